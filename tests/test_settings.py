"""Settings and documents on disk."""

from __future__ import annotations

import json
from dataclasses import asdict

import pytest

from dialoom.settings import Settings, read_settings
from dialoom.sources import io


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(asdict(Settings(top_k_candidates=7)), indent=2))
    assert read_settings(spark, str(path)) == Settings(top_k_candidates=7)
    given = asdict(Settings())
    del given["top_preserved"]
    path.write_text(json.dumps(given))
    with pytest.raises(KeyError, match="top_preserved"):
        read_settings(spark, str(path))


def test_a_document_comes_back(spark, tmp_path):
    row = spark.createDataFrame([(1, "é", [0.5], None)], "a int, b string, c array<double>, d string")
    io.write_document(row, str(tmp_path / "doc"))
    (file,) = (tmp_path / "doc").glob("part-*")
    assert json.loads(file.read_text()) == {"a": 1, "b": "é", "c": [0.5], "d": None} and "\n    " in file.read_text()
