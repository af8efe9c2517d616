"""Rows without an id are compared like others."""

from __future__ import annotations

import random

import pytest

from dialoom.llm import near_dedup


@pytest.mark.parametrize("options", [{}, {"node_rows": 2, "task_elements": 150, "broadcast_rows": 0}])
def test_rows_without_an_id(spark, options):
    rng = random.Random(3)
    text = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(5)]
    near = [t + " more" for t in text]
    rows = [
        (1, text[0], "a"), (None, near[0], "b"), (None, near[0], "c"),  # a near copy of a text with an id
        (None, text[1], "d"), (None, near[1], "e"), (None, text[1], "f"),  # near and exact copies, none with an id
        (7, text[2], "g"), (8, near[2] + " words", "h"), (None, near[2], "i"),
        (None, text[3], "j"), (9, text[4], "k"), (None, "", "l"), (None, None, "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    got = near_dedup.near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    assert sorted(r.component_id for r in got if r.doc_id is None and r.component_id is not None) == [1, 1, 7]
    assert {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None} == {1: (1, True), 7: (7, True), 8: (7, False), 9: (9, True)}
    assert sum(r.kept for r in got if r.doc_id is None) == 4  # one of d, e, f; j; both blank texts
    kept = near_dedup.one_of_each(docs, **options)
    marks = {r.mark for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == len(marks) == 7
    assert {"a", "g", "j", "k", "l", "m"} < marks and len(marks & set("def")) == 1
