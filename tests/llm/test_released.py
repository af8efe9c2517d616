"""Workers give memory back after each task's work."""

from __future__ import annotations

import pyarrow as pa
import pytest
from dialoom.llm import common


def test_memory_is_released_after_the_last_batch_and_after_a_fault(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    rows = [pa.RecordBatch.from_pydict({"a": [k]}) for k in range(3)]
    got = common.released(lambda batches: (b for b in batches))(iter(rows))
    assert next(got) is rows[0] and not released
    assert list(got) == rows[1:] and len(released) == 1
    with pytest.raises(ZeroDivisionError):
        list(common.released(lambda batches: (1 / 0 for _ in batches))(iter(rows)))
    assert len(released) == 2
