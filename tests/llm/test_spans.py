"""What spans of words take in memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from ananym.llm import substrings


def test_spans_take_no_object_each():
    """Spans of a batch, next to null, empty and sliced lists, are read as arrays."""
    n = 200_000
    spans = pa.array(np.arange(n, dtype=np.int32))
    pairs = pa.StructArray.from_arrays([spans, pa.array(np.arange(n, dtype=np.int32) + 20)], names=["begin", "end"])
    lists = pa.ListArray.from_arrays(pa.array([0, 5, None, 5, n], pa.int32()), pairs)
    assert lists.null_count == 1 and [len(x or []) for x in lists.to_pylist()] == [5, 0, 0, n - 5]
    tracemalloc.start()
    rows, begin, end = substrings.listed(lists)
    gone = substrings.covered(begin, end, n + 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n
    assert np.bincount(rows).tolist() == [5, 0, 0, n - 5] and (begin == np.arange(n)).all() and (end == begin + 20).all()
    assert gone.tolist() == [True] * (n + 19) + [False] * 11
    rows, begin, _ = substrings.listed(lists.slice(1))
    assert np.bincount(rows).tolist() == [0, 0, n - 5] and begin[0] == 5
