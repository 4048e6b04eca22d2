"""Near-duplicate vectors and exact search against plain versions."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ananym.llm import neardup_vectors, topk


@pytest.fixture(scope="module")
def vector_rows():
    random = np.random.default_rng(3)
    rows = []

    def add(x, label):
        rows.append((len(rows), None if x is None else [None if c is None else float(c) for c in x], label))

    for group in range(6):
        base = random.normal(size=24)
        for _ in range(12):
            add((base + random.normal(size=24) * random.uniform(0, 0.2)).astype(np.float32), group % 3)
    for _ in range(60):
        add(random.normal(size=24).astype(np.float32), int(random.integers(0, 3)))
    same = random.normal(size=24).astype(np.float32)
    for i in range(5):
        add(same, 1 if i < 4 else 2)
    add(same * 3, 1)
    add(same, None)
    add(np.zeros(24), 1)
    add(None, 1)
    add([], 1)
    add([1.0, None] + [0.0] * 22, 1)
    add([math.nan] + [1.0] * 23, 1)
    add([math.inf] + [1.0] * 23, 1)
    add([1.0, 2.0], 1)
    add([1.0, 2.0], 1)
    rows.append((rows[80][0], rows[80][1], rows[80][2]))  # a row that repeats
    rows.append((None, rows[0][1], 0))
    return rows


@pytest.fixture(scope="module")
def vectors(spark, vector_rows):
    out = spark.createDataFrame(vector_rows, "vec_id long, embedding array<float>, label int")
    return out.withColumns({c: F.lit(1) for c in ("id", "kind", "cell", "vector", "n", "score", "rank", "g")})


def usable(row) -> bool:
    key, x, _ = row
    return key is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)


def test_groups(vectors, vector_rows):
    rows = [r for r in vector_rows if usable(r) and r[2] is not None and any(r[1])]
    links, near = defaultdict(int), defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
            if i != j and a[2] == b[2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a[0]] += 1
                near[a[0]].add(b[0])
    repeated = vector_rows[80][0]
    links[repeated] //= 2  # counted for both of its rows

    def root(key):
        seen, todo = {key}, [key]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        return min(seen)

    out = neardup_vectors.near_duplicates(vectors).collect()
    assert len(out) == len(vector_rows)
    for r in out:
        key = r["vec_id"]
        want = (0, None, True) if key is None else (links[key], root(key), root(key) == key)
        assert (r["n_links"], r["component_id"], r["kept"]) == want
    assert sum(r["n_links"] for r in out) > 200
    assert neardup_vectors.near_duplicates(vectors.limit(0)).count() == 0


def test_large_cells_are_cut(spark, monkeypatch):
    """One group of near copies whose cells fall into many chunks: every pair is counted once."""
    monkeypatch.setattr(neardup_vectors, "HOME_CHUNK", 16)
    monkeypatch.setattr(neardup_vectors, "PROBER_CHUNK", 64)
    random = np.random.default_rng(4)
    base = random.normal(size=32)
    rows = [(i, (base + random.normal(size=32) * 0.02).tolist(), 0) for i in range(120)]
    out = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(119, 0)}


def test_search(vectors, vector_rows):
    rows = [(k, np.floor(1024 * np.float32(x).astype(float)).astype(np.int64)) for k, x, _ in filter(usable, vector_rows)]
    want = []
    dot = lambda a, b: int(sum(int(s) * int(t) for s, t in zip(a, b)))
    for q, x in {k: x for k, x in rows if k % 10 == 0}.items():
        best = sorted(((-dot(x, y), k) for k, y in rows if k != q))[:10]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    out = topk.top_inner_products(vectors, F.col("vec_id") % 10 == 0)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert topk.top_inner_products(vectors.limit(0), F.lit(True)).count() == 0
    few = vectors.where("vec_id in (0, 1, 10)")
    assert topk.top_inner_products(few, F.col("vec_id") % 10 == 0).count() == 4


def test_search_stops_by_bounds(spark):
    """Tight clusters far from each other: later rings are skipped and results stay exact."""
    random = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] * 4 + random.normal(size=8) * 0.01).tolist()) for i in range(800)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(map(tuple, topk.top_inner_products(data, F.col("vec_id") % 100 == 0).collect()))
    whole = np.floor(1024 * np.array([x for _, x in rows])).astype(np.int64)
    want = []
    for q in range(0, 800, 100):
        score = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert out == want


def exact_search(rows, every: int) -> list[tuple[int, int, int, int]]:
    """Plain search in Python's whole numbers; ``rows`` are (id, whole components)."""
    out = []
    for q, x in rows:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), k) for k, y in rows if k != q)[:10]
            out += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size, dim", [(30.0, 16), (1e4, 16), (5e5, 7), (2e5, 64)])
def test_search_is_exact_at_any_size(spark, size, dim):
    """Products up to the end of a long, where sums in doubles would be rounded."""
    random = np.random.default_rng(6)
    base = random.normal(size=(5, dim))
    data = [(i, ((base[i % 5] + random.normal(size=dim) * 0.01) * size).tolist()) for i in range(200)]
    rows = [(i, [math.floor(1024 * c) for c in x]) for i, x in data]
    out = topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, out.collect())) == exact_search(rows, 20)


def test_search_of_short_queries_and_long_vectors(spark):
    """One side's components need three pieces."""
    data = [(i, [float(i % 7 - 3) / 1024, 2.0 / 1024] if i % 10 == 0 else [(2.0**49 + 3 * i) / 1024 * (-1) ** i, (2.0**50 - i) / 1024]) for i in range(60)]
    rows = [(i, [math.floor(1024 * c) for c in x]) for i, x in data]
    out = topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 10)
    want = [(q, r, k, s) for q, r, k, s in exact_search(rows, 10) if q % 20 == 10]
    assert sorted(map(tuple, out.collect())) == want


def test_search_refuses_scores_beyond_a_long(spark):
    data = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_inner_products(data, F.lit(True))


def test_products_of_pieces():
    random = np.random.default_rng(8)
    for high_q, high_x, dim in ((10, 10, 5), (40, 20, 64), (29, 29, 7), (55, 3, 3), (2, 57, 9)):
        q, x = (random.integers(-(2**h), 2**h, size=(6, dim)) for h in (high_q, high_x))
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
        assert topk.inner_products(q, x).tolist() == want


def test_many_blocks_of_queries(spark, monkeypatch):
    """Small blocks on both sides, with and without lists of the blocks that want a ring."""
    monkeypatch.setattr(topk, "QUERY_CHUNK", 3)
    monkeypatch.setattr(topk, "DATA_CHUNK", 20)
    random = np.random.default_rng(9)
    data = [(i, (np.eye(6)[i % 6] * (i % 3) + random.normal(size=6) * 0.05).tolist()) for i in range(400)]
    rows = [(i, [math.floor(1024 * c) for c in x]) for i, x in data]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for most in (1 << 22, 0):
        monkeypatch.setattr(topk, "LISTED_SIDES", most)
        assert sorted(map(tuple, topk.top_inner_products(table, F.col("vec_id") % 8 == 0).collect())) == exact_search(rows, 8)
