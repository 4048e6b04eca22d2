"""Centroid clustering with heap-ordered bounds against plain rounds of exact assignment."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from ananym.llm import centroids


def plain(rows, k, rounds, components, scale):
    """(id, cluster, distance, cluster_inertia, inertia, digest) by comparing all vectors with all centroids in Python integers."""
    whole = [
        (i, tuple(math.floor(scale * x) for x in v))
        for i, v in rows
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    at = [v for _, v in sorted(whole, key=lambda r: (digest(r[0]), r[1]))[:k]]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(at)) for _, v in whole]
    for _ in range(rounds):
        own = assign()
        groups = [[v for (_, v), (_, j) in zip(whole, own) if j == c] for c in range(len(at))]
        at = [tuple(sum(x) // len(g) for x in zip(*g)) if g else old for old, g in zip(at, groups)]
    final = assign()
    inertia = [sum(d for d, j in final if j == c) for c in range(len(at))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia), digests[j]) for (i, _), (d, j) in zip(whole, final)), key=str)


@pytest.fixture(scope="module")
def rows():
    source = random.Random(3)
    middles = [[source.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + source.gauss(0, 0.4) for x in source.choice(middles)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [None] + [0.5] * 7), (304, [float("nan")] + [0.5] * 7), (305, [float("inf")] * 8)]
    return rows + [(306, [0.0] * 8), (307, [0.0] * 8), (7, rows[7][1]), (7, rows[8][1]), (None, [0.25] * 8), (None, [0.25] * 8)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, id int")


@pytest.mark.parametrize(("k", "rounds", "scale"), [(4, 3, 64), (16, 6, 1), (1, 2, 64), (400, 2, 64), (6, 0, 4)])
def test_equals_plain_rounds(spark, rows, k, rounds, scale):
    got = centroids.cluster(table(spark, rows), k, rounds, components=8, scale=scale).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, k, rounds, 8, scale)


def test_large_components_stay_exact(spark):
    source = random.Random(4)
    rows = [(i, [float(source.randint(-(1 << 27), 1 << 27)) for _ in range(4)]) for i in range(60)]
    got = centroids.cluster(table(spark, rows), 5, 3, components=4, scale=1).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 5, 3, 4, 1)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(table(spark, [(1, [1e30] * 4)]), components=4).collect()


def test_no_vectors(spark, rows):
    assert centroids.cluster(table(spark, rows).limit(0)).count() == 0
    assert centroids.cluster(table(spark, rows)).count() == 0


def test_only_expired_vectors_are_rescanned(rows):
    import pyarrow as pa

    vectors = np.floor(64 * np.array([v for _, v in rows[:300]])).astype(np.int64)
    here = centroids.Centroids(vectors[:5].copy(), np.zeros(5))
    block = centroids.Block.first(pa.array(range(300)), vectors, here)
    here = here.moved(here.at + 1)
    popped, _ = block.rescan(here)
    assert 0 < len(popped) < 150
    assert (block.clusters == centroids.squared_distances(vectors, here.at).argmin(axis=1)).all()
    assert sorted(r for heap in block.heaps for _, r in heap) == list(range(300))
