"""Exact centroid clustering that skips vectors whose bounds still hold.

Vectors stand in blocks. In a block, each cluster has a heap of its vectors, ordered by the gap between a vector's distance to its
own centroid (upper bound) and to the second nearest one (lower bound). Centroids that move use this gap up: by the drift of the
cluster's own centroid and the largest drift of any other. So the heap holds each gap plus the drift that its cluster
had accumulated when the vector was placed, and after a round only vectors are popped whose key the accumulated drift has reached. They alone
are compared with all centroids again. Distances are integers; the bounds are roots of them, with a margin beyond any rounding.

The driver holds centroids, sums and drifts of at most ``MAX_CLUSTERS`` clusters. The blocks with their heaps are written to the shared folder each
round, so that a lost executor re-reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ananym.llm.common import prepare_session, written

CLUSTERS = 16
MAX_CLUSTERS = 1024
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
# Squared distances of vectors of up to 64 components below this stay within 63 bits, inner products of those below EXACT within 53.
LARGEST = 1 << 27
EXACT = 1 << 23
# Relative margin of bounds; roots and their sums are right to about 1e-15.
MARGIN = 1e-9


@dataclass(frozen=True)
class Centroids:
    """Where clusters stand, how far each may have brought its vectors towards another one so far, and the moves since the last round."""

    at: np.ndarray  # (clusters, components), integers
    drift: np.ndarray  # accumulated, per cluster

    def moved(self, to: np.ndarray) -> Centroids:
        step = np.sqrt(((to - self.at).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(step, c).max(initial=0) for c in range(len(step))])
        return Centroids(to, self.drift + (step + others) * (1 + MARGIN))


def whole_vectors(vector: Column, components: int) -> Column:
    """True for vectors of that many components, none of them null, infinite or no number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == components) & F.coalesce(finite, F.lit(False))


def integers(vectors: pa.Array, components: int, scale: float) -> np.ndarray:
    values = np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, components)
    whole = np.floor(scale * values)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component times {scale} exceeds {LARGEST}: squared distances would not fit a long")
    return whole.astype(np.int64)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to all centroids."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest < EXACT else np.int64
    inner = (vectors.astype(kind) @ centroids.T.astype(kind)).astype(np.int64)
    return (vectors**2).sum(axis=1)[:, None] - 2 * inner + (centroids**2).sum(axis=1)[None, :]


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cluster (the smaller number of equally near ones) and the drift at which that has to be looked at again."""
    distances = squared_distances(vectors, centroids.at)
    own = distances.argmin(axis=1)
    rows = np.arange(len(own))
    upper = np.sqrt(distances[rows, own].astype(np.float64))
    distances[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(distances.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)) if distances.shape[1] > 1 else np.inf
    return own, lower - upper - MARGIN * (lower + upper) + centroids.drift[own]


class Block:
    """Vectors, their clusters, and a heap of (drift at which it expires, row) for each cluster."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, clusters: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.vectors, self.clusters, self.heaps = ids, vectors, clusters, heaps

    @staticmethod
    def first(ids: pa.Array, vectors: np.ndarray, centroids: Centroids) -> Block:
        own, keys = nearest(vectors, centroids)
        heaps: list[list[tuple[float, int]]] = [[] for _ in centroids.at]
        for row, (cluster, key) in enumerate(zip(own.tolist(), keys.tolist())):
            heaps[cluster].append((key, row))
        for heap in heaps:
            heapify(heap)
        return Block(ids, vectors, own, heaps)

    def rescan(self, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
        """Pop what has expired, compare it with all centroids, and push it again; returns the rows and their earlier clusters."""
        popped: list[int] = []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= centroids.drift[cluster]:
                popped.append(heappop(heap)[1])
        rows = np.array(sorted(popped), np.int64)
        before = self.clusters[rows]
        if len(rows):
            own, keys = nearest(self.vectors[rows], centroids)
            self.clusters[rows] = own
            for row, cluster, key in zip(rows.tolist(), own.tolist(), keys.tolist()):
                heappush(self.heaps[cluster], (key, row))
        return rows, before

    def sums(self, rows: np.ndarray, clusters: np.ndarray, sign: int = 1) -> np.ndarray:
        """Counts and sums of the rows' vectors by cluster, as one row of (1 + components) numbers for each cluster."""
        out = np.zeros((len(self.heaps), 1 + self.vectors.shape[1]), np.int64)
        np.add.at(out[:, 0], clusters, sign)
        np.add.at(out[:, 1:], clusters, sign * self.vectors[rows])
        return out


def _state_type(ids: T.DataType) -> T.StructType:
    """One row for each block: its vectors, heaps one after another, and by how much it changes the sums."""
    fields = {"ids": T.ArrayType(ids), "vectors": T.BinaryType(), "clusters": T.BinaryType(), "sizes": T.ArrayType(T.LongType())}
    fields |= {"keys": T.ArrayType(T.DoubleType()), "rows": T.ArrayType(T.LongType()), "change": T.ArrayType(T.LongType()), "scanned": T.LongType()}
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _stored(block: Block, change: np.ndarray, scanned: int, kind: pa.DataType) -> pa.RecordBatch:
    entries = [entry for heap in block.heaps for entry in heap]
    one = lambda values, of: pa.array([values], pa.list_(of))
    columns = {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids.cast(kind)),
        "vectors": pa.array([block.vectors.astype(np.int32).tobytes()], pa.binary()),
        "clusters": pa.array([block.clusters.astype(np.int32).tobytes()], pa.binary()),
        "sizes": one([len(h) for h in block.heaps], pa.int64()),
        "keys": one([k for k, _ in entries], pa.float64()),
        "rows": one([r for _, r in entries], pa.int64()),
        "change": one(change.ravel(), pa.int64()),
        "scanned": pa.array([scanned], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _loaded(batch: pa.RecordBatch, components: int) -> Iterator[Block]:
    columns = {name: batch.column(name) for name in ("ids", "vectors", "clusters", "sizes", "keys", "rows")}
    for i in range(batch.num_rows):
        vectors = np.frombuffer(columns["vectors"][i].as_py(), np.int32).reshape(-1, components).astype(np.int64)
        clusters = np.frombuffer(columns["clusters"][i].as_py(), np.int32).astype(np.int64)
        entries = iter(list(zip(columns["keys"][i].as_py(), columns["rows"][i].as_py())))
        heaps = [[next(entries) for _ in range(size)] for size in columns["sizes"][i].as_py()]
        yield Block(columns["ids"][i].values, vectors, clusters, heaps)


def _changes(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all blocks' changes: a row for each cluster's count and components, added up in Spark."""
    cells = state.select(F.posexplode("change").alias("cell", "by")).groupBy("cell").agg(F.sum("by").alias("by")).collect()
    out = np.zeros(shape, dtype=object)
    for r in cells:
        out[divmod(r["cell"], shape[1])] = r["by"]
    return out


def _updated(at: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floor of the mean in whole numbers; clusters without vectors stay."""
    after = [[s // n for s in sums] if n else old for old, (n, *sums) in zip(at.tolist(), totals.tolist())]
    return np.array(after, np.int64).reshape(at.shape)


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose key hashes least, in the hash's order; keyless ones come last, equal keys in the order of their components."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), F.col("vector")).limit(k).collect()
    return [r["vector"] for r in rows]


def cluster(
    df: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "centroids",
) -> DataFrame:
    """Clusters of integer vectors ``floor(scale * x)`` after ``rounds`` rounds of exact reassignment and floored means.

    Vectors that are null, have another length or hold null or non-finite components are left out; an empty table, or one without
    whole vectors, gives no rows. Repeated rows and rows without a key each count and give a row; keyless ones become first centroids only
    if others are too few, and with fewer than ``k`` vectors there are fewer clusters. Ties go to the smaller cluster number.
    Vectors too large for their squared distances to fit a long are an error. Other columns are ignored.

    Returns ``id``, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 (of the final centroid's components, joined
    by commas).
    """
    if not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"between 1 and {MAX_CLUSTERS} clusters")
    spark = df.sparkSession
    prepare_session(spark)
    whole = df.where(whole_vectors(F.col(vector), components)).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    first = pa.array(seeds(whole, k), pa.list_(pa.float64()))
    at = integers(first, components, scale)
    kind, state_type = whole.schema["id"].dataType, _state_type(whole.schema["id"].dataType)
    start = here = Centroids(at, np.zeros(len(at)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = Block.first(batch.column("id"), integers(batch.column("vector"), components, scale), start)
                rows = np.arange(len(block.clusters))
                yield _stored(block, block.sums(rows, block.clusters), 0, block.ids.type)

    def rescan(here: Centroids):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _loaded(batch, components):
                    rows, before = block.rescan(here)
                    change = block.sums(rows, block.clusters[rows]) + block.sums(rows, before, -1)
                    yield _stored(block, change, len(rows), block.ids.type)

        return run

    state = written(whole.mapInArrow(place, state_type), f"{label}-state")
    totals = np.zeros((len(at), 1 + components), dtype=object)
    for _ in range(rounds):
        totals = totals + _changes(state, totals.shape)
        here = here.moved(_updated(here.at, totals))
        state = written(state.mapInArrow(rescan(here), state_type), f"{label}-state")
    at = here.at

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _loaded(batch, components):
                distance = ((block.vectors - at[block.clusters]) ** 2).sum(axis=1)
                columns = [block.ids, pa.array(block.clusters.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "cluster", "distance"])

    result = T.StructType([T.StructField(id, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = written(state.mapInArrow(finish, result), f"{label}-assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    per_cluster = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return assigned.withColumns(
        {
            "cluster_inertia": per_cluster([inertia.get(c, 0) for c in range(len(at))] or [0], "long"),
            "inertia": F.lit(sum(inertia.values())).cast("long"),
            "centroid_sha256": per_cluster(digests or [""], "string"),
        }
    )
