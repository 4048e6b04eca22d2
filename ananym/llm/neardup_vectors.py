"""Near-duplicate vectors by cross-polytope hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananym.llm.common import components, local_roots, mix64, prepare_session, signed, written

#: Per table a pair at the least cosine (0.98, 64 components) meets with probability 0.83; over all tables it is missed
#: once in 40 million pairs.
TABLES = 10
HASHES = 3
PROBES = 4
CHOICES = 3
LEAST_COSINE = 0.98
HOME_CHUNK = 2048
PROBER_CHUNK = 65_536
PAIR_BLOCK = 200_000


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list array whose lists have one length as a matrix of doubles."""
    vectors = pa.concat_arrays([vectors])
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def signatures(x: np.ndarray) -> np.ndarray:
    """Bucket numbers (vector, table, probe) of unit vectors; probe 0 is the home bucket.

    Each hash turns the vector by three signed Hadamard transforms and names its nearest signed axis. Further probes replace
    axes by the next nearest ones, those first that lose the least length.
    """
    n, dim = x.shape
    width = max(CHOICES + 1, 1 << max(0, dim - 1).bit_length())
    width = 1 << (width - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    combos = np.array(list(itertools.product(range(CHOICES), repeat=HASHES)))
    combos = combos[np.argsort(combos.sum(axis=1), kind="stable")]
    random = np.random.default_rng(width)
    out = np.empty((n, TABLES, PROBES), np.int64)
    for table in range(TABLES):
        axes, losses = [], []
        for _ in range(HASHES):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice((-1.0, 1.0), width))
            size = np.abs(turned)
            near = np.argsort(-size, axis=1, kind="stable")[:, :CHOICES]
            axes.append(near * 2 + (np.take_along_axis(turned, near, 1) < 0))
            size = np.take_along_axis(size, near, 1)
            losses.append((size[:, :1] - size) ** 2)
        loss = sum(part[:, combos[:, i]] for i, part in enumerate(losses))
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        bucket = np.zeros((n, PROBES), np.int64)
        for i, part in enumerate(axes):
            bucket = bucket * (2 * width) + np.take_along_axis(part[:, combos[:, i]], best, 1)
        out[:, table] = bucket
    return out


def _classes(vectors: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """Rows with their usable vector as doubles and a key of equal vectors; unusable rows have a null key."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))
    # A common scale keeps the squares of very large or small components finite.
    scale = F.array_max(F.transform(doubles, lambda x: F.abs(x)))
    # The scale is a lambda's variable, so that it is not looked for again for each component.
    scaled = F.element_at(F.transform(F.array(scale), lambda most: F.transform(doubles, lambda x: x / most)), 1)
    return vectors.select(
        F.col(key).cast("long").alias("id"), F.when(usable, F.xxhash64(F.col(label).cast("string"), F.size(vector))).alias("kind"),
        F.when(usable, F.xxhash64(doubles)).alias("h"), F.when(usable, F.hash(doubles)).alias("g"), F.when(usable, scaled).alias("vector"),
    )


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell numbers of every vector, table by table: its home and then its probes. Vectors of one kind share a cell if they share a bucket."""
    for batch in batches:
        sizes = np.asarray(batch.column(2).value_lengths())
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            x = matrix(part.column(2))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            buckets = signatures(x)
            kind = np.asarray(part.column(1)).astype(np.int64).view(np.uint64)
            table = mix64(np.arange(TABLES, dtype=np.uint64) + np.uint64(1))
            cells = mix64(mix64(buckets.view(np.uint64) + table[None, :, None]) ^ kind[:, None, None])
            flat = signed(cells.reshape(-1))
            offsets = pa.array(np.arange(len(x) + 1) * TABLES * PROBES, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "cells"])


class _Vectors:
    """Rows of one cell: ids, weights, kinds, vectors with their lengths, and all cells that each is in."""

    def __init__(self, batch: pa.RecordBatch):
        self.id = np.asarray(batch.column("id")).astype(np.int64)
        self.weight = np.asarray(batch.column("weight")).astype(np.int64)
        self.kind = np.asarray(batch.column("kind")).astype(np.int64)
        x = matrix(batch.column("vector"))
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.x = x
        cells = pa.concat_arrays([batch.column("cells")])
        self.cells = np.asarray(cells.flatten()).reshape(len(x), TABLES, PROBES)


def _linked(homes: _Vectors, probers: _Vectors, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (home, prober) at or above the least cosine that meet here first of all their common cells."""
    a_all, b_all = [], []
    step = max(1, PAIR_BLOCK // max(1, len(homes.id)))
    for begin in range(0, len(probers.id), step):
        dots = probers.x[begin : begin + step] @ homes.x.T
        cosine = dots / (probers.norm[begin : begin + step, None] * homes.norm[None, :])
        b, a = np.nonzero((cosine >= least) & (probers.id[begin : begin + step, None] != homes.id[None, :]) & (probers.kind[begin : begin + step, None] == homes.kind[None, :]))
        a_all.append(a)
        b_all.append(b + begin)
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    if not len(a):
        return a, b
    first = np.ones(len(a), bool)
    for begin in range(0, len(a), PAIR_BLOCK // 8):
        part = slice(begin, begin + PAIR_BLOCK // 8)
        sa, sb = homes.cells[a[part]], probers.cells[b[part]]
        to_a = (sb == sa[:, :, :1]).any(axis=2)  # the prober reaches the home's cell, by table
        to_b = (sa == sb[:, :, :1]).any(axis=2)
        earlier = (to_a | to_b)[:, :table].any(axis=1)
        both = to_b[:, table] & (homes.id[a[part]] < probers.id[b[part]])
        first[part] = ~(earlier | both)
    return a[first], b[first]


def _links(least: float):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and chunk, homes first. Homes of a chunk are held (bounded), probers stream past."""
        current, homes, held = None, None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "chunk", "side")], axis=1)
            role = np.asarray(batch.column("prober"))
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (role[1:] != role[:-1])) + 1
            for begin, end in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))):
                if begin == end:
                    continue
                part, key = batch.slice(begin, end - begin), tuple(keys[begin])
                if key != current:
                    current, homes, held = key, None, []
                if not role[begin]:
                    held.append(part)
                    continue
                if not held:
                    continue
                homes = homes or _Vectors(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                probers = _Vectors(part)
                a, b = _linked(homes, probers, int(part.column("table")[0].as_py()), least)
                if not len(a):
                    continue
                ids, place = np.unique(np.concatenate((homes.id[a], probers.id[b])), return_inverse=True)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, place, np.concatenate((probers.weight[b], homes.weight[a])))
                roots = local_roots(place[: len(a)], place[len(a) :], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[roots])], names=["id", "links", "root"])

    return found


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """Groups of vectors linked by a cosine of at least ``least`` within one label.

    Equal vectors of a label are one class with a weight. Each class has a home cell in every table and probes a few
    cells. Cells with much in them are cut into chunks of homes and probers, so that no task holds a hot cell. Candidates are
    compared in double precision in their cell; a pair is counted in the first cell where it meets, so that pairs are
    never listed: tasks return link counts and a spanning tree of what they linked.

    Returns one row per vector: ``key``, ``n_links`` (other rows linked to it directly, equal ones included),
    ``component_id`` (the least key reachable) and ``kept``. Null, empty and zero vectors, those with null or non-finite
    components, and null keys or labels link with nothing; their component is their own key. Vectors of different
    length aren't compared. Rows that repeat are linked with each other. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    prepare_session(spark)
    rows = _classes(vectors, vector, key, label)
    usable = rows.where(F.col("kind").isNotNull())
    classes = written(
        usable.groupBy("kind", "h", "g").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min_by("vector", "id").alias("vector")), "vector-classes"
    )
    signed_rows = written(classes.select("id", "kind", "vector").mapInArrow(_sign, "id long, cells array<long>"), "vector-cells")
    place = F.col("place")
    cells = signed_rows.select("id", F.posexplode("cells").alias("place", "cell"))
    cells = cells.select("id", "cell", F.floor(place / PROBES).cast("int").alias("table"), (place % PROBES == 0).alias("home"))
    busy = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("probers")).where("homes > 0 and probers > 1")
    busy = busy.select("cell", F.ceil(F.col("homes") / HOME_CHUNK).alias("chunks"), F.ceil(F.col("probers") / PROBER_CHUNK).alias("sides"))
    busy = written(busy, "vector-busy")  # a table of its own, so that Spark can split a hot cell of the join
    met = cells.join(busy.hint("merge"), "cell")
    salt = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    homes = met.where("home").withColumn("chunk", F.pmod(salt, "chunks").cast("int")).withColumn("side", every("sides")).withColumn("prober", F.lit(False))
    probers = met.withColumn("side", F.pmod(salt, "sides").cast("int")).withColumn("chunk", every("chunks")).withColumn("prober", F.lit(True))
    columns = ["id", "cell", "table", "chunk", "side", "prober"]
    # A vector travels with its cells, so that the first cell of a pair is known without hashing again.
    whole = classes.join(signed_rows.hint("merge"), "id").select("id", "weight", "kind", "vector", "cells")
    sides = homes.select(columns).union(probers.select(columns)).join(whole.hint("merge"), "id")
    dealt = sides.select(*columns, "weight", "kind", "vector", "cells").repartition("cell", "chunk", "side").sortWithinPartitions("cell", "chunk", "side", "prober", "id")
    found = written(dealt.mapInArrow(_links(least), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-groups")
    known = classes.select("kind", "h", "g", "id", "weight").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("kind", "h", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.drop("vector").join(known.hint("merge"), ["kind", "h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
