"""Exact search for the largest inner products by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananym.llm.common import prepare_session, written

PIVOTS = 16
RINGS = 8
#: Vectors from which pivots are chosen, by hash order.
SAMPLE = 2048
QUERY_CHUNK = 1024
DATA_CHUNK = 16_384
#: Rings of a query that are searched in each step, by falling bound; every step stops at the best scores so far.
STEPS = (8, 24, PIVOTS * RINGS)
#: Products of whole numbers are exact in doubles below this.
EXACT = 2.0**53
#: What stands for "no score": all scores lie above.
NO_SCORE = -(2**63 - 1)
#: Blocks of queries times rings up to which the wanted ones are sent to all tasks as lists (16 MB).
LISTED_SIDES = 1 << 22


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    distance = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _padded(vectors: pa.Array, dim: int) -> np.ndarray:
    vectors = pa.concat_arrays([vectors])
    sizes = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), dtype=np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _pieces(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as sums of doubles of at most 2^bits times powers of 2^bits."""
    out = []
    while True:
        low = x & ((1 << bits) - 1)
        high = x >> bits
        if ((high == 0) | (high == -1)).all():
            # What is left has bits + 1 bits at most, its sign included.
            return [*out, x.astype(np.float64)]
        out.append(low.astype(np.float64))
        x = high


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of two blocks of long vectors whose products fit a long.

    Where doubles could round, components are cut into pieces whose products are exact; their sum wraps around like
    whole numbers of 64 bits do and so ends at the right one.
    """
    dim = q.shape[1]
    largest = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (q, x)]
    if largest[0] * largest[1] * dim < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    bits = (52 - max(1, dim - 1).bit_length()) // 2
    out = np.zeros((len(q), len(x)), np.int64)
    for i, a in enumerate(_pieces(q, bits)):
        for j, b in enumerate(_pieces(x, bits)):
            shift = bits * (i + j)
            if shift < 64:
                out += (a @ b.T).astype(np.int64) << shift
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties in the order of columns."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _search(dim: int, k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, queries first, then vectors by id: queries are held (bounded), vectors stream past."""
        current, held, asked, q, best = None, [], None, None, None

        def told():
            scores, ids = best
            row, rank = np.nonzero(scores != NO_SCORE)
            return pa.RecordBatch.from_arrays(
                [pa.array(asked[row]), pa.array(ids[row, rank]), pa.array(scores[row, rank])], names=["query_id", "vec_id", "score"]
            )

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "part", "side")], axis=1)
            data = np.asarray(batch.column("data"))
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (data[1:] != data[:-1])) + 1
            for begin, end in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))):
                if begin == end:
                    continue
                part, key = batch.slice(begin, end - begin), tuple(keys[begin])
                if key != current:
                    if best is not None:
                        yield told()
                    current, held, best = key, [], None
                if not data[begin]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if best is None:
                    queries = pa.Table.from_batches(held)
                    asked = np.asarray(queries.column("id")).astype(np.int64)
                    q = _padded(queries.column("vector").combine_chunks(), dim)
                    best = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0), np.int64)
                ids = np.asarray(part.column("id")).astype(np.int64)
                scores = inner_products(q, _padded(part.column("vector"), dim))
                scores[asked[:, None] == ids[None, :]] = NO_SCORE
                best = _best(np.hstack((best[0], scores)), np.hstack((best[1], np.broadcast_to(ids, scores.shape))), k)
        if best is not None:
            yield told()

    return found


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, scale: int = 1024, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` largest integer inner products of every query row with all other rows; exact.

    Components become floor(scale * x). Every vector is keyed by its nearest pivot and a ring of its distance to it. For a query
    q at distance D of a pivot, a vector x whose distance lies in [r, R] is at least max(0, r - D, D - R) away, which bounds its
    score by (|q|^2 + |x|^2 - gap^2) / 2. Every query first searches the rings with the greatest bounds; its k-th best
    score then stops all rings bounded below it, and the rest is searched in further steps. Queries whose own rings are the same or neighbours are asked
    together, in bounded blocks, and a ring's vectors go only to blocks with a query that still wants them.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id; fewer rows if there are fewer candidates. Scores are exact
    whole numbers; if the longest query times the longest vector reaches 2^63, so that a long might not hold a score, an
    ``OverflowError`` is raised. Null ids, null vectors and those with null or non-finite components take no part; shorter vectors count as
    padded with zeros. Rows with the query's own id are not its candidates and an id asks once; other repeated rows each
    count. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    prepare_session(spark)
    own = F.col(vector)
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(own, lambda x: F.floor(x.cast("double") * scale))
    usable = vectors.where(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)))
    points = written(usable.select(F.col(key).cast("long").alias("id"), whole.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "search-points")
    dim, count, n_queries = points.agg(F.max(F.size("vector")), F.count("*"), F.count_if("asks")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    sample = points.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toArrow()
    pivots = choose_pivots(_padded(sample.column("vector").combine_chunks(), dim).astype(np.float64))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(1), dim).astype(np.float64)
            norm = (x * x).sum(axis=1)
            # By differences, not by products: so a short distance is as exact as a long one.
            distance = np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))
            near = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(distance[np.arange(len(x)), near]), pa.array(np.sqrt(norm)), pa.array(list(distance))],
                names=["id", "vector", "asks", "pivot", "distance", "norm", "distances"],
            )

    index = written(
        points.mapInArrow(keyed, "id long, vector array<long>, asks boolean, pivot int, distance double, norm double, distances array<double>"), "search-index"
    )
    longest, longest_query = index.agg(F.max("norm"), F.max(F.when(F.col("asks"), F.col("norm")))).first()
    if longest * longest_query >= 2.0**63 * (1 - 1e-6):
        raise OverflowError("scores may not fit a long: use a smaller scale")
    edges = index.groupBy("pivot").agg(F.percentile_approx("distance", [i / RINGS for i in range(1, RINGS)], 1000).alias("edges"))
    # At most one row per pivot and per ring: bounded by PIVOTS * RINGS.
    placed = index.join(F.broadcast(edges), "pivot").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("distance"))))
    placed = placed.withColumn("cell", F.col("pivot") * RINGS + F.col("ring"))
    rings = placed.groupBy("pivot", "cell").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.max("norm").alias("longest"), F.count("*").alias("n"))
    rings = written(rings.withColumn("parts", F.ceil(F.col("n") / DATA_CHUNK)), "search-rings")

    # An id asks once: among several rows the least vector does. Blocks of queries ("sides") hold queries of one ring, or of neighbouring ones.
    asking = placed.where("asks").groupBy("id").agg(F.min(F.struct("vector", "norm", "distances", "cell")).alias("own")).select("id", "own.*")
    asking = written(asking, "search-queries")
    blocks, sides, room = [], 0, 0
    for r in asking.groupBy("cell").count().orderBy("cell").collect():
        own = -(-r["count"] // QUERY_CHUNK)
        if own == 1 and r["count"] <= room:
            # Neighbouring rings with few queries share a block.
            blocks.append((r["cell"], sides - 1, 1))
            room -= r["count"]
        else:
            blocks.append((r["cell"], sides, own))
            sides += own
            room = QUERY_CHUNK - r["count"] if own == 1 else 0
    begin = F.create_map(*[F.lit(x) for c, first, _ in blocks for x in (c, first)])
    within = F.create_map(*[F.lit(x) for c, _, own in blocks for x in (c, own)])
    side = F.element_at(begin, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(within, F.col("cell"))).cast("int")
    queries = asking.select("id", "vector", "norm", "distances", side.alias("side"))
    # At most PIVOTS * RINGS rings: they are written into the plan, and each query lists them with their bounds.
    known = rings.orderBy("cell").collect()
    fields = ("pivot", "cell", "parts", "inner", "outer", "longest")
    listed = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in known])
    each = queries.select("id", "norm", "distances", F.explode(listed).alias("ring")).select("id", "norm", "distances", "ring.*")
    away = F.element_at("distances", F.col("pivot") + 1)
    gap = F.greatest(F.lit(0.0), F.col("inner") - away, away - F.col("outer"))
    # More than any rounding of squares, which grows with the numbers.
    slack = (F.col("norm") + 2 * longest) ** 2 * (1e-14 * (dim + 16)) + 1
    bound = (F.col("norm") ** 2 + F.col("longest") ** 2 - gap * gap) / 2 + slack
    plan = each.select("id", "cell", "parts", bound.alias("bound"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bound"), "cell"))
    plan = written(plan.withColumn("nth", nth), "search-plan")
    pieces = placed.select("id", "vector", "cell").join(F.broadcast(rings.select("cell", "parts")), "cell")
    pieces = pieces.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("data"))
    columns = ["query_id", "vec_id", "score"]

    def searched(wanted: DataFrame) -> DataFrame:
        asked = wanted.join(queries.select("id", "vector", "side"), "id")
        if sides * len(known) <= LISTED_SIDES:
            # At most one number per ring and block.
            open_sides = asked.groupBy("cell").agg(F.collect_set("side").alias("sides"))
            sent = pieces.join(F.broadcast(open_sides), "cell").withColumn("side", F.explode("sides")).drop("sides")
        else:
            sent = pieces.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
        ask = asked.select("id", "vector", "cell", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(False).alias("data"), "side")
        met = ask.unionByName(sent).repartition("cell", "part", "side").sortWithinPartitions("cell", "part", "side", "data", "id")
        return met.mapInArrow(_search(dim, k), "query_id long, vec_id long, score long")

    best, done = None, 0
    for step in STEPS:
        wanted = plan.where((F.col("nth") > done) & (F.col("nth") <= step))
        if best is None:
            found = searched(wanted)
        else:
            reached = best.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("kth"), F.count("*").alias("found"))
            still = F.coalesce(F.col("found") < k, F.lit(True)) | (F.col("bound") >= F.col("kth"))
            found = best.union(searched(wanted.join(reached, "id", "left").where(still).select(wanted.columns)))
        best = written(_top(found, k).select(columns), "search-best")
        done = step
        if done >= len(known):
            break
    return _top(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
