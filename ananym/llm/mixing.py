"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ananym.llm.common import WORD, hash_order, prepare_session, running_totals, spread, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
#: By the weight's place: relative weight at the times 0, 1/2 and 1 of the training run.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_key(source: str) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: ``__key, source_size, place, target``.

    Targets are a common level times the weight, or twice the source's size where that is less. Sources are put in
    order of the level at which they reach that stop; a source is stopped if the level that the sources from it on
    would get lies at or above its own. The windows run over one row per source.
    """
    total = sized.groupBy("__key").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_docs"))
    nth = F.row_number().over(Window.orderBy("__key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") + 1).cast("int"))
    table = total.withColumn("place", F.pmod(nth, F.lit(len(weights)))).withColumn("weight", weight)
    table = table.withColumn("stop", F.col("source_size") * MOST_REPEATS).withColumn("level", F.col("stop") / F.col("weight"))
    by_level = Window.orderBy("level", "__key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    words = F.sum("source_size").over(everything) * F.lit(float(share))
    reach = (words - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(onward)
    table = table.withColumn("reach", reach).withColumn("stopped", F.col("level") <= F.col("reach"))
    free = F.min(F.when(~F.col("stopped"), F.struct("level", "__key", "reach"))).over(everything)["reach"]
    target = F.when(F.col("stopped"), F.col("stop").cast("double")).otherwise(free * F.col("weight"))
    return table.withColumn("target", target).select("__key", "source_size", "place", "target")


def demand_inverse(share: Column, schedule: tuple[float, ...]) -> Column:
    """The time at which the integral of a piecewise linear schedule has reached ``share`` of its whole."""
    step = 1.0 / (len(schedule) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    whole, done, out = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for i, area in enumerate(areas):
        pieces.append((i, done / whole, area, schedule[i], schedule[i + 1]))
        done += area
    for i, begin, _, a, b in reversed(pieces):
        # a*x + (b-a)*x^2/(2*step) = y, solved without division by the slope.
        y = (share - begin) * whole
        slope = (b - a) / step
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2.0 * slope * y))
        time = F.lit(i * step) + F.when(y <= 0, 0.0).otherwise(2.0 * y / (F.lit(a) + root))
        out = time if i == len(pieces) - 1 else F.when(share < pieces[i + 1][1], time).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def curriculum(
    docs: DataFrame,
    size: Column,
    keep: list[str],
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
) -> DataFrame:
    """Training positions of every document.

    Every source stands in the order of its keys' md5 and is read from its start, again from the start when it ends. Its
    weight over time, integrated, is the demand for its words: a document copy begins when that demand reaches the words
    before it. A copy is taken if its middle lies below the source's target, so that what is taken differs from the
    target by half a document at most, and no document is taken more than twice.

    Returns the columns ``keep`` plus ``size, source_size, target, taken`` and ``positions`` (times from 0 to 1, one
    per copy taken). Null text has size 0; a document of size 0 is never taken. Null sources are one source, the last.
    Rows that repeat are documents of their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare_session(spark)
    wanted = docs.select(hash_order(F.col(key)).alias("__id"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"), source_key(source).alias("__key"), *keep)
    # Rows of one key stand in the order of size, then of what is kept; equal rows in any order.
    wanted = wanted.withColumns({"__rest": spread(*keep), "__salt": spread(F.monotonically_increasing_id())})
    sized = written(wanted, "mix-sizes")
    targets = written(source_targets(sized, weights, share), "mix-targets")
    placed = running_totals(sized, ["__key"], ["__id", "__size", "__rest", "__salt"], "__size", sized.count(), "__before", frozenset({"__size"}))
    joined = placed.join(targets, "__key")
    size_, target, start = F.col("__size"), F.col("target"), F.col("__before")
    copies, begun = F.lit(0), []
    for c in range(MOST_REPEATS):
        begin = start + c * F.col("source_size")
        taken = (size_ > 0) & (begin + size_ / 2 < target)
        copies = copies + taken.cast("int")
        at = F.lit(None).cast("double")
        for place, schedule in enumerate(schedules):
            at = F.when(F.col("place") % len(schedules) == place, demand_inverse(begin / target, schedule)).otherwise(at)
        begun.append(F.when(taken, at))
    return joined.select(
        *keep,
        size_.alias("size"),
        "source_size",
        "target",
        (size_ * copies).cast("long").alias("taken"),
        F.array_compact(F.array(*begun)).alias("positions"),
    )


def training_order(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per copy taken, range-sorted by position."""
    copies = placed.withColumn("position", F.explode("positions")).drop("positions")
    return copies.repartitionByRange("position", key).sortWithinPartitions("position", key)


def word_count(text: str = "text") -> Column:
    """Number of words in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, one row per copy, in training order; columns of ``docs``.

    Positions are found for hashes of rows, without texts; one join then brings the rows back. Rows equal in all columns are
    placed each for itself. An empty table stays empty.
    """
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    values = [F.col(f"`{c}`") for c in docs.columns]
    # All columns travel in one struct, so that no name of theirs can clash.
    narrow = docs.select(F.struct("*").alias("__row"), F.xxhash64(*nulls, *values).alias("__m1"), F.xxhash64(F.lit(1), *values, *nulls).alias("__m2"))
    sizes = docs.select(
        F.col(text).alias("__text"), F.col(source).alias("__source"), F.xxhash64(*nulls, *values).alias("__m1"), F.xxhash64(F.lit(1), *values, *nulls).alias("__m2")
    )
    placed = curriculum(sizes, word_count("__text"), ["__m1", "__m2"], "__source", "__m1")
    copies = placed.select("__m1", "__m2", F.explode("positions").alias("__position"))
    rows = narrow.dropDuplicates(["__m1", "__m2"]).join(copies.hint("merge"), ["__m1", "__m2"])
    return rows.repartitionByRange("__position", "__m1").sortWithinPartitions("__position", "__m1").select("__row.*")
