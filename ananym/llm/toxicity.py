"""Severity of toxic texts by ordinal regression on words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ananym.llm.common import byte_slices, prepare_session, split_words, written

#: Most labelled rows that are fitted on, by hash order of the key.
TRAIN_ROWS = 20_000
FEATURES = 1024
LEAST_DOCUMENTS = 3
PREFIXES = (4, 5, 6)
#: A labelled text gets a grade for each of these numbers of marked words that it reaches; 0 is the label alone.
GRADE_STEPS = (0, 3, 8)
STEPS = 400
PENALTY = 1e-4
REJECT = 0.25
HELD_OUT_FOLDS = 5


@dataclass
class SeverityModel:
    """``weights`` of the named features, shared by all thresholds; thresholds ascend."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeding(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def held_out(key: Column, folds: int = HELD_OUT_FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def word_features(word: bytes) -> list[str]:
    """The word without marks at its ends, and its beginnings."""
    plain = word.decode(errors="replace").strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—")
    if not plain:
        return []
    return [plain, *[f"{plain[:n]}*" for n in PREFIXES if len(plain) >= n]]


def text_features(texts: pa.Array, features: dict[str, int] | None) -> tuple[np.ndarray, list | np.ndarray, np.ndarray]:
    """(text, feature, times); features are numbers of a given dictionary, or else all features by name."""
    codes, words, bounds = split_words(texts, lower=True)
    names: list = []
    owners: list[int] = []
    for i, word in enumerate(words):
        for name in word_features(word):
            found = name if features is None else features.get(name)
            if found is not None:
                names.append(found)
                owners.append(i)
    if features is None:
        names, numbers = np.unique(np.array(names, dtype=object), return_inverse=True) if names else (np.array([], object), np.array([], np.int64))
    else:
        numbers = np.array(names, np.int64)
    owners = np.array(owners, np.int64)
    starts = np.searchsorted(owners, np.arange(len(words) + 1))
    counts = np.diff(starts)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    each = counts[codes]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[:-1][codes], each)
    width = max(1, len(names) if features is None else len(features))
    pairs, times = np.unique(np.repeat(row, each) * width + numbers[place], return_counts=True)
    number = pairs % width
    return pairs // width, (names[number] if features is None else number), times


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str, key: str) -> DataFrame:
    """Up to ``rows`` labelled texts outside the held-out fold: ``id, text, label``. A key with several labels takes the largest."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    chosen = chosen.groupBy(F.col(key).alias("id")).agg(F.max(label).alias("label"))
    # The sample has a fixed bound, so it may be broadcast.
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")


def _fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of a cumulative-link model, by gradient steps with momentum and scaling (Adam)."""
    n, cuts = len(grades), len(GRADE_STEPS)
    rates = [np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(cuts)]
    start = np.maximum.accumulate([np.log((1 - r) / r) for r in rates])
    gaps = np.maximum(np.diff(start), 0.1)
    params = np.concatenate((np.zeros(n_features), [start[0]], np.log(gaps)))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    # P(grade = k) is the difference of two logistic curves; index -1 and `cuts` stand for the open ends.
    for step in range(1, STEPS + 1):
        weights, first, gap = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        cut = first + np.concatenate(([0.0], np.cumsum(gap)))
        score = np.bincount(row, weights=weights[feature] * value, minlength=n)
        above = np.ones((n, cuts + 2))
        above[:, 1 : cuts + 1] = 1 / (1 + np.exp(-np.clip(score[:, None] - cut[None, :], -60, 60)))
        above[:, cuts + 1] = 0
        slope = above * (1 - above)
        at = np.arange(n)
        share = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        by_score = (slope[at, grades] - slope[at, grades + 1]) / share
        by_cut = np.zeros((n, cuts + 2))
        by_cut[at, grades] -= slope[at, grades] / share
        by_cut[at, grades + 1] += slope[at, grades + 1] / share
        d_cut = by_cut[:, 1 : cuts + 1].sum(axis=0) / n
        d_weight = np.bincount(feature, weights=by_score[row] * value, minlength=n_features) / n - PENALTY * weights
        tail = np.cumsum(d_cut[::-1])[::-1]
        gradient = np.concatenate((d_weight, [tail[0]], tail[1:] * gap))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient * gradient
        params = params + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gap = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate(([0.0], np.cumsum(gap)))


def fit_severity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> SeverityModel:
    """Learn severity from binary labels of at most ``rows`` rows.

    Features (words, and their beginnings) that tell the labels apart best are chosen by counts in Spark. Grades: 0 without the label;
    with it 1, and one more for each step of ``GRADE_STEPS`` that the number of words with a marked feature reaches.
    The driver sees the chosen features of the sample only, both bounded. Without labelled rows of both kinds, or without documents, every
    text gets severity 0. Null labels, labels with a null key and labels without a document are left out; a key with several labels takes the
    largest. Null texts count as empty ones.
    """
    spark = docs.sparkSession
    prepare_session(spark)
    sample = written(training_sample(docs, labels, label, rows, text, key), "severity-sample")
    totals = {bool(r["label"]): r["count"] for r in sample.groupBy((F.col("label") > 0).alias("label")).count().collect()}
    if len(totals) < 2:
        return SeverityModel({}, np.zeros(0), np.full(len(GRADE_STEPS), 60.0))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                row, names, _ = text_features(part.column(0), None)
                toxic = np.asarray(part.column(1)) > 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic[row])], names=["feature", "toxic"])

    counts = sample.select("text", "label").mapInArrow(named, "feature string, toxic boolean").groupBy("feature").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    # Features in order of the likelihood ratio of their two by two table of presence and label.
    n = totals[True] + totals[False]
    cells = ((F.col("t"), totals[True], 1), (F.col("c"), totals[False], 1), (totals[True] - F.col("t"), totals[True], 0), (totals[False] - F.col("c"), totals[False], 0))
    present = F.col("t") + F.col("c")
    ratio = F.lit(0.0)
    for seen, column, has in cells:
        expected = (present if has else n - present) * column / n
        ratio = ratio + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (totals[True] + 1)) - F.log((F.col("c") + 0.5) / (totals[False] + 1))
    ranked = counts.where(present >= LEAST_DOCUMENTS).withColumn("ratio", ratio).withColumn("odds", odds)
    chosen = ranked.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature", "ratio", "odds").collect()
    features = {r["feature"]: i for i, r in enumerate(chosen)}
    #: Features that mark severity: far more usual in labelled texts.
    marked = np.array([r["ratio"] > 15 and r["odds"] > 2 and not r["feature"].endswith("*") for r in chosen] or [False])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                row, number, times = text_features(part.column(1), features)
                bounds = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (number, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["id", "label", "number", "times"])

    rows_ = sample.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(vectors, "id long, label int, number array<int>, times array<int>").orderBy("id").toArrow().combine_chunks()
    sizes = np.asarray(rows_.column("number").combine_chunks().value_lengths()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    number = np.asarray(rows_.column("number").combine_chunks().flatten()).astype(np.int64)
    times = np.asarray(rows_.column("times").combine_chunks().flatten()).astype(np.int64)
    hits = np.bincount(row, weights=times * marked[number], minlength=len(sizes))
    toxic = np.asarray(rows_.column("label")) > 0
    grades = np.where(toxic, sum((hits >= s).astype(np.int64) for s in GRADE_STEPS), 0)
    weights, thresholds = _fit_ordinal(row, number, np.log1p(times), grades, len(features))
    return SeverityModel(features, weights, thresholds)


def score_severity(docs: DataFrame, model: SeverityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the key by default) with ``severity`` (expected grade), ``p_toxic`` (P of any grade above 0) and ``rejected``.

    Whole texts are scored, however long; a null or empty text has no features. Rows that repeat get equal scores and stay. An
    empty table gives an empty table.
    """
    prepare_session(docs.sparkSession)
    keep = keep or ["doc_id"]
    schema = StructType([docs.schema[c] for c in keep])
    renamed = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    out = StructType(schema.fields.copy()).add("severity", "double").add("p_toxic", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                row, number, times = text_features(part.column(0), model.features)
                score = np.bincount(row, weights=model.weights[number] * np.log1p(times), minlength=len(part))
                above = model.exceeding(score)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(above.sum(axis=1)), pa.array(above[:, 0])], names=out.names)

    found = docs.select(F.col(text).alias("__text"), *renamed).mapInArrow(scored, out)
    return found.withColumn("rejected", F.col("p_toxic") >= REJECT)


def without_toxic(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; rows that repeat stay or go together. An empty table stays empty."""
    # All columns travel in one struct, so that no name of theirs can clash.
    rows = docs.select(F.col(text).alias("__text"), F.struct("*").alias("__row"))
    return score_severity(rows, model, "__text", ["__row"]).where(~F.col("rejected")).select("__row.*")
