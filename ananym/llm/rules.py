"""Text quality by a sparse ensemble of rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ananym.llm.common import byte_slices, prepare_session, split_words, text_buffer, written
from ananym.llm.toxicity import training_sample

#: Most labelled rows that are fitted on, by hash order of the key.
TRAIN_ROWS = 20_000
TREES = 60
DEPTH = 3
BINS = 32
LEAF_ROWS = 20
SHRINK = 0.3
LASSO = 2e-3
LASSO_STEPS = 400
SEED = 7

STATISTICS = (
    "words", "bytes_per_word", "longest_word", "distinct_words", "top_word", "short_words", "upper", "digits", "punctuation", "exclamations", "bars", "symbols",
    "beyond_ascii", "white", "lines", "repeated_lines", "words_per_line", "repeated_pairs", "capitalised", "word_entropy",
)


def _shares(raw: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in a set of byte values."""
    counts = np.concatenate(([0], np.cumsum(chosen[raw])))
    return counts[starts[1:]] - counts[starts[:-1]]


def _byte_set(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in characters]] = 1
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of each whole text; all are 0 for a null or empty text."""
    raw, starts = text_buffer(texts)
    n = len(starts) - 1
    size = np.maximum(np.diff(starts), 1)
    codes, words, bounds = split_words(texts)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    row = np.repeat(np.arange(n), count)
    length = np.fromiter(map(len, words), np.int64, len(words))[codes] if len(words) else np.zeros(0, np.int64)
    capital = np.fromiter((65 <= w[0] <= 90 for w in words), bool, len(words))[codes] if len(words) else np.zeros(0, bool)
    per = lambda values: np.bincount(row, weights=values, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    width = max(1, len(words))
    pair, times = np.unique(row * width + codes, return_counts=True)
    owner = pair // width
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    entropy = np.log(some) - np.bincount(owner, weights=times * np.log(times), minlength=n) / some
    inner = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    # Adjacent words within 64 bits: a text, and two words of this batch.
    twice = (row[:-1][inner] * np.int64(width) + codes[:-1][inner]).astype(np.uint64) * np.uint64(width) + codes[1:][inner].astype(np.uint64)
    unique_pairs, first = np.unique(twice, return_index=True)
    repeated_pairs = np.bincount(row[:-1][inner], minlength=n) - np.bincount(row[:-1][inner][first], minlength=n)
    lines, repeated = np.zeros(n), np.zeros(n)
    data = raw.tobytes()
    for i in range(n):
        own = [x for x in data[starts[i] : starts[i + 1]].split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
    letters = np.zeros(256, np.int64)
    letters[65:91] = letters[97:123] = 1
    upper = np.zeros(256, np.int64)
    upper[65:91] = 1
    beyond = np.zeros(256, np.int64)
    beyond[128:] = 1
    share = lambda s: _shares(raw, starts, s) / size
    columns = (
        count, per(length) / some, longest, distinct / some, top / some, per(length <= 3) / some, _shares(raw, starts, upper) / np.maximum(_shares(raw, starts, letters), 1),
        share(_byte_set("0123456789")), share(_byte_set(".,;:'\"()-?")), share(_byte_set("!")), share(_byte_set("|")), share(_byte_set("#$%&*+/<=>@[]^_`{}~\\")),
        share(beyond), share(_byte_set(" \t\n\r\v\f")), lines, repeated / np.maximum(lines, 1), count / np.maximum(lines, 1), repeated_pairs / some, per(capital) / some, entropy,
    )
    return np.column_stack(columns).astype(np.float64)


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and one column per statistic, named ``__<statistic>``."""
    prepare_session(docs.sparkSession)
    schema = StructType([docs.schema[c] for c in keep])
    for name in STATISTICS:
        schema = schema.add(f"__{name}", "double")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                values = statistics(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(v) for v in values.T]], names=schema.names)

    return docs.select(F.col(text).alias("__text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]).mapInArrow(measured, schema)


# --- learning -------------------------------------------------------------------------------------

#: A rule: conditions (statistic, above?, limit) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    """Weights of rules in a logistic model."""

    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for statistic, above, limit in rule:
                value = F.col(f"__{STATISTICS[statistic]}")
                holds = holds & ((value > limit) if above else (value <= limit))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, curve: np.ndarray, rows: np.ndarray, columns: np.ndarray, path: Rule, rules: list[Rule]) -> None:
    """Grow a regression tree on the gradient; the path to every node becomes a rule."""
    best = None
    if len(path) < DEPTH and len(rows) >= 2 * LEAF_ROWS:
        total, weight = residual[rows].sum(), curve[rows].sum()
        for c in columns:
            bins = binned[rows, c]
            g = np.cumsum(np.bincount(bins, weights=residual[rows], minlength=BINS))[:-1]
            h = np.cumsum(np.bincount(bins, weights=curve[rows], minlength=BINS))[:-1]
            m = np.cumsum(np.bincount(bins, minlength=BINS))[:-1]
            ok = (m >= LEAF_ROWS) & (len(rows) - m >= LEAF_ROWS)
            if not ok.any():
                continue
            gain = np.where(ok, g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1), -np.inf)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                best = gain[i], c, i
        if best is not None and best[0] <= total**2 / (weight + 1) + 1e-6:
            best = None
    if best is None:
        return
    _, c, i = best
    low = binned[rows, c] <= i
    for above, part in ((False, rows[low]), (True, rows[~low])):
        further = (*path, (int(c), above, float(edges[c][i])))
        rules.append(further)
        _tree(binned, edges, residual, curve, part, columns, further, rules)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules from the paths of boosted trees, each grown on half of the rows and of the statistics."""
    random = np.random.default_rng(SEED)
    edges = []
    for c in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(np.concatenate((cuts, np.full(BINS - 1 - len(cuts), np.inf))))
    binned = np.column_stack([np.searchsorted(edges[c][np.isfinite(edges[c])], x[:, c], side="left") for c in range(x.shape[1])])
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(random.choice(len(y), max(1, len(y) // 2), replace=False))
        columns = np.sort(random.choice(x.shape[1], x.shape[1] // 2, replace=False))
        own: list[Rule] = []
        _tree(binned, edges, y - p, p * (1 - p), rows, columns, (), own)
        # Leaves move all rows, not only those the tree was grown on.
        grown = np.zeros(len(y), bool)
        grown[rows] = True
        inner = {o[:-1] for o in own}
        for rule in own:
            if rule not in inner:
                inside = holds(rule, x)
                fitted = inside & grown
                score[inside] += SHRINK * (y - p)[fitted].sum() / ((p * (1 - p))[fitted].sum() + 1)
        rules += [r for r in own if all(np.isfinite(limit) for _, _, limit in r)]
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, limit in rule:
        out &= (x[:, c] > limit) if above else (x[:, c] <= limit)
    return out


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty on the weights, by accelerated proximal gradient steps."""
    n, m = z.shape
    spread = np.maximum(z.std(axis=0), 0.05)
    z = (z / spread).astype(np.float32)
    vector = np.ones(m, np.float32)
    for _ in range(20):  # the greatest curvature, by power iteration
        vector = z.T @ (z @ vector)
        norm = np.linalg.norm(vector)
        vector /= max(norm, 1e-12)
    rate = 1 / (0.25 * norm / n + 0.25 + 1e-9)
    weight, bias = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    ahead, ahead_bias, momentum = weight.copy(), bias, 1.0
    for _ in range(LASSO_STEPS):
        error = 1 / (1 + np.exp(-(z @ ahead.astype(np.float32) + ahead_bias))) - y
        moved = ahead - rate * (z.T @ error.astype(np.float32)) / n
        moved = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        moved_bias = ahead_bias - rate * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = moved + (momentum - 1) / after * (moved - weight), moved_bias + (momentum - 1) / after * (moved_bias - bias)
        weight, bias, momentum = moved, moved_bias, after
    return weight / spread, bias


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """Learn rules from at most ``rows`` labelled texts. Without labels of both kinds, or without documents, the score is constant.

    Null labels, labels with a null key and labels without a document are left out; a key with several labels takes the largest. Documents with
    one key all count with its label; null texts count as empty ones, long ones are measured whole.
    """
    prepare_session(docs.sparkSession)
    sample = training_sample(docs, labels, label, rows, text, key)
    measured = written(with_statistics(sample.withColumn("label", F.col("label").cast("int")), "text", ["id", "label"]), "quality-sample")
    table = measured.orderBy("id", *[f"__{s}" for s in STATISTICS]).toArrow()
    y = (np.asarray(table.column("label")) > 0).astype(np.float64)
    if len(np.unique(y)) < 2:
        share = y.mean() if len(y) else 0.5
        return RuleModel([], np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    x = np.column_stack([np.asarray(table.column(f"__{s}")) for s in STATISTICS])
    rules = grow_rules(x, y)
    weights, bias = fit_lasso(np.column_stack([holds(r, x) for r in rules]).astype(np.float32), y) if rules else (np.zeros(0), 0.0)
    used = np.flatnonzero(np.abs(weights) > 1e-3)
    return RuleModel([rules[i] for i in used], weights[used], bias)


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with ``score``: how likely a text is of quality, by its statistics alone.

    Whole texts are measured, however long. Null and empty texts get the score of an empty text, equal texts equal scores; rows that repeat
    stay. An empty table gives an empty table.
    """
    keep = keep or ["doc_id"]
    measured = with_statistics(docs, text, keep)
    return measured.select(*keep, model.column().alias("score"))
