"""Saved vocabularies: as Parquet tables, and as the JSON file of the public tokenizer library."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ananym.config import BOS, EOS, PAD, UNK, WORD_MARK
from ananym.operators.vocabulary import MAX_VOCAB, MERGES_SCHEMA, VOCAB_SCHEMA, Vocabulary


def save_vocabulary(vocabulary: Vocabulary, path: str, mode: str = "errorifexists") -> None:
    """Store both tables under one folder."""
    vocabulary.save(path, mode)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.load(spark, path)


# How the file names the steps that this library's text functions follow.
_SPACES = {"type": "Metaspace", "replacement": WORD_MARK, "prepend_scheme": "always", "split": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": UNK, "continuing_subword_prefix": None, "end_of_word_suffix": None}
_MODEL |= {"fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_MATCHING = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def _bounded(table: DataFrame, what: str):
    rows = table.limit(MAX_VOCAB + 1).toArrow().to_pylist()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary must not exceed {MAX_VOCAB} {what}")
    return rows


def tokenizer_json(vocabulary: Vocabulary) -> str:
    """The vocabulary as one line in the public library's format; special tokens are matched in text there."""
    rows = sorted(_bounded(vocabulary.vocab, "tokens"), key=lambda r: r["id"])
    merges = sorted(_bounded(vocabulary.merges, "merges"), key=lambda r: r["rank"])
    base = {r["token"]: r["id"] for r in rows if r["token"] not in (BOS, EOS, PAD) or not r["is_special"]}
    added = [{"id": r["id"], "content": r["token"], **_MATCHING, "special": True} for r in rows if r["is_special"]]
    file = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": {"type": "NFKC"}}
    file |= {"pre_tokenizer": _SPACES, "post_processor": None, "decoder": _SPACES}
    return json.dumps(file | {"model": {**_MODEL, "vocab": base, "merges": [[m["left"], m["right"]] for m in merges]}}, ensure_ascii=False)


def write_tokenizer_file(vocabulary: Vocabulary, path: str, mode: str = "errorifexists") -> None:
    """Write that line as the only file in a folder, wherever Spark can write."""
    spark = vocabulary.vocab.sparkSession
    spark.createDataFrame([(tokenizer_json(vocabulary),)], "value string").coalesce(1).write.mode(mode).text(path)


def _without_nulls(step: dict | None) -> dict:
    return {k: v for k, v in (step or {}).items() if v is not None}


def vocabulary_from_json(spark: SparkSession, text: str) -> Vocabulary:
    """A vocabulary from the text of such a file.

    Only what encodes as this library does is taken: byte-pair merges after NFKC and a split at spaces, one unknown token per
    character, no subword affixes. Anything else is an error, as ids would silently differ.
    """
    file = json.loads(text)
    model = file["model"]
    wanted = {k: v for k, v in _MODEL.items() if v is not None}
    odd = {k: v for k, v in _without_nulls(model).items() if k not in ("vocab", "merges", "dropout") and wanted.get(k, "") != v}
    affixes = {"continuing_subword_prefix", "end_of_word_suffix"}
    odd = {k: v for k, v in odd.items() if not (k in affixes and v == "")}
    if model.get("dropout"):
        odd["dropout"] = model["dropout"]
    spaces = _without_nulls(file.get("pre_tokenizer"))
    same = spaces.get("type") == "Metaspace" and spaces.get("replacement") == WORD_MARK
    same &= spaces.get("prepend_scheme", "always" if spaces.get("add_prefix_space", True) else "never") == "always" and spaces.get("split", True)
    if odd or not same or (file.get("normalizer") or {}).get("type") != "NFKC" or UNK not in model["vocab"]:
        raise ValueError(f"this tokenizer does not encode as this library does: {odd or spaces or file.get('normalizer')}")
    added = {t["content"]: t["id"] for t in file.get("added_tokens", []) if t.get("special")}
    ids = {**model["vocab"], **added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = [(i, token, token == UNK or token in added) for token, i in sorted(ids.items(), key=lambda x: x[1])]
    return Vocabulary(
        spark.createDataFrame(vocab, VOCAB_SCHEMA),
        spark.createDataFrame([(rank, *pair) for rank, pair in enumerate(merges)], MERGES_SCHEMA),
    )


def read_tokenizer_file(spark: SparkSession, path: str) -> Vocabulary:
    """Read such a file, or the folder with one that :func:`write_tokenizer_file` wrote."""
    files = spark.read.text(path, wholetext=True).select(F.col("value")).limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"{path} must be one file")
    return vocabulary_from_json(spark, files[0]["value"])
