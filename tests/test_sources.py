import pytest
from pyspark.sql import functions as F

from ananym.operators.reports import loss_history, observed
from ananym.operators.rows import map_batches
from ananym.plans import prepare_corpus
from ananym.session import checkpoint_root, scratch_path, spread, stored
from ananym.sources.corpus import from_rows, keep_copy, read_corpus, read_split_files, read_splits, store_with_keys, write_splits
from ananym.sources.logs import read_log
from ananym.streaming.files import counting_rows, prepare_stream, progress, stream_corpus, write_available


@pytest.fixture
def docs(spark):
    return from_rows(spark, [(i, f"text {i}") for i in range(100)])


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv"])
def test_formats(spark, docs, tmp_path, fmt):
    docs.write.format(fmt).save(str(tmp_path / "d"))
    assert sorted(read_corpus(spark, str(tmp_path / "d"), fmt).collect()) == sorted(docs.collect())


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\ntwo")
    (tmp_path / "b.txt").write_text("three")
    lines = read_corpus(spark, str(tmp_path), "text").collect()
    assert sorted(r["text"] for r in lines) == ["", "one", "three", "two", "two"]
    assert len({r["doc_id"] for r in lines}) == 5
    whole = read_corpus(spark, str(tmp_path), "text", wholetext=True)
    assert sorted(r["text"] for r in whole.collect()) == ["one\ntwo\n\ntwo", "three"]


def test_only_needed_columns_are_scanned(spark, tmp_path):
    spark.range(9).selectExpr("id as doc_id", "'x' as text", "'y' as other").write.parquet(str(tmp_path / "d"))
    plan = prepare_corpus(read_corpus(spark, str(tmp_path / "d")), exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_splits_round_trip_and_prune(spark, docs, tmp_path):
    path = str(tmp_path / "s")
    prepared = prepare_corpus(docs)
    write_splits(prepared, path, max_records_per_file=30)
    assert sorted(read_splits(spark, path).select("doc_id", "split").collect()) == sorted(
        prepared.select("doc_id", "split").collect()
    )
    valid = read_splits(spark, path, "valid")
    assert valid.count() == 10 and "PartitionFilters: [isnotnull(split" in valid._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="(?i)already exists"):
        write_splits(prepared, path)
    loose = read_split_files(spark, {s: f"{path}/split={s}" for s in ("train", "valid")})
    assert {r["split"]: r["count"] for r in loose.groupBy("split").count().collect()} == {"train": 90, "valid": 10}


def test_copy_is_kept(spark, docs, tmp_path):
    path = str(tmp_path / "copy")
    assert keep_copy(docs, path).count() == 100
    assert keep_copy(docs, path).count() == 100


def test_shared_folder_comes_from_the_session(spark, docs):
    root = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert checkpoint_root(spark) == root
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert sorted(stored(docs, "t").collect()) == sorted(docs.collect())


def test_spread_only_inputs_of_few_partitions(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    df = read_corpus(spark, str(tmp_path / "d"))
    assert "Exchange" in spread(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    many = docs.repartition(6)
    assert spread(many, "doc_id") is many


LOG = """start
{'loss': 10.9, 'grad_norm': 1.0}
{'eval_loss': 3.2, 'step': 1}
{'loss': 1e-05, 'grad_norm': 1.0} {'loss': 7.25, 'x': 1}{'loss': 6, 'x': 1}
{'loss': 5.5}
"""


def test_loss_history(spark, tmp_path):
    (tmp_path / "run_5.log").write_text(LOG)
    (tmp_path / "run_6.log").write_text("{'loss': 1.5, }\n" * 3)
    lines = read_log(spark, str(tmp_path))
    assert sorted(map(tuple, loss_history(lines).collect())) == [
        ("run_5.log", 0, 10.9),
        ("run_5.log", 1, 7.25),
        ("run_5.log", 2, 6.0),
        ("run_6.log", 0, 1.5),
        ("run_6.log", 1, 1.5),
        ("run_6.log", 2, 1.5),
    ]
    more = loss_history(lines.where("run = 'run_5.log'"), extended=True).orderBy("step").collect()
    assert [r["loss"] for r in more] == [10.9, 1e-05, 7.25, 6.0]


def test_steps_run_on_over_blocks_and_files(spark, tmp_path):
    """Files far larger than a split, so that one run comes in many blocks."""
    folder = tmp_path / "run=a"
    folder.mkdir()
    want = []
    for part in range(2):
        values = [f"{part}.{i:05d}" for i in range(1, 20_001)]
        (folder / f"part-{part}.txt").write_text("".join(f"{{'loss': {v}, 'x': 0}}\n" for v in values))
        want += [float(v) for v in values]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = read_log(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 10
        assert [(r["run"], r["step"], r["loss"]) for r in loss_history(lines).orderBy("step").collect()] == [
            ("a", i, v) for i, v in enumerate(want)
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_counts_are_observed_during_another_action(docs, tmp_path):
    watched, watch = observed(docs, "docs")
    watched.write.parquet(str(tmp_path / "o"))
    assert watch.get == {"n_rows": 100, "n_chars": 690}


def test_batched_python_map_changes_the_number_of_rows(docs):
    def twice_odd(batch):
        assert len(batch) <= 7
        odd = batch[batch["doc_id"] % 2 == 1]
        return odd.loc[odd.index.repeat(2), ["doc_id"]]

    got = map_batches(docs, twice_odd, "doc_id long", batch_size=7)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(2 * list(range(1, 100, 2)))


def test_stream_continues_and_equals_batch(spark, docs, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    docs.where("doc_id < 60").write.parquet(source)

    def run():
        return write_available(prepare_stream(stream_corpus(spark, source, "*.parquet"), 0.2), out, checkpoint, ["split"])

    counter = counting_rows(spark)
    assert progress(run(), counter) == 60
    docs.where("doc_id >= 60").write.mode("append").parquet(source)
    assert progress(run(), counter) == 40
    spark.streams.removeListener(counter)
    want = prepare_corpus(docs, test_size=0.2, exact=False).select("doc_id", "text", "split")
    assert sorted(read_splits(spark, out).select("doc_id", "text", "split").collect()) == sorted(want.collect())
    assert docs.count() == spark.read.parquet(out).select(F.countDistinct("doc_id")).first()[0]


def test_text_keys_do_not_depend_on_the_reading(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {i}\n" for i in range(200)))
    (tmp_path / "d.txt").write_text("")
    want = {f"{name} line {i}": i + 200 * nth for nth, name in enumerate("abc") for i in range(200)}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("134217728b", "4194304b"), ("500b", "0b"), ("10000b", "100b")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            assert {r["text"]: r["doc_id"] for r in read_corpus(spark, str(tmp_path), "text").collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_copy_is_kept_while_it_is_one(spark, tmp_path):
    """Reused for the same rows; written again after a broken run, for another subset, and when the source has changed."""
    source, path = str(tmp_path / "source"), tmp_path / "copy"
    spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "id % 3 AS part").write.parquet(source)

    def names():
        return {f.name for f in path.glob("part-*")}

    whole = read_corpus(spark, source)
    assert keep_copy(whole, str(path)).count() == 1000
    first = names()
    assert keep_copy(read_corpus(spark, source), str(path)).count() == 1000
    assert names() == first
    for file in (path / "_manifest").glob("part-*"):
        file.unlink()
    assert keep_copy(whole, str(path)).count() == 1000
    assert not names() & first
    assert keep_copy(whole.where("doc_id < 30"), str(path)).count() == 30
    assert keep_copy(whole.where("doc_id < 40"), str(path)).count() == 40
    assert keep_copy(whole.select("text"), str(path)).columns == ["text"]
    assert keep_copy(whole, str(path)).count() == 1000
    spark.range(5).selectExpr("id + 5000 AS doc_id", "'y' AS text", "id AS part").write.mode("append").parquet(source)
    assert keep_copy(read_corpus(spark, source), str(path)).count() == 1005


def test_keys_for_a_corpus_without(spark, tmp_path):
    bare = spark.range(500).selectExpr("cast(null AS bigint) AS doc_id", "concat('t', id) AS text").repartition(5)
    keyed = store_with_keys(bare, str(tmp_path / "keyed"))
    assert keyed.select("doc_id").distinct().count() == 500
    assert sorted(map(tuple, keyed.select("doc_id", "text").collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "keyed")).select("doc_id", "text").collect()))


def test_progress_counts_more_batches_than_spark_remembers(spark, tmp_path):
    spark.range(60).selectExpr("id AS doc_id", "'x' AS text").repartition(12).write.parquet(str(tmp_path / "in"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    counter = counting_rows(spark)
    try:
        query = write_available(stream_corpus(spark, str(tmp_path / "in"), "*.parquet", max_files_per_trigger=1), str(tmp_path / "out"))
        assert progress(query, counter) == 60
    finally:
        spark.streams.removeListener(counter)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


@pytest.mark.parametrize("files", [None, 1, 3])
def test_stream_of_a_table_in_one_or_several_files(spark, tmp_path, files):
    import __spark_entry__ as entry

    docs = from_rows(spark, [(i, f"text {i}") for i in range(50)])
    if files:
        docs.repartition(files, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    else:
        docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    got = entry.stream_prepare(spark, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(i, f"text {i}"[::-1]) for i in range(50)]


def test_text_lines_are_written_in_as_many_files_as_are_read(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    from_rows(spark, [(i, f"same\nline {i % 3}") for i in range(90)]).repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(entry, "scratch_path", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        got = {r["text"]: (r["n"], r["n_keys"]) for r in entry.read_text_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {"same": (90, 90), "line 0": (30, 30), "line 1": (30, 30), "line 2": (30, 30)}
    assert len(list((tmp_path / "text").glob("part-*"))) == 9


def test_lines_are_not_shuffled_by_their_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_corpus(spark, str(tmp_path), "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
