"""Sinks and streams: idempotent folding, schema guard, answers over several files equal to the batch answer."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spoor.operators import rebuild
from spoor.operators.ingest import read_events
from spoor.sources import tables as tb
from spoor.streaming import jobs
from spoor.catalog.views import Tables
from spoor.schema import conform

from conftest import tuples

SF = "/root/testdata/sf0.001"


def poll_rows(spark, source, n):
    return spark.range(n).select(
        F.lit(source).alias("source_key"), F.col("id").alias("start_ns"), (F.col("id") + 5).alias("end_ns"), F.lit(5).cast("bigint").alias("duration_ns"),
        F.lit("svc").alias("service"), F.lit("2024-01-01").alias("date"), F.lit("h").alias("host"))


def test_fold_is_idempotent_and_marks_empty_files(spark, tmp_path):
    out = str(tmp_path)
    keys = spark.createDataFrame([("a",), ("empty",)], "source_key string")
    for _ in range(2):
        tb.fold_write(spark, out, keys, {"polls": poll_rows(spark, "a", 3)})
    assert tb.read_table(spark, out, "polls").count() == 3
    assert tuples(tb.folded_set(spark, out), "source_key") == [("a",), ("empty",)]
    tb.fold_write(spark, out, spark.createDataFrame([("b",)], "source_key string"), {"polls": poll_rows(spark, "b", 2)})
    assert tb.read_table(spark, out, "polls").groupBy("source_key").count().count() == 2
    # The same file written again replaces its own rows only.
    tb.write_polls(poll_rows(spark, "b", 2).withColumn("leaf", tb.leaf(F.col("source_key"))), out)
    assert tb.read_table(spark, out, "polls").count() == 5


def test_read_events(spark, tmp_path):
    """Files of several ages: absent columns read as null, other integers are cast, other columns stay."""
    spark.sql("select 'a' source_key, 1 seq, 10L ts_ns, 'Wake' kind, 5L tid, 'x' note").write.parquet(f"{tmp_path}/old")
    row = read_events(spark, f"{tmp_path}/old").first()
    assert (row.source_key, row.seq, row.ts_ns, row.kind, row.tid, row.note, row.worker_id, row.fields) == ("a", 1, 10, "Wake", 5, "x", None, None)
    assert dict(read_events(spark, f"{tmp_path}/old").dtypes)["seq"] == "bigint"
    spark.sql("select 'a' source_key, 1L seq, 10L ts_ns, 'Wake' kind, 5000000000L tid").write.parquet(f"{tmp_path}/wide")
    with pytest.raises(Exception, match="(?i)out of range|overflow"):
        read_events(spark, f"{tmp_path}/wide").collect()
    spark.sql("select 'a' source_key, 1L seq, 'Wake' kind").write.parquet(f"{tmp_path}/short")
    with pytest.raises(TypeError, match="ts_ns"):
        read_events(spark, f"{tmp_path}/short")
    spark.sql("select 'a' source_key, 1L seq, 10L ts_ns, 'Wake' kind where false").write.parquet(f"{tmp_path}/empty")
    assert read_events(spark, f"{tmp_path}/empty").count() == 0


def test_unreadable_files_are_found_by_halves(spark, tmp_path):
    spark.range(40).withColumn("at", F.col("id")).repartitionByRange(40, "id").write.parquet(f"{tmp_path}/in")
    files = sorted(str(p) for p in (tmp_path / "in").glob("*.parquet"))
    for file in (files[3], files[30]):
        Path(file).write_bytes(b"no parquet")
    asked = []

    def rows(some):
        asked.append(len(some))
        return spark.read.schema("id long, at long").parquet(*some)

    assert [file for file, _ in jobs.unreadable(files, rows)] == [files[3], files[30]]
    assert len(asked) < 30
    assert jobs.unreadable(files[4:6], rows) == []


def test_conform(spark):
    df = spark.createDataFrame([("s", ["f"])], "stack_id string, frames array<string>")
    assert conform(df, "stacks").columns == ["stack_id", "frames"]
    with pytest.raises(TypeError):
        conform(df.withColumn("frames", F.lit(1)), "stacks")
    old = spark.createDataFrame([(1, 2, 1, 7)], "start_ns int, end_ns long, duration_ns long, worker_id long")
    row = conform(old, "polls").first()
    assert row.worker_id == 7 and row.spawn_loc is None and row.end_ns == 2 and row.start_ns == 1
    with pytest.raises(TypeError):
        conform(old.withColumn("worker_id", F.lit("x")), "polls")
    with pytest.raises(Exception):
        conform(old.withColumn("worker_id", F.lit(1 << 40)), "polls").collect()


def in_files(spark, df, folder, parts):
    """One file per period, in time order, as they would arrive."""
    lo, hi = df.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        df.filter(F.col("ts_ns").between(lo + i * step, lo + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(folder)


def test_streamed_answers_equal_the_batch(spark, tmp_path):
    events = Tables(spark, SF).events()
    folder = str(tmp_path / "in")
    in_files(spark, events, folder, 4)
    stream = lambda: jobs.file_stream(spark, folder, events.schema, 1)
    jobs.stream_polls(spark, stream().withColumn("boot_id", F.col("source_key")), str(tmp_path / "polls"), str(tmp_path / "c1"))
    cols = ("source_key", "worker_id", "task_id", "seq", "start_ns", "end_ns", "explicit_end")
    assert tuples(jobs.streamed_polls(spark, str(tmp_path / "polls")), *cols) == tuples(rebuild.polls(events), *cols)
    assert len({r.batch for r in spark.read.parquet(str(tmp_path / "polls/closed")).select("batch").distinct().collect()}) > 1

    answer = stream().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    jobs.snapshots(answer, str(tmp_path / "snap"), str(tmp_path / "c2"))
    assert tuples(jobs.latest_snapshot(spark, str(tmp_path / "snap")), "kind", "n") == tuples(events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "n")
    totals = [r.n for r in spark.read.parquet(str(tmp_path / "snap")).groupBy("version").agg(F.sum("n").alias("n")).orderBy("version").collect()]
    assert totals == sorted(totals) and len(totals) >= 4


def test_stream_restart_continues(spark, tmp_path):
    events = Tables(spark, SF).events()
    folder = str(tmp_path / "in")
    in_files(spark, events, folder, 2)
    stream = lambda: jobs.file_stream(spark, folder, events.schema, 1).withColumn("ts_us", F.expr("ts_ns div 1000"))
    for _ in range(2):  # the second run finds nothing new
        jobs.windowed_rates(stream(), str(tmp_path / "out"), str(tmp_path / "c"), 3_600_000_000)
    got = jobs.read_rates(spark, str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == events.count()
    late = events.filter("seq % 7 = 0").coalesce(1)  # rows far behind all others
    late.write.mode("append").parquet(folder)
    jobs.windowed_rates(stream(), str(tmp_path / "out"), str(tmp_path / "c"), 3_600_000_000)
    assert jobs.read_rates(spark, str(tmp_path / "out")).agg(F.sum("n")).first()[0] == events.count() + late.count()
    jobs.coverage_sessions(stream(), str(tmp_path / "runs"), str(tmp_path / "c2"), 3_600_000_000)
    one = events.unionByName(late).select("host", F.expr("ts_ns div 1000").alias("start_us"), F.expr("ts_ns div 1000 + 3600000000").alias("end_us"), F.lit(1).cast("long").alias("n"))
    cols = ("host", "start_us", "end_us", "n")
    assert tuples(jobs.read_sessions(spark, str(tmp_path / "runs")), *cols) == tuples(jobs.joined_runs(one), *cols)


def test_failed_files_are_counted_and_stay_pending(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = spark.createDataFrame([], "source_key string, n long").schema
    for name in "abc":
        spark.createDataFrame([(name, 1), (name, 2)], schema).coalesce(1).write.parquet(str(tmp_path / name))
    folder.mkdir()
    for name in "abc":
        part = next((tmp_path / name).glob("part-*.parquet"))
        (folder / f"{name}.parquet").write_bytes(part.read_bytes() if name != "b" else part.read_bytes()[:40])
    seen = []
    fold = lambda rows: seen.append(sorted({r.source_key for r in rows.collect()}))
    jobs.fold_files(spark, str(folder), schema, fold, out)
    assert seen == [["a", "c"]]
    failed = jobs.failed_files(spark, out).collect()
    assert [r.file.rsplit("/", 1)[-1] for r in failed] == ["b.parquet"] and failed[0].message
    (folder / "b.parquet").write_bytes(next((tmp_path / "b").glob("part-*.parquet")).read_bytes())
    jobs.fold_files(spark, str(folder), schema, fold, out)
    assert seen == [["a", "c"], ["b"]] and jobs.failed_files(spark, out).isEmpty()


def test_a_poll_goes_on_in_the_next_file(spark, tmp_path):
    columns = "source_key string, host string, boot_id string, worker_id int, task_id long, spawn_loc string, ts_ns long, seq long, kind string"
    batches = [[("f1", "h", "b1", 0, 1, "l", 10, 1, "PollStart"), ("f1", "h", "b1", 1, 2, "l", 11, 2, "PollStart"), ("f1", "h", "b1", 1, 2, "l", 15, 3, "PollEnd")],
               [("f2", "h", "b1", 1, 3, "l", 20, 1, "PollStart"), ("f2", "h", "b1", 1, 3, "l", 25, 2, "PollEnd")],
               [("f3", "h", "b1", 0, 1, "l", 30, 1, "PollEnd"), ("f3", "h", "b1", 1, 4, "l", 31, 2, "PollStart")],
               [("f4", "h", "b2", 0, 9, "l", 90, 1, "PollStart"), ("f4", "h", "b2", 0, 9, "l", 95, 2, "PollEnd")]]
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(folder))
        jobs.stream_polls(spark, jobs.file_stream(spark, str(folder), spark.createDataFrame([], columns).schema, 1), str(tmp_path / "out"), str(tmp_path / "c"), keep_ns=40)
    got = jobs.streamed_polls(spark, str(tmp_path / "out")).select("source_key", "task_id", "start_ns", "end_ns").collect()
    assert sorted(map(tuple, got)) == [("f1", 1, 10, 30), ("f1", 2, 11, 15), ("f2", 3, 20, 25), ("f4", 9, 90, 95)]
    assert spark.read.parquet(str(tmp_path / "out/open/batch=3")).isEmpty()  # worker 1 has been silent for long
    assert [r.task_id for r in spark.read.parquet(str(tmp_path / "out/lost")).collect()] == [4]


def test_a_stack_of_many_files_counts_once(spark, tmp_path):
    from spoor.operators import stacks

    out = str(tmp_path)
    place = "service string, date string, host string, source_key string"
    sample = lambda k, n: [(i, "s1", 0, "svc", "d", f"h{k}", f"f{k}") for i in range(n)]
    for k in range(3):
        samples = spark.createDataFrame(sample(k, k), f"ts_ns long, stack_id string, source int, {place}")
        dictionary = spark.createDataFrame([("s1", ["leaf", "root"], "svc", "d", f"h{k}", f"f{k}")], f"stack_id string, frames array<string>, {place}")
        tb.fold_write(spark, out, spark.createDataFrame([(f"f{k}",)], "source_key string"), {"samples": samples, "stacks": dictionary})
    assert tb.read_table(spark, out, "stacks").count() == 3 and tb.read_stacks(spark, out).count() == 1
    counts = stacks.stack_counts(tb.read_table(spark, out, "samples"))
    tree = stacks.flamegraph_tree(stacks.resolve_stacks(counts, tb.read_table(spark, out, "stacks")))
    assert tuples(tree, "path", "samples") == [("root", 3), ("root;leaf", 3)]


def test_a_file_named_again_can_be_replaced(spark, tmp_path):
    out, key = str(tmp_path), spark.createDataFrame([("a",)], "source_key string")
    tb.fold_write(spark, out, key, {"polls": poll_rows(spark, "a", 3)})
    tb.fold_write(spark, out, key, {"polls": poll_rows(spark, "a", 5)})
    assert tb.read_table(spark, out, "polls").count() == 3
    tb.fold_write(spark, out, key, {"polls": poll_rows(spark, "a", 5)}, replace=True)
    assert tb.read_table(spark, out, "polls").count() == 5


def many_files(spark, names, rows=4, dates=2):
    table = spark.range(rows).crossJoin(spark.createDataFrame([(n,) for n in names], "source_key string"))
    return table.select("source_key", F.col("id").alias("start_ns"), (F.col("id") + 5).alias("end_ns"), F.lit(5).cast("bigint").alias("duration_ns"), F.lit("svc").alias("service"),
                        F.concat(F.lit("d"), (F.col("id") % dates).cast("string")).alias("date"), F.lit("h").alias("host"))


def keys_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "source_key string")


def counts(spark, out):
    return dict(tb.read_table(spark, out, "polls").groupBy("source_key").count().collect())


def test_files_do_not_grow_with_the_sources(spark, tmp_path):
    found = []
    for n in (3, 300):
        out, names = str(tmp_path / str(n)), [f"s{i}" for i in range(n)]
        tb.fold_write(spark, out, keys_of(spark, names), {"polls": many_files(spark, names)})
        assert counts(spark, out) == dict.fromkeys(names, 4)
        found.append(len(list((tmp_path / str(n) / "polls").rglob("*.parquet"))))
        folders = {p.relative_to(tmp_path / str(n) / "polls").as_posix() for p in (tmp_path / str(n) / "polls").rglob("date=*")}
        assert folders == {"batch=1/service=svc/date=d0", "batch=1/service=svc/date=d1"}
    assert found[1] == found[0]


def test_a_batch_that_dies_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    tb.fold_write(spark, out, keys_of(spark, ["a"]), {"polls": many_files(spark, ["a"])})
    batch = {"polls": many_files(spark, ["b"], 6), "stacks": spark.createDataFrame([("s", ["f"], "svc", "d", "h", "b")], "stack_id string, frames array<string>, service string, date string, host string, source_key string")}

    def killed(df, folder, table, number, write=tb._write_rows):
        write(df, folder, table, number)
        if table == "polls":
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tb, "_write_rows", killed)
        with pytest.raises(KeyboardInterrupt):
            tb.fold_write(spark, out, keys_of(spark, ["b"]), batch)
    assert counts(spark, out) == {"a": 4} and tb.read_table(spark, out, "stacks").isEmpty() and tuples(tb.folded_set(spark, out), "source_key") == [("a",)]
    tb.fold_write(spark, out, keys_of(spark, ["b"]), batch)
    tb.fold_write(spark, out, keys_of(spark, ["b"]), batch)
    assert counts(spark, out) == {"a": 4, "b": 6} and tb.read_table(spark, out, "stacks").count() == 1
    assert tb.vacuum(spark, out) == 2  # polls and stacks of the batch that died
    assert counts(spark, out) == {"a": 4, "b": 6} and tb.read_table(spark, out, "stacks").count() == 1


def test_replacing_a_file_touches_no_other_and_compaction_keeps_the_rows(spark, tmp_path):
    out = str(tmp_path)
    names = ["a", "b", "c"]
    tb.fold_write(spark, out, keys_of(spark, names), {"polls": many_files(spark, names).withColumn("origin", F.lit("x"))})
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    tb.fold_write(spark, out, keys_of(spark, ["b"]), {"polls": many_files(spark, ["b"], 9)}, replace=True)
    tb.fold_write(spark, out, keys_of(spark, ["d"]), {"polls": many_files(spark, ["d"], 2).withColumn("date", F.lit("007")).withColumn("later", F.lit(1))})
    tb.fold_write(spark, out, keys_of(spark, ["b"]), {"polls": many_files(spark, ["b"], 7)}, replace=True)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    want = {"a": 4, "b": 7, "c": 4, "d": 2}
    assert counts(spark, out) == want
    assert len(tb.committed(spark, out)[1]) == 4
    tb.compact(spark, out)
    tb.compact(spark, out)  # nothing left to do
    assert tb.committed(spark, out) == (5, [5]) and counts(spark, out) == want
    assert tuples(tb.folded_set(spark, out), "source_key") == [("a",), ("b",), ("c",), ("d",)]
    assert tb.vacuum(spark, out) > 0 and counts(spark, out) == want
    assert [p.name for p in (tmp_path / "polls").iterdir() if p.is_dir()] == ["batch=5"]
    assert tb.read_table(spark, out, "polls", "origin string").filter("origin = 'x'").count() == 8 and tb.read_table(spark, out, "polls", "later int").filter("later = 1 AND date = '007'").count() == 2  # columns beyond the schema outlive compaction
    tb.fold_write(spark, out, keys_of(spark, ["a"]), {"polls": many_files(spark, ["a"], 1)}, replace=True)
    tb.fold_write(spark, out, keys_of(spark, ["c"]), {"polls": many_files(spark, ["c"], 1)})  # known already
    assert counts(spark, out) == {**want, "a": 1}


def test_an_empty_store(spark, tmp_path):
    out = str(tmp_path / "none")
    assert tb.read_table(spark, out, "spans").count() == 0 and tb.folded_set(spark, out).count() == 0 and tb.vacuum(spark, out) == 0
    tb.compact(spark, out)
    tb.fold_write(spark, out, keys_of(spark, []), {"polls": many_files(spark, [])})
    assert tb.committed(spark, out) == (0, [])


def test_a_fold_finds_its_rows_without_a_shuffle_of_the_table(spark, tmp_path, monkeypatch):
    """Few sources out of a large table: their size is known, so they are broadcast."""
    seen = []
    monkeypatch.setattr(tb, "_commit", lambda spark, out, batch, tables, *rest: seen.append(tables["polls"]._jdf.queryExecution().sparkPlan().toString()))
    wide = spark.range(3_000_000).select(F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("source_key"), F.lit("x" * 50).alias("note"))
    tb.fold_write(spark, str(tmp_path), wide, {"polls": wide})
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def test_only_the_tables_asked_for_are_made(spark, monkeypatch):
    from spoor.operators import ingest

    t = Tables(spark, SF)
    monkeypatch.setattr(ingest, "ingest_spans", lambda *a: pytest.fail("spans were not asked for"))
    from spoor.catalog.ingest import sources
    assert list(ingest.ingest(t.events(), t.span_events(), t.cpu(), sources(t), tables=["polls"])) == ["polls"]
