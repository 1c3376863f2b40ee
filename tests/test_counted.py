"""Tables that know how large their keys are: counts against plain counting, widths without jobs, and when the counts must not be used."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import rebuild, series
from spoor.operators.ingest import read_events
from spoor.plans.census import Counts, known_width, merged, scanned_folder
from spoor.plans.timeline import ROWS_SETTING, measure_slot
from spoor.sources.counted import read_counted, write_counted

from conftest import tuples


def events(spark, seed=1, n=900, sources=("hot", "a", "b")):
    rng = random.Random(seed)
    kinds = ["PollStart", "PollEnd", "WorkerPark", "WorkerUnpark", "TaskSpawn", "TaskTerminate"]
    rows = [(sources[0] if rng.random() < 0.6 else rng.choice(sources), i, rng.randrange(1_000_000), rng.choice(kinds), 1, rng.randrange(3), rng.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows, "source_key string, seq bigint, ts_ns bigint, kind string, tid bigint, worker_id bigint, task_id bigint")


def jobs(spark, group, build):
    """What ``build`` returns, and how many jobs it started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def small_slots(spark):
    spark.conf.set(ROWS_SETTING, "60")
    yield 60
    spark.conf.unset(ROWS_SETTING)


def test_counts_match_plain_counting(spark, tmp_path):
    df = events(spark)
    write_counted(df, f"{tmp_path}/t", floor=5)
    field = read_counted(spark, f"{tmp_path}/t").schema["ts_ns"].metadata["spoor.census"]
    import json
    counts = json.loads(field)["counts"][0]
    rows = [(r.source_key, r.ts_ns) for r in df.collect()]
    most = lambda keys: max(map(keys.count, set(keys)))
    assert counts["hottest"] == most([k for k, _ in rows])
    assert len(counts["fullest"]) > 16
    for width, n in counts["fullest"].items():
        assert n == most([(k, t // int(width)) for k, t in rows])


def test_widths_fit_and_need_no_job(spark, tmp_path, small_slots):
    df = events(spark)
    write_counted(df, f"{tmp_path}/t", floor=5)
    table = read_events(spark, f"{tmp_path}/t")
    width, started = jobs(spark, "width", lambda: measure_slot(table, ["source_key"], "ts_ns"))
    assert started == 0 and width is not None
    cells = df.groupBy("source_key", F.expr(f"ts_ns div {width}")).count().agg(F.max("count")).first()[0]
    assert cells <= small_slots < df.groupBy("source_key", F.expr(f"ts_ns div {2 * width}")).count().agg(F.max("count")).first()[0]
    part = table.filter("kind = 'Wake'").select("source_key", F.col("worker_id").alias("w"), F.col("ts_ns").alias("t"))
    assert known_width(part, ["source_key", "w"], "t", small_slots) == (width,)
    for name, build in {"polls": rebuild.polls, "parks": rebuild.parks, "bindings": rebuild.tid_bindings, "ready": rebuild.readiness, "alive": series.active_task_timeline}.items():
        plan, started = jobs(spark, name, lambda build=build: build(table))
        assert started == 0, name
        assert tuples(plan, *plan.columns) == tuples(build(df_columns(spark, df), slot=None), *plan.columns), name


def df_columns(spark, df):
    from spoor.schema import conform
    return conform(df, "events")


def test_counts_are_used_only_for_parts_of_the_table(spark, tmp_path):
    write_counted(events(spark), f"{tmp_path}/t", floor=5)
    write_counted(events(spark, 2), f"{tmp_path}/other", floor=5)
    t, other, keys = read_counted(spark, f"{tmp_path}/t"), read_counted(spark, f"{tmp_path}/other"), ["source_key"]
    known = lambda df, keys=keys, axis="ts_ns": known_width(df, keys, axis, 60)
    assert known(t) and known(t.filter("seq > 5").distinct().repartition(3)) and known(t.groupBy("source_key", "ts_ns").agg(F.max("seq")))
    assert known(t.unionByName(t)) is None
    assert known(t.join(other.select("source_key").distinct(), "source_key")) is None
    assert known(t.withColumn("more", F.explode(F.array(F.lit(1), F.lit(2))))) is None
    assert known(t.sample(True, 3.0)) is None
    assert known(t.withColumn("source_key", F.lit("all"))) is None
    assert known(t.withColumn("ts_ns", F.col("ts_ns") % 10)) is None
    assert known(t, ["worker_id"]) is None and known(t, []) is None
    assert known(t, axis="seq") is None
    # files written from the table keep its marks but are another table
    t.unionByName(t).write.parquet(f"{tmp_path}/copy")
    copy = spark.read.parquet(f"{tmp_path}/copy")
    assert scanned_folder(copy) and known(copy) is None
    t.unionByName(t).write.mode("append").parquet(f"{tmp_path}/t/batch=7")  # not counted
    assert known(read_counted(spark, f"{tmp_path}/t")) is None


def test_batches(spark, tmp_path):
    """Batches add up for keys that several may have, and keep the largest for source files; a batch written again replaces its counts."""
    first, second = events(spark, 3, sources=("a", "b")), events(spark, 4, 300, ("c", "d"))
    both = (("source_key",), ("worker_id",))
    for batch, df in enumerate((first, second)):
        write_counted(df, f"{tmp_path}/t", batch, both, floor=5)
    table, rows = read_counted(spark, f"{tmp_path}/t"), first.unionByName(second)
    assert table.count() == 1200 and "batch" not in table.columns
    for keys in (["source_key"], ["worker_id"]):
        width = known_width(table, keys, "ts_ns", 60)[0]
        assert rows.groupBy(*keys, F.expr(f"ts_ns div {width}")).count().agg(F.max("count")).first()[0] <= 60
    write_counted(first.limit(3), f"{tmp_path}/t", 0, both, floor=5)
    again = read_counted(spark, f"{tmp_path}/t")
    assert again.count() == 303 and known_width(again, ["source_key"], "ts_ns", 250) == (None,)
    write_counted(first.limit(0), f"{tmp_path}/empty", 0, both)
    assert known_width(read_counted(spark, f"{tmp_path}/empty"), ["source_key"], "ts_ns", 1) == (None,)


def test_bounds():
    a, b = Counts(100, {8: 20, 16: 40}), Counts(10, {})
    assert (a.at(4), a.at(16), a.at(32), b.at(1)) == (20, 40, 100, 10)
    assert merged([a, b], False) == Counts(110, {8: 30, 16: 50}) and merged([a, b], True) == Counts(100, {8: 20, 16: 40})
    assert (a.width(100), a.width(50), a.width(30), a.width(5)) == (None, 16, 8, 8)
