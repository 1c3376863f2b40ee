"""Poll statistics per spawn location, worker and host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.plans.ranks import order_statistics
from spoor.plans.timeline import AUTO
from spoor.session import cut_lineage

NOTABLE_NS = 100_000
OFF_CPU_NS = 10_000_000
HIGH_DELAY_NS = 1_000_000
UNKNOWN_LOC = "(unknown)"


def poll_class(cpu: Column, sched: Column, duration: Column) -> Column:
    return (
        F.when((cpu > 0) & (sched > 0), "mixed").when(cpu > 0, "on_cpu")
        .when(duration >= OFF_CPU_NS, "off_cpu").otherwise("unknown"))


def classified(polls: DataFrame) -> DataFrame:
    return polls.withColumn("spawn_loc", F.coalesce("spawn_loc", F.lit(UNKNOWN_LOC))).withColumn(
        "class", poll_class(F.col("cpu_sample_count"), F.col("sched_sample_count"), F.col("duration_ns")))


def spawn_loc_stats(polls: DataFrame) -> DataFrame:
    """Per location: all polls, notable polls (at least 100 us) and their classes."""
    notable = F.col("duration_ns") >= NOTABLE_NS
    return classified(polls).groupBy("spawn_loc").agg(
        F.count(F.lit(1)).alias("total_polls"), F.count_if(notable).alias("notable_polls"),
        *[F.count_if(notable & (F.col("class") == c)).alias(c) for c in ("off_cpu", "on_cpu", "mixed", "unknown")])


def spawn_loc_durations(polls: DataFrame) -> DataFrame:
    """The notable durations of each location as a counted multiset; no location's list is gathered."""
    return (
        classified(polls).filter(F.col("duration_ns") >= NOTABLE_NS)
        .groupBy("spawn_loc", "duration_ns", "class").agg(F.count(F.lit(1)).alias("n")))


def worst_exemplars(polls: DataFrame) -> DataFrame:
    """Longest poll per (location, class); ties go to the earliest start, then source and host."""
    rows = classified(polls).filter(F.col("duration_ns") >= NOTABLE_NS).select(
        "spawn_loc", "class", "duration_ns", "start_ns", "source_key", "host", "end_ns")
    longest = rows.groupBy("spawn_loc", "class").agg(F.max("duration_ns").alias("duration_ns"))
    tied = rows.join(longest, ["spawn_loc", "class", "duration_ns"], "left_semi")
    first = F.min(F.struct("start_ns", "source_key", "host", "end_ns")).alias("b")
    return tied.groupBy("spawn_loc", "class", "duration_ns").agg(first).select(
        "spawn_loc", "class", "duration_ns", "b.start_ns", "b.end_ns", "b.host", "b.source_key")


def worker_activity(polls: DataFrame) -> DataFrame:
    """Per (host, worker): polls, busy time, observed time summed over segments, notable polls and the worst."""
    notable = F.col("duration_ns") >= NOTABLE_NS
    per_segment = polls.groupBy("host", "worker_id", "source_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("busy"),
        F.greatest(F.max("end_ns") - F.min("start_ns"), F.lit(0)).alias("seen"), F.count_if(notable).alias("notable"),
        F.max(F.when(notable, F.col("duration_ns"))).alias("worst"))
    return per_segment.groupBy("host", "worker_id").agg(
        F.sum("n").alias("total_polls"), F.sum("busy").alias("busy_ns"), F.sum("seen").alias("observed_ns"),
        F.sum("notable").alias("notable_polls"), F.coalesce(F.max("worst"), F.lit(0)).alias("worst_poll_ns"),
    ).withColumn("busy_pct", F.coalesce(F.try_divide(F.col("busy_ns") * 100, F.col("observed_ns")), F.lit(0.0)))


def host_busy(activity: DataFrame) -> DataFrame:
    """Pooled busyness per host (not a mean of ratios) and active against configured workers."""
    return activity.groupBy("host").agg(
        F.coalesce(F.try_divide(F.sum("busy_ns") * 100, F.sum("observed_ns")), F.lit(0.0)).alias("busy_pct"),
        F.count(F.lit(1)).alias("active_workers"),
        F.greatest(F.max("worker_id") + 1, F.count(F.lit(1))).alias("num_workers"),
        F.sum("total_polls").alias("total_polls"), F.sum("notable_polls").alias("notable_polls"),
        F.max("worst_poll_ns").alias("worst_poll_ns"))


def sched_coverage(polls: DataFrame) -> DataFrame:
    measured = F.col("scheduling_delay_ns").isNotNull()
    kind, inst = F.col("scheduling_delay_kind"), F.col("task_instrumented")
    tallies = {
        "observed_polls": measured, "unmeasured_polls": ~measured,
        "over_1ms_polls": measured & (F.col("scheduling_delay_ns") >= HIGH_DELAY_NS),
        "spawn_inferred_polls": measured & (kind == 0), "wake_observed_polls": measured & (kind == 1),
        "wake_during_poll_polls": measured & (kind == 2), "uninstrumented_unmeasured_polls": ~measured & ~inst,
        "instrumentation_unknown_unmeasured_polls": ~measured & inst.isNull(),
        "missing_readiness_unmeasured_polls": ~measured & inst}
    return polls.agg(*[F.count_if(cond).alias(name) for name, cond in tallies.items()])


def period_stats(polls: DataFrame, threshold_ns: int, slot=AUTO) -> DataFrame:
    """Polls over a threshold per location: classes, rate per minute of the whole period, and p50, p99 and max
    picked by position floor(n * p) of the descending list."""
    span = polls.agg(F.max("start_ns") - F.min("start_ns")).scalar()
    over = classified(polls).filter(F.col("duration_ns") >= max(threshold_ns, NOTABLE_NS))
    counts = over.groupBy("spawn_loc").agg(
        F.count(F.lit(1)).alias("long_polls"),
        *[F.count_if(F.col("class") == c).alias(c) for c in ("off_cpu", "on_cpu", "mixed")])
    picks = {
        "p50": lambda n: n - 1 - F.floor(n * F.lit(0.5)), "p99": lambda n: n - 1 - F.floor(n * F.lit(0.01)),
        "max": lambda n: n - 1}
    stats = order_statistics(over, ["spawn_loc"], "duration_ns", picks, slot).drop("n")
    minutes = span / F.lit(60e9)
    return counts.join(stats, "spawn_loc").withColumn(
        "rate", F.when(minutes > 0, F.col("long_polls") / minutes).otherwise(F.lit(0.0)))


def period_diff(first: DataFrame, last: DataFrame) -> DataFrame:
    """Outer merge of two periods' rates per location with the verdict of the change."""
    joined = (
        first.select("spawn_loc", F.col("rate").alias("f")).join(last.select("spawn_loc", F.col("rate").alias("l")), "spawn_loc", "full_outer")
        .select("spawn_loc", F.coalesce("f", F.lit(0.0)).alias("first_rate"), F.coalesce("l", F.lit(0.0)).alias("last_rate"))
        .filter((F.col("first_rate") > 0) | (F.col("last_rate") > 0)))
    delta = F.col("last_rate") - F.col("first_rate")
    return joined.select(
        "*", delta.alias("delta"), (delta > 0.1).alias("regression"), (delta < -0.1).alias("improvement"),
        ((F.col("first_rate") == 0) & (F.col("last_rate") > 0)).alias("new_offender"),
        F.when(F.col("first_rate") > 0, delta / F.col("first_rate") * 100).alias("pct"))


def top_long_polls(polls: DataFrame, k: int = 100) -> DataFrame:
    return (
        polls.filter(F.col("duration_ns") >= NOTABLE_NS)
        .orderBy(F.desc("duration_ns"), "start_ns", "source_key", "host", "worker_id", "task_id").limit(k)
        .select("duration_ns", "start_ns", "end_ns", "source_key", "host", "worker_id", "task_id", "spawn_loc"))


def top_sched_delays(polls: DataFrame, k: int = 100) -> DataFrame:
    return (
        polls.filter(F.col("scheduling_delay_ns").isNotNull())
        .orderBy(F.desc("scheduling_delay_ns"), "start_ns", "source_key", "host", "worker_id", "task_id").limit(k)
        .select(F.col("scheduling_delay_ns").alias("delay_ns"), "start_ns", "source_key", "host", "worker_id", "task_id",
                F.col("scheduling_delay_kind").alias("kind")))


def latency_tier(ns: Column) -> Column:
    return F.when(ns >= 3_000_000, "bad").when(ns >= 1_000_000, "warn").otherwise("")


def busyness_tier(pct: Column) -> Column:
    return F.when(pct >= 80, "bad").when(pct >= 50, "warn").otherwise("")


def task_index(polls: DataFrame, lifetimes: DataFrame | None = None, keys=("source_key",)) -> DataFrame:
    """Per task of a process (``keys``): polls, busy time, longest poll, first poll and its worker, number of workers; joined with
    spawn and termination times when given (all tasks of either side, missing polls are zero)."""
    per_worker = polls.groupBy(*keys, "task_id", "worker_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("ns"), F.max("duration_ns").alias("longest"), F.min("start_ns").alias("start_ns"))
    per_task = per_worker.groupBy(*keys, "task_id").agg(
        F.sum("n").alias("polls"), F.sum("ns").alias("total_ns"), F.max("longest").alias("longest_ns"),
        F.min(F.struct("start_ns", "worker_id")).alias("_first"), F.count(F.lit(1)).alias("workers"))
    per_task = per_task.select(
        *keys, "task_id", "polls", "total_ns", "longest_ns", F.col("_first.start_ns").alias("first_poll_ns"),
        F.col("_first.worker_id").alias("first_worker"), "workers")
    if lifetimes is None:
        return per_task
    zero = F.lit(0).cast("bigint")
    return per_task.join(lifetimes, [*keys, "task_id"], "full_outer").select(
        *keys, "task_id", *[F.coalesce(c, zero).alias(c) for c in ("polls", "total_ns", "longest_ns", "workers")],
        F.coalesce("first_poll_ns", F.lit(-1).cast("bigint")).alias("first_poll_ns"),
        F.coalesce("first_worker", F.lit(-1)).alias("first_worker"), "spawn_loc", "spawn_ns", "terminate_ns",
        (F.col("terminate_ns") - F.col("spawn_ns")).alias("lifetime_ns"))


def sort_tasks(tasks: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sorted by a key, unknown values first when ascending and last when descending, ties by task and then by its process."""
    col = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    ties = [c for c in ("host", "source_key") if c in tasks.columns]
    return tasks.orderBy(col, "task_id", *ties)


def ranked_tasks(tasks: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Every task with its place (``rank``, from 1) in the order of :func:`sort_tasks`. The sort deals ranges to tasks; a row's place is that within
    its range and the sizes of the ranges before it, so no task holds all rows."""
    laid = cut_lineage(sort_tasks(tasks, key, descending).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id")))
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    before = sizes.select("_range", "_first", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    return laid.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_range", "_id", "_first", "_before")


def spawn_family(tasks: DataFrame, owner: Column | None = None) -> DataFrame:
    """Per spawn location: tasks, polls, longest poll and its owner (the task with the largest ``owner``; by default that of the longest poll, the
    smallest of several), running tasks, mean lifetime over known. Lifetimes are added up as decimals and rounded once: adding doubles up loses nanoseconds."""
    owner = F.struct("longest_ns", -F.col("task_id")) if owner is None else owner
    known = F.when(F.count("lifetime_ns") > 0, F.count("lifetime_ns"))
    mean = F.sum(F.col("lifetime_ns").cast("decimal(20,0)")).cast("double") / known
    return tasks.groupBy("spawn_loc").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("polls").alias("polls"), F.sum("total_ns").alias("total_ns"),
        F.max("longest_ns").alias("longest_ns"), F.max_by("task_id", owner).alias("longest_task"),
        F.count_if(F.col("terminate_ns").isNull()).alias("running"), F.count("lifetime_ns").alias("lifetime_known"),
        mean.cast("double").alias("mean_lifetime_ns"))


def worker_busy_window(polls: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Clipped busy time per worker inside a window."""
    inside = polls.filter((F.col("start_ns") < end_ns) & (F.col("end_ns") > start_ns))
    clipped = F.least("end_ns", F.lit(end_ns)) - F.greatest("start_ns", F.lit(start_ns))
    return inside.groupBy("host", "worker_id").agg(F.sum(clipped).alias("busy_ns"), F.count(F.lit(1)).alias("polls"))
