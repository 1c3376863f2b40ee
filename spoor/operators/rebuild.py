"""Intervals rebuilt from the event stream: polls, parks, active periods, bindings, readiness.

Each state machine is a handful of ordered windows per lane ``(source_key, worker_id)`` or task
``(source_key, task_id)``; state never crosses a source file. Ties on ``ts_ns`` follow the decode order
``seq``. For a Wake row ``task_id`` is the woken task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.timeline import AUTO, asof, following, measure_slot, prev, running_max, running_sum, with_order
from spoor.session import cut_lineage

LANE = ["source_key", "worker_id"]
TASK = ["source_key", "task_id"]
TID = ["source_key", "tid"]
ORDER = ["ts_ns", "seq"]
LIFECYCLE = ("PollStart", "PollEnd", "WorkerPark", "WorkerUnpark")


def time_slot(events: DataFrame, slot=AUTO):
    """One measured slot width serves every window of a query: lanes and tasks are parts of a source."""
    return measure_slot(events, ["source_key"], "ts_ns", slot)


def closed_starts(events: DataFrame, slot=AUTO) -> DataFrame:
    """Every poll start with how it was closed: by which event, when, and whether the task moved away first."""
    slot = time_slot(events, slot)
    lane = events.filter(F.col("kind").isin(*LIFECYCLE)).select(
        *LANE, "task_id", "spawn_loc", *ORDER, "kind")
    nexted = with_order(lane, LANE, ORDER, {"n": following(F.struct("kind", *ORDER))}, slot)
    starts = nexted.filter(F.col("kind") == "PollStart").drop("kind")
    moved = with_order(starts, TASK, ORDER, {"m": following(F.struct("worker_id", *ORDER))}, slot)
    migrated = F.col("m").isNotNull() & (F.col("m.worker_id") != F.col("worker_id")) & (
        F.col("n").isNull() | (F.struct("m.ts_ns", "m.seq") < F.struct("n.ts_ns", "n.seq")))
    return moved.select(
        *LANE, "task_id", "spawn_loc", "seq", F.col("ts_ns").alias("start_ns"),
        F.when(migrated, "Migrated").otherwise(F.col("n.kind")).alias("closed_by"),
        F.when(migrated, F.col("m.ts_ns")).otherwise(F.col("n.ts_ns")).alias("end_ns"),
        F.when(migrated, F.col("m.seq")).otherwise(F.col("n.seq")).alias("end_seq"))


def polls(events: DataFrame, slot=AUTO, starts: DataFrame | None = None) -> DataFrame:
    """Polls with a proven end: an explicit poll end, or the park of the worker. ``starts``: ``closed_starts`` of the events, if at hand."""
    done = (closed_starts(events, slot) if starts is None else starts).filter(F.col("closed_by").isin("PollEnd", "WorkerPark"))
    return done.select(
        *LANE, "task_id", "spawn_loc", "seq", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        (F.col("closed_by") == "PollEnd").alias("explicit_end"))


def unproven_ends(events: DataFrame, slot=AUTO) -> DataFrame:
    """Number of polls dropped per source because nothing proved their end."""
    lost = closed_starts(events, slot).filter(F.col("closed_by").isin("Migrated", "PollStart", "WorkerUnpark"))
    return lost.groupBy("source_key").agg(F.count(F.lit(1)).alias("end_unproven"))


def polls_open_ended(events: DataFrame, slot=AUTO) -> DataFrame:
    """Viewer variant: a restart or park bounds an unfinished poll (flagged); unpark and trace end drop it."""
    slot = time_slot(events, slot)
    lane = events.filter(F.col("kind").isin(*LIFECYCLE)).select(*LANE, "task_id", "spawn_loc", *ORDER, "kind")
    nexted = with_order(lane, LANE, ORDER, {"n": following(F.struct("kind", "ts_ns"))}, slot)
    return nexted.filter((F.col("kind") == "PollStart") & F.col("n.kind").isin("PollEnd", "PollStart", "WorkerPark")).select(
        *LANE, "task_id", "spawn_loc", "seq", F.col("ts_ns").alias("start_ns"), F.col("n.ts_ns").alias("end_ns"),
        (F.col("n.kind") != "PollEnd").alias("open_ended"))


def _park_steps(events: DataFrame, slot) -> DataFrame:
    parks = events.filter(F.col("kind").isin("WorkerPark", "WorkerUnpark")).select(
        *LANE, "tid", *ORDER, "kind", "cpu_time_ns", "sched_wait_ns")
    return with_order(
        parks, LANE, ORDER, {"n": following(F.struct("kind", "ts_ns", "cpu_time_ns", "sched_wait_ns", "tid"))},
        time_slot(events, slot))


def parks(events: DataFrame, slot=AUTO, woken: bool = False) -> DataFrame:
    """Park to unpark with the kernel's scheduling wait; a park open at the end of a source closes there, or with ``woken`` is left out."""
    stepped = _park_steps(events, slot).filter(F.col("kind") == "WorkerPark")
    if woken:
        return stepped.filter(F.col("n.kind") == "WorkerUnpark").select(
            *LANE, "seq", F.col("ts_ns").alias("start_ns"), F.col("n.ts_ns").alias("end_ns"), F.col("n.sched_wait_ns").alias("sched_wait_ns"))
    ends = events.groupBy("source_key").agg(F.max("ts_ns").alias("max_ts"))
    stepped = stepped.filter(F.col("n").isNull() | (F.col("n.kind") == "WorkerUnpark"))
    return stepped.join(ends, "source_key").select(
        *LANE, "seq", F.col("ts_ns").alias("start_ns"), F.coalesce("n.ts_ns", "max_ts").alias("end_ns"),
        F.col("n.sched_wait_ns").alias("sched_wait_ns"))


def active_periods(events: DataFrame, gap_safe: bool = False, slot=AUTO) -> DataFrame:
    """Unpark to park with the CPU share of the period (1 when it has no length).

    With ``gap_safe`` a period in which the worker changed threads is dropped: its CPU delta mixes two threads.
    """
    stepped = _park_steps(events, slot).filter((F.col("kind") == "WorkerUnpark") & (F.col("n.kind") == "WorkerPark"))
    if gap_safe:
        stepped = stepped.filter((F.col("tid") == F.col("n.tid")) | (F.col("n.ts_ns") == F.col("ts_ns")))
    wall = F.col("n.ts_ns") - F.col("ts_ns")
    cpu = F.col("n.cpu_time_ns") - F.col("cpu_time_ns")
    return stepped.select(
        *LANE, "seq", F.col("ts_ns").alias("start_ns"), F.col("n.ts_ns").alias("end_ns"), cpu.alias("cpu_delta_ns"),
        F.when(wall > 0, F.least(F.try_divide(cpu, wall), F.lit(1.0))).otherwise(F.lit(1.0)).alias("ratio"))


def tid_bindings(events: DataFrame, slot=AUTO) -> DataFrame:
    """History of thread to worker bindings, repeats dropped."""
    seen = events.filter(F.col("kind").isin("WorkerPark", "WorkerUnpark")).select(*TID, "worker_id", *ORDER)
    lagged = with_order(seen, TID, ORDER, {"was": prev(F.col("worker_id"))}, time_slot(events, slot))
    return lagged.filter(F.col("was").isNull() | (F.col("was") != F.col("worker_id"))).select(
        *TID, F.col("ts_ns").alias("from_ns"), "seq", "worker_id")


def handoff_gaps(events: DataFrame, slot=AUTO) -> DataFrame:
    """Spans in which a worker silently changed threads, one row per gap."""
    stepped = _park_steps(events, slot).filter(F.col("n").isNotNull() & (F.col("tid") != F.col("n.tid")))
    return stepped.select(
        *LANE, "seq", F.col("tid").alias("from_tid"), F.col("n.tid").alias("to_tid"), F.col("ts_ns").alias("start_ns"),
        F.col("n.ts_ns").alias("end_ns"))


def thread_gaps(gaps: DataFrame, slot=AUTO) -> DataFrame:
    """Gaps of both threads involved, merged per thread."""
    both = gaps.select(
        "source_key", F.explode(F.array("from_tid", "to_tid")).alias("tid"), "start_ns", "end_ns")
    return merge_intervals(both, TID, slot)


def merge_intervals(df: DataFrame, keys, slot=AUTO) -> DataFrame:
    """Union of intervals per key; touching intervals join."""
    keys = list(keys)
    slot = measure_slot(df, keys, "start_ns", slot)
    distinct = df.groupBy(*keys, "start_ns").agg(F.max("end_ns").alias("end_ns"))
    reach = with_order(distinct, keys, ["start_ns"], {"reach": running_max(F.col("end_ns"), False)}, slot)
    fresh = (F.col("reach").isNull() | (F.col("start_ns") > F.col("reach"))).cast("int")
    islands = with_order(reach, keys, ["start_ns"], {"island": running_sum(fresh)}, slot)
    return islands.groupBy(*keys, "island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("island")


def union_duration(df: DataFrame, keys, slot=AUTO) -> DataFrame:
    return merge_intervals(df, keys, slot).groupBy(*keys).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("union_ns"))


def readiness(events: DataFrame, slot=AUTO, starts: DataFrame | None = None) -> DataFrame:
    """Polls with the evidence of when their task became ready (kind 0 spawn, 1 wake, 2 wake during a poll).

    Between two starts of a task the decisive facts are: its last spawn or termination, whether a wake fell
    into the previous poll and that poll ended explicitly, and the first wake after it closed. ``starts``: ``closed_starts`` of the events, if at hand.
    """
    slot = time_slot(events, slot)
    starts = closed_starts(events, slot) if starts is None else starts
    marks = starts.select(
        *TASK, F.col("start_ns").alias("ts_ns"), "seq", F.lit("PollStart").alias("kind"),
        F.struct(F.col("end_ns").alias("ts_ns"), F.col("end_seq").alias("seq"),
                 (F.col("closed_by") == "PollEnd").alias("explicit")).alias("close"),
        F.lit(None).cast("bigint").alias("waker_task_id"), F.lit(None).cast("boolean").alias("instrumented"))
    evidence = events.filter(F.col("kind").isin("TaskSpawn", "TaskTerminate", "Wake")).select(
        *TASK, *ORDER, "kind", F.lit(None).cast(marks.schema["close"].dataType).alias("close"), "waker_task_id", "instrumented")
    is_start = F.col("kind") == "PollStart"
    stacked = with_order(
        marks.unionByName(evidence), TASK, ORDER,
        {"next_start": following(F.struct(*ORDER), is_start), "last_close": prev(F.col("close"), is_start)}, slot)
    told = stacked.filter(~is_start & F.col("next_start").isNotNull())
    at, close = F.struct(*ORDER), F.struct("last_close.ts_ns", "last_close.seq")
    turn, wake = F.col("kind").isin("TaskSpawn", "TaskTerminate"), F.col("kind") == "Wake"
    before = F.col("last_close").isNotNull() & (F.col("last_close.ts_ns").isNull() | (at < close))
    facts = told.groupBy(*TASK, F.col("next_start.seq").alias("seq")).agg(
        F.max(F.when(turn, F.struct("ts_ns", "seq", "kind"))).alias("L"), F.min(F.when(turn, at)).alias("F"),
        F.min(F.when(wake & before, F.struct("ts_ns", "seq", "waker_task_id"))).alias("wm"),
        F.min(F.when(wake & ~before, F.struct("ts_ns", "seq", "waker_task_id"))).alias("w1"),
        F.max("last_close").alias("C"))
    mid = F.coalesce(F.col("C.explicit"), F.lit(False)) & F.col("wm").isNotNull() & (
        F.col("F").isNull() | (F.struct("wm.ts_ns", "wm.seq") < F.col("F")))
    after_close = F.col("C").isNull() | (F.struct("L.ts_ns", "L.seq") > F.struct("C.ts_ns", "C.seq"))
    spawned = (F.col("L.kind") == "TaskSpawn") & (after_close | ~mid)
    long, integer = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    verdict = facts.select(
        "source_key", "seq",
        F.when(F.col("L.kind") == "TaskTerminate", long).when(spawned, F.col("L.ts_ns")).when(mid, F.col("C.ts_ns"))
        .otherwise(F.col("w1.ts_ns")).alias("ready"),
        F.when(F.col("L.kind") == "TaskTerminate", integer).when(spawned, 0).when(mid, 2)
        .when(F.col("w1").isNotNull(), 1).alias("rk"),
        F.when(F.col("L.kind") == "TaskTerminate", long).when(spawned, long).when(mid, F.col("wm.waker_task_id"))
        .otherwise(F.col("w1.waker_task_id")).alias("rw"))
    done = starts.filter(F.col("closed_by").isin("PollEnd", "WorkerPark")).drop("closed_by", "end_seq")
    ok = F.col("ready") <= F.col("start_ns")
    return done.join(verdict, ["source_key", "seq"], "left").select(
        *LANE, "task_id", "spawn_loc", "seq", "start_ns", "end_ns", F.when(ok, F.col("ready")).alias("ready_at_ns"),
        F.when(ok, F.col("start_ns") - F.col("ready")).alias("scheduling_delay_ns"),
        F.when(ok, F.col("rk")).alias("scheduling_delay_kind"), F.when(ok, F.col("rw")).alias("waker_task_id"))


def task_instrumented(events: DataFrame) -> DataFrame:
    """Latest instrumentation flag per task."""
    return events.filter(F.col("kind") == "TaskSpawn").groupBy(*TASK).agg(
        F.max_by("instrumented", F.struct(*ORDER)).alias("instrumented"))


def attribute_samples(samples: DataFrame, events: DataFrame, poll_rows: DataFrame | None = None, slot=AUTO) -> DataFrame:
    """Each sample with its worker at that time and the poll it fell into (half-open).

    The thread's latest binding gives the worker, unless the thread is inside a hand-over gap then; polls of a
    worker do not overlap, so the latest start before the sample is the only candidate.
    """
    slot = time_slot(events, slot)
    poll_rows = polls(events, slot) if poll_rows is None else poll_rows
    bound = asof(samples, tid_bindings(events, slot), TID, "t", "from_ns", ["worker_id"], right_tie=["seq"], slot=slot)
    gaps = thread_gaps(handoff_gaps(events, slot), slot).withColumnRenamed("end_ns", "gap_end")
    gapped = asof(bound, gaps, TID, "t", "start_ns", ["gap_end"], slot=slot)
    lost = F.col("gap_end").isNotNull() & (F.col("t") < F.col("gap_end"))
    placed = gapped.withColumn("worker_id", F.when(~lost, F.col("worker_id"))).drop("gap_end")
    looked = poll_rows.select(
        *LANE, "start_ns", F.col("end_ns").alias("poll_end"), F.col("seq").alias("poll_seq"), F.col("start_ns").alias("poll_start"),
        F.col("task_id").alias("poll_task"), F.col("spawn_loc").alias("poll_loc"))
    hit = asof(placed, looked, LANE, "t", "start_ns", ["poll_seq", "poll_start", "poll_end", "poll_task", "poll_loc"],
               right_tie=["poll_seq"], slot=slot)
    inside = F.col("poll_end").isNotNull() & F.col("worker_id").isNotNull() & (F.col("t") < F.col("poll_end"))
    cols = ("poll_seq", "poll_start", "poll_end", "poll_task", "poll_loc")
    return hit.select(*placed.columns, *[F.when(inside, F.col(c)).alias(c) for c in cols])


def poll_sample_counts(attributed: DataFrame) -> DataFrame:
    return attributed.filter(F.col("poll_seq").isNotNull()).groupBy("source_key", "poll_seq").agg(
        F.count_if(F.col("source") == 0).alias("cpu_samples"), F.count_if(F.col("source") == 1).alias("sched_samples"))


def nearest(left: DataFrame, right: DataFrame, keys, left_t: str, right_t: str, take, slot=AUTO) -> DataFrame:
    """Right row with the smallest time distance, ties to the earlier one."""
    box = F.struct(F.col(right_t).alias("t"), *take)
    back = asof(left, right.withColumn("_b", box), keys, left_t, right_t, ["_b"], slot=slot)
    both = asof(back, right.withColumn("_a", box), keys, left_t, right_t, ["_a"], inclusive=False, direction="forward", slot=slot)
    forward = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a.t") - F.col(left_t) < F.col(left_t) - F.col("_b.t")))
    pick = F.when(forward, F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_n", pick).select(*left.columns, F.col("_n.t").alias("near_t"), *[F.col("_n").getField(c).alias(c) for c in take])


MAX_DELAY_NS = 1_000_000_000


def wake_to_poll(events: DataFrame, max_delay_ns: int = MAX_DELAY_NS, slot=AUTO) -> DataFrame:
    """Delay from the latest wake at or before each poll start of its task, kept when 0 < d < the maximum."""
    slot = time_slot(events, slot)
    mixed = events.filter(F.col("kind").isin("Wake", "PollStart")).select(*TASK, *ORDER, "kind", "worker_id")
    carried = with_order(mixed, TASK, ORDER, {"wake_ns": prev(F.col("ts_ns"), F.col("kind") == "Wake")}, slot)
    delay = F.col("ts_ns") - F.col("wake_ns")
    return carried.filter((F.col("kind") == "PollStart") & (delay > 0) & (delay < max_delay_ns)).select(
        *TASK, "worker_id", "seq", F.col("ts_ns").alias("poll_ns"), "wake_ns", delay.alias("delay_ns"))


def sched_delays(events: DataFrame, poll_rows: DataFrame | None = None, max_delay_ns: int = MAX_DELAY_NS,
                 allow_zero: bool = False, slot=AUTO) -> DataFrame:
    """As :func:`wake_to_poll` over rebuilt polls, but a wake inside an earlier poll of the task counts from
    that poll's end."""
    slot = time_slot(events, slot)
    poll_rows = polls_open_ended(events, slot) if poll_rows is None else poll_rows
    wakes = events.filter(F.col("kind") == "Wake").select(*TASK, "ts_ns", "seq", "waker_task_id")
    spans = poll_rows.select(*TASK, "start_ns", F.col("end_ns").alias("in_end"), F.col("start_ns").alias("in_start"), "seq")
    # What the task was doing when it was woken, then the latest wake of every poll.
    woken = asof(wakes, spans, TASK, "ts_ns", "start_ns", ["in_start", "in_end"], right_tie=["seq"], slot=slot)
    woken = woken.withColumnRenamed("ts_ns", "wake_ns")
    hit = asof(poll_rows, woken, TASK, "start_ns", "wake_ns", ["wake_ns", "in_start", "in_end", "waker_task_id"],
               right_tie=["seq"], slot=slot)
    inside = F.col("in_end").isNotNull() & (F.col("in_start") < F.col("start_ns")) & (F.col("wake_ns") <= F.col("in_end"))
    effective = F.when(inside, F.col("in_end")).otherwise(F.col("wake_ns"))
    delay = F.col("start_ns") - effective
    low = delay >= 0 if allow_zero else delay > 0
    return hit.filter(F.col("wake_ns").isNotNull() & low & (delay < max_delay_ns)).select(
        *LANE, "task_id", "seq", "start_ns", "end_ns", effective.alias("wake_ns"), delay.alias("delay_ns"), "waker_task_id")


def spawn_delays(events: DataFrame, poll_rows: DataFrame, floor_ns: int = 0) -> DataFrame:
    """First poll of a task on any worker minus its spawn."""
    first = poll_rows.groupBy(*TASK).agg(F.min(F.struct("start_ns", "seq", "worker_id", "end_ns")).alias("f"))
    spawns = events.filter(F.col("kind") == "TaskSpawn").groupBy(*TASK).agg(F.max_by("ts_ns", F.struct(*ORDER)).alias("spawn_ns"))
    delay = F.col("f.start_ns") - F.col("spawn_ns")
    return first.join(spawns, TASK).filter(delay > floor_ns).select(
        *TASK, F.col("f.worker_id").alias("worker_id"), "spawn_ns", F.col("f.start_ns").alias("start_ns"), delay.alias("delay_ns"))


def points_of_interest(events: DataFrame, samples: DataFrame, k: int = 50, max_delay_ns: int = MAX_DELAY_NS, slot=AUTO) -> DataFrame:
    """The worst ``k`` points of seven kinds with the number matched before the cut."""
    slot = time_slot(events, slot)
    poll_rows = cut_lineage(polls_open_ended(events, slot))  # read by five of the kinds
    dur = F.col("end_ns") - F.col("start_ns")

    def point(df, kind, time, value):
        return df.select(
            F.lit(kind).alias("kind"), "source_key", "worker_id", time.alias("time_ns"), value.cast("double").alias("value"))

    counted = poll_sample_counts(attribute_samples(samples, events, poll_rows, slot))
    sampled = poll_rows.join(counted.withColumnRenamed("poll_seq", "seq"), ["source_key", "seq"], "left_semi")
    flagged = poll_rows.join(task_instrumented(events).filter(~F.col("instrumented")), TASK, "left_semi")
    off = active_periods(events, True, slot)
    kinds = [
        point(parks(events, slot).filter("sched_wait_ns > 0"), "sched", F.col("end_ns") - F.col("sched_wait_ns"), F.col("sched_wait_ns")),
        point(poll_rows.filter(dur > 0), "long-poll", F.col("start_ns"), dur / 1e6),
        point(sampled, "cpu-sampled", F.col("start_ns"), dur / 1e6),
        point(off.filter((1 - F.col("ratio")) * dur > 0), "off-cpu-active", F.col("start_ns"), (1 - F.col("ratio")) * dur),
        point(sched_delays(events, poll_rows, max_delay_ns, slot=slot), "wake-delay", F.col("wake_ns"), F.col("delay_ns") / 1000),
        point(flagged, "uninstrumented", F.col("start_ns"), dur / 1e6),
        point(spawn_delays(events, poll_rows), "spawn-delay", F.col("spawn_ns"), F.col("delay_ns") / 1000)]
    union = kinds[0]
    for more in kinds[1:]:
        union = union.unionByName(more)
    return worst_per_kind(union, k)


def worst_per_kind(points: DataFrame, k: int) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("kind").orderBy(F.desc("value"), "time_ns", "source_key", "worker_id")
    worst = points.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    matched = points.groupBy("kind").agg(F.count(F.lit(1)).alias("matched"), F.max("value").alias("peak"))
    return worst.join(F.broadcast(matched), "kind")  # one row per kind


def severity(value: Column, peak: Column) -> Column:
    share = F.when(peak > 0, value / peak).otherwise(F.lit(0.0))
    return F.when(share >= 0.66, "high").when(share >= 0.33, "med").otherwise("low")


def runtime_task_spawns(events: DataFrame, poll_rows: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Spawns per runtime of a source: a task belongs to the runtime of the worker of its earliest poll; ``runtimes``: source_key, worker_id, runtime."""
    first = poll_rows.groupBy(*TASK).agg(F.min(F.struct("start_ns", "seq", "worker_id")).alias("f")).select(*TASK, F.col("f.worker_id").alias("worker_id"))
    return (
        events.filter(F.col("kind") == "TaskSpawn").select(*TASK, "ts_ns").join(first, TASK).join(runtimes, LANE)
        .groupBy("source_key", "runtime").agg(F.count(F.lit(1)).alias("spawns"), F.min("ts_ns").alias("first_ns")))


def local_queue_series(events: DataFrame) -> DataFrame:
    """Local queue depth at starts, parks and unparks."""
    return events.filter(F.col("kind").isin("PollStart", "WorkerPark", "WorkerUnpark")).select(
        *LANE, *ORDER, "local_queue")


def trace_summary(events: DataFrame, poll_rows: DataFrame) -> DataFrame:
    """Per worker of a source: polls, parks, unparks, poll time, deepest local queue, scheduling wait over sampled unparks."""
    per = events.groupBy(*LANE).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "WorkerPark").alias("parks"),
        F.count_if(F.col("kind") == "WorkerUnpark").alias("unparks"),
        F.max(F.when(F.col("kind").isin("PollStart", "WorkerPark", "WorkerUnpark"), F.col("local_queue"))).alias("max_local_queue"),
        F.count(F.when(F.col("kind") == "WorkerUnpark", F.col("sched_wait_ns"))).alias("sched_wait_samples"),
        F.coalesce(F.sum(F.when(F.col("kind") == "WorkerUnpark", F.col("sched_wait_ns"))), F.lit(0)).alias("sched_wait_ns"))
    work = poll_rows.groupBy(*LANE).agg(F.count(F.lit(1)).alias("polls"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("poll_ns"))
    return per.join(work, LANE, "left").fillna(0, ["polls", "poll_ns"])


def gap_samples(gaps: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples on either thread of a hand-over gap, inside ``[start, end)``."""
    from spoor.plans.interval_join import point_in_intervals

    sides = gaps.withColumn("tid", F.explode(F.array_distinct(F.array("from_tid", "to_tid")))).select(
        *TID, F.col("seq").alias("gap_seq"), "start_ns", "end_ns", "worker_id")
    return point_in_intervals(samples, sides, TID, "t", "start_ns", "end_ns")


def dump_wait(dumps: DataFrame, poll_rows: DataFrame, slot=AUTO) -> DataFrame:
    """Task dumps joined to the poll starting at their time, with the idle time since the previous poll's end."""
    lagged = with_order(poll_rows, TASK, ["start_ns", "seq"], {"prev_end": prev(F.col("end_ns"))}, slot)
    at = lagged.select(*TASK, F.col("start_ns").alias("ts_ns"), "end_ns", (F.col("start_ns") - F.col("prev_end")).alias("idle_ns"))
    return dumps.join(at, [*TASK, "ts_ns"])


def segment_edge_polls(events: DataFrame) -> DataFrame:
    """Per source and worker: the poll open at the end, and whether a poll end came first (an unpark says
    nothing about an open poll)."""
    pos = F.struct(*ORDER)
    bounds = F.when(F.col("kind") != "WorkerUnpark", pos)
    last = F.struct("kind", "ts_ns", "task_id")
    return events.filter(F.col("kind").isin(*LIFECYCLE)).groupBy("host", *LANE).agg(
        F.min_by(F.struct("kind", "ts_ns"), pos).alias("first"), F.max_by(last, bounds).alias("last"),
    ).select(
        "host", *LANE, F.when(F.col("first.kind") == "PollEnd", F.col("first.ts_ns")).alias("close_ns"),
        F.when(F.col("last.kind") == "PollStart", F.col("last.ts_ns")).alias("open_ns"),
        F.when(F.col("last.kind") == "PollStart", F.col("last.task_id")).alias("open_task"))


def stitch_boundary_polls(edges: DataFrame, segments: DataFrame, slot=AUTO) -> DataFrame:
    """Polls cut by file rotation, rejoined when every segment between is adjacent and silent for the worker.

    ``segments``: host, source_key, start_ns, end_ns (extent), min_ts, max_ts. Segments of a host form chains of
    adjacent extents. An open poll whose worker's next active segment is in the same chain is joined to the poll
    end that comes first there, or dropped as contradicted; across a gap each side is a truncated lower bound;
    at the ends of the listing it is dropped.
    """
    order = ["start_ns", "source_key"]
    stepped = with_order(segments, ["host"], order, {"reach": prev(F.col("end_ns"))}, slot)
    broken = F.coalesce((F.col("reach") < F.col("start_ns")).cast("int"), F.lit(0))
    chained = with_order(stepped.withColumn("_b", broken), ["host"], order, {"chain": running_sum(F.col("_b"))}, slot)
    chains = chained.groupBy("host", "chain").agg(F.min("min_ts").alias("chain_min"), F.max("max_ts").alias("chain_max"))
    last = chains.groupBy("host").agg(F.max("chain").alias("last_chain"))
    placed = (
        edges.join(chained.select("host", "source_key", "chain", "start_ns"), ["host", "source_key"])
        .join(chains, ["host", "chain"]).join(last, "host"))
    around = with_order(placed, ["host", "worker_id"], order, {
        "nx": following(F.struct("chain", "close_ns")), "pv": prev(F.struct("chain", "open_ns"))}, slot)
    same_next = F.coalesce(F.col("nx.chain") == F.col("chain"), F.lit(False))
    same_prev = F.coalesce(F.col("pv.chain") == F.col("chain"), F.lit(False))
    opened = F.col("open_ns").isNotNull()
    whole = around.filter(opened & same_next & F.col("nx.close_ns").isNotNull()).select(
        "host", "worker_id", F.col("open_task").alias("task_id"), F.col("open_ns").alias("start_ns"),
        F.col("nx.close_ns").alias("end_ns"), F.lit("none").alias("truncated_at"))
    tail = around.filter(opened & ~same_next & (F.col("chain") < F.col("last_chain"))).select(
        "host", "worker_id", F.col("open_task").alias("task_id"), F.col("open_ns").alias("start_ns"),
        F.greatest("chain_max", "open_ns").alias("end_ns"), F.lit("end").alias("truncated_at"))
    head = around.filter(F.col("close_ns").isNotNull() & ~same_prev & (F.col("chain") > 0)).select(
        "host", "worker_id", F.lit(None).cast("bigint").alias("task_id"), F.least("chain_min", "close_ns").alias("start_ns"),
        F.col("close_ns").alias("end_ns"), F.lit("start").alias("truncated_at"))
    return whole.unionByName(tail).unionByName(head)
