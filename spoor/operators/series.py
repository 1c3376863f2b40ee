"""Time series of a trace: queue depth, alive tasks, CPU use, custom gauges and counters, bins and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.operators.rebuild import ORDER, TASK, merge_intervals
from spoor.plans.ranks import order_statistics
from spoor.plans.timeline import AUTO, asof, measure_slot, prev, running_sum, with_order


def queue_series(metrics: DataFrame, legacy: DataFrame | None = None, keys=("source_key",)) -> DataFrame:
    """Queue depth of a process (``keys``) per cycle, over its runtimes; the old single series only for processes without per-runtime rows."""
    keys = list(keys)
    series = metrics.groupBy(*keys, "ts_ns").agg(F.sum("global_queue_depth").alias("depth"))
    if legacy is None:
        return series
    old = legacy.join(metrics.select(*keys).distinct(), keys, "left_anti")
    return series.unionByName(old.select(*keys, "ts_ns", F.col("global_queue").alias("depth")))


def active_task_series(metrics: DataFrame, legacy: DataFrame, lifecycle: DataFrame, keys=("source_key",)) -> DataFrame:
    """Alive tasks of a process per cycle; where it misses a value anywhere its old series, and without one its lifecycle counts."""
    keys = list(keys)
    state = metrics.groupBy(*keys).agg((F.count(F.lit(1)) == F.count("alive_tasks")).alias("complete"))
    whole = state.filter("complete").select(*keys)
    told = legacy.select(*keys).distinct()
    sampled = metrics.join(whole, keys, "left_semi").groupBy(*keys, "ts_ns").agg(F.sum("alive_tasks").alias("alive"))
    old = legacy.join(whole, keys, "left_anti").select(*keys, "ts_ns", F.col("active_tasks").alias("alive"))
    counted = lifecycle.join(whole, keys, "left_anti").join(told, keys, "left_anti").select(*keys, "ts_ns", "alive")
    return sampled.unionByName(old).unionByName(counted)


def active_task_timeline(events: DataFrame, keys=("source_key",), slot=AUTO) -> DataFrame:
    """Running count of live tasks, floored at zero."""
    turns = events.filter(F.col("kind").isin("TaskSpawn", "TaskTerminate")).select(
        *keys, *ORDER, F.when(F.col("kind") == "TaskSpawn", 1).otherwise(-1).alias("delta"))
    counted = with_order(turns, list(keys), ORDER, {"n": running_sum(F.col("delta"))}, slot)
    return counted.select(*keys, *ORDER, F.greatest("n", F.lit(0)).cast("bigint").alias("alive"))


def runtime_metrics(metrics: DataFrame, keys=("source_key",)) -> DataFrame:
    """Per runtime of a process (names recur in others)."""
    return metrics.groupBy(*keys, "runtime_name").agg(
        F.count(F.lit(1)).alias("samples"), (F.count(F.lit(1)) == F.count("alive_tasks")).alias("alive_available"),
        F.coalesce(F.max("alive_tasks"), F.lit(0)).alias("max_alive"), F.max("global_queue_depth").alias("max_queue"))


def runtime_groups(workers: DataFrame, claims: DataFrame, keys=("source_key",)) -> DataFrame:
    """Runtime of every present worker of every process: the first claim wins, unclaimed workers form the inferred default, whose name
    depends on whether that process claims a runtime "main"."""
    keys = list(keys)
    taken = claims.groupBy(*keys).agg(F.max(F.col("runtime") == "main").alias("_taken"))
    first = claims.groupBy(*keys, "worker_id").agg(F.min_by("runtime", "claim_order").alias("runtime"))
    default = F.when(F.col("_taken"), "main (untracked)").otherwise("main")
    present = workers.filter(F.col("worker_id").isNotNull()).select(*keys, "worker_id").distinct()
    return present.join(first, [*keys, "worker_id"], "left").join(taken, keys, "left").select(
        *keys, "worker_id", F.coalesce("runtime", default).alias("runtime"), F.col("runtime").isNull().alias("inferred"))


def runtime_filter(samples: DataFrame, claims: DataFrame, keys=("source_key",)) -> DataFrame:
    """Samples per runtime of processes with more than one. Off-worker samples have no runtime."""
    keys = list(keys)
    per_worker = samples.filter(F.col("worker_id").isNotNull()).groupBy(*keys, "worker_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_worker.join(runtime_groups(per_worker, claims, keys), [*keys, "worker_id"]).groupBy(*keys, "runtime", "inferred").agg(F.sum("n").alias("samples"))
    return counts.withColumn("_runtimes", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_runtimes > 1").drop("_runtimes")


def cpu_usage(resource: DataFrame, capacity: float | None, keys=("host",), slot=AUTO) -> DataFrame:
    """Cores used between consecutive counter samples; pairs without progress or with a reset are skipped."""
    last = F.struct("ts_ns", "user_cpu_ns", "system_cpu_ns")
    paired = with_order(resource, list(keys), ORDER, {"p": prev(last)}, slot)
    wall = F.col("ts_ns") - F.col("p.ts_ns")
    user, system = F.col("user_cpu_ns") - F.col("p.user_cpu_ns"), F.col("system_cpu_ns") - F.col("p.system_cpu_ns")
    good = paired.filter((wall > 0) & (user >= 0) & (system >= 0))
    cores = (user + system) / wall
    pct = F.least(F.lit(100.0), cores / capacity * 100) if capacity else F.lit(None).cast("double")
    return good.select(*keys, F.col("p.ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"), wall.alias("wall_ns"),
                       (user + system).alias("cpu_ns"), cores.alias("cores"), pct.alias("pct"))


def cpu_window_stats(intervals: DataFrame, start_ns: int, end_ns: int, keys=("host",)) -> DataFrame:
    """Overlap-weighted mean and peak cores in a window."""
    overlap = F.least("end_ns", F.lit(end_ns)) - F.greatest("start_ns", F.lit(start_ns))
    return intervals.withColumn("_o", overlap).filter(F.col("_o") > 0).groupBy(*keys).agg(
        (F.sum(F.col("cores") * F.col("_o")) / F.sum("_o")).alias("avg_cores"), F.max("cores").alias("max_cores"))


def numeric_value(text: Column) -> Column:
    """Canonical unsigned decimal of at most 20 digits as a decimal number, else null."""
    ok = F.rlike(text, F.lit("^(0|[1-9][0-9]*)$")) & (F.length(text) <= 20)
    number = F.when(ok, text).cast("decimal(20,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def gauge_series(custom: DataFrame, event: str, field: str, keys=("host",)) -> DataFrame:
    """Field values of one event as they are; a missing value is an explicit gap."""
    value = numeric_value(F.col("fields")[field])  # decimal: unsigned 64-bit numbers fit
    return custom.filter(F.col("name") == event).select(
        *keys, *ORDER, value.alias("value"), F.when(value.isNull(), "missing").alias("gap"))


def field_unit(custom: DataFrame, event: str, keys=("host",)) -> DataFrame:
    """Unit of the series; null where annotations disagree."""
    units = custom.filter(F.col("name") == event).select(*keys, F.col("fields")["unit"].alias("unit")).distinct()
    return units.groupBy(*keys).agg(F.when(F.min("unit") == F.max("unit"), F.min("unit")).alias("unit"))


def counter_series(custom: DataFrame, event: str, field: str, keys=("host",), monotonic: bool = True, slot=AUTO) -> DataFrame:
    """Counter deltas over ``[previous, current)``. A missing value breaks the chain, a decrease of a monotonic
    counter is a reset marker, equal times give no sample."""
    rows = gauge_series(custom, event, field, keys)
    step = with_order(rows, list(keys), ORDER, {"p": prev(F.struct("ts_ns", "value"))}, slot)
    known = F.col("p").isNotNull() & F.col("p.value").isNotNull()
    reset = known & (F.col("value") < F.col("p.value")) & F.lit(monotonic)
    gap = F.when(F.col("value").isNull(), "missing").when(reset, "reset")
    delta = F.when(gap.isNull() & known & (F.col("ts_ns") > F.col("p.ts_ns")), F.col("value") - F.col("p.value"))
    out = step.select(
        *keys, "seq", F.when(gap.isNull(), F.col("p.ts_ns")).otherwise(F.col("ts_ns")).alias("start_ns"),
        F.when(gap.isNull(), F.col("ts_ns")).alias("end_ns"), delta.alias("value"), gap.alias("gap"))
    return out.filter(F.col("value").isNotNull() | F.col("gap").isNotNull())


def field_catalog(custom: DataFrame) -> DataFrame:
    """Chartable (event, field) pairs: their one agreed kind, or no kind but numbers seen."""
    fields = custom.select("name", "kinds", F.explode("fields").alias("field", "value"))
    rows = fields.select("name", "field", F.col("kinds")[F.col("field")].alias("kind"), numeric_value(F.col("value")).isNotNull().alias("num"))
    kinds = rows.groupBy("name", "field", "kind").agg(F.bool_or("num").alias("num"))
    pairs = kinds.groupBy("name", "field").agg(F.bool_or("num").alias("numeric_seen"), F.min("kind").alias("_a"), F.max("kind").alias("_b"))
    kind = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    return pairs.select("name", "field", kind.alias("kind"), "numeric_seen").filter(F.col("kind").isNotNull() | F.col("numeric_seen"))


def bin_timestamps(df: DataFrame, t: str, start_ns: int, end_ns: int, bins: int) -> DataFrame:
    """Counts per equal bin of the inclusive range, the last bin closed."""
    index = F.least(F.floor((F.col(t) - start_ns) / F.lit(float(end_ns - start_ns)) * bins), F.lit(bins - 1))
    return df.filter(F.col(t).between(start_ns, end_ns)).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def peak_per_window(df: DataFrame, t: str, window_ns: int = 1_000_000_000, slot=AUTO) -> DataFrame:
    """Most rows in any sliding window ``(t - window, t]``: running count minus the running count one window ago."""
    slot = measure_slot(df, [], t, slot)
    counts = df.groupBy(F.col(t).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    cum = with_order(counts, [], ["t"], {"cum": running_sum(F.col("n"))}, slot)
    now = cum.select((F.col("t") - window_ns).alias("back"), F.col("cum"))
    past = cum.select(F.col("t").alias("past_t"), F.col("cum").alias("past_cum"))
    slid = asof(now, past, [], "back", "past_t", ["past_cum"], slot=slot)
    return slid.agg(F.max(F.col("cum") - F.coalesce("past_cum", F.lit(0))).alias("peak"))


def step_lookup(probes: DataFrame, series: DataFrame, keys, probe_t: str, series_t: str, value: str, slot=AUTO) -> DataFrame:
    """Value of a step series at each probe: last sample at or before it, 0 before the first."""
    hit = asof(probes, series, list(keys), probe_t, series_t, [value], right_tie=["seq"], slot=slot)
    return hit.withColumn(value, F.coalesce(value, F.lit(0)))


def trace_range(events: DataFrame, samples: DataFrame, resource: DataFrame) -> DataFrame:
    """Time range of the events, else of the CPU samples, else of the resource samples; never of zero width."""
    e, c, r = events.agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b")), samples.filter("source = 0").agg(F.min("t").alias("a"), F.max("t").alias("b")), resource.agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    low = F.coalesce("a", c.select("a").scalar(), r.select("a").scalar())
    high = F.coalesce("b", c.select("b").scalar(), r.select("b").scalar())
    return e.select(low.alias("start_ns"), F.greatest(high, low + 1).alias("end_ns"))


def spawn_counts(events: DataFrame) -> DataFrame:
    """Spawned and still living tasks per spawn location."""
    spawns = events.filter(F.col("kind") == "TaskSpawn").select("source_key", "task_id", "spawn_loc", "ts_ns")
    ended = events.filter(F.col("kind") == "TaskTerminate").select("source_key", "task_id").distinct()
    alive = spawns.join(ended, ["source_key", "task_id"], "left_anti").groupBy("spawn_loc").agg(F.count(F.lit(1)).alias("alive"))
    return spawns.groupBy("spawn_loc").agg(F.count(F.lit(1)).alias("spawned")).join(alive, "spawn_loc", "left").fillna(0, ["alive"])


def spawned_in_range(poll_rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Tasks first polled in the inclusive range, per location."""
    first = poll_rows.groupBy(*TASK).agg(F.min(F.struct("start_ns", "seq", "spawn_loc")).alias("f"))
    return first.filter(F.col("f.start_ns").between(start_ns, end_ns)).groupBy(F.col("f.spawn_loc").alias("spawn_loc")).agg(F.count(F.lit(1)).alias("tasks"))


def segment_quantiles(rows: DataFrame, keys, value: str, slot=AUTO) -> DataFrame:
    """min, p50, p90, p99, max by integer position n/2, n*90/100, n*99/100."""
    at = lambda p: (lambda n: F.least(F.floor(n * p / 100), n - 1))
    picks = {"min": lambda n: F.lit(0), "p50": at(50), "p90": at(90), "p99": at(99), "max": lambda n: n - 1}
    return order_statistics(rows, list(keys), value, picks, slot)


def duration_summary(durations: Mapping[str, DataFrame], slot=AUTO) -> DataFrame:
    """Count, extremes and percentiles of several kinds of durations (columns source_key, ns), per source and kind."""
    rows = None
    for what, df in durations.items():
        own = df.select("source_key", F.lit(what).alias("what"), F.col("ns").cast("bigint").alias("ns"))
        rows = own if rows is None else rows.unionByName(own)
    return segment_quantiles(rows, ["source_key", "what"], "ns", slot)


def blocking_view(attributed: DataFrame) -> DataFrame:
    """Scheduler samples inside polls by leaf: count, share, distinct stacks, five example polls."""
    inside = attributed.filter((F.col("source") == 1) & F.col("poll_seq").isNotNull()).withColumn(
        "leaf", F.coalesce(F.get("frames", F.lit(0)), F.lit("(unknown)")))
    stacks = inside.groupBy("leaf", F.array_join("frames", ";").alias("stack")).agg(F.count(F.lit(1)).alias("n"))
    per_leaf = stacks.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("stacks"))
    total = inside.agg(F.count(F.lit(1))).scalar()
    order = Window.partitionBy("leaf").orderBy("t", "sample_id")
    first = inside.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= 5)
    shown = first.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "poll_seq"))), lambda x: x["poll_seq"].cast("string")), ",").alias("examples"))
    return per_leaf.join(shown, "leaf").select("leaf", "n", "stacks", (F.floor(F.col("n") / total * 1000 + 0.5) / 10).alias("pct"), "examples")


def tid_census(samples: DataFrame, start_ns: int, end_ns: int, hz: float) -> DataFrame:
    """Per thread in a window: on and off CPU samples, estimated on-CPU time, mean gap between samples (from three
    on), commonest leaf, and whether the thread was pinned: on CPU for at least 0.6 of a window long enough to tell."""
    inside = samples.filter(F.col("t").between(start_ns, end_ns)).withColumn("leaf", F.get("frames", F.lit(0)))
    # Two levels: the leaf counts are combined map-side, a thread's rows are never gathered.
    leaves = inside.groupBy("source_key", "tid", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == 0).alias("on"), F.count_if(F.col("source") == 1).alias("off"),
        F.min("t").alias("a"), F.max("t").alias("b"))
    per = leaves.groupBy("source_key", "tid").agg(
        F.sum("n").alias("n"), F.sum("on").alias("on_cpu"), F.sum("off").alias("off_cpu"), F.min("a").alias("a"), F.max("b").alias("b"),
        F.min(F.struct((-F.col("n")).alias("c"), "leaf")).alias("l"))
    expected = (end_ns - start_ns) / 1e9 * hz
    cover = F.least(F.lit(1.0), F.col("on_cpu") / expected)
    return per.select(
        "source_key", "tid", "on_cpu", "off_cpu", (F.col("on_cpu") * 1000 / hz).alias("est_ms"),
        F.when(F.col("n") >= 3, (F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("mean_gap_ns"),
        F.col("l.leaf").alias("top_leaf"), cover.alias("coverage"),
        ((cover >= 0.6) & (F.col("on_cpu") >= 3) & F.lit(expected >= 3)).alias("pinned"))


def waker_label(waker: Column, loc: Column, workers: int = 0) -> Column:
    """io for no task or a worker's own id, else the file name of the waker's spawn location, else its hex id."""
    io = waker.isNull() | (waker == 0) | waker.between(1, workers)
    return F.when(io, "io").otherwise(F.coalesce(F.regexp_replace(loc, "^.*/", ""), F.concat(F.lit("task "), task_label(waker))))


def task_label(task: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(task)))


def task_detail(poll_rows: DataFrame, delays: DataFrame, events: DataFrame, task: int) -> DataFrame:
    """One task's polls with the wake that led to each and who caused it."""
    own = poll_rows.filter(F.col("task_id") == task)
    wakes = delays.filter(F.col("task_id") == task).select("source_key", "seq", "wake_ns", "delay_ns", "waker_task_id")
    places = events.filter(F.col("kind").isin("TaskSpawn", "PollStart")).groupBy("source_key", F.col("task_id").alias("waker_task_id")).agg(
        F.min_by("spawn_loc", F.struct(*ORDER)).alias("waker_loc"))
    rows = own.join(wakes, ["source_key", "seq"], "left").join(places, ["source_key", "waker_task_id"], "left")
    return rows.select(
        "source_key", "seq", "start_ns", "end_ns", "wake_ns", "delay_ns",
        F.when(F.col("wake_ns").isNotNull(), waker_label(F.col("waker_task_id"), F.col("waker_loc"))).alias("waker"))


def event_task(custom: DataFrame, poll_rows: DataFrame, slot=AUTO) -> DataFrame:
    """Task of a custom event: its own field, else the task polled on its worker then, else the only task polled
    anywhere in the source then.

    One sweep over a source's polls keeps the number of tasks that are being polled and the sum of their ids; where the number is one, the sum is the
    task. Polls of a worker follow each other, so its latest start decides. Both are as-of lookups: no event meets more than one
    row, however many workers its source has.
    """
    told, open_ = custom.filter(F.col("own_task").isNotNull()), custom.filter(F.col("own_task").isNull())
    polls = poll_rows.filter((F.col("start_ns") < F.col("end_ns")) & F.col("task_id").isNotNull())
    runs = polls.filter(F.col("worker_id").isNotNull()).select(
        "source_key", "worker_id", F.col("start_ns").alias("run_start"), F.col("end_ns").alias("run_end"), F.col("task_id").alias("run_task"))
    # a task that several polls hold at once counts once
    spells = merge_intervals(polls.select("source_key", "task_id", "start_ns", "end_ns"), ["source_key", "task_id"], slot)
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("n"), (F.lit(sign) * F.col("task_id").cast("decimal(38,0)")).cast("decimal(38,0)").alias("ids"))
    edges = spells.select("source_key", F.explode(F.array(edge("start_ns", 1), edge("end_ns", -1))).alias("e")).select("source_key", "e.*")
    edges = edges.groupBy("source_key", "at").agg(F.sum("n").alias("n"), F.sum("ids").cast("decimal(38,0)").alias("ids"))
    level = with_order(edges, ["source_key"], ["at"], {"open_tasks": running_sum(F.col("n")), "id_sum": running_sum(F.col("ids"))}, slot)
    at = asof(open_.select("source_key", "seq", "ts_ns", "worker_id"), runs, ["source_key", "worker_id"], "ts_ns", "run_start", ["run_end", "run_task"], slot=slot)
    at = asof(at, level, ["source_key"], "ts_ns", "at", ["open_tasks", "id_sum"], slot=slot)
    on_worker = F.when(F.col("worker_id").isNotNull() & (F.col("ts_ns") < F.col("run_end")), F.col("run_task"))
    sole = F.when(F.col("open_tasks") == 1, F.col("id_sum").cast("bigint"))
    return told.select("source_key", "seq", F.col("own_task").alias("task_id")).unionByName(
        at.select("source_key", "seq", F.coalesce(on_worker, sole).alias("task_id")))
