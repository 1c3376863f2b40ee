"""Health checks. Each returns rows (check, severity, subject, value); their union is one report.

``subject`` names what the finding is about, ``value`` is the number the rule compared, as a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.operators import rebuild
from spoor.operators.rebuild import LANE
from spoor.plans.interval_join import point_in_intervals
from spoor.plans.ranks import order_statistics
from spoor.plans.timeline import AUTO, asof
from spoor.session import cut_lineage

MS = 1_000_000


def finding(df: DataFrame, check: str, severity: Column | str, subject: Column, value: Column) -> DataFrame:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(F.lit(check).alias("check"), level.alias("severity"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))


def incomplete_file(metadata: DataFrame) -> DataFrame:
    """Sources whose metadata says they were sealed with events missing."""
    bad = metadata.filter(F.col("metadata")["segment.complete"] == "false")
    return finding(bad, "incomplete-file", "warning", F.col("source_key"), F.lit(1))


def long_poll(polls: DataFrame, worst: int = 5) -> DataFrame:
    """Polls over 50 ms (critical) or 10 ms (warning): the worst of each tier and a row with the tier's size."""
    dur = F.col("end_ns") - F.col("start_ns")
    tiered = polls.withColumn("dur", dur).withColumn(
        "severity", F.when(dur > 50 * MS, "critical").when(dur > 10 * MS, "warning")).filter(F.col("severity").isNotNull())
    order = Window.partitionBy("severity").orderBy(F.desc("dur"), "start_ns", "host", "worker_id", "task_id")
    top = tiered.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= worst)
    rollup = tiered.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    subject = F.concat_ws("/", "host", F.col("worker_id").cast("string"), F.col("task_id").cast("string"), F.col("start_ns").cast("string"))
    return finding(top, "long-poll", F.col("severity"), subject, F.col("dur")).unionByName(
        finding(rollup, "long-poll", F.col("severity"), F.lit("total"), F.col("n")))


def task_leak(alive: DataFrame, keys=("source_key",)) -> DataFrame:
    """More than ten samples, the last over twice the first and equal to the peak."""
    pos = F.struct("ts_ns", "seq")
    per = alive.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("alive", pos).alias("first"), F.max_by("alive", pos).alias("last"), F.max("alive").alias("peak"))
    bad = per.filter((F.col("n") > 10) & (F.col("last") > F.col("first") * 2) & (F.col("last") == F.col("peak")))
    return finding(bad, "task-leak", "warning", F.concat_ws("/", *keys), F.col("last"))


def sched_delay(delays: DataFrame, floor_ns: int = 5 * MS, critical_ns: int = 50 * MS) -> DataFrame:
    """Scheduling delays above the floor per source, critical by the worst of them."""
    per = delays.filter(F.col("delay_ns") > floor_ns).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.max("delay_ns").alias("worst"))
    return finding(per, "sched-delay", F.when(F.col("worst") > critical_ns, "critical").otherwise("warning"), F.col("source_key"), F.col("n"))


def blocking_calls(samples: DataFrame, floor: int = 5) -> DataFrame:
    """The commonest scheduler-sample stack of each source, when seen more than ``floor`` times."""
    groups = samples.filter(F.col("source") == 1).groupBy("source_key", F.array_join("frames", ";").alias("stack")).agg(F.count(F.lit(1)).alias("n"))
    top = groups.groupBy("source_key").agg(F.min(F.struct((-F.col("n")).alias("c"), "stack")).alias("t"))
    return finding(top.filter(-F.col("t.c") > floor), "blocking-calls", "warning", F.concat_ws(" ", "source_key", F.col("t.stack")), -F.col("t.c"))


def queue_depth(queue: DataFrame, high: int = 100, critical: int = 1000, keys=("source_key",)) -> DataFrame:
    """Global queue of a process over ``high``: how many samples, severity by the deepest."""
    over = queue.groupBy(*keys).agg(F.count_if(F.col("depth") > high).alias("n"), F.max("depth").alias("deepest")).filter(F.col("n") > 0)
    return finding(over, "queue-depth", F.when(F.col("deepest") > critical, "critical").otherwise("warning"), F.concat_ws(" ", *keys, F.col("deepest").cast("string")), F.col("n"))


def worker_imbalance(polls: DataFrame, key: str = "source_key", factor: float = 3) -> DataFrame:
    """Busiest worker with over three times the polls of the least busy one (which must have some)."""
    counts = polls.groupBy(key, "worker_id").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(key).agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    bad = per.filter((F.col("w") > 1) & (F.col("lo") > 0) & (F.col("hi") > F.col("lo") * factor))
    return finding(bad, "worker-imbalance", "info", F.col(key), F.col("hi") / F.col("lo"))


def cpu_contention(active: DataFrame) -> DataFrame:
    """Workers with over ten active periods of which more than a tenth, over 1 ms each, ran under half on CPU."""
    low = (F.col("ratio") < 0.5) & (F.col("end_ns") - F.col("start_ns") > MS)
    per = active.groupBy(*LANE).agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low"))
    bad = per.filter((F.col("n") > 10) & (F.col("low") > F.col("n") * 0.1))
    return finding(bad, "cpu-contention", "warning", F.concat_ws("/", "source_key", F.col("worker_id").cast("string")), F.col("low"))


def kernel_sched_wait(parks: DataFrame) -> DataFrame:
    """Unparks that waited over 1 ms for a CPU, per worker; a warning when the worst is over 10 ms."""
    per = parks.filter(F.col("sched_wait_ns") > MS).groupBy(*LANE).agg(F.count(F.lit(1)).alias("n"), F.max("sched_wait_ns").alias("worst"))
    return finding(per, "kernel-sched-wait", F.when(F.col("worst") > 10 * MS, "warning").otherwise("info"),
                   F.concat_ws("/", "source_key", F.col("worker_id").cast("string")), F.col("n"))


def many_spans_per_poll(inside: DataFrame, floor: int = 20) -> DataFrame:
    per = inside.groupBy("source_key", "poll_seq").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor)
    return finding(per, "many-spans-per-poll", "warning", F.concat_ws("/", "source_key", F.col("poll_seq").cast("string")), F.col("n"))


def span_outlier(spans: DataFrame, factor: float = 10, peers: int = 10, slot=AUTO) -> DataFrame:
    """Spans longer than ``factor`` times the middle duration of their name, for names with enough spans."""
    middle = order_statistics(spans, ["name"], "elapsed_ns", {"p50": lambda n: F.floor(n * 0.5)}, slot).filter(F.col("n") >= peers)
    per = spans.join(middle.drop("n"), "name").filter(F.col("elapsed_ns") > F.col("p50") * factor).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return finding(per, "span-duration-outlier", "info", F.col("name"), F.col("n"))


def unmatched_spans(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Enters without an exit, by span name; ``names`` maps an enter to its name."""
    lost = pairs.filter(F.col("state") == "unmatched_enter").join(names, ["source_key", "enter_seq"]).groupBy("span_name").agg(F.count(F.lit(1)).alias("n"))
    return finding(lost, "unmatched-spans", "info", F.col("span_name"), F.col("n"))


def idle_worker(parks: DataFrame, queue: DataFrame, floor_ns: int = MS, slot=AUTO) -> DataFrame:
    """Workers parked for long while tasks were queued when they woke."""
    slept = parks.filter(F.col("end_ns") - F.col("start_ns") > floor_ns)
    depth = queue.select("source_key", "ts_ns", "depth")
    hit = asof(slept, depth, ["source_key"], "end_ns", "ts_ns", ["depth"], slot=slot).filter(F.col("depth") > 0)
    return finding(hit, "idle-worker", "warning", F.concat_ws("/", "source_key", F.col("worker_id").cast("string"), F.col("start_ns").cast("string")), F.col("depth"))


def wake_delay(delays: DataFrame, floor_ns: int) -> DataFrame:
    return finding(delays.filter(F.col("delay_ns") >= floor_ns), "wake-delay", "warning", F.concat_ws("/", "source_key", F.col("seq").cast("string")), F.col("delay_ns"))


def setup_checks(events: DataFrame, samples: DataFrame, symbols: DataFrame, metadata: DataFrame) -> DataFrame:
    """How each source was recorded: frame pointers, wake events, symbols, scheduler events, task polls, and the unstable flag
    (``metadata``: source_key and a map). One finding a source and fault, so a healthy process hides no other; all tables carry source_key."""
    key, on = "source_key", F.col("source") == 0
    unstable = F.coalesce(F.col("metadata")["unstable"], F.lit("false")) == "true"
    per_source = [
        events.groupBy(key).agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("TaskSpawn", "spawns"), ("Wake", "wakes"), ("WorkerUnpark", "unparks"), ("PollStart", "polls"))]),
        samples.groupBy(key).agg(F.count_if(on).alias("on"), F.count_if(~on).alias("off"), F.avg(F.when(on, F.size("frames"))).alias("depth")),
        samples.filter(on).select(key, F.explode("frames").alias("a")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("addrs")),
        symbols.groupBy(key).agg(F.count(F.lit(1)).alias("known"), F.count_if(F.coalesce("location", F.lit("")) != "").alias("placed")),
        metadata.groupBy(key).agg(F.count_if(unstable).alias("flagged"), F.count_if(~unstable).alias("unflagged"))]
    stacked = per_source[0]
    for more in per_source[1:]:
        stacked = stacked.unionByName(more, allowMissingColumns=True)
    counts = [c for c in stacked.columns if c not in (key, "depth")]
    facts = stacked.groupBy(key).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.max("depth").alias("depth"))
    thin = (F.col("known") == 0) | ((F.col("known") / F.col("addrs") < 0.1) & (F.col("placed") == 0))

    def fault(where, check: str, severity: str, value: str) -> DataFrame:
        return finding(facts.filter(where), check, severity, F.col(key), F.col(value))

    pointers = fault((F.col("on") > 10) & (F.col("depth") < 3), "missing-frame-pointers", "critical", "depth")
    wakes = fault((F.col("spawns") > 0) & (F.col("wakes") == 0), "missing-wake-events", "warning", "spawns")
    names = fault((F.col("on") > 10) & (F.col("addrs") > 0) & thin, "missing-debug-symbols", "warning", "known")
    sched = fault((F.col("on") > 0) & (F.col("off") == 0), "no-scheduling-events", "info", "on")
    flag = fault(F.col("unflagged") > 0, "no-unstable-flag", "warning", "unflagged")
    idle = fault((F.col("flagged") > 0) & (F.col("unparks") > 10) & (F.col("polls") == 0), "no-task-polls", "warning", "unparks")
    out = pointers
    for more in (wakes, names, sched, flag, idle):
        out = out.unionByName(more)
    return out


def diagnose_long_polls(polls: DataFrame, attributed: DataFrame, samples: DataFrame, hz: float, top: int = 1, multiple: float = 3,
                        floor_ns: int = MS, percentile: float = 0.99, slot=AUTO) -> DataFrame:
    """The longest polls over max(floor, multiple x p99): on or off CPU, who else ran then, and in how many other
    long polls the suspect's leaf ran too.

    The suspect is the thread with most on-CPU samples inside the poll; it is trusted from three expected samples
    and 0.6 coverage on, below that its columns are null.
    """
    dur = F.col("end_ns") - F.col("start_ns")
    sized = polls.withColumn("duration_ns", dur)
    pick = order_statistics(sized, [], "duration_ns", {"p": lambda n: F.least(n - 1, F.floor(n * percentile))}, slot)
    limit = F.greatest(F.lit(float(floor_ns)), pick.select("p").scalar() * multiple)
    longs = cut_lineage(sized.filter(F.col("duration_ns") >= limit).select("source_key", F.col("seq").alias("poll_seq"), "task_id", "start_ns", "end_ns", "duration_ns"))
    best = longs.orderBy(F.desc("duration_ns"), "start_ns", "poll_seq", "source_key").limit(top)
    counts = rebuild.poll_sample_counts(attributed)
    ran = samples.filter(F.col("source") != 1).select("source_key", "tid", "t", "frames")
    near = point_in_intervals(ran, best, ["source_key"], "t", "start_ns", "end_ns", closed=True)
    poll = ["source_key", "poll_seq"]
    cells = near.groupBy(*poll, "duration_ns", "tid", F.get("frames", F.lit(0)).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    threads = cells.groupBy(*poll, "duration_ns", "tid").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("c"), "leaf")).alias("l"))
    suspect = threads.groupBy(*poll, "duration_ns").agg(
        F.min(F.struct((-F.col("n")).alias("c"), "tid", F.col("l.leaf").alias("leaf"))).alias("s"))
    expected = F.col("duration_ns") / 1e9 * hz
    cover = F.least(F.lit(1.0), -F.col("s.c") / expected)
    named = suspect.filter((expected >= 3) & (cover >= 0.6) & (-F.col("s.c") >= 3)).select(
        *poll, F.col("s.tid").alias("suspect_tid"), (-F.col("s.c")).alias("suspect_samples"), F.col("s.leaf").alias("suspect_leaf"))
    # only frames that are some suspect's leaf are followed into the other polls
    leaves = named.select("suspect_leaf").distinct()
    shown = ran.withColumn("suspect_leaf", F.explode(F.array_distinct("frames"))).join(leaves, "suspect_leaf", "left_semi")
    seen = point_in_intervals(shown, longs, ["source_key"], "t", "start_ns", "end_ns", closed=True).select(
        F.col("source_key").alias("other_source"), F.col("poll_seq").alias("other_seq"), "suspect_leaf").distinct()
    another = (F.col("other_seq") != F.col("poll_seq")) | (F.col("other_source") != F.col("source_key"))
    co = named.join(seen, "suspect_leaf").filter(another).groupBy(*poll).agg(F.count(F.lit(1)).alias("coincided"))
    others = longs.agg(F.count(F.lit(1)) - 1).scalar()
    rows = best.join(counts, ["source_key", "poll_seq"], "left").fillna(0, ["cpu_samples", "sched_samples"]).join(named, poll, "left").join(co, poll, "left")
    off = F.col("cpu_samples") == 0  # a poll that ran on a CPU needs no suspect
    found = off & F.col("suspect_tid").isNotNull()
    return rows.select(
        "source_key", "poll_seq", "task_id", "duration_ns", F.when(off, "off_cpu").otherwise("on_cpu").alias("class"),
        "cpu_samples", "sched_samples", *[F.when(off, F.col(c)).alias(c) for c in ("suspect_tid", "suspect_samples", "suspect_leaf")],
        F.when(found, F.coalesce("coincided", F.lit(0))).alias("coincided"), others.alias("others"))


def zoom_window(polls: DataFrame, samples: DataFrame, queue: DataFrame, spans: DataFrame, center_ns: int, half_ns: int) -> DataFrame:
    """Everything around an instant: polls, busy time per worker, threads on CPU, queue extremes, and the spans
    inside the longest poll. Rows (section, subject, value)."""
    lo, hi = center_ns - half_ns, center_ns + half_ns

    def rows(df, section, subject, value):
        return df.select(F.lit(section).alias("section"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))

    near = polls.filter((F.col("end_ns") >= lo) & (F.col("start_ns") <= hi)).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
    clipped = F.least("end_ns", F.lit(hi)) - F.greatest("start_ns", F.lit(lo))
    busy = near.groupBy("source_key", "worker_id").agg(F.sum(clipped).alias("busy"))
    inside = samples.filter(F.col("t").between(lo, hi)).groupBy("source_key", "tid").agg(F.count_if(F.col("source") != 1).alias("on"))
    depth = queue.filter(F.col("ts_ns").between(lo, hi)).groupBy("source_key").agg(F.max("depth").alias("hi"), F.min("depth").alias("lo"))
    top = near.filter(F.col("duration_ns") > MS).orderBy(F.desc("duration_ns"), "start_ns", "seq").limit(1)
    runs = F.broadcast(top.select("source_key", "worker_id", F.col("start_ns").alias("a"), F.col("end_ns").alias("b")))  # one row
    inner = spans.join(runs, ["source_key", "worker_id"]).filter((F.col("start_ns") >= F.col("a")) & (F.col("end_ns") <= F.col("b"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    out = rows(near, "poll", F.concat_ws("/", "source_key", F.col("seq").cast("string")), F.col("duration_ns"))
    for more in (
        rows(busy, "busy", F.concat_ws("/", "source_key", F.col("worker_id").cast("string")), F.col("busy")),
        rows(inside, "thread", F.concat_ws("/", "source_key", F.col("tid").cast("string")), F.col("on")),
        rows(depth, "queue", F.concat_ws("/", "source_key", F.lit("max")), F.col("hi")), rows(depth, "queue", F.concat_ws("/", "source_key", F.lit("min")), F.col("lo")),
        rows(inner, "span", F.col("name"), F.col("n"))):
        out = out.unionByName(more)
    return out


def report(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more)
    return out
