"""Time series, tasks and runtimes."""

from pyspark.sql import functions as F

from spoor.catalog.rebuild import ATTR, CLOSED, DELAY, OPEN, PK, W2
from spoor.catalog.registry import query
from spoor.operators import polls as poll_op, rebuild, series as op
from spoor.session import cut_lineage

T0, T1 = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000  # second week of the events


@query("queue_series", "SELECT source_key, ts_ns, sum(global_queue_depth)::bigint AS depth FROM v_metrics GROUP BY 1, 2")
def _(t):
    m = t.metrics()
    legacy = m.select("source_key", "ts_ns", F.col("global_queue_depth").alias("global_queue"))
    return op.queue_series(m, legacy)


@query("queue_extremes", "SELECT max(d)::bigint AS max_depth, round(avg(d), 6) AS mean_depth FROM (SELECT sum(global_queue_depth) AS d FROM v_metrics GROUP BY source_key, ts_ns)")
def _(t):
    return op.queue_series(t.metrics()).agg(F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("mean_depth"))


TIMELINE = """tl AS (SELECT source_key, ts_ns, seq, greatest(sum(CASE kind WHEN 'TaskSpawn' THEN 1 ELSE -1 END) OVER (PARTITION BY source_key ORDER BY ts_ns, seq), 0)::bigint AS alive
 FROM v_events WHERE kind IN ('TaskSpawn', 'TaskTerminate'))"""


@query("active_task_timeline", f"WITH {TIMELINE} SELECT * FROM tl")
def _(t):
    return op.active_task_timeline(t.events())


@query("active_task_series", "SELECT source_key, ts_ns, sum(alive_tasks)::bigint AS alive FROM v_metrics GROUP BY 1, 2")
def _(t):
    m = t.metrics()
    legacy = m.select("source_key", "ts_ns", F.col("alive_tasks").alias("active_tasks"))
    return op.active_task_series(m, legacy, op.active_task_timeline(t.events()))


@query("active_task_series_incomplete", f"""WITH {TIMELINE}, m AS (SELECT source_key, ts_ns, CASE WHEN seq % 50 <> 0 THEN alive_tasks END AS alive FROM v_metrics), ok AS (SELECT source_key FROM m GROUP BY 1 HAVING count(*) = count(alive)),
od AS (SELECT source_key, ts_ns, alive_tasks AS alive FROM v_metrics WHERE source_key LIKE 'h1%')
SELECT source_key, ts_ns, sum(alive)::bigint AS alive FROM m SEMI JOIN ok USING (source_key) GROUP BY 1, 2 UNION ALL SELECT * FROM od WHERE source_key NOT IN (SELECT source_key FROM ok)
UNION ALL SELECT source_key, ts_ns, alive FROM tl WHERE source_key NOT IN (SELECT source_key FROM ok) AND source_key NOT IN (SELECT source_key FROM od)""")
def _(t):
    """Some values are missing; one host has the old series as well."""
    m = t.metrics()
    old = m.filter(F.startswith("source_key", F.lit("h1"))).select("source_key", "ts_ns", F.col("alive_tasks").alias("active_tasks"))
    some = m.withColumn("alive_tasks", F.when(F.col("seq") % 50 != 0, F.col("alive_tasks")))
    return op.active_task_series(some, old, op.active_task_timeline(t.events()))


@query("runtime_metrics", "SELECT source_key, runtime_name, count(*) AS samples, true AS alive_available, max(alive_tasks) AS max_alive, max(global_queue_depth) AS max_queue FROM v_metrics GROUP BY 1, 2")
def _(t):
    return op.runtime_metrics(t.metrics())


def claims(workers, key):
    """Claims as segment metadata lists them, other ones in every process: worker 0 and 2 by io, 2 also by web, which comes later; in processes whose
    name ends in an odd digit only worker 1, by main; in those ending in 0 none."""
    w = workers.filter(F.col("worker_id").isNotNull()).select(key, "worker_id").distinct()
    last = F.right(key, F.lit(1))
    odd = last.isin("1", "3", "5", "7", "9")

    def claim(rows, runtime, order):
        return rows.select(key, "worker_id", F.lit(runtime).alias("runtime"), F.lit(order).alias("claim_order"))

    io = claim(w.filter(~odd & (last != "0") & F.col("worker_id").isin(0, 2)), "io", 0)
    web = claim(w.filter(~odd & (last != "0") & (F.col("worker_id") == 2)), "web", 1)
    return io.unionByName(web).unionByName(claim(w.filter(odd & (F.col("worker_id") == 1)), "main", 0))


def runtime_sql(key, table):
    """Each worker of a process with its runtime, as the claims above say."""
    odd, zero = f"right({key}, 1) IN ('1', '3', '5', '7', '9')", f"right({key}, 1) = '0'"
    return f"""w AS (SELECT DISTINCT {key}, worker_id FROM {table} WHERE worker_id IS NOT NULL),
c AS (SELECT *, CASE WHEN {odd} AND worker_id = 1 THEN 'main' WHEN NOT {odd} AND NOT {zero} AND worker_id IN (0, 2) THEN 'io' END AS claimed FROM w),
r AS (SELECT {key}, worker_id, coalesce(claimed, CASE WHEN max(coalesce(claimed, '') = 'main') OVER (PARTITION BY {key}) THEN 'main (untracked)' ELSE 'main' END) AS runtime, claimed IS NULL AS inferred FROM c)"""


@query("runtime_groups", f"WITH {runtime_sql('source_key', 'v_events')} SELECT * FROM r")
def _(t):
    return op.runtime_groups(t.events(), claims(t.events(), "source_key"))


@query("runtime_filter", f"""WITH {runtime_sql('host', 'v_samples')}, n AS (SELECT host, runtime, inferred, count(*) AS samples FROM v_samples JOIN r USING (host, worker_id) GROUP BY 1, 2, 3)
SELECT * FROM n WHERE host IN (SELECT host FROM n GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    return op.runtime_filter(t.samples(), claims(t.samples(), "host"), ("host",))


CPU = """cu AS (SELECT *, lag(ts_ns) OVER w AS pt, lag(user_cpu_ns) OVER w AS pu, lag(system_cpu_ns) OVER w AS ps FROM v_resource WINDOW w AS (PARTITION BY host ORDER BY ts_ns, seq)),
cg AS (SELECT host, pt AS start_ns, ts_ns AS end_ns, ts_ns - pt AS wall_ns, user_cpu_ns - pu + system_cpu_ns - ps AS cpu_ns, (user_cpu_ns - pu + system_cpu_ns - ps) / (ts_ns - pt) AS cores FROM cu
 WHERE ts_ns > pt AND user_cpu_ns >= pu AND system_cpu_ns >= ps)"""


@query("cpu_usage_series", f"WITH {CPU} SELECT host, start_ns, end_ns, wall_ns, cpu_ns, round(cores, 9) AS cores, round(least(100.0, cores / 4 * 100), 6) AS pct FROM cg")
def _(t):
    return op.cpu_usage(t.resource(), 4).withColumn("cores", F.round("cores", 9)).withColumn("pct", F.round("pct", 6))


@query("cpu_window_stats", f"""WITH {CPU}, o AS (SELECT *, least(end_ns, {T1}) - greatest(start_ns, {T0}) AS o FROM cg) SELECT host, round(sum(cores * o) / sum(o), 6) AS avg_cores, round(max(cores), 6) AS max_cores FROM o WHERE o > 0 GROUP BY 1""")
def _(t):
    s = op.cpu_window_stats(op.cpu_usage(t.resource(), 4), T0, T1)
    return s.select("host", *[F.round(c, 6).alias(c) for c in ("avg_cores", "max_cores")])


@query("gauge_series", "SELECT host, ts_ns, seq, k::decimal(20,0) AS value, CASE WHEN k IS NULL THEN 'missing' END AS gap FROM v_custom WHERE name = 'click'")
def _(t):
    return op.gauge_series(t.custom(), "click", "k")


@query("gauge_unit", "SELECT host, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit FROM v_custom WHERE name = 'click' GROUP BY 1")
def _(t):
    return op.field_unit(t.custom(), "click")


@query("counter_series", """WITH p AS (SELECT *, lag(ts_ns) OVER w AS pt, lag(k) OVER w AS pk FROM v_custom WHERE name = 'click' WINDOW w AS (PARTITION BY host ORDER BY ts_ns, seq))
SELECT host, seq, ts_ns AS start_ns, NULL::bigint AS end_ns, NULL::decimal(21,0) AS value, 'missing' AS gap FROM p WHERE k IS NULL
UNION ALL SELECT host, seq, ts_ns, NULL, NULL, 'reset' FROM p WHERE k < pk UNION ALL SELECT host, seq, pt, ts_ns, (k - pk)::decimal(21,0), NULL FROM p WHERE k >= pk AND ts_ns > pt""")
def _(t):
    return op.counter_series(t.custom(), "click", "k")


@query("updown_counter_series", """WITH p AS (SELECT *, lag(ts_ns) OVER w AS pt, lag(k) OVER w AS pk FROM v_custom WHERE name = 'view' WINDOW w AS (PARTITION BY host ORDER BY ts_ns, seq))
SELECT host, seq, ts_ns AS start_ns, NULL::bigint AS end_ns, NULL::decimal(21,0) AS value, 'missing' AS gap FROM p WHERE k IS NULL UNION ALL SELECT host, seq, pt, ts_ns, (k - pk)::decimal(21,0), NULL FROM p WHERE k IS NOT NULL AND pk IS NOT NULL AND ts_ns > pt""")
def _(t):
    return op.counter_series(t.custom(), "view", "k", monotonic=False)


@query("field_catalog", """WITH f AS (SELECT name, 'k' AS field, k IS NOT NULL AS num, CASE WHEN name = 'click' THEN 'gauge' WHEN name = 'view' THEN CASE WHEN seq % 2 = 0 THEN 'gauge' ELSE 'counter' END END AS kind FROM v_custom WHERE k IS NOT NULL
 UNION ALL SELECT name, 'unit', false, NULL FROM v_custom UNION ALL SELECT name, 'who', false, NULL FROM v_custom),
g AS (SELECT name, field, bool_or(num) AS numeric_seen, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS kind FROM f GROUP BY 1, 2) SELECT name, field, kind, numeric_seen FROM g WHERE kind IS NOT NULL OR numeric_seen""")
def _(t):
    kind = F.when(F.col("name") == "click", "gauge").when(F.col("name") == "view", F.when(F.col("seq") % 2 == 0, "gauge").otherwise("counter"))
    return op.field_catalog(t.custom().withColumn("kinds", F.create_map(F.lit("k"), kind)))


@query("bin_timestamps", f"SELECT least(cast(floor((ts_ns - {T0}) / {float(T1 - T0)} * 48) AS int), 47) AS bin, count(*) AS n FROM v_events WHERE ts_ns BETWEEN {T0} AND {T1} GROUP BY 1")
def _(t):
    return op.bin_timestamps(t.events(), "ts_ns", T0, T1, 48)


@query("spawn_histogram", f"SELECT least(cast(floor((ts_ns - {T0}) / {float(T1 - T0)} * 24) AS int), 23) AS bin, count(*) AS n FROM v_events WHERE kind = 'TaskSpawn' AND ts_ns BETWEEN {T0} AND {T1} GROUP BY 1")
def _(t):
    return op.bin_timestamps(t.events().filter("kind = 'TaskSpawn'"), "ts_ns", T0, T1, 24)


@query("spawn_peak", "SELECT max(c) AS peak FROM (SELECT count(*) OVER (ORDER BY ts_ns RANGE BETWEEN 3599999999999 PRECEDING AND CURRENT ROW) AS c FROM v_events WHERE kind = 'TaskSpawn')")
def _(t):
    return op.peak_per_window(t.events().filter("kind = 'TaskSpawn'"), "ts_ns", 3_600_000_000_000)


@query("step_lookup", f"""WITH {TIMELINE} SELECT p.source_key, p.seq, p.ts_ns, coalesce(tl.alive, 0) AS alive FROM (SELECT source_key, seq, ts_ns FROM v_events WHERE kind = 'PollStart') p ASOF LEFT JOIN tl ON tl.source_key = p.source_key AND tl.ts_ns <= p.ts_ns""")
def _(t):
    probes = t.events().filter("kind = 'PollStart'").select("source_key", "seq", "ts_ns")
    line = op.active_task_timeline(t.events()).withColumnRenamed("ts_ns", "at_ns")
    return op.step_lookup(probes, line, ["source_key"], "ts_ns", "at_ns", "alive")


@query("trace_range", "SELECT min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM v_events")
def _(t):
    return op.trace_range(t.events(), t.cpu(), t.resource())


@query("spawn_counts", """WITH s AS (SELECT * FROM v_events WHERE kind = 'TaskSpawn') SELECT spawn_loc, count(*) AS spawned,
 count(*) FILTER ((source_key, task_id) NOT IN (SELECT (source_key, task_id) FROM v_events WHERE kind = 'TaskTerminate')) AS alive FROM s GROUP BY 1""")
def _(t):
    return op.spawn_counts(t.events())


@query("spawned_in_range", f"""WITH {CLOSED}, f AS (SELECT source_key, task_id, min(start_ns) AS s, arg_min(spawn_loc, start_ns) AS spawn_loc FROM polls GROUP BY 1, 2) SELECT spawn_loc, count(*) AS tasks FROM f WHERE s BETWEEN {T0} AND {T1} GROUP BY 1""")
def _(t):
    return op.spawned_in_range(rebuild.polls(t.events()), T0, T1)


QUANT = """SELECT source_key, len(l) AS n, l[1] AS min, l[1 + len(l) // 2] AS p50, l[1 + len(l) * 90 // 100] AS p90, l[1 + len(l) * 99 // 100] AS p99, l[len(l)] AS max FROM (SELECT source_key, list(duration_ns ORDER BY duration_ns) AS l FROM v_polls GROUP BY 1)"""


@query("segment_quantiles", QUANT)
def _(t):
    return op.segment_quantiles(t.polls(), ["source_key"], "duration_ns")


@query("segment_span_quantiles", QUANT.replace("v_polls", "v_spans").replace("duration_ns", "elapsed_ns"))
def _(t):
    return op.segment_quantiles(t.spans(), ["source_key"], "elapsed_ns")


@query("segment_shape", "SELECT source_key, count(*) AS polls, count(DISTINCT worker_id) AS workers, count(DISTINCT task_id) AS tasks FROM v_polls GROUP BY 1")
def _(t):
    return t.polls().groupBy("source_key").agg(F.count(F.lit(1)).alias("polls"), F.countDistinct("worker_id").alias("workers"), F.countDistinct("task_id").alias("tasks"))


@query("event_type_counts", "SELECT source_key, kind, count(*) AS n FROM v_events GROUP BY 1, 2")
def _(t):
    return t.events().groupBy("source_key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("blocking_view", f"""WITH {ATTR}, b AS (SELECT *, frames[1] AS leaf FROM attr WHERE source = 1 AND poll_seq IS NOT NULL), n AS (SELECT leaf, count(*) AS n, count(DISTINCT array_to_string(frames, ';')) AS stacks FROM b GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY t, sample_id) AS rn FROM b)
SELECT leaf, n, stacks, floor(n / (SELECT count(*) FROM b) * 1000 + 0.5) / 10 AS pct, (SELECT array_to_string(list(poll_seq ORDER BY rn), ',') FROM r WHERE r.leaf = n.leaf AND rn <= 5) AS examples FROM n""")
def _(t):
    return op.blocking_view(cut_lineage(rebuild.attribute_samples(t.cpu(), t.events())))


SPAN_NS = T1 - T0


@query("tid_census", f"""WITH s AS (SELECT *, frames[1] AS leaf FROM v_cpu WHERE t BETWEEN {T0} AND {T1}), lf AS (SELECT source_key, tid, leaf, count(*) AS n FROM s GROUP BY 1, 2, 3),
tp AS (SELECT source_key, tid, leaf FROM (SELECT *, row_number() OVER (PARTITION BY source_key, tid ORDER BY n DESC, leaf) AS rn FROM lf) WHERE rn = 1),
p AS (SELECT source_key, tid, count(*) AS n, count(*) FILTER (source = 0) AS on_cpu, count(*) FILTER (source = 1) AS off_cpu, min(t) AS a, max(t) AS b FROM s GROUP BY 1, 2)
SELECT source_key, tid, on_cpu, off_cpu, round(on_cpu * 1000 / 0.0001, 3) AS est_ms, round(CASE WHEN n >= 3 THEN (b - a) / (n - 1) END, 0) AS mean_gap_ns, leaf AS top_leaf, round(least(1.0, on_cpu / ({SPAN_NS} / 1e9 * 0.0001)), 6) AS coverage,
 on_cpu / ({SPAN_NS} / 1e9 * 0.0001) >= 0.6 AND on_cpu >= 3 AS pinned FROM p LEFT JOIN tp USING (source_key, tid)""")
def _(t):
    c = op.tid_census(t.cpu(), T0, T1, 0.0001)
    return c.withColumn("est_ms", F.round("est_ms", 3)).withColumn("mean_gap_ns", F.round("mean_gap_ns", 0)).withColumn("coverage", F.round("coverage", 6))


@query("task_detail", f"""WITH {W2.replace("start_ns - eff > 0", "start_ns - eff >= 0")}, pl AS (SELECT source_key, task_id, arg_min(spawn_loc, ts_ns) AS loc FROM v_events WHERE kind IN ('TaskSpawn', 'PollStart') GROUP BY 1, 2)
SELECT p.source_key, p.seq, p.start_ns, p.end_ns, s.wake_ns, s.delay_ns, CASE WHEN s.wake_ns IS NOT NULL THEN CASE WHEN s.waker_task_id = 0 THEN 'io' ELSE coalesce(loc, concat('task 0x', lower(to_hex(s.waker_task_id)))) END END AS waker
FROM po p LEFT JOIN sd s ON s.source_key = p.source_key AND s.seq = p.seq LEFT JOIN pl ON pl.source_key = p.source_key AND pl.task_id = s.waker_task_id WHERE p.task_id = 21""")
def _(t):
    e = t.events()
    polls = cut_lineage(rebuild.polls_open_ended(e))
    return op.task_detail(polls, rebuild.sched_delays(e, polls, DELAY, allow_zero=True), e, 21)


@query("event_task", f"""WITH {CLOSED}, c AS (SELECT source_key, seq, ts_ns, worker_id, CASE WHEN seq % 3 = 0 THEN task_id END AS own FROM v_custom),
h AS (SELECT c.seq, max(CASE WHEN p.worker_id = c.worker_id THEN p.task_id END) AS onw, CASE WHEN min(p.task_id) = max(p.task_id) THEN min(p.task_id) END AS sole FROM c JOIN polls p ON p.source_key = c.source_key AND p.start_ns <= c.ts_ns AND c.ts_ns < p.end_ns GROUP BY 1)
SELECT c.source_key, c.seq, coalesce(own, onw, sole) AS task_id FROM c LEFT JOIN h USING (seq)""")
def _(t):
    c = t.custom().select("source_key", "seq", "ts_ns", "worker_id", F.when(F.col("seq") % 3 == 0, F.col("task_id")).alias("own_task"))
    return op.event_task(c, cut_lineage(rebuild.polls(t.events())))


TOTALS = PK + ", " + OPEN.replace("life AS", "life2 AS").replace("FROM life", "FROM life2")


@query("analyzer_totals", f"""WITH {TOTALS}, ac AS (SELECT worker_id, sum(nt - ts_ns) AS active, sum(CASE WHEN nt > ts_ns THEN least((nc - cpu_time_ns) / (nt - ts_ns), 1.0) ELSE 1.0 END) / count(*) AS ratio FROM pk WHERE kind = 'WorkerUnpark' AND nk = 'WorkerPark' GROUP BY 1),
pa AS (SELECT worker_id, sum(nt - ts_ns) AS parked FROM pk WHERE kind = 'WorkerPark' AND nk = 'WorkerUnpark' GROUP BY 1), pc AS (SELECT worker_id, count(*) AS polls, count(*) FILTER (end_ns - start_ns > 1000000) AS long_polls FROM po GROUP BY 1)
SELECT worker_id, round(active / (active + parked), 6) AS utilisation, round(ratio, 6) AS mean_cpu_ratio, polls, long_polls FROM ac JOIN pa USING (worker_id) JOIN pc USING (worker_id)""")
def _(t):
    e = t.events()
    slot = rebuild.time_slot(e)
    length = F.col("end_ns") - F.col("start_ns")
    active = rebuild.active_periods(e, slot=slot).groupBy("worker_id").agg(F.sum(length).alias("active"), F.avg("ratio").alias("ratio"))
    parked = rebuild.parks(e, slot, woken=True).groupBy("worker_id").agg(F.sum(length).alias("parked"))
    polls = rebuild.polls_open_ended(e, slot).groupBy("worker_id").agg(F.count(F.lit(1)).alias("polls"), F.count_if(length > 1_000_000).alias("long_polls"))
    return active.join(parked, "worker_id").join(polls, "worker_id").select(
        "worker_id", F.round(F.col("active") / (F.col("active") + F.col("parked")), 6).alias("utilisation"), F.round("ratio", 6).alias("mean_cpu_ratio"), "polls", "long_polls")


@query("analyzer_durations", f"""WITH {W2}, du AS (SELECT source_key, 'poll' AS what, end_ns - start_ns AS ns FROM po UNION ALL SELECT source_key, 'delay', delay_ns FROM sd UNION ALL SELECT source_key, 'span', elapsed_ns FROM v_spans),
li AS (SELECT source_key, what, count(*) AS n, list(ns ORDER BY ns) AS l FROM du GROUP BY 1, 2)
SELECT source_key, what, n, l[1] AS min, l[1 + least(n * 50 // 100, n - 1)] AS p50, l[1 + least(n * 90 // 100, n - 1)] AS p90, l[1 + least(n * 99 // 100, n - 1)] AS p99, l[n] AS max FROM li""")
def _(t):
    e = t.events()
    polls = rebuild.polls_open_ended(e).select("source_key", (F.col("end_ns") - F.col("start_ns")).alias("ns"))
    delays = rebuild.sched_delays(e, max_delay_ns=DELAY).select("source_key", F.col("delay_ns").alias("ns"))
    return op.duration_summary({"poll": polls, "delay": delays, "span": t.spans().select("source_key", F.col("elapsed_ns").alias("ns"))})
