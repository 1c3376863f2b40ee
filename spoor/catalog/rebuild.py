"""Intervals rebuilt from the event stream."""

from pyspark.sql import functions as F

from spoor.catalog.registry import query
from spoor.operators import rebuild as op
from spoor.plans.timeline import asof

DELAY = 6 * 3_600_000_000_000  # the events are minutes apart

LANE = "PARTITION BY source_key, worker_id ORDER BY ts_ns, seq"
TASKW = "PARTITION BY source_key, task_id ORDER BY ts_ns, seq"
LIFE = f"""life AS (SELECT *, lead(kind) OVER w AS nk, lead(ts_ns) OVER w AS nt, lead(seq) OVER w AS ns FROM v_events
  WHERE kind IN ('PollStart', 'PollEnd', 'WorkerPark', 'WorkerUnpark') WINDOW w AS ({LANE}))"""
CLOSED = LIFE + f""", st AS (SELECT *, lead(worker_id) OVER w AS mw, lead(ts_ns) OVER w AS mt, lead(seq) OVER w AS ms FROM life
  WHERE kind = 'PollStart' WINDOW w AS ({TASKW})),
closed AS (SELECT *, coalesce(mw <> worker_id AND (nt IS NULL OR (mt, ms) < (nt, ns)), false) AS moved FROM st),
starts AS (SELECT source_key, worker_id, task_id, spawn_loc, seq, ts_ns AS start_ns, CASE WHEN moved THEN 'Migrated' ELSE nk END AS closed_by,
  CASE WHEN moved THEN mt ELSE nt END AS end_ns, CASE WHEN moved THEN ms ELSE ns END AS end_seq FROM closed),
polls AS (SELECT source_key, worker_id, task_id, spawn_loc, seq, start_ns, end_ns, end_ns - start_ns AS duration_ns, closed_by = 'PollEnd' AS explicit_end
  FROM starts WHERE closed_by IN ('PollEnd', 'WorkerPark'))"""
OPEN = LIFE + """, po AS (SELECT source_key, worker_id, task_id, spawn_loc, seq, ts_ns AS start_ns, nt AS end_ns, nk <> 'PollEnd' AS open_ended
  FROM life WHERE kind = 'PollStart' AND nk IN ('PollEnd', 'PollStart', 'WorkerPark'))"""
PK = f"""pk AS (SELECT *, lead(kind) OVER w AS nk, lead(ts_ns) OVER w AS nt, lead(cpu_time_ns) OVER w AS nc, lead(sched_wait_ns) OVER w AS nw, lead(tid) OVER w AS ntid
  FROM v_events WHERE kind IN ('WorkerPark', 'WorkerUnpark') WINDOW w AS ({LANE}))"""
GAPS = PK + """, gaps AS (SELECT source_key, worker_id, seq, tid AS from_tid, ntid AS to_tid, ts_ns AS start_ns, nt AS end_ns FROM pk WHERE nt IS NOT NULL AND tid <> ntid)"""
BIND = """bind AS (SELECT source_key, tid, ts_ns AS from_ns, seq, worker_id FROM (SELECT *, lag(worker_id) OVER (PARTITION BY source_key, tid ORDER BY ts_ns, seq) AS was
  FROM v_events WHERE kind IN ('WorkerPark', 'WorkerUnpark')) WHERE was IS NULL OR was <> worker_id)"""
ATTR = CLOSED + ", " + GAPS + ", " + BIND + """,
bound AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM gaps g WHERE g.source_key = c.source_key AND (g.from_tid = c.tid OR g.to_tid = c.tid) AND g.start_ns <= c.t AND c.t < g.end_ns)
   THEN NULL ELSE b.worker_id END AS worker_id FROM v_cpu c ASOF LEFT JOIN bind b ON b.source_key = c.source_key AND b.tid = c.tid AND b.from_ns <= c.t),
attr AS (SELECT b.*, p.seq AS poll_seq, p.start_ns AS poll_start, p.end_ns AS poll_end, p.task_id AS poll_task, p.spawn_loc AS poll_loc FROM bound b LEFT JOIN polls p
   ON p.source_key = b.source_key AND p.worker_id = b.worker_id AND p.start_ns <= b.t AND b.t < p.end_ns)"""


@query("polls", f"WITH {CLOSED} SELECT * FROM polls")
def _(t):
    return op.polls(t.events())


@query("polls_unproven", f"WITH {CLOSED} SELECT source_key, count(*) AS end_unproven FROM starts WHERE closed_by IN ('Migrated', 'PollStart', 'WorkerUnpark') GROUP BY 1")
def _(t):
    return op.unproven_ends(t.events())


@query("polls_open_ended", f"WITH {OPEN} SELECT * FROM po")
def _(t):
    return op.polls_open_ended(t.events())


@query("parks", f"""WITH {PK} SELECT source_key, worker_id, seq, ts_ns AS start_ns, coalesce(nt, m) AS end_ns, nw AS sched_wait_ns
FROM pk JOIN (SELECT source_key, max(ts_ns) AS m FROM v_events GROUP BY 1) USING (source_key) WHERE kind = 'WorkerPark' AND (nk IS NULL OR nk = 'WorkerUnpark')""")
def _(t):
    return op.parks(t.events())


ACTIVE = """SELECT source_key, worker_id, seq, ts_ns AS start_ns, nt AS end_ns, nc - cpu_time_ns AS cpu_delta_ns,
 round(CASE WHEN nt > ts_ns THEN least((nc - cpu_time_ns) / (nt - ts_ns), 1.0) ELSE 1.0 END, 9) AS ratio FROM pk WHERE kind = 'WorkerUnpark' AND nk = 'WorkerPark'"""


@query("active_periods", f"WITH {PK} {ACTIVE}")
def _(t):
    return op.active_periods(t.events()).withColumn("ratio", F.round("ratio", 9))


@query("active_periods_gap_safe", f"""WITH {GAPS}, a AS ({ACTIVE}) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source_key = a.source_key
 AND g.worker_id = a.worker_id AND g.start_ns < a.end_ns AND g.end_ns > a.start_ns)""")
def _(t):
    return op.active_periods(t.events(), gap_safe=True).withColumn("ratio", F.round("ratio", 9))


@query("tid_bindings", f"WITH {BIND} SELECT * FROM bind")
def _(t):
    return op.tid_bindings(t.events())


@query("handoff_gaps", f"WITH {GAPS} SELECT * FROM gaps")
def _(t):
    return op.handoff_gaps(t.events())


@query("merge_intervals", f"""WITH {GAPS}, both_t AS (SELECT source_key, from_tid AS tid, start_ns, end_ns FROM gaps UNION ALL SELECT source_key, to_tid, start_ns, end_ns FROM gaps),
f AS (SELECT *, max(end_ns) OVER (PARTITION BY source_key, tid ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM both_t),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ns > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, tid ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS isl FROM f)
SELECT source_key, tid, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM i GROUP BY source_key, tid, isl""")
def _(t):
    return op.thread_gaps(op.handoff_gaps(t.events()))


READY = CLOSED + """, pv AS (SELECT *, lag(start_ns) OVER w AS s0, lag(seq) OVER w AS s0q, lag(end_ns) OVER w AS c, lag(end_seq) OVER w AS cq, lag(closed_by) OVER w = 'PollEnd' AS explicit
  FROM starts WINDOW w AS (PARTITION BY source_key, task_id ORDER BY start_ns, seq)),
ev AS (SELECT p.source_key, p.seq AS pseq, e.ts_ns, e.seq, e.kind, e.waker_task_id, p.c, p.cq, p.s0 FROM pv p JOIN v_events e ON e.source_key = p.source_key AND e.task_id = p.task_id
  AND e.kind IN ('TaskSpawn', 'TaskTerminate', 'Wake') AND (e.ts_ns, e.seq) < (p.start_ns, p.seq) AND (p.s0 IS NULL OR (e.ts_ns, e.seq) > (p.s0, p.s0q))),
fx AS (SELECT source_key, pseq, max(ts_ns) FILTER (kind <> 'Wake') AS lt, arg_max(kind, ts_ns) FILTER (kind <> 'Wake') AS lk, min(ts_ns) FILTER (kind <> 'Wake') AS ft,
  min(ts_ns) FILTER (kind = 'Wake' AND s0 IS NOT NULL AND (c IS NULL OR ts_ns < c)) AS wm, arg_min(waker_task_id, ts_ns) FILTER (kind = 'Wake' AND s0 IS NOT NULL AND (c IS NULL OR ts_ns < c)) AS wmw,
  min(ts_ns) FILTER (kind = 'Wake' AND (s0 IS NULL OR ts_ns > c)) AS w1, arg_min(waker_task_id, ts_ns) FILTER (kind = 'Wake' AND (s0 IS NULL OR ts_ns > c)) AS w1w FROM ev GROUP BY 1, 2),
vd AS (SELECT p.*, lt, lk, wm, wmw, w1, w1w, coalesce(explicit AND wm IS NOT NULL AND (ft IS NULL OR wm < ft), false) AS mid FROM pv p LEFT JOIN fx ON fx.source_key = p.source_key AND fx.pseq = p.seq),
vk AS (SELECT *, CASE WHEN lk = 'TaskTerminate' THEN -1 WHEN lk = 'TaskSpawn' AND (c IS NULL OR lt > c OR NOT mid) THEN 0 WHEN mid THEN 2 WHEN w1 IS NOT NULL THEN 1 ELSE -1 END AS k FROM vd),
rd AS (SELECT *, CASE k WHEN 0 THEN lt WHEN 2 THEN c WHEN 1 THEN w1 END AS ready FROM vk WHERE closed_by IN ('PollEnd', 'WorkerPark')),
readiness AS (SELECT source_key, worker_id, task_id, spawn_loc, seq, start_ns, end_ns, CASE WHEN ready <= start_ns THEN ready END AS ready_at_ns,
  CASE WHEN ready <= start_ns THEN start_ns - ready END AS scheduling_delay_ns, CASE WHEN ready <= start_ns THEN k END AS scheduling_delay_kind,
  CASE WHEN ready <= start_ns THEN CASE k WHEN 2 THEN wmw WHEN 1 THEN w1w END END AS waker_task_id FROM rd)"""


@query("readiness", f"WITH {READY} SELECT * FROM readiness")
def _(t):
    return op.readiness(t.events())


@query("asof_last", """SELECT p.source_key, p.task_id, p.seq, p.ts_ns, w.ts_ns AS wake_ns, w.waker_task_id AS waker FROM (SELECT * FROM v_events WHERE kind = 'PollStart') p
ASOF LEFT JOIN (SELECT * FROM v_events WHERE kind = 'Wake') w ON p.source_key = w.source_key AND p.task_id = w.task_id AND w.ts_ns <= p.ts_ns""")
def _(t):
    e = t.events()
    left = e.filter(F.col("kind") == "PollStart").select("source_key", "task_id", "seq", "ts_ns")
    right = e.filter(F.col("kind") == "Wake").select(
        "source_key", "task_id", F.col("ts_ns").alias("wake_ns"), "seq", F.col("waker_task_id").alias("waker"))
    return asof(left, right, ["source_key", "task_id"], "ts_ns", "wake_ns", ["wake_ns", "waker"], right_tie=["seq"])


@query("nearest_by_t", """WITH l AS (SELECT source_key, seq, ts_ns FROM v_events WHERE kind = 'PollStart'), r AS (SELECT source_key, seq AS wseq, ts_ns AS t FROM v_events WHERE kind = 'Wake'),
j AS (SELECT l.*, r.t AS near_t, r.wseq, row_number() OVER (PARTITION BY l.seq ORDER BY abs(r.t - l.ts_ns), r.t) AS rn FROM l JOIN r USING (source_key))
SELECT source_key, seq, ts_ns, near_t, wseq FROM j WHERE rn = 1""")
def _(t):
    e = t.events()
    left = e.filter(F.col("kind") == "PollStart").select("source_key", "seq", "ts_ns")
    right = e.filter(F.col("kind") == "Wake").select("source_key", F.col("seq").alias("wseq"), F.col("ts_ns").alias("t"))
    return op.nearest(left, right, ["source_key"], "ts_ns", "t", ["wseq"]).filter(F.col("near_t").isNotNull())


@query("point_in_interval", f"WITH {ATTR} SELECT sample_id, worker_id, poll_seq, poll_start, poll_end, poll_task, poll_loc FROM attr")
def _(t):
    return op.attribute_samples(t.cpu(), t.events()).select(
        "sample_id", "worker_id", "poll_seq", "poll_start", "poll_end", "poll_task", "poll_loc")


@query("sample_poll_counts", f"""WITH {ATTR} SELECT source_key, poll_seq, count(*) FILTER (source = 0) AS cpu_samples, count(*) FILTER (source = 1) AS sched_samples
FROM attr WHERE poll_seq IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return op.poll_sample_counts(op.attribute_samples(t.cpu(), t.events()))


@query("gap_samples", f"""WITH {GAPS}, s AS (SELECT DISTINCT g.*, x.tid FROM gaps g, LATERAL (SELECT unnest([g.from_tid, g.to_tid]) AS tid) x)
SELECT c.sample_id, s.tid, s.seq AS gap_seq, s.worker_id FROM s JOIN v_cpu c ON c.source_key = s.source_key AND c.tid = s.tid AND c.t >= s.start_ns AND c.t < s.end_ns""")
def _(t):
    return op.gap_samples(op.handoff_gaps(t.events()), t.cpu()).select("sample_id", "tid", "gap_seq", "worker_id")


W1 = f"""w1 AS (SELECT p.source_key, p.task_id, p.worker_id, p.seq, p.ts_ns AS poll_ns, w.ts_ns AS wake_ns, p.ts_ns - w.ts_ns AS delay_ns FROM (SELECT * FROM v_events WHERE kind = 'PollStart') p
ASOF JOIN (SELECT * FROM v_events WHERE kind = 'Wake') w ON p.source_key = w.source_key AND p.task_id = w.task_id AND w.ts_ns <= p.ts_ns WHERE p.ts_ns > w.ts_ns AND p.ts_ns - w.ts_ns < {DELAY})"""


@query("wake_to_poll", f"WITH {W1} SELECT * FROM w1")
def _(t):
    return op.wake_to_poll(t.events(), DELAY)


W2 = OPEN + f""", wk AS (SELECT w.source_key, w.task_id, w.ts_ns AS wake, w.waker_task_id, q.start_ns AS i_s, q.end_ns AS i_e FROM (SELECT * FROM v_events WHERE kind = 'Wake') w
 ASOF LEFT JOIN po q ON q.source_key = w.source_key AND q.task_id = w.task_id AND q.start_ns <= w.ts_ns),
hit AS (SELECT p.*, wake, waker_task_id, CASE WHEN i_s < p.start_ns AND wake <= i_e THEN i_e ELSE wake END AS eff FROM po p ASOF JOIN wk ON wk.source_key = p.source_key AND wk.task_id = p.task_id AND wk.wake <= p.start_ns),
sd AS (SELECT source_key, worker_id, task_id, seq, start_ns, end_ns, eff AS wake_ns, start_ns - eff AS delay_ns, waker_task_id FROM hit WHERE start_ns - eff > 0 AND start_ns - eff < {DELAY})"""


@query("sched_delays", f"WITH {W2} SELECT * FROM sd")
def _(t):
    return op.sched_delays(t.events(), max_delay_ns=DELAY)


SPAWN = """fp AS (SELECT source_key, task_id, min(start_ns) AS start_ns, arg_min(worker_id, start_ns) AS worker_id FROM po GROUP BY 1, 2),
spw AS (SELECT source_key, task_id, max(ts_ns) AS spawn_ns FROM v_events WHERE kind = 'TaskSpawn' GROUP BY 1, 2),
spd AS (SELECT source_key, task_id, worker_id, spawn_ns, start_ns, start_ns - spawn_ns AS delay_ns FROM fp JOIN spw USING (source_key, task_id) WHERE start_ns > spawn_ns)"""


@query("spawn_delay", f"WITH {OPEN}, {SPAWN} SELECT * FROM spd")
def _(t):
    e = t.events()
    return op.spawn_delays(e, op.polls_open_ended(e))


POI = W2 + ", " + GAPS + ", " + BIND + ", " + SPAWN + f""",
bound AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM gaps g WHERE g.source_key = c.source_key AND (g.from_tid = c.tid OR g.to_tid = c.tid) AND g.start_ns <= c.t AND c.t < g.end_ns)
   THEN NULL ELSE b.worker_id END AS worker_id FROM v_cpu c ASOF LEFT JOIN bind b ON b.source_key = c.source_key AND b.tid = c.tid AND b.from_ns <= c.t),
inst AS (SELECT source_key, task_id, arg_max(instrumented, ts_ns) AS i FROM v_events WHERE kind = 'TaskSpawn' GROUP BY 1, 2), act AS ({ACTIVE.replace("round(", "(").replace(", 9)", ")")}),
poi AS (SELECT 'sched' AS kind, source_key, worker_id, coalesce(nt, 0) - nw AS time_ns, nw::double AS value FROM pk WHERE kind = 'WorkerPark' AND nk = 'WorkerUnpark' AND nw > 0
 UNION ALL SELECT 'long-poll', source_key, worker_id, start_ns, (end_ns - start_ns) / 1e6 FROM po WHERE end_ns > start_ns
 UNION ALL SELECT 'cpu-sampled', source_key, worker_id, start_ns, (end_ns - start_ns) / 1e6 FROM po p WHERE EXISTS (SELECT 1 FROM bound b WHERE b.source_key = p.source_key AND b.worker_id = p.worker_id AND b.t >= p.start_ns AND b.t < p.end_ns)
 UNION ALL SELECT 'off-cpu-active', source_key, worker_id, start_ns, (1 - ratio) * (end_ns - start_ns) FROM act a WHERE (1 - ratio) * (end_ns - start_ns) > 0
   AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source_key = a.source_key AND g.worker_id = a.worker_id AND g.start_ns < a.end_ns AND g.end_ns > a.start_ns)
 UNION ALL SELECT 'wake-delay', source_key, worker_id, wake_ns, delay_ns / 1000 FROM sd
 UNION ALL SELECT 'uninstrumented', source_key, worker_id, start_ns, (end_ns - start_ns) / 1e6 FROM po JOIN inst USING (source_key, task_id) WHERE NOT i
 UNION ALL SELECT 'spawn-delay', source_key, worker_id, spawn_ns, delay_ns / 1000 FROM spd),
rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, time_ns, source_key, worker_id) AS rank, count(*) OVER (PARTITION BY kind) AS matched, max(value) OVER (PARTITION BY kind) AS peak FROM poi)"""


@query("points_of_interest", f"WITH {POI} SELECT kind, source_key, worker_id, time_ns, round(value, 3) AS value, rank, matched FROM rk WHERE rank <= 50")
def _(t):
    poi = op.points_of_interest(t.events(), t.cpu(), max_delay_ns=DELAY)
    return poi.drop("peak").withColumn("value", F.round("value", 3))


@query("poi_severity", f"""WITH {POI} SELECT kind, CASE WHEN value / peak >= 0.66 THEN 'high' WHEN value / peak >= 0.33 THEN 'med' ELSE 'low' END AS severity, count(*) AS n FROM rk WHERE rank <= 50 GROUP BY 1, 2""")
def _(t):
    poi = op.points_of_interest(t.events(), t.cpu(), max_delay_ns=DELAY)
    return poi.groupBy("kind", op.severity(F.col("value"), F.col("peak")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("longest_poll", f"""WITH {ATTR}, top AS (SELECT * FROM polls ORDER BY duration_ns DESC, start_ns, seq LIMIT 1)
SELECT t.source_key, t.seq, t.duration_ns, count(a.sample_id) AS samples FROM top t LEFT JOIN attr a ON a.source_key = t.source_key AND a.poll_seq = t.seq GROUP BY ALL""")
def _(t):
    e = t.events()
    top = op.polls(e).orderBy(F.desc("duration_ns"), "start_ns", "seq").limit(1)
    counts = op.attribute_samples(t.cpu(), e).groupBy("source_key", F.col("poll_seq").alias("seq")).agg(F.count(F.lit(1)).alias("samples"))
    return top.join(counts, ["source_key", "seq"], "left").select("source_key", "seq", "duration_ns", F.coalesce("samples", F.lit(0)).alias("samples"))


#: Worker 1 belongs to one runtime in some sources and to another in the others.
SPLIT_RUNTIMES = "CASE WHEN f.worker_id < CASE WHEN right(source_key, 1) IN ('1', '3', '5', '7', '9') THEN 1 ELSE 2 END THEN 'main' ELSE 'io' END"


@query("runtime_task_spawns", f"""WITH {CLOSED}, f AS (SELECT source_key, task_id, arg_min(worker_id, start_ns) AS worker_id FROM polls GROUP BY 1, 2)
SELECT source_key, {SPLIT_RUNTIMES} AS runtime, count(*) AS spawns, min(ts_ns) AS first_ns FROM v_events e JOIN f USING (source_key, task_id) WHERE kind = 'TaskSpawn' GROUP BY 1, 2""")
def _(t):
    e = t.events()
    edge = F.when(F.right("source_key", F.lit(1)).isin("1", "3", "5", "7", "9"), 1).otherwise(2)
    runtimes = e.select("source_key", "worker_id").distinct().withColumn("runtime", F.when(F.col("worker_id") < edge, "main").otherwise("io"))
    return op.runtime_task_spawns(e, op.polls(e), runtimes)


@query("local_queue_series", """SELECT worker_id, max(local_queue) AS deepest, count(*) AS n, sum(local_queue)::bigint AS total FROM v_events WHERE kind IN ('PollStart', 'WorkerPark', 'WorkerUnpark') GROUP BY 1""")
def _(t):
    return op.local_queue_series(t.events()).groupBy("worker_id").agg(
        F.max("local_queue").alias("deepest"), F.count(F.lit(1)).alias("n"), F.sum("local_queue").alias("total"))


@query("trace_summary", f"""WITH {CLOSED}, a AS (SELECT source_key, worker_id, count(*) AS events, count(*) FILTER (kind = 'WorkerPark') AS parks, count(*) FILTER (kind = 'WorkerUnpark') AS unparks,
 max(local_queue) FILTER (kind IN ('PollStart', 'WorkerPark', 'WorkerUnpark')) AS max_local_queue, count(sched_wait_ns) FILTER (kind = 'WorkerUnpark') AS sched_wait_samples,
 coalesce(sum(sched_wait_ns) FILTER (kind = 'WorkerUnpark'), 0)::bigint AS sched_wait_ns FROM v_events GROUP BY 1, 2),
b AS (SELECT source_key, worker_id, count(*) AS polls, sum(duration_ns)::bigint AS poll_ns FROM polls GROUP BY 1, 2)
SELECT a.*, coalesce(polls, 0) AS polls, coalesce(poll_ns, 0) AS poll_ns FROM a LEFT JOIN b USING (source_key, worker_id)""")
def _(t):
    e = t.events()
    return op.trace_summary(e, op.polls(e))


@query("trace_summary_locations", f"WITH {CLOSED} SELECT spawn_loc, count(*) AS polls, sum(duration_ns)::bigint AS poll_ns, max(duration_ns) AS longest_ns FROM polls GROUP BY 1")
def _(t):
    return op.polls(t.events()).groupBy("spawn_loc").agg(
        F.count(F.lit(1)).alias("polls"), F.sum("duration_ns").alias("poll_ns"), F.max("duration_ns").alias("longest_ns"))


@query("dump_wait", f"""WITH {CLOSED}, lg AS (SELECT *, lag(end_ns) OVER (PARTITION BY source_key, task_id ORDER BY start_ns, seq) AS pe FROM polls)
SELECT source_key, task_id, start_ns AS ts_ns, end_ns, start_ns - pe AS idle_ns FROM lg""")
def _(t):
    e = t.events()
    dumps = e.filter(F.col("kind") == "PollStart").select("source_key", "task_id", "ts_ns")  # a dump is taken as its poll starts
    return op.dump_wait(dumps, op.polls(e))


SEG = """ev6 AS (SELECT * REPLACE (concat(host, '/', cast(ts_ns // 21600000000000 AS varchar)) AS source_key) FROM v_events),
segs AS (SELECT host, source_key, min(ts_ns) AS start_ns, max(ts_ns) + 1200000000000 AS end_ns, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM ev6 GROUP BY 1, 2),
lf AS (SELECT * FROM ev6 WHERE kind IN ('PollStart', 'PollEnd', 'WorkerPark', 'WorkerUnpark')),
fst AS (SELECT host, source_key, worker_id, arg_min(kind, ts_ns) AS fk, min(ts_ns) AS ft, arg_max(kind, ts_ns) FILTER (kind <> 'WorkerUnpark') AS lk,
  max(ts_ns) FILTER (kind <> 'WorkerUnpark') AS lt, arg_max(task_id, ts_ns) FILTER (kind <> 'WorkerUnpark') AS ltask FROM lf GROUP BY 1, 2, 3),
edges AS (SELECT host, source_key, worker_id, CASE WHEN fk = 'PollEnd' THEN ft END AS close_ns, CASE WHEN lk = 'PollStart' THEN lt END AS open_ns, CASE WHEN lk = 'PollStart' THEN ltask END AS open_task FROM fst)"""


def six_hour_events(t):
    grain = F.expr("ts_ns div 21600000000000").cast("string")
    return t.events().withColumn("source_key", F.concat("host", F.lit("/"), grain))


@query("segment_edge_polls", f"WITH {SEG} SELECT * FROM edges")
def _(t):
    return op.segment_edge_polls(six_hour_events(t))


@query("stitch_boundary_polls", f"""WITH {SEG}, g AS (SELECT *, CASE WHEN lag(end_ns) OVER (PARTITION BY host ORDER BY start_ns) < start_ns THEN 1 ELSE 0 END AS b FROM segs),
ch AS (SELECT *, sum(b) OVER (PARTITION BY host ORDER BY start_ns) AS chain FROM g), cm AS (SELECT host, chain, min(min_ts) AS cmin, max(max_ts) AS cmax, max(max(chain)) OVER (PARTITION BY host) AS lastc FROM ch GROUP BY 1, 2),
pl AS (SELECT e.*, ch.chain, ch.start_ns, cmin, cmax, lastc FROM edges e JOIN ch ON ch.source_key = e.source_key AND ch.host = e.host JOIN cm ON cm.host = e.host AND cm.chain = ch.chain),
ar AS (SELECT *, lead(chain) OVER w AS nc, lead(close_ns) OVER w AS ncl, lag(chain) OVER w AS pc FROM pl WINDOW w AS (PARTITION BY host, worker_id ORDER BY start_ns))
SELECT host, worker_id, open_task AS task_id, open_ns AS start_ns, ncl AS end_ns, 'none' AS truncated_at FROM ar WHERE open_ns IS NOT NULL AND nc = chain AND ncl IS NOT NULL
UNION ALL SELECT host, worker_id, open_task, open_ns, greatest(cmax, open_ns), 'end' FROM ar WHERE open_ns IS NOT NULL AND (nc IS NULL OR nc <> chain) AND chain < lastc
UNION ALL SELECT host, worker_id, NULL, least(cmin, close_ns), close_ns, 'start' FROM ar WHERE close_ns IS NOT NULL AND (pc IS NULL OR pc <> chain) AND chain > 0""")
def _(t):
    e = six_hour_events(t)
    segments = e.groupBy("host", "source_key").agg(
        F.min("ts_ns").alias("start_ns"), (F.max("ts_ns") + 1_200_000_000_000).alias("end_ns"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))
    return op.stitch_boundary_polls(op.segment_edge_polls(e), segments)
