"""Health checks."""

from pyspark.sql import functions as F

from spoor.catalog import spans as span_cat
from spoor.catalog.rebuild import ATTR, CLOSED, DELAY, OPEN, PK, W1, W2, ACTIVE
from spoor.catalog.registry import ORACLES, query
from spoor.catalog.series import TIMELINE
from spoor.operators import checks as op, rebuild, series
from spoor.session import cut_lineage

HOUR = 3_600_000_000_000
COLS = '"check", severity, subject, value'


def sel(check, severity, subject, value, rest):
    return f"SELECT '{check}' AS \"check\", {severity} AS severity, cast({subject} AS varchar) AS subject, cast({value} AS double) AS value {rest}"


@query("incomplete_file", sel("incomplete-file", "'warning'", "source_key", "1", "FROM (SELECT source_key, count(*) AS n FROM v_events GROUP BY 1) WHERE n % 2 = 1"))
def _(t):
    return op.incomplete_file(sealed(t))


def sealed(t):
    """Metadata of each source: sealed with events missing if it has an odd number of them."""
    per = t.events().groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    meta = F.create_map(F.lit("segment.complete"), F.when(F.col("n") % 2 == 1, "false").otherwise("true"))
    return per.select("source_key", meta.alias("metadata"))


LONG = """lp AS (SELECT *, CASE WHEN duration_ns > 50000000 THEN 'critical' WHEN duration_ns > 10000000 THEN 'warning' END AS sev FROM v_polls),
lr AS (SELECT *, row_number() OVER (PARTITION BY sev ORDER BY duration_ns DESC, start_ns, host, worker_id, task_id) AS rn FROM lp WHERE sev IS NOT NULL)"""
LONG_SQL = (sel("long-poll", "sev", "concat_ws('/', host, worker_id, task_id, start_ns)", "duration_ns", "FROM lr WHERE rn <= 5") + " UNION ALL "
            + sel("long-poll", "sev", "'total'", "count(*)", "FROM lr GROUP BY sev"))


@query("long_poll", f"WITH {LONG} {LONG_SQL}")
def _(t):
    return op.long_poll(t.polls())


LEAK = f"""lk AS (SELECT source_key, count(*) AS n, arg_min(alive, ts_ns) AS f, arg_max(alive, ts_ns) AS l, max(alive) AS p FROM tl GROUP BY 1)"""
LEAK_SQL = sel("task-leak", "'warning'", "source_key", "l", "FROM lk WHERE n > 10 AND l > f * 2 AND l = p")


@query("task_leak", f"WITH {TIMELINE}, {LEAK} {LEAK_SQL}")
def _(t):
    return op.task_leak(series.active_task_timeline(t.events()))


SD = sel("sched-delay", f"CASE WHEN max(delay_ns) > {HOUR} THEN 'critical' ELSE 'warning' END", "source_key", "count(*)", f"FROM sd WHERE delay_ns > {HOUR // 60} GROUP BY source_key")


@query("sched_delay", f"WITH {W2} {SD}")
def _(t):
    return op.sched_delay(rebuild.sched_delays(t.events(), max_delay_ns=DELAY), HOUR // 60, HOUR)


BLOCK = """bg AS (SELECT source_key, array_to_string(frames, ';') AS stack, count(*) AS n FROM v_cpu WHERE source = 1 GROUP BY 1, 2), br AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY n DESC, stack) AS rn FROM bg)"""


@query("blocking_calls", f"WITH {BLOCK} " + sel("blocking-calls", "'warning'", "concat(source_key, ' ', stack)", "n", "FROM br WHERE rn = 1 AND n > 5"))
def _(t):
    return op.blocking_calls(t.cpu())


QUEUE = "q AS (SELECT source_key, ts_ns, sum(global_queue_depth)::bigint AS depth FROM v_metrics GROUP BY 1, 2)"
QUEUE_SQL = sel("queue-depth", "CASE WHEN max(depth) > 1000 THEN 'critical' ELSE 'warning' END", "concat(source_key, ' ', max(depth))", "count(*) FILTER (depth > 100)", "FROM q GROUP BY source_key HAVING count(*) FILTER (depth > 100) > 0")


@query("queue_depth", f"WITH {QUEUE} {QUEUE_SQL}")
def _(t):
    return op.queue_depth(series.queue_series(t.metrics()))


IMB = "wc AS (SELECT host, CASE WHEN host <> 'h2' AND task_id % 4 <> 0 THEN 0 ELSE worker_id END AS worker_id, count(*) AS n FROM v_polls GROUP BY 1, 2)"
IMB_SQL = sel("worker-imbalance", "'info'", "host", "max(n) / min(n)", "FROM wc GROUP BY host HAVING count(*) > 1 AND max(n) > min(n) * 3")


@query("worker_imbalance", f"WITH {IMB} {IMB_SQL}")
def _(t):
    return op.worker_imbalance(lopsided(t), "host")


def lopsided(t):
    """Polls, of which three in four are left to worker 0 on all hosts but one; the given ones are nearly even."""
    left = (F.col("host") != "h2") & (F.col("task_id") % 4 != 0)
    return t.polls().withColumn("worker_id", F.when(left, 0).otherwise(F.col("worker_id")))


ACT = ACTIVE.replace("round(", "(").replace(", 9)", ")")
CONT = f"aa AS ({ACT}), ab AS (SELECT source_key, worker_id, count(*) AS n, count(*) FILTER (ratio < 0.5 AND end_ns - start_ns > 1000000) AS low FROM aa GROUP BY 1, 2)"
CONT_SQL = sel("cpu-contention", "'warning'", "concat(source_key, '/', worker_id)", "low", "FROM ab WHERE n > 10 AND low > n * 0.1")


@query("cpu_contention", f"WITH {PK}, {CONT} {CONT_SQL}")
def _(t):
    return op.cpu_contention(rebuild.active_periods(t.events()))


WAIT_SQL = sel("kernel-sched-wait", "CASE WHEN max(nw) > 10000000 THEN 'warning' ELSE 'info' END", "concat(source_key, '/', worker_id)", "count(*)",
               "FROM pk WHERE kind = 'WorkerPark' AND nk = 'WorkerUnpark' AND nw > 1000000 GROUP BY source_key, worker_id")


@query("kernel_sched_wait", f"WITH {PK} {WAIT_SQL}")
def _(t):
    return op.kernel_sched_wait(rebuild.parks(t.events()))


PARTS = f"""{CLOSED}, {span_cat.SINGLE}, parts AS (SELECT source_key, worker_id, start_ns + k * ((end_ns - start_ns) // 11) AS start_ns, start_ns + (k + 1) * ((end_ns - start_ns) // 11) AS end_ns FROM single, range(11) r(k)),
inn AS (SELECT p.source_key, p.seq AS poll_seq FROM parts s JOIN polls p ON p.source_key = s.source_key AND p.worker_id = s.worker_id AND s.start_ns >= p.start_ns AND s.end_ns <= p.end_ns)"""


@query("many_spans_per_poll", f"WITH {PARTS} " + sel("many-spans-per-poll", "'warning'", "concat(source_key, '/', poll_seq)", "count(*)", "FROM inn GROUP BY source_key, poll_seq HAVING count(*) > 20"))
def _(t):
    return op.many_spans_per_poll(parts_inside(t))


def parts_inside(t, polls=None):
    """Parts of spans inside polls, each span recorded as eleven equal parts one after the other."""
    size = F.expr("(end_ns - start_ns) div 11")
    parts = span_cat.op.spans_single_event(span_cat.single_events(t), None, 1_000_000_000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumns(
        {"start_ns": F.col("start_ns") + F.col("k") * size, "end_ns": F.col("start_ns") + (F.col("k") + 1) * size})
    return span_cat.op.spans_inside_polls(parts, span_cat.polls_table(t) if polls is None else polls)


SLOW = "sp AS (SELECT name, CASE WHEN span_id % 40 = 0 THEN elapsed_ns * 25 ELSE elapsed_ns END AS elapsed_ns FROM v_spans)"


def with_outliers(t):
    """Spans, of which every fortieth takes 25 times as long."""
    return t.spans().withColumn("elapsed_ns", F.when(F.col("span_id") % 40 == 0, F.col("elapsed_ns") * 25).otherwise(F.col("elapsed_ns")))


@query("span_outlier", f"WITH {SLOW}, m AS (SELECT name, list(elapsed_ns ORDER BY elapsed_ns) AS l FROM sp GROUP BY 1), p AS (SELECT name, l[1 + cast(floor(len(l) * 0.5) AS bigint)] AS p50 FROM m WHERE len(l) >= 10) "
       + sel("span-duration-outlier", "'info'", "v.name", "count(*)", "FROM sp v JOIN p USING (name) WHERE elapsed_ns > p50 * 10 GROUP BY v.name"))
def _(t):
    return op.span_outlier(with_outliers(t))


@query("unmatched_spans", f"WITH {span_cat.PAIR} " + sel("unmatched-spans", "'info'", "span_name", "count(*)", "FROM pairs p JOIN v_span_events e ON e.source_key = p.source_key AND e.seq = p.enter_seq WHERE state = 'unmatched_enter' GROUP BY span_name"))
def _(t):
    return op.unmatched_spans(span_cat.pairs(t), enter_names(t))


def enter_names(t):
    return t.span_events().select("source_key", F.col("seq").alias("enter_seq"), "span_name")


@query("idle_worker", f"WITH {PK}, {QUEUE}, sl AS (SELECT source_key, worker_id, ts_ns AS s, nt AS e FROM pk WHERE kind = 'WorkerPark' AND nk = 'WorkerUnpark' AND nt - ts_ns > 1000000), h AS (SELECT sl.*, q.depth FROM sl ASOF JOIN q ON q.source_key = sl.source_key AND q.ts_ns <= sl.e) "
       + sel("idle-worker", "'warning'", "concat_ws('/', source_key, worker_id, s)", "depth", "FROM h WHERE depth > 0"))
def _(t):
    return op.idle_worker(rebuild.parks(t.events(), woken=True), series.queue_series(t.metrics()))


@query("wake_delay", f"WITH {W1} " + sel("wake-delay", "'warning'", "concat(source_key, '/', seq)", "delay_ns", f"FROM w1 WHERE delay_ns >= {HOUR}"))
def _(t):
    return op.wake_delay(rebuild.wake_to_poll(t.events(), DELAY), HOUR)


#: Sources of odd weeks are recorded badly, the others well: a verdict for each.
BAD = "right(source_key, 1) IN ('1', '3', '5', '7', '9')"
SETUP = {
    "missing_frame_pointers": sel("missing-frame-pointers", "'critical'", "source_key", "depth", "FROM s WHERE n_on > 10 AND depth < 3"),
    "missing_wake_events": sel("missing-wake-events", "'warning'", "source_key", "spawns", "FROM e WHERE spawns > 0 AND wakes = 0"),
    "missing_symbols": sel("missing-debug-symbols", "'warning'", "source_key", "known", "FROM s JOIN y USING (source_key) WHERE n_on > 10 AND addrs > 0 AND (known = 0 OR known / addrs < 0.1 AND placed = 0)"),
    "no_sched_events": sel("no-scheduling-events", "'info'", "source_key", "n_on", "FROM s WHERE n_on > 0 AND n_off = 0"),
    "no_task_polls": sel("no-task-polls", "'warning'", "source_key", "unparks", "FROM e WHERE n % 2 = 0 AND unparks > 10 AND polls = 0"),
}
SETUP_CTE = f"""WITH e AS (SELECT source_key, count(*) AS n, count(*) FILTER (kind = 'TaskSpawn') AS spawns, count(*) FILTER (kind = 'WorkerUnpark') AS unparks,
 count(*) FILTER (kind = 'Wake' AND NOT {BAD}) AS wakes, count(*) FILTER (kind = 'PollStart' AND NOT {BAD}) AS polls FROM v_events GROUP BY 1),
c AS (SELECT source_key, CASE WHEN {BAD} THEN frames[1:2] ELSE frames END AS f, CASE WHEN {BAD} THEN 0 ELSE source END AS source, frames FROM v_cpu),
s AS (SELECT source_key, count(*) FILTER (source = 0) AS n_on, count(*) FILTER (source <> 0) AS n_off, avg(len(f)) FILTER (source = 0) AS depth FROM c GROUP BY 1),
y AS (SELECT source_key, count(DISTINCT a) FILTER (seen) AS addrs, count(DISTINCT a) FILTER (NOT {BAD} OR a LIKE 'kernel::%') AS known, count(DISTINCT a) FILTER (NOT {BAD}) AS placed
 FROM (SELECT source_key, unnest(frames) AS a, false AS seen FROM c UNION ALL SELECT source_key, unnest(f), true FROM c WHERE source = 0) GROUP BY 1) """
FLAG_SQL = sel("no-unstable-flag", "'warning'", "source_key", "1", "FROM e WHERE n % 2 = 1")


def faulty(t):
    """Sources of odd weeks as a recording without frame pointers, wake events, task polls, scheduler samples and symbols beyond the kernel's gives
    them: no row is left out."""
    bad = F.right("source_key", F.lit(1)).isin("1", "3", "5", "7", "9")
    events = t.events().withColumn("kind", F.when(bad & F.col("kind").isin("Wake", "PollStart"), "PollEnd").otherwise(F.col("kind")))
    symbols = t.cpu().select("source_key", F.explode("frames").alias("addr")).distinct().filter(~bad | F.startswith("addr", F.lit("kernel::")))
    short = t.cpu().withColumn("frames", F.when(bad, F.slice("frames", 1, 2)).otherwise(F.col("frames"))).withColumn("source", F.when(bad, F.lit(0)).otherwise(F.col("source")))
    return op.setup_checks(events, short, symbols.withColumn("location", F.when(bad, "").otherwise("file")), flags(t))


def flags(t):
    """Metadata of each source: recorded with the unstable flag if it has an even number of events."""
    per = t.events().groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    return per.select("source_key", F.create_map(F.lit("unstable"), F.when(F.col("n") % 2 == 0, "true").otherwise("false")).alias("metadata"))


@query("setup_checks", SETUP_CTE + " UNION ALL ".join([*SETUP.values(), FLAG_SQL]))
def _(t):
    return faulty(t)


def _register_setup(name, sql):
    check = sql.split("'")[1]

    @query(name, SETUP_CTE + sql)
    def _(t):
        return faulty(t).filter(F.col("check") == check)


for _name, _sql in SETUP.items():
    _register_setup(_name, _sql)


@query("no_unstable_flag", SETUP_CTE + FLAG_SQL)
def _(t):
    return faulty(t).filter(F.col("check") == "no-unstable-flag")


HZ = 0.0004
STUCK = OPEN + ", ps AS (SELECT * REPLACE (CASE WHEN seq % 250 = 0 THEN start_ns + 30 * (end_ns - start_ns) ELSE end_ns END AS end_ns) FROM po)"


def with_stuck(events):
    """Polls bounded by the next start or park, every 250th of them 30 times as long."""
    long = F.col("start_ns") + 30 * (F.col("end_ns") - F.col("start_ns"))
    return cut_lineage(rebuild.polls_open_ended(events).withColumn("end_ns", F.when(F.col("seq") % 250 == 0, long).otherwise(F.col("end_ns"))))


@query("corroborate", f"""WITH {ATTR}, {STUCK.replace('life AS', 'lf9 AS').replace('FROM life', 'FROM lf9')}, d AS (SELECT source_key, seq, task_id, start_ns, end_ns, end_ns - start_ns AS dur FROM ps),
p9 AS (SELECT list(dur ORDER BY dur) AS l FROM d), lg AS (SELECT d.* FROM d, p9 WHERE dur >= greatest(1000000.0, 3 * l[1 + least(len(l) - 1, cast(floor(len(l) * 0.99) AS bigint))])),
best AS (SELECT * FROM lg ORDER BY dur DESC, start_ns, seq LIMIT 20),
ce AS (SELECT b.seq, b.dur, c.tid, c.frames[1] AS leaf, count(*) AS n FROM best b JOIN v_cpu c ON c.source_key = b.source_key AND c.source <> 1 AND c.t BETWEEN b.start_ns AND b.end_ns GROUP BY ALL),
th AS (SELECT seq, dur, tid, sum(n) AS n, arg_max(leaf, n * 1000 - ascii(right(leaf, 1))) AS leaf FROM ce GROUP BY 1, 2, 3), su AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, tid) AS rn FROM th),
nm AS (SELECT seq, tid, n, leaf FROM su WHERE rn = 1 AND dur / 1e9 * {HZ} >= 3 AND least(1.0, n / (dur / 1e9 * {HZ})) >= 0.6 AND n >= 3),
sn AS (SELECT DISTINCT l.seq AS other, unnest(c.frames) AS leaf FROM lg l JOIN v_cpu c ON c.source_key = l.source_key AND c.source <> 1 AND c.t BETWEEN l.start_ns AND l.end_ns),
co AS (SELECT nm.seq, count(*) AS k FROM nm JOIN sn ON sn.leaf = nm.leaf AND sn.other <> nm.seq GROUP BY 1),
ct AS (SELECT source_key, poll_seq, count(*) FILTER (source = 0) AS c0, count(*) FILTER (source = 1) AS c1 FROM attr WHERE poll_seq IS NOT NULL GROUP BY 1, 2)
SELECT b.source_key, b.seq AS poll_seq, b.task_id, b.dur AS duration_ns, CASE WHEN coalesce(c0, 0) > 0 THEN 'on_cpu' ELSE 'off_cpu' END AS class, coalesce(c0, 0) AS cpu_samples, coalesce(c1, 0) AS sched_samples, CASE WHEN coalesce(c0, 0) = 0 THEN nm.tid END AS suspect_tid,
 CASE WHEN coalesce(c0, 0) = 0 THEN nm.n::bigint END AS suspect_samples, CASE WHEN coalesce(c0, 0) = 0 THEN nm.leaf END AS suspect_leaf, CASE WHEN coalesce(c0, 0) = 0 AND nm.tid IS NOT NULL THEN coalesce(k, 0) END AS coincided, (SELECT count(*) - 1 FROM lg) AS others FROM best b LEFT JOIN ct ON ct.source_key = b.source_key AND ct.poll_seq = b.seq
 LEFT JOIN nm ON nm.seq = b.seq LEFT JOIN co ON co.seq = b.seq""")
def _(t):
    e = t.events()
    attributed = rebuild.attribute_samples(t.cpu(), e)
    return op.diagnose_long_polls(with_stuck(e), attributed, t.cpu(), HZ, top=20)


@query("diagnose_long_poll", f"""WITH {STUCK}, d AS (SELECT seq, end_ns - start_ns AS dur, start_ns FROM ps), p9 AS (SELECT list(dur ORDER BY dur) AS l FROM d)
SELECT seq AS poll_seq, dur AS duration_ns FROM d, p9 WHERE dur >= greatest(1000000.0, 3 * l[1 + least(len(l) - 1, cast(floor(len(l) * 0.99) AS bigint))]) ORDER BY dur DESC, start_ns, seq LIMIT 3""")
def _(t):
    e = t.events()
    out = op.diagnose_long_polls(with_stuck(e), rebuild.attribute_samples(t.cpu(), e), t.cpu(), HZ, top=3)
    return out.select("poll_seq", "duration_ns")


Z, HALF = 1_705_000_000_000_000_000, 6 * HOUR


@query("zoom_window", f"""WITH {OPEN}, {QUEUE}, {span_cat.SINGLE}, nr AS (SELECT *, end_ns - start_ns AS dur FROM po WHERE end_ns >= {Z - HALF} AND start_ns <= {Z + HALF}), tp AS (SELECT * FROM nr WHERE dur > 1000000 ORDER BY dur DESC, start_ns, seq LIMIT 1),
z AS (SELECT 'poll' AS section, concat(source_key, '/', seq) AS subject, dur::double AS value FROM nr UNION ALL SELECT 'busy', concat(source_key, '/', worker_id), sum(least(end_ns, {Z + HALF}) - greatest(start_ns, {Z - HALF}))::double FROM nr GROUP BY source_key, worker_id
 UNION ALL SELECT 'thread', concat(source_key, '/', tid), (count(*) FILTER (source <> 1))::double FROM v_cpu WHERE t BETWEEN {Z - HALF} AND {Z + HALF} GROUP BY source_key, tid
 UNION ALL SELECT 'queue', concat(source_key, '/max'), max(depth)::double FROM q WHERE ts_ns BETWEEN {Z - HALF} AND {Z + HALF} GROUP BY source_key UNION ALL SELECT 'queue', concat(source_key, '/min'), min(depth)::double FROM q WHERE ts_ns BETWEEN {Z - HALF} AND {Z + HALF} GROUP BY source_key
 UNION ALL SELECT 'span', s.name, count(*)::double FROM single s JOIN tp ON tp.source_key = s.source_key AND tp.worker_id = s.worker_id AND s.start_ns >= tp.start_ns AND s.end_ns <= tp.end_ns GROUP BY s.name) SELECT * FROM z""")
def _(t):
    spans = span_cat.op.spans_single_event(span_cat.single_events(t), None, 1_000_000_000)
    return op.zoom_window(rebuild.polls_open_ended(t.events()), t.cpu(), series.queue_series(t.metrics()), spans, Z, HALF)


#: The checks of the scan beyond those that one statement holds: each with the common table expressions of its own.
OTHERS = ("incomplete_file", "sched_delay", "many_spans_per_poll", "span_outlier", "unmatched_spans")
OTHER_SQL = " UNION ALL ".join(f'SELECT "check", severity, subject, value FROM ({ORACLES[name]})' for name in OTHERS)


@query("red_flags", f"""WITH {LONG}, {TIMELINE}, {LEAK}, {BLOCK}, {QUEUE}, {IMB}, {PK}, {CONT} {LONG_SQL} UNION ALL {LEAK_SQL} UNION ALL {sel("blocking-calls", "'warning'", "concat(source_key, ' ', stack)", "n", "FROM br WHERE rn = 1 AND n > 5")}
UNION ALL {QUEUE_SQL} UNION ALL {IMB_SQL} UNION ALL {CONT_SQL} UNION ALL {WAIT_SQL} UNION ALL {OTHER_SQL}""")
def _(t):
    e = t.events()
    slot = rebuild.time_slot(e)
    polls = span_cat.polls_table(t)  # for both checks of spans
    return op.report(
        op.long_poll(t.polls()), op.task_leak(series.active_task_timeline(e, slot=slot)), op.blocking_calls(t.cpu()),
        op.queue_depth(series.queue_series(t.metrics())), op.worker_imbalance(lopsided(t), "host"),
        op.cpu_contention(rebuild.active_periods(e, slot=slot)), op.kernel_sched_wait(rebuild.parks(e, slot)),
        op.incomplete_file(sealed(t)), op.sched_delay(rebuild.sched_delays(e, max_delay_ns=DELAY, slot=slot), HOUR // 60, HOUR),
        op.many_spans_per_poll(parts_inside(t, polls)), op.span_outlier(with_outliers(t)), op.unmatched_spans(span_cat.pairs(t, polls), enter_names(t)))
