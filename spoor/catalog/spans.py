"""Tracing spans."""

from pyspark.sql import functions as F

from spoor.catalog.rebuild import BIND, CLOSED, GAPS
from spoor.catalog.registry import query
from spoor.operators import rebuild, spans as op
from spoor.session import cut_lineage

SEGD = """sg AS (SELECT *, coalesce(sum(CASE WHEN kind = 'SpanClose' THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, span_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS segment FROM v_span_events)"""
LANES = CLOSED + ", " + SEGD + """, np AS (SELECT * FROM polls WHERE task_id <> 0),
l0 AS (SELECT s.*, n.task_id AS now_task, n.end_ns AS now_end FROM (SELECT * FROM sg WHERE kind <> 'SpanClose') s ASOF LEFT JOIN np n ON n.source_key = s.source_key AND n.worker_id = s.worker_id AND n.start_ns <= s.ts_ns),
l1 AS (SELECT s.*, b.task_id AS bt, b.end_ns AS be FROM l0 s ASOF LEFT JOIN np b ON b.source_key = s.source_key AND b.worker_id = s.worker_id AND b.start_ns < s.ts_ns),
l2 AS (SELECT *, coalesce(CASE WHEN task_id <> 0 THEN task_id END, CASE WHEN kind = 'SpanExit' AND ts_ns <= be THEN bt END, CASE WHEN ts_ns < now_end THEN now_task END) AS lane0 FROM l1),
l3 AS (SELECT *, CASE WHEN min(lane0) OVER w = max(lane0) OVER w THEN min(lane0) OVER w END AS sole FROM l2 WINDOW w AS (PARTITION BY source_key, span_id, segment)),
lanes AS (SELECT *, coalesce(lane0, sole, -1) AS lane FROM l3)"""
PAIR = LANES + """, p0 AS (SELECT *, sum(CASE WHEN kind = 'SpanEnter' THEN 1 ELSE -1 END) OVER w AS d FROM lanes WINDOW w AS (PARTITION BY source_key, span_id, segment, lane ORDER BY ts_ns, seq)),
p1 AS (SELECT *, least(coalesce(min(d) OVER (PARTITION BY source_key, span_id, segment, lane ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS m FROM p0),
p2 AS (SELECT *, CASE WHEN kind = 'SpanEnter' THEN d - m ELSE d - m + 1 END AS lvl, kind = 'SpanExit' AND d < m AS lost FROM p1),
p3 AS (SELECT *, lead(kind) OVER w AS nk, lead(ts_ns) OVER w AS nt FROM p2 WHERE NOT lost WINDOW w AS (PARTITION BY source_key, span_id, segment, lane, lvl ORDER BY ts_ns, seq)),
pairs AS (SELECT source_key, span_id, segment, lane, CASE WHEN nk = 'SpanExit' THEN 'paired' ELSE 'unmatched_enter' END AS state, ts_ns AS start_ns, CASE WHEN nk = 'SpanExit' THEN nt END AS end_ns, seq AS enter_seq FROM p3 WHERE kind = 'SpanEnter'
  UNION ALL SELECT source_key, span_id, segment, lane, 'unmatched_exit', NULL, ts_ns, NULL FROM p2 WHERE lost)"""
K3 = "source_key, span_id, segment"
UNION_IV = f"""iv AS (SELECT {K3}, start_ns, end_ns, max(end_ns) OVER (PARTITION BY {K3} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pairs WHERE state = 'paired'),
iv2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ns > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {K3} ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS isl FROM iv),
ent AS (SELECT {K3}, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM iv2 GROUP BY {K3}, isl)"""
BUILT = PAIR + ", " + UNION_IV + f""",
fr AS (SELECT {K3}, min(ts_ns) FILTER (kind = 'SpanEnter') AS first_enter, max(ts_ns) FILTER (kind = 'SpanClose') AS close_ns, arg_min(span_name, ts_ns) FILTER (kind = 'SpanEnter') AS name,
  arg_min(coalesce(parent_span_id, -9), ts_ns) FILTER (kind = 'SpanEnter') AS par, arg_max(attr_k, ts_ns) FILTER (kind = 'SpanExit') AS xk, arg_min(attr_k, ts_ns) FILTER (kind = 'SpanEnter') AS ek FROM sg GROUP BY {K3}),
ty AS (SELECT {K3}, count(*) FILTER (state = 'paired') AS intervals, count(*) FILTER (state = 'unmatched_enter') AS ue, count(*) FILTER (state = 'unmatched_exit') AS ux,
  sum(end_ns - start_ns) FILTER (state = 'paired') AS active_ns, max(end_ns) FILTER (state = 'paired') AS lx, min(start_ns) FILTER (state = 'paired') AS fs,
  CASE WHEN min(lane) FILTER (state = 'paired') = max(lane) FILTER (state = 'paired') THEN min(lane) FILTER (state = 'paired') END AS own FROM pairs GROUP BY {K3}),
ob AS (SELECT {K3}, sum(end_ns - start_ns) AS wall FROM ent GROUP BY {K3}),
ow AS (SELECT {K3}, own AS owner FROM ty t WHERE own <> -1 AND EXISTS (SELECT 1 FROM np WHERE np.source_key = t.source_key AND np.task_id = t.own)),
cp AS (SELECT e.source_key, e.span_id, e.segment, sum(least(e.end_ns, p.end_ns) - greatest(e.start_ns, p.start_ns)) AS cpu FROM ent e JOIN ow o ON (e.source_key, e.span_id, e.segment) = (o.source_key, o.span_id, o.segment)
  JOIN polls p ON p.source_key = e.source_key AND p.task_id = o.owner AND p.start_ns < e.end_ns AND p.end_ns > e.start_ns GROUP BY 1, 2, 3),
b0 AS (SELECT {K3}, coalesce(name, '') AS name, CASE WHEN par <> -9 THEN par END AS parent_span_id, coalesce(first_enter, fs, close_ns) AS start_ns, coalesce(close_ns, lx) AS end_ns, active_ns::bigint AS active_ns,
  coalesce(wall, 0)::bigint AS wall, coalesce(ue, 0) AS ue, coalesce(ux, 0) AS ux, owner, CASE WHEN owner IS NOT NULL THEN least(coalesce(cpu, 0), coalesce(wall, 0))::bigint END AS cpu, CASE WHEN first_enter IS NOT NULL THEN coalesce(xk, ek) END AS k
  FROM fr LEFT JOIN ty USING ({K3}) LEFT JOIN ob USING ({K3}) LEFT JOIN ow USING ({K3}) LEFT JOIN cp USING ({K3}) WHERE close_ns IS NOT NULL OR intervals > 0),
b1 AS (SELECT *, greatest(end_ns - start_ns, 0) AS elapsed_ns, CASE WHEN owner IS NOT NULL THEN wall ELSE 0 END AS cl FROM b0),
built AS (SELECT {K3}, name, parent_span_id, start_ns, end_ns, active_ns, wall AS observed_active_wall_ns, coalesce(active_ns, 0) > wall + 1 AS concurrent, ue AS unbalanced_enters, ux AS unbalanced_exits,
  CASE WHEN cl <= elapsed_ns THEN cpu END AS on_cpu_ns_est, CASE WHEN cl <= elapsed_ns THEN wall - cpu END AS async_wait_ns, elapsed_ns, CASE WHEN cl <= elapsed_ns THEN elapsed_ns - cl ELSE elapsed_ns END AS unknown_ns,
  CASE WHEN owner IS NOT NULL THEN 11 ELSE 15 END | CASE WHEN cl <= elapsed_ns THEN 0 ELSE 2 END AS attribution_flags, k FROM b1)"""


def polls_table(t):
    """The rebuilt polls, written once as the ingest job does."""
    return cut_lineage(rebuild.polls(t.events()))


def lanes(t, polls=None):
    slot = rebuild.time_slot(t.span_events())
    segmented = op.close_segments(t.span_events(), slot)
    return op.pairing_lanes(segmented, polls_table(t) if polls is None else polls, slot)


def pairs(t, polls=None):
    return op.pair_lifo(lanes(t, polls), [*op.SPAN, "lane"], rebuild.time_slot(t.span_events()))


def built(t):
    return op.spans_enter_exit(t.span_events(), polls_table(t))


@query("close_segments", f"WITH {SEGD} SELECT seq, source_key, span_id, kind, segment FROM sg")
def _(t):
    return op.close_segments(t.span_events()).select("seq", "source_key", "span_id", "kind", "segment")


@query("pairing_lane", f"WITH {LANES} SELECT seq, kind, lane FROM lanes")
def _(t):
    return lanes(t).select("seq", "kind", "lane")


@query("pair_lifo", f"WITH {PAIR} SELECT * FROM pairs")
def _(t):
    return pairs(t)


@query("union_duration", f"WITH {PAIR}, {UNION_IV} SELECT {K3}, sum(end_ns - start_ns)::bigint AS union_ns FROM ent GROUP BY {K3}")
def _(t):
    done = cut_lineage(pairs(t)).filter("state = 'paired'")
    return rebuild.union_duration(done, op.SPAN)


@query("spans_enter_exit", f"WITH {BUILT} SELECT * FROM built")
def _(t):
    return built(t).withColumn("k", F.col("attributes")["k"]).drop("attributes")


@query("span_accounting", f"""WITH {BUILT} SELECT name, count(*) AS n, count(*) FILTER (concurrent) AS concurrent, sum(elapsed_ns)::bigint AS elapsed_ns, coalesce(sum(on_cpu_ns_est), 0)::bigint AS on_cpu_ns,
 coalesce(sum(async_wait_ns), 0)::bigint AS async_wait_ns, sum(unknown_ns)::bigint AS unknown_ns, count(*) FILTER (attribution_flags & 2 = 2) AS degraded FROM built GROUP BY name""")
def _(t):
    return built(t).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("concurrent").alias("concurrent"), F.sum("elapsed_ns").alias("elapsed_ns"),
        F.coalesce(F.sum("on_cpu_ns_est"), F.lit(0)).alias("on_cpu_ns"), F.coalesce(F.sum("async_wait_ns"), F.lit(0)).alias("async_wait_ns"),
        F.sum("unknown_ns").alias("unknown_ns"), F.count_if(F.col("attribution_flags").bitwiseAND(2) == 2).alias("degraded"))


@query("on_cpu_split", f"WITH {BUILT} SELECT {K3}, on_cpu_ns_est, async_wait_ns FROM built WHERE on_cpu_ns_est IS NOT NULL")
def _(t):
    return built(t).filter("on_cpu_ns_est is not null").select(*op.SPAN, "on_cpu_ns_est", "async_wait_ns")


CUT = PAIR + f""", raw AS (SELECT {K3}, start_ns, end_ns, lane AS task_id, enter_seq FROM pairs WHERE state = 'paired' AND lane > 0),
cut AS (SELECT r.enter_seq, greatest(r.start_ns, p.start_ns) AS start_ns, least(r.end_ns, p.end_ns) AS end_ns FROM raw r JOIN polls p ON p.source_key = r.source_key AND p.task_id = r.task_id AND p.start_ns < r.end_ns AND p.end_ns > r.start_ns)"""


def tasked(t, polls):
    done = cut_lineage(pairs(t, polls)).filter("state = 'paired' and lane > 0")
    return done.select(*op.SPAN, "start_ns", "end_ns", F.col("lane").alias("task_id"), "enter_seq")


@query("interval_intersect", f"WITH {CUT} SELECT * FROM cut")
def _(t):
    polls = polls_table(t)
    return op.overlap_time(tasked(t, polls), polls).select(
        "enter_seq", F.col("cut_start").alias("start_ns"), F.col("cut_end").alias("end_ns"))


@query("span_active_segments", f"""WITH {CUT} SELECT enter_seq, start_ns, end_ns, true AS cut FROM cut
UNION ALL SELECT enter_seq, start_ns, end_ns, false FROM raw WHERE enter_seq NOT IN (SELECT enter_seq FROM cut)""")
def _(t):
    polls = polls_table(t)
    return op.active_segments(tasked(t, polls), polls, ["enter_seq"])


SINGLE = """se AS (SELECT seq, name, host, source_key, worker_id, CASE WHEN task_id % 3 = 0 THEN task_id END AS task_id,
  CASE name WHEN 'click' THEN ts_ns - k * 1000000000 ELSE ts_ns END AS start_ns, CASE name WHEN 'click' THEN ts_ns WHEN 'view' THEN ts_ns + k * 1000000000 WHEN 'error' THEN ts_ns + seq * 1000000 END AS end_ns FROM v_custom),
single AS (SELECT * FROM se WHERE start_ns IS NOT NULL AND end_ns IS NOT NULL)"""


def single_events(t):
    """Views carry start and duration, clicks duration and end, errors start and end, the rest only a start."""
    c, ts = t.custom(), F.col("ts_ns")
    return c.select(
        "seq", "name", "host", "source_key", "worker_id", F.when(F.col("task_id") % 3 == 0, F.col("task_id")).alias("task_id"),
        F.when(F.col("name") != "click", ts).alias("span_start"),
        F.when(F.col("name") == "click", ts).when(F.col("name") == "error", ts + F.col("seq") * 1_000_000).alias("span_end"),
        F.when(F.col("name").isin("view", "click"), F.col("k")).alias("duration"))


@query("spans_single_event", f"""WITH {CLOSED}, {SINGLE} SELECT s.seq, s.name, s.start_ns, s.end_ns, coalesce(s.task_id, p.task_id) AS task_id
FROM single s LEFT JOIN polls p ON p.source_key = s.source_key AND p.worker_id = s.worker_id AND p.start_ns <= s.start_ns AND s.start_ns < p.end_ns""")
def _(t):
    out = op.spans_single_event(single_events(t), rebuild.polls(t.events()), 1_000_000_000)
    return out.select("seq", "name", "start_ns", "end_ns", "task_id")


THREADS = f"""{CLOSED}, {GAPS}, {BIND}, {SINGLE}, th AS (SELECT s.* REPLACE (CASE WHEN s.seq % 2 = 0 THEN s.worker_id END AS worker_id), 1000 + s.worker_id * 10 AS tid FROM single s),
tb AS (SELECT t.*, b.worker_id AS bound, EXISTS (SELECT 1 FROM gaps g WHERE g.source_key = t.source_key AND (g.from_tid = t.tid OR g.to_tid = t.tid) AND g.start_ns <= t.start_ns AND t.start_ns < g.end_ns) AS passing
 FROM th t ASOF LEFT JOIN bind b ON b.source_key = t.source_key AND b.tid = t.tid AND b.from_ns <= t.start_ns)"""


@query("spans_single_event_threads", f"""WITH {THREADS} SELECT s.seq, s.name, s.start_ns, s.end_ns, coalesce(s.worker_id, bound) AS worker_id, coalesce(s.task_id, CASE WHEN NOT passing THEN p.task_id END) AS task_id
FROM tb s LEFT JOIN polls p ON p.source_key = s.source_key AND p.worker_id = coalesce(s.worker_id, bound) AND p.start_ns <= s.start_ns AND s.start_ns < p.end_ns""")
def _(t):
    """Every second event names only its thread."""
    told = single_events(t).withColumn("tid", (F.lit(1000) + F.col("worker_id") * 10).cast("int")).withColumn("worker_id", F.when(F.col("seq") % 2 == 0, F.col("worker_id")))
    out = op.spans_single_event(told, rebuild.polls(t.events()), 1_000_000_000, t.events())
    return out.select("seq", "name", "start_ns", "end_ns", "worker_id", "task_id")


INNER = f"""{CLOSED}, {SINGLE}, inn AS (SELECT p.source_key, s.name, s.seq, p.seq AS poll_seq FROM single s JOIN polls p ON p.source_key = s.source_key AND p.worker_id = s.worker_id AND s.start_ns >= p.start_ns AND s.end_ns <= p.end_ns)"""


def inside(t, polls=None):
    return op.spans_inside_polls(op.spans_single_event(single_events(t), None, 1_000_000_000), polls_table(t) if polls is None else polls)


@query("inner_spans_of_poll", f"WITH {INNER} SELECT source_key, poll_seq, name, count(*) AS n FROM inn GROUP BY 1, 2, 3")
def _(t):
    return inside(t).groupBy("source_key", "poll_seq", "name").agg(F.count(F.lit(1)).alias("n"))


@query("parent_resolve", f"""WITH {BUILT}, ch AS (SELECT * FROM built WHERE parent_span_id > 0), pr AS (SELECT source_key, span_id AS pid, segment AS parent_segment, start_ns AS parent_start FROM built)
SELECT c.{K3.replace(', ', ', c.')}, c.parent_span_id, p.parent_segment, p.parent_start FROM ch c LEFT JOIN LATERAL (SELECT * FROM pr WHERE pr.source_key = c.source_key AND pr.pid = c.parent_span_id AND pr.parent_start <= c.start_ns
 ORDER BY parent_start DESC, parent_segment DESC LIMIT 1) p ON true""")
def _(t):
    return op.resolve_parents(cut_lineage(built(t))).select(*op.SPAN, "parent_span_id", "parent_segment", "parent_start")


@query("span_identity", f"""WITH {SEGD} SELECT DISTINCT md5(concat('abcd-', source_key, chr(0), span_id, '-', segment)) AS span_uid, md5(concat('tracing', chr(0), 'svc', chr(0), span_name, chr(0), 'src/a.rs', chr(0), span_id)) AS span_type_uid FROM sg""")
def _(t):
    s = op.close_segments(t.span_events())
    return s.select(
        op.span_identity(F.concat(F.lit("abcd-"), "source_key"), F.concat(F.col("span_id").cast("string"), F.lit("-"), F.col("segment").cast("string"))).alias("span_uid"),
        op.span_type_identity(F.lit("tracing"), F.lit("svc"), F.col("span_name"), F.lit("src/a.rs"), F.col("span_id")).alias("span_type_uid")).distinct()


@query("span_name_parse", """WITH n AS (SELECT seq, CASE WHEN span_id % 5 = 0 THEN concat('SpanEnter__', span_name) WHEN span_id % 7 = 0 THEN span_name ELSE concat('SpanEnter:svc::mod', span_id, '::', span_name, ':src/', span_name, '.rs:', span_id) END AS s,
 span_id, span_name FROM v_span_events)
SELECT seq, CASE WHEN s LIKE 'SpanEnter:%' THEN concat('svc::mod', span_id) END AS target, CASE WHEN s LIKE 'SpanEnter%' THEN span_name END AS name,
 CASE WHEN s LIKE 'SpanEnter:%' THEN concat('src/', span_name, '.rs') END AS file, CASE WHEN s LIKE 'SpanEnter:%' THEN span_id::int END AS line FROM n""")
def _(t):
    sid, name = F.col("span_id"), F.col("span_name")
    schema = (F.when(sid % 5 == 0, F.concat(F.lit("SpanEnter__"), name)).when(sid % 7 == 0, name)
              .otherwise(F.concat(F.lit("SpanEnter:svc::mod"), sid.cast("string"), F.lit("::"), name, F.lit(":src/"), name, F.lit(".rs:"), sid.cast("string"))))
    parts = op.parse_span_schema(schema)
    return t.span_events().select("seq", *[c.alias(k) for k, c in parts.items()])


# Filters

@query("attr_filter", "SELECT host, count(*) AS n FROM v_spans WHERE attr_status = 'F' AND attr_segment = 'BUILDING' GROUP BY host")
def _(t):
    return op.attr_filter(t.spans(), ["status=F", "segment=BUILDING"]).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


WIN = (852_076_800_000_000_000, 915_148_800_000_000_000)


@query("span_row_scope", f"SELECT host, count(*) AS n, sum(elapsed_ns)::bigint AS elapsed_ns FROM v_spans WHERE end_ns >= {WIN[0]} AND end_ns < {WIN[1]} GROUP BY host")
def _(t):
    return op.span_row_scope(t.spans(), *WIN).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ns").alias("elapsed_ns"))


@query("span_text_filter", """WITH r AS (SELECT *, list(elapsed_ns) OVER (PARTITION BY name) AS l FROM v_spans), f AS (SELECT name, list_sort(any_value(l)) AS s FROM r GROUP BY name)
SELECT v.name, count(*) AS n, min(elapsed_ns) AS shortest FROM v_spans v JOIN f USING (name) WHERE elapsed_ns >= s[1 + cast(floor(len(s) * 90 / 100) AS bigint)]
 AND (contains(lower(v.name), 'build') OR contains(lower(attr_segment), 'build') OR contains(lower(attr_status), 'build') OR contains(lower(attr_cust), 'build')) GROUP BY v.name""")
def _(t):
    return op.span_text_filter(t.spans(), "Build", 90).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("elapsed_ns").alias("shortest"))


@query("percentile_rank", "SELECT span_id, name, cast(floor(cume_dist() OVER (PARTITION BY name ORDER BY elapsed_ns) * 100 + 0.5) AS bigint) AS pct FROM v_spans")
def _(t):
    return op.percentile_rank(t.spans()).select("span_id", "name", "pct")


@query("visible_spans", "SELECT source_key, span_id, name FROM v_spans s WHERE parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM v_spans p WHERE p.source_key = s.source_key AND p.span_id = s.parent_span_id)")
def _(t):
    return op.root_spans(t.spans()).select("source_key", "span_id", "name")


@query("group_by_field_value", "SELECT attr_cust AS who, count(*) AS n, count(DISTINCT worker_id) AS workers, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM v_spans GROUP BY 1")
def _(t):
    return t.spans().groupBy(F.col("attributes")["cust"].alias("who")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("worker_id").alias("workers"), F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))


@query("trace_request", "SELECT source_key, span_id, worker_id, start_ns, end_ns FROM v_spans WHERE attr_cust = 'c7'")
def _(t):
    return op.by_field_value(t.spans(), "cust", "c7").select("source_key", "span_id", "worker_id", "start_ns", "end_ns")


# Statistics

BUCKET = "CASE WHEN elapsed_ns = 0 THEN -1 ELSE cast(floor(log2(elapsed_ns) * 4) AS bigint) END"
H = f"""h AS (SELECT span_type_uid, {BUCKET} AS bucket, count(*) AS n FROM v_spans GROUP BY 1, 2),
hb AS (SELECT *, CASE WHEN bucket = -1 THEN 0 ELSE cast(round(pow(2, bucket / 4.0)) AS bigint) END AS lo_ns, CASE WHEN bucket = -1 THEN 1 ELSE cast(round(pow(2, (bucket + 1) / 4.0)) AS bigint) END AS hi_ns FROM h),
hc AS (SELECT *, sum(n) OVER (PARTITION BY span_type_uid ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY span_type_uid) AS tot,
  CASE WHEN bucket = -1 THEN 0 ELSE cast(round((pow(2, bucket / 4.0) + pow(2, (bucket + 1) / 4.0)) / 2) AS bigint) END AS mid FROM hb)"""


@query("span_histogram", f"WITH {H} SELECT span_type_uid, bucket, n, lo_ns, hi_ns FROM hb")
def _(t):
    return op.span_histogram(t.spans())


@query("hist_percentile", f"WITH {H} SELECT span_type_uid, " + ", ".join(f"min(mid) FILTER (cum >= ceil({p} / 100.0 * tot)) AS p{str(p).replace('.', '_')}" for p in (50, 95, 99, 99.9)) + " FROM hc GROUP BY 1")
def _(t):
    return op.histogram_percentiles(op.span_histogram(t.spans()), {"p50": 50, "p95": 95, "p99": 99, "p99_9": 99.9})


@query("span_stats", f"""WITH {H}, pc AS (SELECT span_type_uid, min(mid) FILTER (cum >= ceil(0.5 * tot)) AS p50_ns, min(mid) FILTER (cum >= ceil(0.95 * tot)) AS p95_ns, min(mid) FILTER (cum >= ceil(0.99 * tot)) AS p99_ns FROM hc GROUP BY 1)
SELECT span_type_uid, min(name) AS name, count(*) AS n, min(elapsed_ns) AS min_ns, max(elapsed_ns) AS max_ns, min(p50_ns) AS p50_ns, min(p95_ns) AS p95_ns, min(p99_ns) AS p99_ns,
 count(*) FILTER (details_complete) AS complete, count(*) FILTER (NOT details_complete) AS partial, 0::bigint AS types_overflow FROM v_spans JOIN pc USING (span_type_uid) GROUP BY 1""")
def _(t):
    return op.span_stats(t.spans())


@query("hist_percentile_interp", f"""WITH {H} SELECT span_type_uid, {", ".join(f"cast(min(floor(greatest(lo_ns, 1) * pow(hi_ns / greatest(lo_ns, 1), greatest(0.0, least(1.0, ({p} / 100.0 * tot - (cum - n)) / n))) + 0.5)) FILTER (cum >= {p} / 100.0 * tot) AS bigint) AS p{p}" for p in (50, 90, 99))} FROM hc GROUP BY 1""")
def _(t):
    return op.histogram_percentiles_interpolated(op.span_histogram(t.spans()), {"p50": 50, "p90": 90, "p99": 99})


@query("percentile_for_duration", f"""WITH {H} SELECT span_type_uid, round(sum(CASE WHEN 250000000 >= hi_ns THEN n WHEN 250000000 <= lo_ns THEN 0 ELSE n * ln(250000000.0 / lo_ns) / ln(hi_ns / lo_ns) END) / sum(n) * 100, 6) AS pct FROM hb GROUP BY 1""")
def _(t):
    return op.percentile_of_duration(op.span_histogram(t.spans()), 250_000_000).withColumn("pct", F.round("pct", 6))


@query("count_in_band", f"WITH {H} SELECT span_type_uid, coalesce(sum(n) FILTER (hi_ns > 100000000 AND lo_ns < 300000000), 0)::bigint AS n FROM hb GROUP BY 1")
def _(t):
    return op.count_in_band(op.span_histogram(t.spans()), 100_000_000, 300_000_000)


@query("span_quality", "SELECT span_type_uid, round(count(*) FILTER (details_complete) / count(*), 9) AS quality FROM v_spans GROUP BY 1")
def _(t):
    return op.span_quality(op.span_stats(t.spans())).withColumn("quality", F.round("quality", 9))


@query("time_composition", """SELECT span_type_uid, sum(on_cpu_ns_est)::bigint AS on_cpu_ns_est, 0::bigint AS blocked_ns_est, sum(coalesce(async_wait_ns, 0))::bigint AS async_wait_ns,
 0::bigint AS scheduler_delay_ns, sum(unknown_ns)::bigint AS unknown_ns FROM v_spans GROUP BY 1""")
def _(t):
    return op.time_composition(t.spans())


COMP = f"""r AS (SELECT span_type_uid, {BUCKET} AS bucket, on_cpu_ns_est AS a, coalesce(async_wait_ns, 0) AS w, unknown_ns AS u, on_cpu_ns_est + coalesce(async_wait_ns, 0) + unknown_ns AS tot FROM v_spans),
comp AS (SELECT span_type_uid, bucket, cast(round(pow(2, bucket / 4.0)) AS bigint) AS lo_ns, cast(round(pow(2, (bucket + 1) / 4.0)) AS bigint) AS hi_ns, sum(a)::bigint AS a, sum(w)::bigint AS w, sum(u)::bigint AS u,
  count(*) FILTER (tot > 0) AS instances, sum(a / tot) AS af, sum(w / tot) AS wf, sum(u / tot) AS uf FROM r GROUP BY 1, 2)"""


@query("composition_hist", f"""WITH {COMP} SELECT span_type_uid, bucket, lo_ns, hi_ns, a AS on_cpu_ns_est, w AS async_wait_ns, u AS unknown_ns, instances, round(af, 6) AS on_cpu_frac, round(wf, 6) AS async_frac, round(uf, 6) AS unknown_frac FROM comp""")
def _(t):
    c = op.composition_histogram(t.spans())
    return c.select("span_type_uid", "bucket", "lo_ns", "hi_ns", "on_cpu_ns_est", "async_wait_ns", "unknown_ns", "instances",
                    F.round("on_cpu_ns_est_frac", 6).alias("on_cpu_frac"), F.round("async_wait_ns_frac", 6).alias("async_frac"), F.round("unknown_ns_frac", 6).alias("unknown_frac"))


@query("band_composition", f"""WITH {COMP} SELECT span_type_uid, sum(instances)::bigint AS instances, (sum(a) + sum(w) + sum(u))::bigint AS total_ns, round(sum(af) / sum(instances), 6) AS on_cpu_share,
 round(sum(wf) / sum(instances), 6) AS async_share, round(sum(uf) / sum(instances), 6) AS unknown_share FROM comp WHERE hi_ns > 100000000 AND lo_ns < 300000000 GROUP BY 1""")
def _(t):
    b = op.band_composition(op.composition_histogram(t.spans()), 100_000_000, 300_000_000)
    return b.select("span_type_uid", "instances", "total_ns", F.round("on_cpu_ns_est_share", 6).alias("on_cpu_share"),
                    F.round("async_wait_ns_share", 6).alias("async_share"), F.round("unknown_ns_share", 6).alias("unknown_share"))


@query("attribute_facets", """WITH a AS (SELECT span_type_uid, span_uid, start_ns, unnest(['status', 'segment', 'cust']) AS key, unnest([attr_status, attr_segment, attr_cust]) AS value FROM v_spans),
v AS (SELECT span_type_uid, key, value, count(*) AS n, min(start_ns) AS seen FROM a GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY span_type_uid, key ORDER BY seen, value) AS rn FROM v)
SELECT span_type_uid, key, sum(n)::bigint AS occurrences, count(*) AS distinct_values, count(*) > 10 AS high_cardinality, 0::bigint AS keys_overflow, array_to_string(list(value ORDER BY rn) FILTER (rn <= 10), ',') AS first_values FROM r GROUP BY 1, 2""")
def _(t):
    return op.attribute_facets(t.spans()).withColumn("first_values", F.array_join("first_values", ","))


@query("span_exemplars", """SELECT span_type_uid, span_uid, elapsed_ns, attr_status AS status, rank FROM (SELECT *, row_number() OVER (PARTITION BY span_type_uid ORDER BY elapsed_ns DESC, start_ns, span_uid) AS rank
 FROM v_spans WHERE elapsed_ns BETWEEN 100000000 AND 400000000) WHERE rank <= 5""")
def _(t):
    return op.span_exemplars(t.spans(), 5, 100_000_000, 400_000_000).select("span_type_uid", "span_uid", "elapsed_ns", F.col("attributes")["status"].alias("status"), "rank")


@query("exemplar_only", """WITH s AS (SELECT * FROM v_spans WHERE span_type_uid = md5('5-LOW')), c AS (SELECT count(*) AS n, count(*) FILTER (elapsed_ns >= 100000000) AS in_band FROM s)
SELECT span_type_uid, span_uid, start_ns, elapsed_ns, n, in_band, row_number() OVER (ORDER BY elapsed_ns DESC, start_ns, span_uid) AS rank FROM s, c WHERE elapsed_ns >= 100000000 ORDER BY rank LIMIT 5""")
def _(t):
    uid = t.spans().filter("name = '5-LOW'").select("span_type_uid").first()[0]
    return op.exemplar_summary(t.spans(), uid, 100_000_000)


@query("degenerate_columns", """SELECT c AS "column", CASE c WHEN 'kind' THEN true WHEN 'name' THEN (SELECT count(DISTINCT name) = 1 FROM v_spans) ELSE (SELECT count(DISTINCT coalesce(parent_span_id::varchar, '')) = 1 FROM v_spans) END AS degenerate
FROM (SELECT unnest(['kind', 'name', 'parent_span_id']) AS c)""")
def _(t):
    return op.degenerate_columns(t.spans().withColumn("kind", F.lit("tracing")), ["kind", "name", "parent_span_id"])


@query("sort_span_types", "SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS rank FROM v_spans GROUP BY name")
def _(t):
    return op.ranked_span_types(t.spans())


@query("span_type_label", "SELECT concat(name, ' (', host, '.rs:', worker_id, ')') AS label, count(*) AS n FROM v_spans GROUP BY 1")
def _(t):
    label = op.span_type_label(F.col("name"), F.concat(F.lit("src/x/"), "host", F.lit(".rs")), F.col("worker_id"))
    return t.spans().groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Joins with samples and polls

def span_samples(t):
    s = t.samples().filter("worker_id is not null")
    sid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return s.select(sid.alias("sample_id"), "ts_ns", (F.col("worker_id") % 4).cast("int").alias("worker_id"), "source")


SID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
HITS = f"""hits AS (SELECT {SID} AS sample_id, x.source, s.span_uid, s.source_key, s.span_id FROM v_samples x JOIN v_spans s ON x.worker_id % 4 = s.worker_id AND x.ts_ns >= s.start_ns AND x.ts_ns < s.end_ns)"""


@query("point_in_overlapping_intervals", f"WITH {HITS} SELECT span_uid, count(*) FILTER (source = 0) AS cpu_samples, count(*) FILTER (source = 1) AS sched_samples FROM hits GROUP BY 1")
def _(t):
    return op.samples_per_span(span_samples(t), t.spans().select("span_uid", "worker_id", "start_ns", "end_ns"))


DEPTH = """dep AS (SELECT s.source_key, s.span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth FROM v_spans s WHERE parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM v_spans p WHERE p.source_key = s.source_key AND p.span_id = s.parent_span_id)
 UNION ALL SELECT s.source_key, s.span_id, d.depth + 1 FROM v_spans s JOIN dep d ON s.source_key = d.source_key AND s.parent_span_id = d.span_id)"""


@query("enclosing_spans", f"""WITH RECURSIVE {DEPTH}, {HITS} SELECT source_key, span_id, depth, count(*) AS samples, min(sample_id) AS first_sample FROM hits JOIN dep USING (source_key, span_id) GROUP BY 1, 2, 3""")
def _(t):
    spans = t.spans()
    return op.enclosing_spans(span_samples(t), spans).join(op.span_depth(spans), ["source_key", "span_id"]).select(
        "source_key", "span_id", "depth", "samples", "first_sample")


@query("interval_overlap", """SELECT source_key, span_id FROM v_spans s WHERE EXISTS (SELECT 1 FROM v_polls p WHERE p.worker_id = s.worker_id AND p.start_ns < s.end_ns AND p.end_ns > s.start_ns)""")
def _(t):
    spans = t.spans().select("source_key", "span_id", "worker_id", "start_ns", "end_ns")
    return op.overlapping_any(spans, t.polls(), ["worker_id"]).select("source_key", "span_id")


@query("overlapping_spans", """WITH s AS (SELECT * FROM v_spans WHERE name = '1-URGENT' ORDER BY elapsed_ns DESC, start_ns, span_uid LIMIT 1)
SELECT v.source_key, v.span_id, v.name FROM v_spans v, s WHERE v.start_ns < s.end_ns AND v.end_ns > s.start_ns AND v.span_uid <> s.span_uid""")
def _(t):
    return op.overlapping_slowest(t.spans(), "1-URGENT").select("source_key", "span_id", "name")


# Hierarchies

@query("span_depth", f"WITH RECURSIVE {DEPTH} SELECT * FROM dep")
def _(t):
    return op.span_depth(t.spans())


@query("span_tree", """SELECT s.source_key, s.span_id, s.name, s.elapsed_ns, coalesce(c.n, 0) AS children, coalesce(c.ns, 0)::bigint AS children_ns FROM v_spans s
LEFT JOIN (SELECT source_key, parent_span_id, count(*) AS n, sum(elapsed_ns) AS ns FROM v_spans GROUP BY 1, 2) c ON c.source_key = s.source_key AND c.parent_span_id = s.span_id""")
def _(t):
    return op.span_tree(t.spans())


@query("descendants", """WITH RECURSIVE d AS (SELECT source_key, span_id FROM v_spans WHERE span_id IN (3, 7) UNION SELECT s.source_key, s.span_id FROM v_spans s JOIN d ON s.source_key = d.source_key AND s.parent_span_id = d.span_id) SELECT * FROM d""")
def _(t):
    spans = t.spans()
    return op.descendants(spans, spans.filter(F.col("span_id").isin(3, 7)))


@query("span_ancestry", """WITH RECURSIVE w AS (SELECT source_key, span_id, start_ns + 1 AS t, span_id AS cur, parent_span_id AS up, 0 AS steps FROM v_spans
 UNION ALL SELECT w.source_key, w.span_id, w.t, p.span_id, p.parent_span_id, w.steps + 1 FROM w JOIN v_spans p ON p.source_key = w.source_key AND p.span_id = w.up AND p.start_ns <= w.t AND p.end_ns >= w.t)
SELECT source_key, span_id, t, arg_max(cur, steps) AS outermost, max(steps)::bigint AS steps FROM w GROUP BY 1, 2, 3""")
def _(t):
    spans = t.spans()
    return op.ancestry_at(spans, spans.select("source_key", "span_id", (F.col("start_ns") + 1).alias("t")))


@query("wake_chain", """WITH l AS (SELECT source_key, task_id, arg_max(waker_task_id, ts_ns) AS waker FROM v_events WHERE kind = 'Wake' GROUP BY 1, 2)
SELECT a.source_key, a.task_id, a.waker AS w1, b.waker AS w2, c.waker AS w3, d.waker AS w4, e.waker AS w5 FROM l a LEFT JOIN l b ON b.source_key = a.source_key AND b.task_id = a.waker LEFT JOIN l c ON c.source_key = b.source_key AND c.task_id = b.waker LEFT JOIN l d ON d.source_key = c.source_key AND d.task_id = c.waker LEFT JOIN l e ON e.source_key = d.source_key AND e.task_id = d.waker""")
def _(t):
    return op.wake_chain(t.events().filter("kind = 'Wake'"))
