"""Object keys, segments and whole-trace row operators."""

from pyspark.sql import functions as F

from spoor.catalog.registry import query
from spoor.catalog.sinks import scratch
from spoor.operators import events as ev
from spoor.operators.ingest import read_events
from spoor.sources import keys as op

T0, T1 = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000
V1 = r"(^|/)version=1/date=(\d{4}-\d{2}-\d{2})/service=([^/]*)/time=(\d{4})/instance=([^/]*)/boot=([^/]*)/[^/]*$"
WB = r"(^|/)(\d{4}-\d{2}-\d{2})/(\d{4})/([^/]*)/([^/]*)/([^/]*)/[^/]*$"
NB = r"(^|/)(\d{4}-\d{2}-\d{2})/(\d{4})/([^/]*)/([^/]*)/[^/]*$"
PARSED = rf"""kp AS (SELECT *, regexp_replace(key, '^s3://[^/]*/', '') AS p FROM v_keys),
kl AS (SELECT *, CASE WHEN regexp_matches(p, '{V1}') THEN 'version1' WHEN regexp_matches(p, '{WB}') THEN 'positional_with_boot' WHEN regexp_matches(p, '{NB}') THEN 'positional_without_boot' ELSE 'unknown' END AS layout,
  split_part(p, '/', -1) AS filename FROM kp),
k AS (SELECT seq, key, size, modified_s, layout, filename,
  CASE layout WHEN 'version1' THEN regexp_extract(p, '{V1}', 2) WHEN 'positional_with_boot' THEN regexp_extract(p, '{WB}', 2) WHEN 'positional_without_boot' THEN regexp_extract(p, '{NB}', 2) END AS date,
  CASE layout WHEN 'version1' THEN regexp_extract(p, '{V1}', 4) WHEN 'positional_with_boot' THEN regexp_extract(p, '{WB}', 3) WHEN 'positional_without_boot' THEN regexp_extract(p, '{NB}', 3) END AS time,
  CASE layout WHEN 'version1' THEN url_decode(regexp_extract(p, '{V1}', 3)) WHEN 'positional_with_boot' THEN regexp_extract(p, '{WB}', 4) WHEN 'positional_without_boot' THEN regexp_extract(p, '{NB}', 4) END AS service,
  CASE layout WHEN 'version1' THEN regexp_extract(p, '{V1}', 5) WHEN 'positional_with_boot' THEN regexp_extract(p, '{WB}', 5) WHEN 'positional_without_boot' THEN regexp_extract(p, '{NB}', 5) END AS instance,
  CASE layout WHEN 'version1' THEN regexp_extract(p, '{V1}', 6) WHEN 'positional_with_boot' THEN regexp_extract(p, '{WB}', 6) END AS boot_id,
  CASE WHEN regexp_matches(filename, '^\d+-\d+\.bin(\.gz)?$') THEN cast(regexp_extract(filename, '^(\d+)-', 1) AS bigint) END AS epoch_secs,
  CASE WHEN regexp_matches(filename, '^\d+-\d+\.bin(\.gz)?$') THEN cast(regexp_extract(filename, '-(\d+)\.', 1) AS bigint) END AS segment_index, p FROM kl)"""
SEGKEY = r"regexp_matches(key, '\.bin(\.gz)?$') AND NOT regexp_matches(key, '/samples/|/dict/|/flamegraph-data/')"


def parsed(t):
    return op.parse_key(t.keys())


@query("parse_source_key", f"WITH {PARSED} SELECT * EXCLUDE (p) FROM k")
def _(t):
    return parsed(t)


@query("boot_id", rf"""WITH {PARSED} SELECT seq, CASE WHEN layout = 'version1' THEN boot_id ELSE coalesce(nullif(split_part(p, '/', -2), ''), '') END AS boot,
 CASE WHEN layout = 'version1' OR regexp_matches(split_part(p, '/', -2), '^[a-z]{{4}}-\d+$') THEN 'path' ELSE 'flat' END AS identity_quality FROM k""")
def _(t):
    return op.boot_identity(parsed(t)).select("seq", "boot", "identity_quality")


@query("trace_segment_pred", f"SELECT {SEGKEY} AS is_segment, count(*) AS n FROM v_keys GROUP BY 1")
def _(t):
    return t.keys().groupBy(op.is_trace_segment(F.col("key")).alias("is_segment")).agg(F.count(F.lit(1)).alias("n"))


SCOPED = f"SELECT key, size, instance FROM k WHERE layout <> 'unknown' AND {SEGKEY} AND instance IN ('h0', 'h2') AND (epoch_secs + 60) * 1000000000 > {T0} AND epoch_secs * 1000000000 < {T1}"


def scoped(t):
    return op.scope_filter(parsed(t).filter(op.is_trace_segment(F.col("key"))), None, ("h0", "h2"), T0, T1).select("key", "size", "instance")


@query("scope_filter", f"WITH {PARSED} {SCOPED}")
def _(t):
    return scoped(t)


LW = (T0, T0 + 5_400_000_000_000)


@query("list_segments", f"""WITH {PARSED} SELECT key, date, time FROM k WHERE epoch(strptime(date || ' ' || time, '%Y-%m-%d %H%M')) BETWEEN ({LW[0]} // 1000000000 - 120) // 60 * 60 AND ({LW[1]} // 1000000000 + 120) // 60 * 60""")
def _(t):
    return op.list_segments(parsed(t), *LW).select("key", "date", "time")


@query("list_segments_hourly", f"""WITH {PARSED} SELECT key FROM k WHERE epoch(date_trunc('hour', strptime(date || ' ' || time, '%Y-%m-%d %H%M'))) BETWEEN ({T0} // 1000000000 // 3600 - 1) * 3600 AND ({T1} // 1000000000 + 3600) // 3600 * 3600""")
def _(t):
    return op.list_segments(parsed(t), T0, T1).select("key")


@query("browse", f"WITH {PARSED} SELECT key, size, epoch_secs, false AS truncated FROM k WHERE service = 'svc1' AND epoch_secs BETWEEN {T0 // 10**9} AND {T1 // 10**9}")
def _(t):
    return op.browse(parsed(t), "svc1", T0, T1).select("key", "size", "epoch_secs", "truncated")


@query("list_services", f"WITH {PARSED} SELECT service, count(DISTINCT instance) AS hosts, count(*) AS objects FROM k WHERE service IS NOT NULL GROUP BY 1")
def _(t):
    return op.list_services(parsed(t))


@query("discover_layout", f"WITH {PARSED} SELECT service, date, bool_or(layout = 'version1') AS version1, bool_or(layout <> 'version1') AS historical FROM k WHERE layout <> 'unknown' GROUP BY 1, 2")
def _(t):
    return op.discover_layout(parsed(t))


@query("order_key", "SELECT key, md5(concat('1', key)) AS order_key FROM v_keys")
def _(t):
    return t.keys().select("key", op.order_key(F.col("key")).alias("order_key"))


RANKED = f"""m AS ({SCOPED}), c AS (SELECT *, md5(concat('1', key)) AS order_key, row_number() OVER (ORDER BY md5(concat('1', key)), key) AS rank FROM m)"""


@query("sampling_cap", f"WITH {PARSED}, {RANKED} SELECT key, order_key, rank FROM c")
def _(t):
    return op.sampled_files(scoped(t)).select("key", "order_key", "rank")


FOLDED = "fd AS (SELECT key FROM v_keys WHERE size < 3000)"


def folded(t):
    """Small files have been folded already."""
    return t.keys().filter(F.col("size") < 3000).select("key")


@query("unfolded", f"WITH {PARSED}, m AS ({SCOPED}), {FOLDED} SELECT key FROM m WHERE key NOT IN (SELECT key FROM fd)")
def _(t):
    return op.unfolded(scoped(t), folded(t)).select("key")


@query("folded_intersect", f"WITH {PARSED}, m AS ({SCOPED}), {FOLDED} SELECT key FROM m WHERE key IN (SELECT key FROM fd)")
def _(t):
    return op.folded_matching(scoped(t), folded(t)).select("key")


@query("coverage", f"""WITH {PARSED}, m AS ({SCOPED}), {FOLDED}, j AS (SELECT m.*, fd.key IS NOT NULL AS f FROM m LEFT JOIN fd USING (key))
SELECT count(*) AS files_matched, count(*) FILTER (f) AS files_folded, sum(size)::bigint AS bytes_matched, coalesce(sum(size) FILTER (f), 0)::bigint AS bytes_folded, count(DISTINCT instance) AS hosts_matched,
 count(DISTINCT instance) FILTER (f) AS hosts_folded, cast(sum(CASE WHEN f THEN cast(concat('0x', substr(md5(key), 1, 12)) AS hugeint) ELSE 0 END) AS varchar) AS folded_digest FROM j""")
def _(t):
    return op.coverage(scoped(t), folded(t))


@query("fold_errors", f"WITH {PARSED} SELECT count(*) AS errors, min(concat('no place for ', key)) AS sample FROM k WHERE layout = 'unknown'")
def _(t):
    lost = parsed(t).filter("layout = 'unknown'")
    return op.fold_errors(lost.select(F.concat(F.lit("no place for "), "key").alias("message")))


@query("segment_extents", f"""WITH {PARSED}, x AS (SELECT key, instance, epoch_secs * 1000000000 AS start_ns, CASE WHEN modified_s > epoch_secs THEN modified_s * 1000000000 ELSE epoch_secs * 1000000000 + 1000000000 END AS e FROM k WHERE epoch_secs > 0 AND instance IS NOT NULL),
y AS (SELECT *, lead(start_ns) OVER (PARTITION BY instance ORDER BY start_ns, key) AS nx FROM x) SELECT key, start_ns, e AS real_end_ns, CASE WHEN nx > start_ns AND nx < e THEN nx ELSE e END AS end_ns FROM y""")
def _(t):
    return op.segment_extents(parsed(t).filter("instance is not null")).select("key", "start_ns", "end_ns", "real_end_ns")


@query("host_rows", "SELECT service, host, count(*) AS segments, sum(size)::bigint AS total_bytes FROM v_segments GROUP BY 1, 2")
def _(t):
    return op.host_rows(t.segments())


@query("boot_transitions", """SELECT service, host, start_us, was AS from_boot, boot_id AS to_boot FROM (SELECT *, lag(boot_id) OVER (PARTITION BY service, host ORDER BY start_us) AS was FROM v_segments WHERE boot_id <> '') WHERE was <> boot_id""")
def _(t):
    return op.boot_transitions(t.segments())


@query("segment_gaps", """SELECT service, host, end_us AS gap_start, nx AS gap_end FROM (SELECT *, lead(start_us) OVER (PARTITION BY service, host ORDER BY start_us) AS nx FROM v_segments) WHERE nx > end_us""")
def _(t):
    return op.segment_gaps(t.segments())


U0, U1 = T0 // 1000, T1 // 1000


@query("segments_overlap", f"SELECT service, host, grain FROM v_segments WHERE start_us <= {U1} AND end_us > {U0}")
def _(t):
    return op.segments_overlapping(t.segments(), U0, U1).select("service", "host", "grain")


STEP = (U1 - U0) / 40


@query("density", f"""WITH s AS (SELECT *, greatest(start_us, {U0}) AS cs, least(end_us, {U1}) AS ce FROM v_segments), c AS (SELECT *, unnest(range(cast(floor((cs - {U0}) / {STEP}) AS bigint), least(cast(floor((ce - {U0}) / {STEP}) AS bigint), 39) + 1)) AS col FROM s WHERE ce > cs),
b AS (SELECT *, size / (end_us - start_us) * (least(ce, {U0} + (col + 1) * {STEP}) - greatest(cs, {U0} + col * {STEP})) AS b FROM c)
SELECT service, host, col, round(sum(b), 3) AS bytes FROM b WHERE b > 0 GROUP BY 1, 2, 3""")
def _(t):
    return op.density(t.segments(), U0, U1, 40).withColumn("bytes", F.round("bytes", 3))


@query("region_coverage", f"""SELECT service, host, CASE WHEN bool_or(size > 60000) THEN 'oversized' WHEN bool_or(size < 1000) THEN 'partial' ELSE 'complete' END AS coverage FROM v_segments WHERE end_us >= {U0} AND start_us <= {U1} GROUP BY 1, 2""")
def _(t):
    state = F.when(F.col("size") > 60000, "oversized").when(F.col("size") < 1000, "listed").otherwise("parsed")
    return op.region_coverage(t.segments().withColumn("state", state), U0, U1, ("service", "host"))


# Row operators

@query("read_events", "SELECT source_key, kind, count(*) AS n, min(ts_ns) AS first_ns, max(seq) AS last_seq FROM v_events GROUP BY 1, 2")
def _(t):
    folder = scratch(t)
    t.events().write.parquet(folder)
    return read_events(t.spark, folder).groupBy("source_key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("seq").alias("last_seq"))


@query("slice_trace", f"SELECT seq, kind, ts_ns FROM v_events WHERE kind = 'TaskTerminate' OR ts_ns BETWEEN {T0} AND {T1}")
def _(t):
    return ev.slice_trace(t.events(), T0, T1, keep=("TaskTerminate",)).select("seq", "kind", "ts_ns")


@query("slice_trace_relative", "SELECT seq FROM v_events WHERE kind = 'TaskTerminate' OR ts_ns - (SELECT min(ts_ns) FROM v_events) BETWEEN 0 AND 86400000000000")
def _(t):
    return ev.slice_trace(t.events(), 0, 86_400_000_000_000, True, ("TaskTerminate",)).select("seq")


@query("parse_time_filter", f"""SELECT seq FROM v_custom WHERE CASE WHEN name = 'view' AND k IS NOT NULL THEN ts_ns <= {T1} AND ts_ns + k * 3600000000000 >= {T0} ELSE name = 'error' OR ts_ns BETWEEN {T0} AND {T1} END""")
def _(t):
    own = (F.col("name") == "view") & F.col("k").isNotNull()
    rows = t.custom().select("seq", "ts_ns", F.col("name").alias("kind"), F.when(own, F.col("ts_ns")).alias("span_start"),
                             F.when(own, F.col("ts_ns") + F.col("k") * 3_600_000_000_000).alias("span_end"))
    return ev.load_range(rows, T0, T1, ("error",)).select("seq")


@query("foldable_samples", f"SELECT sample_id FROM v_cpu WHERE source <> 1 AND len(frames) > 0 AND t BETWEEN {T0} AND {T1}")
def _(t):
    return ev.foldable_samples(t.cpu(), T0, T1).select("sample_id")


@query("event_name_filter", "SELECT name, count(*) AS n FROM v_custom WHERE name IN ('click', 'error') GROUP BY 1")
def _(t):
    return ev.event_name_filter(t.custom(), ["click", "error", "SpanEnter:x"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("clock_align", """WITH s AS (SELECT *, CASE host WHEN 'h0' THEN ts_ns + 1000000000000 WHEN 'h1' THEN ts_ns - 1000000000 - seq ELSE -1 END AS rt FROM v_events),
o AS (SELECT source_key, arg_min(rt - ts_ns, ts_ns) FILTER (kind = 'TaskTerminate') AS off, min(ts_ns) AS lo FROM s GROUP BY 1)
SELECT seq, CASE WHEN off IS NOT NULL AND lo + off >= 0 THEN ts_ns + off ELSE ts_ns END AS wall_ns FROM s JOIN o USING (source_key)""")
def _(t):
    host, ts = F.col("host"), F.col("ts_ns")
    real = F.when(host == "h0", ts + 1_000_000_000_000).when(host == "h1", ts - 1_000_000_000 - F.col("seq")).otherwise(F.lit(-1))
    e = t.events().withColumn("realtime_ns", real).withColumn("kind", F.when(F.col("kind") == "TaskTerminate", "ClockSync").otherwise(F.col("kind")))
    return ev.clock_align(e).select("seq", "wall_ns")


@query("search", """WITH e AS (SELECT DISTINCT 'task' AS kind, spawn_loc AS label, spawn_loc AS prim, concat(spawn_loc, ' ', task_id) AS body, concat('t', lpad(task_id::varchar, 6, '0')) AS ord FROM v_events
 UNION ALL SELECT 'span', name, name, concat(name, ' status=', attr_status, ' segment=', attr_segment), concat('s', lpad(span_id::varchar, 12, '0')) FROM v_spans
 UNION ALL SELECT 'poi', kind, kind, concat(kind, ' w', worker_id), concat('p', lpad(seq::varchar, 12, '0')) FROM v_events),
h AS (SELECT *, CASE WHEN starts_with(lower(prim), 'lo') THEN 2 ELSE 1 END AS score FROM e WHERE contains(lower(body), 'lo')) SELECT kind, label, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, ord) AS rank FROM h) WHERE rank <= 8""")
def _(t):
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    tasks = t.events().select(
        F.lit("task").alias("kind"), F.col("spawn_loc").alias("label"), F.col("spawn_loc").alias("primary"),
        F.concat_ws(" ", "spawn_loc", F.col("task_id").cast("string")).alias("body"), F.concat(F.lit("t"), pad("task_id", 6)).alias("ord")).distinct()
    spans = t.spans().select(
        F.lit("span").alias("kind"), F.col("name").alias("label"), F.col("name").alias("primary"),
        F.concat(F.col("name"), F.lit(" status="), F.col("attributes")["status"], F.lit(" segment="), F.col("attributes")["segment"]).alias("body"),
        F.concat(F.lit("s"), pad("span_id", 12)).alias("ord"))
    points = t.events().select(
        F.lit("poi").alias("kind"), F.col("kind").alias("label"), F.col("kind").alias("primary"),
        F.concat(F.col("kind"), F.lit(" w"), F.col("worker_id").cast("string")).alias("body"), F.concat(F.lit("p"), pad("seq", 12)).alias("ord"))
    return ev.search(tasks.unionByName(spans).unionByName(points), "Lo").select("kind", "label", "ord", "score", "rank")


@query("union_traces", """WITH u AS (SELECT source_key, ts_ns, kind, worker_id FROM v_events UNION ALL SELECT source_key, ts_ns, name, worker_id FROM v_custom UNION ALL SELECT source_key, ts_ns, kind, NULL FROM v_span_events)
SELECT source_key, kind, count(*) AS n, count(worker_id) AS placed FROM u GROUP BY 1, 2""")
def _(t):
    u = ev.union_traces(
        t.events().select("source_key", "ts_ns", "kind", "worker_id"),
        t.custom().select("source_key", "ts_ns", F.col("name").alias("kind"), "worker_id"), t.span_events().select("source_key", "ts_ns", "kind"))
    return u.groupBy("source_key", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("worker_id").alias("placed"))


@query("shift_scope", """WITH b AS (SELECT spawn_loc, count(*) FILTER (ts_ns >= 1704672000000000000 AND ts_ns < 1705276800000000000) AS now_n, count(*) FILTER (ts_ns >= 1704672000000000000 - 604800000000000 AND ts_ns < 1705276800000000000 - 604800000000000) AS week_n FROM v_events GROUP BY 1) SELECT * FROM b""")
def _(t):
    inside = lambda lo, hi: (F.col("ts_ns") >= lo) & (F.col("ts_ns") < hi)
    week = [ev.shift_scope(F.lit(x), "week") for x in (T0, T1)]
    return t.events().groupBy("spawn_loc").agg(F.count_if(inside(T0, T1)).alias("now_n"), F.count_if(inside(*week)).alias("week_n"))
