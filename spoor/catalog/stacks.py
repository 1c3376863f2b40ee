"""Samples and flamegraphs."""

from pyspark.sql import functions as F

from spoor.catalog.registry import query
from spoor.operators import stacks as op

START, END = 852_076_800_000_000_000, 978_307_200_000_000_000  # 1997 up to 2001
PATHS = "(SELECT list_reverse(frames) AS r, count(*) AS n FROM v_samples JOIN v_stacks USING (stack_id) {} GROUP BY ALL)"
TREE = """tree AS (SELECT array_to_string(r[1:d], ';') AS path, d AS depth, r[d] AS name,
  CASE WHEN d > 1 THEN array_to_string(r[1:d-1], ';') END AS parent_path, cast(sum(n) AS bigint) AS samples,
  cast(sum(CASE WHEN d = len(r) THEN n ELSE 0 END) AS bigint) AS self_samples
  FROM (SELECT r, n, unnest(range(1, len(r) + 1)) AS d FROM paths) GROUP BY ALL)"""


def scoped(t):
    return op.facet_filter(op.time_range(t.samples(), START, END))


def resolved(t):
    return op.resolve_stacks(op.stack_counts(t.samples()), t.stacks())


SCOPE = f"WHERE source = 0 AND ts_ns >= {START} AND ts_ns < {END}"


@query("time_range", f"SELECT host, count(*) AS n, min(ts_ns) AS first, max(ts_ns) AS last FROM v_samples WHERE ts_ns >= {START} AND ts_ns < {END} GROUP BY host")
def _(t):
    return op.time_range(t.samples(), START, END).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"))


@query("facet_filter", """SELECT service, count(*) AS n FROM v_samples WHERE source = 1 AND worker_id IS NOT NULL AND spawn_location = 'ECONOMY' GROUP BY service""")
def _(t):
    kept = op.facet_filter(t.samples(), {"thread_class": "worker", "spawn_location": "ECONOMY"}, phase="blocking")
    return kept.groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("poll_band", "SELECT host, count(*) AS n FROM v_samples WHERE source = 0 AND poll_duration_ns BETWEEN 1000000 AND 20000000 GROUP BY host")
def _(t):
    return op.poll_band(op.facet_filter(t.samples()), 1_000_000, 20_000_000).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("span_member_filter", """SELECT host, count(*) AS n FROM v_samples
WHERE len([s for s in enclosing_spans if s.span_type_uid = md5('F') AND s.elapsed_ns >= 10000000 AND s.elapsed_ns <= 30000000]) > 0 GROUP BY host""")
def _(t):
    uid = "800618943025315f869e4e1f09471012"  # md5 of F
    return op.span_member_filter(t.samples(), uid, 10_000_000, 30_000_000).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("stack_counts", f"SELECT stack_id, count(*) AS samples, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM v_samples {SCOPE} GROUP BY stack_id")
def _(t):
    return op.stack_counts(scoped(t))


@query("sample_totals", f"SELECT count(*) AS total, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, greatest(count(DISTINCT host), 1) AS hosts FROM v_samples {SCOPE}")
def _(t):
    return op.sample_totals(scoped(t))


@query("stack_dict_join", f"SELECT array_to_string(frames, ';') AS stack, count(*) AS samples FROM v_samples JOIN v_stacks USING (stack_id) {SCOPE} GROUP BY 1")
def _(t):
    return op.resolve_stacks(op.stack_counts(scoped(t)), t.stacks()).select(F.array_join("frames", ";").alias("stack"), "samples")


@query("flamegraph_tree", f"WITH paths AS {PATHS.format(SCOPE)}, {TREE} SELECT * FROM tree")
def _(t):
    return op.flamegraph_tree(op.resolve_stacks(op.stack_counts(scoped(t)), t.stacks())).drop("id", "parent_id")


@query("flamegraph_weighted", """WITH paths AS (SELECT list_reverse(frames) AS r, count(*) AS n, sum(coalesce(poll_duration_ns, 0)) AS w
  FROM v_samples JOIN v_stacks USING (stack_id) GROUP BY ALL)
SELECT array_to_string(r[1:d], ';') AS path, d AS depth, cast(sum(n) AS bigint) AS samples, cast(sum(w) AS bigint) AS poll_ns,
  cast(sum(CASE WHEN d = len(r) THEN w ELSE 0 END) AS bigint) AS self_poll_ns
FROM (SELECT r, n, w, unnest(range(1, len(r) + 1)) AS d FROM paths) GROUP BY path, d""")
def _(t):
    counts = t.samples().groupBy("stack_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.coalesce("poll_duration_ns", F.lit(0))).alias("poll_ns"))
    tree = op.flamegraph_tree(op.resolve_stacks(counts, t.stacks()), ("samples", "poll_ns"))
    return tree.select("path", "depth", "samples", "poll_ns", "self_poll_ns")


@query("flamegraph_flat_layout", f"""WITH RECURSIVE paths AS {PATHS.format("")}, {TREE},
offs AS (SELECT *, coalesce(sum(samples) OVER (PARTITION BY parent_path ORDER BY samples DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM tree),
tot AS (SELECT sum(samples) AS total FROM tree WHERE depth = 1),
lay AS (SELECT path, depth, name, samples, self_samples, o AS x FROM offs WHERE depth = 1
  UNION ALL SELECT c.path, c.depth, c.name, c.samples, c.self_samples, p.x + c.o FROM lay p JOIN offs c ON c.parent_path = p.path)
SELECT path, depth, name, samples, self_samples, round(x / total, 9) AS x, round(samples / total, 9) AS w FROM lay, tot""")
def _(t):
    lay = op.flat_layout(op.flamegraph_tree(resolved(t)))
    return lay.withColumn("x", F.round("x", 9)).withColumn("w", F.round("w", 9))


@query("to_folded_stacks", f"SELECT concat(array_to_string(list_reverse(frames), ';'), ' ', count(*)) AS value FROM v_samples JOIN v_stacks USING (stack_id) {SCOPE} GROUP BY frames")
def _(t):
    return op.folded_lines(op.flamegraph_tree(op.resolve_stacks(op.stack_counts(scoped(t)), t.stacks())))


@query("facets", """SELECT DISTINCT facet, value FROM (
 SELECT 'source' AS facet, CASE source WHEN 0 THEN 'cpu' WHEN 1 THEN 'sched' END AS value FROM v_samples
 UNION ALL SELECT 'thread_class', CASE WHEN worker_id IS NULL THEN 'off-worker' ELSE 'worker' END FROM v_samples
 UNION ALL SELECT 'host', host FROM v_samples UNION ALL SELECT 'spawn_location', spawn_location FROM v_samples) WHERE value IS NOT NULL""")
def _(t):
    return op.facets(t.samples())


HIST = """SELECT cast(floor(log2(poll_duration_ns) * 4) AS bigint) AS bucket, count(*) AS samples FROM v_samples WHERE poll_duration_ns > 0 GROUP BY 1"""


@query("poll_hist_samples", f"""SELECT bucket, cast(round(pow(2, bucket / 4.0)) AS bigint) AS lo_ns, cast(round(pow(2, (bucket + 1) / 4.0)) AS bigint) AS hi_ns, samples FROM ({HIST})""")
def _(t):
    return op.poll_histogram(t.samples())


@query("weighted_median_bucket", f"""WITH h AS ({HIST}), c AS (SELECT bucket, sum(samples) OVER (ORDER BY bucket) AS cum, sum(samples) OVER () AS tot FROM h)
SELECT cast(round(pow(2, min(bucket) / 4.0)) AS bigint) AS median_lo_ns FROM c WHERE cum * 2 >= tot""")
def _(t):
    return op.weighted_median_bucket(op.poll_histogram(t.samples()))


CUT = 25_000_000
DIFF = """WITH paths AS (SELECT list_reverse(frames) AS r, sum(CASE WHEN poll_duration_ns < 25000000 THEN 1 ELSE 0 END) AS a,
  sum(CASE WHEN poll_duration_ns >= 25000000 THEN 1 ELSE 0 END) AS b FROM v_samples JOIN v_stacks USING (stack_id)
  WHERE poll_duration_ns IS NOT NULL GROUP BY ALL),
d AS (SELECT array_to_string(r[1:d], ';') AS path, cast(sum(a) AS bigint) AS a, cast(sum(b) AS bigint) AS b,
  cast(sum(CASE WHEN d = len(r) THEN a ELSE 0 END) AS bigint) AS self_a, cast(sum(CASE WHEN d = len(r) THEN b ELSE 0 END) AS bigint) AS self_b
  FROM (SELECT *, unnest(range(1, len(r) + 1)) AS d FROM paths) GROUP BY path)"""


def diff(t):
    poll = F.col("poll_duration_ns")
    return op.resolve_stacks(op.diff_counts(t.samples(), poll < CUT, poll >= CUT), t.stacks())


@query("diff_join", DIFF + " SELECT * FROM d WHERE a + b > 0")
def _(t):
    return op.diff_tree(diff(t)).drop("id")


@query("diff_scopes", """WITH paths AS (SELECT list_reverse(frames) AS r, count(*) FILTER (host = 'NATION_0') AS a, count(*) FILTER (host = 'NATION_1') AS b
  FROM v_samples JOIN v_stacks USING (stack_id) WHERE source = 0 AND host IN ('NATION_0', 'NATION_1') GROUP BY ALL)
SELECT array_to_string(r[1:d], ';') AS path, cast(sum(a) AS bigint) AS a, cast(sum(b) AS bigint) AS b, cast(sum(CASE WHEN d = len(r) THEN a ELSE 0 END) AS bigint) AS self_a,
  cast(sum(CASE WHEN d = len(r) THEN b ELSE 0 END) AS bigint) AS self_b FROM (SELECT *, unnest(range(1, len(r) + 1)) AS d FROM paths) GROUP BY path""")
def _(t):
    """One host against another, each side a scan of its own."""
    sides = [op.resolve_stacks(op.stack_counts(op.facet_filter(t.samples(), {"host": h})), t.stacks()) for h in ("NATION_0", "NATION_1")]
    return op.diff_join(*sides).drop("id")


@query("diff_score", DIFF + """, tot AS (SELECT sum(self_a) AS ta, sum(self_b) AS tb FROM d)
SELECT path, round(greatest(-1.0, least(1.0, log2((b / tb + 0.5 / greatest(ta, tb)) / (a / ta + 0.5 / greatest(ta, tb))) / 4)), 6) AS score
FROM d, tot WHERE a + b > 0""")
def _(t):
    known = diff(t)
    d = op.diff_tree(known)
    total = known.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    scored = d.withColumn("t", total)
    return scored.select("path", F.round(op.diff_score(F.col("a"), F.col("b"), F.col("t.a"), F.col("t.b")), 6).alias("score"))


FOCUS = "ECONOMY"
INSPECT = """WITH paths AS (SELECT list_reverse(frames) AS r, count(*) AS n FROM v_samples JOIN v_stacks USING (stack_id)
  WHERE list_contains(frames, 'ECONOMY') GROUP BY ALL),
sub AS (SELECT 'callees' AS side, r[list_position(r, 'ECONOMY'):] AS r, n FROM paths
  UNION ALL SELECT 'callers', list_reverse(r[1:list_position(r, 'ECONOMY')]), n FROM paths)
SELECT side, array_to_string(r[1:d], ';') AS path, cast(sum(n) AS bigint) AS samples FROM (SELECT *, unnest(range(1, len(r) + 1)) AS d FROM sub) GROUP BY side, path"""


@query("inspect_butterfly", INSPECT)
def _(t):
    callers, callees, _totals = op.inspect(resolved(t), FOCUS)
    return callers.select(F.lit("callers").alias("side"), "path", "samples").unionByName(
        callees.select(F.lit("callees").alias("side"), "path", "samples"))


@query("inspect_totals", """SELECT count(*) AS total, sum(CASE WHEN frames[1] = 'Brand#2' THEN 1 ELSE 0 END)::bigint AS self FROM v_samples JOIN v_stacks USING (stack_id) WHERE list_contains(frames, 'Brand#2')""")
def _(t):
    return op.inspect(resolved(t), "Brand#2")[2]


@query("frame_search", """SELECT name, count(*) AS total, sum(CASE WHEN frames[1] = name THEN 1 ELSE 0 END)::bigint AS self,
 count(DISTINCT array_to_string(r[1:list_position(r, name)], ';')) AS sites
FROM (SELECT *, list_reverse(frames) AS r, unnest(list_distinct(frames)) AS name FROM v_samples JOIN v_stacks USING (stack_id))
WHERE contains(lower(name), 'ri') GROUP BY name""")
def _(t):
    return op.frame_search(resolved(t), "RI")


@query("frame_search_coverage", "SELECT sum(CASE WHEN len([f for f in frames if contains(lower(f), 'ri')]) > 0 THEN 1 ELSE 0 END)::bigint AS covered, count(*) AS total FROM v_samples JOIN v_stacks USING (stack_id)")
def _(t):
    return op.search_coverage(resolved(t), "RI")


@query("frame_time_extent", "SELECT min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS samples FROM v_samples JOIN v_stacks USING (stack_id) WHERE frames[5] = 'ASIA' AND frames[4] = (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def _(t):
    # The zoom path: the first nation of a region.
    first = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name = 'ASIA'").agg(F.min("n_name")).first()[0]
    return op.frame_time_extent(t.samples(), t.stacks(), ["ASIA", first])


@query("dedupe_stacks", "SELECT array_to_string(frames, ';') AS stack, count(*) AS n, max(frames[1]) AS leaf FROM v_cpu GROUP BY 1")
def _(t):
    return op.dedupe_stacks(t.cpu())


@query("off_cpu_split", """SELECT poll_duration_ns IS NOT NULL AS in_poll, CASE WHEN poll_duration_ns IS NOT NULL THEN coalesce(spawn_location, '(unknown spawn location)') END AS loc, count(*) AS n FROM v_samples WHERE source = 1 GROUP BY 1, 2""")
def _(t):
    return op.off_cpu_split(t.samples())


@query("trace_properties", """WITH c AS (SELECT stack_id, count(*) AS n, count(*) FILTER (source = 0) AS cpu, count(*) FILTER (source = 1) AS sched, count(*) FILTER (worker_id IS NULL) AS off FROM v_samples GROUP BY 1)
SELECT sum(n)::bigint AS total, sum(cpu)::bigint AS cpu, sum(sched)::bigint AS sched, sum(off)::bigint AS off_runtime, (sum(n) - sum(off))::bigint AS on_runtime, count(*) AS distinct_stacks,
 cast(sum(cast(concat('0x', substr(md5(concat(stack_id, ':', n)), 1, 12)) AS hugeint)) AS varchar) AS digest FROM c""")
def _(t):
    return op.trace_properties(t.samples())


@query("trace_delta_digest", """WITH o AS (SELECT ts_ns - (SELECT min(ts_ns) FROM v_samples WHERE source = 0) AS delta, count(*) AS n FROM v_samples WHERE source = 0 GROUP BY 1)
SELECT sum(n)::bigint AS samples, max(delta) AS span_ns, cast(sum(cast(concat('0x', substr(md5(concat(delta, ':', n)), 1, 12)) AS hugeint)) AS varchar) AS digest FROM o""")
def _(t):
    return op.delta_digest(t.samples())


@query("top_stacks", "SELECT count(*) AS samples, array_to_string(frames, ';') AS stack FROM v_samples JOIN v_stacks USING (stack_id) GROUP BY frames ORDER BY samples DESC, stack LIMIT 10")
def _(t):
    return op.top_stacks(resolved(t))
