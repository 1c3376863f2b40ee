"""Allocations."""

from pyspark.sql import functions as F

from spoor.catalog.registry import query
from spoor.operators import memory as op, stacks

HOOKS = ("hook::alloc",)
WEIGHT = "CASE WHEN size <= 0 THEN 0 WHEN size / 524288.0 > 50 THEN size ELSE size / (1 - exp(-size / 524288.0)) END"
INV = "CASE WHEN size <= 0 OR size / 524288.0 > 50 THEN 1.0 ELSE 1 / (1 - exp(-size / 524288.0)) END"
W0, W1 = 852_076_800_000_000_000, 915_148_800_000_000_000


def frees(t):
    """A returned item was freed again."""
    return t.allocs().filter(F.col("flag") != "N").select("source_key", "addr", F.col("ts_ns").alias("alloc_ts_ns"), (F.col("ts_ns") + 1000).alias("ts_ns"), "size")


FREES = "fr AS (SELECT source_key, addr, ts_ns AS alloc_ts_ns, size FROM v_allocs WHERE flag <> 'N')"
LEAK = f"{FREES}, lk AS (SELECT * FROM v_allocs a WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.source_key = a.source_key AND fr.addr = a.addr AND fr.alloc_ts_ns = a.ts_ns))"


@query("alloc_free_match", f"WITH {LEAK} SELECT site, count(*) AS n, sum(size)::bigint AS leaked_bytes FROM lk GROUP BY 1")
def _(t):
    return op.leaks(t.allocs(), frees(t)).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("leaked_bytes"))


@query("alloc_sites", f"SELECT array_to_string(frames, ';') AS site, sum(size)::bigint AS total_bytes, count(*) AS n, round(sum({WEIGHT}) / 1000)::bigint AS estimated_kb FROM v_allocs GROUP BY 1 ORDER BY sum({WEIGHT}) DESC, site LIMIT 10")
def _(t):
    return op.alloc_sites(t.allocs()).select("site", "total_bytes", "n", F.round(F.col("estimated_bytes") / 1000).cast("bigint").alias("estimated_kb"))


@query("alloc_summary", f"""WITH {LEAK} SELECT sum(size)::bigint AS total_bytes, count(*) AS total_count, round(sum({WEIGHT}) / 1000)::bigint AS estimated_kb, (SELECT count(*) FROM fr) AS free_count,
 (SELECT sum(size)::bigint FROM lk) AS leaked_bytes, (SELECT count(*) FROM lk) AS leaked_count FROM v_allocs""")
def _(t):
    s = op.alloc_summary(t.allocs(), frees(t))
    return s.withColumn("estimated_kb", F.round(F.col("estimated_bytes") / 1000).cast("bigint")).drop("estimated_bytes")


@query("alloc_task", f"""WITH st AS (SELECT host, worker_id, start_ns, max(task_id) AS task_id FROM v_polls GROUP BY 1, 2, 3), j AS (SELECT a.source_key, a.size, s.task_id FROM v_allocs a ASOF JOIN st s ON s.host = a.source_key AND s.worker_id = a.tid AND s.start_ns <= a.ts_ns)
SELECT source_key, task_id, sum(size)::bigint AS sampled_bytes, count(*) AS n, round(sum({WEIGHT}), 1) AS estimated_bytes FROM j GROUP BY 1, 2""")
def _(t):
    tids = t.allocs().select("source_key", "tid").distinct().withColumn("worker_id", F.col("tid"))
    return op.alloc_task(t.allocs(), t.polls().withColumn("source_key", F.col("host")), tids).withColumn("estimated_bytes", F.round("estimated_bytes", 1))


@query("heap_region", f"""SELECT array_to_string(frames[2:], ';') AS stack, count(*) AS samples, round(sum(size * {INV}) / 1000)::bigint AS kb, round(sum({INV}), 3) AS allocs FROM v_allocs WHERE ts_ns BETWEEN {W0} AND {W1} GROUP BY 1""")
def _(t):
    h = op.heap_region(t.allocs(), W0, W1, HOOKS)
    return h.groupBy(F.array_join("frames", ";").alias("stack")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("bytes") / 1000).cast("bigint").alias("kb"), F.round(F.sum("allocs"), 3).alias("allocs"))


@query("alloc_weight", f"SELECT size, round({WEIGHT}, 3) AS weight, round({INV}, 9) AS inverse FROM (SELECT DISTINCT size FROM v_allocs)")
def _(t):
    size = F.col("size")
    return t.allocs().select("size").distinct().select("size", F.round(op.alloc_weight(size), 3).alias("weight"), F.round(op.inverse_probability(size), 9).alias("inverse"))


@query("small_alloc_hotspots", f"""WITH h AS (SELECT list_reverse(frames[2:]) AS r, sum((size // 1000) * {INV}) AS b, sum({INV}) AS n FROM v_allocs GROUP BY 1),
n AS (SELECT array_to_string(r[1:d], ';') AS path, sum(b) AS b, sum(n) AS n FROM (SELECT *, unnest(range(1, len(r) + 1)) AS d FROM h) GROUP BY 1)
SELECT path, round(n, 2) AS allocs, round(b / n, 4) AS mean_bytes FROM n WHERE n > 10 AND b / n < 1024 ORDER BY n DESC, path LIMIT 10""")
def _(t):
    small = op.heap_region(t.allocs(), hooks=HOOKS).withColumn("bytes", F.expr("size div 1000") * F.col("allocs"))
    tree = stacks.flamegraph_tree(small, ("bytes", "allocs"))
    return op.small_alloc_hotspots(tree).select("path", F.round("allocs", 2).alias("allocs"), F.round("mean_bytes", 4).alias("mean_bytes"))
