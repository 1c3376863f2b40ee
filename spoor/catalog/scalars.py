"""Scalar functions."""

from pyspark.sql import functions as F

from spoor.catalog.registry import query
from spoor.functions import frames as fr, privacy as pv
from spoor.operators import series

# Symbols of every frame kind, chosen per row by its numbers.
SYMS = ("__libc_read", "je_malloc", "mi_free", "__schedule", "vfs_read", "tokio::runtime::task::run", "std::thread::spawn", "core::ops::function::call", "svc::handler::work", "0x7f01", "do_futex", "epoll_wait_lock")


def sym(expr):
    return F.element_at(F.array(*[F.lit(s) for s in SYMS]), (expr % len(SYMS) + 1).cast("int"))


SYM_SQL = "[" + ", ".join(f"'{s}'" for s in SYMS) + "]"
KIND = """CASE WHEN s LIKE '0x%' THEN 'unknown' WHEN s IN ('__libc_read') THEN 'libc' WHEN s IN ('je_malloc', 'mi_free') THEN 'allocator' WHEN s IN ('__schedule', 'vfs_read', 'do_futex') THEN 'kernel'
 WHEN s IN ('tokio::runtime::task::run', 'std::thread::spawn', 'core::ops::function::call') THEN 'runtime' ELSE 'app' END"""


def stack_of(t):
    e = t.events()
    return e.select("seq", F.array(*[sym(F.col("seq") * m + F.col("task_id")) for m in (1, 3, 5, 7)], F.lit("main")).alias("frames"))


STACKS = f"st AS (SELECT seq, list_concat([{SYM_SQL}[(seq * m + task_id) % 12 + 1] for m in [1, 3, 5, 7]], ['main']) AS frames FROM v_events)"


@query("frame_kind", f"WITH {STACKS}, x AS (SELECT unnest(frames) AS s FROM st) SELECT s, {KIND} AS kind, count(*) AS n FROM x GROUP BY 1, 2")
def _(t):
    return stack_of(t).select(F.explode("frames").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", fr.frame_kind(F.col("s")))


@query("diagnose_stack", f"""WITH {STACKS}, x AS (SELECT seq, unnest(frames) AS s, generate_subscripts(frames, 1) AS i FROM st), k AS (SELECT *, {KIND} AS kind FROM x), a AS (SELECT seq, min(i) FILTER (kind = 'app') AS ai FROM k GROUP BY 1)
SELECT k.seq, arg_min(s, i) FILTER (kind = 'libc' AND i <= coalesce(ai, 99)) AS syscall, arg_min(s, i) FILTER (kind = 'kernel' AND s <> '__schedule' AND i <= coalesce(ai, 99)) AS blocker,
 arg_min(s, i) FILTER (kind = 'app') AS "trigger" FROM k JOIN a USING (seq) GROUP BY 1""")
def _(t):
    return stack_of(t).select("seq", *[c.alias(n) for n, c in fr.diagnose_stack(F.col("frames")).items()])


@query("blocking_category", f"""WITH {STACKS}, x AS (SELECT frames[1] AS s FROM st) SELECT CASE WHEN s LIKE '%lock%' OR s LIKE '%mutex%' THEN 'lock' WHEN s LIKE '%poll%' THEN 'poll' WHEN s LIKE '%write%' OR s LIKE '%read%' OR s LIKE '%recv%' OR s LIKE '%send%' THEN 'io'
 WHEN s LIKE '%syscall%' THEN 'syscall' ELSE 'other' END AS category, count(*) AS n FROM x GROUP BY 1""")
def _(t):
    return stack_of(t).groupBy(fr.blocking_category(F.element_at("frames", 1)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("symbolize", """WITH sy AS (SELECT DISTINCT l_partkey AS addr, d AS inline_depth, concat('fn', l_partkey, '_', d) AS name FROM lineitem, (SELECT unnest([0, 1, 2]) AS d) WHERE d <= l_partkey % 3 AND l_quantity >= 48),
s AS (SELECT event_id AS stack_id, [value::bigint, user_id, event_id % 2000] AS c FROM (SELECT event_id, user_id, floor(value) AS value FROM events)), x AS (SELECT stack_id, unnest(c) AS addr, generate_subscripts(c, 1) AS i FROM s),
j AS (SELECT x.*, coalesce(name, concat('0x', lower(to_hex(x.addr)))) AS f, coalesce(inline_depth, 0) AS d FROM x LEFT JOIN sy ON sy.addr = x.addr) SELECT stack_id, array_to_string(list(f ORDER BY i, d DESC), ';') AS stack FROM j GROUP BY 1""")
def _(t):
    e = t.table("events")
    samples = e.select(F.col("event_id").alias("stack_id"), F.array(F.floor("value"), F.col("user_id"), F.col("event_id") % 2000).alias("callchain"))
    sold = t.table("lineitem").filter(F.col("l_quantity") >= 48)  # parts never sold in bulk have no symbol
    part = sold.select(F.col("l_partkey").alias("addr")).distinct().withColumn("inline_depth", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    known = part.filter(F.col("inline_depth") <= F.col("addr") % 3)
    symbols = known.withColumn("symbol_name", F.concat(F.lit("fn"), F.col("addr").cast("string"), F.lit("_"), F.col("inline_depth").cast("string")))
    return fr.symbolize(samples, symbols).select("stack_id", F.array_join("frames", ";").alias("stack"))


PROCESS_NAME = "concat('fn', addr, '_', d, CASE WHEN host = 2 THEN '@2' ELSE '' END)"


@query("symbolize_processes", f"""WITH sy AS (SELECT DISTINCT host, l_partkey AS addr, d AS inline_depth, {PROCESS_NAME.replace('addr', 'l_partkey')} AS name FROM lineitem, (SELECT unnest([0, 1, 2]) AS d), (SELECT unnest([0, 1, 2]) AS host)
 WHERE d <= l_partkey % 3 AND l_quantity >= 48),
s AS (SELECT user_id % 4 AS host, event_id AS stack_id, [floor(value)::bigint, user_id, event_id % 2000] AS c FROM events), x AS (SELECT host, stack_id, unnest(c) AS addr, generate_subscripts(c, 1) AS i FROM s),
j AS (SELECT x.*, coalesce(name, concat('0x', lower(to_hex(x.addr)))) AS f, coalesce(inline_depth, 0) AS d FROM x LEFT JOIN sy ON sy.addr = x.addr AND sy.host = x.host)
SELECT host, stack_id, array_to_string(list(f ORDER BY i, d DESC), ';') AS stack FROM j GROUP BY 1, 2""")
def _(t):
    """Four processes with the same addresses: two share an image, one has other names, one has no symbols."""
    e = t.table("events")
    samples = e.select((F.col("user_id") % 4).alias("host"), F.col("event_id").alias("stack_id"), F.array(F.floor("value"), F.col("user_id"), F.col("event_id") % 2000).alias("callchain"))
    part = t.table("lineitem").filter(F.col("l_quantity") >= 48).select(F.col("l_partkey").alias("addr")).distinct()
    known = part.withColumn("inline_depth", F.explode(F.array(*[F.lit(i) for i in range(3)]))).filter(F.col("inline_depth") <= F.col("addr") % 3)
    symbols = known.withColumn("host", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))).withColumn(
        "symbol_name", F.concat(F.lit("fn"), F.col("addr").cast("string"), F.lit("_"), F.col("inline_depth").cast("string"), F.when(F.col("host") == 2, "@2").otherwise("")))
    return fr.symbolize(samples, symbols, keys=("host",)).select("host", "stack_id", F.array_join("frames", ";").alias("stack"))


@query("quantize", """WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, duration_ns AS v FROM (SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice * 500) AS bigint) AS duration_ns FROM lineitem)),
b AS (SELECT *, cast(floor(log2(v)) AS int) AS oc FROM p) SELECT v, count(*) AS n, v // 10000 * 10000 AS ns, CASE WHEN v < 1024 THEN v ELSE ((v >> (oc - 9)) + 1) << (oc - 9) END AS num,
 CASE WHEN v <= 2 THEN v + 2 WHEN (1::bigint << oc) // 4 * 7 + 1 = v THEN v + (1::bigint << oc) // 4 ELSE (1::bigint << oc) // 4 * 7 + 1 END AS bucket FROM b GROUP BY ALL""")
def _(t):
    v = F.col("v")
    return t.polls().select(F.col("duration_ns").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(
        "v", "n", pv.quantize_ns(v).alias("ns"), pv.quantize_numeric(v).alias("num"), pv.privacy_bucket(v).alias("bucket"))


@query("quantize_f64", """SELECT x, floor(x * pow(10, 2 - floor(log10(x))) + 0.5) / pow(10, 2 - floor(log10(x))) AS q FROM (SELECT DISTINCT o_totalprice AS x FROM orders)""")
def _(t):
    return t.table("orders").select(F.col("o_totalprice").alias("x")).distinct().withColumn("q", pv.quantize_f64(F.col("x")))


@query("anonymise_ids", """WITH f AS (SELECT task_id, min(ts_ns) AS at_ns FROM v_events WHERE task_id <> 0 GROUP BY 1) SELECT task_id, row_number() OVER (ORDER BY at_ns, task_id) AS new_id FROM f UNION ALL SELECT DISTINCT 0, 0 FROM v_events WHERE task_id = 0""")
def _(t):
    return pv.renumber(t.events(), "task_id", "ts_ns")


@query("numeric_value", """WITH s AS (SELECT seq, CASE seq % 4 WHEN 0 THEN concat('0', seq) WHEN 1 THEN concat('-', seq) WHEN 2 THEN seq::varchar ELSE concat(seq, '.5') END AS s FROM v_events)
SELECT seq, CASE WHEN regexp_matches(s, '^(0|[1-9][0-9]*)$') THEN s::bigint END AS v FROM s""")
def _(t):
    seq = F.col("seq")
    text = F.when(seq % 4 == 0, F.concat(F.lit("0"), seq.cast("string"))).when(seq % 4 == 1, F.concat(F.lit("-"), seq.cast("string"))).when(
        seq % 4 == 2, seq.cast("string")).otherwise(F.concat(seq.cast("string"), F.lit(".5")))
    return t.events().select("seq", series.numeric_value(text).cast("bigint").alias("v"))


@query("task_id_label", "SELECT DISTINCT task_id, concat('0x', lower(to_hex(task_id))) AS label FROM v_events")
def _(t):
    return t.events().select("task_id", series.task_label(F.col("task_id")).alias("label")).distinct()


@query("waker_label", "SELECT DISTINCT waker_task_id AS w, CASE WHEN waker_task_id <= 4 THEN 'io' WHEN waker_task_id % 3 = 0 THEN concat('task 0x', lower(to_hex(waker_task_id))) ELSE concat('f', waker_task_id, '.rs') END AS label FROM v_events")
def _(t):
    w = F.col("w")
    loc = F.when(w % 3 != 0, F.concat(F.lit("src/x/f"), w.cast("string"), F.lit(".rs")))
    return t.events().select(F.col("waker_task_id").alias("w")).distinct().select("w", series.waker_label(w, loc, 4).alias("label"))


@query("capabilities", """SELECT source_key, count(*) % 2 = 0 AS full_task_coverage, count(*) % 3 <> 0 AS local_queue_depth, count(*) FILTER (kind = 'TaskSpawn') > 0 AS task_lifetimes FROM v_events GROUP BY 1""")
def _(t):
    per = t.events().groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "TaskSpawn").alias("spawns"))
    partial = F.when(F.col("n") % 2 != 0, "helper-spawns-only").otherwise("all")
    queue = F.when(F.col("n") % 3 == 0, "false").otherwise("true")
    meta = F.create_map(F.lit("tokio.poll_coverage"), partial, F.lit("tokio.local_queue"), queue)
    return per.withColumn("meta", meta).select("source_key", *[c.alias(k) for k, c in pv.capabilities(F.col("meta"), F.col("spawns")).items()])


@query("log_bucket", """SELECT DISTINCT elapsed_ns, cast(floor(log2(elapsed_ns) * 4) AS bigint) AS bucket, cast(round(pow(2, floor(log2(elapsed_ns) * 4) / 4)) AS bigint) AS lo_ns FROM v_spans WHERE elapsed_ns > 0""")
def _(t):
    from spoor.functions.buckets import edge_ns, log_bucket

    b = log_bucket(F.col("elapsed_ns"))
    return t.spans().filter("elapsed_ns > 0").select("elapsed_ns", b.alias("bucket"), edge_ns(b).alias("lo_ns")).distinct()
