"""Trace tables derived from the given tables, once as DataFrames and once as plain SQL.

Both definitions are row-for-row equal. Every view keeps all rows of its base tables (a row may land in one
of two sibling views, such as allocations and frees).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


class Tables:
    """The given tables and the views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        """Runtime events: lanes are (source_key, worker_id), one source per host and week."""
        e = self.table("events")
        us, uid, eid = micros("ts"), F.col("user_id"), F.col("event_id")
        worker = ((uid + eid) % 4).cast("int")
        kind = (
            F.when(F.col("event_type") == "view", "PollStart").when(F.col("event_type") == "click", "PollEnd")
            .when(F.col("event_type") == "purchase", "Wake")
            .when(F.col("event_type") == "signup", F.when(eid % 2 == 0, "TaskSpawn").otherwise("WorkerUnpark"))
            .otherwise(F.when(eid % 5 == 0, "TaskTerminate").otherwise("WorkerPark")))
        host = F.concat(F.lit("h"), (uid % 3).cast("string"))
        return e.select(
            eid.alias("seq"), (us * 1000).alias("ts_ns"), host.alias("host"),
            F.concat(host, F.lit("/"), F.expr(f"unix_micros(cast(ts as timestamp)) div {WEEK_US}").cast("string"))
            .alias("source_key"),
            worker.alias("worker_id"), uid.alias("task_id"), kind.alias("kind"),
            (F.lit(1000) + worker * 10 + F.when(eid % 37 == 0, 1).otherwise(0)).cast("int").alias("tid"),
            ((uid * 7 + 3) % 150).alias("waker_task_id"),
            (eid * 40_000_000_000 + F.floor(F.col("value") * 1000)).alias("cpu_time_ns"),
            F.when(eid % 3 == 0, None).otherwise(F.floor(F.col("value") * 100000)).alias("sched_wait_ns"),
            (eid % 7).cast("int").alias("local_queue"),
            F.concat(F.lit("loc"), (uid % 11).cast("string")).alias("spawn_loc"),
            (uid % 2 == 0).alias("instrumented"))

    def cpu(self) -> DataFrame:
        """CPU (source 0) and scheduler (source 1) samples taken on the event lanes' threads."""
        e = self.table("events")
        us, uid, eid = micros("ts"), F.col("user_id"), F.col("event_id")
        worker = (uid + F.floor(F.col("value"))) % 4
        host = F.concat(F.lit("h"), (uid % 3).cast("string"))
        return e.select(
            eid.alias("sample_id"), (us * 1000 + F.floor(F.col("value") * 10_000_000_000)).alias("t"),
            F.concat(host, F.lit("/"), F.expr(f"unix_micros(cast(ts as timestamp)) div {WEEK_US}").cast("string"))
            .alias("source_key"),
            (F.lit(1000) + worker * 10 + F.when(eid % 41 == 0, 1).otherwise(0)).cast("int").alias("tid"),
            (eid % 2).cast("int").alias("source"),
            F.array(
                F.concat(F.lit("libc::fn"), (eid % 5).cast("string")),
                F.concat(F.lit("app::"), F.col("event_type")),
                F.concat(F.lit("app::task"), (uid % 7).cast("string")),
                F.lit("main")).alias("frames"))

    def samples(self) -> DataFrame:
        t = self._sampled()
        stack = F.concat_ws("|", "p_name", "p_type", "p_brand", "n_name", "r_name")
        return t.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            (micros("l_shipdate") * 1000 + F.col("l_linenumber")).alias("ts_ns"), F.md5(stack).alias("stack_id"),
            F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("source"),
            F.when(F.col("l_returnflag") != "N", (F.col("l_suppkey") % 8).cast("int")).alias("worker_id"),
            F.col("n_name").alias("host"), F.col("r_name").alias("service"),
            F.when(F.col("l_tax") != 0, F.floor(F.col("l_extendedprice") * 500)).alias("poll_duration_ns"),
            F.when(F.col("l_tax") != 0, F.col("p_type")).alias("spawn_location"),
            F.array(
                F.struct(F.md5("l_returnflag").alias("span_type_uid"),
                         F.floor(F.col("l_extendedprice") * 100).alias("elapsed_ns")),
                F.struct(F.md5("l_linestatus").alias("span_type_uid"),
                         F.when(F.col("l_tax") != 0, F.floor(F.col("l_quantity") * 1_000_000)).alias("elapsed_ns")),
            ).alias("enclosing_spans"))

    def stacks(self) -> DataFrame:
        """Stack dictionary, frames leaf to root."""
        names = ["p_name", "p_type", "p_brand", "n_name", "r_name"]
        return self._sampled().select(*names).distinct().select(
            F.md5(F.concat_ws("|", *names)).alias("stack_id"), F.array(*names).alias("frames"))

    def _sampled(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")))

    def polls(self) -> DataFrame:
        start = micros("l_shipdate") * 1000 + F.col("l_linenumber") * 1_000_000
        dur = F.floor(F.col("l_extendedprice") * 500)
        return self.table("lineitem").select(
            F.concat(F.lit("h"), (F.col("l_suppkey") % 5).cast("string")).alias("host"),
            (F.col("l_suppkey") % 8).cast("int").alias("worker_id"), F.col("l_partkey").alias("task_id"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), None)
            .otherwise(F.concat(F.lit("svc/"), "l_returnflag", F.col("l_linenumber").cast("string"))).alias("spawn_loc"),
            F.concat(F.lit("seg"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 2592000000000").cast("string"))
            .alias("source_key"),
            start.alias("start_ns"), (start + dur).alias("end_ns"), dur.alias("duration_ns"),
            (F.col("l_quantity").cast("int") % 3).alias("cpu_sample_count"),
            (F.col("l_linenumber") % 2).cast("int").alias("sched_sample_count"),
            F.when(F.col("l_discount") != 0, F.round(F.col("l_discount") * 100).cast("long") * 300000)
            .alias("scheduling_delay_ns"),
            (F.col("l_linenumber") % 3).cast("int").alias("scheduling_delay_kind"),
            F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False).alias("task_instrumented"),
            "l_orderkey", "l_linenumber", "l_suppkey")

    def spans(self) -> DataFrame:
        price = F.col("o_totalprice")
        start = micros("o_orderdate") * 1000
        elapsed, cpu = F.floor(price * 1000), F.floor(price * 400)
        wait = F.when(F.col("o_orderstatus") != "P", F.floor(price * 300))
        return (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
                F.md5(F.concat(F.lit("span"), F.col("o_orderkey").cast("string"))).alias("span_uid"),
                F.md5("o_orderpriority").alias("span_type_uid"), F.col("o_orderpriority").alias("name"),
                F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("source_key"), F.expr("o_orderkey div 3").alias("span_id"),
                F.when((F.col("o_orderkey") % 5 != 0) & (F.col("o_orderkey") >= 3), F.expr("o_orderkey div 3 div 2")).alias("parent_span_id"),
                start.alias("start_ns"), (start + elapsed).alias("end_ns"), elapsed.alias("elapsed_ns"),
                cpu.alias("on_cpu_ns_est"), wait.alias("async_wait_ns"),
                (elapsed - cpu - F.coalesce(wait, F.lit(0))).alias("unknown_ns"),
                (F.col("o_orderkey") % 3 != 0).alias("details_complete"),
                F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("segment"), F.col("c_mktsegment"),
                             F.lit("cust"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")))
                .alias("attributes"),
                F.concat(F.lit("h"), (F.col("o_custkey") % 7).cast("string")).alias("host"),
                (F.col("o_custkey") % 4).cast("int").alias("worker_id")))

    def span_events(self) -> DataFrame:
        """Span lifecycle events: enter, exit, close; ids recur after a close."""
        e = self.table("events")
        uid, eid = F.col("user_id"), F.col("event_id")
        kind = (F.when(F.col("event_type").isin("view", "signup"), "SpanEnter")
                .when(F.col("event_type") == "purchase", "SpanClose").otherwise("SpanExit"))
        span = uid % 30
        return e.select(
            eid.alias("seq"), (micros("ts") * 1000).alias("ts_ns"), kind.alias("kind"), span.alias("span_id"),
            F.when(span % 4 != 0, F.expr("(user_id % 30) div 3")).alias("parent_span_id"),
            F.concat(F.lit("op"), (span % 6).cast("string")).alias("span_name"),
            F.concat(F.lit("h"), (uid % 3).cast("string"), F.lit("/"),
                     F.expr(f"unix_micros(cast(ts as timestamp)) div {WEEK_US}").cast("string")).alias("source_key"),
            F.when(eid % 4 != 0, (eid + uid) % 3).alias("task_id"), ((uid + eid) % 4).cast("int").alias("worker_id"),
            F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"))

    def metrics(self) -> DataFrame:
        """Runtime metrics, one cycle per hour; the ``alive_tasks`` gauge may be missing."""
        e = self.table("events")
        uid, eid = F.col("user_id"), F.col("event_id")
        return e.select(
            eid.alias("seq"),
            (F.expr("unix_micros(cast(ts as timestamp)) div 3600000000") * 3_600_000_000_000).alias("ts_ns"),
            F.concat(F.lit("h"), (uid % 3).cast("string"), F.lit("/"), F.expr(f"unix_micros(cast(ts as timestamp)) div {WEEK_US}").cast("string")).alias("source_key"),
            F.concat(F.lit("rt"), (uid % 2).cast("string")).alias("runtime_name"),
            F.floor("value").alias("global_queue_depth"), (eid % 50 + F.floor("value")).alias("alive_tasks"))

    def resource(self) -> DataFrame:
        """Process counters per host: cumulative CPU time with occasional resets."""
        e = self.table("events")
        uid, eid = F.col("user_id"), F.col("event_id")
        return e.select(
            eid.alias("seq"), (micros("ts") * 1000).alias("ts_ns"),
            F.concat(F.lit("h"), (uid % 3).cast("string")).alias("host"),
            (eid * 200_000_000_000 + F.floor(F.col("value") * 2_000_000_000)).alias("user_cpu_ns"),
            (eid * 50_000_000_000 + F.floor(F.col("value") * 300_000_000)).alias("system_cpu_ns"))

    def custom(self) -> DataFrame:
        """Custom events with string fields, one of them numeric and sometimes missing."""
        e = self.table("events")
        eid = F.col("event_id")
        k = F.get_json_object("props", "$.k")
        return e.select(
            eid.alias("seq"), (micros("ts") * 1000).alias("ts_ns"), F.col("event_type").alias("name"),
            F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
            F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"), F.lit("/"),
                     F.expr(f"unix_micros(cast(ts as timestamp)) div {WEEK_US}").cast("string")).alias("source_key"),
            F.col("user_id").alias("task_id"), ((F.col("user_id") + eid) % 4).cast("int").alias("worker_id"),
            F.when(eid % 6 != 0, k.cast("long")).alias("k"),
            F.when(eid % 6 != 0, F.create_map(F.lit("k"), k, F.lit("unit"), F.lit("ms"), F.lit("who"), F.concat(F.lit("u"), F.col("user_id").cast("string"))))
            .otherwise(F.create_map(F.lit("unit"), F.lit("s"), F.lit("who"), F.concat(F.lit("u"), F.col("user_id").cast("string")))).alias("fields"))

    def allocs(self) -> DataFrame:
        a = self.table("lineitem")
        return a.select(
            F.concat(F.lit("h"), (F.col("l_suppkey") % 5).cast("string")).alias("source_key"), F.col("l_orderkey").alias("addr"), (micros("l_shipdate") * 1000 + F.col("l_linenumber")).alias("ts_ns"),
            (F.col("l_suppkey") % 8).cast("int").alias("tid"), F.floor(F.col("l_extendedprice") * 10).alias("size"),
            F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("site"),
            F.array(F.lit("hook::alloc"), F.concat(F.lit("app::site"), (F.col("l_partkey") % 50).cast("string")),
                    F.concat(F.lit("app::mod"), (F.col("l_partkey") % 5).cast("string"))).alias("frames"))

    def keys(self) -> DataFrame:
        """Object listing: one key per event, in all layouts, some malformed, some not segments."""
        e = self.table("events")
        ts, uid, eid = F.col("ts").cast("timestamp"), F.col("user_id"), F.col("event_id")
        date, hhmm = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HHmm")
        svc = F.concat(F.lit("svc"), (uid % 4).cast("string"))
        host, boot = F.concat(F.lit("h"), (uid % 3).cast("string")), F.concat(F.lit("abcd-"), (uid % 5).cast("string"))
        epoch = F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("string")
        name = F.concat(epoch, F.lit("-"), eid.cast("string"))
        v1 = lambda time: F.concat(
            F.lit("version=1/date="), date, F.lit("/service=a%3A"), svc, F.lit("/time="), time,
            F.lit("/instance="), host, F.lit("/boot="), boot, F.lit("/"), name, F.lit(".bin.gz"))
        key = (
            F.when(F.col("event_type") == "view", v1(hhmm))
            .when(F.col("event_type") == "click", F.concat(
                F.lit("s3://bkt/base/"), F.concat_ws("/", date, hhmm, svc, host, boot, name), F.lit(".bin.gz")))
            .when(F.col("event_type") == "signup", F.concat(F.concat_ws("/", date, hhmm, svc, host, name), F.lit(".bin")))
            .when(F.col("event_type") == "error", v1(F.lit("bad")))
            .otherwise(F.concat(F.lit("misc/samples/"), name, F.lit(".parquet"))))
        return e.select(
            eid.alias("seq"), key.alias("key"), F.floor(F.col("value") * 100).alias("size"),
            F.expr("unix_micros(cast(ts as timestamp)) div 1000000 + user_id % 90").alias("modified_s"))

    def segments(self) -> DataFrame:
        """Trace segments: one per service, host and six hours; silent periods leave gaps."""
        e = self.table("events")
        grain = F.expr("unix_micros(cast(ts as timestamp)) div 21600000000")
        return (
            e.groupBy(F.concat(F.lit("svc"), (F.col("user_id") % 25).cast("string")).alias("service"),
                      F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), grain.alias("grain"))
            .agg(F.min(micros("ts")).alias("start_us"), (F.max(micros("ts")) + 4_000_000_000).alias("end_us"),
                 F.sum(F.floor(F.col("value") * 100)).cast("long").alias("size"))
            .withColumn("boot_id", F.expr("case when grain % 11 = 0 then '' else concat('b', cast(grain div 30 as string)) end")))


_US = "epoch_us({})"
_HOSTW = f"concat('h', cast(user_id % 3 AS varchar), '/', cast(epoch_us(ts) // {WEEK_US} AS varchar))"
_SAMPLED = """lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_STACK = "md5(concat(p_name, '|', p_type, '|', p_brand, '|', n_name, '|', r_name))"
_NAME = "concat(cast(epoch_us(ts) // 1000000 AS varchar), '-', cast(event_id AS varchar))"
_V1 = ("concat('version=1/date=', strftime(ts, '%Y-%m-%d'), '/service=a%3Asvc', cast(user_id % 4 AS varchar), '/time=', {t}, "
       "'/instance=h', cast(user_id % 3 AS varchar), '/boot=abcd-', cast(user_id % 5 AS varchar), '/', " + _NAME + ", '.bin.gz')")

SQL: dict[str, str] = {
    "v_events": f"""
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, concat('h', cast(user_id % 3 AS varchar)) AS host,
       {_HOSTW} AS source_key, cast((user_id + event_id) % 4 AS int) AS worker_id, user_id AS task_id,
       CASE event_type WHEN 'view' THEN 'PollStart' WHEN 'click' THEN 'PollEnd' WHEN 'purchase' THEN 'Wake'
            WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'TaskSpawn' ELSE 'WorkerUnpark' END
            ELSE CASE WHEN event_id % 5 = 0 THEN 'TaskTerminate' ELSE 'WorkerPark' END END AS kind,
       cast(1000 + ((user_id + event_id) % 4) * 10 + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS int) AS tid,
       (user_id * 7 + 3) % 150 AS waker_task_id, event_id * 40000000000 + cast(floor(value * 1000) AS bigint) AS cpu_time_ns,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(floor(value * 100000) AS bigint) END AS sched_wait_ns,
       cast(event_id % 7 AS int) AS local_queue, concat('loc', cast(user_id % 11 AS varchar)) AS spawn_loc,
       user_id % 2 = 0 AS instrumented
FROM events""",
    "v_cpu": f"""
SELECT event_id AS sample_id, epoch_us(ts) * 1000 + cast(floor(value * 10000000000) AS bigint) AS t, {_HOSTW} AS source_key,
       cast(1000 + ((user_id + cast(floor(value) AS bigint)) % 4) * 10 + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS int) AS tid,
       cast(event_id % 2 AS int) AS source,
       [concat('libc::fn', cast(event_id % 5 AS varchar)), concat('app::', event_type),
        concat('app::task', cast(user_id % 7 AS varchar)), 'main'] AS frames
FROM events""",
    "v_samples": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate) * 1000 + l_linenumber AS ts_ns, {_STACK} AS stack_id,
       CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS source,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE cast(l_suppkey % 8 AS int) END AS worker_id,
       n_name AS host, r_name AS service,
       CASE WHEN l_tax = 0 THEN NULL ELSE cast(floor(l_extendedprice * 500) AS bigint) END AS poll_duration_ns,
       CASE WHEN l_tax = 0 THEN NULL ELSE p_type END AS spawn_location,
       [{{'span_type_uid': md5(l_returnflag), 'elapsed_ns': cast(floor(l_extendedprice * 100) AS bigint)}},
        {{'span_type_uid': md5(l_linestatus),
         'elapsed_ns': CASE WHEN l_tax = 0 THEN NULL ELSE cast(floor(l_quantity * 1000000) AS bigint) END}}] AS enclosing_spans
FROM {_SAMPLED}""",
    "v_stacks": f"SELECT DISTINCT {_STACK} AS stack_id, [p_name, p_type, p_brand, n_name, r_name] AS frames FROM {_SAMPLED}",
    "v_polls": """
SELECT concat('h', cast(l_suppkey % 5 AS varchar)) AS host, cast(l_suppkey % 8 AS int) AS worker_id, l_partkey AS task_id,
       CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL
            ELSE concat('svc/', l_returnflag, cast(l_linenumber AS varchar)) END AS spawn_loc,
       concat('seg', cast(epoch_us(l_shipdate) // 2592000000000 AS varchar)) AS source_key,
       epoch_us(l_shipdate) * 1000 + l_linenumber * 1000000 AS start_ns,
       epoch_us(l_shipdate) * 1000 + l_linenumber * 1000000 + cast(floor(l_extendedprice * 500) AS bigint) AS end_ns,
       cast(floor(l_extendedprice * 500) AS bigint) AS duration_ns,
       cast(l_quantity AS int) % 3 AS cpu_sample_count, l_linenumber % 2 AS sched_sample_count,
       CASE WHEN l_discount = 0 THEN NULL ELSE cast(round(l_discount * 100) AS bigint) * 300000 END AS scheduling_delay_ns,
       l_linenumber % 3 AS scheduling_delay_kind,
       CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS task_instrumented,
       l_orderkey, l_linenumber, l_suppkey
FROM lineitem""",
    "v_spans": """
SELECT md5(concat('span', cast(o_orderkey AS varchar))) AS span_uid, md5(o_orderpriority) AS span_type_uid,
       o_orderpriority AS name, concat('s', cast(o_orderkey % 3 AS varchar)) AS source_key, o_orderkey // 3 AS span_id,
       CASE WHEN o_orderkey % 5 = 0 OR o_orderkey < 3 THEN NULL ELSE o_orderkey // 3 // 2 END AS parent_span_id,
       epoch_us(o_orderdate) * 1000 AS start_ns, epoch_us(o_orderdate) * 1000 + cast(floor(o_totalprice * 1000) AS bigint) AS end_ns,
       cast(floor(o_totalprice * 1000) AS bigint) AS elapsed_ns, cast(floor(o_totalprice * 400) AS bigint) AS on_cpu_ns_est,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE cast(floor(o_totalprice * 300) AS bigint) END AS async_wait_ns,
       cast(floor(o_totalprice * 1000) AS bigint) - cast(floor(o_totalprice * 400) AS bigint)
         - CASE WHEN o_orderstatus = 'P' THEN 0 ELSE cast(floor(o_totalprice * 300) AS bigint) END AS unknown_ns,
       o_orderkey % 3 <> 0 AS details_complete, o_orderstatus AS attr_status, c_mktsegment AS attr_segment,
       concat('c', cast(o_custkey % 40 AS varchar)) AS attr_cust,
       concat('h', cast(o_custkey % 7 AS varchar)) AS host, cast(o_custkey % 4 AS int) AS worker_id
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_span_events": f"""
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns,
       CASE WHEN event_type IN ('view', 'signup') THEN 'SpanEnter' WHEN event_type = 'purchase' THEN 'SpanClose' ELSE 'SpanExit' END AS kind,
       user_id % 30 AS span_id, CASE WHEN (user_id % 30) % 4 = 0 THEN NULL ELSE (user_id % 30) // 3 END AS parent_span_id,
       concat('op', cast((user_id % 30) % 6 AS varchar)) AS span_name, {_HOSTW} AS source_key,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id + user_id) % 3 END AS task_id, cast((user_id + event_id) % 4 AS int) AS worker_id,
       json_extract_string(props, '$.k') AS attr_k
FROM events""",
    "v_metrics": f"""
SELECT event_id AS seq, (epoch_us(ts) // 3600000000) * 3600000000000 AS ts_ns, {_HOSTW} AS source_key, concat('rt', cast(user_id % 2 AS varchar)) AS runtime_name,
       cast(floor(value) AS bigint) AS global_queue_depth, event_id % 50 + cast(floor(value) AS bigint) AS alive_tasks
FROM events""",
    "v_resource": """
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, concat('h', cast(user_id % 3 AS varchar)) AS host,
       event_id * 200000000000 + cast(floor(value * 2000000000) AS bigint) AS user_cpu_ns,
       event_id * 50000000000 + cast(floor(value * 300000000) AS bigint) AS system_cpu_ns
FROM events""",
    "v_custom": f"""
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, event_type AS name, concat('h', cast(user_id % 3 AS varchar)) AS host,
       {_HOSTW} AS source_key, user_id AS task_id,
       cast((user_id + event_id) % 4 AS int) AS worker_id,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(json_extract_string(props, '$.k') AS bigint) END AS k,
       CASE WHEN event_id % 6 = 0 THEN 's' ELSE 'ms' END AS unit, concat('u', cast(user_id AS varchar)) AS who
FROM events""",
    "v_allocs": """
SELECT concat('h', cast(l_suppkey % 5 AS varchar)) AS source_key, l_orderkey AS addr, epoch_us(l_shipdate) * 1000 + l_linenumber AS ts_ns, cast(l_suppkey % 8 AS int) AS tid,
       cast(floor(l_extendedprice * 10) AS bigint) AS size, l_returnflag AS flag, l_partkey AS site,
       ['hook::alloc', concat('app::site', cast(l_partkey % 50 AS varchar)), concat('app::mod', cast(l_partkey % 5 AS varchar))] AS frames
FROM lineitem""",
    "v_keys": f"""
SELECT event_id AS seq,
       CASE event_type WHEN 'view' THEN {_V1.format(t="strftime(ts, '%H%M')")}
         WHEN 'click' THEN concat('s3://bkt/base/', strftime(ts, '%Y-%m-%d'), '/', strftime(ts, '%H%M'), '/svc', cast(user_id % 4 AS varchar),
              '/h', cast(user_id % 3 AS varchar), '/abcd-', cast(user_id % 5 AS varchar), '/', {_NAME}, '.bin.gz')
         WHEN 'signup' THEN concat(strftime(ts, '%Y-%m-%d'), '/', strftime(ts, '%H%M'), '/svc', cast(user_id % 4 AS varchar),
              '/h', cast(user_id % 3 AS varchar), '/', {_NAME}, '.bin')
         WHEN 'error' THEN {_V1.format(t="'bad'")}
         ELSE concat('misc/samples/', {_NAME}, '.parquet') END AS key,
       cast(floor(value * 100) AS bigint) AS size, epoch_us(ts) // 1000000 + user_id % 90 AS modified_s
FROM events""",
    "v_segments": """
SELECT service, host, grain, cast(min(us) AS bigint) AS start_us, cast(max(us) AS bigint) + 4000000000 AS end_us, cast(sum(b) AS bigint) AS size,
       CASE WHEN grain % 11 = 0 THEN '' ELSE concat('b', cast(grain // 30 AS varchar)) END AS boot_id
FROM (SELECT concat('svc', cast(user_id % 25 AS varchar)) AS service, concat('h', cast(user_id % 3 AS varchar)) AS host,
             epoch_us(ts) // 21600000000 AS grain, epoch_us(ts) AS us, cast(floor(value * 100) AS bigint) AS b FROM events) e
GROUP BY service, host, grain""",
}
