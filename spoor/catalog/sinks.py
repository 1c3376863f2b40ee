"""Writing the tables, and the streaming jobs, run over the given tables and read back."""

import uuid

from pyspark.sql import functions as F

from spoor.catalog.rebuild import CLOSED
from spoor.catalog.registry import query
from spoor.catalog.spans import BUCKET
from spoor.catalog.stacks import PATHS, TREE
from spoor.catalog.views import WEEK_US
from spoor.functions.buckets import span_bucket
from spoor.operators import rebuild, series, stacks
from spoor.operators.ingest import read_events
from spoor.session import checkpoint_dir
from spoor.sources import tables as op
from spoor.sources.counted import write_counted
from spoor.streaming import jobs


def scratch(t) -> str:
    """A new folder beside the checkpoints."""
    return f"{checkpoint_dir(t.spark)}/spoor-{uuid.uuid4().hex}"


def placed(df):
    """Partition values: the month stands for the day, to keep the folder count of the check small."""
    month = F.concat(F.lit("m"), F.expr("start_ns div 7776000000000000").cast("string"))
    return df.withColumn("date", month).withColumn("service", F.lit("svc"))


def polls(t):
    return placed(t.polls()).withColumn("source_key", F.concat("date", F.lit("/"), "host"))


PLACED = """pp AS (SELECT * REPLACE (concat('m', start_ns // 7776000000000000, '/', host) AS source_key) FROM v_polls)"""


@query("write_samples", "SELECT host, source, count(*) AS n, count(poll_duration_ns) AS in_poll, sum(ts_ns % 1000003)::bigint AS checksum FROM v_samples GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    rows = t.samples().select("ts_ns", "stack_id", "worker_id", "source", "poll_duration_ns", "spawn_location", "service", "host").withColumn(
        "date", F.lit("all")).withColumn("source_key", F.col("host")).withColumn("leaf", op.leaf(F.col("source_key")))
    op.write_samples(rows, out)
    return op.read_table(t.spark, out, "samples").groupBy("host", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("poll_duration_ns").alias("in_poll"), F.sum(F.col("ts_ns") % 1000003).alias("checksum"))


@query("write_stacks", "SELECT stack_id, array_to_string(frames, ';') AS stack FROM v_stacks")
def _(t):
    out = scratch(t)
    rows = t.stacks().select("stack_id", "frames", F.lit("svc").alias("service"), F.lit("all").alias("date"), F.lit("h").alias("host"), F.lit("0").alias("leaf"))
    op.write_stacks(rows.unionByName(rows), out)  # a stack seen twice is stored once
    return op.read_table(t.spark, out, "stacks").select("stack_id", F.array_join("frames", ";").alias("stack"))


@query("stored_flamegraph", f"WITH RECURSIVE paths AS {PATHS.format('')}, {TREE} SELECT path, depth, samples FROM tree")
def _(t):
    """Every host is a file with its own copy of the stacks it saw; read back, each stack counts once."""
    out = scratch(t)
    samples = t.samples().select("ts_ns", "stack_id", "worker_id", "source", "service", "host").withColumn("date", F.lit("all")).withColumn("source_key", F.concat("host", F.lit("/"), F.expr("ts_ns % 2").cast("string")))
    seen = samples.select("stack_id", "service", "date", "host", "source_key").distinct().join(t.stacks(), "stack_id")
    op.fold_write(t.spark, out, samples.select("source_key"), {"samples": samples, "stacks": seen.select("stack_id", "frames", "service", "date", "host", "source_key")})
    counts = stacks.stack_counts(op.read_table(t.spark, out, "samples"))
    return stacks.flamegraph_tree(stacks.resolve_stacks(counts, op.read_table(t.spark, out, "stacks"))).select("path", "depth", "samples")


@query("write_polls", "SELECT host, worker_id, count(*) AS n, sum(duration_ns)::bigint AS busy_ns, count(scheduling_delay_ns) AS measured FROM v_polls GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    op.write_polls(polls(t).withColumn("leaf", op.leaf(F.col("source_key"))), out)
    return op.read_table(t.spark, out, "polls").groupBy("host", "worker_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("busy_ns"), F.count("scheduling_delay_ns").alias("measured"))


@query("write_spans", "SELECT host, name, count(*) AS n, sum(elapsed_ns)::bigint AS elapsed_ns, count(*) FILTER (attr_status = 'F') AS f FROM v_spans GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    rows = placed(t.spans().drop("worker_id", "span_id", "parent_span_id")).withColumn("source_key", F.concat("date", F.lit("/"), "host"))
    op.write_spans(rows.withColumn("leaf", op.leaf(F.col("source_key"))), out)
    return op.read_table(t.spark, out, "spans").groupBy("host", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed_ns").alias("elapsed_ns"), F.count_if(F.col("attributes")["status"] == "F").alias("f"))


def fold_twice(t):
    """The early sources first, then all: the second run must only add the rest."""
    out = scratch(t)
    p = polls(t)
    early = p.filter(F.col("start_ns") < 880_000_000_000_000_000)
    op.fold_write(t.spark, out, early.select("source_key"), {"polls": p})  # of the table, only the sources named are written
    op.fold_write(t.spark, out, p.select("source_key"), {"polls": p})
    op.fold_write(t.spark, out, p.select("source_key"), {"polls": p})
    return out


@query("fold_write", f"WITH {PLACED} SELECT source_key, count(*) AS n, sum(duration_ns)::bigint AS busy_ns FROM pp GROUP BY 1")
def _(t):
    return op.read_table(t.spark, fold_twice(t), "polls").groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("busy_ns"))


@query("compacted_table", f"WITH {PLACED} SELECT source_key, count(*) AS n, sum(duration_ns)::bigint AS busy_ns FROM pp GROUP BY 1")
def _(t):
    """Batches of which one replaces files of another, written as one; then the old ones go."""
    out, p = fold_twice(t), polls(t)
    late = p.filter(F.col("start_ns") >= 880_000_000_000_000_000).select("source_key")
    op.fold_write(t.spark, out, late, {"polls": p}, replace=True)
    op.compact(t.spark, out)
    op.vacuum(t.spark, out)
    return op.read_table(t.spark, out, "polls").groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("busy_ns"))


@query("folded_set", f"WITH {PLACED} SELECT DISTINCT source_key FROM pp")
def _(t):
    return op.folded_set(t.spark, fold_twice(t))


# Streams --------------------------------------------------------------------------------------------------

class Streamed:
    """The views over a stream of the events table."""

    def __init__(self, t):
        self.t = t

    def table(self, name):
        # A pattern, because a stream takes no single file as its path.
        return jobs.file_stream(self.t.spark, f"{self.t.sf_dir}/{name}.parque[t]", self.t.table(name).schema)

    def __getattr__(self, view):
        return lambda: getattr(type(self.t), view)(self)


@query("progressive_snapshots", "SELECT source_key, kind, count(*) AS n, max(ts_ns) AS last_ns FROM v_events GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    answer = Streamed(t).events().groupBy("source_key", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ns").alias("last_ns"))
    jobs.snapshots(answer, f"{out}/answer", f"{out}/ckpt")
    return jobs.latest_snapshot(t.spark, f"{out}/answer")


@query("incremental_merge", f"SELECT md5(o_orderpriority) AS span_type_uid, bucket, count(*) AS n FROM (SELECT o_orderpriority, {BUCKET.replace('elapsed_ns', 'cast(floor(o_totalprice * 1000) AS bigint)')} AS bucket FROM orders) GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    orders = Streamed(t).table("orders")
    cells = orders.groupBy(F.md5("o_orderpriority").alias("span_type_uid"), span_bucket(F.floor(F.col("o_totalprice") * 1000)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    jobs.snapshots(cells, f"{out}/answer", f"{out}/ckpt")
    return jobs.latest_snapshot(t.spark, f"{out}/answer")


@query("exactly_once_fold", f"WITH {PLACED} SELECT source_key AS origin, count(*) AS n, sum(duration_ns)::bigint AS busy_ns FROM pp GROUP BY 1")
def _(t):
    """A source is a file of the stream, whole in one batch; the month and host of its rows stay a column."""
    out = scratch(t)

    def fold(files):
        named = polls(Files(t, files)).withColumnRenamed("source_key", "origin").join(F.broadcast(files.select(F.first("source_file").alias("source_key"))))  # one row
        op.fold_write(t.spark, f"{out}/tables", named.select("source_key"), {"polls": named.withColumn("host", F.lit("all"))})

    jobs.fold_files(t.spark, f"{t.sf_dir}/lineitem.parque[t]", t.table("lineitem").schema, fold, out, files_per_trigger=1)
    assert jobs.failed_files(t.spark, out).isEmpty()
    return op.read_table(t.spark, f"{out}/tables", "polls", "origin string").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("busy_ns"))


class Files(Streamed):
    """The views over one batch of files of a table."""

    def __init__(self, t, rows):
        super().__init__(t)
        self.rows = rows

    def table(self, name):
        return self.rows


STREAMED = CLOSED


@query("stateful_polls", f"WITH {STREAMED} SELECT * FROM polls")
def _(t):
    """Every week of a host is a process of its own, as in the table's other queries."""
    out = scratch(t)
    events = Streamed(t).events().withColumn("boot_id", F.col("source_key"))
    jobs.stream_polls(t.spark, events, f"{out}/polls", f"{out}/ckpt")
    return jobs.streamed_polls(t.spark, f"{out}/polls").drop("host", "boot_id")


@query("windowed_rates", "SELECT ts_ns // 10000000000 * 10000000 AS start_us, kind, count(*) AS n FROM v_events GROUP BY 1, 2")
def _(t):
    out = scratch(t)
    jobs.windowed_rates(Streamed(t).events().withColumn("ts_us", F.expr("ts_ns div 1000")), f"{out}/rates", f"{out}/ckpt")
    return jobs.read_rates(t.spark, f"{out}/rates")


@query("coverage_sessions", """WITH s AS (SELECT host, ts_ns // 1000 AS us, CASE WHEN ts_ns // 1000 < lag(ts_ns // 1000) OVER (PARTITION BY host ORDER BY ts_ns) + 60000000 THEN 0 ELSE 1 END AS fresh FROM v_events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT host, min(us) AS start_us, max(us) + 60000000 AS end_us, count(*) AS n FROM g GROUP BY host, g""")
def _(t):
    out = scratch(t)
    jobs.coverage_sessions(Streamed(t).events().withColumn("ts_us", F.expr("ts_ns div 1000")), f"{out}/sessions", f"{out}/ckpt")
    return jobs.read_sessions(t.spark, f"{out}/sessions")


# Tables that know how large their keys are

def counted_events(t):
    """Events in two batches, each with the sources of one half, counted as they are written."""
    out = scratch(t)
    for batch in (0, 1):
        write_counted(t.events().filter(F.pmod(F.xxhash64("source_key"), F.lit(2)) == batch), out, batch, (("source_key",), ("source_key", "task_id")), floor=10)
    return out


@query("counted_cells", """WITH p AS (SELECT unnest(range(40, 51)) AS bits),
n AS (SELECT bits, source_key, ts_ns // (1::bigint << bits) AS cell, count(*) AS n FROM v_events, p GROUP BY 1, 2, 3)
SELECT bits::int AS bits, max(n) AS rows FROM n GROUP BY 1""")
def _(t):
    """Rows of the fullest (source, cell), as stored beside the table, for cells of 2^40 to 2^50 ns."""
    notes = t.spark.read.schema("counts array<struct<keys: array<string>, hottest: bigint, fullest: map<string, bigint>>>").json(f"{counted_events(t)}/_census")
    cells = notes.select(F.explode("counts").alias("c")).filter(F.array_size("c.keys") == 1).select(F.explode("c.fullest").alias("width", "rows"))
    return cells.groupBy(F.log2(F.col("width").cast("double")).cast("int").alias("bits")).agg(F.max("rows").alias("rows")).filter("bits between 40 and 50")


@query("counted_polls", f"WITH {CLOSED} SELECT * FROM polls")
def _(t):
    return rebuild.polls(read_events(t.spark, counted_events(t)))


@query("counted_task_timeline", """SELECT source_key, ts_ns, seq, greatest(sum(CASE WHEN kind = 'TaskSpawn' THEN 1 ELSE -1 END) OVER (PARTITION BY source_key ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING), 0)::bigint AS alive
FROM v_events WHERE kind IN ('TaskSpawn', 'TaskTerminate')""")
def _(t):
    return series.active_task_timeline(read_events(t.spark, counted_events(t)))
