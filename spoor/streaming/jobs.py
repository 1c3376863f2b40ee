"""Trace analysis on streams: growing answers, exactly-once folding, polls across files, event-time rates, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.operators.rebuild import LIFECYCLE, ORDER
from spoor.plans.timeline import AUTO, following, measure_slot, running_max, running_sum, with_order
from spoor.sources.tables import path_exists
from spoor.streaming.tiers import read_parts, write_part

def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Files as they arrive, each whole in one batch. A file that cannot be read stops the stream; see ``fold_files``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


FAILED = "file string, message string"


def fold_files(spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], None], out: str, files_per_trigger: int | None = None) -> None:
    """Fold files as they arrive and count those that fail.

    The stream carries names only. A batch's files are read together; if that fails, halves are tried until those that cannot be read
    stand alone (about twice the logarithm of the batch in jobs for each such file); they are written to ``out``/failed with the message, and the others are folded. Failed files stay pending: every batch and every
    call tries them again and rewrites the table of failures. ``fold`` must be idempotent by file (column ``source_file``).
    """
    failed = f"{out}/failed"

    def rows(files: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*files).withColumn("source_file", F.col("_metadata.file_path"))

    def process(files: list[str]) -> None:
        errors: list[tuple[str, str]] = []
        if files:
            try:
                fold(rows(files))
            except Exception:  # one file or more; find out which
                errors = unreadable(files, rows)
                if not errors:
                    raise  # not a file's fault
                good = sorted(set(files) - {file for file, _ in errors})
                if good:
                    fold(rows(good))
        spark.createDataFrame(errors, FAILED).coalesce(1).write.mode("overwrite").parquet(failed)

    def pending() -> list[str]:
        if not path_exists(spark, failed):
            return []
        return [r["file"] for r in failed_files(spark, out).collect()]  # as many as files that cannot be read

    def write(batch: DataFrame, _batch_id: int) -> None:
        process(sorted({r["path"] for r in batch.collect()} | set(pending())))  # a batch holds files_per_trigger names

    if pending():
        process(sorted(pending()))
    listing = "path string, modificationTime timestamp, length long, content binary"  # fixed by the source; contents aren't read
    names = spark.readStream.format("binaryFile").schema(listing).option("maxFilesPerTrigger", files_per_trigger or 1000).load(path).select("path")
    run_available(names, write, f"{out}/ckpt", "append")


def unreadable(files: list[str], rows: Callable[[list[str]], DataFrame]) -> list[tuple[str, str]]:
    """Files that cannot be read, each with the reason: halves are read without a result until the bad ones stand alone."""
    try:
        rows(files).write.format("noop").mode("overwrite").save()
        return []
    except Exception as error:
        if len(files) == 1:
            return [(files[0], str(error))]
    middle = len(files) // 2
    return unreadable(files[:middle], rows) + unreadable(files[middle:], rows)


def failed_files(spark: SparkSession, out: str) -> DataFrame:
    """Files that could not be read so far, with the reason."""
    return spark.read.schema(FAILED).option("recursiveFileLookup", "true").parquet(f"{out}/faile[d]")


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    """Process everything that has arrived, batch by batch, and return."""
    query = (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def snapshots(answer: DataFrame, out: str, checkpoint: str) -> None:
    """A full fresh answer after every batch, numbered; repeating a batch rewrites the same number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    run_available(answer, write, checkpoint, "complete")


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    table = spark.read.parquet(out)
    return table.filter(F.col("version") == table.agg(F.max("version")).scalar()).drop("version")


RATES = "start_us bigint, kind string, n bigint"
RUNS = "host string, start_us bigint, end_us bigint, n bigint"


def windowed_rates(events: DataFrame, out: str, checkpoint: str, width_us: int = 10_000_000) -> None:
    """Events per kind and time window (of ``ts_us``). Every batch writes its own counts under its number, and tiers of parts are added up as they
    fill (``streaming.tiers``); ``read_rates`` adds what is left. A row counts however late it comes, and open windows are there from their
    first event."""

    def write(batch: DataFrame, batch_id: int) -> None:
        start = F.expr(f"ts_us - pmod(ts_us, {width_us})").alias("start_us")
        write_part(batch.groupBy(start, "kind").agg(F.count(F.lit(1)).alias("n")), out, batch_id, added_rates)

    run_available(events, write, checkpoint, "append")


def added_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("start_us", "kind").agg(F.sum("n").alias("n"))


def read_rates(spark: SparkSession, out: str) -> DataFrame:
    return added_rates(read_parts(spark, out, RATES))


def coverage_sessions(events: DataFrame, out: str, checkpoint: str, gap_us: int = 60_000_000) -> None:
    """Runs of activity per host without a gap of the given length: each batch's own runs, joined across batches as tiers of parts fill, and
    for the rest by ``read_sessions``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("host", F.col("ts_us").alias("start_us"), (F.col("ts_us") + gap_us).alias("end_us"), F.lit(1).cast("bigint").alias("n"))
        write_part(joined_runs(rows), out, batch_id, joined_runs)

    run_available(events, write, checkpoint, "append")


def read_sessions(spark: SparkSession, out: str) -> DataFrame:
    return joined_runs(read_parts(spark, out, RUNS))


def joined_runs(runs: DataFrame, slot=AUTO) -> DataFrame:
    """Runs of a host that begin before an earlier one has ended, joined (host, start_us, end_us, n). Equal runs are combined first."""
    rows = runs.groupBy("host", "start_us", "end_us").agg(F.sum("n").alias("n"))
    width = measure_slot(rows, ["host"], "start_us", slot)
    reach = with_order(rows, ["host"], ["start_us", "end_us"], {"reach": running_max(F.col("end_us"), False)}, width)
    fresh = F.when(F.col("start_us") < F.col("reach"), F.lit(0)).otherwise(F.lit(1))
    grouped = with_order(reach.withColumn("fresh", fresh), ["host"], ["start_us", "end_us"], {"run": running_sum(F.col("fresh"))}, width)
    return grouped.groupBy("host", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")).drop("run")


CARRY = "source_key string, host string, boot_id string, worker_id int, task_id bigint, spawn_loc string, ts_ns bigint, seq bigint, kind string"
CARRIED = [c.split()[0] for c in CARRY.split(", ")]
#: A worker lives as long as its process, over many files.
PROCESS = ["host", "boot_id"]
LIFE = [*PROCESS, "worker_id"]


def stream_polls(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, keep_ns: int | None = None, slot=AUTO) -> None:
    """Poll starts with the event that ends them, also when that arrives in a later batch.

    A lane is a worker of a process (host and boot), so a poll that a change of files cuts in two is one poll. Batches must not run
    backwards in time within a lane. What a lane leaves open at the end of a batch (its last event, when that is a poll start) is a
    small table written beside the batch and read by the next one, so a repeated batch starts from the same state. It has a row for
    each worker at most, and none once the worker's next event has come. With ``keep_ns``, a start of a worker that has been silent for so
    long, by its host's clock, moves to a table of its own and is not carried further. Nothing runs in Python and no lane is gathered: inside a batch the
    work is one ordered window.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        boot = F.col("boot_id") if "boot_id" in batch.columns else F.lit("").alias("boot_id")
        rows = batch.filter(F.col("kind").isin(*LIFECYCLE)).withColumn("boot_id", F.coalesce(boot, F.lit(""))).select(*CARRIED)
        if batch_id == 0:
            rows.filter(F.lit(False)).select(*CARRIED).write.mode("overwrite").parquet(f"{out}/lost/batch=0")
        else:
            left = session.read.schema(CARRY).parquet(f"{out}/open/batch={batch_id - 1}")
            left = left.join(rows.groupBy("host").agg(F.max("ts_ns").alias("now")), "host", "left").join(rows.select(*LIFE, F.lit(True).alias("seen")).distinct(), LIFE, "left")
            over = F.coalesce(F.col("seen").isNull() & (F.col("now") - F.col("ts_ns") > F.lit(keep_ns)), F.lit(False))
            left.filter(over).select(*CARRIED).write.mode("overwrite").parquet(f"{out}/lost/batch={batch_id}")
            rows = rows.unionByName(left.filter(~over).select(*CARRIED))
        width = measure_slot(rows, LIFE, "ts_ns", slot)
        stepped = with_order(rows, LIFE, ORDER, {"n": following(F.struct("kind", *ORDER))}, width)
        starts = stepped.filter(F.col("kind") == "PollStart")
        starts.filter(F.col("n").isNull()).select(*CARRIED).write.mode("overwrite").parquet(f"{out}/open/batch={batch_id}")
        starts.filter(F.col("n").isNotNull()).select(
            "source_key", *LIFE, "task_id", "spawn_loc", "seq", F.col("ts_ns").alias("start_ns"), F.col("n.kind").alias("closed_by"),
            F.col("n.ts_ns").alias("end_ns"), F.col("n.seq").alias("end_seq"),
        ).write.mode("overwrite").parquet(f"{out}/closed/batch={batch_id}")

    run_available(events, write, checkpoint, "append")


def streamed_polls(spark: SparkSession, out: str, slot=AUTO) -> DataFrame:
    """Polls with a proven end from the streamed starts. A start whose task started elsewhere before its end is
    dropped; the starts still open take part in that test."""
    closed = spark.read.parquet(f"{out}/closed").drop("batch")
    still = spark.read.schema(CARRY + ", batch int").parquet(f"{out}/open")
    last = still.filter(F.col("batch") == still.agg(F.max("batch")).scalar())
    lost = spark.read.schema(CARRY).parquet(f"{out}/lost")
    left = last.drop("batch").unionByName(lost.select(*CARRIED)).select("source_key", *LIFE, "task_id", "spawn_loc", "seq", F.col("ts_ns").alias("start_ns"))
    starts = closed.unionByName(left, allowMissingColumns=True)
    moved = with_order(starts, [*PROCESS, "task_id"], ["start_ns", "seq"], {"m": following(F.struct("worker_id", "start_ns", "seq"))}, slot)
    migrated = F.col("m").isNotNull() & (F.col("m.worker_id") != F.col("worker_id")) & (
        F.struct("m.start_ns", "m.seq") < F.struct(F.col("end_ns").alias("start_ns"), F.col("end_seq").alias("seq")))
    return moved.filter(F.col("closed_by").isin("PollEnd", "WorkerPark") & ~migrated).select(
        "source_key", *LIFE, "task_id", "spawn_loc", "seq", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        (F.col("closed_by") == "PollEnd").alias("explicit_end"))
