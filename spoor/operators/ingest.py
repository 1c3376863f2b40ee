"""From raw events to the four trace tables: every source file's polls, samples, stacks and spans, ready to be folded."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import rebuild, spans as sp
from spoor.operators.rebuild import TASK
from spoor.plans.interval_join import point_in_intervals
from spoor.plans.timeline import AUTO
from spoor.schema import conform
from spoor.session import cut_lineage
from spoor.sources.counted import with_counts
from spoor.sources.tables import WRITE_ORDER, fold_write

SEP = "\0"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder in the columns of the events schema; absent optional columns read as null. What was counted of a folder that
    ``sources.counted`` wrote comes along."""
    return with_counts(conform(spark.read.parquet(path), "events"), path)


def stack_id(frames: str) -> Column:
    return F.md5(F.array_join(frames, SEP))


def ingest_polls(events: DataFrame, attributed: DataFrame, slot=AUTO, starts: DataFrame | None = None) -> DataFrame:
    """Polls with readiness, the latest instrumentation flag of their task, and the samples that fell into them."""
    ready = rebuild.readiness(events, slot, starts)
    counts = rebuild.poll_sample_counts(attributed).withColumnRenamed("poll_seq", "seq")
    rows = ready.join(counts, ["source_key", "seq"], "left").join(rebuild.task_instrumented(events), TASK, "left")
    zero = F.lit(0)
    return conform(rows.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).withColumn("task_instrumented", F.col("instrumented"))
                   .withColumn("cpu_sample_count", F.coalesce("cpu_samples", zero).cast("int")).withColumn("sched_sample_count", F.coalesce("sched_samples", zero).cast("int"))
                   .drop("cpu_samples", "sched_samples", "instrumented", "seq"), "polls")


def ingest_stacks(samples: DataFrame) -> DataFrame:
    """Each source's distinct stacks."""
    return samples.select("source_key", stack_id("frames").alias("stack_id"), "frames").distinct()


def ingest_spans(events: DataFrame, polls: DataFrame, sources: DataFrame, slot=AUTO) -> DataFrame:
    """Span rows with identity, parent and completeness; ``sources``: source_key, boot_id, identity_quality, boundary_ns (first clock
    reading of the file).

    Details are complete if the span was entered, nothing is unbalanced, it began after the file did, and its process is known from
    metadata or path.
    """
    built = cut_lineage(sp.spans_enter_exit(events, polls, slot))
    instance = lambda segment: F.concat_ws("#", F.col("span_id").cast("string"), segment.cast("string"))
    placed = sp.resolve_parents(built, slot).select("source_key", "span_id", "segment", "parent_segment")
    rows = built.join(placed, sp.SPAN, "left").join(sources, "source_key", "left")
    above = F.concat_ws("#", F.col("parent_span_id").cast("string"), F.col("parent_segment").cast("string"))
    null = F.lit(None).cast("string")
    complete = (F.col("active_ns").isNotNull() & (F.col("unbalanced_enters") == 0) & (F.col("unbalanced_exits") == 0)
                & (F.col("start_ns") >= F.col("boundary_ns")) & F.col("identity_quality").isin("metadata", "path"))
    return rows.select(
        *sp.SPAN, sp.span_identity(F.col("boot_id"), instance(F.col("segment"))).alias("span_uid"),
        sp.span_type_identity(F.lit("tracing"), null, F.col("name"), null, null).alias("span_type_uid"), F.lit("tracing").alias("kind"), "name",
        "start_ns", "end_ns", "elapsed_ns", "active_ns", "observed_active_wall_ns", F.col("observed_active_wall_ns").alias("detail_coverage_ns"),
        F.coalesce(complete, F.lit(False)).alias("details_complete"), "concurrent",
        F.when(F.col("parent_segment").isNotNull(), sp.span_identity(F.col("boot_id"), above)).alias("parent_span_uid"),
        "on_cpu_ns_est", "async_wait_ns", "unknown_ns", "attribution_flags", F.col("unbalanced_exits").cast("int").alias("unbalanced_exits"),
        F.col("unbalanced_enters").cast("int").alias("unbalanced_enters"), "identity_quality", "attributes")


def samples_in_spans(attributed: DataFrame, pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """(sample, span) where the span was entered by the sample's task at that time, once each."""
    entered = pairs.filter(F.col("state") == "paired").select("source_key", F.col("lane").alias("poll_task"), F.col("start_ns").alias("in_ns"),
                                                             F.col("end_ns").alias("out_ns"), "span_id", "segment")
    told = attributed.filter(F.col("poll_task").isNotNull()).select("source_key", "sample_id", "t", "source", "poll_task")
    hits = point_in_intervals(told, entered, ["source_key", "poll_task"], "t", "in_ns", "out_ns")
    hits = hits.select("source_key", "sample_id", "source", "span_id", "segment").distinct()
    return hits.join(spans.select(*sp.SPAN, "span_uid", "span_type_uid", "elapsed_ns", "details_complete"), sp.SPAN)


def ingest_samples(attributed: DataFrame, inside: DataFrame) -> DataFrame:
    """Samples with their stack, worker, poll and enclosing spans (a list for each sample: as long as spans are nested)."""
    member = F.struct("span_uid", "span_type_uid", "elapsed_ns", "details_complete")
    lists = inside.groupBy("source_key", "sample_id").agg(F.sort_array(F.collect_list(member)).alias("enclosing_spans"))
    rows = attributed.join(lists, ["source_key", "sample_id"], "left")
    return conform(rows.select(
        F.col("t").alias("ts_ns"), stack_id("frames").alias("stack_id"), "worker_id", "source", "source_key",
        (F.col("poll_end") - F.col("poll_start")).alias("poll_duration_ns"), F.col("poll_loc").alias("spawn_location"), "enclosing_spans"), "samples")


def ingest(events: DataFrame, span_events: DataFrame, samples: DataFrame, sources: DataFrame, slot=AUTO, tables: Collection[str] = WRITE_ORDER) -> dict[str, DataFrame]:
    """The tables asked for (all four by default) of the given sources, with the parts they need. Shared parts are written once."""
    made = {"stacks": ingest_stacks(samples)} if "stacks" in tables else {}
    if not {"polls", "spans", "samples"} & set(tables):
        return made
    width = rebuild.time_slot(events, slot)
    starts = cut_lineage(rebuild.closed_starts(events, width))
    runs = cut_lineage(rebuild.polls(events, width, starts))
    attributed = cut_lineage(rebuild.attribute_samples(samples, events, runs, width))
    if "polls" in tables:
        made["polls"] = ingest_polls(events, attributed, width, starts)
    if not {"spans", "samples"} & set(tables):
        return made
    spans = cut_lineage(ingest_spans(span_events, runs, sources, slot))
    pairs = sp.pair_lifo(sp.pairing_lanes(sp.close_segments(span_events, slot), runs, slot), [*sp.SPAN, "lane"], slot)
    inside = cut_lineage(samples_in_spans(attributed, pairs, spans))
    if "samples" in tables:
        made["samples"] = ingest_samples(attributed, inside)
    if "spans" not in tables:
        return made
    counts = inside.groupBy(*sp.SPAN).agg(F.count_if(F.col("source") == 0).cast("int").alias("cpu_sample_count"), F.count_if(F.col("source") == 1).cast("int").alias("sched_sample_count"))
    full = spans.join(counts, sp.SPAN, "left").fillna(0, ["cpu_sample_count", "sched_sample_count"]).drop("span_id", "segment")
    return {**made, "spans": conform(full, "spans")}


def ingest_files(spark: SparkSession, out: str, tables: dict[str, DataFrame], sources: DataFrame) -> None:
    """Fold the tables; ``sources``: source_key, service, date and host of every file, files without rows included."""
    place = sources.select("source_key", "service", "date", "host")
    fold_write(spark, out, place, {name: rows.join(place, "source_key") for name, rows in tables.items()})
