"""Row-level operators on the event stream: slicing, clock alignment, filters, search, union, scope shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds that describe the file and survive every time filter.
FILE_KINDS = ("SymbolTableEntry", "SegmentMetadata", "ClockSync")
HOUR_NS = 3_600_000_000_000


def slice_trace(events: DataFrame, start_ns: int, end_ns: int, relative: bool = False, keep: Sequence[str] = FILE_KINDS) -> DataFrame:
    """Events of an inclusive time range, absolute or relative to the first event; descriptive kinds survive."""
    t = F.col("ts_ns")
    if relative:
        t = t - events.agg(F.min("ts_ns")).scalar()
    return events.filter(F.col("kind").isin(*keep) | t.between(start_ns, end_ns))


def load_range(events: DataFrame, start_ns: int, end_ns: int, keep: Sequence[str] = FILE_KINDS) -> DataFrame:
    """Inclusive filter at load; rows with an own extent (``span_start``, ``span_end``) are kept by overlap."""
    extent = F.col("span_start").isNotNull()
    overlap = (F.col("span_start") <= end_ns) & (F.col("span_end") >= start_ns)
    return events.filter(F.col("kind").isin(*keep) | (extent & overlap) | (~extent & F.col("ts_ns").between(start_ns, end_ns)))


def foldable_samples(samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """CPU samples with a stack, optionally of an inclusive range."""
    out = samples.filter((F.size("frames") > 0) & (F.col("source") != 1))
    return out if start_ns is None else out.filter(F.col("t").between(start_ns, end_ns))


def event_name_filter(custom: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Custom events other than span lifecycle events, optionally of some names."""
    out = custom.filter(~F.rlike("name", F.lit("^Span(Enter|Exit|Close)")))
    return out if names is None else out.filter(F.col("name").isin(*names))


def clock_align(events: DataFrame, keys=("source_key",)) -> DataFrame:
    """Monotonic to wall time by the source's first clock sync; the raw time where the offset is missing or would
    leave the valid range for the source's first or last event."""
    keys = list(keys)
    offset = (F.col("realtime_ns").cast("decimal(20,0)") - F.col("ts_ns")).cast("decimal(20,0)")
    sync = events.filter(F.col("kind") == "ClockSync").groupBy(*keys).agg(F.min_by(offset, F.struct("ts_ns", "seq")).alias("offset"))
    per = events.groupBy(*keys).agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).join(sync, keys)
    top = F.lit("9223372036854775807").cast("decimal(20,0)")
    valid = (F.col("lo") + F.col("offset") >= 0) & (F.col("hi") + F.col("offset") <= top)
    good = per.filter(valid).select(*keys, F.col("offset").cast("bigint").alias("offset"))
    return events.join(good, keys, "left").withColumn("wall_ns", F.coalesce(F.col("ts_ns") + F.col("offset"), F.col("ts_ns"))).drop("offset")


def search(entries: DataFrame, text: str, per_kind: int = 8) -> DataFrame:
    """Substring search over (kind, label, primary, body, ord): a prefix of the primary scores 2, else 1; the best
    ``per_kind`` of each kind."""
    want = text.strip().lower()
    hits = entries.filter(F.contains(F.lower("body"), F.lit(want)) & F.lit(want != "")).withColumn(
        "score", F.when(F.startswith(F.lower("primary"), F.lit(want)), 2).otherwise(1))
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "ord")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_kind)


def union_traces(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# Offsets of the comparison presets.
SHIFTS = {"hour": HOUR_NS, "day": 24 * HOUR_NS, "week": 7 * 24 * HOUR_NS}


def shift_scope(start: Column, preset: str) -> Column:
    """Start of the comparison window: one hour, day or week earlier."""
    return start - F.lit(SHIFTS[preset])
