"""Object keys of trace segments: parsing, scoping, listing windows, sampling order and what is already folded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.timeline import AUTO, following, prev, with_order

DATE, TIME = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{4}"
SEGMENT_FILE = r"^(-?[0-9]+)-([0-9]+)\.bin(\.gz)?$"


def strip_bucket(key: Column) -> Column:
    return F.regexp_replace(key, "^s3://[^/]*/", "")


def parse_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Adds layout, date, time, service, instance, boot_id, filename, epoch_secs and segment_index.

    The path is split once and its last seven parts are tested one by one: no pattern runs over a whole key.
    """
    df = df.withColumn("_parts", F.split(strip_bucket(F.col(key)), "/"))
    part = lambda i: F.try_element_at(F.col("_parts"), F.lit(-i))
    named = lambda i, name: F.startswith(part(i), F.lit(f"{name}="))
    is_date = lambda i, prefix="": F.rlike(part(i), F.lit(f"^{prefix}{DATE}$"))
    is_time = lambda i, prefix="": F.rlike(part(i), F.lit(f"^{prefix}{TIME}$"))
    v1 = (part(7) == "version=1") & is_date(6, "date=") & named(5, "service") & is_time(4, "time=") & named(3, "instance") & named(2, "boot")
    layout = (F.when(F.coalesce(v1, F.lit(False)), "version1").when(F.coalesce(is_date(6) & is_time(5), F.lit(False)), "positional_with_boot")
              .when(F.coalesce(is_date(5) & is_time(4), F.lit(False)), "positional_without_boot").otherwise("unknown"))
    # Generated rather than projected, so that later filters use the value and do not repeat its expression.
    name = part(1)
    number = lambda i: F.when(F.rlike(name, F.lit(SEGMENT_FILE)), F.regexp_extract(name, SEGMENT_FILE, i).cast("bigint"))
    told = F.struct(layout.alias("layout"), name.alias("filename"), number(1).alias("epoch_secs"), number(2).alias("segment_index"))
    df = df.select("*", F.inline(F.array(told)))

    def field(v1_at: int, boot_at: int, flat_at: int | None) -> Column:
        value = F.substring_index(part(v1_at), "=", -1) if v1_at in (6, 4) else F.regexp_replace(part(v1_at), "^[a-z]+=", "")
        decoded = F.try_url_decode(F.regexp_replace(value, r"\+", "%2B"))
        out = F.when(F.col("layout") == "version1", decoded).when(F.col("layout") == "positional_with_boot", part(boot_at))
        return out if flat_at is None else out.when(F.col("layout") == "positional_without_boot", part(flat_at))

    return df.select(
        "*", field(6, 6, 5).alias("date"), field(4, 5, 4).alias("time"), field(5, 4, 3).alias("service"), field(3, 3, 2).alias("instance"),
        field(2, 2, None).alias("boot_id")).drop("_parts")


def boot_identity(df: DataFrame, key: str = "key", metadata_boot: Column | None = None) -> DataFrame:
    """Boot id from metadata, else from the path, with the quality of that evidence."""
    parsed = df if "layout" in df.columns else parse_key(df, key)
    parts = F.split(strip_bucket(F.col(key)), "/")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    meta = metadata_boot if metadata_boot is not None else F.lit(None).cast("string")
    named = F.rlike(folder, F.lit("^[a-z]{4}-[0-9]+$"))
    v1 = F.col("layout") == "version1"
    return parsed.withColumn("boot", F.coalesce(meta, F.when(v1, F.col("boot_id")), F.when(folder != "", folder), F.lit(""))).withColumn(
        "identity_quality", F.when(meta.isNotNull(), "metadata").when(v1 | F.coalesce(named, F.lit(False)), "path").otherwise("flat"))


def is_trace_segment(key: Column) -> Column:
    # fixed values: folders that hold other things than segments
    return F.rlike(key, F.lit(r"\.bin(\.gz)?$")) & ~F.rlike(key, F.lit("/samples/|/dict/|/flamegraph-data/"))


def scope_filter(parsed: DataFrame, service: str | None = None, hosts: Sequence[str] = (), start_ns: int | None = None,
                 end_ns: int | None = None, segment_secs: int = 60) -> DataFrame:
    """Keys of one service and host set whose half-open file range overlaps the window; an unknown epoch is kept."""
    out = parsed.filter(F.col("layout") != "unknown")
    if service is not None:
        out = out.filter(F.col("service") == service)
    if hosts:
        out = out.filter(F.col("instance").isin(*hosts))
    begin = F.col("epoch_secs") * 1_000_000_000
    if start_ns is not None:
        out = out.filter(F.col("epoch_secs").isNull() | (begin + segment_secs * 1_000_000_000 > start_ns))
    return out if end_ns is None else out.filter(F.col("epoch_secs").isNull() | (begin < end_ns))


def listing_window(start_ns: int, end_ns: int) -> tuple[int, int, str]:
    """Padded window in seconds and the bucket grain: minutes up to two hours, else hours."""
    first, last = start_ns // 1_000_000_000, end_ns // 1_000_000_000
    grain, pad, name = (60, 120, "minute") if last - first <= 7200 else (3600, 3600, "hour")
    lo = (first - pad) // grain * grain
    hi = (last + pad) // grain * grain
    return lo, hi, name


def list_segments(parsed: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Listing rows of the buckets a window touches: a predicate on (date, time), so it prunes partitions."""
    lo, hi, grain = listing_window(start_ns, end_ns)
    minutes = F.unix_timestamp(F.concat("date", F.lit(" "), "time"), "yyyy-MM-dd HHmm")
    at = minutes if grain == "minute" else minutes - F.pmod(minutes, F.lit(3600))
    day_lo, day_hi = (F.date_format(F.timestamp_seconds(F.lit(s)), "yyyy-MM-dd") for s in (lo, hi))
    return parsed.filter(F.col("date").between(day_lo, day_hi) & (at >= lo) & (at <= hi))


def browse(parsed: DataFrame, service: str, start_ns: int, end_ns: int) -> DataFrame:
    """Objects of a service whose epoch lies in the window; complete, so never truncated."""
    return parsed.filter((F.col("service") == service) & F.col("epoch_secs").between(start_ns // 1_000_000_000, end_ns // 1_000_000_000)).withColumn(
        "truncated", F.lit(False))


def list_services(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("service").isNotNull()).groupBy("service").agg(
        F.countDistinct("instance").alias("hosts"), F.count(F.lit(1)).alias("objects"))


def discover_layout(parsed: DataFrame) -> DataFrame:
    """Which days hold which layouts of a service."""
    old = F.col("layout") != "version1"
    return parsed.filter(F.col("layout") != "unknown").groupBy("service", "date").agg(
        F.bool_or(~old).alias("version1"), F.bool_or(old).alias("historical"))


ORDER_VERSION = 1


def order_key(key: Column, version: int = ORDER_VERSION) -> Column:
    """Pseudo-random order of files: uniform over hosts and time, the same every time."""
    return F.md5(F.concat(F.lit(str(version)), key))


def sampled_files(matched: DataFrame, files: int | None = None, slot=AUTO) -> DataFrame:
    """Matched files ranked in sampling order: all of them, or the first ``files``."""
    ordered = matched.withColumn("order_key", order_key(F.col("key"))).withColumn("_at", F.conv(F.substring("order_key", 1, 12), 16, 10).cast("bigint"))
    if files is not None:
        ordered = ordered.orderBy("order_key", "key").limit(files)  # each task keeps its own first ones before the merge
    return with_order(ordered, [], ["_at", "order_key", "key"], {"rank": _count()}, slot).drop("_at")


def _count():
    from spoor.plans.timeline import running_sum

    return running_sum(F.lit(1))


def unfolded(matched: DataFrame, folded: DataFrame) -> DataFrame:
    return matched.join(folded.select("key"), "key", "left_anti")


def folded_matching(matched: DataFrame, folded: DataFrame) -> DataFrame:
    return matched.join(folded.select("key"), "key", "left_semi")


def coverage(matched: DataFrame, folded: DataFrame) -> DataFrame:
    """Files, bytes and hosts matched and folded, and an order-free digest of the folded set. Hosts are combined first, so that both
    distinct counts are plain counts of their rows."""
    part = F.conv(F.substring(F.md5("key"), 1, 12), 16, 10).cast("decimal(20,0)")
    done = F.coalesce("is_folded", F.lit(False))
    rows = matched.join(folded.select("key", F.lit(True).alias("is_folded")).distinct(), "key", "left")
    hosts = rows.groupBy("instance").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("nf"), F.sum("size").alias("b"), F.sum(F.when(done, F.col("size")).otherwise(F.lit(0))).alias("bf"),
        F.sum(F.when(done, part).otherwise(F.lit(0).cast("decimal(20,0)"))).alias("d"))
    known = F.col("instance").isNotNull()
    return hosts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files_matched"), F.coalesce(F.sum("nf"), F.lit(0)).alias("files_folded"), F.sum("b").alias("bytes_matched"),
        F.sum("bf").alias("bytes_folded"), F.count_if(known).alias("hosts_matched"), F.count_if(known & (F.col("nf") > 0)).alias("hosts_folded"),
        F.sum("d").cast("string").alias("folded_digest"))


def fold_errors(errors: DataFrame) -> DataFrame:
    """Files that could not be folded, and one message."""
    return errors.agg(F.count(F.lit(1)).alias("errors"), F.min("message").alias("sample"))


# Segments of a host on the time axis ----------------------------------------------------------------------

def segment_extents(parsed: DataFrame, keys=("instance",), slot=AUTO) -> DataFrame:
    """Extent of every file: start from its name, end from its modification time, at least a second, cut at the
    next file's start."""
    begin = F.col("epoch_secs") * 1_000_000_000
    end = F.col("modified_s") * 1_000_000_000
    rows = parsed.filter(F.col("epoch_secs") > 0).withColumn("start_ns", begin).withColumn(
        "end_ns", F.when(end > begin, end).otherwise(begin + 1_000_000_000))
    return tile_segments(rows, keys, "key", slot)


def tile_segments(segments: DataFrame, keys, tie: str, slot=AUTO) -> DataFrame:
    """Ends clamped to the next segment's start, on real overlap only; ``real_end_ns`` keeps the true end."""
    nexted = with_order(segments, list(keys), ["start_ns", tie], {"nx": following(F.col("start_ns"))}, slot)
    overlap = (F.col("nx") > F.col("start_ns")) & (F.col("nx") < F.col("end_ns"))
    return nexted.withColumn("real_end_ns", F.col("end_ns")).withColumn(
        "end_ns", F.when(overlap, F.col("nx")).otherwise(F.col("end_ns"))).drop("nx")


def host_rows(segments: DataFrame) -> DataFrame:
    return segments.groupBy("service", "host").agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("total_bytes"))


def boot_transitions(segments: DataFrame, keys=("service", "host"), slot=AUTO) -> DataFrame:
    """Changes of boot id along a host's segments; segments without one are ignored."""
    known = segments.filter(F.coalesce("boot_id", F.lit("")) != "").select(*keys, "start_us", "boot_id")
    lagged = with_order(known, list(keys), ["start_us"], {"from_boot": prev(F.col("boot_id"))}, slot)
    return lagged.filter(F.col("from_boot").isNotNull() & (F.col("from_boot") != F.col("boot_id"))).withColumnRenamed("boot_id", "to_boot")


def segment_gaps(segments: DataFrame, keys=("service", "host"), slot=AUTO) -> DataFrame:
    """Uncovered time between consecutive segments."""
    nexted = with_order(segments, list(keys), ["start_us"], {"nx": following(F.col("start_us"))}, slot)
    return nexted.filter(F.col("nx") > F.col("end_us")).select(*keys, F.col("end_us").alias("gap_start"), F.col("nx").alias("gap_end"))


def segments_overlapping(segments: DataFrame, t0: int, t1: int) -> DataFrame:
    """Segments touching a range; start inclusive, end exclusive, so a point on a border picks the later one."""
    return segments.filter((F.col("start_us") <= t1) & (F.col("end_us") > t0))


def density(segments: DataFrame, t0: int, t1: int, width: int, keys=("service", "host")) -> DataFrame:
    """Bytes per time column, each segment's bytes spread evenly over its extent."""
    step = (t1 - t0) / width
    inside = segments.withColumn("cs", F.greatest("start_us", F.lit(t0))).withColumn("ce", F.least("end_us", F.lit(t1))).filter("ce > cs")
    first, last = F.floor((F.col("cs") - t0) / step), F.least(F.floor((F.col("ce") - t0) / step), F.lit(width - 1))
    cols = inside.withColumn("col", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("ce"), t0 + (F.col("col") + 1) * step) - F.greatest(F.col("cs"), t0 + F.col("col") * step)
    return cols.withColumn("_b", F.col("size") / (F.col("end_us") - F.col("start_us")) * overlap).filter(F.col("_b") > 0).groupBy(
        *keys, "col").agg(F.sum("_b").alias("bytes"))


def region_coverage(segments: DataFrame, start: int, end: int, keys=()) -> DataFrame:
    """complete, partial or oversized over the segments overlapping a region (inclusive)."""
    hit = segments.filter((F.col("end_us") >= start) & (F.col("start_us") <= end))
    verdict = (F.when(F.coalesce(F.bool_or(F.col("state") == "oversized"), F.lit(False)), "oversized")
               .when(F.coalesce(F.bool_or(F.col("state") != "parsed"), F.lit(False)), "partial").otherwise("complete"))
    return (hit.groupBy(*keys) if keys else hit.groupBy()).agg(verdict.alias("coverage"))
