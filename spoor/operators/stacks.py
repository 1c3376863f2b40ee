"""Sample filters, stack counts and flamegraph trees.

A tree is a flat node table: one row per root-to-node path, keyed by the id of its prefix. Samples are reduced to (stack_id, count) before
the dictionary join, so the path explosion multiplies distinct stacks, never samples.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.buckets import edge_ns, log_bucket
from spoor.plans.timeline import AUTO, running_sum, with_order
from spoor.plans.trie import ROOT, SEP, numbered_paths, prefix_ids, prefix_tree, summed_to_top, with_text
from spoor.session import cut_lineage

# Facet registry: a new facet is one more entry.
FACETS: dict[str, Callable[[], Column]] = {
    "source": lambda: F.when(F.col("source") == 0, "cpu").when(F.col("source") == 1, "sched"),
    "thread_class": lambda: F.when(F.col("worker_id").isNull(), "off-worker").otherwise("worker"),
    "host": lambda: F.col("host"),
    "spawn_location": lambda: F.col("spawn_location"),
}
FACET_DEFAULTS = {"source": "cpu"}


def time_range(df: DataFrame, start_ns: int | None, end_ns: int | None, t: str = "ts_ns") -> DataFrame:
    """Rows of the half-open range."""
    if start_ns is not None:
        df = df.filter(F.col(t) >= start_ns)
    return df if end_ns is None else df.filter(F.col(t) < end_ns)


def facet_filter(df: DataFrame, chosen: Mapping[str, str] | None = None, phase: str | None = None) -> DataFrame:
    """AND of exact facet matches. Source defaults to cpu, ``all`` lifts a facet, ``phase`` overrides source."""
    values = {**FACET_DEFAULTS, **(chosen or {})}
    if phase is not None:
        values["source"] = {"on_cpu": "cpu", "blocking": "sched"}[phase]
    for name, want in values.items():
        if want not in ("", "all"):
            df = df.filter(FACETS[name]() == want)
    return df


def poll_band(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Samples whose enclosing poll duration is in the inclusive band; samples outside polls drop out."""
    if low is not None:
        df = df.filter(F.col("poll_duration_ns") >= low)
    return df if high is None else df.filter(F.col("poll_duration_ns") <= high)


def span_member_filter(df: DataFrame, type_uid: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Samples with any enclosing span of the type and elapsed band; unknown elapsed fails a bound."""

    def member(span: Column) -> Column:
        ok = span["span_type_uid"] == type_uid
        if low is not None:
            ok = ok & (span["elapsed_ns"] >= low)
        return ok if high is None else ok & (span["elapsed_ns"] <= high)

    return df.filter(F.coalesce(F.exists("enclosing_spans", member), F.lit(False)))


def stack_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("stack_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))


def sample_totals(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("total"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"),
        F.greatest(F.countDistinct("host"), F.lit(1)).alias("hosts"))


def facets(samples: DataFrame) -> DataFrame:
    """Distinct values per facet before facet filters: (facet, value). Equal combinations are combined first, so few rows are taken apart."""
    seen = samples.select(*[column().alias(n) for n, column in FACETS.items()]).distinct()
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in FACETS])
    return (
        seen.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
        .filter(F.col("value").isNotNull()).distinct())


def resolve_stacks(counts: DataFrame, stacks: DataFrame) -> DataFrame:
    """Dictionary join; counts of unknown stacks are skipped. The build side is left to runtime sizes.

    Every file of a stored table brings its own copy of a stack, so the dictionary is made distinct first, by a hash aggregate that
    combines before the shuffle; an id is a digest of its frames, so equal ids have equal frames.
    """
    return counts.join(stacks.select("stack_id", "frames").distinct(), "stack_id")


def root_path(frames: str = "frames") -> Column:
    """Frames from the root to the leaf."""
    return F.reverse(F.col(frames))


def flamegraph_tree(resolved: DataFrame, weights: Sequence[str] = ("samples",), frames: str = "frames", root_first: bool = False) -> DataFrame:
    """Node table: id, parent_id, path, parent_path, depth, name, inclusive and ``self_`` weight per weight column.

    Nodes are told apart by their ids (``plans.trie``), also where a frame holds the separator of the text. Equal stacks are combined
    node by node before the shuffle.
    """
    paths = numbered_paths(resolved, F.col(frames) if root_first else root_path(frames), weights)
    return with_text(prefix_tree(paths, weights), paths)


def flat_layout(tree: DataFrame, total: Column | int | None = None, weight: str = "samples", floor: float = 0.0,
                slot=AUTO) -> DataFrame:
    """Drawable nodes: share of the total at least ``floor``; x = offsets of earlier siblings, summed up to the top."""
    tree = cut_lineage(tree)  # read four times below; a tree is small beside its samples
    whole = tree.filter(F.col("depth") == 1).agg(F.sum(weight)).scalar() if total is None else F.lit(total)
    sized = tree.withColumn("total", whole).withColumn("_rank", -F.col(weight)).withColumn("_par", F.coalesce("parent_id", F.unhex(F.lit(ROOT))))
    offsets = with_order(sized, ["_par"], ["_rank", "name"], {"offset": running_sum(F.col(weight), False)}, slot)
    # a node weighs no more than those above it, so whatever lies above a drawn node is drawn
    drawn = offsets.filter(F.col(weight) / F.col("total") >= floor)
    x = summed_to_top(drawn, "offset").withColumnRenamed("offset", "x_units")
    return drawn.drop("offset").join(x, "id").select(
        "path", "depth", "name", weight, f"self_{weight}", (F.col("x_units") / F.col("total")).alias("x"),
        (F.col(weight) / F.col("total")).alias("w"))


def folded_lines(tree: DataFrame, weight: str = "samples") -> DataFrame:
    """``a;b;c weight`` lines with rounded self weight; zero weights omitted."""
    own = F.round(F.col(f"self_{weight}")).cast("bigint")
    return tree.filter(own > 0).select(F.concat(F.col("path"), F.lit(" "), own.cast("string")).alias("value"))


def poll_histogram(samples: DataFrame) -> DataFrame:
    """Sample-weighted quarter-octave histogram of enclosing poll durations."""
    return (
        samples.select(log_bucket(F.col("poll_duration_ns")).alias("bucket")).filter(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"))
        .select("bucket", edge_ns(F.col("bucket")).alias("lo_ns"), edge_ns(F.col("bucket") + 1).alias("hi_ns"), "samples"))


def weighted_median_bucket(histogram: DataFrame) -> DataFrame:
    """Lower edge of the bar where the cumulative samples reach half (a histogram has a few hundred bars)."""
    ranked = with_order(histogram, [], ["lo_ns"], {"cum": running_sum(F.col("samples"))}, None)
    total = histogram.agg(F.sum("samples")).scalar()
    return ranked.filter(F.col("cum") * 2 >= total).agg(F.min("lo_ns").alias("median_lo_ns"))


def diff_counts(samples: DataFrame, a: Column, b: Column) -> DataFrame:
    """Samples of each stack in two scopes of one table, in one pass: stack_id, a, b."""
    counts = samples.groupBy("stack_id").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    return counts.filter((F.col("a") > 0) | (F.col("b") > 0))


def diff_tree(resolved: DataFrame) -> DataFrame:
    """Both sides of a diff, node by node; ``resolved`` carries the two counts ``a`` and ``b`` per stack."""
    paths = numbered_paths(resolved, root_path(), ("a", "b"))
    nodes = prefix_tree(paths, ("a", "b")).filter((F.col("a") > 0) | (F.col("b") > 0))
    return with_text(nodes, paths).select("id", "path", "a", "b", "self_a", "self_b")


def diff_join(a: DataFrame, b: DataFrame, weight: str = "samples") -> DataFrame:
    """Full outer merge of two resolved tables by node: both are stacked and add up in one aggregate, so neither is built first."""
    zero = F.lit(0).cast("bigint")
    return diff_tree(a.select("frames", F.col(weight).cast("bigint").alias("a"), zero.alias("b")).unionByName(
        b.select("frames", zero.alias("a"), F.col(weight).cast("bigint").alias("b"))))


def diff_score(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """log2 ratio of shares over four octaves, clamped to [-1, 1]; one shared epsilon for both sides."""
    ta = F.when(total_a > 0, total_a).otherwise(F.lit(1))
    tb = F.when(total_b > 0, total_b).otherwise(F.lit(1))
    eps = F.lit(0.5) / F.greatest(ta, tb)
    score = F.log2((b / tb + eps) / (a / ta + eps)) / 4
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def inspect(resolved: DataFrame, focus: str, weight: str = "samples") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Butterfly of one function: callers tree, callees tree, and (total, self).

    Only the top-most occurrence on a stack is a call site; self weight counts nested recursion too.
    """
    rooted = resolved.select(F.reverse("frames").alias("r"), weight).filter(F.array_contains("r", focus))
    at = F.array_position("r", F.lit(focus)).cast("int")
    callees = flamegraph_tree(
        rooted.select(F.expr(f"slice(r, {_pos(focus)}, size(r))").alias("frames"), weight), (weight,), root_first=True)
    callers = flamegraph_tree(
        rooted.select(F.reverse(F.slice("r", F.lit(1), at)).alias("frames"), weight), (weight,), root_first=True)
    totals = rooted.agg(
        F.sum(weight).alias("total"),
        F.sum(F.when(F.element_at("r", -1) == focus, F.col(weight)).otherwise(F.lit(0))).alias("self"))
    return callers, callees, totals


def _pos(focus: str) -> str:
    quoted = focus.replace("\\", "\\\\").replace("'", "\\'")
    return f"cast(array_position(r, '{quoted}') as int)"


def frame_search(resolved: DataFrame, text: str, weight: str = "samples") -> DataFrame:
    """Matching functions: inclusive total (once per stack), self total and number of call paths."""
    # a site is the path down to the topmost call; its id stands for it
    rooted = resolved.select(root_path().alias("r"), weight).filter(F.exists("r", lambda f: F.contains(F.lower(f), F.lit(text.lower()))))
    rooted = rooted.withColumn("ids", prefix_ids(F.col("r")))
    hits = rooted.select("r", "ids", weight, F.explode(F.array_distinct("r")).alias("name")).filter(
        F.contains(F.lower("name"), F.lit(text.lower())))
    site = F.element_at("ids", F.array_position("r", F.col("name")).cast("int") + 1)
    return hits.groupBy("name").agg(
        F.sum(weight).alias("total"),
        F.sum(F.when(F.element_at("r", -1) == F.col("name"), F.col(weight)).otherwise(F.lit(0))).alias("self"),
        F.countDistinct(site).alias("sites"))


def search_coverage(resolved: DataFrame, text: str, weight: str = "samples") -> DataFrame:
    """Union coverage of all matches: weight of stacks holding at least one."""
    hit = F.exists("frames", lambda f: F.contains(F.lower(f), F.lit(text.lower())))
    return resolved.agg(
        F.sum(F.when(hit, F.col(weight)).otherwise(F.lit(0))).alias("covered"), F.sum(weight).alias("total"))


def frame_time_extent(samples: DataFrame, stacks: DataFrame, root_path: Sequence[str]) -> DataFrame:
    """First and last sample whose root path starts with ``root_path``."""
    want = F.array(*[F.lit(p) for p in root_path])
    under = stacks.filter(F.slice(F.reverse("frames"), 1, len(root_path)) == want).select("stack_id")
    return samples.join(under, "stack_id", "left_semi").agg(
        F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("samples"))


def dedupe_stacks(samples: DataFrame, frames: str = "frames") -> DataFrame:
    """Groups of identical stacks with their count and leaf. Names may hold the separator, so the frames themselves are compared."""
    groups = samples.groupBy(F.col(frames).alias("_frames")).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(F.array_join("_frames", SEP).alias("stack"), "n", F.try_element_at("_frames", F.lit(1)).alias("leaf"))


def off_cpu_split(samples: DataFrame) -> DataFrame:
    """Scheduler samples inside polls (blocking), by location, against those between polls (idle)."""
    return samples.filter(F.col("source") == 1).groupBy(
        F.col("poll_duration_ns").isNotNull().alias("in_poll"),
        F.when(F.col("poll_duration_ns").isNotNull(), F.coalesce("spawn_location", F.lit("(unknown spawn location)")))
        .alias("loc"),
    ).agg(F.count(F.lit(1)).alias("n"))


def delta_digest(samples: DataFrame) -> DataFrame:
    """Order-free digest of the on-CPU samples' distances from the first one, which a shift of the clock leaves alone."""
    on = samples.filter(F.col("source") == 0)
    first = on.agg(F.min("ts_ns")).scalar()
    counts = on.groupBy((F.col("ts_ns") - first).alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("delta").cast("string"), F.col("n").cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return counts.agg(F.sum("n").alias("samples"), F.max("delta").alias("span_ns"), F.sum(part).cast("string").alias("digest"))


def top_stacks(resolved: DataFrame, k: int = 10) -> DataFrame:
    """The commonest stacks of :func:`resolve_stacks`."""
    return resolved.select("samples", F.array_join("frames", SEP).alias("stack")).orderBy(F.desc("samples"), "stack").limit(k)


def trace_properties(samples: DataFrame) -> DataFrame:
    """Counts by source and runtime membership, distinct stacks, and an order-free digest of the stack multiset.

    The digest is the xor-free sum of per-stack hashes of (stack, count), so no list is gathered.
    """
    counts = samples.groupBy("stack_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == 0).alias("cpu"),
        F.count_if(F.col("source") == 1).alias("sched"), F.count_if(F.col("worker_id").isNull()).alias("off"))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "stack_id", F.col("n").cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return counts.agg(
        F.sum("n").alias("total"), F.sum("cpu").alias("cpu"), F.sum("sched").alias("sched"),
        F.sum("off").alias("off_runtime"), (F.sum("n") - F.sum("off")).alias("on_runtime"),
        F.count(F.lit(1)).alias("distinct_stacks"), F.sum(part).cast("string").alias("digest"))
