"""Which intervals of a lane hold a point, without forming (point, interval) pairs.

Intervals that cross are cut where the earlier one ends, so the pieces nest: of two, one holds the other or they are disjoint. A sweep over
starts and ends numbers the levels, and the piece one level up that began last is a piece's parent. Every start and end knows the innermost
piece right after it (the piece itself, or the parent of the one that ends), so a point finds its innermost piece by one as-of lookup; the
others that hold it are that piece's ancestors. What is wanted of all points inside an interval is gathered at the innermost pieces
and added up towards the roots, twice as far each round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.interval_join import point_in_intervals
from spoor.plans.timeline import AUTO, asof, following, measure_slot, running_sum, with_order
from spoor.session import cut_lineage

PIECE = ("start_ns", "end_ns")


def nested_pieces(intervals: DataFrame, keys: Sequence[str], ids: Sequence[str], slot=AUTO) -> DataFrame:
    """keys, ids, start_ns, end_ns: the intervals ``[start_ns, end_ns)`` cut so that none cross. There are as many cuts as ends of other, earlier
    begun intervals inside."""
    keys, ids = list(keys), list(ids)
    whole = intervals.filter(F.col("start_ns") < F.col("end_ns")).select(*keys, *ids, *PIECE)
    ends = whole.groupBy(*keys, F.col("end_ns").alias("at")).agg(F.min("start_ns").alias("began"))
    inside = point_in_intervals(ends, whole, keys, "at", *PIECE)
    cuts = inside.filter((F.col("began") < F.col("start_ns")) & (F.col("at") > F.col("start_ns"))).select(*keys, *ids, "at", "end_ns")
    bounds = whole.select(*keys, *ids, F.col("start_ns").alias("at"), "end_ns").unionByName(cuts)
    # an id may have several intervals; bounds of one follow each other under its end
    stepped = with_order(bounds, [*keys, *ids, "end_ns"], ["at"], {"next": following(F.col("at"))}, slot)
    return stepped.select(*keys, *ids, F.col("at").alias("start_ns"), F.coalesce("next", "end_ns").alias("end_ns")).distinct()


def forest(pieces: DataFrame, keys: Sequence[str], slot=AUTO) -> DataFrame:
    """keys, start_ns, end_ns, level (from 1), up_start, up_end (the parent's, null for a root) of the distinct pieces."""
    keys = list(keys)
    nodes = pieces.select(*keys, *PIECE).distinct()
    slot = measure_slot(nodes, keys, "start_ns", slot)
    # at one time ends come before starts; inner ones end first, outer ones start first
    edges = nodes.select(*keys, *PIECE, F.explode(F.array(
        F.struct(F.col("start_ns").alias("at"), F.lit(1).alias("step"), (-F.col("end_ns")).alias("tie")),
        F.struct(F.col("end_ns").alias("at"), F.lit(-1).alias("step"), (-F.col("start_ns")).alias("tie")))).alias("e")).select(*keys, *PIECE, "e.*")
    levels = with_order(edges, keys, ["at", "step", "tie"], {"level": running_sum(F.col("step"))}, slot).filter("step = 1")
    nodes = levels.select(*keys, *PIECE, F.col("level").cast("int").alias("level"))
    above = nodes.select(*keys, (F.col("level") + 1).alias("level"), F.col("start_ns").alias("up_start"), F.col("end_ns").alias("up_end"))
    return asof(nodes, above, [*keys, "level"], "start_ns", "up_start", ["up_start", "up_end"], slot=slot)


def innermost(points: DataFrame, nodes: DataFrame, keys: Sequence[str], t: str = "ts_ns", slot=AUTO) -> DataFrame:
    """The points with in_start, in_end: the innermost piece that holds each (null if none does)."""
    keys = list(keys)
    starts = nodes.select(*keys, F.col("start_ns").alias("at"), F.lit(1).alias("step"), (-F.col("end_ns")).alias("tie"), F.col("start_ns").alias("in_start"), F.col("end_ns").alias("in_end"))
    ends = nodes.select(*keys, F.col("end_ns").alias("at"), F.lit(-1).alias("step"), (-F.col("start_ns")).alias("tie"), F.col("up_start").alias("in_start"), F.col("up_end").alias("in_end"))
    return asof(points, starts.unionByName(ends), keys, t, "at", ["in_start", "in_end"], right_tie=["step", "tie"], slot=slot)


def totals_below(nodes: DataFrame, keys: Sequence[str], folds: Mapping[str, str]) -> DataFrame:
    """keys, start_ns, end_ns and, for each column of ``folds`` (``sum`` or ``min``), its total over a piece and all pieces inside it. A piece knows
    the total of those less than 2^k below it and its ancestor at 2^k, so depth d takes log2(d) rounds; no round adds rows."""
    keys = list(keys)

    def place(start: str, end: str) -> Column:
        return F.when(F.col(start).isNotNull(), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).alias("s"), F.col(end).alias("e")))

    state = cut_lineage(nodes.select(place("start_ns", "end_ns").alias("node"), place("up_start", "up_end").alias("up"), *folds))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        gifts = state.filter(F.col("up").isNotNull()).groupBy("up").agg(*[F.expr(f"{fold}({c})").alias(f"g_{c}") for c, fold in folds.items()])
        hop = state.filter(F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("up").alias("next"))
        joined = state.join(gifts.withColumnRenamed("up", "node"), "node", "left").join(hop, "up", "left")
        both = {c: F.coalesce(F.col(c) + F.col(f"g_{c}"), c, f"g_{c}") if fold == "sum" else F.least(c, f"g_{c}") for c, fold in folds.items()}
        state = cut_lineage(joined.select("node", F.col("next").alias("up"), *[v.alias(c) for c, v in both.items()]))
    return state.select(*[F.col(f"node.k{i}").alias(k) for i, k in enumerate(keys)], F.col("node.s").alias("start_ns"), F.col("node.e").alias("end_ns"), *folds)
