"""Point-in-interval and interval-overlap joins as equi-joins on a multi-level time grid.

Every interval is filed at the finest grid level whose cell is at least as long as the interval, so it
touches two cells at most whatever its length: long and short intervals need no separate path, nothing is
broadcast, and no pair is produced twice. The other side looks up one cell per level in use (a measured list
of at most ``len(WIDTHS)`` numbers).

A cell that holds more than its share is cut into a grid of blocks: each side's rows are spread over the blocks of
their axis by a hash of the row and meet every block of the other axis, so each pair still meets once. A block holds at most
``spoor.window.rows`` rows of either side and ``PAIRS`` times as many pairs to compare, give or take the hash's unevenness; only
rows equal in all columns stay together. Cells are counted only if a key is large enough to have a hot one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.plans.timeline import rows_per_task
from spoor.session import cut_lineage

WIDTHS = tuple(1 << bits for bits in range(14, 63, 4))
#: Pairs that a block may compare, as a multiple of the rows it may hold.
PAIRS = 1024


def _level_sql(start: str, end: str) -> str:
    arms = " ".join(f"when {end} - {start} <= {w} then {i}" for i, w in enumerate(WIDTHS))
    return f"case {arms} else {len(WIDTHS) - 1} end"


def _census(keys: Sequence[str], *sides: tuple[DataFrame, str]) -> list[dict[int, int]]:
    """For each side (rows, level of a row) the levels in use and how many rows of one key each has at most, from one job: at most
    ``len(WIDTHS)`` numbers a side reach the driver."""
    stacked = None
    for i, (df, level) in enumerate(sides):
        rows = df.select(*keys, F.lit(i).alias("_side"), F.expr(level).alias("_level"))
        stacked = rows if stacked is None else stacked.union(rows)
    counts = stacked.groupBy(*keys, "_side", "_level").agg(F.count(F.lit(1)).alias("n"))
    found: list[dict[int, int]] = [{} for _ in sides]
    for r in counts.groupBy("_side", "_level").agg(F.max("n").alias("n")).collect():
        found[r["_side"]][r["_level"]] = r["n"]
    return found


def _may_be_hot(df: DataFrame, left: dict[int, int], right: dict[int, int]) -> bool:
    """Whether a cell could exceed its share: no cell has more rows than its key."""
    share, a, b = rows_per_task(df), sum(left.values()), sum(right.values())
    return max(a, b) > share or a * b > share * PAIRS


def _spread(df: DataFrame, hot: DataFrame, cell: Sequence[str], own: str, other: str) -> DataFrame:
    """Each row at one block of its own axis and at all of the other's; one block where the cell isn't hot."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    blocks = df.join(hot, list(cell), "left")
    return (
        blocks.withColumn(f"{own}_at", F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64(*hashed), F.coalesce(own, F.lit(1)))))
        .withColumn(f"{other}_at", F.explode(F.expr(f"sequence(0L, coalesce({other}, 1L) - 1)"))).drop(own, other))


def _meet(left: DataFrame, right: DataFrame, cell: Sequence[str], hot_keys: bool) -> DataFrame:
    """Rows of both sides that share a cell, block by block where it is hot."""
    cell = list(cell)
    right = right.hint("merge")  # both sides come out of an explode, so sizes estimated from files would have millions of rows broadcast
    if not hot_keys:
        return left.join(right, cell)
    share = rows_per_task(left)
    limit = share * PAIRS
    least = int(limit ** 0.5)
    counts = [df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_a"), (right, "_b"))]
    both = counts[0].join(counts[1], cell, "full").fillna(0, ["_a", "_b"])  # rows without a partner are shuffled too
    blocks = lambda own, other: F.expr(f"greatest(1, ceil({own} / least({share}L, greatest({least}L, {limit}L div greatest({other}, 1)))))")
    hot = cut_lineage(
        both.filter(f"greatest(_a, _b) > {share}L or cast(_a as double) * _b > {limit}L")
        .select(*cell, blocks("_a", "_b").alias("_rows"), blocks("_b", "_a").alias("_columns")))
    if hot.isEmpty():
        return left.join(right, cell)
    joined = _spread(left, hot, cell, "_rows", "_columns").join(_spread(right, hot, cell, "_columns", "_rows"), [*cell, "_rows_at", "_columns_at"])
    return joined.drop("_rows_at", "_columns_at")


def _cells_sql(start: str, end: str, width: str, closed: bool) -> str:
    last = end if closed else f"{end} - 1"
    return f"sequence({start} div {width}, ({last}) div {width})"


def _file_intervals(df: DataFrame, start: str, end: str, closed: bool) -> DataFrame:
    kept = df.filter(F.col(start) <= F.col(end)) if closed else df.filter(F.col(start) < F.col(end))
    widths = "array(" + ", ".join(f"{w}L" for w in WIDTHS) + ")"
    return (
        kept.withColumn("_level", F.expr(_level_sql(start, end)))
        .withColumn("_w", F.expr(f"element_at({widths}, _level + 1)"))
        .withColumn("_cell", F.explode(F.expr(_cells_sql(start, end, "_w", closed)))))


def point_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str,
    start: str,
    end: str,
    closed: bool = False,
) -> DataFrame:
    """Inner join: every point with every interval of its keys that holds it (``[start, end)`` by default)."""
    keys = list(keys)
    per_point, per_level = _census(keys, (points, "0"), (intervals, _level_sql(start, end)))
    used = sorted(per_level) or [0]
    probes = ", ".join(f"struct({i} as l, {t} div {WIDTHS[i]}L as c)" for i in used)
    left = (
        points.withColumn("_probe", F.explode(F.expr(f"array({probes})")))
        .withColumn("_level", F.col("_probe.l")).withColumn("_cell", F.col("_probe.c")).drop("_probe"))
    right = _file_intervals(intervals, start, end, closed).drop("_w")
    joined = _meet(left, right, [*keys, "_level", "_cell"], _may_be_hot(points, per_point, per_level))
    upper = F.col(t) <= F.col(end) if closed else F.col(t) < F.col(end)
    return joined.filter((F.col(start) <= F.col(t)) & upper).drop("_level", "_cell")


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
) -> DataFrame:
    """Inner join: every pair of half-open intervals of the same keys that overlap, each pair once.

    A pair meets at the coarser of its two levels: the finer side is also filed at the coarser levels in
    use, and of the cells both touch only the one holding the later start emits the pair.
    """
    keys = list(keys)
    (ls, le), (rs, re) = left_span, right_span
    per_left, per_right = _census(keys, (left, _level_sql(ls, le)), (right, _level_sql(rs, re)))
    up_left, up_right = sorted(per_left), sorted(per_right)
    hot_keys = _may_be_hot(left, per_left, per_right)

    def raised(df, start, end, levels, strict):
        kept = df.filter(F.col(start) < F.col(end)).withColumn("_own", F.expr(_level_sql(start, end)))
        slots = ", ".join(f"struct({i} as l, {WIDTHS[i]}L as w)" for i in (levels or [0]))
        op = ">" if strict else ">="
        return (
            kept.withColumn("_up", F.explode(F.expr(f"filter(array({slots}), x -> x.l {op} _own)")))
            .withColumn("_level", F.col("_up.l")).withColumn("_w", F.col("_up.w"))
            .withColumn("_cell", F.explode(F.expr(_cells_sql(start, end, "_w", False))))
            .drop("_own", "_up"))

    def meet(a, b):
        pairs = _meet(a, b, [*keys, "_level", "_cell"], hot_keys)
        return (
            pairs.filter((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
            .filter(F.expr(f"greatest({ls}, {rs}) div _w = _cell"))
            .drop("_level", "_cell", "_w"))

    fine_left = meet(raised(left, ls, le, up_right, False), _file_intervals(right, rs, re, False).drop("_w"))
    fine_right = meet(_file_intervals(left, ls, le, False), raised(right, rs, re, up_left, True).drop("_w"))
    return fine_left.unionByName(fine_right)
