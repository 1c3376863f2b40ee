"""Ordered windows that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here every key's axis (time, or any
numeric order column) is cut into slots sized from a measured row count. Each (key, slot) is summarised by a
map-side combined aggregate, the summaries (a handful of values per slot) are folded along the key, and the
result is joined back as the carry into each slot, where the ordinary window runs. Keys that are small
enough get one slot, and then the plan is the ordinary window with no extra join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.plans.census import known_width

ROWS_SETTING = "spoor.window.rows"
DEFAULT_ROWS = 4_000_000
AUTO = "auto"
_GRAINS = 1 << 16


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    where: Column | None = None
    current: bool = False


def prev(value: Column, where: Column | None = None) -> Step:
    """Value of the nearest earlier row, of those satisfying ``where``."""
    return Step("prev", value, where)


def latest(value: Column, where: Column | None = None) -> Step:
    """As :func:`prev` but the current row counts too."""
    return Step("prev", value, where, True)


def following(value: Column, where: Column | None = None) -> Step:
    """Value of the nearest later row, of those satisfying ``where``."""
    return Step("next", value, where)


def running_sum(value: Column, current: bool = True) -> Step:
    return Step("sum", value, None, current)


def running_max(value: Column, current: bool = True) -> Step:
    return Step("max", value, None, current)


def running_min(value: Column, current: bool = True) -> Step:
    return Step("min", value, None, current)


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_SETTING, str(DEFAULT_ROWS)))


def hottest_key(df: DataFrame, keys: Sequence[str], axis: str) -> int | None:
    """Rows (with a place on the axis) of the largest key."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.count(axis).alias("n")).agg(F.max("n")).first()[0]


def fullest_cells(df: DataFrame, keys: Sequence[str], axis: str, grain: int) -> dict[int, int]:
    """Rows of the fullest (key, cell), for cells of ``grain`` and of the 16 powers of two above it."""
    fine = df.groupBy(*keys, F.expr(f"cast({axis} as bigint) div {grain}").alias("_grain")).agg(
        F.count(F.lit(1)).alias("_n"))
    rolled = (
        fine.select(*keys, "_n", F.col("_grain"), F.explode(F.array(*[F.lit(p) for p in range(17)])).alias("_p"))
        .groupBy(*keys, "_p", F.expr("_grain div cast(pow(2, _p) as bigint)").alias("_cell"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_p").agg(F.max("_n").alias("_n"))
    )
    return {grain << r["_p"]: r["_n"] for r in rolled.collect()}  # 17 rows


def measure_slot(df: DataFrame, keys: Sequence[str], axis: str, slot: int | str | None = AUTO) -> int | None:
    """Slot width along ``axis`` so that no (key, slot) exceeds the row target; None when keys are small.

    Of a table that was counted when it was written (``plans.census``) the width is known without a job. Otherwise one small
    aggregate decides the common case, and only when a key is too large is a histogram taken: row
    counts on a fine grid, rolled up by powers of two, and the widest grid whose fullest cell fits wins. The grid's
    grain comes from the middle of the axis, so a stray value cannot make it coarse, and where even its fullest cell is too full
    it is refined, down to single values of the axis. Rows of a key that are equal on the axis stay together.
    """
    if slot != AUTO:
        return slot
    target = rows_per_task(df)
    known = known_width(df, keys, axis, target)
    if known is not None:
        return known[0]
    hottest = hottest_key(df, keys, axis)
    if hottest is None or hottest <= target:
        return None
    low, high = df.agg(F.percentile_approx(axis, [0.001, 0.999], 10_000)).first()[0]
    grain = max(1, int(high - low) // _GRAINS)
    while True:
        fullest = fullest_cells(df, keys, axis, grain)
        fitting = [width for width, n in fullest.items() if n <= target]
        if fitting or grain == 1:
            return max(fitting, default=grain)
        grain = max(1, grain // 256)


def with_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, Step],
    slot: int | str | None = AUTO,
) -> DataFrame:
    """Add one column per step, evaluated per ``keys`` in ``order`` (columns, ascending, total order)."""
    keys, order = list(keys), list(order)
    slot = measure_slot(df, keys, order[0], slot)
    base = df.columns
    for name, step in steps.items():
        boxed = F.struct(step.value.alias("v")) if step.kind in ("prev", "next") else step.value
        df = df.withColumn(f"_{name}", boxed if step.where is None else F.when(step.where, boxed))
    part = keys
    carried: dict[str, Column] = {}
    if slot is not None:
        df = df.withColumn("_slot", F.expr(f"cast({order[0]} as bigint) div {int(slot)}"))
        part = ["_slot"]
        if keys:  # as one value the keys are compared with nulls as equal ones, so the join and the window deal rows out alike and share a shuffle
            df, part = df.withColumn("_key", F.struct(*keys)), ["_slot", "_key"]
        df, carried = _attach_carry(df, part, order, steps)
    window_sql = _window_sql(part, order)
    window = Window.partitionBy(*[F.col(k) for k in part]) if part else Window.partitionBy(F.lit(0))
    window = window.orderBy(*[F.col(c) for c in order])
    out = [F.col(c) for c in base]
    for name, step in steps.items():
        carry = carried.get(name)
        out.append(_local(name, step, window, window_sql, carry).alias(name))
    return df.select(*out)


def _window_sql(part: Sequence[str], order: Sequence[str]) -> str:
    by = ", ".join(f"`{c}`" for c in part) if part else "0"
    return f"over (partition by {by} order by {', '.join(f'`{c}`' for c in order)})"


def _local(name: str, step: Step, window, window_sql: str, carry: Column | None) -> Column:
    source = f"`_{name}`"
    if step.kind in ("prev", "next"):
        if step.kind == "prev" and step.current:
            box = F.last(F.col(f"_{name}"), ignorenulls=True).over(
                window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            func = "lag" if step.kind == "prev" else "lead"
            nulls = "ignore nulls " if step.where is not None else ""
            box = F.expr(f"{func}({source}, 1) {nulls}{window_sql}")
        return (box if carry is None else F.coalesce(box, carry)).getField("v")
    end = Window.currentRow if step.current else -1
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    func = {"sum": F.sum, "max": F.max, "min": F.min}[step.kind]
    local = func(F.col(f"_{name}")).over(frame)
    if step.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry if carry is not None else F.lit(0), F.lit(0))
    if carry is None:
        return local
    return (F.greatest if step.kind == "max" else F.least)(local, carry)


def _attach_carry(df: DataFrame, part, order, steps):
    position = F.struct(*[F.col(c) for c in order])
    aggs = []
    for name, step in steps.items():
        col = F.col(f"_{name}")
        if step.kind in ("prev", "next"):
            at = F.when(col.isNotNull(), position)
            aggs.append((F.max_by if step.kind == "prev" else F.min_by)(col, at).alias(f"_s_{name}"))
        else:
            aggs.append({"sum": F.sum, "max": F.max, "min": F.min}[step.kind](col).alias(f"_s_{name}"))
    summary = df.groupBy(*part).agg(*aggs)
    along = Window.partitionBy("_key") if "_key" in part else Window.partitionBy(F.lit(0))
    before = along.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    after = along.orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(p).alias(f"_at{p}") for p in part]
    carried = {}
    for name, step in steps.items():
        col = F.col(f"_s_{name}")
        if step.kind in ("prev", "next"):
            value = F.last(col, ignorenulls=True).over(before if step.kind == "prev" else after)
        else:
            value = {"sum": F.sum, "max": F.max, "min": F.min}[step.kind](col).over(before)
        cols.append(value.alias(f"_c_{name}"))
        carried[name] = F.col(f"_c_{name}")
    carry = summary.select(*cols)
    # rows without a place on the axis have no slot, and no carry
    return df.join(carry, [F.col(p) == F.col(f"_at{p}") for p in part], "left"), carried


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    take: Sequence[str],
    inclusive: bool = True,
    direction: str = "backward",
    right_tie: Sequence[str] = (),
    slot: int | str | None = AUTO,
) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before (or after) its time.

    No range join: both sides are stacked and the nearest right row is carried along the key, one shuffle,
    linear in both inputs. ``take`` names right columns (they come back null where nothing matches); rows at
    the same right time are ordered by ``right_tie``.
    """
    keys = list(keys)
    left_cols = left.columns
    backward = direction == "backward"
    right_first = inclusive == backward
    lhs = left.select(
        *[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.col(left_t).alias("_t"),
        F.lit(1).alias("_side"), F.struct(*left_cols).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_right"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(right_tie)])
    rhs = right.select(
        *[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.col(right_t).alias("_t"),
        F.lit(0 if right_first else 2).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*left_cols)).schema[0].dataType).alias("_left"),
        F.struct(*take).alias("_right"),
        *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(right_tie)])
    stacked = lhs.unionByName(rhs).filter(F.col("_t").isNotNull() | F.col("_left").isNotNull())
    step = (prev if backward else following)(F.col("_right"), F.col("_right").isNotNull())
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(right_tie))]]
    out = with_order(stacked, [f"_j{i}" for i in range(len(keys))], order, {"_hit": step}, slot)
    return out.filter(F.col("_left").isNotNull()).select(
        *[F.col("_left").getField(c).alias(c) for c in left_cols],
        *[F.col("_hit").getField(c).alias(c) for c in take])
