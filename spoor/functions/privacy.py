"""Coarsening of numbers and renumbering of ids, so that a trace's shape can be shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.buckets import octave
from spoor.plans.timeline import AUTO, running_sum, with_order

QUANTUM_NS = 10_000


def quantize_ns(ns: Column) -> Column:
    return ns - F.pmod(ns, F.lit(QUANTUM_NS))


def quantize_numeric(value: Column) -> Column:
    """Top ten bits, rounded up; values of ten bits or fewer are exact."""
    size = F.pow(F.lit(2.0), octave(value) - 9).cast("bigint")
    top = (value - F.pmod(value, size)) / size
    return F.when(value < 1024, value).otherwise(((top + 1) * size).cast("bigint"))


def quantize_f64(value: Column) -> Column:
    """Three significant decimal digits."""
    factor = F.pow(F.lit(10.0), F.lit(2) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * F.floor(F.abs(value) * factor + 0.5) / factor)


def privacy_bucket(value: Column) -> Column:
    """A number of the same magnitude that never equals the input."""
    base = F.pow(F.lit(2.0), octave(value)).cast("bigint")
    half, quarter = F.shiftright(base, 1), F.shiftright(base, 2)
    guess = base + half + quarter + 1
    return F.when(value == 0, F.lit(0)).when(value <= 2, value + 2).when(guess == value, guess + quarter).otherwise(guess)


def renumber(df: DataFrame, column: str, seen: str, slot=AUTO) -> DataFrame:
    """(old id, new id): dense numbers from 1 in order of first appearance; 0 stays 0."""
    first = df.filter(F.col(column) != 0).groupBy(column).agg(F.min(seen).alias("at"))
    ranked = with_order(first, [], ["at", column], {"new_id": running_sum(F.lit(1))}, slot)
    zero = df.filter(F.col(column) == 0).select(column).distinct().withColumn("new_id", F.lit(0).cast("bigint"))
    return ranked.select(column, F.col("new_id").cast("bigint").alias("new_id")).unionByName(zero)


def capabilities(metadata: Column, spawns: Column) -> dict[str, Column]:
    """What a recording holds, by its metadata (fixed key names of the recorder; absent means everything)."""
    polls, queue = metadata["tokio.poll_coverage"], metadata["tokio.local_queue"]
    return {
        "full_task_coverage": ~F.coalesce(F.endswith(polls, F.lit("-spawns-only")), F.lit(False)),
        "local_queue_depth": F.coalesce(queue != "false", F.lit(True)), "task_lifetimes": spawns > 0}
