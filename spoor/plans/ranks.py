"""Exact order statistics without collecting a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.timeline import AUTO, measure_slot, running_sum, with_order


def value_counts(df: DataFrame, keys: Sequence[str], value: str, slot=AUTO) -> DataFrame:
    """Distinct values per key with their count, ascending cumulative count and the key's total."""
    rows = df.filter(F.col(value).isNotNull())
    # Measured on the rows, an upper bound of the distinct values: a pruned scan instead of a second aggregation.
    slot = measure_slot(rows, keys, value, slot)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_order(counts, keys, [value], {"cum": running_sum(F.col("n"))}, slot)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return ranked.join(totals, list(keys))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: Mapping[str, Callable[[Column], Column]],
    slot=AUTO,
) -> DataFrame:
    """Per key the values at the given 0-based ascending positions; a pick maps the row count to a position.

    Equal values are combined before the shuffle, so a key's rows are never gathered: only its distinct
    values are ranked, in slots when there are many.
    """
    if not keys:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, picks, slot).drop("_all")
    ranked = value_counts(df, keys, value, slot)
    aggs = [F.min(F.when(F.col("cum") > pick(F.col("total")), F.col(value))).alias(name)
            for name, pick in picks.items()]
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), *aggs)
