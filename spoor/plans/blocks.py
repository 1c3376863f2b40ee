"""Least values of ranges of numbered points.

Level k cuts a key's points into blocks of 2^k. A range is made of two blocks a level at most, so it is put together from about twice the logarithm of its
length; the levels are as many as the longest range needs. Neither ranges that share points nor long ones make (range, point) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_least(points: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, low, high and the least ``value`` of the points with low <= place < high, for the distinct, non-empty ranges; places are distinct and from 0."""
    keys = list(keys)
    longest = ranges.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))).alias("level")
    blocks = points.select(*keys, "place", value, levels).groupBy(*keys, "level", F.expr("shiftright(place, level)").alias("block")).agg(F.min(value).alias(value))
    # a block on its own at either end belongs to this level; the rest is made of whole blocks of the next
    inner = ranges.select(*keys, "low", "high", levels).withColumn("a", F.expr("shiftright(low + shiftleft(1L, level) - 1, level)")).withColumn("b", F.expr("shiftright(high, level)"))
    ends = F.expr("filter(array(if(a < b and a % 2 = 1, a, null), if(b % 2 = 1 and a + a % 2 < b, b - 1, null)), x -> x is not null)")
    parts = inner.select(*keys, "low", "high", "level", F.explode(ends).alias("block"))
    return parts.join(blocks, [*keys, "level", "block"]).groupBy(*keys, "low", "high").agg(F.min(value).alias(value))
