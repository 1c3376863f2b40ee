"""Quarter-octave duration buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_OCTAVE = 4


def octave(ns: Column) -> Column:
    """floor(log2(ns)) for ns >= 1, exact at powers of two."""
    guess = F.floor(F.log2(ns.cast("double")))
    return (
        F.when(F.pow(F.lit(2.0), guess) > ns, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= ns, guess + 1).otherwise(guess))


# Above the rounding error of four times a logarithm, below the distance of any whole number of ns to an edge that
# is not a power of two (up to minutes): an exact power of two lands in its own bucket.
_NUDGE = 1e-12


def log_bucket(ns: Column) -> Column:
    """floor(4 * log2(ns)); null for ns <= 0."""
    return F.when(ns > 0, F.floor(F.log2(ns.cast("double")) * PER_OCTAVE + _NUDGE))


def edge(bucket: Column) -> Column:
    """Unrounded lower edge 2^(k/4)."""
    return F.pow(F.lit(2.0), bucket / F.lit(float(PER_OCTAVE)))


def edge_ns(bucket: Column) -> Column:
    return F.round(edge(bucket)).cast("bigint")


ZERO_BUCKET = -1


def span_bucket(ns: Column) -> Column:
    """Bucket with a separate key for zero durations."""
    return F.when(ns == 0, F.lit(ZERO_BUCKET).cast("bigint")).otherwise(log_bucket(ns))


def span_bucket_bounds(bucket: Column) -> tuple[Column, Column]:
    """Rounded [lo, hi) of a span bucket: [0, 1) for zero, never empty."""
    zero = bucket == ZERO_BUCKET
    lo = F.when(zero, F.lit(0).cast("bigint")).otherwise(edge_ns(bucket))
    hi = F.when(zero, F.lit(1).cast("bigint")).otherwise(F.greatest(edge_ns(bucket + 1), edge_ns(bucket) + 1))
    return lo, hi
