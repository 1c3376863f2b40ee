"""Sampled allocations: call sites, leaks and unbiased size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.plans.timeline import AUTO, asof

SAMPLE_RATE = 524_288

# Allocator hook frames stripped from the leaf side of a heap stack.
HOOK_FRAMES = (
    "memory_profiling::hook::on_alloc",
    "memory_profiling::allocator::",
    "__rustc::__rust_alloc",
    "__rustc::__rust_realloc",
)


def inverse_probability(size: Column, rate: int = SAMPLE_RATE) -> Column:
    """1 / P(sampled) for an allocation of this size; 1 where the estimate saturates."""
    ratio = size / F.lit(float(rate))
    return F.when((size <= 0) | (ratio > 50), F.lit(1.0)).otherwise(1 / (1 - F.exp(-ratio)))


def alloc_weight(size: Column, rate: int = SAMPLE_RATE) -> Column:
    """Unbiased bytes a sampled allocation stands for."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(size * inverse_probability(size, rate))


def leaks(allocs: DataFrame, frees: DataFrame, keys=("source_key",)) -> DataFrame:
    """Allocations without a free of the same address and allocation time in their process."""
    freed = frees.select(*keys, "addr", F.col("alloc_ts_ns").alias("ts_ns"))
    return allocs.join(freed, [*keys, "addr", "ts_ns"], "left_anti")


def alloc_sites(allocs: DataFrame, k: int = 10, rate: int = SAMPLE_RATE) -> DataFrame:
    """Call sites by estimated bytes. Equal sizes of a site are combined first, so the sum is over few rows."""
    cells = allocs.groupBy(F.array_join("frames", ";").alias("site"), "size").agg(F.count(F.lit(1)).alias("n"))
    sites = cells.groupBy("site").agg(
        F.sum(F.col("size") * F.col("n")).alias("total_bytes"), F.sum("n").alias("n"),
        F.sum(alloc_weight(F.col("size"), rate) * F.col("n")).alias("estimated_bytes"))
    return sites.orderBy(F.desc("estimated_bytes"), "site").limit(k)


def alloc_summary(allocs: DataFrame, frees: DataFrame, rate: int = SAMPLE_RATE, keys=("source_key",)) -> DataFrame:
    lost = leaks(allocs, frees, keys).agg(F.sum("size").alias("leaked_bytes"), F.count(F.lit(1)).alias("leaked_count"))
    freed = frees.agg(F.count(F.lit(1))).scalar()
    return allocs.agg(
        F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("total_count"),
        F.round(F.sum(alloc_weight(F.col("size"), rate))).cast("bigint").alias("estimated_bytes"),
    ).withColumn("free_count", freed).withColumn("leaked_bytes", lost.select("leaked_bytes").scalar()).withColumn(
        "leaked_count", lost.select("leaked_count").scalar())


def alloc_task(allocs: DataFrame, starts: DataFrame, tid_worker: DataFrame, rate: int = SAMPLE_RATE, keys=("source_key",), slot=AUTO) -> DataFrame:
    """Sampled and estimated bytes per task of a process: the last poll started on the thread's worker before the allocation."""
    keys = list(keys)
    placed = allocs.join(tid_worker, [*keys, "tid"]).select(*keys, "worker_id", "ts_ns", "size")
    polls = starts.groupBy(*keys, "worker_id", "start_ns").agg(F.max("task_id").alias("task_id"))
    hit = asof(placed, polls, [*keys, "worker_id"], "ts_ns", "start_ns", ["task_id"], slot=slot).filter(F.col("task_id").isNotNull())
    return hit.groupBy(*keys, "task_id").agg(
        F.sum("size").alias("sampled_bytes"), F.count(F.lit(1)).alias("n"), F.sum(alloc_weight(F.col("size"), rate)).alias("estimated_bytes"))


def strip_hooks(frames: Column, hooks=HOOK_FRAMES) -> Column:
    """Stack without its leading allocator frames."""
    is_hook = lambda f: _any([F.contains(f, F.lit(h)) for h in hooks])
    leading = F.aggregate(
        frames, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, f: F.struct(
            (acc["n"] + F.when(acc["on"] & is_hook(f), 1).otherwise(0)).alias("n"), (acc["on"] & is_hook(f)).alias("on")),
        lambda acc: acc["n"])
    return F.slice(frames, leading + 1, F.size(frames))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def heap_region(allocs: DataFrame, start_ns: int | None = None, end_ns: int | None = None, hooks=HOOK_FRAMES, rate: int = SAMPLE_RATE) -> DataFrame:
    """Allocations of an inclusive range with hook frames stripped and their byte and count weights; stacks of
    hooks alone are dropped."""
    rows = allocs
    if start_ns is not None:
        rows = rows.filter(F.col("ts_ns") >= start_ns)
    if end_ns is not None:
        rows = rows.filter(F.col("ts_ns") <= end_ns)
    inv = inverse_probability(F.col("size"), rate)
    return rows.withColumn("frames", strip_hooks(F.col("frames"), hooks)).filter(F.size("frames") > 0).withColumn(
        "bytes", F.col("size") * inv).withColumn("allocs", inv)


def small_alloc_hotspots(tree: DataFrame, k: int = 10) -> DataFrame:
    """Flamegraph nodes with more than 10 allocations of under 1 KiB on average."""
    mean = F.col("bytes") / F.col("allocs")
    return tree.filter((F.col("allocs") > 10) & (mean < 1024)).withColumn("mean_bytes", mean).orderBy(F.desc("allocs"), "path").limit(k)
