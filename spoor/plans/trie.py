"""Prefix tries over paths of any depth, keyed by chained digests.

A node's id is a 128-bit digest of its parent's id and its own name, so two paths share a node exactly as far as they agree, whatever
characters their names hold. Ids have one size at any depth: shuffles carry an id, its parent's, one name and the weights, and never
the text of a path. Text is put together for output only, from one path that runs through each node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.session import cut_lineage

SEP = ";"
ROOT = "00" * 16


def child_id(parent: Column, name: Column) -> Column:
    return F.unhex(F.md5(F.concat(parent, F.encode(name, "UTF-8"))))


def prefix_ids(names: Column) -> Column:
    """Ids of all prefixes of a path, the empty one first."""
    return F.aggregate(names, F.array(F.unhex(F.lit(ROOT))), lambda ids, name: F.concat(ids, F.array(child_id(F.element_at(ids, -1), name))))


def _number(node_id: Column) -> Column:
    """120 bits of an id as a number, which aggregates can hold in place."""
    digits = F.hex(node_id)
    high, low = (F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def numbered_paths(rows: DataFrame, names: Column, weights: Sequence[str] = ()) -> DataFrame:
    """names, ids, path_no and the weights of every row with a path; written once, since nodes and texts are both made of it."""
    paths = rows.select(F.transform(names, lambda n: F.coalesce(n, F.lit(""))).alias("names"), *weights).filter(F.size("names") > 0)
    paths = paths.withColumn("ids", prefix_ids(F.col("names")))
    return cut_lineage(paths.withColumn("path_no", _number(F.element_at("ids", -1))))


def prefix_tree(paths: DataFrame, weights: Sequence[str]) -> DataFrame:
    """One row a node: id, parent_id (null at the top), depth from 1, name, inclusive and ``self_`` weights, and the number of a path through it."""
    size = F.size("names")
    nodes = F.transform(F.sequence(F.lit(1), size), lambda d: F.struct(
        F.element_at("ids", d + 1).alias("id"), F.when(d > 1, F.element_at("ids", d)).alias("parent_id"), d.alias("depth"),
        F.element_at("names", d).alias("name"), (d == size).alias("last")))
    flat = paths.select("path_no", *weights, F.inline(nodes))
    return flat.groupBy("id", "parent_id", "depth", "name").agg(
        *[F.sum(w).alias(w) for w in weights], *[F.sum(F.when(F.col("last"), F.col(w)).otherwise(F.lit(0))).alias(f"self_{w}") for w in weights],
        F.max("path_no").alias("path_no"))


def with_text(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``path`` and ``parent_path`` of nodes in place of the number of a path."""
    known = paths.select("path_no", "names").dropDuplicates(["path_no"])

    def text(depth: Column) -> Column:
        return F.array_join(F.slice("names", F.lit(1), depth), SEP)

    rest = [c for c in nodes.columns if c != "path_no"]
    return nodes.join(known, "path_no").select(*rest, text(F.col("depth")).alias("path"), F.when(F.col("depth") > 1, text(F.col("depth") - 1)).alias("parent_path"))


def summed_to_top(nodes: DataFrame, value: str) -> DataFrame:
    """id and the sum of ``value`` over a node and all nodes above it (``nodes`` has id, parent_id), by pointer doubling: each round adds
    what the node reached has gathered and goes on where that one has got to, so depth d takes log2(d) rounds."""
    state = cut_lineage(nodes.select("id", F.col("parent_id").alias("up"), F.col(value)))
    done, moving = state.filter(F.col("up").isNull()), state.filter(F.col("up").isNotNull())
    while not moving.isEmpty():
        reached = moving.unionByName(done).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col(value).alias("more"))
        stepped = cut_lineage(moving.join(reached, "up").select("id", F.col("next").alias("up"), (F.col(value) + F.col("more")).alias(value)))
        done = done.unionByName(stepped.filter(F.col("up").isNull()))
        moving = stepped.filter(F.col("up").isNotNull())
    return done.select("id", value)
