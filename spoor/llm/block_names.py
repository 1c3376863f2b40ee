"""Exact deduplication by deterministic block naming (operator 5).

Texts, lower-cased in A-Z only, are cut into blocks of a fixed number of bytes. Equal blocks get one integer name: the rank of the
block in the order of all distinct blocks, sorted by a salted digest. Then names of adjacent blocks are paired and the pairs renamed
by their rank, again and again, until one name is left for each document. Two documents of as many blocks are equal if and only
if their last names are: no step trusts a digest. It only keeps bytes out of shuffles: a block whose digest no other block has needs
no comparison, the bytes of blocks that share one are compared, and should two differ, naming starts again under another salt.

Cases: null counts as empty, an empty text is one empty block; among rows of one group with the same largest doc_id a single one
stays (the first by place in the table); null doc_ids come last in that order; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import ascii_lower, stored

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8")


def blocks_of(body: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), ((F.octet_length(body) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def ranked(keys: DataFrame, *order: str) -> DataFrame:
    """Distinct ``keys`` with ``name``: the rank in sorted order, from 0. Ranges are sorted apart and offset by what lies before."""
    lay = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    lay = stored(lay.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), "ranked")
    sizes = lay.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))
    return lay.join(before, "_range").withColumn("name", F.col("before") + F.col("_at")).drop("_range", "_at", "before")


def salted_md5(block: Column, salt: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{salt}:").cast("binary"), block)))


def block_hashes(docs: DataFrame, size: int, hash_of: Callable[[Column, int], Column], salt: int) -> DataFrame:
    """Every row, numbered, with the hash of each of its blocks; written, so that the numbers stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), normalised(F.col("text")).alias("body"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", F.unhex(F.sha2("body", 256)).alias("sha"),
                              F.transform(blocks_of(F.col("body"), size), lambda b: hash_of(b, salt)).alias("hashes")), "block-hashes")


def named_blocks(docs: DataFrame, size: int, hash_of: Callable[[Column, int], Column] = salted_md5) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and row, pos, name of every block."""
    for salt in itertools.count():
        rows = block_hashes(docs, size, hash_of, salt)
        at = rows.select("row", F.posexplode("hashes").alias("pos", "hash"))
        hashes = stored(at.groupBy("hash").agg(F.count("*").alias("n")), "hashes")
        blocks = docs.select(F.explode(blocks_of(normalised(F.col("text")), size)).alias("block")).select(hash_of(F.col("block"), salt).alias("hash"), "block")
        # bytes of the blocks that share a hash, combined in each task before they meet
        contents = blocks.join(hashes.where("n > 1"), "hash", "left_semi").groupBy("hash").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        if contents.where("low <> high").isEmpty():
            return rows, at.join(ranked(hashes.select("hash"), "hash"), "hash").select("row", "pos", "name")
    raise AssertionError


def identities(names: DataFrame) -> DataFrame:
    """row, levels, name: adjacent names are paired and renamed until each row has one."""
    sizes = names.groupBy("row").agg(F.count("*").alias("n"))
    open_ = names.join(sizes, "row")
    done, level = None, 0
    while True:
        open_ = stored(open_, f"names-{level}")
        last = open_.where("n = 1").select("row", F.lit(level).alias("levels"), "name")
        done = last if done is None else done.union(last)
        rest = open_.where("n > 1")
        if rest.isEmpty():
            return done
        pairs = (rest.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), ((F.col("n") + 1) / 2).cast("long").alias("n"))
                 .agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        pairs = stored(pairs, f"pairs-{level}")
        open_ = pairs.join(ranked(pairs.select("left", "right").distinct(), "left", "right"), ["left", "right"]).select("row", "pos", "name", "n")
        level += 1


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES, hash_of: Callable[[Column, int], Column] = salted_md5) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, text_key (hash of the text as it is)."""
    rows, names = named_blocks(docs, size, hash_of)
    named = stored(rows.select("row", "doc_id", "text_key", "sha").join(identities(names), "row"), "identities")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
    groups = named.groupBy("levels", "name").agg(best, F.count("*").alias("group_size"))
    return named.join(groups, ["levels", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == -F.col("row")).alias("kept"),
                                                       F.lower(F.hex("sha")).alias("text_sha256"), "text_key")
