"""Helpers of pipeline stages: decisions of an operator applied to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` and ``key``, by which decisions find their rows (doc_id, null as the smallest number, and a hash of the text), and
    ``row``, all columns of the document in one, so that none can clash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def decisions(rows: DataFrame, keep: Column) -> DataFrame:
    """doc, key, keep (how many rows of that key stay), rows, from an operator's rows (doc_id, text_key, ...)."""
    own = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("text_key").alias("key"), keep.cast("int").alias("kept"))
    return own.groupBy("doc", "key").agg(F.sum("kept").alias("keep"), F.count("*").alias("rows"))


def applied(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that stay. Only keys that lose rows take part in a join; of equal rows of which one stays, any one does."""
    rows = keyed(docs)
    stay = rows.join(decided.where("keep < rows").select("doc", "key"), ["doc", "key"], "left_anti")
    one = rows.join(decided.where("keep > 0 AND keep < rows").select("doc", "key"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    return stay.unionByName(one).select("row.*")
