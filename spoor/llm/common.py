"""Helpers that the corpus operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import checkpoint_dir

#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text handed to one numpy step, in characters; longer texts form a step of their own.
STEP_CHARS = 4_000_000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster may ship it with --py-files too), and let Spark remove an execution's
    shuffle files when it ends: whatever is read again has been ``stored``, and loops of many small shuffles would fill the disk until the driver's next collection."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage and outlives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_lower_py(text: str) -> str:
    return text.translate(_FOLD)


_FOLD = str.maketrans(UPPER, LOWER)


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of about ``limit`` characters; the texts come along with null read as empty."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
