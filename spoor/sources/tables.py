"""The four trace tables on disk: batches of files of even size, made visible by a manifest.

``out/<table>/batch=n/service=…/date=…`` holds what one call wrote, whatever number of source files it brought; ``leaf``, a digest of the source
file, is a column. ``out/manifest/batch=n`` lists the source files of a batch and comes last: a batch counts from the moment its folder there is
complete, so all its tables appear at once, and a job that dies before leaves rows that no reader sees. A source file that is written anew goes to a
new batch with a row in ``out/stale/batch=n``, which voids its rows in earlier ones; no stored file is touched. ``compact`` writes all that counts as one new
batch, listed as ``base=n``, before which nothing counts any more; ``vacuum`` removes what no longer counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.schema import table_schema
from spoor.session import measured

FOLDERS = ("service", "date")
COLUMNS = ("host", "leaf")
MANIFEST, STALE = "source_key string", "table string, leaf string, voids int"
# Samples last: their presence completes a file.
WRITE_ORDER = ("stacks", "polls", "spans", "samples")


def leaf(source_key: Column) -> Column:
    return F.md5(source_key)


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match; a store has as many as calls have written since it was compacted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    return sorted(int(part.split("=")[1]) for name in _names(spark, pattern) for part in name.split("/") if part.startswith(("batch=", "base=")))


def path_exists(spark: SparkSession, name: str) -> bool:
    return bool(_names(spark, name))


def committed(spark: SparkSession, out: str) -> tuple[int, list[int]]:
    """The last base (0 if none) and the batches that count: it and the complete ones after it."""
    base = max(_numbers(spark, f"{out}/manifest/base=*/_SUCCESS"), default=0)
    return base, [base] * bool(base) + [n for n in _numbers(spark, f"{out}/manifest/batch=*/_SUCCESS") if n > base]


def _next(spark: SparkSession, out: str) -> int:
    """A number that no batch has, not even one that died half written."""
    return 1 + max(_numbers(spark, f"{out}/*/ba*=*"), default=0)


def _write_rows(df: DataFrame, out: str, table: str, batch: int) -> None:
    """The rebalance step gives every folder few, evenly sized files and splits one that holds much of the data over several tasks."""
    rows = df.distinct() if table == "stacks" else df
    rows.hint("rebalance", *[F.col(p) for p in FOLDERS]).write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{out}/{table}/batch={batch}")


def _commit(spark: SparkSession, out: str, batch: int, tables: Mapping[str, DataFrame], sources: DataFrame, voids: DataFrame | None = None) -> None:
    """Rows, then what they void (``voids``: table, leaf), then the manifest, whose completion is the commit."""
    for name in WRITE_ORDER:
        if name in tables:
            _write_rows(tables[name], out, name, batch)
    if voids is not None:
        voids.withColumn("voids", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/stale/batch={batch}")
    sources.select("source_key").write.mode("overwrite").parquet(f"{out}/manifest/batch={batch}")


def write_table(df: DataFrame, out: str, table: str) -> None:
    """Rows of one table as a batch of its own; they replace earlier rows of their leaves."""
    spark = df.sparkSession
    voids = df.select(F.lit(table).alias("table"), "leaf").distinct() if path_exists(spark, f"{out}/{table}") else None
    _commit(spark, out, _next(spark, out), {table: df}, spark.createDataFrame([], MANIFEST), voids)


def write_samples(df: DataFrame, out: str) -> None:
    write_table(df, out, "samples")


def write_stacks(df: DataFrame, out: str) -> None:
    write_table(df, out, "stacks")


def write_polls(df: DataFrame, out: str) -> None:
    write_table(df, out, "polls")


def write_spans(df: DataFrame, out: str) -> None:
    write_table(df, out, "spans")


def read_table(spark: SparkSession, out: str, table: str, extra: str = "") -> DataFrame:
    """A table of any age with the current columns, service, date, host and leaf, and ``extra`` columns (DDL). The schema is known, so no
    file is opened to find it; a column that an old file lacks reads as null."""
    return _stored_rows(spark, out, table, extra).drop("batch")


def _stored_rows(spark: SparkSession, out: str, table: str, extra: str = "", keep_all: bool = False) -> DataFrame:
    have = table_schema(table)
    places = T.StructType([T.StructField(p, T.StringType()) for p in (*COLUMNS, *FOLDERS) if p not in have.names])
    more = T.StructType.fromDDL(extra) if extra else T.StructType()
    schema = T.StructType([*have, *more, *places, T.StructField("batch", T.IntegerType())])
    base, batches = committed(spark, out)
    if not batches or not path_exists(spark, f"{out}/{table}"):
        return spark.createDataFrame([], schema)
    if keep_all:  # every column that any batch has; folder names stay text
        found = spark.read.option("mergeSchema", "true").parquet(f"{out}/{table}").schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in FOLDERS else f for f in found])
    rows = spark.read.schema(schema).parquet(f"{out}/{table}").filter(F.col("batch").isin(batches))
    voiding = [n for n in batches if n > base and path_exists(spark, f"{out}/stale/batch={n}")]
    if not voiding:
        return rows
    stale = spark.read.schema(STALE).parquet(*[f"{out}/stale/batch={n}" for n in voiding]).filter(F.col("table") == table)
    last = stale.groupBy(F.col("leaf").alias("_leaf")).agg(F.max("voids").alias("_voids"))
    return rows.join(last, (F.col("leaf") == F.col("_leaf")) & (F.col("batch") < F.col("_voids")), "left_anti")


def read_stacks(spark: SparkSession, out: str) -> DataFrame:
    """The dictionary of all files, merged: one row for each stack id."""
    return read_table(spark, out, "stacks").groupBy("stack_id").agg(F.min("frames").alias("frames"))


def folded_set(spark: SparkSession, out: str) -> DataFrame:
    """Source files already folded."""
    base, batches = committed(spark, out)
    if not batches:
        return spark.createDataFrame([], MANIFEST)
    folders = [f"{out}/manifest/{'base' if n == base else 'batch'}={n}" for n in batches]
    return spark.read.schema(MANIFEST).parquet(*folders).distinct()


def fold_write(spark: SparkSession, out: str, source_keys: DataFrame, tables: Mapping[str, DataFrame], replace: bool = False) -> None:
    """Write the files not folded yet as one batch. ``source_keys`` names every file of the batch, so that an
    empty one is marked too; each table carries source_key, service, date and host.

    A source key stands for one complete file: all its rows come in one call, as ``streaming.jobs.fold_files`` brings them. Naming it
    again changes nothing; with ``replace`` its new rows take the place of the old ones.
    """
    pending = source_keys.select("source_key").distinct()
    if not replace:
        pending = pending.join(folded_set(spark, out), "source_key", "left_anti")
    pending = measured(pending)
    if pending.isEmpty():
        return
    key = leaf(F.col("source_key")).alias("leaf")
    rows = {name: df.join(pending, "source_key", "left_semi").withColumn("leaf", key) for name, df in tables.items()}
    again = replace and committed(spark, out)[1]
    voids = pending.select(F.explode(F.array(*[F.lit(t) for t in tables])).alias("table"), key) if again and tables else None
    _commit(spark, out, _next(spark, out), rows, pending, voids)


def compact(spark: SparkSession, out: str) -> None:
    """All that counts, written as one batch with files of even size. Readers see the old batches until the new base is complete."""
    base, batches = committed(spark, out)
    if len(batches) < 2:
        return
    batch = _next(spark, out)
    for name in WRITE_ORDER:
        if path_exists(spark, f"{out}/{name}"):
            _write_rows(_stored_rows(spark, out, name, keep_all=True).drop("batch"), out, name, batch)
    folded_set(spark, out).write.mode("overwrite").parquet(f"{out}/manifest/base={batch}")


def vacuum(spark: SparkSession, out: str) -> int:
    """Remove the folders of batches that don't count (superseded, or never completed); their number. No other job may write meanwhile."""
    base, batches = committed(spark, out)
    jvm, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    for name in [n for kind in ("batch", "base") for n in _names(spark, f"{out}/*/{kind}=*")]:
        if int(name.rsplit("=", 1)[1]) not in batches:
            path = jvm.Path(name)
            gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone
