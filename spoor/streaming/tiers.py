"""Answers that grow batch by batch, kept in tiers of merged parts.

Every batch writes a part under its number. Each time ``fan`` parts of a tier are complete they are merged into one part of the next tier, whose
number follows from theirs, and then removed. So N batches leave at most ``fan - 1`` parts a tier in log(N) tiers, a row is rewritten
log(N) times, and reading costs no more for the batches that lie behind. A batch that is repeated finds either its own part, which it replaces, or
the merged part that holds it already (batches repeat with the same rows), which it leaves alone: every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 16


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, part: str) -> bool:
    path, files = _file_system(spark, f"{part}/_SUCCESS")
    return files.exists(path)


def _remove(spark: SparkSession, part: str) -> None:
    path, files = _file_system(spark, part)
    files.delete(path, True)


def write_part(rows: DataFrame, out: str, batch: int, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Write the rows of a batch and merge what has become complete. ``merge`` combines rows of several parts, in any grouping."""
    spark, tier = rows.sparkSession, 0
    if any(start <= batch < stop for _, start, stop in parts(spark, out, fan) if stop - start > 1):
        return  # a repeated batch whose part has been merged
    rows.write.mode("overwrite").parquet(f"{out}/tier=0/part={batch}")
    while (batch + 1) % fan == 0:
        whole, batch = range(batch + 1 - fan, batch + 1), batch // fan
        have = [p for p in (f"{out}/tier={tier}/part={i}" for i in whole) if _complete(spark, p)]
        merge(spark.read.schema(rows.schema).parquet(*have)).write.mode("overwrite").parquet(f"{out}/tier={tier + 1}/part={batch}")
        for part in have:
            _remove(spark, part)
        tier += 1


def parts(spark: SparkSession, out: str, fan: int = FAN) -> list[tuple[str, int, int]]:
    """Folder, first batch and the one after the last of the parts that hold each batch once, highest tiers first."""
    path, files = _file_system(spark, f"{out}/tier=*/part=*/_SUCCESS")
    found = []
    for status in files.globStatus(path) or []:
        folder = status.getPath().getParent().toString()
        tier, part = (int(x.split("=")[1]) for x in folder.split("/")[-2:])
        found.append((folder, part * fan**tier, (part + 1) * fan**tier))
    chosen: list[tuple[str, int, int]] = []
    for folder, start, stop in sorted(found, key=lambda f: f[1] - f[2]):
        if not any(a <= start < b for _, a, b in chosen):
            chosen.append((folder, start, stop))
    return chosen


def read_parts(spark: SparkSession, out: str, schema: str, fan: int = FAN) -> DataFrame:
    folders = [folder for folder, _, _ in parts(spark, out, fan)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
