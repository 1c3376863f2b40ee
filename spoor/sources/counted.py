"""Tables that know how large their keys are.

``path/batch=n`` holds the rows of one call, ``path/_census/batch=n`` what was counted of them, right after they were written and from two or three of
their columns. Readers of the table don't see the second folder. Queries over such a table need no job to size their windows (``plans.census``).

A batch that is written again loses its counts first and gets new ones last, so a job that dies leaves at worst a batch without counts; then the whole
table counts as uncounted, and queries measure as over any other table. So it is with batches that other writers add.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.plans.census import Counts, marked, merged, scanned_folder, unmarked
from spoor.plans.timeline import fullest_cells, hottest_key

#: Cells are counted down to widths at which the fullest has no more rows than this; queries with a smaller target get the narrowest cells.
FLOOR = 10_000
#: Keys whose rows come in one batch, as those of a source file do.
WHOLE = ("source_key",)
_GRAINS = 16


def counted(df: DataFrame, keys: Sequence[str], axis: str, floor: int = FLOOR) -> Counts:
    """Largest key and fullest cells, for widths that are powers of two; rows without a place on the axis share a cell."""
    hottest = hottest_key(df, keys, axis) or 0
    if hottest <= floor:
        return Counts(hottest, {})
    low, high = df.agg(F.min(axis), F.max(axis)).first()
    bits = max(0, (int(high) - int(low)).bit_length() - _GRAINS)
    fullest: dict[int, int] = {}
    while True:
        fullest |= fullest_cells(df, keys, axis, 1 << bits)
        if bits == 0 or min(fullest.values()) <= floor:
            return Counts(hottest, fullest)
        bits = max(0, bits - _GRAINS)


def _file(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_counted(df: DataFrame, path: str, batch: int = 0, keysets: Sequence[Sequence[str]] = (("source_key",),), axis: str = "ts_ns", floor: int = FLOOR) -> None:
    """Write the rows as one batch (written again, it replaces itself) and count them for each set of keys."""
    spark, df = df.sparkSession, unmarked(df)
    system, note = _file(spark, f"{path}/_census/batch={batch}")
    system.delete(note, False)
    folder = f"{path}/batch={batch}"
    df.write.mode("overwrite").parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder)
    found = [{"keys": list(keys), **vars(counted(rows, keys, axis, floor))} for keys in keysets]
    out = system.create(note, True)
    try:
        out.write(bytearray(json.dumps({"axis": axis, "counts": found}).encode()))
    finally:
        out.close()


def _notes(spark: SparkSession, path: str) -> list[dict] | None:
    """What was counted of each batch; None if a batch has no counts."""
    system, at = _file(spark, path)
    batches = {f.getPath().getName() for f in system.globStatus(_file(spark, f"{path}/[^_.]*")[1]) or []}
    have = {f.getPath().getName(): f.getPath() for f in system.globStatus(_file(spark, f"{path}/_census/batch=*")[1]) or []}
    if not batches or not batches <= set(have):
        return None
    notes = []
    for name in sorted(batches):
        source = system.open(have[name])
        try:
            notes.append(json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source))))
        finally:
            source.close()
    return notes


def with_counts(df: DataFrame, path: str) -> DataFrame:
    """``df``, rows of the folder, with what was counted of them; as it is where they were not, or not all in the same way."""
    df, notes = unmarked(df), _notes(df.sparkSession, path)
    table = scanned_folder(df) if notes else None
    if table is None or len({n["axis"] for n in notes}) != 1:
        return df
    parts: dict[tuple[str, ...], list[Counts]] = {}
    for note in notes:
        for c in note["counts"]:
            parts.setdefault(tuple(c["keys"]), []).append(Counts(c["hottest"], {int(w): n for w, n in c["fullest"].items()}))
    counts = {keys: merged(own, bool(set(keys) & set(WHOLE))) for keys, own in parts.items() if len(own) == len(notes)}
    return marked(df, table, notes[0]["axis"], counts) if counts else df


def read_counted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with what was counted of them."""
    return with_counts(spark.read.parquet(path), path).drop("batch")
