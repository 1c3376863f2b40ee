"""Sizes of keys that are known before a query runs.

A table written by ``sources.counted`` has, for sets of key columns and a time axis, the rows of its largest key and of the
fullest (key, cell) of every cell width stored beside it. The columns of the table carry these numbers as metadata, which Spark hands on through
projections and renames. ``known_width`` reads them off a DataFrame without a job. They bound any part of the table: filters only take rows
away, and finer keys only split cells. So they are used only while

- the axis and a counted set of keys, perhaps with more keys, are still the table's own columns (a computed column has no metadata), and
- nothing in the logical plan can multiply rows: no join, union or explode, down to the scan of that very table.

Otherwise the caller measures, as for any DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

FIELD = "spoor.census"
#: Operators of a logical plan that return no row twice.
_KEEPING = frozenset({
    "Aggregate", "Deduplicate", "Distinct", "Filter", "GlobalLimit", "LocalLimit", "Project", "Repartition", "RepartitionByExpression", "ResolvedHint",
    "Sort", "SubqueryAlias", "Window"})


@dataclass(frozen=True)
class Counts:
    """Rows of the largest key, and of the fullest (key, cell) for each width of cells."""

    hottest: int
    fullest: Mapping[int, int]

    def at(self, width: int) -> int:
        """Rows that a cell of a width has at most, counted or not: a cell of a power of two lies inside one of any larger power."""
        return min([self.hottest, *(n for w, n in self.fullest.items() if w >= width)])

    def width(self, target: int) -> int | None:
        """The widest cells of at most ``target`` rows (the narrowest counted, if all are too full); None if whole keys have no more."""
        if self.hottest <= target or not self.fullest:
            return None
        return max((w for w, n in self.fullest.items() if n <= target), default=min(self.fullest))


def merged(parts: Sequence[Counts], whole: bool) -> Counts:
    """Bounds for parts of one table together: the largest of them where each key lies ``whole`` in one part, else their sum."""
    add = max if whole else sum
    widths = {w for p in parts for w in p.fullest}
    return Counts(add(p.hottest for p in parts), {w: add(p.at(w) for p in parts) for w in widths})


def unmarked(df: DataFrame) -> DataFrame:
    """``df`` without marks, which files keep too."""
    for field in df.schema:
        if FIELD in field.metadata:
            df = df.withMetadata(field.name, {k: v for k, v in field.metadata.items() if k != FIELD})
    return df


def marked(df: DataFrame, table: str, axis: str, counts: Mapping[tuple[str, ...], Counts]) -> DataFrame:
    """``df``, a scan of the folder ``table``, with the counts on its axis and a mark on its key columns."""
    known = [{"keys": list(keys), "hottest": c.hottest, "fullest": {str(w): n for w, n in c.fullest.items()}} for keys, c in counts.items()]
    df = df.withMetadata(axis, {FIELD: json.dumps({"table": table, "column": axis, "counts": known})})
    for key in {k for keys in counts for k in keys}:
        df = df.withMetadata(key, {FIELD: json.dumps({"table": table, "column": key})})
    return df


def known_width(df: DataFrame, keys: Sequence[str], axis: str, target: int) -> tuple[int | None] | None:
    """(width,) as ``Counts.width`` says, if the numbers stored beside the table hold for ``df``, else None."""
    marks = {f.name: json.loads(f.metadata[FIELD]) for f in df.schema if FIELD in f.metadata}
    stored = marks.get(axis, {})
    if "counts" not in stored:
        return None
    own = {marks[k]["column"] for k in keys if k in marks and marks[k]["table"] == stored["table"]}
    fitting = [c for c in stored["counts"] if set(c["keys"]) <= own]
    if not fitting or scanned_folder(df) != stored["table"]:
        return None
    widths = [Counts(c["hottest"], {int(w): n for w, n in c["fullest"].items()}).width(target) for c in fitting]
    return (None if None in widths else max(widths),)


def scanned_folder(df: DataFrame) -> str | None:
    """The one folder whose rows ``df`` has, each once at most; None if the plan could multiply them or reads something else."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _KEEPING and node.children().size() == 1:
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or not node.relation().getClass().getName().endswith("HadoopFsRelation"):
        return None
    roots = node.relation().location().rootPaths()
    return roots.head().toString() if roots.size() == 1 else None

