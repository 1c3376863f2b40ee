"""Runs registered queries on Spark and their SQL on DuckDB and compares the row multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") if value else 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple((type(v).__name__, canon(v)) for v in (r[i] for i in order)) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None, f"{sum(got.values())} rows, no SQL ({t1 - t0:.1f}s)"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    t2 = time.time()
    info = f"{sum(got.values())} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}; {info}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return False, f"{sum(want.values())} wanted; {info}\n   only spark: {extra}\n   only sql: {missing}"
    if not got:
        return False, f"EMPTY; {info}"
    return True, info


def main(argv):
    import importlib.util

    from spoor.session import build_session

    sf = argv[1] if len(argv) > 1 and argv[1].startswith("sf") else "sf0.01"
    slots = "--slots" in argv
    picks = [a for a in argv[1:] if not a.startswith(("sf", "--"))]
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if slots:  # force the many-slot plans that large keys get
        spark.conf.set("spoor.window.rows", "60")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) or p == getattr(fn, "__module_tag__", None) for p in picks):
            continue
        try:
            ok, message = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += ok is False
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'FAIL'} {name}: {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv)
