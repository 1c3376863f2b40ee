"""The shared plans against plain loops: ordered windows, as-of lookups, interval joins, order statistics."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.plans import interval_join
from spoor.plans.interval_join import interval_pairs, point_in_intervals
from spoor.plans.ranks import order_statistics
from spoor.plans.timeline import asof, following, latest, measure_slot, prev, running_max, running_min, running_sum, with_order

from conftest import tuples


def rows_for(seed, n=300, keys=3, span=2000):
    rng = random.Random(seed)
    # Key 0 is hot: half of all rows.
    return [(0 if rng.random() < 0.5 else rng.randrange(keys), rng.randrange(span), i, rng.randrange(-5, 9), rng.random() < 0.4) for i in range(n)]


@pytest.mark.parametrize("slot", [None, 7, 150, 5000])
def test_ordered_windows_match_a_loop(spark, slot):
    rows = rows_for(1)
    df = spark.createDataFrame(rows, "k long, t long, seq long, v long, f boolean")
    out = with_order(df, ["k"], ["t", "seq"], {
        "p": prev(F.col("v")), "pf": prev(F.col("v"), F.col("f")), "lf": latest(F.col("v"), F.col("f")), "n": following(F.col("v")),
        "nf": following(F.col("v"), F.col("f")), "s": running_sum(F.col("v")), "sx": running_sum(F.col("v"), False),
        "mx": running_max(F.col("v")), "mn": running_min(F.col("v"), False)}, slot)
    got = {(r.k, r.seq): r for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(line):
            before, after = line[:i], line[i + 1:]
            flagged = [x[3] for x in before if x[4]]
            later = [x[3] for x in after if x[4]]
            g = got[(key, r[2])]
            assert g.p == (before[-1][3] if before else None)
            assert g.pf == (flagged[-1] if flagged else None)
            assert g.lf == (r[3] if r[4] else (flagged[-1] if flagged else None))
            assert g.n == (after[0][3] if after else None)
            assert g.nf == (later[0] if later else None)
            assert g.s == sum(x[3] for x in before) + r[3] and g.sx == sum(x[3] for x in before)
            assert g.mx == max([x[3] for x in before] + [r[3]])
            assert g.mn == (min(x[3] for x in before) if before else None)


def test_slots_are_measured_from_the_hottest_key(spark):
    rows = rows_for(2, 800)
    df = spark.createDataFrame(rows, "k long, t long, seq long, v long, f boolean")
    assert measure_slot(df, ["k"], "t") is None
    spark.conf.set("spoor.window.rows", "50")
    try:
        slot = measure_slot(df, ["k"], "t")
        fullest = df.groupBy("k", F.expr(f"t div {slot}")).count().agg(F.max("count")).first()[0]
        assert fullest <= 50
    finally:
        spark.conf.unset("spoor.window.rows")


@pytest.mark.parametrize("slot", [None, 90])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, slot, inclusive, direction):
    rng = random.Random(3)
    left = [(rng.randrange(2), rng.randrange(200), i) for i in range(80)]
    right = [(rng.randrange(2), t, t * 10) for t in sorted(rng.sample(range(200), 40))]
    out = asof(spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, rt long, val long"),
               ["k"], "t", "rt", ["val"], inclusive=inclusive, direction=direction, slot=slot)
    got = {r.id: r.val for r in out.collect()}
    for k, t, i in left:
        if direction == "backward":
            hits = [v for kk, rt, v in right if kk == k and (rt <= t if inclusive else rt < t)]
            assert got[i] == (max(hits) if hits else None)
        else:
            hits = [v for kk, rt, v in right if kk == k and (rt >= t if inclusive else rt > t)]
            assert got[i] == (min(hits) if hits else None)


def intervals(rng, n, base):
    out = []
    for i in range(n):
        start = base + rng.randrange(0, 4_000_000)
        out.append((rng.randrange(2), start, start + rng.choice([0, 1, 40, 20_000, 300_000, 3_000_000]), i))
    return out


@pytest.mark.parametrize("closed", [False, True])
def test_point_in_intervals_matches_brute_force(spark, closed):
    rng = random.Random(4)
    base = 1_700_000_000_000_000_000
    spans = intervals(rng, 60, base)
    points = [(rng.randrange(2), base + rng.randrange(0, 4_000_000), i) for i in range(120)] + [(k, s, 1000 + i) for k, s, _, i in spans[:20]]
    out = point_in_intervals(
        spark.createDataFrame(points, "k long, t long, pid long"), spark.createDataFrame(spans, "k long, s long, e long, sid long"), ["k"], "t", "s", "e", closed)
    want = sorted((p, i) for k, t, p in points for kk, s, e, i in spans if kk == k and s <= t and (t <= e if closed else t < e))
    assert sorted((r.pid, r.sid) for r in out.collect()) == want


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """A file of a few kilobytes may explode to any number of rows, which no driver is to hold."""
    spark.range(1000).selectExpr("1L as k", "id as t").write.parquet(f"{tmp_path}/p")
    spark.range(1000).selectExpr("1L as k", "id as s", "id + 5 as e").write.parquet(f"{tmp_path}/i")
    points, runs = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/i")
    joined = point_in_intervals(points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))), runs, ["k"], "t", "s", "e")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50 * sum(min(i, 4) + 1 for i in range(1000))


def test_interval_pairs_match_brute_force_and_are_not_repeated(spark):
    rng = random.Random(5)
    left, right = intervals(rng, 50, 10**15), intervals(rng, 50, 10**15)
    out = interval_pairs(
        spark.createDataFrame(left, "k long, ls long, le long, lid long"), spark.createDataFrame(right, "k long, rs long, re long, rid long"),
        ["k"], ("ls", "le"), ("rs", "re"))
    want = sorted((i, j) for k, s, e, i in left for kk, ss, ee, j in right if k == kk and s < ee and ss < e and s < e and ss < ee)
    assert sorted((r.lid, r.rid) for r in out.collect()) == want


def hot_cell(rng):
    """Points, half of them within one cell and two equal but for their number; intervals, most of them within that cell too, some long."""
    base = (1_700_000_000_000_000_000 >> 30) << 30
    points = [(0, base + rng.randrange(0, 10_000), i) for i in range(300)] + [(i % 5, base + rng.randrange(0, 1 << 34), 300 + i) for i in range(300)]
    points += [(0, base + 77, 600), (0, base + 77, 601), (None, base, 602)]
    spans = [(0, s, s + rng.randrange(0, 9_000), i) for i, s in enumerate(base + rng.randrange(0, 10_000) for _ in range(150))]
    spans += [(i % 5, s, s + rng.randrange(0, 1 << 33), 150 + i) for i, s in enumerate(base + rng.randrange(0, 1 << 34) for _ in range(60))]
    return points, spans + [(None, base, base + 5, 210), (0, base + 50, base + 90, 211), (0, base + 50, base + 90, 212)]


def cells_met(monkeypatch):
    """Fullest cell or block of either side and pairs compared in one, for each join of cells."""
    met = []
    spread = interval_join._spread

    def watched(df, hot, cell, own, other):
        out = spread(df, hot, cell, own, other).dropna(subset=list(cell))
        met.append(out.groupBy(*cell, "_rows_at", "_columns_at").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(interval_join, "_spread", watched)
    return met


@pytest.mark.parametrize("closed", [False, True])
def test_half_of_all_points_in_one_cell(spark, monkeypatch, closed):
    points, spans = hot_cell(random.Random(14))
    met = cells_met(monkeypatch)
    spark.conf.set("spoor.window.rows", "40")
    try:
        out = point_in_intervals(
            spark.createDataFrame(points, "k long, t long, pid long"), spark.createDataFrame(spans, "k long, s long, e long, sid long"), ["k"], "t", "s", "e", closed)
        got = sorted((r.pid, r.sid) for r in out.collect())
    finally:
        spark.conf.unset("spoor.window.rows")
    assert got == sorted((p, i) for k, t, p in points for kk, s, e, i in spans if k is not None and kk == k and s <= t and (t <= e if closed else t < e))
    assert len(met) == 2 and max(met) <= 65  # 40 and what a hash is uneven, of cells with 300 points
    assert out.columns == ["k", "t", "pid", "s", "e", "sid"]


def test_pairs_of_a_hot_cell(spark, monkeypatch):
    rng = random.Random(15)
    _, left = hot_cell(rng)
    _, right = hot_cell(rng)
    met = cells_met(monkeypatch)
    monkeypatch.setattr(interval_join, "PAIRS", 20)  # 16 rows against 16
    spark.conf.set("spoor.window.rows", "13")
    try:
        out = interval_pairs(
            spark.createDataFrame(left, "k long, ls long, le long, lid long"), spark.createDataFrame(right, "k long, rs long, re long, rid long"),
            ["k"], ("ls", "le"), ("rs", "re"))
        got = sorted((r.lid, r.rid) for r in out.collect())
    finally:
        spark.conf.unset("spoor.window.rows")
    assert got == sorted((i, j) for k, s, e, i in left for kk, ss, ee, j in right if k is not None and k == kk and s < ee and ss < e and s < e and ss < ee)
    assert len(met) == 4 and max(met) <= 30


def test_one_job_tells_that_no_cell_is_hot(spark, monkeypatch):
    points, spans = hot_cell(random.Random(16))
    monkeypatch.setattr(interval_join, "cut_lineage", lambda df: pytest.fail("nothing is written"))
    out = point_in_intervals(spark.createDataFrame(points, "k long, t long, pid long"), spark.createDataFrame(spans, "k long, s long, e long, sid long"), ["k"], "t", "s", "e")
    assert out.count() == sum(k is not None and kk == k and s <= t < e for k, t, _ in points for kk, s, e, _ in spans)
    none = spark.createDataFrame([], "k long, s long, e long, sid long")
    assert point_in_intervals(out.select("k", "t", "pid"), none, ["k"], "t", "s", "e").count() == 0


@pytest.mark.parametrize("slot", [None, 3])
def test_order_statistics(spark, slot):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(30)) for _ in range(200)]
    out = order_statistics(spark.createDataFrame(rows, "k long, v long"), ["k"], "v",
                           {"p50": lambda n: F.floor(n * 0.5), "last": lambda n: n - 1}, slot)
    for r in out.collect():
        values = sorted(v for k, v in rows if k == r.k)
        assert (r.n, r.p50, r["last"]) == (len(values), values[len(values) // 2], values[-1])


def test_no_python_and_no_cross_join_in_an_asof_plan(spark):
    left = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    plan = asof(left, left.select("k", F.col("t").alias("rt")), ["k"], "t", "rt", ["rt"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_stray_value_leaves_slots_small(spark):
    rows = [(1, 1_700_000_000_000_000_000 + i, i) for i in range(1000)] + [(1, 0, 1000)]
    df = spark.createDataFrame(rows, "k long, t long, seq long")
    spark.conf.set("spoor.window.rows", "50")
    try:
        width = measure_slot(df, ["k"], "t")
        fullest = df.groupBy("k", F.expr(f"t div {width}")).count().agg(F.max("count")).first()[0]
        assert fullest <= 50
        summed = with_order(df, ["k"], ["t", "seq"], {"n": running_sum(F.lit(1))})
        assert sorted(r.n for r in summed.collect()) == list(range(1, 1002))
        same = df.withColumn("t", F.lit(7).cast("long"))  # ties stay together, results stay right
        assert sorted(r.n for r in with_order(same, ["k"], ["t", "seq"], {"n": running_sum(F.lit(1))}).collect()) == list(range(1, 1002))
    finally:
        spark.conf.unset("spoor.window.rows")


def test_slots_share_one_shuffle(spark):
    """In slots the rows are dealt out once, for the join with the carry and for the window; null keys are a key of their own."""
    rows = [(k, t, t * t) for k in (None, 1, 2) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, t bigint, v bigint").repartition(3)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = with_order(df, ["k"], ["t"], {"s": running_sum(F.col("v")), "p": prev(F.col("v"))}, 7)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.t): (r.s, r.p) for r in out.collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    # of the rows, of their sums by slot and of these along the key
    assert plan.count("Exchange hashpartitioning") <= 4
    assert got == {(k, t): (sum(x * x for x in range(t + 1)), (t - 1) ** 2 if t else None) for k, t, _ in rows}
