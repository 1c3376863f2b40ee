"""Points against intervals without pairs: the containment forest, and the task of an event from one sweep over polls."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import series, spans
from spoor.plans import blocks, forest, interval_join


def table(spark, rows):
    return spark.createDataFrame(rows, "source_key string, span_id bigint, worker_id int, start_ns bigint, end_ns bigint")


def random_spans(seed, n, reach, crossing):
    """Spans of three workers; without ``crossing`` each lies in one that was drawn before, or apart from it."""
    rng, rows, lanes = random.Random(seed), [], {w: [(0, reach)] for w in range(3)}
    for i in range(n):
        w = rng.randrange(3)
        if crossing:
            a, b = sorted(rng.choices(range(reach), k=2))
        else:
            low, high = rng.choice(lanes[w])
            a, b = sorted(rng.choices(range(low, high + 1), k=2))
            if any(s < a < e < b or a < s < b < e for s, e in lanes[w]):
                continue
            lanes[w].append((a, b))
        rows.append((f"s{i % 4}", i // 4, w, a, b))
    return rows


@pytest.mark.parametrize("slot", [None, 7])
@pytest.mark.parametrize("crossing", [True, False])
def test_enclosing_spans_against_all_pairs(spark, crossing, slot):
    rows = random_spans(5, 90, 60, crossing)
    rows += [("s9", 1, 0, 3, 9), ("s9", 1, 0, 7, 20), ("s9", 1, 1, 5, 8), ("s9", 2, 0, 3, 20), ("s9", 3, 0, 3, 20), ("s9", 4, 2, 9, 9)]  # one span in parts, equal ones, an empty one
    rng = random.Random(6)
    points = [(f"p{i:03}", rng.randrange(3), rng.randrange(-2, 63)) for i in range(150)]
    want = {}
    for source, span, worker, a, b in rows:
        for name, lane, t in points:
            if lane == worker and a <= t < b:
                want.setdefault((source, span), set()).add(name)
    samples = spark.createDataFrame(points, "sample_id string, worker_id int, ts_ns bigint")
    got = spans.enclosing_spans(samples, table(spark, rows), slot=slot).collect()
    assert {(r.source_key, r.span_id): (r.samples, r.first_sample) for r in got} == {k: (len(v), min(v)) for k, v in want.items()} and len(got) == len(want)


def test_the_forest_nests(spark):
    keys = ["worker_id"]
    rows = random_spans(8, 60, 40, True)
    pieces = forest.nested_pieces(table(spark, rows), keys, ["source_key", "span_id"])
    by_lane = {}
    nodes = {(r.worker_id, r.start_ns, r.end_ns): r for r in forest.forest(pieces, keys).collect()}
    for lane, a, b in nodes:
        by_lane.setdefault(lane, []).append((a, b))
    for lane, own in by_lane.items():
        for a, b in own:
            assert not any(s < a < e < b for s, e in own)
            holders = [(s, e) for s, e in own if s <= a and b <= e and (s, e) != (a, b)]
            r = nodes[lane, a, b]
            assert r.level == len(holders) + 1
            assert (r.up_start, r.up_end) == (min(holders, key=lambda h: h[1] - h[0]) if holders else (None, None))
    for source, span, lane, a, b in rows:  # pieces of a span follow each other from its start to its end
        own = sorted((r.start_ns, r.end_ns) for r in pieces.filter((F.col("source_key") == source) & (F.col("span_id") == span)).collect()) if span < 3 else None
        if own and a < b:
            assert own[0][0] == a and own[-1][1] == b and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_no_rows_of_samples_and_spans(spark):
    """A thousand spans around each of a thousand samples are a thousand rows, not a million."""
    rows = [("s", i, 0, i, 5000 - i) for i in range(1000)]
    samples = spark.range(1000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("sample_id"), F.lit(0).alias("worker_id"), (F.col("id") + 2000).alias("ts_ns"))
    pieces = forest.nested_pieces(table(spark, rows), ["worker_id"], ["span_id"])
    nodes = forest.forest(pieces, ["worker_id"])
    assert pieces.count() == nodes.count() == 1000 and nodes.agg(F.max("level")).first()[0] == 1000
    assert forest.innermost(samples, nodes, ["worker_id"]).count() == 1000
    got = spans.enclosing_spans(samples, table(spark, rows))
    assert got.filter("samples = 1000 AND first_sample = 'p0000'").count() == 1000


def event_tasks(events, polls):
    out = {}
    for source, seq, ts, worker, own in events:
        open_ = [(w, task) for s, w, task, a, b in polls if s == source and a <= ts < b]
        here = [task for w, task in open_ if w == worker and w is not None]
        tasks = {task for _, task in open_}
        out[source, seq] = own if own is not None else here[0] if here else min(tasks) if len(tasks) == 1 else None
    return out


@pytest.mark.parametrize("slot", [None, 9])
def test_event_task_against_all_polls(spark, slot):
    rng, polls = random.Random(2), []
    for source in ("a", "b"):
        for worker in (*range(5), None):
            t = rng.randrange(5)
            while t < 80:
                length = rng.choice([0, 1, 4, 9])
                polls.append((source, worker, rng.choice([7, 8, (1 << 62) + 1, (1 << 62) + 3]), t, t + length))
                t += length + rng.choice([1, 10, 40])
    events = [(source, i, rng.randrange(90), rng.choice([None, *range(6)]), 99 if i % 7 == 0 else None) for source in ("a", "b", "c") for i in range(80)]
    got = series.event_task(spark.createDataFrame(events, "source_key string, seq bigint, ts_ns bigint, worker_id int, own_task bigint"),
                            spark.createDataFrame(polls, "source_key string, worker_id int, task_id bigint, start_ns bigint, end_ns bigint"), slot).collect()
    assert {(r.source_key, r.seq): r.task_id for r in got} == event_tasks(events, polls) and len(got) == len(events)


def test_event_task_joins_no_pairs(spark):
    """With a thousand workers busy at once, no step has more rows than events and polls."""
    polls = spark.range(1000).select(F.lit("a").alias("source_key"), F.col("id").cast("int").alias("worker_id"), F.col("id").alias("task_id"), F.lit(0).cast("bigint").alias("start_ns"), F.lit(100).cast("bigint").alias("end_ns"))
    events = spark.range(1000).select(F.lit("a").alias("source_key"), F.col("id").alias("seq"), F.lit(50).cast("bigint").alias("ts_ns"), F.lit(5000).alias("worker_id"), F.lit(None).cast("bigint").alias("own_task"))
    found = series.event_task(events, polls, None)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("task_id IS NULL").count() == 1000


def test_range_least_against_slices(spark):
    rng = random.Random(3)
    values = {k: [f"v{rng.randrange(10_000):05}" for _ in range(37)] for k in (0, 1)}
    points = spark.createDataFrame([(k, i, v) for k, own in values.items() for i, v in enumerate(own)], "k int, place bigint, v string")
    ranges = [(k, a, b) for k in values for a in range(37) for b in range(a + 1, 38)]
    got = blocks.range_least(points, spark.createDataFrame(ranges, "k int, low bigint, high bigint"), ["k"], "v").collect()
    assert {(r.k, r.low, r.high): r.v for r in got} == {(k, a, b): min(values[k][a:b]) for k, a, b in ranges} and len(got) == len(ranges)


@pytest.mark.parametrize("slot", [None, 5])
def test_spans_that_begin_together_make_no_pairs(spark, slot):
    """2000 spans of one start and others that cross: before, each end met every span around it (two million rows)."""
    rows = [("s", i, 0, 0, 10 + i) for i in range(2000)] + [("t", i, 0, 5 + i, 3000 + i) for i in range(500)]
    samples = spark.createDataFrame([(f"p{i:04}", 0, 2 * i) for i in range(1500)], "sample_id string, worker_id int, ts_ns bigint")
    made, plain = [], interval_join.point_in_intervals
    spans.point_in_intervals = forest.point_in_intervals = lambda *a, **k: made.append(1) or plain(*a, **k)
    try:
        got = spans.enclosing_spans(samples, table(spark, rows), slot=slot).collect()
    finally:
        spans.point_in_intervals = forest.point_in_intervals = plain
    want = {(s, i): [t for t in range(a + a % 2, min(b, 3000), 2)] for s, i, _, a, b in rows}
    assert not made
    assert {(r.source_key, r.span_id): (r.samples, r.first_sample) for r in got} == {k: (len(v), f"p{v[0] // 2:04}") for k, v in want.items() if v}
