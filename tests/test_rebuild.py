"""Poll, park and readiness reconstruction: literal cases, and state machines as plain loops on random events."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import polls as pl
from spoor.operators import rebuild as op
from spoor.operators import spans as sp

from conftest import tuples

SCHEMA = ("source_key string, host string, worker_id int, task_id long, kind string, ts_ns long, seq long, tid int, spawn_loc string,"
          " waker_task_id long, instrumented boolean, cpu_time_ns long, sched_wait_ns long, local_queue int")


def events(spark, rows):
    """rows: (kind, ts, worker, task[, extra dict])"""
    full = []
    for i, row in enumerate(rows):
        kind, ts, worker, task = row[:4]
        x = row[4] if len(row) > 4 else {}
        full.append((x.get("src", "s"), "h", worker, task, kind, ts, i, x.get("tid", 100 + (worker or 0)), x.get("loc", "loc"), x.get("waker"),
                     x.get("inst"), x.get("cpu", 0), x.get("wait"), x.get("q", 0)))
    return spark.createDataFrame(full, SCHEMA)


def test_poll_trace(spark):
    ms = 1_000_000
    e = events(spark, [("WorkerUnpark", 0, 0, None, {"tid": 100}), ("PollStart", ms, 0, 1), ("PollEnd", 3 * ms // 2, 0, 1), ("PollStart", 10 * ms, 0, 2), ("PollEnd", 60 * ms, 0, 2)])
    assert tuples(op.polls(e), "start_ns", "end_ns", "task_id", "explicit_end") == [(ms, 3 * ms // 2, 1, True), (10 * ms, 60 * ms, 2, True)]
    samples = spark.createDataFrame(
        [(i, "s", 999 if i == 5 else 100, int(t * ms), 0, ["f"]) for i, t in enumerate((1.1, 1.3, 20, 30, 40, 70))],
        "sample_id long, source_key string, tid int, t long, source int, frames array<string>")
    got = op.attribute_samples(samples, e).withColumn("dur", F.col("poll_end") - F.col("poll_start"))
    assert got.filter(f"dur <= {ms}").count() == 2 and got.filter(f"dur >= {10 * ms}").count() == 3
    assert got.filter("worker_id is null").count() == 1 and got.count() == 6


def test_lost_poll_ends(spark):
    e = events(spark, [
        ("PollStart", 1, 0, 1), ("WorkerPark", 5, 0, None), ("PollStart", 10, 0, 2), ("WorkerUnpark", 20, 0, None), ("PollStart", 30, 0, 3), ("PollStart", 40, 0, 4),
        ("PollEnd", 50, 0, 4), ("PollStart", 60, 0, 5)])
    assert tuples(op.polls(e), "start_ns", "end_ns", "explicit_end") == [(1, 5, False), (40, 50, True)]
    assert op.unproven_ends(e).first()["end_unproven"] == 2
    assert tuples(op.polls_open_ended(e), "start_ns", "end_ns", "open_ended") == [(1, 5, True), (30, 40, True), (40, 50, False)]


def test_task_that_moves_workers_drops_the_old_poll(spark):
    e = events(spark, [("PollStart", 1, 0, 7), ("PollStart", 5, 1, 7), ("PollEnd", 6, 1, 7), ("PollEnd", 9, 0, 7)])
    assert tuples(op.polls(e), "worker_id", "start_ns") == [(1, 5)]
    assert op.unproven_ends(e).first()["end_unproven"] == 1


def test_handoff_gaps_are_half_open_and_chain(spark):
    e = events(spark, [("WorkerUnpark", 10, 0, None, {"tid": 42}), ("WorkerPark", 20, 0, None, {"tid": 99}), ("WorkerUnpark", 30, 0, None, {"tid": 77})])
    assert tuples(op.handoff_gaps(e), "from_tid", "to_tid", "start_ns", "end_ns") == [(42, 99, 10, 20), (99, 77, 20, 30)]
    assert tuples(op.thread_gaps(op.handoff_gaps(e)), "tid", "start_ns", "end_ns") == [(42, 10, 20), (77, 20, 30), (99, 10, 30)]
    assert op.active_periods(e, gap_safe=True).count() == 0 and op.active_periods(e).count() == 1


def test_active_period_ratio(spark):
    e = events(spark, [("WorkerUnpark", 100, 0, None, {"cpu": 10}), ("WorkerPark", 200, 0, None, {"cpu": 60}), ("WorkerUnpark", 300, 0, None, {"cpu": 60, "wait": 9}),
                       ("WorkerPark", 310, 0, None, {"cpu": 90})])
    assert tuples(op.active_periods(e), "start_ns", "ratio") == [(100, 0.5), (300, 1.0)]
    assert tuples(op.parks(e), "start_ns", "end_ns", "sched_wait_ns") == [(200, 300, 9), (310, 310, None)]


def test_unpark_at_the_end_of_a_source_wakes(spark):
    """Its wait may be unknown; a park without an unpark is open."""
    e = events(spark, [("WorkerPark", 100, 0, None), ("WorkerPark", 200, 1, None), ("WorkerUnpark", 300, 0, None)])
    assert tuples(op.parks(e, woken=True), "worker_id", "start_ns", "end_ns", "sched_wait_ns") == [(0, 100, 300, None)]
    assert op.parks(e).count() == 2


def test_spawn_family_keeps_whole_nanoseconds(spark):
    """Nine lifetimes whose sum no double holds, and an owner ranked by what the caller says."""
    life = 2_592_000_000_000_001
    rows = [(i, "loc", 1, 5, 5 + i % 2, life, None if i else 1) for i in range(9)]
    tasks = spark.createDataFrame(rows, "task_id long, spawn_loc string, polls long, total_ns long, longest_ns long, lifetime_ns long, terminate_ns long")
    assert tuples(pl.spawn_family(tasks), "longest_task", "mean_lifetime_ns") == [(1, float(life))]
    assert tuples(pl.spawn_family(tasks, F.col("longest_ns") - 10 * F.col("task_id")), "longest_task") == [(0,)]
    assert tuples(pl.spawn_family(tasks.withColumn("lifetime_ns", F.lit(None).cast("long"))), "mean_lifetime_ns") == [(None,)]


def test_wake_inside_an_earlier_poll_counts_from_its_end(spark):
    e = events(spark, [("PollStart", 100, 0, 1), ("Wake", 150, None, 1, {"waker": 5}), ("PollEnd", 200, 0, 1), ("PollStart", 260, 0, 1), ("PollEnd", 270, 0, 1),
                       ("Wake", 300, None, 1, {"waker": 6}), ("PollStart", 310, 0, 1), ("PollEnd", 320, 0, 1)])
    assert tuples(op.sched_delays(e), "start_ns", "delay_ns", "waker_task_id") == [(260, 60, 5), (310, 10, 6)]
    assert tuples(op.wake_to_poll(e), "poll_ns", "delay_ns") == [(260, 110), (310, 10)]


def random_events(seed, n=60):
    rng = random.Random(seed)
    kinds = ["PollStart", "PollStart", "PollEnd", "PollEnd", "WorkerPark", "WorkerUnpark", "TaskSpawn", "TaskTerminate", "Wake", "Wake"]
    return [(rng.choice(kinds), 10 * i + 1, rng.randrange(2), rng.randrange(1, 4), {"waker": rng.randrange(9), "src": f"s{seed}"}) for i in range(n)]


def replay(rows):
    """Straightforward per-event simulation: what a poll's bounds and readiness must be."""
    lane, ready, dead, out, unproven = {}, {}, set(), {}, 0

    def close(worker, ts, how):
        nonlocal unproven
        poll = lane.pop(worker, None)
        if poll is None:
            return
        if how == "PollEnd" and poll["woken"] is not None and poll["task"] not in dead:
            ready[poll["task"]] = (ts, 2, poll["woken"])
        if how in ("PollEnd", "WorkerPark"):
            out[poll["seq"]] = (poll["start"], ts, poll["ready"])
        else:
            unproven += 1

    for seq, (kind, ts, worker, task, x) in enumerate(rows):
        if kind == "TaskSpawn":
            ready[task] = (ts, 0, None)
            dead.discard(task)
            for p in lane.values():  # a fresh task is not being polled
                if p["task"] == task:
                    p["detached"] = True
        elif kind == "TaskTerminate":
            ready.pop(task, None)
            dead.add(task)
        elif kind == "Wake":
            if task in dead:
                continue
            running = [p for p in lane.values() if p["task"] == task and not p.get("detached")]
            if running:
                if running[0]["woken"] is None:
                    running[0]["woken"] = x["waker"]
            else:
                ready.setdefault(task, (ts, 1, x["waker"]))
        elif kind == "PollStart":
            close(worker, ts, "restart")
            for w in [w for w, p in lane.items() if p["task"] == task]:
                close(w, ts, "moved")
            dead.discard(task)
            lane[worker] = {"task": task, "start": ts, "seq": seq, "woken": None, "ready": ready.pop(task, None)}
        else:
            close(worker, ts, kind)
    return out, unproven


def test_random_events_match_the_simulation(spark):
    sets = {f"s{seed}": random_events(seed) for seed in range(40)}
    rows, base = [], 0
    for name, evs in sets.items():
        for i, (kind, ts, worker, task, x) in enumerate(evs):
            rows.append((name, "h", worker, task, kind, ts, base + i, 1, "l", x["waker"], None, 0, None, 0))
        base += 1000
    e = spark.createDataFrame(rows, SCHEMA)
    for slot in (None, 70):
        got = {(r.source_key, r.seq % 1000): r for r in op.readiness(e, slot).collect()}
        bad = {r.source_key: r.end_unproven for r in op.unproven_ends(e, slot).collect()}
        for name, evs in sets.items():
            want, unproven = replay(evs)
            assert bad.get(name, 0) == unproven
            mine = {seq: r for (src, seq), r in got.items() if src == name}
            assert set(mine) == set(want), name
            for seq, (start, end, ready) in want.items():
                r = mine[seq]
                assert (r.start_ns, r.end_ns) == (start, end)
                assert (r.ready_at_ns, r.scheduling_delay_kind, r.waker_task_id) == (ready or (None, None, None)), (name, seq)


def test_lifo_pairing_matches_a_stack(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(6)}", rng.choice(["SpanEnter", "SpanExit"]), 5 * i, i) for i in range(400)]
    want = []
    for key in {r[0] for r in rows}:
        stack = []
        for _, kind, ts, seq in (r for r in rows if r[0] == key):
            if kind == "SpanEnter":
                stack.append((ts, seq))
            elif stack:
                start, enter = stack.pop()
                want.append((key, "paired", start, ts, enter))
            else:
                want.append((key, "unmatched_exit", None, ts, None))
        want += [(key, "unmatched_enter", start, None, enter) for start, enter in stack]
    df = spark.createDataFrame(rows, "key string, kind string, ts_ns long, seq long")
    for slot in (None, 40):
        got = sp.pair_lifo(df, ["key"], slot)
        assert tuples(got, "key", "state", "start_ns", "end_ns", "enter_seq") == sorted(want, key=repr)


def test_exit_at_the_start_of_two_polls_belongs_to_the_one_before(spark):
    """A poll of no length and the next one begin when the earlier one ends: the exit then is that one's."""
    polls = spark.createDataFrame([("s", 0, 7, 1, 10, 20), ("s", 0, 8, 2, 20, 20), ("s", 0, 9, 3, 20, 30)], "source_key string, worker_id int, task_id long, seq long, start_ns long, end_ns long")
    moves = spark.createDataFrame([("s", 1, 0, 0, "SpanExit", 20, 5), ("s", 1, 1, 0, "SpanEnter", 20, 6)], "source_key string, span_id long, segment long, worker_id int, kind string, ts_ns long, seq long").withColumn("task_id", F.lit(None).cast("long"))
    for slot in (None, 5):
        assert tuples(sp.pairing_lanes(moves, polls, slot), "kind", "lane") == [("SpanEnter", 9), ("SpanExit", 7)]


def test_merge_intervals_joins_touching_ones(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 12), ("a", 20, 30), ("a", 21, 22), ("b", 5, 6)], "k string, start_ns long, end_ns long")
    for slot in (None, 4):
        assert tuples(op.merge_intervals(df, ["k"], slot), "k", "start_ns", "end_ns") == [("a", 0, 12), ("a", 20, 30), ("b", 5, 6)]


def test_worker_activity_sums_observed_time_per_segment(spark):
    p = spark.createDataFrame(
        [("h", 0, "s1", 0, 100), ("h", 0, "s1", 900, 1000), ("h", 0, "s2", 50_000, 50_500), ("h", 3, "s1", 0, 1)],
        "host string, worker_id int, source_key string, start_ns long, end_ns long").withColumn("duration_ns", F.expr("end_ns - start_ns"))
    assert tuples(pl.worker_activity(p), "worker_id", "busy_ns", "observed_ns") == [(0, 700, 1500), (3, 1, 1)]
    row = pl.host_busy(pl.worker_activity(p)).first()
    assert (row.active_workers, row.num_workers, round(row.busy_pct, 4)) == (2, 4, round(701 / 1501 * 100, 4))
