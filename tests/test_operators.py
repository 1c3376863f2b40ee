"""Spans, series, memory, keys, frames and checks on small inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from spoor.functions import frames as fr
from spoor.functions import privacy as pv
from spoor.functions.buckets import log_bucket, span_bucket, span_bucket_bounds
from spoor.operators import checks, events as ev, memory, series, spans as sp, stacks
from spoor.sources import keys as kk

from conftest import tuples


def test_mini_trace_counts(spark):
    rows = [(100 + i, f"st{i % 2}", 0, 0) for i in range(5)] + [(105, "st0", None, 0)] + [(106 + i, "st1", 1, 1) for i in range(3)]
    s = spark.createDataFrame(rows, "ts_ns long, stack_id string, worker_id int, source int").withColumn("host", F.lit("h")).withColumn(
        "spawn_location", F.lit(None).cast("string"))
    assert stacks.facet_filter(s).count() == 6
    assert stacks.facet_filter(s, {"source": "all"}).count() == 9
    assert stacks.facet_filter(s, phase="blocking").count() == 3
    assert stacks.facet_filter(s, {"thread_class": "off-worker"}).count() == 1


def test_flamegraph_self_counts_sum_to_the_total(spark):
    d = spark.createDataFrame([(["leaf", "mid", "root"], 3), (["mid", "root"], 2), (["leaf", "root"], 1), (["root", "root"], 4)], "frames array<string>, samples long")
    tree = stacks.flamegraph_tree(d)
    assert tuples(tree, "path", "samples", "self_samples") == [
        ("root", 10, 0), ("root;leaf", 1, 1), ("root;mid", 5, 2), ("root;mid;leaf", 3, 3), ("root;root", 4, 4)]
    assert {r.path: r.parent_path for r in tree.collect()}["root;mid;leaf"] == "root;mid"
    callers, callees, totals = stacks.inspect(d, "root")
    assert totals.first().asDict() == {"total": 10, "self": 4}
    assert tuples(callers, "path", "samples") == [("root", 10)]
    assert {r.path: round(r.x, 3) for r in stacks.flat_layout(tree).collect()} == {
        "root": 0.0, "root;mid": 0.0, "root;mid;leaf": 0.0, "root;root": 0.5, "root;leaf": 0.9}
    assert "root;mid 2" in [r.value for r in stacks.folded_lines(tree).collect()]


def test_diff_score_is_clamped_and_signed(spark):
    d = spark.createDataFrame([(5, 5), (0, 900), (900, 0)], "a long, b long")
    got = [r[0] for r in d.select(stacks.diff_score(F.col("a"), F.col("b"), F.lit(1000), F.lit(1000))).collect()]
    assert got[0] == 0 and got[1] == 1.0 and got[2] == -1.0


def test_buckets_are_exact_at_powers_of_two(spark):
    values = [1, 2, 3, 4, 1023, 1024, 2**40, 2**40 - 1, 2**52]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", log_bucket(F.col("v")).alias("b"))
    for r in df.collect():
        # 4 * log2(v) floored, in integers: the largest k with 2^k <= v^4
        assert r.b == (r.v**4).bit_length() - 1
    lo, hi = span_bucket_bounds(span_bucket(F.col("v")))
    zero = spark.createDataFrame([(0,), (1,)], "v long").select("v", lo.alias("lo"), hi.alias("hi")).orderBy("v").collect()
    assert [(r.lo, r.hi) for r in zero] == [(0, 1), (1, 2)]


SPAN = "span_uid string, span_type_uid string, name string, start_ns long, end_ns long, elapsed_ns long, details_complete boolean, attributes map<string,string>"


def test_facets_cap_values_and_flag_cardinality(spark):
    rows = [(f"u{i:02d}", "t", "n", i, i + 1, 1, True, {"many": f"v{i:02d}", "one": "x"}) for i in range(12)]
    got = {r.key: r for r in sp.attribute_facets(spark.createDataFrame(rows, SPAN)).collect()}
    assert got["many"].first_values == [f"v{i:02d}" for i in range(10)] and got["many"].high_cardinality and got["many"].occurrences == 12
    assert got["one"].first_values == ["x"] and not got["one"].high_cardinality


def test_span_scope_is_half_open_on_the_end_and_needs_it(spark):
    rows = [("a", "t", "n", 0, 100, 100, True, {}), ("b", "t", "n", 0, 200, 200, True, {}), ("c", "t", "n", 0, 199, 199, True, {})]
    df = spark.createDataFrame(rows, SPAN)
    assert tuples(sp.span_row_scope(df, 100, 200), "span_uid") == [("a",), ("c",)]
    with pytest.raises(Exception, match="end_ns is required"):
        sp.span_row_scope(df.withColumn("end_ns", F.lit(None).cast("long")), 100, 200).count()


def test_depth_survives_cycles_and_unknown_parents(spark):
    rows = [("a", *r) for r in [(1, None), (2, 1), (3, 2), (10, 99), (11, 10), (20, 21), (21, 20)]] + [("b", 1, None), ("b", 2, 1), ("b", 5, 2)]
    df = spark.createDataFrame(rows, "source_key string, span_id long, parent_span_id long")
    depths = {(r.source_key, r.span_id): r.depth for r in sp.span_depth(df).collect()}
    assert depths == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 10): 1, ("a", 11): 2, ("a", 20): None, ("a", 21): None, ("b", 1): 0, ("b", 2): 1, ("b", 5): 2}
    seeds = spark.createDataFrame([("a", 1), ("a", 20), ("b", 2)], "source_key string, span_id long")
    assert tuples(sp.descendants(df, seeds), "source_key", "span_id") == [("a", 1), ("a", 2), ("a", 20), ("a", 21), ("a", 3), ("b", 2), ("b", 5)]


def test_long_chains(spark):
    n = 3000
    df = spark.createDataFrame([("s", i, i - 1 if i else None, i, 10_000 if i > 4 else 20) for i in range(n)], "source_key string, span_id long, parent_span_id long, start_ns long, end_ns long")
    assert {r.span_id: r.depth for r in sp.span_depth(df).collect()} == {i: i for i in range(n)}
    assert sp.descendants(df, df.filter("span_id = 7")).count() == n - 7
    probes = df.select("source_key", "span_id", F.lit(5000).cast("long").alias("t"))
    got = {r.span_id: (r.outermost, r.steps) for r in sp.ancestry_at(df, probes).collect()}
    assert got[n - 1] == (5, n - 6) and got[5] == (5, 0) and got[3] == (3, 0)
    assert tuples(sp.root_spans(df), "span_id") == [(0,)]


def test_attribute_filter_splits_at_the_first_equals_sign(spark):
    df = spark.createDataFrame([("a", "t", "n", 0, 1, 1, True, {"q": "x=1"}), ("b", "t", "n", 0, 1, 1, True, {"q": "x"})], SPAN)
    assert tuples(sp.attr_filter(df, ["q=x=1"]), "span_uid") == [("a",)]
    with pytest.raises(ValueError):
        sp.attr_filter(df, ["=x"])


def test_cpu_usage(spark):
    s = 10**9
    df = spark.createDataFrame([("h", 0, 1, s // 10, s // 20), ("h", s, 2, s // 2, 3 * s // 20), ("h", 2 * s, 3, 3 * s // 2, 23 * s // 20), ("h", 2 * s, 4, 0, 0)],
                               "host string, ts_ns long, seq long, user_cpu_ns long, system_cpu_ns long")
    got = series.cpu_usage(df, 4).orderBy("start_ns").collect()
    assert [(r.cores, r.pct) for r in got] == [(0.5, 12.5), (2.0, 50.0)]
    stats = series.cpu_window_stats(series.cpu_usage(df, 4), 0, 2 * s).first()
    assert (stats.avg_cores, stats.max_cores) == (1.25, 2.0)


def test_alive_series_falls_back_when_a_value_is_missing(spark):
    m = spark.createDataFrame([("s", 1, "a", 3), ("s", 1, "b", 4), ("s", 2, "a", None), ("u", 1, "a", 9)], "source_key string, ts_ns long, runtime_name string, alive_tasks long")
    none = spark.createDataFrame([], "source_key string, ts_ns long, active_tasks long")
    life = spark.createDataFrame([("s", 7, 1), ("u", 7, 2)], "source_key string, ts_ns long, alive long")
    columns = ("source_key", "ts_ns", "alive")
    assert tuples(series.active_task_series(m, none, life), *columns) == [("s", 7, 1), ("u", 1, 9)]
    assert tuples(series.active_task_series(m.filter("ts_ns = 1"), none, life), *columns) == [("s", 1, 7), ("u", 1, 9)]
    old = spark.createDataFrame([("s", 3, 5)], "source_key string, ts_ns long, active_tasks long")
    assert tuples(series.active_task_series(m, old, life), *columns) == [("s", 3, 5), ("u", 1, 9)]


def test_counter_gaps_resets_and_equal_times(spark):
    rows = [("e", "h", 1, 1, {"k": "5"}), ("e", "h", 2, 2, {"k": "9"}), ("e", "h", 2, 3, {"k": "10"}), ("e", "h", 4, 4, {"k": "2"}), ("e", "h", 5, 5, {}), ("e", "h", 6, 6, {"k": "8"}), ("e", "h", 7, 7, {"k": "9"})]
    df = spark.createDataFrame(rows, "name string, host string, ts_ns long, seq long, fields map<string,string>")
    got = tuples(series.counter_series(df, "e", "k"), "seq", "start_ns", "end_ns", "value", "gap")
    assert got == [(2, 1, 2, 4, None), (4, 4, None, None, "reset"), (5, 5, None, None, "missing"), (7, 6, 7, 1, None)]


@pytest.mark.parametrize("slot", [None, 5])
def test_peak_per_window(spark, slot):
    times = [0, 1, 2, 9, 10, 10, 11, 19, 20]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    assert series.peak_per_window(df, "t", 10, slot).first()["peak"] == max(sum(1 for x in times if t - 10 < x <= t) for t in times)


def test_numeric_text(spark):
    df = spark.createDataFrame([("0",), ("01",), ("-1",), ("18446744073709551615",), ("18446744073709551616",), ("1e3",)], "s string")
    assert [r[0] is not None for r in df.select(series.numeric_value(F.col("s"))).collect()] == [True, False, False, True, False, False]


def test_alloc_weight_and_hooks(spark):
    df = spark.createDataFrame([(0,), (1024,), (524288,), (524288 * 60,)], "s long")
    got = [r[0] for r in df.select(memory.alloc_weight(F.col("s"))).collect()]
    assert got[0] == 0 and got[3] == 524288 * 60 and math.isclose(got[2], 524288 / (1 - math.exp(-1)))
    f = spark.createDataFrame([(["__rustc::__rust_alloc", "app", "__rustc::__rust_alloc"],), (["__rustc::__rust_alloc"],)], "f array<string>")
    assert [r[0] for r in f.select(memory.strip_hooks(F.col("f"))).collect()] == [["app", "__rustc::__rust_alloc"], []]


@pytest.mark.parametrize("key,layout,service,boot,epoch", [
    ("version=1/date=2024-01-02/service=a%2Fb/time=0102/instance=i/boot=qmxz-1/100-2.bin.gz", "version1", "a/b", "qmxz-1", 100),
    ("s3://bucket/pre/2024-01-02/0102/svc/host/abcd-9/100-2.bin.gz", "positional_with_boot", "svc", "abcd-9", 100),
    ("2024-01-02/0102/svc/host/100-2.bin", "positional_without_boot", "svc", None, 100),
    ("version=1/date=2024-01-02/service=s/time=bad/instance=i/boot=b/100-2.bin.gz", "unknown", None, None, 100),
    ("x/2024-01-02.txt", "unknown", None, None, None),
    ("a/b/1-2-3.bin", "unknown", None, None, None)])
def test_parse_key(spark, key, layout, service, boot, epoch):
    row = kk.parse_key(spark.createDataFrame([(key,)], "key string")).first()
    assert (row.layout, row.service, row.boot_id, row.epoch_secs) == (layout, service, boot, epoch)


def test_listing_window_and_order(spark):
    s = 10**9
    assert kk.listing_window(10_000 * s, 11_000 * s) == (9840, 11_100, "minute")
    lo, hi, grain = kk.listing_window(100 * 3600 * s, 900 * 3600 * s)
    assert (hi - lo, grain) == (802 * 3600, "hour")
    files = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    assert sorted(r["rank"] for r in kk.sampled_files(files).collect()) == list(range(1, 3001))
    first = {r.key for r in kk.sampled_files(files, 7).collect()}
    assert len(first) == 7 and first == {r.key for r in kk.sampled_files(files).filter("rank <= 7").collect()}


def test_segments(spark):
    df = spark.createDataFrame([("s", "h", 0, 10, "a"), ("s", "h", 8, 20, ""), ("s", "h", 30, 40, "b"), ("s", "h", 40, 50, "c")], "service string, host string, start_us long, end_us long, boot_id string")
    assert tuples(kk.segment_gaps(df), "gap_start", "gap_end") == [(20, 30)]
    assert tuples(kk.boot_transitions(df), "from_boot", "to_boot") == [("a", "b"), ("b", "c")]
    assert kk.segments_overlapping(df, 40, 40).count() == 1
    d = kk.density(df.withColumn("size", F.lit(100)), 0, 50, 5)
    assert round(d.agg(F.sum("bytes")).first()[0], 6) == 400


def test_frame_kinds(spark):
    want = {"__GI_read": "libc", "je_alloc": "allocator", "__schedule": "kernel", "tcp_send": "kernel", "tokio::runtime::scheduler::x": "runtime", "<std::sys::x": "runtime", "my::fn": "app", "0x12": "unknown", "main": "app"}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.k for r in df.select("s", fr.frame_kind(F.col("s")).alias("k")).collect()} == want


def test_privacy(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 7, 8, 1023, 5000)], "v long")
    assert all(r.v != r.p or r.v == 0 for r in df.select("v", pv.privacy_bucket(F.col("v")).alias("p")).collect())
    ids = spark.createDataFrame([(9, 5), (3, 1), (0, 0), (9, 2)], "id long, ts long")
    assert tuples(pv.renumber(ids, "id", "ts"), "id", "new_id") == [(0, 0), (3, 1), (9, 2)]


def test_clock_align_ignores_an_impossible_offset(spark):
    rows = [("a", 100, 0, "ClockSync", 1100), ("a", 50, 1, "x", None), ("b", 10, 0, "ClockSync", 1), ("b", 5, 1, "x", None), ("c", 7, 0, "x", None)]
    df = spark.createDataFrame(rows, "source_key string, ts_ns long, seq long, kind string, realtime_ns long")
    assert tuples(ev.clock_align(df), "source_key", "ts_ns", "wall_ns") == [("a", 100, 1100), ("a", 50, 1050), ("b", 10, 10), ("b", 5, 5), ("c", 7, 7)]


def test_long_poll_tiers(spark):
    ms = 1_000_000
    rows = [("h", 0, i, 0, (60 + i) * ms) for i in range(7)] + [("h", 0, 99, 0, 20 * ms), ("h", 0, 100, 0, 5 * ms)]
    out = checks.long_poll(spark.createDataFrame(rows, "host string, worker_id int, task_id long, start_ns long, end_ns long"))
    total = {r.severity: r.value for r in out.filter("subject = 'total'").collect()}
    assert total == {"critical": 7.0, "warning": 1.0} and out.count() == 5 + 1 + 2
