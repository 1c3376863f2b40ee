"""Prefix tries: nodes told apart by chained ids, at any depth and with any characters in names."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from conftest import tuples
from spoor.operators import stacks
from spoor.plans import trie


def frames_table(spark, rows):
    return spark.createDataFrame([(list(reversed(path)), n) for path, n in rows], "frames array<string>, samples long")


def test_a_separator_inside_a_frame(spark):
    rows = [(("main", "a;b", "c"), 3), (("main", "a", "b", "c"), 5), (("main", "a;b"), 2), (("main;a", "b;c"), 7)]
    tree = stacks.flamegraph_tree(frames_table(spark, rows))
    got = Counter((r.name, r.depth, r.samples, r.self_samples, r.path) for r in tree.collect())
    assert got == Counter([("main", 1, 10, 0, "main"), ("a;b", 2, 5, 2, "main;a;b"), ("c", 3, 3, 3, "main;a;b;c"), ("a", 2, 5, 0, "main;a"), ("b", 3, 5, 0, "main;a;b"),
                           ("c", 4, 5, 5, "main;a;b;c"), ("main;a", 1, 7, 0, "main;a"), ("b;c", 2, 7, 7, "main;a;b;c")])
    assert tree.select("id").distinct().count() == 8
    merged = stacks.diff_join(frames_table(spark, rows[:2]), frames_table(spark, rows[1:]))
    assert sorted((r.path, r.a, r.b) for r in merged.collect()) == sorted([
        ("main", 8, 7), ("main;a;b", 3, 2), ("main;a;b;c", 3, 0), ("main;a", 5, 5), ("main;a;b", 5, 5), ("main;a;b;c", 5, 5), ("main;a", 0, 7), ("main;a;b;c", 0, 7)])
    sites = stacks.frame_search(frames_table(spark, rows), "c").filter("name = 'c'")
    assert tuples(sites, "total", "self", "sites") == [(8, 8, 2)]  # two paths whose text is the same


def test_deep_stacks(spark):
    """Stacks of 500 frames with shared beginnings: as many nodes as distinct prefixes, and offsets that add up along 500 levels."""
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        turn = rng.randrange(500)
        rows.append((tuple(f"f{i}" for i in range(turn)) + tuple(f"g{turn}_{i}" for i in range(500 - turn)), rng.randrange(1, 9)))
    prefixes = Counter()
    for path, n in rows:
        for d in range(1, len(path) + 1):
            prefixes[path[:d]] += n
    start = time.time()
    tree = stacks.flamegraph_tree(frames_table(spark, rows))
    got = {r.path: r for r in tree.collect()}
    assert {p: r.samples for p, r in got.items()} == {";".join(p): n for p, n in prefixes.items()}
    assert all((r.parent_path is None) == (r.depth == 1) and (r.parent_path is None or r.path == f"{r.parent_path};{r.name}") for r in got.values())
    total = sum(n for _, n in rows)
    children, x = {}, {None: 0}
    for p, n in sorted(prefixes.items(), key=lambda e: (-e[1], e[0][-1])):
        children.setdefault(p[:-1] or None, []).append((p, n))
    for p in sorted(prefixes, key=len):
        before = 0
        for q, n in children[p[:-1] or None]:
            if q == p:
                break
            before += n
        x[p] = x[p[:-1] or None] + before
    laid = {r.path: r.x for r in stacks.flat_layout(tree).collect()}
    assert {p: round(v * total) for p, v in laid.items()} == {";".join(p): x[p] for p in prefixes}
    assert time.time() - start < 120


def test_shuffles_carry_no_text_of_paths(spark):
    """The aggregate over nodes hashes an id, its parent's, a depth and one name; arrays of frames meet nodes by number only."""
    rows = frames_table(spark, [(("a", "b", "c"), 1), (("a", "b"), 2)])
    paths = trie.numbered_paths(rows, stacks.root_path(), ("samples",))
    plan = trie.prefix_tree(paths, ("samples",))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(keys) == 1 and "names" not in keys[0] and "parent_id" in keys[0]
    text = trie.with_text(trie.prefix_tree(paths, ("samples",)), paths)._jdf.queryExecution().executedPlan().toString()
    assert all("path" not in line.replace("path_no", "") for line in text.splitlines() if "Exchange" in line)


def test_empty_paths_and_nulls(spark):
    rows = spark.createDataFrame([([], 4), (None, 5), ([None, "a"], 1), (["", "a"], 2)], "frames array<string>, samples long")
    assert tuples(stacks.flamegraph_tree(rows), "path", "depth", "samples") == [("a", 1, 3), ("a;", 2, 3)]
    none = stacks.flamegraph_tree(rows.limit(0))
    assert none.count() == 0 and stacks.flat_layout(none).count() == 0
    assert trie.summed_to_top(rows.limit(0).select(F.lit("a").alias("id"), F.lit("a").alias("parent_id"), F.lit(1).alias("v")), "v").count() == 0
