"""SimHash near-duplicates by the generalised pigeonhole principle (operator 3).

A document's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles. Distinct fingerprints link
at ``radius`` differing bits or fewer. The 64 bits are grouped into ``PARTS`` partitions such that correlated bits fall together.
If two fingerprints differ in at most r bits, then for any thresholds t_1..t_m with sum r - m + 1, they differ in at most t_i bits
within some partition i (t_i = -1: this partition is not probed). Each fingerprint takes the thresholds, found by dynamic
programming, that cost it the fewest probes and candidates, given how many fingerprints lie within each distance of its own value
in each partition. Those counts are exact: a partition of 16 bits has 65,536 values, so its histogram over all fingerprints has a
fixed size. Probes meet the index rows of their value, candidates are verified in place, and links leave as spanning edges, so that a
group of near copies never becomes all its pairs. The index of a value that very many fingerprints share is split into a grid of
blocks, each checked by a task of its own.

Cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; copies share a fingerprint and cost one row; equal or null doc_ids keep their rows (a component of null ids only has a null
id); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps, stored
from spoor.llm.components import components, spanning

SHINGLE, SEED, RADIUS, PARTS = 3, 42, 3, 4
#: Index rows of one value that a task takes at once; pairs it compares at once.
BLOCK, PAIRS = 8192, 1 << 21
#: What shuffling a probe costs, in candidates verified.
PROBE_COST = 16.0


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprints from each document's hashes."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (hash of the text), fp of every row; written, as later steps read it again and again."""

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            fp = majority([shingle_hashes(t, size) for t in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return stored(rows.mapInArrow(prints, "doc_id bigint, text_key bigint, fp bigint"), "fingerprints")


def bit_counts(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all distinct fingerprints (64 x 64), and their number."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    cells = dict(distinct.select("fp").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect())
    return np.array([cells.get(i, 0) for i in range(4096)], np.float64).reshape(64, 64), int(cells.get(4096, 0))


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in groups of equal size, correlated ones together: each group grows from its most correlated pair."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(c, -1)
    free, out = list(range(64)), []
    for _ in range(parts):
        sub = c[np.ix_(free, free)]
        first = free[int(sub.max(1).argmax())]
        group = [first]
        while len(group) < 64 // parts:
            rest = [b for b in free if b not in group]
            group.append(rest[int(c[np.ix_(rest, group)].sum(1).argmax())])
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Value of each fingerprint in each partition (partitions x fingerprints)."""
    u = fp.view(np.uint64)
    out = np.zeros((len(groups), len(fp)), np.int64)
    for i, bits in enumerate(groups):
        for k, b in enumerate(bits):
            out[i] |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def value_histogram(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Fingerprints with each value in each partition: partitions x 2**width numbers, whatever the size of the input."""
    size = 1 << len(groups[0])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups) * size, np.int64)
        for batch in batches:
            for i, v in enumerate(part_values(batch.column(0).to_numpy(), groups)):
                total[i * size:(i + 1) * size] += np.bincount(v, minlength=size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(groups) * size, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(len(groups), size)


def within(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """For each partition, distance 0..most and value: fingerprints within that distance in the partition."""

    def flipped(x: np.ndarray) -> np.ndarray:
        at = np.arange(x.shape[1])
        return sum(x[:, at ^ (1 << b)] for b in range(width))

    shells = [histogram, flipped(histogram)]
    for k in range(1, most):  # one flip leads one shell out or in
        shells.append((flipped(shells[k]) - (width - k + 1) * shells[k - 1]) // (k + 1))
    return np.cumsum(np.stack(shells[:most + 1], 1), 1)


def allocate(values: np.ndarray, counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """Thresholds (partitions x fingerprints, -1 and up) of least cost whose sum is radius - partitions + 1, by dynamic programming."""
    m, n = values.shape
    probes = np.cumsum([1] + [_choose(width, k) for k in range(1, radius + 1)])
    goal = radius - m + 1
    states = range(-m, radius + 1)
    best = {0: np.zeros(n)}
    choice: list[dict[int, np.ndarray]] = []
    for i in range(m):
        cost = np.stack([np.zeros(n)] + [counts[i, t, values[i]] + PROBE_COST * probes[t] for t in range(radius + 1)])
        nxt, took = {}, {}
        for s in states:
            for t in range(-1, radius + 1):
                if s - t in best:
                    c = best[s - t] + cost[t + 1]
                    if s not in nxt:
                        nxt[s], took[s] = c, np.full(n, t, np.int8)
                    else:
                        better = c < nxt[s]
                        nxt[s] = np.where(better, c, nxt[s])
                        took[s][better] = t
        best = nxt
        choice.append(took)
    out = np.empty((m, n), np.int64)
    state = np.full(n, goal)
    for i in range(m - 1, -1, -1):
        for s, took in choice[i].items():
            here = state == s
            out[i, here] = took[here]
        state = state - out[i]
    return out


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def masks(width: int, radius: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, .. radius bits."""
    from itertools import combinations

    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], np.int64) for k in range(radius + 1)]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Edges a, b that connect the distinct fingerprints within ``radius`` of each other, directly or through others."""
    together, n = bit_counts(distinct)
    groups = correlated_parts(together, n, parts)
    width = 64 // parts
    histogram = value_histogram(distinct, groups)
    sent = distinct.sparkSession.sparkContext.broadcast((groups, histogram))  # of fixed size

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, histogram = sent.value
        counts, near = within(histogram, width, radius), masks(width, radius)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            values = part_values(fp, groups)
            take = allocate(values, counts, width, radius)
            mixed = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            keys, prints, roles = [], [], []  # roles: 0 an index row, 1 a probe, 2 both
            for i in range(parts):
                index_rows = [(values[i], np.arange(len(fp)), take[i] >= 0)]
                for k in range(1, int(take[i].max(initial=0)) + 1):
                    own = np.flatnonzero(take[i] >= k)
                    index_rows.append(((values[i, own][:, None] ^ near[k]).ravel(), np.repeat(own, len(near[k])), None))
                for value, own, both in index_rows:
                    grid = -(-histogram[i, value] // BLOCK)
                    small = grid <= 1
                    if both is not None:
                        keys.append(_key(i, value[small], 0))
                        prints.append(fp[own[small]])
                        roles.append(np.where(both[small], 2, 0))
                        own, value, grid, both = own[~small], value[~small], grid[~small], both[~small]
                        row = (mixed[own] % np.maximum(grid, 1).astype(np.uint64)).astype(np.int64)
                        for j in range(int(grid.max(initial=0))):  # an index block meets every probe block
                            on = grid > j
                            keys.append(_key(i, value[on], row[on] * grid[on] + j))
                            prints.append(fp[own[on]])
                            roles.append(np.zeros(int(on.sum()), np.int64))
                        own, value, grid = own[both], value[both], grid[both]
                    else:
                        live = small & (grid > 0)  # nothing has the other values
                        keys.append(_key(i, value[live], 0))
                        prints.append(fp[own[live]])
                        roles.append(np.ones(int(live.sum()), np.int64))
                        own, value, grid = own[~small], value[~small], grid[~small]
                    column = ((mixed[own] >> np.uint64(12)) % np.maximum(grid, 1).astype(np.uint64)).astype(np.int64)
                    for j in range(int(grid.max(initial=0))):
                        on = grid > j
                        keys.append(_key(i, value[on], j * grid[on] + column[on]))
                        prints.append(fp[own[on]])
                        roles.append(np.ones(int(on.sum()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(prints)), pa.array(np.concatenate(roles).astype(np.int8))], ["key", "fp", "role"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8))
        for batch in batches:
            held = tuple(np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield from _checked(*(h[:cut] for h in held), radius)
                held = tuple(h[cut:] for h in held)
        yield from _checked(*held, radius)

    rows = distinct.select("fp").mapInArrow(deal, "key bigint, fp bigint, role tinyint")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint")


def _key(part: int, value: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    return (np.int64(part) << 60) | (value << 36) | block


def _checked(key: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Compare probes with the index rows of their key; rows are sorted by key."""
    index, probe = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    if not len(index) or not len(probe):
        return
    own = key[index]
    first, stop = np.searchsorted(own, key[probe], "left"), np.searchsorted(own, key[probe], "right")
    many = stop - first
    probe, first, many = (x[many > 0] for x in (probe, first, many))
    ends = np.cumsum(many)
    a = 0
    while a < len(probe):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = many[a:b]
        at = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x, y = np.repeat(fp[probe[a:b]], n), fp[index[at]]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= radius) & (x != y)
        if near.any():
            left, right = spanning(x[near], y[near])
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])
        a = b


def simhash_components(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, root (a component's smallest fingerprint), fingerprint (16 hex digits), component_id of every row of ``docs(doc_id, text)``."""
    base = fingerprints(docs, size)
    distinct = stored(base.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "root", "component_id")
    return base.join(known, "fp").select("doc_id", "text_key", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
