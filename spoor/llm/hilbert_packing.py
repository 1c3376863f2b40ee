"""Training sequences packed along a space-filling curve (operator 4).

Every document's token ids are hashed into a vector, scaled to length one and projected to a few dimensions; the Hilbert index of
that point is its key, so documents of like content lie near each other on the curve. Documents are range-sorted by key (salted
with a hash of all columns but the text, so that equal texts spread over many ranges, also those without a doc_id), laid end to end along the curve, and
cut every ``seq_len`` ids. Ranges hold about equally many ids, ``RANGE_BYTES`` at most as far as ``MAX_RANGES`` goes; rows equal in all columns share one. Only the last sequence is short: it is cut into powers of two, which need no padding.

Cases: a null or empty text is the end id alone; equal doc_ids stay apart; a null doc_id is allowed; an empty table gives no
pieces; other columns are ignored; a long document runs through as many sequences as it needs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import partition_id, steps, stored
from spoor.llm.units import encoder, with_end

DIMS, BITS, BUCKETS = 3, 10, 256
#: Rows encoded to place the bounds between ranges, at least this many and so many a range; it changes how even they are, not the result's rules.
BOUND_SAMPLE, PER_RANGE = 4096, 16
#: Bytes of ids that a range is to hold, and the most ranges a shuffle is given: beyond them ranges grow, and their sort spills.
RANGE_BYTES, MAX_RANGES = 64 << 20, 20_000
_KEYED = "key bigint, range int, doc_id bigint, n bigint, ids binary"


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indexes of integer points (rows), by Gray-code transposition of all rows at once."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids."""
    bucket = ((flat.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.int64)
    keys = np.empty(len(counts), np.int64)
    ends = np.cumsum(counts)
    rows = 512
    project = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    for a in range(0, len(counts), rows):
        b = min(a + rows, len(counts))
        own = slice(ends[a] - counts[a], ends[b - 1])
        cell = np.repeat(np.arange(b - a), counts[a:b]) * BUCKETS + bucket[own]
        vectors = np.bincount(cell, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS).astype(np.float64)
        vectors /= np.sqrt((vectors ** 2).sum(1, keepdims=True))
        points = vectors @ project  # each coordinate is about normal: squash evenly into the grid
        grid = np.clip(((1 + np.tanh(0.8 * points)) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        keys[a:b] = hilbert_index(grid)
    return keys


def keyed(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int] | None = None) -> DataFrame:
    """key (curve position, then a hash of the other columns), range (bounds at or below the key), doc_id, n, ids (unsigned 16-bit, little-endian)."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            flat, counts = with_end(*encoder(tokenizer).encode(texts), end_id)
            salt = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
            raw, ends = flat.astype("<u2").tobytes(), (2 * np.cumsum(counts)).tolist()
            ids = [raw[e - 2 * n:e] for e, n in zip(ends, counts.tolist(), strict=True)]
            keys = (curve_keys(flat, counts) << 32) | salt
            own = np.searchsorted(np.array(bounds or [], np.int64), keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                                             ["key", "range", "doc_id", "n", "ids"])

    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]  # maps have no hash
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash(*hashed).alias("salt")).mapInArrow(encode, _KEYED)


def range_bounds(docs: DataFrame, tokenizer: str, end_id: int, least: int) -> list[int]:
    """Keys between ranges of about equally many ids, ``least`` ranges or as many as the ids need, from a sample of bounded expected size."""
    total, rows = docs.count(), BOUND_SAMPLE
    while total:
        sample = keyed(docs.sample(min(1.0, rows / total), seed=11), tokenizer, end_id).select("key", "n").toPandas().sort_values("key")
        if sample.empty:
            break
        ranges = min(MAX_RANGES, max(least, math.ceil(2 * sample["n"].mean() * total / RANGE_BYTES)))
        if rows < min(total, PER_RANGE * ranges):
            rows = PER_RANGE * ranges
            continue
        ends = sample["n"].cumsum().to_numpy()
        cuts = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges)
        return sorted(set(sample["key"].to_numpy()[cuts].tolist()))
    return []


def packed(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents laid along the curve: shard, shard_at (ids before it in the shard), doc_id, n, ids; written to shared storage."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = partition_id(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(starts, pa.int64()), *batch.columns], ["shard", "shard_at", "doc_id", "n", "ids"])

    spark = docs.sparkSession
    bounds = range_bounds(docs, tokenizer, end_id, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed(docs, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("range"))
    rows = rows.sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "n", "ids")
    return stored(rows.mapInArrow(place, "shard int, shard_at bigint, doc_id bigint, n bigint, ids binary"), "packed")


def tail_starts(total: int, seq_len: int) -> list[int]:
    """Starts of the sequences after the last full one: powers of two, largest first."""
    at, out = total - total % seq_len, []
    for b in range(seq_len.bit_length() - 1, -1, -1):
        if (total % seq_len) >> b & 1:
            out.append(at)
            at += 1 << b
    return out


def cut_sequences(laid: DataFrame, seq_len: int, ids: bool = False) -> DataFrame:
    """Pieces of the documents laid out by ``packed``: where each lies in its document and in which sequence, and its checksum."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + ids)]
            for doc_id, n, raw, begin, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                tail = tail_starts(total, seq_len)
                full = total // seq_len
                done = 0
                while done < n:
                    at = begin + done
                    if at < full * seq_len:
                        sequence = at // seq_len
                        first, stop = sequence * seq_len, (sequence + 1) * seq_len
                    else:
                        k = sum(t <= at for t in tail) - 1
                        sequence, first, stop = full + k, tail[k], [*tail, total][k + 1]
                    size = min(n - done, stop - at)
                    piece = wide[done:done + size].tobytes()
                    for column, value in zip(out, [doc_id, done, size, zlib.crc32(piece), n, sequence, at - first, *[piece] * ids], strict=True):
                        column.append(value)
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(out)], names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    totals = laid.groupBy("shard").agg(F.sum("n").alias("ids_in"))  # a row for each write task
    every = Window.partitionBy()
    starts = totals.select("shard", (F.sum("ids_in").over(every.orderBy("shard")) - F.col("ids_in")).alias("before"), F.sum("ids_in").over(every).alias("total"))
    rows = laid.join(starts, "shard").select("doc_id", "n", "ids", (F.col("before") + F.col("shard_at")).alias("begin"), "total")
    return rows.mapInArrow(cut, schema)


def hilbert_packing(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int = 2048, ids: bool = False) -> DataFrame:
    """One row for each piece; with ``ids`` also the piece's ids (little-endian, 32 bits)."""
    return cut_sequences(packed(docs, tokenizer, end_id), seq_len, ids)
