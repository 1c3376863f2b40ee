"""Token ids on disk as compressed bit planes (operator 1).

Documents are dealt into shards by ranges of ``doc_id`` and encoded in order. A shard's ids are cut into blocks of a fixed size;
a block is transposed into bit planes (plane b holds bit b of every id) or byte planes, and each plane is compressed with
zstandard by itself, so that the nearly constant high planes vanish. The data set is a folder with two Parquet tables, whose
commit protocol makes lost executors harmless:

* ``blocks``: shard, block, n_ids, plane_bytes (compressed size of each plane), payload (the planes, joined), and which documents
  have ids in the block: doc_ids, doc_ranks (order in the shard), doc_pieces (0 for a document's first piece), doc_counts;
* ``index``: the same without payload, with first_id, the place of the block's first id among the ids of all documents.

Cases: a null or empty text has the end id only; equal doc_ids are kept apart, ordered by text; a null doc_id comes first; an empty
table gives a data set without blocks; other columns are ignored; a document of any length spans as many blocks as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.llm.common import partition_id, shared_folder, steps
from spoor.llm.units import encoder, with_end

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = ("shard int, block int, n_ids int, plane_bytes array<int>, payload binary, doc_ids array<bigint>, doc_ranks array<bigint>, "
                "doc_pieces array<int>, doc_counts array<int>")


def to_planes(ids: np.ndarray, plane: str, id_bits: int) -> list[bytes]:
    """The planes of one block, least significant first."""
    if plane == "byte":
        return [((ids >> (8 * b)) & 0xFF).astype(np.uint8).tobytes() for b in range((id_bits + 7) // 8)]
    return [np.packbits((ids >> b) & 1).tobytes() for b in range(id_bits)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, raw in enumerate(planes):
        bits = np.frombuffer(raw, np.uint8)
        if plane == "byte":
            ids |= bits.astype(np.uint32) << np.uint32(8 * b)
        else:
            ids |= np.unpackbits(bits, count=n).astype(np.uint32) << np.uint32(b)
    return ids


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int, plane: str = "bit", id_bits: int = 16, block_ids: int = BLOCK_IDS,
                 level: int = 3) -> None:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order and write the data set at ``path``."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, rank, packer = partition_id(), 0, -1, zstandard.ZstdCompressor(level=level)
        parts: list[np.ndarray] = []
        held: list[tuple] = []  # (doc_id, rank, piece, count) of the open block
        room = block_ids

        def closed() -> pa.RecordBatch:
            nonlocal block, room, parts, held
            ids = np.concatenate(parts)
            planes = [packer.compress(p) for p in to_planes(ids, plane, id_bits)]
            row = [shard, block, len(ids), [len(p) for p in planes], b"".join(planes), *map(list, zip(*held, strict=True))]
            block, room, parts, held = block + 1, block_ids, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch, texts in steps(batches):
            flat, counts = with_end(*encoder(tokenizer).encode(texts), end_id)
            if len(flat) and int(flat.max()) >> id_bits:
                raise ValueError(f"an id needs more than {id_bits} bits")
            at = 0
            for doc_id, count in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                rank, piece = rank + 1, 0
                while count:
                    take = min(count, room)
                    parts.append(flat[at:at + take])
                    held.append((doc_id, rank, piece, take))
                    at, count, room, piece = at + take, count - take, room - take, piece + 1
                    if not room:
                        yield closed()
        if held:
            yield closed()

    types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = _blocks(docs.sparkSession, path).drop("payload")
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    blocks.join(shard_starts(blocks), "shard").select("shard", "block", (F.col("shard_start") + within).alias("first_id"), "n_ids", "plane_bytes", "doc_ids",
                                                      "doc_ranks", "doc_pieces", "doc_counts").write.option("compression", "zstd").parquet(f"{path}/index")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row for each shard, which are as many as write tasks."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))


def read_pieces(spark: SparkSession, path: str, plane: str = "bit", ids: bool = True) -> DataFrame:
    """Each document's piece in each block: shard, rank, doc_id, piece, n, crc and, if asked for, the ids (little-endian, 32 bits)."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expander = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["plane_bytes"]).tolist()
                planes = [expander.decompress(row["payload"][e - n:e]) for e, n in zip(ends, row["plane_bytes"], strict=True)]
                raw = from_planes(planes, row["n_ids"], plane).astype("<u4").tobytes()
                stops = np.cumsum(row["doc_counts"]).tolist()
                pieces = [raw[4 * (e - n):4 * e] for e, n in zip(stops, row["doc_counts"], strict=True)]
                columns = [pa.array([row["shard"]] * len(pieces), pa.int32()), pa.array(row["doc_ranks"], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                           pa.array(row["doc_pieces"], pa.int32()), pa.array(row["doc_counts"], pa.int64()), pa.array(map(zlib.crc32, pieces), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * ids, names)

    schema = "shard int, rank bigint, doc_id bigint, piece int, n bigint, crc bigint" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    return _blocks(spark, path).select("shard", "n_ids", "plane_bytes", "payload", "doc_ids", "doc_ranks", "doc_pieces", "doc_counts").mapInArrow(unpack, schema)


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two strings joined, from theirs: appending zeros is a linear map over GF(2), applied by repeated squaring."""

    def apply(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        step = [apply(step, row) for row in step]
    while second_bytes:
        if second_bytes & 1:
            first = apply(step, first)
        step, second_bytes = [apply(step, row) for row in step], second_bytes >> 1
    return first ^ second


def read_documents(spark: SparkSession, path: str, plane: str = "bit") -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document. No payload is shuffled; pieces meet as checksums."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces in batch.column(2).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc32_joined(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), batch.column(3), batch.column(4)], names)

    names = ["shard", "doc_id", "ids_crc32", "rank", "n_tokens"]
    whole = (read_pieces(spark, path, plane, ids=False).groupBy("shard", "rank", "doc_id")
             .agg(F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"), F.sum("n").alias("n_tokens"))
             .select("shard", "doc_id", "pieces", "rank", "n_tokens").mapInArrow(join, "shard int, doc_id bigint, ids_crc32 bigint, rank bigint, n_tokens bigint"))
    index = spark.read.parquet(f"{path}/index").select("shard", "first_id", F.arrays_zip("doc_ranks", "doc_pieces", "doc_counts").alias("docs"))
    before = F.expr("transform(sequence(0, size(docs) - 1), i -> struct(docs[i].doc_ranks AS rank, docs[i].doc_pieces AS piece, "
                    "docs[i].doc_counts AS n))")
    # a document's start: ids before its block, and those before it in the block
    starts = (index.select("shard", "first_id", F.posexplode(before).alias("i", "d")).select("shard", "first_id", "i", "d.*")
              .withColumn("start", F.col("first_id") + F.sum("n").over(Window.partitionBy("shard", "first_id").orderBy("i")) - F.col("n"))
              .where("piece = 0").select("shard", "rank", "start"))
    return whole.join(starts, ["shard", "rank"]).select("doc_id", F.col("start").cast("long"), F.col("n_tokens").cast("long"), "ids_crc32")


def token_planes(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, plane: str = "bit") -> DataFrame:
    """Write the data set (by default to a new shared folder) and read every document's place and checksum back from it."""
    path = path or shared_folder(docs.sparkSession, "token-planes")
    write_planes(docs, path, tokenizer, end_id, plane)
    return read_documents(docs.sparkSession, path, plane)
