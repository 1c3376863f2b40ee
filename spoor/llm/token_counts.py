"""Token counts of documents of any length by overlap resynchronisation (operator 7).

A text of at most ``chunk_chars`` characters is counted where it is read. A longer one is cut into chunks that overlap; equal
chunks meet once, spread over the cluster, and are encoded with offsets. Neighbours are spliced at a boundary between
pre-tokens that both encodings have in the overlap. Such a boundary is proven stable:

* the pre-tokenizer scans left to right without looking behind, and merges never cross its cuts, so two scans that both stand at
  one place agree from there on;
* the left chunk's cuts are the document's own up to ``MARGIN`` characters before its end, since no rule looks further ahead, and
  no special string is longer.

By induction from the document's start every splice is exact. A document in which some overlap has no common boundary (a run of
letters longer than the overlap, say) goes round again with an overlap eight times as wide, until one chunk holds it whole.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and equal or null doc_ids are counted row by row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps, stored
from spoor.llm.units import encoder

CHUNK_CHARS, OVERLAP = 1 << 15, 512
#: Longest special string of the vocabularies, and more than any rule of the pre-tokenizer looks ahead.
MARGIN = 16
_PART = "digest binary, chunk int, n_chunks int, head array<struct<at: bigint, before: bigint>>, tail array<struct<at: bigint, before: bigint>>, n bigint"


def cuts(library, text: str) -> tuple[list[int], list[int], int]:
    """Places between pre-tokens (the start included), tokens before each, and tokens in all."""
    found = library.encode(text, add_special_tokens=False)
    words, offsets = found.word_ids, found.offsets
    at, before, last = [], [], object()
    for i, (word, (start, _)) in enumerate(zip(words, offsets, strict=True)):
        if word is None or word != last:  # an added string stands alone
            if not at or start > at[-1]:
                at.append(start)
                before.append(i)
        last = word if word is not None else object()
    return at, before, len(words)


def splice(parts: list) -> int | None:
    """Tokens of a document from its chunks in order; None where two neighbours share no boundary."""
    total, begin = 0, 0
    for left, right in zip(parts, parts[1:], strict=False):
        heads = {x["at"]: x["before"] for x in right["head"]}
        common = next((x for x in left["tail"] if x["at"] in heads), None)
        if common is None:
            return None
        total += common["before"] - begin
        begin = heads[common["at"]]
    return total + parts[-1]["n"] - begin


def count_chunked(texts: DataFrame, tokenizer: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``texts(digest, text)``, equal ones perhaps many times: digest, n_tokens (null where an overlap was too narrow)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in steps(batches):
            for digest, text in zip(batch.column(0).to_pylist(), whole, strict=True):
                n = max(1, -(-max(0, len(text) - overlap) // chunk_chars))
                for i in range(n):
                    end = len(text) if i == n - 1 else (i + 1) * chunk_chars + overlap
                    yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([i], pa.int32()), pa.array([n], pa.int32()),
                                                      pa.array([text[i * chunk_chars:end]])], ["digest", "chunk", "n_chunks", "text"])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunks in steps(batches):
            out = []
            for digest, i, n, text in zip(*(batch.column(c).to_pylist() for c in range(3)), chunks, strict=True):
                base = i * chunk_chars
                at, before, tokens = cuts(encoder(tokenizer).library, text)
                places = [{"at": base + a, "before": b} for a, b in zip(at, before, strict=True)]
                head = [x for x in places if i and x["at"] < base + overlap]
                tail = [x for x in places if i < n - 1 and base + chunk_chars <= x["at"] <= base + len(text) - MARGIN]
                out.append({"digest": digest, "chunk": i, "n_chunks": n, "head": head, "tail": tail, "n": tokens})
            yield pa.RecordBatch.from_pylist(out, schema)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([splice(p) for p in batch.column(1).to_pylist()], pa.int64())], ["digest", "n_tokens"])

    place = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
    schema = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("head", place), ("tail", place), ("n", pa.int64())])
    chunks = texts.mapInArrow(cut, "digest binary, chunk int, n_chunks int, text string")
    parts = chunks.groupBy("digest", "chunk", "n_chunks").agg(F.first("text").alias("text")).mapInArrow(encode, _PART)
    return (parts.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("chunk", "head", "tail", "n"))).alias("parts"))
            .mapInArrow(join, "digest binary, n_tokens bigint"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs(doc_id, text)``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(encoder(tokenizer).count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    huge = F.length("text") > chunk_chars
    small = rows.where(~huge).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    long = rows.where(huge).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counted, pending = None, long.select("digest", "text")
    while True:
        done = stored(count_chunked(pending, tokenizer, chunk_chars, overlap), "token-counts")
        good = done.where("n_tokens IS NOT NULL")
        counted = good if counted is None else counted.union(good)
        failed = done.where("n_tokens IS NULL").select("digest")
        if failed.isEmpty():
            break
        overlap *= 8
        chunk_chars = max(chunk_chars, 2 * overlap)
        pending = long.select("digest", "text").join(failed, "digest", "left_semi")
    spliced = long.select("doc_id", "n_bytes", "digest").join(counted, "digest").select("doc_id", "n_bytes", "n_tokens")
    return small.union(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
