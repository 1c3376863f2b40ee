"""Benchmark decontamination by a distributed positional inverted index (operator 13).

The index is a table of segments. A segment holds the postings of some documents, all that one task read in one step: its
distinct words, how often each occurs, and for each word the places where it stands, as differences in byte planes under zstandard.
Places count through all documents of a segment, with a gap between two that no phrase can bridge.

A search sends distinct phrases to the segments in blocks of bounded size, one pass over the index a block. Within a segment
a phrase is dropped if it has a word that the segment lacks. The rarest word's list gives the candidates for the
phrase's start; each further list, in order of size, is intersected with them, shifted by the word's offset. Lists of all phrases are
intersected at once, by binary search in the segment's (word, place) pairs. With ``slop`` s a word may stand up to s places to
either side of where the phrase has it (a proximity match); with 0 the match is the exact phrase.

Cases: null texts and texts without words have no postings and no matches, such an item none either; repeated rows are indexed and answered row by
row; a null item_id counts as one item with an empty name, equal item_ids as one item; words over ``LONGEST`` bytes are indexed by
their SHA-256; documents of any length are indexed whole; an empty table gives no rows or no matches; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spoor.llm.common import partition_id, steps, stored

WINDOW = 10
#: Places between documents of a segment: more than a phrase and its slop span.
GAP = 64
#: Characters of a segment's documents, at least one document each; bytes of a word that is indexed as it is.
SEGMENT_CHARS, LONGEST = 2_000_000, 64
#: Rows (phrase, item) sent to the segments at once; each holds ``WINDOW`` words of ``LONGEST`` bytes at most.
BLOCK_ROWS = 50_000
SEGMENT = "segment bigint, doc_ids array<bigint>, n_words array<int>, words binary, sizes binary, places binary"
HITS = "segment bigint, place int, items array<string>, spans array<struct<start: int, end: int>>"


def byte_table() -> bytes:
    """Lower-cases A-Z and turns every byte that is no letter, digit or part of a character beyond ASCII into a space."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in keep else 32 for c in range(256))


TABLE = byte_table()


def words_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").translate(TABLE).split()
    return [w if len(w) <= LONGEST else b"." + hashlib.sha256(w).hexdigest().encode() for w in words] if len(text) > LONGEST else words


class Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def document_starts(n_words: np.ndarray) -> np.ndarray:
    """First place of each document of a segment."""
    return np.cumsum(n_words + GAP) - n_words - GAP


def index_segments(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The index of ``docs(doc_id, text)``, written to the shared folder: one row a segment."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, (batch, texts) in enumerate(steps(batches, limit=segment_chars)):
            split = [words_of(t) for t in texts]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            numbers = Numbers()
            word = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(n_words.sum()))
            place = np.arange(len(word)) + np.repeat(GAP * np.arange(len(split)), n_words)
            if len(place) and place[-1] >> 32:
                raise ValueError("a document has more words than a segment can number")
            order = np.argsort(word, kind="stable")
            sizes, listed = np.bincount(word, minlength=len(numbers)), place[order]
            deltas = np.diff(listed, prepend=0)
            heads = np.cumsum(sizes) - sizes
            deltas[heads] = listed[heads]  # each list begins with a place, not a difference
            row = [(partition_id() << 32) + at, batch.column(0).to_pylist(), n_words.tolist(),
                   zstandard.ZstdCompressor(level=1).compress(b" ".join(numbers)), packed(sizes), packed(deltas)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    names = [c.split()[0] for c in SEGMENT.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, SEGMENT)
    return stored(rows, "positions")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (phrase, item) of ``items(item_id, text)``: all runs of ``window`` words, or all words of an item that has fewer."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            for item, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = words_of(text)
                runs = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(list(runs), pa.binary()), pa.array([item] * len(runs), pa.string())], ["phrase", "item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(cut, "phrase binary, item string")
    return stored(rows.distinct().sort("phrase", "item"), "phrases")


class Block(NamedTuple):
    """Phrases to search for: the words they use, word numbers of each phrase (-1 beyond its end), and the items of each phrase."""

    words: dict[bytes, int]
    grid: np.ndarray
    items: list[list[str]]


def block_of(rows: list[Row], window: int) -> Block:
    words, grid, items = Numbers(), [], []
    for phrase, group in itertools.groupby(rows, lambda r: bytes(r["phrase"])):
        own = [words[w] for w in phrase.split(b" ")]
        grid.append(own + [-1] * (window - len(own)))
        items.append([r["item"] for r in group])
    return Block(dict(words), np.array(grid, np.int64).reshape(-1, window), items)


def occurrences(block: Block, words: list[bytes], sizes: np.ndarray, places: bytes, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and start of every match in one segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.fromiter((block.words.get(w, -1) for w in words), np.int64, len(words))
    found = np.flatnonzero(here >= 0)
    local = np.full(len(block.words) + 1, -1, np.int64)  # the last one stands for "beyond the end"
    local[here[found]] = found
    grid = local[block.grid]
    length = (block.grid >= 0).sum(1)
    used = np.arange(grid.shape[1]) < length[:, None]
    phrase = np.flatnonzero(((grid >= 0) | ~used).all(1))
    if not len(phrase):
        return none
    grid, length, used = grid[phrase], length[phrase], used[phrase]
    # word by word from the rarest: its number and its offset in the phrase
    size = np.where(used, sizes[np.where(used, grid, 0)], np.iinfo(np.int64).max)
    offset = np.argsort(size, axis=1, kind="stable")
    grid = np.take_along_axis(grid, offset, 1)
    heads, listed = np.cumsum(sizes) - sizes, unpacked(places)
    before = np.cumsum(listed)
    listed = before - np.repeat(before[heads] - listed[heads], sizes)
    key = (np.repeat(np.arange(len(sizes)), sizes) << 32) + listed
    n = sizes[grid[:, 0]]
    which = np.repeat(np.arange(len(phrase)), n)
    at = listed[np.repeat(heads[grid[:, 0]], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)] - offset[which, 0]
    if slop:
        which, at = np.repeat(which, 2 * slop + 1), (at[:, None] + np.arange(-slop, slop + 1)).ravel()
    for k in range(1, grid.shape[1]):
        more = length[which] > k
        if not more.any():
            break
        w, low = which[more], at[more] + offset[which[more], k] - slop
        base = grid[w, k] << 32
        first = np.minimum(np.searchsorted(key, base + np.maximum(low, 0)), len(key) - 1)
        there = ~more
        there[more] = (key[first] >= base + np.maximum(low, 0)) & (key[first] <= base + low + 2 * slop)
        which, at = which[there], at[there]
    return phrase[which], at


def search(segments: DataFrame, wanted: DataFrame, window: int = WINDOW, slop: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """segment, place (of the document in its segment), items, spans (merged runs of words inside matches) of every document that has a match
    of one of the phrases ``wanted(phrase, item)``, as :func:`phrases` gives them."""
    if window + 2 * slop >= GAP:
        raise ValueError(f"a phrase with its slop must span less than {GAP} words")
    spark = segments.sparkSession
    out = spark.createDataFrame([], HITS)
    rows = wanted.toLocalIterator()
    while taken := list(itertools.islice(rows, block_rows)):
        out = out.union(segments.mapInArrow(searcher(spark.sparkContext.broadcast(block_of(taken, window)), slop), HITS))
    return out.groupBy("segment", "place").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                               F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def searcher(sent, slop: int):
    """The pass over segments for one block of phrases."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        length = (block.grid >= 0).sum(1)
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                words = opened.decompress(row["words"]).split()
                if not words:
                    continue
                phrase, at = occurrences(block, words, unpacked(row["sizes"]), row["places"], slop)
                if not len(phrase):
                    continue
                n_words = np.array(row["n_words"], np.int64)
                starts = document_starts(n_words)
                low, high = at - slop, at + length[phrase] + slop
                doc = np.searchsorted(starts, at + slop, "right") - 1  # every word of a match stands in one document
                low, high = np.maximum(low, starts[doc]), np.minimum(high, (starts + n_words)[doc])
                yield pa.RecordBatch.from_pylist([
                    {"segment": row["segment"], "place": int(d), "items": items, "spans": spans} for d, items, spans in
                    grouped(doc, phrase, low - starts[doc], high - starts[doc], block.items)], schema)

    schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    return scan


def grouped(doc: np.ndarray, phrase: np.ndarray, low: np.ndarray, high: np.ndarray, items: list[list[str]]) -> Iterator[tuple[int, list[str], list[dict]]]:
    """For each document with matches: its items and the merged runs of words that matches cover."""
    order = np.lexsort((low, doc))
    doc, phrase, low, high = doc[order], phrase[order], low[order], high[order]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        reach = np.maximum.accumulate(high[a:b])
        new = np.concatenate([[True], low[a + 1:b] > reach[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], b - a) - 1
        spans = [{"start": s, "end": e} for s, e in zip(low[a:b][first].tolist(), reach[last].tolist(), strict=True)]
        yield doc[a], sorted({i for p in np.unique(phrase[a:b]).tolist() for i in items[p]}), spans


def matched_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, segment_chars: int = SEGMENT_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_hit (words inside matches), items (sorted), spans (start, end in words)."""
    segments = index_segments(docs, segment_chars)
    hits = search(segments, phrases(items, window), window, slop, block_rows)
    rows = segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                          lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
                                                  F.greatest(acc["end"], s["end"]).alias("end")), lambda acc: acc["n"])
    joined = rows.join(hits, ["segment", "place"], "left")
    return joined.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"),
                         F.coalesce(F.when(F.size("spans") > 0, covered), F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"), "spans")
