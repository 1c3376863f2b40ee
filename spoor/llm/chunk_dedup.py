"""Substring deduplication by content-defined chunks (operator 10).

A gear hash rolls over each text's UTF-8 bytes; a chunk begins at a word where the hash of the 16 bytes before it falls below a
threshold, on average every ``MEAN_WORDS`` words. Cuts depend on nearby bytes only, so an insertion moves none beyond it, and a passage
is cut alike wherever it stands. Stretches without white space (Chinese, Japanese or Thai text, for one) are cut between characters too after their first 64
bytes, on average every ``MEAN_WORDS * WORD_BYTES`` bytes, and every ``WORD_BYTES`` bytes there count as a word. At every chunk a window
begins: as many chunks as hold ``MIN_WORDS`` words together. Windows are deduplicated by digest: the occurrence with the smallest
(doc_id, place) stays, the others are removed. So only what an earlier place has in one piece, of ``MIN_WORDS`` words and more, is
cut; shorter repeats never touch a text, however many there are. Every word that goes has a copy that stays: its counterpart
in the earlier window, or that one's, and so on.

A digest that very many documents have is combined in each batch: later occurrences are settled there, and a single one goes on to meet
those of other batches.

Cases: a null text stays null and an empty one empty; rows equal in doc_id and text count as one document and fare alike; a null
doc_id sorts first; a document that repeats as a whole keeps an empty text; an empty table gives no rows; extra columns are kept by
``without_repeats``; texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps
from spoor.llm.stages import NO_ID, keyed

MEAN_WORDS, MIN_WORDS = 4, 20
WINDOW = 16
#: What counts as a word where there is no white space, in bytes.
WORD_BYTES = 6
_ROW = "doc_id bigint, text_key bigint, pos bigint, size int, digest bigint, settled boolean, first_doc bigint"


def gear_table() -> np.ndarray:
    table = np.random.default_rng(2024).integers(0, 1 << 16, 256, dtype=np.uint16)
    table[0] = 0
    return table


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + table[raw[i]] in 16 bits, for all places at once: older bytes have been shifted out."""
    g = gear_table()[raw]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint16(k)
    return h


def chunk_starts(texts: list[bytes], mean_words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined with gaps, and for every chunk its document, start and end in there."""
    return _chunks(texts, mean_words)[:4]


def _chunks(texts: list[bytes], mean_words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``chunk_starts``, and the words that begin before each place, in units of ``1 / WORD_BYTES``."""
    gap = b"\0" * WINDOW
    joined = gap + gap.join(texts) + gap
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = WINDOW + np.cumsum(sizes + WINDOW) - (sizes + WINDOW)
    raw = np.frombuffer(joined, np.uint8)
    h = gear(raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    place = np.arange(len(raw), dtype=np.int64)
    since = place - np.maximum.accumulate(np.where(space | (raw == 0), place, 0))
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (space[:-1] & ~space[1:] & (h[:-1] < 65536 // mean_words)) | ((since[:-1] > 64) & (h[:-1] < 65536 // (mean_words * WORD_BYTES)) & ((raw[1:] & 0xC0) != 0x80))
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + sizes, -1)
    cut &= np.cumsum(inside, dtype=np.int32) > 0
    cut[begins[sizes > 0]] = True
    starts = np.flatnonzero(cut)
    doc = np.searchsorted(begins, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), (begins + sizes)[doc])
    begin = np.zeros(len(raw), bool)
    begin[1:] = space[:-1] & ~space[1:]
    begin[begins[sizes > 0]] = ~space[begins[sizes > 0]]
    size = begin * np.int64(WORD_BYTES) + (since > 64)  # further bytes of a stretch count one by one
    return joined, doc, starts, ends, np.concatenate([[0], np.cumsum(size)])


def windows(texts: list[bytes], mean_words: int, min_words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined with gaps, and for every window its document, start and end in there: from each chunk on, the fewest chunks of
    that document in which ``min_words`` words (or as much without white space) begin. The last chunks of a text may be too few for one."""
    joined, doc, starts, ends, words = _chunks(texts, mean_words)
    last = np.searchsorted(words[ends], words[starts] + min_words * WORD_BYTES)
    whole = last < len(starts)
    whole[whole] = doc[last[whole]] == doc[whole]
    return joined, doc[whole], starts[whole], ends[last[whole]]


def repeated_windows(docs: DataFrame, mean_words: int = MEAN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows that are not the first of their digest: doc_id, text_key, pos, size (bytes), first_doc (a document that has it earlier)."""

    def chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, limit=2_000_000):
            raw = [t.encode("utf-8", "replace") for t in texts]
            joined, doc, starts, ends = windows(raw, mean_words, min_words)
            if not len(starts):
                continue
            digest = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            text_keys = batch.column(2).to_numpy()
            by_doc = np.lexsort((text_keys, ids))
            rank = np.zeros(len(ids), np.int64)  # equal rows are one document and share a rank
            rank[by_doc[1:]] = np.cumsum((np.diff(ids[by_doc]) != 0) | (np.diff(text_keys[by_doc]) != 0))
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + WINDOW
            pos = starts - (np.cumsum(sizes) - sizes + WINDOW)[doc]
            order = np.lexsort((pos, rank[doc], digest))
            later = digest[order[1:]] == digest[order[:-1]]
            settled = np.zeros(len(order), bool)
            settled[order[1:]] = later
            whole = np.ones(len(order), bool)
            whole[order[1:]] = ~(later & (np.diff(rank[doc[order]]) == 0) & (np.diff(pos[order]) == 0))  # a window of equal rows leaves once
            starts_group = np.maximum.accumulate(np.where(np.concatenate([[True], ~later]), np.arange(len(order)), 0))
            first = np.empty(len(order), np.int64)
            first[order] = ids[doc[order[starts_group]]]
            out = pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(text_keys[doc]), pa.array(pos), pa.array((ends - starts).astype(np.int32)), pa.array(digest), pa.array(settled),
                                              pa.array(first, mask=~settled)], names)
            yield out if whole.all() else out.filter(pa.array(whole))

    def later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_digest = last_owner = last_row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, text_keys, pos, digest = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            settled = batch.column(5).to_numpy(zero_copy_only=False)
            out = settled.copy()
            first_doc = batch.column(6).fill_null(0).to_numpy().copy()
            open_ = np.flatnonzero(~settled)
            if len(open_):
                d = digest[open_]
                first = np.concatenate([[last_digest is None or d[0] != last_digest], d[1:] != d[:-1]])
                at = np.maximum.accumulate(np.where(first, np.arange(len(d)), -1))
                own = np.stack([ids[open_], text_keys[open_], pos[open_]], 1)
                owner = own[np.maximum(at, 0)]
                if at[0] < 0:
                    owner[at < 0] = last_owner
                out[open_] = (own != owner).any(1)
                first_doc[open_] = owner[:, 0]
                last_digest, last_owner = d[-1], owner[-1]
            # copies of a row from several batches lie side by side; the first stands for all
            row = np.stack([settled, digest, ids, text_keys, pos], 1)
            again = np.empty(len(row), bool)
            again[0] = last_row is not None and (row[0] == last_row).all()
            again[1:] = (row[1:] == row[:-1]).all(1)
            last_row = row[-1]
            keep = pa.array(out & ~again)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(keep) for i in range(4)), pa.array(first_doc).filter(keep)], [*names[:4], "first_doc"])

    names = [c.split()[0] for c in _ROW.split(", ")]
    rows = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(chunk, _ROW)
    spread = rows.withColumn("_to", F.when(F.col("settled"), F.xxhash64("doc_id", "pos")).otherwise(F.col("digest"))).repartition("_to").drop("_to")
    return (spread.sortWithinPartitions("settled", "digest", "doc_id", "text_key", "pos", "first_doc")
            .mapInArrow(later, "doc_id bigint, text_key bigint, pos bigint, size int, first_doc bigint"))


def runs(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Windows (pos, size, first_doc), joined where they touch to (start, end, first_doc of the first)."""
    out: list[tuple[int, int, int]] = []
    for pos, size, doc in sorted(set(places)):
        if out and pos <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], pos + size), out[-1][2])
        else:
            out.append((pos, pos + size, doc))
    return out


def without_repeats(docs: DataFrame, mean_words: int = MEAN_WORDS, min_words: int = MIN_WORDS, spans: str = "repeats") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and a column ``spans``: what was cut, as (start, size) in bytes of the old
    text and first_doc, a document that has its first ``min_words`` words earlier (null where that has no doc_id). A column of that name in ``docs`` is replaced."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                drop: list[dict] = []
                if text is not None and places:
                    raw, at, parts = text.encode("utf-8", "replace"), 0, []
                    for a, b, doc in runs([(p["pos"], p["size"], p["first_doc"]) for p in places]):
                        parts.append(raw[at:a])
                        drop.append({"start": a, "size": b - a, "first_doc": None if doc == NO_ID else doc})
                        at = b
                    text = (b"".join(parts) + raw[at:]).decode("utf-8", "replace")
                texts.append(text)
                found.append(drop)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, kind), batch.column(2)], ["text", "cut", "row"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("first_doc", pa.int64())]))
    dups = (repeated_windows(docs.select("doc_id", "text"), mean_words, min_words).groupBy(F.col("doc_id").alias("doc"), F.col("text_key").alias("key"))
            .agg(F.collect_list(F.struct("pos", "size", "first_doc")).alias("places")))
    # all other columns travel in one, so that no name can clash
    others = [c for c in docs.columns if c not in ("text", spans)]
    rows = keyed(docs).select("doc", "key", F.col("row.text").alias("text"), F.struct(*(F.col(f"row.`{c}`") for c in others)).alias("row"))
    joined = rows.join(dups, ["doc", "key"], "left").select("text", "places", "row")
    done = joined.mapInArrow(cut, f"text string, cut array<struct<start: bigint, size: bigint, first_doc: bigint>>, row {joined.schema['row'].dataType.simpleString()}")
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != spans), F.col("cut").alias(spans))
