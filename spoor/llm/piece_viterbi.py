"""SentencePiece encoding and decoding by batched Viterbi search (operator 9).

Texts are cut into words where no piece of the vocabulary can cross: before each run of word marks, and between a letter and a punctuation
mark that follows no letter in any piece. Distinct words of equal length advance
together, one character at a time: for every end and every piece length, a polynomial hash of the substring, from prefix hashes, is
probed in the sorted keys of the pieces (and the characters compared), and the best predecessor of each word is kept as a
backpointer, for all words at once. Best means:

* unigram models: the largest sum of scores, the longest last piece among equals, as the library decides;
* pair-merging models: sums of scores do not give what merging gives, so a step from one piece to the next is allowed only if merging
  would leave the two side by side; exactly one path then reaches each place. Whether two pieces stay apart is read off the tree of
  merges that made each, undoing the later merge of the two again and again.

A character without a piece becomes its UTF-8 bytes. Words with two or more word marks in a row (whose pieces tie in rank) and words
of over ``LONGEST`` characters go through the library. Decoding joins the pieces' bytes.

Cases: a null or empty text has no pieces; equal texts are encoded alike; null or equal doc_ids keep their rows; an empty table gives no
rows; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps

MARK = "▁"
LONGEST = 128
#: Words remembered in a worker before it starts afresh; they only save time.
MOST_WORDS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNKNOWN = -2


class Pieces:
    """A vocabulary, its pieces numbered in the order in which merging makes them (single characters first)."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        if kind is not None:
            proto.trainer_spec.model_type = {"unigram": 1, "bpe": 2}[kind]
        self.unigram = proto.trainer_spec.model_type == 1
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        normal.sort(key=lambda p: (len(p[0]) > 1, -p[1], p[2]))
        self.texts = [p[0] for p in normal]
        self.scores = np.array([p[1] for p in normal], np.float64)
        self.ids = np.array([p[2] for p in normal], np.int64)
        self.unknown_score = self.scores.min() - 10
        by_text = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.bytes = [by_text[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else [proto.trainer_spec.unk_id] * 256
        self.raw = [p.piece.encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() for p in proto.pieces]
        self.crosses = any(MARK in t.lstrip(MARK) for t in self.texts)
        self.most = max(map(len, self.texts))
        self.codes = np.zeros((len(self.texts), self.most), np.uint32)
        self.lengths = np.array([len(t) for t in self.texts])
        for i, t in enumerate(self.texts):
            self.codes[i, :len(t)] = [ord(c) for c in t]
        # keys of pieces of each length, sorted, and the piece of each key
        self.keys, self.of_key = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for n in range(1, self.most + 1):
            at = np.flatnonzero(self.lengths == n)
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = key * _BASE + self.codes[at, k].astype(np.uint64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.of_key.append(at[order])
        # a hash may be a piece's only if its top bits are marked
        self.marked = np.zeros(1 << 20, bool)
        self.marked[np.concatenate(self.keys) >> np.uint64(44)] = True
        after = {b for t in self.texts for a, b in zip(t, t[1:], strict=False) if a.isalpha()}
        ends = "".join(re.escape(c) for c in _PUNCTUATION if c not in after)
        alone = "".join(c for c in "\n\t\r" if not any(c in t for t in self.texts))  # in no piece: cut before and after
        stop = f"[{ends}{MARK}{alone}]|\\Z"
        self.cut = re.compile((f"[{alone}]|" if alone else "") + f"{MARK}*[{_LETTERS}]+(?={stop})|{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self.lone = _LONE if not any(_LONE in t for t in self.texts) else None
        self.trees()
        flat = b"".join(self.raw)
        self.raw_flat = np.frombuffer(flat, np.uint8)
        self.raw_sizes = np.array([len(r) for r in self.raw])
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known, self.used = _Numbers(), 0, 0
        self.store, self.starts, self.sizes = np.empty(1 << 16, np.uint16), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    def trees(self) -> None:
        """Halves of each piece's last merge, pieces that merging never makes, and what each pair of pieces would merge to."""
        number = {t: i for i, t in enumerate(self.texts)}
        self.left, self.right = np.arange(len(self.texts)), np.arange(len(self.texts))
        self.made = np.ones(len(self.texts), bool)
        pairs = []
        for i, t in enumerate(self.texts):
            pairs += [(number[t[:k]], number[t[k:]], i) for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
            if len(t) == 1 or self.unigram:
                continue
            parts = [number.get(c, _UNKNOWN) for c in t]
            names = list(t)
            while len(parts) > 1:
                at = [number.get(a + b, len(number)) for a, b in zip(names, names[1:], strict=False)]
                k = min(range(len(at)), key=at.__getitem__)
                if at[k] == len(number):
                    break
                self.left[i], self.right[i] = parts[k], parts[k + 1]
                parts[k:k + 2], names[k:k + 2] = [at[k]], [names[k] + names[k + 1]]
            self.made[i] = parts == [i]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] * len(self.texts) + table[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], table[order, 2]
        self.pair_marked = np.zeros(1 << 22, bool)
        self.pair_marked[_slot(self.pair_keys)] = True

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make together; a number beyond all if none."""
        key = a * len(self.texts) + b
        out = np.full(len(a), len(self.texts))
        rows = np.flatnonzero(self.pair_marked[_slot(key)])
        at = np.minimum(np.searchsorted(self.pair_keys, key[rows]), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key[rows]
        out[rows[hit]] = self.pair_made[at[hit]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a and b side by side.

        At their border, pieces meet that a ends with and b begins with, as they stood before each later merge. If any two of them would
        merge before the merge that replaced one of them, a and b could not both have come about.
        """
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live].copy(), b[live].copy()
        limit = np.full(len(live), len(self.texts))
        while len(live):
            clash = self.merged(a, b) < limit
            out[live[clash]] = False
            right, left = self.right[a], self.left[b]
            can_a, can_b = right != a, left != b
            undo_a = can_a & ((a > b) | ~can_b)
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, right, a), np.where(undo_b, left, b)
            on = ~clash & (undo_a | undo_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return out

    def search(self, codes: np.ndarray) -> np.ndarray:
        """The last piece of the best path to each place (words x places), for words of equal length (words x characters)."""
        n_words, n = codes.shape
        prefix = np.zeros((n_words, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j].astype(np.uint64)
        powers = np.cumprod(np.array([1] + [_BASE] * self.most, np.uint64))
        last = np.full((n_words, n + 1), -1, np.int64)
        best = np.full((n_words, n + 1), -np.inf)
        best[:, 0] = 0
        for j in range(1, n + 1):
            single = np.zeros(n_words, bool)
            for size in range(min(j, self.most), 0, -1):
                i = j - size
                keys = self.keys[size]
                if not len(keys):
                    continue
                wanted = prefix[:, j] - prefix[:, i] * powers[size]
                rows = np.flatnonzero(self.marked[wanted >> np.uint64(44)])
                at = np.minimum(np.searchsorted(keys, wanted[rows]), len(keys) - 1)
                hit = keys[at] == wanted[rows]
                rows, at = rows[hit], at[hit]
                if not len(rows):
                    continue
                piece = self.of_key[size][at]
                same = (self.codes[piece, :size] == codes[rows, i:j]).all(1)
                rows, piece = rows[same], piece[same]
                if size == 1:
                    single[rows] = True
                if self.unigram:
                    score = best[rows, i] + self.scores[piece]
                    better = score > best[rows, j]
                else:
                    open_ = (last[rows, j] == -1) & self.made[piece]
                    rows, piece = rows[open_], piece[open_]
                    score, better = np.zeros(len(rows)), np.ones(len(rows), bool)
                    if i:
                        better = self.apart(last[rows, i], piece)
                last[rows[better], j], best[rows[better], j] = piece[better], score[better]
            lone = np.flatnonzero(~single)
            if len(lone):
                score = best[lone, j - 1] + self.unknown_score
                better = (score > best[lone, j]) if self.unigram else last[lone, j] == -1
                last[lone[better], j], best[lone[better], j] = _UNKNOWN, score[better] if self.unigram else 0
        return last

    def ids_of(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words."""
        out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(words)
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            if word.startswith(MARK * 2) or len(word) > LONGEST or self.crosses:
                out[i] = np.array(self._library_ids(word), np.uint16)
            else:
                by_length[len(word)].append(i)
        for n, group in by_length.items():
            for a in range(0, len(group), 8192):
                part = group[a:a + 8192]
                codes = np.array([words[i] for i in part]).view(np.uint32).reshape(len(part), n)
                last = self.search(codes)
                place, found = np.full(len(part), n), []
                rows = np.arange(len(part))
                while len(rows):  # follow the backpointers of all words
                    piece = last[rows, place[rows]]
                    found.append((rows, piece, place[rows]))
                    place[rows] -= np.where(piece >= 0, self.lengths[piece], 1)
                    rows = rows[place[rows] > 0]
                # pieces of each word in order: the last found come first
                row, piece, ends = (np.concatenate([f[k] for f in reversed(found)]) for k in range(3))
                order = np.argsort(row, kind="stable")
                row, piece, ends = row[order], piece[order], ends[order]
                ids = self.ids[piece].astype(np.uint16)
                stops = np.cumsum(np.bincount(row, minlength=len(part)))
                odd = set(row[piece < 0].tolist())  # words with a character that has no piece
                for k, (i, a_, b_) in enumerate(zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True)):
                    if k in odd:
                        out[i] = np.array([x for p, e, own in zip(piece[a_:b_].tolist(), ends[a_:b_].tolist(), ids[a_:b_].tolist(), strict=True)
                                           for x in ([own] if p >= 0 else [self.bytes[b] for b in chr(codes[k, e - 1]).encode("utf-8", "replace")])], np.uint16)
                    else:
                        out[i] = ids[a_:b_]
        return out

    def _library_ids(self, word: str) -> list[int]:
        """Ids of one word from the library, which puts a mark before what it is given."""
        if word.startswith(MARK):
            return self.library.encode(word[1:].replace(MARK, " "))
        if self.lone is None:
            raise ValueError("no character stands apart in this vocabulary")
        return self.library.encode(self.lone + word.replace(MARK, " "))[len(self.library.encode(self.lone)):]

    def _learn(self) -> None:
        """Ids of the words that have a number but no ids yet."""
        if (fresh := len(self.numbers) - self.known) <= 0:
            return
        found = self.ids_of(list(itertools.islice(self.numbers, self.known, None)))
        sizes = np.fromiter(map(len, found), np.int32, fresh)
        flat = np.concatenate(found)
        while len(self.store) < self.used + len(flat):
            self.store = np.concatenate([self.store, np.empty_like(self.store)])
        while len(self.sizes) < self.known + fresh:
            self.sizes, self.starts = (np.concatenate([x, np.empty_like(x)]) for x in (self.sizes, self.starts))
        self.store[self.used:self.used + len(flat)] = flat
        self.sizes[self.known:self.known + fresh] = sizes
        self.starts[self.known:self.known + fresh] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known += fresh

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, joined, and the number of ids of each text."""
        if len(self.numbers) > MOST_WORDS:
            self.clear()
        get, numbers, counts = self.numbers.__getitem__, [np.empty(0, np.int64)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                marked = MARK + text.replace(" ", MARK)
                words = [marked] if self.crosses else self.cut.findall(marked)
                counts[i] = len(words)
                numbers.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        number = np.concatenate(numbers)
        sizes = self.sizes[number].astype(np.int64)
        ends, stops = np.cumsum(sizes), np.cumsum(counts)
        flat = self.store[np.repeat(self.starts[number] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        sums = np.concatenate([[0], ends])
        return flat, sums[stops] - sums[stops - counts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, lengths = self.encode_flat(texts)
        return np.split(flat, np.cumsum(lengths)[:-1]) if texts else []

    def decode_flat(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of ids: pieces and bytes joined, marks as spaces, without the space put in front."""
        sizes = self.raw_sizes[flat]
        ends = np.cumsum(sizes)
        joined = self.raw_flat[np.repeat(self.raw_starts[flat] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum(lengths)].tolist()
        return [joined[a:b].decode("utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_flat(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * _BASE) >> np.uint64(42)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_LETTERS, _PUNCTUATION = "A-Za-zÀ-ÖØ-öø-ÿ", "\n!#$%&()*+,-./:;<=>?@[]^_{|}~"
#: A character for private use; it stands apart from what follows it.
_LONE = "\ue000"


@lru_cache(maxsize=2)
def pieces(path: str, kind: str | None = None) -> Pieces:
    return Pieces(path, kind)


def piece_ids(docs: DataFrame, model: str, ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text back), and with
    ``ids`` the ids themselves. A word mark that stands in a text itself is read as a space, as the library does."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch, texts in steps(batches):
            flat, lengths = own.encode_flat(texts)
            raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            wide = [raw[e - 4 * n:e] for e, n in zip(ends, lengths.tolist(), strict=True)]
            same = [x == t.replace(MARK, " ") for x, t in zip(own.decode_flat(flat, lengths), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(map(zlib.crc32, wide), pa.int64()), pa.array(same), *([pa.array(wide, pa.binary())] * ids)], names)

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
