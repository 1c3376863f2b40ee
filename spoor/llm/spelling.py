"""Spelling variants by composing a vocabulary acceptor with a one-edit transducer and itself (operator 11).

Words are counted over all texts. The words that begin alike form a partition: those whose paths in the acceptor of the whole vocabulary
go through one state near the initial one. Each task builds the minimal acyclic acceptor of a partition's remaining letters, in which a
word's number follows from the arcs on its path, and walks the composition acceptor, one edit, acceptor. Before the edit both sides
are in the same state; the edit replaces a letter or drops one on one side; after it both sides read the same letters. Pairs of states
from which no common word is left are remembered and never entered twice. A pair of words is counted on both sides where it is found and
only counts and the best neighbour of each word leave the task.

Two words at one edit share at least the first or the last ``KEY`` of their six and more letters. Those with a longest common prefix of
``KEY`` letters or more are found among words that begin alike, the others among words that end alike (the same, on reversed words,
with fewer than ``KEY`` letters left after the edit). A pair that a drop at several places explains is counted at one of them only. A partition
of more than ``limit`` letters is split by one more letter; pairs whose edit falls on that letter meet by the place and what follows
it, in groups no larger than the alphabet. ``few`` words stay together whatever their length, so memory holds the states of that many.

Cases: null texts have no words and a null doc_id is hashed as an empty string; repeated rows count every time; words of any length are
handled without recursion; ties between forms go to the smallest word in code-point order; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps, stored

MIN_LETTERS, MIN_COUNT, RATIO, DROP = 6, 5, 5, 199
#: Letters that two words at one edit share at one end at least: half of the shortest.
KEY = MIN_LETTERS // 2
#: A partition of more letters and more words than these is split further.
LIMIT, FEW = 200_000, 100
NEAR = "word string, n bigint, n_near bigint, best_n bigint, best string"


def byte_table() -> bytes:
    """Latin-1 bytes: lower-cases A-Z, keeps a-z and U+00C0 to U+00FF, and turns all others into spaces."""
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 32 for c in range(256))


TABLE = byte_table()


def document_words(doc_id: int | None, text: str, drop: int = DROP, min_letters: int = MIN_LETTERS) -> Iterator[tuple[bytes, int]]:
    """The words of a text (Latin-1, ``min_letters`` letters and more) and how often they occur. If ``drop`` divides the crc32 of doc_id and word,
    one letter of the word is left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(text.encode("latin-1", "replace").translate(TABLE).split()).items():
        if len(word) >= min_letters:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if h % drop == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
                if len(word) < min_letters:
                    continue
            yield word, n


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of ``docs(doc_id, text)``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            seen: Counter[bytes] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for word, n in document_words(doc_id, text):
                    seen[word] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "vocabulary")


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words. ``arcs[state]`` maps a letter to its target and to the number of words that leave
    the state before that arc, so the sum along a word's path is its rank."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[tuple[str, int]], list[bool]]] = [([], [False])]  # open states of the last word: closed arcs, final
        last = ""

        def close(keep: int) -> None:
            while len(path) > keep + 1:
                arcs, final = path.pop()
                path[-1][0].append((last[len(path) - 1], self._state(known, arcs, final[0])))

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            path.extend(([], [False]) for _ in range(len(word) - shared))
            path[-1][1][0] = True
            last = word
        close(0)
        self.start = self._state(known, path[0][0], path[0][1][0])
        self._common: dict[tuple[int, int], bool] = {}

    def _state(self, known: dict, arcs: list[tuple[str, int]], final: bool) -> int:
        state = known.setdefault((final, *arcs), len(known))
        if state == len(self.arcs):
            out, size = {}, int(final)
            for letter, target in arcs:
                out[letter] = (target, size)
                size += self.size[target]
            self.arcs.append(out)
            self.final.append(final)
            self.size.append(size)
        return state

    def common(self, a: int, b: int) -> bool:
        """Whether some word leads from both states to an end."""
        known, stack = self._common, [(a, b)]
        while stack:
            pair = stack[-1]
            x, y = pair
            if pair in known:
                stack.pop()
            elif x == y or (self.final[x] and self.final[y]):
                known[pair] = True
            else:
                one, two, open_ = self.arcs[x], self.arcs[y], None
                for letter in one.keys() & two.keys():
                    below = one[letter][0], two[letter][0]
                    if known.get(below):
                        known[pair] = True
                        break
                    if below not in known:
                        open_ = below
                else:
                    if open_ is None:
                        known[pair] = False
                    else:
                        stack.append(open_)
        return known[a, b]

    def read(self, a: int, b: int, x: int, y: int, most: int | None, skip: str = "") -> Iterator[tuple[int, int]]:
        """Ranks of the pairs of words that read the same letters from states ``a`` and ``b`` on, with ranks ``x`` and ``y`` so far, in at
        most ``most`` letters and not beginning with ``skip``."""
        stack = [(a, b, x, y, most, skip)]
        while stack:
            a, b, x, y, left, skip = stack.pop()
            if self.final[a] and self.final[b]:
                yield x, y
            if left == 0:
                continue
            one, two = self.arcs[a], self.arcs[b]
            for letter in one.keys() & two.keys():
                if letter != skip:
                    (s, i), (t, j) = one[letter], two[letter]
                    if left is not None or self.common(s, t):
                        stack.append((s, t, x + i, y + j, None if left is None else left - 1, ""))

    def pairs(self, before: str, backward: bool, most: int | None) -> Iterator[tuple[int, int]]:
        """Ranks of all pairs of words at one edit, each once, with ``most`` letters after the edit. ``before`` is the letter before all words. Of
        the places where a dropped letter may have stood, the one furthest from the words' true beginning counts."""
        stack = [(self.start, 0, before)]
        while stack:
            state, rank, previous = stack.pop()
            arcs = list(self.arcs[state].items())
            for k, (letter, (target, offset)) in enumerate(arcs):
                stack.append((target, rank + offset, letter))
                for _, (other, shift) in arcs[:k]:  # the letter replaced
                    if most is not None or self.common(target, other):
                        yield from self.read(target, other, rank + offset, rank + shift, most)
                if backward:  # the letter dropped
                    if letter != previous:
                        yield from self.read(target, state, rank + offset, rank, most)
                elif self.common(target, state):
                    yield from self.read(target, state, rank + offset, rank, most, letter)


def cells(words: DataFrame, backward: bool, limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """cell, depth, edited, s, word, n: words by partition. In rows that are ``edited`` the pairs differ at the letter numbered ``depth``; in the
    others the first ``depth`` letters agree. ``s`` is the word, reversed if ``backward``."""
    rows = words.select((F.reverse("word") if backward else F.col("word")).alias("s"), "word", "n")
    side, depth, out = F.lit("b" if backward else "f"), KEY, None
    while True:
        keyed = rows.withColumn("head", F.substring("s", 1, depth))
        hot = stored(keyed.groupBy("head").agg(F.sum(F.length("s")).alias("letters"), F.count("*").alias("rows")).where(f"letters > {limit} AND rows > {few}").select("head"), "hot")
        shape = (F.lit(depth).alias("depth"), "s", "word", "n")
        plain = keyed.join(hot, "head", "left_anti").select(F.concat(side, "head").alias("cell"), F.lit(False).alias("edited"), *shape)
        out = plain if out is None else out.unionByName(plain)
        if hot.isEmpty():
            return out
        big = stored(keyed.join(hot, "head", "left_semi"), "split")
        # what follows the first letters, with all of it and with its first letter left out
        tails = F.array(F.substring("s", depth + 1, F.length("s")), F.when(F.length("s") > depth, F.substring("s", depth + 2, F.length("s"))))
        edited = big.select("*", F.explode(tails).alias("tail")).where("tail IS NOT NULL")
        if backward:
            edited = edited.where(F.length("tail") < KEY)
        out = out.unionByName(edited.select(F.concat(side, "head", F.lit(" "), "tail").alias("cell"), F.lit(True).alias("edited"), *shape))
        rows = big.where(F.length("s") > depth).select("s", "word", "n")
        depth += 1


def edited_pairs(strings: list[str], depth: int, tail: str, backward: bool) -> Iterator[tuple[int, int]]:
    """Pairs among strings that agree but for the letter at ``depth``, which the one without it lacks."""
    whole = [i for i, s in enumerate(strings) if len(s) == depth + len(tail)]
    others = [i for i, s in enumerate(strings) if len(s) > depth + len(tail)]
    for k, i in enumerate(others):
        yield from ((i, j) for j in others[:k])
        if strings[i][depth] != (strings[i][depth - 1] if backward else tail[:1]):
            yield from ((i, j) for j in whole)


def near_in(cell: str, depth: int, edited: bool, strings: list[str], words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a partition: how many near words it has there, and the place of the best one (its own if it has none)."""
    backward = cell[0] == "b"
    if edited:
        found = edited_pairs(strings, depth, cell.split(" ")[1], backward)
    else:
        found = Acceptor([s[depth:] for s in strings]).pairs(strings[0][depth - 1], backward, KEY - 1 if backward else None)
    flat = np.fromiter((i for pair in found for i in pair), np.int64).reshape(-1, 2)
    one, other = np.concatenate([flat, flat[:, ::-1]]).T
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, one, rank[other])
    return np.bincount(one, minlength=len(words)), np.array([*order, -1])[best]


def near_words(words: DataFrame, limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """word, n, n_near (words at one edit), best_n, best (the one with the largest n; ties: smallest) of every row of ``words(word, n)``."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, depth, edited, strings, words_, n = zip(*held, strict=True)
            near, best = near_in(held[0][0], depth[0], edited[0], list(strings), list(words_), np.array(n))
            lone = best < 0
            return pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.int64()), pa.array(np.array(n)[best], pa.int64(), mask=lone),
                                               pa.array([None if b < 0 else words_[b] for b in best.tolist()], pa.string())], [c.split()[0] for c in NEAR.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    rows = cells(words, False, limit, few).unionByName(cells(words, True, limit, few))
    found = rows.select("cell", "depth", "edited", "s", "word", "n").repartition("cell").sortWithinPartitions("cell", "s").mapInArrow(scan, NEAR)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("best")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms(word, form)``: forms followed to the last, twice as far each round. Counts grow along them, so they have an end."""
    reach = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach = further.select("word", "root")
        if further.where("moved").isEmpty():
            return reach


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs(doc_id, text)`` with ``min_count`` occurrences or more."""
    near = near_words(vocabulary(docs, min_count), limit)
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = stored(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
