"""Fill-in-the-middle examples cut at line, sentence or word boundaries (operator 12).

All texts of a step are laid end to end, their characters are reduced to four classes, and a wavelet matrix over the classes answers
how many characters of a class stand before a place (rank) and where the k-th one stands (select). A unit ends with a character of one
of the classes in ``UNITS``, or with the text. The number of units of a text is a sum of ranks; the end of its k-th unit is one select
if a single class ends units, and found by bisection on the sum of ranks otherwise. All documents of a step are located at once.

Which units become prefix, middle and suffix, and in which order they are written, follows from a hash of the seed and the doc_id only.

Cases: null texts count as empty; an empty text, and one that holds a marker, stays plain; a null doc_id is hashed as an empty string;
rows with equal ids and texts give equal rows; a text of any length is cut whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OTHER, BLANK, NEWLINE, STOP = range(4)
#: Classes of the characters that end a unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (BLANK, NEWLINE)}
CLASS_OF = {**dict.fromkeys(" \t\r\f\v", BLANK), "\n": NEWLINE, **dict.fromkeys(".!?", STOP)}
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Bits:
    """A bit vector with rank and select by counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        raw = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[:len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th one (or zero), from 0."""
        before = self.before if bit else (np.arange(len(self.before), dtype=np.int64) << 6) - self.before
        word = np.searchsorted(before, k, "right") - 1
        inside = self.words[word] if bit else ~self.words[word]
        spread = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (word << 6) + (np.cumsum(spread, axis=1, dtype=np.int16) > (k - before[word])[:, None]).argmax(1)


class WaveletMatrix:
    """``codes`` of ``width`` bits; ranks and selects of many codes and places at once."""

    def __init__(self, codes: np.ndarray, width: int):
        self.size, self.levels = len(codes), []
        for level in range(width - 1, -1, -1):
            bit = (codes >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), len(codes) - int(bit.sum())))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def _down(self, code: int, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = zeros + ones if code >> level & 1 else at - ones
        return at

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place."""
        return self._down(code, at) - self._down(code, np.zeros(1, np.int64))

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th ``code``, from 0."""
        at = self._down(code, np.zeros(1, np.int64)) + k
        for level, bits, zeros in reversed(self.levels):
            one = code >> level & 1
            at = bits.select(at - zeros if one else at, one)
        return at

    def ranks(self, codes: Sequence[int], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(c, at) for c in codes)

    def locate(self, codes: Sequence[int], k: np.ndarray) -> np.ndarray:
        """Place of the k-th character of any of ``codes``, from 0: a select, or bisection on the sum of ranks."""
        if len(codes) == 1:
            return self.select(codes[0], k)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.size, np.int64)  # ranks at low are k or less, at high more
        while (high - low > 1).any():
            middle = (low + high) >> 1
            more = self.ranks(codes, middle) > k
            low, high = np.where(more, low, middle), np.where(more, middle, high)
        return low


def class_table() -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for char, kind in CLASS_OF.items():
        table[ord(char)] = kind
    return table


class Boundaries:
    """Units of texts, all located at once."""

    def __init__(self, texts: list[str], unit: str):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = UNITS[unit]
        self.matrix = WaveletMatrix(class_table()[np.minimum(points, 127)], 2)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.first = self.matrix.ranks(self.codes, self.starts)
        closed = self.matrix.ranks(self.codes, self.ends) - self.first
        last = self.matrix.ranks(self.codes, self.ends) - self.matrix.ranks(self.codes, np.maximum(self.ends - 1, 0))
        self.counts = closed + ((self.lengths > 0) & (last == 0))  # what follows the last boundary is a unit too

    def after(self, k: np.ndarray) -> np.ndarray:
        """Characters of each text up to the end of its k-th unit, 0 for k = 0."""
        out = np.where(k >= self.counts, self.lengths, 0)
        inside = (k > 0) & (k < self.counts)
        if inside.any():
            out[inside] = self.matrix.locate(self.codes, (self.first + k - 1)[inside]) + 1 - self.starts[inside]
        return out


def hashes(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the sha256 of ``seed:doc_id``."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i:i + 4], "big") for i in range(0, 16, 4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of those with the suffix first; the others stay plain.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            units = Boundaries(texts, unit)
            ids = batch.column(0).to_pylist()
            own = np.array([hashes(seed, i) for i in ids], np.int64).reshape(-1, 4)
            places = own[:, :2] % (units.counts[:, None] + 1)
            one, two = units.after(places.min(1)).tolist(), units.after(places.max(1)).tolist()
            plain, suffix_first = (own[:, 2] % 100 >= rate).tolist(), (own[:, 3] % 100 < spm).tolist()
            forms, outputs = [], []
            for i, (text, a, b) in enumerate(zip(texts, one, two, strict=True)):
                if plain[i] or not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    outputs.append(text)
                elif suffix_first[i]:
                    forms.append("spm")
                    outputs.append(f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
                else:
                    forms.append("psm")
                    outputs.append(f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
            whole = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(units.counts, pa.int64()), pa.array(forms, pa.string()), pa.array(one, pa.int64(), mask=whole),
                pa.array(np.subtract(two, one), pa.int64(), mask=whole), pa.array(outputs, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone: what stands between the markers, put in order again."""
    first, second = F.when(form == "spm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    at, last = F.position(second, output), F.position(F.lit(MIDDLE), output)
    one = F.substr(output, F.length(first) + 1, at - F.length(first) - 1)
    two = F.substr(output, at + F.length(second), last - at - F.length(second))
    middle = F.substr(output, last + F.lit(len(MIDDLE)))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
