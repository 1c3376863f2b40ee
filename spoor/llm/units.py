"""Exact ids of the two JSON tokenizers, encoding each distinct word once.

A text of ASCII and Latin-1 letters falls into units at places where both pre-tokenizers always cut: before a run of white
space, and between a letter and a character that is neither letter, white space nor apostrophe. Ids of a text are then the ids of
its units in order, so the library sees every distinct unit once per worker. Any other text (rarer characters, or ``<|``, which
may begin a special string) goes through the library whole. The memory of seen units is bounded and only saves time.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np

SPACE, LETTER = " \t-\r", "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\t-\r -~{LETTER}]*")
#: With the white space before each word, as byte-level vocabularies count it; and without, where it is dropped.
SPACED = re.compile(f"[{SPACE}]*[{LETTER}]+|[{SPACE}]*[^{SPACE}{LETTER}']+|[{SPACE}]*[^{SPACE}{LETTER}]*'[^{SPACE}]*|[{SPACE}]+")
BARE = re.compile(f"[{LETTER}]+|[^{SPACE}{LETTER}']+|[^{SPACE}{LETTER}]*'[^{SPACE}]*")
#: Units kept in a worker before it starts afresh.
MOST_UNITS = 1_000_000
#: Units encoded in one call of the library.
CALL = 1000


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class UnitEncoder:
    """``encode(texts)`` gives all ids, joined, and the number of ids of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        import json

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.bare = described["normalizer"] is not None  # lower-cases and drops white space
        # bytes that each id stands for in plain text: its name has a character for each, and perhaps an end mark
        vocabulary = described["model"]["vocab"]
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.id_bytes[i] = len(name) - (4 if self.bare and name.endswith("</w>") else 0)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known = _Numbers(), 0
        self.ids, self.starts, self.sizes = np.empty(1 << 16, np.uint16), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.used = 0

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the units that have a number but no ids yet."""
        if (fresh := len(self.numbers) - self.known) <= 0:
            return
        units = list(itertools.islice(self.numbers, self.known, None))
        # many units in one call, as words of one text; where each ends follows from the bytes of its ids
        flat = np.concatenate([np.array(self.library.encode_batch_fast([units[i:i + CALL]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint16)
                               for i in range(0, fresh, CALL)])
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, fresh))
        got = np.cumsum(self.id_bytes[flat])
        stops = np.searchsorted(got, ends) + 1
        if stops[-1] != len(flat) or (got[stops - 1] != ends).any():
            raise ValueError("ids and units do not match")
        sizes = np.diff(stops, prepend=0).astype(np.int32)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.sizes) < self.known + fresh:
            self.sizes, self.starts = (np.concatenate([x, np.empty_like(x)]) for x in (self.sizes, self.starts))
        self.ids[self.used:self.used + len(flat)] = flat
        self.sizes[self.known:self.known + fresh] = sizes
        self.starts[self.known:self.known + fresh] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known += fresh

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Numbers of all units, units of each text, and places of the texts that the library takes whole."""
        if len(self.numbers) > MOST_UNITS:
            self.clear()
        find, get, numbers, counts, whole = (BARE if self.bare else SPACED).findall, self.numbers.__getitem__, [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if "<|" in text or not PLAIN.fullmatch(text):
                whole.append(i)
                continue
            units = find(text.lower() if self.bare else text)
            counts[i] = len(units)
            numbers.append(np.fromiter(map(get, units), np.int64, len(units)))
        self._learn()
        return np.concatenate(numbers) if numbers else np.empty(0, np.int64), counts, whole

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, counts, whole = self._units(texts)
        sums = np.concatenate([[0], np.cumsum(self.sizes[numbers], dtype=np.int64)])
        ends = np.cumsum(counts)
        out = sums[ends] - sums[ends - counts]
        for i, ids in zip(whole, self.library_ids([texts[i] for i in whole]), strict=True):
            out[i] = len(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts, whole = self._units(texts)
        sizes = self.sizes[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        sums, stops = np.concatenate([[0], ends]), np.cumsum(counts)
        lengths = sums[stops] - sums[stops - counts]
        if not whole:
            return flat, lengths
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        for i, ids in zip(whole, self.library_ids([texts[i] for i in whole]), strict=True):
            parts[i], lengths[i] = np.array(ids, np.uint16), len(ids)
        return np.concatenate(parts), lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return UnitEncoder(path)


def with_end(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    out = np.full(len(flat) + len(lengths), end_id, flat.dtype)
    at = np.repeat(np.arange(len(lengths)), lengths) + np.arange(len(flat))
    out[at] = flat
    return out, lengths + 1
