"""Hashed n-gram vectors of whole texts, and small linear models over them."""

from __future__ import annotations

import numpy as np

DIM = 4096
_FOLDED = np.zeros(256, np.uint8)  # letters in lower case and all bytes beyond ASCII; anything else is a gap (0)
_FOLDED[0x80:] = np.arange(0x80, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLDED[_c] = _FOLDED[_c - 32] = _c
_SPACES = [9, 10, 11, 12, 13, 32]
_RAW = np.arange(256, dtype=np.uint8)  # all characters tell apart, white space is a gap
_RAW[_SPACES] = 0


def ngram_vectors(texts: list[str], letters_only: bool, dim: int = DIM) -> np.ndarray:
    """Shares of hashed byte bigrams and trigrams (rows sum to one, or are zero); grams over two gaps in a row don't count."""
    out = np.zeros((len(texts), dim), np.float32)
    table = _FOLDED if letters_only else _RAW
    for i in range(0, len(texts), 256):
        part = [(t.lower() if letters_only else t).encode("utf-8", "replace") for t in texts[i:i + 256]]
        raw = table[np.frombuffer(b"".join(b" " + t + b"  " for t in part), np.uint8)]
        doc = np.repeat(np.arange(len(part)), [len(t) + 3 for t in part])
        a, b, c = raw[:-2].astype(np.uint32), raw[1:-1].astype(np.uint32), raw[2:].astype(np.uint32)
        two, three = (a | b) > 0, ((a | b) > 0) & ((b | c) > 0)
        h2 = ((a | b << 8) * np.uint32(2654435769) >> np.uint32(20)) % np.uint32(dim)
        h3 = ((a | b << 8 | c << 16 | 1 << 24) * np.uint32(2246822519) >> np.uint32(20)) % np.uint32(dim)
        cells = np.concatenate([doc[:-2][two] * dim + h2[two], doc[:-2][three] * dim + h3[three]])
        counts = np.bincount(cells, minlength=len(part) * dim).reshape(len(part), dim)
        out[i:i + len(part)] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return out


def _scale(x: np.ndarray) -> np.ndarray:
    """What brings every feature to about one in size; rare ones are not blown up."""
    spread = x.std(0)
    return (1.0 / (spread + 0.1 * spread.mean() + 1e-9) / np.sqrt(x.shape[1])).astype(np.float32)


def _descend(x: np.ndarray, slope, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent; ``slope(margins)`` is the loss' derivative for each row."""
    scale, mean = _scale(x), x.mean(0)
    z = (x - mean) * scale
    w = v = np.zeros(z.shape[1], np.float32)
    b = vb = 0.0
    norm = float((z ** 2).sum(1).mean()) + 1.0
    rate = 1.0 / norm
    for k in range(rounds):
        g = slope(z @ v + vb)
        nw, nb = v - rate * (z.T @ g / len(z) + penalty * v), vb - rate * float(g.mean())
        m = k / (k + 3)
        v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    w = w * scale
    return w.astype(np.float32), float(b - w @ mean)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) for y in -1, 1, both sides weighted alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    return _descend(x, lambda m: -weight * y * np.maximum(0, 1 - y * m), rounds, penalty)


def fit_logistic(x: np.ndarray, p: np.ndarray, rounds: int = 300, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels p (0 to 1)."""
    return _descend(x, lambda m: (sigmoid(m) - p).astype(np.float32), rounds, penalty)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
