"""Quality classifier from weak labels (operator 8).

Heuristic labellers look at every text and vote good, bad or nothing. Their votes form at most 3**labellers patterns; the corpus is counted
by pattern, and expectation-maximisation over the counts estimates, without any gold label, the share of good texts and each
labeller's chance of each vote given the truth. Labellers overlap and err differently; the posterior of a pattern weighs their votes by
those estimates. The posterior labels of a bounded sample (about ``SAMPLE_ROWS`` texts, chosen by hash) train a linear scorer over
hashed n-grams, which then scores every text whole.

Cases: a null or empty text has the votes of a text without words and is scored like any other; rows equal in doc_id and text count
as often as they occur; null doc_ids are allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps, stored
from spoor.llm.linear import DIM, fit_logistic, ngram_vectors, sigmoid
from spoor.llm.risk_rules import measure

SAMPLE_ROWS = 6000
#: Frequent short words of four languages.
FUNCTION_WORDS = frozenset("the of and to in a is that for it as was with be by on de la le les des et en un une du el los las y que der die und das von zu mit den".split())
_SHOUT = re.compile(r"[!?]{2,}")
GOOD, BAD, NONE = 1, 0, 2


def votes(text: str) -> tuple[int, ...]:
    """A vote of each labeller; see the names beside each."""
    n, chars, symbols, dup_lines, repeats, lines = measure(text)
    words, rows = max(n, 1), max(lines, 1)
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    capitals = upper / max(upper + lower, 1)
    common = sum(w in FUNCTION_WORDS for w in text.lower().split()) / words
    mean = chars / words
    shouts = len(_SHOUT.findall(text)) / words

    def by(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
        """Good inside one range, bad outside the other, none between."""
        return GOOD if good[0] <= value <= good[1] else BAD if not bad[0] <= value <= bad[1] else NONE

    return (
        by(symbols / words, (0, 0.02), (0, 0.2)),  # symbols
        by(mean, (4.6, 5.9), (4.2, 6.4)),  # length of words
        by(repeats / words, (0, 0.05), (0, 0.3)),  # repeated windows
        by(dup_lines / rows, (0, 0), (0, 0.3)) if lines > 2 else NONE,  # repeated lines
        by(capitals, (0, 0.08), (0, 0.3)),  # capitals
        by(shouts, (0, 0.01), (0, 0.1)),  # runs of marks
        by(n, (50, float("inf")), (3, float("inf"))),  # length
        by(common, (0.12, 0.8), (0.03, 0.9)) if n >= 20 else NONE,  # function words
    )


N_LABELLERS = len(votes(""))


def code(pattern: tuple[int, ...]) -> int:
    out = 0
    for v in pattern:
        out = 3 * out + v
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, chances (labeller x truth x vote) and each pattern's posterior, by expectation-maximisation.

    It starts from the votes' majority, so that truth 1 means good, and stops when posteriors settle.
    """
    n = counts.sum()
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = (good + 1.0) / (good + bad + 2.0)
    hot = np.eye(3)[patterns]  # pattern x labeller x vote
    share, chance = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = counts[:, None] * np.stack([1 - post, post], 1)  # pattern x truth
        chance = np.einsum("pt,pjv->jtv", weight, hot) + 0.01 * n / 3
        chance /= chance.sum(2, keepdims=True)
        share = min(max(float((counts * post).sum() / n), 1e-6), 1 - 1e-6)
        logs = np.einsum("pjv,jtv->pt", hot, np.log(chance)) + np.log([1 - share, share])
        new = sigmoid(logs[:, 1] - logs[:, 0])
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, chance, post


def weak_labels(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, cutoff: float = 0.5) -> DataFrame:
    """doc_id, posterior (of the label model), score (of the scorer), kept of every row of ``docs(doc_id, text)``."""

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([code(votes(t)) for t in texts], pa.int32())], ["doc_id", "text_key", "pattern"])

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, limit=1_000_000):
            x = ngram_vectors(texts, letters_only=False).astype(np.float16)
            p = [float(posterior[code(votes(t))]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([r.tobytes() for r in x], pa.binary())], ["p", "x"])

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_pylist()) for batch in batches]
        if held:
            x = np.frombuffer(b"".join(r for _, rows in held for r in rows), np.float16).reshape(-1, DIM).astype(np.float32)
            w, b = fit_logistic(x, np.concatenate([p for p, _ in held]))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["w", "b"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            s = np.concatenate([sigmoid(ngram_vectors(texts[i:i + 1024], letters_only=False) @ w + b) for i in range(0, len(texts), 1024)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], ["doc_id", "text_key", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    voted = stored(rows.mapInArrow(vote, "doc_id bigint, text_key bigint, pattern int"), "votes")
    counted = voted.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    codes = np.array([r["pattern"] for r in counted], np.int64)
    patterns = np.stack([codes // 3 ** k % 3 for k in range(N_LABELLERS - 1, -1, -1)], 1)
    n = np.array([r["count"] for r in counted], np.float64)
    posterior = np.full(3 ** N_LABELLERS, 0.5)
    w, b = np.zeros(DIM, np.float32), 0.0
    if len(codes):
        posterior[codes] = label_model(patterns, n)[2]
        chosen = F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(1 << 20)) < int(min(1.0, sample_rows / n.sum()) * (1 << 20))
        found = rows.where(chosen).select("doc_id", "text").dropDuplicates().mapInArrow(vectors, "p double, x binary").repartition(1).mapInArrow(train, "w binary, b double").collect()
        if found:
            w, b = np.frombuffer(found[0]["w"], np.float32), found[0]["b"]
    known = docs.sparkSession.createDataFrame([(int(c), float(posterior[c])) for c in codes], "pattern int, posterior double")
    labelled = voted.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("text_key").alias("_key"), "pattern").distinct().join(F.broadcast(known), "pattern")
    scored = rows.mapInArrow(score, "doc_id bigint, text_key bigint, score double").withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    joined = scored.join(labelled, (scored["_doc"] == labelled["_doc"]) & (scored["text_key"] == labelled["_key"]))
    return joined.select("doc_id", "posterior", "score", (F.col("score") >= cutoff).alias("kept"))
