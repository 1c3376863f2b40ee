"""Quality rules with risk-controlled thresholds (operator 2).

Five rules measure a text: symbols per word, share of words in repeated three-word windows, repeated lines per line, and mean word length
from above and from below. Each has a ladder of cutoffs from lenient to strict; step c of the ladder rejects a text that
is at or beyond any rule's c-th cutoff. In each stratum (a language) the labelled good documents that pass the base rules are the
holdout: with n of them and k rejected at step c, the step is certified if the exact (Clopper-Pearson) upper bound of its
false-rejection rate is at most ``risk``, that is, if a binomial of n trials at ``risk`` gives k or fewer with probability at most
``delta`` / strata. Steps are tested from lenient to strict up to the first that fails, so testing many steps needs no correction;
testing many strata takes Bonferroni's. With probability 1 - delta, no stratum's rules reject more than ``risk`` of its good
documents. A stratum without enough labels certifies nothing and rejects nothing beyond the base rules.

Cases: a null or empty text has no words and fails the base rules; a null stratum is a stratum; repeated labels of a document count once, by
the lowest quality; labels without a quality are ignored; empty tables give no rows or no rejections; equal or null doc_ids keep their
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import steps, stored

RISK, DELTA, STEPS = 0.05, 0.05, 40
#: Rule: (most lenient, strictest cutoff); a text is rejected at or beyond it.
LADDERS = {"symbols": (2.0, 0.05), "repeats": (1.0, 0.2), "dup_lines": (1.0, 0.25), "long_words": (12.0, 6.0), "short_words": (2.0, 4.2)}
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS = 50
_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:  # keep the triple's number below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(numbers) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(triple)] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = text.encode("utf-8", "replace").split()  # of bytes: at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else [text] * bool(words)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def measures(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, text_key, stratum and the measures of every row; written, as they serve the thresholds and the verdicts."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            found = np.array([measure(t) for t in texts], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c) for c in found.T)], names)

    names = ["doc_id", "text_key", "stratum", *(c.split()[0] for c in _MEASURES.split(", "))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    return stored(rows.mapInArrow(scan, f"doc_id bigint, text_key bigint, stratum string, {_MEASURES}"), "measures")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def first_step(ladders: dict[str, tuple[float, float]], n_steps: int) -> Column:
    """The most lenient step, from 1, that rejects a text; ``n_steps`` + 1 if none does. Cutoffs lie evenly between a ladder's ends."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    values = {"symbols": F.col("n_symbols") / words, "repeats": F.col("n_repeat_words") / words, "dup_lines": F.col("n_dup_lines") / lines,
              "long_words": F.col("word_chars") / words, "short_words": F.col("word_chars") / words}
    found = []
    for rule, (lenient, strict) in ladders.items():
        # distance still to go from the lenient end, in steps; the value's own sign of strictness
        step = F.ceil((F.lit(lenient) - values[rule]) / ((lenient - strict) / (n_steps - 1))).cast("int") + 1
        found.append(F.greatest(F.lit(1), step))
    return F.least(*found, F.lit(n_steps + 1))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, its terms added from the largest down."""
    if k >= n:
        return 1.0
    at = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(at)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in at))


def certified(rejected: list[int], n: int, risk: float, delta: float) -> int:
    """The last step certified, from rejected good documents at each step; 0 if none."""
    for c, k in enumerate(rejected):
        if k > risk * n or binomial_at_most(k, n, risk) > delta:  # the first test saves time: such a tail is about a half
            return c
    return len(rejected)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float, delta: float, n_steps: int) -> DataFrame:
    """stratum, holdout (good labelled documents), step (the strictest one certified)."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    counts = (measured.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id")
              .groupBy("stratum", "doc_id").agg(F.min("first_step").alias("first_step"))  # one trial a label, however many rows have its id
              .groupBy("stratum", "first_step").agg(F.count("*").alias("n")))
    # one row of at most n_steps + 1 counts for each stratum
    strata = counts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("first_step", "n"))).alias("at"), F.sum("n").alias("holdout"))
    strata = strata.withColumn("strata", F.count("*").over(Window.partitionBy()))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps_ = []
            for at, n, strata in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = dict(at)
                steps_.append(certified(np.cumsum([at.get(c, 0) for c in range(1, n_steps + 1)]).tolist(), n, risk, delta / strata))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(steps_, pa.int32())], ["stratum", "holdout", "step"])

    return strata.mapInArrow(choose, "stratum string, holdout bigint, step int")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, n_steps: int = STEPS,
                  ladders: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Every row's measures, base_failed, first_step, the certified step of its stratum, and kept."""
    measured = measures(docs, stratum).withColumn("base_failed", base_failed()).withColumn("first_step", first_step(ladders or LADDERS, n_steps))
    steps_ = stored(thresholds(measured, labels, risk, delta, n_steps), "thresholds")
    return (measured.join(steps_.select("stratum", "step"), "stratum", "left").withColumn("step", F.coalesce("step", F.lit(0)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("first_step") > F.col("step"))))
