"""Language identification, family first (operator 6).

A linear support vector machine for each language family, against the rest, picks the family of a text from hashed byte n-grams of its
letters; within it one-versus-one machines between the family's languages vote (ties go by their margins). Each machine is fitted in a
task of its own on a bounded sample: about ``SAMPLE_ROWS`` distinct labelled rows in all, spread evenly over the languages and chosen
by a hash of doc_id and text. Every text is then scored whole.

Cases: ``und`` and score 0 where text is null or has no letter, or where nothing could be learned; rows without a language teach nothing; a
language without a known family is a family of its own; repeated rows, null or equal doc_ids and very long texts are scored row by row;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import steps
from spoor.llm.linear import DIM, fit_svm, ngram_vectors, sigmoid

#: Families of common languages, by code.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "baltic": ["lt", "lv"], "celtic": ["ga", "cy", "gd", "br"], "uralic": ["fi", "et", "hu"], "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "semitic": ["ar", "he", "mt", "am"], "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"], "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["ta", "te", "kn", "ml"], "malayic": ["id", "ms", "jv", "su"], "sinitic": ["zh", "yue", "wuu"],
}
SAMPLE_ROWS = 6000
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits


def has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _LETTER.finditer(text))


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), f"language {lang}")


def held_out(doc_id: Column) -> Column:
    """Documents that teach nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(labelled: DataFrame, sample_rows: int) -> tuple[list[str], DataFrame]:
    """The languages of ``labelled(doc_id, text, lang)``, and about ``sample_rows`` of its distinct rows, as many of each."""
    row = F.xxhash64("doc_id", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(row).alias("n")).collect()}  # a row for each language
    if not counts:
        return [], labelled
    share = sample_rows / len(counts)
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / max(n, 1)))))
    few = labelled.where((F.pmod(row, F.lit(1 << 20)) / F.lit(float(1 << 20))) < F.element_at(rates, F.col("lang")))
    return sorted(counts), few.dropDuplicates(["doc_id", "text", "lang"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[tuple[str, str, str]], np.ndarray, np.ndarray]:
    """From ``labelled(doc_id, text, lang)``: the languages, the machines as (kind, positive, negative), their weights (DIM x machines) and offsets."""
    langs, sample = sampled(labelled, sample_rows)
    if not langs:
        return [], [], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, limit=1_000_000):
            x = ngram_vectors(texts, letters_only=True).astype(np.float16)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                family, rows = family_of(lang), []
                rows += [("family", f, "", 1 if f == family else -1) for f in families] if len(families) > 1 else []
                rows += [("pair", p, q, 1 if lang == p else -1) for p, q in pairs if lang in (p, q)]
                if rows:
                    kind, pos, neg, y = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pos), pa.array(neg), pa.array(y, pa.int32()), pa.array([x[i].tobytes()] * len(rows), pa.binary())],
                                                     ["kind", "pos", "neg", "y", "x"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), DIM).astype(np.float32)
        w, b = fit_svm(x, rows["y"].to_numpy(np.float32))
        return pd.DataFrame({"kind": rows["kind"].iloc[:1], "pos": rows["pos"].iloc[:1], "neg": rows["neg"].iloc[:1], "w": [w.tobytes()], "b": [b]})

    families = sorted({family_of(x) for x in langs})
    pairs = [(p, q) for i, p in enumerate(langs) for q in langs[i + 1:] if family_of(p) == family_of(q)]
    rows = sample.select("lang", "text").mapInArrow(vectors, "kind string, pos string, neg string, y int, x binary")
    found = sorted(rows.groupBy("kind", "pos", "neg").applyInPandas(train, "kind string, pos string, neg string, w binary, b double").collect())
    weights = np.stack([np.frombuffer(r["w"], np.float32) for r in found], 1) if found else np.zeros((DIM, 0), np.float32)
    machines = [(r["kind"], r["pos"], r["neg"]) for r in found]
    return langs, machines, weights, np.array([r["b"] for r in found], np.float32)


def decide(margins: np.ndarray, machines: list[tuple[str, str, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score of each row of margins (rows x machines)."""
    n = len(margins)
    families = sorted({family_of(x) for x in langs})
    ofs = {m[1]: i for i, m in enumerate(machines) if m[0] == "family"}
    pair = {(m[1], m[2]): i for i, m in enumerate(machines) if m[0] == "pair"}
    by_family = np.stack([margins[:, ofs[f]] if f in ofs else np.zeros(n) for f in families], 1)
    family = by_family.argmax(1)
    sure = np.ones(n)
    if len(families) > 1:
        top = np.sort(by_family, 1)
        sure = sigmoid(2 * (top[:, -1] - top[:, -2]))
    lang = np.zeros(n, np.int64)
    for f, name in enumerate(families):
        members = [x for x in langs if family_of(x) == name]
        votes, least = np.zeros((n, len(members))), np.full((n, len(members)), np.inf)
        for i, p in enumerate(members):
            for j, q in enumerate(members[i + 1:], i + 1):
                m = margins[:, pair[p, q]] if (p, q) in pair else np.zeros(n)
                votes[:, i] += (m > 0) + 0.001 * np.tanh(m)
                votes[:, j] += (m <= 0) - 0.001 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = votes.argmax(1)
        here = family == f
        lang[here] = np.array([langs.index(x) for x in members])[best[here]]
        if len(members) > 1:
            sure[here] *= sigmoid(4 * least[np.arange(n), best])[here]
    return lang, sure


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs(doc_id, text, lang)``; learns from rows that are not held out."""
    teaching = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    langs, machines, weights, offsets = fit(teaching, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # DIM x machines: grows with languages, not with rows

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for a in range(0, len(told), 1024):
                part = told[a:a + 1024]
                best, sure = decide(ngram_vectors([texts[i] for i in part], letters_only=True) @ sent.value + offsets, machines, langs)
                for i, k in zip(part, best.tolist(), strict=True):
                    lang[i] = langs[k]
                score[part] = sure
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
