"""Corpus operators against plain versions, and on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from spoor.llm import common, queries  # noqa: E402
from spoor.llm.block_names import exact_dedup, salted_md5  # noqa: E402
from spoor.llm.chunk_dedup import chunk_starts, gear, gear_table, without_repeats  # noqa: E402
from spoor.llm.components import components, spanning  # noqa: E402
from spoor.llm import chunk_dedup, hilbert_packing as hilbert_packing_module  # noqa: E402
from spoor.llm.hilbert_packing import hilbert_index, hilbert_packing, tail_starts  # noqa: E402
from spoor.llm import jaccard  # noqa: E402
from spoor.llm.jaccard import open_pairs, parity, prefixes, similar_components, star_pairs, verified  # noqa: E402
from spoor.llm.lang_id import has_letter, held_out, language_id, sampled  # noqa: E402
from spoor.llm.piece_viterbi import Pieces, piece_ids  # noqa: E402
from spoor.llm.risk_rules import binomial_at_most, certified, measure, quality_rules  # noqa: E402
from spoor.llm.simhash import allocate, links, simhash_components, within  # noqa: E402
from spoor.llm.token_counts import token_counts  # noqa: E402
from spoor.llm.token_planes import crc32_joined, from_planes, to_planes, token_planes  # noqa: E402
from spoor.llm.units import UnitEncoder  # noqa: E402
from spoor.llm.weak_labels import label_model, weak_labels  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (queries.vocabulary(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SPACE = "[ \t-\r]"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, repeats int, doc string, name string, hash string"
LONG = " ".join(f"wort{i % 977} {i}" for i in range(30_000))
TEXTS = ["", None, "One two Three four five six seven", "one two three FOUR five six seven", "  \n\t ", "é<|endoftext|>x İstanbul  don't they'll é",
         "x" * 70_000, LONG, LONG + " end", "<|startoftext|> a  b\n\n c", "word\n\nword\n\nword\n", "日本語のテキスト 123 45.6", "don't 'tis I'm", "a", "a"]


@pytest.fixture(scope="module")
def awkward(spark):
    common.importable(spark)
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "k", i, 1, "d", "n", "h") for i, t in enumerate(TEXTS)]
    rows += [rows[2], rows[7], (3, TEXTS[2], "en", None, None, None, None, None, None, None, None), (None, "one two three four", None, None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None, None)]
    return common.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "awkward")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    common.importable(spark)
    return common.documents(spark, SF)


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words_of(text):
    return re.findall("[^ \t-\r]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Tokens --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_give_the_library_s_ids(path):
    texts = [t or "" for t in TEXTS] + ["áb", "A\x85B \x1cC", "tab\tnew\nline  two", "it's IT'S 'S", "3rd 4,5 (x)", "ÀÖ ß×÷ª", "<|ENDOFTEXT|>", " lead", "trail "]
    own, lib = UnitEncoder(path), library(path)
    flat, lengths = own.encode(texts)
    parts = np.split(flat, np.cumsum(lengths)[:-1])
    for text, got in zip(texts, parts, strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]
    assert own.count(texts).tolist() == lengths.tolist()


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_planes_round_trip(plane):
    ids = np.random.default_rng(0).integers(0, 49408, 1001).astype(np.uint16)
    assert (from_planes(to_planes(ids, plane, 16), len(ids), plane) == ids).all()
    a, b = b"some bytes", b"others" * 999
    assert crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_planes(spark, awkward, nothing):
    got = sorted(map(tuple, token_planes(awkward.select("text", "doc_id", "key"), WORD, 2, plane="byte").collect()), key=lambda r: r[1])
    lib, start, want = library(WORD), 0, []
    for r in sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert token_planes(nothing, WORD, 2).count() == 0


def test_token_counts(awkward, nothing):
    lib = library(BYTE)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in awkward.collect())
    assert Counter(map(tuple, token_counts(awkward, BYTE).collect())) == want
    # narrow overlaps: the run of 70,000 letters has no cut and needs them widened again and again
    assert Counter(map(tuple, token_counts(awkward, BYTE, chunk_chars=100, overlap=20).collect())) == want
    assert token_counts(nothing, BYTE).count() == 0


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(hilbert_index(grid, 3))]
    assert sorted(hilbert_index(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def test_packing(awkward, nothing, real):
    assert tail_starts(2048 + 13, 2048) == [2048, 2056, 2060]
    lib = library(BYTE)
    for docs in (awkward, real):
        pieces = hilbert_packing(docs, BYTE, 1).collect()
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_sequence[p.sequence_id].append(p)
            by_doc[p.doc_id].append(p)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == 2048 or at & (at - 1) == 0
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            want[r.doc_id].append(lib.encode(r.text or "", add_special_tokens=False).ids + [1])
        assert want.keys() == by_doc.keys()
        for doc_id, texts in want.items():
            if len(texts) == 1:
                at = 0
                for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                    assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(texts[0]), crc(texts[0][at:at + p.length]))
                    at += p.length
                assert at == len(texts[0])
            else:
                assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, texts))
    assert hilbert_packing(nothing, BYTE, 1).count() == 0


def test_packing_ranges(spark, real, monkeypatch):
    """As many ranges as the ids need, even in ids, also where a third of all rows is one text without an id."""
    common.importable(spark)
    copies = spark.range(1500).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one text for all of them").alias("text"), F.col("id").alias("row"))
    docs = common.stored(real.select("doc_id", "text", F.lit(None).cast("bigint").alias("row")).unionByName(copies), "ranges")
    monkeypatch.setattr(hilbert_packing_module, "RANGE_BYTES", 20_000)
    laid = hilbert_packing_module.packed(docs, BYTE, 1)
    ids, rows = laid.agg(F.sum("n"), F.count("n")).first()
    shards = laid.groupBy("shard").agg(F.sum("n").alias("ids"), F.max("n").alias("longest"), F.count_if(F.isnull("doc_id")).alias("copies")).collect()
    assert rows == docs.count() and len(shards) >= 0.8 * 2 * ids / 20_000
    assert max(r.ids - r.longest for r in shards) <= 3 * ids / len(shards)
    assert sum(r.copies > 0 for r in shards) > 1 or len(shards) < 3
    few = hilbert_packing_module.range_bounds(docs.limit(5), BYTE, 1, 4)
    assert few == sorted(set(few)) and len(few) <= 4


def test_pieces_equal_the_library(spark, awkward, nothing, tmp_path):
    import random

    from sentencepiece import sentencepiece_model_pb2

    rnd = random.Random(3)
    fuzz = ["".join(rnd.choice("aeiounrstlhd.,!?   \n\t日本語éüß𠀀'\"-0123ABC_▁") for _ in range(rnd.randint(0, 60))) for _ in range(2000)] + [t or "" for t in TEXTS]
    own = Pieces(PIECE)
    for text, ids in zip(fuzz, own.encode(fuzz), strict=True):
        assert ids.tolist() == own.library.encode(text), text[:80]
        assert own.decode(ids) == text.replace("▁", " ")
    # the same pieces as a unigram model, with scores that its 32-bit sums hold exactly
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(Path(PIECE).read_bytes())
    for p in model.pieces:
        p.score = -float(1 + int(xxhash.xxh64_intdigest(p.piece.encode())) % 64) - (8 if len(p.piece) > 6 else 0) if p.type == 1 else p.score
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    unigram = Pieces(str(tmp_path / "unigram.model"), "unigram")
    for text, ids in zip(fuzz[:2000], unigram.encode(fuzz[:2000]), strict=True):
        assert ids.tolist() == unigram.library.encode(text), text
    got = Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.round_trip) for r in piece_ids(awkward, PIECE).collect())
    assert got == Counter((r.doc_id, len(ids := own.library.encode(r.text or "")), crc(ids), True) for r in awkward.collect())
    assert piece_ids(nothing, PIECE).count() == 0


# Duplicates ----------------------------------------------------------------------------------------------------

def exact_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[folded(r.text)].append(r.doc_id)
    return groups


@pytest.mark.parametrize("size", [4096, 8])
def test_block_names(awkward, nothing, size):
    rows = awkward.collect() if size > 8 else [r for r in awkward.collect() if len(r.text or "") < 1000]
    docs = awkward if size > 8 else awkward.where("coalesce(length(text), 0) < 1000")
    weak = lambda b, salt: F.substring(salted_md5(b, salt), 1, 1) if salt == 0 else salted_md5(b, salt)  # noqa: E731  clashes at first
    got = exact_dedup(docs, size, weak if size == 8 else salted_md5).collect()
    groups = exact_groups(rows)
    import hashlib

    want = Counter((r.doc_id, max((i for i in groups[folded(r.text)] if i is not None), default=None), len(groups[folded(r.text)]), hashlib.sha256(folded(r.text).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(r.text_sha256 for r in {r.text_sha256: r for r in got}.values())
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(nothing).count() == 0


def fingerprint(text, size=3):
    w = words_of(folded(text))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Smallest fingerprint reachable from each, by comparing all."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}
    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 3 and label[p] != label[q]:
                low, high = sorted((label[p], label[q]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_simhash(awkward, nothing, real):
    for docs in (awkward.where("coalesce(length(text), 0) < 100000"), real):
        rows = docs.select("doc_id", "text").collect()
        prints = [fingerprint(r.text) for r in rows]
        label = linked(prints)
        least = {}
        for r, p in zip(rows, prints, strict=True):
            if r.doc_id is not None:
                least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
        assert got == Counter((r.doc_id, f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints, strict=True))
    assert simhash_components(nothing).count() == 0


def similar_groups(rows):
    """Groups of row numbers linked by a Jaccard similarity of 5-word shingles of 0.8 or more, by comparing all."""
    sets = []
    for r in rows:
        w = words_of(folded(r.text))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                label = [label[j] if v == label[i] else v for v in label]
    groups = defaultdict(list)
    for i, v in enumerate(label):
        groups[v].append(i)
    return list(groups.values())


def test_near_stage_against_brute_force(spark, awkward, nothing):
    rng = np.random.default_rng(11)
    rows = []
    for n in (3, 6, 30, 60, 100, 100, 250):
        base = [f"w{x}" for x in rng.integers(0, 4000, n)]
        rows.append(" ".join(base))
        for _ in range(8):  # one to six words changed: similarities on both sides of 0.8
            copy = list(base)
            for at in rng.integers(0, n, int(rng.integers(1, 7))):
                copy[at] = f"x{rng.integers(0, 9999)}"
            rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    for docs in (docs, awkward, common.documents(spark, "/root/testdata/sf0.001")):
        own = docs.select("doc_id", "text").collect()
        groups = similar_groups(own)
        got = defaultdict(list)
        for r in similar_components(docs).collect():
            got[r.root].append(r.doc_id)
        order = lambda ids: sorted(ids, key=str)
        assert sorted((order(g) for g in got.values()), key=str) == sorted((order(own[i].doc_id for i in g) for g in groups), key=str)
        if len(own) == len(rows):
            assert 20 < len(groups) < len(rows) - 10
            kept = sorted(r.doc_id for r in pipeline.near(spark, docs, SF).collect())
            assert kept == sorted(min(own[i].doc_id for i in g) for g in groups)
    assert similar_components(nothing).count() == 0


def test_candidates_grow_with_the_rows(spark):
    """Near copies of one text, and texts with one passage in common, make a few candidates each, however many there are."""
    rng = np.random.default_rng(4)
    base, passage = [f"w{x}" for x in rng.integers(0, 4000, 100)], [f"p{x}" for x in range(80)]
    sizes = []
    for n in (150, 300):
        rows = []
        for i in range(n):
            copy = list(base)
            copy[rng.integers(0, 100)] = f"x{i}"
            rows += [" ".join(copy), " ".join([*passage, *(f"y{x}" for x in rng.integers(0, 1 << 30, 60))])]
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
        found = prefixes(docs)
        stars = common.stored(star_pairs(found), "stars")
        texts = docs.select(F.xxhash64("text").alias("node"), "text")
        sizes.append((stars.count() / n, open_pairs(found, components(verified(stars, texts))).count()))
        assert len({r.root for r in similar_components(docs).collect()}) == n + 1  # one group of copies; the texts with the passage stay apart
    assert all(stars < 4 and left < n for stars, left in sizes), sizes


def test_copies_of_copies_meet_by_sampling(spark, monkeypatch):
    """Copies with a few words left out are near to one another but seldom to a centre: rounds of sampling join them, and few pairs are left for the last step."""
    rng = np.random.default_rng(5)
    base, left = [f"w{x}" for x in rng.integers(0, 4000, 150)], {}
    rows = list({" ".join(np.delete(base, rng.choice(150, int(rng.integers(2, 7)), replace=False))) for _ in range(400)})
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    found = prefixes(docs)
    stars = common.stored(star_pairs(found), "stars")
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    before = open_pairs(found, components(verified(stars, texts))).count()
    kept = jaccard._candidates

    def counted(x, y, condition):
        out = common.stored(kept(x, y, condition), "counted")
        left[condition] = out.count()
        return out

    monkeypatch.setattr(jaccard, "_candidates", counted)
    got = defaultdict(list)
    for r in similar_components(docs).collect():
        got[r.root].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(g) for g in similar_groups(docs.orderBy("doc_id").collect()))
    assert before > 5 * len(rows) and left["x.node < y.node AND x.root <> y.root"] < len(rows), (before, left)


def test_few_open_texts_meet_in_the_last_step(spark, monkeypatch):
    """Many texts that are near to nothing and a few copies of copies: one round of sampling shows that few pairs are open, and no link is lost."""
    rng = np.random.default_rng(6)
    base, rounds = [f"w{x}" for x in rng.integers(0, 4000, 150)], []
    rows = [" ".join(np.delete(base, rng.choice(150, int(rng.integers(2, 7)), replace=False))) for _ in range(60)]
    for i in range(400):  # pairs, so that they are candidates, in 400 groups
        own = [f"y{x}" for x in rng.integers(0, 1 << 30, 40)]
        rows += [" ".join(own), " ".join([*own, f"z{i}"])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(jaccard, "stored", lambda df, label: rounds.append(label) or common.stored(df, label))
    got = defaultdict(list)
    for r in similar_components(docs).collect():
        got[r.root].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(g) for g in similar_groups(docs.orderBy("doc_id").collect()))
    assert rounds.count("sampled-pairs") <= 1


def test_parity_bits_lose_no_pair():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(rng.integers(0, 4)):], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        a = np.unique(a)
        assert int(np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("parts", [4, 3])
def test_pigeonhole_finds_every_link(spark, monkeypatch, parts):
    from spoor.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 40)  # dense groups take the grid of blocks
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for _ in range(900):
        flips = rng.choice(64, rng.integers(0, 7), replace=False)
        prints.add(int(centres[rng.integers(0, 3 if rng.random() < 0.7 else 12)]) ^ sum(1 << int(b) for b in flips))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = components(links(spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(5), parts=parts)).collect()
    root = {r.node: r.root for r in found}
    want = linked(prints)
    groups, own = defaultdict(set), defaultdict(set)
    for p, s in zip(prints, signed, strict=True):
        groups[want[p]].add(s)
        own[root.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_thresholds_follow_the_principle():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 50, (4, 256))
    counts = within(histogram, 8, 3)
    v = 37
    for d in range(4):
        assert counts[2, d, v] == sum(histogram[2, w] for w in range(256) if (v ^ w).bit_count() <= d)
    took = allocate(rng.integers(0, 256, (4, 100)), counts, 8, 3)
    assert (took.sum(0) == 0).all() and took.min() >= -1


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (5, 5), (1002, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1003)}
    a, b = spanning(np.array([5, 3, 9, 9]), np.array([3, 1, 8, 7]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 1, 3: 1, 9: 7, 8: 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_end_at_stars(spark, monkeypatch):
    """No round is spent on learning that nothing moves any more."""
    module, rounds = sys.modules["spoor.llm.components"], []
    monkeypatch.setattr(module, "stored", lambda df, label: rounds.append(label) or common.stored(df, label))
    pairs = [(10 * i, 10 * i + k) for i in range(50) for k in (1, 2)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {10 * i + k: 10 * i for i in range(50) for k in range(3)}
    assert rounds.count("small-stars") == 1


def test_gear_and_chunks():
    raw = np.frombuffer(b"some bytes that roll", np.uint8)
    h = 0
    for i, b in enumerate(raw):
        h = (2 * h + int(gear_table()[b])) & 0xFFFF
        assert h == gear(raw)[i]
    text = LONG[:5000].encode()
    joined, _, a, b = chunk_starts([text], 4)
    moved, _, c, d = chunk_starts([b"inserted words before " + text], 4)
    one, two = {joined[x:y] for x, y in zip(a, b, strict=True)}, {moved[x:y] for x, y in zip(c, d, strict=True)}
    assert b"".join(joined[x:y] for x, y in zip(a, b, strict=True)) == text
    assert len(one - two) <= 2  # an insertion moves no cut beyond it


def test_chunk_dedup(spark, awkward, nothing):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [text(n) for n in (52, 60, 80, 200)]
    rows = [(i, f"{text(80)} {p} {text(80)}") for i, p in enumerate(passages * 4)] + [(100 + i, text(300)) for i in range(20)]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for i, (_, old) in enumerate(rows[:16]):
        new, passage = got[i].text, passages[i % 4].split()
        if i < 4:
            assert new == old
        else:
            left = len(set(new.split()) & set(passage))
            assert left < 0.7 * len(passage) and got[i].repeats
    assert all(got[i].text == t for i, t in rows[16:])
    out = without_repeats(awkward)
    assert sorted(out.columns) == sorted(awkward.columns)
    assert out.count() == awkward.count() and out.where("text IS NULL").count() == awkward.where("text IS NULL").count()
    assert without_repeats(nothing).count() == 0


def test_chunk_dedup_needs_the_passage_in_one_piece(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    target, other = text(200), text(120)
    joined, _, a, b = chunk_starts([target.encode()], 4)
    rows = [(i, f"{text(30)} {joined[x:y].decode()}{text(30)}") for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))]  # each chunk somewhere
    n = len(rows)
    rows += [(n, target), (n + 1, f"{text(40)} {target} {text(40)}"), (n + 2, f"{other} {other}"), (n + 3, " ".join(["same"] * 300))]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[i].text == t for i, t in rows[:n + 1])  # no earlier document has 20 of those words in a row
    assert [r.first_doc for r in got[n + 1].repeats] == [n] and len(set(got[n + 1].text.split()) & set(target.split())) < 40
    assert got[n + 2].text.startswith(other) and len(got[n + 2].text.split()) < 150
    for r in got.values():
        raw = rows[r.doc_id][1].encode()
        assert all(len(raw[s["start"]:s["start"] + s["size"]].split()) >= 20 for s in r.repeats)


def plain_repeats(rows):
    """Texts without the windows that an earlier place has, one document and one window at a time; equal rows are one document."""
    seen, done = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        raw = text.encode()
        joined, _, starts, ends = chunk_dedup.windows([raw], chunk_dedup.MEAN_WORDS, chunk_dedup.MIN_WORDS)
        goes = np.zeros(len(raw), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if joined[a:b] in seen:
                goes[a - chunk_dedup.WINDOW:b - chunk_dedup.WINDOW] = True
            seen.add(joined[a:b])
        done[doc_id, text] = bytes(np.frombuffer(raw, np.uint8)[~goes]).decode()
    return done


def test_chunk_dedup_against_the_plain_rule(spark):
    import random

    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    shared = [say(n) for n in (25, 40, 60, 90)]
    rows = []
    for i in range(80):
        parts = [say(rng.randrange(5, 80)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    twice = f"{say(30)} {shared[2]} {say(30)} {shared[2]}"
    within = say(70)  # a document's own passage, and no other's
    rows += [(None, twice)] * 30 + [(90, f"{within} {say(20)} {within}")] * 20 + rows[:10]
    rng.shuffle(rows)
    want = plain_repeats(rows)
    assert 10 < sum(text != old for (_, old), text in want.items()) < len(want)
    for parts in (1, 7):
        got = without_repeats(spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id bigint, text string, old string").repartition(parts)).collect()
        assert len(got) == len(rows)
        assert all(r.text == want[r.doc_id, r.old] for r in got)
    assert within in want[90, next(t for d, t in rows if d == 90)]  # the first of the two stays


def test_windows_of_equal_rows_leave_once(spark):
    import random

    rng = random.Random(13)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(200))
    docs = lambda n: spark.createDataFrame([(None, f"{text} x {text}")] * n + [(1, text)], "doc_id bigint, text string").repartition(5)
    assert chunk_dedup.repeated_windows(docs(400)).count() <= 2 * chunk_dedup.repeated_windows(docs(1)).count()


def test_chunk_dedup_without_white_space(spark):
    rng = np.random.default_rng(13)
    text = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    passage = text(400)
    rows = [(0, text(100) + passage + text(100)), (1, text(150) + passage + text(50)), (2, text(300)), (3, passage[:20] + text(200))]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(got[i].text == rows[i][1] for i in (0, 2, 3))
    assert 200 <= len(got[1].text) < 270 and [r.first_doc for r in got[1].repeats] == [0]


# Quality and language ------------------------------------------------------------------------------------------

def test_measures():
    for text in (t or "" for t in TEXTS):
        w = words_of(text)
        windows = defaultdict(list)
        for i in range(len(w) - 2):
            windows[tuple(w[i:i + 3])].append(i)
        covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))
        assert measure(text) == want


def test_binomial_bounds():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 3, 0.25), (50, 0, 0.1), (200, 12, 0.05)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert binomial_at_most(k, n, p) == pytest.approx(float(exact))
    assert certified([0, 0, 1], 30, 0.05, 0.05) == 0  # too few to certify anything: 0.95 ** 30 > 0.05
    assert certified([0, 0, 1, 90], 1000, 0.05, 0.05) == 3


def test_false_rejections_are_limited():
    """With true rates just above the risk, a step is certified in about delta of all holdouts at most."""
    rng = np.random.default_rng(2)
    wrong = sum(certified([int(rng.binomial(300, 0.051))], 300, 0.05, 0.05) for _ in range(2000))
    assert wrong < 0.07 * 2000


def test_quality_rules(spark, real, awkward, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = "plain words of even length stand here without any marks at all and they go on for quite some time so that nothing fails "
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "en") for i in range(500)] + [(1000 + i, text + good + " $$$ ### &&&" * 40, "en") for i in range(5)] + [(2000, good, "fr"), (2001, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(500)] + [(1000, 0), (7, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, marks).collect()}
    assert all(got[i].kept for i in range(500)) and got[0].step == 40 and got[2000].step == 0 and got[2000].kept
    assert not any(got[1000 + i].kept for i in range(5)) and got[2001].base_failed and not got[2001].kept
    assert quality_rules(awkward, labels).count() == awkward.count()
    assert quality_rules(nothing, labels).count() == 0
    assert quality_rules(real, labels.limit(0)).where("kept = base_failed").count() == 0


def test_repeated_rows_certify_nothing(spark):
    """Forty good labelled documents are too few, and still forty when every row is there three times."""
    rows = [(i, f"document {i} " + " ".join(f"word{i}x{k}" for k in range(80)), "en") for i in range(40)]
    marks = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    for copies in (1, 3):
        docs = spark.createDataFrame(rows * copies, "doc_id bigint, text string, lang string")
        assert {r.step for r in quality_rules(docs, marks).select("step").distinct().collect()} == {0}


def test_numbers_are_no_letters():
    assert [has_letter(t) for t in ("½ ² ①", "", "12 _ !?", "³é", "語", "Ⅷ")] == [False, False, False, True, True, False]


def test_equal_rows_teach_once(spark):
    """A row that is there ten thousand times comes into the fitting sample once."""
    docs = spark.createDataFrame([(None, "some plain words of a text that is there very often")], "doc_id bigint, text string").crossJoin(spark.range(10_000)).select("doc_id", "text")
    got = weak_labels(docs)
    assert got.count() == 10_000 and got.select("score").distinct().count() == 1


def test_language(spark, real, awkward, nothing):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id(docs).collect() if r.held_out]
    assert len(rows) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hidden = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {(r.doc_id, r.lang_pred) for r in language_id(hidden).collect() if r.held_out} == {(r.doc_id, r.lang_pred) for r in rows}
    for r in language_id(awkward).collect():
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    letters = {r.doc_id for r in awkward.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in language_id(awkward).collect() if r.lang_pred == "und"} - {None} == {r.doc_id for r in awkward.collect()} - letters - {None}
    assert language_id(nothing).count() == 0
    assert {r.lang_pred for r in language_id(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """Null ids, one repeated id and equal rows, each a third of the table, do not enter the sample together."""
    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id",
                                        "CASE WHEN id % 4 = 0 THEN 'equal text' ELSE concat('text ', id) END AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    langs, sample = sampled(rows, 600)
    assert langs == ["de", "en"]
    got = sample.groupBy("lang").count().collect()
    assert all(200 < r["count"] < 400 for r in got) and len(got) == 2


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.7, 0.95, 0.65]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 2, np.where(rng.random(len(truth)) < a, truth, ~truth)) for a in right], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chance, post = label_model(patterns, counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.03)
    assert [chance[j, 1, 1] / (1 - chance[j, 1, 2]) for j in range(5)] == pytest.approx(right, abs=0.04)
    assert np.mean((post[at.ravel()] > 0.5) == truth) > 0.9


def test_weak_labels(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in weak_labels(common.documents(spark, sf)).collect() if r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 1]) > 0.95
    assert weak_labels(awkward).count() == awkward.count()
    assert weak_labels(nothing).count() == 0


# Pipeline ------------------------------------------------------------------------------------------------------

def test_stages(spark, real, awkward, nothing):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "exact", "near", "passages", "packing"]
    docs = common.stored(real.unionByName(real.where("doc_id < 40")), "doubled")
    for name, stage in pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF), "out")
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        if name == "quality":
            verdict = {r.doc_id: r.kept for r in quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if verdict[r.doc_id])
        elif name == "exact":
            groups = exact_groups(before)
            assert sorted(r.doc_id for r in after) == sorted(max(g) for g in groups.values())
        elif name == "near":
            assert sorted(r.doc_id for r in after) == sorted(min(before[i].doc_id for i in g) for g in similar_groups(before))
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before) and all(r.n_chars == len(r.text) for r in after if r.text)
        docs = out
    total = sum(p.length for p in pipeline.packing(spark, docs, SF).collect())
    lib = library(BYTE)
    assert total == sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF)
        assert out.columns == awkward.columns and out.collect() is not None
        assert stage(spark, nothing, SF).count() == 0


@pytest.mark.parametrize("name", ["op5_block_names", "op11_spelling", "op12_fill_in_middle", "op13_decontamination"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()) == Counter(map(tuple, want.fetchall()))
