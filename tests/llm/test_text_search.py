"""Spelling variants, fill-in-the-middle and phrase search against plain versions, on real and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spoor.llm import common
from spoor.llm.fill_middle import UNITS, WaveletMatrix, fill_in_middle, restored
from spoor.llm.phrase_index import LONGEST, index_segments, matched_documents, phrases, search
from spoor.llm.spelling import Acceptor, document_words, near_words, spelling_variants, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, row int, word string, n bigint, segment bigint, place int, items string, spans string, cell string, form string, output string, "
          "item string, phrase string, start int")
LONG = " ".join(f"wort{i % 977} {i}.\n" for i in range(20_000))
TEXTS = ["", None, "One two Three four five six seven eight nine ten eleven", "one two three FOUR five six seven eight nine ten", "  \n\t ", "a\n\nb\n", "no end", "\n", "x" * 70_000, LONG, LONG + " end",
         "colour colour colour color color colours couleur été Été ÉTÉ×÷ straße", "a <P> b\nc\n", "日本語 のテキスト\n123. 45.6!\n𝒳𝒴 z", "tail\r\nword", "a", "a", "lines\nand <S\nmore>\n"]


@pytest.fixture(scope="module")
def awkward(spark):
    common.importable(spark)
    blank = (None,) * 13
    rows = [(i, t, "en", *blank) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, *blank), (9, LONG, None, *blank), (3, "other text", None, *blank), (None, "one two three\nfour", None, *blank), (None, None, None, *blank)]
    return common.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "awkward")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    common.importable(spark)
    return common.documents(spark, SF)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Fill in the middle ---------------------------------------------------------------------------------------------

def test_wavelet_matrix():
    codes = np.random.default_rng(1).integers(0, 4, 1000).astype(np.uint8)
    matrix = WaveletMatrix(codes, 2)
    places = np.arange(1001)
    for code in range(4):
        assert matrix.rank(code, places).tolist() == [int((codes[:i] == code).sum()) for i in places]
        at = np.flatnonzero(codes == code)
        assert matrix.select(code, np.arange(len(at))).tolist() == at.tolist()
    both = np.flatnonzero(codes >= 2)
    assert matrix.locate((2, 3), np.arange(len(both))).tolist() == both.tolist()
    assert WaveletMatrix(np.zeros(0, np.uint8), 2).rank(1, np.zeros(1, np.int64)).tolist() == [0]


ENDS = {"line": "[^\n]*\n|[^\n]+", "sentence": "[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": "[^ \t\r\f\v\n]*[ \t\r\f\v\n]|[^ \t\r\f\v\n]+"}


def filled(doc_id, text, pattern, seed, rate, spm):
    text = text or ""
    units = re.findall(pattern, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < spm else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return doc_id, len(units), out[0], len(pre), len(mid), out[1]


@pytest.mark.parametrize("unit", list(UNITS))
def test_fill_in_middle(awkward, real, nothing, unit):
    for docs, options in ((awkward, (7, 100, 50)), (awkward, (8, 60, 20)), (real, (7, 100, 50))):
        rows = fill_in_middle(docs, unit, *options)
        assert Counter(map(tuple, rows.collect())) == Counter(filled(r.doc_id, r.text, ENDS[unit], *options) for r in docs.collect())
        texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
        assert Counter(map(tuple, rows.select("doc_id", restored(rows["output"], rows["form"])).collect())) == texts
    assert fill_in_middle(nothing, unit).count() == 0


# Phrases --------------------------------------------------------------------------------------------------------

def searched(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded(text))


def matched(docs, items, window, slop=0):
    """Every start of every phrase tried on every document."""
    wanted = {}
    for item, text in items:
        words = searched(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            wanted.setdefault(tuple(words[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words, hit, names = searched(text), set(), set()
        for phrase, own in wanted.items():
            for at in range(-slop, len(words) + slop):
                if all(any(0 <= p < len(words) and words[p] == w for p in range(at + k - slop, at + k + slop + 1)) for k, w in enumerate(phrase)):
                    names |= own
                    hit |= set(range(max(0, at - slop), min(len(words), at + len(phrase) + slop)))
        out.append((doc_id, len(words), len(hit), tuple(sorted(names))))
    return Counter(out)


def answered(rows):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows.collect())


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_phrases_against_every_start(spark, slop):
    rng = random.Random(slop)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 12, 40])))) for i in range(40)]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 4, 6])))) for k in [*range(12), 3, 5]] + [(None, "a b c d"), (None, "dd")]
    got = matched_documents(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), 4, slop, segment_chars=100, block_rows=5)
    assert answered(got) == matched(docs, items, 4, slop)


def test_phrases_on_awkward_rows(spark, awkward, nothing):
    items = [(10, TEXTS[3].title()), (9, "one, two; three"), (1, LONG[5_000:6_000]), (1, "end"), (100, "z" * (LONGEST + 9)), (101, "x" * 70_000), (None, "日本語 のテキスト 123"), (2, None), (3, " .\n"), (7, "𝒳𝒴")]
    shape = "item_id bigint, text string, doc_id int, phrase string, item string"
    table = spark.createDataFrame([(*i, 1, "p", "i") for i in items], shape)
    docs = [(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 100_000]
    small = awkward.where("text IS NULL OR length(text) < 100000")
    assert answered(matched_documents(small, table)) == matched(docs, items, 10)
    long = {(r.doc_id, r.n_words, r.n_hit > 0, tuple(r["items"])) for r in matched_documents(awkward.where("length(text) >= 100000"), table).collect()}
    assert long == {(9, 40_000, True, ("1",)), (10, 40_001, True, ("1",))}
    assert matched_documents(nothing, table).count() == 0
    assert answered(matched_documents(small, spark.createDataFrame([], shape))) == matched(docs, [], 10)


def test_spans_and_index(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    segments = index_segments(real, 100_000)
    assert segments.count() > 1
    hits = search(segments, phrases(bench), block_rows=300)
    whole = matched_documents(real, bench)
    assert hits.count() == whole.where("n_hit > 0").count() > 0
    for r in whole.where("n_hit > 0").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


# Spelling -------------------------------------------------------------------------------------------------------

def are_near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    same = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return x[same + (len(x) >= len(y)):] == y[same + (len(y) >= len(x)):]


def variants(words):
    """All pairs of words compared; ``words`` maps each to its count."""
    near = {x: [y for y in words if are_near(x, y)] for x in words}
    form = {}
    for x, others in near.items():
        best = min(others, key=lambda y: (-words[y], y), default=None)
        form[x] = best if best is not None and words[best] >= 5 * words[x] else None
    out = Counter()
    for x in words:
        root = x
        while form[root] is not None:
            root = form[root]
        out[(x, words[x], len(near[x]), form[x], words[form[x]] if form[x] else None, root)] += 1
    return out


def counted(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = folded(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def test_acceptor():
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(random.Random(i).randint(1, 6))) for i in range(300)})
    acceptor = Acceptor(words)
    assert acceptor.size[acceptor.start] == len(words)
    for rank, word in enumerate(words):
        state, at = acceptor.start, 0
        for letter in word:
            state, offset = acceptor.arcs[state][letter]
            at += offset
        assert at == rank and acceptor.final[state]
    assert len(set(map(lambda k: (acceptor.final[k], tuple(acceptor.arcs[k].items())), range(len(acceptor.arcs))))) == len(acceptor.arcs)


@pytest.mark.parametrize("limit", [1, 60, 200_000])
def test_near_words_against_all_pairs(spark, limit):
    """Few letters, so that runs of one letter, drops at several places and both halves occur; small limits split partitions letter by letter."""
    rng = random.Random(7)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(6, 9))): rng.randint(5, 400) for _ in range(250)}
    words |= {"colour": 90, "colours": 10}
    if limit > 1000:  # beyond any recursion
        words |= {"q" * 2000: 9, "q" * 1999: 50, "q" * 1998 + "r": 300}
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = {x: [y for y in words if are_near(x, y)] for x in words}
    got = near_words(rows, limit, few=1).collect()
    assert len(got) == len(words)
    for r in got:
        best = min(want[r.word], key=lambda y: (-words[y], y), default=None)
        assert (r.n, r.n_near, r.best, r.best_n) == (words[r.word], len(want[r.word]), best, words.get(best)), r.word


def test_spelling_variants(spark, real, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in real.collect()]
    words = counted(docs)
    assert {r.word: r.n for r in vocabulary(real).collect()} == words
    got = spelling_variants(real)
    assert Counter(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == variants(words)
    assert spelling_variants(nothing).count() == 0
    doubled = awkward.unionByName(awkward).unionByName(awkward).unionByName(awkward).unionByName(awkward)
    words = counted([(r.doc_id, r.text) for r in doubled.collect()])
    assert "x" * 70_000 in words and "été×÷" not in words
    assert Counter(map(tuple, spelling_variants(doubled).select("word", "n", "n_near", "form", "form_n", "root").collect())) == variants(words)


def test_a_letter_left_out():
    drops = [list(document_words(i, "wonderful wonderful")) for i in range(1000)]
    h = [zlib.crc32(f"{i}:wonderful".encode()) for i in range(1000)]
    assert drops == [[("wonderful"[:x % 9] + "wonderful"[x % 9 + 1:] if x % 199 == 0 else "wonderful").encode()] and [(("wonderful"[:x % 9] + "wonderful"[x % 9 + 1:] if x % 199 == 0 else "wonderful").encode(), 2)] for x in h]
    assert any(x % 199 == 0 for x in h)


def test_roots_follow_chains(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abgggg": 3125, "zzzzzz": 5}
    text = " ".join(f"{w} " * n for w, n in words.items())
    got = spelling_variants(spark.createDataFrame([(None, text)], "doc_id bigint, text string"))
    assert Counter(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == variants(counted([(None, text)]))
