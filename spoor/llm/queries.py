"""Registered queries of the corpus operators, with production parameters over whole tables, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.importable(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    run.__name__ = fn.__name__
    run.__module_tag__ = "llm"
    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as compressed bit planes, written and read back."""
    from spoor.llm.token_planes import token_planes

    return token_planes(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


@query
def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, packed along a Hilbert curve through hashed document vectors."""
    from spoor.llm.hilbert_packing import hilbert_packing

    return hilbert_packing(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=1)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, huge ones by overlapping chunks."""
    from spoor.llm.token_counts import token_counts

    return token_counts(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op5_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies, up to the case of A-Z, by names of blocks."""
    from spoor.llm.block_names import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir)).drop("text_key")


ORACLES["op5_block_names"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints over 3-word shingles and their components at three differing bits."""
    from spoor.llm.simhash import simhash_components

    return simhash_components(common.documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that an earlier document (or place) has, and what was cut."""
    from spoor.llm.chunk_dedup import without_repeats

    rows = without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "text", "repeats", F.size("repeats").alias("n_repeats"),
                       F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["size"]).alias("repeated_bytes"))


@query
def op2_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules whose cutoffs are certified on labelled documents, by language."""
    from spoor.llm.risk_rules import quality_rules

    rows = quality_rules(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "first_step", "step")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: family first, then one-versus-one machines within it."""
    from spoor.llm.lang_id import language_id

    return language_id(common.documents(spark, sf_dir))


@query
def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: posterior of overlapping heuristics, and the linear scorer that it trains."""
    from spoor.llm.weak_labels import weak_labels

    return weak_labels(common.documents(spark, sf_dir))


@query
def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document by batched Viterbi search, decoded again."""
    from spoor.llm.piece_viterbi import piece_ids

    return piece_ids(common.documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words and the forms they vary, by composed acceptors."""
    from spoor.llm.spelling import spelling_variants

    return spelling_variants(common.documents(spark, sf_dir))


# crc32 byte by byte over all distinct (document, run); near words by the letters left out of them
ORACLES["op11_spelling"] = f"""
WITH RECURSIVE bits AS (SELECT b::UBIGINT AS b, 0 AS k, b::UBIGINT AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, xor(c >> 1, 3988292384::UBIGINT * (c & 1)) FROM bits WHERE k < 8),
crc AS (SELECT b, c FROM bits WHERE k = 8),
tokens AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{common.UPPER}', '{common.LOWER}') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS raw FROM tokens WHERE length(run) >= 6 GROUP BY ALL),
fold AS (SELECT doc_id, run, n, raw, 0 AS pos, 4294967295::UBIGINT AS c FROM runs
  UNION ALL SELECT doc_id, run, n, raw, pos + 1, xor(f.c >> 8, crc.c) FROM fold f
  JOIN crc ON crc.b = xor(f.c & 255, concat('0x', substr(raw, 2 * pos + 1, 2))::UBIGINT) WHERE 2 * pos < length(raw)),
hashed AS (SELECT run, n, xor(c, 4294967295::UBIGINT) AS h FROM fold WHERE 2 * pos = length(raw)),
words AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
half AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
  UNION SELECT a.word, v.word FROM cut a JOIN v ON a.rest = v.word),
pair AS (SELECT x, y FROM half UNION SELECT y, x FROM half),
near AS (SELECT x, count(*) AS n_near, max(v.n) AS top, arg_min(y, (-v.n, y)) AS best FROM pair JOIN v ON y = v.word GROUP BY x),
rows AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN best END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n
  FROM v LEFT JOIN near ON x = v.word),
chain AS (SELECT word, word AS root, 0 AS depth FROM rows UNION ALL SELECT c.word, r.form, depth + 1 FROM chain c JOIN rows r ON r.word = c.root WHERE r.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM rows JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) USING (word)"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of every document, cut between lines, and the texts put together again."""
    from spoor.llm.fill_middle import fill_in_middle, restored

    rows = fill_in_middle(common.documents(spark, sf_dir))
    digest = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


ORACLES["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS units, sha256(concat('7:', doc_id)) AS h FROM documents),
k AS (SELECT *, len(units) AS n, concat('0x', h[1:8])::BIGINT % (len(units) + 1) AS a, concat('0x', h[9:16])::BIGINT % (len(units) + 1) AS b,
  concat('0x', h[25:32])::BIGINT % 100 < 50 AS spm, body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') AS plain FROM t),
p AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(units[greatest(a, b) + 1:], '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN body WHEN spm THEN concat('<S>', suf, '<P>', pre, '<M>', mid) ELSE concat('<P>', pre, '<S>', suf, '<M>', mid) END) AS output_sha256,
  sha256(body) AS restored_sha256 FROM p"""


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of every document that runs of ten benchmark words hit, from a positional index of all documents."""
    from spoor.llm.phrase_index import matched_documents

    rows = matched_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op13_decontamination"] = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT row, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM split, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size)),
found AS (SELECT row, i, p.size, item FROM places p JOIN grams g ON p.size = g.size AND p.gram = g.gram),
words AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT row, i, size FROM found)) GROUP BY row),
named AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM split LEFT JOIN words USING (row) LEFT JOIN named USING (row)"""
