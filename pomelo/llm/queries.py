"""The registered queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def register(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@register
def op4_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op5_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op3_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@register
def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


@register
def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op1_tree_score_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract
    return extract(table(spark, sf_dir, "pages"))


@register
def op6_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_join import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register
def op8_zip_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archive import archived
    return archived(table(spark, sf_dir, "pages"))


@register
def op2_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))


@register
def op9_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    docs = table(spark, sf_dir, "documents")
    return quality(docs, docs, table(spark, sf_dir, "labels"))


@register
def op12_range_sorted_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digests
    return line_digests(table(spark, sf_dir, "documents"))


SQL["op12_range_sorted_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register
def op13_misra_gries_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


SQL["op13_misra_gries_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
  UNION ALL
  SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM worded WHERE len(w) >= 2
  UNION ALL
  SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM worded WHERE len(w) >= 3),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS lhs, array_to_string(w[2:k], ' ') AS rhs FROM cand
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.n AS l, y.n AS r,
         (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored),
longer AS (
  SELECT lang, phrase, max(a) AS b FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM cand WHERE k = 3
    UNION ALL
    SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score,
         row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM low s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE s.place = 1 AND (g.b IS NULL OR 100 * g.b < 50 * s.a))
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""


@register
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align
    return align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
