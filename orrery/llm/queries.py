"""The queries that apply each operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, crosstok, langid, maxent, orderhash, packing, periodic, quality, rules, simhash, topk, urls
from orrery.llm.common import split_of, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"), width=3, radius=2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs, fold = table(spark, sf_dir, "documents"), split_of("doc_id", 4)
    found = langid.identify(docs, langid.train(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a model of nine tenths of them."""
    fold = split_of("doc_id", 10)
    found = maxent.scored(table(spark, sf_dir, "documents"), fold != 0)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain_per_token"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one with control strings in its texts, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select(*chat.TURN_COLUMNS)
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(control)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences."""
    return packing.packed(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every twentieth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from four fifths of the labels."""
    docs, fold = table(spark, sf_dir, "documents"), split_of("doc_id", 5)
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), fold != 0))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "score", quality.predicted().alias("predicted"), "n_passages")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents and its verdicts."""
    columns = ("doc_id", *rules.MEASURES[:5], "base_failed", "kept", "failed")
    return rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens over all texts, aligned by bytes."""
    return crosstok.aligned(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every text, a tenth of which are made periodic, and the texts without repetitions."""
    return periodic.collapsed(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms."""
    return orderhash.edited_fingerprints(table(spark, sf_dir, "documents"))


_ALL = (op1_simhash, op2_language_id, op3_maxent_scores, op4_chat_windows, op5_url_filter, op6_best_fit_packing, op7_exact_top_k, op8_quality_classifier, op9_quality_rules, op10_byte_bpe, op11_token_alignment, op12_periodic_runs, op13_order_minhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_ANY = lambda terms: "|".join(terms)
_PAGES = """
WITH p AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), q AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM p
), r AS (
  SELECT *, CASE {fits} END AS rule, {strict} AS is_strict, {soft} AS n_soft_terms
  FROM q
)
SELECT page_id, host, path, rule,
       coalesce(CASE {verdicts} END, CASE WHEN is_strict OR n_soft_terms >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST({n_strict} AS INTEGER) AS n_strict, CAST(n_soft_terms AS INTEGER) AS n_soft
FROM r
"""


def _op5_sql() -> str:
    edge = lambda term: f"(^|[^a-z0-9]){term}($|[^a-z0-9])"
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    # A term's neighbours are taken out of the match by doubling every mark between terms.
    count = lambda term: f"len(regexp_extract_all(regexp_replace(coalesce(low, ''), '([^a-z0-9])', '\\1\\1', 'g'), '{edge(term)}'))"
    return _PAGES.format(
        fits=" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in ordered),
        verdicts=" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in ordered),
        strict=f"regexp_matches(coalesce(low, ''), '{edge('(' + _ANY(urls.STRICT) + ')')}')",
        soft=" + ".join(f"CAST(regexp_matches(coalesce(low, ''), '{edge(term)}') AS INTEGER)" for term in urls.SOFT),
        n_strict=" + ".join(count(term) for term in urls.STRICT),
        limit=urls.SOFT_LIMIT,
    )


_OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 4) AS s(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim
  FROM d LEFT JOIN covered c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
), n AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM m
), f AS (
  SELECT *, {failed} AS failed FROM n
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed & {base} <> 0 AS base_failed, failed & {policy} = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""


def _op9_sql() -> str:
    base = rules.policy_bits("base", 1)
    failed = " | ".join(f"CASE WHEN {rule.fails} THEN {1 << rule.bit} ELSE 0 END" for rule in rules.RULES)
    return _OP9_SQL.replace("{failed}", failed).replace("{base}", str(base)).replace("{policy}", str(base | rules.policy_bits("web", 2)))


ORACLES: dict[str, str] = {"op5_url_filter": _op5_sql(), "op7_exact_top_k": _OP7_SQL, "op9_quality_rules": _op9_sql()}
