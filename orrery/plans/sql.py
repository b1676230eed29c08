"""The queries of `orrery.plans.queries` in SQL, for those that SQL can express."""

from __future__ import annotations

from orrery.functions.text import BETWEEN, QUESTION_WORDS, REVIEW_WORDS, SPACES, STOP_WORDS
from orrery.plans.queries import OTHER_RUNS, RUNS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array(lower({x}), {_quoted(BETWEEN)}), lambda w: w <> '')"
    return f"coalesce(nullif({parts}, CAST([] AS VARCHAR[])), [''])"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {_quoted(f'[{SPACES}]+')}), lambda w: w <> '')"


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_ITEMS = "items AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark)"
_BIB = """bib AS (
  SELECT p_partkey - 1 AS doc_id, p_partkey % 17 <> 0 AS has_record, CASE WHEN p_partkey % 17 <> 0 THEN count(l_partkey) END AS citations,
         CASE WHEN p_partkey % 17 <> 0 THEN max(year(l_shipdate)) END AS year, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS venue
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_brand)"""
_VECTORS = {False: "(SELECT vec_id AS id, embedding FROM embeddings)", True: "(SELECT CASE WHEN vec_id > 0 THEN vec_id - 1 ELSE (SELECT max(vec_id) FROM embeddings) END AS id, embedding FROM embeddings)"}


def _papers(second: bool = False) -> str:
    return f"""{_DOCS}, {_BIB}, papers AS (
  SELECT d.doc_id, d.text, e.embedding, b.citations, b.year, b.venue
  FROM docs d JOIN {_VECTORS[second]} e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.id LEFT JOIN bib b ON b.doc_id = d.doc_id)"""


def _topics(second: bool = False) -> str:
    return f"{_ITEMS}, topics AS (SELECT query_id, text, embedding FROM items JOIN {_VECTORS[second]} e ON query_id % (SELECT count(*) FROM embeddings) = e.id)"


_PAPERS, _TOPICS = _papers(), _topics()


def _bm25(docs: str, queries: str) -> str:
    return f"""tok AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS t FROM {docs}),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM tok) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM {queries}) GROUP BY query_id, term),
mean AS (SELECT avg(len(t)) AS m FROM tok),
met AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score
  FROM tf JOIN idf USING (term) JOIN qt USING (term), mean GROUP BY query_id, doc_id),
bm AS (SELECT q.query_id, d.doc_id, coalesce(score, 0) AS score FROM {queries} q CROSS JOIN {docs} d LEFT JOIN met ON met.query_id = q.query_id AND met.doc_id = d.doc_id)"""


def _ranked(name: str, source: str, by: str, score: str = "score", top: int = 100) -> str:
    return f"{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, doc_id) AS INTEGER) AS rank FROM {source} QUALIFY rank <= {top})"


def _qrels(docs: str, queries: str) -> str:
    runs = lambda key, rel: f"(SELECT DISTINCT {key}, array_to_string(w[i:i+7], ' ') AS run FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 7)) AS i FROM (SELECT {key}, {_words('lower(text)')} AS w FROM {rel}) WHERE len(w) >= 8))"
    return f"""qrels AS (SELECT DISTINCT query_id, p.doc_id, CASE WHEN l.quality = 1 THEN 2 ELSE 1 END AS gain
  FROM {runs('doc_id', docs)} p JOIN {runs('query_id', queries)} q USING (run) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = p.doc_id)"""


def _measured(run: str, queries: str, by: str = "method") -> str:
    share = lambda k: f"CASE WHEN n_rel > 0 THEN coalesce(h{k}, 0) / n_rel ELSE 0.0 END AS r{k}"
    hits = ", ".join(f"sum(CASE WHEN rank <= {k} AND gain >= 1 THEN 1 ELSE 0 END) AS h{k}" for k in (1, 5, 10))
    return f"""ideal AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN pos <= 10 THEN gain / log2(pos + 1) END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS pos FROM qrels WHERE gain >= 1) GROUP BY query_id),
found AS (SELECT {by}, r.query_id, {hits}, sum(CASE WHEN rank <= 10 THEN coalesce(gain, 0) / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN gain >= 1 THEN rank END) AS first
  FROM {run} r LEFT JOIN qrels g ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY {by}, r.query_id),
measured AS (SELECT w.{by}, q.query_id, {share(1)}, {share(5)}, {share(10)}, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0.0 END AS n10, coalesce(1.0 / first, 0.0) AS mrr
  FROM {queries} q CROSS JOIN (SELECT DISTINCT {by} FROM {run}) w LEFT JOIN found f ON f.query_id = q.query_id AND f.{by} = w.{by} LEFT JOIN ideal i ON i.query_id = q.query_id)"""


_FOUR = "%.4f"
_MEASURES = ("r1", "r5", "r10", "n10", "mrr")
_EACH = ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)
_MEAN = ", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEASURES) + ", count(*) AS n_queries"

_SIGNALS = f"""base AS (SELECT doc_id, text, coalesce(citations, 0) AS citations, nullif(year, 0) AS year, coalesce(venue, '') AS venue FROM papers),
whole AS (SELECT max(ln(1 + citations)) AS most, CAST(trunc(median(year)) AS INTEGER) AS mid FROM base),
venues AS (SELECT venue, avg(citations) AS m FROM base GROUP BY venue),
signals AS (SELECT doc_id, ln(1 + citations) / (most + 1e-9) AS c, exp(-0.1 * (2024 - coalesce(year, mid))) AS r,
    CASE WHEN (SELECT max(m) - min(m) FROM venues) > 1e-12 THEN (m - (SELECT min(m) FROM venues)) / (SELECT max(m) - min(m) FROM venues) ELSE 0.0 END AS v, len({_tokens('text')}) AS len
  FROM base JOIN venues USING (venue), whole)"""
def _scored(second: bool = False, queries: str = "topics", extra: str = "") -> str:
    return f"""{_papers(second)}, {_topics(second)}, {extra}{_bm25('papers', queries)}, {_SIGNALS},
pairs AS (SELECT t.query_id, p.doc_id, list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS s_de, b.score AS s_bm
  FROM {queries} t CROSS JOIN papers p JOIN bm b ON b.query_id = t.query_id AND b.doc_id = p.doc_id),
edged AS (SELECT *, min(s_de) OVER q AS a, max(s_de) OVER q AS b, min(s_bm) OVER q AS m, max(s_bm) OVER q AS n FROM pairs WINDOW q AS (PARTITION BY query_id)),
scored AS (SELECT query_id, doc_id, s_bm, s_de, CASE WHEN n - m > 1e-12 THEN (s_bm - m) / (n - m) ELSE 0.0 END AS bm, CASE WHEN b - a > 1e-12 THEN (s_de - a) / (b - a) ELSE 0.0 END AS de, c, r, v, len
  FROM edged JOIN signals USING (doc_id))"""


_SCORED = _scored()
_METHODS = {
    "BM25": "s_bm", "SBERT-Dense": "s_de", "Neural-Hybrid": "0.5 * bm + 0.5 * de", "Alpha-Hybrid": "0.6 * bm + 0.4 * de",
    "UMA-RAG": "0.6 * bm + 0.4 * de + 0.1 * v + 0.1 * c", "LP-RAG": "(0.6 * bm + 0.4 * de) * (1 + 0.2 * exp(-len / 5000.0))",
}


def _reranked(grid: str) -> str:
    return f"""grid AS (SELECT * FROM (VALUES {grid}) g(variant, alpha, beta, gamma)),
content AS (SELECT alpha, query_id, doc_id, c, r, alpha * bm + (1 - alpha) * de AS content FROM scored, (SELECT DISTINCT alpha FROM grid)),
{_ranked('candidates', 'content', 'alpha, query_id', 'content')},
again AS (SELECT variant, query_id, doc_id, content + beta * c + gamma * r AS score FROM candidates JOIN grid USING (alpha)),
{_ranked('reranked', 'again', 'variant, query_id')}"""


def _row(name: str, alpha: float, beta: float, gamma: float) -> str:
    return f"('{name}', CAST({alpha} AS DOUBLE), CAST({beta} AS DOUBLE), CAST({gamma} AS DOUBLE))"


def _runs(second: bool = False, queries: str = "topics", extra: str = "") -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, doc_id, {s} AS score FROM scored" for m, s in _METHODS.items())
    return f"""{_scored(second, queries, extra)}, each AS ({each}),
{_ranked('whole_runs', 'each', 'method, query_id')}, {_reranked(_row('CA-HR', 0.6, 0.15, 0.1))},
runs AS (SELECT method, query_id, doc_id, score, rank FROM whole_runs UNION ALL SELECT variant, query_id, doc_id, score, rank FROM reranked)"""


_RUNS = _runs()
_ABLATION = [("full", 0.6, 0.15, 0.1), ("no_citation", 0.6, 0.0, 0.1), ("no_recency", 0.6, 0.15, 0.0), ("sparse_only", 1.0, 0.15, 0.1), ("dense_only", 0.0, 0.15, 0.1), ("content_only", 0.6, 0.0, 0.0)]
_GRID = [(f"{b:.2f}/{g:.2f}", 0.6, b, g) for b in (0.0, 0.05, 0.10, 0.15, 0.20, 0.30) for g in (0.0, 0.05, 0.10, 0.15, 0.20)] + [("hybrid", 0.5, 0.0, 0.0)]
_ACTIONS = [("none", 0.0, 0.0)] + [(f"citation:{w:.2f}", w, 0.0) for w in (0.05, 0.10, 0.15, 0.20, 0.30)] + [(f"recency:{w:.2f}", 0.0, w) for w in (0.05, 0.10, 0.15, 0.20)]
_BASES = {False: {"SBERT-Dense": 0.0, "Neural-Hybrid": 0.5}, True: {"BGE-Dense": 0.0, "BGE-Hybrid": 0.5}}


def _variants(rows: list[tuple], second: bool = False) -> str:
    return f"WITH {_scored(second)}, {_reranked(', '.join(_row(*r) for r in rows))}, {_qrels('papers', 'topics')}, {_measured('reranked', 'topics', 'variant')}"


def _actions() -> str:
    """Measures of all actions on all bases, as a table `acted`."""
    parts = [f"SELECT * FROM ({_variants([(f'{b}|{n}', alpha, c, r) for b, alpha in bases.items() for n, c, r in _ACTIONS], second)} SELECT split_part(variant, '|', 1) AS base, split_part(variant, '|', 2) AS action, query_id, n10 FROM measured)" for second, bases in _BASES.items()]
    return f"WITH acted AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_A = f"WITH {_DOCS}, {_ITEMS}, {_bm25('docs', 'items')}, {_ranked('run', 'bm', 'query_id')}"
_A_MEASURED = f"{_A}, one AS (SELECT 'BM25' AS method, * FROM run), {_qrels('docs', 'items')}, {_measured('one', 'items')}"
_ALL_MEASURED = f"WITH {_RUNS}, {_qrels('papers', 'topics')}, {_measured('runs', 'topics')}"
_LONG = "told AS (UNPIVOT (SELECT method, query_id, r1, r5, r10, n10, mrr FROM measured) ON r1, r5, r10, n10, mrr INTO NAME measure VALUE value)"
_DIFFS = f"{_ALL_MEASURED}, {_LONG}, diffs AS (SELECT m.method, m.measure, m.query_id, o.value - m.value AS diff FROM told m JOIN told o ON o.method = 'CA-HR' AND m.method <> 'CA-HR' AND o.query_id = m.query_id AND o.measure = m.measure)"
_DENSE = f"""WITH vq AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
dots AS (SELECT query_id, vec_id AS doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM vq q JOIN embeddings e ON query_id <> vec_id), {_ranked('run', 'dots', 'query_id')}"""


def _unit(seed: str, key: str, i: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {seed}, {key}, {i})), 1, 8)) AS BIGINT) / 4294967296.0"


def _dropped(share: float, table: str = "items") -> str:
    kept = f"list_filter({_words('text')}, lambda x, i: {_unit('42', f'{table}.query_id', 'i - 1')} > {share})"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {_words('text')}[1:1] END, ' ')"


_TIED = "CAST(sum(ties) OVER (PARTITION BY {by} ORDER BY {v} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE)"
_SIDE = lambda name, test: f"median(CASE WHEN {test} THEN citations END) AS median_{name}, round(avg(CASE WHEN {test} THEN citations END), 6) AS mean_{name}"
_RECORDS = """records AS (SELECT conv_id AS query_id, turn, system, 'd' || (conv_id % 3) AS dataset,
    list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, '') || ' [' || (conv_id + turn + 2 * s) % 7 || '] [' || (conv_id * 3 + turn + 2 * s) % 7 || ']', '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 5)) AS n,
    CASE WHEN turn % 3 <> 0 THEN (conv_id + s) % 5 + 1 END AS relevance, CASE WHEN turn % 3 <> 0 THEN (turn + conv_id * s) % 5 + 1 END AS faithfulness
  FROM conversations, (VALUES (0, 'plain'), (1, 'guided')) g(s, system) WHERE role = 'assistant'),
cited AS (SELECT *, len(n) AS n_citations, CASE WHEN len(n) > 0 THEN len(list_filter(n, lambda x: (query_id + x - 1) % 2 = 0)) / len(n) END AS citation_precision FROM records)"""
_SUMMARY = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, count({m}) AS {m}_n" for m in ("relevance", "faithfulness", "citation_precision", "n_citations"))
_CONTEXT = """contexts AS (SELECT {by}, string_agg(doc_id, ',' ORDER BY rank) AS doc_ids, list(doc_id) AS ids, string_agg('[' || rank || '] ' || shown, chr(10) || chr(10) ORDER BY rank) AS context
    FROM {run} JOIN (SELECT doc_id, substr(coalesce(source, '') || '. ' || coalesce(text, ''), 1, 1200) AS shown FROM documents) USING (doc_id) WHERE rank <= 5 GROUP BY {by})"""
_W = _words("text")
_PER = f"greatest(len({_W}), 1)"

_SIGNED = """kept AS (SELECT *, round(abs(diff), 12) AS size FROM {source} WHERE abs(diff) > 1e-15), vals AS (SELECT {by}, size, count(*) AS ties FROM kept GROUP BY {by}, size),
  rk AS (SELECT *, coalesce(CAST(sum(ties) OVER (PARTITION BY {by} ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) + (ties + 1) / 2 AS avg_rank FROM vals),
  s AS (SELECT {by}, sum(CASE WHEN diff > 0 THEN avg_rank ELSE 0 END) AS w_plus, count(*) AS n, sum(ties * ties - 1) AS tie_term FROM kept JOIN rk USING ({by}, size) GROUP BY {by}),
  tested AS (SELECT *, CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48 > 0 THEN (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48) ELSE 0 END AS z FROM s)"""

ORACLES: dict[str, str] = {
    "doc_length_stats": f"WITH {_DOCS}, n AS (SELECT len({_tokens('text')}) AS n FROM docs) SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_len, CAST(min(n) AS INTEGER) AS min_len, CAST(max(n) AS INTEGER) AS max_len, median(n) AS median_len FROM n",
    "bm25_idf": f"""WITH {_DOCS}, each AS (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM docs), n AS (SELECT count(*) AS n FROM docs),
      raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM each, n GROUP BY term), mean AS (SELECT avg(raw) AS m FROM raw)
      SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END, 6) AS idf FROM raw, mean""",
    "bm25_topk": f"{_A} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run",
    "bm25_indexed_topk": f"{_A} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run",
    "judgements": f"WITH {_DOCS}, {_ITEMS}, {_qrels('docs', 'items')} SELECT query_id, doc_id, gain FROM qrels",
    "bm25_metrics_per_query": f"{_A_MEASURED} SELECT method, query_id, {_EACH} FROM measured",
    "bm25_metrics_mean": f"{_A_MEASURED} SELECT method, {_MEAN} FROM measured GROUP BY method",
    "dense_topk": f"{_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run",
    "dense_metrics_mean": f"{_DENSE}, one AS (SELECT 'Dense' AS method, * FROM run), qrels AS (SELECT query_id, vec_id AS doc_id, 1 AS gain FROM vq q JOIN embeddings e ON q.label = e.label AND query_id <> vec_id), {_measured('one', 'vq')} SELECT method, {_MEAN} FROM measured GROUP BY method",
    "metadata_signals": f"WITH {_PAPERS}, {_SIGNALS} SELECT doc_id, round(c, 6) AS c, round(r, 6) AS r, round(v, 6) AS v, CAST(len AS INTEGER) AS len FROM signals",
    **{name: f"WITH {_runs(True)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM runs WHERE method = '{method}'" for name, method in OTHER_RUNS.items()},
    **{name: f"WITH {_RUNS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM runs WHERE method = '{method}'" for name, method in RUNS.items()},
    **{name: f"WITH {_scored(second)}, fused AS (SELECT query_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(s_bm, 9) DESC, doc_id) - 1) + 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(s_de, 9) DESC, doc_id) - 1) AS score FROM scored), {_ranked('run', 'fused', 'query_id')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run" for name, second in (("rrf_topk", False), ("second_rrf_topk", True))},
    "metrics_per_query": f"{_ALL_MEASURED} SELECT method, query_id, {_EACH} FROM measured",
    "metrics_mean": f"{_ALL_MEASURED} SELECT method, {_MEAN} FROM measured GROUP BY method",
    "oracle_routed": f"""{_ALL_MEASURED}, chosen AS (SELECT * FROM measured WHERE method IN ('UMA-RAG', 'LP-RAG', 'CA-HR')),
      singles AS (SELECT method, avg(n10) AS m FROM chosen GROUP BY method), best AS (SELECT avg(b) AS o FROM (SELECT max(n10) AS b FROM chosen GROUP BY query_id))
      SELECT method AS best_single, round(m, 6) AS best_mean, round(o, 6) AS oracle, round(o - m, 6) AS headroom FROM singles, best ORDER BY round(m, 9) DESC, list_position(['UMA-RAG', 'LP-RAG', 'CA-HR'], method) LIMIT 1""",
    "ablation_grid": f"{_variants(_ABLATION)} SELECT variant, {_MEAN} FROM measured GROUP BY variant",
    "sensitivity_grid": f"{_variants(_GRID, True)} SELECT variant, {_MEAN} FROM measured GROUP BY variant",
    "action_outcomes": f"{_actions()} SELECT base, action, query_id, round(n10, 6) AS outcome FROM acted",
    "action_archive": f"{_actions()} SELECT a.query_id, a.base, a.action, round(a.n10, 6) AS outcome, round(f.n10, 6) AS fallback FROM acted a JOIN acted f ON f.query_id = a.query_id AND f.base = a.base AND f.action = 'none' WHERE a.action <> 'none'",
    "archive_audit": f"{_actions()}, per AS (SELECT base, query_id, count(*) AS n, count(DISTINCT action) AS parts FROM acted WHERE action <> 'none' GROUP BY base, query_id) SELECT base, count(*) AS n_queries, bool_and(n = 9 AND parts = 9) AS complete, (SELECT count(DISTINCT action) FROM acted a WHERE a.base = per.base AND action <> 'none') AS n_parts FROM per GROUP BY base",
    "content_results": f"{_actions()} SELECT query_id, {', '.join(f'round(max(n10) FILTER (base = {_quoted(b)}), 6) AS {b.lower().replace(chr(45), chr(95))}' for bases in _BASES.values() for b in bases)} FROM acted WHERE action = 'none' GROUP BY query_id",
    "reconstruction_check": f"{_ALL_MEASURED}, own AS (SELECT query_id, n10 AS released FROM measured WHERE method = 'Neural-Hybrid'), rebuilt AS (SELECT * FROM ({_actions()} SELECT query_id, n10 AS rebuilt FROM acted WHERE base = 'Neural-Hybrid' AND action = 'none')), t AS (SELECT count(*) AS n_queries, abs(avg(rebuilt - released)) AS s, avg(CAST(abs(rebuilt - released) > 1e-9 AS INTEGER)) AS m FROM own JOIN rebuilt USING (query_id)) SELECT n_queries, round(s, 6) AS mean_shift, round(m, 6) AS mismatches, s <= 1e-3 AND m <= 0.01 AS ok FROM t",
    "metrics_by_dataset": f"{_ALL_MEASURED}, sets AS (SELECT 'd' || (query_id % 3) AS dataset, method, {', '.join(f'avg({m}) AS {m}' for m in _MEASURES)}, count(*) AS n_queries FROM measured GROUP BY 1, method) SELECT dataset, method, {_EACH}, n_queries FROM sets UNION ALL SELECT 'macro', method, {', '.join(f'round(avg({m}), 6)' for m in _MEASURES)}, CAST(sum(n_queries) AS BIGINT) FROM sets GROUP BY method",
    "oracle_measures": f"{_ALL_MEASURED}, {_LONG}, c AS (SELECT * FROM told WHERE method IN ('UMA-RAG', 'LP-RAG', 'CA-HR')), o AS (SELECT measure, avg(b) AS o FROM (SELECT measure, query_id, max(value) AS b FROM c GROUP BY measure, query_id) GROUP BY measure), s AS (SELECT measure, max(m) AS m FROM (SELECT measure, method, avg(value) AS m FROM c GROUP BY measure, method) GROUP BY measure) SELECT measure, round(o, 6) AS oracle, round(m, 6) AS best_mean, round(o - m, 6) AS headroom FROM o JOIN s USING (measure)",
    "relative_gains": f"{_ALL_MEASURED}, {_LONG}, m AS (SELECT method, measure, avg(value) AS v FROM told GROUP BY method, measure) SELECT a.method, a.measure, round(o.v, 6) AS own, round(a.v, 6) AS other, round(o.v - a.v, 6) AS difference, round(100 * (o.v - a.v) / nullif(a.v, 0), 6) AS percent FROM m a JOIN m o ON o.method = 'CA-HR' AND a.method <> 'CA-HR' AND o.measure = a.measure",
    "paired_effects": f"{_DIFFS} SELECT method, measure, round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS sd, count(*) AS n, round(CASE WHEN stddev_samp(diff) > 1e-12 THEN avg(diff) / stddev_samp(diff) ELSE 0 END, 6) AS d FROM diffs GROUP BY method, measure",
    "signed_ranks": f"{_DIFFS}, {_SIGNED.format(by='method, measure', source='diffs')} SELECT method, measure, round(w_plus, 6) AS w_plus, n, CAST(tie_term AS BIGINT) AS tie_term, round(z, 6) AS z FROM tested",
    "outcome_counts": f"{_DIFFS} SELECT method, measure, CAST(count_if(diff > 1e-12) AS BIGINT) AS improved, CAST(count_if(abs(diff) <= 1e-12) AS BIGINT) AS unchanged, CAST(count_if(diff < -1e-12) AS BIGINT) AS harmed FROM diffs GROUP BY method, measure",
    "metadata_diagnostics": f"""WITH {_DOCS}, {_ITEMS}, {_BIB}, {_qrels('docs', 'items')}, told AS (SELECT b.*, b.doc_id IN (SELECT doc_id FROM qrels) AS relevant FROM docs JOIN bib b USING (doc_id)),
      known AS (SELECT doc_id, year, relevant, coalesce(citations, 0) AS citations FROM told WHERE has_record),
      pool AS (SELECT *, row_number() OVER (ORDER BY substr(md5('7|' || doc_id), 1, 8), doc_id) AS pos FROM known WHERE NOT relevant),
      sides AS (SELECT citations, true AS positive FROM known WHERE relevant UNION ALL SELECT citations, false FROM pool WHERE pos <= least(25000, 10 * (SELECT count(*) FROM known WHERE relevant))),
      vals AS (SELECT citations, count(*) AS ties FROM sides GROUP BY citations), rk AS (SELECT *, coalesce({_TIED.format(by='1', v='citations')}, 0) + (ties + 1) / 2 AS avg_rank FROM vals),
      u AS (SELECT sum(CASE WHEN positive THEN avg_rank END) AS s, count_if(positive) AS n1, count_if(NOT positive) AS n2, sum(ties * ties - 1) AS tie_term FROM sides JOIN rk USING (citations)),
      a AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, (s - n1 * (n1 + 1) / 2) / (n1 * n2) AS auc FROM u),
      e AS (SELECT *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n2 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n2)) AS se,
        sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS spread FROM a)
      SELECT (SELECT round(avg(CAST(has_record AND citations IS NOT NULL AS INTEGER)), 6) FROM told) AS coverage, (SELECT count(*) FROM told) AS n_docs, w.*, f.*, CAST(n1 AS BIGINT) AS n_pos, CAST(n2 AS BIGINT) AS n_neg, u, round(auc, 6) AS auc,
        round(greatest(0, auc - 1.96 * se), 6) AS low, round(least(1, auc + 1.96 * se), 6) AS high, round(sign(u - n1 * n2 / 2) * greatest(0, abs(u - n1 * n2 / 2) - 0.5) / spread, 6) AS z
      FROM e, (SELECT median(citations) AS median_citations, round(avg(citations), 6) AS mean_citations, round(avg(CAST(citations = 0 AS INTEGER)), 6) AS zero_share, median(CASE WHEN year <> 0 THEN 2024 - year END) AS median_age FROM known) w,
        (SELECT {_SIDE('positive', 'positive')}, {_SIDE('background', 'NOT positive')} FROM sides) f""",
    "second_pass": f"""WITH {_BIB} SELECT CAST(doc_id AS VARCHAR) AS doc_id, has_record OR (doc_id + 1) % 3 <> 0 AS has_record, CASE WHEN has_record THEN citations WHEN (doc_id + 1) % 3 <> 0 THEN (doc_id + 1) % 50 END AS citations,
      CASE WHEN has_record THEN year WHEN (doc_id + 1) % 3 <> 0 THEN 2000 END AS year, CASE WHEN has_record THEN venue WHEN (doc_id + 1) % 3 <> 0 THEN 'k' || (doc_id + 1) END AS venue FROM bib""",
    "doi_chain": """SELECT d.doc_id, CAST(s_nationkey AS INTEGER) AS citations, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN 2010 ELSE 0 END, 0), CASE WHEN p_size > 10 THEN p_size + 1950 END) AS year,
      coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END, ''), p_brand, '') AS venue
      FROM documents d LEFT JOIN part ON p_partkey = d.doc_id + 1 LEFT JOIN supplier ON p_partkey % 5 <> 0 AND s_suppkey = p_partkey % 1001""",
    "query_features": f"""WITH {_DOCS} SELECT doc_id, CAST(len({_W}) AS DOUBLE) AS n_tokens, CAST(length(text) AS DOUBLE) AS n_chars,
      round(coalesce(list_avg(list_transform({_W}, lambda x: length(x))), 0), 6) AS mean_token_len, CAST(length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS DOUBLE) AS n_digits,
      CAST(len(list_filter({_W}, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS DOUBLE) AS n_caps,
      CAST(regexp_matches(lower(text), {_quoted(REVIEW_WORDS)}) AS DOUBLE) AS is_review, CAST(regexp_matches(lower(text), {_quoted(QUESTION_WORDS)}) AS DOUBLE) AS is_question,
      round(len(list_distinct(list_transform({_W}, lambda x: lower(x)))) / {_PER}, 6) AS unique_ratio, CAST(regexp_matches(text, '\\b(19|20)\\d{{2}}\\b') AS DOUBLE) AS has_year,
      round(len(list_filter({_W}, lambda x: lower(x) IN ({', '.join(repr(w) for w in STOP_WORDS)}))) / {_PER}, 6) AS stop_ratio, round(len(list_filter({_W}, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / {_PER}, 6) AS capital_ratio,
      CAST(len(list_filter({_W}, lambda x: contains(x, '-'))) AS DOUBLE) AS n_hyphenated FROM docs""",
    "word_drop": f"WITH {_ITEMS} SELECT query_id, {_dropped(0.3)} AS text FROM items",
    "robustness": f"""WITH {_runs(False, 'noisy', "noisy AS (" + ' UNION ALL '.join(f"SELECT '{s}|' || query_id AS query_id, {_dropped(s, 'topics')} AS text, embedding FROM topics" for s in (0.1, 0.2, 0.3, 0.4)) + "), ")},
      one AS (SELECT split_part(query_id, '|', 1) || '|' || method AS method, CAST(split_part(query_id, '|', 2) AS BIGINT) AS query_id, doc_id, rank FROM runs WHERE method IN ('BM25', 'Neural-Hybrid', 'CA-HR')), {_qrels('papers', 'topics')}, {_measured('one', 'topics')}
      SELECT split_part(method, '|', 1) AS noise, split_part(method, '|', 2) AS method, {_MEAN} FROM measured GROUP BY ALL""",
    "keep_best": "SELECT l_partkey, l_orderkey, CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE '' END AS doi FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag <> 'N', l_orderkey, l_linenumber) = 1",
    "merge_fields": """WITH r AS (SELECT l_partkey, l_orderkey * 1000 + l_linenumber AS pos, CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE '' END AS flag, CASE WHEN l_returnflag = 'N' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS shipped FROM lineitem),
      f AS (SELECT l_partkey, min(pos) FILTER (flag <> '') AS a, min(pos) FILTER (shipped <> '') AS b FROM r GROUP BY l_partkey),
      t AS (SELECT f.*, coalesce(x.flag, '') AS af, coalesce(x.shipped, '') AS ash, coalesce(y.flag, '') AS bf, coalesce(y.shipped, '') AS bsh FROM f LEFT JOIN r x ON x.l_partkey = f.l_partkey AND x.pos = a LEFT JOIN r y ON y.l_partkey = f.l_partkey AND y.pos = b)
      SELECT l_partkey, CASE WHEN b > a AND bf <> '' THEN bf ELSE af END AS flag, CASE WHEN a > b AND ash <> '' THEN ash ELSE bsh END AS shipped FROM t""",
    "resume": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "citation_precision": f"WITH {_RECORDS} SELECT query_id, turn, system, CAST(n_citations AS INTEGER) AS n_citations, round(citation_precision, 6) AS citation_precision FROM cited",
    "generation_summary": f"WITH {_RECORDS} SELECT system, dataset, {_SUMMARY} FROM cited WHERE relevance <> 0 GROUP BY system, dataset UNION ALL SELECT system, NULL, {_SUMMARY} FROM cited WHERE relevance <> 0 GROUP BY system",
    "generation_paired": f"""WITH {_RECORDS}, ok AS (SELECT * FROM cited WHERE relevance <> 0), long AS ({' UNION ALL '.join(f"SELECT dataset, query_id, system, turn, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ok" for m in ("relevance", "faithfulness", "citation_precision", "n_citations"))}),
      last AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY dataset, query_id, system, measure ORDER BY turn DESC) = 1),
      p AS (SELECT measure, dataset, query_id, max(value) FILTER (system = 'plain') AS a, max(value) FILTER (system = 'guided') AS b FROM last GROUP BY measure, dataset, query_id HAVING a IS NOT NULL AND b IS NOT NULL),
      diffs AS (SELECT measure, a - b AS diff FROM p), {_SIGNED.format(by='measure', source='diffs')}
      SELECT measure, count(*) AS n_pairs, round(avg(a), 6) AS mean_plain, round(avg(b), 6) AS mean_guided, round(coalesce(any_value(w_plus), 0), 6) AS w_plus, round(coalesce(any_value(z), 0), 6) AS z FROM p LEFT JOIN tested USING (measure) GROUP BY measure HAVING count(*) >= 10""",
    "generation_contexts": f"{_A}, {_CONTEXT.format(run='run', by='query_id')} SELECT query_id, doc_ids, md5(context) AS context_md5 FROM contexts",
    "generation_tasks": f"""WITH {_RUNS}, {_qrels('papers', 'topics')}, asked AS (SELECT 'd' || (query_id % 3) AS dataset, query_id FROM topics QUALIFY row_number() OVER (PARTITION BY query_id % 3 ORDER BY substr(md5('20260813|' || query_id), 1, 8), query_id) <= 10),
      two AS (SELECT * FROM runs JOIN asked USING (query_id) WHERE method IN ('Neural-Hybrid', 'CA-HR')), {_CONTEXT.format(run='two', by='dataset, method, query_id')}
      SELECT dataset, query_id, method AS system, doc_ids, CAST((SELECT count(*) FROM qrels q WHERE q.query_id = contexts.query_id AND list_contains(ids, q.doc_id)) AS INTEGER) AS n_rel_context, md5(context) AS context_md5 FROM contexts""",
    "folds": "SELECT item_id AS query_id, CAST(floor(CAST(('0x' || substr(md5('42|' || item_id), 1, 8)) AS BIGINT) / 4294967296.0 * 5) AS INTEGER) AS fold FROM benchmark",
    "router_labels": f"""{_ALL_MEASURED}, wide AS (SELECT query_id, max(n10) FILTER (method = 'UMA-RAG') AS a, max(n10) FILTER (method = 'LP-RAG') AS b, max(n10) FILTER (method = 'CA-HR') AS c FROM measured WHERE method IN ('UMA-RAG', 'LP-RAG', 'CA-HR') GROUP BY query_id),
      told AS (SELECT query_id, CASE WHEN c >= greatest(a, b, c) - 1e-9 THEN 2 WHEN a = greatest(a, b, c) THEN 0 ELSE 1 END AS label FROM wide)
      SELECT query_id, CAST(label AS INTEGER) AS label, CAST((row_number() OVER (PARTITION BY label ORDER BY substr(md5('42|' || query_id), 1, 8), query_id) - 1) % 5 AS INTEGER) AS fold FROM told""",
    "label_histogram": f"""{_ALL_MEASURED}, wide AS (SELECT query_id, max(n10) FILTER (method = 'UMA-RAG') AS a, max(n10) FILTER (method = 'LP-RAG') AS b, max(n10) FILTER (method = 'CA-HR') AS c FROM measured GROUP BY query_id),
      told AS (SELECT CASE WHEN c >= greatest(a, b, c) - 1e-9 THEN 'CA-HR' WHEN a = greatest(a, b, c) THEN 'UMA-RAG' ELSE 'LP-RAG' END AS method FROM wide)
      SELECT m.method, count(t.method) AS n FROM (VALUES ('UMA-RAG'), ('LP-RAG'), ('CA-HR')) m(method) LEFT JOIN told t ON t.method = m.method GROUP BY m.method""",
    "query_sample": "SELECT 'd' || (item_id % 3) AS dataset, item_id AS query_id FROM benchmark QUALIFY row_number() OVER (PARTITION BY item_id % 3 ORDER BY substr(md5('20260813|' || item_id), 1, 8), item_id) <= 10",
    "policy_bases": f"""{_actions()}, f AS (SELECT DISTINCT query_id, CAST(floor(CAST(('0x' || substr(md5('42|' || query_id), 1, 8)) AS BIGINT) / 4294967296.0 * 5) AS INTEGER) AS fold FROM acted),
      m AS (SELECT s.split, base, avg(n10) AS mean FROM acted JOIN f USING (query_id) JOIN (SELECT unnest(range(5)) AS split) s ON f.fold <> s.split WHERE action = 'none' GROUP BY s.split, base)
      SELECT CAST(split AS INTEGER) AS split, base FROM m QUALIFY row_number() OVER (PARTITION BY split ORDER BY round(mean, 9) DESC, base) = 1""",
    "report_primary": f"{_ALL_MEASURED}, sets AS (SELECT 'd' || (query_id % 3) AS dataset, method, {', '.join(f'avg({m}) AS {m}' for m in _MEASURES)}, count(*) AS n_queries FROM measured GROUP BY 1, method), every AS (SELECT * FROM sets UNION ALL SELECT 'macro', method, {', '.join(f'avg({m})' for m in _MEASURES)}, CAST(sum(n_queries) AS BIGINT) FROM sets GROUP BY method) SELECT dataset, method, {', '.join(f'printf({_quoted(_FOUR)}, {m}) AS {m}' for m in _MEASURES)}, CAST(n_queries AS VARCHAR) AS n_queries FROM every",
    "report_datasets": f"""WITH {_PAPERS}, {_TOPICS}, {_qrels('papers', 'topics')}, q AS (SELECT 'd' || (query_id % 3) AS dataset, count(*) AS n_queries FROM topics GROUP BY 1), j AS (SELECT 'd' || (query_id % 3) AS dataset, count(*) AS n_judgements FROM qrels GROUP BY 1),
      c AS (SELECT count(*) AS n_docs, {', '.join(f'printf({_quoted("%.1f%%")}, 100 * avg(CAST({c} IS NOT NULL AS INTEGER))) AS {c}_share' for c in ("citations", "year", "venue"))} FROM papers)
      SELECT dataset, n_queries, coalesce(n_judgements, 0) AS n_judgements, c.* FROM q LEFT JOIN j USING (dataset), c""",
    "background_sample": f"""WITH {_DOCS}, {_ITEMS}, {_BIB}, {_qrels('docs', 'items')}, known AS (SELECT doc_id FROM docs JOIN bib USING (doc_id) WHERE has_record)
      SELECT doc_id FROM known WHERE doc_id NOT IN (SELECT doc_id FROM qrels) QUALIFY row_number() OVER (ORDER BY substr(md5('7|' || doc_id), 1, 8), doc_id) <= least(25000, 10 * (SELECT count(DISTINCT doc_id) FROM qrels WHERE doc_id IN (SELECT doc_id FROM known)))""",
}
