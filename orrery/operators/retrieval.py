"""Scoring, fusion and ranking of documents for queries.

Ids are called query_id and doc_id. Rankings sort by the score rounded to nine places, then by id, so that ties are settled
in the same way everywhere. They rank the whole corpus: a document that shares no term with a query scores 0.

How pairs are scored. Texts are split into tokens by Spark; tasks score their documents against all queries in arrays and
keep what a ranking may need: each query's least and greatest scores, or its best rows. Nothing else leaves them, so no
shuffle has a row for each pair. Up to QUERY_BLOCK queries go to all tasks as they are. More are cut into blocks, and documents
and blocks of queries meet in a grid of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.sources.writers import kept

K1, B, EPSILON = 1.5, 0.75, 0.25
ALPHA, TOP = 0.6, 100
UMA_WEIGHT, LENGTH_WEIGHT, LENGTH_SCALE = 0.10, 0.2, 5000.0
CITATION_WEIGHT, RECENCY_WEIGHT = 0.15, 0.10
YEAR, DECAY = 2024, 0.1
RRF_K = 60
#: Queries that go to all tasks, the characters that their texts have at most, and documents of a cell where there are more.
QUERY_BLOCK, QUERY_CHARS, DOC_BLOCK = 1024, 8_000_000, 8192
#: Pairs that a task scores at once.
PAIRS = 1_000_000
SIGNALS = ("c", "r", "v")
#: Shares of BM25 in a content score.
ALPHAS = (0.0, 0.5, ALPHA, 1.0)


def term_statistics(corpus: DataFrame) -> DataFrame:
    """`term`, `df`, `total_len` over the whole corpus, read once: each document adds its different terms, and its length to a row
    without a term, whose `df` is the number of documents. `total_len` is null for terms.

    Users tell the two kinds apart by `total_len`.
    """
    t = corpus.select(tokens(F.col("text")).alias("t"))
    each = t.select(F.size("t").alias("len"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("total_len"))


def _corpus_size(statistics: DataFrame) -> DataFrame:
    """One row: `n_docs`, `mean_len`."""
    return statistics.filter("total_len IS NOT NULL").agg(F.sum("df").alias("n_docs"), (F.sum("total_len") / F.sum("df")).alias("mean_len"))


def inverse_frequencies(corpus: DataFrame) -> DataFrame:
    """`term`, `df`, `idf`: a negative idf becomes EPSILON times the mean of all idf as they were."""
    return _inverse(kept(term_statistics(corpus)))


def _inverse(statistics: DataFrame) -> DataFrame:
    n = _corpus_size(statistics).select("n_docs")
    terms = statistics.filter("total_len IS NULL").drop("total_len")
    raw = terms.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def weighted_terms(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` with `terms`, `weights` (how often a query has a term times its idf in the corpus) and the corpus' `mean_len`."""
    found = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    statistics = kept(term_statistics(corpus))  # read four times
    idf = _inverse(statistics).join(found.select("term").distinct(), "term", "left_semi").select("term", "idf")
    listed = found.join(idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("e"))
    told = queries.join(listed, "query_id", "left").crossJoin(F.broadcast(_corpus_size(statistics).select("mean_len")))
    return told.withColumns({"terms": F.coalesce(F.col("e.term"), F.array().cast("array<string>")), "weights": F.coalesce(F.col("e.w"), F.array().cast("array<double>"))}).drop("e", "text")


def _floats(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


class Scorer:
    """Raw scores of documents for a block of queries: BM25 if these have terms, inner products if they have vectors."""

    def __init__(self, queries: pa.Table) -> None:
        self.queries = queries
        if "terms" in queries.column_names:
            lists = queries.column("terms").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            self.known, term = coded.dictionary, coded.indices.to_numpy()
            order = np.argsort(term, kind="stable")
            self.starts = np.searchsorted(term[order], np.arange(len(self.known) + 1))
            self.query = np.repeat(np.arange(len(queries)), sizes)[order]
            self.weight = queries.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[order]
            self.mean_len = queries.column("mean_len")[0].as_py() if len(queries) else 1.0
        if "vector" in queries.column_names and len(queries):
            self.vectors = _floats(queries.column("vector"), len(queries))

    def lexical(self, docs: pa.Table) -> np.ndarray:
        lists, n = docs.column("t").combine_chunks(), len(self.queries)
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.index_in(lists.flatten(), value_set=self.known)
        at = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
        width = max(1, len(self.known))
        key, tf = np.unique(np.repeat(np.arange(len(length)), length)[at] * width + code.to_numpy(zero_copy_only=False)[at].astype(np.int64), return_counts=True)
        doc, term = np.divmod(key, width)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / self.mean_len))
        # Each posting once for every query that has its term.
        times = np.diff(self.starts)[term] if len(term) else np.empty(0, np.int64)
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.starts[term], times)
        cell = self.query[each] * len(length) + np.repeat(doc, times)
        return np.bincount(cell, np.repeat(part, times) * self.weight[each], n * len(length)).astype(float).reshape(n, len(length))

    def scores(self, docs: pa.Table) -> dict[str, np.ndarray]:
        """`s_bm` and `s_de`, a row for each query."""
        found = {}
        if "t" in docs.column_names:
            found["s_bm"] = self.lexical(docs)
        if "embedding" in docs.column_names:
            found["s_de"] = self.vectors @ _floats(docs.column("embedding"), len(docs)).T
        return found

    def steps(self, tables: Iterator[pa.Table]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
        """Documents, a bounded number of pairs at a time, and their scores."""
        step = max(16, PAIRS // max(1, len(self.queries)))
        for table in tables:
            for i in range(0, len(table) if len(self.queries) else 0, step):
                part = table.slice(i, step)
                yield part, self.scores(part)


def _over_cells(docs: DataFrame, queries: DataFrame, size: tuple[int, int], work: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """`work` (a block of queries, documents) where all documents and all queries meet; size: how many queries, and their characters."""
    if size[0] <= QUERY_BLOCK and size[1] <= QUERY_CHARS:
        block = queries.toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in work(block, (pa.Table.from_batches([b]) for b in batches if len(b))):
                yield from table.to_batches()

        return docs.mapInArrow(run, schema)
    blocks = max(1, -(-docs.count() // DOC_BLOCK)), max(-(-size[0] // QUERY_BLOCK), -(-size[1] // QUERY_CHARS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = docs.withColumns({"d": block("doc_id", blocks[0]), "q": every(blocks[1])})
    right = queries.withColumns({"q": block("query_id", blocks[1]), "d": every(blocks[0])})

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(work(right, iter([left] if len(left) else []))) if len(right) else []
        return pa.concat_tables(found) if found else pa.Table.from_batches([], empty)

    empty = pa.schema([(f.name, _arrow(f.dataType)) for f in docs.sparkSession.createDataFrame([], schema).schema])
    return left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(cell, schema)


def _arrow(kind: Any) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind.simpleString()]


class Best:
    """Rows of pairs of which those stay that are among each query's `top` by one of some scores.

    A row has the query's and the document's number or id and any columns that the scores are made of.
    """

    def __init__(self, scores: Callable[[Mapping[str, np.ndarray]], dict[str, np.ndarray]], n_queries: int, top: int) -> None:
        self.scores, self.n, self.top = scores, n_queries, top
        self.least: dict[str, np.ndarray] = {}
        self.rows: list[dict[str, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, columns: Mapping[str, np.ndarray]) -> None:
        """Takes the pairs of all queries with these documents; columns: matrices, or arrays with a value for each document."""
        scores = self.scores(columns)
        shape = (self.n, len(ids))
        keep = np.zeros(shape, bool)
        for name, score in scores.items():
            keep |= np.round(score, 9) >= self.least.setdefault(name, np.full(self.n, -np.inf))[:, None]
        q, d = np.nonzero(keep)
        self.rows.append({"query": q, "doc_id": ids[d], **{c: np.broadcast_to(v, shape)[q, d] for c, v in columns.items()}})
        self.held += len(q)
        if self.held > 4 * len(scores) * self.n * self.top:
            self.prune()

    def prune(self) -> dict[str, np.ndarray]:
        """Leaves only rows among the best."""
        if not self.rows:
            return {}
        rows = {c: np.concatenate([r[c] for r in self.rows]) for c in self.rows[0]}
        keep = np.zeros(len(rows["query"]), bool)
        for name, score in self.scores(rows).items():
            score = np.round(score, 9)
            order = np.lexsort((rows["doc_id"], -score, rows["query"]))
            query = rows["query"][order]
            place = np.arange(len(order)) - np.searchsorted(query, query)
            keep[order[place < self.top]] = True
            last = order[place == self.top - 1]
            self.least[name][rows["query"][last]] = score[last]
        self.rows = [{c: v[keep] for c, v in rows.items()}]
        self.held = int(keep.sum())
        return self.rows[0]


def _best(block: pa.Table, tables: Iterator[pa.Table], scores: Callable[[Mapping[str, np.ndarray]], dict[str, np.ndarray]], top: int, columns: list[str]) -> Iterator[pa.Table]:
    """The best pairs of a task: query_id, doc_id and these columns."""
    scorer = Scorer(block)
    best = Best(scores, len(block), top)
    between = {c: block.column(c).to_numpy() for c in ("low_bm", "high_bm", "low_de", "high_de") if c in block.column_names}
    for part, found in scorer.steps(tables):
        if between:
            found |= {"bm": _between(found["s_bm"], between["low_bm"], between["high_bm"]), "de": _between(found["s_de"], between["low_de"], between["high_de"])}
        found |= {c: part.column(c).to_numpy().astype(float)[None, :] for c in SIGNALS if c in part.column_names}
        if "len" in columns:
            found["len"] = pc.list_value_length(part.column("t")).to_numpy().astype(float)[None, :]
        best.add(part.column("doc_id").to_numpy(), found)
    if rows := best.prune():
        doc_ids = pa.array(rows["doc_id"], pa.string() if rows["doc_id"].dtype == object else None)
        yield pa.table({"query_id": block.column("query_id").take(pa.array(rows["query"])), "doc_id": doc_ids, **{c: pa.array(rows[c]) for c in columns}})


def _kinds(docs: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}"


def _size(queries: DataFrame) -> tuple[int, int]:
    text = F.sum(F.length("text")) if "text" in queries.columns else F.lit(0)
    n, chars = queries.agg(F.count(F.lit(1)), F.coalesce(text, F.lit(0))).first()
    return n, chars


def bm25(corpus: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """`query_id`, `doc_id`, `score`: of each task's pairs a query's best rows, enough to rank `top` of the whole corpus."""
    docs = corpus.select("doc_id", tokens(F.col("text")).alias("t"))
    work = partial(_best, scores=lambda t: {"score": t["s_bm"]}, top=top, columns=["s_bm"])
    return _over_cells(docs, weighted_terms(corpus, queries), _size(queries), work, f"{_kinds(corpus, queries)}, s_bm double").withColumnRenamed("s_bm", "score")


def dense(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """`query_id`, `doc_id`, `score`: inner products of `embedding`s, of each task's pairs a query's best rows."""
    work = partial(_best, scores=lambda t: {"score": t["s_de"]}, top=top, columns=["s_de"])
    asked = queries.select("query_id", F.col("embedding").alias("vector"))
    return _over_cells(docs.select("doc_id", "embedding"), asked, _size(asked), work, f"{_kinds(docs, queries)}, s_de double").withColumnRenamed("s_de", "score")


def signals(docs: DataFrame, falsy: bool = True) -> DataFrame:
    """`docs` (doc_id, text, citations, year, venue) with citation, recency and venue signals and length in tokens.

    falsy: a year of 0 counts as missing too. Missing citations are 0; missing years are the median of the years there are.
    """
    year = F.when(F.col("year") != 0, F.col("year")) if falsy else F.col("year")
    base = docs.withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("venue", F.coalesce("venue", F.lit(""))).withColumn("year", year)
    whole = base.agg(F.max(F.log1p("citations")).alias("most"), F.median("year").cast("int").alias("median_year"))
    base = base.crossJoin(F.broadcast(whole))
    by_venue = base.groupBy("venue").agg(F.avg("citations").alias("venue_mean"))
    edges = by_venue.agg(F.min("venue_mean").alias("low"), F.max("venue_mean").alias("high"))
    venues = by_venue.crossJoin(F.broadcast(edges)).select("venue", F.when(F.col("high") - F.col("low") > 1e-12, (F.col("venue_mean") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0)).alias("v"))
    return base.join(venues, "venue").select(
        "doc_id",
        (F.log1p("citations") / (F.col("most") + 1e-9)).alias("c"),
        F.exp(-DECAY * (YEAR - F.coalesce("year", "median_year"))).alias("r"),
        "v",
        F.size(tokens(F.col("text"))).alias("len"),
    )


def ranked(scores: DataFrame, by: list[str], top: int | None = TOP, score: str = "score") -> DataFrame:
    """The best rows of each group with `rank` from 1."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.filter(F.col("rank") <= top)


def _between(score: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Min-max of each query's row; 0 if its scores hardly differ."""
    low, wide = low[:, None], (high - low)[:, None]
    return np.where(wide > 1e-12, (score - low) / np.where(wide > 1e-12, wide, 1.0), 0.0)


def _spans(block: pa.Table, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Each query's least and greatest scores in a task."""
    spans: dict[str, np.ndarray] = {}
    for _, found in Scorer(block).steps(tables):
        for name, score in found.items():
            for side, pick, of in (("low", np.minimum, score.min(1)), ("high", np.maximum, score.max(1))):
                key = f"{side}_{name[2:]}"
                spans[key] = pick(spans[key], of) if key in spans else of
    if spans:
        yield pa.table({"query_id": block.column("query_id"), **{c: pa.array(spans[c]) for c in ("low_bm", "high_bm", "low_de", "high_de")}})


def score_table(corpus: DataFrame, queries: DataFrame, top: int = TOP, wanted: tuple[str, ...] | None = None, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Pairs with the raw scores `s_bm`, `s_de`, their scaled forms `bm`, `de` over the whole corpus, and the document's signals.

    corpus: doc_id, text, embedding, citations, year, venue; queries: query_id, text, embedding. All pairs are scored, once for
    the ranges and once for the rows; those leave a task that are among its `top` for a query by one of the `wanted` methods (all of
    `methods` if none are named) or by the content score with a share of `alphas`, so that these rankings, up to `top`, are exact.
    """
    docs = corpus.select("doc_id", tokens(F.col("text")).alias("t"), "embedding")
    asked = weighted_terms(corpus, queries.select("query_id", "text", F.col("embedding").alias("vector")))
    size, kinds = _size(queries), _kinds(corpus, queries)
    four = ("low_bm", "high_bm", "low_de", "high_de")
    spans = _over_cells(docs, asked, size, _spans, f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{c} double" for c in four))
    edges = spans.groupBy("query_id").agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in four])

    def scores(t: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        every = methods(t, np.exp)
        return {m: every[m] for m in (every if wanted is None else wanted)} | {f"alpha {a}": mixed(t, a) for a in alphas}

    columns = ["s_bm", "s_de", "bm", "de", *SIGNALS, "len"]
    # Texts are dealt out for the join, not their tokens.
    told = corpus.select("doc_id", "text", "embedding").join(signals(corpus).drop("len"), "doc_id").withColumn("t", tokens(F.col("text"))).drop("text")
    schema = f"{kinds}, " + ", ".join(f"{c} double" for c in columns)
    return _over_cells(told, asked.join(edges, "query_id"), size, partial(_best, scores=scores, top=top, columns=columns), schema)


def mixed(t: Mapping[str, Any], alpha: float = ALPHA) -> Any:
    """The content score: a share alpha of the scaled BM25, the rest of the scaled dense score."""
    return alpha * t["bm"] + (1 - alpha) * t["de"]


def methods(t: Mapping[str, Any], exp: Callable[[Any], Any]) -> dict[str, Any]:
    """Scores of the methods that rank the whole corpus at once, from columns or from arrays."""
    return {
        "BM25": t["s_bm"],
        "SBERT-Dense": t["s_de"],
        "Neural-Hybrid": mixed(t, 0.5),
        "Alpha-Hybrid": mixed(t),
        "UMA-RAG": mixed(t) + UMA_WEIGHT * t["v"] + UMA_WEIGHT * t["c"],
        "LP-RAG": mixed(t) * (1 + LENGTH_WEIGHT * exp(-t["len"] / LENGTH_SCALE)),
    }


def reranked(table: DataFrame, grid: list[tuple[str, float, float, float]]) -> DataFrame:
    """Content scores' best candidates, ranked again with each row (variant, alpha, beta, gamma) of a grid.

    table: as `score_table` gives it for these alphas. Candidates are chosen for each alpha; beta weighs citations, gamma recency.
    """
    spark = table.sparkSession
    alphas = F.explode(F.array(*[F.lit(a) for a in sorted({row[1] for row in grid})]))
    content = table.withColumn("alpha", alphas).withColumn("content", F.col("alpha") * F.col("bm") + (1 - F.col("alpha")) * F.col("de"))
    candidates = ranked(content, ["alpha", "query_id"], score="content").drop("rank")
    rows = spark.createDataFrame(grid, "variant string, alpha double, beta double, gamma double")
    scored = candidates.join(F.broadcast(rows), "alpha").withColumn("score", F.col("content") + F.col("beta") * F.col("c") + F.col("gamma") * F.col("r"))
    return ranked(scored.select("variant", "query_id", "doc_id", "score"), ["variant", "query_id"])


def reranked_corpus(corpus: DataFrame, queries: DataFrame, grid: list[tuple[str, float, float, float]]) -> DataFrame:
    """`reranked` over a corpus, for any alphas of the grid."""
    return reranked(score_table(corpus, queries, wanted=(), alphas=tuple(sorted({row[1] for row in grid}))), grid)


CA_HR = ("CA-HR", ALPHA, CITATION_WEIGHT, RECENCY_WEIGHT)


def ranked_methods(table: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """`method`, `query_id`, `doc_id`, `score`, `rank` of some of `methods`, from a table made for them."""
    scores = methods({c: F.col(c) for c in ("s_bm", "s_de", "bm", "de", *SIGNALS, "len")}, F.exp)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), scores[name].alias("score")) for name in wanted]))
    return ranked(table.select("query_id", "doc_id", each.alias("m")).select("m.method", "query_id", "doc_id", "m.score"), ["method", "query_id"])


def all_runs(table: DataFrame) -> DataFrame:
    """`method`, `query_id`, `doc_id`, `score`, `rank` of all methods, up to TOP."""
    whole = ranked_methods(table, ("BM25", "SBERT-Dense", "Neural-Hybrid", "Alpha-Hybrid", "UMA-RAG", "LP-RAG"))
    return whole.unionByName(reranked(table, [CA_HR]).withColumnRenamed("variant", "method"))


def run_of(corpus: DataFrame, queries: DataFrame, method: str) -> DataFrame:
    """The ranking by one method, without making what others need."""
    if method == "CA-HR":
        return reranked_corpus(corpus, queries, [CA_HR]).withColumnRenamed("variant", "method")
    return ranked_methods(score_table(corpus, queries, wanted=(method,), alphas=()), (method,))


def _first_places(t: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"bm": t["s_bm"], "de": t["s_de"]}


def _places(block: pa.Table, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """How many of a task's documents come before each candidate (ids and both scores, listed with each query) in both rankings."""
    lists = block.column("candidates").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    ids = flat.field("doc_id").to_numpy(zero_copy_only=False)
    own = {n: np.round(flat.field(n).to_numpy(), 9) for n in ("s_bm", "s_de")}
    cuts, before = np.concatenate(([0], np.cumsum(sizes))), {n: np.zeros(len(ids), np.int64) for n in own}
    for part, found in Scorer(block).steps(tables):
        docs = part.column("doc_id").to_numpy()
        for name, score in found.items():
            for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
                order = np.lexsort((docs, -np.round(score[q], 9)))
                falling, named = -np.round(score[q], 9)[order], docs[order]
                low, high = falling.searchsorted(-own[name][a:b]), falling.searchsorted(-own[name][a:b], "right")
                before[name][a:b] += [lo + named[lo:hi].searchsorted(i) if hi > lo else lo for lo, hi, i in zip(low, high, ids[a:b])]
    if len(ids):
        yield pa.table({"query_id": block.column("query_id").take(pa.array(np.repeat(np.arange(len(block)), sizes))), "doc_id": flat.field("doc_id"), "a": pa.array(before["s_bm"]), "b": pa.array(before["s_de"])})


def reciprocal_ranks(corpus: DataFrame, queries: DataFrame, k: int = RRF_K, top: int = TOP) -> DataFrame:
    """Sum of 1 / (k + rank) over both retrievers' rankings of the whole corpus, ranks from 0; the best `top` of each query.

    A list's first `top` documents have 1 / (k + top - 1) or more, so one behind place k + 2 * top in both lists can't be among the
    best. Candidates are the others, at most twice that many a query; their places are counted over all tasks, so they are exact.
    """
    reach, size, kinds = k + 2 * top, _size(queries), _kinds(corpus, queries)
    docs = corpus.select("doc_id", tokens(F.col("text")).alias("t"), "embedding")
    asked = weighted_terms(corpus, queries.select("query_id", "text", F.col("embedding").alias("vector")))
    near = _over_cells(docs, asked, size, partial(_best, scores=_first_places, top=reach, columns=["s_bm", "s_de"]), f"{kinds}, s_bm double, s_de double")
    places = [F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(s, 9).desc(), "doc_id")) for s in ("s_bm", "s_de")]
    near = near.withColumns({"_a": places[0], "_b": places[1]}).filter(F.least("_a", "_b") <= reach)
    listed = near.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "s_bm", "s_de")).alias("candidates"))
    counted = _over_cells(docs, asked.join(listed, "query_id"), size, _places, f"{kinds}, a long, b long")
    fused = counted.groupBy("query_id", "doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return ranked(fused.select("query_id", "doc_id", (1 / (k + F.col("a")) + 1 / (k + F.col("b"))).alias("score")), ["query_id"], top)


#: The nine actions: five weights of citations, four of recency.
ACTIONS = [(f"citation:{w:.2f}", w, 0.0) for w in (0.05, 0.10, 0.15, 0.20, 0.30)] + [(f"recency:{w:.2f}", 0.0, w) for w in (0.05, 0.10, 0.15, 0.20)]
#: The full re-ranking and five that leave a part out.
ABLATIONS = [("full", ALPHA, CITATION_WEIGHT, RECENCY_WEIGHT), ("no_citation", ALPHA, 0.0, RECENCY_WEIGHT), ("no_recency", ALPHA, CITATION_WEIGHT, 0.0), ("sparse_only", 1.0, CITATION_WEIGHT, RECENCY_WEIGHT), ("dense_only", 0.0, CITATION_WEIGHT, RECENCY_WEIGHT), ("content_only", ALPHA, 0.0, 0.0)]
#: Six weights of citations by five of recency.
SENSITIVITY = [(f"{b:.2f}/{g:.2f}", ALPHA, b, g) for b in (0.0, 0.05, 0.10, 0.15, 0.20, 0.30) for g in (0.0, 0.05, 0.10, 0.15, 0.20)]


#: Content bases: whether they need the first or the second encoder's scores, and their share of BM25.
BASES = {"SBERT-Dense": ("first", 0.0), "BGE-Dense": ("second", 0.0), "Neural-Hybrid": ("first", 0.5), "BGE-Hybrid": ("second", 0.5)}


def available_bases(first: bool, second: bool, lexical: bool = True) -> list[str]:
    """The content bases for which there are scores: of the first and the second encoder, and of BM25. None at all is an error."""
    there = {"first": first, "second": second}
    found = [base for base, (encoder, share) in BASES.items() if there[encoder] and (lexical or not share)]
    if not found:
        raise ValueError("no scores of documents' content")
    return found


def action_grid(alpha: float = ALPHA, base: str | None = None) -> list[tuple[str, float, float, float]]:
    """The actions on a content base, named after it if it is given."""
    return [(f"{base}|{name}" if base else name, alpha, b, g) for name, b, g in ACTIONS]


def encode_with(encoder, texts: DataFrame, prefix: str = "") -> DataFrame:
    """`texts` (id, text) with an `embedding` from an encoder that is given: a function from a list of strings to an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=[v.tolist() for v in encoder([prefix + (t or "") for t in batch.text])])

    return texts.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in texts.dtypes) + ", embedding array<float>")
