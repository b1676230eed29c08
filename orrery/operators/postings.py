"""An inverted index of a corpus: written once, added to by segments, and read by BM25 rankings that decode few of its blocks.

A segment holds up to SEGMENT documents, numbered from 0 by length, so that a block's documents are about as long as each other. Each of its terms has blocks of at most BLOCK postings:
numbers of documents and frequencies. Beside them a block keeps those pairs of frequency and length that no other posting of it
beats by more occurrences in no longer a text. BM25's part of a term grows with the one and falls with the other, so one of these
pairs gives the block's greatest part, whatever the mean length has become. A segment needs no other one: no task ever holds all
postings of a common term, and documents are added by writing more segments.

A search brings the blocks of the queries' terms together by segment. In each segment a query's terms are ordered by the greatest
part they can have there. Those with the smallest ones, which together stay below the query's `top`-th best score so far, are not
essential: a document that has no other of the query's terms can't be among the best. Blocks of essential terms are decoded, the
greatest first, as their sums raise that score; documents that can still get there by the greatest parts of the blocks that span them are looked up in these blocks, term by term. A
segment whose parts together stay below is passed over. The first bound comes from a share of the segments, a task's own best rows raise it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators.retrieval import B, EPSILON, K1, QUERY_BLOCK, TOP
from orrery.sources.writers import kept

#: Postings of a block, and documents and tokens that a segment holds about.
BLOCK, SEGMENT, SEGMENT_TOKENS = 64, 2048, 2_000_000
#: One of so many segments gives the first bounds.
SHARE = 4
#: Scores are compared with nine decimals.
MARGIN = 2e-9
FIGURES = ("n_blocks", "n_decoded", "n_postings", "n_read")
_BLOCKS = "segment string, term string, block int, n int, low int, high int, docs array<int>, times array<int>, top_times array<int>, top_lens array<int>, total long, ids array<{0}>"
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def _segment(ids: pa.Array, lists: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
    """A row that lists the documents and their lengths (without a term), and the blocks."""
    order = pc.sort_indices(pa.table({"n": pc.list_value_length(lists), "i": ids}), [("n", "ascending"), ("i", "ascending")])
    ids, lists = ids.take(order), lists.take(order)
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary
    # Terms in their order, so that rows of a segment are sorted as they are made.
    rank = np.empty(len(known), np.int64)
    by_name = pc.sort_indices(known).to_numpy()
    rank[by_name] = np.arange(len(known))
    key, times = np.unique(rank[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), lens), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    number = (np.arange(len(term)) - np.searchsorted(term, term)) // BLOCK
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (number[1:] != number[:-1])))) if len(term) else np.zeros(0, np.int64)
    cuts = np.append(first, len(term))
    # Falling frequencies, then texts shorter than all before in the block; sums with the blocks left make later blocks start lower.
    block = np.repeat(np.arange(len(first)), np.diff(cuts))
    by = np.lexsort((lens[doc], -times, block))
    falling = lens[doc[by]] + (len(first) - block[by]) * (int(lens.max(initial=0)) + 1)
    best = np.concatenate(([True], falling[1:] < np.minimum.accumulate(falling)[:-1])) if len(by) else np.zeros(0, bool)
    tops = by[best]
    top_cuts = np.searchsorted(block[tops], np.arange(len(first) + 1))
    one = lambda x, kind: pa.array([x], kind)
    numbers = pa.list_(pa.int32())
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([one(name, pa.string()), pa.nulls(1, pa.string()), one(0, pa.int32()), one(len(ids), pa.int32()), one(0, pa.int32()), one(len(ids) - 1, pa.int32()), one(lens, numbers), *[pa.nulls(1, numbers)] * 3, one(int(lens.sum()), pa.int64()), own], _NAMES)
    for a in range(0, len(first), 5000):
        part = slice(a, min(a + 5000, len(first)))
        edges, top_edges = cuts[a : part.stop + 1], top_cuts[a : part.stop + 1]
        inner, outer = slice(edges[0], edges[-1]), tops[top_edges[0] : top_edges[-1]]
        columns = [
            pa.array([name] * (part.stop - a)), known.take(pa.array(by_name[term[first[part]]])), *(pa.array(x.astype(np.int32)) for x in (number[first[part]], np.diff(edges), doc[first[part]], doc[cuts[a + 1 : part.stop + 1] - 1])),
            _lists(doc[inner], edges - edges[0]), _lists(times[inner], edges - edges[0]), _lists(times[outer], top_edges - top_edges[0]), _lists(lens[doc[outer]], top_edges - top_edges[0]), pa.nulls(part.stop - a, pa.int64()), pa.nulls(part.stop - a, own.type),
        ]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


def blocks(corpus: DataFrame, name: str = "0") -> DataFrame:
    """The rows of the segments of `corpus` (doc_id, text); name: tells its segments from those written before. Rows without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, number = [], 0, 0, 0
        prefix = f"{name}/{TaskContext.get().partitionId()}"
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                held.append(part)
                n, size = n + len(part), size + len(part.column(1).flatten())
                if n >= SEGMENT or size >= SEGMENT_TOKENS:
                    yield from _segment(*_joined(held), f"{prefix}/{number}")
                    held, n, size, number = [], 0, 0, number + 1
        if n:
            yield from _segment(*_joined(held), f"{prefix}/{number}")

    told = corpus.filter("doc_id IS NOT NULL").select("doc_id", tokens(F.col("text")).alias("t"))
    return told.mapInArrow(run, _BLOCKS.format(dict(told.dtypes)["doc_id"]))


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(parts)
    return table.column(0).combine_chunks(), table.column(1).combine_chunks()


def write(corpus: DataFrame, path: str, name: str = "0") -> None:
    """Adds the corpus' segments to the index at `path`. Tasks write what they make, without a shuffle; terms are sorted within a segment, so readers skip pages of others."""
    blocks(corpus, name).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sizes(index: DataFrame) -> DataFrame:
    """One row: `n_docs`, `mean_len`."""
    return index.filter("term IS NULL").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("mean_len"))


def frequencies(index: DataFrame) -> DataFrame:
    """`term`, `df`, `idf`: a negative idf becomes EPSILON times the mean of all idf as they were, `mean_idf`. Reads no postings."""
    terms = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    raw = kept(terms.crossJoin(F.broadcast(sizes(index).select("n_docs"))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "mean_idf")


class _Query:
    """A query's terms by number and weight, its best rows so far, and what its `top`-th best score is at least."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, least: float, top: int) -> None:
        self.terms, self.weights, self.least, self.top = terms, weights, least, top
        # Weights that aren't bounds (tiny corpora, where the mean of the idf is negative): everything is decoded and kept.
        self.bounded = not len(weights) or weights.min() >= 0
        self.scores, self.ids = np.zeros(0), None
        #: Blocks met and decoded, postings met and decoded.
        self.figures = np.zeros(4, np.int64)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        scores, ids = np.concatenate((self.scores, scores)), ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        if self.bounded and len(scores) > self.top:
            order = pc.sort_indices(pa.table({"s": np.round(scores, 9), "i": ids}), [("s", "descending"), ("i", "ascending")])[: self.top]
            scores, ids = scores[order.to_numpy()], ids.take(order)
            self.least = max(self.least, float(np.round(scores[-1], 9)))
        self.scores, self.ids = scores, ids


class _Postings:
    """A segment's blocks of the wanted terms."""

    def __init__(self, ids: pa.Array, lens: np.ndarray, table: pa.Table, known: pa.Array, mean_len: float) -> None:
        self.ids, self.n = ids, len(lens)
        self.floor = K1 * (1 - B + B * lens / mean_len)
        term = pc.index_in(table.column("term"), value_set=known).to_numpy()
        flat = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        numbers = lambda c: flat(c).flatten().to_numpy(zero_copy_only=False)
        cuts = lambda c: np.concatenate(([0], np.cumsum(pc.list_value_length(flat(c)).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.docs, self.times, self.cuts = numbers("docs"), numbers("times"), cuts("docs")
        self.low, self.high = (table.column(c).to_numpy() for c in ("low", "high"))
        t, n, c = numbers("top_times"), numbers("top_lens"), cuts("top_times")
        part = t * (K1 + 1) / (t + K1 * (1 - B + B * n / mean_len)) if len(t) else np.zeros(0)
        #: Each block's greatest part.
        self.best = np.maximum.reduceat(part, c[:-1]) if len(part) else np.zeros(0)
        # Rows of a term follow each other.
        self.first, self.last = np.searchsorted(term, np.arange(len(known))), np.searchsorted(term, np.arange(len(known)), "right")
        self.greatest = np.zeros(len(known))
        np.maximum.at(self.greatest, term, self.best)

    def decoded(self, q: _Query, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of documents and parts of the postings in blocks a to b."""
        part = slice(self.cuts[a], self.cuts[b])
        docs, times = self.docs[part], self.times[part]
        q.figures[[1, 3]] += b - a, len(docs)
        return docs, times * (K1 + 1) / (times + self.floor[docs])

    def search(self, q: _Query) -> None:
        """Adds to a query's best rows those of this segment that can be among them."""
        here = self.last[q.terms] > self.first[q.terms]
        terms, weights = q.terms[here], q.weights[here]
        bound = weights * self.greatest[terms]
        order = np.argsort(bound, kind="stable")
        terms, weights, bound = terms[order], weights[order], np.concatenate(([0.0], np.cumsum(bound[order])))
        q.figures[[0, 2]] += int((self.last[terms] - self.first[terms]).sum()), int((self.cuts[self.last[terms]] - self.cuts[self.first[terms]]).sum())
        sums, met, rest = np.zeros(self.n), np.zeros(self.n, bool), len(terms)
        while rest and not (q.bounded and bound[rest] < q.least - MARGIN):
            rest -= 1
            t = int(terms[rest])
            docs, part = self.decoded(q, self.first[t], self.last[t])
            sums[docs] += weights[rest] * part
            met[docs] = True
            if q.bounded and rest and self.n >= q.top:
                # Sums only grow, so the `top`-th best of them is a bound at once.
                q.least = max(q.least, float(np.partition(sums, self.n - q.top)[self.n - q.top]) - MARGIN)
        if not q.bounded:
            q.add(sums, self.ids)
            return
        if rest == len(terms):
            return
        found = np.flatnonzero(met)
        # What each other term can still give a document: the greatest part of the block that spans it.
        spans = []
        for t, w in zip(terms[:rest].tolist(), weights[:rest].tolist()):
            own = slice(self.first[t], self.last[t])
            at = np.minimum(np.searchsorted(self.high[own], found), own.stop - own.start - 1)
            spans.append((at + own.start, w * self.best[at + own.start] * ((self.low[own][at] <= found) & (found <= self.high[own][at]))))
        left = np.sum([part for _, part in spans], axis=0) if spans else np.zeros(len(found))
        alive = np.ones(len(found), bool)
        for (block, part), w in zip(reversed(spans), weights[:rest][::-1].tolist()):
            alive &= sums[found] + left >= q.least - MARGIN
            left = left - part
            for k in np.unique(block[alive & (part > 0)]).tolist():
                docs, own = self.decoded(q, k, k + 1)
                sums[docs] += w * own
        found = found[alive]
        found = found[sums[found] >= q.least - MARGIN]
        q.add(sums[found], self.ids.take(pa.array(found)))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by segment, a segment at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        names = batch.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != names[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _searched(rows: DataFrame, asked: pa.Table, least: dict, top: int, figures: bool = False) -> DataFrame:
    """Each task's best rows for a block of queries (query_id, terms, weights, mean_len); or how many blocks it met and decoded."""
    kinds = f"query_id {dict(rows.dtypes)['_query']}, " + (", ".join(f"{c} long" for c in FIGURES) if figures else f"doc_id {dict(rows.dtypes)['ids'][6:-1]}, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = asked.column("terms").combine_chunks().flatten().dictionary_encode()
        known, term = coded.dictionary, coded.indices.to_numpy()
        cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(asked.column("terms")).to_numpy(zero_copy_only=False)))).astype(np.int64)
        weight = asked.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        names, mean_len = asked.column("query_id").to_pylist(), asked.column("mean_len")[0].as_py()
        queries = [_Query(term[a:b], weight[a:b], least.get(name, 0.0), top) for name, a, b in zip(names, cuts, cuts[1:])]
        for table in _segments(batches):
            table = table.sort_by([("term", "ascending"), ("block", "ascending")])
            listed = pc.is_null(table.column("term"))
            about = table.filter(listed)
            ids, lens = (about.column(c).combine_chunks().flatten() for c in ("ids", "docs"))
            # The order of the wanted terms is that of their numbers here.
            table = table.filter(pc.invert(listed))
            place = pc.index_in(table.column("term"), value_set=known).to_numpy()
            segment = _Postings(ids, lens.to_numpy(zero_copy_only=False).astype(np.int64), table.take(pa.array(np.argsort(place, kind="stable"))), known, mean_len)
            for q in queries:
                segment.search(q)
        ids = asked.column("query_id").combine_chunks()
        if figures:
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([int(q.figures[k]) for q in queries], pa.int64()) for k in range(4))], ["query_id", *FIGURES])
            return
        for i, q in enumerate(queries):
            if len(q.scores):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(q.scores), i))), q.ids, pa.array(q.scores)], ["query_id", "doc_id", "score"])

    return rows.drop("_query").mapInArrow(run, kinds)


class Search:
    """A search of an index for `queries` (query_id, text)."""

    def __init__(self, index: DataFrame, queries: DataFrame, top: int = TOP) -> None:
        self.index, self.top = index, top
        found = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        listed = found.join(frequencies(index), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("e"))
        told = listed.crossJoin(F.broadcast(sizes(index).select("mean_len")))
        #: query_id, terms, weights, mean_len of queries that share a term with the corpus.
        self.asked = kept(told.select("query_id", F.col("e.term").alias("terms"), F.col("e.w").alias("weights"), "mean_len"))

    def _parts(self, figures: bool) -> Iterator[DataFrame]:
        """For a bounded number of queries at a time: the best rows of each task, or the figures."""
        n = self.asked.count()
        parts = -(-n // QUERY_BLOCK)
        for i in range(parts):
            own = self.asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else self.asked
            asked = own.toArrow()
            if not len(asked):
                continue
            terms = own.select(F.explode("terms").alias("term")).distinct()
            kept_terms = F.broadcast(terms) if len(asked) * 1000 >= len(asked.column("terms").combine_chunks().flatten()) else terms
            # Blocks of other terms never leave the scan; segments' lists of documents do.
            wanted = self.index.join(kept_terms, "term", "left_semi").unionByName(self.index.filter("term IS NULL")).select(*self.index.columns)
            wanted = wanted.withColumn("_query", F.lit(None).cast(dict(self.asked.dtypes)["query_id"]))
            dealt = lambda rows: rows.repartition("segment").sortWithinPartitions("segment")
            first = F.pmod(F.xxhash64("segment"), F.lit(SHARE)) == 0
            told = kept(_searched(dealt(wanted.filter(first)), asked, {}, self.top, False))
            place = told.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.size("s") >= self.top)
            # One number for each of a bounded number of queries.
            least = {r[0]: round(r[1], 9) for r in place.select("query_id", F.col("s")[self.top - 1]).collect() if r[1] > 0}
            if figures:
                yield _searched(dealt(wanted.filter(first)), asked, {}, self.top, True)
                yield _searched(dealt(wanted.filter(~first)), asked, least, self.top, True)
            else:
                yield told
                yield _searched(dealt(wanted.filter(~first)), asked, least, self.top)

    def scores(self) -> DataFrame | None:
        """`query_id`, `doc_id`, `score` of all documents that may be among the best and share a term; None if no query shares one."""
        found = None
        for part in self._parts(False):
            found = part if found is None else found.unionByName(part)
        return found

    def figures(self) -> DataFrame | None:
        """`query_id`, the blocks of its terms and their postings, and how many of both were decoded. The latter depend on how segments meet in tasks."""
        found = None
        for part in self._parts(True):
            found = part if found is None else found.unionByName(part)
        return None if found is None else found.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in FIGURES])


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """`query_id`, `doc_id`, `score`: of each query enough rows to rank `top` of the whole corpus, documents without a shared term at 0."""
    listed = index.filter("term IS NULL").select(F.explode("ids").alias("doc_id"))
    zero = queries.select("query_id").crossJoin(F.broadcast(listed.orderBy("doc_id").limit(2 * top))).withColumn("score", F.lit(0.0))
    scored = Search(index, queries, top).scores()
    if scored is None:
        return zero
    # Fewer than `top` documents share a term, or these score below 0: among twice as many first ids enough share none.
    return scored.unionByName(zero).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
