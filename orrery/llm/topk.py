"""Exact inner-product search with pruning by norms.

Components become integers, floor(scale * x), so scores are exact. A rotation by the right singular vectors of all vectors
(from their d x d moment matrix, summed by Spark) moves most of each length into the first coordinates. Vectors are put in
order of descending length and dealt into blocks. A query meets a block as: partial inner product over the first rotated
coordinates plus, by Cauchy and Schwarz, the product of what is left of both lengths. Where that can't reach the query's
k-th best score the rest isn't computed; where length times length can't, the remaining shorter vectors are passed over.
What survives is scored exactly with the integers. The block of the longest vectors is searched first and gives every
query its first bound; a query is then sent only to the blocks whose longest vector may still reach that bound.

The queries are a stated part of the rows. They and the blocks meet in a grid of cells, each of a bounded number of both.

Floats serve for bounds only, with slack for their rounding. Scores are computed in floats where no sum can pass 2**53, in
64-bit integers where none can pass 2**63, and else in Python's integers; a score that a long can't hold is an error, as it
is in SQL, and so is a component that one can't hold.

Edge cases: vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part. Shorter
vectors count as padded with zeros. Rows that share an id are rows of their own: each is a candidate for the other, and each
is a query with its own ranks. Ties go to the smaller id. Fewer rows than k give all. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import dropped, partitions_for, written

#: Vectors of a block, and queries that meet one at a time.
BLOCK, QUERIES, STEP = 8192, 2048, 1024
#: Rotated coordinates of the partial sums.
LEADING = 16
#: Blocks' greatest lengths that are told to the queries before they are sent out.
KNOTS = 1000
NO_BOUND = -(2**63)
LONG = 2.0**63
FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id`, `v` (array of long) of the rows that take part."""
    x = F.col("embedding")
    valid = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fits = lambda c: (c * scale >= -LONG) & (c * scale < LONG)
    whole = F.transform(x, lambda c: F.when(fits(c), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a scaled component doesn't fit a long")).cast("long")))
    return rows.filter(F.col("vec_id").isNotNull() & valid).select("vec_id", whole.alias("v"))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as a matrix, padded with zeros."""
    lists = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    if not len(lists):
        return np.zeros((0, width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the matrix of all vectors, the longest direction first. Brings width**2 sums to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    moments = np.zeros((width, width))
    for i, j, s in vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[i, j] = s
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def _exact(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Inner products as longs; most: no sum of products is greater, but for rounding."""
    if most < 2**52:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return vectors @ query
    scores = [sum(a * b for a, b in zip(v, query.tolist())) for v in vectors.tolist()]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score doesn't fit a long")
    return np.array(scores, np.int64)


def search_cell(queries: np.ndarray, query_rows: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """For each query its best (id, score) rows among the vectors that may reach its bound; and how many pairs were scored."""
    lead = min(LEADING, vectors.shape[1])
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    vectors, ids, rows, lengths = vectors[order], ids[order], rows[order], lengths[order]
    v_turned, q_turned = vectors.astype(np.float64) @ turn, queries.astype(np.float64) @ turn
    v_rest, q_rest = (np.sqrt((m[:, lead:] ** 2).sum(axis=1)) for m in (v_turned, q_turned))
    q_lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    least = bounds.copy()
    best: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(queries)
    scored = 0
    for a in range(0, len(ids), STEP):
        part = slice(a, a + STEP)
        slack = 1e-9 * (1 + q_lengths * lengths[a])
        if not (live := np.flatnonzero(q_lengths * lengths[a] + slack >= least)).size:
            break
        reach = q_turned[live, :lead] @ v_turned[part, :lead].T + np.outer(q_rest[live], v_rest[part])
        may = reach + slack[live, None] >= least[live, None]
        for row in np.flatnonzero(may.any(axis=1)):
            q = live[row]
            at = np.flatnonzero(may[row])
            at = at[rows[part][at] != query_rows[q]]
            scored += len(at)
            scores = _exact(vectors[part][at], queries[q], q_lengths[q] * lengths[a])
            both = np.concatenate((best[q], np.column_stack((ids[part][at], scores))))
            both = both[both[:, 1] >= least[q]]
            if len(both) > k:
                both = both[np.lexsort((both[:, 0], -both[:, 1]))[:k]]
            if len(both) == k:
                least[q] = max(least[q], both[:, 1].min())
            best[q] = both
    return best, scored


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` for the rows that `is_query` (a condition on vec_id) selects."""
    rows = written(quantised(vectors, scale, id_col, vector_col), "vectors")
    count, width, n_queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(is_query, 1))).first()
    width = width or 1
    turn = rotation(rows, width)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_blocks, n_shards = partitions_for(count, block), partitions_for(n_queries, QUERIES)
    dealt = rows.withColumn("length", F.sqrt(squares)).repartitionByRange(n_blocks, F.desc("length"), "vec_id")
    part = F.spark_partition_id()
    blocks = written(dealt.select(part.alias("part"), F.monotonically_increasing_id().alias("row"), "vec_id", "v", "length"), "blocks")
    dropped(rows)
    # A block is a run of partitions, so that its size doesn't depend on how many there are.
    n_parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    n_blocks = min(n_blocks, n_parts)
    blocks = blocks.withColumn("block", F.floor(F.col("part") * n_blocks / n_parts).cast("int"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found, n = np.empty((0, 2), np.int64), np.zeros(len(right), np.int64)
        if len(left) and len(right):
            numbers = [right.column(c).to_numpy() for c in ("query_row", "bound")] + [left.column(c).to_numpy() for c in ("vec_id", "row")]
            best, _ = search_cell(_matrix(right.column("q"), width), *numbers[:2], _matrix(left.column("v"), width), *numbers[2:], turn, k)
            found, n = np.concatenate(best), np.array([len(b) for b in best])
        own = (np.repeat(right.column(c).to_numpy(), n) if len(right) else np.empty(0, np.int64) for c in ("query_row", "query_id"))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (*own, found[:, 0], found[:, 1])], ["query_row", "query_id", "vec_id", "score"])

    def search(chosen: Column, queries: DataFrame, cells: Column) -> DataFrame:
        left = blocks.filter(chosen).select(F.col("block").alias("in_block"), "row", "vec_id", "v").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        right = queries.withColumn("shard", F.pmod(F.xxhash64("query_row"), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(cells))
        return left.groupBy("in_block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, FOUND)

    queries = blocks.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "length")
    first = queries.withColumn("bound", F.lit(NO_BOUND).cast("long"))
    found = written(search(F.col("block") == 0, first.drop("length"), F.array(F.lit(0))), "found")
    if n_blocks > 1 and not blocks.filter("block > 0").isEmpty():
        # Lengths fall from block to block: a query goes on up to the last one that may reach its bound, told by a bounded number of them.
        step = partitions_for(n_blocks, KNOTS)
        upto = (F.floor((F.col("block") - 1) / step) + 1) * step
        knots = blocks.filter("block > 0").groupBy(upto.alias("upto")).agg(F.max("length").alias("most")).collect()
        listed = F.array(*[F.struct(F.lit(r.most).alias("most"), F.lit(r.upto).cast("long").alias("upto")) for r in knots])
        near = F.filter(listed, lambda x: F.col("length") * x["most"] * (1 + 1e-9) + 1 >= F.col("bound"))
        last = F.least(F.array_max(F.transform(near, lambda x: x["upto"])), F.lit(n_blocks - 1).cast("long"))
        bounds = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NO_BOUND)).alias("bound"))
        bounded = queries.join(bounds, "query_row", "left").fillna(NO_BOUND, ["bound"]).withColumn("upto", last.cast("int")).filter("upto IS NOT NULL")
        found = found.unionByName(search(F.col("block") > 0, bounded.drop("length"), F.sequence(F.lit(1), F.col("upto"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
