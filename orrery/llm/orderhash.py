"""Document fingerprints by order MinHash: likeness that follows edit distance, not only shared content.

A text is the sequence of its overlapping runs of `K` code points, each numbered by how often it occurred before. Every one
of `SKETCHES` hash functions takes the `PICKED` numbered runs with the smallest values, puts the runs back in the order of
the text and hashes that tuple. Two texts agree in a place of their fingerprints if they have the same smallest runs in the
same order, so moving parts of a text about lowers likeness as changing them does.

`edited_fingerprints` also fingerprints each text with its last half replaced by the start of the next document's. Next
documents are found without bringing all rows into one order in one place: ids are cut at quantiles, each range is sorted
in a task of its own and also gets the first row of the range behind it.

Edge cases: a null text counts as empty; an empty text's fingerprint is all zeros; a text of fewer than `K` code points is one
run. Equal texts have equal fingerprints. Rows without an id come last, rows that share an id in the order of their texts; a
lone document is its own next one. Very long texts are worked through in blocks and held a few times over as numbers. Further
columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, PICKED, SKETCHES = 8, 2, 64
#: Runs that all functions hash at once, rows that a range of ids should have, and ranges there are at most.
BLOCK, ROWS, RANGES = 512, 20_000, 20_000

_drawn = np.random.default_rng(20_13)
_FACTORS = (_drawn.integers(0, 1 << 32, SKETCHES, np.uint32) | np.uint32(1))[:, None]
#: Odd factors: of mixing and numbering first, then one for each doubling of a run's width.
_ODD = _drawn.integers(0, 1 << 63, 5 + 32, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of `x`."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def run_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash for each run of `k` code points, made of the hashes of shorter runs; one for all points if there are fewer."""
    h, width = (points.astype(np.uint64) + np.uint64(1)) * _ODD[2], 1
    k = min(k, len(points))
    while width < k:
        step = min(width, k - width)
        h, width = h[: len(h) - step] * _ODD[4 + width.bit_length()] + h[step:], width + step
    return _mixed(h)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each one."""
    n = len(hashes)
    if n < 1 << 24:
        # Place and hash in one number: sorting that is faster than sorting places by hash.
        ordered = np.sort(hashes >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64))
        place, ordered = (ordered & np.uint64((1 << 24) - 1)).astype(np.int64), ordered >> np.uint64(24)
    else:
        place = np.argsort(hashes, kind="stable")
        ordered = hashes[place]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    number = np.empty(n, np.uint64)
    number[place] = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return number


def fingerprint(text: str, k: int = K) -> np.ndarray:
    """`SKETCHES` numbers of 16 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(SKETCHES, np.uint16)
    hashes = run_hashes(points, k)
    numbered = (_mixed(hashes + occurrences(hashes) * _ODD[4]) >> np.uint64(32)).astype(np.uint32)
    rows, values, places = np.arange(SKETCHES), [], []
    for start in range(0, len(numbered), BLOCK):
        v = numbered[None, start : start + BLOCK] * _FACTORS
        for _ in range(min(PICKED, v.shape[1])):
            at = v.argmin(1)
            values.append(v[rows, at].astype(np.uint64))
            places.append(at + start)
            # Not to be picked again.
            v[rows, at] = np.uint32(0xFFFFFFFF)
    picked = np.array(values).T << np.uint64(32) | np.array(places, np.uint64).T
    picked.sort(axis=1)
    chosen = np.sort(picked[:, :PICKED] & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)
    joined = np.full(SKETCHES, len(chosen[0]), np.uint64)
    for column in chosen.T:
        joined = _mixed(joined * _ODD[3] + hashes[column])
    return (joined >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of places in which two fingerprints agree."""
    return float((a == b).mean())


def as_text(print_: np.ndarray) -> str:
    """Four hex digits a place."""
    return print_.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text`, the last half of which is replaced by as many of the first code points of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_chars`, `fingerprint` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_text(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _ranges(docs: DataFrame, rows_each: int) -> tuple[np.ndarray, dict[int, tuple[int | None, int]]]:
    """Quantiles of the ids that cut them into ranges; for each range that has rows, its greatest id and the range before it.

    A range's number is how many quantiles lie above its ids; rows without an id have one more range. At most RANGES are made.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = min(RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_each)))
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts))).first()[0] if n and parts > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), _range_of(batch.column(0), bounds)], ["doc_id", "k"])

    tops = {r["k"]: r["top"] for r in ids.mapInArrow(run, "doc_id long, k int").groupBy("k").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    return bounds, {k: (tops[k], order[i - 1]) for i, k in enumerate(order)}


def _range_of(ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.where(missing, len(bounds) + 1, len(bounds) - np.searchsorted(bounds, values, "left")).astype(np.int32))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = ROWS) -> DataFrame:
    """`doc_id`, `n_chars`, digest of the edited text, both fingerprints, and how like the own one is to the edited text's and the next document's."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds, ranges = _ranges(picked, rows_each)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its fingerprint and range, and the first rows of a range once more for the range before it (`ahead`)."""
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                ids, where, ahead, rows = part.column(0).to_pylist(), _range_of(part.column(0), bounds).to_pylist(), [], list(range(len(part)))
                prints = [fingerprint(t or "").tobytes() for t in part.column(1).to_pylist()]
                ahead = [0] * len(rows)
                for i in range(len(part)):
                    top, before = ranges[where[i]]
                    if ids[i] == top:
                        rows.append(i)
                        where.append(before)
                        ahead.append(1)
                dealt = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*dealt.columns, pa.array([prints[i] for i in rows], pa.binary()), pa.array(where, pa.int32()), pa.array(ahead, pa.int32())], ["doc_id", "text", "print", "k", "ahead"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int | None, text: str, own_print: bytes, following: str, next_print: bytes) -> tuple:
        new = edited(text, following)
        first, second, third = np.frombuffer(own_print, np.uint16), fingerprint(new), np.frombuffer(next_print, np.uint16)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(first), as_text(second), likeness(first, second), likeness(first, third)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, found = None, []
        for batch in batches:
            for doc_id, text, own_print, k, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if waiting is not None and waiting[0] == k:
                    found.append(row(*waiting[1:], text, own_print))
                waiting = None if ahead else (k, doc_id, text, own_print)
                if len(found) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    dealt = picked.mapInArrow(own, "doc_id long, text string, print binary, k int, ahead int")
    dealt = dealt.repartitionById(len(bounds) + 2, F.col("k")).sortWithinPartitions("k", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
