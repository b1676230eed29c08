"""Language-model scores: a hashed maximum-entropy model beside a smoothed unigram base.

Tokens are words (A-Z lower-cased) and one end for each text. A token has one of `BUCKETS` buckets: short tokens by a hash of the
whole token, longer ones by hashes of their first and last bytes; buckets form classes.

The model. log P(token | history) = log P(class | history) + log P(bucket | class, history) + log P(token | bucket, token before).
All three are softmaxes.

* The first two are over n-gram features (the bucket before with the class or bucket), skip features (the class of the token
  before that) and, for the class, both together, hashed. Their number is fixed.
* The third is over the tokens of the bucket, with the smoothed share of each as its bias and an n-gram feature for every pair
  of tokens that training texts hold at least twice. Tokens are told apart by hashes. These features grow with the
  corpus. Tokens without a feature keep their bias, so the sum of a softmax is 1 and what the features add: it needs the pairs
  seen, not the whole bucket.

Training maximises the likelihood less a Gaussian prior by rounds of gradient steps, each scaled by the feature's own
curvature. For the first two, each task holds the counts of some histories and gives their gradients; the driver adds them up
(their size is the model's) and moves the weights. A softmax of the third depends on one token before and one bucket alone, so
all its pairs are dealt to one task, which takes the steps there; the weights never pass the driver.

How texts and counts meet. Each task reads its documents in chunks of about `CHUNK` bytes, numbers each chunk's distinct tokens,
and writes the documents as these numbers. Distinct tokens, not occurrences, go to the task that counts them, and their counts
come back to the chunk; so do a chunk's distinct pairs and what the third softmax gives them. What travels is compressed arrays,
one for a chunk and a destination. Pairs behind a frequent token are dealt by bucket too, so that no task gets all of them.

Edge cases: null and empty texts are the end token alone. Null ids are never learned from (they have no fold) and are scored.
Repeated rows count each time. If nothing can be learned from, every token is unknown. A text longer than a chunk is one of its
own and takes some tens of bytes a token. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import partitions_for, written

CLASSES, LONG_WIDTH, SHORT_WIDTH = 16, 24, 8
WIDTH = LONG_WIDTH + SHORT_WIDTH
BUCKETS = CLASSES * WIDTH
#: Bytes of a token that counts as short.
SHORT = 4
#: Histories: the bucket before (or none) and the class of the token before that (or none).
BEFORE, GROUPS = BUCKETS + 1, CLASSES + 1
PAIRS = 2048
#: Rounds and step of the first two softmaxes, and what their features' counts are smoothed by.
ROUNDS, RATE, PRIOR = 12, 0.7, 5.0
#: Rounds and greatest step of the third, the variance of its weights' prior, and how often a pair must be seen.
PAIR_ROUNDS, PAIR_STEP, VARIANCE, SEEN = 12, 2.0, 8.0, 2
#: Bits of a token's hash, and steps of one in the third softmax's share of a log10 score as it comes back to a chunk.
HASHED, STEPS = 40, 2048
#: Pairs behind a token that training texts hold this often are dealt by bucket too.
FREQUENT = 4096
SMOOTH = 0.1
END = b""
#: Bytes of a chunk, of the texts in one row of it, and of those that make one destination of tokens and of pairs.
CHUNK, PART, TOKENS_OF, PAIRS_OF = 8_000_000, 1_000_000, 32_000_000, 16_000_000
#: Parts that the histories are divided into by the bucket before.
SHARDS = 16
READ = "chunk long, doc_id array<long>, learns array<boolean>, size array<long>, at binary, target int, token binary, shard int, cell binary, n binary"
KNOWN = "chunk long, target int, h binary, c binary, total array<long>, members array<long>"
PAIR_ROWS = "chunk long, target int, before binary, runs binary, token binary, c binary, n binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _rows(schema: str, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch with these columns, nulls in the others."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    n, parts = len(next(iter(columns.values()))), []
    for name, kind in (p.split() for p in schema.split(", ")):
        kind = pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]
        parts.append(pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind))
    return pa.RecordBatch.from_arrays(parts, _names(schema))


def _pack(values: np.ndarray) -> bytes:
    """An array's bytes, compressed; all first bytes come first, since the last ones are often the same."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _joined(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """The arrays in a column of packed ones, one behind the other."""
    return np.concatenate([np.empty(0, kind), *(_unpack(x.as_buffer(), kind) for x in column)])


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """All values of a column of lists."""
    return pa.concat_arrays([x.flatten() for x in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])


def words_of(text: str | None) -> list[bytes]:
    """The tokens of a text, the end among them."""
    return [*(text or "").encode().lower().split(), END]


def numbered(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """`words_of` many texts: each token's number, each text's number of tokens, and the distinct tokens by number."""
    # A copy that begins at its buffer's start: splitting goes wrong on parts of an array.
    whole = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in pa.compute.fill_null(texts, "").chunks)])
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(whole))
    flat, length = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc, filled = np.repeat(np.arange(len(length)), length), pa.compute.not_equal(flat, "")
    coded, doc = flat.filter(filled).dictionary_encode(), doc[filled.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(doc, minlength=len(length)) + 1
    code = np.full(len(doc) + len(length), len(coded.dictionary), np.int64)
    code[np.arange(len(doc)) + doc] = coded.indices.to_numpy()
    return code, sizes, pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])


def bucket_of(token: bytes) -> int:
    """The token's bucket; its class is the bucket by WIDTH."""
    if len(token) <= SHORT:
        h = zlib.crc32(token)
        return h % CLASSES * WIDTH + LONG_WIDTH + h // CLASSES % SHORT_WIDTH
    return zlib.crc32(token[-2:]) % CLASSES * WIDTH + zlib.crc32(token[:2]) % LONG_WIDTH


def hash_of(token: bytes) -> int:
    """A hash of the token in HASHED bits, the last of which are its bucket."""
    return xxhash.xxh64_intdigest(token, 42) % (1 << HASHED) & ~(BUCKETS - 1) | bucket_of(token)


@dataclass
class Model:
    """Weights of the first two softmaxes and what the counts give."""

    n_tokens: int
    n_distinct: int
    bucket_total: np.ndarray
    bucket_distinct: np.ndarray
    weights: dict[str, np.ndarray]

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability of tokens with these training counts."""
        return np.log10((counts + SMOOTH) / (self.n_tokens + SMOOTH * (self.n_distinct + 1)))

    def share(self, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The tokens' smoothed shares of their buckets."""
        return (counts + SMOOTH) / (self.bucket_total[buckets] + SMOOTH * (self.bucket_distinct[buckets] + 1))

    def table(self) -> np.ndarray:
        """log10 P(bucket | history) for every history and bucket."""
        logs = [log_softmaxes(self.weights, np.arange(i, min(BEFORE, i + 64))) for i in range(0, BEFORE, 64)]
        out = [(c[..., None] + b).reshape(len(c), GROUPS, BUCKETS) / np.log(10) for c, b in logs]
        return np.concatenate(out).astype(np.float32).reshape(BEFORE * GROUPS, BUCKETS)


def pair_features(before: np.ndarray) -> np.ndarray:
    """The hashed feature of each (bucket before, group) of these buckets."""
    return (before[:, None] * 40_503 + np.arange(GROUPS) * 9_176_867) % 1_000_003 % PAIRS


def log_softmaxes(w: dict[str, np.ndarray], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(class | history) and log P(bucket | class, history) for the histories of these buckets before."""
    of_class = w["class_ngram"][before][:, None, :] + w["class_skip"][None] + w["class_pair"][pair_features(before)]
    of_bucket = (w["bucket_ngram"][before][:, None, :] + w["bucket_skip"][None]).reshape(len(before), GROUPS, CLASSES, WIDTH)
    norm = lambda x: x - x.max(axis=-1, keepdims=True) - np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True))
    return norm(of_class), norm(of_bucket)


def histories(buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The history of every token of texts that stand one behind the other; begins: where each text starts."""
    before, group = np.empty(len(buckets), np.int64), np.empty(len(buckets), np.int64)
    before[1:], group[2:] = buckets[:-1], buckets[:-2] // WIDTH
    before[begins], group[begins] = BUCKETS, GROUPS - 1
    second = begins + 1
    group[second[second < len(buckets)]] = GROUPS - 1
    return before * GROUPS + group


def read_chunks(rows: DataFrame, targets: int) -> DataFrame:
    """Three kinds of rows in one table (READ): documents as their chunk's token numbers; for a chunk and a destination the
    distinct tokens, in the order of their numbers, and training counts; and for a shard of histories the cells and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        cells = np.zeros(BEFORE * GROUPS * BUCKETS, np.int64)
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            docs, chunk = pa.Table.from_batches(held), (task << 32) + number
            code, sizes, tokens = numbered(docs.column("text"))
            target = np.fromiter(map(zlib.crc32, tokens.to_pylist()), np.int64, len(tokens)) % targets
            order = pa.compute.sort_indices(pa.table({"target": target, "token": tokens}), [("target", "ascending"), ("token", "ascending")]).to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            at, ends = place[code], np.cumsum(sizes)
            i = 0
            for part in held:
                j = i + len(part)
                yield _rows(READ, chunk=[chunk], doc_id=[part.column("doc_id").to_pylist()], learns=[part.column("learns").to_pylist()], size=[sizes[i:j].tolist()], at=[_pack(at[ends[i] - sizes[i] : ends[j - 1]])])
                i = j
            learned = np.repeat(docs.column("learns").to_numpy(zero_copy_only=False).astype(bool), sizes)
            counts = np.bincount(at[learned], minlength=len(tokens)).astype(np.int64)
            ordered = tokens.take(pa.array(order)).to_pylist()
            cuts = np.searchsorted(target[order], np.arange(targets + 1))
            some = np.flatnonzero(np.diff(cuts))
            runs = [slice(cuts[t], cuts[t + 1]) for t in some]
            yield _rows(READ, chunk=[chunk] * len(some), target=some, token=[zstandard.compress(b"\n".join(ordered[r]), 1) for r in runs], n=[_pack(counts[r]) for r in runs])
            buckets = np.fromiter(map(bucket_of, ordered), np.int64, len(ordered))[at]
            np.add.at(cells, histories(buckets, ends - sizes)[learned] * BUCKETS + buckets[learned], 1)

        for batch in batches:
            bytes_of = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) + 1)
            i = 0
            while i < len(batch):
                # Up to PART bytes, a text more where there is room for none.
                done = bytes_of[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(bytes_of, done + PART, "right")))
                held.append(batch.slice(i, j - i))
                size += int(bytes_of[j - 1] - done)
                i = j
                if size >= CHUNK:
                    yield from close()
                    held, size, number = [], 0, number + 1
        if held:
            yield from close()
        per = -(-BEFORE // SHARDS) * GROUPS * BUCKETS
        some = np.flatnonzero(cells)
        if len(some):
            cuts = np.searchsorted(some, per * np.arange(SHARDS + 1))
            runs = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
            yield _rows(READ, shard=np.arange(SHARDS), cell=[_pack(np.diff(some[r], prepend=0)) for r in runs], n=[_pack(cells[some[r]]) for r in runs])

    return rows.mapInArrow(run, READ)


def count_tokens(read: DataFrame) -> DataFrame:
    """KNOWN rows: for a chunk and a destination its tokens' hashes and counts in all training texts; on a destination's first
    row the count and the number of different training tokens of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(x.as_buffer()).split(b"\n") for x in table.column("token")]
        coded = pa.array([t for some in lists for t in some], pa.binary()).dictionary_encode()
        place, c = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        np.add.at(c, place, _joined(table.column("n")))
        h = np.fromiter(map(hash_of, coded.dictionary.to_pylist()), np.int64, len(c))
        stats = np.zeros((2, BUCKETS), np.int64)
        np.add.at(stats[0], h & (BUCKETS - 1), c)
        np.add.at(stats[1], h & (BUCKETS - 1), c > 0)
        cuts = np.cumsum([0, *map(len, lists)])
        runs = [place[a:b] for a, b in zip(cuts, cuts[1:])]
        once = [[s.tolist(), *[None] * (len(runs) - 1)] for s in stats]
        return pa.Table.from_batches([_rows(KNOWN, chunk=table.column("chunk").combine_chunks(), target=table.column("target").combine_chunks(), h=[_pack(h[r]) for r in runs], c=[_pack(c[r]) for r in runs], total=once[0], members=once[1])])

    return read.filter("target IS NOT NULL").select("chunk", "target", "token", "n").groupBy("target").applyInArrow(run, KNOWN)


def history_counts(read: DataFrame) -> DataFrame:
    """`shard`, `data`: the counts of all cells (bucket before, group, bucket) of a shard."""
    per = -(-BEFORE // SHARDS) * GROUPS * BUCKETS

    def run(table: pa.Table) -> pa.Table:
        shard, counts = table.column("shard")[0].as_py(), np.zeros(per)
        for cell, n in zip(table.column("cell"), table.column("n")):
            counts[np.cumsum(_unpack(cell.as_buffer())) - shard * per] += _unpack(n.as_buffer())
        return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([counts.astype(np.float32).tobytes()], pa.binary())})

    return read.filter("shard IS NOT NULL").select("shard", "cell", "n").groupBy("shard").applyInArrow(run, "shard int, data binary")


def shard_gradient(weights: dict[str, np.ndarray], before: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """For every weight how often its feature is seen and how often it is expected, in the histories of these buckets before."""
    total = {k: np.zeros((2, *v.shape)) for k, v in weights.items()}
    log_class, log_bucket = log_softmaxes(weights, before)
    of_class = counts.reshape(len(before), GROUPS, CLASSES, WIDTH).sum(axis=3)
    expected = of_class.sum(axis=2, keepdims=True) * np.exp(log_class)
    for i, value in enumerate((of_class, expected)):
        total["class_ngram"][i][before] = value.sum(axis=1)
        total["class_skip"][i] = value.sum(axis=0)
        np.add.at(total["class_pair"][i], pair_features(before), value)
    expected = (of_class[..., None] * np.exp(log_bucket)).reshape(counts.shape)
    for i, value in enumerate((counts, expected)):
        total["bucket_ngram"][i][before] = value.sum(axis=1)
        total["bucket_skip"][i] = value.sum(axis=0)
    return total


def gradients(table: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """`shard_gradient` summed over all shards."""
    per = -(-BEFORE // SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = np.arange(shard * per, min(BEFORE, (shard + 1) * per))
                counts = np.frombuffer(data.as_buffer(), np.float32).reshape(per, GROUPS, BUCKETS)[: len(before)].astype(float)
                for k, both in shard_gradient(weights, before, counts).items():
                    some = np.flatnonzero(both.any(axis=(0, 2)))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array([both[:, r].tobytes() for r in some], pa.binary())], ["kind", "row", "data"])

    out = {k: np.zeros((2, *v.shape)) for k, v in weights.items()}
    for kind, row, data in table.mapInArrow(run, "kind string, row int, data binary").collect():
        out[kind][:, row] += np.frombuffer(data).reshape(2, -1)
    return out


def train(table: DataFrame, n_tokens: int, n_distinct: int, total: np.ndarray, distinct: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The first two softmaxes by gradient steps over the histories' counts, from weights that give each bucket its share."""
    share = (total + SMOOTH).reshape(CLASSES, WIDTH)
    shapes = {"class_ngram": (BEFORE, CLASSES), "class_skip": (GROUPS, CLASSES), "class_pair": (PAIRS, CLASSES), "bucket_ngram": (BEFORE, BUCKETS), "bucket_skip": (GROUPS, BUCKETS)}
    weights = {k: np.zeros(s) for k, s in shapes.items()}
    weights["class_skip"] += np.log(share.sum(axis=1))
    weights["bucket_skip"] += np.log(share).ravel()
    moved = {k: np.zeros(s) for k, s in shapes.items()}
    for _ in range(rounds if n_tokens else 0):
        for kind, (seen, expected) in gradients(table, {k: weights[k] + moved[k] for k in weights}).items():
            # The prior pulls towards where the weights began.
            slope = seen - expected - SMOOTH * PRIOR * moved[kind]
            moved[kind] += RATE * slope / (np.maximum(seen, expected) + PRIOR)
    return Model(n_tokens, n_distinct, total, distinct, {k: (weights[k] + moved[k]).astype(np.float32) for k in weights})


@dataclass
class Chunk:
    """A chunk's documents and tokens, put together again from their rows. Its pairs don't depend on the order of these."""

    doc_id: pa.Array
    sizes: np.ndarray
    learned: np.ndarray
    at: np.ndarray
    c: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table, known: pa.Table) -> Chunk:
        known = known.sort_by("target")
        sizes = _flat(docs.column("size")).to_numpy()
        learns = _flat(docs.column("learns")).to_numpy(zero_copy_only=False).astype(bool)
        return cls(_flat(docs.column("doc_id")), sizes, np.repeat(learns, sizes), _joined(docs.column("at"), np.int32), _joined(known.column("c")), _joined(known.column("h")))

    def pairs(self, targets: int) -> tuple[np.ndarray, ...]:
        """Distinct pairs whose first token may have features: the numbers of both tokens, where the second can't have a feature that
        of its bucket behind those of all tokens; how often training texts hold them; and their destinations; all sorted by
        destination and pair. Then each token's pair, the number of pairs where it has none."""
        begins = np.cumsum(self.sizes) - self.sizes
        inside = np.ones(len(self.at), bool)
        inside[begins] = False
        inside[1:] &= self.c[self.at[:-1]] >= SEEN
        where = np.flatnonzero(inside)
        n, bucket = len(self.c), self.h & (BUCKETS - 1)
        second = np.where(self.c >= SEEN, np.arange(n), n + bucket)[self.at[where]]
        key, which = np.unique(self.at[where - 1].astype(np.int64) * (n + BUCKETS) + second, return_inverse=True)
        a, b = np.divmod(key, n + BUCKETS)
        of = np.concatenate((bucket, np.arange(BUCKETS)))[b]
        target = ((self.h[a] >> 9) + np.where(self.c[a] >= FREQUENT, of * 7919, 0)) % targets
        order = np.argsort(target, kind="stable")
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        of_token = np.full(len(self.at), len(key))
        of_token[where] = place[which]
        seen = np.bincount(place[which], self.learned[where], len(key)).astype(np.int64)
        return a[order], b[order], seen, target[order], of_token


def chunk_pairs(read: DataFrame, known: DataFrame, targets: int) -> DataFrame:
    """PAIR_ROWS: a chunk's pairs for each destination; `before` has a hash for each of `runs`, the others a value for each pair:
    the second token's hash, whose last bits are its bucket, and its count, and how often training texts hold the pair."""

    def run(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        chunk = Chunk.of(docs, tokens)
        a, b, seen, target, _ = chunk.pairs(targets)
        cuts, out = np.searchsorted(target, np.arange(targets + 1)), []
        h, c = np.concatenate((chunk.h, np.arange(BUCKETS))), np.concatenate((chunk.c, np.zeros(BUCKETS, np.int64)))
        for t in np.flatnonzero(np.diff(cuts)):
            first, second, n = (x[cuts[t] : cuts[t + 1]] for x in (a, b, seen))
            starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            out.append([t, (chunk.h[first[starts]] >> 9).astype(np.int32), np.diff(np.append(starts, len(first))).astype(np.int32), h[second].astype(np.int32), c[second], n])
        packed = {c: [_pack(r[i]) for r in out] for i, c in enumerate(("before", "runs", "token", "c", "n"), 1)}
        return pa.Table.from_batches([_rows(PAIR_ROWS, chunk=[docs.column("chunk")[0].as_py()] * len(out), target=[r[0] for r in out], **packed)])

    left = read.filter("at IS NOT NULL").select("chunk", "doc_id", "learns", "size", "at")
    right = known.select(F.col("chunk").alias("of"), "target", "h", "c")
    return left.groupBy("chunk").cogroup(right.groupBy("of")).applyInArrow(run, PAIR_ROWS)


def fit_pairs(unit: np.ndarray, token: np.ndarray, share: np.ndarray, n: np.ndarray, rounds: int = PAIR_ROUNDS) -> np.ndarray:
    """What the third softmax adds to log share for every pair; pairs of a unit (token before, bucket) are one softmax.

    Pairs may repeat: their counts n are summed. Those with a share that are seen SEEN times or more have a feature.
    """
    order = np.lexsort((token, unit))
    unit_s, token_s = unit[order], token[order]
    new = np.concatenate(([True], (unit_s[1:] != unit_s[:-1]) | (token_s[1:] != token_s[:-1])))
    starts = np.flatnonzero(new)
    seen, p = np.add.reduceat(n[order], starts).astype(float), share[order][starts].astype(float)
    number = np.cumsum(np.concatenate(([True], unit_s[1:] != unit_s[:-1]))) - 1
    whole = np.bincount(number, n[order])
    of = number[starts]
    featured = np.flatnonzero((seen >= SEEN) & (p > 0))
    w = np.zeros(len(starts))
    f_of, f_seen, f_p, f_w = of[featured], seen[featured], p[featured], np.zeros(len(featured))
    all_of = whole[f_of]
    for _ in range(rounds):
        raised = f_p * np.exp(f_w)
        q = raised / (1 + np.bincount(f_of, raised - f_p, len(whole)))[f_of]
        slope = f_seen - all_of * q - f_w / VARIANCE
        f_w += np.clip(slope / (all_of * q * (1 - q) + 1 / VARIANCE), -PAIR_STEP, PAIR_STEP)
    w[featured] = f_w
    log_sum = np.log1p(np.bincount(f_of, f_p * np.expm1(f_w), len(whole)))
    out = np.empty(len(unit))
    out[order] = w[np.cumsum(new) - 1] - log_sum[number]
    return out


def in_steps(added: np.ndarray) -> np.ndarray:
    """Natural logarithms as steps of 1 / STEPS in log10, which must fit 16 bits."""
    steps = np.rint(added / np.log(10) * STEPS)
    if np.abs(steps).max(initial=0) > 32767:
        raise ValueError(f"a pair's part of a score passes {32767 / STEPS:.0f} in log10; take fewer rounds")
    return steps.astype(np.int16)


def pair_scores(pairs: DataFrame, model: Model, rounds: int = PAIR_ROUNDS) -> DataFrame:
    """`chunk`, `target`, `added`: what the third softmax adds to each pair's log10 share, in steps of 1 / STEPS, in the order that the pairs came in."""

    def run(table: pa.Table) -> pa.Table:
        token = _joined(table.column("token"), np.int32)
        bucket = token & (BUCKETS - 1)
        before = np.unique(_joined(table.column("before"), np.int32), return_inverse=True)[1]
        unit = np.repeat(before, _joined(table.column("runs"), np.int32)) * BUCKETS + bucket
        c = _joined(table.column("c"))
        share = np.where(c >= SEEN, model.share(c, bucket), 0)
        added = in_steps(fit_pairs(unit, token, share, _joined(table.column("n")), rounds))
        cuts = np.cumsum([0, *(len(_unpack(x.as_buffer(), np.int32)) for x in table.column("token"))])
        return pa.table({"chunk": table.column("chunk"), "target": table.column("target"), "added": pa.array([_pack(added[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return pairs.groupBy("target").applyInArrow(run, "chunk long, target int, added binary")


def scored(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS) -> DataFrame:
    """`doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every text; `learns` is a condition on `doc_id`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    read = written(read_chunks(rows.withColumn("learns", F.coalesce(learns, F.lit(False))), partitions_for(size, TOKENS_OF, 1)), "chunks")
    known = written(count_tokens(read), "known")
    total, distinct = np.zeros((2, BUCKETS))
    for bucket, c, n in known.filter("total IS NOT NULL").select(F.posexplode(F.arrays_zip("total", "members"))).groupBy("pos").agg(F.sum("col.total"), F.sum("col.members")).collect():
        total[bucket], distinct[bucket] = c, n
    table = written(history_counts(read), "histories").repartition(SHARDS, "shard")
    model = train(table, int(total.sum()), int(distinct.sum()), total, distinct, rounds)
    targets = partitions_for(size, PAIRS_OF, 1)
    added = written(pair_scores(chunk_pairs(read, known, targets), model, pair_rounds), "added")
    expanded: list[np.ndarray] = []  # filled once by each task

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not expanded:
            expanded.append(model.table())
        is_known = pa.compute.is_valid(right.column("h"))
        chunk = Chunk.of(left, right.filter(is_known))
        of_pair = np.append(_joined(right.filter(pa.compute.invert(is_known)).sort_by("target").column("added"), np.int16) / STEPS, 0)
        buckets, c = (chunk.h & (BUCKETS - 1))[chunk.at], chunk.c[chunk.at]
        begins = np.cumsum(chunk.sizes) - chunk.sizes
        inside = np.log10(model.share(c, buckets)) + expanded[0][histories(buckets, begins), buckets] + of_pair[chunk.pairs(targets)[4]]
        sums = (np.add.reduceat(x, begins) for x in ((c > 0).astype(np.int64), model.base(c), inside.astype(float)))
        return pa.Table.from_batches([_rows(SCORED, **dict(zip(_names(SCORED), (chunk.doc_id, chunk.sizes, *sums))))])

    left = read.filter("at IS NOT NULL").select("chunk", "doc_id", "learns", "size", "at")
    right = known.select("chunk", "target", "h", "c").unionByName(added, True).withColumnRenamed("chunk", "of")
    found = left.groupBy("chunk").cogroup(right.groupBy("of")).applyInArrow(run, SCORED)
    return found.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
