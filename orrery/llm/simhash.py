"""SimHash near-duplicate groups, linked through BK-trees.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes of its word shingles.
Fingerprints that differ in at most `radius` bits are linked, and the connected components are the groups.

How links are found. Two fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, so every
distinct fingerprint goes to r + 1 shards, one for each block and its value. A shard with more than `shard_size`
fingerprints is divided again in the same way on the bits that are still free, as often as needed: its members are
distinct, so a shard with b free bits never has over 2**b members and the division ends. Shards reach the tasks that
search them as rows of a shuffle, never by way of the driver. Each shard builds a BK-tree (children keyed by the integer
distance to their parent; a search follows only edges within the radius) and answers with the links of a spanning forest,
fewer than it has members.

How groups are found. In each round every linked fingerprint goes to the one of least draw among itself and its neighbours, and
only the links between those that are left go into the next round, until there are none; every round is written to the shared folder.

Similar texts. `near_duplicates` and `keep_first` compare whole texts: two are linked if the sets of their five-word shingles
have a Jaccard similarity of 0.8 or more. First the fingerprints of those shingles go through the same sharded BK-trees, and the links
within RADIUS bits are checked by the whole sets. But fingerprints of such pairs differ by 10 bits of 64 on average and by 20 at times,
so no radius that still tells unlike texts apart finds them all. The rest is found without loss: put the shingles of every
set into one order; two sets that are similar enough share a shingle among the first of both (all but 0.8 of a set, and one).
Any order is right; the common shingles of a sample come last, so that few texts meet by them. Of the
sets that share a first shingle the least one is the others' pivot. Shingles that the same sets share make one list. Each set is compared
with its best pivot, and components are made; then with the likest set in another component; then with all other sets there. Sizes and parities
of hashed bits, more for larger sets, rule out pairs that can't be similar enough where the lists of sets are, before there are rows of pairs; lists
with the same pivot are looked at together, so that a pair comes once from all of them. The others are compared in full.

Edge cases. Null, empty and blank texts have no words: their fingerprint is zero and links like any other. A text with
fewer words than the shingle has one shingle, all its words. Repeated rows stay and share a group. Null ids take part and
get their group's id, the smallest that isn't null (null if there is none). Empty tables give empty results. Other columns
of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import dropped, written

BITS = 64
SEED = 42
#: A shard with more members than this is divided again.
SHARD_SIZE = 1024
#: Of `near_duplicates` and `keep_first`: words of a shingle, and the least similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of those may differ to be looked at first.
RADIUS = 4
#: Texts whose shingles are counted, and how many common shingles are told to the tasks.
SAMPLE, COMMON = 5_000, 20_000
#: Words of 64 bits, at most and at least, of the parities that pairs are held against before their texts are read.
PARITIES, FOLDED = 128, 8
#: Pairs of places in lists looked at together; pairs of whole sets sent to a task together.
PAIRS, PAIRS_HELD = 500_000, 200
#: Places in lists with the same least set that are looked at together.
BLOCK = 10_000
#: Texts whose sets a task holds at a time.
TEXTS = 256
#: A table with more rows than this is never broadcast.
BROADCAST_ROWS = 500_000
#: Sorts after every document id.
NO_ID = 2**63 - 1


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle (words of the text with A-Z lower-cased, joined by a space), repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    return _majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp` (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit integers, in flat lists: node i has a value and a map from distance to child."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            todo += [child for edge, child in self.children[node].items() if distance - radius <= edge <= distance + radius]
        return found

    def add(self, value: int) -> int:
        """Adds a value that the tree doesn't hold yet; its node's number."""
        new = len(self.values)
        node = 0
        while new:
            distance = (self.values[node] ^ value).bit_count()
            child = self.children[node].setdefault(distance, new)
            if child == new:
                break
            node = child
        self.values.append(value)
        self.children.append({})
        return new


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between distinct values that differ in at most `radius` bits: a spanning forest of them."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for value in values:
        near = tree.near(value, radius)
        parent.append(new := tree.add(value))
        for other in near:
            if (a := root(new)) != (b := root(other)):
                parent[a] = b
                links.append((value, tree.values[other]))
    return links


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    """The free bit positions as `parts` blocks, sizes as even as can be."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:])]


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _divide(rows: DataFrame, free_of: dict[str, list[int]], parts: int) -> tuple[DataFrame, dict[str, list[int]]]:
    """Each row (fp, path) once for each block of the bits that its path leaves free: path names the blocks taken so far, key has their bits."""
    below, choices = {}, []
    for path, free in free_of.items():
        options = []
        for i, bits in enumerate(_blocks(free, parts)):
            if bits:
                below[f"{path}{i}"] = [b for b in free if b not in bits]
                taken = [b for b in range(BITS) if b not in below[f"{path}{i}"]]
                options.append(F.struct(F.lit(f"{path}{i}").alias("path"), F.lit(_signed(taken)).cast("long").alias("mask")))
        choices += [F.lit(path), F.array(*options)]
    rows = rows.select("fp", F.explode(F.create_map(*choices)[F.col("path")]).alias("to"))
    return rows.select("fp", "to.path", F.col("fp").bitwiseAND(F.col("to.mask")).alias("key")), below


def _search(shards: DataFrame, radius: int) -> DataFrame:
    """Links within each shard (path, key); a shard's rows meet in one task, which holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_of = np.empty(0, np.int64), None
        for batch in batches:
            paths, keys, fps = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]) | np.array([a != b for a, b in zip(paths, paths[1:])], bool)) + 1
            cuts = [0, *new.tolist(), len(keys)]
            links = []
            for a, b in zip(cuts, cuts[1:]):
                if held_of == (of := (paths[a], int(keys[a]))):
                    held_fp = np.concatenate((held_fp, fps[a:b]))
                    continue
                if len(held_fp) > 1:
                    links += spanning_links(held_fp.view(np.uint64).tolist(), radius)
                held_fp, held_of = fps[a:b], of
            if links:
                yield _pairs(links)
        if len(held_fp) > 1 and (links := spanning_links(held_fp.view(np.uint64).tolist(), radius)):
            yield _pairs(links)

    dealt = shards.repartition("path", "key").sortWithinPartitions("path", "key", "fp")
    return dealt.select("path", "key", "fp").mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def links_of(distinct: DataFrame, radius: int = 2, shard_size: int = SHARD_SIZE) -> DataFrame:
    """`a`, `b`: links between distinct values `fp` that connect all those within `radius` bits of each other."""
    rows, free_of = _divide(distinct.select("fp", F.lit("").alias("path")), {"": list(range(BITS))}, radius + 1)
    links = None
    while rows is not None:
        large = written(rows.groupBy("path", "key").count().filter(F.col("count") > shard_size).select("path", "key", F.lit(True).alias("large")), "large")
        if all(1 << len(free) <= shard_size for free in free_of.values()) or large.isEmpty():
            shards, rows = rows, None
        else:
            told = rows.join(large, ["path", "key"], "left")
            shards = told.filter(F.col("large").isNull())
            rows, free_of = _divide(told.filter("large"), free_of, radius + 1)
            rows = written(rows, "divided")
        found = _search(shards, radius)
        links = found if links is None else links.unionByName(found)
    return links


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """`fp`, `first`: for every linked fp of `ids` (fp, first) the smallest `first` that its links reach."""
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    reached, steps = edges.select(F.col("a").alias("fp"), F.col("a").alias("to")).distinct(), []
    while not edges.isEmpty():
        # Each end goes to the one of least draw among itself and its neighbours, by draws of this round; what is left are the links between those.
        drawn = lambda c, n=len(steps): F.struct(F.xxhash64(F.lit(n), c).alias("draw"), F.col(c).alias("at"))
        least = edges.groupBy("a").agg(F.min(drawn("b")).alias("least"))
        step = written(least.select(F.col("a").alias("fp"), F.least("least", drawn("a"))["at"].alias("to")), "step")
        side = lambda end: step.select(F.col("fp").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: E731,B023
        moved = edges.join(side("a"), "a").join(side("b"), "b").filter("to_a <> to_b")
        left = written(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        onward = step.toDF("to", "next")
        reached = reached.join(onward, "to", "left").select("fp", F.coalesce("next", "to").alias("to")) if steps else step
        dropped(edges)
        edges = left
        steps.append(step)
    told = written(ids.join(reached, "fp").select("fp", "first", "to"), "reached")
    labels = written(told.join(told.groupBy("to").agg(F.min("first").alias("least")), "to").select("fp", F.col("least").alias("first")), "labels")
    for table in (edges, told, *steps):
        dropped(table)
    return labels


def fingerprint_groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD_SIZE) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id` for every row of `docs`, linked by fingerprints alone."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    ids = written(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first")), "distinct")
    links = written(links_of(ids, radius, shard_size), "links")
    if not links.isEmpty():
        joined = components(links, ids).withColumnRenamed("first", "component")
        ids = written(ids.join(joined, "fp", "left").select("fp", F.coalesce("component", "first").alias("first")), "groups")
    told = rows.join(ids, "fp", "left")
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("first", F.lit(NO_ID)).alias("component_id"))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def _parities(h: np.ndarray, words: int = PARITIES) -> bytes:
    """For each of 64 * words bits whether an odd number of hashes falls on it; words: a power of two."""
    counts = np.bincount((h >> np.uint64(6) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits(counts & 1).tobytes()


def _wide(h: np.ndarray) -> bytes:
    """The same for at least eight bits a hash, so that sets of any size can be told apart."""
    return _parities(h, max(PARITIES, 1 << max(0, len(h) - 1).bit_length() >> 3))


def _folded(parities: bytes, words: int = FOLDED) -> bytes:
    """The same parities for fewer words of bits."""
    return np.bitwise_xor.reduce(np.frombuffer(parities, np.uint64).reshape(-1, words)).tobytes()


def _small(df: DataFrame, name: str) -> DataFrame:
    """`df` written, to be broadcast if it has a bounded number of rows."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of the most common shingles of some texts, the rarest first: a bounded number from a bounded sample."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width).view(np.int64))], ["h"])

    some = texts.filter(F.pmod(F.xxhash64("_row"), F.lit(-(-n // SAMPLE) or 1)) == 0).select("_text").mapInArrow(run, "h long")
    found = some.groupBy("h").count().filter(F.col("count") >= 5).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    return found.column("h").to_numpy()[::-1].view(np.uint64)


def _words(size: int) -> int:
    """Words of the parities that a set of this size is found by: 0.6 bits a hash at least, which tell unlike sets apart, within bounds."""
    return min(PARITIES, max(FOLDED, 1 << max(0, size * 3 // 5 - 1).bit_length() >> 6))


def _sets(texts: DataFrame, common: np.ndarray, width: int, similarity: float) -> DataFrame:
    """`_row`, `doc_id`, `fp` (a hash of the whole set), `sim` (the fingerprint), `size`, `folded` and `parities`, `first` (the set's first shingles) of every text."""
    order = np.argsort(common)
    ranked = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            out = []
            for text in batch.column(2):
                every = shingle_hashes(text.as_py(), width)
                h = np.unique(every)
                least = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                rank = np.full(len(h), -1)
                if len(ranked):
                    at = np.minimum(ranked.searchsorted(h), len(ranked) - 1)
                    rank[ranked[at] == h] = order[at[ranked[at] == h]]
                first = h[np.argsort(rank, kind="stable")[:least]].view(np.int64)
                fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED), _majority(every)], np.uint64).view(np.int64)
                out.append((int(fp[0]), int(fp[1]), len(h), _folded(parities := _parities(h, _words(len(h)))), parities, first))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], ["_row", "doc_id", "fp", "sim", "size", "folded", "parities", "first"])

    return texts.select("_row", "doc_id", "_text").mapInArrow(run, "_row struct<file:long,at:long>, doc_id long, fp long, sim long, size long, folded binary, parities binary, first array<long>")


def _near_fingerprints(sets: DataFrame, radius: int) -> DataFrame:
    """`a`, `b`: sets whose fingerprints the BK-trees link; where sets share a fingerprint, the least one and each other one."""
    own = written(sets.select("sim", "fp").distinct(), "fingerprints")
    least = own.groupBy("sim").agg(F.min("fp").alias("least"))
    links = written(links_of(least.select(F.col("sim").alias("fp")), radius).distinct(), "near")
    side = lambda end: least.select(F.col("sim").alias(f"sim_{end}"), F.col("least").alias(end))
    found = links.toDF("sim_a", "sim_b").join(side("a"), "sim_a").join(side("b"), "sim_b").select("a", "b")
    return own.join(least, "sim").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).unionByName(found)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, so cut that rows with the same value of it stay together."""
    held = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(both) for both in zip(held, columns)]
        cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None:
        yield held


def _shared(sets: DataFrame) -> DataFrame:
    """`least`, `list`, `fp`, `n`: different sets that share a first shingle, and the least set among them; lists of the same sets are one, of n shingles.
    Nothing else goes with them, since most first shingles aren't shared. Should two lists have one name, they are compared as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, fp in _lists(batches):
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))
            h, fp = h[new], fp[new]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            starts, sizes = starts[sizes > 1], sizes[sizes > 1]
            names = np.array([xxhash.xxh64_intdigest(fp[a : a + n].tobytes(), SEED) for a, n in zip(starts.tolist(), sizes.tolist())], np.uint64).view(np.int64)
            rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            columns = np.repeat(fp[starts], sizes), np.repeat(names, sizes), fp[rows]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], ["least", "list", "fp"])

    postings = sets.select(F.explode("first").alias("h"), "fp").repartition("h").sortWithinPartitions("h", "fp")
    return postings.mapInArrow(run, "least long, list long, fp long").groupBy("least", "list", "fp").agg(F.count("*").alias("n"))


def _index_pairs(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the places `own` with those from low to high, a bounded number at a time (or those of one place)."""
    others = high - low
    ends = np.cumsum(others)
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        times = others[i:j]
        yield np.repeat(own[i:j], times), np.repeat(low[i:j] - np.cumsum(times) + times, times) + np.arange(times.sum())
        i = j


def _apart(levels: dict[int, np.ndarray], words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many parities differ between rows a and b, at the fewer of both rows' words."""
    apart, shared = np.zeros(len(a), np.int64), np.minimum(words[a], words[b])
    for w, rows in levels.items():
        at = np.flatnonzero(shared == w)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            apart[part] = np.bitwise_count(rows[a[part]] ^ rows[b[part]]).sum(axis=1, dtype=np.int64)
    return apart


def _possible_pairs(told: DataFrame, similarity: float, which: str) -> DataFrame:
    """`a`, `b`, `n`: pairs of sets of one list, but not of one group, whose sizes and parities let them be similar enough; their difference
    has at least as many members as parities differ. told: block, list, fp, size, bits, group, n.

    which: "least" pairs each list's least set with the others (n: theirs), "every" makes all pairs, "nearest" pairs each set with the
    one that is likest to it by parities (n: how much nearer than it has to be). Lists bring their sets' parities, so that pairs that are ruled
    out are never rows, and lists of a block are looked at together, so that a pair that meets in many of them is one row."""

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, name, row_fp, row_size, row_bits, row_group, n in _lists(batches):
            fp, one, row = np.unique(row_fp, return_index=True, return_inverse=True)
            size, bits = row_size[one], row_bits[one]
            words, levels = np.array(list(map(len, bits))) // 8, {}
            for w in np.unique(words).tolist():
                levels[w] = np.zeros((len(fp), w), np.uint64)
                for wider in np.unique(words[words >= w]).tolist():
                    at = np.flatnonzero(words == wider)
                    # Places of the fewer parities are those of the more, modulo their number.
                    levels[w][at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[at].tolist()), np.uint64).reshape(len(at), -1, w), axis=1)
            new = np.concatenate(([True], (block[1:] != block[:-1]) | (name[1:] != name[:-1])))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(row))
            if which == "least":
                places = starts, starts + 1, ends
            else:
                # A list's groups stand together, so the others begin where a set's own group ends.
                runs = np.flatnonzero(new | np.concatenate(([True], row_group[1:] != row_group[:-1])))
                sizes = np.diff(np.append(runs, len(row)))
                places = np.arange(len(row)), np.repeat(runs + sizes, sizes), np.repeat(ends, ends - starts)
            nearest, nearness, held = np.full(len(fp), -1), np.full(len(fp), -1.0), np.zeros(0, np.int64)
            for a, b in _index_pairs(*places):
                x, y = row[a], row[b]
                if which != "least":
                    x, y = np.divmod(np.unique(np.minimum(x, y) * len(fp) + np.maximum(x, y)), len(fp))
                keep = np.flatnonzero(np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
                x, y = x[keep], y[keep]
                nearer = (size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-9 - _apart(levels, words, x, y)
                at = np.flatnonzero(nearer >= 0)
                x, y, nearer = x[at], y[at], nearer[at]
                if which == "least":
                    yield batch(fp[x], fp[y], n[b[keep[at]]].astype(float))
                elif which == "nearest":
                    order = np.argsort(nearer, kind="stable")
                    for u, v in ((x[order], y[order]), (y[order], x[order])):
                        last = len(u) - 1 - np.unique(u[::-1], return_index=True)[1]
                        last = last[nearer[order][last] > nearness[u[last]]]
                        nearest[u[last]], nearness[u[last]] = v[last], nearer[order][last]
                else:
                    held = np.union1d(held, x * len(fp) + y)
                    if len(held) > PAIRS:
                        yield batch(fp[held // len(fp)], fp[held % len(fp)], np.zeros(len(held)))
                        held = held[:0]
            if len(at := np.flatnonzero(nearest >= 0)):
                yield batch(fp[nearest[at]], fp[at], nearness[at])
            if len(held):
                yield batch(fp[held // len(fp)], fp[held % len(fp)], np.zeros(len(held)))

    dealt = told.repartition("block").sortWithinPartitions("block", "list", "group", "fp")
    return dealt.select("block", "list", "fp", "size", "bits", "group", "n").mapInArrow(run, "a long, b long, n double")


def _pivots(shared: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """`a`, `b`, `n`: sets with the least sets of their lists, where they may be similar, and in how many lists they meet."""
    met = shared.groupBy("least", "fp").agg(F.sum("n").alias("n"))
    told = met.join(distinct.select("fp", "size", F.col("folded").alias("bits"), F.col("fp").alias("group")), "fp")
    return _possible_pairs(told.select("*", F.col("least").alias("block"), F.col("least").alias("list")), similarity, "least")


def _best(pivots: DataFrame) -> DataFrame:
    """`a`, `b`: each set with the one of its pivots that it meets most."""
    return pivots.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


def _numbered(groups: DataFrame, fp: str = "fp", group: str = "group") -> DataFrame:
    return groups.select(F.col("fp").alias(fp), F.xxhash64("first").alias(group))


def _mixed(shared: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that hold sets of several groups, in blocks of the same least set, large ones divided."""
    grouped = written(shared.join(_numbered(groups), "fp"), "grouped")
    several = grouped.groupBy("least", "list").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("least", "list")
    mixed = written(grouped.join(several, ["least", "list"], "left_semi"), "mixed")
    dropped(grouped)
    large = _small(mixed.groupBy("least").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).filter("parts > 1"), "large")
    told = mixed.join(large, "least", "left").withColumn("block", F.xxhash64("least", F.pmod("list", F.coalesce("parts", F.lit(1)))))
    return told.join(distinct.select("fp", "size", F.col("parities").alias("bits")), "fp")


def _nearest(shared: DataFrame, distinct: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """`a`, `b`, `n`: each set with the likest ones of other groups that share a first shingle and may be similar."""
    return _possible_pairs(_mixed(shared, distinct, groups), similarity, "nearest")


def _pairs_across(shared: DataFrame, distinct: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """`a`, `b`: all pairs that share a first shingle, may be similar and aren't in one group yet."""
    return written(_possible_pairs(_mixed(shared, distinct, groups), similarity, "every").select("a", "b").distinct(), "across")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs `a`, `b` whose sets, made again from their texts, are similar enough."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            found = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            made = [pa.array(x, pa.binary()) for x in ([h.tobytes() for h in found], [_wide(h) for h in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["fp", "data", "wide"])

    def kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for size_a, size_b, a, b in zip(*(batch.column(i) for i in range(2, 6))):
                words = min(len(a.as_buffer()), len(b.as_buffer())) // 8
                x, y = (np.frombuffer(_folded(side.as_buffer(), words), np.uint64) for side in (a, b))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= (size_a.as_py() + size_b.as_py()) * (1 - similarity) / (1 + similarity) + 1e-9)
            yield kept(batch, keep)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield kept(batch, keep)

    def both(pairs: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            size = (F.octet_length("data") / 8).cast("long").alias(f"size_{side}")
            pairs = pairs.join(data.select(F.col("fp").alias(side), size, F.col(column).alias(f"{column}_{side}")), side)
        return pairs.select("a", "b", "size_a", "size_b", f"{column}_a", f"{column}_b")

    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    rows = _small(sets.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("_row").alias("_row")), "wanted")
    data = written(texts.select("_row", "_text").join(rows, "_row").select("fp", "_text").mapInArrow(hashed, "fp long, data binary, wide binary"), "data")
    # Pairs come with two whole sets each, so few at a time.
    possible = written(both(pairs, "wide").mapInArrow(wide, "a long, b long"), "possible", PAIRS_HELD)
    links = written(both(possible, "data").mapInArrow(compared, "a long, b long"), "links", PAIRS_HELD)
    for table in (data, possible, rows):
        dropped(table)
    return links


def _merged(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The groups (fp, first) that links between their sets join. Groups are joined, not sets, so that many links between two count once."""
    ends = found.join(_numbered(groups, "a", "group_a"), "a").join(_numbered(groups, "b", "group_b"), "b")
    links = written(ends.filter("group_a <> group_b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).distinct(), "between")
    numbered = written(groups.select("fp", "first", F.xxhash64("first").alias("group")), "numbered")
    joined = components(links, numbered.select(F.col("group").alias("fp"), "first").distinct()).toDF("group", "least")
    merged = written(numbered.join(joined, "group", "left").select("fp", F.coalesce("least", "first").alias("first")), "groups")
    for table in (links, numbered, joined):
        dropped(table)
    return merged


def _grouped(texts: DataFrame, width: int, similarity: float, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """`_row`, `doc_id`, `fp` of every row of `texts` (_row, doc_id, _text), and `fp`, `first`: the least row of its group."""
    whole = written(_sets(texts, _common(texts, width), width, similarity), "whole")
    shared = written(_shared(whole), "shared")
    # First shingles are most of the table and not needed any more.
    sets = written(whole.drop("first"), "sets")
    dropped(whole)
    # The order of a group: ids first, the smallest first, then the rows without one.
    own = written(sets.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "_row")).alias("first")), "distinct")
    distinct = sets.select("fp", "size", "folded", "parities").dropDuplicates(["fp"])
    pivots = written(_pivots(shared, distinct, similarity), "pivots")
    groups, tried = own, []
    # The first two steps join most of a group, so that the last one, which compares all across groups, finds few pairs left.
    for step in range(3):
        if step == 0:
            pairs = written(_near_fingerprints(sets, radius).unionByName(_best(pivots)).distinct(), "pairs")
        elif step == 1:
            pairs = written(_best(_nearest(shared, distinct, groups, similarity)), "pairs")
        else:
            pairs = _pairs_across(shared, distinct, groups, similarity)
        tried.append(pairs)
        found = _verified(pairs, sets, texts, width, similarity)
        tried.append(found)
        if not found.isEmpty():
            before, groups = groups, _merged(groups, found)
            if before is not own:
                dropped(before)
    rows = written(sets.select("_row", "doc_id", "fp"), "rows")
    for table in (sets, shared, pivots, *tried, *([own] if groups is not own else [])):
        dropped(table)
    return rows, groups


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame]:
    """`docs` with a key of each row, the key's name, which no column has, and the part that is compared.

    The key of a row read from Parquet is its file and its place there. Other rows are numbered and written once, so that they keep
    their numbers.
    """
    key = "_row"
    while key in [c.lower() for c in docs.columns]:
        key = f"_{key}"
    try:
        keyed = docs.withColumn(key, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        keyed = written(docs.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "keyed")
    return keyed, key, keyed.select(F.col(key).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `component_id` for every row of `docs`: groups of texts linked by similarity."""
    rows, groups = _grouped(_keyed(docs, id_col, text_col)[-1], width, similarity)
    return rows.join(groups, "fp").select("doc_id", F.nullif("first.id", F.lit(NO_ID)).alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all its columns: a row of the smallest id, or of none if the whole group has none."""
    keyed, key, texts = _keyed(docs, id_col, text_col)
    rows, groups = _grouped(texts, width, similarity)
    gone = _small(rows.join(groups, "fp").filter(F.col("_row") != F.col("first._row")).select("_row"), "gone")
    dropped(rows)
    dropped(groups)
    return keyed.join(gone.withColumnRenamed("_row", key), key, "left_anti").drop(key)
