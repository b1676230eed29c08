"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Partitions pack their pieces by best
fit, longest first. Bins that are nearly full are done. The others travel on as items of their fill: fewer and fewer
partitions, each of a bounded number of items, pack them by best fit again, until one partition holds them all or a round
hardly saves a bin. Pieces don't move; a table of the bins that were put into others gives their final places.

Edge cases: a null or empty text is the closing token alone. Ids may be null or repeat: each row's pieces are packed, none
twice. A very long text is held as a whole, with the places of its words and its ids. An empty table gives no pieces. Other
columns are neither read nor returned.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import partitions_for, written

CAPACITY = 2048
#: Items that one task packs.
ITEMS = 50_000
#: A bin with less room than this share of the capacity is nearly full.
NEARLY = 0.01
#: A round that saves less than this share of its bins is the last.
WORTHWHILE = 0.005
#: Words that are remembered, and as many that were before those.
REMEMBERED = 400_000
#: Simple words are ASCII and Latin-1 letters with ASCII symbols behind them, where either may be missing. Composing changes none of these
#: characters, and a tokenizer with this pattern and these normalizers splits such a word between the two and nowhere else.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Kinds of bytes: letters a to z, first and second bytes of Latin-1 letters, symbols, all others.
LETTER, LEAD, SECOND, SYMBOL, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = [LETTER if c in b"abcdefghijklmnopqrstuvwxyz" else OTHER if chr(c).isalnum() else SYMBOL for c in range(0x21, 0x7F)]
KINDS[0xC3] = LEAD
KINDS[0x80:0xC0] = [OTHER if c in (0x97, 0xB7) else SECOND for c in range(0x80, 0xC0)]
#: Words with more bytes are left to the tokenizer; so many others are merged at once.
LONG, AT_ONCE = 48, 4_000
#: Marks that compose with ASCII letters, of which some compose with small letters only.
MARKS = r"[\x{300}-\x{36F}]"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Merges:
    """Byte pair merges of many simple words at once: in each round, every word's first pair of the lowest rank becomes one token."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # Bytes that stand for themselves, then the characters from U+0100 on for the others in turn.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in set(own))
        letters = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        self.nothing = max(vocab.values()) + 1
        pairs = model["merges"]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # A table of ranks by the pair's hash; `after` has the next rank with the same hash, and the number of ranks ends the chain.
        self.none = len(pairs)
        self.keys = np.array([*(vocab[a] * (self.nothing + 1) + vocab[b] for a, b in pairs), -1], np.int64)
        self.after = np.full(self.none + 1, self.none, np.int32)
        self.heads = np.full(1 << 18, self.none, np.int32)
        heads = self._hash(self.keys[:-1])
        for rank, at in enumerate(heads.tolist()):
            self.after[rank], self.heads[at] = self.heads[at], rank

    @staticmethod
    def fit(made: dict) -> bool:
        """Whether a tokenizer normalizes and splits as simple words need it, and nothing merges with what stands behind the end of a word."""
        normal, split, model = made["normalizer"] or {}, made["pre_tokenizer"] or {}, made["model"]
        patterns = [step.get("pattern", {}).get("Regex") for step in split.get("pretokenizers", [])]
        if model["type"] != "BPE" or normal.get("normalizers") != NORMAL or patterns != [PATTERN, None]:
            return False
        if not (end := model["end_of_word_suffix"]) or any(model[k] for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return False
        return not any(a.endswith(end) for a, _ in model["merges"])

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 14) & ((1 << 18) - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; `none` for those that don't merge."""
        keys = left * (self.nothing + 1) + right
        ranks = self.heads[self._hash(keys)]
        wrong = np.flatnonzero((self.keys[ranks] != keys) & (ranks < self.none))
        while len(wrong):
            ranks[wrong] = self.after[ranks[wrong]]
            wrong = wrong[(self.keys[ranks[wrong]] != keys[wrong]) & (ranks[wrong] < self.none)]
        return ranks

    def encode(self, words: list[bytes]) -> tuple[list[bytes | None], list[int]]:
        """Each word's ids as little-endian unsigned 32-bit integers, None for words that aren't simple; the places of those."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        kinds = KINDS[data]
        symbol = kinds == SYMBOL
        within = np.ones(len(data), bool)
        within[starts] = False
        wrong = (kinds == OTHER) | ((kinds == SECOND) != (within & np.append(False, kinds[:-1] == LEAD)))
        wrong |= within & ~symbol & np.append(False, symbol[:-1])
        simple = ~np.logical_or.reduceat(wrong, starts) & (sizes <= LONG)
        data = data + 0x20 * ((kinds == SECOND) & (data < 0x9F)).astype(np.uint8)
        # A token that ends a part of a word merges with nothing behind it.
        ends = np.append(symbol[1:] & ~symbol[:-1], True)
        ends[starts[1:] - 1] = True
        tokens = np.where(ends, self.last[data], self.inner[data])
        found: list[bytes | None] = [None] * len(words)
        order = np.flatnonzero(simple)
        order = order[np.argsort(sizes[order], kind="stable")]
        for i in range(0, len(order), AT_ONCE):
            part = order[i : i + AT_ONCE]
            for word, ids in zip(part.tolist(), self._merged(tokens, starts[part], sizes[part])):
                found[word] = ids
        return found, np.flatnonzero(~simple).tolist()

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The merged tokens of each word, whose bytes' tokens are at these places of `data`."""
        # A row for each word, with places for nothing before and behind its tokens.
        width = int(sizes.max()) + 2
        firsts = np.arange(len(sizes)) * width
        ends = np.cumsum(sizes)
        each = np.arange(ends[-1])
        places = each + np.repeat(firsts + 1 - ends + sizes, sizes)
        tokens = np.full(len(sizes) * width, self.nothing, np.int64)
        tokens[places] = data[each + np.repeat(starts - ends + sizes, sizes)]
        before, behind = np.arange(-1, len(tokens) - 1), np.arange(1, len(tokens) + 1)
        ranks = np.full(len(tokens), self.none, np.int32)
        ranks[places] = self._ranks(tokens[places], tokens[places + 1])
        ranks = ranks.reshape(len(sizes), width)
        while len(firsts):
            best = ranks.argmin(1)
            rank = ranks[np.arange(len(best)), best]
            going = rank < self.none
            if not going.all():
                ranks, firsts, best, rank = ranks[going], firsts[going], best[going], rank[going]
            at = firsts + best
            gone = behind[at]
            left, right = before[at], behind[gone]
            token = self.made[rank]
            tokens[at], tokens[gone], behind[at], before[right] = token, self.nothing, right, at
            flat, shift = ranks.reshape(-1), np.arange(len(at)) * width - firsts
            flat[at + shift] = self._ranks(token, tokens[right])
            flat[left + shift] = self._ranks(tokens[left], token)
            flat[gone + shift] = self.none
        left = tokens != self.nothing
        cuts = (4 * np.append(0, np.cumsum(left.reshape(len(sizes), width).sum(1)))).tolist()
        ids = tokens[left].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


class WordTokenizer:
    """Ids of texts under a tokenizer that lower-cases and drops white space, so that each word has ids of its own.

    Words are encoded once and remembered, up to a bound; then those that come again before as many others have come stay. New simple words
    are merged in arrays; others are given to the tokenizer, many in one string, and a token belongs to the word in which it starts.
    """

    #: Nothing where the tokenizer doesn't split as simple words need it; then it gets all words.
    merges: Merges | None = None
    #: What keeps A-Z of a text as they are: marks and tokens that are found in texts as they are written.
    cased = MARKS

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        self.cased = "(?i)" + "|".join([MARKS, *(re.escape(token["content"]) for token in made["added_tokens"])])
        if Merges.fit(made):
            self.merges = Merges(made["model"])

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of these words among those known."""
        others = words
        if self.merges:
            found, left = self.merges.encode(words)
            self.known.update(zip(words, found))
            others = [words[i] for i in left]
        for i in range(0, len(others), 1000):
            part = [word.decode() for word in others[i : i + 1000]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = (4 * np.append(starts.searchsorted(np.cumsum(sizes) - sizes), len(starts))).tolist()
            data = np.array(found.ids, "<u4").tobytes()
            self.known.update((word, data[a:b]) for word, a, b in zip(others[i : i + 1000], cuts, cuts[1:]))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's begin, with the end."""
        texts = pc.fill_null(texts, "")
        # A-Z are lower-cased only where that changes neither what composes nor which added tokens there are.
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, self.cased), texts, pc.ascii_lower(texts)))
        all_words = split.flatten().dictionary_encode()
        words = all_words.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        # White space at an end of a text leaves an empty word there.
        self.known[b""] = b""
        found = list(map(self.known.get, words))
        new = [word for word, ids in zip(words, found) if ids is None]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.before = {}, self.known
                new, found = words, [None] * len(words)
            held = list(map(self.before.get, new))
            self.known.update([(word, ids) for word, ids in zip(new, held) if ids is not None])
            if new := [word for word, ids in zip(new, held) if ids is None]:
                self._learn(new)
            found = [self.known[word] if ids is None else ids for word, ids in zip(words, found)]
        at = all_words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.append(0, np.cumsum(each))
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], each)]
        return ids, ends[split.offsets.to_numpy()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def tokenizer_for(path: str) -> WordTokenizer:
    """One a process, so that later tasks of a worker find words known."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: document, number, first token's place, length, CRC of the ids, and the ids if asked for."""
    end = np.array([closing], "<u4")
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(doc_ids), 500):
                rows = []
                found, bounds = tokenizer.ids(texts.slice(a, 500))
                for doc_id, low, high in zip(doc_ids[a : a + 500], bounds, bounds[1:]):
                    ids = np.append(found[low:high], end)
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, n, start, len(part), zlib.crc32(part)) + ((part.astype(np.int32),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in the order given: each one's bin and its place there; then each bin's fill.

    A bin with the least room that is enough is found as the lowest bit of a mask of rooms that some open bin has.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms, fills = 0, []
    for i, length in enumerate(lengths.tolist()):
        if fitting := rooms >> length:
            room = length + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += length
        if left := room - length:
            if not (rooms >> left) & 1:
                rooms |= 1 << left
                open_bins[left] = []
            open_bins[left].append(at)
    return bins, offsets, np.array(fills, np.int64)


def _pack(items: DataFrame, by: list[str], level: int, capacity: int) -> DataFrame:
    """Packs each partition's rows by column `length`: adds bin, offset and, on a bin's first row, its fill."""
    schema = f"{', '.join(f'{n} {t}' for n, t in items.dtypes)}, bin long, offset long, fill long"
    names = [*items.columns, "bin", "offset", "fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and len(table):
            table = table.sort_by([("length", "descending"), *((c, "ascending") for c in by)])
            bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
            named = bins + ((level << 56) | (TaskContext.get().partitionId() << 28))
            fill = pa.array(fills[bins], mask=offsets > 0)
            for column in (pa.array(named), pa.array(offsets), fill):
                table = table.append_column(names[table.num_columns], column)
            yield from table.to_batches(max_chunksize=10_000)

    return items.mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """`parts` (any columns besides doc_id, piece and length stay) with `sequence_id` and `offset`."""
    count = parts.count()
    # Dealt in turn, not by a key: an id may be missing or be on many rows.
    first = parts.repartition(partitions_for(count, items))
    placed = written(_pack(first, ["doc_id", "piece"], 0, capacity), "placed")
    underfull = placed.filter(F.col("fill") < capacity * (1 - NEARLY)).select("bin", F.col("fill").alias("length"))
    moves = None
    for level in range(1, 128):
        count = underfull.count()
        if count < 2:
            break
        tasks = partitions_for(count, items)
        dealt = underfull.select(F.col("bin").alias("moved"), "length")
        dealt = dealt.repartition(tasks, "moved") if tasks > 1 else dealt.coalesce(1)
        merged = written(_pack(dealt, ["moved"], level, capacity), "merged")
        left = merged.filter("fill IS NOT NULL")
        step = merged.select("moved", "bin", "offset")
        if moves is None:
            moves = step
        else:
            onward = step.select(F.col("moved").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("more"))
            moves = written(moves.join(onward, "bin", "left").select("moved", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "moves")
        remaining = left.count()
        if tasks == 1 or remaining > (1 - WORTHWHILE) * count:
            break
        underfull = left.filter(F.col("fill") < capacity * (1 - NEARLY)).select("bin", F.col("fill").alias("length"))
    placed = placed.drop("fill")
    if moves is None:
        return placed.withColumnRenamed("bin", "sequence_id")
    moves = moves.select(F.col("moved").alias("bin"), F.col("bin").alias("sequence_id"), F.col("offset").alias("more"))
    joined = placed.join(moves, "bin", "left")
    kept = [c for c in placed.columns if c not in ("bin", "offset")]
    return joined.select(*kept, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs `docs`: each piece with its sequence and its place in it."""
    return pack(written(pieces(docs, path, capacity, closing, with_ids, id_col, text_col), "pieces"), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """`sequence_id`, `ids`: each sequence's tokens, from pieces packed with their ids. A sequence has a bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
