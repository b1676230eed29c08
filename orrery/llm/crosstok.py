"""Alignment of two tokenizers' tokens over the same bytes, by fragments that can be joined in any order of brackets.

Both tokenizers encode a space and the text. Where a token of either ends at the same byte, a group of tokens ends. What a
range of bytes knows of this is a `Fragment`: tokens up to its first common end (open prefix), the groups between its first
and its last common end (closed), and the tokens behind that (open suffix). Joining two fragments closes one group at most, of
the first one's suffix and the second one's prefix; joining is associative, and the empty fragment changes nothing. So a long
text's ranges of `CHUNK` bytes, whose ends may lie within tokens, are aligned by different tasks and joined in a tree.

Texts are cut at single spaces between two characters that aren't white space. Tokens of both tokenizers end there whatever
stands around it: the byte-level tokenizer's pattern starts a match at such a space, and no piece of the other one holds a
space behind something else (`Aligner` makes sure of that). So what stands between two cuts is aligned once and remembered.
A part that is longer than a range is left whole, in the range where it starts.

Links are pairs of tokens that share bytes. How often a pair of ids is linked in the corpus is counted by lots: runs of texts
of a task that hold some LOT links. A lot lists its different pairs, texts keep the places of theirs in that list, so counts
come back as one row for each pair of a lot and not for each link.

Edge cases: a null or empty text, or one whose tokens don't spell a space and the text for both, has no tokens: zeros and ''. Such
texts count nowhere. Rows with the same id or none are answered each. Further columns aren't read, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import written

#: Bytes of a range of a long text; longer texts are divided. Fragments that a step of the tree joins.
CHUNK, FAN = 32_768, 16
#: Links of a lot, and texts of it that are looked at together; parts that are remembered (some 450 bytes each), and their longest length.
LOT, TOGETHER, REMEMBERED, SHORT = 2_000_000, 100, 100_000, 64
#: Latin, Greek and Cyrillic letters come before this one.
SETTLED = "\u0500"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)

Tokens = tuple[list[tuple[int, int]], list[tuple[int, int]]]  # of both tokenizers: id and bytes


def group_of(tokens: Tokens, base: int) -> tuple[bytes, list[int]]:
    """A group as text, and its links as numbers: base times the first id plus the second."""
    a, b = tokens
    links, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        links.append(a[i][0] * base + b[j][0])
        end_a, end_b = x + a[i][1], y + b[j][1]
        if end_a <= end_b:
            i, x = i + 1, end_a
        if end_b <= end_a:
            j, y = j + 1, end_b
    return b"%s|%s" % (b",".join(b"%d" % t for t, _ in a), b",".join(b"%d" % t for t, _ in b)), links


class Fragment:
    """What a range of bytes knows of the alignment. Tokens belong to the range in which they end."""

    __slots__ = ("head", "cut", "groups", "n_a", "n_b", "n_groups", "links", "tail")

    def __init__(self, head: Tokens = ((), ()), cut: bool = False, groups: bytes = b"", n_a: int = 0, n_b: int = 0, n_groups: int = 0, links: list[int] | np.ndarray = (), tail: Tokens = ((), ())) -> None:
        self.head, self.cut, self.groups, self.tail = tuple(map(list, head)), cut, groups, tuple(map(list, tail))
        #: Tokens and links of closed groups.
        self.n_a, self.n_b, self.n_groups, self.links = n_a, n_b, n_groups, list(links)

    @classmethod
    def of(cls, tokens: Tokens, base: int, starts: tuple[int, int] = (0, 0)) -> Fragment:
        """The fragment of both tokenizers' tokens in a range; starts: where the first ones begin, from any point."""
        ends = [np.cumsum([n for _, n in side]) + s for side, s in zip(tokens, starts)]
        common, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        if not len(common):
            return cls(head=tokens)
        a, b = tokens
        made = cls(head=(a[: at_a[0] + 1], b[: at_b[0] + 1]), cut=True, tail=(a[at_a[-1] + 1 :], b[at_b[-1] + 1 :]))
        parts = []
        for i in range(1, len(common)):
            own = a[at_a[i - 1] + 1 : at_a[i] + 1], b[at_b[i - 1] + 1 : at_b[i] + 1]
            parts.append(made._close(own, base))
        made.groups = b";".join(parts)
        return made

    def _close(self, tokens: Tokens, base: int) -> bytes:
        text, links = group_of(tokens, base)
        self.links += links
        self.n_a, self.n_b, self.n_groups = self.n_a + len(tokens[0]), self.n_b + len(tokens[1]), self.n_groups + 1
        return text

    def joined(self, other: Fragment, base: int) -> Fragment:
        """This range and the one behind it as one."""
        between = self.tail[0] + other.head[0], self.tail[1] + other.head[1]
        if not self.cut:
            return Fragment((self.head[0] + other.head[0], self.head[1] + other.head[1]), other.cut, other.groups, other.n_a, other.n_b, other.n_groups, other.links, other.tail)
        made = Fragment(self.head, True, b"", self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.links + other.links)
        if not other.cut:
            made.groups, made.tail = self.groups, between
            return made
        middle = [made._close(between, base)] if between[0] else []
        made.groups = b";".join(x for x in (self.groups, *middle, other.groups) if x)
        made.tail = other.tail
        return made


def finished(fragment: Fragment, base: int) -> Fragment:
    """A whole text's fragment: both ends of a text are common ends, so that nothing stays open."""
    whole = Fragment(cut=True).joined(fragment, base).joined(Fragment(cut=True), base)
    if any(map(len, whole.tail)):
        raise ValueError("a text's tokens end at different bytes")
    return whole


class Aligner:
    """Encodes parts of texts by both tokenizers and remembers their closed groups."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # A byte-level entry has a printable character for each byte: its own where that prints, the next ones from 256 on for the others.
        prints = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or c >= 174]
        rest = (c for c in range(256) if c not in prints)
        decoded = {chr(c): c for c in prints} | {chr(256 + i): c for i, c in enumerate(rest)}
        self.bytes_a: dict[int, bytes] = {i: bytes(decoded[c] for c in entry) if all(c in decoded for c in entry) else entry.encode() for entry, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space behind something else, so that texts can't be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.base = len(pieces)
        self.fast = self._ranked(path_a)
        #: Of both: the bytes of each id, its digits with a comma behind, and with what ends its side of a group.
        top = max(self.bytes_a) + 1
        self.size_a, self.size_b = np.array([len(self.bytes_a.get(i, b"")) for i in range(top)]), np.array(list(map(len, self.bytes_b)))
        self.told = [np.array([f"{i}{mark}" for i in range(n)], object) for n, mark in ((top, ","), (top, "|"), (self.base, ","), (self.base, ";"))]
        self.digits = np.array([len(str(i)) + 1 for i in range(max(top, self.base))])
        #: Part: its groups, tokens of both and groups in one number, and links; False if its tokens don't spell it.
        self.known: dict[str, tuple[bytes, int, bytes] | bool] = {}

    def tokens(self, parts: list[str]) -> Iterator[Tokens | None]:
        """Both tokenizers' tokens of a space and each part; None where they don't spell that."""
        found = self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)
        for part, own, ids_b in zip(parts, found, self.b.encode(parts, num_threads=1)):
            a, b, data = [self.bytes_a.get(i, b"") for i in own.ids], [self.bytes_b[i] for i in ids_b], (" " + part).encode()
            same = b"".join(a) == data and b"".join(b) == data
            yield (list(zip(own.ids, map(len, a))), list(zip(ids_b, map(len, b)))) if same else None

    def learn(self, parts: set[str]) -> None:
        """Puts the closed groups of these parts among those known."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {p: self.known[p] for p in parts if p in self.known}
        # White space at a text's edges would run into the space between two parts.
        edged = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        for part in edged:
            self._learn([part])
        for plain in (True, False):
            some = [p for p in new if p not in edged and (max(p) < SETTLED) == plain]
            for i in range(0, len(some), 2000):
                self._learn(some[i : i + 2000])

    def _ranked(self, path: str):
        """The byte-level tokenizer as one by ranks, which is faster, if its merges come in the order of the ids they make; else None."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in pairs]
        if made != list(range(256, 256 + len(made))):
            return None
        ranks = {data: i for i, data in self.bytes_a.items() if i < 256 + len(made)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, text: str) -> list[int]:
        # Which characters are letters, digits or spaces depends on a library's tables, but not in blocks that were settled long ago.
        if self.fast is not None and max(text) < SETTLED:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts as one text, whose tokens end where parts do; if they don't spell it, halves of it."""
        text = " " + " ".join(parts)
        data, a, b = text.encode(), self._ids_a(text), self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            if len(parts) == 1:
                self.known[parts[0]] = False
            else:
                self._learn(parts[: len(parts) // 2])
                self._learn(parts[len(parts) // 2 :])
            return
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # A link's shared bytes end where a token of either side does, and every such end belongs to one link.
        is_end = np.zeros((2, len(data) + 1), bool)
        is_end[0, ends_a] = is_end[1, ends_b] = True
        every, common = np.flatnonzero(is_end.any(0)), np.flatnonzero(is_end.all(0))
        links = a[ends_a.searchsorted(every)] * self.base + b[ends_b.searchsorted(every)]
        # Each group's first ids, then its second ones.
        last_a, last_b = is_end[1, ends_a], is_end[0, ends_b]
        group = np.concatenate((2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1))
        order = np.argsort(group, kind="stable")
        told = np.concatenate((np.where(last_a, self.told[1][a], self.told[0][a]), np.where(last_b, self.told[3][b], self.told[2][b])))[order]
        digits = np.concatenate(([0], np.cumsum(np.concatenate((self.digits[a], self.digits[b]))[order])))
        groups, held = "".join(told.tolist()).encode(), links.tobytes()
        edges = np.cumsum([len(p.encode()) + 1 for p in parts])
        ends = [x.searchsorted(edges, "right") for x in (ends_a, ends_b, common, every)]
        starts = [np.concatenate(([0], x[:-1])) for x in ends]
        n_a, n_b, n_groups, _ = ((e - s).tolist() for s, e in zip(starts, ends))
        low, high = ((x[3] * 8).tolist() for x in (starts, ends))
        told_ends = digits[ends[0] + ends[1]]
        for part, i, j, k, x, y, u, v in zip(parts, n_a, n_b, n_groups, low, high, [0, *told_ends[:-1].tolist()], told_ends.tolist()):
            self.known[part] = groups[u : v - 1], i | j << 64 | k << 128, held[x:y]

    def forget_long(self, parts: set[str]) -> None:
        for part in parts:
            if len(part) > SHORT:
                del self.known[part]

    def parts(self, text: str) -> list[str]:
        """A text cut where both tokenizers' tokens end for certain."""
        some = text.split(" ")
        known = self.known
        if all(p in known or p and not (p[0].isspace() or p[-1].isspace()) for p in some) and "" not in some:
            return some
        return BETWEEN.split(text)

    def closed(self, parts: list[str]) -> Fragment | None:
        """The closed groups of known parts in a row; None if one of them isn't spelled by its tokens."""
        found = list(map(self.known.__getitem__, parts))
        if False in found:
            return None
        counts, low = sum([f[1] for f in found]), (1 << 64) - 1
        made = Fragment(cut=True, groups=b";".join([f[0] for f in found]), n_a=counts & low, n_b=counts >> 64 & low, n_groups=counts >> 128)
        made.links = np.frombuffer(b"".join([f[2] for f in found]), np.int64)
        return made


@lru_cache(maxsize=2)
def aligner_for(path_a: str, path_b: str) -> Aligner:
    """One a process, so that later tasks of a worker find parts known."""
    return Aligner(path_a, path_b)


def slices(text: str, size: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """A text's ranges of about `size` bytes: the parts that a range touches, and where in them (and the space before) it begins and ends.

    Ranges end at multiples of `size`, counted with a space before the text, so within parts and tokens; only in parts longer than
    `size` they don't, but behind these.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    place = np.concatenate(([1], 1 + np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))).astype(np.int64)
    white = np.isin(points, _SPACES)
    cuts = np.flatnonzero((points[1:-1] == 32) & ~white[:-2] & ~white[2:]) + 1 if len(points) > 2 else np.zeros(0, np.int64)
    # Characters at which parts begin with their space (the first one's isn't in the text) and end, and the bytes there.
    starts, at = np.concatenate(([-1], cuts)), np.concatenate(([0], place[cuts], place[-1:]))
    low, total = 0, int(place[-1])
    while low < total:
        high = min(total, (low // size + 1) * size)
        last = int(np.searchsorted(at, high, "left")) - 1  # the part in which the range ends
        if at[last + 1] - at[last] > size:
            high = int(at[last + 1])
        first = int(np.searchsorted(at, low, "right")) - 1
        end = int(starts[last + 1]) if last + 1 < len(starts) else len(text)
        yield text[starts[first] + 1 : end], low - int(at[first]), high - int(at[first])
        low = high


def _tokens_within(tokens: Tokens, low: int, high: int) -> tuple[Tokens, tuple[int, int]]:
    """The tokens that end behind `low` and not behind `high`, and where the first ones begin."""
    kept, starts = [], []
    for side in tokens:
        ends = np.cumsum([n for _, n in side])
        a, b = np.searchsorted(ends, (low, high), "right").tolist()
        kept.append(side[a:b])
        starts.append(int(ends[a - 1]) if a else 0)
    return (kept[0], kept[1]), (starts[0], starts[1])


def range_fragment(aligner: Aligner, text: str, low: int, high: int) -> Fragment | None:
    """The fragment of bytes `low` to `high` of a space and `text`, which begins and ends with whole parts; None if a part isn't spelled by its tokens."""
    parts, base, made = aligner.parts(text), aligner.base, Fragment()
    aligner.learn(set(parts))
    ends = np.cumsum([len(p.encode()) + 1 for p in parts])
    begin = ends - [len(p.encode()) + 1 for p in parts]
    inside = np.flatnonzero((begin >= low) & (ends <= high))
    open_parts = [i for i in range(len(parts)) if not (begin[i] >= low and ends[i] <= high)]
    opened = dict(zip(open_parts, aligner.tokens([parts[i] for i in open_parts])))
    if any(t is None for t in opened.values()):
        return None
    first, last = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (len(parts), len(parts))
    for i in sorted(i for i in open_parts if i < first):
        own, starts = _tokens_within(opened[i], low - int(begin[i]), high - int(begin[i]))
        made = made.joined(Fragment.of(own, base, starts), base)
    if len(inside):
        closed = aligner.closed(parts[first:last])
        if closed is None:
            return None
        closed.links = closed.links.tolist()
        made = made.joined(closed, base)
    for i in sorted(i for i in open_parts if i >= last and len(inside)):
        own, starts = _tokens_within(opened[i], low - int(begin[i]), high - int(begin[i]))
        made = made.joined(Fragment.of(own, base, starts), base)
    return made


_OPEN = ("head_a", "head_a_len", "head_b", "head_b_len", "tail_a", "tail_a_len", "tail_b", "tail_b_len")
_FRAGMENT = "row long, doc_id long, chunk int, valid boolean, cut boolean, groups binary, n_a long, n_b long, n_groups long, n_links long, links array<long>, " + ", ".join(f"{c} array<int>" for c in _OPEN)
_FRAGMENT_NAMES = [c.split()[0] for c in _FRAGMENT.split(", ")]
_LISTS = {"links": pa.list_(pa.int64())} | {c: pa.list_(pa.int32()) for c in _OPEN}


def _columns(row: int, doc_id: int | None, chunk: int, f: Fragment | None, n_links: int, links: list[int]) -> list[pa.Array]:
    """One row of fragments; n_links counts all, `links` are those that no lot has."""
    valid, f = f is not None, f or Fragment()
    split = [x for side in (*f.head, *f.tail) for x in ([t for t, _ in side], [n for _, n in side])]
    own = [row, doc_id, chunk, valid, f.cut, f.groups, f.n_a, f.n_b, f.n_groups, n_links, links, *split]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *_LISTS.values()]
    return [pa.array([x], k) for x, k in zip(own, kinds)]


def _fragment(row: dict) -> Fragment | None:
    if not row["valid"]:
        return None
    sides = [list(zip(row[c], row[f"{c}_len"])) for c in ("head_a", "head_b", "tail_a", "tail_b")]
    return Fragment((sides[0], sides[1]), row["cut"], row["groups"], row["n_a"], row["n_b"], row["n_groups"], row["links"], (sides[2], sides[3]))


def _joined_rows(base: int, last: bool):
    """Joins the fragments of a group of neighbours; last: they are a whole text."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [_fragment(r) for r in rows]
        n = sum(r["n_links"] - len(r["links"]) for r in rows)
        whole = None if None in parts else reduce(lambda x, y: x.joined(y, base), parts)
        if last and whole is not None:
            whole = finished(whole, base)
        links = [] if whole is None else list(whole.links)
        return pa.table(_columns(rows[0]["row"], rows[0]["doc_id"], rows[0]["chunk"] // FAN, whole, n + len(links), links), _FRAGMENT_NAMES)

    return join


def tree_joined(fragments: DataFrame, base: int) -> DataFrame:
    """One row of `fragments` for each text, joined FAN at a time by as many tasks as there are groups."""
    most = fragments.agg(F.max("chunk")).first()[0] or 0
    while True:
        last = most < FAN
        fragments = fragments.withColumn("_g", F.floor(F.col("chunk") / FAN)).groupBy("row", "_g").applyInArrow(_dropping(_joined_rows(base, last)), _FRAGMENT)
        if last:
            return fragments
        most //= FAN


def _dropping(join):
    return lambda table: join(table.drop(["_g"]) if "_g" in table.column_names else table)


_LOT = "lot long, pairs array<long>, times array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, wide boolean, places array<binary>"
_LOT_NAMES = [c.split()[0] for c in _LOT.split(", ")]


def _lot(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    """A lot: its pairs and how often it has them, its texts, and each text's links as places among the pairs."""
    # A few texts at a time: a lot has far fewer pairs than links.
    some = [slice(i, i + TOGETHER) for i in range(0, len(links), TOGETHER)]
    pairs = np.unique(np.concatenate([np.unique(np.concatenate(links[part])) for part in some]))
    kind, times, places = np.uint32 if len(pairs) > 1 << 16 else np.uint16, np.zeros(len(pairs), np.int64), []
    for part in some:
        place = pairs.searchsorted(np.concatenate(links[part]))
        times += np.bincount(place, minlength=len(pairs))
        cuts = np.cumsum([0, *map(len, links[part])])
        places += [place[a:b].astype(kind).tobytes() for a, b in zip(cuts, cuts[1:])]
    values = [number, pairs, times, *zip(*rows), kind is np.uint32, places]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 6, pa.list_(pa.string()), pa.bool_(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _LOT_NAMES)


def _short_lots(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Lots of the texts that are aligned as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_for(path_a, path_b), TaskContext.get().partitionId() << 32
        rows, links, held, none = [], [], 0, np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 500):
                ids, texts = (c.slice(start, 500).to_pylist() for c in batch.columns)
                cut = [aligner.parts(t) if t else [] for t in texts]
                every = set().union(*cut)
                aligner.learn(every)
                for doc_id, parts in zip(ids, cut):
                    f = aligner.closed(parts) if parts else None
                    rows.append((doc_id, 0, 0, 0, "") if f is None else (doc_id, f.n_a, f.n_b, f.n_groups, hashlib.sha256(f.groups).hexdigest()))
                    links.append(none if f is None else f.links)
                    held += 20 + len(links[-1])
                aligner.forget_long(every)
                if held > LOT:
                    yield _lot(number, rows, links)
                    number, rows, links, held = number + 1, [], [], 0
        if rows:
            yield _lot(number, rows, links)

    return docs.mapInArrow(run, _LOT)


def _long_fragments(docs: DataFrame, path_a: str, path_b: str, chunk: int) -> DataFrame:
    """Fragments of the ranges of long texts, each with the pairs of its closed groups (`pairs`, `times`)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (part, low, high) in enumerate(slices(text, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((row, pa.int64()), (doc_id, pa.int64()), (i, pa.int32()), (part, pa.string()), (low, pa.int64()), (high, pa.int64()))], ["row", "doc_id", "chunk", "text", "low", "high"])
                row += 1

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(path_a, path_b)
        for batch in batches:
            for r in batch.to_pylist():
                f = range_fragment(aligner, r["text"], r["low"], r["high"])
                pairs, times = np.unique(np.array(f.links if f else [], np.int64), return_counts=True)
                columns = _columns(r["row"], r["doc_id"], r["chunk"], f, len(f.links) if f else 0, [])
                aligner.forget_long({p for p in BETWEEN.split(r["text"]) if p in aligner.known})
                yield pa.RecordBatch.from_arrays([*columns, pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))], [*_FRAGMENT_NAMES, "pairs", "times"])

    spread = docs.mapInArrow(cut, "row long, doc_id long, chunk int, text string, low long, high long").repartition("row", "chunk")
    return spread.mapInArrow(aligned, f"{_FRAGMENT}, pairs array<long>, times array<long>")


def _resolved(lots: DataFrame, counts: DataFrame) -> DataFrame:
    """The lots' texts with the sums over their links. counts: pair, n, best."""
    asked = lots.select("lot", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    told = asked.groupBy("lot").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("c")).select("lot", F.col("c.n").alias("n"), F.col("c.best").alias("best"))
    joined = lots.drop("pairs", "times").join(told, "lot", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, best = np.array(r["n"] or [0], np.int64), np.array(r["best"] or [0], np.int64)
                places = [np.frombuffer(p, np.uint32 if r["wide"] else np.uint16) for p in r["places"]]
                sums = [(len(p), int(best[p].sum()), int(n[p].sum())) if len(p) else (0, 0, 0) for p in places]
                columns = [r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], *zip(*sums), r["digest"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Each text's tokens, groups, links and their corpus-wide counts, and the digest of its groups.

    n_best counts links whose pair is linked as often as any pair with the same second id; count_sum adds up the pairs' counts over
    all links.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base, long = aligner_for(path_a, path_b).base, F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    lots = written(_short_lots(picked.filter(~long), path_a, path_b), "lots")
    fragments = written(_long_fragments(picked.filter(long), path_a, path_b, chunk), "fragments")
    whole = written(tree_joined(fragments.drop("pairs", "times"), base), "whole")
    valid = whole.filter("valid").select("row", F.explode("links").alias("pair"), F.lit(1).cast("long").alias("times"))
    pairs = F.explode(F.arrays_zip("pairs", "times")).alias("p")
    ranges = fragments.join(whole.filter("valid").select("row"), "row", "left_semi").select("row", pairs).select("row", "p.pairs", "p.times").toDF("row", "pair", "times")
    of_long = ranges.unionByName(valid).groupBy("row", "pair").agg(F.sum("times").alias("times"))
    of_lots = lots.select(pairs).select("p.pairs", "p.times").toDF("pair", "times")
    total = written(of_lots.unionByName(of_long.select("pair", "times")).groupBy("pair").agg(F.sum("times").alias("n")), "totals")
    highest = total.groupBy((F.col("pair") % base).alias("b")).agg(F.max("n").alias("highest"))
    counts = total.withColumn("b", F.col("pair") % base).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    sums = of_long.join(counts, "pair").groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    told = whole.drop("n_links").join(sums, "row", "left")
    zero = lambda c: F.when(F.col("valid"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c)
    digest = F.when(F.col("valid"), F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    longer = told.select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), digest)
    return _resolved(lots, counts).unionByName(longer)
