"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a byte string has exactly one encoding, so it has exactly one last token. It is the only token that ends
there, follows a valid encoding of what is before it, and is compatible with that encoding's last token: two tokens are
compatible if byte pair merging of their joined bytes gives back the two. Storing the last token of each prefix gives the
whole encoding by walking back, lets an encoding be appended to exactly, and lets an edit be re-encoded from its start
until the stored tokens agree with the old ones over the longest token's length.

The DataFrame operator encodes each match of the splitting pattern separately. Texts are cut at single spaces between two
characters that aren't white space: a match always begins there, so what stands between two cuts has the same ids in any
text and is looked up among those met before. Those tables are bounded and cleared when full.

Edge cases: a null text counts as empty and gets no ids. Very long runs without a boundary take time in proportion to
their length. Ids, null ids included, are passed through, repeated rows are answered each; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that each table of results keeps: of matches of the pattern, and of parts between cuts.
PIECES, PARTS = 400_000, 150_000


class Vocabulary:
    """Tokens by rank, with the tables that the prefix method needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token: its rank if it is a token itself, else -1.
        self.endings = {token[i:]: -1 for token in ranks for i in range(len(token))} | ranks
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self._follows: dict[int, bool] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that byte pair merging (the lowest rank first, leftmost among equals) joins last; None for a byte, or if merging doesn't end in the token."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token (side 0: its start, 1: its end) as merging builds it, and the rank of the merge that replaces it."""
        if (known := self._edges[side].get(token)) is None:
            known, at, later = [], self.tokens[token], 1 << 60
            while True:
                known.append((at, later))
                later = self.ranks[at]
                if (halves := self.halves(at)) is None:
                    break
                at = halves[side]
            known.reverse()
            self._edges[side][token] = known
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether merging the two tokens' joined bytes gives back the two: no merge across the border comes before those that build them."""
        pair = before << 32 | token
        if (known := self._follows.get(pair)) is None:
            left, right, i, j, known = self._edge(before, 1), self._edge(token, 0), 0, 0, True
            while known:
                (a, a_ends), (b, b_ends) = left[i], right[j]
                rank = self.ranks.get(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    known = False
                elif a_ends == b_ends == 1 << 60:
                    break
                elif a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
            if len(self._follows) >= PIECES:
                self._follows.clear()
            self._follows[pair] = known
        return known

    def alone(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.halves(self.tokens[token]) is not None

    def last_tokens(self, data: bytes, last: list[int], end: int) -> None:
        """Adds to `last`, whose item i is the last token of data[:i + 1], those of the prefixes up to `end`."""
        endings, known, follows, longest = self.endings.get, self._follows.get, self.follows, self.longest
        for stop in range(len(last) + 1, end + 1):
            fitting, start, least = [], stop - 1, max(0, stop - longest)
            while start >= least and (token := endings(data[start:stop])) is not None:
                if token >= 0:
                    fitting.append((start, token))
                start -= 1
            for start, token in reversed(fitting):
                if start:
                    fits = known(last[start - 1] << 32 | token)
                    if fits is None:
                        fits = follows(last[start - 1], token)
                else:
                    fits = self.alone(token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {stop}")

    def walk_back(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes stand for."""
        found, at = [], len(last)
        while at:
            found.append(last[at - 1])
            at -= len(self.tokens[found[-1]])
        found.reverse()
        return found

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.last_tokens(data, last, len(data))
        return self.walk_back(last)


class PrefixEncoding:
    """An encoding that can grow and change: the bytes and the last token of each of their prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; the earlier prefixes' tokens stay as they are."""
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in place of data[start:end]; returns how many prefixes were encoded again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agreed = 0
        for at in range(start + 1, len(self.data) + 1):
            self.vocabulary.last_tokens(self.data, self.last, at)
            before = at - shift
            agreed = agreed + 1 if before > end and old[before - 1] == self.last[-1] else 0
            if agreed >= self.vocabulary.longest:
                self.last.extend(old[before:])
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        """The encoding of all bytes."""
        return self.vocabulary.walk_back(self.last)


class Encoder:
    """Encodes texts by pattern and prefix method; remembers what it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self._pieces: list[dict[str, bytes]] = [{}, {}]
        self._parts: list[dict[str, bytes]] = [{}, {}]

    def _remember(self, tables: list[dict[str, bytes]], most: int, key: str, ids: bytes) -> bytes:
        """Keeps the newest results; when they fill a table, it becomes the older of the two."""
        if len(key) <= 64:
            if len(tables[0]) >= most:
                tables[:] = {}, tables[0]
            tables[0][key] = ids
        return ids

    def _text(self, text: str) -> bytes:
        found, (new, older) = [], self._pieces
        for piece in self.split(text):
            if (ids := new.get(piece)) is None:
                if (ids := older.get(piece)) is None:
                    ids = array("I", self.vocabulary.encode(piece.encode())).tobytes()
                ids = self._remember(self._pieces, PIECES, piece, ids)
                new, older = self._pieces
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *parts = text.split(" ")
        if not first or first[-1].isspace() or "" in parts:
            return self._text(text)
        known = list(map(self._parts[0].get, parts))
        if None in known:
            older = self._parts[1]
            for i, ids in enumerate(known):
                if ids is None:
                    part = parts[i]
                    if part[0].isspace() or part[-1].isspace():
                        return self._text(text)
                    ids = older.get(part)
                    known[i] = self._remember(self._parts, PARTS, part, self._text(" " + part) if ids is None else ids)
                    older = self._parts[1]
        return self._text(first) + b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder_for(path: str, pattern: str) -> Encoder:
    """One encoder a process: later tasks of the same worker find its tables filled."""
    return Encoder(Vocabulary(read_ranks(path)), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `ids` (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                ids = np.frombuffer(encoder.encode(text.as_py() or ""), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`doc_id`, `data` (the bytes that `ids` stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for batch in batches:
            data = [encoder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_tokens`, and the digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for batch in batches:
            sizes, of_ids, of_data = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                sizes.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_data.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
