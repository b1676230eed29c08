"""Periodic runs in texts by recompression: which stretches of words repeat themselves, exactly.

Texts are sequences of word numbers. Rounds of block and pair compression turn many texts at once into a run-length grammar: a
block round replaces equal neighbours by one letter, a pair round replaces a letter of the left class with the letter of the
right class behind it; classes come from a hash of the letter, new letters are numbered by what they stand for. Equal
stretches are therefore compressed alike but for their edges, and how far two stretches agree is found by climbing the rounds
while they do and by climbing down to the first difference (`Grammar.agreement`), for many pairs of places in one step.

A run with period p is a stretch in which each word equals the one p behind it. Such a stretch of places holds a multiple of
its least length, so only places on that grid are looked at, for every p: n (1 + 1/2 + 1/3 + ...) places in all. Where the two
words are equal, the grammar tells how far the agreement goes to both sides, which is the whole run. Of the periods found for a
stretch the least one is its smallest, and places within a run whose period divides p tell nothing new and are passed over.

Edge cases: a null or empty text has no words and no runs. Ids may repeat: each row is answered. Very long texts are worked on
by themselves; memory is in proportion to their words. Further columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run's least length in words, and how many periods it holds at least.
SHORTEST, PERIODS = 12, 2
#: Words worked on at once, and places of the grid whose agreement is asked for at once.
WORDS, PLACES = 400_000, 500_000
#: More rounds than any text needs.
ROUNDS = 200


class Grammar:
    """The rounds that compress a sequence of letters; the letters at both ends must stand nowhere else."""

    def __init__(self, letters: np.ndarray, least: int = 64) -> None:
        #: For each round: the letters before it, the place in the next round that each of them goes to, the first letter of each next place, and whether it was a block round.
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        self.top = letters.astype(np.int64)
        self.next_letter = int(letters.max(initial=0)) + 1
        while len(self.top) > least and len(self.rounds) < ROUNDS:
            self._block()
            self._pair()

    def _replaced(self, first: np.ndarray, joined: np.ndarray, meaning: np.ndarray, block: bool) -> None:
        """Keeps a round: `first` are where new letters begin, `joined` which of them stand for several, `meaning` what for."""
        follows = np.zeros(len(self.top), np.int64)
        follows[first] = 1
        self.rounds.append((self.top, np.cumsum(follows) - 1, np.append(first, len(self.top)), block))
        letters = self.top[first]
        known, number = np.unique(meaning, return_inverse=True)
        letters[joined] = self.next_letter + number
        self.next_letter += len(known)
        self.top = letters

    def _block(self) -> None:
        same = self.top[1:] == self.top[:-1]
        if same.any():
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(first, len(self.top)))
            joined = np.flatnonzero(size > 1)
            self._replaced(first, joined, self.top[first[joined]] << 32 | size[joined], True)

    def _pair(self) -> None:
        mixed = (self.top.astype(np.uint64) + np.uint64(len(self.rounds))) * np.uint64(0x9E3779B97F4A7C15)
        left = (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(40) & np.uint64(1) == 1
        second = np.concatenate(([False], left[:-1] & ~left[1:]))
        first = np.flatnonzero(~second)
        joined = np.flatnonzero(np.append(second, False)[first + 1])
        self._replaced(first, joined, self.top[first[joined]] << 32 | self.top[first[joined] + 1], False)

    def agreement(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many letters from places i and j on (backward: from there back) are equal, for each pair; i and j differ."""
        step, a, b = (1 if forward else -1), i.copy(), j.copy()
        # Climb: `live` are the pairs that have agreed so far, at places a and b of the round; `left_at` are the others by round.
        live, left_at = np.arange(len(a)), []
        for letters, up, first, block in self.rounds:
            x, y = a[live], b[live]
            px, py = up[x], up[y]
            # How many letters of its next letter lie ahead of a place, and whether all of them do.
            ahead = lambda at, p: (first[p + 1] - at) if forward else (at - first[p] + 1)
            nx, ny = ahead(x, px), ahead(y, py)
            whole = (nx == first[px + 1] - first[px]) & (ny == first[py + 1] - first[py])
            equal = letters[x] == letters[y]
            # Within a next letter: on to its end, if both reach it together.
            inner = ~whole & equal
            most = np.minimum(nx, ny) if block else np.ones_like(nx)
            move = np.where(inner, most, 0)
            goes = whole | inner & ((nx == ny) if block else True)
            x, y = x + step * move, y + step * move
            a[live], b[live] = x, y
            left_at.append(live[~goes])
            live = live[goes]
            a[live], b[live] = up[a[live]], up[b[live]]
        # At the top: letter by letter.
        walking = live
        while len(walking):
            walking = walking[self.top[a[walking]] == self.top[b[walking]]]
            a[walking] += step
            b[walking] += step
        # Climb down: a and b differ in this round; in the one below at most one step agrees.
        for (letters, _, first, block), stopped in zip(reversed(self.rounds), reversed(left_at)):
            x, y = a[live], b[live]
            nx, ny = first[x + 1] - first[x], first[y + 1] - first[y]
            x, y = (first[x], first[y]) if forward else (first[x + 1] - 1, first[y + 1] - 1)
            move = np.where(letters[x] == letters[y], np.minimum(nx, ny) if block else 1, 0)
            a[live], b[live] = x + step * move, y + step * move
            live = np.concatenate((live, stopped))
        return (a - i) * step


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of sequences of numbers from 0: the sequence's place in the list, start, length, period; by sequence, start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes + 1)  # with a letter of its own before each text
    starts = ends - sizes
    highest = max((int(t.max(initial=0)) for t in texts), default=0)
    letters = np.empty(int(ends[-1]) + 1 if len(texts) else 1, np.int64)
    for k, i in enumerate(order):
        letters[starts[k] - 1] = highest + 1 + k
        letters[starts[k] : ends[k]] = texts[i]
    letters[-1] = highest + 1 + len(texts)
    found: list[np.ndarray] = []
    grammar, waiting, held = None, [], 0
    # The longest run known at each place, by its start, end and period.
    at_run = np.full(len(letters), -1, np.int64)
    known = np.zeros((0, 3), np.int64)

    def settle() -> None:
        """Extends the waiting places to runs."""
        nonlocal grammar, held, known
        place, period = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        waiting.clear()
        held = 0
        covering = at_run[place]
        inside = covering >= 0
        s, e, q = known[covering[inside]].T
        inside[inside] = (period[inside] % q == 0) & (place[inside] + period[inside] < e) & (e - s >= period[inside] + q)
        place, period = place[~inside], period[~inside]
        if not len(place):
            return
        grammar = grammar or Grammar(letters)
        start = place - grammar.agreement(place - 1, place + period - 1, False)
        end = place + period + grammar.agreement(place, place + period)
        fits = end - start >= np.maximum(SHORTEST, PERIODS * period)
        new = np.unique(np.stack((start[fits], end[fits], period[fits]), 1), axis=0)
        found.append(new)
        known = np.concatenate((known, new))
        for run, (s, e, _) in enumerate(new.tolist(), len(known) - len(new)):
            own = at_run[s:e]
            own[np.where(own >= 0, known[own, 1] - known[own, 0], 0) < e - s] = run

    longest = int(sizes[0]) if len(sizes) else 0
    for period in range(1, longest // PERIODS + 1):
        least = max(SHORTEST, PERIODS * period)
        count = int(np.searchsorted(-sizes, -least, "right"))  # texts that are long enough
        if not count:
            break
        # Equal words p apart come in a stretch of at least this length, so one of them is on the grid.
        grid, upto = least - period, int(ends[count - 1]) - period
        equal = np.flatnonzero(letters[0:upto:grid] == letters[period : upto + period : grid])
        if len(equal):
            waiting.append((equal * grid, np.full(len(equal), period)))
            held += len(equal)
            if held >= PLACES:
                settle()
    if waiting:
        settle()
    runs = np.concatenate(found) if found else known
    if not len(runs):
        return (np.zeros(0, np.int64),) * 4
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # One stretch has one smallest period.
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))]
    text = np.searchsorted(starts, runs[:, 0], "right") - 1
    owner, start = np.array(order)[text], runs[:, 0] - starts[text]
    length, period = runs[:, 1] - runs[:, 0], runs[:, 2]
    by = np.lexsort((period, start, owner))
    return owner[by], start[by], length[by], period[by]


def repeated_tail(n: int, h: int | None) -> np.ndarray | None:
    """Which word stands at each place of a text of n words whose id has the hash h, if that is one of those made periodic."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where each text's words begin in it (and the last ones end)."""
    parts = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    words, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(words, pa.scalar("", pa.large_string()))
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return words.filter(filled), before[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int64)


def collapsed(docs: DataFrame, repeat: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's runs and the text without their repetitions.

    repeat: a whole number; texts for which it is divisible by ten are made periodic first (`repeated_tail`).
    Columns: doc_id, n_runs; start, length, period and exponent_milli of the longest run; digests of all runs and of the words kept.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def answered(ids: pa.Array, texts: pa.Array, hashes: pa.Array) -> pa.RecordBatch:
        words, cuts = word_lists(texts)
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sources, sequences = [], []
        for h, a, b in zip(hashes.to_pylist(), cuts.tolist(), cuts[1:].tolist()):
            tail = repeated_tail(b - a, h)
            sources.append(np.arange(a, b) if tail is None else a + tail)
            sequences.append(codes[sources[-1]])
        owner, start, length, period = runs_of(sequences)
        edges = np.searchsorted(owner, np.arange(len(sequences) + 1))
        kept, rows = [], []
        for i, source in enumerate(sources):
            a, b = edges[i], edges[i + 1]
            s, n, q = start[a:b], length[a:b], period[a:b]
            if not len(s):
                kept.append(source)
                rows.append((0, None, None, None, None, hashlib.sha256(b"").hexdigest()))
                continue
            open_ = np.zeros(len(source) + 1, np.int64)
            np.add.at(open_, s + q, 1)
            np.add.at(open_, s + n, -1)
            kept.append(source[np.cumsum(open_)[:-1] == 0])
            best = int(np.lexsort((q, s, -n))[0])
            told = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist()))
            rows.append((len(s), int(s[best]), int(n[best]), int(q[best]), int(1000 * n[best] // q[best]), hashlib.sha256(told.encode()).hexdigest()))
        sizes = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(sizes), words.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))))
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in pc.binary_join(lists, pa.scalar(" ", pa.large_string()))]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:])), pa.array(digests)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Words are at least two bytes with the space behind them: an upper bound on how many there are.
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4 + 8)
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + WORDS, "right")))
                yield answered(*(c.slice(a, b - a) for c in batch.columns))
                a = b

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if repeat is None else repeat).cast("long").alias("h"))
    return picked.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
