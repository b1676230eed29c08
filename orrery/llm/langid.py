"""Language identification of documents and of the spans of mixed-language texts.

A model holds, for each language that labelled documents name, log probabilities of hashed character n-grams and whole
words, and the scripts that the language is written in. A word's script narrows the languages that it can have; each of
those gets the word's score. Viterbi, with a penalty for each switch, labels all words of a text; runs of one label are its
spans, and the label of most words is the document's language.

Training counts n-grams in at most `SAMPLE` documents of each language, chosen by a hash of ids over all labelled rows.
The distinct values of the label are taken to be few, as names of languages are. Scoring reads every whole text once.

Edge cases: letters are what Unicode calls so; digits, fractions and the like are none. A null text, or one without letters, is `und` with score 0 and has no spans; so is every text if no row can be
learned from. Null languages teach nothing. Ties go to the language that sorts first. Repeated rows are answered each, null
ids are passed through, empty tables give empty results. A very long text takes a few tens of bytes a word while it is
labelled. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000
BUCKETS = 1 << 15
SWITCH = 7.0
#: What a language loses on a word in a script that it hardly uses, and the share of words that is hardly.
OTHER_SCRIPT, HARDLY = 30.0, 0.005
UNKNOWN = "und"
#: Words that are remembered, and texts labelled at a time, in characters.
REMEMBERED, CHUNK = 400_000, 6_000_000

#: What counts as a word's character but is no letter: numbers of other kinds than digits, such as fractions.
_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: The same in two patterns: one of the characters up to U+FFFF, which is searched for quickly, one of all.
_NUMBER, _ANY_NUMBER = re.compile(f"[{''.join(c for c in _NUMBERS if c <= chr(0xFFFF))}]"), re.compile(f"[{_NUMBERS}]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_]+")
#: First code point of each range of scripts, in order.
_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1900, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"),
    (0x20000, "Han"),
)
_FIRST = [first for first, _ in _RANGES]


def lowered(text: str) -> str:
    """The text in lower case, every character in its place, numbers that `_WORD` would take for letters as spaces."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    if low.isascii() or not (_NUMBER.search(low) or _BEYOND.search(low)):
        return low
    return _ANY_NUMBER.sub(" ", low)


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _RANGES[bisect_right(_FIRST, ord(word[0])) - 1][1]


def grams(word: str) -> list[int]:
    """Buckets of the word itself and of its one to three character runs, its edges marked."""
    edged = f"^{word}$"
    found = [edged, *(edged[i : i + n] for n in (1, 2, 3) for i in range(len(edged) - n + 1))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in found]


@dataclass
class Model:
    """Log probabilities by bucket and language, and which languages use each script."""

    langs: list[str]
    logp: np.ndarray | None = None
    scripts: dict[str, np.ndarray] = field(default_factory=dict)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; languages that don't use its script lose."""
        buckets = [grams(w) for w in words]
        sizes = np.array([len(b) for b in buckets])
        # Runs of three lengths overlap: a third of their sum is about one reading of the word.
        sums = np.add.reduceat(self.logp[np.concatenate([np.array(b) for b in buckets])], np.cumsum(sizes) - sizes) / 3
        everyone = np.ones(len(self.langs), bool)
        uses = np.stack([self.scripts.get(script(w), everyone) for w in words])
        return np.where(uses, sums, sums - OTHER_SCRIPT).astype(np.float32)


class Labeller:
    """Labels texts; remembers the scores of words it has met, up to a bound."""

    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)

    def _places(self, words: list[list[str]]) -> list[int]:
        """Where each word's scores are."""
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*words)
        if new:
            rows, begun = sorted(new), len(self.known)
            if begun + len(rows) > len(self.scores):
                self.scores = np.concatenate((self.scores[:begun], np.zeros((begun + 2 * len(rows), len(self.model.langs)), np.float32)))
            for i in range(0, len(rows), 20_000):
                self.scores[begun + i : begun + min(i + 20_000, len(rows))] = self.model.score_words(rows[i : i + 20_000])
            self.known.update(zip(rows, range(begun, begun + len(rows))))
        get = self.known.__getitem__
        return [get(word) for some in words for word in some]

    def label(self, words: list[list[str]]) -> list[np.ndarray]:
        """The best path for each list of words: numbers of languages."""
        sizes = np.array([len(w) for w in words], np.int64)
        places = np.array(self._places(words), np.int64)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        labels = np.zeros(len(places), np.int16)
        if not len(order):
            return [labels] * len(words)
        size, begin = sizes[order], begins[order]
        # All texts take a step at a time; those still running stand first.
        running = np.searchsorted(-size, -np.arange(size[0]), "left")
        value = np.zeros((len(order), len(self.model.langs)), np.float32)
        # A row for each word, in the order of the steps: a byte for each language and two more.
        switched, best_from = np.empty((len(places), len(self.model.langs)), bool), np.empty(len(places), np.int16)
        at = np.concatenate(([0], np.cumsum(running)))
        for t in range(size[0]):
            n, step = running[t], slice(at[t], at[t + 1])
            v = value[:n]
            source = v.argmax(axis=1)
            best = v[np.arange(n), source] - (self.switch if t else 0)
            take = v < best[:, None]
            value[:n] = np.where(take, best[:, None], v) + self.scores[places[begin[:n] + t]]
            switched[step], best_from[step] = take, source
        state = value.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            n, step = running[t], slice(at[t], at[t + 1])
            now = state[:n]
            labels[begin[:n] + t] = now
            state[:n] = np.where(switched[step][np.arange(n), now], best_from[step], now)
        return [labels[b : b + s] for b, s in zip(begins, sizes)]


def spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of one label, in code points of a `lowered` text; together they cover it."""
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist()]
    if len(cuts) == 1:
        return [{"start": 0, "end": len(text), "lang": langs[labels[0]]}]
    at = [m.start() for m in _WORD.finditer(text)]
    edges = [0, *(at[c] for c in cuts[1:]), len(text)]
    return [{"start": a, "end": b, "lang": langs[labels[c]]} for a, b, c in zip(edges, edges[1:], cuts)]


def train(docs: DataFrame, learns: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams of documents that meet `learns`, a condition on `doc_id`, and name a language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & learns)
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return Model([])
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_003)) / 1_000_003 < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(_WORD.findall(lowered(text.as_py() or "")))
        for lang, words in held.items():
            seen, scripts = np.zeros(BUCKETS), Counter()
            for word, n in words.items():
                scripts[script(word)] += n
                for g in grams(word):
                    seen[g] += n
            some, names = np.flatnonzero(seen), list(scripts)
            buckets = pa.array([*some.tolist(), *[None] * len(names)], pa.int64())
            counts = pa.array([*seen[some].astype(int).tolist(), *scripts.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), buckets, pa.array([*[None] * len(some), *names], pa.string()), counts], ["lang", "bucket", "script", "n"])

    summed = chosen.mapInArrow(run, "lang string, bucket long, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    langs = sorted(counts)
    number = {lang: i for i, lang in enumerate(langs)}
    seen = np.zeros((BUCKETS, len(langs)))
    words: dict[str, np.ndarray] = {}
    for lang, bucket, name, n in summed.collect():
        if name is None:
            seen[bucket, number[lang]] = n
        else:
            words.setdefault(name, np.zeros(len(langs)))[number[lang]] = n
    logp = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS))
    total = np.maximum(1, sum(words.values(), np.zeros(len(langs))))
    uses = {name: n > HARDLY * total for name, n in words.items()}
    return Model(langs, logp.astype(np.float32), {name: u for name, u in uses.items() if u.any()})


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (the share of words with that label) and `spans` of every text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def labelled(labeller: Labeller, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        texts = list(map(lowered, texts))
        words = [_WORD.findall(text) if model.langs else [] for text in texts]
        names, scores, found = [], [], []
        for text, labels in zip(texts, labeller.label(words)) if model.langs else ((t, []) for t in texts):
            if not len(labels):
                names.append(UNKNOWN), scores.append(0.0), found.append([])
                continue
            counts = np.bincount(labels)
            names.append(model.langs[counts.argmax()]), scores.append(counts.max() / len(labels))
            found.append(spans(text, labels, model.langs))
        return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "lang_pred", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch) if model.langs else None
        for batch in batches:
            texts, size, begun = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK or i == len(batch) - 1:
                    yield labelled(labeller, batch.column(0).slice(begun, len(texts)), texts)
                    texts, size, begun = [], 0, i + 1

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
