"""Quality classifier by attention over passages (multiple-instance learning).

Only whole documents carry labels. A document is cut into passages, each described by figures on its characters, words and
repetitions; an encoder layer turns them into vectors, gated attention weighs the passages of a document, and the weighted
vector is scored. Encoder, attention and score are learned together from the documents' labels.

Training uses at most `SAMPLE` labelled documents of each class, chosen by a hash of their ids over all labelled rows and
weighted back to the classes' true shares; a document has at most `MOST` passages, which are longer in longer documents, so
whole texts count and the sample's size is bounded. Scoring reads every whole text once.

Edge cases: labels other than 0 and 1, null ids, and documents labelled both ways teach nothing; repeated labels count once,
and so do rows with one id, of which the one with the least description teaches. Without labels of both classes the score is the share of label 1 (0.5 without any). Null and empty
texts have one passage without words and get a score like any other. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
#: Words of a passage at least, and passages of a document at most.
PASSAGE, MOST = 64, 64
HIDDEN, ROUNDS, RATE, DECAY = 16, 250, 0.03, 1e-4
#: A document with a score below this is predicted to be of label 0.
THRESHOLD = 0.3
#: Texts described at a time, in bytes.
CHUNK = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?;:", "'\"()[]{}", "-_/@+=~^\\`", "#*$%&|<>")
_KIND = np.full(256, len(_KINDS) + 2, np.int64)
for _i, _chars in enumerate(_KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
_KIND[0x80:0xC0], _KIND[0xC0:] = len(_KINDS), len(_KINDS) + 1
_N_KINDS = len(_KINDS) + 3
_random = np.random.default_rng(20240229)
_BYTE, _PLACE = (_random.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (256, 64))
_GRAM = _random.integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)
FEATURES = _N_KINDS + 9


def _distinct(keys: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each group has."""
    mixed = keys ^ (groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(groups[np.unique(mixed, return_index=True)[1]], minlength=n)


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each passage its document's place in the list, in order, and its figures."""
    encoded = [(text or "").encode() for text in texts]
    buffer = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded])[:-1])).astype(np.int64)
    space = _SPACE[buffer]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    doc = np.searchsorted(begins, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    width = np.maximum(PASSAGE, -(-n_words // MOST))
    n_passages = np.maximum(1, -(-n_words // width))
    base = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    passage = base[doc] + (np.arange(len(doc)) - first[doc]) // width[doc]
    owner = np.repeat(np.arange(len(texts)), n_passages)
    if not len(doc):
        return owner, np.zeros((total, FEATURES), np.float32)
    lengths = stops - starts
    chars = buffer[~space]
    begin = np.cumsum(lengths) - lengths
    kinds = np.bincount(np.repeat(passage, lengths) * _N_KINDS + _KIND[chars], minlength=total * _N_KINDS).reshape(total, _N_KINDS)
    place = (np.arange(len(chars)) - np.repeat(begin, lengths)) % len(_PLACE)
    words = np.add.reduceat(_BYTE[chars] * _PLACE[place], begin)
    per = np.maximum(1, np.bincount(passage, minlength=total)).astype(np.float64)
    share = lambda flags: np.bincount(passage[flags], minlength=total) / per
    size = np.maximum(1, kinds.sum(axis=1))
    last, head = _KIND[chars[begin + lengths - 1]], _KIND[chars[begin]]
    same = np.concatenate(([False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])))
    whole = np.maximum(1, n_words)
    grams = sum(words[i : len(words) - 4 + i] * _GRAM[i] for i in range(5)) if len(words) > 4 else words[:0]
    inside = doc[: len(grams)] == doc[4:] if len(words) > 4 else np.zeros(0, bool)
    n_grams = np.bincount(doc[: len(grams)][inside], minlength=len(texts))
    repeated = 1 - (_distinct(grams[inside], doc[: len(grams)][inside], len(texts)) + 1) / (n_grams + 1) if len(grams) else np.zeros(len(texts))
    columns = [
        *(kinds / size[:, None]).T,
        np.bincount(passage, lengths, total) / per,
        share(last == 9),
        share(last == 5),
        share((last == 3) | (last == 4)),
        share(head == 1),
        share(same),
        _distinct(words, passage, total) / per,
        repeated[owner],
        np.log1p(whole)[owner],
    ]
    return owner, np.column_stack(columns).astype(np.float32)


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score; figures are centred and scaled first."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def score(self, owner: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of n documents, and each passage's attention."""
        if self.weights is None:
            return np.full(n, self.prior), 1 / np.bincount(owner, minlength=n)[owner]
        out = _forward(self.weights, owner, self.scaled(x), n)
        return out["score"], out["attention"]


def _forward(w: dict[str, np.ndarray], owner: np.ndarray, x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    code = np.tanh(x @ w["encode"] + w["encode_0"])
    value, gate = np.tanh(code @ w["value"]), sigmoid(code @ w["gate"])
    logits = (value * gate) @ w["attend"]
    first = np.searchsorted(owner, np.arange(n))
    weight = np.exp(logits - np.maximum.reduceat(logits, first)[owner])
    attention = weight / np.add.reduceat(weight, first)[owner]
    pooled = np.add.reduceat(attention[:, None] * code, first)
    return {"code": code, "value": value, "gate": gate, "attention": attention, "pooled": pooled, "first": first, "score": sigmoid(pooled @ w["out"] + w["out_0"])}


def fit(owner: np.ndarray, x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> Model:
    """Learns by Adam on the weighted log loss of whole documents; owner is sorted and names every document."""
    prior = float(np.average(y, weights=importance)) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(prior)
    model = Model(prior, x.mean(axis=0), x.std(axis=0) + 1e-3)
    x, n, rng = model.scaled(x), len(y), np.random.default_rng(7)
    w = {name: rng.normal(0, 1 / np.sqrt(shape[0]), shape) for name, shape in (("encode", (FEATURES, HIDDEN)), ("value", (HIDDEN, HIDDEN)), ("gate", (HIDDEN, HIDDEN)), ("attend", (HIDDEN,)), ("out", (HIDDEN,)))}
    w |= {"encode_0": np.zeros(HIDDEN), "out_0": np.array(np.log(prior / (1 - prior)))}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        f = _forward(w, owner, x, n)
        code, value, gate, attention = f["code"], f["value"], f["gate"], f["attention"]
        d_logit = importance * (f["score"] - y) / importance.sum()
        d_pooled = np.outer(d_logit, w["out"])[owner]
        d_attention = (d_pooled * code).sum(axis=1)
        d_attend = attention * (d_attention - np.add.reduceat(attention * d_attention, f["first"])[owner])
        d_both = np.outer(d_attend, w["attend"])
        d_value, d_gate = d_both * gate * (1 - value**2), d_both * value * gate * (1 - gate)
        d_code = (attention[:, None] * d_pooled + d_value @ w["value"].T + d_gate @ w["gate"].T) * (1 - code**2)
        slope = {"encode": x.T @ d_code, "encode_0": d_code.sum(axis=0), "value": code.T @ d_value, "gate": code.T @ d_gate, "attend": (value * gate).T @ d_attend, "out": f["pooled"].T @ d_logit, "out_0": d_logit.sum()}
        for k in w:
            g = slope[k] + DECAY * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w[k] = w[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    model.weights = w
    return model


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK bytes, with the place of the first."""
    held, size, begun = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK:
            yield begun, held
            held, size, begun = [], 0, i + 1
    if held:
        yield begun, held


def train(docs: DataFrame, labels: DataFrame, learns: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits a model on documents whose label row meets `learns`, a condition on `doc_id`."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learns)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter(F.col("y") == F.col("other"))
    counts = dict(rows.groupBy("y").count().collect())
    if not counts:
        return Model(0.5)
    # A share of each class by hash: about `sample` rows of each, so small enough to send everywhere.
    least = F.element_at(F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(1.0, sample / n))]), F.col("y"))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_003)) / 1_000_003 < least).select(F.col("doc_id").alias("_id"), "y")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in _chunks(batch.column(2)):
                owner, x = describe(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                part = batch.slice(begun, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "y", "x"])

    described = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(run, "doc_id long, y int, x binary")
    # One row for each id that was chosen, however often a document is repeated.
    found = sorted(described.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect())
    if not found:
        return Model(0.5)
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in found]
    y = np.array([r.y for r in found], np.float64)
    importance = np.array([counts[r.y] for r in found]) / np.bincount(y.astype(int), minlength=2)[y.astype(int)]
    return fit(np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs).astype(np.float64), y, importance)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `score` (0 to 1), `n_passages` and `attention`, the greatest weight of a passage, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in _chunks(batch.column(1)):
                owner, x = describe(texts)
                scores, attention = model.score(owner, x, len(texts))
                first = np.searchsorted(owner, np.arange(len(texts)))
                columns = [pa.array(scores), pa.array(np.bincount(owner, minlength=len(texts))), pa.array(np.maximum.reduceat(attention, first))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(texts)), *columns], ["doc_id", "score", "n_passages", "attention"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, n_passages long, attention double")


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`doc` (a whole row of `docs`, ids or not) and its `score`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in _chunks(batch.column(0).field(text_col)):
                scores, _ = model.score(*describe(texts), len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(texts)), pa.array(scores)], ["doc", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def predicted(score_col: str = "score") -> Column:
    """1 for a score of THRESHOLD or more, else 0."""
    return (F.col(score_col) >= THRESHOLD).cast("int")
