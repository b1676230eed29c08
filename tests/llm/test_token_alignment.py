"""Alignment of two tokenizers against a plain version over whole texts."""

import bisect
import hashlib
import tracemalloc
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from orrery.llm import crosstok
from orrery.llm.crosstok import Fragment
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PLAIN = "The quick brown fox, 12345 times: unbelievably internationalised naïve Grüße — 東京タワー 🙂. "


@lru_cache
def tokenizers():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of, extra = {}, 256
    for c in range(256):
        if c in range(33, 127) or c in range(161, 173) or c in range(174, 256):
            byte_of[chr(c)] = c
        else:
            byte_of[chr(extra)] = c
            extra += 1
    return a, b, byte_of


def plain_tokens(text):
    a, b, byte_of = tokenizers()
    one = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    data = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == data == b"".join(x for _, x in two) else None


def plain_alignment(text):
    """Groups as text, numbers, and all links, by every pair of tokens of a group."""
    tokens = plain_tokens(text) if text else None
    if tokens is None:
        return "", 0, 0, 0, []
    spans = []
    for side in tokens:
        at, own = 0, []
        for i, data in side:
            own.append((i, at, at + len(data)))
            at += len(data)
        spans.append(own)
    ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, links, of = [], [], {e: ([], []) for e in ends}
    for k, side in enumerate(spans):
        for t in side:
            of[ends[bisect.bisect_left(ends, t[2])]][k].append(t)
    for a, b in of.values():
        groups.append(",".join(str(t[0]) for t in a) + "|" + ",".join(str(t[0]) for t in b))
        links += [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
    return ";".join(groups), len(spans[0]), len(spans[1]), len(groups), links


def plain_rows(rows):
    found = [(doc_id, *plain_alignment(text)) for doc_id, text in rows]
    count = Counter(x for f in found for x in f[-1])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(doc_id, n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for doc_id, groups, n_a, n_b, n_groups, links in found]


def texts(seed, n):
    rng = np.random.default_rng(seed)
    pool = ["a", "b", "word", "Ab", " ", "  ", "\n", "\t", " ", "\x85", "\x1c", "\x00", "é", "ß", "東", "🙂", "é", "1", "23", "'s", "'ll", ".", "--", "<s>", "<|endoftext|>", "﻿", "​", "ﬁ", "<0x41>", "　"]
    found = [None, "", " ", "x", PLAIN, PLAIN * 30, "no▁place", " lead", "trail ", "two  spaces", "a\n b", "a \nb", "x" * 300, "▁"]
    while len(found) < n:
        found.append("".join(rng.choice(pool, rng.integers(1, 40), p=None)) if rng.random() < 0.7 else " ".join(rng.choice(pool[:5] + pool[12:], rng.integers(1, 60))))
    return found


def test_rows(spark):
    rows = list(enumerate(texts(1, 400))) + [(None, PLAIN), (3, "again"), (3, "again"), (10**12, PLAIN * 40 + " ▁ " + PLAIN * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("row", F.lit(1)).withColumn("lot", F.lit("x"))
    want = sorted(plain_rows(rows), key=str)
    for chunk in (32_768, 100):
        got = crosstok.aligned(df, A, B, chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_long_texts(spark):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list(PLAIN) + [" "] * 8, 90_000))
    rows = [(1, long), (2, PLAIN * 900), (3, "unbroken" * 9000), (4, "short one"), (5, long + " ▁")]
    got = crosstok.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, chunk=2048)
    assert sorted(map(tuple, got.collect())) == sorted(plain_rows(rows))


def test_empty(spark):
    assert crosstok.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_lots(spark, monkeypatch):
    """Many small lots give what one gives."""
    rows = list(enumerate(texts(4, 120)))
    monkeypatch.setattr(crosstok, "LOT", 50)
    got = crosstok.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_rows(rows), key=str)


def shape(f):
    return f.head, f.cut, f.groups, f.n_a, f.n_b, f.n_groups, sorted(f.links), f.tail


@pytest.mark.parametrize("seed", range(20))
def test_fragments_join_in_any_brackets(seed):
    """Ranges with any borders, joined in any brackets, are the whole; the empty fragment changes nothing."""
    rng = np.random.default_rng(seed)
    aligner = crosstok.aligner_for(A, B)
    text = "".join(rng.choice(list(PLAIN), rng.integers(1, 60))).strip() or "x"
    tokens = next(aligner.tokens([text]))
    if tokens is None:
        pytest.skip("not spelled")
    size = len(text.encode()) + 1
    borders = sorted({0, size, *rng.integers(1, size, 6).tolist()})
    parts = []
    for low, high in zip(borders, borders[1:]):
        own, starts = crosstok._tokens_within(tokens, low, high)
        parts.append(Fragment.of(own, aligner.base, starts))
    join = lambda x, y: x.joined(y, aligner.base)
    whole = reduce(join, parts)
    for _ in range(6):
        some = list(parts)
        some.insert(int(rng.integers(0, len(some) + 1)), Fragment())
        while len(some) > 1:
            i = int(rng.integers(0, len(some) - 1))
            some[i : i + 2] = [join(some[i], some[i + 1])]
        assert shape(some[0]) == shape(whole)
    done = crosstok.finished(whole, aligner.base)
    groups, n_a, n_b, n_groups, links = plain_alignment(text)
    assert (done.groups.decode(), done.n_a, done.n_b, done.n_groups) == (groups, n_a, n_b, n_groups)
    assert Counter(done.links) == Counter(a * aligner.base + b for a, b in links)


def test_slices():
    rng = np.random.default_rng(8)
    aligner = crosstok.aligner_for(A, B)
    for size in (7, 30, 200):
        for _ in range(30):
            text = "".join(rng.choice(list(PLAIN), rng.integers(1, 400)))
            parts = list(crosstok.slices(text, size))
            assert sum(high - low for _, low, high in parts) == len(text.encode()) + 1
            found = [crosstok.range_fragment(aligner, *p) for p in parts]
            want = plain_alignment(text)
            if want[0]:
                done = crosstok.finished(reduce(lambda x, y: x.joined(y, aligner.base), found), aligner.base)
                assert done.groups.decode() == want[0]


def test_memory_of_a_lot():
    """A lot's pairs are found in a few times the memory that its links take, and are those of all links."""
    rng = np.random.default_rng(4)
    links = [rng.integers(0, 12_000, n) ** 2 for n in (0, 1, *[1000] * 1000)]
    rows = [(i, 0, 0, 0, "") for i in range(len(links))]
    tracemalloc.start()
    batch = crosstok._lot(7, rows, links)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * sum(x.nbytes for x in links)
    lot = batch.to_pylist()[0]
    pairs, times = np.unique(np.concatenate(links), return_counts=True)
    assert lot["pairs"] == pairs.tolist() and lot["times"] == times.tolist() and not lot["wide"]
    assert all((pairs[np.frombuffer(p, np.uint16)] == x).all() for p, x in zip(lot["places"], links, strict=True))


def test_remembered_parts_are_bounded():
    """Words that occur once don't pile up."""
    aligner = crosstok.Aligner(A, B)
    for i in range(0, 200_000, 20_000):
        aligner.learn({f"w{j}" for j in range(i, i + 20_000)})
        assert len(aligner.known) <= 100_000
    assert aligner.closed(["w199999"]).n_groups > 0
