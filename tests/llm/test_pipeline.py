"""The pipeline from end to end, and names that its stages use themselves."""

import random

import corpus_pipeline
from orrery.llm import packing, quality, rules, simhash
from orrery.llm.common import split_of, table
from orrery.llm.queries import WORD_BPE
from pyspark.sql import functions as F


def test_run(spark):
    """The stages' results put together by hand, near copies by comparing all pairs of sets."""
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder).collect()
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"), split_of("doc_id", 5) != 0)
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
    held = {r.doc_id for r in rules.judged(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good & held}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = sorted((root(a), root(b)))
                first[y] = x
    left = [i for i in ids if root(i) == i]
    assert 0 < len(left) < len(texts) < docs.count()
    # Each document that is left is packed whole, and all sequences are gapless.
    pieces = packing.pieces(docs.filter(F.col("doc_id").isin(left)), WORD_BPE)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(map(tuple, pieces.collect()))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_columns_named_as_the_key(spark):
    """A column that has the name of a row's key stays as it is."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (3, "other words", "c", 7)], "doc_id long, text string, _row string, __ROW int")
    got = simhash.keep_first(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, text, "a", 5), (3, "other words", "c", 7)]


def test_scores_that_do_not_fit():
    """A pair's part beyond what 16 bits hold is an error, not cut."""
    import numpy as np
    import pytest

    from orrery.llm import maxent

    fits = np.array([-15.9, 0.0, 15.9]) * np.log(10)
    assert np.abs(maxent.in_steps(fits) / maxent.STEPS * np.log(10) - fits).max() < np.log(10) / maxent.STEPS
    for value in (16.1, -16.1):
        with pytest.raises(ValueError):
            maxent.in_steps(np.array([value]) * np.log(10))


def test_near_copies_by_fingerprints_first(spark, monkeypatch):
    """The stage's near copies come through the BK-trees where fingerprints are near, even if nothing else finds them; the whole sets are compared."""
    rng = random.Random(8)
    base = [rng.choices([f"w{i}" for i in range(5000)], k=400) for _ in range(3)]
    fingerprint = lambda words: simhash.fingerprint(" ".join(words), simhash.WIDTH)
    edits = lambda words: ([*words[: -1 - i], f"end{i}"] for i in range(50))
    near = [next(x for x in edits(b) if 0 < (fingerprint(b) ^ fingerprint(x)).bit_count() <= simhash.RADIUS) for b in base]
    texts = [" ".join(t) for both in zip(base, near) for t in both] + [" ".join(base[0][:200] + base[1][200:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    radii, own = [], simhash.links_of
    monkeypatch.setattr(simhash, "links_of", lambda *a: radii.append(a[1]) or own(*a))
    monkeypatch.setattr(simhash, "_best", lambda pivots: pivots.filter("false").select("a", "b"))
    monkeypatch.setattr(simhash, "_pairs_across", lambda *a: simhash.written(own(docs.select(F.col("doc_id").alias("fp")).filter("false"), 2), "none"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 4, 6]
    assert radii == [simhash.RADIUS]


def test_unlike_texts_that_share_lines(spark, monkeypatch):
    """Of long unlike texts that share rare lines only a text's best pivots are made pairs, not all; near copies among them are found."""
    rng, words = random.Random(9), [f"w{i}" for i in range(20_000)]
    texts = [rng.choices(words, k=1700) for _ in range(60)]
    for _ in range(450):
        line = rng.choices(words, k=9)
        for i in rng.sample(range(60), 4):
            texts[i] += line
    texts.append(texts[7][:-100])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs, own = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda found, *a: pairs.append(found.count()) or own(found, *a))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {i: i for i in range(60)} | {60: 7}
    assert sum(pairs) <= 2 * len(texts)


def test_pairs_come_once(spark, monkeypatch):
    """Sets that meet by many shingles are one pair, and of a large group of near copies there is about a row for each; no link is lost."""
    rng, words = random.Random(10), [f"w{i}" for i in range(20_000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=300)
        texts += [base, base[:-9]]
    base = rng.choices(words, k=300)
    for _ in range(60):
        texts.append(list(base))
        for _ in range(2):
            texts[-1][rng.randrange(300)] = rng.choice(words)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, own = [], simhash._possible_pairs
    monkeypatch.setattr(simhash, "_possible_pairs", lambda *a: rows.append(own(*a).count()) or own(*a))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: i // 2 * 2 if i < 80 else 80 for i in range(140)}
    assert sum(rows) <= 3 * len(texts)


def test_links_of_one_group_are_joined_once(spark, monkeypatch):
    """A dense group is one after few rounds: later rounds meet only the links that are left."""
    ids = spark.createDataFrame([(i, i) for i in range(100)], "fp long, first long")
    links = spark.createDataFrame([(a, b) for a in range(40) for b in range(a)] + [(a, a + 1) for a in range(50, 99)], "a long, b long")
    tables, own = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, *a: tables.append((name, (made := own(df, name, *a)).count())) or made)
    got = {r.fp: r.first for r in simhash.components(links, ids).collect()}
    assert got == {i: 0 if i < 40 else 50 for i in [*range(40), *range(50, 100)]}
    edges = [n for name, n in tables if name == "edges"]
    assert edges[-1] == 0 and sum(edges[1:]) < edges[0]


def test_frequent_words_stay_known(monkeypatch):
    """Words that come again and again are encoded once, however many others come between; ids are the same as without memory."""
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    tokenizer, learned = packing.WordTokenizer(WORD_BPE), []
    own = tokenizer._learn
    monkeypatch.setattr(tokenizer, "_learn", lambda words: learned.extend(words) or own(words))
    for i in range(30):
        text = "again, and once more. " + " ".join(f"w{i}x{j}" for j in range(20))
        fresh = packing.WordTokenizer.__new__(packing.WordTokenizer)
        fresh.tokenizer, fresh.known, fresh.before = tokenizer.tokenizer, {}, {}
        assert tokenizer.encode([text]) == fresh.encode([text])
    assert len(tokenizer.known) + len(tokenizer.before) <= 400
    assert all(learned.count(word) == 1 for word in (b"again,", b"and", b"once", b"more."))
