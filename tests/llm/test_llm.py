"""Each operator against a plain version, on texts and tables with nulls, blanks, copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from orrery.llm import bpe, chat, langid, maxent, packing, quality, rules, simhash, topk, urls

TEXTS = [None, "", " \n\t ", "one", "one two", "The quick brown fox jumps over the lazy dog. " * 9, "the QUICK brown fox jumps over the lazy dog. " * 9, "Ünïcode wörds \x85 and spaces 日本語 😀", "a b c d e\na b c d e\n# $ | <>", "x" * 5000, "don't  stop\t\tnow  's 'S", "<|endoftext|> [INST] </s>"]
DOCS = "doc_id long, text string, score double, words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.0, "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", 0.0, None), (5, TEXTS[5], 1.0, None)], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("size", [4, 1024])
def test_groups(spark, size):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(8)]
    for v in list(values):
        for _ in range(4):
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values = list(dict.fromkeys(values))
    ids = spark.createDataFrame([(v - 2**64 if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, first long")
    got = {r.fp % 2**64: r.first for r in simhash.components(simhash.links_of(ids, 2, size), ids).collect()}
    group = list(range(len(values)))
    for _ in values:
        group = [min(group[j] for j, w in enumerate(values) if (v ^ w).bit_count() <= 2) for v in values]
    assert all(got.get(v, i) == group[i] for i, v in enumerate(values))


def test_near_duplicates(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == docs.count() and by[1] == by[2] == by[0] == 0 and by[6] == 5 and by[7] == 7
    assert simhash.near_duplicates(nothing).count() == 0
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} >= {0, 3, 5, 7} and simhash.keep_first(docs).columns == docs.columns


def similar_groups(texts):
    """Each text's group, by comparing all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    near = [[j for j, b in enumerate(sets) if alike(a, b)] for a in sets]
    for _ in texts:
        group = [min(group[j] for j in n) for n in near]
    return group


def test_similar_texts(spark):
    """Near copies of 50 to 300 words, chains of them, unlike texts, and texts that share one line."""
    rng, texts = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(3000)]
    line = rng.choices(vocabulary, k=12)
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randrange(50, 300)) + line * (i % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(i % 5):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choices(vocabulary, k=rng.randrange(3)) + base[at + rng.randrange(1, 4 + len(base) // 60) :]
            texts.append(" ".join(base))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = similar_groups(texts)
    assert len(set(wanted)) < len(texts) - 50
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(wanted))
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(wanted))


def test_wide_parities():
    """No more parities differ than hashes do, whatever the widths; long unlike sets differ in many."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, 2 * n, dtype=np.uint64))))
        wide = [simhash._wide(x) for x in (a, b)]
        words = min(map(len, wide)) // 8
        assert all(len(w) // 8 >= max(simhash.PARITIES, len(x) / 8) for w, x in zip(wide, (a, b)))
        folded = [np.frombuffer(simhash._folded(w, words), np.uint64) for w in wide]
        apart, differ = int(np.bitwise_count(folded[0] ^ folded[1]).sum()), len(np.setxor1d(a, b))
        assert apart <= differ and (n < 300 or apart > 0.5 * differ)
        assert simhash._folded(simhash._parities(a), 4) == simhash._parities(a, 4)


def test_stages_without_ids(spark, docs, monkeypatch):
    """Each stage against a plain version, on rows with null ids, repeated rows and one id on a good and a bad text."""
    good, bad = "The quick brown fox jumps over the lazy dog near the old river bank today.", "no no no no no no no no no no no no"
    rows = [(None, bad), (None, good), (1, good), (1, bad), (1, good), (2, bad), (2, "x"), (None, bad), (3, None), (None, "Some other words that stand alone and are rather long for a text of one line.")]
    told = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = lambda df: sorted(map(tuple, df.collect()), key=key)

    fails = {t: rules.judged(spark.createDataFrame([(0, t)], "doc_id long, text string")).first().kept is False for t in {r[1] for r in rows}}
    assert fails[bad] and not fails[good]
    assert got(corpus_pipeline.quality_rules(spark, told, "")) == sorted([r for r in rows if not fails[r[1]]], key=key)

    class Fixed:
        def score(self, owner, x, n):
            return np.bincount(owner, x[:, 0], minlength=n), np.ones(len(owner))

    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *_: Fixed())
    monkeypatch.setattr(quality, "describe", lambda texts: (np.arange(len(texts)), np.array([[float(t == good)] for t in texts])))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    assert corpus_pipeline.quality_classifier(spark, told, "").count() == 3
    assert {r[1] for r in got(corpus_pipeline.quality_classifier(spark, told, ""))} == {good}

    kept = got(corpus_pipeline.near_duplicates(spark, told, ""))
    assert kept == sorted([(1, good), (1, bad), (2, "x"), (3, None), rows[-1]], key=key)


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = bpe.encode(docs, path, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found.collect():
        assert r.ids == plain.encode_ordinary(texts[r.doc_id])
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(found, path, public_tokenizers.PATTERN).collect()} == texts
    assert bpe.round_trip(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_prefix_edits():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng, held = random.Random(1), bpe.PrefixEncoding(vocabulary, b"the lazy dog jumps " * 30)
    for _ in range(60):
        a = rng.randrange(len(held.data))
        held.replace(a, min(len(held.data), a + rng.randrange(4)), rng.choice([b"", b"x", b" the", b"ing"]))
        assert held.ids() == vocabulary.encode(held.data)
    held.append(b" and on")
    assert held.ids() == vocabulary.encode(held.data)


def test_packing(docs, nothing, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), {r.doc_id: r.text or "" for r in docs.filter("doc_id <> 5").collect()}
    for items in (3, 50_000):
        rows = packing.pack(packing.pieces(docs, path, 64), 64, items).collect()
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        ends = {(r.sequence_id, r.offset + r.length) for r in rows}
        assert all(r.offset == 0 or (r.sequence_id, r.offset) in ends for r in rows) and max(e for _, e in ends) <= 64
        for doc_id, text in texts.items():
            ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
            mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
            assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for a in range(0, len(ids), 64)]
    whole = packing.packed(docs, path, 64, with_ids=True)
    assert packing.sequences(whole).agg(F.sum(F.size("ids"))).first()[0] == whole.agg(F.sum("length")).first()[0]
    assert packing.packed(nothing, path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 8)).round(1))]
    x += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (None, [1.0] * 8), (305, x[7][1])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    m = np.zeros((306, 8))
    valid = [*range(300), 304, 305]
    for i, v in x:
        if i in valid:
            m[i, : len(v)] = np.floor(64 * np.array(v, np.float32).astype(float))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=64).orderBy("query_id", "rank").collect()
    for q in range(0, 300, 20):
        s = m @ m[q]
        want = sorted((c for c in valid if c != q), key=lambda c: (-s[c], c))[:5]
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(c, s[c]) for c in want]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_any_size(spark):
    """Components far beyond floats' whole numbers, and ids that several rows share: each row is a candidate and a query of its own."""
    rng = random.Random(6)
    for scale in (1e4, 3e7, 1e8):
        x = [(i % 50, [float(rng.randrange(-9, 10)) * scale / 64 for _ in range(6)]) for i in range(70)] + [(20, [scale / 64] * 6)] * 2
        df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
        m = [[int(np.floor(64 * c)) for c in v] for _, v in x]
        want = []
        for q, (query_id, _) in enumerate(x):
            if query_id % 20 == 0:
                found = sorted((-sum(a * b for a, b in zip(m[q], v)), i) for j, ((i, _), v) in enumerate(zip(x, m)) if j != q)[:5]
                want += [(query_id, r, i, -s) for r, (s, i) in enumerate(found, 1)]
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=16).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    two = spark.createDataFrame([(0, [3e5]), (1, [4e5])], "vec_id long, embedding array<float>")
    assert topk.top_k(two, F.col("vec_id") % 20 == 0).first().score == 491520000004096 - 4096
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()


def test_word_tokenizer_on_any_text():
    """Ids of random texts of all kinds of characters, with marks behind words, are the tokenizer's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(8)
    pool = [*map(chr, (*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x530), 0x130, 0x1E9E, 0x2000, 0x2028, 0x3000, 0x200D, 0xFB01, 0x1F600, 0xAC00, 0x1100, 0x1161, 0x4E00, 0x2167, 0x1D400, 9, 10, 11, 28, 0x85))]
    texts = ["İ,", "ß.", "é,", "<|endoftext|>.", "don't, 's,", *(" ".join("".join(rng.choices(pool, k=rng.randrange(1, 7))) + rng.choice(["", ",", ".", "'s", ".,"]) for _ in range(rng.randrange(12))) for _ in range(5000))]
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


class Unused:
    def encode(self, *args, **kwargs):
        raise AssertionError("the tokenizer was asked for a simple word")


def test_simple_words_are_merged_in_arrays():
    """Words of letters and symbols behind them have the tokenizer's ids without asking it, whatever merges in them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(9)
    letters, syllables = "abcdefghijklmnopqrstuvwxyzABCXYZÀÉÖØÞßàéöøþÿ", ["the", "ing", "er", "aa", "ll", "für", "ción", "Éa", "x"]
    stems = ["", *("".join(rng.choices(syllables if i % 2 else letters, k=rng.randrange(1, 15)))[:24] for i in range(20_000))]
    marks = ["", "", ",", ".", "'", "...", "$$$", "|", "_-_", "</", "".join(map(chr, range(33, 48)))]
    words = [word for stem in stems if (word := stem + rng.choice(marks))]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)] + [" ", "", " a.\n"]
    mine.tokenizer = Unused()
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_case_where_marks_or_added_tokens_need_it():
    """Some letters compose with a mark only if small, and added tokens are found as they are written."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["J\u030c j\u030c THE.", "T\u0323\u0308,", "<|ENDOFTEXT|> The <|endoftext|> x<|EndOfText|>y<|startoftext|>"]
    assert mine.encode(texts) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]


def test_rules(docs, nothing):
    for text in TEXTS:
        words = (text or "").encode().split()
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        got = dict(zip(rules.MEASURES, rules.measures(text)))
        assert (got["n_words"], got["n_repeat_words"]) == (len(words), len(covered))
        assert got["word_chars"] == sum(len(w.decode()) for w in words)
    kept = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert kept[0].base_failed and kept[5].base_failed and not kept[8].kept
    sums = {r.rule: r for r in rules.ablation(rules.ledger(rules.measure(docs)), "base", 1).collect()}
    assert sums["few_words"].n_failed == sum(bool(r.failed & 1) for r in rules.judged(docs).collect())
    assert rules.judged(nothing).count() == 0


def test_urls(spark):
    df = spark.createDataFrame([(1, "https://M.Example.com/en/x?y"), (2, "http://www.example.com/en/"), (3, "http://a.net/fr/1#z"), (4, "http://a.org/win-BET"), (5, "http://a.org/winbet"), (6, None), (7, "casino"), (8, "http://b.com"), (9, "http://xcasinox.org/"), (10, "http://b.net/it")], "page_id long, url string").withColumn("host", F.lit(0))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("m.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("a.net", "/fr/1", "net/fr/", "block") and got[4][3] == "block" and got[5][3] == "allow"
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "block") and got[8] == ("b.com", "", None, "allow") and got[9][3] == "allow"


@pytest.mark.parametrize("budget,history", [(1024, 256), (20, 8), (3, 1)])
def test_chat(spark, budget, history):
    said = ["</s>[INST] ok [/INST]", None, "<\\|im_end|>\n[\\\\INST]", "plain words " * 6, "<|im_start|>user\nhi<|im_end|>\n"]
    turns = [(c, t, r, said[(c + t) % 5]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "us\ner%", "assistant", None][: c + 1])]
    turns += [(None, 0, "user", "x"), (9, None, "assistant", "y"), (9, None, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(0))
    windows = chat.windows(df, budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for text in said:
        assert chat.unescape(chat.escape(text or "")) == (text or "") and not any(c in chat.escape(text or "") for c in chat.CONTROL)
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_chat_keeps_to_the_budget(spark):
    """No window exceeds the budget but one of a single turn; the system turn stands in every window where it fits."""
    words = lambda n: " ".join(["word"] * n)
    turns = [(1, 0, "system", words(596)), (1, 1, "user", words(596)), (1, 2, "assistant", words(300)), (1, 3, "user", words(1500)), (1, 4, "assistant", words(10))]
    turns += [(2, 0, "system", words(20)), *((2, t, "user" if t % 2 else "assistant", words(90)) for t in range(1, 40))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, 1024, 256).orderBy("conv_id", "window").collect()
    for r in made:
        told = chat.parse(r.text)
        assert r.n_tokens <= 1024 or len(told) == 1
        if r.conv_id == 2:
            assert told[0] == ("system", words(20)) and len(told) > r.n_context
    assert [[role for role, _ in chat.parse(r.text)] for r in made if r.conv_id == 1] == [["system"], ["user", "assistant"], ["user"], ["system", "assistant"]]
    assert max(r.n_context for r in made if r.conv_id == 2) == 3


def test_letters_and_offsets(spark):
    """Only letters count as such, and spans are places in the text as it is."""
    df = spark.createDataFrame([(i, ("the cat and the dog sat there " if i % 2 else "der hund und die katze sitzen dort ") * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") >= 0)
    mixed = "İİİ the cat and the dog sat there " * 3 + "ıİ der hund und die katze sitzen dort " * 3
    told = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ ① 12 _ 𝟙 ¾"), (3, mixed), (4, "x² y")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(told, model).collect()}
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (1, 2)] == [("und", 0.0, [])] * 2 and got[4].lang_pred != "und"
    spans = got[3].spans
    assert spans[0].start == 0 and spans[-1].end == len(mixed) and all(a.end == b.start for a, b in zip(spans, spans[1:]))
    first = next(s for s in spans if s.lang == "de" and "hund" in mixed[s.start : s.end])
    assert mixed[first.start : first.end].lstrip().startswith(("der", "ıİ", "hund"))


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from orrery.llm import common

    none = SimpleNamespace(get=lambda *_: None)
    held = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: none, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=none, sparkContext=context))


def test_viterbi():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32))
    labeller = langid.Labeller(model, 1.5)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    scores = rng.normal(0, 1, (20, 3)).astype(np.float32)
    labeller.known, labeller.scores = {w: i for i, w in enumerate(vocabulary)}, scores
    texts = [[vocabulary[i] for i in rng.integers(0, 20, n)] for n in (0, 1, 7, 6, 5)]
    for words, labels in zip(texts, labeller.label(texts)):
        s = [scores[vocabulary.index(w)] for w in words]
        value = lambda path: sum(x[p] for x, p in zip(s, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((value(p) for p in np.ndindex(*[3] * len(words))), default=0)
        assert value(labels.tolist()) == pytest.approx(best, abs=1e-4)


def test_languages(spark, nothing):
    rows = [(i, ("the cat and the dog sat there " if i % 2 else "der hund und die katze sitzen dort ") * 5, "en" if i % 2 else "de") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 0)
    df = spark.createDataFrame([(1, "the dog and the cat"), (2, None), (3, "12 ..."), (4, "the cat and the dog sat there " * 3 + "der hund und die katze " * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0
    assert [s.lang for s in got[4].spans] == ["en", "de"]
    none = langid.train(nothing.withColumn("lang", F.lit(None).cast("string")), F.col("doc_id") >= 0)
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def plain_maxent(docs, learns, spark):
    """Scores token by token: counts in dictionaries, softmaxes over all classes and buckets, pair weights unit by unit."""
    rows = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    read = maxent.read_chunks(rows, 3)
    texts = [(r.doc_id, maxent.words_of(r.text), r.learns) for r in rows.collect()]
    counts, pairs, after = Counter(), Counter(), Counter()
    for _, words, learned in texts:
        if learned:
            counts.update(words)
            pairs.update(zip(words, words[1:]))
            after.update((a, maxent.bucket_of(b)) for a, b in zip(words, words[1:]))
    n, buckets = sum(counts.values()), range(maxent.BUCKETS)
    total = np.array([sum(c for w, c in counts.items() if maxent.bucket_of(w) == b) for b in buckets], float)
    members = np.array([sum(maxent.bucket_of(w) == b for w in counts) for b in buckets], float)
    model = maxent.train(maxent.history_counts(read), n, len(counts), total, members, 3)
    share = lambda w: (counts[w] + 0.1) / (total[maxent.bucket_of(w)] + 0.1 * (members[maxent.bucket_of(w)] + 1))
    featured = {p: c for p, c in pairs.items() if c >= 2 and counts[p[1]] >= 2}
    weights = dict.fromkeys(featured, 0.0)

    def whole(a, bucket):
        return 1 + sum(share(b) * (np.exp(weights[a, b]) - 1) for x, b in featured if x == a and maxent.bucket_of(b) == bucket)

    for _ in range(maxent.PAIR_ROUNDS):
        steps = {}
        for (a, b), c in featured.items():
            bucket = maxent.bucket_of(b)
            q = share(b) * np.exp(weights[a, b]) / whole(a, bucket)
            m = after[a, bucket]
            steps[a, b] = np.clip((c - m * q - weights[a, b] / maxent.VARIANCE) / (m * q * (1 - q) + 1 / maxent.VARIANCE), -2, 2)
        weights = {p: w + steps[p] for p, w in weights.items()}
    w = model.weights

    def log_p(before, skip, token):
        feature = before if before is not None else maxent.BUCKETS
        group = skip // maxent.WIDTH if skip is not None else maxent.CLASSES
        hashed = (feature * 40_503 + group * 9_176_867) % 1_000_003 % maxent.PAIRS
        k, place = divmod(token, maxent.WIDTH)
        of_class = w["class_ngram"][feature] + w["class_skip"][group] + w["class_pair"][hashed]
        of_bucket = (w["bucket_ngram"][feature] + w["bucket_skip"][group])[k * maxent.WIDTH : (k + 1) * maxent.WIDTH]
        return sum(v[i] - np.log(np.exp(v).sum()) for v, i in ((of_class, k), (of_bucket, place)))

    found = []
    for doc_id, words, _ in texts:
        score, of = 0.0, [maxent.bucket_of(x) for x in words]
        for i, word in enumerate(words):
            score += log_p(of[i - 1] if i else None, of[i - 2] if i > 1 else None, of[i]) + np.log(share(word))
            if i and counts[words[i - 1]] >= 2:
                score += weights.get((words[i - 1], word), 0.0) - np.log(whole(words[i - 1], of[i]))
        found.append((doc_id, score / np.log(10)))
    return found, counts, model, weights, share, whole


@pytest.mark.parametrize("chunk", [60, 8_000_000])
def test_maxent(spark, docs, nothing, monkeypatch, chunk):
    """Counts, base and score of every text against the plain version; chunks of a text or two, or one for all."""
    monkeypatch.setattr(maxent, "CHUNK", chunk)
    monkeypatch.setattr(maxent, "FREQUENT", 10)
    monkeypatch.setattr(maxent, "PAIRS_OF", 500)
    learns = F.col("doc_id") % 3 != 0
    plain, counts, *_ = plain_maxent(docs, learns, spark)
    got = maxent.scored(docs, learns, rounds=3).collect()
    n, v = sum(counts.values()), len(counts)
    key = lambda pair: (pair[0] is None, pair[0], pair[1])
    for (a, x), (b, y) in zip(sorted(plain, key=key), sorted(((r.doc_id, r.score) for r in got), key=key)):
        assert a == b and x == pytest.approx(y, abs=0.02)
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            words = maxent.words_of(TEXTS[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    assert maxent.scored(nothing, learns).count() == 0
    assert {r.n_known for r in maxent.scored(docs, F.lit(False)).collect()} == {0}


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_numbered_tokens(kind):
    """Tokens of parts of arrays, in several chunks, are those of each text."""
    texts = [None, "", " A\n\nb\x0bc\x0cd\r\n", "x\x1cy \x85z", "Ünï ÜNÏ", *TEXTS] * 50
    whole = pa.array(texts, kind)
    for parts in ([whole], [whole.slice(37, 400)], [whole.slice(100, 3), whole.slice(600), whole.slice(0, 9)]):
        column = pa.chunked_array(parts)
        code, sizes, tokens = maxent.numbered(column)
        want = [maxent.words_of(t) for t in column.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want]
        known = tokens.to_pylist()
        assert len(set(known)) == len(known) and [known[c] for c in code] == [w for some in want for w in some]


def test_maxent_normalises(spark, docs):
    """What follows a token adds up to 1 over all tokens known and one unknown of each bucket."""
    _, counts, model, weights, share, whole = plain_maxent(docs, F.col("doc_id") >= 0, spark)
    assert np.allclose((10.0 ** model.table()).sum(axis=1), 1, atol=1e-4)
    assert weights and max(weights.values()) > 1
    for a, b in list(weights)[:20]:
        bucket = maxent.bucket_of(b)
        unknown = 0.1 / (model.bucket_total[bucket] + 0.1 * (model.bucket_distinct[bucket] + 1))
        every = unknown + sum(share(w) * np.exp(weights.get((a, w), 0.0)) for w in counts if maxent.bucket_of(w) == bucket)
        assert every / whole(a, bucket) == pytest.approx(1)


def test_maxent_gradients():
    """Seen less expected is the slope of the likelihood; pair weights end where theirs, less the prior's, is zero."""
    rng = np.random.default_rng(0)
    before = np.array([0, 3, maxent.BUCKETS])
    counts = rng.poisson(0.02, (3, maxent.GROUPS, maxent.BUCKETS)).astype(float)
    w = {k: rng.normal(0, 0.5, s) for k, s in (("class_ngram", (maxent.BEFORE, maxent.CLASSES)), ("class_skip", (maxent.GROUPS, maxent.CLASSES)), ("class_pair", (maxent.PAIRS, maxent.CLASSES)), ("bucket_ngram", (maxent.BEFORE, maxent.BUCKETS)), ("bucket_skip", (maxent.GROUPS, maxent.BUCKETS)))}

    def likelihood():
        c, b = maxent.log_softmaxes(w, before)
        return (counts * (c[..., None] + b).reshape(counts.shape)).sum()

    found = maxent.shard_gradient(w, before, counts)
    for kind, row, column in (("class_ngram", 3, 2), ("class_skip", 5, 1), ("class_pair", maxent.pair_features(before)[1, 4], 7), ("bucket_ngram", 0, 40), ("bucket_skip", 16, 300)):
        up = []
        for step in (1e-4, -1e-4):
            w[kind][row, column] += step
            up.append(likelihood())
            w[kind][row, column] -= step
        assert found[kind][0][row, column] - found[kind][1][row, column] == pytest.approx((up[0] - up[1]) / 2e-4, abs=1e-3)
    unit, token = np.array([0, 0, 0, 1, 1, 0]), np.array([5, 6, 7, 5, 8, 5])
    share, n = np.array([0.2, 0.1, 0.3, 0.2, 0.0, 0.2]), np.array([4, 30, 1, 3, 9, 5])
    added = maxent.fit_pairs(unit, token, share, n, 60)
    assert added[0] == added[5]
    whole = {u: -a for u, a in ((0, added[2]), (1, added[4]))}
    for i, seen, every in ((0, 9, 40), (1, 30, 40), (3, 3, 12)):
        weight = added[i] + whole[unit[i]]
        assert seen - every * share[i] * np.exp(added[i]) == pytest.approx(weight / maxent.VARIANCE, abs=1e-2)


def test_maxent_learns(spark):
    """Rounds lower the loss of held-out texts clearly: two languages whose words follow each other in a fixed order."""
    rng, words = random.Random(2), [[f"{c}{i}{c}x" for i in range(40)] for c in "pq"]
    rows = []
    for i in range(400):
        own, at = words[i % 2], rng.randrange(40)
        text = []
        for _ in range(50):
            at = (at + 1) % 40 if rng.random() < 0.8 else rng.randrange(40)
            text.append(own[at])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    loss = []
    for rounds, pair_rounds in ((0, 0), (maxent.ROUNDS, 0), (maxent.ROUNDS, maxent.PAIR_ROUNDS)):
        found = maxent.scored(df, F.col("doc_id") % 5 != 0, rounds=rounds, pair_rounds=pair_rounds).filter("doc_id % 5 = 0")
        loss.append(found.agg(-F.sum("score") / F.sum("n_tokens")).first()[0])
    assert loss[1] < loss[0] - 0.2 and loss[2] < loss[1] - 0.2


def test_quality(spark, nothing):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word() + ("" if i % 3 else "###") for _ in range(rng.randrange(5, 300)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(0, 1), (None, 1), (1, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(df, labels, F.col("doc_id") % 5 != 0)
    got = quality.score(df, model).withColumn("p", quality.predicted()).collect()
    assert sum(r.p == (r.doc_id % 3 > 0) for r in got if r.doc_id % 5 == 0) >= 28
    blank = quality.score(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), model).collect()
    assert len(blank) == 2 and all(0 <= r.score <= 1 for r in blank)
    assert quality.score(nothing, quality.train(df, labels.limit(0), F.lit(True))).count() == 0
    assert quality.score(df, quality.train(df, labels.filter("quality = 1"), F.lit(True))).first().score == 1


def plain_attention(w, passages):
    """The score of one document, passage by passage."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    codes = [np.tanh(w["encode"].T @ x + w["encode_0"]) for x in passages]
    logits = [w["attend"] @ (np.tanh(w["value"].T @ c) * sigmoid(w["gate"].T @ c)) for c in codes]
    weights = np.exp(logits) / np.exp(logits).sum()
    return sigmoid(w["out"] @ sum(a * c for a, c in zip(weights, codes)) + w["out_0"]), weights


def test_attention():
    """Scores and weights against the plain version, the step of training against numeric slopes, and the learned loss."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 6, 40)
    owner = np.repeat(np.arange(40), sizes)
    x = rng.normal(0, 1, (len(owner), quality.FEATURES))
    y = np.array([(x[owner == d, 0].max() > 0.5) for d in range(40)], float)
    importance = rng.uniform(0.5, 2, 40)
    model = quality.fit(owner, x, y, importance)
    scores, attention = model.score(owner, x, 40)
    for d in range(40):
        score, weights = plain_attention(model.weights, model.scaled(x)[owner == d])
        assert scores[d] == pytest.approx(score, abs=1e-9) and np.allclose(attention[owner == d], weights)
    assert ((scores > 0.5) == (y == 1)).mean() > 0.9 and np.allclose(np.bincount(owner, attention), 1)

    def loss(w):
        p = quality._forward(w, owner, model.scaled(x), 40)["score"]
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / importance.sum() + quality.DECAY / 2 * sum((v**2).sum() for v in w.values())

    # At the end of training the slope is next to nothing in every weight, by differences of the loss.
    start = {k: v * 0.5 for k, v in model.weights.items()}
    slopes = lambda w: [(loss({**w, k: w[k] + e}) - loss({**w, k: w[k] - e})) / 2e-5 for k in w for e in (np.where(np.arange(w[k].size) == w[k].size // 2, 1e-5, 0).reshape(w[k].shape),)]
    assert loss(model.weights) < loss(start) and np.abs(slopes(model.weights)).max() < 0.02 < np.abs(slopes(start)).max()


def test_repeated_documents_teach_once(spark):
    texts = [(i, "fine words here and there " * 9 if i % 2 else "### !!! $$$ " * 9) for i in range(20)]
    df = spark.createDataFrame(texts + [texts[3]] * 50 + [(3, "###")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda owner, x, y, importance: seen.append(len(y)) or real(owner, x, y, importance)
    try:
        quality.train(df, labels, F.lit(True))
    finally:
        quality.fit = real
    assert seen == [20]
