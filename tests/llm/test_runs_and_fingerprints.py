"""Periodic runs and order MinHash against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from orrery.llm import orderhash, periodic
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the cat sat on a mat and then it went home again " * 40


def plain_runs(w):
    """Runs by trying every period and every start."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(seed, n):
    rng = np.random.default_rng(seed)
    found = [None, "", "   ", "one", " \t x\x0by\x0c ", "a\x1cb\x85c d", LONG, "é " * 30, "ab " * 5, "a b " * 6]
    while len(found) < n:
        words = rng.integers(0, rng.choice([1, 2, 4, 40]), rng.integers(0, 150))
        found.append(" ".join(f"w{x}" for x in words))
    return found


def test_runs(spark):
    rows = list(enumerate(texts(1, 120)))
    df = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").withColumn("DOC", F.lit(1)).withColumn("h", F.lit("x"))
    got = periodic.collapsed(df, F.crc32(F.col("doc_id").cast("string").cast("binary"))).collect()
    want = [plain_row(*r) for r in rows + rows[:7]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_runs_in_parts(monkeypatch):
    """Texts share batches or don't, places are settled early or late: the same runs."""
    rng = np.random.default_rng(5)
    for places in (3, 60, 500_000):
        monkeypatch.setattr(periodic, "PLACES", places)
        for _ in range(40):
            some = [rng.integers(0, rng.choice([1, 2, 3, 9]), rng.integers(0, 120)) for _ in range(rng.integers(1, 6))]
            owner, *rest = (x.tolist() for x in periodic.runs_of(some))
            got = [[r for o, *r in zip(owner, *rest) if o == i] for i in range(len(some))]
            assert got == [[list(r) for r in plain_runs(t.tolist())] for t in some]


def test_agreement():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 300))
        inner = rng.integers(0, rng.choice([1, 2, 5]), n)
        letters = np.concatenate(([100], inner, [101]))
        grammar = periodic.Grammar(letters, int(rng.choice([2, 8, 64])))
        i, j = rng.integers(1, n + 1, 50), rng.integers(1, n + 1, 50)
        i, j = i[i != j], j[i != j]
        for forward in (True, False):
            step = 1 if forward else -1
            for x, y, got in zip(i, j, grammar.agreement(i, j, forward)):
                k = 0
                while 0 <= min(x, y) + step * k and max(x, y) + step * k < n + 2 and letters[x + step * k] == letters[y + step * k]:
                    k += 1
                assert k == got


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.collapsed(empty).count() == 0
    assert orderhash.edited_fingerprints(empty).count() == 0


def plain_fingerprint(text):
    """The same hash values, everything else one run at a time."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return [0] * orderhash.SKETCHES
    k = min(orderhash.K, len(points))
    runs = [text[i : i + k] for i in range(len(points) - k + 1)]
    value = {r: orderhash.run_hashes(np.frombuffer(r.encode("utf-32-le"), "<u4"))[:1] for r in set(runs)}
    assert len({int(v[0]) for v in value.values()}) == len(value)
    seen, numbered = {}, []
    for r in runs:
        numbered.append(int(orderhash._mixed(value[r] + np.array([seen.get(r, 0)], np.uint64) * orderhash._ODD[4])[0]) >> 32)
        seen[r] = seen.get(r, 0) + 1
    found = []
    for factor in orderhash._FACTORS[:, 0].tolist():
        smallest = sorted(range(len(runs)), key=lambda i: (numbered[i] * factor % 2**32, i))[: orderhash.PICKED]
        joined = np.array([len(smallest)], np.uint64)
        for i in sorted(smallest):
            joined = orderhash._mixed(joined * orderhash._ODD[3] + value[runs[i]])
        found.append(int(joined[0]) >> 48)
    return found


@pytest.mark.parametrize("text", ["", "a", "abc", "abcdefgh", "abcdefghi", "\U0001f600 x " * 20, LONG, "a" * 2000, "".join(chr(97 + i * i % 23) for i in range(3000))])
def test_fingerprint(text):
    assert orderhash.fingerprint(text).tolist() == plain_fingerprint(text)


def test_order_counts():
    """The same parts in another order are less alike than after a small change."""
    rng = np.random.default_rng(3)
    parts = ["".join(map(chr, rng.integers(97, 123, 60))) for _ in range(40)]
    text, moved = "".join(parts), "".join(reversed(parts))
    changed = text.replace(parts[7], "".join(map(chr, rng.integers(97, 123, 60))))
    like = lambda a, b: orderhash.likeness(orderhash.fingerprint(a), orderhash.fingerprint(b))
    assert like(text, text) == 1 and like(text, changed) > 0.8 > 0.7 > like(text, moved) and like(text, "".join(map(chr, rng.integers(97, 123, 2400)))) < 0.1


@pytest.mark.parametrize("rows_each", [2, 20_000])
def test_edited(spark, rows_each):
    rows = list(zip(range(0, 400, 3), texts(2, 130)))
    rows += [(None, "no id"), (9, "second nine"), (9, "a third one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("k", F.lit(1)).withColumn("ahead", F.lit(2))
    got = sorted(map(tuple, orderhash.edited_fingerprints(df, rows_each=rows_each).collect()), key=str)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(text)
        new = text[: n - n // 2] + following[: n // 2]
        a, b, c = (orderhash.fingerprint(t) for t in (text, new, following))
        want.append((doc_id, n, hashlib.sha256(new.encode()).hexdigest(), orderhash.as_text(a), orderhash.as_text(b), (a == b).mean(), (a == c).mean()))
    assert got == sorted(want, key=str)


def test_one_row(spark):
    got = orderhash.edited_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert (got.n_chars, got.edited_sha256, got.near_next) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)
