"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from somatica.llm import periodic

from . import plain


def runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, found):
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9), st.integers(2, 8)), max_size=3))
def test_all_runs(words, planted):
    for at, p, times in planted:
        for i in range(at + p, min(len(words), at + p * times)):
            words[i] = words[i - p]
    found = periodic.find_runs(np.array(words, np.int64))
    assert found == runs(words)
    assert periodic.kept_words(len(words), found).tolist() == [k for k in range(len(words)) if not any(s + p <= k < s + n for s, n, p in found)]


@pytest.mark.parametrize("words", [[1] * 50_000, [k % 7 for k in range(50_000)], [k % 900 for k in range(50_000)], [k % 2 for k in range(9)] * 1000])
def test_long_texts(words):
    found = periodic.find_runs(np.array(words, np.int64))
    assert found[0][0] == 0 and sum(n for _, n, _ in found) >= len(words)


def test_z_function():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [0] * min(len(s), 1) + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic.z_function(s) == want


def test_words_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "é", "\x0bd\x1ce\x85"], k=500)).encode()
    whole = periodic.Interner().ids(text).tolist()
    monkeypatch.setattr(periodic, "_PIECE", 7)
    assert periodic.Interner().ids(text).tolist() == whole


def planted(doc_id, text):
    w = plain.words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def report(doc_id, text):
    w = planted(doc_id, text)
    found = runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *first, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(w, found)))


def test_report(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(200):
        w = rng.choices("the of a cat dog house Tree über \U0001f600 x y".split(" "), k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(80), rng.randint(1, 6)
            for i in range(at + p, min(len(w), at + p * rng.randint(3, 8))):
                w[i] = w[i - p]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in periodic.run_digests(docs).collect())
    assert got == [report(k, t) for k, t in enumerate(texts)]
    assert sum(r[1] for r in got) > 50 and sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(200)) > 5


def test_awkward(spark):
    docs = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA)
    short = docs.where("coalesce(length(text), 0) < 1000").withColumns({c: F.lit(7) for c in [*plain.CLASHES, "start", "length", "period", "runs", "collapsed"]})
    got = sorted((tuple(r) for r in periodic.run_digests(short).collect()), key=repr)
    assert got == sorted((report(r[0], r[1]) for r in plain.AWKWARD if len(r[1] or "") < 1000), key=repr)
    long = periodic.drop_periodic(docs.where("doc_id = 5")).first()
    assert [tuple(r) for r in long.runs] == [(0, 20_000, 5)] and long.collapsed == "lorem ipsum dolor sit amet"
    assert periodic.run_digests(docs.where("false")).collect() == []
