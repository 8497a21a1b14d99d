"""The pipeline's near-duplicate stage on planted pairs."""

import itertools
import random

import pytest

import corpus_pipeline
from somatica.llm import neardup, simhash

from . import plain


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("chunk", [256, 16])
def test_planted_pairs(spark, chunk):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, planted = [], 0
    for k in range(60):
        w = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        n = len(w) - 4
        other = w[:]
        tail = round(n * rng.uniform(0.02, 0.17))  # changed words at the end: as many shingles differ, and no more
        other[len(w) - tail :] = [word() for _ in range(tail)]
        texts.append(" ".join(other))
        planted += 0.8 <= jaccard(texts[-2], texts[-1]) < 0.96
    middle = [word() for _ in range(100)]
    for k in range(40):  # a large group of near copies
        m = middle[:]
        m[k] = word()
        texts.append(" ".join(m))
    texts += ["", "one two", "One  two", "one two three"]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], plain.SCHEMA).repartition(4)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    want = set(plain.components(len(texts), links))
    assert planted > 30 and len(want) < len(texts) - planted
    got = neardup.near_duplicates(d, chunk=chunk) if chunk != 256 else dict(corpus_pipeline.STAGES)["near duplicates"](spark, d, "")
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_awkward(spark):
    d = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA)
    kept = neardup.near_duplicates(d).collect()
    assert len({r.text or "" for r in kept}) == len(kept) and neardup.near_duplicates(d.where("false")).count() == 0


def test_simhash_links(spark):
    """Texts that fingerprints link stay one class, though their sets of shingles are not alike."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    body = " ".join(["spam"] * 400)
    texts = [f"{body} {' '.join(word() for _ in range(12))}" for _ in range(6)] + [" ".join(word() for _ in range(60)) for _ in range(20)]
    prints = [simhash.fingerprint_bytes(t.encode(), 5) for t in texts]
    pairs = list(itertools.combinations(range(len(texts)), 2))
    links = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert len(links) == 15 and all(jaccard(texts[i], texts[j]) < 0.5 for i, j in links)
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], plain.SCHEMA).repartition(3)
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, d, "")
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(6, 26)]
