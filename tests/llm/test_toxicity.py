"""Toxicity: features of single texts, held-out accuracy, and awkward rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from somatica.llm import toxicity

from . import plain

ABUSE, SPOKEN = toxicity._vocabulary(toxicity.ABUSE), toxicity._vocabulary(toxicity.SECOND_PERSON)


def value(name, text, learned=()):
    return toxicity.features(text, ABUSE, {w.encode(): 2.0 for w in learned}, SPOKEN)[toxicity.FEATURES.index(name)]


def test_features():
    assert toxicity.features(None, ABUSE, {}, SPOKEN) == toxicity.features("", ABUSE, {}, SPOKEN) == [0.0] * len(toxicity.FEATURES)
    assert value("abuse_per_100", "What an idiot, an IDIOT!") == 40.0 and value("abuse_kinds", "idiot idiot moron") == 2.0
    assert value("learned_most", "a réêou b", ["réêou"]) == 2.0 and value("learned_sum", "x y z", ["x", "y"]) == 4.0
    assert value("near_second_person", "you are such an idiot") == 20.0 and value("near_second_person", "idiot " + "word " * 9 + "you") == 0.0
    assert value("disguised_abuse", "an 1d10t and a st.u.pid m0r0n") == 3.0 and value("disguised_abuse", "version 1.2.3 of a1b") == 0.0
    assert value("disguised_abuse", "i d i o t") == 1.0
    assert value("capital_share", "ABcd") == 0.5 and value("shouted_words", "LOUD WORDS here") == pytest.approx(2 / 3)
    assert value("exclamations", "a! b! c d") == 50.0 and value("stretched_words", "nooooo way") > 0
    assert value("repetition", "a a a a") == 0.75


def corpus(spark, n=1500):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(900)]
    own = ["zarquon", "blivet", "frobnitz"]
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(vocabulary, k=rng.randint(20, 120))
        bad = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice([*own, "idiot", "worthless"]))
        docs.append((k, " ".join(w), "en", f"s{k % 3}", 1))
        labels.append((k, int(bad)))
    return spark.createDataFrame(docs, plain.SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out(spark):
    docs, labels, want = corpus(spark)
    got = {r.doc_id: r for r in toxicity.held_out_toxicity(docs, labels, rounds=5).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    held = [(r.predicted, want[k]) for k, r in got.items() if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    # labels of held-out documents change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.held_out_toxicity(docs, other, rounds=5).collect()} == {k: r.score for k, r in got.items()}


def test_learned_words(spark):
    docs, labels, _ = corpus(spark)
    sample = docs.join(labels, "doc_id").select("text", "toxic")
    found = toxicity.learned_words(sample)
    assert {"zarquon", "blivet", "frobnitz", "idiot", "worthless"} <= set(found) and all(v > 0 for v in found.values()) and len(found) < 30


def test_sample(spark):
    docs = spark.createDataFrame([(k, f"text {k % 400}") for k in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(800)] + [(3, 0, None), (5, None, None), (None, 1, None)], "doc_id long, toxic int, quality int")
    assert toxicity.labelled_sample(docs, labels, 10_000).count() == 400
    assert 60 < toxicity.labelled_sample(docs, labels, 100).count() < 140


def test_awkward(spark):
    docs = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA).withColumns({c: F.lit(7) for c in [*plain.CLASHES, "features", "prediction", "margin", "held_out", "toxic"]})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.held_out_toxicity(docs, labels).collect()
    assert len(got) == len(plain.AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.held_out_toxicity(docs.where("false"), labels.where("false")).collect() == []
    more, marks, _ = corpus(spark, 600)
    both = docs.select("doc_id", "text").unionByName(more.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    marks = marks.select((F.col("doc_id") + 100).alias("doc_id"), "toxic")
    scores = {}
    for r in toxicity.scored(both, toxicity.fit(both, marks, rounds=3)).where("doc_id is null or doc_id < 100").collect():
        scores.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[2, None] == scores[3, ""]
