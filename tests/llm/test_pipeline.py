"""The pipeline's stages against plain versions of them."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from somatica.llm import packing

from . import plain
from .test_neardup import jaccard


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "und", "ein", "ä"]}
    word = lambda g: "".join(rng.choices(parts[g], k=rng.randint(2, 5)))
    texts = [(" ".join(word(g) for _ in range(rng.randint(20, 90))), g) for g in rng.choices(["en", "de"], k=160)]
    for k in range(40):
        w = texts[k][0].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append((" ".join(w), texts[k][1]))
    texts += texts[:20] + [("12 34 !!", "en"), (None, "en"), ("", "de")]
    texts += [(f"{' '.join(word('en') for _ in range(40))} mail user{k}@host.example or call +49 30 12345{k:02d} now {word('en')}", "en") for k in range(12)]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, g, f"s{i % 3}", len(t or "")) for i, (t, g) in enumerate(texts)]
    spark.createDataFrame(rows, plain.SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path), {i: t for i, t, *_ in rows}


def test_stages(spark, folder):
    path, text = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["language", "near duplicates", "personal data", "mixing", "packing"]

    kept = by_name["language"](spark, docs, path)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {i for i, t in text.items() if t and any(c.isalpha() for c in t)}

    alone = by_name["near duplicates"](spark, kept, path)
    order = sorted(ids)
    links = [(a, b) for a in range(len(order)) for b in range(a) if jaccard(text[order[a]], text[order[b]]) >= 0.8]
    want = {order[c] for c in plain.components(len(order), links)}
    assert alone.columns == docs.columns and {r.doc_id for r in alone.collect()} == want and len(want) < len(order) - 20

    clean = by_name["personal data"](spark, alone, path)
    got = {r.doc_id: r for r in clean.collect()}
    assert set(got) == want and clean.columns == docs.columns
    for i, r in got.items():
        out, at = "", 0
        for span in filter(None, plain.base_spans(text[i]).split(",")):
            kind, a, b = span.split(":")
            out, at = out + text[i][at : int(a)] + f"<{kind.upper()}>", int(b)
        assert r.text == out + text[i][at:] and r.n_chars == len(r.text)
    assert sum("<EMAIL>" in r.text and "<PHONE>" in r.text for r in got.values()) >= 6

    mixed = by_name["mixing"](spark, clean, path)
    sizes, taken = Counter(), Counter()
    for r in got.values():
        sizes[r.source] += len(plain.words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(plain.words(r.text))
    aims = plain.targets(dict(sizes))
    assert mixed.columns == docs.columns and all(abs(taken[s] - aims[s]) <= 100 for s in aims) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    pieces = by_name["packing"](spark, mixed, path).collect()
    own = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter(np.array([*own.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes() for r in mixed.collect())
    parts = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        parts.setdefault((r.doc_id, r.sequence_id * 1024 + r.offset - r.start), []).append(r.ids)
    assert Counter(b"".join(p) for p in parts.values()) == want


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 100 and out.agg({"length": "max"}).first()[0] <= 1024


def test_empty_and_awkward(spark, tmp_path):
    d = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA)
    for name, rows in (("empty", d.where("false")), ("awkward", d)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.where("length > 1024").count() == 0 and (out.count() > 0) == (name == "awkward")
