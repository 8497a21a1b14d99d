"""The ten operators against plain versions, on ordinary and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatica.llm import common, embed_dedup, langid, license_scan, media, mixing, packing, pii, simhash, substring, urlfilter

from . import plain


@pytest.fixture(scope="module")
def awkward(spark):
    d = spark.createDataFrame(plain.AWKWARD, plain.SCHEMA)
    return d.withColumns({c: F.lit(7) for c in plain.CLASHES})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(5, 16))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(rng.randint(1, 25))) for _ in range(150)]
    for k in range(60):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:30]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, plain.SCHEMA).repartition(5)


def rows(df):
    return df.collect()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 501 + k) for k in range(200)]
    want = plain.components(800, links)
    got = {r.node: r.label for r in rows(common.connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {n: want[n] for n in got} and set(got) >= {a for a, b in links if a != b}
    assert rows(common.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_prefix_sums(spark):
    d = spark.createDataFrame([(k, i, i % 7) for k in ("x", None) for i in range(0, 100, 3)], "k string, i long, v long")
    got = {(r.k, r.i): r.s for r in rows(common.prefix_sums(d, ["k"], "i", "v", "s", 8))}
    assert got == {(k, i): sum(j % 7 for j in range(0, i, 3)) for k, i in got} and len(got) == 68


def test_simhash(prose):
    got = rows(simhash.simhash_components(prose))
    text = {r.doc_id: r.text for r in rows(prose)}
    prints = {i: plain.fingerprint(t) for i, t in text.items()}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in got) and len(got) == len(text)
    links = [(i, j) for i, j in itertools.combinations(sorted(text), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(plain.components(len(text), links)))
    kept = rows(simhash.simhash_dedup(prose))
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got}) and all(r.text == text[r.doc_id] for r in kept)


def test_simhash_hot_bucket(spark):
    rng = random.Random(4)
    middle = rng.getrandbits(63)
    points = {middle}
    while len(points) < 700:
        points.add(middle ^ sum(1 << b for b in rng.sample(range(12), rng.randint(1, 6))))
    points |= {rng.getrandbits(63) for _ in range(300)}
    points = sorted(points)
    links = [(i, j) for i, j in itertools.combinations(range(len(points)), 2) if (points[i] ^ points[j]).bit_count() <= 4]
    found = rows(simhash.near_pairs(spark.createDataFrame([(p,) for p in points], "f long"), 4, chunk=64))
    at = {p: i for i, p in enumerate(points)}
    assert all((r.a ^ r.b).bit_count() <= 4 for r in found) and len(found) < len(links) / 4
    assert plain.components(len(points), [(at[r.a], at[r.b]) for r in found]) == plain.components(len(points), links)


@pytest.mark.parametrize("blocks", [6, 7, 8, 10])
def test_block_masks(blocks):
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(64, blocks, 4)]
    rng = random.Random(blocks)
    for _ in range(500):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & m == 0 for m in masks)


def test_simhash_awkward(awkward, empty):
    got = rows(simhash.simhash_components(awkward))
    assert len(got) == len(plain.AWKWARD)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    cat = f"{plain.fingerprint(plain.AWKWARD[0][1]):016x}"
    assert [r.component_id for r in got if r.fingerprint == cat] == [1, 1, 1]
    kept = simhash.simhash_dedup(awkward)
    assert kept.columns == awkward.columns and len({(r.doc_id, r.text) for r in rows(kept)}) == kept.count() == len({(r.fingerprint) for r in got})
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    vectors = [c + rng.normal(size=32) * s for c in centres for s in rng.uniform(0.05, 0.5, 20)] + list(rng.normal(size=(150, 32)))
    vectors += vectors[:25] + [vectors[0]] * 40
    vectors = np.array(vectors, np.float32)
    labels = [i % 2 if i < 240 else 0 for i in range(len(vectors))]
    d = spark.createDataFrame([(i, v.tolist(), lab, 1) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int, n int")
    near = plain.cosine_links(vectors, labels)
    for chunk in (1024, 16):
        got = sorted(rows(embed_dedup.embedding_components(d, chunk=chunk)), key=lambda r: r.vec_id)
        links = np.array([r.n_links for r in got])
        assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    exact = plain.components(len(vectors), list(zip(*np.nonzero(near), strict=True)))
    assert np.mean([r.component_id == exact[r.vec_id] for r in got]) > 0.98


def test_embedding_tables():
    assert embed_dedup.tables_for(64, 1, 1, 0.93, 0.99) >= 1
    x = np.random.default_rng(1).normal(size=(50, 64))
    h = embed_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embed_dedup.hadamard(h), x)


def test_embedding_awkward(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "n", "sound", "code")})
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows(embed_dedup.embedding_components(d)))
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == Counter([*alone, (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)])
    assert embed_dedup.embedding_components(d.where("false")).count() == 0


def test_language(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and", "er", "sh"], "de": ["sch", "ung", "und", "ein", "\u00e4", "\u00fc"], "fr": ["eau", "oi", "ment", "les", "\u00e9", "\u00e8"]}
    word = lambda p: "".join(rng.choices(p, k=rng.randint(1, 3)))
    data = [(i, " ".join(word(parts[g]) for _ in range(rng.randint(4, 60))), g) for i, g in enumerate(rng.choices(list(parts), k=600))]
    d = spark.createDataFrame([*data, (None, "the tion", "en"), (9001, "12 345 !!", "en"), (9002, None, "de"), (9003, plain.LONG, None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in rows(langid.held_out_language(d))}
    lang = {i: g for i, _, g in data}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in lang)
    test = [i for i in lang if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang[i] for i in test]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert got[9001].lang_pred == got[9002].lang_pred == "und" and got[9003].lang_pred in parts
    hidden = d.withColumn("lang", F.when(~langid.held_out(), F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in rows(langid.held_out_language(hidden))}
    assert all(again[i] == got[i].lang_pred for i in got)
    assert {r.doc_id for r in rows(langid.accepted(d))} >= set(lang) and langid.accepted(d).where("doc_id in (9001, 9002)").count() == 0


def test_language_plain(spark):
    """Naive Bayes from dictionaries of grams; so few grams hardly share buckets."""
    rng = random.Random(5)
    data = [(i, " ".join("".join(rng.choices(p, k=4)) for _ in range(rng.randint(1, 12))), g) for i in range(120) for g, p in [rng.choice([("x", "abcd"), ("y", "cdef")])]]
    train = [(t, g) for i, t, g in data if zlib.crc32(str(i).encode()) % 5]
    grams = lambda t: Counter(s[k : k + n] for s in [f" {t} "] for n in (1, 2, 3) for k in range(len(s) - n + 1))
    counts = {g: sum((grams(t) for t in {t for t, h in train if h == g}), Counter()) for g in ("x", "y")}
    prior = Counter(g for _, g in train)

    def posterior(t):
        w = {g: math.log(prior[g] / len(train)) + sum(n * math.log((counts[g][k] + 0.5) / (counts[g].total() + 0.5 * 65536)) for k, n in grams(t).items()) for g in counts}
        top = max(w.values())
        return max(w, key=w.get), 1 / sum(math.exp(v - top) for v in w.values())

    got = {r.doc_id: r for r in rows(langid.held_out_language(spark.createDataFrame(data, "doc_id long, text string, lang string")))}
    for i, t, _ in data:
        lang, score = posterior(t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=2e-3), t


def test_language_noise(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "tion", "and", "er", "sh"], "de": ["sch", "ung", "und", "ein", "\u00e4", "\u00fc"]}
    text = lambda g, n: " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(n))
    data = [(i, text(g, rng.randint(1, 80)), g) for i in range(300) for g in [rng.choice(["en", "de"])]]
    noise = [(1000 + i, "".join(rng.choices("bcdfghjklmnpqrstvwxyz ", k=300)), None) for i in range(20)] + [(2000, "\u4f60\u597d\u4e16\u754c" * 40, None)]
    kept = {r.doc_id for r in rows(langid.accepted(spark.createDataFrame(data + noise, "doc_id long, text string, lang string")))}
    assert kept == set(range(300))


def test_language_awkward(awkward, empty):
    got = langid.held_out_language(awkward)
    assert got.count() == len(plain.AWKWARD) and langid.accepted(awkward).columns == awkward.columns
    assert langid.held_out_language(empty).count() == 0
    assert {r.lang_pred for r in rows(langid.held_out_language(awkward.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


def test_mixing(prose):
    got = rows(mixing.mix(prose))
    size = {r.doc_id: len(plain.words(r.text)) for r in rows(prose)}
    source = {r.doc_id: r.source for r in rows(prose)}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += size[r.doc_id]
        taken[source[r.doc_id]] += r.taken
        assert r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
    want = plain.targets(dict(sizes))
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in got)
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    assert Counter(map(tuple, got)) == Counter(map(tuple, rows(mixing.mix(prose.repartition(3)))))
    copies = Counter(r.doc_id for r in rows(mixing.mixed(prose)))
    assert copies == Counter({r.doc_id: r.copies for r in got if r.copies})
    for s in want:  # the tilt of each source by bisection over its documents, from the plain formula
        own = [r for r in got if source[r.doc_id] == s and r.size]
        mean, low, high = sum(r.size for r in own) / len(own), -200.0, 200.0
        rate = lambda r, tilt, mean=mean: 2 / (1 + math.exp(-max(-700, min(700, tilt * r.size / mean))))
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(rate(r, tilt) * r.size for r in own) < want[s] else (low, tilt)
        if want[s] < 2 * sizes[s] * (1 - 1e-9):
            assert all(r.rate == pytest.approx(rate(r, low), abs=1e-4) for r in own)


def test_mixed_repeated_rows(spark):
    rng = random.Random(14)
    data = [(i // 2 if i < 60 else i, " ".join("w" * rng.randint(1, 4) for _ in range(9 + (i // 2 if i < 60 else i) % 40)), f"s{i % 2 if i < 60 else i % 3}", i) for i in range(120)]
    data = [(i, data[2 * i][1] if i < 30 else t, s, k) for i, t, s, k in data]
    data += [data[0]] * 30 + [(None, "one two", None, 1)] * 3
    d = spark.createDataFrame(data, "doc_id long, text string, source string, k long")
    took, got = Counter(), Counter()
    for r in rows(mixing.mix(d)):
        took[r.doc_id, r.source] += r.copies
    for r in rows(mixing.mixed(d)):
        got[r.doc_id, r.source] += 1
    assert got == +took and {(r.doc_id, r.k) for r in rows(mixing.mixed(d))} <= {(x[0], x[3]) for x in data}


def test_mixing_hot_cell(spark):
    d = spark.range(7000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"))
    got = rows(mixing.mix(d))
    total = Counter()
    for r in got:
        total[r.source] += r.taken
    want = plain.targets({"a": 15000, "b": 6000})
    assert all(abs(total[s] - want[s]) <= 3 for s in want)


def test_mixing_awkward(awkward, empty):
    got = rows(mixing.mix(awkward))
    assert len(got) == len(plain.AWKWARD) and sum(r.size for r in got) == sum(len(plain.words(t)) for _, t, *_ in plain.AWKWARD) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(awkward).columns == awkward.columns


def test_packing(spark, prose, awkward, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    data = [(r.doc_id, r.text) for r in rows(prose)] + [(10_000 + i, t) for i, (_, t, *_) in enumerate(plain.AWKWARD)] + [(20_000, "x <|endoftext|> y"), (20_001, " \u00a0 tab\t\n\n  \u4f60\u597d don't")]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit(1))
    pieces = {}
    for r in rows(packing.pack(d, with_ids=True)):
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in data:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == ids.tobytes() and [r.start for r in got] == [sum(q.length for q in got[:k]) for k in range(len(got))]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    sequences = {}
    for r in itertools.chain(*pieces.values()):
        sequences.setdefault(r.sequence_id, []).append(r)
    lengths = []
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        lengths.append(sum(r.length for r in s))
    assert sorted(lengths)[1:] == [1024] * (len(lengths) - 1)
    assert packing.pack(awkward).groupBy("doc_id").count().count() > 5 and packing.pack(empty).count() == 0


def test_encoder_by_words():
    """Ids put together from words equal those of whole texts, for every character and many ways to stand beside others."""
    encode = packing.encoder(packing.default_vocabulary())
    letters = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    rng = random.Random(8)
    texts = [f"a{c}b {c} 1{c}2  {c}{c}\n{c}'s {c}" for c in letters] + ["".join(rng.choices(letters[:98] + [" ", "\n", "'s", "'ll", " the", "12"] * 9, k=80)) for _ in range(600)]
    assert all(packing._OLD.fullmatch(t) for t in texts) and encode(texts) == encode._whole(texts)
    others = ["\u4f60\u597d \x1c\x85\xa0 x", "x <|endoftext|> y", ""]
    assert encode(others) == encode._whole(others)


def test_licenses(spark, awkward, empty):
    s = license_scan.SENTENCES
    texts = {
        1: "Intro. Released under the MIT License.\nMore text.",
        2: "\n".join((s["mit-grant"], s["mit-notice"], s["mit-as-is"])),
        3: " ".join((s["bsd-grant"], s["bsd-source"], s["bsd-binary"], s["bsd-names"])),
        4: " ".join((s["bsd-grant"], s["bsd-source"], s["bsd-binary"])),
        5: " ".join((s["bsd-binary"], s["bsd-source"], s["bsd-grant"])),
        6: "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
        7: "We licensed the software and the license was long.",
        8: s["apache-grant"].replace(" you", "\n you") + "\n" + s["apache-copy"],
        9: "// SPDX-License-Identifier: Apache-2.0",
    }
    got = {r.doc_id: r.licenses for r in rows(license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert got[1] == ["MIT"] and got[2] == ["MIT"] and got[3] == ["BSD-3-Clause"] and got[4] == ["BSD-2-Clause"] and got[5] == [] and got[6] == ["GPL-3.0-only", "CC-BY-NC-4.0"] and got[7] == [] and got[8] == ["Apache-2.0"]
    assert license_scan.scan_licenses(awkward).count() == len(plain.AWKWARD) and license_scan.scan_licenses(empty).count() == 0


def plain_sentences(known, text):
    """Longest known sentence at every place where one may begin, with words, beginnings and ends found letter by letter."""
    low, words = text.lower(), []
    for m in license_scan._WORD.finditer(low):
        words.append((m.group(), m.start(), m.end()))
    gaps = [low[(words[k - 1][2] if k else 0) : (words[k][1] if k < len(words) else len(low))] for k in range(len(words) + 1)]
    sign = [k in (0, len(words)) or any(c in ".:;!?\n\r()[]{}<>*#|/\u2022\u3002\uff01\uff1f" for c in g) for k, g in enumerate(gaps)]
    out, i = [], 0
    while i < len(words):
        ends = [j for j in range(i + 1, min(len(words), i + 90) + 1) if sign[i] and sign[j] and tuple(w for w, *_ in words[i:j]) in known]
        if ends:
            out.append(known[tuple(w for w, *_ in words[i : ends[-1]])])
        i = ends[-1] if ends else i + 1
    return out


def test_licenses_plain():
    scanner = license_scan.Scanner.default()
    notices = [(n.format(name=s, the=the), name) for name, shown in license_scan.NAMES.items() for n in license_scan.NOTICES for s in shown for the in ("the ", "")]
    for text, name in notices:
        assert scanner.licenses(scanner.identifiers(f"Some words. {text}\nand more")) == [name], text
    for key, text in license_scan.SENTENCES.items():
        words = text.split(" ")
        for k in range(1, len(words)):
            assert key in scanner.identifiers("Intro\n" + " ".join(words[:k]) + "\n" + " ".join(words[k:])), (key, k)
        assert key in scanner.identifiers("\n * ".join(words)) and scanner.identifiers("so " + text) != [key]
    known = {tuple(license_scan.sentence_words(t)): f"named:{n}" for t, n in notices} | {tuple(license_scan.sentence_words(t)): k for k, t in license_scan.SENTENCES.items()}
    rng = random.Random(23)
    parts = [t for t, _ in rng.sample(notices, 40)] + list(license_scan.SENTENCES.values()) + ["word", "The License", "a.", "2.0", "\n", "Licensed", "under", "the", "(MIT)", "//", "MIT License"]
    for _ in range(150):
        text = rng.choice([" ", "\n", ". "]).join(rng.choices(parts, k=rng.randint(1, 12)))
        assert scanner.identifiers(text) == plain_sentences(known, text), text


def test_media(prose, awkward, empty):
    import io
    import wave

    for d in (prose, awkward):
        got = rows(media.media_digests(d))
        want = Counter()
        for t in (r.text for r in rows(d)):
            raw = (t or "").encode()
            p = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
            with wave.open(file := io.BytesIO(), "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(1)
                w.setframerate(8000)
                w.writeframes(p)
            x = [b - 128 for b in p]
            feature = f"samples={len(x)};mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};crossings={sum((a < 0) != (b < 0) for a, b in itertools.pairwise(x))}"
            want[len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest(), feature] += 1
        assert Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == want
    assert media.media_digests(empty).count() == 0
    with pytest.raises(ValueError):
        media.samples_of(media.wave_header(64) + bytes(62))


def test_media_chunks(spark):
    rng = random.Random(6)
    shared = bytes(rng.randrange(32, 127) for _ in range(30_000))
    texts = [bytes(rng.randrange(32, 127) for _ in range(rng.randrange(100, 3000))) + shared + bytes(rng.randrange(32, 127) for _ in range(500)) for _ in range(20)]
    sizes = media.chunk_lengths([media.payload_of(t) for t in texts], media.Chunking())
    assert all(s <= 8192 for c in sizes for s in c) and sizes == [media.chunk_lengths([media.payload_of(t)], media.Chunking())[0] for t in texts]
    d = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    store, _ = media.store_media(d)
    stored = sum(r.size for p in rows(store.where("kind = 'pack'")) for r in p.chunks if not r.shared)
    assert store.where("kind = 'chunk'").count() >= 10 and stored < 20 * 10_000 and media.rebuild_media(store).count() == 20


def test_substring(spark, awkward, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    sentence = lambda: (" ".join(word() for _ in range(12)) + ".").capitalize()
    passage = " ".join(sentence() for _ in range(5))
    own = [[sentence() for _ in range(6)] for _ in range(8)]
    texts = [" ".join(s[:3]) + " " + passage + " " + " ".join(s[3:]) if k % 2 else " ".join(s) for k, s in enumerate(own)]
    inner = passage.split(". ", 1)[1].rsplit(". ", 1)[0] + "."  # the sentences that lie whole in a broken one
    texts += [f"{s[0]} Open {word()} clause then {passage} and goes {word()} on. {s[1]}" for s in own[:2]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in rows(substring.drop_repeats(d))}
    assert got[1].text == texts[1] and all(got[i].text == texts[i].replace(passage + " ", "") for i in (3, 5, 7)) and all(got[i].text == texts[i] for i in (0, 2, 4, 6))
    assert all(inner not in got[i].text and got[i].n_removed >= 3 for i in (8, 9))
    for i in (3, 5, 7):
        a, b = map(int, got[i].spans.split(":"))
        assert texts[i][a:b].strip() == passage
    out = rows(substring.drop_repeats(awkward))
    assert len(out) == len(plain.AWKWARD) and sum(r.text is None for r in out) == 2
    assert substring.drop_repeats(empty).count() == 0


def test_substring_plain(spark):
    """Every run of two or more sentences and ten or more words, all of them looked up, against the operator."""
    rng = random.Random(19)
    sentences = [" ".join(rng.choices("abcdef", k=rng.randint(1, 7))).capitalize() + rng.choice([". ", "! ", "?\n", "\n"]) for _ in range(60)]
    texts = ["".join(rng.choices(sentences, k=rng.randint(1, 14))) for _ in range(40)]
    at = [rng.randrange(50) for _ in range(30)]
    texts += ["".join(sentences[k : k + rng.randint(2, 9)]) for k in at]
    texts += ["Das ist New York City. Der Hund lief im Garten.", "\u6211\u4eec\u5728\u8fd9\u91cc\u5199\u4e00\u53e5\u8bdd\u3002" * 3, None, ""]
    runs, spans = {}, {}
    for i, t in enumerate(texts):
        spans[i] = substring.sentence_spans(t or "")
        words = [(k, w) for k, (a, b) in enumerate(spans[i]) if (w := t[a:b].lower().split())]
        for x, y in itertools.combinations(range(len(words)), 2):
            if sum(substring.n_words(w) for _, w in words[x : y + 1]) >= 10:
                runs.setdefault(tuple(" ".join(w) for _, w in words[x : y + 1]), []).append((i, words[x][0], words[y][0]))
    gone = {i: set() for i in range(len(texts))}
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b + 1))
    blank = {i: {k for k, (a, b) in enumerate(s) if not texts[i][a:b].split()} for i, s in spans.items()}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in rows(substring.drop_repeats(d, least_words=10))}
    assert len(got) == len(texts) and sum(map(bool, gone.values())) > 20
    for i, t in enumerate(texts):
        removed = {k for k, (a, b) in enumerate(spans[i]) for x in filter(None, got[i].spans.split(",")) if int(x.split(":")[0]) <= a and b <= int(x.split(":")[1])}
        assert removed - blank[i] == gone[i] - blank[i], (i, t)
    assert [len(substring.sentence_spans(t)) for t in texts[-4:-2]] == [2, 3]


def test_sentences():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choices("aB. \n!?", k=rng.randrange(40)))
        s = substring.sentence_spans(t)
        assert "".join(t[a:b] for a, b in s) == t and all(a < b for a, b in s)


PERSONAL = [
    "mail a.b@c.de, x@y, a@b.c+d@e.f and 1.2.3.4.5.6.7.8 or 256.1.1.1 and 001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111, 12345678901234567890 and 79927398713",
    "+49 (0)30 1234567-8 +1 23 +12345678901234567 ++49301234567 a@@b.c @x.y 5555555555554444.",
    "\U0001f600\u00e9 a@b.co \u00fc 10.0.0.1\U0001f600 +49301234567", "", None, "@" * 50 + "." * 50 + "1." * 30, "a" * 5000 + "@b.c",
]


def test_personal_data(spark, awkward, empty):
    rng = random.Random(12)
    texts = PERSONAL + ["".join(rng.choices("a1@. +-(2", k=60)) for _ in range(400)] + ["".join(rng.choices("0123456789 -", k=80)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in rows(pii.span_digests(d))}
    for i, t in enumerate(texts):
        want = plain.base_spans(t)
        assert got[i].base_sha256 == plain.sha(want) and got[i].n_email == want.count("email") and got[i].n_phone == want.count("phone"), t
    assert pii.span_digests(awkward).count() == len(plain.AWKWARD) and pii.span_digests(empty).count() == 0
    clean = {r.doc_id: r.text for r in rows(pii.sanitise(d))}
    assert clean[0].startswith("mail <EMAIL>, x@y, <EMAIL>") and clean[4] == "" and clean[5] is None
    assert pii.sanitise(awkward).columns == awkward.columns


def test_disclosure_plain(spark):
    """Counts and measure of the disclosing terms, from the texts with plain loops."""
    rng = random.Random(27)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(900)]
    entities = [f"u{k}@host{k % 3}.example" for k in range(12)] + ["10.0.0.7", "+49 30 1234567"]
    texts = []
    for _ in range(260):
        w = rng.choices(vocabulary, k=rng.randint(20, 90))
        for _ in range(rng.choice([0, 0, 1, 2])):
            e = rng.choice(entities)
            w.insert(rng.randrange(len(w)), f"Name{chr(97 + entities.index(e)) * 3} {e}," if rng.random() < 0.6 else e)
        texts.append(" ".join(w))
    texts += texts[:15]
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    total, n_term = 0, Counter()
    n_entity, both, shown = Counter(), Counter(), {}
    for t in texts:
        n_term.update(letters(t))
        total += len(letters(t))
        for span in filter(None, plain.base_spans(t).split(",")):
            kind, a, b = span.split(":")
            e = t[int(a) : int(b)]
            n_entity[e] += 1
            for term in {*letters(t[: int(a)])[-3:], *letters(t[int(b) :])[:3]}:
                both[e, term] += 1
                shown.setdefault((e, term), set()).add((*letters(t[: int(a)])[-20:], *letters(t[int(b) :])[:20]))
    want = {}
    for (e, term), n in both.items():
        p = 1 / (n_term[term] / n + 1 / len(shown[e, term]))
        if p >= 0.5 and math.log2(p / min(1, 6 * n_entity[e] / total)) >= 4:
            want[term] = max(want.get(term, 0), p)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    based = pii.base_spans(d).where("size(base) > 0").select("text", "base")
    got = {r.term: r.disclosure for r in rows(pii.disclosing_terms(d, based, least_share=0.5))}
    assert len(want) > 5 and got == pytest.approx(want)


def test_disclosing_terms(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    for k in range(12):
        texts[k] += f" {word()} {word()} Zanzibar boss@corp.example {word()} {word()}"
    texts[200] += " about Zanzibar alone"
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in rows(pii.span_digests(d))}
    assert all("term:" in got[k] and "email:" in got[k] for k in (*range(12),)) and got[200].startswith("term:") and not any(got[k] for k in range(12, 300) if k != 200)
    assert "<TERM> <EMAIL>" in {r.doc_id: r.text for r in rows(pii.sanitise(d))}[3]


def test_cascade(spark):
    keys = [f"k{i}" for i in range(4000)]
    for listed in (keys[:700], [], keys, keys[:1]):
        d = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
        y = spark.createDataFrame([(k,) for k in listed], "key string")
        c = urlfilter.Cascade.build(y, d)
        assert {r.key for r in rows(d.where(c.holds(F.col("key"))))} == set(listed)
    with pytest.raises(ValueError):
        urlfilter.Cascade.build(d, d, most_keys=10)


def test_url_rules(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = ["http://a.example.com/en/5", "https://EXAMPLE.com/en/77?x", "http://x.net/de/8", "http://b.example.net/de/81#t", "http://noexample.com/en/7", "http://flood.io/a?b://c", "ftp://q", "no scheme", None, "http://h?x", "a://b/c d/e#f?g", ""]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, None, "y"), (0, urls[0], "z")], "page_id long, url string, host string")
    got = rows(urlfilter.judge(d, rules, spark.createDataFrame([("flood.io",)], "key string")))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("a.example.com", "/en/5", "com/en/", "block") and by[1] == ("example.com", "/en/77", "example.com/en/7", "allow") and by[2] == ("x.net", "/de/8", "net/de/", "allow")
    assert by[3] == ("b.example.net", "/de/81", "example.net/de/8", "block") and by[4] == ("noexample.com", "/en/7", "com/en/", "block") and by[5] == ("flood.io", "/a", None, "block")
    asked = {r.page_id: r.verdict for r in rows(urlfilter.judge(d, [], urlfilter.queried_addresses(d), by="address")) if r.page_id is not None}
    assert {i for i, v in asked.items() if v == "block"} == {1, 5, 9, 10} - ({10} if "?" not in urls[10].split("#")[0] else set())
    assert by[6] == ("q", "", None, "allow") and by[7] == by[8] == by[11] == ("", "", None, "allow") and by[9] == ("h", "", None, "allow") and by[10] == ("b", "/c d/e", None, "allow") and len(got) == 14
    assert urlfilter.judge(d.where("false"), rules, spark.createDataFrame([("x",)], "key string")).count() == 0


def test_packing_asks_the_model_once_a_word(monkeypatch):
    """Words of plain texts go to the library's model, each once, and give the ids of whole texts; no text is encoded whole for them."""
    encode = packing.Encoder(packing.default_vocabulary())
    texts = ["the cat sat, the cat sat on the mat", " don't  stop\n\n\tna\u00efve \u00bd 12xy \x21\u024f", "", "the mat"]
    want = encode._whole(texts)
    monkeypatch.setattr(encode, "_whole", lambda texts: [1 / 0 for _ in texts])
    assert encode(texts) == want and encode(texts[::-1]) == want[::-1]
    assert " cat" in encode.memo and len(encode.memo) == len(set().union(*(packing._WORDS.findall(t) for t in texts)))
