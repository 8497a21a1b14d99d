"""Names that give few or templated spans away."""

import random
import time

import pytest
from pyspark.sql import functions as F

from somatica.llm import pii


@pytest.mark.parametrize("times", [2, 3, 4])
def test_few_spans_one_template_and_far_words(spark, times):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)]
    for k in range(times):
        texts[k] += f" {word()} {word()} Zanzibar few@corp.example {word()} {word()}"
        texts[20 + k] += " please ask Quetzal at one@corp.example for all of it"
        texts[40 + k] += " Farewell " + "-" * 120 + f" far@corp.example {word()}"
    texts[60] += f" {word()} Singleton once@corp.example {word()}"
    texts += [texts[60]] * 6  # copies of one text
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert all("Zanzibar" not in got[k] and "Quetzal" not in got[20 + k] and "Farewell" not in got[40 + k] for k in range(times))
    assert "Singleton" in got[60] and "@" not in "".join(got.values()) and all(got[k] == texts[k] for k in range(100, 200))


@pytest.mark.parametrize("size", [10**5, 10**6])
def test_any_size(spark, size):
    """The same planted names are found, and the same words left, whatever stands around them."""
    filler = spark.range(size // 50).select((F.col("id") + 1000).alias("doc_id"), F.concat_ws(" ", *[F.translate(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)).cast("string"), "0123456789", "abcdefghij") for k in range(50)]).alias("text"))
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("klmnopqrst", k=7))
    planted = [f"{' '.join(word() for _ in range(30))} Zanzibar boss@corp.example {' '.join(word() for _ in range(30))}" for _ in range(2)]
    planted += [f"{' '.join(word() for _ in range(30))} only{chr(97 + k)} u{k}@corp.example" for k in range(5)]
    planted += ["other " + planted[2]]  # a near copy
    d = filler.unionByName(spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string"))
    found = {r.term for r in pii.disclosing_terms(d, pii.base_spans(d).where("size(base) > 0").select("text", "base")).collect()}
    assert found == {"zanzibar"}


def test_many_spans_in_one_text(spark):
    """Thousands of spans in one text take seconds: placed, judged and replaced in time that grows with the text."""
    rng = random.Random(29)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    n = 8000
    text = " ".join(f"{word()} Quetzal{'' if k % 2 else 'x'} user{k % 7}@corp.example {word()} +49 30 {k + 1234567}, {word()}" for k in range(n))
    d = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    began = time.monotonic()
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert time.monotonic() - began < 60
    assert clean[1].count("<EMAIL>") == n and clean[1].count("<PHONE>") == n and "@" not in clean[1] and clean[2] == "nothing here" and clean[3] is None
    assert clean[1].startswith(text[: text.index(" Quetzal")])
    spans = pii.span_digests(d).where("doc_id = 1").first()
    assert spans.n_email == n and spans.n_phone == n


def test_replaced(spark):
    """Against a plain version, spans that overlap and touch included."""
    rng = random.Random(31)
    cases = []
    for _ in range(300):
        text = "".join(rng.choices("ab é\U0001f600-1", k=rng.randrange(1, 30)))
        spans = sorted((s, rng.randrange(3), rng.randrange(s + 1, len(text) + 1)) for s in (rng.randrange(len(text)) for _ in range(rng.randrange(1, 5))))
        cases.append((text, [(s, k, e, f"k{k}", "") for s, k, e in spans]))
    d = spark.createDataFrame(cases, "text string, spans array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    for r in d.select("text", "spans", pii.replaced(F.col("text"), F.col("spans")).alias("got")).collect():
        at, out = 0, ""
        for s in r.spans:
            out += "" if s.start < at else r.text[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        assert r.got == out + r.text[at:], (r.text, r.spans)
