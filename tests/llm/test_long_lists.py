"""Lists and texts with very many entries: URL lists over a cascade's bound, texts with many licences."""

import random
import time

from pyspark.sql import functions as F

from somatica.llm import license_scan, urlfilter


def test_list_over_the_bound(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 300, F.lit(".io/a")).alias("url"))
    listed = spark.range(120).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".io")).alias("key"))
    got = urlfilter.judge(pages, [], listed, most_keys=50).collect()
    assert len(got) == 600 and all((r.verdict == "block") == (r.page_id % 300 < 240 and r.page_id % 2 == 0) for r in got)


def test_many_license_matches():
    """A text with very many licences: linear in them."""
    scanner = license_scan.Scanner.default()
    began = time.monotonic()
    ids = scanner.identifiers("Licensed under the MIT License.\nReleased under the ISC License.\n" * 50_000)
    assert len(ids) == 100_000 and scanner.licenses(ids) == ["MIT", "ISC"] and time.monotonic() - began < 20


def test_rules_one_by_one():
    """Against taking the first match of a rule, then the next among what is left."""
    rng = random.Random(3)
    scanner, keys = license_scan.Scanner.default(), [s for _, sequence in license_scan.RULES for s in sequence]
    few = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-advertising", "mit-grant", "mit-notice", "mit-as-is"]
    for _ in range(500):
        ids = rng.choices(rng.choice([keys, few]), k=rng.randrange(25))
        left, found = list(enumerate(ids)), []
        for name, sequence in license_scan.RULES:
            while True:
                picked = []
                for k, s in left:
                    if len(picked) < len(sequence) and s == sequence[len(picked)]:
                        picked.append(k)
                if len(picked) < len(sequence):
                    break
                found.append((picked[0], name))
                left = [x for x in left if x[0] not in picked]
        assert scanner.licenses(ids) == list(dict.fromkeys(name for _, name in sorted(found)))


def test_sentences_of_whole_texts():
    scanner = license_scan.Scanner.default()
    ids = scanner.identifiers("\n\n".join(license_scan.SENTENCES.values()))
    assert ids == list(license_scan.SENTENCES)
    assert scanner.licenses(["agpl3-preamble", "gpl3-copying"]) == ["AGPL-3.0-only"]
    assert {"GPL-3.0-only", "CC-BY-NC-4.0", "LGPL-3.0-only", "MPL-2.0"} <= set(scanner.licenses(ids))
