"""Substring deduplication: hashes of runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatica.llm.common import KeyFilter, materialise, slices

#: What ends a sentence: . ! ? or the like with closing quotes or brackets and the white space behind, a line break, or a
#: full-width mark, which needs no space behind it.
_END = re.compile("[.!?\u2026\u3002\uff01\uff1f]+[\"'\u201d\u2019)\\]]*(?:\\s+|$)|[\u3002\uff01\uff1f]+[\"'\u201d\u2019)\\]\u300d]*|\\n\\s*")
#: Letters of scripts that put no blanks between words; two of them are counted as a word.
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Bounds (code points) of the sentences of ``text``; together they cover it without gaps."""
    ends = [m.end() for m in _END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def n_words(words: list[str]) -> int:
    """Number of words of a sentence cut at blanks."""
    return len(words) if all(map(str.isascii, words)) else len(words) + sum(len(_UNPARTED.findall(w)) // 2 for w in words)


def sentence_runs(text: str, run: int, least_words: int) -> list[tuple[int, int, int, int]]:
    """Runs of consecutive sentences that are looked up: first sentence, last sentence, and a 128-bit hash in two parts.

    A run holds ``run`` sentences and ``least_words`` words at least. The shortest run from each sentence on and the shortest
    up to each sentence stand for all: a longer run that is repeated consists of shorter ones that are repeated, and each
    sentence of it lies in one of them. Case and white space do not matter. Sentences without a word are passed over.
    """
    kept, words = [], []
    for k, (a, b) in enumerate(sentence_spans(text)):
        w = text[a:b].lower().split()
        if w:
            kept.append(k)
            words.append(w)
    n = list(map(n_words, words))
    found = set()
    j = total = 0  # the shortest run from i on is i..j-1
    for i in range(len(n)):
        while j < len(n) and not (total >= least_words and j - i >= run):
            total += n[j]
            j += 1
        if total >= least_words and j - i >= run:
            found.add((i, j - 1))
        total -= n[i]
    i, total = len(n), 0  # the shortest run up to j is i..j
    for j in range(len(n) - 1, -1, -1):
        while i > 0 and not (total >= least_words and j - i + 1 >= run):
            i -= 1
            total += n[i]
        if total >= least_words and j - i + 1 >= run:
            found.add((i, j))
        total -= n[j]
    line = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    out = []
    for i, j in sorted(found):
        h = xxhash.xxh3_128_intdigest(b"\n".join(line[i : j + 1]))
        out.append((kept[i], kept[j], _signed(h >> 64), _signed(h & (1 << 64) - 1)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _runs(run: int, least_words: int):
    def work(batches):
        for batch in batches:
            for start, stop, texts in slices(batch.column(2), 400_000):
                found = [(start + k, *r) for k, text in enumerate(texts) if text for r in sentence_runs(text, run, least_words)]
                part = list(zip(*found, strict=True)) if found else [()] * 5
                ids = [batch.column(k).take(pa.array(part[0], pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(part[1:], (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "text_hash", "first", "last", "h1", "h2"])

    return work


_KEPT = {"text": pa.string(), "n_removed": pa.int32(), "removed_chars": pa.int64(), "spans": pa.string()}


def without(text: str, removed: list[int]) -> tuple[str, int, int, str]:
    """What stays of a text without the sentences of ``removed`` (first, last, first, last, ...), their number and
    characters, and the spans that went."""
    spans = sentence_spans(text)
    drop = {k for a, b in zip(removed[0::2], removed[1::2], strict=True) for k in range(a, b + 1)}
    merged: list[list[int]] = []
    for k in sorted(drop):
        a, b = spans[k]
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    kept = "".join(text[a:b] for k, (a, b) in enumerate(spans) if k not in drop)
    return kept, len(drop), sum(b - a for a, b in merged), ",".join(f"{a}:{b}" for a, b in merged)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType()), T.StructField("removed_chars", T.LongType()), T.StructField("spans", T.StringType())]))
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out = [(t, 0, 0, "") if t is None or not r else without(t, r) for i, j, part in slices(texts) for t, r in zip(part, removed.slice(i, j - i).to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(_KEPT.values())], list(_KEPT))


def repeated_runs(docs: DataFrame, run: int = 2, least_words: int = 30) -> DataFrame:
    """Every non-first occurrence of a repeated run: doc_id, text_hash (they name the document), first, last (sentences).

    Of the occurrences of a run the first stays, by doc_id (null last), hash of the text and place. A run's
    occurrences are counted with a map-side combine and never gathered. Most runs occur once: a Bloom filter of the hashes
    that occur more often (8 MB at most; a full one only lets more runs pass) keeps them out of the join, which is exact.
    """
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = named.mapInArrow(_runs(run, least_words), f"doc_id {kind}, text_hash long, first int, last int, h1 long, h2 long")
    runs = materialise(runs, "runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "first")
    often = materialise(runs.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("key")), "often")
    some = runs.where(KeyFilter(often, probes=3).passes(F.col("h1")))
    heads = some.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "head")
    return some.join(materialise(heads, "heads"), ["h1", "h2"]).where(place != F.col("head")).select("doc_id", "text_hash", "first", "last")


def drop_repeats(docs: DataFrame, run: int = 2, least_words: int = 30) -> DataFrame:
    """Remove from each text the sentences that a non-first occurrence of a repeated run covers.

    A run is ``run`` or more consecutive sentences with ``least_words`` words in all; every such run counts. Returns doc_id, text
    (what stays), n_removed, removed_chars, spans (``start:end`` of what went, code points, comma-joined). The first
    occurrence stays, so nothing is lost altogether. Repeats within one document count. A passage that is pasted into an
    open sentence is found but for its first and last sentence, which the text around changes; one that is a single
    sentence is not found. A null text stays null and has no sentence; an empty one stays. Rows that share doc_id and text
    are one document: they come back as often as they came, all alike. An empty table gives no rows; other columns are
    ignored. Only rows that a Bloom filter takes for documents with something to remove are joined.
    """
    gone = repeated_runs(docs, run, least_words).groupBy("doc_id", "text_hash").agg(F.flatten(F.sort_array(F.collect_set(F.array("first", "last")))).alias("removed"))
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "removed"), "removed")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seem = KeyFilter(gone.select(F.xxhash64("_id", "_h").alias("key"))).passes(F.xxhash64("doc_id", "text_hash"))
    some = d.where(seem).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    rest = d.where(~seem).select("doc_id", "text", F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("removed_chars"), F.lit("").alias("spans"))
    return some.withColumn("r", _without("text", "removed")).select("doc_id", "r.*").unionByName(rest)
