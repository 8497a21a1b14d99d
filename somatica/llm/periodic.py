"""Periodic runs: stretches of words that repeat with a short period, found by divide and conquer at midpoints.

A run crosses the middle of the smallest segment that holds it. There Z-functions of both halves give, for every period, how far the
words to the left and to the right agree with those one period on (Main and Lorentz, 1984).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatica.llm.common import slices

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of a text that become words at once.
_PIECE = 1_000_000
#: Periods up to this leave no room for other runs inside: two runs share fewer words than their periods make together.
_PLAIN_PERIOD = 3

Run = tuple[int, int, int]
_SPACE = b" \t\n\x0b\x0c\r"
_KIND = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
])


class Interner(dict):
    """Ids of words, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of the words ``[^\\x20\\x09-\\x0D]+`` of a text, which is cut into pieces at blanks."""
        if len(text) <= _PIECE:
            return np.array([self[w] for w in text.split()], np.int64)
        parts, at = [], 0
        while at < len(text):
            end = at + _PIECE
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            parts.append(np.array([self[w] for w in text[at:end].split()], np.int64))
            at = end
        return np.concatenate(parts)


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that the list begins with (0 at place 0)."""
    n = len(s)
    z, a, b = [0] * n, 0, 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        if i + k >= b or not k:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            if i + k > b:
                a, b = i, i + k
        z[i] = k
    return z


def crossing_runs(left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
    """Runs over the border of ``left`` and ``right`` that have two periods or more on the right: words on the left, words on the
    right, period. ``agree`` looks for what ends each shifted copy, ``ahead`` for what begins it."""
    ahead = z_function(right)
    back = left[::-1]
    agree = z_function([*back, -1, *right[::-1], *back])
    out, n = [], len(right)
    for p in range(1, n // 2 + 1):
        on = ahead[p]
        if on >= p:
            before = min(agree[len(back) + 1 + n - p], len(left))
            whole = before + p + on
            if before and whole >= LEAST_WORDS and whole >= LEAST_TIMES * p:
                out.append((before, p + on, p))
    return out


def repeated_trigrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where three words begin, the next and the previous place with the same three (by hash: also others now and
    then, which costs a look but loses nothing); far outside where there is none."""
    n = len(ids) - 2
    u = ids.astype(np.uint64)
    key = ((u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:]) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    after, before = np.full(n, 1 << 60), np.full(n, -1)
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    return after, before


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a list of word ids, by start, then period.

    A run with two periods or more to the right of a midpoint m has the words m-1, m, m+1 again one period on; one with two or more to the
    left has m-2, m-1, m again one period before. Where no such place lies in the segment, its Z-functions are not needed.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    after, before = repeated_trigrams(ids)
    found: dict[tuple[int, int], int] = {}
    plain: list[tuple[int, int]] = []
    lo, hi = np.array([0]), np.array([n])
    while len(lo):
        mid = (lo + hi) // 2
        looked = (after[np.minimum(mid - 1, n - 3)] + 2 < hi) | (before[mid - 2] >= lo)
        for a, m, b in zip(lo[looked].tolist(), mid[looked].tolist(), hi[looked].tolist(), strict=True):
            if any(s <= a and b <= e for s, e in plain):
                continue
            left, right = ids[a:m].tolist(), ids[m:b].tolist()
            spans = [(m - x, m + y, p) for x, y, p in crossing_runs(left, right)] + [(m - y, m + x, p) for x, y, p in crossing_runs(right[::-1], left[::-1])]
            for s, e, p in spans:
                # one that goes on beyond the segment crosses the middle of a larger one, too
                if (s == a and s and ids[s - 1] == ids[s - 1 + p]) or (e == b and e < n and ids[e] == ids[e - p]):
                    continue
                found[s, e] = min(p, found.get((s, e), p))
                if p <= _PLAIN_PERIOD:
                    plain.append((s, e))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        long = hi - lo >= LEAST_WORDS
        lo, hi = lo[long], hi[long]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Places of the words that stay: of each run only its first period, whatever other runs say."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def may_repeat(all_ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of several texts, whose ids follow each other, whether some three words stand there three times; every run has such."""
    out = np.zeros(len(sizes), bool)
    if len(all_ids) < LEAST_WORDS:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    u = all_ids.astype(np.uint64)
    key = (((owner[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + u[:-2]) * np.uint64(0x9E3779B97F4A7C15) + u[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:]) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key)
    key = key[order]
    thrice = np.flatnonzero((key[2:] == key[:-2]))
    out[owner[order[thrice]]] = True
    return out


def collapse(texts: list[str | None]) -> tuple[list[list[Run]], list[str]]:
    """Runs of each text, and the text without the repeats, its words joined by one blank; null counts as empty."""
    intern = Interner()
    ids = [intern.ids(t.encode("utf-8", "surrogatepass")) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(k) for k in ids], np.int64)
    some = may_repeat(np.concatenate(ids), sizes) if ids else []
    runs = [find_runs(k) if s else [] for k, s in zip(ids, some, strict=True)]
    words = list(intern)
    kept = [k[kept_words(len(k), r)] if r else k for k, r in zip(ids, runs, strict=True)]
    return runs, [b" ".join([words[i] for i in k.tolist()]).decode("utf-8", "surrogatepass") for k in kept]


def drop_periodic(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words, by start, then period) and ``collapsed``, the text without repeats.

    A run is a stretch of words with smallest period q, ``LEAST_TIMES`` q or more and ``LEAST_WORDS`` words or more long, that no
    neighbouring word extends. A word goes if a run contains it after the run's first q words. Null and empty texts have no runs and an empty
    result; repeated rows come back as often as they came; an empty table gives no rows. One pass over the rows, no shuffle; a
    task holds about a megabyte of texts at a time, or one text if that is longer.
    """

    @F.arrow_udf(_KIND)
    def scan(texts: pa.Array) -> pa.Array:
        runs: list[list[Run]] = []
        flat = []
        for _, _, values in slices(texts):
            found, kept = collapse(values)
            runs += found
            flat.append(pa.array(kept, pa.string()))
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        one = pa.StructArray.from_arrays([pa.array([r[k] for rs in runs for r in rs], pa.int64()) for k in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), one), pa.concat_arrays(flat) if flat else pa.array([], pa.string())], ["runs", "collapsed"])

    return docs.withColumn("_scan", scan(F.col(text))).select(*docs.columns, F.col("_scan.runs").alias("runs"), F.col("_scan.collapsed").alias("collapsed"))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its words from a place on replaced by repeats of those that begin there."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    root = F.slice(words, a + 1, p)
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(planted, " ")).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: first start, then period; nulls if there is none) and digests of all runs and of
    the collapsed text, after planting; a null doc_id plants nothing."""
    planted = docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    d = drop_periodic(planted).withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    n = F.size("runs").cast("long")
    return d.select(
        "doc_id", n.alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(n > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
