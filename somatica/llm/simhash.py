"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distances."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import connected_components, materialise, whole_rows

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_bytes(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number; 0 where it has no word."""
    words = text.translate(_LOWER).split()  # bytes.split cuts at \x20 and \x09-\x0d only
    if not words:
        return 0
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    xxh = xxhash.xxh64_intdigest
    h = np.fromiter((xxh(line[s:e], 42) for s, e in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint_udf(shingle: int = 4):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_bytes(t.as_py(), shingle) if t.is_valid else 0 for t in texts.cast(pa.binary())], pa.int64())

    return fingerprint


def block_masks(bits: int, blocks: int, distance: int) -> list[int]:
    """Masks of every choice of ``blocks - distance`` of the blocks, as signed 64-bit numbers.

    Two fingerprints at most ``distance`` bits apart differ in at most that many blocks, so they agree under some mask.
    """
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    masks = (sum(c) for c in itertools.combinations(one, blocks - distance))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n: int, distance: int) -> int:
    """Number of blocks: enough masked bits that ``n`` random fingerprints rarely share a key; exact in every case."""
    blocks = distance + 2
    while (blocks - distance) * 64 // blocks < min(n, 1 << 40).bit_length() + 2 and blocks < distance + 6:
        blocks += 1
    return blocks


def forest(points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as indices) of a spanning forest of the points that are within ``distance`` bits of each other."""
    if len(points) == 2:
        ok = int(points[0] ^ points[1]).bit_count() <= distance
        return np.arange(ok), np.arange(1, 1 + ok)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= distance
    np.fill_diagonal(near, False)
    left, right, new = [], [], near.any(axis=1)
    while new.any():
        front = np.array([int(new.argmax())])
        new[front] = False
        while len(front):
            hit = near[front] & new
            found = np.flatnonzero(hit.any(axis=0))
            left.append(front[hit[:, found].argmax(axis=0)])
            right.append(found)
            new[found] = False
            front = found
    return (np.concatenate(left), np.concatenate(right)) if left else (np.arange(0), np.arange(0))


def _links(distance: int):
    """Arrow batches sorted by (mask, key, ca, cb) to spanning-forest edges of each run."""

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            cols = None if batch is None else [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                cols = rest if cols is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            change = np.zeros(len(cols[0]), bool)
            change[0] = True
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(change)
            if batch is not None:  # the last run may go on in the next batch
                rest, cols = [c[first[-1] :] for c in cols], [c[: first[-1]] for c in cols]
                first = first[:-1]
            size = np.diff(np.append(first, len(cols[0])))
            f = cols[4].view(np.uint64)
            two = first[size == 2]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= distance]
            a, b = [f[two]], [f[two + 1]]
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                group = np.unique(f[s : s + n])
                x, y = forest(group, distance)
                a.append(group[x])
                b.append(group[y])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], ["a", "b"])

    return run


def near_pairs(points: DataFrame, distance: int = 4, chunk: int = 512) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct 64-bit values ``f`` just as all pairs within ``distance`` bits do.

    Every value goes to one bucket per choice of agreeing blocks. A bucket over ``chunk`` values is cut into chunks
    and each pair of chunks becomes its own group, so the largest group stays bounded. A group returns a spanning
    forest of its verified links, never all its pairs.
    """
    n = points.count()
    masks = block_masks(64, blocks_for(n, distance), distance)
    keyed = points.select("f", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("f", "k.mask", "k.key")
    count = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = keyed.join(count, ["mask", "key"]).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("mask", "key", F.least("own", "other").alias("ca"), F.greatest("own", "other").alias("cb"), "f")
    dealt = dealt.repartition("mask", "key", "ca", "cb").sortWithinPartitions("mask", "key", "ca", "cb")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def _classes(docs: DataFrame, distance: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprint ``f`` of each document (doc_id, text_hash), and each fingerprint's ``label`` and number of ``copies``.

    Both are written tables: a fingerprint that very many documents share is joined as a plain equi-join, which can be split.
    """
    prints = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_udf(shingle)(F.col("text")).alias("f")), "prints")
    nodes = materialise(prints.groupBy("f").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "nodes")
    labels = connected_components(near_pairs(nodes.select("f"), distance)).select(F.col("node").alias("f"), "label")
    return prints, materialise(nodes.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f")), "labelled")


def simhash_components(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """Near-duplicate classes of whole texts.

    Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0d`` of the text with A-Z lower-cased; a bit of the
    fingerprint is 1 where over half of the XXH64 (seed 42) of the ``shingle``-word shingles, repeats included, have it.
    Fingerprints at ``distance`` or fewer differing bits link.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), copies (rows with the same
    fingerprint). Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id takes part
    and gets the class's smallest id, null if the class has no other; repeated rows come back as often as they came.
    An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    prints, nodes = _classes(docs, distance, shingle)
    low = nodes.groupBy("label").agg(F.min("low").alias("component_id"))
    nodes = materialise(nodes.join(low, "label").select("f", "copies", "component_id"), "components")
    return prints.join(nodes, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def simhash_dedup(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns kept.

    The document with the smallest doc_id stays (ids that are null come last; of equal ids, the one with the smaller hash
    of the text). Of rows that share doc_id and text one stays. Null, empty and blank texts are one class. An empty table gives
    no rows; names of other columns do not matter.
    """
    prints, nodes = _classes(docs, distance, shingle)
    return first_of_class(docs, prints, nodes)


def first_of_class(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents that ``simhash_dedup`` keeps, given ``prints`` (doc_id, text_hash, f) and ``nodes`` (f, label)."""
    named = prints.join(nodes.select("f", "label"), "f").groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows")).alias("k")
    kept = materialise(named.groupBy("label").agg(first).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_h"), F.col("k.rows").alias("_rows")), "kept")
    d = whole_rows(docs).withColumns({"id": F.col("row.doc_id"), "h": F.xxhash64("row.text")})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    once = d.join(kept.where("_rows = 1"), same, "left_semi").select("row.*")
    again = d.join(kept.where("_rows > 1"), same, "left_semi").dropDuplicates(["id", "h"]).select("row.*")
    return once.unionByName(again)
