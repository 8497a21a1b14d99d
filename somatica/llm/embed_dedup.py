"""Embedding near-duplicates: cross-polytope hashes after fast Hadamard rotations, probed buckets, verified pairs."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import connected_components, materialise


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def signs(width: int, tables: int, hashes: int) -> np.ndarray:
    """Random signs of the three flips of each rotation: tables x hashes x 3 x width."""
    return np.random.default_rng(977).choice([-1.0, 1.0], (tables, hashes, 3, width))


def codes(x: np.ndarray, flips: np.ndarray, probes: int) -> np.ndarray:
    """Bucket codes of unit vectors: rows x tables x (1 + probes); the first is a vector's own, the rest it also looks in.

    A rotation is three rounds of random flips and Hadamard transforms; its hash is the largest coordinate with its sign.
    A table joins ``hashes`` of them. The probes replace one hash by its runner-up, smallest loss first.
    """
    tables, hashes, _, width = flips.shape
    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    base = 2 * width
    for t in range(tables):
        best, second, loss = [], [], []
        for h in range(hashes):
            y = wide
            for r in range(3):
                y = hadamard(y * flips[t, h, r])
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2] if width > 2 else np.argsort(-size, axis=1)[:, :2]
            pair = np.take_along_axis(size, top, 1)
            swap = pair[:, 0] < pair[:, 1]
            top[swap] = top[swap][:, ::-1]
            pair[swap] = pair[swap][:, ::-1]
            named = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best.append(named[:, 0])
            second.append(named[:, 1])
            loss.append(pair[:, 0] - pair[:, 1])
        place = [base**h for h in range(hashes)]
        own = sum(b * p for b, p in zip(best, place, strict=True))
        out[:, t, 0] = own
        order = np.argsort(np.stack(loss, 1), axis=1)
        moved = np.stack([own + (s - b) * p for b, s, p in zip(best, second, place, strict=True)], 1)
        for k in range(probes):
            out[:, t, 1 + k] = moved[np.arange(len(x)), order[:, k]]
    return out


@functools.cache
def tables_for(width: int, hashes: int, probes: int, cosine: float, recall: float) -> int:
    """Tables needed so that a pair exactly at ``cosine`` meets with probability ``recall``, from a fixed simulation."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    flips = signs(width, 1, hashes)
    ca, cb = codes(a, flips, probes)[:, 0], codes(b, flips, probes)[:, 0]
    p = ((ca[:, :1] == cb).any(1) | (cb[:, :1] == ca).any(1)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 0.999))))


def _coded(flips: np.ndarray, probes: int):
    """(id, label, n, vector) with the vector's codes, those of one table after those of another."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = np.array(part.column(3).to_pylist(), np.float64)
                c = codes(x / np.linalg.norm(x, axis=1, keepdims=True), flips, probes)
                flat = pa.array(list(c.reshape(len(x), -1)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], ["id", "label", "n", "vector", "codes"])

    return run


def _meet(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """For pairs, the table in which they meet first and the smallest shared bucket there, as one number per pair."""
    own_a, own_b = codes_a[:, :, :1], codes_b[:, :, :1]
    hit_a = (own_a == codes_b).any(2)  # in a's own bucket
    hit_b = (own_b == codes_a).any(2)
    met = hit_a | hit_b
    t = met.argmax(1)
    i = np.arange(len(t))
    far = np.iinfo(np.int64).max
    code = np.minimum(np.where(hit_a[i, t], codes_a[i, t, 0], far), np.where(hit_b[i, t], codes_b[i, t, 0], far))
    return np.stack((t, code), 1)


def _verified(cosine: float, tables: int, many: int, block: int = 1024):
    """Rows of one group to counts of the links that meet here first, and edges of a spanning forest of them.

    Output rows: a (id), b (another id linked with a, or null), links (rows linked with a that are counted here).
    """

    def run(key, table):
        t, code, ca, cb = (key[i].as_py() for i in (1, 2, 3, 4))
        ids, n, probe, own = (table.column(c).to_numpy() for c in ("id", "n", "probe", "chunk"))
        x = np.array(table.column("vector").to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = np.array(table.column("codes").to_pylist(), np.int64).reshape(len(x), tables, many)
        links, edges = np.zeros(len(x), np.int64), []
        left, right = np.flatnonzero((own == ca)), np.flatnonzero((own == cb))
        for s in range(0, len(left), block):
            a_rows = left[s : s + block]
            near = x[a_rows] @ x[right].T >= cosine
            i, j = np.nonzero(near)
            a, b = a_rows[i], right[j]
            keep = (ids[a] != ids[b]) & ~(probe[a] & probe[b])
            if ca == cb:
                keep &= a < b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            for u in range(0, len(a), 100_000):
                p, q = a[u : u + 100_000], b[u : u + 100_000]
                here = (_meet(c[p], c[q]) == (t, code)).all(1)
                p, q = p[here], q[here]
                links += np.bincount(p, n[q], len(x)).astype(np.int64) + np.bincount(q, n[p], len(x)).astype(np.int64)
                edges.append(_forest(p, q, len(x)))
        at = np.flatnonzero(links)
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        e = e[_forest_index(e, len(x))] if len(e) else e
        return pa.table({"a": pa.array(np.concatenate((ids[at], ids[e[:, 0]]))), "b": pa.array([None] * len(at) + ids[e[:, 1]].tolist(), pa.int64()), "links": pa.array(np.concatenate((links[at], np.zeros(len(e), np.int64))))})

    return run


def _forest_index(pairs: np.ndarray, n: int) -> np.ndarray:
    """Indices of the pairs that make up a spanning forest (union-find)."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    keep = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            keep.append(k)
    return np.array(keep, np.int64)


def _forest(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """A few of the pairs that connect the same rows: a first link for each row, then what else joins trees."""
    pairs = np.stack((p, q), 1)
    return pairs[_forest_index(pairs, n)] if len(pairs) else pairs


def embedding_components(vectors: DataFrame, cosine: float = 0.93, probes: int = 1, recall: float = 0.99, bucket: int = 512, chunk: int = 1024) -> DataFrame:
    """Links between vectors of equal label with a cosine (double precision) of ``cosine`` or more, and their components.

    ``vectors``: vec_id, embedding, label. Equal vectors of a label are one class. Each class goes to its own bucket and
    ``probes`` neighbouring ones in every table; the number of tables is set by simulation so that a pair just at the threshold meets
    with probability ``recall``, and the hashes per table by the size of the largest label, so that buckets stay
    near ``bucket`` classes. A bucket of over ``chunk`` classes is cut, and every pair of pieces is a group. Groups check
    the true cosines and return counts and forests, never all pairs; a pair counts only where it meets first.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id is the
    component_id), one row per row of ``vectors``. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or vec_id, link with nothing (component_id is then their own id). Vectors of
    different widths do not link; over 1000 different widths raise ValueError. Rows that share a vec_id are one node but counted singly. An empty table gives no
    rows; other columns are ignored.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.cast("array<double>").alias("embedding"), sound.alias("sound"))
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label"), "width": F.size("embedding")})
    good = rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("vector"), F.first("width").alias("width"))
    classes = materialise(good, "classes")
    shapes = classes.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("width").agg(F.max("n").alias("n")).orderBy("width").limit(1001).collect()
    if len(shapes) > 1000:
        raise ValueError("more than 1000 different widths")
    found, single = None, vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    for width, largest in ((r["width"], r["n"]) for r in shapes):
        wide = max(2, 1 << (width - 1).bit_length())
        hashes = max(1, math.ceil(math.log(max(largest / bucket, 1)) / math.log(2 * wide)))
        tables = tables_for(wide, hashes, probes, cosine, recall)
        flips = signs(wide, tables, hashes)
        kind = classes.schema["label"].dataType.simpleString()
        vector = "array<float>" if single else "array<double>"
        own = classes.where(F.col("width") == width).select("id", "label", "n", F.col("vector").cast(vector).alias("vector"))
        own = materialise(own.mapInArrow(_coded(flips, probes), f"id long, label {kind}, n long, vector {vector}, codes array<long>"), "codes")
        key = ["label", "t", "code"]
        place = {"t": F.floor(F.col("at") / (1 + probes)).cast("int"), "probe": F.col("at") % (1 + probes) > 0}
        sizes = own.select("label", F.posexplode("codes").alias("at", "code")).withColumns(place).groupBy(*key).agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        b = own.select("*", F.posexplode("codes").alias("at", "code")).withColumns(place).drop("at")
        b = b.join(sizes, key).withColumn("pieces", F.ceil(F.col("many") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        b = b.withColumns({"ca": F.least("chunk", "other"), "cb": F.greatest("chunk", "other")})
        links = b.groupBy(*key, "ca", "cb").applyInArrow(_verified(cosine, tables, 1 + probes), "a long, b long, links long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("n").alias("links")).limit(0)
    found = materialise(found, "links")
    labels = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    classes = classes.select("h1", "h2", "id", "n").join(labels, "id", "left").join(counts, "id", "left")
    classes = classes.select("h1", "h2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "id").alias("component_id"))
    out = rows.select("vec_id", "sound", "h1", "h2").join(classes, ["h1", "h2"], "left")
    out = out.select("vec_id", F.when(F.col("sound"), F.col("links") + F.col("n") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
