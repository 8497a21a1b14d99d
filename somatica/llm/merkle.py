"""Merkle manifest of a dataset: a tree over the rows of each group, one over the groups, and a proof for every row.

Large blocks of leaves are reduced by tasks, in rounds, until few nodes are left. The driver builds the trees over those,
their paths go back to the tasks by a broadcast join, and the tasks finish the proofs inside their blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatica.llm.common import materialise

#: Children of a node, and levels that one task reduces at once (a block has FAN ** LEVELS leaves at most).
FAN, LEVELS = 3, 6
#: Nodes that the driver takes at most (about 2 MB); with more, another round of blocks is reduced by tasks.
MOST_TOP = 8_192
#: One step of a proof: digests of the siblings before and after the node, joined.
_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_PATH_SQL = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Digest of a row: of each value its UTF-8 byte count, ``:`` and the value; ``-`` where it is null."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def fold(start: Column, path: Column) -> Column:
    """Digest that a proof leads to from the leaf ``start``."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the number of rows of the same ``tree``, and ``pos``, their place by ``order`` from 0 (nulls first).

    Rows are dealt by ranges of tree and order, so a tree with most of the rows fills many tasks; each task numbers its own, and the
    counts of (task, tree) give what stands before. No task holds more than its range.
    """
    by = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    spread = materialise(spread, "ranked").withColumn("_part", F.shiftright("_id", 33))
    parts = spread.groupBy(F.col("_part").alias("_p"), F.col(tree).alias("_tree")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_p", "_tree", (F.col("_first") - before).alias("_base"), F.sum("_n").over(whole).alias("n"))
    same = (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_tree"))
    return spread.join(parts, same).select(*rows.columns, "n", (F.col("_id") - F.col("_base")).alias("pos"))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(leaves: list[str], levels: int) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """The nodes ``levels`` above ``leaves``, and the siblings (before, after) of every leaf on the way."""
    rows, steps = leaves, []
    for _ in range(levels):
        groups = [rows[i : i + FAN] for i in range(0, len(rows), FAN)]
        steps.append([("".join(g[:k]), "".join(g[k + 1 :])) for g in groups for k in range(len(g))])
        rows = [digest(*g) for g in groups]
    return rows, [[steps[lv][i // FAN**lv] for lv in range(levels)] for i in range(len(leaves))]


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _blocks(batches):
    """Whole blocks of rows that come in order of tree and pos: runs of rows up to the next ``pos`` that begins a block."""
    import numpy as np

    size, kept = FAN**LEVELS, None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        starts = np.flatnonzero(t["pos"].to_numpy() % size == 0).tolist()
        for i, j in zip(starts, starts[1:], strict=False):
            yield t.slice(i, j - i)
        kept = t.slice(starts[-1]) if starts else t
    if kept is not None and kept.num_rows:
        yield kept


def _dealt(nodes: DataFrame) -> DataFrame:
    block = F.floor(F.col("pos") / FAN**LEVELS)
    return nodes.withColumn("_block", block).repartition("tree", "_block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "pos").drop("_block")


def _gathered(tables, schema: pa.Schema, rows: int = 20_000):
    """Tables joined to batches of about ``rows`` rows."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.concat_tables(held).cast(schema).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.concat_tables(held).cast(schema).combine_chunks().to_batches()


def tops(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, n, pos, digest) that stand ``LEVELS`` above the given ones, or at the top of their tree if that is lower."""
    kind = T.StructType([nodes.schema["tree"], T.StructField("n", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches):
        size, fields = FAN**LEVELS, None

        def each():
            nonlocal fields
            for t in _blocks(batches):
                n = t["n"][0].as_py()
                up = min(LEVELS, height(n))
                top, _ = grown(t["digest"].to_pylist(), up)
                fields = fields or pa.schema([t.schema.field("tree"), pa.field("n", pa.int64()), pa.field("pos", pa.int64()), pa.field("digest", pa.string())])
                yield pa.table([t["tree"].slice(0, 1), pa.array([-(-n // size)]), pa.array([t["pos"][0].as_py() // size]), pa.array(top)], schema=fields)

        for table in each():
            yield from table.to_batches()

    return _dealt(nodes.select("tree", "n", "pos", "digest")).mapInArrow(run, kind)


def inner_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: the siblings of each node below the top of its block."""
    kind = T.StructType([*nodes.schema.fields, T.StructField("path", _PATH)])

    def run(batches):
        def each():
            for t in _blocks(batches):
                _, paths = grown(t["digest"].to_pylist(), min(LEVELS, height(t["n"][0].as_py())))
                ends = [0]
                for p in paths:
                    ends.append(ends[-1] + len(p))
                steps = pa.StructArray.from_arrays([pa.array([s[k] for p in paths for s in p], pa.string()) for k in (0, 1)], ["left", "right"])
                yield t.append_column("path", pa.chunked_array([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]))

        for table in each():
            yield from table.combine_chunks().to_batches()

    return _dealt(nodes).mapInArrow(run, kind)


def _top_trees(nodes: DataFrame) -> DataFrame:
    """Paths to the tops of all trees, built by the driver from ``MOST_TOP`` nodes at most."""
    kind = T.StructType([nodes.schema["tree"], T.StructField("pos", T.LongType()), T.StructField("path", _PATH), T.StructField("top", T.StringType())])
    trees: dict = {}
    for r in nodes.select("tree", "pos", "digest").collect():
        trees.setdefault(r["tree"], []).append((r["pos"], r["digest"]))
    rows = []
    for tree, found in trees.items():
        found.sort()
        top, paths = grown([d for _, d in found], height(len(found)))
        rows += [(tree, pos, path, top[0]) for (pos, _), path in zip(found, paths, strict=True)]
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, kind))


def climbed(nodes: DataFrame, most: int = MOST_TOP) -> DataFrame:
    """``nodes`` (tree, n, pos, digest and others; a written table or a cheap plan over one) with ``path``, the siblings on the
    way to the top of its tree, and ``top``, the digest there."""
    own = nodes.select("tree", "n", "pos", "digest")
    known = own.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).first()
    if (known["n"] or 0) <= 1:
        return nodes.select("*", F.array().cast(_PATH_SQL).alias("path"), F.col("digest").alias("top"))
    if known["rows"] <= most:
        upper, inner, at = _top_trees(own), nodes.withColumn("path", F.array().cast(_PATH_SQL)), F.col("pos")
    else:
        level = materialise(tops(own), "tops")
        upper = climbed(level, most).select("tree", "pos", "path", "top")
        if known["rows"] > most * FAN**LEVELS:
            upper = materialise(upper, "upper-paths")
        elif level.count() <= most:
            upper = F.broadcast(upper)
        inner, at = inner_paths(nodes), F.floor(F.col("pos") / FAN**LEVELS)
    upper = upper.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), "top")
    joined = inner.withColumn("_at", at).join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_at") == F.col("_pos")))
    return joined.select(*nodes.columns, F.concat("path", "_path").alias("path"), "top")


def manifest(leaves: DataFrame, most: int = MOST_TOP) -> DataFrame:
    """Proof of every leaf of a dataset.

    ``leaves``: tree (the group of the row, of any type with an order; null is a group, the first), key (its order within the group), leaf
    (hex digest) and other columns. Rows with the same key follow each other by leaf, so repeated rows have a proof each and reruns agree;
    null keys come first. Returns the rows with ``pos`` (place in the group), ``path`` (siblings before and after the node on
    each level, from the leaf to the root), ``subroot`` and ``root``. A group of one row is its own subroot; one group alone
    is the root; an empty table gives no rows.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "key", "leaf")]
    rows = leaves.select("tree", "key", F.col("leaf").alias("digest"), F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("_")]).alias("rest"))
    proven = climbed(ranked(rows, "tree", ["key", "digest"]), most)
    first = proven.where("pos = 0").select(F.col("tree").alias("group"), F.col("top").alias("digest")).withColumn("tree", F.lit(0))
    groups = climbed(ranked(materialise(first, "subroots"), "tree", ["group"]), most)
    groups = materialise(groups.select(F.col("group").alias("_group"), F.col("path").alias("_up"), F.col("top").alias("root")), "group-paths")
    out = proven.join(groups, F.col("tree").eqNullSafe(F.col("_group")))
    return out.select("tree", "key", F.col("digest").alias("leaf"), *[F.col("rest")[c].alias(c) for c in rest], "pos", F.concat("path", "_up").alias("path"), F.col("top").alias("subroot"), "root")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by source: tree, key (doc_id), leaf over doc_id, source, lang, n_chars and text; other columns are
    ignored. ``changed`` is the leaf after tampering where 2 divides the CRC-32 of doc_id and the text has a line feed, else null."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(*own, F.col("text")).alias("leaf"), F.when(hit, leaf(*own, F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))


def proof_digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, else the own one) and verified.

    Nulls in any column have a mark of their own in the leaf; a null doc_id is never tampered with. An empty text differs from a null
    one. Repeated rows come back as often as they came; an empty table gives no rows.
    """
    proven = manifest(document_leaves(docs))
    out = proven.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
