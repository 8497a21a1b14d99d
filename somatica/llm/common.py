"""Helpers that several operators of this subpackage share: scratch tables, components, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where a local session has none (tests), one temporary folder per application. On a cluster it must be set: executors
    would write to their own disks, and what they wrote would be missing without a sign.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="somatica-")
    return _LOCAL_SCRATCH[app]


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared scratch folder and read it back.

    This cuts the lineage; a lost executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/somatica/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(column: pa.Array, most: int = 1_000_000):
    """Cuts an Arrow column of texts or byte strings into runs of about ``most`` bytes: first row, last row + 1, and the run's
    values as a list. So a task's Python objects stay few, whatever the size of Arrow's batches; unused memory is given back."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist() if len(block) else []
    for i, j in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield i, j, column.slice(i, j - i).to_pylist()
    pa.default_memory_pool().release_unused()


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names (points in them too)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole_rows(df: DataFrame) -> DataFrame:
    """``df`` as one column ``row``, so that helper columns beside it cannot clash with names in it (undo: ``row.*``)."""
    return df.select(F.struct("*").alias("row"))


def _edge_digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: columns ``a``, ``b`` (long), undirected; loops and repeats are fine. Returns ``node``, ``label``.
    Alternates large-star and small-star steps until the edge set is a set of stars.
    Each step aggregates per node (combined on the map side) and joins, so that a node
    with very many neighbours is never gathered in one task; every round ends in a written table.
    """
    e = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _edge_digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = materialise(small, "edges")
        now = _edge_digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` with a smaller ``order``.

    ``order`` is a non-negative long, unique within its keys. Two levels: sums of blocks of ``block`` consecutive
    orders, then the rows of a block. No task holds more than a block or the list of one key's blocks.
    """
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = b.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = b.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, same).select(*df.columns, (F.col("_own") + F.col("_base")).alias(out))


def bloom_bit(key: Column, seed: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(probe)), F.lit(bits))


def bit_words(at: DataFrame, bits: int) -> DataFrame:
    """One row: ``words``, an array of ``bits / 64`` longs in which the bits listed in ``at`` are set."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    word = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("set"))
    every = at.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(word, "w", "left")
    listed = F.array_sort(F.collect_list(F.struct("w", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    return every.agg(F.transform(listed, lambda x: x["set"]).alias("words"))


def bloom_words(keys: DataFrame, seed: int, probes: int, bits: int) -> DataFrame:
    """One row: the Bloom filter of ``keys`` (column ``key``) as ``words``, an array of ``bits / 64`` longs."""
    return bit_words(keys.select(F.explode(F.array(*[bloom_bit(F.col("key"), seed, i, bits) for i in range(probes)])).alias("at")), bits)


def bloom_passes(key: Column, words: Column, seed: int, probes: int, bits: int) -> Column:
    """Whether all probed bits of ``key`` are set in the filter ``words``."""
    out = F.lit(True)
    for i in range(probes):
        at = bloom_bit(key, seed, i, bits)
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        out = out & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0)
    return out


#: Bits of the largest Bloom filter that is sent to every task (8 MB).
MOST_BITS = 1 << 26


class KeyFilter:
    """Bloom filter of a written table of keys (column ``key``), bounded by ``MOST_BITS``, to tell rows apart before a join.

    A key of the table always passes; of other keys few do, until the filter is full. So it may thin out what a join has to
    move, and the join stays exact. The filter reaches the tasks as a scalar subquery of a written row.
    """

    def __init__(self, keys: DataFrame, each: int = 16, probes: int = 4, seed: int = 8):
        self.bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (each * keys.count()).bit_length()))
        self.seed, self.probes = seed, probes
        self.words = materialise(bloom_words(keys, seed, probes, self.bits), "key-filter")

    def passes(self, key: Column) -> Column:
        return bloom_passes(key, self.words.scalar(), self.seed, self.probes, self.bits)
