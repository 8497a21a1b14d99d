"""Mixing sources to target weights by entropy balancing: tilted document rates, rounded into copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.llm.common import materialise, prefix_sums, whole_rows

#: Rows of one (source, size) cell that are ranked in one task.
_RANKED = 1_000


def words():
    """Number of runs of bytes other than ``\\x20 \\x09-\\x0d`` in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources. ``sizes``: source, source_size; one row per source.

    Sources by code point, null last, take the weights in turn and share ``share`` times the whole size by weight.
    None takes over ``most`` times its own size; what is over goes to the others by weight, until none is above.
    (Sorted by size per weight, the capped sources are a prefix, so the fixed point comes from prefix sums.)
    Returns source, source_size, target.
    """
    if share > most:
        raise ValueError("share exceeds what the sources may give")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(turn, (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(on)
    s = s.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def exact_sum(term):
    """Sum that does not depend on the order of the rows, so that reruns agree to the last bit."""
    return F.sum(term.cast("decimal(38,6)")).cast("double")


def balance(cells: DataFrame, targets: DataFrame, most: float = 2.0, rounds: int = 60, close: float = 1e-7) -> DataFrame:
    """Tilt of each source: ``source``, ``tilt``.

    ``cells``: source, size, n (documents of that size). Among rates between 0 and ``most`` whose words meet the
    target, those of largest entropy are ``most / (1 + exp(-tilt * size / mean size))``: a rate r takes the share r / ``most`` of
    a document's possible copies and leaves the rest, and maximising the sum of both shares' entropies under the one
    constraint sum(size * r) = target gives log(r / (most - r)) = tilt * size: exponential tilting of the odds, since
    rates are bounded on both sides (for small rates it is the plain exponential tilt). ``tilt`` solves the source's convex dual. Each round is one Spark job over the cells: per-source sums of the
    gradient and the curvature, then a Newton step for every source, halved into the bracket where it would leave it.
    A source at its cap has no finite tilt; its row holds the largest double.
    """
    means = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    state = means.join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = state.select("source", "total", (F.col("total") / F.col("docs")).alias("mean"), "target", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = state.withColumn("capped", (F.col("total") == 0) | (F.col("target") >= F.col("total") * F.lit(float(most)) * (1 - 1e-12)))
    state = materialise(state.withColumn("off", F.when(F.col("capped"), 0.0).otherwise(1.0)), "tilts")
    cells = cells.where("size > 0")
    for _ in range(rounds):
        here = cells.withColumnRenamed("source", "_s").join(state.where(F.col("off") > close), F.col("_s").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("mean")
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("tilt") * x, F.lit(700.0)), F.lit(-700.0))))
        sums = here.groupBy("_s").agg(exact_sum(F.col("n") * F.col("size") * p * F.lit(float(most))).alias("got"), exact_sum(F.col("n") * F.col("size") * x * p * (1 - p) * F.lit(float(most))).alias("slope"))
        s = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("got") - F.col("target")
        s = s.withColumn("low", F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        s = s.withColumn("off", F.when(F.col("got").isNull(), F.col("off")).otherwise(F.abs(gap) / F.greatest("target", F.lit(1.0))))
        s = s.withColumn("tilt", F.when(F.col("got").isNull() | (F.col("off") <= close), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialise(s.drop("got", "slope"), "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= close:
            break
    return state.select("source", "mean", F.when(F.col("capped"), F.lit(1.7976931348623157e308)).otherwise(F.col("tilt")).alias("tilt"))


def _dealer(most: int):
    """Whole copies for the sizes of one source, one row per size: from the largest down, the words given follow the words
    that the rates want, so that what is over or short at the end is about half of the smallest document."""

    def deal(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        wanted = given = 0.0
        give = []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            wanted += size * n * rate
            k = min(max(round((wanted - given) / size), 0), most * n) if size else 0
            given += k * size
            give.append(k)
        return cells.assign(_give=np.array(give, np.int64))

    return deal


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often each document of ``docs`` goes into the mix.

    Returns doc_id, text_hash (with doc_id it names the row), size (words), source, source_size, target (of the source),
    rate (tilted, 0 to ``most``), copies and taken (copies * size). Copies are whole: a source's sizes are rounded one after
    the other with what is over carried on, and the copies a size gets are dealt to its documents by hash, so that the
    words taken miss the target by less than a small document and reruns agree. (A task sees one row for each size that
    occurs in a source, whatever the number of documents.)
    A null source is a source of its own, last in order; null and blank texts have size 0 and take 0 words. Rows that
    share doc_id and text are dealt in turn. An empty table gives no rows; other columns are ignored.
    """
    rows = materialise(docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    cells = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, float(most)), "targets")
    tilts = balance(cells, targets, float(most))
    known = tilts.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    full = F.col("tilt") >= 1e308
    x = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(700.0))
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(most)).otherwise(most / (1 + F.exp(-F.greatest(x, F.lit(-700.0)))))
    c = cells.withColumnRenamed("source", "_s").join(known, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumn("rate", rate)
    dealt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema) + ", _give long"
    c = c.groupBy("source").applyInPandas(_dealer(most), dealt).withColumn("_parts", F.ceil(F.col("n") / _RANKED))
    c = c.select("source", "size", "n", "source_size", "target", "rate", "_parts", F.floor(F.col("_give") / F.col("n")).alias("_each"), (F.col("_give") % F.col("n")).alias("_extra"))
    c = materialise(c, "copies")
    key = ["source", "size"]
    named = c.select(F.col("source").alias("_s"), F.col("size").alias("_z"), *[x for x in c.columns if x not in key])
    d = rows.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    d = d.withColumn("_h", F.xxhash64("doc_id", "text_hash", F.lit(11))).withColumn("_part", F.when(F.col("_parts") > 1, F.pmod("_h", "_parts")).otherwise(F.lit(0)))
    some = (F.col("_extra") > 0) & (F.col("_parts") > 1)
    parts = d.where(some).groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_m"), F.first("_extra").alias("_x"), F.first("n").alias("_n"))
    parts = prefix_sums(parts, key, "_part", "_m", "_done")
    quota = F.floor((F.col("_done") + F.col("_m")) * F.col("_x") / F.col("_n")) - F.floor(F.col("_done") * F.col("_x") / F.col("_n"))
    parts = parts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"), quota.alias("_quota"))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_part") == F.col("_p")), "left")
    turn = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_h", "doc_id", "text_hash"))
    copies = F.col("_each") + (turn <= F.coalesce("_quota", "_extra")).cast("long")
    d = d.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return d.select("doc_id", "text_hash", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns and texts stay as they are.

    Exactly the copies that ``mix`` decides. Rows that share doc_id, text and source are counted together and take their
    copies in turn: each as many as the next, give or take one; rows that are alike in all columns are never gathered,
    only counted. Null and blank texts take no words and are left out; null sources and ids are kept as such; an empty
    table gives no rows.
    """
    took = mix(docs, **how).where("copies > 0").groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("_sum"))
    took = materialise(took.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"), F.col("source").alias("_s"), "_sum"), "taken")
    every = mix_keys(docs).groupBy("id", "h", "source").agg(F.count(F.lit(1)).alias("_rows"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))
    took = materialise(every.join(took, same).select("_id", "_t", "_s", "_sum", "_rows"), "shares")
    d = mix_keys(docs).join(took, same)
    once = d.where("_rows = 1").select("row", F.col("_sum").alias("times"))
    kinds = d.where("_rows > 1").groupBy("id", "h", "source", F.xxhash64("row").alias("v")).agg(F.first("row").alias("row"), F.first("_sum").alias("_sum"), F.first("_rows").alias("_rows"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "h", "source").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each, extra = F.floor(F.col("_sum") / F.col("_rows")), F.col("_sum") % F.col("_rows")
    times = F.col("n") * each + F.greatest(F.lit(0), F.least(extra - before, F.col("n")))
    like = kinds.select("row", times.cast("long").alias("times"))
    return once.unionByName(like).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def mix_keys(docs: DataFrame) -> DataFrame:
    """``docs`` as column ``row`` with what names a document in the mix: id, h (hash of the text), source."""
    return whole_rows(docs).withColumns({"id": F.col("row.doc_id"), "h": F.xxhash64("row.text"), "source": F.col("row.source")})
