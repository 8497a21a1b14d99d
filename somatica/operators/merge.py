"""Keyed merges: key normalisation, first and last wins, left merges into master sheets, misses, ragged unions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``. (Pass descending orders for "last wins".)"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def largest_mask_per_cell(masks: DataFrame) -> DataFrame:
    """The largest mask of each (image_name, soma_id), by file name on ties. Prune by this before reading any pixels."""
    return first_per_key(masks, ["image_name", "soma_id"], [F.col("area").desc(), F.col("filename").asc()])


def left_merge(master: DataFrame, keys: dict[str, Column], rows: DataFrame, row_keys: dict[str, Column], values: list[str], order: list[Column]) -> DataFrame:
    """``master`` with ``values`` of the row of ``rows`` under the same normalised keys; the last in ``order`` wins.

    A column of that name in ``master`` is replaced, by null where nothing matches. ``matched`` tells which rows did.
    """
    names = list(keys)
    right = rows.select(*[c.alias(f"_k_{k}") for k, c in row_keys.items()], *values, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    right = first_per_key(right, [f"_k_{k}" for k in names], [F.col(f"_o{i}").desc() for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    left = master.drop(*values, "matched").withColumns({f"_l_{k}": c for k, c in keys.items()})
    same = functools.reduce(lambda a, b: a & b, [F.col(f"_l_{k}") == F.col(f"_k_{k}") for k in names])
    out = left.join(right.withColumn("matched", F.lit(True)), same, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return out.drop(*[f"_l_{k}" for k in names], *[f"_k_{k}" for k in names])


def pick_column(columns: list[str], candidates: tuple[str, ...], explicit: str | None = None) -> str | None:
    """The explicit name, else the first candidate that is a column whatever its case, else None."""
    if explicit is not None:
        return explicit if explicit in columns else None
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[c] for c in candidates if c in lower), None)


def with_metadata(results: DataFrame, images: DataFrame, result_stem: Column, image_stem: Column, order: list[Column]) -> DataFrame:
    """``results`` with animal_id and treatment of the first image of the same stem, empty strings where there is none."""
    meta = first_per_key(images.withColumn("_stem", image_stem), ["_stem"], order).select("_stem", "animal_id", "treatment")
    out = results.drop("animal_id", "treatment").withColumn("_key", result_stem).join(meta, F.col("_key") == F.col("_stem"), "left").drop("_key", "_stem")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("animal_id", "treatment")})


def with_soma_position(results: DataFrame, somas: DataFrame) -> DataFrame:
    """``results`` with row and col of the soma at (image_name, soma_idx); (0, 0) where there is none."""
    at = somas.select("image_name", "soma_idx", "row", "col")
    return results.drop("row", "col").join(at, ["image_name", "soma_idx"], "left").na.fill(0, ["row", "col"])


def ranked_match(left: DataFrame, right: DataFrame, rules: list[Column], keys: list[str], order: list[Column]) -> DataFrame:
    """For each row of ``left`` (named by ``keys``) the row of ``right`` under the first rule that finds one; left join.

    Every rule is an equality and joins on its own, so no rule compares all pairs.
    """
    found = None
    for rank, rule in enumerate(rules):
        hits = left.join(right, rule).select(*keys, *[F.col(c) for c in right.columns], F.lit(rank).alias("match_rank"))
        found = hits if found is None else found.unionByName(hits)
    best = first_per_key(found, keys, [F.col("match_rank"), *order])
    return left.join(best, keys, "left")


def split_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` that have a partner, joined with it, and those that have none."""
    return left.join(right, keys), left.join(right, keys, "left_anti")


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Union of frames with different columns; what a frame lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def totals(df: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """Rows and sums per group, with a grand total under a null group."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def status_histogram(images: DataFrame) -> DataFrame:
    """Number of selected images of each status."""
    return images.where("selected").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def incomplete_metadata(images: DataFrame) -> DataFrame:
    """Images without an animal or a treatment."""
    return images.where((F.coalesce("animal_id", F.lit("")) == "") | (F.coalesce("treatment", F.lit("")) == ""))
