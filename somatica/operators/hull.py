"""Convex hulls of regions and what is measured on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators import batches, regions


def vertices(mask: DataFrame, pixel_corners: bool = False) -> DataFrame:
    """Corners of each image's convex hull over pixel centres, or the corners of pixels: image, seq, y, x, counter-clockwise.

    Only the outermost pixels of each row reach the per-image group (two per row at most).
    """
    ends = mask.groupBy("image", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    if pixel_corners:
        ends = ends.select("image", F.explode(F.array("y", F.col("y") + 1)).alias("y"), "a", (F.col("b") + 1).alias("b"))

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        y, a, b = (batches.numbers(table, c).tolist() for c in ("y", "a", "b"))
        found, rows = [], []
        for i, j in batches.spans(table, starts):
            points = sorted({*zip(a[i:j], y[i:j], strict=True), *zip(b[i:j], y[i:j], strict=True)})
            out = half_hull(points)[:-1] + half_hull(points[::-1])[:-1] if len(points) > 1 else points
            found += [(k, p[1], p[0]) for k, p in enumerate(out)]
            rows += [i] * len(out)
        columns = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1, 2)]
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", np.array(rows, int)), *columns], ["image", "seq", "y", "x"])

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(ends.select("image", "y", "a", "b"), ["image"], run, f"image {kind}, seq int, y int, x int")


def half_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Lower hull of points in order, left turns only."""
    out: list[tuple[int, int]] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def measure(corners: DataFrame, mask: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Area, perimeter, circularity, density, largest span and width across it, and their ratio; none where the area is 0.

    Lengths and areas are in the unit of ``pixel_size``.
    """
    w = Window.partitionBy("image").orderBy("seq")
    c = corners.withColumns({"y2": F.coalesce(F.lead("y").over(w), F.first("y").over(w)), "x2": F.coalesce(F.lead("x").over(w), F.first("x").over(w))})
    m = c.groupBy("image").agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("hull_area"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("hull_perimeter"))
    a = corners.select("image", F.col("seq").alias("i"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = corners.select("image", F.col("seq").alias("j"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    far = a.join(b, "image").where("i < j").withColumn("d", F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")))
    far = far.groupBy("image").agg(F.max_by(F.struct("d", "ya", "xa", "yb", "xb"), F.struct("d", -F.col("i"), -F.col("j"))).alias("f"))
    across = (F.col("y") * (F.col("f.xb") - F.col("f.xa")) - F.col("x") * (F.col("f.yb") - F.col("f.ya"))) / F.col("f.d")
    width = corners.join(far, "image").groupBy("image").agg((F.max(across) - F.min(across)).alias("width"), F.max("f.d").alias("span"))
    n = mask.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    out = m.join(width, "image").join(n, "image").where("hull_area > 0")
    p2 = F.col("hull_perimeter") * F.col("hull_perimeter")
    scaled = [(F.col("hull_area") * pixel_size**2).alias("hull_area"), (F.col("hull_perimeter") * pixel_size).alias("hull_perimeter")]
    across_it = [(F.col(c) * pixel_size).alias(c) for c in ("span", "width")]
    return out.select("image", *scaled, (4 * math.pi * F.col("hull_area") / p2).alias("hull_circularity"), (F.col("n") / F.col("hull_area")).alias("density"), *across_it, F.when(F.col("width") > 0, F.col("span") / F.col("width")).alias("span_ratio"))


def mask_shapes(mask: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Shape set of each image's mask: area, perimeter, circularity, aspect ratio, roundness (4 area over pi times the squared
    major axis) and solidity (area over the hull's, both of whole pixels)."""
    w = Window.partitionBy("image").orderBy("seq")
    c = vertices(mask, pixel_corners=True).withColumns({"y2": F.coalesce(F.lead("y").over(w), F.first("y").over(w)), "x2": F.coalesce(F.lead("x").over(w), F.first("x").over(w))})
    area = c.groupBy("image").agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("_hull"))
    d = regions.descriptors(mask, pixel_size).join(area, "image")
    round_ = F.when(F.col("major") > 0, 4 * F.col("n_px") / (math.pi * F.col("major") * F.col("major"))).otherwise(0.0)
    return d.select("image", F.col("area_um2").alias("mask_area"), F.col("perimeter").alias("mask_perimeter"), F.col("circularity").alias("mask_circularity"), F.col("aspect_ratio").alias("mask_aspect_ratio"), round_.alias("mask_roundness"), (F.col("n_px") / F.col("_hull")).alias("mask_solidity"))
