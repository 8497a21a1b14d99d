"""Shape of regions: pixels (``image, y, x``, one region per image) to one row of metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.operators.morphology import EIGHT, FOUR, neighbour_sums


def axes(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Major and minor axis of the ellipse with variances ``a`` (y), ``c`` (x) and covariance ``b``."""
    mid, half = (a + c) / 2, F.sqrt(4 * b * b + (a - c) * (a - c)) / 2
    return 4 * F.sqrt(F.greatest(mid + half, F.lit(0.0))), 4 * F.sqrt(F.greatest(mid - half, F.lit(0.0)))


#: Rows and columns (31 bits each) are packed into one whole number, so that extremes with ties need no struct and aggregate by hash.
_BITS = 31
_SPAN = 1 << _BITS


def _sums() -> list[Column]:
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    return [
        F.count(F.lit(1)).alias("n_px"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("_a"), F.covar_pop("y", "x").alias("_b"), F.var_pop("x").alias("_c"),
        F.min(y * _SPAN + x).alias("_top"), F.max(y * _SPAN + (_SPAN - 1 - x)).alias("_bottom"), F.min(x * _SPAN + y).alias("_left"), F.max(x * _SPAN + (_SPAN - 1 - y)).alias("_right"),
    ]


def _shape(m: DataFrame, pixel_size: float) -> DataFrame:
    major, minor = axes(F.col("_a"), F.col("_b"), F.col("_c"))
    m = m.withColumns({"major": major, "minor": minor})
    rho = F.when(F.col("major") > 0, F.col("minor") / F.col("major"))
    return m.withColumns({
        "area_um2": F.col("n_px") * (pixel_size * pixel_size),
        "eccentricity": F.coalesce(F.sqrt(F.greatest(1 - rho * rho, F.lit(0.0))), F.lit(0.0)),
        "roundness": F.coalesce(rho * rho, F.lit(0.0)),
        "aspect_ratio": F.when(F.col("minor") > 0, F.col("major") / F.col("minor")).otherwise(0.0),
    })


def _spread(pixel_size: float) -> Column:
    high, low = lambda c: F.shiftright(F.col(c), _BITS), lambda c: F.col(c).bitwiseAND(F.lit(_SPAN - 1))
    ends = [(high("_top"), low("_top")), (high("_bottom"), _SPAN - 1 - low("_bottom")), (low("_left"), high("_left")), (_SPAN - 1 - low("_right"), high("_right"))]
    return sum(F.hypot(y - F.col("cy"), x - F.col("cx")) for y, x in ends) / 4 * pixel_size


_HELPERS = ("_a", "_b", "_c", "_top", "_bottom", "_left", "_right")


def moments(mask: DataFrame, pixel_size: float) -> DataFrame:
    """Area, centroid, axes, eccentricity and roundness of each image's region; aspect_ratio as older tables have it."""
    return _shape(mask.groupBy("image").agg(*_sums()), pixel_size).drop(*_HELPERS)


def spread_from_centroid(mask: DataFrame, pixel_size: float) -> DataFrame:
    """Mean distance from the centroid to the top, bottom, left and right pixel (first in raster order on ties)."""
    return mask.groupBy("image").agg(*_sums()).select("image", _spread(pixel_size).alias("average_centroid_distance"))


def perimeter(mask: DataFrame, pixel_size: float) -> DataFrame:
    """Perimeter from the pattern of border pixels around each border pixel: straight 1, diagonal root 2, mixed their mean.

    A border pixel lacks one of its four neighbours. Its code is 1, plus 2 for each straight and 10 for each diagonal
    neighbour on the border. Two aggregations by pixel, one by image.
    """
    border = neighbour_sums(mask, [(o, 1) for o in FOUR]).where("s < 4")
    c = neighbour_sums(border, [(o, 2 if o in FOUR else 10) for o in EIGHT]).withColumn("code", F.col("s") + 1)
    weight = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), math.sqrt(2)).when(F.col("code").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return c.groupBy("image").agg((F.sum(weight) * pixel_size).alias("perimeter"))


def descriptors(mask: DataFrame, pixel_size: float = 0.3) -> DataFrame:
    """All shape metrics of a region; the empty region has no row (an outer join gives it nulls)."""
    out = _shape(mask.groupBy("image").agg(*_sums()), pixel_size).withColumn("average_centroid_distance", _spread(pixel_size)).drop(*_HELPERS)
    out = out.join(perimeter(mask, pixel_size), "image", "left")
    p2 = F.col("perimeter") * F.col("perimeter")
    return out.withColumns({"circularity": F.when(p2 > 0, 4 * math.pi * F.col("area_um2") / p2).otherwise(0.0), "transformation_index": F.when(F.col("area_um2") > 0, p2 / (4 * math.pi * F.col("area_um2"))).otherwise(0.0)})
