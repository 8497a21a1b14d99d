"""Box counting: fractal dimension and lacunarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Box sizes, each with the half side an image must have for it: powers of two, and the midpoints between two of them.
_SIZES = sorted([(1 << k, 1 << k) for k in range(1, 16)] + [(3 << k - 1, 2 << k) for k in range(1, 15)])


def box_sizes(height: int, width: int) -> list[int]:
    """Powers of two up to half the shorter side, and the rounded midpoints between them; empty if fewer than three."""
    sizes = [s for s, half in _SIZES if half <= min(height, width) // 2]
    return sizes if len(sizes) >= 3 else []


def box_counts(mask: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """For each image and box size s: occupied boxes n, and lacunarity (variance over squared mean of the pixels per box, plus
    1) over all boxes of the grid anchored at the frame's corner, empty and ragged ones too. ``height`` and ``width`` are
    numbers, or columns of ``mask`` where images differ in size."""
    every = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(half).alias("half")) for s, half in _SIZES])
    fits = F.filter(every, lambda e: e["half"] <= F.floor(F.least("_h", "_w") / 2))
    framed = mask.select("image", "y", "x", F.lit(height).alias("_h"), F.lit(width).alias("_w"))
    boxes = framed.select("*", F.explode(F.transform(F.when(F.size(fits) >= 3, fits), lambda e: e["s"])).alias("s"))
    boxes = boxes.groupBy("image", "_h", "_w", "s", F.floor(F.col("y") / F.col("s")).alias("by"), F.floor(F.col("x") / F.col("s")).alias("bx")).agg(F.count(F.lit(1)).alias("c"))
    sums = boxes.groupBy("image", "_h", "_w", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c1"), F.sum(F.col("c") * F.col("c")).alias("c2"))
    grid = F.ceil(F.col("_h") / F.col("s")) * F.ceil(F.col("_w") / F.col("s"))
    mean = F.col("c1") / grid
    return sums.select("image", "s", "n", ((F.col("c2") / grid - mean * mean) / (mean * mean) + 1).alias("lacunarity"))


def dimension(counts: DataFrame) -> DataFrame:
    """Slope and fit of ln n over ln 1/s, and the mean, first and last lacunarity."""
    x, y = -F.ln("s"), F.ln("n")
    return counts.groupBy("image").agg(
        F.regr_slope(y, x).alias("fractal_dimension"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("scales"),
        F.avg("lacunarity").alias("mean_lacunarity"), F.min_by("lacunarity", "s").alias("first_lacunarity"), F.max_by("lacunarity", "s").alias("last_lacunarity"),
    )
