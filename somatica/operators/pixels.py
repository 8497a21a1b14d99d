"""Pixel relations: ``image, y, x, v`` (and channel ``c``), one row per pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ["image", "y", "x"]


def from_arrays(images: DataFrame, width: str = "width", values: str = "data") -> DataFrame:
    """Rows (image, width, data array in raster order) to pixels."""
    p = images.select("image", F.col(width).alias("_w"), F.posexplode(values).alias("_i", "v"))
    return p.select("image", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def to_arrays(px: DataFrame) -> DataFrame:
    """Pixels to rows (image, height, width, data in raster order); meant for one image per row."""
    p = px.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("data"))
    return p


def project_max(stack: DataFrame) -> DataFrame:
    """Largest value over z: (image, c, z, y, x, v) to (image, c, y, x, v)."""
    return stack.groupBy("image", "c", "y", "x").agg(F.max("v").alias("v"))


def threshold(px: DataFrame, above: float | Column) -> DataFrame:
    """Pixels brighter than ``above``, as a mask (image, y, x)."""
    return px.where(F.col("v") > above).select(AT)


def select_channel(px: DataFrame, channel: int, channels: int) -> DataFrame:
    """Channel ``channel`` (1-based) of ``channels``; ValueError outside of them."""
    if not 1 <= channel <= channels:
        raise ValueError(f"channel {channel} of {channels}")
    return px.where(F.col("c") == channel - 1).drop("c")


def rescale(px: DataFrame, by: list[str] | None = None, top: float = 255.0) -> DataFrame:
    """Values of each image (or group) stretched to 0..``top``, cut to whole numbers; a constant image is only cut."""
    w = Window.partitionBy(*(by or ["image"]))
    low, high = F.min("v").over(w), F.max("v").over(w)
    stretched = F.when(high > low, F.floor((F.col("v") - low) / (high - low) * top)).otherwise(F.floor("v"))
    return px.withColumn("v", stretched.cast("int"))


def luminance(rgb: DataFrame, scale: float = 255.0) -> DataFrame:
    """Channels 0 to 2 (0..1) to one grey channel, cut to whole numbers (after rounding to a millionth, so that a whole sum stays
    whole); further channels do not count."""
    weight = F.when(F.col("c") == 0, 0.2125).when(F.col("c") == 1, 0.7154).when(F.col("c") == 2, 0.0721)
    return rgb.where("c < 3").groupBy(AT).agg(F.floor(F.round(F.sum(F.col("v") * weight) * scale, 6)).cast("int").alias("v"))


def unmix_magenta(rgb: DataFrame) -> DataFrame:
    """Red, green and blue (0 to 2) to blue, green, red and far red (0 to 3): what red and blue share counts as far red.

    These are estimates from a flattened picture, marked by ``is_estimated``.
    """
    of = lambda k: F.max(F.when(F.col("c") == k, F.col("v")))
    p = rgb.groupBy(AT).agg(of(0).alias("r"), of(1).alias("g"), of(2).alias("b")).withColumn("f", F.least("r", "b"))
    out = F.array(F.greatest(F.col("b") - F.col("f"), F.lit(0)), F.col("g"), F.greatest(F.col("r") - F.col("f"), F.lit(0)), F.col("f"))
    return p.select(*AT, F.posexplode(out).alias("c", "v")).withColumn("is_estimated", F.lit(True))


def contrast_factor(contrast: float) -> float:
    return 1 + 2 * contrast / 100 if contrast > 0 else 1 + 0.9 * contrast / 100


def display(px: DataFrame, brightness: float, contrast: float, by: list[str] | None = None, brightness_first: bool = False) -> DataFrame:
    """Stretch to 0..255, contrast about 127.5, brightness, clip, whole numbers. Colour pictures add brightness first."""
    w = Window.partitionBy(*(by or ["image"]))
    low, high = F.min("v").over(w), F.max("v").over(w)
    v = F.when(high > low, (F.col("v") - low) / (high - low) * 255.0).otherwise(F.lit(0.0))
    k, add = contrast_factor(contrast), 1.5 * brightness
    v = (v + add - 127.5) * k + 127.5 if brightness_first else (v - 127.5) * k + 127.5 + add
    return px.withColumn("v", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int"))


def display_colour(px: DataFrame, brightness: float, contrast: float, channels: dict[int, float] | None = None) -> DataFrame:
    """Colour pictures (image, c, y, x, v): each channel stretched to 0..255 on its own (a constant one stays as it is) and made
    brighter by its entry in ``channels``, then brightness and contrast of the whole picture, clip, whole numbers."""
    w = Window.partitionBy("image", "c")
    low, high = F.min("v").over(w), F.max("v").over(w)
    own = F.lit(0.0)
    for c, add in (channels or {}).items():
        own = F.when(F.col("c") == c, F.lit(1.5 * add)).otherwise(own)
    v = F.when(high > low, (F.col("v") - low) / (high - low) * 255.0).otherwise(F.col("v")) + own + 1.5 * brightness
    v = (v - 127.5) * contrast_factor(contrast) + 127.5
    return px.withColumn("v", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int"))


def composite(px: DataFrame, channel: int, processed: DataFrame, shown: list[int]) -> DataFrame:
    """``px`` with one channel taken from ``processed`` (image, y, x, v) where that has the pixel, also where ``px`` has none;
    channels not shown are 0."""
    new = processed.select(*AT, F.lit(channel).alias("c"), F.col("v").alias("_new"))
    out = px.join(new, [*AT, "c"], "full")
    v = F.when(~F.col("c").isin(shown), 0.0).otherwise(F.coalesce("_new", "v"))
    return out.select("image", "c", "y", "x", v.alias("v"))


def crop(px: DataFrame, centres: DataFrame, half: int = 200) -> DataFrame:
    """Pixels within ``half`` of each centre (image, cell, cy, cx): adds cell. Joined by image, then a range filter."""
    c = centres.select("image", "cell", "cy", "cx")
    inside = (F.abs(F.col("y") - F.col("cy")) <= half) & (F.abs(F.col("x") - F.col("cx")) <= half)
    return px.join(c, "image").where(inside).drop("cy", "cx")


def median_filter(px: DataFrame, size: int, height: int | Column, width: int | Column, tile: int = 512) -> DataFrame:
    """Median over ``size`` x ``size`` windows of dense images; borders are mirrored. (An odd window, so an order statistic.)

    Tile by tile with a halo (``tiles.filtered``), a few rows at a time. ``height`` and ``width`` are numbers, or columns of ``px``
    where images differ in size; so in all filters.
    """
    from somatica.operators import tiles

    r = size // 2

    def work(block, inside):
        import numpy as np

        seen = np.lib.stride_tricks.sliding_window_view(block, (2 * r + 1, 2 * r + 1), axis=(-2, -1))
        out = np.zeros_like(block)
        high, wide = seen.shape[-4:-2]
        some = max(1, 4_000_000 // (seen[..., :1, :, :, :].size))
        for k in range(0, high, some):
            part = seen[..., k : k + some, :, :, :]
            out[..., r + k : r + k + part.shape[-4], r : r + wide] = np.median(part, axis=(-2, -1))
        return out

    return tiles.filter_pixels(px, r, work, height, width, tile)


def _weights(sigma: float, reach: float) -> list[float]:
    r = int(reach * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def blurred(block, sigma: float, reach: float = 4.0):
    """Separable Gaussian blur of an array along its last two axes; what lies within the kernel's reach of its border is not to be used."""
    import numpy as np

    weights = _weights(sigma, reach)
    r = len(weights) // 2
    for axis in (block.ndim - 2, block.ndim - 1):
        wide = np.pad(block, [(r, r) if k == axis else (0, 0) for k in range(block.ndim)], mode="edge")
        n = block.shape[axis]
        block = sum(w * (wide[..., k : k + n, :] if axis == block.ndim - 2 else wide[..., k : k + n]) for k, w in enumerate(weights))
    return block


def gaussian(px: DataFrame, sigma: float, height: int | Column, width: int | Column, reach: float = 4.0, tile: int = 512) -> DataFrame:
    """Separable Gaussian blur of dense images, borders mirrored: tile by tile with a halo."""
    from somatica.operators import tiles

    return tiles.filter_pixels(px, int(reach * sigma + 0.5), lambda block, inside: blurred(block, sigma, reach), height, width, tile)


def unsharp(px: DataFrame, amount: float, height: int | Column, width: int | Column, sigma: float = 2.0, top: float = 255.0, tile: int = 512) -> DataFrame:
    """Value plus ``amount`` times its difference from the blurred image, clipped to 0..``top``; one pass over the tiles."""
    from somatica.operators import tiles

    def work(block, inside):
        import numpy as np

        return np.clip(block + amount * (block - blurred(block, sigma)), 0.0, float(top))

    return tiles.filter_pixels(px, int(4.0 * sigma + 0.5), work, height, width, tile)


def in_polygon(px: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pixels inside polygons (image, cell, seq, py, px): image, cell, y, x, by an odd number of edges crossed to the right.

    Polygons with fewer than three points are empty. Edges join the pixels by image and row band.
    """
    w = Window.partitionBy("image", "cell").orderBy("seq")
    every = Window.partitionBy("image", "cell")
    e = polygons.withColumns({"y2": F.coalesce(F.lead("py").over(w), F.first("py").over(w)), "x2": F.coalesce(F.lead("px").over(w), F.first("px").over(w)), "points": F.count(F.lit(1)).over(every)}).where("points >= 3")
    e = e.select("image", "cell", F.col("py").alias("y1"), F.col("px").alias("x1"), "y2", "x2")
    rows = e.where("y1 <> y2").withColumn("y", F.explode(F.sequence(F.floor(F.least("y1", "y2")).cast("int"), F.ceil(F.greatest("y1", "y2")).cast("int"))))
    spans = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    rows = rows.where(spans).withColumn("cut", F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    cuts = rows.groupBy("image", "cell", "y").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    odd = F.size(F.filter("cuts", lambda c: c > F.col("x"))) % 2 == 1
    return px.select(AT).join(cuts, ["image", "y"]).where(odd).select("image", "cell", "y", "x")
