"""Vessels: segmentation, leakage of a tracer, exposure of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.operators import background, distance, morphology, thresholds
from somatica.operators.pixels import AT


def vessel_mask(px: DataFrame, height: int | Column, width: int | Column, pixel_size: float, least_um2: float = 5.0, tubes: bool = False, sigmas: tuple[float, ...] = background.SIGMAS) -> DataFrame:
    """Pixels over Otsu's threshold of the positive values, closed with a disk of 2, small specks dropped.

    With ``tubes`` the threshold is taken of the ridges of the image (``background.tubeness``, at the scales ``sigmas``, brightness as a
    share of its largest), which keeps lines and drops blobs. An image without a positive value has no vessels.
    """
    if tubes:
        top = px.groupBy("image").agg(F.max("v").alias("_top")).where("_top > 0")
        sized = px.join(top, "image").select(*AT, (F.col("v") / F.col("_top")).alias("v"), F.lit(height).alias("_h"), F.lit(width).alias("_w"))
        numbers = isinstance(height, int) and isinstance(width, int)  # then whole images need no neighbours
        base = background.tubeness(sized, height if numbers else F.col("_h"), width if numbers else F.col("_w"), sigmas)
    else:
        base = px
    level = thresholds.otsu(base.where("v > 0"))
    bright = base.join(level, "image").where(F.col("v") > F.col("threshold")).select(AT)
    closed = morphology.close(bright, morphology.disk(2), height, width)
    return morphology.despeckle(closed, max(int(least_um2 / pixel_size**2), 1))


def leakage(px: DataFrame, vessel: DataFrame) -> DataFrame:
    """Tracer inside and outside of the vessels: means, leakage index, share outside brighter than the median inside."""
    t = px.join(vessel.select(*AT, F.lit(True).alias("inside")), AT, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    level = t.where("inside").groupBy("image").agg(F.percentile("v", F.lit(0.5)).alias("level"), F.avg("v").alias("intra"))
    outside = t.where(~F.col("inside")).join(level, "image", "left").groupBy("image").agg(F.avg("v").alias("extra"), F.avg((F.col("v") > F.coalesce("level", F.lit(0.0))).cast("double")).alias("fraction"))
    m = px.select("image").distinct().join(level, "image", "left").join(outside, "image", "left").na.fill(0.0, ["intra", "extra", "fraction"])
    index = F.when(F.col("intra") > 0, F.col("extra") / F.col("intra")).otherwise(0.0)
    return m.select("image", F.col("intra").alias("intravascular_mean"), F.col("extra").alias("extravascular_mean"), index.alias("leakage_index"), F.col("fraction").alias("extravascular_area_fraction"))


def ring_means(px: DataFrame, vessel: DataFrame, pixel_size: float = 1.0, edges: tuple[int, ...] = (0, 10, 20, 40)) -> DataFrame:
    """Mean tracer in rings around the vessels, one column per ring, 0 where a ring is empty."""
    d = distance.bands(distance.nearest(px, vessel), edges, pixel_size)
    names = {(a, b): f"perivasc_{a}_{b}um_mean" for a, b in zip(edges, edges[1:], strict=False)}
    v = px.join(d, AT)
    return v.groupBy("image").agg(*[F.coalesce(F.avg(F.when(F.col("lo") == a, F.col("v"))), F.lit(0.0)).alias(n) for (a, _), n in names.items()])


def soma_disk(centres: DataFrame, height: int, width: int, pixel_size: float, radius_um: float = 6.0) -> DataFrame:
    """Disk of pixels around each centre (image, cell, cy, cx) moved into the frame: image, cell, y, x."""
    r = max(1, round(radius_um / max(pixel_size, 1e-6)))
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round(c).cast("int")))
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in morphology.disk(r)]))
    d = centres.select("image", "cell", at(F.col("cy"), height).alias("cy"), at(F.col("cx"), width).alias("cx"), o.alias("o"))
    d = d.select("image", "cell", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"))
    return d.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def exposure(cell_px: DataFrame, px: DataFrame, vessel: DataFrame, soma: DataFrame, pixel_size: float, marker: DataFrame | None = None) -> DataFrame:
    """Per cell (image, cell): distance of its soma to the vessels, mean tracer outside of them, share of it on them, and the
    mean of the vessel ``marker`` (image, y, x, v) over all of it, if given.

    A cell without soma pixels is measured by all its pixels, and one that lies wholly on vessels is averaged as a whole.
    """
    key = ["image", "cell"]
    if marker is not None:
        mean = cell_px.join(marker.select(*AT, F.col("v").alias("_marker")), AT).groupBy(key).agg(F.avg("_marker").alias("cd31_exposure_mean"))
        return exposure(cell_px, px, vessel, soma, pixel_size).join(mean, key, "left")
    tagged = cell_px.join(px, AT, "left").join(vessel.select(*AT, F.lit(1).alias("on")), AT, "left").na.fill(0, ["on"])
    m = tagged.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("on") == 0, F.col("v"))), F.avg("v")).alias("exposure_mean"), F.avg("on").alias("vessel_contact_fraction"))
    region = soma.select("image", "cell", "y", "x", F.lit(True).alias("soma")).unionByName(cell_px.select("image", "cell", "y", "x", F.lit(False).alias("soma")))
    d = region.join(distance.nearest(region, vessel).distinct(), AT)
    near = d.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("soma"), F.col("d"))), F.min("d")).alias("d"))
    return m.join(near, key, "left").select(*key, (F.col("d") * pixel_size).alias("dist_to_vessel_um"), "exposure_mean", "vessel_contact_fraction")


def network(vessel: DataFrame, skeleton: DataFrame, height: int | Column, width: int | Column, pixel_size: float) -> DataFrame:
    """Area share, skeleton length and branch points per area, and mean diameter of each image's vessels.

    ``height`` and ``width`` are numbers, or columns of ``vessel`` where images differ in size.
    """
    area = F.col("frame") * pixel_size**2
    d = distance.to_background(vessel, height, width)
    s = morphology.degrees(skeleton).join(d, AT, "left").groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("degree") >= 3).alias("branches"), F.avg("d").alias("d"))
    v = vessel.groupBy("image").agg(F.count(F.lit(1)).alias("n_px"), F.max(F.lit(height) * F.lit(width)).cast("double").alias("frame")).withColumn("vessel_area_fraction", F.col("n_px") / F.col("frame"))
    return v.join(s, "image", "left").select("image", "vessel_area_fraction", (F.coalesce("n", F.lit(0)) * pixel_size / area).alias("length_density"), (F.coalesce("branches", F.lit(0)) / (area / 1e6)).alias("branchpoint_density"), (F.coalesce("d", F.lit(0.0)) * 2 * pixel_size).alias("mean_diameter"))
