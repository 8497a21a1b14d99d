"""Terminal bulbs: swellings at the ends of a cell's processes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatica.functions.cells import cosine
from somatica.operators import batches, distance, morphology, skeleton
from somatica.operators.pixels import AT
from somatica.sources import scratch


@dataclass(frozen=True)
class BulbRules:
    """Fixed values of the detector."""

    least_diameter_um: float = 1.4
    soma_margin: float = 1.3
    least_tip_factor: float = 1.5
    connection_px: int = 10
    most_connections: int = 1
    distal_px: int = 4
    distal_cosine: float = -0.2
    soma_dilation_px: int = 3
    half_width_fallback: float = 2.0


def detect(mask: DataFrame, height: int | Column, width: int | Column, pixel_size: float, rules: BulbRules = BulbRules(), open_radius: int | None = None, outlines: DataFrame | None = None, areas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bulbs (image, label, cy, cx, diameter_um) and one row of counts per image (num_bulbous_endings, mean_bulb_diameter_um,
    beading_index).

    The soma of a cell is its traced one (``outlines``: image, y, x), grown a little. Without, it is a disk around the thickest place,
    as large as its known area (``areas``: image, soma_area_um2) or as the cell is thick there.

    A bulb is a blob left by opening the mask, thick enough, away from the soma, touched by at most one long process, and with no
    process that goes on beyond it. Distances, thinning, opening and labels are found for many images a call, in two tables of pixels that
    are written, so nothing is worked out twice; the rest are aggregations and joins.
    """
    px = scratch.written(_measured(mask, height, width))
    soma, tagged = _somas(px, pixel_size, rules, outlines, areas)
    soma = scratch.written(soma)
    if outlines is not None:
        px = scratch.written(tagged(px, soma))
    else:
        px = tagged(px, soma)
    if open_radius is None:
        half = px.where("thin and not in_soma").groupBy("image").agg(F.percentile("d", F.lit(0.25)).alias("p25"))
        ceiling = max(3, int(rules.least_diameter_um / pixel_size / 2) - 1)
        radius = F.least(F.greatest(F.bround(F.coalesce("p25", F.lit(rules.half_width_fallback)) + 2), F.lit(3)), F.lit(ceiling))
        px = px.join(soma.select("image").join(half, "image", "left").select("image", radius.cast("int").alias("_r")), "image")
    else:
        px = px.withColumn("_r", F.lit(open_radius))
    px = scratch.written(_labelled(px))
    key = ["image", "label"]
    blobs = px.where("label is not null")
    sizes = [F.count_if("in_soma").alias("n"), F.max(F.col("at_centre").cast("int")).alias("centre"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.max("d").alias("thick")]
    own = F.max(F.when((F.col("n") > 0) | (F.col("centre") == 1), F.struct("centre", "n", (-F.col("label")).alias("label")))).over(Window.partitionBy("image"))
    b = blobs.groupBy(key).agg(*sizes).withColumn("own", -own["label"]).drop("n", "centre").join(soma, "image")
    far = F.hypot(F.col("cy") - F.col("sy"), F.col("cx") - F.col("sx")) >= rules.least_tip_factor * F.col("sr")
    b = scratch.written(b.where((F.col("own").isNull() | (F.col("label") != F.col("own"))) & (F.col("thick") >= rules.least_diameter_um / pixel_size / 2) & far))
    near = px.join(b.select(*key, F.lit(True).alias("_thick")), key, "left").where("_thick or line is not null")
    contact = _contacts(near).join(b, key)
    along = cosine(F.col("ty") - F.col("cy"), F.col("tx") - F.col("cx"), F.col("sy") - F.col("cy"), F.col("sx") - F.col("cx"))
    ties = contact.groupBy(key).agg(F.count_if(F.col("size") >= rules.connection_px).alias("connections"), F.count_if((F.col("size") >= rules.distal_px) & (along < rules.distal_cosine)).alias("beyond"))
    bulbs = b.join(ties, key, "left").where((F.coalesce("connections", F.lit(0)) <= rules.most_connections) & (F.coalesce("beyond", F.lit(0)) == 0))
    bulbs = bulbs.select("image", "label", "cy", "cx", (2 * F.col("thick") * pixel_size).alias("diameter_um"))
    tips = morphology.degrees(px.where("thin and not in_soma").select(AT)).groupBy("image").agg(F.count_if(F.col("degree") == 1).alias("tips"))
    n = bulbs.groupBy("image").agg(F.count(F.lit(1)).alias("num_bulbous_endings"), F.round(F.avg("diameter_um"), 4).alias("mean_bulb_diameter_um"))
    counts = soma.select("image").join(n, "image", "left").join(tips, "image", "left").na.fill(0, ["num_bulbous_endings"]).na.fill(0.0, ["mean_bulb_diameter_um"])
    index = F.when(F.col("tips") > 0, F.round(F.col("num_bulbous_endings") / F.col("tips"), 4)).otherwise(0.0)
    return bulbs, counts.select("image", "num_bulbous_endings", "mean_bulb_diameter_um", index.alias("beading_index"))


def _measured(mask: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """Every pixel of ``mask`` once, with ``d``, its distance to the background, and ``thin``: whether it is of the skeleton."""

    def once(table, starts):
        import numpy as np

        group, _, _ = morphology.raster_places(table, starts, morphology.FAR)
        if len(group) == table.num_rows:
            return table.to_batches()
        number, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        places = np.stack([number, batches.numbers(table, "y"), batches.numbers(table, "x")])
        return table.take(np.sort(np.unique(places, axis=1, return_index=True)[1])).to_batches()

    def run(table, starts):
        import pyarrow as pa

        thin = batches.in_strips(table, starts, skeleton.thinned)
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in AT), distance.background(table, starts), pa.array(thin)], [*AT, "d", "thin"])

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(distance.framed(mask, height, width), ["image"], [once, run], f"image {kind}, y int, x int, d double, thin boolean")


def _labelled(px: DataFrame) -> DataFrame:
    """Pixels (each once) with the label of their blob, what is left of the mask opened with its image's radius ``_r``, and ``line`` and its
    ``size``, the part of the skeleton outside of blobs that they belong to; nulls where there is none."""

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        y, x, thin = (batches.numbers(table, c) for c in ("y", "x", "thin"))
        radius = batches.numbers(table, "_r")[starts].astype(np.int64)
        blob = batches.in_strips(table, starts, lambda on, groups, rows: distance.disk_opened(on, np.repeat(radius[groups], rows)), int(radius.max()) + 1)
        label, line, size = (np.zeros(len(y), np.int64) for _ in range(3))
        for of, into in ((blob, label), (thin & ~blob, line)):
            into[of] = morphology.labels_of(group[of], y[of], x[of])
        alone = thin & ~blob
        _, part, n = np.unique(np.stack([group[alone], line[alone]]), axis=1, return_inverse=True, return_counts=True)
        size[alone] = n[part.ravel()]
        columns = [pa.array(label, mask=~blob), pa.array(line, mask=~alone), pa.array(size, mask=~alone)]
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in kept), *columns], [*kept, "label", "line", "size"])

    kept = [*AT, "d", "thin", "in_soma", "at_centre"]
    kind = px.schema["image"].dataType.simpleString()
    return batches.apply(px.select(*kept, "_r"), ["image"], run, f"image {kind}, y int, x int, d double, thin boolean, in_soma boolean, at_centre boolean, label long, line long, size long")


def _contacts(px: DataFrame) -> DataFrame:
    """Lines (``line``, ``size``) within two steps of a blob (``label``), with the mean place of the pixels on which they meet (``ty``, ``tx``)."""

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        y, x = (batches.numbers(table, c).astype(np.int64) for c in ("y", "x"))
        label, line, size = (table.column(c).combine_chunks() for c in ("label", "line", "size"))
        blob, lines = (np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False)) for c in (label, line))
        blobs, own = np.unique(np.stack([group[blob], label.take(pa.array(blob)).to_numpy()]), axis=1, return_inverse=True)
        # places of lines, numbered; a line's pixel is its group and that number
        at = y * morphology.FAR + x
        every, number = np.unique(at[lines], return_inverse=True)
        pixel = group[lines] * len(every) + number.ravel()
        lines, pixel = lines[order := np.argsort(pixel)], pixel[order]
        met = []
        for dy, dx in morphology.cross(2) if len(lines) else []:
            want = at[blob] + dy * morphology.FAR + dx
            i = np.minimum(np.searchsorted(every, want), len(every) - 1)
            key = group[blob] * len(every) + i
            j = np.minimum(np.searchsorted(pixel, key), len(pixel) - 1)
            hit = (every[i] == want) & (pixel[j] == key)
            met.append(np.stack([own.ravel()[hit], lines[j[hit]]]))
        blob_of, row = np.unique(np.concatenate(met or [np.zeros((2, 0), np.int64)], axis=1), axis=1)
        pairs, pair, n = np.unique(np.stack([blob_of, line.take(pa.array(row)).to_numpy(zero_copy_only=False)]), axis=1, return_inverse=True, return_counts=True)
        ty, tx = (np.bincount(pair.ravel(), c[row], len(n)) / n for c in (y, x))
        sizes = np.zeros(len(n), np.int64)
        sizes[pair.ravel()] = size.take(pa.array(row)).to_numpy(zero_copy_only=False)
        columns = [pa.array(c) for c in (blobs[1][pairs[0]], pairs[1], sizes, ty, tx)]
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts[blobs[0][pairs[0]]]), *columns], ["image", "label", "line", "size", "ty", "tx"])

    kind = px.schema["image"].dataType.simpleString()
    either = px.select(*AT, F.when(F.col("_thick"), F.col("label")).alias("label"), "line", "size")
    return batches.apply(either, ["image"], run, f"image {kind}, label long, line long, size long, ty double, tx double")


def _somas(d: DataFrame, pixel_size: float, rules: BulbRules, outlines: DataFrame | None, areas: DataFrame | None):
    """Centre and radius of each image's soma (image, sy, sx, sr), and a function that adds to pixels whether they are
    ``in_soma`` and ``at_centre`` of such a table."""
    soma = d.groupBy("image").agg(F.max_by(F.struct("y", "x", "d"), F.struct("d", -F.col("y"), -F.col("x"))).alias("s"))
    soma = soma.select("image", F.col("s.y").cast("double").alias("sy"), F.col("s.x").cast("double").alias("sx"), F.col("s.d").alias("sr"))
    if areas is not None:
        known = areas.where("soma_area_um2 > 0").groupBy("image").agg((F.sqrt(F.max("soma_area_um2") / math.pi) / pixel_size).alias("_r"))
        soma = soma.join(known, "image", "left").withColumn("sr", F.coalesce("_r", "sr")).drop("_r")
    centre = (F.col("y") == F.bround("sy")) & (F.col("x") == F.bround("sx"))
    disk = F.hypot(F.col("y") - F.col("sy"), F.col("x") - F.col("sx")) <= F.col("sr") * rules.soma_margin
    if outlines is None:
        return soma, lambda px, soma: px.join(soma, "image").select(*px.columns, disk.alias("in_soma"), centre.alias("at_centre"))
    traced = outlines.groupBy("image").agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"), F.sqrt(F.count(F.lit(1)) / math.pi).alias("_r"))
    soma = soma.join(traced, "image", "left").select("image", F.coalesce("_y", "sy").alias("sy"), F.coalesce("_x", "sx").alias("sx"), F.coalesce("_r", "sr").alias("sr"), F.isnotnull("_r").alias("traced"))
    grown = morphology.dilate(outlines, morphology.cross(rules.soma_dilation_px)).withColumn("_grown", F.lit(True))
    flag = F.when(F.col("traced"), F.coalesce("_grown", F.lit(False))).otherwise(disk)
    return soma, lambda px, soma: px.join(soma, "image").join(grown, AT, "left").select(*px.columns, flag.alias("in_soma"), centre.alias("at_centre"))
