"""Nested masks of a cell: one for each target area, each holding the smaller ones and the soma."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.functions.cells import floor_scale
from somatica.operators import batches, thresholds, tiles
from somatica.operators.pixels import AT

#: Target areas in square micrometres.
TARGETS_UM2 = (200, 300, 400, 500, 600, 700, 800)


def nest(masks: DataFrame, areas: tuple[int, ...] | None = None) -> DataFrame:
    """Masks (image, area, y, x) made to hold each other: a pixel of one area is in all larger ones.

    In sparse form a running union is the area at which a pixel first appears, and all that are not smaller: those of
    ``areas``, if given (one pass), else those that the image's masks have.
    """
    first = masks.groupBy(AT).agg(F.min("area").alias("first"))
    if areas is not None:
        return first.select("image", F.explode(F.filter(F.array(*map(F.lit, areas)), lambda a: a >= F.col("first"))).alias("area"), "y", "x")
    areas = masks.groupBy("image").agg(F.collect_set("area").alias("_areas"))
    each = F.explode(F.filter("_areas", lambda a: a >= F.col("first")))
    return first.join(areas, "image").select("image", each.alias("area"), "y", "x")


def nested_masks(roi: DataFrame, centres: DataFrame, pixel_size: float, targets_um2: tuple[int, ...] = TARGETS_UM2, floor_percent: float | None = 30.0, soma: DataFrame | None = None, tolerance: float = 100.0) -> DataFrame:
    """Masks of every target area around each centre: image, area, y, x.

    ``roi``: image, y, x, v, one cell's surroundings per image; ``centres``: image, cy, cx; ``soma``: image, y, x. The
    threshold starts at Otsu's level, and never falls below a share of the brightest value that shrinks with the area.
    """
    top = roi.groupBy("image").agg(F.max("v").alias("top"))
    t = centres.join(thresholds.otsu(roi), "image").join(top, "image").withColumn("area", F.explode(F.array(*[F.lit(a) for a in targets_um2])))
    floor = F.lit(None).cast("double") if floor_percent is None else F.lit(floor_percent / 100) * F.col("top") * floor_scale(F.col("area"))
    t = t.select("image", "cy", "cx", F.col("threshold").alias("start"), (F.col("area") / float(pixel_size) ** 2).alias("target"), floor.alias("floor"))
    found = thresholds.area_targets(roi, t, tolerance=tolerance)
    masks = found.select("image", F.round(F.col("target") * float(pixel_size) ** 2).cast("int").alias("area"), "y", "x")
    if soma is not None:
        masks = masks.unionByName(soma.select(AT).withColumn("area", F.lit(min(targets_um2))))
    return nest(masks, tuple(sorted(targets_um2)))


def cell_masks(
    raster: DataFrame, centres: DataFrame, pixel_size: float, targets_um2: tuple[int, ...] = TARGETS_UM2, floor_percent: float | None = 30.0, soma: DataFrame | None = None,
    tolerance: float = 100.0, rounds: int = 30, half: int = 200, nested: bool = True, size: int = tiles.SIZE,
) -> DataFrame:
    """Masks of every target area around many cells of an image: image, cell, area, y, x.

    ``raster``: tiles; ``centres``: image, cell, cy, cx; ``soma``: image, cell, y, x, which is in every mask of its cell. Each cell is
    grown in its own window, up to 2 ``half`` x 2 ``half`` pixels cut out of the tiles it touches, with Otsu's level of that window; masks
    come back in places of the image. Cells may share pixels (``contested`` gives each to one). The older way is
    ``targets_um2=TARGETS_UM2[1:], nested=False``: no smallest area, no soma, masks as found.
    """
    kind, cell = raster.schema["image"].dataType.simpleString(), centres.schema["cell"].dataType.simpleString()
    scale = float(pixel_size) ** 2

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        cy, cx, y, x, h, w = (batches.numbers(table, c).astype(np.int64) for c in ("cy", "cx", "y", "x", "h", "w"))
        pieces, rows, areas, ys, xs = table.column("piece").to_pylist(), [], [], [], []
        for i, j in batches.spans(table, starts):
            y0, x0 = int(y[i:j].min()), int(x[i:j].min())
            size_ = int((y[i:j] + h[i:j]).max()) - y0, int((x[i:j] + w[i:j]).max()) - x0
            window = tiles.joined(zip(*(c[i:j].tolist() for c in (y, x, h, w)), pieces[i:j], strict=True), y0, x0, *size_)
            search = thresholds.Window2D(window, int(cy[i]) - y0, int(cx[i]) - x0)
            start = search.otsu() if len(search.values) else 0.0
            for area in targets_um2:
                floor = None if floor_percent is None or not len(search.values) else floor_percent / 100 * search.values[-1] * least_share(area)
                found_y, found_x = search.mask(start, area / scale, floor, rounds, tolerance)
                ys.append(found_y + y0)
                xs.append(found_x + x0)
                areas.append(area)
                rows.append(i)
        n = [len(c) for c in ys]
        at = np.repeat(np.array(rows, int), n)
        numbers = [np.repeat(np.array(areas), n), np.concatenate(ys), np.concatenate(xs)]
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", at), batches.chosen(table, "cell", at), *(pa.array(c.astype(np.int32)) for c in numbers)], ["image", "cell", "area", "y", "x"])

    pieces = tiles.windows(raster, centres, half, size)
    found = batches.apply(pieces, ["image", "cell"], run, f"image {kind}, cell {cell}, area int, y int, x int")
    if not nested:
        return found
    if soma is not None:
        found = found.unionByName(soma.select("image", "cell", F.lit(min(targets_um2)).alias("area"), "y", "x"))
    first = found.groupBy("image", "cell", "y", "x").agg(F.min("area").alias("first"))
    larger = F.filter(F.array(*map(F.lit, sorted(targets_um2))), lambda a: a >= F.col("first"))
    return first.select("image", "cell", F.explode(larger).alias("area"), "y", "x")


def least_share(area_um2: int) -> float:
    """Share of the least brightness that a mask of an area has to keep: all up to 300, 0.3 from 800 on, a line between."""
    return min(1.0, max(0.3, 1 - 0.7 * (area_um2 - 300) / 500))


def contested(masks: DataFrame, centres: DataFrame) -> DataFrame:
    """``masks`` (image, cell, area, y, x) with every pixel of an area left to one cell: the one with the nearest centre, of equally
    near ones the first. One aggregation by pixel."""
    at = centres.select("image", "cell", "cy", "cx")
    off = F.struct(((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))).alias("d"), F.col("cell").alias("cell"))
    return masks.join(at, ["image", "cell"]).groupBy("image", "area", "y", "x").agg(F.min(off).alias("n")).select("image", F.col("n.cell").alias("cell"), "area", "y", "x")


def review_queue(masks: DataFrame) -> DataFrame:
    """Masks in review order: by image and cell, largest first, with the index in the whole queue of the image."""
    w = Window.partitionBy("image_name").orderBy("soma_id", F.col("area").desc())
    return masks.withColumn("idx", F.row_number().over(w) - 1)
