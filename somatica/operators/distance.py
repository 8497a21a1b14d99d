"""Distances between pixel sets of the same image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.operators import batches
from somatica.operators.pixels import AT


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Euclidean distance ``d`` from each pixel of ``points`` to the nearest of ``targets``; no row where the image has none.

    One group per image: the exact distance transform of the frame that holds both, so the work follows the image's size and
    not the number of pairs. Images may differ in size.
    """

    def run(left, right):
        import numpy as np

        if not len(left) or not len(right):
            return left[AT].assign(d=0.0).iloc[:0]
        y0, x0 = min(left["y"].min(), right["y"].min()), min(left["x"].min(), right["x"].min())
        on = np.zeros((max(left["y"].max(), right["y"].max()) - y0 + 1, max(left["x"].max(), right["x"].max()) - x0 + 1), bool)
        on[right["y"] - y0, right["x"] - x0] = True
        return left[AT].assign(d=np.sqrt(squared_distances(on)[left["y"] - y0, left["x"] - x0]))

    kind = points.schema["image"].dataType.simpleString()
    at = [F.col("image"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")]
    both = points.select(*at).groupBy("image").cogroup(targets.select(*at).groupBy("image"))
    return both.applyInPandas(run, f"image {kind}, y int, x int, d double")


def to_background(mask: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """``mask`` with ``d``: exact distance to the nearest pixel of the frame that is not in the mask (null: there is none).

    ``height`` and ``width`` are numbers, or columns of ``mask`` where images differ in size. Many images a call, those of one size as a
    stack; the squared distances along columns are widened row by row until nothing can become smaller.
    """

    def run(table, starts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in AT), background(table, starts)], [*AT, "d"])

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(framed(mask, height, width), ["image"], run, f"image {kind}, y int, x int, d double")


def framed(mask: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """``mask`` as ``background`` needs it."""
    return mask.select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(height).cast("int").alias("_h"), F.lit(width).cast("int").alias("_w"))


def background(table, starts):
    """Distances of ``to_background`` of every row of groups of ``framed`` rows."""
    import numpy as np
    import pyarrow as pa

    h, w = (batches.numbers(table, c)[starts].astype(np.int64) for c in ("_h", "_w"))
    y, x = batches.numbers(table, "y"), batches.numbers(table, "x")
    group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
    d2 = np.zeros(table.num_rows)
    for high, wide in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
        same = np.flatnonzero((h == high) & (w == wide))
        some = max(1, batches.STACK // (high * wide))
        for k in range(0, len(same), some):
            number = np.full(len(starts), -1)
            number[same[k : k + some]] = np.arange(len(same[k : k + some]))
            rows = np.flatnonzero(number[group] >= 0)
            on = np.zeros((len(same[k : k + some]), high, wide), bool)
            place = number[group[rows]], y[rows], x[rows]
            on[place] = True
            d2[rows] = squared_distances(~on)[place]
    known = np.isfinite(d2)
    return pa.array(np.sqrt(np.where(known, d2, 0.0)), mask=~known)


def opened(mask: DataFrame, radius: int | Column) -> DataFrame:
    """``mask`` opened with a disk whose radius is a number or a column of ``mask`` (one value an image).

    A pixel stays in the erosion if nothing outside the mask is within the radius, and is in the dilation if something of the erosion
    is: two exact distance transforms, whatever the radius. Many images a call, on their masks' bounding boxes.
    """

    def run(table, starts):
        import numpy as np

        radius = batches.numbers(table, "_r")[starts].astype(np.int64)
        for on, groups, rows, *rest in batches.strips(table, starts, int(radius.max()) + 1):
            left = disk_opened(on, np.repeat(radius[groups], np.diff(np.append(rows, len(on)))))
            yield batches.from_strip(table, starts, left, groups, rows, *rest)

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(mask.select(*AT, F.lit(radius).cast("int").alias("_r")), ["image"], run, f"image {kind}, y int, x int")


def disk_opened(on, radius):
    """A boolean array opened with disks, by the radius of each row. Masks of different radii must lie further apart than the largest, so that
    none is within reach of another."""
    most, r2 = int(radius.max()), (radius**2)[:, None]
    return squared_distances(squared_distances(~on, most) > r2, most) <= r2


def squared_distances(targets, within: float | None = None):
    """Squared distance of every cell of a boolean array (or of each of a stack) to the nearest true one of it; infinite if there is none.
    Distances over ``within`` may come out larger than they are."""
    import numpy as np

    h, w = targets.shape[-2:]
    steps = np.where(targets, 0.0, np.inf)
    for i in range(1, h):
        steps[..., i, :] = np.minimum(steps[..., i, :], steps[..., i - 1, :] + 1)
    for i in range(h - 2, -1, -1):
        steps[..., i, :] = np.minimum(steps[..., i, :], steps[..., i + 1, :] + 1)
    best = steps * steps
    if targets.ndim > 2:
        some = targets.any(axis=(-2, -1))
        best[some] = _widened(best[some], w if within is None else within + 1)
        return best
    return _widened(best, w if within is None else within + 1) if targets.any() else best


def _widened(column, most: float):
    """Squared distances from those along columns; steps of ``most`` or more along rows are left out."""
    import numpy as np

    best, w = column.copy(), column.shape[-1]
    for k in range(1, w if best.size else 0):
        if k * k >= best.max() or k >= most:
            break
        best[..., k:] = np.minimum(best[..., k:], column[..., :-k] + k * k)
        best[..., :-k] = np.minimum(best[..., :-k], column[..., k:] + k * k)
    return best


def bands(distances: DataFrame, edges: tuple[float, ...] = (0, 10, 20, 40), pixel_size: float = 1.0) -> DataFrame:
    """``distances`` with ``lo`` and ``hi`` of the band (lo, hi] that ``d * pixel_size`` falls in; others are left out."""
    um = F.col("d") * pixel_size
    lo = hi = F.lit(None).cast("int")
    for a, b in zip(edges, edges[1:], strict=False):
        inside = (um > a) & (um <= b)
        lo, hi = F.when(inside, F.lit(int(a))).otherwise(lo), F.when(inside, F.lit(int(b))).otherwise(hi)
    return distances.withColumns({"lo": lo, "hi": hi}).where("lo is not null")
