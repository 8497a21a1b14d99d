"""Thresholds: Otsu's, and masks of a wanted area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators import batches


def otsu(px: DataFrame, bins: int = 256) -> DataFrame:
    """Threshold of each image: centre of the bin that parts the values with the largest variance between classes.

    Bins are equal between the image's extremes; the lowest of equally good ones wins. A constant image gets its value less
    one, so that all of it lies above. Histogram and cumulative sums only: no value leaves Spark.
    """
    every = Window.partitionBy("image")
    ranges = px.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = px.join(ranges, "image").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int"))
    h = b.groupBy("image", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("image").orderBy("bin")
    h = h.withColumns({"w1": F.sum("n").over(up), "m1": F.sum(F.col("n") * (2 * F.col("bin") + 1)).over(up), "w": F.sum("n").over(every), "m": F.sum(F.col("n") * (2 * F.col("bin") + 1)).over(every)})
    w2, gap = F.col("w") - F.col("w1"), F.col("m1") / F.col("w1") - (F.col("m") - F.col("m1")) / F.nullif(F.col("w") - F.col("w1"), F.lit(0))
    h = h.withColumn("between", F.coalesce(F.col("w1") * w2 * gap * gap, F.lit(-1.0)))
    best = h.groupBy("image", "lo", "hi").agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"))
    return best.select("image", F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).otherwise(F.col("lo") - 1).alias("threshold"))


def percentiles(px: DataFrame, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles of whole values from 0 to 65,535 without a sort: per image (or group) a column for each of ``shares``, the
    smallest value that at least that share of the pixels does not exceed.

    Two rounds of 256 bins: the first finds the bin of high bytes that holds the percentile, the second counts low bytes in it alone.
    Both are sums, so parts of an image can be counted apart and added, and a group leaves 256 rows at most.
    """
    keys = by or ["image"]
    v = F.col("v").cast("int")
    d = px.select(*keys, F.shiftright(v, 8).alias("high"), v.bitwiseAND(F.lit(255)).alias("low"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("share")) for n, q in shares.items()]))
    first = d.groupBy(*keys, "high").agg(F.count(F.lit(1)).alias("n"))
    all_, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("high")
    first = first.withColumns({"total": F.sum("n").over(all_), "until": F.sum("n").over(upto)}).select("*", wanted.alias("w"))
    # with a share of the whole, which a product in doubles may miss by a trifle, nothing above is asked for
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("w.share") * F.col("total"), 6)))
    bins = first.withColumn("rank", rank).where((F.col("until") >= F.col("rank")) & (F.col("until") - F.col("n") < F.col("rank")))
    bins = bins.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("high").alias("_high"), F.col("w.name").alias("name"), (F.col("rank") - F.col("until") + F.col("n")).alias("left"))
    same = F.col("high") == F.col("_high")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    second = d.groupBy(*keys, "high", "low").agg(F.count(F.lit(1)).alias("n")).join(bins, same)
    w = Window.partitionBy(*keys, "name").orderBy("low")
    found = second.withColumn("until", F.sum("n").over(w)).where((F.col("until") >= F.col("left")) & (F.col("until") - F.col("n") < F.col("left")))
    value = F.col("high") * 256 + F.col("low")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in shares])


def area_targets(roi: DataFrame, targets: DataFrame, rounds: int = 30, tolerance: float = 100.0) -> DataFrame:
    """Masks of wanted areas around a point, by moving a threshold.

    ``roi``: image, y, x, v of one region each. ``targets``: image, cy, cx, start (threshold to begin with), target (pixels),
    floor (least threshold, may be null). In each round the pixels above the threshold are labelled (8 neighbours), the
    component at (cy, cx) is taken, or else the nearest one, and the threshold moves by its relative error in area, less and
    less. The first mask within ``tolerance`` pixels of the target wins, else the closest. Returns image, target, y, x.
    Many regions of interest a call; each is bounded in size by its crop.
    """

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        wanted = table.column("target").is_valid().to_numpy()
        rows, targets_, ys, xs = [], [], [], []
        for i, j in batches.spans(table, starts):
            part, own = table.slice(i, j - i), wanted[i:j]
            if own.all():
                continue
            y, x, v = (part.column(c).combine_chunks().filter(pa.array(~own)).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
            y0, x0 = int(y.min()), int(x.min())
            window = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
            window[y.astype(int) - y0, x.astype(int) - x0] = v
            grown: dict = {}
            for t in part.filter(pa.array(own)).select(["cy", "cx", "start", "target", "floor"]).to_pylist():
                place = int(t["cy"]), int(t["cx"])
                if place not in grown:
                    grown[place] = Window2D(window, place[0] - y0, place[1] - x0)
                floor = None if t["floor"] is None or t["floor"] != t["floor"] else t["floor"]
                found_y, found_x = grown[place].mask(t["start"], t["target"], floor, rounds, tolerance)
                ys.append(found_y + y0)
                xs.append(found_x + x0)
                targets_.append(t["target"])
                rows.append(i)
        n = [len(c) for c in ys]
        none = np.zeros(0, int)
        y, x = (np.concatenate([none, *c]).astype(np.int32) for c in (ys, xs))
        at = np.repeat(np.array(rows, int), n)
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", at), pa.array(np.repeat(np.array(targets_, float), n)), pa.array(y), pa.array(x)], ["image", "target", "y", "x"])

    kind = roi.schema["image"].dataType.simpleString()
    names = ("cy", "cx", "start", "target", "floor")
    pixels = roi.select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    both = pixels.unionByName(targets.select("image", *[F.col(c).cast("double").alias(c) for c in names]), allowMissingColumns=True)
    return batches.apply(both, ["image"], run, f"image {kind}, target double, y int, x int")


#: Fixed value: a move of the threshold below this ends the search.
LEAST_MOVE = 0.1


class Window2D:
    """The surroundings of a cell (NaN: no pixel), and its components above any level; what was labelled once is remembered."""

    def __init__(self, window, cy: int, cx: int):
        import numpy as np

        self.window, self.values = window, np.sort(window[~np.isnan(window)])
        y, x = np.nonzero(~np.isnan(window))
        near = np.lexsort((x, y, (y - cy) ** 2 + (x - cx) ** 2))
        self.near = y[near], x[near]
        self.found: dict = {}

    def otsu(self, bins: int = 256) -> float:
        """As ``otsu``: centre of the lowest of the best bins; the value less one where all are equal."""
        import numpy as np

        lo, hi = self.values[0], self.values[-1]
        if hi <= lo:
            return float(lo - 1)
        n = np.bincount(np.minimum(bins - 1, np.floor((self.values - lo) / (hi - lo) * bins)).astype(int), minlength=bins)
        w1, m1 = np.cumsum(n), np.cumsum(n * (2 * np.arange(bins) + 1))
        w2, m2 = w1[-1] - w1, m1[-1] - m1
        with np.errstate(invalid="ignore", divide="ignore"):
            between = np.where((w1 > 0) & (w2 > 0) & (n > 0), w1 * w2 * (m1 / w1 - m2 / w2) ** 2, -1.0)
        return float(lo + (int(between.argmax()) + 0.5) * (hi - lo) / bins)

    def component(self, level: float):
        """Runs (starts, ends) of the component above ``level`` at the centre, or at the pixel above it that is nearest to the centre."""
        import numpy as np

        from somatica.operators.morphology import run_labels

        # all levels between two values give the same pixels
        rank = int(np.searchsorted(self.values, level, "right"))
        if rank not in self.found:
            on = self.window > level
            starts, ends, root = run_labels(on)
            y, x = self.near
            first = int(on[y, x].argmax())
            at = np.searchsorted(starts, y[first] * (on.shape[1] + 2) + x[first] + 1, "right") - 1 if len(starts) else 0
            same = root == root[at] if len(starts) else np.zeros(0, bool)
            self.found[rank] = starts[same], ends[same]
        return self.found[rank]

    def mask(self, start: float, target: float, floor: float | None, rounds: int, tolerance: float):
        """Rows and columns of the component whose area comes closest to ``target``, or first within ``tolerance`` of it."""
        import numpy as np

        if not len(self.values):
            return np.zeros(0, int), np.zeros(0, int)
        least, top = self.values[0] if floor is None else floor, self.values[-1]
        tried, level = [], start if floor is None else max(start, floor)
        for n in range(1, rounds + 1):
            starts, ends = self.component(level)
            miss = int((ends - starts).sum()) - target
            tried.append((abs(miss), n, level))
            move = level * miss / (n * target)
            if abs(miss) <= tolerance or abs(move) < LEAST_MOVE:
                break
            level = float(np.minimum(np.maximum(level + move, least), top))
        starts, ends = self.component(min(tried)[2])
        n = ends - starts
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        w = self.window.shape[1] + 2
        return at // w, at % w - 1
