"""Sholl profiles: how often the arbour crosses circles around the soma."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators import batches


def profile(mask: DataFrame, centres: DataFrame, step: float = 1.0) -> DataFrame:
    """Intersections at every radius: image, radius, n, trimmed to the radii from the first to the last crossing.

    ``centres``: image, cy, cx, r0 (soma radius). A pixel belongs to the circle nearest to it; along a circle, pixels whose
    angles are further apart than a pixel is wide begin a new arc, and the arcs are counted (windows over image and circle).
    """
    d = mask.join(centres, "image").withColumn("r", F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).where(F.col("r") >= F.col("r0"))
    d = d.withColumns({"k": F.round((F.col("r") - F.col("r0")) / step).cast("int"), "angle": F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))})
    w = Window.partitionBy("image", "k").orderBy("angle", "y", "x")
    whole = Window.partitionBy("image", "k")
    before = F.coalesce(F.lag("angle").over(w), F.max("angle").over(whole) - 2 * math.pi)
    reach = (1.5 + step) / F.greatest(F.col("r0") + F.col("k") * step, F.lit(1.0))
    arcs = d.withColumn("gap", F.col("angle") - before).withColumn("start", (F.col("gap") > reach).cast("int"))
    n = arcs.groupBy("image", "k", "r0").agg(F.greatest(F.sum("start"), F.lit(1)).alias("n"))
    ranges = n.groupBy("image", "r0").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    every = ranges.select("image", "r0", F.explode(F.sequence("a", "b")).alias("k"))
    return every.join(n.select("image", "k", "n"), ["image", "k"], "left").select("image", (F.col("r0") + F.col("k") * step).alias("radius"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def soma_centres(soma: DataFrame) -> DataFrame:
    """Where the circles begin: image, cy, cx (the soma's centroid in whole pixels) and r0 (radius of a disk of its area, in pixels)."""
    return soma.groupBy("image").agg(F.round(F.avg("y")).cast("int").alias("cy"), F.round(F.avg("x")).cast("int").alias("cx"), F.sqrt(F.count(F.lit(1)) / math.pi).alias("r0"))


def continuous(mask: DataFrame, centres: DataFrame) -> DataFrame:
    """Intersections of every circle around the soma: image, from_radius, to_radius, n, trimmed to the circles that meet the mask.

    Pixels are unit squares; n is the number of arcs that a circle shares with them. Every arc begins and ends at a side between a
    pixel of the mask and one outside, so n is half the crossings of such sides, which change only where a circle reaches or leaves
    one: a running sum over those radii, each side counted once. A circle that lies in the mask all around counts as one.
    Four times the squared radius is a whole number at every change, so nothing is lost to rounding. ``centres``: image, cy, cx (whole
    pixels), r0; smaller circles are left out.
    """
    d = mask.select("image", "y", "x").join(centres.select("image", "cy", "cx", "r0"), "image")
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    d = d.select("image", "y", "x", "cy", "cx", "r0", sides.alias("o")).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx")})
    open_ = d.join(mask.select("image", "y", "x"), ["image", "y", "x"], "left_anti")
    # the side lies half a pixel back; along it runs the other coordinate, from u - 1 to u + 1 in half pixels
    y, x = (2 * (F.col("y") - F.col("cy")) - F.col("o.dy")).cast("long"), (2 * (F.col("x") - F.col("cx")) - F.col("o.dx")).cast("long")
    across, along = F.when(F.col("o.dy") != 0, y).otherwise(x), F.when(F.col("o.dy") != 0, x).otherwise(y)
    both = F.when(along == 0, 2).otherwise(1)
    near, far = across * across + F.when(along == 0, F.lit(0)).otherwise((F.abs(along) - 1) * (F.abs(along) - 1)), across * across + (F.abs(along) + 1) * (F.abs(along) + 1)
    events = open_.select("image", "cy", "cx", "r0", F.explode(F.array(F.struct(near.alias("q"), both.alias("n")), F.struct(far.alias("q"), (-both).alias("n")))).alias("e"))
    steps = events.groupBy("image", "cy", "cx", "r0", "e.q").agg(F.sum("e.n").alias("n"))
    order = Window.partitionBy("image").orderBy("q")
    runs = steps.select("image", "cy", "cx", "r0", F.col("q").alias("a"), F.lead("q").over(order).alias("b"), (F.sum("n").over(order) / 2).cast("long").alias("n")).where("b is not null")
    first = steps.groupBy("image", "cy", "cx", "r0").agg(F.lit(0).cast("long").alias("a"), F.min("q").alias("b"), F.lit(0).cast("long").alias("n")).where("b > 0")
    runs = runs.unionByName(first).withColumn("a", F.greatest(F.col("a").cast("double"), 4 * F.col("r0") * F.col("r0"))).where("a < b")
    # a circle between two changes either lies in the mask or outside of it: one pixel of it tells
    at = runs.withColumns({"y": F.col("cy"), "x": (F.col("cx") + F.round(F.sqrt((F.col("a") + F.col("b")) / 2) / 2)).cast("int")})
    inside = mask.select("image", "y", "x", F.lit(1).alias("in"))
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(F.coalesce("in", F.lit(0))).cast("long")
    every = at.join(inside, ["image", "y", "x"], "left").select("image", F.col("a").alias("qa"), F.col("b").alias("qb"), n.alias("n"))
    w = Window.partitionBy("image")
    met = every.withColumns({"_lo": F.min(F.when(F.col("n") > 0, F.col("qa"))).over(w), "_hi": F.max(F.when(F.col("n") > 0, F.col("qb"))).over(w)}).where("qa >= _lo and qb <= _hi")
    return met.select("image", (F.sqrt("qa") / 2).alias("from_radius"), (F.sqrt("qb") / 2).alias("to_radius"), "n")


def sampled_metrics(profiles: DataFrame) -> DataFrame:
    """Metrics of the sampled profile of each image; the centroid (radius, value) is that of the area below the profile."""
    first = F.min_by("n", "radius")
    top = F.max("n")
    return profiles.groupBy("image").agg(
        first.alias("primary_branches"), F.count_if(F.col("n") > 0).alias("intersecting_radii"), F.sum("n").alias("sum_intersections"), F.avg("n").alias("mean_intersections"),
        F.percentile("n", F.lit(0.5)).alias("median_intersections"), F.skewness("n").alias("skewness"), F.kurtosis("n").alias("kurtosis"), top.alias("max_intersections"),
        F.min_by("radius", F.struct(-F.col("n"), "radius")).alias("max_radius"), (top / F.nullif(first, F.lit(0))).alias("ramification_index"),
        (F.sum(F.col("radius") * F.col("n")) / F.sum("n")).alias("centroid_radius"), (F.sum(F.col("n") * F.col("n")) / F.sum("n") / 2).alias("centroid_value"), F.max(F.when(F.col("n") > 0, F.col("radius"))).alias("enclosing_radius"),
    )


def regressions(profiles: DataFrame, percentiles: tuple[float, float] | None = None) -> DataFrame:
    """Slopes and intercepts of ln(n / circle area) over the radius and over its logarithm; radii without crossings are left out.

    With ``percentiles`` only radii between them count.
    """
    p = profiles.where("n > 0 and radius > 0")
    if percentiles:
        lo, hi = (v / 100 for v in percentiles)
        w = Window.partitionBy("image")
        p = p.withColumns({"_lo": F.percentile("radius", F.lit(lo)).over(w), "_hi": F.percentile("radius", F.lit(hi)).over(w)}).where(F.col("radius").between(F.col("_lo"), F.col("_hi")))
    y = F.ln(F.col("n") / (math.pi * F.col("radius") * F.col("radius")))
    x = F.ln("radius")
    return p.groupBy("image").agg(F.regr_slope(y, F.col("radius")).alias("semi_log_slope"), F.regr_intercept(y, F.col("radius")).alias("semi_log_intercept"), F.regr_slope(y, x).alias("log_log_slope"), F.regr_intercept(y, x).alias("log_log_intercept"))


_FIT = "array<struct<degree:int,alpha:double,beta:double,c:double,r2:double,p:double>>"

#: Radii of a stack of profiles that is worked on at a time, and points on which a curve's peak is looked for.
_STACK, _FINE = 1 << 18, 1001


def polynomial_fits(profiles: DataFrame, degrees: int = 30) -> DataFrame:
    """Least-squares polynomials of every degree up to ``degrees`` (two less than the radii at most): image, mean, lo, hi and ``fits``, an
    array of degree, r2, p and the coefficients; no row for profiles of fewer than three radii.

    The polynomials are built to be orthogonal over the profile's own radii (three-term recurrence, from sums over them), so each degree adds
    one term and nothing is solved again. p is the tail of the F test of the fit against a constant. Many profiles a call.
    """

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        for some, lo, hi, mean, size, fit in _stacks(table, starts, degrees):
            k, i = np.nonzero(fit["on"])
            k, i = k[order := np.lexsort((k, i))], i[order]
            p = beta_tail(np.maximum(1 - fit["r2"][k, i], 0.0), size[i] - k - 2, k + 1)
            fields = {"degree": pa.array((k + 1).astype(np.int32)), **{c: pa.array(fit[c][k, i]) for c in ("alpha", "beta", "c", "r2")}, "p": pa.array(p)}
            ends = np.concatenate([[0], np.cumsum(fit["on"].sum(axis=0))]).astype(np.int32)
            fits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            yield pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts[some]), pa.array(lo), pa.array(hi), pa.array(mean), pa.array(size.astype(np.int32)), fits], ["image", "lo", "hi", "mean", "radii", "fits"])

    return batches.apply(_points(profiles), ["image"], run, f"image {profiles.schema['image'].dataType.simpleString()}, lo double, hi double, mean double, radii int, fits {_FIT}")


def _points(profiles: DataFrame) -> DataFrame:
    return profiles.select("image", F.col("radius").cast("double").alias("r"), F.col("n").cast("double").alias("n"))


def _stacks(table, starts, degrees: int):
    """Fits of the groups of ``table`` (image, r, n) with three radii or more, in stacks of profiles of about one size: the groups, their first and
    last radius, mean and size, and by degree and profile whether there is a fit (``on``), its coefficients and r2."""
    import numpy as np

    size = np.diff(np.append(starts, table.num_rows))
    group, _ = batches.places(size)
    r, n = batches.numbers(table, "r"), batches.numbers(table, "n")
    order = np.lexsort((n, r, group))
    r, n = r[order], n[order]
    left = np.flatnonzero(size >= 3)
    left = left[np.argsort(size[left], kind="stable")]
    while len(left):
        fits = np.arange(1, len(left) + 1) * size[left] <= _STACK  # padded to the largest
        some, left = left[: max(1, int(fits.sum()))], left[max(1, int(fits.sum())) :]
        inside = np.arange(size[some].max())[:, None] < size[some]
        at = np.where(inside, starts[some] + np.arange(len(inside))[:, None], 0)
        lo, hi = r[starts[some]], r[starts[some] + size[some] - 1]
        mean = _sums(np.where(inside, n[at], 0.0)) / size[some]
        with np.errstate(all="ignore"):
            x = np.where(inside, (2 * r[at] - lo - hi) / (hi - lo), 0.0)
            yield some, lo, hi, mean, size[some], _orthogonal(x, np.where(inside, n[at] - mean, 0.0), inside, degrees)


def _sums(values):
    """Sums of columns, added up in order, so that they do not depend on how many columns there are."""
    import numpy as np

    return np.add.accumulate(values, axis=0)[-1]


def _orthogonal(x, y, inside, degrees: int) -> dict:
    """Fits of every column of ``y`` over ``x``, one row a degree; what lies outside of a profile is 0."""
    import numpy as np

    size = inside.sum(axis=0)
    most, spread = min(degrees, int(size.max()) - 2), _sums(y * y)
    now, before, norm, last, explained = inside.astype(float), np.zeros(x.shape), size.astype(float), np.zeros(len(size)), np.zeros(len(size))
    out = {k: np.zeros((most, len(size))) for k in ("alpha", "beta", "c", "r2")} | {"on": np.arange(1, most + 1)[:, None] <= size - 2}
    for k in range(most):
        alpha = _sums(x * now * now) / norm
        beta = np.where(last > 0, norm / last, 0.0)
        now, before, last = (x - alpha) * now - beta * before, now, norm
        norm = _sums(now * now)
        c = _sums(y * now) / norm
        explained = explained + c * c * norm
        for name, v in (("alpha", alpha), ("beta", beta), ("c", c), ("r2", np.where(spread > 0, explained / spread, 0.0))):
            out[name][k] = v
    return out


def beta_tail(x, m, n, terms: int = 200):
    """Regularised incomplete beta function at x with the parameters m / 2 and n / 2, arrays: the chance of an F statistic of n and m degrees
    of freedom that explains a share of 1 - x or more. By its continued fraction, from the side on which that converges."""
    import numpy as np

    ln_gamma = np.array([math.inf, *(math.lgamma(k / 2) for k in range(1, int(np.max(m + n, initial=0)) + 1))])
    straight = x < (m / 2 + 1) / ((m + n) / 2 + 2)
    a, b, z = np.where(straight, m, n) / 2, np.where(straight, n, m) / 2, np.where(straight, x, 1 - x)

    def tiny(u):
        return np.where(np.abs(u) < 1e-30, 1e-30, u)

    with np.errstate(all="ignore"):
        front = np.exp(ln_gamma[m + n] - ln_gamma[m] - ln_gamma[n] + a * np.log(z) + b * np.log(1 - z)) / a
        c, d = np.ones(len(z)), 1 / tiny(1 - (a + b) * z / (a + 1))
        h = d
        for k in range(1, terms + 1):
            was = h
            for step in (k * (b - k) * z / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * z / ((a + 2 * k) * (a + 2 * k + 1))):
                c, d = tiny(1 + step / c), 1 / tiny(1 + step * d)
                h = h * c * d
            if np.array_equal(h, was, equal_nan=True):
                break
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(straight, front * h, 1 - front * h)))


def fit_quality(profiles: DataFrame, degrees: int = 30) -> DataFrame:
    """image, degree, r2 and p of every polynomial."""
    return polynomial_fits(profiles, degrees).select("image", F.explode("fits").alias("f")).select("image", "f.degree", "f.r2", "f.p")


def best_polynomial(profiles: DataFrame, degrees: int = 30, least_r2: float = 0.7, most_p: float = 0.05) -> DataFrame:
    """Lowest degree whose least-squares polynomial explains ``least_r2`` of the profile with an F test of ``most_p`` or less: image,
    degree, r2, p, and the peak of the curve on 1,001 radii (critical_value, critical_radius). Nulls if none does, also for
    profiles of fewer than three radii. Many profiles a call; the test is made only where the share is enough."""
    names = ("degree", "r2", "p", "critical_value", "critical_radius")

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        found = {c: np.zeros(len(starts)) for c in names}
        known = np.zeros(len(starts), bool)
        for some, lo, hi, mean, size, fit in _stacks(table, starts, degrees):
            k, i = np.nonzero(fit["on"] & (fit["r2"] >= least_r2))
            p = np.full(fit["r2"].shape, np.inf)
            p[k, i] = beta_tail(np.maximum(1 - fit["r2"][k, i], 0.0), size[i] - k - 2, k + 1)
            good = p <= most_p
            has = np.flatnonzero(good.any(axis=0))
            for i in np.array_split(has, -(-len(has) * _FINE // _STACK)) if len(has) else []:
                first = good[:, i].argmax(axis=0)
                value, at = _peaks({c: fit[c][: first.max() + 1, i] for c in ("alpha", "beta", "c")}, first, mean[i])
                values = (first + 1, fit["r2"][first, i], p[first, i], value, lo[i] + at / 1000.0 * (hi[i] - lo[i]))
                known[some[i]] = True
                for c, v in zip(names, values, strict=True):
                    found[c][some[i]] = v
        columns = [pa.array(found[c].astype(np.int32 if c == "degree" else float), mask=~known) for c in names]
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts), *columns], ["image", *names])

    return batches.apply(_points(profiles), ["image"], run, f"image {profiles.schema['image'].dataType.simpleString()}, degree int, r2 double, p double, critical_value double, critical_radius double")


def _peaks(fit: dict, first, mean):
    """Largest value of each column's polynomial of the degree in row ``first``, and where it is first met of 1,001 places from -1 to 1."""
    import numpy as np

    x = (np.arange(_FINE) / 500.0 - 1)[:, None]
    now, before, sum_ = np.ones((_FINE, len(mean))), np.zeros((_FINE, len(mean))), np.tile(mean, (_FINE, 1))
    for k, (alpha, beta, c) in enumerate(zip(fit["alpha"], fit["beta"], fit["c"], strict=True)):
        now, before = (x - alpha) * now - beta * before, now
        sum_ += np.where(k <= first, c, 0.0) * now
    return sum_.max(axis=0), sum_.argmax(axis=0)
