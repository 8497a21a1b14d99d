"""Queries on pixel relations, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.operators import background, boxes, bulbs, distance, hull, masks, morphology, pixels, regions, sholl, skeleton, thresholds, vessels
from somatica.plans import bindings as b
from somatica.plans.cell_queries import rounded
from somatica.sources import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def small_mask(spark, sf_dir) -> DataFrame:
    return pixels.threshold(b.px_small(spark, sf_dir), 0.0)


def big_mask(spark, sf_dir, above: float = 30000.0) -> DataFrame:
    return pixels.threshold(b.px_big(spark, sf_dir), above)


SMALL = f"{b.PX_SMALL}, m AS (SELECT image, y, x FROM px WHERE v > 0)"
BIG = f"{b.PX_BIG}, m AS (SELECT image, y, x FROM px WHERE v > 30000)"


@query(f"WITH {b.PX_BIG} SELECT * FROM px")
def px_projection(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.lit(0).alias("c"), F.col("l_linenumber").alias("z"), (F.col("l_partkey") % 32).cast("int").alias("y"), (F.col("l_orderkey") % 32).cast("int").alias("x"), F.col("l_extendedprice").alias("v"))
    return pixels.project_max(li).drop("c")


@query(f"WITH {b.PX_SMALL} SELECT image, y, x, CAST(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE floor(v) END AS INTEGER) AS v FROM (SELECT *, min(v) OVER (PARTITION BY image) AS lo, max(v) OVER (PARTITION BY image) AS hi FROM px)")
def px_rescale(spark, sf_dir):
    return pixels.rescale(b.px_small(spark, sf_dir))


def _rgb(spark, sf_dir) -> DataFrame:
    p = b.px_big(spark, sf_dir)
    return p.select("image", "y", "x", F.posexplode(F.array(F.floor(F.col("v")) % 200, F.floor(F.col("v")) % 90, F.floor(F.col("v")) % 256)).alias("c", "v"))


_RGB = f"{b.PX_BIG}, rgb AS (SELECT image, y, x, CAST(floor(v) AS BIGINT) % 200 AS r, CAST(floor(v) AS BIGINT) % 90 AS g, CAST(floor(v) AS BIGINT) % 256 AS b FROM px)"


@query(f"WITH {_RGB} SELECT image, y, x, CAST(floor(round(r * 0.2125 + g * 0.7154 + b * 0.0721, 6)) AS INTEGER) AS v FROM rgb")
def px_luminance(spark, sf_dir):
    return pixels.luminance(_rgb(spark, sf_dir).withColumn("v", F.col("v") / 255.0))


@query(f"WITH {_RGB}, u AS (SELECT *, least(r, b) AS f FROM rgb) SELECT image, y, x, unnest([0, 1, 2, 3]) AS c, unnest([greatest(b - f, 0), g, greatest(r - f, 0), f]) AS v FROM u")
def px_unmix(spark, sf_dir):
    return pixels.unmix_magenta(_rgb(spark, sf_dir)).drop("is_estimated")


_SHOW = "CAST(floor(greatest(0.0, least(255.0, {}))) AS INTEGER) AS v FROM (SELECT *, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 255.0 ELSE 0.0 END AS s FROM (SELECT *, min(v) OVER (PARTITION BY image) AS lo, max(v) OVER (PARTITION BY image) AS hi FROM px))"


@query(f"WITH {b.PX_SMALL} SELECT image, y, x, " + _SHOW.format("(s - 127.5) * (1 + 2 * 40.0 / 100) + 127.5 + 1.5 * 10.0"))
def px_display(spark, sf_dir):
    return pixels.display(b.px_small(spark, sf_dir), 10.0, 40.0)


@query(f"WITH {b.PX_SMALL} SELECT image, y, x, " + _SHOW.format("(s + 1.5 * -10.0 - 127.5) * (1 + 0.9 * -40.0 / 100) + 127.5"))
def px_display_colour(spark, sf_dir):
    return pixels.display(b.px_small(spark, sf_dir), -10.0, -40.0, brightness_first=True)


@query(f"WITH {_RGB}, l AS (SELECT image, y, x, unnest([0, 1, 2]) AS c, CAST(unnest([r, g, b]) AS DOUBLE) AS v FROM rgb) SELECT l.image, l.c, l.y, l.x, CASE WHEN l.c = 0 THEN 0.0 WHEN l.c = 1 THEN coalesce(p.v, l.v) ELSE l.v END AS v FROM l LEFT JOIN (SELECT * FROM px WHERE v > 60000) p USING (image, y, x)")
def px_composite(spark, sf_dir):
    d = _rgb(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return pixels.composite(d, 1, b.px_big(spark, sf_dir).where("v > 60000"), [1, 2])


@query(f"WITH {_RGB} SELECT image, y, x, g AS v FROM rgb")
def px_channel(spark, sf_dir):
    return pixels.select_channel(_rgb(spark, sf_dir), 2, 3)


@query(f"WITH {b.PX_BIG}, c AS (SELECT DISTINCT image, image % 4 AS cell, image % 32 AS cy, (image * 7) % 32 AS cx FROM px) SELECT image, y, x, v, cell FROM px JOIN c USING (image) WHERE abs(y - cy) <= 5 AND abs(x - cx) <= 5")
def px_crop(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    c = p.select("image").distinct().select("image", (F.col("image") % 4).alias("cell"), (F.col("image") % 32).alias("cy"), (F.col("image") * 7 % 32).alias("cx"))
    return pixels.crop(p, c, 5)


_MIRROR = """place AS (SELECT image, v, p AS py, q AS qx FROM px, LATERAL (SELECT unnest([y, -1 - y, 15 - y]) AS p), LATERAL (SELECT unnest([x, -1 - x, 15 - x]) AS q))"""


@query(f"WITH {b.PX_SMALL}, {_MIRROR}, o AS (SELECT a.d AS dy, c.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) c(d)) SELECT image, CAST(py - dy AS INTEGER) AS y, CAST(qx - dx AS INTEGER) AS x, round(median(v), 6) AS v FROM place, o WHERE py - dy BETWEEN 0 AND 7 AND qx - dx BETWEEN 0 AND 7 GROUP BY ALL")
def px_median(spark, sf_dir):
    return rounded(pixels.median_filter(b.px_small(spark, sf_dir), 3, 8, 8))


def _gauss_sql(sigma: float, reach: float = 4.0) -> str:
    r = int(reach * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    w = ", ".join(f"({k}, {v / sum(raw)!r})" for k, v in zip(range(-r, r + 1), raw, strict=True))
    along = "SELECT image, {y} AS y, {x} AS x, sum(v * w) AS v FROM (SELECT image, y, x, v, unnest([{p}, -1 - {p}, 15 - {p}]) AS p FROM {t}), k WHERE p - d BETWEEN 0 AND 7 GROUP BY ALL"
    return f"k(d, w) AS (VALUES {w}), g1 AS ({along.format(y='p - d', x='x', p='y', t='px')}), g2 AS ({along.format(y='y', x='p - d', p='x', t='g1')})"


@query(f"WITH {b.PX_SMALL}, {_gauss_sql(1.0, 3.0)} SELECT image, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 6) AS v FROM g2")
def px_gaussian(spark, sf_dir):
    return rounded(pixels.gaussian(b.px_small(spark, sf_dir), 1.0, 8, 8, 3.0))


@query(f"WITH {b.PX_SMALL}, {_gauss_sql(2.0)} SELECT image, px.y, px.x, round(greatest(0.0, least(255.0, px.v + 1.3 * (px.v - g2.v))), 6) AS v FROM px JOIN g2 USING (image) WHERE px.y = g2.y AND px.x = g2.x")
def px_unsharp(spark, sf_dir):
    return rounded(pixels.unsharp(b.px_small(spark, sf_dir), 1.3, 8, 8))


@query(f"""WITH {SMALL}, e AS (SELECT image, cell, py AS y1, qx AS x1, lead(py, 1, first) OVER w AS y2, lead(qx, 1, firstx) OVER w AS x2 FROM (SELECT *, first_value(py) OVER (PARTITION BY image ORDER BY seq) AS first, first_value(qx) OVER (PARTITION BY image ORDER BY seq) AS firstx FROM
 (SELECT image, 1 AS cell, unnest([0, 1, 2, 3]) AS seq, unnest([0.5, 1.5 + image % 3, 6.5, 5.5]) AS py, unnest([0.5, 6.5, 5.5 - image % 2, 0.5]) AS qx FROM (SELECT DISTINCT image FROM px))) WINDOW w AS (PARTITION BY image ORDER BY seq))
 SELECT image, cell, y, x FROM px JOIN e USING (image) WHERE (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x GROUP BY ALL HAVING count(*) % 2 = 1""")
def px_polygon(spark, sf_dir):
    p = b.px_small(spark, sf_dir)
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), y.alias("py"), x.alias("px")) for k, (y, x) in enumerate([(F.lit(0.5), F.lit(0.5)), (1.5 + F.col("image") % 3, F.lit(6.5)), (F.lit(6.5), 5.5 - F.col("image") % 2), (F.lit(5.5), F.lit(0.5))])])
    polygons = p.select("image").distinct().select("image", F.lit(1).alias("cell"), F.explode(corners).alias("p")).select("image", "cell", "p.*")
    return pixels.in_polygon(p, polygons)


def _off(offsets) -> str:
    return "o(dy, dx) AS (VALUES " + ", ".join(f"({a}, {c})" for a, c in offsets) + ")"


@query(f"WITH {SMALL}, {_off(morphology.cross(2))} SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM m, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7")
def mask_dilate(spark, sf_dir):
    return morphology.dilate(small_mask(spark, sf_dir), morphology.cross(2), 8, 8)


@query(f"WITH {SMALL}, {_off(morphology.cross(1))} SELECT image, y - dy AS y, x - dx AS x FROM m, o GROUP BY ALL HAVING count(*) = 5")
def mask_erode(spark, sf_dir):
    return morphology.erode(small_mask(spark, sf_dir), morphology.cross(1))


@query(f"WITH {BIG}, {_off(morphology.disk(2))}, d AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM m, o WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31) SELECT image, y - dy AS y, x - dx AS x FROM d, o GROUP BY ALL HAVING count(*) = 13")
def mask_close(spark, sf_dir):
    return morphology.close(big_mask(spark, sf_dir), morphology.disk(2), 32, 32)


@query(f"WITH {BIG}, {_off(morphology.disk(1))}, e AS (SELECT image, y - dy AS y, x - dx AS x FROM m, o GROUP BY ALL HAVING count(*) = 5) SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM e, o")
def mask_open(spark, sf_dir):
    return morphology.open_(big_mask(spark, sf_dir), morphology.disk(1))


_TWO = f"{b.PX_BIG}, m AS (SELECT image, y, x FROM px WHERE v > 30000), n AS (SELECT image, y, x FROM px WHERE CAST(floor(v) AS BIGINT) % 2 = 0)"


@query(f"WITH {_TWO} SELECT 'union' AS op, image, y, x FROM (SELECT * FROM m UNION SELECT * FROM n) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM m INTERSECT SELECT * FROM n) UNION ALL SELECT 'subtract', * FROM (SELECT * FROM m EXCEPT SELECT * FROM n)")
def mask_sets(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    m, n = pixels.threshold(p, 30000.0), p.where(F.floor("v") % 2 == 0).select("image", "y", "x")
    tag = lambda d, op: d.withColumn("op", F.lit(op))
    return tag(morphology.union(m, n), "union").unionByName(tag(morphology.intersect(m, n), "intersect")).unionByName(tag(morphology.subtract(m, n), "subtract"))


@query(f"WITH {SMALL}, {_off(morphology.EIGHT)}, s AS (SELECT image, y + dy AS y, x + dx AS x, count(*) AS degree FROM m, o GROUP BY ALL) SELECT m.image, m.y, m.x, coalesce(degree, 0) AS degree FROM m LEFT JOIN s USING (image, y, x)")
def mask_degrees(spark, sf_dir):
    return morphology.degrees(small_mask(spark, sf_dir))


@query(f"WITH {SMALL}, {_off(morphology.FOUR)}, s AS (SELECT image, y + dy AS y, x + dx AS x, count(*) AS degree FROM m, o GROUP BY ALL) SELECT m.image, m.y, m.x FROM m LEFT JOIN s USING (image, y, x) WHERE coalesce(degree, 0) < 4")
def mask_boundary(spark, sf_dir):
    return morphology.boundary(small_mask(spark, sf_dir))


def _reach(near: str) -> str:
    return f"""RECURSIVE {SMALL}, r AS (SELECT image, y, x, y * 65536 + x AS label FROM m UNION SELECT m.image, m.y, m.x, r.label FROM r JOIN m ON m.image = r.image AND {near})"""


_EIGHT = "abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1"
_FOUR = "abs(m.y - r.y) + abs(m.x - r.x) <= 1"


@query(f"WITH {_reach(_EIGHT)} SELECT image, y, x, min(label) AS label FROM r GROUP BY ALL")
def components_8(spark, sf_dir):
    return morphology.components(small_mask(spark, sf_dir), True)


@query(f"WITH {_reach(_FOUR)} SELECT image, y, x, min(label) AS label FROM r GROUP BY ALL")
def components_4(spark, sf_dir):
    return morphology.components(small_mask(spark, sf_dir), False)


@query(f"WITH {_reach(_FOUR)}, l AS (SELECT image, y, x, min(label) AS label FROM r GROUP BY ALL) SELECT image, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image, label) AS n FROM l) WHERE n >= 4")
def despeckled(spark, sf_dir):
    return morphology.despeckle(small_mask(spark, sf_dir), 4)


# labels sink to the smallest of the neighbourhood, 160 times; no shortest way in a 32 x 32 image of this density is longer
@query(f"""WITH RECURSIVE {BIG}, r AS (SELECT image, y, x, y * 65536 + x AS label, 0 AS i FROM m UNION ALL SELECT m.image, m.y, m.x, min(r.label), max(r.i) + 1 FROM r JOIN m ON m.image = r.image AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1 WHERE i < 160 GROUP BY m.image, m.y, m.x)
 SELECT image, CAST(label AS BIGINT) AS label, count(*) AS size FROM r WHERE i = 160 GROUP BY ALL""")
def components_big(spark, sf_dir):
    return morphology.component_sizes(morphology.components(big_mask(spark, sf_dir)))


_MOMENTS = """s AS (SELECT image, count(*) AS n_px, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS a, covar_pop(y, x) AS b, var_pop(x) AS c FROM m GROUP BY 1),
 q AS (SELECT *, 4 * sqrt(greatest((a + c) / 2 + sqrt(4 * b * b + (a - c) * (a - c)) / 2, 0)) AS major, 4 * sqrt(greatest((a + c) / 2 - sqrt(4 * b * b + (a - c) * (a - c)) / 2, 0)) AS minor FROM s)"""


@query(f"WITH {BIG}, {_MOMENTS} SELECT image, n_px, round(cy, 6) AS cy, round(cx, 6) AS cx, round(major, 6) AS major, round(minor, 6) AS minor, round(n_px * 0.09, 6) AS area_um2, round(coalesce(sqrt(greatest(1 - (minor / nullif(major, 0)) ** 2, 0)), 0), 6) AS eccentricity, round(coalesce((minor / nullif(major, 0)) ** 2, 0), 6) AS roundness, round(coalesce(major / nullif(minor, 0), 0), 6) AS aspect_ratio FROM q")
def region_moments(spark, sf_dir):
    return rounded(regions.moments(big_mask(spark, sf_dir), 0.3))


@query(f"""WITH {SMALL}, c AS (SELECT image, avg(y) AS cy, avg(x) AS cx, arg_min([y, x], y * 100 + x) AS t, arg_min([y, x], -y * 100 + x) AS u, arg_min([y, x], x * 100 + y) AS l, arg_min([y, x], -x * 100 + y) AS r FROM m GROUP BY 1)
 SELECT image, round((sqrt((t[1] - cy) ** 2 + (t[2] - cx) ** 2) + sqrt((u[1] - cy) ** 2 + (u[2] - cx) ** 2) + sqrt((l[1] - cy) ** 2 + (l[2] - cx) ** 2) + sqrt((r[1] - cy) ** 2 + (r[2] - cx) ** 2)) / 4 * 0.3, 6) AS average_centroid_distance FROM c""")
def region_spread(spark, sf_dir):
    return rounded(regions.spread_from_centroid(small_mask(spark, sf_dir), 0.3))


@query(f"""WITH {SMALL}, f(dy, dx, w) AS (VALUES (-1, 0, 2), (0, -1, 2), (0, 1, 2), (1, 0, 2), (-1, -1, 10), (-1, 1, 10), (1, -1, 10), (1, 1, 10)),
 n AS (SELECT m.image, m.y, m.x, count(k.y) AS n FROM m JOIN f ON w = 2 LEFT JOIN m k ON k.image = m.image AND k.y = m.y + dy AND k.x = m.x + dx GROUP BY ALL), b AS (SELECT image, y, x FROM n WHERE n < 4),
 c AS (SELECT b.image, b.y, b.x, 1 + sum(CASE WHEN k.y IS NOT NULL THEN w ELSE 0 END) AS code FROM b CROSS JOIN f LEFT JOIN b k ON k.image = b.image AND k.y = b.y + dy AND k.x = b.x + dx GROUP BY ALL)
 SELECT image, round(0.3 * sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM c GROUP BY 1""")
def region_perimeter(spark, sf_dir):
    return rounded(regions.perimeter(small_mask(spark, sf_dir), 0.3))


@query(f"""WITH {BIG}, {_MOMENTS}, c AS (SELECT image, avg(y) AS cy, avg(x) AS cx, arg_min([y, x], y * 100 + x) AS t, arg_min([y, x], -y * 100 + x) AS u, arg_min([y, x], x * 100 + y) AS l, arg_min([y, x], -x * 100 + y) AS r FROM m GROUP BY 1),
 sp AS (SELECT image, (sqrt((t[1] - cy) ** 2 + (t[2] - cx) ** 2) + sqrt((u[1] - cy) ** 2 + (u[2] - cx) ** 2) + sqrt((l[1] - cy) ** 2 + (l[2] - cx) ** 2) + sqrt((r[1] - cy) ** 2 + (r[2] - cx) ** 2)) / 4 * 0.3 AS spread FROM c),
 fo(dy, dx, w) AS (VALUES (-1, 0, 2), (0, -1, 2), (0, 1, 2), (1, 0, 2), (-1, -1, 10), (-1, 1, 10), (1, -1, 10), (1, 1, 10)),
 nb AS (SELECT m.image, m.y, m.x, count(k.y) AS n FROM m JOIN fo ON w = 2 LEFT JOIN m k ON k.image = m.image AND k.y = m.y + dy AND k.x = m.x + dx GROUP BY ALL), bo AS (SELECT image, y, x FROM nb WHERE n < 4),
 cd AS (SELECT bo.image, bo.y, bo.x, 1 + sum(CASE WHEN k.y IS NOT NULL THEN w ELSE 0 END) AS code FROM bo CROSS JOIN fo LEFT JOIN bo k ON k.image = bo.image AND k.y = bo.y + dy AND k.x = bo.x + dx GROUP BY ALL),
 pe AS (SELECT image, 0.3 * sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM cd GROUP BY 1)
 SELECT image, n_px, round(q.cy, 6) AS cy, round(q.cx, 6) AS cx, round(major, 6) AS major, round(minor, 6) AS minor, round(n_px * 0.09::DOUBLE, 6) AS area_um2, round(coalesce(sqrt(greatest(1 - (minor / nullif(major, 0)) ** 2, 0)), 0), 6) AS eccentricity,
  round(coalesce((minor / nullif(major, 0)) ** 2, 0), 6) AS roundness, round(CASE WHEN minor > 0 THEN major / minor ELSE 0 END, 6) AS aspect_ratio, round(spread, 6) AS average_centroid_distance, round(perimeter, 6) AS perimeter,
  round(CASE WHEN perimeter ** 2 > 0 THEN 4 * pi() * n_px * 0.09 / perimeter ** 2 ELSE 0 END, 6) AS circularity, round(CASE WHEN n_px > 0 THEN perimeter ** 2 / (4 * pi() * n_px * 0.09) ELSE 0 END, 6) AS transformation_index
 FROM q JOIN sp USING (image) LEFT JOIN pe USING (image)""")
def region_descriptors(spark, sf_dir):
    return rounded(regions.descriptors(big_mask(spark, sf_dir)))


_BOXES = f"""WITH {BIG}, s AS (SELECT unnest({boxes.box_sizes(32, 32)}) AS s), bx AS (SELECT image, s, y // s AS p, x // s AS q, count(*) AS c FROM m, s GROUP BY ALL),
 t AS (SELECT image, s, count(*) AS n, sum(c) AS c1, sum(c * c) AS c2, ceil(32.0 / s) ** 2 AS g FROM bx GROUP BY ALL), u AS (SELECT image, s, n, (c2 / g - (c1 / g) ** 2) / (c1 / g) ** 2 + 1 AS lacunarity FROM t)"""


@query(f"{_BOXES} SELECT image, CAST(s AS INTEGER) AS s, n, round(lacunarity, 6) AS lacunarity FROM u")
def box_counts(spark, sf_dir):
    return rounded(boxes.box_counts(big_mask(spark, sf_dir), 32, 32))


@query(f"{_BOXES} SELECT image, round(regr_slope(ln(n), -ln(s)), 6) AS fractal_dimension, round(regr_r2(ln(n), -ln(s)), 6) AS r2, count(*) AS scales, round(avg(lacunarity), 6) AS mean_lacunarity, round(arg_min(lacunarity, s), 6) AS first_lacunarity, round(arg_max(lacunarity, s), 6) AS last_lacunarity FROM u GROUP BY 1")
def box_dimension(spark, sf_dir):
    return rounded(boxes.dimension(boxes.box_counts(big_mask(spark, sf_dir), 32, 32)))


_OTSU = """rg AS (SELECT image, min(v) AS lo, max(v) AS hi FROM pos GROUP BY 1), bn AS (SELECT image, lo, hi, CASE WHEN hi > lo THEN least(255, CAST(floor((v - lo) / (hi - lo) * 256) AS INTEGER)) ELSE 0 END AS bin FROM pos JOIN rg USING (image)),
 h AS (SELECT image, lo, hi, bin, count(*) AS n FROM bn GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS w1, sum(n * (2 * bin + 1)) OVER w AS m1, sum(n) OVER (PARTITION BY image) AS wt, sum(n * (2 * bin + 1)) OVER (PARTITION BY image) AS mt FROM h WINDOW w AS (PARTITION BY image ORDER BY bin)),
 sc AS (SELECT *, coalesce(w1 * (wt - w1) * (m1 / w1 - (mt - m1) / nullif(wt - w1, 0)) ** 2, -1) AS b FROM c),
 th AS (SELECT image, CASE WHEN hi > lo THEN lo + (bin + 0.5) * (hi - lo) / 256 ELSE lo - 1 END AS threshold FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY image ORDER BY b DESC, bin) = 1))"""


@query(f"WITH {b.PX_BIG}, pos AS (SELECT * FROM px WHERE v > 0), {_OTSU} SELECT image, round(threshold, 6) AS threshold FROM th")
def otsu_threshold(spark, sf_dir):
    return rounded(thresholds.otsu(b.px_big(spark, sf_dir).where("v > 0")))


_VESSEL = f"{b.PX_BIG}, m AS (SELECT image, y, x FROM px WHERE v > 60000), dist AS (SELECT p.image, p.y, p.x, p.v, sqrt(min((p.y - m.y) ** 2 + (p.x - m.x) ** 2)) AS d FROM px p JOIN m USING (image) GROUP BY ALL)"


@query(f"WITH {_VESSEL} SELECT image, y, x, round(d, 6) AS d FROM dist")
def nearest_vessel(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    return rounded(distance.nearest(p, pixels.threshold(p, 60000.0)))


@query(f"""WITH {SMALL}, f AS (SELECT y.i AS y, x.i AS x FROM range(8) y(i), range(8) x(i)), z AS (SELECT i.image, f.y, f.x FROM (SELECT DISTINCT image FROM m) i CROSS JOIN f ANTI JOIN m ON m.image = i.image AND m.y = f.y AND m.x = f.x)
 SELECT m.image, m.y, m.x, round(sqrt(min((m.y - z.y) ** 2 + (m.x - z.x) ** 2)), 6) AS d FROM m LEFT JOIN z USING (image) GROUP BY m.image, m.y, m.x""")
def distance_transform(spark, sf_dir):
    return rounded(distance.to_background(small_mask(spark, sf_dir), 8, 8))


@query(f"WITH {_VESSEL} SELECT image, round(coalesce(avg(v) FILTER (d > 0 AND d <= 2), 0), 6) AS perivasc_0_2um_mean, round(coalesce(avg(v) FILTER (d > 2 AND d <= 4), 0), 6) AS perivasc_2_4um_mean, round(coalesce(avg(v) FILTER (d > 4 AND d <= 8), 0), 6) AS perivasc_4_8um_mean FROM dist GROUP BY 1 HAVING count(*) FILTER (d > 0 AND d <= 8) > 0")
def ring_means(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    return rounded(vessels.ring_means(p, pixels.threshold(p, 60000.0), 1.0, (0, 2, 4, 8)))


@query(f"""WITH {_VESSEL}, t AS (SELECT px.*, m.image IS NOT NULL AS inside FROM px LEFT JOIN m USING (image, y, x)), lv AS (SELECT image, median(v) AS level, avg(v) AS intra FROM t WHERE inside GROUP BY 1),
 ot AS (SELECT t.image, avg(v) AS extra, avg(CASE WHEN v > coalesce(level, 0) THEN 1.0 ELSE 0 END) AS fraction FROM t LEFT JOIN lv USING (image) WHERE NOT inside GROUP BY 1)
 SELECT i.image, round(coalesce(intra, 0), 6) AS intravascular_mean, round(coalesce(extra, 0), 6) AS extravascular_mean, round(CASE WHEN intra > 0 THEN coalesce(extra, 0) / intra ELSE 0 END, 6) AS leakage_index, round(coalesce(fraction, 0), 6) AS extravascular_area_fraction FROM (SELECT DISTINCT image FROM px) i LEFT JOIN lv USING (image) LEFT JOIN ot USING (image)""")
def leakage(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    return rounded(vessels.leakage(p, pixels.threshold(p, 60000.0)))


def _centres(spark, sf_dir) -> DataFrame:
    i = b.px_big(spark, sf_dir).select("image").distinct()
    return i.select("image", F.explode(F.array(F.lit(0), F.lit(1))).alias("cell")).withColumns({"cy": (F.col("image") + 11 * F.col("cell")) % 32, "cx": (F.col("image") * 7 + 5 * F.col("cell")) % 32})


_DISK = f"ce AS (SELECT image, cell, (image + 11 * cell) % 32 AS cy, (image * 7 + 5 * cell) % 32 AS cx FROM (SELECT DISTINCT image FROM px), (VALUES (0), (1)) c(cell)), {_off(morphology.disk(4))}, so AS (SELECT image, cell, cy + dy AS y, cx + dx AS x FROM ce, o WHERE cy + dy BETWEEN 0 AND 31 AND cx + dx BETWEEN 0 AND 31)"


@query(f"WITH {b.PX_BIG}, {_DISK} SELECT * FROM so")
def soma_disk(spark, sf_dir):
    return vessels.soma_disk(_centres(spark, sf_dir), 32, 32, 1.5)


@query(f"""WITH {_VESSEL}, {_DISK}, cp AS (SELECT so.image, so.cell, so.y, so.x, px.v, d, d = 0 AS onv FROM so JOIN px USING (image, y, x) LEFT JOIN dist USING (image, y, x))
 SELECT image, cell, round(min(d) * 1.5, 6) AS dist_to_vessel_um, round(coalesce(avg(v) FILTER (onv IS NOT TRUE), avg(v)), 6) AS exposure_mean, round(avg(CASE WHEN onv THEN 1.0 ELSE 0 END), 6) AS vessel_contact_fraction FROM cp GROUP BY ALL""")
def cell_exposure(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    v = pixels.threshold(p, 60000.0)
    cell = vessels.soma_disk(_centres(spark, sf_dir), 32, 32, 1.5).join(p.select("image", "y", "x"), ["image", "y", "x"], "left_semi")
    return rounded(vessels.exposure(cell, p, v, cell.limit(0), 1.5))


@query(f"""WITH {BIG}, nm AS (SELECT image, CAST(200 + 100 * (image % 3 + (y + x) % 4) AS INTEGER) AS area, y, x FROM m), ar AS (SELECT DISTINCT image, area FROM nm) SELECT image, a.area, y, x FROM (SELECT image, y, x, min(area) AS first FROM nm GROUP BY ALL) f JOIN ar a USING (image) WHERE a.area >= first""")
def nested_union(spark, sf_dir):
    m = big_mask(spark, sf_dir)
    return masks.nest(m.withColumn("area", (200 + 100 * (F.col("image") % 3 + (F.col("y") + F.col("x")) % 4)).cast("int")))


@query()
def nested_masks(spark, sf_dir):
    p = b.px_big(spark, sf_dir)
    c = p.select("image").distinct().select("image", F.lit(16).alias("cy"), F.lit(16).alias("cx"))
    found = masks.nested_masks(p, c, 1.0, (40, 80, 160, 320), tolerance=5.0)
    return found.groupBy("image", "area").agg(F.count(F.lit(1)).alias("n"))


@query()
def vessel_network(spark, sf_dir):
    v = vessels.vessel_mask(b.px_big(spark, sf_dir), 32, 32, 1.0)
    return rounded(vessels.network(v, skeleton.thin(v), 32, 32, 1.0))


def _hull_sql(points: str) -> str:
    """Hull edges ``e`` (from p to q, nothing to the right of them) and numbered corners ``h`` of the points (image, y, x)."""
    return f"""pt AS ({points}), e AS (SELECT p.image, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx FROM pt p JOIN pt q ON p.image = q.image AND (p.y, p.x) <> (q.y, q.x) JOIN pt r ON r.image = p.image GROUP BY ALL
  HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) <= 0))),
 c AS (SELECT image, py AS y, px AS x, avg(py) OVER w AS my, avg(px) OVER w AS mx, row_number() OVER (PARTITION BY image ORDER BY px, py) = 1 AS fst FROM e WINDOW w AS (PARTITION BY image)),
 g AS (SELECT *, atan2(y - my, x - mx) AS angle, max(CASE WHEN fst THEN atan2(y - my, x - mx) END) OVER (PARTITION BY image) AS a0 FROM c),
 h AS (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY CASE WHEN fst THEN -1 WHEN angle < a0 THEN angle - a0 + 2 * pi() ELSE angle - a0 END) - 1 AS INTEGER) AS seq, y, x FROM g)"""


_HULL = f"WITH {BIG}, {_hull_sql('SELECT image, y, min(x) AS x FROM m GROUP BY image, y UNION SELECT image, y, max(x) FROM m GROUP BY image, y')}"


@query(f"{_HULL} SELECT * FROM h")
def hull_vertices(spark, sf_dir):
    return hull.vertices(big_mask(spark, sf_dir))


@query(f"""{_HULL}, a AS (SELECT image, sum(px * qy - qx * py) / 2 AS area, sum(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS perimeter FROM e GROUP BY 1),
 f AS (SELECT i.image, i.y AS ya, i.x AS xa, j.y AS yb, j.x AS xb, sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2) AS d FROM h i JOIN h j ON i.image = j.image AND i.seq < j.seq QUALIFY row_number() OVER (PARTITION BY i.image ORDER BY (i.x - j.x) ** 2 + (i.y - j.y) ** 2 DESC, i.seq, j.seq) = 1),
 w AS (SELECT image, any_value(d) AS span, max((y * (xb - xa) - x * (yb - ya)) / d) - min((y * (xb - xa) - x * (yb - ya)) / d) AS width FROM h JOIN f USING (image) GROUP BY 1), n AS (SELECT image, count(*) AS n FROM m GROUP BY 1)
 SELECT image, round(area, 6) AS hull_area, round(perimeter, 6) AS hull_perimeter, round(4 * pi() * area / perimeter ** 2, 6) AS hull_circularity, round(n / area, 6) AS density, round(span, 6) AS span, round(width, 6) AS width, round(span / nullif(width, 0), 6) AS span_ratio
 FROM a JOIN w USING (image) JOIN n USING (image) WHERE area > 0""")
def hull_metrics(spark, sf_dir):
    m = big_mask(spark, sf_dir)
    return rounded(hull.measure(hull.vertices(m), m))


_WHOLE = _hull_sql("SELECT image, y + dy AS y, min(x) AS x FROM m, (VALUES (0), (1)) o(dy) GROUP BY ALL UNION SELECT image, y + dy, max(x) + 1 FROM m, (VALUES (0), (1)) o(dy) GROUP BY ALL")


@query(f"WITH {BIG}, {_WHOLE}, a AS (SELECT image, sum(px * qy - qx * py) / 2 AS area FROM e GROUP BY 1), n AS (SELECT image, count(*) AS n FROM m GROUP BY 1) SELECT image, round(n * 0.09, 6) AS mask_area, round(n / area, 6) AS mask_solidity FROM n JOIN a USING (image)")
def mask_solidity(spark, sf_dir):
    return rounded(hull.mask_shapes(big_mask(spark, sf_dir), 0.3).select("image", "mask_area", "mask_solidity"))


def _sholl_centres(spark, sf_dir) -> DataFrame:
    return big_mask(spark, sf_dir).select("image").distinct().select("image", F.lit(16).alias("cy"), F.lit(16).alias("cx"), F.lit(2.0).alias("r0"))


def _profiles(spark, sf_dir) -> DataFrame:
    return sholl.profile(big_mask(spark, sf_dir, 60000.0), _sholl_centres(spark, sf_dir))


_SHOLL = f"""WITH {b.PX_BIG}, d AS (SELECT image, y, x, sqrt((y - 16) ** 2 + (x - 16) ** 2) AS r, atan2(y - 16, x - 16) AS angle FROM px WHERE v > 60000 AND (y - 16) ** 2 + (x - 16) ** 2 >= 4),
 k AS (SELECT *, CAST(round(r - 2) AS INTEGER) AS k FROM d), g AS (SELECT *, angle - coalesce(lag(angle) OVER (PARTITION BY image, k ORDER BY angle, y, x), max(angle) OVER (PARTITION BY image, k) - 2 * pi()) AS gap FROM k),
 n AS (SELECT image, k, greatest(sum(CASE WHEN gap > 2.5 / greatest(2 + k, 1) THEN 1 ELSE 0 END), 1) AS n FROM g GROUP BY ALL), ra AS (SELECT image, min(k) AS a, max(k) AS b FROM n GROUP BY 1),
 ev AS (SELECT image, unnest(range(a, b + 1)) AS k FROM ra), pr AS (SELECT ev.image, 2.0 + ev.k AS radius, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ev LEFT JOIN n ON n.image = ev.image AND n.k = ev.k)"""


@query(f"{_SHOLL} SELECT * FROM pr")
def sholl_profile(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query(f"""{_SHOLL}, f AS (SELECT *, first_value(n) OVER (PARTITION BY image ORDER BY radius) AS fst FROM pr) SELECT image, max(fst) AS primary_branches, count(*) FILTER (n > 0) AS intersecting_radii, CAST(sum(n) AS BIGINT) AS sum_intersections, round(avg(n), 6) AS mean_intersections, round(median(n), 6) AS median_intersections,
 max(n) AS max_intersections, arg_min(radius, -n * 1000 + radius) AS max_radius, round(max(n) / nullif(max(fst), 0), 6) AS ramification_index, round(sum(radius * n) / sum(n), 6) AS centroid_radius, round(sum(n * n) / sum(n) / 2, 6) AS centroid_value, max(radius) FILTER (n > 0) AS enclosing_radius FROM f GROUP BY 1""")
def sholl_metrics(spark, sf_dir):
    return rounded(sholl.sampled_metrics(_profiles(spark, sf_dir)).drop("skewness", "kurtosis"))


@query(f"{_SHOLL}, q AS (SELECT image, radius AS r, ln(n / (pi() * radius ** 2)) AS l FROM pr WHERE n > 0) SELECT image, round(regr_slope(l, r), 6) AS semi_log_slope, round(regr_intercept(l, r), 6) AS semi_log_intercept, round(regr_slope(l, ln(r)), 6) AS log_log_slope, round(regr_intercept(l, ln(r)), 6) AS log_log_intercept FROM q GROUP BY 1")
def sholl_regressions(spark, sf_dir):
    return rounded(sholl.regressions(_profiles(spark, sf_dir)))


@query(f"{_SHOLL}, q AS (SELECT image, radius AS r, ln(n / (pi() * radius ** 2)) AS l, quantile_cont(radius, 0.1) OVER (PARTITION BY image) AS p, quantile_cont(radius, 0.9) OVER (PARTITION BY image) AS q FROM pr WHERE n > 0) SELECT image, round(regr_slope(l, r), 6) AS semi_log_slope, round(regr_intercept(l, r), 6) AS semi_log_intercept, round(regr_slope(l, ln(r)), 6) AS log_log_slope, round(regr_intercept(l, ln(r)), 6) AS log_log_intercept FROM q WHERE r BETWEEN p AND q GROUP BY 1")
def sholl_regressions_p10_p90(spark, sf_dir):
    return rounded(sholl.regressions(_profiles(spark, sf_dir), (10, 90)))


@query(f"""{_SHOLL}, c AS (SELECT image, n - avg(n) OVER (PARTITION BY image) AS d FROM pr), s AS (SELECT image, avg(d * d) AS s2, avg(d * d * d) AS s3, avg(d * d * d * d) AS s4 FROM c GROUP BY 1)
 SELECT image, round(s3 / nullif(s2, 0) ** 1.5, 6) AS skewness, round(s4 / nullif(s2, 0) ** 2 - 3, 6) AS kurtosis FROM s""")
def sholl_shape(spark, sf_dir):
    return rounded(sholl.sampled_metrics(_profiles(spark, sf_dir)).select("image", "skewness", "kurtosis"))


# R2 by orthogonal steps; the F tail I(1 - R2; (n - k - 1) / 2, k / 2) by finite sums from its two starting values
@query(f"""{_SHOLL}, a1 AS (SELECT image, radius AS x, n AS y, radius ** 2 AS x2, radius ** 3 AS x3 FROM pr), a2 AS (SELECT *, x2 - regr_slope(x2, x) OVER w * x AS p2 FROM a1 WINDOW w AS (PARTITION BY image)),
 a3 AS (SELECT *, x3 - regr_slope(x3, x) OVER w * x - regr_slope(x3, p2) OVER w * p2 AS p3 FROM a2 WINDOW w AS (PARTITION BY image)), r AS (SELECT image, count(*) AS m, regr_r2(y, x) AS r1, regr_r2(y, p2) AS r2, regr_r2(y, p3) AS r3 FROM a3 GROUP BY 1),
 q AS (SELECT image, m, unnest([1, 2, 3]) AS k, unnest([r1, r1 + r2, r1 + r2 + r3]) AS r2 FROM r), t AS (SELECT *, (m - k - 1) / 2.0 AS a, CASE WHEN (m - k - 1) % 2 = 0 THEN 1.0 ELSE 0.5 END AS a0, 1 - r2 AS x FROM q),
 h AS (SELECT *, CASE WHEN a0 = 1 THEN 1 - sqrt(1 - x) ELSE 2 / pi() * asin(sqrt(x)) END - coalesce(list_sum(list_transform(range(CAST(a - a0 AS BIGINT)), lambda j: exp((a0 + j) * ln(x) + 0.5 * ln(1 - x) - ln(a0 + j) - lgamma(a0 + j) - lgamma(0.5) + lgamma(a0 + j + 0.5)))), 0) AS half FROM t)
 SELECT image, CAST(k AS INTEGER) AS degree, round(r2, 6) AS r2, round(CASE k WHEN 1 THEN half WHEN 2 THEN x ** a ELSE half + exp(a * ln(x) + 0.5 * ln(1 - x) - ln(0.5) - lgamma(a) - lgamma(0.5) + lgamma(a + 0.5)) END, 6) AS p FROM h""")
def sholl_fits(spark, sf_dir):
    """R2 and significance of the first three degrees."""
    return rounded(sholl.fit_quality(_profiles(spark, sf_dir), 3))


@query()
def sholl_polynomial(spark, sf_dir):
    return rounded(sholl.best_polynomial(_profiles(spark, sf_dir)), 4)


@query()
def skeleton_pixels(spark, sf_dir):
    return skeleton.thin(big_mask(spark, sf_dir))


@query()
def skeleton_metrics(spark, sf_dir):
    return rounded(skeleton.graph_metrics(skeleton.thin(big_mask(spark, sf_dir)), 0.3))


@query()
def skeleton_longest_path(spark, sf_dir):
    return rounded(skeleton.longest_path(skeleton.without_loops(skeleton.thin(big_mask(spark, sf_dir))), 0.3))


@query(f"WITH {SMALL} SELECT image, y * 2 + dy AS y, x * 2 + dx AS x FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)")
def mask_upscaled(spark, sf_dir):
    return skeleton.upscale(small_mask(spark, sf_dir), 2)


@query()
def terminal_bulbs(spark, sf_dir):
    return bulbs.detect(morphology.close(big_mask(spark, sf_dir), morphology.disk(1), 32, 32), 32, 32, 0.5, open_radius=1)[1]


@query()
def terminal_bulbs_traced(spark, sf_dir):
    """Bulbs of cells with a traced soma, or a known soma area where the outline is missing; automatic opening."""
    m = scratch.written(morphology.close(big_mask(spark, sf_dir), morphology.disk(1), 32, 32))
    centre = (F.abs(F.col("y") - 16) <= 3) & (F.abs(F.col("x") - 16) <= 3)
    areas = m.groupBy("image").agg((F.count(F.lit(1)) / 20.0).alias("soma_area_um2"))
    return bulbs.detect(m, 32, 32, 0.3, outlines=m.where(centre & (F.col("image") % 2 == 0)), areas=areas)[1]


@query(f"WITH {b.PX_SMALL}, {_off(morphology.disk(2))} SELECT p.image, p.y, p.x, round(greatest(0.0, least(255.0, p.v - min(k.v + 2 - sqrt(4 - dy ** 2 - dx ** 2)))), 6) AS v FROM px p CROSS JOIN o JOIN px k ON k.image = p.image AND k.y = p.y + dy AND k.x = p.x + dx GROUP BY p.image, p.y, p.x, p.v")
def rolling_ball(spark, sf_dir):
    return rounded(background.rolling_ball(b.px_small(spark, sf_dir), 2, 8, 8))


@query(f"WITH {b.PX_SMALL}, {_off(morphology.disk(1))}, e AS (SELECT p.image, p.y, p.x, min(k.v) AS v FROM px p CROSS JOIN o JOIN px k ON k.image = p.image AND k.y = p.y + dy AND k.x = p.x + dx GROUP BY ALL) SELECT p.image, p.y, p.x, round(p.v - max(k.v), 6) AS v FROM px p CROSS JOIN o JOIN e k ON k.image = p.image AND k.y = p.y + dy AND k.x = p.x + dx GROUP BY p.image, p.y, p.x, p.v")
def top_hat(spark, sf_dir):
    return rounded(background.white_top_hat(b.px_small(spark, sf_dir), 1, 8, 8))
