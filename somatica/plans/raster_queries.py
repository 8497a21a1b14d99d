"""Queries on tiles, many cells per image, TIFF folders, result sheets and the methods that came with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.operators import background, distance, masks, morphology, pixels, qa, sheets, sholl, statistics, thresholds, tiles, vessels
from somatica.plans import bindings as b
from somatica.plans import stages
from somatica.plans.cell_queries import classified, rounded
from somatica.plans.pixel_queries import _BOXES, _EIGHT, _HULL, _RGB, BIG, SMALL, _centres, _off, _reach, _rgb, big_mask, small_mask
from somatica.sources import tables, tiff_source
from somatica.sources.scratch import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _raster(spark, sf_dir, size: int) -> DataFrame:
    return tiles.from_pixels(b.px_big(spark, sf_dir), 32, 32, size)


_CELLS = "ce AS (SELECT image, cell, (image + 11 * cell) % 32 AS cy, (image * 7 + 5 * cell) % 32 AS cx FROM (SELECT DISTINCT image FROM px), (VALUES (0), (1)) c(cell))"


@query(f"WITH {b.PX_BIG}, {_CELLS} SELECT image, cell, y, x, v FROM px JOIN ce USING (image) WHERE y >= cy - 7 AND y < cy + 7 AND x >= cx - 7 AND x < cx + 7")
def cell_windows(spark, sf_dir):
    """Windows of two cells an image, cut out of tiles of 12 x 12."""
    return tiles.crop(_raster(spark, sf_dir, 12), _centres(spark, sf_dir), 7, 12)


@query()
def cell_masks(spark, sf_dir):
    """Nested masks of two cells an image, whose windows overlap."""
    found = masks.cell_masks(_raster(spark, sf_dir, 16), _centres(spark, sf_dir), 1.0, (40, 80, 160), tolerance=5.0, half=10, size=16)
    return found.groupBy("image", "cell", "area").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {b.PX_BIG}, {_CELLS}, {_off(morphology.disk(9))}, so AS (SELECT image, cell, cy, cx, cy + dy AS y, cx + dx AS x FROM ce, o WHERE cy + dy BETWEEN 0 AND 31 AND cx + dx BETWEEN 0 AND 31)
 SELECT image, y, x, cell, 200 AS area FROM so QUALIFY row_number() OVER (PARTITION BY image, y, x ORDER BY (y - cy) ** 2 + (x - cx) ** 2, cell) = 1""")
def contested_pixels(spark, sf_dir):
    c = _centres(spark, sf_dir)
    return masks.contested(vessels.soma_disk(c, 32, 32, 0.66).withColumn("area", F.lit(200)), c)


@query(f"WITH {_reach(_EIGHT)} SELECT image, y, x, min(label) AS label FROM r GROUP BY ALL")
def components_tiled(spark, sf_dir):
    """The same labels as of whole images, from tiles of 5 x 5."""
    return tiles.components(small_mask(spark, sf_dir), True, 5)


@query(f"WITH {b.PX_BIG} SELECT 'img' || image || '.tif' AS image, count(*) AS n, CAST(sum(CAST(floor(v / 2) AS BIGINT)) AS BIGINT) AS total, max(y) AS y, max(x) AS x FROM px WHERE floor(v / 2) > 0 GROUP BY image")
def tiff_folder(spark, sf_dir):
    """Rasters written as TIFF files by the sink and read back by the source, in tiles of 20 x 20."""
    p = b.px_big(spark, sf_dir).select(F.concat(F.lit("img"), "image").alias("image"), "y", "x", F.floor(F.col("v") / 2).alias("v"))
    folder = shared_folder(spark)
    tiff_source.write_files(tables.raster_files(p, ".tif", "u2", height=32, width=32), folder)
    back = tiles.to_pixels(tiff_source.read_tiles(spark, folder, size=20), 20).where("v > 0")
    return back.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("long").alias("total"), F.max("y").alias("y"), F.max("x").alias("x"))


@query(f"""WITH {SMALL}, {_off(morphology.disk(3))}, rr AS (SELECT *, 1 + image % 3 AS r FROM m), pr AS (SELECT image, y, x, r FROM rr),
 e AS (SELECT a.image, a.y, a.x, a.r FROM pr a JOIN o ON dy * dy + dx * dx <= a.r * a.r LEFT JOIN m k ON k.image = a.image AND k.y = a.y + dy AND k.x = a.x + dx GROUP BY ALL HAVING bool_and(k.image IS NOT NULL))
 SELECT DISTINCT image, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM e JOIN o ON dy * dy + dx * dx <= r * r""")
def mask_opened(spark, sf_dir):
    """Opening with a radius of 1, 2 or 3, as the image says."""
    return distance.opened(small_mask(spark, sf_dir), 1 + F.col("image") % 3)


_ARCS = """s AS (SELECT image, y + dy AS y, x + dx AS x, dy, dx FROM m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)), op AS (SELECT * FROM s ANTI JOIN m USING (image, y, x)),
 sd AS (SELECT image, CASE WHEN dy <> 0 THEN 2 * (y - 16) - dy ELSE 2 * (x - 16) - dx END AS p, CASE WHEN dy <> 0 THEN 2 * (x - 16) - dx ELSE 2 * (y - 16) - dy END AS u FROM op),
 ev AS (SELECT image, p * p + CASE WHEN u = 0 THEN 0 ELSE (abs(u) - 1) ** 2 END AS q, CASE WHEN u = 0 THEN 2 ELSE 1 END AS n FROM sd UNION ALL SELECT image, p * p + (abs(u) + 1) ** 2, CASE WHEN u = 0 THEN -2 ELSE -1 END FROM sd),
 st AS (SELECT image, CAST(q AS BIGINT) AS q, sum(n) AS n FROM ev GROUP BY ALL), rn AS (SELECT image, q AS a, lead(q) OVER w AS b, sum(n) OVER w / 2 AS n FROM st WINDOW w AS (PARTITION BY image ORDER BY q)),
 al AS (SELECT * FROM rn WHERE b IS NOT NULL UNION ALL SELECT image, 0, min(q), 0 FROM st GROUP BY 1 HAVING min(q) > 0), cl AS (SELECT image, greatest(a, 16.0) AS a, b, n FROM al WHERE greatest(a, 16.0) < b),
 fu AS (SELECT cl.image, a, b, CAST(CASE WHEN n > 0 THEN n ELSE (m.image IS NOT NULL)::INTEGER END AS BIGINT) AS n FROM cl LEFT JOIN m ON m.image = cl.image AND m.y = 16 AND m.x = 16 + round(sqrt((a + b) / 2) / 2)),
 li AS (SELECT *, min(a) FILTER (n > 0) OVER (PARTITION BY image) AS lo, max(b) FILTER (n > 0) OVER (PARTITION BY image) AS hi FROM fu)"""


@query(f"WITH {BIG}, {_ARCS} SELECT image, round(sqrt(a) / 2, 6) AS from_radius, round(sqrt(b) / 2, 6) AS to_radius, n FROM li WHERE a >= lo AND b <= hi")
def sholl_continuous(spark, sf_dir):
    m = big_mask(spark, sf_dir)
    centres = m.select("image").distinct().select("image", F.lit(16).alias("cy"), F.lit(16).alias("cx"), F.lit(2.0).alias("r0"))
    return rounded(sholl.continuous(m, centres))


@query(f"WITH {BIG} SELECT image, CAST(round(avg(y)) AS INTEGER) AS cy, CAST(round(avg(x)) AS INTEGER) AS cx, round(sqrt(count(*) / pi()), 6) AS r0 FROM m GROUP BY 1")
def sholl_start(spark, sf_dir):
    return rounded(sholl.soma_centres(big_mask(spark, sf_dir)))


# bisection of the logarithm of the odds, 70 halvings, over all tables with the margins
_ODDS = f"""WITH RECURSIVE {b.CLASSIFIED}, n AS (SELECT treatment, phenotype, count(*) AS n FROM classified GROUP BY ALL), s AS (SELECT treatment, sum(n) AS r FROM n GROUP BY 1),
 p AS (SELECT x.phenotype, x.treatment AS group_a, y.treatment AS group_b, x.n AS a, y.n AS b, sx.r AS ra, sy.r AS rb FROM n x JOIN n y ON x.phenotype = y.phenotype AND x.treatment < y.treatment JOIN s sx ON sx.treatment = x.treatment JOIN s sy ON sy.treatment = y.treatment),
 t AS (SELECT *, list_transform(range(CAST(greatest(0, a + b - rb) AS BIGINT), CAST(least(ra, a + b) AS BIGINT) + 1), lambda k: {{'k': k - a, 'l': -(lgamma(k + 1) + lgamma(ra - k + 1) + lgamma(a + b - k + 1) + lgamma(rb - a - b + k + 1))}}) AS w FROM p),
 g AS (SELECT phenotype, group_a, group_b, w, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi, 0 AS i FROM t WHERE a > greatest(0, a + b - rb) AND a < least(ra, a + b)
  UNION ALL SELECT phenotype, group_a, group_b, w, CASE WHEN f > 0 THEN lo ELSE mid END, CASE WHEN f > 0 THEN mid ELSE hi END, i + 1 FROM
   (SELECT *, list_sum(list_transform(w, lambda x: exp(x.l + mid * x.k - top) * x.k)) AS f FROM (SELECT *, (lo + hi) / 2 AS mid, list_max(list_transform(w, lambda x: x.l + (lo + hi) / 2 * x.k)) AS top FROM g WHERE i < 70)))
 SELECT phenotype, group_a, group_b, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CASE WHEN a <= greatest(0, a + b - rb) THEN 0.0 WHEN a >= least(ra, a + b) THEN 'inf'::DOUBLE ELSE exp((lo + hi) / 2) END, 6) AS odds_ratio FROM t LEFT JOIN (SELECT * FROM g WHERE i = 70) USING (phenotype, group_a, group_b)"""


@query(_ODDS)
def fisher_odds(spark, sf_dir):
    table = classified(spark, sf_dir).groupBy("treatment", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    found = statistics.conditional_odds(statistics.fisher_pairs(table))
    return rounded(found.select("phenotype", "group_a", "group_b", "a", "b", "odds_ratio"))


@query(f"""WITH RECURSIVE {b.QA}, d AS (SELECT seq, cell, area, op, row_number() OVER (ORDER BY seq) AS k FROM ev WHERE op IN ('approve', 'reject', 'undo')),
 s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS stack, NULL::BIGINT AS undo, NULL::BIGINT AS of UNION ALL
  SELECT d.k, CASE WHEN op = 'undo' THEN stack[1:greatest(len(stack) - 1, 0)] ELSE list_append(stack, seq::BIGINT) END, CASE WHEN op = 'undo' AND len(stack) > 0 THEN seq END, CASE WHEN op = 'undo' AND len(stack) > 0 THEN stack[len(stack)] END FROM s JOIN d ON d.k = s.k + 1)
 SELECT undo, of AS seq FROM s WHERE undo IS NOT NULL""")
def undo_pairs(spark, sf_dir):
    """Decision that each undo of the whole session takes back; every event of the review has a mask here."""
    return qa.undone(b.qa_events(spark, sf_dir).select("seq", "op")).select(F.col("undo").cast("long").alias("undo"), F.col("seq").cast("long").alias("seq"))


_SESSION = f"""WITH RECURSIVE {b.QA}, d AS (SELECT seq, cell, area, op, row_number() OVER (ORDER BY seq) AS k FROM ev WHERE op IN ('approve', 'reject', 'undo')),
 s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS stack, NULL::BIGINT AS undo, NULL::BIGINT AS of UNION ALL
  SELECT d.k, CASE WHEN op = 'undo' THEN stack[1:greatest(len(stack) - 1, 0)] ELSE list_append(stack, seq::BIGINT) END, CASE WHEN op = 'undo' AND len(stack) > 0 THEN seq END, CASE WHEN op = 'undo' AND len(stack) > 0 THEN stack[len(stack)] END FROM s JOIN d ON d.k = s.k + 1),
 st AS (SELECT cell, seq AS happened, area, op = 'approve' AS yes, seq AS of FROM d WHERE op <> 'undo' UNION ALL SELECT d.cell, s.undo, 0, NULL, s.of FROM s JOIN d ON d.seq = s.of),
 o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY happened) AS k FROM st),
 f AS (SELECT cell, 0::BIGINT AS k, list_transform(range(200, 801, 100), lambda a: {{'area': a, 'yes': NULL::BOOLEAN, 'of': NULL::BIGINT}}) AS m FROM (SELECT DISTINCT cell FROM masks) UNION ALL
  SELECT f.cell, o.k, list_transform(m, lambda x: CASE WHEN o.yes IS NULL AND x.of = o.of THEN {{'area': x.area, 'yes': NULL::BOOLEAN, 'of': NULL::BIGINT}}
    WHEN o.yes IS NOT NULL AND (x.area = o.area OR (x.yes IS NULL AND CASE WHEN o.yes THEN x.area < o.area ELSE x.area > o.area END)) THEN {{'area': x.area, 'yes': o.yes, 'of': o.of::BIGINT}} ELSE x END) FROM f JOIN o ON o.cell = f.cell AND o.k = f.k + 1),
 l AS (SELECT cell, unnest(m) AS m FROM f QUALIFY row_number() OVER (PARTITION BY cell ORDER BY k DESC) = 1)
 SELECT cell, CAST(m.area AS INTEGER) AS area, m.yes AS approved FROM l"""


@query(_SESSION)
def qa_session(spark, sf_dir):
    """Review with one stack of decisions over all cells."""
    return qa.replay_session(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir)).select("cell", F.col("area").cast("int").alias("area"), "approved")


def _file(image):
    return F.concat(F.lit("img"), image, F.lit("_soma_1_"), image, F.lit("_area400_mask.tif"))


@query(f"""{_HULL}, a AS (SELECT image, sum(px * qy - qx * py) / 2 AS area, sum(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS perimeter FROM e GROUP BY 1),
 f AS (SELECT i.image, i.y AS ya, i.x AS xa, j.y AS yb, j.x AS xb, sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2) AS d FROM h i JOIN h j ON i.image = j.image AND i.seq < j.seq QUALIFY row_number() OVER (PARTITION BY i.image ORDER BY (i.x - j.x) ** 2 + (i.y - j.y) ** 2 DESC, i.seq, j.seq) = 1),
 w AS (SELECT image, any_value(d) AS span, max((y * (xb - xa) - x * (yb - ya)) / d) - min((y * (xb - xa) - x * (yb - ya)) / d) AS width FROM h JOIN f USING (image) GROUP BY 1), n AS (SELECT image, count(*) AS n FROM m GROUP BY 1),
 hm AS (SELECT image, area, perimeter, span, width, n FROM a JOIN w USING (image) JOIN n USING (image) WHERE area > 0),
 {_BOXES[_BOXES.index("s AS (SELECT unnest"):].replace("s AS (SELECT unnest", "sz AS (SELECT unnest").replace("FROM m, s GROUP", "FROM m, sz GROUP")},
 d AS (SELECT image, regr_slope(ln(n), -ln(s)) AS fd, regr_r2(ln(n), -ln(s)) AS r2, count(*) AS scales, avg(lacunarity) AS l0, arg_min(lacunarity, s) AS l1, arg_max(lacunarity, s) AS l2 FROM u GROUP BY 1)
 SELECT 'img' || image || '_soma_1_' || image AS cell_name, 'img' || image AS image_name, 'soma_1_' || image AS soma_id, 400 AS mask_area_um2, 'img' || image || '_soma_1_' || image || '_area400_mask.tif' AS mask_file,
  round(fd, 6) AS fractal_dimension, round(r2, 6) AS fractal_r_squared, round(l0, 6) AS fractal_lacunarity_mean, round(l1, 6) AS fractal_lacunarity_small, round(l2, 6) AS fractal_lacunarity_large, scales AS fractal_num_scales,
  nn.n AS fractal_foreground_pixels, round(nn.n * CAST(0.09 AS DOUBLE), 4) AS fractal_foreground_area_um2, round(area, 4) AS hull_area_px, round(area * 0.09, 4) AS hull_area_um2, round(perimeter, 4) AS hull_perimeter_px, round(perimeter * 0.3, 4) AS hull_perimeter_um,
  round(4 * pi() * area / perimeter ** 2, 6) AS hull_circularity, round(hm.n / area, 6) AS hull_density, round(span, 4) AS hull_max_span_px, round(span * 0.3, 4) AS hull_max_span_um, round(span / nullif(width, 0), 6) AS hull_span_ratio
 FROM d JOIN n nn USING (image) LEFT JOIN hm USING (image)""")
def fractal_sheet(spark, sf_dir):
    """All 22 columns of the box-counting and hull sheet."""
    return sheets.fractal_sheet(big_mask(spark, sf_dir).withColumn("image", _file(F.col("image"))), 32, 32, 0.3)


@query()
def skeleton_sheet(spark, sf_dir):
    """All 24 columns of the skeleton sheet, skeletons drawn at twice the size."""
    return rounded(sheets.skeleton_sheet(big_mask(spark, sf_dir).withColumn("image", _file(F.col("image"))), 0.3, 2))


@query()
def process_shape(spark, sf_dir):
    m = big_mask(spark, sf_dir)
    soma = m.where((F.abs(F.col("y") - 16) <= 2) & (F.abs(F.col("x") - 16) <= 2))
    return rounded(sheets.process_shape(m, 32, 32, 0.3, soma))


@query(f"""WITH {b.PX_BIG}, {_CELLS}, {_off(morphology.disk(4))}, so AS (SELECT image, cell, cy + dy AS y, cx + dx AS x FROM ce, o WHERE cy + dy BETWEEN 0 AND 31 AND cx + dx BETWEEN 0 AND 31), ve AS (SELECT image, y, x FROM px WHERE v > 60000),
 di AS (SELECT s.image, s.cell, sqrt(min((s.y - m.y) ** 2 + (s.x - m.x) ** 2)) AS d FROM so s JOIN ce ON ce.image = s.image AND ce.cell = s.cell AND (s.y - cy) ** 2 + (s.x - cx) ** 2 <= 4 JOIN ve m ON m.image = s.image GROUP BY ALL),
 cp AS (SELECT so.image, so.cell, px.v, ve.image IS NOT NULL AS onv FROM so JOIN px USING (image, y, x) LEFT JOIN ve USING (image, y, x)),
 mm AS (SELECT image, cell, coalesce(avg(v) FILTER (NOT onv), avg(v)) AS e, avg(onv::INTEGER) AS c, avg(v * 2) AS k FROM cp GROUP BY ALL)
 SELECT image, cell, round(d * 1.5, 6) AS dist_to_vessel_um, round(e, 6) AS exposure_mean, round(c, 6) AS vessel_contact_fraction, round(k, 6) AS cd31_exposure_mean FROM mm LEFT JOIN di USING (image, cell)""")
def cell_exposure_marker(spark, sf_dir):
    """Exposure with a soma smaller than its cell, and the mean of the vessel marker."""
    p = b.px_big(spark, sf_dir)
    c = _centres(spark, sf_dir)
    cell = vessels.soma_disk(c, 32, 32, 1.5).join(p.select("image", "y", "x"), ["image", "y", "x"], "left_semi")
    soma = vessels.soma_disk(c, 32, 32, 3.0)
    return rounded(vessels.exposure(cell, p, pixels.threshold(p, 60000.0), soma, 1.5, p.withColumn("v", 2 * F.col("v"))))


@query()
def vessel_tubes(spark, sf_dir):
    """Vessels from the ridges of every image, all scales."""
    return vessels.vessel_mask(b.px_small(spark, sf_dir).withColumn("v", F.abs("v")), 8, 8, 1.0, tubes=True)


@query(f"""WITH {_RGB}, l AS (SELECT image, y, x, unnest([0, 1, 2]) AS c, CAST(unnest([r, g, b]) AS DOUBLE) AS v FROM rgb), w AS (SELECT *, min(v) OVER (PARTITION BY image, c) AS lo, max(v) OVER (PARTITION BY image, c) AS hi FROM l)
 SELECT image, y, x, c, CAST(floor(greatest(0.0, least(255.0, (CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 255.0 ELSE v END + CASE c WHEN 0 THEN 30.0 WHEN 2 THEN -15.0 ELSE 0.0 END + 7.5 - 127.5) * 1.4 + 127.5))) AS INTEGER) AS v FROM w""")
def px_display_channels(spark, sf_dir):
    return pixels.display_colour(_rgb(spark, sf_dir).withColumn("v", F.col("v").cast("double")), 5.0, 20.0, {0: 20.0, 2: -10.0})


@query()
def tubeness(spark, sf_dir):
    """All scales, image by image."""
    return rounded(background.tubeness(b.px_small(spark, sf_dir), 8, 8))


@query(f"WITH {b.PX_BIG}, q AS (SELECT image, CAST(floor(v / 2) AS INTEGER) AS v FROM px) SELECT image, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.99) AS p99, min(v) AS p0, max(v) AS p100 FROM q GROUP BY 1")
def px_percentiles(spark, sf_dir):
    """Percentiles by two rounds of histograms."""
    p = b.px_big(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 2))
    return thresholds.percentiles(p, {"p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0})


@query(f"""WITH {b.PX_BIG}, m AS (SELECT image, CAST(200 + 100 * k AS INTEGER) AS area, y, x FROM px, (VALUES (0), (1), (2)) a(k) WHERE v > 60000 + 10000 * k), l AS (SELECT image, max(area) AS area FROM m GROUP BY 1)
 SELECT 'img' || image || '_soma_16_16_area' || area || '_mask.tif' AS image, count(*) AS n FROM m JOIN l USING (image, area) GROUP BY ALL""")
def largest_stage(spark, sf_dir):
    """The first stage of the combined analysis: of every cell the largest mask."""
    p = b.px_big(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).where(F.col("v") > 60000 + 10000 * F.col("k"))
    m = p.select(F.concat(F.lit("img"), "image", F.lit("_soma_16_16_area"), (200 + 100 * F.col("k")).cast("int"), F.lit("_mask.tif")).alias("image"), "y", "x", F.lit(32).alias("height"), F.lit(32).alias("width"))
    return stages.LargestMasks().transform(m).groupBy("image").agg(F.count(F.lit(1)).alias("n"))


@query()
def combined_analysis(spark, sf_dir):
    """Skeleton, Sholl and fractal sheets of every cell side by side, with the defaults of the separate scripts."""
    m = big_mask(spark, sf_dir, 60000.0).select(F.concat(F.lit("img"), "image", F.lit("_soma_16_16_area400_mask.tif")).alias("image"), "y", "x", F.lit(32).alias("height"), F.lit(32).alias("width"))
    return rounded(stages.Combined().transform(m), 4)
