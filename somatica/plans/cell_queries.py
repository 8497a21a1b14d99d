"""Queries on cells, names and sheets, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatica.functions import cells, names
from somatica.operators import merge, phenotype, qa, statistics
from somatica.plans import bindings as b

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenotype.classify(b.cells(spark, sf_dir))


@query(f"WITH {b.CLASSIFIED}, n AS (SELECT phenotype, count(*) AS n FROM classified GROUP BY 1) SELECT phenotype, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM n")
def phenotype_distribution(spark, sf_dir):
    return phenotype.distribution(classified(spark, sf_dir)).select("phenotype", "n", "pct")


@query(f"WITH {b.CLASSIFIED}, n AS (SELECT treatment, phenotype, count(*) AS n FROM classified GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY treatment), 1) AS pct FROM n")
def phenotype_by_treatment(spark, sf_dir):
    return phenotype.distribution(classified(spark, sf_dir), ["treatment"]).drop("ord")


@query(f"WITH {b.CLASSIFIED}, n AS (SELECT image_name, treatment, phenotype, count(*) AS n FROM classified GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY image_name, treatment), 1) AS pct FROM n")
def phenotype_by_image(spark, sf_dir):
    return phenotype.distribution(classified(spark, sf_dir), ["image_name", "treatment"]).drop("ord")


_WIDE = ", ".join(f"count(*) FILTER (phenotype = '{p}') AS {p}" for p in cells.PHENOTYPES) + ", count(*) AS total, " + ", ".join(f"round(100.0 * count(*) FILTER (phenotype = '{p}') / count(*), 1) AS pct_{p}" for p in cells.PHENOTYPES)


@query(f"WITH {b.CLASSIFIED} SELECT image_name, treatment, {_WIDE} FROM classified GROUP BY ALL")
def phenotype_wide(spark, sf_dir):
    return phenotype.wide_summary(classified(spark, sf_dir), ["image_name", "treatment"])


@query(f"WITH {b.CLASSIFIED} SELECT image_name, {_WIDE} FROM classified GROUP BY ALL")
def phenotype_wide_untreated(spark, sf_dir):
    return phenotype.wide_summary(classified(spark, sf_dir), ["image_name"])


_MEANS = ["soma_area", "mask_area", "perimeter", "soma_cell_ratio", "transformation_index", "roundness", "eccentricity"]


@query(f"WITH {b.CLASSIFIED} SELECT phenotype, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in _MEANS)} FROM classified GROUP BY 1")
def phenotype_metric_means(spark, sf_dir):
    return rounded(phenotype.metric_means(classified(spark, sf_dir), _MEANS))


_RANGES = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS sd, round(min({m}), 6) AS low, round(max({m}), 6) AS high FROM metrics" for m in ("soma_cell_ratio", "transformation_index"))


@query(f"WITH {b.CELLS}, {b.METRICS} {_RANGES}")
def derived_metric_ranges(spark, sf_dir):
    return rounded(phenotype.metric_ranges(phenotype.with_metrics(b.cells(spark, sf_dir)), ["soma_cell_ratio", "transformation_index"]))


@query(f"WITH {b.CELLS} SELECT count(DISTINCT image_name) AS images, count(*) AS cells FROM cells")
def distinct_images(spark, sf_dir):
    return b.cells(spark, sf_dir).agg(F.count_distinct("image_name").alias("images"), F.count(F.lit(1)).alias("cells"))


@query(f"WITH {b.CLASSIFIED} SELECT t.treatment, p.phenotype, count(c.treatment) AS n FROM (SELECT DISTINCT treatment FROM classified) t CROSS JOIN (SELECT DISTINCT phenotype FROM classified) p LEFT JOIN classified c ON c.treatment = t.treatment AND c.phenotype = p.phenotype GROUP BY ALL")
def contingency_table(spark, sf_dir):
    return phenotype.contingency(classified(spark, sf_dir), "treatment")


@query(f"""WITH {b.CLASSIFIED}, n AS (SELECT treatment, phenotype, count(*)::DOUBLE AS n FROM classified GROUP BY ALL),
 p AS (SELECT n, sum(n) OVER (PARTITION BY treatment) AS r, sum(n) OVER (PARTITION BY phenotype) AS c, sum(n) OVER () AS t FROM n),
 s AS (SELECT max(t) * (sum(n * n / r / c) - 1) AS x FROM p), d AS (SELECT (count(DISTINCT treatment) - 1) * (count(DISTINCT phenotype) - 1) AS df FROM n)
 SELECT round(x, 6) AS statistic, CAST(df AS INTEGER) AS df, round(exp(-x / 2) * list_sum(list_transform(range(0, df // 2), lambda k: pow(x / 2, k) / gamma(k + 1))), 6) AS p FROM s, d""")
def chi_square_treatments(spark, sf_dir):
    return rounded(statistics.chi_square(phenotype.contingency(classified(spark, sf_dir), "treatment"), "treatment"))


@query(f"""WITH {b.CLASSIFIED}, n AS (SELECT treatment, phenotype, count(*) AS n FROM classified GROUP BY ALL), s AS (SELECT treatment, sum(n) AS r FROM n GROUP BY 1),
 t AS (SELECT n.*, r FROM n JOIN s USING (treatment)),
 pr AS (SELECT x.phenotype, x.treatment AS group_a, y.treatment AS group_b, x.n AS a, y.n AS b, CAST(x.r AS BIGINT) AS ra, CAST(y.r AS BIGINT) AS rb FROM t x JOIN t y ON x.phenotype = y.phenotype AND x.treatment < y.treatment),
 k AS (SELECT *, unnest(range(greatest(0, a + b - rb), least(ra, a + b) + 1)) AS k FROM pr),
 l AS (SELECT *, -(lgamma(k + 1.0) + lgamma(ra - k + 1.0) + lgamma(a + b - k + 1.0) + lgamma(rb - (a + b) + k + 1.0)) AS lp FROM k),
 m AS (SELECT *, lp - max(lp) OVER w AS q FROM l WINDOW w AS (PARTITION BY phenotype, group_a, group_b)),
 o AS (SELECT *, max(CASE WHEN k = a THEN q END) OVER (PARTITION BY phenotype, group_a, group_b) AS seen FROM m)
 SELECT phenotype, group_a, group_b, a, b, ra, rb, round(least(1.0, sum(CASE WHEN q <= seen + ln(1 + 1e-7) THEN exp(q) ELSE 0 END) / sum(exp(q))), 6) AS p,
 round(a * (rb - b)::DOUBLE / (b * (ra - a)), 6) AS sample_odds_ratio FROM o GROUP BY ALL""")
def fisher_pairs(spark, sf_dir):
    table = classified(spark, sf_dir).groupBy("treatment", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    return rounded(statistics.fisher_pairs(table).drop("stars"))


@query(f"WITH {b.CELLS} SELECT DISTINCT mask_area AS p, CASE WHEN mask_area / 1e6 < 0.001 THEN '***' WHEN mask_area / 1e6 < 0.01 THEN '**' WHEN mask_area / 1e6 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM cells")
def significance_stars(spark, sf_dir):
    return b.cells(spark, sf_dir).select(F.col("mask_area").alias("p"), cells.significance(F.col("mask_area") / 1e6).alias("stars")).distinct()


_PARTS = r"regexp_extract(filename, '(?i)^(.+?)_(soma_\d+_\d+)_area(\d+)_mask\.tiff?$', {})"


@query(f"WITH {b.MASK_NAMES} SELECT filename, {_PARTS.format(1)} AS image_name, {_PARTS.format(2)} AS soma_id, CAST(regexp_extract(filename, '_soma_(\\d+)_', 1) AS INTEGER) AS \"row\", CAST(regexp_extract(filename, '_soma_\\d+_(\\d+)_', 1) AS INTEGER) AS col, CAST({_PARTS.format(3)} AS INTEGER) AS area FROM names")
def mask_name_parts(spark, sf_dir):
    return b.mask_names(spark, sf_dir).withColumns(names.mask_parts(F.col("filename")))


@query(f"WITH {b.MASK_NAMES} SELECT filename, replace(filename, '_mask.tif', '') AS series, CASE WHEN filename LIKE '%.tif' AND contains(filename, '_area') THEN left(filename, length(filename) - length(regexp_extract(filename, '_area[0-9]+_mask\\.tif$'))) ELSE filename END AS cell, regexp_replace(filename, '\\.[^.]*$', '') AS stem, CAST(regexp_extract(filename, 'area(\\d+)', 1) AS INTEGER) AS area FROM (SELECT DISTINCT filename FROM names)")
def cleaned_names(spark, sf_dir):
    d = b.mask_names(spark, sf_dir).distinct()
    return d.select("filename", F.regexp_replace("filename", r"_mask\.tif", "").alias("series"), names.clean_cell_name(F.col("filename")).alias("cell"), names.stem(F.col("filename")).alias("stem"), names.area_key(F.regexp_extract("filename", r"area(\d+)", 1)).alias("area"))


@query(f"WITH {b.MASK_NAMES}, p AS (SELECT filename, split_part(filename, '_soma', 1) AS image_name, regexp_extract(filename, 'soma_\\d+_\\d+') AS soma_id, CAST(regexp_extract(filename, 'area(\\d+)', 1) AS INTEGER) AS area FROM names), r AS (SELECT *, row_number() OVER (PARTITION BY image_name, soma_id ORDER BY area DESC, filename) AS rn FROM p) SELECT filename, image_name, soma_id, area FROM r WHERE rn = 1")
def largest_masks(spark, sf_dir):
    d = b.mask_names(spark, sf_dir).withColumns(names.mask_parts(F.col("filename")))
    return merge.largest_mask_per_cell(d).select("filename", "image_name", "soma_id", "area")


_MASTER = """master AS (SELECT p_partkey AS row_id, '  img' || (p_partkey % 100) || CASE p_partkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' ELSE '' END AS image_name,
  ' soma_' || (p_partkey % 7) || '_' || (p_size % 5) || ' ' AS soma_id, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(200 + 100 * (p_size % 7) AS VARCHAR) || '.4' END AS area FROM part),
 bbb AS (SELECT 'img' || (o_custkey % 100) AS image_name, 'soma_' || (o_orderkey % 7) || '_' || (o_custkey % 5) AS soma_id, CAST(200 + 100 * (o_orderkey % 7) AS INTEGER) AS area, o_totalprice AS exposure, o_orderkey AS seq FROM orders)"""


def _master(spark, sf_dir) -> DataFrame:
    p = b.read(spark, sf_dir, "part")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".tif").when(F.col("p_partkey") % 3 == 1, ".TIFF").otherwise("")
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lit("  img"), (F.col("p_partkey") % 100).cast("string"), ending).alias("image_name"),
        F.concat(F.lit(" soma_"), (F.col("p_partkey") % 7).cast("string"), F.lit("_"), (F.col("p_size") % 5).cast("string"), F.lit(" ")).alias("soma_id"),
        F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.concat((200 + 100 * (F.col("p_size") % 7)).cast("string"), F.lit(".4"))).alias("area"),
    )


def _bbb(spark, sf_dir) -> DataFrame:
    o = b.read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("img"), (F.col("o_custkey") % 100).cast("string")).alias("image_name"), F.concat(F.lit("soma_"), (F.col("o_orderkey") % 7).cast("string"), F.lit("_"), (F.col("o_custkey") % 5).cast("string")).alias("soma_id"), (200 + 100 * (F.col("o_orderkey") % 7)).cast("int").alias("area"), F.col("o_totalprice").alias("exposure"), F.col("o_orderkey").alias("seq"))


_NORM = "regexp_replace(trim(image_name), '(?i)\\.tiff?$', '')"


@query(f"WITH {_MASTER}, last AS (SELECT * FROM bbb QUALIFY row_number() OVER (PARTITION BY image_name, soma_id, area ORDER BY seq DESC) = 1), m AS (SELECT *, {_NORM} AS k1, trim(soma_id) AS k2, CAST(round(TRY_CAST(area AS DOUBLE)) AS INTEGER) AS k3 FROM master) SELECT row_id, m.image_name, m.soma_id, m.area, exposure, last.seq IS NOT NULL AS matched FROM m LEFT JOIN last ON k1 = last.image_name AND k2 = last.soma_id AND k3 = last.area")
def merge_exposure(spark, sf_dir):
    keys = {"image": names.image_key(F.col("image_name")), "soma": F.trim("soma_id"), "area": names.area_key(F.col("area"))}
    right = {"image": F.col("image_name"), "soma": F.col("soma_id"), "area": F.col("area")}
    return merge.left_merge(_master(spark, sf_dir), keys, _bbb(spark, sf_dir), right, ["exposure"], [F.col("seq")])


@query(f"WITH {_MASTER}, last AS (SELECT image_name, soma_id, max_by(exposure, seq) AS bulbs FROM bbb GROUP BY ALL), m AS (SELECT *, {_NORM} AS k1, trim(soma_id) AS k2 FROM master) SELECT row_id, m.image_name, m.soma_id, m.area, bulbs, last.image_name IS NOT NULL AS matched FROM m LEFT JOIN last ON k1 = last.image_name AND k2 = last.soma_id")
def merge_bulbs(spark, sf_dir):
    keys = {"image": names.image_key(F.col("image_name")), "soma": F.trim("soma_id")}
    rows = _bbb(spark, sf_dir).withColumnRenamed("exposure", "bulbs")
    return merge.left_merge(_master(spark, sf_dir), keys, rows, {"image": F.col("image_name"), "soma": F.col("soma_id")}, ["bulbs"], [F.col("seq")])


@query("""WITH img AS (SELECT s_suppkey, 'img' || (s_suppkey % 40) || '.tif' AS image_name, 'a' || s_nationkey AS animal_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ctrl' ELSE 'drug' END AS treatment FROM supplier),
 f AS (SELECT regexp_replace(image_name, '\\.[^.]*$', '') AS stem, animal_id, treatment FROM img QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY s_suppkey) = 1)
 SELECT l_orderkey, l_linenumber, count(*) AS n, max(coalesce(animal_id, '')) AS animal_id, max(coalesce(treatment, '')) AS treatment FROM lineitem LEFT JOIN f ON stem = 'img' || (l_suppkey % 60) GROUP BY ALL""")
def metadata_join(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier")
    images = s.select("s_suppkey", F.concat(F.lit("img"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".tif")).alias("image_name"), F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("animal_id"), F.when(F.col("s_suppkey") % 2 == 0, "ctrl").otherwise("drug").alias("treatment"))
    li = b.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("img"), (F.col("l_suppkey") % 60).cast("string")).alias("stem"))
    d = merge.with_metadata(li, images, F.col("stem"), names.stem(F.col("image_name")), [F.col("s_suppkey")])
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("animal_id").alias("animal_id"), F.max("treatment").alias("treatment"))


@query("WITH s AS (SELECT c_nationkey AS image_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS soma_idx, c_custkey AS r FROM customer) SELECT s_suppkey, coalesce(s.r, 0) AS \"row\", coalesce(s.r, 0) * 2 AS col FROM supplier LEFT JOIN s ON s_nationkey = image_name AND s_suppkey % 80 = soma_idx")
def soma_positions(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    s = b.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_name"), (F.row_number().over(w) - 1).cast("long").alias("soma_idx"), F.col("c_custkey").alias("row"), (F.col("c_custkey") * 2).alias("col"))
    r = b.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("image_name"), (F.col("s_suppkey") % 80).alias("soma_idx"))
    return merge.with_soma_position(r, s).select("s_suppkey", "row", "col")


@query("SELECT o_orderpriority AS timepoint, count(*) AS n, sum(o_custkey) AS sum_bulbs FROM orders GROUP BY ROLLUP (o_orderpriority)")
def totals_by_timepoint(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("timepoint"), F.col("o_custkey").alias("bulbs"))
    return merge.totals(o, "timepoint", ["bulbs"])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def status_counts(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 1000).alias("selected"))
    return merge.status_histogram(o)


@query("SELECT c_custkey AS image_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS animal_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS treatment FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def incomplete_metadata(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer")
    return merge.incomplete_metadata(c.select(F.col("c_custkey").alias("image_name"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("animal_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("treatment")))


@query("SELECT c_custkey AS image, 'miss' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'hit' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def raw_matches(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"))
    o = b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image")).distinct()
    hit, miss = merge.split_matches(c, o, ["image"])
    return miss.withColumn("kind", F.lit("miss")).unionByName(hit.withColumn("kind", F.lit("hit")))


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS k, 'Img' || (c_nationkey % 13) AS image_name FROM customer), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Img' ELSE 'IMG' END || (s_suppkey % 17) AS stem FROM supplier),
 h AS (SELECT k, s_suppkey, 0 AS match_rank FROM l JOIN r ON image_name = stem UNION ALL SELECT k, s_suppkey, 1 FROM l JOIN r ON lower(image_name) = lower(stem)),
 m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY match_rank, s_suppkey) = 1)
 SELECT l.k, l.image_name, s_suppkey, match_rank FROM l LEFT JOIN m USING (k)""")
def ranked_lookup(spark, sf_dir):
    left = b.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("Img"), (F.col("c_nationkey") % 13).cast("string")).alias("image_name")).distinct()
    right = b.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Img").otherwise("IMG"), (F.col("s_suppkey") % 17).cast("string")).alias("stem"))
    return merge.ranked_match(left, right, [F.col("image_name") == F.col("stem"), F.lower("image_name") == F.lower("stem")], ["k"], [F.col("s_suppkey")]).select("k", "image_name", "s_suppkey", "match_rank")


@query("SELECT 'cell' AS kind, l_suppkey AS id, sum(l_quantity) AS n_cells, NULL::DOUBLE AS value FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'image', s_suppkey, NULL, s_acctbal FROM supplier")
def ragged_union(spark, sf_dir):
    a = b.read(spark, sf_dir, "lineitem").groupBy(F.lit("cell").alias("kind"), F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("n_cells"))
    c = b.read(spark, sf_dir, "supplier").select(F.lit("image").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return merge.ragged_union(a, c)


@query("SELECT DISTINCT a, CASE WHEN a <= 300 THEN 1.0 WHEN a >= 800 THEN 0.3 ELSE round(1.0 - 0.7 * (a - 300) / 500, 6) END AS scale, CASE WHEN d >= 1 THEN round(50 / d, 6) END AS pixel_size FROM (SELECT 150 + (l_partkey % 800) AS a, sqrt((l_suppkey % 9) ** 2 + (l_linenumber % 4) ** 2) AS d FROM lineitem)")
def scalar_functions(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    a = (150 + F.col("l_partkey") % 800).alias("a")
    return rounded(li.select(a, F.round(cells.floor_scale(150 + F.col("l_partkey") % 800), 6).alias("scale"), F.round(cells.calibrated_pixel_size(F.lit(50.0), F.col("l_suppkey") % 9, F.col("l_linenumber") % 4), 6).alias("pixel_size")).distinct())


_STATE = """hit AS (SELECT m.cell, m.area, e.seq, e.op = 'approve' AS yes, e.area = m.area AS own FROM masks m LEFT JOIN ev e ON e.cell = m.cell AND e.op IN ('approve', 'reject')
   AND (e.area = m.area OR (e.op = 'approve' AND m.area < e.area) OR (e.op = 'reject' AND m.area > e.area))),
 state AS (SELECT cell, area, coalesce(max_by(yes, seq) FILTER (own), min_by(yes, seq)) AS approved FROM hit GROUP BY ALL)"""


@query(f"WITH {b.QA}, {_STATE} SELECT * FROM state")
def qa_replay(spark, sf_dir):
    return qa.replay(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir))


#: One stack of decisions a cell: every mask remembers the decision that set it and whether one ever did.
UNDO_STATE = """o AS (SELECT cell, seq, area, op, row_number() OVER (PARTITION BY cell ORDER BY seq) AS k FROM ev WHERE op IN ('approve', 'reject', 'undo')),
 f AS (SELECT cell, 0::BIGINT AS k, []::BIGINT[] AS stack, list_transform(range(200, 801, 100), lambda a: {'area': a, 'yes': NULL::BOOLEAN, 'of': NULL::BIGINT, 'ever': FALSE}) AS m FROM (SELECT DISTINCT cell FROM masks) UNION ALL
  SELECT f.cell, o.k, CASE WHEN o.op = 'undo' THEN stack[1:greatest(len(stack) - 1, 0)] ELSE list_append(stack, o.seq::BIGINT) END,
   list_transform(m, lambda x: CASE WHEN o.op = 'undo' AND x.of = stack[len(stack)] THEN {'area': x.area, 'yes': NULL::BOOLEAN, 'of': NULL::BIGINT, 'ever': TRUE}
    WHEN o.op <> 'undo' AND (x.area = o.area OR (x.yes IS NULL AND CASE WHEN o.op = 'approve' THEN x.area < o.area ELSE x.area > o.area END)) THEN {'area': x.area, 'yes': o.op = 'approve', 'of': o.seq::BIGINT, 'ever': TRUE} ELSE x END) FROM f JOIN o ON o.cell = f.cell AND o.k = f.k + 1),
 l AS (SELECT cell, unnest(m) AS m FROM f QUALIFY row_number() OVER (PARTITION BY cell ORDER BY k DESC) = 1)"""


@query(f"WITH RECURSIVE {b.QA}, {UNDO_STATE} SELECT cell, CAST(m.area AS INTEGER) AS area, m.yes AS approved FROM l")
def qa_replay_undo(spark, sf_dir):
    return qa.replay_with_undo(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir))


@query(f"WITH {b.QA}, {_STATE} SELECT cell, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected, count(*) FILTER (approved IS NULL) AS open, bool_and(approved IS NOT NULL) AS reviewed FROM state GROUP BY 1")
def qa_counts(spark, sf_dir):
    return qa.review_counts(qa.replay(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir)), ["cell"])


@query(f"""WITH {b.QA}, {_STATE}, q AS (SELECT cell, area, approved, row_number() OVER (PARTITION BY cell ORDER BY area DESC) - 1 AS idx FROM state)
 SELECT cell, area, approved, CAST(idx AS INTEGER) AS idx, CAST(coalesce(lead(idx) OVER w, idx) AS INTEGER) AS following, CAST(coalesce(lag(idx) OVER w, idx) AS INTEGER) AS preceding,
 CAST(min(CASE WHEN approved IS NULL THEN idx END) OVER (PARTITION BY cell ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS INTEGER) AS next_open FROM q WINDOW w AS (PARTITION BY cell ORDER BY idx)""")
def qa_navigation(spark, sf_dir):
    s = qa.replay(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir)).select("cell", "area", "approved")
    q = s.withColumn("idx", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("area").desc())) - 1)
    return qa.next_unreviewed(q)


@query("SELECT user_id AS image_name, max_by(event_type, event_id) AS status FROM events GROUP BY 1")
def last_status(spark, sf_dir):
    return qa.last_status(b.read(spark, sf_dir, "events").select(F.col("user_id").alias("image_name"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query(f"WITH {b.QA}, {_STATE} SELECT cell, area FROM state WHERE approved IS NOT TRUE")
def qa_deletes(spark, sf_dir):
    m = b.qa_masks(spark, sf_dir)
    return qa.to_delete(m, qa.replay(m, b.qa_events(spark, sf_dir)))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def extension_cube(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extension_tumbling(spark, sf_dir):
    from somatica.streaming.review import activity_windows

    return activity_windows(b.read(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def extension_sessions(spark, sf_dir):
    from somatica.streaming.review import sessions

    return sessions(b.read(spark, sf_dir, "events")).select("user_id", F.col("session_window.start").alias("start"), "n", F.round("total", 4).alias("total"))
