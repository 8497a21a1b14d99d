"""Queries on sessions: the driver's events stand for edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from somatica.operators import session
from somatica.plans import bindings as b
from somatica.sources import tables, tiff

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("""WITH e AS (SELECT event_id AS seq, user_id AS image_name, CASE WHEN event_id % 997 = 0 THEN 'all' WHEN event_id % 991 = 0 THEN 'clear' WHEN event_type = 'click' THEN 'check' WHEN event_type = 'error' THEN 'uncheck' END AS op FROM events),
 g AS (SELECT max(seq) AS seq, max_by(op = 'all', seq) AS flag FROM e WHERE op IN ('all', 'clear')), o AS (SELECT image_name, max(seq) AS seq, max_by(op = 'check', seq) AS flag FROM e WHERE op IN ('check', 'uncheck') GROUP BY 1)
 SELECT i.image_name, CASE WHEN o.seq IS NULL AND g.seq IS NULL THEN true WHEN g.seq IS NULL OR o.seq > g.seq THEN o.flag ELSE g.flag END AS selected FROM (SELECT DISTINCT user_id AS image_name FROM events) i LEFT JOIN o USING (image_name), g""")
def selected_images(spark, sf_dir):
    e = b.read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 997 == 0, "all").when(F.col("event_id") % 991 == 0, "clear").when(F.col("event_type") == "click", "check").when(F.col("event_type") == "error", "uncheck")
    edits = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("image_name"), op.alias("op")).where("op is not null")
    return session.selection(e.select(F.col("user_id").alias("image_name")).distinct(), edits)


@query("""WITH RECURSIVE e AS (SELECT user_id AS image_name, event_id AS seq, event_type IN ('click', 'view', 'purchase') AS added, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 s AS (SELECT DISTINCT image_name, 0::BIGINT AS k, []::BIGINT[] AS stack FROM e
  UNION ALL SELECT e.image_name, e.k, CASE WHEN added THEN list_append(stack, seq::BIGINT) ELSE stack[1:greatest(len(stack) - 1, 0)] END FROM s JOIN e ON e.image_name = s.image_name AND e.k = s.k + 1)
 SELECT image_name, unnest(stack) AS seq FROM (SELECT image_name, max_by(stack, k) AS stack FROM s GROUP BY 1)""")
def picks_after_undo(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select(F.col("user_id").alias("image_name"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view", "purchase"), "add").otherwise("undo").alias("op"))
    return session.after_undo(e, ["image_name"]).select("image_name", F.col("seq").cast("long").alias("seq"))


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'loaded' WHEN 1 THEN 'masks_generated' WHEN 2 THEN 'qa_complete' WHEN 3 THEN 'morphology_calculated' ELSE 'outlined' END"


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN s IN ('masks_generated', 'qa_complete', 'morphology_calculated') THEN 'outlined' ELSE s END AS status FROM (SELECT {_STATUS} AS s FROM orders)) GROUP BY 1")
def cleared_masks(spark, sf_dir):
    images = b.read(spark, sf_dir, "orders").select(F.expr(_STATUS).alias("status"))
    return session.without_masks(images).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT 'img' || (c_custkey % 30) || '.tif' AS image_name, 'soma_' || (c_custkey % 30) || '_' || (c_custkey % 7) AS soma_id FROM customer),
 f AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'img' || (s_suppkey % 30) || '_' || sid || '_soma.tif' WHEN 1 THEN sid || '_soma.tif' ELSE 'old_' || sid || '_x.tif' END AS soma_file, CASE WHEN s_suppkey % 4 = 0 THEN 'somas' ELSE 'masks' END AS soma_folder, sid FROM (SELECT s_suppkey, 'soma_' || (s_suppkey % 30) || '_' || (s_suppkey % 5) AS sid FROM supplier)),
 h AS (SELECT c.*, soma_file, soma_folder, CASE soma_folder WHEN 'somas' THEN 0 ELSE 3 END + CASE WHEN soma_file = replace(image_name, '.tif', '') || '_' || soma_id || '_soma.tif' THEN 0 WHEN soma_file = soma_id || '_soma.tif' THEN 1 ELSE 2 END AS match_rank FROM c JOIN f ON sid = soma_id),
 m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY image_name, soma_id ORDER BY match_rank, soma_file) = 1)
 SELECT image_name, soma_id, soma_file, soma_folder, match_rank FROM c LEFT JOIN m USING (image_name, soma_id)""")
def soma_lookup(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    cells = b.read(spark, sf_dir, "customer").select(F.concat(F.lit("img"), k % 30, F.lit(".tif")).alias("image_name"), F.concat(F.lit("soma_"), k % 30, F.lit("_"), k % 7).alias("soma_id"))
    sid = F.concat(F.lit("soma_"), s % 30, F.lit("_"), s % 5)
    name = F.when(s % 3 == 0, F.concat(F.lit("img"), s % 30, F.lit("_"), sid, F.lit("_soma.tif"))).when(s % 3 == 1, F.concat(sid, F.lit("_soma.tif"))).otherwise(F.concat(F.lit("old_"), sid, F.lit("_x.tif")))
    files = b.read(spark, sf_dir, "supplier").select(name.alias("filename"), F.when(s % 4 == 0, "somas").otherwise("masks").alias("folder")).distinct()
    return session.soma_rasters(cells, files, ("somas", "masks"))


@query("""WITH l AS (SELECT p_partkey AS image, CAST(8 + p_partkey % 3 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width FROM part)
 SELECT image % 3 AS kind, count(*) FILTER (height = 8 + (image // 2) % 3) AS fit, count(*) FILTER (height <> 8 + (image // 2) % 3) AS differ FROM l GROUP BY 1""")
def shape_guard(spark, sf_dir):
    p = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.lit(8).alias("width"))
    left = p.withColumn("height", (8 + F.col("image") % 3).cast("int"))
    right = p.withColumn("height", (8 + F.floor(F.col("image") / 2) % 3).cast("int"))
    fit, differ = session.same_shape(left, right)
    both = fit.withColumn("ok", F.lit(True)).unionByName(differ.withColumn("ok", F.lit(False)))
    return both.groupBy((F.col("image") % 3).alias("kind")).agg(F.count_if("ok").alias("fit"), F.count_if(~F.col("ok")).alias("differ"))


@query(f"WITH {b.PX_SMALL} SELECT image, y, x, greatest(0.0, least(3 * v, max(v) OVER (PARTITION BY image))) AS v FROM px")
def preview_clip(spark, sf_dir):
    p = b.px_small(spark, sf_dir)
    return session.clipped_to_raw(p.withColumn("v", 3 * F.col("v")), p)


@query(f"WITH {b.PX_SMALL} SELECT 'img' || image || '_processed.tif' AS filename, CAST(sum(CAST(floor(greatest(0.0, least(65535.0, 1000 * v))) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM px GROUP BY 1")
def processed_round_trip(spark, sf_dir):
    """Processed rasters cast back to 16 bits, written as TIFF content and decoded again."""
    p = b.px_small(spark, sf_dir).select(F.concat(F.lit("img"), "image").alias("image"), "y", "x", (1000 * F.col("v")).alias("v"))

    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            a = [tiff.decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x.sum()) for x in a], pa.int64()), pa.array([x.size for x in a], pa.int64())], ["filename", "total", "n"])

    return tables.raster_files(p, "_processed.tif", "u2").mapInArrow(sums, "filename string, total long, n long")
