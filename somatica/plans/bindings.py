"""Views of the driver tables as cells, pixels, masks and review events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatica.operators import batches


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(
        F.col("l_suppkey").alias("image_name"),
        F.col("c_mktsegment").alias("treatment"),
        (F.col("l_quantity") * 200).alias("soma_area"),
        F.col("l_extendedprice").alias("mask_area"),
        (F.sqrt("l_extendedprice") * (3.6 + 80 * F.col("l_discount"))).alias("perimeter"),
        (6 * F.col("l_tax")).alias("roundness"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - 6 * F.col("l_tax"))).alias("eccentricity"),
    )


CELLS = """cells AS (SELECT l_suppkey AS image_name, c_mktsegment AS treatment, l_quantity * 200 AS soma_area, l_extendedprice AS mask_area,
  sqrt(l_extendedprice) * (3.6 + 80 * l_discount) AS perimeter, 6 * l_tax AS roundness, sqrt(greatest(0.0, 1 - 6 * l_tax)) AS eccentricity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

METRICS = """metrics AS (SELECT *, CASE WHEN mask_area > 0 THEN soma_area / mask_area ELSE 0 END AS soma_cell_ratio,
  CASE WHEN mask_area > 0 THEN perimeter * perimeter / (4 * pi() * mask_area) ELSE 0 END AS transformation_index FROM cells)"""

CLASSIFIED = f"""{CELLS}, {METRICS}, classified AS (SELECT *, CASE WHEN soma_cell_ratio > 0.55 THEN 'Amoeboid'
  WHEN soma_cell_ratio > 0.30 AND roundness > 0.35 THEN 'Bushy' WHEN roundness < 0.15 AND eccentricity > 0.85 THEN 'Rod'
  WHEN soma_cell_ratio > 0.20 AND transformation_index < 5 THEN 'Hypertrophic' ELSE 'Ramified' END AS phenotype FROM metrics)"""


def px_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images from the embeddings."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    return e.select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


PX_SMALL = """px AS (SELECT vec_id AS image, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def px_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 images from the line items: the largest value of all that fall on a pixel.

    Images are small, so each is kept in one task from the start, and the tasks are as many as shuffles have: what groups or joins by
    image and pixel moves nothing again, and a task's images stay few.
    """
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 32).cast("int").alias("y"), (F.col("l_orderkey") % 32).cast("int").alias("x"), F.col("l_extendedprice").alias("v"))
    return li.repartition(batches.parts(li), "image").groupBy("image", "y", "x").agg(F.max("v").alias("v"))


PX_BIG = """px AS (SELECT l_suppkey AS image, CAST(l_partkey % 32 AS INTEGER) AS y, CAST(l_orderkey % 32 AS INTEGER) AS x, max(l_extendedprice) AS v
  FROM lineitem GROUP BY ALL)"""


def qa_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "undo")
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("cell"), (200 + 100 * (F.col("event_id") % 7)).cast("int").alias("area"), op.alias("op"))
    return e.where("op is not null")


def qa_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = read(spark, sf_dir, "events").select(F.col("user_id").alias("cell")).distinct()
    return u.select("cell", F.explode(F.sequence(F.lit(200), F.lit(800), F.lit(100))).alias("area"))


QA = """ev AS (SELECT event_id AS seq, user_id AS cell, CAST(200 + 100 * (event_id % 7) AS INTEGER) AS area,
  CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'undo' END AS op FROM events),
  masks AS (SELECT cell, CAST(unnest(range(200, 801, 100)) AS INTEGER) AS area FROM (SELECT DISTINCT user_id AS cell FROM events))"""


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.format_string("img%d_soma_%d_%d_area%d_mask.tif", "l_suppkey", F.col("l_partkey") % 50, F.col("l_orderkey") % 50, 200 + 100 * (F.col("l_linenumber") % 7)).alias("filename"))


MASK_NAMES = """names AS (SELECT printf('img%d_soma_%d_%d_area%d_mask.tif', l_suppkey, l_partkey % 50, l_orderkey % 50, 200 + 100 * (l_linenumber % 7)) AS filename
  FROM lineitem)"""
