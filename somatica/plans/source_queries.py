"""Queries that go through files and streams: a table is written, read back by a source or a stream, and measured.

They write to the shared folder that ``spark.checkpoint.dir`` names, or, in a local session where that is unset, to a temporary one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatica.functions import names
from somatica.operators import phenotype, qa
from somatica.plans import bindings as b
from somatica.plans.cell_queries import _RANGES, UNDO_STATE, classified, rounded
from somatica.sources import images, tables
from somatica.sources.scratch import shared_folder
from somatica.streaming import review

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _written_masks(spark: SparkSession, sf_dir: str) -> str:
    """Small masks as TIFF files in a folder of the local driver or cluster; returns the folder."""
    folder = shared_folder(spark)
    p = b.px_small(spark, sf_dir).where("v > 0")
    m = p.select(F.concat(F.lit("img"), (F.col("image") % 7).cast("string"), F.lit(".tif")).alias("image_name"), F.concat(F.lit("soma_1_"), F.col("image").cast("string")).alias("soma_id"), (200 + F.col("image") % 7 * 100).cast("int").alias("area"), F.lit(True).alias("approved"), "y", "x", F.lit(8).alias("height"), F.lit(8).alias("width"))
    tables.mask_files(m, 0.316).write.parquet(f"{folder}/files")
    return folder


_FILES = f"""WITH {b.PX_SMALL}, m AS (SELECT image, y, x FROM px WHERE v > 0), f AS (SELECT 'img' || (image % 7) AS image_name, 'soma_1_' || image AS soma_id, CAST(200 + image % 7 * 100 AS INTEGER) AS area, y, x FROM m)"""


@query(f"{_FILES} SELECT image_name, soma_id, area, count(*) AS n, round(count(*) * 0.316 * 0.316, 6) AS area_um2, 8 AS height, 8 AS width FROM f GROUP BY ALL")
def mask_files_round_trip(spark, sf_dir):
    """Exported mask files, decoded again: area by pixels brighter than 0, pixel size from the resolution tag."""
    files = spark.read.parquet(f"{_written_masks(spark, sf_dir)}/files")
    listed = images.list_masks(files)
    d = images.decoded(listed)
    px = images.pixels(d).where("v > 0").groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    out = d.join(px, F.col("filename") == F.col("image"))
    return rounded(out.select("image_name", "soma_id", "area", "n", (F.col("n") * F.round("pixel_size", 6) * F.round("pixel_size", 6)).alias("area_um2"), "height", "width"))


@query(f"WITH {b.CELLS}, {b.METRICS} {_RANGES}")
def csv_typed_round_trip(spark, sf_dir):
    """Cells written as CSV in the fixed column order, read with inferred types, measured."""
    path = shared_folder(spark)
    tables.write_csv(tables.ordered(b.cells(spark, sf_dir)), path)
    return rounded(phenotype.metric_ranges(phenotype.with_metrics(tables.read_typed(spark, path)), ["soma_cell_ratio", "transformation_index"]))


@query("SELECT 'img' || (s_suppkey % 10) AS image_name, count(*) AS n, count(*) FILTER (s_suppkey % 3 = 0) AS empty, CAST(sum(CASE WHEN s_suppkey % 3 <> 0 THEN 200 + s_suppkey % 7 * 100 END) AS BIGINT) AS areas FROM supplier GROUP BY 1")
def csv_string_round_trip(spark, sf_dir):
    """A sheet read as strings only: blanks stay empty strings, areas are parsed on demand."""
    path = shared_folder(spark)
    s = b.read(spark, sf_dir, "supplier")
    sheet = s.select(F.concat(F.lit("img"), (F.col("s_suppkey") % 10).cast("string")).alias("image_name"), F.when(F.col("s_suppkey") % 3 != 0, (200 + F.col("s_suppkey") % 7 * 100).cast("string")).alias("area"))
    tables.write_csv(sheet, path)
    d = tables.read_strings(spark, path)
    return d.groupBy("image_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") == "").alias("empty"), F.sum(names.area_key(F.col("area"))).alias("areas"))


@query("SELECT l_suppkey AS image_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS mask_area FROM lineitem GROUP BY 1")
def csv_per_image(spark, sf_dir):
    """One folder per image, read back with the image from the folder's name."""
    path = shared_folder(spark)
    d = b.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_name"), F.col("l_extendedprice").alias("mask_area")).repartition("image_name")
    tables.write_csv(d, path, "image_name")
    back = tables.read_per_folder(spark, path, "image_name")
    return back.groupBy(F.col("image_name").cast("long").alias("image_name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mask_area"), 2).alias("mask_area"))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS exposure FROM customer")
def sheet_replaced(spark, sf_dir):
    """A sheet that is read, extended and put in its own place."""
    path = shared_folder(spark)
    c = b.read(spark, sf_dir, "customer")
    tables.write_csv(c.select(F.col("c_custkey").alias("row_id")), path)
    sheet = tables.read_typed(spark, path).join(c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("exposure")), "row_id", "left")
    tables.replace_table(sheet, path)
    return tables.read_typed(spark, path).select(F.col("row_id").cast("long").alias("row_id"), "exposure")


@query(f"WITH {b.CLASSIFIED} SELECT phenotype, count(*) AS n FROM classified GROUP BY 1")
def phenotype_sheet(spark, sf_dir):
    """Labelled cells written next to their sheet under the derived name, and counted from there."""
    path = tables.derived_path(f"{shared_folder(spark)}/cells.csv", "_with_phenotypes.csv")
    tables.write_csv(classified(spark, sf_dir), path)
    return tables.read_strings(spark, path).groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {b.MASK_NAMES} SELECT image_name, soma_id, count(*) AS n FROM (SELECT regexp_extract(filename, '^(.+?)_soma', 1) AS image_name, regexp_extract(filename, 'soma_\\d+_\\d+') AS soma_id FROM names) GROUP BY ALL UNION ALL SELECT 'odd.tif', 'unknown', 1")
def listed_masks(spark, sf_dir):
    """Listing with names that do not match kept as unknown cells."""
    d = b.mask_names(spark, sf_dir).unionByName(spark.range(1).select(F.lit("odd.tif").alias("filename")))
    return images.list_masks(d, keep_unknown=True).groupBy("image_name", "soma_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT DISTINCT 'img' || (c_custkey % 30) AS image_name FROM customer), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'img' ELSE 'IMG' END || (s_suppkey % 23) AS raw_stem, CASE WHEN s_suppkey % 3 = 0 THEN '.tif' ELSE '.png' END AS ending FROM supplier),
 h AS (SELECT image_name, raw_stem || ending AS raw_file, 0 AS k FROM l JOIN r ON image_name = raw_stem AND ending = '.tif' UNION ALL SELECT image_name, raw_stem || ending, 1 FROM l JOIN r ON lower(image_name) = lower(raw_stem)),
 m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY k, raw_file) = 1) SELECT image_name, raw_file, k AS match_rank FROM l LEFT JOIN m USING (image_name)""")
def raw_lookup(spark, sf_dir):
    masks = b.read(spark, sf_dir, "customer").select(F.concat(F.lit("img"), (F.col("c_custkey") % 30).cast("string")).alias("image_name"))
    s = b.read(spark, sf_dir, "supplier")
    stem = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "img").otherwise("IMG"), (F.col("s_suppkey") % 23).cast("string"))
    name = F.concat(stem, F.when(F.col("s_suppkey") % 3 == 0, ".tif").otherwise(".png"))
    return images.find_raw(masks, s.select(name.alias("path"), name.alias("filename"), stem.alias("stem"))).select("image_name", "raw_file", "match_rank")


def _drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """A stream run to the end of what there is, its rows as a table."""
    folder = shared_folder(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _source(spark: SparkSession, df: DataFrame, files: int = 4, by: str | None = None) -> DataFrame:
    """``df`` as a stream of files in order of its first column: ranges of it, or, with ``by``, all rows of a key in one file."""
    folder, order = shared_folder(spark), df.columns[0]
    dealt = df.repartition(files, by) if by else df.repartitionByRange(files, order)
    dealt.sortWithinPartitions(order).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


_STORE = "spark.sql.streaming.stateStore.providerClass"


@query(f"WITH RECURSIVE {b.QA}, {UNDO_STATE} SELECT cell, CAST(m.area AS INTEGER) AS area, m.yes AS approved FROM l WHERE m.ever")
def stream_review(spark, sf_dir):
    """The review state machine fed by a stream; the last decision on every mask that ever changed."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = b.qa_events(spark, sf_dir).select("seq", "cell", "area", "op")
        changed = _drained(review.review_stream(_source(spark, e, by="cell")), spark, "append")
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return changed.groupBy("cell", "area").agg(F.max_by("approved", "seq").alias("approved"))


@query("SELECT user_id AS image_name, max_by(event_type, event_id) AS status FROM events GROUP BY 1")
def stream_status(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("image_name"), F.col("event_type").alias("status"))
    found = _drained(review.status_stream(_source(spark, e)), spark, "update")
    return found.groupBy("image_name").agg(F.max_by("status", "batch").alias("status"))


@query("WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(spark, sf_dir):
    """Tumbling windows of a stream with a watermark: the windows that are final."""
    e = b.read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    done = _drained(review.activity_windows(_source(spark, e)), spark, "append")
    return done.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id AS cell, CAST(200 AS INTEGER) AS area, NULL::BOOLEAN AS approved, NULL::BOOLEAN AS live FROM events WHERE FALSE")
def review_agrees(spark, sf_dir):
    """Masks on which the stream's last decision and the batch replay differ: none."""
    batch = qa.replay_with_undo(b.qa_masks(spark, sf_dir), b.qa_events(spark, sf_dir))
    live = QUERIES["stream_review"](spark, sf_dir).select("cell", "area", F.col("approved").alias("live"))
    return batch.join(live, ["cell", "area"], "left").where(~F.col("approved").eqNullSafe(F.col("live")))
