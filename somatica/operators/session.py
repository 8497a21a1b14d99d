"""State of a working session as tables of edits: selection, picks with undo, cleared masks, soma rasters and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators.merge import ranked_match
from somatica.operators.pixels import AT

#: States of an image that has masks, and the one it falls back to.
WITH_MASKS, OUTLINED = ("masks_generated", "qa_complete", "morphology_calculated"), "outlined"


def selection(images: DataFrame, edits: DataFrame) -> DataFrame:
    """``selected`` of every image (image_name): as the last edit says that concerns it.

    ``edits``: seq, op (all, clear, check, uncheck), image_name (of the last two). Images are selected before any edit.
    """
    last = F.max(F.struct("seq", F.col("op").isin("all", "check").alias("on")))
    every = edits.where("op in ('all', 'clear')").agg(last.alias("every"))
    own = edits.where("op in ('check', 'uncheck')").groupBy("image_name").agg(last.alias("own"))
    both = images.select("image_name").join(own, "image_name", "left").crossJoin(F.broadcast(every))  # one row
    return both.select("image_name", F.coalesce(F.greatest("own", "every")["on"], F.lit(True)).alias("selected"))


def after_undo(edits: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The picks or points that stay: rows of ``edits`` with op ``add`` that no later ``undo`` of their keys takes back.

    An undo takes back the last one there is, and does nothing where there is none. The height of the stack is a running sum
    less its running minimum; an added row stays if the stack never falls below its height again.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.col("op") == "add", 1).otherwise(-1)
    d = edits.where("op in ('add', 'undo')").withColumn("_sum", F.sum(step).over(w))
    d = d.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    d = d.withColumn("_later", F.min("_height").over(w.rowsBetween(1, Window.unboundedFollowing)))
    return d.where("op = 'add' and coalesce(_later, _height) >= _height").select(*edits.columns)


def without_masks(images: DataFrame) -> DataFrame:
    """``images`` after all masks have been cleared: those that had some are outlined again."""
    return images.withColumn("status", F.when(F.col("status").isin(*WITH_MASKS), OUTLINED).otherwise(F.col("status")))


def soma_rasters(cells: DataFrame, files: DataFrame, folders: tuple[str, ...] = ("",)) -> DataFrame:
    """Soma raster of each cell (image_name, soma_id): soma_file, soma_folder and match_rank; null where there is none.

    ``files``: filename, folder. Of the ``folders`` the first that has one counts, and in it ``<image>_<soma>_soma.tif``, then
    ``<soma>_soma.tif``, then any file whose name holds the soma id, by name.
    """
    soma = F.regexp_extract("filename", r"(soma_\d+_\d+)", 1)
    right = files.where(F.col("folder").isin(*folders) & (soma != "")).select(F.col("filename").alias("soma_file"), F.col("folder").alias("soma_folder"), soma.alias("_soma"))
    left = cells.select("image_name", "soma_id").distinct()
    same = F.col("soma_id") == F.col("_soma")
    own = F.concat(F.regexp_replace("image_name", r"(?i)\.tiff?$", ""), F.lit("_"), F.col("soma_id"), F.lit("_soma.tif"))
    rules = [same & (F.col("soma_folder") == f) & how for f in folders for how in (F.col("soma_file") == own, F.col("soma_file") == F.concat("soma_id", F.lit("_soma.tif")), F.lit(True))]
    return ranked_match(left, right, rules, ["image_name", "soma_id"], [F.col("soma_file")]).drop("_soma")


def same_shape(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` (image, height, width) whose image has the same shape in ``right``, and those whose image differs."""
    r = right.select("image", F.col("height").alias("_h"), F.col("width").alias("_w")).distinct()
    both = left.join(r, "image")
    fits = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    return both.where(fits).drop("_h", "_w"), both.where(~fits).drop("_h", "_w")


def clipped_to_raw(px: DataFrame, raw: DataFrame) -> DataFrame:
    """``px`` cut to 0 and the largest value of the raw image, as a preview shows it."""
    top = raw.groupBy("image").agg(F.max("v").alias("_top"))
    return px.join(top, "image").select(*AT, F.greatest(F.lit(0.0), F.least("v", F.col("_top").cast("double"))).alias("v"))
