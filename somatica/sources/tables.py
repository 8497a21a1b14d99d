"""Tables of metrics: reading sheets as strings or typed, and writing results in fixed column orders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somatica.functions import names
from somatica.operators import batches
from somatica.sources import folders

#: Column orders of the written tables.
ID_COLUMNS = ("image_name", "animal_id", "treatment", "soma_id", "soma_idx")
METADATA_COLUMNS = ("image_name", "animal_id", "treatment", "soma_id", "soma_idx", "soma_row", "soma_col", "area_um2", "mask_filename", "pixel_size_um", "mask_area", "perimeter", "eccentricity", "roundness", "average_centroid_distance", "soma_area")
#: Column orders of the two result sheets.
FRACTAL_COLUMNS = (
    "cell_name", "image_name", "soma_id", "mask_area_um2", "mask_file", "fractal_dimension", "fractal_r_squared", "fractal_lacunarity_mean", "fractal_lacunarity_small",
    "fractal_lacunarity_large", "fractal_num_scales", "fractal_foreground_pixels", "fractal_foreground_area_um2", "hull_area_px", "hull_area_um2", "hull_perimeter_px",
    "hull_perimeter_um", "hull_circularity", "hull_density", "hull_max_span_px", "hull_max_span_um", "hull_span_ratio",
)
SKELETON_COLUMNS = (
    "cell_name", "mask_file", "skeleton_file", "pixel_size_um", "upscale_factor", "mask_area_um2", "mask_perimeter_um", "mask_circularity", "mask_aspect_ratio", "mask_roundness",
    "mask_solidity", "num_branches", "num_junctions", "num_end_points", "num_junction_voxels", "num_slab_voxels", "num_triple_points", "num_quadruple_points",
    "max_branch_length_um", "avg_branch_length_um", "longest_shortest_path_um", "total_skeleton_length_um", "skeleton_area_um2", "branching_density",
)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string; empty fields are empty strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types; NA is null."""
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path)


def read_per_folder(spark: SparkSession, path: str, by: str) -> DataFrame:
    """A sheet with one folder per value of ``by``, with inferred types; NA is null, ``by`` is text. Where Arrow knows the store, the driver lists no folders."""
    if folders.reached(spark, path):
        return folders.read(spark, path, by, nullValue="NA")
    return read_typed(spark, path).withColumn(by, F.col(by).cast("string"))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet as strings; needs the optional package openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("reading .xlsx files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str).fillna(""))


def ordered(df: DataFrame, first: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    """The id columns first (those there are), the rest by name."""
    ids = [c for c in first if c in df.columns]
    return df.select(*ids, *sorted(set(df.columns) - set(ids)))


def mask_metadata(results: DataFrame, pixel_size: float) -> DataFrame:
    """Table of the masks in the fixed order: the true pixel size, row and column of the soma, and exported file names."""
    named = names.mask_file(names.stem(F.col("image_name")), F.col("soma_id"), F.col("area_um2"))
    out = results.withColumns({"mask_filename": named, "pixel_size_um": F.lit(float(pixel_size)), "soma_row": F.col("row"), "soma_col": F.col("col")})
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in METADATA_COLUMNS])


def result_sheet(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` in the fixed order of a result sheet; columns that are not in the sheet are left out, and one that is missing is an error.

    ``operators.sheets`` makes the rows of both sheets."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the sheet needs {', '.join(missing)}")
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV with a header; missing values are empty. One folder per value of ``partition_by`` if given: tasks put them in place where Arrow
    knows the store, otherwise the driver does, which then keeps all their names."""
    if partition_by and folders.reached(df.sparkSession, path):
        folders.write(df, path, partition_by)
        return
    writer = df.write.mode("errorifexists").option("header", True).option("nullValue", "")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def derived_path(path: str, ending: str) -> str:
    """``path`` with ``.csv`` at its end replaced, as in ``x.csv`` to ``x_with_phenotypes.csv``."""
    return re.sub(r"\.csv$", ending, path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df``, which may read from ``path``, in its place: first to a sibling; then the old one is put aside, the new one
    takes its name, and the old one goes. At no time is there neither."""
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    write_csv(df, fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(path), hadoop(fresh)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = hadoop(f"{fresh}.old")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"could not put {path} aside")
    if not fs.rename(new, old):
        raise OSError(f"could not rename {fresh}; the former table is {fresh}.old")
    fs.delete(aside, True)


def raster_files(px: DataFrame, ending: str, kind: str = "u2", pixel_size: float | None = None, height: int | Column | None = None, width: int | Column | None = None) -> DataFrame:
    """Dense or sparse pixels (image, y, x, v) to rows of filename (image and ``ending``) and TIFF content, one per image.

    Values are cut to the range of ``kind`` (u1, u2, or f4 as they are) and to whole numbers; pixels without a row are 0. ``height`` and
    ``width`` of the frame are numbers, or columns of ``px``; without them the picture ends at the last row and column that has a
    pixel, which suits dense rasters only. A pixel outside the frame is an error. Several channels (column ``c``) or planes become
    pages. Processed rasters end in ``_processed.tif``, soma masks (image ``<image>_<soma>``) in ``_soma.tif``. Many images a call.
    """

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        from somatica.sources import tiff

        c, y, x = (batches.numbers(table, n) for n in ("c", "y", "x"))
        v, images, out = table.column("v").cast(pa.float64()).to_numpy(), batches.chosen(table, "image", starts).to_pylist(), []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            frame = [int(own[0].as_py()) if not (own := table.column(a).slice(i, j - i)).null_count else int(at[i:j].max()) + 1 for a, at in (("_h", y), ("_w", x))]
            image = np.zeros((int(c[i:j].max()) + 1, *frame))
            image[c[i:j], y[i:j], x[i:j]] = v[i:j]
            if kind != "f4":
                image = np.floor(np.clip(image, 0, np.iinfo(kind).max))
            out.append(tiff.encode(image.astype(kind), pixel_size))
        return pa.RecordBatch.from_arrays([pa.array([f"{n}{ending}" for n in images], pa.string()), pa.array(out, pa.binary())], ["filename", "content"])

    page = F.col("c").cast("int") if "c" in px.columns else F.lit(0)
    framed = [F.lit(n).cast("int").alias(a) for n, a in ((height, "_h"), (width, "_w"))]
    rows = px.select(F.col("image").cast("string").alias("image"), page.alias("c"), "y", "x", F.col("v").cast("double").alias("v"), *framed)
    return batches.apply(rows, ["image"], run, "filename string, content binary")


def mask_files(masks: DataFrame, pixel_size: float = 0.316) -> DataFrame:
    """Approved masks (image_name, soma_id, area, approved, y, x, height, width) to rows of filename and TIFF content, empty
    masks left out. One group per mask."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from somatica.sources import tiff

        image = np.zeros((int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])), np.uint8)
        image[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = 255
        return pd.DataFrame({"filename": [pdf["filename"].iloc[0]], "content": [tiff.encode(image, pixel_size)]})

    named = masks.where("approved").withColumn("filename", names.mask_file(names.stem(F.col("image_name")), F.col("soma_id"), F.col("area")))
    return named.select("filename", "y", "x", "height", "width").groupBy("filename").applyInPandas(run, "filename string, content binary")
