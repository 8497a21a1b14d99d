"""Folders of images and masks as tables. Names are filtered before any content is read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatica.functions import names

_KIND = T.StructType([
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.DoubleType())), T.StructField("pixel_size", T.DoubleType()), T.StructField("error", T.StringType()),
])


def list_images(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff,png,jpg,jpeg,TIF,TIFF,PNG,JPG,JPEG}") -> DataFrame:
    """Files of a folder: path, filename, stem; hidden ones left out. Content is read only where a later step asks for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"filename": name, "stem": names.stem(name)}).where(~F.startswith("filename", F.lit("."))).dropDuplicates(["path"])


def registry(files: DataFrame) -> DataFrame:
    """Image registry in its first state: image_name, raw_path, status, selected, animal_id, treatment."""
    return files.select(F.col("filename").alias("image_name"), F.col("path").alias("raw_path"), F.lit(None).cast("int").alias("rolling_ball_radius"), F.lit("loaded").alias("status"), F.lit(True).alias("selected"), F.lit("").alias("animal_id"), F.lit("").alias("treatment"))


def decoded(files: DataFrame, default_pixel_size: float = 0.104, pixel_size: float | None = None) -> DataFrame:
    """``files`` (filename, content) with height, width, channels, data (raster order, channels last), pixel_size and error.

    A file that cannot be read has nulls and says why in ``error``; it does not stop the others. An explicit pixel size
    wins over the file's, and the default stands in for a missing one.
    """

    @F.arrow_udf(_KIND)
    def decode(contents: pa.Array) -> pa.Array:
        from somatica.sources import tiff

        rows = []
        for content in contents:
            try:
                a = tiff.channels_last(tiff.decode(content.as_py()))
                rows.append((*a.shape, a.ravel(), tiff.resolution(content.as_py()), None))
            except Exception as e:  # noqa: BLE001  the message goes to the row
                rows.append((None, None, None, None, None, str(e)[:200]))
        kinds = {"height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "data": pa.list_(pa.float64()), "pixel_size": pa.float64(), "error": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    out = files.withColumn("_d", decode("content")).select(*[c for c in files.columns if c != "content"], "_d.*")
    return out.withColumn("pixel_size", F.coalesce(F.lit(pixel_size).cast("double"), "pixel_size", F.lit(default_pixel_size)))


def pictures(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}", pixel_size: float = 0.104) -> DataFrame:
    """PNG and JPEG files of a folder as ``decoded`` gives TIFF files: red, green and blue (and alpha) of 8 bits, or one grey channel.

    Spark's image source decodes them; it stores colours as blue, green, red. A file that cannot be read has null data and an error.
    """
    d = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder).select("image.*")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def samples(data: pa.Array, channels: pa.Array) -> pa.Array:
        import numpy as np

        rows = []
        for content, n in zip(data, channels.to_pylist(), strict=True):
            a = np.frombuffer(content.as_py() or b"", np.uint8)
            rows.append(a.reshape(-1, n)[:, [2, 1, 0, 3][:n]].ravel().astype(float) if n in (3, 4) else a.astype(float))
        return pa.array(rows, pa.list_(pa.float64()))

    good = F.col("height") > 0
    known = lambda c: F.when(good, c)
    name = F.url_decode(F.replace(F.element_at(F.split("origin", "/"), -1), F.lit("+"), F.lit("%2B")))
    return d.select(
        F.col("origin").alias("path"), name.alias("filename"), names.stem(name).alias("stem"), known(F.col("height")).alias("height"), known(F.col("width")).alias("width"), known(F.col("nChannels")).alias("channels"),
        known(samples("data", "nChannels")).alias("data"), F.lit(pixel_size).alias("pixel_size"), F.when(~good, "not a readable picture").alias("error"),
    )


def pixels(images: DataFrame, key: str = "filename") -> DataFrame:
    """Decoded images to pixels: image, c, y, x, v."""
    d = images.where("data is not null").select(F.col(key).alias("image"), "width", "channels", F.posexplode("data").alias("i", "v"))
    at = F.floor(F.col("i") / F.col("channels"))
    return d.select("image", (F.col("i") % F.col("channels")).cast("int").alias("c"), F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).cast("int").alias("x"), "v")


def list_masks(files: DataFrame, dialect: str = "lazy_any", keep_unknown: bool = False) -> DataFrame:
    """Mask files with their name's parts. Names that do not match are dropped, or kept as unknown cells."""
    parts = names.unknown_parts(F.col("filename")) if keep_unknown else names.mask_parts(F.col("filename"), dialect)
    out = files.withColumns(parts)
    return out if keep_unknown else out.where("soma_id is not null")


def read_groups(spark: SparkSession, root: str, groups: tuple[str, ...] = ("1d", "3d", "7d", "28d"), pattern: str = "*.{tif,tiff,TIF,TIFF}") -> tuple[DataFrame | None, list[str]]:
    """Files of every timepoint folder with ``timepoint``, and the folders that are missing (no error)."""
    found, missing = None, []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for g in groups:
        path = hadoop(f"{root}/{g}")
        if not path.getFileSystem(conf).exists(path):
            missing.append(g)
            continue
        part = list_images(spark, f"{root}/{g}", pattern).withColumn("timepoint", F.lit(g))
        found = part if found is None else found.unionByName(part)
    return found, missing


def find_raw(masks: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw file of each mask's image: an exact .tif name first, else any file of the same stem whatever its case."""
    from somatica.operators.merge import ranked_match

    left = masks.select("image_name").distinct()
    right = raw.select(F.col("path").alias("raw_path"), F.col("filename").alias("raw_file"), F.col("stem").alias("raw_stem"))
    exact = (F.col("image_name") == F.col("raw_stem")) & F.col("raw_file").rlike(r"\.(tif|tiff|TIF|TIFF)$")
    return ranked_match(left, right, [exact, F.lower("image_name") == F.lower("raw_stem")], ["image_name"], [F.col("raw_file")])
