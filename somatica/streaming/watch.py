"""Images that arrive while a job runs: decoded batch by batch, faulty files put aside, progress told as it happens."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from somatica.sources import images


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` reports of the streams it listens to: batch, rows, and what the stream observes (``observed``)."""

    def __init__(self, most: int = 1000):
        self.reports: deque[dict] = deque(maxlen=most)
        self.started: list[str] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802  names set by Spark
        self.started.append(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.reports.append({"id": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "observed": observed})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append((str(event.id), event.exception))


def arriving(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff,TIF,TIFF}", per_batch: int = 100) -> DataFrame:
    """Files of a folder as a stream: path, filename, content; some ``per_batch`` files a batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where(~F.startswith("filename", F.lit(".")))


def decode_arriving(files: DataFrame, out: str, checkpoint: str, name: str = "images", **how) -> StreamingQuery:
    """Decodes a stream of files into ``out``/images and the faulty ones, with what is wrong with them, into ``out``/faults.

    Every batch is decoded once and written under its number, so a batch that is repeated after a failure replaces itself. Files and
    faults are counted as the stream's observed metrics. One faulty file stops neither the others nor the stream.
    """
    told = [F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("faults")]
    decoded = images.decoded(files.select("path", "filename", "content"), **how).observe("decoding", *told)

    def put(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("error").isNull(), "images").otherwise("faults")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    return decoded.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, out: str, kind: str = "images") -> DataFrame:
    """What a stream has put down so far: the decoded ``images``, or the ``faults`` (path, filename, error)."""
    d = spark.read.parquet(out).where(F.col("kind") == kind).drop("kind")
    return d if kind == "images" else d.select("path", "filename", "error", "batch")
