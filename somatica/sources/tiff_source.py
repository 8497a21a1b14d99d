"""TIFF files as a Spark data source: ``spark.read.format("tiff")`` and ``df.write.format("tiff")``.

Reading gives one row per strip or tile; a large file is cut into runs of them, each a partition that reads only its byte ranges.
``register`` makes the format known to a session. Files are reached through Arrow's file systems (local and shared
folders, object stores, HDFS where its library is there).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, filename string, page int, sample int, y int, x int, h int, w int, height int, width int, samples int, kind string, pixel_size double, piece binary"
WRITTEN = "filename string, content binary"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Run(InputPartition):
    """Segments ``first`` up to ``last`` of a file, counted over its pages; None: all, and all of the files ``more``."""

    path: str
    first: int | None = None
    last: int | None = None
    more: tuple[str, ...] = ()


#: Opening a file counts like reading so many bytes, where small files share a partition.
OPENING = 1 << 20


class TiffSource(DataSource):
    """Options of reading: ``path`` (a file or folder), ``pathGlobFilter``, ``splitBytes`` (size of a partition, 64 MB by default),
    ``pushNames`` (conditions on filename are met before files are opened; Spark allows that where
    ``spark.sql.python.filterPushdown.enabled`` is set)."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TiffReader:
        options = dict(self.options)
        return (NamedTiffReader if options.get("pushnames", options.get("pushNames")) == "true" else TiffReader)(options)

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        if overwrite:
            raise ValueError("the tiff sink only appends")
        return TiffWriter(dict(self.options)["path"])


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*"))
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.wanted: list[Filter] = []

    def _named(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringEndsWith: lambda f: name.endswith(f.value)}
        return not name.startswith(".") and fnmatch.fnmatch(name, self.pattern) and all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[Run]:
        """Small files together up to the split size; of files over it the directories are read, and runs of segments of about that size."""
        from pyarrow import fs

        from somatica.sources import tiff

        system, where = _opened(self.folder)
        info = system.get_file_info(where)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where))
        out, small, filled = [], [], 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and self._named(f.base_name)), key=lambda f: f.path):
            path = self.folder if info.type == fs.FileType.File else f"{self.folder.rstrip('/')}/{f.base_name}"
            if f.size <= self.split:
                if small and filled + f.size + OPENING > self.split:
                    out.append(Run(small[0], more=tuple(small[1:])))
                    small, filled = [], 0
                small.append(path)
                filled += f.size + OPENING
                continue
            with system.open_input_file(f.path) as file:
                sizes = [s.size for tags in tiff.directories(lambda at, n, file=file: file.read_at(n, at)) for s in tiff.segments(tags)]
            first, held = 0, 0
            for k, n in enumerate(sizes):
                held += n
                if held >= self.split or k + 1 == len(sizes):
                    out.append(Run(path, first, k + 1))
                    first, held = k + 1, 0
        if small:
            out.append(Run(small[0], more=tuple(small[1:])))
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition.path:
            yield from self._read(partition)
        for path in partition.more:
            yield from self._read(Run(path))

    def _read(self, partition: Run) -> Iterator[tuple]:
        from somatica.sources import tiff

        system, where = _opened(partition.path)
        name, k = partition.path.rsplit("/", 1)[-1], 0
        with system.open_input_file(where) as file:
            for page, tags in enumerate(tiff.directories(lambda at, n: file.read_at(n, at))):
                own = tiff.segments(tags)
                first, last = (0, len(own)) if partition.first is None else (max(0, partition.first - k), min(len(own), partition.last - k))
                k += len(own)
                for s in own[first:last] if first < last else []:
                    block = tiff.segment_array(tags, s, file.read_at(s.size, s.offset))
                    yield partition.path, name, page, s.sample, s.y, s.x, s.height, s.width, *tiff.shape(tags), tiff.kind_of(tags), tiff.pixel_size(tags), block.tobytes()


class NamedTiffReader(TiffReader):
    """Reader that takes conditions on the file's name."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the file's name are met here, before a file is opened; others go back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("filename",):
                self.wanted.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """Temporary names of a task's files and the names they are to get."""

    names: list[tuple[str, str]]


class TiffWriter(DataSourceWriter):
    """Rows (filename, content) to files: each task writes under names of its own, which become the files' names when all tasks are
    done, so a task that runs twice leaves nothing behind."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        system, where = _opened(self.folder)
        system.create_dir(where, recursive=True)
        names = []
        for row in iterator:
            own = f"{where}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(bytes(row["content"]))
            names.append((own, f"{where}/{row['filename']}"))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.folder)
        for own, name in (pair for m in messages if m for pair in m.names):
            system.move(own, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.folder)
        for own, _ in (pair for m in messages if m for pair in m.names):
            system.delete_file(own)


_KNOWN: set[str] = set()


def register(spark: SparkSession) -> None:
    """Makes the format known to the application, once."""
    if spark.sparkContext.applicationId not in _KNOWN:
        spark.dataSource.register(TiffSource)
        _KNOWN.add(spark.sparkContext.applicationId)


def read_segments(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Strips and tiles of a file or folder, one row each (``SCHEMA``)."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tiff").options(path=path, pushNames=push, **options).load()


def read_tiles(spark: SparkSession, path: str, page: int | None = None, size: int = 512, **options: str) -> DataFrame:
    """Tiles (``operators.tiles``) of the first sample of every file (image: its name); over several pages the largest values,
    or those of one ``page``. No task holds more than a segment and a tile."""
    from somatica.operators import tiles

    s = read_segments(spark, path, **options).where("coalesce(sample, 0) = 0")
    return tiles.from_blocks((s if page is None else s.where(F.col("page") == page)).withColumnRenamed("filename", "image"), size)


def write_files(files: DataFrame, path: str) -> None:
    """Rows (filename, content) as files of a folder."""
    register(files.sparkSession)
    files.select("filename", "content").write.format("tiff").mode("append").save(path)
