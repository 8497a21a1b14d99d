"""CSV with one folder per value of a column, for any number of values: tasks write, list and read the folders.

Spark's own writer sends every folder's name to the driver, and its reader keeps every file there, each several times. Here the driver gets one
name for each task. The layout is the same (``path/column=value/part-*.csv``), and so are the lines: Spark's CSV expressions make
and read them. Folders are reached through Arrow's file systems, as by the TIFF source.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somatica.operators import batches

#: Folder of missing and of empty values.
MISSING = "__HIVE_DEFAULT_PARTITION__"

#: Bytes that a task reads, and cuts into lines, at a time.
BLOCK = 1 << 20

_STAGED = "_temporary"


def address(spark: SparkSession, path: str) -> str:
    """``path`` as an address with the scheme that Hadoop finds for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def _opened(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def reached(spark: SparkSession, path: str) -> bool:
    """Whether Arrow knows the store of ``path``."""
    try:
        _opened(address(spark, path))
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _escaped(name: str) -> str:
    """As Spark escapes what a folder's name must not hold."""
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def _unescaped(name: str) -> str | None:
    return None if name == MISSING else re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def _visible(infos: list) -> list:
    return sorted((i for i in infos if i.base_name[:1] not in ("", ".", "_")), key=lambda i: i.path)


def _csv(columns: list[Column]) -> Column:
    """A row as a line. A missing value is empty, one that is alone in its row is quoted: an empty line would not count as a row."""
    line = F.to_csv(F.struct(*columns), {"nullValue": ""})
    return line if len(columns) > 1 else F.when(columns[0].isNull(), F.lit('""')).otherwise(line)


def write(df: DataFrame, path: str, by: str) -> None:
    """``df`` to a new folder ``path``. A task writes one file for each of its values of ``by``, under names of its own, and these move to
    their places when all tasks are done; a task that runs twice leaves nothing behind. Deal ``df`` by ``by`` for one file a folder."""
    from pyarrow import fs

    spark, columns = df.sparkSession, [c for c in df.columns if c != by]
    if len(columns) in (0, len(df.columns)):
        raise ValueError(f"no column {by}, or no other")
    where = address(spark, path)
    system, root = _opened(where)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    head = spark.range(1).select(_csv([F.lit(c).alias(c) for c in columns])).first()[0]

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        system, root = _opened(where)
        own, name, out = uuid.uuid4().hex, None, None
        system.create_dir(f"{root}/{_STAGED}/{own}", recursive=True)
        try:
            for batch in rows:
                runs, lines, first = pc.run_end_encode(batch.column(0)), batch.column(1).to_pylist(), 0
                for value, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if value != name:
                        if out:
                            out.close()
                        name, out = value, system.open_output_stream(f"{root}/{_STAGED}/{own}/{_escaped(by)}={_escaped(value)}")
                        lines[first] = f"{head}\n{lines[first]}"
                    out.write(("\n".join(lines[first:last]) + "\n").encode())
                    first = last
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.string())], ["own"])

    def place(own: str) -> None:
        system, root = _opened(where)
        for f in system.get_file_info(fs.FileSelector(f"{root}/{_STAGED}/{own}")):
            system.create_dir(f"{root}/{f.base_name}", recursive=True)
            system.move(f.path, f"{root}/{f.base_name}/part-{own}.csv")

    value = F.coalesce(F.nullif(_col(by).cast("string"), F.lit("")), F.lit(MISSING))
    rows = df.select(value.alias("_folder"), *map(_col, columns)).sortWithinPartitions("_folder").select("_folder", _csv([*map(_col, columns)]).alias("_line"))
    try:
        made = [r.own for r in rows.mapInArrow(run, "own string").collect()]
        if made:
            spark.sparkContext.parallelize(made, len(made)).foreach(place)
    finally:
        if system.get_file_info(f"{root}/{_STAGED}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{_STAGED}")
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_head") as out:  # a sheet without rows has no other place for its columns
        out.write(head.encode())
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _folders(spark: SparkSession, where: str, by: str) -> DataFrame:
    """Names of the folders, listed in one task."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, root = _opened(where)
        for _ in rows:
            names = [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith(f"{_escaped(by)}=")]
            for k in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 10_000], pa.string())], ["folder"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "folder string")


def _blocks(file) -> Iterator[tuple[bool, str]]:
    """A file's text in blocks of whole lines: whether it is the first line, and the text without the last line break."""
    rest, first = b"", True
    while block := file.read(BLOCK):
        rest += block
        if first and (end := rest.find(b"\n") + 1):
            yield True, rest[: end - 1].decode(errors="replace").rstrip("\r")
            rest, first = rest[end:], False
        if not first and (end := rest.rfind(b"\n") + 1):
            yield False, rest[: end - 1].decode(errors="replace")
            rest = rest[end:]
    if rest:
        yield first, rest.decode(errors="replace")


def _lines(folders: DataFrame, where: str, heads: bool = False) -> DataFrame:
    """Rows of the value of a folder and a line of its files: all but their first lines, or only these."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        def cut():
            parts = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
            lines, values = pc.utf8_rtrim(parts.flatten(), "\r"), pa.array(names, pa.string()).take(pc.list_parent_indices(parts))
            return pa.RecordBatch.from_arrays([values, lines.cast(pa.string())], ["name", "line"])

        system, root = _opened(where)
        names, texts, held = [], [], 0
        for batch in rows:
            for folder in batch.column(0).to_pylist():
                name = _unescaped(folder.split("=", 1)[1])
                for f in _visible(system.get_file_info(fs.FileSelector(f"{root}/{folder}"))):
                    with system.open_input_stream(f.path, buffer_size=0) as file:
                        for head, text in _blocks(file):
                            if head != heads:
                                continue
                            names.append(name)
                            texts.append(text)
                            held += len(text)
                            if held >= BLOCK or heads:
                                yield cut()
                                names, texts, held = [], [], 0
        if texts:
            yield cut()

    return folders.mapInArrow(run, "name string, line string")


def read(spark: SparkSession, path: str, by: str, **options: str) -> DataFrame:
    """What ``write`` or Spark's writer left at ``path``: columns with the types that Spark infers from all lines, then ``by`` as text, null for the folder of
    missing values. ``options`` are those of Spark's CSV reader. A line is a row; empty lines are none."""
    from pyarrow import fs

    where = address(spark, path)
    system, root = _opened(where)
    folders = _folders(spark, where, by)
    if system.get_file_info(f"{root}/_head").type == fs.FileType.File:
        with system.open_input_stream(f"{root}/_head") as file:
            head = file.read().decode()
    elif (first := _lines(folders, where, heads=True).first()) is not None:
        head = first["line"]
    else:
        raise ValueError(f"{path} has no folder of {by} with a file")
    dealt = folders.repartition(batches.parts(folders), "folder")
    lines = _lines(dealt, where).where("trim(line) <> ''")
    reader = spark._jsparkSession.read().option("header", True).option("inferSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    texts = spark.createDataFrame([(head,)], "line string").coalesce(1).union(lines.select("line"))
    schema = reader.csv(getattr(texts._jdf, "as")(spark._jvm.Encoders.STRING())).schema().toDDL()
    return lines.select(F.from_csv("line", schema, options).alias("_row"), F.col("name").alias(by)).select("_row.*", _col(by))
