"""Sheets with one folder per value: round trips of odd values, and nothing of the folders in the driver."""

import os

import pytest
from pyspark.sql import functions as F

from somatica.plans.source_queries import QUERIES
from somatica.sources import folders, tables

ODD = [("a/b:c", 1.5, "x,y"), (None, None, None), ("", 2.0, ""), ("e é=%", 3.0, 'q"z'), ("007", 4.0, "NA"), ("007", 5.5, "ü"), ("[^]", None, "last")]


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_values(spark, tmp_path):
    """Lines and layout are Spark's own; names come back as text, null and empty ones as null."""
    d = spark.createDataFrame(ODD, "k string, v double, w string")
    tables.write_csv(d.repartition(3), f"{tmp_path}/x y%", "k")
    back = tables.read_per_folder(spark, f"{tmp_path}/x y%", "k")
    assert back.schema.simpleString() == "struct<v:double,w:string,k:string>"
    want = [(1.5, "x,y", "a/b:c"), (None, None, None), (2.0, "", None), (3.0, 'q"z', "e é=%"), (4.0, None, "007"), (5.5, "ü", "007"), (None, "last", "[^]")]
    assert _sorted(back) == sorted(want, key=repr)
    plain = f"{tmp_path}/plain"
    d.repartition(3).write.option("header", True).option("nullValue", "").partitionBy("k").csv(plain)
    assert {n for n in os.listdir(plain) if "=" in n} == {n for n in os.listdir(f"{tmp_path}/x y%") if "=" in n}
    assert _sorted(tables.read_per_folder(spark, plain, "k")) == sorted(want, key=repr)
    other = tables.read_typed(spark, f"{tmp_path}/x y%")
    assert _sorted(other.select("v", "w")) == sorted([w[:2] for w in want], key=repr)
    with pytest.raises(FileExistsError):
        tables.write_csv(d, f"{tmp_path}/x y%", "k")
    assert not os.path.exists(f"{tmp_path}/x y%/_temporary") and os.path.exists(f"{tmp_path}/x y%/_SUCCESS")


def test_missing_value_alone(spark, tmp_path):
    """A row whose only value is missing stays a row."""
    tables.write_csv(spark.createDataFrame([(1, 2.5), (1, None), (2, None)], "k long, v double"), f"{tmp_path}/x", "k")
    assert _sorted(tables.read_per_folder(spark, f"{tmp_path}/x", "k")) == sorted([(2.5, "1"), (None, "1"), (None, "2")], key=repr)


def test_lines_over_blocks(spark, tmp_path, monkeypatch):
    """Files of any length, line breaks of two characters, no break at the end, no lines, no header."""
    monkeypatch.setattr(folders, "BLOCK", 7)
    texts = {"a": b"v,w\r\n1,x\r\n\r\n22222222222,yyyyyyyyyyy\r\n3,z", "b": b"v,w\n", "c": b"v,w", "d": b"", "e": b"a long first line,w\n" + b"5,\xc3\xa4\n" * 9}
    for name, text in texts.items():
        (tmp_path / f"k={name}").mkdir()
        (tmp_path / f"k={name}" / "part.csv").write_bytes(text)
        (tmp_path / f"k={name}" / ".part.csv.crc").write_bytes(b"crc")
    for name, text in texts.items():
        import io

        whole = [t for _, t in folders._blocks(io.BytesIO(text))]
        assert "\n".join(whole).replace("\r", "") == text.decode().replace("\r", "").removesuffix("\n")
    back = tables.read_per_folder(spark, str(tmp_path), "k")
    assert _sorted(back.select(F.col("v").cast("long"), "w", "k")) == sorted([(1, "x", "a"), (22222222222, "yyyyyyyyyyy", "a"), (3, "z", "a")] + [(5, "ä", "e")] * 9, key=repr)


def test_csv_per_image(spark, tmp_path):
    """Counts rows without a price, takes an empty table, and leaves listing and reading to a few tasks: before, the driver kept every file."""
    rows = [(k, float(k) + i) for k in range(50) for i in range(3)] + [(7, None), (None, 1.25)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/in/lineitem.parquet")
    out = QUERIES["csv_per_image"](spark, f"{tmp_path}/in")
    got = {r.image_name: (r.n, r.mask_area) for r in out.collect()}
    assert len(got) == 51 and got[7] == (4, 24.0) and got[None] == (1, 1.25) and got[49] == (3, 150.0)
    assert out.inputFiles() == []
    spark.createDataFrame([], "l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    none = QUERIES["csv_per_image"](spark, f"{tmp_path}/none")
    assert none.schema == out.schema and none.count() == 0


def test_stores_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    """These go through Spark's own writer and reader."""
    assert folders.reached(spark, str(tmp_path)) and folders.reached(spark, f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./x", f"file://{tmp_path}")
    path = "viewfs://tests/x/y"
    assert not folders.reached(spark, path)
    tables.write_csv(spark.createDataFrame([(1, 2.5), (2, 3.5)], "k long, v double"), path, "k")
    assert _sorted(tables.read_per_folder(spark, path, "k")) == [(2.5, "1"), (3.5, "2")]
