"""Names, merges, tests on counts, review, files and streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatica.functions import names
from somatica.operators import merge, phenotype, qa, session, sheets, statistics
from somatica.sources import images, tables, tiff
from somatica.streaming import review


def test_name_dialects(spark):
    d = spark.createDataFrame([("a_soma_1_2_x_soma_3_4_area500_mask.tif",), ("b_soma_1_2_area200_mask.TIFF",), ("c.tif",), (None,)], "f string")
    lazy = [r.image_name for r in d.select(names.mask_parts(F.col("f"), "lazy_any")["image_name"].alias("image_name")).collect()]
    greedy = [r.image_name for r in d.select(names.mask_parts(F.col("f"), "greedy_any")["image_name"].alias("image_name")).collect()]
    assert greedy == ["a_soma_1_2_x", "b", None, None] and lazy == greedy
    assert [r.a for r in spark.createDataFrame([("3.5",), ("NaN",), ("x",), ("",), (None,), ("2.5",)], "v string").select(names.area_key(F.col("v")).alias("a")).collect()] == [4, None, None, None, None, 2]
    assert [r.s for r in spark.createDataFrame([("a.b.tif",), (".hidden",), ("plain",)], "n string").select(names.stem(F.col("n")).alias("s")).collect()] == ["a.b", ".hidden", "plain"]


def test_phenotype_rules(spark):
    rows = [(0.0, 0.0, 5.0, 0.5, 0.5), (60.0, 100.0, 5.0, 0.5, 0.5), (40.0, 100.0, 50.0, 0.5, 0.5), (10.0, 100.0, 5.0, 0.1, 0.9), (25.0, 100.0, 5.0, 0.5, 0.5), (1.0, 100.0, 5.0, 0.5, 0.5), (None, 100.0, 5.0, None, 0.9)]
    d = spark.createDataFrame(rows, "soma_area double, mask_area double, perimeter double, roundness double, eccentricity double")
    assert [r.phenotype for r in phenotype.classify(d).collect()] == ["Ramified", "Amoeboid", "Bushy", "Rod", "Hypertrophic", "Ramified", "Ramified"]
    with pytest.raises(ValueError, match="perimeter"):
        phenotype.classify(d.drop("perimeter"))
    wide = phenotype.wide_summary(phenotype.classify(d).withColumn("image_name", F.lit("i")), ["image_name"]).first()
    assert wide.total == 7 and wide.Rod == 1 and wide.pct_Ramified == pytest.approx(42.9)


def test_chi_square_tail():
    assert statistics.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert statistics.chi_square_p(5.991464547107979, 2) == pytest.approx(0.05)
    assert statistics.chi_square_p(7.814727903251179, 3) == pytest.approx(0.05)
    assert statistics.chi_square_p(11.070497693516351, 5) == pytest.approx(0.05)


def test_fisher(spark):
    t = spark.createDataFrame([("x", "P", 8), ("x", "Q", 2), ("y", "P", 1), ("y", "Q", 5)], "treatment string, phenotype string, n long")
    p = {r.phenotype: r.p for r in statistics.fisher_pairs(t).collect()}
    assert p["P"] == pytest.approx(0.03496503496503495) and p["Q"] == pytest.approx(p["P"])


def test_merges(spark):
    master = spark.createDataFrame([(1, " a.TIF", "s", "old"), (2, "b", "s", "old")], "id int, image string, soma string, v string")
    rows = spark.createDataFrame([("a", "s", "first", 1), ("a", "s", "last", 2)], "image string, soma string, v string, seq int")
    out = merge.left_merge(master, {"i": names.image_key(F.col("image")), "s": F.col("soma")}, rows, {"i": F.col("image"), "s": F.col("soma")}, ["v"], [F.col("seq")])
    assert {(r.id, r.v, r.matched) for r in out.collect()} == {(1, "last", True), (2, None, False)}
    assert merge.pick_column(["Image", "x"], ("image_name", "image")) == "Image" and merge.pick_column(["x"], ("image",)) is None


def test_replay_equals_fold(spark):
    rng = random.Random(5)
    cells, areas = list(range(60)), [200, 300, 400, 500]
    events = [(s, rng.choice(cells), rng.choice(areas), rng.choice(["approve", "reject"])) for s in range(900)]
    e = spark.createDataFrame(events, "seq long, cell long, area int, op string")
    m = spark.createDataFrame(list(itertools.product(cells, areas)), "cell long, area int")
    got = {(r.cell, r.area): r.approved for r in qa.replay(m, e).collect()}
    undo = {(r.cell, r.area): r.approved for r in qa.replay_with_undo(m, e).collect()}
    want = {(c, a): s for c in cells for a, s in qa.fold(areas, [x[:1] + x[2:] for x in events if x[1] == c])[0].items()}
    assert got == want == undo


def test_undo():
    state, stack = qa.fold([1, 2, 3], [(1, 2, "approve"), (2, 3, "reject"), (3, 0, "undo"), (4, 0, "undo"), (5, 0, "undo")])
    assert state == {1: None, 2: None, 3: None} and not stack


def test_tiff_round_trip():
    for kind in ("u1", "u2", "f4"):
        a = np.arange(12).reshape(3, 4).astype(kind) * 20
        data = tiff.encode(a, 0.25)
        assert (tiff.decode(data) == a).all() and tiff.resolution(data) == pytest.approx(0.25)
    assert tiff.channels_last(np.zeros((3, 20, 30))).shape == (20, 30, 3) and tiff.channels_last(np.zeros((9, 20, 30))).shape == (20, 30, 1)
    assert tiff.channels_last(np.zeros((5, 2, 20, 30))).shape == (20, 30, 5) and tiff.channels_last(np.zeros((20, 30))).shape == (20, 30, 1)
    with pytest.raises(ValueError):
        tiff.decode(b"PK")


def test_folder_scan(spark, tmp_path):
    for g in ("1d", "7d"):
        (tmp_path / g).mkdir()
    a = np.zeros((4, 5), np.uint16)
    a[1, 2] = 1000
    (tmp_path / "1d" / "i_soma_1_2_area300_mask.tif").write_bytes(tiff.encode(a, 0.5))
    (tmp_path / "1d" / "._i_soma_1_2_area300_mask.tif").write_bytes(b"x")
    (tmp_path / "7d" / "bad.tif").write_bytes(b"broken")
    files, missing = images.read_groups(spark, str(tmp_path))
    assert missing == ["3d", "28d"] and files.count() == 2
    d = {r.filename: r for r in images.decoded(files).collect()}
    good, bad = d["i_soma_1_2_area300_mask.tif"], d["bad.tif"]
    assert (good.height, good.width, good.channels, good.pixel_size, good.timepoint) == (4, 5, 1, 0.5, "1d") and good.data[7] == 1000
    assert bad.error and bad.data is None and bad.pixel_size == 0.104
    assert images.list_masks(files).count() == 1 and images.list_masks(files, keep_unknown=True).count() == 2
    assert images.pixels(images.decoded(files)).where("v > 0").first().v == 1000


def test_sheets(spark, tmp_path):
    d = spark.createDataFrame([("i", "s", 1, 2.5, None)], "image_name string, soma_id string, area_um2 int, perimeter double, animal_id string")
    assert tables.ordered(d).columns == ["image_name", "animal_id", "soma_id", "area_um2", "perimeter"]
    tables.write_csv(d, f"{tmp_path}/x")
    assert tables.read_strings(spark, f"{tmp_path}/x").first().animal_id == ""
    tables.replace_table(tables.read_strings(spark, f"{tmp_path}/x").withColumn("n", F.lit(1)), f"file://{tmp_path}/x")
    assert tables.read_typed(spark, f"{tmp_path}/x").first().n == 1
    assert tables.derived_path("a.csv", "_with_phenotypes.csv") == "a_with_phenotypes.csv"


def test_stream_of_reviews(spark, tmp_path):
    events = [(1, 7, 300, "approve"), (2, 7, 500, "reject"), (3, 7, 0, "undo"), (4, 8, 800, "approve")]
    spark.createDataFrame(events, "seq long, cell long, area int, op string").coalesce(1).write.parquet(f"{tmp_path}/in")
    q = review.review_stream(spark.readStream.schema(review.EVENTS).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {(r.cell, r.area): r.a for r in spark.read.parquet(f"{tmp_path}/out").groupBy("cell", "area").agg(F.max_by("approved", "seq").alias("a")).collect()}
    assert last[7, 200] and last[7, 300] and last[7, 500] is None and all(last[8, a] for a in range(200, 900, 100))


def test_tiff_compressions():
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 5, (40, 50)).astype("u1"), rng.integers(0, 60000, (3, 7, 9)).astype("u2"), rng.random((4, 5)).astype("f4")):
        for compressed in (False, True):
            assert np.array_equal(tiff.decode(tiff.encode(a, 0.3, compressed)), a) and abs(tiff.resolution(tiff.encode(a, 0.3)) - 0.3) < 1e-6
    assert tiff._unpacked_bits(bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 1])

    def packed(data):  # LZW by the book, codes as TIFF writes them
        table, word, bits = {bytes([b]): b for b in range(256)}, b"", f"{256:09b}"
        size = 258
        width = 9
        for b in data:
            if word + bytes([b]) in table:
                word += bytes([b])
                continue
            bits += f"{table[word]:0{width}b}"
            table[word + bytes([b])] = size
            size += 1
            width = size.bit_length() if size + 1 < 4096 else 12
            word = bytes([b])
            if size >= 4094:
                bits += f"{table[word]:0{width}b}{256:0{width}b}"
                table, word, size, width = {bytes([b]): b for b in range(256)}, b"", 258, 9
        bits += (f"{table[word]:0{width}b}" if word else "") + f"{257:0{width}b}"
        return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))

    for n in (0, 1, 300, 3000):
        data = rng.integers(0, 6, n).astype("u1").tobytes()
        assert tiff._unpacked_lzw(packed(data)) == data


def test_session(spark):
    e = spark.createDataFrame([("i", 1, "add"), ("i", 2, "undo"), ("i", 3, "undo"), ("i", 4, "add"), ("i", 5, "add"), ("i", 6, "undo"), ("k", 1, "add")], "image string, seq int, op string")
    assert {(r.image, r.seq) for r in session.after_undo(e, ["image"]).collect()} == {("i", 4), ("k", 1)}
    images = spark.createDataFrame([("a",), ("b",)], "image_name string")
    edits = spark.createDataFrame([(1, "clear", None), (2, "check", "a")], "seq int, op string, image_name string")
    assert {r.image_name: r.selected for r in session.selection(images, edits).collect()} == {"a": True, "b": False}
    assert all(r.selected for r in session.selection(images, edits.where("false")).collect())


def test_clean_names(spark):
    d = spark.createDataFrame([("a_area300_mask.tif",), ("a_area300_mask.tiff",), ("a_mask.tif",), ("a_mask.tif.bak",)], "n string")
    assert [r[0] for r in d.select(names.clean_cell_name(F.col("n"))).collect()] == ["a", "a_area300_mask.tiff", "a", "a_mask.tif.bak"]


def test_result_sheets(spark):
    """A sheet that lacks a column is refused; the operators fill both sheets."""
    assert len(tables.FRACTAL_COLUMNS) == 22 and len(tables.SKELETON_COLUMNS) == 24
    with pytest.raises(ValueError, match="image_name"):
        tables.result_sheet(spark.createDataFrame([("c", 1.0, 2)], "cell_name string, hull_density double, other int"), tables.FRACTAL_COLUMNS)
    rows = [("img1_soma_5_6_area400_mask.tif", y, x) for y in range(2, 30) for x in range(4, 28)] + [("odd.tif", 3, x) for x in range(20)]
    mask = spark.createDataFrame(rows, "image string, y int, x int")
    f = {r.mask_file: r for r in sheets.fractal_sheet(mask, 32, 32, 0.5).collect()}
    one = f["img1_soma_5_6_area400_mask.tif"]
    assert sheets.fractal_sheet(mask, 32, 32, 0.5).columns == list(tables.FRACTAL_COLUMNS)
    assert (one.cell_name, one.image_name, one.soma_id, one.mask_area_um2) == ("img1_soma_5_6", "img1", "soma_5_6", 400)
    assert (one.fractal_foreground_pixels, one.fractal_foreground_area_um2, one.hull_area_px, one.hull_area_um2) == (28 * 24, 28 * 24 / 4, 27 * 23.0, 27 * 23 / 4)
    assert f["odd.tif"].soma_id == "unknown" and f["odd.tif"].hull_area_px is None and f["odd.tif"].fractal_dimension == pytest.approx(0.95, abs=0.15)
    for upscale in (1, 2):
        s = {r.mask_file: r for r in sheets.skeleton_sheet(mask, 0.5, upscale).collect()}
        line = s["odd.tif"]
        assert list(line.asDict()) == list(tables.SKELETON_COLUMNS) and line.skeleton_file == "odd.tif_skeleton.tif" and line.upscale_factor == upscale
        assert (line.num_branches, line.num_junctions, line.num_end_points) == (1, 0, 2) and line.longest_shortest_path_um == pytest.approx(9.5, abs=0.6)
        assert line.total_skeleton_length_um == pytest.approx(line.longest_shortest_path_um) and line.branching_density == pytest.approx(line.skeleton_area_um2 / line.mask_area_um2)


def test_pictures(spark, tmp_path):
    import struct
    import zlib

    def png(rows, kind):
        part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        width = len(rows[0]) // (3 if kind == 2 else 1)
        head = struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + part(b"IEND", b"")

    (tmp_path / "colour a.png").write_bytes(png([[255, 10, 20, 1, 2, 3], [4, 5, 6, 7, 8, 9]], 2))
    (tmp_path / "grey.png").write_bytes(png([[1, 2, 3]], 0))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    found = {r["filename"]: r for r in images.pictures(spark, str(tmp_path)).collect()}
    assert found["colour a.png"]["data"] == [255, 10, 20, 1, 2, 3, 4, 5, 6, 7, 8, 9] and found["colour a.png"]["channels"] == 3
    assert (found["grey.png"]["height"], found["grey.png"]["width"], found["grey.png"]["data"]) == (1, 3, [1, 2, 3])
    assert found["broken.png"]["data"] is None and found["broken.png"]["error"]
    px = images.pixels(images.pictures(spark, str(tmp_path)))
    assert {tuple(r)[1:] for r in px.where("image = 'grey.png'").collect()} == {(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 0, 2, 3.0)}
