"""Tiles: filters with halos, windows, components across borders, masks of many cells; the TIFF data source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatica.operators import background, masks, morphology, pixels, thresholds, tiles
from somatica.sources import tables, tiff, tiff_source


def frame(spark, arrays):
    rows = [(name, int(y), int(x), float(a[y, x])) for name, a in arrays.items() for y, x in np.ndindex(a.shape)]
    sizes = spark.createDataFrame([(name, *a.shape) for name, a in arrays.items()], "image string, hh int, ww int")
    return spark.createDataFrame(rows, "image string, y int, x int, v double").join(sizes, "image")


def arrays_of(px, like):
    out = {name: np.full(a.shape, np.nan) for name, a in like.items()}
    for r in px.collect():
        out[r.image][r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(7)
    return {"a": rng.integers(0, 255, (23, 31)).astype(float), "b": rng.integers(0, 255, (9, 40)).astype(float), "c": rng.integers(0, 9, (5, 5)).astype(float)}


def mirrored(a, r):
    return np.pad(a, r, mode="symmetric")


def plain_gaussian(a, sigma, reach=4.0):
    r = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    p = mirrored(a, r)
    p = np.stack([sum(w[k] * p[k + i] for k in range(2 * r + 1)) for i in range(a.shape[0])])
    return np.stack([sum(w[k] * p[:, k + j] for k in range(2 * r + 1)) for j in range(a.shape[1])], 1)


def extreme(a, offsets, lift, least):
    out = np.empty(a.shape)
    for y, x in np.ndindex(a.shape):
        near = [a[y + dy, x + dx] + up for (dy, dx), up in zip(offsets, lift, strict=True) if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
        out[y, x] = min(near) if least else max(near)
    return out


@pytest.mark.parametrize("tile", [7, 16, 512])
def test_filters(spark, images, tile):
    """Tiled and whole images alike, images of different sizes in one table."""
    px = frame(spark, images)
    h, w = F.col("hh"), F.col("ww")
    disk = morphology.disk(3)
    lift = [3 - (9 - a * a - b * b) ** 0.5 for a, b in disk]
    flat = [0.0] * len(disk)
    want = {
        "median": (pixels.median_filter(px, 5, h, w, tile), lambda a: np.array([[np.median(mirrored(a, 2)[y : y + 5, x : x + 5]) for x in range(a.shape[1])] for y in range(a.shape[0])])),
        "gaussian": (pixels.gaussian(px, 1.5, h, w, tile=tile), lambda a: plain_gaussian(a, 1.5)),
        "unsharp": (pixels.unsharp(px, 1.3, h, w, tile=tile), lambda a: np.clip(a + 1.3 * (a - plain_gaussian(a, 2.0)), 0, 255)),
        "ball": (background.rolling_ball(px, 3, h, w, tile=tile), lambda a: np.clip(a - extreme(a, disk, lift, True), 0, 255)),
        "hat": (background.white_top_hat(px, 3, h, w, tile=tile), lambda a: a - extreme(extreme(a, disk, flat, True), disk, flat, False)),
    }
    for name, (got, plain) in want.items():
        for image, a in arrays_of(got, images).items():
            assert np.allclose(a, plain(images[image])), (name, image)


def test_tubeness(spark, images):
    """All scales, whatever the tiles; a bright line stands out from its surroundings."""
    line = np.zeros((40, 40))
    line[20, 5:35] = 100
    px = frame(spark, images | {"line": line})
    whole = arrays_of(background.tubeness(px, F.col("hh"), F.col("ww")), images | {"line": line})
    parts = arrays_of(background.tubeness(px, F.col("hh"), F.col("ww"), tile=11), images | {"line": line})
    assert all(np.allclose(whole[k], parts[k]) for k in whole)
    assert whole["line"][20, 20] > 10 and whole["line"][5, 20] < 0.1


def test_missing_pixels(spark):
    px = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 9, 9, 7.0)], "image string, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in background.rolling_ball(px, 1, 10, 10, tile=4).collect()}
    assert got == {(0, 0): 4.0, (9, 9): 6.0}
    assert pixels.gaussian(px.where("false"), 1.0, 10, 10).count() == 0


def test_windows(spark, images):
    px = frame(spark, images)
    raster = tiles.from_pixels(px, F.col("hh"), F.col("ww"), 8)
    centres = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 11, 12), ("a", 3, 22, 30), ("b", 1, 4, 39), ("z", 1, 0, 0)], "image string, cell long, cy int, cx int")
    got = sorted(tuple(r) for r in tiles.crop(raster, centres, 6, 8).collect())
    inside = (F.col("y") >= F.col("cy") - 6) & (F.col("y") < F.col("cy") + 6) & (F.col("x") >= F.col("cx") - 6) & (F.col("x") < F.col("cx") + 6)
    assert got == sorted(tuple(r) for r in px.join(centres, "image").where(inside).select("image", "cell", "y", "x", "v").collect())


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("size", [1, 4, 64])
def test_components_across_tiles(spark, diagonal, size):
    rng = np.random.default_rng(size)
    rows = [(image, int(y), int(x)) for image in ("a", "b") for y, x in np.argwhere(rng.random((25, 30)) < 0.45)]
    rows += [("wide", 0, 65_535), ("wide", 0, 65_536), ("wide", 1, 0), ("wide", 3, 70_000), ("wide", 4, 69_999)]
    mask = spark.createDataFrame(rows, "image string, y int, x int")
    show = lambda df: sorted(tuple(r) for r in df.collect())
    whole = show(morphology.components(mask, diagonal))
    assert len(whole) == len(rows) and show(tiles.components(mask, diagonal, size)) == whole
    assert len({r[3] for r in whole if r[0] == "wide"}) == (3 if diagonal else 4)


def blobs(spark):
    """Two images with three bright cells each on a noisy ground."""
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:90, :120]
    out, centres = {}, []
    for name in ("a", "b"):
        a = rng.normal(20, 4, yy.shape)
        for cell in (1, 2, 3):
            cy, cx = rng.integers(15, 75), 20 + 36 * cell - 20
            centres.append((name, cell, int(cy), int(cx)))
            a = a + 200 * np.exp(-((yy - cy) ** 2 + (xx - cx) ** 2) / rng.integers(60, 150))
        out[name] = np.clip(np.floor(a), 0, 255)
    return out, spark.createDataFrame(centres, "image string, cell long, cy int, cx int"), centres


def test_masks_of_many_cells(spark):
    images, centres, listed = blobs(spark)
    raster = tiles.from_pixels(frame(spark, images), 90, 120, 32)
    targets = (60, 120, 240)
    got = {}
    for r in masks.cell_masks(raster, centres, 1.0, targets, tolerance=6.0, half=25, size=32).collect():
        got.setdefault((r.image, r.cell, r.area), set()).add((r.y, r.x))
    assert set(got) == {(i, c, t) for i, c, _, _ in listed for t in targets}
    for image, cell, cy, cx in listed:
        a = images[image]
        y0, x0 = max(0, cy - 25), max(0, cx - 25)
        search = thresholds.Window2D(a[y0 : cy + 25, x0 : cx + 25], cy - y0, cx - x0)
        held = set()
        for t in targets:
            y, x = search.mask(search.otsu(), float(t), 0.3 * search.values[-1] * masks.least_share(t), 30, 6.0)
            held |= set(zip((y + y0).tolist(), (x + x0).tolist(), strict=True))
            assert got[image, cell, t] == held  # each holds the smaller ones
            assert (cy, cx) in held and abs(len(y) - t) <= 0.5 * t
    # the windows of neighbours overlap; contested pixels go to the nearer cell, and none is lost
    wide = masks.cell_masks(raster, centres, 1.0, (900,), floor_percent=None, tolerance=6.0, half=40, size=32)
    one = masks.contested(wide, centres)
    assert wide.count() > one.count() == one.select("image", "y", "x").distinct().count() == wide.select("image", "y", "x").distinct().count()
    older = masks.cell_masks(raster, centres, 1.0, targets[1:], tolerance=6.0, half=25, size=32, nested=False)
    assert {r.area for r in older.select("area").distinct().collect()} == {120, 240}
    soma = spark.createDataFrame([("a", 1, 0, 0)], "image string, cell long, y int, x int")
    assert masks.cell_masks(raster, centres, 1.0, targets, half=25, size=32, soma=soma).where("image = 'a' and cell = 1 and y = 0 and x = 0").count() == 3


def test_levels_of_a_window():
    """Areas above every level, by labelling as a whole."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 5, rng.integers(1, 12, 2)).astype(float)
        cy, cx = (int(rng.integers(0, n)) for n in a.shape)
        search = thresholds.Window2D(a, cy, cx)
        for level in (-1.0, 0.0, 1.5, 3.0, 4.0):
            on = {(int(y), int(x)) for y, x in np.argwhere(a > level)}
            seed = min(on, key=lambda p: ((p[0] - cy) ** 2 + (p[1] - cx) ** 2, p), default=None)
            seen, todo = set(), [seed] if seed else []
            while todo:
                y, x = todo.pop()
                if (y, x) not in seen:
                    seen.add((y, x))
                    todo += [q for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in on]
            starts, ends = search.component(level)
            assert int((ends - starts).sum()) == len(seen)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("tile", [None, 16, 48])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_layouts(compressed, tile, big):
    rng = np.random.default_rng(1)
    for kind, form in (("u1", (2, 37, 50)), ("u2", (16, 16)), ("f4", (70, 33)), ("f8", (3, 5, 90))):
        a = (rng.random(form) * 200).astype(kind)
        data = tiff.encode(a, 0.25, compressed, tile, big)
        assert np.array_equal(tiff.decode(data), a) and tiff.resolution(data) == 0.25 and len(tiff.pages(data)) == (form[0] if len(form) == 3 else 1)


def test_data_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    stack = {"one.tif": rng.integers(0, 60_000, (100, 130)).astype("u2"), "two.tif": rng.integers(0, 200, (3, 40, 33)).astype("u1")}
    files = spark.createDataFrame([(n, tiff.encode(a, 0.5, True, 16 if n == "one.tif" else None, n == "one.tif")) for n, a in stack.items()], "filename string, content binary")
    folder = f"{tmp_path}/slides"
    tiff_source.write_files(files, folder)
    assert sorted(os.listdir(folder)) == ["one.tif", "two.tif"]
    rows = tiff_source.read_segments(spark, folder, splitBytes="4000")
    assert rows.rdd.getNumPartitions() > 5 and rows.where("filename = 'one.tif'").count() == 7 * 9 and {r.page for r in rows.where("filename = 'two.tif'").collect()} == {0, 1, 2}
    raster = tiff_source.read_tiles(spark, folder, size=24)
    got = arrays_of(tiles.to_pixels(raster, 24), {"one.tif": stack["one.tif"], "two.tif": stack["two.tif"][0]})
    assert np.array_equal(got["one.tif"], stack["one.tif"]) and np.array_equal(got["two.tif"], stack["two.tif"].max(axis=0))
    first = tiles.to_pixels(tiff_source.read_tiles(spark, f"{folder}/two.tif", page=1, size=24), 24)
    assert np.array_equal(arrays_of(first, {"two.tif": stack["two.tif"][0]})["two.tif"], stack["two.tif"][1])


def test_names_are_pushed_down(spark, tmp_path):
    folder = f"{tmp_path}/some"
    tiff_source.write_files(spark.createDataFrame([(f"{n}.tif", tiff.encode(np.full((4, 4), k, "u1"))) for k, n in enumerate("abc")], "filename string, content binary"), folder)
    with open(f"{folder}/broken.tif", "wb") as out:
        out.write(b"no picture")
    reader = tiff_source.NamedTiffReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("filename",), "b.tif"), GreaterThan(("y",), 0)]))
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["b.tif"] and len(left) == 1
    assert tiff_source.read_segments(spark, folder, pathGlobFilter="[ab].tif").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert tiff_source.read_segments(spark, folder).where("filename = 'c.tif'").count() == 1  # the broken file is not opened
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_raster_files_keep_their_frame(spark):
    px = spark.createDataFrame([("a", 2, 3, 9.0)], "image string, y int, x int, v double")
    row = tables.raster_files(px, "_soma.tif", "u1", height=7, width=5).first()
    a = tiff.decode(row.content)
    assert row.filename == "a_soma.tif" and a.shape == (7, 5) and a[2, 3] == 9 and a.sum() == 9
