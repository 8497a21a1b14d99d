"""Analytic shapes: what is known about squares, disks, lines and rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatica.operators import background, boxes, bulbs, distance, hull, masks, morphology, pixels, regions, sholl, skeleton, thresholds, vessels


def mask(spark, shapes):
    rows = [(k, int(y), int(x)) for k, s in shapes.items() for y, x in zip(*np.nonzero(s), strict=True)]
    return spark.createDataFrame(rows, "image string, y int, x int")


def disk(n, r, cy=None, cx=None):
    y, x = np.mgrid[:n, :n]
    return (y - (cy if cy is not None else n // 2)) ** 2 + (x - (cx if cx is not None else n // 2)) ** 2 <= r * r


def canvas(n=32):
    return np.zeros((n, n), bool)


@pytest.fixture(scope="module")
def shapes():
    square, line, dot, diagonal, plus = canvas(), canvas(), canvas(), canvas(), canvas()
    square[5:15, 8:18] = True
    line[10, 3:13] = True
    dot[4, 7] = True
    diagonal[2, 2] = diagonal[3, 3] = True
    plus[16, 6:27] = plus[6:27, 16] = True
    return {"square": square, "line": line, "dot": dot, "diagonal": diagonal, "plus": plus, "disk": disk(32, 10), "ring": disk(32, 10) & ~disk(32, 6)}


def by_image(df):
    return {r["image"]: r for r in df.collect()}


def test_moments(spark, shapes):
    m = by_image(regions.descriptors(mask(spark, shapes), 0.5))
    assert m["square"]["n_px"] == 100 and m["square"]["area_um2"] == 25 and (m["square"]["cy"], m["square"]["cx"]) == (9.5, 12.5)
    assert m["line"]["roundness"] == 0 and m["line"]["eccentricity"] == 1
    assert m["dot"]["roundness"] == 0 and m["dot"]["eccentricity"] == 0 and m["dot"]["perimeter"] == 0
    assert m["disk"]["roundness"] == pytest.approx(1, abs=1e-9)
    assert m["square"]["perimeter"] == pytest.approx(36 * 0.5)


def test_translation(spark, shapes):
    moved = {k: np.roll(s, (3, 2), (0, 1)) for k, s in shapes.items() if k in ("square", "line", "diagonal")}
    a, b = by_image(regions.descriptors(mask(spark, {k: shapes[k] for k in moved}))), by_image(regions.descriptors(mask(spark, moved)))
    for k in moved:
        for c in ("area_um2", "perimeter", "roundness", "average_centroid_distance"):
            assert a[k][c] == pytest.approx(b[k][c])


def test_components(spark, shapes):
    sizes = lambda d: {r["image"]: r["c"] for r in morphology.component_sizes(morphology.components(mask(spark, shapes), d)).groupBy("image").count().withColumnRenamed("count", "c").collect()}
    assert sizes(True)["diagonal"] == 1 and sizes(False)["diagonal"] == 2 and sizes(True)["ring"] == 1


def test_set_morphology(spark, shapes):
    m = mask(spark, shapes)
    as_set = lambda d: {tuple(r) for r in d.select("image", "y", "x").collect()}
    whole, b = as_set(m), morphology.disk(2)
    assert as_set(morphology.erode(m, b)) <= whole <= as_set(morphology.dilate(m, b))
    closed, opened = morphology.close(m, b), morphology.open_(m, b)
    assert as_set(morphology.close(closed, b)) == as_set(closed) and as_set(morphology.open_(opened, b)) == as_set(opened)
    assert as_set(morphology.subtract(m, m)) == set() and as_set(morphology.union(m, m)) == whole == as_set(morphology.intersect(m, m))
    assert not [r for r in as_set(morphology.despeckle(m, 3)) if r[0] in ("dot", "diagonal")]


def test_distance_forms_agree(spark, shapes):
    m = mask(spark, {"disk": shapes["disk"]})
    other = mask(spark, {"disk": ~shapes["disk"]})
    a = {(r["y"], r["x"]): r["d"] for r in distance.to_background(m, 32, 32).collect()}
    b = {(r["y"], r["x"]): r["d"] for r in distance.nearest(m, other).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a) and 10 <= max(a.values()) <= 11
    assert distance.to_background(mask(spark, {"full": np.ones((4, 4), bool)}), 4, 4).where("d is not null").count() == 0


def test_boxes(spark):
    full = mask(spark, {"full": np.ones((32, 32), bool)})
    powers = boxes.box_counts(full, 32, 32).where("s in (2, 4, 8, 16)")
    d = boxes.dimension(powers).first()
    assert d["fractal_dimension"] == pytest.approx(2) and d["mean_lacunarity"] == pytest.approx(1)
    assert boxes.box_sizes(32, 32) == [2, 3, 4, 6, 8, 12, 16] and boxes.box_sizes(4, 4) == []


def test_hull(spark, shapes):
    m = mask(spark, shapes)
    h = by_image(hull.measure(hull.vertices(m), m))
    assert h["square"]["hull_area"] == 81 and h["square"]["hull_perimeter"] == 36 and h["square"]["span"] == pytest.approx(9 * math.sqrt(2))
    assert "line" not in h and "dot" not in h
    assert h["ring"]["hull_area"] == h["disk"]["hull_area"]


def test_skeleton(spark, shapes):
    s = skeleton.thin(mask(spark, shapes))
    m = by_image(skeleton.graph_metrics(s))
    assert m["line"]["end_points"] == 2 and m["line"]["junctions"] == 0 and m["line"]["total_length"] == 9
    assert m["plus"]["end_points"] == 4 and m["plus"]["junctions"] == 1 and m["plus"]["branches"] == 4
    assert s.where("image = 'dot'").count() == 1
    assert skeleton.thin(mask(spark, {"block": np.ones((2, 2), bool)})).count() <= 1  # thinning in sub-steps may use up a block of two by two


def test_sholl(spark, shapes):
    centre = spark.createDataFrame([("plus", 16, 16, 2.0), ("disk", 16, 16, 2.0)], "image string, cy int, cx int, r0 double")
    p = sholl.profile(mask(spark, shapes), centre)
    assert {r["n"] for r in p.where("image = 'plus' and radius between 4 and 9").collect()} == {4}
    m = by_image(sholl.sampled_metrics(p))
    assert m["plus"]["max_intersections"] == 4
    assert {r["n"] for r in p.where("image = 'disk' and radius between 3 and 8").collect()} == {1}
    assert sholl.best_polynomial(p).count() == 2


def test_otsu_and_targets(spark):
    rng = np.random.default_rng(3)
    img = np.where(disk(40, 8), 200.0, 20.0) + rng.integers(0, 5, (40, 40))
    px = spark.createDataFrame([("a", int(y), int(x), float(img[y, x])) for y in range(40) for x in range(40)] + [("flat", 0, 0, 7.0), ("flat", 0, 1, 7.0)], "image string, y int, x int, v double")
    t = by_image(thresholds.otsu(px))
    assert 23 < t["a"]["threshold"] < 200 and t["flat"]["threshold"] == 6
    roi = px.where("image = 'a'")
    centre = spark.createDataFrame([("a", 20, 20)], "image string, cy int, cx int")
    areas = (50, 100, 200, 400)
    grown = roi.withColumn("v", roi.v - ((roi.y - 20) * (roi.y - 20) + (roi.x - 20) * (roi.x - 20)) / 10.0)
    soma = mask(spark, {"a": disk(40, 2)})  # on a plateau the search may end at an empty mask; the soma is in every mask
    nested = masks.nested_masks(grown, centre, 1.0, areas, floor_percent=None, soma=soma, tolerance=20.0)
    n = {r["area"]: {(q["y"], q["x"]) for q in nested.where(f"area = {r['area']}").collect()} for r in nested.select("area").distinct().collect()}
    assert sorted(n) == list(areas) and all(n[a] <= n[b] for a, b in zip(areas, areas[1:], strict=False)) and abs(len(n[100]) - 100) < 60


def test_dumbbell_has_one_bulb(spark):
    cell = disk(64, 9, 20, 20) | disk(64, 5, 20, 52)
    cell[19:22, 20:52] = True
    found, counts = bulbs.detect(mask(spark, {"cell": cell}), 64, 64, 0.2)
    assert found.count() == 1 and abs(found.first()["cx"] - 52) < 2 and counts.first()["num_bulbous_endings"] == 1
    _, none = bulbs.detect(mask(spark, {"cell": disk(64, 9, 20, 20)}), 64, 64, 0.2)
    assert none.first()["num_bulbous_endings"] == 0


def test_bulbs_with_known_somas(spark):
    cell = disk(64, 9, 20, 20) | disk(64, 5, 20, 52)
    cell[19:22, 20:52] = True
    m = mask(spark, {"traced": cell, "area": cell, "wide": cell, "lobe": cell})
    outlines = mask(spark, {"traced": disk(64, 8, 20, 20), "lobe": disk(64, 5, 20, 52)})
    areas = spark.createDataFrame([("area", math.pi * (9 * 0.2) ** 2), ("wide", math.pi * (25 * 0.2) ** 2)], "image string, soma_area_um2 double")
    found, counts = bulbs.detect(m, 64, 64, 0.2, outlines=outlines, areas=areas)
    at = {r["image"]: round(r["cx"]) for r in found.collect()}
    assert abs(at["traced"] - 52) < 2 and abs(at["area"] - 52) < 2
    assert abs(at["lobe"] - 20) < 3  # the lobe is the soma: what is left is the other swelling
    assert "wide" not in at  # a soma so large that the swelling is within reach of it
    assert {r["image"]: r["num_bulbous_endings"] for r in counts.collect()} == {"traced": 1, "area": 1, "wide": 0, "lobe": 1}


def test_sizes_as_columns(spark):
    small, large = disk(16, 5), disk(48, 16)
    m = mask(spark, {"small": small, "large": large})
    m = m.withColumn("side", F.when(F.col("image") == "small", 16).otherwise(48))
    for name, shape in (("small", small), ("large", large)):
        one, n = mask(spark, {name: shape}), len(shape)
        side = F.col("side")
        rows = lambda df: sorted(map(tuple, df.where(F.col("image") == name).collect()))  # noqa: B023, E731
        assert rows(distance.to_background(m, side, side)) == rows(distance.to_background(one, n, n))
        assert rows(morphology.close(m, morphology.disk(3), side, side)) == rows(morphology.close(one, morphology.disk(3), n, n))
        assert rows(boxes.box_counts(m, side, side)) == rows(boxes.box_counts(one, n, n)) != []
        assert rows(skeleton.thin(m)) == rows(skeleton.thin(one))
        assert rows(vessels.network(m, skeleton.thin(m), side, side, 1.0)) == rows(vessels.network(one, skeleton.thin(one), n, n, 1.0))


def test_longest_path_and_loops(spark, shapes):
    loop = canvas()
    loop[4:14, 4] = loop[4:14, 20] = loop[4, 4:21] = loop[13, 4:21] = True  # a box with two tails
    loop[13, 20:30] = loop[4, 1:5] = True
    two = canvas()
    two[2, 2:8] = two[20, 2:30] = True
    s = mask(spark, {"plus": shapes["plus"], "line": shapes["line"], "loop": loop, "two": two, "dot": shapes["dot"]})
    d = {k: r["longest_shortest_path"] for k, r in by_image(skeleton.longest_path(s)).items()}
    assert d["plus"] == 20 and d["line"] == 9 and d["dot"] == 0 and d["two"] == 5  # the first skeleton alone counts
    opened = skeleton.without_loops(s)
    n = lambda df: {r["image"]: r["count"] for r in df.groupBy("image").count().collect()}
    before, after = n(s), n(opened)
    assert all(before[k] == after[k] for k in ("plus", "line", "two", "dot")) and before["loop"] - 24 <= after["loop"] < before["loop"]
    assert skeleton.longest_path(opened).where("image = 'loop'").first()[1] >= d["loop"]


def test_solidity(spark, shapes):
    m = by_image(hull.mask_shapes(mask(spark, shapes), 0.5))
    assert m["square"]["mask_solidity"] == 1 and m["line"]["mask_solidity"] == 1 and m["dot"]["mask_solidity"] == 1
    assert m["square"]["mask_area"] == 25 and m["ring"]["mask_solidity"] < 0.75 < 0.9 < m["disk"]["mask_solidity"] < 1
    h = by_image(hull.measure(hull.vertices(mask(spark, shapes), pixel_corners=True), mask(spark, shapes), 0.5))
    assert h["square"]["hull_area"] == 25 and h["square"]["density"] == 1 and h["square"]["hull_perimeter"] == 20


def test_background(spark):
    img = np.add.outer(np.arange(16.0), np.arange(16.0))
    img[8, 8] += 50
    px = spark.createDataFrame([("a", y, x, float(img[y, x])) for y in range(16) for x in range(16)], "image string, y int, x int, v double")
    flat = {(r["y"], r["x"]): r["v"] for r in background.rolling_ball(px, 4, 16, 16).collect()}
    assert flat[8, 8] > 45 and flat[3, 3] < 3
    hat = {(r["y"], r["x"]): r["v"] for r in background.white_top_hat(px, 1, 16, 16).collect()}
    assert hat[8, 8] > 45 and hat[4, 4] <= 2
    assert pixels.gaussian(px, 1.0, 16, 16).count() == 256
    soft = pixels.gaussian(px.withColumn("v", px.v * 0 + 3.0), 2.0, 16, 16)
    assert {round(r["v"], 9) for r in soft.collect()} == {3.0}


def test_vessels(spark):
    img = np.full((40, 40), 10.0)
    img[18:23, :] = 200.0
    px = spark.createDataFrame([("a", y, x, float(img[y, x])) for y in range(40) for x in range(40)], "image string, y int, x int, v double")
    v = vessels.vessel_mask(px, 40, 40, 1.0)
    n = vessels.network(v, skeleton.thin(v), 40, 40, 1.0).first()
    assert 0.08 < n["vessel_area_fraction"] < 0.13 and n["branchpoint_density"] == 0
    leak = vessels.leakage(px, v).first()
    assert leak["leakage_index"] < 0.2 and leak["extravascular_area_fraction"] == 0
    rings = vessels.ring_means(px, v).first()
    assert rings["perivasc_0_10um_mean"] < 60


def test_empty(spark):
    none = mask(spark, {})
    assert regions.moments(none, 1.0).count() == 0 and morphology.components(none).count() == 0 and hull.vertices(none).count() == 0 and morphology.degrees(none).count() == 0
