"""Many small groups in one call: no step of these queries starts Python for every group, and results stay those of single groups."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somatica.operators import batches, morphology, pixels, sholl, skeleton, tiles
from somatica.plans import registry
from somatica.sources import tables, tiff_source

DATA = "/root/testdata/sf0.001"


def steps(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["px_gaussian", "px_unsharp", "tubeness", "cell_windows", "components_tiled", "vessel_tubes"])
def test_no_call_for_each_group(spark, name):
    plan = steps(registry.QUERIES[name](spark, DATA))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan


def test_whole_groups():
    keys = [None, None, "a", "a", "a", "b", "c", "c"]
    table = pa.table({"k": pa.array(keys, pa.string()), "v": list(range(8))})
    for rows in (1, 2, 3, 8):
        got = list(batches.whole_groups(iter(table.to_batches(rows)), 1))
        assert sum(len(starts) for _, starts in got) == 4 and pa.concat_tables([t for t, _ in got]).equals(table)
        assert all(t.column("k").to_pylist()[s] not in t.column("k").to_pylist()[:s] for t, starts in got for s in starts)


def test_images_of_one_tile_and_of_many(spark):
    """Stacks of whole images give the same as tiles with neighbours; some pixels are missing, an image has no name."""
    rng = np.random.default_rng(4)
    rows = [(None if i == 3 else f"i{i}", y, x, float(rng.integers(0, 255))) for i in range(5) for y in range(9) for x in range(7) if (y, x) != (i, i)]
    px = spark.createDataFrame(rows, "image string, y int, x int, v double")
    plain = {(r.image, r.y, r.x): round(r.v, 9) for r in pixels.unsharp(px, 1.3, 9, 7).collect()}
    for tile in (4, 3):
        got = {(r.image, r.y, r.x): round(r.v, 9) for r in pixels.unsharp(px, 1.3, 9, 7, tile=tile).collect()}
        assert got == plain and len(got) == len(rows)
    sized = px.withColumns({"h": F.lit(9), "w": F.lit(7)})
    assert {(r.image, r.y, r.x): round(r.v, 9) for r in pixels.unsharp(sized, 1.3, F.col("h"), F.col("w")).collect()} == plain


def test_small_files_share_a_partition(spark, tmp_path):
    px = spark.createDataFrame([(f"i{i}", y, 2, float(i + 1)) for i in range(60) for y in range(3)], "image string, y int, x int, v double")
    folder = f"file://{tmp_path}/files"
    tiff_source.write_files(tables.raster_files(px, ".tif", "u2", height=4, width=4), folder)
    few = tiff_source.TiffReader({"path": folder}).partitions()
    assert len(few) == 1 and len(few[0].more) == 59
    assert len(tiff_source.TiffReader({"path": folder, "splitBytes": str(10 << 20)}).partitions()) == 7
    back = tiles.to_pixels(tiff_source.read_tiles(spark, folder, size=8), 8).where("v > 0")
    assert {(r.image, r.y, r.x, r.v) for r in back.collect()} == {(f"i{i}.tif", y, 2, i + 1.0) for i in range(60) for y in range(3)}


@pytest.mark.parametrize("name", ["skeleton_sheet", "terminal_bulbs", "vessel_network", "nested_masks", "cell_masks"])
def test_masks_of_many_images_a_call(spark, name):
    plan = steps(registry.QUERIES[name](spark, DATA))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_profiles_of_many_images_a_call(spark):
    """No expression works through a profile's polynomials; profiles of several sizes in one stack, too short ones and one without a name."""
    rng = np.random.default_rng(8)
    rows = [(None if k == 5 else f"i{k}", 1.0 + i, int(rng.integers(0, 4)) + (9 if i < n // 2 else 0)) for k, n in enumerate((2, 3, 20, 21, 60, 33)) for i in range(n)]
    d = spark.createDataFrame(rows, "image string, radius double, n long")
    found = sholl.best_polynomial(d)
    assert "MapInArrow" in steps(found) and "zip_with" not in steps(found) and "MapInArrow" in steps(sholl.fit_quality(d))
    got = {r.image: r for r in found.collect()}
    alone = {k: sholl.best_polynomial(d.where(F.col("image").eqNullSafe(k))).first() for k in ("i2", "i3", "i4", None)}
    assert len(got) == 6 and all(got[k] == r and r.degree is not None for k, r in alone.items()) and got["i0"].degree is None


@pytest.mark.parametrize("name", ["terminal_bulbs", "terminal_bulbs_traced"])
def test_bulbs_work_out_pixels_once(spark, name):
    """What is left to run reads written tables: no thinning, distance or opening, and no line items; contacts are the one step in Python."""
    plan = steps(registry.QUERIES[name](spark, DATA))
    assert plan.count("MapInArrow") == 1 and "lineitem" not in plan


def test_labels_beside_rows():
    """Labels of pixels in any order are those of ``components``; wide images keep their stride."""
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, (3, 12, 12), (200, 3)), axis=0)
    at[at[:, 0] == 2, 2] += 65_530
    at = rng.permutation(at)
    group, y, x = at.T
    label = morphology.labels_of(group, y, x)
    for g in range(3):
        stride = 1 << 32 if g == 2 else 1 << 16
        place = np.sort(y[group == g] * stride + x[group == g])
        root = place[morphology.component_roots(place, [1, stride - 1, stride, stride + 1])]
        assert dict(zip(place.tolist(), root.tolist())) == dict(zip((y[group == g] * stride + x[group == g]).tolist(), label[group == g].tolist()))


def test_longest_way_begins_from_few_nodes(monkeypatch):
    """A path with side arms: the bounds leave few beginnings, and the length is that of all of them."""
    import heapq

    n, begun = 400, []
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, n + i, 0.5) for i in range(0, n, 3)]
    used = {u for e in edges for u in e[:2]}
    number = {u: k for k, u in enumerate(sorted(used))}
    pop = heapq.heappop
    monkeypatch.setattr(heapq, "heappop", lambda h: begun.append(h[0][0] == 0.0) or pop(h))
    assert skeleton.longest_way(len(used), [(number[u], number[v], w) for u, v, w in edges]) == n - 1 + 0.5 + 0.5
    assert sum(begun) < 20
