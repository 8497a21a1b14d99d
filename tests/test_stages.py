"""Stages with parameters: defaults, chaining, saving."""

import math

import pytest
from pyspark.ml import PipelineModel

from somatica.plans import stages


@pytest.fixture(scope="module")
def masks(spark):
    rows = []
    for area, size in ((200, 5), (400, 9)):
        rows += [(f"img_soma_20_20_area{area}_mask.tif", y, x, 40, 40) for y in range(20 - size, 21 + size) for x in range(20 - size, 21 + size) if abs(y - 20) <= 1 or abs(x - 20) <= 1]
    rows += [("other.tif", 3, x, 40, 40) for x in range(12)]
    return spark.createDataFrame(rows, "image string, y int, x int, height int, width int")


def test_defaults():
    s, f, p = stages.SkeletonSheet(), stages.FractalSheet(), stages.ShollSheet()
    assert (s.getOrDefault("pixelSize"), s.getOrDefault("upscaleFactor"), f.getOrDefault("pixelSize")) == (0.316, 2, 0.316)
    assert (p.getOrDefault("pixelSize"), p.getOrDefault("stepSize"), p.getOrDefault("startRadius")) == (0.3, 0.0, 5.0)
    assert stages.Combined().getOrDefault("analyses") == ["skeleton", "sholl", "fractal"]


def test_saved_and_loaded(spark, masks, tmp_path):
    chain = PipelineModel([stages.LargestMasks(), stages.Combined(analyses=["fractal", "skeleton"], pixelSize=0.5)])
    chain.write().save(f"{tmp_path}/chain")
    again = PipelineModel.load(f"{tmp_path}/chain")
    assert again.stages[1].getOrDefault("pixelSize") == 0.5 and again.stages[1].getOrDefault("analyses") == ["fractal", "skeleton"]
    rows = sorted(tuple(r) for r in chain.transform(masks).collect())
    assert rows == sorted(tuple(r) for r in again.transform(masks).collect()) and [r[0] for r in rows] == ["img_soma_20_20_area400_mask.tif", "other.tif"]


def test_sheets(masks):
    sholl = {r.mask_file: r for r in stages.ShollSheet(pixelSize=1.0, startRadius=3.0).transform(masks).collect()}
    assert set(sholl) == {"img_soma_20_20_area200_mask.tif", "img_soma_20_20_area400_mask.tif"} and {r.primary_branches for r in sholl.values()} == {4}
    assert sholl["img_soma_20_20_area400_mask.tif"].enclosing_radius == pytest.approx(9.5, abs=0.5)
    step = {r.mask_file: r for r in stages.ShollSheet(pixelSize=1.0, startRadius=3.0, stepSize=1.0).transform(masks).collect()}
    assert step["img_soma_20_20_area400_mask.tif"].primary_branches == 4
    wide = {r.mask_file: r for r in stages.Combined().transform(masks).collect()}
    line = wide["other.tif"]
    assert len(wide) == 3 and line.sholl_max_intersections is None and line.fractal_foreground_pixels == 12 and line.skeleton_pixel_size_um == 0.316
    assert math.isclose(line.skeleton_mask_area_um2, 12 * 0.316**2)
    with pytest.raises(ValueError):
        stages.Combined(analyses=["colour"]).transform(masks)
