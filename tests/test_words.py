"""Morphology on words of bits against sets of pixels, and how often pixels move."""

import random

import pytest
from pyspark.sql import functions as F

from somatica.operators import morphology as m
from somatica.plans import registry


@pytest.mark.parametrize("name", ["mask_close", "mask_open", "box_counts", "box_dimension"])
def test_pixels_move_once(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("offsets", [m.disk(2), m.disk(8), m.EIGHT, [(0, 3), (1, -2)], [(0, 17), (0, -18)], [(0, 10), (2, -12), (0, 0)]])
def test_words(spark, offsets):
    rng = random.Random(1)
    rows = [(f"i{i}", rng.randint(-3, 20) if i else rng.randint(0, 20), rng.randint(-40, 100) if i else rng.randint(0, 69)) for i in range(2) for _ in range(1300)]
    mask, pixels = spark.createDataFrame(rows, "image string, y int, x int").repartition(3), set(rows)

    def dilated(s, framed=False):
        return {(i, y + a, x + b) for i, y, x in s for a, b in offsets if not framed or (0 <= y + a < 21 and 0 <= x + b < (40 if i == "i0" else 64))}

    def eroded(s):
        a, b = offsets[0]
        return {(i, y - a, x - b) for i, y, x in s if all((i, y - a + c, x - b + d) in s for c, d in offsets)}

    def got(df):
        found = [tuple(r) for r in df.collect()]
        assert len(found) == len(set(found)) and df.columns == ["image", "y", "x"]
        return set(found)

    width = F.when(F.col("image") == "i0", 40).otherwise(64)
    assert got(m.dilate(mask, offsets)) == dilated(pixels) and got(m.dilate(mask, offsets, 21, width)) == dilated(pixels, True)
    assert got(m.erode(mask, offsets)) == eroded(pixels) and got(m.open_(mask, offsets)) == dilated(eroded(pixels))
    assert got(m.close(mask, offsets, 21, width)) == eroded(dilated(pixels, True))
