"""Analyses as stages of a ``pyspark.ml`` pipeline, so that a run with its parameters can be chained, saved and loaded.

Stages take mask pixels: image (the mask's file name), y, x, height, width. ``Combined`` runs the chosen sheets over them and joins these
by file. The defaults are those of the separate scripts.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.functions import names
from somatica.operators import sheets, sholl

#: Parameters of the separate scripts.
SKELETON_PIXEL, FRACTAL_PIXEL, SHOLL_PIXEL, UPSCALE, STEP_UM, START_UM = 0.316, 0.316, 0.3, 2, 0.0, 5.0


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters are given by name; a sheet comes back with ``mask_file`` and columns of its own."""

    pixelSize = Param(Params._dummy(), "pixelSize", "micrometres per pixel", TypeConverters.toFloat)  # noqa: N815  named as parameters of that library are

    def _given(self, kwargs: dict) -> None:
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class LargestMasks(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Of each cell (image and soma in the file's name) the mask of the largest area; files with other names stay as they are."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = names.mask_parts(F.col("image"))
        files = dataset.select("image").distinct().select("image", parts["image_name"].alias("i"), parts["soma_id"].alias("s"), parts["area"].alias("a"))
        cell = Window.partitionBy(F.coalesce("i", "image"), "s").orderBy(F.col("a").desc(), "image")
        kept = files.withColumn("_rank", F.row_number().over(cell)).where((F.col("_rank") == 1) | F.col("s").isNull()).select("image")
        return dataset.join(kept, "image", "left_semi")


class SkeletonSheet(_Stage):
    upscaleFactor = Param(Params._dummy(), "upscaleFactor", "enlargement of the mask before thinning", TypeConverters.toInt)  # noqa: N815

    @keyword_only
    def __init__(self, *, pixelSize: float | None = None, upscaleFactor: int | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(pixelSize=SKELETON_PIXEL, upscaleFactor=UPSCALE)
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return sheets.skeleton_sheet(dataset.select("image", "y", "x"), self.getOrDefault(self.pixelSize), self.getOrDefault(self.upscaleFactor))


class FractalSheet(_Stage):
    @keyword_only
    def __init__(self, *, pixelSize: float | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(pixelSize=FRACTAL_PIXEL)
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return sheets.fractal_sheet(dataset, F.col("height"), F.col("width"), self.getOrDefault(self.pixelSize))


class ShollSheet(_Stage):
    """Sampled metrics and regressions of every mask's profile around the soma that its file name gives; a step of 0 takes every circle
    on which the profile changes."""

    stepSize = Param(Params._dummy(), "stepSize", "micrometres between circles, 0: continuous", TypeConverters.toFloat)  # noqa: N815
    startRadius = Param(Params._dummy(), "startRadius", "micrometres of the first circle", TypeConverters.toFloat)  # noqa: N815

    @keyword_only
    def __init__(self, *, pixelSize: float | None = None, stepSize: float | None = None, startRadius: float | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(pixelSize=SHOLL_PIXEL, stepSize=STEP_UM, startRadius=START_UM)
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        px, step, start = (self.getOrDefault(p) for p in (self.pixelSize, self.stepSize, self.startRadius))
        parts = names.mask_parts(F.col("image"))
        centres = dataset.select("image").distinct().select("image", parts["row"].alias("cy"), parts["col"].alias("cx"), F.lit(start / px).alias("r0")).where("cy is not null")
        mask = dataset.select("image", "y", "x")
        if step > 0:
            profile = sholl.profile(mask, centres, step / px).select("image", (F.col("radius") * px).alias("radius"), "n")
        else:
            profile = sholl.continuous(mask, centres).select("image", ((F.col("from_radius") + F.col("to_radius")) / 2 * px).alias("radius"), "n")
        return sholl.sampled_metrics(profile).join(sholl.regressions(profile), "image", "left").join(sholl.best_polynomial(profile), "image", "left").withColumnRenamed("image", "mask_file")


class Combined(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The chosen sheets of the same masks side by side, one row per file that any of them has. Columns of a sheet begin with its name."""

    analyses = Param(Params._dummy(), "analyses", "of skeleton, sholl and fractal", TypeConverters.toListString)
    pixelSize = Param(Params._dummy(), "pixelSize", "micrometres per pixel in all sheets; unset: the default of each", TypeConverters.toFloat)  # noqa: N815
    _KINDS = {"skeleton": SkeletonSheet, "sholl": ShollSheet, "fractal": FractalSheet}

    @keyword_only
    def __init__(self, *, analyses: list[str] | None = None, pixelSize: float | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(analyses=["skeleton", "sholl", "fractal"])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        chosen = self.getOrDefault(self.analyses)
        if not chosen or set(chosen) - set(self._KINDS):
            raise ValueError(f"analyses are some of {', '.join(self._KINDS)}")
        size = {"pixelSize": self.getOrDefault(self.pixelSize)} if self.isSet(self.pixelSize) else {}
        found = []
        for kind in chosen:
            sheet = self._KINDS[kind](**size).transform(dataset)
            found.append(sheet.select("mask_file", *[F.col(c).alias(f"{kind}_{c.removeprefix(f'{kind}_')}") for c in sheet.columns if c != "mask_file"]))
        return reduce(lambda a, b: a.join(b, "mask_file", "full"), found)
