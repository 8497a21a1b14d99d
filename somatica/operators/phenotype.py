"""Phenotype classification of cells and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.functions.cells import PHENOTYPES, Thresholds, phenotype, phenotype_order, soma_cell_ratio, transformation_index

REQUIRED = ("soma_area", "mask_area", "perimeter", "roundness", "eccentricity")


def require_columns(cells: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``cells``, or a ValueError that names the missing columns."""
    missing = sorted(set(columns) - set(cells.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return cells


def with_metrics(cells: DataFrame) -> DataFrame:
    return require_columns(cells).withColumns({"soma_cell_ratio": soma_cell_ratio(), "transformation_index": transformation_index()})


def classify(cells: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``cells`` with soma_cell_ratio, transformation_index and phenotype."""
    return with_metrics(cells).withColumn("phenotype", phenotype(thresholds))


def distribution(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells and percentage of each phenotype, over all cells or within each group of ``by``."""
    by = by or []
    n = classified.groupBy(*by, "phenotype").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return n.withColumn("pct", F.round(100 * F.col("n") / total, 1)).withColumn("ord", phenotype_order(F.col("phenotype")))


def wide_summary(classified: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: cells of every phenotype, total and percentages; phenotypes that never occur are 0."""
    wide = classified.groupBy(*by).pivot("phenotype", list(PHENOTYPES)).count().na.fill(0, list(PHENOTYPES))
    wide = wide.withColumn("total", sum(F.col(p) for p in PHENOTYPES))
    return wide.withColumns({f"pct_{p}": F.round(100 * F.col(p) / F.col("total"), 1) for p in PHENOTYPES})


def metric_means(classified: DataFrame, metrics: list[str]) -> DataFrame:
    """Cells and means of the metrics by phenotype; nulls do not count."""
    return classified.groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def metric_ranges(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and largest value of each metric, one row per metric."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def contingency(classified: DataFrame, row: str, column: str = "phenotype") -> DataFrame:
    """Counts of every level of ``row`` with every level of ``column``, zeros too; rows with a null do not count.

    Levels are those that occur. The grid is levels times levels, not rows times rows.
    """
    known = classified.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.agg(F.collect_set(column)).scalar()
    full = counts.select(row).distinct().select(row, F.explode(levels).alias(column))
    return full.join(counts, [row, column], "left").na.fill(0, ["n"])
