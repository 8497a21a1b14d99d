"""Cell metrics as column expressions: derived ratios, the phenotype ladder, scales and marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phenotypes in report order.
PHENOTYPES = ("Ramified", "Hypertrophic", "Bushy", "Amoeboid", "Rod")


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the phenotype rules."""

    amoeboid_soma_ratio: float = 0.55
    bushy_soma_ratio: float = 0.30
    bushy_roundness: float = 0.35
    rod_roundness: float = 0.15
    rod_eccentricity: float = 0.85
    hypertrophic_soma_ratio: float = 0.20
    hypertrophic_ti_max: float = 5.0


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; 0 where the bottom is not positive, null where it is null."""
    return F.when(bottom.isNull(), None).when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def soma_cell_ratio() -> Column:
    return guarded_ratio(F.col("soma_area"), F.col("mask_area"))


def transformation_index() -> Column:
    """Squared perimeter over 4 pi area: 1 for a disk, larger for branched outlines."""
    return guarded_ratio(F.col("perimeter") * F.col("perimeter"), 4 * F.pi() * F.col("mask_area"))


def circularity() -> Column:
    return guarded_ratio(4 * F.pi() * F.col("mask_area"), F.col("perimeter") * F.col("perimeter"))


def phenotype(t: Thresholds = Thresholds()) -> Column:
    """First rule that holds; a null makes its rule fail; else Ramified."""
    ratio, index = F.col("soma_cell_ratio"), F.col("transformation_index")
    rod = (F.col("roundness") < t.rod_roundness) & (F.col("eccentricity") > t.rod_eccentricity)
    return (
        F.when(ratio > t.amoeboid_soma_ratio, "Amoeboid")
        .when((ratio > t.bushy_soma_ratio) & (F.col("roundness") > t.bushy_roundness), "Bushy")
        .when(rod, "Rod")
        .when((ratio > t.hypertrophic_soma_ratio) & (index < t.hypertrophic_ti_max), "Hypertrophic")
        .otherwise("Ramified")
    )


def phenotype_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PHENOTYPES]), name)


def significance(p: Column) -> Column:
    """Stars of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def floor_scale(area_um2: Column) -> Column:
    """Share of the intensity floor that a target area keeps: 1 up to 300, down to 0.3 from 800 on."""
    return F.when(area_um2 <= 300, 1.0).when(area_um2 >= 800, 0.3).otherwise(1.0 - 0.7 * (area_um2 - 300) / 500)


def area_um2(pixels: Column, pixel_size: float) -> Column:
    return pixels * F.lit(pixel_size * pixel_size)


def equivalent_radius(area: Column) -> Column:
    return F.sqrt(area / F.pi())


def calibrated_pixel_size(known_um: Column, dy: Column, dx: Column) -> Column:
    """Micrometres per pixel from a line of known length; null for lines under one pixel."""
    d = F.hypot(dy, dx)
    return F.when(d >= 1, known_um / d)


def cosine(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Cosine of two plane vectors, kept finite for zero vectors."""
    return (ay * by + ax * bx) / (F.hypot(ay, ax) * (F.hypot(by, bx) + 1e-9) + 1e-9)
