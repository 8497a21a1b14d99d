"""Names of images, cells and mask files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three dialects of mask file names. Lazy and greedy differ where an image name itself contains a soma id.
MASK_NAME = {
    "lazy_tif": r"^(.+?)_(soma_\d+_\d+)_area(\d+)_mask\.tif$",
    "lazy_any": r"(?i)^(.+?)_(soma_\d+_\d+)_area(\d+)_mask\.tiff?$",
    "greedy_any": r"(?i)^(.+)_(soma_\d+_\d+)_area(\d+)_mask\.tiff?$",
}


def mask_parts(name: Column, dialect: str = "lazy_any") -> dict[str, Column]:
    """image_name, soma_id, row, col and area of a mask file name; all null where it does not match."""
    pattern = MASK_NAME[dialect]
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    place = lambda k: F.regexp_extract(part(2), r"^soma_(\d+)_(\d+)$", k).try_cast("int")
    return {"image_name": part(1), "soma_id": part(2), "row": place(1), "col": place(2), "area": part(3).try_cast("int")}


def unknown_parts(name: Column) -> dict[str, Column]:
    """Like ``mask_parts`` of the strict dialect, but a name that does not match is an image of its own with an unknown cell."""
    p = mask_parts(name, "lazy_tif")
    return {"image_name": F.coalesce(p["image_name"], name), "soma_id": F.coalesce(p["soma_id"], F.lit("unknown")), "area": F.coalesce(p["area"], F.lit(0))}


def mask_file(image: Column, soma: Column, area: Column) -> Column:
    return F.concat(image, F.lit("_"), soma, F.lit("_area"), area.cast("string"), F.lit("_mask.tif"))


def soma_id(row: Column, col: Column) -> Column:
    return F.concat_ws("_", F.lit("soma"), row.cast("string"), col.cast("string"))


def stem(name: Column) -> Column:
    """Name without what stands from its last point on; a leading point is part of the name."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def image_key(name: Column) -> Column:
    """Key under which image names are merged: trimmed, without a .tif or .tiff at the end."""
    return F.regexp_replace(F.trim(name), r"(?i)\.tiff?$", "")


def clean_cell_name(name: Column) -> Column:
    """Mask file name without the area and mask ending that it may end in."""
    return F.regexp_replace(name, r"(?:_area\d+)?_mask\.tif$", "")


def area_key(value: Column) -> Column:
    """Rounded whole area of a text, null where it is no number."""
    number = F.trim(value).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(F.bround(number)).cast("int")


def safe_series(name: Column) -> Column:
    """Series name with every character but letters, digits, point, underscore and hyphen replaced."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
