"""Result sheets of masks: one row per mask file, with the columns, units and rounding of the written tables.

Masks are (image, y, x), ``image`` being the mask's file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.functions import names
from somatica.operators import boxes, distance, hull, morphology, skeleton
from somatica.operators.pixels import AT
from somatica.sources.tables import FRACTAL_COLUMNS, SKELETON_COLUMNS, result_sheet


def fractal_sheet(mask: DataFrame, height: int | Column, width: int | Column, pixel_size: float) -> DataFrame:
    """Box dimension, lacunarity and hull of every mask that has three box sizes or more; hull columns are null where the hull has no
    area. Areas and lengths are rounded to 4 places, ratios to 6."""
    files = mask.select(F.col("image").alias("_f"), "y", "x", F.lit(height).alias("_h"), F.lit(width).alias("_w")).withColumnRenamed("_f", "image")
    scales = boxes.dimension(boxes.box_counts(files, F.col("_h"), F.col("_w")))
    n = files.groupBy("image").agg(F.count(F.lit(1)).alias("fractal_foreground_pixels"))
    h = hull.measure(hull.vertices(files), files)
    file = F.col("image")
    parts = names.unknown_parts(file)
    by = lambda c, digits: F.round(c, digits)
    area, perimeter, span = F.col("hull_area"), F.col("hull_perimeter"), F.col("span")
    rows = scales.join(n, "image").join(h, "image", "left").select(
        names.clean_cell_name(file).alias("cell_name"), parts["image_name"].alias("image_name"), parts["soma_id"].alias("soma_id"), parts["area"].alias("mask_area_um2"), file.alias("mask_file"),
        by("fractal_dimension", 6).alias("fractal_dimension"), by("r2", 6).alias("fractal_r_squared"), by("mean_lacunarity", 6).alias("fractal_lacunarity_mean"),
        by("first_lacunarity", 6).alias("fractal_lacunarity_small"), by("last_lacunarity", 6).alias("fractal_lacunarity_large"), F.col("scales").alias("fractal_num_scales"),
        "fractal_foreground_pixels", by(F.col("fractal_foreground_pixels") * pixel_size**2, 4).alias("fractal_foreground_area_um2"),
        by(area, 4).alias("hull_area_px"), by(area * pixel_size**2, 4).alias("hull_area_um2"), by(perimeter, 4).alias("hull_perimeter_px"), by(perimeter * pixel_size, 4).alias("hull_perimeter_um"),
        by("hull_circularity", 6).alias("hull_circularity"), by("density", 6).alias("hull_density"), by(span, 4).alias("hull_max_span_px"), by(span * pixel_size, 4).alias("hull_max_span_um"), by("span_ratio", 6).alias("hull_span_ratio"),
    )
    return result_sheet(rows, FRACTAL_COLUMNS)


def skeleton_sheet(mask: DataFrame, pixel_size: float, upscale: int = 1) -> DataFrame:
    """Shape of every mask and metrics of its skeleton, loops opened. The skeleton is drawn on the mask enlarged ``upscale`` times, its
    lengths are in micrometres all the same."""
    px = pixel_size / upscale
    thin = skeleton.without_loops(skeleton.thin(skeleton.upscale(mask, upscale) if upscale > 1 else mask.select(AT)))
    n = thin.groupBy("image").agg((F.count(F.lit(1)) * px**2).alias("skeleton_area_um2"))
    graph = skeleton.graph_metrics(thin, px).join(skeleton.longest_path(thin, px), "image", "left").join(n, "image")
    file, area = F.col("image"), F.col("mask_area")
    cell = names.clean_cell_name(file)
    number = lambda old, new: F.col(old).cast("long").alias(new)
    rows = hull.mask_shapes(mask, pixel_size).join(graph, "image").select(
        cell.alias("cell_name"), file.alias("mask_file"), F.concat(cell, F.lit("_skeleton.tif")).alias("skeleton_file"), F.lit(pixel_size).alias("pixel_size_um"), F.lit(upscale).alias("upscale_factor"),
        area.alias("mask_area_um2"), F.col("mask_perimeter").alias("mask_perimeter_um"), "mask_circularity", "mask_aspect_ratio", "mask_roundness", "mask_solidity",
        number("branches", "num_branches"), number("junctions", "num_junctions"), number("end_points", "num_end_points"), number("junction_voxels", "num_junction_voxels"), number("slab_voxels", "num_slab_voxels"),
        number("triple_points", "num_triple_points"), number("quadruple_points", "num_quadruple_points"), F.col("max_branch_length").alias("max_branch_length_um"), F.col("mean_branch_length").alias("avg_branch_length_um"),
        F.col("longest_shortest_path").alias("longest_shortest_path_um"), F.when((F.col("mean_branch_length") > 0) & (F.col("branches") > 0), F.col("mean_branch_length") * F.col("branches")).otherwise(F.col("slab_voxels") * px).alias("total_skeleton_length_um"),
        "skeleton_area_um2", F.when(area > 0, F.col("skeleton_area_um2") / area).otherwise(0.0).alias("branching_density"),
    )
    return result_sheet(rows, SKELETON_COLUMNS)


def process_shape(mask: DataFrame, height: int | Column, width: int | Column, pixel_size: float, soma: DataFrame | None = None) -> DataFrame:
    """Processes of every cell: total length, mean thickness (twice the distance to the background along the skeleton), branch points,
    ends and ramification index (ends per process that leaves the soma); the ``soma`` (image, y, x) does not count as process."""
    thin = skeleton.thin(mask)
    d = distance.to_background(mask, height, width)
    outside = thin if soma is None else thin.join(soma.select(AT), AT, "left_anti")
    graph = skeleton.graph_metrics(outside, pixel_size)
    thick = outside.join(d, AT).groupBy("image").agg((2 * pixel_size * F.avg("d")).alias("mean_process_thickness"))
    parts = morphology.components(outside).groupBy("image").agg(F.count_distinct("label").alias("processes"))
    out = graph.join(thick, "image").join(parts, "image")
    return out.select("image", F.col("total_length").alias("process_length"), "mean_process_thickness", F.col("junctions").alias("branch_points"), F.col("end_points").alias("endpoints"), "processes", (F.col("end_points") / F.col("processes")).alias("ramification_index"))
