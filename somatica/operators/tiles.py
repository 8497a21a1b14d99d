"""Rasters as tiles: blocks of an image, one row each, so that no task holds a whole slide.

A tile is a row (image, ty, tx, height, width, block): its place in the image's grid of ``size`` x ``size`` tiles, the size of the
image, and its pixels in raster order as 64-bit floats, NaN where the image has no pixel. Tiles at the right and lower border are smaller.
Filters exchange halos: a tile sends only the strips that other tiles reach into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatica.operators import batches
from somatica.operators.pixels import AT

#: Side of a tile: 512 x 512 doubles are 2 MB.
SIZE = 512
TILE = ["image", "ty", "tx"]
#: Padded block (mirrored beyond the frame, 0 where pixels are missing), or a stack of such blocks of one size along a first axis, and
#: which of a block lies inside the frame, to a block or stack.
Work = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _kind(df: DataFrame) -> str:
    return df.schema["image"].dataType.simpleString()


def from_pixels(px: DataFrame, height: int | Column, width: int | Column, size: int = SIZE) -> DataFrame:
    """Tiles of pixels (image, y, x, v). ``height`` and ``width`` are numbers, or columns of ``px`` where images differ in size."""

    def run(table, starts):
        h, w, ty, tx = (batches.numbers(table, c)[starts].astype(np.int64) for c in ("height", "width", "ty", "tx"))
        rows, across = np.minimum(size, h - ty * size), np.minimum(size, w - tx * size)
        n = rows * across
        group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        first = np.cumsum(n) - n
        values = np.full(n.sum(), np.nan)
        y, x = (batches.numbers(table, c).astype(np.int64) for c in ("y", "x"))
        values[first[group] + (y - ty[group] * size) * across[group] + x - tx[group] * size] = table.column("v").cast(pa.float64()).to_numpy()
        kept = [batches.chosen(table, c, starts) for c in (*TILE, "height", "width")]
        return pa.RecordBatch.from_arrays([*kept, batches.of_doubles(values, n)], [*TILE, "height", "width", "block"])

    p = px.select(*AT, F.col("v").cast("double").alias("v"), F.lit(height).cast("int").alias("height"), F.lit(width).cast("int").alias("width"))
    p = p.where(F.col("y").between(0, F.col("height") - 1) & F.col("x").between(0, F.col("width") - 1))
    p = p.withColumns({"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")})
    return batches.apply(p, TILE, run, f"image {_kind(px)}, ty int, tx int, height int, width int, block binary")


def _spread(batch: pa.RecordBatch, keep: list[str], y0: np.ndarray, x0: np.ndarray, across: np.ndarray, piece: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Pixels of rows that hold a block each: their ``keep`` columns, y, x and v, without missing ones; about ``size`` pixels at a time."""
    raw, ends = batches.binaries(batch.column(piece))
    values, ends = raw.view(float), ends // 8
    block = ends[:-1] // size
    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        row, at = batches.places(np.diff(ends[i : j + 1]))
        v = values[ends[i] : ends[j]]
        seen = np.flatnonzero(~np.isnan(v))
        row, at, v = row[seen] + i, at[seen], v[seen]
        y, x = at // across[row] + y0[row], at % across[row] + x0[row]
        out = [batches.chosen(batch, c, row) for c in keep]
        yield pa.RecordBatch.from_arrays([*out, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(v)], [*keep, "y", "x", "v"])


def to_pixels(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """Pixels (image, y, x, v) of tiles, many tiles at a time."""

    def run(found):
        for batch in found:
            if batch.num_rows:
                ty, tx, w = (batches.numbers(batch, c).astype(np.int64) for c in ("ty", "tx", "width"))
                yield from _spread(batch, ["image"], ty * size, tx * size, np.minimum(size, w - tx * size), "block")

    return tiles.select(*TILE, "height", "width", "block").mapInArrow(run, f"image {_kind(tiles)}, y int, x int, v double")


def _block(data: bytes, ty: int, tx: int, height: int, width: int, size: int) -> np.ndarray:
    return np.frombuffer(data).reshape(min(size, height - ty * size), min(size, width - tx * size))


def _pieces(tiles: DataFrame, reach: int, size: int) -> DataFrame:
    """What each tile shows to the tiles ``reach`` pixels around it, itself first: those tiles' places, and the strip's."""
    far = -(-reach // size)
    names = [*TILE, "height", "width", "own", "y", "x", "h", "w", "piece"]

    def run(found):
        for batch in found:
            rows, kept = [], []
            columns = [batch.column(c).to_pylist() for c in ("ty", "tx", "height", "width", "block")]
            for k, (ty, tx, height, width, data) in enumerate(zip(*columns, strict=True)):
                block = _block(data, ty, tx, height, width, size)
                y0, x0 = ty * size, tx * size
                for ny in range(max(0, ty - far), min(-(-height // size), ty + far + 1)):
                    for nx in range(max(0, tx - far), min(-(-width // size), tx + far + 1)):
                        a, b = max(y0, ny * size - reach), min(y0 + block.shape[0], (ny + 1) * size + reach)
                        c, d = max(x0, nx * size - reach), min(x0 + block.shape[1], (nx + 1) * size + reach)
                        if a < b and c < d:
                            kept.append(k)
                            rows.append((ny, nx, height, width, (ny, nx) == (ty, tx), a, c, b - a, d - c, block[a - y0 : b - y0, c - x0 : d - x0].tobytes()))
            kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.int32()] * 4 + [pa.binary()]
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batches.chosen(batch, "image", np.array(kept, int)), *out], names)

    return tiles.select(*TILE, "height", "width", "block").mapInArrow(run, f"image {_kind(tiles)}, ty int, tx int, height int, width int, own boolean, y int, x int, h int, w int, piece binary")


def assembled(pdf: pd.DataFrame, y0: int, x0: int, h: int, w: int) -> np.ndarray:
    """The window at (y0, x0) from its pieces (y, x, h, w, piece); NaN where there is none."""
    return joined(zip(*(pdf[c].tolist() for c in ("y", "x", "h", "w", "piece")), strict=True), y0, x0, h, w)


def joined(pieces, y0: int, x0: int, h: int, w: int) -> np.ndarray:
    """``assembled`` of rows (y, x, h, w, piece)."""
    out = np.full((h, w), np.nan)
    for y, x, a, b, piece in pieces:
        out[y - y0 : y - y0 + a, x - x0 : x - x0 + b] = np.frombuffer(piece).reshape(a, b)
    return out


def _worked(seen: np.ndarray, beyond: tuple[tuple[int, int], tuple[int, int]], work: Work) -> np.ndarray:
    """``work`` on a block, or on a stack of blocks of one size, mirrored by ``beyond`` at its sides."""
    inside = np.pad(np.ones(seen.shape[-2:], bool), beyond)
    return work(np.pad(np.nan_to_num(seen), [*[(0, 0)] * (seen.ndim - 2), *beyond], mode="symmetric"), inside)


def filtered(tiles: DataFrame, reach: int, work: Work, size: int = SIZE) -> DataFrame:
    """``tiles`` with every block replaced by what ``work`` makes of it and the ``reach`` pixels around it.

    Beyond the frame the image is mirrored with its edge repeated. Missing pixels count as 0 and stay missing. Each tile is moved once;
    its neighbours get strips of ``reach`` pixels.
    """

    def run(table, starts):
        ty, tx, height, width = (batches.numbers(table, c)[starts].tolist() for c in ("ty", "tx", "height", "width"))
        owned = np.logical_or.reduceat(table.column("own").to_numpy(zero_copy_only=False), starts)
        pieces = list(zip(*(table.column(c).to_pylist() for c in ("y", "x", "h", "w", "piece")), strict=True))
        ends, kept, out = [*starts[1:].tolist(), table.num_rows], [], []
        for k, (i, j) in enumerate(zip(starts.tolist(), ends, strict=True)):
            if not owned[k]:
                continue
            h, w, y0, x0 = height[k], width[k], ty[k] * size, tx[k] * size
            y1, x1 = min(h, y0 + size), min(w, x0 + size)
            a, b, c, d = max(0, y0 - reach), min(h, y1 + reach), max(0, x0 - reach), min(w, x1 + reach)
            seen = joined(pieces[i:j], a, c, b - a, d - c)
            made = _worked(seen, ((a - y0 + reach, y1 + reach - b), (c - x0 + reach, x1 + reach - d)), work)
            shown = seen[y0 - a : y1 - a, x0 - c : x1 - c]
            out.append(np.where(np.isnan(shown), np.nan, made[reach : reach + y1 - y0, reach : reach + x1 - x0]).tobytes())
            kept.append(i)
        columns = [batches.chosen(table, c, np.array(kept, int)) for c in (*TILE, "height", "width")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*TILE, "height", "width", "block"])

    return batches.apply(_pieces(tiles, reach, size), TILE, run, f"image {_kind(tiles)}, ty int, tx int, height int, width int, block binary")


def _whole_images(tiles: DataFrame, reach: int, work: Work) -> DataFrame:
    """``filtered`` for tiles that are whole images: nothing moves, and images of one size are worked on as stacks."""

    def run(found):
        for batch in found:
            if not batch.num_rows:
                continue
            h, w = (batches.numbers(batch, c).astype(np.int64) for c in ("height", "width"))
            raw, ends = batches.binaries(batch.column("block"))
            values, first = raw.view(float).copy(), ends[:-1] // 8
            for high, wide in set(zip(h.tolist(), w.tolist(), strict=True)):
                rows = np.flatnonzero((h == high) & (w == wide))
                some = max(1, batches.STACK // ((high + 2 * reach) * (wide + 2 * reach)))
                for k in range(0, len(rows), some):
                    at = first[rows[k : k + some], None] + np.arange(high * wide)
                    seen = values[at].reshape(-1, high, wide)
                    made = _worked(seen, ((reach, reach), (reach, reach)), work)[:, reach : reach + high, reach : reach + wide]
                    values[at] = np.where(np.isnan(seen), np.nan, made).reshape(len(seen), -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*TILE, "height", "width")), batches.of_doubles(values, h * w)], [*TILE, "height", "width", "block"])

    return tiles.select(*TILE, "height", "width", "block").mapInArrow(run, f"image {_kind(tiles)}, ty int, tx int, height int, width int, block binary")


def filter_pixels(px: DataFrame, reach: int, work: Work, height: int | Column, width: int | Column, size: int = SIZE) -> DataFrame:
    """Pixels through ``filtered`` and back. Where the size says that every image is one tile, tiles need no neighbours."""
    found = from_pixels(px, height, width, size)
    one = isinstance(height, int) and isinstance(width, int) and max(height, width) <= size
    return to_pixels(_whole_images(found, reach, work) if one else filtered(found, reach, work, size), size)


def from_blocks(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of an image's blocks (image, y, x, h, w, height, width, samples, kind, piece), whatever their grid; where blocks overlap, as the
    pages of a stack do, the largest value. Of several samples the first counts. Blocks are cut before they move."""

    def cut(frames):
        for pdf in frames:
            rows = []
            for b in pdf.itertuples(index=False):
                block = np.frombuffer(b.piece, b.kind).reshape(b.h, b.w, -1)[:, :, 0].astype(float)
                for ty in range(b.y // size, (b.y + b.h - 1) // size + 1):
                    for tx in range(b.x // size, (b.x + b.w - 1) // size + 1):
                        a, c = max(b.y, ty * size), max(b.x, tx * size)
                        part = block[a - b.y : (ty + 1) * size - b.y, c - b.x : (tx + 1) * size - b.x]
                        rows.append((b.image, ty, tx, b.height, b.width, a, c, *part.shape, part.tobytes()))
            yield pd.DataFrame(rows, columns=[*TILE, "height", "width", "y", "x", "h", "w", "piece"]).astype({"image": pdf["image"].dtype})

    def join(table, starts):
        columns = {c: table.column(c).to_pylist() for c in ("ty", "tx", "height", "width", "y", "x", "h", "w", "piece")}
        high, wide, out = [], [], []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            h, w, y0, x0 = max(columns["height"][i:j]), max(columns["width"][i:j]), columns["ty"][i] * size, columns["tx"][i] * size
            block = np.full((min(size, h - y0), min(size, w - x0)), np.nan)
            for y, x, a, b, piece in zip(*(columns[c][i:j] for c in ("y", "x", "h", "w", "piece")), strict=True):
                at = np.s_[y - y0 : y - y0 + a, x - x0 : x - x0 + b]
                block[at] = np.fmax(block[at], np.frombuffer(piece).reshape(a, b))
            high.append(h)
            wide.append(w)
            out.append(block.tobytes())
        kept = [batches.chosen(table, c, starts) for c in TILE]
        return pa.RecordBatch.from_arrays([*kept, pa.array(high, pa.int32()), pa.array(wide, pa.int32()), pa.array(out, pa.binary())], [*TILE, "height", "width", "block"])

    parts = blocks.select("image", "y", "x", "h", "w", "height", "width", "samples", "kind", "piece").mapInPandas(cut, f"image {_kind(blocks)}, ty int, tx int, height int, width int, y int, x int, h int, w int, piece binary")
    return batches.apply(parts, TILE, join, f"image {_kind(blocks)}, ty int, tx int, height int, width int, block binary")


def windows(tiles: DataFrame, centres: DataFrame, half: int, size: int = SIZE) -> DataFrame:
    """Pieces of the windows around cells: image, cell, cy, cx, y, x, h, w, piece, to be grouped by (image, cell).

    ``centres``: image, cell, cy, cx. A window reaches from ``half`` before its centre to ``half`` behind it (that one not included), within
    the frame. Cells are joined with the tiles that their windows touch, by image and place in the grid, so the work follows
    the windows' pixels and not cells times pixels.
    """
    at = centres.select("image", "cell", F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"))
    grid = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - half) / size)).cast("int"), F.greatest(F.lit(0), F.floor((F.col(c) + half - 1) / size)).cast("int")))
    at = at.withColumn("ty", grid("cy")).withColumn("tx", grid("cx"))

    def run(frames):
        for pdf in frames:
            rows = []
            for t in pdf.itertuples(index=False):
                block = _block(t.block, t.ty, t.tx, t.height, t.width, size)
                y0, x0 = t.ty * size, t.tx * size
                a, b = max(y0, t.cy - half), min(y0 + block.shape[0], t.cy + half)
                c, d = max(x0, t.cx - half), min(x0 + block.shape[1], t.cx + half)
                if a < b and c < d:
                    rows.append((t.image, t.cell, t.cy, t.cx, a, c, b - a, d - c, block[a - y0 : b - y0, c - x0 : d - x0].tobytes()))
            yield pd.DataFrame(rows, columns=["image", "cell", "cy", "cx", "y", "x", "h", "w", "piece"]).astype({"image": pdf["image"].dtype, "cell": pdf["cell"].dtype})

    joined = tiles.join(at, TILE).select(*TILE, "height", "width", "cell", "cy", "cx", "block")
    cell = centres.schema["cell"].dataType.simpleString()
    return joined.mapInPandas(run, f"image {_kind(tiles)}, cell {cell}, cy int, cx int, y int, x int, h int, w int, piece binary")


def whole_window(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """The window that the pieces of a cell make up, and the place of its corner."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    return assembled(pdf, y0, x0, int((pdf["y"] + pdf["h"]).max()) - y0, int((pdf["x"] + pdf["w"]).max()) - x0), y0, x0


def crop(tiles: DataFrame, centres: DataFrame, half: int = 200, size: int = SIZE) -> DataFrame:
    """Pixels of the windows around cells: image, cell, y, x, v."""

    def run(found):
        for batch in found:
            if batch.num_rows:
                yield from _spread(batch, ["image", "cell"], *(batches.numbers(batch, c).astype(np.int64) for c in ("y", "x", "w")), "piece")

    cell = centres.schema["cell"].dataType.simpleString()
    return windows(tiles, centres, half, size).mapInArrow(run, f"image {_kind(tiles)}, cell {cell}, y int, x int, v double")


def components(mask: DataFrame, diagonal: bool = True, size: int = SIZE) -> DataFrame:
    """``mask`` (image, y, x) with ``label``, the same as ``morphology.components`` gives, without an image in one task.

    Each tile labels its own pixels; pixels on tile borders are joined with their neighbours in other tiles; the pairs of labels that
    touch, each once, are united per image.
    """
    from somatica.operators import morphology

    ahead = [(0, 1), (1, -1), (1, 0), (1, 1)] if diagonal else [(0, 1), (1, 0)]
    place = lambda y, x: F.shiftleft(y.cast("long"), 32) + x

    def local(table, starts):
        group, at, row = morphology.raster_places(table, starts, morphology.FAR)
        root = morphology.component_roots_of(group, at, [dy * morphology.FAR + dx for dy, dx in ahead])
        y, x = at // morphology.FAR, at % morphology.FAR
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", row), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(at[root])], ["image", "y", "x", "own"])

    def unite(table, starts):
        a, b = batches.numbers(table, "a"), batches.numbers(table, "b")
        group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        ends = np.stack([np.concatenate([group, group]), np.concatenate([a, b])])
        nodes, places = np.unique(ends, axis=1, return_inverse=True)
        root = morphology.hooked(places[: len(a)], places[len(a) :], nodes.shape[1])
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts[nodes[0]]), pa.array(nodes[1]), pa.array(nodes[1][root])], ["image", "own", "root"])

    tile = [F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")]
    labelled = batches.apply(mask.select(*AT, *tile), TILE, local, f"image {_kind(mask)}, y int, x int, own long")
    edge = (F.col("y") % size).isin(0, size - 1) | (F.col("x") % size).isin(0, size - 1)
    border = labelled.where(edge)
    moved = morphology.shifted(border, ahead, ["own"]).withColumnRenamed("own", "a")
    pairs = moved.join(border.withColumnRenamed("own", "b"), AT).where("a <> b").select("image", "a", "b").distinct()
    roots = batches.apply(pairs, ["image"], unite, f"image {_kind(mask)}, own long, root long")
    reach = mask.groupBy("image").agg(F.max("x").alias("_far"))
    out = labelled.join(roots, ["image", "own"], "left").join(reach, "image").withColumn("root", F.coalesce("root", "own"))
    y, x = F.shiftright("root", 32), F.col("root").bitwiseAND(F.lit(morphology.FAR - 1))
    stride = F.when(F.col("_far") < morphology.NEAR - 1, F.lit(morphology.NEAR)).otherwise(F.lit(morphology.FAR))
    return out.select(*AT, (y * stride + x).alias("label"))
