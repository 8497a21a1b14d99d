"""Set morphology on masks (``image, y, x``): rows as words of bits, moved, joined and compared. No Python on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators import batches
from somatica.operators.pixels import AT

Offsets = list[tuple[int, int]]
EIGHT: Offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
FOUR: Offsets = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def disk(r: int) -> Offsets:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def cross(n: int) -> Offsets:
    """What ``n`` dilations with a plus sign reach."""
    return [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if abs(dy) + abs(dx) <= n]


def shifted(mask: DataFrame, offsets: Offsets, keep: list[str] | None = None) -> DataFrame:
    """Each pixel once per offset, moved by it."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets]))
    rest = [c for c in (keep or []) if c not in AT]
    return mask.select(*AT, *rest, o.alias("_o")).select("image", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), *rest)


#: Columns of a word: a row of a mask is cut into words of so many pixels, each a long with as much room at both sides together.
WORD, ROOM = 32, 16


def words(mask: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """A mask as words: image, y, w and ``bits``, of which bit k is the pixel at column ``w`` * 32 + k - 16; the first and last 16 bits
    repeat the neighbours' pixels. ``rest``: columns with one value an image, which stay."""
    rest, w = rest or [], F.shiftright("x", 5)
    k = F.col("x") - 32 * w
    near = F.filter(F.array(F.struct(w.alias("w"), (k + ROOM).alias("k")), F.struct(F.when(k < ROOM, w - 1).when(k >= WORD - ROOM, w + 1).alias("w"), F.when(k < ROOM, k + ROOM + WORD).otherwise(k + ROOM - WORD).alias("k"))), lambda p: p["w"].isNotNull())
    spread = mask.select("image", "y", *rest, F.explode(near).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.k").cast("int"))
    return spread.groupBy("image", "y", F.col("p.w").alias("w")).agg(F.bit_or(bit).alias("bits"), *[F.first(c).alias(c) for c in rest])


def pixels_of(rows: DataFrame) -> DataFrame:
    """Pixels of words, without what they repeat of their neighbours."""
    own = rows.withColumn("bits", F.shiftrightunsigned("bits", ROOM).bitwiseAND(F.lit((1 << WORD) - 1))).where("bits <> 0")
    each = F.explode(F.filter(F.array(*[F.lit(k) for k in range(WORD)]), lambda k: F.call_function("getbit", F.col("bits"), k) == 1))
    return own.select("image", "y", "w", each.alias("_k")).select("image", "y", (F.col("w") * WORD + F.col("_k")).cast("int").alias("x"))


def _moved(bits: Column, dx: int) -> Column:
    """Bits of a word moved by ``dx`` columns."""
    return bits if dx == 0 else F.shiftleft(bits, dx) if dx > 0 else F.shiftrightunsigned(bits, -dx)


def _by_row(offsets: Offsets) -> dict[int, list[int]]:
    """Steps along the row for each step across rows."""
    return {dy: sorted(dx for a, dx in offsets if a == dy) for dy in sorted({a for a, _ in offsets})}


def _dilated(rows: DataFrame, offsets: Offsets, rest: list[str]) -> DataFrame:
    """Words of a dilation. Bits within reach of a word's ends are not to be used."""
    moved = F.array(*[F.struct(F.lit(dy).alias("dy"), reduce(lambda a, b: a.bitwiseOR(b), [_moved(F.col("bits"), dx) for dx in steps]).alias("bits")) for dy, steps in _by_row(offsets).items()])
    spread = rows.select("image", "y", "w", *rest, F.explode(moved).alias("m")).select("image", (F.col("y") + F.col("m.dy")).alias("y"), "w", *rest, F.col("m.bits").alias("bits"))
    return spread.groupBy("image", "y", "w").agg(F.bit_or("bits").alias("bits"), *[F.first(c).alias(c) for c in rest])


def _eroded(rows: DataFrame, offsets: Offsets) -> DataFrame:
    """Words of an erosion: a word that lacks one of the rows it needs is empty."""
    by_row = _by_row(offsets)
    moved = F.array(*[F.struct(F.lit(dy).alias("dy"), reduce(lambda a, b: a.bitwiseAND(b), [_moved(F.col("bits"), -dx) for dx in steps]).alias("bits")) for dy, steps in by_row.items()])
    spread = rows.select("image", "y", "w", F.explode(moved).alias("m")).where("m.bits <> 0").select("image", (F.col("y") - F.col("m.dy")).alias("y"), "w", F.col("m.bits").alias("bits"))
    return spread.groupBy("image", "y", "w").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(by_row)).drop("n")


def _framed(rows: DataFrame, height: str, width: str) -> DataFrame:
    """Words without the pixels beyond the frame."""
    first, last = F.greatest(F.lit(0), ROOM - WORD * F.col("w")), F.least(F.lit(63), F.col(width) - 1 - WORD * F.col("w") + ROOM)
    ones = F.lit(-1).cast("long")
    inside = F.call_function("shiftleft", F.call_function("shiftrightunsigned", ones, (63 - (last - first)).cast("int")), first.cast("int"))
    return rows.where(F.col("y").between(0, F.col(height) - 1) & (first <= last)).withColumn("bits", F.col("bits").bitwiseAND(inside))


def _reach(offsets: Offsets) -> int:
    return max(abs(dx) for _, dx in offsets)


def dilate(mask: DataFrame, offsets: Offsets, height: int | Column | None = None, width: int | Column | None = None) -> DataFrame:
    """Pixels that some offset reaches; with a size (numbers, or columns of ``mask``) those inside the frame.

    Rows of 32 pixels are one number each (``words``), whose bits move together; so in erosion, closing and opening. Offsets that reach
    further than words have room move pixels one by one.
    """
    framed = height is not None and width is not None
    rest = ["_h", "_w"] if framed else []
    sized = mask.select(*AT, *([F.lit(height).alias("_h"), F.lit(width).alias("_w")] if framed else []))
    if _reach(offsets) > ROOM:
        inside = F.col("y").between(0, F.col("_h") - 1) & F.col("x").between(0, F.col("_w") - 1) if framed else F.lit(True)
        return shifted(sized, offsets, rest).where(inside).select(AT).distinct()
    rows = _dilated(words(sized, rest), offsets, rest)
    return pixels_of(_framed(rows, "_h", "_w") if framed else rows)


def erode(mask: DataFrame, offsets: Offsets) -> DataFrame:
    """Pixels all of whose offsets are in the mask; beyond the frame counts as empty."""
    if _reach(offsets) > ROOM:
        back = [(-a, -b) for a, b in offsets]
        n = shifted(mask.select(AT).distinct(), back).groupBy(AT).agg(F.count(F.lit(1)).alias("n"))
        return n.where(F.col("n") == len(offsets)).select(AT)
    return pixels_of(_eroded(words(mask), offsets))


def close(mask: DataFrame, offsets: Offsets, height: int | Column | None = None, width: int | Column | None = None) -> DataFrame:
    if 2 * _reach(offsets) > ROOM:
        return erode(dilate(mask, offsets, height, width), offsets)
    if height is None or width is None:
        return pixels_of(_eroded(_dilated(words(mask), offsets, []), offsets))
    rest = ["_h", "_w"]
    rows = _dilated(words(mask.select(*AT, F.lit(height).alias("_h"), F.lit(width).alias("_w")), rest), offsets, rest)
    return pixels_of(_eroded(_framed(rows, *rest), offsets))


def open_(mask: DataFrame, offsets: Offsets) -> DataFrame:
    if 2 * _reach(offsets) > ROOM:
        return dilate(erode(mask, offsets), offsets)
    return pixels_of(_dilated(_eroded(words(mask), offsets), offsets, []))


def neighbour_sums(mask: DataFrame, weights: list[tuple[tuple[int, int], int]]) -> DataFrame:
    """``mask`` with ``s``: the sum of the weights of its neighbours in the mask.

    Each pixel is sent to its neighbours and, marked, to itself; one aggregation adds up and keeps the marked, so no join.
    """
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w"), F.lit(0).alias("own")) for (a, b), w in [*weights]], F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(0).alias("w"), F.lit(1).alias("own"))))
    d = mask.select(*AT, o.alias("_o")).select("image", (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x"), F.col("_o.w").alias("w"), F.col("_o.own").alias("own"))
    return d.groupBy(AT).agg(F.sum("w").alias("s"), F.max("own").alias("own")).where("own = 1").drop("own")


def degrees(mask: DataFrame, offsets: Offsets = EIGHT) -> DataFrame:
    """``mask`` with ``degree``: how many of its neighbours are in the mask."""
    return neighbour_sums(mask, [(o, 1) for o in offsets]).withColumnRenamed("s", "degree")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(AT).union(b.select(AT)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(AT).join(b.select(AT), AT, "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(AT).join(b.select(AT), AT, "left_anti")


def boundary(mask: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour outside the mask."""
    return degrees(mask, FOUR).where("degree < 4").select(AT)


#: Raster places are y times a stride plus x: the first stride for images up to 65,535 columns, the second for wider ones.
NEAR, FAR = 1 << 16, 1 << 32


def stride_of(x) -> int:
    """Stride of a mask's raster places, from its columns; no pixel may have a neighbour by place that is none by row and column."""
    return NEAR if not len(x) or int(x.max()) < NEAR - 1 else FAR


def components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """``mask`` with ``label``: the smallest raster place of its connected component (y * 65,536 + x; in an image with a pixel beyond
    column 65,534, y * 2**32 + x).

    Many images a call; inside, sparse min-label hooking with pointer jumping. ``tiles.components`` does the same tile by tile.
    """
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)] if diagonal else [(0, 1), (1, 0)]

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        # images with a pixel in a far column have the wider stride
        far = np.maximum.reduceat(batches.numbers(table, "x"), starts) >= NEAR - 1
        group, at, row = raster_places(table, starts, FAR)
        root = component_roots_of(group, at, [dy * FAR + dx for dy, dx in steps])
        y, x = at // FAR, at % FAR
        label = np.where(far[group], at[root], y[root] * NEAR + x[root])
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", row), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(label)], ["image", "y", "x", "label"])

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(mask.select(AT), ["image"], run, f"image {kind}, y int, x int, label long")


def raster_places(table, starts, stride: int):
    """Pixels (y, x) of groups of rows, each once and in raster order: their group, their raster place, and a row of their group."""
    import numpy as np

    group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
    at = batches.numbers(table, "y").astype(np.int64) * stride + batches.numbers(table, "x").astype(np.int64)
    order = np.lexsort((at, group))
    group, at = group[order], at[order]
    once = np.ones(len(at), bool)
    once[1:] = (group[1:] != group[:-1]) | (at[1:] != at[:-1])
    return group[once], at[once], starts[group[once]]


def labels_of(group, y, x):
    """Labels of ``components`` (diagonal steps) of pixels, each once, of many groups."""
    import numpy as np

    at, far = y.astype(np.int64) * FAR + x, np.zeros(int(group.max(initial=0)) + 1, bool)
    far[group[x >= NEAR - 1]] = True
    order = np.lexsort((at, group))
    label, place = np.empty(len(at), np.int64), at[order]
    root = place[component_roots_of(group[order], place, [dy * FAR + dx for dy, dx in [(0, 1), (1, -1), (1, 0), (1, 1)]])]
    label[order] = np.where(far[group[order]], root, root // FAR * NEAR + root % FAR)
    return label


def component_roots_of(group, at, steps: list[int]):
    """``component_roots`` of many groups of pixels at once: index of the first pixel of each pixel's component in its group."""
    import numpy as np

    # the places that occur, numbered: a neighbour's place is looked up once for all groups, and pixels by group and number
    every = np.unique(at)
    own = np.searchsorted(every, at)
    pixel = group * len(every) + own
    a, b = [], []
    for s in steps:
        next_ = np.searchsorted(every, every + s)
        next_[next_ == len(every)] = 0
        there = every[next_] == every + s
        want = np.flatnonzero(there[own])
        key = group[want] * len(every) + next_[own[want]]
        i = np.searchsorted(pixel, key)
        i[i == len(pixel)] = 0
        hit = pixel[i] == key
        a.append(want[hit])
        b.append(i[hit])
    return hooked(np.concatenate(a), np.concatenate(b), len(at))


def component_roots(at, steps: list[int]):
    """Index of the first pixel of each pixel's component; ``at``: sorted raster places, ``steps``: forward neighbours."""
    import numpy as np

    a, b = [], []
    for s in steps:
        i = np.searchsorted(at, at + s)
        i[i == len(at)] = 0
        hit = np.flatnonzero(at[i] == at + s)
        a.append(hit)
        b.append(i[hit])
    return hooked(np.concatenate(a), np.concatenate(b), len(at))


def hooked(a, b, n: int):
    """Smallest node reachable from each of ``n`` nodes over the links ``a`` to ``b``."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def run_labels(on):
    """8-connected components of a boolean array by its horizontal runs: first and last + 1 place of each run (in an array with an empty
    column at both sides) and the first run of its component."""
    import numpy as np

    w = on.shape[1] + 2
    flat = np.zeros((on.shape[0], w), np.int8)
    flat[:, 1:-1] = on
    turn = np.diff(flat.ravel())
    starts, ends = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
    # runs of the next row that a run touches: the first that ends behind its left neighbour, up to the last that begins before its right one
    first, last = np.searchsorted(ends, starts - 1 + w, "right"), np.searchsorted(starts, ends + 1 + w, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return starts, ends, hooked(a, b, len(starts))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image", "label").agg(F.count(F.lit(1)).alias("size"))


def despeckle(mask: DataFrame, least: int, diagonal: bool = False) -> DataFrame:
    """``mask`` without components of fewer than ``least`` pixels."""
    n = F.count(F.lit(1)).over(Window.partitionBy("image", "label"))
    return components(mask, diagonal).withColumn("_n", n).where(F.col("_n") >= least).select(AT)
