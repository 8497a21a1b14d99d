"""Skeletons: thinning, and metrics of the skeleton graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.operators import batches
from somatica.operators.morphology import component_roots, degrees, hooked, stride_of
from somatica.operators.pixels import AT


def thin(mask: DataFrame) -> DataFrame:
    """Skeleton of each image's mask by thinning in two sub-steps (Zhang and Suen, 1984).

    Many images a call, each on its mask's bounding box: what lies beyond a mask is empty, whatever the frame's size. An image that is done
    does not change while others go on.
    """

    kind = mask.schema["image"].dataType.simpleString()
    return batches.apply(mask.select(AT), ["image"], thin_run, f"image {kind}, y int, x int")


def thin_run(table, starts):
    for on, *rest in batches.strips(table, starts):
        yield batches.from_strip(table, starts, thinned(on), *rest)


def thinned(on, *_):
    """A boolean array, empty at its edges, thinned in place."""
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            gone = removable(on, first)
            changed |= bool(gone.any())
            on[1:-1, 1:-1] &= ~gone
    return on


def _rules() -> list[list[bool]]:
    """For both sub-steps: whether a pixel goes, by its neighbours as the bits of a number, from north on clockwise."""
    out = []
    for first in (True, False):
        n, e, s, w = ([bool(code >> k & 1) for code in range(256)] for k in (0, 2, 4, 6))
        turns = [sum(not code >> k & 1 and code >> (k + 1) % 8 & 1 for k in range(8)) for code in range(256)]
        sides = [not (a and b and c) and not (b and c and d) if first else not (a and b and d) and not (a and c and d) for a, b, c, d in zip(n, e, s, w, strict=True)]
        out.append([2 <= code.bit_count() <= 6 and turns[code] == 1 and sides[code] for code in range(256)])
    return out


#: By sub-step, as ``removable`` needs them.
_GOES = _rules()


def removable(on, first: bool):
    """Pixels (without the frame of one) that a sub-step of the thinning deletes."""
    import numpy as np

    n, ne, e, se, s, sw, w, nw = on[:-2, 1:-1], on[:-2, 2:], on[1:-1, 2:], on[2:, 2:], on[2:, 1:-1], on[2:, :-2], on[1:-1, :-2], on[:-2, :-2]
    code = np.zeros(n.shape, np.uint8)
    for k, p in enumerate((n, ne, e, se, s, sw, w, nw)):
        code |= p.view(np.uint8) << np.uint8(k)
    return on[1:-1, 1:-1] & np.array(_GOES[0 if first else 1])[code]


def points(skeleton: DataFrame) -> DataFrame:
    """Skeleton pixels with degree and kind: end (at most one neighbour), slab (two), junction (more)."""
    kind = F.when(F.col("degree") <= 1, "end").when(F.col("degree") == 2, "slab").otherwise("junction")
    return degrees(skeleton).withColumn("kind", kind)


def links(at, stride: int):
    """Neighbouring pixels of a skeleton (sorted raster places): their indices, each pair once, and how far apart they are."""
    import numpy as np

    a, b, length = [], [], []
    for dy, dx in [(0, 1), (1, -1), (1, 0), (1, 1)]:
        i = np.searchsorted(at, at + dy * stride + dx)
        i[i == len(at)] = 0
        hit = np.flatnonzero(at[i] == at + dy * stride + dx)
        a.append(hit)
        b.append(i[hit])
        length.append(np.full(len(hit), math.hypot(dy, dx)))
    return np.concatenate(a), np.concatenate(b), np.concatenate(length)


def parts(at, stride: int):
    """``links``, the number of neighbours of each pixel, and its part: the junction pixels that touch, or the branch between junctions, by
    the first pixel."""
    import numpy as np

    a, b, length = links(at, stride)
    degree = np.bincount(a, minlength=len(at)) + np.bincount(b, minlength=len(at))
    own = (degree[a] > 2) == (degree[b] > 2)
    return a, b, length, degree, hooked(a[own], b[own], len(at))


GRAPH_METRICS = ("end_points", "slab_voxels", "junction_voxels", "junctions", "triple_points", "quadruple_points", "branches", "mean_branch_length", "max_branch_length", "total_length")


def graph_metrics(skeleton: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Metrics of each image's skeleton: pixel classes, junction clusters by how many branches meet, branches and lengths.

    A branch is a connected run of pixels that are not junctions; its length sums its steps (1 or root 2). Junction
    pixels that touch are one junction. Every image is labelled at once, many images a call.
    """

    def row(y, x):
        import numpy as np

        at, stride = raster(y, x)
        a, b, length, degree, part = parts(at, stride)
        knot = degree > 2
        own = knot[a] == knot[b]
        joints, branches = np.unique(part[knot]), np.unique(part[~knot])
        meet = np.unique(np.stack([np.where(knot[a], part[a], part[b])[~own], np.where(knot[a], part[b], part[a])[~own]]), axis=1)
        arms = np.bincount(meet[0], minlength=len(at))[joints]
        lengths = np.bincount(part[a[own & ~knot[a]]], length[own & ~knot[a]], len(at))[branches] * pixel_size
        n = {"end_points": degree <= 1, "slab_voxels": degree == 2, "junction_voxels": knot, "triple_points": arms == 3, "quadruple_points": arms == 4}
        row = {k: int(v.sum()) for k, v in n.items()} | {"junctions": len(joints), "branches": len(branches)}
        some = len(branches) > 0
        row |= {"mean_branch_length": float(lengths.mean()) if some else 0.0, "max_branch_length": float(lengths.max()) if some else 0.0, "total_length": float(lengths.sum())}
        return [row[k] for k in GRAPH_METRICS]

    def run(table, starts):
        import pyarrow as pa

        y, x = batches.numbers(table, "y"), batches.numbers(table, "x")
        columns = zip(*(row(y[i:j], x[i:j]) for i, j in batches.spans(table, starts)), strict=True)
        arrays = [pa.array(c, pa.float64() if "length" in k else pa.int64()) for c, k in zip(columns, GRAPH_METRICS, strict=True)]
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts), *arrays], ["image", *GRAPH_METRICS])

    kinds = ", ".join(f"{k} {'double' if 'length' in k else 'long'}" for k in GRAPH_METRICS)
    return batches.apply(skeleton.select(AT), ["image"], run, f"image {skeleton.schema['image'].dataType.simpleString()}, {kinds}")


def raster(y, x):
    """Sorted raster places of pixels, each once, and their stride."""
    import numpy as np

    stride = stride_of(x)
    return np.unique(y.astype(np.int64) * stride + x.astype(np.int64)), stride


def longest_path(skeleton: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Longest of the shortest ways between ends and junctions of each image's first skeleton, the one with the first pixel.

    Runs of pixels with two neighbours become edges with a length, and the shortest ways are found on the small graph of ends and
    junctions; many images a call.
    """

    def run(table, starts):
        import pyarrow as pa

        y, x, out = batches.numbers(table, "y"), batches.numbers(table, "x"), []
        for i, j in batches.spans(table, starts):
            at, stride = raster(y[i:j], x[i:j])
            at = at[component_roots(at, [1, stride - 1, stride, stride + 1]) == 0]
            out.append(float(longest_way(*skeleton_graph(at, stride)) * pixel_size))
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", starts), pa.array(out, pa.float64())], ["image", "d"])

    kind = skeleton.schema["image"].dataType.simpleString()
    return batches.apply(skeleton.select(AT), ["image"], run, f"image {kind}, d double").withColumnRenamed("d", "longest_shortest_path")


def skeleton_graph(at, stride: int):
    """Graph of a skeleton (sorted raster places): number of its nodes, ends and junctions, and edges (node, node, length).

    A pixel with two neighbours lies on a simple path, so such pixels hang together as paths; each is an edge between the nodes at its
    ends, as are two nodes side by side.
    """
    import numpy as np

    a, b, length = links(at, stride)
    node = np.bincount(a, minlength=len(at)) + np.bincount(b, minlength=len(at)) != 2
    number = np.cumsum(node) - 1
    slab = ~node[a] & ~node[b]
    path = hooked(a[slab], b[slab], len(at))
    along = np.bincount(path[a[slab]], length[slab], len(at))
    direct = node[a] & node[b]
    edges = list(zip(number[a[direct]].tolist(), number[b[direct]].tolist(), length[direct].tolist(), strict=True))
    ends: dict[int, list] = {}
    for x, y, n in ((a, b, length), (b, a, length)):
        some = node[x] & ~node[y]
        for u, k, w in zip(number[x[some]].tolist(), path[y[some]].tolist(), n[some].tolist(), strict=True):
            ends.setdefault(k, []).append((u, w))
    edges += [(e[0][0], e[1][0], e[0][1] + e[1][1] + float(along[k])) for k, e in ends.items() if len(e) == 2]
    return int(node.sum()), edges


def longest_way(nodes: int, edges: list[tuple[int, int, float]]) -> float:
    """Longest of the shortest ways between any two nodes of a graph that hangs together.

    Ways from one node bound those from every other: they reach at most as far as both together. Nodes that cannot reach further than the
    longest way so far are not begun from, which leaves few of a skeleton's (Takes and Kosters, 2011).
    """
    import heapq

    near: list[dict[int, float]] = [{} for _ in range(nodes)]
    for u, v, w in edges:
        if u != v and w < near[u].get(v, math.inf):
            near[u][v] = near[v][u] = w
    longest, most, left = 0.0, [math.inf] * nodes, list(range(nodes))
    least, outward = [0.0] * nodes, True
    while left:
        # by turns the node that may reach furthest, and the one that is most in the middle
        begin = max(left, key=most.__getitem__) if outward else min(left, key=least.__getitem__)
        outward = not outward
        far, open_ = {begin: 0.0}, [(0.0, begin)]
        while open_:
            d, u = heapq.heappop(open_)
            if d > far[u]:
                continue
            for v, w in near[u].items():
                if d + w < far.get(v, math.inf):
                    far[v] = d + w
                    heapq.heappush(open_, (d + w, v))
        reach = max(far.values())
        longest = max(longest, reach)
        for v, d in far.items():
            most[v] = min(most[v], reach + d)
            least[v] = max(least[v], d, reach - d)
        left = [v for v in left if v != begin and most[v] > longest]
    return longest


def without_loops(skeleton: DataFrame) -> DataFrame:
    """``skeleton`` with every loop opened at its shortest branch.

    Branches are taken from the longest on; one whose junctions are linked already closes a loop and goes, as does one without an
    end that meets a single junction. Junctions and branches of an image are labelled at once; many images a call.
    """

    def kept(y, x):
        import numpy as np

        at, stride = raster(y, x)
        a, b, _, degree, part = parts(at, stride)
        knot = degree > 2
        mixed = knot[a] != knot[b]
        met: dict[int, set[int]] = {}
        for branch, joint in zip(np.where(knot[a], part[b], part[a])[mixed].tolist(), np.where(knot[a], part[a], part[b])[mixed].tolist(), strict=True):
            met.setdefault(branch, set()).add(joint)
        size, ended = np.bincount(part, minlength=len(at)), np.bincount(part, degree <= 1, len(at)) > 0
        root: dict[int, int] = {}

        def top(k: int) -> int:
            while root.setdefault(k, k) != k:
                k = root[k]
            return k

        gone = []
        for branch in sorted(met, key=lambda k: (-size[k], k)):
            tops = [top(k) for k in sorted(met[branch])]
            if len(set(tops)) < len(tops) or (len(tops) == 1 and not ended[branch]):
                gone.append(branch)
            else:
                root.update(dict.fromkeys(tops, min(tops)))
        left = at[~np.isin(part, gone)]
        return left // stride, left % stride

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        y, x = batches.numbers(table, "y"), batches.numbers(table, "x")
        found = [kept(y[i:j], x[i:j]) for i, j in batches.spans(table, starts)]
        rows = np.repeat(starts, [len(c[0]) for c in found])
        return pa.RecordBatch.from_arrays([batches.chosen(table, "image", rows), *(pa.array(np.concatenate([c[k] for c in found]).astype(np.int32)) for k in (0, 1))], ["image", "y", "x"])

    kind = skeleton.schema["image"].dataType.simpleString()
    return batches.apply(skeleton.select(AT), ["image"], run, f"image {kind}, y int, x int")


def upscale(mask: DataFrame, k: int = 2) -> DataFrame:
    """Every pixel as ``k`` x ``k`` pixels."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(k) for b in range(k)]))
    return mask.select(*AT, o.alias("o")).select("image", (F.col("y") * k + F.col("o.dy")).alias("y"), (F.col("x") * k + F.col("o.dx")).alias("x"))
