"""Groups in batches: many small groups of rows in one call of a function, so that a group costs no call of its own.

Rows are shuffled and sorted by their keys; a task sees Arrow batches of whole groups. A group of any size is put together
before it is handed over, so tasks hold a batch or their largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows sorted by their keys, and where each group begins, to the rows of all groups' results.
Run = Callable[[pa.Table, np.ndarray], pa.RecordBatch | Iterator[pa.RecordBatch]]

#: Pixels of a stack of small images that is worked on at a time; it should stay in a core's cache.
STACK = 1 << 16


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; nulls are equal to each other."""
    known = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(known, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def starts_of(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows at which the groups of the first ``keys`` columns begin; rows are sorted by them."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in range(keys):
        c = table.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        change[1:] |= _differs(c[1:], c[:-1])
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut anew, so that none parts a group, each with the rows at which its groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = starts_of(batch, keys)
        new = bool(held) and len(starts_of(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 2
        cut = int(starts[-1])
        if cut == 0 and not new:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, keys)
        held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, keys)


def parts(df: DataFrame) -> int:
    """Tasks for work that takes long beside its bytes: as many as shuffles have, not as few as the bytes ask for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` shuffled and sorted by ``keys``, which come first, in as many tasks as shuffles have."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(parts(df), *keys).sortWithinPartitions(*keys)


def apply(df: DataFrame, keys: list[str], run: Run | list[Run], schema: str) -> DataFrame:
    """What ``run`` makes of the groups of ``df`` by ``keys`` (its columns come first), many groups a call. Of several functions each gets the
    last one's rows, which must have the keys first and keep groups together: one shuffle for all."""
    runs = run if isinstance(run, list) else [run]

    def step(batches, f):
        for table, starts in whole_groups(batches, len(keys)):
            out = f(table, starts)
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    def each(batches):
        return reduce(step, runs, batches)

    return sorted_by(df, keys).mapInArrow(each, schema)


def numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as an array."""
    return table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy()


def chosen(table: pa.Table | pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    """A column's values at ``rows``, of any type."""
    out = table.column(name).take(pa.array(rows))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def binaries(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of byte strings without nulls, end to end, and where each begins (one more: the end of the last)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def of_doubles(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of byte strings: runs of ``sizes`` doubles each, end to end in ``values``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
    data = pa.py_buffer(np.ascontiguousarray(values, float))
    if ends[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), data])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), data])


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``sizes`` elements: each element's run, and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def spans(table: pa.Table, starts: np.ndarray) -> list[tuple[int, int]]:
    """First row and last row + 1 of each group."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True))


def strips(table: pa.Table, starts: np.ndarray, gap: int = 1, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Masks (y, x) of groups below each other in boolean arrays of about ``most`` pixels, each on its bounding box with ``gap`` empty rows and a
    column around it: the array, the groups in it, each one's first row there, and what its rows and columns are short of those of the mask."""
    y, x = (numbers(table, c).astype(np.int64) for c in ("y", "x"))
    y0, x0, y1, x1 = (f.reduceat(c, starts) for f, c in ((np.minimum, y), (np.minimum, x), (np.maximum, y), (np.maximum, x)))
    high, wide = y1 - y0 + 1 + 2 * gap, x1 - x0 + 3
    ends, first = np.append(starts, table.num_rows), 0
    while first < len(starts):
        area = np.cumsum(high[first:]) * np.maximum.accumulate(wide[first:])
        last = first + max(1, int(np.searchsorted(area, most, "right")))
        rows = np.cumsum(high[first:last]) - high[first:last]
        on = np.zeros((int(high[first:last].sum()), int(wide[first:last].max())), bool)
        i, j = ends[first], ends[last]
        group, _ = places(np.diff(ends[first : last + 1]))
        dy, dx = y0[first:last] - rows - gap, x0[first:last] - 1
        on[y[i:j] - dy[group], x[i:j] - dx[group]] = True
        yield on, np.arange(first, last), rows, dy, dx
        first = last


def from_strip(table: pa.Table, starts: np.ndarray, on: np.ndarray, groups: np.ndarray, rows: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> pa.RecordBatch:
    """Pixels (image, y, x) of an array like one of ``strips``."""
    y, x = np.nonzero(on)
    at = np.searchsorted(rows, y, "right") - 1
    return pa.RecordBatch.from_arrays([chosen(table, "image", starts[groups[at]]), pa.array((y + dy[at]).astype(np.int32)), pa.array((x + dx[at]).astype(np.int32))], ["image", "y", "x"])


def in_strips(table: pa.Table, starts: np.ndarray, work: Callable, gap: int = 1) -> np.ndarray:
    """Whether ``work`` leaves each row's pixel: it gets an array like those of ``strips``, the groups in it and how many rows each has there, and
    returns such an array."""
    y, x = (numbers(table, c).astype(np.int64) for c in ("y", "x"))
    ends, out = np.append(starts, table.num_rows), np.zeros(table.num_rows, bool)
    for on, groups, rows, dy, dx in strips(table, starts, gap):
        left = work(on, groups, np.diff(np.append(rows, len(on))))
        i, j = ends[groups[0]], ends[groups[-1] + 1]
        group, _ = places(np.diff(ends[groups[0] : groups[-1] + 2]))
        out[i:j] = left[y[i:j] - dy[group], x[i:j] - dx[group]]
    return out
