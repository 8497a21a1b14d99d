"""Mask review as a stream: one state machine per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

OUTPUT = "cell long, seq long, area int, approved boolean"


#: Decisions of a stack that are kept in one entry of the state.
BLOCK = 64


class Review(StatefulProcessor):
    """State of a cell: its masks with their decision and the seq of the event that made it, and the stack of decisions that can be undone, in
    blocks. A cell's events of a batch are folded in memory: its masks are read and written once, and of the stack the blocks that changed,
    however many events there are.

    Emits the masks that an event changed, with their new decision (null: open again).
    """

    def __init__(self, areas: tuple[int, ...]):
        self.areas = areas

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.masks = handle.getValueState("masks", StructType([StructField("depth", LongType()), StructField("approved", ArrayType(BooleanType())), StructField("by", ArrayType(LongType()))]))
        self.stack = handle.getMapState("stack", long("block"), StructType([StructField("seqs", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802  name set by Spark
        held = self.masks.get()
        depth, approved, by = held if held is not None else (0, [None] * len(self.areas), [None] * len(self.areas))
        state = dict(zip(self.areas, zip(approved, by, strict=True), strict=True))
        blocks: dict[int, list[int]] = {}
        stored, dirty = -(-depth // BLOCK), set()

        def block(k: int) -> list[int]:
            if k not in blocks:
                blocks[k] = list(self.stack.getValue((k,))[0]) if k < stored else []
            dirty.add(k)
            return blocks[k]

        for seq, area, op in sorted(((r.seq, r.area, r.op) for r in rows), key=lambda e: e[0]):
            if op == "undo":
                if not depth:
                    continue
                depth -= 1
                taken = block(depth // BLOCK).pop()
                changed = {a: (None, None) for a, (_, by) in state.items() if by == taken}
            elif area in state and op in ("approve", "reject"):
                yes = op == "approve"
                changed = {a: (yes, seq) for a, (s, _) in state.items() if a == area or (s is None and (a < area if yes else a > area))}
                block(depth // BLOCK).append(seq)
                depth += 1
            else:
                continue
            for a, new in changed.items():
                if new[0] != state[a][0]:
                    yield Row(cell=key[0], seq=seq, area=a, approved=new[0])
            state |= changed
        for k in sorted(dirty):
            if blocks[k]:
                self.stack.updateValue((k,), (blocks[k],))
            elif k < stored:
                self.stack.removeKey((k,))
        if dirty:
            self.masks.update((depth, [state[a][0] for a in self.areas], [state[a][1] for a in self.areas]))

    def close(self) -> None:
        pass


EVENTS = StructType([StructField("seq", LongType()), StructField("cell", LongType()), StructField("area", IntegerType()), StructField("op", StringType())])


def review_stream(events: DataFrame, areas: tuple[int, ...] = (200, 300, 400, 500, 600, 700, 800)) -> DataFrame:
    """Changed decisions of a stream of events (seq, cell, area, op), keyed by cell. Needs the RocksDB state store."""
    return events.groupBy("cell").transformWithState(Review(areas), OUTPUT, "append", "none")


def status_stream(events: DataFrame) -> DataFrame:
    """Latest status of each image of a stream (image_name, seq, status), for update mode."""
    return events.groupBy("image_name").agg(F.max_by("status", "seq").alias("status"))


def activity_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and values per window and type, tumbling or sliding, with a watermark for late ones (an extension)."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause of ``gap`` (an extension)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
