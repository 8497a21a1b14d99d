"""Mask review: decisions that cascade over a cell's nested masks, undo, and what is left to review.

``events``: seq, cell (image and soma), area, op (approve, reject or undo). ``masks``: cell, area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatica.operators import batches


def replay(masks: DataFrame, events: DataFrame) -> DataFrame:
    """Decision on each mask from approve and reject events: cell, area, approved (null: not reviewed).

    Approving a mask also approves the cell's smaller masks, rejecting it also rejects the larger ones, in both cases
    only those not reviewed yet. So a mask's state is its last direct decision, else the first decision that covered it.
    One join by cell and one aggregation; undo events are ignored here (``replay_with_undo`` follows them).
    """
    e = events.where("op in ('approve', 'reject')").select(F.col("cell").alias("_c"), "seq", F.col("area").alias("_a"), (F.col("op") == "approve").alias("yes"))
    covers = (F.col("_c") == F.col("cell")) & ((F.col("_a") == F.col("area")) | (F.col("yes") & (F.col("area") < F.col("_a"))) | (~F.col("yes") & (F.col("area") > F.col("_a"))))
    hit = masks.select("cell", "area").distinct().join(e, covers, "left")
    own = F.col("_a") == F.col("area")
    state = F.coalesce(F.max_by(F.when(own, F.col("yes")), F.when(own, F.col("seq"))), F.min_by("yes", "seq"))
    return hit.groupBy("cell", "area").agg(state.alias("approved"))


def fold(areas: list[int], events: list[tuple[int, int, str]]) -> tuple[dict[int, bool | None], list]:
    """State of one cell's masks after ``events`` (seq, area, op) in order, and the stack of decisions that can be undone.

    Undo takes the last decision back: its mask and those it cascaded to are unreviewed again.
    """
    state: dict[int, bool | None] = dict.fromkeys(areas)
    stack: list[list[int]] = []
    for _, area, op in events:
        apply_event(state, stack, area, op)
    return state, stack


def apply_event(state: dict[int, bool | None], stack: list[list[int]], area: int, op: str) -> None:
    if op == "undo":
        for a in stack.pop() if stack else ():
            state[a] = None
    elif area in state and op in ("approve", "reject"):
        yes = op == "approve"
        more = [a for a, s in state.items() if s is None and (a < area if yes else a > area)]
        for a in (area, *more):
            state[a] = yes
        stack.append([area, *more])


def replay_with_undo(masks: DataFrame, events: DataFrame) -> DataFrame:
    """As ``replay``, but undo events of a cell take its last decision back. Many cells a call, each one's events in order."""

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        group, _ = batches.places(np.diff(np.append(starts, table.num_rows)))
        order = np.lexsort((table.column("seq").fill_null(0).to_numpy(), group))
        area, op, mask = (table.column(c).take(pa.array(order)).to_pylist() for c in ("area", "op", "mask"))
        cells, areas, approved = [], [], []
        for i, j in batches.spans(table, starts):
            state, _ = fold(sorted({area[k] for k in range(i, j) if mask[k]}), [(k, area[k], op[k]) for k in range(i, j) if not mask[k]])
            cells += [i] * len(state)
            areas += state.keys()
            approved += state.values()
        return pa.RecordBatch.from_arrays([batches.chosen(table, "cell", np.array(cells, int)), pa.array(areas, pa.int32()), pa.array(approved, pa.bool_())], ["cell", "area", "approved"])

    own = masks.select("cell", F.lit(None).cast("long").alias("seq"), F.col("area").cast("int").alias("area"), F.lit(None).cast("string").alias("op"), F.lit(True).alias("mask"))
    each = events.select(F.col("cell").cast(masks.schema["cell"].dataType).alias("cell"), F.col("seq").cast("long").alias("seq"), F.col("area").cast("int").alias("area"), "op", F.lit(False).alias("mask"))
    return batches.apply(own.unionByName(each), ["cell"], run, f"cell {masks.schema['cell'].dataType.simpleString()}, area int, approved boolean")


def undone(events: DataFrame, block: int = 4096) -> DataFrame:
    """Which decision each undo of a session takes back: undo (its seq) and seq (the decision's).

    ``events``: seq (whole numbers, each once), op; one stack for the whole session, in which every other op is a decision. An undo takes the
    last decision back that is still there, and none where there is none. The stack's height is a running sum less its running
    minimum, worked out in blocks of seq; a decision and the undo that meets its height first belong together. Pairs are found
    inside the blocks, and what is left of those, two rows for each height and block at most, across them.
    """
    e = events.select("seq", F.when(F.col("op") == "undo", -1).otherwise(1).alias("step"), F.floor(F.col("seq") / block).alias("block"))
    inside, so_far = Window.partitionBy("block").orderBy("seq"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("run", F.sum("step").over(inside)).withColumns({"low": F.min("run").over(inside), "low_before": F.min("run").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    blocks = e.groupBy("block").agg(F.sum("step").alias("sum"), F.min("run").alias("least"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("sum").over(so_far), F.lit(0)))
    blocks = blocks.select(F.col("block").alias("_block"), "base", F.least(F.coalesce(F.min(F.col("base") + F.col("least")).over(so_far), F.lit(0)), F.lit(0)).alias("floor"))
    e = e.join(blocks, F.col("block") == F.col("_block"))
    at = F.col("base") + F.col("run")
    now, before = F.least("floor", F.col("base") + F.col("low")), F.least("floor", F.coalesce(F.col("base") + F.col("low_before"), F.col("floor")))
    e = e.where((F.col("step") == 1) | (at >= before)).select("seq", "step", "block", (at - now + F.when(F.col("step") == -1, 1).otherwise(0)).alias("height"))

    def paired(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy(*by).orderBy("seq")
        d = rows.withColumns({"_next": F.lead("step").over(w), "_undo": F.lead("seq").over(w), "_last": F.lag("step").over(w)})
        met = (F.col("step") == 1) & F.coalesce(F.col("_next") == -1, F.lit(False))
        closed = (F.col("step") == -1) & F.coalesce(F.col("_last") == 1, F.lit(False))
        return d.where(met).select(F.col("_undo").alias("undo"), "seq"), d.where(~met & ~closed).select(*rows.columns)

    own, rest = paired(e, ["block", "height"])
    return own.unionByName(paired(rest, ["height"])[0])


def replay_session(masks: DataFrame, events: DataFrame) -> DataFrame:
    """Decision on each mask after a whole session, in which undo takes back the last decision on any cell: cell, area, approved.

    Undone, a decision's mask and those it cascaded to are unreviewed again. Decisions on masks that are not there do not count. The
    decision that each undo means is found first (``undone``); then every cell's own events are folded over its masks in an expression,
    where a mask remembers the decision that set it.
    """
    own = masks.select("cell", "area").distinct()
    e = events.where("op in ('approve', 'reject', 'undo')").select("seq", "cell", F.col("area").cast("int").alias("area"), "op")
    decisions = e.where("op <> 'undo'").join(own.withColumn("area", F.col("area").cast("int")), ["cell", "area"], "left_semi")
    pairs = undone(decisions.select("seq", "op").unionByName(e.where("op = 'undo'").select("seq", "op")))
    back = pairs.join(decisions.select("seq", "cell"), "seq").select("cell", F.col("undo").alias("at"), F.lit(0).alias("area"), F.lit(None).cast("boolean").alias("yes"), F.col("seq").alias("of"))
    steps = decisions.select("cell", F.col("seq").alias("at"), "area", (F.col("op") == "approve").alias("yes"), F.col("seq").alias("of")).unionByName(back)
    steps = steps.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "area", "yes", "of"))).alias("steps"))
    state = own.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(F.col("area").cast("int").alias("area"), F.lit(None).cast("boolean").alias("approved"), F.lit(None).cast("long").alias("by")))).alias("state"))

    def step(s, e):
        def after(m):
            hit = (m["area"] == e["area"]) | (m["approved"].isNull() & F.when(e["yes"], m["area"] < e["area"]).otherwise(m["area"] > e["area"]))
            taken = e["yes"].isNull() & (m["by"] == e["of"])
            return F.struct(
                m["area"].alias("area"),
                F.when(taken, F.lit(None)).when(e["yes"].isNotNull() & hit, e["yes"]).otherwise(m["approved"]).alias("approved"),
                F.when(taken, F.lit(None)).when(e["yes"].isNotNull() & hit, e["of"].cast("long")).otherwise(m["by"]).alias("by"),
            )

        return F.transform(s, after)

    done = state.join(steps, "cell", "left").select("cell", F.explode(F.when(F.col("steps").isNull(), F.col("state")).otherwise(F.aggregate("steps", F.col("state"), step))).alias("m"))
    return done.select("cell", "m.area", "m.approved")


def review_counts(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Approved, rejected and open masks, and whether all are reviewed."""
    return decisions.groupBy(*(by or [])).agg(F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"), F.count_if(F.col("approved").isNull()).alias("open"), F.bool_and(F.col("approved").isNotNull()).alias("reviewed"))


def next_unreviewed(queue: DataFrame) -> DataFrame:
    """``queue`` (cell, idx, approved) with the next and previous index, clamped, and the next one not reviewed (null: none)."""
    w = Window.partitionBy("cell").orderBy("idx")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    return queue.withColumns({"following": F.coalesce(F.lead("idx").over(w), "idx"), "preceding": F.coalesce(F.lag("idx").over(w), "idx"), "next_open": F.min(F.when(F.col("approved").isNull(), F.col("idx"))).over(later)})


def last_status(status_events: DataFrame) -> DataFrame:
    """Latest status of each image: image_name, status."""
    return status_events.groupBy("image_name").agg(F.max_by("status", "seq").alias("status"))


def to_delete(exported: DataFrame, decisions: DataFrame) -> DataFrame:
    """Exported masks (cell, area) that the final decisions do not approve."""
    return exported.join(decisions.where("approved"), ["cell", "area"], "left_anti")
