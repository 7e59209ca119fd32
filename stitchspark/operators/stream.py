"""One pass over ordered command streams: what each command has to know of the commands before it.

A design is cut into blocks of its order. A block is summed up as its last command, its totals, the last stitch, move and segment in it and the box of
its segments; these summaries are combined over the blocks of a design, in order, and joined to the rows of the next block. So one shuffle of the rows
serves all derived columns, whatever a design's size, and totals of the whole design come with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import BLOCK_ROWS, block_number

_COUNTS = ("color", "stitch", "trim", "other", "move", "segment")


def _is(name: str) -> Column:
    return F.col("command") == name


def _add(point: Column, offsets: tuple[str, ...]) -> Column:
    """A carried point of a block with its counts raised by those of the blocks before."""
    fields = {"x": point["x"], "y": point["y"]} | {c: point[c] + F.col(f"_o_{c}") for c in offsets}
    return F.when(point.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def walk(commands: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """design_id, seq (dense from 0), command, x_mm, y_mm and, for each command:

    prev_x, prev_y (command before), move_x, move_y (last stitch or jump before), seg_x, seg_y, seg_color (end and color of the last segment before),
    color_no, stitches, move_no, segment_id (running counts, itself included), n_between, n_trim, n_color_change (commands other than stitches since the
    last stitch), is_segment (a stitch that isn't first) and, of the whole design, n_segments, min_x, max_x, min_y, max_y of its segments.
    `_blk` numbers the blocks; later work on (design_id, _blk) needs no further shuffle."""
    is_segment = _is("STITCH") & (F.col("seq") > 0)
    df = commands.select("design_id", "seq", "command", "x_mm", "y_mm", block_number("seq", rows).alias("_blk"))
    by_block = W.partitionBy("design_id", "_blk").orderBy("seq")
    upto, before = by_block.rowsBetween(W.unboundedPreceding, 0), by_block.rowsBetween(W.unboundedPreceding, -1)
    counted = {"color": _is("COLOR_CHANGE"), "stitch": _is("STITCH"), "trim": _is("TRIM"), "other": ~_is("STITCH"), "move": _is("STITCH") | _is("JUMP"), "segment": is_segment}
    df = df.withColumns({"is_segment": is_segment, "_px": F.lag("x_mm").over(by_block), "_py": F.lag("y_mm").over(by_block)}
                        | {f"_n_{c}": F.sum(cond.cast("long")).over(upto) for c, cond in counted.items()})
    here = F.struct(F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), *(F.col(f"_n_{c}").alias(c) for c in _COUNTS))
    marks = {"_stitch": _is("STITCH"), "_move": counted["move"], "_seg": is_segment}
    local = df.withColumns({k: F.last(F.when(cond, here), ignorenulls=True).over(before) for k, cond in marks.items()})

    # Blocks: summed up, then combined in order.
    at_end = lambda cond, row: F.max_by(F.when(cond, row), F.when(cond, F.col("seq")))
    inner = F.col("is_segment") & F.col("_px").isNotNull()
    first = F.col("is_segment") & (F.pmod("seq", F.lit(rows)) == 0)
    blocks = df.groupBy("design_id", "_blk").agg(
        F.max_by(here, "seq").alias("_end"), *(at_end(cond, here).alias(f"_last{k}") for k, cond in marks.items()), F.max(first).alias("_first"),
        *(agg(F.when(F.col("is_segment"), F.col(c))).alias(f"_{n}_{c}") for c in ("x_mm", "y_mm") for n, agg in (("min", F.min), ("max", F.max))),
        *(agg(F.when(inner, F.col(p))).alias(f"_{n}{p}") for p in ("_px", "_py") for n, agg in (("min", F.min), ("max", F.max))))
    along = W.partitionBy("design_id").orderBy("_blk")
    past, whole = along.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("design_id")
    zero = F.lit(0).cast("long")
    blocks = blocks.withColumns({"_p": F.lag("_end").over(along)} | {f"_o_{c}": F.coalesce(F.sum(f"_end.{c}").over(past), zero) for c in _COUNTS})
    box = {}
    for axis, (c, p, end) in {"x": ("x_mm", "_px", "x"), "y": ("y_mm", "_py", "y")}.items():
        entry = F.when(F.col("_first"), F.col(f"_p.{end}"))
        box |= {f"min_{axis}": F.min(F.least(f"_min_{c}", f"_min{p}", entry)).over(whole), f"max_{axis}": F.max(F.greatest(f"_max_{c}", f"_max{p}", entry)).over(whole)}
    carried = blocks.withColumns({f"_c{k}": F.last(_add(F.col(f"_last{k}"), _COUNTS), ignorenulls=True).over(past) for k in marks}
                                 | {"n_segments": F.sum("_end.segment").over(whole)} | box)
    carried = carried.select("design_id", "_blk", "_p", *(f"_o_{c}" for c in _COUNTS), *(f"_c{k}" for k in marks), "n_segments", *box)

    j = local.join(carried, ["design_id", "_blk"])
    border = F.pmod("seq", F.lit(rows)) == 0
    last = {k: F.coalesce(_add(F.col(k), _COUNTS), F.col(f"_c{k}")) for k in marks}
    now = lambda c: F.col(f"_n_{c}") + F.col(f"_o_{c}")
    since = lambda c: now(c) - F.coalesce(last["_stitch"][c], zero)
    return j.select(
        "design_id", "_blk", "seq", "command", "x_mm", "y_mm", "is_segment",
        F.when(border, F.col("_p.x")).otherwise(F.col("_px")).alias("prev_x"), F.when(border, F.col("_p.y")).otherwise(F.col("_py")).alias("prev_y"),
        last["_move"]["x"].alias("move_x"), last["_move"]["y"].alias("move_y"), last["_seg"]["x"].alias("seg_x"), last["_seg"]["y"].alias("seg_y"),
        (last["_seg"]["color"] + 1).alias("seg_color"), now("color").alias("color_no"), now("stitch").alias("stitches"), now("move").alias("move_no"),
        now("segment").alias("segment_id"), since("other").alias("n_between"), since("trim").alias("n_trim"), since("color").alias("n_color_change"),
        "n_segments", *box)
