"""Operators on ordered machine-command streams (design_id, seq, command, x_mm, y_mm).

``seq`` is 0-based and dense within a design.  Nothing here gathers a whole design in one task:
order-dependent values come from blocks of the order (see ``functions.ordered``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import previous_values, running_totals
from ..functions.scalars import nearest_name
from ..functions.scores import preview_scores
from ..functions.semantics import half_even
from .stream import walk

# Command codes after masking, and their names.
COMMAND_MASK = 0xFF
COMMAND_CODES = {"STITCH": 0, "JUMP": 1, "TRIM": 2, "END": 4, "COLOR_CHANGE": 5}
KNOWN = tuple(COMMAND_CODES)


def is_cmd(name: str) -> Column:
    return F.col("command") == name


def distance(dx, dy) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def with_deltas(commands: DataFrame) -> DataFrame:
    """dx, dy and distance to the previous command of any kind (distance 0 for the first)."""
    df = previous_values(commands, ["design_id"], "seq", {"prev_x": "x_mm", "prev_y": "y_mm"})
    dx, dy = F.col("x_mm") - F.col("prev_x"), F.col("y_mm") - F.col("prev_y")
    return df.withColumns({
        "dx_mm": dx, "dy_mm": dy,
        "distance_mm": F.coalesce(distance(dx, dy), F.lit(0.0)),
        "has_prev": F.col("prev_x").isNotNull(),
    })


def _total(cond: Column, value="distance_mm") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))


def _largest(cond: Column, value="distance_mm") -> Column:
    return F.coalesce(F.max(F.when(cond, F.col(value))), F.lit(0.0))


def execution_metrics(commands: DataFrame, max_stitch_mm: float = 4.0, high_risk_jump_mm: float = 8.0) -> DataFrame:
    """Counts, path lengths, extremes and limit violations per design."""
    d = F.col("distance_mm")
    return with_deltas(commands).groupBy("design_id").agg(
        F.count(F.lit(1)).alias("commands"),
        F.count_if(is_cmd("STITCH")).alias("stitch_count"),
        F.count_if(is_cmd("JUMP")).alias("jump_count"),
        F.count_if(is_cmd("TRIM")).alias("trim_count"),
        F.count_if(is_cmd("COLOR_CHANGE")).alias("color_change_count"),
        F.count_if(~F.col("command").isin(*KNOWN)).alias("unsupported_command_count"),
        F.count_if(is_cmd("STITCH") & (d > max_stitch_mm)).alias("illegal_long_stitch_count"),
        F.count_if(is_cmd("JUMP") & (d >= high_risk_jump_mm)).alias("high_risk_jump_count"),
        half_even(_largest(is_cmd("STITCH")), 4).alias("max_stitch_mm"),
        half_even(_largest(is_cmd("JUMP")), 4).alias("max_jump_mm"),
        half_even(_total(is_cmd("STITCH")), 4).alias("stitch_path_mm"),
        half_even(_total(is_cmd("JUMP")), 4).alias("jump_path_mm"),
    )


def command_counts(commands: DataFrame) -> DataFrame:
    """One count map per design."""
    per = commands.groupBy("design_id", F.lower("command").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("name", "n")))
    return per.groupBy("design_id").agg(F.map_from_entries(entries).alias("command_counts"))


def _by_run(commands: DataFrame, more: dict[str, Column], min_mm: float, max_mm: float) -> DataFrame:
    """design_id, run_id, run_length, closed_and_counted and the aggregates ``more`` (partial ones, over distance_mm) of each run of short stitches.

    A break closes the run of the rows before it, so it belongs to the run numbered one less. Runs are numbered within a block of the stream first; the
    breaks of the blocks before are added then, so a run that crosses a border is one again."""
    dist = F.coalesce(distance(F.col("x_mm") - F.col("prev_x"), F.col("y_mm") - F.col("prev_y")), F.lit(0.0))
    moves = walk(commands).select("design_id", "_blk", "seq", "command", dist.alias("distance_mm"))
    short = is_cmd("STITCH") & F.col("distance_mm").between(min_mm, max_mm)
    moves = moves.withColumns({"short": short, "is_break": ~short & ~is_cmd("END")})
    inside = W.partitionBy("design_id", "_blk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    run = F.sum(F.col("is_break").cast("long")).over(inside) - F.col("is_break").cast("long")
    counted = is_cmd("STITCH") | is_cmd("JUMP") | is_cmd("TRIM")
    part = moves.withColumn("_run", run).groupBy("design_id", "_blk", "_run").agg(
        F.count_if("short").alias("run_length"), F.max(F.when(F.col("is_break"), counted)).alias("closed"), F.count_if("is_break").alias("_breaks"), *(c.alias(k) for k, c in more.items()))
    breaks = part.groupBy("design_id", "_blk").agg(F.sum("_breaks").alias("_b"))
    past = W.partitionBy("design_id").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    return part.join(breaks.select("design_id", "_blk", F.coalesce(F.sum("_b").over(past), F.lit(0)).alias("_before")), ["design_id", "_blk"]).withColumn("run_id", F.col("_run") + F.col("_before"))


def lock_tack_runs(commands: DataFrame, min_mm: float = 0.05, max_mm: float = 1.2, min_run: int = 3) -> DataFrame:
    """Runs of at least ``min_run`` short stitches per design.

    END leaves a run untouched.  A run closed by a color change or an unsupported command is not
    counted; one closed by a longer stitch, a jump, a trim or the end of the stream is.
    """
    return execution_report(commands, min_mm=min_mm, max_mm=max_mm, min_run=min_run).select("design_id", "lock_tack_like_count")


def execution_report(commands: DataFrame, max_stitch_mm: float = 4.0, high_risk_jump_mm: float = 8.0, min_mm: float = 0.05, max_mm: float = 1.2, min_run: int = 3) -> DataFrame:
    """:func:`execution_metrics`, the count map and the short runs in one pass: every command belongs to a run, and runs add up to designs."""
    d = F.col("distance_mm")
    counts = {f"n_{k}": F.count_if(is_cmd(k)) for k in KNOWN} | {"commands": F.count(F.lit(1)), "illegal": F.count_if(is_cmd("STITCH") & (d > max_stitch_mm)), "risky": F.count_if(is_cmd("JUMP") & (d >= high_risk_jump_mm))}
    most = {"most_stitch": F.max(F.when(is_cmd("STITCH"), d)), "most_jump": F.max(F.when(is_cmd("JUMP"), d))}
    sums = {"path_stitch": F.sum(F.when(is_cmd("STITCH"), d)), "path_jump": F.sum(F.when(is_cmd("JUMP"), d))}
    runs = _by_run(commands, counts | most | sums, min_mm, max_mm).groupBy("design_id", "run_id").agg(
        F.sum("run_length").alias("run_length"), F.coalesce(F.max("closed"), F.lit(True)).alias("closed"), *(F.sum(k).alias(k) for k in counts | sums), *(F.max(k).alias(k) for k in most))
    g = runs.groupBy("design_id").agg(F.count_if((F.col("run_length") >= min_run) & F.col("closed")).alias("lock_tack_like_count"), *(F.sum(k).alias(k) for k in counts | sums), *(F.max(k).alias(k) for k in most))
    zero = lambda c: half_even(F.coalesce(c, F.lit(0.0)), 4)
    return g.select(
        "design_id", "commands", F.col("n_STITCH").alias("stitch_count"), F.col("n_JUMP").alias("jump_count"), F.col("n_TRIM").alias("trim_count"),
        F.col("n_COLOR_CHANGE").alias("color_change_count"), (F.col("commands") - sum((F.col(f"n_{k}") for k in KNOWN), F.lit(0))).alias("unsupported_command_count"),
        F.col("illegal").alias("illegal_long_stitch_count"), F.col("risky").alias("high_risk_jump_count"), zero("most_stitch").alias("max_stitch_mm"), zero("most_jump").alias("max_jump_mm"),
        zero("path_stitch").alias("stitch_path_mm"), zero("path_jump").alias("jump_path_mm"), "lock_tack_like_count")


def full_execution_report(commands: DataFrame, off_mask: DataFrame, mask_path: Column | None = None, target_width_mm: float = 25.6, max_stitch_mm: float = 4.0,
                          high_risk_jump_mm: float = 8.0, visible_min_mm: float = 1.5, visible_ratio: float = 0.65) -> DataFrame:
    """All 25 columns of a design's report: the metrics in one pass, the count map, and what lies off the mask, with the limits they were taken at.

    ``off_mask``: the share of each stitch outside the mask (``pixels.off_mask_stitches``); a design without any has none."""
    from .pixels import visible_connectors
    seen = visible_connectors(off_mask, visible_min_mm, visible_ratio)
    report = execution_report(commands, max_stitch_mm, high_risk_jump_mm).join(command_counts(commands), "design_id").join(seen, "design_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in seen.dtypes if c != "design_id"}
    return report.withColumns(zero | {
        "round_trip_parse_success": F.lit(True), "mask_path": F.coalesce(mask_path, F.lit("")) if mask_path is not None else F.lit(""), "target_width_mm": F.lit(target_width_mm),
        "max_stitch_threshold_mm": F.lit(max_stitch_mm), "high_risk_jump_threshold_mm": F.lit(high_risk_jump_mm), "visible_connector_min_mm": F.lit(visible_min_mm),
        "visible_connector_off_mask_ratio": F.lit(visible_ratio)})


def design_metrics(commands: DataFrame, trim_mm: float = 6.0, high_risk_mm: float = 12.0) -> DataFrame:
    """Segment counts and distances; the first command has no segment."""
    d, prev = F.col("distance_mm"), F.col("has_prev")
    stitch, jump = is_cmd("STITCH") & prev, is_cmd("JUMP") & prev
    return with_deltas(commands).groupBy("design_id").agg(
        F.count_if(stitch).alias("stitch_segments"),
        F.count_if(jump).alias("jump_segments"),
        F.count_if(is_cmd("COLOR_CHANGE")).alias("color_changes"),
        half_even(_total(stitch), 3).alias("stitch_distance_mm"),
        half_even(_total(jump), 3).alias("jump_distance_mm"),
        half_even(_largest(jump), 3).alias("max_jump_mm"),
        F.count_if(jump & (d >= trim_mm)).alias("estimated_trim_jumps"),
        F.count_if(jump & (d >= high_risk_mm)).alias("high_risk_jumps"),
    )


def vector_continuity(commands: DataFrame, max_stitch_mm: float = 4.0, high_risk_mm: float = 8.0,
                      near_mm: float = 2.5) -> DataFrame:
    """Continuity score with its violation counts."""
    d, prev = F.col("distance_mm"), F.col("has_prev")
    stitch, jump = is_cmd("STITCH") & prev, is_cmd("JUMP") & prev
    agg = with_deltas(commands).groupBy("design_id").agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_if(stitch).alias("stitch_vectors"),
        F.count_if(jump).alias("jump_vectors"),
        F.count_if(is_cmd("TRIM")).alias("trim_count"),
        F.count_if(is_cmd("COLOR_CHANGE")).alias("color_changes"),
        half_even(_largest(stitch), 3).alias("max_stitch_mm"),
        half_even(_largest(jump), 3).alias("max_jump_mm"),
        F.count_if(stitch & (d > max_stitch_mm)).alias("illegal_long_stitch_count"),
        F.count_if(jump & (d > high_risk_mm)).alias("high_risk_jump_count"),
        F.count_if(jump & (d <= high_risk_mm) & (d <= near_mm)).alias("near_jump_candidate_count"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(F.lit(0.0))

    score = (1.0 - share("illegal_long_stitch_count", "stitch_vectors")
             - 0.35 * share("high_risk_jump_count", "jump_vectors")
             - 0.15 * share("near_jump_candidate_count", "jump_vectors"))
    return agg.withColumn("continuity_score", half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def continuity_examples(commands: DataFrame, max_stitch_mm: float = 4.0, high_risk_mm: float = 8.0,
                        near_mm: float = 2.5, per_kind: int = 20) -> DataFrame:
    """The first ``per_kind`` violating vectors of each kind per design, in stream order."""
    d = F.col("distance_mm")
    kind = (
        F.when(is_cmd("STITCH") & (d > max_stitch_mm), "illegal_long_stitch")
        .when(is_cmd("JUMP") & (d > high_risk_mm), "high_risk_jump")
        .when(is_cmd("JUMP") & (d <= near_mm), "near_jump_candidate")
    )
    hits = with_deltas(commands).filter("has_prev").withColumn("kind", kind).filter(F.col("kind").isNotNull())
    rank = F.row_number().over(W.partitionBy("design_id", "kind").orderBy("seq")).cast("long")
    return (
        hits.withColumn("example_no", rank).filter(F.col("example_no") <= per_kind)
        .select("design_id", "kind", "example_no", (F.col("seq") - 1).alias("i0"), F.col("seq").alias("i1"),
                "dx_mm", "dy_mm", "distance_mm")
    )


def movement_stats(commands: DataFrame) -> DataFrame:
    """Bounding box over all points; moves measured between consecutive stitches and jumps only."""
    box = commands.groupBy("design_id").agg(
        half_even(F.max("x_mm") - F.min("x_mm"), 3).alias("width_mm"),
        half_even(F.max("y_mm") - F.min("y_mm"), 3).alias("height_mm"),
        F.count(F.lit(1)).alias("command_count"),
        *[F.count_if(is_cmd(c)).alias(n) for c, n in (
            ("STITCH", "stitch_commands"), ("JUMP", "jump_commands"), ("TRIM", "trim_commands"),
            ("COLOR_CHANGE", "color_changes"), ("END", "end_commands"))],
    )
    step = distance(F.col("x_mm") - F.col("move_x"), F.col("y_mm") - F.col("move_y"))
    moves = walk(commands).filter(is_cmd("STITCH") | is_cmd("JUMP")).withColumn("distance_mm", F.coalesce(step, F.lit(0.0)))
    steps = moves.groupBy("design_id").agg(
        F.max("distance_mm").alias("m"), _total(is_cmd("JUMP")).alias("j"))
    return box.join(steps, "design_id", "left").select(
        *box.columns,
        half_even(F.coalesce("m", F.lit(0.0)), 3).alias("max_move_mm"),
        half_even(F.coalesce("j", F.lit(0.0)), 3).alias("total_jump_mm"))


def segments_of(walked: DataFrame) -> DataFrame:
    """The segments of walked commands, with what lies between a segment and the one before and with the design's totals."""
    length = F.coalesce(distance(F.col("x_mm") - F.col("prev_x"), F.col("y_mm") - F.col("prev_y")), F.lit(0.0))
    return walked.filter("is_segment").select(
        "design_id", "segment_id", (F.col("color_no") + 1).alias("color_layer"), F.col("seq").alias("source_order"),
        F.col("prev_x").alias("entry_x_mm"), F.col("prev_y").alias("entry_y_mm"),
        F.col("x_mm").alias("exit_x_mm"), F.col("y_mm").alias("exit_y_mm"), length.alias("length_mm"),
        "seg_x", "seg_y", "seg_color", "n_between", "n_trim", "n_color_change", "n_segments", "min_x", "max_x", "min_y", "max_y")


def build_segments(commands: DataFrame) -> DataFrame:
    """One row per stitch that has a predecessor, with its color layer and position."""
    return segments_of(walk(commands)).select("design_id", "segment_id", "color_layer", "source_order", "entry_x_mm", "entry_y_mm", "exit_x_mm", "exit_y_mm", "length_mm")


def preceding_commands(commands: DataFrame) -> DataFrame:
    """The commands other than STITCH ahead of each stitch, one row per command in order.

    ``stitch_no`` counts the stitches of the design from 1; ``position`` counts from 1 within the gap.
    """
    numbered = running_totals(commands, ["design_id"], "seq", {"stitches": is_cmd("STITCH").cast("long")})
    closed = numbered.groupBy("design_id").agg(F.max("stitches").alias("last_stitch"))
    first = numbered.filter(is_cmd("STITCH")).select(
        "design_id", (F.col("stitches")).alias("_gap"), F.col("seq").alias("_start"))
    between = numbered.filter(~is_cmd("STITCH")).join(closed, "design_id").filter(
        F.col("stitches") < F.col("last_stitch")).withColumn("_gap", F.col("stitches"))
    return between.join(first, ["design_id", "_gap"], "left").select(
        "design_id", (F.col("_gap") + 1).alias("stitch_no"), "seq",
        (F.col("seq") - F.coalesce("_start", F.lit(-1))).alias("position"), "command")


def event_labels(near_mm: float = 2.5, long_mm: float = 8.0) -> dict[str, Column]:
    """Gap to the segment before and its overlapping labels, as columns over :func:`segments_of`."""
    gap = distance(F.col("entry_x_mm") - F.col("seg_x"), F.col("entry_y_mm") - F.col("seg_y"))
    same = F.col("seg_color") == F.col("color_layer")
    return {"same_color": same, "distance_mm": half_even(gap, 4), "near_connect_label": same & (gap <= near_mm), "long_jump_label": gap >= long_mm,
            "trim_label": F.col("n_trim") > 0, "color_change_label": (F.col("n_color_change") > 0) | ~same}


def path_events(segments: DataFrame, near_mm: float = 2.5, long_mm: float = 8.0) -> DataFrame:
    """Gap between consecutive segments with overlapping labels (``segments`` from :func:`segments_of`)."""
    labels = event_labels(near_mm, long_mm)
    return segments.filter(F.col("seg_x").isNotNull()).select(
        "design_id", (F.col("segment_id") - 1).alias("from_segment"), F.col("segment_id").alias("to_segment"),
        labels["same_color"].alias("same_color"), labels["distance_mm"].alias("distance_mm"), F.col("n_between").alias("commands_between"),
        *(labels[f"{k}_label"].alias(f"{k}_label") for k in ("near_connect", "long_jump", "trim", "color_change")))


def closure_gaps(segments: DataFrame, gap_mm: float = 6.0, min_segments: int = 4, extra: tuple[str, ...] = ()) -> DataFrame:
    """Colors whose last exit is far from their first entry; ``extra`` names columns x0, y0, x1, y1 of the ends to carry along."""
    more = [F.col(c) for c in extra]
    ends = segments.groupBy("design_id", "color_layer").agg(
        F.min_by(F.struct("segment_id", F.col("entry_x_mm").alias("x"), F.col("entry_y_mm").alias("y"), *more), "segment_id").alias("a"),
        F.max_by(F.struct("segment_id", F.col("exit_x_mm").alias("x"), F.col("exit_y_mm").alias("y"), *more), "segment_id").alias("b"),
        F.count(F.lit(1)).alias("segments"))
    gap = distance(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return ends.filter((gap >= gap_mm) & (F.col("segments") >= min_segments)).select(
        "design_id", "color_layer", F.col("b.segment_id").alias("from_segment"),
        F.col("a.segment_id").alias("to_segment"), half_even(gap, 4).alias("distance_mm"), "segments",
        F.lit(True).alias("closure_gap_label"), *(F.col(f"a.{c}").alias(c) for c in extra[:2]), *(F.col(f"b.{c}").alias(c) for c in extra[2:]))


def with_closures(events: DataFrame, closures: DataFrame) -> DataFrame:
    """The events of a stream and, after them, a row for each closure gap; ``commands`` says which of the two a row is."""
    rows = closures.select("design_id", "from_segment", "to_segment", F.lit(True).alias("same_color"), "distance_mm", "color_layer", "closure_gap_label", F.lit("CLOSURE_CHECK").alias("commands"))
    return events.withColumns({"commands": F.lit("STREAM"), "closure_gap_label": F.lit(False)}).unionByName(rows, allowMissingColumns=True)


def continuity_edges(segments: DataFrame, connect_px: Column, long_px: Column) -> DataFrame:
    """Exclusive label per consecutive pair: near, else long, else color change.

    ``segments`` carries entry/exit in pixels (entry_x .. exit_y); the limits may vary by design.
    """
    located = segments.withColumns({"_pos": F.col("segment_id") - 1, "_near": connect_px, "_long": long_px})
    pairs = previous_values(located, ["design_id"], "_pos", {"p_color": "color_layer", "p_x": "exit_x", "p_y": "exit_y"})
    gap = distance(F.col("entry_x") - F.col("p_x"), F.col("entry_y") - F.col("p_y"))
    same = F.col("p_color") == F.col("color_layer")
    label = (F.when(same & (gap <= F.col("_near")), "near_connect").when(gap >= F.col("_long"), "long_jump")
             .when(~same, "color_change").otherwise("none"))
    return pairs.filter(F.col("p_x").isNotNull()).select(
        "design_id", F.col("segment_id").alias("to_segment"), gap.alias("gap_px"), label.alias("edge_label"))


def continuity_totals(edges: DataFrame) -> DataFrame:
    per_design = edges.groupBy("design_id").agg(
        (F.count(F.lit(1)) + 1).alias("segments"),
        *[F.count_if(F.col("edge_label") == k).alias(f"{k}_edges") for k in ("near_connect", "long_jump", "color_change")])
    return per_design


def entry_exit_by_color(segments: DataFrame, x0="entry_x_mm", y0="entry_y_mm", x1="exit_x_mm", y1="exit_y_mm",
                        min_length: float = 1e-6) -> DataFrame:
    length = distance(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    index = F.col("segment_id") - 1
    return segments.filter(length >= min_length).groupBy("design_id", "color_layer").agg(
        half_even(F.min_by(x0, index), 3).alias("entry_x"), half_even(F.min_by(y0, index), 3).alias("entry_y"),
        half_even(F.max_by(x1, index), 3).alias("exit_x"), half_even(F.max_by(y1, index), 3).alias("exit_y"),
        F.min(index).alias("segment_start"), F.max(index).alias("segment_end"))


def sequence_windows(commands: DataFrame, seq_len: int = 4, delta_scale: float = 1.0,
                     vocabulary: tuple[str, ...] = KNOWN) -> DataFrame:
    """Sliding windows of scaled steps and command ids with the next step as target.

    Each step is sent to the ``seq_len + 1`` windows it takes part in, so windows are independent groups.
    """
    ids = F.lit(len(vocabulary))
    for i, name in reversed(list(enumerate(vocabulary))):
        ids = F.when(is_cmd(name), F.lit(i)).otherwise(ids)
    steps = with_deltas(commands).filter("has_prev").select(
        "design_id", "seq", (F.col("dx_mm") / delta_scale).alias("dx"), (F.col("dy_mm") / delta_scale).alias("dy"),
        ids.alias("command_id"))
    uses = steps.withColumn("target_seq", F.explode(F.sequence(F.col("seq"), F.col("seq") + seq_len)))
    step = F.struct("seq", "dx", "dy", "command_id")
    is_target = F.col("seq") == F.col("target_seq")
    grouped = uses.groupBy("design_id", "target_seq").agg(
        F.array_sort(F.collect_list(F.when(~is_target, step))).alias("window"),
        F.max(F.when(is_target, step)).alias("target"))
    full = grouped.filter((F.size("window") == seq_len) & F.col("target").isNotNull())
    width = len(vocabulary) + 1
    one_hot = lambda e: F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                    lambda i: F.when(i == e["command_id"], F.lit(1.0)).otherwise(F.lit(0.0)))
    features = F.flatten(F.transform("window", lambda e: F.concat(F.array(e["dx"], e["dy"]), one_hot(e))))
    return full.select("design_id", "target_seq", features.alias("features"), F.col("target.dx").alias("target_dx"),
                       F.col("target.dy").alias("target_dy"), F.col("target.command_id").alias("target_command"))


def stitch_texture_metrics(commands: DataFrame, bins: int = 18, short_mm: float = 0.8, long_mm: float = 4.0, bin_mm: float = 0.1) -> DataFrame:
    """Length, angle and density statistics of the stitches of each design.

    Stitches are counted by length and angle bin once; all else comes from these counts. For the exact median, the totals of length bins show which bins
    hold its ranks (every design keeps at least one row, with its sums), and only the lengths of those are ordered."""
    angle = F.pmod(F.atan2("dy_mm", "dx_mm"), F.lit(math.pi))
    binned = F.least(F.lit(bins - 1), F.floor(F.pmod(angle, F.lit(math.pi)) / F.lit(math.pi) * bins).cast("int"))
    used = is_cmd("STITCH") & F.col("has_prev") & (F.col("distance_mm") > 1e-6)
    moves = with_deltas(commands).select("design_id", "command", F.when(used, F.col("distance_mm")).alias("v"), F.when(used, binned).alias("angle"), "x_mm", "y_mm", "prev_x", "prev_y")
    seen = lambda c: F.when(F.col("v").isNotNull(), F.col(c))
    kinds = ("STITCH", "JUMP", "TRIM")
    box = {f"{n}_{c}": agg(seen(c)) for c in ("x_mm", "y_mm", "prev_x", "prev_y") for n, agg in (("min", F.min), ("max", F.max))}
    cells = moves.groupBy("design_id", "v", "angle").agg(F.count("v").alias("c"), *(F.count_if(is_cmd(k)).alias(k) for k in kinds), *(x.alias(k) for k, x in box.items()))
    cells = cells.withColumn("_bin", F.floor(F.col("v") / bin_mm).cast("long"))

    v, c = F.col("v"), F.col("c")
    sums = {"n": F.sum(c), "total": F.sum(v * c), "squares": F.sum(v * v * c), "n_short": F.sum(F.when(v < short_mm, c)), "n_long": F.sum(F.when(v > long_mm, c))}
    sums |= {k: F.sum(k) for k in kinds} | {f"a{i}": F.sum(F.when(F.col("angle") == i, c)) for i in range(bins)}
    ends = {k: (F.min if k.startswith("min") else F.max)(k) for k in box}
    per_bin = cells.groupBy("design_id", "_bin").agg(*(x.alias(k) for k, x in (sums | ends).items()))
    whole, along = W.partitionBy("design_id"), W.partitionBy("design_id").orderBy("_bin")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    wide = per_bin.select("design_id", "_bin", F.col("n").alias("_c"), F.sum("n").over(upto).alias("_end"), F.row_number().over(along).alias("_row"),
                          *(F.sum(k).over(whole).alias(k) for k in sums), *((F.min if k.startswith("min") else F.max)(k).over(whole).alias(k) for k in ends))
    # Ranks of the two middle lengths, from 0; a design without stitches keeps its first row.
    low, high = F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long")
    holds = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))
    wanted = wide.withColumns({"_low": low, "_high": high}).filter(F.when(F.col("n") > 0, holds(F.col("_low")) | holds(F.col("_high"))).otherwise(F.col("_row") == 1))
    lengths = cells.groupBy("design_id", "_bin", "v").agg(F.sum("c").alias("_k"))
    inner = W.partitionBy("design_id", "_bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    # Null-safe keys add no filter to one side, so that both read the same shuffle of the rows.
    lengths = lengths.select(F.col("design_id").alias("_d"), F.col("_bin").alias("_b"), "v", "_k")
    met = wanted.join(lengths, wanted["design_id"].eqNullSafe(lengths["_d"]) & wanted["_bin"].eqNullSafe(lengths["_b"]), "left").withColumn("_upto", F.col("_end") - F.col("_c") + F.sum("_k").over(inner))
    at = lambda rank: F.max(F.when((F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_k")), v))
    g = met.groupBy("design_id").agg(((at("_low") + at("_high")) / 2).alias("median"), *(F.first(k).alias(k) for k in (*sums, *ends)))

    n = F.greatest(F.lit(1), F.col("n"))
    span = lambda c: F.greatest(f"max_{c}", f"max_prev_{c[0]}") - F.least(f"min_{c}", f"min_prev_{c[0]}")
    g = g.withColumns({"w": span("x_mm"), "h": span("y_mm"), "mean": F.when(F.col("n") > 0, F.col("total") / F.col("n"))})
    shares = F.transform(F.array(*(F.coalesce(f"a{i}", F.lit(0)) for i in range(bins))), lambda x: x / n)
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log(p)) / math.log(bins)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - F.col("mean") ** 2))
    area = F.coalesce(F.greatest(F.lit(1e-6), F.col("w") * F.col("h")), F.lit(1e-6))
    r8 = lambda c, name: half_even(F.coalesce(c, F.lit(0.0)), 8).alias(name)
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return g.select(
        "design_id", count("n").alias("stitch_segment_count"), F.col("STITCH").alias("stitch_command_count"), F.col("JUMP").alias("jump_count"), F.col("TRIM").alias("trim_count"),
        r8(F.col("w"), "bbox_width_mm"), r8(F.col("h"), "bbox_height_mm"), r8(area, "bbox_area_mm2"),
        r8(F.col("total"), "stitch_path_mm"), r8(F.col("mean"), "mean_stitch_length_mm"), r8(F.col("median"), "median_stitch_length_mm"),
        r8(sd / F.greatest(F.lit(1e-6), F.col("mean")), "stitch_length_cv"), r8(count("n_short") / n, "short_stitch_ratio"), r8(count("n_long") / n, "long_stitch_ratio"),
        r8(entropy, "angle_entropy"), r8(F.array_max(shares), "dominant_angle_mass"),
        r8(100.0 * F.col("n") / area, "stitch_density_per_100mm2"), r8(100.0 * F.coalesce("total", F.lit(0.0)) / area, "path_density_per_100mm2"))


def preview_texture(texture: DataFrame) -> DataFrame:
    """Texture metrics with the preview sub-scores; absent inputs count as 0."""
    needed = ("coverage_ratio", "stitch_precision_ratio", "adaptive_stitch_precision_ratio", "generator_texture_score",
              "visible_connector_count", "off_mask_stitch_length_mm", "illegal_long_stitch_count")
    filled = texture.withColumns({n: F.lit(None).cast("double") for n in needed if n not in texture.columns}) \
        if any(n not in texture.columns for n in needed) else texture
    return filled.withColumns(preview_scores())


def polyline_stats(points: DataFrame, keys: list[str], seq: str = "seq", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Length, bounding box, end points and point count of each polyline given as point rows."""
    stepped = previous_values(points, keys, seq, {"_px": x, "_py": y})
    step = F.coalesce(distance(F.col(x) - F.col("_px"), F.col(y) - F.col("_py")), F.lit(0.0))
    return stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"), F.sum(step).alias("length_mm"),
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"),
        F.min_by(x, seq).alias("start_x"), F.min_by(y, seq).alias("start_y"),
        F.max_by(x, seq).alias("end_x"), F.max_by(y, seq).alias("end_y"))


def split_long_moves(commands: DataFrame, max_stitch_mm: float = 4.0, max_jump_mm: float = 12.0,
                     trim_at_mm: float = 6.0) -> DataFrame:
    """Cut stitches and jumps into equal steps on the 0.1 mm grid; long jumps get a trim first."""
    moves = with_deltas(commands).filter("has_prev").filter(is_cmd("STITCH") | is_cmd("JUMP")).filter(
        F.col("distance_mm") > 1e-6)
    limit = F.when(is_cmd("STITCH"), F.lit(max(0.1, max_stitch_mm))).otherwise(F.lit(max(0.1, max_jump_mm)))
    steps = F.greatest(F.lit(1), F.ceil(F.col("distance_mm") / limit).cast("int"))
    trims = is_cmd("JUMP") & F.lit(trim_at_mm > 0.0) & (F.col("distance_mm") >= trim_at_mm)
    first = F.when(trims, F.lit(0)).otherwise(F.lit(1))
    grid = lambda a, b, t: F.rint((F.col(a) + (F.col(b) - F.col(a)) * t) * 10.0).cast("long")
    t = F.col("step") / F.col("steps")
    return (
        moves.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(first, F.col("steps"))))
        .select("design_id", F.col("seq").alias("source_seq"), "step",
                F.when(F.col("step") == 0, F.lit("TRIM")).otherwise(F.col("command")).alias("command"),
                grid("prev_x", "x_mm", t).alias("x_tenth_mm"), grid("prev_y", "y_mm", t).alias("y_tenth_mm"))
    )


def drop_collinear(points: DataFrame, keys: list[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Keep the ends of a grid path and the points where its direction changes."""
    back = previous_values(points, keys, seq, {"_px": x, "_py": y})
    lead_in = back.withColumns({"_dx": F.signum(F.col(x) - F.col("_px")), "_dy": F.signum(F.col(y) - F.col("_py"))})
    # The direction after a point is the direction stored on its successor: walk the order backwards.
    last = points.groupBy(*keys).agg(F.max(seq).alias("_last"))
    flipped = lead_in.join(last, keys).withColumn("_rev", F.col("_last") - F.col(seq))
    both = previous_values(flipped, keys, "_rev", {"_nx": "_dx", "_ny": "_dy"})
    turning = (F.col("_dx") != F.col("_nx")) | (F.col("_dy") != F.col("_ny"))
    ends = (F.col(seq) == 0) | (F.col(seq) == F.col("_last"))
    return both.filter(ends | turning).select(*points.columns)


def thread_palette(blocks: DataFrame, color_names: dict[tuple[int, int, int], str]) -> DataFrame:
    """One row per thread color in order of first use.

    ``blocks``: design_id, block_no, color_index, r, g, b, stitch_count.
    """
    per = blocks.groupBy("design_id", "color_index").agg(
        F.min("block_no").alias("first_block"), F.min_by(F.struct("r", "g", "b"), "block_no").alias("rgb"),
        F.count(F.lit(1)).alias("region_count"), F.sum("stitch_count").alias("stitch_count"))
    order = F.row_number().over(W.partitionBy("design_id").orderBy("first_block"))
    r, g, b = F.col("rgb.r"), F.col("rgb.g"), F.col("rgb.b")
    return per.select(
        "design_id", order.alias("thread_order"), "color_index",
        F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int")).alias("hex"),
        nearest_name(r, g, b, color_names).alias("approx_color_name"), "region_count", "stitch_count")


def sequence_cost(polylines: DataFrame, long_jump_mm: float = 8.0, long_jump_weight: float = 0.45,
                  trim_at_mm: float = 10.0, trim_penalty: float = 4.0, rows: int = 4096,
                  extra_forward: Column | None = None, extra_reverse: Column | None = None) -> DataFrame:
    """Total transition cost of a given order of polylines, each entered at its cheaper end.

    ``polylines``: route_id, position (dense from 0), start_x, start_y, end_x, end_y; the walk starts at the
    origin.  The free end of a polyline depends only on the end it was entered by, so a block of positions
    reduces to a table of (way the previous one was left) -> (cost, way this block is left), and the blocks
    chain.  ``extra_forward`` / ``extra_reverse`` add link terms such as off-mask cost.
    """
    p = previous_values(polylines, ["route_id"], "position", {
        "_sx": "start_x", "_sy": "start_y", "_ex": "end_x", "_ey": "end_y"})

    def step(px: Column, py: Column) -> Column:
        def link(tx: str, ty: str, extra: Column | None, way: int) -> Column:
            d = distance(F.col(tx) - px, F.col(ty) - py)
            cost = (d + long_jump_weight * F.greatest(F.lit(0.0), d - long_jump_mm)
                    + F.when(d >= trim_at_mm, F.lit(float(trim_penalty))).otherwise(F.lit(0.0)))
            return F.struct((cost + extra if extra is not None else cost).alias("cost"), F.lit(way).alias("way"))
        return F.least(link("start_x", "start_y", extra_forward, 0), link("end_x", "end_y", extra_reverse, 1))

    # way 0: the previous polyline was left at its end; way 1: it was reversed and left at its start.
    after_end = step(F.coalesce("_ex", F.lit(0.0)), F.coalesce("_ey", F.lit(0.0)))
    after_start = step(F.coalesce("_sx", F.lit(0.0)), F.coalesce("_sy", F.lit(0.0)))
    moves = p.select("route_id", "position", F.array(after_end, after_start).alias("by_way"))

    def chain(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        table = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "by_way"))), lambda e: e["by_way"])
        walk = lambda way: F.aggregate(
            "table", F.struct(F.lit(0.0).alias("cost"), F.lit(way).alias("way")),
            lambda acc, e: F.struct((acc["cost"] + F.get(e, acc["way"])["cost"]).alias("cost"),
                                    F.get(e, acc["way"])["way"].alias("way")))
        return df.groupBy(*keys).agg(table.alias("table"), F.count(F.lit(1)).alias("n")).select(
            *keys, F.array(walk(0), walk(1)).alias("by_way"))

    blocked = moves.withColumn("_b", F.floor(F.col("position") / rows).cast("long"))
    per_block = chain(blocked, ["route_id", "_b"], "position")
    per_super = chain(per_block.withColumn("_s", F.floor(F.col("_b") / rows).cast("long")), ["route_id", "_s"], "_b")
    counts = polylines.groupBy("route_id").agg(F.count(F.lit(1)).alias("polylines"))
    return chain(per_super, ["route_id"], "_s").join(counts, "route_id").select(
        "route_id", "polylines", F.get("by_way", F.lit(0))["cost"].alias("total_cost"))
