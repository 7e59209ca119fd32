"""Queries over command streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as ops
from ..operators.stream import walk
from ..functions.scores import unified_score
from ..functions.semantics import half_even
from .fixtures import commands
from .registry import cte, query, r, tidy


def segments_of(spark, sf):
    return ops.segments_of(walk(commands(spark, sf)))


@query("command_deltas", f"SELECT design_id, seq, command, {r('dx_mm', 'dy_mm', 'distance_mm')}, has_prev FROM deltas", "deltas")
def command_deltas(spark, sf):
    return tidy(ops.with_deltas(commands(spark, sf)).select(
        "design_id", "seq", "command", "dx_mm", "dy_mm", "distance_mm", "has_prev"))


cte("execution_metrics", """
SELECT design_id, count(*) AS commands, count_if(command = 'STITCH') AS stitch_count, count_if(command = 'JUMP') AS jump_count,
  count_if(command = 'TRIM') AS trim_count, count_if(command = 'COLOR_CHANGE') AS color_change_count,
  count_if(command NOT IN ('STITCH','JUMP','TRIM','COLOR_CHANGE','END')) AS unsupported_command_count,
  count_if(command = 'STITCH' AND distance_mm > 4.0) AS illegal_long_stitch_count,
  count_if(command = 'JUMP' AND distance_mm >= 8.0) AS high_risk_jump_count,
  round_even(coalesce(max(distance_mm) FILTER (command = 'STITCH'), 0.0), 4) AS max_stitch_mm,
  round_even(coalesce(max(distance_mm) FILTER (command = 'JUMP'), 0.0), 4) AS max_jump_mm,
  round_even(coalesce(sum(distance_mm) FILTER (command = 'STITCH'), 0.0), 4) AS stitch_path_mm,
  round_even(coalesce(sum(distance_mm) FILTER (command = 'JUMP'), 0.0), 4) AS jump_path_mm
FROM deltas GROUP BY 1""", "deltas")


@query("execution_metrics", "SELECT * FROM execution_metrics", "execution_metrics")
def execution_metrics(spark, sf):
    return ops.execution_metrics(commands(spark, sf))


@query("command_counts", """
SELECT design_id, string_agg(name || '=' || n, ',' ORDER BY name) AS counts
FROM (SELECT design_id, lower(command) AS name, count(*) AS n FROM commands GROUP BY 1, 2) GROUP BY 1""", "commands")
def command_counts(spark, sf):
    df = ops.command_counts(commands(spark, sf))
    pairs = F.transform(F.map_entries("command_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.select("design_id", F.array_join(pairs, ",").alias("counts"))


cte("lock_tack", """
SELECT design_id, count_if(n >= 3 AND ok) AS lock_tack_like_count FROM (
  SELECT design_id, breaks_before, count_if(short) AS n,
    coalesce(bool_or(command IN ('STITCH','JUMP','TRIM')) FILTER (brk), true) AS ok
  FROM (SELECT *, coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS breaks_before
        FROM (SELECT *, command = 'STITCH' AND distance_mm BETWEEN 0.05 AND 1.2 AS short,
                NOT (command = 'STITCH' AND distance_mm BETWEEN 0.05 AND 1.2) AND command <> 'END' AS brk FROM deltas))
  GROUP BY 1, 2) GROUP BY 1""", "deltas")


@query("lock_tack_runs", "SELECT * FROM lock_tack", "lock_tack")
def lock_tack_runs(spark, sf):
    return ops.lock_tack_runs(commands(spark, sf))


@query("execution_report", """
SELECT e.*, l.lock_tack_like_count FROM execution_metrics e JOIN lock_tack l USING (design_id)""", "execution_metrics", "lock_tack")
def execution_report(spark, sf):
    return ops.execution_report(commands(spark, sf))


@query("design_metrics", """
SELECT design_id, count_if(command = 'STITCH' AND has_prev) AS stitch_segments, count_if(command = 'JUMP' AND has_prev) AS jump_segments,
  count_if(command = 'COLOR_CHANGE') AS color_changes,
  round_even(coalesce(sum(distance_mm) FILTER (command = 'STITCH'), 0.0), 3) AS stitch_distance_mm,
  round_even(coalesce(sum(distance_mm) FILTER (command = 'JUMP'), 0.0), 3) AS jump_distance_mm,
  round_even(coalesce(max(distance_mm) FILTER (command = 'JUMP'), 0.0), 3) AS max_jump_mm,
  count_if(command = 'JUMP' AND has_prev AND distance_mm >= 6.0) AS estimated_trim_jumps,
  count_if(command = 'JUMP' AND has_prev AND distance_mm >= 12.0) AS high_risk_jumps
FROM deltas GROUP BY 1""", "deltas")
def design_metrics(spark, sf):
    return ops.design_metrics(commands(spark, sf))


@query("vector_continuity", """
SELECT design_id, total_points, s AS stitch_vectors, j AS jump_vectors, trim_count, color_changes, max_stitch_mm, max_jump_mm,
  il AS illegal_long_stitch_count, hr AS high_risk_jump_count, nj AS near_jump_candidate_count,
  round_even(greatest(0.0, least(1.0, 1.0 - CASE WHEN s > 0 THEN least(1.0, il / s) ELSE 0.0 END
    - 0.35 * CASE WHEN j > 0 THEN least(1.0, hr / j) ELSE 0.0 END - 0.15 * CASE WHEN j > 0 THEN least(1.0, nj / j) ELSE 0.0 END)), 4) AS continuity_score
FROM (SELECT design_id, count(*) AS total_points, count_if(command = 'STITCH' AND has_prev) AS s, count_if(command = 'JUMP' AND has_prev) AS j,
  count_if(command = 'TRIM') AS trim_count, count_if(command = 'COLOR_CHANGE') AS color_changes,
  round_even(coalesce(max(distance_mm) FILTER (command = 'STITCH'), 0.0), 3) AS max_stitch_mm,
  round_even(coalesce(max(distance_mm) FILTER (command = 'JUMP'), 0.0), 3) AS max_jump_mm,
  count_if(command = 'STITCH' AND has_prev AND distance_mm > 4.0) AS il, count_if(command = 'JUMP' AND has_prev AND distance_mm > 8.0) AS hr,
  count_if(command = 'JUMP' AND has_prev AND distance_mm <= 2.5) AS nj FROM deltas GROUP BY 1)""", "deltas")
def vector_continuity(spark, sf):
    return ops.vector_continuity(commands(spark, sf))


@query("continuity_examples", f"""
SELECT design_id, kind, row_number() OVER (PARTITION BY design_id, kind ORDER BY seq) AS example_no, seq - 1 AS i0, seq AS i1,
  {r('dx_mm', 'dy_mm', 'distance_mm')}
FROM (SELECT *, CASE WHEN command = 'STITCH' AND distance_mm > 4.0 THEN 'illegal_long_stitch'
  WHEN command = 'JUMP' AND distance_mm > 8.0 THEN 'high_risk_jump' WHEN command = 'JUMP' AND distance_mm <= 2.5 THEN 'near_jump_candidate' END AS kind
  FROM deltas WHERE has_prev) WHERE kind IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY design_id, kind ORDER BY seq) <= 20""", "deltas")
def continuity_examples(spark, sf):
    return tidy(ops.continuity_examples(commands(spark, sf)))


@query("movement_stats", """
SELECT * FROM (SELECT design_id, round_even(max(x_mm) - min(x_mm), 3) AS width_mm, round_even(max(y_mm) - min(y_mm), 3) AS height_mm,
  count(*) AS command_count, count_if(command = 'STITCH') AS stitch_commands, count_if(command = 'JUMP') AS jump_commands,
  count_if(command = 'TRIM') AS trim_commands, count_if(command = 'COLOR_CHANGE') AS color_changes, count_if(command = 'END') AS end_commands
  FROM commands GROUP BY 1)
JOIN (SELECT design_id, round_even(coalesce(max(d), 0.0), 3) AS max_move_mm, round_even(coalesce(sum(d) FILTER (command = 'JUMP'), 0.0), 3) AS total_jump_mm
  FROM (SELECT *, sqrt((x_mm - lag(x_mm) OVER w) * (x_mm - lag(x_mm) OVER w) + (y_mm - lag(y_mm) OVER w) * (y_mm - lag(y_mm) OVER w)) AS d
        FROM commands WHERE command IN ('STITCH', 'JUMP') WINDOW w AS (PARTITION BY design_id ORDER BY seq)) GROUP BY 1) USING (design_id)""", "commands")
def movement_stats(spark, sf):
    return ops.movement_stats(commands(spark, sf))


@query("build_segments", f"""
SELECT design_id, segment_id, color_layer, source_order, {r('entry_x_mm', 'entry_y_mm', 'exit_x_mm', 'exit_y_mm', 'length_mm')} FROM segments""", "segments")
def build_segments(spark, sf):
    return tidy(ops.build_segments(commands(spark, sf)))


cte("gap_numbers", """
SELECT *, CAST(coalesce(sum(CASE WHEN command = 'STITCH' THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gap FROM commands""", "commands")


@query("preceding_commands", """
SELECT design_id, gap + 1 AS stitch_no, seq, row_number() OVER (PARTITION BY design_id, gap ORDER BY seq) AS position, command
FROM (SELECT *, bool_or(command = 'STITCH') OVER (PARTITION BY design_id, gap) AS closed FROM gap_numbers) WHERE closed AND command <> 'STITCH'""", "gap_numbers")
def preceding_commands(spark, sf):
    return ops.preceding_commands(commands(spark, sf))


cte("path_events", """
SELECT design_id, p_id AS from_segment, segment_id AS to_segment, p_color = color_layer AS same_color, round_even(gap_mm, 4) AS distance_mm,
  n_between AS commands_between, p_color = color_layer AND gap_mm <= 2.5 AS near_connect_label, gap_mm >= 8.0 AS long_jump_label,
  n_trim > 0 AS trim_label, n_cc > 0 OR p_color <> color_layer AS color_change_label
FROM (SELECT *, sqrt((entry_x_mm - p_x) * (entry_x_mm - p_x) + (entry_y_mm - p_y) * (entry_y_mm - p_y)) AS gap_mm FROM (
  SELECT s.*, g.*, lag(segment_id) OVER w AS p_id, lag(color_layer) OVER w AS p_color, lag(exit_x_mm) OVER w AS p_x, lag(exit_y_mm) OVER w AS p_y
  FROM segments s JOIN (SELECT design_id AS did, max(seq) FILTER (command = 'STITCH') AS closing, count_if(command <> 'STITCH') AS n_between,
      count_if(command = 'TRIM') AS n_trim, count_if(command = 'COLOR_CHANGE') AS n_cc FROM gap_numbers GROUP BY design_id, gap) g
    ON did = design_id AND closing = source_order
  WINDOW w AS (PARTITION BY design_id ORDER BY segment_id))) WHERE p_id IS NOT NULL""", "segments", "gap_numbers")


@query("path_events", "SELECT * FROM path_events", "path_events")
def path_events(spark, sf):
    return ops.path_events(segments_of(spark, sf))


@query("path_event_stats", """
SELECT design_id, count(*) AS edges, count_if(near_connect_label) AS same_color_near_connect_edges, count_if(long_jump_label) AS long_jump_edges,
  count_if(trim_label) AS trim_edges, count_if(color_change_label) AS color_change_edges FROM path_events GROUP BY 1""", "path_events")
def path_event_stats(spark, sf):
    e = ops.path_events(segments_of(spark, sf))
    return e.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("near_connect_label").alias("same_color_near_connect_edges"),
        F.count_if("long_jump_label").alias("long_jump_edges"), F.count_if("trim_label").alias("trim_edges"),
        F.count_if("color_change_label").alias("color_change_edges"))


cte("closures", """
SELECT design_id, color_layer, from_segment, to_segment, round_even(gap, 4) AS distance_mm, segments, true AS closure_gap_label FROM (
  SELECT design_id, color_layer, max(segment_id) AS from_segment, min(segment_id) AS to_segment, count(*) AS segments,
    sqrt((arg_min(entry_x_mm, segment_id) - arg_max(exit_x_mm, segment_id)) ** 2 + (arg_min(entry_y_mm, segment_id) - arg_max(exit_y_mm, segment_id)) ** 2) AS gap
  FROM segments GROUP BY 1, 2) WHERE gap >= 6.0 AND segments >= 4""", "segments")


@query("path_events_with_closures", """
SELECT design_id, from_segment, to_segment, same_color, distance_mm, commands_between, near_connect_label, long_jump_label, trim_label, color_change_label,
  'STREAM' AS commands, false AS closure_gap_label, NULL::BIGINT AS color_layer FROM path_events
UNION ALL SELECT design_id, from_segment, to_segment, true, distance_mm, NULL, NULL, NULL, NULL, NULL, 'CLOSURE_CHECK', true, color_layer FROM closures""", "path_events", "closures")
def path_events_with_closures(spark, sf):
    s = segments_of(spark, sf)
    return ops.with_closures(ops.path_events(s), ops.closure_gaps(s))


@query("closure_gaps", "SELECT * FROM closures", "closures")
def closure_gaps(spark, sf):
    return ops.closure_gaps(ops.build_segments(commands(spark, sf)))


@query("entry_exit_by_color", """
SELECT design_id, color_layer, round_even(arg_min(entry_x_mm, segment_id), 3) AS entry_x, round_even(arg_min(entry_y_mm, segment_id), 3) AS entry_y,
  round_even(arg_max(exit_x_mm, segment_id), 3) AS exit_x, round_even(arg_max(exit_y_mm, segment_id), 3) AS exit_y,
  min(segment_id) - 1 AS segment_start, max(segment_id) - 1 AS segment_end FROM segments WHERE length_mm >= 1e-6 GROUP BY 1, 2""", "segments")
def entry_exit_by_color(spark, sf):
    return ops.entry_exit_by_color(ops.build_segments(commands(spark, sf)))


@query("sequence_windows", """
SELECT design_id, seq AS target_seq, round_even(dx_mm, 6) AS target_dx, round_even(dy_mm, 6) AS target_dy, cid AS target_command,
  round_even(dx4, 6) AS first_dx, round_even(dy1, 6) AS last_dy, c1 AS last_command, CAST(32 AS INTEGER) AS n_features
FROM (SELECT *, lag(dx_mm, 4) OVER w AS dx4, lag(dy_mm, 1) OVER w AS dy1, lag(cid, 1) OVER w AS c1, row_number() OVER w AS rn
  FROM (SELECT *, CAST(CASE command WHEN 'STITCH' THEN 0 WHEN 'JUMP' THEN 1 WHEN 'TRIM' THEN 2 WHEN 'END' THEN 3 WHEN 'COLOR_CHANGE' THEN 4 ELSE 5 END AS INTEGER) AS cid
        FROM deltas WHERE has_prev) WINDOW w AS (PARTITION BY design_id ORDER BY seq)) WHERE rn > 4""", "deltas")
def sequence_windows(spark, sf):
    w = ops.sequence_windows(commands(spark, sf), seq_len=4)
    f = lambda i: F.get("features", F.lit(i))
    hot = F.slice("features", 27, 6)
    return tidy(w.select(
        "design_id", "target_seq", "target_dx", "target_dy", "target_command", f(0).alias("first_dx"), f(25).alias("last_dy"),
        (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("last_command"), F.size("features").alias("n_features")))


cte("texture", """
SELECT c.design_id, coalesce(n, 0) AS stitch_segment_count, stitch_command_count, jump_count, trim_count,
  coalesce(round_even(w, 8), 0.0) AS bbox_width_mm, coalesce(round_even(h, 8), 0.0) AS bbox_height_mm,
  coalesce(round_even(greatest(1e-6, w * h), 8), 1e-6) AS bbox_area_mm2, coalesce(round_even(total, 8), 0.0) AS stitch_path_mm,
  coalesce(round_even(m, 8), 0.0) AS mean_stitch_length_mm, coalesce(round_even(med, 8), 0.0) AS median_stitch_length_mm,
  coalesce(round_even(sd / greatest(1e-6, m), 8), 0.0) AS stitch_length_cv, coalesce(round_even(ns / n, 8), 0.0) AS short_stitch_ratio,
  coalesce(round_even(nl / n, 8), 0.0) AS long_stitch_ratio, coalesce(round_even(ent, 8), 0.0) AS angle_entropy,
  coalesce(round_even(dom, 8), 0.0) AS dominant_angle_mass, coalesce(round_even(100.0 * n / greatest(1e-6, w * h), 8), 0.0) AS stitch_density_per_100mm2,
  coalesce(round_even(100.0 * total / greatest(1e-6, w * h), 8), 0.0) AS path_density_per_100mm2
FROM (SELECT design_id, count_if(command = 'STITCH') AS stitch_command_count, count_if(command = 'JUMP') AS jump_count, count_if(command = 'TRIM') AS trim_count FROM deltas GROUP BY 1) c
LEFT JOIN (SELECT design_id, count(*) AS n, sum(distance_mm) AS total, avg(distance_mm) AS m, stddev_pop(distance_mm) AS sd, quantile_cont(distance_mm, 0.5) AS med,
  count_if(distance_mm < 0.8) AS ns, count_if(distance_mm > 4.0) AS nl, greatest(max(x_mm), max(prev_x)) - least(min(x_mm), min(prev_x)) AS w,
  greatest(max(y_mm), max(prev_y)) - least(min(y_mm), min(prev_y)) AS h FROM stitches GROUP BY 1) s USING (design_id)
LEFT JOIN (SELECT design_id, sum(-p * ln(p)) / ln(18) AS ent, max(p) AS dom FROM (
  SELECT design_id, bin, count(*) / sum(count(*)) OVER (PARTITION BY design_id) AS p FROM stitches GROUP BY 1, 2) GROUP BY 1) a USING (design_id)""", "stitches", "deltas")
cte("stitches", """
SELECT *, least(17, CAST(floor(fmod(fmod(atan2(dy_mm, dx_mm), pi()) + pi(), pi()) / pi() * 18) AS INTEGER)) AS bin
FROM deltas WHERE command = 'STITCH' AND has_prev AND distance_mm > 1e-6""", "deltas")
_TEXTURE = ("bbox_width_mm", "bbox_height_mm", "bbox_area_mm2", "stitch_path_mm", "mean_stitch_length_mm", "median_stitch_length_mm",
            "stitch_length_cv", "short_stitch_ratio", "long_stitch_ratio", "angle_entropy", "dominant_angle_mass",
            "stitch_density_per_100mm2", "path_density_per_100mm2")


@query("stitch_texture_metrics", f"SELECT design_id, stitch_segment_count, stitch_command_count, jump_count, trim_count, {r(*_TEXTURE)} FROM texture", "texture")
def stitch_texture_metrics(spark, sf):
    return tidy(ops.stitch_texture_metrics(commands(spark, sf)))


@query("preview_texture", """
SELECT design_id, round_even(round_even(den, 8), 6) AS density_score, round_even(round_even(rhy, 8), 6) AS rhythm_score,
  round_even(round_even(dir, 8), 6) AS directional_score, round_even(round_even(saf, 8), 6) AS safety_score,
  round_even(round_even(0.18 * den + 0.18 * rhy + 0.17 * dir + 0.08 * saf, 8), 6) AS professional_preview_score
FROM (SELECT design_id, least(1.0, stitch_density_per_100mm2 / 5.0) AS den,
  greatest(0.0, least(1.0, 1.0 - abs(mean_stitch_length_mm - 2.2) / 2.8)) * greatest(0.0, least(1.0, 1.0 - 0.75 * stitch_length_cv)) AS rhy,
  greatest(0.0, least(1.0, 0.55 * dominant_angle_mass + 0.45 * greatest(0.0, least(1.0, 1.0 - abs(angle_entropy - 0.42) / 0.42)))) AS dir,
  greatest(0.0, least(1.0, 1.0 - 0.35 * long_stitch_ratio)) AS saf FROM texture)""", "texture")
def preview_texture(spark, sf):
    p = ops.preview_texture(ops.stitch_texture_metrics(commands(spark, sf)))
    return tidy(p.select("design_id", "density_score", "rhythm_score", "directional_score", "safety_score", "professional_preview_score"))


@query("polyline_stats", f"""
SELECT design_id, count(*) AS point_count, round_even(sum(distance_mm), 6) AS length_mm, min(x_mm) AS min_x, min(y_mm) AS min_y, max(x_mm) AS max_x, max(y_mm) AS max_y,
  arg_min(x_mm, seq) AS start_x, arg_min(y_mm, seq) AS start_y, arg_max(x_mm, seq) AS end_x, arg_max(y_mm, seq) AS end_y FROM deltas GROUP BY 1""", "deltas")
def polyline_stats(spark, sf):
    p = ops.polyline_stats(commands(spark, sf), ["design_id"])
    return p.withColumn("length_mm", half_even("length_mm", 6))


@query("split_long_moves", """
SELECT design_id, seq AS source_seq, CAST(step AS INTEGER) AS step, CASE WHEN step = 0 THEN 'TRIM' ELSE command END AS command,
  CAST(round_even((prev_x + (x_mm - prev_x) * (step / steps)) * 10.0, 0) AS BIGINT) AS x_tenth_mm,
  CAST(round_even((prev_y + (y_mm - prev_y) * (step / steps)) * 10.0, 0) AS BIGINT) AS y_tenth_mm
FROM (SELECT *, unnest(range(first_step, steps + 1)) AS step FROM (
  SELECT *, greatest(1, CAST(ceil(distance_mm / CASE WHEN command = 'STITCH' THEN 4.0 ELSE 12.0 END) AS INTEGER)) AS steps,
    CASE WHEN command = 'JUMP' AND distance_mm >= 6.0 THEN 0 ELSE 1 END AS first_step
  FROM deltas WHERE has_prev AND command IN ('STITCH', 'JUMP') AND distance_mm > 1e-6))""", "deltas")
def split_long_moves(spark, sf):
    return ops.split_long_moves(commands(spark, sf))


@query("drop_collinear", """
SELECT design_id, seq, x, y FROM (
  SELECT *, sign(x - lag(x) OVER w) AS dx, sign(y - lag(y) OVER w) AS dy, sign(lead(x) OVER w - x) AS nx, sign(lead(y) OVER w - y) AS ny
  FROM (SELECT design_id, seq, CAST(floor(x_mm) AS BIGINT) AS x, CAST(floor(y_mm * 4) AS BIGINT) AS y FROM commands)
  WINDOW w AS (PARTITION BY design_id ORDER BY seq)) WHERE dx IS NULL OR nx IS NULL OR dx <> nx OR dy <> ny""", "commands")
def drop_collinear(spark, sf):
    p = commands(spark, sf).select("design_id", "seq", F.floor("x_mm").cast("long").alias("x"), F.floor(F.col("y_mm") * 4).cast("long").alias("y"))
    return ops.drop_collinear(p, ["design_id"])


_PALETTE = {(0, 0, 0): "black", (255, 255, 255): "white", (220, 20, 60): "red", (34, 139, 34): "green", (30, 80, 200): "blue", (240, 200, 40): "yellow"}


@query("thread_palette", """
SELECT design_id, row_number() OVER (PARTITION BY design_id ORDER BY first_block) AS thread_order, color_index,
  format('#{:02x}{:02x}{:02x}', r, g, b) AS hex, list_sort([%s])[1].n AS approx_color_name, region_count, stitch_count
FROM (SELECT design_id, color_index, min(block_no) AS first_block, CAST(color_index * 53 %% 256 AS INTEGER) AS r, CAST(color_index * 97 %% 256 AS INTEGER) AS g, CAST(color_index * 29 %% 256 AS INTEGER) AS b,
  count(*) AS region_count, CAST(sum(stitch_count) AS BIGINT) AS stitch_count FROM (
  SELECT design_id, seq // 8 AS block_no, (seq // 8 * 7 + design_id) %% 5 AS color_index, count_if(command = 'STITCH') AS stitch_count
  FROM commands GROUP BY 1, 2, 3) GROUP BY 1, 2)""" % ", ".join(
    "{'d': (r-%d)*(r-%d)+(g-%d)*(g-%d)+(b-%d)*(b-%d), 'i': %d, 'n': '%s'}" % (c[0], c[0], c[1], c[1], c[2], c[2], i, n)
    for i, (c, n) in enumerate(_PALETTE.items())), "commands")
def thread_palette(spark, sf):
    blk = F.floor(F.col("seq") / 8).cast("long")
    blocks = commands(spark, sf).groupBy("design_id", blk.alias("block_no")).agg(F.count_if(F.col("command") == "STITCH").alias("stitch_count"))
    color = (F.col("block_no") * 7 + F.col("design_id")) % 5
    blocks = blocks.withColumn("color_index", color).withColumns({
        "r": (F.col("color_index") * 53 % 256).cast("int"), "g": (F.col("color_index") * 97 % 256).cast("int"), "b": (F.col("color_index") * 29 % 256).cast("int")})
    return ops.thread_palette(blocks, _PALETTE).withColumn("thread_order", F.col("thread_order").cast("long"))


@query("sequence_cost")
def sequence_cost(spark, sf):
    seg = ops.build_segments(commands(spark, sf))
    lines = seg.select(F.col("design_id").alias("route_id"), (F.col("segment_id") - 1).alias("position"),
                       F.col("entry_x_mm").alias("start_x"), F.col("entry_y_mm").alias("start_y"),
                       F.col("exit_x_mm").alias("end_x"), F.col("exit_y_mm").alias("end_y"))
    return tidy(ops.sequence_cost(lines))


@query("unified_scores_of_streams", """
SELECT design_id, jump_count, trim_count, round_even(0.25 * least(1.0, jump_count / 25.0::DOUBLE) + 0.15 * least(1.0, trim_count / 20.0::DOUBLE), 8) AS unified_loss,
  CASE WHEN jump_count > 25 OR trim_count > 20 THEN 'hard_fail' WHEN jump_count > 15 OR trim_count > 10 THEN 'warning'
       WHEN jump_count <= 10 AND trim_count <= 6 THEN 'excellent' ELSE 'pass' END AS quality_level FROM execution_metrics""", "execution_metrics")
def unified_scores_of_streams(spark, sf):
    m = ops.execution_metrics(commands(spark, sf)).select("design_id", "jump_count", "trim_count")
    s = unified_score(m.columns, F.lit(True))
    return m.select("*", s["unified_loss"].alias("unified_loss"), s["quality_level"].alias("quality_level"))
