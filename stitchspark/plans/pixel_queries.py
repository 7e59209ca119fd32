"""Queries over pixel tables and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import axis_direction, planner_prior
from ..operators import commands as cmd
from ..operators import components as comp
from ..operators import pixels as px
from ..operators.stream import walk
from .fixtures import GRID, commands, masks
from .registry import cte, query, r, tidy

PAD = 4


def segments(spark, sf):
    return cmd.segments_of(walk(commands(spark, sf)))


def fitted(spark, sf):
    return px.fit_transform(segments(spark, sf), GRID, PAD)


def hits(spark, sf, width=1):
    return px.rasterize_segments(fitted(spark, sf), GRID, width)


def typed(spark, sf):
    return px.drawn_maps(fitted(spark, sf), GRID, 3)


cte("fitted", f"""
SELECT s.*, n_segments, scale, ox + (entry_x_mm - min_x) * scale AS entry_x, oy + (entry_y_mm - min_y) * scale AS entry_y, ox + (exit_x_mm - min_x) * scale AS exit_x, oy + (exit_y_mm - min_y) * scale AS exit_y
FROM segments s JOIN (SELECT *, ({GRID} - w * scale) / 2.0 AS ox, ({GRID} - h * scale) / 2.0 AS oy FROM (SELECT *, {GRID - 2 * PAD}::DOUBLE / greatest(w, h) AS scale FROM (
  SELECT design_id, min_x, min_y, greatest(1e-6, max_x - min_x) AS w, greatest(1e-6, max_y - min_y) AS h, n_segments FROM (
   SELECT design_id, least(min(entry_x_mm), min(exit_x_mm)) AS min_x, greatest(max(entry_x_mm), max(exit_x_mm)) AS max_x, least(min(entry_y_mm), min(exit_y_mm)) AS min_y,
     greatest(max(entry_y_mm), max(exit_y_mm)) AS max_y, count(*) AS n_segments FROM segments GROUP BY 1)))) b USING (design_id)""", "segments")
_STEP = "CASE WHEN i = n THEN {b} ELSE {a} + i * (({b} - {a}) / n) END"


def _disc(radius: int) -> str:
    return "(SELECT unnest([%s], recursive := true))" % ", ".join(f"{{'ody': {dy}, 'odx': {dx}}}" for dy, dx in px.disc(radius))


def _hits_sql(width: int) -> str:
    clip = lambda a, b, o: f"greatest(0, least({GRID - 1}, CAST(round_even({_STEP.format(a=a, b=b)}, 0) AS INTEGER) + {o}))"
    return f"""SELECT design_id, segment_id, color_layer, n_segments, length_px, ux, uy, {clip('entry_y', 'exit_y', 'ody')} AS y, {clip('entry_x', 'exit_x', 'odx')} AS x
FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, dx / length_px AS ux, dy / length_px AS uy, greatest(1, CAST(ceil(greatest(abs(dx), abs(dy))) AS INTEGER)) AS n FROM (
  SELECT *, exit_x - entry_x AS dx, exit_y - entry_y AS dy, sqrt((exit_x - entry_x) * (exit_x - entry_x) + (exit_y - entry_y) * (exit_y - entry_y)) AS length_px FROM fitted) WHERE length_px >= 1e-6)), {_disc(width // 2)}"""


cte("hits", _hits_sql(1), "fitted")
cte("wide_hits", _hits_sql(3), "fitted")


@query("fit_transform", f"SELECT design_id, segment_id, {r('scale', 'entry_x', 'entry_y', 'exit_x', 'exit_y')} FROM fitted", "fitted")
def fit_transform(spark, sf):
    return tidy(fitted(spark, sf).select("design_id", "segment_id", "scale", "entry_x", "entry_y", "exit_x", "exit_y"))


@query("rasterize_segments", "SELECT design_id, segment_id, y, x, count(*) AS n FROM wide_hits GROUP BY 1, 2, 3, 4", "wide_hits")
def rasterize_segments(spark, sf):
    return hits(spark, sf, 3).groupBy("design_id", "segment_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))


cte("stitch_px", """
SELECT *, least(1.0, ln(1 + hits) / ln(1 + greatest(1.0, p99))) AS density FROM (SELECT *, quantile_cont(hits::DOUBLE, 0.99) OVER (PARTITION BY design_id) AS p99 FROM (
  SELECT design_id, y, x, count(*) AS hits, avg(ux) AS dir_x, avg(uy) AS dir_y FROM hits GROUP BY 1, 2, 3))""", "hits")


@query("stitch_maps", f"SELECT design_id, y, x, hits, {r('dir_x', 'dir_y', 'density')} FROM stitch_px", "stitch_px")
def stitch_maps(spark, sf):
    return tidy(px.stitch_maps(hits(spark, sf)))


cte("typed", """
SELECT design_id, y, x, arg_max(color_layer, segment_id) AS color_layer, arg_max((segment_id - 1) / greatest(1, n_segments - 1), segment_id) AS path_order,
  arg_max(CASE WHEN length_px <= 1.8 THEN 1 WHEN length_px <= 6.0 THEN 2 ELSE 3 END, segment_id)::INTEGER AS stitch_type, max(segment_id) AS segment_id FROM wide_hits GROUP BY 1, 2, 3""", "wide_hits")


@query("last_writer_maps", f"SELECT design_id, y, x, color_layer, {r('path_order')}, stitch_type, segment_id FROM typed", "typed")
def last_writer_maps(spark, sf):
    return tidy(typed(spark, sf))


_SPAN = "greatest(1, CAST(ceil(greatest(abs(bx - ax), abs(by_ - ay))) AS INTEGER))"
cte("placed", """
SELECT e.*, a.exit_x AS ax, a.exit_y AS ay, b.entry_x AS bx, b.entry_y AS by_ FROM path_events e JOIN fitted a ON e.design_id = a.design_id AND e.from_segment = a.segment_id
JOIN fitted b ON e.design_id = b.design_id AND e.to_segment = b.segment_id""", "path_events", "fitted")
cte("event_px", f"""
SELECT design_id, channel, y, x, max(value) AS value FROM (
  SELECT design_id, 'stitch_trace' AS channel, y, x, 1.0::DOUBLE AS value FROM hits
  UNION ALL SELECT design_id, 'path_order', y, x, (segment_id - 1) / greatest(1, n_segments - 1) FROM hits
  UNION ALL SELECT design_id, 'near_connect', greatest(0, least({GRID - 1}, CAST(round_even({_STEP.format(a='ay', b='by_')}, 0) AS INTEGER))), greatest(0, least({GRID - 1}, CAST(round_even({_STEP.format(a='ax', b='bx')}, 0) AS INTEGER))), 1.0
    FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, {_SPAN} AS n FROM placed WHERE near_connect_label))
  UNION ALL SELECT design_id, channel, y, x, value FROM (SELECT design_id, channel, value, CAST(round_even(py, 0) AS INTEGER) + ody AS y, CAST(round_even(px, 0) AS INTEGER) + odx AS x FROM (
     SELECT design_id, 'closure_gap' AS channel, 1.0::DOUBLE AS value, p.px, p.py FROM (SELECT design_id, unnest([{{'px': ax, 'py': ay}}, {{'px': bx, 'py': by_}}]) AS p FROM closed)
     UNION ALL SELECT design_id, m.channel, m.value, p.px, p.py FROM (SELECT *, unnest([{{'channel': 'long_jump', 'value': 1.0::DOUBLE, 'on_': long_jump_label}}, {{'channel': 'trim', 'value': 1.0::DOUBLE, 'on_': trim_label}},
        {{'channel': 'color_change', 'value': 0.85::DOUBLE, 'on_': color_change_label}}]) AS m FROM (SELECT *, unnest([{{'px': ax, 'py': ay}}, {{'px': bx, 'py': by_}}]) AS p FROM placed)) WHERE m.on_), {_disc(2)})
    WHERE y BETWEEN 0 AND {GRID - 1} AND x BETWEEN 0 AND {GRID - 1}) GROUP BY 1, 2, 3, 4""", "hits", "placed", "closed")
cte("closed", """
SELECT c.design_id, a.entry_x AS ax, a.entry_y AS ay, b.exit_x AS bx, b.exit_y AS by_ FROM closures c JOIN fitted a ON c.design_id = a.design_id AND c.to_segment = a.segment_id
JOIN fitted b ON c.design_id = b.design_id AND c.from_segment = b.segment_id""", "closures", "fitted")


def events_px(spark, sf):
    f = fitted(spark, sf)
    ends = ("entry_x", "entry_y", "exit_x", "exit_y")
    closures = cmd.closure_gaps(f, extra=ends).withColumnsRenamed(dict(zip(ends, ("x0", "y0", "x1", "y1"))))
    return px.event_maps(f, cmd.event_labels(), closures, GRID)


@query("event_maps", f"SELECT design_id, channel, y, x, {r('value')} FROM event_px", "event_px")
def event_maps(spark, sf):
    return tidy(events_px(spark, sf))


@query("continuity_edges", f"""
SELECT design_id, segment_id AS to_segment, round_even(gap, 6) AS gap_px, CASE WHEN same AND gap <= 2.5 * scale THEN 'near_connect' WHEN gap >= 8.0 * scale THEN 'long_jump' WHEN NOT same THEN 'color_change' ELSE 'none' END AS edge_label
FROM (SELECT *, sqrt((entry_x - px) * (entry_x - px) + (entry_y - py) * (entry_y - py)) AS gap, pc = color_layer AS same FROM (
  SELECT *, lag(exit_x) OVER w AS px, lag(exit_y) OVER w AS py, lag(color_layer) OVER w AS pc FROM fitted WINDOW w AS (PARTITION BY design_id ORDER BY segment_id)) WHERE px IS NOT NULL)""", "fitted")
def continuity_edges(spark, sf):
    return tidy(cmd.continuity_edges(fitted(spark, sf), 2.5 * F.col("scale"), 8.0 * F.col("scale")))


@query("continuity_totals", """
SELECT design_id, count(*) + 1 AS segments, count_if(l = 1) AS near_connect_edges, count_if(l = 2) AS long_jump_edges, count_if(l = 3) AS color_change_edges
FROM (SELECT design_id, CASE WHEN same AND gap <= 2.5 * scale THEN 1 WHEN gap >= 8.0 * scale THEN 2 WHEN NOT same THEN 3 ELSE 0 END AS l
  FROM (SELECT *, sqrt((entry_x - px) * (entry_x - px) + (entry_y - py) * (entry_y - py)) AS gap, pc = color_layer AS same FROM (
    SELECT *, lag(exit_x) OVER w AS px, lag(exit_y) OVER w AS py, lag(color_layer) OVER w AS pc FROM fitted WINDOW w AS (PARTITION BY design_id ORDER BY segment_id)) WHERE px IS NOT NULL)) GROUP BY 1""", "fitted")
def continuity_totals(spark, sf):
    return cmd.continuity_totals(cmd.continuity_edges(fitted(spark, sf), 2.5 * F.col("scale"), 8.0 * F.col("scale")))


_MM = "(25.6::DOUBLE / 64)"
cte("off_mask", f"""
SELECT design_id, seq, any_value(distance_mm) AS distance_mm, avg(CASE WHEN m.y IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) AS off_fraction FROM (
  SELECT design_id, seq, distance_mm, CAST(round_even((prev_y + (y_mm - prev_y) * (i / n)) / {_MM} + 32.0, 0) AS INTEGER) AS y, CAST(round_even((prev_x + (x_mm - prev_x) * (i / n)) / {_MM} + 32.0, 0) AS INTEGER) AS x
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(1, CAST(ceil(distance_mm) AS INTEGER)) AS n FROM deltas WHERE command = 'STITCH' AND has_prev AND distance_mm > 1e-6))) s
LEFT JOIN masks m USING (design_id, y, x) GROUP BY 1, 2""", "deltas", "masks")


def off_mask(spark, sf):
    return px.off_mask_stitches(cmd.with_deltas(commands(spark, sf)), masks(spark, sf))


@query("off_mask_fraction", f"SELECT design_id, seq, {r('distance_mm', 'off_fraction')} FROM off_mask", "off_mask")
def off_mask_fraction(spark, sf):
    return tidy(off_mask(spark, sf))


@query("visible_connectors", """
SELECT design_id, round_even(sum(distance_mm * off_fraction), 4) AS off_mask_stitch_length_mm, count_if(off_fraction > 0) AS off_mask_stitch_count, count_if(distance_mm >= 1.5 AND off_fraction >= 0.65) AS visible_connector_count,
  round_even(coalesce(sum(distance_mm) FILTER (distance_mm >= 1.5 AND off_fraction >= 0.65), 0.0), 4) AS visible_connector_length_mm FROM off_mask GROUP BY 1""", "off_mask")
def visible_connectors(spark, sf):
    return px.visible_connectors(off_mask(spark, sf))


_COUNT_TEXT = "SELECT design_id, string_agg(name || '=' || n, ',' ORDER BY name) AS command_counts FROM (SELECT design_id, lower(command) AS name, count(*) AS n FROM commands GROUP BY 1, 2) GROUP BY 1"


@query("full_execution_report", f"""
SELECT e.*, l.lock_tack_like_count, c.command_counts, coalesce(v.off_mask_stitch_length_mm, 0.0) AS off_mask_stitch_length_mm, coalesce(v.off_mask_stitch_count, 0) AS off_mask_stitch_count,
  coalesce(v.visible_connector_count, 0) AS visible_connector_count, coalesce(v.visible_connector_length_mm, 0.0) AS visible_connector_length_mm, true AS round_trip_parse_success,
  'masks/' || e.design_id || '.png' AS mask_path, 25.6::DOUBLE AS target_width_mm, 4.0::DOUBLE AS max_stitch_threshold_mm, 8.0::DOUBLE AS high_risk_jump_threshold_mm,
  1.5::DOUBLE AS visible_connector_min_mm, 0.65::DOUBLE AS visible_connector_off_mask_ratio
FROM execution_metrics e JOIN lock_tack l USING (design_id) JOIN ({_COUNT_TEXT}) c USING (design_id) LEFT JOIN (
  SELECT design_id, round_even(sum(distance_mm * off_fraction), 4) AS off_mask_stitch_length_mm, count_if(off_fraction > 0) AS off_mask_stitch_count, count_if(distance_mm >= 1.5 AND off_fraction >= 0.65) AS visible_connector_count,
    round_even(coalesce(sum(distance_mm) FILTER (distance_mm >= 1.5 AND off_fraction >= 0.65), 0.0), 4) AS visible_connector_length_mm FROM off_mask GROUP BY 1) v USING (design_id)""", "execution_metrics", "lock_tack", "commands", "off_mask")
def full_execution_report(spark, sf):
    path = F.concat(F.lit("masks/"), F.col("design_id").cast("string"), F.lit(".png"))
    report = cmd.full_execution_report(commands(spark, sf), off_mask(spark, sf), path)
    pairs = F.transform(F.map_entries("command_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.withColumn("command_counts", F.array_join(pairs, ","))


cte("drawn", "SELECT DISTINCT design_id, y, x FROM wide_hits", "wide_hits")
cte("dilated", f"SELECT DISTINCT design_id, y + ody AS y, x + odx AS x FROM masks, {_disc(1)} WHERE y + ody BETWEEN 0 AND {GRID - 1} AND x + odx BETWEEN 0 AND {GRID - 1}", "masks")


@query("dilate", "SELECT design_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM dilated", "dilated")
def dilate(spark, sf):
    return px.dilate(masks(spark, sf), 1, GRID)


cte("coverage", """
SELECT *, round_even(overlap_pixels / greatest(1, target_pixels), 6) AS coverage_ratio, round_even(overlap_pixels / greatest(1, stitch_pixels), 6) AS stitch_precision_ratio,
  round_even(adaptive_overlap_pixels / greatest(1, adaptive_target_pixels), 6) AS adaptive_coverage_ratio, round_even(adaptive_overlap_pixels / greatest(1, stitch_pixels), 6) AS adaptive_stitch_precision_ratio,
  round_even(adaptive_off_target_pixels / greatest(1, stitch_pixels), 6) AS overfill_outside_adaptive_ratio
FROM (SELECT design_id, count_if(t) AS target_pixels, count_if(a) AS adaptive_target_pixels, count_if(s) AS stitch_pixels, count_if(s AND t) AS overlap_pixels, count_if(s AND NOT t) AS off_target_pixels,
  count_if(s AND a) AS adaptive_overlap_pixels, count_if(s AND NOT a) AS adaptive_off_target_pixels FROM (
   SELECT design_id, y, x, bool_or(k = 't') AS t, bool_or(k = 'a') AS a, bool_or(k = 's') AS s FROM (SELECT design_id, y, x, 't' AS k FROM masks UNION ALL SELECT design_id, y, x, 'a' FROM dilated UNION ALL SELECT design_id, y, x, 's' FROM drawn)
   GROUP BY 1, 2, 3) GROUP BY 1)""", "masks", "dilated", "drawn")


@query("coverage_metrics", "SELECT * FROM coverage", "coverage")
def coverage_metrics(spark, sf):
    return px.coverage_metrics(hits(spark, sf, 3), masks(spark, sf), GRID, 1)


@query("skeleton_coverage", """
SELECT design_id, target_pixels AS skeleton_pixels, coverage_ratio AS skeleton_coverage_ratio, adaptive_coverage_ratio AS adaptive_skeleton_coverage_ratio, coverage_ratio < 0.95 AS low_skeleton_coverage FROM coverage""", "coverage")
def skeleton_coverage(spark, sf):
    return px.skeleton_coverage(hits(spark, sf, 3), masks(spark, sf), GRID, 1)


def _boundary_sql(near: str, n: int) -> str:
    return f"""SELECT p.design_id, p.y, p.x FROM drawn p LEFT JOIN (SELECT design_id, y + ody AS y, x + odx AS x, count(*) AS n FROM drawn, {near} GROUP BY 1, 2, 3) q USING (design_id, y, x) WHERE coalesce(n, 0) < {n}"""


def _near(points) -> str:
    return "(SELECT unnest([%s], recursive := true))" % ", ".join(f"{{'ody': {dy}, 'odx': {dx}}}" for dy, dx in points)


def drawn(spark, sf):
    return hits(spark, sf, 3).select(*px.PX).distinct()


@query("boundary_pixels", _boundary_sql(_near(px.NEIGHBOURS_4), 4), "drawn")
def boundary_pixels(spark, sf):
    return px.boundary_pixels(drawn(spark, sf))


@query("boundary_pixels_8", _boundary_sql(_near(px.NEIGHBOURS_8), 8), "drawn")
def boundary_pixels_8(spark, sf):
    return px.boundary_pixels(drawn(spark, sf), 8)


@query("row_runs", """
SELECT design_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY design_id, y ORDER BY x) AS g FROM drawn) GROUP BY design_id, y, g HAVING max(x) - min(x) + 1 >= 2""", "drawn")
def row_runs(spark, sf):
    return px.row_runs(drawn(spark, sf), 2)


cte("links", """
SELECT design_id, segment_id AS connector_id, px AS ax, py AS ay, entry_x AS bx, entry_y AS by_ FROM (SELECT *, lag(exit_x) OVER w AS px, lag(exit_y) OVER w AS py FROM fitted WINDOW w AS (PARTITION BY design_id ORDER BY segment_id)) WHERE px IS NOT NULL""", "fitted")
cte("link_stats", f"""
SELECT design_id, connector_id, avg((v > 0)::INTEGER) AS inside_fraction, min(v) AS min_value, quantile_cont(v, 0.05) AS q05_value, avg(v) AS mean_value FROM (
  SELECT l.design_id, connector_id, coalesce(hits, 0)::DOUBLE AS v FROM (SELECT design_id, connector_id, greatest(0, least({GRID - 1}, CAST(round_even({_STEP.format(a='ay', b='by_')}, 0) AS INTEGER))) AS y,
    greatest(0, least({GRID - 1}, CAST(round_even({_STEP.format(a='ax', b='bx')}, 0) AS INTEGER))) AS x FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(1, CAST(ceil(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS INTEGER)) AS n FROM links))) l
  LEFT JOIN stitch_px USING (design_id, y, x)) GROUP BY 1, 2""", "links", "stitch_px")


def links(spark, sf):
    p = fitted(spark, sf).filter("prev_exit_x IS NOT NULL")
    return p.select("design_id", F.col("segment_id").alias("connector_id"), F.col("prev_exit_x").alias("ax"), F.col("prev_exit_y").alias("ay"), F.col("entry_x").alias("bx"), F.col("entry_y").alias("by"))


def link_stats(spark, sf):
    maps = px.stitch_maps(hits(spark, sf)).select(*px.PX, F.col("hits").cast("double").alias("value"))
    return px.connector_stats(links(spark, sf), maps, GRID)


@query("connector_stats", f"SELECT design_id, connector_id, {r('inside_fraction', 'min_value', 'q05_value', 'mean_value')}, min_value >= 1.0 AND q05_value >= 1.5 AS safe FROM link_stats", "link_stats")
def connector_stats(spark, sf):
    return tidy(link_stats(spark, sf).withColumn("safe", px.connector_is_safe()))


@query("continuity_adjusted_cost", """
SELECT design_id, connector_id, round_even(d + 0.45 * greatest(0.0, d - 8.0) - 0.85 * inside_fraction * 8.0 + 0.35 * least(1.0, mean_value) * greatest(d, 8.0), 6) AS cost
FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS d FROM links JOIN link_stats USING (design_id, connector_id))""", "links", "link_stats")
def continuity_adjusted_cost(spark, sf):
    from ..functions.scalars import continuity_adjusted_cost as cost
    j = links(spark, sf).join(link_stats(spark, sf), ["design_id", "connector_id"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    j = j.withColumns({"d": F.sqrt(dx * dx + dy * dy), "jm": F.least(F.lit(1.0), F.col("mean_value"))})
    return tidy(j.select("design_id", "connector_id", cost("d", "inside_fraction", "jm").alias("cost")))


@query("split_polylines_by_mask", f"""
SELECT design_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS point_count FROM (
  SELECT *, sum(CASE WHEN inside AND (NOT coalesce(pin, false) OR share < 0.72) THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS run_id FROM (SELECT p.*, share FROM pts p LEFT JOIN (
    SELECT s.design_id, s.seq, avg((m.y IS NOT NULL)::INTEGER) AS share FROM (SELECT design_id, seq, CAST(round_even(ppy + (py - ppy) * (i / n), 0) AS INTEGER) AS y, CAST(round_even(ppx + (px - ppx) * (i / n), 0) AS INTEGER) AS x
      FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(1, CAST(ceil(sqrt((px - ppx) ** 2 + (py - ppy) ** 2) / 0.75) AS INTEGER)) AS n FROM pts WHERE inside AND coalesce(pin, false)))) s LEFT JOIN masks m USING (design_id, y, x) GROUP BY 1, 2) USING (design_id, seq)))
WHERE inside GROUP BY design_id, run_id HAVING count(*) >= 2""", "pts", "masks")
def split_polylines_by_mask(spark, sf):
    pts = commands(spark, sf).select("design_id", "seq", (F.col("x_mm") * 5.0 + 8.0).alias("px"), (F.col("y_mm") * 40.0 + 8.0).alias("py"))
    return px.split_polylines_by_mask(pts, masks(spark, sf), GRID)


cte("pts", """
SELECT *, lag(px) OVER w AS ppx, lag(py) OVER w AS ppy, lag(inside) OVER w AS pin FROM (SELECT c.*, m.y IS NOT NULL AS inside FROM (
  SELECT design_id, seq, x_mm * 5.0 + 8.0 AS px, y_mm * 40.0 + 8.0 AS py FROM commands) c LEFT JOIN masks m ON c.design_id = m.design_id AND CAST(round_even(py, 0) AS INTEGER) = m.y AND CAST(round_even(px, 0) AS INTEGER) = m.x)
WINDOW w AS (PARTITION BY design_id ORDER BY seq)""", "commands", "masks")

cte("trace_map", "SELECT design_id, y, x, value FROM event_px WHERE channel = 'path_order'", "event_px")
cte("map_pair", """
SELECT design_id, y, x, coalesce(p.value, 0.0) AS p, t.value AS t FROM trace_map p FULL JOIN (SELECT design_id, y, x, density AS value FROM stitch_px WHERE density > 0.2) t USING (design_id, y, x)""", "trace_map", "stitch_px")


def map_pair(spark, sf):
    p = events_px(spark, sf).filter("channel = 'path_order'").select(*px.PX, "value")
    t = px.stitch_maps(hits(spark, sf)).filter("density > 0.2").select(*px.PX, F.col("density").alias("value"))
    return p, t


@query("binary_map_eval", """
SELECT design_id, round_even(tp / greatest(1.0, tp + fp + fn), 6) AS iou, round_even(2.0 * tp / greatest(1.0, 2.0 * tp + fp + fn), 6) AS f1 FROM (
  SELECT design_id, count_if(p > 0.5 AND coalesce(t, 0) > 0.5)::DOUBLE AS tp, count_if(p > 0.5 AND NOT coalesce(t, 0) > 0.5)::DOUBLE AS fp, count_if(NOT p > 0.5 AND t > 0.5)::DOUBLE AS fn FROM map_pair GROUP BY 1) WHERE tp + fp + fn > 0""", "map_pair")
def binary_map_eval(spark, sf):
    return tidy(px.binary_map_eval(*map_pair(spark, sf)))


@query("map_errors", f"""
SELECT design_id, round_even(sum(abs(p - coalesce(t, 0.0))) / {float(GRID * GRID)}, 6) AS mae, round_even(coalesce(sum(abs(p - t)) FILTER (t > 0), 0.0) / greatest(1, count_if(t > 0)), 6) AS mae_on_valid FROM map_pair GROUP BY 1""", "map_pair")
def map_errors(spark, sf):
    return tidy(px.map_errors(*map_pair(spark, sf), GRID))


@query("peak_recall", """
SELECT design_id, round_even(count_if(p > 0.35) / count(*), 6) AS endpoint_peak_recall FROM map_pair WHERE t > 0.35 GROUP BY 1""", "map_pair")
def peak_recall(spark, sf):
    return tidy(px.peak_recall(*map_pair(spark, sf)))


@query("top1_error", f"""
SELECT design_id, round_even(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / sqrt({float(2 * GRID * GRID)}), 6) AS top1_error_norm FROM (SELECT design_id, y, x FROM trace_map QUALIFY row_number() OVER (PARTITION BY design_id ORDER BY value DESC, y * {GRID} + x) = 1) a
JOIN (SELECT design_id, y, x FROM stitch_px QUALIFY row_number() OVER (PARTITION BY design_id ORDER BY hits DESC, y * {GRID} + x) = 1) b USING (design_id)""", "trace_map", "stitch_px")
def top1_error(spark, sf):
    p = events_px(spark, sf).filter("channel = 'path_order'")
    t = px.stitch_maps(hits(spark, sf)).select(*px.PX, F.col("hits").alias("value"))
    return tidy(px.top1_error(p, t, GRID))


@query("class_map_eval", """
SELECT design_id, round_even((count_if(p = 1 AND t = 1) / greatest(1, count_if(p = 1 OR t = 1)) + count_if(p = 2 AND t = 2) / greatest(1, count_if(p = 2 OR t = 2)) + count_if(p = 3 AND t = 3) / greatest(1, count_if(p = 3 OR t = 3))) / 3, 6) AS miou,
  round_even(count_if(t > 0 AND p = t) / greatest(1, count_if(t > 0)), 6) AS acc_on_mask
FROM (SELECT design_id, coalesce(a.cls, 0) AS p, coalesce(b.cls, 0) AS t FROM (SELECT design_id, y, x, ((stitch_type + (x + y) % 5 // 4) % 4) AS cls FROM typed) a FULL JOIN (SELECT design_id, y, x, stitch_type AS cls FROM typed WHERE path_order < 0.9) b USING (design_id, y, x)) GROUP BY 1""", "typed")
def class_map_eval(spark, sf):
    t = typed(spark, sf)
    shift = F.floor(((F.col("x") + F.col("y")) % 5) / 4).cast("int")
    return tidy(px.class_map_eval(t.select(*px.PX, ((F.col("stitch_type") + shift) % 4).alias("cls")), t.filter("path_order < 0.9").select(*px.PX, F.col("stitch_type").alias("cls"))))


@query("order_pair_accuracy")
def order_pair_accuracy(spark, sf):
    t = typed(spark, sf)
    return tidy(px.order_pair_accuracy(t.select(*px.PX, F.col("path_order").alias("target"), (F.col("path_order") + 0.05 * F.sin(F.col("x") * F.col("y"))).alias("pred"))))


@query("class_weights", """
SELECT cls, pixels, round_even(w / (sum(w) OVER () / 4) * CASE WHEN cls = 0 THEN 0.45 ELSE 1.0 END, 6) AS weight FROM (SELECT c::INTEGER AS cls, count(stitch_type) AS pixels, 1.0 / sqrt(greatest(1e-6, count(stitch_type) / (SELECT count(*) FROM typed))) AS w
  FROM range(4) g(c) LEFT JOIN typed ON stitch_type = c GROUP BY 1)""", "typed")
def class_weights(spark, sf):
    return tidy(px.class_weights(typed(spark, sf), 4, "stitch_type"))


@query("class_histogram_entropy", """
SELECT design_id, count(DISTINCT color_layer) AS color_layers, round_even(coalesce(-sum(p * log2(p)) FILTER (rn = 1), 0.0), 6) + 0.0 AS stitch_type_entropy
FROM (SELECT *, count(*) OVER (PARTITION BY design_id, stitch_type) / count(*) OVER (PARTITION BY design_id) AS p, row_number() OVER (PARTITION BY design_id, stitch_type ORDER BY y, x) AS rn FROM typed) GROUP BY 1""", "typed")
def class_histogram_entropy(spark, sf):
    return px.class_histogram_entropy(typed(spark, sf))


_RGB = {c: f"(color_layer * {k} + x // 16 * {k + 20}) % 256" for c, k in (("r", 37), ("g", 91), ("b", 11))}


@query("rank_colors", f"""
SELECT design_id, r, g, b, pixels, row_number() OVER (PARTITION BY design_id ORDER BY pixels DESC, r, g, b) AS label FROM (SELECT design_id, {', '.join(f'{e} AS {c}' for c, e in _RGB.items())}, count(*) AS pixels FROM typed GROUP BY 1, 2, 3, 4) WHERE r > 8 OR g > 8 OR b > 8""", "typed")
def rank_colors(spark, sf):
    t = typed(spark, sf)
    return px.rank_colors(t.select("design_id", *[F.expr(e.replace("x // 16", "(x div 16)")).alias(c) for c, e in _RGB.items()]))


_PAL = [(0, 250, 250, 250), (1, 200, 20, 20), (2, 240, 240, 200), (3, 20, 20, 20)]


@query("background_labels", f"""
SELECT design_id, label, area, border FROM (SELECT *, first_value(label) OVER (PARTITION BY design_id ORDER BY border DESC, label) AS top FROM (
  SELECT design_id, ((x // 32) + (y // 24) * 2 + design_id) % 4 AS label, count(*) AS area, CAST(sum((y = 0)::INTEGER + (y = {GRID - 1})::INTEGER + (x = 0)::INTEGER + (x = {GRID - 1})::INTEGER) AS BIGINT) AS border FROM masks GROUP BY 1, 2))
JOIN (SELECT unnest([{', '.join(f"{{'label': {a}, 'lum': 0.2126 * {b} + 0.7152 * {c} + 0.0722 * {d}}}" for a, b, c, d in _PAL)}], recursive := true)) USING (label)
WHERE (label = top AND border / {float(4 * GRID)} > 0.30) OR (lum >= 235 AND area / {float(GRID * GRID)} > 0.05)""", "masks")
def background_labels(spark, sf):
    lab = masks(spark, sf).withColumn("label", (F.expr("x div 32") + F.expr("y div 24") * 2 + F.col("design_id")) % 4)
    pal = spark.createDataFrame(_PAL, "label bigint, r int, g int, b int")
    return px.background_labels(lab, pal, GRID, GRID)


cte("feature_px", "SELECT t.*, s.density, (x % 5) / 5.0 AS centerline, (y % 7) / 7.0 AS boundary FROM typed t JOIN stitch_px s USING (design_id, y, x)", "typed", "stitch_px")
cte("mask_features", f"""
SELECT design_id, count(*) / {float(GRID * GRID)} AS area_ratio, (max(x) - min(x) + 1) / (max(y) - min(y) + 1) AS bbox_aspect, avg(density) AS density_mean, count_if(centerline > 0.35) / count(*) AS centerline_ratio,
  count_if(boundary > 0.35) / count(*) AS boundary_ratio, count_if(stitch_type = 1) / count(*) AS running_ratio, count_if(stitch_type = 2) / count(*) AS satin_ratio, count_if(stitch_type = 3) / count(*) AS fill_ratio FROM feature_px GROUP BY 1""", "feature_px")
_FEAT = ("area_ratio", "bbox_aspect", "density_mean", "centerline_ratio", "boundary_ratio", "running_ratio", "satin_ratio", "fill_ratio")


def features(spark, sf):
    s = px.stitch_maps(hits(spark, sf)).select(*px.PX, "density")
    j = typed(spark, sf).join(s, px.PX).withColumns({"centerline": (F.col("x") % 5) / 5.0, "boundary": (F.col("y") % 7) / 7.0})
    return px.mask_features(j, GRID)


@query("mask_features", f"SELECT design_id, {r(*_FEAT)} FROM mask_features", "mask_features")
def mask_features(spark, sf):
    return tidy(features(spark, sf))


@query("planner_prior", """
SELECT design_id, CASE WHEN dense THEN 2 ELSE 3 END AS row_step_px, CASE WHEN busy THEN 90 ELSE 60 END AS max_components, CASE WHEN centerline_ratio > 0.06 THEN 2.0 ELSE 1.2 END::DOUBLE AS connect_near_mm,
  CASE WHEN dense THEN 3.6 ELSE 4.0 END::DOUBLE AS max_stitch_mm, true AS serpentine_fill FROM (SELECT *, boundary_ratio > 0.16 OR centerline_ratio > 0.10 AS busy, fill_ratio >= 0.45 OR area_ratio >= 0.18 AS dense FROM mask_features)""", "mask_features")
def planner_priors(spark, sf):
    f = features(spark, sf).withColumn("p", planner_prior(nodes=F.lit(0), long_ratio=F.lit(0.0)))
    return f.select("design_id", "p.row_step_px", "p.max_components", "p.connect_near_mm", "p.max_stitch_mm", "p.serpentine_fill")


@query("axis_directions", """
SELECT design_id, y, x, round_even(CASE WHEN m > 1e-6 THEN cos(2.0 * a) ELSE 0.0 END, 6) + 0.0 AS axis_x, round_even(CASE WHEN m > 1e-6 THEN sin(2.0 * a) ELSE 0.0 END, 6) + 0.0 AS axis_y, round_even(CASE WHEN m > 1e-6 THEN least(1.0, m) ELSE 0.0 END, 6) AS confidence
FROM (SELECT *, sqrt(dir_x * dir_x + dir_y * dir_y) AS m, atan2(dir_y, dir_x) AS a FROM stitch_px) WHERE m > 0.05""", "stitch_px")
def axis_directions(spark, sf):
    m = px.stitch_maps(hits(spark, sf)).withColumns(axis_direction("dir_x", "dir_y"))
    t = tidy(m.filter(F.sqrt(F.col("dir_x") * F.col("dir_x") + F.col("dir_y") * F.col("dir_y")) > 0.05).select(*px.PX, "axis_x", "axis_y", "confidence"))
    return t.withColumns({"axis_x": F.col("axis_x") + 0.0, "axis_y": F.col("axis_y") + 0.0})


@query("direction_confidence_stats", """
SELECT design_id, round_even(avg(c), 6) AS mean_direction_confidence, round_even(count_if(c < 0.2) / count(*), 6) AS low_direction_confidence_ratio, count_if(c >= 0.35) AS axis_valid_pixels, round_even(count_if(c >= 0.35) / count(*), 6) AS axis_valid_coverage_on_mask
FROM (SELECT design_id, least(1.0, sqrt(dir_x * dir_x + dir_y * dir_y)) AS c FROM stitch_px) GROUP BY 1""", "stitch_px")
def direction_confidence_stats(spark, sf):
    c = F.least(F.lit(1.0), F.sqrt(F.col("dir_x") * F.col("dir_x") + F.col("dir_y") * F.col("dir_y")))
    return tidy(px.direction_confidence_stats(px.stitch_maps(hits(spark, sf)).select("design_id", c.alias("confidence"))))


@query("trimap_to_mask", """
SELECT design_id, y, x FROM (SELECT *, max(v) OVER (PARTITION BY design_id) AS m FROM (SELECT design_id, y, x, (x + y) % (3 + design_id % 3) AS v FROM masks)) WHERE CASE WHEN m <= 3 THEN v IN (1, 3) ELSE v > 0 END""", "masks")
def trimap_to_mask(spark, sf):
    return px.trimap_to_mask(masks(spark, sf).withColumn("value", (F.col("x") + F.col("y")) % (F.col("design_id") % 3 + 3)))


def labelled(spark, sf):
    return comp.connected_components(typed(spark, sf).select(*px.PX, "color_layer"), ["design_id", "color_layer"])


cte("labelled", """
WITH RECURSIVE runs AS (
  SELECT design_id, color_layer, y, min(x) AS x0, max(x) AS x1, y * 1048576::BIGINT + min(x) AS run
  FROM (SELECT *, x - row_number() OVER (PARTITION BY design_id, color_layer, y ORDER BY x) AS g FROM typed) GROUP BY design_id, color_layer, y, g),
met AS (SELECT a.design_id, a.color_layer, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.design_id = b.design_id AND a.color_layer = b.color_layer AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
spread(design_id, color_layer, run, label) USING KEY (design_id, color_layer, run) AS (
  SELECT design_id, color_layer, run, run FROM runs
  UNION SELECT m.design_id, m.color_layer, m.b, min(s.label) FROM spread s JOIN met m ON m.design_id = s.design_id AND m.color_layer = s.color_layer AND m.a = s.run
    JOIN recurring.spread c ON c.design_id = m.design_id AND c.color_layer = m.color_layer AND c.run = m.b WHERE s.label < c.label GROUP BY 1, 2, 3)
SELECT t.design_id, t.color_layer, t.y, t.x, s.label AS component FROM typed t JOIN runs r ON r.design_id = t.design_id AND r.color_layer = t.color_layer AND r.y = t.y AND t.x BETWEEN r.x0 AND r.x1
JOIN spread s ON s.design_id = r.design_id AND s.color_layer = r.color_layer AND s.run = r.run""", "typed")
cte("component_areas", "SELECT design_id, color_layer, component, count(*) AS area_px FROM labelled GROUP BY 1, 2, 3", "labelled")


@query("connected_components", "SELECT * FROM labelled", "labelled")
def connected_components(spark, sf):
    return labelled(spark, sf)


@query("component_order", """
SELECT *, row_number() OVER (PARTITION BY design_id, color_layer ORDER BY area_px DESC, component) AS component_rank FROM component_areas WHERE area_px >= 2""", "component_areas")
def component_order(spark, sf):
    return comp.component_order(comp.component_sizes(labelled(spark, sf), ["design_id", "color_layer"], 2), ["design_id", "color_layer"])


@query("drop_small_components", """
SELECT design_id, color_layer, CAST(coalesce(sum(area_px) FILTER (area_px < 6 AND m >= 6), 0) AS BIGINT) AS removed_pixels, count(*) AS components_total
FROM (SELECT *, max(area_px) OVER (PARTITION BY design_id, color_layer) AS m FROM component_areas) GROUP BY 1, 2""", "component_areas")
def drop_small_components(spark, sf):
    return comp.drop_small_components(labelled(spark, sf), 6, ["design_id", "color_layer"])[1]


@query("kept_components", """
SELECT l.design_id, l.color_layer, y, x FROM labelled l JOIN (SELECT *, max(area_px) OVER (PARTITION BY design_id, color_layer) AS m FROM component_areas) a
  ON a.design_id = l.design_id AND a.color_layer = l.color_layer AND a.component = l.component WHERE area_px >= 6 OR m < 6""", "labelled", "component_areas")
def kept_components(spark, sf):
    return comp.drop_small_components(labelled(spark, sf), 6, ["design_id", "color_layer"])[0].select("design_id", "color_layer", "y", "x")


cte("shaped", """
SELECT design_id, color_layer, color_layer * 4294967296 + component AS node_id, x, y, stitch_type FROM labelled JOIN typed USING (design_id, color_layer, y, x)""", "labelled", "typed")
cte("nodes", """
SELECT design_id, node_id, any_value(color_layer) AS color_layer, count(*) AS area_px, avg(x) AS cx, avg(y) AS cy, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
  CASE WHEN count(*) < 3 THEN 0.0 ELSE 0.5 * atan2((2 * (count(*) * sum(x * y) - sum(x) * sum(y)))::DOUBLE, (count(*) * (sum(x * x) - sum(y * y)) - sum(x) * sum(x) + sum(y) * sum(y))::DOUBLE) END AS obb_angle,
  CASE WHEN count_if(stitch_type = 1) >= greatest(count_if(stitch_type = 2), count_if(stitch_type = 3)) THEN 1 WHEN count_if(stitch_type = 2) >= count_if(stitch_type = 3) THEN 2 ELSE 3 END AS stitch_type FROM shaped GROUP BY 1, 2""", "shaped")
cte("boxes", """
SELECT n.design_id, n.node_id, max(u) AS u1, min(u) AS u0, max(v) AS v1, min(v) AS v0 FROM (
  SELECT n.design_id, n.node_id, cos(obb_angle) * (s.x - cx) + sin(obb_angle) * (s.y - cy) AS u, cos(obb_angle) * (s.y - cy) - sin(obb_angle) * (s.x - cx) AS v FROM shaped s JOIN nodes n USING (design_id, node_id)) n GROUP BY 1, 2""", "shaped", "nodes")


def nodes(spark, sf):
    """A node for each component, of every color; components that aren't of one color never touch."""
    types = {f"type_{c}": F.col("stitch_type") == c for c in (1, 2, 3)}
    runs = comp.component_runs(typed(spark, sf), ["design_id", "color_layer"], marks=types)
    shaped = runs.withColumn("node_id", F.col("color_layer") * 4294967296 + F.col("component"))
    return comp.component_nodes(shaped, ["design_id", "node_id"])


@query("component_nodes", """
SELECT n.design_id, n.node_id, area_px, round_even(cx, 3) AS centroid_x, round_even(cy, 3) AS centroid_y, min_x, min_y, max_x, max_y,
  round_even(CASE WHEN area_px < 3 THEN cx ELSE cx + cos(obb_angle) * (u0 + u1) / 2.0 - sin(obb_angle) * (v0 + v1) / 2.0 END, 5) AS obb_cx,
  round_even(CASE WHEN area_px < 3 THEN cy ELSE cy + sin(obb_angle) * (u0 + u1) / 2.0 + cos(obb_angle) * (v0 + v1) / 2.0 END, 5) AS obb_cy,
  round_even(CASE WHEN area_px < 3 THEN 1.0 ELSE u1 - u0 END, 5) AS obb_w, round_even(CASE WHEN area_px < 3 THEN 1.0 ELSE v1 - v0 END, 5) AS obb_h, round_even(obb_angle, 5) AS obb_angle, stitch_type
FROM nodes n JOIN boxes USING (design_id, node_id)""", "nodes", "boxes")
def component_nodes(spark, sf):
    return nodes(spark, sf).drop("boundary_mean")


@query("component_graph", """
SELECT a.design_id, a.node_id AS source, b.node_id AS target, round_even(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * CASE WHEN a.c = b.c THEN 0.65 ELSE 1.0 END, 4) AS cost, a.c = b.c AS same_color
FROM (SELECT design_id, node_id, color_layer AS c, round_even(cx, 3) AS x, round_even(cy, 3) AS y FROM nodes) a JOIN (SELECT design_id, node_id, color_layer AS c, round_even(cx, 3) AS x, round_even(cy, 3) AS y FROM nodes) b ON a.design_id = b.design_id AND a.node_id <> b.node_id
QUALIFY row_number() OVER (PARTITION BY a.design_id, a.node_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * CASE WHEN a.c = b.c THEN 0.65 ELSE 1.0 END, b.node_id) <= 4""", "nodes")
def component_graph(spark, sf):
    return comp.component_graph(nodes(spark, sf).withColumn("color_layer", F.floor(F.col("node_id") / 4294967296)))
