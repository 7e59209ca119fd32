"""Stitch-shaped views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import order_number
from ..functions.scores import texture_score, unified_score
from .registry import Tables, cte

GRID = 64


def commands(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events
    i = F.col("event_id")
    command = (
        F.when(i % 13 == 0, "TRIM").when(i % 17 == 0, "COLOR_CHANGE").when(i % 29 == 0, "END")
        .when(i % 31 == 0, "unsupported_9").when(F.col("event_type") == "signup", "JUMP").otherwise("STITCH"))
    rows = e.select(
        F.col("user_id").alias("design_id"), "ts", "event_id", command.alias("command"),
        (F.col("value") / 100.0 + F.when(i % 11 == 0, 9).otherwise(0)).alias("x_mm"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("y_mm"))
    n = order_number(rows, ["design_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "n")
    return n.select("design_id", (F.col("n") - 1).alias("seq"), "command", "x_mm", "y_mm", "event_id")


cte("commands", """
SELECT user_id AS design_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CASE WHEN event_id % 13 = 0 THEN 'TRIM' WHEN event_id % 17 = 0 THEN 'COLOR_CHANGE' WHEN event_id % 29 = 0 THEN 'END'
       WHEN event_id % 31 = 0 THEN 'unsupported_9' WHEN event_type = 'signup' THEN 'JUMP' ELSE 'STITCH' END AS command,
  value / 100.0 + CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END AS x_mm,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS y_mm, event_id
FROM events""")
cte("deltas", """
SELECT *, x_mm - prev_x AS dx_mm, y_mm - prev_y AS dy_mm,
  coalesce(sqrt((x_mm - prev_x) * (x_mm - prev_x) + (y_mm - prev_y) * (y_mm - prev_y)), 0.0) AS distance_mm,
  prev_x IS NOT NULL AS has_prev
FROM (SELECT *, lag(x_mm) OVER w AS prev_x, lag(y_mm) OVER w AS prev_y FROM commands
      WINDOW w AS (PARTITION BY design_id ORDER BY seq))""", "commands")
cte("segments", """
SELECT design_id, row_number() OVER (PARTITION BY design_id ORDER BY seq) AS segment_id, color_no + 1 AS color_layer,
  seq AS source_order, prev_x AS entry_x_mm, prev_y AS entry_y_mm, x_mm AS exit_x_mm, y_mm AS exit_y_mm,
  distance_mm AS length_mm
FROM (SELECT *, CAST(sum(CASE WHEN command = 'COLOR_CHANGE' THEN 1 ELSE 0 END)
        OVER (PARTITION BY design_id ORDER BY seq) AS BIGINT) AS color_no FROM deltas)
WHERE command = 'STITCH' AND has_prev""", "deltas")


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """A grid mask per design whose pattern depends on the design."""
    designs = Tables(spark, sf).events.select(F.col("user_id").alias("design_id")).distinct()
    cell = designs.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))))
    y, x = F.floor(F.col("cell") / GRID).cast("int"), (F.col("cell") % GRID).cast("int")
    return cell.select("design_id", y.alias("y"), x.alias("x")).filter(
        (F.col("x") * 7 + F.col("y") * 3 + F.col("design_id")) % 5 < 3)


cte("masks", f"""
SELECT design_id, CAST(c // {GRID} AS INTEGER) AS y, CAST(c % {GRID} AS INTEGER) AS x
FROM (SELECT DISTINCT user_id AS design_id FROM events), range({GRID * GRID}) t(c)
WHERE ((c % {GRID}) * 7 + (c // {GRID}) * 3 + design_id) % 5 < 3""")

CANDIDATE_NAMES = (
    "base_keep", "skeleton_auto", "mask_fill_edgewalk_inset2_rows16_p40", "mask_fill_nearestrow_adapt_t1p5_m3",
    "styleaware_outline", "mask_fill_satinrail_strict", "dtsatin_quantvalid_inset1")
SOURCES = {"AUTOMOBILE": "QuickDraw", "BUILDING": "Rendered text", "FURNITURE": "Openclipart", "HOUSEHOLD": "OpenMoji"}


def _source(segment: Column) -> Column:
    out = None
    for k, v in SOURCES.items():
        out = F.when(segment == k, v) if out is None else out.when(segment == k, v)
    return out.otherwise("TextRender")


_SOURCE_SQL = ("CASE " + " ".join(f"WHEN c_mktsegment = '{k}' THEN '{v}'" for k, v in SOURCES.items())
               + " ELSE 'TextRender' END")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("sample_id"), _source(F.col("c_mktsegment")).alias("source_name"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.month("o_orderdate") <= 6, "core").otherwise("full").alias("phase"),
        F.concat(F.lit("designs/"), F.lower("n_name"), F.lit("/"), F.regexp_replace("c_name", "Customer#0*", "cust"),
                 F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".dst")).alias("source_dst"),
        "o_totalprice", F.col("o_orderstatus").alias("old_status"))


cte("manifest", f"""
SELECT o_orderkey AS sample_id, {_SOURCE_SQL} AS source_name, o_orderpriority AS category,
  CASE WHEN month(o_orderdate) <= 6 THEN 'core' ELSE 'full' END AS phase,
  'designs/' || lower(n_name) || '/' || regexp_replace(c_name, 'Customer#0*', 'cust') || '_' || o_orderkey || '.dst' AS source_dst,
  o_totalprice, o_orderstatus AS old_status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


def _metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the metrics follow from. A sample's rows are brought together once: its groups, its manifest row and its pool meet where they lie."""
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_extendedprice", "l_partkey")
    return lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.sum("l_quantity").cast("long").alias("q"), F.round(F.avg("l_tax"), 6).alias("tax"),
        F.round(F.avg("l_discount"), 6).alias("disc"), F.max("l_extendedprice").alias("price"),
        F.min("l_partkey").alias("partkey"))


def _metric_columns() -> list[Column]:
    q = F.col("q")
    name = F.get(F.array(*[F.lit(n) for n in CANDIDATE_NAMES]), F.col("ordinal") - 1)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return [
        F.col("sample_id"), F.col("ordinal"), name.alias("candidate"), q, F.col("partkey"), (q % 41 != 0).alias("round_trip_parse_success"),
        (q % 30).alias("jump_count"), (q % 9).alias("trim_count"), r6(F.col("price") / 50.0, "jump_path_mm"),
        r6(100.0 * F.col("tax"), "off_mask_stitch_length_mm"),
        F.when(q % 7 == 0, 2).otherwise(0).cast("long").alias("visible_connector_count"),
        r6(F.when(q % 7 == 0, 3.5).otherwise(0.0), "visible_connector_length_mm"),
        r6(1.0 - 4.0 * F.col("disc"), "coverage_ratio"), r6(1.0 - 5.0 * F.col("tax"), "stitch_precision_ratio"),
        r6(1.0 - 3.0 * F.col("disc"), "adaptive_coverage_ratio"),
        r6(1.0 - 2.0 * F.col("tax"), "adaptive_stitch_precision_ratio"),
        r6(F.col("tax") * 2.0, "overfill_outside_adaptive_ratio"),
        (q * 3 % 40).alias("fill_rows"), (q * 7 % 90).alias("outline_points"), (q * 5 % 60).alias("satin_columns"),
        (q * 11 % 50).alias("satin_rail_segments"), (q * 13 % 30).alias("dt_satin_segments"),
        (q * 17 % 80).alias("style_running_points")]


def candidate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (sample, candidate) with its raw metrics."""
    return _metric_rows(spark, sf).select(*_metric_columns())


cte("candidate_metrics", """
SELECT sample_id, ordinal, [%s][ordinal] AS candidate, q, partkey, q %% 41 <> 0 AS round_trip_parse_success,
  q %% 30 AS jump_count, q %% 9 AS trim_count, round(price / 50.0, 6) AS jump_path_mm,
  round(100.0 * tax, 6) AS off_mask_stitch_length_mm, CAST(CASE WHEN q %% 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS visible_connector_count,
  CAST(CASE WHEN q %% 7 = 0 THEN 3.5 ELSE 0.0 END AS DOUBLE) AS visible_connector_length_mm,
  round(1.0 - 4.0 * disc, 6) AS coverage_ratio, round(1.0 - 5.0 * tax, 6) AS stitch_precision_ratio,
  round(1.0 - 3.0 * disc, 6) AS adaptive_coverage_ratio, round(1.0 - 2.0 * tax, 6) AS adaptive_stitch_precision_ratio,
  round(tax * 2.0, 6) AS overfill_outside_adaptive_ratio,
  q * 3 %% 40 AS fill_rows, q * 7 %% 90 AS outline_points, q * 5 %% 60 AS satin_columns,
  q * 11 %% 50 AS satin_rail_segments, q * 13 %% 30 AS dt_satin_segments, q * 17 %% 80 AS style_running_points
FROM (SELECT l_orderkey AS sample_id, l_linenumber AS ordinal, CAST(sum(l_quantity) AS BIGINT) AS q, round(avg(l_tax), 6) AS tax,
        round(avg(l_discount), 6) AS disc, max(l_extendedprice) AS price, min(l_partkey) AS partkey
      FROM lineitem GROUP BY 1, 2)""" % ", ".join(f"'{n}'" for n in CANDIDATE_NAMES))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate metrics with their scores, texture score and source."""
    origin = ("source_name", "category", "phase")
    # A merge join leaves a sample's rows where they lie; a broadcast of the pool, which looks small before it is made, would not.
    rows = _metric_rows(spark, sf).join(manifest(spark, sf).select("sample_id", *origin).hint("merge"), "sample_id")
    metrics = rows.select(*_metric_columns(), *origin)
    names = [c for c in metrics.columns if c not in origin]
    scored = metrics.withColumns({**unified_score(names), "generator_texture_score": texture_score()})
    return scored.select(*[c for c in scored.columns if c not in origin], *origin)


cte("scored_candidates", """
SELECT *, round_even(0.002 * fill_rows + 0.001 * outline_points + 0.006 * satin_columns + 0.010 * satin_rail_segments
    + 0.010 * dt_satin_segments + 0.004 * style_running_points, 8) AS generator_texture_score,
  round_even(0.30 * pf + 0.20 * tj + 0.12 * tt + 0.08 * tp + 0.18 * tm + 0.08 * tv + 0.04 * tl, 8) AS unified_loss,
  round_even(0.30 * pf + 0.20 * tj + 0.12 * tt + 0.08 * tp, 8) AS exec_score,
  round_even(0.18 * tm + 0.08 * tv + 0.04 * tl, 8) AS visual_risk,
  CASE WHEN pf = 1 THEN 'hard_fail'
       WHEN jump_count > 25 OR trim_count > 20 OR off_mask_stitch_length_mm > 8 OR visible_connector_count > 3 THEN 'hard_fail'
       WHEN jump_count > 15 OR trim_count > 10 OR off_mask_stitch_length_mm > 4 OR visible_connector_count > 1 THEN 'warning'
       WHEN jump_count <= 10 AND trim_count <= 6 AND off_mask_stitch_length_mm <= 2 AND visible_connector_count <= 0.5 THEN 'excellent'
       ELSE 'pass' END AS quality_level
FROM (SELECT *, CASE WHEN round_trip_parse_success THEN 0.0 ELSE 1.0 END::DOUBLE AS pf,
        least(1.0, jump_count / 25.0::DOUBLE) AS tj, least(1.0, trim_count / 20.0::DOUBLE) AS tt, least(1.0, jump_path_mm / 2500.0::DOUBLE) AS tp,
        least(1.0, off_mask_stitch_length_mm / 8.0::DOUBLE) AS tm, least(1.0, visible_connector_count / 3.0::DOUBLE) AS tv,
        least(1.0, visible_connector_length_mm / 20.0::DOUBLE) AS tl FROM candidate_metrics)""", "candidate_metrics")
cte("candidates", """
SELECT c.* EXCLUDE (pf, tj, tt, tp, tm, tv, tl), m.source_name, m.category, m.phase
FROM scored_candidates c JOIN manifest m USING (sample_id)""", "scored_candidates", "manifest")


def baseline(c: DataFrame) -> DataFrame:
    """The candidate registered first for each sample."""
    first = c.groupBy("sample_id").agg(F.min_by(F.struct(*[x for x in c.columns if x != "sample_id"]), "ordinal").alias("b"))
    return first.select("sample_id", "b.*")


cte("baseline", """
SELECT * EXCLUDE (first_ordinal) FROM (SELECT *, min(ordinal) OVER (PARTITION BY sample_id) AS first_ordinal FROM candidates)
WHERE ordinal = first_ordinal""", "candidates")


LABEL_STEPS = {"base_keep": 7, "running_line": 11, "auto_running": 13, "auto_fill": 17, "fill_tatami_like": 19,
               "satin_like": 23, "outline_border": 29, "reject": 31}


def policy_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with preview, texture, skeleton and selector columns."""
    from ..functions.scalars import candidate_family
    from ..functions.scores import preview_scores
    from ..operators.policies import predicted_family
    q, ordinal = F.col("q"), F.col("ordinal")
    c = candidates(spark, sf).withColumns({
        "candidate_family": candidate_family("candidate", "sweep"),
        "angle_entropy": (q * 7 % 19) / 19.0, "dominant_angle_mass": (q % 11) / 11.0,
        "mean_stitch_length_mm": 1.0 + (q % 37) / 10.0, "stitch_length_cv": (q % 5) / 10.0,
        "long_stitch_ratio": (q % 13) / 50.0, "stitch_density_per_100mm2": (q % 29) / 5.0,
        "illegal_long_stitch_count": F.when(q % 41 == 0, 1).otherwise(0).cast("long"),
        "rail_and_dt_segments": F.col("satin_rail_segments") + F.col("dt_satin_segments"),
        "satin_like_segments": F.col("satin_columns") + F.col("satin_rail_segments") + F.col("dt_satin_segments"),
        "skeleton_coverage_ratio": F.round(1.0 - 0.5 * (1.0 - F.col("coverage_ratio")), 6),
        "adaptive_skeleton_coverage_ratio": F.round(1.0 - 0.1 * (1.0 - F.col("coverage_ratio")), 6),
        "policy_pass": q % 5 != 0, "executable_candidate": q % 37 != 0,
        **{f"score_{n}": ((q * k + ordinal * 3) % 101) / 100.0 for n, k in LABEL_STEPS.items()},
    })
    return c.withColumns({**preview_scores(), "predicted_family": predicted_family()})


cte("policy_pool", """
SELECT *, round_even(greatest(0.0, least(1.0, 0.25 * xc + 0.18 * xd + 0.18 * xr + 0.17 * xo + 0.14 * xf + 0.08 * xs)), 8) AS professional_preview_score,
  round_even(xd, 8) AS density_score, round_even(xr, 8) AS rhythm_score, round_even(xo, 8) AS directional_score,
  round_even(xf, 8) AS family_texture_score_norm,
  CASE WHEN score_reject >= best_score THEN 'reject' WHEN score_base_keep = best_score THEN 'base_keep' WHEN score_running_line = best_score THEN 'running_line'
    WHEN score_auto_running = best_score THEN 'auto_running' WHEN score_auto_fill = best_score THEN 'auto_fill'
    WHEN score_fill_tatami_like = best_score THEN 'fill_tatami_like' WHEN score_satin_like = best_score THEN 'satin_like'
    ELSE 'outline_border' END AS predicted_family
FROM (SELECT *, greatest(%s) AS best_score,
    greatest(0.0, least(1.0, 0.55 * coverage_ratio + 0.45 * greatest(stitch_precision_ratio, adaptive_stitch_precision_ratio))) AS xc,
    least(1.0, stitch_density_per_100mm2 / 5.0) AS xd,
    greatest(0.0, least(1.0, 1.0 - abs(mean_stitch_length_mm - 2.2) / 2.8)) * greatest(0.0, least(1.0, 1.0 - 0.75 * stitch_length_cv)) AS xr,
    greatest(0.0, least(1.0, 0.55 * dominant_angle_mass + 0.45 * greatest(0.0, least(1.0, 1.0 - abs(angle_entropy - 0.42) / 0.42)))) AS xo,
    least(1.0, generator_texture_score / 0.75) AS xf,
    greatest(0.0, least(1.0, 1.0 - 0.20 * visible_connector_count - 0.02 * off_mask_stitch_length_mm - 0.10 * illegal_long_stitch_count - 0.35 * long_stitch_ratio)) AS xs
  FROM (SELECT *, CASE WHEN candidate LIKE '%%dtsatin%%' THEN 'dt_satin' WHEN candidate LIKE '%%satin%%' THEN 'satin_like' WHEN candidate LIKE '%%outline%%' THEN 'outline_border'
      WHEN candidate LIKE '%%edgewalk%%' THEN 'edgewalk_fill' WHEN candidate LIKE '%%nearestrow%%' THEN 'nearestrow_fill' WHEN candidate LIKE '%%mask_fill%%' THEN 'mask_fill' ELSE 'other' END AS candidate_family,
    (q * 7 %% 19) / 19.0::DOUBLE AS angle_entropy, (q %% 11) / 11.0::DOUBLE AS dominant_angle_mass, 1.0 + (q %% 37) / 10.0::DOUBLE AS mean_stitch_length_mm,
    (q %% 5) / 10.0::DOUBLE AS stitch_length_cv, (q %% 13) / 50.0::DOUBLE AS long_stitch_ratio, (q %% 29) / 5.0::DOUBLE AS stitch_density_per_100mm2,
    CASE WHEN q %% 41 = 0 THEN 1 ELSE 0 END AS illegal_long_stitch_count, satin_rail_segments + dt_satin_segments AS rail_and_dt_segments,
    satin_columns + satin_rail_segments + dt_satin_segments AS satin_like_segments, round(1.0 - 0.5 * (1.0 - coverage_ratio), 6) AS skeleton_coverage_ratio,
    round(1.0 - 0.1 * (1.0 - coverage_ratio), 6) AS adaptive_skeleton_coverage_ratio, q %% 5 <> 0 AS policy_pass, q %% 37 <> 0 AS executable_candidate, %s
  FROM candidates))""" % (", ".join(f"score_{n}" for n in LABEL_STEPS),
                          ", ".join(f"((q * {k} + ordinal * 3) % 101) / 100.0::DOUBLE AS score_{n}" for n, k in LABEL_STEPS.items())), "candidates")
cte("pool_base", """
SELECT * FROM policy_pool QUALIFY ordinal = min(ordinal) OVER (PARTITION BY sample_id)""", "policy_pool")
