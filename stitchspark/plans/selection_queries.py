"""Queries of rankings, choosers, summaries, risk audit, Pareto fronts and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import in_file_order
from ..functions.scores import hard_score
from ..functions.semantics import half_even
from ..operators import gates, pareto, ranking, summaries
from .fixtures import CANDIDATE_NAMES, baseline, candidates, manifest, policy_pool
from .registry import Tables, cte, query, r, tidy

PROFILES = ("balanced", "low_jump", "precision")
STRENGTH = 0.65
_M = ranking.POOL_METRICS


def predicted(df):
    return df.withColumn("predicted_score", ((F.col("q") * 37 + F.col("ordinal") * 11) % 1000) / 1000.0)


cte("ranked", """
SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY predicted_score, ordinal) - 1) / greatest(1, count(*) OVER (PARTITION BY sample_id) - 1) AS learned_rank_score,
  row_number() OVER (PARTITION BY sample_id ORDER BY predicted_score, ordinal) AS pool_rank, count(*) OVER (PARTITION BY sample_id) AS pool_size
FROM (SELECT *, ((q * 37 + ordinal * 11) % 1000) / 1000.0::DOUBLE AS predicted_score FROM candidates)""", "candidates")


@query("learned_rank", f"SELECT sample_id, candidate, pool_rank, pool_size, {r('learned_rank_score')} FROM ranked", "ranked")
def learned_rank(spark, sf):
    return tidy(ranking.learned_rank(predicted(candidates(spark, sf)), "predicted_score").select(
        "sample_id", "candidate", "pool_rank", "pool_size", "learned_rank_score"))


def _norm(m: str) -> str:
    n = f"CASE WHEN abs(hi_{m} - lo_{m}) < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, ({m} - lo_{m}) / (hi_{m} - lo_{m}))) END"
    return f"(1.0 - ({n}))" if m in ranking.HIGH_IS_GOOD else f"({n})"


def _profile(p: str) -> str:
    return " + ".join(f"{w}::DOUBLE * n_{m}" for m, w in ranking.PROFILE_WEIGHTS[p].items())


cte("reranked", f"""
SELECT *, {1.0 - STRENGTH}::DOUBLE * learned_rank_score + {STRENGTH}::DOUBLE * semantic_score AS calibrated_score FROM (
  SELECT *, CASE task_profile WHEN 'low_jump' THEN {_profile('low_jump')} WHEN 'precision' THEN {_profile('precision')} ELSE {_profile('balanced')} END
    + 0.35::DOUBLE * greatest(0.0, floor_cov - coverage_ratio) AS semantic_score
  FROM (SELECT *, {', '.join(f'{_norm(m)}::DOUBLE AS n_{m}' for m in _M)}, CASE WHEN task_profile = 'precision' THEN 0.88::DOUBLE ELSE 0.90::DOUBLE END AS floor_cov
    FROM (SELECT *, {', '.join(f'min({m}) OVER w AS lo_{m}, max({m}) OVER w AS hi_{m}' for m in _M)}
      FROM ranked, (SELECT unnest(['balanced', 'low_jump', 'precision']) AS task_profile) WINDOW w AS (PARTITION BY sample_id))))""", "ranked")


def reranked(spark, sf, profiles=PROFILES):
    # A pool has the same spans in every profile: they are found before its rows are multiplied.
    pool = predicted(candidates(spark, sf)).select("sample_id", "candidate", "ordinal", "source_name", "predicted_score", *_M)
    wide = ranking.expand_profiles(ranking.with_spans(ranking.learned_rank(pool, "predicted_score")), profiles)
    return ranking.profile_rerank(wide, STRENGTH, ranking.COVERAGE_FLOORS, 0.35)


@query("profile_rerank", f"SELECT sample_id, candidate, task_profile, {r('semantic_score', 'calibrated_score')} FROM reranked", "reranked")
def profile_rerank(spark, sf):
    return tidy(reranked(spark, sf).select("sample_id", "candidate", "task_profile", "semantic_score", "calibrated_score"))


@query("coverage_constraint", f"""
SELECT sample_id, task_profile, candidate AS chosen_candidate, {r('calibrated_score', 'coverage_ratio')}, level = 0 AS constraint_met
FROM (SELECT *, CASE WHEN coverage_ratio + 1e-9 >= floor_cov THEN 0 WHEN coverage_ratio + 1e-9 >= floor_cov - 0.03::DOUBLE THEN 1 ELSE 2 END AS level FROM reranked)
QUALIFY row_number() OVER (PARTITION BY sample_id, task_profile ORDER BY level, calibrated_score, learned_rank_score, ordinal) = 1""", "reranked")
def coverage_constraint(spark, sf):
    return tidy(ranking.coverage_constraint(reranked(spark, sf), ranking.COVERAGE_FLOORS))


cte("benefit", """
SELECT sample_id, task_profile, base_candidate, base_loss, coalesce(acc.candidate, base_candidate) AS chosen_candidate, coalesce(acc.unified_loss, base_loss) AS chosen_loss,
  coalesce(acc.ordinal, base_ordinal) AS chosen_ordinal, coalesce(acc.mode, 'safe_fallback') AS gate_mode, acc.mode IS NOT NULL OR any_safe AS gate_met
FROM (SELECT sample_id, task_profile, candidate AS base_candidate, ordinal AS base_ordinal, unified_loss AS base_loss, jump_count AS base_jump, safe AS any_safe
    FROM safe_rows QUALIFY row_number() OVER (PARTITION BY sample_id, task_profile ORDER BY NOT safe, calibrated_score, learned_rank_score, ordinal) = 1) b
LEFT JOIN (SELECT * FROM (SELECT s.*, CASE WHEN safe THEN 'safe_coverage' WHEN coverage_ratio + 1e-9 >= 0.65 AND b.base_jump - jump_count + 1e-9 >= 3.0
      AND stitch_precision_ratio + 1e-9 >= 0.8 AND unified_loss - b.base_loss <= 0.02 + 1e-9 THEN 'benefit_tradeoff' END AS mode
    FROM safe_rows s JOIN (SELECT sample_id, task_profile, jump_count AS base_jump, unified_loss AS base_loss FROM safe_rows
      QUALIFY row_number() OVER (PARTITION BY sample_id, task_profile ORDER BY NOT safe, calibrated_score, learned_rank_score, ordinal) = 1) b USING (sample_id, task_profile))
  WHERE mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id, task_profile ORDER BY calibrated_score, learned_rank_score, ordinal) = 1) acc USING (sample_id, task_profile)""", "safe_rows")
cte("safe_rows", "SELECT *, coverage_ratio + 1e-9 >= floor_cov AS safe FROM reranked", "reranked")


@query("benefit_gate", "SELECT sample_id, task_profile, base_candidate, chosen_candidate, gate_mode, gate_met FROM benefit", "benefit")
def benefit_gate(spark, sf):
    return ranking.benefit_gate(reranked(spark, sf), ranking.COVERAGE_FLOORS).select(
        "sample_id", "task_profile", F.col("base.candidate").alias("base_candidate"), F.col("chosen.candidate").alias("chosen_candidate"), "gate_mode", "gate_met")


def _line_input(spark, sf):
    return ranking.benefit_rows(reranked(spark, sf, ("low_jump",)), ranking.COVERAGE_FLOORS, key=("sample_id",))


_EPS = "+ 1e-9"
cte("line_base", """SELECT r.* FROM reranked r JOIN benefit b ON r.sample_id = b.sample_id AND r.task_profile = 'low_jump' AND b.task_profile = 'low_jump' AND r.ordinal = b.chosen_ordinal""", "reranked", "benefit")
cte("line_pool", """
SELECT r.*, b.candidate AS b_candidate, b.unified_loss AS b_loss, b.jump_count AS b_jump, b.coverage_ratio AS b_cov, b.stitch_precision_ratio AS b_prec,
  b.visible_connector_count AS b_vis, b.off_mask_stitch_length_mm AS b_off, b.ordinal AS b_ordinal
FROM reranked r JOIN line_base b USING (sample_id) WHERE r.task_profile = 'low_jump' AND r.source_name IN ('QuickDraw', 'Rendered text')""", "reranked", "line_base")
cte("line_guard", """
SELECT sample_id, g.ordinal AS g_ordinal, g.unified_loss - g.b_loss > 0.03 + 1e-9 AS slack, g.b_ordinal, rel.ordinal AS rel_ordinal
FROM (SELECT *, coverage_ratio + 1e-9 >= 0.6 AND stitch_precision_ratio + 1e-9 >= 0.45 AND jump_count <= 10.0 + 1e-9 AND off_mask_stitch_length_mm <= 1.0 + 1e-9
      AND visible_connector_count <= 1e-9 AND trim_count <= 6.0 + 1e-9 AS valid FROM line_pool
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY NOT (coverage_ratio + 1e-9 >= 0.6 AND stitch_precision_ratio + 1e-9 >= 0.45 AND jump_count <= 10.0 + 1e-9
      AND off_mask_stitch_length_mm <= 1.0 + 1e-9 AND visible_connector_count <= 1e-9 AND trim_count <= 6.0 + 1e-9),
      unified_loss + 0.004 * jump_count + 0.002 * trim_count + 0.01 * off_mask_stitch_length_mm + 0.005 * visible_connector_count
        + 0.55 * greatest(0.0, 0.88 - coverage_ratio) + 0.22 * greatest(0.0, 0.75 - stitch_precision_ratio), calibrated_score, learned_rank_score, ordinal) = 1) g
LEFT JOIN (SELECT * FROM line_pool WHERE coverage_ratio + 1e-9 >= 0.7 AND jump_count <= b_jump - 1.0 + 1e-9 AND unified_loss <= b_loss + 1e-9
      AND coverage_ratio + 0.05 + 1e-9 >= b_cov AND stitch_precision_ratio + 0.02 + 1e-9 >= b_prec AND visible_connector_count <= b_vis + 1e-9 AND off_mask_stitch_length_mm <= b_off + 1e-9
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY unified_loss + 0.004 * jump_count + 0.2 * greatest(0.0, 0.8 - coverage_ratio)
      + 0.1 * greatest(0.0, 0.7 - stitch_precision_ratio), calibrated_score, learned_rank_score, ordinal) = 1) rel USING (sample_id)""", "line_pool")
cte("line_current", """
SELECT l.sample_id, CASE WHEN slack THEN 'baseline_loss_guard' ELSE 'line_domain_guard' END AS guard_mode,
  CASE WHEN rel_ordinal IS NOT NULL THEN 'relative_rescue' ELSE 'no_rescue_candidate' END AS rescue_mode, c.*
FROM line_guard l JOIN (SELECT sample_id AS sid, ordinal AS c_ordinal, candidate AS c_candidate, unified_loss AS c_loss, jump_count AS c_jump, trim_count AS c_trim,
   coverage_ratio AS c_cov, stitch_precision_ratio AS c_prec, visible_connector_count AS c_vis, off_mask_stitch_length_mm AS c_off FROM line_pool) c
  ON sid = l.sample_id AND c_ordinal = coalesce(rel_ordinal, CASE WHEN slack THEN b_ordinal ELSE g_ordinal END)""", "line_guard", "line_pool")


@query("line_guard_chain", f"""
SELECT b.sample_id, b.candidate AS base_candidate, coalesce(pr.candidate, c.c_candidate, b.candidate) AS chosen_candidate,
  round_even(coalesce(pr.unified_loss, c.c_loss, b.unified_loss), 6) AS unified_loss, coalesce(guard_mode, 'non_line_domain') AS guard_mode, coalesce(rescue_mode, '') AS rescue_mode,
  CASE WHEN guard_mode IS NULL THEN '' WHEN c_prec + 1e-9 >= 0.6 THEN 'precision_not_low' WHEN pr.candidate IS NULL THEN 'no_precision_rescue_candidate' ELSE 'precision_rescue' END AS precision_mode
FROM line_base b LEFT JOIN line_current c USING (sample_id)
LEFT JOIN (SELECT p.sample_id, p.candidate, p.unified_loss FROM line_pool p JOIN line_current c USING (sample_id)
  WHERE c_prec + 1e-9 < 0.6 AND stitch_precision_ratio + 1e-9 >= 0.65 AND stitch_precision_ratio - c_prec + 1e-9 >= 0.1 AND coverage_ratio + 1e-9 >= 0.85
    AND coverage_ratio + 0.08 + 1e-9 >= c_cov AND unified_loss <= c_loss + 0.06 + 1e-9 AND jump_count <= c_jump + 6.0 + 1e-9 AND trim_count <= c_trim + 2.0 + 1e-9
    AND visible_connector_count <= c_vis + 1e-9 AND off_mask_stitch_length_mm <= c_off + 1e-9
  QUALIFY row_number() OVER (PARTITION BY p.sample_id ORDER BY p.unified_loss + 0.004 * p.jump_count + 0.002 * p.trim_count + 0.2 * greatest(0.0, 0.9 - p.coverage_ratio)
    - 0.1 * (p.stitch_precision_ratio - c_prec), p.calibrated_score, p.learned_rank_score, p.ordinal) = 1) pr USING (sample_id)""", "line_base", "line_current", "line_pool")
def line_guard_chain(spark, sf):
    return tidy(ranking.line_guard_chain(_line_input(spark, sf)))


@query("anchored_baseline", """
SELECT b.sample_id, CASE WHEN b.source_name = 'TextRender' THEN 'no_anchor_row' WHEN b.source_name = 'OpenMoji' THEN 'missing_anchor_candidate' WHEN a.candidate IS NULL THEN 'anchor_candidate_not_found' ELSE 'anchored_baseline' END AS anchor_mode,
  coalesce(a.candidate, b.candidate) AS chosen_candidate
FROM line_base b LEFT JOIN (SELECT sample_id, candidate FROM line_base_pool WHERE candidate = 'skeleton_auto' AND source_name NOT IN ('TextRender', 'OpenMoji')) a USING (sample_id)""", "line_base", "line_base_pool")
def anchored_baseline(spark, sf):
    source = F.col("chosen.source_name")
    anchor = F.when(source == "OpenMoji", "").when(source != "TextRender", "skeleton_auto")
    return ranking.anchored_rows(_line_input(spark, sf), anchor).select("sample_id", "anchor_mode", F.col("chosen.candidate").alias("chosen_candidate"))


cte("line_base_pool", "SELECT * FROM reranked WHERE task_profile = 'low_jump'", "reranked")

_MG = "off_mask_stitch_length_mm <= 0.05 AND jump_count <= {j} AND trim_count <= 3.0 AND stitch_precision_ratio >= {p} AND coverage_ratio >= 0.8"
cte("pooled", """
SELECT * FROM (SELECT *, count_if(g4) OVER (PARTITION BY sample_id) AS n4 FROM (
 SELECT * FROM (SELECT *, count_if(g3) OVER (PARTITION BY sample_id) AS n3 FROM (
  SELECT * FROM (SELECT *, count_if(g2) OVER (PARTITION BY sample_id) AS n2 FROM (
   SELECT * FROM (SELECT *, count_if(g1) OVER (PARTITION BY sample_id) AS n1 FROM (
    SELECT *, quality_level <> 'hard_fail' AS g1, coverage_ratio >= CASE WHEN source_name IN ('QuickDraw', 'Rendered text') THEN 0.45 ELSE 0.75 END AS g2,
      NOT candidate LIKE '%%styleaware%%' OR (%s) AS g3, NOT candidate LIKE '%%mask_fill%%' OR (%s) AS g4 FROM candidates)) WHERE g1 OR n1 = 0)) WHERE g2 OR n2 = 0)) WHERE g3 OR n3 = 0)) WHERE g4 OR n4 = 0""" % (
    _MG.format(j=15.0, p=0.75), _MG.format(j=20.0, p=0.70)), "candidates")


@query("selectable_pool", "SELECT sample_id, candidate, quality_level FROM pooled", "pooled")
def selectable_pool(spark, sf):
    return gates.keep_all_chain(candidates(spark, sf), ranking.pool_gates()).select("sample_id", "candidate", "quality_level")


@query("hard_safe_pool", """SELECT sample_id, candidate FROM (SELECT *, count_if(quality_level <> 'hard_fail') OVER (PARTITION BY sample_id) AS n FROM candidates) WHERE quality_level <> 'hard_fail' OR n = 0""", "candidates")
def hard_safe_pool(spark, sf):
    return gates.keep_all_if_empty(candidates(spark, sf), F.col("quality_level") != "hard_fail").select("sample_id", "candidate")


_CAL = """unified_loss + {cw} * greatest(0.0, CASE source_name WHEN 'Openclipart' THEN 0.88::DOUBLE WHEN 'OpenMoji' THEN 0.84::DOUBLE WHEN 'QuickDraw' THEN 0.58::DOUBLE WHEN 'Rendered text' THEN 0.60::DOUBLE ELSE 0.84::DOUBLE END - coverage_ratio)
  + {pw} * greatest(0.0, 0.72::DOUBLE - stitch_precision_ratio) + {jw} * (jump_count / 20.0::DOUBLE) + 0.02::DOUBLE * (trim_count / 8.0::DOUBLE)
  + 0.05::DOUBLE * off_mask_stitch_length_mm + 0.05::DOUBLE * visible_connector_count + CASE WHEN quality_level = 'hard_fail' THEN 0.04::DOUBLE ELSE 0.0 END"""


@query("calibrated_selector", f"""
SELECT sample_id, candidate AS chosen_candidate, round_even(s, 6) AS calibrated_score
FROM (SELECT *, {_CAL.format(cw='0.35::DOUBLE', pw='0.15::DOUBLE', jw='0.02::DOUBLE')} AS s FROM pooled)
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s, ordinal) = 1""", "pooled")
def calibrated_selector(spark, sf):
    pool = gates.keep_all_chain(candidates(spark, sf), ranking.pool_gates()).withColumn("s", ranking.calibrated_score("public_balanced"))
    return tidy(gates.best_per_sample(pool, ["candidate", "s"], "min", "s", (-F.col("ordinal"),)).select(
        "sample_id", F.col("candidate").alias("chosen_candidate"), F.col("s").alias("calibrated_score")))


@query("hard_and_mean_ranks", f"""
SELECT sample_id, candidate, {r('hard_score')}, hard_rank, mean_rank, hard_rank = 0 AS is_hard_best, mean_rank = 0 AS is_mean_best FROM (
  SELECT *, 10.0 * pf + visible_connector_count / 3.0::DOUBLE + off_mask_stitch_length_mm / 8.0::DOUBLE + jump_count / 25.0::DOUBLE + trim_count / 20.0::DOUBLE + unified_loss AS hard_score,
    row_number() OVER (PARTITION BY sample_id ORDER BY pf, visible_connector_count, off_mask_stitch_length_mm, jump_count, trim_count, unified_loss, ordinal) - 1 AS hard_rank,
    row_number() OVER (PARTITION BY sample_id ORDER BY unified_loss, ordinal) - 1 AS mean_rank
  FROM (SELECT *, CASE WHEN round_trip_parse_success THEN 0 ELSE 1 END AS pf FROM candidates))""", "candidates")
def hard_and_mean_ranks(spark, sf):
    return tidy(ranking.hard_and_mean_ranks(candidates(spark, sf)).select(
        "sample_id", "candidate", "hard_score", "hard_rank", "mean_rank", "is_hard_best", "is_mean_best"))


@query("oracle_choice", """
SELECT sample_id, candidate, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY unified_loss, ordinal) = 1 AS INTEGER) AS is_oracle_choice FROM candidates""", "candidates")
def oracle_choice(spark, sf):
    return ranking.oracle_choice(candidates(spark, sf), "unified_loss").select("sample_id", "candidate", "is_oracle_choice")


_FEATURE_NAMES = ("skeleton_auto",)


@query("first_or_fallback", """
SELECT sample_id, candidate, round_even(unified_loss, 6) AS unified_loss FROM candidates
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY candidate <> 'skeleton_auto', candidate) = 1""", "candidates")
def first_or_fallback(spark, sf):
    return tidy(ranking.first_or_fallback(candidates(spark, sf), "sample_id", F.col("candidate") == "skeleton_auto", [F.col("candidate")], ["candidate", "unified_loss"]))


@query("first_seen_scan", """
SELECT sample_id, partkey, ordinal FROM (SELECT l_orderkey AS sample_id, l_partkey % 50 AS partkey, l_linenumber AS ordinal, l_suppkey FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY sample_id, partkey ORDER BY ordinal, l_suppkey) = 1""")
def first_seen_scan(spark, sf):
    rows = Tables(spark, sf).lineitem.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 50).alias("partkey"), F.col("l_linenumber").alias("ordinal"), "l_suppkey")
    return ranking.first_seen(rows, ["sample_id", "partkey"], ["ordinal", "l_suppkey"]).select("sample_id", "partkey", "ordinal")


_SUM = ", ".join(f"round_even(round_even(coalesce(avg({m}), 0.0), 8), 6) AS mean_{m}" for m in _M)
_LEVELS = ", ".join(f'count_if(quality_level = \'{v}\') AS "{v}"' for v in summaries.LEVELS)


@query("summarize_by_candidate", f"SELECT candidate, count(*) AS samples, {_LEVELS}, {_SUM} FROM candidates GROUP BY 1", "candidates")
def summarize_by_candidate(spark, sf):
    return tidy(summaries.summarize_by(candidates(spark, sf), ["candidate"], _M))


@query("summarize_by_each", " UNION ALL ".join(
    f"SELECT '{k}' AS group_by, {k if k != 'all' else chr(39) * 2} AS group_value, count(*) AS samples, {_LEVELS}, {_SUM} FROM candidates" + ("" if k == "all" else " GROUP BY 2")
    for k in ("source_name", "category", "phase", "all")), "candidates")
def summarize_by_each(spark, sf):
    return tidy(summaries.summarize_by_each(candidates(spark, sf), ["source_name", "category", "phase"], _M))


@query("value_counts_json", """
SELECT source_name, '{' || string_agg('"' || candidate || '":' || n, ',' ORDER BY candidate) || '}' AS candidate_counts
FROM (SELECT source_name, candidate, count(*) AS n FROM candidates GROUP BY 1, 2) GROUP BY 1""", "candidates")
def value_counts_json(spark, sf):
    return summaries.value_counts_json(candidates(spark, sf), ["source_name"], "candidate")


_CMP = ("unified_loss", "jump_count", "coverage_ratio")


@query("compare_profiles", "SELECT a.sample_id, %s FROM candidates a JOIN candidates b ON a.sample_id = b.sample_id AND a.ordinal = 2 AND b.ordinal = 5" % ", ".join(
    f"a.{m} AS base_{m}, b.{m} AS compare_{m}, round_even(round_even((b.{m} - a.{m})::DOUBLE, 8), 6) AS delta_{m}" for m in _CMP), "candidates")
def compare_profiles(spark, sf):
    c = candidates(spark, sf)
    d = summaries.compare_profiles(c.filter("ordinal = 2"), c.filter("ordinal = 5"), "sample_id", _CMP)
    return d.withColumns({f"delta_{m}": half_even(f"delta_{m}", 6) for m in _CMP})


@query("improvement_counts", "SELECT %s FROM (SELECT %s FROM candidates a JOIN candidates b ON a.sample_id = b.sample_id AND a.ordinal = 2 AND b.ordinal = 5)" % (
    ", ".join(f"count_if({m} > 0) AS {m}_up, count_if({m} < 0) AS {m}_down, round_even(round_even(avg({m}), 8), 6) AS mean_delta_{m}" for m in _CMP),
    ", ".join(f"round_even(b.{m} - a.{m}, 8) AS {m}" for m in _CMP)), "candidates")
def improvement_counts(spark, sf):
    c = candidates(spark, sf)
    return tidy(summaries.improvement_counts(summaries.compare_profiles(c.filter("ordinal = 2"), c.filter("ordinal = 5"), "sample_id", _CMP), _CMP))


@query("method_deltas", "SELECT a.candidate, count(*) AS samples, %s FROM candidates a JOIN candidates b ON a.sample_id = b.sample_id AND b.candidate = 'base_keep' GROUP BY 1" % ", ".join(
    f"round_even(round_even(avg(a.{m} - b.{m}), 8), 6) AS delta_{m}" for m in _M), "candidates")
def method_deltas(spark, sf):
    return tidy(summaries.method_deltas(candidates(spark, sf), "base_keep", _M))


@query("split_ranking", """
SELECT candidate, phase, samples, round_even(mean_score, 6) AS mean_score, rank() OVER (PARTITION BY phase ORDER BY mean_score) AS split_rank
FROM (SELECT candidate, phase, count(*) AS samples, avg(s) AS mean_score FROM (
  SELECT *, CASE WHEN NOT round_trip_parse_success THEN 1e6 ELSE jump_path_mm + 10.0 * jump_count + 18.0 * trim_count + off_mask_stitch_length_mm + 20.0 * visible_connector_count END AS s FROM candidates) GROUP BY 1, 2)""", "candidates")
def split_ranking(spark, sf):
    from ..functions.scores import preset_score
    c = candidates(spark, sf).withColumns({n: F.lit(0) for n in ("illegal_long_stitch_count", "high_risk_jump_count", "unsupported_command_count", "stitch_path_mm")})
    c = c.withColumn("s", preset_score("round_trip_parse_success", F.lit(0.0)))
    return tidy(summaries.split_ranking(c, "candidate", "phase", "s"))


@query("changed_from_baseline", "SELECT a.sample_id, b.candidate AS baseline_candidate, a.candidate AS selected_candidate, a.candidate <> b.candidate AS changed, %s FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY unified_loss, ordinal) = 1) a JOIN baseline b USING (sample_id)" % ", ".join(
    f"round_even(round_even((a.{m} - b.{m})::DOUBLE, 8), 6) AS delta_{m}" for m in _M), "candidates", "baseline")
def changed_from_baseline(spark, sf):
    c = candidates(spark, sf)
    best = gates.best_per_sample(c, ["candidate", *_M], "min", "unified_loss", (-F.col("ordinal"),))
    return tidy(summaries.changed_from_baseline(best, baseline(c), "sample_id", _M))


@query("prediction_ratios", "SELECT a.sample_id, %s FROM candidates a JOIN candidates b ON a.sample_id = b.sample_id AND a.ordinal = 3 AND b.ordinal = 1" % ", ".join(
    f"round_even((a.{m} - b.{m})::DOUBLE, 6) AS {m}_delta, round_even(a.{m} / greatest(1e-6, b.{m}), 6) AS {m}_ratio" for m in ("jump_count", "jump_path_mm")), "candidates")
def prediction_ratios(spark, sf):
    c = candidates(spark, sf)
    return tidy(summaries.prediction_ratios(c.filter("ordinal = 3"), c.filter("ordinal = 1"), "sample_id", ["jump_count", "jump_path_mm"]))


@query("summary_delta", "SELECT a.source_name, %s FROM (SELECT source_name, %s FROM candidates WHERE ordinal = 3 GROUP BY 1) a JOIN (SELECT source_name, %s FROM candidates WHERE ordinal = 1 GROUP BY 1) b USING (source_name)" % (
    ", ".join(f"round_even(round_even(a.mean_{m} - b.mean_{m}, 8), 6) AS delta_mean_{m}" for m in _CMP), *[", ".join(f"round_even(avg({m}), 8) AS mean_{m}" for m in _CMP)] * 2), "candidates")
def summary_delta(spark, sf):
    c = candidates(spark, sf)
    s = lambda o: summaries.summarize_by(c.filter(F.col("ordinal") == o), ["source_name"], _CMP)
    return tidy(summaries.summary_delta(s(3), s(1), ["source_name"], [f"mean_{m}" for m in _CMP]))


@query("low_precision_counts", """
SELECT source_name, count(*) AS samples, count_if(stitch_precision_ratio < 0.75) AS low_stitch_precision_ratio, count_if(adaptive_stitch_precision_ratio < 0.94) AS low_adaptive_stitch_precision_ratio,
  count_if(coverage_ratio < 0.9) AS low_coverage_ratio FROM candidates GROUP BY 1""", "candidates")
def low_precision_counts(spark, sf):
    return summaries.low_counts(candidates(spark, sf), ["source_name"], {"stitch_precision_ratio": 0.75, "adaptive_stitch_precision_ratio": 0.94, "coverage_ratio": 0.9})


@query("switch_quality", """
SELECT source_name, count(*) AS samples, round_even(count_if(t AND p) / greatest(1, count_if(t)), 6) AS switch_recall, round_even(count_if(t AND p) / greatest(1, count_if(p)), 6) AS switch_precision,
  round_even(count_if(t = p) / count(*), 6) AS exact_match FROM (SELECT source_name, q % 3 = 0 AS t, q % 2 = 0 AS p FROM candidates) GROUP BY 1""", "candidates")
def switch_quality(spark, sf):
    c = candidates(spark, sf).withColumns({"t": (F.col("q") % 3 == 0).cast("int"), "p": (F.col("q") % 2 == 0).cast("int")})
    return tidy(summaries.switch_quality(c, "t", "p", ["source_name"]))


cte("risky", """
SELECT *, round_even(unified_loss + 0.006 * jump_count + 0.004 * trim_count + 0.030 * off_mask_stitch_length_mm + 0.015 * visible_connector_count
  + 0.5 * greatest(0.0, 0.90 - coverage_ratio) + 0.25 * greatest(0.0, 0.75 - stitch_precision_ratio) + 0.05 * risk_flag_count, 8) AS risk_score, risk_flag_count > 0 AS needs_review
FROM (SELECT *, CASE WHEN risk_flags = '' THEN 0 ELSE len(string_split(risk_flags, '|')) END::BIGINT AS risk_flag_count FROM (
  SELECT *, concat_ws('|', CASE WHEN quality_level IN ('warning', 'hard_fail') THEN 'quality_' || quality_level END, CASE WHEN unified_loss > 0.10 THEN 'high_loss' END,
    CASE WHEN jump_count > 10 THEN 'high_jump' END, CASE WHEN trim_count > 3 THEN 'high_trim' END, CASE WHEN off_mask_stitch_length_mm > 1 THEN 'off_mask' END,
    CASE WHEN visible_connector_count > 0 THEN 'visible_connector' END, CASE WHEN coverage_ratio < 0.90 THEN 'low_coverage' END, CASE WHEN stitch_precision_ratio < 0.75 THEN 'low_precision' END) AS risk_flags
  FROM candidates))""", "candidates")


@query("risk_rows", f"SELECT sample_id, candidate, risk_flags, risk_flag_count, {r('risk_score')}, needs_review FROM risky", "risky")
def risk_rows(spark, sf):
    return tidy(summaries.risk_rows(candidates(spark, sf)).select("sample_id", "candidate", "risk_flags", "risk_flag_count", "risk_score", "needs_review"))


@query("risk_rows_component_aware", """
SELECT sample_id, candidate, (2.0 + 2.0 * greatest(1, q % 5))::DOUBLE AS component_jump_allowance, greatest(0.0, jump_count - (2.0 + 2.0 * greatest(1, q % 5)))::DOUBLE AS jump_excess_count FROM candidates""", "candidates")
def risk_rows_component_aware(spark, sf):
    return summaries.risk_rows(candidates(spark, sf), components=F.col("q") % 5).select("sample_id", "candidate", "component_jump_allowance", "jump_excess_count")


@query("risk_summary", f"""
SELECT source_name, count(*) AS samples, count_if(needs_review) AS review_samples, round_even(count_if(needs_review) / count(*), 6) AS review_rate, round_even(avg(risk_score), 6) AS mean_risk_score,
  round_even(max(risk_score), 6) AS worst_risk_score, arg_max(sample_id, (risk_score, -sample_id, -ordinal)) AS worst_sample_id, arg_max(candidate, (risk_score, -sample_id, -ordinal)) AS worst_candidate,
  arg_max(risk_flags, (risk_score, -sample_id, -ordinal)) AS worst_flags, {_SUM} FROM risky GROUP BY 1""", "risky")
def risk_summary(spark, sf):
    return tidy(summaries.risk_summary(summaries.risk_rows(candidates(spark, sf)), ["source_name"], _M))


@query("risk_flag_counts", "SELECT flag, count(*) AS count FROM (SELECT unnest(string_split(risk_flags, '|')) AS flag FROM risky WHERE risk_flags <> '') GROUP BY 1", "risky")
def risk_flag_counts(spark, sf):
    return summaries.flag_counts(summaries.risk_rows(candidates(spark, sf)))


@query("review_queue", f"SELECT sample_id, candidate, risk_flags, {r('risk_score')} FROM risky WHERE needs_review ORDER BY risky.risk_score DESC, source_name, sample_id, ordinal LIMIT 10", "risky")
def review_queue(spark, sf):
    return tidy(summaries.review_queue(summaries.risk_rows(candidates(spark, sf))).select("sample_id", "candidate", "risk_flags", "risk_score"))


@query("execution_risk", f"""
SELECT sample_id, candidate, {r('jump_explosion_ratio', 'trim_explosion_ratio')}, off AS offmask_explosion_mm, vis::DOUBLE AS visible_explosion_count,
  round_even(round_even(least(8.0, jump_explosion_ratio) + 0.9 * least(8.0, trim_explosion_ratio) + 1.5 * least(8.0, off / 10.0) + 2.0 * least(8.0, vis) + 8.0 * greatest(0.0, delta_unified_loss)
    + CASE WHEN quality_level = 'hard_fail' THEN 4.0 ELSE 0.0 END, 8), 6) AS execution_penalty_score
FROM (SELECT *, greatest(jump_count / 50.0::DOUBLE, delta_jump_count / 10.0::DOUBLE) AS jump_explosion_ratio, greatest(trim_count / 10.0::DOUBLE, greatest(0.0, delta_trim_count) / 3.0::DOUBLE) AS trim_explosion_ratio,
  greatest(off_mask_stitch_length_mm, delta_off_mask_stitch_length_mm) AS off, greatest(visible_connector_count, delta_visible_connector_count) AS vis FROM (
   SELECT c.*, c.jump_count - b.jump_count AS delta_jump_count, c.trim_count - b.trim_count AS delta_trim_count, round_even(c.unified_loss - b.unified_loss, 8) AS delta_unified_loss,
     round_even(c.off_mask_stitch_length_mm - b.off_mask_stitch_length_mm, 8) AS delta_off_mask_stitch_length_mm, c.visible_connector_count - b.visible_connector_count AS delta_visible_connector_count
   FROM candidates c JOIN baseline b USING (sample_id)))""", "candidates", "baseline")
def execution_risk(spark, sf):
    c = candidates(spark, sf)
    j = gates.beside_first(c)
    return tidy(j.select("sample_id", "candidate", *[e.alias(n) for n, e in summaries.execution_risk().items()]))


_AVG = {"mean_unified_loss": "(1.0 - l_discount) * l_quantity / 60.0", "mean_jump_count": "l_quantity", "mean_trim_count": "l_linenumber",
        "mean_off_mask_stitch_length_mm": "l_tax * 100.0", "mean_visible_connector_count": "l_partkey % 3",
        "mean_coverage_ratio": "1.0 - l_discount", "mean_stitch_precision_ratio": "1.0 - l_tax"}
cte("sweep_rows", """
SELECT *, round_even(mean_unified_loss + 0.003 * mean_jump_count + 0.002 * mean_trim_count + 0.010 * mean_off_mask_stitch_length_mm + 0.002 * mean_visible_connector_count
  + 0.5 * greatest(0.0, 0.95 - mean_coverage_ratio) + 10.0 * greatest(0.0, hard_fail - 1), 8) AS objective
FROM (SELECT l_returnflag AS profile, l_suppkey AS strength, l_linestatus AS sweep, year(l_shipdate)::INTEGER AS yr, concat_ws('-', l_returnflag, l_linestatus, l_suppkey, year(l_shipdate)) AS row_id,
  %s, max(l_linenumber) %% 3 AS hard_fail FROM lineitem GROUP BY ALL)""" % ", ".join(f"round_even(avg({e.replace('60.0', '60.0::DOUBLE')}), 4) AS {n}" for n, e in _AVG.items()))


def sweep_rows(spark, sf):
    """Where a mean lies on a tie of its last digit, the order in which its doubles are added decides: it is the table's, however the files are cut."""
    li = in_file_order(Tables(spark, sf).lineitem, [
        F.col("l_suppkey").alias("strength"), F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("sweep"), F.year("l_shipdate").alias("yr")],
        ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey"])
    g = li.groupBy("profile", "strength", "sweep", "yr").agg(
        *[half_even(F.avg(F.expr(e.replace("1.0", "1.0D").replace("60.0", "60.0D"))), 4).alias(n) for n, e in _AVG.items()], (F.max("l_linenumber") % 3).alias("hard_fail"))
    g = g.withColumn("row_id", F.concat_ws("-", "profile", "sweep", F.col("strength").cast("string"), F.col("yr").cast("string")))
    return g.withColumn("objective", half_even(pareto.gate_objective(0.95, 1), 8))


@query("gate_objective", f"SELECT row_id, {r('objective')} FROM sweep_rows", "sweep_rows")
def gate_objective(spark, sf):
    return tidy(sweep_rows(spark, sf).select("row_id", "objective"))


_DOM = " AND ".join([f"a.{m} <= b.{m} + 1e-12" for m in pareto.MINIMISE] + [f"a.{m} + 1e-12 >= b.{m}" for m in pareto.MAXIMISE])
_STRICT = " OR ".join([f"a.{m} + 1e-12 < b.{m}" for m in pareto.MINIMISE] + [f"a.{m} > b.{m} + 1e-12" for m in pareto.MAXIMISE])
cte("front", f"SELECT * FROM sweep_rows b WHERE NOT EXISTS (SELECT 1 FROM sweep_rows a WHERE a.profile = b.profile AND {_DOM} AND ({_STRICT}))", "sweep_rows")


def front(spark, sf):
    return pareto.pareto_front(sweep_rows(spark, sf), "row_id", ["profile"])


@query("pareto_front", f"SELECT profile, row_id, {r('objective')} FROM front", "front")
def pareto_front(spark, sf):
    return tidy(front(spark, sf).select("profile", "row_id", "objective"))


def _spans(alias, weights, part):
    return ", ".join(f"min({m}) OVER {part} AS lo_{m}, max({m}) OVER {part} AS hi_{m}" for m in weights)


def _mm(m, invert=False):
    e = f"CASE WHEN abs(hi_{m} - lo_{m}) < 1e-12 THEN {0.0 if invert is None else (0.0)} ELSE greatest(0.0, least(1.0, ({m} - lo_{m}) / (hi_{m} - lo_{m}))) END"
    return e


_KNEE = " + ".join(f"{w}::DOUBLE * " + (f"({_mm(m)})" if m in pareto.MINIMISE else f"(1.0 - ({_mm(m)}))") for m, w in pareto.KNEE_WEIGHTS.items())
cte("feasible_front", f"""
SELECT *, round_even({_KNEE} + 0.5 * greatest(0.0, 0.95 - mean_coverage_ratio), 8) AS balanced_knee_score FROM (
  SELECT *, {_spans('', pareto.KNEE_WEIGHTS, '(PARTITION BY profile)')} FROM (SELECT *, count_if(f) OVER (PARTITION BY profile) AS nf FROM (
    SELECT *, hard_fail <= 1 AND mean_coverage_ratio + 1e-12 >= 0.95 AS f FROM front)) WHERE f OR nf = 0)""", "front")


@query("front_recommendations", " UNION ALL ".join(
    f"SELECT * FROM (SELECT profile, '{n}' AS recommendation, row_id, round_even(objective, 6) AS objective, round_even(balanced_knee_score, 6) AS balanced_knee_score FROM feasible_front ff QUALIFY row_number() OVER (PARTITION BY profile ORDER BY {o}, row_id) = 1)"
    for n, o in (("best_objective", "ff.objective"), ("best_low_jump", "mean_jump_count, ff.objective"), ("best_high_coverage", "mean_coverage_ratio DESC, ff.objective"), ("balanced_knee", "ff.balanced_knee_score"))), "feasible_front")
def front_recommendations(spark, sf):
    return tidy(pareto.recommendations(front(spark, sf), ["profile"], "row_id", 0.95, 1))


@query("collapse_duplicates", """
SELECT profile, jump, cov, arg_min(row_id, (objective, row_id)) AS row_id, count(*) AS equivalent_config_count FROM (
  SELECT *, CAST(floor(mean_jump_count / 5) AS BIGINT) AS jump, CAST(floor(mean_coverage_ratio * 50) AS BIGINT) AS cov FROM sweep_rows) GROUP BY 1, 2, 3""", "sweep_rows")
def collapse_duplicates(spark, sf):
    d = sweep_rows(spark, sf).withColumns({"jump": F.floor(F.col("mean_jump_count") / 5).cast("long"), "cov": F.floor(F.col("mean_coverage_ratio") * 50).cast("long")})
    return pareto.collapse_duplicates(d, ["profile", "jump", "cov"], order=["row_id"]).select("profile", "jump", "cov", "row_id", "equivalent_config_count")


_ROB = " + ".join(f"{w}::DOUBLE * (CASE WHEN abs(hi_{m} - lo_{m}) < 1e-12 THEN 0.0 ELSE " + ("1.0 - " if m in pareto.MAXIMISE else "") + f"greatest(0.0, least(1.0, ({m} - lo_{m}) / (hi_{m} - lo_{m}))) END)" for m, w in pareto.ROBUST_WEIGHTS.items())
cte("robust", f"""
SELECT *, row_number() OVER (PARTITION BY profile ORDER BY robust_score, mean_objective, mean_jump_count, -min_coverage_ratio, strength, yr) AS robust_rank FROM (
 SELECT profile, strength, yr, round_even(0.55 * avg(s) + 0.30 * max(s) + 0.15 * (max(s) - min(s)), 8) AS robust_score, round_even(avg(s), 8) AS mean_dataset_score, round_even(max(s), 8) AS worst_dataset_score,
   round_even(avg(objective), 8) AS mean_objective, round_even(max(objective), 8) AS worst_objective, round_even(avg(mean_jump_count), 8) AS mean_jump_count, round_even(min(mean_coverage_ratio), 8) AS min_coverage_ratio
 FROM (SELECT *, {_ROB} AS s FROM (SELECT *, {_spans('', pareto.ROBUST_WEIGHTS, '(PARTITION BY sweep, profile)')} FROM sweep_rows WHERE hard_fail <= 1 AND mean_coverage_ratio >= 0.94))
 GROUP BY 1, 2, 3 HAVING count(DISTINCT sweep) = 2)""", "sweep_rows")


def robust(spark, sf):
    return pareto.robust_policies(sweep_rows(spark, sf), "sweep", ["strength", "yr"], 2, min_coverage=0.94, max_hard_fail=1)


@query("robust_policies", f"SELECT profile, strength, yr, {r('robust_score', 'mean_objective', 'worst_objective', 'min_coverage_ratio')}, robust_rank FROM robust", "robust")
def robust_policies(spark, sf):
    return tidy(robust(spark, sf).select("profile", "strength", "yr", "robust_score", "mean_objective", "worst_objective", "min_coverage_ratio", "robust_rank"))


@query("robust_picks", " UNION ALL ".join(
    f"SELECT * FROM (SELECT profile, '{n}' AS recommendation, strength, yr, robust_rank FROM robust QUALIFY row_number() OVER (PARTITION BY profile ORDER BY {o}, robust_rank) = 1)"
    for n, o in (("best_robust_score", "robust_rank"), ("best_mean_objective", "mean_objective"), ("best_low_jump", "mean_jump_count, mean_objective"), ("best_min_coverage", "min_coverage_ratio DESC, mean_objective"))), "robust")
def robust_picks(spark, sf):
    return pareto.robust_picks(robust(spark, sf), ["strength", "yr"])


@query("pivot_sweeps", """
SELECT profile, strength, yr, max(objective) FILTER (sweep = 'F') AS "F_objective", max(mean_jump_count) FILTER (sweep = 'F') AS "F_mean_jump_count",
  max(objective) FILTER (sweep = 'O') AS "O_objective", max(mean_jump_count) FILTER (sweep = 'O') AS "O_mean_jump_count" FROM sweep_rows GROUP BY 1, 2, 3""", "sweep_rows")
def pivot_sweeps(spark, sf):
    return pareto.pivot_sweeps(sweep_rows(spark, sf), "sweep", ["F", "O"], ["profile", "strength", "yr"], ["objective", "mean_jump_count"])


GRID = [{"cw": cw, "pw": pw, "jw": jw} for cw in (0.20, 0.35, 0.50) for pw in (0.05, 0.15, 0.30) for jw in (0.0, 0.02)]
cte("grid_choice", """
SELECT config_id, sample_id, candidate, unified_loss, coverage_ratio, quality_level FROM (SELECT *, %s AS s FROM pooled, (SELECT unnest([%s], recursive := true)))
QUALIFY row_number() OVER (PARTITION BY config_id, sample_id ORDER BY s, ordinal) = 1""" % (
    _CAL.format(cw="cw", pw="pw", jw="jw"), ", ".join("{'config_id': %d, 'cw': %s::DOUBLE, 'pw': %s::DOUBLE, 'jw': %s::DOUBLE}" % (i, g["cw"], g["pw"], g["jw"]) for i, g in enumerate(GRID))), "pooled")


def grid_choice(spark, sf):
    pool = gates.keep_all_chain(candidates(spark, sf), ranking.pool_gates())
    names = {"coverage_weight": "cw", "precision_weight": "pw", "jump_weight": "jw"}
    score = lambda g: ranking.calibrated_score("public_balanced", param=lambda n: F.lit(float(g[names[n]] if n in names else ranking.CALIBRATED[n])))
    # A sample's rows are one group for all configurations; what is multiplied by them is its picks, not its rows.
    row = F.struct("candidate", "unified_loss", "coverage_ratio", "quality_level")
    picks = pool.groupBy("sample_id").agg(*[F.min_by(row, F.struct(score(g).alias("s"), "ordinal")).alias(f"_p{i}") for i, g in enumerate(GRID)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("config_id"), F.col(f"_p{i}").alias("r")) for i in range(len(GRID))]))
    return picks.select("sample_id", each.alias("g")).select("g.config_id", "sample_id", "g.r.*")


@query("grid_sweep", """
SELECT config_id, count(*) AS samples, count_if(quality_level = 'hard_fail') AS hard_fail, round_even(avg(unified_loss), 6) AS mean_unified_loss, round_even(avg(coverage_ratio), 6) AS mean_coverage_ratio
FROM grid_choice GROUP BY 1""", "grid_choice")
def grid_sweep(spark, sf):
    return tidy(grid_choice(spark, sf).groupBy("config_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("quality_level") == "hard_fail").alias("hard_fail"),
        F.avg("unified_loss").alias("mean_unified_loss"), F.avg("coverage_ratio").alias("mean_coverage_ratio")))


@query("benefit_gate_sweep", """
SELECT task_profile, count(*) AS samples, round_even(avg(chosen_loss), 6) AS mean_unified_loss, count_if(gate_mode = 'safe_coverage') AS safe_coverage, count_if(gate_mode = 'benefit_tradeoff') AS benefit_tradeoff,
  count_if(gate_mode = 'safe_fallback') AS safe_fallback FROM benefit GROUP BY 1""", "benefit")
def benefit_gate_sweep(spark, sf):
    b = ranking.benefit_gate(reranked(spark, sf), ranking.COVERAGE_FLOORS)
    return tidy(b.groupBy("task_profile").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("chosen.unified_loss").alias("mean_unified_loss"),
        *[F.count_if(F.col("gate_mode") == m).alias(m) for m in ("safe_coverage", "benefit_tradeoff", "safe_fallback")]))


_TASKS = {"low_loss": dict(coverage=0.0, precision=0.0, off_mask=0.0, visible=0.0, jump=0.0, trim=0.0),
          "balanced": dict(coverage=0.10, precision=0.05, off_mask=0.02, visible=0.005, jump=0.003, trim=0.003)}


@query("task_profile_features", """
SELECT sample_id, candidate, p AS task_profile, (p = 'low_loss')::DOUBLE AS task_is_low_loss, (p = 'balanced')::DOUBLE AS task_is_balanced,
  CASE WHEN p = 'balanced' THEN 0.10 ELSE 0.0 END::DOUBLE AS task_coverage_weight, round_even(CASE WHEN p = 'balanced' THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END * coverage_ratio, 6) AS task_coverage_weight_x_coverage_ratio,
  round_even(CASE WHEN p = 'low_loss' THEN unified_loss ELSE 0.0 END, 6) AS task_low_loss_x_unified_loss FROM candidates, (SELECT unnest(['low_loss', 'balanced']) AS p)""", "candidates")
def task_profile_features(spark, sf):
    wide = ranking.expand_profiles(candidates(spark, sf), list(_TASKS)).withColumns(ranking.task_features(_TASKS))
    return tidy(wide.select("sample_id", "candidate", "task_profile", "task_is_low_loss", "task_is_balanced", "task_coverage_weight", "task_coverage_weight_x_coverage_ratio", "task_low_loss_x_unified_loss"))


_PRESETS = [{"name": "conservative", "coverage_ratio": 0.95, "stitch_precision_ratio": 0.95}, {"name": "balanced", "coverage_ratio": 0.85, "stitch_precision_ratio": 0.85},
            {"name": "dense", "coverage_ratio": 0.99, "stitch_precision_ratio": 0.65}]


@query("nearest_preset", "SELECT sample_id, candidate, g.n AS nearest_preset, round_even(g.d, 6) AS preset_error FROM (SELECT sample_id, candidate, list_sort([%s])[1] AS g FROM candidates)" % ", ".join(
    "{'d': ((coverage_ratio - %s::DOUBLE) / 0.2::DOUBLE * ((coverage_ratio - %s::DOUBLE) / 0.2::DOUBLE) + (stitch_precision_ratio - %s::DOUBLE) / 0.3::DOUBLE * ((stitch_precision_ratio - %s::DOUBLE) / 0.3::DOUBLE)) / 2, 'i': %d, 'n': '%s'}" % (
        p["coverage_ratio"], p["coverage_ratio"], p["stitch_precision_ratio"], p["stitch_precision_ratio"], i, p["name"]) for i, p in enumerate(_PRESETS)), "candidates")
def nearest_preset(spark, sf):
    return tidy(ranking.nearest_preset(candidates(spark, sf), _PRESETS, {"coverage_ratio": 0.2, "stitch_precision_ratio": 0.3}).select("sample_id", "candidate", "nearest_preset", "preset_error"))


cte("decisions", """
SELECT l_orderkey AS decision_id, l_partkey AS node_id, max(l_quantity) AS distance_mm, max(l_quantity * 1.5 + l_linenumber) AS cost, max(1.0 - l_discount * 5.0) AS inside_fraction,
  max(l_tax * 10.0 - l_discount) AS utility, max(l_quantity / 100.0) AS decode_penalty FROM lineitem GROUP BY 1, 2""")


def decisions(spark, sf):
    c = lambda e: F.max(F.expr(e))
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("node_id")).agg(
        F.max("l_quantity").alias("distance_mm"), c("l_quantity * 1.5D + l_linenumber").alias("cost"), c("1.0D - l_discount * 5.0D").alias("inside_fraction"),
        c("l_tax * 10.0D - l_discount").alias("utility"), c("l_quantity / 100.0D").alias("decode_penalty"))


@query("top_k_policy", """
SELECT decision_id, arg_max(node_id, (utility - decode_penalty, utility, -cost, -node_id)) AS chosen_node, any_value(det) AS deterministic_node,
  arg_max(node_id, (utility - decode_penalty, utility, -cost, -node_id)) <> any_value(det) AS override, CAST(CASE WHEN any_value(ns) > 0 THEN any_value(k) - any_value(ns) ELSE 0 END AS BIGINT) AS filtered
FROM (SELECT *, count_if(safe) OVER (PARTITION BY decision_id) AS ns, count(*) OVER (PARTITION BY decision_id) AS k, arg_min(node_id, rn) OVER (PARTITION BY decision_id) AS det FROM (
  SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY cost, node_id) AS rn, inside_fraction >= 0.7 AS safe FROM decisions) WHERE rn <= 4) WHERE safe OR ns = 0 GROUP BY 1""", "decisions")
def top_k_policy(spark, sf):
    return ranking.top_k_policy(decisions(spark, sf), 4, 0.7)


@query("hardest_negatives", """
SELECT decision_id, node_id, label FROM (SELECT *, row_number() OVER (PARTITION BY decision_id, label ORDER BY distance_mm, node_id) AS rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY decision_id ORDER BY cost, node_id) = 1 AS INTEGER) AS label FROM decisions)) WHERE label = 1 OR rn <= 3""", "decisions")
def hardest_negatives(spark, sf):
    d = decisions(spark, sf)
    best = d.groupBy("decision_id").agg(F.min_by("node_id", F.struct("cost", "node_id")).alias("_b"))
    labelled = d.join(best, "decision_id").withColumn("label", (F.col("node_id") == F.col("_b")).cast("int")).drop("_b")
    return ranking.hardest_negatives(labelled, 3).select("decision_id", "node_id", "label")
