"""Queries of the gate-and-promote policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics
from ..operators import gates, policies as P
from ..operators.gates import METRICS, Policy
from .fixtures import baseline, candidates, policy_pool
from .registry import cte, query, r, tidy

EXTRA = ("skeleton_coverage_ratio", "adaptive_skeleton_coverage_ratio", "family_texture_score_norm", "directional_score", "rhythm_score")
ALL_METRICS = (*METRICS, *EXTRA)

cte("joined", "SELECT c.*, %s, b.candidate AS base_candidate FROM policy_pool c JOIN pool_base b USING (sample_id)" % ", ".join(
    f"b.{m} AS base_{m}, round_even(c.{m} - b.{m}, 8) AS delta_{m}" for m in ALL_METRICS), "policy_pool", "pool_base")
cte("deployed", """
SELECT *, CASE WHEN predicted_family NOT IN ('base_keep', 'reject') AND mg < 0.2 THEN 'reject' ELSE predicted_family END AS deployed_family,
  CASE WHEN predicted_family NOT IN ('base_keep', 'reject') AND mg < 0.2 THEN 'risk_margin_reject' ELSE 'keep_selector_prediction' END AS deployment_reason,
  round_even(mg, 8) AS selector_margin_vs_reject
FROM (SELECT *, CASE WHEN predicted_family = 'reject' THEN score_reject - greatest(score_base_keep, score_running_line, score_auto_running, score_auto_fill,
    score_fill_tatami_like, score_satin_like, score_outline_border) ELSE greatest(score_base_keep, score_running_line, score_auto_running, score_auto_fill,
    score_fill_tatami_like, score_satin_like, score_outline_border) - score_reject END AS mg FROM joined)""", "joined")


def _m(name: str) -> str:
    if name.startswith("-"):
        return f"(-{_m(name[1:])})"
    return {"d:": "delta_", "b:": "base_"}.get(name[:2], "") + (name[2:] if name[1:2] == ":" else name)


def _rule(rule) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    if rule.op == "is":
        return f"{rule.measure} = '{rule.limit}'"
    if rule.op in ("in", "not in"):
        none = f"{rule.measure} IS NULL OR " if rule.op == "not in" else ""
        return f"({none}{rule.measure} {rule.op} ({', '.join(map(text, rule.limit))}))"
    if rule.op == "null":
        return f"{rule.measure} IS NULL"
    return f"{_m(rule.measure)} {rule.op} {rule.limit:.12g}::DOUBLE"


def _terms(p: Policy) -> str:
    parts = []
    for t in p.terms:
        v = {"raw": "{}", "positive": "greatest(0.0, {})", "deficit": f"greatest(0.0, {t.target} - {{}})"}[t.shape].format(_m(t.measure))
        parts.append(f"({t.weight}::DOUBLE) * {v}")
    parts += [f"CASE WHEN candidate_family = '{f}' THEN {a}::DOUBLE ELSE 0.0 END" for f, a in p.family_bonus.items()]
    total = " + ".join(parts) or "0.0::DOUBLE"
    return f"round_even({total}, 8)" if p.round_score else total


def ladder_sql(p: Policy, source: str) -> str:
    rules = [f"WHEN {_rule(x)} THEN '{x.reason}'" for x in p.rejects]
    if p.only_sources:
        rules.insert(0, f"WHEN source_name NOT IN ({', '.join(repr(s) for s in p.only_sources)}) THEN 'other_source'")
    passed, gains = f"'{p.pass_reason}'", "''"
    if p.gains:
        gains = "concat_ws('|', " + ", ".join(f"CASE WHEN {_m(m)} >= {x} THEN '{n}' END" for n, m, x in p.gains) + ")"
        rules += ["WHEN gains = '' THEN 'no_material_improvement'", f"WHEN policy_score < {p.min_score} THEN '{p.score_reason}'"]
        passed = "gains"
    return f"""SELECT *, reason IS NULL AS gate_pass, coalesce(reason, {passed}) AS gate_reason FROM (
  SELECT *, CASE {' '.join(rules)} END AS reason FROM (SELECT *, {_terms(p)} AS policy_score, {gains} AS gains FROM {source}))"""


def promote_sql(p: Policy, gated: str) -> str:
    limit = f" AND policy_score >= {p.min_score}" if p.min_score is not None and not p.gains else ""
    limit += "".join(f" AND coalesce({c}, '') <> 'base_keep'" for c in p.never_base)
    direction = "DESC" if p.best == "max" else "ASC"
    tie = "unified_loss, ordinal" if p.gains else "ordinal"
    return f"""SELECT b.sample_id, b.source_name, b.category, b.candidate AS base_candidate, coalesce(g.candidate, b.candidate) AS chosen_candidate,
  g.candidate IS NOT NULL AS promoted, coalesce(g.gate_reason, 'baseline_kept') AS status, round_even(coalesce(g.policy_score, 0.0), 6) AS policy_score,
  round_even(coalesce(g.unified_loss, b.unified_loss), 6) AS unified_loss
FROM pool_base b LEFT JOIN (SELECT * FROM {gated} WHERE gate_pass{limit}
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY policy_score {direction}, {tie}) = 1) g USING (sample_id)"""


_OWN = ("guarded_no_regression", "multifamily_safety")


def gated_pool(spark, sf, policy: Policy, whole: bool = False):
    """The gated rows beside their baseline; ``whole`` keeps the baselines of policies that gate only the others."""
    joined = gates.beside_first(policy_pool(spark, sf), ALL_METRICS)
    if policy.name == "multifamily_safety":
        joined = P.deploy(joined)
    if policy.name in _OWN and not whole:
        joined = joined.filter(not_base())
    return gates.apply_policy(joined, policy)


def not_base():
    return F.coalesce(F.col("candidate") != F.col("base_candidate"), F.lit(False))


def _register(p: Policy) -> None:
    source = "deployed" if p.name == "multifamily_safety" else "joined"
    if p.name in _OWN:
        source = f"(SELECT * FROM {source} WHERE candidate <> base_candidate)"
    cte(f"gated_{p.name}", ladder_sql(p, source), "deployed" if p.name == "multifamily_safety" else "joined")

    @query(f"gate_{p.name}", f"SELECT sample_id, candidate, gate_pass, gate_reason, {r('policy_score')} FROM gated_{p.name}", f"gated_{p.name}")
    def gate(spark, sf):
        return tidy(gated_pool(spark, sf, p).select("sample_id", "candidate", "gate_pass", "gate_reason", "policy_score"))

    if p.terms:
        @query(f"promote_{p.name}", promote_sql(p, f"gated_{p.name}"), f"gated_{p.name}", "pool_base")
        def promoted(spark, sf):
            ties = (-F.col("unified_loss"), -F.col("ordinal")) if p.gains else None
            return tidy(gates.promote_beside(gated_pool(spark, sf, p, whole=True), p, ties, not_base() if p.name in _OWN else None))


for _p in P.ALL:
    _register(_p)


@query("rejection_reasons", """
SELECT sample_id, string_agg(gate_reason || ':' || n, '|' ORDER BY gate_reason) AS rejection_reasons
FROM (SELECT sample_id, gate_reason, count(*) AS n FROM gated_guarded_no_regression WHERE NOT gate_pass GROUP BY 1, 2) GROUP BY 1""", "gated_guarded_no_regression")
def rejection_reasons(spark, sf):
    return gates.reason_counts(gated_pool(spark, sf, P.GUARDED))


@query("near_misses", f"""
SELECT sample_id, candidate, gate_reason, {r('policy_score')} FROM gated_guarded_no_regression WHERE NOT gate_pass
ORDER BY policy_score DESC, sample_id, ordinal LIMIT 80""", "gated_guarded_no_regression")
def near_misses(spark, sf):
    return tidy(gates.near_misses(gated_pool(spark, sf, P.GUARDED)).select("sample_id", "candidate", "gate_reason", "policy_score"))


@query("text_switch_rows", """
SELECT f.sample_id, f.source_name, f.category, coalesce(g.gate_pass, false) AS switched,
  CASE WHEN g.gate_pass THEN g.candidate ELSE f.candidate END AS chosen_candidate, CASE WHEN g.gate_pass THEN g.gate_reason WHEN g.gate_reason = 'other_source' THEN 'non_text_source'
    WHEN g.gate_reason IS NOT NULL THEN 'text_safe_fallback:' || g.gate_reason || ':' || coalesce(f.category, '') ELSE 'missing_row' END AS gate_reason
FROM pool_base f LEFT JOIN (SELECT * FROM gated_text_profile_switcher WHERE ordinal = 5) g USING (sample_id)""", "gated_text_profile_switcher", "pool_base")
def text_switch_rows(spark, sf):
    pool = policy_pool(spark, sf)
    return gates.select_rows_by_gate(baseline(pool), pool.filter("ordinal = 5"), P.TEXT_SWITCHER)


@query("deployed_families", f"SELECT sample_id, candidate, predicted_family, deployed_family, deployment_reason, {r('selector_margin_vs_reject')} FROM deployed", "deployed")
def deployed_families(spark, sf):
    d = P.deploy(policy_pool(spark, sf))
    return tidy(d.select("sample_id", "candidate", "predicted_family", "deployed_family", "deployment_reason", "selector_margin_vs_reject"))


@query("candidate_roots", """
SELECT sample_id, candidate, CASE WHEN q % 3 = 0 AND q % 12 <> 0 THEN 'textures/' || sample_id || '/' || candidate WHEN ordinal < 6 THEN 'pool/' || candidate END AS candidate_root FROM candidates""", "candidates")
def candidate_roots(spark, sf):
    c = candidates(spark, sf)
    path = F.concat_ws("/", F.lit("textures"), F.col("sample_id").cast("string"), "candidate")
    texture = c.filter("q % 3 = 0").select("sample_id", "candidate", F.explode(F.array(
        F.struct(F.lit("old").alias("candidate_root"), F.lit(1).alias("row")), F.struct(F.when(F.col("q") % 12 == 0, "").otherwise(path).alias("candidate_root"), F.lit(2).alias("row")))).alias("r"))
    roots = c.filter("ordinal < 6").select("candidate").distinct().withColumn("result_dir", F.concat(F.lit("pool/"), F.col("candidate")))
    return gates.candidate_roots(c, texture.select("sample_id", "candidate", "r.*"), roots).select("sample_id", "candidate", "candidate_root")


cte("skeleton_audit", """
SELECT candidate AS selection, sample_id, round_even(1.0 - 0.3 * (1.0 - coverage_ratio), 6) AS skeleton_coverage_ratio, round_even(1.0 - 0.05 * (1.0 - coverage_ratio), 6) AS adaptive_skeleton_coverage_ratio
FROM policy_pool WHERE q % 4 <> 3 OR candidate = 'base_keep'""", "policy_pool")
cte("audited", "SELECT p.* EXCLUDE (skeleton_coverage_ratio, adaptive_skeleton_coverage_ratio), a.skeleton_coverage_ratio, a.adaptive_skeleton_coverage_ratio FROM policy_pool p LEFT JOIN skeleton_audit a ON a.selection = p.candidate AND a.sample_id = p.sample_id", "policy_pool", "skeleton_audit")
cte("audited_deltas", "SELECT c.*, %s FROM audited c JOIN (SELECT a.* FROM audited a JOIN pool_base p ON p.sample_id = a.sample_id AND p.ordinal = a.ordinal) b USING (sample_id)" % ", ".join(
    f"round_even(coalesce(c.{m}, 0) - coalesce(b.{m}, 0), 8) AS delta_{m}" for m in ALL_METRICS), "audited", "pool_base")


@query("line_skeleton_rows", """
SELECT sample_id, candidate, CASE WHEN source_name <> 'QuickDraw' THEN 'other_source' WHEN quality_level = 'hard_fail' THEN 'candidate_hard_fail' WHEN delta_off_mask_stitch_length_mm > 0 THEN 'off_mask_increase'
  WHEN delta_visible_connector_count > 0 THEN 'visible_increase' WHEN delta_jump_count > 0 THEN 'jump_increase' WHEN delta_trim_count > 0 THEN 'trim_increase' WHEN delta_unified_loss > 0 THEN 'loss_increase'
  WHEN adaptive_stitch_precision_ratio < 0.95 THEN 'adaptive_precision_too_low' WHEN coalesce(adaptive_skeleton_coverage_ratio, 0) < 0.95 THEN 'adaptive_skeleton_coverage_too_low'
  WHEN delta_skeleton_coverage_ratio < 0.005 THEN 'skeleton_coverage_gain_too_small' WHEN delta_adaptive_skeleton_coverage_ratio < 0.005 THEN 'adaptive_skeleton_coverage_gain_too_small'
  ELSE 'line_skeleton_fidelity' END AS gate_reason FROM audited_deltas""", "audited_deltas")
def line_skeleton_rows(spark, sf):
    """The line-skeleton gate over audit rows joined by selection and sample; its SQL states the published ladder, not the policy's table."""
    pool = policy_pool(spark, sf)
    half = lambda k: semantics.half_even(1.0 - k * (1.0 - F.col("coverage_ratio")), 6)
    audit = pool.filter("q % 4 <> 3 OR candidate = 'base_keep'").select(F.col("candidate").alias("selection"), "sample_id", half(0.3).alias("skeleton_coverage_ratio"), half(0.05).alias("adaptive_skeleton_coverage_ratio"))
    rows = gates.with_skeleton_rows(pool, audit, F.col("candidate"))
    joined = gates.beside_first(rows, ALL_METRICS)
    return gates.apply_policy(joined, P.LINE_SKELETON).select("sample_id", "candidate", "gate_reason")


_TEACHER = ("base_keep", "fill_tatami_like", "satin_like", "outline_border", "reject")
_TEACHER_SQL = "[%s][q %% 5 + 1]" % ", ".join(f"'{t}'" for t in _TEACHER)
_SUMMARY_SQL = """count(*) AS rows, round_even(count_if({p} = t) / count(*), 6) AS accuracy,
  round_even(count_if({p} = t AND t <> 'reject') / greatest(1, count_if(t <> 'reject')), 6) AS positive_accuracy,
  round_even(count_if({p} = t AND t NOT IN ('reject', 'base_keep')) / greatest(1, count_if(t NOT IN ('reject', 'base_keep'))), 6) AS nonbase_positive_accuracy,
  round_even(count_if({p} = t AND t = 'reject') / greatest(1, count_if(t = 'reject')), 6) AS reject_recall,
  count_if(t IN ('reject', 'base_keep') AND {p} IN ('satin_like', 'fill_tatami_like', 'outline_border')) AS false_texture_promotions"""


def _with_teacher(df):
    return df.withColumn("teacher_family", F.get(F.array(*[F.lit(t) for t in _TEACHER]), (F.col("q") % 5).cast("int")))


@query("classification_summary", f"SELECT source_name, {_SUMMARY_SQL.format(p='deployed_family')} FROM (SELECT *, {_TEACHER_SQL} AS t FROM deployed) GROUP BY 1", "deployed")
def classification_summary(spark, sf):
    return tidy(P.classification_summary(P.deploy(_with_teacher(policy_pool(spark, sf))), ["source_name"]))


_MARGINS = (0, 0.02, 0.05, 0.08, 0.10, 0.12, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)


@query("risk_margin_sweep", f"""
SELECT min_risky_margin, a.rows, a.accuracy, a.positive_accuracy, a.nonbase_positive_accuracy, a.reject_recall, a.false_texture_promotions,
  round_even(a.a8 - b.a8, 6) AS accuracy_delta_vs_raw, round_even(a.r8 - b.r8, 6) AS reject_recall_delta_vs_raw,
  a.false_texture_promotions - b.false_texture_promotions AS false_texture_delta_vs_raw
FROM (SELECT min_risky_margin, {_SUMMARY_SQL.format(p='dep')}, round_even(count_if(dep = t) / count(*), 8) AS a8,
    round_even(count_if(dep = t AND t = 'reject') / greatest(1, count_if(t = 'reject')), 8) AS r8
  FROM (SELECT *, {_TEACHER_SQL} AS t, CASE WHEN predicted_family NOT IN ('base_keep', 'reject') AND mg < min_risky_margin THEN 'reject' ELSE predicted_family END AS dep
        FROM deployed, (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in _MARGINS)}]) AS min_risky_margin)) GROUP BY 1) a,
 (SELECT {_SUMMARY_SQL.format(p='predicted_family')}, round_even(count_if(predicted_family = t) / count(*), 8) AS a8,
    round_even(count_if(predicted_family = t AND t = 'reject') / greatest(1, count_if(t = 'reject')), 8) AS r8 FROM (SELECT *, {_TEACHER_SQL} AS t FROM deployed)) b""", "deployed")
def risk_margin_sweep(spark, sf):
    return tidy(P.margin_sweep(_with_teacher(policy_pool(spark, sf)), _MARGINS))


@query("confusion_table", f"SELECT {_TEACHER_SQL} AS teacher_family, predicted_family, count(*) AS count FROM deployed GROUP BY 1, 2", "deployed")
def confusion_table(spark, sf):
    return _with_teacher(policy_pool(spark, sf)).groupBy("teacher_family", "predicted_family").agg(F.count(F.lit(1)).alias("count"))


cte("learned", """
SELECT *, CASE WHEN NOT sweep_pass THEN 'preview_sweep_gate_failed' WHEN dep0 = 'reject' THEN 'learned_selector_reject' ELSE 'learned_selector_accept' END AS gate_reason,
  round_even(sweep_score + 0.001 * greatest(0.0, m8), 8) AS policy_score
FROM (SELECT d.*, g.gate_pass AS sweep_pass, g.policy_score AS sweep_score, round_even(d.mg, 8) AS m8,
  CASE WHEN d.predicted_family NOT IN ('base_keep', 'reject') AND d.mg < 0.0 THEN 'reject' ELSE d.predicted_family END AS dep0
  FROM deployed d JOIN gated_preview_sweep g USING (sample_id, candidate))""", "deployed", "gated_preview_sweep")


@query("promote_learned_deployment", """
SELECT b.sample_id, b.source_name, b.category, b.candidate AS base_candidate, coalesce(g.candidate, b.candidate) AS chosen_candidate,
  g.candidate IS NOT NULL AS promoted, coalesce(g.gate_reason, 'baseline_kept') AS status, round_even(coalesce(g.policy_score, 0.0), 6) AS policy_score,
  round_even(coalesce(g.unified_loss, b.unified_loss), 6) AS unified_loss
FROM pool_base b LEFT JOIN (SELECT * FROM learned WHERE gate_reason = 'learned_selector_accept'
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY policy_score DESC, ordinal) = 1) g USING (sample_id)""", "learned", "pool_base")
def promote_learned_deployment(spark, sf):
    learned = P.learned_deployment(gated_pool(spark, sf, P.PREVIEW_SWEEP))
    return tidy(gates.promote_beside(learned, Policy("learned_deployment", (), "")))


@query("family_policy_texture", """
SELECT b.sample_id, coalesce(g.candidate, b.candidate) AS chosen_candidate,
  CASE WHEN g.candidate IS NULL THEN 'fallback_base_keep' ELSE 'eligible_texture_highest_utility' END AS reason
FROM pool_base b LEFT JOIN (SELECT t.* FROM gated_texture_teacher_gate t JOIN deployed d USING (sample_id, candidate)
  WHERE t.gate_pass AND t.candidate <> 'base_keep' AND d.deployed_family = 'satin_like'
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY t.policy_score DESC, t.ordinal) = 1) g USING (sample_id)""", "gated_texture_teacher_gate", "deployed", "pool_base")
def family_policy_texture(spark, sf):
    eligible = F.expr("candidate <> 'base_keep' AND deployed_family = 'satin_like'")
    chosen = gates.promote_beside(P.deploy(gated_pool(spark, sf, P.TEXTURE_TEACHER)), Policy("family_texture", (), ""), may=eligible)
    return chosen.select("sample_id", "chosen_candidate", F.when(F.col("promoted"), "eligible_texture_highest_utility").otherwise("fallback_base_keep").alias("reason"))
