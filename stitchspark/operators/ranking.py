"""Per-sample ranks, profile scores and choosers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hard_score
from ..functions.semantics import minmax_norm, num_value

POOL_METRICS = ("unified_loss", "jump_count", "trim_count", "off_mask_stitch_length_mm", "visible_connector_count",
                "coverage_ratio", "stitch_precision_ratio")
HIGH_IS_GOOD = ("coverage_ratio", "stitch_precision_ratio")
_L, _J, _T, _O, _V, _C, _P = POOL_METRICS
# Weights of the pool-normalised metrics per profile.
PROFILE_WEIGHTS: dict[str, dict[str, float]] = {
    "precision": {_P: 0.52, _L: 0.14, _C: 0.10, _J: 0.08, _T: 0.03, _O: 0.03},
    "strict_precision": {_P: 0.62, _L: 0.14, _C: 0.10, _J: 0.08, _T: 0.03, _O: 0.03},
    "coverage": {_C: 0.52, _L: 0.16, _P: 0.10, _J: 0.07, _T: 0.03, _O: 0.02},
    "strict_coverage": {_C: 0.62, _L: 0.16, _P: 0.10, _J: 0.07, _T: 0.03, _O: 0.02},
    "low_jump": {_J: 0.52, _T: 0.12, _L: 0.14, _C: 0.08, _P: 0.02, _O: 0.02},
    "strict_low_jump": {_J: 0.62, _T: 0.12, _L: 0.14, _C: 0.08, _P: 0.02, _O: 0.02},
    "low_loss": {_L: 0.60, _J: 0.12, _T: 0.06, _C: 0.12, _P: 0.04, _O: 0.06},
    "balanced": {_L: 0.34, _J: 0.12, _T: 0.06, _C: 0.20, _P: 0.14, _O: 0.08, _V: 0.06},
}
# Coverage floors per profile.
COVERAGE_FLOORS = {"low_loss": 0.90, "balanced": 0.90, "precision": 0.88, "coverage": 0.97, "low_jump": 0.90,
                   "strict_precision": 0.85, "strict_coverage": 0.99, "strict_low_jump": 0.90}


def learned_rank(df: DataFrame, score: str, key: Sequence[str] = ("sample_id",), descending: bool = False,
                 tie: str = "ordinal") -> DataFrame:
    """Position of each row in its pool by a score, and index / (n - 1); pools, which their generators bound, are grouped once."""
    value = -F.col(score) if descending else F.col(score)
    pool = Window.partitionBy(*key)
    ranked = df.withColumns({"pool_rank": F.row_number().over(pool.orderBy(value.asc(), F.col(tie).asc())).cast("long"),
                             "pool_size": F.count(F.lit(1)).over(pool)})
    return ranked.withColumn("learned_rank_score", (F.col("pool_rank") - 1) / F.greatest(F.lit(1), F.col("pool_size") - 1))


def with_spans(df: DataFrame, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The least and greatest value of each pool metric as lo_ and hi_ columns."""
    pool = Window.partitionBy(*key)
    return df.withColumns({f"{n}_{m}": f(num_value(m)).over(pool) for m in POOL_METRICS for n, f in (("lo", F.min), ("hi", F.max))})


def expand_profiles(df: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Each row once per task profile."""
    return df.withColumn("task_profile", F.explode(F.array(*[F.lit(p) for p in profiles])))


def task_features(weights: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    """Profile indicators, profile weights and weight x measure columns for a table with task_profile."""
    measures = {"coverage": "coverage_ratio", "precision": "stitch_precision_ratio", "off_mask": "off_mask_stitch_length_mm",
                "visible": "visible_connector_count", "jump": "jump_count", "trim": "trim_count"}
    is_p = lambda p: (F.col("task_profile") == p)
    out = {f"task_is_{p}": is_p(p).cast("double") for p in weights}
    for part, metric in measures.items():
        w = F.lit(0.0)
        for p, row in weights.items():
            w = F.when(is_p(p), F.lit(float(row[part]))).otherwise(w)
        out[f"task_{part}_weight"] = w
        out[f"task_{part}_weight_x_{metric}"] = w * num_value(metric)
    out["task_low_loss_x_unified_loss"] = is_p("low_loss").cast("double") * num_value("unified_loss")
    return out


def profile_rerank(ranked: DataFrame, strength: float, coverage_floors: Mapping[str, float] | None = None,
                   coverage_weight: float = 0.0, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Semantic and calibrated score of each row of a pool (columns task_profile and learned_rank_score).

    Rows that carry their pool's spans (``with_spans``) are scored as they are; of others the spans over ``key`` are found first."""
    df = ranked if f"lo_{POOL_METRICS[0]}" in ranked.columns else with_spans(ranked, key)

    def norm(m: str) -> Column:
        low = minmax_norm(num_value(m), f"lo_{m}", f"hi_{m}", eps=1e-9)
        return 1.0 - low if m in HIGH_IS_GOOD else low

    def score(profile: str) -> Column:
        total = F.lit(0.0)
        for m, w in PROFILE_WEIGHTS[profile].items():
            total = total + w * norm(m)
        return total

    semantic = score("balanced")
    for p in PROFILE_WEIGHTS:
        if p != "balanced":
            semantic = F.when(F.col("task_profile") == p, score(p)).otherwise(semantic)
    if coverage_floors and coverage_weight > 0:
        semantic = semantic + coverage_weight * F.greatest(F.lit(0.0), floor_of(coverage_floors) - num_value("coverage_ratio"))
    df = df.withColumn("semantic_score", semantic)
    calibrated = (1.0 - strength) * F.col("learned_rank_score") + strength * F.col("semantic_score")
    return df.withColumn("calibrated_score", calibrated).drop(*[f"{n}_{m}" for m in POOL_METRICS for n in ("lo", "hi")])


def floor_of(floors: Mapping[str, float], default: float = 0.90) -> Column:
    out = F.lit(float(default))
    for p, v in floors.items():
        out = F.when(F.col("task_profile") == p, F.lit(float(v))).otherwise(out)
    return out


def _order() -> Column:
    return F.struct(F.col("calibrated_score").alias("c"), F.col("learned_rank_score").alias("l"), F.col("ordinal").alias("o"))


PAYLOAD = ("candidate", "ordinal", "source_name", "calibrated_score", "learned_rank_score", *POOL_METRICS)


def _row(names: Sequence[str] = PAYLOAD) -> Column:
    return F.struct(*names)


def coverage_constraint(reranked: DataFrame, floors: Mapping[str, float], fallback_margin: float = 0.03,
                        key: Sequence[str] = ("sample_id", "task_profile")) -> DataFrame:
    """First row that reaches the floor, else the relaxed floor, else the first row."""
    floor, cov = floor_of(floors), num_value("coverage_ratio") + 1e-9
    relaxed = F.greatest(F.lit(0.0), floor - max(0.0, fallback_margin))
    level = F.when(cov >= floor, 0).when(cov >= relaxed, 1).otherwise(2)
    best = reranked.withColumn("_level", level).groupBy(*key).agg(
        F.min_by(_row(), F.struct("_level", _order())).alias("r"), F.min("_level").alias("_level"))
    return best.select(*key, F.col("r.candidate").alias("chosen_candidate"), F.col("r.calibrated_score").alias("calibrated_score"),
                       F.col("r.coverage_ratio").alias("coverage_ratio"), (F.col("_level") == 0).alias("constraint_met"))


def benefit_gate(reranked: DataFrame, floors: Mapping[str, float], absolute_min_coverage: float = 0.65,
                 min_jump_gain: float = 3.0, min_precision: float = 0.8, max_loss_slack: float = 0.02,
                 key: Sequence[str] = ("sample_id", "task_profile")) -> DataFrame:
    """First row in order that is safe or trades coverage for enough benefit against the first safe row.

    Returns one row per key with the chosen row as a struct, the baseline row and the mode.
    """
    rows = benefit_rows(reranked, floors, absolute_min_coverage, min_jump_gain, min_precision, max_loss_slack, key)
    return rows.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("chosen", "base", "gate_mode", "gate_met")])


def benefit_rows(reranked: DataFrame, floors: Mapping[str, float], absolute_min_coverage: float = 0.65,
                 min_jump_gain: float = 3.0, min_precision: float = 0.8, max_loss_slack: float = 0.02,
                 key: Sequence[str] = ("sample_id", "task_profile")) -> DataFrame:
    """``reranked`` with the columns of :func:`benefit_gate` on each row; a pool is grouped once and joined to nothing."""
    eps, pool = 1e-9, Window.partitionBy(*key)
    safe = num_value("coverage_ratio") + eps >= floor_of(floors)
    first = lambda row, cond: F.min_by(F.when(cond, row), F.when(cond, _order())).over(pool)
    marked = reranked.withColumn("_safe", safe)
    based = marked.withColumns({"base": F.coalesce(first(_row(), F.col("_safe")), F.min_by(_row(), _order()).over(pool)), "_any": F.max("_safe").over(pool)})
    trade = ((num_value("coverage_ratio") + eps >= absolute_min_coverage)
             & (F.col("base.jump_count") - num_value("jump_count") + eps >= min_jump_gain)
             & (num_value("stitch_precision_ratio") + eps >= min_precision)
             & (num_value("unified_loss") - F.col("base.unified_loss") <= max_loss_slack + eps))
    mode = F.when(F.col("_safe"), F.lit("safe_coverage")).when(trade, F.lit("benefit_tradeoff"))
    found = based.withColumn("_mode", mode).withColumn("_a", first(F.struct(_row().alias("row"), "_mode"), F.col("_mode").isNotNull()))
    return found.withColumns({
        "chosen": F.coalesce("_a.row", "base"), "gate_mode": F.coalesce("_a._mode", F.lit("safe_fallback")),
        "gate_met": F.col("_a._mode").isNotNull() | F.col("_any")}).drop("_safe", "_any", "_mode", "_a")


# Settings of the line-domain guard chain.
GUARD = {
    "target_coverage": 0.88, "target_precision": 0.75, "absolute_min_coverage": 0.6, "absolute_min_precision": 0.45,
    "max_jump_count": 10.0, "max_off_mask_mm": 1.0, "max_visible_count": 0.0, "max_trim_count": 6.0, "max_loss_slack": 0.03,
}
RESCUE = {"min_coverage": 0.7, "min_jump_gain": 1.0, "max_loss_slack": 0.0, "max_coverage_drop": 0.05, "max_precision_drop": 0.02}
PRECISION_RESCUE = {"trigger_precision": 0.6, "min_precision": 0.65, "min_gain": 0.1, "min_coverage": 0.85, "max_coverage_drop": 0.08,
                    "max_loss_slack": 0.06, "max_jump_increase": 6.0, "max_trim_increase": 2.0}


def anchored(chosen: DataFrame, reranked: DataFrame, anchors: DataFrame, key: str = "sample_id") -> DataFrame:
    """Replace the chosen row by the anchor's candidate where the pool has it (``anchors``: key, anchor_candidate)."""
    hits = reranked.join(anchors, key).filter(F.col("candidate") == F.col("anchor_candidate")).groupBy(key).agg(
        F.min_by(_row(), _order()).alias("_hit"))
    return _anchor_modes(chosen.join(anchors, key, "left").join(hits, key, "left"))


def anchored_rows(rows: DataFrame, anchor: Column, key: str = "sample_id") -> DataFrame:
    """:func:`anchored` over pool rows that carry their chosen row (``benefit_rows``) and name their anchor in a column (null: none)."""
    held = rows.withColumn("anchor_candidate", anchor)
    is_hit = F.col("candidate") == F.col("anchor_candidate")
    return _anchor_modes(held.groupBy(key).agg(
        F.first("chosen").alias("chosen"), F.first("anchor_candidate").alias("anchor_candidate"), F.min_by(F.when(is_hit, _row()), F.when(is_hit, _order())).alias("_hit")))


def _anchor_modes(met: DataFrame) -> DataFrame:
    mode = (F.when(F.col("anchor_candidate").isNull(), F.lit("no_anchor_row"))
            .when(F.trim("anchor_candidate") == "", F.lit("missing_anchor_candidate"))
            .when(F.col("_hit").isNull(), F.lit("anchor_candidate_not_found")).otherwise(F.lit("anchored_baseline")))
    return met.withColumns({"anchor_mode": mode, "chosen": F.coalesce("_hit", "chosen")}).drop("_hit", "anchor_candidate")


def line_guard_chain(rows: DataFrame, line_sources: Sequence[str] = ("QuickDraw", "Rendered text"), key: str = "sample_id") -> DataFrame:
    """Guard, relative rescue and precision rescue for line sources, each against the row chosen before it.

    ``rows``: pool rows that carry their chosen row (``benefit_rows``); a pool is grouped once for all steps."""
    eps, n = 1e-9, num_value
    cov, prec, jump, trim, off, vis, loss = (n(m) for m in (_C, _P, _J, _T, _O, _V, _L))
    pos = lambda c: F.greatest(F.lit(0.0), c)
    is_line = F.coalesce(F.col("chosen.source_name").isin(*line_sources), F.lit(False))
    score = (loss + 0.004 * jump + 0.002 * trim + 0.01 * off + 0.005 * vis + 0.55 * pos(GUARD["target_coverage"] - cov)
             + 0.22 * pos(GUARD["target_precision"] - prec))
    valid = ((cov + eps >= GUARD["absolute_min_coverage"]) & (prec + eps >= GUARD["absolute_min_precision"])
             & (jump <= GUARD["max_jump_count"] + eps) & (off <= GUARD["max_off_mask_mm"] + eps)
             & (vis <= GUARD["max_visible_count"] + eps) & (trim <= GUARD["max_trim_count"] + eps))
    b = lambda m: F.col(f"chosen.{m}")
    relative = ((cov + eps >= RESCUE["min_coverage"]) & (jump <= b(_J) - RESCUE["min_jump_gain"] + eps)
                & (loss <= b(_L) + RESCUE["max_loss_slack"] + eps) & (cov + RESCUE["max_coverage_drop"] + eps >= b(_C))
                & (prec + RESCUE["max_precision_drop"] + eps >= b(_P)) & (vis <= b(_V) + eps) & (off <= b(_O) + eps))
    rescue_score = loss + 0.004 * jump + 0.2 * pos(0.8 - cov) + 0.1 * pos(0.7 - prec)
    by = lambda s, cond=None: F.min_by(_row() if cond is None else F.when(cond, _row()),
                                       F.struct(F.col(s), _order()) if cond is None else F.when(cond, F.struct(F.col(s), _order())))
    pool = Window.partitionBy(key)
    marked = rows.withColumns({"_line": is_line, "_s": score, "_ok": valid, "_rs": rescue_score, "_rel": relative})
    picks = marked.withColumns({"g": F.coalesce(by("_s", F.col("_ok")).over(pool), by("_s").over(pool)), "rel": by("_rs", F.col("_rel")).over(pool)})
    slack = F.col("g.unified_loss") - F.col("chosen.unified_loss") > GUARD["max_loss_slack"] + eps
    staged = picks.withColumns({
        "guard_mode": F.when(slack, F.lit("baseline_loss_guard")).otherwise(F.lit("line_domain_guard")),
        "current": F.when(F.col("rel").isNotNull(), F.col("rel")).when(slack, F.col("chosen")).otherwise(F.col("g")),
        "rescue_mode": F.when(F.col("rel").isNotNull(), F.lit("relative_rescue")).otherwise(F.lit("no_rescue_candidate"))})

    p = PRECISION_RESCUE
    low = F.col("current.stitch_precision_ratio") + eps < p["trigger_precision"]
    cur = lambda m: F.col(f"current.{m}")
    gain = prec - cur(_P)
    fits = ((prec + eps >= p["min_precision"]) & (gain + eps >= p["min_gain"]) & (cov + eps >= p["min_coverage"])
            & (cov + p["max_coverage_drop"] + eps >= cur(_C)) & (loss <= cur(_L) + p["max_loss_slack"] + eps)
            & (jump <= cur(_J) + p["max_jump_increase"] + eps) & (trim <= cur(_T) + p["max_trim_increase"] + eps)
            & (vis <= cur(_V) + eps) & (off <= cur(_O) + eps))
    ps = loss + 0.004 * jump + 0.002 * trim + 0.2 * pos(0.9 - cov) - 0.1 * gain
    done = staged.withColumns({"_fits": low & fits, "_ps": ps}).groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("chosen", "_line", "guard_mode", "rescue_mode", "current")], by("_ps", F.col("_fits")).alias("pr"))
    line = lambda c, other: F.when(F.col("_line"), c).otherwise(other)
    mode = (F.when(~low, F.lit("precision_not_low")).when(F.col("pr").isNull(), F.lit("no_precision_rescue_candidate"))
            .otherwise(F.lit("precision_rescue")))
    final = lambda m: line(F.coalesce(f"pr.{m}", f"current.{m}", f"chosen.{m}"), F.col(f"chosen.{m}"))
    return done.select(
        key, F.col("chosen.candidate").alias("base_candidate"), final("candidate").alias("chosen_candidate"), final("unified_loss").alias("unified_loss"),
        line(F.col("guard_mode"), F.lit("non_line_domain")).alias("guard_mode"), line(F.col("rescue_mode"), F.lit("")).alias("rescue_mode"),
        line(mode, F.lit("")).alias("precision_mode"))


# Coverage targets by source.
SOURCE_TARGETS = {
    "public_soft": {"Openclipart": 0.82, "OpenMoji": 0.78, "QuickDraw": 0.55, "Oxford-IIIT Pet": 0.74, "Rendered text": 0.55,
                    "Incoming paired review": 0.78},
    "public_balanced": {"Openclipart": 0.88, "OpenMoji": 0.84, "QuickDraw": 0.58, "Oxford-IIIT Pet": 0.78, "Rendered text": 0.60,
                        "Incoming paired review": 0.82},
    "public_conservative": {"Openclipart": 0.92, "OpenMoji": 0.88, "QuickDraw": 0.62, "Oxford-IIIT Pet": 0.82, "Rendered text": 0.65,
                            "Incoming paired review": 0.84},
}
CALIBRATED = {"unified_weight": 1.0, "coverage_weight": 0.35, "precision_weight": 0.15, "jump_weight": 0.02, "trim_weight": 0.02,
              "off_mask_weight": 0.05, "visible_weight": 0.05, "min_coverage": 0.80, "adaptive_flat_min_coverage": 0.84,
              "adaptive_line_min_coverage": 0.58, "min_precision": 0.72, "jump_scale": 20.0, "trim_scale": 8.0, "hard_fail_penalty": 0.04}


def coverage_target(profile: str = "global", config: Mapping[str, float] = CALIBRATED) -> Column:
    if profile == "global":
        return F.lit(float(config["min_coverage"]))
    line = F.col("source_name").isin("QuickDraw", "Rendered text")
    out = F.when(line, F.lit(config["adaptive_line_min_coverage"])).otherwise(F.lit(config["adaptive_flat_min_coverage"]))
    for source, target in SOURCE_TARGETS[profile].items():
        out = F.when(F.col("source_name") == source, F.lit(target)).otherwise(out)
    return out


def calibrated_score(profile: str = "global", config: Mapping[str, float] | None = None, param=None) -> Column:
    """Calibrated cost; ``param(name)`` may read settings from columns of a parameter grid."""
    config = {**CALIBRATED, **(config or {})}
    get = param or (lambda name: F.lit(float(config[name])))
    pos = lambda c: F.greatest(F.lit(0.0), c)
    return (get("unified_weight") * num_value("unified_loss")
            + get("coverage_weight") * pos(coverage_target(profile, config) - num_value("coverage_ratio"))
            + get("precision_weight") * pos(config["min_precision"] - num_value("stitch_precision_ratio"))
            + get("jump_weight") * (num_value("jump_count") / max(1.0, config["jump_scale"]))
            + get("trim_weight") * (num_value("trim_count") / max(1.0, config["trim_scale"]))
            + get("off_mask_weight") * num_value("off_mask_stitch_length_mm")
            + get("visible_weight") * num_value("visible_connector_count")
            + F.when(F.col("quality_level") == "hard_fail", F.lit(config["hard_fail_penalty"])).otherwise(F.lit(0.0)))


def candidate_metric_gate(max_off: float = 0.05, max_jump: float = 15.0, max_trim: float = 3.0, min_precision: float = 0.75,
                          min_coverage: float = 0.8) -> Column:
    return ((num_value("off_mask_stitch_length_mm") <= max_off) & (num_value("jump_count") <= max_jump)
            & (num_value("trim_count") <= max_trim) & (num_value("stitch_precision_ratio") >= min_precision)
            & (num_value("coverage_ratio") >= min_coverage))


def pool_gates(flat_min: float = 0.75, line_min: float = 0.45, tolerance: float = 0.0,
               line_sources: Sequence[str] = ("QuickDraw", "Rendered text")) -> list[Column]:
    """Hard-safe, coverage floor, style-aware and mask-fill gates in their order."""
    name = F.lower("candidate")
    floor = F.when(F.col("source_name").isin(*line_sources), F.lit(line_min)).otherwise(F.lit(flat_min))
    styled = name.contains("styleaware") | name.contains("style_aware")
    return [
        F.col("quality_level") != "hard_fail",
        num_value("coverage_ratio") >= F.greatest(F.lit(0.0), floor - tolerance),
        ~styled | candidate_metric_gate(),
        ~name.contains("mask_fill") | candidate_metric_gate(max_jump=20.0, min_precision=0.70),
    ]


# The order of hard failures.
HARD_ORDER = ("parse_fail", "visible_connector_count", "off_mask_stitch_length_mm", "jump_count", "trim_count", "unified_loss")


def hard_and_mean_ranks(df: DataFrame, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """0-based positions by the lexicographic hard order and by loss, and the best flags. The candidates of a sample, which its generators bound, are
    grouped once for both orders."""
    d = df.withColumn("parse_fail", (~F.col("round_trip_parse_success")).cast("int")).withColumn("hard_score", hard_score())
    place = lambda *order: (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long")
    ranked = d.withColumns({"hard_rank": place(*HARD_ORDER, "ordinal"), "mean_rank": place("unified_loss", "ordinal")})
    return ranked.withColumns({"is_hard_best": F.col("hard_rank") == 0, "is_mean_best": F.col("mean_rank") == 0})


def oracle_choice(df: DataFrame, score: str = "oracle_score", key: str = "sample_id") -> DataFrame:
    """Flag of the first lowest score per sample."""
    best = F.min_by("ordinal", F.struct(score, "ordinal")).over(Window.partitionBy(key))
    return df.withColumn("_best", best).withColumn("is_oracle_choice", (F.col("ordinal") == F.col("_best")).cast("int")).drop("_best")


def top_k_policy(candidates: DataFrame, k: int = 4, min_inside: float = 0.0, max_distance: float = 0.0,
                 key: Sequence[str] = ("decision_id",)) -> DataFrame:
    """Cheapest k nodes of a decision, safe ones if any, then the best decode score.

    ``candidates``: decision_id, node_id, cost, distance_mm, inside_fraction, utility, decode_penalty.
    """
    from pyspark.sql import Window as W
    ranked = candidates.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("cost", "node_id"))).filter(F.col("_r") <= k)
    safe = (F.col("inside_fraction") >= min_inside) & (F.lit(max_distance <= 0.0) | (F.col("distance_mm") <= max_distance))
    score = F.col("utility") - F.col("decode_penalty")
    row = F.struct("node_id", "utility", F.lit(0).alias("x"))
    order = F.struct(score.alias("a"), F.col("utility").alias("b"), (-F.col("cost")).alias("c"), (-F.col("node_id")).alias("d"))
    # At most k rows per decision are left, so the fallback to the unfiltered pool is decided on them.
    best = ranked.withColumn("_safe", safe).groupBy(*key).agg(
        F.coalesce(F.max_by(F.when(F.col("_safe"), row), F.when(F.col("_safe"), order)), F.max_by(row, order)).alias("p"),
        F.min_by("node_id", "_r").alias("deterministic_node"), F.count_if(~F.col("_safe")).alias("_unsafe"), F.max("_safe").alias("_any"))
    return best.select(*key, F.col("p.node_id").alias("chosen_node"), "deterministic_node",
                       (F.col("p.node_id") != F.col("deterministic_node")).alias("override"),
                       F.when(F.col("_any"), F.col("_unsafe")).otherwise(F.lit(0)).cast("long").alias("filtered"))


def hardest_negatives(rows: DataFrame, per_decision: int, key: str = "decision_id", label: str = "label",
                      distance: str = "distance_mm", node: str = "node_id") -> DataFrame:
    """All positives and the nearest negatives of each decision."""
    from pyspark.sql import Window as W
    kept = rows.filter(F.col(label) == 0).withColumn(
        "_r", F.row_number().over(W.partitionBy(key).orderBy(distance, node))).filter(F.col("_r") <= per_decision).drop("_r")
    return rows.filter(F.col(label) == 1).unionByName(kept)


def first_or_fallback(df: DataFrame, key: str, prefer: Column, order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """The preferred row of each key, else the first in order."""
    rank = F.struct(F.when(prefer, 0).otherwise(1).alias("p"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(key).agg(F.min_by(F.struct(*payload), rank).alias("r")).select(key, "r.*")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def nearest_preset(samples: DataFrame, presets: Sequence[Mapping[str, object]], scales: Mapping[str, float]) -> DataFrame:
    """Name of the preset with the least scaled squared error (earlier preset wins a tie)."""
    def gap(i: int, preset: Mapping[str, object]) -> Column:
        total = F.lit(0.0)
        for name, scale in scales.items():
            d = (F.col(name) - F.lit(float(preset[name]))) / F.lit(max(1e-6, float(scale)))
            total = total + d * d
        return F.struct((total / len(scales)).alias("d"), F.lit(i).alias("i"), F.lit(str(preset["name"])).alias("n"))
    best = F.array_min(F.array(*[gap(i, p) for i, p in enumerate(presets)]))
    return samples.withColumns({"nearest_preset": best["n"], "preset_error": best["d"]})
