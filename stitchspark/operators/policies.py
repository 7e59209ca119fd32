"""The promotion policies as tables of rules (reasons, limits and weights are fixed values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import Policy, Reject, Term

OFF, VIS, LOSS = "off_mask_stitch_length_mm", "visible_connector_count", "unified_loss"
JUMP, TRIM = "jump_count", "trim_count"
COV, PREC = "coverage_ratio", "stitch_precision_ratio"
ACOV, APREC, OVER = "adaptive_coverage_ratio", "adaptive_stitch_precision_ratio", "overfill_outside_adaptive_ratio"
TEX, PREV = "generator_texture_score", "professional_preview_score"
EPS = 1e-9
HARD = Reject("candidate_hard_fail", "quality_level", "is", "hard_fail")


def increases(limits: dict[str, float], names: dict[str, str]) -> list[Reject]:
    return [Reject(names[m], f"d:{m}", ">", limit) for m, limit in limits.items()]


INCREASE = {OFF: "off_mask_increase", VIS: "visible_increase", JUMP: "jump_increase", TRIM: "trim_increase", LOSS: "loss_increase"}
TOO_LARGE = {VIS: "visible_connector_increase", OFF: "off_mask_increase", LOSS: "loss_increase_too_large",
             JUMP: "jump_increase_too_large", TRIM: "trim_increase_too_large"}
PREVIEW_LADDER = (
    Reject("preview_gain_too_small", f"d:{PREV}", "<", 0.001),
    Reject("texture_regression_too_large", f"d:{TEX}", "<", -0.05),
    Reject("visible_connector_increase", f"d:{VIS}", ">", 0.0),
    Reject("off_mask_increase", f"d:{OFF}", ">", 0.0),
    Reject("loss_increase", f"d:{LOSS}", ">", 0.01),
    Reject("jump_increase", f"d:{JUMP}", ">", 2.0),
    Reject("trim_increase", f"d:{TRIM}", ">", 2.0),
    Reject("coverage_drop", f"d:{COV}", "<", -0.015),
    Reject("precision_drop", f"d:{PREC}", "<", -0.03),
)

GUARDED = Policy(
    "guarded_no_regression",
    [HARD, *increases({OFF: 0.0, VIS: 0.0, JUMP: 0.0, TRIM: 0.0, LOSS: 0.0}, INCREASE),
     Reject("coverage_drop", f"d:{COV}", "<", -0.005), Reject("strict_precision_drop", f"d:{PREC}", "<", -0.005),
     Reject("adaptive_coverage_drop", f"d:{ACOV}", "<", -0.01), Reject("adaptive_precision_drop", f"d:{APREC}", "<", -0.01),
     Reject("absolute_coverage_too_low", COV, "<", 0.90), Reject("absolute_adaptive_coverage_too_low", ACOV, "<", 0.85),
     Reject("absolute_adaptive_precision_too_low", APREC, "<", 0.94)],
    "", [Term(1.0, f"-d:{LOSS}"), Term(0.006, f"-d:{JUMP}"), Term(0.003, f"-d:{TRIM}"), Term(0.02, f"d:{COV}"),
         Term(0.02, f"d:{PREC}"), Term(0.02, f"d:{ACOV}"), Term(0.02, f"d:{APREC}")],
    gains=[("loss_reduced", f"-d:{LOSS}", 0.0005), ("jump_reduced", f"-d:{JUMP}", 1.0), ("trim_reduced", f"-d:{TRIM}", 1.0),
           ("coverage_improved", f"d:{COV}", 0.01), ("strict_precision_improved", f"d:{PREC}", 0.01),
           ("adaptive_coverage_improved", f"d:{ACOV}", 0.01), ("adaptive_precision_improved", f"d:{APREC}", 0.005)],
    min_score=0.0, score_reason="guarded_score_too_low")

TEXT_RESCUE = Policy(
    "text_precision_rescue",
    [Reject("adaptive_precision_low", APREC, "<", 0.95 - EPS), Reject("precision_gain_small", f"d:{APREC}", "<", 0.02 - EPS),
     Reject("adaptive_coverage_low", ACOV, "<", 0.88 - EPS), Reject("coverage_low", COV, "<", 0.95 - EPS),
     Reject("visible_increase", f"d:{VIS}", ">", EPS), Reject("off_mask_increase", f"d:{OFF}", ">", 0.25 + EPS),
     Reject("loss_increase", f"d:{LOSS}", ">", 0.04 + EPS), Reject("jump_increase", f"d:{JUMP}", ">", 4.0 + EPS),
     Reject("trim_increase", f"d:{TRIM}", ">", 2.0 + EPS)],
    "text_precision_rescue",
    [Term(1.0, LOSS), Term(0.004, JUMP), Term(0.002, TRIM), Term(0.15, ACOV, "deficit", 0.92),
     Term(0.05, COV, "deficit", 0.98), Term(-0.04, f"d:{APREC}")],
    best="min", round_score=False, only_sources=("Rendered text",))

TEXT_SWITCHER = Policy(
    "text_profile_switcher",
    [Reject("precision_gain_too_small", f"d:{APREC}", "<", 0.015), Reject("overfill_reduction_too_small", f"-d:{OVER}", "<", 0.015),
     *increases({VIS: 0.0, OFF: 0.25, LOSS: 0.12, JUMP: 12.0, TRIM: 4.0}, TOO_LARGE),
     Reject("adaptive_precision_too_low", APREC, "<", 0.95), Reject("adaptive_coverage_too_low", ACOV, "<", 0.88)],
    "text_legibility_gain", only_sources=("Rendered text",))

LINE_ART = Policy(
    "line_art_profile",
    [HARD, Reject("adaptive_precision_gain_too_small", f"d:{APREC}", "<", 0.1), Reject("strict_precision_gain_too_small", f"d:{PREC}", "<", 0.03),
     Reject("overfill_reduction_too_small", f"-d:{OVER}", "<", 0.05), Reject("adaptive_precision_too_low", APREC, "<", 0.95),
     Reject("adaptive_coverage_too_low", ACOV, "<", 0.84), *increases({VIS: 0.0, OFF: 0.25, LOSS: 0.18, JUMP: 22.0, TRIM: 4.0}, TOO_LARGE)],
    "line_art_precision_gain",
    [Term(1.0, LOSS), Term(0.004, JUMP), Term(0.002, TRIM), Term(0.12, ACOV, "deficit", 0.84), Term(0.04, COV, "deficit", 0.92),
     Term(-0.08, f"d:{APREC}"), Term(-0.05, f"d:{PREC}")],
    best="min", round_score=False, only_sources=("QuickDraw",))

LINE_JUMP = Policy(
    "line_art_jump_relief",
    [HARD, Reject("base_jump_not_high", f"b:{JUMP}", "<", 12.0), Reject("jump_reduction_too_small", f"-d:{JUMP}", "<", 4.0),
     Reject("candidate_jump_too_high", JUMP, ">", 10.0), Reject("adaptive_precision_too_low", APREC, "<", 0.94),
     Reject("adaptive_coverage_too_low", ACOV, "<", 0.85), Reject("coverage_too_low", COV, "<", 0.94),
     Reject("strict_precision_too_low", PREC, "<", 0.70), Reject("adaptive_precision_drop_too_large", f"-d:{APREC}", ">", 0.04),
     Reject("strict_precision_drop_too_large", f"-d:{PREC}", ">", 0.06), Reject("loss_increase_too_large", f"d:{LOSS}", ">", 0.0),
     Reject("trim_increase_too_large", f"d:{TRIM}", ">", 0.0), Reject("visible_increase", f"d:{VIS}", ">", 0.0),
     Reject("off_mask_increase", f"d:{OFF}", ">", 0.0)],
    "line_art_jump_relief",
    [Term(1.0, LOSS), Term(0.004, JUMP), Term(0.002, TRIM), Term(0.08, COV, "deficit", 0.96), Term(0.1, ACOV, "deficit", 0.86),
     Term(0.14, f"-d:{APREC}", "positive"), Term(0.06, f"-d:{PREC}", "positive"), Term(-0.006, f"-d:{JUMP}"), Term(-0.1, f"-d:{LOSS}")],
    best="min", only_sources=("QuickDraw",))

LINE_SKELETON = Policy(
    "line_skeleton_fidelity",
    [HARD, *increases({OFF: 0.0, VIS: 0.0, JUMP: 0.0, TRIM: 0.0, LOSS: 0.0}, INCREASE),
     Reject("adaptive_precision_too_low", APREC, "<", 0.95),
     Reject("adaptive_skeleton_coverage_too_low", "adaptive_skeleton_coverage_ratio", "<", 0.95),
     Reject("skeleton_coverage_gain_too_small", "d:skeleton_coverage_ratio", "<", 0.005),
     Reject("adaptive_skeleton_coverage_gain_too_small", "d:adaptive_skeleton_coverage_ratio", "<", 0.005)],
    "line_skeleton_fidelity", only_sources=("QuickDraw",))

SHAPE = Policy(
    "shape_profile",
    [HARD, Reject("off_mask_reduction_too_small", f"-d:{OFF}", "<", 1.0), Reject("adaptive_precision_gain_too_small", f"d:{APREC}", "<", 0.03),
     Reject("strict_precision_gain_too_small", f"d:{PREC}", "<", 0.03), Reject("coverage_too_low", COV, "<", 0.96),
     Reject("adaptive_coverage_too_low", ACOV, "<", 0.90), *increases({VIS: 0.0, LOSS: 0.05, JUMP: 6.0, TRIM: 2.0}, TOO_LARGE)],
    "shape_offmask_precision_gain",
    [Term(1.0, LOSS), Term(0.004, JUMP), Term(0.002, TRIM), Term(0.08, COV, "deficit", 0.98), Term(0.1, ACOV, "deficit", 0.94),
     Term(-0.03, f"-d:{OFF}"), Term(-0.06, f"d:{APREC}"), Term(-0.04, f"d:{PREC}")],
    best="min", round_score=False, only_sources=("Openclipart",))

TEXT_LOW_PRECISION = Policy(
    "text_low_precision_profile",
    [HARD, Reject("base_precision_not_low", f"b:{APREC}", ">=", 0.9), Reject("adaptive_precision_too_low", APREC, "<", 0.9),
     Reject("adaptive_precision_gain_too_small", f"d:{APREC}", "<", 0.01), Reject("strict_precision_too_low", PREC, "<", 0.75),
     Reject("coverage_too_low", COV, "<", 0.98), Reject("adaptive_coverage_too_low", ACOV, "<", 0.94),
     Reject("loss_increase_too_large", f"d:{LOSS}", ">", 0.01), Reject("jump_increase_too_large", f"d:{JUMP}", ">", 1.0),
     Reject("trim_increase_too_large", f"d:{TRIM}", ">", 1.0), Reject("visible_increase", f"d:{VIS}", ">", 0.0),
     Reject("off_mask_increase", f"d:{OFF}", ">", 0.0)],
    "text_low_adaptive_precision_gain",
    [Term(1.0, LOSS), Term(0.004, JUMP), Term(0.002, TRIM), Term(0.08, COV, "deficit", 0.98), Term(0.12, ACOV, "deficit", 0.94),
     Term(0.08, PREC, "deficit", 0.75), Term(-0.08, f"d:{APREC}")],
    best="min", only_sources=("Rendered text",))

TEXTURE = Policy(
    "texture_profile",
    [HARD, Reject("excluded_source", "source_name", "in", ("QuickDraw", "TextRender")),
     *increases({OFF: 0.0, VIS: 0.0, JUMP: 0.0, TRIM: 0.0, LOSS: 0.002}, INCREASE),
     Reject("coverage_gain_too_small", f"d:{COV}", "<", 0.0), Reject("precision_drop_too_large", f"d:{PREC}", "<", -0.01),
     Reject("texture_gain_too_small", f"d:{TEX}", "<", 0.5), Reject("not_enough_satin_like_segments", "rail_and_dt_segments", "<", 60.0)],
    "texture_layer_safe",
    [Term(1.0, f"d:{TEX}"), Term(2.0, f"d:{COV}", "positive"), Term(3.0, f"d:{PREC}"), Term(-6.0, f"d:{LOSS}", "positive"),
     Term(-0.15, f"d:{JUMP}", "positive"), Term(-0.10, f"d:{TRIM}", "positive")])

TEXTURE_TEACHER = Policy(
    "texture_teacher_gate",
    [HARD, Reject("excluded_source", "source_name", "in", ("QuickDraw", "TextRender")),
     *increases({OFF: 0.0, VIS: 0.0, JUMP: 8.0, TRIM: 3.0, LOSS: 0.03}, INCREASE),
     Reject("coverage_gain_too_small", f"d:{COV}", "<", -0.015), Reject("precision_drop_too_large", f"d:{PREC}", "<", -0.04),
     Reject("texture_gain_too_small", f"d:{TEX}", "<", 0.35), Reject("not_enough_satin_like_segments", "satin_like_segments", "<", 35.0)],
    "professional_texture_allowed",
    [Term(1.0, f"d:{TEX}"), Term(2.0, f"d:{COV}"), Term(3.0, f"d:{PREC}"), Term(-6.0, f"d:{LOSS}", "positive"),
     Term(-0.15, f"d:{JUMP}", "positive"), Term(-0.1, f"d:{TRIM}", "positive"), Term(-20.0, f"d:{OFF}", "positive"),
     Term(-4.0, f"d:{VIS}", "positive")])

MULTIFAMILY = Policy(
    "multifamily_safety",
    [Reject("missing_prediction_dst", "executable_candidate", "in", (False,)),
     Reject("family_rejected", "deployed_family", "is", "reject"), Reject("hard_fail", "quality_level", "is", "hard_fail"),
     *increases({VIS: 0.0, OFF: 0.0, LOSS: 0.01, JUMP: 2.0, TRIM: 2.0}, INCREASE),
     Reject("coverage_drop", f"d:{COV}", "<", -0.015), Reject("precision_drop", f"d:{PREC}", "<", -0.03)],
    "safe_multifamily_candidate",
    [Term(2.0, f"-d:{LOSS}"), Term(0.04, f"-d:{JUMP}"), Term(0.05, f"-d:{TRIM}"), Term(0.8, f"d:{COV}"), Term(0.6, f"d:{PREC}"),
     Term(0.05, "selector_margin_vs_reject", "positive")],
    min_score=0.05, never_base=("candidate_family", "deployed_family"))

PREVIEW_VETO = Policy(
    "preview_gated",
    [Reject("baseline_or_empty_candidate", "candidate", "in", ("base_keep", "")),
     Reject("m2_82_policy_failed", "policy_pass", "in", (False,)),
     Reject("preview_score_regression", f"d:{PREV}", "<", 0.0), Reject("texture_score_regression", f"d:{TEX}", "<", -0.005),
     Reject("visible_connector_increase", f"d:{VIS}", ">", 0.0), Reject("off_mask_increase", f"d:{OFF}", ">", 0.0)],
    "preview_gate_pass")

_PREVIEW_TERMS = (Term(0.20, f"d:{COV}"), Term(-0.02, f"d:{JUMP}", "positive"), Term(-0.02, f"d:{TRIM}", "positive"))
PREVIEW_RERANK = Policy(
    "preview_aware_rerank",
    [Reject("baseline_or_empty_candidate", "candidate", "in", ("base_keep", "")), Reject("m2_82_policy_failed", "policy_pass", "not in", (True,)),
     Reject("missing_prediction_dst", "executable_candidate", "in", (False,)), *PREVIEW_LADDER],
    "preview_aware_candidate_pass",
    [Term(6.0, f"d:{PREV}"), Term(0.20, f"d:{TEX}"), Term(0.30, f"d:{PREC}"), Term(-0.80, f"d:{LOSS}", "positive"), *_PREVIEW_TERMS])

PREVIEW_SWEEP = Policy(
    "preview_sweep",
    [Reject("missing_prediction_dst", "executable_candidate", "in", (False,)),
     *(Reject(f"missing_{m}", m, "null", None) for m in ("unified_loss", "coverage_ratio", "stitch_precision_ratio")), *PREVIEW_LADDER],
    "preview_sweep_candidate_pass",
    [Term(6.5, f"d:{PREV}"), Term(0.25, f"d:{TEX}"), Term(0.35, f"d:{PREC}"), Term(-0.85, f"d:{LOSS}", "positive"), *_PREVIEW_TERMS],
    family_bonus={"satin_like": 0.0005, "dt_satin": 0.0005, "outline_border": 0.0005})

TEXTURE_OBJECTIVE = Policy(
    "professional_texture_objective",
    [Reject("round_trip_parse_failed", "round_trip_parse_success", "in", (False,)),
     Reject("hard_fail_quality_level", "quality_level", "is", "hard_fail"),
     Reject("preview_gain_too_small", f"d:{PREV}", "<", 0.001), Reject("texture_regression_too_large", f"d:{TEX}", "<", -0.05),
     Reject("visible_connector_absolute", f"d:{VIS}", ">", 0.0), Reject("visible_connector_increase", f"d:{VIS}", ">", 0.0),
     Reject("off_mask_absolute", OFF, ">", 0.5), Reject("off_mask_increase", f"d:{OFF}", ">", 0.25),
     Reject("loss_increase", f"d:{LOSS}", ">", 0.12), Reject("jump_increase", f"d:{JUMP}", ">", 20.0),
     Reject("trim_increase", f"d:{TRIM}", ">", 8.0), Reject("coverage_drop", f"d:{COV}", "<", -0.03),
     Reject("precision_drop", f"d:{PREC}", "<", -0.12), Reject("precision_absolute", PREC, "<", 0.70),
     Reject("coverage_absolute", COV, "<", 0.90)],
    "professional_texture_candidate_pass",
    [Term(10.0, f"d:{PREV}"), Term(1.0, f"d:{TEX}"), Term(0.8, "d:family_texture_score_norm"), Term(0.3, "d:directional_score"),
     Term(0.2, "d:rhythm_score"), Term(0.2, f"d:{COV}"), Term(-0.7, f"d:{LOSS}", "positive"), Term(-0.015, f"d:{JUMP}", "positive"),
     Term(-0.015, f"d:{TRIM}", "positive"), Term(-0.5, f"-d:{PREC}", "positive")],
    min_score=0.0,
    family_bonus={"satin_like": 0.005, "dt_satin": 0.005, "outline_border": 0.005, "edgewalk_fill": 0.002, "nearestrow_fill": 0.002})

ALL = (GUARDED, TEXT_RESCUE, TEXT_SWITCHER, LINE_ART, LINE_JUMP, LINE_SKELETON, SHAPE, TEXT_LOW_PRECISION, TEXTURE, TEXTURE_TEACHER,
       MULTIFAMILY, PREVIEW_VETO, PREVIEW_RERANK, PREVIEW_SWEEP, TEXTURE_OBJECTIVE)

# Labels of the family selector; the risky ones need a margin over reject.
LABELS = ("base_keep", "running_line", "auto_running", "auto_fill", "fill_tatami_like", "satin_like", "outline_border", "reject")
RISKY = LABELS[1:-1]
TEXTURE_FAMILIES = ("satin_like", "fill_tatami_like", "outline_border")


def predicted_family(labels: Sequence[str] = LABELS, reject_margin: float = 0.0, prefix: str = "score_") -> Column:
    """Label of the highest score (first wins a tie), unless reject plus its margin reaches it."""
    scores = F.array(*[F.col(prefix + n) for n in labels])
    best = F.get(F.array(*[F.lit(n) for n in labels]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    return F.when((best != "reject") & (F.array_max(scores) <= F.col(prefix + "reject") + reject_margin), F.lit("reject")).otherwise(best)


def reject_margin(predicted: str = "predicted_family", labels: Sequence[str] = LABELS, prefix: str = "score_") -> Column:
    """How far the predicted label is ahead of reject (or reject ahead of the rest)."""
    others = F.greatest(*[F.col(prefix + n) for n in labels if n != "reject"])
    own = F.lit(0.0)
    for n in labels:
        own = F.when(F.col(predicted) == n, F.col(prefix + n)).otherwise(own)
    return F.when(F.col(predicted) == "reject", F.col(prefix + "reject") - others).otherwise(own - F.col(prefix + "reject"))


def deploy(df: DataFrame, min_risky_margin: float | Column = 0.2, risky: Sequence[str] = RISKY) -> DataFrame:
    """Replace risky predictions without enough margin by reject."""
    m = F.lit(min_risky_margin) if not isinstance(min_risky_margin, Column) else min_risky_margin
    held = F.col("predicted_family").isin(*risky) & (F.col("_margin") < m)
    return df.withColumn("_margin", reject_margin()).withColumns({
        "deployed_family": F.when(held, F.lit("reject")).otherwise(F.col("predicted_family")),
        "deployment_reason": F.when(held, F.lit("risk_margin_reject")).otherwise(F.lit("keep_selector_prediction")),
        "selector_margin_vs_reject": F.rint(F.col("_margin") * 1e8) / 1e8,
    }).drop("_margin")


def classification_summary(df: DataFrame, keys: Sequence[str] = (), predicted: str = "deployed_family",
                           teacher: str = "teacher_family") -> DataFrame:
    """Accuracy, positive accuracies, reject recall and false texture promotions."""
    hit = F.col(predicted) == F.col(teacher)
    pos, reject = F.col(teacher) != "reject", F.col(teacher) == "reject"
    nonbase = pos & (F.col(teacher) != "base_keep")
    rate = lambda cond, base: F.rint(F.count_if(cond & hit) / F.greatest(F.lit(1), F.count_if(base)) * 1e8) / 1e8
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), rate(F.lit(True), F.lit(True)).alias("accuracy"),
        rate(pos, pos).alias("positive_accuracy"), rate(nonbase, nonbase).alias("nonbase_positive_accuracy"),
        rate(reject, reject).alias("reject_recall"),
        F.count_if(F.col(teacher).isin("reject", "base_keep") & F.col(predicted).isin(*TEXTURE_FAMILIES)).alias("false_texture_promotions"))


def margin_sweep(df: DataFrame, margins: Sequence[float], risky: Sequence[str] = RISKY) -> DataFrame:
    """Classification summary for each margin with its change against the raw prediction."""
    wide = df.withColumn("min_risky_margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    deployed = deploy(wide, F.col("min_risky_margin"), risky)
    s = classification_summary(deployed, ["min_risky_margin"])
    raw = classification_summary(deployed, ["min_risky_margin"], "predicted_family").select(
        "min_risky_margin", F.col("accuracy").alias("_a"), F.col("reject_recall").alias("_r"), F.col("false_texture_promotions").alias("_f"))
    return s.join(raw, "min_risky_margin").select(
        *s.columns, (F.rint((F.col("accuracy") - F.col("_a")) * 1e8) / 1e8).alias("accuracy_delta_vs_raw"),
        (F.rint((F.col("reject_recall") - F.col("_r")) * 1e8) / 1e8).alias("reject_recall_delta_vs_raw"),
        (F.col("false_texture_promotions") - F.col("_f")).alias("false_texture_delta_vs_raw"))


def learned_deployment(gated: DataFrame, margin_weight: float = 0.001, min_risky_margin: float = 0.0,
                       require_gate: bool = True) -> DataFrame:
    """Model veto on top of a gate, with a margin bonus on its score (``gated``: gate_pass, policy_score, score_*)."""
    deployed = deploy(gated, min_risky_margin)
    gate_failed = ~F.col("gate_pass") if require_gate else F.lit(False)
    reason = (F.when(gate_failed, F.lit("preview_sweep_gate_failed"))
              .when(F.col("deployed_family") == "reject", F.lit("learned_selector_reject")).otherwise(F.lit("learned_selector_accept")))
    score = F.col("policy_score") + margin_weight * F.greatest(F.lit(0.0), F.col("selector_margin_vs_reject"))
    return deployed.withColumns({"policy_score": F.rint(score * 1e8) / 1e8, "gate_reason": reason,
                                 "gate_pass": reason == "learned_selector_accept"})
