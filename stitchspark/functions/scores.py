"""Scalar scores of a candidate or a design: unified loss, quality level, texture, risk, utilities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import clamp01, clipped, col, half_even, num_value

# Thresholds and weights of the unified loss.
UNIFIED_THRESHOLDS = {
    "jump_count": 25.0, "trim_count": 20.0, "jump_path_mm": 2500.0, "off_mask_stitch_length_mm": 8.0,
    "visible_connector_count": 3.0, "visible_connector_length_mm": 20.0,
}
FULL_WEIGHTS = {
    "parse_fail": 0.30, "jump_count": 0.20, "trim_count": 0.12, "jump_path_mm": 0.08,
    "off_mask_stitch_length_mm": 0.18, "visible_connector_count": 0.08, "visible_connector_length_mm": 0.04,
}
FALLBACK_WEIGHTS = {
    "parse_fail": 0.35, "jump_count": 0.25, "trim_count": 0.15, "off_mask_stitch_length_mm": 0.15,
    "visible_connector_count": 0.10,
}
# Quality ladder limits.
HARD_LIMITS = {"jump_count": 25.0, "trim_count": 20.0, "off_mask_stitch_length_mm": 8.0, "visible_connector_count": 3.0}
WARNING_LIMITS = {"jump_count": 15.0, "trim_count": 10.0, "off_mask_stitch_length_mm": 4.0, "visible_connector_count": 1.0}
EXCELLENT_LIMITS = {"jump_count": 10.0, "trim_count": 6.0, "off_mask_stitch_length_mm": 2.0, "visible_connector_count": 0.5}
EXEC_TERMS = ("parse_fail", "jump_count", "trim_count", "jump_path_mm")
VISUAL_TERMS = ("off_mask_stitch_length_mm", "visible_connector_count", "visible_connector_length_mm")
# Weights of the generator counters.
TEXTURE_WEIGHTS = {
    "fill_rows": 0.002, "outline_points": 0.001, "satin_columns": 0.006, "satin_rail_segments": 0.010,
    "dt_satin_segments": 0.010, "style_running_points": 0.004,
}
# Weights of the preview sub-scores.
PREVIEW_WEIGHTS = {
    "coverage_score": 0.25, "density_score": 0.18, "rhythm_score": 0.18, "directional_score": 0.17,
    "family_texture_score_norm": 0.14, "safety_score": 0.08,
}


def weighted_sum(terms: Mapping[str, float], value=None) -> Column:
    """Sum of weight x column over a plain mapping."""
    read = value or (lambda name: num_value(name))
    total = None
    for name, weight in terms.items():
        part = F.lit(float(weight)) * read(name)
        total = part if total is None else total + part
    return total if total is not None else F.lit(0.0)


def unified_score(columns, parse_ok: Column | str = "round_trip_parse_success",
                  thresholds: Mapping[str, float] | None = None,
                  weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """unified_loss, exec_score, visual_risk and quality_level for a table with the given columns.

    The full weight set needs both the jump path and the visible connector length; without them
    the fallback set is used.
    """
    full = {"jump_path_mm", "visible_connector_length_mm"} <= set(columns)
    w = {**(FULL_WEIGHTS if full else FALLBACK_WEIGHTS), **(weights or {})}
    t = {**UNIFIED_THRESHOLDS, **(thresholds or {})}
    ok = F.coalesce(col(parse_ok).cast("double"), F.lit(0.0)) >= 0.5

    def term(name: str) -> Column:
        if name == "parse_fail":
            return F.when(ok, F.lit(0.0)).otherwise(F.lit(1.0))
        return clipped(num_value(name), t.get(name, 1.0)) if name in columns else F.lit(0.0)

    def part(names) -> Column:
        return half_even(weighted_sum({n: w[n] for n in names if n in w}, term), 8)

    return {
        "unified_loss": part(EXEC_TERMS + VISUAL_TERMS),
        "exec_score": part(EXEC_TERMS),
        "visual_risk": part(VISUAL_TERMS),
        "quality_level": quality_level(columns, ok),
    }


def quality_level(columns, parse_ok: Column) -> Column:
    def over(limits) -> Column:
        hit = F.lit(False)
        for name, limit in limits.items():
            if name in columns:
                hit = hit | (num_value(name) > limit)
        return hit

    return (
        F.when(~parse_ok, F.lit("hard_fail")).when(over(HARD_LIMITS), F.lit("hard_fail"))
        .when(over(WARNING_LIMITS), F.lit("warning")).when(~over(EXCELLENT_LIMITS), F.lit("excellent"))
        .otherwise(F.lit("pass"))
    )


def hard_score(parse_fail="parse_fail") -> Column:
    """One scalar that orders candidates as the hard ordering would."""
    return (
        F.lit(10.0) * col(parse_fail).cast("double") + num_value("visible_connector_count") / 3.0
        + num_value("off_mask_stitch_length_mm") / 8.0 + num_value("jump_count") / 25.0
        + num_value("trim_count") / 20.0 + num_value("unified_loss")
    )


def preset_score(parse_ok, reference_path) -> Column:
    """Machine cost of a preset against the stitch path of its reference."""
    cost = (
        num_value("jump_path_mm") + 10.0 * num_value("jump_count") + 18.0 * num_value("trim_count")
        + 120.0 * num_value("illegal_long_stitch_count") + 60.0 * num_value("high_risk_jump_count")
        + 4.0 * num_value("unsupported_command_count")
        + 0.25 * F.greatest(F.lit(0.0), num_value("stitch_path_mm") - col(reference_path))
        + num_value("off_mask_stitch_length_mm") + 20.0 * num_value("visible_connector_count")
    )
    return F.when(~col(parse_ok), F.lit(1e6)).otherwise(cost)


def texture_score() -> Column:
    return half_even(weighted_sum(TEXTURE_WEIGHTS), 8)


def preview_scores() -> dict[str, Column]:
    """Six sub-scores in [0, 1] and their weighted preview score."""
    precision = num_value("stitch_precision_ratio")
    adaptive = F.coalesce(num_value("adaptive_stitch_precision_ratio", float("nan")), precision)
    adaptive = F.when(F.isnan(adaptive), precision).otherwise(adaptive)
    balance = clamp01(1.0 - F.abs(num_value("angle_entropy") - 0.42) / 0.42)
    raw = {
        "coverage_score": clamp01(0.55 * num_value("coverage_ratio") + 0.45 * F.greatest(precision, adaptive)),
        "density_score": clamp01(num_value("stitch_density_per_100mm2") / 5.0),
        "rhythm_score": clamp01(1.0 - F.abs(num_value("mean_stitch_length_mm") - 2.2) / 2.8)
        * clamp01(1.0 - 0.75 * num_value("stitch_length_cv")),
        "directional_score": clamp01(0.55 * num_value("dominant_angle_mass") + 0.45 * balance),
        "family_texture_score_norm": clamp01(num_value("generator_texture_score") / 0.75),
        "safety_score": clamp01(
            1.0 - 0.20 * num_value("visible_connector_count") - 0.02 * num_value("off_mask_stitch_length_mm")
            - 0.10 * num_value("illegal_long_stitch_count") - 0.35 * num_value("long_stitch_ratio")),
    }
    out = {name: half_even(c, 8) for name, c in raw.items()}
    out["professional_preview_score"] = half_even(
        clamp01(weighted_sum(PREVIEW_WEIGHTS, lambda n: raw[n])), 8)
    return out
