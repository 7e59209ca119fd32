"""Published reasons of single rows, stated here and not taken from the policies."""

import json

import pytest
from pyspark.sql import functions as F

from stitchspark.functions.tables import Rounds
from stitchspark.operators import gates, pixels
from stitchspark.operators import policies as P
from stitchspark.sources import files

FINE = {"sample_id": "s", "ordinal": 1, "candidate": "c", "base_candidate": "base_keep", "candidate_family": "satin_like", "deployed_family": "satin_like", "source_name": "x",
        "round_trip_parse_success": True, "quality_level": "pass", "unified_loss": 0.1, "coverage_ratio": 0.95, "stitch_precision_ratio": 0.95,
        "adaptive_coverage_ratio": 0.95, "adaptive_stitch_precision_ratio": 0.97, "off_mask_stitch_length_mm": 0.0, "selector_margin_vs_reject": 0.5, "policy_pass": True, "executable_candidate": True}
DELTAS = ("unified_loss", "coverage_ratio", "stitch_precision_ratio", "adaptive_coverage_ratio", "adaptive_stitch_precision_ratio", "off_mask_stitch_length_mm",
          "visible_connector_count", "jump_count", "trim_count", "professional_preview_score", "generator_texture_score", "family_texture_score_norm",
          "directional_score", "rhythm_score", "visible_connector_length_mm")


def gated(spark, policy, **changed):
    row = {**FINE, **{f"delta_{m}": 0.0 for m in DELTAS}, "delta_professional_preview_score": 0.1, **changed}
    kinds = {bool: "boolean", int: "int", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in row.items())
    return gates.apply_policy(spark.createDataFrame([tuple(row.values())], schema), policy)


@pytest.mark.parametrize("policy, changed, reason", [
    (P.PREVIEW_SWEEP, {"executable_candidate": False}, "missing_prediction_dst"), (P.PREVIEW_SWEEP, {"unified_loss": None}, "missing_unified_loss"),
    (P.PREVIEW_SWEEP, {"coverage_ratio": None}, "missing_coverage_ratio"), (P.PREVIEW_SWEEP, {"stitch_precision_ratio": None}, "missing_stitch_precision_ratio"),
    (P.TEXTURE_OBJECTIVE, {"delta_visible_connector_count": 1.0}, "visible_connector_absolute"), (P.MULTIFAMILY, {"executable_candidate": False}, "missing_prediction_dst"),
    (P.PREVIEW_RERANK, {"policy_pass": False}, "m2_82_policy_failed"), (P.PREVIEW_RERANK, {"executable_candidate": False}, "missing_prediction_dst"), (P.PREVIEW_VETO, {"policy_pass": False}, "m2_82_policy_failed"),
    (P.GUARDED, {"delta_adaptive_stitch_precision_ratio": 0.005, "delta_coverage_ratio": -0.004, "delta_stitch_precision_ratio": -0.004,
                 "delta_adaptive_coverage_ratio": -0.009}, "guarded_score_too_low"),
])
def test_reasons(spark, policy, changed, reason):
    row = gated(spark, policy, **changed).first()
    assert (row["gate_pass"], row["gate_reason"]) == (False, reason)


def test_deployed_base_is_not_promoted(spark):
    """A passing row of the base family stays where it is; one without a family is no base row."""
    kind = "sample_id string, source_name string, category string, candidate string, candidate_family string, deployed_family string, gate_pass boolean, gate_reason string, policy_score double, unified_loss double, ordinal int"
    row = lambda s, c, f, d: (s, "x", "k", c, f, d, True, "ok", 1.0, 0.1, 1)
    rows = spark.createDataFrame([row("a", "n", "base_keep", "satin_like"), row("b", "n", "satin_like", "base_keep"), row("c", "n", None, None), row("d", "n", "satin_like", "satin_like")], kind)
    base = spark.createDataFrame([row(s, "base", "base_keep", "base_keep") for s in "abcd"], kind)
    assert {r["sample_id"]: r["promoted"] for r in gates.promote(rows, base, P.MULTIFAMILY).collect()} == {"a": False, "b": False, "c": True, "d": True}


def test_statuses_of_a_switched_profile(spark):
    metrics = {m: 0.9 for m in (*gates.METRICS,)}
    row = lambda s, source, candidate, **m: {"sample_id": s, "source_name": source, "category": "k", "candidate": candidate, **metrics, **m}
    better = {"adaptive_stitch_precision_ratio": 0.98, "overfill_outside_adaptive_ratio": 0.1}
    current = spark.createDataFrame([row("a", "Rendered text", "safe"), row("b", "Rendered text", "safe"), row("c", "QuickDraw", "safe"), row("d", "Rendered text", "safe")])
    other = spark.createDataFrame([row("a", "Rendered text", "text", **better), row("b", "Rendered text", "text"), row("c", "QuickDraw", "text", **better)])
    got = {r["sample_id"]: (r["chosen_candidate"], r["gate_reason"]) for r in gates.select_rows_by_gate(current, other, P.TEXT_SWITCHER).collect()}
    assert got == {"a": ("text", "text_legibility_gain"), "b": ("safe", "text_safe_fallback:precision_gain_too_small:k"), "c": ("safe", "non_text_source"), "d": ("safe", "missing_row")}


def test_no_caps(spark):
    pixel = spark.range(300).select(F.lit("d").alias("design_id"), (F.col("id") % 256).cast("int").alias("r"), F.lit(100).alias("g"), (F.col("id") / 256).cast("int").alias("b"))
    assert pixels.rank_colors(pixel).agg(F.max("label")).first()[0] == 300
    hits = spark.range(1).selectExpr("'d' design_id", "1 y", "2 x", "70000L segment_id", "80000L n_segments", "3.0D length_px", "1 color_layer")
    assert pixels.last_writer_maps(hits).first()["segment_id"] == 70000


def test_bad_json_lines_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"a": 1}) + "\n{broken\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()


def test_rounds_are_tables_that_go(spark, tmp_path):
    rounds = Rounds(spark)
    kept = rounds.keep(spark.range(3), "a")
    assert kept.count() == 3
    rounds.drop("a")
    assert rounds.keep(spark.range(4), "a").count() == 4
