"""Queries over candidate pools read the lines once: rows find their baseline and their sample's best where they lie."""

import os

import pytest
from pyspark.sql import functions as F

from stitchspark import plans
from stitchspark.operators import gates

FOLDER = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_")


ONCE = ("stitch_type_teachers", "texture_teachers", "preview_teachers", "probe_hard_negatives", "selector_teachers", "promote_text_precision_rescue",
        "promote_learned_deployment", "promote_text_low_precision_profile", "gate_professional_texture_objective")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ONCE)
def test_one_scan_of_the_lines(spark, name):
    assert scans(plans.RUN[name](spark, FOLDER)) == 1


def test_row_beside_its_first(spark):
    df = spark.createDataFrame([("a", 2, "x", 5.0), ("a", 1, "y", 3.0), ("b", 4, "z", None)], "sample_id string, ordinal int, candidate string, jump_count double")
    got = {(r["candidate"], r["base_candidate"], r["delta_jump_count"]) for r in gates.beside_first(df, ["jump_count"]).collect()}
    assert got == {("x", "y", 2.0), ("y", "y", 0.0), ("z", "z", 0.0)}


def test_skeleton_rows_of_a_selection(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "sample_id string, candidate string")
    audit = spark.createDataFrame([("x", "a", 0.5, 0.6), ("x", "a", 0.7, 0.8), ("z", "b", 0.1, 0.2)], "selection string, sample_id string, skeleton_coverage_ratio double, adaptive_skeleton_coverage_ratio double")
    got = sorted((r["sample_id"], r["candidate"], r["skeleton_coverage_ratio"] or 0.0) for r in gates.with_skeleton_rows(rows, audit, F.col("candidate")).collect())
    assert got == [("a", "x", 0.5), ("a", "x", 0.7), ("a", "y", 0.0), ("b", "x", 0.0)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_scans_of_decisions_and_features(spark):
    assert scans(plans.RUN["decision_ranks"](spark, FOLDER)) == 1
    assert scans(plans.RUN["selector_dataset"](spark, FOLDER)) == 2  # the second finds the presets


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_a_grid_multiplies_picks_and_not_rows(spark):
    from stitchspark.plans.selection_queries import grid_choice
    plan = grid_choice(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1 and plan.index("Generate explode") < plan.index("Aggregate(")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_four_teachers_over_one_reading(spark):
    from stitchspark.operators import teachers
    from stitchspark.plans import learning_queries as lq
    got = plans.RUN["teacher_union_summary"](spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1 and plan.count("FileScan parquet [o_") == 1
    cols = ["seed_source", *lq._TCOLS, "unified_loss"]
    apart = teachers.union_teachers(*[f(spark, FOLDER).select(*cols) for f in (lq.selector_rows, lq.texture_rows, lq.preview_rows, lq.probe_rows)])
    want = lq.tidy(teachers.teacher_summary(apart, ["seed_source", "teacher_family"], ["unified_loss"]))
    assert got.schema.names == want.schema.names and sorted(got.collect()) == sorted(want.collect())


def test_samples_without_an_order_are_marked(spark):
    df = spark.createDataFrame([("a", 1, "y", 3.0), ("b", None, "z", 1.0)], "sample_id string, ordinal int, candidate string, jump_count double")
    assert [r["candidate"] for r in gates.beside_first(df, ["jump_count"]).collect()] == ["y"]
    assert {(r["candidate"], r["lone"]) for r in gates.beside_first(df, ["jump_count"], lone="lone").collect()} == {("y", False), ("z", True)}
