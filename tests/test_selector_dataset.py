"""The features of the selector dataset are plain columns, and sets of names are put together once a batch."""

import hashlib
import os

import pytest

from stitchspark import plans
from stitchspark.operators import teachers
from stitchspark.plans import learning_queries

FOLDER = "/root/testdata/sf0.001"


def test_features_are_columns_and_absent_ones_null(spark):
    row = "sample_id int, method string, ordinal int, round_trip_parse_success boolean, visible_connector_count int, off_mask_stitch_length_mm double, jump_count int, trim_count int, unified_loss double"
    rows = spark.createDataFrame([(1, "x", 1, True, 0, 0.0, 3, 1, 0.5), (1, "y", 2, True, 0, 0.0, 2, 1, 0.6), (2, "x", 1, True, 0, 0.0, 3, 1, 0.5)], row)
    samples = spark.createDataFrame([(1, 30.0, 20.0, "mask1", (0.5, 9.0), (0.25, None), (3, -1, 1)), (2, None, 20.0, None, (None, 9.0), (0.0, 1.0), (0, -1, 0))],
                                    "sample_id int, source_width double, source_height double, selected_source string, pre struct<selected_foreground_ratio:double,other:double>, "
                                    "pred struct<mask_mean:double,density_mean:double>, stitch_type_counts struct<`1`:int,`2`:int,`3`:int>")
    presets = spark.createDataFrame([("x", (4.0, True))], "method string, args struct<`--row-step-px`:double,`--graph-tsp-planner`:boolean>")
    exports = spark.createDataFrame([(1, "x", (7, 1), (2, 2), (5,))], "sample_id int, method string, dst struct<stitches:int,unknown:int>, type_component_counts struct<a:int,b:int>, graph struct<edges:int>")
    made = teachers.selector_dataset(rows, samples, presets, exports)
    features = made.columns[made.columns.index("source_feature") + 1:]
    got = {(r["sample_id"], r["method"]): (r["hard_rank"], r["is_best_mean"], r["source_feature"], {k: r[k] for k in features if r[k] is not None}) for r in made.collect()}
    assert len(got) == 3
    first = {"pre.source_width": 30.0, "pre.source_height": 20.0, "pre.source_aspect": 1.5, "pre.selected_foreground_ratio": 0.5, "pred.mask_mean": 0.25,
             "pred.stitch_type.1_ratio": 0.75, "pred.stitch_type.2_ratio": 0.0, "pred.stitch_type.3_ratio": 0.25}
    derived = {"derived.coverage_density": 0.0, "derived.mask_density": 0.0, "derived.running_to_satin_ratio": 0.75 / 1e-6, "derived.fill_or_satin_ratio": 0.25}
    args = {"preset.row_step_px": 4.0, "preset.graph_tsp_planner": 1.0}
    of = lambda known: {f"interaction.{s.replace('.', '_')}__x__{p.replace('.', '_')}": known[s] * v for s in known if s in teachers.SAMPLE_FACTORS for p, v in args.items()}
    post = {"post.dst.stitches": 7.0, "post.graph.edges": 5.0, "post.type_component.a_ratio": 0.5, "post.type_component.b_ratio": 0.5}
    assert got[1, "x"] == (1, True, "pre.selected_source=mask1", first | derived | args | of(first) | post)
    assert got[1, "y"] == (0, False, "pre.selected_source=mask1", first | derived)
    second = {"pred.mask_mean": 0.0, "pred.density_mean": 1.0}  # without a width there is no size, without a count no share
    assert got[2, "x"] == (0, True, "pre.selected_source=unknown", second | args | of(second) | dict.fromkeys(derived, 0.0))
    assert not [c for c in teachers.selector_dataset(rows, samples, presets).columns if c.startswith("post.")]


def test_digests_of_sets_of_names(spark):
    names = ["b", "c", "a"]
    rows = [("101", "111", "pre.selected_source=x"), ("000", "010", "pre.selected_source=x"), ("101", "101", "pre.selected_source=y"), ("101", "111", "pre.selected_source=x")]
    got = spark.createDataFrame(rows, "h string, p string, s string").select(learning_queries.name_digests(names)("h", "p", "s").alias("n")).select("n.*").collect()
    md5 = lambda has, source: hashlib.md5(",".join(sorted([source, *(n for h, n in zip(has, names) if h == "1")])).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(md5(h, s), md5(p, s)) for h, p, s in rows]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_no_row_builds_a_map(spark):
    plan = plans.RUN["selector_dataset"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "map_" not in plan and "transform" not in plan and "md5(" not in plan
