import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchspark.functions.scores import unified_score
from stitchspark.operators import commands as ops
from stitchspark.operators.stream import walk


def stream(spark, *designs):
    """Each design is a list of (command, x) on the line y = 0."""
    rows = [(d, i, c, float(x), 0.0) for d, cs in enumerate(designs) for i, (c, x) in enumerate(cs)]
    return spark.createDataFrame(rows, "design_id bigint, seq bigint, command string, x_mm double, y_mm double")


def short(n, start=0.0, step=1.0):
    return [("STITCH", start + step * i) for i in range(n)]


@pytest.mark.parametrize("commands,expected", [
    (short(4), 1),                                              # first stitch has distance 0: not short, 3 short ones follow
    (short(3), 0),
    (short(4) + [("COLOR_CHANGE", 3.0)], 0),                     # closed, not counted
    (short(4) + [("unsupported_9", 3.0)], 0),
    (short(4) + [("TRIM", 3.0)], 1),
    (short(4) + [("JUMP", 9.0)], 1),
    (short(4) + [("STITCH", 9.0)], 1),
    (short(3) + [("END", 2.0)] + [("STITCH", 3.0)], 1),          # END is neutral
    (short(4) + [("COLOR_CHANGE", 3.0)] + short(4, 4.0), 1),
])
def test_lock_tack_closers(spark, commands, expected):
    assert ops.lock_tack_runs(stream(spark, commands)).first()["lock_tack_like_count"] == expected


def test_execution_metrics_limits(spark):
    df = stream(spark, [("STITCH", 0), ("STITCH", 4.0), ("STITCH", 8.5), ("JUMP", 16.5), ("END", 16.5)], [("JUMP", 5.0)])
    m = {r["design_id"]: r for r in ops.execution_metrics(df).collect()}
    assert m[0]["illegal_long_stitch_count"] == 1 and m[0]["high_risk_jump_count"] == 1
    assert m[0]["stitch_path_mm"] == 8.5 and m[0]["jump_path_mm"] == 8.0 and m[1]["max_jump_mm"] == 0.0


def test_segments_and_events(spark):
    df = stream(spark, [("JUMP", 0), ("STITCH", 1), ("TRIM", 1), ("COLOR_CHANGE", 12), ("STITCH", 13), ("STITCH", 14)])
    seg = ops.build_segments(df)
    assert [(r["segment_id"], r["color_layer"]) for r in seg.orderBy("segment_id").collect()] == [(1, 1), (2, 2), (3, 2)]
    e = ops.path_events(ops.segments_of(walk(df, 2))).orderBy("to_segment").collect()
    assert (e[0]["distance_mm"], e[0]["long_jump_label"], e[0]["trim_label"], e[0]["color_change_label"], e[0]["near_connect_label"]) == (11.0, True, True, True, False)
    assert e[1]["near_connect_label"] and not e[1]["color_change_label"]
    p = ops.preceding_commands(df).orderBy("stitch_no", "position").collect()
    assert [(r["stitch_no"], r["position"], r["command"]) for r in p] == [(1, 1, "JUMP"), (2, 1, "TRIM"), (2, 2, "COLOR_CHANGE")]


def test_split_long_moves(spark):
    out = ops.split_long_moves(stream(spark, [("JUMP", 0), ("STITCH", 10.0), ("JUMP", 17.0)])).orderBy("source_seq", "step").collect()
    assert [(r["command"], r["x_tenth_mm"]) for r in out] == [("STITCH", 33), ("STITCH", 67), ("STITCH", 100), ("TRIM", 100), ("JUMP", 170)]


@pytest.mark.parametrize("rows", [2, 5, 4096])
def test_sequence_cost_follows_orientation(spark, rows):
    rng = np.random.default_rng(5)
    lines = rng.uniform(0, 40, (30, 4))
    total, cur = 0.0, (0.0, 0.0)
    for sx, sy, ex, ey in lines:
        def cost(x, y):
            d = math.hypot(x - cur[0], y - cur[1])
            return d + 0.45 * max(0.0, d - 8.0) + (4.0 if d >= 10.0 else 0.0)
        a, b = cost(sx, sy), cost(ex, ey)
        total += min(a, b)
        cur = (ex, ey) if a <= b else (sx, sy)
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(lines)], "route_id bigint, position bigint, start_x double, start_y double, end_x double, end_y double")
    got = ops.sequence_cost(df.repartition(4), rows=rows).first()
    assert got["polylines"] == 30 and got["total_cost"] == pytest.approx(total, rel=1e-9)


def test_drop_collinear(spark):
    pts = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (3, 2)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "k bigint, seq bigint, x bigint, y bigint")
    assert [r["seq"] for r in ops.drop_collinear(df, ["k"]).orderBy("seq").collect()] == [0, 2, 4, 5]


def test_unified_score_published_rows(spark):
    """Published metric rows and their scores."""
    rows = [(149, 17, 678.8156, 421.8983, 111, 359.9238), (135, 23, 743.6894, 39.7567, 1, 2.3022), (416, 26, 1338.6445, 62.1593, 3, 9.6256), (114, 17, 597.9792, 163.8339, 15, 51.1719)]
    want = [(0.6237221, 0.3237221, 0.3), (0.55506913, 0.34379806, 0.21127107), (0.64208782, 0.36283662, 0.2792512), (0.62113533, 0.32113533, 0.3)]
    names = ["jump_count", "trim_count", "jump_path_mm", "off_mask_stitch_length_mm", "visible_connector_count", "visible_connector_length_mm"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], names).coalesce(1)
    s = unified_score(df.columns, F.lit(True))
    got = df.select(*[c.alias(n) for n, c in s.items()]).collect()
    for g, w in zip(got, want):
        assert (g["unified_loss"], g["exec_score"], g["visual_risk"]) == pytest.approx(w, abs=1e-8) and g["quality_level"] == "hard_fail"
    assert "jump_path_mm" not in (few := ["jump_count"]) and unified_score(few, F.lit(True))
