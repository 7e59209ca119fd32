"""Walked streams against a plain loop, with blocks so small that everything crosses borders; shuffles of the plans that use them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stitchspark import plans
from stitchspark.operators import commands as ops
from stitchspark.operators.stream import walk
from tools.plan_counts import plan_counts

KINDS = ("STITCH", "STITCH", "STITCH", "JUMP", "TRIM", "COLOR_CHANGE", "END", "unsupported_9")


def streams(seed=1):
    rng = random.Random(seed)
    return {d: [(rng.choice(KINDS), rng.choice([0.0, 0.25, 1.0, 9.0]) * rng.random(), float(rng.randrange(9))) for _ in range(n)] for d, n in ((1, 1), (2, 2), (3, 7), (4, 60), (5, 203))}


def frame(spark, designs):
    rows = [(d, i, *c) for d, cs in designs.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "design_id long, seq long, command string, x_mm double, y_mm double").repartition(5)


def looped(commands):
    n = dict.fromkeys(("color", "stitch", "move", "segment", "between", "trim", "changes"), 0)
    prev = move = seg = None
    out, box = [], [[], []]
    for i, (c, x, y) in enumerate(commands):
        row = {"prev_x": prev and prev[0], "prev_y": prev and prev[1], "move_x": move and move[0], "move_y": move and move[1], "seg_x": seg and seg[0], "seg_y": seg and seg[1], "seg_color": seg and seg[2]}
        is_segment = c == "STITCH" and i > 0
        for k, hit in (("color", c == "COLOR_CHANGE"), ("stitch", c == "STITCH"), ("move", c in ("STITCH", "JUMP")), ("segment", is_segment), ("between", c != "STITCH"), ("trim", c == "TRIM"), ("changes", c == "COLOR_CHANGE")):
            n[k] += hit
        row |= {"color_no": n["color"], "stitches": n["stitch"], "move_no": n["move"], "segment_id": n["segment"], "is_segment": is_segment, "n_between": n["between"], "n_trim": n["trim"], "n_color_change": n["changes"]}
        if c == "STITCH":
            n |= {"between": 0, "trim": 0, "changes": 0}
        if is_segment:
            seg = (x, y, n["color"] + 1)
            for axis in (0, 1):
                box[axis] += [prev[axis], (x, y)[axis]]
        if c in ("STITCH", "JUMP"):
            move = (x, y)
        prev = (x, y)
        out.append(row)
    ends = {f"{f.__name__}_{a}": f(b) if b else None for a, b in zip("xy", box) for f in (min, max)}
    return [r | ends | {"n_segments": n["segment"]} for r in out]


@pytest.mark.parametrize("rows", [1, 2, 5, 1 << 16])
def test_walk(spark, rows):
    designs = streams()
    got = {(r["design_id"], r["seq"]): r.asDict() for r in walk(frame(spark, designs), rows).collect()}
    for d, commands in designs.items():
        for i, want in enumerate(looped(commands)):
            assert {k: got[d, i][k] for k in want} == want, (d, i)
    assert len(got) == sum(map(len, designs.values()))


def test_report_in_one_pass(spark, monkeypatch):
    """Runs that cross block borders are one run; the report has the same metrics as the operator for each."""
    df = frame(spark, streams(2))
    whole = {r["design_id"]: r for r in ops.execution_report(df).collect()}
    monkeypatch.setattr(ops, "walk", lambda c: walk(c, 3))
    cut = {r["design_id"]: r for r in ops.execution_report(df, max_mm=5.0, min_run=2).collect()}
    monkeypatch.undo()
    long = {r["design_id"]: r for r in ops.execution_report(df, max_mm=5.0, min_run=2).collect()}
    metrics = ops.execution_metrics(df)
    for r in metrics.collect():
        assert all(whole[r["design_id"]][c] == r[c] for c in metrics.columns)
    assert cut == long and any(r["lock_tack_like_count"] for r in long.values())


def test_texture_of_designs_without_stitches(spark):
    rows = frame(spark, {1: [("JUMP", 1.0, 1.0), ("TRIM", 1.0, 1.0)], 2: [("STITCH", 0.0, 0.0), ("STITCH", 3.0, 4.0), ("STITCH", 3.0, 5.0), ("STITCH", 3.0, 8.0)], 3: [("STITCH", 0.0, 0.0)]})
    got = {r["design_id"]: r for r in ops.stitch_texture_metrics(rows).collect()}
    assert (got[1]["stitch_segment_count"], got[1]["jump_count"], got[1]["median_stitch_length_mm"], got[1]["bbox_area_mm2"]) == (0, 1, 0.0, 1e-6)
    assert (got[2]["stitch_segment_count"], got[2]["median_stitch_length_mm"], got[2]["mean_stitch_length_mm"], got[2]["bbox_width_mm"]) == (3, 3.0, 3.0, 3.0)
    assert got[3]["stitch_segment_count"] == 0 and got[3]["stitch_command_count"] == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["event_maps", "stitch_texture_metrics", "execution_report"])
def test_plans_have_few_shuffles(spark, name):
    counts = plan_counts(plans.RUN[name](spark, "/root/testdata/sf0.001"))
    assert counts["scans"] <= 2 and counts["shuffles"] <= 10, counts
