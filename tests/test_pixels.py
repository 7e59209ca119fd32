from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stitchspark.operators import components as comp
from stitchspark.operators import pixels as px


def table(spark, grids):
    rows = [(d, int(y), int(x)) for d, g in enumerate(grids) for y, x in zip(*np.nonzero(g))]
    return spark.createDataFrame(rows, "design_id bigint, y int, x int").repartition(5)


def flood(grid, conn):
    steps = px.NEIGHBOURS_4 if conn == 4 else px.NEIGHBOURS_8
    label = -np.ones(grid.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(grid)):
        if label[y, x] >= 0:
            continue
        queue = deque([(y, x)])
        label[y, x] = n
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                u, v = a + dy, b + dx
                if 0 <= u < grid.shape[0] and 0 <= v < grid.shape[1] and grid[u, v] and label[u, v] < 0:
                    label[u, v] = n
                    queue.append((u, v))
        n += 1
    return label


def spiral(n):
    g = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    g[0, 0] = True
    for _ in range(n * n):
        u, v = y + dy, x + dx
        far = (y + 2 * dy, x + 2 * dx)
        if not (0 <= u < n and 0 <= v < n) or (0 <= far[0] < n and 0 <= far[1] < n and g[far]):
            dy, dx = dx, -dy
            u, v = y + dy, x + dx
            far = (y + 2 * dy, x + 2 * dx)
            if not (0 <= u < n and 0 <= v < n) or g[u, v] or (0 <= far[0] < n and 0 <= far[1] < n and g[far]):
                break
        y, x = u, v
        g[y, x] = True
    return g


@pytest.mark.parametrize("conn", [4, 8])
def test_components_match_flood_fill(spark, conn):
    rng = np.random.default_rng(6)
    grids = [rng.random((24, 24)) < 0.55, spiral(21), np.ones((5, 9), bool), np.eye(8, dtype=bool)]
    got = comp.connected_components(table(spark, grids), ["design_id"], conn).toPandas()
    for d, g in enumerate(grids):
        want = flood(g, conn)
        part = got[got["design_id"] == d]
        assert len(part) == g.sum()
        pairs = {(c, want[y, x]) for y, x, c in zip(part["y"], part["x"], part["component"])}
        assert len(pairs) == want.max() + 1 == part["component"].nunique()


def test_small_components(spark):
    g = np.zeros((6, 6), bool)
    g[0, :4] = g[3, 0] = g[5, 5] = True
    lone = np.zeros((6, 6), bool)
    lone[2, 2] = True
    labelled = comp.connected_components(table(spark, [g, lone]))
    kept, stats = comp.drop_small_components(labelled, 3)
    assert {(r["design_id"], r["removed_pixels"], r["components_total"]) for r in stats.collect()} == {(0, 2, 3), (1, 0, 1)}
    assert kept.count() == 5
    order = comp.component_order(comp.component_sizes(labelled)).filter("component_rank = 1").collect()
    assert {(r["design_id"], r["area_px"]) for r in order} == {(0, 4), (1, 1)}


def test_runs_boundary_dilate(spark):
    g = np.zeros((7, 7), bool)
    g[1:5, 1:6] = True
    g[2, 3] = False
    t = table(spark, [g])
    runs = {(r["y"], r["x0"], r["x1"]) for r in px.row_runs(t, 2).collect()}
    assert runs == {(1, 1, 5), (2, 1, 2), (2, 4, 5), (3, 1, 5), (4, 1, 5)}
    pad = np.pad(g, 1)
    inner = pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
    assert {(r["y"], r["x"]) for r in px.boundary_pixels(t).collect()} == set(zip(*np.nonzero(g & ~inner)))
    big = np.zeros((7, 7), bool)
    for y, x in zip(*np.nonzero(g)):
        for dy, dx in px.disc(1):
            if 0 <= y + dy < 7 and 0 <= x + dx < 7:
                big[y + dy, x + dx] = True
    assert {(r["y"], r["x"]) for r in px.dilate(t, 1, 7).collect()} == set(zip(*np.nonzero(big)))


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "ties"])
def test_component_graph_matches_brute_force(spark, shape):
    rng = np.random.default_rng(9)
    sizes = ((1, 150), (2, 3), (3, 1), (4, 9))
    xy = rng.random((163, 2)) * 50
    if shape == "clusters":
        xy = np.where(rng.random((163, 1)) < 0.8, rng.integers(0, 3, (163, 1)) * 20 + xy / 100, xy)
    elif shape == "line":
        xy[:, 1] = 7.0
    elif shape == "ties":
        xy = np.floor(xy / 8)
    pdf = pd.DataFrame({"design_id": [d for d, n in sizes for _ in range(n)], "node_id": [i for _, n in sizes for i in range(n)], "color_layer": rng.integers(1, 4, 163), "centroid_x": xy[:, 0], "centroid_y": xy[:, 1]})
    got = comp.component_graph(spark.createDataFrame(pdf)).toPandas()
    for d, g in pdf.groupby("design_id"):
        for a in g.itertuples():
            others = sorted((((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) ** 0.5 * (0.65 if a.color_layer == b.color_layer else 1.0), b.node_id)
                            for b in g.itertuples() if b.node_id != a.node_id)[:4]
            mine = got[(got["design_id"] == d) & (got["source"] == a.node_id)]
            assert set(mine["target"]) == {o[1] for o in others}


def test_oriented_box_of_a_diagonal(spark):
    rows = [(1, 1, i, i, 2) for i in range(10)] + [(2, 1, 3, 4, 0)]
    df = spark.createDataFrame(rows, "design_id bigint, component bigint, y int, x int, stitch_type int")
    n = {r["design_id"]: r for r in comp.component_nodes(df).collect()}
    assert n[1]["obb_w"] == pytest.approx(9 * 2 ** 0.5, abs=1e-4) and n[1]["obb_h"] == pytest.approx(0.0, abs=1e-4)
    assert n[1]["obb_angle"] == pytest.approx(np.pi / 4, abs=1e-4) and n[1]["obb_cx"] == pytest.approx(4.5)
    assert n[2]["obb_w"] == 1.0 and n[2]["stitch_type"] == 0 and n[1]["stitch_type"] == 2


def test_order_pair_accuracy_of_a_perfect_order(spark):
    df = spark.range(200).selectExpr("1L AS design_id", "CAST(id AS INT) AS y", "0 AS x", "id / 200 AS target", "id / 100 AS pred")
    assert px.order_pair_accuracy(df).first()["order_pair_accuracy"] == 1.0


def test_words_of_a_canvas_wider_than_a_word(spark):
    rng = np.random.default_rng(8)
    target, stitch = rng.random((70, 70)) < 0.4, rng.random((70, 70)) < 0.5
    near = np.zeros((72, 72), bool)
    for dy, dx in px.disc(1):
        near[1 + dy:71 + dy, 1 + dx:71 + dx] |= target
    near = near[1:-1, 1:-1]
    s, t = table(spark, [stitch]), table(spark, [target])
    assert {(r["y"], r["x"]) for r in px.dilate(t, 1, 70).collect()} == set(zip(*np.nonzero(near)))
    got = px.coverage_metrics(s.unionByName(s), t, 70)
    row = got.first()
    want = (target.sum(), near.sum(), stitch.sum(), (stitch & target).sum(), (stitch & ~target).sum(), (stitch & near).sum(), (stitch & ~near).sum())
    assert tuple(row[c] for c in got.columns[1:8]) == want
    assert "word" in got._jdf.queryExecution().executedPlan().toString()  # words are grouped, not pixels
    padded = np.pad(target, 1)
    for conn, around in ((4, px.NEIGHBOURS_4), (8, px.NEIGHBOURS_8)):
        inner = np.all([padded[1 + dy:71 + dy, 1 + dx:71 + dx] for dy, dx in around], axis=0)
        assert {(r["y"], r["x"]) for r in px.boundary_pixels(t, conn).collect()} == set(zip(*np.nonzero(target & ~inner)))


def test_masks_are_not_broadcast(spark):
    rng = np.random.default_rng(9)
    mask = rng.random((64, 64)) < 0.5
    moves = [(d, k, "STITCH", True, float(a), *map(float, rng.uniform(-14, 14, 4))) for d in (0, 1) for k, a in enumerate(rng.uniform(0.1, 9, 200))]
    names = "design_id bigint, seq bigint, command string, has_prev boolean, distance_mm double, prev_x double, prev_y double, x_mm double, y_mm double"
    got = px.off_mask_stitches(spark.createDataFrame(moves, names), table(spark, [mask]))  # design 1 has no mask
    want = {}
    for d, k, _, _, length, x0, y0, x1, y1 in moves:
        n = max(1, int(np.ceil(length)))
        spots = [(int(np.rint((y0 + (y1 - y0) * (i / n)) / 0.4 + 32)), int(np.rint((x0 + (x1 - x0) * (i / n)) / 0.4 + 32))) for i in range(n + 1)]
        want[d, k] = sum(d == 1 or not (0 <= y < 64 and 0 <= x < 64 and mask[y, x]) for y, x in spots) / (n + 1)
    assert {(r["design_id"], r["seq"]): r["off_fraction"] for r in got.collect()} == want
    points = spark.createDataFrame([(0, k, float(k % 60), float(k // 60)) for k in range(600)], "design_id bigint, seq bigint, px double, py double")
    for df in (got, px.split_polylines_by_mask(points, table(spark, [mask]), 64)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("conn", [4, 8])
def test_components_across_tiles(spark, conn):
    rng = np.random.default_rng(conn)
    spiral = np.zeros((150, 150), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True  # one line through all tiles
    grids = [rng.random((140, 200)) < 0.55, spiral, np.eye(130, dtype=bool)[:, ::-1], np.eye(130, dtype=bool)]
    got = comp.connected_components(table(spark, grids), connectivity=conn).toPandas()
    for d, g in enumerate(grids):
        want = flood(g, conn)
        part = got[got["design_id"] == d]
        assert len(part) == g.sum()
        first = {}
        for y, x in zip(*np.nonzero(g)):
            first.setdefault(want[y, x], y * (1 << 20) + x)
        assert [first[want[y, x]] for y, x in zip(part["y"], part["x"])] == part["component"].tolist()


def test_components_of_one_tile_need_no_rounds_over_pixels(spark):
    rng = np.random.default_rng(3)
    t = table(spark, [rng.random((60, 60)) < 0.5 for _ in range(3)]).withColumn("stitch_type", F.expr("1 + (x * 7 + y * 5) % 3"))
    runs = comp.component_runs(t, marks={f"type_{c}": F.col("stitch_type") == c for c in (1, 2, 3)})
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # labelled in their tiles, and no label is asked for
    pixels = comp.connected_components(t).join(t, px.PX)
    key = ["design_id", "component"]
    nodes = [{(r["design_id"], r["component"]): r for r in comp.component_nodes(df, key).collect()} for df in (runs, pixels)]
    assert nodes[0] == nodes[1] and len(nodes[0]) > 100


@pytest.mark.parametrize("width", [1, 3])
def test_maps_of_drawn_segments(spark, width):
    rng = np.random.default_rng(6)
    rows = [(d, i + 1, int(rng.integers(1, 4)), 40, *map(float, rng.uniform(-3, 67, 4))) for d in (1, 2) for i in range(40)]
    fitted = spark.createDataFrame(rows, "design_id bigint, segment_id bigint, color_layer bigint, n_segments bigint, entry_x double, entry_y double, exit_x double, exit_y double")
    want = px.last_writer_maps(px.rasterize_segments(fitted, 64, width))
    got = px.drawn_maps(fitted, 64, width)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_segments_are_drawn_before_they_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(None if d == 3 else d, int(i), int(rng.integers(1, 4)), 40, *map(float, rng.uniform(-3, 67, 4))) for d in (1, 2, 3) for i in rng.permutation(40) + 1]
    fitted = spark.createDataFrame(rows, "design_id bigint, segment_id bigint, color_layer bigint, n_segments bigint, entry_x double, entry_y double, exit_x double, exit_y double")
    got = px.drawn_maps(fitted, 64, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1  # no row per step, and one shuffle of pixels
    assert sorted(got.collect(), key=str) == sorted(px.last_writer_maps(px.rasterize_segments(fitted, 64, 3)).collect(), key=str)
    monkeypatch.setattr(px, "_STEPS", 500)  # a batch is cut where its steps are many
    names = ["design_id", "color_layer", "n_segments", "kind", "segment_id"]
    batch = px._drawn(fitted).selectExpr(*names[:3], "1 AS kind", *names[4:], "steps", "entry_x", "entry_y", "exit_x", "exit_y").toArrow().combine_chunks().to_batches()
    parts = list(px._draw(iter(batch), 64, px.disc(1), names))
    assert len(parts) > 3
    last = {}
    for r in (r for p in parts for r in p.to_pylist()):
        spot = r["design_id"], r["y"], r["x"]
        last[spot] = max(last.get(spot, 0), r["segment_id"])
    assert last == {(r["design_id"], r["y"], r["x"]): r["segment_id"] for r in got.collect()}
    broken = spark.createDataFrame([(1, 1, 1, 1, 0.0, 0.0, float("nan"), 1.0)], fitted.schema)
    with pytest.raises(Exception, match="not finite"):
        px.drawn_maps(broken, 64, 3).collect()


def test_component_graph_makes_its_nodes_once(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"design_id": rng.integers(0, 3, 60), "node_id": range(60), "color_layer": rng.integers(1, 4, 60), "centroid_x": rng.random(60), "centroid_y": rng.random(60)})
    got = comp.component_graph(spark.createDataFrame(pdf).filter("node_id < 50"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "< 50" not in plan and "ExistingRDD" not in plan and "FileScan parquet" in plan  # every step reads the nodes that were kept
    assert got.select("source").distinct().count() == 50
