"""Connected components over row runs, their nodes and neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import half_even
from ..functions.tables import Rounds


TILE = 64
#: A pixel's number is y * CANVAS + x; the least of a component names it.
CANVAS = 1 << 20


def _overlaps(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, above: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (ordered by row and x0) of which the second touches the first from the row above it, which is -1 where there is none."""
    at = lambda r, x: r * 2 * TILE + x + 1
    up = above[row]
    low, high = np.searchsorted(at(row, x1), at(up, x0 - reach)), np.searchsorted(at(row, x0), at(up, x1 + reach), "right")
    n = np.where(up >= 0, np.maximum(high - low, 0), 0)
    return np.repeat(np.arange(len(row)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0 .. n - 1 is linked with."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
    return label


def _tile_runs(batches: Iterator[pa.RecordBatch], keys: list[str], marks: list[str], reach: int) -> Iterator[pa.RecordBatch]:
    """Tiles (keys, word, rows) to their runs, labelled as far as the tile shows."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            lists = part.column("rows")
            flat = lists.flatten()
            cells = dict(zip((f.name for f in flat.type), (c.to_numpy(zero_copy_only=False) for c in flat.flatten())))
            tile = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((cells["y"], tile))
            tile, cells = tile[order], {k: v[order] for k, v in cells.items()}
            y, bits = cells["y"].astype(np.int64), np.ascontiguousarray(cells["bits"], "<i8")
            on = np.zeros((len(y), TILE + 2), bool)
            on[:, 1:-1] = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, x0 = np.nonzero(on[:, 1:-1] & ~on[:, :-2])
            x1 = np.nonzero(on[:, 1:-1] & ~on[:, 2:])[1]
            above = np.full(len(y), -1)
            next_row = np.flatnonzero((tile[1:] == tile[:-1]) & (y[1:] == y[:-1] + 1))
            above[next_row + 1] = next_row
            label = _least(len(row), *_overlaps(row, x0, x1, above, reach))
            left = part.column("word").to_numpy(zero_copy_only=False).astype(np.int64)[tile[row]] * TILE
            number = y[row] * CANVAS + left + x0
            span = (np.uint64(2**64 - 1) >> (TILE - 1 - x1 + x0).astype(np.uint64)) << x0.astype(np.uint64)
            of = pa.array(tile[row])
            yield pa.RecordBatch.from_arrays(
                [part.column(k).take(of) for k in keys] + [pa.array(v.astype(np.int32)) for v in (y[row], left + x0, left + x1)] + [pa.array(number[label])]
                + [pa.array(cells[m][row] & span.view(np.int64)) for m in marks], names=[*keys, "y", "x0", "x1", "component", *marks])


def component_runs(pixels: DataFrame, keys: Sequence[str] = ("design_id",), connectivity: int = 4, marks: dict[str, Column] | None = None) -> DataFrame:
    """keys, y, x0, x1, component: the pixels as row runs, cut every 64 columns, with their component's label (its least y * 2^20 + x), and a word of bits for
    each of ``marks``: the run's pixels that have the mark, at x % 64. Pixels with a null key are dropped.

    A canvas is cut into tiles of 64 x 64 pixels, which a task labels by themselves. Components of neighbouring tiles that touch are edges; their labels
    spread by least-label hooking and pointer jumping until nothing changes, which takes about log(n) rounds. Without such edges there is no round."""
    keys, marks = list(keys), marks or {}
    rounds, at = Rounds(pixels.sparkSession), 0
    bit = F.expr(f"shiftleft(1L, int(pmod(x, {TILE})))")
    tile = {"tile": F.floor(F.col("y") / TILE).cast("int"), "word": F.floor(F.col("x") / TILE).cast("int")}
    cells = pixels.dropna(subset=keys).select(*keys, "y", "x", *(c.alias(m) for m, c in marks.items())).withColumns(tile).repartition(*keys, *tile)
    rows = cells.groupBy(*keys, *tile, F.col("y").cast("int").alias("y")).agg(F.bit_or(bit).alias("bits"), *(F.bit_or(F.when(F.col(m), bit).otherwise(F.lit(0).cast("long"))).alias(m) for m in marks))
    tiles = rows.groupBy(*keys, *tile).agg(F.collect_list(F.struct("y", "bits", *marks)).alias("rows")).drop("tile")
    types = dict(pixels.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["y int, x0 int, x1 int, component long"] + [f"`{m}` long" for m in marks])
    names, reach = list(marks), 0 if connectivity == 4 else 1
    runs = rounds.keep(tiles.mapInArrow(lambda batches: _tile_runs(batches, keys, names, reach), schema), "runs")

    # Pixels at the last row and column of a tile meet those of the next tiles at one shared key.
    border = lambda c, *at: F.pmod(c, F.lit(TILE)).isin(*at)
    x, y = F.col("x"), F.col("y")
    ends = F.when(border("y", 0, TILE - 1), F.sequence("x0", "x1")).otherwise(F.array_distinct(F.array("x0", "x1")))
    own = runs.filter(border("y", 0, TILE - 1) | border("x0", 0) | border("x1", TILE - 1)).select(*keys, "y", F.explode(ends).alias("x"), F.col("component").alias("run"))
    side = range(-reach, reach + 1)
    step = lambda steps: F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))
    none = F.slice(step([(0, 0)]), 1, 0)
    out = F.concat(F.when(border("y", TILE - 1), step([(1, d) for d in side])).otherwise(none), F.when(border("x", TILE - 1), step([(d, 1) for d in side])).otherwise(none))
    sent = own.withColumn("_d", F.explode(out)).select(*keys, (y + F.col("_d.dy")).alias("y"), (x + F.col("_d.dx")).alias("x"), F.lit(None).cast("long").alias("run"), F.col("run").alias("from"))
    met = own.withColumn("from", F.lit(None).cast("long")).unionByName(sent).groupBy(*keys, "y", "x").agg(F.max("run").alias("a"), F.collect_set("from").alias("bs"))
    pairs = met.select(*keys, "a", F.explode("bs").alias("b")).filter("a <> b").distinct()
    edges = rounds.keep(pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    if edges.isEmpty():
        rounds.drop("edges")
        return runs
    labels = rounds.keep(edges.select(*keys, F.col("a").alias("run"), F.col("a").alias("label")).distinct(), "labels-0")
    while True:
        la = labels.select(*keys, F.col("run").alias("a"), F.col("label").alias("la"))
        lb = labels.select(*keys, F.col("run").alias("b"), F.col("label").alias("lb"))
        seen = edges.join(la, [*keys, "a"]).join(lb, [*keys, "b"]).filter("lb < la")
        offers = seen.select(*keys, F.explode(F.array("a", "la")).alias("run"), "lb").groupBy(*keys, "run").agg(F.min("lb").alias("offer"))
        hooked = labels.join(offers, [*keys, "run"], "left").select(*keys, "run", F.least("label", "offer").alias("label"), F.col("label").alias("old"))
        # Many runs share a label; each of them asks for its label's label, which one row answers.
        parents = hooked.select(*keys, F.col("run").alias("label"), F.col("label").alias("jump"))
        asked = hooked.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(parents, [*keys, "label"])
        jumped = rounds.keep(hooked.join(asked, [*keys, "label"]).select(*keys, "run", F.col("jump").alias("label"), (F.col("jump") != F.col("old")).alias("moved")), f"labels-{at + 1}")
        rounds.drop(f"labels-{at}")
        at, labels = at + 1, jumped.select(*keys, "run", "label")
        if jumped.filter("moved").isEmpty():
            break
    rounds.drop("edges")
    labels = labels.select(*keys, F.col("run").alias("component"), "label")
    return runs.join(labels, [*keys, "component"], "left").select(*keys, "y", "x0", "x1", F.coalesce("label", "component").alias("component"), *names)


def connected_components(pixels: DataFrame, keys: Sequence[str] = ("design_id",), connectivity: int = 4) -> DataFrame:
    """Pixels with a component label (see :func:`component_runs`)."""
    types = dict(pixels.dtypes)
    cells = component_runs(pixels, keys, connectivity).select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")
    return cells.select(*keys, F.col("y").cast(types["y"]), F.col("x").cast(types["x"]), "component")


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ("design_id",), min_area: int = 1) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("area_px")).filter(F.col("area_px") >= min_area)


def component_order(sizes: DataFrame, keys: Sequence[str] = ("design_id",)) -> DataFrame:
    """Largest first; the components of one canvas bound the window."""
    w = W.partitionBy(*keys).orderBy(F.col("area_px").desc(), "component")
    return sizes.withColumn("component_rank", F.row_number().over(w).cast("long"))


def drop_small_components(labelled: DataFrame, min_area: int, keys: Sequence[str] = ("design_id",)) -> tuple[DataFrame, DataFrame]:
    """Pixels without small islands, and per key the removed pixels and component count.

    A class none of whose components reaches the area is left untouched.
    """
    sizes = component_sizes(labelled, keys)
    best = sizes.groupBy(*keys).agg(F.max("area_px").alias("_max"))
    marked = sizes.join(best, list(keys)).withColumn("keep", (F.col("area_px") >= min_area) | (F.col("_max") < min_area))
    kept = labelled.join(marked.select(*keys, "component", "keep"), [*keys, "component"]).filter("keep").drop("keep")
    stats = marked.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~F.col("keep"), F.col("area_px"))), F.lit(0)).alias("removed_pixels"), F.count(F.lit(1)).alias("components_total"))
    return kept, stats


def component_nodes(px: DataFrame, keys: Sequence[str] = ("design_id", "component"), boundary: str | None = None) -> DataFrame:
    """Area, centroid, axis-aligned and oriented box and leading stitch type of each component.

    ``px``: pixels (x, y, stitch_type) or runs of :func:`component_runs` with the marks type_1, type_2 and type_3. Sums over a run are closed forms, and a
    box ends at ends of runs, since an axis is monotonic along a run."""
    keys, codes = list(keys), (1, 2, 3)
    if "x0" in px.columns:
        px = px.withColumns({f"_t{c}": F.bit_count(f"type_{c}").cast("long") for c in codes})
    else:
        px = px.withColumns({"x0": F.col("x"), "x1": F.col("x"), **{f"_t{c}": F.when(F.col("stitch_type") == c, 1).otherwise(0).cast("long") for c in codes}})
    # Sums of whole numbers are exact, so that shapes without a leading axis have angle 0 whatever the order of the sums.
    x0, x1, y = (F.col(c).cast("long") for c in ("x0", "x1", "y"))
    n = x1 - x0 + 1
    sx = F.expr("(CAST(x1 AS BIGINT) - x0 + 1) * (CAST(x0 AS BIGINT) + x1) div 2")
    squares = lambda c: c * (c + 1) * (2 * c + 1)
    px = px.withColumns({"_n": n, "_sx": sx, "_sxx": squares(x1) - squares(x0 - 1)})
    g = px.groupBy(*keys).agg(
        F.sum("_n").alias("area_px"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"),
        F.sum("_sx").alias("_sx"), F.sum(F.col("_n") * y).alias("_sy"), F.sum(F.col("_sx") * y).alias("_sxy"), F.expr("sum(_sxx div 6)").alias("_sxx"), F.sum(F.col("_n") * y * y).alias("_syy"),
        *[F.sum(f"_t{c}").alias(f"_t{c}") for c in codes], (F.avg(boundary) if boundary else F.lit(0.0)).alias("boundary_mean"))
    g = g.withColumns({"cx": F.col("_sx") / F.col("area_px"), "cy": F.col("_sy") / F.col("area_px")})
    small, n = F.col("area_px") < 3, F.col("area_px")
    cross = n * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    spread = n * (F.col("_sxx") - F.col("_syy")) - F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy")
    theta = F.when(small, F.lit(0.0)).otherwise(0.5 * F.atan2((2 * cross).cast("double"), spread.cast("double")))
    mode = F.when((F.col("_t1") == 0) & (F.col("_t2") == 0) & (F.col("_t3") == 0), 0).when(
        (F.col("_t1") >= F.col("_t2")) & (F.col("_t1") >= F.col("_t3")), 1).when(F.col("_t2") >= F.col("_t3"), 2).otherwise(3)
    g = g.withColumns({"obb_angle": theta, "stitch_type": mode})
    turned = px.select(*keys, "x0", "x1", "y").join(g.select(*keys, "cx", "cy", "obb_angle"), keys)
    dy = F.col("y") - F.col("cy")
    turned = turned.withColumns({"_cos": F.cos("obb_angle"), "_sin": F.sin("obb_angle")})
    u, v = ([turn(F.col(x) - F.col("cx")) for x in ("x0", "x1")] for turn in (
        lambda dx: F.col("_cos") * dx + F.col("_sin") * dy, lambda dx: F.col("_cos") * dy - F.col("_sin") * dx))
    ext = turned.groupBy(*keys).agg(F.min(F.least(*u)).alias("_u0"), F.max(F.greatest(*u)).alias("_u1"), F.min(F.least(*v)).alias("_v0"), F.max(F.greatest(*v)).alias("_v1"))
    mu, mv = (F.col("_u0") + F.col("_u1")) / 2.0, (F.col("_v0") + F.col("_v1")) / 2.0
    c, s = F.cos("obb_angle"), F.sin("obb_angle")
    pick = lambda a, b: half_even(F.when(small, b).otherwise(a), 5)
    return g.join(ext, keys).select(
        *keys, "area_px", half_even("cx", 3).alias("centroid_x"), half_even("cy", 3).alias("centroid_y"), "min_x", "min_y", "max_x", "max_y",
        pick(F.col("cx") + c * mu - s * mv, F.col("cx")).alias("obb_cx"), pick(F.col("cy") + s * mu + c * mv, F.col("cy")).alias("obb_cy"),
        pick(F.col("_u1") - F.col("_u0"), F.lit(1.0)).alias("obb_w"), pick(F.col("_v1") - F.col("_v0"), F.lit(1.0)).alias("obb_h"),
        half_even("obb_angle", 5).alias("obb_angle"), "stitch_type", half_even("boundary_mean", 5).alias("boundary_mean"))


def component_graph(nodes: DataFrame, k: int = 4, same_color: float = 0.65, per_cell: int = 2) -> DataFrame:
    """The k cheapest other nodes of each node by centroid distance, less for the same color; ties by number.

    ``nodes``: design_id, node_id, color_layer, centroid_x, centroid_y. A design is cut into a grid of about ``per_cell`` nodes a cell, four cells of a
    level are one of the next, up to one cell for all. A node starts from the finest level on which the ring of cells around its own holds k others: they
    bound its k-th cost, so only cells within that cost can hold a cheaper one. Rings are widened only where they hold too few."""
    low, high = min(1.0, same_color), max(1.0, same_color)
    n = nodes.select(F.col("design_id").cast("long").alias("design_id"), F.col("node_id").cast("long").alias("node_id"), "color_layer", "centroid_x", "centroid_y")
    # Nodes are read at each step below; they are made once.
    n = Rounds(nodes.sparkSession).keep(n, "nodes")
    box = n.groupBy("design_id").agg(F.min("centroid_x").alias("_x0"), F.min("centroid_y").alias("_y0"), F.count(F.lit(1)).alias("_n"),
                                     F.greatest(F.max("centroid_x") - F.min("centroid_x"), F.max("centroid_y") - F.min("centroid_y"), F.lit(1e-9)).alias("_span"))
    top = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / per_cell) / 2)).cast("int")
    box = box.withColumn("_top", top).withColumn("_cells", F.expr("shiftleft(1, _top)"))
    cell = lambda c, o: F.least(F.col("_cells") - 1, F.floor((F.col(c) - F.col(o)) / F.col("_span") * F.col("_cells")).cast("int"))
    placed = n.join(box, "design_id").withColumns({"gx": cell("centroid_x", "_x0"), "gy": cell("centroid_y", "_y0")}).drop("_x0", "_y0", "_span", "_cells")
    each = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumns({"cx": F.expr("shiftright(gx, level)"), "cy": F.expr("shiftright(gy, level)")})

    def ring(df: DataFrame, radius: int) -> DataFrame:
        steps = F.sequence(F.lit(-radius), F.lit(radius))
        return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")}).filter(
            (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") <= F.expr("shiftright(shiftleft(1, _top) - 1, level)")) & (F.col("cy") <= F.expr("shiftright(shiftleft(1, _top) - 1, level)"))).drop("_dx", "_dy")

    at = ["design_id", "level", "cx", "cy"]
    held = each.groupBy(*at).agg(F.count(F.lit(1)).alias("_held"))
    around = ring(each.select("design_id", "node_id", "level", "cx", "cy", "_top", "_n"), 1).join(held, at).groupBy("design_id", "node_id", "level", "_n").agg(F.sum("_held").alias("_sum"))
    start = around.filter(F.col("_sum") >= F.least(F.lit(k + 1), F.col("_n"))).groupBy("design_id", "node_id").agg(F.min("level").alias("level"))
    # The ring's nodes are within two cells' diagonals; on the next level a cell is twice as wide.
    radius = math.ceil(math.ceil(2 * math.sqrt(2) * high / low) / 2)
    asking = placed.join(start, ["design_id", "node_id"]).withColumn("level", F.least(F.col("level") + 1, F.col("_top")))
    asking = asking.withColumns({"cx": F.expr("shiftright(gx, level)"), "cy": F.expr("shiftright(gy, level)")})
    other = each.select(*at, F.col("node_id").alias("target"), F.col("color_layer").alias("_c"), F.col("centroid_x").alias("_x"), F.col("centroid_y").alias("_y"))
    met = ring(asking, radius).join(other, at).filter("node_id <> target")
    same = F.col("color_layer") == F.col("_c")
    gap = F.sqrt((F.col("centroid_x") - F.col("_x")) ** 2 + (F.col("centroid_y") - F.col("_y")) ** 2) * F.when(same, same_color).otherwise(1.0)
    place = F.row_number().over(W.partitionBy("design_id", "node_id").orderBy("_gap", "target"))
    near = met.select("design_id", "node_id", "target", gap.alias("_gap"), same.alias("same_color")).withColumn("_place", place).filter(F.col("_place") <= k)
    return near.select("design_id", F.col("node_id").alias("source"), "target", half_even("_gap", 4).alias("cost"), "same_color")
