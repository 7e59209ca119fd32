"""Pixel-table operators: rasterising, maps, coverage, boundaries, runs, evaluation.

A pixel table has one row per foreground pixel (design_id, y, x[, channel, value]).  Work is grouped by
pixel or by row, so a design with very many pixels spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import grouped_quantiles, previous_values, running_totals
from ..functions.semantics import clamp01, half_even

PX = ["design_id", "y", "x"]


def disc(radius: int) -> list[tuple[int, int]]:
    """(dy, dx) offsets of a disc."""
    r = max(0, radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]


def _offsets(points: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in points])


WORD = 64


def pixel_words(pixels: DataFrame, keys: Sequence[str] = ("design_id",)) -> DataFrame:
    """Pixels as bits: one row per key, canvas row and word of 64 columns; pixel x is bit x % 64 of word x / 64. Pixels may repeat."""
    bit = F.expr(f"shiftleft(1L, int(pmod(x, {WORD})))")
    return pixels.groupBy(*keys, "y", F.floor(F.col("x") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def word_pixels(words: DataFrame, keys: Sequence[str] = ("design_id",)) -> DataFrame:
    """One row per set bit of :func:`pixel_words`."""
    on = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)
    return words.filter("bits <> 0").select(*keys, "y", "word", F.explode(on).alias("b")).select(*keys, "y", (F.col("word") * WORD + F.col("b")).alias("x"))


def shifted(bits: Column, dx: int) -> dict[int, Column]:
    """The words that pixels of one word reach when moved by dx columns, by their distance from it."""
    q, s = divmod(dx, WORD)
    return {q: F.shiftleft(bits, s), q + 1: F.shiftrightunsigned(bits, WORD - s)} if s else {q: bits}


def moved_words(words: DataFrame, offsets: Sequence[tuple[int, int]], size: int) -> DataFrame:
    """design_id, y, word, near, own: the canvas words that pixels and their offsets reach, with the pixels reached and the word's own ones. Words repeat."""
    reach: dict[tuple[int, int], Column] = {}
    for dy, dx in offsets:
        for dw, bits in shifted(F.col("bits"), dx).items():
            reach[dy, dw] = reach[dy, dw].bitwiseOR(bits) if (dy, dw) in reach else bits
    none, last = F.lit(0).cast("long"), (size - 1) // WORD
    own = lambda at: F.col("bits") if at == (0, 0) else none
    cells = F.array(*[F.struct(F.lit(at[0]).alias("dy"), F.lit(at[1]).alias("dw"), bits.alias("near"), own(at).alias("own")) for at, bits in reach.items()])
    moved = words.select("design_id", "y", "word", F.explode(cells).alias("v")).select(
        "design_id", (F.col("y") + F.col("v.dy")).alias("y"), (F.col("word") + F.col("v.dw")).alias("word"), "v.near", "v.own")
    moved = moved.filter(F.col("y").between(0, size - 1) & F.col("word").between(0, last))
    if size % WORD:
        clip = lambda c: F.when(F.col("word") == last, F.col(c).bitwiseAND(F.lit((1 << size % WORD) - 1).cast("long"))).otherwise(F.col(c))
        moved = moved.withColumns({"near": clip("near"), "own": clip("own")})
    return moved.filter("near <> 0 OR own <> 0")


def canvas_bits(pixels: DataFrame, size: int) -> DataFrame:
    """One row per design with its canvas in `_canvas`, an array of words that the canvas bounds: pixel (y, x) is bit i % 64 of word i / 64, i = y * size + x."""
    on = F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)
    spots = pixels.filter(on).select("design_id", (F.col("y") * size + F.col("x")).alias("_i"))
    words = spots.groupBy("design_id", F.shiftright("_i", 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, _i % {WORD})")).alias("bits"))
    canvas = words.groupBy("design_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("_m"))
    at = lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long"))
    return canvas.select("design_id", F.transform(F.sequence(F.lit(0), F.lit((size * size - 1) // WORD)), at).alias("_canvas"))


def on_canvas(canvas: str, y: Column, x: Column, size: int) -> Column:
    """Whether pixel (y, x) is set in an array of :func:`canvas_bits`; false off the canvas and without an array."""
    i = y * size + x
    on = (y >= 0) & (y < size) & (x >= 0) & (x < size)
    return F.coalesce(F.when(on, F.getbit(F.get(F.col(canvas), F.shiftright(i, 6)), i % WORD) == 1), F.lit(False))


_BOX = ("n_segments", "min_x", "max_x", "min_y", "max_y")


def fit_transform(segments: DataFrame, size: int = 64, padding: int = 4) -> DataFrame:
    """Scale and centre the segments of each design on a square canvas.

    Segments that carry their design's box (``commands.segments_of``) are fitted as they are, with the end of the segment before as seg_x, seg_y; of
    others the box is found first."""
    if not set(_BOX) <= set(segments.columns):
        box = segments.groupBy("design_id").agg(
            F.least(F.min("entry_x_mm"), F.min("exit_x_mm")).alias("min_x"), F.greatest(F.max("entry_x_mm"), F.max("exit_x_mm")).alias("max_x"),
            F.least(F.min("entry_y_mm"), F.min("exit_y_mm")).alias("min_y"), F.greatest(F.max("entry_y_mm"), F.max("exit_y_mm")).alias("max_y"),
            F.count(F.lit(1)).alias("n_segments"))
        segments = segments.join(box, "design_id")
    w, h = F.greatest(F.lit(1e-6), F.col("max_x") - F.col("min_x")), F.greatest(F.lit(1e-6), F.col("max_y") - F.col("min_y"))
    s = segments.withColumn("scale", F.lit(float(size - 2 * padding)) / F.greatest(w, h)).withColumns(
        {"_ox": (size - w * F.col("scale")) / 2.0, "_oy": (size - h * F.col("scale")) / 2.0})
    fit = lambda c, o, m: F.col(o) + (F.col(c) - F.col(m)) * F.col("scale")
    before = {"prev_exit_x": fit("seg_x", "_ox", "min_x"), "prev_exit_y": fit("seg_y", "_oy", "min_y")} if "seg_x" in s.columns else {}
    return s.withColumns(before | {
        "entry_x": fit("entry_x_mm", "_ox", "min_x"), "entry_y": fit("entry_y_mm", "_oy", "min_y"),
        "exit_x": fit("exit_x_mm", "_ox", "min_x"), "exit_y": fit("exit_y_mm", "_oy", "min_y")}).drop("min_x", "max_x", "min_y", "max_y", "_ox", "_oy")


def line_samples(df: DataFrame, x0: str, y0: str, x1: str, y1: str, steps: Column) -> DataFrame:
    """One row per sample i = 0..steps along each line, as columns sx, sy (unrounded)."""
    at = lambda a, b: F.when(F.col("_i") == F.col("_n"), F.col(b)).otherwise(
        F.col(a) + F.col("_i") * ((F.col(b) - F.col(a)) / F.col("_n")))
    return df.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumns(
        {"sx": at(x0, x1), "sy": at(y0, y1)}).drop("_n", "_i")


def _drawn(fitted: DataFrame) -> DataFrame:
    """The segments that have a length, and their number of steps."""
    dx, dy = F.col("exit_x") - F.col("entry_x"), F.col("exit_y") - F.col("entry_y")
    length = F.sqrt(dx * dx + dy * dy)
    drawn = fitted.withColumns({"length_px": length, "ux": dx / length, "uy": dy / length}).filter(F.col("length_px") >= 1e-6)
    return drawn.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy))).cast("int")))


def _steps(fitted: DataFrame) -> DataFrame:
    """Every step of each segment, as sx, sy (unrounded)."""
    return line_samples(_drawn(fitted), "entry_x", "entry_y", "exit_x", "exit_y", F.col("steps")).drop("steps")


def _clipped(size: int, c: Column, d: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), c + F.col(d)))


def rasterize_segments(fitted: DataFrame, size: int = 64, line_width: int = 1) -> DataFrame:
    """Every pixel hit of every step and disc offset of each segment."""
    hits = _steps(fitted).withColumn("_d", F.explode(_offsets(disc(line_width // 2))))
    at = lambda c, d: _clipped(size, F.rint(c).cast("int"), d)
    return hits.withColumns({"x": at("sx", "_d.dx"), "y": at("sy", "_d.dy")}).drop("_d", "sx", "sy")


def stitch_maps(hits: DataFrame) -> DataFrame:
    """Hit count, mean direction and density of each touched pixel."""
    px = hits.groupBy(*PX).agg(F.count(F.lit(1)).alias("hits"), F.avg("ux").alias("dir_x"), F.avg("uy").alias("dir_y"))
    p99 = grouped_quantiles(px, ["design_id"], "hits", {"p99": 0.99}, bin_width=1.0)
    density = clamp01(F.log1p("hits") / F.log1p(F.greatest(F.lit(1.0), F.col("p99"))))
    return px.join(p99, "design_id").withColumn("density", density).drop("p99")


_DRAWN = ("color_layer", "n_segments", "kind")


def _last_writers(hits: DataFrame) -> DataFrame:
    """The last segment over each pixel. A number beside its segment is kept by hash; a row of them would be kept by sorting."""
    return hits.groupBy(*PX).agg(*(F.max_by(c, "segment_id").alias(c) for c in _DRAWN), F.max("segment_id").alias("segment_id"))


def _kind() -> Column:
    return F.when(F.col("length_px") <= 1.8, 1).when(F.col("length_px") <= 6.0, 2).otherwise(3)


def _written(last: DataFrame) -> DataFrame:
    order = (F.col("segment_id") - 1) / F.greatest(F.lit(1), F.col("n_segments") - 1)
    return last.select(*PX, "color_layer", order.alias("path_order"), F.col("kind").alias("stitch_type"), "segment_id")


def last_writer_maps(hits: DataFrame) -> DataFrame:
    """Attributes of the last segment drawn over each pixel."""
    return _written(_last_writers(hits.withColumn("kind", _kind())))


#: Steps that are drawn at once.
_STEPS = 1 << 18


def _last(design: np.ndarray, y: np.ndarray, x: np.ndarray, side: int) -> np.ndarray:
    """Places of the last entry of each pixel."""
    key = (design * side + y) * side + x
    return len(key) - 1 - np.unique(key[::-1], return_index=True)[1]


def _draw(batches: Iterator[pa.RecordBatch], size: int, offsets: list[tuple[int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Segments to their pixels; of segments of a batch over one pixel, the last."""
    reach = max(max(abs(d) for d in o) for o in offsets)
    side = size + 2 * reach
    for batch in batches:
        ends = np.cumsum(batch.column("steps").to_numpy(zero_copy_only=False).astype(np.int64) + 1) // _STEPS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
        for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
            col = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("segment_id", "steps", "entry_x", "entry_y", "exit_x", "exit_y")}
            if not all(np.isfinite(col[c]).all() for c in ("entry_x", "entry_y", "exit_x", "exit_y")):
                raise ValueError("a segment has an end that is not finite")
            order = np.argsort(col["segment_id"], kind="stable")
            n = col["steps"][order].astype(np.int64)
            row, of = np.repeat(order, n + 1), np.repeat(n, n + 1)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)

            def at(axis: str) -> np.ndarray:
                a, b = col[f"entry_{axis}"][row], col[f"exit_{axis}"][row]
                # What lies further out than the disc reaches is clipped to the same pixels.
                return np.clip(np.rint(np.where(i == of, b, a + i * ((b - a) / of))), -reach, size - 1 + reach).astype(np.int64)

            design = part.column("design_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            y, x = at("y"), at("x")
            kept = np.sort(_last(design[row], y + reach, x + reach, side))
            row = np.repeat(row[kept], len(offsets))
            y, x = (np.clip(c[kept][:, None] + np.array([o[k] for o in offsets]), 0, size - 1).ravel() for k, c in enumerate((y, x)))
            kept = _last(design[row], y, x, side)
            taken = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array(c[kept].astype(np.int32)) for c in (y, x)] + [part.column(c).take(taken) for c in names], names=["y", "x", *names])


def drawn_maps(fitted: DataFrame, size: int = 64, line_width: int = 1) -> DataFrame:
    """:func:`last_writer_maps` of :func:`rasterize_segments`: tasks draw batches of segments, of which only the last over each pixel is sent on."""
    names = ["design_id", *_DRAWN, "segment_id"]
    segments = _drawn(fitted).withColumn("kind", _kind()).select(*names, "steps", "entry_x", "entry_y", "exit_x", "exit_y")
    types, offsets = dict(segments.dtypes), disc(line_width // 2)
    schema = "y int not null, x int not null, " + ", ".join(f"`{c}` {types[c]}" for c in names)
    return _written(_last_writers(segments.mapInArrow(lambda batches: _draw(batches, size, offsets, names), schema)))


def event_maps(fitted: DataFrame, labels: dict[str, Column], closures: DataFrame, size: int = 64, line_width: int = 1, point_radius: int = 2) -> DataFrame:
    """Sparse channels of traces, near links, long jumps, trims, color changes, closure gaps and order, merged by maximum.

    ``fitted`` has the end of the segment before (prev_exit_x, prev_exit_y), over which ``labels`` are columns; ``closures`` has the ends x0, y0, x1, y1
    of each gap in pixels. A segment gives its line, the line to it and its points in one expansion, so nothing is joined to it."""
    ok = F.sqrt((F.col("exit_x") - F.col("entry_x")) ** 2 + (F.col("exit_y") - F.col("entry_y")) ** 2) >= 1e-6
    order = (F.col("segment_id") - 1) / F.greatest(F.lit(1), F.col("n_segments") - 1)
    linked = F.col("seg_x").isNotNull()
    cell = lambda channel, value: F.struct(F.lit(channel).alias("channel"), (F.lit(value) if isinstance(value, float) else value).alias("value"))
    shapes = fitted.withColumn("_line", F.explode(F.array_compact(F.array(
        F.when(ok, F.struct(F.col("entry_x").alias("x0"), F.col("entry_y").alias("y0"), F.col("exit_x").alias("x1"), F.col("exit_y").alias("y1"), F.lit(0).alias("kind"))),
        F.when(linked & labels["near_connect_label"], F.struct(F.col("prev_exit_x").alias("x0"), F.col("prev_exit_y").alias("y0"), F.col("entry_x").alias("x1"), F.col("entry_y").alias("y1"), F.lit(1).alias("kind")))))))
    span = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))).cast("int"))
    clip = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(c).cast("int") + F.col(d)))
    lines = line_samples(shapes.select("design_id", "_line.*", order.alias("order")), "x0", "y0", "x1", "y1", span)
    lines = lines.withColumn("_d", F.explode(_offsets(disc(line_width // 2)))).select(
        "design_id", clip("sy", "_d.dy").alias("y"), clip("sx", "_d.dx").alias("x"),
        F.explode(F.when(F.col("kind") == 1, F.array(cell("near_connect", 1.0))).otherwise(F.array(cell("stitch_trace", 1.0), cell("path_order", F.col("order"))))).alias("c"))
    mark = lambda label, channel, value: F.when(linked & labels[label], cell(channel, value))
    marks = F.array_compact(F.array(mark("long_jump_label", "long_jump", 1.0), mark("trim_label", "trim", 1.0), mark("color_change_label", "color_change", 0.85)))
    ends = lambda *names: F.array(*(F.struct(F.col(a).alias("px"), F.col(b).alias("py")) for a, b in names))
    points = fitted.select("design_id", F.explode(marks).alias("c"), ends(("prev_exit_x", "prev_exit_y"), ("entry_x", "entry_y")).alias("_e"))
    points = points.unionByName(closures.select("design_id", cell("closure_gap", 1.0).alias("c"), ends(("x0", "y0"), ("x1", "y1")).alias("_e")))
    points = points.withColumn("_p", F.explode("_e")).withColumn("_d", F.explode(_offsets(disc(point_radius))))
    inside = lambda c: (c >= 0) & (c < size)
    py, px = F.rint("_p.py").cast("int") + F.col("_d.dy"), F.rint("_p.px").cast("int") + F.col("_d.dx")
    points = points.filter(inside(py) & inside(px)).select("design_id", py.alias("y"), px.alias("x"), "c")
    return lines.unionByName(points).groupBy("design_id", F.col("c.channel").alias("channel"), "y", "x").agg(F.max("c.value").alias("value"))


def off_mask_stitches(moves: DataFrame, mask: DataFrame, size: int = 64, target_width_mm: float = 25.6, step_mm: float = 1.0) -> DataFrame:
    """Share of sample points of each stitch outside the mask (outside the canvas counts as outside).

    A stitch meets its design's canvas as bits, not a row per pixel."""
    scale = target_width_mm / max(1, size)
    stitches = moves.filter((F.col("command") == "STITCH") & F.col("has_prev")).select("design_id", "seq", "distance_mm", "prev_x", "prev_y", "x_mm", "y_mm")
    steps = F.greatest(F.lit(1), F.ceil(F.col("distance_mm") / max(0.1, step_mm)).cast("int"))
    at = lambda a, b, i: F.rint((F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))) / scale + size / 2.0).cast("int")
    placed = stitches.filter("distance_mm > 1e-6").withColumn("_n", steps).join(canvas_bits(mask, size).hint("merge"), "design_id", "left")
    points = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.struct(at("prev_y", "y_mm", i).alias("y"), at("prev_x", "x_mm", i).alias("x")))
    off = F.size(F.filter(points, lambda p: ~on_canvas("_canvas", p["y"], p["x"], size)))
    return placed.select("design_id", "seq", "distance_mm", (off / (F.col("_n") + 1)).alias("off_fraction"))


def visible_connectors(off: DataFrame, min_mm: float = 1.5, ratio: float = 0.65) -> DataFrame:
    """Off-mask stitch length and count and visible connectors per design."""
    d, f = F.col("distance_mm"), F.col("off_fraction")
    seen = (d >= min_mm) & (f >= ratio)
    return off.groupBy("design_id").agg(
        half_even(F.sum(d * f), 4).alias("off_mask_stitch_length_mm"), F.count_if(f > 0).alias("off_mask_stitch_count"),
        F.count_if(seen).alias("visible_connector_count"),
        half_even(F.coalesce(F.sum(F.when(seen, d)), F.lit(0.0)), 4).alias("visible_connector_length_mm"))


def dilate(pixels: DataFrame, radius: int, size: int) -> DataFrame:
    """Disc dilation of a pixel set inside the canvas."""
    near = moved_words(pixel_words(pixels), disc(radius), size).groupBy("design_id", "y", "word").agg(F.bit_or("near").alias("bits"))
    return word_pixels(near)


def coverage_metrics(stitch: DataFrame, target: DataFrame, size: int, adaptive_radius: int = 1) -> DataFrame:
    """Coverage and precision of drawn stitches against a target mask and its dilation, in one grouping of words of pixels (which may repeat)."""
    none = F.lit(0).cast("long")
    near = moved_words(pixel_words(target), disc(adaptive_radius), size).select("design_id", "y", "word", none.alias("s"), F.col("own").alias("t"), F.col("near").alias("a"))
    drawn = pixel_words(stitch).select("design_id", "y", "word", F.col("bits").alias("s"), none.alias("t"), none.alias("a"))
    px = near.unionByName(drawn).groupBy("design_id", "y", "word").agg(*[F.bit_or(c).alias(c) for c in "sta"])
    n = lambda c: F.sum(F.bit_count(c))
    s, t, a = (F.col(c) for c in "sta")
    g = px.groupBy("design_id").agg(
        n(t).alias("target_pixels"), n(a).alias("adaptive_target_pixels"), n(s).alias("stitch_pixels"), n(s.bitwiseAND(t)).alias("overlap_pixels"),
        n(s.bitwiseAND(F.bitwise_not(t))).alias("off_target_pixels"), n(s.bitwiseAND(a)).alias("adaptive_overlap_pixels"),
        n(s.bitwiseAND(F.bitwise_not(a))).alias("adaptive_off_target_pixels"))
    ratio = lambda p, q: half_even(F.col(p) / F.greatest(F.lit(1), F.col(q)), 6)
    return g.withColumns({
        "coverage_ratio": ratio("overlap_pixels", "target_pixels"), "stitch_precision_ratio": ratio("overlap_pixels", "stitch_pixels"),
        "adaptive_coverage_ratio": ratio("adaptive_overlap_pixels", "adaptive_target_pixels"),
        "adaptive_stitch_precision_ratio": ratio("adaptive_overlap_pixels", "stitch_pixels"),
        "overfill_outside_adaptive_ratio": ratio("adaptive_off_target_pixels", "stitch_pixels")})


def skeleton_coverage(stitch: DataFrame, skeleton: DataFrame, size: int, adaptive_radius: int = 1, low: float = 0.95) -> DataFrame:
    """Coverage against a skeleton target with low-coverage flags."""
    m = coverage_metrics(stitch, skeleton, size, adaptive_radius)
    return m.select("design_id", F.col("target_pixels").alias("skeleton_pixels"), F.col("coverage_ratio").alias("skeleton_coverage_ratio"),
                    F.col("adaptive_coverage_ratio").alias("adaptive_skeleton_coverage_ratio"),
                    (F.col("coverage_ratio") < low).alias("low_skeleton_coverage"))


NEIGHBOURS_4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
NEIGHBOURS_8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def boundary_pixels(pixels: DataFrame, connectivity: int = 4, keys: Sequence[str] = ("design_id",)) -> DataFrame:
    """Foreground pixels with a neighbour missing: every word of pixels votes for the words around it, one shuffle."""
    around = NEIGHBOURS_4 if connectivity == 4 else NEIGHBOURS_8
    words = pixel_words(pixels, keys)
    none = F.lit(0).cast("long")
    votes = {(0, 0): {"own": F.col("bits")}}
    for i, (dy, dx) in enumerate(around):
        for dw, bits in shifted(F.col("bits"), dx).items():
            votes.setdefault((dy, dw), {})[f"n{i}"] = bits
    names = ["own", *(f"n{i}" for i in range(len(around)))]
    cells = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dw).alias("dw"), *[v.get(n, none).alias(n) for n in names]) for (dy, dw), v in votes.items()])
    cells = words.select(*keys, "y", "word", F.explode(cells).alias("v")).filter(" OR ".join(f"v.{n} <> 0" for n in names))
    met = cells.groupBy(*keys, (F.col("y") + F.col("v.dy")).alias("y"), (F.col("word") + F.col("v.dw")).alias("word")).agg(
        *[F.bit_or(f"v.{n}").alias(n) for n in names])
    inner = F.col("own")
    for n in names[1:]:
        inner = inner.bitwiseAND(F.col(n))
    return word_pixels(met.withColumn("bits", F.col("own").bitwiseAND(F.bitwise_not(inner))), keys)


def row_runs(pixels: DataFrame, min_run: int = 1, keys: Sequence[str] = ("design_id",)) -> DataFrame:
    """Maximal horizontal runs (a row of the canvas bounds the window)."""
    w = W.partitionBy(*keys, "y").orderBy("x")
    island = pixels.withColumn("_g", F.col("x") - F.row_number().over(w))
    runs = island.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.filter(F.col("x1") - F.col("x0") + 1 >= min_run).select(*keys, "y", "x0", "x1")


def connector_stats(connectors: DataFrame, maps: DataFrame, size: int, step_px: float = 1.0) -> DataFrame:
    """Values of a map along each connector: inside share, least, 5 % quantile and mean.

    ``connectors``: design_id, connector_id, ax, ay, bx, by; ``maps``: design_id, y, x, value (absent pixels are 0).
    The number of samples of a connector is bounded by the canvas diagonal.
    """
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    steps = F.greatest(F.lit(1), F.ceil(length / max(0.25, step_px)).cast("int"))
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(c).cast("int")))
    s = line_samples(connectors, "ax", "ay", "bx", "by", steps).select(
        "design_id", "connector_id", clip("sy").alias("y"), clip("sx").alias("x"))
    v = s.join(maps.select(*PX, "value"), PX, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return v.groupBy("design_id", "connector_id").agg(
        F.avg((F.col("value") > 0).cast("double")).alias("inside_fraction"), F.min("value").alias("min_value"),
        F.percentile("value", F.lit(0.05)).alias("q05_value"), F.avg("value").alias("mean_value"))


def connector_is_safe(min_value: float = 1.0, q05_value: float = 1.5) -> Column:
    return (F.col("min_value") >= min_value) & (F.col("q05_value") >= q05_value)


def split_polylines_by_mask(points: DataFrame, mask: DataFrame, size: int, step_px: float = 0.75, min_inside: float = 0.72,
                            min_points: int = 2) -> DataFrame:
    """Cut point sequences at points outside the mask and at links that leave it.

    ``points``: design_id, seq (dense), px, py.  An outside point is dropped; a bad link starts a new run.
    """
    linked = previous_values(points, ["design_id"], "seq", {"_px": "px", "_py": "py"}).join(canvas_bits(mask, size).hint("merge"), "design_id", "left")
    inside = lambda px, py: on_canvas("_canvas", F.rint(py).cast("int"), F.rint(px).cast("int"), size)
    flagged = linked.withColumns({"inside": inside("px", "py"), "_pin": inside("_px", "_py")})
    length = F.sqrt((F.col("px") - F.col("_px")) ** 2 + (F.col("py") - F.col("_py")) ** 2)
    steps = F.greatest(F.lit(1), F.ceil(length / max(0.25, step_px)).cast("int"))
    at = lambda a, b, i: F.rint(F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))).cast("int")
    samples = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.struct(at("_py", "py", i).alias("y"), at("_px", "px", i).alias("x")))
    met = F.size(F.filter(samples, lambda p: on_canvas("_canvas", p["y"], p["x"], size)))
    both = F.col("inside") & F.col("_pin")
    joined = flagged.withColumn("_n", F.when(both, steps)).withColumn("share", F.when(both, met / (F.col("_n") + 1)))
    joined = joined.select("design_id", "seq", "inside", "_pin", "share")
    starts = F.col("inside") & (~F.col("_pin") | (F.col("share") < min_inside))
    numbered = running_totals(joined, ["design_id"], "seq", {"run_id": F.coalesce(starts, F.lit(False)).cast("long")}).filter("inside")
    sizes = numbered.groupBy("design_id", "run_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return sizes.filter(F.col("n") >= min_points).select("design_id", "first_seq", "last_seq", F.col("n").alias("point_count"))


def binary_map_eval(pred: DataFrame, target: DataFrame, threshold: float = 0.5) -> DataFrame:
    """IoU and F1 of two sparse maps per design."""
    p = pred.filter(F.col("value") > threshold).select(*PX, F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = target.filter(F.col("value") > threshold).select(*PX, F.lit(0).alias("p"), F.lit(1).alias("t"))
    px = p.unionByName(t).groupBy(*PX).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    tp, fp, fn = (F.count_if(c).cast("double") for c in ((F.col("p") == 1) & (F.col("t") == 1), (F.col("p") == 1) & (F.col("t") == 0), (F.col("p") == 0)))
    return px.groupBy("design_id").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
        "design_id", (F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"),
        (2.0 * F.col("tp") / F.greatest(F.lit(1.0), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def map_errors(pred: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """Mean absolute error over the canvas and over the pixels where the target is set."""
    both = pred.select(*PX, F.col("value").alias("p"), F.lit(None).cast("double").alias("t")).unionByName(
        target.select(*PX, F.lit(None).cast("double").alias("p"), F.col("value").alias("t")))
    px = both.groupBy(*PX).agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"), F.max("t").alias("t"))
    err = F.abs(F.col("p") - F.coalesce("t", F.lit(0.0)))
    valid = F.coalesce(F.col("t") > 0, F.lit(False))
    return px.groupBy("design_id").agg(
        (F.sum(err) / float(size * size)).alias("mae"),
        (F.coalesce(F.sum(F.when(valid, err)), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(valid))).alias("mae_on_valid"))


def class_map_eval(pred: DataFrame, target: DataFrame, classes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Mean IoU of the classes and accuracy where the target has a class (column ``cls``)."""
    both = pred.select(*PX, F.col("cls").alias("p"), F.lit(None).cast("int").alias("t")).unionByName(
        target.select(*PX, F.lit(None).cast("int").alias("p"), F.col("cls").alias("t")))
    px = both.groupBy(*PX).agg(F.coalesce(F.max("p"), F.lit(0)).alias("p"), F.coalesce(F.max("t"), F.lit(0)).alias("t"))
    iou = F.lit(0.0)
    for c in classes:
        p, t = F.col("p") == c, F.col("t") == c
        iou = iou + F.count_if(p & t) / F.greatest(F.lit(1), F.count_if(p | t))
    on = F.col("t") > 0
    return px.groupBy("design_id").agg(
        (iou / len(classes)).alias("miou"), (F.count_if(on & (F.col("p") == F.col("t"))) / F.greatest(F.lit(1), F.count_if(on))).alias("acc_on_mask"))


def peak_recall(pred: DataFrame, target: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Share of target peaks also above the threshold in the prediction."""
    t = target.filter(F.col("value") > threshold).select(*PX)
    p = pred.filter(F.col("value") > threshold).select(*PX, F.lit(1).alias("hit"))
    return t.join(p, PX, "left").groupBy("design_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("endpoint_peak_recall"))


def top1_error(pred: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """Distance of the two highest pixels over the canvas diagonal (lowest pixel index wins a tie)."""
    flat = F.col("y") * size + F.col("x")
    top = lambda df, n: df.groupBy("design_id").agg(F.max_by(F.struct("y", "x"), F.struct("value", (-flat).alias("f"))).alias(n))
    d = F.sqrt((F.col("a.y") - F.col("b.y")) ** 2 + (F.col("a.x") - F.col("b.x")) ** 2)
    return top(pred, "a").join(top(target, "b"), "design_id").select("design_id", (d / float((2 * size * size) ** 0.5)).alias("top1_error_norm"))


def order_pair_accuracy(pixels: DataFrame, samples: int = 256, pairs: int = 512, margin: float = 0.02, seed: int = 7) -> DataFrame:
    """Share of hash-sampled pixel pairs whose predicted order agrees (``pixels``: design_id, y, x, pred, target)."""
    pick = F.xxhash64(F.lit(seed), "y", "x")
    ranked = pixels.withColumn("_r", F.row_number().over(W.partitionBy("design_id").orderBy(pick, "y", "x"))).filter(F.col("_r") <= samples)
    sizes = ranked.groupBy("design_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 3)
    drawn = sizes.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(pairs)))).select(
        "design_id", (F.pmod(F.xxhash64(F.lit(seed), "_j"), F.col("_n")) + 1).alias("_a"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "_j"), F.col("_n")) + 1).alias("_b"))
    side = lambda n: ranked.select("design_id", F.col("_r").cast("long").alias(f"_{n}"), F.col("pred").alias(f"p_{n}"), F.col("target").alias(f"t_{n}"))
    j = drawn.join(side("a"), ["design_id", "_a"]).join(side("b"), ["design_id", "_b"])
    td, pd_ = F.col("t_a") - F.col("t_b"), F.col("p_a") - F.col("p_b")
    return j.filter(F.abs(td) > margin).groupBy("design_id").agg(
        F.avg((F.signum(td) == F.signum(pd_)).cast("double")).alias("order_pair_accuracy"))


def class_weights(pixels: DataFrame, classes: int, cls: str = "cls", background: float = 0.45) -> DataFrame:
    """1 / sqrt(share), normalised to mean 1 over all classes, background damped."""
    counts = pixels.agg(*[F.count_if(F.col(cls) == c).alias(f"c{c}") for c in range(classes)], F.count(F.lit(1)).alias("n"))
    w = lambda c: 1.0 / F.sqrt(F.greatest(F.lit(1e-6), F.col(f"c{c}") / F.greatest(F.lit(1), F.col("n"))))
    mean = sum((w(c) for c in range(1, classes)), w(0)) / classes
    rows = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"c{c}").alias("pixels"),
                              (w(c) / mean * (background if c == 0 else 1.0)).alias("weight")) for c in range(classes)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def class_histogram_entropy(typed: DataFrame, classes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Distinct color layers and base-2 entropy of the stitch types of each design."""
    n = sum((F.count_if(F.col("stitch_type") == c) for c in classes[1:]), F.count_if(F.col("stitch_type") == classes[0]))
    ent = F.lit(0.0)
    for c in classes:
        p = F.count_if(F.col("stitch_type") == c) / F.greatest(F.lit(1), n)
        ent = ent + F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return typed.groupBy("design_id").agg(F.count_distinct(F.when(F.col("color_layer") > 0, F.col("color_layer"))).alias("color_layers"),
                                          half_even(ent, 6).alias("stitch_type_entropy"))


def rank_colors(pixels: DataFrame, background: int = 8) -> DataFrame:
    """Label colors by falling pixel count (distinct colors of one canvas bound the window)."""
    counts = pixels.filter((F.col("r") > background) | (F.col("g") > background) | (F.col("b") > background)).groupBy(
        "design_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("pixels"))
    w = W.partitionBy("design_id").orderBy(F.col("pixels").desc(), "r", "g", "b")
    return counts.withColumn("label", F.row_number().over(w).cast("long"))


def background_labels(labelled: DataFrame, palette: DataFrame, height: int, width: int, light: float = 235.0,
                      border_share: float = 0.30, area_share: float = 0.05) -> DataFrame:
    """Labels that dominate the border, or are bright and large (``labelled``: design_id, y, x, label; palette: label, r, g, b)."""
    y, x = F.col("y"), F.col("x")
    edges = (y == 0).cast("int") + (y == height - 1).cast("int") + (x == 0).cast("int") + (x == width - 1).cast("int")
    per = labelled.groupBy("design_id", "label").agg(F.count(F.lit(1)).alias("area"), F.sum(edges).alias("border"))
    total = per.groupBy("design_id").agg(F.max_by("label", F.struct("border", (-F.col("label")).alias("l"))).alias("_top"))
    bright = (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) >= light
    j = per.join(total, "design_id").join(palette, "label")
    dominant = (F.col("label") == F.col("_top")) & (F.col("border") / float(2 * (height + width)) > border_share)
    return j.filter(dominant | (bright & (F.col("area") / float(height * width) > area_share))).select("design_id", "label", "area", "border")


def mask_features(px: DataFrame, size: int, line_threshold: float = 0.35) -> DataFrame:
    """Eight features of a design from its pixel rows (density, stitch_type, centerline, boundary)."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    ratio = lambda c: F.count_if(c) / n
    width = F.greatest(F.lit(1), F.max("x") - F.min("x") + 1)
    return px.groupBy("design_id").agg(
        (F.count(F.lit(1)) / float(size * size)).alias("area_ratio"), (width / F.greatest(F.lit(1), F.max("y") - F.min("y") + 1)).alias("bbox_aspect"),
        F.avg("density").alias("density_mean"), ratio(F.col("centerline") > line_threshold).alias("centerline_ratio"),
        ratio(F.col("boundary") > line_threshold).alias("boundary_ratio"), ratio(F.col("stitch_type") == 1).alias("running_ratio"),
        ratio(F.col("stitch_type") == 2).alias("satin_ratio"), ratio(F.col("stitch_type") == 3).alias("fill_ratio"))


def direction_confidence_stats(px: DataFrame, valid_from: float = 0.35, low: float = 0.2) -> DataFrame:
    """Mean confidence, weak share and valid-axis coverage (``px``: design_id, confidence on the mask)."""
    c = F.col("confidence")
    return px.groupBy("design_id").agg(
        F.avg(c).alias("mean_direction_confidence"), F.avg((c < low).cast("double")).alias("low_direction_confidence_ratio"),
        F.count_if(c >= valid_from).alias("axis_valid_pixels"),
        (F.count_if(c >= valid_from) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("axis_valid_coverage_on_mask"))


def trimap_to_mask(pixels: DataFrame) -> DataFrame:
    """Foreground of a label image: {1, 3} where the design uses only 0..3, else everything above 0."""
    top = pixels.groupBy("design_id").agg(F.max("value").alias("_max"))
    fg = F.when(F.col("_max") <= 3, F.col("value").isin(1, 3)).otherwise(F.col("value") > 0)
    return pixels.join(top, "design_id").filter(fg).select(*PX)
