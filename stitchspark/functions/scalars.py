"""Column builders: names, hashes, bins, families, geometry of one step, rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import clamp01, col, half_even, num_value


def _trim_underscore(c: Column) -> Column:
    return F.regexp_replace(c, "^_+|_+$", "")


def slug(text, max_len: int = 80, default: str = "item") -> Column:
    """File-safe text: runs of other characters become one underscore."""
    s = F.substring(_trim_underscore(F.regexp_replace(F.trim(col(text)), "[^a-zA-Z0-9._-]+", "_")), 1, max_len)
    return F.when(F.length(s) == 0, F.lit(default)).otherwise(s)


def file_stem(path) -> Column:
    """Last path part without its last suffix."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.when(name.rlike("^[.]?[^.]+$"), name).otherwise(F.regexp_replace(name, "[.][^.]*$", ""))


def design_key(path, index, prefix: str = "design") -> Column:
    """prefix_00042_stem."""
    stem = F.substring(_trim_underscore(F.regexp_replace(file_stem(path), "[^A-Za-z0-9_-]+", "_")), 1, 48)
    stem = F.when(F.length(stem) == 0, F.lit("design")).otherwise(stem)
    return F.concat(F.lit(prefix + "_"), F.format_string("%05d", col(index).cast("long")), F.lit("_"), stem)


def source_family(path) -> Column:
    """Leading letters of the file stem, else its first three characters."""
    stem = file_stem(path)
    letters = F.regexp_extract(stem, "^([A-Za-z]+)", 1)
    return F.when(letters == "", F.substring(stem, 1, 3)).otherwise(letters)


def stable_unit(text, hex_digits: int = 8) -> Column:
    """Hash of a text as a number in [0, 1]."""
    return (F.conv(F.substring(F.sha1(col(text)), 1, hex_digits), 16, 10).cast("double")
            / F.lit(float(16 ** hex_digits - 1)))


def bin_numeric(value, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first cut above the value, else the last label."""
    out = F.when(col(value) < cuts[0], F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(col(value) < cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Keyword lists of the candidate families; the first row with a hit wins.
FAMILY_SCHEMES: dict[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "teacher": (
        (("dt_satin", "dtsatin", "satinrail", "satin_rail", "satin"), "satin_like"),
        (("styleaware", "style_aware"), "style_aware_mixed"),
        (("outline",), "outline_border"),
        (("mask_fill",), "fill_tatami_like"),
        (("skeleton", "skel"), "running_line"),
    ),
    "sweep": (
        (("dtsatin", "dt_satin"), "dt_satin"),
        (("satinrail", "satin_rail", "satin"), "satin_like"),
        (("outline",), "outline_border"),
        (("styleaware", "style_running"), "style_running"),
        (("edgewalk",), "edgewalk_fill"),
        (("nearestrow", "nearest_row"), "nearestrow_fill"),
        (("mask_fill",), "mask_fill"),
    ),
    "kind": (
        (("dtsatin", "dt_satin"), "dt_satin"),
        (("satinrail", "satin_rail"), "satin_rail"),
        (("satin",), "satin"),
        (("outline",), "outline"),
        (("style",), "style_aware"),
        (("skeleton", "line"), "running"),
    ),
}
# Family names seen by the selector, and the labels the trainer accepts.
SELECTOR_FAMILY = {
    "base_keep": "base_keep", "edgewalk_fill": "fill_tatami_like", "nearestrow_fill": "fill_tatami_like",
    "mask_fill": "fill_tatami_like", "dt_satin": "satin_like", "satin_like": "satin_like",
    "satin_rail": "satin_like", "outline_border": "outline_border", "style_running": "running_line",
    "running_line": "running_line",
}
LABEL_FAMILY = {
    "base_keep": "base_keep", "running_line": "running_line", "auto_running": "auto_running", "auto_fill": "auto_fill",
    "fill_tatami_like": "fill_tatami_like", "satin_like": "satin_like", "outline_border": "outline_border",
    "edgewalk_fill": "fill_tatami_like", "nearestrow_fill": "fill_tatami_like", "mask_fill": "fill_tatami_like",
    "dt_satin": "satin_like", "satin_rail": "satin_like", "satinrail": "satin_like", "satin": "satin_like",
    "style_running": "running_line", "style_aware_mixed": "running_line", "reject": "reject",
}


def _any_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def candidate_family(name, scheme: str = "teacher", context=None) -> Column:
    """Family of a candidate from the keywords of its name.

    ``context`` is the branch for the teacher scheme and the mode for the sweep scheme.
    """
    text = F.lower(col(name))
    context = F.lower(F.coalesce(col(context), F.lit(""))) if context is not None else F.lit("")
    if scheme == "sweep":
        text = F.concat_ws(" ", text, context)
    out = F.when(text == "base_keep", F.lit("base_keep")) if scheme != "sweep" else None
    for words, family in FAMILY_SCHEMES[scheme]:
        hit = _any_word(text, words)
        out = F.when(hit, F.lit(family)) if out is None else out.when(hit, F.lit(family))
    if scheme == "teacher":
        line = _any_word(context, ("skeleton", "line", "text"))
        return out.when(text.contains("auto"), F.when(line, F.lit("auto_running")).otherwise(F.lit("auto_fill"))) \
            .otherwise(F.lit("unknown"))
    return out.otherwise(F.lit("other" if scheme == "sweep" else "fill"))


def lookup(value, table: Mapping[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(value)), default)


def selector_family(family) -> Column:
    trimmed = F.trim(F.coalesce(col(family), F.lit("")))
    return lookup(trimmed, SELECTOR_FAMILY, trimmed)


def label_family(family) -> Column:
    return lookup(F.lower(F.coalesce(col(family), F.lit(""))), LABEL_FAMILY, F.lit("candidate_non_teacher"))


def candidate_tags(name) -> dict[str, Column]:
    """Indicator and numeric tags read from a candidate name."""
    text = F.lower(col(name))
    one = lambda cond: cond.cast("double")
    has = lambda *words: one(_any_word(text, words))
    number = lambda pattern, group=1: F.coalesce(
        F.replace(F.regexp_extract(text, pattern, group), F.lit("p"), F.lit(".")).try_cast("double"), F.lit(0.0))
    adaptive = has("adapt_", "_adapt")
    inset = number(r"inset([0-9]+)")
    fixed = one((inset > 0) & (adaptive == 0))
    nearest = has("nearestrow", "nearest_row")
    adapt = r"adapt_t([0-9]+(?:p[0-9]+)?)_m([0-9]+(?:p[0-9]+)?)"
    tags = {
        "is_skeleton": has("skeleton"), "is_auto": has("auto"), "is_mask_fill": has("mask_fill"),
        "is_edgewalk": has("edgewalk"), "is_nearestrow": nearest,
        "is_raw_nearestrow": one((nearest == 1) & (fixed == 0) & (adaptive == 0)),
        "is_fixed_inset": fixed, "is_inset1": one((inset == 1) & (adaptive == 0)),
        "is_inset2": one((inset == 2) & (adaptive == 0)), "fixed_inset_px": inset,
        "is_adaptive_inset": adaptive, "adaptive_thin_px": number(adapt, 1), "adaptive_mid_px": number(adapt, 2),
        "row_spacing_tag": number(r"rows([0-9]+)"), "mask_path_limit_tag": number(r"_p([0-9]+)"),
        "is_style_aware": has("styleaware", "style_aware"), "is_outline": has("outline"), "is_satin": has("satin"),
        "is_satinrail": has("satinrail"), "is_dt_satin": has("dtsatin", "dt_satin"), "is_quantvalid": has("quantvalid"),
        "is_segvalid": has("segvalid"), "is_qdirect": has("qdirect"), "is_qpath": has("qpath"), "is_strict": has("strict"),
    }
    return {f"candidate_{name}": value for name, value in tags.items()}


# Which tag is multiplied by which measure, under which name.
TAG_INTERACTIONS = {
    "interaction_skeleton_x_line_score": ("is_skeleton", "branch_line_score"), "interaction_skeleton_x_coverage": ("is_skeleton", "coverage_ratio"),
    "interaction_auto_x_coverage": ("is_auto", "coverage_ratio"), "interaction_mask_fill_x_coverage": ("is_mask_fill", "coverage_ratio"),
    "interaction_mask_fill_x_line_score": ("is_mask_fill", "branch_line_score"), "interaction_edgewalk_x_coverage": ("is_edgewalk", "coverage_ratio"),
    "interaction_nearestrow_x_coverage": ("is_nearestrow", "coverage_ratio"), "interaction_nearestrow_x_mask_area": ("is_nearestrow", "mask_area_ratio"),
    "interaction_fixed_inset_x_mask_area": ("is_fixed_inset", "mask_area_ratio"), "interaction_inset2_x_mask_area": ("is_inset2", "mask_area_ratio"),
    "interaction_adaptive_inset_x_mask_area": ("is_adaptive_inset", "mask_area_ratio"),
    "interaction_adaptive_inset_x_skeleton_ratio": ("is_adaptive_inset", "skeleton_to_mask_ratio"),
    "interaction_style_aware_x_coverage": ("is_style_aware", "coverage_ratio"), "interaction_style_aware_x_line_score": ("is_style_aware", "branch_line_score"),
}


def tag_interactions(name, measures) -> dict[str, Column]:
    tags = candidate_tags(name)
    return {k: tags[f"candidate_{t}"] * num_value(m) for k, (t, m) in TAG_INTERACTIONS.items() if m in measures}


def command_class(code, names: Mapping[int, str], mask: int = 0xFF, unknown: str = "unsupported_") -> Column:
    """Name of a command code after masking."""
    masked = col(code).cast("int").bitwiseAND(F.lit(mask))
    out = None
    for value, name in names.items():
        out = F.when(masked == value, F.lit(name)) if out is None else out.when(masked == value, F.lit(name))
    return out.otherwise(F.concat(F.lit(unknown), masked.cast("string")))


def segment_type(length_px) -> Column:
    """1 run, 2 satin, 3 fill by segment length."""
    return F.when(col(length_px) <= 1.8, 1).when(col(length_px) <= 6.0, 2).otherwise(3)


def region_stitch_class(width, height, area_mm2, satin_max_width_mm: float = 6.0) -> Column:
    short = F.greatest(F.lit(0.01), F.least(col(width), col(height)))
    aspect = F.greatest(col(width), col(height)) / short
    return (F.when((short < 1.2) | ((col(area_mm2) < 8.0) & (aspect > 2.0)), F.lit("run"))
            .when((short <= satin_max_width_mm) & (aspect >= 1.45), F.lit("satin")).otherwise(F.lit("fill")))


def axis_direction(dx, dy) -> dict[str, Column]:
    """Undirected axis (cos 2a, sin 2a) and confidence of a mean direction."""
    size = F.sqrt(col(dx) * col(dx) + col(dy) * col(dy))
    angle, valid = F.atan2(col(dy), col(dx)), size > 1e-6
    pick = lambda c: F.when(valid, c).otherwise(F.lit(0.0))
    return {"axis_x": pick(F.cos(2.0 * angle)), "axis_y": pick(F.sin(2.0 * angle)), "confidence": pick(clamp01(size))}


def mm_to_px(value_mm, size_px, width_px, target_width_mm: float) -> Column:
    """Pixel coordinate (unrounded) of a millimetre coordinate with the origin at the canvas centre."""
    scale = F.lit(float(target_width_mm)) / F.greatest(F.lit(1), F.lit(width_px))
    return col(value_mm) / scale + F.lit(size_px) / 2.0


def px_to_mm(value_px, size_px, scale_mm) -> Column:
    return (col(value_px) - F.lit(size_px) / 2.0) * F.lit(float(scale_mm))


def nearest_index(r, g, b, palette: Sequence[tuple[int, int, int]]) -> Column:
    """Position of the closest palette color; the earlier entry wins a tie."""
    def gap(i: int) -> Column:
        pr, pg, pb = palette[i]
        dr, dg, db = col(r) - pr, col(g) - pg, col(b) - pb
        return F.struct((dr * dr + dg * dg + db * db).cast("double").alias("d"), F.lit(i).alias("i"))
    return F.array_min(F.array(*[gap(i) for i in range(len(palette))]))["i"]


def nearest_name(r, g, b, names: Mapping[tuple[int, int, int], str]) -> Column:
    labels = F.array(*[F.lit(v) for v in names.values()])
    return F.get(labels, nearest_index(r, g, b, list(names)))


def luminance(r, g, b) -> Column:
    return 0.2126 * col(r) + 0.7152 * col(g) + 0.0722 * col(b)


def ratio_features(counts) -> Column:
    """Count map to shares; negatives count as 0, an empty total gives an empty map."""
    positive = F.transform_values(col(counts), lambda k, v: F.greatest(F.lit(0.0), F.coalesce(v.cast("double"), F.lit(0.0))))
    total = F.aggregate(F.map_values(positive), F.lit(0.0), lambda a, v: a + v)
    shares = F.transform_values(positive, lambda k, v: v / F.when(total > 0, total))
    return F.when(total > 0, shares).otherwise(F.map_filter(shares, lambda k, v: F.lit(False)))


def flatten_numeric(prefix: str, fields: Mapping[str, str]) -> Column:
    """Map of prefixed names to doubles for numeric and boolean fields (name -> Spark type name)."""
    numeric = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}
    kept = [n for n, t in fields.items() if t in numeric]
    return F.map_from_arrays(F.array(*[F.lit(f"{prefix}.{n}") for n in kept]),
                             F.array(*[F.col(n).cast("double") for n in kept]))


def interaction_features(sample_cols: Sequence[str], preset_cols: Sequence[str]) -> dict[str, Column]:
    return {f"{s}__x__{p}": F.col(s).cast("double") * F.col(p).cast("double") for s in sample_cols for p in preset_cols}


def derived_features(selected, density, mask, running, satin, fill) -> dict[str, Column]:
    return {
        "coverage_density": num_value(selected) * num_value(density),
        "mask_density": num_value(mask) * num_value(density),
        "running_to_satin_ratio": num_value(running) / F.greatest(F.lit(1e-6), num_value(satin)),
        "fill_or_satin_ratio": num_value(fill) + num_value(satin),
    }


def planner_prior(area="area_ratio", fill="fill_ratio", boundary="boundary_ratio", center="centerline_ratio",
                  nodes="path_graph_nodes", long_ratio="long_jump_ratio") -> Column:
    """Sixteen planning parameters from four features and two statistics."""
    busy = (num_value(nodes) >= 20) | (num_value(boundary) > 0.16) | (num_value(center) > 0.10)
    dense = (num_value(fill, 0.5) >= 0.45) | (num_value(area) >= 0.18)
    lr = num_value(long_ratio)
    pick = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    values = {
        "row_step_px": pick(dense, 2, 3), "point_step_px": pick(busy, 1, 2), "min_component_px": pick(busy, 18, 28),
        "max_components": pick(busy, 90, 60), "long_jump_threshold_mm": pick(lr > 0.08, 7.0, 8.0),
        "long_jump_weight": pick(lr > 0.05, 1.1, 0.45), "two_opt_passes": pick(busy, 2, 1),
        "connect_near_mm": pick(num_value(center) > 0.06, 2.0, 1.2), "continuity_order_weight": F.lit(0.85),
        "jump_endpoint_weight": pick(lr > 0.04, 0.45, 0.35), "continuity_connect_threshold": F.lit(0.25),
        "continuity_connect_max_mm": F.lit(5.0), "max_stitch_mm": pick(dense, 3.6, 4.0),
        "max_jump_mm": pick(lr > 0.04, 6.5, 7.5), "trim_jump_threshold_mm": pick(lr > 0.04, 8.5, 10.0),
        "serpentine_fill": F.lit(True),
    }
    return F.struct(*[c.alias(n) for n, c in values.items()])


# Settings of the relation cost.
RELATION_DEFAULTS = {
    "enabled": True, "d_ref_mm": 2.0, "jump_mm": 2.5, "illegal_jump_mm": 18.0, "big_m": 1000000.0, "w_d": 1.0,
    "w_jump": 1.2, "w_trim": 0.8, "w_lock": 0.2, "w_near_connect": 1.0, "w_axis_align": 0.5, "w_endpoint_compat": 0.6,
    "w_retrieval": 0.8, "trim_mm": 10.0, "near_connect_scale_mm": 2.5, "endpoint_compat_mm": 3.0, "retrieval_prior": 0.0,
}


def unit_vector(dx, dy) -> tuple[Column, Column]:
    """Direction of a step; a step of no length points along x."""
    size = F.sqrt(col(dx) * col(dx) + col(dy) * col(dy))
    flat = size <= 1e-6
    safe = F.when(flat, F.lit(1.0)).otherwise(size)
    return F.when(flat, F.lit(1.0)).otherwise(col(dx) / safe), F.when(flat, F.lit(0.0)).otherwise(col(dy) / safe)


def relation_cost(distance_mm, near_signal, jump_signal, transition_dir, segment_dir, config=None) -> Column:
    """Penalty minus bonus of a transition, with its terms."""
    c = {**RELATION_DEFAULTS, **(config or {})}
    d = col(distance_mm).cast("double")
    if not c["enabled"]:
        return F.struct(d.alias("cost"), d.alias("distance_mm"))
    norm = F.least(d / max(1e-6, c["d_ref_mm"]), F.lit(3.0))
    align = F.abs(transition_dir[0] * segment_dir[0] + transition_dir[1] * segment_dir[1])
    compat = F.greatest(F.lit(0.0), 1.0 - d / max(1e-6, c["endpoint_compat_mm"]))
    near = F.greatest(col(near_signal), F.lit(0.0), 1.0 - d / max(1e-6, c["near_connect_scale_mm"]))
    step = lambda limit: F.when(d >= limit, F.lit(1.0)).otherwise(F.lit(0.0))
    jump, trim, lock = F.greatest(col(jump_signal), step(c["jump_mm"])), step(c["trim_mm"]), step(c["jump_mm"])
    cost = (c["w_d"] * norm + c["w_jump"] * jump + c["w_trim"] * trim + c["w_lock"] * lock) - (
        c["w_near_connect"] * near + c["w_axis_align"] * align + c["w_endpoint_compat"] * compat
        + F.lit(c["w_retrieval"] * c["retrieval_prior"]))
    illegal = d >= c["illegal_jump_mm"]
    return F.struct(
        F.when(illegal, F.lit(c["big_m"])).otherwise(cost).alias("cost"), d.alias("distance_mm"),
        norm.alias("normalized_distance"), near.alias("near_bonus"), jump.alias("jump_risk"),
        trim.alias("trim_risk"), align.alias("axis_align"), compat.alias("endpoint_compat"),
        illegal.alias("illegal_jump"))


def component_style(skeleton_pixels, area, max_distance_px, min_skeleton_pixels: int = 12, running_ratio: float = 0.22,
                    running_max_distance_px: float = 2.5) -> dict[str, Column]:
    """Running line or fill, with the reasons that made it a running line."""
    enough = col(skeleton_pixels) >= min_skeleton_pixels
    ratio = col(skeleton_pixels) / F.greatest(F.lit(1), col(area))
    reasons = F.array_compact(F.array(
        F.when(enough & (ratio >= running_ratio), F.lit("high_skeleton_ratio")),
        F.when(enough & (col(max_distance_px) <= running_max_distance_px), F.lit("thin_distance_transform"))))
    return {
        "style": F.when(F.size(reasons) > 0, F.lit("running")).otherwise(F.lit("fill")),
        "skeleton_ratio": half_even(ratio, 6), "reasons": F.concat_ws("|", reasons),
    }


def fill_inset(area, max_distance, q25_distance, median_distance, thin_area_px: int = 40, thin_px: float = 2.0,
               mid_px: float = 4.0, max_inset_px: int = 2) -> Column:
    """Starting inset of a fill from the distance statistics of its component."""
    return (F.when(col(area) <= 0, F.lit(0))
            .when((col(area) <= thin_area_px) | (col(max_distance) <= thin_px), F.lit(0))
            .when((col(max_distance) <= mid_px) | (col(q25_distance) <= 1.25) | (col(median_distance) <= 2.0),
                  F.lit(min(1, max(0, max_inset_px))))
            .otherwise(F.lit(max(0, max_inset_px))))


def use_region_mask(area_ratio, region_mean) -> Column:
    return col(area_ratio).between(1.15, 1.55) & (col(region_mean) <= 0.5)


def parse_profile_map(text) -> Column:
    """'name=value, name=value' to a map of doubles."""
    return F.transform_values(F.str_to_map(F.regexp_replace(col(text), r"\s+", ""), F.lit(","), F.lit("=")),
                              lambda k, v: v.try_cast("double"))


def hard_status(thresholds: Mapping[str, tuple[str, float]]) -> Column:
    """Threshold checks ('min' or 'max' per metric) with the passed count and the overall result."""
    checks = F.array(*[
        F.struct(F.lit(name).alias("metric"), num_value(name).alias("value"),
                 ((num_value(name) >= limit) if mode == "min" else (num_value(name) <= limit)).alias("passed"))
        for name, (mode, limit) in thresholds.items()])
    passed = F.size(F.filter(checks, lambda e: e["passed"]))
    return F.struct(checks.alias("checks"), passed.alias("passed"), (passed == len(thresholds)).alias("all_passed"))


def decode_param(value, lo, hi, kind: str) -> Column:
    """Clamp a predicted parameter to its observed range and restore its type."""
    kept = F.least(F.greatest(col(value), col(lo)), col(hi))
    if kind == "bool":
        return kept >= 0.5
    return F.rint(kept).cast("int") if kind == "int" else half_even(kept, 6)


def continuity_adjusted_cost(distance_mm, near_mean, jump_mean, long_jump_mm: float = 8.0, long_jump_weight: float = 0.45,
                             order_weight: float = 0.85, endpoint_weight: float = 0.35) -> Column:
    """Distance and long-jump cost, lowered by the near signal of the link and raised by its jump signal."""
    d = col(distance_mm)
    return (d + long_jump_weight * F.greatest(F.lit(0.0), d - long_jump_mm) - order_weight * col(near_mean) * long_jump_mm
            + endpoint_weight * col(jump_mean) * F.greatest(d, F.lit(float(long_jump_mm))))
