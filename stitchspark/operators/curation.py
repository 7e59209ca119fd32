"""Manifests: splits, leakage, quality flags, enrichment, incremental work, attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import order_number
from ..functions.scalars import bin_numeric, file_stem, source_family, stable_unit
from ..functions.semantics import half_even


def hash_split(source: str) -> Column:
    """Stable 10 / 10 / 80 test, validation, train split of a source path."""
    u = stable_unit(source, 8)
    return F.when(u < 0.10, F.lit("test")).when(u < 0.20, F.lit("val")).otherwise(F.lit("train"))


def family_split(family, source, hex_digits: int = 12) -> Column:
    """Stable 15 / 12 / 73 split of family::source."""
    u = stable_unit(F.concat(F.col(family), F.lit("::"), F.col(source)), hex_digits)
    return F.when(u < 0.15, F.lit("test")).when(u < 0.27, F.lit("val")).otherwise(F.lit("train"))


# Bins of the canonical split.
SEGMENT_BINS = ([1000, 3000, 8000, 20000], ["seg_lt1k", "seg_1k_3k", "seg_3k_8k", "seg_8k_20k", "seg_ge20k"])
MASK_BINS = ([0.05, 0.10, 0.20, 0.40], ["mask_lt05", "mask_05_10", "mask_10_20", "mask_20_40", "mask_ge40"])


def canonical_split(manifest: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Split, bins and leakage against an older split matched by file stem (the last old row of a stem counts)."""
    m = manifest.withColumns({"source_family": source_family("source_dst"), "stem": file_stem("source_dst")})
    if old is not None:
        prior = old.withColumn("stem", file_stem("source_dst")).groupBy("stem").agg(F.max_by("split", "ordinal").alias("old_split"))
        m = m.join(prior, "stem", "left")
    else:
        m = m.withColumn("old_split", F.lit(None).cast("string"))
    split = family_split("source_family", "source_dst")
    m = m.withColumns({
        "canonical_split": split, "old_split": F.coalesce("old_split", F.lit("")),
        "segment_bin": bin_numeric("segments", *SEGMENT_BINS), "mask_ratio_bin": bin_numeric("mask_ratio", *MASK_BINS)})
    return m.withColumn("leakage_if_using_old_pretrain", (F.col("old_split") == "train") & F.col("canonical_split").isin("val", "test")).drop("stem")


def family_ood_split(manifest: DataFrame) -> DataFrame:
    """Hold out families by their alphabetical rank (ranks end in 0 or 3: test, 6: validation)."""
    m = manifest.withColumn("source_family", source_family("source_dst"))
    families = m.select("source_family").distinct().withColumn("one", F.lit(1))
    # Families are numbered through the first letter as coarse order, so no task sees all of them.
    ranked = order_number(families, ["one"], [F.col("source_family")], F.substring("source_family", 1, 1), "n").select(
        "source_family", (F.col("n") - 1).alias("family_rank"))
    last = F.col("family_rank") % 10
    split = F.when(last.isin(0, 3), F.lit("ood_test")).when(last == 6, F.lit("ood_val")).otherwise(F.lit("train"))
    return m.join(ranked, "source_family").withColumn("family_ood_split", split)


def ordinal_split(df: DataFrame, key: str, val_share: float = 0.1, test_share: float = 0.1, seed: int = 7) -> DataFrame:
    """Exact shares by position in a seeded hash order (positions by hash prefix, then within it)."""
    h = F.xxhash64(F.lit(seed), key)
    one = df.withColumns({"_one": F.lit(1), "_h": h})
    ranked = order_number(one, ["_one"], [F.col("_h"), F.col(key)], F.shiftright(F.col("_h"), 52), "_n")
    total = df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    pos = F.col("_n") / F.col("_total")
    split = F.when(pos <= val_share, F.lit("val")).when(pos <= val_share + test_share, F.lit("test")).otherwise(F.lit("train"))
    return ranked.join(total, "_one").withColumn("split", split).drop("_one", "_h", "_n", "_total")


def every_nth_split(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 10, coarse: Column | None = None) -> DataFrame:
    """Every n-th row of each group is validation."""
    ranked = order_number(df, list(group), [F.col(c) for c in order], coarse if coarse is not None else F.lit(0), "_n")
    return ranked.withColumn("split", F.when((F.col("_n") - 1) % n == 0, F.lit("val")).otherwise(F.lit("train"))).drop("_n")


def filter_designs(df: DataFrame, min_segments: int = 100, max_segments: int = 30000) -> DataFrame:
    """skip_reason of designs outside the segment range (empty where usable)."""
    s = F.col("segments")
    return df.withColumn("skip_reason", F.when(s < min_segments, F.lit("too_few_segments")).when(s > max_segments, F.lit("too_many_segments")).otherwise(F.lit("")))


def qa_flags(extra: bool = False) -> Column:
    """'|'-joined flags: sparse mask, extreme aspect, weak direction, complexity; ``extra`` adds the graph checks, sorted."""
    basic = F.array_compact(F.array(
        F.when(F.col("mask_ratio") < 0.05, F.lit("very_sparse_mask")).when(F.col("mask_ratio") < 0.10, F.lit("sparse_mask")),
        F.when(F.col("aspect_ratio") > 8.0, F.lit("extreme_aspect")),
        F.when(F.col("low_direction_confidence_ratio") > 0.5, F.lit("weak_direction_label")),
        F.when(F.col("segments") > 30000, F.lit("high_complexity"))))
    if not extra:
        return F.concat_ws("|", basic)
    more = F.array_compact(F.array(
        F.when(F.col("axis_valid_pixels") < F.greatest(F.lit(16), F.floor(F.col("mask_pixels") * 0.05)), F.lit("low_axis_valid_coverage")),
        F.when(F.col("removed_pixels") > 0, F.lit("color_islands_cleaned")),
        F.when(F.col("edge_distance") <= 2, F.lit("edge_truncation_risk"))))
    return F.concat_ws("|", F.array_sort(F.array_distinct(F.concat(basic, more))))


def enrich_manifest(designs: DataFrame, canvas: int, padding: int) -> DataFrame:
    """mask_ratio, aspect_ratio and mm_per_px from design measures (width_mm, height_mm, mask_pixels)."""
    long, short = F.greatest("width_mm", "height_mm"), F.least("width_mm", "height_mm")
    return designs.withColumns({
        "mask_ratio": F.col("mask_pixels") / float(canvas * canvas), "aspect_ratio": long / F.greatest(F.lit(1e-6), short),
        "mm_per_px_est": long / float(max(1, canvas - 2 * padding))})


def count_by(df: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("count").desc(), *keys).limit(top) if top else out


def attach_attribution(manifest: DataFrame, notes: Mapping[str, tuple[str, str]]) -> DataFrame:
    """License and attribution by source."""
    lic, att = F.lit(""), F.lit("")
    for source, (a, b) in notes.items():
        lic, att = F.when(F.col("source_name") == source, F.lit(a)).otherwise(lic), F.when(F.col("source_name") == source, F.lit(b)).otherwise(att)
    return manifest.withColumns({"license": lic, "attribution": att})


def source_counts(manifest: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Sample count of every listed source, zero included: each row is counted once against the fixed list."""
    counts = manifest.agg(*[F.count_if(F.col("source_name") == s).alias(f"c{i}") for i, s in enumerate(sources)])
    rows = F.array(*[F.struct(F.lit(s).alias("source_name"), F.col(f"c{i}").alias("samples")) for i, s in enumerate(sources)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def incremental_todo(inputs: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    return inputs if overwrite else inputs.join(outputs.select(key).distinct(), key, "left_anti")


def color_order(blocks: DataFrame) -> DataFrame:
    """Colors of each design by total points, most first (a design's colors bound the window)."""
    totals = blocks.groupBy("design_id", "color_index").agg(F.sum("points").alias("points"), F.min("block_no").alias("_first"))
    w = W.partitionBy("design_id").orderBy(F.col("points").desc(), "_first")
    return totals.withColumn("color_order", F.row_number().over(w).cast("long")).drop("_first")


def variant_expansion(manifest: DataFrame, variants: int, key: str = "sample_id") -> DataFrame:
    """Each sample with numbered variants sample_augNN."""
    return manifest.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants)))).withColumn(
        "variant_id", F.concat(F.col(key).cast("string"), F.lit("_aug"), F.lpad(F.col("variant").cast("string"), 2, "0")))


def sketch_filter(min_strokes: int = 2, max_strokes: int = 8, low: float = 0.30, high: float = 0.85, canvas: float = 255.0) -> Column:
    """Recognised sketches with a sane number of strokes and box area (drawing: strokes of [xs, ys])."""
    xs, ys = (F.flatten(F.transform("drawing", _axis(i))) for i in (0, 1))
    box = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return F.col("recognized") & _sane(F.size("drawing"), box, min_strokes, max_strokes, low, high, canvas)


def _sane(strokes: Column, box: Column, min_strokes: int = 2, max_strokes: int = 8, low: float = 0.30, high: float = 0.85, canvas: float = 255.0) -> Column:
    return strokes.between(min_strokes, max_strokes) & (box / (canvas * canvas)).between(low, high)


def _axis(i: int):
    return lambda stroke: F.get(stroke, F.lit(i))


def sketch_per_category(sketches: DataFrame, **limits) -> DataFrame:
    """The accepted sketch with the smallest key of each category."""
    return _smallest(sketches.filter(sketch_filter(**limits)))


def dots_per_category(dots: DataFrame, **limits) -> DataFrame:
    """As `sketch_per_category`, for recognised sketches whose strokes are rows of one point (category, key_id, x, y): counts and boxes, no gathered drawing."""
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    found = dots.groupBy("category", "key_id").agg(F.count(F.lit(1)).alias("strokes"), box.alias("box"))
    return _smallest(found.filter(_sane(F.col("strokes"), F.col("box"), **limits)))


def _smallest(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("category").agg(F.min("key_id").alias("key_id"), F.count(F.lit(1)).alias("accepted"))


def unusable_pairs(images: DataFrame, designs: DataFrame) -> DataFrame:
    """Image and design files matched by stem; rows with one side missing carry the reason."""
    first = lambda df, name: df.withColumn("stem", F.lower(file_stem("path"))).groupBy("stem").agg(F.min("path").alias(name))
    j = first(images, "image_path").join(first(designs, "design_path"), "stem", "full_outer")
    return j.withColumn("reason", F.when(F.col("image_path").isNull(), F.lit("missing_image")).when(F.col("design_path").isNull(), F.lit("missing_design")).otherwise(F.lit("")))
