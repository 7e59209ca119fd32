"""Group summaries, comparisons and risk audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import half_even, key_text, mean0, num_value, rounded_delta

LEVELS = ("hard_fail", "warning", "pass", "excellent")


def _summary(metrics: Sequence[str], digits: int = 8) -> list[Column]:
    return ([F.count(F.lit(1)).alias("samples")] + [F.count_if(F.col("quality_level") == v).alias(v) for v in LEVELS]
            + [half_even(mean0(num_value(m)), digits).alias(f"mean_{m}") for m in metrics])


def summarize_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*[key_text(k).alias(k) for k in keys]).agg(*_summary(metrics))


def summarize_by_each(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The same summary over all rows and by each key, in one pass."""
    named = df.withColumns({k: key_text(k) for k in keys})
    sets = [[F.col(k)] for k in keys] + [[]]
    out = named.groupingSets(sets, *[F.col(k) for k in keys]).agg(*_summary(metrics), F.grouping_id().alias("_gid"))
    n = len(keys)
    by, value = F.lit("all"), F.lit("")
    for i, k in enumerate(keys):
        here = F.col("_gid") == ((1 << n) - 1 - (1 << (n - 1 - i)))
        by, value = F.when(here, F.lit(k)).otherwise(by), F.when(here, F.col(k)).otherwise(value)
    return out.select(by.alias("group_by"), value.alias("group_value"), *[c for c in out.columns if c not in (*keys, "_gid")])


def value_counts_json(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """JSON map of value counts per key."""
    per = df.groupBy(*keys, key_text(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("v", "n")))
    return per.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias(f"{value}_counts"))


def compare_profiles(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """base_*, compare_* and delta_* per sample of two profiles."""
    base = a.select(key, *[F.col(m).alias(f"base_{m}") for m in metrics])
    other = b.select(key, *[F.col(m).alias(f"compare_{m}") for m in metrics])
    j = base.join(other, key)
    return j.withColumns({f"delta_{m}": rounded_delta(num_value(f"compare_{m}"), num_value(f"base_{m}")) for m in metrics})


def improvement_counts(compared: DataFrame, metrics: Sequence[str]) -> DataFrame:
    d = lambda m: F.col(f"delta_{m}")
    return compared.agg(*[c for m in metrics for c in (
        F.count_if(d(m) > 0).alias(f"{m}_up"), F.count_if(d(m) < 0).alias(f"{m}_down"),
        half_even(mean0(d(m)), 8).alias(f"mean_delta_{m}"))])


def method_deltas(df: DataFrame, baseline: str, metrics: Sequence[str], key: str = "sample_id", method: str = "candidate") -> DataFrame:
    """Mean change of each method against a named method on the samples both have."""
    base = df.filter(F.col(method) == baseline).select(key, *[F.col(m).alias(f"b_{m}") for m in metrics])
    return df.join(base, key).groupBy(method).agg(
        F.count(F.lit(1)).alias("samples"), *[half_even(mean0(num_value(m) - num_value(f"b_{m}")), 8).alias(f"delta_{m}") for m in metrics])


def split_ranking(df: DataFrame, preset: str, split: str, score: str) -> DataFrame:
    """Mean score of each preset per split and its rank there."""
    from pyspark.sql import Window as W
    means = df.groupBy(preset, split).agg(F.count(F.lit(1)).alias("samples"), F.avg(score).alias("mean_score"))
    # One row per preset and split is left: the window is over the list of presets.
    return means.withColumn("split_rank", F.rank().over(W.partitionBy(split).orderBy("mean_score")).cast("long"))


def changed_from_baseline(selected: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    base = baseline.select(key, F.col("candidate").alias("baseline_candidate"), *[F.col(m).alias(f"_b_{m}") for m in metrics])
    j = selected.join(base, key)
    return j.select(key, "baseline_candidate", F.col("candidate").alias("selected_candidate"),
                    (F.col("baseline_candidate") != F.col("candidate")).alias("changed"),
                    *[rounded_delta(num_value(m), num_value(f"_b_{m}")).alias(f"delta_{m}") for m in metrics])


def prediction_ratios(pred: DataFrame, truth: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """pred - truth and pred / truth (denominator at least 1e-6)."""
    t = truth.select(key, *[F.col(m).alias(f"_t_{m}") for m in metrics])
    j = pred.join(t, key)
    return j.select(key, *[c for m in metrics for c in (
        (num_value(m) - num_value(f"_t_{m}")).alias(f"{m}_delta"),
        (num_value(m) / F.greatest(F.lit(1e-6), num_value(f"_t_{m}"))).alias(f"{m}_ratio"))])


def summary_delta(current: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    ref = reference.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in metrics])
    return current.join(ref, list(keys)).select(
        *keys, *[rounded_delta(num_value(m), num_value(f"_r_{m}")).alias(f"delta_{m}") for m in metrics])


def low_counts(df: DataFrame, keys: Sequence[str], floors: Mapping[str, Column | float]) -> DataFrame:
    """How many rows are below the floor of each measure."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), *[
        F.count_if(num_value(m) < floor).alias(f"low_{m}") for m, floor in floors.items()])


def switch_quality(df: DataFrame, teacher: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Recall and precision of a switch and the exact-match rate (0/1 columns)."""
    t, p = F.col(teacher) == 1, F.col(predicted) == 1
    ratio = lambda a, b: half_even(F.count_if(a) / F.greatest(F.lit(1), F.count_if(b)), 8)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), ratio(t & p, t).alias("switch_recall"),
                                 ratio(t & p, p).alias("switch_precision"), ratio(t == p, F.lit(True)).alias("exact_match"))


# Risk limits and weights.
RISK_LIMITS = {"unified_loss": 0.10, "jump_count": 10.0, "trim_count": 3.0, "off_mask_stitch_length_mm": 1.0,
               "visible_connector_count": 0.0, "coverage_ratio": 0.90, "stitch_precision_ratio": 0.75}
RISK_WEIGHTS = {"unified_loss": 1.0, "jump_count": 0.006, "trim_count": 0.004, "off_mask_stitch_length_mm": 0.030,
                "visible_connector_count": 0.015}


def risk_rows(df: DataFrame, limits: Mapping[str, float] = RISK_LIMITS, components: Column | None = None,
              bias: float = 2.0, multiplier: float = 2.0) -> DataFrame:
    """Ordered flags, risk score and review flag; with ``components`` only jumps beyond an allowance count."""
    jump, jump_flag = num_value("jump_count"), "high_jump"
    if components is not None:
        allowance = bias + multiplier * F.greatest(F.lit(1), components)
        df = df.withColumns({"component_jump_allowance": half_even(allowance, 6),
                             "jump_excess_count": half_even(F.greatest(F.lit(0.0), jump - allowance), 6)})
        jump, jump_flag = num_value("jump_excess_count"), "high_jump_excess"
    q = F.lower(F.trim(F.coalesce("quality_level", F.lit(""))))
    over = lambda c, m, name: F.when(c > limits[m], F.lit(name))
    under = lambda m, name: F.when(num_value(m) < limits[m], F.lit(name))
    flags = F.array_compact(F.array(
        F.when(q.isin("warning", "fail", "hard_fail"), F.concat(F.lit("quality_"), q)),
        over(num_value("unified_loss"), "unified_loss", "high_loss"), over(jump, "jump_count", jump_flag),
        over(num_value("trim_count"), "trim_count", "high_trim"),
        over(num_value("off_mask_stitch_length_mm"), "off_mask_stitch_length_mm", "off_mask"),
        over(num_value("visible_connector_count"), "visible_connector_count", "visible_connector"),
        under("coverage_ratio", "low_coverage"), under("stitch_precision_ratio", "low_precision")))
    lack = lambda m: F.greatest(F.lit(0.0), limits[m] - num_value(m))
    score = None
    for m, w in RISK_WEIGHTS.items():
        part = w * (jump if m == "jump_count" else num_value(m))
        score = part if score is None else score + part
    score = score + 0.5 * lack("coverage_ratio") + 0.25 * lack("stitch_precision_ratio")
    return df.withColumn("_flags", flags).withColumns({
        "risk_flags": F.concat_ws("|", "_flags"), "risk_flag_count": F.size("_flags").cast("long"),
        "risk_score": half_even(score + 0.05 * F.size("_flags"), 8), "needs_review": F.size("_flags") > 0}).drop("_flags")


def risk_summary(risky: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(RISK_LIMITS)) -> DataFrame:
    """Review rate, mean risk and the worst sample of each group."""
    worst = F.max_by(F.struct("sample_id", "candidate", "risk_flags"), F.struct(F.col("risk_score"), -F.col("sample_id"), -F.col("ordinal")))
    return risky.groupBy(*[key_text(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("needs_review").alias("review_samples"),
        half_even(F.avg(F.col("needs_review").cast("double")), 6).alias("review_rate"),
        half_even(F.avg("risk_score"), 8).alias("mean_risk_score"), F.max("risk_score").alias("worst_risk_score"), worst.alias("_w"),
        *[half_even(mean0(num_value(m)), 8).alias(f"mean_{m}") for m in metrics]).withColumns({
            "worst_sample_id": F.col("_w.sample_id"), "worst_candidate": F.col("_w.candidate"), "worst_flags": F.col("_w.risk_flags")}).drop("_w")


def flag_counts(risky: DataFrame) -> DataFrame:
    return risky.select(F.explode(F.split("risk_flags", r"\|")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(
        F.count(F.lit(1)).alias("count"))


def review_queue(risky: DataFrame, top: int = 10) -> DataFrame:
    return risky.filter("needs_review").orderBy(F.col("risk_score").desc(), "source_name", "sample_id", "ordinal").limit(top)


def execution_risk(known_bad: Column | None = None) -> dict[str, Column]:
    """Explosion ratios against absolute scales and the baseline, and their penalty."""
    pos = lambda m: F.greatest(F.lit(0.0), num_value(f"delta_{m}"))
    cap = lambda c: F.least(F.lit(8.0), c)
    jump = F.greatest(num_value("jump_count") / 50.0, pos("jump_count") / 10.0)
    trim = F.greatest(num_value("trim_count") / 10.0, pos("trim_count") / 3.0)
    off = F.greatest(num_value("off_mask_stitch_length_mm"), pos("off_mask_stitch_length_mm"))
    vis = F.greatest(num_value("visible_connector_count"), pos("visible_connector_count"))
    bad = known_bad if known_bad is not None else F.lit(False)
    score = (cap(jump) + 0.9 * cap(trim) + 1.5 * cap(off / 10.0) + 2.0 * cap(vis) + 8.0 * pos("unified_loss")
             + F.when(F.lower("quality_level") == "hard_fail", F.lit(4.0)).otherwise(F.lit(0.0)) + F.when(bad, F.lit(2.0)).otherwise(F.lit(0.0)))
    return {"execution_penalty_score": half_even(score, 8), "jump_explosion_ratio": half_even(jump, 8),
            "trim_explosion_ratio": half_even(trim, 8), "offmask_explosion_mm": half_even(off, 8),
            "visible_explosion_count": half_even(vis, 8)}
