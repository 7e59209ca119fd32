"""Dominance, configuration sweeps and robust policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import order_number
from ..functions.semantics import half_even, minmax_norm, num_value
from ..functions.tables import Rounds

MINIMISE = ("mean_unified_loss", "mean_jump_count", "mean_trim_count", "mean_off_mask_stitch_length_mm", "mean_visible_connector_count")
MAXIMISE = ("mean_coverage_ratio", "mean_stitch_precision_ratio")


def _beaten(rows: np.ndarray, by: np.ndarray, eps: float, chunk: int = 512) -> np.ndarray:
    """Which rows are dominated by any of ``by`` (all columns minimised)."""
    out = np.zeros(len(rows), dtype=bool)
    for at in range(0, len(rows), chunk):
        part = rows[at:at + chunk, None, :]
        no_worse = (by[None] <= part + eps).all(axis=2)
        better = (by[None] + eps < part).any(axis=2)
        out[at:at + chunk] = (no_worse & better).any(axis=1)
    return out


def pareto_front(df: DataFrame, id_col: str, group: Sequence[str] = (), minimise: Sequence[str] = MINIMISE,
                 maximise: Sequence[str] = MAXIMISE, eps: float = 1e-12, block_rows: int = 4096, best: int = 64) -> DataFrame:
    """Rows no other row of their group dominates.

    A row can only be dominated by one whose sum of normalised values is no larger. So the ``best`` rows of a group by that sum drop most others first, in
    one pass over all rows; the rest are put in order of the sum and cut into blocks, and a block is checked against the blocks whose sums start no later
    than its own end, each two in a task of their own. No task holds a group, and rows with later sums are never compared.
    """
    df = df if group else df.withColumn("_all", F.lit(0))
    group = list(group) or ["_all"]
    cols = [*minimise, *maximise]
    slim = df.select(*group, F.col(id_col).alias("_id"), *[(num_value(c) if c in minimise else -num_value(c)).alias(c) for c in cols])
    spans = slim.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    width = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    total = sum((F.when(width(c) > 0, (F.col(c) - F.col(f"lo_{c}")) / width(c)).otherwise(0.0) for c in cols), F.lit(0.0))
    # Sums that eps or rounding may have put in the wrong order.
    loose = sum((F.when(width(c) > 0, eps / width(c)).otherwise(0.0) for c in cols), F.lit(1e-9))
    rounds = Rounds(df.sparkSession)
    scored = rounds.keep(slim.join(spans, group).select(*slim.columns, total.alias("_sum"), loose.alias("_loose")), "scored")
    place = F.row_number().over(W.partitionBy(*group).orderBy("_sum", "_id"))
    few = scored.withColumn("_place", place).filter(F.col("_place") <= best).groupBy(*group).agg(F.collect_list(F.struct(*cols)).alias("_few"))
    beats = lambda f: reduce(and_, [f[c] <= F.col(c) + eps for c in cols]) & reduce(or_, [f[c] + eps < F.col(c) for c in cols])
    left = scored.join(few, group).filter(~F.exists("_few", beats)).drop("_few")
    left = rounds.keep(order_number(left, group, [F.col("_sum"), F.col("_id")], F.floor(F.col("_sum") * 1000), "_place").withColumn("_block", F.floor((F.col("_place") - 1) / block_rows)), "left")
    rounds.drop("scored")

    blocks = left.groupBy(*group, "_block").agg(F.min("_sum").alias("_from"), F.max(F.col("_sum") + F.col("_loose")).alias("_to"))
    own, other = blocks.select(*group, F.col("_block").alias("_i"), "_to"), blocks.select(*group, F.col("_block").alias("_j"), "_from")
    pairs = own.join(other, group).filter("_from <= _to").select(*group, "_i", "_j")
    many = pairs.groupBy(*group, "_i").agg(F.count(F.lit(1)).alias("_blocks"))
    values = left.select(*group, "_id", *cols, F.col("_block"))
    tasks = values.withColumnRenamed("_block", "_i").join(pairs, [*group, "_i"]).withColumn("_cand", F.lit(True)).unionByName(
        values.withColumnRenamed("_block", "_j").join(pairs, [*group, "_j"]).withColumn("_cand", F.lit(False)))

    def against(pdf: pd.DataFrame) -> pd.DataFrame:
        cand, by = pdf[pdf["_cand"]], pdf[~pdf["_cand"]]
        return cand.loc[~_beaten(cand[cols].to_numpy(dtype=float), by[cols].to_numpy(dtype=float), eps), [*group, "_id", "_i"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in (*group, "_id")) + ", _i bigint"
    kept = tasks.groupBy(*group, "_i", "_j").applyInPandas(against, kinds).groupBy(*group, "_id", "_i").agg(F.count(F.lit(1)).alias("_n"))
    front = kept.join(many, [*group, "_i"]).filter("_n = _blocks")
    return df.join(front.select(*group, F.col("_id").alias(id_col)), [*group, id_col], "left_semi").drop("_all")


def collapse_duplicates(df: DataFrame, signature: Sequence[str], objective: str = "objective", order: Sequence[str] = ()) -> DataFrame:
    """Best row of each outcome signature and the number of rows that share it."""
    rest = [c for c in df.columns if c not in signature]
    return df.groupBy(*signature).agg(F.min_by(F.struct(*rest), F.struct(objective, *order)).alias("r"),
                                      F.count(F.lit(1)).alias("equivalent_config_count")).select(*signature, "r.*", "equivalent_config_count")


# Weights of the knee score.
KNEE_WEIGHTS = {"mean_unified_loss": 0.32, "mean_jump_count": 0.18, "mean_trim_count": 0.08, "mean_off_mask_stitch_length_mm": 0.12,
                "mean_visible_connector_count": 0.05, "mean_coverage_ratio": 0.18, "mean_stitch_precision_ratio": 0.07}


def knee_score(df: DataFrame, group: Sequence[str], min_coverage: float = 0.90) -> DataFrame:
    """Normalised distance to the best corner of the group's metric ranges."""
    spans = df.groupBy(*group).agg(*[f(num_value(m)).alias(f"{n}_{m}") for m in KNEE_WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for m, w in KNEE_WEIGHTS.items():
        norm = minmax_norm(num_value(m), f"lo_{m}", f"hi_{m}")
        score = score + w * (norm if m in MINIMISE else 1.0 - norm)
    score = score + 0.5 * F.greatest(F.lit(0.0), min_coverage - num_value("mean_coverage_ratio"))
    return df.join(spans, list(group)).withColumn("balanced_knee_score", half_even(score, 8)).select(*df.columns, "balanced_knee_score")


def recommendations(front: DataFrame, group: Sequence[str], id_col: str, min_coverage: float = 0.90, max_hard_fail: int = 0) -> DataFrame:
    """Best objective, low jump, high coverage and knee of the feasible rows (of all when none is feasible)."""
    front = Rounds(front.sparkSession).keep(front, "front")  # it is read several times
    feasible = (num_value("hard_fail") <= max_hard_fail) & (num_value("mean_coverage_ratio") + 1e-12 >= min_coverage)
    marked = front.withColumn("_f", feasible)
    some = marked.groupBy(*group).agg(F.max("_f").alias("_any"))
    pool = marked.join(some, list(group)).filter(F.col("_f") | ~F.col("_any")).drop("_f", "_any")
    scored = knee_score(pool, group, min_coverage)
    i = F.col(id_col)
    picks = {
        "best_objective": F.struct("objective", i), "best_low_jump": F.struct("mean_jump_count", "objective", i),
        "best_high_coverage": F.struct((-F.col("mean_coverage_ratio")).alias("c"), "objective", i),
        "balanced_knee": F.struct("balanced_knee_score", i),
    }
    row = F.struct(i.alias("id"), "objective", "balanced_knee_score")
    wide = scored.groupBy(*group).agg(*[F.min_by(row, o).alias(n) for n, o in picks.items()])
    long = wide.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("recommendation"), F.col(n).alias("r")) for n in picks])).alias("p"))
    return long.select(*group, "p.recommendation", F.col("p.r.id").alias(id_col), F.col("p.r.objective").alias("objective"),
                       F.col("p.r.balanced_knee_score").alias("balanced_knee_score"))


def gate_objective(min_coverage: float = 0.90, max_hard_fail: int = 0) -> Column:
    """Objective of a sweep summary row."""
    return (num_value("mean_unified_loss") + 0.003 * num_value("mean_jump_count") + 0.002 * num_value("mean_trim_count")
            + 0.010 * num_value("mean_off_mask_stitch_length_mm") + 0.002 * num_value("mean_visible_connector_count")
            + 0.5 * F.greatest(F.lit(0.0), min_coverage - num_value("mean_coverage_ratio"))
            + 10.0 * F.greatest(F.lit(0.0), num_value("hard_fail") - max_hard_fail))


def with_grid(df: DataFrame, grid: Sequence[dict[str, float]]) -> DataFrame:
    """Each row once per configuration of a fixed parameter grid; columns config_id and the parameters."""
    configs = F.array(*[F.struct(F.lit(i).alias("config_id"), *[F.lit(float(v)).alias(k) for k, v in g.items()]) for i, g in enumerate(grid)])
    return df.withColumn("_g", F.explode(configs)).select(*df.columns, "_g.*")


# Weights of the robust score of one sweep.
ROBUST_WEIGHTS = {"objective": 0.40, "mean_unified_loss": 0.18, "mean_jump_count": 0.16, "mean_trim_count": 0.06,
                  "mean_off_mask_stitch_length_mm": 0.08, "mean_coverage_ratio": 0.08, "mean_stitch_precision_ratio": 0.04}


def robust_policies(rows: DataFrame, sweep: str, config: Sequence[str], n_sweeps: int, profile: str = "profile",
                    min_coverage: float = 0.90, max_hard_fail: int = 0) -> DataFrame:
    """Configurations feasible in every sweep, scored by mean, worst and range of their per-sweep scores."""
    keys = [profile, *config]
    unique = collapse_duplicates(rows, [sweep, *keys])
    feasible = unique.filter((num_value("hard_fail") <= max_hard_fail) & (num_value("mean_coverage_ratio") >= min_coverage))
    spans = feasible.groupBy(sweep, profile).agg(*[f(num_value(m)).alias(f"{n}_{m}") for m in ROBUST_WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for m, w in ROBUST_WEIGHTS.items():
        score = score + w * minmax_norm(num_value(m), f"lo_{m}", f"hi_{m}", invert=m in MAXIMISE)
    scored = feasible.join(spans, [sweep, profile]).withColumn("_score", score)
    per = scored.groupBy(*keys).agg(
        F.count_distinct(sweep).alias("_n"), F.avg("_score").alias("_mean"), F.max("_score").alias("_worst"), F.min("_score").alias("_best"),
        F.avg("objective").alias("_obj"), F.max("objective").alias("_wobj"), F.avg("mean_jump_count").alias("_jump"),
        F.min("mean_coverage_ratio").alias("_mincov")).filter(F.col("_n") == n_sweeps)
    r8 = lambda c, n: half_even(c, 8).alias(n)
    out = per.select(*keys, r8(0.55 * F.col("_mean") + 0.30 * F.col("_worst") + 0.15 * (F.col("_worst") - F.col("_best")), "robust_score"),
                     r8(F.col("_mean"), "mean_dataset_score"), r8(F.col("_worst"), "worst_dataset_score"),
                     r8(F.col("_obj"), "mean_objective"), r8(F.col("_wobj"), "worst_objective"), r8(F.col("_jump"), "mean_jump_count"),
                     r8(F.col("_mincov"), "min_coverage_ratio"))
    order = [F.col("robust_score"), F.col("mean_objective"), F.col("mean_jump_count"), -F.col("min_coverage_ratio"), *[F.col(c) for c in config]]
    return order_number(out, [profile], order, F.floor(F.col("robust_score") * 1000), "robust_rank")


def robust_picks(robust: DataFrame, config: Sequence[str], profile: str = "profile") -> DataFrame:
    """Best robust score, mean objective, low jump and coverage per profile."""
    cfg = [F.col(c) for c in config]
    orders = {
        "best_robust_score": F.struct("robust_rank"), "best_mean_objective": F.struct("mean_objective", "robust_rank"),
        "best_low_jump": F.struct("mean_jump_count", "mean_objective", "robust_rank"),
        "best_min_coverage": F.struct((-F.col("min_coverage_ratio")).alias("c"), "mean_objective", "robust_rank"),
    }
    wide = robust.groupBy(profile).agg(*[F.min_by(F.struct(*cfg, "robust_rank"), o).alias(n) for n, o in orders.items()])
    long = wide.select(profile, F.explode(F.array(*[F.struct(F.lit(n).alias("recommendation"), F.col(n).alias("r")) for n in orders])).alias("p"))
    return long.select(profile, "p.recommendation", "p.r.*")


def pivot_sweeps(rows: DataFrame, sweep: str, names: Sequence[str], config: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of each configuration side by side, prefixed by sweep."""
    wide = rows.groupBy(*config).pivot(sweep, list(names)).agg(*[F.first(m).alias(m) for m in metrics])
    return wide
