"""Linear rankers from distributed moments, and their held-out validation.

Fitting needs only sums of products.  They are formed per Arrow batch in the tasks and added up by Spark; what
reaches the driver is one square matrix over the features, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import half_even, num_value
from ..functions.tables import Rounds

MAX_FEATURES = 512


def feature_columns(numeric: Sequence[str], categorical: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Numeric columns and one indicator per category, in sorted order."""
    out = {n: num_value(n) for n in numeric}
    for name, values in categorical.items():
        for v in sorted(values):
            out[f"{name}={v}"] = (F.coalesce(F.col(name).cast("string"), F.lit("")) == v).cast("double")
    return out


def categories(df: DataFrame, names: Sequence[str], limit: int = 200) -> dict[str, list[str]]:
    """Sorted categories of each column; more than ``limit`` is refused before anything is collected."""
    found = {}
    for n in names:
        values = df.select(F.coalesce(F.col(n).cast("string"), F.lit("")).alias("v")).distinct().limit(limit + 1).collect()
        if len(values) > limit:
            raise ValueError(f"{n} has more than {limit} categories")
        found[n] = sorted(v["v"] for v in values)
    return found


def moments(df: DataFrame, columns: Sequence[str], fold: str | None = None, weight: str | None = None) -> DataFrame:
    """Sums of products of [1, columns...] per fold: rows (fold, i, j, v) with i <= j."""
    return _moments(df, columns, fold, weight).drop("plain")


def _moments(df: DataFrame, columns: Sequence[str], fold: str | None, weight: str | None) -> DataFrame:
    """:func:`moments` with, for ``weight``, the sums without it in the column ``plain``."""
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"{len(columns)} columns: at most {MAX_FEATURES}")
    cols = [*columns]
    slim = df.select((F.col(fold) if fold else F.lit("")).cast("string").alias("fold"), *[F.col(c).cast("double").alias(c) for c in cols],
                     *([F.col(weight).cast("double").alias("_w")] if weight else []))
    d = len(cols) + 1
    upper_i, upper_j = np.triu_indices(d)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 2_000_000 // (d * d))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step].sort_values("fold", kind="stable")
                z = np.column_stack([np.ones(len(part)), part[cols].to_numpy(dtype=float)])
                folds, starts = np.unique(part["fold"].to_numpy(dtype=str), return_index=True)
                outer = z[:, upper_i] * z[:, upper_j]
                plain = np.add.reduceat(outer, starts, axis=0)
                sums = np.add.reduceat(outer * part["_w"].to_numpy()[:, None], starts, axis=0) if weight else plain
                n = len(upper_i)
                yield pd.DataFrame({"fold": np.repeat(folds, n), "i": np.tile(upper_i, len(folds)).astype("int32"),
                                    "j": np.tile(upper_j, len(folds)).astype("int32"), "v": sums.ravel(), "plain": plain.ravel()})

    return slim.mapInPandas(partial, "fold string, i int, j int, v double, plain double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"), F.sum("plain").alias("plain"))


def total_matrix(m: DataFrame, d: int) -> np.ndarray:
    """The symmetric matrix over all folds (d x d values)."""
    out = np.zeros((d, d))
    for row in m.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def standardise(g: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the first p columns (deviations below 1e-8 become 1)."""
    n = max(1.0, g[0, 0])
    mean = g[0, 1:p + 1] / n
    var = np.maximum(0.0, np.diag(g)[1:p + 1] / n - mean ** 2)
    std = np.sqrt(var)
    return mean, np.where(std < 1e-8, 1.0, std)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


def ridge_from_moments(g: np.ndarray, p: int, alpha: float) -> dict:
    """Ridge weights [intercept, features...] on standardised features; the intercept is not penalised."""
    n = g[0, 0]
    mean, std = standardise(g, p)
    xx = (g[1:p + 1, 1:p + 1] - n * np.outer(mean, mean)) / np.outer(std, std)
    xy = (g[1:p + 1, p + 1] - mean * g[0, p + 1]) / std
    w = _solve(xx + alpha * np.eye(p), xy)
    return {"mean": mean, "std": std, "weights": np.concatenate([[g[0, p + 1] / max(1.0, n)], w])}


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> dict:
    g = total_matrix(moments(df, [*features, target]), len(features) + 2)
    return {**ridge_from_moments(g, len(features), alpha), "features": list(features)}


def linear_score(model: dict, clip: float | None = None, intercept: bool = True) -> Column:
    """Score of a stored linear model as a column."""
    w = list(model["weights"])
    total = F.lit(float(w[0])) if intercept else F.lit(0.0)
    rest = w[1:] if intercept else w
    for name, m, s, c in zip(model["features"], model["mean"], model["std"], rest):
        z = (num_value(name) - float(m)) / float(s if s >= 1e-8 else 1.0)
        if clip is not None:
            z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
        total = total + z * float(c)
    return total


def shrink_to_method(df: DataFrame, score: str, target: str, method: str, shrinkage: float) -> DataFrame:
    """Blend of the score and the mean target of its method."""
    means = df.groupBy(method).agg(F.avg(target).alias("_mm"))
    return df.join(means, method).withColumn(score, (1.0 - shrinkage) * F.col(score) + shrinkage * F.col("_mm")).drop("_mm")


def fold_ridge_models(df: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """One ridge model per held-out fold: moments of all folds minus those of the fold, solved in the tasks."""
    p = len(features)
    m = moments(df, [*features, target], fold)
    total = total_matrix(m, p + 2)
    packed = m.groupBy("fold").agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fold_id, cells in zip(batch["fold"], batch["cells"]):
                g = total.copy()
                for c in cells:
                    g[c["i"], c["j"]] -= c["v"]
                    if c["i"] != c["j"]:
                        g[c["j"], c["i"]] -= c["v"]
                f = ridge_from_moments(g, p, alpha)
                rows.append((fold_id, f["mean"].tolist(), f["std"].tolist(), f["weights"].tolist()))
            yield pd.DataFrame(rows, columns=["fold", "mean", "std", "weights"])

    return packed.mapInPandas(solve, "fold string, mean array<double>, std array<double>, weights array<double>")


def held_out_predictions(df: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Prediction of each row by the model that has not seen its fold."""
    models = fold_ridge_models(df, features, target, fold, alpha).withColumnRenamed("fold", "_fold")
    x = F.array(*[num_value(f) for f in features])
    z = F.transform(F.arrays_zip(x.alias("x"), F.col("mean").alias("m"), F.col("std").alias("s"), F.slice("weights", 2, len(features)).alias("w")),
                    lambda e: (e["x"] - e["m"]) / e["s"] * e["w"])
    pred = F.aggregate(z, F.get("weights", F.lit(0)), lambda a, v: a + v)
    return df.withColumn("_fold", F.col(fold).cast("string")).join(models, "_fold").withColumn("prediction", pred).drop(
        "_fold", "mean", "std", "weights")


def fit_ridge_classifier(df: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], alpha: float = 1.0,
                         weight: str | None = None, balance: bool = True, reject_weight: float = 1.0) -> dict:
    """Weighted one-vs-all ridge on standardised features without intercept."""
    p = len(features)
    # Weights of a class and indicators are the same for all its rows: sums per label, of one pass, give the counts and both matrices.
    plain, own = ({n: np.zeros((p + 1, p + 1)) for n in labels} for _ in range(2))
    for r in _moments(df.filter(F.col(label).isin(*labels)), features, label, weight).collect():
        for held, v in ((plain, r["plain"]), (own, r["v"])):
            held[r["fold"]][r["i"], r["j"]] = held[r["fold"]][r["j"], r["i"]] = v
    total = sum(m[0, 0] for m in plain.values())
    factor = {n: (np.sqrt(total / max(1.0, m[0, 0])) if balance else 1.0) * (reject_weight if n == "reject" else 1.0) for n, m in plain.items()}
    mean, std = standardise(sum(plain.values()), p)
    classes = [factor[n] * own[n] for n in labels]
    g = np.hstack([sum(classes), np.column_stack([m[0] for m in classes])])
    s1, sy = g[0, 1:p + 1], g[0, p + 1:]
    xx = g[1:p + 1, 1:p + 1] - np.outer(mean, s1) - np.outer(s1, mean) + g[0, 0] * np.outer(mean, mean)
    xy = g[1:p + 1, p + 1:] - np.outer(mean, sy)
    coef = _solve(xx / np.outer(std, std) + alpha * np.eye(p), xy / std[:, None])
    return {"features": list(features), "labels": list(labels), "mean": mean, "std": std, "coef": coef}


def classifier_scores(model: dict) -> dict[str, Column]:
    """score_<label> columns of a classifier, rounded to 8 digits."""
    out = {}
    for k, name in enumerate(model["labels"]):
        one = {"features": model["features"], "mean": model["mean"], "std": model["std"], "weights": model["coef"][:, k]}
        out[f"score_{name}"] = F.rint(linear_score(one, intercept=False) * 1e8) / 1e8
    return out


def fit_pairwise_ridge(df: DataFrame, features: Sequence[str], score: str, group: str, alpha: float = 1.0) -> dict:
    """Ridge on all within-group differences, from group sums: sum of dd' over pairs = n * sum xx' - (sum x)(sum x)'."""
    p = len(features)
    m = moments(df, [*features, score], group)
    mean, std = standardise(total_matrix(m, p + 2), p)
    packed = m.groupBy("fold").agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))

    def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + 2, p + 2))
        for batch in batches:
            for cells in batch["cells"]:
                g = np.zeros((p + 2, p + 2))
                for c in cells:
                    g[c["i"], c["j"]] = g[c["j"], c["i"]] = c["v"]
                total += g[0, 0] * g - np.outer(g[0], g[0])
        i, j = np.triu_indices(p + 2)
        yield pd.DataFrame({"fold": "", "i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    g = 2.0 * total_matrix(packed.mapInPandas(pair_sums, "fold string, i int, j int, v double"), p + 2)
    xx = g[1:p + 1, 1:p + 1] / np.outer(std, std)
    xy = g[1:p + 1, p + 1] / std
    return {"features": list(features), "mean": mean, "std": std, "weights": _solve(xx + alpha * np.eye(p), xy)}


def decision_differences(rows: DataFrame, features: Sequence[str], key: str = "decision_id", label: str = "label") -> DataFrame:
    """Standardised positive minus negative features, one row per negative of a decision with one positive."""
    stats = rows.agg(*[c for f in features for c in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    z = {f: (num_value(f) - float(stats[f"m_{f}"] or 0.0)) / float(stats[f"s_{f}"] if (stats[f"s_{f}"] or 0.0) >= 1e-8 else 1.0) for f in features}
    scaled = rows.select(key, label, *[c.alias(f) for f, c in z.items()])
    # The rows of a decision, which its generators bound, are one window; its one positive is the greatest of one value.
    w, pos = Window.partitionBy(key), F.col(label) == 1
    met = scaled.withColumns({"_n": F.count_if(pos).over(w), **{f"p_{f}": F.max(F.when(pos, F.col(f))).over(w) for f in features}})
    return met.filter((F.col("_n") == 1) & (F.col(label) == 0)).select(key, *[(F.col(f"p_{f}") - F.col(f)).alias(f) for f in features])


def fit_pairwise_logistic(diffs: DataFrame, features: Sequence[str], weight_decay: float = 0.001, max_iter: int = 50) -> np.ndarray:
    """Weights that make positive differences score above 0 (mirrored pairs, no intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    mirrored = diffs.withColumn("label", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).select("label", *[F.when(F.col("label") == 1.0, F.col(f)).otherwise(-F.col(f)).alias(f) for f in features])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(mirrored)
    lr = LogisticRegression(fitIntercept=False, standardization=False, regParam=weight_decay, elasticNetParam=0.0, maxIter=max_iter)
    return np.asarray(lr.fit(data).coefficients.toArray())


def decision_ranks(rows: DataFrame, utility: str, key: str = "decision_id", label: str = "label", node: str = "node_id") -> DataFrame:
    """Rank of the positive of each decision: one more than the rows that beat it."""
    w, pos = Window.partitionBy(key), F.col(label) == 1
    held = rows.withColumns({"_n": F.count_if(pos).over(w), "_pu": F.max(F.when(pos, F.col(utility))).over(w), "_node": F.max(F.when(pos, F.col(node))).over(w)})
    ahead = (F.col(utility) > F.col("_pu")) | ((F.col(utility) == F.col("_pu")) & (F.col(node) < F.col("_node")))
    return held.filter("_n = 1").groupBy(key).agg(
        F.first("_node").alias("oracle_node"), (F.count_if(ahead) + 1).alias("oracle_rank"), F.count(F.lit(1)).alias("candidate_count"))


def rank_quality(ranks: DataFrame) -> DataFrame:
    r = F.col("oracle_rank")
    return ranks.agg(F.count(F.lit(1)).alias("decision_count"), F.avg((r == 1).cast("double")).alias("accuracy"),
                     F.avg((r <= 3).cast("double")).alias("top3_accuracy"), F.avg(r).alias("mean_oracle_rank"))


def pack_groups(df: DataFrame, features: Sequence[str], group: str, mean: np.ndarray, std: np.ndarray, *extra: Column) -> DataFrame:
    """One row per group: ``x``, the standardised features of its rows one after the other, and an array for each column of ``extra``.

    A group is the candidates of one sample, which its generators bound."""
    z = F.array(*[(num_value(f) - float(mean[k])) / float(std[k]) for k, f in enumerate(features)])
    rows = df.select(F.col(group).alias("_g"), F.struct(z.alias("z"), *[e.alias(f"e{k}") for k, e in enumerate(extra)]).alias("r"))
    packed = rows.groupBy("_g").agg(F.collect_list("r").alias("r"))
    return packed.select(F.flatten("r.z").alias("x"), *[F.col(f"r.e{k}").alias(f"e{k}") for k in range(len(extra))])


def _softmax_terms(w: np.ndarray, temperature: float):
    """A batch of packed groups to what it adds to loss, gradient and curvature of the cross-entropy: rows (i, v) of one long vector."""
    p = len(w)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("e0")), np.int64)
            if not len(size):
                continue
            z, t = (np.asarray(batch.column(c).flatten(), float) for c in ("x", "e0"))
            z, first = z.reshape(-1, p), np.cumsum(size) - size
            each = lambda v: np.repeat(v, size, axis=0)
            logs = lambda v: (v := v - each(np.maximum.reduceat(v, first))) - each(np.log(np.add.reduceat(np.exp(v), first)))
            teacher, mine = np.exp(logs(t)), logs(-(z @ w) / temperature)
            likely = np.exp(mine)
            middle = np.add.reduceat(likely[:, None] * z, first)
            total += np.concatenate([[-(teacher * mine).sum()], z.T @ (teacher - likely) / temperature, ((z.T * likely) @ z - middle.T @ middle).ravel() / temperature**2])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    return terms


def fit_listwise(df: DataFrame, features: Sequence[str], teacher: str, group: str = "sample_id", temperature: float = 0.02,
                 alpha: float = 1.0, max_steps: int = 1200, tolerance: float = 1e-8) -> dict:
    """Softmax ranker (low scores win): the weights that minimise the mean cross-entropy between the group softmax of -teacher / temperature and that of
    -score / temperature, plus alpha / 2 times their square.

    The objective is convex. Damped Newton steps go on until the gradient's norm is below ``tolerance``; ``converged`` says whether it came to that within
    ``max_steps``. Groups are packed into arrays once; a step is one pass over them, of which a vector over the features reaches the driver."""
    p = len(features)
    mean, std = standardise(total_matrix(moments(df, features), p + 1), p)
    rounds = Rounds(df.sparkSession)
    packed = rounds.keep(pack_groups(df, features, group, mean, std, -F.col(teacher).cast("double") / temperature), "groups")
    groups = max(1, packed.count())

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rows = packed.mapInArrow(_softmax_terms(w, temperature), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(1 + p + p * p)
        for r in rows:
            v[r["i"]] = r["v"] / groups
        return v[0] + alpha / 2 * w @ w, v[1:p + 1] + alpha * w, v[p + 1:].reshape(p, p) + alpha * np.eye(p)

    w, steps = np.zeros(p), 0
    loss, gradient, curve = at(w)
    while np.linalg.norm(gradient) > tolerance and steps < max_steps:
        step, share = np.linalg.solve(curve + 1e-12 * np.eye(p), gradient), 1.0
        while True:
            new = at(w - share * step)
            steps += 1
            if new[0] <= loss - 1e-4 * share * gradient @ step or np.linalg.norm(new[1]) < np.linalg.norm(gradient) or share < 1e-6:
                break
            share /= 2
        w, (loss, gradient, curve) = w - share * step, new
    rounds.drop("groups")
    norm = float(np.linalg.norm(gradient))
    return {"features": list(features), "mean": mean, "std": std, "weights": w, "gradient_norm": norm, "steps": steps, "objective": float(loss), "converged": norm <= tolerance}


def fit_preset_classifier(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.01):
    """Multinomial classifier over sample features as a pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(features), outputCol="_x"),
        StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_label", regParam=reg, maxIter=30),
    ]).fit(df)


def _bounded(rows: DataFrame, limit: int) -> list:
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} alternatives")
    return got


def leave_one_out_best(values: DataFrame, sample: str, option: str, value: str, limit: int = 2000) -> DataFrame:
    """For each sample, the option with the lowest mean over all other samples, and its own value.

    ``values``: one row per (sample, option).  Options are a fixed list (methods, grid configurations); their
    totals are read once, and the exclusion of a sample is a subtraction.
    """
    totals = _bounded(values.groupBy(option).agg(F.sum(value).alias("s"), F.count(value).alias("n")).orderBy(option), limit)
    own = values.groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct(F.col(option), F.col(value)))).alias("own"))
    entries = []
    for k, t in enumerate(totals):
        mine = F.try_element_at("own", F.lit(t[option]))
        n = F.lit(float(t["n"])) - mine.isNotNull().cast("double")
        # Means that differ by less than the order of summation can cause are ties; the first option wins.
        mean = half_even((F.lit(float(t["s"])) - F.coalesce(mine, F.lit(0.0))) / F.when(n > 0, n), 10)
        entries.append(F.struct(F.coalesce(mean, F.lit(float("inf"))).alias("m"), F.lit(k).alias("k"), F.lit(t[option]).alias("o"), mine.alias("v")))
    best = F.array_min(F.array(*entries))
    return own.select(sample, best["o"].alias("train_best"), best["m"].alias("train_mean"), best["v"].alias("held_value"))


def selection_baselines(values: DataFrame, sample: str, option: str, value: str, fixed: str) -> DataFrame:
    """Mean value of a fixed option, of the oracle and of the train-best option."""
    oracle = values.groupBy(sample).agg(F.min(value).alias("o"), F.max(F.when(F.col(option) == fixed, F.col(value))).alias("f"))
    loo = leave_one_out_best(values, sample, option, value)
    j = oracle.join(loo, sample)
    return j.agg(F.count(F.lit(1)).alias("samples"), F.avg("o").alias("oracle_mean"), F.avg("f").alias("fixed_mean"), F.avg("held_value").alias("train_best_mean"))


def phase_split(df: DataFrame, phase: str = "phase", train: str = "core", test: str = "full") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(phase) == train), df.filter(F.col(phase) == test)
