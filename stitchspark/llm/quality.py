"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each document is a vector of transformed statistics. For each language and source the mean and covariance of the half of its documents that
lie closest together are found by concentration steps (distances, the closest subset, its moments, again); a document is rejected where its
Mahalanobis distance is beyond a quantile of the chi-square distribution. Moments and histograms of distances are aggregates that are combined
before the shuffle, and the Cholesky factor of a covariance is a handful of column expressions on one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, bound, doc_id, doc_key, n_words, whole_text

X = ("x0", "x1", "x2", "x3", "x4")
#: Standard deviations that are added to those of a group, so that a statistic that is the same everywhere rejects nothing by a hair.
FLOORS = (0.5, 0.15, 0.08, 0.10, 0.15)
#: The share of a group's documents that the estimates rest on (at a half, up to half of a group may be junk), concentration steps, and the least group that has estimates of its own.
SUBSET, STEPS, LEAST = 0.5, 4, 100
#: Chi-square quantiles for five statistics: the median, and that which one in a million exceeds.
MEDIAN, CUTOFF = 4.3515, 35.888


def _windows(words: Column) -> Column:
    """Windows of five words as (hash, place), sorted, so that equal ones are neighbours."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.struct(F.xxhash64(F.slice(words, i, 5)).alias("h"), i.alias("i")))
    return F.sort_array(made)


def _covered(windows: Column) -> Column:
    """How many words the windows cover that are found twice or more."""
    same = lambda x, k: F.coalesce(F.get(windows, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
                       lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def statistics(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; `df` has a column body without nulls."""
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    words = F.split(F.btrim(body, F.lit(" \t\n\x0b\f\r")), f"[{SPACE}]+")
    df = (df.withColumn("n_words", n_words(body)).withColumn("word_chars", F.char_length(F.regexp_replace(body, f"[{SPACE}]+", "")).cast("long"))
          .withColumn("n_symbols", F.char_length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"))
          .withColumn("n_dup_lines", bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    repeated = F.when(F.col("n_words") > 5, bound(words, lambda w: bound(_windows(w), _covered)))
    df = df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vectors(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logarithms of lengths, square roots of rates."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rates = [F.sqrt(F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.withColumns(dict(zip(X, [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *rates])))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, from the group's m_i and Cholesky factor l_i_j by forward substitution."""
    z: list[Column] = []
    for i in range(len(X)):
        rest = reduce(lambda a, b: a - b, (F.col(f"l_{i}_{j}") * F.col(f"z_{j}") for j in range(i)), F.col(X[i]) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
        z.append(F.col(f"z_{i}") * F.col(f"z_{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, z)).drop(*(f"z_{i}" for i in range(len(X))))


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factors l_i_j of the covariances c_i_j, one column after the other."""
    for i in range(len(X)):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a - b, (F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.col(f"c_{i}_{j}"))
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return groups.select("group", *(f"m_{i}" for i in range(len(X))), *(f"l_{i}_{j}" for i in range(len(X)) for j in range(i + 1)))


def _bin() -> Column:
    """A sixteenth of a doubling of the distance."""
    return F.floor(F.log2(F.col("d2") + 1e-9) * 16)


def _quantile(rows: DataFrame, share: float, name: str) -> DataFrame:
    """group, name: the first bin of distances up to which a group has this share of its rows. A group has a few hundred bins at most."""
    bins = rows.groupBy("group", _bin().alias("bin")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("group")
    upto = F.sum("n").over(over.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(over))
    return bins.filter(F.col("upto") >= share * F.col("all")).groupBy("group").agg(F.min("bin").alias(name))


def estimates(rows: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """group, m_i, l_i_j, scale: robust centre and scatter of each group; scale makes the median distance that of a normal sample."""
    k = len(X)
    first = rows.groupBy("group").agg(*(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{i}") for i, x in enumerate(X)))
    spread = {f"l_{i}_{i}": F.sqrt(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(k)}
    now = first.select("group", *(F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(k)),
                       *(spread[f"l_{i}_{i}"].alias(f"l_{i}_{i}") if i == j else F.lit(0.0).alias(f"l_{i}_{j}") for i in range(k) for j in range(i + 1)))
    now = scratch.keep(now, "centre-0")
    for step in range(1, steps + 1):
        far = _distance(rows.join(now, "group"))
        held = scratch.keep(_quantile(far, SUBSET, "held"), f"held-{step}")
        near = far.join(held, "group").filter(_bin() <= F.col("held"))
        sums = near.groupBy("group").agg(F.count("*").alias("n"), *(F.avg(X[i]).alias(f"m_{i}") for i in range(k)),
                                         *(F.covar_pop(X[i], X[j]).alias(f"v_{i}_{j}") for i in range(k) for j in range(i + 1)))
        sums = sums.withColumns({f"c_{i}_{j}": F.col(f"v_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(k) for j in range(i + 1)})
        now = scratch.keep(_factor(sums), f"centre-{step}")
    middle = _quantile(_distance(rows.join(now, "group")), 0.5, "middle")
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("middle") + 1) / 16) / MEDIAN, F.lit(1.0))
    return scratch.keep(now.join(middle.withColumn("scale", scale).drop("middle"), "group"), "estimates")


def quality(df: DataFrame) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, distance, kept and text_hash for each row of `df` (doc_id, text, lang, source).

    A null text has no words and fails the base rules. A null lang or source is a value of its own. Groups of fewer than LEAST documents are estimated
    together. Repeated rows count and are returned each for itself. An empty table gives no rows."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(doc_key().alias("key"), F.to_json(F.struct("lang", "source")).alias("own"), whole_text().alias("body"))
    rows = vectors(statistics(rows).withColumn("text_hash", F.xxhash64("body")).drop("body"))
    rows = scratch.keep(rows, "statistics")
    sizes = scratch.keep(rows.filter("not base_failed").groupBy("own").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST), "sizes")
    rows = rows.join(sizes, "own", "left").withColumn("group", F.when(F.col("n").isNotNull(), F.col("own")).otherwise("rest")).drop("n", "own")
    found = estimates(rows.filter("not base_failed"), scratch)
    far = _distance(rows.join(found, "group", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") / F.col("scale") <= CUTOFF, F.lit(True))
    return far.select(doc_id("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.sqrt(F.col("d2") / F.col("scale")).alias("distance"), kept.alias("kept"), "key", "text_hash")


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of `df` that the rules keep."""
    gone = quality(df).filter(~F.col("kept")).select(F.col("key").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    key = F.coalesce(df["doc_id"].cast("long"), F.lit(2**63 - 1))
    return df.join(gone, (key == gone["_gone"]) & (F.xxhash64(F.coalesce(df["text"], F.lit(""))) == gone["_hash"]), "left_anti")
