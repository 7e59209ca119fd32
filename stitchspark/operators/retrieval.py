"""Feature retrieval: nearest items and blended priors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import planner_prior

FEATURES = ("area_ratio", "bbox_aspect", "density_mean", "centerline_ratio", "boundary_ratio", "running_ratio", "satin_ratio", "fill_ratio")


def feature_distance(own: Column, query: Column, scales: Sequence[float]) -> Column:
    """Root mean square difference of two arrays of features, over the features that both have."""
    parts = F.zip_with(F.zip_with(query, own, lambda q, v: q - v), F.array(*[F.lit(float(x)) for x in scales]), lambda d, x: (d / x) * (d / x))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("used"))
    add = lambda a, d: F.struct((a["total"] + F.coalesce(d, F.lit(0.0))).alias("total"), (a["used"] + d.isNotNull().cast("int")).alias("used"))
    return F.aggregate(parts, start, add, lambda a: F.sqrt(a["total"] / F.greatest(F.lit(1), a["used"])))


def knn(index: DataFrame, queries: Sequence[Mapping], k: int = 5, id_col: str = "id", features: Sequence[str] = FEATURES,
        scales: Mapping[str, float] | None = None, batch: int = 64) -> DataFrame:
    """The k nearest index items of each query.

    Queries are a driver-side list and are taken in batches of a fixed size; each batch is one scan of the index
    whose tasks keep k rows per query before the shuffle.
    """
    scales = scales if scales is not None else {"bbox_aspect": 2.0}

    own = index.select(F.col(id_col), F.array(*[F.col(f).cast("double") for f in features]).alias("_own"))

    def one(part: Sequence[Mapping]) -> DataFrame:
        asked = F.array(*[F.struct(F.lit(q["query_id"]).alias("query_id"), F.array(*[F.lit(q.get(f)).cast("double") for f in features]).alias("v")) for q in part])
        far = lambda q: F.struct(q["query_id"].alias("query_id"), feature_distance(F.col("_own"), q["v"], [scales.get(f, 1.0) for f in features]).alias("distance"))
        wide = own.withColumn("_h", F.explode(F.transform(asked, far))).select(F.col("_h.query_id").alias("query_id"), F.col(id_col), F.col("_h.distance").alias("distance"))
        w = W.partitionBy("query_id").orderBy("distance", id_col)
        return wide.withColumn("match_no", F.row_number().over(w).cast("long")).filter(F.col("match_no") <= k)

    parts = [queries[at:at + batch] for at in range(0, len(queries), batch)]
    return reduce(DataFrame.unionByName, [one(p) for p in parts])


def prototypes(items: DataFrame, label: str, features: Sequence[str], limit: int = 1000) -> list[dict]:
    """Mean features per label as queries; more labels than ``limit`` are refused before they are read."""
    means = items.groupBy(label).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).orderBy(label)
    rows = means.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return [{"query_id": r[label], **{f: r[f] for f in features}} for r in rows]


def without_self(matches_index: DataFrame, sample: str, id_col: str = "id", source_col: str = "source") -> DataFrame:
    """Leave the sample's own items out of an index (id or source contains it)."""
    hit = F.coalesce(F.col(id_col).cast("string"), F.lit("")).contains(sample) | F.coalesce(F.col(source_col), F.lit("")).contains(sample)
    return matches_index.filter(~hit)


def blend_priors(matches: DataFrame, kinds: Mapping[str, str], key: str = "query_id") -> DataFrame:
    """Majority of booleans (a tie is true), rounded mean of integers, mean of doubles."""
    def mix(name: str, kind: str) -> Column:
        if kind == "bool":
            return (F.avg(F.col(name).cast("double")) >= 0.5).alias(name)
        return (F.rint(F.avg(name)).cast("int") if kind == "int" else F.avg(name)).alias(name)
    return matches.groupBy(key).agg(*[mix(n, k) for n, k in kinds.items()])


def weighted_blend(own: Column, retrieved: Column, weight: float) -> Column:
    return (1.0 - weight) * own + weight * retrieved


def build_index(features: DataFrame, id_col: str = "design_id") -> DataFrame:
    """Index rows: features and the rule-table prior."""
    return features.select(F.col(id_col).alias("id"), *[F.col(f) for f in FEATURES if f in features.columns], planner_prior(
        nodes="path_graph_nodes" if "path_graph_nodes" in features.columns else F.lit(0),
        long_ratio="long_jump_ratio" if "long_jump_ratio" in features.columns else F.lit(0.0)).alias("planner_prior"))


def random_prior(index: DataFrame, k: int, seed: int = 7, id_col: str = "id") -> DataFrame:
    """A seeded sample of k index items (control)."""
    return index.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(k)
