"""Centroid clustering with Orchard search.

Vectors become integers, so that all distances and means are exact. For each centroid the others are listed by their distance from it. A search stands
at a centroid and walks its list: at a closer centroid it goes on with that one's list from the start, passing over what it has visited, and it
stops where a list's next centroid is strictly beyond twice the distance from the vector to the one it stands at. A task searches for all vectors of a
batch at once and sends sums per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLUSTERS, ROUNDS, WIDTH, SEED, SCALE = 8, 10, 64, 3, 1024
#: Integer components are held to this, so that any squared distance of 64 components is a long. No vector with components below 131 072 is changed.
LARGEST = 2**27
_ROWS = 8192


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by squared distance from it, then by number; and all squared distances."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    return np.stack([row[row != i] for i, row in enumerate(order)]), apart


def search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the least number), and the squared distance to it."""
    lists, apart = neighbour_lists(centroids)
    n, many = len(vectors), len(centroids)
    at = np.full(n, int(np.argmin(apart.sum(1))))
    near = ((vectors - centroids[at]) ** 2).sum(1)
    place, visited = np.zeros(n, np.int64), np.zeros((n, many), bool)
    visited[np.arange(n), at] = True
    open_ = np.arange(n if many > 1 else 0)
    while len(open_):
        next_ = lists[at[open_], place[open_]]
        # Within twice the distance, in squares; a centroid at just that distance may be as near, with a smaller number.
        inside = apart[at[open_], next_] <= 4 * near[open_]
        open_, next_ = open_[inside], next_[inside]
        new = ~visited[open_, next_]
        place[open_] += 1
        seen, to = open_[new], next_[new]
        visited[seen, to] = True
        far = ((vectors[seen] - centroids[to]) ** 2).sum(1)
        closer = (far < near[seen]) | ((far == near[seen]) & (to < at[seen]))
        moved = seen[closer]
        at[moved], near[moved], place[moved] = to[closer], far[closer], 0
        open_ = open_[place[open_] < many - 1]
    return at, near


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as double."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(2.0**40)), F.lit(-(2.0**40)))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of `df` (vec_id, embedding; other columns are not read).

    Rows whose embedding is null, has another number of components, or a component that is null or not finite are left out. Each row is a vector for
    itself, also where vec_id or vector repeat. The first centroids are ordered by hash of vec_id, null ids last, then by their components; of fewer
    rows than clusters each gives one. Integer components beyond 2**27 in size count as 2**27. A centroid that no vector is nearest to stays where it
    is. An empty table gives no rows. The centroids are brought to the driver, `clusters` rows of `width` numbers; sums are of decimals."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.coalesce(finite, F.lit(False)))
    kept = scratch.keep(kept.select("vec_id", integers(F.col("embedding")).alias("x")), "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "x").limit(clusters)
    centroids = np.array([r["x"] for r in first.collect()], np.int64).reshape(-1, width)

    def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), width), np.int64), np.zeros(len(centroids), np.int64)
        some = lambda: pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count), pa.int32()), pa.array(count[count > 0]), pa.array(list(total[count > 0]), pa.list_(pa.int64()))], ["cluster", "n", "x"])
        for batch in batches:
            x = _vectors(batch)
            for i in range(0, len(x), _ROWS):
                part = x[i:i + _ROWS]
                at, _ = search(part, centroids)
                # At most 8 192 numbers of at most 2**27 a batch: their sums are exact as doubles, and as long over a partition.
                for k in np.unique(at):
                    total[k] += part[at == k].sum(0)
                count += np.bincount(at, minlength=len(centroids))
            if count.max() > 2**34:
                yield some()
                total[:], count[:] = 0, 0
        if count.any():
            yield some()

    for _ in range(rounds if len(centroids) else 0):
        made = kept.select("x").mapInArrow(lambda b, c=centroids: sums(b, c), "cluster int, n long, x array<bigint>")
        by = made.select("cluster", "n", F.posexplode("x").alias("i", "part")).groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in by.collect():
            centroids[r["cluster"], r["i"]] = int(r["total"]) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            at, near = map(np.concatenate, zip(*(search(x[i:i + _ROWS], centroids) for i in range(0, max(len(x), 1), _ROWS))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(near, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = scratch.keep(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "found")
    by = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    names = [",".join(map(str, c)) for c in centroids.tolist()]
    return found.select("vec_id", "cluster", "distance", of([by.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"),
                        F.lit(sum(by.values())).cast("long").alias("inertia"), F.sha2(of(names).cast("binary"), 256).alias("centroid_sha256"))
