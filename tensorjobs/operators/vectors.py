"""Distances and projections of many vectors: blocked numpy kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a matrix or of centroids that may be broadcast (128 MB of doubles).
BROADCAST_VALUES = 16_000_000


def _bounded(m: np.ndarray) -> np.ndarray:
    if m.size > BROADCAST_VALUES:
        raise ValueError("too large to broadcast: use matmul or pairwise_nearest")
    return m


def by_rows(x: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """f of the rows that are not null, as one matrix; null for the others."""
    some = x.notna().to_numpy()
    rows = iter(f(np.array(x[some].tolist(), float)) if some.any() else ())
    return pd.Series([next(rows) if s else None for s in some], dtype=object)


def orthonormal(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    """A seeded matrix with orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, cols)))[0]


def project(df: DataFrame, features: str, matrix: np.ndarray, out: str = "projected", normalise: bool = True) -> DataFrame:
    """df with features @ matrix, over its norm if that is above 1e-12. Rows with null features give null."""
    m = df.sparkSession.sparkContext.broadcast(_bounded(np.asarray(matrix, float)))

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series) -> pd.Series:
        def f(v: np.ndarray) -> np.ndarray:
            y = v @ m.value
            n = np.linalg.norm(y, axis=1, keepdims=True)
            return np.where(n > 1e-12, y / np.maximum(n, 1e-300), y) if normalise else y

        return by_rows(x, f)

    return df.withColumn(out, kernel(F.col(features)))


def nearest_centroid(df: DataFrame, features: str, centroids: np.ndarray, out: str = "cluster") -> DataFrame:
    """df with the number of the nearest centroid by squared distance (the first of equals) and that distance; null for null features."""
    c = df.sparkSession.sparkContext.broadcast(_bounded(np.asarray(centroids, float)))

    @F.pandas_udf("struct<cluster:int,distance:double>")
    def kernel(x: pd.Series) -> pd.DataFrame:
        some = x.notna().to_numpy()
        cluster, distance = np.full(len(x), None, object), np.full(len(x), None, object)
        if not some.any():
            return pd.DataFrame({"cluster": pd.Series(cluster, dtype="Int32"), "distance": pd.Series(distance, dtype="Float64")})
        v = np.array(x[some].tolist(), float)
        d = ((v[:, None, :] - c.value[None, :, :]) ** 2).sum(2) if len(c.value) * v.size < 50_000_000 else np.stack([((v - k) ** 2).sum(1) for k in c.value], 1)
        cluster[some], distance[some] = d.argmin(1), d.min(1)
        return pd.DataFrame({"cluster": pd.Series(cluster, dtype="Int32"), "distance": pd.Series(distance, dtype="Float64")})

    return df.withColumn("_k", kernel(F.col(features))).withColumns({out: F.col("_k.cluster"), "distance": F.col("_k.distance")}).drop("_k")


def nearest_sql(features: Column, centroids: list[list[float]]) -> Column:
    """The same number as an expression, for few centroids."""
    d = [F.struct(F.aggregate(F.zip_with(features, F.array(*map(F.lit, c)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*d))["k"]


def kmeans_step(df: DataFrame, features: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, dim, center): the mean vector of each cluster."""
    return df.select(cluster, F.posexplode(features).alias("dim", "v")).groupBy(cluster, "dim").agg(F.avg(F.col("v").cast("double")).alias("center"))


def kmeans(df: DataFrame, features: str, k: int, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Lloyd's rounds from k rows chosen by hash; only k centers reach the driver."""
    centers = np.array([r[0] for r in df.select(features).orderBy(F.xxhash64(F.col(features).cast("array<double>"), F.lit(seed))).limit(k).collect()], float)
    for _ in range(rounds):
        new = centers.copy()
        for r in kmeans_step(nearest_centroid(df, features, centers), features).collect():
            new[r["cluster"], r["dim"]] = r["center"]
        if np.allclose(new, centers):
            break
        centers = new
    return centers, nearest_centroid(df, features, centers)


#: Distances that a task holds at once (a few arrays of this size).
TILE = 1_000_000


def pairwise_nearest(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest points of each stated query, by exact blocked products.

    Both have id and v; rows with null ids or vectors take no part. A block of queries meets a block of points once; only k rows a query leave each pair of blocks.
    A task makes TILE distances at a time.
    """
    queries, points = (df.where("id IS NOT NULL AND v IS NOT NULL") for df in (queries, points))
    blocks = lambda df: max(1, -(-df.count() // block))
    nq, npts = blocks(queries), blocks(points)
    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(npts - 1))).alias("pb"), "id", "v")
    p = points.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(npts)).cast("int").alias("pb"), "id", "v")

    def some(x: np.ndarray, y: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        if metric == "euclid":
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        else:
            d = -(x @ y.T)
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
                d = np.where(n > 1e-12, 1 + d / np.maximum(n, 1e-300), 1.0)
        d = np.where(ids[None] == asked[:, None], np.inf, d)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(d, at, 1)
        other = ids[at] != asked[:, None]
        return pd.DataFrame({"query_id": np.repeat(asked, at.shape[1])[other.ravel()], "vec_id": ids[at][other], "distance": found[other]})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            b = b.sort_values("id")
            x, y, ids = np.array(a.v.tolist(), float), np.array(b.v.tolist(), float), b.id.to_numpy()
            step = max(1, TILE // len(y))
            return pd.concat([some(x[lo : lo + step], y, a.id.to_numpy()[lo : lo + step], ids) for lo in range(0, len(x), step)])
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})

    found = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(run, "query_id long, vec_id long, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", F.explode("b").alias("b")).select("query_id", "b.vec_id", "b.distance")
