"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; a hash is
the pair of signed axes nearest to the result, so a table of 64 components has 8,128 buckets. Every vector is in one
bucket of each of `tables` tables. A query probes the buckets whose two axes lie nearest to it, over all tables together:
a share of the buckets that falls with the fourth root of the number of vectors, as nearest neighbours come closer.

Buckets are dealt to slices of about `block` vectors, so their number grows with the table; a slice that near copies
overfill is cut in parts by a hash of the id, on the side of the vectors and on that of the queries. In a slice each
probed bucket is one matrix product, and only the best of each query leave it. Scores are then exact: cosine in
double precision, summed for each pair in the same order wherever it is computed.

Equal vectors are searched once: of these only the k + 1 smallest ids can be among the k nearest of anything, as all
have the same score.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without id; components of any finite size count (vectors are scaled by a power of two); vectors only meet
those of their own length; ties go to the smaller id; rows that repeat an id count once (any one of them if their vectors
differ); a query with fewer than k neighbours found looks into every bucket of one table, which is an exhaustive search;
columns other than the two asked for are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ragged, table

TABLES, NEAREST = 12, 5
#: Share of the buckets that a query probes among AT vectors.
SHARE, AT = 0.016, 20_000
#: Axes of a table that a query's pairs are made of, at most.
AXES = 96
#: Vectors in a slice, on average; OVERFULL times as many are cut in parts.
BLOCK, OVERFULL = 8_000, 4
SEED = 20


def signs(dim: int, t: int, seed: int = SEED) -> np.ndarray:
    """Three rounds of random signs of table t, for vectors padded to `dim` (a power of two)."""
    return np.where(np.random.default_rng([seed, t, dim]).random((3, dim)) < 0.5, -1.0, 1.0)


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of each row: D H D H D H x, each H in n log n."""
    n, dim = x.shape
    for row in flips:
        x = x * row
        h = 1
        while h < dim:
            x = x.reshape(n, dim // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, dim)
            h *= 2
    return x / dim**1.5


def scaled(vectors: pd.Series) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and squares neither overflow nor vanish."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def padded(x: np.ndarray) -> np.ndarray:
    """Unit rows of `scaled` ones, padded with zeros to a power of two."""
    out = np.zeros((len(x), 1 << max(0, x.shape[1] - 1).bit_length()))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def axes_of(x: np.ndarray, t: int) -> np.ndarray:
    """How near each signed axis of table t is to each padded row."""
    y = rotate(x, signs(x.shape[1], t))
    return np.concatenate([y, -y], axis=1)


def bucket_of(a: np.ndarray, b: np.ndarray, axes: int) -> np.ndarray:
    """The number of a pair of axes, in either order."""
    return np.minimum(a, b) * axes + np.maximum(a, b)


def probes(n: int, dim: int, tables: int, share: float) -> int:
    """Buckets that a query probes among n vectors; lengths over 128 count as 128, of which a query's AXES nearest axes tell enough."""
    axes = min(2 * dim, 256)
    return max(1, round(tables * axes * (axes - 1) / 2 * min(1.0, share * (AT / max(n, 1)) ** 0.25)))


def _hashed(groups: DataFrame, tables: int, slices: dict[int, int]) -> DataFrame:
    """(dim, t, slice, bucket, g, v): the bucket of each vector in each table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                x = padded(scaled(part.v))
                for t in range(tables):
                    both = axes_of(x, t)
                    top = np.argpartition(-both, 1, axis=1)[:, :2]
                    bucket = bucket_of(top[:, 0], top[:, 1], both.shape[1])
                    yield pd.DataFrame({"dim": np.int32(dim), "t": np.int32(t), "slice": (bucket * 31 + t) % slices[dim], "bucket": bucket, "g": part.g.to_numpy(), "v": part.v.to_numpy()})

    return groups.select("dim", "g", "v").mapInPandas(run, "dim int, t int, slice long, bucket long, g long, v array<double>")


def _asked(queries: DataFrame, tables: int, slices: dict[int, int], sizes: dict[int, int], share: float) -> DataFrame:
    """(dim, t, slice, buckets, g, v): the buckets that each query probes in each slice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                x = padded(scaled(part.v))
                n_probes = probes(sizes[dim], x.shape[1], tables, share)
                near = np.stack([axes_of(x, t) for t in range(tables)], axis=1)
                axes = near.shape[2]
                some = min(axes, AXES)
                one, two = np.triu_indices(some, 1)
                out = []
                for g, v, of in zip(part.g.tolist(), part.v, near, strict=True):
                    top = np.argpartition(-of, some - 1, axis=1)[:, :some]
                    value = np.take_along_axis(of, top, axis=1)
                    sums = (value[:, one] + value[:, two]).ravel()
                    best = np.argpartition(-sums, min(n_probes, len(sums)) - 1)[:n_probes]
                    t, pair = np.divmod(best, len(one))
                    bucket = bucket_of(top[t, one[pair]], top[t, two[pair]], axes)
                    where = np.stack([t, (bucket * 31 + t) % slices[dim]], axis=1)
                    order = np.lexsort((where[:, 1], where[:, 0]))
                    where, bucket = where[order], bucket[order]
                    starts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1)))
                    out += [(dim, a, b, c, g, v) for (a, b), c in zip(where[starts].tolist(), np.split(bucket, starts[1:]), strict=True)]
                yield pd.DataFrame(out, columns=["dim", "t", "slice", "buckets", "g", "v"])

    return queries.select("dim", "g", "v").mapInPandas(run, "dim int, t int, slice long, buckets array<long>, g long, v array<double>")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of the rows of q with those of x; each pair is summed alone, so equal pairs have equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _best(asked: DataFrame, hashed: DataFrame, k: int, block: int) -> DataFrame:
    """(q, g, score): for each query the k best of each slice it looks into; buckets null: of all its buckets."""
    place = ["dim", "t", "slice"]
    many = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias(name)).where(F.col(name) > OVERFULL)
    parts, shifts = many(hashed, "parts"), many(asked, "shifts")
    both = lambda df: df.join(parts, place, "left").join(shifts, place, "left").na.fill(1, ["parts", "shifts"])
    own = lambda n: F.pmod(F.xxhash64("g"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = both(hashed).select(*place, own("parts").alias("part"), all_of("shifts").alias("shift"), "bucket", "g", "v")
    asked = both(asked).select(*place, all_of("parts").alias("part"), own("shifts").alias("shift"), "buckets", "g", "v")
    keys = [*place, "part", "shift"]

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series([], dtype="int64"), "g": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if q.empty or x.empty:
            return none
        x = x.sort_values("bucket")
        ids, xs, qs = x.g.to_numpy(), scaled(x.v), scaled(q.v)
        unit, of = xs / np.linalg.norm(xs, axis=1, keepdims=True), qs / np.linalg.norm(qs, axis=1, keepdims=True)
        kinds, first, count = np.unique(x.bucket.to_numpy(), return_index=True, return_counts=True)
        asked_in = [np.arange(len(kinds)) if b is None else np.flatnonzero(np.isin(kinds, b, assume_unique=True)) for b in q.buckets]
        who, which = np.repeat(np.arange(len(q)), [len(b) for b in asked_in]), np.concatenate(asked_in)
        order = np.argsort(which, kind="stable")
        who, which = who[order], which[order]
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bounds = np.flatnonzero(np.append(which[1:] != which[:-1], True)) + 1 if len(which) else np.zeros(0, int)
        for lo, hi in zip(np.append(0, bounds[:-1]).tolist(), bounds.tolist(), strict=True):
            a, n = int(first[which[lo]]), int(count[which[lo]])
            for at in range(lo, hi, 256):
                mine = who[at : min(at + 256, hi)]
                near = of[mine] @ unit[a : a + n].T
                if n > k + 1:
                    least = np.partition(near, n - k - 1, axis=1)[:, n - k - 1, None]
                    i, j = np.nonzero(near >= least - 1e-9)
                else:
                    i, j = np.divmod(np.arange(near.size), n)
                pairs.append((mine[i], a + j, near[i, j]))
        if not pairs:
            return none
        i, j, near = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.lexsort((-near, i))
        i, j, near = i[order], j[order], near[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        size = np.diff(np.append(starts, len(i)))
        least = np.repeat(near[starts + np.minimum(size, k + 1) - 1], size)  # of the k + 1 best, then exactly
        keep = near >= least - 1e-9
        i, j = i[keep], j[keep]
        score = cosines(qs[i], xs[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        size = np.diff(np.append(starts, len(i)))
        top = ragged(starts, np.minimum(size, k))
        return pd.DataFrame({"q": q.g.to_numpy()[i[top]], "g": ids[j[top]], "score": score[top]})

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, "q long, g long, score double")


def usable(vectors: DataFrame, vec_id: Column, vector: Column) -> DataFrame:
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(vec_id.cast("long").alias("vec_id"), F.size(v).alias("dim"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _top(df: DataFrame, by: str, what: str, k: int) -> DataFrame:
    """The k rows of largest score for each `by`, ties to the smaller `what`; tasks cut theirs before the shuffle."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), what))).where(F.col("r") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, tables: int = TABLES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest. vectors: `usable` rows; is_query: a condition on them."""
    vectors = vectors.dropDuplicates(["vec_id"])
    some = vectors.withColumn("r", F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    groups = cut(some.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("g", F.get("ids", F.lit(0))), "vectors")
    queries = cut(vectors.where(is_query).select("vec_id", "dim", "v").join(groups.select("dim", "v", "g"), ["dim", "v"]).select("vec_id", "g"), "queries")
    distinct = groups.join(queries.select("g").distinct(), "g", "left_semi")
    sizes = {r["dim"]: r["count"] for r in groups.groupBy("dim").count().collect()}  # a row per length of vectors
    slices = {d: -(-n // block) for d, n in sizes.items()}
    hashed = _hashed(groups, tables, slices)
    found = cut(_best(_asked(distinct, tables, slices, sizes, share), hashed, k + 1, block).groupBy("q", "g").agg(F.max("score").alias("score")), "found")
    lacking = found.groupBy("q").count().where(F.col("count") > k).select(F.col("q").alias("g"))
    each = F.expr("CASE dim " + " ".join(f"WHEN {d} THEN {n}" for d, n in slices.items()) + " END") if slices else F.lit(1)
    few = distinct.join(lacking, "g", "left_anti").select("dim", F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), each.cast("long") - 1)).alias("slice"), F.lit(None).cast("array<long>").alias("buckets"), "g", "v")
    rest = _best(few, _hashed(groups, 1, slices), k + 1, block)
    best = _top(found.unionByName(rest).groupBy("q", "g").agg(F.max("score").alias("score")), "q", "g", k + 1)
    ids = best.join(groups.select("g", "ids"), "g").select("q", F.explode("ids").alias("vec_id"), "score")
    lists = _top(ids, "q", "vec_id", k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))  # k + 1 of them
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("g").alias("q")).join(lists, "q")
    kept = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    vectors = usable(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))
    return nearest(vectors, F.col("vec_id") % 50 == 0)
