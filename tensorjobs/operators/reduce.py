"""Reductions, votes, losses and normalisation, per group or per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .lookup import small

EPS = 1e-5
REDUCE = {0: "sum", 1: "avg", 2: "max", 3: "min"}
VOTES = {0: "median", 1: "mean", 3: "min", 4: "max"}


def _fold(x: Column, op: int) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    if op == 0:
        return total
    if op == 1:
        return total / F.size(x)
    # the first value stands until another compares larger (smaller): later NaN are passed over
    better = (lambda v, a: v > a) if op == 2 else (lambda v, a: v < a)
    return F.aggregate(x, F.get(x, F.lit(0)), lambda a, v: F.when(~F.isnan(v) & ~F.isnan(a) & better(v, a), v).otherwise(a))


def reduce(m: DataFrame, op: int, dim: int = -1) -> DataFrame:
    """Sum, mean, max or min (op 0-3) of coordinates (i, j, v): of all (-1), per column (0) or per row (1)."""
    value = getattr(F, REDUCE[op])("v").alias("v")
    return m.agg(value) if dim == -1 else m.groupBy("j" if dim == 0 else "i").agg(value)


def reduce_many(m: DataFrame, ops: dict[str, int], dim: int = -1) -> DataFrame:
    """Several reductions, by column name, in one aggregation."""
    values = [getattr(F, REDUCE[op])("v").alias(name) for name, op in ops.items()]
    return m.agg(*values) if dim == -1 else m.groupBy("j" if dim == 0 else "i").agg(*values)


def reduce_row(x: Column, op: int) -> Column:
    """The same of an array column; no shuffle."""
    return _fold(F.transform(x, lambda v: v.cast("double")), op)


def votes(df: DataFrame, keys: list[str], value: str, strategies: dict[str, int], approximate: bool = False) -> DataFrame:
    """(keys, one column per name): several consensus values of each group in one aggregation; nulls take no part."""

    def f(strategy: int) -> Column:
        kind = VOTES[strategy]
        return (F.percentile_approx(value, 0.5, 10_000) if approximate else F.median(value)) if kind == "median" else {"mean": F.avg, "min": F.min, "max": F.max}[kind](value)

    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[f(s).cast("double").alias(n) for n, s in strategies.items()])


def vote(df: DataFrame, keys: list[str], value: str = "value", strategy: int = 0, approximate: bool = False) -> DataFrame:
    """(keys, value): consensus of each group; nulls take no part."""
    return votes(df, keys, value, {"value": strategy}, approximate)


#: Values of a group from which its median is found by counting, and bits that a round of counting settles.
HUGE, DIGIT = 1_000_000, 16


@F.pandas_udf(LongType())
def _sortable(v: pd.Series) -> pd.Series:
    """Bits of a double that order like the doubles (NaN last) when read without sign."""
    b = (v.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(b < 0, ~b, b ^ np.int64(-(2**63))))


@F.pandas_udf(DoubleType())
def _unsortable(s: pd.Series) -> pd.Series:
    b = s.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(-(2**63)), ~b).view(float))


def median(df: DataFrame, keys: list[str], value: str = "value", huge: int = HUGE) -> DataFrame:
    """(keys, value): exact medians, also of groups whose values no task could hold; nulls take no part, a null key is a group.

    Groups of up to `huge` values are aggregated as usual. For larger ones (a table of them is as small as the data over `huge`) the
    middle values are narrowed down: of the doubles' bits in sorting order, DIGIT at a time, one aggregation counts how many values
    begin with each pattern, and the pattern that holds the middle one goes on to the next round. No values are gathered.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > huge)
    if not large.take(1):
        return rows.groupBy(*keys).agg(F.median("_v").alias("value"))
    few = _with_group(rows, F.broadcast(large), keys, "left").where("_n IS NULL").groupBy(*keys).agg(F.median("_v").alias("value"))
    found = large.select(*keys, F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).alias("_rank")).distinct()
    found = found.select(*keys, F.col("_rank").alias("_of"), "_rank", F.lit(0).cast("long").alias("_prefix"))
    bits = rows.withColumn("_s", _sortable("_v")).drop("_v")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        above = F.lit(0).cast("long") if shift + DIGIT == 64 else F.shiftrightunsigned("_s", shift + DIGIT)
        some = _with_group(bits, F.broadcast(found), keys).where(above == F.col("_prefix"))
        digit = F.shiftrightunsigned("_s", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        counts = some.groupBy(*keys, "_of", "_rank", "_prefix", digit.alias("_d")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_of").orderBy("_d"))  # 2 ** DIGIT rows at most
        held = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        found = held.select(*keys, "_of", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_d")).alias("_prefix"))
    number = F.coalesce(_unsortable("_prefix"), F.lit(float("nan")))  # pandas hands NaN over as null
    many = found.withColumn("_v", number).groupBy(*keys).agg(F.avg("_v").alias("value"))
    return few.unionByName(many)


def vote_named(df: DataFrame, keys: list[str], value: str = "value", strategy: str = "mean") -> DataFrame:
    """As vote, by name; an unknown name means the mean."""
    return vote(df, keys, value, {v: k for k, v in VOTES.items()}.get(strategy, 1))


def vote_quorum(df: DataFrame, keys: list[str], k: int, tol: float = 0.01, value: str = "value", pos: str = "pos", as_float32: bool = False) -> DataFrame:
    """(keys, value, count, agree): the value with most others within tol (itself too), the first by pos of equals.

    Values meet those of their own and the neighbouring buckets of 2 * tol, so no group is compared pair by pair
    beyond values that are that close; equal values are compared once.
    """
    v = F.col(value).cast("float").cast("double") if as_float32 else F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(pos).alias("_pos"), v.alias("_v"))
    distinct = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.min("_pos").alias("_pos")).withColumn("_b", F.floor(F.col("_v") / (2 * tol)).cast("long"))
    other = distinct.select(*keys, F.col("_v").alias("_w"), F.col("_n").alias("_m"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    near = distinct.join(other, [*keys, "_b"]).where(F.abs(F.col("_v") - F.col("_w")) <= tol)
    counted = near.groupBy(*keys, "_v", "_pos").agg(F.sum("_m").alias("_c"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("_v", "_c"), F.struct("_c", -F.col("_pos"))).alias("b"))
    return best.select(*keys, F.col("b._v").alias("value"), F.col("b._c").alias("count"), (F.col("b._c") >= k).cast("int").alias("agree"))


def losses(df: DataFrame, keys: list[str], kinds: dict[str, int], pred: str = "pred", target: str = "target") -> DataFrame:
    """Several losses per group, by column name, in one aggregation: 0 mean squared error, 1 mean absolute error (no rows: 0)."""
    d = F.col(pred).cast("double") - F.col(target)
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(d * d if kind == 0 else F.abs(d)), F.lit(0.0)).alias(n) for n, kind in kinds.items()])


def loss(df: DataFrame, keys: list[str], kind: int, pred: str = "pred", target: str = "target") -> DataFrame:
    """Per group: 0 mean squared error, 1 mean absolute error (no rows: 0)."""
    return losses(df, keys, {"loss": kind}, pred, target)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-sum t * (x - logsumexp(x)) over t > 0, of two arrays; a sum, not a mean."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    part = F.zip_with(logits, target, lambda x, t: F.when(t > 0, t * (x - lse)).otherwise(0.0))
    return -F.aggregate(part, F.lit(0.0), lambda a, x: a + x)


def softmax(x: Column) -> Column:
    """Of an array."""
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def _with_group(df: DataFrame, of: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of `of`, a row per group; null keys are a group too. Few groups are best sent along (`lookup.small`): else all rows of one meet in a task."""
    of = of.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(of, same, how).drop(*(f"_of_{k}" for k in keys))


def softmax_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with `softmax` of a long column per group, rows with null keys being a group; the group's maximum and sum are aggregates joined back, not a window over a large group."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    shifted = _with_group(df, small(top), keys).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_total"))
    return _with_group(shifted, small(total), keys).withColumn("softmax", F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


def layer_norm(x: Column, gamma: Column | None = None, beta: Column | None = None) -> Column:
    """Of an array over its length: population variance, 1 / sqrt(var + 1e-5)."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return _normalised(x, mean, n, gamma, beta)


def _normalised(x: Column, mean: Column, n: Column, gamma: Column | None, beta: Column | None) -> Column:
    parts = F.transform(F.array(F.struct(mean.alias("m"))), lambda s: F.struct(s["m"].alias("m"), (F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - s["m"]) * (v - s["m"])) / n).alias("q")))
    g = (lambda i: F.get(gamma, i)) if gamma is not None else (lambda i: F.lit(1.0))
    b = (lambda i: F.get(beta, i)) if beta is not None else (lambda i: F.lit(0.0))
    return F.get(F.transform(parts, lambda s: F.transform(x, lambda v, i: (v - s["m"]) / F.sqrt(s["q"] + EPS) * g(i) + b(i))), F.lit(0))


def batch_norm(df: DataFrame, channel: str, value: str, params: DataFrame | None = None) -> DataFrame:
    """df with `normed`: per channel (null is one too) over all rows; params(channel, gamma, beta) are optional. One pass for the moments."""
    moments = df.groupBy(channel).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_q"))
    if params is not None:
        moments = moments.join(params.select(channel, "gamma", "beta"), channel, "left")
    else:
        moments = moments.withColumns({"gamma": F.lit(1.0), "beta": F.lit(0.0)})
    scaled = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_q") + EPS) * F.coalesce("gamma", F.lit(1.0)) + F.coalesce("beta", F.lit(0.0))
    return _with_group(df, small(moments), [channel]).withColumn("normed", scaled).drop("_m", "_q", "gamma", "beta")


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 below two values)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Of two arrays of equal size (else an error): cosine distance (1 if a norm product is at most 1e-12), euclid or dot."""
    s = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)
    d = lambda x: x.cast("double")
    dot = s(lambda x, y: d(x) * d(y))
    if metric == "dot":
        out = dot
    elif metric == "euclid":
        out = F.sqrt(s(lambda x, y: (d(x) - d(y)) * (d(x) - d(y))))
    else:
        norms = F.sqrt(s(lambda x, y: d(x) * d(x))) * F.sqrt(s(lambda x, y: d(y) * d(y)))
        out = F.when(norms > 1e-12, 1.0 - dot / norms).otherwise(1.0)
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("sizes do not match")).cast("double"))


def unit(x: Column) -> Column:
    """x over its norm, if that is above 1e-12."""
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.when(n > 1e-12, F.transform(x, lambda v: v / n)).otherwise(x)
