"""Ordered series: filters, sliding features, spectra. Rows are (series_id, pos, x); order is always explicit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fir(df: DataFrame, keys: list[str], pos: str, x: str, coeffs: list[float], out: str = "y") -> DataFrame:
    """df with sum of coeffs[k] * x[n - k], missing history 0."""
    w = Window.partitionBy(*keys).orderBy(pos)
    y = F.lit(0.0)
    for k, c in enumerate(coeffs):
        y = y + F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) * float(c)
    return df.withColumn(out, y)


def fir_chunked(df: DataFrame, keys: list[str], pos: str, x: str, coeffs: list[float], chunk: int = 100_000, out: str = "y") -> DataFrame:
    """The same for series too long for one task: chunks of consecutive positions (gapless), each with the history it needs."""
    m = len(coeffs) - 1
    c = F.floor(F.col(pos) / chunk)
    parts = df.withColumn("_c", F.explode(F.array_distinct(F.array(c, F.floor((F.col(pos) + m) / chunk)))))
    return fir(parts, [*keys, "_c"], pos, x, coeffs, out).where(F.col("_c") == c).drop("_c")


def sliding_features(df: DataFrame, keys: list[str], pos: str, x: str, n: int) -> DataFrame:
    """df with `features`, the last n values in order, where there are n."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(n - 1), 0)
    return df.withColumn("features", F.collect_list(x).over(w)).where(F.size("features") == n)


def dft_sql(df: DataFrame, keys: list[str], pos: str, x: str) -> DataFrame:
    """(keys, k, re, im) of short series (positions 0 .. n-1), unnormalised: one array per series, sums by expression."""
    series = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(x).cast("double").alias("v")))), lambda s: s["v"]).alias("s"))
    at = series.select(*keys, "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("k"))

    def total(f) -> Column:
        return F.aggregate(F.transform("s", lambda v, n: v * f(2 * np.pi * ((F.col("k") * n) % F.size("s")) / F.size("s"))), F.lit(0.0), lambda a, v: a + v)

    return at.select(*keys, F.col("k").cast("long"), total(F.cos).alias("re"), (-total(F.sin)).alias("im"))


def dft(df: DataFrame, key: str, pos: str, x: str, kind: str = "long") -> DataFrame:
    """The same by fast Fourier transform; one series must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.fft.fft(pdf.sort_values(pos)[x].to_numpy(float))
        return pd.DataFrame({key: pdf[key].iloc[0], "k": np.arange(len(y)), "re": y.real, "im": y.imag})

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, k long, re double, im double")
