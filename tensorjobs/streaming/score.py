"""Streams: the same column functions on unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.columns import clamp, decide
from ..operators.models import Scorer
from ..operators.reduce import vote_named


def score_stream(stream: DataFrame, scorer: Scorer, features: list[str], divisors: list[float], t: float = 0.5) -> DataFrame:
    """stream with score and decision: features over divisors, clamped to [0, 1], scored, cut at t. Stateless."""
    x = F.array(*[clamp(F.col(f).cast("double") / d) for f, d in zip(features, divisors, strict=True)])
    scored = scorer.score(stream.withColumn("_x", x), "_x", "_s").withColumn("score", F.get("_s", F.lit(0)))
    return scored.withColumn("decision", decide(F.col("score"), t)).drop("_x", "_s")


def vote_stream(results: DataFrame, path: str, key: str = "request", value: str = "value", strategy: str = "mean") -> DataStreamWriter:
    """A writer that votes per request within each micro-batch (results of a request that arrive apart: session_votes) and writes it to path/batch=N: a batch done again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        vote_named(batch, [key], value, strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(each)


def session_votes(stream: DataFrame, ts: str, key: str = "request", value: str = "value", strategy: str = "mean", gap: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(key, value, n, until): one vote per request over all micro-batches, given when no result of it came for `gap` (mean, min or max)."""
    vote = {"mean": F.avg, "min": F.min, "max": F.max}[strategy](value).cast("double").alias("value")
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key)
    return g.agg(vote, F.count(value).alias("n")).select(key, "value", "n", F.col("s.end").alias("until"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Results in an element of the state's lists at most.
STEP = 100_000


def votes_by_timer(
    stream: DataFrame, ts: str, key: str = "request", value: str = "value", pos: str = "pos", strategy: str = "median", k: int = 1, tol: float = 0.01, gap: str = "1 minute", late: str = "1 minute"
) -> DataFrame:
    """(key, value, n, agree): one vote per request over all micro-batches, given when no result of it came for `gap` of event time.

    All strategies: median, mean, min, max (else the mean), and quorum: the value with most results within tol (itself too), the first by
    `pos` of equals; agree says whether `k` results or more do. For the others agree is null. It equals `vote` and `vote_quorum` over the same rows.

    The results of a request are a list of packed pieces (one a micro-batch or STEP results) in the state store; a timer, moved on by each result, ends the vote and clears the list, so
    state holds the requests of the last gap only. Results of null value or time take no part, those that come after their vote (or later than
    `late` behind the stream) are a vote of their own or dropped with the watermark. One request's results must fit a task. The session must use the
    store ROCKSDB (spark.sql.streaming.stateStore.providerClass).
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    wait = stream.sparkSession.sql(f"SELECT cast(unix_millis(timestamp_seconds(0) + INTERVAL {gap}) AS long)").first()[0]
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.col(pos).cast("long").alias("pos"), F.col(ts).alias("ts"))
    grouped = rows.withWatermark("ts", late).groupBy("key")
    found = grouped.transformWithStateInPandas(_Vote(strategy, k, tol, wait), f"key {kind}, value double, n long, agree int", "Append", "EventTime")
    return found.withColumnRenamed("key", key)


class _Vote(StatefulProcessor):
    def __init__(self, strategy: str, k: int, tol: float, wait: int) -> None:
        self.strategy, self.k, self.tol, self.wait = strategy, k, tol, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.results = handle.getListState("results", "value binary, pos binary")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.until.get()[0] if self.until.exists() else 0
        last = before
        for pdf in rows:
            if len(pdf):
                v, pos = pdf["value"].to_numpy(float), pdf["pos"].fillna(0).to_numpy(np.int64)
                self.results.appendList([(v[lo : lo + STEP].tobytes(), pos[lo : lo + STEP].tobytes()) for lo in range(0, len(v), STEP)])
                last = max(last, int(pdf["ts"].max().timestamp() * 1000) + self.wait)
        if last != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(last)
            self.until.update((last,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = list(self.results.get())
        v, pos = np.frombuffer(b"".join(r[0] for r in rows)), np.frombuffer(b"".join(r[1] for r in rows), np.int64)
        agree = None
        if self.strategy == "quorum":
            value, most = quorum(v, pos, self.tol)
            agree = int(most >= self.k)
        else:
            value = {"median": np.median, "min": np.min, "max": np.max}.get(self.strategy, np.mean)(v)
        self.results.clear()
        self.until.clear()
        yield pd.DataFrame({"key": [key[0]], "value": [float(value)], "n": [len(v)], "agree": pd.array([agree], "Int32")})

    def close(self) -> None:
        pass


def quorum(v: np.ndarray, pos: np.ndarray, tol: float) -> tuple[float, int]:
    """(the value with most values within tol, the first by pos of equals; how many), by one sort."""
    u, at, n = np.unique(v, return_inverse=True, return_counts=True)
    sums = np.append(0, np.cumsum(n))
    near = lambda i: np.abs(u[np.clip(i, 0, len(u) - 1)] - u) <= tol
    lo, hi = np.searchsorted(u, u - tol), np.searchsorted(u, u + tol, "right")
    # u - tol and u + tol are rounded: the difference itself decides about the values at the borders
    lo = np.where((lo > 0) & near(lo - 1), lo - 1, np.where(near(lo), lo, lo + 1))
    hi = np.where((hi < len(u)) & near(hi), hi + 1, np.where(near(hi - 1), hi, hi - 1))
    count = (sums[hi] - sums[lo])[at]
    best = np.lexsort((pos, -count))[0]
    return float(v[best]), int(count[best])


def windowed_votes(stream: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean, least and largest value per key and window, with a watermark for late rows."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key)
    return g.agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), key, "mean", "least", "largest")
