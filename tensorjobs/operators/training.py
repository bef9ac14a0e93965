"""Mini-batch training: barrier tasks keep their rows, walk through them in batches and add up their gradients after each one.

Rows are dealt to `tasks` tasks by hash and stay there, as float arrays, for all epochs; an epoch's order is by another hash. A batch
is the next `batch / tasks` rows of every task. Tasks exchange only sums as large as the parameters, and each applies the same step, so all hold the same
parameters. With no more than `batch` rows a batch is all of them, whatever the number of tasks. All tasks must run at once; a lost one restarts the stage.

An exchange takes about a second (barriers poll), so for many rows a task takes `every` steps on its own parts of the batches, after which parameters and
moments are averaged, weighted by the rows that each has seen.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import BETA1, BETA2, EPSILON, Layer, _gradients
from .vectors import _bounded

#: Rows of a batch.
BATCH = 64
#: Values of the rows that one task keeps (1 GB).
HELD = 134_217_728


def _order(h: np.ndarray, epoch: int) -> np.ndarray:
    """The rows' order in an epoch, by a hash of their hash."""
    x = h.view(np.uint64) + np.uint64((epoch * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argsort(x ^ (x >> np.uint64(31)), kind="stable")


def _cut(flat: np.ndarray, shapes: list[tuple[tuple, tuple, int]]) -> list[Layer]:
    """Layers as views of one array of parameters."""
    out, at = [], 0
    for w, b, act in shapes:
        middle, end = at + int(np.prod(w)), at + int(np.prod(w)) + int(np.prod(b))
        out.append((flat[at:middle].reshape(w), flat[middle:end].reshape(b), act))
        at = end
    return out


def _like(flat: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """flat in pieces of the arrays' shapes."""
    ends = np.cumsum([a.size for a in arrays])
    return [piece.reshape(a.shape) for piece, a in zip(np.split(flat, ends[:-1]), arrays, strict=True)]


class Optimiser:
    """Steps on a list of arrays, which it changes: plain, or with moments."""

    def __init__(self, params: list[np.ndarray], lr: float, adam: bool) -> None:
        self.params, self.lr, self.adam, self.t = params, lr, adam, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.params, self.m, self.v, grads, strict=True):
            if self.adam:
                m += (1 - BETA1) * (g - m)
                v += (1 - BETA2) * (g * g - v)
                g = m / (1 - BETA1**self.t) / (np.sqrt(v / (1 - BETA2**self.t)) + EPSILON)
            p -= self.lr * g


class Patience:
    """Stops after `patience` epochs (if any) without an improvement of more than min_delta on the best loss, which only such ones replace."""

    def __init__(self, patience: int, min_delta: float) -> None:
        self.patience, self.min_delta, self.best, self.since = patience, min_delta, np.inf, 0

    def stops(self, loss: float) -> bool:
        if self.best - loss > self.min_delta:
            self.best, self.since = loss, 0
        else:
            self.since += 1
        return bool(self.patience) and self.since >= self.patience


def batches_train(
    df: DataFrame, features: str, labels: str, layers: list[Layer], epochs: int = 1000, lr: float = 0.001, adam: bool = True, patience: int = 0, min_delta: float = 1e-6, batch: int = BATCH, tasks: int | None = None, every: int = 1
) -> tuple[list[Layer], list[float]]:
    """(layers, losses) by mini-batch steps on the mean squared error; labels is an array column. A loss is the epoch's mean over rows and outputs, each
    before its batch's step. Rows with null features or labels take no part; without rows the layers come back as they are."""
    spark = df.sparkSession
    tasks = tasks or min(spark.sparkContext.defaultParallelism, 32)
    shapes = [(_bounded(w).shape, b.shape, act) for w, b, act in layers]
    start = np.concatenate([p.ravel() for w, b, _ in layers for p in (w, b)]).astype(float)
    sent = spark.sparkContext.broadcast(start)
    rows = df.where(F.col(features).isNotNull() & F.col(labels).isNotNull())
    rows = rows.select(F.xxhash64(features, labels).alias("h"), F.col(features).alias("x"), F.col(labels).alias("y")).repartition(tasks, "h")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()

        def added(v: np.ndarray) -> np.ndarray:
            """The sum of the tasks' arrays, in one order everywhere."""
            return np.sum([np.frombuffer(base64.b64decode(m)) for m in context.allGather(base64.b64encode(v.astype(float).tobytes()).decode())], 0)

        h, x, y, size = [np.empty(0, np.int64)], [], [], 0
        for pdf in frames:
            if len(pdf):
                h.append(pdf["h"].to_numpy())
                x.append(np.array(pdf["x"].tolist(), float))
                y.append(np.array(pdf["y"].tolist(), float))
                size += x[-1].size + y[-1].size
                if size > HELD:
                    raise ValueError("too many rows for a task: train with more tasks")
        hashes = np.concatenate(h)
        own = len(hashes)
        first = np.lexsort(tuple(np.concatenate([np.concatenate(x), np.concatenate(y)], 1).T) + (hashes,)) if own else hashes  # whatever order the shuffle gave
        xs, ys = (np.concatenate(v)[first] if own else np.empty((0, 0)) for v in (x, y))
        hashes = hashes[first]
        counts = np.zeros(len(context.getTaskInfos()))
        counts[context.partitionId()] = own
        counts = added(counts)
        n = int(counts.sum())
        each = max(int(counts.max()), 1) if n <= batch else -(-batch // tasks)
        flat = sent.value.copy()
        params = _cut(flat, shapes)
        optimiser, waiting, losses = Optimiser([p for w, b, _ in params for p in (w, b)], lr, adam), Patience(patience, min_delta), []
        for epoch in range(epochs if n else 0):
            order, lost = _order(hashes, epoch), 0.0
            for lo in range(0, int(counts.max()), each * every):
                if every == 1:
                    some = order[lo : lo + each]
                    loss, grads = _gradients(xs[some], ys[some], params) if len(some) else (0.0, [np.zeros_like(p) for p in optimiser.params])
                    total = added(np.concatenate([[loss, len(some)], *(g.ravel() for g in grads)]))
                    optimiser.step(_like(total[2:] / total[1], optimiser.params))
                else:
                    seen, loss = 0, 0.0
                    for at in range(lo, min(lo + each * every, int(counts.max())), each):
                        some = order[at : at + each]
                        if len(some):
                            own_loss, grads = _gradients(xs[some], ys[some], params)
                            loss, seen = loss + own_loss, seen + len(some)
                            optimiser.step([g / len(some) for g in grads])
                        else:
                            optimiser.t += 1
                    held = [*optimiser.params, *optimiser.m, *optimiser.v]
                    total = added(np.concatenate([[loss, seen], *(seen * p.ravel() for p in held)]))
                    for p, mean in zip(held, _like(total[2:] / total[1], held), strict=True):
                        p[...] = mean
                lost += total[0]
            losses.append(lost / (n * params[-1][0].shape[1]))
            if waiting.stops(losses[-1]):
                break
        if context.partitionId() == 0:
            yield pd.DataFrame({"i": np.concatenate([np.arange(len(flat)), -1 - np.arange(len(losses))]), "v": np.concatenate([flat, losses])})

    got = rows.mapInPandas(run, "i long, v double", barrier=True).toPandas()  # parameters and losses
    flat = start.copy()
    some = got[got["i"] >= 0]
    flat[some["i"].to_numpy()] = some["v"].to_numpy()
    return _cut(flat, shapes), got[got["i"] < 0].sort_values("i", ascending=False)["v"].tolist()
