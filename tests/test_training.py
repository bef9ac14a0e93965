"""Mini-batches over barrier tasks against a plain loop in the same order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.operators import models, training


def loop(parts, layers, epochs, lr, adam, batch, patience=0, min_delta=1e-6):
    """parts: (hashes, x, y) of each task."""
    layers = [(w.copy(), b.copy(), act) for w, b, act in layers]
    params = [p for w, b, _ in layers for p in (w, b)]
    m, v = [0.0] * len(params), [0.0] * len(params)
    n = sum(len(p[0]) for p in parts)
    each = n if n <= batch else -(-batch // len(parts))
    losses, best, since, t = [], np.inf, 0, 0
    for epoch in range(epochs):
        orders = [training._order(h, epoch) for h, _, _ in parts]
        total = 0.0
        for lo in range(0, max(len(p[0]) for p in parts), each):
            x, y = (np.concatenate([p[k][o[lo : lo + each]] for p, o in zip(parts, orders, strict=True) if len(p[0])]) for k in (1, 2))
            loss, grads = models._gradients(x, y, layers)
            total += loss
            t += 1
            for k, g in enumerate(grads):
                g = g / len(x)
                if adam:
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    g = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                params[k] -= lr * g
        losses.append(total / (n * layers[-1][0].shape[1]))
        if best - losses[-1] > min_delta:
            best, since = losses[-1], 0
        else:
            since += 1
        if patience and since >= patience:
            break
    return params, losses


def data(spark, n, tasks):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 3))
    y = np.tanh(x @ rng.standard_normal((3, 2)))
    rows = [(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)] + [(None, [1.0, 1.0]), ([1.0] * 3, None)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    placed = df.where("x IS NOT NULL AND y IS NOT NULL").select(F.xxhash64("x", "y").alias("h"), "x", "y").repartition(tasks, "h").withColumn("p", F.spark_partition_id()).collect()
    parts = []
    for p in range(tasks):
        own = sorted((r for r in placed if r["p"] == p), key=lambda r: r["h"])
        parts.append((np.array([r["h"] for r in own], np.int64), np.array([r["x"] for r in own]).reshape(-1, 3), np.array([r["y"] for r in own]).reshape(-1, 2)))
    return df, parts


NET = [(np.random.default_rng(1).standard_normal((3, 4)), np.zeros(4), 2), (np.random.default_rng(2).standard_normal((4, 2)), np.zeros(2), 3)]


@pytest.mark.parametrize(("n", "tasks", "adam"), [(40, 3, True), (64, 4, False), (131, 2, True)])
def test_equal_to_a_loop(spark, n, tasks, adam):
    df, parts = data(spark, n, tasks)
    got, losses = training.batches_train(df, "x", "y", NET, 3, 0.05, adam, tasks=tasks)
    want, seen = loop(parts, NET, 3, 0.05, adam, 64)
    assert np.allclose(losses, seen) and all(np.allclose(a, b) for a, b in zip([p for w, b, _ in got for p in (w, b)], want, strict=True))
    if n <= 64:  # one batch: what full-batch training gives
        full, other = models.mlp_train(df, "x", "y", NET, 3, 0.05, adam)
        assert np.allclose(losses, other) and np.allclose(got[0][0], full[0][0])


def test_tasks_that_average(spark):
    """Several steps of each task on its own, then the mean weighted by rows."""
    df, parts = data(spark, 150, 2)
    got, losses = training.batches_train(df, "x", "y", NET, 2, 0.05, False, batch=32, tasks=2, every=3)
    nets, seen = [[(w.copy(), b.copy(), act) for w, b, act in NET] for _ in parts], []
    for epoch in range(2):
        orders, total = [training._order(h, epoch) for h, _, _ in parts], 0.0
        for lo in range(0, max(len(p[0]) for p in parts), 48):
            rows = [0, 0]
            for k, (p, o) in enumerate(zip(parts, orders, strict=True)):
                for at in range(lo, lo + 48, 16):
                    some = o[at : at + 16]
                    if len(some):
                        loss, grads = models._gradients(p[1][some], p[2][some], nets[k])
                        total, rows[k] = total + loss, rows[k] + len(some)
                        for q, g in zip([q for w, b, _ in nets[k] for q in (w, b)], grads, strict=True):
                            q -= 0.05 * g / len(some)
            for layers in zip(*nets, strict=True):
                for i in (0, 1):
                    mean = sum(n * layer[i] for n, layer in zip(rows, layers, strict=True)) / sum(rows)
                    for layer in layers:
                        layer[i][...] = mean
        seen.append(total / 300)
    assert np.allclose(losses, seen) and all(np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) for a, b in zip(got, nets[0], strict=True))
    assert training.batches_train(df, "x", "y", NET, 12, 0.02, True, batch=32, tasks=2, every=5)[1][-1] < seen[0]


def test_early_stop(spark):
    """A loss that creeps on counts against the last real improvement, in both trainers."""
    df, parts = data(spark, 50, 2)
    _, seen = loop(parts, NET, 60, 0.05, True, 64, 2, 0.2)
    for losses in (training.batches_train(df, "x", "y", NET, 60, 0.05, True, 2, 0.2, tasks=2)[1], models.mlp_train(df, "x", "y", NET, 60, 0.05, True, 2, 0.2)[1]):
        assert len(losses) == len(seen) < 60 and np.allclose(losses, seen)


def test_more_tasks_than_rows(spark):
    df, parts = data(spark, 2, 4)
    got, losses = training.batches_train(df, "x", "y", NET, 3, 0.1, tasks=4)
    assert np.allclose(losses, loop(parts, NET, 3, 0.1, True, 64)[1])
    got, losses = training.batches_train(df.where(F.lit(False)), "x", "y", NET, 3, 0.1, tasks=2)
    assert losses == [] and np.array_equal(got[0][0], NET[0][0])
