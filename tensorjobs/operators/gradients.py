"""Gradients through whole graphs of layers: a forward pass that keeps its inputs, and a reverse pass, batch by batch in one kernel.

Layers are those of `models.graph_score` (conv with stride and padding, pools, reshape, flatten, dense, add, scale, activations, softmax) and
layer_norm (eps, gamma, beta) and attention (wq, wk, wv over x[n, t, d]). Sums over rows are made per task and added up by Spark; only parameters
reach the driver. Rows with null features or targets take no part in sums and give null in columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from . import reduce as R
from .vectors import _bounded

#: Parameters of a layer by operation.
PARTS = {"conv": ("kernel", "bias"), "dense": ("w", "b"), "add": ("value",), "scale": ("value",), "layer_norm": ("gamma", "beta"), "attention": ("wq", "wk", "wv")}


def _parts(layer: dict) -> list[str]:
    return [p for p in PARTS.get(layer["op"], ()) if p in layer]


def _unbroadcast(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """g summed down to the shape that was broadcast to its own."""
    g = g.sum(tuple(range(g.ndim - len(shape))))
    return g.sum(tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1), keepdims=True)


def _attend(x: np.ndarray, layer: dict) -> tuple[np.ndarray, ...]:
    q, k, v = (x @ np.asarray(layer[p], float) for p in ("wq", "wk", "wv"))
    s = models._softmax(q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1]))
    return q, k, v, s


def step(x: np.ndarray, layer: dict, outputs: dict[str, np.ndarray]) -> np.ndarray:
    """One layer forward."""
    if layer["op"] == "layer_norm":
        h = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + layer.get("eps", R.EPS))
        return h * np.asarray(layer.get("gamma", 1.0), float) + np.asarray(layer.get("beta", 0.0), float)
    if layer["op"] == "attention":
        *_, v, s = _attend(x, layer)
        return s @ v
    return models._graph_step(x, layer, outputs)


def _windows(x: np.ndarray, size: tuple[int, int], stride: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=(2, 3))[:, :, ::stride, ::stride]


def _spread(g: np.ndarray, shape: tuple[int, ...], stride: int) -> np.ndarray:
    """g[n, c, oh, ow, i, j], what each cell of each window gets, added up over x of this shape."""
    out = np.zeros(shape)
    oh, ow, kh, kw = g.shape[2:]
    for i in range(kh):
        for j in range(kw):
            out[:, :, i : i + stride * (oh - 1) + 1 : stride, j : j + stride * (ow - 1) + 1 : stride] += g[..., i, j]
    return out


def back(g: np.ndarray, x: np.ndarray, y: np.ndarray, layer: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(gradient of the layer's input, of its parameters) from that of its output; x and y: its input and output."""
    op, found = layer["op"], {}
    if op == "conv":
        pad, stride, kernel = layer.get("padding", 0), layer.get("stride", 1), np.asarray(layer["kernel"], float)
        wide = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        found["kernel"] = np.einsum("nchwij,nohw->ocij", _windows(wide, kernel.shape[2:], stride), g, optimize=True)
        if "bias" in layer:
            found["bias"] = _unbroadcast(g.sum((0, 2, 3)), np.shape(layer["bias"]))
        d = _spread(np.einsum("nohw,ocij->nchwij", g, kernel, optimize=True), wide.shape, stride)
        return d[:, :, pad : d.shape[2] - pad, pad : d.shape[3] - pad], found
    if op in ("maxpool", "avgpool"):
        size, stride = layer.get("size", 2), layer.get("stride", layer.get("size", 2))
        if op == "avgpool":
            each = np.broadcast_to(g[..., None, None] / size**2, (*g.shape, size, size))
        else:  # to the first largest of each window
            view = _windows(x, (size, size), stride)
            each = np.zeros((*g.shape, size * size))
            np.put_along_axis(each, view.reshape(*g.shape, -1).argmax(-1)[..., None], g[..., None], -1)
            each = each.reshape(*g.shape, size, size)
        return _spread(each, x.shape, stride), found
    if op in ("reshape", "flatten"):
        return g.reshape(x.shape), found
    if op == "dense":
        w = np.asarray(layer["w"], float)
        found["w"] = x.reshape(-1, w.shape[0]).T @ g.reshape(-1, w.shape[1])
        if "b" in layer:
            found["b"] = _unbroadcast(g, np.shape(layer["b"]))
        return g @ w.T, found
    if op == "add":
        if "with" not in layer:
            found["value"] = _unbroadcast(g, np.shape(layer["value"]))
        return g, found
    if op == "scale":
        found["value"] = _unbroadcast(g * x, np.shape(layer["value"]))
        return g * np.asarray(layer["value"], float), found
    if op == "layer_norm":
        inv = 1 / np.sqrt(x.var(-1, keepdims=True) + layer.get("eps", R.EPS))
        h = (x - x.mean(-1, keepdims=True)) * inv
        for part, v in (("gamma", g * h), ("beta", g)):
            if part in layer:
                found[part] = _unbroadcast(v, np.shape(layer[part]))
        return models.layer_norm_backward(g * np.asarray(layer.get("gamma", 1.0), float), x, layer.get("eps", R.EPS)), found
    if op == "attention":
        q, k, v, s = _attend(x, layer)
        z = models.softmax_backward(g @ v.swapaxes(1, 2), s) / np.sqrt(q.shape[-1])
        grads = {"wq": z @ k, "wk": z.swapaxes(1, 2) @ q, "wv": s.swapaxes(1, 2) @ g}
        for part, d in grads.items():
            found[part] = np.einsum("ntd,nte->de", x, d)
        return sum(d @ np.asarray(layer[part], float).T for part, d in grads.items()), found
    if op == "softmax":
        return models.softmax_backward(g, y), found
    slope = {"relu": lambda: x > 0, "sigmoid": lambda: y * (1 - y), "tanh": lambda: 1 - y * y, "identity": lambda: 1.0}
    return g * slope[op](), found


def run(x: np.ndarray, layers: list[dict]) -> tuple[np.ndarray, list[np.ndarray], dict[str, int]]:
    """(output, what stands before each layer and after the last, number of the layer that has each name)."""
    tape, outputs, names = [x], {}, {}
    for i, layer in enumerate(layers):
        x = step(x, layer, outputs)
        tape.append(x)
        if "name" in layer:
            outputs[layer["name"]], names[layer["name"]] = x, i
    return x, tape, names


def reverse(g: np.ndarray, layers: list[dict], tape: list[np.ndarray], names: dict[str, int]) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
    """(gradient of the input, gradients of each layer's parameters) from the gradient of the output."""
    at: dict[int, np.ndarray] = {len(layers) - 1: g}
    found: list[dict[str, np.ndarray]] = [{} for _ in layers]

    def add(i: int, d: np.ndarray) -> None:
        at[i] = at[i] + d if i in at else d

    for i in range(len(layers) - 1, -1, -1):
        own = at.pop(i, None)
        if own is None:
            own = np.zeros_like(tape[i + 1])
        d, found[i] = back(own, tape[i], tape[i + 1], layers[i])
        add(i - 1, d)
        if layers[i]["op"] == "add" and "with" in layers[i]:
            add(names[layers[i]["with"]], own)
    return at[-1], found


def _checked(layers: list[dict]) -> list[dict]:
    seen: set[str] = set()
    for layer in layers:
        if "with" in layer and layer["with"] not in seen:
            raise ValueError(f"no layer is called {layer['with']} before it is added")
        for part in _parts(layer):
            _bounded(np.asarray(layer[part], float))
        seen.add(layer.get("name", ""))
    return layers


def input_gradient(df: DataFrame, features: str, upstream: str, layers: list[dict], out: str = "gradient") -> DataFrame:
    """df with the gradient (a flat array) of the graph's input, from that of its output (`upstream`, a flat array)."""
    sent = df.sparkSession.sparkContext.broadcast(_checked(layers))

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series, g: pd.Series) -> pd.Series:
        some = (x.notna() & g.notna()).to_numpy()
        found: list[np.ndarray | None] = [None] * len(x)
        if some.any():
            y, tape, names = run(np.array(x[some].tolist(), float), sent.value)
            d, _ = reverse(np.array(g[some].tolist(), float).reshape(y.shape), sent.value, tape, names)
            for i, v in zip(np.flatnonzero(some).tolist(), d.reshape(len(d), -1), strict=True):
                found[i] = v
        return pd.Series(found, dtype=object)

    return df.withColumn(out, kernel(F.col(features), F.col(upstream)))


def graph_gradients(df: DataFrame, features: str, target: str, layers: list[dict], loss: str = "mse") -> DataFrame:
    """(layer, part, place, value): sums over all rows of the gradients of each parameter, row-major; as layer -1 the parts `loss` and `rows`.

    mse: squared errors, summed over outputs; cross_entropy: -sum(target * log(output)) of a graph that ends with softmax. Divide by `rows` for means.
    """
    if loss == "cross_entropy" and layers[-1]["op"] != "softmax":
        raise ValueError("cross_entropy needs a graph that ends with softmax")
    sent = df.sparkSession.sparkContext.broadcast(_checked(layers))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, str], np.ndarray] = {}

        def add(key: tuple[int, str], v: np.ndarray) -> None:
            total[key] = total[key] + v if key in total else v

        graph = sent.value
        for pdf in frames:
            if not len(pdf):
                continue
            y, tape, names = run(np.array(pdf[features].tolist(), float), graph)
            t = np.array(pdf[target].tolist(), float).reshape(y.shape)
            if loss == "mse":
                value, g, layers_, tape_ = ((y - t) ** 2).sum(), 2 * (y - t), graph, tape
            else:  # through the softmax at once
                value, g, layers_, tape_ = -(t * np.log(np.maximum(y, 1e-300))).sum(), y * t.sum(-1, keepdims=True) - t, graph[:-1], tape[:-1]
            _, found = reverse(g, layers_, tape_, names)
            for i, parts in enumerate(found):
                for part, v in parts.items():
                    add((i, part), v.ravel())
            add((-1, "loss"), np.array([value]))
            add((-1, "rows"), np.array([float(len(pdf))]))
        for (i, part), v in total.items():
            yield pd.DataFrame({"layer": i, "part": part, "place": np.arange(len(v)), "value": v})

    rows = df.select(features, target).where(F.col(features).isNotNull() & F.col(target).isNotNull())
    return rows.mapInPandas(partial, "layer int, part string, place long, value double").groupBy("layer", "part", "place").agg(F.sum("value").alias("value"))


def graph_train(df: DataFrame, features: str, target: str, layers: list[dict], epochs: int, lr: float, loss: str = "mse", adam: bool = True) -> tuple[list[dict], list[float]]:
    """(layers, losses) by full-batch steps on the mean gradient over rows, one job an epoch; a loss is the mean over rows before its step."""
    layers = [dict(layer, **{p: np.array(layer[p], float) for p in _parts(layer)}) for layer in layers]
    moments: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
    losses: list[float] = []
    for t in range(1, epochs + 1):
        sums = graph_gradients(df, features, target, layers, loss).toPandas()  # as many rows as parameters
        if not len(sums):
            break
        own = sums[sums["layer"] < 0].set_index("part")["value"]
        losses.append(own["loss"] / own["rows"])
        for (i, part), some in sums[sums["layer"] >= 0].groupby(["layer", "part"]):
            p = layers[i][part]
            g = np.zeros(p.size)
            g[some["place"].to_numpy()] = some["value"].to_numpy() / own["rows"]
            g = g.reshape(p.shape)
            if adam:
                m, v = moments.get((i, part), (np.zeros_like(g), np.zeros_like(g)))
                m, v = models.BETA1 * m + (1 - models.BETA1) * g, models.BETA2 * v + (1 - models.BETA2) * g * g
                moments[i, part] = m, v
                g = m / (1 - models.BETA1**t) / (np.sqrt(v / (1 - models.BETA2**t)) + models.EPSILON)
            layers[i][part] = p - lr * g
    return layers, losses
