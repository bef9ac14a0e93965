"""Gradients of graphs against finite differences and goldens; training steps; attention in blocks; images of any shape and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.operators import gradients, models

RNG = np.random.default_rng(7)


def n(*shape):
    return RNG.standard_normal(shape)


GRAPHS = {
    "dense": (6, [{"op": "dense", "w": n(6, 4), "b": n(4)}, {"op": "tanh"}, {"op": "dense", "w": n(4, 3)}, {"op": "sigmoid"}]),
    "strided conv": (50, [{"op": "reshape", "shape": (2, 5, 5)}, {"op": "conv", "kernel": n(3, 2, 3, 3), "bias": n(3), "stride": 2, "padding": 1}, {"op": "relu"}, {"op": "flatten"}, {"op": "dense", "w": n(27, 2), "b": n(2)}]),
    "uneven conv": (36, [{"op": "reshape", "shape": (1, 6, 6)}, {"op": "conv", "kernel": n(2, 1, 2, 3), "stride": 2, "bias": 0.3}, {"op": "flatten"}]),
    "pools": (64, [{"op": "reshape", "shape": (1, 8, 8)}, {"op": "maxpool", "size": 3, "stride": 2}, {"op": "avgpool", "size": 2, "stride": 1}, {"op": "flatten"}]),
    "norm": (5, [{"op": "layer_norm", "gamma": n(5), "beta": n(5)}, {"op": "scale", "value": n(5)}, {"op": "add", "value": n(1)}, {"op": "softmax"}]),
    "attention": (12, [{"op": "reshape", "shape": (3, 4)}, {"op": "attention", "wq": n(4, 2), "wk": n(4, 2), "wv": n(4, 3)}, {"op": "flatten"}]),
    "skip": (4, [{"op": "dense", "w": n(4, 4), "name": "a"}, {"op": "tanh"}, {"op": "dense", "w": n(4, 4), "name": "b"}, {"op": "add", "with": "a"}, {"op": "add", "with": "b"}, {"op": "identity"}]),
}


def losses(x, t, layers):
    y = gradients.run(x, layers)[0].reshape(len(x), -1)
    return ((y - t) ** 2).sum()


@pytest.fixture(scope="module")
def frame(spark):
    return lambda x, t: spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, t, strict=True))] + [(-1, None, t[0].tolist()), (-2, x[0].tolist(), None)], "id long, x array<double>, t array<double>").repartition(3)


@pytest.mark.parametrize("name", GRAPHS)
def test_all_gradients_match_differences(frame, name):
    size, layers = GRAPHS[name]
    x = n(5, size)
    t = n(5, gradients.run(x, layers)[0][0].size)
    got = {(r["layer"], r["part"], r["place"]): r["value"] for r in gradients.graph_gradients(frame(x, t), "x", "t", layers).collect()}
    assert got.pop((-1, "rows", 0)) == 5 and got.pop((-1, "loss", 0)) == pytest.approx(losses(x, t, layers))
    assert len(got) == sum(np.size(layer[p]) for layer in layers for p in gradients._parts(layer))
    for (i, part, place), value in got.items():
        ends = []
        for h in (1e-6, -1e-6):
            p = np.array(layers[i][part], float)
            p.flat[place] += h
            ends.append(losses(x, t, [*layers[:i], {**layers[i], part: p}, *layers[i + 1 :]]))
        assert value == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("name", GRAPHS)
def test_input_gradients_match_differences(frame, name):
    size, layers = GRAPHS[name]
    x = n(3, size)
    g = n(3, gradients.run(x, layers)[0][0].size)
    got = {r["id"]: r["gradient"] for r in gradients.input_gradient(frame(x, g), "x", "t", layers).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    f = lambda x: (gradients.run(x, layers)[0].reshape(len(x), -1) * g).sum(1)
    for k in range(size):
        h = np.zeros(size)
        h[k] = 1e-6
        assert np.allclose([got[i][k] for i in range(3)], (f(x + h) - f(x - h)) / 2e-6, rtol=1e-4, atol=1e-5)


def test_goldens(spark):
    """Values of the fixtures: relu and product gradients, layer norm sums to nothing per row."""
    df = spark.createDataFrame([([-1.0, 0.5, 2.0, -0.3], [1.0] * 4)], "x array<double>, g array<double>")
    assert gradients.input_gradient(df, "x", "g", [{"op": "relu"}]).first()["gradient"] == [0.0, 1.0, 1.0, 0.0]
    w = np.arange(1, 7).reshape(3, 2) / 10
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 1.0])], "x array<double>, g array<double>")
    assert np.allclose(gradients.input_gradient(df, "x", "g", [{"op": "dense", "w": w}]).first()["gradient"], [0.25, 0.55, 0.85])
    assert np.allclose(gradients.back(np.array([[0.5, 1.0]]), np.array([[1.0, 2.0, 3.0]]), None, {"op": "dense", "w": w})[1]["w"], [[0.5, 1], [1, 2], [1.5, 3]])
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, -1.0]), ([4.0, 5.0, 6.0], [0.5] * 3)], "x array<double>, g array<double>")
    out = [r["gradient"] for r in gradients.input_gradient(df, "x", "g", [{"op": "layer_norm"}]).collect()]
    assert np.allclose(np.sum(out, 1), 0) and np.allclose(out[1], 0, atol=1e-9)


def test_cross_entropy(frame):
    layers = [{"op": "dense", "w": n(3, 4), "b": n(4)}, {"op": "softmax"}]
    x, t = n(6, 3), np.eye(4)[[0, 1, 2, 3, 0, 1]]
    f = lambda w: -(t * np.log(gradients.run(x, [{**layers[0], "w": w}, layers[1]])[0])).sum()
    rows = gradients.graph_gradients(frame(x, t), "x", "t", layers, "cross_entropy").where("part = 'w'").collect()
    for r in rows:
        h = np.zeros((3, 4))
        h.flat[r["place"]] = 1e-6
        assert r["value"] == pytest.approx((f(layers[0]["w"] + h) - f(layers[0]["w"] - h)) / 2e-6, rel=1e-4, abs=1e-5)
    with pytest.raises(ValueError):
        gradients.graph_gradients(frame(x, t), "x", "t", layers[:1], "cross_entropy")


@pytest.mark.parametrize("adam", [False, True])
def test_training_of_a_conv_graph(frame, adam):
    size, layers = GRAPHS["strided conv"]
    x = n(12, size)
    t = np.stack([x[:, 0], x[:, 7] - x[:, 30]], 1)
    trained, seen = gradients.graph_train(frame(x, t), "x", "t", layers, 25, 0.02, adam=adam)
    assert seen[0] == pytest.approx(losses(x, t, layers) / 12) and seen[-1] < seen[0] * 0.7
    assert losses(x, t, trained) / 12 < seen[-1] * 1.05


def test_dense_graphs_train_like_networks(spark, frame):
    w1, b1, w2, b2 = n(3, 4), n(4), n(4, 2), n(2)
    x, t = n(20, 3), n(20, 2)
    graph = [{"op": "dense", "w": w1, "b": b1}, {"op": "tanh"}, {"op": "dense", "w": w2, "b": b2}]
    got, _ = gradients.graph_train(frame(x, t), "x", "t", graph, 4, 0.01)
    want, _ = models.mlp_train(frame(x, t), "x", "t", [(w1, b1, 2), (w2, b2, 3)], 4, 0.01)
    assert np.allclose(got[0]["w"], want[0][0]) and np.allclose(got[2]["b"], want[1][1])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_attention_of_any_block(spark, block):
    """Blocks give what the whole sequence gives; null keys are passed over, null queries, sequences and repeated places keep their rows."""
    rows, want = [], []
    for seq, length in (("a", 1), ("b", 40), (None, 9)):
        q, k, v = n(length, 4) * 5, n(length, 4) * 5, n(length, 3)
        z = np.exp(q @ k.T / 2 - (q @ k.T / 2).max(1, keepdims=True))
        out = z @ v / z.sum(1, keepdims=True)
        rows += [(seq, i, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(length)]
        want += [(seq, i, out[i]) for i in range(length)]
    rows += [("b", 900, None, None, [1.0] * 3), ("b", 901, None, [9.0] * 4, None), ("c", 0, [1.0] * 4, None, None), ("b", 3, rows[4][2], None, None)]
    want += [("b", 900, None), ("b", 901, None), ("c", 0, None), ("b", 3, want[4][2])]
    df = spark.createDataFrame(rows, "seq string, pos long, q array<double>, k array<double>, v array<double>")
    got = models.attention(df, "seq", "pos", "string", block).collect()
    order = lambda r: (str(r[0]), r[1])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert order(a) == order(b) and (a["out"] is None) == (b[2] is None) and (b[2] is None or np.allclose(a["out"], b[2]))


def test_images_of_many_shapes_and_nulls(spark):
    x, y = n(2, 4, 5), n(1, 6, 6)
    rows = [(1, 2, 4, 5, x.ravel().tolist()), (2, 1, 6, 6, y.ravel().tolist()), (3, 1, 2, 2, None), (4, None, 2, 2, [1.0] * 4), (5, 2, 4, 5, (x + 1).ravel().tolist())]
    df = spark.createDataFrame(rows, "n long, c int, h int, w int, pixels array<double>")
    got = {r["n"]: r for r in models.maxpool(df).collect()}
    want = lambda v: v[:, : v.shape[1] // 2 * 2, : v.shape[2] // 2 * 2].reshape(v.shape[0], v.shape[1] // 2, 2, v.shape[2] // 2, 2).max((2, 4))
    for i, v in ((1, x), (2, y), (5, x + 1)):
        assert np.allclose(got[i]["pixels"], want(v).ravel()) and (got[i]["c"], got[i]["h"], got[i]["w"]) == want(v).shape
    assert got[3]["pixels"] is None and got[4]["pixels"] is None
    assert models.pad(models.upscale(df), 1).where("n = 2").first()["h"] == 14
    assert np.allclose({r["n"]: r for r in models.conv2d(df.where("c = 2 or c is null"), n(1, 2, 3, 3)).collect()}[1]["h"], 2)


def test_null_rows_of_products(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0]), (None, [1.0]), ([5.0, 6.0], None)], "x array<double>, g array<double>")
    assert {(r["i"], r["j"]): r["v"] for r in models.matmul_backward(df, "x", "g").collect()} == {(0, 0): 3.0, (1, 0): 6.0}
    assert models.matmul_backward(df.where(F.lit(False)), "x", "g").count() == 0
