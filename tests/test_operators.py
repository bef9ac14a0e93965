"""Golden values and edge cases of the operators on small fixtures."""

import inspect
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tensorjobs.functions import columns as C
from tensorjobs.operators import audit, corpus, evaluate, lint, lookup, models, reduce, signal, tensors, vectors
from tensorjobs.sources import files
from tensorjobs.streaming import score as streaming


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_ieee_comparisons_and_nulls(spark):
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    r = one(spark, C.relu(nan), C.relu(none), C.clamp(nan), C.cmpr(nan, 0, 0), C.decide(nan), C.decide(none), C.relu(F.lit(float("inf"))), reduce.reduce_row(arr(1, float("nan"), 3), 2))
    assert r[0] == 0 and r[1] is None and math.isnan(r[2]) and r[3] == 0 and r[4] == 0 and r[5] is None and r[6] == math.inf and r[7] == 3


def test_golden_elementwise(spark):
    r = one(spark, C.gelu(F.lit(1.0)), C.mod(F.lit(17), F.lit(5)), C.mod(F.lit(-17), F.lit(5)), C.ftoi(F.lit(3.7)), C.bnot(F.lit(0)), C.elementwise(arr(1, 2, 3, 4, 5, 6), arr(10, 20, 30), "add"))
    assert r[0] == pytest.approx(0.8411920, abs=1e-6) and r[1:5] == (2, -2, 3, -1) and r[5] == [11, 22, 33, 14, 25, 36]


@pytest.mark.parametrize("c", [0, 1, 2])
def test_errors(spark, c):
    bad = [lambda: C.elementwise(arr(1), arr(0), "div"), lambda: C.elementwise(arr(1, 2, 3), arr(1, 2), "add"), lambda: C.mod(F.lit(1), F.col("id").cast("int"))][c]
    with pytest.raises(PySparkException):
        spark.range(1).select(bad()).collect()


def test_softmax_losses_norms(spark):
    r = one(spark, reduce.softmax(arr(1, 2, 3, 4)), reduce.cross_entropy(arr(5, 0.5, 0.5), arr(1, 0, 0)), reduce.cross_entropy(arr(0.5, 0.5, 5), arr(1, 0, 0)))
    assert np.allclose(r[0], [0.0320586, 0.0871443, 0.2368828, 0.6439143], atol=1e-6)
    assert r[1] == pytest.approx(0.0219748, abs=1e-6) and r[2] == pytest.approx(4.5219748, abs=1e-6)
    a, b = arr(0.762757, 0.646685), arr(0.212950, 0.977063)
    r = one(spark, reduce.distance(a, b), reduce.distance(a, b, "euclid"), reduce.distance(arr(0, 0), b))
    assert r[0] == pytest.approx(0.205719, abs=1e-5) and r[1] == pytest.approx(0.641434, abs=1e-5) and r[2] == 1.0


def test_quorum_depends_on_precision(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([6200.0, 6200.01, 6199.98, 6200.0, 6150.0])], "request string, pos int, value double")
    assert reduce.vote_quorum(df, ["request"], 3).first()["agree"] == 0
    assert reduce.vote_quorum(df, ["request"], 3, as_float32=True).first()["agree"] == 1
    assert reduce.vote(df, ["request"]).first()["value"] == 6200
    assert reduce.vote_named(df.unionByName(spark.createDataFrame([("a", 9, None)], df.schema)), ["request"], strategy="unknown").first()["value"] == pytest.approx(6189.998)


def test_batch_norm(spark):
    rows = [(i, j, float(i * 3 + j + 1)) for i in range(4) for j in range(3)]
    params = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 1.0), (2, 0.5, -1.0)], "j int, gamma double, beta double")
    out = reduce.batch_norm(spark.createDataFrame(rows, "i int, j int, v double"), "j", "v", params).where("i = 0").orderBy("j").collect()
    assert np.allclose([r["normed"] for r in out], [-1.341640, -1.683280, -1.670821], atol=1e-5)


@pytest.mark.parametrize("net, amount", [(5000, 0), (10000, 360), (20000, 1393.5), (91400, 13614), (150000, 27311), (700000, 213652.25)])
def test_rates_agree(spark, net, amount):
    df = spark.createDataFrame([(float(net),)], "x double")
    assert lookup.rate_lookup(df, "x", lookup.brackets(spark)).first()["amount"] == pytest.approx(amount)
    assert df.select(lookup.rate_relu(F.col("x"))).first()[0] == pytest.approx(amount)


def test_matmul_and_shapes(spark):
    m = lambda rows: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")
    a, b = m([[1, 2, 3], [4, 5, 6]]), m([[1, 0], [0, 1], [1, 1]])
    cells = lambda df: {(r["i"], r["j"]): r["v"] for r in df.collect()}
    want = {(0, 0): 4, (0, 1): 5, (1, 0): 10, (1, 1): 11}
    assert cells(tensors.matmul(a, b)) == want == cells(tensors.matmul_blocked(a, b, 2))
    assert cells(tensors.reshape(a, 3, 3, 2, 2))[2, 1] == 6
    x, y = tensors.split(a, 1, 1, 3)
    assert cells(tensors.merge(x, y, 1, 1)) == cells(a)
    with pytest.raises(ValueError):
        tensors.reshape(a, 3, 4, 2, 2)
    src = spark.createDataFrame([(0, 10.0), (1, 20.0)], "i long, v double")
    idx = spark.createDataFrame([(0, 1), (1, 5)], "pos long, i long")
    assert tensors.gather(src, idx, strict=False).orderBy("pos").collect()[1]["v"] is None
    with pytest.raises(PySparkException):
        tensors.gather(src, idx).collect()
    new = spark.createDataFrame([(1, 0, 7.0), (1, 1, 8.0)], "i long, pos long, v double")
    assert {r["i"]: r["v"] for r in tensors.scatter(src, new).collect()} == {0: 10, 1: 8}


def test_signals(spark):
    x = [0, 0.707, 1, 0.707, 0, -0.707, -1, -0.707]
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id long, pos long, x double")
    y = [r["y"] for r in signal.fir(s, ["series_id"], "pos", "x", [0.25, 0.5, 0.25]).orderBy("pos").collect()]
    assert np.allclose(y, [0, 0.17675, 0.6035, 0.8535, 0.6035, 0, -0.6035, -0.8535])
    im = [r["im"] for r in signal.dft(s, "series_id", "pos", "x").orderBy("k").collect()]
    assert np.allclose(im, [0, -3.999698, 0, 0.000302, 0, -0.000302, 0, 3.999698], atol=1e-6)


def test_training_reaches_target(spark):
    df = spark.createDataFrame([([3.0], [7.0])], "features array<double>, label array<double>")
    layers, losses = models.tnet_train(df, "features", "label", np.array([[0.5, -0.3, 0.2, -0.1]]), np.full(4, 0.1), np.array([[0.4], [-0.2], [0.3], [0.1]]), np.zeros(1), epochs=100, lr=0.001)
    assert models.forward(np.array([[3.0]]), layers)[0, 0] == pytest.approx(6.994043, abs=1e-4) and losses[0] > losses[-1]


def test_linear_fit_of_prices(spark):
    sizes, prices = [600, 800, 1000, 1200, 1500, 1800, 2000], [150, 200, 250, 300, 375, 450, 500]
    df = spark.createDataFrame([(s / 2000, p / 500) for s, p in zip(sizes, prices)], "x double, y double")
    w, b = models.linear_fit(df, "x", "y", 0.1, 20000)
    assert w == pytest.approx(1, abs=1e-2) and b == pytest.approx(0, abs=1e-2)


def test_images(spark):
    px = [0.1, 0.2, 0.8, 0.9, 0.1, 0.3, 0.7, 0.8, 0.5, 0.6, 0.2, 0.1, 0.9, 0.8, 0.3, 0.2]
    df = spark.createDataFrame([(1, 1, 4, 4, px)], "n long, c int, h int, w int, pixels array<double>")
    k = np.array([[[[-1, -1, -1], [0, 0, 0], [1, 1, 1]]]], float)
    assert np.allclose(models.conv2d(df, k).first()["pixels"], [0.2, -1.0, 0.9, -0.5])
    assert models.maxpool(df).first()["pixels"] == [0.3, 0.9, 0.9, 0.3]
    assert models.pad(models.upscale(df), 1).first()["h"] == 10


def test_attention(spark):
    q = [[0.1, 0.2, 0.3, 0.4], [0.5, 0.6, 0.7, 0.8]]
    k = [[0.4, 0.3, 0.2, 0.1], [0.8, 0.7, 0.6, 0.5]]
    v = [[1, 0, 0.5, 0.2], [0, 1, 0.3, 0.7]]
    df = spark.createDataFrame([(1, i, q[i], k[i], [float(x) for x in v[i]]) for i in range(2)], "seq long, pos long, q array<double>, k array<double>, v array<double>")
    out = [r["out"] for r in models.attention(df, "seq", "pos").orderBy("pos").collect()]
    assert np.allclose(out, [[0.450166, 0.549834, 0.390033, 0.474917], [0.372852, 0.627148, 0.374570, 0.513574]], atol=1e-5)


def test_outliers_and_duplicates(spark):
    df = spark.createDataFrame([("a", f"k{i}", 1.0 + i % 2 * 0.01) for i in range(20)] + [("a", "k99", 9.0), ("b", "k1", 5.0), ("b", "k2", 6.0), *[("c", f"k{i}", 2.0) for i in range(5)]], "type string, key string, v double")
    assert [r["key"] for r in audit.outliers(df, "type", "key", "v").collect()] == ["k99"]
    lib = spark.createDataFrame([("00-000-0000-FIT-000", "x\ny"), ("01-000-0000-FIT-000", " x\ny \n"), ("00-000-0000-SIT-000", "z"), ("00-000-0000-CITY-001", "z")], "key string, text string")
    assert {r["key"] for r in audit.duplicate_content(lib).collect()} == {"00-000-0000-FIT-000", "01-000-0000-FIT-000"}
    assert audit.short_programs(lib).count() == 4


def test_structure_and_golden(spark):
    b = lambda rows: spark.createDataFrame(rows, "key string, status string, threshold double, rate double, cumulative double")
    old = b([("k", "s", 100.0, 0.1, 0.0), ("k", "s", 200.0, 0.2, 10.0), ("k", "s", 300.0, 0.3, 30.0)])
    new = b([("k", "s", 100.004, 0.1 + 1e-9, 0.0), ("k", "s", 200.006, 0.2 + 1e-7, 10.0)])
    assert sorted(r["category"] for r in audit.structure_diff(old, new).collect()) == ["bracket_removed", "rate_changed", "threshold_changed"]
    g = lambda rows: spark.createDataFrame(rows, "key string, vector int, output string, value double")
    golden = g([("a", 0, "o", 1.0), ("b", 0, "o", 1.0), ("b", 1, "o", 1.0), ("c", 0, "o", 1.0), ("d", 0, "o", 1.0)])
    actual = g([("a", 0, "o", 1.019), ("b", 0, "o", 1.021), ("b", 1, "o", 5.0)])
    programs = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r["key"]: r["status"] for r in audit.golden_check(actual, golden, programs).collect()} == {"a": "ok", "b": "value_mismatch", "c": "missing_output", "d": "error"}


RATES = """
ι @income
⋈ φ κ #1.5 #1.5
↘ #2
∎ γ #14600
→ #3
⋈ φ κ #0 #2.5
↘ #2
∎ γ #29200
→ #1
∎ γ #21900
⋈ φ κ #0 #1.5
↘ #8
∗ α π #0.10
→ #20
∎ α #1100
∎ γ #11000
⊖ ρ π γ
∗ ρ ρ #0.12
∎ α #5000
∎ γ #44000
⋈ φ κ #0 #2.5
↘ #6
∗ α π #0.10
∎ α #2200
∎ γ #22000
∗ ρ ρ #0.11
→ #4
⊕ α α ρ
∗ α π #0.10
∎ α #1700
∎ γ #17000
∗ ρ ρ #0.13
↑ α @tax
◼
"""


def test_rate_structure_text(spark):
    programs = [("k", RATES), ("flat", "ι @x\n∗ γ ι #0.045\n↑ γ @tax\n◼"), ("none", "◼"), ("null", None)]
    rows = [tuple(r) for r in audit.extract_rate_structure(spark.createDataFrame(programs, "key string, text string")).orderBy("key", "kind", "line").collect()]
    brackets = [(r[2], r[3], r[4], r[5], r[6]) for r in rows if r[0] == "k" and r[1] == "bracket"]
    assert brackets == [
        ("single", 0, 0.0, 0.10, 0.0), ("single", 1, 11000.0, 0.12, 1100.0), ("single", 2, 44000.0, 0.0, 5000.0), ("mfj", 0, 0.0, 0.10, 0.0), ("mfj", 1, 22000.0, 0.11, 2200.0),
        ("hoh", 0, 0.0, 0.10, 0.0), ("hoh", 1, 17000.0, 0.13, 1700.0),
    ]
    assert [(r[2], r[7]) for r in rows if r[1] == "deduction"] == [("single", 14600.0), ("mfj", 29200.0), ("default", 21900.0)]
    assert [(r[0], r[2], r[5], r[8]) for r in rows if r[1] == "flat"] == [("flat", "unknown", 0.045, 2)] and {r[0] for r in rows} == {"k", "flat"}


def test_signatures(spark):
    key = "00ff10"
    body = "LD R0 @x\nHALT"
    import hashlib
    import hmac

    sign = lambda text, k=key: hmac.new(bytes.fromhex(k), hashlib.sha256(text.encode()).hexdigest().encode(), "sha256").hexdigest()
    line = lambda s, k=key, a="hmac-sha256": f"✦  agent=me  key={a}:{k}  sig={s}"
    cases = {
        "valid": line(sign(body)) + "\n" + body + "\n", "mismatch": line(sign(body + "x")) + "\n" + body, "no signature": body, "unknown algorithm": line(sign(body), a="other") + "\n" + body,
        "unreadable": line(sign(body), k="zz") + "\n" + body,
    }
    rows = [(want, text) for want, text in cases.items()] + [("no signature", None), ("unreadable", "✦ nothing\n" + body)]
    for r in lint.verify_hmac(spark.createDataFrame(rows, "want string, text string")).collect():
        assert r["signature"] == r["want"]


def test_type_check(spark):
    rows = [("currency", "ratio", "multiply", True, "currency"), ("currency", "ratio", "add", False, "float"), ("bool", "bool", "add", False, "float"), ("float", "bool", "add", True, "bool"), ("count", "float", "divide", True, "count"), ("currency", "count", "divide", True, "currency"), (None, "count", "add", False, "float")]
    out = C.type_check(spark.createDataFrame(rows, "left_type string, right_type string, op string, want boolean, kind string")).collect()
    assert all((r["safe"], r["result_type"]) == (r["want"], r["kind"]) for r in out) and len(out) == len(rows)


def test_nulls_keep_rows(spark):
    g = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, v double")
    assert sorted(round(r["normed"], 3) for r in reduce.batch_norm(g, "k", "v").collect()) == [-1.0, -1.0, 1.0, 1.0]
    assert sum(r["softmax"] for r in reduce.softmax_by(g, ["k"], "v").collect()) == pytest.approx(2.0)
    d = spark.createDataFrame([("x", None, 1), ("x", 2, 2), ("y", None, 3), (None, 1, 4), (None, 5, 5)], "k string, o int, id int")
    assert {r["id"] for r in corpus.dedup_first(d, F.col("k"), "o").collect()} == {1, 3, 4}
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [5.0, 5.0])], "id int, x array<double>")
    assert [(r["cluster"], r["distance"]) for r in vectors.nearest_centroid(v, "x", np.array([[0.0, 0.0], [5.0, 5.0]])).orderBy("id").collect()] == [(0, 1.0), (None, None), (1, 0.0)]
    tree = {0: [{"node": 0, "feature": 0, "threshold": 1.0, "left": 1, "right": 2, "leaf": None}, {"node": 1, "feature": None, "threshold": None, "left": None, "right": None, "leaf": 3.0}, {"node": 2, "feature": None, "threshold": None, "left": None, "right": None, "leaf": 4.0}]}
    assert [r["score"] for r in models.trees_score(v, "x", tree).orderBy("id").collect()] == [3.0, None, 4.0]


def test_graph_score(spark):
    """Convolution, bias, relu, residual, average pooling, dense and softmax against numpy."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, 32))
    kernel, w = rng.standard_normal((2, 2, 3, 3)), rng.standard_normal((8, 3))
    graph = [{"op": "reshape", "shape": (2, 4, 4), "name": "in"}, {"op": "conv", "kernel": kernel, "bias": [0.1, -0.2], "padding": 1}, {"op": "relu"}, {"op": "add", "with": "in"}, {"op": "avgpool", "size": 2}, {"op": "flatten"}, {"op": "dense", "w": w}, {"op": "softmax"}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())] + [(9, None)], "id int, f array<double>")
    got = [r["score"] for r in models.graph_score(df, "f", graph).orderBy("id").collect()]
    for row, out in zip(x.reshape(5, 2, 4, 4), got[:5], strict=True):
        p = np.pad(row, ((0, 0), (1, 1), (1, 1)))
        c = np.array([[[(p[:, i : i + 3, j : j + 3] * kernel[o]).sum() + [0.1, -0.2][o] for j in range(4)] for i in range(4)] for o in range(2)])
        y = np.maximum(c, 0) + row
        z = y.reshape(2, 2, 2, 2, 2).mean((2, 4)).ravel() @ w
        assert out == pytest.approx((np.exp(z - z.max()) / np.exp(z - z.max()).sum()).tolist())
    assert got[5] is None
    with pytest.raises(Exception):
        models.graph_score(df, "f", [{"op": "fly"}]).collect()


def test_golden_round_trip_and_splits(spark, tmp_path):
    rows = [("a", "FIT", 0, "o", 1.0), ("a", "FIT", 1, "o", 2.0), ("a", "FIT", 1, "p", 3.0), ("b", "SIT", 0, "o", 4.0)]
    golden = spark.createDataFrame(rows, "key string, type string, vector int, output string, value double")
    path = str(tmp_path / "golden")
    files.write_golden(golden, path)
    read = lambda: sorted(tuple(r) for r in files.read_golden(spark, path).collect())
    assert read() == rows
    (tmp_path / "golden" / "c.json").write_text('{\n "key": "c", "type": "FIT",\n "test_vectors": [{"inputs": {"x": 1}, "expected": {"o": 5}}]\n}')
    assert read() == [*rows, ("c", "FIT", 0, "o", 5.0)]
    d = spark.createDataFrame([(1, "train", 7), (2, "test", 8)], "id int, split string, _h int")
    files.write_splits(d, str(tmp_path / "splits"))
    back = spark.read.json(str(tmp_path / "splits"))
    assert sorted(back.columns) == ["id", "split"] and {(r["id"], r["split"]) for r in back.collect()} == {(1, "train"), (2, "test")}
    with pytest.raises(ValueError):
        files.union_sources({})
    chat = spark.createDataFrame([([("user", "a\r\nb")], None, None), (None, "do", "done")], "messages array<struct<role:string,content:string>>, instruction string, output string")
    lines = files.corpus_lines(chat, spark.createDataFrame([("x\ny",)], "text string")).collect()
    assert sorted((r["source"], r["line"]) for r in lines) == [("alpaca", "do"), ("alpaca", "done"), ("chat", "a"), ("chat", "b"), ("program", "x"), ("program", "y")]


def test_samples_and_dropout(spark):
    df = spark.range(1000)
    a, b = (corpus.sample_n(df, F.col("id"), 50, 7).collect() for _ in range(2))
    assert a == b and len({r["id"] for r in a}) == 50
    assert corpus.pad_to(df.limit(10), df, F.col("id"), 30).count() == 30 and corpus.pad_to(df, df, F.col("id"), 30).count() == 1000
    parts = {r["split"]: r["count"] for r in corpus.split_90_10(df, F.col("id")).groupBy("split").count().collect()}
    assert parts["train"] + parts["valid"] == 1000 and 850 < parts["train"] < 950
    x = df.select("id", F.expr("transform(sequence(1, 20), x -> cast(x as double))").alias("x"))
    out = x.select("id", "x", C.dropout(F.col("x"), 0.25, 3, F.col("id")).alias("y")).collect()
    assert all(v == 0 or v == pytest.approx(u / 0.75) for r in out for u, v in zip(r["x"], r["y"], strict=True))
    assert 0.23 < sum(v == 0 for r in out for v in r["y"]) / 20_000 < 0.27
    t = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id int, id int")
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id int, vector array<double>")
    p = {r["doc_id"]: r["class"] for r in models.embed_pool_classify(t, table, 2, np.array([[0.0, 1.0], [0.0, 3.0]]), np.array([0.9, 0.0])).collect()}
    assert p == {1: 1, 2: 1}


def test_lint(spark):
    arity = spark.createDataFrame([("LD", 2, 2), ("ST", 2, 2), ("JUMP", 1, 1), ("HALT", 0, 0), ("FRAG", 1, 1), ("ENDF", 0, 0)], "word string, low int, high int")
    programs = spark.createDataFrame([
        ("ok", "LD R0 @x ; load\nST R0 @y\nHALT"), ("word", "LDD R0 @x\nST R0 @y\nHALT"), ("count", "LD R0\nST R0 @y\nHALT"), ("jump", "JUMP #9\nST R0 @y\nHALT"), ("halt", "ST R0 @y"),
        ("empty", "; nothing\n\n"), ("endf", "ENDF\nST R0 @y\nHALT"), ("open", "FRAG f\nST R0 @y\nHALT"), ("quiet", "LD R0 @x\nHALT"),
    ], "key string, text string")
    found = {(r["key"], r["kind"]) for r in lint.lint_lines(programs, arity, ["JUMP"], ["HALT"], ["ST"]).collect()}
    assert found == {("word", "invalid_opcode"), ("count", "wrong_operand_count"), ("jump", "invalid_jump"), ("halt", "missing_halt"), ("empty", "empty_program"), ("endf", "unmatched_endf"), ("open", "unclosed_fragment"), ("quiet", "no_output")}
    s = lint.suggest_word(spark.createDataFrame([("LDD",), ("QQQQQQQQ",)], "word string"), ["LD", "ST", "HALT"]).collect()
    assert {r["word"]: r["suggestion"] for r in s} == {"LDD": "LD", "QQQQQQQQ": None}
    assert lint.suggest_word(spark.createDataFrame([("XD",)], "word string"), ["ZD", "LD", "AD"]).first()["suggestion"] == "ZD"  # of equals the first


def test_patch_round_trip(spark):
    cases = [("a\nb\nc", "a\nx\nc\nd"), ("a\nb\nc\nd", "b\nd"), ("", "x\ny"), ("one", "one"), ("a\nb\nc\nd\ne", "z\na\nq\nr\ne")]
    pairs = spark.createDataFrame([(str(i), o, n) for i, (o, n) in enumerate(cases)], "key string, old string, new string")
    out = lint.apply_patch(pairs.select("key", F.col("old").alias("text")), lint.make_patch(pairs)).collect()
    assert {r["key"]: (r["text"], r["status"]) for r in out} == {str(i): (n, "ok") for i, (_, n) in enumerate(cases)}


def test_chat_normalisation(spark):
    m = "messages array<struct<role:string,content:string>>, instruction string, input string, output string, file string, pos long"
    df = spark.createDataFrame([([("user", "q"), ("assistant", "a")], None, None, None, "f", 0), (None, " i ", "x", "o\t", "f", 1), (None, "i", None, "o", "f", 2), (None, None, None, None, "f", 3), ([("system", "s"), ("user", "q"), ("assistant", "a")], None, None, None, "f", 4)], m)
    out = corpus.build_corpus(df, "sys", ["LD"]).orderBy("pos").collect()
    assert [(r["pos"], r["system"], r["user"], r["assistant"]) for r in out] == [(0, "sys", "q", "a"), (1, "sys", "i\nx", "o"), (2, "sys", "i", "o")]


def test_pairs_and_attempts(spark):
    c = spark.createDataFrame([("p", 0, "a", 1), ("p", 1, "b", 2), ("p", 2, "c", 2), ("p", 3, "d", 0), ("q", 0, "a", 1), ("q", 1, "b", 1), ("r", 0, "a", 2)], "prompt string, pos int, text string, score int")
    assert [tuple(r) for r in evaluate.best_worst_pair(c).collect()] == [("p", "b", "d")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.data").write_text("# c\n\n@x shape=2,2 dtype=f64 data=1,2,3\n@y shape=2 dtype=i32 data=1.9,-1.9,5\n@x shape=1 data=0.1\n")
    t = files.read_named_tensors(spark, str(tmp_path / "t"))
    got = {r["name"]: (r["dtype"], r["shape"], r["data"]) for r in t.collect()}
    assert got["y"] == ("i32", [2], [1.0, -1.0]) and got["x"] == ("f32", [1], [float(np.float32(0.1))])
    files.write_named_tensors(t, str(tmp_path / "out"))
    again = {r["name"]: (r["dtype"], r["shape"], r["data"]) for r in files.read_named_tensors(spark, str(tmp_path / "out")).collect()}
    assert again == got
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"messages":[{"role":"user","content":"q"}]}\n\nnot json\n{"instruction":"i","output":"o"}\n')
    assert files.read_chat_jsonl(spark, str(tmp_path / "c")).count() == 2
    (tmp_path / "m.json").write_text('{"jurisdictions": ["a", 1, "b"]}')
    assert {r["key"] for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {"a", "b"}
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "00-000-0000-FIT-000.txt").write_text("x\ny")
    assert files.read_library(spark, str(tmp_path / "lib"), "FIT").first()["place"] == "00-000-0000"


def test_stream_scores_like_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 10.0, 5.0 - i) for i in range(10)], "id long, a double, b double")
    df.write.parquet(str(tmp_path / "in"))
    scorer = models.Scorer([(np.array([[1.0], [0.5]]), np.array([-0.5]), 1)])
    stream = streaming.score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), scorer, ["a", "b"], [1.0, 5.0])
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["id"]: (round(r["score"], 9), r["decision"]) for r in spark.table("scored").collect()}
    want = {r["id"]: (round(r["score"], 9), r["decision"]) for r in streaming.score_stream(df, scorer, ["a", "b"], [1.0, 5.0]).collect()}
    assert got == want and len(got) == 10


def test_kmeans_and_projection(spark):
    rows = [(i, [float(i % 2 * 10 + i / 100), 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centers, out = vectors.kmeans(df, "v", 2)
    groups = {frozenset(r["id"] % 2 for r in out.where(f"cluster = {c}").collect()) for c in (0, 1)}
    assert groups == {frozenset([0]), frozenset([1])}
    assert np.allclose(sorted(centers[:, 0]), [0.09, 10.10])  # the means of even and odd rows
    p = vectors.project(spark.createDataFrame([([0.5, 0.3, 0.8, 0.1],), (None,)], "f array<double>"), "f", np.array([[1, 0], [0, 1], [0.5, 0.5], [0.2, 0.8]])).collect()
    assert np.allclose(p[0]["projected"], [0.762757, 0.646685], atol=1e-5) and p[1]["projected"] is None


def test_local_training_in_parts(spark):
    """As each worker's rows trained alone, though no task gets a worker whole."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 2 else "ab"[i % 3], [float(x) for x in rng.random(2)], [float(rng.random())]) for i in range(120)]
    layers = [(rng.random((2, 2)), rng.random(2), 2), (rng.random((2, 1)), rng.random(1), 3)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y array<double>").repartition(7)
    want = []
    for k in ("a", "b", None):
        x, y = (np.array([r[j] for r in rows if r[0] == k]) for j in (1, 2))
        ls = [(w.copy(), b.copy(), a) for w, b, a in layers]
        for _ in range(5):
            _, g = models._gradients(x, y, ls)
            for p, step in zip([p for w, b, _ in ls for p in (w, b)], g, strict=True):
                p -= 0.1 * step / len(x)
        want.append(np.concatenate([p.ravel() for w, b, _ in ls for p in (w, b)]))
    for strategy, f in ((0, np.median), (1, np.mean)):
        got = models.local_train_then_vote(df, "g", "x", "y", layers, 5, 0.1, strategy)
        assert np.allclose(np.concatenate([p.ravel() for w, b, _ in got for p in (w, b)]), f(want, axis=0))
    assert "applyInPandas" not in inspect.getsource(models.local_train_then_vote)


def test_equalize_ranks_in_buckets(spark):
    """No window over a whole word; copies as even as they can be."""
    words = spark.createDataFrame([("big" if i % 10 else "small", i) for i in range(500)], "word string, key long")
    targets = spark.createDataFrame([("big", 1000), ("small", 120), ("none", 5)], "word string, target long")
    out = corpus.equalize(words.select("key"), words, targets)
    n = {}
    for r in out.collect():
        n.setdefault(r["word"], {}).setdefault(r["key"], []).append(r["copy"])
    assert {w: (len(k), sum(map(len, k.values()))) for w, k in n.items()} == {"big": (450, 1000), "small": (50, 120)}
    assert {len(c) for c in n["big"].values()} == {2, 3} and {len(c) for c in n["small"].values()} == {2, 3}
    ranked = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line]
    assert ranked and all("_b#" in line for line in ranked)


def test_session_votes(spark, tmp_path):
    """A request whose results come in two micro-batches gets one vote."""
    schema = "request string, value double, ts timestamp"
    for i, rows in enumerate([[("a", 1.0, 0), ("b", 5.0, 0)], [("a", 3.0, 20)], [("z", 0.0, 3600)], [("z", 0.0, 7200)]]):
        spark.createDataFrame(rows, "request string, value double, s int").selectExpr("request", "value", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = streaming.session_votes(stream, "ts").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = {r["request"]: (r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["request"] != "z"}
    assert got == {"a": (2.0, 2), "b": (5.0, 1)}


def test_semantic_checks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = audit.semantic_checks(
        frame([("p", "x"), ("p", "y"), ("q", "x")], "key string, name string"), frame([("p", "x"), ("q", "x")], "key string, name string"), frame([("p",)], "key string"),
        frame([("p", "FIT", "single"), ("q", "XYZ", None)], "key string, type string, status string"), frame([("single",), ("mfj",)], "status string"),
    )
    assert sorted(tuple(r) for r in found.select("key", "kind", "severity").collect()) == [("p", "missing_status", "warning"), ("p", "unused_input", "warning"), ("q", "missing_output", "error")]
    priors = frame([(0, -0.7), (1, -0.7)], "class int, logp double")
    out = models.naive_bayes_score(frame([(1, "a"), (2, "z")], "doc_id int, word string"), frame([("a", 0, -1.0), ("a", 1, -3.0)], "word string, class int, logp double"), priors)
    got = {(r["doc_id"], r["class"]): round(r["probability"], 4) for r in out.collect()}
    assert got == {(1, 0): 0.8808, (1, 1): 0.1192, (2, 0): 0.5, (2, 1): 0.5}


def test_signals_over_passes(spark):
    """Several passes add up to what one pass finds; ties go to the rank, null signals match nothing."""
    texts = spark.createDataFrame([(1, "a tax on wage and rent"), (2, "RENT due"), (3, None), (4, "none"), (5, "")], "doc_id long, text string")
    rows = [("p", 0, "tax"), ("p", 0, "wage"), ("q", 1, "rent"), ("q", 1, "wage"), ("r", 2, "due"), ("q", 1, None), (None, 3, "a"), ("s", 4, "Tax")]
    signals = spark.createDataFrame(rows, "problem_id string, rank int, signal string")
    want = {(1, "p", 2, 1), (1, "q", 2, 2), (2, "q", 1, 1), (2, "r", 1, 2)}
    for block in (10_000, 2, 1):
        got = lookup.signal_match(texts, signals, block=block)
        assert got.columns == ["doc_id", "problem_id", "hits", "place"] and {tuple(r) for r in got.collect()} == want
    assert lookup.signal_match(texts, signals.where("false")).count() == 0


def test_model_pivot_of_all_models(spark):
    rows = [("x", "m1", True), ("x", "m1", False), ("x", "m2", True), ("y", "m2", False), ("y", None, True)]
    df = spark.createDataFrame(rows, "cat string, model string, execute boolean")
    assert {tuple(r) for r in evaluate.model_pivot(df).select("cat", "m1", "m2").collect()} == {("x", 0.5, 1.0), ("y", None, 0.0)}
    assert evaluate.model_shares(df).count() == 4
