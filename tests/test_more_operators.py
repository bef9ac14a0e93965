"""Medians by counting, many signals, spelling from large vocabularies, null keys and vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.functions import columns as C
from tensorjobs.operators import audit, corpus, lint, lookup, models, reduce, tensors, vectors


@pytest.mark.parametrize("huge", [10, 10**9])
def test_median_of_any_group(spark, huge):
    rng = random.Random(0)
    values = [float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, -5e-324, 1e308, -1.5, 2.5, None]
    rows = [(k, rng.choice(values) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300)) for k in ("a", "b", None) for _ in range(rng.choice([301, 400]))]
    rows += [("c", 7.25)] * 50 + [("d", -0.0)] * 12 + [("e", float(i)) for i in range(9)] + [("f", None)] * 20 + [("g", float("nan"))] * 11
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    got = {r["k"]: r["value"] for r in reduce.median(df, ["k"], huge=huge).collect()}
    want = {r["k"]: r["m"] for r in df.where("value IS NOT NULL").groupBy("k").agg(F.median("value").alias("m")).collect()}
    assert got.keys() == want.keys() and np.array_equal([got[k] for k in want], list(want.values()), equal_nan=True)


def test_median_of_ten_million(spark):
    """No values are gathered: the plan has no aggregate that holds a list of them."""
    df = spark.range(10_000_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 10_000_019 * 1.5).alias("value"))
    out = reduce.median(df, ["k"])
    assert "percentile" not in out.where("k = 'k'")._jdf.queryExecution().executedPlan().toString().split("Union")[-1].split("HashAggregate")[0]
    assert out.first()["value"] == np.median((np.arange(10_000_000) * 7919) % 10_000_019 * 1.5)


def brute_signals(texts, rows, top=3):
    ranks, by = {}, {}
    for p, rank, s in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[0], r[2])):
        ranks.setdefault(p, rank)
        by.setdefault(p, []).append(s)
    out = set()
    for i, t in texts:
        hits = [(-sum(s in (t or "").lower() for s in found) if t is not None else 0, (ranks[p] is not None, ranks[p] or 0), p) for p, found in by.items()]
        out |= {(i, p, -n, k + 1) for k, (n, _, p) in enumerate(sorted(h for h in hits if h[0])[:top])}
    return out


@pytest.mark.parametrize(("each", "block"), [(0, 10**6), (10**6, 10**6), (0, 70), (3, 11)])
def test_signals_by_automaton(spark, each, block):
    """Overlapping, nested, repeated and empty signals; expressions, one automaton and several passes agree."""
    rng = random.Random(each + block)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = [(f"p{rng.randrange(9)}", rng.choice([None, 0, 1, 2]), word(rng.randint(1, 4))) for _ in range(200)] + [("p1", 5, ""), (None, 1, "a"), ("p2", 1, None), ("p3", 1, "A"), ("p4", 0, "ab"), ("p4", 0, "ab")]
    texts = [(i, word(rng.randint(0, 30)).title()) for i in range(40)] + [(90, None), (91, ""), (92, "ab" * 50_000)]
    got = lookup.signal_match(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "problem_id string, rank int, signal string"), block=block, each=each)
    assert {tuple(r) for r in got.collect()} == brute_signals(texts, rows)


def test_fifty_thousand_signals(spark):
    signals = spark.range(50_000).select((F.col("id") % 1000).cast("string").alias("problem_id"), F.lit(0).alias("rank"), F.concat(F.lit("s"), "id", F.lit("e")).alias("signal"))
    texts = spark.createDataFrame([(i, " ".join(f"S{(i * 37 + j * 1009) % 60_000}E" for j in range(30))) for i in range(200)], "doc_id long, text string")
    got = lookup.signal_match(texts, signals)
    assert {tuple(r)[:3] for r in got.where("place = 1").collect()} and got.where("hits = 1 AND place = 1").count() + got.where("hits > 1 AND place = 1").count() == 200


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_suggestions_from_a_table(spark):
    """Short, long and very long words near the limits, ties by place, words of other alphabets, none near."""
    rng = random.Random(1)
    letters = "ABCDÉ"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    known = list(dict.fromkeys([word(rng.randint(1, 7)) for _ in range(60)] + [word(n) for n in (17, 20, 21, 22, 23, 26, 40)] + ["LOAD", "STORE", ""]))

    def changed(w):
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        return w

    asked = [changed(rng.choice(known)) for _ in range(150)] + [changed(w) for w in known if len(w) > 15 for _ in range(6)] + ["load", "lodx", "zzzzzzzz", "", None, "x", "st", "W" * 200]
    places = list(range(len(known)))
    rng.shuffle(places)
    vocabulary = spark.createDataFrame(list(zip(known, places, strict=True)) + [(None, 1), (known[0], 10**6)], "word string, place int")
    got = {r["word"]: r["suggestion"] for r in lint.suggest_word_from(spark.createDataFrame([(w,) for w in asked], "word string"), vocabulary).collect()}
    want = {}
    for w in {w for w in asked if w is not None}:
        d, _, v = min((distance(w.upper(), v), p, v) for v, p in zip(known, places, strict=True))
        want[w] = v if d <= (2 if len(w) <= 4 else 3) else None
    assert got == want
    order = [v for _, v in sorted(zip(places, known, strict=True))]
    listed = {r["word"]: r["suggestion"] for r in lint.suggest_word(spark.createDataFrame([(w,) for w in want], "word string"), order).collect()}
    assert got == listed


def test_structure_of_null_status(spark):
    b = lambda rows: spark.createDataFrame(rows, "key string, status string, threshold double, rate double, cumulative double")
    old = b([("k", None, 100.0, 0.1, 0.0), (None, None, 5.0, 0.1, 0.0), ("k", "s", 1.0, 0.1, 0.0)])
    new = b([("k", None, 100.0, 0.1, 0.0), (None, None, 6.0, 0.1, 0.0)])
    got = {(r["key"], r["status"], r["category"]) for r in audit.structure_diff(old, new).collect()}
    assert got == {(None, None, "threshold_changed"), ("k", "s", "bracket_removed")}


def test_value_diff(spark):
    """Flat rates and deductions that change, come and go; null statuses are a status."""
    v = lambda rows: spark.createDataFrame(rows, "key string, status string, value double")
    old = v([("k", None, 0.1), ("k", "a", 0.1), ("k", "b", 0.2), ("k", "c", 0.3), (None, "a", 1.0)])
    new = v([("k", None, 0.1), ("k", "a", 0.1 + 1e-9), ("k", "b", 0.2 + 1e-7), ("k", "d", 0.3), (None, "a", 2.0)])
    got = {(r["key"], r["status"], r["category"]) for r in audit.value_diff(old, new, "flat_rate", audit.TOL_RATE).collect()}
    assert got == {("k", "b", "flat_rate_changed"), ("k", "c", "flat_rate_removed"), ("k", "d", "flat_rate_added"), (None, "a", "flat_rate_changed")}


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, f"k{i}", 1.0 + i % 3 * 0.01) for i in range(20)] + [(None, "far", 101.0)], "g string, k string, v double")
    assert [r["k"] for r in audit.outliers(df, "g", "k", "v").collect()] == ["far"]
    words = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "word string, key long")
    targets = spark.createDataFrame([(None, 5), ("a", 1), ("b", 2)], "word string, target long")
    n = {}
    for r in corpus.equalize(words.select("key"), words, targets).collect():
        n[r["word"]] = n.get(r["word"], 0) + 1
    assert n == {None: 5, "a": 1}
    assert {r["word"]: r["missing"] for r in corpus.deficits(words, targets).collect()} == {None: 3, "a": 0, "b": 2}


def test_null_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in vectors.pairwise_nearest(df, df, 1, block=2).collect()}
    assert got == {(1, 2), (2, 1), (4, 2)}
    assert vectors.pairwise_nearest(df.where("id = 3"), df, 2).count() == 0


def test_conversions_and_rows_under_a_matrix(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [10.0, 20.0, 30.0], 3, 7)], "a array<double>, b array<double>, n int, k int")
    row = df.select(C.broadcast_rows(F.col("a"), F.col("b"), F.col("n"), "add").alias("sum"), C.itof(F.col("k")).alias("k")).first()
    assert row["sum"] == [11.0, 22.0, 33.0, 14.0, 25.0, 36.0] and row["k"] == 7.0 and isinstance(row["k"], float)


def test_packed_tensors_as_coordinates(spark):
    df = spark.createDataFrame([("m", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("v", [2], [7.0, 8.0]), ("e", [0], [])], "name string, shape array<int>, data array<double>")
    got = {(r["name"], r["i"], r["j"]): r["v"] for r in tensors.packed_to_coordinates(df).collect()}
    assert got == {("m", i, j): 3.0 * i + j + 1 for i in range(2) for j in range(3)} | {("v", 0, j): 7.0 + j for j in range(2)}


def test_nearest_centroid_as_expression(spark):
    rng = np.random.default_rng(0)
    x, c = rng.standard_normal((40, 3)), rng.standard_normal((4, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = {r["id"]: r["k"] for r in df.select("id", vectors.nearest_sql(F.col("v"), c.tolist()).alias("k")).collect() if r["id"] < 99}
    want = {r["id"]: r["cluster"] for r in vectors.nearest_centroid(df, "v", c).collect() if r["id"] < 99}
    assert got == want == {i: int(((c - v) ** 2).sum(1).argmin()) for i, v in enumerate(x)}


def test_models_from_tables(spark):
    """Layers from rows in any order, a scorer from packed tensors; a missing tensor is an error."""
    w1, b1, w2, b2 = np.arange(6.0).reshape(2, 3) / 10, np.ones(3), np.array([[1.0], [-1.0], [0.5]]), np.array([0.2])
    rows = [{"layer": 1, "w": w2.ravel(), "b": b2, "rows": 3, "cols": 1, "act": 3}, {"layer": 0, "w": w1.ravel(), "b": b1, "rows": 2, "cols": 3, "act": 0}]
    layers = models.layers_of(rows)
    x = np.array([[1.0, 2.0], [-3.0, 0.5]])
    want = models.forward(x, [(w1, b1, 0), (w2, b2, 3)])
    assert np.allclose(models.forward(x, layers), want)
    with pytest.raises(ValueError, match="10 layers"):
        models.layers_of(rows * 6)
    t = spark.createDataFrame([("w1", [2, 3], w1.ravel().tolist()), ("b1", [1, 3], b1.tolist()), ("w2", [3, 1], w2.ravel().tolist()), ("b2", [1], b2.tolist()), ("other", [1], [0.0])], "name string, shape array<int>, data array<double>")
    scorer = models.Scorer.from_tensors(t, [("w1", "b1", 0), ("w2", "b2", 3)])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "features array<double>")
    got = [r["score"] for r in scorer.score(df).collect()]
    assert np.allclose(got[:2], want) and got[2] is None
    with pytest.raises(KeyError):
        models.Scorer.from_tensors(t, [("w3", "b1", 0)])


def test_composition(spark):
    """Operators chain by df.transform."""
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "pos long, k string, value double")
    out = df.transform(reduce.softmax_by, ["k"], "value").transform(reduce.vote, ["k"], "softmax")
    assert {r["k"]: round(r["value"], 6) for r in out.collect()} == {"a": 0.5, "b": 1.0}
