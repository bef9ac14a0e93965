"""What the third review found: each test failed before."""

import inspect

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.operators import lookup, models, reduce, vectors
from tensorjobs.plans.queries import QUERIES, SQL
from tensorjobs.sources import files


def test_attention_per_label_as_its_sql(spark, tmp_path):
    """Small negative components, null ids and null vectors; lists are compared as written, so the sign of a zero counts."""
    e = [-3e-8] + [0.25] * 63
    rows = [(1, e, 1), (2, [-1e-8] * 64, 1), (3, None, 1), (None, e, 1), (205, None, None), (300, [4e-8] * 64, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(repr((x["pos"], x["out"])) for x in QUERIES["attention_per_label"](spark, str(tmp_path)).collect())
    embeddings = duckdb.read_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841  read by the SQL
    want = sorted(repr((pos, out)) for pos, out in duckdb.sql(f"SELECT pos, out FROM ({SQL['attention_per_label']})").fetchall())
    assert got == want and "-0.0" in got[0]


def test_attention_in_tiles(spark, monkeypatch):
    """Rows go once to a block of 16,384; scores are made a tile at a time, with the same result."""
    assert inspect.signature(models.attention).parameters["block"].default >= 16_384
    monkeypatch.setattr(models, "TILE", 7)
    x = np.random.default_rng(1).standard_normal((40, 3))
    df = spark.createDataFrame([(0, i, v, v, v) for i, v in enumerate(x.tolist())], "seq long, pos long, q array<double>, k array<double>, v array<double>")
    got = np.array([r["out"] for r in models.attention(df, "seq", "pos").orderBy("pos").collect()])
    w = np.exp(x @ x.T / np.sqrt(3))
    assert got == pytest.approx(w @ x / w.sum(1, keepdims=True))


def test_nearest_in_tiles(spark, monkeypatch):
    """A task makes a few rows of distances at a time."""
    monkeypatch.setattr(vectors, "TILE", 50)
    x = np.random.default_rng(2).standard_normal((60, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = sorted((r["query_id"], r["vec_id"]) for r in vectors.pairwise_nearest(df.where("id % 3 = 0"), df, 2, "euclid").collect())
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 60)
    assert got == sorted((i, int(j)) for i in range(0, 60, 3) for j in np.argsort(d[i])[:2])


def test_moments_of_few_groups_are_sent_along(spark):
    """Else all rows of a group meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = reduce.batch_norm(spark.range(10).select((F.col("id") % 2).alias("c"), F.col("id").cast("double").alias("v")), "c", "v")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_local_training_packs_rows(spark, monkeypatch):
    """Rows of workers are packed once, in blocks of whatever size."""
    monkeypatch.setattr(models, "PACK", 7)
    x = np.random.default_rng(3).standard_normal((50, 2))
    y, w = x @ [0.5, -1.0] + 0.3, np.zeros((3, 3))
    df = spark.createDataFrame([(i % 3 or None, a, [b]) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "k int, x array<double>, y array<double>")
    (got, bias, _), *_ = models.local_train_then_vote(df, "k", "x", "y", [(np.zeros((2, 1)), np.zeros(1), 3)], 5, 0.1)
    for k in range(3):
        a = np.c_[x, np.ones(50)][k::3]
        for _ in range(5):
            w[k] -= 0.2 * a.T @ (a @ w[k] - y[k::3]) / len(a)
    assert [*got[:, 0], bias[0]] == pytest.approx(np.median(w, axis=0))
    assert b"".join(r["x"] for r in spark.createDataFrame([(1, [0.5], [1.0])] * 20, "_i long, x array<double>, y array<double>").mapInArrow(models._packed("x", "y"), "_i long, n long, x binary, y binary").collect()) == np.full(20, 0.5).tobytes()


def test_tensors_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """The number of tasks that sort tensors by name follows the size of the files; the later of equal names holds."""
    monkeypatch.setattr(files, "PART", 100)
    (tmp_path / "t.txt").write_text("".join(f"@n{i % 90} shape=1 dtype=f64 data={i}\n" for i in range(100)))
    df = files.read_named_tensors(spark, str(tmp_path / "t.txt"))
    assert df.rdd.getNumPartitions() > 20
    assert {r["name"]: r["data"] for r in df.collect()} == {f"n{i % 90}": [float(i)] for i in range(100)}


def test_next_threshold_in_bins(spark):
    """No task sorts all thresholds of a key."""
    rows = [(k, float(v * v % 9973)) for k in ("a", "b", None) for v in range(300 if k else 20)]
    df = spark.createDataFrame(rows, "k string, at double").distinct()
    plain = df.withColumn("up", F.expr("lead(at) OVER (PARTITION BY k ORDER BY at)"))
    assert sorted(map(repr, lookup.following(df, ["k"], "at", "up", each=10).collect())) == sorted(map(repr, plain.collect()))


def test_filled_in_many_tasks(spark, monkeypatch):
    """Bins are found in numpy, the sort's tasks follow the rows; bins with many rows are dealt out."""
    monkeypatch.setattr(lookup, "TASK", 50)
    at = [float(i * 37 % 1000) / 4 for i in range(600)]
    x = [None, -1.0, float("nan"), *[i * 0.37 for i in range(800)], *[50.0] * 400]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(at)], "at double, n long")
    found = lookup.asof_lookup(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double"), "x", table, "at", "b", few=2, fill=100, bins=5)
    assert found.rdd.getNumPartitions() > 20
    got = {r["i"]: r["b"] and (r["b"]["at"], r["b"]["n"]) for r in found.collect()}
    last = {v: i for i, v in enumerate(at)}
    below = lambda v: None if v is None or v < 0 else max(a for a in last if not a > v)
    assert len(got) == len(x) and got == {i: (m := below(v)) if v is None or v < 0 else (m := below(v), last[m]) for i, v in enumerate(x)}
