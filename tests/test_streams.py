"""Votes over micro-batches against batch votes, with restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.operators import reduce
from tensorjobs.streaming import score as streaming

SCHEMA = "request string, value double, pos long, ts timestamp"


@pytest.fixture(scope="module")
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streaming.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def sample(seed):
    """(request, value, pos, second): results of a request lie within a minute; values near and far, repeated, null."""
    rng = random.Random(seed)
    rows = []
    for i in range(25):
        middle = rng.choice([10.0, 6200.0, -3.5])
        for j in range(rng.randint(1, 12)):
            value = rng.choice([middle, middle + rng.choice([0.01, -0.01, 0.005, 0.02]), middle + rng.uniform(-5, 5), None])
            rows.append((f"r{i}", value, j, rng.randint(0, 20)))
    return rows


def write(spark, path, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "request string, value double, pos long, s long")
        df.selectExpr("request", "value", "pos", "timestamp_seconds(s + 100000) AS ts").coalesce(1).write.parquet(f"{path}/{i:03}")  # rows at the first watermark, 0, would be late


def run(spark, path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    found = streaming.votes_by_timer(stream, "ts", **options)
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination(300)
    return {r["request"]: (r["value"], r["n"], r["agree"]) for r in spark.read.schema("request string, value double, n long, agree int").parquet(f"{path}/out").collect() if r["request"] != "end"}


@pytest.mark.parametrize("strategy", ["median", "quorum"])
def test_equal_to_batch_votes(stateful, tmp_path, strategy):
    """Rows split at random over micro-batches, with a restart from the checkpoint in between."""
    rows = sample(1 if strategy == "median" else 2)
    rng = random.Random(3)
    parts = [[] for _ in range(4)]
    for r in rows:
        rng.choice(parts).append(r)
    write(stateful, tmp_path / "in", [p + [("end", 0.0, 0, 20)] for p in parts[:2]])
    assert run(stateful, tmp_path, strategy=strategy, k=3) == {}
    later = [p + [("end", 0.0, 0, 20)] for p in parts[2:]] + [[("end", 0.0, 0, 4000)], [("end", 0.0, 0, 9000)]]
    for i, p in enumerate(later):
        write(stateful, tmp_path / f"in/later{i}", [p])
    got = run(stateful, tmp_path, strategy=strategy, k=3)
    df = stateful.createDataFrame(rows, "request string, value double, pos long, s long")
    if strategy == "median":
        want = {r["request"]: r["value"] for r in reduce.vote(df, ["request"]).collect()}
        assert {q: v for q, (v, _, _) in got.items()} == want
    else:
        want = {r["request"]: (r["value"], r["agree"]) for r in reduce.vote_quorum(df, ["request"], 3).collect()}
        assert {q: (v, a) for q, (v, _, a) in got.items()} == want
    n = {r["request"]: r["n"] for r in df.where("value IS NOT NULL").groupBy("request").agg(F.count("*").alias("n")).collect()}
    assert {q: c for q, (_, c, _) in got.items()} == n


def test_quorum_by_sorting():
    rng = np.random.default_rng(0)
    for _ in range(300):
        v = np.round(rng.choice([5.0, 6200.0]) + rng.integers(-5, 6, rng.integers(1, 15)) * 0.005, 3)
        pos = rng.permutation(len(v))
        count = (np.abs(v[:, None] - v[None]) <= 0.01).sum(1)
        best = min(range(len(v)), key=lambda i: (-count[i], pos[i]))
        assert streaming.quorum(v, pos, 0.01) == (v[best], count[best])


def test_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS request", "1.0 AS value", "0L AS pos", "timestamp AS ts")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if before != streaming.ROCKSDB:
        with pytest.raises(ValueError, match="providerClass"):
            streaming.votes_by_timer(stream, "ts")


def test_vote_stream_replaces_its_batches(spark, tmp_path):
    write(spark, tmp_path / "in", [[("a", 1.0, 0, 0), ("a", 3.0, 1, 0)], [("a", 9.0, 0, 0)]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for _ in range(2):
        streaming.vote_stream(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2.0, 9.0]


def test_windowed_votes(spark, tmp_path):
    write(spark, tmp_path / "in", [[("a", 1.0, 0, 0), ("a", 3.0, 1, 10), ("b", 5.0, 0, 400)], [("z", 0.0, 0, 9000)], [("z", 0.0, 0, 19000)]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    found = streaming.windowed_votes(stream, "ts", "request", "value")
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = {(r["request"], r["mean"], r["least"], r["largest"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got >= {("a", 2.0, 1.0, 3.0), ("b", 5.0, 5.0, 5.0)}
