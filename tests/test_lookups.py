"""As-of lookups and rate tables with many brackets."""

import random

import pytest
from pyspark.sql import functions as F

from tensorjobs.operators import lookup


def brute(rows, table, keyed):
    out = []
    for k, x in rows:
        found = [(at, v) for q, at, v in table if at is not None and x is not None and at <= x and (not keyed or q is not None and q == k)]
        out.append((k, x, *(max(found) if found else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize(("few", "fill", "bins"), [(64, 1000, 100), (3, 7, 5), (3, 10**6, 1)])
def test_against_loops(spark, keys, few, fill, bins):
    """Arrays and the one sort, parts of hot bins, keys and bins without thresholds, nulls, repeated and equal thresholds."""
    rng = random.Random(len(keys) + few)
    value = lambda: rng.choice([None, 50.0, float(rng.randint(-10, 120)), rng.uniform(-10, 120)])
    table = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 100))]), i) for i in range(1300 if few == 3 else 60)]
    rows = [(rng.choice(["a", "a", "b", "c", None]), value()) for _ in range(300)] + [("a", 50.0)] * 100
    df, tb = spark.createDataFrame(rows, "k string, x double"), spark.createDataFrame(table, "k string, at double, v int")
    got = lookup.asof_lookup(df, "x", tb if keys else tb.drop("k"), "at", "b", keys, few, fill, bins)
    assert sorted([tuple(r) for r in got.select("k", "x", "b.at", "b.v").collect()], key=repr) == brute(rows, table, bool(keys))


def test_no_nested_loop(spark):
    """Any size of table: no row meets all thresholds."""
    lines = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("k"))
    table = spark.range(150_000).select(F.col("id").cast("double").alias("threshold"), F.lit(0.1).alias("rate"), F.lit(0.0).alias("base"), F.lit(None).cast("double").alias("upper"))
    for n in (7, 150_000):
        plan = lookup.rate_lookup(lines, "x", table.limit(n))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lookup.rate_lookup(lines.where("false"), "x", table).count() == 0
    assert lookup.rate_lookup(lines, "x", table.where("false")).agg(F.sum("amount")).first()[0] == 0


def test_upper_ends(spark):
    """A bracket that ends before the next begins gives nothing beyond its end."""
    table = spark.createDataFrame([(10.0, 0.5, 1.0, 20.0), (30.0, 0.1, 6.0, None)], "threshold double, rate double, base double, upper double")
    df = spark.createDataFrame([(5.0,), (10.0,), (19.0,), (20.0,), (30.0,), (40.0,), (None,)], "x double")
    assert [r["amount"] for r in lookup.rate_lookup(df, "x", table).collect()] == [0.0, 1.0, 5.5, 0.0, 6.0, 7.0, None]
