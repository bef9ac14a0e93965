"""Queries that run the given tables through streams, to their end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.models import Scorer
from ..streaming import score
from .fixtures import _folder
from .queries import query, r, t


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; event times need a zone."""
    table = t(spark, d, name)
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in table.dtypes if kind == "timestamp_ntz"})


def _ended(found: DataFrame) -> DataFrame:
    """All that a stream has put out when its input is read."""
    spark, path = found.sparkSession, _folder(found.sparkSession)
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


@query("""WITH l AS (SELECT user_id, median(value) AS value, count(*) AS n, max(ts) AS last FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
SELECT user_id, round(value, 6) AS value, n FROM l WHERE last + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL 1 MINUTE""")
def votes_of_event_stream(spark, d):
    """The median of each user's events, given by a timer once the stream is two minutes beyond the last."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, score.ROCKSDB)
    try:
        found = _ended(score.votes_by_timer(_stream(spark, d, "events"), "ts", "user_id", "value", "event_id"))
    finally:
        spark.conf.set(name, before)
    return found.select("user_id", r("value").alias("value"), "n")


@query("""WITH e AS (SELECT user_id, value, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, round(avg(value), 6) AS value, count(value) AS n, max(ts) + INTERVAL 10 MINUTE AS until FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def session_votes_of_event_stream(spark, d):
    """The mean of each session of a user: events less than ten minutes apart."""
    found = _ended(score.session_votes(_stream(spark, d, "events"), "ts", "user_id", "value", gap="10 minutes"))
    return found.select("user_id", r("value").alias("value"), "n", F.col("until").cast("timestamp_ntz").alias("until"))


@query("""WITH z AS (SELECT event_id, least(greatest(value / 100, 0), 1) AS a, least(greatest(user_id / 1000.0, 0), 1)::DOUBLE AS b FROM events), h AS (SELECT event_id, greatest(0, 1.5 * a - 0.5 * b + 0.1) AS u, greatest(0, 0.7 * b - a) AS v FROM z)
SELECT event_id, round(1 / (1 + exp(-(u - 2 * v - 0.6))), 6) AS score FROM h""")
def scores_of_event_stream(spark, d):
    """A small network over a stream of events."""
    scorer = Scorer([(np.array([[1.5, -1.0], [-0.5, 0.7]]), np.array([0.1, 0.0]), 0), (np.array([[1.0], [-2.0]]), np.array([-0.6]), 1)])
    found = _ended(score.score_stream(_stream(spark, d, "events"), scorer, ["value", "user_id"], [100.0, 1000.0]))
    return found.select("event_id", r("score").alias("score"))


_LEVELS = [(0.0, 0.10), (11000.0, 0.12), (44725.0, 0.22), (95375.0, 0.24), (182100.0, 0.32)]


@query(f"""WITH b(level, rate) AS (VALUES {', '.join(f'({a}, {b})' for a, b in _LEVELS)}), s AS (SELECT DISTINCT c_mktsegment AS status, CASE WHEN c_mktsegment < 'F' THEN 2 ELSE 1 END AS k FROM customer),
f AS (SELECT status, level * k AS threshold, rate, lead(level * k) OVER (PARTITION BY status ORDER BY level) AS upper FROM b, s), g AS (SELECT *, coalesce(sum((upper - threshold) * rate) OVER (PARTITION BY status ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM f),
c AS (SELECT c_custkey, c_mktsegment AS status, (c_acctbal + 1000) * 40 AS gross FROM customer)
SELECT c_custkey, round(CASE WHEN g.threshold IS NULL THEN 0 ELSE g.base + (greatest(0, gross - 14600) - g.threshold) * g.rate END, 4) AS federal_tax FROM c ASOF LEFT JOIN g ON c.status = g.status AND greatest(0, gross - 14600) >= g.threshold""")
def rules_calc_by_brackets(spark, d):
    """Withholding over five brackets a status, their bases from the widths below."""
    c = t(spark, d, "customer").withColumn("gross_pay", (F.col("c_acctbal") + 1000) * 40)
    staff = c.select("c_custkey", "gross_pay", F.col("c_mktsegment").alias("filing_status"), F.lit(0).alias("dependents"), F.lit(0.0).alias("pre_tax_deduct_pct"), F.lit(0.0).alias("retirement_pct"), F.lit(0).alias("state_code"), F.lit(26).alias("pay_periods"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("rate")) for a, b in _LEVELS])).alias("x")
    levels = c.select(F.col("c_mktsegment").alias("filing_status")).distinct().select("filing_status", each)
    wide = F.when(F.col("filing_status") < "F", 2.0).otherwise(1.0)
    table = lookup.bracket_bases(levels.select("filing_status", (F.col("x.level") * wide).alias("threshold"), "x.rate"), ["filing_status"])
    federal = table.withColumn("upper", F.expr("lead(threshold) OVER (PARTITION BY filing_status ORDER BY threshold)"))
    fica = {"ss_rate": 0.0, "ss_base": 0.0, "medicare": 0.0, "extra_threshold": 0.0, "extra_rate": 0.0, "dependent_credit": 0.0, "default_deduction": 14600.0}
    out = lookup.rules_calc(staff, spark.createDataFrame([], "filing_status string, deduction double"), federal, spark.createDataFrame([], "state_code int, state_rate double"), fica)
    return out.select("c_custkey", r("federal_tax", 4).alias("federal_tax"))
