"""Evaluation of models on prompts: pass rates, retries, preferences, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, n: Column) -> Column:
    """round(100 * part / n), 0 for n = 0."""
    return F.when(n == 0, 0.0).otherwise(F.round(100.0 * part / n, 1))


def pass_rates(results: DataFrame, *keys: str) -> DataFrame:
    """Per group: total, grammar, execute, errors and percentages. results: grammar and execute (boolean), error."""
    g = results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("grammar")).alias("grammar"), F.count_if(F.col("execute")).alias("execute"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
    return g.withColumns({"grammar_pct": percent(F.col("grammar"), F.col("total")), "execute_pct": percent(F.col("execute"), F.col("total"))})


#: Models up to which a pivot makes columns of them.
MODELS = 1_000


def model_shares(results: DataFrame, metric: str = "execute") -> DataFrame:
    """(cat, model, share): the share of `metric` for each pair that occurs, whatever the number of models."""
    return results.groupBy("cat", "model").agg(F.avg(F.col(metric).cast("double")).alias("share"))


def model_pivot(results: DataFrame, models: list[str] | None = None, metric: str = "execute") -> DataFrame:
    """A row per category with the share of `metric` per model; all models that occur unless some are given (MODELS at most, see model_shares)."""
    if models is None:
        models = sorted(r["model"] for r in results.select("model").where("model IS NOT NULL").distinct().limit(MODELS + 1).collect())
        if len(models) > MODELS:
            raise ValueError(f"more than {MODELS} models for columns: use model_shares")
    return model_shares(results, metric).groupBy("cat").pivot("model", models).agg(F.first("share"))


def retry_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: retries used by passed prompts, prompts saved by retries, passed with and without them."""
    ok = F.col("passed")
    return results.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col("attempts") - 1).otherwise(0)).alias("retries_used"), F.count_if(ok & (F.col("attempts") > 1)).alias("saved"),
        F.count_if(ok).alias("passed"), F.count_if(ok & (F.col("attempts") == 1)).alias("passed_at_once"),
    )


def retry_gain(results: DataFrame, keys: list[str], run: str = "retries") -> DataFrame:
    """(keys, run, total, passed, rate, gain): the pass rate of each run and what it gains over the run without retries (run 0; null without one)."""
    per = results.groupBy(*keys, run).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("rate", F.col("passed") / F.col("total"))
    base = F.max(F.when(F.col(run) == 0, F.col("rate"))).over(Window.partitionBy(*keys))  # a row per run
    return per.withColumn("gain", F.col("rate") - base)


def word_outcomes(results: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per vocabulary word: prompts that generated it, of these valid and executed ones; 0 where none."""
    each = results.select(F.explode(F.array_distinct("opcodes")).alias("word"), "grammar", "execute")
    counts = each.groupBy("word").agg(F.count("*").alias("generated"), F.count_if("grammar").alias("valid"), F.count_if("execute").alias("executed"))
    return vocabulary.select("word").distinct().join(counts, "word", "left").na.fill(0, ["generated", "valid", "executed"])


def preference_stats(candidates: DataFrame) -> DataFrame:
    """One row: prompts with two or more candidates, of these with all passing, all failing, all of one score."""
    per = candidates.groupBy("prompt").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).where("n >= 2")
    return per.agg(F.count("*").alias("prompts"), F.count_if(F.col("lo") == 2).alias("both_pass"), F.count_if(F.col("hi") == 0).alias("both_fail"), F.count_if(F.col("lo") == F.col("hi")).alias("no_variance"))


def round_stats(results: DataFrame, target: float) -> DataFrame:
    """Per round: percentages, and flags to stop: execution fell under 0.8 of the round before, or met the target."""
    g = results.groupBy("round").agg((100.0 * F.avg(F.col("grammar").cast("double"))).alias("grammar_pct"), (100.0 * F.avg(F.col("execute").cast("double"))).alias("execute_pct"))
    before = F.lag("execute_pct").over(Window.orderBy("round"))  # one row per round
    return g.withColumn("regressed", F.coalesce(F.col("execute_pct") < 0.8 * before, F.lit(False))).withColumn("reached", F.col("execute_pct") >= target)


def lint_summary(findings: DataFrame, programs: DataFrame) -> DataFrame:
    """One row: programs with and without errors, errors, warnings."""
    bad = findings.where("severity = 'error'").select("key").distinct().withColumn("_bad", F.lit(True))
    files = programs.select("key").distinct().join(bad, "key", "left").agg(F.count_if(F.col("_bad").isNull()).alias("valid"), F.count_if(F.col("_bad")).alias("invalid"))
    totals = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return files.crossJoin(totals)  # one row each


def best_worst_pair(candidates: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected): highest score first by position, lowest last; prompts of one score or one candidate go."""
    order = F.struct("score", -F.col("pos"))
    g = candidates.groupBy("prompt").agg(F.max_by("text", order).alias("chosen"), F.min_by("text", order).alias("rejected"), F.count("*").alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    return g.where("n >= 2 AND hi <> lo").select("prompt", "chosen", "rejected")


def first_valid_attempt(attempts: DataFrame) -> DataFrame:
    """(prompt, attempt, text): the first valid attempt, else the first that is not empty."""
    order = F.struct((~F.col("valid")).cast("int"), F.col("attempt"))
    some = attempts.where(F.col("valid") | (F.coalesce("text", F.lit("")) != ""))
    return some.groupBy("prompt").agg(F.min_by(F.struct("attempt", "text"), order).alias("a")).select("prompt", "a.attempt", "a.text")
