"""Audits of rule libraries: outliers, duplicates, short or missing programs, structural differences, golden checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import small
from .reduce import _with_group

#: Program types that must have at least MIN_LINES lines, and tolerances of comparisons.
INCOME_TYPES = ["FIT", "SIT", "COUNTY", "CITY", "SCHL", "PIT", "EIT"]
MIN_LINES = 5
TOL_AMOUNT, TOL_RATE, TOL_GOLDEN = 0.005, 1e-8, 0.02


def key_type(key: Column) -> Column:
    """Part 3 of a key, else ''."""
    p = F.split(key, "-")
    return F.when(F.size(p) >= 4, F.get(p, F.lit(3))).otherwise("")


def key_place(key: Column) -> Column:
    """Parts 0 to 2 of a key, else the key."""
    p = F.split(key, "-")
    return F.when(F.size(p) >= 3, F.array_join(F.slice(p, 1, 3), "-")).otherwise(key)


def outliers(df: DataFrame, group: str, key: str, value: str, digits: int = 8, sigmas: float = 2.0, upper: float | None = None) -> DataFrame:
    """(group, key, value, mean, sd, z): values more than `sigmas` sample deviations from their group's mean.

    Only positive values (below `upper`) count; groups of fewer than 3 values or without spread give none. Moments are
    aggregated with partial sums and joined back; one row per key and rounded value. Rows of a null group are a group.
    """
    rows = df.where(F.col(value) > 0)
    if upper is not None:
        rows = rows.where(F.col(value) < upper)
    moments = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).where("n >= 3 AND sd >= 1e-9").drop("n")
    hits = _with_group(rows, small(moments), [group]).withColumn("z", F.abs(F.col(value) - F.col("mean")) / F.col("sd")).where(F.col("z") > sigmas)
    return hits.groupBy(group, key, F.round(value, digits).alias("value")).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.max("z").alias("z"))


def duplicate_content(programs: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """(hash, key, n_keys, first_key): programs with one stripped text in two or more places.

    Groups are named by their smallest key instead of a list of all others, whose size is the square of the group's.
    """
    rows = programs.select(F.substring(F.sha2(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 256), 1, 16).alias("hash"), key, key_place(F.col(key)).alias("place"))
    groups = rows.groupBy("hash").agg(F.count("*").alias("n_keys"), F.min("place").alias("_a"), F.max("place").alias("_b"), F.min(key).alias("first_key")).where("n_keys >= 2 AND _a < _b").drop("_a", "_b")
    return rows.join(groups, "hash").select("hash", key, "n_keys", "first_key")


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: x.rlike(r"\S")))


def short_programs(programs: DataFrame) -> DataFrame:
    """(key, lines): programs of an income type with fewer than MIN_LINES lines that are not blank."""
    rows = programs.select("key", line_count(F.col("text")).alias("lines"), key_type(F.col("key")).alias("type"))
    return rows.where(F.col("type").isin(INCOME_TYPES) & (F.col("lines") < MIN_LINES)).select("key", "lines")


def anomaly_summary(findings: DataFrame) -> DataFrame:
    """(kind, severity, n): counts by kind, by severity and in all, in one pass; the column not grouped by is null."""
    return findings.groupingSets([["kind"], ["severity"], []], "kind", "severity").agg(F.count("*").alias("n"))


def monotonic_check(thresholds: DataFrame, keys: list[str] = ("key", "status")) -> DataFrame:
    """Rows (.., line, value, before) whose threshold is not below the previous one in program order."""
    w = Window.partitionBy(*keys).orderBy("line")
    return thresholds.withColumn("before", F.lag("value").over(w)).where("before IS NOT NULL AND value >= before")


def structure_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status, idx, category, old_value, new_value): brackets paired by their place in threshold order.

    old, new: key, status, threshold, rate, cumulative.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        idx = F.row_number().over(Window.partitionBy("key", "status").orderBy("threshold", "rate", "cumulative"))
        return df.select("key", "status", idx.alias("idx"), F.struct("threshold", "rate", "cumulative").alias(side))

    both = _beside(placed(old, "o"), placed(new, "n"), ["key", "status", "idx"])

    def change(name: str, field: str, tol: float) -> Column:
        a, b = F.col(f"o.{field}"), F.col(f"n.{field}")
        return F.when(F.abs(a - b) > tol, F.struct(F.lit(name).alias("category"), a.cast("double").alias("old_value"), b.cast("double").alias("new_value")))

    alone = F.when(F.col("o").isNull(), F.struct(F.lit("bracket_added").alias("category"), F.lit(None).cast("double").alias("old_value"), F.col("n.threshold").cast("double").alias("new_value"))).when(
        F.col("n").isNull(), F.struct(F.lit("bracket_removed").alias("category"), F.col("o.threshold").cast("double").alias("old_value"), F.lit(None).cast("double").alias("new_value"))
    )
    changes = F.filter(F.array(alone, change("threshold_changed", "threshold", TOL_AMOUNT), change("rate_changed", "rate", TOL_RATE), change("cumulative_changed", "cumulative", TOL_AMOUNT)), lambda c: c.isNotNull())
    return both.select("key", "status", "idx", F.explode(changes).alias("c")).select("key", "status", "idx", "c.*")


def value_diff(old: DataFrame, new: DataFrame, name: str, tol: float) -> DataFrame:
    """The same for single values per (key, status): a flat rate (TOL_RATE) or a deduction (TOL_AMOUNT)."""
    o = old.select("key", "status", F.col("value").alias("old_value"))
    n = new.select("key", "status", F.col("value").alias("new_value"))
    kind = F.when(F.col("_in").isNull(), f"{name}_added").when(F.col("_on").isNull(), f"{name}_removed").when(F.abs(F.col("old_value") - F.col("new_value")) > tol, f"{name}_changed")
    return _beside(o.withColumn("_in", F.lit(True)), n.withColumn("_on", F.lit(True)), ["key", "status"]).withColumn("category", kind).where("category IS NOT NULL").drop("_in", "_on")


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join in which null keys are equal."""
    a, b = a.withColumn("_a", F.lit(True)), b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    both = a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), "full_outer")
    return both.withColumns({k: F.when(F.col("_a"), F.col(k)).otherwise(F.col(f"_of_{k}")) for k in keys}).drop("_a", *(f"_of_{k}" for k in keys))


def golden_check(actual: DataFrame, golden: DataFrame, programs: DataFrame, tol: float = TOL_GOLDEN) -> DataFrame:
    """(key, status, vector, output): per golden key 'ok', its first failure, or 'error' if the program is gone.

    actual, golden: key, vector, output, value. The first failure is the smallest (vector, output).
    """
    known = programs.select("key").distinct().withColumn("_p", F.lit(True))
    joined = golden.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "got"), ["key", "vector", "output"], "left").join(known, "key", "left")
    fault = F.when(F.col("_p").isNull(), "error").when(F.col("got").isNull(), "missing_output").when(F.abs(F.col("got") - F.col("expected")) > tol, "value_mismatch")
    per = joined.withColumn("f", fault).groupBy("key").agg(F.min(F.when(F.col("f").isNotNull(), F.struct("vector", "output", "f"))).alias("m"))
    return per.select("key", F.coalesce("m.f", F.lit("ok")).alias("status"), "m.vector", "m.output")


#: Filing statuses by the number programs compare with, and the jump from which a gate opens a branch of brackets.
STATUSES = {1.5: "single", 2.5: "mfj", 3.5: "mfs", 4.5: "hoh"}
BRANCH_JUMP = 5


def extract_rate_structure(programs: DataFrame) -> DataFrame:
    """(key, kind, status, idx, threshold, rate, cumulative, amount, line) of symbolic programs(key, text); kind: bracket, flat or deduction.

    A comparison of the status followed by a jump is a gate. Gates that jump far open a branch of their status, up to the next such
    gate; the last one's branch is as long as its jump, and what follows it up to a store or the end belongs to the default branch. Without
    them the program is one branch, 'unknown'. A branch's brackets are its first rate from zero, and the loads of an amount and a
    threshold with the rate in the three lines after them; without brackets its flat rate counts. Deductions are loads between the
    first short gate and the branches. Windows over a program's lines; programs are small.
    """
    rows = programs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "s")).withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " "))).where("s <> ''")
    w, whole = Window.partitionBy("key").orderBy("pos"), Window.partitionBy("key")
    words = F.split("s", " ")
    code = rows.select("key", (F.col("pos") + 1).alias("line"), "pos", F.get(words, F.lit(0)).alias("op"), F.slice(words, 2, 100).alias("a"))
    arg = lambda i, a="a": F.get(F.col(a), F.lit(i))
    number = lambda x: F.when(x.rlike(r"^#[^\[]"), F.substring(x, 2, 100).try_cast("double"))
    code = code.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole)})
    code = code.withColumns({f"{c}{k}": F.lead(c, k).over(w) for k in (1, 2, 3, 4) for c in ("op", "a")})
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv]), number(arg(3))), F.lit("unknown"))
    gate = (F.col("op") == "⋈") & (arg(0) == "φ") & (arg(1) == "κ") & number(arg(3)).isNotNull() & (F.col("op1") == "↘") & number(arg(0, "a1")).isNotNull()
    jump = number(arg(0, "a1")).cast("int")
    code = code.withColumns({"far": F.when(gate & (jump >= BRANCH_JUMP), F.struct("i", named.alias("status"), jump.alias("jump"))), "near": F.when(gate & (jump < BRANCH_JUMP), F.col("i"))})
    code = code.withColumns({"at": F.last("far", True).over(w), "end": F.max(F.col("far.i")).over(whole), "first": F.min(F.col("far.i")).over(whole), "married": F.max(F.col("far.status") == "mfj").over(whole), "short": F.min("near").over(whole)})
    begin = F.col("at.i") + 2
    after = (F.col("at.i") == F.col("end")) & (F.col("i") >= begin + F.col("at.jump"))
    stop = F.max(F.when(after & F.col("op").isin("↑", "◼"), 1)).over(w)
    code = code.withColumns({"after": F.coalesce(after, F.lit(False)), "stop": stop})
    status = (
        F.when(F.col("end").isNull(), "unknown")
        .when(F.col("after") & F.col("stop").isNull(), F.when(F.col("married"), "hoh").otherwise("default"))
        .when(~F.col("after") & (F.col("i") >= begin), F.col("at.status"))
    )
    branch = F.struct(F.coalesce("at.i", F.lit(-1)).alias("i"), "after")
    code = code.withColumns({"status": status, "branch": F.when(status.isNotNull(), branch)})
    inside = Window.partitionBy("key", "branch").orderBy("i")
    body = code.where("status IS NOT NULL").withColumns({f"same{k}": F.lead("i", k).over(inside).isNotNull() for k in (1, 2, 3, 4)})
    rated = lambda k: F.col(f"same{k}") & (F.col(f"op{k}") == "∗") & (F.size(f"a{k}") >= 3) & number(arg(2, f"a{k}")).isNotNull()
    base = (F.col("op") == "∗") & (arg(0) == "α") & (arg(1) == "π") & number(arg(2)).isNotNull()
    flat = (F.col("op") == "∗") & (arg(0) == "γ") & (arg(1) == "ι") & number(arg(2)).isNotNull()
    higher = (F.col("op") == "∎") & (arg(0) == "α") & number(arg(1)).isNotNull() & F.col("same1") & (F.col("op1") == "∎") & (arg(0, "a1") == "γ") & number(arg(1, "a1")).isNotNull()
    rate = F.coalesce(*[F.when(rated(k), number(arg(2, f"a{k}"))) for k in (2, 3, 4)], F.lit(0.0))
    zero = F.lit(0.0)
    found = body.withColumn(
        "x",
        F.when(base, F.struct(F.lit("bracket").alias("kind"), F.lit(0).alias("order"), zero.alias("threshold"), number(arg(2)).alias("rate"), zero.alias("cumulative")))
        .when(flat, F.struct(F.lit("flat").alias("kind"), F.lit(0).alias("order"), F.lit(None).cast("double").alias("threshold"), number(arg(2)).alias("rate"), F.lit(None).cast("double").alias("cumulative")))
        .when(higher, F.struct(F.lit("bracket").alias("kind"), F.lit(1).alias("order"), number(arg(1, "a1")).alias("threshold"), rate.alias("rate"), number(arg(1)).alias("cumulative"))),
    ).where("x IS NOT NULL").select("key", "branch", "status", "i", "line", "x.*")
    nth = F.row_number().over(Window.partitionBy("key", "branch", "kind", "order").orderBy("i"))
    brackets = F.count_if(F.col("kind") == "bracket").over(Window.partitionBy("key", "branch"))
    found = found.withColumns({"nth": nth, "brackets": brackets}).where("(order = 1 OR nth = 1) AND (kind = 'bracket' OR brackets = 0)")
    place = F.row_number().over(Window.partitionBy("key", "branch", "kind").orderBy("threshold", "order", "i")) - 1
    none = F.lit(None).cast("double")
    found = found.select("key", "kind", "status", place.alias("idx"), "threshold", "rate", "cumulative", none.alias("amount"), "line")
    region = code.where((F.col("i") >= F.col("short")) & (F.col("i") < F.coalesce("first", F.least(F.col("short") + 30, "n"))))
    event = F.when((F.col("op") == "⋈") & (arg(1) == "κ") & number(arg(3)).isNotNull(), F.struct(named.alias("s"))).when(F.col("op") == "→", F.struct(F.lit(None).cast("string").alias("s")))
    amount = F.when((F.col("op") == "∎") & (arg(0) == "γ") & (number(arg(1)) > 0), number(arg(1)))
    region = region.select("key", "i", "line", F.coalesce(F.last(event, True).over(Window.partitionBy("key").orderBy("i"))["s"], F.lit("default")).alias("status"), amount.alias("amount")).where("amount IS NOT NULL")
    one = region.withColumn("nth", F.row_number().over(Window.partitionBy("key", "status").orderBy("i"))).where("nth = 1")
    return found.unionByName(one.select("key", F.lit("deduction").alias("kind"), "status", F.lit(0).alias("idx"), none.alias("threshold"), none.alias("rate"), none.alias("cumulative"), "amount", "line"))


#: Statuses that may be required of every income program.
MAX_STATUSES = 1_000


def semantic_checks(inputs: DataFrame, used: DataFrame, outputs: DataFrame, statuses: DataFrame, required: DataFrame) -> DataFrame:
    """(key, kind, severity, name): inputs never used, programs without output, income programs without a required status.

    inputs(key, name), used(key, name), outputs(key), statuses(key, type, status), required(status).
    """
    row = lambda df, kind, severity: df.select("key", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("name").cast("string").alias("name"))
    unused = row(inputs.join(used, ["key", "name"], "left_anti"), "unused_input", "warning")
    silent = row(statuses.select("key").distinct().join(outputs, "key", "left_anti").withColumn("name", F.lit(None)), "missing_output", "error")
    names = [r["status"] for r in required.select("status").distinct().limit(MAX_STATUSES + 1).collect()]
    if len(names) > MAX_STATUSES:
        raise ValueError("too many required statuses")
    every = F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("status")
    income = statuses.where(F.col("type").isin(INCOME_TYPES)).select("key").distinct().select("key", every)
    lacking = row(income.join(statuses.select("key", "status"), ["key", "status"], "left_anti").withColumnRenamed("status", "name"), "missing_status", "warning")
    return unused.unionByName(silent).unionByName(lacking)
