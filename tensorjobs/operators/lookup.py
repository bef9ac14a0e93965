"""Rate tables, embeddings, rule tables and keyword matches: joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of a progressive rate: deduction, thresholds, rates above each, amounts at each.
RATE_DEDUCTION = 8600.0
RATE_THRESHOLDS = [6400.0, 18325.0, 54875.0, 109750.0, 203700.0, 256925.0, 632750.0]
RATE_RATES = [0.10, 0.12, 0.22, 0.24, 0.32, 0.35, 0.37]
RATE_BASES = [0.0, 1192.5, 5578.5, 17651.0, 40199.0, 57231.0, 188769.75]
#: Rows of a lookup table up to which it is broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, broadcast if it has at most `rows` rows; else the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def brackets(spark, thresholds=RATE_THRESHOLDS, rates=RATE_RATES, bases=RATE_BASES) -> DataFrame:
    """(threshold, rate, base, upper): a rate table with its upper ends."""
    uppers = [*thresholds[1:], None]
    return spark.createDataFrame(list(zip(thresholds, rates, bases, uppers, strict=True)), "threshold double, rate double, base double, upper double")


#: Thresholds of a key up to which they travel with the key as an array.
FEW = 64
#: Bins of an as-of join at most, rows of a bin that stay together, and rows that one task fills.
MAX_BINS, FILL, TASK = 2_048, 250_000, 500_000


def rate_lookup(df: DataFrame, x: str, table: DataFrame, out: str = "amount", keys: list[str] = ()) -> DataFrame:
    """df with base + (x - threshold) * rate of the largest threshold <= x; below the first, and from its `upper` on, 0.

    keys: equal in both; a null key finds nothing. A null x gives null.
    """
    found = asof_lookup(df, x, table.select(*keys, "threshold", "rate", "base", "upper"), "threshold", "_b", keys)
    b = lambda c: F.col(f"_b.{c}").cast("double")
    inside = F.col("_b").isNotNull() & (b("upper").isNull() | (F.col(x) < b("upper")))
    amount = F.when(inside, b("base") + (F.col(x) - b("threshold")) * b("rate")).otherwise(0.0)
    return found.withColumn(out, F.when(F.col(x).isNotNull(), amount)).drop("_b")


def asof_lookup(df: DataFrame, x: str, table: DataFrame, at: str, out: str, keys: list[str] = (), few: int = FEW, fill: int = FILL, bins: int = MAX_BINS) -> DataFrame:
    """df with the table's row of the largest `at` <= x among those with its keys, as a struct; null if there is none.

    Of rows with equal keys and `at` the largest counts. Rows with null keys, x or `at` find and give nothing. Tables with `few` rows a
    key go along as arrays in a join on the keys; others in one sort: rows and thresholds of a bin (`_filled`) stand in order, and each
    row takes the last threshold before it. No row meets thresholds other than its own.
    """
    values = [c for c in table.columns if c not in keys and c != at]
    known = [F.col(k).isNotNull() for k in keys] + [F.col(at).isNotNull()]
    one = table.where(reduce(Column.__and__, known)).groupBy(*keys, at).agg(F.max(F.struct(*[F.col(v) for v in values]) if values else F.lit(True)).alias("_v"))
    one = one.select(*keys, F.col(at).alias("_at"), F.struct(F.col(at), *[F.col(f"_v.{v}") for v in values]).alias("_r"))
    kind, below = one.schema["_r"].dataType, lambda b: b[at] <= F.col(x)
    if keys:
        most = one.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
        if (most[0] or 0) > few:
            return _filled(df, x, one, out, list(keys), fill, bins)
        lists = one.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_l"))
        lists = F.broadcast(lists) if most[1] <= SMALL // few else lists
        return df.join(lists, list(keys), "left").select(*[df[c] for c in df.columns], F.try_element_at(F.filter("_l", below), F.lit(-1)).alias(out))
    rows = sorted(one.limit(few + 1).collect(), key=lambda r: r["_at"])
    if len(rows) > few:
        return _filled(df, x, one, out, [], fill, bins)
    cells = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["_r"], kind.fields, strict=True)]) for r in rows]
    literal = F.array(*cells) if cells else F.array().cast(f"array<{kind.simpleString()}>")
    return df.select("*", F.try_element_at(F.filter(literal, below), F.lit(-1)).alias(out))


def _edges(table: DataFrame, at: str, each: int, bins: int) -> list:
    """Values of `at` between which about equally many rows lie, `each` at least."""
    n = min(bins, max(1, table.count() // each))
    cuts = table.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    return sorted(set(cuts or ()))


def _bin(x: Column, edges: list, kind: str) -> Column:
    """How many of the sorted edges are <= x, by halving; x is of type `kind`."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    if kind in ("double", "bigint") and all(isinstance(e, float if kind == "double" else int) for e in edges):  # NaN is the largest in both
        steps = np.array(edges)

        @F.pandas_udf("int")
        def found(v: pd.Series) -> pd.Series:
            some = v.to_numpy(steps.dtype)
            return pd.Series(np.searchsorted(steps, some, "right").astype(np.int32))

        return F.when(x.isNotNull(), found(F.coalesce(x, F.lit(edges[0]))))
    e = F.array(*map(F.lit, edges))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(e, middle(s)) <= x, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))))
    halves = F.sequence(F.lit(0), F.lit(len(edges).bit_length()))
    return F.when(x.isNotNull(), F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), step, lambda s: s["lo"]))


def following(table: DataFrame, keys: list[str], at: str, out: str, each: int = 4_096, bins: int = MAX_BINS) -> DataFrame:
    """table with the next larger `at` of its keys (distinct and not null), null after the last: found in bins, as a key's rows may be too many for a task."""
    rows = table.withColumn("_bin", _bin(F.col(at), _edges(table, at, each, bins), dict(table.dtypes)[at]))
    firsts = rows.groupBy(*keys, "_bin").agg(F.min(at).alias("_first"))
    ahead = firsts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bin").alias("_of_bin"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_next"))  # `bins` rows a key at most
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_bin") == F.col("_of_bin")]
    found = rows.withColumn(out, F.lead(at).over(Window.partitionBy(*keys, "_bin").orderBy(at))).join(ahead, same, "left")
    return found.select(*table.columns, F.coalesce(out, "_next").alias(out))


def _filled(df: DataFrame, x: str, table: DataFrame, out: str, keys: list[str], fill: int, bins: int) -> DataFrame:
    """The as-of join by one sort. table: keys, _at, _r.

    Bins hold about equally many thresholds. A bin with more than `fill` rows is dealt out over parts, each with all of the bin's
    thresholds; what a bin takes over from those before is found among the bins' last thresholds alone. One pass over x and the keys counts
    the rows of each bin, one sorts.
    """
    edges = _edges(table, "_at", 256, bins)
    group = [*keys, "_bin"]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (x, *keys)])
    rows = df.where(known).select(F.struct("*").alias("_row"), F.col(x).alias("_x"), *keys).withColumn("_bin", _bin(F.col("_x"), edges, dict(df.dtypes)[x]))
    marks = table.withColumn("_bin", _bin(F.col("_at"), edges, dict(table.dtypes)["_at"]))
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n")).select(*group, "_n", F.ceil(F.col("_n") / fill).cast("int").alias("_parts"))
    total, many = counts.agg(F.sum("_n"), F.count_if(F.col("_parts") > 1)).first()
    lasts = marks.groupBy(*group).agg(F.max(F.struct("_at", "_r")).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # `bins` rows a key at most
    spans = counts.join(lasts, group, "full_outer").withColumn("_last", F.last("_last", True).over(before)).where("_parts IS NOT NULL")
    spans = spans.select(*group, "_last", "_parts")
    part = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    own = marks.join(spans.select(*group, "_parts"), group).select(*group, part, "_at", "_r")
    taken = spans.where("_last IS NOT NULL").select(*group, part, F.col("_last._at").alias("_at"), F.col("_last._r").alias("_r"))
    large = counts.where("_parts > 1").select(*group, "_parts")
    dealt = rows.join(F.broadcast(large) if many <= SMALL else large, group, "left") if many else rows.withColumn("_parts", F.lit(1))
    dealt = dealt.withColumn("_part", (F.monotonically_increasing_id() % F.coalesce("_parts", F.lit(1))).cast("int"))
    every = dealt.select(*group, "_part", F.col("_x").alias("_at"), F.lit(1).alias("_kind"), "_row", F.lit(None).cast(table.schema["_r"].dataType).alias("_r"))
    every = every.unionByName(own.unionByName(taken).select(*group, "_part", "_at", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_r"))
    tasks = (total or 0) // TASK
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # what a task sorts does not grow with the input
        every = every.repartition(tasks, *group, "_part")
    w = Window.partitionBy(*group, "_part").orderBy("_at", "_kind")
    found = every.withColumn("_r", F.last("_r", True).over(w)).where("_kind = 1").select("_row.*", F.col("_r").alias(out))
    return found.unionByName(df.where(~known).withColumn(out, F.lit(None).cast(table.schema["_r"].dataType)))


def rate_relu(x: Column, thresholds: list[float] = RATE_THRESHOLDS, rates: list[float] = RATE_RATES) -> Column:
    """The same amount without a table: sum of max(0, x - threshold) * change of rate. No join, no shuffle."""
    deltas = [r - p for r, p in zip(rates, [0.0, *rates[:-1]], strict=True)]
    total = F.lit(0.0)
    for t, d in zip(thresholds, deltas, strict=True):
        total = total + F.when(x > t, (x - t) * d).otherwise(0.0)
    return F.when(x.isNotNull(), total)


def embed_lookup(ids: DataFrame, table: DataFrame, dim: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """ids with the table's vector; an id outside it keeps its row, with zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return ids.join(table.select(key, vector), key, "left").withColumn(vector, F.coalesce(vector, zeros))


def bracket_bases(table: DataFrame, keys: list[str]) -> DataFrame:
    """table(keys, threshold, rate) with base: the amount gathered below each threshold."""
    w = Window.partitionBy(*keys).orderBy("threshold")
    width = (F.lead("threshold").over(w) - F.col("threshold")) * F.col("rate")
    return table.withColumn("_w", width).withColumn("base", F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_w")


def rules_calc(staff: DataFrame, standard: DataFrame, federal: DataFrame, state: DataFrame, fica: dict) -> DataFrame:
    """Withholding per period.

    staff: id, gross_pay, filing_status, dependents, pre_tax_deduct_pct, retirement_pct, state_code, pay_periods.
    standard(filing_status, deduction), federal(filing_status, threshold, rate, base, upper), state(state_code, state_rate).
    fica: ss_rate, ss_base, medicare, extra_threshold, extra_rate, dependent_credit, default_deduction.
    """
    d = staff.join(small(standard), "filing_status", "left").join(small(state), "state_code", "left")
    gross = F.col("gross_pay")
    agi = gross * (1 - F.col("pre_tax_deduct_pct")) - gross * F.col("retirement_pct")
    d = d.withColumn("agi", agi).withColumn("taxable", F.greatest(F.lit(0.0), F.col("agi") - F.coalesce("deduction", F.lit(fica["default_deduction"]))))
    d = rate_lookup(d, "taxable", federal, "federal_tax", ["filing_status"])
    social = F.least(gross, F.lit(fica["ss_base"])) * fica["ss_rate"]
    medicare = gross * fica["medicare"] + F.greatest(F.lit(0.0), gross - fica["extra_threshold"]) * fica["extra_rate"]
    total = F.col("federal_tax") + social + medicare + F.col("agi") * F.coalesce("state_rate", F.lit(0.0)) - F.col("dependents") * fica["dependent_credit"]
    return d.withColumn("total_tax", F.greatest(F.lit(0.0), total)).withColumn("per_period", F.col("total_tax") / F.col("pay_periods"))


def missing_keys(expected: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    return expected.select(key).distinct().join(found, key, "left_anti").withColumn("severity", F.lit("error"))


def library_diff_keys(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, presence): both, old or new."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    presence = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "old").otherwise("both")
    return a.join(b, key, "full_outer").select(key, presence.alias("presence"))


def catalog_lookup(catalog: DataFrame, state: str, kind: str) -> DataFrame:
    parts = F.split("key", "-")
    return catalog.where((F.get(parts, F.lit(0)) == state) & (F.get(parts, F.lit(3)) == kind))


#: Signals up to which each is looked for on its own, and the most that one automaton holds and the driver reads (about 1 GB).
EACH, MOST_SIGNALS = 32, 2_000_000


def signal_match(texts: DataFrame, signals: DataFrame, text: str = "text", key: str = "doc_id", top: int = 3, block: int = MOST_SIGNALS, each: int = EACH) -> DataFrame:
    """(key, problem_id, hits, place): for each text the problems with most signals in it, ties by rank, then problem.

    signals(problem_id, rank, signal) is a parameter table of at most MOST_SIGNALS rows; a null problem or signal matches nothing, a problem's first
    rank holds. Few signals become expressions; more go into one automaton (Aho-Corasick), which reads a text once whatever their number, `block`
    signals a pass. Only with several passes are hits (not texts) shuffled, to be added up. Texts are lower-cased, so a signal with a
    capital never matches; keys are unique.
    """
    rows = signals.where("problem_id IS NOT NULL AND signal IS NOT NULL").select("problem_id", "rank", "signal").limit(MOST_SIGNALS + 1).collect()
    if len(rows) > MOST_SIGNALS:
        raise ValueError(f"more than {MOST_SIGNALS} signals: match parts of them by problem and rank what they find")
    rows.sort(key=lambda r: ((r["rank"] is not None, r["rank"] or 0), r["problem_id"], r["signal"]))
    ranks: dict = {}
    for r in rows:
        ranks.setdefault(r["problem_id"], r["rank"])
    kinds = dict(signals.dtypes)
    hit = f"struct<n:int,rank:{kinds['rank']},problem_id:{kinds['problem_id']}>"

    def hits(part: list) -> Column:
        if len(part) > each:
            return _automaton(part, ranks, f"array<{hit}>")(F.lower(text))
        by: dict = {}
        for r in part:
            by.setdefault(r["problem_id"], []).append(F.contains(F.lower(text), F.lit(r["signal"])).cast("int"))
        found = [F.struct((-reduce(Column.__add__, c)).alias("n"), F.lit(ranks[p]).cast(kinds["rank"]).alias("rank"), F.lit(p).alias("problem_id")) for p, c in by.items()]
        return F.filter(F.array(*found), lambda h: h["n"] < 0)

    if len(rows) <= block:
        found = hits(rows) if rows else F.array().cast(f"array<{hit}>")
        best = texts.select(key, F.posexplode(F.slice(F.array_sort(found), 1, top)).alias("place", "h"))
        return best.select(key, F.col("h.problem_id").alias("problem_id"), (-F.col("h.n")).alias("hits"), (F.col("place") + 1).alias("place"))
    passes = [texts.select(key, F.explode(hits(rows[lo : lo + block])).alias("h")).select(key, "h.*") for lo in range(0, len(rows), block)]
    summed = reduce(DataFrame.unionByName, passes).groupBy(key, "rank", "problem_id").agg(F.sum("n").cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("n", "rank", "problem_id"))  # a row per problem at most
    return summed.withColumn("place", place).where(F.col("place") <= top).select(key, "problem_id", (-F.col("n")).alias("hits"), "place")


_built: dict = {}


def _automaton(part: list, ranks: dict, schema: str):
    """A function of a text column that gives its problems as structs (minus the number of signals, rank, problem)."""
    from pyspark.sql import SparkSession

    problems = list(dict.fromkeys(r["problem_id"] for r in part))
    number = {p: i for i, p in enumerate(problems)}
    sent = SparkSession.active().sparkContext.broadcast(([(r["signal"], number[r["problem_id"]]) for r in part], [(p, ranks[p]) for p in problems]))
    name = uuid4().hex

    def built():
        """The automaton; a worker makes it once."""
        import ahocorasick

        if name not in _built:
            _built.clear()
            words: dict[str, list[int]] = {}
            for signal, i in sent.value[0]:
                words.setdefault(signal, []).append(i)
            machine = ahocorasick.Automaton()
            for k, w in enumerate(words):
                if w:
                    machine.add_word(w, k)
            machine.make_automaton()
            always = words.get("", [])
            _built[name] = machine, list(words.values()), always
        return _built[name]

    @F.pandas_udf(schema)
    def kernel(x: pd.Series) -> pd.Series:
        machine, owners, always = built()
        out = []
        for text in x:
            counts: dict[int, int] = {}
            if text is not None:
                for i in always:
                    counts[i] = counts.get(i, 0) + 1
                for k in {k for _, k in machine.iter(text)} if len(machine) else ():
                    for i in owners[k]:
                        counts[i] = counts.get(i, 0) + 1
            out.append([{"n": -n, "rank": sent.value[1][i][1], "problem_id": sent.value[1][i][0]} for i, n in counts.items()])
        return pd.Series(out, dtype=object)

    return kernel


def fragment_compat(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(fragment, name, issue): consumer inputs without a producer of that name (missing) or with another type (mismatch)."""
    made = producers.groupBy("name").agg(F.collect_set("type").alias("types"))
    joined = consumers.join(made, "name", "left")
    issue = F.when(F.col("types").isNull(), "missing").when(F.col("type").isNotNull() & ~F.array_contains("types", F.col("type")), "mismatch")
    return joined.select("fragment", "name", issue.alias("issue")).where("issue IS NOT NULL")
