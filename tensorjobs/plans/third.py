"""Queries on as-of lookups, program checks, gradients and training steps over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import gradients, lint, lookup, models, programs, reduce, training
from .queries import query, r, t


@query("""WITH p AS (SELECT o_totalprice AS threshold, min(o_orderkey) AS first, max(o_orderkey) AS rate FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, p.threshold, p.rate AS last FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem) l ASOF LEFT JOIN p ON l.x >= p.threshold""")
def asof_line_prices(spark, d):
    """The order price at or below the price of each line, and the last order that has it: as many thresholds as prices."""
    table = t(spark, d, "orders").select(F.col("o_totalprice").alias("threshold"), F.col("o_orderkey").alias("rate"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    found = lookup.asof_lookup(lines, "x", table, "threshold", "b")
    return found.select("l_orderkey", "l_linenumber", F.col("b.threshold").alias("threshold"), F.col("b.rate").alias("last"))


@query("""WITH p AS (SELECT o_orderstatus AS status, o_totalprice AS threshold, lead(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS upper FROM (SELECT DISTINCT o_orderstatus, o_totalprice FROM orders)),
b AS (SELECT status, threshold, 0.05 + 0.01 * floor(threshold / 100000) AS rate, threshold / 10 AS base, CASE WHEN floor(threshold)::BIGINT % 5 = 0 THEN threshold + (upper - threshold) / 2 ELSE upper END AS upper FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN b.threshold IS NULL OR x >= b.upper THEN 0 ELSE b.base + (x - b.threshold) * b.rate END, 4) AS amount
FROM (SELECT l_orderkey, l_linenumber, l_linestatus AS status, l_extendedprice * 3 AS x FROM lineitem) l ASOF LEFT JOIN b ON l.status = b.status AND l.x >= b.threshold""")
def rate_lookup_many_brackets(spark, d):
    """A rate table with a bracket for each order price, by status; some brackets end before the next begins."""
    prices = t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("threshold")).distinct()
    follow = lookup.following(prices, ["status"], "threshold", "upper")
    gap = F.when(F.floor("threshold") % 5 == 0, F.col("threshold") + (F.col("upper") - F.col("threshold")) / 2).otherwise(F.col("upper"))
    table = follow.select("status", "threshold", (0.05 + 0.01 * F.floor(F.col("threshold") / 100000)).alias("rate"), (F.col("threshold") / 10).alias("base"), gap.alias("upper"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") * 3).alias("x"))
    return lookup.rate_lookup(lines, "x", table, "amount", ["status"]).select("l_orderkey", "l_linenumber", r("amount", 4).alias("amount"))


def _program_of_order():
    """A program for each order: what it holds follows from the order's columns, so SQL can say what is to be found."""
    k = F.col("o_orderkey")
    line = lambda cond, text: F.when(cond, text)
    kinds = F.element_at(F.array(*map(F.lit, ("currency", "ratio", "category", "count"))), (k % 4 + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, ("currency", "ratio", "category", "count"))), (F.floor(k / 4) % 4 + 1).cast("int"))
    lines = [
        F.concat(F.lit("↓ ι:"), kinds, F.lit(" @gross")),
        line(k % 3 == 0, F.lit("↓ ε @is_exempt")),
        F.concat(F.lit("↓ γ:"), other, F.lit("  @amount")),
        line(k % 3 == 0, F.lit("⋈ φ ε #0 #0.5")),
        line((k % 3 == 0) & (k % 2 == 0), F.concat(F.lit("↘ #"), (k % 7).cast("string"))),
        F.when(k % 2 == 0, F.lit("∗ α ι γ")).otherwise(F.lit("+ α ι γ")),
        F.concat(F.lit("∗ β α #"), (F.floor(F.col("o_totalprice") / 1000) / 100).cast("string")),
        F.lit("∎ δ #1"), F.lit("∎ δ #2"), F.lit("∎ δ #3"),
        line(k % 5 != 0, F.lit("↑ β @out")),
        F.lit("◼"),
    ]
    return F.concat_ws("\n", *lines)


@query("""WITH o AS (SELECT o_orderkey AS key, floor(o_totalprice / 1000) / 100 AS rate, ['currency', 'ratio', 'category', 'count'][o_orderkey % 4 + 1] AS a, ['currency', 'ratio', 'category', 'count'][o_orderkey // 4 % 4 + 1] AS b,
  CASE WHEN o_orderkey % 2 = 0 THEN 'mul' ELSE 'add' END AS op, 2 + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END + 1 AS line FROM orders)
SELECT key, 'missing_output' AS kind, 'error' AS severity, 0 AS line FROM o WHERE key % 5 = 0
UNION ALL SELECT key, 'rate_bounds', 'warning', line + 1 FROM o WHERE rate > 1
UNION ALL SELECT key, 'exempt_handling', 'warning', 0 FROM o WHERE key % 3 = 0 AND NOT (key % 2 = 0 AND 4 + key % 7 >= 11 + CASE WHEN key % 5 <> 0 THEN 1 ELSE 0 END - 5)
UNION ALL SELECT key, 'type_compatibility', 'warning', line FROM o WHERE NOT ((a = 'currency' AND b = 'ratio' AND op = 'mul') OR (a = 'ratio' AND b = 'currency' AND op = 'mul') OR (a = 'currency' AND b = 'currency' AND op = 'add'))""")
def program_findings_orders(spark, d):
    """Semantic findings in a program for each order: outputs, rates, exempt branches and operand types."""
    made = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), _program_of_order().alias("text"), F.lit("NONE").alias("type"))
    return programs.program_checks(made, type_="type").select("key", "kind", "severity", "line")


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1")
def median_of_large_groups(spark, d):
    """Exact medians found by counting bit patterns, as for groups that no task could hold."""
    return reduce.median(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", huge=1_000).select("l_returnflag", r("value", 4).alias("median"))


_BENCH_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark"


@query(f"""WITH s AS (SELECT w AS signal, substr(w, 1, 2) AS p FROM ({_BENCH_WORDS})), h AS (SELECT doc_id, p, count(*) AS n FROM documents JOIN s ON contains(lower(text), signal) GROUP BY ALL)
SELECT doc_id, p AS problem_id, n::INT AS hits, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord(p), p) AS place FROM h) WHERE place <= 3""")
def signal_match_many(spark, d):
    """The three groups of benchmark words (by their first two letters) with most members inside each document: one automaton."""
    words = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("signal")).distinct()
    signals = words.select(F.substring("signal", 1, 2).alias("problem_id"), F.ascii("signal").alias("rank"), "signal")
    return lookup.signal_match(t(spark, d, "documents"), signals)


@query(f"""WITH v AS (SELECT upper(w) AS v, row_number() OVER (ORDER BY w) AS place FROM ({_BENCH_WORDS})), u AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM conversations),
n AS (SELECT word, v, place, levenshtein(upper(word), v) AS d FROM u JOIN v ON abs(len(word) - len(v)) <= 3)
SELECT u.word, b.v AS suggestion FROM u LEFT JOIN (SELECT word, arg_min(v, d * 1000000 + place) AS v FROM n WHERE d <= CASE WHEN len(word) <= 4 THEN 2 ELSE 3 END GROUP BY word) b USING (word)""")
def suggested_words_of_conversations(spark, d):
    """The nearest benchmark word for each word of a conversation, by deletions that both have in common."""
    words = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    unknown = t(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return lint.suggest_word_from(unknown, words.select(F.upper("w").alias("word"), F.col("w").alias("place")))


_CONV_CELLS = [(y, x) for y in range(4) for x in range(4)]
_KERNEL = [[0.5, -0.25, 0.1], [0.3, 0.2, -0.4], [-0.1, 0.6, 0.05]]
_OUT = [((3 * i) % 7 - 3) / 5 for i in range(16)]


def _cell(y: int, x: int, a: int, b: int) -> str | None:
    """The pixel under cell (a, b) of the kernel at output (y, x): stride 2, one pixel of padding."""
    i, j = 2 * y - 1 + a, 2 * x - 1 + b
    return f"e[{8 * i + j + 1}]" if 0 <= i < 8 and 0 <= j < 8 else None


_CONV = ", ".join("greatest(0, 0.1 + " + " + ".join(f"({_KERNEL[a][b]}) * {c}" for a in range(3) for b in range(3) if (c := _cell(y, x, a, b))) + ")" for y, x in _CONV_CELLS)
_DK = ", ".join("list_sum([" + ", ".join(f"CASE WHEN r[{k + 1}] > 0 THEN g * ({_OUT[k]}) * {c} ELSE 0 END" for k, (y, x) in enumerate(_CONV_CELLS) if (c := _cell(y, x, a, b))) + "])" for a in range(3) for b in range(3))


@query(f"""WITH c AS (SELECT e, [{_CONV}] AS r, label / 10 AS y FROM (SELECT embedding::DOUBLE[] AS e, label FROM embeddings WHERE len(embedding) = 64)),
p AS (SELECT e, r, 2 * ({' + '.join(f'({w}) * r[{k + 1}]' for k, w in enumerate(_OUT))} - 0.3 - y) AS g FROM c),
d AS (SELECT 1 AS layer, 'kernel' AS part, unnest(range(9)) AS place, unnest([{_DK}]) AS v, {_KERNEL} AS old FROM p
UNION ALL SELECT 4, 'w', unnest(range(16)), unnest([{', '.join(f'g * r[{k + 1}]' for k in range(16))}]), [{_OUT}] FROM p UNION ALL SELECT 4, 'b', 0, g, [[-0.3]] FROM p)
SELECT layer, part, place, round(any_value(flatten(old)[place + 1]) - 0.05 * sum(v) / (SELECT count(*) FROM p), 6) AS value FROM d GROUP BY layer, part, place""")
def conv_training_step(spark, d):
    """One step of a graph with a strided, padded convolution over vectors as images: every parameter after it."""
    y = t(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("embedding").cast("array<double>").alias("x"), F.array(F.col("label") / 10).alias("y"))
    graph = [
        {"op": "reshape", "shape": (1, 8, 8)}, {"op": "conv", "kernel": np.array([[_KERNEL]]), "bias": 0.1, "stride": 2, "padding": 1}, {"op": "relu"}, {"op": "flatten"},
        {"op": "dense", "w": np.array(_OUT)[:, None], "b": np.array([-0.3])},
    ]
    trained, _ = gradients.graph_train(y, "x", "y", graph, 1, 0.05, adam=False)
    rows = [(i, part, k, float(v)) for i, part in ((1, "kernel"), (4, "w"), (4, "b")) for k, v in enumerate(trained[i][part].ravel())]
    return spark.createDataFrame(rows, "layer int, part string, place long, value double").withColumn("value", r("value"))


@query("""WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
z AS (SELECT a.vec_id AS pos, b.e AS v, list_dot_product(a.e, b.e) / sqrt(len(a.e)) AS z FROM x a JOIN x b ON a.label IS NOT DISTINCT FROM b.label), w AS (SELECT pos, v, exp(z - max(z) OVER (PARTITION BY pos)) AS w FROM z)
SELECT pos, round(sum(w * v[1]) / sum(w), 6) AS first, round(sum(w * v[64]) / sum(w), 6) AS last, round(sum(w * list_sum(v)) / sum(w), 6) AS total FROM w GROUP BY pos""")
def attention_whole_labels(spark, d):
    """Self-attention among all vectors of a label, in blocks of keys: some components and the sum of each output."""
    e = F.col("embedding").cast("array<double>")
    y = t(spark, d, "embeddings").select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), e.alias("q"), e.alias("k"), e.alias("v")).where("q IS NOT NULL")
    out = models.attention(y, "seq", "pos", dict(y.dtypes)["seq"])
    return out.select("pos", r(F.get("out", F.lit(0))).alias("first"), r(F.get("out", F.lit(63))).alias("last"), r(F.aggregate("out", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT len(text) / 5000 AS x, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL)),
a AS (SELECT *, 0.2 - 0.1 * 2 * (0.2 * xx + 0.1 * x - xy) / n AS w1, 0.1 - 0.1 * 2 * (0.2 * x + 0.1 * n - y) / n AS b1 FROM s),
b AS (SELECT *, w1 - 0.1 * 2 * (w1 * xx + b1 * x - xy) / n AS w2, b1 - 0.1 * 2 * (w1 * x + b1 * n - y) / n AS b2 FROM a)
SELECT round(w2, 8) AS w, round(b2, 8) AS b, round((0.04 * xx + 0.01 * n + yy + 0.04 * x - 0.4 * xy - 0.2 * y) / n, 8) AS loss1, round((w1 * w1 * xx + b1 * b1 * n + yy + 2 * w1 * b1 * x - 2 * w1 * xy - 2 * b1 * y) / n, 8) AS loss2 FROM b""")
def batch_training_quality(spark, d):
    """Two epochs over barrier tasks, a batch being all labelled documents: quality by length."""
    y = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select(F.array(F.length("text") / 5000).alias("x"), F.array(F.col("quality").cast("double")).alias("y")).where("x[0] IS NOT NULL AND y[0] IS NOT NULL")
    layers, losses = training.batches_train(y, "x", "y", [(np.array([[0.2]]), np.array([0.1]), 3)], 2, 0.1, adam=False, batch=1 << 40, tasks=2)
    row = (float(layers[0][0][0, 0]), float(layers[0][1][0]), *losses)
    return spark.createDataFrame([row], "w double, b double, loss1 double, loss2 double").select(*[r(c, 8).alias(c) for c in ("w", "b", "loss1", "loss2")])
