"""Queries on whole graphs, gradients, classifiers and program texts over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import corpus, evaluate, lint, lookup, models
from ..sources import files
from .queries import _WORDS_SQL, SQL, WORDS, query, r, t

_E = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64)"


def _cell(y: int, x: int) -> str:
    """A component of a vector of 64 as a cell of 8 x 8."""
    return f"e[{8 * y + x + 1}]"


_POOLED = [f"greatest({', '.join(_cell(2 * i + a, 2 * j + b) for a in (0, 1) for b in (0, 1))})" for i in range(4) for j in range(4)]
_DENSE = np.array([[((3 * i + 5 * k) % 7 - 3) / 4 for k in range(2)] for i in range(16)])


def _dense_sql(k: int) -> str:
    return "greatest(0, " + " + ".join(f"({w}) * {p}" for p, w in zip(_POOLED, _DENSE[:, k].tolist(), strict=True)) + f" + ({0.1 * k}))"


@query(f"SELECT vec_id, round({_dense_sql(0)}, 6) AS a, round({_dense_sql(1)}, 6) AS b FROM {_E}")
def graph_score_embeddings(spark, d):
    """An imported graph over vectors as images: pool, flatten, dense, relu."""
    graph = [{"op": "reshape", "shape": (1, 8, 8)}, {"op": "maxpool", "size": 2}, {"op": "flatten"}, {"op": "dense", "w": _DENSE, "b": np.array([0.0, 0.1])}, {"op": "relu"}]
    rows = models.graph_score(t(spark, d, "embeddings").where("size(embedding) = 64"), "embedding", graph)
    return rows.select("vec_id", r(F.get("score", F.lit(0))).alias("a"), r(F.get("score", F.lit(1))).alias("b"))


_KERNEL = [[-1, -1, -1], [0, 0, 0], [1, 1, 1]]


def _conv_sql(y: int, x: int) -> str:
    return " + ".join(f"({_KERNEL[a][b]}) * {_cell(y + a, x + b)}" for a in range(3) for b in range(3) if _KERNEL[a][b])


_CONV_SQL = ", ".join(f"greatest({', '.join(_conv_sql(2 * i + a, 2 * j + b) for a in (0, 1) for b in (0, 1))})" for i in range(3) for j in range(3))


SQL["conv2d_embeddings"] = f"SELECT vec_id, 1 AS c, 3 AS h, 3 AS w, list_transform([{_CONV_SQL}], lambda x: round(x, 6)) AS pixels FROM {_E}"


@query(f"SELECT vec_id, unnest(range(9)) AS place, round(unnest([{_CONV_SQL}]), 6) AS value FROM {_E}")
def conv2d_pixels_embeddings(spark, d):
    """Convolution and pooling of vectors as images, a row per pixel."""
    y = t(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("pixels"))
    out = models.maxpool(models.conv2d(y, np.array([[_KERNEL]], float)))
    return out.select("vec_id", F.posexplode("pixels").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), r("value").alias("value"))


@query("""WITH x AS (SELECT vec_id, floor(vec_id / 100)::BIGINT::VARCHAR || '/' || coalesce(label::VARCHAR, '') AS seq, embedding::DOUBLE[] AS e FROM embeddings),
z AS (SELECT a.vec_id AS pos, b.e AS v, list_dot_product(a.e, b.e) / sqrt(len(a.e)) AS z FROM x a JOIN x b USING (seq)), w AS (SELECT pos, v, exp(z - max(z) OVER (PARTITION BY pos)) AS w FROM z)
SELECT pos, round(sum(w * v[1]) / sum(w), 6) AS first, round(sum(w * list_sum(v)) / sum(w), 6) AS total FROM w GROUP BY pos""")
def attention_sums(spark, d):
    """Self-attention within windows of one label among 100 consecutive ids: first component and sum of each output."""
    e = F.col("embedding").cast("array<double>")
    seq = F.concat_ws("/", F.floor(F.col("vec_id") / 100).cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    y = t(spark, d, "embeddings").select(seq.alias("seq"), F.col("vec_id").alias("pos"), e.alias("q"), e.alias("k"), e.alias("v"))
    out = models.attention(y, "seq", "pos", "string")
    return out.select("pos", r(F.get("out", F.lit(0))).alias("first"), r(F.aggregate("out", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_SIGM = "(1 / (1 + exp(-x)))"
_T = f"tanh({C.GELU_SCALE} * (x + {C.GELU_CUBIC} * x * x * x))"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN x > 0 THEN g ELSE 0.0 END AS relu, round(g * {_SIGM} * (1 - {_SIGM}), 6) + 0.0 AS sigm, round(g * (1 - tanh(x) * tanh(x)), 6) + 0.0 AS tanh,
round(g * (0.5 * (1 + {_T}) + 0.5 * x * (1 - {_T} * {_T}) * {C.GELU_SCALE} * (1 + 3 * {C.GELU_CUBIC} * x * x)), 6) + 0.0 AS gelu, round(2 * (x - g) / 4, 6) + 0.0 AS error
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25)::DOUBLE / 10 AS x, l_discount::DOUBLE AS g FROM lineitem)""")
def gradients_of_lines(spark, d):
    """Gradients through activations, and of the squared error."""
    x, g = (F.col("l_quantity").cast("double") - 25) / 10, F.col("l_discount").cast("double")
    cells = [((r(C.act_backward(g, x, a)) + 0.0) if a != "relu" else C.act_backward(g, x, a)).alias(a) for a in ("relu", "sigm", "tanh", "gelu")]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cells, (r(C.output_grad(x, g, 4)) + 0.0).alias("error"))


_Z = [f"({a} * q + {b} * p + {c})" for a, b, c in ((0.0213, 3.1, -0.417), (-0.0107, 5.3, 0.131), (0.0017, -2.3, 0.311))]


@query(f"""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-{_Z[0]})), 6) AS probability, CASE WHEN {_Z[0]} >= {_Z[1]} AND {_Z[0]} >= {_Z[2]} THEN 0 WHEN {_Z[1]} >= {_Z[2]} THEN 1 ELSE 2 END AS class,
round(exp({_Z[2]}) / (exp({_Z[0]}) + exp({_Z[1]}) + exp({_Z[2]})), 6) AS third FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS p FROM lineitem)""")
def classified_lines(spark, d):
    """Logistic and softmax classifiers over two features."""
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    y = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("features"))
    out = models.softmax_classify(y, "features", np.array([[0.0213, -0.0107, 0.0017], [3.1, 5.3, -2.3]]), np.array([-0.417, 0.131, 0.311]))
    return out.select("l_orderkey", "l_linenumber", r(models.logreg_score(F.col("features"), [0.0213, 3.1], -0.417)).alias("probability"), F.col("class").cast("int").alias("class"), r(F.get("probabilities", F.lit(2))).alias("third"))


@query("SELECT vec_id, round(0.25 * list_sum(list_transform(e, lambda x: x * x)), 6) AS error FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64)")
def reconstruction_of_embeddings(spark, d):
    """Squared error of a linear autoencoder that gives half of its input."""
    y = t(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return models.reconstruction_error(y, "x", [(np.eye(64) / 2, np.zeros(64), 3)]).select("vec_id", r("error").alias("error"))


@query("SELECT p_partkey FROM part WHERE split_part(p_brand, '#', 2) = '12' AND p_size % 3 = 1")
def catalog_of_parts(spark, d):
    key = F.concat_ws("-", F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit("0"), F.lit("0"), F.concat(F.lit("K"), (F.col("p_size") % 3).cast("string")), F.lit("0"))
    return lookup.catalog_lookup(t(spark, d, "part").select("p_partkey", key.alias("key")), "12", "K1").select("p_partkey")


@query(f"""WITH v(word) AS (VALUES {_WORDS_SQL}), w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
SELECT v.word, count(*) AS n FROM v JOIN w ON v.word = w.word GROUP BY v.word ORDER BY n, v.word LIMIT 3""")
def rarest_words(spark, d):
    """A top-3 report."""
    vocabulary = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return corpus.lowest_coverage(corpus.coverage(t(spark, d, "documents"), "text", vocabulary), 3)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(h, '[|#]') THEN 'symbolic' WHEN regexp_matches(h, '(?m)^[ \t\n\v\f\r]*(?:The|And|He)(?:[^\p{L}\p{N}_]|$)') THEN 'classic' WHEN regexp_matches(h, '(?m)^[ \t\n\v\f\r]*(?:A|In|La)(?:[^\p{L}\p{N}_]|$)') THEN 'verbose' ELSE 'unknown' END AS syntax
FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 500) AS h FROM documents)""")
def syntax_of_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", lint.detect_syntax(F.col("text"), "|#", ["The", "And", "He"], ["A", "In", "La"]).alias("syntax"))


@query("""SELECT n_nationkey, '⊕ r' || n_regionkey || ' ' || CASE n_name WHEN 'FRANCE' THEN 'κ' ELSE n_name END || ' ; note' || chr(10) || 'STORE @' || n_regionkey AS text, n_regionkey::VARCHAR AS stored FROM nation WHERE n_name NOT LIKE '% %'""")
def translated_programs(spark, d):
    """Small programs made of nations, translated token by token; what they store is read off."""
    n = t(spark, d, "nation").where(~F.col("n_name").contains(" "))
    text = F.concat(F.lit("add r"), F.col("n_regionkey").cast("string"), F.lit("   "), F.col("n_name"), F.lit(" ; note\nST @"), F.col("n_regionkey").cast("string"))
    stored = lint.io_names(F.concat(F.lit("ST r1 @"), F.col("n_regionkey").cast("string")))[1]
    return n.select("n_nationkey", lint.translate_tokens(text, {"ADD": "⊕", "ST": "STORE"}, {"FRANCE": "κ"}).alias("text"), F.get(stored, F.lit(0)).alias("stored"))


@query("SELECT 'nation' AS source, count(*) AS n, FALSE AS missing FROM nation UNION ALL SELECT 'none', 0, TRUE UNION ALL SELECT 'region', count(*), FALSE FROM region")
def united_sources(spark, d):
    n, g = t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_name").alias("name"))
    return files.union_sources({"nation": n, "region": g, "none": n.where("false")})[1]


_LINE = "SELECT l_returnflag AS flag, l_quantity::DOUBLE / 50 AS a, l_discount::DOUBLE * 10 AS b, l_tax::DOUBLE * 10 AS y FROM lineitem"
_STEP = "avg(2 * (0.5 * a - 0.25 * b + 0.1 - y) * {x})"


def _line_samples(spark, d):
    x = F.array(F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10)
    return t(spark, d, "lineitem").select("l_returnflag", x.alias("x"), F.array(F.col("l_tax").cast("double") * 10).alias("y"))


_LINEAR = [(np.array([[0.5], [-0.25]]), np.array([0.1]), 3)]


@query(f"""SELECT round(0.5 - 0.1 * {_STEP.format(x='a')}, 6) AS a, round(-0.25 - 0.1 * {_STEP.format(x='b')}, 6) AS b, round(0.1 - 0.1 * {_STEP.format(x='1')}, 6) AS bias,
round(avg((0.5 * a - 0.25 * b + 0.1 - y) ** 2), 6) AS loss FROM ({_LINE})""")
def training_step_lines(spark, d):
    """One full-batch step of a linear network over all lines."""
    (w, b, _), *_ = (out := models.mlp_train(_line_samples(spark, d), "x", "y", _LINEAR, epochs=1, lr=0.1, adam=False))[0]
    return spark.createDataFrame([(float(w[0, 0]), float(w[1, 0]), float(b[0]), out[1][0])], "a double, b double, bias double, loss double").select(*[r(c).alias(c) for c in ("a", "b", "bias", "loss")])


@query(f"""WITH g AS (SELECT flag, 0.5 - 0.1 * {_STEP.format(x='a')} AS a, -0.25 - 0.1 * {_STEP.format(x='b')} AS b, 0.1 - 0.1 * {_STEP.format(x='1')} AS bias FROM ({_LINE}) GROUP BY flag)
SELECT round(median(a), 6) AS a, round(median(b), 6) AS b, round(median(bias), 6) AS bias FROM g""")
def local_step_votes(spark, d):
    """One step for the lines of each flag alone, then the median of each parameter."""
    ((w, b, _),) = models.local_train_then_vote(_line_samples(spark, d), "l_returnflag", "x", "y", _LINEAR, epochs=1, lr=0.1)
    return spark.createDataFrame([(float(w[0, 0]), float(w[1, 0]), float(b[0]))], "a double, b double, bias double").select(*[r(c).alias(c) for c in ("a", "b", "bias")])


@query("""WITH p AS (SELECT o_orderstatus, o_orderkey % 3 AS retries, count(*) AS total, count(*) FILTER (o_totalprice > 150000 + 10000 * (o_orderkey % 3)) AS passed FROM orders GROUP BY ALL)
SELECT o_orderstatus, retries, total, passed, round(passed / total - max(CASE WHEN retries = 0 THEN passed / total END) OVER (PARTITION BY o_orderstatus), 6) + 0.0 AS gain FROM p""")
def retry_gain_orders(spark, d):
    run = (F.col("o_orderkey") % 3).alias("retries")
    rows = t(spark, d, "orders").select("o_orderstatus", run, (F.col("o_totalprice") > 150000 + 10000 * (F.col("o_orderkey") % 3)).alias("passed"))
    return evaluate.retry_gain(rows, ["o_orderstatus"]).select("o_orderstatus", "retries", "total", "passed", (r("gain") + 0.0).alias("gain"))
