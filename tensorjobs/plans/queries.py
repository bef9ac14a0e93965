"""Queries over the given tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, corpus, evaluate, lint, lookup, models, reduce, signal, tensors, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, n: int = 6):
    return F.round(x, n)


def r_each(x, n: int = 6):
    """The numbers of an array rounded, small negative ones to -0.0: lists are compared as they are written."""
    return F.transform(x, lambda v: F.when(F.round(v, n) == 0, v * 0.0).otherwise(F.round(v, n)))


BRACKETS = ", ".join(
    f"({a}, {b}, {c}, {d if d is not None else 'NULL'})"
    for a, b, c, d in zip(lookup.RATE_THRESHOLDS, lookup.RATE_RATES, lookup.RATE_BASES, [*lookup.RATE_THRESHOLDS[1:], None], strict=True)
)
RATE_SQL = f"""
WITH b(lo, rate, base, hi) AS (VALUES {BRACKETS}),
n AS (SELECT *, greatest(o_totalprice - {lookup.RATE_DEDUCTION}, 0.0) AS net FROM orders)
SELECT o_orderpriority, count(*) AS n, round(sum(coalesce(base + (net - lo) * rate, 0.0)), 2) AS amount
FROM n LEFT JOIN b ON net >= lo AND (hi IS NULL OR net < hi) GROUP BY o_orderpriority"""


def _net(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").withColumn("net", F.greatest(F.col("o_totalprice") - lookup.RATE_DEDUCTION, F.lit(0.0)))


@query(RATE_SQL)
def rate_lookup_by_priority(spark, d):
    rows = lookup.rate_lookup(_net(spark, d), "net", lookup.brackets(spark))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("amount"))


@query(RATE_SQL)
def rate_relu_by_priority(spark, d):
    rows = _net(spark, d).withColumn("amount", lookup.rate_relu(F.col("net")))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("amount"))


L = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount"
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(ID)


@query(f"""SELECT {ID_SQL}, CAST(round((l_extendedprice * (1 - l_discount) + l_tax) * 10000) AS BIGINT) AS combined, CAST(floor(l_extendedprice / l_quantity * 1000 + 1e-6) AS BIGINT) AS unit_price,
CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(trunc(l_extendedprice) AS INT) % 7 AS m, CAST(trunc(l_extendedprice) AS INT) AS whole, ~CAST(trunc(l_quantity) AS INT) AS inverse FROM lineitem""")
def column_arithmetic(spark, d):
    x = F.array("l_extendedprice", "l_quantity")
    y = t(spark, d, "lineitem")
    price = F.get(C.elementwise(F.array("l_extendedprice"), F.array(1 - F.col("l_discount")), "mul"), F.lit(0))
    ratio = F.get(C.elementwise(x, F.array("l_quantity", "l_quantity"), "div"), F.lit(0))
    return y.select(*ID, F.round((price + F.col("l_tax")) * 10000).cast("long").alias("combined"), F.floor(ratio * 1000 + 1e-6).alias("unit_price"), F.round(C.scalar(F.col("l_discount"), 100, "mul", array=False)).cast("long").alias("pct"),
                    C.mod(F.col("l_extendedprice"), F.lit(7)).alias("m"), C.ftoi(F.col("l_extendedprice")).alias("whole"), C.bnot(F.col("l_quantity")).alias("inverse"))


X_SQL = "(l_quantity - 25.0) / 10.0"


@query(f"""SELECT {ID_SQL}, round(CASE WHEN x > 0 THEN x ELSE 0 END, 6) AS relu, round(1 / (1 + exp(-x)), 6) AS sigm, round((exp(2 * x) - 1) / (exp(2 * x) + 1), 6) AS tanh,
round(0.5 * x * (1 + (exp(2 * u) - 1) / (exp(2 * u) + 1)), 6) AS gelu, round(least(greatest(x, 0.2), 0.8), 6) AS clamped, round(CASE WHEN x > 0 THEN x ELSE 0.0 - x END, 6) AS chosen
FROM (SELECT *, 0.7978845608 * (x + 0.044715 * x * x * x) AS u FROM (SELECT *, {X_SQL} AS x FROM lineitem))""")
def column_activations(spark, d):
    x = F.col("x")
    y = t(spark, d, "lineitem").withColumn("x", F.expr("(l_quantity - 25.0D) / 10.0D"))
    return y.select(*ID, r(C.relu(x)).alias("relu"), r(C.sigm(x)).alias("sigm"), r(C.tanh_act(x)).alias("tanh"), r(C.gelu(x)).alias("gelu"),
                    r(C.clamp(x, 0.2, 0.8)).alias("clamped"), r(C.where(x, x, F.lit(0.0) - x)).alias("chosen"))


@query(f"""SELECT {ID_SQL}, CAST(l_quantity > 25 AS FLOAT) AS gt, CAST(l_quantity < 25 AS FLOAT) AS lt, CAST(l_quantity >= 25 AS FLOAT) AS ge, CAST(l_quantity <= 25 AS FLOAT) AS le,
CAST(abs(l_quantity - 25) < 1e-6 AS FLOAT) AS eq, CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS decided, l_discount < 0.05 AS below, l_discount < l_tax AS less FROM lineitem""")
def column_masks(spark, d):
    q = F.col("l_quantity")
    names = ("gt", "lt", "ge", "le", "eq")
    return t(spark, d, "lineitem").select(*ID, *[C.cmpr(q, 25, i).alias(n) for i, n in enumerate(names)], C.decide(F.col("l_discount"), 0.05).alias("decided"),
                                          C.cmpf(F.array("l_discount", "l_tax"), 0, 0.05).alias("below"), C.cmp(F.col("l_discount"), F.col("l_tax")).alias("less"))


@query(f"""SELECT {ID_SQL}, CAST(round((l_extendedprice / 1000 - l_quantity) * 100000) AS BIGINT) AS price_gap, CAST(floor(l_extendedprice / l_quantity / 100 * 1000 + 1e-6) AS BIGINT) AS price_ratio FROM lineitem
UNION ALL SELECT {ID_SQL}, CAST(round(-(l_extendedprice / 1000 - l_quantity) * 100000) AS BIGINT), CAST(floor(-(l_extendedprice / l_quantity / 100) * 1000 + 1e-6) AS BIGINT) FROM lineitem""")
def feature_spec_augmented(spark, d):
    spec = [{"name": "price_gap", "source_fields": ["p", "l_quantity"], "transformation": "diff"}, {"name": "price_ratio", "source_fields": ["l_extendedprice", "l_quantity"], "transformation": "ratio", "divisor": 100}]
    y = t(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    f = y.select(*ID, *C.feature_transform(spec)).select(*ID, F.array("price_gap", "price_ratio").alias("features"), F.lit(0.0).alias("label"))
    both = C.augment_negate_flip(f)
    return both.select(*ID, F.round(F.get("features", F.lit(0)) * 100000).cast("long").alias("price_gap"), F.floor(F.get("features", F.lit(1)) * 1000 + 1e-6).alias("price_ratio"))


@query("SELECT 'l_discount' AS name, max(abs(l_discount)) AS largest, max(abs(l_discount)) BETWEEN 0 AND 0.2 AS ok FROM lineitem UNION ALL SELECT 'l_quantity', max(abs(l_quantity)), max(abs(l_quantity)) BETWEEN 0 AND 10 FROM lineitem")
def range_checks(spark, d):
    spec = [{"name": "l_discount", "lo": 0, "hi": 0.2, "flag": True}, {"name": "l_quantity", "lo": 0, "hi": 10, "flag": True}]
    return C.range_check_divisor(t(spark, d, "lineitem"), spec)


@query("SELECT j, round(sum(v), 4) AS s, round(avg(v), 6) AS m, max(v) AS hi, min(v) AS lo FROM (SELECT unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY j")
def reduce_columns(spark, d):
    m = tensors.rows_to_coordinates(t(spark, d, "embeddings"), "vec_id", "embedding").withColumn("v", F.col("v").cast("double"))
    return reduce.reduce_many(m, {"s": 0, "m": 1, "hi": 2, "lo": 3}, 0).select("j", r("s", 4).alias("s"), r("m").alias("m"), "hi", "lo")


@query("SELECT vec_id, round(list_sum(e), 6) AS s, round(list_avg(e), 6) AS m, list_max(e) AS hi, list_min(e) AS lo FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def reduce_rows(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", *[(r(reduce.reduce_row(e, op)) if op < 2 else reduce.reduce_row(e, op)).alias(n) for op, n in enumerate(("s", "m", "hi", "lo"))])


@query("SELECT o_custkey, round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey")
def vote_per_customer(spark, d):
    o = t(spark, d, "orders")
    return reduce.votes(o, ["o_custkey"], "o_totalprice", {"median": 0, "mean": 1, "least": 3, "largest": 4}).select("o_custkey", r("median", 4).alias("median"), r("mean", 6).alias("mean"), "least", "largest")


@query("""WITH c AS (SELECT a.user_id, a.event_id, a.value, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 0.01 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_id) AS k FROM c) SELECT user_id, value, n AS count, CAST(n >= 3 AS INT) AS agree FROM r WHERE k = 1""")
def vote_quorum_per_user(spark, d):
    return reduce.vote_quorum(t(spark, d, "events"), ["user_id"], 3, 0.01, "value", "event_id")


@query("SELECT l_returnflag, round(avg((l_discount - l_tax) ** 2), 8) AS mse, round(avg(abs(l_discount - l_tax)), 8) AS mae FROM lineitem GROUP BY l_returnflag")
def losses_by_flag(spark, d):
    y = t(spark, d, "lineitem")
    return reduce.losses(y, ["l_returnflag"], {"mse": 0, "mae": 1}, "l_discount", "l_tax").select("l_returnflag", r("mse", 8).alias("mse"), r("mae", 8).alias("mae"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x)) AS x, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(x[1] / list_sum(x), 6) AS p0, round(-(v[1] - ln(list_sum(x))), 6) AS ce FROM e""")
def softmax_rows(spark, d):
    e = F.col("e")
    y = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = F.transform(e, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return y.select("vec_id", r(F.get(reduce.softmax(e), F.lit(0))).alias("p0"), r(reduce.cross_entropy(e, one)).alias("ce"))


@query("SELECT event_id, round(exp(value - max(value) OVER w) / sum(exp(value)) OVER w * exp(max(value) OVER w), 8) AS softmax FROM (SELECT event_id, user_id, value / 100.0 AS value FROM events) WINDOW w AS (PARTITION BY user_id)")
def softmax_per_user(spark, d):
    y = t(spark, d, "events").select("event_id", "user_id", (F.col("value") / 100.0).alias("value"))
    return reduce.softmax_by(y, ["user_id"], "value").select("event_id", r("softmax", 8).alias("softmax"))


@query("""WITH m AS (SELECT vec_id, e, list_avg(e) AS mu FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
q AS (SELECT *, list_avg(list_transform(e, lambda x: (x - mu) * (x - mu))) AS q FROM m)
SELECT vec_id, round((e[1] - mu) / sqrt(q + 1e-5), 6) AS first, round((e[len(e)] - mu) / sqrt(q + 1e-5), 6) AS last FROM q""")
def layer_norm_rows(spark, d):
    y = t(spark, d, "embeddings").select("vec_id", reduce.layer_norm(F.col("embedding").cast("array<double>")).alias("n"))
    return y.select("vec_id", r(F.get("n", F.lit(0))).alias("first"), r(F.element_at("n", -1)).alias("last"))


@query(f"SELECT {ID_SQL}, round((l_extendedprice - avg(l_extendedprice) OVER w) / sqrt(var_pop(l_extendedprice) OVER w + 1e-5), 6) AS normed FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def batch_norm_by_flag(spark, d):
    return reduce.batch_norm(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select(*ID, r("normed").alias("normed"))


DIST_SQL = """WITH a AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(list_cosine_distance(v, q), 6) AS cosine, round(list_distance(v, q), 6) AS euclid, round(list_inner_product(v, q), 6) AS dot FROM e, a"""


@query(DIST_SQL)
def distances_to_one(spark, d):
    y = t(spark, d, "embeddings")
    q = y.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    e = y.join(F.broadcast(q), how="cross")  # one row
    return e.select("vec_id", *[r(reduce.distance(F.col("embedding"), F.col("q"), m)).alias(m) for m in ("cosine", "euclid", "dot")])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
r AS (SELECT query_id, vec_id, list_distance(v, q) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, q), vec_id) AS k FROM q, e WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(distance, 5) AS distance FROM r WHERE k <= 3""")
def pairwise_nearest_blocks(spark, d):
    y = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.pairwise_nearest(y.where("id % 50 = 0"), y, 3, "euclid").withColumn("distance", r("distance", 5))


SMALL_MATRIX = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(4)] for i in range(64)]
_MAT_SQL = ", ".join(f"round(list_inner_product(e, [{', '.join(str(SMALL_MATRIX[i][j]) for i in range(64))}]), 6) AS c{j}" for j in range(4))


@query(f"SELECT vec_id, {_MAT_SQL} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def matmul_small_matrix(spark, d):
    y = t(spark, d, "embeddings").select("vec_id", tensors.matmul_small(F.col("embedding"), SMALL_MATRIX).alias("c"))
    return y.select("vec_id", *[r(F.get("c", F.lit(j))).alias(f"c{j}") for j in range(4)])


MATMUL_SQL = """WITH x AS (SELECT label AS i, p AS k, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b USING (k) GROUP BY a.i, b.i"""


def _label_means(spark, d):
    m = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "v"))
    return m.groupBy(F.col("label").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.avg(F.col("v").cast("double")).alias("v"))


@query(MATMUL_SQL)
def matmul_coordinates(spark, d):
    m = _label_means(spark, d)
    return tensors.matmul(m, tensors.transpose(m)).withColumn("v", r("v"))


@query(MATMUL_SQL)
def matmul_blocks(spark, d):
    m = _label_means(spark, d)
    return tensors.matmul_blocked(m, tensors.transpose(m), 16).withColumn("v", r("v"))


@query("SELECT vec_id, round(list_inner_product(e, e), 6) AS norm2 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def projection_keeps_norms(spark, d):
    """Projection on a full orthonormal basis leaves inner products alone."""
    y = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = vectors.project(y, "e", vectors.orthonormal(64, 64), normalise=False)
    return p.select("vec_id", r(tensors.dot(F.col("projected"), F.col("projected"))).alias("norm2"))


@query("""SELECT vec_id, c AS cluster FROM (SELECT vec_id, label AS c FROM (SELECT e.vec_id, m.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], m.v), m.label) AS k
FROM embeddings e, (SELECT label, list(v ORDER BY p) AS v FROM (SELECT label, p, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL) GROUP BY label) m) WHERE k = 1)""")
def nearest_label_mean(spark, d):
    means = _label_means(spark, d).orderBy("i", "j").collect()  # labels x dimensions
    labels = sorted({x["i"] for x in means})
    c = np.array([[x["v"] for x in means if x["i"] == i] for i in labels])
    y = vectors.nearest_centroid(t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", c)
    names = F.array(*[F.lit(int(x)) for x in labels])
    return y.select("vec_id", F.get(names, F.col("cluster")).cast("int").alias("cluster"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_retailprice, 0) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def embed_lookup_part(spark, d):
    table = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.array("p_retailprice").alias("vector"))
    return lookup.embed_lookup(t(spark, d, "lineitem"), table, 1, "l_partkey").select(*ID, F.get("vector", F.lit(0)).alias("v"))


@query("SELECT l_linenumber::BIGINT AS j, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1")
def transpose_and_reduce(spark, d):
    y = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("v"))
    rows = tensors.transpose(y)
    return reduce.reduce(rows, 0, 1).join(rows.groupBy("i").agg(F.count("*").alias("n")), "i").select(F.col("i").alias("j"), "n", "v")


FIR_SQL = "SELECT event_id, round(0.25 * value + 0.5 * coalesce(lag(value, 1) OVER w, 0) + 0.25 * coalesce(lag(value, 2) OVER w, 0), 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _series(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t(spark, d, "events").select("event_id", "user_id", pos.cast("long").alias("pos"), "value")


@query(FIR_SQL)
def fir_per_user(spark, d):
    return signal.fir(_series(spark, d), ["user_id"], "pos", "value", [0.25, 0.5, 0.25]).select("event_id", r("y").alias("y"))


@query(FIR_SQL)
def fir_in_chunks(spark, d):
    return signal.fir_chunked(_series(spark, d), ["user_id"], "pos", "value", [0.25, 0.5, 0.25], 50).select("event_id", r("y").alias("y"))


@query("SELECT event_id, f[1] AS first, f[4] AS last, round(list_avg(f), 6) AS mean FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f FROM events) WHERE len(f) = 4")
def sliding_features_per_user(spark, d):
    y = signal.sliding_features(_series(spark, d), ["user_id"], "pos", "value", 4)
    return y.select("event_id", F.get("features", F.lit(0)).alias("first"), F.get("features", F.lit(3)).alias("last"), r(reduce.reduce_row(F.col("features"), 1)).alias("mean"))


DFT_SQL = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c, value FROM events),
k AS (SELECT user_id, n AS k FROM s) SELECT k.user_id, k.k, round(sum(value * cos(2 * pi() * ((k * n) % c) / c)), 3) + 0.0 AS re FROM k JOIN s USING (user_id) GROUP BY ALL"""


@query(DFT_SQL)
def dft_per_user(spark, d):
    y = signal.dft(_series(spark, d), "user_id", "pos", "value")
    return y.select("user_id", "k", (r("re", 3) + 0.0).alias("re"))


@query(DFT_SQL)
def dft_per_user_sql(spark, d):
    y = signal.dft_sql(_series(spark, d), ["user_id"], "pos", "value")
    return y.select("user_id", "k", (r("re", 3) + 0.0).alias("re"))


@query("""WITH l AS (SELECT p_brand, l_partkey, l_extendedprice / l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand, avg(v) AS mean, stddev_samp(v) AS sd FROM l WHERE v > 0 GROUP BY 1 HAVING count(*) >= 3 AND stddev_samp(v) >= 1e-9)
SELECT p_brand, l_partkey, round(v, 2) AS value, round(max(abs(v - mean) / sd), 6) AS z FROM l JOIN m USING (p_brand) WHERE v > 0 AND abs(v - mean) / sd > 2 GROUP BY 1, 2, 3""")
def outlier_prices_by_brand(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    y = t(spark, d, "lineitem").join(p, "l_partkey").select("p_brand", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return audit.outliers(y, "p_brand", "l_partkey", "v", 2).select("p_brand", "l_partkey", "value", r("z").alias("z"))


@query("SELECT l_returnflag, round(avg(l_discount), 8) AS mean, round(stddev_samp(l_discount), 8) AS sd FROM lineitem GROUP BY 1")
def mean_std_by_flag(spark, d):
    return reduce.mean_std(t(spark, d, "lineitem"), ["l_returnflag"], "l_discount").select("l_returnflag", r("mean", 8).alias("mean"), r("sd", 8).alias("sd"))


@query("""WITH p AS (SELECT doc_id, substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) AS hash, source AS place FROM documents),
g AS (SELECT hash, count(*) AS n_keys FROM p GROUP BY 1 HAVING count(*) >= 2 AND min(place) < max(place)) SELECT hash, source || '-0-0-TXT-' || documents.doc_id AS key, n_keys FROM g JOIN p USING (hash) JOIN documents USING (doc_id)""")
def duplicate_documents(spark, d):
    y = t(spark, d, "documents").select("text", F.concat("source", F.lit("-0-0-TXT-"), F.col("doc_id").cast("string")).alias("key"))
    return audit.duplicate_content(y).select("hash", "key", "n_keys")


@query("SELECT source || '-0-0-CITY-' || doc_id AS key, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS lines FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) < 5")
def short_documents(spark, d):
    y = t(spark, d, "documents").select("text", F.concat("source", F.lit("-0-0-CITY-"), F.col("doc_id").cast("string")).alias("key"))
    return audit.short_programs(y).select("key", F.col("lines").cast("long").alias("lines"))


@query("SELECT p_partkey AS key, 'error' AS severity FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def missing_parts(spark, d):
    return lookup.missing_keys(t(spark, d, "part").select(F.col("p_partkey").alias("key")), t(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


@query("""SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'old' ELSE 'both' END AS presence
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k""")
def library_diff_parts(spark, d):
    y = t(spark, d, "lineitem").withColumnRenamed("l_partkey", "key")
    return lookup.library_diff_keys(y.where("l_returnflag = 'A'"), y.where("l_returnflag = 'R'"))


@query("""WITH b AS (SELECT c_mktsegment AS key, c_nationkey::VARCHAR AS status, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal, c_custkey) AS idx, c_acctbal AS o, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 0.01 ELSE c_acctbal END AS n FROM customer),
s AS (SELECT key, status, n, row_number() OVER (PARTITION BY key, status ORDER BY n) AS idx FROM b), o AS (SELECT key, status, o, row_number() OVER (PARTITION BY key, status ORDER BY o) AS idx FROM b)
SELECT key, status, idx, 'threshold_changed' AS category, o AS old_value, n AS new_value FROM o JOIN s USING (key, status, idx) WHERE abs(o - n) > 0.005""")
def structure_diff_segments(spark, d):
    y = t(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("status"), F.col("c_acctbal").alias("threshold"), F.lit(0.1).alias("rate"), F.lit(0.0).alias("cumulative"), "c_custkey")
    new = y.withColumn("threshold", F.when(F.col("c_custkey") % 10 == 0, F.col("threshold") + 0.01).otherwise(F.col("threshold")))
    return audit.structure_diff(y.drop("c_custkey"), new.drop("c_custkey"))


@query("SELECT o_orderkey AS key, CASE WHEN abs(o_totalprice - round(o_totalprice, 1)) > 0.02 THEN 'value_mismatch' ELSE 'ok' END AS status FROM orders")
def golden_check_orders(spark, d):
    y = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("vector"), F.lit("total").alias("output"), F.col("o_totalprice").alias("value"))
    return audit.golden_check(y.withColumn("value", F.round("value", 1)), y, y.select("key")).select("key", "status")


@query("""WITH f AS (SELECT l_returnflag AS kind, l_linestatus AS severity FROM lineitem) SELECT kind, NULL AS severity, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT NULL, severity, count(*) FROM f GROUP BY severity UNION ALL SELECT NULL, NULL, count(*) FROM f""")
def anomaly_summary_lines(spark, d):
    return audit.anomaly_summary(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("severity")))


@query("""WITH b AS (SELECT DISTINCT c_mktsegment, c_acctbal FROM customer), w AS (SELECT *, (lead(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - c_acctbal) * 0.1 AS w FROM b)
SELECT c_mktsegment, c_acctbal, round(coalesce(sum(w) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS base FROM w""")
def bracket_bases_by_segment(spark, d):
    y = t(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("threshold"), F.lit(0.1).alias("rate")).distinct()
    return lookup.bracket_bases(y, ["c_mktsegment"]).select("c_mktsegment", F.col("threshold").alias("c_acctbal"), r("base", 3).alias("base"))


@query("""SELECT key, line, value, before FROM (SELECT o_custkey AS key, o_orderkey AS line, o_totalprice AS value, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE value >= before""")
def monotonic_orders(spark, d):
    y = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("").alias("status"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("value"))
    return audit.monotonic_check(y).select("key", "line", "value", "before")


WORDS = ["the", "and", "of", "der", "und", "que", "pour", "los", "zebra"]
_WORDS_SQL = ", ".join(f"('{w}')" for w in WORDS)


@query(f"""WITH v(word) AS (VALUES {_WORDS_SQL}), w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
SELECT v.word, count(w.doc_id) AS n FROM v LEFT JOIN w ON v.word = w.word GROUP BY v.word""")
def word_coverage(spark, d):
    vocabulary = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return corpus.coverage(t(spark, d, "documents"), "text", vocabulary)


@query(f"""WITH v(word) AS (VALUES {_WORDS_SQL}), w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
c AS (SELECT v.word, count(w.doc_id) AS n FROM v LEFT JOIN w ON v.word = w.word GROUP BY v.word) SELECT word, n, CASE WHEN n = 0 THEN 'missing' ELSE 'low' END AS gap FROM c WHERE n < 200""")
def word_coverage_gaps(spark, d):
    return corpus.coverage_gaps(word_coverage(spark, d))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 2")
def document_word_counts(spark, d):
    return corpus.word_counts(t(spark, d, "documents"), "text")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(source || chr(0) || text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_documents(spark, d):
    return corpus.dedup_first(t(spark, d, "documents"), corpus.pair_key(F.col("source"), F.col("text")), "doc_id").select("doc_id")


@query("""WITH s AS (SELECT 'the' AS g, ['the ', ' and '] AS w, 1 AS rank UNION ALL SELECT 'de', [' der ', ' und '], 2 UNION ALL SELECT 'FFT', ['FFT'], 3 UNION ALL SELECT 'fr', [' les ', ' que ', ' des '], 4 UNION ALL SELECT 'es', [' los ', ' para '], 5),
h AS (SELECT doc_id, g, rank, len(list_filter(w, lambda x: contains(lower(text), x))) AS hits FROM documents, s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rank) AS place FROM h WHERE hits > 0)
SELECT doc_id, g AS problem_id, hits::INT AS hits, place::INT AS place FROM r WHERE place <= 3""")
def signal_match_documents(spark, d):
    groups = [("the", ["the ", " and "]), ("de", [" der ", " und "]), ("FFT", ["FFT"]), ("fr", [" les ", " que ", " des "]), ("es", [" los ", " para "])]
    rows = [(g, i + 1, s) for i, (g, w) in enumerate(groups) for s in w]
    return lookup.signal_match(t(spark, d, "documents"), spark.createDataFrame(rows, "problem_id string, rank int, signal string"))


CHAT_SQL = """WITH c AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS u, min_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(u, '') AS u, coalesce(a, '') AS a FROM c), k AS (SELECT *, md5(u || chr(0) || a) AS key, row_number() OVER (PARTITION BY md5(u || chr(0) || a) ORDER BY conv_id) AS r FROM p WHERE u <> '' AND a <> '')
SELECT conv_id, key, length(u) AS user_chars, length(a) AS assistant_chars FROM k WHERE r = 1"""


@query(CHAT_SQL)
def corpus_build_conversations(spark, d):
    """The whole build: chats from turns, system message, first turns, pair key, first of equal pairs, split by hash."""
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    none = F.lit(None).cast("string")
    chats = turns.select("messages", none.alias("instruction"), none.alias("input"), none.alias("output"), F.lit("").alias("file"), F.col("conv_id").alias("pos"))
    built = corpus.build_corpus(chats, "You answer.", ["LD", "MMUL"])
    return built.select(F.col("pos").alias("conv_id"), "key", F.length("user").cast("long").alias("user_chars"), F.length("assistant").cast("long").alias("assistant_chars"))


@query("SELECT count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, CAST(floor(count(*) * 0.1) AS BIGINT) AS valid, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) - CAST(floor(count(*) * 0.1) AS BIGINT) AS test FROM documents")
def split_exact_sizes(spark, d):
    y = corpus.split_exact(t(spark, d, "documents").select("doc_id"), F.col("doc_id"))
    return y.agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])


@query("SELECT lang AS word, CASE WHEN count(*) >= 300 THEN count(*) ELSE 300 END AS n FROM documents GROUP BY lang")
def equalize_languages(spark, d):
    y = t(spark, d, "documents")
    words = y.select(F.col("lang").alias("word"), F.col("doc_id").alias("key"))
    targets = y.select(F.col("lang").alias("word")).distinct().withColumn("target", F.lit(300).cast("long"))
    return corpus.equalize(y.select(F.col("doc_id").alias("key")), words, targets).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT lang AS word, greatest(300 - count(*), 0) AS missing FROM documents GROUP BY lang")
def language_deficits(spark, d):
    y = t(spark, d, "documents").select(F.col("lang").alias("word"))
    return corpus.deficits(y, y.distinct().withColumn("target", F.lit(300)))


EVAL = """SELECT l.doc_id, d.lang AS cat, d.source AS model, l.quality = 1 AS grammar, l.quality = 1 AND l.toxic = 0 AS execute FROM labels l JOIN documents d USING (doc_id)"""


def _results(spark, d):
    l, y = t(spark, d, "labels"), t(spark, d, "documents").select("doc_id", "lang", "source")
    return l.join(y, "doc_id").select("doc_id", F.col("lang").alias("cat"), F.col("source").alias("model"), (F.col("quality") == 1).alias("grammar"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("execute"), F.lit(None).cast("string").alias("error"))


@query(f"SELECT model, cat, count(*) AS total, count_if(grammar) AS grammar, count_if(execute) AS execute, round(100.0::DOUBLE * count_if(grammar) / count(*), 1) AS grammar_pct FROM ({EVAL}) GROUP BY ALL")
def pass_rates_by_source(spark, d):
    return evaluate.pass_rates(_results(spark, d), "model", "cat").select("model", "cat", "total", "grammar", "execute", "grammar_pct")


@query(f"SELECT cat, model, round(avg(execute::INT), 6) AS share FROM ({EVAL}) GROUP BY ALL HAVING share IS NOT NULL AND model IS NOT NULL")
def pivot_by_source(spark, d):
    """All sources as columns of a pivot, and back to a row per category and source that occur together."""
    p = evaluate.model_pivot(_results(spark, d))
    long = p.unpivot("cat", [f"`{c}`" for c in p.columns if c != "cat"], "model", "share")
    return long.where("share IS NOT NULL").select("cat", "model", r("share").alias("share"))


@query("""SELECT prompt, max_by(doc_id, score * 1000000000 - doc_id) AS chosen, min_by(doc_id, score * 1000000000 - doc_id) AS rejected FROM (SELECT d.source AS prompt, l.doc_id, l.quality * 2 - l.toxic * l.quality AS score FROM labels l JOIN documents d USING (doc_id)) GROUP BY prompt HAVING count(*) >= 2 AND min(score) <> max(score)""")
def best_worst_by_source(spark, d):
    y = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    c = y.select(F.col("source").alias("prompt"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("text"), (F.col("quality") * 2 - F.col("toxic") * F.col("quality")).alias("score"))
    return evaluate.best_worst_pair(c)


@query("SELECT o_custkey AS prompt, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) * 1000000000000 + o_orderkey) AS attempt FROM orders GROUP BY 1")
def first_valid_order(spark, d):
    y = t(spark, d, "orders").select(F.col("o_custkey").alias("prompt"), F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("text"), (F.col("o_orderstatus") == "F").alias("valid"))
    return evaluate.first_valid_attempt(y).select("prompt", "attempt")


@query("SELECT count(*) AS prompts, count_if(lo = 2) AS both_pass, count_if(hi = 0) AS both_fail, count_if(lo = hi) AS no_variance FROM (SELECT lang, source, min(quality * 2) AS lo, max(quality * 2) AS hi FROM labels JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) >= 2)")
def preference_counts(spark, d):
    y = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluate.preference_stats(y.select(F.struct("lang", "source").alias("prompt"), (F.col("quality") * 2).alias("score")))


@query("SELECT l_shipmode, sum(used) AS retries_used, count_if(used > 0) AS saved, count(*) AS passed FROM (SELECT l_returnflag AS l_shipmode, l_linenumber - 1 AS used FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def retry_counts(spark, d):
    y = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), F.col("l_linenumber").alias("attempts"), (F.col("l_linestatus") == "F").alias("passed"))
    return evaluate.retry_stats(y, ["l_shipmode"]).select("l_shipmode", "retries_used", "saved", "passed")


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(regexp_replace(x, ';.*$', ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ')), lambda x: x <> ''), '¶') AS compact FROM documents")
def compact_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", lint.compact(F.col("text")).alias("compact"))


_LAYERS = [(np.array([[((i * 5 + j * 3) % 7 - 3) / 10 for j in range(3)] for i in range(4)]), np.array([0.1, -0.1, 0.05]), 0), (np.array([[0.4], [-0.2], [0.3]]), np.array([0.02]), 1)]
_FEATS = ["l_quantity / 50", "l_extendedprice / 100000", "l_discount", "l_tax"]
_H = ", ".join("greatest(0, " + " + ".join(f"({f}) * ({_LAYERS[0][0][i, j]})" for i, f in enumerate(_FEATS)) + f" + ({_LAYERS[0][1][j]})) AS h{j}" for j in range(3))
MLP_SQL = f"SELECT {ID_SQL}, round(1 / (1 + exp(-(h0 * 0.4 + h1 * -0.2 + h2 * 0.3 + 0.02))), 6) AS score FROM (SELECT *, {_H} FROM lineitem)"


def _featured(spark, d):
    return t(spark, d, "lineitem").select(*ID, F.array(*[F.expr(f).cast("double") for f in _FEATS]).alias("features"))


@query(MLP_SQL)
def mlp_score_lines(spark, d):
    return models.Scorer(_LAYERS).score(_featured(spark, d)).select(*ID, r(F.get("score", F.lit(0))).alias("score"))


@query(MLP_SQL)
def mlp_score_lines_sql(spark, d):
    return _featured(spark, d).select(*ID, r(F.get(models.mlp_score_sql(F.col("features"), _LAYERS), F.lit(0))).alias("score"))


_TREES = {
    0: [{"node": 0, "feature": 0, "threshold": 0.5, "left": 1, "right": 2, "leaf": 0}, {"node": 1, "feature": -1, "threshold": 0, "left": 0, "right": 0, "leaf": 1.5}, {"node": 2, "feature": 2, "threshold": 0.05, "left": 3, "right": 4, "leaf": 0}, {"node": 3, "feature": -1, "threshold": 0, "left": 0, "right": 0, "leaf": -0.5}, {"node": 4, "feature": -1, "threshold": 0, "left": 0, "right": 0, "leaf": 2.0}],
    1: [{"node": 0, "feature": 3, "threshold": 0.04, "left": 1, "right": 2, "leaf": 0}, {"node": 1, "feature": -1, "threshold": 0, "left": 0, "right": 0, "leaf": 0.25}, {"node": 2, "feature": -1, "threshold": 0, "left": 0, "right": 0, "leaf": -0.25}],
}
TREE_SQL = f"SELECT {ID_SQL}, (CASE WHEN l_quantity / 50 < 0.5 THEN 1.5::DOUBLE WHEN l_discount < 0.05 THEN -0.5 ELSE 2.0 END) + (CASE WHEN l_tax < 0.04 THEN 0.25::DOUBLE ELSE -0.25 END) AS score FROM lineitem"


@query(TREE_SQL)
def tree_score_lines(spark, d):
    f = F.col("features")
    return _featured(spark, d).select(*ID, (models.tree_score_sql(f, _TREES[0]) + models.tree_score_sql(f, _TREES[1])).alias("score"))


@query(TREE_SQL)
def trees_score_lines(spark, d):
    return models.trees_score(_featured(spark, d), "features", _TREES).select(*ID, "score")


@query(f"SELECT {ID_SQL}, list_median([l_discount, l_tax, l_quantity / 50]) AS median FROM lineitem")
def ensemble_median_lines(spark, d):
    return t(spark, d, "lineitem").select(*ID, models.ensemble_vote(F.array("l_discount", "l_tax", F.col("l_quantity") / 50)).alias("median"))


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)),
g AS (SELECT range AS i FROM range(201)) SELECT round((n * xy - x * y) / (n * xx - x * x), 3) AS w, round((y - (n * xy - x * y) / (n * xx - x * x) * x) / n, 3) AS b FROM s""")
def linear_fit_lines(spark, d):
    y = t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    w, b = models.linear_fit(y, "x", "y", 0.5, 4000)
    return y.agg(r(F.lit(w), 3).alias("w"), r(F.lit(b), 3).alias("b"))


@query()
def mlp_train_quality(spark, d):
    """Three full-batch epochs of a small network on text lengths against quality labels; rows are the losses."""
    y = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    f = y.select(F.array(F.log1p(F.length("text")) / 12, F.regexp_count("text", F.lit(r"[|#*$%&!]")) / F.length("text")).alias("features"), F.array(F.col("quality").cast("double")).alias("label"))
    rng = np.random.default_rng(1)
    layers = [(rng.standard_normal((2, 4)), np.zeros(4), 2), (rng.standard_normal((4, 1)), np.zeros(1), 3)]
    _, losses = models.mlp_train(f, "features", "label", layers, epochs=3, lr=0.05)
    return y.limit(1).select(F.posexplode(F.array(*map(F.lit, losses))).alias("epoch", "loss"))


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, round(sum(a * b), 4) AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS a FROM embeddings) JOIN (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(list_reverse(embedding))::DOUBLE AS b FROM embeddings) USING (vec_id) GROUP BY ALL")
def matmul_backward_embeddings(spark, d):
    """The gradient of a product's matrix over all vectors: their outer products with themselves reversed, summed."""
    y = t(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), F.reverse("embedding").cast("array<double>").alias("g"))
    return models.matmul_backward(y, "x", "g").withColumn("v", r("v", 4))


@query("""WITH w AS (SELECT l.doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word FROM labels l JOIN documents USING (doc_id)),
k AS (SELECT word, c, ln(n) AS logp FROM (VALUES ('the', 0, 0.2), ('the', 1, 0.1), ('der', 0, 0.05), ('der', 1, 0.3), ('que', 0, 0.1), ('que', 1, 0.15)) v(word, c, n)),
s AS (SELECT doc_id, c, sum(logp) AS s FROM w JOIN k USING (word) GROUP BY ALL), d AS (SELECT DISTINCT doc_id, c FROM w, (VALUES (0), (1)) v(c)), z AS (SELECT d.doc_id, d.c, coalesce(s, 0) + ln(0.5) AS z FROM d LEFT JOIN s USING (doc_id, c))
SELECT doc_id, c AS class, round(exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w, 6) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS m FROM z) WINDOW w AS (PARTITION BY doc_id)""")
def naive_bayes_documents(spark, d):
    rows = [("the", 0, 0.2), ("the", 1, 0.1), ("der", 0, 0.05), ("der", 1, 0.3), ("que", 0, 0.1), ("que", 1, 0.15)]
    likelihood = spark.createDataFrame([(w, c, float(np.log(p))) for w, c, p in rows], "word string, class int, logp double")
    priors = spark.createDataFrame([(0, float(np.log(0.5))), (1, float(np.log(0.5)))], "class int, logp double")
    y = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = y.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word"))
    return models.naive_bayes_score(words, likelihood, priors).withColumn("probability", r("probability"))


@query()
def conv2d_embeddings(spark, d):
    """Embeddings as 8 x 8 images: convolution, then pooling."""
    y = t(spark, d, "embeddings").select("vec_id", F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("pixels"))
    k = np.array([[[[-1, -1, -1], [0, 0, 0], [1, 1, 1]]]], float)
    return models.maxpool(models.conv2d(y, k)).select("vec_id", "c", "h", "w", F.transform("pixels", lambda x: F.round(x, 6)).alias("pixels"))


@query(f"""WITH x AS (SELECT vec_id, floor(vec_id / 100)::BIGINT::VARCHAR || '/' || coalesce(label::VARCHAR, '') AS seq, embedding::DOUBLE[] AS e FROM embeddings),
z AS (SELECT a.vec_id AS pos, b.e AS v, list_dot_product(a.e, b.e) / sqrt(len(a.e)) AS z FROM x a JOIN x b USING (seq)), w AS (SELECT pos, v, exp(z - max(z) OVER (PARTITION BY pos)) AS w FROM z)
SELECT pos, [{', '.join(f'round(sum(w * v[{k}]) / sum(w), 6)' for k in range(1, 65))}] AS out FROM w GROUP BY pos""")
def attention_per_label(spark, d):
    """Self-attention within fixed windows: the vectors of one label among 100 consecutive ids, never a whole label.

    A window's key holds label and window number apart, so windows of different labels or places never meet.
    """
    e = F.col("embedding").cast("array<double>")
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    seq = F.concat_ws("/", F.floor(F.col("vec_id") / 100).cast("string"), label)  # a number first: no two pairs give one string
    y = t(spark, d, "embeddings").where("vec_id IS NOT NULL").select(seq.alias("seq"), F.col("vec_id").alias("pos"), e.alias("q"), e.alias("k"), e.alias("v"))
    out = F.coalesce("out", F.array_repeat(F.lit(None).cast("double"), 64))  # a null vector asks for nothing
    return models.attention(y, "seq", "pos", "string").select("pos", r_each(out).alias("out"))


@query("SELECT c_custkey, floor(greatest(0.0, federal + least(g, 160200) * 0.062 + g * 0.0145 + greatest(0, g - 200000) * 0.009 + agi * sr) + 0.003) AS total_tax FROM (SELECT c_custkey, g, agi, sr, greatest(0, taxable - 11000) * 0.1 AS federal FROM (SELECT c_custkey, g, g * 0.9 AS agi, greatest(0, g * 0.9 - CASE WHEN c_mktsegment = 'BUILDING' THEN 20000 ELSE 14600 END) AS taxable, CASE WHEN c_nationkey < 5 THEN 0.03 ELSE 0 END AS sr FROM (SELECT *, (c_acctbal + 1000) * 20 AS g FROM customer)))")
def rules_calc_customers(spark, d):
    c = t(spark, d, "customer").withColumn("gross_pay", (F.col("c_acctbal") + 1000) * 20)
    staff = c.select("c_custkey", "gross_pay", F.col("c_mktsegment").alias("filing_status"), F.lit(0).alias("dependents"), F.lit(0.06).alias("pre_tax_deduct_pct"), F.lit(0.04).alias("retirement_pct"), F.col("c_nationkey").alias("state_code"), F.lit(26).alias("pay_periods"))
    standard = spark.createDataFrame([("BUILDING", 20000.0)], "filing_status string, deduction double")
    state = spark.createDataFrame([(i, 0.03) for i in range(5)], "state_code int, state_rate double")
    segments = c.select(F.col("c_mktsegment").alias("filing_status")).distinct()
    federal = segments.select("filing_status", F.lit(11000.0).alias("threshold"), F.lit(0.1).alias("rate"), F.lit(0.0).alias("base"), F.lit(None).cast("double").alias("upper"))
    fica = {"ss_rate": 0.062, "ss_base": 160200.0, "medicare": 0.0145, "extra_threshold": 200000.0, "extra_rate": 0.009, "dependent_credit": 2000.0, "default_deduction": 14600.0}
    return lookup.rules_calc(staff, standard, federal, state, fica).select("c_custkey", F.floor(F.col("total_tax") + 0.003).cast("double").alias("total_tax"))


from . import more  # noqa: E402,F401  registers its queries
from . import extra  # noqa: E402,F401  so does this
from . import third  # noqa: E402,F401  and this
from . import fixtures  # noqa: E402,F401  and this
from . import streams  # noqa: E402,F401  and this
