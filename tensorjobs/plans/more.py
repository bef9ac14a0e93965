"""Further queries: shapes, keys, text jobs and evaluation over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, corpus, evaluate, lint, lookup, models, tensors
from .queries import query, r, t

ROWS = "SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"


def _matrix(spark, d):
    """The vectors whose ids are the first of their order, as coordinates with consecutive rows."""
    m = tensors.rows_to_coordinates(t(spark, d, "embeddings"), "vec_id", "embedding")
    return m.select("i", "j", F.col("v").cast("double").alias("v"))


@query(f"SELECT (i * 64 + j) // 16 AS i, (i * 64 + j) % 16 AS j, v FROM ({ROWS})")
def reshape_embeddings(spark, d):
    y = t(spark, d, "embeddings")
    n = y.count()
    return tensors.reshape(_matrix(spark, d), 64, n * 4, 16, n)


@query(f"SELECT i, CASE WHEN j < 10 THEN j + 54 ELSE j - 10 END AS j, v FROM ({ROWS})")
def split_and_merge_embeddings(spark, d):
    left, right = tensors.split(_matrix(spark, d), 1, 10, 64)
    return tensors.merge(right, left, 1, 54)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice AS v FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def gather_part_prices(spark, d):
    src = t(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    idx = t(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("i"))
    return tensors.gather(src, idx, strict=False).select("pos.*", "v")


@query("SELECT c_custkey AS i, coalesce(max_by(o_totalprice, o_orderkey), any_value(c_acctbal)) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def scatter_last_order(spark, d):
    dst = t(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))
    return tensors.scatter(dst, new)


@query("SELECT vec_id, embedding::DOUBLE[] AS features FROM embeddings")
def pack_and_unpack_embeddings(spark, d):
    out = tensors.coordinates_to_rows(_matrix(spark, d))
    return out.select(F.col("i").alias("vec_id"), "features")


@query("SELECT count(*) AS n, count_if(l_discount < 0 OR l_discount > 1) AS discounts, count_if(l_quantity < 0 OR l_quantity > 1) AS quantities FROM lineitem")
def rate_bounds_lines(spark, d):
    out = C.outside_rate_bounds
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(out(F.col("l_discount"))).alias("discounts"), F.count_if(out(F.col("l_quantity"))).alias("quantities"))


_TYPES_SQL = ", ".join(f"('{a}', '{b}', '{o}', '{x}')" for a, b, o, x in C.TYPE_RESULTS)


@query(f"""WITH k(l, r, o, res) AS (VALUES {_TYPES_SQL}), x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'float' WHEN 'O' THEN 'currency' ELSE 'ratio' END AS lt,
CASE o_orderkey % 4 WHEN 0 THEN 'float' WHEN 1 THEN 'ratio' WHEN 2 THEN 'currency' ELSE 'category' END AS rt, CASE o_custkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'multiply' ELSE 'divide' END AS op FROM orders),
y AS (SELECT o_orderkey, CASE WHEN lt = 'float' THEN rt WHEN rt = 'float' THEN lt ELSE res END AS found FROM x LEFT JOIN k ON l = lt AND r = rt AND o = op)
SELECT o_orderkey, found IS NOT NULL AS safe, coalesce(found, 'float') AS result_type FROM y""")
def type_check_orders(spark, d):
    left = F.when(F.col("o_orderstatus") == "F", "float").when(F.col("o_orderstatus") == "O", "currency").otherwise("ratio")
    kind = lambda c, n, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    right = kind("o_orderkey", 4, ["float", "ratio", "currency", "category"])
    rows = t(spark, d, "orders").select("o_orderkey", left.alias("left_type"), right.alias("right_type"), kind("o_custkey", 3, ["add", "multiply", "divide"]).alias("op"))
    return C.type_check(rows).select("o_orderkey", "safe", "result_type")


@query("SELECT event_id, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS kept FROM (SELECT event_id, TRUE AS keep FROM events) GROUP BY 1")
def dropout_identity_events(spark, d):
    """p = 0 keeps everything."""
    x = C.dropout(F.array("value"), 0.0, 1, F.col("event_id"))
    return t(spark, d, "events").select("event_id", F.size(x).cast("long").alias("kept"))


@query("SELECT event_type, count(*) AS n, TRUE AS near, 0::BIGINT AS wrong FROM events WHERE value IS NOT NULL GROUP BY 1")
def dropout_share_events(spark, d):
    """A quarter of the values is dropped (within six standard errors) and the rest is scaled; the same draw gives the same rows."""
    e = t(spark, d, "events").where("value IS NOT NULL").select("event_type", F.col("value").cast("double").alias("v"), "event_id")
    draw = lambda: C.dropout(F.array(F.col("v") + 1000), 0.25, 7, F.col("event_id"))
    e = e.withColumns({"x": F.get(draw(), F.lit(0)), "again": F.get(draw(), F.lit(0))})
    kept = F.abs(F.col("x") - (F.col("v") + 1000) / 0.75) < 1e-9
    near = F.abs(F.avg((F.col("x") == 0).cast("int")) - 0.25) < 6 * F.sqrt(0.1875 / F.count("*"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), near.alias("near"), F.count_if(((F.col("x") != 0) & ~kept) | (F.col("x") != F.col("again"))).alias("wrong"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * 0.999 - 0.01 * x)), 6) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def decayed_update_embeddings(spark, d):
    e = F.col("embedding").cast("array<double>")
    return t(spark, d, "embeddings").select("vec_id", r(F.aggregate(C.wupd(C.wdecay(e, 0.001), e, 0.01), F.lit(0.0), lambda a, x: a + x)).alias("s"))


@query("SELECT DISTINCT l_partkey AS key, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS in_both FROM lineitem WHERE l_returnflag = 'A'")
def key_sets_parts(spark, d):
    of = lambda flag: F.max(F.col("l_returnflag") == flag)
    sets = t(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_partkey").alias("key")).agg(of("A").alias("a"), of("R").alias("in_both"))
    return sets.where("a").select("key", "in_both")


@query("SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 16) AS hash, md5(lang || chr(0) || text) AS pair FROM documents")
def content_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", corpus.content_hash(F.col("text")).alias("hash"), corpus.pair_key(F.col("lang"), F.col("text")).alias("pair"))


@query("SELECT doc_id, copy::INT AS copy FROM (SELECT doc_id, unnest(range(1, CASE WHEN lang = 'fr' THEN 4 ELSE 2 END)) AS copy FROM documents)")
def replicated_anchors(spark, d):
    return corpus.replicate_anchors(t(spark, d, "documents"), F.col("lang") == "fr").select("doc_id", "copy")


@query("SELECT p_partkey, p_type AS kind, replace(p_brand, '-', '') || '-' || p_size || '-0' AS place FROM part")
def key_parts_of_parts(spark, d):
    key = F.concat_ws("-", F.regexp_replace("p_brand", "-", ""), F.col("p_size").cast("string"), F.lit("0"), "p_type", F.lit("000"))
    return t(spark, d, "part").withColumn("key", key).select("p_partkey", audit.key_type(F.col("key")).alias("kind"), audit.key_place(F.col("key")).alias("place"))


@query("SELECT item_id AS key, text, 'ok' AS status FROM benchmark")
def patch_round_trip(spark, d):
    """Edits from one text to the next, applied, give the next."""
    y = t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.regexp_replace("text", " (?=\\w+ \\w+\\.)", "\n").alias("old"), F.col("text").alias("new"))
    out = lint.apply_patch(y.select("key", F.col("old").alias("text")), lint.make_patch(y))
    return out.select(F.col("key").cast("long").alias("key"), "text", "status")


VOCABULARY = ["VERBER", "AND", "THERE", "ENTION", "THER"]
_VOCABULARY_SQL = ", ".join(f"({i}, '{v}')" for i, v in enumerate(VOCABULARY))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), v(i, v) AS (VALUES {_VOCABULARY_SQL}),
n AS (SELECT word, min({{'d': levenshtein(upper(word), v), 'i': i, 'v': v}}) AS n FROM w, v GROUP BY word) SELECT word, CASE WHEN n.d <= CASE WHEN length(word) <= 4 THEN 2 ELSE 3 END THEN n.v END AS suggestion FROM n""")
def suggest_document_words(spark, d):
    words = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return lint.suggest_word(words, VOCABULARY)


@query("SELECT doc_id, regexp_matches(text, '(?m)^[ \\t\\n\\v\\f\\r]*(?:The|And|Der)\\b') AS is_code, TRUE AS alone FROM documents")
def code_like_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", corpus.looks_like_code(F.col("text"), ["The", "And", "Der"]).alias("is_code"), corpus.is_self_contained(F.col("text")).alias("alone"))


@query("""SELECT event_type AS word, count(*) AS generated, count_if(value > 5) AS valid, count_if(value > 10) AS executed FROM events GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0""")
def word_outcomes_events(spark, d):
    y = t(spark, d, "events").select(F.array("event_type").alias("opcodes"), (F.col("value") > 5).alias("grammar"), (F.col("value") > 10).alias("execute"))
    vocabulary = y.select(F.explode("opcodes").alias("word")).distinct().unionByName(spark.createDataFrame([("none",)], "word string"))
    return evaluate.word_outcomes(y, vocabulary)


@query("""WITH g AS (SELECT l_linenumber AS round, round(100.0::DOUBLE * avg((l_linestatus = 'F')::INT), 6) AS e FROM lineitem GROUP BY 1) SELECT round, e AS execute_pct, coalesce(e < 0.8 * lag(e) OVER (ORDER BY round), FALSE) AS regressed, e >= 50 AS reached FROM g""")
def round_stats_lines(spark, d):
    y = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("round"), F.lit(True).alias("grammar"), (F.col("l_linestatus") == "F").alias("execute"))
    return evaluate.round_stats(y, 50.0).select("round", r("execute_pct").alias("execute_pct"), "regressed", "reached")


@query("SELECT count_if(e = 0) AS valid, count_if(e > 0) AS invalid, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings FROM (SELECT o_custkey, count_if(o_orderstatus = 'F') AS e, count_if(o_orderstatus = 'P') AS w FROM orders GROUP BY 1)")
def lint_summary_orders(spark, d):
    y = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    found = y.where("o_orderstatus <> 'O'").select("key", F.when(F.col("o_orderstatus") == "F", "error").otherwise("warning").alias("severity"))
    return evaluate.lint_summary(found, y)


@query("""SELECT ps AS fragment, name, issue FROM (SELECT l_returnflag AS ps, l_partkey AS name, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_type <> 'SMALL' THEN 'mismatch' END AS issue FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10) WHERE issue IS NOT NULL""")
def fragment_compat_parts(spark, d):
    made = t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("type"))
    used = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("fragment"), F.col("l_partkey").alias("name"), F.lit("SMALL").alias("type")).distinct()
    return lookup.fragment_compat(made, used)


@query("SELECT item_id, length(text) AS n FROM benchmark")
def program_lines_of_benchmark(spark, d):
    """Every character of every line is kept when lines are taken apart and joined."""
    lines = t(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", corpus.LINE_END)).alias("line", "s"))
    return lines.groupBy("item_id").agg((F.sum(F.length("s")) + F.count("*") - 1).alias("n"))


@query("""WITH RECURSIVE s AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem) GROUP BY 1),
t AS (SELECT f, 0 AS i, 0::DOUBLE AS w, 0::DOUBLE AS b FROM s UNION ALL SELECT t.f, i + 1, w - 0.6 * (w * xx + b * x - xy) / n, b - 0.6 * (w * x + b * n - y) / n FROM t JOIN s USING (f) WHERE i < 20)
SELECT round(median(w), 6) AS w, round(median(b), 6) AS b, (SELECT count(*) FROM lineitem) AS n FROM t WHERE i = 20""")
def local_training_votes(spark, d):
    """A linear model trained on each return flag alone, parameters voted by median: weights in a row."""
    y = t(spark, d, "lineitem").select("l_returnflag", F.array(F.col("l_quantity") / 50).alias("x"), F.array(F.col("l_extendedprice") / 100000).alias("y"))
    (w, b, _), *_ = models.local_train_then_vote(y, "l_returnflag", "x", "y", [(np.zeros((1, 1)), np.zeros(1), 3)], 20, 0.3)
    return y.groupBy().agg(r(F.lit(float(w[0, 0]))).alias("w"), r(F.lit(float(b[0]))).alias("b"), F.count("*").alias("n"))
