"""Queries on files and programs that are made from the given tables: written, read again or checked, and compared with the tables' columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import table_functions
from ..operators import corpus, lint, lookup, models, reduce
from ..sources import files, tensor_source
from .queries import query, r, t


def _folder(spark) -> str:
    """A new folder in the one that all machines share; only a local master may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/tensorjobs/fixture-{uuid.uuid4().hex}"


def _tensors(spark, d):
    """A tensor for each vector and order, of all three types."""
    e = F.col("embedding").cast("array<double>")
    vectors = t(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.lit("f32").alias("dtype"), F.array(F.size("embedding")).alias("shape"), e.alias("data"))
    o = t(spark, d, "orders")
    prices = o.select(F.concat(F.lit("p"), "o_orderkey").alias("name"), F.lit("f64").alias("dtype"), F.array(F.lit(1), F.lit(2)).alias("shape"), F.array("o_totalprice", -F.col("o_totalprice")).alias("data"))
    keys = o.select(F.concat(F.lit("k"), "o_orderkey").alias("name"), F.lit("i32").alias("dtype"), F.array(F.lit(1)).alias("shape"), F.array(F.col("o_custkey").cast("double")).alias("data"))
    return vectors.unionByName(prices).unionByName(keys)


_TENSORS_SQL = """SELECT 'v' || vec_id AS name, 'f32' AS dtype, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE embedding IS NOT NULL
UNION ALL SELECT 'p' || o_orderkey, 'f64', 2, 0.0 FROM orders UNION ALL SELECT 'k' || o_orderkey, 'i32', 1, o_custkey::DOUBLE FROM orders"""


def _summed(df):
    return df.select("name", "dtype", F.size("data").cast("long").alias("n"), (r(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)) + 0.0).alias("total"))


@query(_TENSORS_SQL)
def tensors_written_and_read(spark, d):
    path = _folder(spark)
    files.write_named_tensors(_tensors(spark, d), path)
    return _summed(files.read_named_tensors(spark, path))


@query(_TENSORS_SQL)
def tensor_format_round_trip(spark, d):
    """The same through the data source, written by its writer."""
    path = _folder(spark).removeprefix("file://")
    tensor_source.register(spark)
    _tensors(spark, d).write.format("named_tensors").mode("append").save(path)
    return _summed(tensor_source.load_named_tensors(spark, path))


@query("""SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS users, sum(length(text))::BIGINT AS characters FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def chats_written_and_read(spark, d):
    """Conversations as JSON lines, in files of one chat a line, with broken lines in between that are skipped."""
    path = _folder(spark)
    one = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"), F.col("conv_id").cast("string").alias("input")))
    chats = t(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(one.alias("value"))
    chats.select(F.explode(F.array(F.col("value"), F.lit('{"messages": ['), F.lit(" "))).alias("value")).write.text(path)
    read = files.read_chat_jsonl(spark, path, "*.txt")
    m = F.col("messages")
    return read.select(F.col("input").cast("long").alias("conv_id"), F.size(m).cast("long").alias("turns"), F.size(F.filter(m, lambda x: x["role"] == "user")).cast("long").alias("users"), F.aggregate(F.transform(m, lambda x: F.length(x["content"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("characters"))


@query("SELECT o_orderpriority AS type, o_orderkey AS key, 'total' AS output, o_totalprice AS value FROM orders UNION ALL SELECT o_orderpriority, o_orderkey, 'customer', o_custkey FROM orders")
def golden_written_and_read(spark, d):
    """Expected values of each order, two vectors a key: written as objects, read a row a value."""
    path = _folder(spark)
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("type"), F.inline(F.array(F.struct(F.lit(0).alias("vector"), F.lit("total").alias("output"), F.col("o_totalprice").alias("value")), F.struct(F.lit(1).alias("vector"), F.lit("customer").alias("output"), F.col("o_custkey").cast("double").alias("value")))))
    files.write_golden(o, path)
    return files.read_golden(spark, path).select("type", F.col("key").cast("long").alias("key"), "output", "value")


@query("SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM documents) GROUP BY 1")
def splits_written_and_read(spark, d):
    path = _folder(spark)
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "valid").otherwise("test")
    files.write_splits(t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("_hidden"), split.alias("split")), path)
    read = spark.read.json(path)
    assert "_hidden" not in read.columns
    return read.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_LINT_SQL = """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 2 = 0 AS halts, o_orderkey % 3 = 0 AS stores, o_orderkey % 5 = 0 AS wrong, o_orderkey % 7 = 0 AS few, o_orderkey % 4 = 0 AS opens, o_orderkey % 6 = 0 AS closes, (o_custkey % 12)::INT AS jump FROM orders),
l AS (SELECT *, 3 + halts::INT + stores::INT + wrong::INT + few::INT + opens::INT + closes::INT AS n FROM o)
SELECT key, 'invalid_opcode' AS kind, 'error' AS severity, 4 AS line FROM l WHERE wrong
UNION ALL SELECT key, 'wrong_operand_count', 'error', 4 + wrong::INT FROM l WHERE few
UNION ALL SELECT key, 'invalid_jump', 'error', 3 FROM l WHERE 1 + jump - 4 < 0 OR 1 + jump - 4 >= n
UNION ALL SELECT key, 'unmatched_endf', 'error', 4 + wrong::INT + few::INT + opens::INT FROM l WHERE closes AND NOT opens
UNION ALL SELECT key, 'missing_halt', 'error', NULL FROM l WHERE NOT halts
UNION ALL SELECT key, 'unclosed_fragment', 'warning', NULL FROM l WHERE opens AND NOT closes
UNION ALL SELECT key, 'no_output', 'warning', NULL FROM l WHERE NOT stores"""


@query(_LINT_SQL)
def lint_of_order_programs(spark, d):
    """Lint findings in a program for each order: words, operands, jumps, fragments, stores and halts."""
    k, some = F.col("o_orderkey"), lambda n, line: F.when(F.col("o_orderkey") % n == 0, line)
    text = F.concat_ws(
        "\n", F.lit("; program\nLD R0 @x"), F.concat(F.lit("jump #"), (F.col("o_custkey") % 12 - 4).cast("string"), F.lit("   ; ahead")), some(5, F.lit("WHAT R0")), some(7, F.lit("ADD R0")), some(4, F.lit("FRAG a")), some(6, F.lit("ENDF")),
        some(3, F.lit("ST R0 @y")), F.lit("ADD R0 R1 R2"), some(2, F.lit("HALT")),
    )
    programs = t(spark, d, "orders").select(k.alias("key"), text.alias("text"))
    arity = spark.createDataFrame([("LD", 2, 2), ("ST", 2, 2), ("ADD", 3, 3), ("JUMP", 1, 1), ("HALT", 0, 0), ("FRAG", 1, 1), ("ENDF", 0, 0)], "word string, low int, high int")
    return lint.lint_lines(programs, arity, ["JUMP"], ["HALT"], ["ST"])


@query("""WITH c AS (SELECT c_custkey AS key, c_custkey % 3 AS form, (100 + c_custkey % 50)::DOUBLE AS low, (1000 + c_nationkey)::DOUBLE AS high, (c_nationkey % 10)::DOUBLE / 100 AS rate, (c_nationkey % 10 + 1)::DOUBLE / 100 AS flat FROM customer)
SELECT key, 'flat' AS kind, 'unknown' AS status, 0 AS idx, NULL::DOUBLE AS threshold, flat AS rate, NULL::DOUBLE AS cumulative, NULL::DOUBLE AS amount, 2 AS line FROM c WHERE form = 0
UNION ALL SELECT key, 'bracket', 'unknown', 0, 0, rate, 0, NULL, 1 FROM c WHERE form = 1 UNION ALL SELECT key, 'bracket', 'unknown', 1, low, 0.2, 7, NULL, 5 FROM c WHERE form = 1 UNION ALL SELECT key, 'bracket', 'unknown', 2, high, 0.5, 5, NULL, 2 FROM c WHERE form = 1
UNION ALL SELECT key, 'bracket', 'single', 0, 0, rate, 0, NULL, 6 FROM c WHERE form = 2 UNION ALL SELECT key, 'bracket', 'single', 1, low, 0.3, 9, NULL, 7 FROM c WHERE form = 2
UNION ALL SELECT key, 'bracket', 'default', 0, high, 0, 1, NULL, 12 FROM c WHERE form = 2 UNION ALL SELECT key, 'deduction', 'single', 0, NULL, NULL, NULL, low, 3 FROM c WHERE form = 2""")
def rate_structure_by_sql(spark, d):
    """The structure of a program for each customer, through the table function in SQL."""
    number = lambda x: F.concat(F.lit("#"), x.cast("string"))
    low, high, rate = (100 + F.col("c_custkey") % 50), (1000 + F.col("c_nationkey")), F.col("c_nationkey") % 10
    cents = lambda x: F.concat(F.lit("#0."), F.lpad(x.cast("string"), 2, "0"))
    flat = F.concat(F.lit("↓ ι @x\n∗ γ ι "), cents(rate + 1))
    brackets = F.concat(F.lit("∗ α π "), cents(rate), F.lit("\n∎ α #5\n∎ γ "), number(high), F.lit("\n∗ δ δ #0.5\n∎ α #7\n∎ γ "), number(low), F.lit("\n− δ π γ\n∗ δ δ #0.2"))
    gates = F.concat(F.lit("⋈ φ κ #0 #1.5\n↘ #2\n∎ γ "), number(low), F.lit("\n⋈ φ κ #0 #1.5\n↘ #6\n∗ α π "), cents(rate), F.lit("\n∎ α #9\n∎ γ "), number(low), F.lit("\n− δ π γ\n∗ δ δ #0.3\n→ #3\n∎ α #1\n∎ γ "), number(high), F.lit("\n↑ α @tax\n◼"))
    form = F.col("c_custkey") % 3
    t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.when(form == 0, flat).when(form == 1, brackets).otherwise(gates).alias("text")).createOrReplaceTempView("customer_programs")
    table_functions.register(spark)
    return spark.sql("SELECT cast(key AS bigint) AS key, kind, status, idx, threshold, rate, cumulative, amount, line FROM extract_rate_structure(TABLE(customer_programs) PARTITION BY key)")


@query("""WITH e AS (SELECT l_orderkey AS doc_id, coalesce(p_retailprice / 1000, 0) AS a, coalesce(p_size / 50.0, 0) AS b FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 4 <> 0),
m AS (SELECT doc_id, avg(a) AS a, avg(b) AS b FROM e GROUP BY 1), z AS (SELECT doc_id, 0.5 * a - b AS x, 0.3 * a + 0.7 * b + 0.1 AS y, -0.2 * a + 0.4 * b AS w FROM m)
SELECT doc_id, round(exp(x) / (exp(x) + exp(y) + exp(w)), 6) AS first, (CASE WHEN x >= y AND x >= w THEN 0 WHEN y >= w THEN 1 ELSE 2 END)::BIGINT AS class FROM z""")
def embed_pool_classify_orders(spark, d):
    """Parts of an order looked up in a table of two features, averaged, classified; parts outside the table count as zeros."""
    tokens = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("id"))
    table = t(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice") / 1000, F.col("p_size") / 50).alias("vector"))
    out = models.embed_pool_classify(tokens, table, 2, np.array([[0.5, 0.3, -0.2], [-1.0, 0.7, 0.4]]), np.array([0.0, 0.1, 0.0]))
    return out.select("doc_id", r(F.get("probabilities", F.lit(0))).alias("first"), F.col("class").cast("long").alias("class"))


@query("SELECT c_custkey AS key, 'error' AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_customers(spark, d):
    """Customers without a pending order."""
    found = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return lookup.missing_keys(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), found)


_KEY = bytes(range(7, 39))
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'no signature' WHEN o_orderkey % 5 = 0 THEN 'unknown algorithm' WHEN o_orderkey % 11 = 0 THEN 'unreadable' WHEN o_orderkey % 3 = 0 THEN 'mismatch' ELSE 'valid' END AS signature FROM orders""")
def signatures_of_order_programs(spark, d):
    """Programs signed by the definition of HMAC in hash functions of the engine, some changed afterwards, then verified."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("LD R0 @x"), k.cast("string"), F.lit("\nADD R0 R0 R1\nHALT"))
    inner = F.sha2(F.unhex(F.concat(F.lit(_INNER), F.hex(F.sha2(body, 256)))), 256)
    sig = F.sha2(F.unhex(F.concat(F.lit(_OUTER), inner)), 256)
    name = F.when(k % 5 == 0, "other").otherwise("hmac-sha256")
    line = F.concat(F.lit("✦ agent=a key="), name, F.lit(":"), F.when(k % 11 == 0, "xyz").otherwise(_KEY.hex()), F.lit(" sig="), sig)
    text = F.concat_ws("\n", F.when(k % 7 != 0, line), F.when(k % 3 == 0, F.concat(body, F.lit(" "))).otherwise(body))
    return lint.verify_hmac(t(spark, d, "orders").select(k.alias("key"), text.alias("text"))).select("key", "signature")


@query("""WITH l AS (SELECT 'chat' AS source, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'program', unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) FROM documents
UNION ALL SELECT 'alpaca', unnest([p_name, p_type]) FROM part) SELECT source, count(*) AS n, sum(length(line))::BIGINT AS characters FROM l GROUP BY 1""")
def corpus_lines_by_source(spark, d):
    """Lines of conversations, of pairs of part names and types, and of documents as programs."""
    chats = t(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    pairs = t(spark, d, "part").select(F.col("p_name").alias("output"), F.col("p_type").alias("instruction"))
    lines = files.corpus_lines(chats.select("messages").unionByName(pairs, allowMissingColumns=True), t(spark, d, "documents").select("text"))
    return lines.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("characters"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS other, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY 1")
def named_votes_by_priority(spark, d):
    """Votes by the name of their strategy; an unknown name means the mean."""
    o = t(spark, d, "orders")
    other, middle = (reduce.vote_named(o, ["o_orderpriority"], "o_totalprice", name).withColumn("value", r("value", 4)) for name in ("whatever", "median"))
    return other.withColumnRenamed("value", "other").join(middle.withColumnRenamed("value", "middle"), "o_orderpriority")


@query("SELECT o_orderkey AS key, o_orderkey % 4 <> 1 AS alone, o_orderkey % 3 <> 2 AS is_code FROM orders")
def self_contained_order_programs(spark, d):
    """Programs that load from a named slot, or only mention one; texts that begin a line with a vocabulary word, or not."""
    k = F.col("o_orderkey")
    load = F.when(k % 4 == 0, "LD R0 #1").when(k % 4 == 1, " LOAD R0 @x").when(k % 4 == 2, "; LD R0 @x").otherwise("ST R0 @x")
    text = F.concat_ws("\n", F.when(k % 3 == 2, "the HALT of it").otherwise("HALT"), F.when(k % 3 == 2, F.concat(F.lit("- "), load)).otherwise(load))
    rows = t(spark, d, "orders").select(k.alias("key"), text.alias("text"), load.alias("load"))
    return rows.select("key", corpus.is_self_contained(F.col("load")).alias("alone"), corpus.looks_like_code(F.col("text"), ["HALT", "LD", "ST"]).alias("is_code"))
