"""Corpora of text pairs: normalise, validate, deduplicate, audit, split, balance.

White space is what Python's strip and splitlines take for it, not blanks alone. Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduce import _with_group

LINE_END = r"\r\n|\r|\n"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def normalize_chat(df: DataFrame, system: str) -> DataFrame:
    """Rows with messages, instruction, input and output become chats that begin with a system message; other forms go."""
    user = F.when(strip(F.col("input")) != "", F.concat_ws("\n", strip(F.col("instruction")), strip(F.col("input")))).otherwise(strip(F.col("instruction")))
    alpaca = F.array(message("system", F.lit(system)), message("user", user), message("assistant", strip(F.col("output"))))
    chat = F.when(F.get("messages", F.lit(0))["role"] == "system", F.col("messages")).otherwise(F.concat(F.array(message("system", F.lit(system))), F.col("messages")))
    new = F.when(F.col("messages").isNotNull(), chat).when(F.col("instruction").isNotNull() & F.col("output").isNotNull(), alpaca)
    return df.withColumn("messages", new).where("messages IS NOT NULL")


def first_of_role(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def looks_like_code(text: Column, words: list[str], symbols: str = "") -> Column:
    """Some line begins with a vocabulary word or one of the symbols."""
    pattern = r"(?m)^\s*(?:" + "|".join(words) + r")\b"
    out = F.coalesce(text, F.lit("")).rlike(pattern)
    return out | F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*[" + symbols + "]") if symbols else out


def is_self_contained(text: Column) -> Column:
    """No line loads from a named slot."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*(?:LD|↓|LOAD)\s+\S+\s+@\w+")


def pair_key(user: Column, assistant: Column) -> Column:
    return F.md5(F.concat(F.coalesce(user, F.lit("")), F.lit("\0"), F.coalesce(assistant, F.lit(""))))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def dedup_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row by `order` (nulls first) of each key, a null key being one. Only (key, order) is compared before the texts are joined back."""
    rows = df.withColumns({"_key": key, "_order": F.struct(*order)})
    first = rows.groupBy("_key").agg(F.min("_order").alias("_first")).withColumnRenamed("_key", "_of")
    same = F.col("_key").eqNullSafe(F.col("_of")) & F.col("_order").eqNullSafe(F.col("_first"))
    return rows.join(first, same, "left_semi").drop("_key", "_order")


#: Words of a vocabulary that become a literal array.
LITERAL = 1_000


def coverage(records: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(word, n): records in which each vocabulary word occurs, once per record; words that never occur have 0."""
    each = F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"(?U)\W+"))
    known = [r["word"] for r in vocabulary.select("word").distinct().limit(LITERAL + 1).collect()]
    if len(known) <= LITERAL:  # few enough to be looked for in each text before its words become rows
        each = F.array_intersect(each, F.array(*map(F.lit, known)).cast("array<string>"))
    words = records.select(F.explode(each).alias("word"))
    found = words.join(vocabulary.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.select("word").distinct().join(found, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_gaps(of: DataFrame, least: int = 200) -> DataFrame:
    """Words below `least`, with gap 'missing' or 'low'."""
    return of.where(F.col("n") < least).withColumn("gap", F.when(F.col("n") == 0, "missing").otherwise("low"))


def lowest_coverage(of: DataFrame, n: int) -> DataFrame:
    return of.where("n > 0").orderBy("n", "word").limit(n)


def replicate_anchors(df: DataFrame, anchor: Column, n: int = 3) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(anchor, F.lit(n)).otherwise(F.lit(1)))))


def _draw(key: Column, seed: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts))


def split_80_10_10(df: DataFrame, key: Column, seed: int = 42, anchor: Column | None = None, copies: int = 3) -> DataFrame:
    """df with split; anchors all go to train, `copies` times. By hash: no sort, and rows stay where they were when others are added."""
    p = _draw(key, seed, 100)
    split = F.when(p < 80, "train").when(p < 90, "valid").otherwise("test")
    if anchor is None:
        return df.withColumn("split", split)
    return replicate_anchors(df.withColumn("split", F.when(anchor, "train").otherwise(split)), anchor, copies).drop("copy")


def split_exact(df: DataFrame, key: Column, shares: tuple[float, ...] = (0.8, 0.1), names: tuple[str, ...] = ("train", "valid", "test"), seed: int = 42) -> DataFrame:
    """df with split of exact sizes int(n * share), the rest last. Each of 1000 buckets of the hash knows how many rows lie below it; only the rows of buckets with a cut in them are ranked."""
    from pyspark.sql import Window

    buckets = 1000
    rows = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_b", F.shiftright(F.col("_h"), 44).cast("long"))
    rows = rows.withColumn("_b", F.pmod(F.col("_b"), F.lit(buckets)))
    counts = sorted((r["_b"], r["n"]) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).collect())  # `buckets` rows
    total, below, seen = sum(n for _, n in counts), [], 0
    for b, n in counts:
        below.append((b, seen))
        seen += n
    ends, at = [], 0
    for s in shares:
        at += int(total * s)
        ends.append(at)
    spark = df.sparkSession
    starts = spark.createDataFrame(below, "_b long, _start long") if below else spark.createDataFrame([], "_b long, _start long")
    sizes = dict(counts)
    with_cut = [b for b, start in below if any(start < end < start + sizes[b] for end in ends)]  # one a cut at most
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *[c for c in df.columns if dict(df.dtypes)[c] in ("bigint", "int", "string")]))
    split = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends, strict=False))):
        split = F.when(F.col("_p") < end, name).otherwise(split)
    rows = rows.join(F.broadcast(starts), "_b")
    ranked = rows.where(F.col("_b").isin(with_cut)).withColumn("_p", F.col("_start") + rank - 1)
    placed = rows.where(~F.col("_b").isin(with_cut)).withColumn("_p", F.col("_start")).unionByName(ranked)
    return placed.withColumn("split", split).drop("_h", "_b", "_start", "_p")


def split_90_10(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(_draw(key, seed, 100) < 90, "train").otherwise("valid"))


def sample_n(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same for the same seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def pad_to(df: DataFrame, anchors: DataFrame, key: Column, least: int = 500) -> DataFrame:
    """df, with random anchors added if it has fewer than `least` rows."""
    have = df.limit(least).count()
    return df if have >= least else df.unionByName(sample_n(anchors, key, least - have))


def equalize(records: DataFrame, words: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """Rows of words(word, key) repeated until each word of targets(word, target) has its number; a word short of it says how many copies it needs.

    Returns (word, key, copy): for each word its records, copied evenly, `target` rows if it had fewer, all of them otherwise. A null word is a word.
    """
    pairs = words.join(records.select(key), key, "left_semi")
    counts = pairs.groupBy("word").agg(F.count("*").alias("n"))
    need = _with_group(targets, counts, ["word"])
    from pyspark.sql import Window

    # ranks within hash buckets of a word, from the rows of the buckets below: no word meets in one task
    pairs = pairs.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(1000)))
    sizes = pairs.groupBy("word", "_b").agg(F.count("*").alias("_m"))
    below = F.sum("_m").over(Window.partitionBy("word").orderBy("_b")) - F.col("_m")  # 1000 rows a word at most
    starts = sizes.select(F.col("word").alias("_word"), F.col("_b").alias("_bucket"), below.alias("_start"))
    rank = F.row_number().over(Window.partitionBy("word", "_b").orderBy(key))
    ranked = pairs.withColumn("_k", rank).join(starts, F.col("word").eqNullSafe(F.col("_word")) & (F.col("_b") == F.col("_bucket"))).withColumn("_r", F.col("_start") + F.col("_k"))
    held = _with_group(ranked, need, ["word"])
    copies = F.when(F.col("n") >= F.col("target"), F.lit(1)).otherwise(F.expr("cast(target div n + if(_r <= target % n, 1, 0) as int)"))
    return held.select("word", key, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def deficits(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(word, missing): max(target - count, 0)."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return _with_group(targets, counts, ["word"], "left").select("word", F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("missing"))


def word_counts(lines: DataFrame, line: str = "line", least: int = 2, special: tuple[str, ...] = ()) -> DataFrame:
    """(word, n) of at least `least`; words by white space, special tokens kept whole."""
    pattern = "|".join([*(rf"\Q{s}\E" for s in special), r"[^\s]+"])
    return lines.select(F.explode(F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def build_corpus(records: DataFrame, system: str, words: list[str], seed: int = 42) -> DataFrame:
    """The whole build: normalise, check answers that look like code, keep the first of equal pairs, split.

    records: messages, instruction, input, output, file, pos. Gives system, user, assistant, key, split.
    """
    chats = normalize_chat(records, system)
    rows = chats.select("file", "pos", *[first_of_role(F.col("messages"), r).alias(r) for r in ("system", "user", "assistant")])
    rows = rows.where((F.col("user") != "") & (F.col("assistant") != "")).withColumn("key", pair_key(F.col("user"), F.col("assistant")))
    rows = rows.withColumn("is_code", looks_like_code(F.col("assistant"), words))
    return split_80_10_10(dedup_first(rows, F.col("key"), "file", "pos"), F.col("key"), seed)
