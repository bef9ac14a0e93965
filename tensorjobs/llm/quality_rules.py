"""Quality rules as a bitmask ledger: each rule is evaluated once per document, its verdict is a bit.

`ledger` stores measurements and the bits of failed rules; policies are versioned masks over those
bits, and ablations are counts over distinct masks. Built-in functions only, no shuffle before the
(tiny) aggregation by mask.

Defined results: a null or blank text has no words, so it fails `too_few_words`; repeated rows are
judged alike; texts of any length are measured whole; other columns pass through `ledger` unless they are called like a
measure or `failed`, then the ledger's wins; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, sql_words, table, unused

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over MEASURES


#: A rule's bit never changes its meaning; new rules take new bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_lines >= 4"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "very_long_word", "longest_word > 1000"),
)


def mask_of(*names: str) -> int:
    known = {r.name: r.bit for r in RULES}
    return sum(1 << known[n] for n in names)


#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": mask_of("too_few_words", "repeated_windows"),
    "v1": mask_of("too_few_words", "repeated_windows", "many_symbols", "repeated_lines"),
    "v2": mask_of(*(r.name for r in RULES)),
}


def windows(hashes: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words, from the words' hashes."""
    return F.when(
        F.size(hashes) >= WINDOW,
        # element by element: slice() would copy the whole array for each window
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))


def covered(starts: Column) -> Column:
    """Words under windows that begin at the given places, which are in order."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )


def repeat_words(words: Column) -> Column:
    """Words in windows that the text has twice or more. Only texts that repeat a window sort theirs."""

    def starts(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def count(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(pairs, lambda p: covered(starts(p)))).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def measures(text: Column) -> Column:
    """A struct of MEASURES."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of = lambda w, n: {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)),
        "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(n),
        "longest_word": F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)),
    }
    return let(sql_words(text), lambda w: let(lines, lambda n: F.struct(*[x.cast("long").alias(k) for k, x in of(w, n).items()])))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with MEASURES and `failed` (long): bit r.bit is set where rule r fails."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "failed")]
    m = unused(docs, "_m")[0]
    bits = [f"shiftleft(cast(coalesce({r.fails}, false) as bigint), {r.bit})" for r in rules]
    measured = docs.select(*kept, measures(F.col("text")).alias(m)).select(*kept, f"`{m}`.*")
    return measured.withColumn("failed", F.expr(" | ".join(bits)))


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(of: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it fails, documents kept without it.

    One aggregation by mask (2**rules rows at most) answers all rules; no document is looked at again.
    """
    mask = POLICIES[policy]
    by_mask = of.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule")) for r in used]))
    one = F.expr("shiftleft(1L, r.bit)")
    return (
        by_mask.select("m", "n", each.alias("r"))
        .groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == one, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(one)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base_failed = ~passes(F.col("failed"), "base")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & passes(F.col("failed"), "v1")).alias("kept"), "failed",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines FROM m),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END) | (CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END)
  | (CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_lines >= 4 THEN 8 ELSE 0 END) | (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END)
  | (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) | (CASE WHEN longest_word > 1000 THEN 64 ELSE 0 END) AS failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept, failed::BIGINT AS failed FROM f"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that policy v1 keeps."""
    return ledger(docs.select("doc_id", "text", "lang", "source", "n_chars")).where(passes(F.col("failed"), "v1")).drop(*MEASURES, "failed")
