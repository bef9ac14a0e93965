"""Text jobs on small programs: compact and expand, translate, lint, suggest, patch, verify signatures."""

from __future__ import annotations

import difflib
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import small

LINE_END = r"\r\n|\r|\n"


def uncommented(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r";.*$", ""), r"\s+", " "))


def compact(text: Column, delimiter: str = "¶") -> Column:
    """Lines without comments and spare blanks, joined; empty ones go."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), uncommented), lambda x: x != ""), delimiter)


def expand(text: Column, delimiter: str = "¶") -> Column:
    return F.array_join(F.transform(F.split(text, rf"\Q{delimiter}\E"), F.trim), "\n")


def detect_syntax(text: Column, symbols: str, classic: list[str], verbose: list[str]) -> Column:
    """symbolic, classic, verbose or unknown, from the first 500 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    word = lambda words: head.rlike(r"(?m)^\s*(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")
    return F.when(head.rlike(f"[{symbols}]"), "symbolic").when(word(classic), "classic").when(word(verbose), "verbose").otherwise("unknown")


def translate_tokens(text: Column, ops: dict[str, str], registers: dict[str, str]) -> Column:
    """Each line's first token by `ops`, the others by `registers` (both looked up in upper case); comments stay."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    o, r = table(ops), table(registers)

    def line(s: Column) -> Column:
        comment = F.regexp_extract(s, r"(;.*)$", 1)
        tokens = F.filter(F.split(F.trim(F.regexp_replace(s, r";.*$", "")), r"\s+"), lambda t: t != "")
        new = F.transform(tokens, lambda t, i: F.when(i == 0, F.coalesce(F.try_element_at(o, F.upper(t)), t)).otherwise(F.coalesce(F.try_element_at(r, F.upper(t)), t)))
        return F.trim(F.concat_ws(" ", F.array_join(new, " "), comment))

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), line), "\n")


def io_names(text: Column) -> tuple[Column, Column]:
    """Names loaded and names stored, in order of appearance."""
    find = lambda words: F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:" + words + r")\s+\S+\s+@(\w+)"), F.lit(1))
    return find("↓|LD|LOAD"), find("↑|ST|STORE")


def lint_lines(programs: DataFrame, arity: DataFrame, jumps: list[str], halt: list[str], outputs: list[str], opens: str = "FRAG", closes: str = "ENDF") -> DataFrame:
    """(key, kind, severity, line): findings of programs(key, text) against arity(word, low, high).

    invalid_opcode, wrong_operand_count, invalid_jump, unmatched_endf per line; missing_halt, empty_program (errors),
    unclosed_fragment, no_output (warnings) per program. One window per program; the vocabulary is broadcast if it is small.
    """
    lines = programs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("line", "s")).withColumn("s", uncommented(F.col("s"))).where("s <> ''")
    tokens = F.split("s", " ")
    code = lines.select("key", (F.col("line") + 1).alias("line"), F.upper(F.get(tokens, F.lit(0))).alias("word"), (F.size(tokens) - 1).alias("operands"), F.get(tokens, F.size(tokens) - 1).alias("last"))
    w = Window.partitionBy("key").orderBy("line")
    whole = Window.partitionBy("key")
    step = F.when(F.col("word") == opens, 1).when(F.col("word") == closes, -1).otherwise(0)
    code = code.withColumns({"idx": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "depth": F.sum(step).over(w)})
    code = code.withColumn("low", F.min("depth").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    known = code.join(small(arity.select("word", "low", "high").withColumnsRenamed({"low": "least", "high": "most"})), "word", "left")
    target = F.col("idx") + F.regexp_extract("last", r"#?(-?\d+)$", 1).try_cast("int")
    found = F.array(
        F.when(F.col("least").isNull(), "invalid_opcode"),
        F.when(~F.col("operands").between(F.col("least"), F.col("most")), "wrong_operand_count"),
        F.when(F.col("word").isin(jumps) & ((target < 0) | (target >= F.col("n"))), "invalid_jump"),
        F.when((F.col("word") == closes) & (F.col("depth") < F.least(F.lit(0), F.coalesce("low", F.lit(0)))), "unmatched_endf"),
    )
    per_line = known.select("key", "line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind")).withColumn("severity", F.lit("error"))
    facts = code.groupBy("key").agg(
        F.bool_or(F.col("word").isin(halt)).alias("halts"), F.bool_or(F.col("word").isin(outputs)).alias("stores"),
        F.count_if(F.col("word") == opens).alias("opened"), F.count_if(F.col("word") == closes).alias("closed"), F.least(F.min("depth"), F.lit(0)).alias("under"),
    )
    whole_program = programs.select("key").distinct().join(facts, "key", "left")
    issues = F.array(
        F.when(F.col("halts").isNull(), F.struct(F.lit("empty_program").alias("kind"), F.lit("error").alias("severity"))),
        F.when(~F.col("halts"), F.struct(F.lit("missing_halt").alias("kind"), F.lit("error").alias("severity"))),
        F.when(F.col("opened") - (F.col("closed") + F.col("under")) > 0, F.struct(F.lit("unclosed_fragment").alias("kind"), F.lit("warning").alias("severity"))),
        F.when(~F.col("stores"), F.struct(F.lit("no_output").alias("kind"), F.lit("warning").alias("severity"))),
    )
    per_program = whole_program.select("key", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select("key", F.lit(None).cast("int").alias("line"), "x.kind", "x.severity")
    return per_line.select("key", "kind", "severity", "line").unionByName(per_program)


def suggest_word(unknown: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, suggestion): the nearest vocabulary word by edit distance, at most 2 for words of 4 letters or less, else 3; of equals the first in the vocabulary.

    The vocabulary becomes literal arrays of 10000 words each, so distinct unknown words are read once and no pairs are made.
    """
    known = list(dict.fromkeys(vocabulary))
    part = lambda lo: F.array(*[F.lit(v) for v in known[lo : lo + 10_000]])
    near = lambda lo: F.array_min(F.transform(part(lo), lambda v, i: F.struct(F.levenshtein(F.upper("word"), v).alias("d"), (i + lo).alias("i"), v.alias("v"))))
    best = F.array_min(F.array(*[near(lo) for lo in range(0, max(len(known), 1), 10_000)]))
    limit = F.when(F.length("word") <= 4, 2).otherwise(3)
    return unknown.select("word").distinct().withColumn("n", best).select("word", F.when(F.col("n.d") <= limit, F.col("n.v")).alias("suggestion"))


#: Edits that may part a word from its suggestion, in words of up to SHORT letters and longer ones.
NEAR_SHORT, NEAR, SHORT = 2, 3, 4
#: Letters from which words are compared by pieces instead of deletions, whose number grows with the cube of the length.
LONG = 22


def suggest_word_from(unknown: DataFrame, vocabulary: DataFrame, word: str = "word", place: str = "place") -> DataFrame:
    """As `suggest_word`, from a vocabulary of any size: a table of `word` and `place`, its order.

    Two words within d edits become equal by at most d deletions from each: both sides list what their deletions leave, and equality joins bring
    near words together. Words of LONG letters and more list pieces instead: with NEAR edits, one of NEAR + 1 pieces of the vocabulary's word stands
    in the other unchanged, moved by NEAR places at most. The exact distance is taken of these candidates only. Null words are left out.
    """
    asked = unknown.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct().withColumn("u", F.upper("word"))
    limit = F.when(F.length("word") <= SHORT, NEAR_SHORT).otherwise(NEAR)
    known = vocabulary.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("v")).agg(F.min(place).alias("place"))
    left = asked.withColumn("limit", limit)
    forms = lambda df, c, most: df.select("*", F.explode(_deletions(F.col(c), most)).alias("form"))
    short = forms(left.where(F.length("u") < LONG + NEAR), "u", F.col("limit")).join(forms(known.where(F.length("v") < LONG), "v", F.lit(NEAR)), "form")
    pieces = _by_pieces(left.where(F.length("u") >= LONG - NEAR), known.where(F.length("v") >= LONG))
    columns = ["word", "u", "limit", "v", "place"]
    pairs = short.select(columns).unionByName(pieces.select(columns)).distinct()
    near = pairs.withColumn("d", F.levenshtein("u", "v")).where(F.col("d") <= F.col("limit"))
    best = near.groupBy("word").agg(F.min(F.struct("d", "place", "v")).alias("b")).select("word", F.col("b.v").alias("suggestion"))
    return asked.select("word").join(best, "word", "left")


def _deletions(word: Column, most: Column) -> Column:
    """All that is left of a word after up to `most` deletions."""
    from itertools import combinations

    @F.pandas_udf("array<string>")
    def kernel(words: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for w, m in zip(words, most, strict=True):
            left = {w}
            for k in range(1, min(int(m), len(w)) + 1):
                left.update("".join(c) for c in combinations(w, len(w) - k))
            out.append(list(left))
        return pd.Series(out, dtype=object)

    return kernel(word, most)


def _by_pieces(left: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of long words of which a piece of the known one stands in the other, near its place."""
    n = NEAR + 1
    # piece i of a word of length l begins at floor(i * l / n)
    at = lambda i, length: F.floor(i * length / n).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    one = known.select("*", F.length("v").alias("l"), F.explode(numbers).alias("i"))
    one = one.withColumn("form", F.expr(f"substring(v, cast(floor(i * l / {n}) as int) + 1, cast(floor((i + 1) * l / {n}) as int) - cast(floor(i * l / {n}) as int))"))
    probes = left.select("*", F.explode(F.sequence(F.length("u") - NEAR, F.length("u") + NEAR)).alias("l")).select("*", F.explode(numbers).alias("i"))
    start = at(F.col("i"), F.col("l"))
    probes = probes.withColumns({"s": start, "m": at(F.col("i") + 1, F.col("l")) - start}).select("*", F.explode(F.sequence(F.greatest(F.col("s") - NEAR, F.lit(0)), F.col("s") + NEAR)).alias("p"))
    probes = probes.withColumn("form", F.substring(F.col("u"), F.col("p") + 1, F.col("m"))).where(F.length("form") == F.col("m")).select("word", "u", "limit", "l", "i", "form").distinct()
    return probes.join(one, ["l", "i", "form"])


_SIGN_LINE = r"^\s*✦\s+"
_SIGNED = r"^\s*✦\s+agent=(\S+)\s+key=(\S+?):(\S+)\s+sig=(\S+)"


def verify_hmac(df: DataFrame, text: str = "text", out: str = "signature") -> DataFrame:
    """df with 'valid', 'mismatch', 'no signature', 'unknown algorithm' or 'unreadable' for the first sign line of each program.

    A line '✦ agent=NAME key=ALGORITHM:KEY sig=HEX' signs the sha256 of all other lines (sign lines left out), by HMAC-SHA256 with
    the key's bytes. What can't be parsed or has a key that is no hex is unreadable; other algorithms than hmac-sha256 are unknown.
    """
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    sign = F.get(F.filter(lines, lambda x: x.rlike(_SIGN_LINE)), F.lit(0))
    # a line end at the very end opens no further line
    bare = F.filter(F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), lambda x: ~x.rlike(_SIGN_LINE))
    digest = F.sha2(F.array_join(bare, "\n"), 256)
    part = lambda i: F.regexp_extract(sign, _SIGNED, i)

    @F.pandas_udf("string")
    def check(digests: pd.Series, keys: pd.Series, given: pd.Series) -> pd.Series:
        def one(d: str, k: str, s: str) -> str:
            try:
                key = bytes.fromhex(k)
            except ValueError:
                return "unreadable"
            return "valid" if hmac.compare_digest(hmac.new(key, d.encode(), "sha256").hexdigest().encode(), s.encode()) else "mismatch"

        return pd.Series([one(*x) for x in zip(digests, keys, given, strict=True)], dtype=object)

    verdict = (
        F.when(sign.isNull(), "no signature")
        .when(~sign.rlike(_SIGNED), "unreadable")
        .when(part(2) != "hmac-sha256", "unknown algorithm")
        .otherwise(check(digest, F.coalesce(part(3), F.lit("")), F.coalesce(part(4), F.lit(""))))
    )
    return df.withColumn(out, verdict)


def extract_code_and_data(df: DataFrame, text: str = "response") -> DataFrame:
    """df with code and data: the first fenced block, and a later one that declares tensors; one mixed block is parted by line; without fences the lines that look like code."""

    @F.pandas_udf("struct<code:string,data:string>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.fillna(""):
            blocks, now = [], None
            for line in t.splitlines():
                if line.strip().startswith("```"):
                    if now is None:
                        now = []
                    else:
                        blocks.append(now)
                        now = None
                elif now is not None:
                    now.append(line)
            if now:
                blocks.append(now)
            is_data = lambda x: x.lstrip().startswith("@") and "shape=" in x
            if not blocks:
                code, data = [x for x in t.splitlines() if x[:1].isupper() and x.split()[:1] and x.split()[0].isupper()], []
            else:
                code = [x for x in blocks[0] if not is_data(x)]
                data = next((b for b in blocks[1:] if any(map(is_data, b))), [x for x in blocks[0] if is_data(x)])
            out.append(("\n".join(code), "\n".join(data)))
        return pd.DataFrame(out, columns=["code", "data"])

    return df.withColumn("_p", parts(F.col(text))).withColumns({"code": F.col("_p.code"), "data": F.col("_p.data")}).drop("_p")


def make_patch(pairs: DataFrame) -> DataFrame:
    """(key, base_hash, op, line, text): line edits from old to new text of each key. `set` and `ins` lines count after deletions."""
    names = ["key", "base_hash", "op", "line", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, old, new in zip(pdf.key, pdf.old.fillna(""), pdf.new.fillna(""), strict=True):
                base, a, b = hashlib.sha256(old.encode()).hexdigest()[:16], old.split("\n"), new.split("\n")
                gone = 0
                for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    same = min(j - i, m - k) if tag == "replace" else 0
                    out += [(key, base, "set", i - gone + x, b[k + x]) for x in range(same)]
                    if tag in ("delete", "replace"):
                        out += [(key, base, "del", x, None) for x in range(i + same, j)]
                    if tag in ("insert", "replace"):
                        out += [(key, base, "ins", i + same - gone, b[x]) for x in range(k + same, m)]
                    gone += max(0, j - i - same) if tag in ("delete", "replace") else 0
            yield pd.DataFrame(out, columns=names)

    return pairs.select("key", "old", "new").mapInPandas(run, "key string, base_hash string, op string, line int, text string")


def apply_patch(base: DataFrame, patch: DataFrame) -> DataFrame:
    """(key, text, status): base(key, text) with its edits, 'ok', or unchanged with 'base mismatch'. Edits of a key: deletions from the bottom, sets, insertions from the bottom."""

    def run(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame(columns=["key", "text", "status"])
        text = a.text.iloc[0] or ""
        if len(b) and (b.base_hash != hashlib.sha256(text.encode()).hexdigest()[:16]).any():
            return pd.DataFrame([(keys[0], text, "base mismatch")], columns=["key", "text", "status"])
        lines = text.split("\n")
        for x in sorted(b[b.op == "del"].line, reverse=True):
            del lines[x]
        for x, s in b[b.op == "set"][["line", "text"]].itertuples(index=False):
            lines[x] = s
        for x, g in sorted(b[b.op == "ins"].groupby("line", sort=False), key=lambda p: -p[0]):
            lines[x:x] = (g.sort_values("seq") if "seq" in g else g).text.tolist()
        return pd.DataFrame([(keys[0], "\n".join(lines), "ok")], columns=["key", "text", "status"])

    return base.groupBy("key").cogroup(patch.groupBy("key")).applyInPandas(run, "key string, text string, status string")
