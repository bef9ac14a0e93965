"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is
- a value assigned to a keyword (password = ..., "token": ...), of any length and characters,
- a password of a URL (scheme://user:password@host),
- a key with a known prefix (AKIA..., ghp_..., PREFIXES),
- a piece of the body of a PEM private key, also with line ends written as \\n,
- a run of 16 or more key characters with a digit in it, inside a word.
The forest sees its form, length, character transitions and distribution, how much of it a dictionary covers
(the most frequent words of the documents themselves, and words of identifiers), the path of its document and the neighbouring words. It learns from labelled
findings and gives every verdict: no rule stands beside it. Findings of one's own are a parameter; without them it learns from `examples`, a
documented table of labelled texts: EXAMPLES lists contexts with the kind of value in them and the label, each written out COPIES times with values drawn by a fixed seed.

Out of reach: values after a keyword without : or = ("the password is ...", <password>...</password>), values on another
line than an opening quote, the rest of unquoted values after a blank, a quote or one of , ; &, runs without keyword and
prefix that are shorter than 16 or have no digit, and secrets that are split or encoded.

Built-in functions and the DataFrame forest only. Texts without candidates are dropped by one pattern
before anything is taken apart. Defined results: null and empty texts have no candidates; null paths
are empty; rows that repeat an id are scanned one by one; candidates of any length are examined whole;
with labels of one class only, that class is the verdict for all; with an empty table of labels, nothing is removed; columns of docs keep
their names and values in `redact`, whatever they are called, and `scan` returns none of them.
"""

from __future__ import annotations

import random
import re
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, sql_words, table, unused

#: Looks ahead only where a run begins, so that long runs take linear time.
CANDIDATE = r"(?<![A-Za-z0-9_\-+/=])(?=[A-Za-z_\-+/=]*+[0-9])[A-Za-z0-9_\-+/=]{16,}+"
#: Patterns whose first group is the candidate; nothing is matched after it.
ASSIGNED = (
    r"(?i)(?<![a-z])(?:[a-z]{0,24}[_\-.])?(?:passw(?:or)?d|passphrase|pass|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|authorization|credentials?|key)"
    r"(?:[_\-]?(?:key|token|id|secret|hash|[0-9]{1,4}))?[\"'`\])]{0,2}\s{0,8}(?::=|=>|==?|:)\s{0,8}(?:(?:bearer|basic|token)\s{1,4})?[\"'`]?"
    r"((?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)|[^\s\"'`,;&]+)"
)
URL = r"://[^\s/:@\"'<>]{0,256}:([^\s/\"'<>]+)(?=@[A-Za-z0-9\[])"
PREFIXES = (
    r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abeprs]-[A-Za-z0-9\-]{10,}"
    r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{20,}|(?<![_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+)"
)
PEM = r"(?s)-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\z)"
FORMS = {"assigned": ASSIGNED, "url": URL, "prefix": PREFIXES}
#: Values that stand for a secret, as a whole.
STANDIN = r"(?i)^(?:passw(?:or)?d|pass|pwd|secret|token|key|user|none|null|true|false|nil|undefined|[*x.\-_#]+|[$%<{\[(].*|.*\(\)?|os\..*|process\..*|self\..*)$"
TREES, DEPTH, SEED = 30, 10, 11
KEYWORDS = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential|private)"
HARMLESS = r"(?i)(commit|sha|md5|checksum|digest|uuid|order|card|phone|isbn|issue|revision|etag)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your|test|xxxx|0123456789|1234567890|abcdef0)"
PATHS = r"(?i)(test|example|sample|doc|fixture|mock|demo)"
#: Words taken from the documents as a dictionary.
WORDS = 3_000
#: Words that readable identifiers are made of, also where nothing parts them.
DICTIONARY = (
    "the and for with that this from not are was will have page file user name data test example sample index image item list "
    "order number value config default version build release commit branch docs path home server client local public private "
    "key token secret password auth api url http https www com org net html json xml text string date time year month day "
    "first last next new old main core base lib src bin tmp log error info debug"
).split()
FEATURES = (
    "is_pem", "is_prefix", "is_url", "is_assigned", "standin", "special_share", "blanks",
    "length", "digit_share", "upper_share", "lower_share", "hex", "kind_changes", "case_changes", "distinct_share", "entropy",
    "dictionary_share", "placeholder", "slashes", "path_harmless", "before_keyword", "before_harmless", "before_assigns", "after_harmless", "quoted",
)


def has_candidates(text: Column) -> Column:
    return F.coalesce(text.rlike(CANDIDATE) | text.rlike(ASSIGNED) | text.rlike(URL) | text.rlike(PREFIXES) | text.contains("PRIVATE KEY"), F.lit(False))


SPACE = r"[\x20\x09-\x0D]"
#: Pieces whose word ends are summed at once.
STRIDE = 256


def _forms(text: Column, kind: str) -> Column:
    """Structs (kind, at, candidate) of one pattern. Each match is taken with what is before it; \\G keeps the search for the last one linear.

    A candidate's word has the number of the words that end before it. Ends are counted in each piece once and summed over
    whole strides first, so that very many matches in one text cost little more than few.
    """
    pattern = FORMS[kind]
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    pattern = flags + r"\G.*?" + pattern.removeprefix("(?i)")
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("c"))

    def ends(ps: Column, i: Column, part: Column) -> Column:
        """Ends of words in the beginning of piece i, the one that its first character marks included."""
        open_ = F.coalesce(F.right(F.get(ps, i - 1)["m"], F.lit(1)).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) & part.rlike("^" + SPACE)
        return F.regexp_count(part, F.lit("(?<=[^\\x20\\x09-\\x0D])" + SPACE)) + open_.cast("int")

    def placed(ps: Column) -> Column:
        each = F.transform(ps, lambda x, i: F.struct(ends(ps, i, x["m"]).alias("all"), ends(ps, i, F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(x["c"]))).alias("own"), x["c"].alias("c")))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, y: n + y)
        sums = lambda es: F.transform(F.sequence(F.lit(0), F.floor(F.size(es) / STRIDE).cast("int")), lambda b: F.aggregate(F.slice(es, b * STRIDE + 1, F.lit(STRIDE)), F.lit(0), lambda n, y: n + y["all"]))
        before = lambda es, ss, i: total(F.slice(ss, F.lit(1), F.floor(i / STRIDE).cast("int"))) + F.aggregate(F.slice(es, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE), F.lit(0), lambda n, y: n + y["all"])
        return let(each, lambda es: let(sums(es), lambda ss: F.transform(es, lambda x, i: F.struct(F.lit(kind).alias("kind"), (before(es, ss, i) + x["own"]).alias("at"), x["c"].alias("candidate")))))

    return F.when(text.rlike(FORMS[kind]), let(pieces, placed)).otherwise(F.array().cast("array<struct<kind:string,at:int,candidate:string>>"))


def _pem(text: Column, words: Column) -> Column:
    """Structs (kind, at, candidate) of the pieces of PEM bodies; at is the first word that has the piece."""
    bodies = F.regexp_extract_all(text, F.lit(PEM), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(F.array_join(bodies, " "), r"\\[nr]", "\n"), r"(?m)^[A-Za-z\-]+: .*$", " ")
    pieces = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/]{4,}={0,2}"), F.lit(0)))
    at = lambda c: F.array_position(F.transform(words, lambda w: w.contains(c)), F.lit(True)).cast("int") - 1
    found = F.transform(pieces, lambda c: F.struct(F.lit("pem").alias("kind"), at(c).alias("at"), c.alias("candidate")))
    return F.when(text.contains("PRIVATE KEY"), found).otherwise(F.array().cast("array<struct<kind:string,at:int,candidate:string>>"))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """A row per candidate: doc_id, text_key, at (number of the word it starts in), word, kind, candidate, path, before2, before, after."""
    text = F.col("text")
    words = docs.where(has_candidates(text)).select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(path, F.lit("")).alias("path"), "text", sql_words(text).alias("w"))
    numbered = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].rlike(CANDIDATE))
    run = lambda x: F.transform(F.regexp_extract_all(x["word"], F.lit(CANDIDATE), F.lit(0)), lambda c: F.struct(F.lit("run").alias("kind"), x["at"].alias("at"), c.alias("candidate")))
    order = F.create_map(*[F.lit(x) for k, i in (("pem", 0), ("prefix", 1), ("url", 2), ("assigned", 3), ("run", 4)) for x in (k, i)])
    every = F.concat(_pem(text, F.col("w")), *[_forms(text, k) for k in ("prefix", "url", "assigned")], F.flatten(F.transform(numbered, run)))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["at"].alias("at"), x["candidate"].alias("candidate"), order[x["kind"]].alias("order"), x["kind"].alias("kind"))))
    same = lambda x, y: (x["at"] == y["at"]) & (x["candidate"] == y["candidate"])
    # the first form that has a candidate stands
    forms = let(ordered, lambda xs: F.filter(xs, lambda x, i: ~F.coalesce(same(x, F.get(xs, i - 1)), F.lit(False))))
    hits = words.select("doc_id", "text_key", "path", "w", F.explode(forms).alias("x"))
    near = lambda k: F.coalesce(F.get("w", F.col("x.at") + k), F.lit(""))
    return hits.select("doc_id", "text_key", "path", F.col("x.at").alias("at"), near(0).alias("word"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"), "x.kind", "x.candidate")


def word_list(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The `size` most frequent words of plain small letters in all documents, counted before the shuffle; ties in the order of letters."""
    each = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9_\-+/=])[a-z]{3,12}(?![A-Za-z0-9_\-+/=])"), F.lit(0))).alias("word"))
    return sorted(r["word"] for r in each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect())


def featured(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """found with the columns FEATURES (doubles). words: a list of real words; letters of a candidate between other characters that are one count as covered."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda x: x.cast("double")
    # ends of the runs of equal characters in the sorted array: their lengths give the distribution
    runs = let(F.array_sort(F.split(c, "")), lambda x: F.filter(F.transform(x, lambda y, i: F.when(~F.get(x, i + 1).eqNullSafe(y), i + 1)), lambda y: y.isNotNull()))
    found = found.withColumn("_e", runs)
    p = lambda e, ends, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0))) / n
    bits = lambda q: -q * F.log2(q)
    entropy = let(F.col("_e"), lambda ends: F.aggregate(F.transform(ends, lambda e, i: bits(p(e, ends, i))), F.lit(0.0), lambda a, x: a + x))
    covered = F.lit(0.0)
    if words:
        known = F.array(*map(F.lit, words))
        covered = F.aggregate(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda x: F.array_contains(known, x)), F.lit(0), lambda a, x: a + F.length(x)) / n
    before = F.concat_ws(" ", "before2", "before", F.expr("substring_index(word, candidate, 1)"))
    return found.withColumns(
        {
            **{f"is_{k}": flag(F.col("kind") == k) for k in ("pem", "prefix", "url", "assigned")},
            "standin": flag(c.rlike(STANDIN)),
            "special_share": share(r"[^A-Za-z0-9\s]"),
            "blanks": share(r"\s"),
            "length": F.log2(n.cast("double")),
            "digit_share": share("[0-9]"),
            "upper_share": share("[A-Z]"),
            "lower_share": share("[a-z]"),
            "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "kind_changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
            "case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "distinct_share": F.size("_e") / n,
            "entropy": entropy,
            "dictionary_share": F.greatest(covered, 1 - F.length(F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")) / n),
            "placeholder": flag(c.rlike(PLACEHOLDER)),
            "slashes": share("[/=+]"),
            "path_harmless": flag(F.col("path").rlike(PATHS)),
            "before_keyword": flag(before.rlike(KEYWORDS)),
            "before_harmless": flag(before.rlike(HARMLESS)),
            "before_assigns": flag(before.rlike("[=:]")),
            "after_harmless": flag(F.col("after").rlike(HARMLESS)),
            "quoted": flag(F.col("word").rlike("[\"'`]")),
        }
    ).drop("_e")


#: Labelled contexts: 1 for secrets, 0 for what only looks like one; {v} is the value, of the kind named (`_value`).
EXAMPLES = (
    (1, 'token = "{v}"', "hex40"), (1, 'token = "{v}"', "base62"), (1, 'token = "{v}"', "letters"), (1, 'password = "{v}"', "password"), (1, "DB_PASSWORD={v}", "password"),
    (1, "db_password: '{v}'", "spaced"), (1, 'pwd = "{v}"', "odd"), (1, "DB_PASS={v}", "odd"), (1, '"api_key": "{v}"', "base62"), (1, "api-key={v}", "hex32"), (1, "secret: {v}", "base64"),
    (1, "Authorization: Bearer {v}", "base62"), (1, "aws_secret_access_key = {v}", "base64"), (1, "access_key={v}", "upper"), (1, "private_key: '{v}'", "base64"), (1, "auth_token := {v}", "hex40"),
    (1, 'client_secret => "{v}"', "password"), (1, "token = {v}", "password"), (1, "token = {v}", "long"), (1, "token = {v}", "base62"), (1, 'credentials = "{v}"', "password"), (1, "secret_key = {v}", "hex40"),
    (1, "postgres://admin:{v}@db.host/x", "password"), (1, "https://bot:{v}@git.host/r.git", "base62"), (1, "redis://:{v}@cache:6379", "hex32"), (1, "mysql://root:{v}@db", "odd"),
    (1, "it was AKIA{v} there", "upper"), (1, "it was ghp_{v} there", "base62"), (1, "use sk_live_{v} now", "base62"), (1, "hook xoxb-{v} here", "base62"), (1, "AIza{v}", "base62"), (1, "got glpat-{v}", "base62"),
    (1, "eyJ{v}.{v}.{v}", "base62"), (1, "npm_{v}", "base62"), (1, "hf_{v}", "letters"), (1, "github_pat_{v}", "base62"),
    (1, "-----BEGIN RSA PRIVATE KEY-----\n{v}\n{v}\n{v}\n-----END RSA PRIVATE KEY-----", "base64"), (1, "-----BEGIN PRIVATE KEY-----\n{v}\n{v}\n-----END PRIVATE KEY-----", "letters"),
    (1, '{"k": "-----BEGIN PRIVATE KEY-----\\n{v}\\n{v}\\n-----END PRIVATE KEY-----"}', "base64"), (1, "-----BEGIN EC PRIVATE KEY-----\n{v}==\n-----END EC PRIVATE KEY-----", "short"),
    (0, "commit {v} was merged", "hex40"), (0, "commit {v} was merged", "base62"), (0, "sha256: {v}", "hex64"), (0, "md5 {v}", "hex32"), (0, "checksum={v}", "hex32"), (0, "etag {v}", "hex32"), (0, "digest {v}", "base64"),
    (0, "revision {v} of it", "hex40"), (0, "order {v} came", "digits"), (0, "card {v} was used", "digits"), (0, "and {v} then", "digits"), (0, "phone {v}", "digits"), (0, "isbn {v}", "digits"), (0, "{v} {v}", "digits"),
    (0, "uuid {v}", "uuid"), (0, "item {v} here", "uuid"), (0, "see {v} for it", "path"), (0, "the {v} build", "slug"), (0, "release {v} is out", "slug"), (0, "by {v} in", "slug"), (0, "cached as {v} there", "hex40"),
    (0, "some {v} words", "hex32"), (0, 'password = "{v}"', "placeholder"), (0, "token: {v}", "placeholder"), (0, "api_key={v}", "placeholder"), (0, 'secret = "{v}"', "standin"), (0, "password: {v}", "standin"),
    (0, "token = {v}", "variable"), (0, "password = {v}", "variable"), (0, "DB_PASS={v}", "variable"), (0, "The key: {v} was found", "word"), (0, "the secret: {v} knew", "word"), (0, "token: {v} of love", "word"),
    (0, "a pass: {v}, they said", "word"), (0, "the auth: {v}.", "word"), (0, "http://user:{v}@host/x", "standin"), (0, "https://me:{v}@example.org", "standin"), (0, "ftp://a:{v}@b", "variable"),
    (0, "AKIA{v}EXAMPLE", "upper9"), (0, 'sort_key = "{v}"', "name"), (0, "primary key: {v}", "name"), (0, 'key = "{v}"', "name"),
)
COPIES = 16


def _value(rng: random.Random, kind: str) -> str:
    pick = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    word = lambda: rng.choice(DICTIONARY)
    small, large, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    return {
        "hex32": lambda: pick("0123456789abcdef", 32, 32), "hex40": lambda: pick("0123456789abcdef", 40, 40), "hex64": lambda: pick("0123456789abcdef", 64, 64),
        "base62": lambda: pick(small + large + digits, 20, 40), "letters": lambda: pick(small + large, 22, 64), "base64": lambda: pick(small + large + digits + "+/", 40, 64), "short": lambda: pick(small + large + digits, 8, 16),
        "upper": lambda: pick(large + digits, 16, 16), "upper9": lambda: pick(large + digits, 9, 9), "digits": lambda: pick(digits, 16, 19), "long": lambda: pick(small + large + digits, 4, 6) * rng.randint(20, 2000),
        "password": lambda: rng.choice([pick(small, 4, 9) + rng.choice(["", "-", "!", "_"]) + pick(digits, 2, 4), pick(large, 1, 1) + pick(small + digits, 5, 11) + pick(digits, 1, 2), word().title() + pick(digits, 3, 4) + rng.choice("!#%")]),
        "spaced": lambda: f"{pick(large, 1, 1)}{pick(small + digits, 4, 7)}{rng.choice(' 	')}{pick(small, 3, 6)} {pick(digits, 2, 3)}", "odd": lambda: pick(small + digits, 2, 4) + rng.choice("$!%") + rng.choice(["", "\\", "$"]) + pick(small + large + digits, 3, 6) + rng.choice("!$%*?"),
        "uuid": lambda: "-".join(pick("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)), "path": lambda: "/".join([word(), word() + "-" + word(), word() + pick(digits, 1, 3)]) + "/" + word(),
        "slug": lambda: "-".join([word(), word(), word(), pick(digits, 1, 4)]), "name": lambda: word() + rng.choice(["_", "-", "."]) + word(), "word": lambda: rng.choice([word(), pick(small, 2, 9)]),
        "placeholder": lambda: rng.choice(["changeme", "your-token-here", "example123", "xxxxxxxxxxxxxxxx", "your_password", "test1234567890", "dummy-secret", "<your key>", "sample0123456789"]),
        "standin": lambda: rng.choice(["password", "secret", "null", "None", "pass", "true", "******", "undefined", "user", "pwd", "token"]),
        "variable": lambda: rng.choice(["${DB_PASS}", "$TOKEN", "os.environ['X']", "getenv()", "<password>", "{{ secret }}", "%PASS%", "process.env.KEY", "self.token", "read_key()"]),
    }[kind]()


def examples(spark: SparkSession) -> DataFrame:
    """(doc_id, text, source, label): EXAMPLES written out; the same rows every time."""
    rng = random.Random(SEED)
    rows = []
    for label, context, kind in EXAMPLES:
        for _ in range(COPIES):
            text = re.sub(r"\{v\}", lambda _, kind=kind: _value(rng, kind), context)
            around = [" ".join(rng.choice(DICTIONARY) for _ in range(rng.randint(0, 4))) for _ in range(2)]
            rows.append((len(rows), f"{around[0]} {text} {around[1]}".strip(), rng.choice(["src1", "web", "mail"]), float(label)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, label double")


def judge(found: DataFrame, labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """`featured` findings with probability (of a secret) and secret. labelled: FEATURES and label (0 or 1), a bounded table."""
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_v", handleInvalid="keep")
    classes = {r["label"] for r in labelled.select("label").distinct().collect()}
    if len(classes) < 2:
        return found.withColumn("probability", F.lit(float(min(classes)) if classes else 1.0)).withColumn("secret", F.col("probability") >= 0.5)
    forest = RandomForestClassifier(labelCol="label", featuresCol="_v", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_b", numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=False)
    model = forest.fit(vector.transform(labelled))
    out = model.transform(vector.transform(found)).withColumn("probability", vector_to_array("_b")[1])
    return out.drop("_v", "_p", "_r", "_b").withColumn("secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, path: Column, labelled: DataFrame | None = None) -> DataFrame:
    """Findings with the forest's verdict: doc_id, text_key, path, at, word, kind, candidate, FEATURES, probability, secret.

    labelled: FEATURES and label (0 or 1), a bounded table; without it `examples`.
    """
    words = word_list(docs)
    found = cut(featured(candidates(docs, path), words), "findings")  # few and small
    if labelled is None:
        texts = examples(docs.sparkSession)
        known = featured(candidates(texts, F.col("source")), words).select("doc_id", *FEATURES)
        labelled = cut(known.join(texts.select("doc_id", "label"), "doc_id").select(*FEATURES, "label"), "labelled-findings")
    return judge(found, labelled)


def redact(docs: DataFrame, path: Column, labelled: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in `text` replaced. Only texts that have candidates are shuffled."""
    has = has_candidates(F.col("text"))
    at, secrets = unused(docs, "key", "found")
    key = [F.xxhash64("text").alias("text_key"), F.coalesce(path, F.lit("")).alias("path")]
    found = scan(docs, path, labelled).where("secret").groupBy("text_key", "path")
    found = found.agg(F.array_sort(F.collect_set(F.struct((-F.length("candidate")).alias("n"), F.col("candidate").alias("c"), F.col("kind").alias("k")))).alias(secrets))
    some = docs.where(has).withColumn(at, F.struct(*key)).join(found.withColumn(at, F.struct("text_key", "path")).select(at, secrets), at, "left")
    none = F.expr("cast(array() as array<struct<n:int,c:string,k:string>>)")
    text = F.aggregate(F.coalesce(secrets, none), F.col("text"), lambda t, x: _masked(t, x["c"], x["k"], mask))
    return some.withColumn("text", text).select(docs.columns).unionByName(docs.where(~has))


def _masked(text: Column, candidate: Column, kind: Column, mask: str) -> Column:
    """text without the candidate: assigned values and passwords of URLs after : or = only, as short ones may be words of the text too; pieces of keys as a whole."""
    exact = F.concat(F.lit("\\Q"), F.replace(candidate, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    after = F.concat(F.lit(r"(?i)(?<=[:=>][\s\"'`]{0,10}|(?:bearer|basic|token)\s{1,4}[\"'`]{0,1})(?-i)"), exact)
    alone = F.concat(F.lit(r"(?<![A-Za-z0-9+/=])"), exact, F.lit("(?![A-Za-z0-9+/=])"))
    safe = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))
    short = F.length(candidate) < 16
    return (
        F.when(short & kind.isin("assigned", "url"), F.regexp_replace(text, after, safe))
        .when(short & (kind == "pem"), F.regexp_replace(F.regexp_replace(text, F.concat(F.lit(r"(?<=\\[nr])"), exact, F.lit("(?![A-Za-z0-9+/=])")), safe), alone, safe))
        .otherwise(F.replace(text, candidate, F.lit(mask)))
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs, F.col("source")).select("doc_id", "at", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "probability", "secret")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs.select("doc_id", "text", "lang", "source", "n_chars"), F.col("source"))
