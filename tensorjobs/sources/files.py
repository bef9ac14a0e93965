"""Sources and sinks: tensor text files, chat JSONL, program libraries, manifests, golden records, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAT = "messages array<struct<role:string,content:string>>, instruction string, input string, output string, _corrupt string"
GOLDEN = "key string, type string, test_vectors array<struct<inputs:map<string,double>,expected:map<string,double>>>, hash string, date string"


#: Bytes of text whose tensors a task sorts by name.
PART = 16 << 20


def dtype_of(name: Column) -> Column:
    return F.when(name.isin("f64", "F64", "double"), "f64").when(name.isin("i32", "I32", "int"), "i32").otherwise("f32")


def read_named_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, dtype, shape, data) from lines '@name shape=2,3 dtype=f64 data=1,2,..'.

    Blank lines and those beginning with # or ; are skipped; too few values are filled with zeros, too many dropped;
    i32 truncates, f32 rounds to single precision; of a name given twice the later line (by file, then place) holds.
    Names are dealt over as many tasks as the size of the files asks for.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("s"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    get = lambda key: F.regexp_extract("s", rf"\b{key}=(\S*)", 1)
    rows = lines.where(F.col("s").rlike(r"^@\S+")).select(
        "file", "line", F.regexp_extract("s", r"^@(\S+)", 1).alias("name"), dtype_of(get("dtype")).alias("dtype"),
        F.transform(F.split(get("shape"), ","), lambda x: x.cast("int")).alias("shape"),
        F.transform(F.filter(F.split(get("data"), ","), lambda x: x != ""), lambda x: x.cast("double")).alias("values"),
    )
    size = F.aggregate("shape", F.lit(1), lambda a, x: a * x)
    padded = F.slice(F.concat("values", F.array_repeat(F.lit(0.0), F.greatest(size - F.size("values"), F.lit(0)))), F.lit(1), size)
    stored = F.transform(padded, lambda x: F.when(F.col("dtype") == "i32", x.cast("int").cast("double")).when(F.col("dtype") == "f32", x.cast("float").cast("double")).otherwise(x))
    size_ = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_ // PART))
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("file"), F.desc("line")))
    return rows.withColumn("data", stored).repartition(parts, "name").withColumn("_r", last).where("_r = 1").select("name", "dtype", "shape", "data")


def write_named_tensors(df: DataFrame, path: str) -> None:
    """f32 and i32 values are written as such, so reading them again gives the same."""
    number = lambda x: F.when(F.col("dtype") == "i32", x.cast("int").cast("string")).when(F.col("dtype") == "f32", x.cast("float").cast("string")).otherwise(x.cast("string"))
    line = F.concat(F.lit("@"), "name", F.lit(" shape="), F.array_join(F.transform("shape", lambda x: x.cast("string")), ","), F.lit(" dtype="), "dtype", F.lit(" data="), F.array_join(F.transform("data", number), ","))
    df.select(line.alias("value")).write.text(path)


def read_chat_jsonl(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """Chats with file and pos, from files called like `names`; lines that don't parse are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")).where(F.col("value").rlike(r"\S"))
    parsed = lines.withColumn("r", F.from_json("value", CHAT, {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("r IS NOT NULL AND r._corrupt IS NULL").select("r.messages", "r.instruction", "r.input", "r.output", "file", "pos")


def read_library(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(key, type, place, text) of every file below path; kind: only '-KIND-' in the name or KIND as the folder."""
    from ..operators.audit import key_place, key_type

    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    key = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = files.withColumn("key", key)
    if kind:
        rows = rows.where(F.contains("key", F.lit(f"-{kind}-")) | F.col("file").rlike(rf"/{kind}/[^/]*$"))
    return rows.select("key", key_type(F.col("key")).alias("type"), key_place(F.col("key")).alias("place"), "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key) from {"jurisdictions": [..]}, {"keys": [..]} or a bare list; only strings count."""
    text = spark.read.option("wholetext", True).text(path)
    keys = F.coalesce(*[F.from_json(x, "array<string>") for x in (F.get_json_object("value", "$.jurisdictions"), F.get_json_object("value", "$.keys"), F.col("value"))])
    quoted = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return text.select(F.explode(F.array_intersect(keys, quoted)).alias("key")).distinct()


def write_splits(df: DataFrame, path: str) -> None:
    """JSON per split in path/split=NAME; columns that begin with _ stay behind."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").partitionBy("split").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(key, type, vector, output, value): expected values, one a row; files part-* hold an object a line, others one object each."""
    lines = F.col("_metadata.file_name").startswith("part-")
    read = lambda multi: spark.read.schema(GOLDEN).option("multiLine", multi).option("recursiveFileLookup", True).json(path)
    rows = read(False).where(lines).unionByName(read(True).where(~lines))
    vectors = rows.select("key", "type", F.posexplode("test_vectors").alias("vector", "t"))
    return vectors.select("key", "type", "vector", F.explode("t.expected").alias("output", "value"))


def write_golden(golden: DataFrame, path: str) -> None:
    """Rows as read_golden gives them (or nested ones, with test_vectors), an object a line; the reader reads them again."""
    if "test_vectors" not in golden.columns:
        one = golden.groupBy("key", "type", "vector").agg(F.map_from_entries(F.collect_list(F.struct("output", "value"))).alias("expected"))
        vectors = F.array_sort(F.collect_list(F.struct("vector", "expected")), lambda a, b: a["vector"] - b["vector"])
        golden = one.groupBy("key", "type").agg(F.transform(vectors, lambda v: F.struct(v["expected"].alias("expected"))).alias("test_vectors"))
    golden.write.mode("overwrite").json(path)


def corpus_lines(chat: DataFrame, programs: DataFrame) -> DataFrame:
    """(source, line): lines of messages, outputs, instructions and programs."""
    split = lambda c: F.explode(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"))
    messages = chat.select(F.explode("messages").alias("m")).select(F.lit("chat").alias("source"), split(F.col("m.content")).alias("line"))
    pairs = chat.where("messages IS NULL").select(F.lit("alpaca").alias("source"), F.explode(F.array("output", "instruction")).alias("t")).select("source", split(F.col("t")).alias("line"))
    return messages.unionByName(pairs).unionByName(programs.select(F.lit("program").alias("source"), split(F.col("text")).alias("line")))


def union_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with source, counts per source with missing): the sources together; empty ones are marked missing. Needs a source at least."""
    if not sources:
        raise ValueError("no sources")
    rows = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    names = rows.sparkSession.createDataFrame([(n,) for n in sources], "source string")
    counts = names.join(rows.groupBy("source").agg(F.count("*").alias("n")), "source", "left")
    return rows, counts.select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))
