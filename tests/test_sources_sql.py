"""The tensor format and the table function."""

import pytest
from pyspark.sql import functions as F

from tensorjobs.functions import table_functions
from tensorjobs.operators import audit
from tensorjobs.sources import files, tensor_source

ROWS = [("a", "f64", [2, 2], [1.5, -2.0, 1e-300, 0.1]), ("b", "i32", [3], [1.0, 2.0, -3.0]), ("c", "f32", [1], [0.5]), ("d", "f64", [0], [])]


def rows(df):
    return sorted((r["name"], r["dtype"], list(r["shape"]), list(r["data"])) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_format_reads_what_files_reads(spark, tmp_path, split):
    """Any split, blank and broken lines, comments, short and long data, names given twice, a file without a last line end."""
    (tmp_path / "x").mkdir()
    (tmp_path / "x/1.nml.data").write_text("# no\n\n@a shape=2 data=1,2\n; @z shape=1 data=1\n  @b shape=2,2 dtype=i32 data=1.9,2,3,4,5\n@é shape=1 dtype=double data=0.1\nnothing\n@short shape=3 data=7")
    (tmp_path / "x/2.nml.data").write_text("@a shape=1 dtype=f64 data=9\n@a shape=1 dtype=f64 data=10\n")
    (tmp_path / "x/_SUCCESS").write_text("@no shape=1 data=1")
    tensor_source.register(spark)
    read = spark.read.format("named_tensors").option("split", split).load(str(tmp_path / "x"))
    assert read.count() == 6
    assert rows(tensor_source.load_named_tensors(spark, str(tmp_path / "x"))) == rows(files.read_named_tensors(spark, str(tmp_path / "x")))
    broken = [b"@x shape=a data=1", b"@x shape=2 data=1,b", b"x", b"", b"@"]
    assert [tensor_source.parse(x) for x in broken] == [None] * 5


def test_filters_reach_the_source(spark, tmp_path):
    (tmp_path / "1.data").write_text("".join(f"@t{i} shape=1 data={i}\n" for i in range(100)))
    tensor_source.register(spark)
    read = spark.read.format("named_tensors").load(str(tmp_path))
    for cond, want in ((F.col("name") == "t7", {"t7"}), (F.col("name").isin("t1", "t2", "none"), {"t1", "t2"}), ((F.col("name") == "t3") & (F.col("name") == "t4"), set()), (F.col("name") > "t98", {"t99"})):
        some = read.where(cond)
        assert {r["name"] for r in some.collect()} == want
    plan = read.where("name = 't7'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan named_tensors" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # all of it went into the scan


def test_round_trip_and_overwrite(spark, tmp_path):
    tensor_source.register(spark)
    df = spark.createDataFrame(ROWS, "name string, dtype string, shape array<int>, data array<double>").repartition(3)
    path = str(tmp_path / "out")
    df.write.format("named_tensors").mode("append").save(path)
    assert rows(tensor_source.load_named_tensors(spark, path)) == sorted(ROWS) == rows(files.read_named_tensors(spark, path))
    df.where("name = 'a'").write.format("named_tensors").mode("overwrite").save(path)
    assert rows(tensor_source.load_named_tensors(spark, path)) == ROWS[:1]
    with pytest.raises(Exception, match="no way"):
        bad = df.withColumn("dtype", F.when(F.col("name") == "c", F.raise_error(F.lit("no way"))).otherwise("f64"))
        bad.write.format("named_tensors").mode("append").save(path)
    assert rows(tensor_source.load_named_tensors(spark, path)) == ROWS[:1] == rows(files.read_named_tensors(spark, path))
    writer = tensor_source.TensorWriter(path, overwrite=False)
    message = writer.write(iter(df.where("name = 'b'").collect()))
    assert rows(tensor_source.load_named_tensors(spark, path)) == ROWS[:1]  # nothing is seen before the commit
    writer.abort([message])
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(f".{writer.run}")]


PROGRAMS = [
    ("gates", "⋈ φ κ #0 #1.5\n↘ #3\n∎ γ #14600\n→ #2\n⋈ φ κ #0 #2.5\n↘ #2\n∎ γ #29200\n→ #1\n∎ γ #21900\n⋈ φ κ #0 #1.5\n↘ #8\n∗ α π #0.1\n∎ α #1100\n∎ γ #11000\n− δ π γ\n∗ δ δ #0.12\n∎ α #5000\n∎ γ #44000\n"
     "⋈ φ κ #0 #2.5\n↘ #5\n∗ α π #0.10\n∎ α #2200\n∎ γ #22000\n∗ δ δ #0.11\n→ #3\n∗ α π #0.1\n∎ α #1700\n∎ γ #17000\n∗ δ δ #0.13\n↑ α @tax\n∗ α π #0.9\n◼"),
    ("flat", "↓ ι @x\n∗ γ ι #0.045\n↑ γ @tax"), ("two flats", "∗ γ ι #0.1\n∗ γ ι #0.2"), ("flat beside bracket", "∗ γ ι #0.1\n∗ α π #0.2"), ("unsorted", "∎ α #5\n∎ γ #300\n∗ δ δ #0.3\n∎ α #1\n∎ γ #100\n∎ α #1\n∎ γ #100\n∗ δ δ #[3]"),
    ("statuses", "⋈ φ κ #0 #9\n↘ #6\n∗ α π #0.1\n∎ α #1\n\n  ∎   γ\t#2 \n⋈ φ κ #0 #4.5\n↘ #100\n∗ α π #0.3"), ("short only", "⋈ φ κ #0 #1.5\n↘ #1\n∎ γ #5\n∎ γ #-1\n→\n∎ γ #0\n∎ γ #7\n∎ γ #8"),
    ("broken", "⋈ φ κ #0 #x\n↘ #9\n⋈ φ κ\n↘\n∎ α\n∎ γ #1\n∗ α π #"), ("empty", " \n\n"), ("none", None),
]


def test_table_function_equals_the_dataframe_form(spark):
    df = spark.createDataFrame([(k, t, "extra") for k, t in PROGRAMS], "key string, text string, other string")
    df.createOrReplaceTempView("programs")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM extract_rate_structure(TABLE(programs) PARTITION BY key)")
    want = audit.extract_rate_structure(df)
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
    assert got.count() > 20
    assert spark.sql("SELECT count(*) FROM extract_rate_structure(TABLE(SELECT key, text FROM programs WHERE key = 'flat'))").first()[0] == 1
