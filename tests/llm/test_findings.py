"""What the third review found: each test failed before."""

from pyspark.sql import functions as F

from tensorjobs.llm import mixing


def test_mixing_is_the_same_beyond_the_cells_of_the_driver(spark):
    """Probabilities don't depend on where the cells are raked, to the last bit."""
    rows = [(i, "one two three " * (1 + i % 7 + 3 * (i % 2)) if i % 11 else "", ("en", "fr")[i // 2 % 2], f"s{i % 2}" if i % 10 else None, 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = [{r["doc_id"]: r["probability"] for r in mixing.mix(docs, topic=F.concat(F.lit("t"), F.floor(F.col("doc_id") / 4) % 2), max_cells=n).collect()} for n in (200_000, 3)]
    assert len(got[0]) == 120 and len(set(got[0].values())) > 4 and got[0] == got[1]
