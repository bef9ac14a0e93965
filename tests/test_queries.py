"""Each query with SQL against DuckDB on the smallest tables; the others give rows."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from tensorjobs.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((plain(r) for r in df.select(columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    rel = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert rows == sorted((plain(r) for r in rel.fetchall()), key=repr)


def test_compact_keeps_all_rows(spark, tmp_path):
    """Carriage returns end lines; null texts are empty."""
    rows = [(1, "A 1 ; x\r\nB  2\rC\n"), (2, None), (3, "D"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["compact"] for r in QUERIES["compact_documents"](spark, str(tmp_path)).collect()}
    assert got == {1: "A 1¶B 2¶C", 2: "", 3: "D", 4: ""}


def test_attention_windows_do_not_meet(spark, tmp_path):
    """Label 0 from id 100,000 on is not in the windows of label 1 from id 0 on."""
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (100_001, 0, [5.0, 5.0]), (100_002, 0, [5.0, 5.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["pos"]: r["out"] for r in QUERIES["attention_per_label"](spark, str(tmp_path)).collect()}
    assert got[100_001] == got[100_002] == [5.0, 5.0]
    near = math.exp(1 / math.sqrt(2))
    assert got[1] == pytest.approx([near / (near + 1), 1 / (near + 1)], abs=1e-5)
