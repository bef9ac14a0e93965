"""The forest gives every verdict; its features against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorjobs.llm import secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def some(spark):
    """The labelled examples drawn anew, as documents."""
    rows = secret_scan.examples(spark).collect()
    return rows, spark.createDataFrame([(r["doc_id"], r["text"], "en", r["source"], 1) for r in rows if r["doc_id"] % 16 < 3], DOCS)


def test_verdicts_follow_the_labels(spark, some):
    """With the opposite labels the verdicts turn round: no rule decides beside the forest. A constant would fail both ways."""
    rows, docs = some
    words = secret_scan.word_list(docs)
    known = secret_scan.featured(secret_scan.candidates(secret_scan.examples(spark), F.col("source")), words)
    labels = secret_scan.examples(spark).select("doc_id", (1 - F.col("label")).alias("label"))
    turned = known.select("doc_id", *secret_scan.FEATURES).join(labels, "doc_id").drop("doc_id")
    label = {r["doc_id"]: r["label"] for r in rows}
    right, wrong = (secret_scan.scan(docs, F.col("source"), of).collect() for of in (None, turned))
    assert sum((r["secret"]) == (label[r["doc_id"]] == 1) for r in right) > 0.97 * len(right)
    assert sum((r["secret"]) != (label[r["doc_id"]] == 1) for r in wrong) > 0.97 * len(wrong)
    assert len({round(r["probability"], 3) for r in right}) > 20 and all(r["secret"] == (r["probability"] >= 0.5) for r in right)


def test_unseen_values(spark):
    """Values and neighbours that the examples don't have."""
    texts = {
        1: 'const token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b";', 2: "export GITHUB_TOKEN=ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8", 3: "jdbc://svc:Tr0ub4dor@10.0.0.3/db",
        11: "git revision 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b was reverted", 12: "paid with 4111111111111111 yesterday", 13: "token: see the manual", 14: "http://user:password@localhost/",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    got = {i: False for i in texts}
    for r in secret_scan.scan(docs, F.col("source")).collect():
        got[r["doc_id"]] |= r["secret"]
    assert got == {i: i < 10 for i in texts}


def test_features_in_python(some):
    _, docs = some
    found = secret_scan.featured(secret_scan.candidates(docs, F.col("source")), ["the", "order"]).collect()
    assert len(found) > 150
    for r in found:
        c, n = r["candidate"], len(r["candidate"])
        p = [k / n for k in Counter(c).values()]
        assert r["length"] == pytest.approx(math.log2(n)) and r["entropy"] == pytest.approx(-sum(x * math.log2(x) for x in p))
        assert r["distinct_share"] == pytest.approx(len(p) / n) and r["digit_share"] == pytest.approx(sum(x in "0123456789" for x in c) / n)
        changes = sum(a.isdigit() and b.isalpha() or a.isalpha() and b.isdigit() for a, b in zip(c, c[1:], strict=False))
        cases = sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(c, c[1:], strict=False))
        assert r["kind_changes"] == pytest.approx(changes / n) and r["case_changes"] == pytest.approx(cases / n)
        assert r["hex"] == bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)) and r["special_share"] == pytest.approx(len(re.findall(r"[^A-Za-z0-9\s]", c)) / n)
        listed = sum(len(x) for x in re.findall("[a-z]{3,}", c.lower()) if x in ("the", "order"))
        inside = n - len(re.sub("|".join(sorted(secret_scan.DICTIONARY, key=len, reverse=True)), "", c.lower()))
        assert r["dictionary_share"] == pytest.approx(max(listed, inside) / n)
