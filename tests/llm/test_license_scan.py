"""License phrases and templates against plain loops."""

import random
import re

import pytest

from tensorjobs.llm import license_scan

DOCS = "doc_id long, text string, key string, at long, salt long, label string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, templates=license_scan.TEMPLATES, contained=license_scan.CONTAINED, block=license_scan.BLOCK):
    sets = [(label, set(words(t))) for label, t in templates]
    out = []
    for doc_id, text in rows:
        w = words(text)
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        more, share = set(), 0.0
        for lo in range(0, len(w), block // 2):
            own = set(w[lo : lo + block])
            for label, s in sets:
                need = len(s) if len(s) < license_scan.SHORT else -(-contained * len(s) // 100)
                if len(own & s) >= need:
                    more.add(label)
                    share = max(share, len(own & s) / len(s))
        base = {x for _, x in places}
        at = [i for i, _ in places]
        line = lambda x: ",".join(sorted(x))
        out.append((doc_id, len(w), len(places), min(at, default=None), max(at, default=None), line(base), line(base | more), 1.0 if places else share))
    return sorted(out, key=repr)


def sample(n=150, seed=0):
    """Random words with whole, changed, cut and scattered templates, over lines and punctuation, and phrases."""
    rng = random.Random(seed)
    vocab = ["the", "of", "license", "Licensed", "under", "version", "été", "K", "software", *[f"w{i}" for i in range(80)]]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 2:
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            if i % 4 == 1:
                t[rng.randrange(len(t))] = "changed"
            if i % 6 == 1:
                t = [x for y in t for x in (y, *[rng.choice(vocab) for _ in range(rng.randint(0, 3))])]
            at = rng.randint(0, len(w))
            w[at:at] = t
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(["CC-BY", "cc by nc by cc", "GNU General\nPublic, LICENSE", "All rights reserved.", "all rights", "ccc by", "éall rights reserved", "all rights reservedx"]).split(" ")
        rows.append((i, "".join(x + rng.choice([" ", "\n", ", ", "-", "\t"]) for x in w)))
    return rows + [(None, None), (1000, ""), (1001, "cc by"), (1002, " \n"), (3, rows[3][1]), (None, rows[3][1]), (1003, "by cc " * 60_000 + license_scan.TEMPLATES[0][1])]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [64, 16])
def test_against_loops(spark, block):
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "x") for r in rows], DOCS)
    want = brute(rows, block=block)
    assert got(license_scan.scan(docs, block=block)) == want
    assert sum(r[6] != r[5] for r in want) > 15


@pytest.mark.parametrize("contained", [50, 85, 100])
def test_any_threshold(spark, contained):
    """The filters lose no block, whatever is required: random templates over few words."""
    rng = random.Random(contained)
    templates = tuple((f"t{i}", " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30)))) for i in range(60))
    rows = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(60))}" for _ in range(rng.randint(0, 120)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(license_scan.scan(docs, templates, contained, 24)) == brute(rows, templates, contained, 24)


def test_notices(spark):
    texts = {
        "mit": "code\nReleased under the MIT License.\nmore",
        "apache-2.0": "# Licensed under the\n# Apache License, Version 2.0 (the x)",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "": "released under the license of the apache people",
    }
    rows = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    assert [r["labels"] for r in license_scan.scan(rows).orderBy("doc_id").collect()] == list(texts)


def test_no_python_and_no_templates(spark):
    docs = spark.createDataFrame(sample(20), "doc_id long, text string")
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got(license_scan.scan(docs, ())) == brute(sample(20), ())


def test_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0
