"""Collocations against plain counting, with awkward rows and every way a chunk can be cut."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tensorjobs.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, key long, n long"


def brute(rows, longest=3, least=10, top=2000):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        total = sum(c for v, c in count.items() if len(v) == 1)
        inside = defaultdict(int)
        for v, a in count.items():
            if a >= least and len(v) > 2:
                for m in range(2, len(v)):
                    for i in range(len(v) - m + 1):
                        inside[v[i : i + m]] = max(inside[v[i : i + m]], a)
        found = []
        for v, a in count.items():
            if a < least or len(v) < 2 or 100 * inside[v] >= 50 * a and v in inside and inside[v]:
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[v[:k]] * count[v[k:]]), k, count[v[:k]], count[v[k:]]) for k in range(1, len(v)))
            found.append((-score, -a, " ".join(v).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def sample(n=400, seed=0):
    rng = random.Random(seed)
    vocab = ["the", "Of", "new", "york", "City", "été", "x" * 300, "a-b", "“q”", *[f"w{i}" for i in range(60)]]
    passage = "New York city of the WORLD, old york. new york"
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", " ; "]) for w in words) + (passage if i % 7 == 0 else "")
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    copy = "one two three four five six seven eight nine ten eleven " * 3
    return rows + [(900 + i, copy, "en") for i in range(30)] + [(None, None, None), (5, "", "en"), (6, " \t\n", "xx"), (7, "Long line " * 40_000, "de"), (8, ".,;", None)]


@pytest.mark.parametrize(("modulus", "limit"), [(32, 256), (1, 256), (2, 3), (10**9, 5)])
def test_against_counting(spark, modulus, limit):
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS)
    assert sorted(tuple(r) for r in collocations.mine(docs, modulus=modulus, limit=limit).collect()) == brute(rows)


def test_longer_phrases_and_short_lists(spark):
    rows = sample(200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(docs, longest=4, least=5, top=7).collect()) == brute(rows, 4, 5, 7)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """Where all bits are set, everything is counted as text."""
    monkeypatch.setattr(collocations, "bitmap", lambda keys, at, bits: np.full(1 << (bits - 3), 255, np.uint8))
    rows = sample(100, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == brute(rows)


def test_parse_is_a_dictionary(spark):
    """Chunks own every word once; a passage in two texts is cut alike inside."""
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(2000))
    rows = [(i, f"{'start ' * i} {passage} end{i}", "en") for i in range(8)]
    chunks = collocations.parse(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(c["own"] * c["weight"] for c in chunks) == sum(len(r[1].split()) for r in rows)
    assert sum(c["own"] for c in chunks) < 3000  # of 16,000 words and more: only first and last chunks differ


def test_huge_counts(spark):
    """Products beyond 64 bits are exact."""
    big = 9 * 10**15
    found = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big - 1)], "lang string, phrase string, size int, f long")
    out = collocations.score(found, spark.createDataFrame([("en", 5)], "lang string, n long")).collect()
    assert [(r["a"], r["score"]) for r in out] == [(big - 1, 1_000_000 * (big - 1) ** 2 // (big * (big - 1)))]


def test_empty(spark):
    out = collocations.mine(spark.createDataFrame([], DOCS))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
