"""The manifest's trees and proofs against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorjobs.llm import merkle
from tensorjobs.llm.common import crc_mod

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, row int, part int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 16 * 16
        out.append((level[lo:i], level[i + 1 : lo + 16]))
        i //= 16
    return out


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(((r[0] is not None, r[0] or 0), leaf(*r[:5]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: grown([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in names}
    high = grown([low[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, r) in enumerate(sorted(trees[s], key=lambda x: x[:2])):
            path = sides(low[s], i) + sides(high, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(*r[:4], text)
            for a, b in path:
                now = h(*a, now, *b)
            proof = h(*[x for a, b in path for x in a + b])
            out.append((r[0], own, low[s][-1][0], high[-1][0], proof, now, now == high[-1][0]))
    return sorted(out, key=repr)


def proofs(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.proofs(df, crc_mod(F.col("doc_id"), 5) == 0).collect()), key=repr)


def some(n, seed=0, source=lambda i: f"s{i % 19}"):
    rng = random.Random(seed)
    return [(i, source(i), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([f"Text {i} É", f"plain {i}", "", None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 17])
def test_small(spark, n):
    rows = some(n)
    assert proofs(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    """Null ids and sources, an empty source beside the null one, repeated rows, a very long text, many sources."""
    rows = some(300) + [(None, None, None, None, None)] * 3 + [(5, "", "en", 1, "A")] * 40 + [(None, "", "en", 2, "B"), (None, "é", "en", 2, "b"), (7, "z", "x", 3, "Long Words " * 300_000), (7, "z", "x", 3, "other")]
    assert proofs(spark, rows) == brute(rows)


def test_sources_over_several_leaf_partitions(spark):
    """A hot source of three leaf partitions, one that just fills one and one that has a leaf more."""
    full = merkle.FAN**merkle.DEPTH
    rows = some(2 * full + 100, source=lambda i: "hot") + some(full, 1, lambda i: "full") + some(full + 1, 2, lambda i: "more") + some(20, 3)
    got, want = proofs(spark, rows), brute(rows)
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 5


def test_octopus():
    """The coordinates are those that any leaf needs, less what other leaves let derive; without them the root can't be had."""
    rng = np.random.default_rng(0)
    for total in (1, 2, 16, 17, 300, 5000):
        size = merkle.sizes(total)
        for _ in range(20):
            at = np.unique(rng.integers(0, total, rng.integers(1, 30)))
            derived, need = [set(at.tolist())], [set() for _ in size]
            for _ in size[1:]:
                derived.append({x // 16 for x in derived[-1]})
            for i in at.tolist():
                for k, n in enumerate(size[:-1]):
                    need[k] |= {x for x in range(i // 16 * 16, min(i // 16 * 16 + 16, n)) if x != i} - derived[k]
                    i //= 16
            assert [set(x.tolist()) for x in merkle.missing(at, size)] == need


def test_empty(spark):
    out = merkle.proofs(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0
