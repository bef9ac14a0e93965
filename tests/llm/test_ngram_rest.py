"""Links between components of a split block: as few as bring them together."""

from pyspark.sql import functions as F

from tensorjobs.llm import ngram_join


def shingles(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_touching_families_give_one_link(spark, monkeypatch):
    """A chain of families of near copies, each family near the next one: without the bound every pair of members would be a link."""
    base = [f"t{i}" for i in range(204)]
    rows = []
    for family in range(40):
        for copy in range(3):
            w = list(base)
            for i in range(family * 2):
                w[(i * 5) % 200] = f"f{i}"
            w[203] = f"c{family}x{copy}"
            rows.append((family * 100 + copy, " ".join(w)))
    seen = []
    real = ngram_join._rest

    def kept(joined, roots, *rest):
        out = real(joined, roots, *rest)
        seen.append((out.withColumn("task", F.spark_partition_id()).collect(), {r["node"]: r["root"] for r in roots.collect()}))
        return out

    monkeypatch.setattr(ngram_join, "_rest", kept)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), chunk=300).collect()}
    sets = {i: shingles(t) for i, t in rows}
    component = {i: i for i in sets}
    near = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near += 1
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = {i: new if c == old else c for i, c in component.items()}
    assert got == component and near > 300
    assert any(links for links, _ in seen)
    for links, roots in seen:
        by_task = {}
        for r in links:
            a, b = roots.get(r["a"], r["a"]), roots.get(r["b"], r["b"])
            assert a != b
            pairs = by_task.setdefault(r["task"], [])
            assert {a, b} not in pairs
            pairs.append({a, b})
        assert all(len(p) < len(set().union(*p)) for p in by_task.values())
