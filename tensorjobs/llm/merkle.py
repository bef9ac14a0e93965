"""Merkle manifest of a table: every row a leaf, a tree a source, a tree over the sources, and a proof for each leaf.

1. `numbered` gives each leaf its place in its source: rows are dealt by range and counted per part, so that a source of any
   size is spread over many tasks.
2. `blocks` puts FAN ** DEPTH consecutive leaves of a source into a leaf partition (one row of arrays) and hashes its subtree.
3. `grow` hashes the nodes above, a level at a time, FAN children a group.
4. `proofs` makes an octopus multiproof per leaf partition: `missing` gives the minimal union of node coordinates that all its
   leaves need and that it can't derive itself; one join fetches them all at once; interiors that leaves share are derived once
   and every single proof is expanded in the partition.

A hash H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text; tables hold the 32 bytes.

Defined results: a null field counts as `-`, also a null source, whose tree comes first; null ids come before others;
rows with one source and id follow by leaf, rows that are equal in all fields stand side by side and have proofs of their own; a source with
one row is its own subroot and a single source its own root; empty and very long texts are hashed whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, ragged, runs, table

FAN = 16
SHIFT = 4
#: Levels of the subtree of a leaf partition: FAN ** DEPTH leaves, about 200 KB.
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over the sources; a source's tree is called `n` (null) or `s` and the source.
TOP = "t"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*values: Column) -> Column:
    """The digest (binary) of fields: `-` for null, else the UTF-8 byte count, a colon and the value."""
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256))


def node_of(digests: Column) -> Column:
    """The digest of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), ""), 256))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, changed): changed is the leaf with the text's A-Z lower-cased where the condition holds, else null."""
    c = [F.col(x) for x in FIELDS]
    other = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf_of(*c[:-1], F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*c).alias("leaf"), other.alias("changed"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at (the place in its tree by `order`, from 0) and total (rows of the tree).

    Rows are dealt by range, so no task holds a tree; equal ones are told apart by their place in the input. The
    table of counts has a row for each part and tree in it.
    """
    keys, names = ["tree", *order, "row"], rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", part int, k long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = pc.run_end_encode(batch.column("tree"))
            k, lo = np.empty(batch.num_rows, np.int64), 0
            for tree, hi in zip(trees.values.to_pylist(), trees.run_ends.to_pylist(), strict=True):
                n, now = n if tree == now else 0, tree
                k[lo:hi] = np.arange(n, n + hi - lo)
                n, lo = n + hi - lo, hi
            columns = [batch.column(c) for c in names] + [pa.array(np.full(len(k), part, np.int32)), pa.array(k)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "part", "k"])

    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(dealt.drop("row").mapInArrow(count, schema), "placed")
    spans = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    spans = spans.selectExpr("tree", "part", "sum(n) OVER (PARTITION BY tree ORDER BY part) - n AS first", "sum(n) OVER (PARTITION BY tree) AS total")
    return placed.join(spans, ["tree", "part"]).withColumn("at", F.col("first") + F.col("k")).drop("part", "k", "first")


def sizes(total: int) -> list[int]:
    """Nodes on each level of a tree of so many leaves."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(at: np.ndarray, size: list[int]) -> list[np.ndarray]:
    """The octopus: per level, the fewest nodes that have to be known besides the leaves `at` (sorted) to derive the root."""
    out, known = [], at
    for n in size:
        runs_ = np.unique(known >> SHIFT)
        if n == 1:
            out.append(runs_[:0])
            break
        every = ragged(runs_ << SHIFT, np.minimum(FAN, n - (runs_ << SHIFT)))
        out.append(np.setdiff1d(every, known, assume_unique=True))
        known = runs_
    return out


def subtree(hexes: bytes, total: int) -> list[bytes]:
    """The levels of a leaf partition, each the hex digests of its nodes in one string; its root is the last."""
    out = [hexes]
    while len(out) <= DEPTH and (len(out[-1]) > 64 or total > FAN**DEPTH):
        last = out[-1]
        out.append("".join(sha256(last[i : i + 64 * FAN]).hexdigest() for i in range(0, len(last), 64 * FAN)).encode())
    return out


BLOCKS = "tree string, block long, total long, ids array<long>, leaves binary, changed array<binary>, top binary"


def blocks(placed: DataFrame) -> DataFrame:
    """A row per leaf partition: tree, block, total, ids, leaves (digests in one binary), changed, top (digest of its root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), parts in runs(batches, ["tree", "block"]):
            t = pa.Table.from_batches(parts)
            total, digests = t["total"][0].as_py(), b"".join(t["leaf"].to_pylist())
            top = binascii.unhexlify(subtree(binascii.hexlify(digests), total)[-1])
            row = {"tree": tree, "block": int(block), "total": total, "ids": t["doc_id"].to_pylist(), "leaves": digests, "changed": t["changed"].to_pylist(), "top": top}
            yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("changed", pa.list_(pa.binary())), ("top", pa.binary())])
    of = placed.withColumn("block", F.shiftright("at", SHIFT * DEPTH))
    return of.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(run, BLOCKS)


def grow(nodes: DataFrame) -> DataFrame:
    """nodes (tree, level, at, size, digest; size: nodes of the tree on that level) and all above them."""
    every = now = cut(nodes, "nodes")
    while (now.agg(F.max("size")).first()[0] or 0) > 1:
        up = now.where("size > 1").groupBy("tree", (F.col("level") + 1).alias("level"), F.shiftright("at", SHIFT).alias("at"), F.ceil(F.col("size") / FAN).cast("long").alias("size"))
        children = F.array_sort(F.collect_list(F.struct("at", "digest")))  # FAN at most
        now = cut(up.agg(node_of(F.transform(children, lambda x: x["digest"])).alias("digest")), "nodes")
        every = every.unionByName(now)
    return every


def proofs(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per row: source's tree, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = leaves(docs, changed)
    parted = cut(blocks(numbered(rows, ["doc_id", "leaf"])), "leaf-partitions")
    large = parted.where(F.col("total") > FAN**DEPTH)
    nodes = grow(large.select("tree", F.lit(DEPTH).alias("level"), F.col("block").alias("at"), F.ceil(F.col("total") / FAN**DEPTH).cast("long").alias("size"), F.col("top").alias("digest")))
    subroots = nodes.where("size = 1").select("tree", "digest").unionByName(parted.where(F.col("total") <= FAN**DEPTH).select("tree", F.col("top").alias("digest")))
    sources = numbered(subroots.withColumnRenamed("tree", "name").withColumn("tree", F.lit(TOP)), ["name"])
    sources = cut(sources.select("name", "digest", "at", "total"), "sources")
    top = grow(sources.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "at", F.col("total").alias("size"), "digest"))
    root = next(iter(top.where("size = 1").select("digest").take(1)), [b""])[0]
    heads = parted.select("tree", "block", "total").join(sources.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("at").alias("place"), F.col("total").alias("trees")), "tree")
    found = nodes.select("tree", "level", "at", "digest").unionByName(top.select("tree", "level", "at", "digest"))
    fetched = heads.mapInArrow(_wanted, "tree string, block long, of string, level int, at long")
    fetched = fetched.join(found.withColumnRenamed("tree", "of"), ["of", "level", "at"]).groupBy("tree", "block")
    fetched = fetched.agg(F.collect_list(F.struct((F.col("of") == TOP).alias("above"), "level", "at", "digest")).alias("fetched"))  # FAN - 1 a level
    each = parted.drop("total", "top").join(heads.join(fetched, ["tree", "block"], "left"), ["tree", "block"])
    return each.mapInArrow(lambda batches: _expanded(batches, root.hex()), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, of, level, at): the coordinates that each leaf partition is missing, in its own tree and the one above."""
    for batch in batches:
        out: list[dict] = []
        for r in batch.select(["tree", "block", "total", "place", "trees"]).to_pylist():
            first = r["block"] << SHIFT * DEPTH
            own = missing(np.arange(first, min(r["total"], first + FAN**DEPTH)), sizes(r["total"]))
            above = missing(np.array([r["place"]]), sizes(r["trees"]))
            for of, levels in ((r["tree"], own), (TOP, above)):
                out += [{"tree": r["tree"], "block": r["block"], "of": of, "level": k, "at": int(x)} for k, need in enumerate(levels) for x in need]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("of", pa.string()), ("level", pa.int32()), ("at", pa.int64())]))


def _sides(at: int, size: list[int], lowest: int, known: dict[tuple[int, int], str]) -> list[tuple[str, str]]:
    """Per level from `lowest` on: the hex digests left and right of the path from node `at`."""
    out = []
    for level in range(lowest, len(size) - 1):
        first = at >> SHIFT << SHIFT
        last = min(first + FAN, size[level])
        out.append(("".join(known[level, x] for x in range(first, at)), "".join(known[level, x] for x in range(at + 1, last))))
        at >>= SHIFT
    return out


def _fold(digest: str, sides: list[tuple[str, str]]) -> str:
    for left, right in sides:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _expanded(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The proofs of the leaves of each leaf partition, from its own leaves and what it fetched."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in ("block", "total", "place", "trees", "ids", "leaves", "changed", "subroot", "fetched")}
            known: tuple[dict, dict] = ({}, {})
            for x in r["fetched"] or ():
                known[x["above"]][x["level"], x["at"]] = x["digest"].hex()
            levels = [x.decode() for x in subtree(binascii.hexlify(r["leaves"]), r["total"])]
            above = _sides(r["block"], sizes(r["total"]), DEPTH, known[0]) + _sides(r["place"], sizes(r["trees"]), 0, known[1])
            whole = _fold(levels[-1], above)
            rest = ["".join(a + b for a, b in above)]  # of the proof, per node of a level
            for level in levels[-2:0:-1]:
                rest = [level[j >> SHIFT << SHIFT + 6 : j << 6] + level[j + 1 << 6 : (j >> SHIFT) + 1 << SHIFT + 6] + rest[j >> SHIFT] for j in range(len(level) >> 6)]
            out = []
            for j, (doc_id, other) in enumerate(zip(r["ids"], r["changed"], strict=True)):
                here = levels[0]
                first, last = j >> SHIFT << SHIFT + 6, (j >> SHIFT) + 1 << SHIFT + 6
                leaf = here[j << 6 : j + 1 << 6]
                proof = here[first : j << 6] + here[j + 1 << 6 : last] + rest[j >> SHIFT] if len(levels) > 1 else rest[0]
                folded = whole
                if other is not None:
                    own, k = [], j
                    for level in levels[:-1]:
                        own.append((level[k >> SHIFT << SHIFT + 6 : k << 6], level[k + 1 << 6 : (k >> SHIFT) + 1 << SHIFT + 6]))
                        k >>= SHIFT
                    folded = _fold(other.hex(), own + above)
                out.append((doc_id, leaf, r["subroot"].hex(), root, sha256(proof.encode()).hexdigest(), folded, folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    return proofs(docs, crc_mod(F.col("doc_id"), 5) == 0)


#: Trees grow a level a step; a document's fold takes its levels in their own order, those of its source before those above.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), repeat([0::BIGINT], 8)), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM documents),
f AS (SELECT *, unnest([text, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END]) AS t, unnest([0, 1]) AS v FROM d),
h AS (SELECT rid, doc_id, source, v, sha256(array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, t], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '')) AS leaf FROM f),
p AS (SELECT a.rid, a.doc_id, coalesce('s' || a.source, 'n') AS tree, a.leaf, b.leaf AS other, row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id NULLS FIRST, a.leaf) - 1 AS i, count(*) OVER (PARTITION BY a.source) AS n
  FROM h a JOIN h b ON a.rid = b.rid AND a.v = 0 AND b.v = 1),
low AS (SELECT tree, 0 AS l, i, n, leaf AS h FROM p
  UNION ALL SELECT tree, l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, l, i // 16, n),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS l, i, n, subroot AS h FROM s
  UNION ALL SELECT l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 16, n),
side AS (
  SELECT p.rid, 0 AS part, low.l, string_agg(low.h, '' ORDER BY low.i) FILTER (low.i < p.i >> (4 * low.l)) AS a, string_agg(low.h, '' ORDER BY low.i) FILTER (low.i > p.i >> (4 * low.l)) AS b
  FROM p JOIN low ON p.tree = low.tree AND low.n > 1 AND low.i // 16 = p.i >> (4 * low.l + 4) GROUP BY p.rid, low.l
  UNION ALL
  SELECT p.rid, 1, high.l, string_agg(high.h, '' ORDER BY high.i) FILTER (high.i < s.i >> (4 * high.l)), string_agg(high.h, '' ORDER BY high.i) FILTER (high.i > s.i >> (4 * high.l))
  FROM p JOIN s USING (tree) JOIN high ON high.n > 1 AND high.i // 16 = s.i >> (4 * high.l + 4) GROUP BY p.rid, high.l),
step AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, l) AS k, coalesce(a, '') AS a, coalesce(b, '') AS b FROM side),
proof AS (SELECT rid, string_agg(a || b, '' ORDER BY k) AS all_sides, max(k) AS last FROM step GROUP BY rid),
fold AS (SELECT rid, 0 AS k, other AS h FROM p UNION ALL SELECT fold.rid, step.k, sha256(step.a || fold.h || step.b) FROM fold JOIN step ON fold.rid = step.rid AND step.k = fold.k + 1)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(proof.all_sides, '')) AS proof_sha256, fold.h AS folded_root, fold.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM p JOIN s USING (tree) LEFT JOIN proof USING (rid) JOIN fold ON fold.rid = p.rid AND fold.k = coalesce(proof.last, 0)"""
