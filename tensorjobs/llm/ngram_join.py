"""N-gram Jaccard self-join with prefix trees: link texts whose word-shingle sets are near equal.

Every distinct set is a node (64-bit hash of the set), so exact copies meet before any comparison.
Steps:

1. `_sets`: per text its node and set size, and a count sketch of shingles over all texts (2**20 counts,
   a fixed size). Shingles are globally ordered by the logarithm of their count, then by hash.
2. `_hubs`: two sets at the threshold share k of their first n - ceil(t*n) + k (rarest) shingles, k growing with n,
   so common passages don't suffice. The smallest node among those with a prefix shingle is its hub.
3. `_memberships`: a node joins the blocks of its hubs, so every pair that shares a prefix shingle meets in a block.
   A node that shares fewer than k with anyone links with nothing; one that shares enough still leaves out the hubs of
   which it has the fewest shingles, up to (k - 1) / 2 of these: both sides of a link together can't lose all k.
4. `_join_blocks`: large blocks are split in chunks that all hold the hub. In a chunk the ordered sets (most
   frequent shingle first) form a prefix tree (`PrefixTree`). A probe descends it level by level, keeps the overlap
   counted along shared paths, and leaves a subtree as soon as what remains of either set cannot make up for what
   was missed. A chunk is bounded in shingles and in sets (each weighs SET_WEIGHT shingles more).
5. `_rest`: members of a split block in another component than the hub are compared with the rest of
   the block, as probes against chunks; pairs whose distances to the hub differ by more than 1 - t, or whose
   sizes are too far apart, cannot link (Jaccard distance is a metric).

Texts are hashed in three scans, block by block; what is shuffled are prefix shingles once, shared ones once more,
and the texts of nodes that remain in blocks.

Defined results: null, blank and empty texts have an empty set and link with nothing; rows that repeat
an id are nodes like others; null ids take part but never name a component unless it has no other id; very long
texts are compared whole; columns other than doc_id and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, drop, each_text, gram_hashes, has_bit, mix, ragged, runs, table, texts_of, word_arrays
from .components import components

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
SKETCH_BITS, SLICE = 20, 4096
KEY_BITS, SHINGLE_BITS = 25, 27
#: Shingles in a chunk of a block, on average; each set counts for so many more.
CHUNK, SET_WEIGHT = 150_000, 16
#: One more shared shingle is asked for per so many of a set, in a prefix that much longer.
EVIDENCE = 16


def shingle_sets(texts: Iterable[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; of the whole sequence if it has fewer words."""
    for h in word_arrays(texts, lower=True):
        s = gram_hashes(h, min(size, len(h))) if len(h) else h
        s.sort()
        yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def rare_first(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the global order; `shingles` are sorted, so ties in rank stay sorted by hash."""
    return shingles[np.argsort(ranks[(shingles & np.uint64(len(ranks) - 1)).astype(np.int64)], kind="stable")]


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, node) for texts, (chunk, counts) for the sketch: one pass, written once."""
    schema = "doc_id long, text_key long, n long, node long, chunk int, counts binary"
    names = ["doc_id", "text_key", "n", "node", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(1 << SKETCH_BITS, np.int64), 1 << SKETCH_BITS
        for batch in batches:
            n, node, held, held_n = [], [], [], 0
            for s in shingle_sets(each_text(batch)):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                held.append((s & np.uint64(size - 1)).astype(np.int64))
                held_n += len(s)
                if held_n > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, held_n = [], 0
            if held_n:
                total += np.bincount(np.concatenate(held), minlength=size)
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names
            )
        parts = total.reshape(-1, SLICE)
        chunks = [i for i in range(len(parts)) if parts[i].any()]
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(chunks, pa.int32()), pa.array([parts[i].tobytes() for i in chunks], pa.binary())], names)

    return cut(docs.mapInArrow(run, schema), "shingle-sets")


def _ranks(sketch: DataFrame) -> np.ndarray:
    """log2 of the counts, as bytes: 1 MB whatever the data. Slices of the tasks' sketches are summed where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(counts, np.int64)
                total[chunk] = total[chunk] + counts if chunk in total else counts
        if total:
            ranks = [np.log2(c + 1).astype(np.uint8).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["chunk", "ranks"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sketch.select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, ranks binary").collect():
        out[r["chunk"] * SLICE : (r["chunk"] + 1) * SLICE] = np.frombuffer(bytes(r["ranks"]), np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n to look at: 1 + n // EVIDENCE of them at least are in any set it links with.

    Both sets of a link see the first k they share, where k is that of the smaller set, of percent * n / 100 at least.
    """
    return n - -(-percent * n // 100) + 1 + n // EVIDENCE


def least_shared(n: int, percent: int) -> int:
    """Prefix shingles that a set of n shares with any set it links with, at least: the other has percent * n / 100 of them or more."""
    return 1 + -(-percent * n // 100) // EVIDENCE


def _prefixes(docs: DataFrame, ranks, percent: int, bits=None) -> DataFrame:
    """(shingle, node, n, copies): the prefix shingles of each text, once for all its copies in a batch; with `bits` only those that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place: dict[int, int] = {}
            nodes, sizes, copies, tokens, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                lengths = [len(t) for t in tokens]
                spread = lambda x, kind: pa.array(np.repeat(np.array(x, kind), lengths))
                columns = [pa.array(np.concatenate(tokens).view(np.int64)), spread(nodes, np.int64), spread(sizes, np.int32), spread(copies, np.int32)]
                return pa.RecordBatch.from_arrays(columns, ["shingle", "node", "n", "copies"])

            for s in shingle_sets(each_text(batch)):
                if not len(s):
                    continue
                node = node_of(s)
                if node in place:
                    copies[place[node]] += 1
                    continue
                prefix = rare_first(s, ranks.value)[: prefix_length(len(s), percent)]
                if bits is not None:
                    prefix = prefix[has_bit(bits.value, (prefix & np.uint64((1 << SHINGLE_BITS) - 1)).astype(np.int64))]
                place[node] = len(nodes)
                nodes.append(node)
                sizes.append(len(s))
                copies.append(1)
                tokens.append(prefix)
                held += len(prefix)
                if held > 100_000:
                    yield out()
                    place, held = {}, 0
                    nodes, sizes, copies, tokens = [], [], [], []
            if nodes:
                yield out()

    return docs.select("text").mapInArrow(run, "shingle long, node long, n int, copies int")


def _hubs(docs: DataFrame, ranks, percent: int) -> DataFrame:
    """(shingle, hub) of prefix shingles that several nodes have."""
    return _prefixes(docs, ranks, percent).groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("shingle", "hub")


def _memberships(docs: DataFrame, ranks, hubs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(hub, node, n): the nodes of each hub's block, the hub (their smallest) among them."""
    at = F.col("shingle").bitwiseAND(F.lit((1 << SHINGLE_BITS) - 1))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(hubs, at, SHINGLE_BITS))
    met = _prefixes(docs, ranks, percent, bits).join(hubs, "shingle").groupBy("hub", "node", "n").agg(F.sum("copies").alias("k"))
    met = met.join(classes.select("node", F.col("copies").alias("of")), "node").select("hub", "node", "n", (F.col("k") / F.col("of")).cast("long").alias("k"))
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / EVIDENCE)
    own = Window.partitionBy("node")  # the prefix shingles of one set at most
    members = (
        met.withColumns({"all": F.sum("k").over(own), "up_to": F.sum("k").over(own.orderBy("k", "hub").rowsBetween(Window.unboundedPreceding, 0))})
        .where((F.col("all") >= least) & (F.col("up_to") > F.floor((least - 1) / 2)))
        .select("hub", "node", "n")
    )
    members = cut(members, "meetings")
    first = members.groupBy("hub").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("hub", "first")
    return members.join(first, "hub").select(F.col("first").alias("hub"), "node", "n").distinct()


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) of the keys, each once; a bitmap of fixed size keeps the others out of the shuffle."""
    at = F.pmod("text_key", F.lit(1 << KEY_BITS))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys, at, KEY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, batch.column("at").to_numpy()))).select(["text_key", "text"])

    some = docs.select("text_key", "text", at.alias("at")).mapInArrow(run, "text_key long, text string")
    return some.groupBy("text_key").agg(F.first("text").alias("text")).join(keys.select("text_key").distinct(), "text_key", "left_semi")


class PrefixTree:
    """Ordered sets as a prefix tree with paths compressed: each tree node holds a run of shingles that all sets below it share.

    Shingles are numbered in the global order, most frequent first. Tree nodes lie level by level, children of one
    node side by side, so that a probe handles all live nodes of a level at once.
    """

    def __init__(self, sets: list[np.ndarray], ranks: np.ndarray | None = None) -> None:
        self.vocabulary = np.unique(np.concatenate(sets))
        rank = np.zeros(1, np.uint8) if ranks is None else ranks
        order = np.argsort(rank[(self.vocabulary & np.uint64(len(rank) - 1)).astype(np.int64)], kind="stable")
        self.number = np.empty(len(order), np.int32)
        self.number[order] = np.arange(len(order) - 1, -1, -1)
        sequences = [np.sort(self.number[np.searchsorted(self.vocabulary, s)]) for s in sets]
        keys = [s.astype(">i4").tobytes() for s in sequences]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        begin, end, of, parent, leaf, stack = [], [], [], [], [], []
        before = None
        for i in order:
            s = sequences[i]
            depth = 0
            if before is not None:
                m = min(len(before), len(s))
                other = np.flatnonzero(before[:m] != s[:m])
                depth = int(other[0]) if len(other) else m
            while stack and begin[stack[-1]] >= depth:
                stack.pop()
            if stack and depth < end[stack[-1]]:  # the path parts within a run: the part above becomes a node of its own
                below = stack.pop()
                stack.append(len(begin))
                begin.append(begin[below])
                end.append(depth)
                of.append(of[below])
                parent.append(parent[below])
                begin[below], parent[below] = depth, stack[-1]
            if len(s) > depth:
                begin.append(depth)
                end.append(len(s))
                of.append(i)
                parent.append(stack[-1] if stack else -1)
                stack.append(len(begin) - 1)
            leaf.append(stack[-1])
            before = s
        begin, end, of, parent, leaf = (np.array(x, np.int64) for x in (begin, end, of, parent, leaf))
        level = np.zeros(len(begin), np.int64)
        for x in np.argsort(end, kind="stable").tolist():  # parents end before their children
            if parent[x] >= 0:
                level[x] = level[parent[x]] + 1
        # level by level; within a level in the order of the parents
        place, by_level = np.full(len(begin) + 1, -1), []
        for depth in range(int(level.max()) + 1):
            some = np.flatnonzero(level == depth)
            some = some[np.argsort(place[parent[some]], kind="stable")]
            place[some] = np.arange(len(some)) + sum(map(len, by_level))
            by_level.append(some)
        at = np.concatenate(by_level)
        self.first_level = len(by_level[0])
        self.end, up = end[at], place[parent[at]]
        self.length = end[at] - begin[at]
        self.start = np.cumsum(self.length) - self.length
        self.shingles = np.concatenate([sequences[i][a:b] for i, a, b in zip(of[at].tolist(), begin[at].tolist(), end[at].tolist(), strict=True)])
        self.last = self.shingles[self.start + self.length - 1]
        inner = up[self.first_level :]
        self.children = np.bincount(inner, minlength=len(at))
        self.first_child = self.first_level + np.cumsum(self.children) - self.children
        leaf = place[leaf]
        by_leaf = np.argsort(leaf, kind="stable")
        self.leaf, self.sets = leaf[by_leaf], np.array(order)[by_leaf]
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        self.shortest, self.longest = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
        np.minimum.at(self.shortest, leaf, self.sizes[order])
        np.maximum.at(self.longest, leaf, self.sizes[order])
        bounds = np.cumsum([0, *map(len, by_level)])
        for lo, hi in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):  # from the deepest level up
            np.minimum.at(self.shortest, up[lo:hi], self.shortest[lo:hi])
            np.maximum.at(self.longest, up[lo:hi], self.longest[lo:hi])
        self.mark = np.zeros(len(self.vocabulary) + 1, bool)

    def overlaps(self, probe: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the sets that link with the probe, their intersections with it); probe: sorted hashes."""
        n = len(probe)
        at = np.searchsorted(self.vocabulary, probe)
        at[at == len(self.vocabulary)] = 0
        own = np.sort(self.number[at[self.vocabulary[at] == probe]])
        self.mark[own] = True
        live, above = np.arange(self.first_level), np.zeros(self.first_level, np.int64)
        nodes, common = [], []
        while len(live):
            length = self.length[live]
            hits = self.mark[self.shingles[ragged(self.start[live], length)]]
            overlap = above + np.add.reduceat(hits, np.cumsum(length) - length, dtype=np.int64)
            most = overlap + np.minimum(self.longest[live] - self.end[live], len(own) - np.searchsorted(own, self.last[live], "right"))
            shortest = self.shortest[live]
            keep = (100 * most >= percent * (n + np.maximum(shortest, most) - most)) & (self.longest[live] * 100 >= percent * n) & (shortest * percent <= n * 100)
            live, overlap = live[keep], overlap[keep]
            nodes.append(live)
            common.append(overlap)
            children = self.children[live]
            live, above = ragged(self.first_child[live], children), np.repeat(overlap, children)
        self.mark[own] = False
        nodes, common = np.concatenate(nodes), np.concatenate(common)
        lo = np.searchsorted(self.leaf, nodes)
        count = np.searchsorted(self.leaf, nodes, "right") - lo
        found, common = self.sets[ragged(lo, count)], np.repeat(common, count)
        link = 100 * common >= percent * (n + self.sizes[found] - common)
        return found[link], common[link]


class Forest:
    """Union-find over the places of a list."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[b] = a
        return a != b


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _join_blocks(blocks: DataFrame, ranks, percent: int) -> DataFrame:
    """(hub, node, n, common, link) from (hub, chunk, node, split, text).

    A row per member of a split block with its overlap with the hub, and a row per link of a spanning forest of each chunk.
    """
    schema = "hub long, node long, n int, common int, link long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (hub, _), parts in runs(batches, ["hub", "chunk"]):
            nodes = [x for p in parts for x in p.column("node").to_pylist()]
            split = parts[0].column("split")[0].as_py()
            sets = [s for p in parts for s in shingle_sets(texts_of(p))]
            if len(nodes) == 1:
                continue
            forest, at = Forest(len(nodes)), nodes.index(hub)
            tree = PrefixTree(sets, ranks.value)
            left = len(nodes) - 1
            for i in [at, *(i for i in range(len(nodes)) if i != at)]:
                if not left:
                    break
                for j in tree.overlaps(sets[i], percent)[0].tolist():
                    if forest.join(i, j):
                        out.append((hub, nodes[j], len(sets[j]), None, nodes[i]))
                        left -= 1
            if split:
                out += [(hub, x, len(s), intersection(sets[at], s), None) for x, s in zip(nodes, sets, strict=True) if x != hub]
            if len(out) > 5000:
                yield _batch(out, ["hub", "node", "n", "common", "link"])
                out = []
        if out:
            yield _batch(out, ["hub", "node", "n", "common", "link"])

    return blocks.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("n", "common") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _rest(joined: DataFrame, roots: DataFrame, with_text: Callable[[DataFrame], DataFrame], sizes: DataFrame, ranks, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) between components that meet in a split block, in which neither was the hub's own chunk mate.

    Probes are the members outside the hub's component, in cells of like distance to the hub; each cell gets the
    members it could link with once, in a stream. A task keeps which components it has linked, directly or by others, and puts out only links
    that bring two of them together: fewer than it meets components, however many of their members are near each other.
    """
    far = F.col("common") / (F.col("n") + F.col("hub_n") - F.col("common"))
    rooted = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    hubs = sizes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    members = rooted(rooted(joined.where("common IS NOT NULL").select("hub", "node", "n", "common"), "node"), "hub").join(hubs, "hub")
    members = members.select("hub", "node", "n", "node_root", "hub_root", (1 - far).alias("d")).withColumn("bin", F.floor(F.col("d") * 20).cast("int"))
    probes = members.where("node_root <> hub_root").withColumn("cell", F.floor(F.log("n") * 5).cast("int"))
    cells = probes.groupBy("hub", "bin", "cell").agg(F.sum(F.col("n") + SET_WEIGHT).alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    cells = cells.withColumn("parts", F.ceil(F.col("total") / chunk).cast("int"))
    probes = probes.join(cells.select("hub", "bin", "cell", "parts"), ["hub", "bin", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    t = F.lit(percent / 100)
    near = (F.abs(F.col("m.bin") - F.col("c.bin")) <= F.ceil((1 - t) * 20 + 1e-9) + 1) & (F.col("m.n") >= t * F.col("c.lo")) & (F.col("m.n") * t <= F.col("c.hi"))
    against = (
        members.alias("m")
        .join(cells.alias("c"), F.expr("m.hub = c.hub") & near)
        .select("m.hub", "c.bin", "c.cell", F.explode(F.expr("sequence(0, c.parts - 1)")).alias("part"), "m.node", "m.node_root", F.lit(1).alias("side"))
    )
    rows = probes.select("hub", "bin", "cell", "part", "node", "node_root", F.lit(0).alias("side")).unionByName(against)
    keys = ["hub", "bin", "cell", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        now, nodes, roots_, sets, tree = None, [], [], [], None
        above: dict[int, int] = {}  # of linked components the one they are known by

        def known(root: int) -> int:
            while root in above:
                if above[root] in above:
                    above[root] = above[above[root]]
                root = above[root]
            return root

        for key, parts in runs(batches, [*keys, "side"]):
            for p in parts:
                some = zip(p.column("node").to_pylist(), p.column("node_root").to_pylist(), shingle_sets(texts_of(p)), strict=True)
                if key[-1] == 0:
                    if key[:-1] != now:
                        now, nodes, roots_, sets, tree = key[:-1], [], [], [], None
                    for node, root, s in some:
                        nodes.append(node)
                        roots_.append(root)
                        sets.append(s)
                    continue
                if tree is None:
                    tree = PrefixTree(sets, ranks.value)
                for node, root, s in some:
                    for j in tree.overlaps(s, percent)[0].tolist():
                        a, b = known(root), known(roots_[j])
                        if a != b:
                            above[max(a, b)] = min(a, b)
                            out.append((node, nodes[j]))
            if len(out) > 5000:
                yield _batch(out, ["a", "b"])
                out = []
        if out:
            yield _batch(out, ["a", "b"])

    return with_text(rows).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return _linked(docs, percent, chunk).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """As link, with text_key and component: equal in the rows that links reach, also without ids; null for texts without shingles."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    sets = _sets(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(sets.where("chunk IS NOT NULL")))
    rows = sets.where("chunk IS NULL").select("doc_id", "text_key", "n", "node")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = cut(classes, "classes")
    shared = cut(_hubs(docs, ranks, percent), "hubs")
    members = cut(_memberships(docs, ranks, shared, classes, percent), "memberships")
    drop(shared)
    hubs = members.groupBy("hub").agg(F.ceil(F.sum(F.col("n") + SET_WEIGHT) / chunk).cast("int").alias("chunks"))
    blocks = (
        members.where("node <> hub")
        .join(hubs, "hub")
        .select("hub", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", (F.col("chunks") > 1).alias("split"))
        .unionByName(hubs.select("hub", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("hub").alias("node"), (F.col("chunks") > 1).alias("split")))
    )
    involved = cut(members.select("node").distinct().join(classes, "node"), "involved")
    texts = _texts(docs, involved)
    with_text = lambda df: df.join(involved.select("node", "text_key"), "node").join(texts, "text_key").drop("text_key")
    joined = cut(_join_blocks(with_text(blocks), ranks, percent), "block-links")
    links = joined.where("link IS NOT NULL").select(F.col("node").alias("a"), F.col("link").alias("b"))
    roots = components(links)
    if joined.where("common IS NOT NULL").limit(1).count():
        more = cut(_rest(joined, roots, with_text, involved, ranks, percent, chunk), "rest-links")
        if more.limit(1).count():
            roots = components(links.union(more))
    smallest = roots.join(classes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("smallest"))
    named = classes.select("node", "first_id").join(roots.join(smallest, "root"), "node", "left").select("node", "root", F.coalesce("smallest", "first_id").alias("smallest"))
    own = rows.join(cut(named, "components"), "node", "left")  # a table of its own, so that a text with very many copies can be split
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), "text_key", F.coalesce("root", "node").alias("component"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, then text hash; rows without id come last. Texts without shingles are told apart by id and text."""
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "text_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("x")
    kept = _linked(docs).withColumn("_alone", alone).groupBy("component", "_alone").agg(first).select(F.col("x.doc_id").alias("_id"), F.col("x.text_key").alias("_text"))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_key", F.xxhash64("text"))
    once = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left_semi")
    return once.dropDuplicates(["doc_id", "_key"]).drop("_key")
