"""Minimum-cost-flow resharding: move as few bytes as possible from old shards to new capacities.

Documents of an old shard fall into blocks by a hash of their id and text. A flow from old shard
sizes to new capacities, at a cost of 1 per byte that changes shard, says how many bytes go where;
blocks then realise the flow. As blocks are whole, each flow between two shards is met up to a block, and evening out
the shards moves a few more: `moved_bytes` tells the bytes moved and the least that the flow asks for. Only block sizes (old shards x blocks rows, whatever the data) reach
the driver, and no text is shuffled.

Defined results: a null text has size 1 and no crc; null ids hash like any value, repeated rows are
placed one by one, but rows with one id and text share a block; equal texts are not kept together (under the law `bytes`
only sizes count, and copies of one text may be a third of all rows); ties in size go to the smaller shard, then block;
texts of any length count whole, and one that is larger than a shard's share fills its shard alone; other columns are
ignored by `plan` and kept by `rewrite`, whose column shard replaces one of that name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCKS = 1024


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> np.ndarray:
    """Flow[i, j] of least total cost that ships all of `supply` within `demand` (successive shortest paths)."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity, cost; the reverse edge is at index ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, capacity: int, c: int) -> None:
        for x, y, cap, k in ((a, b, capacity, c), (b, a, 0, -c)):
            out[x].append(len(edges))
            edges.append([y, cap, k])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supply[i], demand[j]), cost[i][j])
    for j, d in enumerate(demand):
        add(n + j, sink, d, 0)
    height = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        far, back, queue = [float("inf")] * (n + m + 2), [-1] * (n + m + 2), [(0, source)]
        far[source] = 0
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y, cap, c = edges[e]
                if cap and d + c + height[x] - height[y] < far[y]:
                    far[y], back[y] = d + c + height[x] - height[y], e
                    heapq.heappush(queue, (far[y], y))
        if back[sink] < 0:
            raise ValueError("the new capacities are smaller than the data")
        height = [h + f if f < float("inf") else h for h, f in zip(height, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(back[x])
            x = edges[back[x] ^ 1][0]
        step = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= step
            edges[e ^ 1][1] += step
        left -= step
    return np.array([[edges[first + 2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)], dtype=object).reshape(n, m)


def assign_blocks(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard, from (old shard, block, bytes).

    Large blocks first, each to the target with most of its flow left; then single blocks move from
    the fullest to the emptiest shard as long as that lowers the difference.
    """
    old = sorted({b[0] for b in blocks})
    supply = [sum(s for o, _, s in blocks if o == x) for x in old]
    cost = [[0 if x == j else 1 for j in range(len(capacities))] for x in old]
    left = {x: list(row) for x, row in zip(old, min_cost_flow(supply, capacities, cost), strict=True)}
    to: dict[tuple[int, int], int] = {}
    load = [-c for c in capacities]  # above its capacity
    sizes = {(o, b): s for o, b, s in blocks}
    for o, b, s in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        j = max(range(len(capacities)), key=lambda j: (left[o][j], j == o, -j))
        left[o][j] -= s
        load[j] += s
        to[o, b] = j
    inside: list[list[tuple[int, tuple[int, int]]]] = [sorted((sizes[k], k) for k in to if to[k] == j) for j in range(len(capacities))]
    for _ in range(10 * len(capacities)):
        hi, lo = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap = load[hi] - load[lo]
        best = min(inside[hi], key=lambda x: abs(gap / 2 - x[0]), default=None)
        if best is None or best[0] >= gap:
            break
        inside[hi].remove(best)
        inside[lo] = sorted([*inside[lo], best])
        load[hi] -= best[0]
        load[lo] += best[0]
        to[best[1]] = lo
    return to


def plan(docs: DataFrame, old: Column, n_shards: int, blocks: int = BLOCKS, capacities: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, transfers).

    placed: doc_id, size, text_crc32, old_shard, block, shard, slot. transfers: old_shard, block,
    n_bytes, n_rows, shard - the block moves if shard differs. `old` gives a document's present shard
    (an int). Capacities default to equal shares of the bytes.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        old.cast("int").alias("old_shard"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    found = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows")).collect()
    total = sum(r["n_bytes"] for r in found)
    if capacities is None:
        capacities = [(total + i) // n_shards for i in range(n_shards)]
    to = assign_blocks([(r["old_shard"], r["block"], r["n_bytes"]) for r in found], capacities) if found else {}
    base, moved = [0] * n_shards, []
    for r in sorted(found, key=lambda r: (r["old_shard"], r["block"])):
        j = to[r["old_shard"], r["block"]]
        moved.append((r["old_shard"], r["block"], r["n_bytes"], r["n_rows"], j, base[j]))
        base[j] += r["n_rows"]
    spark = docs.sparkSession
    transfers = spark.createDataFrame(moved, "old_shard int, block int, n_bytes long, n_rows long, shard int, first_slot long")
    rank = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size"))
    placed = (
        rows.withColumn("rank", rank)
        .join(F.broadcast(transfers.drop("n_bytes", "n_rows")), ["old_shard", "block"])  # old shards x blocks rows
        .withColumn("slot", F.col("first_slot") + F.col("rank") - 1)
        .drop("rank", "first_slot")
    )
    return placed, transfers.drop("first_slot")


def moved_bytes(transfers: DataFrame, n_shards: int, capacities: list[int] | None = None) -> tuple[int, int]:
    """(bytes that the transfers move, the least that meeting the capacities exactly moves)."""
    by = transfers.groupBy("old_shard").agg(F.sum("n_bytes").alias("n"), F.sum(F.when(F.col("old_shard") != F.col("shard"), F.col("n_bytes")).otherwise(0)).alias("moved")).orderBy("old_shard").collect()
    total = sum(r["n"] for r in by)
    capacities = capacities or [(total + i) // n_shards for i in range(n_shards)]
    cost = [[int(r["old_shard"] != j) for j in range(n_shards)] for r in by]
    flow = min_cost_flow([r["n"] for r in by], capacities, cost) if by else np.zeros((0, n_shards))
    return sum(r["moved"] for r in by), int(sum(f * c for row, costs in zip(flow, cost, strict=True) for f, c in zip(row, costs, strict=True)))


def rewrite(docs: DataFrame, transfers: DataFrame, old: Column, path: str, blocks: int = BLOCKS) -> list[int]:
    """Write the shards that lose or gain a block, as path/shard=J; returns their numbers. Others keep their files."""
    at = F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(blocks)).cast("int")
    moves = transfers.where("old_shard <> shard").select(F.array("old_shard", "shard").alias("s")).distinct().collect()
    affected = sorted({x for r in moves for x in r["s"]})
    (
        docs.withColumns({"_old": old.cast("int"), "_block": at})
        .join(F.broadcast(transfers.select(F.col("old_shard").alias("_old"), F.col("block").alias("_block"), "shard")), ["_old", "_block"])
        .where(F.col("shard").isin(affected))
        .drop("_old", "_block")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
    return affected


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by source, one of them hot, to eight of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(6))
    placed, _ = plan(docs, old, 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
