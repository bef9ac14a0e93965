"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Topics come from the words: distinct words are hashed to BINS bins,
weighted by how few documents have them, and documents are clustered by direction (spherical k-means from random
centroids, SWEEPS passes over all documents; a model of TOPICS x BINS numbers). Token weights of the cells are raked until their
marginals meet the targets; a document is kept with the probability its cell needs, decided by a hash of its
id and text, so a rerun keeps the same ones.

Probabilities are min(1, c * weight) for a stated amount of tokens (KEEP of all, or a budget). Cells that reach 1
are kept whole, and raking goes on over the others: a small cell can't scale down the corpus. What a category is
short of (its share of the amount is more than it has) the others of its dimension make up in proportion.

Up to MAX_CELLS cells (one row per combination that occurs) are raked on the driver. More stay a table in blocks: each step is then one
aggregation of sums per block and category, and the driver holds a name and a number per category. Both add the same numbers in
the same order, so every probability is the same to the last bit, whichever way is taken. Up to MAX_CELLS cells no text is shuffled;
a larger table of probabilities is joined as the planner decides. Defined results:
null sources, languages, topics and texts are values of their own ('' in cells);
categories without a target keep their present share; rows that repeat an id and text are kept or left
together; a text without words weighs nothing in the cells, has the topic 'none' and is treated like its cell; columns of
docs keep their values, but those called topic, n_tokens, probability or sampled are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut, table, texts_of, unused, word_arrays

#: Cells that the driver rakes; it changes no result.
MAX_CELLS = 200_000
TOPICS, BINS, SWEEPS = 12, 4096, 2
DIMENSIONS = ("source", "lang", "topic")
#: Shares wanted by default: sources and topics by their token share to this power, languages as listed.
POWER = {"source": 0.8, "topic": 0.9}
LANGUAGES = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
#: Share of the tokens kept where no budget is given.
KEEP = 0.5
SEED = 17


class Topics:
    """Weights of bins and centroids; a document's topic is the centroid nearest in direction to its weighted bins."""

    def __init__(self, seed: int, topics: int, bins: int) -> None:
        self.weight, self.centroids = np.ones(bins), np.abs(np.random.default_rng(seed).standard_normal((topics, bins)))

    def bins(self, h: np.ndarray) -> np.ndarray:
        return np.unique((h >> np.uint64(32)) % np.uint64(len(self.weight))).astype(np.int64)

    def topic(self, bins: np.ndarray) -> int:
        return int(np.argmax(self.centroids[:, bins] @ self.weight[bins])) if len(bins) else -1


def fit_topics(docs: DataFrame, topics: int = TOPICS, bins: int = BINS, sweeps: int = SWEEPS, seed: int = SEED) -> Topics:
    """One pass over all texts for the weights, then one per sweep; tasks sum what they see, at most topics x bins numbers each."""
    model = Topics(seed, topics, bins)
    spark = docs.sparkSession

    def sums(weigh: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = sent.value
            total = np.zeros((topics if weigh else 1, bins))
            for batch in batches:
                for h in word_arrays(texts_of(batch), lower=True):
                    some = of.bins(h)
                    if weigh and len(some):
                        w = of.weight[some]
                        total[of.topic(some), some] += w / max(np.sqrt((w * w).sum()), 1e-12)
                    elif len(some):
                        total[0, some] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

        out = np.zeros((topics if weigh else 1) * bins)
        for r in docs.select("text").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum(F.col("n").cast("decimal(28,8)")).cast("double").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out.reshape(-1, bins)

    seen = sums(False)[0]
    model.weight = np.log((seen.max() + 2) / (seen + 1))
    for _ in range(sweeps):
        total = sums(True)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        model.centroids = np.where(length > 0, total / np.maximum(length, 1e-12), model.centroids)
    return model


def with_topics(docs: DataFrame, model: Topics) -> DataFrame:
    """docs with topic ('t0' .., 'none' without words) and n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("topic", "n_tokens")
    schema = StructType([*docs.schema.fields, StructField("topic", IntegerType()), StructField("n_tokens", LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic, n = [], []
            for h in word_arrays(texts_of(batch), lower=True):
                topic.append(sent.value.topic(sent.value.bins(h)))
                n.append(len(h))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topic, pa.int32()), pa.array(n, pa.int64())], names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("topic", F.when(F.col("topic") < 0, "none").otherwise(F.concat(F.lit("t"), F.col("topic").cast("string"))))


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 200, close: float = 1e-10) -> np.ndarray:
    """Weights per cell so that tokens * weights has the target shares in each dimension.

    codes[d, c] is cell c's category in dimension d; targets[d] are the shares of that dimension's
    categories. Dimensions are scaled in turn; if the targets contradict each other the last round stands.
    """
    mass = tokens / tokens.sum()
    start = mass.copy()
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, mass, len(target))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            off = max(off, float(np.abs(now - target).max()))
            mass = mass * factor[code]
        if off < close:
            break
    return np.divide(mass, start, out=np.zeros_like(mass), where=start > 0)


def scaled(tokens: np.ndarray, value: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """value times a factor per category, so that tokens * min(1, value) sums to `want` there, or to all it has if that is less.

    The sum is concave in the factor: Newton steps from below never overshoot and end.
    """
    n = len(want)
    now = np.bincount(code, tokens * value, n)
    factor = np.divide(want, now, out=np.zeros_like(now), where=now > 0)
    while True:
        free = value * factor[code] < 1
        held, rest = np.bincount(code, tokens * ~free, n), np.bincount(code, tokens * value * free, n)
        better = np.maximum(factor, np.divide(want - held, rest, out=np.zeros_like(rest), where=rest > 0))
        if (better <= factor * (1 + 1e-12)).all():
            return value * factor[code]
        factor = better


#: Parts of the cells that are summed each on its own; then their sums are added in the order of the parts.
BLOCKS = 16
MOST = 1e12


def _values(codes: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A cell's value is the product of a factor per category, given by its logarithm: some grow and others shrink without end where targets contradict each other."""
    out = np.zeros(codes.shape[1])
    for code, f in zip(codes, factors, strict=True):
        out = out + f[code]
    return np.exp(np.minimum(out, np.log(MOST)))


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(x, out=np.full(len(x), -np.inf), where=x > 0)


def _sums(tokens: np.ndarray, codes: np.ndarray, factors: list[np.ndarray], dim: int, trial: np.ndarray) -> np.ndarray:
    """Per category of dim: tokens * value, the tokens of cells that trial * value takes to 1 or more, tokens * value of the others."""
    value, code, n = _values(codes, factors), codes[dim], len(trial)
    free = value * trial[code] < 1
    return np.stack([np.bincount(code, w, n) for w in (tokens * value, tokens * ~free, tokens * value * free)]).astype(float)  # of no cells: integers


def _packed(codes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, codes and a code that all share) of the cells of a block that have tokens, in the order of their codes."""
    order = np.lexsort(codes[::-1])
    order = order[tokens[order] > 0]
    return tokens[order].astype(float), np.vstack([codes[:, order], np.zeros((1, len(order)), np.int64)]).astype(np.int64)


class Cells:
    """Cells in blocks, as arrays of the driver or as rows of a table. Sums come out the same to the last bit: blocks are summed in order, by the same code."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]] | DataFrame, dims: int) -> None:
        self.blocks, self.dims = blocks, dims

    def sums(self, factors: list[np.ndarray], dim: int, trial: np.ndarray) -> np.ndarray:
        total = np.zeros((3, len(trial)))
        if isinstance(self.blocks, list):
            for tokens, codes in self.blocks:
                total += _sums(tokens, codes, factors, dim, trial)
            return total
        sent, dims = self.blocks.sparkSession.sparkContext.broadcast((factors, dim, trial)), self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    got = _sums(np.frombuffer(row["tokens"]), np.frombuffer(row["codes"], np.int64).reshape(dims + 1, -1), *sent.value)
                    at = np.flatnonzero(got.any(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"], np.int32)), pa.array(at), *map(pa.array, got[:, at])], ["block", "at", "a", "b", "c"])

        each = self.blocks.mapInArrow(run, "block int, at long, a double, b double, c double").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("block", "a", "b", "c"))).alias("x"))
        added = lambda c: F.aggregate(F.transform("x", lambda x: x[c]), F.lit(0.0), lambda s, v: s + v).alias(c)
        got = each.select("at", *map(added, "abc")).toPandas()  # a row per category
        sent.unpersist()
        for i, c in enumerate("abc"):
            total[i, got["at"].to_numpy()] = got[c].to_numpy()
        return total

    def rake(self, targets: list[np.ndarray], rounds: int = 200, close: float = 1e-10) -> list[np.ndarray]:
        """Logarithms of factors per category so that tokens * value has the target shares, see `rake`."""
        factors = [np.zeros(len(x)) for x in targets] + [np.zeros(1)]
        whole = self.sums(factors, self.dims, np.ones(1))[0, 0]
        for _ in range(rounds):
            off = 0.0
            for dim, target in enumerate(targets):
                now = self.sums(factors, dim, np.ones(len(target)))[0] / whole
                off = max(off, float(np.abs(now - target).max()))
                factors[dim] = factors[dim] + _log(np.divide(target, now, out=np.zeros_like(now), where=now > 0))
            if off < close:
                break
        return factors

    def scale(self, factors: list[np.ndarray], dim: int, want: np.ndarray) -> float:
        """Change the factors of dim as `scaled` does; gives how far its sums were off."""
        now, held, rest = self.sums(factors, dim, np.ones(len(want)))
        off = float(np.abs(held + rest - want).max())
        factor = np.divide(want, now, out=np.zeros_like(now), where=now > 0)
        while True:
            _, held, rest = self.sums(factors, dim, factor)
            better = np.maximum(factor, np.divide(want - held, rest, out=np.zeros_like(rest), where=rest > 0))
            if (better <= factor * (1 + 1e-12)).all():
                factors[dim] = factors[dim] + _log(factor)
                return off
            factor = better

    def calibrate(self, has: list[np.ndarray], targets: list[np.ndarray], amount: float, rounds: int = 200, close: float = 1e-10) -> list[np.ndarray]:
        """The same for `calibrate`; has: the tokens of each category."""
        reach = []
        for tokens, target in zip(has, targets, strict=True):
            part = np.divide(target, tokens, out=np.zeros_like(tokens), where=tokens > 0)
            reach.append(tokens * np.minimum(1, scaled(tokens, part, np.zeros(len(tokens), int), np.array([amount]))))
        factors = self.rake(targets)
        for _ in range(rounds):
            if max([self.scale(factors, dim, want) for dim, want in enumerate(reach)]) < close * amount:
                break
        self.scale(factors, self.dims, np.array([amount]))
        return factors


def calibrate(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], amount: float) -> np.ndarray:
    """Probability per cell (all have tokens), so that tokens * probability sums to amount with the target shares as far as they can be reached.

    codes and targets as for rake. If targets contradict each other within the cells, the last round stands.
    """
    all_ = np.vstack([codes, np.zeros((1, len(tokens)), np.int64)])
    has = [np.bincount(code, tokens, len(target)) for code, target in zip(codes, targets, strict=True)]
    return np.minimum(1, _values(all_, Cells([(tokens, all_)], len(codes)).calibrate(has, targets, amount)))


def wanted(shares: dict[str, float], given: dict[str, float] | None) -> dict[str, float]:
    """Given shares for the categories that occur, present ones for the rest, as a distribution."""
    rest = {k: v for k, v in shares.items() if k not in (given or {})}
    out = {k: (given[k] if given and k in given else v) for k, v in shares.items()}
    listed = sum(out[k] for k in out if k not in rest)
    if listed and rest:  # listed categories share what the others leave
        room = 1 - sum(rest.values())
        out = {k: v if k in rest else v * room / listed for k, v in out.items()}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with topic, n_tokens, probability and sampled.

    topic: an expression over docs, the fitted topics without it. targets: shares by dimension and category. budget:
    tokens to keep in expectation, KEEP of all without it.
    """
    if topic is None:
        rows = with_topics(docs, fit_topics(docs))
    else:
        tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        rows = docs.withColumns({"n_tokens": tokens, "topic": topic})
    rows = rows.drop("probability", "sampled")
    keys = unused(rows, "s", "l", "t")
    rows = rows.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, DIMENSIONS, strict=True)})
    counts = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    cells = cut(counts.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int")), "cells")
    held = cells.limit(max_cells + 1).toPandas()
    local = len(held) <= max_cells
    totals = [(held if local else cells.groupBy(k).agg(F.sum("tokens").alias("tokens")).toPandas()).groupby(k)["tokens"].sum().sort_index() for k in keys]  # a row per category
    names = [{name: i for i, name in enumerate(x.index)} for x in totals]
    has = [x.to_numpy(float) for x in totals]
    factors = None
    if has[0].sum() > 0:
        shares = []
        for name, number, tokens in zip(DIMENSIONS, names, has, strict=True):
            share = dict(zip(number, (tokens / tokens.sum()).tolist(), strict=True))
            given = (targets or {}).get(name)
            if given is None:
                powered = {k: v ** POWER[name] for k, v in share.items()} if name in POWER else LANGUAGES
                given = {k: v / sum(powered.values()) for k, v in powered.items()}
            want = wanted(share, given)
            shares.append(np.array([want[k] for k in number]))
        amount = min(KEEP * has[0].sum() if budget is None else budget, has[0].sum())
        sent = docs.sparkSession.sparkContext.broadcast(names)

        def codes_of(pdf: pd.DataFrame, names: list[dict[str, int]]) -> np.ndarray:
            return np.stack([pdf[k].map(number).to_numpy(np.int64) for k, number in zip(keys, names, strict=True)])

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            tokens, codes = _packed(codes_of(pdf, sent.value), pdf["tokens"].to_numpy())
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tokens": [tokens.tobytes()], "codes": [codes.tobytes()]})

        if local:
            blocks = [_packed(codes_of(some, names), some["tokens"].to_numpy()) for _, some in held.groupby("block")]
        else:
            blocks = cut(cells.groupBy("block").applyInPandas(packed, "block int, tokens binary, codes binary"), "blocks")
        factors = Cells(blocks, len(keys)).calibrate(has, shares, amount)

    def chances(pdf: pd.DataFrame, names: list[dict[str, int]], factors: list[np.ndarray] | None) -> pd.DataFrame:
        p = np.ones(len(pdf))
        if factors is not None and len(pdf):
            codes = codes_of(pdf, names)
            p = np.where(pdf["tokens"] > 0, np.minimum(1, _values(np.vstack([codes, np.zeros((1, len(pdf)), np.int64)]), factors)), np.nan)
        return pdf[keys].assign(probability=p)

    schema = ", ".join(f"{k} string" for k in keys) + ", probability double"
    if local:
        found = chances(held, names, factors)
        found["probability"] = found["probability"].fillna(found["probability"].min())  # without tokens: the least of the others
        table_ = F.broadcast(docs.sparkSession.createDataFrame(list(found.itertuples(index=False, name=None)), schema))
    else:
        given_ = docs.sparkSession.sparkContext.broadcast((names, factors))
        found = cells.mapInPandas(lambda frames: (chances(pdf, *given_.value) for pdf in frames), schema)
        found = cut(found.withColumn("probability", F.nanvl("probability", F.lit(None).cast("double"))), "probabilities")
        least = found.agg(F.min("probability")).first()[0]
        table_ = found.withColumn("probability", F.coalesce("probability", F.lit(least)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.join(table_, keys).drop(*keys).withColumn("sampled", draw < F.col("probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("sampled").select("doc_id", "text", "lang", "source", "n_chars")
