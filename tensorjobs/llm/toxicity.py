"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between of a whole text,
hashed to 2**BITS coordinates. FTRL keeps a rate per coordinate and its L1 term leaves most weights at
exactly zero, so the model is a short list of weights that is broadcast (bounded by 2**BITS).

Training reads a bounded sample of labelled rows (SAMPLE, the smallest hashes of their ids); scoring reads
every text. Defined results: a null or empty text has only the constant feature; documents and labels
with null ids or labels are not learned from; a document with several labels counts as toxic if one says
so; without any labelled row the score is 0.5 times nothing learned, that is 0.5, and with labels of one
class it tends to that class; rows that repeat an id are learned from and scored one by one; texts of any length are taken
whole; columns that are not asked for are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, WordHash, crc_mod, gram_hashes, mix, table, texts_of, word_hash, word_hashes

BITS = 20
#: Labelled documents that are learned from, at most.
SAMPLE = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.3, 1.0, 8.0, 1.0
THRESHOLD = 0.3
_EDGES = re.compile(rb"^[^A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+$")


class CleanHash(WordHash):
    """Hashes of words in lower case without punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(_EDGES.sub(b"", word))
        if len(self) < CACHE:
            self[word] = h
        return h


def features(cache: CleanHash, text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of a text, the constant one (0) included."""
    h = word_hashes(cache, (text or b"").lower().split())
    with np.errstate(over="ignore"):
        skips = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:] + np.uint64(11)) if len(h) > 2 else h[:0]
    grams = np.concatenate([gram_hashes(h, 1), gram_hashes(h, 2), skips])
    return np.unique(np.append((grams >> np.uint64(64 - bits)).astype(np.int64), 0))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights from (coordinates, label) rows, in their order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    step = l1 * np.ones(1 << bits)
    step[0] = 0.0  # the constant is not shrunk

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= step[i], 0.0, -(zi - np.sign(zi) * step[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in rows:
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - rate * w
            n[i] += g * g
    return weights(np.arange(1 << bits))


def _featured(docs: DataFrame, *keep: str) -> DataFrame:
    names = [*keep, "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hash(CleanHash)
        for batch in batches:
            f = [features(cache, t).astype(np.int32) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(f, pa.list_(pa.int32()))], names)

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", f array<int>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most `sample` labelled documents whose id meets `learn`."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.coalesce(learn, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    some = spark.createDataFrame(known.orderBy("h", "doc_id").limit(sample).collect(), "doc_id long, y int, h long")  # `sample` rows
    rows = _featured(docs.join(F.broadcast(some), "doc_id"), "h", "doc_id", "y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = fit([(np.asarray(f, np.int64), int(y)) for pdf in frames for f, y in zip(pdf.f, pdf.y, strict=True)])
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})

    # the sample is bounded, so one task learns from it, in the order of hashes
    learned = rows.repartition(1).sortWithinPartitions("h", "doc_id").mapInPandas(run, "at int, w double").collect()
    w = np.zeros(1 << BITS)
    for r in learned:
        w[r["at"]] = r["w"]
    return w


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The columns `keep` and score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hash(CleanHash)
        for batch in batches:
            s = np.array([sent.value[features(cache, t)].sum() for t in texts_of(batch)], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(1.0 / (1.0 + np.exp(-np.clip(s, -500, 500))))], [*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    weights = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~out)
    return score(docs, weights, "doc_id").select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
