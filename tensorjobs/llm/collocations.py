"""Phrase collocations by prefix-free parsing: n-grams are counted in the distinct chunks of the texts, weighted by their frequency.

Texts are lower-cased in A-Z, split at PAUSES into pieces and those at blanks into words. Everything is per language.

1. `parse` cuts each text before words where a hash of the word and the one before is 0 modulo MODULUS, so equal passages are cut
   alike wherever they stand. A chunk owns the n-grams that start in it and carries the LONGEST - 1 words after it, so that
   those are whole: overlaps are counted once. Equal chunks are counted before the shuffle: the dictionary with frequencies.
   Runs without such a place are cut after LIMIT words, which only costs equal chunks.
2. `frequent` prunes: a phrase can only have LEAST occurrences if its parts have. n-grams of n words are looked at
   where both their parts of n - 1 words may be frequent, counted by 64-bit hash (an upper bound of the count),
   and what reaches LEAST goes into a bitmap. The bitmap has a size that follows the number of frequent hashes up to
   2 ** MOST_BITS; beyond that it fills up and lets more through, never less.
3. `phrases` counts the n-grams that pass, as text; these counts are exact, whatever the hashes let through.
4. `score` takes each candidate apart (joins), drops those inside frequent longer ones, and ranks, in parts first,
   so that no task sorts a whole language.

Defined results: a null text is empty and has no words; a null language counts as `und`, together with the language of that
name; repeated rows and copies count each time; texts, words and pieces of any length are taken whole; other columns are ignored,
whatever their names; an empty table gives an empty result. Products are decimals of 38 digits: counts up to 9 * 10 ** 15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK, bitmap, cut, drop, gram_hashes, has_bit, mix, ragged, table, texts_of, word_places

PAUSES = b".,;:!?\n\v\f\r"
#: Words of a phrase at most, and occurrences it needs.
LONGEST, LEAST = 3, 10
#: Percent of a phrase's occurrences inside a longer one that drop it; phrases reported per language.
INSIDE, TOP = 50, 2000
#: Mean words of a chunk, and most.
MODULUS, LIMIT = 32, 256
LEAST_BITS, MOST_BITS = 22, 30
#: n-grams that a task counts before it puts them out.
AT_ONCE = 1_000_000
#: Parts in which a language is ranked first.
PARTS = 64
_PLAIN = bytes(10 if c in PAUSES else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(buffer, where its texts start, number of the first): texts one after the other, each ended by a pause, about BLOCK bytes or one text."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > BLOCK:
            yield b"\n".join([*held, b""]), np.cumsum([0, *[len(t) + 1 for t in held[:-1]]]), first
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield b"\n".join([*held, b""]), np.cumsum([0, *[len(t) + 1 for t in held[:-1]]]), first


def cuts(h: np.ndarray, first: np.ndarray, modulus: int = MODULUS, limit: int = LIMIT) -> np.ndarray:
    """The words that begin chunks, from the words' hashes; first: those that begin texts."""
    at = np.zeros(len(h), bool)
    at[1:] = mix(h[1:] * np.uint64(3) + h[:-1]) % np.uint64(modulus) == 0
    at[first] = True
    starts = np.flatnonzero(at)
    counts = np.diff(np.append(starts, len(h)))
    if len(counts) and counts.max() > limit:
        parts = -(-counts // limit)
        starts = np.repeat(starts, parts) + ragged(np.zeros(len(parts), np.int64), parts) * limit
    return starts


def parse(docs: DataFrame, longest: int = LONGEST, modulus: int = MODULUS, limit: int = LIMIT) -> DataFrame:
    """(lang, own, chunk, weight): the distinct chunks, how many of their words they own, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = (t and t.translate(_PLAIN) for lo in range(0, batch.num_rows, 200) for t in texts_of(batch.slice(lo, 200)))
            for buffer, begin, number in _blocks(texts):
                h, start, end = word_places(buffer)
                if not len(h):
                    continue
                doc = np.searchsorted(begin, start, "right") - 1
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                at = cuts(h, first, modulus, limit)
                until = np.append(at[1:], len(h))
                last_of_text = np.append(first[1:], len(h))[np.searchsorted(first, at, "right") - 1]
                last = np.minimum(until + longest - 1, last_of_text) - 1
                chunks = [buffer[a:b] for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[number + d] for d in doc[at].tolist()], pa.string()), pa.array((until - at).astype(np.int32)), pa.array(chunks, pa.binary())], ["lang", "own", "chunk"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, "lang string, own int, chunk binary").groupBy("lang", "own", "chunk").agg(F.count("*").alias("weight"))


class Grams(NamedTuple):
    """n-grams of n words that the chunks of a block own: hashes (with language and n), hashes of their first and last n - 1 words, rows of the batch, spans in the buffer."""

    n: int
    keys: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rows: np.ndarray
    buffer: bytes
    start: np.ndarray
    end: np.ndarray


def _grams(batch: pa.RecordBatch, sizes: tuple[int, ...]) -> Iterator[Grams]:
    langs = batch.column("lang").to_pylist()
    salt = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
    salts, own = np.array([salt[lang] for lang in langs], np.uint64), batch.column("own").to_numpy()
    for buffer, begin, number in _blocks(texts_of(batch, "chunk")):
        h, start, end = word_places(buffer)
        if not len(h):
            continue
        chunk = np.searchsorted(begin, start, "right") - 1
        first = np.searchsorted(chunk, np.arange(len(begin)))
        owned = np.arange(len(h)) - first[chunk] < own[number + chunk]
        piece = np.searchsorted(np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10), start)
        salted = salts[number + chunk]

        def keyed(n: int, h: np.ndarray = h, salted: np.ndarray = salted) -> np.ndarray:
            return mix(gram_hashes(h, n) + salted[: max(len(h) - n + 1, 0)] * np.uint64(2 * n + 1))

        for n in sizes:
            m = max(len(h) - n + 1, 0)
            at = np.flatnonzero(owned[:m] & (piece[n - 1 :] == piece[:m]))
            part = keyed(max(n - 1, 1))
            yield Grams(n, keyed(n)[at], part[at], part[at + (n > 1)], number + chunk[at], buffer, start[at], end[at + n - 1])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal first keys together, where runs of rows with equal keys begin in it)."""
    order = np.argsort(keys[0], kind="stable")
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(change)


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _counts(chunks: DataFrame, n: int, parts: tuple[np.ndarray, int] | None) -> DataFrame:
    """(key, n): hashes of n-grams with their weights; of those, if a bitmap is given, whose parts are in it."""
    sent = chunks.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, weights = (np.concatenate(x) for x in zip(*held, strict=True))
            order, starts = _runs(keys)
            sums = np.add.reduceat(weights[order], starts) if len(starts) else weights
            return pa.RecordBatch.from_arrays([pa.array(keys[order[starts]].view(np.int64)), pa.array(sums)], ["key", "n"])

        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for g in _grams(batch, (n,)):
                keys, rows = g.keys, g.rows
                if sent.value is not None:
                    bits, k = sent.value
                    some = has_bit(bits, _place(g.first, k)) & has_bit(bits, _place(g.last, k))
                    keys, rows = keys[some], rows[some]
                held.append((keys, weight[rows]))
                size += len(keys)
                if size > AT_ONCE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return chunks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(chunks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[np.ndarray, int]:
    """(bitmap, bits) with the places of the hashes of all n-grams up to `longest` that may have `least` occurrences."""
    held, tables, most = None, [], 0
    for n in range(1, longest + 1):
        found = cut(_counts(chunks, n, held).where(F.col("n") >= least).select("key"), "frequent")
        tables.append(found)
        most += found.count()
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * most).bit_length()))
        at = F.shiftrightunsigned("key", 64 - bits)
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        held = bitmap(every, at, bits), bits
    drop(*tables)
    return held


def phrases(chunks: DataFrame, held: tuple[np.ndarray, int], longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to `longest` words with `least` occurrences; words are joined by one space."""
    sent = chunks.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        kept: list[tuple[np.ndarray, ...]] = []
        buffers: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, weights, n, lang, of, start, end = (np.concatenate(x) for x in zip(*kept, strict=True))
            order, starts = _runs(keys, end - start)
            sums = np.add.reduceat(weights[order], starts) if len(starts) else weights
            at = order[starts]
            names = list(code)
            texts = [b" ".join(buffers[i][a:b].split()) for i, a, b in zip(of[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True)]
            columns = [pa.array([names[i] for i in lang[at].tolist()], pa.string()), pa.array(texts, pa.binary()), pa.array(n[at]), pa.array(sums)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "f"])

        for batch in batches:
            weight = batch.column("weight").to_numpy()
            langs = np.array([code.setdefault(x, len(code)) for x in batch.column("lang").to_pylist()], np.int32)
            for g in _grams(batch, tuple(range(1, longest + 1))):
                bits, k = sent.value
                some = np.flatnonzero(has_bit(bits, _place(g.keys, k)))
                if not buffers or buffers[-1] is not g.buffer:
                    buffers.append(g.buffer)
                rows, like = g.rows[some], np.ones(len(some), np.int32)
                kept.append((g.keys[some], weight[rows], like * g.n, langs[rows], like * (len(buffers) - 1), g.start[some], g.end[some]))
                size += len(some)
            if size > AT_ONCE:
                yield out()
                kept, buffers, size = [], [], 0
        if kept:
            yield out()

    each = chunks.mapInArrow(run, "lang string, phrase binary, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return each.where(F.col("f") >= least).withColumn("phrase", F.col("phrase").cast("string"))


def _part(phrase: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def score(found: DataFrame, totals: DataFrame, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The first `top` candidates of each language: lang, rank, phrase, a, l, r, n, score."""
    of = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))  # noqa: E731
    candidates = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    halves = candidates.select("*", k).select("*", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _part(F.col("phrase"), F.col("k") + 1, F.col("size")).alias("right"))
    whole = lambda c: f"cast({c} as decimal(19,0))"  # noqa: E731
    value = F.expr(f"cast({whole('a')} * {whole('a')} * 1000000 div ({whole('l')} * {whole('r')}) as bigint)")
    cuts_ = halves.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", value)
    best = cuts_.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # parts of two words and more of longer candidates
    spans = F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> struct(i, m))))")).alias("s")
    parts = candidates.where("size > 2").select("lang", "a", "phrase", spans).select("lang", _part(F.col("phrase"), F.col("s.i"), F.col("s.m")).alias("phrase"), F.col("a").alias("b"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"b IS NULL OR 100 * b < {inside} * a").select("lang", "phrase", "a", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    kept = kept.withColumn("i", F.row_number().over(first)).where(F.col("i") <= top)  # PARTS * top a language at most
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, modulus: int = MODULUS, limit: int = LIMIT) -> DataFrame:
    """The collocations of docs (lang, text): see `score`."""
    chunks = cut(parse(docs, longest, modulus, limit), "chunks")
    held = frequent(chunks, longest, least)
    found = cut(phrases(chunks, held, longest, least), "phrases")
    totals = cut(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("weight")).alias("n")), "totals")
    drop(chunks)
    return score(found, totals, longest, inside, top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, s, w[i : i + s - 1] AS v FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS x(s))),
f AS (SELECT lang, s, v, count(*)::HUGEINT AS a FROM g GROUP BY lang, s, v HAVING count(*) >= 10),
c AS (SELECT lang, s, v, a, unnest(range(1, s)) AS k FROM f WHERE s > 1),
cuts AS (SELECT c.*, l.a AS l, r.a AS r, 1000000 * c.a * c.a // (l.a * r.a) AS score FROM c JOIN f l ON c.lang = l.lang AND c.v[:c.k] = l.v JOIN f r ON c.lang = r.lang AND c.v[c.k + 1:] = r.v),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, v ORDER BY score, k) = 1),
longer AS (SELECT lang, v, max(a) AS b FROM (SELECT lang, v[1:2] AS v, a FROM f WHERE s = 3 UNION ALL SELECT lang, v[2:3], a FROM f WHERE s = 3) GROUP BY lang, v),
kept AS (SELECT best.*, array_to_string(best.v, ' ') AS phrase FROM best LEFT JOIN longer ON best.s = 2 AND best.lang = longer.lang AND best.v = longer.v WHERE b IS NULL OR 100 * b < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
