"""Substring dedup by super-k-mers: runs of windows with one minimiser travel as one string to its bucket.

A window is WINDOW consecutive words. Its minimiser is the least hash among its grams of GRAM words, so
equal windows share it wherever they stand. Passes over the texts:

1. `census`: per minimiser, the documents and distinct super-k-mers it has. Minimisers of one document
   need no further work; two bitmaps of fixed size keep that knowledge (false positives only add work).
2. Super-k-mers of shared minimisers go to buckets, equal ones combined before the shuffle. In a bucket
   the windows of the distinct strings are sorted exactly (`window_ids`): each gets the smallest document that has it.
3. Each occurrence learns which of its windows start in an earlier document; covered words go. Texts that lose
   nothing are not shuffled: a bitmap of fixed size tells most of them from the others.

A bucket with more than HOT distinct strings would be too much for one task: its super-k-mers are broken
into single windows under a 128-bit hash, each a bucket of its own. Super-k-mers are told apart by a 128-bit hash
of their words' 64-bit hashes; all hashes are computed for whole texts at once.

Defined results: a null or blank text has no words and keeps none (the hash of an empty text); rows
that repeat a document's id and text are judged alike and never against each other; a row without id
keeps all its words and removes none; texts and words of any length are taken whole; columns other than doc_id and
text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, gram_hashes, has_bit, mix, powers, ragged, runs, table, texts_of, word_arrays

WINDOW = 50
GRAM = 8
#: Windows in a super-k-mer at most; longer runs of one minimiser (repeated phrases) are cut.
LONGEST = 64
#: Distinct super-k-mers of a minimiser that one task takes.
HOT = 2_000
BITS, KEY_BITS = 27, 25
#: Bytes of strings whose windows are sorted at once.
AT_ONCE = 4_000_000


def super_kmers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of a text, from its words' hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, span, width = gram_hashes(h, gram), 1, window - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, n))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, left = np.repeat(starts, parts) + at * LONGEST, np.repeat(counts, parts) - at * LONGEST
        counts = np.minimum(left, LONGEST)
    return least[starts], starts, counts


class StringIds:
    """128-bit hashes, as two signed longs, of runs of a text's words, from the words' hashes."""

    RADIX = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, h: np.ndarray) -> None:
        size = max(1024, 1 << len(h).bit_length())
        self.sums, self.down = [], []
        for x, radix in zip((h, mix(h + np.uint64(1))), self.RADIX, strict=True):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * powers(radix, size)[: len(h)], out=total[1:])
            self.sums.append(total)
            self.down.append(powers(pow(radix, -1, 1 << 64), size))

    def __call__(self, start: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p1, p2 = (mix((t[start + n_words] - t[start]) * d[start] + n_words.astype(np.uint64)).view(np.int64) for t, d in zip(self.sums, self.down, strict=True))
        return p1, p2


def _rows(docs: DataFrame, window: int, marks: tuple[np.ndarray, np.ndarray, np.ndarray] | None, packed: bool) -> DataFrame:
    """A row per super-k-mer: mini, p1, p2 (hash of its string), doc_id, text_key, start, n[, packed].

    With `marks` (bitmaps of shared, several-string and hot minimisers) only those of shared ones; those
    of hot ones as single windows, each with its own hash as minimiser.
    """
    names = ["mini", "p1", "p2", "doc_id", "text_key", "start", "n"] + ["packed"] * packed
    schema = "mini long, p1 long, p2 long, doc_id long, text_key long, start int, n int" + ", packed binary" * packed
    types = [pa.int64()] * 5 + [pa.int32()] * 2
    sent = docs.sparkSession.sparkContext.broadcast(marks) if marks is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch)
            held: list[list[np.ndarray]] = []
            strings: list[bytes | None] = []
            size = 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays(columns + [pa.array(strings, pa.binary())] * packed, names)

            for doc_id, key, text, h in zip(ids, keys, texts, word_arrays(texts), strict=True):
                if len(h) < window:
                    continue
                minis, starts, counts = super_kmers(h, window)
                several = np.zeros(len(minis), bool)
                if sent is not None:
                    at = (minis & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    shared, several, hot = (has_bit(b, at) for b in sent.value)
                    keep = np.flatnonzero(shared)
                    if not len(keep):
                        continue
                    minis, starts, counts, several, hot = minis[keep], starts[keep], counts[keep], several[keep], hot[keep]
                    if hot.any():  # these as single windows
                        single = ragged(starts[hot], counts[hot])
                        minis, several = np.concatenate([minis[~hot], np.zeros(len(single), np.uint64)]), np.concatenate([several[~hot], np.zeros(len(single), bool)])
                        starts, counts = np.concatenate([starts[~hot], single]), np.concatenate([counts[~hot], np.ones(len(single), np.int64)])
                p1, p2 = StringIds(h)(starts, counts + window - 1)
                minis = np.where(minis == 0, p1, minis.view(np.int64))
                held.append([minis, p1, p2, np.full(len(minis), doc_id), np.full(len(minis), key), starts, counts])
                if packed:
                    words = text.split() if several.any() else []
                    strings += [b" ".join(words[s : s + c + window - 1]) if many else None for s, c, many in zip(starts.tolist(), counts.tolist(), several.tolist(), strict=True)]
                size += len(minis)
                if size > 20_000:
                    yield out()
                    held, strings, size = [], [], 0
            if held:
                yield out()

    return docs.mapInArrow(run, schema)


def window_ids(strings: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(id of each window of the strings, windows per string): equal windows have equal ids, told apart by their words.

    Words are numbered, then runs of two, four, ... words by sorting pairs of numbers; a window is two runs that overlap.
    """
    number: dict[bytes, int] = {}
    words = [s.split(b" ") for s in strings]
    counts = np.array([len(w) - window + 1 for w in words])
    now = np.fromiter((number.setdefault(w, len(number)) for some in words for w in some), np.int64)
    span = 1
    while span < window:
        step = min(span, window - span)
        now = np.unique(now[:-step] * (int(now.max()) + 1) + now[step:], return_inverse=True)[1]
        span += step
    start = np.cumsum(counts + window - 1) - (counts + window - 1)
    return now[ragged(start, counts)], counts


def _first_documents(strings: DataFrame, window: int) -> DataFrame:
    """(p1, p2, first): per window of each distinct string, the smallest document of its bucket that has it."""

    def matched(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """Equal windows have equal minimisers, so whole buckets can be sorted together."""
        rows = pa.Table.from_batches(parts)
        ids, counts = window_ids(rows["packed"].to_pylist(), window)
        first, last = np.repeat(rows["first_doc"].to_numpy(), counts), np.repeat(rows["last_doc"].to_numpy(), counts)
        least = np.full(ids.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, ids, first)
        of = least[ids]
        offsets = np.append(0, np.cumsum(counts))
        some = np.logical_or.reduceat(of < last, offsets[:-1])
        if not some.any():
            return None
        kept = counts[some]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(of[np.repeat(some, counts)]))
        return pa.RecordBatch.from_arrays([pa.array(rows["p1"].to_numpy()[some]), pa.array(rows["p2"].to_numpy()[some]), lists], ["p1", "p2", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for _, parts in runs(batches, ["mini"]):
            held += parts
            size += sum(len(x) for p in parts for x in p.column("packed").to_pylist())
            if size > AT_ONCE:
                out = matched(held)
                held, size = [], 0
                if out is not None:
                    yield out
        if held and (out := matched(held)) is not None:
            yield out

    return strings.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "p1 long, p2 long, first array<long>")


def removals(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, starts): a document's windows that also start in a document with a smaller id.

    docs: doc_id, text, text_key (a hash of the text, so that rows with one id stay apart).
    """
    docs = docs.where("doc_id IS NOT NULL")
    census = (
        _rows(docs, window, None, packed=False)
        .groupBy("mini", "p1")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .groupBy("mini")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))
        .where("a < b")
        .select(F.col("mini").bitwiseAND(F.lit((1 << BITS) - 1)).alias("at"), "n")
    )
    census = cut(census, "minimisers")
    at = F.col("at").cast("long")
    marks = tuple(bitmap(x, at, BITS) for x in (census, census.where("n > 1"), census.where(F.col("n") > hot)))
    strings = (
        _rows(docs, window, marks, packed=True)
        .groupBy("mini", "p1", "p2")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("n").alias("n"), F.max("packed").alias("packed"))
        .where("first_doc < last_doc OR packed IS NOT NULL")
    )
    strings = cut(strings, "super-k-mers")
    alone = strings.where("packed IS NULL").select("p1", "p2", F.expr("array_repeat(first_doc, n)").alias("first"))
    first = alone.unionByName(_first_documents(strings.where("packed IS NOT NULL"), window))
    found = _rows(docs, window, marks, packed=False).join(first, ["p1", "p2"])
    earlier = F.filter(F.transform("first", lambda d, j: F.when(d < F.col("doc_id"), F.col("start") + j)), lambda x: x.isNotNull())
    return (
        found.select("doc_id", "text_key", earlier.alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))  # within one document
    )


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and kept_text if asked for."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    removed = cut(removals(docs, window, hot), "removals")
    at = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << KEY_BITS))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(removed, at, KEY_BITS))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def kept(batch: pa.RecordBatch, starts_of) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, text, starts in zip(batch.column("doc_id").to_pylist(), texts_of(batch), starts_of, strict=True):
            words = (text or b"").split()
            n, gone = len(words), 0
            if starts is not None and starts.is_valid:
                edge = np.zeros(n + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                edge[at] += 1
                edge[at + window] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                gone = n - int(stay.sum())
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            joined = b" ".join(words)
            out.append((doc_id, n, gone, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace"))[: len(names)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        return has_bit(bits.value, batch.column("at").to_numpy())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~marked(batch)))
            yield from kept(some, [None] * some.num_rows)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch))).select(["doc_id", "text_key", "text"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kept(batch, batch.column("starts"))

    placed = docs.withColumn("at", at)
    hit = placed.select("doc_id", "text_key", "text", "at").mapInArrow(some, "doc_id long, text_key long, text string")
    hit = hit.join(removed, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts").mapInArrow(cut_out, schema)
    return placed.select("doc_id", "text", "at").mapInArrow(whole, schema).unionByName(hit)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM hit),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n FROM word LEFT JOIN gone ON word.rid = gone.rid AND word.p = gone.p GROUP BY word.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
