"""Scores by a class-based bigram model (Brown et al.): exchange clustering, then class transitions and word emissions.

P(text) is the product over tokens of P(class | class before) * P(word | class); a text starts after an end
token. Classes are found in two steps. The SEEDS most frequent words get theirs by exchange on the driver: each in turn
moves to the class that raises the likelihood of the class bigrams most. Each other word of the head (the HEAD most
frequent words) then moves, on Spark, to the class of largest gain given the classes around its occurrences in the whole
corpus. Transitions between classes are counted over the whole corpus afterwards. Words beyond the head share a tail
class, in which they are told apart by their own counts, so every token's exact count in the corpus is used.

Passes over the texts: word counts (whole corpus, one row per word), bigrams of seeds (at most (SEEDS + 2)**2
rows), classes around head words (at most HEAD x 2 (CLASSES + 2) rows), class transitions, scores. The head travels in a
broadcast of bounded size; counts of rarer words are joined to the documents that use them.

Defined results: a null or empty text is one end token; rows that repeat an id are scored and learned one by
one; a null id is learned from and not held out; without any training text all counts are 0; equally frequent words
are taken in the order of their bytes; texts and words of any length are taken whole; kept columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE, crc_mod, cut, table, texts_of, unused

SEEDS, CLASSES = 1_500, 48
HEAD = 150_000
SWEEPS = 4
#: Added to each class transition, and to each word of a class (the unknown word among them).
ADD_CLASS, ADD_WORD = 0.5, 1.0
END = ""  # no word is empty


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), b""]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, the end token as ''. Tasks count in bounded tables before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
            count.clear()
            return batch

        for batch in batches:
            for text in texts_of(batch):
                count.update(tokens_of(text))
                if len(count) > 2 * CACHE:
                    yield out()
        if count:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Ranks(dict):
    """Number of a word in the head (by descending count), -1 outside; words not in it are not stored."""

    def __missing__(self, word: bytes) -> int:
        return -1


def bigrams(docs: DataFrame, ranks, clustered: int) -> DataFrame:
    """(pair, n): neighbours as first * (clustered + 2) + second, from numbers of the seeds; clustered is the tail, + 1 the end."""
    width = clustered + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Ranks({w: i for i, w in enumerate(ranks.value[0][:clustered])})
        number[b""] = clustered + 1
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                tokens = tokens_of(text)
                at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                at[at < 0] = clustered
                before = np.concatenate([[clustered + 1], at[:-1]])
                np.add.at(total, before * width + at, 1)
        found = np.flatnonzero(total)
        for lo in range(0, len(found), 50_000):
            some = found[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word from the counts pairs[w, v] of v after w: greedy exchange of single words.

    Maximises sum over classes of N(a, b) log N(a, b) - N(a) log N(a) - N(b) log N(b), which is the
    likelihood of the class bigrams up to a constant. The last two rows (tail and end) keep classes of their own.
    """
    n = len(pairs)
    movable = n - 2
    k = max(1, min(classes, movable))
    cls = np.append(np.arange(movable) % k, [k, k + 1])
    size = k + 2
    xlog = lambda x: x * np.log(np.maximum(x, 1))
    pairs = pairs.astype(float)
    for _ in range(sweeps):
        moved = 0
        onehot = np.zeros((n, size))
        onehot[np.arange(n), cls] = 1
        follows, precedes = pairs @ onehot, pairs.T @ onehot  # per word: counts by class after and before it
        table_ = onehot.T @ follows
        rows, cols = table_.sum(1), table_.sum(0)
        for w in range(movable):
            old, self_ = cls[w], pairs[w, w]
            out, inn = follows[w].copy(), precedes[w].copy()
            out[old] -= self_
            inn[old] -= self_
            o, i = pairs[w].sum(), pairs[:, w].sum()
            # without the word
            t = table_
            t[old] -= out
            t[:, old] -= inn
            t[old, old] -= self_
            rows[old] -= o
            cols[old] -= i
            # gain of adding it to each class
            gain = (xlog(t + out) - xlog(t)).sum(1) + (xlog(t + inn[:, None]) - xlog(t)).sum(0)
            d = t.diagonal()
            gain += xlog(d + out + inn + self_) - xlog(d + out) - xlog(d + inn) + xlog(d)
            gain -= xlog(rows + o) - xlog(rows) + xlog(cols + i) - xlog(cols)
            new = int(np.argmax(gain[:k]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            t[new] += out
            t[:, new] += inn
            t[new, new] += self_
            rows[new] += o
            cols[new] += i
            if new != old:
                moved += 1
                cls[w] = new
                follows[:, old] -= pairs[:, w]
                follows[:, new] += pairs[:, w]
                precedes[:, old] -= pairs[w]
                precedes[:, new] += pairs[w]
        if not moved:
            break
    return cls


def numbers(words: list[bytes]) -> Ranks:
    """Places of the head's words; the end has the place after the last."""
    out = Ranks({w: i for i, w in enumerate(words)})
    out[b""] = len(words)
    return out


def surroundings(docs: DataFrame, ranks, cls: np.ndarray, seeds: int, k: int) -> DataFrame:
    """(word, code, n): how often a class comes before (code below k) or after (from k on) each head word that is no seed.

    cls: class of each place of the head, of the end, and of words outside the head (last).
    """
    sent = docs.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks.value[0]
        number, h = numbers(words), len(words)
        total = np.zeros((max(h - seeds, 1), 2 * k), np.int32)
        for batch in batches:
            for text in texts_of(batch):
                tokens = tokens_of(text)
                at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                of = sent.value[at]
                i = np.flatnonzero((at >= seeds) & (at < h))
                np.add.at(total, (at[i] - seeds, np.append(of[-1], of[:-1])[i]), 1)  # the last token, the end, is what a text starts after
                np.add.at(total, (at[i] - seeds, k + of[i + 1]), 1)
        w, code = np.nonzero(total)
        for lo in range(0, len(w), 100_000):
            a, b = w[lo : lo + 100_000], code[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a + seeds), pa.array(b), pa.array(total[a, b].astype(np.int64))], ["word", "code", "n"])

    return docs.select("text").mapInArrow(run, "word long, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def assigned(around: DataFrame, affinity: np.ndarray, movable: int) -> DataFrame:
    """(word, class): the class of largest gain in log-likelihood, from how much more often than by chance classes follow each other (affinity)."""
    k = len(affinity)
    gains = np.concatenate([affinity, affinity.T])[:, :movable]  # of a class before, then of one after

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"word": [], "code": [], "n": []})])  # at most 2 k rows a word
        words, place = np.unique(rows.word.to_numpy(np.int64), return_inverse=True)
        for lo in range(0, len(words), 50_000):
            some = (place >= lo) & (place < lo + 50_000)
            counts = np.zeros((min(50_000, len(words) - lo), 2 * k))
            np.add.at(counts, (place[some] - lo, rows.code.to_numpy(np.int64)[some]), rows.n.to_numpy(float)[some])
            yield pd.DataFrame({"word": words[lo : lo + 50_000], "class": np.argmax(counts @ gains, axis=1).astype(np.int64)})

    return around.repartition("word").mapInPandas(run, "word long, class long")


def transitions(docs: DataFrame, ranks, cls: np.ndarray, k: int) -> np.ndarray:
    """Counts of each class after each class over all texts: k * k rows at most reach the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = numbers(ranks.value[0]), np.zeros(k * k, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                tokens = tokens_of(text)
                of = sent.value[np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))]
                total += np.bincount(np.append(of[-1], of[:-1]) * k + of, minlength=k * k)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    out = np.zeros(k * k)
    for r in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def most_frequent(counts: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """The words above the least count that at most `head` words reach, and their counts; descending, then by word."""
    sizes = counts.where("word <> ''").groupBy("n").agg(F.count("*").alias("k"))
    reach = Window.orderBy(F.desc("n"))  # a row per distinct count: few
    least = sizes.withColumn("s", F.sum("k").over(reach)).where(F.col("s") <= head).agg(F.min("n")).first()[0]
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where((F.col("word") != "") & (F.col("n") >= least)).toArrow()  # `head` rows at most
    words, n = top["word"].cast(pa.binary()).to_pylist(), top["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order].astype(np.int64)


def train(docs: DataFrame, clustered: int = SEEDS, classes: int = CLASSES, head: int = HEAD) -> tuple[DataFrame, dict]:
    """(word counts, model) of all rows of docs."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, c = most_frequent(counts, head)
    end = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    m = min(clustered, len(words))
    ranks = spark.sparkContext.broadcast((words, c))
    pairs = np.zeros((m + 2) ** 2)
    found = bigrams(docs, ranks, m).toArrow()  # (m + 2) ** 2 rows at most
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(m + 2, m + 2)
    cls = exchange(pairs, classes)
    k = int(cls.max()) + 1
    h, tail, last = len(words), int(cls[m]), int(cls[m + 1])
    onehot = np.zeros((m + 2, k))
    onehot[np.arange(m + 2), cls] = 1
    seen = onehot.T @ pairs @ onehot + ADD_CLASS
    affinity = np.log(seen * seen.sum() / seen.sum(1, keepdims=True) / seen.sum(0, keepdims=True))
    full = np.concatenate([cls[:m], np.full(h - m, tail), [last, tail]]).astype(np.int64)  # by place; the end, then the rest
    if h > m:
        for r in assigned(surroundings(docs, ranks, full, m, k), affinity, max(1, k - 2)).collect():  # a row per head word
            full[r["word"]] = r["class"]
    counted = transitions(docs, ranks, full, k) + ADD_CLASS
    log_next = np.log10(counted / counted.sum(1, keepdims=True))
    mass = np.bincount(full, np.concatenate([c, [end, 0]]), k)
    mass[tail] += total - mass.sum()
    number = np.bincount(full, np.concatenate([np.ones(h), [1, 0]]), k)
    number[tail] += kinds - h - (1 if end else 0) + 1  # and the unknown word
    log_room = np.log10(np.maximum(mass + ADD_WORD * number, 1e-300))
    return counts, {"words": words, "counts": c, "end": int(end), "total": int(total), "kinds": int(kinds), "cls": full, "tail": tail, "log_next": log_next, "log_room": log_room}


def score(docs: DataFrame, counts: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns `keep`, n_tokens, n_known, train_tokens, base_score and score (log10) of each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    names = [*(f"keep{i}" for i in range(len(keep))), "row", "n_tokens", "n_head", "base", "own", "rare"]
    back = [F.col(f"keep{i}").alias(k) for i, k in enumerate(keep)]
    row = unused(docs, "row")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words, h = m["words"], len(m["words"])
        number = numbers(words)
        n = np.append(m["counts"], m["end"])
        base = np.log10((n + 1) / (m["total"] + m["kinds"] + 1))
        cls = m["cls"]
        emit = np.log10(n + ADD_WORD) - m["log_room"][cls[: h + 1]]
        base, emit = np.append(base, 0.0), np.append(emit, 0.0)  # place -1: words outside the head
        known = np.append(n > 0, False)
        for batch in batches:
            texts = texts_of(batch)
            for lo in range(0, len(texts), 500):
                some = batch.slice(lo, 500)
                cols: list[list] = [[], [], [], [], []]
                for text in texts[lo : lo + 500]:
                    tokens = tokens_of(text)
                    at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                    c = cls[at]
                    step = m["log_next"][np.concatenate([[cls[h]], c[:-1]]), c].sum()
                    rare = Counter(tokens[i] for i in np.flatnonzero(at < 0).tolist())
                    for col, x in zip(cols, (len(tokens), int(known[at].sum()), float(base[at].sum()), float(emit[at].sum() + step), list(rare.items())), strict=True):
                        col.append(x)
                rare_type = pa.map_(pa.string(), pa.int64())
                rare = pa.array([[(w.decode("utf-8", "replace"), k) for w, k in r] for r in cols[4]], rare_type)
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keep), some.column(row), *(pa.array(c, t) for c, t in zip(cols[:4], (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), rare], names)

    fields = "".join(f"keep{i} {kinds[k]}, " for i, k in enumerate(keep))
    schema = f"{fields}row long, n_tokens long, n_head long, base double, own double, rare map<string,bigint>"
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn(row, F.monotonically_increasing_id())
    rows = cut(rows.mapInArrow(run, schema), "token-scores")
    rare = rows.select("row", F.explode("rare").alias("word", "k"))
    total = model["total"] + model["kinds"] + 1
    one = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total)))
    own = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD_WORD)) - F.lit(float(model["log_room"][model["tail"]]))
    tails = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("k") * one).alias("t_base"), F.sum(F.col("k") * own).alias("t_own"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("t_known"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("rare").join(tails, "row", "left").select(
        *back,
        "n_tokens",
        (F.col("n_head") + zero("t_known")).alias("n_known"),
        F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base")).alias("base_score"),
        (F.col("own") + zero("t_own")).alias("score"),
    )


def perplexity(log10_score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -log10_score / n_tokens)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    counts, model = train(docs.where(~out))
    scored = score(docs, counts, model, "doc_id")
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
