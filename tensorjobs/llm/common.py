"""Shared helpers of the subpackage: words, hashes, scratch tables, bounded bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
#: Words that a worker keeps hashes of (about 100 MB); the frequent ones are met first. It only saves time.
CACHE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(text: Column) -> Column:
    """The words of a text as an array, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body refers to it.

    A column of its own would not do: filters pushed down replace names by expressions, also inside
    lambdas, which would compute an array anew for each of its elements.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of df have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local master may do without: then a new folder is taken."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later steps neither recompute nor depend on lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/tensorjobs/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from `cut` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class WordHash(dict):
    """64-bit hash of a word (bytes); the first CACHE words are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


@lru_cache(maxsize=4)
def word_hash(kind: type = WordHash) -> WordHash:
    """One for all tasks of a worker."""
    return kind()


def word_hashes(cache: WordHash, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


#: Bytes that are hashed at once; a block and its temporary arrays stay in the processor's cache.
BLOCK = 1 << 16
SPACE_BYTES = b" \t\n\v\f\r"
_random = np.random.default_rng(20240229)
_RADIX = int(_random.integers(1, 1 << 62)) * 2 + 1
_EXACT = _random.integers(1, 1 << 63, 256, np.uint64)
_SMALL = _EXACT.copy()
_SMALL[65:91] = _EXACT[97:123]
_WORD = np.ones(256, bool)
_WORD[list(SPACE_BYTES)] = False


@lru_cache(maxsize=64)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _hash_block(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of at most BLOCK + 1 bytes: sums of random values of the bytes times powers of an odd radix."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(_RADIX, BLOCK + 2)[: len(data)], out=total[1:])
    return (total[end] - total[start]) * powers(pow(_RADIX, -1, 1 << 64), BLOCK + 2)[start], start, end


def _hash_long(word: bytes, values: np.ndarray) -> int:
    """The same hash of one word, piece by piece."""
    h, up = 0, powers(_RADIX, BLOCK + 2)
    for lo in range(0, len(word), BLOCK):
        part = np.frombuffer(word, np.uint8, min(BLOCK, len(word) - lo), lo)
        h += int((values[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_RADIX, lo, 1 << 64)
    return h & ((1 << 64) - 1)


def word_places(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text of any length, block by block; blocks end at white space."""
    values = _SMALL if lower else _EXACT
    out, lo = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while lo < len(text):
        hi = min(lo + BLOCK, len(text))
        if hi < len(text):
            hi = max(text.rfind(c, lo, hi) for c in (SPACE_BYTES[i : i + 1] for i in range(6))) + 1
            if hi <= lo:  # a word longer than a block
                hi = min((x for x in (text.find(SPACE_BYTES[i : i + 1], lo + BLOCK) for i in range(6)) if x >= 0), default=len(text))
                out.append((np.array([_hash_long(text[lo:hi], values)], np.uint64), np.array([lo]), np.array([hi])))
                lo = hi
                continue
        h, start, end = _hash_block(np.frombuffer(text, np.uint8, hi - lo, lo), values)
        out.append((h, start + lo, end + lo))
        lo = hi
    h, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, start, end


def word_arrays(texts: Iterable[bytes | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words (runs of other than ASCII white space), in order; A-Z like a-z if asked for.

    Many short texts are hashed at once, long ones block by block; nothing is done word by word.
    """
    values = _SMALL if lower else _EXACT
    held: list[bytes] = []
    size = 0

    def out() -> Iterator[np.ndarray]:
        h, start, _ = _hash_block(np.frombuffer(b" ".join(held), np.uint8), values)
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(h, np.searchsorted(start, ends[:-1]))

    for text in texts:
        text = text or b""
        if held and size + len(text) > BLOCK:
            yield from out()
            held, size = [], 0
        if len(text) > BLOCK:
            yield word_places(text, lower)[0]
            continue
        held.append(text)
        size += len(text) + 1
    if held:
        yield from out()


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges start[i] .. start[i] + length[i] - 1, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    acc = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
        return mix(acc)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def each_text(batch: pa.RecordBatch, step: int = 200) -> Iterator[bytes | None]:
    """The texts of a batch one by one; only `step` of them are copied at a time."""
    for lo in range(0, batch.num_rows, step):
        yield from texts_of(batch.slice(lo, step))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def bitmap(keys: DataFrame, at: Column, bits: int = 25) -> np.ndarray:
    """Which places `at` (a non-negative long below 2**bits) occur: a filter of fixed size, 4 MB for 25 bits.

    Each of the 2**bits / 32768 rows that reach the driver holds 4 KB, whatever the number of keys.
    """
    rows = (
        keys.select((at + 1).alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at0 = (r["bucket"] - 1) * 4096
        out[at0 : at0 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
