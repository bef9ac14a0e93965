"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut into pieces whose lengths are the powers of two in n (largest first,
at most `longest`; longer documents give several of that length). Each piece is a whole sequence;
sequences of one length form a bucket, from which batches of equal shape are drawn.

The tokenizer file must lower letters, drop white space and part letters from marks, as `word_bpe_49k.json` does; another
kind is refused. The id that ends a document is END.

Defined results: a null or empty text is one end token; repeated rows give their pieces again, with
sequence ids of their own; a null id stays null; texts of any length are taken whole; columns other than doc_id and
text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, table, texts_of, word_places

SEQUENCE, END = 2048, 1
#: Runs that a worker keeps (about 200 MB); the frequent ones are met first.
KEPT = 1_000_000
_LETTER, _MARK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(string.ascii_lowercase.encode())] = _LETTER
_KIND[list(string.punctuation.encode())] = _MARK


class WordIds:
    """Token ids of texts, looked up by the 64-bit hashes of their runs of characters without ASCII white space; KEPT runs are kept.

    The tokenizer turns white space into borders no token crosses, so a text's ids are those of its runs.
    """

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.exists(file) else public_tokenizers.path(file))
        self.place: dict[int, int] = {}
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        whole, *parts = self._encoded([b"don't Stop,", b"don", b"'t", b"stop", b","])
        if list(whole) != [i for p in parts for i in p]:
            raise ValueError("the tokenizer must lower letters, drop white space and part letters from marks")

    def _encoded(self, runs: list[bytes]) -> list[array]:
        some = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in runs], add_special_tokens=False)
        return [array("I", e.ids) for e in some]

    def texts(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text with its end; each distinct run is looked up once, new ones are encoded together."""
        data, begins = simplified([t or b"" for t in texts])
        h, start, end = word_places(data)
        distinct, first, run = np.unique(h, return_index=True, return_inverse=True)
        at = np.array([self.place.get(x, -1) for x in distinct.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        found = self._encoded([data[start[i] : end[i]] for i in first[new].tolist()])
        length = np.append(self.length, [len(x) for x in found]).astype(np.int64)
        begin = np.append(self.start, len(self.ids) + np.cumsum(length[len(self.length) :]) - length[len(self.length) :]).astype(np.int64)
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(x.tobytes() for x in found), "<u4")])
        at[new] = len(self.length) + np.arange(len(new))
        if len(self.place) + len(new) <= KEPT:
            self.place.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
            self.start, self.length, self.ids = begin, length, ids
        at = at[run]
        flat, ends = ids[ragged(begin[at], length[at])], np.append(0, np.cumsum(length[at]))
        bounds = ends[np.append(np.searchsorted(start, begins), len(start))].tolist()
        return [np.append(flat[a:b], np.array(END, "<u4")) for a, b in zip(bounds, bounds[1:], strict=False)]


def simplified(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(texts joined by a blank, the place where each begins), with the same ids but fewer distinct runs: ASCII letters small, letters and marks apart.

    The tokenizer itself lowers letters and parts them from marks, but for an apostrophe before them. Texts that hold
    '<|' (special tokens) or combining marks, which could compose with a small letter only, are left as they are.
    """
    as_is = [i for i, t in enumerate(texts) if b"<|" in t or b"\xcc" in t or b"\xcd" in t]
    texts = [t.lower() for t in texts] if not as_is else [t if i in as_is else t.lower() for i, t in enumerate(texts)]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    kind = _KIND[data]
    cuts = np.flatnonzero(kind[1:] + kind[:-1] == _LETTER + _MARK) + 1
    cuts = cuts[data[cuts - 1] != ord("'")]
    if as_is:
        cuts = cuts[~np.isin(np.searchsorted(begins, cuts, "right") - 1, as_is)]
    return np.insert(data, cuts, ord(" ")).tobytes(), begins[:-1] + np.searchsorted(cuts, begins[:-1])


@cache
def word_ids(file: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(file)


def pieces(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, rest = n // longest * longest, n % longest
    while rest:
        size = 1 << rest.bit_length() - 1
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length), and ids if asked for.

    `longest` must be a power of two. tokenizer: a path that the workers have, or a name among the public tokenizers, which
    they look up themselves. A sequence id holds the number of its partition and its place there.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        count = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for lo in range(0, len(texts), 256):
                rows, ids_of = [], []
                for doc_id, ids in zip(doc_ids[lo : lo + 256], words.texts(texts[lo : lo + 256]), strict=True):
                    for start, length in pieces(len(ids), longest):
                        piece = ids[start : start + length]
                        rows.append((doc_id, start, length, zlib.crc32(piece), len(ids), count, 0, length.bit_length() - 1))
                        count += 1
                        if with_ids:
                            ids_of.append(piece.astype(np.int32))
                columns = [pa.array(c, pa.int32() if n == "bucket" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=False)]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, "word_bpe_49k.json")
