"""Tensor text files as a data source: spark.read.format("named_tensors").load(path) and df.write.format("named_tensors").

Lines are '@name shape=2,3 dtype=f64 data=1,2,..', as for `files.read_named_tensors`. Files are split at SPLIT bytes; a line belongs to the split it begins
in. Comparisons of the name with values are pushed down, so other tensors' values are never taken apart. Each task writes a file of its own
under a hidden name; the commit gives them their names, an abort removes them. What a task writes that outlives its job stays hidden, so readers never see it.

The files are opened by path on executors, so they must lie on a file system that all machines mount; for object stores use `files`.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, dtype string, shape array<int>, data array<double>, file string, at long"
SPLIT = 64 << 20
_LINE = re.compile(rb"@(\S+)")


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str | None


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _files(path: str) -> Iterator[str]:
    if os.path.isfile(path):
        yield path
        return
    for top, folders, names in os.walk(path):
        folders[:] = sorted(d for d in folders if d[0] not in "._")
        yield from (os.path.join(top, n) for n in sorted(names) if n[0] not in "._")


def parse(line: bytes) -> tuple[str, str, list[int], list[float]] | None:
    """(name, dtype, shape, data) of a line; None for blank lines, comments and lines without a name or with a shape or value that is no number."""
    line = line.strip()
    named = _LINE.match(line)
    if not named:
        return None
    text = line.decode("utf-8", "replace")
    get = lambda key: (m[1] if (m := re.search(rf"(?<!\S){key}=(\S*)", text)) else "")
    dtype = {"f64": "f64", "F64": "f64", "double": "f64", "i32": "i32", "I32": "i32", "int": "i32"}.get(get("dtype"), "f32")
    try:
        shape = [int(x) for x in get("shape").split(",")]
        data = [float(x) for x in get("data").split(",") if x]
    except ValueError:
        return None
    size = 1
    for n in shape:
        size *= n
    data = (data + [0.0] * (size - len(data)))[:size]
    if dtype == "i32":
        data = [float(int(x)) for x in data]
    elif dtype == "f32":
        import numpy as np

        data = np.asarray(data, np.float32).astype(float).tolist()
    return named[1].decode("utf-8", "replace"), dtype, shape, data


class NamedTensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(_local(self.options["path"]), int(self.options.get("split", SPLIT)), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        lacking = {"name", "dtype", "shape", "data"} - set(schema.names)
        if lacking:
            raise ValueError(f"columns {sorted(lacking)} are missing")
        return TensorWriter(_local(self.options["path"]), overwrite)


class TensorReader(DataSourceReader):
    def __init__(self, path: str, split: int, columns: list[str]) -> None:
        self.path, self.split, self.columns, self.names = path, split, columns, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif not (isinstance(f, IsNotNull) and f.attribute == ("name",)):  # a line without a name is no tensor
                yield f

    def partitions(self) -> list[Split]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        return [Split(f, lo, min(lo + self.split, os.path.getsize(f))) for f in _files(self.path) for lo in range(0, os.path.getsize(f), self.split)]

    def read(self, part: Split) -> Iterator[tuple]:
        wanted = None if self.names is None else {n.encode() for n in self.names if n is not None}
        with open(part.path, "rb") as f:
            at = part.begin
            if at:  # the line that the split begins in is the last one's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                here, at = at, at + len(line)
                named = _LINE.match(line.strip())
                if named and (wanted is None or named[1] in wanted) and (found := parse(line)):
                    yield (*found, part.path, here)


class TensorWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        hidden, held = None, None
        for r in rows:
            if held is None:
                name = f"part-{uuid.uuid4().hex}.nml.data"
                os.makedirs(self.path, exist_ok=True)
                hidden = os.path.join(self.path, f".{self.run}-{name}")
                held = open(hidden, "w", encoding="utf-8")  # noqa: SIM115  closed below
            number = {"i32": lambda x: str(int(x)), "f32": lambda x: repr(float(x))}.get(r["dtype"], lambda x: repr(float(x)))
            held.write(f"@{r['name']} shape={','.join(map(str, r['shape']))} dtype={r['dtype']} data={','.join(map(number, r['data']))}\n")
        if held is None:
            return Written(None, None)
        held.close()
        return Written(hidden, os.path.join(self.path, name))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m and m.hidden]
        if self.overwrite and os.path.isdir(self.path):
            for f in list(_files(self.path)):
                os.remove(f)
        for m in done:
            os.replace(m.hidden, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.isdir(self.path):
            for f in os.listdir(self.path):
                if f.startswith(f".{self.run}-"):
                    os.remove(os.path.join(self.path, f))


def register(spark: SparkSession) -> None:
    """Make the format known, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NamedTensors)


def load_named_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, dtype, shape, data) as `files.read_named_tensors`: of a name given twice the later line holds, by file, then place."""
    register(spark)
    rows = spark.read.format("named_tensors").load(path)
    return rows.groupBy("name").agg(F.max_by(F.struct("dtype", "shape", "data"), F.struct("file", "at")).alias("t")).select("name", "t.*")
