"""Tensors as rows: coordinate (i, j, v), row-vector (id, features) and packed (shape, data), and their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_to_coordinates(df: DataFrame, row: str = "i", features: str = "features") -> DataFrame:
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(features).alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def coordinates_to_rows(m: DataFrame) -> DataFrame:
    """(i, features), features in the order of j; one matrix row is one array."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("features"))


def packed_to_coordinates(t: DataFrame) -> DataFrame:
    """(name, i, j, v) of packed tensors of one or two dimensions."""
    cols = F.element_at("shape", -1)
    return t.select("name", cols.alias("c"), F.posexplode("data").alias("p", "v")).select("name", F.expr("p div c").alias("i"), (F.col("p") % F.col("c")).cast("long").alias("j"), "v")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(m: DataFrame, cols: int, new_rows: int, new_cols: int, rows: int) -> DataFrame:
    """The same flat order in another shape; sizes that differ are an error."""
    if rows * cols != new_rows * new_cols:
        raise ValueError("the shapes hold different numbers of elements")
    p = F.col("i") * cols + F.col("j")
    return m.select(F.floor(p / new_cols).cast("long").alias("i"), (p % new_cols).cast("long").alias("j"), "v")


def split(m: DataFrame, dim: int, at: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Two parts along rows (dim 0) or columns (1), the second counted from 0 again."""
    if not 0 < at < size:
        raise ValueError("the split is out of range")
    axis = "ij"[dim]
    return m.where(F.col(axis) < at), m.where(F.col(axis) >= at).withColumn(axis, F.col(axis) - at)


def merge(a: DataFrame, b: DataFrame, dim: int, size: int) -> DataFrame:
    """b after a along a dimension of which a has `size`."""
    axis = "ij"[dim]
    return a.unionByName(b.withColumn(axis, F.col(axis) + size))


def gather(src: DataFrame, idx: DataFrame, strict: bool = True) -> DataFrame:
    """(pos, v) = src[idx]: src(i, v), idx(pos, i). A missing index is an error, or null if not strict."""
    out = idx.join(src.withColumn("_found", F.lit(True)), "i", "left")
    missing = F.raise_error(F.concat(F.lit("index out of bounds: "), F.col("i").cast("string"))).cast("double")
    return out.select("pos", F.when(F.col("_found"), F.col("v")).otherwise(missing if strict else F.lit(None)).alias("v"))


def scatter(dst: DataFrame, updates: DataFrame) -> DataFrame:
    """dst(i, v) with updates(i, pos, v) applied; of several updates of a place the last by pos holds."""
    last = updates.groupBy("i").agg(F.max_by("v", "pos").alias("new"), F.lit(True).alias("hit"))
    return dst.join(last, "i", "left").select("i", F.when(F.col("hit"), F.col("new")).otherwise(F.col("v")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinate product: join on the inner index, sum per cell. For sparse or moderate matrices."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    y = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matmul_small(features: Column, matrix: list[list[float]]) -> Column:
    """Row-vector times a small constant matrix, as an expression (no shuffle, no Python)."""
    columns = list(zip(*matrix, strict=True))
    return F.array(*[dot(features, F.array(*[F.lit(float(x)) for x in c])) for c in columns])


def matmul_blocked(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """Dense product by blocks: coordinates packed into block x block tiles, tiles joined on the inner block, multiplied by numpy, summed per tile cell."""
    import numpy as np
    import pandas as pd

    def tiles(m: DataFrame, r: str, c: str, name: str) -> DataFrame:
        at = ((F.col("i") % block) * block + F.col("j") % block).cast("int")
        cells = m.where("v IS NOT NULL").groupBy(F.floor(F.col("i") / block).alias(r), F.floor(F.col("j") / block).alias(c)).agg(F.collect_list(F.struct(at.alias("at"), F.col("v").cast("double").alias("v"))).alias("_c"))
        return cells.select(r, c, F.struct(F.col("_c.at").alias("at"), F.col("_c.v").alias("v")).alias(name))

    def run(frames):
        for pdf in frames:
            out = []
            for r, c, left, right in zip(pdf.r, pdf.c, pdf.left, pdf.right, strict=True):
                x, y = np.zeros((block, block)), np.zeros((block, block))
                for m, cells in ((x, left), (y, right)):
                    m.ravel()[np.asarray(cells["at"])] = cells["v"]
                i, j = np.nonzero((x != 0).any(1)[:, None] & (y != 0).any(0)[None, :])
                out.append(pd.DataFrame({"i": r * block + i, "j": c * block + j, "v": (x @ y)[i, j]}))
            if out:
                yield pd.concat(out)

    pairs = tiles(a, "r", "k", "left").join(tiles(b, "k", "c", "right"), "k").select("r", "c", "left", "right")
    return pairs.mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def dot(a: Column, b: Column) -> Column:
    """Over a's length."""
    return F.aggregate(F.transform(a, lambda x, i: x.cast("double") * F.get(b, i).cast("double")), F.lit(0.0), lambda s, x: s + x)
