"""Element-wise functions over tensor columns: expressions only, no shuffle, no Python in tasks.

An argument may be a numeric column or an array column (a row-major tensor); `each` lifts a scalar
function over both. Arithmetic is in double. Comparisons are IEEE: NaN > 0 is false, although Spark orders NaN
above every number. A null element or argument gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scalar = Callable[[Column], Column]


def each(f: Scalar, array: bool) -> Scalar:
    return (lambda x: F.transform(x, f)) if array else f


def gt(a: Column, b: Column | float) -> Column:
    """a > b as IEEE has it."""
    return ~F.isnan(a.cast("double")) & (a > b)


# ---- arithmetic -------------------------------------------------------------------------------------------------

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(x / y),
    "try_div": lambda x, y: F.try_divide(x, y),
}


def elementwise(a: Column, b: Column, op: str) -> Column:
    """a op b on arrays with a's length; a shorter b is repeated if its length divides a's, else an error."""
    f = _OPS[op]
    fits = (F.size(b) > 0) & (F.size(a) % F.greatest(F.size(b), F.lit(1)) == 0)
    wrong = F.raise_error(F.lit("sizes do not match")).cast("array<double>")
    return F.when(F.size(a) == 0, a).when(fits, F.transform(a, lambda x, i: f(x.cast("double"), F.get(b, i % F.size(b)).cast("double")))).otherwise(wrong)


def broadcast_rows(a: Column, b: Column, cols: Column, op: str) -> Column:
    """A row-major matrix with `cols` columns, combined with a row b of that many values."""
    return F.transform(a, lambda x, i: _OPS[op](x, F.get(b, i % cols)))


def scalar(a: Column, s: Column | float, op: str, array: bool = True) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return each(lambda x: _OPS[op](x.cast("double"), s), array)(a)


def mod(a: Column, b: Column) -> Column:
    """Remainder of the truncated values, with the sign of a; 0 as b is an error."""
    y = b.cast("int")
    return F.when(y == 0, F.raise_error(F.lit("modulo by zero"))).otherwise(a.cast("int") % y)


def ftoi(x: Column) -> Column:
    return x.cast("int")


def itof(x: Column) -> Column:
    return x.cast("double")


def bnot(x: Column) -> Column:
    return F.bitwise_not(x.cast("int"))


# ---- activations ------------------------------------------------------------------------------------------------

#: Fixed values of the tanh form of GELU.
GELU_SCALE = 0.7978845608
GELU_CUBIC = 0.044715


def relu(x: Column) -> Column:
    return F.when(gt(x, 0.0), x.cast("double")).when(x.isNotNull(), F.lit(0.0))


def sigm(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def tanh_act(x: Column) -> Column:
    return F.tanh(x)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + F.tanh(GELU_SCALE * (x + GELU_CUBIC * x * x * x)))


ACTIVATIONS: dict[str, Scalar] = {"relu": relu, "sigm": sigm, "tanh": tanh_act, "gelu": gelu, "linear": lambda x: x}


def act_backward(grad: Column, x: Column, act: str) -> Column:
    """Gradient through an activation at x (scalars)."""
    if act == "relu":
        return F.when(gt(x, 0.0), grad).otherwise(F.lit(0.0))
    if act == "sigm":
        return grad * sigm(x) * (1.0 - sigm(x))
    if act == "tanh":
        return grad * (1.0 - F.tanh(x) * F.tanh(x))
    if act == "gelu":
        t = F.tanh(GELU_SCALE * (x + GELU_CUBIC * x * x * x))
        return grad * (0.5 * (1.0 + t) + 0.5 * x * (1.0 - t * t) * GELU_SCALE * (1.0 + 3.0 * GELU_CUBIC * x * x))
    return grad


# ---- clamp, select, masks ---------------------------------------------------------------------------------------


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """NaN stays."""
    return F.when(F.isnan(x), x).when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def where(cond: Column, a: Column, b: Column | None = None) -> Column:
    return F.when(gt(cond, 0), a).otherwise(a if b is None else b)


def cmpr(x: Column, t: float, op: int) -> Column:
    """0/1 mask: 0 >, 1 <, 2 >=, 3 <=, 4 equal within 1e-6. A NaN compares false."""
    x = x.cast("double")
    tests = [x > t, x < t, x >= t, x <= t, F.abs(x - t) < 1e-6]
    return (~F.isnan(x) & tests[op]).cast("float")


def cmp(a: Column, b: Column) -> Column:
    """a < b, an unset value counting as 0."""
    return F.coalesce(a, F.lit(0)) < F.coalesce(b, F.lit(0))


def cmpf(features: Column, idx: int, t: float) -> Column:
    """features[idx] < t, an index beyond the end reading 0."""
    return F.coalesce(F.get(features, F.lit(idx)), F.lit(0.0)) < t


def decide(score: Column, t: float = 0.5) -> Column:
    return F.when(~F.isnan(score) & (score >= t), 1.0).when(score.isNotNull(), 0.0)


def outside_rate_bounds(rate: Column) -> Column:
    return ~rate.between(0.0, 1.0)


# ---- training helpers -------------------------------------------------------------------------------------------


def dropout(x: Column, p: float, seed: int, *row_id: Column) -> Column:
    """An array with each element zero with probability p, else over 1 - p; the same for the same row, place and seed."""
    if p <= 0:
        return x
    keep = lambda i: F.pmod(F.xxhash64(*row_id, i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24) >= p
    return F.transform(x, lambda v, i: F.when(keep(i), v / (1.0 - p)).otherwise(0.0))


def wdecay(w: Column, rate: float) -> Column:
    return F.transform(w, lambda x: x * (1.0 - rate))


def wupd(w: Column, g: Column, lr: float) -> Column:
    """w - lr * g over the common length."""
    n = F.least(F.size(w), F.size(g))
    return F.zip_with(F.slice(w, 1, n), F.slice(g, 1, n), lambda a, b: a - lr * b)


def output_grad(pred: Column, target: Column, n: Column | int) -> Column:
    return 2.0 * (pred - target) / n


# ---- features ---------------------------------------------------------------------------------------------------


def feature_transform(spec: list[dict]) -> list[Column]:
    """Columns from feature specs: name, source_fields (dot paths), transformation (diff, ratio, absolute), divisor."""
    out = []
    for s in spec:
        a, *rest = [F.col(f) for f in s["source_fields"]]
        kind = s["transformation"]
        x = a - rest[0] if kind == "diff" else F.try_divide(a, rest[0]) if kind == "ratio" else a
        out.append((x / float(s.get("divisor") or 1.0)).alias(s["name"]))
    return out


def augment_negate_flip(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """df and its mirror: features negated, label 1 - label."""
    return df.unionByName(df.withColumns({features: F.transform(features, lambda x: -x), label: 1 - F.col(label)}))


def range_check_divisor(df: DataFrame, spec: list[dict]) -> DataFrame:
    """(name, largest, ok): the largest absolute value of each flagged feature against its expected range; one pass."""
    flagged = [s for s in spec if s.get("flag")]
    row = df.agg(*[F.max(F.abs(F.col(s["name"]))).alias(s["name"]) for s in flagged])
    cells = [F.struct(F.lit(s["name"]).alias("name"), F.col(s["name"]).cast("double").alias("largest"), F.col(s["name"]).between(float(s["lo"]), float(s["hi"])).alias("ok")) for s in flagged]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


#: Operand types and operation that go together, and what they give. float goes with every type in any operation.
TYPE_RESULTS = [
    ("currency", "ratio", "multiply", "currency"), ("ratio", "currency", "multiply", "currency"), ("currency", "currency", "add", "currency"),
    ("currency", "currency", "subtract", "currency"), ("currency", "count", "divide", "currency"), ("ratio", "ratio", "add", "ratio"),
    ("ratio", "ratio", "subtract", "ratio"), ("count", "count", "add", "count"), ("count", "count", "subtract", "count"), ("count", "count", "multiply", "count"),
]


def type_check(ops: DataFrame) -> DataFrame:
    """ops(left_type, right_type, op, ...) with safe and result_type; float promotes to the other side, what is not safe gives float."""
    table = ops.sparkSession.createDataFrame(TYPE_RESULTS, "left_type string, right_type string, op string, known string")
    joined = ops.join(F.broadcast(table), ["left_type", "right_type", "op"], "left")
    promoted = F.when(F.col("left_type") == "float", F.col("right_type")).when(F.col("right_type") == "float", F.col("left_type"))
    result = F.coalesce("known", promoted)
    return joined.withColumns({"safe": result.isNotNull(), "result_type": F.coalesce(result, F.lit("float"))}).drop("known")
