"""Scoring and training of small models over many rows.

Weights are packed arrays of checked size, sent once per worker; a batch is one matrix product. Training runs
one job per epoch: partial gradients per partition, summed by Spark, applied on the driver (parameters only).
Rows with null features score null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import reduce as R
from .vectors import _bounded, by_rows

ACT: dict[object, Callable[[np.ndarray], np.ndarray]] = {
    0: lambda z: np.where(z > 0, z, 0.0),
    1: lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))),
    2: np.tanh,
    3: lambda z: z,
}
SLOPE: dict[object, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    0: lambda z, a: (z > 0).astype(float),
    1: lambda z, a: a * (1 - a),
    2: lambda z, a: 1 - a * a,
    3: lambda z, a: np.ones_like(z),
}
MAX_LAYERS = 10
#: Fixed values of the optimiser.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

Layer = tuple[np.ndarray, np.ndarray, int]


def layers_of(rows: list) -> list[Layer]:
    """Layers from rows (layer, w, b, rows, cols, act) of a small table."""
    if len(rows) > MAX_LAYERS:
        raise ValueError("more than 10 layers")
    return [(_bounded(np.array(r["w"], float).reshape(r["rows"], r["cols"])), np.array(r["b"], float), int(r["act"])) for r in sorted(rows, key=lambda r: r["layer"])]


def forward(x: np.ndarray, layers: list[Layer]) -> np.ndarray:
    for w, b, act in layers:
        x = ACT[act](x @ w + b)
    return x


def mlp_score(df: DataFrame, features: str, layers: list[Layer], out: str = "score") -> DataFrame:
    """df with the network's output (an array). Activations: 0 relu, 1 sigmoid, 2 tanh, 3 linear; the last layer has its own too."""
    sent = df.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series) -> pd.Series:
        return by_rows(x, lambda v: forward(v, sent.value))

    return df.withColumn(out, kernel(F.col(features)))


def mlp_score_sql(features: Column, layers: list[Layer]) -> Column:
    """The same as one expression, for small networks: stays in the JVM. Activations 0 and 3."""
    x = features
    for w, b, act in layers:
        units = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[:, j]]).alias("w"), F.lit(float(b[j])).alias("b")) for j in range(w.shape[1])])
        z = F.transform(F.array(x), lambda p: F.transform(units, lambda u: F.aggregate(F.zip_with(p, u["w"], lambda a, c: a * c), u["b"], lambda s, y: s + y)))
        z = F.get(z, F.lit(0))
        x = F.transform(z, lambda v: F.when(v > 0, v).otherwise(0.0)) if act == 0 else F.transform(z, lambda v: 1.0 / (1.0 + F.exp(-v))) if act == 1 else F.transform(z, F.tanh) if act == 2 else z
    return x


dense_chain_score = mlp_score


def tree_score_sql(features: Column, tree: list[dict]) -> Column:
    """One tree (rows node, feature, threshold, left, right, leaf) as nested conditions: feature < threshold goes left."""
    nodes = {n["node"]: n for n in tree}

    def at(i: int) -> Column:
        n = nodes[i]
        if n["feature"] is None or n["feature"] < 0:
            return F.lit(float(n["leaf"]))
        return F.when(F.coalesce(F.get(features, F.lit(n["feature"])), F.lit(0.0)) < n["threshold"], at(n["left"])).otherwise(at(n["right"]))

    return at(0)


def trees_score(df: DataFrame, features: str, trees: dict[int, list[dict]], out: str = "score", vote: bool = False) -> DataFrame:
    """df with the sum (or the median) of many trees, walked in numpy level by level. Rows with null features give null."""
    tables = []
    for rows in trees.values():
        n = max(r["node"] for r in rows) + 1
        t = {k: np.zeros(n, float if k in ("threshold", "leaf") else np.int64) for k in ("feature", "threshold", "left", "right", "leaf")}
        for r in rows:
            for k in t:
                t[k][r["node"]] = -1 if r[k] is None else r[k]
        tables.append(t)
    sent = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("double")
    def kernel(x: pd.Series) -> pd.Series:
        return by_rows(x, walk)

    def walk(v: np.ndarray) -> np.ndarray:
        scores = []
        for t in sent.value:
            at = np.zeros(len(v), np.int64)
            while (t["feature"][at] >= 0).any():
                f = t["feature"][at]
                left = v[np.arange(len(v)), np.maximum(f, 0)] < t["threshold"][at]
                at = np.where(f < 0, at, np.where(left, t["left"][at], t["right"][at]))
            scores.append(t["leaf"][at])
        return np.median(scores, 0) if vote else np.sum(scores, 0)

    return df.withColumn(out, kernel(F.col(features)))


def ensemble_vote(scores: Column, strategy: str = "median") -> Column:
    """Of an array column."""
    s = F.array_sort(F.filter(scores, lambda x: x.isNotNull()))
    n = F.size(s)
    if strategy == "median":
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return {"min": F.array_min(s), "max": F.array_max(s)}.get(strategy, F.when(n > 0, R.reduce_row(s, 1)))


def _gradients(x: np.ndarray, y: np.ndarray, layers: list[Layer]) -> tuple[float, list[np.ndarray]]:
    zs, activations = [], [x]
    for w, b, act in layers:
        zs.append(activations[-1] @ w + b)
        activations.append(ACT[act](zs[-1]))
    diff = activations[-1] - y
    delta, grads = 2 * diff, []
    for (w, _, act), z, a, before in zip(reversed(layers), reversed(zs), reversed(activations[1:]), reversed(activations[:-1]), strict=True):
        delta = delta * SLOPE[act](z, a)
        grads = [before.T @ delta, delta.sum(0), *grads]
        delta = delta @ w.T
    return float((diff**2).sum()), grads


def mlp_train(df: DataFrame, features: str, labels: str, layers: list[Layer], epochs: int = 1000, lr: float = 0.001, adam: bool = True, patience: int = 0, min_delta: float = 1e-6) -> tuple[list[Layer], list[float]]:
    """(layers, losses) by full-batch gradient steps on the mean squared error; labels is an array column.

    A loss is the mean over rows and outputs before its step; training stops after `patience` epochs (if any) that
    improve by no more than min_delta. Rows are kept as float arrays between epochs.
    """
    data = df.select(features, labels).where(F.col(features).isNotNull() & F.col(labels).isNotNull()).persist()
    n = data.count()
    layers = [(w.copy(), b.copy(), act) for w, b, act in layers]
    flat = [p for w, b, _ in layers for p in (w, b)]
    m, v, losses, best, since = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], [], np.inf, 0
    outputs = layers[-1][0].shape[1]
    spark = df.sparkSession
    try:
        for t in range(1, epochs + 1 if n else 1):
            sent = spark.sparkContext.broadcast(layers)

            def partial(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                total, loss = None, 0.0
                for pdf in frames:
                    if len(pdf):
                        s, g = _gradients(np.array(pdf[features].tolist(), float), np.array(pdf[labels].tolist(), float), sent.value)
                        loss += s
                        total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
                if total is not None:
                    yield pd.DataFrame({"i": np.arange(-1, sum(x.size for x in total)), "g": np.concatenate([[loss], *(x.ravel() for x in total)])})

            rows = data.mapInPandas(partial, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # as many as parameters
            sent.unpersist()
            g = np.zeros(len(rows) - 1)
            for r in rows:
                if r["i"] >= 0:
                    g[r["i"]] = r["g"]
                else:
                    losses.append(r["g"] / (n * outputs))
            at = 0
            for k, p in enumerate(flat):
                step = g[at : at + p.size].reshape(p.shape) / n
                at += p.size
                if adam:
                    m[k] = BETA1 * m[k] + (1 - BETA1) * step
                    v[k] = BETA2 * v[k] + (1 - BETA2) * step * step
                    p -= lr * (m[k] / (1 - BETA1**t)) / (np.sqrt(v[k] / (1 - BETA2**t)) + EPSILON)
                else:
                    p -= lr * step
            if patience:
                better = best - losses[-1] > min_delta
                best, since = (losses[-1], 0) if better else (best, since + 1)
                if since >= patience:
                    break
    finally:
        data.unpersist()
    return layers, losses


def tnet_train(df: DataFrame, features: str, labels: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, **config) -> tuple[list[Layer], list[float]]:
    """Two layers, relu then linear."""
    return mlp_train(df, features, labels, [(w1, b1, 0), (w2, b2, 3)], **{"adam": False, **config})


def linear_fit(df: DataFrame, x: str, y: str, lr: float, steps: int, w0: float = 0.0, b0: float = 0.0) -> tuple[float, float]:
    """(w, b) by gradient steps on the squared error of w * x + b. One aggregation gives the sums; steps need no data."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count("*").alias("n"), *[F.sum(c.cast("double")).alias(k) for k, c in {"x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}.items()]
    ).first()
    w, b = w0, b0
    for _ in range(steps if s["n"] else 0):
        gw = 2 * (w * s["xx"] + b * s["x"] - s["xy"]) / s["n"]
        gb = 2 * (w * s["x"] + b * s["n"] - s["y"]) / s["n"]
        w, b = w - lr * gw, b - lr * gb
    return w, b


#: Workers times parameters of local_train_then_vote, which meet on the driver.
MAX_LOCAL = 10_000_000


#: Rows that a task packs at once.
PACK = 200_000


def _packed(features: str, labels: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_i, n, x, y): the rows of each worker in blocks of doubles, which later passes read without going through rows."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        i = table["_i"].to_numpy()
        order = np.argsort(i, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(i[order]) != 0))
        ends = np.append(starts[1:], len(i))
        x, y = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(i), -1)[order] for c in (features, labels))
        blocks = [[m[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for m in (x, y)]
        return pa.RecordBatch.from_arrays([pa.array(i[order[starts]]), pa.array(ends - starts), *(pa.array(b, pa.binary()) for b in blocks)], ["_i", "n", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACK:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def local_train_then_vote(df: DataFrame, worker: str, features: str, labels: str, layers: list[Layer], epochs: int, lr: float, strategy: int = 0) -> list[Layer]:
    """Train on each worker's rows alone, then combine each parameter by median or mean.

    All workers train together, one job an epoch over rows packed once into blocks of doubles: tasks send partial gradients per worker and parameter, and only
    workers x parameters (MAX_LOCAL at most, or an error) reach the driver. A null worker is a worker of its own.
    """
    data = df.select(F.col(worker).alias("_w"), features, labels).where(F.col(features).isNotNull() & F.col(labels).isNotNull())
    first = np.concatenate([p.ravel() for w, b, _ in layers for p in (w, b)]).astype(float)
    spark = df.sparkSession
    most = MAX_LOCAL // max(len(first), 1)
    rows = data.groupBy("_w").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many workers for their parameters to meet on the driver: group workers first")
    at = {r["_w"]: i for i, r in enumerate(rows)}
    n = np.array([r["n"] for r in rows], float)
    params = np.tile(first, (len(rows), 1))
    numbers = spark.createDataFrame([(r["_w"], i) for i, r in enumerate(rows)], StructType([StructField("_w", data.schema["_w"].dataType), StructField("_i", LongType())]))
    lists = [F.col(c).cast("array<double>").alias(c) for c in (features, labels)]
    data = data.join(F.broadcast(numbers), data["_w"].eqNullSafe(numbers["_w"])).select("_i", *lists)
    data = data.mapInArrow(_packed(features, labels), "_i long, n long, x binary, y binary").persist()

    def shaped(flat: np.ndarray) -> list[Layer]:
        out, k = [], 0
        for w, b, act in layers:
            out.append((flat[k : k + w.size].reshape(w.shape), flat[k + w.size : k + w.size + b.size].reshape(b.shape), act))
            k += w.size + b.size
        return out

    try:
        for _ in range(epochs if at else 0):
            sent = spark.sparkContext.broadcast(params)

            def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for row in batch.to_pylist():
                        x, y = (np.frombuffer(row[c]).reshape(row["n"], -1) for c in "xy")
                        _, g = _gradients(x, y, shaped(sent.value[row["_i"]]))
                        flat = np.concatenate([v.ravel() for v in g])
                        total[row["_i"]] = total[row["_i"]] + flat if row["_i"] in total else flat
                for i, g in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i)), pa.array(np.arange(len(g))), pa.array(g)], ["_i", "i", "g"])

            got = data.mapInArrow(partial, "_i long, i long, g double").groupBy("_i", "i").agg(F.sum("g").alias("g")).toPandas()  # workers x parameters
            sent.unpersist()
            step = np.zeros_like(params)
            step[got["_i"].to_numpy(), got["i"].to_numpy()] = got["g"].to_numpy()
            params = params - lr * step / n[:, None]
    finally:
        data.unpersist()
    if not at:
        return shaped(np.zeros(len(first)))
    combine = {"median": np.median, "mean": np.mean, "min": np.min, "max": np.max}[R.VOTES[strategy]]
    return shaped(combine(params, axis=0))


def logreg_score(features: Column, weights: list[float], bias: float) -> Column:
    z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)
    return 1.0 / (1.0 + F.exp(-z))


def softmax_classify(df: DataFrame, features: str, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """df with probabilities and class."""
    out = mlp_score(df, features, [(w, b, 3)], "_z").withColumn("probabilities", R.softmax(F.col("_z")))
    return out.withColumn("class", F.expr("array_position(probabilities, array_max(probabilities)) - 1")).drop("_z")


#: Classes of a naive Bayes model.
MAX_CLASSES = 10_000


def naive_bayes_score(tokens: DataFrame, likelihood: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, class, probability): tokens(doc_id, word), likelihood(word, class, logp), priors(class, logp). Unknown words say nothing."""
    classes = priors.select("class", "logp").limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError("too many classes to be listed for each document")
    kind = priors.schema["class"].dataType.simpleString()
    every = F.array(*[F.struct(F.lit(c["class"]).alias("class"), F.lit(c["logp"]).alias("prior")) for c in classes]).cast(f"array<struct<class:{kind},prior:double>>")
    docs = tokens.select("doc_id").distinct().select("doc_id", F.inline(every))
    counts = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    sums = counts.join(likelihood, "word").groupBy("doc_id", "class").agg(F.sum(F.col("n") * F.col("logp")).alias("s"))
    total = docs.join(sums, ["doc_id", "class"], "left").withColumn("z", F.col("prior") + F.coalesce("s", F.lit(0.0)))
    return R.softmax_by(total.select("doc_id", "class", "z"), ["doc_id"], "z").select("doc_id", "class", F.col("softmax").alias("probability"))


def reconstruction_error(df: DataFrame, features: str, layers: list[Layer], out: str = "error") -> DataFrame:
    scored = mlp_score(df, features, layers, "_r")
    return scored.withColumn(out, F.aggregate(F.zip_with(features, "_r", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).drop("_r")


def embed_pool_classify(tokens: DataFrame, table: DataFrame, dim: int, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """(doc_id, probabilities, class): look up tokens(doc_id, id), mean per document, linear, softmax."""
    from .lookup import embed_lookup

    long = embed_lookup(tokens, table, dim).select("doc_id", F.posexplode("vector").alias("j", "v")).groupBy("doc_id", "j").agg(F.avg("v").alias("v"))
    pooled = long.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("features"))
    return softmax_classify(pooled, "features", w, b).drop("features")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Scores of queries and keys that a task holds at once.
TILE = 4_000_000


def attention(df: DataFrame, seq: str, pos: str, kind: str = "long", block: int = 16_384) -> DataFrame:
    """(seq, pos, out): softmax(Q K^T / sqrt(d)) V of each sequence, rows (seq, pos, q, k, v), of any length.

    A sequence is cut into blocks of about `block` rows by hash. Each block of queries meets each block of keys in a task of its own, which keeps per query
    the largest score, the sum of weights and the weighted sum of values; these merge in any order. The work grows with the square
    of a sequence's length, as the result needs; memory does not. Rows are shuffled once per block of their sequence, so in proportion to the input up to `block` rows
    a sequence; within a task scores are made TILE at a time. Rows with null k or v are no keys; a null q, or no key at all, gives null.
    """
    rows = df.select(F.col(seq).alias("_s"), F.col(pos).alias("_p"), "q", "k", "v", F.monotonically_increasing_id().alias("_id"))
    sizes = rows.groupBy("_s").agg(F.ceil(F.count("*") / block).cast("int").alias("_n")).withColumnRenamed("_s", "_t")
    rows = rows.join(sizes, F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_b", F.pmod(F.xxhash64("_p", "_id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    queries = rows.where("q IS NOT NULL").select("_s", F.col("_b").alias("qb"), every.alias("kb"), "_p", "_id", "q")
    keys = rows.where("k IS NOT NULL AND v IS NOT NULL").select(F.col("_s").alias("_t"), every.alias("to"), F.col("_b").alias("of"), "k", "v")
    schema = f"_s {kind}, _p {dict(rows.dtypes)['_p']}, _id long, m double, w double, a array<double>"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[["_s", "_p", "_id"]].assign(m=-np.inf, w=0.0, a=None)
        q, k, v = np.array(left.q.tolist(), float), np.array(right.k.tolist(), float), np.array(right.v.tolist(), float)
        m, w, a = np.empty(len(q)), np.empty(len(q)), []
        step = max(1, TILE // len(k))
        for lo in range(0, len(q), step):
            z = q[lo : lo + step] @ k.T / np.sqrt(q.shape[1])
            m[lo : lo + step] = z.max(1)
            e = np.exp(z - m[lo : lo + step, None])
            w[lo : lo + step] = e.sum(1)
            a.extend(e @ v)
        return left[["_s", "_p", "_id"]].assign(m=m, w=w, a=a)

    parts = queries.groupBy("_s", "qb", "kb").cogroup(keys.groupBy("_t", "to", "of")).applyInPandas(run, schema)
    found = parts.groupBy("_s", "_p", "_id").agg(F.max("m").alias("m"), F.filter(F.collect_list(F.struct("m", "w", "a")), lambda x: x["a"].isNotNull()).alias("x"))  # a row per block of keys
    scaled = F.transform("x", lambda x: F.struct((x["w"] * F.exp(x["m"] - F.col("m"))).alias("w"), F.transform(x["a"], lambda y: y * F.exp(x["m"] - F.col("m"))).alias("a")))
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + x["w"])
    summed = F.aggregate(F.slice("y", F.lit(2), F.size("y")), F.get("y", F.lit(0))["a"], lambda s, x: F.zip_with(s, x["a"], lambda a, b: a + b))
    found = found.withColumn("y", scaled).withColumns({"_total": total, "_sum": F.when(F.size("y") > 0, summed)})
    out = found.select(F.col("_s").alias(seq), F.col("_p").alias(pos), F.transform("_sum", lambda x: x / F.col("_total")).alias("out"))
    return out.unionByName(rows.where("q IS NULL").select(F.col("_s").alias(seq), F.col("_p").alias(pos), F.lit(None).cast("array<double>").alias("out")))


# ---- whole graphs ---------------------------------------------------------------------------------------------------


def _graph_step(x: np.ndarray, layer: dict, outputs: dict[str, np.ndarray]) -> np.ndarray:
    """One layer over a batch: x[n, c, h, w] for images, x[n, k] otherwise."""
    op = layer["op"]
    if op == "conv":
        pad_, stride, kernel = layer.get("padding", 0), layer.get("stride", 1), np.asarray(layer["kernel"], float)
        x = np.pad(x, ((0, 0), (0, 0), (pad_, pad_), (pad_, pad_)))
        view = np.lib.stride_tricks.sliding_window_view(x, kernel.shape[2:], axis=(2, 3))[:, :, ::stride, ::stride]
        return np.einsum("nchwij,ocij->nohw", view, kernel, optimize=True) + np.asarray(layer.get("bias", 0.0), float).reshape(1, -1, 1, 1)
    if op in ("maxpool", "avgpool"):
        size, stride = layer.get("size", 2), layer.get("stride", layer.get("size", 2))
        view = np.lib.stride_tricks.sliding_window_view(x, (size, size), axis=(2, 3))[:, :, ::stride, ::stride]
        return view.max((4, 5)) if op == "maxpool" else view.mean((4, 5))
    if op == "reshape":
        return x.reshape(len(x), *layer["shape"])
    if op == "flatten":
        return x.reshape(len(x), -1)
    if op == "dense":
        return x @ np.asarray(layer["w"], float) + np.asarray(layer.get("b", 0.0), float)
    if op == "add":
        return x + (outputs[layer["with"]] if "with" in layer else np.asarray(layer["value"], float))
    if op == "scale":
        return x * np.asarray(layer["value"], float)
    kinds = {"relu": lambda v: np.maximum(v, 0), "sigmoid": ACT[1], "tanh": np.tanh, "softmax": _softmax, "identity": lambda v: v}
    if op not in kinds:
        raise ValueError(f"unknown layer {op}")
    return kinds[op](x)


def graph_score(df: DataFrame, features: str, layers: list[dict], out: str = "score") -> DataFrame:
    """df with the output (a flat array) of an imported graph, its layers in the order of computation, in one Arrow kernel.

    A layer has op (conv, maxpool, avgpool, reshape, flatten, dense, add, scale, relu, sigmoid, tanh, softmax or identity), its
    parameters, and a name if a later `add` takes its output. Images begin with reshape to (c, h, w). Rows with null features give null.
    """
    for layer in layers:
        for part in ("kernel", "bias", "w", "b", "value"):
            if part in layer:
                _bounded(np.asarray(layer[part], float))
    sent = df.sparkSession.sparkContext.broadcast(layers)

    def run(v: np.ndarray) -> np.ndarray:
        outputs: dict[str, np.ndarray] = {}
        for layer in sent.value:
            v = _graph_step(v, layer, outputs)
            if "name" in layer:
                outputs[layer["name"]] = v
        return v.reshape(len(v), -1)

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series) -> pd.Series:
        return by_rows(x, run)

    return df.withColumn(out, kernel(F.col(features)))


# ---- images: rows (n, c, h, w, pixels), row-major -------------------------------------------------------------------


def _images(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f over the images of one shape at once, as x[n, c, h, w]. Null pixels or sizes give null pixels."""
    kinds, keep = dict(df.dtypes), [c for c in df.columns if c not in ("c", "h", "w", "pixels")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            shapes = np.full((len(pdf), 3), None, object)
            pixels = np.full(len(pdf), None, object)
            at = pd.Series(np.arange(len(pdf)))[pdf[["c", "h", "w", "pixels"]].notna().all(axis=1).to_numpy()]
            for (c, h, w), some in at.groupby([pdf[k].to_numpy()[at] for k in "chw"]):
                y = f(np.array(pdf["pixels"].iloc[some].tolist(), float).reshape(len(some), int(c), int(h), int(w)))
                shapes[some] = y.shape[1:]
                for i, v in zip(some, y.reshape(len(y), -1), strict=True):
                    pixels[i] = v
            yield pdf[keep].assign(**{k: pd.array(shapes[:, i], "Int32") for i, k in enumerate("chw")}, pixels=pixels)

    return df.select(*keep, "c", "h", "w", "pixels").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "c int, h int, w int, pixels array<double>"]))


def conv2d(df: DataFrame, kernel: np.ndarray, stride: int = 1, padding: int = 0) -> DataFrame:
    """Correlation with kernel[out, in, kh, kw]; zeros around."""
    layer = {"op": "conv", "kernel": np.asarray(kernel, float), "stride": stride, "padding": padding}
    return _images(df, lambda x: _graph_step(x, layer, {}))


def maxpool(df: DataFrame, size: int = 2, stride: int = 2) -> DataFrame:
    return _images(df, lambda x: _graph_step(x, {"op": "maxpool", "size": size, "stride": stride}, {}))


def upscale(df: DataFrame, factor: int = 2) -> DataFrame:
    return _images(df, lambda x: x.repeat(factor, 2).repeat(factor, 3))


def pad(df: DataFrame, n: int = 1) -> DataFrame:
    return _images(df, lambda x: np.pad(x, ((0, 0), (0, 0), (n, n), (n, n))))


# ---- gradients --------------------------------------------------------------------------------------------------


def softmax_backward(grad: np.ndarray, s: np.ndarray) -> np.ndarray:
    return s * (grad - (grad * s).sum(-1, keepdims=True))


def layer_norm_backward(grad: np.ndarray, x: np.ndarray, eps: float = R.EPS) -> np.ndarray:
    n, mu = x.shape[-1], x.mean(-1, keepdims=True)
    inv = 1 / np.sqrt(x.var(-1, keepdims=True) + eps)
    h = (x - mu) * inv
    return inv / n * (n * grad - grad.sum(-1, keepdims=True) - h * (grad * h).sum(-1, keepdims=True))


def matmul_backward(df: DataFrame, features: str, grad: str) -> DataFrame:
    """(i, j, v) = X^T G over all rows: partial products per partition, then a sum. Rows with a null on either side take no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            if len(pdf):
                g = np.array(pdf[features].tolist(), float).T @ np.array(pdf[grad].tolist(), float)
                total = g if total is None else total + g
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = df.select(features, grad).where(F.col(features).isNotNull() & F.col(grad).isNotNull())
    return rows.mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


class Scorer:
    """A model read from packed tensors, applied to any DataFrame, batch or streaming."""

    def __init__(self, layers: list[Layer]) -> None:
        self.layers = layers

    @classmethod
    def from_tensors(cls, tensors: DataFrame, names: list[tuple[str, str, int]]) -> Scorer:
        """names: (weights, bias, activation) per layer. Only these tensors are read, of checked size."""
        wanted = [n for w, b, _ in names for n in (w, b)]
        t = {r["name"]: np.array(r["data"], float).reshape(r["shape"]) for r in tensors.where(F.col("name").isin(wanted)).limit(len(wanted)).collect()}
        return cls([(_bounded(t[w]), t[b].ravel(), act) for w, b, act in names])

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        return mlp_score(df, features, self.layers, out)
