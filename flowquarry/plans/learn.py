"""Models: pluggable scoring, Spark ML training, splits and reconstruction errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowquarry.functions import vectors as V
from flowquarry.operators import metrics
from flowquarry.operators.clean import q
from flowquarry.plans.joins import join_dimension
from flowquarry.plans.storage import materialize


def linear_scores(df: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float],
                  vec: str = "features", out: str = "logits") -> DataFrame:
    """Linear model: of short vectors inside the JVM, of long ones in Arrow batches; both add the terms in the order of the cells."""
    width = len(weights[0])
    if width <= V.UNROLL:
        return df.withColumn(out, V.dense(vec, weights, bias))
    table, start = np.asarray(weights, dtype=float), np.asarray(bias, dtype=float)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        rows, size = len(vectors), len(table)
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
        flat = vectors.filter(pa.array(fits)).flatten()
        missing = np.ones(rows, bool)
        missing[fits] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        cells = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, width).T)
        sums = np.zeros((size, cells.shape[1]))
        for c in range(width):  # one after the other, so that every sum is rounded as in a plain loop over a row
            for k in range(size):
                sums[k] += cells[c] * table[k, c]
        found = np.zeros((rows, size))
        found[fits] = (sums + start[:, None]).T
        values = pa.array(found.reshape(-1), mask=np.repeat(missing, size))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * size + 1, size), pa.int32()), values)
    return df.withColumn(out, run(q(vec)))


def score(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], vec: str = "features",
          out: str = "logits") -> DataFrame:
    """Any batch predictor (rows x dims in, rows x outputs out), in Arrow batches.

    The callable is shipped once per Python worker; batches follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch):
                yield pd.Series(list(np.asarray(predict(np.stack(batch.to_numpy())), dtype=float)))
            else:
                yield pd.Series([], dtype=object)
    return df.withColumn(out, run(q(vec)))


EDGE_ROWS, DIGITS = 100_000, 3


def _edge_cells(rows: DataFrame, y: str, frac: float | None, at: DataFrame | None, edge_rows: int) -> DataFrame:
    """For every class the range of hashes that holds its last test row: cell (their common beginning), start, n, take.

    Without ``at``, ranges are those of the first digits; with it, the ranges of ``at`` that are too large are divided further.
    """
    if at is None:
        wide = rows.withColumns({"__base": F.lit(0).cast("long"), "__wanted": F.lit(None).cast("long"), "__long": F.lit(DIGITS)})
    else:
        wide = join_dimension(rows, at.where(F.col("n") > edge_rows), [y], "inner", null_safe=True).where(F.startswith("__h", F.col("cell")))
        wide = wide.select(y, "__h", F.col("start").alias("__base"), F.col("take").alias("__wanted"), (F.length("cell") + DIGITS).alias("__long"))
    cells = wide.groupBy(y, "__base", "__wanted", F.substring("__h", F.lit(1), F.col("__long")).alias("cell")).agg(F.count("*").alias("n"))
    of_class = W.partitionBy(y)
    before = of_class.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    ends = cells.select(y, "cell", "n", (F.col("__base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"),
                        F.coalesce("__wanted", F.ceil(F.sum("n").over(of_class) * F.lit(frac))).alias("take"))
    return materialize(ends.where((F.col("start") < F.col("take")) & (F.col("take") <= F.col("start") + F.col("n"))))


def stratified_split(df: DataFrame, frac: float, seed: int = 42, y: str = "y", id: str = "id",
                     edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Add ``is_test``: exactly ceil(frac * n) rows of each class, chosen by hashed id.

    Hashes are uniform, so their first digits cut every class into even ranges, and counts say which range holds the
    last test row. That range alone is divided by further digits until it has at most ``edge_rows`` rows, whatever the size of the
    class (rows of one id stay together); only what is left of it is sorted.
    """
    rows = df.withColumn("__h", F.md5(F.concat_ws("|", q(id).cast("string"), F.lit(str(seed)))))
    keys = rows.select(y, "__h")
    at = _edge_cells(keys, y, frac, None, edge_rows)
    for _ in range(32 // DIGITS - 1):
        if at.where(F.col("n") > edge_rows).isEmpty():
            break
        at = at.where(F.col("n") <= edge_rows).unionByName(_edge_cells(keys, y, None, at, edge_rows))
    cells = at.select(y, F.col("cell").alias("__cell"), (F.col("take") - F.col("start")).alias("__left"))
    placed = join_dimension(rows, cells, [y], null_safe=True)
    edge = F.coalesce(F.startswith("__h", F.col("__cell")), F.lit(False))
    whole = placed.where(~edge).withColumn("is_test", F.coalesce(F.col("__h") < F.col("__cell"), F.lit(False)))
    rank = F.row_number().over(W.partitionBy(y).orderBy("__h", id))
    last = placed.where(edge).withColumn("__r", rank).withColumn("is_test", F.col("__r") <= F.col("__left")).drop("__r")
    extra = ["__h", "__cell", "__left"]
    return whole.drop(*extra).unionByName(last.drop(*extra))


def train_classifier(df: DataFrame, k: int, vec: str = "features", y: str = "y",
                     max_iter: int = 30, reg: float = 0.01):
    """Multinomial logistic regression with balanced class weights."""
    weights = {r["class"]: r["weight"] for r in metrics.class_weights(df, k, y).collect()}
    table = F.create_map(*[c for kv in weights.items() for c in (F.lit(kv[0]), F.lit(kv[1]))])
    rows = df.select(array_to_vector(q(vec)).alias("x"), q(y).cast("double").alias("label"),
                     F.element_at(table, q(y).cast("int")).alias("w"))
    return LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", family="multinomial",
                              maxIter=max_iter, regParam=reg).fit(rows)


def classifier_logits(model, df: DataFrame, vec: str = "features",
                      out: str = "logits") -> DataFrame:
    """Logits of a fitted linear classifier, computed as column expressions."""
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return linear_scores(df, w.tolist(), b.tolist(), vec, out)


def fit_reconstruction(df: DataFrame, components: int, vec: str = "features"):
    """Low-rank model of benign rows: (mean, components x dims)."""
    rows = df.select(array_to_vector(q(vec)).alias("x"))
    pca = PCA(k=components, inputCol="x", outputCol="z").fit(rows)
    basis = pca.pc.toArray().T
    dim = basis.shape[1]
    mean = df.agg(F.array(*[F.avg(q(vec)[i]) for i in range(dim)]).alias("m")).first()["m"]
    return np.array(mean), basis


def reconstruction_error(df: DataFrame, model, vec: str = "features",
                         out: str = "error") -> DataFrame:
    """Mean squared distance between a row and its low-rank reconstruction."""
    mean, basis = model
    code = V.dense(vec, basis.tolist(), (-(basis @ mean)).tolist())
    rows = df.withColumn("__code", code)
    rows = rows.withColumn("__back", V.dense("__code", basis.T.tolist(), mean.tolist()))
    return rows.withColumn(out, V.mse(q(vec), F.col("__back"), basis.shape[1])).drop("__code", "__back")


def cluster_discovery(df: DataFrame, k: int, vec: str = "features", seed: int = 42,
                      out: str = "cluster", max_iter: int = 20) -> DataFrame:
    """Unsupervised class codes."""
    rows = df.withColumn("__x", array_to_vector(q(vec)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__x", predictionCol=out).fit(rows)
    return model.transform(rows).drop("__x")


def classifier_eval(df: DataFrame, k: int, logits: str = "logits", y: str = "y") -> DataFrame:
    """Closed-set report of the plain classifier."""
    return metrics.per_class_report(df.withColumn("pred", V.argmax(q(logits))), k, y, "pred")


