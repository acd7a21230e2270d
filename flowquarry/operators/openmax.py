"""Open-set recognition: class means, tail fits, OpenMax and softmax-threshold rules.

Scoring is a chain of projections over literal parameters (classes x dimensions numbers), so it
never shuffles. Fitting keeps at most ``tail`` distances per class before anything is grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowquarry.functions import vectors as V
from flowquarry.functions.numeric import harmonic, nan_to_num, ratio
from flowquarry.operators.clean import q
from flowquarry.operators.lookup import parameter_grid
from flowquarry.sources.params import OpenMaxParams

# --- fixed values: published sweep grids ----------------------------------------------------
SWEEP_TAILS = [20, 50, 100, 200, 500]
SWEEP_ALPHAS = [1, 2, 3, 5, 7, 10]
SMALL_SWEEP_TAILS = [5, 10, 20, 50]
SMALL_SWEEP_ALPHAS = [1, 2, 3, 5]
MSP_FIFTIETHS = range(25, 50)  # thresholds 0.50, 0.52 .. 0.98


# --- fitting --------------------------------------------------------------------------------

def class_mavs(df: DataFrame, dim: int, y: str = "y", vec: str = "logits") -> DataFrame:
    """(class, mav, n): mean vector per class; one wide aggregate, combined map-side."""
    means = df.groupBy(q(y).cast("int").alias("class")).agg(
        F.count("*").alias("n"),
        *[F.avg(q(vec)[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    return means.select("class", F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("mav"), "n")


def load_mavs(mavs: DataFrame, num_known: int) -> dict[int, list[float]]:
    """Class means of the known classes as driver-side parameters."""
    rows = mavs.where(F.col("class").between(0, num_known - 1)).select("class", "mav").collect()
    return {r["class"]: list(r["mav"]) for r in rows}


def class_distances(df: DataFrame, mavs: dict[int, list[float]], kind: str = "cosine",
                    y: str = "y", vec: str = "logits", out: str = "distance") -> DataFrame:
    """Distance of each row to the mean of its own class; rows of other classes are left out."""
    table = F.expr("map(" + ", ".join(
        f"{int(k)}, array({', '.join(map(V.number, m))})" for k, m in sorted(mavs.items())) + ")")
    rows = df.where(q(y).isin(list(mavs)))
    return rows.withColumn(out, V.distance(
        kind, q(vec), F.element_at(table, q(y).cast("int"))))


def largest_distances(df: DataFrame, tail: int, y: str = "y",
                      distance: str = "distance", tie: Sequence[str] = ()) -> DataFrame:
    """(class, distance, rank): the ``tail`` largest per class.

    The rank filter is pushed below the shuffle, so a task sends at most ``tail`` rows per class.
    """
    w = W.partitionBy("class").orderBy(F.desc("distance"), *tie)
    return (df.select(q(y).cast("int").alias("class"), q(distance).alias("distance"), *tie)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= tail)
            .drop(*tie))


def _tail_fitter():
    """Fit functions as closures, so that Spark ships their code with the task."""

    def mle(x: np.ndarray) -> tuple[float, float] | None:
        """Two-parameter maximum likelihood by bisection on the shape; None when undefined."""
        x = np.asarray(x, dtype=float)
        if len(x) < 3 or not np.all(np.isfinite(x)) or x.min() <= 0 or x.min() == x.max():
            return None
        top = x.max()
        z = x / top
        logs = np.log(z)

        def slope(k: float) -> float:
            p = z ** k
            return float((p * logs).sum() / p.sum() - 1.0 / k - logs.mean())

        lo, hi = 1e-3, 1e-3
        while slope(hi) < 0:
            lo, hi = hi, hi * 2
            if hi > 1e9:
                return None
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
        k = (lo + hi) / 2
        return k, float(top * np.mean(z ** k) ** (1.0 / k))

    def per_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = mle(pdf["distance"].to_numpy())
        shape, scale = fit if fit else (None, None)
        return pd.DataFrame({
            "tail_size": [int(key[0])], "class": [int(key[1])],
            "wb_shape": pd.Series([shape], dtype="float64"),
            "wb_loc": pd.Series([0.0 if fit else None], dtype="float64"),
            "wb_scale": pd.Series([scale], dtype="float64"), "tail_n": [len(pdf)]})

    return mle, per_group


weibull_mle, _fit_tail = _tail_fitter()
_FIT_SCHEMA = ("tail_size int, class int, wb_shape double, wb_loc double, wb_scale double, "
               "tail_n long")


def fit_weibull(df: DataFrame, tails: Sequence[int], y: str = "y", distance: str = "distance",
                tie: Sequence[str] = ()) -> DataFrame:
    """Weibull of the largest distances per class, for every tail size at once.

    A group holds at most ``max(tails)`` numbers. Fewer than three points, equal points or a
    non-positive one give null parameters.
    """
    top = largest_distances(df, max(tails), y, distance, tie)
    sized = top.select("class", "distance", "rank",
                       F.explode(F.array(*[F.lit(int(t)) for t in tails])).alias("tail_size"))
    return (sized.where("rank <= tail_size").groupBy("tail_size", "class")
            .applyInPandas(_fit_tail, _FIT_SCHEMA))


def fit_openmax(df: DataFrame, num_known: int, dim: int, tail_size: int, kind: str,
                alpha_rank: int, y: str = "y", vec: str = "logits",
                tie: Sequence[str] = ()) -> OpenMaxParams:
    """Means and tail fits as one driver-side parameter object."""
    mavs = load_mavs(class_mavs(df, dim, y, vec), num_known)
    fits = fit_weibull(class_distances(df, mavs, kind, y, vec), [tail_size], y, tie=tie).collect()
    return OpenMaxParams(
        num_known, mavs, {r["class"]: (r["wb_shape"], r["wb_scale"])
                          if r["wb_shape"] is not None else None for r in fits},
        kind, alpha_rank, tail_size)


# --- scoring --------------------------------------------------------------------------------

def rank_sql(vec: str, k: int, num: int) -> str:
    """0-based rank of entry ``k`` by descending value; equal values rank by index."""
    v = V.name_of(vec)
    ahead = [f"cast({v}[{j}] {'>=' if j < k else '>'} {v}[{k}] as int)"
             for j in range(num) if j != k]
    return "(" + (" + ".join(ahead) or "0") + ")"


def rank_alpha_sql(ranks: str, k: int, alpha: str) -> str:
    """Weight (alpha - rank)/alpha of the first alpha ranks, 0 beyond."""
    r = f"{V.name_of(ranks)}[{k}]"
    return f"if({r} < {alpha}, cast({alpha} - {r} as double) / {alpha}, 0D)"


def with_ranks(df: DataFrame, vec: str, num: int, out: str = "ranks") -> DataFrame:
    """Rank of every entry within its row."""
    return df.withColumn(out, F.expr(
        "array(" + ", ".join(rank_sql(vec, k, num) for k in range(num)) + ")"))


def class_distance_vector(df: DataFrame, params: OpenMaxParams, vec: str,
                          out: str = "distances") -> DataFrame:
    """Distances of every row to every class mean."""
    if params.distance_type == "cosine":
        df = df.withColumn("__norm", V.norm(q(vec)))
    cells = [V.distance_sql(params.distance_type, vec, params.mav(k), "__norm")
             for k in range(params.num_known)]
    return df.withColumn(out, F.expr("array(" + ", ".join(cells) + ")")).drop("__norm")


def omega_sql(k: int, shape: str, scale: str, alpha: str, missing: float) -> str:
    """Share of activation ``k`` that stays with its class."""
    cdf = f"(1D - exp(-pow(greatest(__d[{k}], 0D) / greatest({scale}, 1e-10D), {shape})))"
    return f"coalesce(1D - {rank_alpha_sql('__r', k, alpha)} * {cdf}, {V.number(missing)})"


def recalibrated(df: DataFrame, num: int, shapes: Sequence[str], scales: Sequence[str],
                 alpha: str, missing: float = 1.0) -> DataFrame:
    """``__v`` logits and ``__d`` distances to ``__z``: revised activations, unknown last."""
    base = with_ranks(df, "__v", num, "__r")
    base = base.withColumn("__w", F.expr("array(" + ", ".join(
        omega_sql(k, shapes[k], scales[k], alpha, missing) for k in range(num)) + ")"))
    kept = ", ".join(f"__v[{k}] * __w[{k}]" for k in range(num))
    lost = " + ".join(f"__v[{k}] * (1D - __w[{k}])" for k in range(num))
    return base.withColumn("__z", F.expr(f"array({kept}, {lost})"))


def openmax(df: DataFrame, params: OpenMaxParams, alpha: int | None = None,
            logits: str = "logits", activations: str | None = None,
            missing_omega: float = 1.0, prediction: str = "prediction",
            probabilities: str = "probabilities") -> DataFrame:
    """OpenMax probabilities over K+1 classes and the chosen class; index K means unknown.

    With ``activations`` the distances are taken there while ranks and recalibration use the
    logits. ``missing_omega=0`` hands a class without tail fit entirely to the unknown class.
    """
    base = df.withColumn("__v", F.transform(q(logits).cast("array<double>"), nan_to_num))
    if activations is not None:
        base = base.withColumn("__a", q(activations).cast("array<double>"))
    base = class_distance_vector(base, params, "__v" if activations is None else "__a", "__d")
    fits = [params.weibull.get(k) for k in range(params.num_known)]
    text = lambda i: [V.number(f[i]) if f else "cast(null as double)" for f in fits]
    base = recalibrated(base, params.num_known, text(0), text(1),
                        str(int(params.alpha_rank if alpha is None else alpha)), missing_omega)
    base = base.withColumn(probabilities, F.transform(V.softmax(F.col("__z")), nan_to_num))
    return base.withColumn(prediction, V.argmax(q(probabilities))).drop(
        "__v", "__a", "__d", "__r", "__w", "__z")


def openmax_single(df: DataFrame, params: OpenMaxParams, **options) -> DataFrame:
    """Variant in which a class without tail fit keeps nothing."""
    return openmax(df, params, missing_omega=0.0, **options)


def hybrid_openmax(df: DataFrame, params: OpenMaxParams, activations: str = "penultimate",
                   **options) -> DataFrame:
    """Distances in activation space, recalibration on logits."""
    return openmax(df, params, activations=activations, **options)


def msp_predict(df: DataFrame, cut: float, num_known: int, logits: str = "logits",
                prediction: str = "prediction", probabilities: str = "probabilities",
                confidence: str = "confidence") -> DataFrame:
    """Top softmax probability below ``cut`` means unknown.

    So do logits without a softmax (null, NaN or infinite ones, or none): their confidence is 0, all probability is the unknown's.
    """
    given = F.slice(q(logits).cast("array<double>"), 1, num_known)
    sound = F.coalesce((F.size(given) == num_known) & ~F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    base = df.withColumn("__p", F.when(sound, V.softmax(given)).otherwise(F.array_repeat(F.lit(0.0), num_known)))
    base = base.withColumn(confidence, F.array_max("__p"))
    rejected = (q(confidence) < F.lit(float(cut))) | (q(confidence) == 0)
    return (base.withColumn(prediction, F.when(rejected, num_known).otherwise(V.argmax(F.col("__p"))).cast("int"))
            .withColumn(probabilities, V.with_unknown(F.col("__p"))).drop("__p"))


# --- sweeps ---------------------------------------------------------------------------------

def _sweep_scores(df: DataFrame, num_known: int, by: Sequence[str], y: str,
                  known: str) -> DataFrame:
    right = q(known) & (F.col("pred") != num_known) & (F.col("pred") == q(y))
    g = df.groupBy(*by).agg(
        F.count_if(q(known)).alias("nk"), F.count_if(~q(known)).alias("nu"),
        F.count_if(right).alias("ok"), F.count_if(~q(known) & (F.col("pred") == num_known))
        .alias("ru"))
    ka, ud = ratio(F.col("ok"), F.col("nk")), ratio(F.col("ru"), F.col("nu"))
    return g.select(*by, F.round(ka, 4).alias("known_acc"), F.round(ud, 4).alias("unknown_det"),
                    F.round(harmonic(ka, ud), 4).alias("h_score"))


def sweep_msp(df: DataFrame, num_known: int, logits: str = "logits", y: str = "y",
              known: str = "is_known", fiftieths: Sequence[int] = MSP_FIFTIETHS) -> DataFrame:
    """Known accuracy, unknown detection and H per softmax threshold.

    Every row contributes one (threshold, outcome) per grid entry; the grid is a constant list
    and outcomes are summed map-side, so the shuffle carries 25 rows per task.
    """
    p = V.softmax(F.slice(q(logits).cast("array<double>"), 1, num_known))
    base = df.select(q(y).alias(y), q(known).alias(known), p.alias("__p"))
    base = base.select(y, known, F.array_max("__p").alias("__top"),
                       V.argmax(F.col("__p")).alias("__best"))
    grid = F.array(*[F.lit(i / 50.0) for i in fiftieths])
    at = base.select("*", F.explode(grid).alias("threshold")).withColumn(
        "pred", F.when(F.col("__top") < F.col("threshold"), num_known).otherwise(F.col("__best")))
    return _sweep_scores(at, num_known, ["threshold"], y, known)


def sweep_openmax(df: DataFrame, mavs: dict[int, list[float]], fits: DataFrame, num_known: int,
                  kind: str, tails: Sequence[int] = SWEEP_TAILS,
                  alphas: Sequence[int] = SWEEP_ALPHAS, logits: str = "logits",
                  activations: str | None = None, y: str = "y",
                  known: str = "is_known") -> DataFrame:
    """Known accuracy, unknown detection and H for every tail size x alpha.

    Distances are computed once per row; only the cheap recalibration runs per grid entry. The
    fitted tails (tails x classes rows) travel with the grid as literals.
    """
    held = {(r["tail_size"], r["class"]): r for r in fits.collect()}
    def pair(t, k):
        r = held.get((t, k))
        ok = r is not None and r["wb_shape"] is not None
        return (float(r["wb_shape"]), float(r["wb_scale"])) if ok else (None, None)
    text = lambda x: "cast(null as double)" if x is None else V.number(x)
    cells = lambda t, i: ", ".join(text(pair(t, k)[i]) for k in range(num_known))
    tail_rows = F.expr("array(" + ", ".join(
        f"named_struct('tail_size', {int(t)}, 'shapes', array({cells(t, 0)}), "
        f"'scales', array({cells(t, 1)}))" for t in tails) + ")")
    params = OpenMaxParams(num_known, mavs, {}, kind)
    base = df.select(q(y).alias(y), q(known).alias(known),
                     F.transform(q(logits).cast("array<double>"), nan_to_num).alias("__v"),
                     *([q(activations).cast("array<double>").alias("__a")] if activations else []))
    base = class_distance_vector(base, params, "__a" if activations else "__v", "__d").drop("__a")
    spark = df.sparkSession
    grid = F.broadcast(parameter_grid(spark, alpha_rank=list(alphas)).crossJoin(
        spark.range(1).select(F.inline(tail_rows))))
    at = base.crossJoin(grid)
    at = recalibrated(at, num_known, [f"shapes[{k}]" for k in range(num_known)],
                      [f"scales[{k}]" for k in range(num_known)], "alpha_rank")
    at = at.withColumn("pred", V.argmax(F.col("__z")))
    return _sweep_scores(at, num_known, ["tail_size", "alpha_rank"], y, known)


def union_sweeps(**sweeps: DataFrame) -> DataFrame:
    """Stack sweeps of different methods; parameters a method lacks are null."""
    shape = [("tail_size", "int"), ("alpha_rank", "int"), ("threshold", "double")]
    out = None
    for name, s in sweeps.items():
        part = s.select(F.lit(name).alias("method"), *[
            F.col(c).cast(t).alias(c) if c in s.columns else F.lit(None).cast(t).alias(c)
            for c, t in shape], "known_acc", "unknown_det", "h_score")
        out = part if out is None else out.unionByName(part)
    return out
