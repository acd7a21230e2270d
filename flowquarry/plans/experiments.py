"""Offline experiments composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import vectors as V
from flowquarry.operators import metrics, openmax
from flowquarry.plans import learn
from flowquarry.plans.storage import materialize


def open_set_experiment(df: DataFrame, num_known: int, dim: int, id: str = "id",
                        frac: float = 0.15, tail_size: int = 200, alpha: int = 5,
                        vec: str = "features") -> dict[str, DataFrame]:
    """Split, train, fit three open-set rules, compare, sweep and report.

    ``df`` holds ``id``, a vector, ``y`` (unknown rows carry ``num_known``) and ``is_known``.
    The scored rows are written once; every table below reads them.
    """
    known = df.where("is_known")
    parts = learn.stratified_split(known, frac, y="y", id=id)
    train = materialize(parts.where(~F.col("is_test")).drop("is_test"))
    test = parts.where("is_test").drop("is_test").unionByName(df.where("not is_known"))
    model = learn.train_classifier(train, num_known, vec)
    train = learn.classifier_logits(model, train, vec)
    test = materialize(learn.classifier_logits(model, test, vec))
    std = openmax.fit_openmax(train, num_known, num_known, tail_size, "euclidean", alpha, tie=[id])
    hyb = openmax.fit_openmax(train, num_known, dim, tail_size, "cosine", alpha, vec=vec, tie=[id])
    msp = openmax.sweep_msp(test, num_known)
    best_cut = metrics.best_rows(msp, 1, ["threshold"]).first()["threshold"]
    scored = {
        "M1": openmax.openmax(test, std, prediction="pred"),
        "M2": openmax.hybrid_openmax(test, hyb, activations=vec, prediction="pred"),
        "M3": openmax.msp_predict(test, best_cut, num_known, prediction="pred").drop("confidence"),
    }
    scored = {m: materialize(s.select(id, "y", "is_known", "pred", "probabilities"))
              for m, s in scored.items()}
    per_method = metrics.open_set_metrics(metrics.tag_union(scored, "method"), num_known,
                                          by=["method"])
    per_method = materialize(per_method)
    best = metrics.best_method(per_method).first()["method"]
    k = num_known + 1
    points = metrics.curve_points(metrics.one_vs_rest(scored[best], k))
    fits = lambda kind, v, mavs: openmax.fit_weibull(
        openmax.class_distances(train, mavs, kind, vec=v), openmax.SWEEP_TAILS, tie=[id])
    sweeps = openmax.union_sweeps(
        M1=openmax.sweep_openmax(test, std.mavs, fits("euclidean", "logits", std.mavs), num_known,
                                 "euclidean"),
        M2=openmax.sweep_openmax(test, hyb.mavs, fits("cosine", vec, hyb.mavs), num_known, "cosine",
                                 activations=vec),
        M3=msp)
    return {
        "closed_set": learn.classifier_eval(test.where("is_known"), num_known),
        "methods": per_method, "comparison": metrics.method_comparison(per_method),
        "sweep": sweeps,
        "report": metrics.macro_weighted_rows(metrics.per_class_report(scored[best], k)),
        "confusion": metrics.confusion_matrix(scored[best], k),
        "auc": metrics.auc_per_class(points).join(metrics.average_precision(points), "class"),
        "macro_auc": metrics.trapezoid(metrics.macro_roc(metrics.roc_interp(points))),
    }


def autoencoder_experiment(df: DataFrame, components: Sequence[int], benign, file: str,
                           vec: str = "features", percentile: float = 97) -> dict[str, DataFrame]:
    """Reconstruction models fitted on benign rows, thresholded and measured per attack file."""
    tables = {}
    for c in components:
        model = learn.fit_reconstruction(df.where(benign), c, vec)
        scored = materialize(learn.reconstruction_error(df, model, vec).drop(vec))
        cut = metrics.threshold(scored.where(benign), percentile=percentile).first()["threshold"]
        tables[f"low_rank_{c}"] = materialize(
            metrics.evaluate_per_file(scored, cut, file, benign=benign))
    runs = metrics.tag_union(tables)
    return {"runs": runs, "summary": metrics.model_summary(runs),
            "ranking": metrics.model_ranking(runs),
            "recall": metrics.recall_pivot(runs, list(tables))}
