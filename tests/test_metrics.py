"""Evaluation tables against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import metrics


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 3, n)
    s = np.round(rng.random((n, 4)) + 0.3 * np.eye(4)[y], 2)
    rows = [(int(a), [float(v) for v in b]) for a, b in zip(y, s)]
    return spark.createDataFrame(rows, "y int, probabilities array<double>").cache(), y, s


def _curve(y, s, c):
    pts = [(0.0, 0.0)]
    for t in sorted(set(s[:, c]), reverse=True):
        hit = s[:, c] >= t
        pts.append(((hit & (y != c)).sum() / (y != c).sum(), (hit & (y == c)).sum() / (y == c).sum()))
    return np.array(pts)


def test_curves(scored):
    df, y, s = scored
    points = metrics.curve_points(metrics.one_vs_rest(df, 4), parts=8).cache()
    auc = {r["class"]: r["auc"] for r in metrics.auc_per_class(points).collect()}
    ap = {r["class"]: r["ap"] for r in metrics.average_precision(points).collect()}
    interp = metrics.roc_interp(points).cache()
    assert set(auc) == {0, 1, 2}  # class 3 has no positives
    grid, mean = np.linspace(0, 1, 200), np.zeros(200)
    for c in range(3):
        pts = _curve(y, s, c)
        assert auc[c] == pytest.approx(np.trapezoid(pts[:, 1], pts[:, 0]), abs=1e-12)
        exp = np.interp(grid, pts[:, 0], pts[:, 1])
        got = [r["tpr"] for r in interp.where(F.col("class") == c).orderBy("pos").collect()]
        assert len(got) == 200 and np.allclose(got, exp, atol=1e-12)
        mean += exp / 3
        total, last = 0.0, 0.0
        for t in sorted(set(s[:, c]), reverse=True):
            hit = s[:, c] >= t
            rec = (hit & (y == c)).sum() / (y == c).sum()
            total, last = total + (rec - last) * (hit & (y == c)).sum() / hit.sum(), rec
        assert ap[c] == pytest.approx(total, abs=1e-12)
    area = metrics.trapezoid(metrics.macro_roc(interp)).first()["auc"]
    assert area == pytest.approx(np.trapezoid(mean, grid), abs=1e-12)


def test_evaluate_per_file(spark):
    rng = np.random.default_rng(5)
    rows = [("b", float(v), 0) for v in rng.integers(0, 20, 200)]
    rows += [(f, float(v), int(v) % 2) for f in ("x", "y") for v in rng.integers(5, 25, 60)]
    df = spark.createDataFrame(rows, "source_file string, error double, y int")
    for mode in ("file", "label"):
        got = {r["Attack"]: r for r in metrics.evaluate_per_file(
            df, 12.0, benign=F.col("source_file") == "b", positives=mode, parts=4).collect()}
        assert set(got) == {"x", "y"}
        for f, r in got.items():
            s = np.array([v for g, v, _ in rows if g in ("b", f)])
            t = np.array([0 if g == "b" else (1 if mode == "file" else k) for g, _, k in rows
                          if g in ("b", f)])
            assert (r["TP"], r["FP"]) == (((s > 12) & (t == 1)).sum(), ((s > 12) & (t == 0)).sum())
            p, n = s[t == 1], s[t == 0]
            wins = (p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()
            assert r["AUC"] == pytest.approx(wins / len(p) / len(n), abs=1e-12)


def test_zero_division_and_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    rep = {r["class"]: r for r in metrics.per_class_report(df, 3).collect()}
    assert (rep[2]["precision"], rep[2]["recall"], rep[2]["f1"], rep[2]["support"]) == (0, 0, 0, 0)
    assert rep[1]["precision"] == 0.5 and rep[1]["fpr"] == 0.5
    cm = {r["y"]: (r["p0"], r["p1"], r["p2"]) for r in metrics.confusion_matrix(df, 3).collect()}
    assert cm == {0: (1, 1, 0), 1: (0, 1, 0), 2: (0, 0, 0)}
    one = spark.createDataFrame([(1, 0.4)], "y int, s double")
    assert metrics.binary_auc(one, "y", "s").first()["AUC"] is None


def test_threshold_methods(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v,) for v in x], "error double")
    assert metrics.threshold(df, percentile=50).first()[0] == 3.0
    assert metrics.threshold(df, method="gaussian").first()[0] == pytest.approx(np.mean(x) + 3 * np.std(x))
    with pytest.raises(ValueError):
        metrics.threshold(df, method="other")
    flat = spark.createDataFrame([(2.0,)] * 3, "error double")
    assert metrics.error_histogram(flat, bins=4).agg(F.sum("n")).first()[0] == 3
    assert metrics.error_histogram(df.where("error > 9"), bins=4).count() == 0


def test_assignment(spark):
    df = spark.createDataFrame([(0, 2)] * 5 + [(1, 0)] * 4 + [(2, 1)] * 3 + [(2, 2)], "y int, cluster int")
    best = {r["cluster"]: r["y"] for r in metrics.best_assignment(metrics.contingency(df), 3).collect()}
    assert best == {2: 0, 0: 1, 1: 2}


def test_assignment_of_many_clusters(spark):
    """Eight clusters against all permutations of their counts."""
    rng = np.random.default_rng(5)
    n = rng.integers(0, 30, (8, 8))
    rows = [(y, c) for y in range(8) for c in range(8) for _ in range(n[y, c])]
    df = spark.createDataFrame(rows, "y int, cluster int")
    best = {r["cluster"]: r["y"] for r in metrics.best_assignment(metrics.contingency(df), 8).collect()}
    assert sorted(best) == sorted(best.values()) == list(range(8))
    assert sum(n[y, c] for c, y in best.items()) == max(sum(n[p[c], c] for c in range(8)) for p in itertools.permutations(range(8)))
