"""Open-set scoring against a plain numpy evaluation of the formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import openmax as O
from flowquarry.sources.params import OpenMaxParams

K = 4


def formula(v, a, params, alpha, missing):
    """One row: probabilities over K+1 classes."""
    order = sorted(range(K), key=lambda k: (-v[k], k))
    z, lost = [], 0.0
    for k in range(K):
        weight = (alpha - order.index(k)) / alpha if order.index(k) < alpha else 0.0
        m = np.array(params.mav(k))
        if params.distance_type == "cosine":
            d = 1 - a @ m / max(np.linalg.norm(a) * np.linalg.norm(m), 1e-10)
        else:
            d = np.linalg.norm(a - m)
        w = params.weibull.get(k)
        om = missing if w is None else 1 - weight * (1 - np.exp(-(max(d, 0) / max(w[1], 1e-10)) ** w[0]))
        z.append(v[k] * om)
        lost += v[k] * (1 - om)
    z = np.array([*z, lost])
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(0, 4, (60, K))
    v[0], v[1] = [1, 1, 1, 1], [0, 0, 0, 0]
    pen = rng.normal(0, 1, (60, 20))
    df = spark.createDataFrame([(i, v[i].tolist(), pen[i].tolist()) for i in range(60)],
                               "id int, logits array<double>, penultimate array<double>").cache()
    return df, v, pen


@pytest.mark.parametrize("kind", ["cosine", "euclidean"])
@pytest.mark.parametrize("alpha", [1, 3, 7])
@pytest.mark.parametrize("missing", [1.0, 0.0])
def test_openmax(rows, kind, alpha, missing):
    df, v, pen = rows
    rng = np.random.default_rng(1)
    for vec, data, dim in ((None, v, K), ("penultimate", pen, 20)):
        p = OpenMaxParams(K, {k: rng.normal(0, 2, dim).tolist() for k in range(K - 1)},
                          {0: (2.0, 0.9), 1: (0.7, 1.8), 2: None}, kind)
        got = O.openmax(df, p, alpha, activations=vec, missing_omega=missing).orderBy("id").collect()
        for i, r in enumerate(got):
            exp = formula(v[i], data[i], p, alpha, missing)
            assert np.allclose(r["probabilities"], exp, atol=1e-9)
            assert exp[r["prediction"]] == pytest.approx(exp.max())


def test_weibull_fit():
    rng = np.random.default_rng(2)
    shape, scale = O.weibull_mle(3.0 * rng.weibull(2.5, 4000))
    assert shape == pytest.approx(2.5, rel=0.05) and scale == pytest.approx(3.0, rel=0.05)
    for bad in ([1.0, 2.0], [1.0, 1.0, 1.0], [0.0, 1.0, 2.0], [float("nan"), 1.0, 2.0]):
        assert O.weibull_mle(np.array(bad)) is None


def test_fit_tails(spark):
    rng = np.random.default_rng(4)
    data = {0: rng.random(300) + 0.1, 1: np.array([0.5, 0.7]), 2: np.full(5, 0.3)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs],
                               "y int, distance double")
    got = {(r["tail_size"], r["class"]): r for r in O.fit_weibull(df, [20, 500]).collect()}
    assert set(got) == {(t, k) for t in (20, 500) for k in range(3)}
    for t in (20, 500):
        exp = O.weibull_mle(np.sort(data[0])[::-1][:t])
        assert (got[t, 0]["wb_shape"], got[t, 0]["wb_scale"]) == pytest.approx(exp)
        assert got[t, 1]["wb_shape"] is None and got[t, 2]["wb_scale"] is None


def test_msp(rows):
    df, v, _ = rows
    got = O.msp_predict(df, 0.6, K).orderBy("id").collect()
    for i, r in enumerate(got):
        e = np.exp(v[i] - v[i].max())
        p = e / e.sum()
        full = np.append(p, 1 - p.max())
        assert r["prediction"] == (K if p.max() < 0.6 else int(p.argmax()))
        assert np.allclose(r["probabilities"], full / full.sum())


def test_sweep_matches_single_runs(rows, spark):
    df, v, _ = rows
    df = df.withColumn("y", F.least(F.col("id") % 5, F.lit(K)).cast("int")).withColumn(
        "is_known", F.col("y") < K)
    train = df.where("is_known")
    mavs = O.load_mavs(O.class_mavs(train, K), K)
    fits = O.fit_weibull(O.class_distances(train, mavs, "euclidean"), [3, 6], tie=["id"])
    sweep = {(r["tail_size"], r["alpha_rank"]): r for r in O.sweep_openmax(
        df, mavs, fits, K, "euclidean", [3, 6], [1, 3]).collect()}
    for tail in (3, 6):
        for alpha in (1, 3):
            p = O.fit_openmax(train, K, K, tail, "euclidean", alpha, tie=["id"])
            one = O.openmax(df, p, prediction="pred").where("not is_known")
            assert sweep[tail, alpha]["unknown_det"] == pytest.approx(
                one.agg(F.avg((F.col("pred") == K).cast("int"))).first()[0], abs=1e-4)
