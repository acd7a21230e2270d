"""Long vectors are served and scored in Arrow batches, with the results of the plain expressions."""

import numpy as np

from flowquarry.functions import vectors as V
from flowquarry.operators.scale import Scaler
from flowquarry.plans import learn, prepare


def _plan(df, capfd):
    df.explain("extended")
    return capfd.readouterr().out


def test_long_scores_equal_expressions(spark, capfd):
    rng = np.random.default_rng(5)
    width = V.UNROLL + 25
    weights, bias = rng.normal(size=(3, width)).tolist(), rng.normal(size=3).tolist()
    rows = [(i, rng.normal(0, 10.0 ** rng.integers(-5, 6), width).tolist()) for i in range(300)]
    rows += [(900, None), (901, [1.0]), (902, [None, *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, rows[0][1] + [0.0]), (905, [])]
    df = spark.createDataFrame(rows, "id int, features array<double>").repartition(3)
    got = learn.linear_scores(df, weights, bias)
    assert "ArrowEvalPython" in _plan(got, capfd)
    want = {r["id"]: r["w"] for r in df.select("id", V.dense("features", weights, bias).alias("w")).collect()}
    assert {r["id"]: r["logits"] for r in got.collect()} == want


def test_serving_vectors(spark, capfd):
    cells = ["1.5", " 2 ", "x", "NaN", "Infinity", "-1e308", None]
    names = ["a", "b", "absent"]
    flows = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate((a, b) for a in cells for b in cells)],
                                  "source_file string, i int, a string, b string").repartition(3)
    scaler = Scaler(names, [0.0, 1.0, 0.0], [4.0, 1.0, 2.0], -1.0, 1e10)
    number = {"1.5": 1.5, " 2 ": 2.0, "-1e308": -1e308}
    for pad in (5, 2):
        out = prepare.serving_vectors(flows, scaler, names, ["i", "a", "b"], pad)
        if pad == 5:
            assert "lambda" not in _plan(out, capfd)
        for r in out.collect():
            want = []
            for i, raw in enumerate((r["a"], r["b"], None)):
                factor = (scaler.high - scaler.low) / ((scaler.maxs[i] - scaler.mins[i]) or 1.0)
                v = number.get(raw, 0.0) * factor + (scaler.low - scaler.mins[i] * factor)
                want.append(v if np.isfinite(v) else 0.0)
            assert r["features"] == (want + [0.0] * 5)[:pad], r
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_no_rows(spark):
    df = spark.createDataFrame([], "features array<double>")
    assert learn.linear_scores(df, [[1.0] * 40], [0.0]).count() == 0


def test_short_reconstruction_has_no_lambda(spark, capfd):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    mean, basis = rng.normal(size=5), rng.normal(size=(2, 5))
    out = learn.reconstruction_error(df, (mean, basis))
    assert "lambda" not in _plan(out, capfd)
    got = {r["id"]: r["error"] for r in out.collect()}
    for i, x in rows:
        back = (np.array(x) - mean) @ basis.T @ basis + mean
        assert abs(got[i] - np.mean((np.array(x) - back) ** 2)) < 1e-9
