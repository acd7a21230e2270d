"""Exact ranks and percentiles against numpy, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.plans import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in (("hot", 30_000), ("mid", 900), ("tiny", 2), ("one", 1)):
        x = np.round(rng.lognormal(0, 2, n), 2)
        z = rng.integers(0, 4, n).astype(float)
        rows += [(g, i, float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(zip(x, z))]
    rows += [("empty", i, 1.5, None) for i in range(3)]
    return spark.createDataFrame(rows, "g string, i long, x double, z double").cache(), rows


def _expected(rows, p):
    out = {}
    for g in {r[0] for r in rows}:
        cols = [[r[c] for r in rows if r[0] == g and r[c] is not None] for c in (2, 3)]
        out[g] = tuple(float(np.percentile(c, p * 100)) if c else None for c in cols)
    return out


@pytest.mark.parametrize("p", [0.5, 0.97, 0.0, 1.0])
def test_grouped_percentiles(skewed, p):
    df, rows = skewed
    got = {r["g"]: (r["x"], r["z"]) for r in
           ranks.grouped_percentiles(df, ["x", "z"], ["g"], p).collect()}
    exp = _expected(rows, p)
    assert got.keys() == exp.keys()
    for g in exp:
        for a, b in zip(got[g], exp[g]):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    df, rows = skewed
    got = ranks.running_totals(df, "x", {"n": F.lit(1)}, ["g"], descending, parts=16).collect()
    for g in ("hot", "tiny"):
        x = np.array([r[2] for r in rows if r[0] == g])
        mine = {r["x"]: (r["n"], r["cum_n"], r["total_n"]) for r in got if r["g"] == g}
        assert len(mine) == len(set(x))
        for v in list(mine)[:200]:
            ahead = (x >= v).sum() if descending else (x <= v).sum()
            assert mine[v] == ((x == v).sum(), ahead, len(x))


def test_row_positions(skewed):
    df, _ = skewed
    got = ranks.row_positions(df, ["g"], ["i"], "pos", parts=16)
    assert got.where("pos <> i").count() == 0
    assert got.count() == df.count()


@pytest.mark.parametrize("p", [0.25, 0.5, 0.9])
def test_percentiles_of_odd_numbers(spark, p):
    """Values whose order only the last bits decide, infinities, both zeros, null groups and columns without values."""
    rng = np.random.default_rng(3)
    close = 1.0 + np.arange(400) * 2.0**-52
    groups = {"close": close, "signs": np.concatenate([rng.normal(0, 1e-300, 50), rng.normal(0, 1e300, 51), [0.0, -0.0]]),
              "ends": np.array([-np.inf, -5e-324, 5e-324, 1.7e308, np.inf]), None: rng.integers(-5, 5, 200).astype(float),
              "wide": rng.integers(0, 2**50, 5000).astype(float), "single": np.array([3.5])}
    rows = [(g, float(v), None) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows + [("none", None, None)], "g string, `x y` double, z double").repartition(4)
    got = {r["g"]: (r["x y"], r["z"]) for r in ranks.grouped_percentiles(df, ["x y", "z"], ["g"], p).collect()}
    assert got.keys() == groups.keys() | {"none"} and got["none"] == (None, None)
    for g, values in groups.items():
        values = np.sort(values)
        at = (len(values) - 1) * p
        a, b, w = values[int(np.floor(at))], values[int(np.ceil(at))], at - np.floor(at)
        assert got[g] == (a if a == b or w == 0 else (1 - w) * a + w * b, None), g


def test_percentiles_keep_nan_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "g string, x double")
    top = ranks.grouped_percentiles(df, ["x"], ["g"], 1.0).first()["x"]
    assert top != top and ranks.grouped_percentiles(df, ["x"], ["g"], 0.5).first()["x"] == 2.0


def test_vectors_of_any_length(spark):
    """Ragged, empty and missing vectors, with groups of several columns; cells are compared with numpy."""
    rng = np.random.default_rng(11)
    rows = [(g, h, [None if rng.random() < 0.2 else float(rng.integers(-9, 9)) / 4 for _ in range(rng.integers(0, 5))])
            for g in ("a", None, "b") for h in (1, 2) for _ in range(60)] + [("a", 1, None), ("none", 1, None), ("none", 2, [])]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(3)
    got = {(r["g"], r["h"], r["item"]): (r["v"], r["lo"], r["hi"]) for r in ranks.vector_percentiles(df, "v", ["g", "h"], 0.5).collect()}
    want = {("none", 1, None): (None,) * 3, ("none", 2, None): (None,) * 3}
    for g, h, v in rows:
        if not v:
            want[g, h, None] = (None,) * 3
        for i in range(len(v or [])):
            cells = [w[i] for a, b, w in rows if (a, b) == (g, h) and w and len(w) > i and w[i] is not None]
            want[g, h, i] = (float(np.median(cells)), min(cells), max(cells)) if cells else (None,) * 3
    assert got == want


def test_cells_are_counted_in_blocks(spark, capfd):
    """A pass over wide rows has no row a cell and no lambda: its tasks sort blocks of cells and hand on counts."""
    from flowquarry.plans import prepare
    flows = spark.range(10).select(F.lit("f").alias("source_file"), *[(F.col("id") * i).cast("string").alias(f"c{i}") for i in range(70)])
    rows = prepare.tidy(flows, [f"c{i}" for i in range(70)], ["source_file"])
    rows.explain("extended")
    assert "lambda" not in capfd.readouterr().out
    keep, ranks.materialize = ranks.materialize, lambda df: (df.explain(), keep(df))[1]
    try:
        ranks.vector_percentiles(rows, "features", ["source_file"], 0.5).count()
    finally:
        ranks.materialize = keep
    plans = capfd.readouterr().out
    assert "MapInArrow" in plans and "Generate" not in plans
