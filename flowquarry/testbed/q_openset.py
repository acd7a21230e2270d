"""Open-set recognition and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import vectors as V
from flowquarry.operators import metrics, openmax
from flowquarry.plans import experiments, learn
from flowquarry.testbed import adapters as A
from flowquarry.testbed.q_metrics import rounded
from flowquarry.testbed.registry import query

K, D = A.KNOWN, A.DIM


def _flat(vec: str, dim: int) -> str:
    return (f"SELECT y AS class, list(m ORDER BY i) AS mav FROM (SELECT y, i, avg({vec}[i]) AS m FROM act, "
            f"(SELECT unnest(range(1, {dim + 1})) AS i) WHERE is_known GROUP BY 1, 2) GROUP BY 1")


MAV_SQL = f"act AS ({A.ACTIVATIONS_SQL}), mavs AS ({_flat('logits', K)})"
PEN_SQL = f"act AS ({A.ACTIVATIONS_SQL}), mavs AS ({_flat('penultimate', D)})"


def _cos(a: str, b: str) -> str:
    return (f"1 - list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) "
            f"* sqrt(list_inner_product({b}, {b})), 1e-10)")


EUC = "list_distance({a}, {b})"


def _dist(kind: str, a: str, b: str) -> str:
    return _cos(a, b) if kind == "cosine" else EUC.format(a=a, b=b)


def _own(kind: str, vec: str) -> str:
    return f"own AS (SELECT id, class, {_dist(kind, vec, 'mav')} AS d FROM act JOIN mavs ON y = class)"


def _fit(tails) -> str:
    """Weibull maximum likelihood by 200 bisections of the shape."""
    p = "list_sum(list_transform(z, lambda x: pow(x, {k})))"
    pl = "list_sum(list_transform(z, lambda x: pow(x, {k}) * ln(x)))"
    mid = "(lo + hi) / 2"
    slope = f"{pl.format(k=mid)} / {p.format(k=mid)} - 1 / ({mid}) - lz"
    return f"""tl AS (SELECT CAST(unnest({list(tails)}) AS INT) AS tail_size),
rk AS (SELECT class, d, row_number() OVER (PARTITION BY class ORDER BY d DESC, id) AS r FROM own),
tz AS (SELECT tail_size, class, list(d) AS x, max(d) AS top, min(d) AS low, count(*) AS tail_n
  FROM rk JOIN tl ON r <= tail_size GROUP BY 1, 2),
pr AS (SELECT *, list_transform(x, lambda v: v / top) AS z FROM tz WHERE tail_n >= 3 AND low > 0 AND low < top),
it AS (SELECT tail_size, class, top, z, list_avg(list_transform(z, lambda x: ln(x))) AS lz,
  CAST(1e-3 AS DOUBLE) AS lo, CAST(1e5 AS DOUBLE) AS hi, 0 AS i FROM pr
  UNION ALL SELECT tail_size, class, top, z, lz, CASE WHEN {slope} < 0 THEN {mid} ELSE lo END,
  CASE WHEN {slope} < 0 THEN hi ELSE {mid} END, i + 1 FROM it WHERE i < 100),
fit AS (SELECT tail_size, class, {mid} AS c, top * pow({p.format(k=mid)} / len(z), 1 / ({mid})) AS s
  FROM it WHERE i = 100)"""


def _score(alphas, missing: int = 1, drop: str = "false") -> str:
    """One row per (row, tail, alpha) with probabilities over K+1 classes."""
    return f"""al AS (SELECT CAST(unnest({list(alphas)}) AS INT) AS alpha),
kd AS (SELECT id, y, is_known, logits, class, logits[class + 1] AS v, {{dist}} AS d,
  len(list_filter(list_zip(logits, range({K})), lambda e: e[1] > logits[class + 1]
    OR (e[1] = logits[class + 1] AND e[2] < class))) AS rank
  FROM act, mavs),
gr AS (SELECT tail_size, alpha FROM tl, al),
om AS (SELECT id, y, is_known, gr.tail_size, gr.alpha, kd.class, v, CASE WHEN f.c IS NULL OR {drop} THEN {missing}
  ELSE 1 - (CASE WHEN rank < alpha THEN (alpha - rank) / alpha ELSE 0 END)
  * (1 - exp(-pow(greatest(d, 0) / greatest(f.s, 1e-10), f.c))) END AS w
  FROM kd JOIN gr ON true LEFT JOIN fit f ON f.tail_size = gr.tail_size AND f.class = kd.class),
ac AS (SELECT id, y, is_known, tail_size, alpha, list_append(list(v * w ORDER BY class), sum(v * (1 - w))) AS a
  FROM om GROUP BY 1, 2, 3, 4, 5),
ex AS (SELECT *, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM ac),
sc AS (SELECT id, y, is_known, tail_size, alpha, list_position(e, list_max(e)) - 1 AS pred,
  e[{K + 1}] / list_sum(e) AS p_unknown, list_max(e) / list_sum(e) AS p_best FROM ex)"""


def _sql(kind: str, vec: str, tails, alphas, mav=MAV_SQL, **o) -> str:
    return (f"WITH RECURSIVE {mav}, {_own(kind, vec)}, {_fit(tails)}, "
            + _score(alphas, **o).replace("{dist}", _dist(kind, vec, "mav")))


PICK = """ SELECT id, CAST(pred AS INT) AS pred, round(p_unknown, 6) AS p_unknown,
round(p_best, 6) AS p_best FROM sc"""


def _picked(df):
    return df.select("id", "pred", F.round(F.element_at("probabilities", -1), 6).alias("p_unknown"),
                     F.round(F.array_max("probabilities"), 6).alias("p_best"))


def _train(spark, sf):
    return A.activations(spark, sf).where("is_known")


def _params(spark, sf, kind, tail=20, vec="logits", dim=K, alpha=5):
    return openmax.fit_openmax(_train(spark, sf), K, dim, tail, kind, alpha, vec=vec, tie=["id"])


# --- vector algebra ---------------------------------------------------------------------------------

@query("x5_row_mse", f"""WITH act AS ({A.ACTIVATIONS_SQL}) SELECT id,
round(pow(list_distance(logits, penultimate[9:16]), 2) / 8, 6) AS mse FROM act""")
def _(spark, sf):
    a = A.activations(spark, sf)
    return a.select("id", F.round(V.mse(F.col("logits"), F.slice("penultimate", 9, 8)), 6)
                    .alias("mse"))


@query("x6_distances", f"""WITH act AS ({A.ACTIVATIONS_SQL}) SELECT id,
round(list_inner_product(penultimate[1:32], penultimate[33:64]), 6) AS dot,
round(sqrt(list_inner_product(penultimate, penultimate)), 6) AS norm,
round({_cos('penultimate[1:32]', 'penultimate[33:64]')}, 6) AS cosine,
round(list_distance(penultimate[1:32], penultimate[33:64]), 6) AS euclidean FROM act""")
def _(spark, sf):
    a, b = F.slice("penultimate", 1, 32), F.slice("penultimate", 33, 32)
    return A.activations(spark, sf).select(
        "id", F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.norm(F.col("penultimate")), 6).alias("norm"),
        F.round(V.cosine_distance(a, b), 6).alias("cosine"),
        F.round(V.euclidean_distance(a, b), 6).alias("euclidean"))


def _weights(rows: int, cols: int):
    """Fixed test weights: entry (r, c) is ((7r + 3c) mod 11 - 5) / 10."""
    return [[((7 * r + 3 * c) % 11 - 5) / 10 for c in range(cols)] for r in range(rows)]


DENSE = (f"list_transform(range(3), lambda r: list_sum(list_transform(range({D}), lambda c: "
         f"penultimate[c + 1] * ((7 * r + 3 * c) % 11 - 5) / 10)) + r)")


@query("x7_dense_layer", f"""WITH act AS ({A.ACTIVATIONS_SQL}), z AS (SELECT id, {DENSE} AS z FROM act)
SELECT id, round(z[1], 6) AS z0, round(z[2], 6) AS z1, round(z[3], 6) AS z2 FROM z""")
def _(spark, sf):
    z = learn.linear_scores(A.activations(spark, sf), _weights(3, D), [0, 1, 2], "penultimate", "z")
    return z.select("id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(3)])


@query("x8_softmax_argmax", f"""WITH act AS ({A.ACTIVATIONS_SQL}),
e AS (SELECT id, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM act)
SELECT id, round(list_max(e) / list_sum(e), 6) AS top, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS best FROM e""")
def _(spark, sf):
    return A.activations(spark, sf).select(
        "id", F.round(F.array_max(V.softmax(F.col("logits"))), 6).alias("top"),
        V.argmax(F.col("logits")).alias("best"))


@query("x9_weibull_cdf", """SELECT l_orderkey, l_linenumber,
round(1 - exp(-pow(l_quantity / 20, 1.5)), 6) AS cdf FROM lineitem""")
def _(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(V.weibull_cdf(
            F.col("l_quantity"), F.lit(1.5), F.lit(20.0)), 6).alias("cdf"))


@query("x13_with_unknown", f"""WITH act AS ({A.ACTIVATIONS_SQL}),
e AS (SELECT id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM act),
p AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT id, round((1 - list_max(p)) / (list_sum(p) + 1 - list_max(p)), 6) AS p_unknown FROM p""")
def _(spark, sf):
    p = V.with_unknown(V.softmax(F.col("logits")))
    return A.activations(spark, sf).select("id", F.round(F.element_at(p, -1), 6).alias("p_unknown"))


@query("w1_rank_within_row", f"""WITH act AS ({A.ACTIVATIONS_SQL}) SELECT id, CAST(k AS INT) AS k,
CAST(len(list_filter(list_zip(logits, range({K})), lambda e: e[1] > logits[k + 1]
 OR (e[1] = logits[k + 1] AND e[2] < k))) AS INT) AS rank FROM act, (SELECT unnest(range({K})) AS k)""")
def _(spark, sf):
    rows = openmax.with_ranks(A.activations(spark, sf), "logits", K)
    return rows.select("id", F.posexplode("ranks").alias("k", "rank"))


@query("m7_rank_alpha", f"""WITH act AS ({A.ACTIVATIONS_SQL}), r AS (SELECT id, k,
len(list_filter(list_zip(logits, range({K})), lambda e: e[1] > logits[k + 1]
 OR (e[1] = logits[k + 1] AND e[2] < k))) AS rank FROM act, (SELECT unnest(range({K})) AS k))
SELECT id, CAST(k AS INT) AS k, CAST(CASE WHEN rank < 5 THEN (5 - rank) / 5 ELSE 0 END AS DOUBLE) AS alpha FROM r""")
def _(spark, sf):
    rows = openmax.with_ranks(A.activations(spark, sf), "logits", K)
    weights = [openmax.rank_alpha_sql("ranks", k, "5") for k in range(K)]
    return rows.select("id", F.posexplode(F.expr(f"array({', '.join(weights)})"))
                       .alias("k", "alpha"))


# --- fitting ----------------------------------------------------------------------------------------

@query("a6_class_mavs", f"""WITH {PEN_SQL} SELECT CAST(class AS INT) AS class, CAST(i - 1 AS INT) AS i,
round(mav[i], 6) AS v FROM mavs, (SELECT unnest(range(1, {D + 1})) AS i)""")
def _(spark, sf):
    m = openmax.class_mavs(_train(spark, sf), D, vec="penultimate")
    return m.select("class", F.posexplode("mav").alias("i", "v")).withColumn("v", F.round("v", 6))


@query("m5_class_distances", f"""WITH {MAV_SQL}, {_own('cosine', 'logits')}, oe AS (SELECT id,
{_dist('euclidean', 'logits', 'mav')} AS e FROM act JOIN mavs ON y = class)
SELECT id, CAST(class AS INT) AS class, round(d, 6) AS cosine, round(e, 6) AS euclidean FROM own JOIN oe USING (id)""")
def _(spark, sf):
    rows = _train(spark, sf)
    mavs = openmax.load_mavs(openmax.class_mavs(rows, K), K)
    both = openmax.class_distances(rows, mavs, "cosine", out="cosine")
    both = openmax.class_distances(both, mavs, "euclidean", out="euclidean")
    return both.select("id", F.col("y").alias("class"), F.round("cosine", 6).alias("cosine"),
                       F.round("euclidean", 6).alias("euclidean"))


@query("j6_class_distance_vector", f"""WITH {PEN_SQL} SELECT id, CAST(class AS INT) AS class,
round({_cos('penultimate', 'mav')}, 6) AS d FROM act, mavs""")
def _(spark, sf):
    rows = A.activations(spark, sf)
    mavs = openmax.load_mavs(openmax.class_mavs(rows.where("is_known"), D, vec="penultimate"), K)
    d = openmax.class_distance_vector(rows, openmax.OpenMaxParams(K, mavs), "penultimate")
    return d.select("id", F.posexplode("distances").alias("class", "d")).withColumn(
        "d", F.round("d", 6))


@query("w2_largest_distances", f"""WITH {MAV_SQL}, {_own('euclidean', 'logits')},
r AS (SELECT class, d, row_number() OVER (PARTITION BY class ORDER BY d DESC, id) AS rank FROM own)
SELECT CAST(class AS INT) AS class, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def _(spark, sf):
    rows = _train(spark, sf)
    mavs = openmax.load_mavs(openmax.class_mavs(rows, K), K)
    top = openmax.largest_distances(openmax.class_distances(rows, mavs, "euclidean"), 20, tie=["id"])
    return top.withColumn("distance", F.round("distance", 6))


@query("m6_fit_weibull", f"""WITH RECURSIVE {MAV_SQL}, {_own('euclidean', 'logits')}, {_fit([5, 20, 50])}
SELECT tail_size, CAST(class AS INT) AS class, round(c, 4) AS wb_shape, round(s, 4) AS wb_scale FROM fit""")
def _(spark, sf):
    rows = _train(spark, sf)
    mavs = openmax.load_mavs(openmax.class_mavs(rows, K), K)
    fits = openmax.fit_weibull(openmax.class_distances(rows, mavs, "euclidean"), [5, 20, 50],
                               tie=["id"])
    return fits.select("tail_size", "class", F.round("wb_shape", 4).alias("wb_shape"),
                       F.round("wb_scale", 4).alias("wb_scale"))


# --- prediction --------------------------------------------------------------------------------------

@query("m9_openmax", _sql("euclidean", "logits", [20], [5]) + PICK)
def _(spark, sf):
    return _picked(openmax.openmax(A.activations(spark, sf), _params(spark, sf, "euclidean"),
                                   prediction="pred"))


@query("m9_openmax_cosine", _sql("cosine", "logits", [20], [3]) + PICK)
def _(spark, sf):
    p = _params(spark, sf, "cosine")
    return _picked(openmax.openmax(A.activations(spark, sf), p, 3, prediction="pred"))


@query("m8_omega_missing_class", _sql("euclidean", "logits", [20], [5], drop="kd.class = 3") + PICK)
def _(spark, sf):
    p = _params(spark, sf, "euclidean")
    p.weibull[3] = None
    return _picked(openmax.openmax(A.activations(spark, sf), p, prediction="pred"))


@query("m10_openmax_single", _sql("euclidean", "logits", [20], [5], missing=0, drop="kd.class = 3") + PICK)
def _(spark, sf):
    p = _params(spark, sf, "euclidean")
    p.weibull[3] = None
    return _picked(openmax.openmax_single(A.activations(spark, sf), p, prediction="pred"))


@query("m11_hybrid_openmax", _sql("cosine", "penultimate", [20], [5], PEN_SQL) + PICK)
def _(spark, sf):
    p = _params(spark, sf, "cosine", vec="penultimate", dim=D)
    return _picked(openmax.hybrid_openmax(A.activations(spark, sf), p, prediction="pred"))


MSP = f"""act AS ({A.ACTIVATIONS_SQL}), e AS (SELECT id, y, is_known,
list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM act),
p AS (SELECT id, y, is_known, list_max(e) / list_sum(e) AS top, list_position(e, list_max(e)) - 1 AS best FROM e)"""


@query("m12_msp_predict", f"""WITH {MSP} SELECT id, CAST(CASE WHEN top < 0.5 THEN {K} ELSE best END AS INT) AS pred,
round((1 - top) / (2 - top), 6) AS p_unknown, round(greatest(top, 1 - top) / (2 - top), 6) AS p_best FROM p""")
def _(spark, sf):
    return _picked(openmax.msp_predict(A.activations(spark, sf), 0.5, K, prediction="pred"))


def _sweep_cols(pred: str) -> str:
    ka = f"count(*) FILTER (is_known AND {pred} <> {K} AND {pred} = y) / count(*) FILTER (is_known)"
    ud = f"count(*) FILTER (NOT is_known AND {pred} = {K}) / count(*) FILTER (NOT is_known)"
    return (f"round({ka}, 4) AS known_acc, round({ud}, 4) AS unknown_det, "
            f"round(CASE WHEN {ka} + {ud} = 0 THEN 0 ELSE 2 * ({ka}) * ({ud}) / ({ka} + {ud}) END, 4) AS h_score")


@query("m13_sweep_msp", f"""WITH {MSP}, t AS (SELECT unnest(range(25, 50)) / 50 AS threshold),
a AS (SELECT *, CASE WHEN top < threshold THEN {K} ELSE best END AS pred FROM p, t)
SELECT threshold, {_sweep_cols('pred')} FROM a GROUP BY 1""")
def _(spark, sf):
    return openmax.sweep_msp(A.activations(spark, sf), K)


SWEEP_OUT = f""" SELECT tail_size, alpha AS alpha_rank, {_sweep_cols('pred')} FROM sc GROUP BY 1, 2"""


def _sweep(spark, sf, kind, vec, dim, tails, alphas):
    rows = A.activations(spark, sf)
    train = rows.where("is_known")
    mavs = openmax.load_mavs(openmax.class_mavs(train, dim, vec=vec), K)
    fits = openmax.fit_weibull(openmax.class_distances(train, mavs, kind, vec=vec), tails, tie=["id"])
    return openmax.sweep_openmax(rows, mavs, fits, K, kind, tails, alphas,
                                 activations=None if vec == "logits" else vec)


@query("m14_sweep_openmax", _sql("euclidean", "logits", openmax.SWEEP_TAILS, openmax.SWEEP_ALPHAS) + SWEEP_OUT)
def _(spark, sf):
    return _sweep(spark, sf, "euclidean", "logits", K, openmax.SWEEP_TAILS, openmax.SWEEP_ALPHAS)


@query("m14_sweep_hybrid",
       _sql("cosine", "penultimate", openmax.SMALL_SWEEP_TAILS, openmax.SMALL_SWEEP_ALPHAS, PEN_SQL) + SWEEP_OUT)
def _(spark, sf):
    return _sweep(spark, sf, "cosine", "penultimate", D, openmax.SMALL_SWEEP_TAILS,
                  openmax.SMALL_SWEEP_ALPHAS)


@query("t5_best_sweep_rows", f"""WITH {MSP}, t AS (SELECT unnest(range(25, 50)) / 50 AS threshold),
a AS (SELECT *, CASE WHEN top < threshold THEN {K} ELSE best END AS pred FROM p, t)
SELECT threshold, {_sweep_cols('pred')} FROM a GROUP BY 1 ORDER BY h_score DESC, threshold LIMIT 10""")
def _(spark, sf):
    return metrics.best_rows(openmax.sweep_msp(A.activations(spark, sf), K), 10, ["threshold"])


# --- models ------------------------------------------------------------------------------------------

@query("m1_score", f"""WITH act AS ({A.ACTIVATIONS_SQL}), z AS (SELECT id, {DENSE} AS z FROM act)
SELECT id, round(z[1], 6) AS z0, round(z[2], 6) AS z1, round(z[3], 6) AS z2 FROM z""")
def _(spark, sf):
    import numpy as np
    w, b = np.array(_weights(3, D)), np.array([0.0, 1.0, 2.0])
    z = learn.score(A.activations(spark, sf), lambda x: x @ w.T + b, "penultimate", "z")
    return z.select("id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(3)])


@query("m2_train_classifier")
def _(spark, sf):
    rows = _train(spark, sf)
    model = learn.train_classifier(rows, K, "penultimate")
    scored = learn.classifier_logits(model, rows, "penultimate")
    return metrics.overall_accuracy(scored.withColumn("pred", V.argmax(F.col("logits"))))


@query("m20_classifier_eval", f"""WITH act AS ({A.ACTIVATIONS_SQL}),
b AS (SELECT y, list_position(logits, list_max(logits)) - 1 AS pred FROM act WHERE is_known),
d AS (SELECT CAST(unnest(range({K})) AS INT) AS class),
r AS (SELECT class, (SELECT count(*) FROM b WHERE y = class) AS support,
 (SELECT count(*) FROM b WHERE pred = class) AS predicted, (SELECT count(*) FROM b WHERE y = class AND pred = class) AS tp,
 (SELECT count(*) FROM b) AS total FROM d)
SELECT class, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS precision,
round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 6) AS recall,
round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END, 6) AS f1,
round((predicted - tp) / (total - support), 6) AS fpr, support FROM r""")
def _(spark, sf):
    return rounded(learn.classifier_eval(_train(spark, sf), K), "precision", "recall", "f1", "fpr")


@query("m3_reconstruction_error")
def _(spark, sf):
    rows = A.activations(spark, sf)
    model = learn.fit_reconstruction(rows.where("y = 0"), 8, "penultimate")
    scored = learn.reconstruction_error(rows, model, "penultimate")
    return scored.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query("m17_cluster_discovery")
def _(spark, sf):
    found = learn.cluster_discovery(_train(spark, sf), 8, "penultimate")
    match = metrics.best_assignment(metrics.contingency(found), 8)
    return metrics.overall_accuracy(metrics.apply_assignment(found, match))


@query("e2_open_set_experiment")
def _(spark, sf):
    rows = A.activations(spark, sf).drop("logits").withColumnRenamed("penultimate", "features")
    return experiments.open_set_experiment(rows, K, D)["methods"]


@query("e3_autoencoder_experiment")
def _(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(
        F.expr(A.SOURCE_FILE).alias("source_file"),
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10,
                F.col("l_tax") * 10, F.col("l_linenumber") / 7.0).alias("features"))
    out = experiments.autoencoder_experiment(rows, [2, 3], F.col("source_file") == A.BENIGN_FILE,
                                             "source_file")
    return out["summary"]
