"""Evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import vectors as V
from flowquarry.operators import metrics
from flowquarry.plans import ranks
from flowquarry.testbed import adapters as A
from flowquarry.testbed.registry import query


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a1_label_distribution", f"""SELECT "Label", count(*) AS n FROM ({A.FLOWS_SQL}) GROUP BY 1""")
def _(spark, sf):
    return metrics.label_distribution(A.flows(spark, sf))


@query("a1_normal_attack_totals", f"""SELECT count(*) FILTER ("Label" = 'BENIGN') AS normal,
count(*) FILTER ("Label" <> 'BENIGN') AS attack FROM ({A.FLOWS_SQL})""")
def _(spark, sf):
    return metrics.normal_attack_totals(A.flows(spark, sf))


# --- thresholds -------------------------------------------------------------------------------

P97 = f"""SELECT source_file, round(quantile_cont(error, 0.97), 6) AS threshold FROM ({A.SCORES_SQL})
GROUP BY 1"""


@query("a7_threshold_percentile", f"""SELECT round(quantile_cont(error, 0.95), 6) AS threshold
FROM ({A.SCORES_SQL})""")
def _(spark, sf):
    return rounded(metrics.threshold(A.scores(spark, sf), percentile=95), "threshold")


@query("a7_threshold_by_file", P97)
def _(spark, sf):
    return rounded(metrics.threshold(A.scores(spark, sf), by=["source_file"]), "threshold")


@query("a7_threshold_by_file_narrowed", P97)
def _(spark, sf):
    return rounded(metrics.threshold(A.scores(spark, sf), by=["source_file"]).where("threshold IS NOT NULL"), "threshold")


@query("a8_threshold_gaussian", f"""SELECT round(avg(error) + 3 * stddev_pop(error), 4) AS threshold
FROM ({A.SCORES_SQL})""")
def _(spark, sf):
    return rounded(metrics.threshold(A.scores(spark, sf), method="gaussian"), "threshold", digits=4)


@query("a9_error_histogram", f"""WITH s AS ({A.SCORES_SQL}), e AS (SELECT min(error) AS lo, max(error) AS hi FROM s),
b AS (SELECT CAST(least(floor((error - lo) / ((hi - lo) / 100)), 99) AS INT) AS bin, count(*) AS n
  FROM s, e GROUP BY 1),
r AS (SELECT CAST(unnest(range(100)) AS INT) AS bin)
SELECT r.bin, round(lo + r.bin * ((hi - lo) / 100), 6) AS lo, round(lo + (r.bin + 1) * ((hi - lo) / 100), 6) AS hi,
coalesce(n, 0) AS n FROM r LEFT JOIN b ON r.bin = b.bin, e""")
def _(spark, sf):
    return rounded(metrics.error_histogram(A.scores(spark, sf)), "lo", "hi")


@query("m4_anomaly_flag", f"""SELECT source_file, error > 250 AS is_anomaly, count(*) AS n
FROM ({A.SCORES_SQL}) GROUP BY 1, 2""")
def _(spark, sf):
    return metrics.anomaly_flag(A.scores(spark, sf), 250.0).groupBy(
        "source_file", "is_anomaly").agg(F.count("*").alias("n"))


# --- binary -----------------------------------------------------------------------------------

CONFUSION = f"""c AS (SELECT source_file, count(*) FILTER (y = 1 AND error > 250) AS "TP",
count(*) FILTER (y = 0 AND NOT error > 250) AS "TN", count(*) FILTER (y = 0 AND error > 250) AS "FP",
count(*) FILTER (y = 1 AND NOT error > 250) AS "FN" FROM ({A.SCORES_SQL}) GROUP BY 1)"""
METRICS = """round(("TP" + "TN") / ("TP" + "TN" + "FP" + "FN"), 6) AS "Accuracy",
round(CASE WHEN "TP" + "FP" = 0 THEN 0 ELSE "TP" / ("TP" + "FP") END, 6) AS "Precision",
round(CASE WHEN "TP" + "FN" = 0 THEN 0 ELSE "TP" / ("TP" + "FN") END, 6) AS "Recall",
round(CASE WHEN 2 * "TP" + "FP" + "FN" = 0 THEN 0 ELSE 2 * "TP" / (2 * "TP" + "FP" + "FN") END, 6) AS "F1\""""


@query("a10_binary_confusion", f"WITH {CONFUSION} SELECT * FROM c")
def _(spark, sf):
    return metrics.binary_confusion(A.scores(spark, sf), "y", "error", 250.0, ["source_file"])


@query("a11_binary_metrics", f"WITH {CONFUSION} SELECT *, {METRICS} FROM c")
def _(spark, sf):
    c = metrics.binary_confusion(A.scores(spark, sf), "y", "error", 250.0, ["source_file"])
    return rounded(metrics.binary_metrics(c), "Accuracy", "Precision", "Recall", "F1")


def _auc_sql(rows: str, by: str) -> str:
    return f"""g AS (SELECT {by}, error, sum(y) AS pos, sum(1 - y) AS neg FROM ({rows}) GROUP BY {by}, error),
k AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY error) AS cum FROM g),
auc AS (SELECT {by}, round(sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)), 6) AS "AUC" FROM k GROUP BY {by})"""


@query("a12_binary_auc", f"WITH {_auc_sql(A.SCORES_SQL, 'source_file')} SELECT * FROM auc")
def _(spark, sf):
    return rounded(metrics.binary_auc(A.scores(spark, sf), "y", "error", ["source_file"]), "AUC")


@query("a12_binary_auc_overall", f"""WITH {_auc_sql(f"SELECT *, 1 AS g0 FROM ({A.SCORES_SQL})", 'g0')}
SELECT "AUC" FROM auc""")
def _(spark, sf):
    return rounded(metrics.binary_auc(A.scores(spark, sf), "y", "error"), "AUC")


def _runs_sql(scores: str) -> str:
    """Per (model, attack file) metrics against all benign rows of the model."""
    return f"""s AS ({scores}),
f AS (SELECT DISTINCT model, source_file AS attack FROM s WHERE source_file <> '{A.BENIGN_FILE}'),
u AS (SELECT model, source_file AS attack, error, 1 AS y FROM s WHERE source_file <> '{A.BENIGN_FILE}'
  UNION ALL SELECT s.model, attack, error, 0 FROM s JOIN f ON s.model = f.model
  WHERE source_file = '{A.BENIGN_FILE}'),
c AS (SELECT model AS "Model", attack AS "Attack", count(*) FILTER (y = 1 AND error > 250) AS "TP",
  count(*) FILTER (y = 0 AND NOT error > 250) AS "TN", count(*) FILTER (y = 0 AND error > 250) AS "FP",
  count(*) FILTER (y = 1 AND NOT error > 250) AS "FN" FROM u GROUP BY 1, 2),
{_auc_sql("SELECT * FROM u", "model, attack")},
runs AS (SELECT c."Model", c."Attack", CAST(250 AS DOUBLE) AS "Threshold", {METRICS}, "AUC", "TP", "TN", "FP", "FN"
  FROM c JOIN auc ON c."Model" = auc.model AND c."Attack" = auc.attack)"""


SECOND = A.SCORES_SQL.replace("l_extendedprice / 1000, 0", "l_quantity, 0")
ONE_SQL = _runs_sql(f"SELECT *, 'm1' AS model FROM ({A.SCORES_SQL})")
TWO_SQL = _runs_sql(f"SELECT *, 'm1' AS model FROM ({A.SCORES_SQL}) UNION ALL "
                    f"SELECT *, 'm2' AS model FROM ({SECOND})")


def _run(scores):
    return metrics.evaluate_per_file(scores, 250.0, benign=F.col("source_file") == A.BENIGN_FILE)


def _second(spark, sf):
    cols = [(n, e.replace("l_extendedprice / 1000", "l_quantity")) for n, e in A.SCORES]
    return A.build(A.table(spark, sf, "lineitem"), cols)


def _runs(spark, sf):
    return metrics.tag_union({"m1": _run(A.scores(spark, sf)), "m2": _run(_second(spark, sf))})


SCORE_COLS = ["Accuracy", "Precision", "Recall", "F1", "AUC"]


@query("a24_evaluate_per_file", f'WITH {ONE_SQL} SELECT * EXCLUDE ("Model") FROM runs')
def _(spark, sf):
    return rounded(_run(A.scores(spark, sf)), *SCORE_COLS)


@query("j7_benign_reuse", f"""WITH {ONE_SQL} SELECT count(DISTINCT "TN" + "FP") AS benign_sizes,
CAST(sum("TP" + "FN") AS BIGINT) AS attack_rows FROM runs""")
def _(spark, sf):
    return _run(A.scores(spark, sf)).agg(
        F.count_distinct(F.col("TN") + F.col("FP")).alias("benign_sizes"),
        F.sum(F.col("TP") + F.col("FN")).alias("attack_rows"))


@query("u2_tagged_union", f'WITH {TWO_SQL} SELECT "Model", "Attack", "TP", "FN" FROM runs')
def _(spark, sf):
    return _runs(spark, sf).select("Model", "Attack", "TP", "FN")


AVGS = ", ".join(f'round(avg("{c}"), 4) AS "{c}"' for c in SCORE_COLS)


@query("a25_model_summary", f'WITH {TWO_SQL} SELECT "Model", {AVGS} FROM runs GROUP BY 1')
def _(spark, sf):
    return rounded(metrics.model_summary(_runs(spark, sf)), *SCORE_COLS, digits=4)


@query("a26_model_ranking", f"""WITH {TWO_SQL} SELECT "Model", round(avg("Recall"), 4) AS mean_recall,
round(avg("F1"), 4) AS mean_f1, round(avg("AUC"), 4) AS mean_auc,
round(avg("Accuracy"), 4) AS mean_accuracy, round(min("Recall"), 4) AS worst_recall FROM runs GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.model_ranking(_runs(spark, sf)), "mean_recall", "mean_f1", "mean_auc",
                   "mean_accuracy", "worst_recall", digits=4)


@query("a27_recall_pivot", f"""WITH {TWO_SQL} SELECT "Attack", max("Recall") FILTER ("Model" = 'm1') AS m1,
max("Recall") FILTER ("Model" = 'm2') AS m2 FROM runs GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.recall_pivot(_runs(spark, sf), ["m1", "m2"]), "m1", "m2")


# --- multi-class ---------------------------------------------------------------------------------

K = A.NUM_CLASSES
CELLS = f"""x AS ({A.CLASSED_SQL}), d AS (SELECT CAST(unnest(range({K})) AS INT) AS class),
r AS (SELECT class, (SELECT count(*) FROM x WHERE y = class) AS support,
 (SELECT count(*) FROM x WHERE pred = class) AS predicted,
 (SELECT count(*) FROM x WHERE y = class AND pred = class) AS tp, (SELECT count(*) FROM x) AS total FROM d),
rep AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
 CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
 CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1,
 CASE WHEN total = support THEN 0 ELSE (predicted - tp) / (total - support) END AS fpr, support FROM r)"""
REP = ["precision", "recall", "f1", "fpr"]
REP_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in REP)


@query("a13_confusion_matrix", f"""WITH {CELLS} SELECT class AS y, {', '.join(
    f'(SELECT count(*) FROM x WHERE y = class AND pred = {i}) AS p{i}' for i in range(K))} FROM d""")
def _(spark, sf):
    return metrics.confusion_matrix(A.classed(spark, sf), K)


@query("a14_per_class_report", f"WITH {CELLS} SELECT class, {REP_SQL}, support FROM rep")
def _(spark, sf):
    return rounded(metrics.per_class_report(A.classed(spark, sf), K), *REP)


@query("a15_per_class_fpr", f"WITH {CELLS} SELECT class, round(fpr, 6) AS fpr FROM rep")
def _(spark, sf):
    return rounded(metrics.per_class_fpr(A.classed(spark, sf), K), "fpr")


def _weighted(weight: str) -> str:
    return ", ".join(f"round(sum({c} * {weight}) / sum({weight}), 6) AS {c}" for c in REP)


def _averages(weight: str) -> str:
    return f"""WITH {CELLS} SELECT CAST(class AS STRING) AS class, {REP_SQL}, support FROM rep
UNION ALL SELECT 'Macro Avg', {', '.join(f'round(avg({c}), 6)' for c in REP)}, CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'Weighted Avg', {_weighted(weight)}, CAST(sum(support) AS BIGINT) FROM rep"""


@query("a16_macro_weighted_rows", _averages("greatest(support, 1)"))
def _(spark, sf):
    rep = metrics.per_class_report(A.classed(spark, sf), K)
    return rounded(metrics.macro_weighted_rows(rep), *REP)


@query("a16_macro_weighted_by_support", _averages("support"))
def _(spark, sf):
    rep = metrics.per_class_report(A.classed(spark, sf), K)
    return rounded(metrics.macro_weighted_rows(rep, floor=0), *REP)


@query("a17_overall_accuracy", f"""SELECT is_known, round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 6)
AS accuracy FROM ({A.CLASSED_SQL}) GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.overall_accuracy(A.classed(spark, sf), by=["is_known"]), "accuracy")


# --- curves ----------------------------------------------------------------------------------------

RANK_K = 4
OVR = f"""o AS ({" UNION ALL ".join(
    f"SELECT {i} AS class, CAST(s{i} AS DOUBLE) AS score, CASE WHEN y = {i} THEN 1 ELSE 0 END AS hit FROM ({A.RANKED_SQL})"
    for i in range(RANK_K))}),
g AS (SELECT class, score, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(1 - hit) AS BIGINT) AS fp FROM o GROUP BY 1, 2),
k AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY class) AS p,
 sum(fp) OVER (PARTITION BY class) AS n FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
pts AS (SELECT * FROM k WHERE p > 0)"""


def _points(spark, sf):
    return metrics.curve_points(metrics.one_vs_rest(A.ranked(spark, sf), RANK_K))


@query("x14_one_hot", f"""WITH r AS ({A.RANKED_SQL}) SELECT y, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS h0,
CAST(sum(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS BIGINT) AS h2 FROM r GROUP BY 1""")
def _(spark, sf):
    h = A.ranked(spark, sf).withColumn("h", V.one_hot(F.col("y"), 3))
    return h.groupBy("y").agg(F.sum(F.col("h")[0]).alias("h0"), F.sum(F.col("h")[2]).alias("h2"))


@query("w3_running_totals", f"""WITH {OVR} SELECT CAST(class AS INT) AS class, score, tp, CAST(ctp AS BIGINT) AS cum_tp,
CAST(cfp AS BIGINT) AS cum_fp FROM pts""")
def _(spark, sf):
    return _points(spark, sf).select("class", "score", "tp", "cum_tp", "cum_fp")


@query("a18_roc_curve", f"""WITH {OVR} SELECT CAST(class AS INT) AS class, score, round(cfp / n, 6) AS fpr,
round(ctp / p, 6) AS tpr FROM pts UNION ALL
SELECT DISTINCT CAST(class AS INT), CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM pts""")
def _(spark, sf):
    return rounded(metrics.roc_curve(_points(spark, sf)), "fpr", "tpr")


@query("a18_auc_per_class", f"""WITH {OVR} SELECT CAST(class AS INT) AS class,
round(sum(fp * (ctp - tp / 2)) / (max(p) * max(n)), 6) AS auc FROM pts GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.auc_per_class(_points(spark, sf)), "auc")


# points with their FPR, the highest TPR per FPR, then the neighbours of every grid position
INTERP = f"""{OVR}, c AS (SELECT class, cfp / n AS x, max(ctp / p) AS y, min(ctp / p) AS y_in FROM pts GROUP BY 1, 2
 UNION ALL SELECT DISTINCT class, 0, coalesce((SELECT max(ctp / p) FROM pts q WHERE q.class = pts.class AND cfp = 0), 0), 0
 FROM pts WHERE class NOT IN (SELECT class FROM pts WHERE cfp = 0)),
m AS (SELECT *, lead(x) OVER (PARTITION BY class ORDER BY x) AS x1, lead(y_in) OVER (PARTITION BY class ORDER BY x) AS y1 FROM c),
gr AS (SELECT CAST(unnest(range(200)) AS INT) AS pos),
it AS (SELECT class, pos, pos / 199 AS xg, CASE WHEN x1 IS NULL THEN y
  ELSE y + (pos / 199 - x) * (y1 - y) / (x1 - x) END AS tpr
  FROM m JOIN gr ON pos / 199 >= x AND (x1 IS NULL OR pos / 199 < x1))"""


@query("j8_roc_interp", f"""WITH {INTERP} SELECT CAST(class AS INT) AS class, pos, round(xg, 6) AS x,
round(tpr, 6) AS tpr FROM it""")
def _(spark, sf):
    return rounded(metrics.roc_interp(_points(spark, sf)), "x", "tpr")


@query("a19_macro_roc", f"""WITH {INTERP}, a AS (SELECT pos, xg, avg(tpr) AS t FROM it GROUP BY 1, 2),
l AS (SELECT (xg - lag(xg) OVER (ORDER BY pos)) * (t + lag(t) OVER (ORDER BY pos)) / 2 AS s FROM a)
SELECT round(sum(s), 6) AS auc FROM l""")
def _(spark, sf):
    curve = metrics.macro_roc(metrics.roc_interp(_points(spark, sf)))
    return rounded(metrics.trapezoid(curve), "auc")


@query("a20_pr_curve", f"""WITH {OVR} SELECT CAST(class AS INT) AS class, score, round(ctp / (ctp + cfp), 6) AS precision,
round(ctp / p, 6) AS recall FROM pts""")
def _(spark, sf):
    return rounded(metrics.pr_curve(_points(spark, sf)), "precision", "recall")


AP = f"""{OVR}, ap AS (SELECT class, sum(ctp / (ctp + cfp) * tp / p) AS ap FROM pts GROUP BY 1)"""


@query("a20_average_precision", f"WITH {AP} SELECT CAST(class AS INT) AS class, round(ap, 6) AS ap FROM ap")
def _(spark, sf):
    return rounded(metrics.average_precision(_points(spark, sf)), "ap")


@query("a20_mean_average_precision", f"WITH {AP} SELECT round(avg(ap), 6) AS map FROM ap")
def _(spark, sf):
    return rounded(metrics.mean_average_precision(metrics.average_precision(_points(spark, sf))), "map")


@query("w6_running_difference", f"""WITH {OVR} SELECT CAST(class AS INT) AS class,
round(max(ctp / p - pr), 6) AS largest_gain FROM (SELECT *, coalesce(lag(ctp / p) OVER
(PARTITION BY class ORDER BY score DESC), 0) AS pr FROM pts) GROUP BY 1""")
def _(spark, sf):
    # the gain of a point is its own share of positives, so no ordering is needed
    p = _points(spark, sf)
    return rounded(p.groupBy("class").agg(F.max(F.col("tp") / F.col("total_tp"))
                                          .alias("largest_gain")), "largest_gain")


# --- open-set tables ----------------------------------------------------------------------------------

OPEN = """(SELECT count(*) FILTER (is_known) AS nk, count(*) FILTER (NOT is_known) AS nu,
count(*) FILTER (is_known AND pred <> 6 AND pred = y) AS ok, count(*) FILTER (is_known AND pred = 6) AS rk,
count(*) FILTER (NOT is_known AND pred = 6) AS ru{g} FROM ({rows}){by})"""
OPEN_COLS = """round(ok / nk, 6) AS known_acc, round(rk / nk, 6) AS known_rejection,
round(ru / nu, 6) AS unknown_det, round(1 - ru / nu, 6) AS false_known,
round(CASE WHEN ok / nk + ru / nu = 0 THEN 0 ELSE 2 * (ok / nk) * (ru / nu) / (ok / nk + ru / nu) END, 6) AS h_score,
round((ok + ru) / (nk + nu), 6) AS overall_accuracy"""
OPEN_NAMES = ["known_acc", "known_rejection", "unknown_det", "false_known", "h_score", "overall_accuracy"]


@query("a21_open_set_metrics", f"SELECT {OPEN_COLS} FROM {OPEN.format(g='', rows=A.CLASSED_SQL, by='')}")
def _(spark, sf):
    return rounded(metrics.open_set_metrics(A.classed(spark, sf), 6), *OPEN_NAMES)


@query("a22_confidence_stats", f"""SELECT is_known, round(min(confidence), 6) AS min, round(avg(confidence), 6) AS mean,
round(median(confidence), 6) AS median FROM ({A.CLASSED_SQL}) GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.confidence_stats(A.classed(spark, sf)), "min", "mean", "median")


@query("a23_unknown_misclassification", f"""SELECT CAST(pred AS INT) AS pred, count(*) AS n FROM ({A.CLASSED_SQL})
WHERE NOT is_known AND pred <> 6 GROUP BY 1""")
def _(spark, sf):
    return metrics.unknown_misclassification(A.classed(spark, sf), 6)


METHODS = " UNION ALL ".join(
    f"SELECT y, is_known, CASE WHEN confidence < {c} THEN 6 ELSE pred END AS pred, '{m}' AS method "
    f"FROM ({A.CLASSED_SQL})" for m, c in (("M1", 0.7), ("M2", 0.8), ("M3", 0.9)))
METHOD_ROWS = OPEN.format(g=", method", rows=METHODS, by=" GROUP BY method")


def _methods(spark, sf):
    c = A.classed(spark, sf)
    cut = lambda x: c.withColumn("pred", F.when(F.col("confidence") < x, 6).otherwise(F.col("pred")))
    return metrics.open_set_metrics(metrics.tag_union(
        {"M1": cut(0.7), "M2": cut(0.8), "M3": cut(0.9)}, "method"), 6, by=["method"])


@query("a34_method_comparison", f"""WITH m AS (SELECT method, {OPEN_COLS} FROM {METHOD_ROWS}),
u AS (UNPIVOT m ON {', '.join(OPEN_NAMES)} INTO NAME metric VALUE v)
SELECT metric, max(v) FILTER (method = 'M1') AS "M1", max(v) FILTER (method = 'M2') AS "M2",
max(v) FILTER (method = 'M3') AS "M3" FROM u GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.method_comparison(_methods(spark, sf)), "M1", "M2", "M3")


@query("a34_best_method", f"""SELECT method, {OPEN_COLS} FROM {METHOD_ROWS} ORDER BY h_score DESC, method LIMIT 1""")
def _(spark, sf):
    return rounded(metrics.best_method(_methods(spark, sf)), *OPEN_NAMES)


@query("u1_union_known_unknown", f"""SELECT CASE WHEN is_known THEN y ELSE 6 END AS y, count(*) AS n
FROM ({A.CLASSED_SQL}) GROUP BY 1""")
def _(spark, sf):
    c = A.classed(spark, sf)
    both = metrics.rows_to_test(c.where("is_known"), c.where("not is_known"), 6)
    return both.groupBy("y").agg(F.count("*").alias("n"))


# --- clusters ---------------------------------------------------------------------------------------

CLUSTER = ("SELECT CAST(l_linenumber % 5 AS INT) AS y, CAST(CASE WHEN l_discount < 3e-2 "
           "THEN (l_linenumber + 2) % 5 ELSE l_suppkey % 5 END AS INT) AS cluster FROM lineitem")


def _clusters(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 5).cast("int").alias("y"),
        F.when(F.col("l_discount") < 0.03, (F.col("l_linenumber") + 2) % 5)
        .otherwise(F.col("l_suppkey") % 5).cast("int").alias("cluster"))


@query("a28_contingency", f"SELECT y, cluster, count(*) AS n FROM ({CLUSTER}) GROUP BY 1, 2")
def _(spark, sf):
    return metrics.contingency(_clusters(spark, sf))


@query("a28_best_assignment", f"""WITH c AS (SELECT y, cluster, count(*) AS n FROM ({CLUSTER}) GROUP BY 1, 2),
p AS (SELECT a.y AS y0, b.y AS y1, d.y AS y2, e.y AS y3, f.y AS y4, a.n + b.n + d.n + e.n + f.n AS agree
 FROM c a, c b, c d, c e, c f WHERE a.cluster = 0 AND b.cluster = 1 AND d.cluster = 2 AND e.cluster = 3
 AND f.cluster = 4 AND len(list_distinct([a.y, b.y, d.y, e.y, f.y])) = 5),
t AS (SELECT [y0, y1, y2, y3, y4] AS ys, agree FROM p ORDER BY agree DESC, ys LIMIT 1)
SELECT CAST(i AS INT) AS cluster, ys[i + 1] AS y, agree FROM t, (SELECT unnest(range(5)) AS i)""")
def _(spark, sf):
    return metrics.best_assignment(metrics.contingency(_clusters(spark, sf)), 5)


@query("a28_apply_assignment", f"""WITH c AS (SELECT y, cluster, count(*) AS n FROM ({CLUSTER}) GROUP BY 1, 2),
p AS (SELECT [a.y, b.y, d.y, e.y, f.y] AS ys, a.n + b.n + d.n + e.n + f.n AS agree
 FROM c a, c b, c d, c e, c f WHERE a.cluster = 0 AND b.cluster = 1 AND d.cluster = 2 AND e.cluster = 3
 AND f.cluster = 4 AND len(list_distinct([a.y, b.y, d.y, e.y, f.y])) = 5)
SELECT round(max(agree) / (SELECT count(*) FROM lineitem), 6) AS accuracy FROM p""")
def _(spark, sf):
    rows = _clusters(spark, sf)
    match = metrics.best_assignment(metrics.contingency(rows), 5)
    return rounded(metrics.overall_accuracy(metrics.apply_assignment(rows, match)), "accuracy")


@query("f1_exact_ranks", f"""WITH s AS ({A.SCORES_SQL}) SELECT source_file, error, count(*) AS n,
CAST(sum(count(*)) OVER (PARTITION BY source_file ORDER BY error) AS BIGINT) AS cum_n FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return ranks.running_totals(A.scores(spark, sf), "error", {"n": F.lit(1)},
                                ["source_file"]).drop("total_n")
