"""Evaluation tables as grouped conditional sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowquarry.functions.numeric import harmonic, ratio
from flowquarry.operators.clean import q
from flowquarry.plans.joins import fixed_rows, join_null_safe
from flowquarry.plans.ranks import (
    grouped_percentiles, running_totals, score_table, totals_along, with_totals, with_totals_of_all)


# --- distributions and thresholds ---------------------------------------------------------

def label_distribution(df: DataFrame, col: str = "Label") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(q(col).alias(col)).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.asc(col))


def normal_attack_totals(df: DataFrame, col: str = "Label", normal: str = "BENIGN") -> DataFrame:
    hit = q(col) == normal
    return df.agg(F.count_if(hit).alias("normal"), F.count_if(~hit).alias("attack"))


def class_weights(df: DataFrame, k: int, col: str = "y") -> DataFrame:
    """Balanced weights n/(present * n_c); a class without rows gets 1."""
    counted = df.where(q(col).between(0, k - 1)).groupBy(q(col).alias("class")).agg(
        F.count("*").alias("n"))
    all_k = fixed_rows(df.sparkSession, [(i,) for i in range(k)], "class int")
    every = W.partitionBy()
    return (all_k.join(counted, "class", "left")
            .withColumn("rows", F.sum("n").over(every))
            .withColumn("present", F.count("n").over(every))
            .select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(
                F.col("rows") / (F.col("present") * F.col("n")), F.lit(1.0)).alias("weight")))


def threshold(df: DataFrame, error: str = "error", method: str = "percentile",
              percentile: float = 97, by: Sequence[str] = ()) -> DataFrame:
    """Alarm threshold of training errors: exact percentile, or mean + 3 population deviations."""
    if method == "percentile":
        key = list(by) or ["__all"]
        src = df if by else df.withColumn("__all", F.lit(0))
        got = grouped_percentiles(src, [error], key, percentile / 100.0)
        return got.select(*by, q(error).alias("threshold"))
    if method == "gaussian":
        return df.groupBy(*by).agg((F.avg(error) + 3 * F.stddev_pop(error)).alias("threshold"))
    raise ValueError("method must be 'percentile' or 'gaussian'")


def error_histogram(df: DataFrame, error: str = "error", bins: int = 100) -> DataFrame:
    """Equal-width histogram; the last bin includes the maximum."""
    ends = df.agg(F.min(error).alias("lo"), F.max(error).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    at = F.least(F.floor((q(error) - F.lit(lo)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    counted = df.where(q(error).isNotNull()).groupBy(at.alias("bin")).count()
    return (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            .join(counted, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * step).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * step).alias("hi"),
                    F.coalesce("count", F.lit(0)).alias("n")))


# --- binary scores --------------------------------------------------------------------------

def anomaly_flag(df: DataFrame, cut: Column | float, error: str = "error",
                 out: str = "is_anomaly") -> DataFrame:
    return df.withColumn(out, q(error) > cut)


def binary_confusion(df: DataFrame, y: str, score: str, cut: Column | float,
                     by: Sequence[str] = ()) -> DataFrame:
    """TP, TN, FP, FN with a row predicted positive when its score is above the cut."""
    pos, hit = q(y) == 1, q(score) > cut
    return df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("TP"), F.count_if(~pos & ~hit).alias("TN"),
        F.count_if(~pos & hit).alias("FP"), F.count_if(pos & ~hit).alias("FN"))


def binary_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from TP, TN, FP, FN; 0 on division by zero."""
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    return df.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("Accuracy"),
        ratio(tp, tp + fp).alias("Precision"), ratio(tp, tp + fn).alias("Recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("F1"))


def _auc_terms(r: DataFrame) -> Column:
    below = F.col("cum_neg") - F.col("neg")
    return F.col("pos") * (below + F.col("neg") / 2.0)


def binary_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC, ties count half; null when one of the two classes is absent."""
    pos = (q(y) == 1).cast("long")
    r = running_totals(df, score, {"pos": pos, "neg": 1 - pos}, by)
    return r.groupBy(*by).agg(F.try_divide(
        F.sum(_auc_terms(r)),
        (F.max("total_pos") * F.max("total_neg")).cast("double")).alias("AUC"))


def evaluate_per_file(scored: DataFrame, cut: float, file: str = "source_file",
                      score: str = "error", benign: Column | None = None,
                      positives: str = "file", y: str = "y", parts: int | None = None) -> DataFrame:
    """One row of metrics per attack file, each measured against all benign rows.

    ``benign`` marks the rows of the benign source. Benign rows are never copied per file: their
    counts are aggregated once, and AUC reads the benign distribution at each attack score from
    one running total. ``positives="file"`` counts every attack-file row as positive,
    ``"label"`` uses column ``y`` (non-positive rows join the file's own negatives).
    """
    if positives not in ("file", "label"):
        raise ValueError("positives must be 'file' or 'label'")
    is_benign = F.coalesce(benign if benign is not None else q(file).isNull(), F.lit(False))
    label = F.lit(1) if positives == "file" else q(y)
    pos = F.when(~is_benign, label).cast("int")
    rows = scored.where(q(score).isNotNull()).select(
        F.when(~is_benign, q(file)).alias("Attack"), is_benign.alias("benign"),
        q(score).alias("s"), pos.alias("pos"))
    # counts by score, written once: everything below reads this table
    table = score_table(rows, "s", {"pos": (F.col("pos") == 1).cast("long"), "neg": (F.col("pos") == 0).cast("long"),
                                    "base": F.col("benign").cast("long")}, ["Attack", "benign"], parts)
    hit = F.col("s") > F.lit(cut)
    total = lambda n, c, name: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias(name)
    base = table.where("benign").agg(total("base", hit, "FP0"), total("base", ~hit, "TN0"))
    per_file = table.where("not benign").groupBy("Attack").agg(
        total("pos", hit, "TP"), total("pos", ~hit, "FN"), total("neg", hit, "FP1"), total("neg", ~hit, "TN1"))
    counts = per_file.crossJoin(F.broadcast(base)).select(
        "Attack", "TP", (F.col("TN0") + F.col("TN1")).alias("TN"),
        (F.col("FP0") + F.col("FP1")).alias("FP"), "FN")
    # the file's own negatives, then benign rows below each score, shared by all files
    own = with_totals(table, "s", ["pos", "neg"], ["Attack"])
    at = with_totals_of_all(own, table, "s", "base").where("not benign")
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("below_base")
                           + (F.col("neg") + F.col("at_base")) / 2.0)
    auc = at.groupBy("Attack").agg(F.try_divide(F.sum(wins), (
        F.max("total_pos") * (F.max("total_neg") + F.max("total_base"))).cast("double"))
        .alias("AUC"))
    return join_null_safe(binary_metrics(counts), auc, ["Attack"]).select(
        "Attack", F.lit(float(cut)).alias("Threshold"), "Accuracy", "Precision", "Recall", "F1",
        "AUC", "TP", "TN", "FP", "FN")


# --- multi-class ----------------------------------------------------------------------------

def confusion_cells(df: DataFrame, k: int, y: str = "y", pred: str = "pred",
                    by: Sequence[str] = ()) -> DataFrame:
    """Counts per (true, predicted): at most k*k rows per group leave the scan."""
    inside = q(y).between(0, k - 1) & q(pred).between(0, k - 1)
    return df.where(inside).groupBy(*by, q(y).cast("int").alias("y"),
                                    q(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Dense k x k matrix, one row per true class, columns ``p0`` .. ``p{k-1}``."""
    cells = confusion_cells(df, k, y, pred)
    sums = cells.groupBy("y").agg(*[F.sum(F.when(F.col("pred") == i, F.col("n"))).alias(f"p{i}")
                                    for i in range(k)])
    dim = fixed_rows(df.sparkSession, [(i,) for i in range(k)], "y int")
    return dim.join(sums, "y", "left").na.fill(0)


def per_class_report(df: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1, one-vs-rest false positive rate and support of every class."""
    cells = confusion_cells(df, k, y, pred)
    dim = fixed_rows(df.sparkSession, [(i,) for i in range(k)], "class int")
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long")
                 .alias("predicted"), F.when(F.expr("y = pred"), F.col("n")).otherwise(0)
                 .alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("s")
    ).select("s.*").groupBy("class").agg(F.sum("support").alias("support"),
                                         F.sum("predicted").alias("predicted"),
                                         F.sum("tp").alias("tp"))
    full = dim.join(sides, "class", "left").na.fill(0)
    total = F.sum("support").over(W.partitionBy())
    tp, sup, pr = F.col("tp"), F.col("support"), F.col("predicted")
    return full.withColumn("rows", total).select(
        "class", ratio(tp, pr).alias("precision"), ratio(tp, sup).alias("recall"),
        ratio(2 * tp, sup + pr).alias("f1"), ratio(pr - tp, F.col("rows") - sup).alias("fpr"),
        "support")


def per_class_fpr(df: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    return per_class_report(df, k, y, pred).select("class", "fpr")


def macro_weighted_rows(report: DataFrame, floor: int = 1) -> DataFrame:
    """Report plus ``Macro Avg`` and ``Weighted Avg``; weights are ``max(support, floor)``."""
    scores = ["precision", "recall", "f1", "fpr"]
    w = F.greatest(F.col("support"), F.lit(floor))
    rows = report.select(F.col("class").cast("string").alias("class"), *scores, "support")
    macro = report.agg(F.lit("Macro Avg").alias("class"), *[F.avg(s).alias(s) for s in scores],
                       F.sum("support").alias("support"))
    weighted = report.agg(F.lit("Weighted Avg").alias("class"),
                          *[ratio(F.sum(F.col(s) * w), F.sum(w)).alias(s) for s in scores],
                          F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def overall_accuracy(df: DataFrame, y: str = "y", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((q(y) == q(pred)).cast("double")).alias("accuracy"))


# --- curves ---------------------------------------------------------------------------------

def one_vs_rest(df: DataFrame, k: int, y: str = "y", probs: str = "probabilities",
                keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, class): is it the true class, and the class's score."""
    return df.select(*[q(c) for c in keep], q(y).alias("__y"),
                     F.posexplode(F.slice(q(probs), 1, k)).alias("class", "score")).select(
        *keep, "class", "score", (F.col("__y") == F.col("class")).cast("int").alias("hit"))


def curve_points(ovr: DataFrame, by: Sequence[str] = ("class",), parts: int | None = None) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first."""
    hit = F.col("hit").cast("long")
    r = running_totals(ovr, "score", {"tp": hit, "fp": 1 - hit}, by, descending=True, parts=parts)
    return r.where(F.col("total_tp") > 0)


def roc_curve(points: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """(fpr, tpr) per distinct score plus the origin; classes without positives are absent."""
    at = F.struct("score", ratio(F.col("cum_fp"), F.col("total_fp")).alias("fpr"), ratio(F.col("cum_tp"), F.col("total_tp")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
    return points.select(*by, F.explode(F.when(first, F.array(origin, at)).otherwise(F.array(at))).alias("p")).select(*by, "p.*")


def auc_per_class(points: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Trapezoid area under each ROC curve; each point knows its own step, so no ordering."""
    height = (F.col("cum_tp") - F.col("tp") / 2.0) / F.col("total_tp")
    return points.groupBy(*by).agg(F.sum(F.try_divide(F.col("fp") * height,
                                                      F.col("total_fp").cast("double")))
                                   .alias("auc"))


def roc_interp(points: DataFrame, grid: int = 200, by: Sequence[str] = ("class",)) -> DataFrame:
    """TPR at ``grid`` evenly spaced false positive rates, linearly interpolated.

    Each curve segment lists the grid positions it covers, so no range join is needed. Where
    several points share one FPR the highest TPR counts.
    """
    last = grid - 1
    p, n = F.col("total_tp").cast("double"), F.col("total_fp").cast("double")
    x0, x1 = F.try_divide(F.col("cum_fp") - F.col("fp"), n), F.try_divide(F.col("cum_fp"), n)
    # a run of pure true positives lifts the curve at its FPR; the segment that follows starts
    # from the lifted value, and at FPR 1 every curve ends at TPR 1
    ends = F.expr("cum_fp = total_fp AND (fp > 0 OR total_fp = 0 AND cum_tp = total_tp)")
    seg = points.where(ends | (F.col("fp") > 0)).select(
        *by, x0.alias("x0"), x1.alias("x1"), ends.alias("ends"),
        ((F.col("cum_tp") - F.col("tp")) / p).alias("y0"), (F.col("cum_tp") / p).alias("y1"))
    near = F.sequence(F.greatest(F.floor(F.col("x0") * last) - 1, F.lit(0)),
                      F.least(F.ceil(F.col("x1") * last) + 1, F.lit(last)))
    y = lambda x: F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    spot = lambda pos, x, tpr: F.struct(pos.cast("int").alias("pos"), x.alias("x"), tpr.alias("tpr"))
    along = F.transform(F.filter(near, lambda i: (i / float(last) >= F.col("x0")) & (i / float(last) < F.col("x1"))),
                        lambda i: spot(i, i / float(last), y(i / float(last))))
    end = F.when(F.col("ends"), F.array(spot(F.lit(last), F.lit(1.0), F.lit(1.0))))
    none = F.array().cast("array<struct<pos:int,x:double,tpr:double>>")
    listed = F.concat(F.when(F.col("x1") > F.col("x0"), along).otherwise(none), F.coalesce(end, none))
    return seg.select(*by, F.explode(listed).alias("p")).select(*by, "p.*")


def macro_roc(interp: DataFrame) -> DataFrame:
    """Mean curve over the classes present."""
    return interp.groupBy("pos", "x").agg(F.avg("tpr").alias("tpr"))


def trapezoid(curve: DataFrame, x: str = "x", y: str = "tpr", order: str = "pos") -> DataFrame:
    """Area under a short curve (a fixed grid)."""
    w = W.orderBy(order)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    return curve.select(step.alias("s")).agg(F.sum("s").alias("auc"))


def pr_curve(points: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """(precision, recall) at every distinct score."""
    return points.select(*by, "score",
                         ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
                         .alias("precision"),
                         ratio(F.col("cum_tp"), F.col("total_tp")).alias("recall"))


def average_precision(points: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Sum of precision times recall gain; each point carries its own gain."""
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return points.groupBy(*by).agg(F.sum(prec * F.col("tp") / F.col("total_tp")).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"))


# --- open-set -------------------------------------------------------------------------------

def rows_to_test(known: DataFrame, unknown: DataFrame, k: int, y: str = "y") -> DataFrame:
    """Known and unknown test rows as one set; the true class of every unknown row is ``k``. Columns both have are kept."""
    shared = [c for c in known.columns if c in unknown.columns and c != y]
    kind = known.schema[y].dataType
    return known.select(q(y), *[q(c) for c in shared]).unionByName(unknown.select(F.lit(k).cast(kind).alias(y), *[q(c) for c in shared]))


def open_set_metrics(df: DataFrame, k: int, y: str = "y", pred: str = "pred",
                     known: str = "is_known", by: Sequence[str] = ()) -> DataFrame:
    """Known accuracy, rejections, unknown detection and their harmonic mean in one pass."""
    is_known, rejected = q(known), q(pred) == k
    right = is_known & ~rejected & (q(pred) == q(y))
    g = df.groupBy(*by).agg(
        F.count_if(is_known).alias("nk"), F.count_if(~is_known).alias("nu"),
        F.count_if(right).alias("ok"), F.count_if(is_known & rejected).alias("rk"),
        F.count_if(~is_known & rejected).alias("ru"))
    kca, udr = ratio(F.col("ok"), F.col("nk")), ratio(F.col("ru"), F.col("nu"))
    return g.select(
        *by, kca.alias("known_acc"), ratio(F.col("rk"), F.col("nk")).alias("known_rejection"),
        udr.alias("unknown_det"), (F.lit(1.0) - udr).alias("false_known"),
        harmonic(kca, udr).alias("h_score"),
        ratio(F.col("ok") + F.col("ru"), F.col("nk") + F.col("nu")).alias("overall_accuracy"))


def confidence_stats(df: DataFrame, confidence: str = "confidence",
                     by: str = "is_known") -> DataFrame:
    """Min, mean and exact median of the top probability, known vs unknown."""
    plain = df.groupBy(by).agg(F.min(confidence).alias("min"), F.avg(confidence).alias("mean"))
    med = grouped_percentiles(df, [confidence], [by], 0.5)
    return join_null_safe(plain, med.withColumnRenamed(confidence, "median"), [by])


def unknown_misclassification(df: DataFrame, k: int, pred: str = "pred",
                              known: str = "is_known") -> DataFrame:
    """Unknown rows that were not rejected, by the class they were given."""
    return df.where(~q(known) & (q(pred) != k)).groupBy(q(pred).alias("pred")).agg(
        F.count("*").alias("n"))


def method_comparison(per_method: DataFrame, method: str = "method") -> DataFrame:
    """Metric x method table from one open-set row per method."""
    metrics = ["known_acc", "known_rejection", "unknown_det", "false_known", "h_score",
               "overall_accuracy"]
    rows = per_method.select(method, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    names = [r[0] for r in per_method.select(method).distinct().orderBy(method).collect()]
    return rows.groupBy("metric").pivot(method, names).agg(F.first("value"))


def best_method(per_method: DataFrame, method: str = "method") -> DataFrame:
    """Method with the highest H-score; equal scores go by name."""
    return per_method.orderBy(F.desc("h_score"), F.asc(method)).limit(1)


def best_rows(sweep: DataFrame, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` sweep rows by H-score."""
    return sweep.orderBy(F.desc("h_score"), *[F.asc_nulls_last(t) for t in ties]).limit(n)


# --- model comparison -----------------------------------------------------------------------

def tag_union(tables: dict[str, DataFrame], tag: str = "Model") -> DataFrame:
    """Stack per-model tables, each tagged with its model."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [t.withColumn(tag, F.lit(name)) for name, t in tables.items()])


def model_summary(df: DataFrame) -> DataFrame:
    """Mean metrics per model, best F1 first."""
    cols = ["Accuracy", "Precision", "Recall", "F1", "AUC"]
    return df.groupBy("Model").agg(*[F.avg(c).alias(c) for c in cols]).orderBy(
        F.desc("F1"), F.asc("Model"))


def model_ranking(df: DataFrame) -> DataFrame:
    """Mean recall, F1, AUC, accuracy and worst recall; ordered by the first three."""
    return df.groupBy("Model").agg(
        F.avg("Recall").alias("mean_recall"), F.avg("F1").alias("mean_f1"),
        F.avg("AUC").alias("mean_auc"), F.avg("Accuracy").alias("mean_accuracy"),
        F.min("Recall").alias("worst_recall")).orderBy(
        F.desc("mean_recall"), F.desc("mean_f1"), F.desc("mean_auc"), F.asc("Model"))


def recall_pivot(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Attack rows x model columns."""
    return df.groupBy("Attack").pivot("Model", list(models)).agg(F.first("Recall"))


# --- clusters -------------------------------------------------------------------------------

def contingency(df: DataFrame, y: str = "y", cluster: str = "cluster") -> DataFrame:
    return df.groupBy(q(y).cast("int").alias("y"), q(cluster).cast("int").alias("cluster")).agg(
        F.count("*").alias("n"))


def _cheapest(cost: list[list[int]]) -> list[int]:
    """Column of every row of a square cost matrix, so that the sum is least.

    Rows enter one by one; each looks for the cheapest path of exchanges to a free column under prices
    that keep the costs of taken columns at zero.
    """
    k = len(cost)
    row_price, col_price = [0] * k, [0] * (k + 1)
    owner = [-1] * (k + 1)  # row that holds a column; column k is where the entering row stands
    for row in range(k):
        owner[k] = row
        at, seen = k, [False] * (k + 1)
        slack, came = [None] * k, [k] * k
        while owner[at] != -1:
            seen[at] = True
            here, nearest, step = owner[at], -1, None
            for col in range(k):
                if seen[col]:
                    continue
                left = cost[here][col] - row_price[here] - col_price[col]
                if slack[col] is None or left < slack[col]:
                    slack[col], came[col] = left, at
                if step is None or slack[col] < step:
                    nearest, step = col, slack[col]
            for col in range(k + 1):
                if seen[col]:
                    row_price[owner[col]] += step
                    col_price[col] -= step
                elif col < k:
                    slack[col] -= step
            at = nearest
        while at != k:
            owner[at] = owner[came[at]]
            at = came[at]
    chosen = [0] * k
    for col in range(k):
        chosen[owner[col]] = col
    return chosen


def best_assignment(counts: DataFrame, k: int) -> DataFrame:
    """One-to-one cluster -> class with the most agreeing rows, from the k*k counts.

    Equal sums go to the first assignment in lexical order. Codes outside 0..k-1 are ignored.
    """
    n = [[0] * k for _ in range(k)]
    inside = counts.where(F.col("y").between(0, k - 1) & F.col("cluster").between(0, k - 1))
    for r in inside.groupBy("cluster", "y").agg(F.sum("n").alias("n")).collect():
        n[r["cluster"]][r["y"]] = r["n"]
    # the lexical rank of an assignment is below k**k, so it decides between equal sums only
    cost = [[-n[c][y] * k**k + y * k**(k - 1 - c) for y in range(k)] for c in range(k)]
    chosen = _cheapest(cost)
    agree = sum(n[c][y] for c, y in enumerate(chosen))
    return counts.sparkSession.createDataFrame(
        [(c, y, agree) for c, y in enumerate(chosen)], "cluster int, y int, agree long")


def apply_assignment(df: DataFrame, assignment: DataFrame, cluster: str = "cluster",
                     out: str = "pred") -> DataFrame:
    """Replace cluster codes by their matched classes (one row a class is broadcast)."""
    a = F.broadcast(assignment.select(F.col("cluster").alias("__c"), F.col("y").alias(out)))
    return df.join(a, q(cluster) == F.col("__c"), "left").drop("__c")
