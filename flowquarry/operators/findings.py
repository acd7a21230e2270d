"""Per-capture summaries: traffic profile, class distribution, findings.

Grouping by capture alone would send one hot capture to one task, so every summary first groups
by (capture, small key): counts are combined map-side and what remains per capture is bounded by
the number of classes, ports or protocols.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowquarry.functions.numeric import exact_round, null_if_not_finite, ratio, to_number
from flowquarry.operators.clean import q
from flowquarry.operators.lookup import protocol_of
from flowquarry.plans.ranks import row_positions
from flowquarry.schema import (ATTACK_RATIO_ALARM, FLOWS_RETURNED, NORMAL, PROFILE_TYPE,
                               SERVED_CLASSES, TOP_K, UNKNOWN)


def top_k(df: DataFrame, by: Sequence[str], key: str, k: int = TOP_K) -> DataFrame:
    """Most frequent ``key`` values per group with rank; equal counts go by key ascending."""
    counted = df.where(q(key).isNotNull()).groupBy(*by, key).count()
    order = W.partitionBy(*by).orderBy(F.desc("count"), F.asc(key))
    return (counted.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).withColumnRenamed("count", "n"))


def _ranked_map(entries: Column) -> Column:
    """(rank, key, n) structs to a map whose first entry is the most frequent key."""
    return F.map_from_entries(F.transform(F.array_sort(entries),
                                          lambda e: F.struct(e["key"], e["n"])))


def _has(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def protocol_text(cell: Column) -> Column:
    """Name of a protocol cell: ``6`` and ``6.0`` are one protocol, text stays as it is written."""
    code = null_if_not_finite(to_number(cell)).try_cast("int")
    return F.coalesce(protocol_of(code), F.trim(cell.cast("string")))


def profile_cells(df: DataFrame) -> Column:
    """The cells of a raw flow that the profile of its capture needs, as one struct; absent columns are null."""
    port, proto = _has(df, "Destination Port", "Dst Port"), _has(df, "Protocol")
    ip, dur = _has(df, "Source IP", "Src IP"), _has(df, "Flow Duration")
    fwd = _has(df, "Total Length of Fwd Packets", "TotLen Fwd Pkts")
    number = lambda name: null_if_not_finite(to_number(q(name))) if name else F.lit(None).cast("double")
    return F.struct(
        number(port).try_cast("int").alias("port"), number(proto).try_cast("int").alias("code"),
        (protocol_text(q(proto)) if proto else F.lit(None).cast("string")).alias("protocol"),
        (q(ip).cast("string") if ip else F.lit(None).cast("string")).alias("address"),
        number(dur).alias("duration"), number(fwd).alias("volume"), F.lit(ip is not None).alias("has_address"))


PORT, PROTOCOL, ADDRESS, VOLUME, CLASS = range(5)  # kinds of counted keys
_SPREAD = 64


def capture_counts(df: DataFrame, by: str, cells: str, name: str | None = None, confidence: str | None = None,
                   position: str | None = None) -> DataFrame:
    """Rows per (capture, kind, key) of ports, protocols, addresses and, if given, predicted classes, in one pass.

    Sums of the numeric cells stand in the row of kind VOLUME. All of a capture's figures follow from this table; tasks
    combine it before the shuffle, so it has one row a distinct key however many flows there are.
    """
    c = lambda f: F.col(f"`{cells}`.{f}")

    def entry(kind, num=None, txt=None, a=None, b=None, at=None):
        given = [("num", num, "int"), ("txt", txt, "string"), ("a", a, "double"), ("b", b, "double"), ("at", at, "long")]
        return F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if v is None else v).cast(t).alias(n) for n, v, t in given])
    entries = [entry(PORT, c("port")), entry(PROTOCOL, txt=c("protocol"), a=c("code")), entry(ADDRESS, txt=c("address")),
               entry(VOLUME, c("has_address").cast("int"), a=c("duration"), b=c("volume"))]
    if name:
        entries.append(entry(CLASS, txt=q(name), a=q(confidence) if confidence else F.lit(0.0), at=q(position) if position else F.lit(0)))
    each = df.select(q(by).alias("__by"), F.explode(F.array(*entries)).alias("e")).select("__by", "e.*")
    return each.where((F.col("kind") >= VOLUME) | F.col("num").isNotNull() | F.col("txt").isNotNull()).groupBy("__by", "kind", "num", "txt").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.count("a").alias("n_a"), F.min("a").alias("least"), F.sum("b").alias("b"),
        F.count("b").alias("n_b"), F.min("at").alias("first_at"))


def _summary(counted: DataFrame, by: str, classes: bool) -> DataFrame:
    """Findings (with ``classes``) and profile of every capture, from :func:`capture_counts`."""
    kind = F.col("kind")
    # equal counts: ports and protocols by number, names without a number last; addresses need no order
    spread = F.when(kind > PROTOCOL, F.pmod(F.hash("txt"), F.lit(_SPREAD)))
    rank = W.partitionBy("__by", "kind", spread).orderBy(F.desc("n"), "num", F.asc_nulls_last("least"), "txt")
    ranked = counted.withColumn("r", F.row_number().over(rank))
    top = lambda k, key: F.collect_list(F.when((kind == k) & (F.col("r") <= TOP_K), F.struct("r", key.alias("key"), "n")))
    volume, is_class = kind == VOLUME, kind == CLASS
    mean = lambda v, n: F.try_divide(F.sum(F.when(volume, F.col(v))), F.sum(F.when(volume, F.col(n))))
    masked = lambda c: F.when(is_class, F.col(c))
    g = ranked.groupBy(F.col("__by").alias(by)).agg(
        top(PORT, F.col("num")).alias("ports"), top(PROTOCOL, F.col("txt")).alias("protocols"),
        F.count_if(kind == PORT).alias("n_ports"), F.count_if(kind == ADDRESS).alias("n_addresses"),
        F.max(F.when(volume, F.col("num"))).alias("has_address"), mean("a", "n_a").alias("duration"), mean("b", "n_b").alias("volume"),
        *(_finding_aggs(masked("txt"), masked("n"), masked("a"), masked("first_at")) if classes else []))
    listed = lambda c: F.when(F.size(c) > 0, _ranked_map(F.col(c)))
    profile = F.struct(
        listed("ports").alias("top_dst_ports"), F.when(F.col("n_ports") > 0, F.col("n_ports")).alias("unique_dst_ports"),
        listed("protocols").alias("protocols"), F.when(F.col("has_address") == 1, F.col("n_addresses")).alias("unique_src_ips"),
        F.col("duration").cast("long").alias("avg_flow_duration_us"), exact_round(F.col("volume"), 1).alias("avg_fwd_bytes"))
    return g.select(by, *(_finding_columns() if classes else []), profile.cast(PROFILE_TYPE).alias("traffic_profile"))


def traffic_profile(df: DataFrame, by: str = "source_file") -> DataFrame:
    """One row per capture with a ``traffic_profile`` struct; absent columns give null fields."""
    return _summary(capture_counts(df.select(q(by), profile_cells(df).alias("__cells")), by, "__cells"), by, False)


def capture_summary(df: DataFrame, by: str = "source_file", name: str = "class_name", confidence: str = "confidence",
                    position: str | None = None, cells: str | None = None) -> DataFrame:
    """Findings and traffic profile of every capture from one read of classified flows.

    ``cells`` names a column of :func:`profile_cells` made before the raw cells were scaled; without it they are taken from ``df``.
    """
    if cells is None:
        df, cells = df.withColumn("__cells", profile_cells(df)), "__cells"
    return _summary(capture_counts(df, by, cells, name, confidence, position), by, True)


def per_flow_predictions(df: DataFrame, prediction: str = "prediction",
                         probabilities: str = "probabilities") -> DataFrame:
    """Name, class id and the probability of the chosen class, rounded to 4."""
    names = F.array(*[F.lit(n) for n in SERVED_CLASSES])
    cls = q(prediction).cast("int")
    return df.select(
        "*", cls.alias("class_id"),
        F.coalesce(F.try_element_at(names, cls + 1), F.lit(UNKNOWN)).alias("class_name"),
        F.round(F.element_at(q(probabilities), cls + 1), 4).alias("confidence"))


def number_flows(df: DataFrame, order: Sequence[str], by: str = "source_file") -> DataFrame:
    """``flow_id``: 0-based position in the capture."""
    return row_positions(df, [by], order, "flow_id")


def first_flows(df: DataFrame, order: Sequence[str], by: str = "source_file",
                n: int = FLOWS_RETURNED) -> DataFrame:
    """First ``n`` flows of each capture; each task keeps its own first ``n`` before the shuffle."""
    w = W.partitionBy(by).orderBy(*order)
    return (df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
            .withColumn("flow_id", (F.col("__r") - 1).cast("long")).drop("__r"))


FLOWS_SHOWN, ROWS_SHOWN, CELLS_SHOWN, LINES_SHOWN = 20, 3, 10, 6


def preview_flows(df: DataFrame, order: Sequence[str], n: int = FLOWS_SHOWN) -> DataFrame:
    """First flows of a table; every task keeps its own first ``n``."""
    return df.orderBy(*order).limit(n)


def preview_vectors(df: DataFrame, order: Sequence[str], vec: str = "features", n: int = ROWS_SHOWN, cells: int = CELLS_SHOWN) -> DataFrame:
    """First rows of a prepared set, with the first cells of their vectors."""
    return df.orderBy(*order).limit(n).withColumn(vec, F.slice(q(vec), 1, cells))


def preview_text(text: Column, n: int = LINES_SHOWN) -> Column:
    """First lines of a text."""
    return F.substring_index(text, "\n", n)


def class_counts(df: DataFrame, by: str = "source_file", name: str = "class_name",
                 confidence: str | None = None, position: str | None = None) -> DataFrame:
    """Rows per (capture, predicted class), with confidence sum and first position."""
    return df.groupBy(by, name).agg(
        F.count("*").alias("n"),
        (F.sum(confidence) if confidence else F.lit(0.0)).alias("confidence_sum"),
        (F.min(position) if position else F.lit(0)).cast("long").alias("first_at"))


def class_distribution(df: DataFrame, by: str = "source_file",
                       name: str = "class_name", position: str | None = None) -> DataFrame:
    """Map of predicted class to count, most frequent first."""
    counted = class_counts(df, by, name, position=position)
    return counted.groupBy(by).agg(
        _distribution(F.col(name), F.col("n"), F.col("first_at")).alias("class_distribution"))


def _distribution(name: Column, n: Column, first_at: Column) -> Column:
    entries = F.array_sort(F.collect_list(F.when(n.isNotNull(), F.struct(
        (-n).alias("o"), first_at.alias("first_at"), name.alias("k"), n.alias("n")))))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["n"])))


def _finding_aggs(name: Column, n: Column, confidence_sum: Column, first_at: Column) -> list[Column]:
    """Aggregates of (capture, class) counts; rows without ``n`` don't count."""
    attack = name != NORMAL
    # equal counts go to the class seen first; without positions to the last name in order
    strength = F.when(n.isNotNull(), F.struct(n.alias("n"), (-first_at).alias("f"), name.alias("k")))
    return [F.sum(n).alias("flow_count"), F.sum(confidence_sum).alias("cs"),
            F.coalesce(F.sum(F.when(attack, n)), F.lit(0)).alias("attacks"),
            F.max_by(name, strength).alias("dominant_class"),
            F.max_by(F.when(attack, name), F.when(attack, strength)).alias("top"),
            _distribution(name, n, first_at).alias("class_distribution")]


def _finding_columns() -> list[Column | str]:
    share = ratio(F.col("attacks"), F.col("flow_count"))
    hit = share > ATTACK_RATIO_ALARM
    return [F.when(hit, "abnormal").otherwise("normal").alias("status"),
            hit.alias("attack_detected"), F.when(hit, F.col("top")).alias("attack_type"),
            exact_round(F.col("cs") / F.col("flow_count"), 4).alias("confidence"),
            exact_round(share, 4).alias("attack_ratio"), "flow_count", "dominant_class",
            "class_distribution"]


def findings_from_counts(counts: DataFrame, by: str = "source_file",
                         name: str = "class_name") -> DataFrame:
    """Capture findings from (capture, class) counts: at most one row per class and capture."""
    aggs = _finding_aggs(F.col(name), F.col("n"), F.col("confidence_sum"), F.col("first_at"))
    return counts.groupBy(by).agg(*aggs).select(by, *_finding_columns())


def capture_findings(df: DataFrame, by: str = "source_file", name: str = "class_name",
                     confidence: str = "confidence", position: str | None = None) -> DataFrame:
    """Status, top attack, mean confidence and attack ratio per capture.

    A capture is abnormal when more than a fifth of its flows (unrounded) are not Normal;
    rejected flows count as attacks. Equal counts go to the class seen first.
    """
    return findings_from_counts(class_counts(df, by, name, confidence, position), by, name)


def class_breakdown_pct(df: DataFrame, by: str = "source_file",
                        dist: str = "class_distribution") -> DataFrame:
    """Distribution map to rows with percentage of the capture total."""
    rows = df.select(by, q(dist), F.aggregate(F.map_values(dist), F.lit(0).cast("long"),
                                              lambda s, n: s + n).alias("total"))
    return rows.select(by, "total", F.explode(dist).alias("class_name", "n")).withColumn(
        "pct", F.round(F.col("n") * 100.0 / F.col("total"), 1))
