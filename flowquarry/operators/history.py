"""Analysis history: filters, alerts, dashboard figures and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import parse_iso
from flowquarry.operators.clean import q
from flowquarry.operators.lookup import zero_filled_counts
from flowquarry.schema import ALERT_TYPES, SEVERITIES


def filter_history(df: DataFrame, severity: str | None = None,
                   zone: str | None = None) -> DataFrame:
    """Each condition applies only when given."""
    if severity:
        df = df.where(F.col("verdict.verdict") == severity)
    if zone:
        df = df.where(F.col("context.networkZone") == zone)
    return df


def explode_alerts(df: DataFrame) -> DataFrame:
    """One row per triggered alert."""
    a = df.select("*", F.explode("verdict.alertsTriggered").alias("type"))
    return a.select(
        F.concat_ws("-", "id", "type").alias("id"), "timestamp", "type",
        F.col("verdict.verdict").alias("severity"),
        F.coalesce(F.nullif("modelFindings.attack_type", F.lit("")), F.lit("--"))
        .alias("attackType"), F.col("id").alias("analysisId"),
        F.coalesce("verdict.recommendedActions", F.expr("cast(array() as array<string>)"))
        .alias("recommendedActions"), "filename")


def filter_alerts(alerts: DataFrame, type: str | None = None,
                  severity: str | None = None) -> DataFrame:
    if type:
        alerts = alerts.where(F.col("type") == type)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    return alerts


def last_24h(df: DataFrame, now: Column, ts: str = "timestamp") -> DataFrame:
    """Rows strictly younger than 24 hours at ``now``."""
    return df.where(parse_iso(q(ts)) > now - F.expr("interval 24 hours"))


def page_after(df: DataFrame, key: str, direction: str = "asc", last: dict | None = None, size: int = 20,
               ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The page that follows the row ``last`` of a sorted table; the first page without it.

    ``last`` holds key and ties of the last row seen. The rows before it are filtered out where they are read, so that a
    page costs the same however deep it lies: each task keeps one page. Ties must make the order unique. Same order as :func:`sort_page`.
    """
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    if last is not None:
        # ties in order: later in the first one that differs
        after, same = F.lit(False), F.lit(True)
        for t in ties:
            after = after | (same & (q(t) > F.lit(last[t])))
            same = same & q(t).eqNullSafe(F.lit(last[t]))
        if last[key] is None:
            df = df.where(q(key).isNull() & after)
        else:
            beyond = q(key) > F.lit(last[key]) if direction == "asc" else q(key) < F.lit(last[key])
            df = df.where(q(key).isNull() | beyond | ((q(key) == F.lit(last[key])) & after))
    first = (F.asc_nulls_last if direction == "asc" else F.desc_nulls_last)(q(key))
    return df.orderBy(first, *[q(t) for t in ties]).limit(size)


def _flat_columns() -> list[Column]:
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("--"))
    return [F.col("id"), F.col("timestamp"), F.col("filename"),
            F.col("verdict.verdict").alias("verdict"),
            text("modelFindings.attack_type").alias("attack"),
            text("context.networkZone").alias("zone"),
            text("context.assetCriticality").alias("criticality")]


def flatten_history(df: DataFrame) -> DataFrame:
    """Flat table with defaults for missing nested values."""
    return df.select(*_flat_columns(),
                     F.coalesce("preprocessMeta.row_count", F.lit(0)).alias("flows"))


def dashboard_stats(df: DataFrame, now: Column) -> DataFrame:
    """Total, threats (anything but LOW, null included), critical in 24 h, mean confidence."""
    sev = F.col("verdict.verdict")
    recent = parse_iso(F.col("timestamp")) > now - F.expr("interval 24 hours")
    conf = F.avg(F.coalesce("modelFindings.confidence", F.lit(0.0)))
    return df.agg(
        F.count("*").alias("total"), F.count_if(~sev.eqNullSafe("LOW")).alias("threats"),
        F.count_if(recent & (sev == "CRITICAL")).alias("critical_24h"),
        F.coalesce(F.format_string("%.2f", conf), F.lit("--")).alias("avg_confidence"))


def with_share_of_max(counts: DataFrame, n: str = "n") -> DataFrame:
    """Bar length relative to the longest bar (of at least 1)."""
    top = counts.agg(F.greatest(F.max(n), F.lit(1)).alias("__top"))
    return counts.crossJoin(F.broadcast(top)).withColumn(
        "share", F.col(n) / F.col("__top")).drop("__top")


def severity_breakdown(df: DataFrame) -> DataFrame:
    """Analyses per severity, zero-filled, names outside the list ignored."""
    rows = df.select(F.col("verdict.verdict").alias("severity"))
    return with_share_of_max(zero_filled_counts(rows, "severity", SEVERITIES))


def alert_summary(df: DataFrame) -> DataFrame:
    """Alerts per type, zero-filled."""
    rows = df.select(F.explode("verdict.alertsTriggered").alias("type"))
    return with_share_of_max(zero_filled_counts(rows, "type", ALERT_TYPES))


def recent_analyses(df: DataFrame, n: int = 10) -> DataFrame:
    """Newest analyses with the number of recommended actions; each task keeps its newest n."""
    rows = df.orderBy(F.desc(parse_iso(F.col("timestamp"))), F.asc("id")).limit(n)
    return rows.select(*_flat_columns(),
                       F.coalesce(F.size("verdict.recommendedActions"), F.lit(0))
                       .alias("n_actions"))


def sort_page(df: DataFrame, key: str | None, direction: str = "asc", page: int = 0,
              size: int = 20, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """One page of a sorted table; missing values go last in both directions."""
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    if key:
        first = (F.asc_nulls_last if direction == "asc" else F.desc_nulls_last)(q(key))
        df = df.orderBy(first, *[q(t) for t in ties])
    return df.offset(page * size).limit(size)
