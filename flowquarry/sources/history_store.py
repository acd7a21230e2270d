"""Analysis history by day, with daily totals.

Records are stored with their time as a timestamp and in one partition a day, so that questions about the last hours read
the last days. Totals of every day stand in a table of their own, a row a day; adding records recomputes only
the days they fall on, from those days' partitions. Readers of figures over the whole history read the totals.

``<path>/records/day=...`` holds the records, ``<path>/totals/version=...`` the totals; the newest complete version counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions.numeric import parse_iso
from flowquarry.operators.history import recent_analyses
from flowquarry.schema import ALERT_TYPES, HISTORY_TYPE, SEVERITIES
from flowquarry.sources.params import child_names, path_exists, remove_path

NO_DAY = "1970-01-01"  # partition of records whose time can't be read


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, analyses: DataFrame) -> None:
        """Add records and renew the totals of their days."""
        time = parse_iso(F.col("timestamp"))
        rows = (analyses.select(*[f.name for f in HISTORY_TYPE.fields]).withColumn("event_time", time)
                .withColumn("day", F.coalesce(F.to_date("event_time"), F.lit(NO_DAY).cast("date"))))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # one a day
        rows.repartition("day", F.pmod(F.hash("id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(f"{self.path}/records")
        self._renew(days)

    def records(self) -> DataFrame:
        """All records, with event_time and day."""
        schema = T.StructType([*HISTORY_TYPE.fields, T.StructField("event_time", T.TimestampType()), T.StructField("day", T.DateType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/records")

    def _versions(self) -> list[int]:
        found = [int(n.removeprefix("version=")) for n in child_names(self.spark, f"{self.path}/totals") if n.startswith("version=")]
        return sorted(v for v in found if path_exists(self.spark, f"{self.path}/totals/version={v}/_SUCCESS"))

    def totals(self) -> DataFrame:
        """One row a day: total, threats, confidence_sum, n_<severity>, alert_<type>."""
        done = self._versions()
        if not done:
            raise ValueError(f"no history below {self.path}")
        return self.spark.read.parquet(f"{self.path}/totals/version={done[-1]}")

    def _renew(self, days: list) -> None:
        severity, alerts = F.col("verdict.verdict"), F.col("verdict.alertsTriggered")
        fresh = self.records().where(F.col("day").isin(days)).groupBy("day").agg(
            F.count("*").alias("total"), F.count_if(~severity.eqNullSafe("LOW")).alias("threats"),
            F.sum(F.coalesce("modelFindings.confidence", F.lit(0.0))).alias("confidence_sum"),
            *[F.count_if(severity == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
            *[F.count_if(F.array_contains(alerts, t)).alias(f"alert_{t.lower()}") for t in ALERT_TYPES])
        done = self._versions()
        if done:
            fresh = self.totals().where(~F.col("day").isin(days)).unionByName(fresh)
        fresh.coalesce(1).write.parquet(f"{self.path}/totals/version={done[-1] + 1 if done else 0}")
        for old in done[:-1]:  # a reader may still be on the last one
            remove_path(self.spark, f"{self.path}/totals/version={old}")

    def last_24h(self, now: Column) -> DataFrame:
        """Records strictly younger than 24 hours at ``now``, from the partitions that can hold them."""
        since = now - F.expr("interval 24 hours")
        return self.records().where((F.col("day") >= F.to_date(since)) & (F.col("event_time") > since))

    def dashboard(self, now: Column) -> DataFrame:
        """Figures of :func:`operators.history.dashboard_stats` from the totals and the last two days."""
        whole = self.totals().agg(F.sum("total").alias("total"), F.sum("threats").alias("threats"), F.sum("confidence_sum").alias("c"))
        critical = self.last_24h(now).agg(F.count_if(F.col("verdict.verdict") == "CRITICAL").alias("critical_24h"))
        mean = F.format_string("%.2f", F.try_divide("c", F.col("total").cast("double")))
        return whole.crossJoin(F.broadcast(critical)).select(  # a row each
            F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("threats", F.lit(0)).alias("threats"), "critical_24h",
            F.when(F.col("total") > 0, mean).otherwise("--").alias("avg_confidence"))

    def recent(self, n: int = 10) -> DataFrame:
        """The newest analyses, from the newest days that have enough."""
        found, first = 0, None
        for r in self.totals().select("day", "total").orderBy(F.desc("day")).limit(n).collect():
            found, first = found + r["total"], r["day"]
            if found >= n:
                break
        rows = self.records()
        return recent_analyses(rows if first is None else rows.where(F.col("day") >= F.lit(first)), n)
