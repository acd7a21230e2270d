"""Arriving captures, analyses, packets and scaler updates as streaming queries.

Every job takes its checkpoint folder from the caller or from the shared folder, and writes so
that a batch replayed after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowquarry.operators.history import explode_alerts
from flowquarry.operators.packets import flow_features_windowed
from flowquarry.operators.scale import fit_minmax, merge_scalers
from flowquarry.plans.analyze import judge, to_history
from flowquarry.plans.storage import scratch_path
from flowquarry.schema import ALERT_TYPES, SEVERITIES
from flowquarry.session import compile_wide_plans
from flowquarry.sources.params import child_names, path_exists, remove_path, touch


def _start(writer, checkpoint: str | None, spark, label: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-ckpt"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_verdicts(flows: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str,
                    checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """New flow files to verdict rows, one folder per batch.

    A file is never divided between batches, so a capture stored as one file gets one verdict. A
    replayed batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        analyze(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return _start(flows.writeStream.foreachBatch(write), checkpoint, flows.sparkSession,
                  "verdicts", once)


def stream_analyses(flows: DataFrame, find: Callable[[DataFrame], DataFrame],
                    context: Callable[[DataFrame], DataFrame], out: str, now: Column | None = None, by: str = "source_file",
                    checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """New flow files to verdicts, alerts and quarantined findings, all of a batch or nothing.

    Flows are read once a batch: ``find`` makes the findings, which are written, and the three outputs come from that small
    table. ``context`` gives the contexts of the captures in a table of findings. A batch counts when its mark is written, after all
    outputs (:func:`read_batches`); a replayed batch takes its mark back first and overwrites its own folders.
    """
    spark = flows.sparkSession
    compile_wide_plans(spark)  # a batch is made by the stream's own settings, before ``find`` sees it

    def write(batch: DataFrame, batch_id: int) -> None:
        at = lambda name: f"{out}/{name}/batch={batch_id}"
        remove_path(spark, at(MARKS))
        find(batch).write.mode("overwrite").parquet(at("findings"))
        found = spark.read.parquet(at("findings"))
        verdicts, quarantine = judge(found, context(found), by)
        verdicts.write.mode("overwrite").parquet(at("verdicts"))
        quarantine.write.mode("overwrite").parquet(at("quarantine"))
        records = to_history(spark.read.parquet(at("verdicts")), F.current_timestamp() if now is None else now, by)
        explode_alerts(records).write.mode("overwrite").parquet(at("alerts"))
        touch(spark, at(MARKS))
    return _start(flows.writeStream.foreachBatch(write), checkpoint, spark, "analyses", once)


MARKS = "_complete"


def read_batches(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of an output (findings, verdicts, alerts, quarantine) of all complete batches of :func:`stream_analyses`."""
    done = [f"{out}/{name}/{b}" for b in sorted(child_names(spark, f"{out}/{MARKS}"))]
    if not done:
        raise ValueError(f"no complete batch below {out}")
    return spark.read.option("basePath", f"{out}/{name}").parquet(*done)


def dashboard_windows(history: DataFrame, size: str = "24 hours", slide: str = "1 hour",
                      late: str = "2 hours", ts: str = "event_time") -> DataFrame:
    """Sliding dashboard figures over arriving history; records later than ``late`` are dropped."""
    sev = F.col("verdict.verdict")
    alerts = F.coalesce(F.col("verdict.alertsTriggered"), F.expr("cast(array() as array<string>)"))
    return history.withWatermark(ts, late).groupBy(F.window(ts, size, slide)).agg(
        F.count("*").alias("total"), F.count_if(~sev.eqNullSafe("LOW")).alias("threats"),
        F.avg(F.coalesce("modelFindings.confidence", F.lit(0.0))).alias("avg_confidence"),
        *[F.count_if(sev == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
        *[F.count_if(F.array_contains(alerts, t)).alias(f"alert_{t.lower()}")
          for t in ALERT_TYPES]).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total",
        "threats", "avg_confidence", *[f"n_{s.lower()}" for s in SEVERITIES],
        *[f"alert_{t.lower()}" for t in ALERT_TYPES])


def stream_dashboard(history: DataFrame, out: str, checkpoint: str | None = None,
                     once: bool = True, **options) -> StreamingQuery:
    """Closed windows are appended to ``out``."""
    frame = dashboard_windows(history, **options)
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, history.sparkSession, "dashboard", once)


def stream_scaler(flows: DataFrame, cols: Sequence[str], out: str, checkpoint: str | None = None,
                  once: bool = True) -> StreamingQuery:
    """Merge minima and maxima of arriving flows into versioned scaler tables.

    Version ``n`` is version ``n-1`` merged with batch ``n``; replaying a batch rewrites the same
    version, and min/max merging is idempotent anyway.
    """
    spark = flows.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        part = fit_minmax(batch, cols)
        last = next((i for i in range(batch_id - 1, -1, -1)
                     if path_exists(spark, f"{out}/version={i}/_SUCCESS")), None)
        if last is not None:
            part = merge_scalers(spark.read.parquet(f"{out}/version={last}"), part)
        part.coalesce(1).write.mode("overwrite").parquet(f"{out}/version={batch_id}")
    return _start(flows.writeStream.foreachBatch(merge), checkpoint, spark, "scaler", once)


def latest_scaler(spark, out: str) -> DataFrame:
    """Newest complete scaler version."""
    newest = max((int(name.removeprefix("version=")) for name in child_names(spark, out)
                  if name.startswith("version=")
                  and path_exists(spark, f"{out}/{name}/_SUCCESS")), default=None)
    if newest is None:
        raise ValueError(f"no complete scaler version below {out}")
    return spark.read.parquet(f"{out}/version={newest}")


def stream_flow_features(packets: DataFrame, gap: str, out: str, late: str = "10 minutes",
                         checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Packets to flows by session window; a flow is written once its gap has passed for good."""
    flows = flow_features_windowed(packets.withWatermark("ts", late), gap)
    writer = flows.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, packets.sparkSession, "flows", once)
