"""Streaming jobs run to the end of the available data; the sink table is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import clean, packets
from flowquarry.plans.storage import scratch_path
from flowquarry.streaming import jobs
from flowquarry.testbed import adapters as A
from flowquarry.testbed.q_clean import SCALER_SQL, WITH
from flowquarry.testbed.q_decision import VERDICT_SQL, WIDE, wide_findings
from flowquarry.testbed.registry import query


@query("g1_stream_verdicts", f"WITH {WIDE.instead(VERDICT_SQL)} SELECT source_file, verdict, summary, alerts FROM v")
def _(spark, sf):
    """Arriving flows of full width through the model; verdicts and alerts of complete batches."""
    flows = A.build(A.stream(spark, sf, "lineitem"), A.FULL_FLOWS)
    out = scratch_path(spark, "analyses")
    jobs.stream_analyses(flows, wide_findings, A.contexts, out, now=F.lit(A.NOW).cast("timestamp")).awaitTermination()
    told = jobs.read_batches(spark, out, "alerts").groupBy(F.col("filename").alias("source_file")).agg(
        F.collect_set("type").alias("types"))
    verdicts = jobs.read_batches(spark, out, "verdicts").join(told, "source_file", "left")
    listed = F.array_join(F.filter("alertsTriggered", lambda a: F.array_contains("types", a)), "; ")
    return verdicts.select("source_file", "verdict", "summary", F.coalesce(listed, F.lit("")).alias("alerts"))


WINDOWS = f"""h AS ({A.HISTORY_SQL}), w AS (SELECT *, unnest(range(24)) AS back FROM h),
s AS (SELECT *, date_trunc('hour', ts) - to_hours(CAST(back AS INT)) AS start FROM w),
m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOURS AS mark FROM h)
SELECT epoch_us(start) AS start_us, count(*) AS total, count(*) FILTER (severity IS DISTINCT FROM 'LOW') AS threats,
round(avg(coalesce(confidence, 0)), 6) AS avg_confidence, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
count(*) FILTER (list_contains(string_split(channels, ','), 'SOC')) AS alert_soc
FROM s, m WHERE start + INTERVAL 24 HOURS <= mark GROUP BY 1"""


@query("g2_stream_dashboard", f"WITH {WINDOWS}")
def _(spark, sf):
    history = A.shape_history(A.build(A.stream(spark, sf, "events"), A.HISTORY))
    out = scratch_path(spark, "dashboard")
    jobs.stream_dashboard(history, out).awaitTermination()
    return spark.read.parquet(out).select(
        F.unix_micros("start").alias("start_us"), "total", "threats",
        F.round("avg_confidence", 6).alias("avg_confidence"), "n_critical", "alert_soc")


@query("g3_stream_scaler", f"{WITH} {SCALER_SQL}")
def _(spark, sf):
    flows = A.build(A.stream(spark, sf, "lineitem"), A.FLOWS)
    flows = clean.null_non_finite(clean.coerce_numeric(flows, A.FEATURE_NAMES), A.FEATURE_NAMES)
    out = scratch_path(spark, "scalers")
    jobs.stream_scaler(flows, A.FEATURE_NAMES, out).awaitTermination()
    return jobs.latest_scaler(spark, out).select("feature", "pos", "min", "max")


SESSIONS = f"""p AS ({A.PACKETS_SQL}), l AS (SELECT *, lag(ts) OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS prev FROM p),
n AS (SELECT *, prev IS NULL OR ts >= prev + INTERVAL {A.GAP} AS fresh FROM l),
f AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS sid FROM n),
d AS (SELECT *, CASE WHEN fresh THEN NULL ELSE epoch_us(ts) - epoch_us(prev) END AS iat,
 epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY flow_key, sid, direction ORDER BY ts, packet_id)) AS gap FROM f),
g AS (SELECT flow_key, sid, min(ts) AS st, max(ts) AS en, count(*) AS packets,
 count(*) FILTER (direction = 'fwd') AS nf, count(*) FILTER (direction = 'bwd') AS nb,
 coalesce(sum(length) FILTER (direction = 'fwd'), 0) AS lf, coalesce(sum(length) FILTER (direction = 'bwd'), 0) AS lb,
 coalesce(stddev_samp(length), 0) AS ls, coalesce(max(length) FILTER (direction = 'bwd'), 0) AS bmax,
 count(*) FILTER (flag = 'RST') AS rst, coalesce(avg(iat), 0) AS im, coalesce(max(iat), 0) AS ix,
 coalesce(sum(gap) FILTER (direction = 'fwd'), 0) AS ft, coalesce(avg(gap) FILTER (direction = 'bwd'), 0) AS bm
 FROM d GROUP BY 1, 2)"""
VOLUME_SQL = """flow_key, epoch_us(st) AS start_us, packets, epoch_us(en) - epoch_us(st) AS duration, nf AS n_fwd, nb AS n_bwd,
round(lf, 6) AS len_fwd, round(lb, 6) AS len_bwd, round(ls, 6) AS len_std, bmax AS bwd_max, rst,
round(CASE WHEN nf = 0 THEN 0 ELSE nb / nf END, 6) AS down_up"""


def _volume():
    return ["flow_key", F.unix_micros("start").alias("start_us"), "packets",
            F.col("Flow Duration").alias("duration"), F.col("Total Fwd Packets").alias("n_fwd"),
            F.col("Total Backward Packets").alias("n_bwd"),
            F.round("Total Length of Fwd Packets", 6).alias("len_fwd"),
            F.round("Total Length of Bwd Packets", 6).alias("len_bwd"),
            F.round("Packet Length Std", 6).alias("len_std"),
            F.col("Bwd Packet Length Max").alias("bwd_max"), F.col("RST Flag Count").alias("rst"),
            F.round(clean.q("Down/Up Ratio"), 6).alias("down_up")]


@query("g4_flow_features", f"""WITH {SESSIONS} SELECT {VOLUME_SQL}, round(im, 2) AS iat_mean, CAST(ix AS DOUBLE) AS iat_max,
CAST(ft AS DOUBLE) AS fwd_iat_total, round(bm, 2) AS bwd_iat_mean FROM g""")
def _(spark, sf):
    f = packets.flow_features(A.packets(spark, sf), A.GAP)
    return f.select(*_volume(), F.round("Flow IAT Mean", 2).alias("iat_mean"),
                    F.col("Flow IAT Max").alias("iat_max"),
                    F.col("Fwd IAT Total").alias("fwd_iat_total"),
                    F.round("Bwd IAT Mean", 2).alias("bwd_iat_mean"))


@query("g4_flow_features_windowed", f"WITH {SESSIONS} SELECT {VOLUME_SQL} FROM g")
def _(spark, sf):
    return packets.flow_features_windowed(A.packets(spark, sf), A.GAP).select(*_volume())


@query("g4_stream_flow_features", f"""WITH {SESSIONS}, m AS (SELECT date_trunc('millisecond', max(ts)) -
INTERVAL 10 MINUTES AS mark FROM p) SELECT {VOLUME_SQL} FROM g, m WHERE en + INTERVAL {A.GAP} <= mark""")
def _(spark, sf):
    rows = A.build(A.stream(spark, sf, "events"), A.PACKETS)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "packet-flows")
    jobs.stream_flow_features(rows, A.GAP, out).awaitTermination()
    return spark.read.parquet(out).select(*_volume())


