"""Readers and writers, exercised on files Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import clean, metrics, openmax, scale
from flowquarry.operators.clean import q
from flowquarry.plans.storage import scratch_path
from flowquarry.schema import HISTORY_TYPE, RENAMES
from flowquarry.sources import flows as S
from flowquarry.sources import params as P
from flowquarry.sources import sinks
from flowquarry.testbed import adapters as A
from flowquarry.testbed.q_clean import SCALER_SQL, WITH, cleaned
from flowquarry.testbed.q_openset import MAV_SQL
from flowquarry.testbed.registry import query


def flow_csv(spark, sf) -> str:
    """The flows of the adapter as CSV files with padded header names."""
    path = scratch_path(spark, "flows-csv")
    df = A.flows(spark, sf).drop("position")
    padded = df.toDF(*[c if c == "source_file" else f" {c}" for c in df.columns])
    (padded.withColumnRenamed("source_file", "capture")
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path))
    return path


@query("s1_read_flows", f"""WITH flows AS ({A.FLOWS_SQL}) SELECT trim("Label") AS label, count(*) AS n,
round(avg(CAST("Flow Duration" AS DOUBLE)), 4) AS a0,
round(avg(CAST("Fwd Header Length.1" AS DOUBLE)), 4) AS a1 FROM flows GROUP BY 1""")
def _(spark, sf):
    df = S.normalize_headers(S.read_flows(spark, flow_csv(spark, sf)))
    df = clean.coerce_numeric(df, ["Flow Duration", "Fwd Header Length.1"])
    return df.groupBy(F.trim("Label").alias("label")).agg(
        F.count("*").alias("n"), F.round(F.avg(q("Flow Duration")), 4).alias("a0"),
        F.round(F.avg(q("Fwd Header Length.1")), 4).alias("a1"))


@query("s1_mixed_layouts", f"""WITH flows AS ({A.FLOWS_SQL}) SELECT trim("Label") AS label, "Protocol" AS proto, count(*) AS n,
round(avg(CAST("Flow Duration" AS DOUBLE)), 4) AS a0, round(avg(CAST("Fwd Header Length" AS DOUBLE)), 4) AS a1,
round(avg(CAST("Fwd Header Length.1" AS DOUBLE)), 4) AS a2, round(avg(TRY_CAST("Destination Port" AS INT)), 4) AS a3
FROM flows GROUP BY 1, 2""")
def _(spark, sf):
    """Files of two column orders in one folder, both with the header that stands twice, one with short names."""
    path = scratch_path(spark, "flows-csv-mixed")
    df = A.flows(spark, sf).drop("position")
    short = {v: k for k, v in RENAMES.items()}
    one, two = "Fwd Header Length", "Fwd Header Length.1"
    late = [{one: two, two: one}.get(c, c) for c in reversed(df.columns)]  # the repeated names keep their order
    for rows, columns, name in ((df.where("source_file < 'N'"), df.columns, lambda c: c), (df.where("source_file >= 'N'"), late, lambda c: short.get(c, c))):
        # a blank keeps the second one apart for the writer
        named = [q(c).alias(name(one) + " " if c == two else "capture" if c == "source_file" else name(c)) for c in columns]
        rows.select(*named).write.mode("append").option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = clean.canonicalize_columns(S.read_flows(spark, path))
    names = ["Flow Duration", "Fwd Header Length", "Fwd Header Length.1", "Destination Port"]
    return clean.coerce_numeric(df, names).groupBy(F.trim("Label").alias("label"), F.col("Protocol").alias("proto")).agg(
        F.count("*").alias("n"), *[F.round(F.avg(q(n)), 4).alias(f"a{i}") for i, n in enumerate(names)])


@query("s2_normalize_headers", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT "Protocol" AS proto, count("Idle Mean") AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf)
    df = S.normalize_headers(df.toDF(*[f"  {c} " for c in df.columns]))
    return df.groupBy(F.col("Protocol").alias("proto")).agg(F.count(q("Idle Mean")).alias("n"))


@query("s3_dedupe_header", f"""WITH flows AS ({A.FLOWS_SQL}) SELECT source_file,
round(avg(CAST("Fwd Header Length" AS DOUBLE)), 4) AS a0,
round(avg(CAST("Fwd Header Length.1" AS DOUBLE)), 4) AS a1 FROM flows GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf)
    twice = ["Fwd Header Length" if c == "Fwd Header Length.1" else c for c in df.columns]
    df = S.dedupe_header(df.toDF(*twice))
    names = ["Fwd Header Length", "Fwd Header Length.1"]
    return clean.coerce_numeric(df, names).groupBy("source_file").agg(
        *[F.round(F.avg(q(n)), 4).alias(f"a{i}") for i, n in enumerate(names)])


@query("s4_union_flows", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT source_file, count(*) AS n, 15 AS width FROM flows GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf)
    old = df.where("source_file < 'N'").drop("Idle Mean")
    new = df.where("source_file >= 'N'").select(
        *[q(c) for c in reversed(df.columns)], F.lit(1).alias("extra"))
    both = S.union_flows([old, new])
    return both.groupBy("source_file").agg(F.count("*").alias("n"),
                                           F.lit(len(both.columns)).alias("width"))


@query("s5_read_openmax_params", f"""WITH {MAV_SQL} SELECT CAST(class AS INT) AS class, round(mav[1], 6) AS m0,
round(mav[8], 6) AS m7, CASE WHEN class <> 3 THEN CAST(2 AS DOUBLE) END AS wb_shape, 8 AS num_known
FROM mavs""")
def _(spark, sf):
    mavs = openmax.class_mavs(A.activations(spark, sf).where("is_known"), A.KNOWN)
    key = F.col("class").cast("string")
    wb = F.when(F.col("class") != 3, F.array(F.lit(2.0), F.lit(0.0), F.lit(0.5)))
    doc = mavs.agg(F.map_from_entries(F.collect_list(F.struct(key, "mav"))).alias("mavs"),
                   F.map_from_entries(F.collect_list(F.struct(key, wb))).alias("weibull_params"),
                   F.lit(A.KNOWN).alias("num_known"), F.lit(5).alias("alpha_rank"),
                   F.lit(200).alias("tail_size"), F.lit("cosine").alias("distance_type"))
    path = scratch_path(spark, "openmax-json")
    doc.coalesce(1).write.option("ignoreNullFields", False).json(path)
    got = P.read_openmax_params(spark, path)
    return got.select("class", F.round(F.col("mav")[0], 6).alias("m0"),
                      F.round(F.col("mav")[7], 6).alias("m7"), "wb_shape", "num_known")


@query("s6_read_feature_list", f"""SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS pos, f AS feature
FROM (SELECT DISTINCT {A.SOURCE_FILE} AS f FROM lineitem)""")
def _(spark, sf):
    path = scratch_path(spark, "names-json")
    names = A.table(spark, sf, "lineitem").select(F.expr(A.SOURCE_FILE).alias("f")).distinct()
    doc = names.agg(F.to_json(F.array_sort(F.collect_list("f"))).alias("value"))
    doc.coalesce(1).write.text(path)
    return P.read_feature_list(spark, path)


@query("s7_scaler_round_trip", f"{WITH} {SCALER_SQL}")
def _(spark, sf):
    path = scratch_path(spark, "scaler")
    fit = lambda: scale.fit_minmax(cleaned(spark, sf), A.FEATURE_NAMES)
    P.scaler_or_fit(spark, path, fit)
    return P.scaler_or_fit(spark, path, lambda: (_ for _ in ()).throw(AssertionError("refit")))


@query("s8_materialize_features", f"{WITH} SELECT source_file, count(*) AS n, true AS whole "
       "FROM c GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "features")
    rows = cleaned(spark, sf)
    first = sinks.materialize_features(rows, path, "source_file")
    again = sinks.materialize_features(rows.where("false"), path)
    got = spark.read.parquet(path)
    return got.groupBy("source_file").agg(F.count("*").alias("n")).withColumn(
        "whole", F.lit(first == again))


@query("s9_write_metrics", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT trim("Label") AS label, count(*) AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    table = metrics.label_distribution(A.flows(spark, sf).withColumn("Label", F.trim("Label")))
    sinks.write_metrics(table, path)
    return (spark.read.option("header", True).schema("label string, n bigint").csv(path))


@query("s10_append_history", f"""WITH h AS ({A.HISTORY_SQL})
SELECT severity, 2 * count(*) AS n FROM h GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "history")
    records = A.history(spark, sf)
    full = records.select(*[_fit(records, f) for f in HISTORY_TYPE.fields])
    sinks.clear_history(spark, path)
    sinks.append_history(full.withColumn("features", F.array(F.lit(0.0))), path)
    sinks.append_history(full, path)
    return sinks.read_history(spark, path).groupBy(F.col("verdict.verdict").alias("severity")).agg(
        F.count("*").alias("n"))


def _fit(df, field):
    """Cast a nested column to the stored type, absent fields as null."""
    have = df.schema[field.name].dataType
    if not hasattr(field.dataType, "fields"):
        return F.col(field.name).cast(field.dataType)
    return F.struct(*[
        (F.col(f"{field.name}.{f.name}").cast(f.dataType) if f.name in have.names
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in field.dataType.fields]
    ).alias(field.name)


@query("s11_write_threshold", f"""WITH s AS ({A.SCORES_SQL})
SELECT round(quantile_cont(error, 0.97), 6) AS threshold FROM s WHERE source_file = '{A.BENIGN_FILE}'""")
def _(spark, sf):
    path = scratch_path(spark, "threshold")
    benign = A.scores(spark, sf).where(F.col("source_file") == A.BENIGN_FILE)
    cut = metrics.threshold(benign).first()["threshold"]
    P.write_threshold(spark, cut, path, {"method": "percentile"})
    return spark.read.json(path).select(F.round("threshold", 6).alias("threshold"))


@query("s12_empty_captures", f"""WITH p AS ({A.PREDICTIONS_SQL}),
f AS (SELECT DISTINCT source_file FROM p UNION SELECT concat('empty-', l_returnflag) FROM lineitem)
SELECT source_file, count(p.class_name) AS flow_count, coalesce(avg(CASE WHEN class_name <> 'Normal'
THEN 1 ELSE 0 END) FILTER (p.class_name IS NOT NULL) > 0.2, false) AS attack_detected
FROM f LEFT JOIN p USING (source_file) GROUP BY 1""")
def _(spark, sf):
    from flowquarry.operators.findings import capture_findings
    found = capture_findings(A.predictions(spark, sf), position="position")
    names = A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("empty-"), "l_returnflag").alias("source_file")).distinct()
    manifest = found.select("source_file").unionByName(names)
    return S.empty_capture_rows(manifest, found).select("source_file", "flow_count",
                                                        "attack_detected")


@query("s13_capture_manifest", f"""SELECT count(DISTINCT {A.SOURCE_FILE}) AS files, true AS sized
FROM lineitem""")
def _(spark, sf):
    path = scratch_path(spark, "captures")
    df = A.flows(spark, sf).select("source_file", "Flow Duration", "Label")
    (df.repartition("source_file").write.partitionBy("source_file").option("header", True).csv(path))
    listed = S.capture_manifest(spark, path + "/*")
    return listed.agg(F.count("*").alias("files"), (F.min("size_bytes") > 0).alias("sized"))


@query("u3_union_sweeps", f"""WITH s AS ({A.SCORES_SQL})
SELECT 'a' AS method, CAST(NULL AS INT) AS tail_size, CAST(NULL AS INT) AS alpha_rank,
 CAST(0.5 AS DOUBLE) AS threshold, round(avg(y), 4) AS known_acc FROM s
UNION ALL SELECT 'b', 20, 3, NULL, round(avg(y), 4) FROM s""")
def _(spark, sf):
    base = A.scores(spark, sf).agg(F.round(F.avg("y"), 4).alias("known_acc")).withColumns(
        {"unknown_det": F.lit(0.0), "h_score": F.lit(0.0)})
    got = openmax.union_sweeps(
        a=base.withColumn("threshold", F.lit(0.5)),
        b=base.withColumns({"tail_size": F.lit(20), "alpha_rank": F.lit(3)}))
    return got.drop("unknown_det", "h_score")


@query("u4_multi_path_read", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT trim("Label") AS label, count(*) * 2 AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    df = S.read_flows(spark, [flow_csv(spark, sf), flow_csv(spark, sf)])
    return df.groupBy(F.trim("Label").alias("label")).agg(F.count("*").alias("n"))
