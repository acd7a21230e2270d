"""Projection, imputation, scaling, vectors, lookups and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import vectors as V
from flowquarry.functions.numeric import nan_to_num, to_number
from flowquarry.operators import clean, lookup, metrics, scale
from flowquarry.operators.clean import q
from flowquarry.plans import learn, prepare, ranks
from flowquarry.schema import (FEATURES, KNOWN_CLASSES, LABEL_IDS, MODEL_FEATURES, PORT_SERVICES, RENAMES,
                               SERVED_CLASSES, UNKNOWN_CLASSES)
from flowquarry.testbed import adapters as A
from flowquarry.testbed.registry import query

CELLS = ", ".join(f'{A.clean_cell(n)} AS "{n}"' for n in A.FEATURE_NAMES)
WITH = f"WITH flows AS ({A.FLOWS_SQL}), c AS (SELECT source_file, position, \"Label\", {CELLS} FROM flows)"
MEDIANS = ", ".join(f'median("{n}") AS "{n}"' for n in A.FEATURE_NAMES)
FILLED = ", ".join(f'coalesce(c."{n}", m."{n}", 0) AS "{n}"' for n in A.FEATURE_NAMES)
IMPUTED = (f"{WITH}, m AS (SELECT source_file, {MEDIANS} FROM c GROUP BY source_file), "
           f"f AS (SELECT c.source_file, c.position, c.\"Label\", {FILLED} FROM c JOIN m USING (source_file))")


def mean4(names, alias="a"):
    return [F.round(F.avg(q(n)), 4).alias(f"{alias}{i}") for i, n in enumerate(names)]


def mean4_sql(names, alias="a"):
    return ", ".join(f'round(avg("{n}"), 4) AS {alias}{i}' for i, n in enumerate(names))


def cleaned(spark, sf):
    df = clean.coerce_numeric(A.flows(spark, sf), A.FEATURE_NAMES)
    return clean.null_non_finite(df, A.FEATURE_NAMES)


# --- projection and filters -------------------------------------------------------------------

@query("p1_canonicalize_columns", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT source_file, count(*) AS n, round(avg(CAST("Total Fwd Packets" AS DOUBLE)), 4) AS a0,
  round(avg(CAST("Total Length of Bwd Packets" AS DOUBLE)), 4) AS a1 FROM flows GROUP BY 1""")
def _(spark, sf):
    short = {v: k for k, v in RENAMES.items()}
    flows = A.flows(spark, sf)
    df = clean.canonicalize_columns(flows.toDF(*[short.get(c, c) for c in flows.columns]))
    df = clean.coerce_numeric(df, ["Total Fwd Packets", "Total Length of Bwd Packets"])
    return df.groupBy("source_file").agg(
        F.count("*").alias("n"), *mean4(["Total Fwd Packets", "Total Length of Bwd Packets"]))


@query("p2_split_label", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT "Label" AS label, count(*) AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    return clean.split_label(A.flows(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("p3_select_features", f"""{WITH} SELECT source_file,
{mean4_sql(A.FEATURE_NAMES)}, CAST(0 AS DOUBLE) AS missing_sum FROM c GROUP BY 1""")
def _(spark, sf):
    df = clean.select_features(cleaned(spark, sf), A.WANTED, keep=["source_file"])
    return df.groupBy("source_file").agg(*mean4(A.FEATURE_NAMES),
                                         F.sum("Active Mean").alias("missing_sum"))


@query("p4_lock_features", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT "Protocol" AS proto, count("Flow Bytes/s") AS n, 15 AS width FROM flows GROUP BY 1""")
def _(spark, sf):
    flows = A.flows(spark, sf)
    _, names = clean.lock_features(flows, None)
    later, _ = clean.lock_features(flows.select(*[q(c) for c in reversed(flows.columns)]), names)
    return later.groupBy(F.col("Protocol").alias("proto")).agg(
        F.count(q("Flow Bytes/s")).alias("n"), F.lit(len(later.columns)).alias("width"))


@query("p5_drop_non_features", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT "Protocol" AS proto, count(*) AS n, 13 AS width FROM flows GROUP BY 1""")
def _(spark, sf):
    df = clean.drop_non_features(A.flows(spark, sf))
    return df.groupBy(F.col("Protocol").alias("proto")).agg(
        F.count("*").alias("n"), F.lit(len(df.columns)).alias("width"))


@query("p6_coerce_numeric", f"""WITH flows AS ({A.FLOWS_SQL}) SELECT source_file,
count(*) FILTER (TRY_CAST("Flow Bytes/s" AS DOUBLE) IS NULL) AS bad_rate,
count(*) FILTER (TRY_CAST("Destination Port" AS DOUBLE) IS NULL) AS bad_port
FROM flows GROUP BY 1""")
def _(spark, sf):
    df = clean.coerce_numeric(A.flows(spark, sf), ["Flow Bytes/s", "Destination Port"])
    return df.groupBy("source_file").agg(
        F.count_if(q("Flow Bytes/s").isNull()).alias("bad_rate"),
        F.count_if(q("Destination Port").isNull()).alias("bad_port"))


@query("p7_null_non_finite", f"""{WITH} SELECT source_file, count("Flow Bytes/s") AS rates,
count("Flow Packets/s") AS packets, round(max("Flow Bytes/s"), 4) AS top FROM c GROUP BY 1""")
def _(spark, sf):
    return cleaned(spark, sf).groupBy("source_file").agg(
        F.count(q("Flow Bytes/s")).alias("rates"), F.count(q("Flow Packets/s")).alias("packets"),
        F.round(F.max(q("Flow Bytes/s")), 4).alias("top"))


@query("p8_filter_benign", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT source_file, count(*) AS n FROM flows WHERE "Label" = 'BENIGN' GROUP BY 1""")
def _(spark, sf):
    return clean.filter_benign(A.flows(spark, sf)).groupBy("source_file").agg(
        F.count("*").alias("n"))


LABEL_CASE = ("CASE trim(\"Label\") " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in LABEL_IDS.items() if "\x96" not in k) + " ELSE -1 END")
LABELLED = f"WITH flows AS ({A.FLOWS_SQL}), l AS (SELECT *, CAST({LABEL_CASE} AS INT) AS class_id FROM flows)"


@query("p9_filter_known", f"""{LABELLED} SELECT class_id, count(*) AS n FROM l
WHERE class_id IN (0, 1, 2, 3, 5, 6) GROUP BY 1""")
def _(spark, sf):
    df = lookup.map_labels(A.flows(spark, sf))
    return clean.filter_known(df, KNOWN_CLASSES).groupBy("class_id").agg(F.count("*").alias("n"))


@query("p10_filter_unknown", f"""{LABELLED} SELECT source_file, count(*) AS n FROM l
WHERE class_id = 4 GROUP BY 1""")
def _(spark, sf):
    df = lookup.map_labels(A.flows(spark, sf))
    return clean.filter_unknown(df, UNKNOWN_CLASSES).groupBy("source_file").agg(
        F.count("*").alias("n"))


@query("p11_drop_incomplete_rows", f"""{WITH} SELECT source_file, count(*) AS n FROM c WHERE
{' AND '.join(f'"{n}" IS NOT NULL' for n in A.FEATURE_NAMES)} GROUP BY 1""")
def _(spark, sf):
    df = clean.coerce_numeric(A.flows(spark, sf), A.FEATURE_NAMES)
    return clean.drop_incomplete_rows(df, A.FEATURE_NAMES).groupBy("source_file").agg(
        F.count("*").alias("n"))


@query("f14_null_inf_report", "WITH flows AS (" + A.FLOWS_SQL + ") " + " UNION ALL ".join(
    f"""SELECT '{n}' AS feature,
    count(*) FILTER (TRY_CAST("{n}" AS DOUBLE) IS NULL OR isnan(TRY_CAST("{n}" AS DOUBLE))) AS nulls,
    count(*) FILTER (isinf(TRY_CAST("{n}" AS DOUBLE))) AS infs FROM flows""" for n in A.FEATURE_NAMES))
def _(spark, sf):
    df = clean.coerce_numeric(A.flows(spark, sf), A.FEATURE_NAMES)
    return clean.null_inf_report(df, A.FEATURE_NAMES)


# --- imputation and scaling ---------------------------------------------------------------------

MEDIAN_SQL = f"""{WITH} SELECT source_file, {', '.join(
    f'round(median("{n}"), 6) AS m{i}' for i, n in enumerate(A.FEATURE_NAMES))} FROM c GROUP BY 1"""


def _medians(spark, sf):
    got = clean.file_medians(cleaned(spark, sf), A.FEATURE_NAMES)
    return got.select("source_file", *[F.round(q(n), 6).alias(f"m{i}")
                                       for i, n in enumerate(A.FEATURE_NAMES)])


@query("f1_file_medians", MEDIAN_SQL)
def _(spark, sf):
    return _medians(spark, sf)


@query("f1_file_medians_narrowed", MEDIAN_SQL)
def _(spark, sf):
    parts = ranks.grouped_percentiles(cleaned(spark, sf), A.FEATURE_NAMES, ["source_file"], 0.5)
    return parts.select("source_file", *[F.round(q(n), 6).alias(f"m{i}") for i, n in enumerate(A.FEATURE_NAMES)])


@query("f1_impute_median", f"""{IMPUTED} SELECT source_file, {mean4_sql(A.FEATURE_NAMES)},
count(*) AS n FROM f GROUP BY 1""")
def _(spark, sf):
    df = clean.impute_median(cleaned(spark, sf), A.FEATURE_NAMES)
    df = clean.impute_zero(df, A.FEATURE_NAMES)
    return df.groupBy("source_file").agg(*mean4(A.FEATURE_NAMES), F.count("*").alias("n"))


@query("f2_impute_zero", f"""{WITH} SELECT source_file,
round(avg(coalesce("Flow Bytes/s", 0)), 4) AS a0, round(avg(coalesce("Flow Packets/s", 0)), 6) AS a1
FROM c GROUP BY 1""")
def _(spark, sf):
    df = clean.impute_zero(cleaned(spark, sf), ["Flow Bytes/s", "Flow Packets/s"])
    return df.groupBy("source_file").agg(
        F.round(F.avg(q("Flow Bytes/s")), 4).alias("a0"),
        F.round(F.avg(q("Flow Packets/s")), 6).alias("a1"))


SCALER_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, CAST({i} AS INT) AS pos, min("{n}") AS min, max("{n}") AS max FROM c"""
    for i, n in enumerate(A.FEATURE_NAMES))


@query("f3_fit_minmax", f"{WITH} {SCALER_SQL}")
def _(spark, sf):
    return scale.fit_minmax(cleaned(spark, sf), A.FEATURE_NAMES)


@query("f4_merge_scalers", f"{WITH} {SCALER_SQL}")
def _(spark, sf):
    df = cleaned(spark, sf)
    parts = [scale.fit_minmax(df.where(f"source_file {op} 'N'"), A.FEATURE_NAMES)
             for op in ("<", ">=")]
    return scale.merge_scalers(*parts)


def _scaled_sql(low, high, source, names=A.FEATURE_NAMES):
    """Scaled columns s0.. from ``source`` with its own minima and maxima."""
    ends = ", ".join(f'min("{n}") AS lo{i}, max("{n}") AS hi{i}' for i, n in enumerate(names))
    cells = ", ".join(
        f'"{n}" * (CAST({high - low} AS DOUBLE) / (CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END)) '
        f'+ ({low} - lo{i} * (CAST({high - low} AS DOUBLE) / (CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END)))'
        f" AS s{i}" for i, n in enumerate(names))
    return (f", e AS (SELECT {ends} FROM {source}), "
            f"s AS (SELECT source_file, position, \"Label\", {cells} FROM {source}, e)")


S_MEANS = ", ".join(f"round(avg(s{i}), 6) AS a{i}" for i in range(len(A.FEATURE_NAMES)))


def _s_means():
    return [F.round(F.avg(q(n)), 6).alias(f"a{i}") for i, n in enumerate(A.FEATURE_NAMES)]


@query("f5_apply_minmax", f"{IMPUTED}{_scaled_sql(-1, 1, 'f')} SELECT source_file, {S_MEANS} FROM s GROUP BY 1")
def _(spark, sf):
    df = clean.impute_zero(clean.impute_median(cleaned(spark, sf), A.FEATURE_NAMES), A.FEATURE_NAMES)
    scaler = scale.load_scaler(scale.fit_minmax(df, A.FEATURE_NAMES), (-1, 1))
    return scale.apply_minmax(df, scaler).groupBy("source_file").agg(*_s_means())


@query("f6_nan_to_num", f"""{WITH} SELECT source_file, round(avg(coalesce("Flow Bytes/s", 0)), 4) AS a0
FROM c GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf).withColumn("v", nan_to_num(to_number(q("Flow Bytes/s"))))
    return df.groupBy("source_file").agg(F.round(F.avg("v"), 4).alias("a0"))


# --- vectors ------------------------------------------------------------------------------------

V4 = ["Total Fwd Packets", "Total Backward Packets", "Fwd Header Length", "Idle Mean"]
LIST4 = "[" + ", ".join(f'"{n}"' for n in V4) + "]"


def _vector4(spark, sf, keep=("source_file", "position")):
    return scale.to_vector(cleaned(spark, sf), V4, "v", keep=keep)


@query("f7_to_vector", f"""{WITH} SELECT source_file, count(*) AS n,
round(avg(list_sum({LIST4})), 4) AS total, round(avg({LIST4}[3]), 4) AS third FROM c GROUP BY 1""")
def _(spark, sf):
    return _vector4(spark, sf).groupBy("source_file").agg(
        F.count("*").alias("n"), F.round(F.avg(V.total(F.col("v"))), 4).alias("total"),
        F.round(F.avg(F.col("v")[2]), 4).alias("third"))


@query("f8_vector_from_named", f"""{WITH} SELECT source_file, round(avg("Idle Mean"), 4) AS a0,
round(avg(0.0), 4) AS a1, round(avg("Total Fwd Packets"), 4) AS a2 FROM c GROUP BY 1""")
def _(spark, sf):
    named = _vector4(spark, sf).withColumn("names", F.array(*[F.lit(n) for n in V4]))
    picked = named.withColumn("w", V.pick_by_name(F.col("v"), F.col("names"),
                                                  ["Idle Mean", "Bwd IAT Std", "Total Fwd Packets"]))
    return picked.groupBy("source_file").agg(
        *[F.round(F.avg(F.col("w")[i]), 4).alias(f"a{i}") for i in range(3)])


@query("f9_pad_to", f"""{WITH} SELECT source_file, 121 AS width,
round(avg(list_sum({LIST4})), 4) AS total, round(avg(list_sum({LIST4}[1:2])), 4) AS cut
FROM c GROUP BY 1""")
def _(spark, sf):
    df = _vector4(spark, sf).withColumns({"p": V.pad_to(F.col("v"), 121),
                                          "c": V.pad_to(F.col("v"), 2)})
    return df.groupBy("source_file").agg(
        F.max(F.size("p")).alias("width"), F.round(F.avg(V.total(F.col("p"))), 4).alias("total"),
        F.round(F.avg(V.total(F.col("c"))), 4).alias("cut"))


@query("f10_to_grid", f"""{WITH} SELECT source_file, 2 AS rows_, round(avg({LIST4}[3]), 4) AS r1c0,
round(avg({LIST4}[2]), 4) AS r0c1 FROM c GROUP BY 1""")
def _(spark, sf):
    df = _vector4(spark, sf).withColumn("g", V.to_grid(F.col("v"), 2, 2))
    return df.groupBy("source_file").agg(
        F.max(F.size("g")).alias("rows_"), F.round(F.avg(F.col("g")[1][0]), 4).alias("r1c0"),
        F.round(F.avg(F.col("g")[0][1]), 4).alias("r0c1"))


# --- composed preparation -------------------------------------------------------------------------


@query("f11_preprocess", f"""{IMPUTED}{_scaled_sql(0, 1, 'f')} SELECT source_file, count(*) AS row_count,
{len(A.WANTED)} AS feature_count, {S_MEANS} FROM s GROUP BY 1""")
def _(spark, sf):
    flows = A.flows(spark, sf)
    medians, scaler = prepare.fit_cleaning(flows, A.WANTED)
    out = prepare.preprocess(flows, scaler, A.WANTED, medians=medians)
    return out.groupBy("source_file").agg(
        F.count("*").alias("row_count"), F.max(F.size("features")).alias("feature_count"),
        *[F.round(F.avg(F.col("features")[i]), 6).alias(f"a{i}")
          for i in range(len(A.FEATURE_NAMES))])


BENIGN_IMPUTED = (f"{WITH}, b AS (SELECT * FROM c WHERE \"Label\" = 'BENIGN'), m AS (SELECT source_file, "
                  f"{MEDIANS} FROM b GROUP BY source_file), f AS (SELECT c.source_file, c.position, "
                  f"c.\"Label\", {FILLED} FROM b c JOIN m USING (source_file))")


@query("f12_prepare_train",
       f"{BENIGN_IMPUTED}{_scaled_sql(0, 1, 'f')} SELECT source_file, {S_MEANS} FROM s GROUP BY 1")
def _(spark, sf):
    rows, _ = prepare.prepare_train(A.flows(spark, sf), A.FEATURE_NAMES)
    return rows.groupBy("source_file").agg(*[
        F.round(F.avg(F.col("features")[i]), 6).alias(f"a{i}")
        for i in range(len(A.FEATURE_NAMES))])


@query("f13_prepare_labelled", f"""{IMPUTED}{_scaled_sql(-1, 1, 'f')},
y AS (SELECT *, CAST({LABEL_CASE} AS INT) AS class_id FROM s)
SELECT CAST(list_position([0, 1, 2, 3, 5, 6], class_id) - 1 AS INT) AS y, count(*) AS n, 121 AS width,
{S_MEANS} FROM y WHERE class_id IN (0, 1, 2, 3, 5, 6) GROUP BY 1""")
def _(spark, sf):
    flows = A.flows(spark, sf)
    medians, scaler = prepare.fit_cleaning(flows, A.FEATURE_NAMES, feature_range=(-1, 1))
    out = prepare.prepare_labelled(flows, scaler, A.FEATURE_NAMES, medians=medians)
    return out.groupBy("y").agg(
        F.count("*").alias("n"), F.max(F.size("features")).alias("width"),
        *[F.round(F.avg(F.col("features")[i]), 6).alias(f"a{i}")
          for i in range(len(A.FEATURE_NAMES))])


def _full_sql(names) -> str:
    """Cleaned and imputed columns of the full-width flows."""
    cells = ", ".join(f'{A.clean_cell(n)} AS "{n}"' for n in names)
    medians = ", ".join(f'median("{n}") AS "{n}"' for n in names)
    filled = ", ".join(f'coalesce(c."{n}", m."{n}", 0) AS "{n}"' for n in names)
    return (f"WITH flows AS ({A.FULL_FLOWS_SQL}), c AS (SELECT source_file, position, \"Label\", {cells} FROM flows), "
            f"m AS (SELECT source_file, {medians} FROM c GROUP BY source_file), "
            f"f AS (SELECT c.source_file, c.position, c.\"Label\", {filled} FROM c JOIN m USING (source_file))")


def _wide_means(names):
    return ", ".join(f"round(avg(s{i}), 6) AS a{i}" for i in range(len(names)))


def _vector_means(names):
    return [F.round(F.avg(F.col("features")[i]), 6).alias(f"a{i}") for i in range(len(names))]


@query("f11_full_width", f"""{_full_sql(FEATURES)}{_scaled_sql(0, 1, 'f', FEATURES)} SELECT source_file, count(*) AS row_count,
{len(FEATURES)} AS feature_count, {_wide_means(FEATURES)} FROM s GROUP BY 1""")
def _(spark, sf):
    flows = A.full_flows(spark, sf)
    medians, scaler = prepare.fit_cleaning(flows, FEATURES)
    out = prepare.preprocess(flows, scaler, FEATURES, medians=medians)
    return out.groupBy("source_file").agg(
        F.count("*").alias("row_count"), F.max(F.size("features")).alias("feature_count"), *_vector_means(FEATURES))


@query("f13_full_width", f"""{_full_sql(MODEL_FEATURES)}{_scaled_sql(-1, 1, 'f', MODEL_FEATURES)},
y AS (SELECT *, CAST({LABEL_CASE} AS INT) AS class_id FROM s)
SELECT CAST(list_position([0, 1, 2, 3, 5, 6], class_id) - 1 AS INT) AS y, count(*) AS n, 121 AS width,
{_wide_means(MODEL_FEATURES)} FROM y WHERE class_id IN (0, 1, 2, 3, 5, 6) GROUP BY 1""")
def _(spark, sf):
    flows = A.full_flows(spark, sf)
    medians, scaler = prepare.fit_cleaning(flows, MODEL_FEATURES, feature_range=(-1, 1))
    out = prepare.prepare_labelled(flows, scaler, medians=medians)
    return out.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), *_vector_means(MODEL_FEATURES))


# --- lookups --------------------------------------------------------------------------------------

@query("j1_map_labels", f"{LABELLED} SELECT class_id, count(*) AS n FROM l GROUP BY 1")
def _(spark, sf):
    return lookup.map_labels(A.flows(spark, sf)).groupBy("class_id").agg(F.count("*").alias("n"))


@query("j2_remap_known", f"""{LABELLED} SELECT
CAST(list_position([0, 1, 2, 3, 5, 6], class_id) - 1 AS INT) AS y, count(*) AS n
FROM l WHERE class_id IN (0, 1, 2, 3, 5, 6) GROUP BY 1""")
def _(spark, sf):
    df = lookup.remap_known(lookup.map_labels(A.flows(spark, sf)))
    return df.groupBy("y").agg(F.count("*").alias("n"))


@query("j3_class_name", f"""SELECT coalesce(list_extract({SERVED_CLASSES}, l_linenumber), 'Unknown')
AS prediction, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    df = A.table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("class_id"))
    return lookup.class_name(df).groupBy("prediction").agg(F.count("*").alias("n"))


PORT_CASE = ("CASE p " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PORT_SERVICES.items())
             + " ELSE concat('port ', p) END")


@query("j4_port_service", f"""WITH flows AS ({A.FLOWS_SQL}),
p AS (SELECT TRY_CAST("Destination Port" AS INT) AS p FROM flows)
SELECT {PORT_CASE} AS service, count(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf).select(q("Destination Port").try_cast("int").alias("port"))
    return lookup.port_service(df.where("port is not null")).groupBy("service").agg(
        F.count("*").alias("n"))


@query("j5_protocol_name", f"""WITH flows AS ({A.FLOWS_SQL})
SELECT CASE "Protocol" WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1' THEN 'ICMP'
ELSE "Protocol" END AS protocol_name, count(*) AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf).select(F.col("Protocol").alias("protocol"))
    return lookup.protocol_name(df).groupBy("protocol_name").agg(F.count("*").alias("n"))


@query("j9_parameter_grid", f"""WITH s AS ({A.SCORES_SQL})
SELECT CAST(a AS INT) AS a, b, count(*) FILTER (error > a * b) AS above FROM s,
(SELECT unnest([10, 100]) AS a), (SELECT unnest(CAST([0.5, 1.5] AS DOUBLE[])) AS b) GROUP BY 1, 2""")
def _(spark, sf):
    grid = F.broadcast(lookup.parameter_grid(spark, a=[10, 100], b=[0.5, 1.5]))
    return A.scores(spark, sf).crossJoin(grid).groupBy("a", "b").agg(
        F.count_if(F.col("error") > F.col("a") * F.col("b")).alias("above"))


@query("j10_known_unknown_split", f"""{LABELLED} SELECT class_id IN (0, 1, 2) AS known, count(*) AS n
FROM l GROUP BY 1""")
def _(spark, sf):
    df = lookup.map_labels(A.flows(spark, sf)).select("class_id")
    listed = df.where("class_id between 0 and 2")
    known, unknown = lookup.known_unknown_split(df, listed, "class_id")
    count = lambda d, k: d.agg(F.lit(k).alias("known"), F.count("*").alias("n"))
    return count(known, True).unionByName(count(unknown, False))


@query("j11_zero_filled_counts", f"""WITH flows AS ({A.FLOWS_SQL}),
d AS (SELECT unnest(['BENIGN', 'DDoS', 'PortScan', 'Heartbleed']) AS "Label", unnest([0, 1, 2, 3]) AS pos)
SELECT CAST(pos AS INT) AS pos, d."Label", count(flows."Label") AS n FROM d LEFT JOIN flows
ON d."Label" = flows."Label" GROUP BY 1, 2""")
def _(spark, sf):
    return lookup.zero_filled_counts(A.flows(spark, sf), "Label",
                                     ["BENIGN", "DDoS", "PortScan", "Heartbleed"])


# --- splits, positions and class balance -------------------------------------------------------------

@query("m16_stratified_split", f"""WITH r AS (SELECT event_id, event_type,
row_number() OVER (PARTITION BY event_type ORDER BY md5(concat(event_id, '|42')), event_id) AS k,
count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, k <= ceil(n * 0.15) AS is_test, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM r GROUP BY 1, 2""")
def _(spark, sf):
    df = A.table(spark, sf, "events").select("event_id", "event_type")
    return learn.stratified_split(df, 0.15, y="event_type", id="event_id").groupBy(
        "event_type", "is_test").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("w4_row_positions", """SELECT event_id, event_type,
row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS flow_id FROM events""")
def _(spark, sf):
    df = A.table(spark, sf, "events").select("event_id", "event_type")
    return ranks.row_positions(df, ["event_type"], ["event_id"], "flow_id")


@query("a5_class_weights", f"""WITH d AS (SELECT unnest(range(8)) AS class),
c AS (SELECT y, count(*) AS n FROM ({A.CLASSED_SQL}) GROUP BY 1), t AS (SELECT sum(n) AS s, count(*) AS k FROM c)
SELECT CAST(class AS INT) AS class, coalesce(n, 0) AS n, round(coalesce(s / (k * n), 1), 6) AS weight
FROM d LEFT JOIN c ON class = y, t""")
def _(spark, sf):
    w = metrics.class_weights(A.classed(spark, sf), 8)
    return w.select("class", "n", F.round("weight", 6).alias("weight"))


@query("a33_count_samples", f"""{LABELLED} SELECT count(*) AS n FROM l
WHERE class_id IN (0, 1, 2, 3, 5, 6)""")
def _(spark, sf):
    df = clean.filter_known(lookup.map_labels(A.flows(spark, sf)), KNOWN_CLASSES)
    return df.agg(F.count("*").alias("n"))


