"""Capture summaries, top-k and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import text
from flowquarry.operators import findings
from flowquarry.operators.clean import q
from flowquarry.testbed import adapters as A
from flowquarry.testbed.registry import query

# maps travel to the comparison as text: "key:n" in map order
PAIRS = "array_join(transform(map_entries({m}), e -> concat(e.key, ':', e.value)), ',')"


def pairs(m: str):
    return F.expr(PAIRS.format(m=m))


PROFILE_SQL = f"""flows AS ({A.FLOWS_SQL}),
ports AS (SELECT source_file, CAST(TRY_CAST("Destination Port" AS DOUBLE) AS INT) AS k, count(*) AS n
  FROM flows WHERE TRY_CAST("Destination Port" AS DOUBLE) IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, k) AS r FROM ports),
pp AS (SELECT source_file, count(*) AS unique_dst_ports,
  string_agg(k || ':' || n, ',' ORDER BY r) FILTER (r <= 5) AS top_dst_ports FROM pr GROUP BY 1),
protos AS (SELECT source_file, "Protocol" AS k, count(*) AS n FROM flows GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, TRY_CAST(k AS INT) NULLS LAST, k) AS r FROM protos),
tp AS (SELECT source_file, string_agg(CASE k WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1' THEN 'ICMP'
  ELSE k END || ':' || n, ',' ORDER BY r) FILTER (r <= 5) AS protocols FROM tr GROUP BY 1),
w AS (SELECT source_file, count(DISTINCT "Source IP") AS unique_src_ips,
  CAST(trunc(avg(CAST("Flow Duration" AS DOUBLE))) AS BIGINT) AS avg_flow_duration_us,
  round(avg(CAST("Total Length of Fwd Packets" AS DOUBLE)), 1) AS avg_fwd_bytes FROM flows GROUP BY 1),
profile AS (SELECT * FROM w LEFT JOIN pp USING (source_file) LEFT JOIN tp USING (source_file))"""


@query("a2_traffic_profile", f"WITH {PROFILE_SQL} SELECT * FROM profile")
def _(spark, sf):
    p = findings.traffic_profile(A.flows(spark, sf)).select("source_file", "traffic_profile.*")
    return p.withColumns({"top_dst_ports": pairs("top_dst_ports"), "protocols": pairs("protocols")})


COUNTS_SQL = f"""p AS ({A.PREDICTIONS_SQL}), counts AS (SELECT source_file, class_name, count(*) AS n,
sum(confidence) AS cs, min(position) AS first_at FROM p GROUP BY 1, 2)"""
DIST_SQL = "string_agg(class_name || ':' || n, ',' ORDER BY n DESC, first_at, class_name)"
FINDINGS_SQL = f"""{COUNTS_SQL}, g AS (SELECT source_file, CAST(sum(n) AS BIGINT) AS flow_count,
sum(cs) AS cs, coalesce(sum(n) FILTER (class_name <> 'Normal'), 0) AS bad,
arg_max(class_name, n) AS dominant_class, arg_max(class_name, n) FILTER (class_name <> 'Normal') AS top,
{DIST_SQL} AS class_distribution FROM counts GROUP BY 1),
findings AS (SELECT source_file, CASE WHEN bad / flow_count > 0.2 THEN 'abnormal' ELSE 'normal' END AS status,
bad / flow_count > 0.2 AS attack_detected, CASE WHEN bad / flow_count > 0.2 THEN top END AS attack_type,
round(cs / flow_count, 4) AS confidence, round(bad / flow_count, 4) AS attack_ratio, flow_count,
dominant_class, class_distribution FROM g)"""


@query("a3_class_distribution",
       f"WITH {COUNTS_SQL} SELECT source_file, {DIST_SQL} AS class_distribution FROM counts GROUP BY 1")
def _(spark, sf):
    d = findings.class_distribution(A.predictions(spark, sf), position="position")
    return d.select("source_file", pairs("class_distribution").alias("class_distribution"))


@query("a4_capture_findings", f"WITH {FINDINGS_SQL} SELECT * FROM findings")
def _(spark, sf):
    f = findings.capture_findings(A.predictions(spark, sf), position="position")
    return f.withColumn("class_distribution", pairs("class_distribution"))


@query("a32_class_breakdown_pct", f"""WITH {COUNTS_SQL} SELECT source_file,
CAST(sum(n) OVER (PARTITION BY source_file) AS BIGINT) AS total, class_name, n,
round(n * 100.0 / sum(n) OVER (PARTITION BY source_file), 1) AS pct FROM counts""")
def _(spark, sf):
    d = findings.class_distribution(A.predictions(spark, sf), position="position")
    return findings.class_breakdown_pct(d)


@query("m15_per_flow_predictions", f"""WITH e AS ({A.ACTIVATIONS_SQL}),
p AS (SELECT id, list_transform(logits[1:7], lambda x: exp(x)) AS ex FROM e),
s AS (SELECT id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM p),
b AS (SELECT id, pr, list_position(pr, list_max(pr)) AS k FROM s)
SELECT id, CAST(k - 1 AS INT) AS class_id,
['Normal', 'Botnet', 'Brute Force', 'DoS', 'PortScan', 'Web Attack', 'Unknown'][k] AS class_name,
round(pr[k], 4) AS confidence FROM b""")
def _(spark, sf):
    from flowquarry.functions import vectors as V
    a = A.activations(spark, sf).withColumn("probabilities", V.softmax(F.slice("logits", 1, 7)))
    a = a.withColumn("prediction", V.argmax(F.col("probabilities")))
    return findings.per_flow_predictions(a).select("id", "class_id", "class_name", "confidence")


ORDER_SQL = ", ".join(A.ROW_ORDER)


@query("t1_top_ports", f"""WITH {PROFILE_SQL} SELECT k AS port, n, CAST(r AS INT) AS rank FROM (
SELECT k, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY sum(n) DESC, k) AS r FROM ports GROUP BY 1)
WHERE r <= 5""")
def _(spark, sf):
    ports = A.flows(spark, sf).select(q("Destination Port").try_cast("int").alias("port"),
                                      F.lit(0).alias("all"))
    return findings.top_k(ports, ["all"], "port").drop("all")


@query("t2_first_flows", f"""WITH p AS (SELECT {A.SOURCE_FILE} AS source_file, l_extendedprice,
row_number() OVER (PARTITION BY {A.SOURCE_FILE} ORDER BY {ORDER_SQL}) - 1 AS flow_id FROM lineitem)
SELECT * FROM p WHERE flow_id < 200""")
def _(spark, sf):
    df = A.table(spark, sf, "lineitem").withColumn("source_file", F.expr(A.SOURCE_FILE))
    return findings.first_flows(df, A.ROW_ORDER).select("source_file", "l_extendedprice", "flow_id")


@query("w4_number_flows", f"""SELECT source_file, CAST(sum(flow_id) AS BIGINT) AS ids, max(flow_id) AS last_id,
round(avg(flow_id * l_quantity), 2) AS mix
FROM (SELECT {A.SOURCE_FILE} AS source_file, l_quantity,
row_number() OVER (PARTITION BY {A.SOURCE_FILE} ORDER BY {ORDER_SQL}) - 1 AS flow_id FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    df = A.table(spark, sf, "lineitem").withColumn("source_file", F.expr(A.SOURCE_FILE))
    return findings.number_flows(df, A.ROW_ORDER).groupBy("source_file").agg(
        F.sum("flow_id").alias("ids"), F.max("flow_id").alias("last_id"),
        F.round(F.avg(F.col("flow_id") * F.col("l_quantity")), 2).alias("mix"))


@query("t7_previews", f"""SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders
ORDER BY o_orderkey LIMIT 20""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    return findings.preview_flows(o, ["o_orderkey"])


@query("t7_preview_vectors", """SELECT vec_id, round(list_sum(CAST(embedding[1:10] AS DOUBLE[])), 6) AS total, 10 AS width
FROM embeddings ORDER BY vec_id LIMIT 3""")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    shown = findings.preview_vectors(e, ["vec_id"])
    return shown.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("features").alias("width"))


@query("t7_preview_text", """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS shown FROM documents""")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", findings.preview_text(F.col("text")).alias("shown"))


@query("z3_prepare_data", f"""WITH act AS ({A.ACTIVATIONS_SQL}) SELECT id, round(list_max(penultimate), 6) AS peak,
round(penultimate[64], 6) AS last FROM act""")
def _(spark, sf):
    """Another preparation than the grid: the vector with its peak in front."""
    from flowquarry.plans.prepare import as_grid
    g = as_grid(A.activations(spark, sf), "penultimate", "prepared", reshape=lambda v: F.concat(F.array(F.array_max(v)), v))
    return g.select("id", F.round(F.col("prepared")[0], 6).alias("peak"), F.round(F.col("prepared")[64], 6).alias("last"))


@query("x2_text_templates", """SELECT l_orderkey, l_linenumber,
concat('total ', format('{:,}', CAST(trunc(l_extendedprice * 100) AS BIGINT)), ' qty ',
 format('{:.0f}', l_quantity), ' disc ', format('{:.1f}', round_even(l_discount * 100, 1)), '%') AS line
FROM lineitem""")
def _(spark, sf):
    li = A.table(spark, sf, "lineitem")
    line = text.template("total {t} qty {q} disc {d}",
                         t=text.thousands(F.floor(F.col("l_extendedprice") * 100)),
                         q=text.fixed(F.col("l_quantity"), 0), d=text.percent(F.col("l_discount")))
    return li.select("l_orderkey", "l_linenumber", line.alias("line"))


@query("x3_joined_list", """SELECT o_custkey, coalesce(string_agg(o_orderpriority, ', ' ORDER BY o_orderkey)
FILTER (o_orderstatus = 'F'), 'various') AS items FROM orders GROUP BY 1""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.when(
        F.col("o_orderstatus") == "F", F.struct("o_orderkey", "o_orderpriority")))).alias("l"))
    return o.select("o_custkey", text.joined(F.transform("l", lambda s: s["o_orderpriority"]),
                                             "various").alias("items"))


@query("x12_parse_json", """SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events
GROUP BY 1""")
def _(spark, sf):
    e = A.table(spark, sf, "events").select(text.parse_json(F.col("props"), "k bigint").alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("x12_malformed", """WITH t AS (SELECT CASE event_id % 5 WHEN 0 THEN substr(props, 2) WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{}' ELSE props END AS c,
event_id % 5 AS r, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT CASE WHEN r > 2 THEN k END AS k, CASE WHEN r < 2 THEN c END AS malformed, count(*) AS n FROM t GROUP BY 1, 2""")
def _(spark, sf):
    broken = F.expr("""CASE event_id % 5 WHEN 0 THEN substr(props, 2) WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{}' ELSE props END""")
    e = A.table(spark, sf, "events").select(text.parse_checked(broken, "k: bigint").alias("p"))
    return e.groupBy(F.col("p.value.k").alias("k"), F.col("p.malformed").alias("malformed")).agg(F.count("*").alias("n"))


@query("x12_encode", """SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '"' ||
CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"user":' || user_id END || '}' AS encoded FROM events""")
def _(spark, sf):
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user"))
    return A.table(spark, sf, "events").select("event_id", text.encode_json(record).alias("encoded"))


# --- small functions and aliases -------------------------------------------------------------------

@query("x1_trim_and_suffix", f"""WITH flows AS ({A.FLOWS_SQL}) SELECT trim("Label") AS label,
count(*) FILTER (source_file LIKE '%.csv') AS csv, count(*) AS n FROM flows GROUP BY 1""")
def _(spark, sf):
    df = A.flows(spark, sf)
    return df.groupBy(F.trim("Label").alias("label")).agg(
        F.count_if(text.has_suffix(F.col("source_file"))).alias("csv"), F.count("*").alias("n"))


@query("x10_rounding", """SELECT l_orderkey, l_linenumber, CAST(format('{:.1f}', l_extendedprice / 7) AS DOUBLE) AS one,
CAST(trunc(l_extendedprice) AS BIGINT) AS whole FROM lineitem""")
def _(spark, sf):
    from flowquarry.functions.numeric import exact_round
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", exact_round(F.col("l_extendedprice") / 7, 1).alias("one"),
        F.col("l_extendedprice").cast("long").alias("whole"))


@query("x11_map_lookup", f"""WITH {COUNTS_SQL} SELECT source_file,
coalesce(sum(n) FILTER (class_name = 'DoS'), 0)::BIGINT AS dos, first(class_name ORDER BY n DESC, first_at) AS top
FROM counts GROUP BY 1""")
def _(spark, sf):
    d = findings.class_distribution(A.predictions(spark, sf), position="position")
    m = F.col("class_distribution")
    return d.select("source_file", F.coalesce(F.try_element_at(m, F.lit("DoS")), F.lit(0)).alias("dos"),
                    F.map_keys(m)[0].alias("top"))


@query("x15_capped_upgrade", """SELECT l_linenumber, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(l_linenumber % 4
+ CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, 3) + 1] AS severity,
count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    from flowquarry.functions.numeric import severity_name, upgrade
    level = upgrade(F.col("l_linenumber") % 4, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return A.table(spark, sf, "lineitem").groupBy(
        "l_linenumber", severity_name(level).alias("severity")).agg(F.count("*").alias("n"))


@query("w5_top_ports_per_capture",
       f"WITH {PROFILE_SQL} SELECT source_file, k AS port, n, CAST(r AS INT) AS rank FROM pr WHERE r <= 5")
def _(spark, sf):
    ports = A.flows(spark, sf).select("source_file", q("Destination Port").try_cast("int").alias("port"))
    return findings.top_k(ports, ["source_file"], "port")


@query("z2_reshape", f"""WITH act AS ({A.ACTIVATIONS_SQL}) SELECT id, 4 AS rows_, round(penultimate[17], 6) AS r1c0
FROM act""")
def _(spark, sf):
    from flowquarry.functions import vectors as V
    from flowquarry.plans.prepare import as_grid
    g = as_grid(A.activations(spark, sf), "penultimate", reshape=lambda v: V.to_grid(v, 4, 16))
    return g.select("id", F.size("grid").alias("rows_"), F.round(F.col("grid")[1][0], 6).alias("r1c0"))
