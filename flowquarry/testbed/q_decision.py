"""Verdicts, alerts, history and dashboard."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowquarry.functions.numeric import parse_iso
from flowquarry.operators import clean, decision, findings, history
from flowquarry.plans import analyze, learn, prepare
from flowquarry.operators import scale
from flowquarry.schema import ALERT_TYPES, FEATURES, GRID_CELLS, MODEL_FEATURES, PORT_SERVICES, SEVERITIES
from flowquarry.plans.storage import scratch_path
from flowquarry.sources.history_store import HistoryStore
from flowquarry.sources.params import OpenMaxParams
from flowquarry.testbed import adapters as A
from flowquarry.testbed.q_findings import FINDINGS_SQL, PROFILE_SQL, pairs
from flowquarry.testbed.registry import query

SEV = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
BY_RATIO = f"""{SEV}[least(4, (CASE WHEN attack_ratio < 0.25 THEN 2 WHEN attack_ratio < 0.45 THEN 3 ELSE 4 END)
+ CASE WHEN attack_type IN ('DoS', 'DDoS', 'Botnet') THEN 1 ELSE 0 END
+ CASE WHEN confidence > 0.5 AND attack_ratio > 0.3 THEN 1 ELSE 0 END
+ CASE WHEN asset = 'High' THEN 1 ELSE 0 END + CASE WHEN zone = 'Internal' THEN 1 ELSE 0 END)]"""


def lit(template: str) -> str:
    """Text with {name} to an SQL concatenation."""
    parts = re.split(r"\{(\w+)\}", template.replace("'", "''"))
    return " || ".join(f"'{p}'" if i % 2 == 0 else f"CAST({p}_ AS STRING)"
                       for i, p in enumerate(parts) if p)


def svc(port: str) -> str:
    return ("CASE " + port + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PORT_SERVICES.items())
            + f" ELSE 'port ' || {port} END")


def _chain(what) -> str:
    cond = {"login": "port_ IN (22, 21, 23) AND coalesce(avg_fwd_bytes, 0) < 5000",
            "scan": "ports_ > 20", "distributed": "srcs_ > 10"}
    out = "CASE "
    for name, s in decision.SCENARIOS.items():
        test = cond.get(name, f"port_ IN ({', '.join(map(str, s[0]))})" if s[0] else "true")
        out += f"WHEN {test} THEN {what(s)} "
    return out + "END"


ACTIONS = _chain(lambda s: "[" + ", ".join(lit(a) for a in s[4]) + "]")
# findings + profile + context, then the facts the texts quote
VERDICT_SQL = f"""{FINDINGS_SQL}, {PROFILE_SQL},
tops AS (SELECT source_file, first(k ORDER BY r) AS port_, string_agg({svc('k')}, ', ' ORDER BY r) FILTER (r <= 3) AS targets
  FROM pr WHERE r <= 5 GROUP BY 1),
dist AS (SELECT source_file, string_agg(class_name || ': ' || format('{{:,}}', n) || ' (' ||
  format('{{:.1f}}', n / tot * 100) || '%)', ', ' ORDER BY n DESC, first_at, class_name) AS dist
  FROM (SELECT *, sum(n) OVER (PARTITION BY source_file) AS tot FROM counts) GROUP BY 1),
j AS (SELECT *, {A.ZONE} AS zone, {A.ASSET} AS asset, coalesce(tops.port_, 0) AS port_p FROM findings
  LEFT JOIN profile USING (source_file) LEFT JOIN tops USING (source_file) LEFT JOIN dist USING (source_file)),
k AS (SELECT * EXCLUDE (port_), port_p AS port_, {svc('port_p')} AS svc_,
  format('{{:.0f}}', coalesce(avg_fwd_bytes, 0)) AS bytes_,
  format('{{:.1f}}', coalesce(avg_flow_duration_us, 0) / 1e6) AS seconds_,
  coalesce(unique_src_ips, 0) AS srcs_, coalesce(unique_dst_ports, 0) AS ports_,
  coalesce(targets, 'various') AS targets_, coalesce(targets, 'unknown') AS targets_or_unknown_, {BY_RATIO} AS sev FROM j),
l AS (SELECT *, CASE WHEN port_ <> 0 THEN 'targeting ' || svc_ || ' (port ' || port_ || ')'
   ELSE 'across network services' END AS where_,
  CASE WHEN port_ <> 0 THEN 'Anomalous Traffic — ' || svc_ ELSE 'Anomalous Network Traffic' END AS other_label_ FROM k),
v AS (SELECT source_file, CASE WHEN status = 'normal' THEN 'LOW' ELSE sev END AS verdict,
 CASE WHEN status = 'normal' THEN 'Normal network behavior detected'
  ELSE {_chain(lambda s: lit(s[2]))} || ' — ' || sev || ' severity' END AS summary,
 CASE WHEN status = 'normal' THEN 'The 2D CNN + OpenMax classifier analyzed ' || format('{{:,}}', flow_count) ||
  ' network flows and classified the traffic as benign with ' || format('{{:.1f}}', confidence * 100) ||
  '% average confidence. No significant attack patterns were identified in the captured traffic.'
 ELSE 'The 2D CNN + OpenMax classifier analyzed ' || format('{{:,}}', flow_count) || ' network flows. ' ||
  format('{{:.1f}}', attack_ratio * 100) || '% of flows (' ||
  format('{{:,}}', CAST(trunc(flow_count * attack_ratio) AS BIGINT)) || ' flows) were flagged as malicious. ' ||
  {_chain(lambda s: lit(s[3]))} || ' Flow classification breakdown — ' || dist || '. Context: ' || zone ||
  ' network zone, ' || asset || ' criticality asset. Final severity: ' || sev || '.' END AS explanation,
 CASE WHEN status = 'normal' THEN NULL ELSE {_chain(lambda s: lit(s[1]))} END AS "inferredAttack",
 CASE WHEN status = 'normal' THEN 'Continue standard network monitoring' ELSE array_to_string({ACTIONS}, '; ') ||
  CASE WHEN sev = 'CRITICAL' THEN '; Escalate immediately to incident response team' ELSE '' END END AS actions,
 CASE WHEN status = 'normal' THEN '' ELSE CASE sev WHEN 'MEDIUM' THEN 'SOC' WHEN 'HIGH' THEN 'SOC; Firewall'
  WHEN 'CRITICAL' THEN 'SOC; Firewall; Admin; SIEM' ELSE '' END END AS alerts FROM l)"""
VERDICT_COLS = ["source_file", "verdict", "summary", "explanation", "inferredAttack"]


def _found(spark, sf):
    """Findings of the given predictions, with profile and context."""
    flows = A.build(A.table(spark, sf, "lineitem"), A.FLOWS + A.PREDICTIONS[2:])
    return A.with_context(findings.capture_summary(flows, position="position"))


def _told(v):
    return v.select(*VERDICT_COLS, F.array_join("recommendedActions", "; ").alias("actions"),
                    F.array_join("alertsTriggered", "; ").alias("alerts"))


# --- severity ----------------------------------------------------------------------------------

@query("v1_severity_by_ratio", f"""WITH {FINDINGS_SQL}, c AS (SELECT *, {A.ZONE} AS zone, {A.ASSET} AS asset FROM findings)
SELECT source_file, {BY_RATIO} AS severity FROM c""")
def _(spark, sf):
    f = findings.capture_findings(A.predictions(spark, sf), position="position")
    f = A.with_context(f)
    return f.select("source_file", decision.ratio_rule(f).alias("severity"))


ERR = """least(4, (CASE WHEN e < 0.65 * 1.1 THEN 2 WHEN e < 0.65 * 1.5 THEN 3 ELSE 4 END)
+ CASE WHEN a IN ('DDoS', 'Ransomware') THEN 1 ELSE 0 END + CASE WHEN asset = 'High' THEN 1 ELSE 0 END
+ CASE WHEN zone = 'Internal' THEN 1 ELSE 0 END)"""


@query("v2_severity_by_error", f"""WITH c AS (SELECT *, {A.ZONE} AS zone, {A.ASSET} AS asset FROM
(SELECT {A.SOURCE_FILE} AS source_file, l_extendedprice / 70000 AS e,
CASE l_linenumber WHEN 1 THEN 'DDoS' WHEN 2 THEN 'Ransomware' ELSE 'PortScan' END AS a FROM lineitem))
SELECT source_file, {SEV}[{ERR}] AS severity, count(*) AS n FROM c GROUP BY 1, 2""")
def _(spark, sf):
    rows = A.with_context(A.table(spark, sf, "lineitem").select(
        F.expr(A.SOURCE_FILE).alias("source_file"), (F.col("l_extendedprice") / 70000).alias("e"),
        F.expr("CASE l_linenumber WHEN 1 THEN 'DDoS' WHEN 2 THEN 'Ransomware' ELSE 'PortScan' END")
        .alias("a")))
    sev = decision.severity_by_error(F.col("e"), F.lit(0.65), F.col("a"), F.col("networkZone"),
                                     F.col("assetCriticality"))
    return rows.groupBy("source_file", sev.alias("severity")).agg(F.count("*").alias("n"))


@query("v3_route_alerts", f"""SELECT severity, CASE severity WHEN 'MEDIUM' THEN 'SOC' WHEN 'HIGH' THEN 'SOC,Firewall'
WHEN 'CRITICAL' THEN 'SOC,Firewall,Admin,SIEM' ELSE '' END AS alerts, count(*) AS n FROM ({A.HISTORY_SQL}) GROUP BY 1""")
def _(spark, sf):
    h = A.history(spark, sf).select(F.col("verdict.verdict").alias("severity"))
    return h.select("severity", F.array_join(decision.route_alerts(F.col("severity")), ",")
                    .alias("alerts")).groupBy("severity", "alerts").agg(F.count("*").alias("n"))


@query("v4_infer_attack", f"""WITH {VERDICT_SQL} SELECT source_file, {_chain(lambda s: lit(s[1]))} AS label,
{_chain(lambda s: lit(s[2]))} AS summary, {_chain(lambda s: lit(s[3]))} AS detail FROM l""")
def _(spark, sf):
    p = findings.traffic_profile(A.flows(spark, sf))
    return decision.infer_attack(p).select("source_file", "inferred.label", "inferred.summary",
                                           "inferred.detail")


@query("t6_targeted_services", f"""WITH {VERDICT_SQL} SELECT source_file, targets AS services FROM k
WHERE targets IS NOT NULL""")
def _(spark, sf):
    p = findings.traffic_profile(A.flows(spark, sf)).where("traffic_profile.top_dst_ports is not null")
    return p.select("source_file", F.array_join(decision.targeted_services(
        F.col("traffic_profile.top_dst_ports")), ", ").alias("services"))


@query("v5_verdict_normal", f"WITH {VERDICT_SQL} SELECT * FROM v WHERE verdict = 'LOW'")
def _(spark, sf):
    return _told(decision.verdict_normal(_found(spark, sf)))


@query("v6_verdict_abnormal", f"WITH {VERDICT_SQL} SELECT * FROM v WHERE verdict <> 'LOW'")
def _(spark, sf):
    return _told(decision.verdict_abnormal(_found(spark, sf)))


@query("v7_explanation", f"WITH {VERDICT_SQL} SELECT source_file, explanation FROM v")
def _(spark, sf):
    return decision.verdict(_found(spark, sf)).select("source_file", "explanation")


@query("v8_verdict", f"WITH {VERDICT_SQL} SELECT * FROM v")
def _(spark, sf):
    return _told(decision.verdict(_found(spark, sf)))


@query("v9_actions_by_attack", f"""WITH {FINDINGS_SQL} SELECT source_file, CASE attack_type
WHEN 'PortScan' THEN 'Monitor source IP; Enable IDS logging' ELSE 'Investigate manually; Review logs' END AS actions
FROM findings""")
def _(spark, sf):
    f = findings.capture_findings(A.predictions(spark, sf), position="position")
    return decision.actions_by_attack(f).select("source_file",
                                                F.array_join("actions", "; ").alias("actions"))


@query("z1_custom_rule", f"""WITH {FINDINGS_SQL} SELECT source_file, CASE WHEN status = 'normal' THEN 'LOW'
WHEN attack_type = 'DoS' THEN 'CRITICAL' ELSE 'HIGH' END AS verdict FROM findings""")
def _(spark, sf):
    rule = lambda df: F.when(F.col("attack_type") == "DoS", "CRITICAL").otherwise("HIGH")
    return decision.verdict(_found(spark, sf), rule).select("source_file", "verdict")


@query("p16_validate_findings", """WITH c AS (SELECT *, l_discount * 15 AS confidence,
 CASE WHEN l_linenumber = 1 THEN 'odd' WHEN l_returnflag = 'R' THEN 'abnormal' ELSE 'normal' END AS status,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE 'DoS' END AS attack_type FROM lineitem)
SELECT concat_ws(',', CASE WHEN status = 'odd' THEN 'status' END,
 CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END,
 CASE WHEN l_linenumber - 2 < 0 THEN 'flow_count' END,
 CASE WHEN status = 'abnormal' AND attack_type IS NULL THEN 'attack_type' END,
 CASE WHEN status = 'abnormal' AND NOT l_tax * 15 BETWEEN 0 AND 1 THEN 'attack_ratio' END,
 CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'networkZone' END) AS errors, count(*) AS n FROM c GROUP BY 1""")
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.expr("CASE WHEN l_linenumber = 1 THEN 'odd' WHEN l_returnflag = 'R' THEN 'abnormal' "
               "ELSE 'normal' END").alias("status"),
        (F.col("l_discount") * 15).alias("confidence"), F.lit(True).alias("attack_detected"),
        F.when(F.col("l_linenumber") != 2, "DoS").alias("attack_type"),
        (F.col("l_tax") * 15).alias("attack_ratio"), (F.col("l_linenumber") - 2).alias("flow_count"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'DMZ' WHEN 'R' THEN 'Internal' END")
        .alias("networkZone"), F.lit("Low").alias("assetCriticality"))
    return clean.validate_findings(li).groupBy(F.array_join("errors", ",").alias("errors")).agg(
        F.count("*").alias("n"))


# --- whole workflow -------------------------------------------------------------------------------

# a linear stand-in for a trained model: fixed weights over the scaled features, padded like those of the served one
class Model:
    """Weights, OpenMax parameters and scaler over ``names``, and the same as SQL over ``flows``."""

    def __init__(self, names, ends, flows: str, step: float = 1.0):
        self.names, self.ends, self.flows = names, ends, flows
        self.w = [[((5 * r + 2 * c) % 7 - 3) * step for c in range(len(names))] for r in range(6)]
        self.b = [1.5, 0.0, 0.5, -0.5, 0.0, 0.25]
        self.params = OpenMaxParams(6, {k: [float((k + c) % 3) for c in range(6)] for k in range(6)},
                                    {k: (2.0, 2.0) for k in range(6) if k != 5}, "euclidean", 5)
        self.scaler = scale.Scaler(names, [ends[n][0] for n in names], [ends[n][1] for n in names], -1.0, 1.0)

    def score(self, df):
        width = max(len(self.names), GRID_CELLS if len(self.names) > len(MODEL_NAMES) else 0)
        return learn.linear_scores(df, [row + [0.0] * (width - len(row)) for row in self.w], self.b, "features", "logits")

    def sql(self) -> str:
        """Scaled vector, logits, OpenMax class and probability of every flow."""
        span = lambda n: self.ends[n][1] - self.ends[n][0]
        scaled = ", ".join(f"CAST(coalesce({A.clean_cell(n)}, 0) * {2 / span(n)!r} + ({-1 - self.ends[n][0] * 2 / span(n)!r}) AS DOUBLE)"
                           for n in self.names)
        logits = ", ".join("(" + " + ".join(f"x[{c + 1}] * {w!r}" for c, w in enumerate(self.w[r]))
                           + f" + {self.b[r]})" for r in range(6))
        mav = lambda k: "[" + ", ".join(f"CAST({m} AS DOUBLE)" for m in self.params.mavs[k]) + "]"
        rank = lambda k: " + ".join(
            f"CAST(v[{j + 1}] {'>=' if j < k else '>'} v[{k + 1}] AS INT)" for j in range(6) if j != k)
        w = ", ".join("1" if k == 5 else
                      f"1 - (CASE WHEN {rank(k)} < 5 THEN (5 - ({rank(k)})) / 5 ELSE 0 END) * "
                      f"(1 - exp(-pow(list_distance(v, {mav(k)}) / 2, 2)))" for k in range(6))
        z = ", ".join(f"v[{k}] * w[{k}]" for k in range(1, 7))
        u = " + ".join(f"v[{k}] * (1 - w[{k}])" for k in range(1, 7))
        return f"""mf AS ({self.flows}),
mx AS (SELECT source_file, position, [{scaled}] AS x FROM mf),
ml AS (SELECT source_file, position, [{logits}] AS v FROM mx),
mw AS (SELECT *, [{w}] AS w FROM ml), mz AS (SELECT *, [{z}, {u}] AS z FROM mw),
me AS (SELECT *, list_transform(z, lambda q: exp(q - list_max(z))) AS e FROM mz),
mp AS (SELECT source_file, position, ['Normal', 'Botnet', 'Brute Force', 'DoS', 'PortScan', 'Web Attack', 'Unknown']
 [list_position(e, list_max(e))] AS class_name, list_max(e) / list_sum(e) AS confidence FROM me)"""

    def instead(self, sql: str) -> str:
        """``sql`` over given predictions, with this model's."""
        return sql.replace(f"p AS ({A.PREDICTIONS_SQL})", self.sql() + ", p AS (SELECT * FROM mp)")


MODEL_NAMES = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Flow Packets/s"]
RANGES = {"Flow Duration": (0, 5e6), "Total Fwd Packets": (0, 50), "Total Backward Packets": (1, 7),
          "Flow Packets/s": (0, 0.1)}
SMALL = Model(MODEL_NAMES, RANGES, A.FLOWS_SQL)
WIDE = Model(MODEL_FEATURES, {n: RANGES.get(n, (0, 40.0 * (i % 7 + 1) + 10)) for i, n in enumerate(MODEL_FEATURES)}, A.FULL_FLOWS_SQL, 0.125)
MODEL_FINDINGS = SMALL.instead(FINDINGS_SQL)
MODEL_COLS = ["source_file", "status", "attack_detected", "attack_type", "confidence", "attack_ratio",
              "flow_count", "dominant_class", "class_distribution"]
PROFILE_COLS = ["unique_dst_ports", "unique_src_ips", "avg_flow_duration_us", "avg_fwd_bytes"]


def wide_findings(flows):
    """Findings of raw flows: 67 scaled features, padded to 121 cells, scores, OpenMax, counts and profile in one plan."""
    return analyze.predict_flows(flows, WIDE.scaler, WIDE.score, WIDE.params, position="position")


def _with_profile(df):
    return df.select("*", *[F.col(f"traffic_profile.{c}") for c in PROFILE_COLS], pairs("traffic_profile.top_dst_ports").alias("top_dst_ports"),
                     pairs("traffic_profile.protocols").alias("protocols"))


# --- whole workflow -------------------------------------------------------------------------------

E1_SQL = f"""SELECT v.*, flow_count AS row_count, {len(FEATURES)} AS feature_count, {', '.join(PROFILE_COLS)}, profile.top_dst_ports, protocols
FROM v JOIN findings USING (source_file) JOIN profile USING (source_file)"""


@query("e1_analyze", f"WITH {WIDE.instead(VERDICT_SQL)} {E1_SQL}")
def _(spark, sf):
    """Raw flows of full width to verdicts, through the model."""
    found = wide_findings(A.full_flows(spark, sf))
    v, _ = analyze.judge(found, A.contexts(A.table(spark, sf, "lineitem").select(F.expr(A.SOURCE_FILE).alias("source_file"))))
    return _with_profile(v).select(*VERDICT_COLS, F.array_join("recommendedActions", "; ").alias("actions"),
                                   F.array_join("alertsTriggered", "; ").alias("alerts"), "row_count",
                                   F.col("feature_count").cast("int").alias("feature_count"), *PROFILE_COLS, "top_dst_ports", "protocols")


@query("e1_given_classes", f"""WITH {VERDICT_SQL} SELECT v.*, flow_count AS row_count, {len(FEATURES)} AS feature_count
FROM v JOIN findings USING (source_file)""")
def _(spark, sf):
    flows = A.build(A.table(spark, sf, "lineitem"), A.FLOWS + A.PREDICTIONS[2:])

    def find(df):
        return findings.capture_summary(df, position="position")

    v = analyze.analyze(flows, A.contexts(flows), find)
    return v.select(*VERDICT_COLS, F.array_join("recommendedActions", "; ").alias("actions"),
                    F.array_join("alertsTriggered", "; ").alias("alerts"), "row_count",
                    F.col("feature_count").cast("int").alias("feature_count"))


@query("p16_quarantine", f"""WITH {VERDICT_SQL}, b AS (SELECT source_file, concat_ws(',',
 CASE WHEN source_file LIKE '%1997%' THEN 'networkZone' END, CASE WHEN source_file LIKE '%1999%' THEN 'assetCriticality' END) AS errors FROM findings)
SELECT source_file, CASE WHEN errors = '' THEN verdict END AS verdict, errors FROM b JOIN v USING (source_file)""")
def _(spark, sf):
    """Contexts of some captures break the rules: a zone that is none, no criticality."""
    flows = A.build(A.table(spark, sf, "lineitem"), A.FLOWS + A.PREDICTIONS[2:])
    found = findings.capture_summary(flows, position="position")
    odd = A.contexts(found).withColumns({
        "networkZone": F.when(F.col("source_file").contains("1997"), "Lab").otherwise(F.col("networkZone")),
        "assetCriticality": F.when(~F.col("source_file").contains("1999"), F.col("assetCriticality"))})
    verdicts, quarantine = analyze.judge(found, odd)
    return verdicts.select("source_file", "verdict", F.lit("").alias("errors")).unionByName(
        quarantine.select("source_file", F.lit(None).cast("string").alias("verdict"), F.array_join("errors", ",").alias("errors")))


@query("m18_full_chain", f"""WITH {WIDE.instead(FINDINGS_SQL)}, {PROFILE_SQL} SELECT * FROM findings JOIN profile USING (source_file)""")
def _(spark, sf):
    out = wide_findings(A.full_flows(spark, sf)).withColumn("class_distribution", pairs("class_distribution"))
    return _with_profile(out).drop("traffic_profile")


@query("m18_predict_flows", f"WITH {MODEL_FINDINGS}, {PROFILE_SQL} SELECT * FROM findings JOIN profile USING (source_file)")
def _(spark, sf):
    out = analyze.predict_flows(A.flows(spark, sf), SMALL.scaler, SMALL.score, SMALL.params, MODEL_NAMES,
                                position="position", pad=len(MODEL_NAMES))
    return _with_profile(out.withColumn("class_distribution", pairs("class_distribution"))).drop("traffic_profile")


@query("m19_predict_features", f"WITH {MODEL_FINDINGS} SELECT * FROM findings")
def _(spark, sf):
    vec = prepare.serving_vectors(A.flows(spark, sf), SMALL.scaler, MODEL_NAMES,
                                  ["source_file", "position"], pad=len(MODEL_NAMES))
    names = ["Idle Max", *reversed(MODEL_NAMES)]
    rows = vec.select("source_file", "position", F.concat(F.array(F.lit(9.0)), F.reverse("features"))
                      .alias("values"), F.array(*[F.lit(n) for n in names]).alias("names"))
    out = analyze.predict_features(rows, SMALL.score, SMALL.params, MODEL_NAMES, position="position",
                                   pad=len(MODEL_NAMES))
    return out.withColumn("class_distribution", pairs("class_distribution")).select(*MODEL_COLS)


# --- history -----------------------------------------------------------------------------------------

H = f"h AS ({A.HISTORY_SQL})"
TEXT = lambda c: f"coalesce(nullif({c}, ''), '--')"
FLAT_SQL = f"""id, filename, severity AS verdict, {TEXT('attack')} AS attack, {TEXT('zone')} AS zone,
{TEXT('asset')} AS criticality"""
NOW_SQL = f"TIMESTAMP '{A.NOW}'"
now = lambda: F.lit(A.NOW).cast("timestamp")
ALERTS_SQL = f"""{H}, a AS (SELECT *, unnest(string_split(channels, ',')) AS type FROM h),
al AS (SELECT id || '-' || type AS id, type, severity, {TEXT('attack')} AS "attackType", id AS "analysisId",
channels AS actions, filename FROM a)"""


@query("p12_filter_history", f"WITH {H} SELECT id FROM h WHERE severity = 'CRITICAL' AND zone = 'DMZ'")
def _(spark, sf):
    return history.filter_history(A.history(spark, sf), "CRITICAL", "DMZ").select("id")


@query("p13_filter_alerts", f"WITH {ALERTS_SQL} SELECT id FROM al WHERE type = 'SOC' AND severity = 'HIGH'")
def _(spark, sf):
    return history.filter_alerts(history.explode_alerts(A.history(spark, sf)), "SOC", "HIGH").select("id")


@query("p14_last_24h", f"WITH {H} SELECT id FROM h WHERE ts > {NOW_SQL} - INTERVAL 24 HOURS")
def _(spark, sf):
    return history.last_24h(A.history(spark, sf), now()).select("id")


def _store(spark, sf) -> HistoryStore:
    """The history in day partitions, added in two goes that share a day."""
    store, rows = HistoryStore(spark, scratch_path(spark, "history")), A.history(spark, sf)
    for part in (F.col("event_time") < F.lit(A.NOW).cast("timestamp"), F.col("event_time") >= F.lit(A.NOW).cast("timestamp")):
        store.append(rows.where(part))
    return store


@query("p14_last_24h_by_day", f"WITH {H} SELECT id FROM h WHERE ts > {NOW_SQL} - INTERVAL 24 HOURS")
def _(spark, sf):
    return _store(spark, sf).last_24h(now()).select("id")


@query("p15_flatten_history", f"WITH {H} SELECT {FLAT_SQL}, coalesce(n_flows, 0) AS flows FROM h")
def _(spark, sf):
    return history.flatten_history(A.history(spark, sf)).drop("timestamp")


@query("v10_explode_alerts", f"WITH {ALERTS_SQL} SELECT * FROM al")
def _(spark, sf):
    a = history.explode_alerts(A.history(spark, sf))
    return a.drop("timestamp").withColumn("actions", F.array_join("recommendedActions", ",")).drop(
        "recommendedActions")


@query("x4_parse_iso", f"WITH {H} SELECT id, date_trunc('second', ts) AS at FROM h")
def _(spark, sf):
    h = A.history(spark, sf)
    at = F.date_trunc("second", parse_iso(F.col("timestamp"))).cast("timestamp_ntz")
    return h.select("id", at.alias("at"))


@query("a29_dashboard_stats", f"""WITH {H} SELECT count(*) AS total,
count(*) FILTER (severity IS DISTINCT FROM 'LOW') AS threats,
count(*) FILTER (severity = 'CRITICAL' AND ts > {NOW_SQL} - INTERVAL 24 HOURS) AS critical_24h,
format('{{:.2f}}', avg(coalesce(confidence, 0))) AS avg_confidence FROM h""")
def _(spark, sf):
    return history.dashboard_stats(A.history(spark, sf), now())


@query("a29_dashboard_by_day", f"""WITH {H} SELECT CAST(count(*) AS BIGINT) AS total,
count(*) FILTER (severity IS DISTINCT FROM 'LOW') AS threats,
count(*) FILTER (severity = 'CRITICAL' AND ts > {NOW_SQL} - INTERVAL 24 HOURS) AS critical_24h,
format('{{:.2f}}', avg(coalesce(confidence, 0))) AS avg_confidence FROM h""")
def _(spark, sf):
    return _store(spark, sf).dashboard(now())


def _bars(col: str, members, rows: str) -> str:
    return f"""c AS ({rows}), d AS (SELECT CAST(unnest(range({len(members)})) AS INT) AS pos, unnest({members}) AS {col}),
n AS (SELECT pos, d.{col}, count(c.{col}) AS n FROM d LEFT JOIN c ON c.{col} = d.{col} GROUP BY 1, 2)
SELECT *, n / greatest(max(n) OVER (), 1) AS share FROM n"""


@query("a30_severity_breakdown", f"WITH {H}, {_bars('severity', SEVERITIES, 'SELECT severity FROM h')}")
def _(spark, sf):
    return history.severity_breakdown(A.history(spark, sf))


@query("a31_alert_summary", f"WITH {ALERTS_SQL}, {_bars('type', ALERT_TYPES, 'SELECT type FROM al')}")
def _(spark, sf):
    return history.alert_summary(A.history(spark, sf))


@query("t3_recent_analyses", f"""WITH {H} SELECT {FLAT_SQL},
CAST(CASE WHEN channels IS NULL THEN 0 ELSE len(string_split(channels, ',')) END AS INT) AS n_actions
FROM h ORDER BY ts DESC, id LIMIT 10""")
def _(spark, sf):
    return history.recent_analyses(A.history(spark, sf)).drop("timestamp")


@query("t3_recent_by_day", f"""WITH {H} SELECT {FLAT_SQL},
CAST(CASE WHEN channels IS NULL THEN 0 ELSE len(string_split(channels, ',')) END AS INT) AS n_actions
FROM h ORDER BY ts DESC, id LIMIT 10""")
def _(spark, sf):
    return _store(spark, sf).recent().drop("timestamp")


@query("t4_page_by_cursor", f"""WITH {H} SELECT {FLAT_SQL}, coalesce(n_flows, 0) AS flows FROM h
ORDER BY severity DESC NULLS LAST, id LIMIT 20 OFFSET 40""")
def _(spark, sf):
    flat = history.flatten_history(A.history(spark, sf)).drop("timestamp")
    last = None
    for _ in range(2):  # the two pages before, of which only the last row is kept
        last = history.page_after(flat, "verdict", "desc", last).select("verdict", "id").tail(1)[0].asDict()
    return history.page_after(flat, "verdict", "desc", last)


@query("t4_sort_page", f"""WITH {H} SELECT {FLAT_SQL}, coalesce(n_flows, 0) AS flows FROM h
ORDER BY severity DESC NULLS LAST, id LIMIT 20 OFFSET 40""")
def _(spark, sf):
    flat = history.flatten_history(A.history(spark, sf)).drop("timestamp")
    return history.sort_page(flat, "verdict", "desc", page=2)
