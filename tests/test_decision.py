"""Severities, verdict wording and number formatting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import text
from flowquarry.functions.numeric import exact_round
from flowquarry.operators import clean, decision

# ratio, confidence, attack -> severity for External/Low, Internal/Medium, Internal/High
BY_RATIO = [
    (0.72, 0.85, "DoS", ("CRITICAL", "CRITICAL", "CRITICAL")),
    (0.35, 0.78, "Brute Force", ("CRITICAL", "CRITICAL", "CRITICAL")),
    (0.60, 0.88, "PortScan", ("CRITICAL", "CRITICAL", "CRITICAL")),
    (0.22, 0.40, "PortScan", ("MEDIUM", "HIGH", "CRITICAL")),
    (0.22, 0.90, "Botnet", ("HIGH", "CRITICAL", "CRITICAL")),
    (0.25, 0.40, "Web Attack", ("HIGH", "CRITICAL", "CRITICAL")),
    (0.45, 0.50, "Web Attack", ("CRITICAL", "CRITICAL", "CRITICAL")),
]
CONTEXTS = [("External", "Low"), ("Internal", "Medium"), ("Internal", "High")]
BY_ERROR = [
    (0.70, "PortScan", "External", "Low", "MEDIUM"), (0.85, "PortScan", "External", "Low", "HIGH"),
    (1.00, "PortScan", "External", "Low", "CRITICAL"), (0.70, "DDoS", "External", "Low", "HIGH"),
    (0.70, "PortScan", "External", "High", "HIGH"), (0.70, "PortScan", "Internal", "Low", "HIGH"),
    (0.85, "Ransomware", "Internal", "High", "CRITICAL"), (1.50, "DDoS", "External", "High", "CRITICAL"),
]


def test_severity_by_ratio(spark):
    rows = [(r, c, a, z, s, e) for r, c, a, exp in BY_RATIO for (z, s), e in zip(CONTEXTS, exp)]
    df = spark.createDataFrame(rows, "attack_ratio double, confidence double, attack_type string, "
                                     "networkZone string, assetCriticality string, exp string")
    assert df.where(decision.ratio_rule(df) != F.col("exp")).count() == 0


def test_severity_by_error(spark):
    df = spark.createDataFrame(BY_ERROR, "e double, a string, z string, s string, exp string")
    got = decision.severity_by_error(F.col("e"), F.lit(0.65), F.col("a"), F.col("z"), F.col("s"))
    assert df.where(got != F.col("exp")).count() == 0


def findings(spark, **over):
    base = dict(status="abnormal", attack_detected=True, attack_type="DoS", confidence=0.85,
                attack_ratio=0.72, flow_count=12500,
                class_distribution={"DoS": 9000, "Normal": 3500},
                traffic_profile=dict(top_dst_ports={22: 900, 80: 100}, unique_dst_ports=2,
                                     protocols={"TCP": 1000}, unique_src_ips=3,
                                     avg_flow_duration_us=2500000, avg_fwd_bytes=1200.5))
    base.update(over)
    # through JSON, as a service would receive it: this keeps the order of map entries
    df = spark.createDataFrame([(json.dumps(base),)], "doc string").select(
        decision.findings_from_json(F.col("doc")).alias("f")).select("f.*")
    return df.withColumns({"networkZone": F.lit("DMZ"), "assetCriticality": F.lit("Low")})


def test_abnormal_verdict_text(spark):
    v = decision.verdict(findings(spark)).first()
    assert v["verdict"] == "CRITICAL"
    assert v["summary"] == "Brute-force attack targeting SSH service detected — CRITICAL severity"
    assert v["inferredAttack"] == "Brute-Force Authentication Attack"
    assert v["recommendedActions"][0] == "Enforce account lockout on the SSH service"
    assert v["recommendedActions"][-1] == "Escalate immediately to incident response team"
    assert v["alertsTriggered"] == ["SOC", "Firewall", "Admin", "SIEM"]
    assert v["explanation"] == (
        "The 2D CNN + OpenMax classifier analyzed 12,500 network flows. "
        "72.0% of flows (9,000 flows) were flagged as malicious. "
        "High volume of connections targeting SSH (port 22) with small payload sizes "
        "(1200 bytes avg), consistent with automated credential stuffing or password brute-force "
        "tools. 3 unique source IP(s) observed. Flow classification breakdown — DoS: 9,000 (72.0%), "
        "Normal: 3,500 (28.0%). Context: DMZ network zone, Low criticality asset. "
        "Final severity: CRITICAL.")


def test_profile_free_verdict(spark):
    v = decision.verdict(findings(spark, traffic_profile=None, class_distribution=None,
                                  attack_ratio=0.22, attack_type="PortScan")).first()
    assert v["verdict"] == "MEDIUM" and v["inferredAttack"] == "Anomalous Network Traffic"
    assert "Targeted services: unknown." in v["explanation"] and "breakdown — N/A." in v["explanation"]
    assert v["alertsTriggered"] == ["SOC"] and len(v["recommendedActions"]) == 4


def test_rule_order(spark):
    def label(**p):
        prof = dict(top_dst_ports=None, unique_dst_ports=0, protocols=None, unique_src_ips=0,
                    avg_flow_duration_us=0, avg_fwd_bytes=0.0)
        prof.update(p)
        return decision.infer_attack(findings(spark, traffic_profile=prof)).first()["inferred"]["label"]
    assert label(top_dst_ports={22: 5}, avg_fwd_bytes=9000.0) == "Anomalous Traffic — SSH"
    assert label(top_dst_ports={443: 5}, unique_dst_ports=50) == "Web Application Attack"
    assert label(top_dst_ports={9999: 5}, unique_dst_ports=21) == "Network Reconnaissance / Port Scan"
    assert label(top_dst_ports={9999: 5}, unique_src_ips=11) == "Distributed Attack"
    assert label(top_dst_ports={9999: 5}, unique_src_ips=10) == "Anomalous Traffic — port 9999"


def test_normal_verdict(spark):
    v = decision.verdict(findings(spark, status="normal", confidence=0.9455, flow_count=1234)).first()
    assert v["verdict"] == "LOW" and v["alertsTriggered"] == [] and v["inferredAttack"] is None
    assert f"1,234 network flows and classified the traffic as benign with {0.9455:.1%} " in v["explanation"]
    v = decision.verdict(findings(spark, status="normal", flow_count=0)).first()
    assert v["explanation"].startswith("No network flows could be extracted")


def test_quarantine(spark):
    good, bad = clean.split_valid(findings(spark, confidence=1.5))
    assert good.count() == 0 and bad.first()["errors"] == ["confidence"]
    good, bad = clean.split_valid(findings(spark))
    assert good.count() == 1 and bad.count() == 0


def test_formatting_matches_python(spark):
    rnd = random.Random(8)
    xs = [0.125, 2.5, 33.45, 33.35, 12.25, 12.35, 0.05, 1e6 + 0.5, 99.95, -33.45, 0.0]
    xs += [round(rnd.random() * 100, 2) for _ in range(2000)] + [rnd.random() * 1e5 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 4):
        got = df.select("x", text.fixed(F.col("x"), d), exact_round(F.col("x"), d)).collect()
        for x, s, r in got:
            assert s.replace("-0.0", "0.0") == f"{x:.{d}f}".replace("-0.0", "0.0"), (x, d)
            assert r == pytest.approx(round(x, d), abs=0)
