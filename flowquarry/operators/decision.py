"""Severity, attack inference, verdict text and alert routing as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import severity_name, upgrade
from flowquarry.functions.text import fixed, joined, percent, template, template_sql, thousands
from flowquarry.operators.clean import q
from flowquarry.operators.lookup import service_of
from flowquarry.plans.joins import fixed_rows
from flowquarry.schema import ALERTS_BY_SEVERITY, FINDINGS_TYPE, PROFILE_TYPE

# --- fixed values: severity rules -----------------------------------------------------------
RATIO_MEDIUM_BELOW, RATIO_HIGH_BELOW = 0.25, 0.45
ERROR_MEDIUM_FACTOR, ERROR_HIGH_FACTOR = 1.1, 1.5
HIGH_RISK_BY_RATIO = ["DoS", "DDoS", "Botnet"]
HIGH_RISK_BY_ERROR = ["DDoS", "Ransomware"]

# --- fixed values: two recommended actions per attack, older rule set -------------------------
ACTIONS_BY_ATTACK = {
    "DDoS": ["Enable rate limiting", "Block source IPs"],
    "Ransomware": ["Isolate affected host", "Disable SMB shares"],
    "PortScan": ["Monitor source IP", "Enable IDS logging"],
}
DEFAULT_ACTIONS = ["Investigate manually", "Review logs"]

ESCALATION = "Escalate immediately to incident response team"
NORMAL_SUMMARY = "Normal network behavior detected"
NORMAL_ACTION = "Continue standard network monitoring"
NO_FLOWS_TEXT = ("No network flows could be extracted from the capture file. "
                 "The PCAP may be too small, corrupted, or contain only non-TCP/UDP traffic.")
BENIGN_TEXT = ("The 2D CNN + OpenMax classifier analyzed {flows} network flows "
               "and classified the traffic as benign with {confidence} average confidence. "
               "No significant attack patterns were identified in the captured traffic.")
ABNORMAL_TEXT = ("The 2D CNN + OpenMax classifier analyzed {flows} network flows. "
                 "{pct}% of flows ({bad} flows) were flagged as malicious. "
                 "{detail} Flow classification breakdown — {dist}. "
                 "Context: {zone} network zone, {asset} criticality asset. "
                 "Final severity: {severity}.")

# --- fixed values: attack inference, first matching rule wins ---------------------------------
# rule name -> (ports it covers, label, summary, detail, actions)
SCENARIOS = {
    "login": (
        [22, 21, 23], "Brute-Force Authentication Attack",
        "Brute-force attack targeting {svc} service detected",
        "High volume of connections targeting {svc} (port {port}) with "
        "small payload sizes ({bytes} bytes avg), consistent with automated "
        "credential stuffing or password brute-force tools. "
        "{srcs} unique source IP(s) observed.",
        ["Enforce account lockout on the {svc} service",
         "Block source IPs with repeated failed {svc} login attempts",
         "Enable multi-factor authentication for {svc} access",
         "Review {svc} authentication logs for compromised accounts"]),
    "web": (
        [80, 443, 8080, 8443], "Web Application Attack",
        "Malicious activity targeting {svc} web service detected",
        "Suspicious traffic directed at {svc} (port {port}) "
        "with {bytes} bytes average payload size. "
        "This may include exploit attempts, SQL injection, XSS, or directory traversal. "
        "{srcs} unique source IP(s) involved across {ports} destination ports.",
        ["Review web application firewall (WAF) logs for attack payloads",
         "Inspect {svc} server access logs for exploit patterns",
         "Patch and update the targeted web application stack",
         "Block attacking source IPs at the reverse proxy"]),
    "mail": (
        [25], "SMTP / Email Service Attack",
        "Attack targeting mail server (SMTP) detected",
        "Anomalous traffic to SMTP service (port 25) detected. "
        "This may indicate email relay abuse, spam injection, or exploitation of "
        "mail server vulnerabilities. {srcs} source IP(s) observed.",
        ["Review SMTP server logs for unauthorized relay attempts",
         "Ensure open relay is disabled on the mail server",
         "Block suspicious source IPs at the mail gateway",
         "Check for known SMTP server vulnerabilities and patch"]),
    "shares": (
        [445, 139], "SMB / NetBIOS Exploitation",
        "Attack targeting SMB/NetBIOS file sharing service detected",
        "High volume of traffic to SMB service (port {port}) detected. "
        "This pattern is consistent with lateral movement, ransomware propagation, "
        "or exploitation of SMB vulnerabilities (e.g., EternalBlue). "
        "{srcs} source IP(s) involved.",
        ["Isolate affected hosts from the network segment",
         "Disable unnecessary SMB shares and services",
         "Scan for EternalBlue and related SMB vulnerabilities",
         "Check for signs of ransomware or lateral movement"]),
    "database": (
        [3306, 5432, 1433, 1521, 27017, 6379], "Database Service Attack",
        "Attack targeting {svc} database service detected",
        "Suspicious connections to {svc} (port {port}) detected. "
        "This may indicate unauthorized database access attempts, SQL injection "
        "via direct connection, or brute-force of database credentials. "
        "{srcs} source IP(s) involved.",
        ["Review {svc} access logs for unauthorized queries",
         "Ensure database is not exposed to untrusted networks",
         "Rotate {svc} credentials as a precaution",
         "Verify database firewall rules restrict access to authorized hosts only"]),
    "desktop": (
        [3389], "Remote Desktop Attack",
        "Brute-force or exploitation targeting RDP service detected",
        "High volume of connections to Remote Desktop (port 3389). "
        "This is commonly targeted for credential brute-forcing or exploitation "
        "of RDP vulnerabilities (e.g., BlueKeep). {srcs} unique source IP(s) observed.",
        ["Enable Network Level Authentication (NLA) on RDP",
         "Restrict RDP access to VPN-only or specific IP ranges",
         "Review Windows Event logs for failed logon attempts",
         "Consider disabling RDP if not essential"]),
    "scan": (
        [], "Network Reconnaissance / Port Scan",
        "Port scanning activity detected across {ports} ports",
        "Traffic directed at {ports} unique destination ports, "
        "indicating systematic port enumeration or network reconnaissance. "
        "Top targeted services: {targets}. "
        "{srcs} source IP(s) involved.",
        ["Log and monitor the scanning source IPs",
         "Verify that only necessary ports are exposed externally",
         "Add scanning sources to a watch list",
         "Review firewall rules to restrict inbound access"]),
    "distributed": (
        [], "Distributed Attack",
        "Distributed attack from {srcs} source IPs detected",
        "Anomalous traffic from {srcs} unique source IPs "
        "targeting {svc} (port {port}). "
        "The distributed nature suggests coordinated botnet activity or DDoS. "
        "Average payload: {bytes} bytes.",
        ["Activate rate limiting and traffic shaping",
         "Block or null-route top attacking source IP ranges",
         "Enable SYN cookies on {svc} service",
         "Coordinate with ISP for upstream traffic filtering if needed"]),
    "other": (
        [], "{other_label}",
        "Suspicious network activity {where} detected",
        "The classifier flagged anomalous flow patterns {where}. "
        "Average forward payload: {bytes} bytes, "
        "average flow duration: {seconds}s. "
        "{srcs} unique source IP(s), {ports} unique destination port(s). "
        "Targeted services: {targets_or_unknown}.",
        ["Investigate traffic to {svc} for exploit or abuse patterns",
         "Capture additional packets for deep inspection",
         "Review IDS/IPS signatures for the flagged traffic",
         "Escalate to security team if patterns persist"]),
}
SMALL_PAYLOAD, MANY_PORTS, MANY_SOURCES = 5000, 20, 10


def severity_by_ratio(attack_ratio: Column, confidence: Column, attack: Column, zone: Column,
                      asset: Column) -> Column:
    """Severity from the share of attack flows, raised by risk, confidence and context."""
    base = (F.when(attack_ratio < RATIO_MEDIUM_BELOW, 1)
            .when(attack_ratio < RATIO_HIGH_BELOW, 2).otherwise(3))
    return severity_name(upgrade(
        base, attack.isin(HIGH_RISK_BY_RATIO), (confidence > 0.5) & (attack_ratio > 0.3),
        asset == "High", zone == "Internal"))


def severity_by_error(error: Column, cut: Column, attack: Column, zone: Column,
                      asset: Column) -> Column:
    """Severity from a reconstruction error relative to its threshold."""
    base = (F.when(error < cut * ERROR_MEDIUM_FACTOR, 1)
            .when(error < cut * ERROR_HIGH_FACTOR, 2).otherwise(3))
    return severity_name(upgrade(base, attack.isin(HIGH_RISK_BY_ERROR), asset == "High",
                                 zone == "Internal"))


def route_alerts(severity: Column) -> Column:
    """Alert channels of a severity."""
    out = F.expr("cast(array() as array<string>)")
    for name, channels in ALERTS_BY_SEVERITY.items():
        if channels:
            out = F.when(severity == name, F.array(*[F.lit(c) for c in channels])).otherwise(out)
    return out


def findings_from_json(doc: Column) -> Column:
    """Findings record from a JSON message; its port keys are text there and become numbers.

    The order of map entries is kept, the first port being the primary one.
    """
    text_keys = FINDINGS_TYPE.simpleString().replace("map<int,", "map<string,")
    got = F.from_json(doc, text_keys)
    profile = got["traffic_profile"]
    fields = [F.transform_keys(profile["top_dst_ports"], lambda k, _: k.try_cast("int"))
              .alias("top_dst_ports"),
              *[profile[f.name].alias(f.name) for f in PROFILE_TYPE.fields[1:]]]
    return F.when(got["traffic_profile"].isNotNull(), got.withField(
        "traffic_profile", F.struct(*fields))).otherwise(got.withField(
            "traffic_profile", F.lit(None).cast(PROFILE_TYPE)))


def targeted_services(top_ports: Column) -> Column:
    """Services of the three most frequent ports."""
    entries = F.map_entries(top_ports)
    ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct(
        (-e["value"]).alias("n"), i.alias("i"), e["key"].alias("port"))))
    return F.transform(F.slice(ordered, 1, 3), lambda e: service_of(e["port"]))


def _facts(profile: Column) -> dict[str, Column]:
    ports = profile["top_dst_ports"]
    port = F.coalesce(F.when(F.size(ports) > 0, F.map_keys(ports)[0]), F.lit(0))
    svc = service_of(port)
    num = lambda f: F.coalesce(profile[f].cast("double"), F.lit(0.0))
    whole = lambda f: F.coalesce(profile[f], F.lit(0)).cast("long")
    where = F.when(port != 0, template("targeting {svc} (port {port})", svc=svc, port=port)
                   ).otherwise("across network services")
    targets = targeted_services(ports)
    return {
        "port": port, "svc": svc, "bytes": fixed(num("avg_fwd_bytes"), 0),
        "avg_bytes": num("avg_fwd_bytes"),
        "seconds": fixed(num("avg_flow_duration_us") / 1e6, 1),
        "srcs": whole("unique_src_ips"), "ports": whole("unique_dst_ports"), "where": where,
        "targets": joined(targets, "various"), "targets_or_unknown": joined(targets, "unknown"),
        "other_label": F.when(port != 0, F.concat(F.lit("Anomalous Traffic — "), svc))
                        .otherwise("Anomalous Network Traffic"),
    }


def infer_attack(df: DataFrame, profile: str = "traffic_profile", out: str = "inferred") -> DataFrame:
    """Attack scenario from the traffic profile: struct of label, summary, detail, actions.

    The facts are projected once, so the rule chain works on plain columns.
    """
    facts = _facts(q(profile))
    rows = df.withColumns({f"__{k}": c for k, c in facts.items()})
    extra = {"login": f" AND __avg_bytes < {SMALL_PAYLOAD}"}
    special = {"scan": f"__ports > {MANY_PORTS}", "distributed": f"__srcs > {MANY_SOURCES}"}
    branches = []
    for name, (ports, label, summary, detail, actions) in SCENARIOS.items():
        fill = lambda text: template_sql(text, "__")
        value = (f"named_struct('label', {fill(label)}, 'summary', {fill(summary)}, "
                 f"'detail', {fill(detail)}, 'actions', array({', '.join(map(fill, actions))}))")
        listed = f"__port IN ({', '.join(map(str, ports))})" + extra.get(name, "") if ports else ""
        test = special.get(name, listed)
        branches.append(f"WHEN {test} THEN {value}" if test else f"ELSE {value}")
    chain = F.expr("CASE " + " ".join(branches) + " END")
    return rows.withColumn(out, chain).drop(*[f"__{k}" for k in facts])


def distribution_text(dist: Column, flows: Column) -> Column:
    """``name: count (share%)`` of each class, most frequent first, ``N/A`` when empty."""
    ordered = F.array_sort(F.transform(F.map_entries(dist), lambda e, i: F.struct(
        (-e["value"]).alias("n"), i.alias("i"), e["key"].alias("k"))))
    per = F.greatest(flows, F.lit(1))
    parts = F.transform(ordered, lambda e: F.concat(
        e["k"], F.lit(": "), thousands(-e["n"]), F.lit(" ("), percent(-e["n"] / per), F.lit(")")))
    return joined(parts, "N/A")


SeverityRule = Callable[[DataFrame], Column]


def ratio_rule(df: DataFrame) -> Column:
    return severity_by_ratio(F.coalesce(F.col("attack_ratio"), F.lit(0.0)), F.col("confidence"),
                             F.col("attack_type"), F.col("networkZone"),
                             F.col("assetCriticality"))


def explanation_normal() -> Column:
    text = template(BENIGN_TEXT, flows=thousands(F.col("flow_count")),
                    confidence=percent(F.col("confidence")))
    return F.when(F.col("flow_count") == 0, NO_FLOWS_TEXT).otherwise(text)


def explanation_abnormal(severity: str = "__severity", inferred: str = "__inferred") -> Column:
    share = F.coalesce(F.col("attack_ratio"), F.lit(0.0))
    return template(
        ABNORMAL_TEXT, flows=thousands(F.col("flow_count")), pct=fixed(share * 100, 1),
        bad=thousands(F.floor(F.col("flow_count") * share)),
        detail=F.col(inferred)["detail"],
        dist=distribution_text(F.col("class_distribution"), F.col("flow_count")),
        zone=F.col("networkZone"), asset=F.col("assetCriticality"), severity=F.col(severity))


def verdict(findings: DataFrame, rule: SeverityRule = ratio_rule) -> DataFrame:
    """Findings with context to verdict columns; only status ``normal`` counts as normal.

    ``rule`` is the pluggable severity strategy: DataFrame in, severity column out.
    """
    rows = infer_attack(findings, "traffic_profile", "__inferred")
    rows = rows.withColumn("__severity", rule(rows))
    normal = F.coalesce(F.col("status") == "normal", F.lit(False))
    pick = lambda a, b: F.when(normal, a).otherwise(b)
    guess, sev = F.col("__inferred"), F.col("__severity")
    actions = F.when(sev == "CRITICAL", F.array_append(guess["actions"], F.lit(ESCALATION))
                     ).otherwise(guess["actions"])
    none = F.lit(None).cast("string")
    return rows.select(
        *[q(c) for c in findings.columns],
        pick(F.lit("LOW"), sev).alias("verdict"),
        pick(F.lit(NORMAL_SUMMARY), F.concat(guess["summary"], F.lit(" — "), sev,
                                             F.lit(" severity"))).alias("summary"),
        pick(explanation_normal(), explanation_abnormal()).alias("explanation"),
        pick(none, guess["label"]).alias("inferredAttack"),
        pick(F.array(F.lit(NORMAL_ACTION)), actions).alias("recommendedActions"),
        route_alerts(pick(F.lit("LOW"), sev)).alias("alertsTriggered"))


def verdict_normal(findings: DataFrame) -> DataFrame:
    """Verdicts of the normal captures only."""
    return verdict(findings.where("status = 'normal'"))


def verdict_abnormal(findings: DataFrame, rule: SeverityRule = ratio_rule) -> DataFrame:
    """Verdicts of every other capture."""
    return verdict(findings.where("not (status <=> 'normal')"), rule)


def actions_by_attack(df: DataFrame, attack: str = "attack_type", out: str = "actions") -> DataFrame:
    """Two recommended actions per attack name (older rule set)."""
    dim = fixed_rows(df.sparkSession, list(ACTIONS_BY_ATTACK.items()),
                     "__attack string, __actions array<string>")
    default = F.array(*[F.lit(a) for a in DEFAULT_ACTIONS])
    return (df.join(dim, q(attack) == F.col("__attack"), "left")
            .withColumn(out, F.coalesce("__actions", default)).drop("__attack", "__actions"))
