"""The supplied tables seen as flows, scores, activations, history and packets.

Each adapter is a list of (column, expression); the expressions are plain SQL that Spark and the
checking database both understand, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.schema import FEATURES

SOURCE_FILE = "concat(l_linestatus, '-', CAST(year(l_shipdate) AS STRING), '.csv')"
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
POSITION = "l_orderkey * 8 + l_linenumber"

_PORT = """CASE
  WHEN l_linestatus = 'O' AND year(l_shipdate) = 2001 THEN 'none'
  WHEN l_linestatus = 'O' AND year(l_shipdate) = 1999 THEN CAST(1000 + l_partkey % 50 AS STRING)
  WHEN l_suppkey % 4 = 0 THEN CASE WHEN l_suppkey % 8 = 0 THEN '53' ELSE '110' END
  WHEN l_linestatus = 'F' THEN CASE year(l_shipdate) WHEN 1995 THEN '22' WHEN 1996 THEN '80'
    WHEN 1997 THEN '25' WHEN 1998 THEN '3306' WHEN 1999 THEN '3389' WHEN 2000 THEN '5900'
    ELSE '9999' END
  ELSE CASE year(l_shipdate) WHEN 1995 THEN '21' WHEN 1996 THEN '8443' WHEN 1997 THEN '445'
    WHEN 1998 THEN '6379' WHEN 2000 THEN '7777' ELSE '9999' END END"""

_LABEL = """CASE WHEN l_returnflag <> 'R' THEN 'BENIGN' ELSE CASE l_linenumber
  WHEN 1 THEN 'DoS Hulk' WHEN 2 THEN 'PortScan' WHEN 3 THEN ' Bot ' WHEN 4 THEN 'FTP-Patator'
  WHEN 5 THEN 'Infiltration' WHEN 6 THEN 'Web Attack – XSS' ELSE 'Web Attack - XSS' END END"""

FLOW_FEATURES = [
    ("Destination Port", _PORT),
    ("Flow Duration", "l_quantity * 100000 + l_partkey"),
    ("Total Fwd Packets", "l_quantity"),
    ("Total Backward Packets", "CAST(l_linenumber AS DOUBLE)"),
    ("Total Length of Fwd Packets", "l_extendedprice"),
    ("Total Length of Bwd Packets", "l_extendedprice * l_discount"),
    ("Flow Bytes/s", "CASE l_linenumber WHEN 7 THEN 'Infinity' WHEN 6 THEN 'NaN' WHEN 5 THEN 'x' "
                     "ELSE CAST(l_extendedprice AS STRING) END"),
    ("Flow Packets/s", "CASE WHEN l_linestatus = 'O' AND year(l_shipdate) = 1998 THEN '-Infinity' "
                       "WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_tax AS STRING) END"),
    ("Fwd Header Length", "l_quantity * 20"),
    ("Fwd Header Length.1", "l_quantity * 20 + l_linenumber"),
    ("Idle Mean", "CAST(5 AS DOUBLE)"),
]
FEATURE_NAMES = [n for n, _ in FLOW_FEATURES]
WANTED = FEATURE_NAMES + ["Active Mean"]  # the last one is absent from the data

FLOWS = [
    ("source_file", SOURCE_FILE), ("position", POSITION),
    ("Source IP", "CASE WHEN year(l_shipdate) = 2001 THEN concat('10.0.0.', "
                  "CAST(l_suppkey % 5 AS STRING)) ELSE concat('10.0.', CAST(l_suppkey % 256 AS "
                  "STRING), '.', CAST(l_partkey % 256 AS STRING)) END"),
    ("Protocol", "CASE WHEN l_linenumber = 7 THEN '47' WHEN l_linenumber % 3 = 0 THEN '6' "
                 "WHEN l_linenumber % 3 = 1 THEN '17' ELSE '1' END"),
    *FLOW_FEATURES, ("Label", _LABEL),
]

def _full_feature(i: int, name: str) -> str:
    """One of the 78 features: those above as they are, the others by a rule, with gaps and a few that hardly vary."""
    if name in dict(FLOW_FEATURES):
        return dict(FLOW_FEATURES)[name]
    if i % 13 == 5:
        return f"CAST(l_linenumber % {i % 3 + 1} AS DOUBLE)"
    value = f"l_quantity * {i % 7 + 1} + l_partkey % {11 + i} + l_tax * {i % 5}"
    return f"CASE WHEN l_linenumber = {i % 9} THEN NULL ELSE {value} END" if i % 4 == 0 else value


# the full width of a flow file; the columns of FLOWS that are no features stay
FULL_FLOWS = [*FLOWS[:4], *[(n, _full_feature(i, n)) for i, n in enumerate(FEATURES)], ("Label", _LABEL)]

# a given prediction per flow, for summaries that need no model
PREDICTIONS = [
    ("source_file", SOURCE_FILE), ("position", POSITION),
    ("class_name", "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND "
                   "year(l_shipdate) <> 1996 THEN 'DoS' WHEN l_returnflag = 'A' AND "
                   "l_linenumber <= year(l_shipdate) - 1996 THEN 'PortScan' "
                   "WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'Unknown' "
                   "WHEN l_returnflag = 'R' AND year(l_shipdate) = 2000 THEN 'Web Attack' "
                   "ELSE 'Normal' END"),
    ("confidence", "5e-1 + l_discount * 4"),
]

ZONE = ("CASE WHEN source_file LIKE 'O%' THEN 'Internal' WHEN source_file LIKE '%1997%' THEN 'DMZ' "
        "ELSE 'External' END")
ASSET = ("CASE WHEN source_file LIKE '%1998%' THEN 'High' WHEN source_file LIKE '%1999%' "
         "THEN 'Medium' ELSE 'Low' END")

# anomaly scores per capture; the capture O-1995.csv is the benign one
SCORES = [
    ("source_file", SOURCE_FILE),
    ("y", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
    ("error", "round(l_extendedprice / 1000, 0) * (1 + l_linenumber)"),
]
BENIGN_FILE = "O-1995.csv"

# true and predicted class of 8 (the last never occurs), scores of three classes
CLASSED = [
    ("id", POSITION),
    ("y", "l_linenumber - 1"),
    ("pred", "CASE WHEN l_discount < 6e-2 THEN l_linenumber - 1 "
             "ELSE CAST(l_suppkey % 7 AS INT) END"),
    ("is_known", "l_linenumber <= 6"), ("confidence", "1 - l_tax * 5"),
]
NUM_CLASSES = 8
RANKED = [
    ("y", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"),
    ("s0", "l_quantity / 50"), ("s1", "l_extendedprice / 100000"),
    ("s2", "l_tax * 10 + CASE WHEN l_returnflag = 'R' THEN 1e-1 ELSE 0 END"),
    ("s3", "l_discount * 10"),
]

KNOWN, DIM = 8, 64

HISTORY = [
    ("id", "CAST(event_id AS STRING)"), ("ts", "ts"),
    ("filename", "concat('capture-', CAST(user_id AS STRING), '.pcap')"),
    ("zone", "CASE user_id % 4 WHEN 0 THEN 'Internal' WHEN 1 THEN 'DMZ' WHEN 2 THEN 'External' "
             "ELSE NULL END"),
    ("asset", "CASE user_id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END"),
    ("severity", "CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' "
                 "WHEN 'purchase' THEN 'HIGH' WHEN 'error' THEN 'CRITICAL' ELSE NULL END"),
    ("attack", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' "
               "WHEN event_id % 5 = 2 THEN 'DoS' ELSE 'PortScan' END"),
    ("confidence", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100) / 100e0 END"),
    ("n_flows", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id * 10 END"),
    ("channels", "CASE event_type WHEN 'view' THEN 'SOC' WHEN 'purchase' THEN 'SOC,Firewall' "
                 "WHEN 'error' THEN 'SOC,Firewall,Admin,SIEM' WHEN 'signup' THEN 'Pager' "
                 "ELSE NULL END"),
]
NOW = "2024-01-20 00:00:00"

PACKETS = [
    ("flow_key", "CAST(user_id AS STRING)"), ("packet_id", "event_id"), ("ts", "ts"),
    ("direction", "CASE WHEN event_id % 3 = 0 THEN 'bwd' ELSE 'fwd' END"),
    ("length", "value"), ("header_len", "CAST(20 + event_id % 2 * 12 AS DOUBLE)"),
    ("flag", "CASE event_type WHEN 'click' THEN 'SYN' WHEN 'view' THEN 'ACK' WHEN 'error' "
             "THEN 'RST' WHEN 'purchase' THEN 'PSH' ELSE 'FIN' END"),
]
GAP = "6 hours"


def sql(cols: list[tuple[str, str]], table: str) -> str:
    """The adapter as a SELECT for the checking database."""
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in cols) + f" FROM {table}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def build(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols])


def flows(spark, sf) -> DataFrame:
    return build(table(spark, sf, "lineitem"), FLOWS)


def full_flows(spark, sf) -> DataFrame:
    return build(table(spark, sf, "lineitem"), FULL_FLOWS)


def predictions(spark, sf) -> DataFrame:
    return build(table(spark, sf, "lineitem"), PREDICTIONS)


def scores(spark, sf) -> DataFrame:
    return build(table(spark, sf, "lineitem"), SCORES)


def classed(spark, sf) -> DataFrame:
    return build(table(spark, sf, "lineitem"), CLASSED)


def ranked(spark, sf) -> DataFrame:
    rows = build(table(spark, sf, "lineitem"), RANKED)
    return rows.select("y", F.array("s0", "s1", "s2", "s3").alias("probabilities"))


def contexts(df: DataFrame) -> DataFrame:
    """Context of every capture in ``df``, from its name."""
    return df.select("source_file").distinct().select(
        "source_file", F.expr(ZONE).alias("networkZone"), F.expr(ASSET).alias("assetCriticality"))


def with_context(df: DataFrame) -> DataFrame:
    return df.withColumns({"networkZone": F.expr(ZONE), "assetCriticality": F.expr(ASSET)})


def activations(spark, sf) -> DataFrame:
    """Classes 0..7 known, 8 and 9 unknown (y = 8); logits are the first eight cells times ten."""
    e = table(spark, sf, "embeddings")
    pen = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        F.col("vec_id").alias("id"), F.least("label", F.lit(KNOWN)).cast("int").alias("y"),
        (F.col("label") < KNOWN).alias("is_known"), pen.alias("penultimate"),
        F.transform(F.slice(pen, 1, KNOWN), lambda x: x * 10.0).alias("logits"))


def shape_history(rows: DataFrame) -> DataFrame:
    """Flat adapter columns to nested history records, with the event time kept."""
    alerts = F.when(F.col("channels").isNotNull(), F.split("channels", ","))
    null = F.lit(None)
    return rows.select(
        "id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .alias("timestamp"), "filename",
        F.struct(F.col("zone").alias("networkZone"), F.col("asset").alias("assetCriticality"))
        .alias("context"),
        F.struct(F.col("severity").alias("verdict"), null.cast("string").alias("summary"),
                 null.cast("string").alias("explanation"),
                 null.cast("string").alias("inferredAttack"), alerts.alias("recommendedActions"),
                 alerts.alias("alertsTriggered")).alias("verdict"),
        F.struct(F.col("attack").alias("attack_type"), "confidence").alias("modelFindings"),
        F.struct(F.col("n_flows").cast("long").alias("row_count")).alias("preprocessMeta"),
        F.col("ts").cast("timestamp").alias("event_time"))


def history(spark, sf) -> DataFrame:
    return shape_history(build(table(spark, sf, "events"), HISTORY))


def packets(spark, sf) -> DataFrame:
    rows = build(table(spark, sf, "events"), PACKETS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, sf, name: str) -> DataFrame:
    """A supplied table as a file stream."""
    schema = table(spark, sf, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf))


# --- the same views for the checking database ------------------------------------------------
FLOWS_SQL = sql(FLOWS, "lineitem")
FULL_FLOWS_SQL = sql(FULL_FLOWS, "lineitem")
PREDICTIONS_SQL = sql(PREDICTIONS, "lineitem")
SCORES_SQL = sql(SCORES, "lineitem")
CLASSED_SQL = sql(CLASSED, "lineitem")
RANKED_SQL = sql(RANKED, "lineitem")
HISTORY_SQL = sql(HISTORY, "events")
PACKETS_SQL = sql(PACKETS, "events")
ACTIVATIONS_SQL = f"""SELECT vec_id AS id, CAST(least(label, {KNOWN}) AS INT) AS y,
  label < {KNOWN} AS is_known, CAST(embedding AS DOUBLE[]) AS penultimate,
  list_transform(CAST(embedding AS DOUBLE[])[1:{KNOWN}], lambda x: x * 10) AS logits
  FROM embeddings"""


def clean_cell(name: str) -> str:
    """Finite number of a text cell, else NULL."""
    n = f'TRY_CAST(trim(CAST("{name}" AS STRING)) AS DOUBLE)'
    return f"CASE WHEN isfinite({n}) THEN {n} END"
