"""Splits, packets, history paging and the streaming path on small data."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import clean, findings, history, lookup, packets, scale
from flowquarry.plans import analyze, learn
from flowquarry.sources.flows import read_flows
from flowquarry.streaming import jobs


@pytest.mark.parametrize("frac", [0.15, 0.2, 1.0])
def test_stratified_split(spark, frac):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4990, 0).otherwise(1).alias("y"))
    got = learn.stratified_split(df, frac)
    sizes = {r["y"]: r["n"] for r in got.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: math.ceil(4990 * frac), 1: math.ceil(10 * frac)}
    assert got.select("id").distinct().count() == 5000


def test_imputed_scaler_equals_two_steps(spark):
    rng = np.random.default_rng(6)
    rows = [(f"f{i % 3}", None if i % 4 == 0 or (i % 3 == 2) else float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "source_file string, a double")
    filled = clean.impute_zero(clean.impute_median(df, ["a"]), ["a"])
    one, sizes = scale.fit_minmax_imputed(df, ["a"])
    assert one.collect() == scale.fit_minmax(filled, ["a"]).collect() and sizes == (3, 20)


def test_label_spellings(spark):
    names = [" BENIGN ", "Web Attack \x96 XSS", "Web Attack – XSS", "Web Attack - XSS", None]
    df = spark.createDataFrame([(n,) for n in names], "Label string")
    assert sorted(r[0] for r in lookup.map_labels(df).select("class_id").collect()) == [-1, -1, 0, 6, 6]


def test_sort_page_nulls_last(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 == 0 else i) for i in range(9)], "id string, v int")
    for direction, exp in (("asc", [1, 2, 4]), ("desc", [8, 7, 5])):
        assert [r["v"] for r in history.sort_page(df, "v", direction, size=3).collect()] == exp
        assert [r["v"] for r in history.sort_page(df, "v", direction, 2, 3).collect()] == [None] * 3


@pytest.mark.parametrize("slice_rows", [3, 40, 10**6])
def test_packets_to_flows(spark, slice_rows):
    rng = np.random.default_rng(9)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for key, n in (("hot", 400), ("cold", 7)):
        t = np.cumsum(rng.exponential(4, n)).round(3)
        rows += [(key, i, start + timedelta(seconds=float(s)), "fwd" if rng.random() < 0.6 else "bwd",
                  float(rng.integers(0, 1500)), 20.0, "ACK") for i, s in enumerate(t)]
    df = spark.createDataFrame(rows, "flow_key string, packet_id long, ts timestamp, direction string, "
                                     "length double, header_len double, flag string")
    got = {(r["flow_key"], r["start"]): r for r in packets.flow_features(
        df, "10 seconds", slice_rows=slice_rows).withColumn(
        "start", F.unix_micros("start")).collect()}
    micros = lambda d: round((d - start).total_seconds() * 1e6)
    base = round(start.timestamp() * 1e6)
    n = 0
    for key in ("hot", "cold"):
        cur = []
        ps = [r for r in rows if r[0] == key]
        for i, p in enumerate(ps):
            cur.append(p)
            if i + 1 == len(ps) or micros(ps[i + 1][2]) - micros(p[2]) >= 10_000_000:
                f = got[key, base + micros(cur[0][2])]
                ts = np.array([micros(x[2]) for x in cur], float)
                bwd = ts[[x[3] == "bwd" for x in cur]]
                assert f["packets"] == len(cur) and f["Flow Duration"] == ts[-1] - ts[0]
                gaps, bg = np.diff(ts), np.diff(bwd)
                assert f["Flow IAT Mean"] == pytest.approx(gaps.mean() if len(gaps) else 0)
                assert f["Flow IAT Std"] == pytest.approx(gaps.std(ddof=1) if len(gaps) > 1 else 0)
                assert f["Bwd IAT Total"] == pytest.approx(bg.sum())
                assert f["Bwd IAT Std"] == pytest.approx(bg.std(ddof=1) if len(bg) > 1 else 0)
                assert f["Bwd IAT Min"] == pytest.approx(bg.min() if len(bg) else 0)
                size = np.array([x[4] for x in cur])
                assert f["Packet Length Variance"] == pytest.approx(size.var(ddof=1) if len(size) > 1 else 0)
                cur, n = [], n + 1
    assert len(got) == n


def test_busy_key_is_cut(spark):
    """One key has most packets, its flows span many slices, several packets share a time; null keys are a key."""
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([0, 0, 1, 2, 30], 3000, p=[0.2, 0.2, 0.3, 0.28, 0.02]))
    rows = [("busy" if i % 50 else None, int(i), int(s), "fwd" if i % 7 else "bwd", float(i % 11), 20.0, "ACK") for i, s in enumerate(t)]
    df = spark.createDataFrame(rows, "flow_key string, packet_id long, s long, direction string, length double, header_len double, flag string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(5)
    whole = packets.flow_features(df, "20 seconds")
    cut = packets.flow_features(df, "20 seconds", slice_rows=25)
    assert packets.fragments(df, "20 seconds", slice_rows=25).select("__slice").distinct().count() > 50
    key = lambda r: (str(r["flow_key"]), r["start"])
    for a, b in zip(sorted(whole.collect(), key=key), sorted(cut.collect(), key=key), strict=True):
        assert [x if isinstance(x, (str, type(a["start"]), type(None))) else pytest.approx(x, abs=1e-6) for x in a] == list(b)
    assert cut.count() > 20
    same = ["flow_key", "start", "end", "packets", "Total Fwd Packets", "ACK Flag Count", "Max Packet Length"]
    windowed = packets.flow_features_windowed(df.where("flow_key IS NOT NULL"), "20 seconds").select(same)
    assert sorted(windowed.collect()) == sorted(cut.where("flow_key IS NOT NULL").select(same).collect())


def test_stream_of_csv_captures(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = "Source IP,Destination Port,Protocol,Flow Duration,Label\n"
    (src / "a.csv").write_text(line + "1.1.1.1,22,6,10,bad\n" * 3 + "1.1.1.2,80,6,10,ok\n")
    (src / "b.csv").write_text(line + "1.1.1.1,22,6,10,ok\n" * 5)
    schema = read_flows(spark, str(src)).drop("source_file").schema

    def judge(batch):
        named = batch.withColumn("class_name", F.when(F.col("Label") == "bad", "DoS").otherwise("Normal")
                                 ).withColumn("confidence", F.lit(0.9))
        ctx = batch.select("source_file").distinct().withColumns(
            {"networkZone": F.lit("Internal"), "assetCriticality": F.lit("Low")})
        find = lambda d: findings.capture_findings(d).join(findings.traffic_profile(d), "source_file", "left")
        return analyze.analyze(named, ctx, find)

    def run():
        stream = (spark.readStream.schema(schema).option("header", True).csv(str(src))
                  .select("*", F.col("_metadata.file_name").alias("source_file")))
        jobs.stream_verdicts(stream, judge, out, checkpoint=str(tmp_path / "ck")).awaitTermination()
        got = spark.read.parquet(out)
        return {r["source_file"]: (r["verdict"], r["row_count"], r["inferredAttack"]) for r in got.collect()}

    first = run()
    assert first == {"a.csv": ("CRITICAL", 4, "Brute-Force Authentication Attack"), "b.csv": ("LOW", 5, None)}
    (src / "c.csv").write_text(line + "1.1.1.1,22,6,10,ok\n")
    assert run() == {**first, "c.csv": ("LOW", 1, None)}
    records = analyze.to_history(spark.read.parquet(out), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert records.select("id").distinct().count() == 3
