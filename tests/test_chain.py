"""Summaries, quarantine, streamed analyses, stored history and paging on small data."""

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import findings, history, openmax
from flowquarry.plans import analyze, learn
from flowquarry.sources import sinks
from flowquarry.sources.history_store import HistoryStore
from flowquarry.sources.params import path_exists, remove_path
from flowquarry.streaming import jobs

FLOWS = "source_file string, `Source IP` string, `Destination Port` string, Protocol string, `Flow Duration` string, class_name string, confidence double, position long"


def _flows(spark):
    rows = [("a", f"10.0.0.{i % 3}", "22" if i < 3 else "x", ["17", "6", "6.0", "17", "odd", "TCP"][i], str(i), "DoS", 0.5, i) for i in range(6)]
    rows += [("b", None, None, None, "inf", "Normal", 0.9, 0), (None, "1.1.1.1", "80", "6", "4", "Normal", 0.8, 1)]
    return spark.createDataFrame(rows, FLOWS)


def test_summary_is_findings_and_profile(spark):
    df = _flows(spark)
    got = {r["source_file"]: r for r in findings.capture_summary(df, position="position").collect()}
    a = got["a"]["traffic_profile"]
    assert a["top_dst_ports"] == {22: 3} and a["unique_dst_ports"] == 1 and a["unique_src_ips"] == 3 and a["avg_flow_duration_us"] == 2
    assert a["protocols"] == {"TCP": 3, "UDP": 2, "odd": 1} and a["avg_fwd_bytes"] is None
    assert got["b"]["traffic_profile"]["protocols"] is None and got["b"]["traffic_profile"]["unique_src_ips"] == 0
    assert got[None]["flow_count"] == 1 and got["a"]["status"] == "abnormal" and got["a"]["class_distribution"] == {"DoS": 6}
    plain = {r["source_file"]: r.asDict() for r in findings.capture_findings(df, position="position").collect()}
    assert all({k: v for k, v in got[f].asDict().items() if k != "traffic_profile"} == plain[f] for f in plain)
    ties = spark.createDataFrame([("t", p) for p in ("17", "6", "47", "x")], "source_file string, Protocol string")
    assert findings.traffic_profile(ties).select(F.map_keys("traffic_profile.protocols")).first()[0] == ["TCP", "UDP", "47", "x"]


def _context(found):
    return found.select("source_file").distinct().withColumns(
        {"networkZone": F.when(F.col("source_file") == "b", "Lab").otherwise("DMZ"), "assetCriticality": F.lit("Low")})


def test_findings_without_valid_context_are_kept_apart(spark):
    found = findings.capture_summary(_flows(spark).where("source_file IS NOT NULL"), position="position")
    verdicts, quarantine = analyze.judge(found, _context(found))
    assert [r["source_file"] for r in verdicts.collect()] == ["a"]
    assert [(r["source_file"], r["errors"]) for r in quarantine.collect()] == [("b", ["networkZone"])]


def test_streamed_batches_count_when_complete(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    flows = _flows(spark).where("source_file IS NOT NULL")
    flows.coalesce(1).write.parquet(src)
    find = lambda df: findings.capture_summary(df, position="position")

    def run(checkpoint):
        stream = spark.readStream.schema(flows.schema).parquet(src)
        jobs.stream_analyses(stream, find, _context, out, now=F.lit("2024-01-02 03:04:05").cast("timestamp"), checkpoint=str(tmp_path / checkpoint)).awaitTermination()
        return {name: sorted(tuple(map(str, r)) for r in jobs.read_batches(spark, out, name).drop("batch").collect()) for name in ("verdicts", "quarantine", "alerts")}
    first = run("ck")
    assert [len(first[n]) for n in ("verdicts", "quarantine")] == [1, 1] and first["alerts"]
    remove_path(spark, f"{out}/_complete/batch=0")
    with pytest.raises(ValueError, match="complete"):
        jobs.read_batches(spark, out, "verdicts")
    assert run("again") == first  # the batch is replayed into the same folders


def test_unmarked_folder_is_not_overwritten(spark, tmp_path):
    path, df = str(tmp_path / "set"), spark.range(3)
    spark.range(7).write.parquet(path)
    remove_path(spark, f"{path}/_SUCCESS")
    with pytest.raises(FileExistsError):
        sinks.materialize_features(df, path)
    assert spark.read.parquet(path).count() == 7
    assert sinks.materialize_features(df, path, replace=True) == 3
    assert sinks.materialize_features(spark.range(9), path) == 3 and path_exists(spark, f"{path}/_SUCCESS")
    assert sinks.materialize_features(df, str(tmp_path / "new")) == 3 and len(list(tmp_path.iterdir())) == 2


def test_softmax_of_broken_logits_is_unknown(spark):
    rows = [(0, [1.0, 5.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, None), (4, [1.0]), (5, [None, 1.0])]
    got = {r["id"]: (r["prediction"], round(r["confidence"], 2)) for r in openmax.msp_predict(
        spark.createDataFrame(rows, "id int, logits array<double>"), 0.0, 2).collect()}
    assert got == {0: (1, 0.98), **{i: (2, 0.0) for i in range(1, 6)}}


def _records(spark, rows):
    flat = spark.createDataFrame(rows, "id string, timestamp string, severity string, confidence double, actions array<string>")
    return flat.select("id", "timestamp", F.lit("f").alias("filename"), F.struct(F.lit("DMZ").alias("networkZone"), F.lit("Low").alias("assetCriticality")).alias("context"),
                       F.struct(F.col("severity").alias("verdict"), F.col("actions").alias("recommendedActions"), F.array(F.lit("SOC")).alias("alertsTriggered")).alias("verdict"),
                       F.struct(F.lit("DoS").alias("attack_type"), "confidence").alias("modelFindings"), F.struct(F.lit(1).cast("long").alias("row_count")).alias("preprocessMeta"))


def test_history_by_day(spark, tmp_path):
    rows = [(f"{d:02d}-{i}", f"2024-01-{d:02d}T{i:02d}:30:00Z", ["LOW", "CRITICAL", None][i % 3], None if i == 4 else i / 10, ["x"] * i) for d in (1, 2, 9, 10) for i in range(6)]
    rows.append(("odd", "no time", "HIGH", 0.5, None))
    every, store = _records(spark, rows), HistoryStore(spark, str(tmp_path / "h"))
    with pytest.raises(ValueError):
        store.totals()
    store.append(every.where("id < '09-3' OR id = 'odd'"))
    store.append(every.where("id >= '09-3' AND id <> 'odd'"))
    now = F.lit("2024-01-10 03:00:00").cast("timestamp")
    assert sorted(r["id"] for r in store.last_24h(now).collect()) == sorted(r["id"] for r in history.last_24h(every, now).collect())
    assert tuple(store.dashboard(now).first()) == tuple(history.dashboard_stats(every, now).first())
    assert [tuple(r) for r in store.recent(8).collect()] == [tuple(r) for r in history.recent_analyses(every, 8).collect()]
    assert store.totals().agg(F.sum("alert_soc"), F.count("*")).first()[:] == (25, 5)
    assert "PartitionFilters: [isnotnull(day" in store.last_24h(now)._jdf.queryExecution().toString()


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_cursor(spark, direction):
    df = spark.createDataFrame([(str(i % 7), i, None if i % 3 == 0 else i % 4) for i in range(23)], "id string, n int, v int")
    last, seen = None, []
    for page in range(6):
        rows = history.page_after(df, "v", direction, last, 4, ("id", "n")).collect()
        assert rows == history.sort_page(df, "v", direction, page, 4, ("id", "n")).collect()
        seen += rows
        last = rows[-1].asDict() if rows else last
    assert len(seen) == 23


@pytest.mark.parametrize("edge_rows", [1, 40, 10**6])
def test_split_takes_the_first_hashes_of_every_class(spark, edge_rows):
    import hashlib
    import math
    rows = [(c, i) for c, n in ((0, 700), (1, 3), (None, 60)) for i in range(n)] + [(2, 5)] * 30
    df = spark.createDataFrame(rows, "y int, id long")
    for frac in (0.0, 0.15, 1.0):
        got = learn.stratified_split(df, frac, edge_rows=edge_rows).collect()
        assert len(got) == len(rows)
        for c in (0, 1, 2, None):
            own = sorted(hashlib.md5(f"{i}|42".encode()).hexdigest() for y, i in rows if y == c)
            taken = sorted(hashlib.md5(f"{r['id']}|42".encode()).hexdigest() for r in got if r["y"] == c and r["is_test"])
            assert taken == own[:math.ceil(frac * len(own))]
