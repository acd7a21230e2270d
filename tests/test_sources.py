"""Readers on hand-written files."""

import json

import pytest

from flowquarry.operators import clean
from flowquarry.plans import prepare
from flowquarry.operators.scale import Scaler
from flowquarry.schema import FEATURES, FLOW_HEADER, MODEL_FEATURES
from flowquarry.sources import flows as S
from flowquarry.sources import params as P


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fixed_lists():
    assert len(FEATURES) == 78 and len(MODEL_FEATURES) == 67
    assert len(FLOW_HEADER) == 85 and len(set(FLOW_HEADER)) == 84


def test_padded_and_repeated_header(spark, tmp_path):
    write(tmp_path / "a.csv", " Dst Port, Fwd Header Length,Fwd Header Length ,Label\n"
                              "80,20,40,BENIGN\n22,x,60,DDoS\n")
    write(tmp_path / "note.txt", "ignored\n")
    df = S.read_flows(spark, str(tmp_path))
    assert df.columns == ["source_file", "Dst Port", "Fwd Header Length", "Fwd Header Length.1",
                          "Label"]
    df = clean.coerce_numeric(clean.canonicalize_columns(df), ["Fwd Header Length",
                                                              "Fwd Header Length.1"])
    got = sorted(df.collect(), key=lambda r: r["Destination Port"])
    assert [(r["Fwd Header Length"], r["Fwd Header Length.1"]) for r in got] == [(None, 60.0), (20.0, 40.0)]
    assert {r["source_file"] for r in got} == {"a.csv"}


def test_abbreviated_repeated_header():
    assert S.clean_names(["Fwd Header Len", " Fwd Header Len"]) == ["Fwd Header Len",
                                                                   "Fwd Header Length.1"]


def test_layouts_are_aligned_by_name(spark, tmp_path):
    """Other column order, abbreviated and padded names, the repeated header, a column only some files have."""
    write(tmp_path / "a.csv", "\ufeffFlow ID, Dst Port,Fwd Header Len,Fwd Header Len,Label\n1,80,20,40,BENIGN\n")
    write(tmp_path / "b [1].csv", '"Label","Fwd Header Length"," Fwd Header Length","Destination Port",extra\r\nDDoS,1,2,"22",9\r\n')
    write(tmp_path / "c.csv", "Dst Port,Label,Fwd Header Length,Fwd Header Length.1\n,x,7,8\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "head.csv", "Label,Dst Port,Fwd Header Length,Fwd Header Length\n")
    df = S.read_flows(spark, str(tmp_path))
    assert df.columns == ["source_file", "Dst Port", "Fwd Header Len", "Fwd Header Length.1", "Label"]
    assert {tuple(r) for r in df.collect()} == {
        ("a.csv", "80", "20", "40", "BENIGN"), ("b%20%5B1%5D.csv", "22", "1", "2", "DDoS"), ("c.csv", None, "7", "8", "x")}
    assert set(S.layouts(spark, [str(tmp_path)]).popitem()[1]) and len(S.layouts(spark, [str(tmp_path)])) == 4


def test_swapped_columns(spark, tmp_path):
    write(tmp_path / "a.csv", "Flow Duration,Protocol\n1,6\n")
    write(tmp_path / "b.csv", "Protocol,Flow Duration\n17,2\n")
    got = S.read_flows(spark, str(tmp_path)).select("Flow Duration", "Protocol").collect()
    assert {tuple(r) for r in got} == {("1", "6"), ("2", "17")}


def test_files_that_cannot_be_aligned(spark, tmp_path):
    write(tmp_path / "a.csv", "Flow Duration,Protocol\n1,6\n")
    write(tmp_path / "b.csv", "Protocol,Protocol\n6,1\n")
    with pytest.raises(ValueError, match="Protocol.*b.csv"):
        S.read_flows(spark, str(tmp_path))
    other = tmp_path / "other"
    other.mkdir()
    write(other / "a.csv", "x,y\n1,6\n")
    write(other / "b.csv", "v,w\n6,1\n")
    with pytest.raises(ValueError, match="no column.*a.csv.*b.csv"):
        S.read_flows(spark, str(other))
    with pytest.raises(Exception, match="(?i)header"):
        S.read_flows(spark, str(tmp_path), header=["Flow Duration", "Protocol"]).collect()


def test_union_keeps_shared_columns(spark):
    a = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    b = spark.createDataFrame([(9, 8)], "c int, a int")
    u = S.union_flows([a, b])
    assert u.columns == ["a", "c"] and {tuple(r) for r in u.collect()} == {(1, 3), (8, 9)}


def test_preprocess_variants(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    head = "Flow Duration,Flow Byts/s,Label\n"
    write(d / "f1.csv", head + "10,Infinity,BENIGN\n30,4,BENIGN\n20,NaN,DDoS\n,x,DDoS\n")
    write(d / "f2.csv", head + "5,-Infinity,BENIGN\n")
    write(d / "f3.csv", head)
    df = S.read_flows(spark, str(d))
    names = ["Flow Duration", "Flow Bytes/s", "Idle Max"]
    scaler = Scaler(names, [0.0, 0.0, 7.0], [40.0, 8.0, 7.0])
    out = prepare.preprocess(df, scaler, names)
    got = sorted((r["source_file"], tuple(r["features"]), r["label"]) for r in out.collect())
    # missing Idle Max is 0 and, being constant at 7 in the scaler, becomes 0 - 7
    assert got == [
        ("f1.csv", (0.25, 0.5, -7.0), "BENIGN"), ("f1.csv", (0.5, 0.5, -7.0), "DDoS"),
        ("f1.csv", (0.5, 0.5, -7.0), "DDoS"), ("f1.csv", (0.75, 0.5, -7.0), "BENIGN"),
        ("f2.csv", (0.125, 0.0, -7.0), "BENIGN")]
    manifest = S.capture_manifest(spark, str(d))
    rows = S.empty_capture_rows(manifest, prepare.preprocess_counts(df, names=names))
    assert {r["source_file"]: r["row_count"] for r in rows.collect()} == {
        "f1.csv": 4, "f2.csv": 1, "f3.csv": 0}


def test_no_label_column(spark):
    df = spark.createDataFrame([("f", 1.0)], "source_file string, `Flow Duration` double")
    out = prepare.preprocess(df, Scaler(["Flow Duration"], [0.0], [2.0]), ["Flow Duration"])
    assert [tuple(r) for r in out.select("features", "label").collect()] == [([0.5], None)]


def test_openmax_params_and_features(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps({
        "mavs": {"0": [1.0, 2.0], "1": [3.0, 4.0]}, "weibull_params": {"0": [2.5, 0, 1.5], "1": None},
        "known_classes": [0, 1, 2], "unknown_classes": [4], "tail_size": 200, "alpha_rank": 5,
        "distance_type": "euclidean", "num_known": 3}, indent=1))
    p = P.load_openmax_params(P.read_openmax_params(spark, path))
    assert (p.num_known, p.alpha_rank, p.distance_type) == (3, 5, "euclidean")
    assert p.weibull == {0: (2.5, 1.5), 1: None, 2: None} and p.mav(2) == [0.0, 0.0]
    path = write(tmp_path / "f.json", json.dumps(["b", "a", "c"]))
    assert P.names_of(P.read_feature_list(spark, path)) == ["b", "a", "c"]
    with pytest.warns(UserWarning, match="cosine"):
        P.OpenMaxParams(1, {0: [1.0]}, {0: (1.0, 50.0)}, "cosine")
    with pytest.raises(ValueError):
        P.OpenMaxParams(1, {0: [1.0]}, {}, "manhattan")
