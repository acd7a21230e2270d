"""The driver contract, and a few queries compared with their SQL twins."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


def test_every_twin_has_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 14


@pytest.mark.parametrize("name", ["f11_preprocess", "a2_traffic_profile", "a4_capture_findings",
                                  "a24_evaluate_per_file", "m6_fit_weibull", "m11_hybrid_openmax",
                                  "v8_verdict", "g4_flow_features", "g2_stream_dashboard"])
def test_twin(spark, name):
    import __spark_entry__ as entry
    import check
    db = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = check.rows_of(entry.queries()[name](spark, SF).toArrow())
    assert got == check.rows_of(db.sql(entry.oracle_sql()[name]).to_arrow_table())
