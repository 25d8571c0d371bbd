"""A sample of the catalogue against its SQL twins at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from compare import TABLES, compare  # noqa: E402

DATA = "/root/testdata/sf0.001"
NAMES = ["scalar_arithmetic", "ts_moving_stats", "cs_rank", "asof_carry_limit", "align_statements", "forward_labels", "batch_ic_summary", "benjamini_hochberg",
         "walk_forward_ridge", "ew_covariance", "capped_weights", "trade_replay", "red_flag_values", "sealed_ingest",
         "target_weights", "average_cost", "deflated_ratio", "hac_p_values", "candidate_screen", "factor_store", "value_mix", "industry_features", "report_text_forecasts", "holding_correlations",
         "event_entries", "event_feature_table", "trial_pairing"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = E.queries()[name](spark, DATA).toPandas()
    res = compare(got, con.execute(E.oracle_sql()[name]).df())
    assert res.startswith("ok"), res  # an empty result shows nothing


def test_entry_runs(spark):
    assert E.entry(spark).count() == 1


def test_every_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 200
