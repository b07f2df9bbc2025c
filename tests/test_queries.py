"""Registered queries against their SQL twins.

A spread of queries by default; TIDEPANEL_ALL=1 runs every one (minutes), TIDEPANEL_SF picks the tables.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, oracle  # noqa: E402

SF = f"/root/testdata/sf{os.environ.get('TIDEPANEL_SF', '0.001')}"
SPREAD = [
    "bars_hourly", "dedup_dates", "clean_all", "fill_interpolate", "technical_all", "technical_all_blocks", "returns_all",
    "regime_features_blocks", "align_macro", "describe_features", "build_features", "ic_matrix_universe", "ic_half_life",
    "assign_folds", "index_walk_forward", "time_series_cv", "classification_report", "meta_features", "momentum_signal_blocks",
    "risk_parity", "cross_sectional_topk", "rolling_beta", "order_deltas", "adv_cap", "trades", "portfolio_run",
    "performance_report", "tail_stats", "outlier_dependence", "check_ordering", "calendar_overlap",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("TIDEPANEL_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), columns) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
