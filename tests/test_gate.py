"""The gate of all folds against fold-by-fold fits; sampling and fold membership against plain Python."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import gate, models, splits
from tidepanel.sources import bars as src


@pytest.fixture(scope="module")
def calls(spark):
    """Three series with scores, one of them too short to train on; some rows were never scored."""
    rng = np.random.default_rng(11)
    rows = []
    for t, n in (("A", 150), ("B", 143), ("C", 36)):
        for i in range(n):
            p = 0.5 if i % 17 == 0 else float(rng.uniform(0.2, 0.8))
            r = float(rng.normal(0, 0.01) + 0.01 * (p - 0.5))
            rows.append((t, i, r, p, int(p > 0.5), float(rng.random() < 0.5), float(rng.uniform(0.1, 0.3)), int(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "ticker string, i int, log_ret_1d double, proba_M double, pred_M int, target_direction double, realized_vol_20d double, regime_trend_bullish int")
    return df.withColumn("dt", F.date_add(F.lit("2021-01-01").cast("date"), F.col("i"))).drop("i").cache()


def test_gate_equals_fits_fold_by_fold(calls):
    args = dict(model="M", train=30, warmup=5, test=20, min_rows=20)
    shared = {(r["ticker"], r["dt"]): r for r in gate.gate_walk_forward(calls, **args).collect()}
    single = models.meta_walk_forward(calls, **args).collect()
    assert len(single) == len(shared) == 150 + 143 + 36
    fitted = [r for r in single if r["meta_proba"] != 0.5]
    assert len(fitted) > 60
    for r in single:
        assert shared[(r["ticker"], r["dt"])]["meta_proba"] == pytest.approx(r["meta_proba"], abs=2e-4)


def test_rows_enter_when_their_outcome_is_known(calls):
    folds = splits.expanding_walk_forward(calls, 30, 5, 20)
    rows = gate.gate_rows(calls, folds, "M").toPandas()
    start = dt.date(2021, 1, 1) + dt.timedelta(days=30)
    plain = calls.toPandas()
    known = plain[(plain.proba_M != 0.5) & (plain.dt >= start)].sort_values(["ticker", "dt"])
    # C has 6 scored rows in the range: too few
    assert set(rows.ticker) == {"A", "B"} and (known.ticker == "C").sum() < 10
    for t in ("A", "B"):
        dates = list(known[known.ticker == t].dt)
        assert set(rows[rows.ticker == t].dt) <= set(dates[9:])


def test_no_fold_can_be_fitted(calls):
    out = gate.gate_walk_forward(calls, "M", train=30, warmup=5, test=20, min_rows=10_000)
    assert out.filter("meta_pred = 1 and meta_proba = 0.5").count() == out.count() == 329
    assert gate.gate_walk_forward(calls.limit(0), "M").count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 200, 500])
def test_sample_is_the_start_of_the_digest_order(calls, n):
    keys = [(r["ticker"], r["dt"]) for r in calls.select("ticker", "dt").collect()]
    first = sorted(keys, key=lambda k: hashlib.md5(f"{k[0]}|{k[1]}|7".encode()).hexdigest())[:n]
    assert {(r["ticker"], r["dt"]) for r in src.sample_rows(calls, n, seed=7).collect()} == set(first)


def test_sample_of_repeated_rows(calls):
    twice = calls.unionByName(calls).unionByName(calls)
    assert src.sample_rows(twice, 100).count() == 100


def test_folds_with_bounds_outside_the_calendar(spark, calls):
    d = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=i)
    rows = [(1, d(-5), d(10), d(11), d(20)), (2, d(80), d(200), None, None), (3, d(50), d(40), d(300), d(400))]
    folds = spark.createDataFrame(rows, "fold int, train_start date, train_end date, test_start date, test_end date")
    got = sorted((r["ticker"], r["dt"], r["fold"], r["role"]) for r in splits.assign_folds(calls, folds).collect())
    want = []
    for r in calls.collect():
        for f, a, b, c, e in rows:
            want += [(r["ticker"], r["dt"], f, role) for role, lo, hi in (("train", a, b), ("test", c, e)) if lo and lo <= r["dt"] <= hi]
    assert got == sorted(want)
