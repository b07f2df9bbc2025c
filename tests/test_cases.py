"""Hand-computed cases and invariants of signals, positions, costs and metrics."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import closes, ordered, walk
from pyspark.sql import functions as F

from tidepanel.functions.series import Series
from tidepanel.operators import allocate, assemble, clean, costs, cvar, ic, meta, metrics, models, pnl, quality, risk, signals, splits


def test_signal_is_held_one_bar_later(spark):
    b = pnl.asset_returns(closes(spark, [100, 105, 110, 108, 112, 109]))
    day = F.dense_rank().over(Series().window())
    b = b.withColumn("signal", F.when(day <= 3, 1.0).otherwise(0.0))
    out = ordered(pnl.net_returns_flat(pnl.positions_from_signals(b), 0.0), "position", "ret", "asset_ret")
    assert list(out["position"]) == [0, 1, 1, 1, 0, 0]
    assert out["ret"][0] == 0 and abs(out["ret"][1] - 0.05) < 1e-12


def test_two_trades(spark):
    b = pnl.asset_returns(closes(spark, np.linspace(100, 130, 30)))
    day = F.dense_rank().over(Series().window())
    b = b.withColumn("signal", F.when(day.between(3, 7) | day.between(15, 19), 1.0).otherwise(0.0))
    held = pnl.positions_from_signals(b)
    assert pnl.trades(held).count() == 2
    stats = metrics.trade_stats(pnl.net_returns_flat(held)).first()
    assert stats.total_trades == 2 and stats.win_rate == 1.0 and stats.profit_factor == float("inf")


def test_total_loss_and_short_series(spark):
    days = pd.bdate_range("2020-01-01", periods=3).date
    lossy = spark.createDataFrame([("L", d, -0.5) for d in days] + [("S", days[0], 0.1)], "ticker string, dt date, ret double")
    out = {r.ticker: r for r in metrics.performance_report(lossy, positions=False).collect()}
    assert out["L"].cagr == -1.0 and out["L"].sharpe_ratio == 0.0
    # the first value is the first peak
    assert abs(out["L"].max_drawdown + 0.75) < 1e-12 and out["L"].max_drawdown_duration_days == 2
    assert out["S"].total_return == 0.0 and out["S"].start_date is None


def test_constant_price_earns_nothing(spark):
    b = pnl.benchmark_buy_hold(pnl.asset_returns(closes(spark, [100] * 20)), 0.0)
    r = metrics.performance_report(b).first()
    assert r.total_return == 0 and r.sharpe_ratio == 0 and r.max_drawdown == 0


def test_cleaner(spark):
    f = walk(("OK", "BAD"), 100)
    f.loc[(f["ticker"] == "BAD") & (f.index % 5 == 0), "open"] = None
    ok = f["ticker"] == "OK"
    rows = f[ok].index
    f.loc[rows[3], ["high", "low"]] = f.loc[rows[3], ["low", "high"]].values
    f.loc[rows[7], "close"] = -1.0
    f.loc[rows[9], "volume"] = -500.0
    f.loc[rows[11], "close"] = None
    f.loc[rows[80], "close"] *= 3
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), "ticker string, dt date, open double, high double, low double, close double, volume double")
    out = ordered(clean.clean(df), "ticker", "dt", "high", "low", "close", "volume", "is_outlier")
    assert set(out["ticker"]) == {"OK"} and len(out) == 99
    assert (out["high"] >= out["low"]).all() and (out["volume"] >= 0).all() and out["close"].notna().all()
    assert out[out["dt"] == f.loc[rows[80], "dt"]]["is_outlier"].all()


@pytest.mark.parametrize("s", [Series(), Series(block=40, slot=30)], ids=["whole", "blocks"])
def test_volume_cap_equals_loop(spark, s):
    rng = np.random.default_rng(5)
    n = 160
    f = pd.DataFrame({"ticker": "C", "dt": pd.bdate_range("2020-01-01", periods=n).date, "target": rng.choice([-1.0, -0.4, 0.0, 0.3, 1.0], n), "adv": rng.uniform(1e5, 4e6, n)})
    out = ordered(costs.adv_cap(spark.createDataFrame(f, "ticker string, dt date, target double, adv double"), s=s), "position", "capped")
    want, hits = [], 0
    for i in range(n):
        change = f["target"][i] - f["target"][i - 1] if i else 0.0
        limit = 0.05 * f["adv"][i]
        if abs(change) * 1e5 > limit:
            hits += 1
            want.append(want[-1] + change * limit / (abs(change) * 1e5))
        else:
            want.append(f["target"][i])
    assert hits > 20 and out["capped"].sum() == hits
    np.testing.assert_allclose(out["position"], want, atol=1e-12)


def test_cost_only_on_trades(spark, bars):
    held = pnl.positions_from_signals(signals.momentum_signal(bars), out="target")
    out = costs.impact_cost(costs.adv_cap(costs.liquidity_profile(held)))
    assert out.filter(~F.col("traded") & (F.col("exec_cost") != 0)).count() == 0
    assert out.filter(F.col("traded") & (F.col("exec_cost") <= 0)).count() == 0


def test_momentum_goes_flat_before_it_turns(bars):
    out = ordered(signals.momentum_signal(bars), "ticker", "signal")
    for _, g in out.groupby("ticker"):
        assert (np.abs(np.diff(g["signal"])) <= 1).all()


def test_gate_and_high_volatility_are_flat(spark):
    days = pd.bdate_range("2020-01-01", periods=4).date
    rows = [("A", d, 0.9, r, g, 0.15, -0.01) for d, r, g in zip(days, (0, 1, 2, 2), (1, 1, 1, 0))]
    df = spark.createDataFrame(rows, "ticker string, dt date, proba_M double, market_regime int, meta_pred int, realized_vol_20d double, log_ret_1d double")
    out = ordered(signals.ml_signal(df, "M"), "signal")["signal"]
    np.testing.assert_allclose(out, [0.4, 0, 0.4, 0], atol=1e-6)


def test_risk_rules_keep_the_bound(bars):
    df = pnl.asset_returns(bars).withColumn("log_ret_1d", F.log1p("asset_ret")).withColumn("signal", F.lit(1.0))
    out = ordered(risk.apply_risk(df), "position")["position"]
    assert out.between(-1, 1).all() and (out < 1).any()


def test_gap_between_train_and_test(spark):
    days = pd.bdate_range("2018-01-01", "2023-12-29").date
    df = spark.createDataFrame([("A", d) for d in days], "ticker string, dt date")
    folds = splits.calendar_walk_forward(df).collect()
    assert len(folds) == 5
    assert all((f.test_start - f.train_end) >= dt.timedelta(days=5) and f.train_size >= 200 for f in folds)
    near = splits.fold_table(splits.index_walk_forward(df, 252, 20, gap_rows=3)).collect()
    assert all(f.train_size == 249 for f in near)


def test_no_lookahead_in_returns(bars):
    from tidepanel.operators.returns import returns_all

    columns = assemble.feature_columns(returns_all(bars.limit(0)))
    assert quality.lookahead_probe(returns_all, bars, "2020-10-01", columns).count() == 0
    ahead = quality.lookahead_probe(assemble.forward_return, bars, "2020-10-01", ["target_fwd_return"])
    assert ahead.count() == 2


def test_feature_columns_hold_no_outputs():
    blocked = ["pred_X", "proba_X", "meta_pred", "target_direction", "obv", "dow_cos"]
    assert quality.leak_columns(["sma_10", *blocked]) == ["pred_X", "proba_X", "meta_pred", "target_direction"]


def test_half_life_rules(spark):
    rows = [("A", "half", 1, 0.4), ("A", "half", 5, 0.3), ("A", "half", 10, 0.1), ("A", "half", 20, 0.0),
            ("A", "slow", 1, 0.4), ("A", "slow", 5, 0.4), ("A", "slow", 10, 0.39), ("A", "slow", 20, -0.3),
            ("A", "none", 1, 0.0), ("A", "none", 5, 0.3), ("A", "none", 10, 0.1), ("A", "none", 20, 0.0)]
    df = spark.createDataFrame(rows, "ticker string, feature string, horizon int, ic double")
    out = {r.feature: r.half_life for r in ic.ic_half_life(df).collect()}
    assert abs(out["half"] - 7.5) < 1e-9 and out["slow"] == float("inf") and out["none"] is None


def test_topk_takes_the_stronger_half(spark):
    d = dt.date(2020, 1, 1)
    rows = [(t, d, p) for t, p in zip("abcdef", (0.5, 0.5, 0.5, 0.9, -1.0, 0.1))]
    df = spark.createDataFrame(rows, "ticker string, dt date, position double")
    out = {r.ticker: r.weight for r in allocate.cross_sectional_topk(df).collect()}
    assert out == {"a": 0.5, "d": 0.5, "b": 0, "c": 0, "e": 0, "f": 0}


# --- tail loss --------------------------------------------------------------------------------


def test_solver_closes_the_gap():
    rng = np.random.default_rng(2)
    r = rng.normal(0.0005, 0.02, (60, 8))
    w, y, value, met = cvar.minimise_tail(r, 0.95, 1.0, 0.4)
    assert met
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= 0.4 + 1e-12
    low = cvar._fill(-(r.T @ y), 1.0, 0.4)
    assert -1e-12 <= value - low <= cvar.TOLERANCE
    for _ in range(300):
        other = cvar._project(rng.dirichlet(np.ones(8)), 1.0, 0.4)
        assert value <= -np.sort(r @ other)[:3].mean() + 1e-9


def test_weights_and_active_sets(spark):
    f = walk(tuple(f"t{i:02d}" for i in range(12)), 120, 9)
    bars = pnl.asset_returns(spark.createDataFrame(f, "ticker string, dt date, open double, high double, low double, close double, volume double"))
    full = cvar.cvar_weights(bars, low=0.01).toPandas()
    sums = full.groupby("m")["w"].sum()
    np.testing.assert_allclose(sums, 1.0, atol=1e-9)
    assert full["w"].min() >= 0.01 - 1e-12 and full["w"].max() <= 0.4 + 1e-9
    windows = {m: g.set_index("ticker")["rets"] for m, g in cvar.return_windows(bars).toPandas().groupby("m")}

    def loss(weights, m):
        g = weights[weights["m"] == m].set_index("ticker")["w"]
        r = sum(np.asarray(windows[m][t]) * w for t, w in g.items())
        return -np.sort(r)[: cvar.tail_size(len(r), 0.95)].mean()

    for m in windows:
        equal = full.assign(w=1 / 12)
        r = np.stack([np.asarray(x, float) for x in windows[m]], axis=1)
        whole = cvar.minimise_tail(r, 0.95, 1.0 - 12 * 0.01, 0.39, r.sum(axis=1) * 0.01)
        assert whole[3] and abs(loss(full, m) - whole[2]) < 1e-5 and loss(full, m) <= loss(equal, m) + 1e-9


def test_unfinished_dates_give_equal_weights(spark, monkeypatch):
    f = walk(tuple(f"t{i:02d}" for i in range(6)), 90, 9)
    bars = pnl.asset_returns(spark.createDataFrame(f, "ticker string, dt date, open double, high double, low double, close double, volume double"))
    solve = cvar.minimise_tail
    monkeypatch.setattr(cvar, "_solve", lambda alpha, total, cap: _unfinished(solve, alpha, total, cap))
    assert {round(r.w, 9) for r in cvar.cvar_weights(bars).collect()} == {round(1 / 6, 9)}


def _unfinished(solve, alpha, total, cap):
    def run(pdf):
        r = np.stack([np.asarray(x, float) for x in pdf["rets"]], axis=1)
        w, y, value, _ = solve(r, alpha, total, min(cap, total) if cap * r.shape[1] >= total else total)
        return pd.DataFrame({"m": pdf["m"], "ticker": pdf["ticker"], "w": w, "y": [y.tolist()] * len(w), "loss": value, "met": False})

    return run


# --- classification ---------------------------------------------------------------------------


def test_auc_is_exact_and_validation_rows_all_count(spark):
    rows = [(1.0, 1.0, 0.5000001), (0.0, 1.0, 0.5000002), (0.0, 1.0, 0.7), (1.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "target_direction double, pred_m double, proba_m double")
    out = meta.classification_report(df, "m").first()
    assert out.auc == 0.0 and out.tp + out.tn + out.fp + out.fn == 3
    out = meta.classification_report(df, "m", scored_only=False).first()
    assert out.auc == 0.0 and out.tp + out.tn + out.fp + out.fn == 4
    many = pd.DataFrame({"target_direction": [1.0, 0.0] * 50, "pred_m": 1.0, "proba_m": [i % 7 / 7 for i in range(100)]})
    out = meta.classification_report(spark.createDataFrame(many), "m", scored_only=False).first()
    pos, neg = (many.loc[many["target_direction"] == k, "proba_m"].to_numpy() for k in (1.0, 0.0))
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert abs(out.auc - want) < 1e-12


def test_folds_saved_at_once_are_all_listed(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 3 > 0)) for i in range(30)], ["x", models.LABEL])
    fitted = models.fit(rows, models.logistic_regression)
    sides = {("L", True): fitted, ("L", False): fitted}
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: models.save_models(spark, str(tmp_path), k, sides, ["f"]), range(6)))
    assert {(r.fold, r.side) for r in models.list_models(spark, str(tmp_path)).collect()} == {(k, b) for k in range(6) for b in ("bull", "bear")}
    assert {r.fold for r in models.latest_models(spark, str(tmp_path)).collect()} == {5}


def test_gaps_are_filled_forward_then_with_zero(spark):
    rows = [("a", f"2024-01-0{i}", None if x is None else float(x), 1.0) for i, x in enumerate([None, 2, None, 4], 1)]
    df = spark.createDataFrame(rows, "ticker string, dt string, f double, target_direction double").withColumn("dt", F.to_date("dt"))
    assert [r.f for r in models._labelled(df, ["f"], models.DAILY).orderBy("dt").collect()] == [0.0, 2.0, 2.0, 4.0]


def test_infeasible_bounds_give_equal_weights(spark):
    f = walk(("a", "b"), 60, 9)
    bars = pnl.asset_returns(spark.createDataFrame(f, "ticker string, dt date, open double, high double, low double, close double, volume double"))
    assert {round(r.w, 9) for r in cvar.cvar_weights(bars).collect()} == {0.5}


# --- models -----------------------------------------------------------------------------------


def test_partner_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 100):
        a, b = models._stride(n, 42)
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))
    df = spark.createDataFrame(walk(("a", "b", "c"), 30)[["ticker", "dt", "close"]], "ticker string, dt date, close double")
    out = models.permuted_partner(df, "close", "other").toPandas()
    np.testing.assert_allclose(sorted(out["close"]), sorted(out["other"]))
    assert (out["close"] != out["other"]).mean() > 0.8


def test_model_without_classes_scores_default(spark, bars):
    rows = models.vectors(bars.withColumn("target_direction", F.lit(1.0)), ["close"])
    assert models.fit(rows, models.logistic_regression) is None
    assert models.score(rows, None, "m").filter("proba_m <> 0.5").count() == 0


def test_save_and_load_latest(spark, bars, tmp_path):
    rows = models.vectors(bars.withColumn("target_direction", (F.col("close") > F.col("open")).cast("double")), ["close", "open"])
    model = models.fit(rows, models.random_forest(2, 2))
    for fold in (9, 10):
        models.save_models(spark, str(tmp_path), fold, {("Forest", True): model, ("Forest", False): None}, ["close", "open"])
    assert models.latest_models(spark, str(tmp_path)).first().fold == 10
    assert models.load_model(spark, str(tmp_path), "Forest").transform(rows).count() == bars.count()
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path), "Forest", "bear")


def test_zero_price_is_unknown_not_an_error(spark):
    from tidepanel.operators.regime import regime_features
    from tidepanel.operators.returns import log_returns

    df = closes(spark, [100, 0, 101, 102, 103])
    out = ordered(pnl.asset_returns(regime_features(log_returns(df, (1,)))), "asset_ret", "log_ret_1d")
    assert out["asset_ret"][2] == 0.0 and pd.isna(out["log_ret_1d"][2])
