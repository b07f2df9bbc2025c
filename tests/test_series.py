"""Windows, exponential sums and scans against pandas and plain loops, in both layouts."""

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, walk
from pyspark.sql import functions as F

from tidepanel.functions.series import Series, rolling, running, state_scan, transition
from tidepanel.operators import indicators, regime, returns, risk

BLOCKS = Series(block=64, slot=50)


def by_ticker(frame, fn):
    return pd.concat([fn(g) for _, g in frame.groupby("ticker", sort=True)]).reset_index(drop=True)


def close_to(a, b, tol=1e-8):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tol, atol=tol)


@pytest.mark.parametrize("kind,rows,least", [("mean", 20, 20), ("std", 63, 63), ("std", 20, 5), ("mean", 252, 63), ("skew", 20, 20), ("max", 200, 63), ("sum", 5, 5)])
def test_rolling_matches_pandas(bars, frame, kind, rows, least):
    out = ordered(rolling(bars, Series(), {"x": (kind, "close", rows, least)}), "x")["x"]
    want = by_ticker(frame, lambda g: getattr(g["close"].rolling(rows, min_periods=least), kind)())
    close_to(out, want, 1e-6 if kind == "skew" else 1e-9)


def test_rolling_counts_gaps(spark):
    f = walk(("G",), 60)
    f.loc[[5, 6, 7, 30], "close"] = None
    df = spark.createDataFrame(f.replace({np.nan: None}), "ticker string, dt date, open double, high double, low double, close double, volume double")
    out = ordered(rolling(df, Series(), {"m": ("mean", "close", 10, 4), "s": ("std", "close", 10, 4), "c": ("mean", "close", 10, 10)}), "m", "s", "c")
    roll = f["close"].rolling(10, min_periods=4)
    close_to(out["m"], roll.mean())
    close_to(out["s"], roll.std())
    close_to(out["c"], f["close"].rolling(10).mean())


@pytest.mark.parametrize("s", [Series(), Series(block=600, slot=50)], ids=["whole", "blocks"])
def test_exponential_indicators(bars, frame, s):
    df = returns.ewm_vol(indicators.atr(indicators.macd(indicators.rsi(indicators.ema(bars, s=s), s=s), s=s), s=s), s=s)
    out = ordered(df, "ema_12", "ema_26", "rsi", "macd_line", "macd_signal", "atr", "ewm_vol")
    c = lambda g: g["close"]
    close_to(out["ema_12"], by_ticker(frame, lambda g: c(g).ewm(span=12, adjust=False, min_periods=12).mean()))
    close_to(out["ema_26"], by_ticker(frame, lambda g: c(g).ewm(span=26, adjust=False, min_periods=26).mean()))

    def rsi(g):
        d = c(g).diff()
        up, down = (x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
        return 100 - 100 / (1 + up / (down + 1e-10))

    close_to(out["rsi"], by_ticker(frame, rsi))
    assert out["rsi"].dropna().between(0, 100).all()

    def line(g):
        return c(g).ewm(span=12, adjust=False, min_periods=12).mean() - c(g).ewm(span=26, adjust=False, min_periods=26).mean()

    close_to(out["macd_line"], by_ticker(frame, line))
    close_to(out["macd_signal"], by_ticker(frame, lambda g: line(g).ewm(span=9, adjust=False, min_periods=9).mean()))
    vol = by_ticker(frame, lambda g: np.log(c(g) / c(g).shift(1)).ewm(span=21, min_periods=21).std() * np.sqrt(252))
    close_to(out["ewm_vol"], vol)


def test_blocks_equal_whole_series(bars):
    for fn in (returns.returns_all, regime.regime_features):
        whole = fn(bars)
        names = [c for c in whole.columns if c not in ("ticker", "dt")]
        a, b = ordered(whole, *names), ordered(fn(bars, s=BLOCKS), *names)
        for c in names:
            close_to(a[c], b[c], 1e-7)


def test_running_in_blocks(bars):
    specs = {"s": ("sum", F.col("volume")), "m": ("max", F.col("close")), "l": ("last", F.when(F.col("close") > 101, F.col("close"))), "p": ("product", F.col("close") / 100)}
    for reverse in (False, True):
        a = ordered(running(bars, Series(), specs, reverse), *specs)
        b = ordered(running(bars, BLOCKS, specs, reverse), *specs)
        for c in specs:
            close_to(a[c], b[c])


def test_rows_are_numbered_without_gaps(bars):
    out = ordered(BLOCKS.numbered(bars), "ticker", "_rn")
    for _, g in out.groupby("ticker"):
        assert list(g["_rn"]) == list(range(len(g)))


@pytest.mark.parametrize("s", [Series(), BLOCKS], ids=["whole", "blocks"])
def test_state_scan_equals_loop(spark, s):
    rng = np.random.default_rng(1)
    n = 500
    maps = rng.integers(-1, 2, (n, 3))
    days = pd.bdate_range("2020-01-01", periods=n).date
    df = spark.createDataFrame([("T", d, *map(int, m)) for d, m in zip(days, maps)], "ticker string, dt date, a int, b int, c int")
    out = ordered(state_scan(df, s, transition(F.col("a"), F.col("b"), F.col("c")), "state"), "state")["state"]
    state, want = 0, []
    for m in maps:
        state = int(m[state + 1])
        want.append(state)
    assert list(out) == want


def test_intraday_series_are_cut_by_default(bars):
    stamped = bars.withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    assert Series().block_rows(bars) == 0
    assert Series().block_rows(stamped) > 0
    a = ordered(indicators.sma(bars, (20,)), "sma_20")["sma_20"]
    close_to(a, ordered(indicators.sma(stamped, (20,)), "sma_20")["sma_20"])


@pytest.mark.parametrize(
    "build",
    [
        lambda df, s: indicators.technical_all(df, windows=(5,), spans=(40, 1), bb=(90, 2.0), s=s),
        lambda df, s: returns.returns_all(df, windows=(150,), span=3, s=s),
        lambda df, s: risk.stop_loss(df.withColumns({"pnl": F.col("close") / 50 - 2, "position": F.lit(1.0)}), rows=30, s=s),
    ],
)
def test_blocks_reach_back_as_far_as_the_arguments_ask(bars, build):
    whole, cut = (build(bars, s) for s in (Series(), BLOCKS))
    names = [c for c, kind in whole.dtypes if kind == "double"]
    a, b = ordered(whole, *names), ordered(cut, *names)
    for c in names:
        close_to(a[c], b[c], 1e-6)


def test_exponential_mean_of_short_spans(bars, frame):
    out = ordered(indicators.ema(bars, spans=(1, 2)), "ema_1", "ema_2")
    for span, c in ((1, "ema_1"), (2, "ema_2")):
        close_to(out[c], by_ticker(frame, lambda g: g["close"].ewm(span=span, adjust=False, min_periods=span).mean()))
