"""Returns, volatility and volume features; every one looks back only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import (
    DAILY,
    EPS,
    TRADING_DAYS,
    Series,
    decay_rows,
    decayed_sums,
    rolling,
    running,
    span_decay,
    windowed,
)

ANNUAL = math.sqrt(TRADING_DAYS)

LOG_PERIODS = (1, 5, 21)
LAGS = (1, 2, 3, 5)
RETURN_WINDOWS = (5, 10, 21, 63)
VOL_WINDOWS = (5, 10, 20, 63)
VOL_ADJ_WINDOWS = (5, 10, 20)
ZSCORE_WINDOWS = (20, 60)
VOLUME_WINDOW, OBV_WINDOW = 20, 63


def log_ret(n: int, s: Series, price: str = "close") -> Column:
    # try_divide: a zero price gives NULL instead of failing the job
    return F.ln(F.try_divide(F.col(price), F.lag(price, n).over(s.window())))


def simple_ret(n: int, s: Series, price: str = "close") -> Column:
    return F.try_divide(F.col(price), F.lag(price, n).over(s.window())) - 1.0


def _need_log_ret(df: DataFrame, s: Series) -> DataFrame:
    return df if "log_ret_1d" in df.columns else df.withColumn("log_ret_1d", log_ret(1, s))


@windowed(lambda p: max(p["periods"]))
def log_returns(df: DataFrame, periods=LOG_PERIODS, s: Series = DAILY) -> DataFrame:
    return df.withColumns({f"log_ret_{n}d": log_ret(n, s) for n in periods})


@windowed(lambda p: max(p["lags"]) + 1)
def lagged_returns(df: DataFrame, lags=LAGS, s: Series = DAILY) -> DataFrame:
    df = _need_log_ret(df, s)
    return df.withColumns({f"log_ret_1d_lag_{k}": F.lag("log_ret_1d", k).over(s.window()) for k in lags})


@windowed(lambda p: max(p["windows"]))
def rolling_returns(df: DataFrame, windows=RETURN_WINDOWS, s: Series = DAILY) -> DataFrame:
    return df.withColumns({f"rolling_ret_{w}d": simple_ret(w, s) for w in windows})


@windowed(lambda p: max(p["windows"]) + 1)
def realized_vol(df: DataFrame, windows=VOL_WINDOWS, s: Series = DAILY) -> DataFrame:
    out = rolling(_need_log_ret(df, s), s, {f"realized_vol_{w}d": ("std", "log_ret_1d", w, w) for w in windows})
    return out.withColumns({f"realized_vol_{w}d": F.col(f"realized_vol_{w}d") * ANNUAL for w in windows})


@windowed(lambda p: decay_rows(span_decay(p["span"])) + 1)
def ewm_vol(df: DataFrame, span: int = 21, s: Series = DAILY) -> DataFrame:
    """Bias-corrected exponentially weighted deviation (weights normalised over the history)."""
    return _ewm_vol(_need_log_ret(df, s), span, s)


def _ewm_vol(df: DataFrame, span: int, s: Series) -> DataFrame:
    q = span_decay(span)
    df = df.withColumns(
        {"_cnt": F.count("log_ret_1d").over(s.upto()), "_sq": F.col("log_ret_1d") * F.col("log_ret_1d")}
    )
    df = decayed_sums(df, s, {"_wx": ("log_ret_1d", q), "_wxx": ("_sq", q)})
    n = F.col("_cnt").cast("double")
    w = (1.0 - F.pow(F.lit(q), n)) / (1.0 - q)
    ww = (1.0 - F.pow(F.lit(q * q), n)) / (1.0 - q * q)
    mean = F.col("_wx") / w
    var = F.greatest(F.col("_wxx") / w - mean * mean, F.lit(0.0)) * w * w / (w * w - ww)
    return df.withColumn("ewm_vol", F.when(n >= span, F.sqrt(var) * ANNUAL)).drop("_cnt", "_sq", "_wx", "_wxx")


def vol_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_ratio_5_20", F.col("realized_vol_5d") / (F.col("realized_vol_20d") + EPS))


def _stat_specs(windows, metrics=("mean", "std", "skew")) -> dict:
    return {f"ret_{m}_{w}d": (m, "log_ret_1d", w, w) for w in windows for m in metrics}


@windowed(lambda p: max(p["windows"]) + 1)
def rolling_stats(
    df: DataFrame, windows=VOL_WINDOWS, metrics=("mean", "std", "skew"), s: Series = DAILY
) -> DataFrame:
    return rolling(_need_log_ret(df, s), s, _stat_specs(windows, metrics))


@windowed(1)
def volume_change_pct(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Relative change of volume; NULL after a bar without volume."""
    before = F.lag("volume", 1).over(s.window())
    return df.withColumn("_pv", before).withColumn(
        "volume_change_pct", F.when(F.col("_pv") != 0, F.col("volume") / F.col("_pv") - 1.0)
    ).drop("_pv")


@windowed(lambda p: p["window"])
def relative_volume(df: DataFrame, window: int = 20, least: int = 10, s: Series = DAILY) -> DataFrame:
    out = rolling(df, s, {"_mv": ("mean", "volume", window, least)})
    return out.withColumn("relative_volume", F.col("volume") / (F.col("_mv") + EPS)).drop("_mv")


@windowed(1)
def _signed_volume(df: DataFrame, s: Series = DAILY) -> DataFrame:
    change = F.col("close") - F.lag("close", 1).over(s.window())
    return df.withColumn("_sv", F.signum(change) * F.col("volume"))


def obv(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Cumulative volume signed by the price change; NULL on the first row."""
    out = running(_signed_volume(df, s=s), s, {"_obv": ("sum", F.col("_sv"))})
    return out.withColumn("obv", F.when(F.col("_sv").isNotNull(), F.col("_obv"))).drop("_sv", "_obv")


@windowed(lambda p: p["window"])
def obv_zscore(df: DataFrame, window: int = 63, least: int = 21, s: Series = DAILY) -> DataFrame:
    out = rolling(df, s, {"_mo": ("mean", "obv", window, least), "_so": ("std", "obv", window, least)})
    z = (F.col("obv") - F.col("_mo")) / (F.col("_so") + EPS)
    return out.withColumn("obv_zscore", z).drop("_mo", "_so")


@windowed(lambda p: max(p["windows"]) + 1)
def vol_adj_returns(df: DataFrame, windows=VOL_ADJ_WINDOWS, s: Series = DAILY) -> DataFrame:
    out = rolling(_need_log_ret(df, s), s, {f"_sd_{w}": ("std", "log_ret_1d", w, w) for w in windows})
    out = out.withColumns({f"vol_adj_ret_{w}d": F.col("log_ret_1d") / (F.col(f"_sd_{w}") + EPS) for w in windows})
    return out.drop(*[f"_sd_{w}" for w in windows])


@windowed(lambda p: max(p["windows"]) + 1)
def return_zscore(df: DataFrame, windows=ZSCORE_WINDOWS, s: Series = DAILY) -> DataFrame:
    out = rolling(
        _need_log_ret(df, s),
        s,
        {f"_{m}_{w}": (m, "log_ret_1d", w, w) for w in windows for m in ("mean", "std")},
    )
    out = out.withColumns(
        {f"ret_zscore_{w}d": (F.col("log_ret_1d") - F.col(f"_mean_{w}")) / (F.col(f"_std_{w}") + EPS) for w in windows}
    )
    return out.drop(*[f"_{m}_{w}" for w in windows for m in ("mean", "std")])


def _returns_back(p) -> int:
    frames = (*p["periods"], *p["lags"], *p["windows"], *p["vols"], *p["stats"], *VOL_ADJ_WINDOWS, *ZSCORE_WINDOWS, VOLUME_WINDOW, OBV_WINDOW)
    return max(*frames, decay_rows(span_decay(p["span"]))) + 1


@windowed(_returns_back)
def _bounded_returns(
    df: DataFrame, periods, lags, windows, vols, span: int, stats, s: Series = DAILY
) -> DataFrame:
    w = s.window()
    df = df.withColumns({f"log_ret_{n}d": log_ret(n, s) for n in {*periods, 1}})
    df = df.withColumns(
        {f"log_ret_1d_lag_{k}": F.lag("log_ret_1d", k).over(w) for k in lags}
        | {f"rolling_ret_{n}d": simple_ret(n, s) for n in windows}
        | {"_pv": F.lag("volume", 1).over(w)}
    )
    stds = {*vols, *VOL_ADJ_WINDOWS, *ZSCORE_WINDOWS}
    df = rolling(
        df,
        s,
        {f"_sd_{n}": ("std", "log_ret_1d", n, n) for n in stds}
        | {f"_me_{n}": ("mean", "log_ret_1d", n, n) for n in {*ZSCORE_WINDOWS, *stats}}
        | {f"ret_skew_{n}d": ("skew", "log_ret_1d", n, n) for n in stats}
        | {"_mv": ("mean", "volume", VOLUME_WINDOW, 10)}
        | {"_mo": ("mean", "obv", OBV_WINDOW, 21), "_so": ("std", "obv", OBV_WINDOW, 21)},
    )
    one = F.col("log_ret_1d")
    df = df.withColumns(
        {f"realized_vol_{n}d": F.col(f"_sd_{n}") * ANNUAL for n in vols}
        | {f"ret_mean_{n}d": F.col(f"_me_{n}") for n in stats}
        | {f"ret_std_{n}d": F.col(f"_sd_{n}") for n in stats}
        | {f"vol_adj_ret_{n}d": one / (F.col(f"_sd_{n}") + EPS) for n in VOL_ADJ_WINDOWS}
        | {f"ret_zscore_{n}d": (one - F.col(f"_me_{n}")) / (F.col(f"_sd_{n}") + EPS) for n in ZSCORE_WINDOWS}
        | {
            "vol_ratio_5_20": F.col("_sd_5") * ANNUAL / (F.col("_sd_20") * ANNUAL + EPS),
            "volume_change_pct": F.when(F.col("_pv") != 0, F.col("volume") / F.col("_pv") - 1.0),
            "relative_volume": F.col("volume") / (F.col("_mv") + EPS),
            "obv_zscore": (F.col("obv") - F.col("_mo")) / (F.col("_so") + EPS),
        }
    )
    df = df.drop(*[c for c in df.columns if c.startswith(("_sd_", "_me_"))], "_mv", "_mo", "_so", "_pv")
    return _ewm_vol(df, span, s)


def returns_all(
    df: DataFrame,
    periods=LOG_PERIODS,
    lags=LAGS,
    windows=RETURN_WINDOWS,
    vols=VOL_WINDOWS,
    span: int = 21,
    stats=VOL_WINDOWS,
    s: Series = DAILY,
) -> DataFrame:
    """All return, volatility and volume features; frames shared by several are computed once."""
    return _bounded_returns(obv(df, s), periods, lags, windows, vols, span, stats, s=s)
