"""Market regime labels.  A comparison with an unknown value gives 0, never NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, Series, rolling, windowed
from tidepanel.operators.returns import ANNUAL, _need_log_ret

RANGING, HIGH_VOL, TREND_UP, TREND_DOWN = 0, 1, 2, 3
LONG_WINDOW, LONG_LEAST = 252, 63


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


@windowed(lambda p: p["vol_window"] + 1)
def regime_volatility(df: DataFrame, vol_window: int = 21, s: Series = DAILY) -> DataFrame:
    out = rolling(_need_log_ret(df, s), s, {"regime_volatility": ("std", "log_ret_1d", vol_window, vol_window)})
    return out.withColumn("regime_volatility", F.col("regime_volatility") * ANNUAL)


def regime_label() -> Column:
    return (
        F.when(F.col("regime_is_high_vol") == 1, HIGH_VOL)
        .when(F.col("regime_is_trending_down") == 1, TREND_DOWN)
        .when(F.col("regime_is_trending_up") == 1, TREND_UP)
        .otherwise(RANGING)
    )


@windowed(lambda p: p["vol_window"] + LONG_WINDOW + p["trend_window"])
def regime_features(df: DataFrame, vol_window: int = 21, trend_window: int = 50, s: Series = DAILY) -> DataFrame:
    """Volatility, trend and drawdown flags and the combined ``market_regime``."""
    df = rolling(
        _need_log_ret(df, s),
        s,
        {
            "regime_volatility": ("std", "log_ret_1d", vol_window, vol_window),
            "_trend": ("mean", "close", trend_window, trend_window),
            "_peak": ("max", "close", LONG_WINDOW, LONG_LEAST),
        },
    )
    df = df.withColumn("regime_volatility", F.col("regime_volatility") * ANNUAL)
    df = df.withColumn("_before", F.lag("_trend", 5).over(s.window()))
    df = rolling(df, s, {"_mean": ("mean", "regime_volatility", LONG_WINDOW, LONG_LEAST)})
    vol, mean, trend, before = (F.col(c) for c in ("regime_volatility", "_mean", "_trend", "_before"))
    df = df.withColumns(
        {
            "regime_is_high_vol": flag(vol > mean * 1.2),
            "regime_is_low_vol": flag(vol <= mean),
            "regime_trend_bullish": flag(F.col("close") > trend),
            "regime_trend_bearish": flag(F.col("close") <= trend),
            "regime_trend_slope": F.try_divide(trend - before, before),
            "regime_drawdown": F.try_divide(F.col("close"), F.col("_peak")) - 1.0,
        }
    ).drop("_mean", "_trend", "_before", "_peak")
    df = df.withColumns(
        {
            "regime_is_trending_up": flag(F.col("regime_trend_slope") > 0.01),
            "regime_is_trending_down": flag(F.col("regime_trend_slope") < -0.01),
        }
    )
    return df.withColumn("market_regime", regime_label())


def regime_histogram(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return df.groupBy(*s.keys, "market_regime").agg(F.count(F.lit(1)).alias("n"))
