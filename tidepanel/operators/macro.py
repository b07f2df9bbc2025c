"""Features of market-wide series, computed on their own calendars and aligned to the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import by_date, with_totals
from tidepanel.functions.series import DAILY, EPS, Series, rolling, windowed
from tidepanel.operators.returns import ANNUAL, log_ret

MACRO = Series(keys=("label",))
RETURN_PERIODS = (1, 5, 10)


def macro_names(periods=RETURN_PERIODS, vol_window: int = 20, zscore_window: int = 60) -> list[str]:
    return [*[f"ret_{n}d" for n in periods], f"vol_{vol_window}d", f"zscore_{zscore_window}d", "trend"]


@windowed(lambda p: max(*p["periods"], p["vol_window"] + 1, p["zscore_window"], p["trend_window"]))
def macro_features(
    macro: DataFrame,
    periods=RETURN_PERIODS,
    vol_window: int = 20,
    zscore_window: int = 60,
    trend_window: int = 20,
    s: Series = MACRO,
) -> DataFrame:
    """Log returns, volatility, z-score and trend per label: (label, dt, features...)."""
    df = macro.select(*s.keys, s.order, "close", *[c for c in ("_rn",) if c in macro.columns])
    df = df.withColumns({f"ret_{n}d": log_ret(n, s) for n in periods} | {"_one": log_ret(1, s)})
    df = rolling(
        df,
        s,
        {
            "_vol": ("std", "_one", vol_window, vol_window),
            "_mean": ("mean", "close", zscore_window, zscore_window),
            "_std": ("std", "close", zscore_window, zscore_window),
            "_ma": ("mean", "close", trend_window, trend_window),
        },
    )
    return df.withColumns(
        {
            f"vol_{vol_window}d": F.col("_vol") * ANNUAL,
            f"zscore_{zscore_window}d": (F.col("close") - F.col("_mean")) / (F.col("_std") + EPS),
            "trend": F.col("close") / (F.col("_ma") + EPS) - 1.0,
        }
    ).drop("_one", "_vol", "_mean", "_std", "_ma", "close")


@windowed(lambda p: p["limit"])
def _fill_recent(df: DataFrame, columns: list[str], limit: int, s: Series = MACRO) -> DataFrame:
    recent = s.window().rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(recent) for c in columns})


def align_macro(
    features: DataFrame, calendar: DataFrame, labels: list[str], limit: int = 5, order: str = "dt"
) -> DataFrame:
    """One row per calendar date with columns ``macro_{label}_{feature}``.

    Dates are matched exactly; gaps take the last value of at most ``limit`` calendar rows before.
    Macro dates outside the calendar do not count.
    """
    names = [c for c in features.columns if c not in ("label", order)]
    grid = calendar.select(order).distinct().withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    joined = grid.join(features, ["label", order], "left")
    filled = _fill_recent(joined, names, limit, s=Series(keys=("label",), order=order))
    wide = filled.groupBy(order).pivot("label", labels).agg(*[F.first(c).alias(c) for c in names])
    if len(names) == 1:
        wide = wide.withColumnsRenamed({v: f"{v}_{names[0]}" for v in labels})
    return wide.select(order, *[F.col(f"{v}_{c}").alias(f"macro_{v}_{c}") for v in labels for c in names])


def macro_warmup_range(macro: DataFrame, calendar: DataFrame, days: int = 120, order: str = "dt") -> DataFrame:
    """Macro rows from ``days`` before the first calendar date up to the last."""
    span = calendar.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    inside: Column = (F.col(order) >= F.date_sub(F.col("_lo"), days)) & (F.col(order) <= F.col("_hi"))
    return with_totals(macro, span).filter(inside).drop("_lo", "_hi")


def attach_macro(
    df: DataFrame, bars: DataFrame, macro: DataFrame, labels: list[str], s: Series = DAILY
) -> DataFrame:
    """Join the macro columns, aligned to the calendar of the bars, to a table with their dates."""
    calendar = bars.select(s.order).distinct()
    history = macro_warmup_range(macro, calendar, order=s.order)
    wide = align_macro(macro_features(history, s=Series(keys=("label",), order=s.order)), calendar, labels, order=s.order)
    return by_date(df, wide, s.order)
