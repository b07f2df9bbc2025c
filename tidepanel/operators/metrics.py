"""Performance and tail-risk metrics of return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ranks import series_quantiles
from tidepanel.functions.series import DAILY, EPS, TRADING_DAYS, Series, rolling, running, windowed
from tidepanel.operators.returns import ANNUAL

RISK_FREE = 0.04
DAILY_RF = (1.0 + RISK_FREE) ** (1.0 / TRADING_DAYS) - 1.0


def cagr_of(total: Column, n: Column) -> Column:
    years = F.greatest(n / float(TRADING_DAYS), F.lit(1e-6))
    return F.when(total > -1.0, F.pow(total + 1.0, F.lit(1.0) / years) - 1.0).otherwise(-1.0)


def sharpe_of(mean: Column, std: Column, n: Column, rf: float = DAILY_RF) -> Column:
    return F.when((std >= 1e-8) & (n >= 10), (mean - rf) / std * ANNUAL).otherwise(0.0)


def drawdowns(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Add ``growth``, ``peak``, ``drawdown`` and ``below_rows``, the rows since the last peak.

    The peak starts at the first compounded value, so a loss on the first day is no drawdown.
    """
    df = running(df, s, {"growth": ("product", F.col("ret") + 1.0), "_row": ("sum", F.lit(1))})
    df = running(df, s, {"peak": ("max", F.col("growth"))})
    df = df.withColumn("drawdown", F.try_divide(F.col("growth"), F.col("peak")) - 1.0)
    df = running(df, s, {"_at": ("last", F.when(~(F.col("drawdown") < 0), F.col("_row")))})
    return df.withColumn("below_rows", (F.col("_row") - F.coalesce("_at", F.lit(0))).cast("long")).drop("_row", "_at")


@windowed(1)
def _entries(df: DataFrame, s: Series = DAILY) -> DataFrame:
    df = df.withColumn("_was", F.lag("position", 1).over(s.window()))
    moved = F.coalesce(F.col("position") - F.col("_was"), F.lit(0.0)) != 0
    held = F.col("position") != 0
    return df.withColumns(
        {
            "_entry": (moved & held).cast("int"),
            "_open": (held & (F.coalesce("_was", F.lit(0.0)) == 0)).cast("int"),
        }
    ).drop("_was")


def trade_stats(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Entries, win rate, profit factor and mean return per trade.

    Every change into a non-zero position is an entry; a trade's return compounds one maximal
    stretch of non-zero positions.
    """
    keys = list(s.keys)
    df = running(_entries(df, s=s), s, {"_trade": ("sum", F.col("_open"))})
    held = F.col("position") != 0
    per_trade = df.groupBy(*keys, "_trade").agg(
        F.product(F.when(held, F.col("ret") + 1.0)).alias("_g"), F.sum("_entry").alias("_e")
    )
    r = F.col("_g") - 1.0
    out = per_trade.groupBy(*keys).agg(
        F.coalesce(F.sum("_e"), F.lit(0)).cast("long").alias("total_trades"),
        F.count("_g").alias("_n"),
        F.count(F.when(r > 0, 1)).alias("_w"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("_lost"),
        F.count(F.when(r < 0, 1)).alias("_l"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_trade_return"),
    )
    some = F.col("_n") > 0
    return out.select(
        *keys,
        "total_trades",
        F.when(some, F.col("_w") / F.col("_n")).otherwise(0.0).alias("win_rate"),
        F.when(some, _profit_factor()).otherwise(0.0).alias("profit_factor"),
        "avg_trade_return",
    )


def _profit_factor() -> Column:
    """Gains over losses; infinite without a loss."""
    return F.when(F.col("_l") > 0, F.col("_won") / (F.abs("_lost") + EPS)).otherwise(float("inf"))


def daily_stats(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """The same figures with every day of non-zero return as a trade (portfolios)."""
    r = F.col("ret")
    out = df.groupBy(*s.keys).agg(
        F.count(F.when(r != 0, 1)).alias("total_trades"),
        F.count(F.when(r > 0, 1)).alias("_w"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("_lost"),
        F.count(F.when(r < 0, 1)).alias("_l"),
        F.coalesce(F.avg(F.when(r != 0, r)), F.lit(0.0)).alias("avg_trade_return"),
    )
    return out.select(
        *s.keys,
        "total_trades",
        (F.col("_w") / F.greatest(F.col("total_trades"), F.lit(1))).alias("win_rate"),
        _profit_factor().alias("profit_factor"),
        "avg_trade_return",
    )


REPORT_COLUMNS = (
    "total_return",
    "cagr",
    "annualized_volatility",
    "sharpe_ratio",
    "sortino_ratio",
    "max_drawdown",
    "max_drawdown_duration_days",
    "calmar_ratio",
    "win_rate",
    "profit_factor",
    "total_trades",
    "avg_trade_return",
)


def return_metrics(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Return, risk and drawdown figures per key of ``ret``; zeros below two rows."""
    keys = list(s.keys)
    known = drawdowns(df.filter(F.col("ret").isNotNull()), s)
    excess = F.col("ret") - DAILY_RF
    agg = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(s.order).alias("start_date"),
        F.max(s.order).alias("end_date"),
        (F.product(F.col("ret") + 1.0) - 1.0).alias("_total"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_std"),
        F.count(F.when(excess < 0, 1)).alias("_nd"),
        F.stddev_samp(F.when(excess < 0, excess)).alias("_dstd"),
        F.min("drawdown").alias("_dd"),
        F.max("below_rows").alias("_dur"),
    )
    agg = agg.withColumn("_cagr", cagr_of(F.col("_total"), F.col("_n")))
    sortino = F.when(
        (F.col("_nd") > 1) & (F.col("_dstd") >= 1e-8), (F.col("_mean") - DAILY_RF) / F.col("_dstd") * ANNUAL
    ).otherwise(0.0)
    enough = F.col("_n") >= 2

    def kept(c: Column, name: str) -> Column:
        return F.when(enough, c).otherwise(0.0).alias(name)

    return agg.select(
        *keys,
        F.when(enough, F.col("start_date")).alias("start_date"),
        F.when(enough, F.col("end_date")).alias("end_date"),
        kept(F.col("_total"), "total_return"),
        kept(F.col("_cagr"), "cagr"),
        kept(F.col("_std") * ANNUAL, "annualized_volatility"),
        kept(sharpe_of(F.col("_mean"), F.col("_std"), F.col("_n")), "sharpe_ratio"),
        kept(sortino, "sortino_ratio"),
        kept(F.col("_dd"), "max_drawdown"),
        F.when(enough, F.col("_dur")).otherwise(0).cast("long").alias("max_drawdown_duration_days"),
        kept(F.col("_cagr") / (F.abs("_dd") + EPS), "calmar_ratio"),
        F.col("_n").alias("n_rows"),
    )


def performance_report(df: DataFrame, s: Series = DAILY, positions: bool = True) -> DataFrame:
    """All figures, one row per key; without positions, days count as trades."""
    keys = list(s.keys)
    counted = trade_stats(df, s) if positions else daily_stats(df, s)
    joined = return_metrics(df, s).join(counted, keys, "left")
    fixed = {c: F.when(F.col("n_rows") >= 2, F.col(c)).otherwise(0) for c in ("win_rate", "profit_factor", "total_trades", "avg_trade_return")}
    return joined.withColumns(fixed).drop("n_rows")


def historical_var_cvar(df: DataFrame, alpha: float = 0.95, s: Series = DAILY) -> DataFrame:
    """Quantile of returns and their mean at or below it; 0 for a series that does not vary."""
    keys = list(s.keys)
    cut = series_quantiles(df, s, "ret", {"var_value": 1.0 - alpha})
    tail = df.join(cut, keys).groupBy(*keys).agg(
        F.first("var_value").alias("var_value"),
        F.stddev_samp("ret").alias("_s"),
        F.avg(F.when(F.col("ret") <= F.col("var_value"), F.col("ret"))).alias("cvar_value"),
    )
    flat = F.coalesce(F.col("_s") < 1e-10, F.lit(True))
    return tail.withColumn("cvar_value", F.when(flat, 0.0).otherwise(F.col("cvar_value"))).drop("_s")


@windowed(5)
def _five_sum(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return rolling(df, s, {"_five": ("sum", "ret", 5, 5)})


def tail_stats(df: DataFrame, alpha: float = 0.95, s: Series = DAILY) -> DataFrame:
    """VaR, expected shortfall, worst day and five days, tail ratio, adjusted skewness and kurtosis."""
    keys = list(s.keys)
    rows = _five_sum(df.filter(F.col("ret").isNotNull()), s=s)
    cuts = series_quantiles(rows, s, "ret", {"_lo": 1.0 - alpha, "_hi": 0.95})
    agg = rows.join(cuts, keys).groupBy(*keys).agg(
        F.first("_lo").alias("var_5pct"),
        F.avg(F.when(F.col("ret") <= F.col("_lo"), F.col("ret"))).alias("cvar_5pct"),
        F.avg(F.when(F.col("ret") >= F.col("_hi"), F.col("ret"))).alias("_up"),
        F.min("ret").alias("worst_day"),
        F.coalesce(F.min("_five"), F.lit(0.0)).alias("worst_5d"),
        F.count("ret").cast("double").alias("_n"),
        F.skewness("ret").alias("_g1"),
        F.kurtosis("ret").alias("_g2"),
    )
    n, low = F.col("_n"), F.abs("cvar_5pct")
    return agg.select(
        *keys,
        "var_5pct",
        "cvar_5pct",
        "worst_day",
        "worst_5d",
        F.when(low > 1e-10, F.col("_up") / low).otherwise(0.0).alias("tail_ratio"),
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6.0)).alias("kurtosis"),
    )


# The headline metrics of a comparison, higher is better for each
HEADLINE = ("sharpe_ratio", "max_drawdown", "cvar_5pct", "cagr")


def allocation_comparison(reports: DataFrame, first: str, second: str, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Differences of the headline metrics of two methods, a score of four and the verdict.

    reports: one row per (keys, method) with the headline columns.
    """
    sides = reports.groupBy(*keys).agg(
        *[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"_{i}_{c}") for i, m in enumerate((first, second)) for c in HEADLINE]
    )
    delta = {f"delta_{c}": F.col(f"_0_{c}") - F.col(f"_1_{c}") for c in HEADLINE}
    out = sides.withColumns(delta)
    score = sum(((F.col(d) > 0).cast("int") for d in delta), F.lit(0))
    out = out.withColumn("score", score)
    verdict = F.when(F.col("score") >= 3, first).when(F.col("score") <= 1, second).otherwise("mixed")
    return out.withColumn("verdict", verdict).select(*keys, *delta, "score", "verdict")


@windowed(1)
def _plain_return(df: DataFrame, s: Series = DAILY) -> DataFrame:
    return df.withColumn("_r", F.try_divide(F.col("close"), F.lag("close", 1).over(s.window())) - 1.0)


def series_summary(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Start, end, bars, total return, volatility and plain Sharpe per series."""
    agg = _plain_return(df, s=s).groupBy(*s.keys).agg(
        F.min(s.order).alias("start_date"),
        F.max(s.order).alias("end_date"),
        F.count(F.lit(1)).alias("bars"),
        (F.try_divide(F.max_by("close", s.order), F.min_by("close", s.order)) - 1.0).alias("total_return"),
        F.avg("_r").alias("_m"),
        F.stddev_samp("_r").alias("_s"),
    )
    return agg.withColumns(
        {"ann_vol": F.col("_s") * ANNUAL, "sharpe": F.col("_m") / (F.col("_s") + EPS) * ANNUAL}
    ).drop("_m", "_s")
