"""Returns, equity and trades from positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.joins import with_totals
from tidepanel.functions.series import DAILY, EPS, Series, running, windowed
from tidepanel.operators.costs import CAPITAL, adv_cap, impact_cost, liquidity_profile

FLAT_RATE = 0.001


@windowed(1)
def asset_returns(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Add ``asset_ret``: simple return per bar, 0 on the first."""
    ret = F.try_divide(F.col("close"), F.lag("close", 1).over(s.window())) - 1.0
    return df.withColumn("asset_ret", F.coalesce(ret, F.lit(0.0)))


@windowed(1)
def positions_from_signals(
    df: DataFrame, signal: str = "signal", out: str = "position", s: Series = DAILY
) -> DataFrame:
    """The signal of a bar is held on the next one; unknown signals are flat, sizes within 1."""
    bounded = F.least(F.greatest(F.coalesce(F.col(signal).cast("double"), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    df = df.withColumn("_sig", bounded)
    return df.withColumn(out, F.coalesce(F.lag("_sig", 1).over(s.window()), F.lit(0.0))).drop("_sig")


@windowed(1)
def position_change(df: DataFrame, s: Series = DAILY) -> DataFrame:
    change = F.col("position") - F.lag("position", 1).over(s.window())
    return df.withColumn("pos_change", F.coalesce(change, F.lit(0.0)))


def net_returns_flat(df: DataFrame, rate: float | Column = FLAT_RATE, s: Series = DAILY) -> DataFrame:
    """Position times asset return less a flat rate on changes; adds ``ret``."""
    df = position_change(df, s=s)
    return df.withColumn("ret", F.col("position") * F.col("asset_ret") - F.abs("pos_change") * rate)


def net_returns_impact(
    df: DataFrame, rate: float | Column = FLAT_RATE, capital: float = CAPITAL, s: Series = DAILY
) -> DataFrame:
    """Capped positions, estimated execution cost and half the flat rate as commission.

    Takes lagged positions in ``position``.
    """
    df = liquidity_profile(df.withColumnRenamed("position", "target"), s=s)
    df = impact_cost(adv_cap(df, capital=capital, s=s), capital)
    df = position_change(df, s=s)
    gross = F.col("position") * F.col("asset_ret")
    return df.withColumn("ret", gross - F.col("exec_cost") - F.abs("pos_change") * rate / 2.0)


def equity_curve(df: DataFrame, capital: float = CAPITAL, s: Series = DAILY) -> DataFrame:
    out = running(df, s, {"_growth": ("product", F.col("ret") + 1.0)})
    return out.withColumn("equity", F.col("_growth") * capital).drop("_growth")


@windowed(1, 1)
def _trade_edges(df: DataFrame, s: Series = DAILY) -> DataFrame:
    w = s.window()
    df = df.withColumns(
        {
            "_before": F.coalesce(F.lag("position", 1).over(w), F.lit(0.0)),
            "_next_dt": F.lead(s.order, 1).over(w),
            "_next_close": F.lead("close", 1).over(w),
        }
    )
    return df.withColumn("_start", ((F.col("position") != F.col("_before")) & (F.col("position") != 0)).cast("int"))


def trades(df: DataFrame, rate: float = FLAT_RATE, capital: float = CAPITAL, s: Series = DAILY) -> DataFrame:
    """One row per stretch of equal non-zero position; a resize closes and reopens.

    Entry at the close of the first bar, exit at the close of the bar after the last one.
    """
    df = _trade_edges(df, s=s)
    df = running(df, s, {"trade_id": ("sum", F.col("_start"))}).filter(F.col("position") != 0)
    rows = df.groupBy(*s.keys, F.col("trade_id").cast("long").alias("trade_id")).agg(
        F.min(s.order).alias("entry_dt"),
        F.min_by("close", s.order).alias("entry_price"),
        F.first("position").alias("direction"),
        F.max_by(F.coalesce("_next_dt", s.order), s.order).alias("exit_dt"),
        F.max_by(F.coalesce("_next_close", "close"), s.order).alias("exit_price"),
    )
    net = F.col("direction") * (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1.0) - 2.0 * rate
    rows = rows.withColumns({"shares": F.lit(capital) / (F.col("entry_price") + EPS), "return_pct": net})
    notional = F.col("shares") * F.col("entry_price")
    return rows.withColumns({"pnl": notional * F.col("return_pct"), "cost": notional * (2.0 * rate)})


def benchmark_buy_hold(df: DataFrame, rate: float = FLAT_RATE, s: Series = DAILY) -> DataFrame:
    held = positions_from_signals(df.withColumn("signal", F.lit(1.0)), s=s)
    return net_returns_flat(held, rate, s=s)


def portfolio_returns(
    df: DataFrame,
    keys: tuple[str, ...] = (),
    missing: str = "drop",
    order: str = "dt",
    universe: DataFrame | None = None,
) -> DataFrame:
    """Sum of returns over the series of each date: (keys..., dt, ret).

    missing: "drop" keeps only dates on which every series has a row, "zero" keeps all.
    universe: a table with the same (keys, ticker), if one is cheaper to read than df.
    """
    sums = df.groupBy(*keys, order).agg(F.sum("ret").alias("ret"), F.count("ret").alias("_here"))
    if missing == "zero":
        return sums.drop("_here")
    names = (df if universe is None else universe).select(*keys, "ticker").distinct()
    if keys:
        sizes = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        joined = sums.join(sizes, list(keys))
    else:
        joined = with_totals(sums, names.agg(F.count(F.lit(1)).alias("_n")))
    return joined.filter(F.col("_here") == F.col("_n")).drop("_here", "_n")


def equity_snapshot(df: DataFrame, keys: tuple[str, ...] = ("ticker",), order: str = "dt") -> DataFrame:
    """Last equity of each quarter and the return since the first bar."""
    quarter = df.groupBy(*keys, F.date_trunc("quarter", order).cast("date").alias("quarter")).agg(
        F.max_by("equity", order).alias("equity"), F.max(order).alias("last_dt")
    )
    first = df.groupBy(*keys).agg(F.min_by("equity", order).alias("_first"))
    return quarter.join(first, list(keys)).withColumn("cum_return", F.try_divide(F.col("equity"), F.col("_first")) - 1.0).drop("_first")


def cost_levels(df: DataFrame, rates: dict[str, float], out: str = "cost_level") -> DataFrame:
    """Repeat rows once per named rate, with the rate in ``cost_rate``."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rates.items()])
    exploded = df.withColumn("_level", F.explode(table))
    return exploded.withColumns({out: F.col("_level.k"), "cost_rate": F.col("_level.v")}).drop("_level")


def relative_to_benchmark(reports: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """CAGR above the benchmark and its ratio to the strategy's volatility.

    benchmark: one row per key in ``keys`` (a single row without keys) with its ``cagr``.
    """
    base = benchmark.select(*keys, F.col("cagr").alias("_base"))
    if keys:
        joined = reports.join(base, list(keys))
    else:
        joined = with_totals(reports, base)
    joined = joined.withColumn("alpha_ann", F.col("cagr") - F.col("_base")).drop("_base")
    vol = F.col("annualized_volatility")
    return joined.withColumn("info_ratio", F.when(vol > 1e-8, F.col("alpha_ann") / vol).otherwise(0.0))
