"""Technical indicators; every one looks back only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, EPS, Series, decay_rows, ewm_means, rolling, span_decay, windowed

SMA_WINDOWS = (5, 10, 20, 50, 200)
EMA_SPANS = (12, 26, 50)


def _sma_specs(windows) -> dict:
    return {f"sma_{w}": ("mean", "close", w, w) for w in windows}


def _std_specs(windows) -> dict:
    return {f"_std_{w}": ("std", "close", w, w) for w in windows}


def _zscore(w: int) -> Column:
    return (F.col("close") - F.col(f"sma_{w}")) / (F.col(f"_std_{w}") + EPS)


def _to_sma(w: int) -> Column:
    return F.col("close") / (F.col(f"sma_{w}") + EPS) - 1.0


def _widest(p) -> int:
    return max(p["windows"])


@windowed(_widest)
def sma(df: DataFrame, windows=SMA_WINDOWS, s: Series = DAILY) -> DataFrame:
    return rolling(df, s, _sma_specs(windows))


@windowed(_widest)
def price_zscore(df: DataFrame, windows=SMA_WINDOWS, s: Series = DAILY) -> DataFrame:
    had = [c for c in df.columns if c.startswith("sma_")]
    out = rolling(df, s, _sma_specs(windows) | _std_specs(windows))
    out = out.withColumns({f"zscore_{w}": _zscore(w) for w in windows})
    return out.drop(*[f"_std_{w}" for w in windows], *[f"sma_{w}" for w in windows if f"sma_{w}" not in had])


@windowed(_widest)
def close_to_sma(df: DataFrame, windows=SMA_WINDOWS, s: Series = DAILY) -> DataFrame:
    had = [c for c in df.columns if c.startswith("sma_")]
    out = rolling(df, s, _sma_specs(windows)).withColumns({f"close_to_sma_{w}": _to_sma(w) for w in windows})
    return out.drop(*[f"sma_{w}" for w in windows if f"sma_{w}" not in had])


@windowed(lambda p: max(decay_rows(span_decay(x)) for x in p["spans"]))
def ema(df: DataFrame, spans=EMA_SPANS, s: Series = DAILY) -> DataFrame:
    return ewm_means(df, s, {f"ema_{x}": ("close", span_decay(x), x) for x in spans})


def _moves(df: DataFrame, s: Series) -> DataFrame:
    change = F.col("close") - F.lag("close", 1).over(s.window())
    df = df.withColumn("_d", change)
    # greatest and least skip NULL, so the first row needs the explicit test
    return df.withColumns(
        {
            "_up": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))),
            "_down": F.when(F.col("_d").isNotNull(), -F.least("_d", F.lit(0.0))),
        }
    ).drop("_d")


def _rsi() -> Column:
    return 100.0 - 100.0 / (1.0 + F.col("_gain") / (F.col("_loss") + EPS))


def _rsi_specs(period: int) -> dict:
    q = 1.0 - 1.0 / period
    return {"_gain": ("_up", q, period), "_loss": ("_down", q, period)}


@windowed(lambda p: decay_rows(1.0 - 1.0 / p["period"]) + 1)
def rsi(df: DataFrame, period: int = 14, s: Series = DAILY) -> DataFrame:
    """Relative strength with Wilder's smoothing."""
    out = ewm_means(_moves(df, s), s, _rsi_specs(period))
    return out.withColumn("rsi", _rsi()).drop("_up", "_down", "_gain", "_loss")


def _macd_specs(fast: int, slow: int) -> dict:
    return {"_fast": ("close", span_decay(fast), fast), "_slow": ("close", span_decay(slow), slow)}


def _macd_finish(df: DataFrame, s: Series, signal: int) -> DataFrame:
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm_means(df, s, {"macd_signal": ("macd_line", span_decay(signal), signal)})
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def _macd_back(p) -> int:
    return decay_rows(span_decay(p["slow"])) + decay_rows(span_decay(p["signal"]))


@windowed(_macd_back)
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, s: Series = DAILY) -> DataFrame:
    return _macd_finish(ewm_means(df, s, _macd_specs(fast, slow)), s, signal)


def _bands(window: int, width: float) -> dict[str, Column]:
    mid, spread = F.col("_bb_mid"), F.col("_bb_std") * width
    return {
        "bb_middle": mid,
        "bb_upper": mid + spread,
        "bb_lower": mid - spread,
        "bb_bandwidth": (mid + spread - (mid - spread)) / (mid + EPS),
        "bb_pct_b": (F.col("close") - (mid - spread)) / (mid + spread - (mid - spread) + EPS),
    }


def _band_specs(window: int) -> dict:
    return {"_bb_mid": ("mean", "close", window, window), "_bb_std": ("std", "close", window, window)}


@windowed(lambda p: p["window"])
def bollinger(df: DataFrame, window: int = 20, width: float = 2.0, s: Series = DAILY) -> DataFrame:
    return rolling(df, s, _band_specs(window)).withColumns(_bands(window, width)).drop("_bb_mid", "_bb_std")


def _true_range(df: DataFrame, s: Series) -> DataFrame:
    before = F.lag("close", 1).over(s.window())
    df = df.withColumn("_pc", before)
    ranges = [F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))]
    return df.withColumn("_tr", F.greatest(*ranges)).drop("_pc")


@windowed(lambda p: decay_rows(1.0 - 1.0 / p["period"]) + 1)
def atr(df: DataFrame, period: int = 14, s: Series = DAILY) -> DataFrame:
    out = ewm_means(_true_range(df, s), s, {"atr": ("_tr", 1.0 - 1.0 / period, period)})
    return out.withColumn("atr_pct", F.col("atr") / (F.col("close") + EPS)).drop("_tr")


def _technical_back(p) -> int:
    fast, slow, signal = p["macd_spans"]
    smoothed = [*map(span_decay, p["spans"]), *(1.0 - 1.0 / p[n] for n in ("rsi_period", "atr_period"))]
    macd_rows = max(decay_rows(span_decay(x)) for x in (fast, slow)) + decay_rows(span_decay(signal))
    return max(*p["windows"], p["bb"][0], macd_rows, *map(decay_rows, smoothed)) + 1


@windowed(_technical_back)
def technical_all(
    df: DataFrame,
    windows=SMA_WINDOWS,
    spans=EMA_SPANS,
    rsi_period: int = 14,
    macd_spans: tuple[int, int, int] = (12, 26, 9),
    bb: tuple[int, float] = (20, 2.0),
    atr_period: int = 14,
    s: Series = DAILY,
) -> DataFrame:
    """All indicators with one pass of frames and two of exponential sums."""
    out = rolling(df, s, _sma_specs(windows) | _std_specs(windows) | _band_specs(bb[0]))
    out = out.withColumns(
        {f"zscore_{w}": _zscore(w) for w in windows}
        | {f"close_to_sma_{w}": _to_sma(w) for w in windows}
        | _bands(*bb)
    ).drop(*[f"_std_{w}" for w in windows], "_bb_mid", "_bb_std")
    out = _true_range(_moves(out, s), s)
    out = ewm_means(
        out,
        s,
        {f"ema_{x}": ("close", span_decay(x), x) for x in spans}
        | _rsi_specs(rsi_period)
        | _macd_specs(*macd_spans[:2])
        | {"atr": ("_tr", 1.0 - 1.0 / atr_period, atr_period)},
    )
    out = out.withColumns({"rsi": _rsi(), "atr_pct": F.col("atr") / (F.col("close") + EPS)})
    return _macd_finish(out.drop("_up", "_down", "_gain", "_loss", "_tr"), s, macd_spans[2])
