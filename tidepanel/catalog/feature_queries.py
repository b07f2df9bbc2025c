"""Queries over sources, cleaning, indicators, returns, regimes, assembly and signal quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog import views as v
from tidepanel.catalog.base import add
from tidepanel.catalog.oracle import EPS, MACRO_FEATURES, lag, roll, with_
from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise, new_path
from tidepanel.operators import assemble, clean, ic, indicators, macro, regime, returns
from tidepanel.sources import bars as src

OHLCV = "open high low close volume"
SMA, VOLS = indicators.SMA_WINDOWS, returns.VOL_WINDOWS
BLOCKS = Series(block=1024)


def on_bars(fn):
    return lambda spark, d: fn(v.bars(spark, d))


# --- sources and sinks ------------------------------------------------------------------------


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "bars")
    src.write_bars(v.bars(spark, d), path)
    return src.read_bars(spark, path, tickers=["1-URGENT", "5-LOW", "ABSENT"], missing="skip")


add(
    "read_bars", "A1 A4", _round_trip,
    (with_("bars5"), "select * from bars5 where ticker in ('1-URGENT', '5-LOW')"), doubles=OHLCV,
)


def _normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = v.bars(spark, d).withColumn("volume", F.when(F.col("ticker") != "5-LOW", F.col("volume")))
    raw = raw.withColumn("ticker", F.lower("ticker")).withColumnsRenamed({"close": "Close", "high": " High"})
    return src.normalise_bars(raw)


add(
    "normalise_bars", "A2", _normalise,
    (with_("bars5"), "select * from bars5 where ticker <> '5-LOW'"), doubles=OHLCV,
)


def _bars(spark: SparkSession, d: str, grain: str) -> DataFrame:
    t = v.ticks(spark, d)
    return src.bars_from_events(t, F.col("name"), "ts", F.col("price"), F.col("qty"), grain, tie="event_id")


def _bars_sql(dt: str) -> str:
    return f"""
select event_type as ticker, {dt} as dt, min_by(value + 1.0, ts) as open, max(value + 1.0) as high,
  min(value + 1.0) as low, max_by(value + 1.0, ts) as close, cast(count(*) as double) as volume
from events group by 1, 2"""


add("bars_daily", "A3", lambda s, d: _bars(s, d, "1d"), ("", _bars_sql("cast(ts as date)")), doubles=OHLCV)
add("bars_hourly", "A3", lambda s, d: _bars(s, d, "1h"), ("", _bars_sql("date_trunc('hour', ts)")), doubles=OHLCV)
add(
    "bars_5m", "A3", lambda s, d: _bars(s, d, "5m"),
    ("", _bars_sql("time_bucket(interval '5 minutes', ts)")), doubles=OHLCV,
)


def _features_read_back(spark: SparkSession, d: str) -> DataFrame:
    df = returns.returns_all(indicators.sma(v.bars(spark, d)))
    path = new_path(spark, "features")
    src.write_bars(assemble.impute_terminal(df), path, per_ticker=False)
    return src.read_bars(spark, path, schema=None)


add(
    "write_features", "A4 F14", _features_read_back,
    (with_("feats"), f"""
select ticker, dt, {', '.join(f"coalesce({c}, 0) as {c}" for c in ('sma_50', 'log_ret_5d', 'ret_skew_10d', 'realized_vol_63d'))}
from feats"""),
    doubles="sma_50 log_ret_5d ret_skew_10d realized_vol_63d",
)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    df = indicators.sma(v.bars(spark, d))
    return src.feature_manifest(df, assemble.feature_columns(df), "v1", {"sma_windows": list(SMA)})


add(
    "feature_manifest", "A5", _manifest,
    (with_("bars5"), """
select ticker, min(dt) as first_dt, max(dt) as last_dt, 'v1' as version,
  'sma_5,sma_10,sma_20,sma_50,sma_200' as feature_columns, '{"sma_windows": [5, 10, 20, 50, 200]}' as params,
  count(*) as num_rows, 12 as num_columns
from bars5 group by ticker"""),
    keys="ticker first_dt last_dt version feature_columns params", ints="num_rows num_columns",
)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    orders = v.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"), "o_orderkey", "o_totalprice"
    )
    return src.dedup_dates(orders, "o_orderkey")


add(
    "dedup_dates", "A6", _dedup,
    ("", """
select o_orderpriority as ticker, cast(o_orderdate as date) as dt, min(o_orderkey) as o_orderkey,
  min_by(o_totalprice, o_orderkey) as o_totalprice
from orders group by 1, 2"""),
    ints="o_orderkey", doubles="o_totalprice",
)


def _cut(spark: SparkSession, d: str) -> DataFrame:
    m = v.macro(spark, d)
    have = m.filter((F.col("label") != "P") & (F.col("dt") < F.when(F.col("label") == "F", F.lit("1995-06-01")).otherwise(F.lit("1997-01-01")).cast("date")))
    return src.incremental_cut(m, have)


add(
    "incremental_cut", "A7", _cut,
    (with_("macro"), """
select m.* from macro m left join (
  select label, max(dt) as seen from macro
  where label <> 'P' and dt < case when label = 'F' then date '1995-06-01' else date '1997-01-01' end group by label) s
on s.label = m.label where s.seen is null or m.dt > s.seen"""),
    keys="label dt", doubles="close",
)
add(
    "discover_series", "A8", on_bars(src.discover_series),
    (with_("bars5"), "select distinct ticker from bars5"), keys="ticker",
)


def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "report")
    src.write_report_csv(v.bars(spark, d).groupBy("ticker").agg(F.max("close").alias("top"), F.count("dt").alias("n")), path)
    return spark.read.csv(path, header=True, schema="ticker string, top double, n long")


add(
    "report_csv", "A9", _csv,
    (with_("bars5"), "select ticker, max(close) as top, count(*) as n from bars5 group by ticker"),
    keys="ticker", ints="n", doubles="top",
)
add(
    "sample_rows", "A10", on_bars(lambda b: src.sample_rows(b, 500)),
    (with_("bars5"), "select * from bars5 order by md5(ticker || '|' || cast(dt as varchar) || '|42') limit 500"), doubles=OHLCV,
)

# --- cleaning ---------------------------------------------------------------------------------


def on_dirty(fn):
    return lambda spark, d: fn(v.dirty(spark, d))


_FILL = ", ".join(
    f"last_value({c} ignore nulls) over (partition by ticker order by dt rows between unbounded preceding and current row) as {c}"
    for c in OHLCV.split()
)
_KEPT = "select * from dirty where ticker in (select ticker from dirty group by ticker having greatest(avg(cast(close is null as int)), avg(cast(volume is null as int)), avg(cast(open is null as int)), avg(cast(high is null as int)), avg(cast(low is null as int))) <= 0.05)"
add("missing_filter", "B1", on_dirty(clean.missing_filter), (with_("dirty"), _KEPT), doubles=OHLCV)
add("fill_forward", "B2", on_dirty(clean.fill_forward), (with_("dirty"), f"select ticker, dt, {_FILL} from dirty"), doubles=OHLCV)
add(
    "fill_interpolate", "B3", on_dirty(lambda b: clean.fill_interpolate(b, ("close", "volume"))),
    (with_("dirty"), f"""
select ticker, dt, {', '.join(f'''case when {c} is not null then {c} when p_{c} is not null and q_{c} is not null
  then p_{c} + (q_{c} - p_{c}) * date_diff('day', pd_{c}, dt) / cast(date_diff('day', pd_{c}, qd_{c}) as double) else p_{c} end as {c}''' for c in ('close', 'volume'))}
from (select ticker, dt, close, volume, {', '.join(f'''last_value({c} ignore nulls) over up as p_{c},
  last_value(case when {c} is not null then dt end ignore nulls) over up as pd_{c}, first_value({c} ignore nulls) over dn as q_{c},
  first_value(case when {c} is not null then dt end ignore nulls) over dn as qd_{c}''' for c in ('close', 'volume'))}
  from dirty window up as (partition by ticker order by dt rows between unbounded preceding and current row),
  dn as (partition by ticker order by dt rows between current row and unbounded following)) x"""),
    doubles="close volume",
)
add(
    "clamp_high", "B4", on_dirty(clean.clamp_high),
    (with_("dirty"), "select * replace (case when high < low then low else high end as high) from dirty"), doubles=OHLCV,
)
_POSITIVE = "coalesce(open < 0, false) = false and coalesce(high < 0, false) = false and coalesce(low < 0, false) = false and coalesce(close < 0, false) = false"
add(
    "drop_negative_prices", "B5", on_dirty(clean.drop_negative_prices),
    (with_("dirty"), f"select * from dirty where {_POSITIVE}"), doubles=OHLCV,
)
add(
    "zero_negative_volume", "B6", on_dirty(clean.zero_negative_volume),
    (with_("dirty"), "select * replace (case when volume < 0 then 0 else volume end as volume) from dirty"), doubles=OHLCV,
)


def _outlier_sql(src_name: str) -> str:
    m, s = roll("avg", "close", 60, 10), roll("stddev_samp", "close", 60, 10)
    return f"select *, coalesce(abs((close - {m}) / ({s} + {EPS})) > 2.5, false) as is_outlier from {src_name}"


add(
    "flag_outliers", "B7", on_bars(lambda b: clean.flag_outliers(b, threshold=2.5)),
    (with_("bars5"), _outlier_sql("bars5")), keys="ticker dt is_outlier",
)
_CLEAN = f"""
select ticker, dt, open, case when high < low then low else high end as high, low, close,
  case when volume < 0 then 0 else volume end as volume
from (select ticker, dt, {_FILL} from ({_KEPT}) k) f where {_POSITIVE}"""
add(
    "clean_all", "B8", on_dirty(lambda b: clean.clean(b, threshold=2.5)),
    (with_("dirty"), _outlier_sql(f"({_CLEAN}) c")), keys="ticker dt is_outlier", doubles=OHLCV,
)

# --- indicators -------------------------------------------------------------------------------


def feat(name: str, ids: str, fn, doubles: str = "", ints: str = "", view: str = "feats", digits: int = 6) -> None:
    add(name, ids, on_bars(fn), (with_(view), f"select * from {view}"), doubles=doubles, ints=ints, digits=digits)


def names(pattern: str, values) -> str:
    return " ".join(pattern.format(x) for x in values)


# means of 200 prices with four decimals end in ...5 at the seventh, so they are compared finer
SMAS = names("sma_{}", SMA).replace("sma_200", "sma_200:8")


BANDS = "bb_middle bb_upper bb_lower bb_bandwidth bb_pct_b"
EWMS = "ema_12 ema_26 ema_50 rsi atr atr_pct macd_line macd_signal macd_histogram"
feat("sma", "C1", indicators.sma, SMAS)
feat("ema", "C2", indicators.ema, "ema_12 ema_26 ema_50", view="ewm")
feat("rsi", "C3", indicators.rsi, "rsi", view="ewm")
feat("macd", "C4", indicators.macd, "macd_line macd_signal macd_histogram", view="ewm")
feat("bollinger", "C5", indicators.bollinger, BANDS)
feat("atr", "C6", indicators.atr, "atr atr_pct", view="ewm")
feat("price_zscore", "C7", indicators.price_zscore, names("zscore_{}", SMA))
feat("close_to_sma", "C8", indicators.close_to_sma, names("close_to_sma_{}", SMA))
TECH = f"{SMAS} {names('zscore_{0} close_to_sma_{0}', SMA)} {BANDS} {EWMS}"
_TECH_SQL = "select f.*, e.* exclude (ticker, dt, rn, close) from feats f join ewm e using (ticker, dt)"
add("technical_all", "C9", on_bars(indicators.technical_all), (with_("feats", "ewm"), _TECH_SQL), doubles=TECH)
add(
    "technical_all_blocks", "C9", on_bars(lambda b: indicators.technical_all(b, s=BLOCKS)),
    (with_("feats", "ewm"), _TECH_SQL), doubles=TECH,
)

# --- returns ----------------------------------------------------------------------------------

feat("log_returns", "D1", returns.log_returns, "log_ret_1d log_ret_5d log_ret_21d")
feat("lagged_returns", "D2", returns.lagged_returns, names("log_ret_1d_lag_{}", returns.LAGS))
feat("rolling_returns", "D3", returns.rolling_returns, names("rolling_ret_{}d", returns.RETURN_WINDOWS))
feat("realized_vol", "D4", returns.realized_vol, names("realized_vol_{}d", VOLS))
feat("ewm_vol", "D5", returns.ewm_vol, "ewm_vol", view="ewm")
feat("vol_ratio", "D6", lambda b: returns.vol_ratio(returns.realized_vol(b)), "vol_ratio_5_20")
feat("rolling_stats", "D7", returns.rolling_stats, names("ret_mean_{0}d ret_std_{0}d ret_skew_{0}d", VOLS))
feat("volume_change_pct", "D8", returns.volume_change_pct, "volume_change_pct")
feat("relative_volume", "D9", returns.relative_volume, "relative_volume")
feat("obv", "D10", returns.obv, "obv")
feat("obv_zscore", "D11", lambda b: returns.obv_zscore(returns.obv(b)), "obv_zscore")
feat("vol_adj_returns", "D12", returns.vol_adj_returns, names("vol_adj_ret_{}d", (5, 10, 20)))
feat("return_zscore", "D13", returns.return_zscore, names("ret_zscore_{}d", (20, 60)))
RETS = (
    "log_ret_1d log_ret_5d log_ret_21d "
    + names("log_ret_1d_lag_{}", returns.LAGS) + " " + names("rolling_ret_{}d", returns.RETURN_WINDOWS) + " "
    + names("realized_vol_{0}d ret_mean_{0}d ret_std_{0}d ret_skew_{0}d", VOLS)
    + " ewm_vol vol_ratio_5_20 volume_change_pct relative_volume obv obv_zscore "
    + names("vol_adj_ret_{}d", (5, 10, 20)) + " " + names("ret_zscore_{}d", (20, 60))
)
add("returns_all", "D14", on_bars(returns.returns_all), (with_("feats", "ewm"), _TECH_SQL), doubles=RETS)
add(
    "returns_all_blocks", "D14", on_bars(lambda b: returns.returns_all(b, s=BLOCKS)),
    (with_("feats", "ewm"), _TECH_SQL), doubles=RETS,
)

# --- regimes ----------------------------------------------------------------------------------

REGIME_FLAGS = (
    "regime_is_high_vol regime_is_low_vol regime_trend_bullish regime_trend_bearish "
    "regime_is_trending_up regime_is_trending_down market_regime"
)
feat("regime_volatility", "E1", regime.regime_volatility, "regime_volatility")
feat("regime_vol_flags", "E2", regime.regime_features, ints="regime_is_high_vol regime_is_low_vol")
feat("regime_trend_flags", "E3", regime.regime_features, ints="regime_trend_bullish regime_trend_bearish")
feat("regime_trend_slope", "E4", regime.regime_features, "regime_trend_slope", "regime_is_trending_up regime_is_trending_down")
feat("regime_drawdown", "E5", regime.regime_features, "regime_drawdown")
feat("market_regime", "E6", regime.regime_features, ints="market_regime")
feat(
    "regime_features_blocks", "E1-E6", lambda b: regime.regime_features(b, s=BLOCKS),
    "regime_volatility regime_trend_slope regime_drawdown", REGIME_FLAGS,
)
add(
    "regime_histogram", "E7", on_bars(lambda b: regime.regime_histogram(regime.regime_features(b))),
    (with_("feats"), "select ticker, market_regime, count(*) as n from feats group by all"),
    keys="ticker", ints="market_regime n",
)

# --- assembly ---------------------------------------------------------------------------------

feat("calendar_features", "F1", assemble.calendar_features, ints="day_of_week month quarter")
feat("cyclical_dow", "F2", lambda b: assemble.cyclical_dow(assemble.calendar_features(b)), "dow_sin dow_cos")
feat("forward_return", "F3", assemble.forward_return, "target_fwd_return")
feat("target_direction", "F4", lambda b: assemble.target_direction(assemble.forward_return(b)), "target_fwd_return target_direction")
add(
    "universe_avg_return", "F5", on_bars(assemble.universe_avg_return),
    (with_("univ"), "select * from univ"), keys="dt", doubles="portfolio_avg_return",
)


def _cross(b: DataFrame, s: Series = DAILY) -> DataFrame:
    df = b.join(assemble.universe_avg_return(b, s), "dt")
    return assemble.corr_with_universe(assemble.relative_strength(returns.log_returns(df, s=s)), s=s)


feat("relative_strength", "F6", _cross, "relative_strength_portfolio", view="crossf")
feat("corr_with_universe", "F7", _cross, "corr_with_portfolio_20d", view="crossf")
add("union_calendar", "F8", on_bars(assemble.union_calendar), (with_("bars5"), "select distinct dt from bars5"), keys="dt")
add(
    "macro_features", "F9", lambda s, d: macro.macro_features(v.macro(s, d)),
    (with_("macrof"), "select * from macrof"), keys="label dt", doubles=" ".join(MACRO_FEATURES),
)
MACRO_WIDE = " ".join(f"macro_{x}_{c}" for x in v.LABELS for c in MACRO_FEATURES)
add(
    "align_macro", "F10",
    lambda s, d: macro.align_macro(macro.macro_features(v.macro(s, d)), v.bars(s, d).select("dt"), v.LABELS),
    (with_("macrow"), "select * from macrow"), keys="dt", doubles=MACRO_WIDE,
)


def _warm_macro(spark: SparkSession, d: str) -> DataFrame:
    late = v.bars(spark, d).filter(F.col("dt") >= F.lit("1995-01-01").cast("date"))
    return macro.macro_warmup_range(v.macro(spark, d), late)


add(
    "macro_warmup_range", "F11", _warm_macro,
    (with_("macro", "bars5"), """
select m.* from macro m, (select min(dt) as lo, max(dt) as hi from bars5 where dt >= date '1995-01-01') b
where m.dt >= b.lo - interval 120 day and m.dt <= b.hi"""),
    keys="label dt", doubles="close",
)
_WARM = ["open", "high", "low", "close", "volume", *names("sma_{}", SMA).split(), *names("zscore_{}", SMA).split()]


def _warm(b: DataFrame) -> DataFrame:
    return assemble.warmup_filter(indicators.price_zscore(indicators.sma(b)))


add(
    "warmup_filter", "F12", on_bars(_warm),
    (with_("feats"), f"""
select * from feats
where ({' + '.join(f'cast({c} is not null as int)' for c in _WARM)}) / cast({len(_WARM)} as double) >= 0.8"""),
    doubles="close sma_50 zscore_50",
)


def _feature_columns(b: DataFrame) -> DataFrame:
    df = assemble.target_direction(assemble.forward_return(indicators.sma(returns.obv(b))))
    df = df.withColumns({"pred_X": F.lit(1), "proba_X": F.lit(0.5), "meta_pred": F.lit(1)})
    return df.select("ticker", "dt", *assemble.feature_columns(df))


feat("feature_columns", "F13", _feature_columns, SMAS)
_IMPUTED = "sma_200 realized_vol_63d zscore_20 log_ret_5d"


def _impute(b: DataFrame) -> DataFrame:
    gaps = F.when(F.pmod(F.dayofyear("dt"), F.lit(9)) != 0, F.col("close"))
    return assemble.impute_terminal(b.withColumns({"gap": gaps, "early": F.when(F.year("dt") > 1993, F.col("high"))}))


add(
    "impute_terminal", "F14", on_bars(_impute),
    (with_("bars5"), """
select ticker, dt, close, coalesce(last_value(case when dayofyear(dt) % 9 <> 0 then close end ignore nulls) over w, 0) as gap,
  coalesce(last_value(case when year(dt) > 1993 then high end ignore nulls) over w, 0) as early
from bars5 window w as (partition by ticker order by dt rows between unbounded preceding and current row)"""),
    doubles="close gap early",
)
DESCRIBED = [c.split(":")[0] for c in f"{TECH} {RETS} {REGIME_FLAGS} regime_volatility regime_trend_slope regime_drawdown".split()]


def _described(b: DataFrame) -> DataFrame:
    df = regime.regime_features(returns.returns_all(indicators.technical_all(b)))
    return assemble.describe_features(df, DESCRIBED).withColumnRenamed("count", "n")


add(
    "describe_features", "F15", on_bars(_described),
    (f"{with_('feats', 'ewm')},\nwide as materialized ({_TECH_SQL})", " union all ".join(f"""
select '{c}' as feature, count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, max({c}) as max,
  quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75 from wide""" for c in DESCRIBED)),
    # quartiles of decimal prices end in a 5 at the seventh digit
    keys="feature", ints="n", doubles="mean std min max q25:8 q50:8 q75:8",
)
ALL_DOUBLES = (
    f"{OHLCV} portfolio_avg_return {MACRO_WIDE} {TECH} {RETS} regime_volatility regime_trend_slope regime_drawdown "
    "dow_sin dow_cos target_fwd_return target_direction relative_strength_portfolio corr_with_portfolio_20d"
)
ALL_INTS = f"{REGIME_FLAGS} day_of_week month quarter"
_ALL = [*ALL_DOUBLES.replace(":8", "").split(), *ALL_INTS.split()]
ALL_SQL = (
    with_("crossf", "ewm", "macrow"),
    f"""
select * from (select c.*, e.* exclude (ticker, dt, rn, close), m.* exclude (dt)
  from crossf c join ewm e using (ticker, dt) join macrow m using (dt)) j
where ({' + '.join(f'cast({c} is not null as int)' for c in _ALL)}) / cast({len(_ALL)} as double) >= 0.8""",
)


def build(spark: SparkSession, d: str, s: Series = DAILY) -> DataFrame:
    return assemble.build_features(v.bars(spark, d), v.macro(spark, d), v.LABELS, s=s)


add("build_features", "F16", build, ALL_SQL, doubles=ALL_DOUBLES, ints=ALL_INTS)

# intraday bars have no calendar bound, so their series are always cut into blocks
_HOUR = _bars_sql("date_trunc('hour', ts)")


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    s = Series(block=256, slot=86_400)
    df = returns.obv(_bars(spark, d, "1h"), s)
    return indicators.sma(returns.realized_vol(df, (20,), s=s), (20, 200), s=s)


add(
    "hourly_features", "A3 C1 D4 D10", _hourly,
    (f"with h as ({_HOUR})", f"""
select *, {roll('avg', 'close', 20, 20)} as sma_20, {roll('avg', 'close', 200, 200)} as sma_200,
  {roll('stddev_samp', 'r', 20, 20)} * sqrt(cast(252 as double)) as realized_vol_20d,
  sum(sign(close - pc) * volume) over (partition by ticker order by dt) as obv
from (select *, {lag('close')} as pc, ln(close / {lag('close')}) as r from h) x"""),
    doubles="close sma_20 sma_200 realized_vol_20d obv",
)

# --- signal quality ---------------------------------------------------------------------------

IC_FEATURES = ["zscore_20", "realized_vol_20d", "close_to_sma_50", "rolling_ret_21d", "market_regime"]
#: All model inputs of the feature table; the pooled matrix keeps to the five above.
IC_ALL = [c for c in (c.partition(":")[0] for c in _ALL) if c not in assemble.NOT_FEATURES]


def ic_input(b: DataFrame) -> DataFrame:
    df = regime.regime_features(returns.realized_vol(returns.rolling_returns(b), (20,)))
    return indicators.close_to_sma(indicators.price_zscore(df, (20,)), (50,))


def ic_sql(by: str, method: str, features: list[str]) -> str:
    cols = ", ".join(f"lead(close, {h}) over (partition by ticker order by dt) / close - 1 as f{h}" for h in ic.HORIZONS)
    x = "round(cast({} as double), 8)" if features is IC_ALL else "cast({} as double)"
    long = " union all ".join(
        f"select {by} as grp, '{c}' as feature, {h} as horizon, {x.format(c)} as x, f{h} as y from r where {c} is not null and f{h} is not null"
        for c in features for h in ic.HORIZONS
    )
    w = "partition by grp, feature, horizon"
    rank = ", ".join(
        f"rank() over ({w} order by {a}) + (count(*) over ({w}, {a}) - 1) / cast(2 as double) as r{a}" for a in "xy"
    )
    a, b = ("rx", "ry") if method == "spearman" else ("x", "y")
    return f"""
select grp, feature, horizon, count(*) as n, case when count(*) > 30 and not isnan(corr({a}, {b})) then corr({a}, {b}) end as ic
from (select *, {rank} from (select * from ({long}) l) l2) l3 group by grp, feature, horizon"""


_AHEAD = ", ".join(f"lead(close, {h}) over (partition by ticker order by dt) / close - 1 as f{h}" for h in ic.HORIZONS)


def _ic_with(by: str, method: str = "spearman") -> str:
    """Forward returns are those of the table's own rows."""
    if by == "ticker":
        return f"{ALL_SQL[0]}, r as materialized (select *, {_AHEAD} from ({ALL_SQL[1]}) a), ics as materialized ({ic_sql(by, method, IC_ALL)})"
    return with_("feats") + f", r as (select *, {_AHEAD} from feats), ics as ({ic_sql(by, method, IC_FEATURES)})"


add(
    "ic_forward_returns", "G1", on_bars(ic.forward_returns),
    (with_("feats"), f"select ticker, dt, {', '.join(f'lead(close, {h}) over (partition by ticker order by dt) / close - 1 as fwd_ret_{h}d' for h in ic.HORIZONS)} from feats"),
    doubles=names("fwd_ret_{}d", ic.HORIZONS),
)


def ics(spark: SparkSession, d: str, method: str = "spearman", by=("ticker",)) -> DataFrame:
    if by:
        df = build(spark, d)
        columns = assemble.feature_columns(df)
        # equal prices give equal means only up to the last bits: rounded, both engines see the same ties
        df = materialise(df.withColumns({c: F.round(F.col(c).cast("double"), 8) for c in columns}), "features")
        return materialise(ic.ic_matrix(df, columns, method=method, by=by), "ics")
    return ic.ic_matrix(ic_input(v.bars(spark, d)), IC_FEATURES, method=method, by=by)


add(
    "ic_matrix", "G2", ics, (_ic_with("ticker"), "select grp as ticker, * from ics"),
    keys="ticker feature", ints="horizon n", doubles="ic",
)
add(
    "ic_matrix_pearson", "G2", lambda s, d: ics(s, d, "pearson"),
    (_ic_with("ticker", "pearson"), "select grp as ticker, * from ics"), keys="ticker feature", ints="horizon n", doubles="ic",
)
add(
    "ic_matrix_universe", "G2", lambda s, d: ics(s, d, by=()),
    (_ic_with("'all'"), "select grp as sample, * from ics"), keys="sample feature", ints="horizon n", doubles="ic",
)
add(
    "ic_weak_strong", "G3", lambda s, d: ic.split_weak_strong(ics(s, d), 0.03),
    (_ic_with("ticker"), """
select grp as ticker, feature, ic, case when abs(ic) >= 0.03 then 'strong' when abs(ic) < 0.03 then 'weak' end as strength
from ics where horizon = 1"""),
    keys="ticker feature strength", doubles="ic",
)
_HALF = """,
seg as (select *, abs(ic) as a, lag(abs(ic)) over w as pa, lag(horizon) over w as ph, first_value(abs(ic)) over w as a1,
  last_value(abs(ic)) over (partition by grp, feature order by horizon rows between unbounded preceding and unbounded following) as az
  from ics window w as (partition by grp, feature order by horizon)),
hit as (select grp, feature, min(horizon) as h from seg where a <= a1 / 2 and a1 / 2 <= pa group by 1, 2),
hl as (select s.grp, s.feature, case when s.a1 > 0 then
    coalesce(case when s.a <> s.pa then s.ph + (s.a1 / 2 - s.pa) / ((s.a - s.pa) / (s.horizon - s.ph)) end,
      case when s.az > s.a1 / 2 then cast('inf' as double) end) end as half_life
  from seg s left join hit using (grp, feature) where s.horizon = coalesce(hit.h, 1))"""
add(
    "ic_half_life", "G4", lambda s, d: ic.ic_half_life(ics(s, d)),
    (_ic_with("ticker") + _HALF, "select grp as ticker, feature, half_life from hl"), keys="ticker feature", doubles="half_life",
)
add(
    "optimal_holding_period", "G5", lambda s, d: ic.optimal_holding_period(ic.ic_half_life(ics(s, d))),
    (_ic_with("ticker") + _HALF, """
select grp as ticker, quantile_cont(half_life, 0.5) as median_half_life,
  greatest(1, round_even(quantile_cont(half_life, 0.5), 0)) as holding_days
from hl where half_life > 0 and half_life < cast('inf' as double) group by grp"""),
    keys="ticker", ints="holding_days", doubles="median_half_life",
)
add(
    "ic_summary", "G6", lambda s, d: ic.ic_summary(ics(s, d), top=3),
    (_ic_with("ticker") + _HALF, f"""
select * from (select *, row_number() over (partition by ticker order by round(abs(ic_1d), 9) desc nulls last, feature) as rk
  from (select i.grp as ticker, i.feature, {', '.join(f'max(case when horizon = {h} then ic end) as ic_{h}d' for h in ic.HORIZONS)}, max(h.half_life) as half_life
    from ics i join hl h using (grp, feature) group by 1, 2) p) z where rk <= 3"""),
    keys="ticker feature", doubles=names("ic_{}d", ic.HORIZONS) + " half_life",
)
