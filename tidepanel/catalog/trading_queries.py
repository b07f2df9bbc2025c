"""Queries over splits, scores, signals, risk, allocation, costs, returns, metrics and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.catalog import views as v
from tidepanel.catalog.base import add
from tidepanel.catalog.feature_queries import on_bars
from tidepanel.catalog.oracle import (
    ANN,
    EPS,
    REPORT_DOUBLES,
    REPORT_INTS,
    frame,
    lag,
    ml_biased,
    ml_size,
    pair,
    report_sql,
    roll,
    with_,
)
from tidepanel.functions.series import DAILY, Series
from tidepanel.functions.tables import materialise
from tidepanel.operators import (
    allocate,
    assemble,
    costs,
    hedge,
    indicators,
    meta,
    metrics,
    pnl,
    quality,
    regime,
    returns,
    risk,
    robust,
    signals,
    splits,
)
from tidepanel.plans import portfolio as pf

BLOCKS = Series(block=1024)
PANEL_KEYS = "strategy, ticker"


def logistic(column: str, scale: float):
    return F.when(F.col(column).isNull(), 0.5).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(column) / scale)))


def scored(b: DataFrame, s: Series = DAILY) -> DataFrame:
    """Features with closed-form scores, so that what follows does not depend on a learner."""
    df = returns.rolling_returns(returns.realized_vol(b, (20,), s=s), (21,), s=s)
    df = regime.regime_features(indicators.price_zscore(df, (5, 10, 20), s=s), s=s)
    df = assemble.target_direction(assemble.forward_return(df, s=s))
    df = df.withColumns({"proba_S": logistic("zscore_20", -4.0), "proba_T": logistic("zscore_5", 3.0)})
    return df.withColumns(
        {
            "pred_S": (F.col("proba_S") > 0.5).cast("int"),
            "pred_T": (F.col("proba_T") > 0.5).cast("int"),
            "meta_pred": F.coalesce((F.col("zscore_10") < 0.8).cast("int"), F.lit(1)),
        }
    )


def on_scored(fn):
    return lambda spark, d: fn(scored(v.bars(spark, d)))


# --- splits -----------------------------------------------------------------------------------

FOLD_KEYS, FOLD_INTS = "train_start train_end test_start test_end", "fold train_size test_size"
_CALENDAR = """
select f.fold, min(case when d.dt between rs and re then d.dt end) as train_start, max(case when d.dt between rs and re then d.dt end) as train_end,
  min(case when d.dt between ts and te then d.dt end) as test_start, max(case when d.dt between ts and te then d.dt end) as test_end,
  count(case when d.dt between rs and re then 1 end) as train_size, count(case when d.dt between ts and te then 1 end) as test_size
from (select distinct dt from bars5) d cross join (
  select fold, te, ts, re, greatest(cast(re - interval 12 month as date), lo) as rs from (
    select fold, te, ts, cast(ts - interval 5 day as date) as re, lo from (
      select fold, te, cast(te - interval 3 month as date) as ts, lo from (
        select 5 - b as fold, cast(hi - to_months(cast(3 * b as int)) as date) as te, lo
        from range(5) t(b), (select max(dt) as hi, min(dt) as lo from bars5) m) a) b) c) f
group by f.fold having count(case when d.dt between rs and re then 1 end) >= 200 and count(case when d.dt between ts and te then 1 end) > 0"""
add(
    "calendar_walk_forward", "H1", on_bars(splits.calendar_walk_forward), (with_("bars5"), _CALENDAR),
    keys=FOLD_KEYS, ints=FOLD_INTS,
)
add(
    "assign_folds", "H2", on_bars(lambda b: splits.assign_folds(b, splits.calendar_walk_forward(b))),
    (with_("bars5") + f", folds as ({_CALENDAR})", """
select b.ticker, b.dt, r.role, f.fold, b.close from bars5 b cross join folds f cross join (select unnest(['train', 'test']) as role) r
where b.dt between case when r.role = 'train' then f.train_start else f.test_start end
  and case when r.role = 'train' then f.train_end else f.test_end end"""),
    keys="ticker dt role", ints="fold", doubles="close",
)
_IDX = "idx as (select dt, row_number() over (order by dt) - 1 as i, count(*) over () as n from (select distinct dt from bars5) d)"


def _wf_sql(lo: str, start: str, test: int) -> str:
    return f"""
select f + 1 as fold, min(case when i < s then dt end) as train_start, max(case when i < s then dt end) as train_end,
  min(case when i >= s then dt end) as test_start, max(case when i >= s then dt end) as test_end,
  count(case when i < s then 1 end) as train_size, count(case when i >= s then 1 end) as test_size
from (select *, {start} + f * {test} as s from idx, range(1000) t(f)) x
where s < n and i >= {lo} and i < s + {test} group by f"""


add(
    "index_walk_forward", "H3", on_bars(lambda b: splits.fold_table(splits.index_walk_forward(b))),
    (with_("bars5") + ", " + _IDX, _wf_sql("s - 252", "252", 20)), keys=FOLD_KEYS, ints=FOLD_INTS,
)
add(
    "expanding_walk_forward", "H4", on_bars(lambda b: splits.fold_table(splits.expanding_walk_forward(b))),
    (with_("bars5") + ", " + _IDX, _wf_sql("252", "272", 20)), keys=FOLD_KEYS, ints=FOLD_INTS,
)
_GI = "gi as (select ticker, dt, row_number() over (order by dt, ticker) - 1 as g, count(*) over () as n from bars5)"
add(
    "time_series_cv", "H5", on_bars(lambda b: splits.time_series_cv(b, 3)),
    (with_("bars5") + ", " + _GI, """
select ticker, dt, case when g >= n - 3 * (n // 4) then (g - (n - 3 * (n // 4))) // (n // 4) + 1 else 0 end as cv_fold from gi"""),
    ints="cv_fold",
)
add(
    "chronological_thirds", "H6", on_bars(splits.chronological_thirds),
    (with_("bars5") + ", " + _GI, "select ticker, dt, case when g < n // 3 then 'Early' when g < 2 * (n // 3) then 'Mid' else 'Late' end as period from gi"),
    keys="ticker dt period",
)
add(
    "fraction_split", "H6", on_bars(splits.fraction_split),
    (with_("bars5") + ", " + _GI, "select ticker, dt, case when g < floor(n * cast(0.8 as double)) then 'train' else 'test' end as part from gi"),
    keys="ticker dt part",
)

# --- scores -----------------------------------------------------------------------------------

SCALED = ["close", "realized_vol_20d", "regime_trend_bullish", "constant"]


def _scaler(b: DataFrame) -> DataFrame:
    df = regime.regime_features(returns.realized_vol(b, (20,))).withColumn("constant", F.lit(3.0))
    df = df.withColumn("regime_trend_bullish", F.col("regime_trend_bullish").cast("double"))
    folds = splits.assign_folds(df, splits.calendar_walk_forward(b))
    fitted = meta.fit_scaler(folds.filter("role = 'train'"), SCALED)
    return meta.apply_scaler(folds.filter("role = 'test'"), fitted, SCALED)


add(
    "fit_scaler", "I1", on_bars(_scaler),
    (with_("feats") + f", folds as ({_CALENDAR}), mem as (select f.fold, x.ticker, x.dt, close, realized_vol_20d, cast(regime_trend_bullish as double) as regime_trend_bullish, cast(3 as double) as constant, x.dt between f.train_start and f.train_end as tr, x.dt between f.test_start and f.test_end as te from feats x cross join folds f), fit as (select fold, {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as d_{c}' for c in SCALED)} from mem where tr group by fold)",
     f"select ticker, dt, fold, {', '.join(f'({c} - m_{c}) / case when d_{c} > 1e-12 then d_{c} else 1 end as {c}' for c in SCALED)} from mem join fit using (fold) where te"),
    ints="fold", doubles=" ".join(SCALED),
)
add(
    "ensemble_soft", "I6", on_scored(lambda x: meta.ensemble_soft(x, ["S", "T"], "E")),
    (with_("scored"), "select *, (proba_S + proba_T) / 2 as proba_E, cast((proba_S + proba_T) / 2 > 0.5 as int) as pred_E from scored"),
    ints="pred_E", doubles="proba_E",
)
add(
    "ensemble_hard", "I7", on_scored(lambda x: meta.ensemble_hard(x, ["S", "T"], "V")),
    (with_("scored"), "select *, cast(pred_S + pred_T > 1 as int) as pred_V from scored"), ints="pred_V",
)


def _report_sql(model: str, group: str) -> str:
    return f"""
select {group}, (tp + tn) / cast(tp + tn + fp + fn as double) as accuracy, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as prec,
  case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end as f1, tn, fp, fn, tp,
  case when pairs > 0 then wins / pairs else 0.5 end as auc
from (select {group}, count(case when target_direction = 0 and pred_{model} = 0 then 1 end) as tn, count(case when target_direction = 0 and pred_{model} = 1 then 1 end) as fp,
    count(case when target_direction = 1 and pred_{model} = 0 then 1 end) as fn, count(case when target_direction = 1 and pred_{model} = 1 then 1 end) as tp
  from ev where proba_{model} <> 0.5 and target_direction is not null group by {group}) c
join (select {group}, sum(pos * (under + neg / cast(2 as double))) as wins, sum(pos) * sum(neg) as pairs
  from (select *, coalesce(sum(neg) over (partition by {group} order by s rows between unbounded preceding and 1 preceding), 0) as under
    from (select {group}, proba_{model} as s, count(case when target_direction = 1 then 1 end) as pos, count(case when target_direction = 0 then 1 end) as neg
      from ev where proba_{model} <> 0.5 and target_direction is not null group by {group}, 2) a) b group by {group}) w using ({group})"""


CLASS_DOUBLES, CLASS_INTS = "accuracy prec recall f1 auc", "tn fp fn tp"
_EV = with_("scored") + ", ev as (select *, 'S' as model from scored)"
add(
    "classification_report", "I19", on_scored(lambda x: meta.classification_report(x, "S")),
    (_EV, _report_sql("S", "model")), keys="model", ints=CLASS_INTS, doubles=CLASS_DOUBLES,
)
add(
    "classification_by_ticker", "I19", on_scored(lambda x: meta.classification_report(x, "T", ("ticker",))),
    (_EV, _report_sql("T", "ticker")), keys="ticker", ints=CLASS_INTS, doubles=CLASS_DOUBLES,
)


def _sharpe_sql(model: str, group: str) -> str:
    return f"""
select {group}, case when stddev_samp(r) > 1e-10 then avg(r) / stddev_samp(r) * {ANN} else 0 end as sharpe
from (select *, coalesce(lag(pred_{model}) over (partition by ticker order by dt), 0) * log_ret_1d as r
  from ev where proba_{model} <> 0.5 and target_direction is not null) x group by {group}"""


add(
    "model_sharpe", "I20", on_scored(lambda x: meta.model_sharpe(x, "S")),
    (_EV, _sharpe_sql("S", "model")), keys="model", doubles="sharpe",
)


def _deltas(x: DataFrame) -> DataFrame:
    sides = [
        meta.classification_report(x, m, ("ticker",)).join(meta.model_sharpe(x, m, ("ticker",)), "ticker") for m in "ST"
    ]
    return meta.tuned_vs_baseline(*sides, on="ticker")


_METRICS = ("auc", "sharpe", "accuracy", "f1")
add(
    "tuned_vs_baseline", "I12", on_scored(_deltas),
    (_EV + "".join(f", c{m} as ({_report_sql(m, 'ticker')}), h{m} as ({_sharpe_sql(m, 'ticker')}), z{m} as (select * from c{m} join h{m} using (ticker))" for m in "ST"),
     f"select a.ticker, {', '.join(f'a.{m} as tuned_{m}, b.{m} as base_{m}, a.{m} - b.{m} as delta_{m}' for m in _METRICS)} from zS a join zT b using (ticker)"),
    keys="ticker", doubles=" ".join(f"tuned_{m} base_{m} delta_{m}" for m in _METRICS),
)
META_INTS = "meta_regime_bullish meta_regime_bearish meta_regime_high_vol meta_regime_low_vol meta_market_regime"
META_DOUBLES = " ".join(c for c in meta.META_FEATURES if c not in META_INTS.split())
_META = f"""
select *, proba_S as meta_confidence, abs(proba_S - 0.5) as meta_confidence_distance, {roll('avg', 'hit', 20, 5)} as meta_rolling_accuracy,
  {roll('avg', 'er', 20, 5)} / ({roll('stddev_samp', 'er', 20, 5)} + {EPS}) * {ANN} as meta_rolling_sharpe, realized_vol_20d as meta_volatility_20d,
  regime_trend_bullish as meta_regime_bullish, regime_trend_bearish as meta_regime_bearish, regime_is_high_vol as meta_regime_high_vol,
  regime_is_low_vol as meta_regime_low_vol, market_regime as meta_market_regime, {roll('stddev_samp', 'proba_S', 10, 3)} as meta_pred_stability,
  {roll('avg', 'proba_S', 10, 3)} as meta_pred_rolling_mean,
  {roll('sum', 'win', 20, 5)} / ({roll('sum', 'act', 20, 5)} + {EPS}) as meta_rolling_winrate, regime_drawdown as meta_drawdown,
  case when pred_S <> 0 and next_ret is not null then cast(pred_S * next_ret > 0 as int) end as meta_target
from (select *, case when pl is not null then cast(pp = pl as int) end as hit, pp * log_ret_1d as er, cast(coalesce(pp * log_ret_1d > 0, false) as int) as win,
    cast(coalesce(pp <> 0, true) as int) as act
  from (select *, {lag('target_direction')} as pl, {lag('pred_S')} as pp from scored) a) b"""
add(
    "meta_features", "I16", on_scored(lambda x: meta.meta_features(x, "S")),
    (with_("scored"), _META), ints=META_INTS, doubles=META_DOUBLES,
)
add(
    "meta_target", "I17", on_scored(lambda x: meta.meta_target(x, "S")),
    (with_("scored"), _META), doubles="meta_target",
)


def _arm_sql(r: str, sig: str, tag: str) -> str:
    ok = f"count({r}) >= 10 and coalesce(stddev_samp({r}), 0) >= 1e-10"
    act = f"case when {sig} <> 0 then {r} end"
    return f"""count({act}) as {tag}_trades, case when {ok} then avg({r}) / stddev_samp({r}) * {ANN} else 0 end as {tag}_sharpe,
  case when {ok} then product(1 + {r}) - 1 else 0 end as {tag}_return,
  case when {ok} then coalesce(count(case when {act} > 0 then 1 end) / cast(nullif(count({act}), 0) as double), 0) else 0 end as {tag}_win_rate,
  case when {ok} then coalesce(avg({act}), 0) else 0 end as {tag}_avg"""


add(
    "meta_impact", "I21", on_scored(lambda x: meta.meta_impact(x, "S")),
    (with_("scored"), f"""
select *, (orig_trades - gated_trades) * 100.0 / greatest(orig_trades, 1) as reduction_pct from (
select ticker, {_arm_sql('c * log_ret_1d', 'c', 'orig')}, {_arm_sql('gc * log_ret_1d', 'gc', 'gated')},
  coalesce(count(case when y = meta_pred then 1 end) / cast(nullif(count(y), 0) as double), 0) as gate_accuracy,
  coalesce(count(case when y = 1 and meta_pred = 1 then 1 end) / cast(nullif(count(case when y is not null and meta_pred = 1 then 1 end), 0) as double), 0) as gate_precision,
  coalesce(count(case when y = 1 and meta_pred = 1 then 1 end) / cast(nullif(count(case when y = 1 then 1 end), 0) as double), 0) as gate_recall
from (select *, case when gate = 0 then 0 else c end as gc from (
  select *, cast(coalesce(lag(pred_S) over w, 0) as double) as c, coalesce(lag(meta_pred) over w, 0) as gate,
    case when pred_S <> 0 and lead(log_ret_1d) over w is not null then cast(pred_S * lead(log_ret_1d) over w > 0 as int) end as y
  from scored where proba_S <> 0.5 window w as (partition by ticker order by dt)) a where log_ret_1d is not null) b group by ticker) z"""),
    keys="ticker", ints="orig_trades gated_trades",
    doubles="orig_sharpe orig_return orig_win_rate orig_avg gated_sharpe gated_return gated_win_rate gated_avg gate_accuracy gate_precision gate_recall reduction_pct",
)
add(
    "filter_rate", "I22", on_scored(lambda x: meta.filter_rate(x, "S")),
    (with_("scored"), """
select ticker, count(case when meta_pred = 0 then 1 end) as n_filtered, count(*) as n_predicted,
  count(case when meta_pred = 0 then 1 end) * 100.0 / cast(count(*) as double) as filter_rate from scored where proba_S <> 0.5 group by ticker"""),
    keys="ticker", ints="n_filtered n_predicted", doubles="filter_rate",
)

# --- signals ----------------------------------------------------------------------------------


def momentum(x: DataFrame, s: Series = DAILY) -> DataFrame:
    return signals.momentum_signal(x, s=s)


def reversion(x: DataFrame, s: Series = DAILY) -> DataFrame:
    return signals.mean_reversion_signal(x, s=s)


def model_signal(x: DataFrame) -> DataFrame:
    return signals.ml_signal(x, "S")


_MOM = (with_("scored", "mom"), "select ticker, dt, st as signal from scored join mom using (ticker, rn)")
_REV = (with_("scored", "rev"), "select ticker, dt, st as signal from scored join rev using (ticker, rn)")
add("momentum_signal", "J1", on_bars(momentum), _MOM, ints="signal")
add("momentum_signal_blocks", "J1", on_bars(lambda b: momentum(b, Series(block=1024, slot=100))), _MOM, ints="signal")
add("mean_reversion_signal", "J2", on_bars(lambda b: reversion(indicators.rsi(b))), _REV, ints="signal")
add(
    "ml_signal_proba", "J3", on_scored(lambda x: signals.ml_signal_proba(x, "S", shorts=True)),
    (with_("scored"), f"select *, {ml_size('proba_S', True)} as signal from scored"), doubles="signal",
)
add(
    "ml_signal_label", "J4", on_scored(lambda x: signals.ml_signal_label(x, "S", shorts=True)),
    (with_("scored"), "select *, case when pred_S > 0 then 1 else -1 end as signal from scored"), doubles="signal",
)
add(
    "regime_bias", "J5", on_scored(lambda x: signals.regime_bias(signals.ml_signal_proba(x, "S", shorts=True), True)),
    (with_("scored"), f"select *, {ml_biased(True)} as signal from (select *, {ml_size('proba_S', True)} as g from scored) x"),
    doubles="signal",
)
add(
    "meta_gate", "J6", on_scored(lambda x: signals.meta_gate(signals.ml_signal_label(x, "S"))),
    (with_("scored"), "select *, case when meta_pred = 0 then 0 when pred_S > 0 then 1 else 0 end as signal from scored"),
    doubles="signal",
)
add(
    "latest_target_weights", "J7",
    on_scored(lambda x: signals.latest_target_weights(x.withColumn("meta_pred", F.lit(1)), "T")),
    (with_("scored"), """
select ticker, raw / case when total > 0 then total else 1 end as weight
from (select *, sum(abs(raw)) over () as total from (
  select ticker, greatest(0, coalesce(0.5 * (2 * max_by(proba_T, dt) - 1), 0)) as raw from scored group by ticker) a) b"""),
    keys="ticker", doubles="weight",
)
add(
    "signal_counts", "J8", on_bars(lambda b: signals.signal_counts(momentum(b))),
    (with_("scored", "mom"), """
select ticker, count(case when st > 0 then 1 end) as n_long, count(case when st < 0 then 1 end) as n_short,
  count(case when st = 0 then 1 end) as n_flat from mom group by ticker"""),
    keys="ticker", ints="n_long n_short n_flat",
)

STRATEGIES = {"momentum": momentum, "reversion": reversion, "model": model_signal}


def panel(spark: SparkSession, d: str) -> DataFrame:
    df = indicators.rsi(pnl.asset_returns(scored(v.bars(spark, d))))
    return materialise(pf.strategy_panel(df, {**STRATEGIES, pf.BENCHMARK: pf.hold}), "panel")


add(
    "apply_strategies", "J9",
    lambda s, d: signals.apply_strategies(indicators.rsi(scored(v.bars(s, d))), STRATEGIES),
    (with_("panel"), "select * from panel where strategy <> 'Buy & Hold'"), keys="strategy ticker dt", doubles="signal",
)
add(
    "strategy_panel", "J9", panel, (with_("panel"), "select * from panel"),
    keys="strategy ticker dt", doubles="close volume asset_ret signal",
)

# --- risk -------------------------------------------------------------------------------------

KEYED = "strategy ticker dt"
_RULED = "where strategy <> 'Buy & Hold'"


def risky(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).filter(F.col("strategy") != pf.BENCHMARK).withColumn("position", F.col("signal"))


def targeted(spark: SparkSession, d: str) -> DataFrame:
    return risk.running_pnl(risk.vol_target(risky(spark, d), s=pf.PANEL), pf.PANEL)


add(
    "vol_target", "K1", lambda s, d: risk.vol_target(risky(s, d), s=pf.PANEL),
    (with_("risk1"), f"select *, p1 as position from risk1 {_RULED}"), keys=KEYED, doubles="position",
)
add(
    "running_pnl", "K2", targeted, (with_("risk4"), f"select * from risk4 {_RULED}"),
    keys=KEYED, doubles="pnl cum_ret peak drawdown",
)
add(
    "drawdown_guard", "K3", lambda s, d: risk.drawdown_guard(targeted(s, d), s=pf.PANEL),
    (with_("risk5"), f"select *, p3 as position from risk5 {_RULED}"), keys=KEYED, doubles="position",
)
add(
    "stop_loss", "K4", lambda s, d: risk.stop_loss(targeted(s, d), s=pf.PANEL),
    (with_("risk5"), f"select *, case when stopped then 0 else p1 end as position from risk5 {_RULED}"), keys=KEYED, doubles="position",
)
add(
    "clip_position", "K5", lambda s, d: risk.clip_position(risk.vol_target(risky(s, d), s=pf.PANEL)),
    (with_("risk1"), f"select *, case when p1 is not null then least(greatest(p1, -1), 1) end as position from risk1 {_RULED}"), keys=KEYED, doubles="position",
)
add(
    "apply_risk", "K6", lambda s, d: risk.apply_risk(risky(s, d), s=pf.PANEL),
    (with_("risk"), f"select * from risk {_RULED}"), keys=KEYED, doubles="position",
)

# --- allocation and hedging -------------------------------------------------------------------


def ruled(spark: SparkSession, d: str) -> DataFrame:
    return materialise(risk.apply_risk(risky(spark, d), s=pf.PANEL), "risk")


def weights(spark: SparkSession, d: str) -> DataFrame:
    return materialise(pf.allocated(panel(spark, d)), "weights")


add(
    "equal_weight", "L1", lambda s, d: allocate.equal_weight(ruled(s, d)),
    (with_("risk"), f"select *, position / (select count(distinct ticker) from bars5) as weight from risk {_RULED}"),
    keys=KEYED, doubles="weight",
)
add(
    "risk_parity", "L2", weights, (with_("parity"), "select * from parity"), keys=KEYED, doubles="weight",
)
add(
    "cross_sectional_topk", "L3", lambda s, d: allocate.cross_sectional_topk(ruled(s, d), pf.PANEL),
    (with_("risk"), f"""
select r.*, coalesce(1 / cast(k as double), 0) as weight from risk r left join (
  select *, case when n < 3 then n else n // 2 end as k from (
    select strategy, ticker, dt, count(*) over (partition by strategy, dt) as n,
      row_number() over (partition by strategy, dt order by position desc, ticker) as rk
    from risk where position > 0) a where rk <= case when n < 3 then n else n // 2 end) c using (strategy, ticker, dt) {_RULED}"""),
    keys=KEYED, doubles="weight",
)


def portfolio(spark: SparkSession, d: str, impact: bool = True) -> DataFrame:
    w = weights(spark, d)
    return materialise(pnl.portfolio_returns(pf.executed(w, impact=impact), ("strategy",), universe=w), "portfolio")


_CVAR = "select strategy, {agg} from (select *, quantile_cont(ret, 0.05) over (partition by strategy) as cut from pf_flat) x group by strategy"
add(
    "portfolio_cvar", "L5", lambda s, d: allocate.portfolio_cvar(portfolio(s, d, False), s=pf.PORTFOLIO),
    (with_("pf_flat"), _CVAR.format(agg="-avg(case when ret <= cut then ret end) as cvar")), keys="strategy", doubles="cvar",
)


def market(spark: SparkSession, d: str) -> DataFrame:
    return pf.market_returns(v.bars(spark, d, "market"))


def betas(spark: SparkSession, d: str) -> DataFrame:
    return hedge.rolling_beta(pnl.asset_returns(v.bars(spark, d)), market(spark, d))


add("rolling_beta", "L6", betas, (with_("beta"), "select * from beta"), doubles="beta")
add(
    "alpha_decomposition", "L7", lambda s, d: hedge.alpha_decomposition(betas(s, d), market(s, d)),
    (with_("beta"), "select *, beta * coalesce(market_ret, 0) as beta_component, asset_ret - beta * coalesce(market_ret, 0) as alpha from beta left join mkt using (dt)"),
    doubles="asset_ret beta beta_component alpha",
)
add(
    "alpha_share", "L7", lambda s, d: pf.hedge_summary(portfolio(s, d), market(s, d)),
    (with_("pf", "mkt"), f"""
select strategy, avg(beta) as avg_beta, case when sum(ret) <> 0 then sum(ret - beta * coalesce(market_ret, 0)) / sum(ret) * 100 else 0 end as alpha_pct
from (select strategy, dt, ret, market_ret, coalesce({pair('covar_samp', 'ret', 'market_ret', 60, 60, 'strategy')} / ({roll('var_samp', 'market_ret', 60, 60, 'strategy')} + {EPS}), 1) as beta
  from pf join mkt using (dt)) b group by strategy"""),
    keys="strategy", doubles="avg_beta alpha_pct:4",
)
add(
    "beta_hedge", "L8", lambda s, d: hedge.beta_hedge(weights(s, d), betas(s, d), ("strategy",)),
    (with_("hedge"), "select * from hedge"), keys="strategy dt", doubles="hedge",
)


def _neutral(spark: SparkSession, d: str) -> DataFrame:
    w = weights(spark, d).filter(F.col("strategy") != pf.BENCHMARK)
    plain = pnl.portfolio_returns(pf.executed(w), ("strategy",), universe=w)
    return pf.hedged(plain, w, pnl.asset_returns(v.bars(spark, d)), market(spark, d))


add("hedged_returns", "L9", _neutral, (with_("neutral"), "select * from neutral"), keys="strategy dt", doubles="ret")
add(
    "rebased_prices", "L10", on_bars(allocate.rebased_prices),
    (with_("bars5"), """
select *, avg(rebased) over (partition by dt) as index_value from (
  select ticker, dt, close / first_value(close) over (partition by ticker order by dt) * 100 as rebased from bars5
  where dt in (select dt from bars5 group by dt having count(close) = (select count(distinct ticker) from bars5))) x"""),
    doubles="rebased index_value",
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    b = v.bars(spark, d)
    target = signals.latest_target_weights(scored(b).withColumn("meta_pred", F.lit(1)), "T")
    prices = b.groupBy("ticker").agg(F.max_by("close", "dt").alias("price"), F.count("dt").alias("_n"))
    held = prices.select("ticker", (F.pmod("_n", F.lit(90)) * 10).cast("double").alias("qty"))
    gone = held.limit(0).unionByName(held.agg(F.lit("SOLD OUT").alias("ticker"), F.min("qty").alias("qty")))
    return allocate.order_deltas(target, held.unionByName(gone), prices, 100_000.0)


add(
    "order_deltas", "L11", _orders,
    (with_("scored") + """
, w as (select ticker, raw / case when total > 0 then total else 1 end as weight from (select *, sum(abs(raw)) over () as total from (
  select ticker, greatest(0, coalesce(0.5 * (2 * max_by(proba_T, dt) - 1), 0)) as raw from scored group by ticker) a) b),
p as (select ticker, max_by(close, dt) as price, (count(*) % 90) * 10 as qty from bars5 group by ticker),
h as (select ticker, qty from p union all select 'SOLD OUT', min(qty) from p),
o as (select coalesce(w.ticker, h.ticker) as ticker,
  case when weight is null or weight = 0 then 0 else floor(100000 * weight / price) end - coalesce(h.qty, 0) as diff
  from w full join h using (ticker) left join p on p.ticker = coalesce(w.ticker, h.ticker))""",
     """select ticker, case when diff > 0 then 'buy' else 'sell' end as side, cast(floor(abs(diff)) as bigint) as qty from o where abs(diff) >= 1"""),
    keys="ticker side", ints="qty",
)

# --- costs ------------------------------------------------------------------------------------


def executed(spark: SparkSession, d: str) -> DataFrame:
    return pf.executed(weights(spark, d))


add(
    "liquidity_profile", "M1", on_bars(costs.liquidity_profile),
    (with_("base"), f"""
select *, 0.15 * vol * close as spread from (select *, avg(close * volume) over {frame(20)} as adv,
  greatest(coalesce(stddev_samp(log_ret_1d) over {frame(20)} * {ANN}, 0.2), 0.01) as vol from base) x"""),
    doubles="adv vol spread",
)


def thin(spark: SparkSession, d: str) -> DataFrame:
    """Momentum positions in a market so thin that many orders hit the volume cap."""
    b = v.bars(spark, d).withColumn("volume", F.round(F.col("volume") / 3.0, 0))
    df = pnl.positions_from_signals(momentum(b), out="target")
    return costs.impact_cost(costs.adv_cap(costs.liquidity_profile(df)))


from tidepanel.catalog.oracle import capped, cte  # noqa: E402

cte(
    "thin_src", ["base", "mom"],
    "select ticker, dt, close, round(volume / 3.0, 0) as volume, cast(coalesce(lag(st) over (partition by ticker order by dt), 0) as double) as target from base join mom using (ticker, rn)",
)
capped("thin", "select * from thin_src", ["thin_src"], ["ticker"])
add(
    "adv_cap", "M2", thin, (with_("thin"), "select * from thin"), keys="ticker dt capped", doubles="target position change",
)
add("impact_cost", "M3", thin, (with_("thin"), "select * from thin"), doubles="exec_cost:8 slippage:8")
_STATS = """
select ticker, count(case when traded then 1 end) as total_changes, count(case when capped then 1 end) as orders_capped,
  coalesce(sum(case when traded then slippage * 10000 end), 0) as total_slippage_bps,
  coalesce(count(case when capped then 1 end) / cast(nullif(count(case when traded then 1 end), 0) as double), 0) as pct_capped,
  coalesce(avg(case when traded then slippage * 10000 end), 0) as avg_slippage_bps from thin group by ticker"""
add(
    "execution_stats", "M4", lambda s, d: costs.execution_stats(thin(s, d)), (with_("thin"), _STATS),
    keys="ticker", ints="total_changes orders_capped", doubles="total_slippage_bps:4 pct_capped avg_slippage_bps",
)

# --- returns from positions -------------------------------------------------------------------


def held(b: DataFrame, s: Series = DAILY) -> DataFrame:
    return pnl.positions_from_signals(momentum(pnl.asset_returns(b, s=s), s), s=s)


cte("held", ["base", "mom"], "select ticker, dt, close, asset_ret, cast(coalesce(lag(st) over (partition by ticker order by dt), 0) as double) as position from base join mom using (ticker, rn)")
cte("flat1", ["held"], f"select *, position * asset_ret - abs(coalesce(position - {lag('position')}, 0)) * 0.001 as ret from held")
add("positions_from_signals", "N1", on_bars(held), (with_("held"), "select * from held"), doubles="position asset_ret")
add(
    "net_returns_flat", "N2", on_bars(lambda b: pnl.net_returns_flat(held(b))),
    (with_("flat1"), "select * from flat1"), doubles="ret:8",
)
add(
    "net_returns_impact", "N3", executed, (with_("netted"), "select * from netted"),
    keys="strategy ticker dt", doubles="position ret:8 exec_cost:8",
)
add(
    "equity_curve", "N4", on_bars(lambda b: pnl.equity_curve(pnl.net_returns_flat(held(b)))),
    (with_("flat1"), f"select *, 100000 * product(1 + ret) over {frame(None)} as equity from flat1"), doubles="equity:4",
)
_TRADES = f"""
select ticker, entry_dt, exit_dt, direction, entry_price, exit_price, 100000 / (entry_price + 1e-10) as shares, r as return_pct,
  100000 / (entry_price + 1e-10) * entry_price * r as pnl, 100000 / (entry_price + 1e-10) * entry_price * 0.002 as cost
from (select *, direction * (exit_price / entry_price - 1) - 0.002 as r from (
  select ticker, tid, min(dt) as entry_dt, min_by(close, dt) as entry_price, max(position) as direction,
    max_by(coalesce(ndt, dt), dt) as exit_dt, max_by(coalesce(ncl, close), dt) as exit_price
  from (select *, sum(st) over {frame(None)} as tid from (
    select *, cast(position <> 0 and position <> coalesce({lag('position')}, 0) as int) as st,
      lead(dt) over (partition by ticker order by dt) as ndt, lead(close) over (partition by ticker order by dt) as ncl from held) a) b
  where position <> 0 group by ticker, tid) c) e"""
add(
    "trades", "N5", on_bars(lambda b: pnl.trades(held(b))), (with_("held"), _TRADES),
    keys="ticker entry_dt exit_dt", doubles="direction entry_price exit_price shares return_pct pnl:4 cost:4",
)
add(
    "benchmark_buy_hold", "N6", on_bars(lambda b: pnl.benchmark_buy_hold(pnl.asset_returns(b))),
    (with_("base"), """
select *, case when rn = 1 then 0 else asset_ret end - case when rn = 2 then 0.001 else 0 end as ret from base"""),
    doubles="ret:8",
)
add("portfolio_returns", "N7", portfolio, (with_("pf"), "select * from pf"), keys="strategy dt", doubles="ret:8")
add(
    "portfolio_returns_all_dates", "N7",
    lambda s, d: pnl.portfolio_returns(pf.executed(weights(s, d), impact=False), ("strategy",), missing="zero"),
    (with_("flatted"), "select strategy, dt, sum(ret) as ret from flatted group by strategy, dt"), keys="strategy dt", doubles="ret:8",
)


def _run(spark: SparkSession, d: str) -> DataFrame:
    df = indicators.rsi(scored(v.bars(spark, d)))
    return pf.portfolio_run(df, market(spark, d), STRATEGIES)


REPORT_KEYS = "start_date end_date"
add(
    "portfolio_run", "N8", _run,
    (with_("pf", "neutral"), report_sql("select strategy, dt, ret from pf union all select strategy, dt, ret from neutral", "strategy", False)),
    keys=f"strategy {REPORT_KEYS}", ints=REPORT_INTS, doubles=REPORT_DOUBLES, digits=5,
)
_FOLDED = f"""
, folds as ({_CALENDAR}),
slice as (select f.fold, s.ticker, s.dt, s.close, s.rolling_ret_21d as m, row_number() over (partition by f.fold, s.ticker order by s.dt) as k
  from scored s join folds f on s.dt between f.test_start and f.test_end),
walk as (select fold, ticker, k, case when m > 0.02 then 1 when m < -0.02 then -1 else 0 end as st from slice where k = 1
  union all select b.fold, b.ticker, b.k, case when m is null then 0
    when e.st = 0 then case when m > 0.02 then 1 when m < -0.02 then -1 else 0 end
    when e.st = 1 then case when m < -0.01 then 0 else 1 end else case when m > 0.01 then 0 else -1 end end
  from walk e join slice b on b.fold = e.fold and b.ticker = e.ticker and b.k = e.k + 1),
walked as (select *, position * ar - abs(coalesce(position - lag(position) over (partition by fold, ticker order by dt), 0)) * 0.001 as ret from (
  select fold, ticker, dt, cast(coalesce(lag(st) over (partition by fold, ticker order by dt), 0) as double) as position,
    coalesce(close / lag(close) over (partition by fold, ticker order by dt) - 1, 0) as ar from slice join walk using (fold, ticker, k)) a)"""
def _folds(spark: SparkSession, d: str) -> DataFrame:
    # the momentum column comes from the full history, the positions restart in each fold
    full = returns.rolling_returns(v.bars(spark, d), (21,))
    s = Series(keys=("fold", "ticker"))
    return pf.walk_forward_reports(full, lambda x: momentum(x, s))


add(
    "walk_forward_reports", "N9", _folds,
    (with_("scored") + _FOLDED, report_sql("select * from walked", "fold, ticker", True)),
    keys=f"ticker {REPORT_KEYS}", ints=f"fold {REPORT_INTS}", doubles=REPORT_DOUBLES, digits=5,
)
add(
    "equity_snapshot", "N10", on_bars(lambda b: pnl.equity_snapshot(pnl.equity_curve(pnl.net_returns_flat(held(b))))),
    (with_("flat1"), f"""
select *, equity / first_value(first_eq) over (partition by ticker order by quarter) - 1 as cum_return from (
  select ticker, cast(date_trunc('quarter', dt) as date) as quarter, max_by(equity, dt) as equity, max(dt) as last_dt, min_by(equity, dt) as first_eq
  from (select *, 100000 * product(1 + ret) over {frame(None)} as equity from flat1) e group by 1, 2) q"""),
    keys="ticker quarter last_dt", doubles="equity:4 cum_return",
)
_BOTH = "select 'flat' as mode, strategy, dt, ret from pf_flat union all select 'impact' as mode, strategy, dt, ret from pf"
add(
    "cost_model_comparison", "N11", lambda s, d: pf.cost_model_comparison(weights(s, d)),
    (with_("pf", "pf_flat") + f", rep as ({report_sql(_BOTH, 'mode, strategy', False)})",
     f"select a.strategy, {', '.join(f'a.{c} as flat_{c}, b.{c} as impact_{c}, b.{c} - a.{c} as delta_{c}' for c in pf.COMPARED)} from rep a join rep b using (strategy) where a.mode = 'flat' and b.mode = 'impact'"),
    keys="strategy", doubles=" ".join(f"flat_{c} impact_{c} delta_{c}" for c in pf.COMPARED), digits=5,
)
_LEVELS = " union all ".join(
    f"select '{name}' as cost_level, strategy, dt, sum(position * asset_ret - exec_cost - abs(pc) * {rate} / 2) as ret from netted group by strategy, dt having count(ret) = (select count(distinct ticker) from bars5)"
    for name, rate in pf.SENSITIVITY.items()
)
add(
    "cost_sensitivity", "N12", lambda s, d: pf.cost_sensitivity(weights(s, d)),
    (with_("netted", "bars5"), report_sql(_LEVELS, "cost_level, strategy", False)),
    keys="cost_level strategy", doubles="cagr sharpe_ratio max_drawdown total_return", digits=5,
)


def _relative(spark: SparkSession, d: str) -> DataFrame:
    reports = materialise(metrics.performance_report(portfolio(spark, d, False), pf.PORTFOLIO, positions=False), "reports")
    base = F.col("strategy") == pf.BENCHMARK
    return pnl.relative_to_benchmark(reports.filter(~base), reports.filter(base))


add(
    "relative_to_benchmark", "N13", _relative,
    (with_("pf_flat") + f", rep as ({report_sql('select * from pf_flat', 'strategy', False)})", """
select a.strategy, a.cagr, a.cagr - b.cagr as alpha_ann, case when a.annualized_volatility > 1e-8 then (a.cagr - b.cagr) / a.annualized_volatility else 0 end as info_ratio
from rep a, rep b where a.strategy <> 'Buy & Hold' and b.strategy = 'Buy & Hold'"""),
    keys="strategy", doubles="cagr alpha_ann info_ratio",
)

# --- metrics ----------------------------------------------------------------------------------


def netted(b: DataFrame) -> DataFrame:
    return pnl.net_returns_flat(held(b))


_REP1 = with_("flat1") + f", rep as ({report_sql('select * from flat1', 'ticker', True)})"


def metric(name: str, ids: str, doubles: str = "", ints: str = "") -> None:
    add(
        name, ids, on_bars(lambda b: metrics.performance_report(netted(b))), (_REP1, "select * from rep"),
        keys="ticker", doubles=doubles, ints=ints,
    )


metric("total_return_cagr", "O1", "total_return cagr")
metric("annualised_vol", "O2", "annualized_volatility")
metric("sharpe", "O3", "sharpe_ratio")
metric("sortino", "O4", "sortino_ratio")
metric("max_drawdown", "O5", "max_drawdown")
metric("max_drawdown_duration", "O6", ints="max_drawdown_duration_days")
metric("calmar", "O7", "calmar_ratio")
add(
    "trade_stats", "O8", on_bars(lambda b: metrics.trade_stats(netted(b))), (_REP1, "select * from rep"),
    keys="ticker", ints="total_trades", doubles="win_rate profit_factor avg_trade_return",
)
add(
    "daily_stats", "O9", on_bars(lambda b: metrics.daily_stats(netted(b))),
    (with_("flat1"), report_sql("select * from flat1", "ticker", False)),
    keys="ticker", ints="total_trades", doubles="win_rate profit_factor avg_trade_return",
)
add(
    "performance_report", "O10", on_bars(lambda b: metrics.performance_report(netted(b))), (_REP1, "select * from rep"),
    keys=f"ticker {REPORT_KEYS}", ints=REPORT_INTS, doubles=REPORT_DOUBLES,
)
add(
    "performance_report_blocks", "O10",
    on_bars(lambda b: metrics.performance_report(pnl.net_returns_flat(held(b, BLOCKS), s=BLOCKS), BLOCKS)),
    (_REP1, "select * from rep"), keys=f"ticker {REPORT_KEYS}", ints=REPORT_INTS, doubles=REPORT_DOUBLES,
)
add(
    "historical_var_cvar", "O11", on_bars(lambda b: metrics.historical_var_cvar(netted(b))),
    (with_("flat1"), """
select ticker, min(cut) as var_value, case when stddev_samp(ret) < 1e-10 then 0 else avg(case when ret <= cut then ret end) end as cvar_value
from (select *, quantile_cont(ret, 0.05) over (partition by ticker) as cut from flat1) x group by ticker"""),
    keys="ticker", doubles="var_value cvar_value",
)
_TAIL = f"""
select ticker, min(lo) as var_5pct, avg(case when ret <= lo then ret end) as cvar_5pct, min(ret) as worst_day, coalesce(min(five), 0) as worst_5d,
  case when abs(avg(case when ret <= lo then ret end)) > 1e-10 then avg(case when ret >= hi then ret end) / abs(avg(case when ret <= lo then ret end)) else 0 end as tail_ratio,
  skewness(ret) as skewness, kurtosis(ret) as kurtosis
from (select *, quantile_cont(ret, 0.05) over (partition by ticker) as lo, quantile_cont(ret, 0.95) over (partition by ticker) as hi,
  {roll('sum', 'ret', 5, 5)} as five from flat1) x group by ticker"""
TAIL_DOUBLES = "var_5pct cvar_5pct worst_day worst_5d tail_ratio skewness kurtosis"
add("tail_stats", "O12", on_bars(lambda b: metrics.tail_stats(netted(b))), (with_("flat1"), _TAIL), keys="ticker", doubles=TAIL_DOUBLES)
add(
    "series_summary", "O14", on_bars(metrics.series_summary),
    (with_("base"), f"""
select ticker, min(dt) as start_date, max(dt) as end_date, count(*) as bars, max_by(close, dt) / min_by(close, dt) - 1 as total_return,
  stddev_samp(sret) * {ANN} as ann_vol, avg(sret) / (stddev_samp(sret) + {EPS}) * {ANN} as sharpe from base group by ticker"""),
    keys="ticker start_date end_date", ints="bars", doubles="total_return ann_vol sharpe",
)


def _trend(spark: SparkSession, d: str) -> DataFrame:
    df = pnl.positions_from_signals(signals.trend_signal(pnl.asset_returns(v.bars(spark, d))))
    return metrics.performance_report(pnl.net_returns_flat(df))


_TREND = f"""
select *, position * asset_ret - abs(coalesce(position - {lag('position')}, 0)) * 0.001 as ret from (
  select *, coalesce(lag(g) over (partition by ticker order by dt), 0) as position from (
    select *, coalesce(cast(sign(close - {roll('avg', 'close', 20, 20)}) as double), 0) as g from base) a) b"""
add(
    "trend_report", "D1 C1 N1 N2 N4 O10", _trend,
    (with_("base"), report_sql(_TREND, "ticker", True)), keys=f"ticker {REPORT_KEYS}", ints=REPORT_INTS, doubles=REPORT_DOUBLES,
)

# --- robustness -------------------------------------------------------------------------------

_MODEL = f"""
, mp as (select *, abs(position - coalesce({lag('position')}, 0)) as change, position * coalesce(sret, 0) as gross from (
  select *, cast(coalesce(lag(case when pred_S = 1 then 1 else -1 end) over (partition by ticker order by dt), 0) as double) as position from scored) a)"""
_STRESS = " union all ".join(
    f"select '{k}' as cost_level, ticker, dt, gross - change * {c} as ret from mp" for k, c in robust.COSTS.items()
)
_STRESS_SQL = f"""
select cost_level, ticker, tr as total_return, case when tr > -1 then pow(1 + tr, 1 / greatest(n / cast(252 as double), 0.01)) - 1 else -1 end as cagr,
  case when sd > 1e-8 then m / sd * {ANN} else 0 end as sharpe, dd as max_drawdown
from (select cost_level, ticker, product(1 + ret) - 1 as tr, count(*) as n, avg(ret) as m, stddev_pop(ret) as sd, min(g / p - 1) as dd
  from (select *, max(g) over {frame(None, 'cost_level, ticker')} as p from (
    select *, product(1 + ret) over {frame(None, 'cost_level, ticker')} as g from ({_STRESS}) s) t) u group by cost_level, ticker) w"""
add(
    "cost_stress", "P4", on_scored(lambda x: robust.cost_stress(x, "pred_S")), (with_("scored") + _MODEL, _STRESS_SQL),
    keys="cost_level ticker", doubles="total_return cagr sharpe max_drawdown",
)
_OUT = f"""
, rk as (select *, row_number() over (partition by ticker order by gross desc, dt) as t, row_number() over (partition by ticker order by gross, dt) as b from mp),
od as (select *, abs(f - nb) / (abs(f) + 1e-10) as collapse from (
  select ticker, {', '.join(f'case when stddev_pop({x}) > 1e-8 then avg({x}) / stddev_pop({x}) * {ANN} else 0 end as {n}' for x, n in (('gross', 'f'), ('case when t > 5 then gross end', 'nb'), ('case when b > 5 then gross end', 'nw')))}
  from rk group by ticker) a)"""
_OUT_SQL = "select ticker, f as sharpe_full, nb as sharpe_no_best, nw as sharpe_no_worst, collapse, case when collapse > 0.5 then 'OUTLIER_DEPENDENT' when collapse > 0.25 then 'MODERATE' else 'ROBUST' end as verdict from od"
add(
    "outlier_dependence", "P5", on_scored(lambda x: robust.outlier_dependence(x, "pred_S")),
    (with_("scored") + _MODEL + _OUT, _OUT_SQL), keys="ticker verdict", doubles="sharpe_full sharpe_no_best sharpe_no_worst collapse",
)


def _facts(x: DataFrame) -> DataFrame:
    stress = robust.cost_resilience(robust.cost_stress(x, "pred_S"))
    outliers = robust.outlier_dependence(x, "pred_S").select("ticker", F.col("verdict").alias("outlier_verdict"))
    thirds = splits.chronological_thirds(x)
    acc = meta.classification_report(thirds, "S", ("ticker", "period")).groupBy("ticker").agg(
        F.max(F.when(F.col("period") == "Early", F.col("accuracy"))).alias("acc_early"),
        F.max(F.when(F.col("period") == "Late", F.col("accuracy"))).alias("acc_late"),
    )
    full = meta.classification_report(x, "S", ("ticker",)).select("ticker", F.col("accuracy").alias("acc_full"))
    other = meta.classification_report(x, "T", ("ticker",)).select("ticker", F.col("accuracy").alias("acc_random"))
    facts = stress.select("ticker", "sharpe_medium", "sharpe_high").join(outliers, "ticker").join(acc, "ticker")
    facts = facts.join(full, "ticker").join(other, "ticker")
    shuffle = robust.shuffle_verdict(F.col("acc_full"), F.col("acc_random"))
    return robust.robustness_verdict(facts.withColumn("shuffle_verdict", shuffle))


def _acc(model: str, where: str, name: str) -> str:
    return f"""{name} as (select x.ticker, avg(cast(pred_{model} = target_direction as int)) as a from scored x join gs using (ticker, dt)
  where proba_{model} <> 0.5 and target_direction is not null and {where} group by x.ticker)"""


_VERDICT = f""", stress as ({_STRESS_SQL}),
gs as (select ticker, dt, row_number() over (order by dt, ticker) - 1 as g, count(*) over () as n from scored),
{_acc('S', 'g < n // 3', 'ae')}, {_acc('S', 'g >= 2 * (n // 3)', 'al')}, {_acc('S', 'true', 'af')}, {_acc('T', 'true', 'ar')},
facts as (select o.ticker, ae.a < 0 as z, ae.a as acc_early, al.a as acc_late, af.a as acc_full, ar.a as acc_random,
  sm.sharpe as sharpe_medium, sh.sharpe as sharpe_high,
  case when collapse > 0.5 then 'OUTLIER_DEPENDENT' when collapse > 0.25 then 'MODERATE' else 'ROBUST' end as ov,
  case when abs(ar.a - 0.5) > 0.8 * abs(af.a - 0.5) then 'FAIL' when ar.a > 0.52 then 'WARN' else 'PASS' end as shuffle_verdict
  from od o join ae using (ticker) join al using (ticker) join af using (ticker) join ar using (ticker)
  join stress sm on sm.ticker = o.ticker and sm.cost_level = '0.5%' join stress sh on sh.ticker = o.ticker and sh.cost_level = '2.0%')
select *, case when shuffle_verdict = 'FAIL' then 'OVERFITTED / LEAKAGE RISK' when n_issues >= 3 then 'WEAK' when n_issues >= 2 then 'MODERATE'
    when n_issues = 1 then 'ROBUST (Minor Concerns)' else 'ROBUST' end as rating,
  case when shuffle_verdict = 'FAIL' or n_issues >= 3 then 'Low' when n_issues >= 2 then 'Medium' when n_issues = 1 then 'Medium-High' else 'High' end as confidence
from (select *, cast(acc_late < acc_early - 0.03 as int) + cast(acc_random < acc_full - 0.05 as int) + cast(shuffle_verdict <> 'PASS' as int)
  + cast(sharpe_medium <= 0 or sharpe_high <= 0 as int) + cast(ov <> 'ROBUST' as int) as n_issues from facts) y"""
_PRE, _LAST = _VERDICT.rsplit("\nselect *, case when shuffle_verdict", 1)
add(
    "robustness_verdict", "P6", on_scored(_facts),
    (with_("scored") + _MODEL + _OUT + _PRE, "select *, case when shuffle_verdict" + _LAST),
    keys="ticker shuffle_verdict rating confidence", ints="n_issues", doubles="acc_early acc_late acc_full acc_random",
)

# --- data quality -----------------------------------------------------------------------------


def _seq(spark: SparkSession, d: str) -> DataFrame:
    # orders in key order: dates repeat and run back and forth
    o = v.table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"), F.col("o_orderkey").alias("seq"))


add(
    "check_ordering", "Q1", lambda s, d: quality.check_ordering(_seq(s, d)),
    ("", """
select ticker, count(*) as n_rows, count(*) - count(distinct dt) as n_repeated, count(case when dt < prev then 1 end) as n_backward,
  cast(count(*) = count(distinct dt) and count(case when dt < prev then 1 end) = 0 as int) as ordered
from (select *, lag(dt) over (partition by ticker order by o_orderkey) as prev from (
  select o_orderpriority as ticker, cast(o_orderdate as date) as dt, o_orderkey from orders) o) x group by ticker"""),
    keys="ticker", ints="n_rows n_repeated n_backward ordered",
)
_NULLS = ["open", "high", "low", "close", "volume"]
add(
    "null_scan", "Q2", lambda s, d: quality.null_scan(v.dirty(s, d), _NULLS),
    (with_("dirty"), "select * from (" + " union all ".join(f"select ticker, '{c}' as feature, count(*) - count({c}) as n_null from dirty group by ticker" for c in _NULLS) + ") n where n_null > 0"),
    keys="ticker feature", ints="n_null",
)
add(
    "worst_features", "Q2", on_bars(lambda b: quality.worst_features(quality.null_scan(indicators.sma(b), [f"sma_{w}" for w in indicators.SMA_WINDOWS]))),
    (with_("feats"), "select * from (" + " union all ".join(f"select 'sma_{w}' as feature, count(*) - count(sma_{w}) as n_null from feats" for w in indicators.SMA_WINDOWS) + ") n order by n_null desc limit 3"),
    keys="feature", ints="n_null",
)
add(
    "target_audit", "Q3", on_scored(quality.target_audit),
    (with_("scored"), "select count(*) as n_rows, count(target_direction) as n_labels, 1 - count(target_direction) / cast(count(*) as double) as null_share, cast(count(target_direction) >= 100 as int) as enough from scored"),
    keys="", ints="n_rows n_labels enough", doubles="null_share",
)
_LEAKY = ["zscore_20", "target_direction", "pred_S", "meta_pred"]
add(
    "leak_audit", "Q4", on_scored(lambda x: quality.leak_audit(x, _LEAKY)),
    (with_("scored"), " union all ".join(f"select '{c}' as name, count({c}) as n_known from scored" for c in _LEAKY[1:])),
    keys="name", ints="n_known",
)
add(
    "calendar_overlap", "Q5", on_bars(lambda b: quality.calendar_overlap(b, "5-LOW")),
    (with_("bars5"), """
select ticker, common, n_dates, common / cast(greatest(n_dates, base) as double) as overlap, cast(common / cast(greatest(n_dates, base) as double) >= 0.8 as int) as aligned
from (select ticker, count(*) as n_dates, count(case when dt in (select dt from bars5 where ticker = '5-LOW') then 1 end) as common,
  (select count(*) from bars5 where ticker = '5-LOW') as base from bars5 group by ticker) x"""),
    keys="ticker", ints="common n_dates aligned", doubles="overlap",
)


def _probe(spark: SparkSession, d: str) -> DataFrame:
    """The full feature table, and a column of next closes that must be reported."""
    bars, cut = v.bars(spark, d), "1996-01-01"
    ahead = F.lead("close").over(Window.partitionBy("ticker").orderBy("dt"))

    def build(b: DataFrame) -> DataFrame:
        return assemble.build_features(b, v.macro(spark, d), v.LABELS)

    columns = assemble.feature_columns(build(bars.limit(0)))
    parts = {
        "features": quality.lookahead_probe(build, bars, cut, columns),
        "next_close": quality.lookahead_probe(lambda b: b.withColumn("next_close", ahead), bars, cut, ["next_close"]),
    }
    found = [df.select("ticker", "dt", F.lit(name).alias("source")) for name, df in parts.items()]
    return found[0].unionByName(found[1])


add(
    "lookahead_probe", "Q6", _probe,
    (with_("bars5"), """
select ticker, dt, 'next_close' as source
from (select ticker, dt, lead(dt) over w as next_dt, lead(close) over w as next_close from bars5 window w as (partition by ticker order by dt)) n
where dt < date '1996-01-01' and next_dt >= date '1996-01-01' and next_close <> 0"""),
    keys="ticker dt source",
)
add(
    "return_invariants", "Q7", lambda s, d: quality.return_invariants(executed(s, d), by=("strategy",)),
    (with_("netted"), """
select b.*, w.weights_above_one
from (select strategy, count(case when exec_cost <> 0 and not traded then 1 end) as cost_without_change,
  count(case when abs(position) > 1 + 1e-9 then 1 end) as position_beyond_one from netted group by strategy) b
join (select strategy, count(case when held > 1 + 1e-9 then 1 end) as weights_above_one
  from (select strategy, dt, sum(abs(position)) as held from netted group by strategy, dt) h group by strategy) w on w.strategy = b.strategy"""),
    keys="strategy", ints="cost_without_change position_beyond_one weights_above_one",
)
