"""The same computations as plain SQL (common table expressions), used to check the queries."""

from __future__ import annotations

from tidepanel.catalog.views import BARS_SQL, DIRTY_SQL, KEYS

EPS = "1e-10"
ANN = "sqrt(cast(252 as double))"


def frame(k: int | None, by: str = "ticker", order: str = "dt") -> str:
    start = "unbounded" if k is None else str(k - 1)
    return f"(partition by {by} order by {order} rows between {start} preceding and current row)"


def roll(fn: str, col: str, k: int, p: int, by: str = "ticker") -> str:
    w = frame(k, by)
    arg = col if fn != "count" else col
    return f"case when count({col}) over {w} >= {p} then {fn}({arg}) over {w} end"


def pair(fn: str, a: str, b: str, k: int, p: int, by: str = "ticker") -> str:
    w = frame(k, by)
    return (
        f"case when count(case when {a} is not null and {b} is not null then 1 end) over {w} >= {p} "
        f"then {fn}({a}, {b}) over {w} end"
    )


def lag(col: str, k: int = 1, by: str = "ticker") -> str:
    return f"lag({col}, {k}) over (partition by {by} order by dt)"


def flag(cond: str) -> str:
    return f"cast(coalesce({cond}, false) as int)"


SMA = (5, 10, 20, 50, 200)
VOLS = (5, 10, 20, 63)

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def with_(*names: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in done:
        body = CTES[n][1].strip()
        recursive = f" {n} " in body and "union all" in body
        parts.append(f"{n} as {'' if recursive else 'materialized '}({body})")
    return "with recursive " + ",\n".join(parts)


for view, key in KEYS.items():
    if view == "macro":
        cte("macro", [], "select ticker as label, * exclude (ticker) from (" + BARS_SQL.format(key=key) + ") m")
    else:
        cte(view, [], BARS_SQL.format(key=key))
cte("dirty", ["bars5"], DIRTY_SQL.replace("{bars5}", "bars5"))

cte(
    "base",
    ["bars5"],
    f"""
select *, ln(close / pc) as log_ret_1d, close / pc - 1 as sret, coalesce(close / pc - 1, 0) as asset_ret,
  greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
  case when close - pc > 0 then close - pc when pc is not null then cast(0 as double) end as up,
  case when close - pc < 0 then pc - close when pc is not null then cast(0 as double) end as down
from (select *, row_number() over (partition by ticker order by dt) as rn, {lag('close')} as pc from bars5) b
""",
)

_level1 = (
    [f"{roll('avg', 'close', w, w)} as sma_{w}" for w in SMA]
    + [f"{roll('stddev_samp', 'close', w, w)} as std_{w}" for w in SMA]
    + [f"{roll('stddev_samp', 'log_ret_1d', n, n)} as sd_{n}" for n in (5, 10, 20, 21, 60, 63)]
    + [f"{roll('avg', 'log_ret_1d', n, n)} as me_{n}" for n in (5, 10, 20, 60, 63)]
    + [f"{roll('skewness', 'log_ret_1d', n, n)} as ret_skew_{n}d" for n in VOLS]
    + [f"ln(close / {lag('close', n)}) as log_ret_{n}d" for n in (5, 21)]
    + [f"{lag('log_ret_1d', k)} as log_ret_1d_lag_{k}" for k in (1, 2, 3, 5)]
    + [f"close / {lag('close', n)} - 1 as rolling_ret_{n}d" for n in (5, 10, 21, 63)]
    + [
        f"case when {lag('volume')} <> 0 then volume / {lag('volume')} - 1 end as volume_change_pct",
        f"volume / ({roll('avg', 'volume', 20, 10)} + {EPS}) as relative_volume",
        f"sum(sign(close - pc) * volume) over {frame(None)} as obv",
        f"{roll('max', 'close', 252, 63)} as peak",
        "lead(close, 1) over (partition by ticker order by dt) / close - 1 as target_fwd_return",
        "lead(log_ret_1d, 1) over (partition by ticker order by dt) as next_ret",
    ]
)
cte("roll1", ["base"], "select *, " + ",\n  ".join(_level1) + "\nfrom base")

cte(
    "roll2",
    ["roll1"],
    f"""
select *, sd_21 * {ANN} as regime_volatility, {roll('avg', 'obv', 63, 21)} as obv_mean,
  {roll('stddev_samp', 'obv', 63, 21)} as obv_std,
  case when count(sd_21) over {frame(252)} >= 63 then avg(sd_21) over {frame(252)} end * {ANN} as vol_mean,
  {lag('sma_50', 5)} as sma_before
from roll1
""",
)

_feats = (
    [f"(close - sma_{w}) / (std_{w} + {EPS}) as zscore_{w}" for w in SMA]
    + [f"close / (sma_{w} + {EPS}) - 1 as close_to_sma_{w}" for w in SMA]
    + [f"sd_{n} * {ANN} as realized_vol_{n}d" for n in VOLS]
    + [f"me_{n} as ret_mean_{n}d, sd_{n} as ret_std_{n}d" for n in VOLS]
    + [f"log_ret_1d / (sd_{n} + {EPS}) as vol_adj_ret_{n}d" for n in (5, 10, 20)]
    + [f"(log_ret_1d - me_{n}) / (sd_{n} + {EPS}) as ret_zscore_{n}d" for n in (20, 60)]
    + [
        f"sd_5 * {ANN} / (sd_20 * {ANN} + {EPS}) as vol_ratio_5_20",
        f"(obv - obv_mean) / (obv_std + {EPS}) as obv_zscore",
        "sma_20 as bb_middle, sma_20 + 2 * std_20 as bb_upper, sma_20 - 2 * std_20 as bb_lower",
        f"4 * std_20 / (sma_20 + {EPS}) as bb_bandwidth",
        f"(close - (sma_20 - 2 * std_20)) / (4 * std_20 + {EPS}) as bb_pct_b",
        flag("regime_volatility > vol_mean * 1.2") + " as regime_is_high_vol",
        flag("regime_volatility <= vol_mean") + " as regime_is_low_vol",
        flag("close > sma_50") + " as regime_trend_bullish",
        flag("close <= sma_50") + " as regime_trend_bearish",
        "(sma_50 - sma_before) / sma_before as regime_trend_slope",
        flag("(sma_50 - sma_before) / sma_before > 0.01") + " as regime_is_trending_up",
        flag("(sma_50 - sma_before) / sma_before < -0.01") + " as regime_is_trending_down",
        "close / peak - 1 as regime_drawdown",
        """case when coalesce(regime_volatility > vol_mean * 1.2, false) then 1
          when coalesce((sma_50 - sma_before) / sma_before < -0.01, false) then 3
          when coalesce((sma_50 - sma_before) / sma_before > 0.01, false) then 2 else 0 end as market_regime""",
        "isodow(dt) - 1 as day_of_week, month(dt) as month, quarter(dt) as quarter",
        "sin(2 * pi() * (isodow(dt) - 1) / 5) as dow_sin, cos(2 * pi() * (isodow(dt) - 1) / 5) as dow_cos",
        """cast(case when target_fwd_return > 0.005 then 1 when target_fwd_return < -0.005 then 0 end as double)
          as target_direction""",
    ]
)
cte("feats", ["roll2"], "select *, " + ",\n  ".join(_feats) + "\nfrom roll2")


def _q(span: int) -> str:
    return f"(1 - 2 / cast({span + 1} as double))"


def _ema(col: str, span: int, x: str) -> str:
    return f"{_q(span)} * e.{col} + (1 - {_q(span)}) * {x}"


_W = "(1 - 1 / cast(14 as double))"
_LINE = f"(({_ema('ema_12', 12, 'b.close')}) - ({_ema('ema_26', 26, 'b.close')}))"
cte(
    "scan",
    ["base"],
    f"""
select ticker, rn, close as ema_12, close as ema_26, close as ema_50, cast(null as double) as gain,
  cast(null as double) as loss, tr as atr, cast(null as double) as sig, cast(0 as double) as wx, cast(0 as double) as wxx
from base where rn = 1
union all
select b.ticker, b.rn, {_ema('ema_12', 12, 'b.close')}, {_ema('ema_26', 26, 'b.close')}, {_ema('ema_50', 50, 'b.close')},
  case when b.rn = 2 then b.up else {_W} * e.gain + (1 - {_W}) * b.up end,
  case when b.rn = 2 then b.down else {_W} * e.loss + (1 - {_W}) * b.down end,
  {_W} * e.atr + (1 - {_W}) * b.tr,
  case when b.rn = 26 then {_LINE} when b.rn > 26 then {_q(9)} * e.sig + (1 - {_q(9)}) * {_LINE} end,
  {_q(21)} * e.wx + b.log_ret_1d, {_q(21)} * e.wxx + b.log_ret_1d * b.log_ret_1d
from scan e join base b on b.ticker = e.ticker and b.rn = e.rn + 1
""",
)
cte(
    "ewm",
    ["base", "scan"],
    f"""
select ticker, dt, rn, close,
  case when rn >= 12 then ema_12 end as ema_12, case when rn >= 26 then ema_26 end as ema_26,
  case when rn >= 50 then ema_50 end as ema_50,
  case when rn >= 15 then 100 - 100 / (1 + gain / (loss + {EPS})) end as rsi,
  case when rn >= 14 then s.atr end as atr, case when rn >= 14 then s.atr / (close + {EPS}) end as atr_pct,
  case when rn >= 26 then ema_12 - ema_26 end as macd_line,
  case when rn >= 34 then sig end as macd_signal,
  case when rn >= 34 then ema_12 - ema_26 - sig end as macd_histogram,
  case when rn - 1 >= 21 then sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0) * w * w / (w * w - ww)) * {ANN} end as ewm_vol
from (select b.dt, b.close, s.*, (1 - pow({_q(21)}, s.rn - 1)) / (1 - {_q(21)}) as w,
        (1 - pow({_q(21)} * {_q(21)}, s.rn - 1)) / (1 - {_q(21)} * {_q(21)}) as ww
      from base b join scan s on s.ticker = b.ticker and s.rn = b.rn) s
""",
)
cte("univ", ["base"], "select dt, avg(sret) as portfolio_avg_return from base group by dt")
cte(
    "macrof",
    ["macro"],
    f"""
select label, dt, close, {', '.join(f"ln(close / {lag('close', n, 'label')}) as ret_{n}d" for n in (1, 5, 10))},
  {roll('stddev_samp', 'r', 20, 20, 'label')} * {ANN} as vol_20d,
  (close - {roll('avg', 'close', 60, 60, 'label')}) / ({roll('stddev_samp', 'close', 60, 60, 'label')} + {EPS}) as zscore_60d,
  close / ({roll('avg', 'close', 20, 20, 'label')} + {EPS}) - 1 as trend
from (select *, ln(close / {lag('close', 1, 'label')}) as r from macro) m
""",
)
MACRO_FEATURES = ("ret_1d", "ret_5d", "ret_10d", "vol_20d", "zscore_60d", "trend")
cte(
    "macroa",
    ["macrof", "bars5"],
    "select dt, label, "
    + ", ".join(
        f"last_value({c} ignore nulls) over (partition by label order by dt rows between 5 preceding and current row) as {c}"
        for c in MACRO_FEATURES
    )
    + """
from (select d.dt, l.label, {cols}
      from (select distinct dt from bars5) d cross join (select distinct label from macro) l
      left join macrof f on f.dt = d.dt and f.label = l.label) g
""".format(cols=", ".join(f"f.{c}" for c in MACRO_FEATURES)),
)
cte(
    "macrow",
    ["macroa"],
    "select dt, "
    + ", ".join(
        f"max(case when label = '{v}' then {c} end) as macro_{v}_{c}" for v in ("F", "O", "P") for c in MACRO_FEATURES
    )
    + " from macroa group by dt",
)
cte(
    "crossf",
    ["feats", "univ"],
    f"""
select *, log_ret_1d - portfolio_avg_return as relative_strength_portfolio,
  {pair('corr', 'log_ret_1d', 'portfolio_avg_return', 20, 10)} as corr_with_portfolio_20d
from (select f.*, u.portfolio_avg_return from feats f join univ u using (dt)) j
""",
)
SCORE = "case when zscore_20 is null then cast(0.5 as double) else 1 / (1 + exp(-zscore_20 / 4)) end"
SCORE_T = "case when zscore_5 is null then cast(0.5 as double) else 1 / (1 + exp(zscore_5 / 3)) end"
GATE = "case when zscore_10 is null then 1 else cast(zscore_10 < 0.8 as int) end"
cte(
    "scored",
    ["feats"],
    f"""
select *, cast(proba_S > 0.5 as int) as pred_S, cast(proba_T > 0.5 as int) as pred_T, {GATE} as meta_pred
from (select *, {SCORE} as proba_S, {SCORE_T} as proba_T from feats) f
""",
)
cte(
    "mom",
    ["scored"],
    """
select ticker, rn, 0 as st from scored where rn = 1
union all
select b.ticker, b.rn, case when m is null then 0
  when e.st = 0 then case when m > 0.02 then 1 when m < -0.02 then -1 else 0 end
  when e.st = 1 then case when m < -0.01 then 0 else 1 end else case when m > 0.01 then 0 else -1 end end
from mom e join (select ticker, rn, rolling_ret_21d as m from scored) b on b.ticker = e.ticker and b.rn = e.rn + 1
""",
)
cte("revin", ["scored", "ewm"], "select s.ticker, s.rn, e.rsi as r, s.close_to_sma_20 as d from scored s join ewm e using (ticker, rn)")
cte(
    "rev",
    ["revin"],
    """
select ticker, rn, 0 as st from revin where rn = 1
union all
select b.ticker, b.rn, case when r is null or d is null then 0
  when e.st = 0 then case when r < 30 and d < -0.03 then 1 when r > 70 and d > 0.03 then -1 else 0 end
  when e.st = 1 then case when r > 70 or d > 0.02 then 0 else 1 end
  else case when r < 30 or d < -0.02 then 0 else -1 end end
from rev e join revin b on b.ticker = e.ticker and b.rn = e.rn + 1
""",
)


def ml_size(p: str, shorts: bool = False) -> str:
    size = f"(case when {p} < 0.55 and {p} > 0.45 then 0 else 0.5 * (2 * {p} - 1) end)"
    scaled = f"{size} * least(greatest(0.15 / (realized_vol_20d + {EPS}), 0.2), 3.0)"
    return f"case when {p} is not null and realized_vol_20d is not null then least(greatest({scaled}, {-1 if shorts else 0}), 1) end"


def ml_biased(shorts: bool = False) -> str:
    extra = " or (market_regime = 0 and g < 0 and coalesce(log_ret_1d < 0, false))" if shorts else ""
    return (
        "case when market_regime = 1 or (market_regime = 2 and g < 0) or (market_regime = 3 and g > 0) "
        f"or (market_regime = 0 and g > 0 and coalesce(log_ret_1d > 0, false)){extra} then 0 else g end"
    )


cte(
    "mls",
    ["scored"],
    f"""
select *, case when meta_pred = 0 then 0 else {ml_biased()} end as signal
from (select *, {ml_size('proba_S')} as g from scored) g
""",
)
PANEL_KEYS = "strategy, ticker"
_BAR = "s.ticker, s.dt, s.close, s.volume, s.log_ret_1d, s.asset_ret"
cte(
    "panel",
    ["scored", "mom", "rev", "mls"],
    f"""
select 'momentum' as strategy, {_BAR}, cast(st as double) as signal from scored s join mom using (ticker, rn)
union all by name select 'reversion' as strategy, {_BAR}, cast(st as double) as signal from scored s join rev using (ticker, rn)
union all by name select 'model' as strategy, {_BAR}, cast(signal as double) as signal from mls s
union all by name select 'Buy & Hold' as strategy, {_BAR}, cast(1 as double) as signal from scored s
""",
)
_P = PANEL_KEYS
cte(
    "risk1",
    ["panel"],
    f"""
select *, signal * least(greatest(0.15 / greatest(coalesce({roll('stddev_samp', 'log_ret_1d', 21, 21, _P)} * {ANN}, 0.2), 0.05), 0), 1.5) as p1
from panel
""",
)
cte("risk2", ["risk1"], f"select *, coalesce({lag('p1', 1, _P)}, 0) * asset_ret as pnl from risk1")
cte("risk3", ["risk2"], f"select *, product(1 + pnl) over {frame(None, _P)} as cum_ret from risk2")
cte(
    "risk4",
    ["risk3"],
    f"""
select *, cum_ret / max(cum_ret) over {frame(None, _P)} - 1 as drawdown, max(cum_ret) over {frame(None, _P)} as peak,
  {roll('product', '(1 + pnl)', 5, 5, _P)} - 1 as trail
from risk3
""",
)
cte(
    "risk5",
    ["risk4"],
    f"""
select *, case when coalesce({lag('drawdown', 1, _P)} < -0.15, false) then p1 * 0.5 else p1 end as p3,
  coalesce({lag('trail', 1, _P)} < -0.05, false) as stopped from risk4
""",
)
cte(
    "risk",
    ["risk5"],
    "select *, case when strategy = 'Buy & Hold' then signal when p3 is null then null "
    "else least(greatest(case when stopped then 0 else p3 end, -1), 1) end as position from risk5",
)
cte(
    "parity",
    ["risk"],
    f"""
select r.* exclude (vol, v), r.position * (1 / (r.v + {EPS})) / t.total as weight
from (select *, coalesce(vol, 0.2) as v from (select *, {roll('stddev_samp', 'asset_ret', 60, 20, _P)} * {ANN} as vol from risk) a) r
join (select strategy, dt, sum(1 / (coalesce(f, 0.2) + {EPS})) as total
      from (select strategy, dt, last_value(vol ignore nulls) over (partition by strategy, ticker order by dt rows between unbounded preceding and current row) as f
            from (select d.strategy, d.dt, n.ticker, x.vol from (select distinct strategy, dt from risk) d cross join (select distinct ticker from risk) n
                  left join (select *, {roll('stddev_samp', 'asset_ret', 60, 20, _P)} * {ANN} as vol from risk) x
                  on x.strategy = d.strategy and x.dt = d.dt and x.ticker = n.ticker) g) h
      group by strategy, dt) t on t.strategy = r.strategy and t.dt = r.dt
""",
)


def held(src: str, col: str, by: str) -> str:
    """Rows with the lagged, bounded signal as ``target``."""
    bounded = f"least(greatest(coalesce({col}, 0), -1), 1)"
    return f"select *, coalesce(lag({bounded}) over (partition by {by} order by dt), 0) as target from ({src}) h0"


def liquid(src: str, by: str) -> str:
    return f"""
select *, 0.15 * vol * close as spread from (
  select *, avg(close * volume) over {frame(20, by)} as adv,
    greatest(coalesce(stddev_samp(lr) over {frame(20, by)} * {ANN}, 0.2), 0.01) as vol
  from (select *, ln(close / {lag('close', 1, by)}) as lr from ({src}) l0) l1) l2"""


def changes(src: str, by: str) -> str:
    return f"""
select *, abs(raw) > 1e-10 as traded, case when capped then raw * (0.05 * adv) / (abs(raw) * 100000) else raw end as change
from (select *, coalesce(abs(raw) > 1e-10 and adv > 0 and abs(raw) * 100000 > 0.05 * adv, false) as capped
  from (select *, coalesce(target - {lag('target', 1, by)}, 0) as raw, row_number() over (partition by {by} order by dt) as pos_rn
    from ({src}) c0) c1) c2"""


def capped(prefix: str, src: str, deps: list[str], keys: list[str]) -> None:
    """CTEs {prefix}_in, {prefix}_scan and {prefix}: positions under the volume cap, bar by bar."""
    by = ", ".join(keys)
    cte(f"{prefix}_in", deps, changes(liquid(src, by), by))
    on = " and ".join(f"b.{k} = e.{k}" for k in keys)
    cte(
        f"{prefix}_scan",
        [f"{prefix}_in"],
        f"""
select {by}, pos_rn, case when capped then change else target end as position from {prefix}_in where pos_rn = 1
union all
select {', '.join('b.' + k for k in keys)}, b.pos_rn, case when b.capped then e.position + b.change else b.target end
from {prefix}_scan e join {prefix}_in b on {on} and b.pos_rn = e.pos_rn + 1
""",
    )
    cte(
        prefix,
        [f"{prefix}_in", f"{prefix}_scan"],
        f"""
select *, case when traded then slippage * abs(change) else 0 end as exec_cost
from (select i.*, s.position, i.spread / 2 / (i.close + {EPS}) + pow(abs(change) * 100000 / (adv + {EPS}), 2) * vol as slippage
  from (select * {'exclude (position)' if prefix == 'exe' else ''} from {prefix}_in) i join {prefix}_scan s using ({by}, pos_rn)) x
""",
    )


capped("exe", held("select * from parity", "weight", _P), ["parity"], ["strategy", "ticker"])
cte(
    "netted",
    ["exe"],
    f"""
select *, position * asset_ret - exec_cost - abs(pc) * 0.001 / 2 as ret
from (select *, coalesce(position - {lag('position', 1, _P)}, 0) as pc from exe) n
""",
)
cte(
    "flatted",
    ["parity"],
    f"""
select *, target * asset_ret - abs(coalesce(target - {lag('target', 1, _P)}, 0)) * 0.001 as ret
from ({held('select * from parity', 'weight', _P)}) f
""",
)
PF = "select strategy, dt, sum(ret) as ret from {src} group by strategy, dt having count(ret) = (select count(distinct ticker) from bars5)"
cte("pf", ["netted", "bars5"], PF.format(src="netted"))
cte("pf_flat", ["flatted", "bars5"], PF.format(src="flatted"))
cte("mkt", ["market"], "select dt, coalesce(close / lag(close) over (order by dt) - 1, 0) as market_ret from market")
cte(
    "beta",
    ["base", "mkt"],
    f"""
select b.ticker, b.dt, b.asset_ret, coalesce(x.raw, 1) as beta from base b left join (
  select ticker, dt, {pair('covar_samp', 'asset_ret', 'market_ret', 60, 60)} / ({roll('var_samp', 'market_ret', 60, 60)} + {EPS}) as raw
  from (select ticker, dt, asset_ret, market_ret from base join mkt using (dt)) p) x using (ticker, dt)
""",
)
cte("hedge", ["parity", "beta"], "select strategy, dt, -sum(weight * beta) as hedge from parity join beta using (ticker, dt) group by strategy, dt")
cte(
    "neutral",
    ["pf", "hedge", "mkt"],
    """
select strategy || ' (Beta-Neutral)' as strategy, dt, ret + coalesce(h, 0) * coalesce(market_ret, 0) as ret
from pf left join (select strategy, dt, coalesce(lag(hedge) over (partition by strategy order by dt), 0) as h from hedge) g using (strategy, dt)
left join mkt using (dt) where strategy <> 'Buy & Hold'
""",
)

RF = "(pow(cast(1.04 as double), 1 / cast(252 as double)) - 1)"


def report_sql(src: str, keys: str, positions: bool) -> str:
    """Performance report of ``ret`` (and ``position``) as one select."""
    k = keys
    if positions:
        stats = f"""
select {k}, sum(e) as total_trades, count(g) as nt, count(case when g > 1 then 1 end) as nw,
  coalesce(sum(case when g > 1 then g - 1 end), 0) as won, coalesce(sum(case when g < 1 then g - 1 end), 0) as lost,
  count(case when g < 1 then 1 end) as nl, coalesce(avg(g - 1), 0) as avg_trade_return
from (select {k}, tid, product(case when position <> 0 then 1 + ret end) as g, sum(entry) as e
  from (select *, sum(opened) over {frame(None, k)} as tid
    from (select *, cast(position <> 0 and coalesce(was, 0) = 0 as int) as opened,
        cast(position <> 0 and coalesce(position - was, 0) <> 0 as int) as entry
      from (select *, {lag('position', 1, k)} as was from ({src}) a) b) c) d group by {k}, tid) e group by {k}"""
        win, factor = "case when nt > 0 then nw / cast(nt as double) else 0 end", "case when nt = 0 then 0 when nl > 0 then won / (abs(lost) + 1e-10) else cast('inf' as double) end"
    else:
        stats = f"""
select {k}, count(case when ret <> 0 then 1 end) as total_trades, count(case when ret > 0 then 1 end) as nw,
  coalesce(sum(case when ret > 0 then ret end), 0) as won, coalesce(sum(case when ret < 0 then ret end), 0) as lost,
  count(case when ret < 0 then 1 end) as nl, coalesce(avg(case when ret <> 0 then ret end), 0) as avg_trade_return
from ({src}) a group by {k}"""
        win, factor = "nw / cast(greatest(total_trades, 1) as double)", "case when nl > 0 then won / (abs(lost) + 1e-10) else cast('inf' as double) end"
    return f"""
select {k}, start_date, end_date, total_return, cagr, std * {ANN} as annualized_volatility,
  case when std >= 1e-8 and n >= 10 then (mean - {RF}) / std * {ANN} else 0 end as sharpe_ratio,
  case when nd > 1 and dstd >= 1e-8 then (mean - {RF}) / dstd * {ANN} else 0 end as sortino_ratio,
  dd as max_drawdown, dur as max_drawdown_duration_days, cagr / (abs(dd) + 1e-10) as calmar_ratio,
  {win} as win_rate, {factor} as profit_factor, total_trades, avg_trade_return
from (select *, case when total_return > -1 then pow(1 + total_return, 1 / greatest(n / cast(252 as double), 1e-6)) - 1 else -1 end as cagr
  from (select {k}, min(dt) as start_date, max(dt) as end_date, product(1 + ret) - 1 as total_return, count(*) as n,
      avg(ret) as mean, stddev_samp(ret) as std, count(case when ret < {RF} then 1 end) as nd,
      stddev_samp(case when ret < {RF} then ret - {RF} end) as dstd, min(dd) as dd,
      max(rn - coalesce(ref, 0)) as dur
    from (select *, max(case when not dd < 0 then rn end) over {frame(None, k)} as ref
      from (select *, growth / max(growth) over {frame(None, k)} - 1 as dd
        from (select *, product(1 + ret) over {frame(None, k)} as growth, row_number() over (partition by {k} order by dt) as rn
          from (select * from ({src}) r0 where ret is not null) r1) r2) r3) r4 group by {k}) r5) r6
join ({stats}) st using ({k})"""


REPORT_DOUBLES = (
    "total_return cagr annualized_volatility sharpe_ratio sortino_ratio max_drawdown calmar_ratio win_rate profit_factor avg_trade_return"
)
REPORT_INTS = "max_drawdown_duration_days total_trades"
