"""How a panel of time series is split into window groups.

A panel is a long table with one row per (keys, order).  Two layouts exist:

* order is a DATE and the pair is unique.  A series then has at most one row per calendar
  day, so a window group of one whole series is bounded by the calendar (a century is
  36,525 rows) no matter how large the panel is.
* order is finer than a day (bars of minutes, ticks).  One series may then hold any share of
  the panel, so it is cut into blocks of consecutive rows.  Operators with a bounded look-back
  get the preceding rows of the block copied in (``windowed``); unbounded ones carry one small
  summary row per block (``running``, ``state_scan``).

The operators are written once; the layout is chosen from the type of the order column, or
forced with ``Series(block=...)``.
"""

from __future__ import annotations

import functools
import inspect
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.tables import materialise

EPS = 1e-10
TRADING_DAYS = 252

BLOCK_ROWS = 65_536
DAY_SLOT = 366
SECOND_SLOT = 86_400

@dataclass(frozen=True)
class Series:
    """Keys, order column and layout of a panel.

    block: rows per block; 0 picks whole series for DATE and blocks of BLOCK_ROWS otherwise.
    slot: width used to number the rows of a series (days for DATE, seconds otherwise).
    """

    keys: tuple[str, ...] = ("ticker",)
    order: str = "dt"
    block: int = 0
    slot: int = 0
    inside: bool = False

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def over(self) -> str:
        """The window as SQL text, for expressions given as strings."""
        return f"(partition by {', '.join(f'`{k}`' for k in self.keys)} order by `{self.order}`)"

    def upto(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def last(self, rows: int) -> WindowSpec:
        return self.window().rowsBetween(-(rows - 1), 0)

    def with_keys(self, *extra: str) -> "Series":
        return replace(self, keys=(*extra, *self.keys))

    def block_rows(self, df: DataFrame) -> int:
        """Rows per block for this table, or 0 when whole series are safe window groups."""
        if self.inside:
            return 0
        if self.block:
            return self.block
        return 0 if isinstance(df.schema[self.order].dataType, T.DateType) else BLOCK_ROWS

    def _slot_column(self, df: DataFrame) -> Column:
        if isinstance(df.schema[self.order].dataType, T.DateType):
            return F.floor(F.unix_date(self.order) / (self.slot or DAY_SLOT))
        seconds = F.unix_seconds(F.col(self.order).cast("timestamp"))
        return F.floor(seconds / (self.slot or SECOND_SLOT))

    def numbered(self, df: DataFrame) -> DataFrame:
        """Add ``_rn``, the row number within the series from 0, without a window over a series.

        Rows are numbered inside short time slots; the per-slot counts (bounded by the calendar)
        give each slot its offset.
        """
        keys = list(self.keys)
        # the table is read twice, and chained operators would repeat their inputs each time
        df = materialise(df, "numbered")
        slotted = df.withColumn("_slot", self._slot_column(df))
        counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_cnt"))
        before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
        in_slot = Window.partitionBy(*keys, "_slot").orderBy(self.order)
        local = slotted.withColumn("_idx", F.row_number().over(in_slot) - 1)
        return (
            local.join(offsets, [*keys, "_slot"])
            .withColumn("_rn", F.col("_off") + F.col("_idx"))
            .drop("_slot", "_idx", "_off")
        )

    def framed(self, df: DataFrame, rows: int, back: int, ahead: int) -> DataFrame:
        """Copy each row into every block that needs it as history (or as look-ahead)."""
        first = F.expr(f"(_rn - {ahead}) div {rows}")
        final = F.expr(f"(_rn + {back}) div {rows}")
        return self.numbered(df).withColumn("_blk", F.explode(F.sequence(first, final)))

    def within(self) -> "Series":
        return replace(self, keys=(*self.keys, "_blk"), inside=True)

    @staticmethod
    def unframed(df: DataFrame, rows: int) -> DataFrame:
        return df.filter(F.expr(f"_blk = _rn div {rows}")).drop("_blk", "_rn")


DAILY = Series()


def windowed(back, ahead=0):
    """Mark an operator ``fn(df, ..., s=Series)`` as needing ``back`` rows of history.

    ``back`` and ``ahead`` are numbers or functions of the operator's arguments.
    """

    def decorate(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def run(df: DataFrame, *args, s: Series | None = None, **kwargs) -> DataFrame:
            s = s or signature.parameters["s"].default
            rows = s.block_rows(df)
            if not rows:
                return fn(df, *args, s=s, **kwargs)
            bound = signature.bind(df, *args, s=s, **kwargs)
            bound.apply_defaults()
            need = [n(bound.arguments) if callable(n) else n for n in (back, ahead)]
            framed = s.framed(df, rows, *need)
            return s.unframed(fn(framed, *args, s=s.within(), **kwargs), rows)

        return run

    return decorate


# ---------------------------------------------------------------------------------------------
# bounded frames with a minimum number of observations
#
# A frame of k rows is put together from equal shorter frames by lags (200 rows from four of 50,
# 50 from five of 10, ...), merging counts, means and central moments.  That is a handful of
# lags per row where a sliding frame would visit every row of the frame again, and it has none of
# the cancellation of differences of prefix sums.

MAX_PARTS = 8


def _child(k: int, wanted: set[int]) -> int:
    """Size of the equal frames that make up a frame of k rows; 0 if there is no good split."""
    if k <= MAX_PARTS:
        return 1
    sizes = [d for d in range(2, k) if k % d == 0 and k // d <= MAX_PARTS]
    ready = [d for d in sizes if d in wanted]
    return min(ready or sizes, default=0)


class _Frames:
    """Collects the lags and merges for a set of frames and runs them level by level."""

    def __init__(self, df: DataFrame, s: Series):
        self.df, self.s = df, s
        self.levels: dict[int, tuple[dict[str, str], list[dict[str, str]]]] = {}
        self.depth: dict[str, int] = {}
        self.wanted: dict[tuple, set[int]] = {}

    def _lagged(self, level: int, col: str, off: int) -> str:
        if off == 0:
            return col
        name = f"{col}__{off}"
        self.levels.setdefault(level, ({}, []))[0][name] = f"lag({col}, {off}) over {self.s.over()}"
        return name

    def _put(self, level: int, layers: list[dict[str, str]]) -> None:
        lanes = self.levels.setdefault(level, ({}, []))[1]
        for i, layer in enumerate(layers):
            while len(lanes) <= i:
                lanes.append({})
            lanes[i].update(layer)

    def moments(self, col: str, k: int, order: int, partial: bool) -> str:
        """Node with the mean and the 2nd and 3rd central sums of k rows.

        A complete node is NULL unless all k values are known; a partial one counts them.
        """
        tag = f"_{'p' if partial else 'c'}_{col}_{k}"
        if self.depth.get(tag, 0) and self.order_of[tag] >= order:
            return tag
        h = _child(k, self.wanted[(col, partial)])
        if h > 1:
            child = self.moments(col, h, order, partial)
            level = self.depth[child] + 1
            m, q, c, n = f"{child}_m", f"{child}_q", f"{child}_t", f"{child}_n"
        else:
            level, m, q, c, n, h = 1, col, None, None, None, 1
        parts = [i * h for i in range(k // h)]
        means = [self._lagged(level, m, o) for o in parts]
        out = f"{tag}_m"
        if partial:
            counts = (
                [f"coalesce({self._lagged(level, n, o)}, 0)" for o in parts]
                if n
                else [f"cast({x} is not null as int)" for x in means]
            )
            weighted = [f"coalesce({x} * {c_}, 0.0d)" for x, c_ in zip(means, counts)]
            layers = [{f"{tag}_n": " + ".join(counts)}]
            layers.append({out: f"case when {tag}_n > 0 then ({' + '.join(weighted)}) / {tag}_n end"})
        else:
            counts = [str(h)] * len(parts)
            layers = [{out: f"({' + '.join(means)}) / {len(parts)}.0d"}]
        if order >= 2:
            squares = [self._lagged(level, q, o) for o in parts] if q else []
            terms = [f"{w} * ({x} - {out}) * ({x} - {out})" for x, w in zip(means, counts)] + squares
            layers.append({f"{tag}_q": " + ".join(f"coalesce({x}, 0.0d)" for x in terms) if partial else " + ".join(terms)})
        if order >= 3:
            cubes = [self._lagged(level, c, o) for o in parts] if c else []
            mixed = [f"3.0d * ({x} - {out}) * {sq}" for x, sq in zip(means, squares)] if q else []
            terms = [f"{w} * ({x} - {out}) * ({x} - {out}) * ({x} - {out})" for x, w in zip(means, counts)]
            layers.append({f"{tag}_t": " + ".join(terms + mixed + cubes)})
        self._put(level, layers)
        self.depth[tag] = level
        self.order_of[tag] = order
        return tag

    order_of: dict[str, int] = {}

    def folded(self, col: str, k: int, kind: str) -> str:
        """Node with the greatest, least, summed or multiplied known value of k rows."""
        tag = f"_{kind}_{col}_{k}"
        if tag in self.depth:
            return tag
        h = _child(k, set())
        child, level = (col, 1) if h <= 1 else (self.folded(col, h, kind), 0)
        level = level or self.depth[child] + 1
        parts = [self._lagged(level, child, i * max(h, 1)) for i in range(k // max(h, 1))]
        neutral = {"sum": "0.0d", "prod": "1.0d"}.get(kind)
        if kind in ("max", "min"):
            text = f"{'greatest' if kind == 'max' else 'least'}({', '.join(parts)})" if len(parts) > 1 else parts[0]
        else:
            text = (" + " if kind == "sum" else " * ").join(f"coalesce({p}, {neutral})" for p in parts)
        self._put(level, [{tag: text}])
        self.depth[tag] = level
        return tag

    def run(self) -> DataFrame:
        df = self.df
        for level in sorted(self.levels):
            lags, layers = self.levels[level]
            if lags:
                df = df.selectExpr("*", *[f"{e} as {n}" for n, e in lags.items()])
            for layer in layers:
                df = df.selectExpr("*", *[f"{e} as {n}" for n, e in layer.items()])
        return df


_FRAME_FNS = {"corr": "corr", "cov": "covar_samp"}


def rolling(df: DataFrame, s: Series, specs: dict[str, tuple]) -> DataFrame:
    """Add rolling statistics: ``{out: (kind, column, rows, min_rows)}``.

    kind: mean, std, var, skew (adjusted), sum, prod, max, min, or corr and cov of two columns.
    A value appears once ``min_rows`` non-null values lie in the frame.
    """
    original = df.columns
    frames = _Frames(df, s)
    frames.order_of = {}
    counted: dict[str, str] = {}
    singles = [(k, c, n, p) for k, c, n, p in specs.values() if not isinstance(c, tuple)]
    for kind, c, rows, least in singles:
        if kind in ("mean", "std", "var", "skew"):
            frames.wanted.setdefault((c, least < rows), set()).add(rows)
    # higher moments first, so that a shared node carries all that is asked of it
    ordered = sorted(singles, key=lambda x: -{"skew": 3, "std": 2, "var": 2}.get(x[0], 1))
    shorter = sorted(ordered, key=lambda x: (-{"skew": 3, "std": 2, "var": 2}.get(x[0], 1), x[2]))
    nodes: dict[tuple, str] = {}
    for kind, c, rows, least in shorter:
        if kind in ("mean", "std", "var", "skew"):
            order = {"mean": 1, "skew": 3}.get(kind, 2)
            nodes[(c, rows, least < rows)] = frames.moments(c, rows, order, least < rows)
        else:
            nodes[(c, rows, kind)] = frames.folded(c, rows, kind)
            counted[c] = c
    upto = f"{s.over()[:-1]} rows between unbounded preceding and current row)"
    pairs = {c for _, c, _, _ in specs.values() if isinstance(c, tuple)}
    before: list[str] = []
    for a, b in pairs:
        both = f"_pair_{a}_{b}"
        before.append(f"case when {a} is not null and {b} is not null then 1 end as {both}")
        counted[both] = both
    if before:
        frames.df = frames.df.selectExpr("*", *before)
    if counted:
        frames.df = frames.df.selectExpr("*", *[f"count({c}) over {upto} as _k_{c}" for c in counted])
    out = frames.run()

    late: dict[str, str] = {}
    final: dict[str, str] = {}
    for name, (kind, c, rows, least) in specs.items():
        if kind in ("mean", "std", "var", "skew"):
            tag = nodes[(c, rows, least < rows)]
            n = f"{tag}_n" if least < rows else f"{rows}"
            if kind == "mean":
                value = f"{tag}_m"
            elif kind == "skew":
                # a frame without spread has no skewness
                value = (
                    f"case when {tag}_q > 0 then sqrt({n} * 1.0d) * {tag}_t / power({tag}_q, 1.5d)"
                    f" * sqrt({n} * ({n} - 1.0d)) / ({n} - 2.0d) end"
                )
            else:
                value = f"case when {n} > 1 then {tag}_q / ({n} - 1.0d) end"
                value = f"sqrt({value})" if kind == "std" else value
            final[name] = f"case when {n} >= {least} then {value} end" if least < rows else value
            continue
        if isinstance(c, tuple):
            a, b = c
            key = f"_pair_{a}_{b}"
            raw = f"_{kind}_{a}_{b}_{rows}"
            frame = f"{s.over()[:-1]} rows between {rows - 1} preceding and current row)"
            late[raw] = f"{_FRAME_FNS[kind]}({a}, {b}) over {frame}"
        else:
            key, raw = c, nodes[(c, rows, kind)]
        late[f"_k_{key}_{rows}"] = f"_k_{key} - lag(_k_{key}, {rows}, 0L) over {s.over()}"
        final[name] = f"case when _k_{key}_{rows} >= {least} then {raw} end"
    if late:
        out = out.selectExpr("*", *[f"{e} as {n}" for n, e in late.items()])
    keep = [f"`{c}`" for c in original if c not in specs]
    return out.selectExpr(*keep, *[f"{e} as {n}" for n, e in final.items()])


# ---------------------------------------------------------------------------------------------
# exponential weights


def decay_rows(q: float) -> int:
    """Rows after which a weight q**n falls below double precision."""
    return max(1, math.ceil(39.2 / -math.log(q))) if q > 0 else 1


def span_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


CHUNK = 512
#: Natural logarithm of the largest weight in a chunk; doubles end at 709.
WEIGHT_RANGE = 600.0


def _lit(x: float) -> str:
    return f"{x!r}d"


def decayed_sums(df: DataFrame, s: Series, terms: dict[str, tuple[str, float]]) -> DataFrame:
    """Add ``out_t = sum over i <= t of u_i * q**(t-i)`` for ``{out: (u, q)}``, NULL u as 0.

    A weighted prefix sum inside chunks of CHUNK rows plus the totals of the few preceding chunks
    that still matter in double precision; all terms share one sort.  Small q make the chunks
    shorter, so that no weight overflows; with q = 0 a term is its last value.
    """
    alone = [f"coalesce({u}, 0.0d) as {o}" for o, (u, q) in terms.items() if q <= 0.0]
    original = [c for c in df.columns if c not in terms]
    terms = {o: t for o, t in terms.items() if t[1] > 0.0}
    if not terms:
        return df.selectExpr(*[f"`{c}`" for c in original], *alone)
    chunk = min([CHUNK, *(max(1, int(WEIGHT_RANGE / -math.log(q))) for _, q in terms.values())])
    keys = ", ".join(f"`{k}`" for k in s.keys)
    df = df.selectExpr("*", f"row_number() over {s.over()} - 1 as _at")
    df = df.selectExpr("*", f"_at div {chunk} as _chunk", f"_at % {chunk} as _pos")
    df = df.selectExpr(
        "*", *[f"coalesce({u}, 0.0d) * power({_lit(q)}, -_pos) as _u_{o}" for o, (u, q) in terms.items()]
    )
    local = f"(partition by {keys}, _chunk order by `{s.order}` rows between unbounded preceding and current row)"
    df = df.selectExpr("*", *[f"sum(_u_{o}) over {local} as _l_{o}" for o in terms])
    reach = {o: max(1, math.ceil(decay_rows(q) / chunk)) for o, (_, q) in terms.items()}
    df = df.selectExpr(
        "*",
        *[
            f"sum(_u_{o}) over (partition by {keys} order by _chunk range between {k} preceding and {k} preceding)"
            f" as _k_{o}_{k}"
            for o in terms
            for k in range(1, reach[o] + 1)
        ],
    )
    outs = []
    for o, (_, q) in terms.items():
        carries = [f"coalesce(_k_{o}_{k}, 0.0d) * {_lit(q ** (chunk * k))}" for k in range(1, reach[o] + 1)]
        outs.append(f"({' + '.join([f'_l_{o}', *carries])}) * power({_lit(q)}, _pos) as {o}")
    return df.selectExpr(*[f"`{c}`" for c in original], *outs, *alone)


def ewm_means(df: DataFrame, s: Series, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Recursive exponential means ``y = q*y' + (1-q)*x`` seeded with the first value.

    ``{out: (x, q, min_rows)}``.  x may be NULL at the start of a series; later gaps are expected
    to be filled beforehand.
    """
    original = [c for c in df.columns if c not in specs]
    upto = f"{s.over()[:-1]} rows between unbounded preceding and current row)"
    inputs = {x for x, _, _ in specs.values()}
    df = df.selectExpr("*", *[f"count({x}) over {upto} as _cnt_{x}" for x in inputs])
    df = df.selectExpr(
        "*",
        *[f"case when _cnt_{x} = 1 then {x} else {x} * {_lit(1.0 - q)} end as _x_{o}" for o, (x, q, _) in specs.items()],
    )
    df = decayed_sums(df, s, {f"_y_{o}": (f"_x_{o}", q) for o, (_, q, _) in specs.items()})
    return df.selectExpr(
        *[f"`{c}`" for c in original],
        *[f"case when _cnt_{x} >= {least} then _y_{o} end as {o}" for o, (x, _, least) in specs.items()],
    )


# ---------------------------------------------------------------------------------------------
# unbounded running values


def _last(c):
    return F.last(c, ignorenulls=True)


_RUNNING = {
    "sum": (F.sum, lambda carry, local: F.coalesce(carry, F.lit(0)) + local),
    "product": (F.product, lambda carry, local: F.coalesce(carry, F.lit(1.0)) * local),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "min": (F.min, lambda carry, local: F.least(carry, local)),
    "last": (_last, lambda carry, local: F.coalesce(local, carry)),
}


def running(df: DataFrame, s: Series, specs: dict[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """Add cumulative values ``{out: (kind, expression)}`` over all rows so far of a series.

    sum and product treat NULL as neutral; reverse accumulates from the end of the series.  In
    blocks, each block sends one summary row.
    """
    if s.inside:
        raise ValueError("a running value needs whole series; compute it before framing")
    neutral = {"sum": 0.0, "product": 1.0}
    args = {
        o: (F.coalesce(e, F.lit(neutral[k])) if k in neutral else e) for o, (k, e) in specs.items()
    }
    rows = s.block_rows(df)
    if not rows:
        w = Window.partitionBy(*s.keys).orderBy(F.desc(s.order) if reverse else F.asc(s.order))
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: _RUNNING[k][0](args[o]).over(w) for o, (k, _) in specs.items()})

    keys = list(s.keys)
    blocked = s.numbered(df).withColumn("_blk", F.expr(f"_rn div {rows}"))
    blocked = materialise(blocked.withColumns({f"_in_{o}": args[o] for o in specs}), "blocks")
    sign = -1 if reverse else 1
    local = Window.partitionBy(*keys, "_blk").orderBy(F.col("_rn") * sign).rowsBetween(Window.unboundedPreceding, 0)
    ends = blocked.groupBy(*keys, "_blk").agg(
        *[
            # the last non-null value in time order, as a mergeable aggregate
            F.max_by(f"_in_{o}", F.when(F.col(f"_in_{o}").isNotNull(), F.col("_rn") * sign)).alias(f"_e_{o}")
            if k == "last"
            else _RUNNING[k][0](f"_in_{o}").alias(f"_e_{o}")
            for o, (k, _) in specs.items()
        ]
    )
    before = Window.partitionBy(*keys).orderBy(F.col("_blk") * sign).rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(
        *keys, "_blk", *[_RUNNING[k][0](f"_e_{o}").over(before).alias(f"_k_{o}") for o, (k, _) in specs.items()]
    )
    blocked = blocked.withColumns({f"_l_{o}": _RUNNING[k][0](f"_in_{o}").over(local) for o, (k, _) in specs.items()})
    joined = blocked.join(carries, [*keys, "_blk"], "left")
    return joined.select(
        *df.columns, *[_RUNNING[k][1](F.col(f"_k_{o}"), F.col(f"_l_{o}")).alias(o) for o, (k, _) in specs.items()]
    )


# ---------------------------------------------------------------------------------------------
# three-state machines
#
# A row's transition is a string of three digits: the next state (0 short, 1 flat, 2 long) from
# each state.  translate() applies one transition after another, and that is associative.

IDENTITY = "012"
SCAN_BLOCK = 4096
# four-fold distances: 4**8 rows cover a DATE-keyed series of 179 years, 4**6 rows a block
CALENDAR_STEPS = 8
BLOCK_STEPS = 6


def transition(from_short: Column, from_flat: Column, from_long: Column) -> Column:
    """One row's transition of a {-1, 0, 1} machine."""
    return F.concat(*[(c + 1).cast("int").cast("string") for c in (from_short, from_flat, from_long)])


def _then(first: str, second: str) -> str:
    return f"translate({first}, '{IDENTITY}', {second})"


def _prefix(df: DataFrame, over: str, steps: int) -> DataFrame:
    """Compose ``_map`` with all earlier ones in its group, four times the distance per step."""
    rest = [f"`{c}`" for c in df.columns if c != "_map"]
    for i in range(steps):
        lags = [f"lag(_map, {n * 4**i}, '{IDENTITY}') over {over} as _m{n}" for n in (1, 2, 3)]
        composed = _then(_then(_then("_m3", "_m2"), "_m1"), "_map")
        df = df.selectExpr("*", *lags).selectExpr(*rest, f"{composed} as _map")
    return df


def _over(keys: list[str], order: str) -> str:
    return f"(partition by {', '.join(f'`{k}`' for k in keys)} order by `{order}`)"


def _carried(ends: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Transition up to the end of each block, from one row (keys, _blk, _map) per block."""
    if levels == 0:
        return _prefix(ends, _over(keys, "_blk"), CALENDAR_STEPS)
    ends = ends.withColumn("_sup", F.expr(f"_blk div {SCAN_BLOCK}"))
    local = _prefix(ends, _over([*keys, "_sup"], "_blk"), BLOCK_STEPS)
    tops = local.groupBy(*keys, "_sup").agg(F.max_by("_map", "_blk").alias("_map"))
    tops = _carried(tops.withColumnRenamed("_sup", "_blk"), keys, levels - 1)
    tops = tops.select(*keys, (F.col("_blk") + 1).alias("_sup"), F.col("_map").alias("_top"))
    joined = local.join(tops, [*keys, "_sup"], "left")
    return joined.select(*keys, "_blk", F.expr(_then(f"coalesce(_top, '{IDENTITY}')", "_map")).alias("_map"))


def state_scan(df: DataFrame, s: Series, code: Column, out: str) -> DataFrame:
    """Run a {-1, 0, 1} machine that starts flat; ``code`` is a ``transition`` per row.

    Composition is associative, so the scan needs lags only: no row loop, and in blocks only one
    row per block moves between tasks.
    """
    if s.inside:
        raise ValueError("a state machine needs whole series; run it before framing")
    columns = [f"`{c}`" for c in df.columns]
    df = df.withColumn("_map", code)
    state = f"cast(substring(_map, 2, 1) as int) - 1 as {out}"
    if not s.block_rows(df):
        return _prefix(df, s.over(), CALENDAR_STEPS).selectExpr(*columns, state)
    keys = list(s.keys)
    blocked = s.numbered(df).withColumn("_blk", F.expr(f"_rn div {SCAN_BLOCK}"))
    local = materialise(_prefix(blocked, _over([*keys, "_blk"], "_rn"), BLOCK_STEPS), "states")
    ends = local.groupBy(*keys, "_blk").agg(F.max_by("_map", "_rn").alias("_map"))
    ends = _carried(ends, keys, 1).select(*keys, (F.col("_blk") + 1).alias("_blk"), F.col("_map").alias("_before"))
    joined = local.join(ends, [*keys, "_blk"], "left")
    joined = joined.withColumn("_map", F.expr(_then(f"coalesce(_before, '{IDENTITY}')", "_map")))
    return joined.selectExpr(*columns, state)
