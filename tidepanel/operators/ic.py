"""Signal quality: information coefficients of features against forward returns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.ranks import average_rank
from tidepanel.functions.series import DAILY, Series, windowed
from tidepanel.functions.tables import materialise

HORIZONS = (1, 5, 10, 20)
LEAST_PAIRS = 30


@windowed(0, lambda p: max(p["horizons"]))
def forward_returns(df: DataFrame, horizons=HORIZONS, s: Series = DAILY) -> DataFrame:
    w = s.window()
    return df.withColumns({f"fwd_ret_{h}d": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1.0 for h in horizons})


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share the mean."""
    order = np.argsort(v, kind="stable")
    new = np.concatenate([[True], v[order][1:] != v[order][:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(start + (size + 1) / 2.0, size)
    return out


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 0 else None


def _whole_series(wide: DataFrame, by: list[str], features: list[str], horizons, method: str) -> DataFrame:
    """The matrix of every group in one task: a series of dates is bounded by the calendar, so no row is repeated per feature or horizon."""
    fields = [wide.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("feature", T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("_ic", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_numpy() for c in [*features, *[f"fwd_ret_{h}d" for h in horizons]]}
        known = {c: table.column(c).is_valid().to_numpy() for c in cells}
        found = []
        for c in features:
            for h in horizons:
                pairs = known[c] & known[f"fwd_ret_{h}d"]
                n = int(pairs.sum())
                x, y = cells[c][pairs], cells[f"fwd_ret_{h}d"][pairs]
                ic = None
                if n > LEAST_PAIRS:
                    ic = _correlation(_ranks(x), _ranks(y)) if method == "spearman" else _correlation(x, y)
                if n:
                    found.append((c, h, n, ic))
        first = pa.array(np.zeros(len(found), np.int64))
        columns = [table.column(c).combine_chunks().take(first) for c in by]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64()]
        columns += [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
        return pa.Table.from_arrays(columns, [*by, "feature", "horizon", "n", "_ic"])

    return wide.groupBy(*by).applyInArrow(run, schema)


def ic_matrix(
    df: DataFrame,
    features: list[str],
    horizons=HORIZONS,
    method: str = "spearman",
    by: tuple[str, ...] = ("ticker",),
    s: Series = DAILY,
) -> DataFrame:
    """Correlation of each feature with each forward return: (by..., feature, horizon, n, ic).

    Pairs with one side unknown are left out; 30 pairs or fewer give NULL.  ``by`` lists the
    grouping columns; with ``by=()`` all series form one sample.
    """
    df = forward_returns(df.select(*s.keys, s.order, "close", *[c for c in features if c != "close"]), horizons, s=s)
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in features], *[f"fwd_ret_{h}d" for h in horizons])
    if not by:
        wide = wide.withColumn("sample", F.lit("all"))
    groups = [*(by or ("sample",)), "feature", "horizon"]
    if set(s.keys) <= set(by) and not s.block_rows(df):
        out = _whole_series(wide, groups[:-2], list(features), tuple(horizons), method)
    else:
        out = _pooled(wide, groups, features, horizons, method)
    ic = F.when(F.col("n") > LEAST_PAIRS, F.col("_ic"))
    return out.select(*groups, "n", F.when(~F.isnan(ic), ic).alias("ic"))


def _pooled(wide: DataFrame, groups: list[str], features: list[str], horizons, method: str) -> DataFrame:
    """Groups of any size: pairs as rows, ranked in value buckets."""
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_ret_{h}d").alias("y")) for h in horizons])
    long = (
        wide.unpivot([*groups[:-2], *[f"fwd_ret_{h}d" for h in horizons]], features, "feature", "x")
        .filter(F.col("x").isNotNull())
        .select(*groups[:-2], "feature", "x", F.explode(ahead).alias("_a"))
        .select(*groups[:-2], "feature", "x", "_a.horizon", "_a.y")
        .filter(F.col("y").isNotNull())
    )
    pair = ("x", "y")
    if method == "spearman":
        long = materialise(average_rank(materialise(long, "pairs"), groups, "x", "_rx"), "ranked")
        long = average_rank(long, groups, "y", "_ry")
        pair = ("_rx", "_ry")
    return long.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.corr(*pair).alias("_ic"))


def _first(ics: DataFrame) -> DataFrame:
    return ics.filter(F.col("horizon") == 1)


def split_weak_strong(ics: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Flag features by their absolute one-day coefficient; unknown ones carry no flag."""
    size = F.abs("ic")
    return _first(ics).withColumn("strength", F.when(size >= threshold, "strong").when(size < threshold, "weak"))


def ic_half_life(ics: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Horizon at which |IC| has halved, interpolated; infinite when it never does."""
    keys = [*by, "feature"]
    w = Window.partitionBy(*keys).orderBy("horizon")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = ics.withColumn("_v", F.abs("ic")).withColumns(
        {"_pv": F.lag("_v").over(w), "_ph": F.lag("horizon").over(w), "_v1": F.first("_v").over(full)}
    )
    target: Column = F.col("_v1") / 2.0
    crossed = (F.col("_v") <= target) & (target <= F.col("_pv"))
    slope = (F.col("_v") - F.col("_pv")) / (F.col("horizon") - F.col("_ph"))
    at = F.when(slope != 0, F.col("_ph") + (target - F.col("_pv")) / slope)
    agg = df.withColumns({"_hit": F.when(crossed, F.col("horizon")), "_at": F.when(crossed, at)}).groupBy(*keys).agg(
        F.min_by("_at", "_hit").alias("_hl"),
        F.max_by("_v", "horizon").alias("_end"),
        F.first("_v1").alias("_v1"),
    )
    value = F.coalesce(
        F.col("_hl"), F.when(F.col("_end") > F.col("_v1") / 2.0, F.lit(float("inf")))
    )
    return agg.select(*keys, F.when(F.col("_v1") > 0, value).alias("half_life"))


def optimal_holding_period(half_lives: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Median finite half-life, rounded half to even, at least one day."""
    finite = half_lives.filter((F.col("half_life") > 0) & (F.col("half_life") < float("inf")))
    if not by:
        finite = finite.withColumn("sample", F.lit("all"))
    # one value per feature, so the exact percentile has a small buffer
    return finite.groupBy(*(by or ("sample",))).agg(F.percentile("half_life", 0.5).alias("median_half_life")).withColumn(
        "holding_days", F.greatest(F.lit(1), F.bround("median_half_life").cast("int"))
    )


def ic_summary(ics: DataFrame, top: int | None = None, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Coefficients by horizon with half-life, strongest one-day signal first; top n per group.

    Coefficients that agree to nine digits count as equal and go by name.
    """
    keys = [*by, "feature"]
    horizons = list(HORIZONS)
    wide = ics.groupBy(*keys).pivot("horizon", horizons).agg(F.first("ic"))
    wide = wide.withColumnsRenamed({str(h): f"ic_{h}d" for h in horizons})
    joined = wide.join(ic_half_life(ics, by), keys, "left")
    order = [F.desc_nulls_last(F.round(F.abs("ic_1d"), 9)), F.asc("feature")]
    if top is None:
        return joined.orderBy(*order)
    if not by:
        return joined.orderBy(*order).limit(top)
    # one row per feature in each group
    ranked = joined.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_r") <= top).drop("_r")
