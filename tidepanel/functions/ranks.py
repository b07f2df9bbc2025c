"""Exact ranks and quantiles of large groups without sorting a group in one task.

Equal values are first counted (a partial aggregate collapses ties before the shuffle), then dealt
out by range over (group, value) and ranked within each part.  Ranges come from a sample of the
values, so a crowded stretch is cut as often as its rows ask for; over a whole group only one count
per part is accumulated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.series import Series
from tidepanel.functions.tables import materialise

def dealt(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Written table with ``_part``, which rises with ``value`` inside a group; equal values share one."""
    df = df.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id())
    # the parts must be the same for the counts and for the rows, so they are written
    return materialise(df, "dealt")


def value_counts(df: DataFrame, groups: list[str], value: str, aggs: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with its 0-based positions ``[lo, hi)`` in its group.

    ``aggs`` adds further aggregates of the rows of each value.
    """
    aggs = aggs or {}
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(o) for o, c in aggs.items()])
    counts = dealt(counts, groups, value)
    totals = counts.groupBy(*groups, "_part").agg(F.sum("n").alias("_bn"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_part", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    in_part = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_cum", F.sum("n").over(in_part)).join(totals, [*groups, "_part"])
    hi = F.col("_off") + F.col("_cum")
    return ranked.select(*groups, value, "n", (hi - F.col("n")).alias("lo"), hi.alias("hi"), *aggs)


def average_rank(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank (from 1, ties share the mean) of ``value`` within ``groups``.

    The join back is on (groups, value); a value shared by very many rows is split by the
    adaptive skew join, the rank side having one row per distinct value.
    """
    ranks = value_counts(df, groups, value).select(
        *groups, value, (F.col("lo") + (F.col("n") + 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*groups, value], "left")


def quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per group: ``{out: q}``."""
    ranked = value_counts(df, groups, value)
    size = ranked.groupBy(*groups).agg(F.sum("n").alias("_size"))
    joined = ranked.join(size, groups)
    aggs = []
    for out, q in qs.items():
        at = (F.col("_size") - 1) * F.lit(q)
        for side, pos in (("l", F.floor(at)), ("h", F.ceil(at))):
            here = (F.col("lo") <= pos) & (pos < F.col("hi"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{out}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f_{out}"))
    result = joined.groupBy(*groups).agg(*aggs)
    return result.select(
        *groups,
        *[
            (F.col(f"_l_{o}") + F.col(f"_f_{o}") * (F.col(f"_h_{o}") - F.col(f"_l_{o}"))).alias(o)
            for o in qs
        ],
    )


def series_quantiles(df: DataFrame, s: Series, value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles per series: one aggregate for DATE-keyed series, value buckets beyond."""
    if s.block_rows(df):
        return quantiles(df, list(s.keys), value, qs)
    return df.groupBy(*s.keys).agg(*[F.percentile(value, q).alias(o) for o, q in qs.items()])


def tie_order(df: DataFrame, groups: list[str], name: str, out: str) -> DataFrame:
    """Add the position (from 0) of a string within ``groups``, in string order."""
    df = dealt(df, groups, name)
    counts = df.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"))
    local = df.withColumn("_i", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(name)) - 1)
    return local.join(offsets, [*groups, "_part"]).withColumn(out, F.col("_off") + F.col("_i")).drop("_part", "_off", "_i")
