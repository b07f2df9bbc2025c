"""Joins of a panel with small tables whose size is known from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_date(df: DataFrame, dated: DataFrame, on: str = "dt", how: str = "left") -> DataFrame:
    """Join a table with one row per date.

    A DATE key bounds it by the calendar, so it is broadcast; with a finer key its size is not
    known and the join strategy is left to the adaptive planner.
    """
    if isinstance(dated.schema[on].dataType, T.DateType):
        dated = F.broadcast(dated)
    return df.join(dated, on, how)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the single row of an aggregate without keys to every row."""
    one = F.broadcast(totals.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
