"""Registry of queries: a Spark function, the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _split(c: str, digits: int) -> tuple[str, int]:
    """A column may name its own digits: ``sma_200:8``."""
    name, _, own = c.partition(":")
    return name, int(own) if own else digits


def _rounded(c: str, digits: int) -> Column:
    c, digits = _split(c, digits)
    r = F.round(F.col(c).cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)


def _rounded_sql(c: str, digits: int) -> str:
    c, digits = _split(c, digits)
    r = f"round(cast({c} as double), {digits})"
    return f"case when {r} = 0 then cast(0 as double) else {r} end as {c}"


def add(
    name: str,
    ids: str,
    run: Callable[[SparkSession, str], DataFrame],
    sql: tuple[str, str] | None = None,
    keys: str = "ticker dt",
    ints: str = "",
    doubles: str = "",
    digits: int = 6,
) -> None:
    """Register a query.  sql is (WITH clause, select); both sides get the same typed columns."""
    k, i, d = keys.split(), ints.split(), doubles.split()

    def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(
            *k, *[F.col(c).cast("long").alias(c) for c in i], *[_rounded(c, digits) for c in d]
        )

    text = None
    if sql is not None:
        columns = [*k, *[f"cast({c} as bigint) as {c}" for c in i], *[_rounded_sql(c, digits) for c in d]]
        text = f"{sql[0]}\nselect {', '.join(columns)}\nfrom (\n{sql[1]}\n) q"
    REGISTRY[name] = Query(ids, checked, text)
