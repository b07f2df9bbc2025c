"""Small helpers for steps that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids (a few bytes each) up to which a side of a join is sent to all tasks.
BROADCAST_ROWS = 1_000_000


def small_side(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """``ids``, broadcast if counting shows that it is small; else the join shuffles both sides."""
    rows = ids.count() if rows is None else rows
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids.hint("merge")


#: A key is hot if it has more than this share of all rows; so there are fewer than its inverse.
HOT_SHARE = 1 / 512


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``facts`` of their key; ``size`` is the key's number of rows, of ``total``.

    Facts of hot keys, of which there is a bounded number, are broadcast, so that no task gets the rows of one;
    the others are joined by a shuffle.
    """
    hot, rest = facts.filter(F.col(size) > total * HOT_SHARE), facts.filter(F.col(size) <= total * HOT_SHARE)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(rest.hint("merge"), key))
