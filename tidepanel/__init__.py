"""Panel time-series features, signals and portfolio analytics as Spark DataFrame operators."""

from tidepanel.functions.series import DAILY, Series

__all__ = ["DAILY", "Series"]
