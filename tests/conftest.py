import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepanel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="6g")
    # small inputs: generating classes costs more than it saves
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


def walk(tickers=("A", "B"), n=300, seed=42) -> pd.DataFrame:
    """Random OHLCV series on business days."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, t in enumerate(tickers):
        close = 100 + np.cumsum(rng.normal(0, 0.5, n + 17 * i))
        days = pd.bdate_range("2020-01-01", periods=len(close)).date
        spread = np.abs(rng.normal(0, 0.5, len(close)))
        parts.append(
            pd.DataFrame(
                {
                    "ticker": t, "dt": days, "open": close + rng.normal(0, 0.1, len(close)), "high": close + spread,
                    "low": close - spread, "close": close, "volume": rng.integers(1_000_000, 10_000_000, len(close)).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


SCHEMA = "ticker string, dt date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def frame() -> pd.DataFrame:
    return walk()


@pytest.fixture(scope="session")
def bars(spark, frame):
    return spark.createDataFrame(frame, SCHEMA).cache()


def closes(spark, values, ticker="X", start="2020-01-01"):
    days = pd.bdate_range(start, periods=len(values)).date
    rows = [(ticker, d, c, c * 1.01, c * 0.99, c, 1e6) for d, c in zip(days, map(float, values))]
    return spark.createDataFrame(rows, SCHEMA)


def ordered(df, *columns):
    return df.orderBy("ticker", "dt").select(*columns).toPandas()
