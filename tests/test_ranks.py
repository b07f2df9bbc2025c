"""Exact ranks and quantiles when one value or one group dominates."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.functions.ranks import average_rank, dealt, quantiles, tie_order


def data(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1e-3, 700), np.zeros(600), rng.normal(50, 400, 200), [-1e9, 1e9]])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(x)) % 3 == 0, "hot", "b"), "id": range(len(x)), "x": x})
    return pdf, spark.createDataFrame(pdf)


def test_average_rank(spark):
    pdf, df = data(spark)
    out = average_rank(df, ["g"], "x", "r").orderBy("id").toPandas()
    np.testing.assert_allclose(out["r"], pdf.groupby("g")["x"].rank())


def test_quantiles(spark):
    pdf, df = data(spark)
    out = quantiles(df, ["g"], "x", {"q05": 0.05, "q50": 0.5, "q99": 0.99}).toPandas().set_index("g")
    for q, c in ((0.05, "q05"), (0.5, "q50"), (0.99, "q99")):
        for g, part in pdf.groupby("g"):
            assert abs(out.loc[g, c] - np.quantile(part["x"], q)) < 1e-9


def test_parts_rise_with_crowded_values(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": rng.uniform(0.99, 1.01, 4000)}))
    out = dealt(df, ["g"], "x").orderBy("x").toPandas()
    assert out["_part"].is_monotonic_increasing
    assert out["_part"].value_counts().max() < 4000 / 2


def test_names_with_a_common_start(spark):
    df = spark.range(20_000).selectExpr("'d' as g", "concat('STOCKNAME0', lpad(id, 6, '0')) as name", "id")
    out = tie_order(df, ["g"], "name", "k")
    assert out.filter("k <> id").count() == 0 and out.count() == 20_000


def test_tie_order(spark):
    names = [f"{p}{i:03d}" for p in ("aaa", "aab", "b", "Z") for i in range(40)]
    df = spark.createDataFrame([("d", n) for n in names], "g string, name string")
    out = tie_order(df, ["g"], "name", "k").toPandas().set_index("name")["k"]
    assert [out[n] for n in sorted(names)] == list(range(len(names)))
