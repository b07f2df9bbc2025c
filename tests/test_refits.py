"""Variants fitted in shared jobs: sizes, held-out accuracy and the shuffled labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import refits
from tidepanel.operators.boosting import Boost

FEATURES = ["f0", "f1", "noise", "flat"]
SMALL = Boost(20, 2, 0.2)


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in ("A", "B"):
        for i in range(400):
            x = rng.normal(size=3)
            y = None if i % 50 == 7 else float(rng.random() < 1 / (1 + math.exp(-3 * (x[0] + x[1]))))
            rows.append((t, i, *map(float, x), 3.0, y, 1.0))
    df = spark.createDataFrame(rows, "ticker string, i int, f0 double, f1 double, noise double, flat double, target_direction double, regime_trend_bullish double")
    return df.withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i").cache()


def test_thirds_learn(learnable):
    n = learnable.filter("target_direction is not null").count()
    out = {r["label"]: r for r in refits.time_stability(learnable, FEATURES, SMALL).collect()}
    assert list(sorted(out)) == ["Early", "Late", "Mid"]
    for label, size in (("Early", n // 3), ("Mid", n // 3), ("Late", n - 2 * (n // 3))):
        assert out[label]["n"] == math.floor(size * 0.7) and out[label]["n_test"] == size - out[label]["n"]
        assert out[label]["accuracy"] > 0.7
    assert len({r["degrades"] for r in out.values()}) == 1


def test_subsets(learnable):
    out = {r["label"]: r for r in refits.feature_subset_stability(learnable, FEATURES, SMALL).collect()}
    assert set(out) == set(refits.SUBSETS) and len({r["n_test"] for r in out.values()}) == 1
    # the two features that carry the label are the better half
    assert out["Top 50% Features"]["auc"] > 0.85 and out["Full Features"]["auc"] > 0.85


def test_shuffled_labels_lose_the_edge(learnable):
    r = refits.label_shuffle_test(learnable, FEATURES, SMALL).first()
    assert r["real"] > 0.75 and abs(r["shuffled"] - 0.5) < 0.2 and r["verdict"] in ("PASS", "WARN")
    assert (r["n_real"], r["n_pos_real"], r["n_test_real"]) == (r["n_shuffled"], r["n_pos_shuffled"], r["n_test_shuffled"])


def test_one_class_has_no_row(learnable):
    assert refits.time_stability(learnable.withColumn("target_direction", F.lit(1.0)), FEATURES, SMALL).count() == 0
