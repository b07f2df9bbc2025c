"""What each feature adds to the score of a boosted model, row by row and exact.

A leaf belongs to the rows that pass all cuts on its path.  With p features on the path, a subset of them known
and the others replaced by the share of training rows that took the path's side, the leaf's weighted contribution to feature i
is its value times (o_i - z_i) times the sum over the subsets of the others, weighted by subset size.  That sum is
read off the coefficients of the product of (z_j + o_j t) over the others, so the work per leaf grows with the square of
the path length, not with the subsets.  Contributions and the mean score add up to the raw score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.series import DAILY, Series
from tidepanel.operators.boosting import LEAF, raw_score
from tidepanel.operators.fitting import SET

GROUP_ROWS, CELLS, PRUNE = 20_000, 1 << 21, 1e-4


def paths(trees: list[dict]) -> tuple[float, dict[int, tuple]]:
    """Mean of the trees' scores, and per path length p the leaves: features (leaves x p), lower and upper ends, shares, values."""
    mean, found = 0.0, defaultdict(list)
    for t in trees:
        feature, threshold, value, rows = t["feature"], t["threshold"], t["value"], t["rows"]
        stack: list[tuple[int, float, dict]] = [(1, 1.0, {})]
        while stack:
            node, share, cuts = stack.pop()
            f = feature[node]
            if f == LEAF:
                mean += value[node] * share
                if cuts:
                    found[len(cuts)].append((list(cuts), *zip(*cuts.values()), value[node]))
                continue
            for child, low, high in ((2 * node, -np.inf, threshold[node]), (2 * node + 1, threshold[node], np.inf)):
                part = rows[child] / rows[node]
                a, b, z = cuts.get(f, (-np.inf, np.inf, 1.0))
                stack.append((child, share * part, {**cuts, f: (max(a, low), min(b, high), z * part)}))
    return mean, {p: tuple(np.array(c) for c in zip(*leaves)) for p, leaves in found.items()}


def contributions(x: np.ndarray, leaves: dict[int, tuple]) -> np.ndarray:
    """Rows x features."""
    n, width = x.shape
    out = np.zeros(n * width)
    for p, (feature, low, high, share, value) in leaves.items():
        weight = [factorial(k) * factorial(p - 1 - k) / factorial(p) for k in range(p)]
        step = max(1, CELLS // max(1, n * p))
        for at in range(0, len(value), step):
            f, z, v = feature[at : at + step], share[at : at + step], value[at : at + step]
            cells = x[:, f]
            o = ((cells > low[at : at + step]) & (cells <= high[at : at + step])).astype(np.float64)
            for i in range(p):
                poly = [np.ones(o.shape[:2])]
                for j in range(p):
                    if j != i:
                        low_part = [c * z[:, j] for c in poly] + [0.0]
                        high_part = [0.0] + [c * o[:, :, j] for c in poly]
                        poly = [a + b for a, b in zip(low_part, high_part)]
                part = v * (o[:, :, i] - z[:, i]) * sum(w * c for w, c in zip(weight, poly))
                place = (np.arange(n)[:, None] * width + f[:, i]).ravel()
                out += np.bincount(place, weights=part.ravel(), minlength=len(out))
    return out.reshape(n, width)


def attribute(rows: DataFrame, trees: DataFrame, model: str, s: Series = DAILY) -> DataFrame:
    """Keys, order, fold, bull, raw, mean (the score with nothing known), phi (array: what each feature adds).

    ``rows`` (keys, order, fold, bull, x) meet the trees of their set in groups of about GROUP_ROWS.
    """
    own = trees.filter(F.col("model") == model).select(*SET, "depth", "base", "trees")
    counts = rows.groupBy(*SET).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_parts"))
    keyed = rows.withColumn("_row", F.xxhash64(*s.keys, s.order)).join(F.broadcast(counts), list(SET))
    keyed = keyed.join(F.broadcast(own), list(SET)).withColumn("raw", raw_score()).drop("depth", "base", "trees")
    keyed = keyed.withColumn("_part", F.pmod("_row", "_parts")).select(*s.keys, s.order, *SET, "_part", "raw", "x")
    dealt = own.join(F.broadcast(counts), list(SET)).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.drop_columns(["_part", "x"])
        if not left.num_rows:
            return out.append_column("mean", pa.array([], pa.float64())).append_column("phi", pa.array([], pa.list_(pa.float64())))
        x = np.array(left.column("x").combine_chunks().flatten()).reshape(left.num_rows, -1)
        mean, leaves = paths(right.column("trees")[0].as_py())
        phi = contributions(x, leaves)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(left.num_rows + 1) * x.shape[1], pa.int32()), pa.array(phi.ravel()))
        out = out.append_column("mean", pa.array(np.full(left.num_rows, mean + right.column("base")[0].as_py())))
        return out.append_column("phi", cells)

    kept = keyed.drop("_part", "x").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", mean double, phi array<double>"
    return keyed.groupBy(*SET, "_part").cogroup(dealt.select(*SET, "_part", "base", "trees").groupBy(*SET, "_part")).applyInArrow(run, schema)


def importance(attributed: DataFrame, features: Sequence[str], threshold: float = PRUNE) -> DataFrame:
    """feature, mean_abs (mean absolute contribution), rank, prunable (below ``threshold``)."""
    sums = attributed.select(F.posexplode("phi").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs"))
    names = attributed.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    return sums.join(F.broadcast(names), "i").select(
        "feature", "mean_abs", F.expr("rank() over (order by mean_abs desc)").alias("rank"), (F.col("mean_abs") < threshold).cast("int").alias("prunable")
    )
