"""Boosted trees of all folds and sides at once, on histograms of gradients.

Features are cut into bins once.  A tree grows level by level: gradients and second derivatives are summed by (set, node,
feature, bin), and every node takes the cut that lowers the penalised loss most.  A set (fold, bull) of
at most GROUP_ROWS rows is fitted where its rows lie, all sets in one job; for larger sets every level is one
job over all rows, whose partial histograms are added up by (set, node).  Both run the same steps on
integer sums, so they give the same trees.

Trees are a table: one row per set with, for each tree, its nodes in heap order (children of n are 2n and 2n + 1).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.operators.fitting import SET

BINS, GROUP_ROWS, TREES_A_TABLE = 32, 200_000, 10
#: Gradients are whole multiples of 1/UNIT, so that their sums do not depend on the order; exact up to 2^26 rows a task.
UNIT = float(1 << 26)
LEAF = -1


@dataclass(frozen=True)
class Boost:
    """A learner: number and depth of trees, learning rate, least rows and second derivative of a leaf, penalty on leaves, share of rows a tree sees."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    leaf: int = 1
    weight: float = 1.0
    l2: float = 1.0
    subsample: float = 1.0


# The two boosted learners
BOOST_A = Boost(100, 3, 0.1)
BOOST_B = Boost(100, 5, 0.05, leaf=20, weight=1e-3, l2=0.0)


# ---------------------------------------------------------------------------------------------
# bins


def bin_edges(rows: DataFrame, features: int, bins: int = BINS) -> np.ndarray:
    """Upper ends of the bins but the last, per feature: quantiles of all rows of ``x`` (labels play no part)."""
    cuts = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), cuts, 10_000).alias(f"e{i}") for i in range(features)]).first()
    # an empty table has no quantiles
    return np.array([sorted(e or [0.0] * (bins - 1)) for e in found], np.float64).reshape(features, bins - 1)


def binned(sets: DataFrame, edges: np.ndarray) -> DataFrame:
    """The sets with ``bins`` (a byte per feature) in place of ``x``."""
    sent = sets.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        edges = sent.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.empty(x.shape, np.uint8)
            for f in range(x.shape[1]):
                out[:, f] = np.searchsorted(edges[f], x[:, f], side="left")
            cells = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*SET, "row", "y")], cells], [*SET, "row", "y", "bins"])

    return sets.select(*SET, "row", "y", "x").mapInArrow(run, "fold int, bull boolean, row long, y double, bins binary")


# ---------------------------------------------------------------------------------------------
# one level of trees


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * UNIT), np.rint(p * (1.0 - p) * UNIT)


def sampled(row: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by a hash of row and tree."""
    if share >= 1:
        return np.ones(len(row), bool)
    x = row.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(33)).astype(np.float64) < share * float(1 << 31)


def histograms(bins: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows, gradients and second derivatives by (slot, feature, bin), as whole numbers."""
    n, features = bins.shape
    at = (slot[:, None] * features + np.arange(features)) * BINS + bins
    size = slots * features * BINS
    at = at.ravel()
    parts = [np.bincount(at, minlength=size), *[np.bincount(at, weights=np.repeat(w, features), minlength=size) for w in (g, h)]]
    return np.stack([p.astype(np.int64) for p in parts]).reshape(3, slots, features, BINS)


def splits(hist: np.ndarray, p: Boost) -> list[tuple | None]:
    """Per slot the best cut (feature, bin, gain, sums left, sums right), ties to the first; None if no cut helps."""
    left = hist.cumsum(axis=3)[:, :, :, :-1]
    whole = hist[:, :, :1, :].sum(axis=3, keepdims=True)
    right = whole - left
    value = lambda s: (s[1] / UNIT) ** 2 / (s[2] / UNIT + p.l2 + 1e-12)
    gain = 0.5 * (value(left) + value(right) - value(whole))
    ok = np.ones(gain.shape, bool)
    for s in (left, right):
        ok &= (s[0] >= max(1, p.leaf)) & (s[2] >= p.weight * UNIT)
    gain = np.where(ok, gain, -1.0).reshape(hist.shape[1], -1)
    out: list[tuple | None] = []
    for slot, at in enumerate(gain.argmax(axis=1).tolist()):
        f, b = divmod(at, BINS - 1)
        best = float(gain[slot, at])
        out.append((f, b, best, left[:, slot, f, b].tolist(), right[:, slot, f, b].tolist()) if best > 1e-9 else None)
    return out


class Tree:
    """Nodes in heap order; grows by the cuts of its open nodes, which are those of one level."""

    def __init__(self, sums: list[int], p: Boost):
        size = 2 << p.depth
        self.p, self.open, self.level = p, [1], 0
        self.feature, self.bin = np.full(size, LEAF, np.int32), np.zeros(size, np.int32)
        self.value, self.rows, self.gain = np.zeros(size), np.zeros(size, np.int64), np.zeros(size)
        self.sums = {1: sums}
        self._settle(1)

    def _settle(self, node: int) -> None:
        n, g, h = self.sums[node]
        self.rows[node] = n
        self.value[node] = -self.p.rate * (g / UNIT) / (h / UNIT + self.p.l2 + 1e-12)

    def grow(self, cuts: list[tuple | None]) -> None:
        below = []
        for node, cut in zip(self.open, cuts):
            if cut:
                self.feature[node], self.bin[node], self.gain[node] = cut[:3]
                for child, sums in ((2 * node, cut[3]), (2 * node + 1, cut[4])):
                    self.sums[child] = sums
                    self._settle(child)
                    below.append(child)
        self.level += 1
        self.open = below if self.level < self.p.depth else []

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        node = np.ones(len(bins), np.int64)
        at = np.arange(len(bins))
        for _ in range(self.level):
            f = self.feature[node]
            node = np.where(f == LEAF, node, 2 * node + (bins[at, f] > self.bin[node]))
        return node

    def slots(self, node: np.ndarray) -> np.ndarray:
        """Number of a node among the open ones, or -1."""
        table = np.full(len(self.feature), -1, np.int64)
        table[self.open] = np.arange(len(self.open))
        return table[node]


def start(n: int, pos: int) -> float:
    return float(np.log(pos / (n - pos)))


def boost(bins: np.ndarray, y: np.ndarray, row: np.ndarray, p: Boost) -> list[Tree]:
    """All trees of one set whose rows are at hand."""
    margin, out = np.full(len(y), start(len(y), int(y.sum()))), []
    for t in range(p.trees):
        g, h = gradients(margin, y)
        seen = np.flatnonzero(sampled(row, t, p.subsample))
        tree = Tree([len(seen), int(g[seen].sum()), int(h[seen].sum())], p)
        while tree.open:
            slot = tree.slots(tree.nodes(bins[seen]))
            own = seen[slot >= 0]
            tree.grow(splits(histograms(bins[own], slot[slot >= 0], len(tree.open), g[own], h[own]), p))
        margin += tree.value[tree.nodes(bins)]
        out.append(tree)
    return out


# ---------------------------------------------------------------------------------------------
# all sets

TREES = (
    "model string, fold int, bull boolean, n long, n_pos long, depth int, base double, "
    "trees array<struct<feature: array<int>, threshold: array<double>, value: array<double>, rows: array<long>, gain: array<double>>>"
)
_TREE_TYPE = pa.list_(
    pa.struct(
        [("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("value", pa.list_(pa.float64())), ("rows", pa.list_(pa.int64())), ("gain", pa.list_(pa.float64()))]
    )
)


def _row(model: str, fold: int, bull: bool, n: int, pos: int, p: Boost, trees: list[Tree], edges: np.ndarray) -> dict:
    def cut(t: Tree) -> list:
        inner = t.feature != LEAF
        out = np.zeros(len(inner))
        out[inner] = edges[t.feature[inner], t.bin[inner]]
        return out.tolist()

    cells = [{"feature": t.feature.tolist(), "threshold": cut(t), "value": t.value.tolist(), "rows": t.rows.tolist(), "gain": t.gain.tolist()} for t in trees]
    return {"model": model, "fold": fold, "bull": bull, "n": n, "n_pos": pos, "depth": p.depth, "base": start(n, pos), "trees": cells}


_ROW_TYPE = pa.schema(
    [("model", pa.string()), ("fold", pa.int32()), ("bull", pa.bool_()), ("n", pa.int64()), ("n_pos", pa.int64()), ("depth", pa.int32()), ("base", pa.float64()), ("trees", _TREE_TYPE)]
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)


def learner_of(learners: dict, name: str, fold: int) -> Boost | None:
    """A learner may differ by fold: ``{name: Boost}`` or ``{name: {fold: Boost}}``."""
    own = learners[name]
    return own.get(fold) if isinstance(own, dict) else own


def fit_boosting(sets: DataFrame, sizes: DataFrame, learners: dict, edges: np.ndarray, group_rows: int | None = None) -> DataFrame:
    """Trees of every learner and set; columns as in TREES.

    ``sets`` (fold, bull, row, y, x, or bins if they are cut already) and ``sizes`` (fold, bull, n, n_pos) are those of ``fitting``; ``learners`` maps names to a Boost,
    or to one per fold.
    """
    spark = sets.sparkSession
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    sent = spark.sparkContext.broadcast(edges)
    names = sorted(learners)
    rows = sets if "bins" in sets.columns else binned(sets, edges)
    small = sizes.filter(F.col("n") <= group_rows).select(*SET)
    model = F.explode(F.array(*[F.lit(m) for m in names])).alias("model")

    def whole(table: pa.Table) -> pa.Table:
        name, fold, bull = (table.column(c)[0].as_py() for c in ("model", *SET))
        p = learner_of(learners, name, fold)
        if p is None:
            return pa.Table.from_pylist([], _ROW_TYPE)
        y, row = table.column("y").to_numpy(), table.column("row").to_numpy()
        trees = boost(_matrix(table.column("bins")), y, row, p)
        return pa.Table.from_pylist([_row(name, fold, bull, len(y), int(y.sum()), p, trees, sent.value)], _ROW_TYPE)

    own = rows.join(F.broadcast(small), list(SET), "left_semi").select(model, *SET, "row", "y", "bins")
    out = own.groupBy("model", *SET).applyInArrow(whole, TREES)
    large = {(r["fold"], r["bull"]): (r["n"], r["n_pos"]) for r in sizes.filter(F.col("n") > group_rows).collect()}
    if large:
        rest = rows.join(F.broadcast(sizes.filter(F.col("n") > group_rows).select(*SET)), list(SET), "left_semi")
        rest = materialise(rest, "binned")
        for name in names:
            out = out.unionByName(_fit_large(rest, large, name, learners, edges))
    return materialise(out, "trees")


def _fit_large(rows: DataFrame, large: dict, name: str, learners: dict, edges: np.ndarray) -> DataFrame:
    """Level by level over all rows; margins are written anew every TREES_A_TABLE trees, so a pass adds up few trees only."""
    spark = rows.sparkSession
    learner = {k: learner_of(learners, name, k[0]) for k in large}
    learner = {k: p for k, p in learner.items() if p is not None}
    done: dict = {k: [] for k in learner}
    base = spark.createDataFrame([(*k, start(*large[k])) for k in learner], "fold int, bull boolean, margin double")
    rows = rows.join(F.broadcast(base), list(SET))
    features = edges.shape[0]
    for t in range(max((p.trees for p in learner.values()), default=0)):
        if t and t % TREES_A_TABLE == 0:
            rows = materialise(rows.mapInArrow(_moved(spark, {k: v[t - TREES_A_TABLE : t] for k, v in done.items()}), rows.schema), "margins")
        recent = {k: v[t - t % TREES_A_TABLE :] for k, v in done.items() if learner[k].trees > t}
        growing: dict = {k: None for k in recent}
        while any(tree is None or tree.open for tree in growing.values()):
            sent = spark.sparkContext.broadcast((recent, {k: v for k, v in growing.items() if v is None or v.open}, {k: learner[k] for k in recent}, t))
            sums = rows.mapInArrow(_level(sent, features), "fold int, bull boolean, node int, sums binary")
            cuts = sums.groupBy(*SET, "node").applyInArrow(_cut(sent, features), "fold int, bull boolean, node int, whole array<long>, cut string").collect()
            _grown(growing, cuts, learner)
            sent.unpersist()
        for k, tree in growing.items():
            done[k].append(tree)
    cells = [_row(name, *k, *large[k], learner[k], done[k], edges) for k in learner]
    return spark.createDataFrame(pa.Table.from_pylist(cells, _ROW_TYPE)).select(*[c.split()[0] for c in TREES.split(", ")[:7]], "trees")


def _grown(growing: dict, cuts: list, learner: dict) -> None:
    found: dict = {}
    for r in cuts:
        found[(r["fold"], r["bull"], r["node"])] = (list(r["whole"]), json.loads(r["cut"]))
    for k, tree in growing.items():
        if tree is None:
            # no row was sampled: a tree of one leaf without weight
            whole, cut = found.get((*k, 1), ([0, 0, 0], None))
            tree = growing[k] = Tree(whole, learner[k])
            tree.grow([cut])
        elif tree.open:
            tree.grow([found.get((*k, n), (None, None))[1] for n in tree.open])


def _keys(batch: pa.RecordBatch):
    fold, bull = (batch.column(c).to_numpy(zero_copy_only=False) for c in SET)
    code = fold.astype(np.int64) * 2 + bull.astype(np.int64)
    for c in np.unique(code).tolist():
        yield (c // 2, bool(c % 2)), np.flatnonzero(code == c)


def _moved(spark, trees: dict):
    sent = spark.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            margin = batch.column("margin").to_numpy().copy()
            for k, own in _keys(batch):
                bins = _matrix(batch.column("bins").take(pa.array(own)))
                for tree in sent.value.get(k, ()):
                    margin[own] += tree.value[tree.nodes(bins)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return run


def _level(sent, features: int):
    """Sums of the open nodes, one row per set and node for each task."""

    def run(batches):
        recent, growing, learner, t = sent.value
        total: dict = {}
        for batch in batches:
            for k, own in _keys(batch):
                if k not in growing:
                    continue
                part = batch.take(pa.array(own))
                bins, y, row = _matrix(part.column("bins")), part.column("y").to_numpy(), part.column("row").to_numpy()
                margin = part.column("margin").to_numpy().copy()
                for tree in recent[k]:
                    margin += tree.value[tree.nodes(bins)]
                g, h = gradients(margin, y)
                tree = growing[k]
                slot = np.zeros(len(y), np.int64) if tree is None else tree.slots(tree.nodes(bins))
                slot[~sampled(row, t, learner[k].subsample)] = -1
                use = slot >= 0
                nodes = [1] if tree is None else tree.open
                hist = histograms(bins[use], slot[use], len(nodes), g[use], h[use])
                for i, node in enumerate(nodes):
                    at = (*k, node)
                    total[at] = total[at] + hist[:, i] if at in total else hist[:, i].copy()
        for (fold, bull, node), hist in total.items():
            if hist[0].any():
                yield pa.RecordBatch.from_pylist(
                    [{"fold": fold, "bull": bull, "node": node, "sums": hist.tobytes()}],
                    pa.schema([("fold", pa.int32()), ("bull", pa.bool_()), ("node", pa.int32()), ("sums", pa.binary())]),
                )

    return run


def _cut(sent, features: int):
    def run(table: pa.Table) -> pa.Table:
        fold, bull, node = (table.column(c)[0].as_py() for c in (*SET, "node"))
        hist = sum(np.frombuffer(s, np.int64).reshape(3, 1, features, BINS) for s in table.column("sums").to_pylist())
        cut = splits(hist, sent.value[2][(fold, bull)])[0]
        row = {"fold": fold, "bull": bull, "node": node, "whole": hist[:, 0, 0].sum(axis=1).tolist(), "cut": json.dumps(cut)}
        return pa.Table.from_pylist(
            [row], pa.schema([("fold", pa.int32()), ("bull", pa.bool_()), ("node", pa.int32()), ("whole", pa.list_(pa.int64())), ("cut", pa.string())])
        )

    return run


# ---------------------------------------------------------------------------------------------
# scores from the table


def leaf_of(tree: Column, depth: Column, x: str = "x") -> Column:
    """The node a row ends in; built-in functions only."""
    step = lambda n, _: F.when(
        F.get(tree["feature"], n) == LEAF, n
    ).otherwise(2 * n + (F.get(x, F.get(tree["feature"], n)) > F.get(tree["threshold"], n)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), depth), F.lit(1), step)


def raw_score() -> Column:
    """Base plus the leaves of all trees, for a row joined with its set's trees."""
    return F.aggregate("trees", F.col("base"), lambda acc, t: acc + F.get(t["value"], leaf_of(t, F.col("depth"))))


def score_boosting(rows: DataFrame, trees: DataFrame, name: str) -> DataFrame:
    """Add raw_, pred_ and proba_ to the rows (fold, bull, x) whose set was fitted; one row of trees per set is broadcast."""
    own = trees.filter(F.col("model") == name).select(*SET, "depth", "base", "trees")
    out = rows.join(F.broadcast(own), list(SET)).withColumn(f"raw_{name}", raw_score()).drop("depth", "base", "trees")
    out = out.withColumn(f"proba_{name}", 1.0 / (1.0 + F.exp(-F.col(f"raw_{name}"))))
    return out.withColumn(f"pred_{name}", (F.col(f"proba_{name}") > 0.5).cast("double"))


def leaf_check(sets: DataFrame, trees: DataFrame, name: str, p: Boost) -> DataFrame:
    """Leaves and losses recomputed from the table by joins and sums alone, for learners that see all rows.

    fold, bull, n, n_pos, trees, worst (largest difference between a stored leaf and minus rate times gradients over second
    derivatives plus penalty), loss and start_loss (mean log loss after the last tree and before the first).
    """
    own = trees.filter(F.col("model") == name).select(*SET, "depth", "base", "trees")
    joined = sets.select(*SET, "y", "x").join(F.broadcast(own), list(SET))
    # per tree: the score before it, and the leaf
    first = F.struct(F.col("base").alias("before"), F.lit(0).alias("leaf"), F.lit(0.0).alias("value"))
    path = F.aggregate(
        "trees",
        F.array(first),
        lambda acc, t: F.array_append(
            acc, F.struct((F.get(acc, F.size(acc) - 1)["before"] + F.get(acc, F.size(acc) - 1)["value"]).alias("before"), leaf_of(t, F.col("depth")).alias("leaf"), F.get(t["value"], leaf_of(t, F.col("depth"))).alias("value"))
        ),
    )
    steps = joined.select(*SET, "y", "base", F.posexplode(path).alias("tree", "s")).select(*SET, "y", "base", "tree", "s.*")
    p_before = 1.0 / (1.0 + F.exp(-F.col("before")))
    leaves = steps.filter("tree > 0").groupBy(*SET, "tree", "leaf").agg(
        F.sum(p_before - F.col("y")).alias("g"), F.sum(p_before * (1.0 - p_before)).alias("h"), F.max("value").alias("value"), F.count("*").alias("rows"),
        F.sum(_loss(F.col("before") + F.col("value"))).alias("after"), F.sum(_loss(F.col("base"))).alias("at_base"),
    )
    leaves = leaves.withColumn("error", F.abs(F.col("value") + p.rate * F.col("g") / (F.col("h") + p.l2 + 1e-12)))
    by_tree = leaves.groupBy(*SET, "tree").agg(F.max("error").alias("error"), F.sum("after").alias("after"), F.sum("at_base").alias("at_base"), F.sum("rows").alias("n"))
    sums = by_tree.groupBy(*SET).agg(
        F.count("*").alias("trees"), F.max("error").alias("worst"), F.max_by("after", "tree").alias("_after"), F.max("at_base").alias("_base"), F.max("n").alias("n")
    )
    pos = sets.groupBy(*SET).agg(F.sum("y").cast("long").alias("n_pos"))
    return sums.join(pos, list(SET)).select(
        *SET, "n", "n_pos", "trees", "worst", (F.col("_after") / F.col("n")).alias("loss"), (F.col("_base") / F.col("n")).alias("start_loss")
    )


def _loss(margin: Column) -> Column:
    return F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - F.col("y") * margin


def gains(trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """model, feature, gain: the loss that each feature's cuts took away, over all sets and trees."""
    cuts = trees.select("model", F.explode("trees").alias("t")).select("model", F.explode(F.arrays_zip("t.feature", "t.gain")).alias("c"))
    sums = cuts.filter(F.col("c.feature") >= 0).groupBy("model", F.col("c.feature").alias("i")).agg(F.sum("c.gain").alias("gain"))
    names = trees.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    every = trees.select("model").distinct().join(F.broadcast(names))
    return every.join(sums, ["model", "i"], "left").select("model", "feature", F.coalesce("gain", F.lit(0.0)).alias("gain"))
