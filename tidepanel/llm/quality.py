"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each chosen pair of features.  The
tables are learnt by cyclic boosting: in turn, every feature gets a small step of a shallow tree that
sees this feature alone.  Scoring adds one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.text import SPACE_WORD, Rolling, Texts, held_out, texts

#: Bound on labelled rows that a model is fitted on: the rows whose hash of the id is smallest.
FIT_ROWS = 20_000
THRESHOLD = 0.7

CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "pipe", "exclaim", "symbol", "high")
NAMES = (
    "log_bytes", *[f"{c}_share" for c in CLASSES], "log_words", "word_bytes", "repeat_share", "symbol_end_share", "capital_share", "bytes_per_line",
)


def _classes() -> np.ndarray:
    kind = np.full(256, CLASSES.index("symbol"))
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    kind[[ord(c) for c in ".,;:'\"?()-"]] = CLASSES.index("stop")
    kind[ord("|")], kind[ord("!")] = CLASSES.index("pipe"), CLASSES.index("exclaim")
    kind[128:] = CLASSES.index("high")
    return kind


KIND = _classes()
#: Three counters of 21 bits to a number, so that one running sum counts three classes.
PACKED = [np.array([1 << 21 * (k - at) if at <= k < at + 3 else 0 for k in KIND], np.int64) for at in range(0, len(CLASSES), 3)]
SYMBOL = np.isin(KIND, [CLASSES.index(c) for c in ("symbol", "pipe", "exclaim")])
ROLLING = Rolling(0x9E3779B97F4A7C15)


def class_counts(t: Texts) -> np.ndarray:
    if len(t) == 1:  # may be longer than a counter holds
        return np.bincount(KIND[t.data], minlength=len(CLASSES))[None, :].astype(float)
    out = []
    for table in PACKED:
        sums = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum(table[t.data], out=sums[1:])
        d = np.diff(sums[t.offsets])
        out += [d >> 21 * i & (1 << 21) - 1 for i in range(3)]
    return np.stack(out[: len(CLASSES)], axis=1).astype(float)


def features(t: Texts) -> np.ndarray:
    """Rows of NAMES for every text; an empty text has zeros."""
    n, size = len(t), np.diff(t.offsets).astype(float)
    counts = class_counts(t)
    starts, ends = t.words(SPACE_WORD)
    docs = t.doc_of(starts)
    words = np.bincount(docs, minlength=n).astype(float)
    hashes = ROLLING.hashes(ROLLING.sums(t.data), starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    share = lambda flag: np.bincount(docs, weights=flag, minlength=n) / np.maximum(words, 1)
    bytes_ = np.maximum(size, 1)
    return np.column_stack(
        [
            np.log1p(size), counts / bytes_[:, None], np.log1p(words), (size - counts[:, 3] - counts[:, 4]) / np.maximum(words, 1), share(again),
            share(SYMBOL[t.data[ends - 1]]), share(KIND[t.data[starts]] == 0), size / (counts[:, 4] + 1),
        ]
    )


@dataclass
class Gam:
    """Log-odds = base + sum of tables; edges[j] cuts feature j, coarse[j] cuts it for pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Step of each bin: a tree of a few leaves on one ordered feature, split where the gain is largest."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    bounds = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = value(a, mid) + value(mid, b) - value(a, b)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, at = gain[i], int(mid[i])
        if at is None:
            break
        bounds = sorted([*bounds, at])
    out = np.empty(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one cut in each of two features."""
    cg, ch = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    best, out = 0.0, np.zeros_like(g)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    n, m = g.shape
    if n < 2 or m < 2:
        return best, out
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    part = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gs, hs = part(cg), part(ch)
    gain = sum(a**2 / (b + l2) for a, b in zip(gs, hs)) - total
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = [a[at] / (b[at] + l2) for a, b in zip(gs, hs)]
    p, q = at[0] + 1, at[1] + 1
    out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = steps
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 12, rounds: int = 150, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, l2: float = 2.0) -> Gam:
    """Without rows the score is 0.5 for all; with one class it is nearly that class's."""
    n, f = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    model = Gam(float(np.log(mean / (1 - mean))), [cuts_of(x[:, j], bins) for j in range(f)], [], [cuts_of(x[:, j], pair_bins) for j in range(f)], [], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    codes = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.edges)]
    z = np.full(n, model.base)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * shallow_tree(np.bincount(codes[j], g, len(table)), np.bincount(codes[j], h, len(table)), leaves, l2)
            table += step
            z += step[codes[j]]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)

    def grid(a, b, w):
        s = shape(a, b)
        return np.bincount(rough[a] * s[1] + rough[b], w, s[0] * s[1]).reshape(s)

    g, h = gradient()
    gains = {(a, b): quadrants(grid(a, b, g), grid(a, b, h), l2)[0] for a, b in combinations(range(f), 2)}
    model.pairs = sorted((p for p in gains if gains[p] > 1e-6), key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradient()
            step = rate * quadrants(grid(a, b, g), grid(a, b, h), l2)[1]
            table += step
            z += step[rough[a], rough[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``fit_rows`` labelled documents: those not held out whose id has the smallest hash.

    Labels that are null, or ids with different labels, are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 4))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).filter("y = most")
    some = known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(_features, "y int, x array<double>")
    got = rows.toPandas()  # bounded by fit_rows
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    y = got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y]) if len(got) else np.zeros(0, int)  # rows come in any order
    return fit(x[order], y[order])


def _features(batches):
    for t in texts(batches, limit=(1 << 20) - 1):
        x = features(t)
        yield pa.RecordBatch.from_arrays([t.rows.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def quality_scores(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score (0 to 1) of every row; empty and null texts are scored as empty ones."""

    def run(batches):
        for t in texts(batches, limit=(1 << 20) - 1):
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array(model.score(features(t)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""

    def run(batches):
        for t in texts(batches, limit=(1 << 20) - 1):
            yield t.rows.filter(pa.array(model.score(features(t)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scores = quality_scores(docs, train(docs, labels, fit_rows))
    return scores.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
