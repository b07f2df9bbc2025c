"""Exact top-k by inner product through histograms of all scores.

Components become floor(scale * x), so scores are integers.  For every query the k-th largest score
is located by histograms: the range of possible scores is cut into bins, the counts of all
partitions are added, and the bin that holds the k-th score is cut again until it is one integer wide.
A last pass returns the scores above it, and of those equal to it the smallest ids.

A partition reports its bins from the top down to its own k-th score only: the k-th score of
all rows is not below that of a part, so no lower bin can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
QUERY_ROWS = 2048
SCORE_CELLS = 4 << 20


def vectors(batch: pa.RecordBatch, scale: int, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of the rows that take part: a vector of ``dim`` finite components."""
    col = batch.column(1)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    n = len(col)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim or 0))
    lengths = np.asarray(col.value_lengths().fill_null(0))
    flat = col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    rows = lengths == dim
    starts = np.cumsum(lengths) - lengths
    m = flat[starts[rows][:, None] + np.arange(dim)] if rows.any() else np.zeros((0, dim))
    good = np.isfinite(m).all(axis=1)
    return ids[rows][good].astype(np.int64), np.floor(scale * m[good])


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``id``, score of each query's k highest scores over ``rows``.

    Ties go to the smaller id; a query's own row (same id) is no candidate; with fewer candidates
    all are returned.  Vectors that are null, hold a null or a component that is not finite, or
    differ in length from the query take no part; nor do rows with a null id.  Rows that repeat an id are
    candidates each; as a query, an id is asked once (with its smallest vector).  ``queries`` go
    through the rows in blocks of QUERY_ROWS: a block's vectors, a bounded number, are sent to the tasks,
    the rows never move.  Scores must stay below 2^53, where doubles are exact; else it raises.
    """
    spark = rows.sparkSession
    data = rows.filter(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.filter(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = asked.filter(finite & (F.size("v") > 0)).groupBy("id").agg(F.min("v").alias("v"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(F.floor(x.cast("double") * scale)).cast("double")))
    out, last = None, None
    while True:
        block = (asked if last is None else asked.filter(F.col("id") > last)).orderBy("id").limit(QUERY_ROWS).collect()
        if not block:
            break
        last = block[-1]["id"]
        for dim in sorted({len(r["v"]) for r in block}):
            own = [r for r in block if len(r["v"]) == dim]
            part = _block(spark, data, finite, largest, own, dim, k, scale)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    return out.withColumnRenamed("id", id)


def _block(spark, data: DataFrame, finite, largest, block: list, dim: int, k: int, scale: int) -> DataFrame:
    ids = np.array([r["id"] for r in block], np.int64)
    q = np.floor(scale * np.array([r["v"] for r in block], np.float64))
    data = data.filter(F.size("v") == dim)
    top = data.filter(finite).agg(F.max(largest)).first()[0] or 0.0
    bound = np.abs(q).sum(axis=1) * top
    if len(bound) and bound.max() >= 2**53:
        raise ValueError("scores beyond 2^53 are not exact; use a smaller scale")
    lo, hi = -bound.astype(np.int64) - 1, bound.astype(np.int64) + 2  # the k-th score lies in [lo, hi)
    above = np.zeros(len(ids), np.int64)
    done = np.zeros(len(ids), bool)
    place = {int(x): i for i, x in enumerate(ids)}
    sent = spark.sparkContext.broadcast((ids, q))
    while not done.all():
        width = np.maximum(1, -(-(hi - lo) // BINS))
        counts = data.mapInArrow(_histogram(sent, lo, hi, width, above, done, dim, k, scale), "query_id long, need long, bin long, n long")
        counts = counts.groupBy("query_id", "need", "bin").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))))
        # a row per query of the block: the bin of its k-th score
        hit = upto.filter("upto >= need").groupBy("query_id").agg(F.max(F.struct("bin", "upto", "n")).alias("hit"))
        found = {r["query_id"]: r["hit"] for r in hit.collect()}
        for x, i in place.items():
            if done[i]:
                continue
            b = found.get(x)
            if b is None:  # fewer than k candidates: all are returned
                lo[i], above[i], done[i] = -(2**62), 0, True
                continue
            above[i] += b["upto"] - b["n"]
            lo[i] += b["bin"] * width[i]
            hi[i] = min(hi[i], lo[i] + width[i])
            done[i] = width[i] == 1
    found = data.mapInArrow(_select(sent, lo, k - above, dim, scale), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _scored(batches: Iterator[pa.RecordBatch], sent, dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores (queries x rows) of bounded slices; a query's own row has the lowest number."""
    ids, q = sent.value
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            own, m = vectors(batch.slice(at, step), scale, dim)
            if len(own):
                s = (q @ m.T).astype(np.int64)
                s[ids[:, None] == own[None, :]] = np.iinfo(np.int64).min
                yield own, s


def _histogram(sent, lo, hi, width, above, done, dim, k, scale):
    def run(batches):
        ids = sent.value[0]
        n = len(ids)
        counts: dict[int, np.ndarray] = {}
        bins = np.zeros((n, BINS), np.int64)
        live = np.flatnonzero(~done)
        for _, s in _scored(batches, sent, dim, scale):
            for i in live:
                inside = s[i][(s[i] >= lo[i]) & (s[i] < hi[i])]
                bins[i] += np.bincount((inside - lo[i]) // width[i], minlength=BINS)
        for i in live:
            full = np.flatnonzero(bins[i])[::-1]
            if not len(full):
                continue
            upto = np.cumsum(bins[i][full])
            counts[i] = full[: int(np.searchsorted(upto, k - above[i])) + 1]
        if counts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(b), ids[i]) for i, b in counts.items()])),
                    pa.array(np.concatenate([np.full(len(b), k - above[i]) for i, b in counts.items()])),
                    pa.array(np.concatenate(list(counts.values())).astype(np.int64)),
                    pa.array(np.concatenate([bins[i][b] for i, b in counts.items()])),
                ],
                ["query_id", "need", "bin", "n"],
            )

    return run


def _select(sent, kth, ties, dim, scale):
    """Scores above the k-th, and of those equal to it each partition's ``ties`` smallest ids."""

    def run(batches):
        ids = sent.value[0]
        equal: dict[int, np.ndarray] = {}
        for own, s in _scored(batches, sent, dim, scale):
            q, r = np.nonzero(s > kth[:, None])
            keep = s[q, r] != np.iinfo(np.int64).min
            q, r = q[keep], r[keep]
            if len(q):
                yield _found(ids[q], own[r], s[q, r])
            for i in np.flatnonzero((s == kth[:, None]).any(axis=1)):
                same = np.concatenate([equal.get(i, own[:0]), own[s[i] == kth[i]]])
                equal[i] = np.sort(same)[: ties[i]]
        for i, own in equal.items():
            yield _found(np.full(len(own), ids[i]), own, np.full(len(own), kth[i]))

    return run


def _found(q, own, s):
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(own), pa.array(s)], ["query_id", "id", "score"])
