"""Near-duplicates by circulant MinHash.

One permutation places every shingle on a circle, a second one gives each place a rank.  Coordinate k of
a signature is the smallest rank that the document's places have after the circle is shifted by k, so
two permutations give all coordinates.  Documents that agree in all rows of a band are candidates;
every link is confirmed on the full shingle sets.

Groups of candidates may be as large as the corpus.  They are not turned into pairs: equal sets are one
class first; in a group each member is compared with one leader; components are formed; and only what
different components of a group have not yet settled is compared, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.llm.components import components
from tidepanel.llm.storage import small_side
from tidepanel.llm.text import SPACE_WORD, Rolling, Texts, mix, texts

#: Places on the circle, bands and rows per band: at a similarity of 0.85 a pair shares no band
#: with probability 7e-9, at 0.8 with 3e-6.
CIRCLE, BANDS, ROWS = 1 << 20, 32, 5
COORDINATES = BANDS * ROWS
BLOCK = 256

WORDS = Rolling(0xD6E8FEB86659FD93)
FACTORS = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def shifted_ranks() -> np.ndarray:
    """Row p: the ranks that place p has under shifts 0, 1, ... (a view of one permutation, not a copy)."""
    ranks = np.random.default_rng(4).permutation(CIRCLE).astype(np.uint32)
    return sliding_window_view(np.concatenate([ranks, ranks[:COORDINATES]]), COORDINATES)


def shingle_sets(t: Texts, size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each document's distinct shingles of ``size`` words (A-Z lower-cased).

    With fewer words, the whole sequence is the one shingle; without words the set is empty.
    """
    low = t.lowered()
    starts, ends = low.words(SPACE_WORD)
    hashes = WORDS.hashes(WORDS.sums(low.data), starts, ends)
    first = np.searchsorted(starts, low.offsets)
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * FACTORS[i]
    total = mix(total)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            whole = (hashes[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    places = np.unique(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    table = shifted_ranks()
    out = table[places[:2048]].min(axis=0)
    for at in range(2048, len(places), 2048):
        np.minimum(out, table[places[at : at + 2048]].min(axis=0), out=out)
    return out


SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, marks binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per document: set size, a key that equal sets share, band keys, and the set as 16-bit marks; null for empty sets."""

    def run(batches):
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for t in texts(batches):
            sets = shingle_sets(t, size)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, bands, marks = ([None] * len(sets) for _ in range(3))
            if some:
                sig = np.stack([signature(sets[i]) for i in some])
                parts = sig.reshape(len(some), BANDS, ROWS).astype(np.uint64)
                key = mix(mix((parts * FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64)) + salt).view(np.int64)
                for j, i in enumerate(some):
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], marks[i] = key[j], (sets[i] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [t.rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "marks"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(ids), "doc_id", "left_semi")
    needed = materialise(needed.dropDuplicates(["doc_id"]), "candidates")
    one, two = needed.toDF("a", "text_a"), needed.toDF("b", "text_b")

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                left, right = ([s for t in texts(iter([rows]), c) for s in shingle_sets(t, size)] for c in ("text_a", "text_b"))
                same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - same
                yield rows.select(["a", "b"]).filter(pa.array((100 * same >= percent * union) & (union > 0)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def alike_in_size(percent: int):
    return 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``size``-word
    shingles; component_id is the smallest doc_id reachable.  Null and empty texts have empty sets, are
    linked with nothing and kept.  Rows that repeat a doc_id count as that document.  Rows without
    doc_id lend their text to nobody: they get the component of an equal set if there is one, and are not kept.
    """
    marked = materialise(sketches(docs, size), "sketches")
    classes = materialise(
        marked.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")).filter("rep is not null"), "classes"
    )
    reps = marked.filter("doc_id is not null").join(classes.select("set_key", F.col("rep").alias("doc_id"), "n"), ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    reps = materialise(reps.select(F.col("doc_id").alias("rep"), "n", "bands", "marks"), "reps")
    rows = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    grouped = materialise(rows.join(sizes, "key").select("key", "band", "rep", "n", "members"), "groups")
    # the member whose bands are shared most is the likeliest to be linked with the others: it leads
    shared = grouped.groupBy("rep").agg(F.sum("members").alias("weight"))
    leaders = grouped.join(shared, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"), "n")).alias("lead"))
    leaders = leaders.select("key", (-F.col("lead.low")).alias("lead"), F.col("lead.n").alias("n2"))
    first = grouped.join(leaders, "key").filter("rep <> lead").filter(alike_in_size(percent))
    first = materialise(first.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct(), "pairs")
    links = materialise(confirmed(first, docs, size, percent), "confirmed")
    roots = materialise(components(links), "roots")

    second = _open_pairs(grouped.filter("members > 2"), reps, roots, percent)
    second = materialise(second.join(first, ["a", "b"], "left_anti"), "pairs")
    if second.limit(1).count():
        more = confirmed(second, docs, size, percent)
        roots = materialise(components(links.union(more)), "roots")

    out = marked.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left")
    out = out.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _open_pairs(grouped: DataFrame, reps: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of one group but different components whose marks allow a link; none that is one is left out.

    In a group the largest component is not compared with itself, nor is any other.  The rest, cut into blocks,
    meets every block of the group; a task sees two blocks at a time.
    """
    member = grouped.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "band", "rep", "n", "members", F.coalesce("root", "rep").alias("root"))
    parts = member.groupBy("key", "root").agg(F.count("*").alias("own"), F.first("members").alias("members"))
    facts = parts.groupBy("key").agg(F.max(F.struct("own", "root")).alias("main"), F.max("members").alias("members"))
    facts = facts.filter(F.col("main.own") < F.col("members")).select("key", F.col("main.root").alias("main"), (F.col("members") - F.col("main.own")).alias("others"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    at = member.join(facts, "key").join(reps.select("rep", "bands", "marks"), "rep")
    at = at.withColumn("all", blocks("members")).withColumn("some", blocks("others")).withColumn("h", F.xxhash64("rep"))
    every = at.select("key", "band", "rep", "n", "root", "bands", "marks", F.pmod("h", F.col("all")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("some") - 1)).alias("y"), F.lit(False).alias("asks"))
    rest = at.filter("root <> main").select(
        "key", "band", "rep", "n", "root", "bands", "marks", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("x"), F.pmod("h", F.col("some")).cast("int").alias("y"), F.lit(True).alias("asks")
    )

    def compare(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool)
        rep, n, root = (table.column(c).to_numpy() for c in ("rep", "n", "root"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        marks = [np.frombuffer(m, np.uint16) for m in table.column("marks").to_pylist()]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return pa.table({"a": rep[:0], "b": rep[:0]})
        flat, sizes = np.concatenate([marks[j] for j in right]), n[right]
        at = np.cumsum(sizes) - sizes
        band = table.column("band")[0].as_py()
        a, b = [rep[:0]], [rep[:0]]
        for i in left:
            known = np.zeros(1 << 16, bool)
            known[marks[i]] = True
            # no less than the intersection: shingles whose mark the other set has too
            most = np.minimum(np.add.reduceat(known[flat].astype(np.int64), at), n[i])
            ok = (100 * most >= percent * (sizes + n[i] - most)) & (root[right] != root[i])
            # a pair that shares several bands is reported in the first one only
            ok &= ~(bands[right][:, :band] == bands[i, :band]).any(axis=1)
            a.append(np.minimum(rep[right[ok]], rep[i]))
            b.append(np.maximum(rep[right[ok]], rep[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return every.union(rest).groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component holds a smaller doc_id.

    Rows that repeat a doc_id, and rows without one, stay.
    """
    dropped = near_duplicates(docs, size, percent).filter("not kept and doc_id is not null").select("doc_id").distinct()
    dropped = materialise(dropped, "dropped")
    return docs.join(small_side(dropped), "doc_id", "left_anti").select(docs.columns)
