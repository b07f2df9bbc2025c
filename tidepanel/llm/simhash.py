"""Near-duplicates by SimHash, compared exactly in tiles.

A document's fingerprint has bit b set if more than half of its shingles' hashes have it.  Equal
fingerprints are one row first.  The distinct ones are sorted by the population counts of their four
16-bit quarters and cut into tiles of bounded size.  Two fingerprints differ in at least as many bits
as their population counts differ, so tile pairs whose counts lie further apart than the radius are skipped; in
every other pair the runs of equal counts are compared by exclusive-or and bit counts in numpy.

A tile pair reports no more than the edges of a forest that connects what it found linked, so a large group
of near copies does not grow into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.llm.components import components
from tidepanel.llm.storage import join_hot
from tidepanel.llm.text import SPACE_WORD, Texts, ragged, texts

SEED = 42
#: Fingerprints of a tile, cells of one comparison, and shingles whose bits are counted at once.
TILE, CELLS, SHINGLES = 16384, 1 << 21, 1 << 16
QUARTERS = 4


def spaced(t: Texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all documents, each followed by one space; their starts, ends and the first word of each document."""
    low = t.lowered()
    starts, ends = low.words(SPACE_WORD)
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.full(int((sizes + 1).sum()), 32, np.uint8)
    flat[ragged(at, sizes)] = low.data[ragged(starts, sizes)]
    return flat.tobytes(), at, at + sizes, np.searchsorted(starts, low.offsets)


def fingerprints_of(t: Texts, size: int) -> np.ndarray:
    data, starts, ends, first = spaced(t)
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(t), np.uint64)
    starts, ends = starts.tolist(), ends.tolist()
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b == a:
            continue
        n = max(1, b - a - size + 1)
        width = min(size, b - a) - 1
        counts = np.zeros(64, np.int64)
        for at in range(a, a + n, SHINGLES):
            upto = min(at + SHINGLES, a + n)
            spans = zip(starts[at:upto], ends[at + width : upto + width])
            hashes = np.array([digest(data[x:y], SEED) for x, y in spans], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a long) of every row."""

    def run(batches):
        for t in texts(batches):
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array(fingerprints_of(t, size).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def counts(fingerprints: np.ndarray) -> np.ndarray:
    """Population counts of the quarters, a row per fingerprint."""
    return np.bitwise_count(fingerprints.astype("<u8").view("<u2").reshape(-1, QUARTERS)).astype(np.int16)


TILES = "tile long, low array<int>, high array<int>, members binary"


def tiles(distinct: DataFrame, rows: int) -> DataFrame:
    """The distinct fingerprints in tiles: first member as the key, bounds of the counts, members."""
    quarter = [F.bit_count(F.shiftrightunsigned("fingerprint", 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int") for q in range(QUARTERS)]
    order = [*[f"q{q}" for q in range(QUARTERS)], "fingerprint"]
    dealt = distinct.select(*[c.alias(f"q{q}") for q, c in enumerate(quarter)], "fingerprint")
    dealt = dealt.repartitionByRange(max(1, -(-rows // TILE)), *order).sortWithinPartitions(*order)

    def run(batches):
        rest = np.zeros(0, np.int64)
        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy()])
            while len(rest) >= 2 * TILE:
                yield pack(rest[:TILE])
                rest = rest[TILE:]
        for part in np.array_split(rest, max(1, -(-len(rest) // TILE))):
            if len(part):
                yield pack(part)

    def pack(members):
        c = counts(members.view(np.uint64))
        row = {"tile": members[0], "low": c.min(axis=0).tolist(), "high": c.max(axis=0).tolist(), "members": members.tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("tile", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("members", pa.binary())]))

    return dealt.select("fingerprint").mapInArrow(run, TILES)


def near_tiles(cut: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of tiles, a tile with itself too, whose counts may be within the radius.

    The bounds of all tiles, 40 bytes for TILE fingerprints, go to the tasks.
    """
    spark = cut.sparkSession
    bounds = cut.select("tile", "low", "high").orderBy("tile").toPandas()
    keys = bounds["tile"].to_numpy(np.int64)
    low, high = (np.array(bounds[c].tolist(), np.int32).reshape(-1, QUARTERS) for c in ("low", "high"))
    sent = spark.sparkContext.broadcast((keys, low, high))

    def run(batches):
        keys, low, high = sent.value
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                i = int(np.searchsorted(keys, tile))
                apart = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:])).sum(axis=1)
                near = keys[i:][apart <= radius]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), tile)), pa.array(near)], ["a", "b"])

    return cut.select("tile").mapInArrow(run, "a long, b long")


def runs(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and population counts of the runs of equal counts; members are sorted by them."""
    c = counts(members)
    starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]).any(axis=1)]))
    return starts, np.diff(np.append(starts, len(c))), c[starts]


class Forest:
    """Disjoint sets of 0 .. n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links connect sets that the ones before them left apart."""
        used = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used[i] = True
        return used

    def connect(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Enough of the links to connect what all of them connect.

        Every round takes one link of each set that still has open ones, so the sets at least halve.
        """
        left, right = [a[:0]], [b[:0]]
        while len(a):
            label = self.labels()
            x, y = label[a], label[b]
            still = x != y
            a, b, x, y = a[still], b[still], x[still], y[still]
            pick = np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])
            used = pick[self.join(a[pick], b[pick])]
            left.append(a[used])
            right.append(b[used])
        return np.concatenate(left), np.concatenate(right)


def links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of linked fingerprints: enough of the links to connect all that are linked."""
    starts, lengths, own = runs(a)
    starts_b, lengths_b, other = runs(b)
    forest = Forest(len(a) + len(b))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n, c in zip(starts.tolist(), lengths.tolist(), own):
        near = np.abs(other - c).sum(axis=1) <= radius
        at = ragged(starts_b[near], lengths_b[near])
        if not len(at):
            continue
        step = max(1, CELLS // len(at))
        for k in range(s, s + n, step):
            part = a[k : min(k + step, s + n)]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ b[at][None, :]) <= radius)
            i, j = i + k, at[j]
            keep = a[i] != b[j]
            i, j = i[keep], j[keep]
            i, j = forest.connect(i, j + len(a))
            left.append(i)
            right.append(j - len(a))
    return np.concatenate(left), np.concatenate(right)


def compared(pairs: DataFrame, cut: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between fingerprints of the tile pairs."""
    one, two = (cut.select(F.col("tile").alias(t), F.col("members").alias(f"members_{t}")) for t in "ab")

    def run(batches):
        for batch in batches:
            same = batch.column("a").to_numpy() == batch.column("b").to_numpy()
            for x, y, own in zip(batch.column("members_a"), batch.column("members_b"), same):
                a, b = (np.frombuffer(m.as_buffer(), np.uint64) for m in (x, y))
                i, j = own_links(a, radius) if own else links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a[i].view(np.int64)), pa.array(b[j].view(np.int64))], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "members_a", "members_b").mapInArrow(run, "a long, b long")


def own_links(a: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a tile; both sides of a fingerprint are one node."""
    return Forest(len(a)).connect(*links(a, a, radius))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are the runs of other characters than white space, A-Z lower-cased, joined by single spaces into
    ``size``-word shingles, each counted as often as it stands; a shorter text is one shingle.  Null texts and
    texts without words have fingerprint zero and are linked like any other.  Fingerprints are linked at ``radius``
    differing bits or fewer; component_id is the smallest doc_id reachable, null if no row reached has one.
    Rows that repeat a doc_id are rows of their own.  Only doc_id and text are read.
    """
    marked = materialise(fingerprints(docs, size), "fingerprints")
    classes = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    total = classes.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    cut = materialise(tiles(classes.select("fingerprint"), total["n"]), "tiles")
    pairs = materialise(near_tiles(cut, radius), "tile-pairs")
    found = materialise(compared(pairs, cut, radius).distinct(), "links")
    roots = materialise(components(found), "roots")
    facts = classes.join(roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
    facts = materialise(facts.select("fingerprint", "rep", "rows", "root"), "facts")
    linked = facts.filter("root is not null")
    whole = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("own"))
    linked = join_hot(linked, whole, "root", "own", total["n"])
    alone = facts.filter("root is null").withColumn("component_id", F.col("rep"))
    facts = linked.select("fingerprint", "rows", "component_id").unionByName(alone.select("fingerprint", "rows", "component_id"))
    facts = materialise(facts, "facts")
    out = join_hot(marked, facts, "fingerprint", "rows", total["rows"] or 0)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
