"""Ranked lexical search over an index whose strata are documents of equal length normaliser.

Documents of one normaliser m form a stratum; in it a term's postings are kept by falling tf, so that a
document's impact depends on tf alone and is computed once per tf.  A stratum's bound for a query is the sum of the
impacts of its terms' largest tf.  Strata are visited in falling order of their bounds, until no bound reaches the
k-th score found so far.

The index is cut into shards of consecutive documents (a bounded number of postings each), so a stratum
of a shard is one row with all postings of its documents: no term and no normaliser is ever gathered, and every
task scores whole documents.  What crosses tasks are term counts and each task's k best.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.tables import new_path
from tidepanel.llm.text import ALNUM_WORD, Texts, ragged, texts, word_array

#: Postings after which a shard is closed, queries answered in one pass, bytes of strata ordered at a time.
SHARD_POSTINGS, QUERY_ROWS, STRATA_BYTES = 1_000_000, 512, 16 << 20
# The normaliser and the saturation of the score
FLAT, SLOPE, SCALE, SATURATION = 75, 25, 1_000_000_000, 12
NO_ID = np.iinfo(np.int64).min

#: A row of the index: numbers are packed in the fewest bytes each; ``letters`` are the terms one after another.
SCHEMA = "m long, doc_ids binary, letters binary, lengths binary, df binary, runs binary, tfs binary, sizes binary, places binary"


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in 1, 2, 4 or 8 bytes each; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(cell: pa.Scalar) -> np.ndarray:
    data = np.frombuffer(cell.as_buffer(), np.uint8)
    return np.frombuffer(data[1:].tobytes(), f"<u{data[0]}").astype(np.int64)


def term_array(letters: pa.Scalar, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), letters.as_buffer()])


def sliced(batches):
    """Fewer rows at a time, so that copies of a batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def normaliser(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    return np.array([FLAT + SLOPE * x * documents // words for x in n.tolist()], np.int64)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# ---------------------------------------------------------------------------------------------
# building


@dataclass
class Index:
    """A stored index: folder of its strata, number of documents with a term, number of their terms."""

    spark: SparkSession
    path: str
    documents: int
    words: int

    def strata(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/strata")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        facts = spark.read.parquet(f"{path}/facts").first()
        return cls(spark, path, facts["documents"], facts["words"])


def lengths(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def run(batches):
        documents = words = 0
        for t in texts(sliced(batches)):
            low = t.lowered()
            starts, _ = low.words(ALNUM_WORD)
            documents += int((np.diff(np.searchsorted(starts, low.offsets)) > 0).sum())
            words += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([words])], ["documents", "words"])

    total = docs.select("text").mapInArrow(run, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    return total[0] or 0, total[1] or 0


class Shard:
    """Postings of consecutive documents, turned into strata when it is closed."""

    def __init__(self, documents: int, words: int):
        self.total = documents, words
        self.codes: dict[bytes, int] = {}
        self.ids, self.n, self.parts, self.postings, self.rows = [], [], [], 0, 0

    def add(self, t: Texts) -> None:
        low = t.lowered()
        starts, ends = low.words(ALNUM_WORD)
        n = np.diff(np.searchsorted(starts, low.offsets))
        ids = t.rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.ids.append(ids[n > 0])
        self.n.append(n[n > 0])
        place = np.repeat(np.arange((n > 0).sum()), n[n > 0]) + self.rows
        self.rows += int((n > 0).sum())
        if not len(starts):
            return
        found = word_array(low.data, starts, ends).dictionary_encode()
        code = np.array([self.codes.setdefault(w, len(self.codes)) for w in found.dictionary.to_pylist()], np.int64)
        key, tf = np.unique((place << 32) | code[found.indices.to_numpy()], return_counts=True)
        self.parts.append((key, tf.astype(np.int32)))
        self.postings += len(key)

    def strata(self) -> pa.RecordBatch:
        """A row per normaliser: per term its runs of equal tf, from the largest, and each run's documents."""
        ids, n = np.concatenate(self.ids), np.concatenate(self.n)
        key, tf = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        place, code = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        del key
        m = normaliser(n, *self.total)
        levels, stratum = np.unique(m, return_inverse=True)
        stratum = stratum.astype(np.int32)
        order = np.lexsort((place, -tf, code, stratum[place]))
        place, code, tf = place[order], code[order], tf[order]
        del order
        of = stratum[place]
        # documents in order of stratum; a posting names its document by the place in the stratum
        docs = np.argsort(stratum, kind="stable")
        at = np.searchsorted(stratum[docs], np.arange(len(levels) + 1))
        local = np.empty(len(ids), np.int64)
        local[docs] = np.arange(len(ids)) - at[stratum[docs]]
        new_term = np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])])
        new_run = new_term | np.concatenate([[True], tf[1:] != tf[:-1]])
        terms, runs = np.flatnonzero(new_term), np.flatnonzero(new_run)
        df, runs_of = np.diff(np.append(terms, len(tf))), np.diff(np.append(np.searchsorted(runs, terms), len(runs)))
        sizes = np.diff(np.append(runs, len(tf)))
        words = pa.array(list(self.codes), pa.large_binary()).take(pa.array(code[terms]))
        lengths = pc.binary_length(words).to_numpy()
        letters = words.buffers()[2].to_pybytes() if len(words) else b""
        upto = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.arange(len(levels) + 1)
        by_term, by_run, by_row = (np.searchsorted(x, cuts) for x in (of[terms], of[runs], of))

        def cells(values, by):
            return pa.array([packed(values[x:y]) for x, y in zip(by, by[1:])], pa.binary())

        columns = [
            pa.array(levels),
            pa.array([ids[docs[x:y]].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
            pa.array([letters[upto[x] : upto[y]] for x, y in zip(by_term, by_term[1:])], pa.binary()),
            cells(lengths, by_term),
            cells(df, by_term),
            cells(runs_of, by_term),
            cells(tf[runs], by_run),
            cells(sizes, by_run),
            cells(local[place], by_row),
        ]
        return pa.RecordBatch.from_arrays(columns, ["m", "doc_ids", "letters", "lengths", "df", "runs", "tfs", "sizes", "places"])


def build(docs: DataFrame, path: str | None = None) -> Index:
    """Index every row of ``docs`` (doc_id, text) under ``path``, by default a new folder of the shared one."""
    spark = docs.sparkSession
    path = path or new_path(spark, "lexical")
    documents, words = lengths(docs)

    def run(batches):
        shard = Shard(documents, words)
        for t in texts(sliced(batches)):
            shard.add(t)
            if shard.postings >= SHARD_POSTINGS:
                yield shard.strata()
                shard = Shard(documents, words)
        if shard.postings:
            yield shard.strata()
        del shard
        pa.default_memory_pool().release_unused()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA).write.parquet(f"{path}/strata")
    spark.createDataFrame([(documents, words)], "documents long, words long").write.parquet(f"{path}/facts")
    return Index(spark, path, documents, words)


# ---------------------------------------------------------------------------------------------
# searching


def terms_of(text: str) -> Counter:
    """Terms and their number of one query text."""
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
    out: Counter = Counter()
    for t in texts(iter([batch])):
        low = t.lowered()
        out.update(w.decode() for w in word_array(low.data, *low.words(ALNUM_WORD)).to_pylist())
    return out


def document_counts(strata: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of ``terms``, a bounded number of them."""
    sent = strata.sparkSession.sparkContext.broadcast(pa.array([t.encode() for t in terms], pa.large_binary()))

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for letters, lengths, df in zip(*batch.columns):
                which = pc.index_in(term_array(letters, unpacked(lengths)), value_set=sent.value)
                known = which.is_valid().to_numpy(zero_copy_only=False)
                # a term stands once in a stratum
                total[which.drop_null().to_numpy()] += unpacked(df)[known]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    counted = strata.select("letters", "lengths", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {terms[r["term"]]: r["df"] for r in counted.collect()}


class Stratum:
    """One row of the index: copies of the postings of the queries' terms only, so that the row itself can go."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        m = row["m"].as_py()
        self.ids = np.frombuffer(row["doc_ids"].as_buffer(), np.int64).copy()
        which = pc.index_in(term_array(row["letters"], unpacked(row["lengths"])), value_set=vocabulary)
        own = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
        self.term = np.full(len(vocabulary), -1, np.int32)
        self.term[which.drop_null().to_numpy()] = np.arange(len(own))
        df, runs, tfs, sizes, places = (unpacked(row[c]) for c in ("df", "runs", "tfs", "sizes", "places"))
        first, first_run = np.cumsum(df) - df, np.cumsum(runs) - runs
        of_run = ragged(first_run[own], runs[own])
        # once per tf of the stratum
        levels, back = np.unique(tfs[of_run], return_inverse=True)
        impacts = impact(levels, m)[back]
        self.each = np.repeat(impacts, sizes[of_run])
        self.df = df[own]
        self.start = np.cumsum(self.df) - self.df
        self.places = places[ragged(first[own], self.df)].astype(np.int32)
        # the largest tf of a term comes first
        self.top = np.zeros(len(vocabulary), np.int64)
        self.top[self.term >= 0] = impacts[np.cumsum(runs[own]) - runs[own]][self.term[self.term >= 0]]

    def __len__(self) -> int:
        """Bytes held."""
        return sum(x.nbytes for x in (self.ids, self.term, self.each, self.df, self.start, self.places, self.top))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        held = self.term[terms] >= 0
        at, weights = self.term[terms][held], weights[held]
        rows = ragged(self.start[at], self.df[at])
        parts = np.repeat(weights, self.df[at]) * self.each[rows]
        if int(weights.sum()) * (SCALE // 1000) < 2**53:  # doubles are exact
            return np.bincount(self.places[rows], weights=parts, minlength=len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.places[rows], parts)
        return out


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach: the k-th score, or 1."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score >= self.least) & (doc != NO_ID)
        if good.any():
            score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]


def visit(strata: list[Stratum], starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: list[Best]) -> None:
    """Every query goes through the strata in falling order of their bounds for it."""
    bounds = np.stack([np.add.reduceat(weights * s.top[terms], starts[:-1]) for s in strata])
    for q, own in enumerate(best):
        span = slice(starts[q], starts[q + 1])
        for r in np.argsort(-bounds[:, q], kind="stable"):
            if bounds[r, q] < own.least:
                break
            own.add(strata[r].scores(terms[span], weights[span]), strata[r].ids)


def search(index: Index, items: DataFrame, k: int = 20, id: str = "item_id", text: str = "text") -> DataFrame:
    """``id``, rank (from 1), doc_id, score of each query's k best documents with a score above 0.

    Terms are the runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none.
    Equal scores go to the smaller doc_id.  Documents without doc_id count in the statistics and are not returned; rows that
    repeat a doc_id are documents of their own.  Queries without id take no part; an id that is repeated is asked once, with its smallest
    text.  Queries go over the index in blocks of QUERY_ROWS; a block's terms are sent to the tasks.
    """
    spark = index.spark
    asked = items.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(text).alias("text"))
    out, last = None, None
    while index.documents:
        block = (asked if last is None else asked.filter(F.col("id") > F.lit(last))).orderBy("id").limit(QUERY_ROWS).collect()
        if not block:
            break
        last = block[-1]["id"]
        part = _block(index, [(r["id"], terms_of(r["text"])) for r in block], k, asked.schema["id"].dataType)
        out = part if out is None or part is None else out.unionByName(part)
    if out is None:
        out = asked.select("id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out.withColumnRenamed("id", id)


def _block(index: Index, queries: list[tuple], k: int, kind) -> DataFrame | None:
    spark = index.spark
    vocabulary = sorted({t for _, terms in queries for t in terms})
    df = document_counts(index.strata(), vocabulary) if vocabulary else {}
    vocabulary = sorted(df)
    place = {t: i for i, t in enumerate(vocabulary)}
    known = [(x, [(place[t], n * weight(index.documents, df[t])) for t, n in sorted(terms.items()) if t in place]) for x, terms in queries]
    known = [(x, pairs) for x, pairs in known if pairs]
    if not known:
        return None
    starts = np.cumsum([0, *[len(pairs) for _, pairs in known]])
    flat = np.array([p for _, pairs in known for p in pairs], np.int64)
    sent = spark.sparkContext.broadcast((pa.array([t.encode() for t in vocabulary], pa.large_binary()), starts, flat[:, 0].copy(), flat[:, 1].copy()))

    def run(batches):
        words, starts, terms, weights = sent.value
        best = [Best(k) for _ in range(len(starts) - 1)]
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held.append(Stratum({c: row.column(c)[0] for c in row.schema.names}, words))
                size += len(held[-1])
                if size > STRATA_BYTES:
                    visit(held, starts, terms, weights, best)
                    held, size = [], 0
        if held:
            visit(held, starts, terms, weights, best)
        some = [(q, b) for q, b in enumerate(best) if len(b.score)]
        if some:
            columns = [np.concatenate([np.full(len(b.score), q) for q, b in some]), np.concatenate([b.doc for _, b in some]), np.concatenate([b.score for _, b in some])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "doc_id", "score"])

    found = index.strata().mapInArrow(run, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, x) for q, (x, _) in enumerate(known)], T.StructType([T.StructField("q", T.LongType()), T.StructField("id", kind)]))
    return ranked.join(F.broadcast(names), "q").select("id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``docs`` and search it; see ``search``."""
    return search(build(docs), items, k)
