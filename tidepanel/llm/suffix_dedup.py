"""Removal of repeated strings through suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.  To let equal strings meet
without moving the corpus, each string is assigned to the smallest hash of the GRAM-byte pieces in it.
Strings of one document that follow each other mostly share it, so documents fall into short
overlapping pieces keyed by that hash, their anchor, and equal strings always lie in pieces of one anchor.

Pieces equal as a whole are settled by their digests.  The different pieces of an anchor are sorted by column-wise
construction, but for those that share no range of 90 bytes around the anchor with another: round by round one symbol of every piece is inserted, from the last to the first, which
updates the Burrows-Wheeler transform of the collection and the common prefixes of neighbours in
suffix order.  Neighbours that share LENGTH bytes hold equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.llm.storage import small_side
from tidepanel.llm.text import Rolling, Texts, mix, ragged, texts

LENGTH, GRAM = 100, 50
#: Strings that a piece starts at most (periodic texts would give endless pieces).
PIECE_STRINGS = 100
#: Bytes sorted at a time.  An anchor with more different pieces than HOT_PIECES is settled by string digests instead.
SORT_BYTES, HOT_PIECES = 400_000, 3_000
#: Of these, the bytes that one suffix order holds: its arrays are passed over once per symbol, so they should stay in a core's cache.
PART_BYTES = 100_000
#: Before the sort: any string of an anchor holds one of the CORE-byte ranges that begin a multiple of STEP bytes before it.
STEP = 10
CORE = LENGTH - STEP

ANCHOR, DIGEST = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
NONE = np.uint64(2**64 - 1)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(uid, doc_id, text) with uids that are distinct and ordered like doc_id; and whether uid is the doc_id.

    Where doc_ids repeat or are null, distinct (doc_id, text) are numbered in order, nulls last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("uid"), "doc_id", "text"), True
    keys = [F.col("doc_id").asc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256)]
    ordered = docs.distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered"), False


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    m, have = h, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - have :]) if have < width else m


def pieces(t: Texts) -> tuple[np.ndarray, ...]:
    """Anchor, digest, document, start in it, number of strings, and whether its strings may repeat, of every piece."""
    nothing = tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    n = len(t.data)
    if n < LENGTH:
        return nothing
    sums = ANCHOR.sums(t.data)
    at = np.arange(n - GRAM + 1)
    grams = ANCHOR.hashes(sums, at, at + GRAM)
    low = sliding_min(grams, LENGTH - GRAM + 1)
    valid = np.zeros(n + 1, np.int8)
    sizes = np.diff(t.offsets)
    some = np.flatnonzero(sizes >= LENGTH)
    if not len(some):
        return nothing
    valid[t.offsets[some]] += 1
    np.subtract.at(valid, t.offsets[some + 1] - LENGTH + 1, 1)
    valid = np.cumsum(valid[: len(low)], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(low))  # the run ends at the next start or with the document
    doc = t.doc_of(start)
    end = np.minimum(end, t.offsets[doc + 1] - LENGTH + 1)
    parts = -(-(end - start) // PIECE_STRINGS)
    if parts.max(initial=1) > 1:
        first = ragged(np.zeros(len(start), np.int64), parts) * PIECE_STRINGS
        start, last, doc = np.repeat(start, parts) + first, np.repeat(end, parts), np.repeat(doc, parts)
        end = np.minimum(start + PIECE_STRINGS, last)
    key = DIGEST.hashes(DIGEST.sums(t.data), start, end + LENGTH - 1)
    # a piece can repeat a string only if its anchor occurs in it twice; every string holds the anchor among its
    # LENGTH - GRAM + 1 grams, so two occurrences in a row lie at most that far apart (then one in each of two strings)
    wide = np.pad(~np.where(valid, low, 0), LENGTH - GRAM, constant_values=NONE)
    chosen = np.flatnonzero(grams == ~sliding_min(wide, LENGTH - GRAM + 1))
    twice = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= LENGTH - GRAM + 1))
    pair = np.append(chosen[1:][twice], n + LENGTH)
    inside = pair[np.searchsorted(chosen[:-1][twice], start)] < end + LENGTH - GRAM
    return low[start], key, doc, start - t.offsets[doc], end - start, inside


PIECES = "anchor long, digest long, uid long, start int, strings int, repeats boolean"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents.  Of those equal in one go only the first is passed on; the others, for
    which it is an earlier place, are reported as covered (anchor null)."""
    for t in texts(batches):
        anchor, digest, doc, start, strings, repeats = pieces(t)
        if not len(anchor):
            continue
        uid = t.rows.column("uid").to_numpy()[doc]
        order = np.lexsort((start, uid, digest, anchor))
        anchor, digest, uid, start, strings, repeats = (x[order] for x in (anchor, digest, uid, start, strings, repeats))
        again = np.zeros(len(anchor), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchor.view(np.int64), mask=again), pa.array(digest.view(np.int64)), pa.array(uid),
                pa.array(start.astype(np.int32)), pa.array(strings.astype(np.int32)), pa.array(repeats),
            ],
            NAMES,
        )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest, uid, start.  A piece equal to the row before is covered
    (anchor becomes null).  Of the others those stay whose anchor has several, or that may repeat a string; the rest goes.
    Only the last row of a batch is carried on, however many rows an anchor has."""
    held: list[np.ndarray] | None = None  # the last first-of-its-kind piece, undecided yet
    before = None  # the anchor of the piece before it
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gone = batch.column("anchor").is_null()
        done = batch.filter(gone)
        if done.num_rows:
            yield done
        rest = batch.filter(pc.invert(gone))
        if not rest.num_rows:
            continue
        cols = [rest.column(c).to_numpy(zero_copy_only=False) for c in NAMES]
        a, d = cols[0], cols[1]
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
        again[0] = last is not None and last == (a[0], d[0])
        last = (a[-1], d[-1])
        if again.any():
            yield _rows([np.zeros(int(again.sum()), np.int64), *(c[again] for c in cols[1:])], True)
        own = [c[~again] for c in cols]
        if held is not None:
            own = [np.concatenate([h, o]) for h, o in zip(held, own)]
        if not len(own[0]):
            continue
        same = own[0][1:] == own[0][:-1]
        need = own[5].astype(bool)
        need[1:] |= same
        need[:-1] |= same
        need[0] |= before is not None and before == own[0][0]
        if need[:-1].any():
            yield _rows([c[:-1][need[:-1]] for c in own], False)
        held = [c[-1:] for c in own]
        before = own[0][-2] if len(own[0]) > 1 else before
    if held is not None and (held[5][0] or before is not None and before == held[0][0]):
        yield _rows(held, False)


def _rows(cols: list[np.ndarray], covered: bool) -> pa.RecordBatch:
    a, d, u, s, n, r = cols
    anchor = pa.nulls(len(a), pa.int64()) if covered else pa.array(a)
    return pa.RecordBatch.from_arrays([anchor, pa.array(d), pa.array(u), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(r.astype(bool))], NAMES)


def column_wise(data: np.ndarray, lengths: np.ndarray, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection of strings that lie one after another in ``data``.

    Returns string and start of each suffix in order, and the length of the prefix it shares with the one
    before (suffixes that are equal as a whole share no end).  Round j inserts the suffix of j symbols of
    each string; its place follows from the rank of its first symbol in the transform so far.
    """
    m = len(lengths)
    ends = np.cumsum(lengths)
    used = np.unique(data)
    kind = np.uint8 if len(used) < 255 else np.uint16
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    symbols = np.concatenate([[kind(0)], code[data]])  # symbols[i] is before position i
    ahead = np.where(lengths > 0, symbols[ends], 0).astype(kind)  # 0: the string is complete
    string, left = np.arange(m, dtype=np.int32), np.zeros(m, np.int16 if lengths.max(initial=0) < 1 << 15 else np.int64)
    common = np.zeros(m, np.int16)
    front, done = np.arange(m), 0  # places of the suffixes inserted last
    while len(front):
        order = np.argsort(ahead, kind="stable")
        order = order[np.count_nonzero(ahead == 0) :]
        latest = np.zeros(len(ahead), bool)
        latest[front] = True
        k = np.flatnonzero(latest[order])  # ranks of the new suffixes
        if not len(k):
            break
        done += 1
        own = order[k]
        which = string[own]
        # common prefixes of the new suffixes and of the old ones that come right after them
        touched = np.zeros(len(order) + 1, bool)
        touched[k] = touched[k + 1] = True
        touched = np.flatnonzero(touched[:-1])
        prefix = _shared(order, ahead, common, touched)
        fresh = np.zeros(m + len(order), bool)
        fresh[m + k] = True
        ahead, string, left, common = (_inserted(x, fresh) for x in (ahead, string, left, common))
        string[fresh], left[fresh] = which, done
        begin = ends[which] - done
        ahead[fresh] = np.where(done < lengths[which], symbols[begin], 0)
        common[m + touched] = np.minimum(prefix, cap)
        front = m + k
    return string.astype(np.int64), lengths[string] - left, common


def _inserted(old: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fresh), old.dtype)
    out[~fresh] = old
    return out


def _shared(order: np.ndarray, ahead: np.ndarray, common: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One symbol more than the least common prefix between the two suffixes that are extended by the same symbol."""
    out = np.zeros(len(k), np.int64)
    some = np.flatnonzero(k > 0)
    some = some[ahead[order[k[some]]] == ahead[order[k[some] - 1]]]
    if len(some):
        a, b = order[k[some] - 1] + 1, order[k[some]] + 1
        size = b - a
        values = common[ragged(a, size)]
        out[some] = 1 + np.minimum.reduceat(values, np.cumsum(size) - size)
    return out


def repeated(uid: np.ndarray, start: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uid and start of every string that also starts earlier in one of the pieces."""
    string, at, common = column_wise(data, lengths)
    group = np.cumsum(common < LENGTH)
    joined = common >= LENGTH
    joined[:-1] |= joined[1:]
    some = np.flatnonzero(joined)
    group, u, s = group[some], uid[string[some]], start[string[some]] + at[some]
    order = np.lexsort((s, u, group))
    group, u, s = group[order], u[order], s[order]
    first = np.zeros(len(group), bool)
    first[:1] = True
    first[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    later = (u != u[lead]) | (s != s[lead])
    return u[later], s[later]


def repeated_by_anchor(anchor: np.ndarray, uid: np.ndarray, start: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``repeated`` for pieces sorted by anchor: whole anchors of about PART_BYTES at a time, as equal strings lie in one anchor."""
    ends = np.cumsum(lengths)
    last = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) if len(anchor) else np.zeros(0, np.int64)
    part = (ends[last] - 1) // PART_BYTES
    cuts = [0, *(last[np.flatnonzero(np.append(part[1:] != part[:-1], True))] + 1)] if len(last) else [0]
    at = np.concatenate([[0], ends])
    found = [repeated(uid[a:b], start[a:b], data[at[a] : at[b]], lengths[a:b]) for a, b in zip(cuts, cuts[1:])]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def may_share(anchor: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which pieces can share a string with another one of their anchor, or repeat one of their own.

    A string holds its anchor after 0 to LENGTH - GRAM bytes.  Whatever that number, it also holds one of the
    CORE-byte ranges that begin 0, STEP, 2 * STEP ... bytes before the anchor, so two pieces that hold the anchor once
    and agree in none of these ranges share no string.  Where a piece of an anchor holds it several times, all stay.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sums, sums2 = ANCHOR.sums(data), DIGEST.sums(data)
    at = ragged(begins, np.maximum(lengths - GRAM + 1, 0))
    piece = np.repeat(np.arange(len(lengths)), np.maximum(lengths - GRAM + 1, 0))
    hit = ANCHOR.hashes(sums, at, at + GRAM) == anchor.view(np.uint64)[piece]
    at, piece = at[hit], piece[hit]
    _, group = np.unique(anchor, return_inverse=True)
    keep = np.zeros(len(lengths), bool)
    often = np.bincount(piece, minlength=len(lengths)) != 1
    keep[np.isin(group, group[often])] = True
    at, piece = at[~keep[piece]], piece[~keep[piece]]
    for back in range(0, LENGTH - GRAM, STEP):
        fits = (at - back >= begins[piece]) & (at - back + CORE <= ends[piece])
        here, own = at[fits] - back, piece[fits]
        key = mix(DIGEST.hashes(sums2, here, here + CORE) ^ mix(group[own].astype(np.uint64))) if len(own) else np.zeros(0, np.uint64)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[own[count[which] > 1]] = True
    return keep


def in_runs(uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, start and number of strings of each run of strings that follow each other."""
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    first = np.ones(len(uid), bool)
    first[1:] = (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    return uid[at], start[at], np.diff(np.append(at, len(uid)))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; sorts whole anchors together, about SORT_BYTES at a time."""
    waiting: list[pa.Table] = []

    def settle(table: pa.Table):
        data = table.column("data").combine_chunks().cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1])
        flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        uid, start = table.column("uid").to_numpy(), table.column("start").to_numpy().astype(np.int64)
        some = may_share(table.column("anchor").to_numpy(), flat, lengths)
        flat = flat[ragged((np.cumsum(lengths) - lengths)[some], lengths[some])]
        u, s, n = in_runs(*repeated_by_anchor(table.column("anchor").to_numpy()[some], uid[some], start[some], flat, lengths[some]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["uid", "start", "strings"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            waiting.append(pa.Table.from_batches([batch.slice(at, 1024)]))
            if sum(t.column("data").nbytes for t in waiting) < SORT_BYTES:
                continue
            table = pa.concat_tables(waiting)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
            if cut:
                yield settle(table.slice(0, cut))
            waiting = [table.slice(cut)]
    table = pa.concat_tables(waiting) if waiting else None
    if table is not None and table.num_rows:
        yield settle(table)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that a document's row lists."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column("text")[i].as_py() or "").encode()
            need = batch.column("need")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["anchor"] for x in need], pa.int64()), pa.array([batch.column("uid")[i].as_py()] * len(need), pa.int64()),
                    pa.array([x["start"] for x in need], pa.int32()), pa.array([text[x["start"] : x["start"] + x["strings"] + LENGTH - 1] for x in need], pa.binary()),
                ],
                ["anchor", "uid", "start", "data"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            for uid, start, data in zip(*(rows.column(c).to_pylist() for c in ("uid", "start", "data"))):
                n = len(data) - LENGTH + 1
                keys = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([uid] * n, pa.int64()), pa.array(range(start, start + n), pa.int32())], ["key", "uid", "start"])


def covered_strings(docs: DataFrame) -> DataFrame:
    """(uid, start, strings): runs of strings that also start earlier, for docs (uid, text)."""
    cut = docs.select("uid", "text").mapInArrow(_emit, PIECES)
    spread = F.coalesce(F.col("anchor"), F.xxhash64("uid", "start"))
    settled = cut.repartition(spread).sortWithinPartitions("anchor", "digest", "uid", "start").mapInArrow(_settle, PIECES)
    settled = materialise(settled, "pieces")
    whole = settled.filter("anchor is null").select("uid", "start", "strings")

    need = settled.filter("anchor is not null").select("anchor", "uid", "start", "strings")
    listed = need.groupBy("uid").agg(F.collect_list(F.struct("anchor", "start", "strings")).alias("need"))
    some = docs.select("uid", "text").join(small_side(need.select("uid").distinct()), "uid", "left_semi")
    data = materialise(some.join(listed, "uid").mapInArrow(_cut, "anchor long, uid long, start int, data binary"), "data")
    hot = materialise(data.groupBy("anchor").count().filter(F.col("count") > HOT_PIECES).select("anchor"), "hot")
    many = hot.count()
    cold = data.join(small_side(hot, many), "anchor", "left_anti")
    out = cold.repartition("anchor").sortWithinPartitions("anchor", "uid", "start").mapInArrow(_sort, "uid long, start int, strings int")
    out = whole.union(out)
    if many:
        # too many pieces for one task: the strings themselves are the keys, so no group lies in one place
        strings = data.join(small_side(hot, many), "anchor", "left_semi").mapInArrow(_digests, "key binary, uid long, start int")
        strings = materialise(strings, "strings")
        first = strings.groupBy("key").agg(F.min(F.struct("uid", "start")).alias("first"))
        later = strings.join(first, "key").filter(F.struct("uid", "start") > F.col("first"))
        out = out.union(later.select("uid", "start", F.lit(1).alias("strings")))
    return out


RESULT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        has = "runs" in batch.schema.names
        out = []
        for i in range(batch.num_rows):
            data = np.frombuffer((batch.column("text")[i].as_py() or "").encode(), np.uint8)
            step = np.zeros(len(data) + 1, np.int64)
            if has:
                runs = batch.column("runs")[i].values
                start, n = (runs.field(f).to_numpy().astype(np.int64) for f in ("start", "strings"))
                np.add.at(step, start, 1)
                np.subtract.at(step, start + n + LENGTH - 1, 1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            ["uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty.  Texts under LENGTH bytes keep everything.  Rows that repeat a doc_id are ordered by the
    digest of their text; rows equal in both are one document and get the same result.  Null doc_ids come last.
    """
    own, plain = numbered(docs)
    runs = materialise(covered_strings(own), "runs")
    lists = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    hit = runs.select("uid").distinct()
    n = hit.count()
    clean = own.join(small_side(hit, n), "uid", "left_anti").mapInArrow(_remove, RESULT)
    dirty = own.join(small_side(hit, n), "uid", "left_semi").join(lists, "uid").mapInArrow(_remove, RESULT)
    out = clean.union(dirty)
    if plain:
        return out.drop("uid")
    keyed = own.select("uid", F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h2"))
    rows = rows.join(keyed, rows["doc_id"].eqNullSafe(keyed["d"]) & (rows["h2"] == keyed["h"])).select("uid")
    return rows.join(out, "uid").drop("uid")
