"""Lexical search, manifest and SimHash against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidepanel.llm import lexical, merkle, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["grp", "pos", "h", "size", "chunk", "row", "fingerprint", "a", "b", "tile", "root", "rank", "score", "m", "terms", "q"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def make(n=90, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" if i % 4 else f"Wört{i}" for i in range(60)]
    out = [(i, t, "en", "s", 0) for i, t in enumerate([None, "", "  \t", "!?", "one", "One two", "x " * 3000, "a b C"])]
    for i in range(8, n):
        text = " ".join(rng.choice(words, rng.integers(1, 40)))
        out.append((i, text, [None, "", "de", "en", "fr"][i % 5], None if i % 7 == 0 else f"src{i % 3}", None if i % 6 == 0 else len(text)))
    long = " ".join(rng.choice(words, 400))
    out += [(n, long, "en", "s", 1), (n + 1, long.upper().replace("Ö", "ö"), "en", "s", 2), (n + 2, long + " tail", "fr", "s", 3), (n + 2, long + " tail", "fr", "s", 3)]
    out += [(n + 2, "another text of that id", "fr", "s", 4), (None, long, "en", None, None), (None, None, None, None, None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def ranked(rows, items, k):
    terms = [TERM.findall((t or "").translate(LOW)) for _, t, *_ in rows]
    total, words = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for item, text in asked.items():
        scores = []
        for (doc, *_), own in zip(rows, terms):
            tf, m = Counter(own), 75 + 25 * len(own) * total // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in TERM.findall(text.translate(LOW)) if tf[x])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, n, doc, -s) for n, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "w1 w2 w2 Wört0"), (2, None), (3, "nothing known"), (4, " ".join(f"w{i}" for i in range(60)) + " one Two"), (4, "w7 w9"), (None, "w1"), (5, ""), (6, "x X a C")]


@pytest.mark.parametrize("postings, held, queries", [(1_000_000, 32 << 20, 512), (50, 1, 2)])
def test_lexical_search(spark, docs, rows, monkeypatch, postings, held, queries):
    monkeypatch.setattr(lexical, "QUERY_ROWS", queries)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "STRATA_BYTES", held)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.ranked_search(docs, items, 5).collect())
    assert got == ranked(rows, ITEMS, 5)


def test_lexical_index_opens_again(spark, docs, rows):
    index = lexical.build(docs)
    again = lexical.Index.open(spark, index.path)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r) for r in lexical.search(again, items, 3).orderBy("rank").collect()] == ranked(rows, ITEMS[:1], 3)


def test_lexical_bounds_hold():
    """No document of a stratum scores above the stratum's bound."""
    import pyarrow as pa

    from tidepanel.llm.text import texts

    rows = make()[8:90]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    shard = lexical.Shard(len(rows), sum(len(TERM.findall(r[1].translate(LOW))) for r in rows))
    for t in texts(iter([batch])):
        shard.add(t)
    strata = shard.strata()
    words = pa.array([w.encode() for w in ("w1", "w2", "wört0", "absent")], pa.large_binary())
    for i in range(strata.num_rows):
        s = lexical.Stratum({c: strata.column(c)[i] for c in strata.schema.names}, words)
        weights = np.array([5, 3, 2, 9])
        assert (s.scores(np.arange(4), weights) <= (weights * s.top).sum()).all()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def beside(levels, i, fanout):
    out = []
    for row in levels[:-1]:
        at = i - i % fanout
        out.append((row[at:i], row[i + 1 : at + fanout]))
        i //= fanout
    return out


def expected_manifest(rows, fanout=2):
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, source, n: sha("".join(map(cell, (i, source, lang, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = beside(trees[g], i, fanout) + beside(top, k, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = leaf(*r[:4], r[4] + 1) if hit else h
            for a, b in way:
                folded = sha("".join([*a, folded, *b]))
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in way)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout, levels", [(2, 10), (2, 1), (2, 3), (3, 2)])
def test_manifest(docs, rows, fanout, levels):
    from pyspark.sql import functions as F

    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit & F.col("n_chars").isNotNull(), merkle.leaf(n_chars=F.col("n_chars") + 1))
    got = sorted((tuple(r) for r in merkle.manifest(docs, tampered=changed, fanout=fanout, levels=levels).collect()), key=str)
    assert got == expected_manifest(rows, fanout)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_and_of_langs(spark):
    one = make()[20:21]
    assert [tuple(r) for r in merkle.tamper_evidence(frame(spark, one)).collect()] == expected_manifest(one)
    many = [(i, "t", f"lang{i}", "s", i) for i in range(40)]
    assert sorted((tuple(r) for r in merkle.manifest(frame(spark, many), tampered=merkle.leaf(n_chars=merkle.F.lit(-1)), levels=2).drop("folded_root", "verified").collect()), key=str) == [
        r[:5] for r in expected_manifest(many)
    ]


def test_states_are_those_of_the_whole_tree():
    nodes = [sha(str(i)) for i in range(23)]
    for fanout in (2, 3, 5):
        levels = tree(nodes, fanout)
        chunk = merkle.Chunk(nodes, len(levels) - 1, fanout)
        assert chunk.levels == levels
        for i in range(23):
            assert chunk.fold(i, nodes[i]) == chunk.root
            assert chunk.fold(i, sha("other")) == tree([*nodes[:i], sha("other"), *nodes[i + 1 :]], fanout)[-1][0]


def expected_simhash(rows, size=3, radius=3):
    prints = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
        counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted([(r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)], key=str)


@pytest.mark.parametrize("radius, tile, cells", [(3, 16384, 1 << 21), (3, 4, 8), (9, 4, 64), (20, 16, 1 << 10)])
def test_simhash(docs, rows, monkeypatch, radius, tile, cells):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CELLS", cells)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, radius=radius).collect()), key=str)
    assert got == expected_simhash(rows, radius=radius)


def test_links_connect_a_dense_group():
    """Thousands of fingerprints within the radius of each other give a forest, not their pairs."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique([base ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(60) for j in range(i)])
    far = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    members = np.unique(np.concatenate([near, far]))
    members = members[np.lexsort((members, *simhash.counts(members).T[::-1]))]
    i, j = simhash.own_links(members, 3)
    forest = simhash.Forest(len(members))
    assert forest.join(i, j).all()
    labels = forest.labels()
    for k in rng.integers(0, len(members), 200):
        for n in np.flatnonzero(np.bitwise_count(members ^ members[k]) <= 3):
            assert labels[k] == labels[n]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert merkle.tamper_evidence(none).count() == simhash.near_duplicates(none).count() == lexical.ranked_search(none, items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
