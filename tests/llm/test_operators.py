"""The operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline
from tidepanel.llm import bpe, chat, exact_dedup, licenses, lm, minhash, mixing, quality, queries, suffix_dedup, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, rank string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}ö" if i % 5 == 0 else f"Word{i}" for i in range(200)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(6)]
    out = [None, "", "   ", "the mit license", "Licensed under the Apache License, Version 2.0.", "x" * 1200, "<|endoftext|> a  b\n", "Ä ä A a"]
    for b in base:
        w = b.split()
        w[30] = "changed"
        out += [b, b.upper().replace("Ö", "ö"), " ".join(w), "Head. " + b[:150] + " tail", b]
    return [(i, t, "en", "s", 0, "u", "r") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_exact_dedup(docs, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert set(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_exact_dedup_in_batches(spark, docs, rows, batches):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    want = {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {tuple(r)[:4] for r in exact_dedup.exact_dedup(docs, 4, batches).collect()} == want
    parts = exact_dedup.falling(docs.select(docs.doc_id.alias("id")), batches)
    ids = [sorted(r[0] for r in p.collect()) for p in parts]
    assert sum(map(len, ids)) == len(rows) and all(a[0] > b[-1] for a, b in zip(ids, ids[1:]) if a and b)


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "b"), (1, "A"), (1, "c"), (9, "c"), (9, "c"), (5, None), (4, ""), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3):
        got = sorted(exact_dedup.exact_dedup(df, 2, batches).drop("text_sha256").collect(), key=str)
        want = [(None, 1, 2, False), (1, 1, 2, True), (None, None, 2, False), (None, None, 2, False), (1, 9, 3, False), (9, 9, 3, True), (9, 9, 3, True), (5, 5, 2, True), (4, 5, 2, False)]
        assert [tuple(r) for r in got] == [t for _, t in sorted((str(spark_row(t)), t) for t in want)]


def spark_row(t):
    return Row(doc_id=t[0], keep_id=t[1], group_size=t[2], kept=t[3])


def test_index_path_opened_again(spark, docs):
    """A filled index under its path: a later batch is compared with what an earlier run stored."""
    first = exact_dedup.DigestIndex(spark, buckets=4)
    first.dedup(docs.filter("doc_id >= 20"), "old").count()
    again = exact_dedup.DigestIndex(spark, path=first.path, buckets=4)
    out = again.dedup(docs.filter("doc_id < 20"), "new")
    fresh, stored = out.filter("kept").count(), again.read()
    assert fresh == stored.filter("batch = 'new'").count() > 0
    # the new batch has texts that the old one brought
    assert fresh < out.select("text_sha256").distinct().count()
    assert stored.count() == stored.select("text_sha256").distinct().count() == exact_dedup.exact_dedup(docs).filter("kept").count()


def test_digest_index_goes_on(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.dedup(docs.filter("doc_id < 20"), "a").filter("kept").count()
    again = index.dedup(docs.filter("doc_id < 20"), "a").filter("kept").count()
    second = index.dedup(docs, "b").filter("kept").count()
    whole = exact_dedup.exact_dedup(docs).filter("kept").count()
    assert first == again and first + second == whole


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, size, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_repeated_bytes(docs, rows):
    seen, want = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = (len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert got == want


def test_column_wise_is_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 12, rng.integers(1, 9))
        data = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
        string, start, common = suffix_dedup.column_wise(data, sizes)
        at = np.cumsum(sizes) - sizes
        order = [bytes(data[at[s] + p : at[s] + sizes[s]]) for s, p in zip(string, start)]
        assert order == sorted(order) and len(order) == sizes.sum() + len(sizes)
        for k in range(1, len(order)):
            n = next((i for i, (x, y) in enumerate(zip(order[k - 1], order[k])) if x != y), min(map(len, order[k - 1 : k + 1])))
            assert common[k] == n


def test_bpe_is_the_library(docs, rows):
    from tokenizers import Tokenizer

    content = queries.tokenizer_file(queries.VOCABULARY)
    library = Tokenizer.from_str(content.decode())
    ids = bpe.encode_documents(docs, content)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, content).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = {r["doc_id"]: tuple(r)[1:] for r in bpe.encoding_digests(docs, content).collect()}
    assert digests == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in got.items()}


def test_lm_base_and_gain(docs, rows):
    import public_tokenizers

    words = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, t, *_ in rows}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = lm.lm_scores(docs, queries.tokenizer_file(queries.RANKS), public_tokenizers.PATTERN).collect()
    for r in got:
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] <= 0
    assert len(got) == len(rows)


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["base_labels"]) == (1, 1, "mit")
    assert got[4]["base_labels"] == "apache" and "apache-2.0" in got[4]["labels"] and got[0]["n_words"] == 0 and got[8]["score"] == 0


def test_top_k_ties_and_bad_vectors(spark):
    v = [(i, [float(i % 3), 1.0]) for i in range(250)] + [(300, None), (301, [1.0, None]), (400, [float("nan"), 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(4)
    good = [(i, [int(1024 * x) for x in e]) for i, e in v[:250]]
    want = set()
    for q, a in good[::100]:
        best = sorted((-(a[0] * b[0] + a[1] * b[1]), i) for i, b in good if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert set(map(tuple, topk.exact_top_k(df, df.filter("vec_id % 100 = 0")).collect())) == want


def test_quality_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality long, toxic long")
    out = quality.classify_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = docs.limit(0)
    assert quality.classify_quality(none, labels).count() == exact_dedup.exact_dedup(none).count() == minhash.near_duplicates(none).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame([(i, ("alpha beta gamma " if i % 4 else "uno dos tres ") * 5) for i in range(80)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "case when doc_id % 4 = 0 then 'b' else 'a' end as domain")
    r = mixing.mixing_rates(docs, labels, {"a": 0.5, "b": 0.5}).toPandas()
    share = (r.rate * r.n_tokens * r.p_b).sum() / (r.rate * r.n_tokens).sum()
    assert abs(share - 0.5) < 2e-3 and (r.rate > 0).all()
    assert mixing.mixed(docs, labels, {"a": 0.5, "b": 0.5}, least=1.0).select("doc_id").distinct().count() == 80


def test_encode_and_decode_in_one_pass(spark, docs):
    content = queries.tokenizer_file(queries.VOCABULARY)
    both = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in bpe.encode_and_decode(docs, content).collect()}
    parts = bpe.decode_documents(bpe.encode_documents(docs, content), content, keep_ids=True).collect()
    assert both == {r["doc_id"]: (r["ids"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in parts}
    assert bpe.encode_and_decode(docs.limit(0), content).count() == 0


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "ids", "decoded_sha256"]


def test_bpe_small_vocabularies():
    """Pairs judged at their border, and encodings by backtracking, against merging by definition."""
    ordered = 0
    for seed in range(200):
        r = random.Random(seed)
        pool, merges = ["a", "b"], []
        for _ in range(r.randint(1, 9)):
            m = r.choice(pool), r.choice(pool)
            if m not in merges:
                merges.append(m)
                pool += [m[0] + m[1]] * (m[0] + m[1] not in pool)
        vocab = {c: i for i, c in enumerate(bpe.byte_of_char())}
        for a, b in merges:
            vocab.setdefault(a + b, len(vocab))
        coder = bpe.Bpe(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}}).encode())
        if not coder.ordered:
            continue
        ordered += 1
        tokens = [vocab[t] for t in pool]
        assert all(coder.stay_apart(i, j) == coder.merge_back(i, j) for i in [*tokens, coder.first] for j in tokens)
        for _ in range(20):
            data = bytes(r.choice(b"ab") for _ in range(r.randint(1, 14)))
            assert [coder.bytes_of[i] for i in coder.encode_piece(data)] == coder.merged(data)
    assert ordered > 50


def test_bpe_word_table_turns_over(monkeypatch):
    """A table of two words gives the same ids as a large one."""
    content = queries.tokenizer_file(queries.VOCABULARY)
    words = [f" word{i % 5}".encode() for i in range(40)]
    whole = bpe.Bpe(content)
    want = [whole.word(w) for w in words]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 2)
    coder = bpe.Bpe(content)
    assert [coder.word(w) for w in words] == want
    assert len(coder.word_ids) <= 2 and len(coder.older_ids) <= 2


def test_repeated_bytes_of_periodic_texts(spark):
    """Every period from 1 to 100, two to five times in a row, each in a text whose other bytes occur once."""
    r = random.Random(3)
    letters = "".join(map(chr, range(97, 123)))
    word = lambda n: "".join(r.choices(letters, k=n))
    texts = [word(r.randint(0, 70)) + word(p) * k + word(r.randint(0, 70)) for p in range(1, 101) for k in range(2, 6)]
    texts += [word(20) + (word(50) + "\n") * 3 + word(20) for _ in range(100)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        want[i] = sum(gone), hashlib.sha256("".join(x for x, g in zip(t, gone) if not g).encode()).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.repeated_bytes(df).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, f"{len(wrong)} of {len(want)} texts"


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "one"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"),
    (2, 2, "user", ""), (2, 3, "assistant", "two"), (3, 1, "assistant", "two"), (3, 0, None, None), (3, 0, None, None), (3, None, "user", "first"),
    (7, 0, "user", "no answer"), (9, 0, "assistant", "three"), (9, 1, "user", "bye"), (None, 0, "user", "lost"), (12, 0, "assistant", None), (20, 0, "assistant", "one"),
]


def preference(a: list, b: list) -> tuple:
    """prefix_turns, prompt, chosen, its spans, rejected, its spans, turn by turn."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = []
    for part in (a[:n], a[n:], b[n:]):
        text, spans = "", []
        for role, said in part:
            text += f"<|{role}|>\n"
            spans += [(len(text), len(text) + len(said) + len("<|end|>\n"))] * (role == "assistant")
            text += f"{said}<|end|>\n"
        out += [text, spans]
    return n, out[0], *out[2:]


def by_conversation() -> dict:
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    return {c: [(r or "", x or "") for _, _, r, x in sorted((t for t in TURNS if t[0] == c), key=key)] for c in sorted({t[0] for t in TURNS if t[0] is not None})}


def formatted(df) -> dict:
    pairs = lambda spans: [tuple(s) for s in spans]
    return {(r[0], r[1]): (r["prefix_turns"], r["prompt"], r["chosen"], pairs(r["chosen_spans"]), r["rejected"], pairs(r["rejected_spans"])) for r in df.collect()}


def test_preferences_share_prefixes(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    whole = by_conversation()
    pairs = [(a, b) for a in whole for b in whole]
    got = formatted(chat.format_preferences(turns, spark.createDataFrame([*pairs, (1, 99)], "chosen_id long, rejected_id long")))
    assert got == {(a, b): preference(whole[a], whole[b]) for a, b in pairs}
    assert got[1, 2][0] == 3 and got[1, 1][2] == "" == got[1, 1][4]


def test_replaced_answers(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    whole = by_conversation()
    last = {c: max((i for i, (r, _) in enumerate(t) if r == "assistant"), default=None) for c, t in whole.items()}
    some = [c for c in whole if last[c] is not None]
    want = {}
    for a, b in zip(some, some[1:] + some[:1]):
        other = list(whole[a])
        other[last[a]] = ("assistant", whole[b][last[b]][1])
        want[a, b] = preference(whole[a], other)
    assert formatted(chat.replaced_answers(turns)) == want and want[2, 3][2] == "" and 7 not in some
    assert chat.replaced_answers(turns.filter("conv_id in (1, 7)")).count() == chat.replaced_answers(turns.limit(0)).count() == 0


def test_replaced_answers_is_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    query = queries.QUERIES["op5_preferences"]
    got = [tuple(r) for r in query.run(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(db.execute(query.sql).fetchall())
    assert got and all(r[2] > 0 and r[3] for r in got)


def test_licences_of_one_family(spark):
    """Whole texts, and versions and families that differ in a word, get their own label only."""
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version 2 of the License, or later."
    bodies = {f.stem: f.read_text() for f in licenses.WHOLE.glob("*.txt")}
    assert {"mit", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "apache-2.0"} <= bodies.keys()
    text = [
        "This work is licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 3",
        gpl.format(""), gpl.format("Lesser ").replace("program", "library"), "Licensed under the Apache License, Version 1.1", "Licensed under CC BY-NC-ND 4.0", "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0 or so. " + "other words " * 30 + "Licensed under CC BY-NC 4.0", bodies["mit"][bodies["mit"].index("THE SOFTWARE IS") :] + bodies["mit"][:300],
    ]
    df = spark.createDataFrame(list(enumerate([*text, *bodies.values()])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    got = [set(rows[i]["labels"].split(",")) - {"", *rows[i]["base_labels"].split(",")} for i in range(len(text))]
    assert got[:2] == [set(), {"gpl-3.0"}] and not got[4] and not got[5] and got[6] == {"cc-by-nc"}
    assert "lgpl" not in got[2] and got[3] == {"lgpl"} and rows[2]["labels"] == "gpl" and {s["label"] for s in rows[2]["spans"] if s["cover"] >= 0.6} >= {"gpl"}
    assert sum(s["label"] == "cc-by-nc" and s["cover"] == 1 for s in rows[7]["spans"]) == 2
    assert any(s["label"] == "mit" and s["cover"] >= 0.6 for s in rows[8]["spans"])
    for i, name in enumerate(bodies, len(text)):
        same = {s for s in rows[i]["labels"].split(",") if s in bodies}
        assert name in same and not same & {x for x in bodies if x != name and x[:3] in ("gpl", "lgp", "mpl", "gfd")}, (name, same)


def test_rates_of_domains_hard_to_tell_apart(spark):
    rows = spark.createDataFrame([(10.0, [0.48 + i / 5000, 0.52 - i / 5000]) for i in range(201)], "_n double, _p array<double>").coalesce(2)
    _, want, got = mixing.fit_rates(rows, [0.505, 0.495], total=2010.0)
    assert sum(abs(a - b) for a, b in zip(want, got)) <= mixing.TOLERANCE * 2010
    with pytest.warns(UserWarning, match="targets missed"):
        mixing.fit_rates(rows, [0.5, 0.5], total=1000.0, least=1.0)


def test_filter_before_the_sort_keeps_every_piece_that_shares_a_string():
    r = random.Random(11)
    anchor = bytes(r.randrange(97, 123) for _ in range(50))
    side = lambda: bytes(r.choice(b"ab") for _ in range(r.randint(0, 4))) + r.choice((b"x", b"y")) * r.randint(0, 55)
    for again in (False, True):
        parts = [side()[-50:] + anchor + side()[::-1][:50] for _ in range(60)]
        parts = [p for p in parts if len(p) >= 100] + ([anchor + b"z" * 3 + anchor] if again else [])
        data = np.frombuffer(b"".join(parts), np.uint8)
        key = suffix_dedup.ANCHOR.hashes(suffix_dedup.ANCHOR.sums(np.frombuffer(anchor, np.uint8)), np.array([0]), np.array([50]))
        keep = suffix_dedup.may_share(np.repeat(key.view(np.int64), len(parts)), data, np.array(list(map(len, parts))))
        strings = [{p[i : i + 100] for i in range(len(p) - 99)} for p in parts]
        shares = [any(a & b for j, b in enumerate(strings) if j != i) for i, a in enumerate(strings)]
        assert any(shares) and not all(shares) and all(k for k, s in zip(keep, shares) if s)
        assert keep.all() if again else not keep.all()


def test_runs_of_strings():
    u, s, n = suffix_dedup.in_runs(np.array([2, 1, 1, 1, 2]), np.array([5, 8, 7, 3, 6]))
    assert list(zip(u.tolist(), s.tolist(), n.tolist())) == [(1, 3, 1), (1, 7, 2), (2, 5, 2)]
    assert len(suffix_dedup.in_runs(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


class Bytes:
    """Subword reader for tests: a word is its bytes, the first one apart."""

    size = end = 512
    ids = staticmethod(lambda words: [np.array([w[0] + 256, *w[1:]], np.int32) for w in words])


def test_windows_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "loaded", lambda *_: Bytes)
    import pyarrow as pa

    texts = [None, "", "a", "ab " * 510, "ab " * 511, "ab " * 512, "x y " * 5000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(7), pa.int64()), "text": pa.array(texts, pa.string())})
    sent = type("Sent", (), {"value": ("", "")})
    out = pa.Table.from_batches(list(lm._windows(sent)(iter([batch])))).to_pylist()
    found = Counter(r["doc_id"] for r in out)
    assert [found[i] for i in range(7)] == [1, 1, 1, 1, 1, 2, 20]
    for r in out:
        words = (texts[r["doc_id"]] or "").encode().split()
        ids = [*[-1] * lm.BLOCK, 512, *(int(x) for w in Bytes.ids(words) for x in w), 512, *[-1] * lm.BLOCK]
        u = lm.BLOCK + 1 + sum(map(len, words[: r["place"]]))
        assert r["ids"] == ids[u - lm.BLOCK - 1 : u + lm.BLOCK]


def test_scores_are_those_of_masked_attention():
    """Block by block against the pass that the gradients use, also where numbers are too large for the short way."""
    from tidepanel.llm.text import Texts

    rng = np.random.default_rng(8)
    texts = [b"", b"one", b"a few words " * 3, b"more than a single block of words " * 9]
    offsets = np.cumsum([0, *map(len, texts)])
    import pyarrow as pa

    t = Texts(pa.RecordBatch.from_pydict({"i": list(range(4))}), np.frombuffer(b"".join(texts), np.uint8), offsets)
    seq = lm.Sequence(Bytes, t)
    class_of = rng.integers(0, 9, 513)
    for scale in (1, 40):
        p = lm.start(20, np.ones(9))
        p = {k: (w * scale if k in ("E", "rel") else w) for k, w in p.items()}
        model = lm.Model(p, rng.integers(0, 20, 513), class_of, np.zeros(513, np.float32), (np.arange(9) < 4).astype(np.float32))
        got, begin = model.scores(seq)
        at, want, first_of = 0, [], []
        for n in seq.doc_tokens:
            ids = np.concatenate([[512], seq.tokens[at : at + n]])
            for a in range(0, n, lm.BLOCK):
                block = lambda k: np.concatenate([x := model.input_of[ids[:n][max(k, 0) : k + lm.BLOCK]] if k >= 0 else np.zeros(0, int), np.full(lm.BLOCK - len(x), 20)])
                h = lm.attend(p, block(a)[None], block(a - lm.BLOCK)[None], np.array([a == 0]))[0][0].astype(float)
                z = h @ p["W2"] + p["b2"]
                z -= z.max(axis=1, keepdims=True)
                z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
                for i in range(min(lm.BLOCK, n - a)):
                    want.append(z[i, class_of[ids[a + i + 1]]])
                    first_of.append(np.exp(z[i, :4]).sum())
            at += n
        assert np.allclose(got, want, rtol=2e-3, atol=2e-3 * scale)
        assert np.allclose(np.exp(begin), first_of, atol=2e-3 * scale)


CLASHING = ["_n", "_p", "_k", "_z", "_e", "_sum", "_top", "_words", "_copy", "_row", "row", "id", "sha", "d", "s", "text_sha256", "keep_id"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Repeated ids with other texts, repeated rows, copies in other case, null ids, and columns named like the helpers'."""
    rows = [
        (1, "Same text"), (2, "same TEXT"), (2, "another text"), (3, "lone"), (3, "lone"), (4, None), (5, ""), (None, "lone"), (None, "nobody's"), (None, "nobody's"), (2, "yet another"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", "s", 1, *(f"{c}-own" for c in CLASHING)) for i, t in rows], schema).repartition(2)


def test_drop_copies_by_row(spark, odd_docs):
    got = corpus_pipeline.drop_copies(spark, odd_docs, "")
    assert got.columns == odd_docs.columns
    rows = got.collect()
    want = [(2, "same TEXT"), (2, "another text"), (2, "yet another"), (3, "lone"), (5, ""), (None, "nobody's")]
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(want)
    assert all(r[c] == f"{c}-own" for r in rows for c in CLASHING)
    assert corpus_pipeline.drop_copies(spark, odd_docs.limit(0), "").count() == 0


def test_mixed_keeps_clashing_columns(spark, odd_docs):
    labelled = spark.createDataFrame([(1, "en"), (3, "de")], "doc_id long, domain string")
    got = mixing.mixed(odd_docs, labelled, {"en": 0.5, "de": 0.5}, least=1.0)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert all(r[c] == f"{c}-own" for r in rows for c in CLASHING)


def test_last_stage_decodes(spark, odd_docs):
    got = corpus_pipeline.encode(spark, odd_docs, "")
    texts = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd_docs.collect())
    rows = got.collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == texts
    assert all((len(r["ids"]) > 0) == (r["decoded_sha256"] != hashlib.sha256(b"").hexdigest()) for r in rows)


@pytest.mark.parametrize("part", [1, 700, 1 << 20])
def test_repeats_are_found_anchor_by_anchor(monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    r = random.Random(part)
    seeds = [[bytes(r.choice(b"ab") for _ in range(160)) for _ in range(2)] for _ in range(8)]  # equal strings lie in one anchor
    pieces = [(a, u, r.randrange(5), r.choice(seeds[a])[r.randrange(40) :]) for a in range(8) for u in range(r.randint(1, 5))]
    anchor, uid, start, texts = zip(*pieces)
    seen, want = {}, set()
    for a, u, s, t in sorted(pieces, key=lambda p: p[:3]):
        for i in range(len(t) - 99):
            seen.setdefault((a, t[i : i + 100]), []).append((u, s + i))
    for places in seen.values():
        want |= {p for p in places if p != min(places)}
    args = (np.array(x) for x in (anchor, uid, start))
    u, s = suffix_dedup.repeated_by_anchor(*args, np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))))
    assert set(zip(u.tolist(), s.tolist())) == want and want
    assert len(suffix_dedup.repeated_by_anchor(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint8), np.zeros(0, np.int64))[0]) == 0
