"""The fit of the language model: every subword of every text is learnt from, by the right gradients."""

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import lm
from tidepanel.llm.text import texts


class Bytes:
    """Subword reader: a word is its bytes, the first one apart."""

    size = end = 512
    ids = staticmethod(lambda words: [np.array([w[0] + 256, *w[1:]], np.int32) for w in words])


TEXTS = [None, "", "a", "ab " * 15, "ab " * 16, "abc " * 40, "x y " * 500, "ab " * 16]


def sequence(text):
    return [*(int(x) for w in Bytes.ids((text or "").encode().split()) for x in w), 512]


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_every_subword_of_every_text_is_a_target_once(spark, monkeypatch, piece):
    monkeypatch.setattr(lm, "loaded", lambda *_: Bytes)
    monkeypatch.setattr(lm, "PIECE", piece)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 8)], pa.int64()), "text": pa.array(TEXTS, pa.string())})
    sent = type("Sent", (), {"value": ("", "")})
    found = pa.Table.from_batches(list(lm._subwords(sent)(iter([batch]))))
    windows = lm.blocks_of(found, Bytes.end)
    assert len(windows) == sum(found.column("blocks").to_pylist())
    want = []
    for t in TEXTS:
        ids = [-1] * lm.BLOCK + [512] + sequence(t) + [-1] * lm.BLOCK
        want += [tuple(ids[a : a + 2 * lm.BLOCK + 1]) for a in range(0, len(sequence(t)), lm.BLOCK)]
    assert sorted(map(tuple, windows.tolist())) == sorted(want)
    order = np.random.default_rng(0).permutation(found.num_rows)
    assert np.array_equal(lm.blocks_of(found.take(pa.array(order)), Bytes.end), windows)

    pieces = spark.createDataFrame(found.to_pylist(), "doc_id long, place long, blocks long, ids binary").repartition(3)
    ids = [x for t in TEXTS for x in sequence(t)]
    assert lm.usage(pieces, 512)[:, 0].tolist() == np.bincount(ids, minlength=513).tolist()
    top = np.array([ord("b"), ord("x") + 256])
    near = np.zeros((513, 4))
    for t in TEXTS:
        s = [512, *sequence(t)]
        for a, b in zip(s, s[1:]):
            if a not in top and b in top:
                near[a, list(top).index(b)] += 1
            if a in top and b not in top:
                near[b, 2 + list(top).index(a)] += 1
    assert np.array_equal(lm.usage(pieces, 512, top), near)


@pytest.mark.parametrize("spread, n", [(1, 20_000), (lm.ROUNDS, 50_000), (lm.ROUNDS, 10)])
def test_steps_use_every_window(monkeypatch, spread, n):
    seen = [set() for _ in range(lm.ROUNDS)]
    x = np.arange(n)[:, None]
    p = {"E": np.zeros(1, np.float32)}
    for turn in range(lm.ROUNDS):
        monkeypatch.setattr(lm, "gradients", lambda p, at, *_, turn=turn: (seen[turn].update(at.ravel().tolist()), p))
        lm.steps_of_round(p, x, x, x, -1, turn, 7, spread)
    assert len(set().union(*seen)) == n and (spread > 1 or all(len(s) == n for s in seen))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    p = lm.start(12, np.ones(7))
    x, prev, y = rng.integers(0, 12, (3, lm.BLOCK)), rng.integers(0, 12, (3, lm.BLOCK)), rng.integers(-1, 7, (3, lm.BLOCK))
    first = np.array([True, False, False])
    prev[0] = 12

    def loss(p):
        z = lm.attend(p, x, prev, first)[0] @ p["W2"] + p["b2"]
        z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
        i, j = np.nonzero(y >= 0)
        return -z[i, j, y[i, j]].mean()

    wide = {k: w.astype(float) for k, w in p.items()}
    room = lm.Room()
    for _ in range(2):
        got, g = lm.gradients(p, x, prev, first, y, room)
    assert np.isclose(got, loss(wide), rtol=1e-5) and set(g) == set(p)
    for k, w in wide.items():
        for at in rng.integers(0, w.size, 12):
            up, down = ({**wide, k: w + d * (np.arange(w.size) == at).reshape(w.shape)} for d in (1e-5, -1e-5))
            assert np.isclose(g[k].ravel()[at], (loss(up) - loss(down)) / 2e-5, rtol=2e-3, atol=2e-6), k


def test_words_read_together_are_words_read_alone():
    import public_tokenizers

    from tidepanel.llm import queries

    sub = lm.loaded(queries.tokenizer_file(queries.RANKS), public_tokenizers.PATTERN)
    odd = ["a   b  c  d  e　", "    x\x1cy \x1f", None, "", "it's 'tis don't' 's", "Ää ÖÖ ß", "x" * 500, "... ,,, --- 12345 a1b2 \U0001f600"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(odd)})
    for t in texts(iter([batch])):
        seq = lm.Sequence(sub, t)
        words = [w for text in odd for w in [*(text or "").translate({i: 32 for i in range(9, 14)}).split(" "), None] if w != ""]
        words = [w and "".join(c.lower() if c < "\x80" else c for c in w) for w in words]
        want = [[sub.end] if w is None else sub.encoding.encode_ordinary(" " + w) for w in words]
        assert seq.sizes.tolist() == list(map(len, want)) and seq.tokens.tolist() == sum(want, [])
    bad = pa.array([b"ok", b"\xff\xfe", b"fine"], pa.large_binary())
    flat, at, sizes = lm.subwords_of(sub, bad)
    assert [flat[a : a + n].tolist() for a, n in zip(at, sizes)] == [x.tolist() for x in sub.ids(bad.to_pylist())]


@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_pieces_are_counted_together(monkeypatch, limit):
    rng = np.random.default_rng(4)
    rows = [np.concatenate([np.full(lm.BLOCK, 513), [512], rng.integers(0, 513, n)]).astype(np.uint16) for n in (32, 1, 64, 500)] * 40
    column = pa.array([b""] + [r.tobytes() for r in rows], pa.binary()).slice(1)
    got = list(lm.joined_ids(column, np.uint16, limit))
    assert np.array_equal(np.concatenate([ids for ids, _ in got]), np.concatenate(rows))
    assert sum(len(at) for _, at in got) == len(rows) and all(at[0] == 0 for _, at in got)
    calls, count = [], np.bincount
    monkeypatch.setattr(lm.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    (out,) = lm._usage(512)(iter([pa.RecordBatch.from_arrays([column], ["ids"])]))
    assert len(calls) == 1  # not one for every piece
    want = count(np.concatenate([r[lm.BLOCK + 1 :] for r in rows]), minlength=513)
    assert dict(zip(out.column("key").to_pylist(), out.column("value").to_pylist())) == {i: n for i, n in enumerate(want.tolist()) if n}


def test_steps_are_those_of_adam(monkeypatch):
    rng = np.random.default_rng(6)
    p = {"a": rng.normal(size=(3, 2)).astype(np.float32), "b": rng.normal(size=4).astype(np.float32)}
    pull = lambda p: {k: 2 * w + (1 if k == "a" else -3) for k, w in p.items()}
    monkeypatch.setattr(lm, "gradients", lambda p, *_: (0.0, pull(p)))
    x = np.arange(8)[:, None]
    got = lm.steps_of_round(p, x, x, x, -1, 1, 7, lm.ROUNDS)
    want, steps = {k: w.astype(float) for k, w in p.items()}, -(-lm.STEPS // lm.ROUNDS)
    m, v = ({k: np.zeros_like(w) for k, w in want.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rate = lm.RATE * min(1.0, 2 * (1 - (steps + step - 1) / (steps * lm.ROUNDS)))
        for k, g in pull(want).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            want[k] = want[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    assert all(np.allclose(got[k], want[k], atol=1e-4) and got[k].shape == want[k].shape for k in want)


def test_large_numbers_give_the_same_gradients():
    """Where the exponentials would overflow, sums are shifted; all weights agree with those of a wide computation."""
    rng = np.random.default_rng(9)
    x, prev, y = rng.integers(0, 12, (2, lm.BLOCK)), rng.integers(0, 12, (2, lm.BLOCK)), rng.integers(-1, 7, (2, lm.BLOCK))
    first = np.array([False, True])
    prev[1] = 12
    p = {k: w * (12 if k in ("E", "rel", "W2") else 1) for k, w in lm.start(12, np.ones(7)).items()}
    wide = {k: w.astype(float) for k, w in p.items()}
    h = lm.attend(wide, x, prev, first)[0]
    z = h @ wide["W2"] + wide["b2"]
    assert np.abs(z).max() > 90
    z -= z.max(axis=2, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
    i, j = np.nonzero(y >= 0)
    loss, g = lm.gradients(p, x, prev, first, y)
    assert np.isclose(loss, -z[i, j, y[i, j]].mean(), rtol=1e-4) and all(np.isfinite(w).all() for w in g.values())
    d = np.exp(z)
    d[i, j, y[i, j]] -= 1
    d *= (y >= 0)[:, :, None] / len(i)
    assert np.allclose(g["W2"], np.einsum("nbi,nbc->ic", h, d), rtol=2e-3, atol=2e-3 * np.abs(g["W2"]).max())
