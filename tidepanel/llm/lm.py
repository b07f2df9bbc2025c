"""Language-model scoring: a causal self-attention model on subword ids.

A text is read as its words (A-Z lower-cased, separated by white space) and one end.  The words' subword
ids form one sequence per text, cut into blocks.  A block's positions attend to all earlier
ones of the block and of the block before, so windows overlap by half and each token is scored once.

Attention predicts a class of subwords.  Its weights are learnt from every block of every training text, the classes
from all neighbours there: shards of texts are fitted side by side and their weights averaged round by round.  The shares of subwords in their class, and the counts of words, are those of all training texts.  The probability of a word is a mixture of the attention model's,
read as subwords up to the next beginning of a word, and of the smoothed word frequency.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.llm.text import SPACE_WORD, Texts, held_out, ragged, texts, word_array

#: Positions of a block; a position sees its block so far and the block before.
BLOCK = 32
WIDTH, SINGLES, GROUPS, INPUTS = 16, 96, 12, 1024
#: The fit: a window for every block of every training text, dealt to shards of about SHARD windows.
#: In ROUNDS rounds each shard takes steps on BATCH windows from the mean of all shards' weights: STEPS in all, and more
#: if its windows need more to be used once.
SHARD, ROUNDS = 1 << 15, 3
STEPS, BATCH, RATE = 500, 64, 0.01
#: Blocks of a text that travel in one row.
PIECE = 1024
#: ``_windows`` draws one window for every STRETCH words begun of a text.
STRETCH = 512
#: White space that a cutting rule may know beyond the ASCII one that separates words; words with it are read one by one.
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words whose counts are sent to all tasks: the most frequent ones.  The others are joined.
HEAD_WORDS = 200_000
CACHE_WORDS = 200_000
#: Weight of the word frequency in the mixture.
FREQUENCY = 0.5


class Subwords:
    """Subword ids of words, each read with one space before it."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.size = max(table.values()) + 1
        self.initial = np.zeros(self.size + 1, bool)
        self.initial[[i for t, i in table.items() if t[:1] == b" "]] = True
        self.initial[self.size] = True  # the end of a text
        self.length = np.zeros(self.size, np.int64)
        self.length[list(table.values())] = [len(t) for t in table]
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[bytes, np.ndarray] = {}

    @property
    def end(self) -> int:
        return self.size

    def joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all words one after another, and how many each has, from one text of all words; None if a subword crosses words."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        sizes = np.diff(offsets)
        text = np.full(int(sizes.sum()) + len(words), 32, np.uint8)
        text[ragged(np.cumsum(sizes + 1) - sizes, sizes)] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        ids = np.array(self.encoding.encode_ordinary(text.tobytes().decode()), np.int32)
        ends = np.cumsum(self.length[ids])
        last = np.searchsorted(ends, np.cumsum(sizes + 1))
        if last[-1] >= len(ids) or not np.array_equal(ends[last], np.cumsum(sizes + 1)):
            return None
        return ids, np.diff(last, prepend=-1)

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        out = []
        for w in words:
            x = self.known.get(w)
            if x is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                x = np.array(self.encoding.encode_ordinary(" " + w.decode(errors="replace")), np.int32)
                if len(w) <= 64:
                    self.known[w] = x
            out.append(x)
        return out


_LOADED: dict[str, Subwords] = {}


def loaded(ranks: bytes, pattern: str) -> Subwords:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Subwords(ranks, pattern)
    return _LOADED[key]


def subwords_of(sub: Subwords, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids, and where in them each of some words begins and how many it has."""
    alone = np.ones(len(words), bool)
    got = None
    if hasattr(sub, "joined"):
        try:
            alone = pc.match_substring_regex(words.cast(pa.large_string()), ODD_SPACE).to_numpy(zero_copy_only=False).astype(bool)
            got = sub.joined(words.filter(pa.array(~alone)))
        except (pa.ArrowInvalid, UnicodeDecodeError):
            pass  # not UTF-8
    if got is None:
        alone[:] = True
        got = np.zeros(0, np.int32), np.zeros(0, np.int64)
    own = sub.ids(words.filter(pa.array(alone)).to_pylist())
    sizes = np.zeros(len(words), np.int64)
    sizes[~alone], sizes[alone] = got[1], [len(x) for x in own]
    at = np.zeros(len(words), np.int64)
    at[~alone] = np.cumsum(sizes[~alone]) - sizes[~alone]
    at[alone] = len(got[0]) + np.cumsum(sizes[alone]) - sizes[alone]
    return np.concatenate([got[0], *own]), at, sizes


class Sequence:
    """Words and subwords of some texts, an end after each text."""

    def __init__(self, sub: Subwords, t: Texts):
        low = t.lowered()
        starts, ends = low.words(SPACE_WORD)
        coded = word_array(low.data, starts, ends).dictionary_encode()
        self.dictionary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        first = np.searchsorted(starts, low.offsets)
        self.end_code = len(self.dictionary)
        self.codes = np.insert(codes.astype(np.int64), first[1:], self.end_code)
        self.doc_words = np.diff(first) + 1  # with the end
        flat, at, sizes = subwords_of(sub, self.dictionary)
        at, sizes = np.append(at, len(flat)), np.append(sizes, 1)
        flat = np.append(flat, np.int32(sub.end))
        self.sizes = sizes[self.codes]
        self.tokens = flat[ragged(at[self.codes], self.sizes)]
        self.word_at = np.cumsum(self.sizes) - self.sizes
        last = np.cumsum(self.doc_words)
        upto = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc_tokens = np.diff(upto[np.concatenate([[0], last])])
        self.doc_of_word = np.repeat(np.arange(len(t)), self.doc_words)


class Room:
    """Arrays used again for each group of blocks; fresh ones would cost more than the sums."""

    def __init__(self):
        self.arrays: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.arrays or len(self.arrays[name]) < size:
            self.arrays[name] = np.empty(size, kind)
        return self.arrays[name][:size].reshape(shape)


@dataclass
class Model:
    params: dict[str, np.ndarray]
    input_of: np.ndarray  # by subword id; the last input is padding
    class_of: np.ndarray
    log_share: np.ndarray  # of a subword in its class
    initial: np.ndarray  # by class: 1 if its subwords begin words

    def __post_init__(self):
        p = self.params
        self.masses = np.stack([np.ones_like(self.initial), self.initial], axis=1).astype(np.float32)
        # an input's share in queries, keys and values depends on nothing else, so it is looked up
        one = np.ones((len(p["E"]), 1), np.float32)
        self.asks = np.hstack([p["E"] @ (p["Wq"] / np.float32(np.sqrt(WIDTH))), p["E"] @ p["Wr"] + p["b"]])
        self.keys = np.ascontiguousarray(p["E"] @ p["Wk"])
        self.values = np.hstack([p["E"] @ p["Wv"] @ p["Wo"], one])
        self.bias = p["rel"][DISTANCE] + CAUSAL
        self.last = np.vstack([p["W2"], p["b2"]])
        # of two tables' rows no inner product exceeds the product of their largest norms
        longest = lambda rows: np.sqrt((rows**2).sum(axis=1).max())
        self.small = bool(longest(self.asks[:, :WIDTH]) * longest(self.keys) + np.abs(p["rel"]).max() < 60)

    def hidden(self, x: np.ndarray, first: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Last layer's inputs, a one after each, of the blocks x[1:]; each sees the block before it unless it is a text's first."""
        n, room = len(first), room or Room()
        own = np.take(self.asks, x[1:], axis=0, out=room("own", n, BLOCK, 2 * WIDTH), mode="clip")
        both = lambda t: as_strided(t, (n, 2 * BLOCK, t.shape[2]), t.strides)
        look = lambda table, name: np.take(table, x, axis=0, out=room(name, *x.shape, table.shape[1]), mode="clip")
        keys, values = look(self.keys, "keys"), look(self.values, "values")
        s = np.matmul(own[:, :, :WIDTH], both(keys).transpose(0, 2, 1), out=room("s", n, BLOCK, 2 * BLOCK))
        s += self.bias
        s[first, :, :BLOCK] = -1e9  # the block before belongs to another text
        if not self.small and (s.max() > 60 or np.diagonal(s, BLOCK, 1, 2).min() < -60):  # else neither overflow nor a vanishing sum
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        c = np.matmul(s, both(values), out=room("c", n, BLOCK, WIDTH + 1))
        c /= c[:, :, WIDTH:].copy()  # the last column becomes a one
        c[:, :, :WIDTH] += own[:, :, WIDTH:]
        out = np.maximum(c, 0, out=c)
        return out.reshape(-1, WIDTH + 1)

    def scores(self, seq: Sequence, group: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each subword's probability, and of the probability that a word begins there."""
        pad = len(self.params["E"]) - 1
        n_blocks = -(-seq.doc_tokens // BLOCK)
        block_at = np.cumsum(n_blocks) - n_blocks
        place = ragged(block_at * BLOCK, seq.doc_tokens)
        total = int(n_blocks.sum())
        x = np.full((total + 1) * BLOCK, pad)
        before = np.empty(len(seq.tokens), np.int64)
        before[1:] = seq.tokens[:-1]
        before[np.cumsum(seq.doc_tokens) - seq.doc_tokens] = len(self.input_of) - 1  # an end before each text
        x[place + BLOCK] = self.input_of[before]  # one block of padding leads
        x = x.reshape(-1, BLOCK)
        y = np.zeros(total * BLOCK, np.int64)
        y[place] = self.class_of[seq.tokens]
        y += np.arange(total * BLOCK) % (group * BLOCK) * self.last.shape[1]  # where it is among the numbers of its group
        first = np.zeros(total, bool)
        first[block_at] = True
        own, mass = np.empty(total * BLOCK, np.float32), np.empty((total * BLOCK, 2), np.float32)
        room = Room()
        for a in range(0, total, group):
            b = min(a + group, total)
            z = np.matmul(self.hidden(x[a : b + 1], first[a:b], room), self.last, out=room("z", (b - a) * BLOCK, self.last.shape[1]))
            if max(z.max(), -z.min()) > 80:
                z -= z.max(axis=1, keepdims=True)
            np.take(z.reshape(-1), y[a * BLOCK : b * BLOCK], out=own[a * BLOCK : b * BLOCK], mode="clip")
            np.exp(z, out=z)
            np.matmul(z, self.masses, out=mass[a * BLOCK : b * BLOCK])
        log_all = np.log(mass[:, 0])
        lp, li = own - log_all, np.log(np.maximum(mass[:, 1], 1e-30)) - log_all
        return lp[place] + self.log_share[seq.tokens], li[place]

    def word_scores(self, seq: Sequence) -> np.ndarray:
        """Natural log probability of each word (and end) given what is before it."""
        lp, li = self.scores(seq)
        lp = lp.astype(float)
        begins = li[seq.word_at].astype(float)
        after = np.zeros(len(begins))
        after[:-1] = begins[1:]
        after[np.cumsum(seq.doc_words) - 1] = 0.0  # nothing follows an end
        return np.add.reduceat(lp, seq.word_at) - begins + after


CAUSAL = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK, 2 * BLOCK)[:, None], 0.0, -1e9).astype(np.float32)
DISTANCE = np.clip(np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)


def attend(p: dict, x: np.ndarray, prev: np.ndarray, first: np.ndarray):
    """Masked attention of blocks x over themselves and the blocks before, all in one batch."""
    both = np.concatenate([prev, x], axis=1)
    e = p["E"][both]
    own = e[:, BLOCK:]
    q = own @ (p["Wq"] / np.float32(np.sqrt(WIDTH)))
    k, v = e @ p["Wk"], e @ p["Wv"]
    s = q @ k.transpose(0, 2, 1)
    s += p["rel"][DISTANCE] + CAUSAL
    s[first, :, :BLOCK] = -1e9  # the block before belongs to another text
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    c = s @ v
    h = own @ p["Wr"] + c @ p["Wo"] + p["b"]
    np.maximum(h, 0, out=h)
    return h, e, own, q, k, v, s, c, both


def gradients(p: dict, x, prev, first, y, room: Room | None = None) -> tuple[float, dict]:
    """Mean loss and gradients."""
    room, n, wide, scale = room or Room(), len(x), 2 * BLOCK, np.float32(1 / np.sqrt(WIDTH))
    both_at = np.concatenate([prev, x], axis=1)
    look = lambda table, at, name: np.take(table, at, axis=0, out=room(name, *at.shape, table.shape[1]), mode="clip")
    to_own, to_both = np.hstack([p["Wq"] * scale, p["Wr"]]), np.hstack([p["Wk"], p["Wv"]])
    asks, keys = p["E"] @ to_own, p["E"] @ to_both  # an input's share in queries, keys and values depends on nothing else
    asks[:, WIDTH:] += p["b"]
    own, both = look(asks, x, "own"), look(keys, both_at, "both")
    q, k, v = own[:, :, :WIDTH], both[:, :, :WIDTH], both[:, :, WIDTH:]
    s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, BLOCK, wide))
    s += p["rel"][DISTANCE] + CAUSAL
    s[first, :, :BLOCK] = -1e9  # the block before belongs to another text
    if s.max() > 60 or np.diagonal(s, BLOCK, 1, 2).min() < -60:  # else neither overflow nor a vanishing sum
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    total = (s.reshape(-1, wide) @ np.ones(wide, np.float32))[:, None]
    c = np.matmul(s, v, out=room("c", n, BLOCK, WIDTH)).reshape(-1, WIDTH)
    c /= total
    h = np.ones((n * BLOCK, WIDTH + 1), np.float32)
    np.maximum(c @ p["Wo"] + own.reshape(-1, 2 * WIDTH)[:, WIDTH:], 0, out=h[:, :WIDTH])
    last, back = np.vstack([p["W2"], p["b2"]]), np.vstack([p["W2"], np.ones_like(p["b2"])])
    z = np.matmul(h, last, out=room("z", len(h), last.shape[1]))
    if max(z.max(), -z.min()) > 60:
        z -= z.max(axis=1, keepdims=True)
    seen = np.flatnonzero(y.ravel() >= 0)
    to, m = y.ravel()[seen], max(1, len(seen))
    hit = z[seen, to]
    np.exp(z, out=z)
    dh = z @ back.T  # of the masses, their sums beside it
    mass = dh[seen, WIDTH]
    loss = (np.log(mass) - hit).sum() / m
    part = np.zeros((len(h), 1), np.float32)
    part[seen, 0] = 1 / (m * mass)
    dh = dh[:, :WIDTH] * part
    pull = np.vstack([p["W2"].T / np.float32(m), np.zeros(WIDTH, np.float32)])  # the last row for what is not seen
    dh -= np.take(pull, y.ravel(), axis=0, mode="wrap")
    dh *= h[:, :WIDTH] > 0
    z[seen, to] -= mass
    g_last = (h * part).T @ z
    dc = dh @ p["Wo"].T
    dc /= total
    ds = np.matmul(dc.reshape(n, BLOCK, WIDTH), v.transpose(0, 2, 1), out=room("ds", n, BLOCK, wide))
    ds -= np.einsum("ij,ij->i", dc, c).reshape(n, BLOCK, 1)
    ds *= s
    near = np.ones(n, np.float32) @ ds.reshape(n, -1)
    d_own, d_both = room("d own", n, BLOCK, 2 * WIDTH), room("d both", n, wide, 2 * WIDTH)
    np.matmul(ds, k, out=d_own[:, :, :WIDTH])
    d_own[:, :, WIDTH:] = dh.reshape(n, BLOCK, WIDTH)
    np.matmul(ds.transpose(0, 2, 1), q, out=d_both[:, :, :WIDTH])
    np.matmul(s.transpose(0, 2, 1), dc.reshape(n, BLOCK, WIDTH), out=d_both[:, :, WIDTH:])
    d_own, d_both = d_own.reshape(-1, 2 * WIDTH), d_both.reshape(-1, 2 * WIDTH)
    e = look(p["E"], both_at, "e")
    g_own, g_both = e[:, BLOCK:].reshape(-1, WIDTH).T @ d_own, e.reshape(-1, WIDTH).T @ d_both
    # a position's share in the gradient of its input, in both of its parts, is summed by input once
    de = np.matmul(d_both, to_both.T, out=room("de", len(d_both), WIDTH)).reshape(n, wide, WIDTH)
    de[:, BLOCK:] += (d_own @ to_own.T).reshape(n, BLOCK, WIDTH)
    cells = np.add((both_at * WIDTH)[:, :, None], np.arange(WIDTH), out=room("cells", n, wide, WIDTH, kind=np.int64))
    g = {"E": np.zeros_like(p["E"]), "Wq": g_own[:, :WIDTH] * scale, "Wk": g_both[:, :WIDTH], "Wv": g_both[:, WIDTH:], "Wr": g_own[:, WIDTH:]}
    np.add.at(g["E"].reshape(-1), cells.reshape(-1), de.reshape(-1))
    g |= {"Wo": c.T @ dh, "b": dh.sum(0), "W2": g_last[:WIDTH], "b2": g_last[WIDTH]}
    g["rel"] = np.bincount(DISTANCE.ravel(), weights=near, minlength=wide).astype(np.float32)
    return float(loss), g


def start(n_inputs: int, classes: np.ndarray, seed: int = 3) -> dict:
    """Weights before the first step; ``classes`` counts how often each class is used."""
    rng = np.random.default_rng(seed)
    new = lambda *shape, s=0.3: (rng.normal(0, s, shape)).astype(np.float32)
    p = {"E": new(n_inputs + 1, WIDTH), **{w: new(WIDTH, WIDTH, s=WIDTH**-0.5) for w in ("Wq", "Wk", "Wv", "Wr", "Wo")}}
    p |= {"b": np.zeros(WIDTH, np.float32), "W2": new(WIDTH, len(classes)), "rel": np.zeros(2 * BLOCK, np.float32)}
    share = classes + 0.5
    return p | {"b2": np.log(share / share.sum()).astype(np.float32)}


def steps_of_round(p: dict, prev: np.ndarray, x: np.ndarray, y: np.ndarray, n_inputs: int, turn: int, seed: int, spread: int = ROUNDS) -> dict:
    """One round of Adam: inputs of two blocks, classes that follow in the second (-1: none).  Over ``spread`` rounds
    every window is used."""
    flat = np.concatenate([w.ravel() for w in p.values()])
    cuts = np.cumsum([0, *(w.size for w in p.values())]).tolist()
    p = {n: flat[a:b].reshape(w.shape) for (n, w), a, b in zip(p.items(), cuts, cuts[1:])}
    order = np.random.default_rng(seed).permutation(len(x))
    size = min(BATCH, len(x))
    steps = max(-(-STEPS // ROUNDS), -(-len(x) // (spread * size)))
    first = (prev == n_inputs).all(axis=1)
    m, v, g, t = (np.zeros_like(flat) for _ in range(4))
    room = Room()
    for step in range(1, steps + 1):
        done = turn * steps + step - 1
        at = order[(done * size + np.arange(size)) % len(x)]
        _, found = gradients(p, x[at], prev[at], first[at], y[at], room)
        rate = RATE * min(1.0, 2 * (1 - done / (steps * ROUNDS)))
        np.concatenate([found[n].ravel() for n in p], out=g)
        m += np.multiply(np.subtract(g, m, out=t), np.float32(0.1), out=t)
        v += np.multiply(np.subtract(np.square(g, out=g), v, out=g), np.float32(0.01), out=g)
        np.sqrt(np.divide(v, np.float32(1 - 0.99**step), out=t), out=t)
        t += np.float32(1e-8)
        flat -= np.multiply(np.divide(m, t, out=t), np.float32(rate / (1 - 0.9**step)), out=t)
    return p


def cluster(points: np.ndarray, weight: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Weighted k-means; rows without weight, or all if fewer than k have some, are in the last group."""
    seen = np.flatnonzero(weight)
    out = np.full(len(points), k - 1)
    if len(seen) < k:
        return out
    points, weight = points[seen], weight[seen]
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        near = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
        for i in range(k):
            if (near == i).any():
                centres[i] = np.average(points[near == i], axis=0, weights=weight[near == i])
    out[seen] = near
    return out


def kind_of(end: int) -> type:
    """How subword ids travel; end + 1 stands for no subword."""
    return np.uint16 if end + 1 < 1 << 16 else np.int32


def blocks_of(table, end: int) -> np.ndarray:
    """A window for every block of the pieces, -1 where there is no subword; in an order that does not depend on how the pieces arrived."""
    kind = kind_of(end)
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["place"], r["ids"]) for r in table.select(["doc_id", "place", "ids"]).to_pylist())
    out = []
    for *_, ids in rows:
        ids = np.frombuffer(ids, kind)
        out.append(as_strided(ids, ((len(ids) - BLOCK - 1) // BLOCK, 2 * BLOCK + 1), (BLOCK * ids.itemsize, ids.itemsize)))
    out = np.concatenate(out).astype(np.int64)
    out[out > end] = -1
    return out


def joined_ids(rows: pa.Array, kind: type, limit: int = 1 << 20):
    """Subword ids of some rows one after another, and where each begins; about ``limit`` ids at a time (one row at least)."""
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    at, size = 0, np.dtype(kind).itemsize
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit * size, side="right")) - 1)
        ids = np.frombuffer(data, np.uint8)[offsets[at] : offsets[stop]].copy().view(kind).astype(np.int64)
        yield ids, (offsets[at:stop] - offsets[at]) // size
        at = stop


def _usage(end: int, top: np.ndarray | None = None):
    """How often each subword occurs; with ``top``: how often each one that is not in it stands right before and right
    after one of it, as keys id * 2 * len(top) + column."""
    width = 1 if top is None else 2 * len(top)

    def run(batches):
        total = np.zeros((end + 2) * width, np.int64 if top is None else np.int32)
        if top is not None:
            col = np.full(end + 2, -1)
            col[top] = np.arange(len(top))
        for batch in batches:
            for ids, starts in joined_ids(batch.column("ids"), kind_of(end)):
                own = np.ones(len(ids), bool)  # from the subword before the first block on
                own[ragged(starts, np.full(len(starts), BLOCK + (top is None)))] = False
                if top is None:
                    total += np.bincount(ids[own], minlength=len(total))
                    continue
                c, pair = col[ids], own[1:] & own[:-1]
                before, after = np.flatnonzero(pair & (c[1:] >= 0) & (c[:-1] < 0)), np.flatnonzero(pair & (c[:-1] >= 0) & (c[1:] < 0))
                keys = np.concatenate([ids[before] * width + c[before + 1], ids[after + 1] * width + len(top) + c[after]])
                np.add.at(total, keys, np.ones(len(keys), total.dtype))
        at = np.flatnonzero(total[: (end + 1) * width])
        for a in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + (1 << 18)]), pa.array(total[at[a : a + (1 << 18)]].astype(np.int64))], ["key", "value"])

    return run


def usage(pieces: DataFrame, end: int, top: np.ndarray | None = None) -> np.ndarray:
    """Sums over all pieces, whose number of cells is bounded by the vocabulary."""
    sums = pieces.select("ids").mapInArrow(_usage(end, top), "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    width = 1 if top is None else 2 * len(top)
    out = np.zeros((end + 1) * width)
    out[sums.column("key").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(end + 1, width)


def learn(pieces: DataFrame, n_windows: int, initial: np.ndarray) -> Model:
    """pieces: (doc_id, place, blocks, ids) of all training texts.  The driver gets sums by subword and by weight, whatever their number."""
    spark = pieces.sparkSession
    n, end = len(initial), len(initial) - 1
    counts = usage(pieces, end)[:, 0]
    order = np.lexsort((np.arange(n), -counts))
    order = order[order != end]
    class_of = np.empty(n, np.int64)
    class_of[end] = 0
    top = order[:SINGLES]
    class_of[top] = 1 + np.arange(len(top))
    rest, base = order[SINGLES:], 1 + len(top)
    vec = usage(pieces, end, top)
    points = np.sqrt(vec / np.maximum(counts, 1)[:, None])
    for flag in (True, False):
        own = rest[initial[rest] == flag]
        class_of[own] = base + cluster(points[own], counts[own], GROUPS)
        base += GROUPS
    smooth = counts + 0.01
    mass = np.bincount(class_of, weights=smooth, minlength=base)
    log_share = np.log(smooth / mass[class_of])
    input_of = np.empty(n, np.int64)
    input_of[:] = INPUTS + class_of
    input_of[order[: INPUTS - 1]] = np.arange(min(INPUTS - 1, len(order)))
    input_of[end] = INPUTS - 1
    n_inputs = INPUTS + base
    first_of = np.zeros(base, np.float32)
    first_of[class_of[initial]] = 1
    params = start(n_inputs, np.bincount(class_of, weights=counts, minlength=base))
    # copies of a text are dealt to different shards; each round takes another part of the texts, unless there is one shard
    shards = max(1, -(-n_windows // SHARD))
    spread = ROUNDS if shards == 1 else 1
    deal = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "place", "ids"), F.lit(k))
    dealt = pieces.withColumn("shard", deal(1, shards))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((params, input_of, class_of))
        windows = dealt if spread > 1 else dealt.filter(deal(2, ROUNDS) == turn)
        got = windows.groupBy("shard").applyInArrow(_round(sent, n_inputs, turn, spread), "at int, weighted long, windows long")
        got = got.groupBy("at").agg(F.sum("weighted").alias("w"), F.sum("windows").alias("n")).toArrow()
        if not got.num_rows:
            continue
        flat = np.empty(got.num_rows)
        flat[got.column("at").to_numpy()] = got.column("w").to_numpy() / got.column("n").to_numpy() / FIXED
        cuts = np.cumsum([w.size for w in params.values()])[:-1]
        params = {k: part.reshape(w.shape).astype(np.float32) for (k, w), part in zip(params.items(), np.split(flat, cuts))}
    return Model(params, input_of, class_of, log_share.astype(np.float32), first_of)


#: Weights travel as whole multiples of 1 / FIXED, so that their sums depend on no order.
FIXED = 1 << 20


def _round(sent, n_inputs: int, turn: int, spread: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        params, input_of, class_of = sent.value
        w = blocks_of(table, len(input_of) - 1)
        ins = np.where(w[:, :-1] >= 0, input_of[w[:, :-1]], n_inputs)
        outs = np.where((w[:, BLOCK + 1 :] >= 0) & (w[:, BLOCK:-1] >= 0), class_of[w[:, BLOCK + 1 :]], -1)
        params = steps_of_round(params, ins[:, :BLOCK], ins[:, BLOCK:], outs, n_inputs, turn, key[0].as_py(), spread)
        flat = np.concatenate([x.ravel() for x in params.values()]).astype(float)
        return pa.table({"at": np.arange(len(flat), dtype=np.int32), "weighted": np.rint(flat * len(w) * FIXED).astype(np.int64), "windows": np.full(len(flat), len(w), np.int64)})

    return run


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n: over all texts."""

    def run(batches):
        for t in texts(batches, limit=12 << 20):
            low = t.lowered()
            coded = word_array(low.data, *low.words(SPACE_WORD)).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(words: DataFrame) -> int:
    """The count from which on at most HEAD_WORDS words have it; found from counts by powers of 2^(1/8)."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    found = {r["step"]: r["count"] for r in words.groupBy(step).count().collect()}
    cut, total = max(found, default=0) + 1, 0
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > HEAD_WORDS:
            break
        cut = k
    return math.ceil(2 ** (cut / 8) - 1e-9) if cut > 0 else 1


def _windows(sent):
    """Draws a window for every STRETCH words begun of a text (the end counts): the subwords from a word of that stretch on, and those before it.
    A look at texts only: the fit takes all of ``subword_pieces``."""

    def run(batches):
        sub = loaded(*sent.value)
        for t in texts(batches):
            low = t.lowered()
            starts, ends = low.words(SPACE_WORD)
            upto = np.searchsorted(starts, low.offsets).tolist()
            words = word_array(low.data, starts, ends)
            rows, docs, places = [], [], []
            for i, doc in enumerate(t.rows.column("doc_id").to_pylist()):
                a, b = upto[i], upto[i + 1]
                rng = np.random.default_rng(zlib.crc32(str(doc).encode()))
                for at in range(a, b + 1, STRETCH):
                    u = int(rng.integers(at, min(at + STRETCH, b + 1)))
                    lo, hi = max(a, u - BLOCK - 1), min(b, u + BLOCK)
                    ids = sub.ids(words.slice(lo, hi - lo).to_pylist())
                    left = np.concatenate([np.full(BLOCK, -1), [sub.end], *ids[: u - lo]])[-BLOCK - 1 :]
                    right = np.concatenate([*ids[u - lo :], [sub.end] if hi == b else [], np.full(BLOCK, -1)])[:BLOCK]
                    rows.append(np.concatenate([left, right]).astype(np.int32))
                    docs.append(doc)
                    places.append(u - a)
            if rows:
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * (2 * BLOCK + 1) + 1, 2 * BLOCK + 1, dtype=np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), ids], ["doc_id", "place", "ids"])

    return run


def _subwords(sent):
    """Rows of a text's subwords: those of up to PIECE blocks, of the block before them and the one before that."""

    def run(batches):
        sub = loaded(*sent.value)
        kind = kind_of(sub.end)
        for t in texts(batches, limit=4 << 20):
            seq = Sequence(sub, t)
            blocks = -(-seq.doc_tokens // BLOCK)
            size = blocks * BLOCK + BLOCK + 1
            begin = np.cumsum(size) - size
            flat = np.full(int(size.sum()), sub.end + 1, kind)
            flat[begin + BLOCK] = sub.end  # an end before each text
            flat[ragged(begin + BLOCK + 1, seq.doc_tokens)] = seq.tokens
            parts = -(-blocks // PIECE)
            doc, place = np.repeat(np.arange(len(t)), parts), ragged(np.zeros(len(t), np.int64), parts)
            own = np.minimum(blocks[doc] - place * PIECE, PIECE)
            size = own * BLOCK + BLOCK + 1
            flat = flat[ragged(begin[doc] + place * PIECE * BLOCK, size)]
            at = np.concatenate([[0], np.cumsum(size)]) * flat.itemsize
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id").take(pa.array(doc)), pa.array(place), pa.array(own), ids], ["doc_id", "place", "blocks", "ids"])

    return run


def subword_pieces(train: DataFrame, sent) -> DataFrame:
    """(doc_id, place, blocks, ids): the subwords of whole texts."""
    return train.select("doc_id", "text").mapInArrow(_subwords(sent), "doc_id long, place long, blocks long, ids binary")


PARTS = "row long, doc_id long, held_out boolean, word binary, lp double, n_tokens long, n_known long, base double, score double"


def lm_scores(docs: DataFrame, ranks: bytes, pattern: str, frequency: float = FREQUENCY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (crc32 of the id, remainder 2 modulo 7).  Null and empty texts are one
    end.  Without training rows all probabilities of the base are 1 and so is the model's.
    ``ranks`` is the content of a public vocabulary file of byte-level BPE, ``pattern`` its cutting rule.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    train = docs.filter("not held_out")
    sent = spark.sparkContext.broadcast((ranks, pattern))

    words = materialise(count_words(train), "words")
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = train.select("doc_id").count()
    n_all, v_all = tokens + ends, distinct + (ends > 0)
    least = frequent_from(words)
    head = words.filter(F.col("n") >= least).toArrow()

    sub = loaded(ranks, pattern)
    pieces = materialise(subword_pieces(train, sent), "subwords")
    n_windows = pieces.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    model = learn(pieces, n_windows, sub.initial) if n_all else None

    z = float(n_all + v_all + 1)
    known = spark.sparkContext.broadcast((head.column("word").cast(pa.large_binary()).combine_chunks(), head.column("n").to_numpy(), model))
    share = frequency if n_windows else 1.0
    run = _score(sent, known, ends, z, share)
    # the words that are not among the frequent ones come as rows of their own, to meet their counts
    parts = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, PARTS)
    parts = materialise(parts, "scored")
    rare = parts.filter("word is not null").select("row", "word", "lp")
    rare = rare.join(words.filter(F.col("n") < least), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = (F.col("n") + 1) / F.lit(z)
    rare = rare.groupBy("row").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("k2"), F.sum(F.log10(p)).alias("b2"), F.sum(F.log10(F.lit(share) * p + F.lit(1 - share) * F.exp("lp"))).alias("s2")
    )
    out = parts.filter("word is null").join(rare, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "k2").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        plus("base", "b2").alias("base_score"), plus("score", "s2").alias("score"),
    )


def _score(sent, known, ends: int, z: float, share: float):
    def run(batches):
        sub = loaded(*sent.value)
        head, head_n, model = known.value
        for t in texts(batches, limit=4 << 20):
            seq = Sequence(sub, t)
            lp = model.word_scores(seq) if model is not None else np.zeros(len(seq.codes))
            at = pc.fill_null(pc.index_in(seq.dictionary, value_set=head), -1).to_numpy(zero_copy_only=False)
            n = np.concatenate([np.where(at >= 0, head_n[at] if len(head_n) else 0, -1), [ends]])[seq.codes]
            here = n >= 0
            p = (n + 1) / z
            with np.errstate(divide="ignore"):
                base = np.where(here, np.log10(np.where(here, p, 1)), 0)
                score = np.where(here, np.log10(np.where(here, share * p + (1 - share) * np.exp(lp), 1)), 0)
            docs, k = seq.doc_of_word, len(t)
            row, ids, out = (t.rows.column(c) for c in ("row", "doc_id", "held_out"))
            sums = [np.bincount(docs, weights=w, minlength=k) for w in (n > 0, base, score)]
            nothing = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays(
                [row, ids, out, nothing(pa.binary(), k), nothing(pa.float64(), k), pa.array(seq.doc_words.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], NAMES
            )
            far = np.flatnonzero(~here)
            if len(far):
                w = seq.dictionary.take(pa.array(seq.codes[far])).cast(pa.binary())
                size = len(far)
                rows = row.take(pa.array(docs[far]))
                yield pa.RecordBatch.from_arrays(
                    [rows, nothing(pa.int64(), size), nothing(pa.bool_(), size), w, pa.array(lp[far]), nothing(pa.int64(), size), nothing(pa.int64(), size), nothing(pa.float64(), size), nothing(pa.float64(), size)], NAMES
                )

    return run


NAMES = [c.split()[0] for c in PARTS.split(", ")]
