"""Byte-pair encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are compatible,
that is, if merging their joint bytes gives the two again.  So encoding walks from left to right:
take the longest token that starts here (an Aho-Corasick scan finds them all at once), check it against the
token before, try its next shorter prefix if they are not compatible, and step back if none is left.  A
position from which nothing fits is marked, hence no place is tried twice.

The vocabulary is given as the content of a public tokenizer file.  Nothing is trained.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.text import Texts, ragged, texts, word_array

#: Bounds of the tables that a worker keeps, for memory alone: results stay the same beyond them.
CACHE_WORDS, CACHE_PAIRS = 400_000, 1 << 19

# Fixed value: how byte-level BPE cuts texts before merging; \s by the Unicode property
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_of_char() -> dict[str, int]:
    """Vocabulary files write each byte as one printable character: itself, or the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return {chr(b if b in shown else next(extra)): b for b in range(256)}


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        byte, model = byte_of_char(), spec["model"]
        raw = lambda s: bytes(byte[c] for c in s)
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: b for b, i in self.added.items()}
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t.decode()) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        # offset table: the bytes of all tokens one after another
        size = max(self.bytes_of, default=-1) + 1
        parts = [self.bytes_of.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # tokens that merging can reach, and of each the longest that begins it; -1 is none
        made = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        known = {t: i for t, i in self.id_of.items() if t in made}
        # read backwards, the tokens that start at a place are those that end there, the longest first
        self.scan = ahocorasick.Automaton()
        for t, i in known.items():
            self.scan.add_word(t[::-1].decode("latin-1"), i)
        self.scan.make_automaton()
        self.shorter = [-1] * size
        for t, i in known.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.sizes = self.lengths.tolist()
        self.known, self.first = known, size
        # whether each token has one merge, after those that make its parts, as in any trained vocabulary
        made_at: dict[bytes, int] = {}
        self.ordered = True
        for r, (x, y) in enumerate(self.rank):
            self.ordered &= x + y not in made_at and all(len(z) == 1 or z in made_at for z in (x, y))
            made_at[x + y] = r
        self.edges: dict[tuple[int, bool], list | None] = {}
        self.pair_fits: dict[int, bool] = {}
        self.names = list(map(str, range(size)))
        # encodings of words as packed 32-bit ids: those of late, and those before
        self.word_ids: dict[bytes, bytes] = {}
        self.older_ids: dict[bytes, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges by definition: the pair of lowest rank first, leftmost among equals.  For short byte strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """The table of compatible neighbours, filled as pairs occur; ``first`` stands before the first token.

        A token alone is looked at too: its merge may be unreachable behind earlier ones.
        """
        key = a << 32 | b
        fit = self.pair_fits.get(key)
        if fit is None:
            if len(self.pair_fits) >= CACHE_PAIRS:
                self.pair_fits.clear()
            fit = self.pair_fits[key] = self.stay_apart(a, b) if self.ordered else self.merge_back(a, b)
        return fit

    def merge_back(self, a: int, b: int) -> bool:
        """Compatibility by definition."""
        parts = [self.bytes_of[i] for i in (a, b) if i != self.first]
        return self.merged(b"".join(parts)) == parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Compatibility from what stands at the border of both tokens while each is merged.

        A merge across the border needs two parts that are there at the same time: after both were made, before
        either became part of something longer.  Of equal merges the left one goes first, hence the
        border's goes before that of the right token, but not before that of the left one.
        """
        right = self.edge(b, False)
        if right is None or a == self.first:
            return right is not None
        left = self.edge(a, True)
        if left is None:
            return False
        for x, born_x, gone_x in left:
            for y, born_y, gone_y in right:
                r = self.rank.get((x, y))
                if r is not None and born_x < r < gone_x and born_y < r <= gone_y:
                    return False
        return True

    def edge(self, i: int, last: bool) -> list[tuple[bytes, int, int]] | None:
        """Parts that stand last (or first) while the token's bytes are merged, each with the merges that make it and end it.

        None if merging does not give the token back.
        """
        key = (i, last)
        if key not in self.edges:
            at = -1 if last else 0
            data = self.bytes_of[i]
            parts = [data[k : k + 1] for k in range(len(data))]
            part, born, out = parts[at], -1, []
            while len(parts) > 1:
                rank, k = min((self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts[at]) > len(part):
                    out.append((part, born, rank))
                    part, born = parts[at], rank
            self.edges[key] = [*out, (part, born, 1 << 60)] if len(parts) == 1 else None
        return self.edges[key]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece, within which any merge is allowed."""
        whole = self.known.get(data)
        if whole is not None and self.fits(self.first, whole):
            return [whole]
        found = list(self.scan.iter(data[::-1].decode("latin-1")))
        found.reverse()
        longest = dict(found)  # by the bytes that are left behind the first one; the last entry wins
        sizes, shorter, fitting = self.sizes, self.shorter, self.pair_fits.get
        dead = set()
        out: list[int] = []
        left, before, token = len(data), self.first, longest.get(len(data) - 1, -1)
        while left:
            while token >= 0:
                if left - sizes[token] not in dead:
                    fit = fitting(before << 32 | token)
                    if fit or (fit is None and self.fits(before, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                left -= sizes[token]
                before, token = token, longest.get(left - 1, -1)
                continue
            if not out:
                raise ValueError("bytes that the vocabulary cannot express")
            dead.add(left)
            token = out.pop()
            left += sizes[token]
            before = out[-1] if out else self.first
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; added tokens that it spells out are single ids."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0].encode()])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self.cut.findall(text) for i in self.encode_piece(piece.encode())]

    def word(self, data: bytes) -> bytes:
        """Packed ids of a stretch; words seen of late stay in the table, half of it goes at a time."""
        ids = self.word_ids.get(data)
        if ids is None:
            ids = self.older_ids.get(data)
            if ids is None:
                ids = array("i", self.encode(data.decode())).tobytes()
            if len(data) <= 64:
                if len(self.word_ids) >= CACHE_WORDS // 2:
                    self.older_ids, self.word_ids = self.word_ids, {}
                self.word_ids[data] = ids
        return ids

    def written(self, ids: bytes) -> str:
        """Packed ids in decimal, joined by commas."""
        return ",".join([self.names[i] for i in memoryview(ids).cast("i")])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        return self.flat[ragged(self.starts[ids], self.lengths[ids])]


def stretches(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that can be encoded one by one, and together give the text.

    A white-space run always begins a new piece, and pieces look no further than the character
    after such a run.  So cuts are safe before ASCII white space that follows a character which is surely
    no white space: printable ASCII or one of U+00C0 to U+00FF.
    """
    d = t.data
    n = len(d)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = (d == 32) | ((d >= 9) & (d <= 13))
    solid = (d > 32) & (d < 127)
    solid[1:] |= (d[1:] >= 128) & (d[:-1] == 0xC3)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = space[1:] & solid[:-1]
    cut[t.offsets] = True
    cuts = np.flatnonzero(cut)
    return cuts[:-1], cuts[1:]


_LOADED: dict[str, Bpe] = {}


def loaded(content: bytes) -> Bpe:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(content)
    return _LOADED[key]


class Encoded:
    """Encodings of some documents: distinct stretches once, documents as lists of their numbers."""

    def __init__(self, bpe: Bpe, t: Texts):
        starts, ends = stretches(t)
        self.first = np.searchsorted(starts, t.offsets)
        coded = word_array(t.data, starts, ends).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.ids = [bpe.word(w) for w in coded.dictionary.to_pylist()]
        self.sizes = np.array([len(x) // 4 for x in self.ids], np.int64)

    def n_tokens(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.sizes[self.codes])]) if len(self.codes) else np.zeros(1, np.int64)
        return np.diff(sums[self.first])

    def documents(self):
        for a, b in zip(self.first, self.first[1:]):
            yield self.codes[a:b].tolist()

    def flat_ids(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.ids), np.int32)


def encode_documents(docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id, ids: the encoding of every text as a list of ids; null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        bpe = loaded(sent.value)
        for t in texts(batches):
            e = Encoded(bpe, t)
            lists = [np.frombuffer(b"".join([e.ids[c] for c in own]), np.int32) for own in e.documents()]
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, content: bytes, keep_ids: bool = False) -> DataFrame:
    """doc_id, text (and the ids) of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        bpe = loaded(sent.value)
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                own = np.asarray(ids.values) if ids.is_valid else np.zeros(0, np.int32)
                out.append(bpe.decode(own.astype(np.int64)).tobytes().decode(errors="replace"))
            cols = {"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())} | ({"ids": batch.column("ids")} if keep_ids else {})
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string" + (", ids array<int>" if keep_ids else ""))


def encode_and_decode(docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id, ids of every text, and the SHA-256 of the text that the ids decode to; null texts are empty.

    One worker does both, so the vocabulary is held once a task and decoded texts stay where they are made.
    """
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        bpe = loaded(sent.value)
        for t in texts(batches, limit=2 << 20):
            e = Encoded(bpe, t)
            lists, shas = [], []
            for own in e.documents():
                ids = np.frombuffer(b"".join([e.ids[c] for c in own]), np.int32)
                back = bpe.decode(ids.astype(np.int64)).tobytes().decode(errors="replace")
                lists.append(ids)
                shas.append(hashlib.sha256(back.encode()).hexdigest())
            columns = [t.rows.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded_sha256 string")


def encoding_digests(docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        bpe = loaded(sent.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for t in texts(batches, limit=2 << 20):
            e = Encoded(bpe, t)
            written = [bpe.written(x) for x in e.ids]
            flat = e.flat_ids().astype(np.int64)
            data, ends = bpe.decode(flat).tobytes(), np.cumsum(bpe.lengths[flat])
            last = np.cumsum(e.sizes)
            upto = [0, *(int(ends[i - 1]) if i else 0 for i in last.tolist())]
            decoded = [data[a:b] for a, b in zip(upto, upto[1:])]
            ids_sha, text_sha = [], []
            for own in e.documents():
                ids_sha.append(sha(",".join([written[c] for c in own]).encode()))
                back = b"".join([decoded[c] for c in own])
                text_sha.append(sha(back.decode(errors="replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [t.rows.column("doc_id"), pa.array(e.n_tokens()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
