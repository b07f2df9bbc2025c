"""A Merkle manifest of a dataset: leaves, roots and proofs, checked by folding.

A node is the SHA-256 of its children's digests, joined as hex text.  While a task builds a node it keeps
a copy of the hash state before each child slot.  To check a leaf, the state before its slot is
resumed with the replacement and the siblings to its right only: what lies to the left is never hashed again.

Trees are built in chunks of fanout^LEVELS consecutive nodes, one group of rows each, whatever the size of a group; the
roots of the chunks are the nodes of the next round.  On the way back, every chunk's path to the root is
one row joined to its nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise

FANOUT, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


# ---------------------------------------------------------------------------------------------
# trees of digests, in memory


class Chunk:
    """The tree over some consecutive nodes, ``levels`` deep, with the hash states before each child slot."""

    def __init__(self, nodes: list[str], levels: int, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [nodes]
        self.states: list[list] = []
        for _ in range(levels):
            below, states, row = self.levels[-1], [], []
            for at in range(0, len(below), fanout):
                state = hashlib.sha256()
                for child in below[at : at + fanout]:
                    states.append(state.copy())
                    state.update(child.encode())
                row.append(state.hexdigest())
            self.states.append(states)
            self.levels.append(row)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """The digests left and right of node ``i`` and of its ancestors, each joined, from below."""
        out = []
        for row in self.levels[:-1]:
            at = i - i % self.fanout
            out.append(("".join(row[at:i]), "".join(row[i + 1 : at + self.fanout])))
            i //= self.fanout
        return out

    def fold(self, i: int, digest: str) -> str:
        """The root if node ``i`` were ``digest``."""
        for row, states in zip(self.levels, self.states):
            state = states[i].copy()
            state.update(digest.encode())
            at = i - i % self.fanout
            for right in row[i + 1 : at + self.fanout]:
                state.update(right.encode())
            digest = state.hexdigest()
            i //= self.fanout
        return digest


class Path:
    """What lies beside a chunk on its way to the root: a state after the left siblings, and the right ones."""

    def __init__(self, left: list[str], right: list[str]):
        self.siblings = list(zip(left, right))
        self.steps = [(hashlib.sha256(a.encode()), b.encode()) for a, b in self.siblings]

    def fold(self, digest: str) -> str:
        for state, right in self.steps:
            state = state.copy()
            state.update(digest.encode() + right)
            digest = state.hexdigest()
        return digest


# ---------------------------------------------------------------------------------------------
# rounds of chunks


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0) within ``group`` by ``order``, and ``size``, the number of rows of the group.

    Rows are dealt by range over group and order, so a large group is cut; only one count per group and
    part is accumulated.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    dealt = materialise(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    spans = dealt.groupBy(group, part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy(group)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(every).alias("size"))
    out = dealt.withColumn("_part", part).join(offsets, [group, "_part"])
    return out.withColumn("pos", F.col("_id") - F.col("_first") + F.col("_off")).drop("_id", "_part", "_first", "_off")


def depth(size: int, fanout: int) -> int:
    """Levels above ``size`` nodes until one remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fanout), levels + 1
    return levels


def chunk_key(width: int) -> Column:
    return F.floor(F.col("pos") / width).cast("long")


def roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A round upwards: (grp, pos, h, size) of chunks to the same of their roots."""
    width = fanout**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        tree = Chunk(table.column("h").to_pylist(), min(levels, depth(size, fanout)), fanout)
        row = {"grp": table.column("grp")[0].as_py(), "pos": table.column("pos")[0].as_py() // width, "h": tree.root, "size": -(-size // width)}
        return pa.Table.from_pylist([row], pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("h", pa.string()), ("size", pa.int64())]))

    nodes = nodes.select("grp", "pos", "h", "size", chunk_key(width).alias("chunk"))
    return nodes.groupBy("grp", "chunk").applyInArrow(run, "grp string, pos long, h string, size long")


PATHS = "grp string, pos long, top string, left array<string>, right array<string>"


def paths(nodes: DataFrame, above: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """A round downwards: the siblings of every node up to the top of its group.

    ``above`` has the paths of the chunks (grp, pos, top, left, right); None if a group is a single chunk.
    """
    width = fanout**levels
    nodes = nodes.select("grp", "pos", "h", "size", chunk_key(width).alias("chunk"))
    if above is not None:
        nodes = nodes.join(above.select("grp", F.col("pos").alias("chunk"), "top", "left", "right"), ["grp", "chunk"])
    else:
        none = F.array().cast("array<string>")
        nodes = nodes.withColumns({"top": F.lit(None).cast("string"), "left": none, "right": none})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = Chunk(table.column("h").to_pylist(), min(levels, depth(table.column("size")[0].as_py(), fanout)), fanout)
        rest = list(zip(table.column("left")[0].as_py(), table.column("right")[0].as_py()))
        top = table.column("top")[0].as_py() or tree.root
        ways = [tree.siblings(i) + rest for i in range(table.num_rows)]
        n = table.num_rows
        lists = [pa.array([[w[k] for w in way] for way in ways], pa.list_(pa.string())) for k in (0, 1)]
        return pa.Table.from_arrays([table.column("grp"), table.column("pos"), pa.array([top] * n, pa.string()), *lists], ["grp", "pos", "top", "left", "right"])

    return nodes.groupBy("grp", "chunk").applyInArrow(run, PATHS)


def climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of all rounds, written, until every group has one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(materialise(roots(rounds[-1], fanout, levels), "nodes"))
    return rounds


def descend(rounds: list[DataFrame], fanout: int, levels: int) -> DataFrame | None:
    """Paths of the nodes of round 1, that is of the chunks of round 0; None if no group has more than a node."""
    above = None
    for nodes in reversed(rounds[1:]):
        above = materialise(paths(nodes, above, fanout, levels), "paths")
    return above


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, leaves: Column | None = None, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root, verified.

    ``leaves`` is the digest of a row (by default of the five columns of documents); ``tampered`` the digest
    to check in its place, null or left out where the row is untouched.  Leaves of a lang ascend by doc_id, null first, rows that
    repeat an id by digest; langs ascend bytewise, null first.  Every ``fanout`` consecutive nodes, the last run may have fewer, become one until
    one remains.  The proof is all siblings from the leaf to the root, left to right, hashed; a lone leaf has none and
    proves by the hash of nothing.  An empty table gives no rows.  Columns beyond those hashed are not read.
    """
    rows = docs.select(
        # no lang sorts before every lang
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (leaf() if leaves is None else leaves).alias("h"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("changed"),
    )
    # row: deals equal rows out, in any order
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    base = materialise(numbered(rows, "grp", ["doc_id", "h", "row"]).drop("row"), "leaves")
    rounds = climb(base.select("grp", "pos", "h", "size"), fanout, levels)
    chunks = descend(rounds, fanout, levels)

    # a group's only node is its subroot; the subroots are the nodes of one more tree
    ends = [nodes.filter("size = 1").select("grp", "h") for nodes in rounds]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    subroots = subroots.groupBy("grp").agg(F.first("h").alias("h")).withColumn("all", F.lit(""))
    subroots = materialise(numbered(subroots, "all", ["grp"]), "subroots")
    tops = climb(subroots.select(F.col("all").alias("grp"), "pos", "h", "size"), fanout, levels)
    ways = paths(tops[0], descend(tops, fanout, levels), fanout, levels)
    ways = subroots.select("grp", "pos", F.col("h").alias("subroot")).join(ways.drop("grp"), "pos")
    ways = materialise(ways.select("grp", "subroot", F.col("top").alias("root"), F.col("left").alias("l2"), F.col("right").alias("r2")), "ways")

    width = fanout**levels
    none = F.array().cast("array<string>")
    facts = base.select("grp", chunk_key(width).alias("chunk")).distinct().join(ways, "grp")
    if chunks is not None:
        own = chunks.select("grp", F.col("pos").alias("chunk"), F.col("left").alias("l1"), F.col("right").alias("r1"))
        facts = facts.join(own, ["grp", "chunk"], "left")
    else:
        facts = facts.withColumns({"l1": none, "r1": none})
    facts = facts.select(
        "grp", "chunk", "subroot", "root", F.concat(F.coalesce("l1", none), "l2").alias("left"), F.concat(F.coalesce("r1", none), "r2").alias("right")
    )
    facts = materialise(facts, "facts")

    def prove(key, own: pa.Table, fact: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        size = own.column("size")[0].as_py()
        tree = Chunk(own.column("h").to_pylist(), min(levels, depth(size, fanout)), fanout)
        path = Path(fact.column("left")[0].as_py(), fact.column("right")[0].as_py())
        beyond = "".join(a + b for a, b in path.siblings)
        subroot, root = (fact.column(c)[0].as_py() for c in ("subroot", "root"))
        proofs, folded = [], []
        for i, (h, changed) in enumerate(zip(tree.levels[0], own.column("changed").to_pylist())):
            proofs.append(sha("".join(a + b for a, b in tree.siblings(i)) + beyond))
            folded.append(path.fold(tree.fold(i, changed or h)))
        n = own.num_rows
        columns = [own.column("doc_id"), own.column("h"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
        return pa.Table.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return base.withColumn("chunk", chunk_key(width)).groupBy("grp", "chunk").cogroup(facts.groupBy("grp", "chunk")).applyInArrow(prove, PROOFS)


def tamper_evidence(docs: DataFrame) -> DataFrame:
    """The manifest, with ``n_chars`` raised by 1 where 7 divides the crc32 of the decimal doc_id; rows without doc_id stay."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1))
    return manifest(docs, tampered=changed)
