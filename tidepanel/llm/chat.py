"""Preference formatting: two conversations with a common beginning as one prompt and two completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ranks import value_counts
from tidepanel.functions.tables import materialise

#: Marks around a turn.
OPEN, SEP, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns as an ordered array of (role, text).

    Turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own.
    A null role or text is empty.  Rows without conv_id are no conversation and are left out.
    """
    part = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    listed = F.sort_array(F.collect_list(part))
    bare = F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(bare.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    return F.when(n == 0, 0).when(F.array_contains(same, F.lit(False)), F.array_position(same, F.lit(False)) - 1).otherwise(n).cast("long")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SEP), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learnt(turns: Column, role: str) -> Column:
    """Character spans (start, end) of the rendering that are learnt: text and end mark of ``role``'s turns."""
    start = F.named_struct(F.lit("at"), F.lit(0).cast("long"), F.lit("spans"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))

    def step(state: Column, turn: Column) -> Column:
        head = F.length(turn["role"]).cast("long") + len(OPEN) + len(SEP)
        end = state["at"] + head + F.length(turn["text"]) + len(CLOSE)
        span = F.named_struct(F.lit("start"), state["at"] + head, F.lit("end"), end)
        more = F.when(turn["role"] == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.named_struct(F.lit("at"), end, F.lit("spans"), more)

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """A row per pair (chosen_id, rejected_id) whose conversations both exist.

    The longest common prefix of turns is rendered once as ``prompt``; what follows it in either
    conversation is rendered as ``chosen`` and ``rejected``, with the character spans on which a
    model is trained (``*_spans``: the turns of ``role``, without their heads).  Equal
    conversations give empty completions; without a common turn the prompt is empty.  Other
    columns of ``pairs`` are left out.
    """
    whole = conversations(turns)
    a = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.select("chosen_id", "rejected_id").join(a, "chosen_id").join(b, "rejected_id")
    return completions(both, role)


def completions(both: DataFrame, role: str = "assistant") -> DataFrame:
    """The formatting of rows (chosen_id, rejected_id, a, b), a and b being arrays of turns."""
    cut = both.withColumn("prefix_turns", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), (F.col("prefix_turns") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    cut = cut.select(
        "chosen_id", "rejected_id", "prefix_turns", F.slice("a", F.lit(1), F.col("prefix_turns").cast("int")).alias("p"),
        rest("a").alias("a"), rest("b").alias("b"),
    )
    return cut.select(
        "chosen_id", "rejected_id", "prefix_turns", render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"), learnt(F.col("a"), role).alias("chosen_spans"),
        render(F.col("b")).alias("rejected"), learnt(F.col("b"), role).alias("rejected_spans"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected, where both exist."""
    ids = turns.filter(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    key = F.expr("conv_id - pmod(conv_id, 2)")
    return ids.groupBy(key.alias("chosen_id")).agg(F.count("*").alias("n")).filter("n = 2").select("chosen_id", (F.col("chosen_id") + 1).alias("rejected_id"))


def replaced_answers(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Each conversation against itself with another answer, formatted; all share a beginning up to that turn.

    The last turn of ``role`` gets the text of the last such turn of the conversation with the next
    greater conv_id that has one (rejected_id; after the last comes the first).  Turns after it stay.
    Conversations without a turn of ``role`` are left out, and so is one that is the only one.
    """
    from_end = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), role)
    whole = conversations(turns).withColumn("at", (F.size("turns") - from_end).cast("int")).filter(from_end > 0)
    ranked = materialise(value_counts(whole.select("conv_id"), [], "conv_id").select("conv_id", "lo"), "ranks")
    n = ranked.count()
    after = ranked.select(F.col("conv_id").alias("rejected_id"), F.col("lo").alias("rank"))
    pairs = ranked.select(F.col("conv_id").alias("chosen_id"), F.expr(f"(lo + 1) % {max(n, 1)}").alias("rank")).join(after, "rank")
    own = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"), "at")
    other = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns")[F.col("at")]["text"].alias("answer"))
    both = pairs.filter("chosen_id <> rejected_id").join(own, "chosen_id").join(other, "rejected_id")
    swap = lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("answer").alias("text"))).otherwise(t)
    return completions(both.withColumn("b", F.transform("a", swap)), role)
