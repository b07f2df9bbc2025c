"""Mixing to target weights with soft membership.

A document belongs to every domain with some probability.  A classifier learnt on labelled rows gives
these posteriors; non-negative rates per document are then fitted so that the expected tokens
of each domain meet the targets.  Everything runs in DataFrame expressions; the driver holds only numbers by
domain and by word of the classifier's vocabulary.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise

#: Bounds of the classifier: labelled documents it learns from (smallest hash of the id), words it looks at.
FIT_ROWS, WORDS = 4_000, 128
#: Rounds at most; share of all tokens off target, and squared projected gradient per token, at which fitting ends.
ROUNDS, TOLERANCE, FLAT = 50, 1e-3, 1e-12


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


@dataclass(frozen=True)
class Domains:
    """Naive Bayes on which of the chosen words a document has."""

    names: list[str]
    words: list[str]
    base: list[float]  # by domain: log prior and all words absent
    present: list[list[float]]  # by word and domain: change if the word is there

    def logits(self, words: Column) -> Column:
        """array<double>: unnormalised log probability of each domain, in the order of ``names``."""
        base = F.array(*[F.lit(float(b)) for b in self.base])
        if not self.words:
            return base
        vocabulary = F.array(*[F.lit(w) for w in self.words])
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.present])
        add = lambda acc, w: F.zip_with(acc, F.element_at(table, F.array_position(vocabulary, w).cast("int")), lambda x, y: x + y)
        return F.aggregate(F.array_intersect(words, vocabulary), base, add)


def learn_domains(docs: DataFrame, labelled: DataFrame, names: list[str], fit_rows: int = FIT_ROWS, n_words: int = WORDS) -> Domains:
    """Learn from ``labelled`` (doc_id, domain), at most ``fit_rows`` of them.

    Rows with a null id or a domain that is not in ``names`` are left out; without any, all domains are equally likely.
    """
    some = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", F.array_distinct(words_of(F.col("text"))).alias("words"))
    known = materialise(known, "labelled")
    size = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [size.get(d, 0) for d in names]
    counts = known.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(names)])
    shares = [F.col(f"n{i}") / max(1, n[i]) for i in range(len(names))]
    spread = (F.greatest(*shares) - F.least(*shares)) if len(names) > 1 else shares[0]
    chosen = counts.orderBy(F.desc(spread), "word").limit(n_words).collect()
    share = [[(r[f"n{i}"] + 0.5) / (n[i] + 1) for i in range(len(names))] for r in chosen]
    prior = [(k + 1) / (sum(n) + len(names)) for k in n]
    base = [math.log(prior[i]) + sum(math.log(1 - s[i]) for s in share) for i in range(len(names))]
    return Domains(list(names), [r["word"] for r in chosen], base, [[math.log(x / (1 - x)) for x in s] for s in share])


def with_posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """``docs`` with ``_n`` (words of the text) and ``_p`` (posteriors)."""
    # step by step: an expression that is used twice in one step would be computed twice
    rows = docs.withColumn("_words", words_of(F.col("text")))
    rows = rows.withColumns({"_n": F.size("_words").cast("double"), "_z": model.logits(F.col("_words"))}).drop("_words")
    rows = rows.withColumn("_top", F.array_max("_z")).withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))
    return rows.withColumn("_p", F.transform("_e", lambda x: x / F.col("_sum"))).drop("_z", "_top", "_e", "_sum")


def rate(steps: list[list[float]], least: float) -> Column:
    """Rate of a document after the given steps of projected gradient descent, from 1 on."""
    r = F.lit(1.0)
    if not steps:
        return F.greatest(r, F.lit(least))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(s, F.col("_p"), lambda x, y: x * y), F.lit(0.0), lambda a, y: a + y)
    return F.aggregate(table, r, lambda acc, s: F.greatest(F.lit(float(least)), acc - dot(s)))


def domain_tokens(rows: DataFrame, weight: Column, k: int) -> list[float]:
    got = rows.agg(*[F.sum(weight * F.col("_n") * F.col("_p")[i]).alias(f"t{i}") for i in range(k)]).first()
    return [float(x or 0.0) for x in got]


def curvature(rows: DataFrame, weight: Column, down: list[float], least: float, k: int) -> tuple[np.ndarray, float]:
    """Over the documents whose rate can go down the gradient: tokens by pair of domains, and the squared gradient."""
    own = rows.withColumn("_r", weight)
    own = own.withColumn("_g", sum((F.col("_p")[i] * F.lit(float(x)) for i, x in enumerate(down)), F.lit(0.0)))
    free = own.filter((F.col("_r") > F.lit(float(least))) | (F.col("_g") < 0))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = free.agg(F.sum(F.col("_n") * F.col("_g") * F.col("_g")), *[F.sum(F.col("_n") * F.col("_p")[i] * F.col("_p")[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
    h = np.zeros((k, k))
    for (i, j), x in zip(pairs, got[1:]):
        h[i, j] = h[j, i] = x or 0.0
    return h, float(got[0] or 0.0)


def fit_rates(rows: DataFrame, weights: list[float], total: float | None = None, least: float = 0.0) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps that lead to the rates, the targets in tokens, and the tokens reached.

    Minimises the sum over domains of (expected tokens - target)^2 / (tokens at rate 1) over rates
    >= ``least``.  A document's gradient is measured per token, so the rate depends on its posteriors and not on
    its length, and the step length 1 is safe: with soft members, the scaled system has no eigenvalue above 1.
    Steps scaled by the k x k system come first, as domains that are hard to tell apart have small eigenvalues.
    Where the bound or the round limit leaves targets missed by more than TOLERANCE, a warning gives the gap.
    ``total`` defaults to the smallest sum for which no domain needs fewer tokens than it has.
    A domain without tokens cannot be raised; the others are fitted.
    """
    k = len(weights)
    share = [w / sum(weights) for w in weights]
    have = domain_tokens(rows, F.lit(1.0), k)
    if total is None:
        total = max([h / s for h, s in zip(have, share) if s > 0], default=0.0)
    want = [s * total for s in share]
    steps: list[list[float]] = []
    got = have if least <= 1 else domain_tokens(rows, F.lit(float(least)), k)
    gap = lambda t: [g - w if h > 0 else 0.0 for g, w, h in zip(t, want, have)]
    loss = lambda t: sum(o * o / h for o, h in zip(gap(t), have) if h > 0)
    met = lambda t: sum(map(abs, gap(t))) <= TOLERANCE * max(total, 1.0)
    for _ in range(ROUNDS):
        if met(got):
            break
        off = gap(got)
        down = [o / h if h > 0 else 0.0 for o, h in zip(off, have)]
        system, slope = curvature(rows, rate(steps, least), down, least, k)
        if slope <= FLAT * max(total, 1.0):
            break  # the bound holds it back
        scaled = np.linalg.lstsq(system, np.array(off), rcond=1e-9)[0]
        for step, enough in ((scaled, 0.9), (scaled / 4, 0.9), (np.array(down), 1.0)):
            now = domain_tokens(rows, rate([*steps, step.tolist()], least), k)
            if loss(now) < enough * loss(got):
                break
        else:
            break  # no step goes further down in double precision
        steps.append(step.tolist())
        got = now
    if not met(got):
        warnings.warn(f"mixing targets missed by {sum(map(abs, gap(got))) / max(total, 1.0):.4f} of all tokens", stacklevel=2)
    return steps, want, got


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole number of copies whose expectation is the rate: rounded up or down by the hash of the id."""
    u = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, least: float = 0.0) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>..., rate, copies.

    Tokens are words between white space.  A null or empty text has none; its rate follows from the prior.
    """
    names = sorted(targets)
    model = learn_domains(docs, labelled, names)
    rows = materialise(with_posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text"), "posteriors")
    steps, _, _ = fit_rates(rows, [targets[d] for d in names], total, least)
    out = rows.withColumn("rate", rate(steps, least))
    return out.select(
        "doc_id", F.col("_n").cast("long").alias("n_tokens"), *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(names)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies")
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, all columns.

    With ``least`` = 1 every row stays at least once.
    """
    names = sorted(targets)
    model = learn_domains(docs, labelled, names)
    # the caller's columns travel as one struct, so that none can clash with those of the fit
    own = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_row"), "text")
    rows = materialise(with_posteriors(own, model).drop("text"), "posteriors")
    steps, _, _ = fit_rates(rows, [targets[d] for d in names], total, least)
    often = copies(rate(steps, least), F.col("_row")["doc_id"]).cast("int")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), often)).alias("_copy")).select("_row.*")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
