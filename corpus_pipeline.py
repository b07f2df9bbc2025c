"""From raw documents to encoded training data: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise
from tidepanel.llm import bpe, exact_dedup, minhash, mixing, quality
from tidepanel.llm.queries import TARGETS, VOCABULARY, language_labels, table, tokenizer_file
from tidepanel.llm.storage import small_side


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest doc_id; rows with the same id and another text are judged apart.

    A row without doc_id goes if one with an id has its text.  Of rows equal in id and text the smallest stays.
    """
    marked = exact_dedup.exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.count("*").alias("n"))
    marked = marked.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), "n")
    marked = materialise(marked.filter("n > 1 or not stays"), "copies")
    gone, again = marked.filter("not stays").select("d", "s"), marked.filter("stays").select("d", "s")
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), exact_dedup.digest(F.col("text")).alias("sha"))
    rows = rows.join(small_side(gone), same, "left_anti")
    if again.limit(1).count():
        once = rows.join(small_side(again), same, "left_semi").groupBy("id", "sha").agg(F.min("row").alias("row"))
        rows = rows.join(small_side(again), same, "left_anti").select("row").union(once.select("row"))
    return rows.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, size=5, percent=80)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of languages asks for, each at least once."""
    return mixing.mixed(docs, language_labels(spark, sf_dir, docs), TARGETS, least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of every row, and the digest of the text that the ids decode to."""
    return bpe.encode_and_decode(docs, tokenizer_file(VOCABULARY))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_languages),
    ("BPE encoding and decoding", encode),
]

#: A trained classifier and fitted rates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
