"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest.  New rows are first reduced to one per digest,
then compared with the index by a sort-merge anti-join that leaves the index where it lies (only
the new digests are shuffled), and the digests that are new are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise, new_path
from tidepanel.llm.text import lower_ascii

SCHEMA = "text_sha256 string, keep_id long, group_size long, batch string"
#: A digest is hot if it has more than this share of a batch's rows; so there are fewer than its inverse.
HOT_SHARE = 1 / 512


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return F.sha2(lower_ascii(text).cast("binary"), 256)


class DigestIndex:
    """Digests of all rows seen, in ``buckets`` buckets sorted by digest, kept under ``path``.

    Opening the same path again goes on from what is stored there.  ``buckets`` is a property of
    the stored table: pass the number it was created with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digests")
        self.table = f"digests_{uuid.uuid4().hex}"
        columns = ", ".join(SCHEMA.split(", "))
        spark.sql(
            f"create table {self.table} ({columns}) using parquet options (path '{self.path}') "
            f"clustered by (text_sha256) sorted by (text_sha256) into {buckets} buckets"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, digests: DataFrame, batch: str) -> DataFrame:
        """Append the digests of (id, text_sha256) rows that the index does not have; returns the batch's groups.

        The row with the largest id stands for its digest.  A batch that was appended before
        is compared with the other batches only and not appended twice, so that a run that broke
        off can be repeated.
        """
        index = self.read()
        groups = digests.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        # as a table: else the anti-join moves below the grouping, and every row is shuffled
        groups = materialise(groups, "groups")
        if index.filter(F.col("batch") == batch).limit(1).count():
            return groups
        known = index.select("text_sha256")
        fresh = groups.join(known.hint("merge"), "text_sha256", "left_anti")
        (
            fresh.withColumn("batch", F.lit(batch))
            .repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
            .saveAsTable(self.table, path=self.path)
        )
        return groups

    def dedup(self, docs: DataFrame, batch: str, id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per document with the document that stays.

        Columns: ``id``, keep_id, group_size, kept, text_sha256.  Of equal texts of one batch the
        row with the largest id stays; a text that an earlier batch brought is never kept and names
        that batch's row.  group_size counts the rows of the batch that brought the digest.  Rows with a null
        id take part: a group of them alone has keep_id null and none is kept.
        """
        digests = docs.select(F.col(id).cast("long").alias("id"), digest(F.col(text)).alias("text_sha256"))
        digests = materialise(digests, "digests")
        self.add(digests, batch)
        return attach(digests, self.read(), batch).withColumnRenamed("id", id)


def attach(digests: DataFrame, index: DataFrame, batch: str | None = None) -> DataFrame:
    """Join every row with its index entry.  Hot digests, of which there is a bounded number, are broadcast.

    With ``batch`` the rows are that batch's, and texts of earlier ones are not kept; else they are those of all batches.
    """
    own = F.lit(True) if batch is None else F.col("batch") == batch
    total = index.filter(own).agg(F.sum("group_size")).first()[0] or 0
    facts = ["text_sha256", "keep_id", "group_size", "batch"]
    hot = index.filter(own & (F.col("group_size") > total * HOT_SHARE)).select(facts)
    rest = index.filter(~own | (F.col("group_size") <= total * HOT_SHARE)).select(facts)
    out = digests.join(F.broadcast(hot), "text_sha256").unionByName(
        digests.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(rest.hint("merge"), "text_sha256")
    )
    kept = F.coalesce(own & (F.col("id") == F.col("keep_id")), F.lit(False))
    return out.select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


#: Batches in which ``exact_dedup`` deals the documents to its index.
BATCHES = 4


def falling(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in batches of about equal size, largest ids first; rows with one id share a batch, null ids come last."""
    cuts = digests.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    bounds = sorted(set(cuts or []), reverse=True)
    uppers = [None, *bounds]
    parts = [digests if u is None else digests.filter(F.col("id") < u) for u in uppers]
    parts = [p.filter(F.col("id") >= b) for p, b in zip(parts, bounds)]
    rest = F.col("id").isNull() | (F.col("id") < bounds[-1]) if bounds else F.lit(True)
    return [*parts, digests.filter(rest)]


def exact_dedup(docs: DataFrame, buckets: int | None = None, batches: int = BATCHES) -> DataFrame:
    """All of ``docs``, dealt to a new index in batches of falling ids, so that the stored row of a text has the largest id.

    Every batch after the first meets a filled index; group sizes are added up over the batches.  Columns and the
    treatment of nulls are those of ``DigestIndex.dedup``.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = docs.select(F.col("doc_id").cast("long").alias("id"), digest(F.col("text")).alias("text_sha256"))
    digests = materialise(digests, "digests")
    index = DigestIndex(spark, buckets=buckets)
    groups = [index.add(part, f"batch{i}").select("text_sha256", "group_size") for i, part in enumerate(falling(digests, batches))]
    sizes = groups[0]
    for g in groups[1:]:
        sizes = sizes.unionByName(g)
    sizes = sizes.groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"))
    entries = index.read().drop("group_size").join(sizes.hint("merge"), "text_sha256")
    return attach(digests, materialise(entries, "entries")).withColumnRenamed("id", "doc_id")
