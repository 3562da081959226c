"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

Texts are equal when they are identical after deleting the characters of
``[\\x20\\x09-\\x0D]``; their digest is the SHA-256 of that form in UTF-8. The index is a
table on disk, CLUSTERED BY and SORTED BY the digest. New data is first reduced to one
row per digest (partial aggregation before the shuffle), then a sort-merge anti-join
against the index leaves the unknown digests, which are appended. The index side of that
join needs no shuffle.

Defined cases: a null text is an empty text, and all empty texts are equal. Ties on the
length go to the smallest doc_id (of any type that sorts); a null doc_id loses to any other. Rows that repeat a
doc_id and its text are one document: each row is returned, with the same decision. An
empty table gives no rows. Other columns of the input are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, written
from .frames import first_of, keep_rows, numbered, slim, text_of

_SPACES = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(text, _SPACES, ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, n_chars, digest) and ``more`` per row, written once: the text is hashed one time."""
    more = more or {}
    d = slim(docs, id_col, text_col, *[c.alias(k) for k, c in more.items()])
    return written(d.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                            text_digest(F.col("text")).alias("digest"), *more), "digests")


class DigestIndex:
    """One row per known text: digest, keep_id (the document that stays), group_size.

    ``path`` is a folder of the shared store; opening an existing one registers it again,
    so the index outlives the session.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}, group_size BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def append(self, rows: DataFrame) -> DataFrame:
        """Add the texts of ``rows`` (from ``digests``) that the index does not know.

        Returns (digest, keep_id, group_size) for every digest of ``rows``: a known text
        keeps the document that the index holds, a new one its longest original text,
        then its smallest doc_id. group_size counts the rows of this batch plus the size
        at which the index first met the text.
        """
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
        batch = rows.groupBy("digest").agg(best["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        batch = written(batch, "batch")
        known = written(self.spark.table(self.name).hint("merge").join(batch.select("digest"), "digest", "left_semi"), "known")
        fresh = batch.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        old = known.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
        return batch.join(old, "digest", "left").select(
            "digest", F.when(F.col("old_size").isNull(), F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"),
            (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                 text_col: str = "text", buckets: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, then ``more``.

    Without ``index`` a new one is laid down in the shared folder, with as many buckets as
    the digests have partitions if not told (64 at least).
    """
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col, more)
    if index is None:
        path = shared_path(spark, "digest-index")
        buckets = buckets or max(64, rows.rdd.getNumPartitions())
        index = DigestIndex(spark, path, "digest_index_" + path.rsplit("-", 1)[1], buckets, rows.schema["doc_id"].dataType.simpleString())
    groups = written(index.append(rows), "groups")  # plain files: a hot digest's rows can be split
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *(more or {}))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per text (the longest original, then the smallest
    doc_id, null last), all columns."""
    rows, row = numbered(docs)
    place = F.struct((-F.length(text_of(text_col))).alias("n"), first_of(rows, id_col, row).alias("first"))
    groups = exact_groups(rows, id_col=id_col, text_col=text_col, more={"place": place}).where("kept")
    kept = groups.groupBy("text_sha256").agg(F.min("place").alias("best"))
    return keep_rows(rows, row, kept.select(F.col("best.first.row").alias("kept_row")))
