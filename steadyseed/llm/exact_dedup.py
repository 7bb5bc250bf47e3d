"""Exact deduplication against a persistent index of text digests."""

from __future__ import annotations

from dataclasses import dataclass
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyseed.llm.common import SPACE, col, mark_of, new_folder, saved, staying, text_of

BUCKETS = 64


def normalised(text: Column) -> Column:
    """The text with every run of white space turned into one space."""
    return F.regexp_replace(text, SPACE, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass
class DigestIndex:
    """A table (digest, keep_id) of all texts seen so far, bucketed and sorted by digest.

    It lives as files under ``path`` in a shared folder and outlasts the session:
    a later session opens it again with the same ``path`` and ``buckets``. Size
    ``buckets`` for the final corpus when the index is made; one bucket of an
    anti-join is one task, which sorts and spills.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def __post_init__(self):
        self.table = f"digest_index_{uuid.uuid4().hex}"
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """Add digests that the index does not have yet, one file per bucket."""
        (
            new.select("digest", "keep_id").repartition(self.buckets, "digest").write.mode("append")
            .format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def close(self) -> None:
        """Forget the session's name for the index; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, mark) per row, written once."""
    return saved(docs.select(
        col(id_col).cast("bigint").alias("doc_id"), digest_of(text_of(text_col)).alias("digest"), mark_of(text_of(text_col)).alias("mark")
    ), "digests")


def add_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index and itself, then append what is new to the index.

    Returns (doc_id, mark, digest, keep_id, group_size, kept) per input row. ``keep_id``
    is the index's document for a text seen in an earlier batch, else the batch's
    smallest doc_id with that text; ``group_size`` counts the batch's rows of that
    text; ``kept`` says that the row itself stays.

    Nulls: a null text is an empty text. A null doc_id comes after all others; a
    text that only such rows have has a null ``keep_id`` and keeps them. Rows that
    repeat both doc_id and text are one document and share its ``kept``. An empty
    table gives an empty result. Other columns are not read.

    Only (doc_id, 32 bytes) per row are shuffled; a text's rows are combined
    map-side, and the index side of the anti-join is read by bucket, in order.
    """
    return _add(digests(docs, id_col, text_col), index)


def _add(batch: DataFrame, index: DigestIndex) -> DataFrame:
    groups = batch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    groups = saved(groups.repartition(index.buckets, "digest"), "groups")
    before = index.rows().withColumnRenamed("keep_id", "seen_id")
    new = groups.select("digest", F.col("first_id").alias("keep_id")).join(before.hint("merge"), "digest", "left_anti")
    old = groups.select("digest").join(before.hint("merge"), "digest").withColumn("old", F.lit(True))
    groups = groups.join(saved(old, "seen-before"), "digest", "left")
    index.append(saved(new, "new-digests"))
    return batch.join(groups, "digest").select(
        "doc_id", "mark", "digest",
        F.when(F.col("old"), F.col("seen_id")).otherwise(F.col("first_id")).alias("keep_id"),
        "group_size",
        (F.col("old").isNull() & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"),
    )


BATCHES = 3


def add_batches(docs: DataFrame, index: DigestIndex, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``add_batch`` for ranges of ascending doc_ids, one after the other, as a growing corpus would be added.

    Later ranges meet the index that earlier ones left, so the smallest doc_id of a
    text stays; null doc_ids are in the last range. ``group_size`` counts the rows
    of all ranges. Other edge cases as in ``add_batch``.
    """
    all_rows = digests(docs, id_col, text_col)
    low, high = all_rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    edges = sorted({low + (high - low) * i // batches for i in range(1, batches)}) if low is not None else []
    reports = None
    for start, end in zip([None, *edges], [*edges, None], strict=True):
        own = F.lit(True) if start is None else F.col("doc_id") > start
        own = own & (F.col("doc_id") <= end) if end is not None else own | F.col("doc_id").isNull()
        report = saved(_add(all_rows.where(own), index), "range-report")
        reports = report if reports is None else reports.unionByName(report)
    # written, so that the join deals both sides out anew and Spark can split the rows of a large group
    sizes = saved(reports.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "group-sizes")
    return reports.drop("group_size").join(sizes, "digest").select("doc_id", "mark", "digest", "keep_id", "group_size", "kept")


def deduplicate(docs: DataFrame, index: DigestIndex, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one row per text that the index lacked.

    Of rows that repeat both text and doc_id any one stays. Edge cases as in ``add_batches``.
    """
    report = saved(add_batches(docs, index, batches, id_col, text_col).withColumnRenamed("digest", "group"), "dedup-report")
    return staying(docs, report, id_col, text_col)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in a folder of its own below the shared checkpoint folder."""
    return DigestIndex(spark, new_folder(spark, "digest-index"))
