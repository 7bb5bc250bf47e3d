"""What the corpus operators share: reading, names that cannot clash, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyseed.config import ensure_checkpoint_dir

# The white space that separates words in all contracts, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: a cut lineage that survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark_of(text: Column) -> Column:
    """64 bits of the text, to tell rows of one doc_id apart."""
    return F.xxhash64(text)


def staying(docs: DataFrame, report: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``report`` keeps, one per group, with the columns of ``docs``.

    ``report`` has (doc_id, mark, group, kept) per row. Of a group's kept rows that
    repeat doc_id and text any one stays. The texts are shuffled once, by doc_id.
    """
    id_name, mark, rows, group = unused(docs, "__id", "__mark", "__rows", "__group")
    keepers = report.where("kept").groupBy("group", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "rows")).alias("first")
    )
    keepers = saved(keepers.select(
        F.col("group").alias(group), F.col("first.doc_id").alias(id_name), F.col("first.mark").alias(mark), F.col("first.rows").alias(rows)
    ), "keepers")
    keyed = docs.withColumns({id_name: col(id_col).cast("bigint"), mark: mark_of(text_of(text_col))})
    found = keyed.alias("d").join(
        keepers.alias("k"),
        F.col(f"d.{id_name}").eqNullSafe(F.col(f"k.{id_name}")) & (F.col(f"d.{mark}") == F.col(f"k.{mark}")),
    ).select("d.*", F.col(f"k.{rows}"), F.col(f"k.{group}"))
    if not keepers.where(F.col(rows) > 1).isEmpty():
        found = found.where(F.col(rows) == 1).unionByName(found.where(F.col(rows) > 1).dropDuplicates([group]))
    return found.drop(id_name, mark, rows, group)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, held: Column, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out part.

    Those with the smallest hashes of doc_id are taken, so the choice depends on
    the labels alone; a doc_id with several labels counts as 1 if any is. ``rows``
    bounds what is broadcast and, as each doc_id gives one row, what a fit gathers.
    """
    known = labels.where(~held & col(id_col).isNotNull() & col(label).isNotNull())
    known = known.groupBy(col(id_col).cast("bigint").alias("doc_id")).agg(F.max(col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


ROWS_AT_ONCE = 250


def by_slices(values: Column, returns, work: Callable[[], Callable[[pa.Array], pa.Array]]) -> Column:
    """An Arrow function over a column, a few rows at a time.

    ``work`` is called once per task and gives the function for the slices. Only a
    slice's texts are Python objects at any time, and results leave slice by slice,
    so a worker's memory hangs on the longest texts and not on the batch.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        handle = work()
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                yield handle(batch.slice(at, ROWS_AT_ONCE))

    return F.arrow_udf(run, returns)(values)
