"""Row identity and repeatable randomness that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.functions.columns import quoted

COPIES_PER_CHUNK = 100_000


def keyed_hash(*parts) -> Column:
    """md5 over the parts joined by a colon; the draw behind every split and pick."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def unit_interval(md5_hex: Column) -> Column:
    """The first 52 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(md5_hex, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def repeat_rows(df: DataFrame, times: str, position: str, chunk: int = COPIES_PER_CHUNK) -> DataFrame:
    """Each row ``times`` times, numbered 0.. in ``position``; rows with 0 vanish.

    A row that is to be repeated very often is cut into chunks first, and the
    chunks are spread over the cluster, so that no task writes one row's copies
    alone.
    """
    n = F.col(quoted(times)).cast("bigint")
    chunked = df.where(n > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(chunk)).cast("bigint")))
    )
    spread = chunked.repartition(*[F.col(quoted(c)) for c in chunked.columns if _is_hashable(chunked, c)])
    first = F.col("__chunk") * F.lit(chunk)
    last = F.least(first + F.lit(chunk), n) - F.lit(1)
    return spread.withColumn(position, F.explode(F.sequence(first, last))).drop("__chunk")


def _is_hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def with_row_id(df: DataFrame, name: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """Add an identity derived from the row's content.

    With ``columns`` (a key of the table) it is the md5 of those columns. Without,
    it is the md5 of the whole row plus the row's number among its exact copies:
    copies are first counted (so a row that makes up a third of the table is
    combined map-side) and then written out again with their numbers.
    """
    if columns:
        return df.withColumn(name, F.md5(F.concat_ws("|", *[F.col(quoted(c)).cast("string") for c in columns])))
    everything = [F.col(quoted(c)) for c in df.columns]
    counted = df.groupBy(*everything).agg(F.count(F.lit(1)).alias("__copies"))
    numbered = repeat_rows(counted, "__copies", "__copy")
    content = F.md5(F.to_json(F.struct(*everything), {"ignoreNullFields": "false"}))
    return numbered.select(*everything, F.concat_ws("-", content, F.col("__copy").cast("string")).alias(name))
