"""Tables derived from the driver tables, as DataFrames and as SQL.

Each derivation keeps every row of the tables it starts from, except those about
labelled documents, which leave out documents without a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyseed.functions.hashing import with_row_id
from steadyseed.sources import load_table

NET = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
LINE_ID_SQL = (
    "md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS INTEGER))"
)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet", spread=spread)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with ``row_id``."""
    rows = table(spark, sf_dir, "lineitem", spread=True).withColumn("__quantity", F.col("l_quantity").cast("int"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "__quantity"]
    return with_row_id(rows, "row_id", key).drop("__quantity")


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnable two-class problem: is the net price above 40000?"""
    return lines(spark, sf_dir).select(
        "row_id", "l_extendedprice", "l_discount", "l_tax", F.expr(f"CAST({NET} > 40000 AS INT)").alias("label")
    )


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnable regression: the net price."""
    return lines(spark, sf_dir).select(
        "row_id", "l_extendedprice", "l_discount", "l_tax", F.expr(NET).alias("label")
    )


BANDS = ["price_band", "l_discount", "l_tax"]
BANDS_SQL = (
    f"SELECT {LINE_ID_SQL} AS row_id, floor(l_extendedprice / 5000) AS price_band, l_discount, l_tax, {NET} AS net, CAST({NET} > 40000 AS INTEGER) AS label FROM lineitem"
)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with features of few values, so that each of them can be a threshold; net price and its class."""
    return lines(spark, sf_dir).select(
        "row_id", F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("price_band"), "l_discount", "l_tax",
        F.expr(NET).alias("net"), F.expr(f"CAST({NET} > 40000 AS INT)").alias("label"),
    )


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise: was the line returned? Nothing in the features tells."""
    return lines(spark, sf_dir).select(
        "row_id", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalanced two-class problem: labelled documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


TOXIC_SQL = "SELECT doc_id, lang, source, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)"


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` where a zero discount or tax is taken as not recorded."""
    return lines(spark, sf_dir).select(
        "row_id", "l_quantity", "l_extendedprice",
        F.expr("nullif(l_discount, 0D)").alias("discount"), F.expr("nullif(l_tax, 0D)").alias("tax"),
    )


GAPS_SQL = (
    f"SELECT {LINE_ID_SQL} AS row_id, l_quantity, l_extendedprice, "
    "nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem"
)


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` described in words: one column for each rule on value sets."""
    return table(spark, sf_dir, "lineitem", spread=True).select(
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE ' no' END").alias("came_back"),
        F.expr("CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 35 THEN 'Medium' ELSE 'HIGH' END").alias("level"),
        F.expr("CASE WHEN l_extendedprice < 30000 THEN 'S' WHEN l_extendedprice < 60000 THEN 'M' ELSE 'XL' END").alias("box"),
        F.expr("CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'B' ELSE 'F' END").alias("grade"),
        F.expr("CAST(l_linenumber AS STRING) || '.5'").alias("number_text"),
        F.date_format("l_shipdate", "MMMM").alias("ship_month"),
        F.date_format("l_shipdate", "E").alias("ship_day"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'done' END").alias("state"),
        F.expr("l_returnflag || '-' || l_linestatus").alias("flags"),
        F.expr("'tax ' || CAST(CAST(round(l_tax * 100) AS INT) AS STRING)").alias("tax_band"),
        F.expr("'line of ' || CAST(l_orderkey AS STRING)").alias("free_text"),
        F.expr("CAST(nullif(l_linenumber, l_linenumber) AS STRING)").alias("empty"),
        "l_linenumber", "l_orderkey",
    )


SCALES_SQL = f"""SELECT l_orderkey,
    CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE ' no' END AS came_back,
    CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 35 THEN 'Medium' ELSE 'HIGH' END AS level,
    CASE WHEN l_extendedprice < 30000 THEN 'S' WHEN l_extendedprice < 60000 THEN 'M' ELSE 'XL' END AS box,
    CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'B' ELSE 'F' END AS grade,
    CAST(l_linenumber AS VARCHAR) || '.5' AS number_text,
    strftime(l_shipdate, '%B') AS ship_month,
    strftime(l_shipdate, '%a') AS ship_day,
    CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'done' END AS state,
    l_returnflag || '-' || l_linestatus AS flags,
    'tax ' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS tax_band,
    'line of ' || CAST(l_orderkey AS VARCHAR) AS free_text
    FROM lineitem"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with one column per dimension of the longest one, ``e0`` and so on."""
    rows = table(spark, sf_dir, "embeddings")
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    return rows.select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)]
    )
