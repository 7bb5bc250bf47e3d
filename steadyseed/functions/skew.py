"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadyseed.functions.columns import quoted

HOT_KEYS_AT_MOST = 1000
HOT_ROWS = 100_000
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], at_least: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than 1/1000 of all rows.

    By counting there are fewer than 1000 of them, which is what makes the
    result safe to broadcast. Tables below ``at_least`` rows per key have none.
    """
    counts = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    threshold = F.greatest(F.lit(at_least), counts.agg(F.sum("__n") / F.lit(HOT_KEYS_AT_MOST)).scalar())
    return counts.where(F.col("__n") > threshold).drop("__n")


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: str,
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_at_least: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` with unique keys that is too large to broadcast.

    Rows of hot keys are spread over ``SALTS`` groups by ``spread_by``; only the
    lookup rows of those keys are repeated. ``hot`` gives the hot keys where they
    are known already; there are fewer than 1000. Keys must not be NULL on either
    side.
    """
    found = hot if hot is not None else hot_keys(rows, keys, hot_at_least)
    hot = F.broadcast(found.withColumn("__hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(F.col(quoted(spread_by))), F.lit(SALTS)).cast("int")
    salted = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")
    every_salt = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = (
        lookup.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), every_salt).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return salted.join(spread, keys + ["__salt"], how).drop("__salt")
