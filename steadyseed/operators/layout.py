"""A partition layout that depends on the data only.

Tree ensembles draw their samples per partition, so the same rows in another
layout give another model. Hashing rows into a number of partitions derived from
the row count, and ordering them inside, makes a fit repeatable on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

ROWS_PER_PARTITION = 75_000
MAX_PARTITIONS = 100_000


def partitions_for(rows: int) -> int:
    return min(MAX_PARTITIONS, max(1, math.ceil(rows / ROWS_PER_PARTITION)))


def fixed_layout(df: DataFrame, row_id: str, rows: int) -> DataFrame:
    return df.repartition(partitions_for(rows), F.col(row_id)).sortWithinPartitions(row_id)
