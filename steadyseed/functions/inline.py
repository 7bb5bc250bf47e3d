"""Relations built from driver-side values, without a Python job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Above this many rows literals would make the plan itself slow to analyse.
LITERAL_ROWS = 100


def inline_rows(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """``rows`` as a relation; ``schema`` maps column names to types, in order.

    A few rows are literals of the plan, more are handed over as Arrow data.
    """
    record = ", ".join(f"`{n}`: {t}" for n, t in schema.items())
    if not rows:
        empty = F.from_json(F.lit("[]"), f"array<struct<{record}>>")
        return spark.range(1).select(F.inline(empty))
    if len(rows) > LITERAL_ROWS:
        columns = [pa.array(values) for values in zip(*rows, strict=True)]
        table = spark.createDataFrame(pa.table(columns, names=[str(i) for i in range(len(schema))]))
        return table.select(*[F.col(str(i)).cast(t).alias(n) for i, (n, t) in enumerate(schema.items())])
    structs = [
        F.struct(*[_literal(v, t).alias(n) for v, (n, t) in zip(row, schema.items(), strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _literal(value, type_name: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(type_name)
    return F.lit(value).cast(type_name)
