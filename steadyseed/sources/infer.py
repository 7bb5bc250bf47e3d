"""Column types for tables that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.functions.columns import col

# Texts read as missing, number grammars, boolean spellings.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
TRUE_TEXT = ("True", "TRUE", "true")
FALSE_TEXT = ("False", "FALSE", "false")


def _as_bigint(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast("bigint"))


def _as_double(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("double"))


def _as_boolean(text: Column) -> Column:
    return F.when(text.isin(*TRUE_TEXT), F.lit(True)).when(text.isin(*FALSE_TEXT), F.lit(False))


# Narrowest first. A column takes the first type that reads all of its values.
CONVERSIONS = (("bigint", _as_bigint), ("double", _as_double), ("boolean", _as_boolean))


def blank_missing(df: DataFrame, na_tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Texts that stand for a missing value become NULL."""
    return df.select(*[F.when(~col(c).isin(*na_tokens), col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest type that reads every value.

    One aggregation counts, for all columns and types together, the values a
    type cannot read; the conversion itself is a projection. A column without
    any value becomes double.
    """
    if not df.columns:
        return df
    failures = [
        F.count_if(col(c).isNotNull() & convert(col(c)).isNull()).alias(f"f{i}_{name}")
        for i, c in enumerate(df.columns)
        for name, convert in CONVERSIONS
    ]
    present = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*failures, *present).first()
    converted = []
    for i, c in enumerate(df.columns):
        if row[f"n{i}"] == 0:
            converted.append(F.lit(None).cast("double").alias(c))
            continue
        fitting = [convert for name, convert in CONVERSIONS if row[f"f{i}_{name}"] == 0]
        converted.append((fitting[0](col(c)) if fitting else col(c)).alias(c))
    return df.select(*converted)
