"""Schema inspection and quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col(quoted(name))


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "categorical"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def is_missing(name: str, data_type: T.DataType) -> Column:
    """NULL, or NaN in a floating column."""
    missing = col(name).isNull()
    return missing | F.isnan(col(name)) if is_floating(data_type) else missing


def value_text(name: str, data_type: T.DataType) -> Column:
    """The column as text, with missing values as NULL and one spelling of zero."""
    if is_floating(data_type):
        return F.nanvl(col(name) + F.lit(0.0).cast(data_type), F.lit(None).cast(data_type)).cast("string")
    if isinstance(data_type, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(col(name))
    return col(name).cast("string")
