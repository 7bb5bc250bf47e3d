"""Column profiles: counts, missing values, distinct values, preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from steadyseed.functions.columns import col, column_kind, is_floating, is_missing, value_text
from steadyseed.functions.inline import inline_rows

MAX_VALUES = 20
# Texts longer than this are told apart by their md5, which keeps the shuffle
# of a distinct count as narrow as its number of distinct values allows.
LONG_TEXT = 64
# Registers of a sketch with a relative deviation of 0.05.
SKETCH_REGISTERS = 512


def _per_column(wide: DataFrame, df: DataFrame, **measures: dict[str, str]) -> DataFrame:
    """One aggregated row to one row per column of ``df``."""
    entries = []
    for position, field in enumerate(df.schema.fields):
        values = [F.col(names[field.name]).alias(alias) for alias, names in measures.items()]
        entries.append(F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(position).alias("position"),
            F.lit(column_kind(field.dataType)).alias("kind"),
            *values,
        ))
    return wide.select(F.inline(F.array(*entries)))


def row_and_column_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column_name, missing)``, one pass, NaN counted as missing."""
    names = {f.name: f"m{i}" for i, f in enumerate(df.schema.fields)}
    wide = df.agg(*[F.count_if(is_missing(f.name, f.dataType)).alias(names[f.name]) for f in df.schema.fields])
    return _per_column(wide, df, missing=names).select("column_name", "missing")


def total_missing(df: DataFrame) -> DataFrame:
    return missing_counts(df).agg(F.sum("missing").alias("total_missing"))


def preview(df: DataFrame, order_by: str | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (without one, by a hash of the row) as text, missing values empty."""
    texts = [F.coalesce(value_text(f.name, f.dataType), F.lit("")).alias(f.name) for f in df.schema.fields]
    key = col(order_by) if order_by else F.md5(F.to_json(F.struct(*[col(c) for c in df.columns])))
    return df.orderBy(key).limit(n).select(*texts)


def _native(field: T.StructField, shorten: bool) -> tuple[str, Column]:
    """A type that several columns can share, and the column in it with missing values as NULL."""
    kind, value = field.dataType, col(field.name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint", value.cast("bigint")
    if is_floating(kind):
        return "double", F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        text = value_text(field.name, kind)
        if shorten:
            text = F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)
        return "string", text
    return kind.simpleString(), value


def _cells(df: DataFrame, fields: list[T.StructField], order_by: str | None, shorten: bool) -> list[DataFrame]:
    """``([at,] position, value)`` of the non-missing values: one table per column type.

    Values keep their type, so nothing is turned into text row by row, and each
    table reads the columns of its type only.
    """
    by_type: dict[str, list[tuple[str, Column]]] = {}
    for i, field in enumerate(fields):
        kind, value = _native(field, shorten)
        by_type.setdefault(kind, []).append((str(i), value))
    at = [col(order_by).alias("__at")] if order_by else []
    names = ["__at"] if order_by else []
    return [
        df.select(*at, *[value.alias(i) for i, value in group])
        .unpivot(names, [i for i, _ in group], "position", "value")
        .where(F.col("value").isNotNull())
        for group in by_type.values()
    ]


def distinct_counts(df: DataFrame, approx: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, distinct, distinct_ratio)`` over non-missing values.

    Exact counting combines equal values map-side and shuffles each distinct
    value of a column once; ``approx`` keeps one sketch per column instead and
    shuffles nothing but those.
    """
    chosen = df.select(*[col(c) for c in columns]) if columns is not None else df
    fields = chosen.schema.fields
    rows = {f.name: "rows" for f in fields}
    if approx:
        names = {f.name: f"d{i}" for i, f in enumerate(fields)}
        wide = chosen.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.approx_count_distinct(_native(f, False)[1]).alias(names[f.name]) for f in fields],
        )
        counted = _per_column(wide, chosen, distinct=names, rows=rows)
    else:
        per_type = [
            cells.groupBy("position", "value").agg(F.lit(1).alias("one"))
            .groupBy("position").agg(F.count(F.lit(1)).alias("distinct"))
            for cells in _cells(chosen, fields, None, shorten=True)
        ]
        found = reduce(DataFrame.unionByName, per_type).select(F.col("position").cast("int").alias("position"), "distinct")
        every = _per_column(chosen.agg(F.count(F.lit(1)).alias("rows")), chosen, rows=rows)
        counted = every.join(F.broadcast(found), "position", "left")
    distinct = F.coalesce(F.col("distinct"), F.lit(0)).cast("bigint")
    ratio = F.when(F.col("rows") > 0, distinct / F.col("rows")).otherwise(F.lit(0.0))
    return counted.select("column_name", distinct.alias("distinct"), ratio.alias("distinct_ratio"))


def _value_lists(df: DataFrame, fields: list[T.StructField], order_by: str | None) -> DataFrame:
    """``(column_name, values)`` in first-appearance order, ties in text order; the fields have few values.

    A numeric ``order_by`` keeps the aggregation hash-based.
    """
    per_type = []
    for cells in _cells(df, fields, order_by, shorten=False):
        first = F.min("__at") if order_by else F.lit(0)
        per_value = cells.groupBy("position", "value").agg(first.alias("__at"))
        per_type.append(per_value.select("position", F.col("value").cast("string").alias("value"), "__at"))
    ordered = F.sort_array(F.collect_list(F.struct("__at", "value")))
    lists = reduce(DataFrame.unionByName, per_type).groupBy("position").agg(
        F.transform(ordered, lambda e: e["value"]).alias("values")
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    return lists.select(F.element_at(names, F.col("position").cast("int") + 1).alias("column_name"), "values")


def distinct_values(
    df: DataFrame,
    order_by: str | None = None,
    max_values: int = MAX_VALUES,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """``(column_name, position, unique_count, values)`` of non-numeric columns.

    Values are listed, and counted by their lists, only for the columns that may
    have at most ``max_values``, reading just those columns. Which these are is
    known from ``counts`` or ruled out by sketches (``_surely_above``), so columns
    of many values are not shuffled. ``order_by`` names the key that defines first
    appearance; without one the values are in text order.
    """
    wanted = [f for f in df.schema.fields if column_kind(f.dataType) != "numeric"]
    if counts is None:
        above = _surely_above(df, wanted, max_values)
        possible = [f for f in wanted if f.name not in above]
    else:
        possible = [f for f in wanted if counts[f.name] <= max_values]
    positions = {c: i for i, c in enumerate(df.columns)}
    every = inline_rows(
        df.sparkSession, [(f.name, positions[f.name]) for f in possible], {"column_name": "string", "position": "int"}
    )
    none = F.array().cast("array<string>")
    if possible:
        listed = every.join(F.broadcast(_value_lists(df, possible, order_by)), "column_name", "left")
    else:
        listed = every.withColumn("values", none)
    listed = listed.withColumn("values", F.coalesce("values", none))
    return listed.select("column_name", "position", F.size("values").cast("bigint").alias("unique_count"), "values").where(
        F.col("unique_count") <= max_values
    )


def _surely_above(df: DataFrame, fields: list[T.StructField], max_values: int) -> set[str]:
    """Columns that have more than ``max_values`` distinct values for certain, from one scan of sketches.

    A sketch of 512 registers in which k values fill at most k is read by linear
    counting, which gives less than 1.2 k up to a quarter of the registers: an
    estimate of twice ``max_values`` proves that there are more. Columns it leaves
    have few values. For larger ``max_values`` nothing is ruled out.
    """
    if not fields or max_values > SKETCH_REGISTERS // 4:
        return set()
    row = df.agg(*[F.approx_count_distinct(_native(f, False)[1], 0.05).alias(f"d{i}") for i, f in enumerate(fields)]).first()
    return {f.name for f, estimate in zip(fields, row, strict=True) if estimate > 2 * max(max_values, 1)}


def column_profile(
    df: DataFrame, order_by: str | None = None, max_values: int = MAX_VALUES, approx: bool = False
) -> DataFrame:
    """One row per column: position, kind, rows, missing, distinct, values.

    ``values`` is filled for non-numeric columns with at most ``max_values``
    distinct values. ``is_zero_one`` marks numeric columns that hold exactly the
    two values 0 and 1, ``distinct_ratio`` is distinct / rows.
    """
    fields = df.schema.fields
    counted = {r["column_name"]: r for r in distinct_counts(df, approx=approx).collect()}
    missing = {f.name: f"m{i}" for i, f in enumerate(fields)}
    binary = {f.name: f"b{i}" for i, f in enumerate(fields)}
    rows = {f.name: "rows" for f in fields}

    def holds_zero_one(field: T.StructField) -> Column:
        if column_kind(field.dataType) != "numeric" or counted[field.name]["distinct"] != 2:
            return F.first(F.lit(False))
        number = col(field.name).cast("double")
        return F.coalesce(F.every(is_missing(field.name, field.dataType) | number.isin(0.0, 1.0)), F.lit(False))

    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(missing[f.name]) for f in fields],
        *[F.coalesce(holds_zero_one(f), F.lit(False)).alias(binary[f.name]) for f in fields],
    )
    base = _per_column(wide, df, rows=rows, missing=missing, is_zero_one=binary)
    distinct = inline_rows(
        df.sparkSession,
        [(name, r["distinct"], r["distinct_ratio"]) for name, r in counted.items()],
        {"column_name": "string", "distinct": "bigint", "distinct_ratio": "double"},
    )
    listed = distinct_values(
        df, order_by, max_values, counts={name: r["distinct"] for name, r in counted.items()}
    ).select("column_name", "values")
    return (
        base.join(F.broadcast(distinct), "column_name")
        .join(F.broadcast(listed), "column_name", "left")
        .select("column_name", "position", "kind", "rows", "missing", "distinct", "values", "distinct_ratio", "is_zero_one")
    )
