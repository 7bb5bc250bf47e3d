"""Target indexing and categorical encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from steadyseed.config import MAX_LOOKUP_ROWS, CategoricalConfig, ensure_checkpoint_dir
from steadyseed.functions.columns import col, is_missing, is_nested, kinds, value_text
from steadyseed.functions.inline import inline_rows
from steadyseed.functions.numbering import numbered
from steadyseed.functions.skew import lookup_join
from steadyseed.operators.profile import distinct_counts
from steadyseed.sources.infer import DECIMAL_TEXT

MAX_LOOKUP_BYTES = 4 << 20
MAX_VECTOR_SIZE = 2**31 - 1
NAN_TEXT = "nan"
LAYOUTS = ("columns", "vector")


def drop_columns(df: DataFrame, target: str, removals: list[str]) -> DataFrame:
    """The features: everything but the target and the removed columns."""
    return df.drop(target, *removals)


def sorted_codes(values: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """``(column, code)`` numbering the distinct values in order, and whether it is small.

    Up to ``MAX_LOOKUP_ROWS`` values of ``MAX_LOOKUP_BYTES`` together are numbered
    on the driver and may be broadcast; more are numbered by ranges. The codes are
    the same either way.
    """
    distinct = values.select(col(column)).where(col(column).isNotNull()).distinct()
    kind = values.schema[column].dataType
    size = F.sum(F.octet_length(col(column).cast("string")))
    rows, bytes_ = distinct.limit(MAX_LOOKUP_ROWS + 1).agg(F.count(F.lit(1)), size).first()
    if rows <= MAX_LOOKUP_ROWS and (bytes_ or 0) <= MAX_LOOKUP_BYTES:
        found = sorted(r[0] for r in distinct.collect())
        rows = [(v, i) for i, v in enumerate(found)]
        return inline_rows(values.sparkSession, rows, {column: kind.simpleString(), "code": "bigint"}), True
    return numbered(distinct, [col(column)], "code"), False


def _attach_code(df: DataFrame, key: Column, codes: DataFrame, value: str, small: bool, spread_by: str | None) -> DataFrame:
    """``df`` with ``__code``, the code of ``key``; NULL keys get NULL."""
    lookup = codes.select(col(value).alias("__key"), F.col("code").alias("__code"))
    keyed = df.withColumn("__key", key)
    if small:
        return keyed.join(F.broadcast(lookup), "__key", "left").drop("__key")
    if spread_by is None:  # nothing to salt hot values by: Spark splits large partitions of the join
        return keyed.join(lookup, "__key", "left").drop("__key")
    known = lookup_join(keyed.where(F.col("__key").isNotNull()), lookup, ["__key"], spread_by, "left")
    unknown = keyed.where(F.col("__key").isNull()).withColumn("__code", F.lit(None).cast("bigint"))
    return known.unionByName(unknown).drop("__key")


def index_target(
    df: DataFrame, target: str, null_target: str = "error", row_id: str | None = None
) -> DataFrame:
    """Classification target as ``label``: integers as they are, else the sorted position.

    Missing targets are an error unless ``null_target='drop'``.
    """
    data_type = df.schema[target].dataType
    missing = is_missing(target, data_type)
    if null_target == "drop":
        df = df.where(~missing)
    elif not df.where(missing).limit(1).isEmpty():
        raise ValueError(f"target '{target}' holds missing values; use null_target='drop' to leave those rows out")
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn("label", col(target).cast("bigint")).drop(target)
    codes, small = sorted_codes(df, target)
    labelled = _attach_code(df, col(target), codes, target, small, row_id)
    return labelled.withColumnRenamed("__code", "label").drop(target)


def coerce_numeric_target(df: DataFrame, target: str, null_target: str = "error") -> DataFrame:
    """Regression target as the double ``label``; text that is no number is an error."""
    data_type = df.schema[target].dataType
    missing = is_missing(target, data_type)
    if null_target == "drop":
        df = df.where(~missing)
    if isinstance(data_type, T.NumericType):
        value = col(target).cast("double")
    else:
        text = value_text(target, data_type)
        value = F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("double"))
    # NaN is a missing target like NULL.
    seen = df.agg(
        F.count_if(missing).alias("missing"), F.count_if(~missing & value.isNull()).alias("unreadable")
    ).first()
    if seen["unreadable"]:
        raise ValueError(f"regression needs numbers, but {seen['unreadable']} values of target '{target}' are other text")
    if seen["missing"]:
        raise ValueError(f"target '{target}' holds missing values; use null_target='drop' to leave those rows out")
    return df.withColumn("label", value).drop(target)


def ordinal_encode(df: DataFrame, column: str, ordering: list[str] | tuple[str, ...]) -> DataFrame:
    """Position in the ordering as a double; values outside it become NULL, a repeated one takes its last position."""
    position = {value: i for i, value in enumerate(ordering)}
    pairs = [part for value, i in position.items() for part in (F.lit(value), F.lit(float(i)))]
    text = value_text(column, df.schema[column].dataType)
    code = F.try_element_at(F.create_map(*pairs), F.coalesce(text, F.lit("")))
    return df.withColumn(column, F.when(text.isNotNull(), code))


def ordinal_encode_auto(df: DataFrame, column: str, row_id: str | None = None) -> DataFrame:
    """Position among the sorted texts of the column, a missing value being the text ``nan``."""
    text = F.coalesce(value_text(column, df.schema[column].dataType), F.lit(NAN_TEXT))
    codes, small = sorted_codes(df.select(text.alias("__value")), "__value")
    coded = _attach_code(df, text, codes, "__value", small, row_id)
    return coded.withColumn(column, F.col("__code").cast("double")).drop("__code").select(*[col(c) for c in df.columns])


def category_values(df: DataFrame, columns: list[str], limit: int | None = None) -> dict[str, list[str] | None]:
    """Sorted categories per column, missing values being the text ``nan``, last; None where there are more than ``limit``.

    Columns are counted first where there is a limit; values are then read only of
    the columns within it.
    """
    if not columns:
        return {}
    fitting = columns
    if limit is not None:
        sizes = {r["column_name"]: r["distinct"] for r in distinct_counts(df, columns=columns).collect()}
        fitting = [c for c in columns if sizes[c] <= limit]
    found: dict[str, list[str] | None] = {c: [] if c in fitting else None for c in columns}
    if fitting:
        texts = df.select(*[category_text(df, c).alias(str(i)) for i, c in enumerate(fitting)])
        cells = texts.unpivot([], texts.columns, "position", "value").distinct().collect()
        for r in cells:
            found[fitting[int(r["position"])]].append(r["value"])
    # A missing value is a category too, and is seen only now.
    return {
        c: sorted(v, key=lambda x: (x == NAN_TEXT, x)) if v is not None and (limit is None or len(v) <= limit) else None
        for c, v in found.items()
    }


def category_text(df: DataFrame, name: str) -> Column:
    """The category of a row; a missing value and the text ``nan`` are one."""
    return F.coalesce(value_text(name, df.schema[name].dataType), F.lit(NAN_TEXT))


def distinct_name(name: str, taken: set[str]) -> str:
    """``name``, or with a number if a column of that name exists; names are compared without case, as Spark does."""
    found, n = name, 1
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    taken.add(found.lower())
    return found


def one_hot_encode(
    df: DataFrame, columns: list[str], max_categories: int | None = None, row_id: str | None = None
) -> DataFrame:
    """0/1 columns ``column_value`` for every category, missing values being ``column_nan``.

    Where two such names are equal but for case, or a column has the name already,
    later ones get a number (``answer_yes_2``). The table's shape depends on its
    categories alone. Only a caller who gives ``max_categories`` gets one sparse
    vector column ``column_onehot`` for columns with more.
    """
    categories = category_values(df, columns, max_categories)
    kept = [col(c) for c in df.columns if c not in columns]
    taken = {c.lower() for c in df.columns}
    dense = []
    for name in columns:
        text = category_text(df, name)
        for value in categories[name] or []:
            dense.append((text == F.lit(value)).cast("double").alias(distinct_name(f"{name}_{value}", taken)))
    wide = [c for c in columns if categories[c] is None]
    encoded = df.select(*kept, *dense, *[col(c) for c in wide])
    for name in wide:
        encoded = _sparse_one_hot(encoded, name, row_id)
    return encoded


def _sparse_one_hot(df: DataFrame, name: str, row_id: str | None) -> DataFrame:
    """Categories in order, a missing value being the last."""
    text = df.withColumn("__text", value_text(name, df.schema[name].dataType)).drop(name)
    codes, small = sorted_codes(text, "__text")
    coded = _attach_code(text, F.col("__text"), codes, "__text", small, row_id)
    indexed = coded.withColumn("__index", F.coalesce(F.col("__code"), codes.agg(F.count(F.lit(1))).scalar()).cast("double"))
    encoder = OneHotEncoder(inputCol="__index", outputCol=f"{name}_onehot", dropLast=False)
    return encoder.fit(indexed).transform(indexed).drop("__text", "__code", "__index")


def category_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, code)``: the categories of all columns, numbered together from 0.

    Codes go column by column in the given order, and by value inside a column, a
    missing value (and the text ``nan``) being the last one. Values are combined
    map-side and numbered by ranges; none is brought to the driver. A table without
    rows, or no columns, gives an empty dictionary.
    """
    if not columns:
        return inline_rows(df.sparkSession, [], {"column_name": "string", "value": "string", "code": "bigint"})
    ensure_checkpoint_dir(df.sparkSession)
    texts = df.select(*[category_text(df, c).alias(str(i)) for i, c in enumerate(columns)])
    cells = texts.unpivot([], texts.columns, "position", "value").distinct()
    placed = cells.select(F.col("position").cast("int").alias("position"), "value")
    ordered = numbered(placed, [F.col("position"), F.col("value") == NAN_TEXT, F.col("value")], "code")
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("position"))
    return ordered.select(name.alias("column_name"), "value", "code").checkpoint()


def _unit_vectors(codes: pa.Array, sizes: pa.Array) -> pa.Array:
    """Sparse vectors with 1 at the codes, in the layout of MLlib's vector type."""
    places = codes.cast(pa.list_(pa.int32()))
    ones = pa.ListArray.from_arrays(places.offsets, pa.array(np.ones(len(places.values))))
    kind = pa.array(np.zeros(len(codes), dtype=np.int8))
    return pa.StructArray.from_arrays([kind, sizes.cast(pa.int32()), places, ones], ["type", "size", "indices", "values"])


def one_hot_vector(
    df: DataFrame, columns: list[str], output: str = "onehot", row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``df`` with one sparse vector in place of the columns, and the dictionary that names its places.

    A row has a 1 at the code of its category in each column (``category_dictionary``),
    so the vector is as long as there are categories and the plan does not grow with
    them. Dictionaries up to ``MAX_LOOKUP_ROWS`` rows of ``MAX_LOOKUP_BYTES`` are
    broadcast; larger ones are joined, hot categories being spread by ``row_id``
    where it is given. Every row stays, repeated ones too.
    """
    dictionary = category_dictionary(df, columns)
    rows, bytes_ = dictionary.agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).first()
    if rows > MAX_VECTOR_SIZE:
        raise ValueError(f"{rows} categories are more than a vector can hold")
    small = rows <= MAX_LOOKUP_ROWS and (bytes_ or 0) <= MAX_LOOKUP_BYTES
    table, kept = df, [c for c in df.columns if c not in columns]
    for i, name in enumerate(columns):
        lookup = dictionary.where(F.col("column_name") == F.lit(name)).select(F.col("value").alias("__key"), F.col("code").alias(f"__code_{i}"))
        keyed = table.withColumn("__key", category_text(df, name))
        if small:
            table = keyed.join(F.broadcast(lookup), "__key").drop("__key")
        elif row_id is None:  # nothing to salt hot values by: Spark splits large partitions of the join
            table = keyed.join(lookup, "__key").drop("__key")
        else:
            table = lookup_join(keyed, lookup, ["__key"], row_id).drop("__key")
    codes = F.array(*[F.col(f"__code_{i}").cast("int") for i in range(len(columns))]).cast("array<int>")
    vector = F.arrow_udf(_unit_vectors, VectorUDT())(codes, F.lit(rows).cast("int"))
    taken = {c.lower() for c in kept}
    return table.select(*[col(c) for c in kept], vector.alias(distinct_name(output, taken))), dictionary


@dataclass
class EncodedFeatures:
    """Encoded table, its feature columns, those that hold numbers, findings about columns left out, names of a vector's places."""

    table: DataFrame
    features: list[str]
    numeric: list[str]
    findings: list[tuple] = field(default_factory=list)
    dictionary: DataFrame | None = None


def encode_features(
    df: DataFrame,
    keep: list[str],
    configs: list[CategoricalConfig] | None = None,
    row_id: str | None = None,
    max_categories: int | None = None,
    layout: str = "columns",
) -> EncodedFeatures:
    """Numeric columns as doubles, configured ordinals as positions, other text one-hot.

    ``layout='columns'`` gives a 0/1 column per category, whose names the driver
    has to know; ``layout='vector'`` gives one sparse vector ``onehot`` with a
    dictionary table at any number of categories, none of them on the driver.
    ``keep`` names columns that are no features (row id, label). Datetime and
    nested columns cannot be encoded; they are left out with a finding, except
    arrays of numbers, which are features already.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout!r}")
    by_name = {c.variable_name: c for c in configs or []}
    kind = kinds(df)
    found: list[tuple] = []
    ready, numeric, ordinal, nominal = [], [], [], []
    for f in df.schema.fields:
        if f.name in keep:
            continue
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            ready.append(f.name)
        elif is_nested(f.dataType):
            found.append(("warning", "nested_feature", f.name, f"Nested column '{f.name}' cannot be encoded; it is left out"))
        elif kind[f.name] == "datetime":
            found.append(("warning", "datetime_feature", f.name, f"Datetime column '{f.name}' cannot be encoded; it is left out"))
        elif kind[f.name] == "numeric":
            numeric.append(f.name)
        elif f.name in by_name and by_name[f.name].variable_type == "ordinal":
            ordinal.append(f.name)
        else:
            nominal.append(f.name)
    table = df.select(
        *[col(c) for c in keep],
        *[_as_number(df, c) if c in numeric else col(c) for c in df.columns if c in {*ready, *numeric, *ordinal, *nominal}],
    )
    for name in ordinal:
        ordering = by_name[name].value_ordering
        table = ordinal_encode(table, name, ordering) if ordering else ordinal_encode_auto(table, name, row_id)
    dictionary = None
    if nominal and layout == "vector":
        table, dictionary = one_hot_vector(table, nominal, row_id=row_id)
    elif nominal:
        table = one_hot_encode(table, nominal, max_categories, row_id)
    features = [c for c in table.columns if c not in keep]
    numbers = [c for c in features if isinstance(table.schema[c].dataType, T.NumericType)]
    return EncodedFeatures(table, features, numbers, found, dictionary)


def _as_number(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    value = col(name).cast("int").cast("double") if isinstance(data_type, T.BooleanType) else col(name).cast("double")
    return F.when(~is_missing(name, data_type), value).alias(name)


def epoch_seconds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Datetime columns as seconds since 1970, for callers that want them as features."""
    return df.withColumns({
        c: F.unix_micros(col(c).cast("timestamp")) / F.lit(1e6) for c in columns
    })

