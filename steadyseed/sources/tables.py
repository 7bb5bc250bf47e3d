"""Readers: delimited text, JSON, workbooks, Parquet."""

from __future__ import annotations

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from steadyseed.functions.columns import col, is_floating
from steadyseed.sources.infer import NA_TOKENS, blank_missing, infer_types
from steadyseed.sources.workbook import sheet_rows


def read_csv(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS, multi_line: bool = False) -> DataFrame:
    """A delimited file or folder with a header line; types are inferred.

    ``multi_line`` is for quoted line breaks; without it large files are split.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    return infer_types(blank_missing(text, na_tokens))


def read_json(spark: SparkSession, path: str, orient: str = "records") -> DataFrame:
    """JSON as an array of records, as one record per line, or as columns.

    ``columns`` is ``{"column": {"row": value}}``, one such object per file.
    """
    if orient == "lines":
        return _in_file_order(spark.read.json(path), spark.read.text(path).select("value"))
    if orient == "records":
        first = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$[0]").alias("value"))
        return _in_file_order(spark.read.json(path, multiLine=True), first)
    if orient != "columns":
        raise ValueError(f"orient must be records, lines or columns, got {orient!r}")
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"),
        F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))).alias("table"),
    )
    cells = files.select("file", F.explode("table").alias("name", "entries")).select(
        "file", "name", F.explode("entries").alias("row", "value")
    )
    table = infer_types(blank_missing(_by_row(cells, ["file", "row"])))
    return _in_file_order(table, spark.read.text(path, wholetext=True).select("value"))


def _in_file_order(table: DataFrame, records: DataFrame) -> DataFrame:
    """Columns by the earliest place any record gives them; those that no record of ``records`` has come last, by name."""
    keys = records.select(F.posexplode(F.json_object_keys("value")).alias("place", "name"))
    place = {r["name"]: r["place"] for r in keys.groupBy("name").agg(F.min("place").alias("place")).collect()}
    return table.select(*[col(c) for c in sorted(table.columns, key=lambda c: (place.get(c, len(place)), c))])


def json_orient(spark: SparkSession, path: str) -> str:
    """How a JSON source is laid out: an array of records, else an object of columns, else a record per line."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    text = line[0]["value"].strip() if line else "["
    if text.startswith("["):
        return "records"
    try:
        whole = json.loads(text)
    except ValueError:  # an object over several lines
        return "columns"
    return "columns" if whole and all(isinstance(v, dict) for v in whole.values()) else "lines"


def _by_row(cells: DataFrame, row_key: list[str]) -> DataFrame:
    """Cells ``(row_key, name, value)`` to a table; column names in name order."""
    names = [r["name"] for r in cells.select("name").distinct().orderBy("name").collect()]
    if not names:
        raise ValueError("the source holds no columns")
    wide = cells.groupBy(*row_key).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )
    return wide.select(*[col(n) for n in names])


def read_workbooks(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A workbook, or a folder of workbooks with the same kind of sheet.

    Each workbook is one task; its first row names the columns. Columns appear
    in their order in the sheet.
    """
    if path.lower().endswith(".xls"):
        raise ValueError("legacy binary workbooks are not supported; save as .xlsx")
    row_type = "values array<struct<position:int,name:string,value:string>>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = sheet_rows(content, sheet)
                header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(next(lines, []))]
                pending = []
                for line in lines:
                    pending.append([
                        {"position": i, "name": name, "value": line[i] if i < len(line) else None}
                        for i, name in enumerate(header)
                    ])
                    if len(pending) == 10_000:
                        yield pd.DataFrame({"values": pending})
                        pending = []
                if pending:
                    yield pd.DataFrame({"values": pending})

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    sheet_lines = books.mapInPandas(rows, row_type)
    heads = (
        sheet_lines.select(F.explode("values").alias("v"))
        .groupBy("v.name").agg(F.min("v.position").alias("position"))
        .orderBy("position", "name").collect()
    )
    if not heads:
        raise ValueError(f"no rows in {path}")
    by_name = F.map_from_entries(F.transform("values", lambda v: F.struct(v["name"], v["value"])))
    text = sheet_lines.select(by_name.alias("m")).select(
        *[F.try_element_at("m", F.lit(h["name"])).alias(h["name"]) for h in heads]
    )
    return infer_types(blank_missing(text))


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[
        F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if is_floating(f.dataType) else col(f.name)
        for f in df.schema.fields
    ])


def spread_narrow(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer partitions than there are cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_table(spark: SparkSession, path: str, spread: bool = False, **options) -> DataFrame:
    """Read by extension: .csv, .json, .xlsx or .parquet.

    ``spread`` is for heavy work on a file that cannot be split into enough tasks.
    """
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        table = read_csv(spark, path, **options)
    elif lowered.endswith(".json"):
        table = read_json(spark, path, **(options if "orient" in options else {**options, "orient": json_orient(spark, path)}))
    elif lowered.endswith((".xlsx", ".xls")):
        table = read_workbooks(spark, path, **options)
    elif lowered.endswith(".parquet"):
        table = spark.read.parquet(path, **options)
    else:
        raise ValueError(f"no reader for the extension of {path}; known are .csv, .json, .xlsx and .parquet")
    return missing_as_null(spread_narrow(table) if spread else table)
