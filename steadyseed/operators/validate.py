"""Validation of a configuration against a table, as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadyseed.config import (
    BINARY_METRICS,
    IMPUTE_METHODS,
    MAX_ITERATIONS,
    MIN_ITERATIONS,
    PROBLEM_TYPES,
    AnalysisConfig,
    CategoricalConfig,
    metrics_for,
)
from steadyseed.functions.columns import is_nested, kinds, value_text
from steadyseed.functions.inline import inline_rows
from steadyseed.operators.profile import distinct_counts
from steadyseed.sources.infer import DECIMAL_TEXT

FINDING = {"severity": "string", "check": "string", "column": "string", "message": "string"}
# Thresholds of the warnings and texts of the messages.
MANY_CLASSES, FEW_FEATURES, FEW_ROWS = 20, 3, 50
NO_COLUMN = "Column '{}' not found in dataset"
NUMERIC_COLUMN = "Column '{}' is numeric, not categorical"
MISSING_VALUES = "Missing values in ordering for '{}': {}"
EXTRA_VALUES = "Extra values in ordering for '{}': {}"
NO_TARGET = "Target column '{}' not found"
TARGET_REMOVED = "Target column cannot be in remove columns list"
TOO_MANY_CLASSES = "High number of classes ({}) for classification. Consider regression."
TOO_FEW_CLASSES = "Classification requires at least 2 classes"
TARGET_NOT_NUMERIC = "Regression target must be numeric"
NO_FEATURES = "No features remaining after column removal"
FEATURES_FEW = "Very few features remaining. Consider keeping more columns."
ROWS_FEW = "Small dataset size may lead to unreliable results"


def findings(spark, rows: list[tuple]) -> DataFrame:
    return inline_rows(spark, rows, FINDING)


def ordering_differences(df: DataFrame, configs: list[CategoricalConfig]) -> DataFrame:
    """``(config, column_name, side, value)``: values missing from an ordering, or extra in it.

    ``config`` is the position in ``configs``. Distinct values are combined
    map-side; the orderings are the caller's own lists.
    """
    ordered = [
        (i, c) for i, c in enumerate(configs)
        if c.variable_type == "ordinal" and c.value_ordering and c.variable_name in df.columns
    ]
    schema = {"config": "int", "column_name": "string", "value": "string"}
    wanted = inline_rows(
        df.sparkSession, [(i, c.variable_name, v) for i, c in ordered for v in dict.fromkeys(c.value_ordering)], schema
    )
    if not ordered:
        return wanted.select("config", "column_name", F.lit("").alias("side"), "value")
    texts = df.select(*[value_text(c.variable_name, df.schema[c.variable_name].dataType).alias(str(i)) for i, c in ordered])
    names = F.element_at(F.create_map(*[F.lit(x) for i, c in ordered for x in (i, c.variable_name)]), F.col("config"))
    present = (
        texts.unpivot([], texts.columns, "position", "value").where(F.col("value").isNotNull()).distinct()
        .withColumn("config", F.col("position").cast("int")).select("config", names.alias("column_name"), "value")
    )
    key = ["config", "column_name", "value"]
    missing = present.join(F.broadcast(wanted), key, "left_anti")
    known = present.join(F.broadcast(wanted), key, "left_semi")
    extra = wanted.join(known, key, "left_anti")
    return missing.select("config", "column_name", F.lit("missing").alias("side"), "value").unionByName(
        extra.select("config", "column_name", F.lit("extra").alias("side"), "value")
    )


def validate_categorical_configs(
    df: DataFrame, configs: list[CategoricalConfig]
) -> tuple[list[CategoricalConfig], DataFrame]:
    """The configurations that hold for the table, and findings about the others.

    A finding names every value; its text is put together in Spark, and only which
    configurations differ reaches the driver.
    """
    rows: list[tuple] = []
    kind = kinds(df)
    usable = []
    for config in configs:
        name = config.variable_name
        if name not in kind:
            rows.append(("warning", "categorical_config", name, NO_COLUMN.format(name)))
        elif kind[name] == "numeric":
            rows.append(("warning", "categorical_config", name, NUMERIC_COLUMN.format(name)))
        else:
            usable.append(config)
    differences = ordering_differences(df, usable)
    tally: set[tuple[int, str]] = set()  # at most two per configuration
    if any(c.variable_type == "ordinal" and c.value_ordering for c in usable):
        tally = {(r["config"], r["side"]) for r in differences.select("config", "side").distinct().collect()}
    found = findings(df.sparkSession, rows)
    if tally:
        found = found.unionByName(_difference_findings(differences, usable, sorted(tally)))
    rejected = {i for i, _ in tally}
    return [c for i, c in enumerate(usable) if i not in rejected], found


def _difference_findings(differences: DataFrame, configs: list[CategoricalConfig], sides: list[tuple[int, str]]) -> DataFrame:
    """One finding per configuration and side that names all its values; the texts are put together in Spark."""
    templates = {"missing": MISSING_VALUES, "extra": EXTRA_VALUES}
    starts = inline_rows(
        differences.sparkSession,
        [(i, side, configs[i].variable_name, templates[side].format(configs[i].variable_name, "")) for i, side in sides],
        {"config": "int", "side": "string", "column": "string", "start": "string"},
    )
    named = differences.groupBy("config", "side").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("named"))
    return named.join(F.broadcast(starts), ["config", "side"]).select(
        F.lit("warning").alias("severity"), F.lit("categorical_config").alias("check"), "column",
        F.concat("start", "named").alias("message"),
    )


def _settings_findings(cfg: AnalysisConfig) -> list[tuple]:
    rows = []
    if cfg.problem_type not in PROBLEM_TYPES:
        rows.append(("error", "problem_type", None, f"Problem type must be one of {list(PROBLEM_TYPES)}"))
    elif cfg.resolved_metric not in metrics_for(cfg.problem_type):
        rows.append(("error", "metric", None, f"Metric {cfg.resolved_metric} is not a {cfg.problem_type} metric"))
    if cfg.impute_method not in IMPUTE_METHODS:
        rows.append(("error", "impute_method", None, f"Impute method must be one of {list(IMPUTE_METHODS)}"))
    if not MIN_ITERATIONS <= cfg.iterations <= MAX_ITERATIONS:
        rows.append(("error", "iterations", None, f"Iterations must be between {MIN_ITERATIONS} and {MAX_ITERATIONS}"))
    return rows


def unparsable_target_count(df: DataFrame, target: str) -> DataFrame:
    """How many target values are present but not a number."""
    text = value_text(target, df.schema[target].dataType)
    return df.agg(F.count_if(text.isNotNull() & ~text.rlike(DECIMAL_TEXT)).alias("unparsable"))


def class_and_row_findings(df: DataFrame, cfg: AnalysisConfig) -> list[tuple]:
    """Checks that read the table: classes or number format of the target, and size."""
    rows = []
    target_type = df.schema[cfg.target].dataType
    total = F.count(F.lit(1)).alias("rows")
    if cfg.problem_type == "classification":
        classes = distinct_counts(df, columns=[cfg.target]).first()["distinct"]
        n = df.agg(total).first()["rows"]
        if classes > MANY_CLASSES:
            rows.append(("warning", "class_count", cfg.target,
                         TOO_MANY_CLASSES.format(classes)))
        elif classes < 2:
            rows.append(("error", "class_count", cfg.target, TOO_FEW_CLASSES))
        if classes > 2 and cfg.average == "binary" and cfg.resolved_metric in BINARY_METRICS:
            rows.append(("error", "metric", cfg.target,
                         f"Metric {cfg.resolved_metric} is defined for two classes, got {classes}; use average='macro'"))
    elif kinds(df)[cfg.target] == "numeric":
        n = df.agg(total).first()["rows"]
    else:
        text = value_text(cfg.target, target_type)
        seen = df.agg(total, F.count_if(text.isNotNull() & ~text.rlike(DECIMAL_TEXT)).alias("unparsable")).first()
        n = seen["rows"]
        if seen["unparsable"]:
            rows.append(("error", "numeric_target", cfg.target, TARGET_NOT_NUMERIC))
    if n < FEW_ROWS:
        rows.append(("warning", "row_count", None, ROWS_FEW))
    return rows


def feature_findings(df: DataFrame, cfg: AnalysisConfig) -> list[tuple]:
    """Checks on the schema left after removals."""
    rows = []
    removals = list(dict.fromkeys(cfg.remove_columns))
    for name in removals:
        if name not in df.columns:
            rows.append(("warning", "removals", name, f"Column '{name}' to remove not found in dataset"))
    kept = [c for c in df.columns if c != cfg.target and c not in removals and c != cfg.id_col]
    if len(kept) < 1:
        rows.append(("error", "feature_count", None, NO_FEATURES))
    elif len(kept) < FEW_FEATURES:
        rows.append(("warning", "feature_count", None, FEATURES_FEW))
    for name in kept:
        if kinds(df)[name] == "datetime":
            rows.append(("warning", "datetime_feature", name, f"Datetime column '{name}' cannot be encoded; remove it"))
        elif is_nested(df.schema[name].dataType):
            rows.append(("warning", "nested_feature", name, f"Nested column '{name}' cannot be encoded; it is left out"))
    return rows


def validate_configuration(df: DataFrame, cfg: AnalysisConfig) -> tuple[bool, DataFrame]:
    """``(valid, findings)``; a missing or removed target ends the checks at once."""
    spark = df.sparkSession
    if cfg.target not in df.columns:
        return False, findings(spark, [("error", "target", cfg.target, NO_TARGET.format(cfg.target))])
    if cfg.target in cfg.remove_columns:
        return False, findings(
            spark, [("error", "target", cfg.target, TARGET_REMOVED)]
        )
    rows = _settings_findings(cfg)
    if cfg.problem_type in PROBLEM_TYPES:
        rows += class_and_row_findings(df, cfg)
    rows += feature_findings(df, cfg)
    valid = not any(r[0] == "error" for r in rows)
    found = findings(spark, rows)
    if cfg.categorical_configs:
        found = found.unionByName(validate_categorical_configs(df, cfg.categorical_configs)[1])
    return valid, found
