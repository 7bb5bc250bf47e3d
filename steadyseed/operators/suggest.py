"""Suggestions read off the profile: targets, removable columns, variable types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.operators.profile import MAX_VALUES, distinct_values

# Name parts, value scales and reasons.
TARGET_NAME_PARTS = (
    "target", "label", "class", "outcome", "result", "prediction",
    "approved", "success", "failure", "churned", "converted",
    "price", "value", "amount", "score", "rating", "revenue",
    "sales", "profit", "loss", "cost", "gone", "left",
)
REMOVAL_NAME_PARTS = (
    "id", "index", "key", "uuid", "guid", "timestamp", "date_created",
    "created_at", "updated_at", "modified_at",
)
MAX_TARGETS = 5
REMOVAL_RATIO = 0.8
BINARY_PAIRS = (
    ("yes", "no"), ("true", "false"), ("0", "1"), ("pass", "fail"),
    ("approved", "rejected"), ("active", "inactive"), ("on", "off"),
    ("high", "low"), ("good", "bad"), ("positive", "negative"),
)
ORDINAL_SCALES = (
    ("low", "medium", "high"), ("small", "medium", "large"),
    ("poor", "fair", "good", "excellent"), ("bad", "average", "good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
    ("beginner", "intermediate", "advanced"), ("junior", "senior"),
    ("first", "second", "third"), ("primary", "secondary", "tertiary"),
)
SIZES = ("xs", "s", "m", "l", "xl", "xxl")
GRADES = ("a", "b", "c", "d", "f")
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
WEEKDAYS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
)
NUMBER_TEXT = (
    r"^[+-]?(([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?$"
    r"|^[+-]?(inf|infinity|nan)$"
)
REASON_BINARY = "Binary classification pattern detected: {}"
REASON_SCALE = "Ordinal pattern detected: {}"
REASON_SIZE = "Size classification detected (XS, S, M, L, XL, etc.)"
REASON_GRADE = "Grade/rating pattern detected (A, B, C, D, F)"
REASON_NUMBER = "Numeric strings detected - likely ordinal"
REASON_MONTH = "Month names detected - chronological order"
REASON_WEEKDAY = "Day names detected - chronological order"
REASON_TWO = "Binary variable - assuming ordinal ordering"
REASON_FEW = "Small number of categories (%d) - likely ordinal"
REASON_MANY = "Many categories (%d) - likely nominal"
WHITESPACE = " \t\n\r\x0b\x0c"


def _name_holds(parts: tuple[str, ...]) -> Column:
    return F.lower("column_name").rlike("|".join(parts))


def suggest_targets(profile: DataFrame, limit: int = MAX_TARGETS) -> DataFrame:
    """The first columns that look like a target by name or by holding 0 and 1."""
    return (
        profile.where(_name_holds(TARGET_NAME_PARTS) | F.col("is_zero_one"))
        .select("column_name", "position")
        .orderBy("position")
        .limit(limit)
    )


def suggest_removals(profile: DataFrame, ratio: float = REMOVAL_RATIO) -> DataFrame:
    """Columns named like an identifier, or text with mostly distinct values."""
    mostly_distinct = (F.col("kind") != "numeric") & (F.col("distinct_ratio") > ratio)
    return profile.where(_name_holds(REMOVAL_NAME_PARTS) | mostly_distinct).select("column_name", "position")


def default_target(profile: DataFrame) -> DataFrame:
    """The last suggested target."""
    return suggest_targets(profile).agg(F.max_by("column_name", "position").alias("column_name"))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _within(values: Column, scale: tuple[str, ...]) -> Column:
    return F.size(F.array_except(values, _texts(scale))) == 0


def _listing(values: tuple[str, ...]) -> str:
    return str(list(values))


def classify_values(values: Column, unique_count: Column) -> Column:
    """``struct(suggested_type, reasoning)`` of the values; the first matching rule wins."""
    seen = F.array_distinct(F.transform(values, lambda v: F.lower(F.trim(v, F.lit(WHITESPACE)))))
    ordinal: list[tuple[Column, Column]] = []
    for pair in BINARY_PAIRS:
        both = _within(seen, pair) & (F.size(seen) == len(set(pair)))
        ordinal.append((both, F.lit(REASON_BINARY.format(_listing(pair)))))
    for scale in ORDINAL_SCALES:
        ordinal.append((_within(seen, scale) & (F.size(seen) >= 2), F.lit(REASON_SCALE.format(_listing(scale)))))
    ordinal += [
        (_within(seen, SIZES), F.lit(REASON_SIZE)),
        (_within(seen, GRADES), F.lit(REASON_GRADE)),
        (F.forall(seen, lambda v: v.rlike(NUMBER_TEXT)), F.lit(REASON_NUMBER)),
        (_within(seen, MONTHS), F.lit(REASON_MONTH)),
        (_within(seen, WEEKDAYS), F.lit(REASON_WEEKDAY)),
        (unique_count == 2, F.lit(REASON_TWO)),
        (unique_count.between(3, 7), F.format_string(REASON_FEW, unique_count)),
    ]

    def verdict(kind: str, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("suggested_type"), reason.alias("reasoning"))

    (first_test, first_reason), *rest = ordinal
    chain = reduce(
        lambda acc, rule: acc.when(rule[0], verdict("ordinal", rule[1])),
        rest,
        F.when(first_test, verdict("ordinal", first_reason)),
    )
    return chain.otherwise(verdict("nominal", F.format_string(REASON_MANY, unique_count)))


def suggest_categorical_types(df: DataFrame, order_by: str | None = None, max_values: int = MAX_VALUES) -> DataFrame:
    """Ordinal or nominal, with the reason, for every non-numeric column with few values.

    A column without any value gets no suggestion.
    """
    listed = distinct_values(df, order_by, max_values).where(F.size("values") > 0)
    verdict = classify_values(F.col("values"), F.col("unique_count"))
    return listed.select(
        F.col("column_name").alias("variable_name"),
        "position",
        verdict["suggested_type"].alias("suggested_type"),
        F.col("values").alias("unique_values"),
        "unique_count",
        verdict["reasoning"].alias("reasoning"),
    )


def default_categorical_configs(suggestions: DataFrame) -> DataFrame:
    """Each ordinal suggestion as a configuration ordered by first appearance."""
    return suggestions.where(F.col("suggested_type") == "ordinal").select(
        "variable_name",
        F.lit("ordinal").alias("variable_type"),
        F.col("unique_values").alias("value_ordering"),
    )
