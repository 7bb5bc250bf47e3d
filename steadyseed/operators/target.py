"""Target analysis: classes, balance, oversampling advice, statistics, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.config import IMBALANCE_THRESHOLD
from steadyseed.functions.columns import col, is_missing
from steadyseed.functions.inline import inline_rows
from steadyseed.operators.quantiles import quantiles

# Reasons of the oversampling advice and histogram limits.
REASON_NOT_CLASSIFICATION = "ADASYN is only applicable for classification problems"
REASON_NOT_BINARY = "ADASYN is only recommended for binary classification problems"
REASON_IMBALANCED = "Class imbalance detected (%.1f%% vs %.1f%%). ADASYN recommended to balance classes."
REASON_BALANCED = "Classes are relatively balanced (%.1f%% vs %.1f%%). ADASYN not necessary."
MIN_BINS, MAX_BINS, ROWS_PER_BIN = 10, 50, 20


def _present(df: DataFrame, target: str) -> DataFrame:
    """The non-missing target values as the only column, ``value``."""
    return df.where(~is_missing(target, df.schema[target].dataType)).select(col(target).alias("value"))


def _counts(df: DataFrame, target: str) -> DataFrame:
    return _present(df, target).groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class, count, percentage)`` ordered by class, missing targets left out."""
    counts = _counts(df, target)
    total = counts.agg(F.sum("count").alias("total")).scalar()
    return counts.orderBy("value").select(
        F.col("value").cast("string").alias("class"),
        "count",
        F.round(F.col("count") * 100.0 / total, 2).alias("percentage"),
    )


def class_statistics(df: DataFrame, target: str) -> DataFrame:
    """Totals with the most and least frequent class (ties: smaller label), and first and last label."""
    counts = _counts(df, target)
    most, least = F.max("count"), F.min("count")
    extremes = counts.agg(most.alias("most"), least.alias("least"))
    smallest_with = lambda n: F.min(F.when(F.col("count") == n, F.col("value")))
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_samples"),
        F.count(F.lit(1)).alias("num_classes"),
        smallest_with(extremes.select("most").scalar()).cast("string").alias("most_frequent_class"),
        smallest_with(extremes.select("least").scalar()).cast("string").alias("least_frequent_class"),
        F.min("value").cast("string").alias("first_class"),
        F.max("value").cast("string").alias("last_class"),
    )


def _two_classes(df: DataFrame, target: str) -> DataFrame:
    """One row about the classes; first and last are the two when there are two."""
    counts = _counts(df, target)
    return counts.agg(
        F.count(F.lit(1)).alias("num_classes"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.max("count").alias("largest"),
        F.min(F.struct("value", "count")).alias("a"),
        F.max(F.struct("value", "count")).alias("b"),
    )


def _balance_columns(threshold: float) -> list[Column]:
    a_wins = F.col("a.count") >= F.col("b.count")
    major, minor = F.greatest("a.count", "b.count"), F.least("a.count", "b.count")
    a_label, b_label = F.col("a.value").cast("string"), F.col("b.value").cast("string")
    share = major / F.col("total")
    return [
        F.map_from_arrays(F.array(a_label, b_label), F.array("a.count", "b.count")).alias("class_distribution"),
        F.round(share, 3).alias("imbalance_ratio"),
        F.when(a_wins, a_label).otherwise(b_label).alias("majority_class"),
        F.when(a_wins, b_label).otherwise(a_label).alias("minority_class"),
        (share > threshold).alias("is_imbalanced"),
        F.round(share * 100.0, 1).alias("majority_percentage"),
        F.round(minor / F.col("total") * 100.0, 1).alias("minority_percentage"),
    ]


def class_imbalance(df: DataFrame, target: str, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """One row for exactly two classes, none otherwise; on a tie the smaller label is the majority."""
    return _two_classes(df, target).where(F.col("num_classes") == 2).select(*_balance_columns(threshold))


def oversampling_recommendation(
    df: DataFrame, target: str, problem_type: str, threshold: float = IMBALANCE_THRESHOLD
) -> DataFrame:
    """``(recommended, reason)``."""
    if problem_type != "classification":
        return inline_rows(
            df.sparkSession, [(False, REASON_NOT_CLASSIFICATION)], {"recommended": "boolean", "reason": "string"}
        )
    seen = _two_classes(df, target)
    share = F.greatest("a.count", "b.count") / F.col("total")
    rest = F.least("a.count", "b.count") / F.col("total")
    binary = F.col("num_classes") == 2
    shares = (F.round(share * 100.0, 1), F.round(rest * 100.0, 1))
    return seen.select(
        (binary & (share > threshold)).alias("recommended"),
        F.when(~binary, F.lit(REASON_NOT_BINARY))
        .when(share > threshold, F.format_string(REASON_IMBALANCED, *shares))
        .otherwise(F.format_string(REASON_BALANCED, *shares))
        .alias("reason"),
    )


def class_imbalance_kind(
    df: DataFrame, target: str, problem_type: str = "classification", threshold: float = IMBALANCE_THRESHOLD
) -> DataFrame:
    """``(imbalanced, kind)``: binary when one of two classes dominates, multiclass for more classes."""
    if problem_type != "classification":
        return inline_rows(df.sparkSession, [(False, None)], {"imbalanced": "boolean", "kind": "string"})
    dominated = (F.col("num_classes") == 2) & (F.col("largest") / F.col("total") > threshold)
    return _two_classes(df, target).select(
        dominated.alias("imbalanced"),
        F.when(dominated, "binary").when(F.col("num_classes") > 2, "multiclass").alias("kind"),
    )


def class_bars(df: DataFrame, target: str) -> DataFrame:
    """Chart data: the class distribution with the kind of chart that shows it."""
    bars = class_distribution(df, target)
    classes = _counts(df, target).agg(F.count(F.lit(1)).alias("classes")).scalar()
    kind = F.when(classes == 2, F.lit("bar_chart")).otherwise(F.lit("histogram"))
    return bars.withColumn("chart_type", kind)


def numeric_target_statistics(df: DataFrame, target: str) -> DataFrame:
    """Size, centre, spread, quartiles and bias-corrected shape of a numeric target."""
    values = _present(df, target).select(F.col("value").cast("double").alias("value"))
    n = F.count("value").cast("double")
    g1, g2 = F.skewness("value"), F.kurtosis("value")
    constant = F.min("value") == F.max("value")
    skew = F.when(n > 2, F.when(constant, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))
    kurt = F.when(
        n > 3, F.when(constant, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    )
    moments = values.agg(
        F.count("value").alias("total_samples"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
    )
    size = values.where(~F.isnan("value")).count()
    q25, q50, q75 = quantiles(values, "value", [0.25, 0.5, 0.75], size)
    return moments.select(
        "total_samples", "mean", F.lit(q50).cast("double").alias("median"), "std", "min", "max",
        F.lit(q25).cast("double").alias("q25"), F.lit(q75).cast("double").alias("q75"), "skewness", "kurtosis",
    )


def equal_width_histogram(values: DataFrame, column: str, bins: Column) -> DataFrame:
    """``(bin, lo, hi, n)`` over equal-width bins, the last one closed, empty bins kept.

    ``bins`` is an expression over ``n``, the number of values. A constant column
    is widened by 0.5 on both sides.
    """
    v = F.col(column).cast("double")
    stats = values.agg(F.min(v).alias("lo0"), F.max(v).alias("hi0"), F.count(v).alias("n")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
        bins.cast("int").alias("bins"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    lo, width, last = (
        stats.select("lo").scalar(), stats.select("width").scalar(), stats.select(F.col("bins") - 1).scalar()
    )
    edged = values.where(v.isNotNull()).select(v.alias("v"), lo.alias("lo"), width.alias("w"), last.alias("last"))
    guessed = edged.withColumn("guess", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int"), F.col("last")))
    # The division can land one bin off next to an edge; the edges decide.
    placed = F.expr("""
        CASE WHEN guess > 0 AND v < lo + guess * w THEN guess - 1
             WHEN guess < last AND v >= lo + (guess + 1) * w THEN guess + 1 ELSE guess END""")
    counted = guessed.groupBy(placed.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = stats.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "width"
    )
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("n"),
    )


def target_histogram(df: DataFrame, target: str) -> DataFrame:
    """The histogram behind the target chart: n // 20 bins, at least 10, at most 50."""
    bins = F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), F.floor(F.col("n") / ROWS_PER_BIN)))
    return equal_width_histogram(_present(df, target), "value", bins)


def target_markers(df: DataFrame, target: str) -> DataFrame:
    """The mean and median lines of the target chart."""
    return numeric_target_statistics(df, target).select("mean", "median")


def describe_target(df: DataFrame, target: str, problem_type: str) -> dict[str, DataFrame]:
    """The tables that describe the target, by name."""
    if problem_type == "classification":
        return {
            "class_distribution": class_distribution(df, target),
            "class_statistics": class_statistics(df, target),
            "class_imbalance": class_imbalance(df, target),
            "class_bars": class_bars(df, target),
        }
    return {
        "target_statistics": numeric_target_statistics(df, target),
        "target_histogram": target_histogram(df, target),
        "target_markers": target_markers(df, target),
    }
