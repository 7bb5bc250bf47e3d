"""Score metrics as one grouped aggregation over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.config import BINARY_METRICS, default_metric, metrics_for

POSITIVE = 1.0


def _hits(label: Column, prediction: Column, positive: float) -> tuple[Column, Column, Column]:
    said_yes, is_yes = prediction == F.lit(positive), label == F.lit(positive)
    tp = F.sum(F.when(said_yes & is_yes, 1.0).otherwise(0.0))
    fp = F.sum(F.when(said_yes & ~is_yes, 1.0).otherwise(0.0))
    fn = F.sum(F.when(~said_yes & is_yes, 1.0).otherwise(0.0))
    return tp, fp, fn


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def precision(label: Column, prediction: Column, positive: float = POSITIVE) -> Column:
    tp, fp, _ = _hits(label, prediction, positive)
    return _ratio_or_zero(tp, tp + fp)


def recall(label: Column, prediction: Column, positive: float = POSITIVE) -> Column:
    tp, _, fn = _hits(label, prediction, positive)
    return _ratio_or_zero(tp, tp + fn)


def f1(label: Column, prediction: Column, positive: float = POSITIVE) -> Column:
    tp, fp, fn = _hits(label, prediction, positive)
    return _ratio_or_zero(2.0 * tp, 2.0 * tp + fp + fn)


def mae(label: Column, prediction: Column) -> Column:
    return F.avg(F.abs(label - prediction))


def rmse(label: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((label - prediction) * (label - prediction)))


def r2(label: Column, prediction: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when every prediction is exact, else 0."""
    sse = F.sum((label - prediction) * (label - prediction))
    sst = F.var_pop(label) * F.count(label)
    constant = F.min(label) == F.max(label)
    return F.when(constant, F.when(sse == 0.0, 1.0).otherwise(0.0)).otherwise(1.0 - sse / F.nullif(sst, F.lit(0.0)))


def metric_column(metric: str, label: str = "label", prediction: str = "prediction", positive: float = POSITIVE) -> Column:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    binary = {"precision": precision, "recall": recall, "f1": f1}
    plain = {"accuracy": accuracy, "mae": mae, "rmse": rmse, "r2": r2}
    name = metric.lower()
    if name in binary:
        return binary[name](y, p, positive)
    if name in plain:
        return plain[name](y, p)
    raise ValueError(f"unknown metric {metric!r}")


def check_binary_labels(labels: list[float], metric: str, average: str = "binary") -> None:
    """The binary metrics need at most two label values with 1 among them."""
    if metric.lower() in BINARY_METRICS and average == "binary":
        distinct = sorted({float(v) for v in labels})
        if len(distinct) > 2:
            raise ValueError(f"{metric} is defined for two classes, got {len(distinct)}; use average='macro'")
        if distinct and POSITIVE not in distinct:
            raise ValueError(f"{metric} needs the positive label 1 among the labels, got {distinct}")


def all_metrics(preds: DataFrame, problem_type: str, by: list[str] | None = None, average: str = "binary") -> DataFrame:
    """Every metric of the problem kind, one row per group; ``average`` as in ``score``."""
    if average == "macro" and problem_type == "classification":
        return _macro(preds, by or []).select(*(by or []), *metrics_for(problem_type))
    aggregates = [metric_column(m).alias(m) for m in metrics_for(problem_type)]
    return preds.groupBy(*(by or [])).agg(*aggregates)


def score(
    preds: DataFrame,
    problem_type: str,
    metric: str | None = None,
    by: str | list[str] = "seed",
    average: str = "binary",
) -> DataFrame:
    """``(by, score)`` of predictions ``(by, label, prediction)``.

    ``average='macro'`` scores each class in turn as the positive one and takes
    the plain mean over classes seen in labels or predictions.
    """
    by = [by] if isinstance(by, str) else list(by)
    name = (metric or default_metric(problem_type)).lower()
    if name not in metrics_for(problem_type):
        raise ValueError(f"{name} is not a {problem_type} metric")
    if average == "macro" and name in BINARY_METRICS:
        return _macro(preds, by).select(*by, F.col(name).alias("score"))
    return preds.groupBy(*by).agg(metric_column(name).alias("score"))


def classification_metrics(preds: DataFrame, by: list[str], average: str = "binary") -> DataFrame:
    """Accuracy, precision, recall and f1 with ``average`` as in ``score``, Cohen's kappa and the Matthews coefficient.

    All come from one count per label and prediction, combined map-side. Kappa and
    Matthews cover any number of classes; both are 0 where they are not defined
    (a single class among labels and predictions, or all predictions alike).
    """
    each = _per_class(preds, by)

    def of_positive(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("cls") == F.lit(POSITIVE), F.col(name))), F.lit(0.0))

    hits, n = F.sum("tp"), F.sum("rows")
    by_chance = F.sum(F.col("rows") * F.col("said"))
    labels, said = F.sum(F.col("rows") * F.col("rows")), F.sum(F.col("said") * F.col("said"))
    above = hits * n - by_chance
    return each.groupBy(*by).agg(
        (hits / n).alias("accuracy"),
        *[(of_positive(m) if average == "binary" else F.avg(m)).alias(m) for m in BINARY_METRICS],
        _ratio_or_zero(above, n * n - by_chance).alias("kappa"),
        _ratio_or_zero(above, F.sqrt(n * n - said) * F.sqrt(n * n - labels)).alias("mcc"),
    )


def _per_class(preds: DataFrame, by: list[str]) -> DataFrame:
    """``(by, cls, tp, rows, said, precision, recall, f1)`` of each class seen in labels or predictions."""
    hit = F.col("label") == F.col("prediction")
    # One row per (prediction, class it touches): the pair table is as small as
    # classes squared after the first, map-side combined, aggregation.
    confusion = preds.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = confusion.select(
        *by,
        F.explode(
            F.when(hit, F.array(F.struct(F.col("label").alias("cls"), F.lit("tp").alias("side")))).otherwise(
                F.array(
                    F.struct(F.col("label").alias("cls"), F.lit("fn").alias("side")),
                    F.struct(F.col("prediction").alias("cls"), F.lit("fp").alias("side")),
                )
            )
        ).alias("e"),
        "n",
    ).select(*by, "e.cls", "e.side", "n")

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0.0))

    tp, fp, fn = total("tp"), total("fp"), total("fn")
    return sides.groupBy(*by, "cls").agg(
        tp.alias("tp"), (tp + fn).alias("rows"), (tp + fp).alias("said"),
        _ratio_or_zero(tp, tp + fp).alias("precision"),
        _ratio_or_zero(tp, tp + fn).alias("recall"),
        _ratio_or_zero(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
    )


def _macro(preds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, and the means over classes of precision, recall and f1."""
    return _per_class(preds, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("rows")).alias("accuracy"), *[F.avg(m).alias(m) for m in BINARY_METRICS]
    )
