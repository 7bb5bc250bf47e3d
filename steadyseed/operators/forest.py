"""Random forests and the baseline predictor."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from steadyseed.functions.columns import col
from steadyseed.operators import trees as level_trees
from steadyseed.operators.layout import fixed_layout, partitions_for

# Size and seed of the forest whose split sensitivity is measured.
TREES, MODEL_SEED, MAX_DEPTH = 100, 1, 5


def assemble(df: DataFrame, row_id: str, features: list[str], label: str) -> DataFrame:
    """``(row_id, label, features)`` with one vector; numbers, number arrays and vectors are taken."""
    inputs, parts = [], []
    for i, name in enumerate(features):
        is_array = isinstance(df.schema[name].dataType, T.ArrayType)
        parts.append((array_to_vector(col(name)) if is_array else col(name)).alias(f"__f{i}"))
        inputs.append(f"__f{i}")
    plain = df.select(col(row_id).alias("row_id"), col(label).cast("double").alias("label"), *parts)
    if not inputs:
        return plain.withColumn("features", array_to_vector(F.array().cast("array<double>"))).select("row_id", "label", "features")
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(plain).select("row_id", "label", "features")


def index_of(classes: list, column: Column) -> Column:
    """Position of a label among the sorted classes, as the fits need 0..k-1."""
    if [float(c) for c in classes] == [float(i) for i in range(len(classes))]:
        return column
    pairs = [p for i, c in enumerate(classes) for p in (F.lit(float(c)), F.lit(float(i)))]
    return F.element_at(F.create_map(*pairs), column)


def target_column(classes: list | None) -> Column:
    """The label as a fit wants it; naming the number of classes spares each fit a pass to find it."""
    if not classes:
        return F.col("label").alias("__y")
    kind = {"ml_attr": {"type": "nominal", "num_vals": len(classes)}}
    return index_of(classes, F.col("label")).alias("__y", metadata=kind)


def class_of(classes: list, column: Column) -> Column:
    if [float(c) for c in classes] == [float(i) for i in range(len(classes))]:
        return column
    return F.element_at(F.array(*[F.lit(float(c)) for c in classes]), column.cast("int") + 1)


def forest(classes: int, trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = MODEL_SEED, bagging: bool = True) -> level_trees.Growth:
    """A forest of so many classes (0: a regression): square root of the features per node, or all."""
    return level_trees.Growth(trees, max_depth, classes, bagging, "sqrt" if classes else "all", seed=seed)


def fit_predict(
    train: DataFrame,
    test: DataFrame,
    problem_type: str,
    kind: str = "forest",
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = MODEL_SEED,
    classes: list | None = None,
    bagging: bool = True,
) -> DataFrame:
    """``(row_id, label, prediction)`` of the test rows; inputs are ``assemble``d rows."""
    if kind == "baseline":
        value = baseline_value(train, problem_type).scalar()
        return test.select("row_id", "label", value.alias("prediction"))
    if problem_type == "classification" and classes is None:
        classes = sorted(r["label"] for r in train.select("label").distinct().collect())
    indexed = train.select("row_id", "label", "features", target_column(classes))
    n = indexed.count()
    laid_out = fixed_layout(indexed, "row_id", n).persist()
    held = [laid_out]
    try:
        cuts = level_trees.cuts_of(laid_out, n=n)
        # held, so that not every level cuts the rows into bins again
        known = level_trees.prepared(laid_out, F.array(F.lit(True)), cuts).persist()
        held.insert(0, known)
        growth = forest(len(classes or []), trees, max_depth, seed, bagging)
        model = level_trees.Model(growth, level_trees.grow(known, 1, max(len(cuts), 1), growth, partitions_for(n)))
    finally:
        for table in held:
            table.unpersist()
    unseen = test.select("row_id", "features", F.col("label").cast("double").alias("__y"))
    asked = level_trees.prepared(unseen, F.array(F.lit(False)), cuts)
    found = level_trees.predictions(asked, {"forest": model}, with_ids=True)
    prediction = class_of(classes, F.col("prediction")) if classes else F.col("prediction")
    return found.select("row_id", F.col("y").alias("label"), prediction.alias("prediction"))


def baseline_value(train: DataFrame, problem_type: str, by: list[str] | None = None) -> DataFrame:
    """``(by, prediction)``: the majority class (ties: smaller label) or the mean of the training labels."""
    by = by or []
    if problem_type == "classification":
        counts = train.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
        best = F.max_by("label", F.struct("n", -F.col("label").cast("double"))).cast("double")
        return counts.groupBy(*by).agg(best.alias("prediction"))
    return train.groupBy(*by).agg(F.avg(F.col("label").cast("double")).alias("prediction"))


def baseline_predictions(split: DataFrame, problem_type: str) -> DataFrame:
    """``(seed, label, prediction)`` for the test rows of ``(seed, label, is_test)``.

    The predictor is one row per seed, of which an analysis has at most 1000.
    """
    learned = baseline_value(split.where(~F.col("is_test")), problem_type, ["seed"])
    return split.where("is_test").join(F.broadcast(learned), "seed").select(
        "seed", F.col("label").cast("double").alias("label"), "prediction"
    )
