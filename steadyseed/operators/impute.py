"""Imputation of missing feature values."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyseed.config import ensure_checkpoint_dir
from steadyseed.functions.columns import col
from steadyseed.operators import trees as level_trees
from steadyseed.operators.layout import fixed_layout, partitions_for

# Rounds, trees, seed and tolerance of the round-robin imputation.
MAX_ITER, TREES, SEED, TOLERANCE = 10, 10, 1, 1e-3
DEPTH = 5
ESTIMATORS = ("extra", "forest", "linear")


def _gap_statistics(df: DataFrame, features: list[str]) -> dict[str, tuple[int, float | None, float]]:
    """Missing count, mean and largest magnitude per feature, in one pass."""
    if not features:
        return {}
    row = df.agg(*[
        a for i, c in enumerate(features) for a in (
            F.count_if(col(c).isNull()).alias(f"m{i}"),
            F.avg(col(c)).alias(f"a{i}"),
            F.max(F.abs(col(c))).alias(f"x{i}"),
        )
    ]).first()
    return {c: (row[f"m{i}"], row[f"a{i}"], row[f"x{i}"] or 0.0) for i, c in enumerate(features)}


def _all_missing_findings(stats: dict) -> tuple[list[str], list[tuple]]:
    empty = [c for c, (m, mean, _) in stats.items() if m > 0 and mean is None]
    return empty, [("warning", "empty_feature", c, f"Column '{c}' holds no value; it is left out") for c in empty]


def impute_mean(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[tuple]]:
    """Missing values of each incomplete feature become its mean; empty features are dropped with a finding."""
    stats = _gap_statistics(df, features)
    empty, found = _all_missing_findings(stats)
    filled = {c: F.coalesce(col(c), F.lit(mean)) for c, (m, mean, _) in stats.items() if m > 0 and c not in empty}
    return (df.withColumns(filled) if filled else df).drop(*empty), found


def impute_iterative(
    df: DataFrame,
    features: list[str],
    row_id: str,
    max_iter: int = MAX_ITER,
    trees: int = TREES,
    seed: int = SEED,
    estimator: str = "extra",
    predictors: str = "incomplete",
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, list[tuple]]:
    """Round-robin regression imputation of the incomplete features.

    Starting from means, each round predicts the missing values of every
    incomplete feature, fewest gaps first, from the other incomplete features
    (or from all features with ``predictors='all'``), until no value moves by
    more than ``tolerance`` times the largest observed magnitude. The regression is
    one of extremely randomised trees (``extra``), a random ``forest`` or a
    ``linear`` one; observed values stay as they are. Each round is
    checkpointed in the shared folder, and the one before it is removed there. A lone incomplete feature without other
    predictors keeps its mean.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}, got {estimator!r}")
    stats = _gap_statistics(df, features)
    empty, found = _all_missing_findings(stats)
    df = df.drop(*empty)
    incomplete = sorted([c for c, (m, _, _) in stats.items() if m > 0 and c not in empty], key=lambda c: (stats[c][0], features.index(c)))
    usable = [c for c in features if c not in empty]
    basis = usable if predictors == "all" else incomplete
    if not incomplete or len(basis) < 2:
        filled, _ = impute_mean(df, usable)
        return filled, found
    ensure_checkpoint_dir(df.sparkSession)
    flags = {c: f"__gap{i}" for i, c in enumerate(incomplete)}
    current = df.withColumns({flags[c]: col(c).isNull() for c in incomplete}).withColumns(
        {c: F.coalesce(col(c), F.lit(stats[c][1])) for c in incomplete}
    )
    n = df.count()
    current = fixed_layout(current, row_id, n).checkpoint()
    kept = _checkpoint_file(current)
    limit = tolerance * max(stats[c][2] for c in incomplete)
    for _ in range(max_iter):
        start = {c: f"__was{i}" for i, c in enumerate(incomplete)}
        moved = current.withColumns({start[c]: col(c) for c in incomplete})
        held: list[DataFrame] = []
        for c in incomplete:
            others = [p for p in basis if p != c]
            # held while the next fit reads it, so that a fit does not repeat the predictions of those before it
            moved = _predict_gaps(moved, c, others, flags[c], estimator, trees, seed, row_id, partitions_for(n), n - stats[c][0]).persist()
            held.append(moved)
            if len(held) > 2:
                held.pop(0).unpersist()
        moved = moved.checkpoint()
        for step in held:
            step.unpersist()
        # nothing reads the round before any more, and ten of them would be ten times the table
        _remove(df.sparkSession, kept)
        kept = _checkpoint_file(moved)
        change = moved.agg(
            F.greatest(*[F.max(F.abs(col(c) - F.col(start[c]))) for c in incomplete], F.lit(0.0)).alias("d")
        ).first()["d"]
        current = moved.drop(*start.values())
        if change < limit:
            break
    return current.drop(*flags.values()), found


def _checkpoint_file(df: DataFrame) -> str:
    """Where the rows of a DataFrame are that has just been checkpointed."""
    return df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def _number(column: str) -> Column:
    """A predictor's value; one that is missing or not a number is an error."""
    value = col(column).cast("double")
    wrong = F.raise_error(F.lit(f"Column '{column}' holds a value that is missing or not a number"))
    return F.when(value.isNull() | F.isnan(value), wrong.cast("double")).otherwise(value)


def _predict_gaps(
    df: DataFrame, column: str, others: list[str], flag: str, estimator: str, trees: int, seed: int, row_id: str, partitions: int, n_observed: int
) -> DataFrame:
    observed = df.where(~F.col(flag))
    if estimator == "linear" and len(others) == 1:
        line = observed.agg(
            F.regr_slope(col(column), col(others[0])).alias("slope"), F.avg(col(column)).alias("y"), F.avg(col(others[0])).alias("x")
        ).first()
        slope = line["slope"] or 0.0
        guess = F.lit(line["y"]) + F.lit(slope) * (col(others[0]) - F.lit(line["x"]))
        return df.withColumn(column, F.when(F.col(flag), guess).otherwise(col(column)))
    if estimator == "linear":
        safe = {name: f"__p{i}" for i, name in enumerate(others)}
        assembler = VectorAssembler(inputCols=list(safe.values()), outputCol="__vector")
        vectors = assembler.transform(df.withColumns({s: col(n) for n, s in safe.items()}).withColumn("__target", col(column)))
        model = LinearRegression(featuresCol="__vector", labelCol="__target", predictionCol="__guess", solver="normal")
        predicted = model.fit(vectors.where(~F.col(flag))).transform(vectors)
    else:
        drawn = estimator == "extra"
        growth = level_trees.Growth(trees, DEPTH, 0, not drawn, "all", drawn, seed)
        values = F.array(*[_number(name) for name in others])
        known = observed.select(col(row_id).alias("row_id"), values.alias("features"), col(column).alias("__y"))
        cuts = None if drawn else level_trees.cuts_of(known, n=n_observed)
        rows = level_trees.prepared(known, F.array(F.lit(level_trees.LEARNED)), cuts)
        if not drawn:
            rows = rows.persist()
        model = level_trees.Model(growth, level_trees.grow(rows, 1, len(others), growth, partitions))
        rows.unpersist()
        predicted = df.withColumn("__guess", level_trees.guess(df.sparkSession, model, cuts, values, needed=F.col(flag)))
    value = F.when(F.col(flag), F.col("__guess")).otherwise(col(column))
    return predicted.withColumn(column, value).select(*[col(c) for c in df.columns])
