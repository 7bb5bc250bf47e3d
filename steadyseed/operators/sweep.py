"""The seed sweep: split, fit, predict and score once per seed."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from steadyseed.config import TEST_SHARE, default_metric, metrics_for
from steadyseed.functions.inline import inline_rows
from steadyseed.functions.metrics import check_binary_labels, score
from steadyseed.operators import trees as level_trees
from steadyseed.operators.forest import (
    MAX_DEPTH,
    TREES,
    assemble,
    baseline_predictions,
    baseline_value,
    class_of,
    fit_predict,
    forest,
    target_column,
)
from steadyseed.operators.layout import fixed_layout, partitions_for
from steadyseed.operators.resample import adasyn
from steadyseed.operators.split import (
    RANKED_ROWS,
    assign_split,
    check_stratified,
    class_sizes,
    collect_cutoffs,
    hash_cutoffs,
    part_column,
    quotas,
)

SEEDS_PER_BATCH = 20
SCORES = {"seed": "int", "score": "double"}


def seed_results(spark, scores: dict[int, float]) -> DataFrame:
    """``(seed, score)`` rows; an analysis has at most 1000 seeds."""
    return inline_rows(spark, sorted(scores.items()), SCORES)


def baseline_sweep(
    df: DataFrame, row_id: str, label: str, problem_type: str, seeds: list[int], metric: str | None = None,
    stratify: bool | None = None, test_share: float = TEST_SHARE, average: str = "binary",
) -> DataFrame:
    """``(seed, score)`` of the majority class or mean predictor, all seeds in one query."""
    stratified = problem_type == "classification" if stratify is None else stratify
    table = df.select(row_id, label)
    split = assign_split(table, row_id, seeds, test_share, label if stratified else None)
    preds = baseline_predictions(split.withColumnRenamed(label, "label"), problem_type)
    return score(preds, problem_type, metric, "seed", average)


def seed_sweep(
    df: DataFrame,
    row_id: str,
    features: list[str],
    label: str,
    problem_type: str,
    seeds: list[int],
    metric: str | None = None,
    kind: str = "forest",
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    parallelism: int = 4,
    average: str = "binary",
    oversample_train: bool = False,
    test_share: float = TEST_SHARE,
    ranked_rows: int = RANKED_ROWS,
    bagging: bool = True,
    progress: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """``(seed, score)`` for every seed.

    The assembled rows are laid out and persisted once. A seed's two parts are
    comparisons of a hash with the cutoffs of that seed, so no row is shuffled or
    copied per seed. The forests of a batch of seeds grow together, one scan per
    level, and are scored in one query. ``kind="baseline"`` takes the mean or the
    majority class in place of a forest; it, and oversampled training parts, go
    seed by seed, ``parallelism`` at a time.

    ``progress`` is called with (seeds done, seeds in all) after each batch, or each
    seed that goes by itself.
    """
    metric = (metric or default_metric(problem_type)).lower()
    if metric not in metrics_for(problem_type):
        raise ValueError(f"{metric} is not a {problem_type} metric")
    spark = df.sparkSession
    stratify = "label" if problem_type == "classification" else None
    n = df.count()
    laid_out = fixed_layout(assemble(df, row_id, features, label), "row_id", n).persist()
    scores: dict[int, float] = {}
    together = kind != "baseline" and not oversample_train

    def all_of(batch: list[int], cutoffs: dict) -> dict[int, float]:
        member = F.array(*[part_column(seed, "row_id", stratify, cutoffs.get(seed, {}), 1) == 1 for seed in batch])
        rows = level_trees.prepared(laid_out.select("row_id", "label", "features", target_column(classes)), member, cuts).persist()
        growth = forest(len(classes or []), trees, max_depth, bagging=bagging)
        try:
            grown = level_trees.grow(rows, len(batch), max(len(cuts), 1), growth, partitions_for(n))
            preds = level_trees.predictions(rows, {"forest": level_trees.Model(growth, grown)})
            value = (lambda c: class_of(classes, F.col(c))) if classes else F.col
            seed = F.element_at(F.array(*[F.lit(s) for s in batch]), F.col("run") + 1)
            named = preds.select(seed.alias("seed"), value("y").alias("label"), value("prediction").alias("prediction"))
            return {r["seed"]: r["score"] for r in score(named, problem_type, metric, "seed", average).collect()}
        finally:
            rows.unpersist()

    def one(seed: int, cutoffs: dict) -> tuple[int, float]:
        part = part_column(seed, "row_id", stratify, cutoffs, 1)
        train, test = laid_out.where(part == 1), laid_out.where(part == 0)
        if oversample_train:
            train = _oversampled(train)
        if kind == "baseline":
            preds = test.select("label", baseline_value(train, problem_type).scalar().alias("prediction"))
        else:
            preds = fit_predict(train, test, problem_type, trees=trees, max_depth=max_depth, classes=classes, bagging=bagging)
        row = score(preds.withColumn("seed", F.lit(seed)), problem_type, metric, "seed", average).first()
        return seed, row["score"]

    try:
        sizes = class_sizes(laid_out, stratify)
        classes = list(sizes) if stratify else None
        if stratify:
            check_stratified(sizes)
            check_binary_labels(classes, metric, average)
        ranks = {c: [q] for c, q in quotas(sizes, test_share).items()}
        cuts = level_trees.cuts_of(laid_out, n=n) if together else []
        tell = progress or (lambda done, of: None)
        for start in range(0, len(seeds), SEEDS_PER_BATCH):
            batch = seeds[start:start + SEEDS_PER_BATCH]
            cutoffs = collect_cutoffs(hash_cutoffs(laid_out, "row_id", batch, ranks, stratify, ranked_rows, sizes))
            if together:
                scores.update(all_of(batch, cutoffs))
                tell(len(scores), len(seeds))
                continue
            with ThreadPool(max(1, min(parallelism, len(batch)))) as pool:
                task = inheritable_thread_target(spark)(lambda seed: one(seed, cutoffs.get(seed, {})))
                for seed, found in pool.imap_unordered(task, batch):
                    scores[seed] = found
                    tell(len(scores), len(seeds))
    finally:
        laid_out.unpersist()
    return seed_results(spark, scores)


def _oversampled(train: DataFrame) -> DataFrame:
    """ADASYN on the training part of one seed only."""
    width = train.select(F.size(vector_to_array("features")).alias("w")).first()["w"]
    names = [f"f{i}" for i in range(width)]
    flat = train.select("row_id", F.col("label").cast("bigint").alias("label"),
                        *[vector_to_array("features")[i].alias(n) for i, n in enumerate(names)])
    balanced, _ = adasyn(flat, "row_id", names, "label")
    return balanced.select("row_id", F.col("label").cast("double").alias("label"),
                           array_to_vector(F.array(*names)).alias("features"))
