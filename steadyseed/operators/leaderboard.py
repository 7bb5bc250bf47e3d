"""Comparison of model families at chosen seeds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from multiprocessing.pool import ThreadPool
import time

from pyspark import inheritable_thread_target
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.config import AGREEMENT_METRICS, METRIC_DISPLAY, default_metric, higher_is_better, metrics_for
from steadyseed.functions.inline import inline_rows
from steadyseed.functions.metrics import all_metrics, check_binary_labels, classification_metrics
from steadyseed.operators import descent, moments, trees as level_trees
from steadyseed.operators.encode import encode_features
from steadyseed.operators.forest import MAX_DEPTH, MODEL_SEED, assemble, class_of, forest, target_column
from steadyseed.operators.impute import impute_mean
from steadyseed.operators.layout import fixed_layout, partitions_for
from steadyseed.operators.split import class_sizes, collect_cutoffs, hash_cutoffs, part_column, quotas

# Share used for training, folds, models selected.
TRAIN_SHARE, FOLDS, SELECTED = 0.7, 10, 10
ROLES = ("Best", "Worst", "Most_Common")
TREES = 100


def pick_leaderboard_seeds(summary: DataFrame) -> DataFrame:
    """``(seed_role, seed)``: the best, the worst and the first modal seed."""
    roles = F.array(
        F.struct(F.lit("Best").alias("seed_role"), F.col("best_seed").alias("seed")),
        F.struct(F.lit("Worst").alias("seed_role"), F.col("worst_seed").alias("seed")),
        F.struct(F.lit("Most_Common").alias("seed_role"), F.element_at("common_seeds", 1).alias("seed")),
    )
    return summary.select(F.inline(roles))


def leaderboard_input(df: DataFrame, removals: list[str], target: str, row_id: str) -> tuple[DataFrame, list[str]]:
    """The raw table without removals, encoded and mean-filled by default; with its features.

    The target column must be a number by now (``index_target``, ``coerce_numeric_target``).
    """
    kept = df.drop(*[c for c in removals if c not in (row_id, target)])
    encoded = encode_features(kept, [row_id, target], row_id=row_id)
    filled, _ = impute_mean(encoded.table, encoded.numeric)
    return filled, [c for c in filled.columns if c not in (row_id, target)]


#: Families grown by ``trees``, all folds in the same scans.
TREE_FAMILIES = ("Decision Tree", "Random Forest", "Extra Trees", "Gradient Boosting", "Ada Boost")


def families(problem_type: str, features: int, classes: int, seed: int = 1) -> dict:
    """Name to estimator, with its settings, of the families that ``descent`` learns."""
    y = {"labelCol": "__y"}
    if problem_type != "classification":
        return {"Factorization Machine": mlr.FMRegressor(seed=seed, **y)}
    logistic = mlc.LogisticRegression(**y)
    # A little regularisation and a bound on its steps: without them the hinge loss has no single
    # minimum, and its line search goes on failing until the last of a hundred steps.
    svc = mlc.LinearSVC(regParam=1e-4, maxIter=50, tol=1e-4, **y)
    found = {
        "Logistic Regression": logistic,
        "Linear SVC": mlc.OneVsRest(classifier=svc, **y) if classes > 2 else svc,
        "One vs Rest Logistic": mlc.OneVsRest(classifier=logistic, **y),
        "Multilayer Perceptron": mlc.MultilayerPerceptronClassifier(
            layers=[features, max(4, (features + classes) // 2), classes], seed=seed, maxIter=50, **y),
    }
    if classes == 2:
        found["Factorization Machine"] = mlc.FMClassifier(seed=seed, **y)
    return found


def tree_families(problem_type: str, classes: int) -> list[str]:
    kind = "Classifier" if problem_type == "classification" else "Regressor"
    known = [f"{n} {kind}" for n in TREE_FAMILIES]
    # gradient boosting here knows two classes, reweighted stumps know classes only
    left_out = "Ada Boost Regressor" if problem_type != "classification" else "Gradient Boosting Classifier" if classes != 2 else None
    return [n for n in known if n != left_out]


def _grown(name: str, cells: DataFrame, values: DataFrame, folds: int, width: int, classes: int, trees: int, partitions: int, seed: int) -> level_trees.Model:
    """One family of trees for all folds; ``values`` are the rows with features that are not cut into bins."""
    plain = level_trees.Growth(1, MAX_DEPTH, classes, seed=seed)
    if name.startswith("Gradient"):
        return level_trees.gradient_boosting(cells, folds, width, plain, partitions)
    if name.startswith("Ada"):
        return level_trees.reweighted_stumps(cells, folds, width, classes, partitions)
    growth = plain
    if name.startswith("Random"):
        growth = forest(classes, trees, MAX_DEPTH, seed)
    elif name.startswith("Extra"):
        growth = replace(forest(classes, trees, MAX_DEPTH, seed, bagging=False), drawn=True)
    return level_trees.Model(growth, level_trees.grow(values if growth.drawn else cells, folds, width, growth, partitions))


def _fold_ranks(sizes: dict, folds: int) -> dict:
    """Per class: the last rank of the test part, then of every fold but the last."""
    ranks = {}
    for c, held_out in quotas(sizes, 1.0 - TRAIN_SHARE).items():
        training = sizes[c] - held_out
        ranks[c] = [held_out] + [held_out + training * f // folds for f in range(1, folds)]
    return ranks


def compare_models(
    df: DataFrame,
    row_id: str,
    features: list[str],
    label: str,
    problem_type: str,
    seed: int,
    metric: str | None = None,
    models: list[str] | None = None,
    folds: int = FOLDS,
    trees: int = TREES,
    parallelism: int = 8,
    average: str | None = None,
) -> DataFrame:
    """``(model, metric columns, seconds, error)``, best first by the metric.

    ``average`` is that of precision, recall and f1; without it two classes are
    scored as binary if 1 is one of them, others as macro.

    Families are cross-validated on the 70 % training part of the seed's split;
    part and folds are ranges of the seed's hash ranking, so they need no shuffle.
    Linear families and discriminants learn from one scan for all folds
    (``moments``), trees from one scan per level for all folds (``trees``), the families of
    ``descent`` from one scan per step for all folds; any other is fitted fold by fold. All of these share one pool of
    ``parallelism`` threads, so the slowest family does not wait for others. ``seconds`` is the time
    from a family's first step to its last; those learned together share it. A
    family that fails gives a row with its error.
    """
    metric = (metric or default_metric(problem_type)).lower()
    found = _compared(df, row_id, features, label, problem_type, [seed], models, folds, trees, parallelism, average)
    order = F.col(metric).desc_nulls_last() if higher_is_better(metric) else F.col(metric).asc_nulls_last()
    return found.drop("seed").orderBy(order, "model")


def _compared(
    df: DataFrame, row_id: str, features: list[str], label: str, problem_type: str, seeds: list[int], models: list[str] | None,
    folds: int, trees: int, parallelism: int, average: str | None,
) -> DataFrame:
    """``compare_models`` for all seeds at once, with ``seed``: fold f of the k-th seed is part k * folds + f."""
    spark = df.sparkSession
    stratify = "label" if problem_type == "classification" else None
    n = df.count()
    laid_out = fixed_layout(assemble(df, row_id, features, label), "row_id", n).persist()
    sizes = class_sizes(laid_out, stratify)
    classes = list(sizes) if stratify else []
    ranks = _fold_ranks(sizes, folds)
    cutoffs = collect_cutoffs(hash_cutoffs(laid_out, "row_id", seeds, ranks, stratify, sizes=sizes))
    local = F.array(*[part_column(s, "row_id", stratify, cutoffs.get(s, {}), folds) for s in seeds])
    rows = laid_out.select("row_id", "label", target_column(classes), "features", local.alias("parts")).persist()
    if average is None:
        average = "binary" if not stratify or len(classes) <= 2 and 1 in classes else "macro"
    names = list(metrics_for(problem_type))
    for name in names:
        check_binary_labels(classes, name, average)
    names += AGREEMENT_METRICS if stratify else ()
    width, partitions, parts = len(rows.select("features").first()["features"]), partitions_for(n), len(seeds) * folds
    everywhere = F.posexplode("parts").alias("at", "local")
    training = rows.select("label", "features", everywhere).where(F.col("local") > 0).select(
        "label", "features", (F.col("at") * folds + F.col("local")).alias("part")
    )
    by_fold = families(problem_type, width, len(classes))
    from_moments = list(moments.families(problem_type))

    def wanted(known) -> list[str]:
        return [x for x in known if models is None or x in models]

    grown, fitted, learned = wanted(tree_families(problem_type, len(classes))), wanted(by_fold), wanted(from_moments)
    totals: dict[tuple, dict] = {}
    errors: dict[str, str] = {}
    times: dict[str, list[float]] = {}

    def step(own: list[str], work: Callable[[], None]) -> None:
        """One piece of work for the families ``own``: keeps its time, and an error if it fails."""
        started = time.monotonic()
        try:
            work()
        except Exception as error:  # one family failing must not end the comparison
            errors.update(dict.fromkeys(own, str(error) or repr(error)))
        for name in own:
            span = times.setdefault(name, [started, started])
            span[0], span[1] = min(span[0], started), max(span[1], time.monotonic())

    def value(name: str) -> Column:
        return class_of(classes, F.col(name)) if classes else F.col(name)

    def by_part(scored: DataFrame) -> DataFrame:
        return _metrics(scored, problem_type, ["part", "model"], average)

    def keep_means(each: DataFrame) -> None:
        group = F.floor((F.col("part") - 1) / folds).cast("int").alias("at")
        for r in each.groupBy("model", group).agg(*[F.avg(m).alias(m) for m in names]).collect():
            totals[r["model"], r["at"]] = {m: r[m] for m in names}

    def keep(scored: DataFrame) -> None:
        """Means over the folds of (part, model, label, prediction)."""
        keep_means(by_part(scored))

    def by_moments() -> None:
        pieces = moments.parts_at_once(width, len(seeds), folds, len(classes))
        if len(pieces) == 1:
            found, failed = moments.fit_folds(training, problem_type, learned, partitions, folds)
            errors.update(failed)
            if found:
                keep(moments.predictions(training, found))
            return
        each = []
        for own in pieces:
            found, failed = moments.fit_folds(training, problem_type, learned, partitions, folds, own)
            errors.update(failed)
            if found:
                scored = by_part(moments.predictions(training.where(F.col("part").isin(own)), found))
                each += scored.select("part", "model", *names).collect()
        if each:
            keep_means(inline_rows(spark, [tuple(r) for r in each], {"part": "int", "model": "string", **{m: "double" for m in names}}))

    def by_trees(name: str) -> None:
        model = _grown(name, cells, values, parts, max(width, 1), len(classes), trees, partitions, MODEL_SEED)
        scored = level_trees.predictions(values if name.startswith("Extra") else cells, {name: model})
        keep(scored.select((F.col("run") + 1).alias("part"), "model", value("y").alias("label"), value("prediction").alias("prediction")))

    def by_baseline() -> None:
        keep(_baseline(training, problem_type, folds, parts).withColumn("model", F.lit("Baseline")))

    together, single = [x for x in fitted if x in descent.FAMILIES], [x for x in fitted if x not in descent.FAMILIES]

    def by_descent() -> None:
        found, failed = descent.fit_folds(rows, {name: by_fold[name] for name in together}, folds, parts, len(classes), partitions)
        errors.update(failed)
        if found:
            keep(moments.predictions(training, found, descent.predict).withColumn("prediction", value("prediction")))

    each_fold: dict[tuple, list] = {(name, at): [] for name in single for at in range(len(seeds))}

    def by_estimator(name: str, at: int, fold: int) -> None:
        if name in errors:
            return
        own = rows.withColumn("part", F.col("parts")[at])
        learn, check = own.where((F.col("part") > 0) & (F.col("part") != fold)), own.where(F.col("part") == fold)
        prediction = by_fold[name].copy().fit(learn).transform(check)
        each_fold[name, at].append(
            _metrics(prediction.select("label", value("prediction").alias("prediction")), problem_type, [], average).first()
        )

    tasks = [([name], lambda name=name: by_trees(name)) for name in reversed(grown)]
    tasks[:0] = [(together, by_descent)] if together else []
    tasks += [
        ([name], lambda name=name, at=at, fold=fold: by_estimator(name, at, fold)) for name, at in each_fold for fold in range(1, folds + 1)
    ]
    tasks += [(learned, by_moments)] if learned else []
    tasks += [(["Baseline"], by_baseline)] if wanted(["Baseline"]) else []
    held = [rows, laid_out]
    try:
        if grown:
            member = F.array(*[
                F.when(F.col("parts")[at] == f, level_trees.ASKED).when(F.col("parts")[at] > 0, level_trees.LEARNED).otherwise(-1)
                for at in range(len(seeds)) for f in range(1, folds + 1)
            ])
            cells = level_trees.prepared(rows, member, level_trees.cuts_of(rows, n=n)).persist()
            values = level_trees.prepared(rows, member, None)
            held.insert(0, cells)
        with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
            pool.map(inheritable_thread_target(spark)(lambda task: step(*task)), tasks, chunksize=1)
    finally:
        for table in held:
            table.unpersist()
    for key, scored in each_fold.items():
        if scored and key[0] not in errors:
            totals[key] = {m: sum(r[m] for r in scored) / folds for m in names}
    found = [
        (seed, name, *[totals[name, at][m] if (name, at) in totals and name not in errors else None for m in names], span[1] - span[0], errors.get(name))
        for at, seed in enumerate(seeds) for name, span in sorted(times.items())
    ]
    schema = {"seed": "int", "model": "string", **{m: "double" for m in names}, "seconds": "double", "error": "string"}
    return inline_rows(spark, found, schema)


def _metrics(preds: DataFrame, problem_type: str, by: list[str], average: str) -> DataFrame:
    """The columns of a comparison: all metrics, and for classes kappa and Matthews from the same counts."""
    if problem_type == "classification":
        return classification_metrics(preds, by, average)
    return all_metrics(preds, problem_type, by, average)


def _baseline(training: DataFrame, problem_type: str, folds: int, parts: int) -> DataFrame:
    """``(part, label, prediction)``: the majority class or the mean of the other folds, from one count per part."""
    counts = training.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")) if problem_type == "classification" else (
        training.groupBy("part").agg(F.sum("label").alias("label"), F.count(F.lit(1)).alias("n")))
    group = lambda c: F.floor((F.col(c) - 1) / folds)
    others = counts.select("*", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("fold"))
    others = others.where((F.col("part") != F.col("fold")) & (group("part") == group("fold")))
    if problem_type == "classification":
        others = others.groupBy("fold", "label").agg(F.sum("n").alias("n"))
        guess = F.max_by("label", F.struct("n", -F.col("label").cast("double"))).cast("double")
    else:
        guess = F.sum("label") / F.sum("n")
    # one row per fold
    guesses = F.broadcast(others.groupBy("fold").agg(guess.alias("prediction")).withColumnRenamed("fold", "part"))
    return training.select("part", F.col("label").cast("double").alias("label")).join(guesses, "part")


def compare_models_for_seeds(
    df: DataFrame, row_id: str, features: list[str], label: str, problem_type: str, roles: DataFrame, models: list[str] | None = None,
    folds: int = FOLDS, trees: int = TREES, parallelism: int = 8, average: str | None = None,
) -> DataFrame:
    """``compare_models`` for each role of ``pick_leaderboard_seeds``, with ``seed_role`` and ``seed``.

    All seeds are compared at once, those of several roles once.
    """
    wanted = [(r["seed_role"], r["seed"]) for r in roles.collect()]
    found = _compared(df, row_id, features, label, problem_type, sorted({s for _, s in wanted}), models, folds, trees, parallelism, average)
    named = inline_rows(df.sparkSession, wanted, {"seed_role": "string", "seed": "int"})
    return named.join(found, "seed").select("seed_role", "seed", *[c for c in found.columns if c != "seed"])


def rank_leaderboard(leaderboard: DataFrame, metric: str, selected: int = SELECTED) -> DataFrame:
    """Metrics under their display names, ``rank`` per role in the metric's direction, and ``selected``."""
    metric = metric.lower()
    order = F.col(metric).desc_nulls_last() if higher_is_better(metric) else F.col(metric).asc_nulls_last()
    place = F.row_number().over(Window.partitionBy("seed_role").orderBy(order, "model"))
    ranked = leaderboard.withColumn("rank", place).withColumn("selected", F.col("rank") <= selected)
    return ranked.withColumnsRenamed({m: shown for m, shown in METRIC_DISPLAY.items() if m in leaderboard.columns})


def top_models(ranked: DataFrame, n: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= n)
