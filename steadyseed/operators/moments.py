"""Model families that need no more of the rows than counts, means and scatter matrices.

One scan gives a mergeable moment matrix per fold (and class). What a model of fold f
learns from is the total less that fold, so all folds of all these families come from
the same scan, and a second one scores them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

# Cells of the matrices of one scan, over its folds and classes: more folds take more scans.
MOST_CELLS = 20_000_000
# Floor of variances of scaled features; what naive Bayes adds to all variances, as a share of the largest.
LEAST_VARIANCE = 1e-9

Moments = tuple[float, np.ndarray, np.ndarray]  # rows, mean, scatter around the mean


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of the rows of both."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def without(total: Moments, part: Moments) -> Moments:
    """The moments of the rows of ``total`` that are not in ``part``."""
    n = total[0] - part[0]
    if not part[0] or n <= 0:
        return total if not part[0] else (0.0, np.zeros_like(total[1]), np.zeros_like(total[2]))
    mean = (total[1] * total[0] - part[1] * part[0]) / n
    step = part[1] - mean
    return n, mean, total[2] - part[2] - np.outer(step, step) * (n * part[0] / total[0])


def _of(values: np.ndarray) -> Moments:
    mean = values.mean(axis=0)
    centred = values - mean
    return float(len(values)), mean, centred.T @ centred


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of numbers as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


FIELDS = [("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))]


def _row(key: tuple, names: list[str], deal: int, m: Moments) -> pa.RecordBatch:
    schema = pa.schema([(n, pa.float64()) for n in names] + [("deal", pa.int32()), *FIELDS])
    values = dict(zip(names, key, strict=True)) | {"deal": deal, "n": m[0], "mean": m[1].tolist(), "scatter": m[2].ravel().tolist()}
    return pa.RecordBatch.from_pylist([values], schema)


def _partial(names: list[str], deals: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix_of(batch.column("values"))
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                key = tuple(float(c[start]) for c in columns)
                own = _of(values[order[start:end]])
                known = found.get(key)
                found[key] = merged(known, own) if known else own
        deal = TaskContext.get().partitionId() % deals
        for key, m in found.items():
            yield _row(key, names, deal, m)

    return run


def _moments_of(row: dict) -> Moments:
    mean = np.array(row["mean"])
    return row["n"], mean, np.array(row["scatter"]).reshape(len(mean), len(mean))


def _sum(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        total, key = None, None
        # in one order, so that sums come out alike in every run
        for at in table.sort_by([("deal", "ascending"), ("n", "ascending")]).to_batches():
            for i in range(at.num_rows):
                row = at.slice(i, 1).to_pylist()[0]
                total, key = merged(total, _moments_of(row)) if total else _moments_of(row), row
        return pa.Table.from_batches([_row(tuple(key[n] for n in names), names, key["deal"], total)])

    return run


def moments(rows: DataFrame, names: list[str], partitions: int) -> DataFrame:
    """(names, deal, n, mean, scatter) of the array column ``values`` per key; keys are doubles.

    Each task adds up its rows; its matrices are added in two steps, the first by
    about the square root of the number of ``partitions``, so that no task reads
    more than that many matrices of a key.
    """
    deals = max(1, math.isqrt(partitions))
    schema = ", ".join([*[f"{n} double" for n in names], "deal int, n double, mean array<double>, scatter array<double>"])
    part = rows.select(*[F.col(n).cast("double").alias(n) for n in names], "values").mapInArrow(_partial(names, deals), schema)
    if deals > 1:
        part = part.groupBy(*names, "deal").applyInArrow(_sum(names), schema)
    return part.groupBy(*names).applyInArrow(_sum(names), schema)


# --- what is learned from moments ----------------------------------------------


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(correlations of features, with the label, deviations, deviation of the label); the label is the last value."""
    n, _, scatter = m
    deviation = np.sqrt(np.maximum(np.diag(scatter) / n, 0.0))
    deviation[deviation < 1e-12 * max(1.0, float(np.abs(m[1]).max()))] = 0.0
    scale = np.where(deviation > 0, deviation, np.inf)
    c = scatter / n / np.outer(scale, scale)
    return c[:-1, :-1], c[:-1, -1], deviation[:-1], float(deviation[-1])


def _line(m: Moments, beta: np.ndarray, deviation: np.ndarray, own: float) -> dict:
    """Coefficients and intercept from those of standardised columns."""
    coefficients = np.divide(beta * own, deviation, out=np.zeros_like(beta), where=deviation > 0)
    return {"coefficients": coefficients, "intercept": float(m[1][-1] - coefficients @ m[1][:-1])}


def least_squares(m: Moments) -> dict:
    a, b, deviation, own = _standardised(m)
    return _line(m, np.linalg.lstsq(a, b, rcond=1e-12)[0], deviation, own)


def elastic_net(m: Moments, penalty: float, share: float, tolerance: float = 1e-10, rounds: int = 100_000) -> dict:
    """Coordinate descent on correlations; ``penalty`` in the label's units, ``share`` of it on absolute values."""
    a, b, deviation, own = _standardised(m)
    if not own:
        return _line(m, np.zeros_like(b), deviation, own)
    absolute, square = penalty / own * share, penalty / own * (1 - share)
    used = np.flatnonzero(deviation > 0)
    beta = np.zeros_like(b)
    if not share:
        beta[used] = np.linalg.solve(a[np.ix_(used, used)] + square * np.eye(len(used)), b[used])
        return _line(m, beta, deviation, own)
    left = b.copy()  # b - a @ beta
    for _ in range(rounds):
        moved = 0.0
        for j in used:
            pull = left[j] + beta[j]
            new = math.copysign(max(abs(pull) - absolute, 0.0), pull) / (1.0 + square)
            if new != beta[j]:
                left -= a[:, j] * (new - beta[j])
                moved, beta[j] = max(moved, abs(new - beta[j])), new
        if moved < tolerance:
            break
    return _line(m, beta, deviation, own)


def bayesian_ridge(m: Moments, rounds: int = 300, tolerance: float = 1e-6, prior: float = 1e-6) -> dict:
    """Ridge whose penalty is the ratio of the precisions of noise and weights, both found by their evidence."""
    a, b, deviation, own = _standardised(m)
    n = m[0]
    values, vectors = np.linalg.eigh(a * n)
    values, turned = np.maximum(values, 0.0), vectors.T @ (b * n)
    noise, weight, beta = 1.0, 1.0, np.zeros_like(b)
    for _ in range(rounds):
        new = vectors @ (turned / (values + weight / noise))
        sse = max(n - 2 * new @ (b * n) + new @ (a * n) @ new, 0.0)
        known = float(np.sum(noise * values / (weight + noise * values)))
        weight = (known + 2 * prior) / (float(new @ new) + 2 * prior)
        noise = (n - known + 2 * prior) / (sse + 2 * prior)
        moved, beta = float(np.abs(new - beta).sum()), new
        if moved < tolerance:
            break
    return _line(m, beta, deviation, own)


def matching_pursuit(m: Moments, share: float = 0.1) -> dict:
    """Least squares on the features that explain most, one after the other, up to ``share`` of all features (one at least)."""
    a, b, deviation, own = _standardised(m)
    chosen: list[int] = []
    beta = np.zeros_like(b)
    for _ in range(max(1, int(len(b) * share))):
        left = np.abs(b - a @ beta)
        left[[*chosen, *np.flatnonzero(deviation == 0)]] = -1.0
        if not len(left) or left.max() <= 1e-12:
            break
        chosen.append(int(left.argmax()))
        beta = np.zeros_like(b)
        beta[chosen] = np.linalg.lstsq(a[np.ix_(chosen, chosen)], b[chosen], rcond=1e-12)[0]
    return _line(m, beta, deviation, own)


#: Families of a regression: from the moments of features and label.
REGRESSION: dict[str, Callable[[Moments], dict]] = {
    "Linear Regression": least_squares,
    "Ridge Regression": lambda m: elastic_net(m, 1.0, 0.0),
    "Lasso Regression": lambda m: elastic_net(m, 1.0, 1.0),
    "Elastic Net": lambda m: elastic_net(m, 1.0, 0.5),
    "Generalized Linear Regression": least_squares,
    "Bayesian Ridge": bayesian_ridge,
    "Orthogonal Matching Pursuit": matching_pursuit,
}

ByClass = dict[float, Moments]


def _whole(classes: ByClass) -> Moments:
    total = None
    for m in classes.values():
        total = merged(total, m) if total else m
    return total


def _least(classes: ByClass) -> float:
    n, _, scatter = _whole(classes)
    return LEAST_VARIANCE * max(float((np.diag(scatter) / n).max(initial=0.0)), 1e-300)


def _priors(classes: ByClass) -> np.ndarray:
    sizes = np.array([m[0] for m in classes.values()])
    return np.log(sizes / sizes.sum())


def _densities(classes: ByClass, covariances: list[np.ndarray]) -> dict:
    """Log densities of normal distributions up to a constant: whitening matrices and what is added.

    Features are scaled by their deviations first, so that a small unit is not taken for no variance.
    """
    n, _, scatter = _whole(classes)
    scale = np.sqrt(np.diag(scatter) / n)
    scale[scale == 0] = 1.0
    white, added = [], []
    for covariance, prior in zip(covariances, _priors(classes), strict=True):
        values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
        values = np.maximum(values, LEAST_VARIANCE)
        white.append(vectors / scale[:, None] / np.sqrt(values))
        added.append(prior - 0.5 * np.log(values).sum())
    return {"classes": list(classes), "means": [m[1] for m in classes.values()], "white": white, "added": added}


def naive_bayes(classes: ByClass) -> dict:
    """Variances are smoothed by a share of the largest one, whatever the units."""
    return _densities(classes, [np.diag(np.diag(m[2]) / m[0] + _least(classes)) for m in classes.values()])


def linear_discriminant(classes: ByClass) -> dict:
    rows = sum(m[0] for m in classes.values()) - len(classes)
    pooled = sum(m[2] for m in classes.values()) / max(rows, 1.0)
    return _densities(classes, [pooled] * len(classes))


def quadratic_discriminant(classes: ByClass) -> dict:
    return _densities(classes, [m[2] / max(m[0] - 1, 1.0) for m in classes.values()])


def ridge_classifier(classes: ByClass, penalty: float = 1.0) -> dict:
    """One ridge regression per class on 1 and -1; the class with the largest value is predicted."""
    n, mean, scatter = _whole(classes)
    inner = scatter + penalty * np.eye(len(mean))
    weights, intercepts = [], []
    for m in classes.values():
        centre = 2 * m[0] / n - 1
        # the scatter of features and target: only the class mean and the rest's mean matter
        cross = 2 * m[0] * (m[1] - mean)
        w = np.linalg.solve(inner, cross)
        weights.append(w)
        intercepts.append(centre - w @ mean)
    return {"classes": list(classes), "weights": np.array(weights), "intercepts": np.array(intercepts)}


#: Families of a classification: from the moments of the features per class.
CLASSIFICATION: dict[str, Callable[[ByClass], dict]] = {
    "Naive Bayes": naive_bayes,
    "Linear Discriminant Analysis": linear_discriminant,
    "Quadratic Discriminant Analysis": quadratic_discriminant,
    "Ridge Classifier": ridge_classifier,
}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Values or class labels for the rows of ``x``; of equally likely classes the smaller label."""
    if "coefficients" in model:
        return x @ model["coefficients"] + model["intercept"]
    if "weights" in model:
        return np.array(model["classes"])[(x @ model["weights"].T + model["intercepts"]).argmax(axis=1)]
    scores = [a - 0.5 * (((x - c) @ w) ** 2).sum(axis=1) for c, w, a in zip(model["means"], model["white"], model["added"], strict=True)]
    return np.array(model["classes"])[np.array(scores).argmax(axis=0)]


def _group_of(part: float, folds: int) -> int:
    """The group of a part, or of the rows of a group's other parts, whose key is below 0."""
    return int(part - 1) // folds if part > 0 else int(-part) - 1


def _fit(problem_type: str, folds: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        by_part: dict[float, dict] = {}
        name = None
        for row in table.to_pylist():
            name = row["model"]
            by_part.setdefault(row["part"], {})[row.get("label")] = _moments_of(row)
        totals: dict[int, dict] = {}
        for part, own in sorted(by_part.items()):
            total = totals.setdefault(_group_of(part, folds), {})
            for c, m in own.items():
                total[c] = merged(total[c], m) if c in total else m
        out = []
        for part, own in sorted(by_part.items()):
            if part < 0:
                continue
            total = totals[_group_of(part, folds)]
            learn = {c: without(m, own[c]) if c in own else m for c, m in sorted(total.items(), key=lambda x: x[0] or 0.0)}
            learn = {c: m for c, m in learn.items() if m[0] > 0}
            try:
                fit = (REGRESSION[name](learn[None]) if problem_type == "regression" else CLASSIFICATION[name](learn))
                out.append((name, part, pickle.dumps(fit), None))
            except Exception as error:  # one family failing must not end the comparison
                out.append((name, part, None, str(error) or repr(error)))
        return pa.table(list(zip(*out, strict=True)) or [[]] * 4, schema=pa.schema([("model", pa.string()), ("part", pa.float64()), ("fit", pa.binary()), ("error", pa.string())]))

    return run


def families(problem_type: str) -> dict:
    return REGRESSION if problem_type == "regression" else CLASSIFICATION


def parts_at_once(width: int, groups: int, folds: int, classes: int) -> list[list[int]]:
    """The parts 1 .. ``groups * folds``, cut into those whose matrices one scan adds up.

    All of them where their matrices are few and small enough for one task per family.
    Otherwise so many of a group's parts as fit beside the matrices of its other
    parts, which are added together; one at least, however wide the rows are.
    """
    cells = (width + 1) ** 2 * max(classes, 1)
    if cells * groups * folds <= MOST_CELLS:
        return [list(range(1, groups * folds + 1))]
    step = max(1, MOST_CELLS // cells - 1)
    starts = [(at * folds + first, at * folds + min(first + step - 1, folds)) for at in range(groups) for first in range(1, folds + 1, step)]
    return [list(range(first, last + 1)) for first, last in starts]


def fit_folds(training: DataFrame, problem_type: str, names: list[str], partitions: int, folds: int, own: list[int] | None = None) -> tuple[dict, dict]:
    """({(family, part): model}, {family: error}) for each part of (part, label, features): learned from the others of its group.

    Parts 1 .. ``folds`` are one group, the next ``folds`` another one, and so on.
    One scan for all, or for the parts ``own`` of ``parts_at_once``, which bounds
    its matrices. They stay on the cluster, one task per family reads them; a model
    has at most a matrix per class.
    """
    if own is not None:
        group = F.floor((F.col("part") - 1) / folds)
        training = training.where(group.isin(sorted({(p - 1) // folds for p in own}))).withColumn(
            "part", F.when(F.col("part").isin(own), F.col("part")).otherwise(-(group + 1))
        )
    x = vector_to_array("features")
    if problem_type == "regression":
        keyed, keys = training.select("part", F.concat(x, F.array(F.col("label"))).alias("values")), ["part"]
    else:
        keyed, keys = training.select("part", "label", x.alias("values")), ["part", "label"]
    gathered = moments(keyed, keys, partitions)
    wanted = gathered.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names])))
    found = wanted.groupBy("model").applyInArrow(_fit(problem_type, folds), "model string, part double, fit binary, error string").collect()
    errors = {r["model"]: r["error"] for r in found if r["error"]}
    return {(r["model"], int(r["part"])): pickle.loads(r["fit"]) for r in found if r["fit"] and r["model"] not in errors}, errors


def _score(models: dict, names: list[str], say: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("label", pa.float64()), ("predictions", pa.list_(pa.float64()))])
        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts = matrix_of(batch.column("x")), batch.column("part").to_numpy()
            out = np.zeros((len(parts), len(names)))
            for part in np.unique(parts):
                rows = parts == part
                for j, name in enumerate(names):
                    out[rows, j] = say(models.value[name, int(part)], x[rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(names)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("part").cast(pa.int32()), batch.column("label"), lists], schema=schema)

    return run


def predictions(training: DataFrame, models: dict, say: Callable = predict) -> DataFrame:
    """(part, model, label, prediction): what every row is to the models that have not seen its part, in one scan; ``say`` asks a model."""
    names = sorted({name for name, _ in models})
    shared = training.sparkSession.sparkContext.broadcast(models)
    scored = training.select("part", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x")).mapInArrow(
        _score(shared, names, say), "part int, label double, predictions array<double>"
    )
    each = F.posexplode("predictions").alias("at", "prediction")
    return scored.select("part", "label", each).select(
        "part", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("model"), "label", "prediction"
    )
