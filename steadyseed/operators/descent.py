"""Model families that are learned by descent, all folds of all of them in the same scans.

An optimiser is a generator: it hands out the point whose loss and gradient it wants to
know, is sent both, and returns the point where it ends. One scan answers all the points
that are wanted at a time, for every family and fold, so the number of scans is that of
the slowest fit and not the sum of all. What reaches the driver is a gradient per point.

Losses, scaling, starts, steps and ends are those of the MLlib estimator of each family.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from steadyseed.operators.moments import matrix_of

# Rows of a piece, and of a step that stays in a core's cache; rows per block of a perceptron's mean.
PIECE_ROWS, STEP_ROWS, BLOCK = 16_384, 2048, 128
# A scan has a task per so many partitions of the layout, but that many at least; so many sums are added at a time.
PARTITIONS_PER_TASK, TASKS_AT_LEAST, SUMS_AT_ONCE = 8, 32, 64
# Steps, tolerance and memory of the optimisers.
STEPS, TOLERANCE, MEMORY = 100, 1e-6, 10
ZOOMS, TRIES, HALVINGS = 10, 10, 20

Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class SearchFailed(Exception):
    """A line search found no step."""


# --- optimisers ------------------------------------------------------------------


def adam(start: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, rate: float = 1.0) -> Search:
    """Steps scaled by running means of the gradient and its square, until one moves little."""
    x, mean, square, known = start, np.zeros_like(start), np.zeros_like(start), False
    for i in range(1, steps + 1):
        _, gradient = yield x
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        new = x - rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
        ended = known and np.linalg.norm(new - x) < tolerance * max(np.linalg.norm(new), 1.0)
        x, known = new, True
        if ended:
            break
    return x


def _direction(gradient: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Downhill by the two-loop recursion over the last moves and how the gradient turned, newest first."""
    way, scale, shares = gradient.copy(), 1.0, []
    if moves:
        along = moves[0] @ turns[0]
        if not along >= 0:
            raise SearchFailed
        scale = along / (turns[0] @ turns[0])
    for move, turn in zip(moves, turns, strict=True):
        shares.append((move @ way) / (move @ turn))
        if math.isnan(shares[-1]):
            raise SearchFailed
        way -= shares[-1] * turn
    way *= scale
    for move, turn, share in zip(moves[::-1], turns[::-1], shares[::-1], strict=True):
        way += move * (share - (turn @ way) / (move @ turn))
    return -way


@dataclass
class _Tried:
    """A step of a line search: its length, the loss, the slope, and what the scan said there."""

    t: float
    value: float
    slope: float
    x: np.ndarray | None = None
    gradient: np.ndarray | None = None


def _try(x: np.ndarray, way: np.ndarray, t: float, orthant: np.ndarray | None) -> Generator:
    there = x + way * t
    if orthant is not None:
        there = np.where(np.sign(there) == orthant, there, 0.0)
    value, gradient = yield there
    return _Tried(t, value, float(gradient @ way), there, gradient)


def _between(a: _Tried, b: _Tried) -> float:
    """Where a cubic through both ends is least, not too near to either."""
    d1 = a.slope + b.slope - 3 * (a.value - b.value) / (a.t - b.t)
    d2 = np.sqrt(d1 * d1 - a.slope * b.slope)
    t = b.t - (b.t - a.t) * (b.slope + d2 - d1) / (b.slope - a.slope + 2 * d2)
    low, high = a.t + 0.1 * (b.t - a.t), a.t + 0.9 * (b.t - a.t)
    return low if t < low else high if t > high else t


def _strong_wolfe(x: np.ndarray, way: np.ndarray, value: float, slope: float, t: float) -> Generator:
    """A step whose loss falls enough and whose slope is flat enough."""
    if slope > 0:
        raise SearchFailed
    low = _Tried(0.0, value, slope)
    bracket = None
    for i in range(TRIES):
        c = yield from _try(x, way, t, None)
        if not math.isfinite(c.value):
            t /= 2
            continue
        if c.value > value + 1e-4 * t * slope or i and c.value >= low.value:
            bracket = low, c
            break
        if abs(c.slope) <= 0.9 * abs(slope):
            return c
        if c.slope >= 0:
            bracket = c, low
            break
        low, t = c, t * 1.5
    if bracket is None:
        raise SearchFailed
    low, high = bracket
    for _ in range(ZOOMS):
        c = yield from _try(x, way, _between(high, low) if low.t > high.t else _between(low, high), None)
        if c.value > value + 1e-4 * c.t * slope or c.value >= low.value:
            high = c
            continue
        if abs(c.slope) <= 0.9 * abs(slope):
            return c
        if np.sign(c.slope) == np.sign(high.t - low.t):
            high = low
        low = c
    raise SearchFailed


def _backtracking(x: np.ndarray, way: np.ndarray, value: float, slope: float, t: float, shrink: float, orthant: np.ndarray) -> Generator:
    """A step that starts shrunk and is shrunk or grown until it meets the same conditions, within the signs of ``orthant``."""
    c = yield from _try(x, way, t * shrink, orthant)
    for _ in range(HALVINGS):
        if c.value > value + c.t * slope * 1e-4:
            factor = shrink
        elif c.slope < 0.9 * slope:
            factor = 2.1
        elif c.slope > -0.9 * slope:
            factor = shrink
        else:
            return c
        if not 1e-10 <= c.t * factor <= 1e10:
            raise SearchFailed
        c = yield from _try(x, way, c.t * factor, orthant)
    raise SearchFailed


def quasi_newton(start: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, by_signs: bool = False) -> Search:
    """Limited-memory BFGS; ``by_signs`` keeps a step within one orthant and searches it by backtracking, as for a hinge."""
    x = start
    value, gradient = yield x
    first, done, seen, reset = value, 0, [math.inf], False
    moves: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    while done < steps:
        if len(seen) >= 2 and abs(value - max(seen)) <= tolerance * first or np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        try:
            way = _direction(gradient, moves, turns)
            if by_signs:
                way = np.where(way * gradient < 0, way, 0.0)
                orthant = np.where(x != 0, np.sign(x), np.sign(-gradient))
                t, shrink = (1.0, 0.5) if done else (0.5 / np.linalg.norm(gradient), 0.1)
                c = yield from _backtracking(x, way, value, float(gradient @ way), t, shrink, orthant)
            else:
                c = yield from _strong_wolfe(x, way, value, float(gradient @ way), 1.0 if done else 1.0 / np.linalg.norm(way))
                if c.t * np.linalg.norm(gradient) < 1e-10:
                    raise SearchFailed
        except SearchFailed:
            if reset:
                break
            reset, moves, turns = True, [], []
            continue
        moves, turns = [c.x - x, *moves][:MEMORY], [c.gradient - gradient, *turns][:MEMORY]
        x, value, gradient, done, reset = c.x, c.value, c.gradient, done + 1, False
        seen = [*seen, value][-20:]
    return x


# --- what a scan adds up ----------------------------------------------------------


@dataclass
class Point:
    """A point of a fit as tasks read it: the loss, the fold that is left out, the class taken as 1, the numbers."""

    loss: str  # machine, logistic machine, logistic, hinge, softmax or perceptron
    run: int
    values: np.ndarray
    one: float = 1.0
    layers: tuple[int, ...] = ()
    size: int = 0  # factors or classes


@dataclass
class Asked:
    """What a scan answers: points, the shift and scale of the features of linear losses, folds per seed."""

    points: list[Point]
    centre: np.ndarray
    scale: np.ndarray
    folds: int
    of_partition: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class Piece:
    x: np.ndarray
    z: np.ndarray
    y: np.ndarray
    learned: np.ndarray  # (row, run)
    ahead: np.ndarray  # learned rows of the partition before this step, by run
    whole: np.ndarray  # learned rows of the partition, by run


def _linear(step: Piece, points: list[Point], hinge: bool) -> list[np.ndarray]:
    numbers = np.array([p.values for p in points])
    inside = step.learned[:, [p.run for p in points]]
    side = np.where(step.y[:, None] == np.array([p.one for p in points]), 1.0, -1.0)
    margin = step.z @ numbers[:, :-1].T
    margin += numbers[:, -1]
    margin *= side
    if hinge:
        short = np.where(inside & (margin < 1.0), 1.0 - margin, 0.0)
        loss, pull = short.sum(axis=0), np.where(short > 0, -side, 0.0)
    else:
        small = np.exp(-np.abs(margin))
        loss = np.where(inside, np.log1p(small) + np.maximum(-margin, 0.0), 0.0).sum(axis=0)
        pull = np.where(inside, -side * np.where(margin > 0, small, 1.0) / (1.0 + small), 0.0)
    return list(np.column_stack([loss, (step.z.T @ pull).T, pull.sum(axis=0)]))


def _raw_of_machines(x: np.ndarray, factors: np.ndarray, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, machine) values, and the (row, machine, factor) sums they come from; factors are (machine, feature, factor)."""
    sums = (x @ factors.transpose(1, 0, 2).reshape(x.shape[1], -1)).reshape(len(x), len(factors), -1)
    raw = np.einsum("nmf,nmf->nm", sums, sums) - (x**2) @ (factors**2).sum(axis=2).T
    raw *= 0.5
    raw += x @ weights.T
    raw += intercepts
    return raw, sums


def _machine_of(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, weights, intercepts) of machines of so many factors."""
    width = (values.shape[1] - 1) // (size + 1)
    return values[:, : width * size].reshape(len(values), width, size), values[:, width * size : -1], values[:, -1]


def _machines(step: Piece, points: list[Point], classes: bool) -> list[np.ndarray]:
    numbers = np.array([p.values for p in points])
    factors, weights, intercepts = _machine_of(numbers, points[0].size)
    inside = step.learned[:, [p.run for p in points]]
    raw, sums = _raw_of_machines(step.x, factors, weights, intercepts)
    if classes:
        side = np.where(step.y > 0, 1.0, -1.0)[:, None]
        loss = np.where(inside, np.logaddexp(0.0, -side * raw), 0.0).sum(axis=0)
        pull = np.where(inside, 1.0 / (1.0 + np.exp(-raw)) - (step.y > 0)[:, None], 0.0)
    else:
        off = np.where(inside, raw - step.y[:, None], 0.0)
        loss, pull = np.einsum("nm,nm->m", off, off), 2.0 * off
    sums *= pull[:, :, None]
    across = (step.x.T @ sums.reshape(len(sums), -1)).reshape(step.x.shape[1], len(points), -1).transpose(1, 0, 2)
    across = across - factors * ((step.x**2).T @ pull).T[:, :, None]
    return list(np.column_stack([loss, across.reshape(len(points), -1), (step.x.T @ pull).T, pull.sum(axis=0)]))


def _shares(margin: np.ndarray) -> np.ndarray:
    share = np.exp(margin - margin.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return share


def _softmax(step: Piece, point: Point) -> np.ndarray:
    own = np.flatnonzero(step.learned[:, point.run])
    z, y = step.z[own], step.y[own].astype(np.intp)
    numbers = point.values.reshape(point.size, -1)
    margin = z @ numbers[:, :-1].T + numbers[:, -1]
    top = margin.max(axis=1)
    rows = np.arange(len(own))
    loss = (top + np.log(np.exp(margin - top[:, None]).sum(axis=1)) - margin[rows, y]).sum()
    pull = _shares(margin)
    pull[rows, y] -= 1.0
    return np.r_[loss, np.column_stack([pull.T @ z, pull.sum(axis=0)]).ravel()]


def _layers_of(values: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights by (in, out), added) per layer."""
    found, at = [], 0
    for before, after in zip(layers, layers[1:]):
        found.append((values[at : at + before * after].reshape(before, after), values[at + before * after : at + (before + 1) * after]))
        at += (before + 1) * after
    return found


def _outputs(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What each layer hands on; the last one shares per class."""
    found = [x]
    for k, (weights, added) in enumerate(layers):
        own = found[-1] @ weights + added
        found.append(_shares(own) if k == len(layers) - 1 else 1.0 / (1.0 + np.exp(-own)))
    return found


def _perceptron(step: Piece, point: Point) -> np.ndarray:
    """Sums of means per block of rows, as rows of the last block of a partition count more."""
    own = np.flatnonzero(step.learned[:, point.run])
    whole, full = step.whole[point.run], step.whole[point.run] // BLOCK * BLOCK
    weight = np.where(step.ahead[point.run] + np.arange(len(own)) < full, 1.0 / BLOCK, 1.0 / max(whole - full, 1))
    y, layers = step.y[own].astype(np.intp), _layers_of(point.values, point.layers)
    outputs = _outputs(step.x[own], layers)
    rows = np.arange(len(own))
    loss = -(weight * np.log(outputs[-1][rows, y])).sum()
    delta = outputs[-1].copy()
    delta[rows, y] -= 1.0
    delta *= weight[:, None]
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts[:0] = [(outputs[k].T @ delta).ravel(), delta.sum(axis=0)]
        if k:
            delta = (delta @ layers[k][0].T) * outputs[k] * (1.0 - outputs[k])
    return np.concatenate([[loss], *parts])


def _added(asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task one row: loss and gradient of each point over the rows it learns, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        kinds: dict[str, list[int]] = {}
        for i, p in enumerate(a.points):
            kinds.setdefault(p.loss, []).append(i)
        total = [np.zeros(1 + len(p.values)) for p in a.points]

        def add(step: Piece) -> None:
            for kind, which in kinds.items():
                own = [a.points[i] for i in which]
                if kind in ("logistic", "hinge"):
                    found = _linear(step, own, kind == "hinge")
                elif kind.endswith("machine"):
                    found = _machines(step, own, kind != "machine")
                else:
                    found = [(_softmax if kind == "softmax" else _perceptron)(step, p) for p in own]
                for i, sums in zip(which, found, strict=True):
                    total[i] += sums

        with np.errstate(all="ignore"):
            for batch in batches:
                for piece in batch.to_pylist():
                    for step in _steps(piece, a):
                        add(step)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(total).tobytes()], pa.binary())], names=["task", "sums"]
        )

    return run


def _steps(piece: dict, a: Asked) -> Iterator[Piece]:
    y = np.frombuffer(piece["y"])
    x, parts = np.frombuffer(piece["x"]).reshape(len(y), -1), np.frombuffer(piece["parts"], np.int16).reshape(len(y), -1)
    ahead, whole = np.array(piece["ahead"]), a.of_partition.get(piece["partition"], np.array(piece["ahead"]))
    for at in range(0, len(y), STEP_ROWS):
        some = slice(at, at + STEP_ROWS)
        learned = _learned(parts[some], a.folds)
        yield Piece(x[some], (x[some] - a.centre) / a.scale, y[some], learned, ahead, whole)
        ahead = ahead + learned.sum(axis=0)


def _learned(parts: np.ndarray, folds: int) -> np.ndarray:
    """(row, run): whether the run of a seed and fold learns a row, from the row's part per seed."""
    fold = np.arange(1, folds + 1)
    return ((parts[:, :, None] > 0) & (parts[:, :, None] != fold)).reshape(len(parts), -1)


def _packed(folds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, ahead = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                some = batch.slice(at, PIECE_ROWS)
                x = np.ascontiguousarray(matrix_of(some.column("x")), dtype=float)
                parts = np.ascontiguousarray(matrix_of(some.column("parts")), dtype=np.int16)
                learned = _learned(parts, folds).sum(axis=0)
                ahead = np.zeros_like(learned) if ahead is None else ahead
                row = {"partition": partition, "ahead": ahead.tolist(), "x": x.tobytes(), "y": some.column("y").to_numpy().tobytes(), "parts": parts.tobytes()}
                yield pa.RecordBatch.from_pylist([row], PACKED)
                ahead = ahead + learned

    return run


PACKED = pa.schema([("partition", pa.int32()), ("ahead", pa.list_(pa.int64())), ("x", pa.binary()), ("y", pa.binary()), ("parts", pa.binary())])


def packed(rows: DataFrame, folds: int) -> DataFrame:
    """Pieces of the rows (__y, features, parts) as bytes, in the order of their partition."""
    plain = rows.select(F.col("__y").cast("double").alias("y"), vector_to_array("features").alias("x"), "parts")
    return plain.mapInArrow(_packed(folds), "partition int, ahead array<bigint>, x binary, y binary, parts binary")


def _sum_of(table: pa.Table) -> np.ndarray:
    """In the order of the tasks, so that sums come out alike in every run."""
    return np.sum([np.frombuffer(raw.as_buffer()) for raw in table.sort_by("task").column("sums").combine_chunks()], axis=0)


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"task": pa.array([min(table.column("task").to_pylist())], pa.int32()), "sums": pa.array([_sum_of(table).tobytes()], pa.binary())})


def _scan(pieces: DataFrame, asked: Asked, partitions: int) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of each point, summed over the rows it learns."""
    shared = pieces.sparkSession.sparkContext.broadcast(asked)
    tasks = max(min(partitions, TASKS_AT_LEAST), math.ceil(partitions / PARTITIONS_PER_TASK))
    sums = (pieces.coalesce(tasks) if tasks < partitions else pieces).mapInArrow(_added(shared), "task int, sums binary")
    if tasks > SUMS_AT_ONCE:
        sums = sums.groupBy((F.col("task") % math.isqrt(tasks)).alias("deal")).applyInArrow(_summed, "task int, sums binary")
    total = _sum_of(sums.toArrow())
    shared.unpersist()
    found, at = [], 0
    for p in asked.points:
        found.append((float(total[at]), total[at + 1 : at + 1 + len(p.values)]))
        at += 1 + len(p.values)
    return found


# --- fits --------------------------------------------------------------------------


@dataclass
class Scales:
    """Per run: rows, rows by class, means and deviations of the scaled features; rows by partition and run."""

    centre: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    by_class: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    of_partition: dict[int, np.ndarray]


def _statistics(folds: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per piece: rows, mean and squared distances from it of the rows of each run, rows by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, partition = None, None
        for batch in batches:
            for piece in batch.to_pylist():
                y = np.frombuffer(piece["y"])
                x = np.frombuffer(piece["x"]).reshape(len(y), -1)
                learned = _learned(np.frombuffer(piece["parts"], np.int16).reshape(len(y), -1), folds).astype(float)
                n = learned.sum(axis=0)
                middle = x.mean(axis=0)
                shift = np.divide(learned.T @ (x - middle), n[:, None], out=np.zeros((len(n), x.shape[1])), where=n[:, None] > 0)
                square = np.maximum(learned.T @ (x - middle) ** 2 - n[:, None] * shift**2, 0.0)
                by_class = np.array([learned[y == c].sum(axis=0) for c in range(classes)]).reshape(classes, len(n))
                found = _merged(found, (n, middle + shift, square, by_class))
                partition = piece["partition"]
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([partition], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["partition", "found"])

    return run


def _merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)[:, None]
    step = b[1] - a[1]
    return n, a[1] + step * share, a[2] + b[2] + step**2 * a[0][:, None] * share, a[3] + b[3]


def _scales(pieces: DataFrame, folds: int, classes: int) -> Scales:
    found = pieces.mapInArrow(_statistics(folds, classes), "partition int, found binary").orderBy("partition").collect()
    total, of_partition = None, {}
    for r in found:
        own = pickle.loads(r["found"])
        of_partition[r["partition"]] = own[0].astype(np.int64)
        total = _merged(total, own)
    n, mean, square, by_class = total
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.where(n[:, None] > 1, np.sqrt(square / (n[:, None] - 1)), 0.0)
    centre, scale = mean.mean(axis=0), deviation.max(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    return Scales(centre, scale, n, by_class, (mean - centre) / scale, deviation / scale, of_partition)


@dataclass
class Fit:
    """One fit of a family and run: its search, the point a search wants as tasks read it, and back."""

    search: Search
    point: Callable[[np.ndarray], Point]
    back: Callable[[float, np.ndarray, np.ndarray], tuple[float, np.ndarray]]
    model: Callable[[np.ndarray], dict]


def _plain(run: int, rows: float, start: np.ndarray, search: Callable[[np.ndarray], Search], model: dict, **kind) -> Fit:
    """A fit on the features as they are."""
    return Fit(
        search(start), lambda v: Point(run=run, values=v, **kind), lambda value, gradient, _: (value / rows, gradient / rows), lambda v: {**model, "values": v}
    )


def _scaled(s: Scales, run: int, start: np.ndarray, search: Callable[[np.ndarray], Search], rows: int, penalty: float, model: dict, **kind) -> Fit:
    """A fit of one or several (``rows``) lines on features scaled by the deviations of the run's rows, centred at their means."""
    mean, deviation, n = s.mean[run], s.deviation[run], s.rows[run]
    inverse = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)

    def lines(v: np.ndarray) -> np.ndarray:
        own = v.reshape(rows, -1)
        slopes = own[:, :-1] * inverse
        return np.column_stack([slopes, own[:, -1] - slopes @ mean]).ravel()

    def back(value: float, gradient: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        own, g = v.reshape(rows, -1), gradient.reshape(rows, -1)
        slopes = (g[:, :-1] - g[:, -1:] * mean) * inverse / n + penalty * own[:, :-1]
        return value / n + 0.5 * penalty * (own[:, :-1] ** 2).sum(), np.column_stack([slopes, g[:, -1] / n]).ravel()

    return Fit(
        search(start), lambda v: Point(run=run, values=lines(v), **kind), back,
        lambda v: {**model, "values": lines(v).reshape(rows, -1), "centre": s.centre, "scale": s.scale},
    )


def _constant(start: np.ndarray) -> Search:
    """No descent at all: where all rows are of one class, a line without slopes is exact."""
    return start
    yield  # pragma: no cover


def _logistic(s: Scales, run: int, one: int) -> Fit:
    width, ones = len(s.centre), s.by_class[one, run]
    others = s.rows[run] - ones
    with np.errstate(divide="ignore"):
        start = np.r_[np.zeros(width), np.log(ones) - np.log(others)]
    search = quasi_newton if ones and others else _constant
    return _scaled(s, run, start, search, 1, 0.0, {"kind": "line"}, loss="logistic", one=float(one))


def _multinomial(s: Scales, run: int, classes: int) -> Fit:
    known = np.log1p(s.by_class[:, run])
    start = np.column_stack([np.zeros((classes, len(s.centre))), known - known.mean()])
    search = quasi_newton
    if (s.by_class[:, run] == s.rows[run]).any():
        start[:, -1] = np.where(s.by_class[:, run] == s.rows[run], np.inf, 0.0)
        search = _constant
    return _scaled(s, run, start.ravel(), search, classes, 0.0, {"kind": "lines"}, loss="softmax", size=classes)


def _hinge(s: Scales, run: int, one: int, penalty: float, steps: int, tolerance: float) -> Fit:
    start = np.zeros(len(s.centre) + 1)
    return _scaled(s, run, start, lambda v: quasi_newton(v, steps, tolerance, True), 1, penalty, {"kind": "line"}, loss="hinge", one=float(one))


def _fits(name: str, estimator, s: Scales, run: int, classes: int, start: np.ndarray | None) -> list[Fit]:
    """The fits of a family for one run: one, or one per class."""
    if name == "Factorization Machine":
        size = estimator.getFactorSize()
        kind = "logistic machine" if classes else "machine"
        return [_plain(run, s.rows[run], start, adam, {"kind": kind, "size": size}, loss=kind, size=size)]
    if name == "Multilayer Perceptron":
        blocks = sum(math.ceil(n[run] / BLOCK) for n in s.of_partition.values())
        layers = tuple(estimator.getLayers())
        return [_plain(run, blocks, start, lambda v: quasi_newton(v, estimator.getMaxIter()), {"kind": "perceptron", "layers": layers}, loss="perceptron", layers=layers)]
    if name == "Logistic Regression":
        return [_logistic(s, run, 1)] if classes == 2 else [_multinomial(s, run, classes)]
    if name == "One vs Rest Logistic":
        return [_logistic(s, run, c) for c in range(classes)]
    svc = estimator if classes == 2 else estimator.getClassifier()
    settings = svc.getRegParam(), svc.getMaxIter(), svc.getTol()
    return [_hinge(s, run, c, *settings) for c in ([1] if classes == 2 else range(classes))]


FAMILIES = ("Factorization Machine", "Multilayer Perceptron", "Logistic Regression", "One vs Rest Logistic", "Linear SVC")


def _start(name: str, estimator, rows: DataFrame) -> np.ndarray | None:
    """Where a family starts that draws its start: what its estimator gives without a step."""
    if name not in FAMILIES[:2]:
        return None
    one = estimator.copy().setMaxIter(0).fit(rows.select("__y", "features").limit(1))
    if name == "Factorization Machine":
        return np.r_[one.factors.toArray().ravel(), one.linear.toArray(), one.intercept]
    return one.weights.toArray()


def fit_folds(rows: DataFrame, estimators: dict, folds: int, runs: int, classes: int, partitions: int) -> tuple[dict, dict]:
    """({(family, part): model}, {family: error}) of the rows (__y, features, parts), where part f + 1 leaves out fold f of a seed.

    ``classes`` is 0 for a regression. Families of the same scans wait for each other.
    """
    pieces = packed(rows, folds).persist()
    errors: dict[str, str] = {}
    models: dict[tuple, list[dict]] = {}
    try:
        s = _scales(pieces, folds, classes)
        open_fits: dict[tuple, tuple[Fit, np.ndarray]] = {}

        def moved(key: tuple, fit: Fit, go: Callable[[], np.ndarray]) -> None:
            try:
                open_fits[key] = fit, go()
            except StopIteration as ended:
                open_fits.pop(key, None)
                models.setdefault(key[:2], []).append((key[2], fit.model(ended.value)))

        with np.errstate(all="ignore"):
            for name, estimator in estimators.items():
                try:
                    if not (s.rows > 0).all():
                        raise ValueError("a fold has no rows to learn from")
                    start = _start(name, estimator, rows)
                    for run in range(runs):
                        for k, fit in enumerate(_fits(name, estimator, s, run, classes, start)):
                            moved((name, run + 1, k), fit, lambda fit=fit: next(fit.search))
                except Exception as error:  # one family failing must not end the comparison
                    errors[name] = str(error) or repr(error)
            while open_fits := {k: v for k, v in open_fits.items() if k[0] not in errors}:
                keys = list(open_fits)
                asked = Asked([open_fits[k][0].point(open_fits[k][1]) for k in keys], s.centre, s.scale, folds, s.of_partition)
                for key, (value, gradient) in zip(keys, _scan(pieces, asked, partitions), strict=True):
                    fit, at = open_fits[key]
                    try:
                        moved(key, fit, lambda: fit.search.send(fit.back(value, gradient, at)))
                    except Exception as error:
                        errors[key[0]] = str(error) or repr(error)
    finally:
        pieces.unpersist()
    return {key: [m for _, m in sorted(found, key=lambda f: f[0])] for key, found in models.items() if key[0] not in errors}, errors


def predict(models: list[dict], x: np.ndarray) -> np.ndarray:
    """Values or class numbers of the rows of ``x``; several lines are one per class."""
    with np.errstate(all="ignore"):
        first = models[0]
        if first["kind"] in ("line", "lines"):
            lines = np.concatenate([m["values"] for m in models])
            margin = ((x - first["centre"]) / first["scale"]) @ lines[:, :-1].T + lines[:, -1]
            return (margin[:, 0] > 0).astype(float) if len(lines) == 1 else margin.argmax(axis=1).astype(float)
        if first["kind"] == "perceptron":
            return _outputs(x, _layers_of(first["values"], first["layers"]))[-1].argmax(axis=1).astype(float)
        raw, _ = _raw_of_machines(x, *_machine_of(first["values"][None, :], first["size"]))
        return raw[:, 0] if first["kind"] == "machine" else (raw[:, 0] > 0).astype(float)
