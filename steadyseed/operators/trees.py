"""Trees for many training parts at once, grown level by level.

A *run* is a training part: that of a seed, or the rows outside a fold. Features are
cut into bins once. One scan per level adds up, for every (run, tree, node), what each
bin holds; tasks hand on one array per tree, which Spark adds up and turns into splits.
Nothing is stored per row between scans: where a row stands in a tree, how often a tree
draws it, and what it weighs in a later round of boosting all follow from its id, its
bins and the trees so far.

Rows of equal features go the same way in every tree. Where they are many, one scan
adds up what they weigh in each (run, tree), and the levels only read these masses.
Where few trees are grown, each task adds up its own rows, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyseed.functions.skew import SALTS, hot_keys
from steadyseed.operators.moments import matrix_of

# Bins per feature, rows that bins are set from, rounds and step of gradient boosting, rounds of reweighting.
BINS, BIN_ROWS, BIN_CELLS = 32, 20_000, 8_000_000
GRADIENT_ROUNDS, STEP, STUMP_ROUNDS = 20, 0.1, 50
# Bytes of sums that a task holds at a time, and rows that it works on at a time.
SUM_BYTES, ROWS_AT_ONCE, BYTES_AT_ONCE = 128_000_000, 1_000_000, 64_000_000
# Rows of a step where rows are not grouped by their bins, and bits of a row's bins that are put into one number.
PLAIN_ROWS, CODE_BITS = 100_000, 62
# A scan has a task per so many partitions of the layout, but that many at least: each hands on sums of all trees.
PARTITIONS_PER_TASK, TASKS_AT_LEAST = 8, 32
# Masses are kept where they take no more than so many bytes per row, or in all, and rows are that many times the distinct ones.
MASS_BYTES_PER_ROW, MASS_BYTES, ROWS_PER_CELL = 128, 256_000_000, 4
# Levels of trees (over all runs and rounds) from which on masses are added up: by each task for its own rows, or by all.
OWN_MASS_WORK, MASS_WORK = 20, 500
# Rows whose way through drawn splits is followed at a time.
WALKED_ROWS = 32_768
# Bytes of masses in one piece and in a step of a task, and rows whose draws are looked up at a time.
PIECE_BYTES, STEP_BYTES, DRAWN_ROWS = 8_000_000, 64_000_000, 8192
# Bytes of predictions for distinct rows that are broadcast.
SAID_BYTES = 64_000_000
# What a row is to a run (other rows are not looked at), and trees whose sums one task adds up.
ASKED, LEARNED = 0, 1
TREES_PER_TASK = 16


@dataclass(frozen=True)
class Growth:
    """How trees are grown. ``classes`` is 0 for a regression.

    ``bagging`` draws rows as often as a Poisson number of mean 1, ``features`` (all
    or sqrt) of the features are looked at per node, and ``drawn`` takes one random
    threshold per node and feature between the node's extremes instead of the best.
    """

    trees: int = 1
    depth: int = 5
    classes: int = 0
    bagging: bool = False
    features: str = "all"
    drawn: bool = False
    seed: int = 1


@dataclass
class Trees:
    """One forest per run. Arrays are by (run, tree, node); the children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # -1 in leaves
    threshold: np.ndarray  # not above it goes left; in bins, or in values for drawn thresholds
    value: np.ndarray  # class shares or mean of the training rows
    weight: np.ndarray  # of the training rows

    @classmethod
    def empty(cls, runs: int, g: Growth) -> Trees:
        shape = (runs, g.trees, 2 ** (g.depth + 1) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros((*shape, max(g.classes, 1))), np.zeros(shape))

    def part(self, first: int, last: int) -> Trees:
        """Views of some of the trees."""
        return Trees(*[a[:, first:last] for a in (self.feature, self.threshold, self.value, self.weight)])


def leaves(v: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of ``v`` reaches within ``levels`` steps."""
    if not levels or feature[0] < 0:
        return np.zeros(len(v), np.intp)
    if v.dtype == np.uint8:
        threshold = threshold.astype(np.uint8)
    node = (v[:, feature[0]] > threshold[0]).astype(np.intp) + 1
    if levels == 1:
        return node
    flat, start = v.reshape(-1), np.arange(0, v.size, v.shape[1])
    ended = (feature[: 2**levels - 1] < 0).any()
    for _ in range(levels - 1):
        f = feature.take(node)
        at = start + (np.maximum(f, 0) if ended else f)
        to = 2 * node + 1
        to += flat.take(at) > threshold.take(node)
        node = np.where(f >= 0, to, node) if ended else to
    return node


# --- bins ----------------------------------------------------------------------


def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds half way between neighbouring values: all of them, or those next to the quantiles."""
    known = np.unique(values)
    if len(known) > bins:
        kept = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))
    else:
        kept = known
    place = np.searchsorted(known, kept)
    place = place[place < len(known) - 1]
    return (known[place] + known[place + 1]) / 2


def _values_of(rows: DataFrame) -> Column:
    """``features``, a vector or an array already, as an array."""
    return F.col("features") if rows.schema["features"].dataType.typeName() == "array" else vector_to_array("features")


def cuts_of(rows: DataFrame, bins: int = BINS, most: int = BIN_ROWS, n: int | None = None) -> list[np.ndarray]:
    """Thresholds per feature of (row_id, features), from the ``most`` rows of the smallest hashes; ``n`` is the number of rows, if known.

    That many rows (fewer where they have very many features) bound what reaches the
    driver. Hashes that are too large to be among them are left out by each task, so
    that the one that merges does not read ``most`` rows of every other.
    """
    first = rows.select("features").first()
    width = len(first["features"]) if first else 0
    most = min(most, max(1000, BIN_CELLS // max(width, 1)))
    sample = rows.select(F.xxhash64(F.col("row_id").cast("string")).alias("h"), F.col("row_id").cast("string").alias("id"), _values_of(rows).alias("x"))
    n = rows.count() if n is None else n
    share = (most + 6 * math.sqrt(most) + 10) / max(n, 1)
    near = sample.where(F.col("h") <= F.lit(int(share * 2**64) - 2**63)) if share < 1 else sample
    found = near.orderBy("h", "id").limit(most).select("x").toArrow()
    if share < 1 and found.num_rows < most:  # ids that repeat have few hashes
        found = sample.orderBy("h", "id").limit(most).select("x").toArrow()
    x = matrix_of(found.column("x").combine_chunks())
    return [cut_points(x[:, j], bins) for j in range(x.shape[1])]


def _cells(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    cells = np.empty(x.shape, np.uint8)
    for j, cut in enumerate(cuts):
        cells[:, j] = np.searchsorted(cut, x[:, j], side="left")
    return cells


def _binning(cuts: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(matrix_of(batch.column("x")), cuts)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(len(cuts), 1)), batch.num_rows, [None, pa.py_buffer(cells.tobytes() or bytes(batch.num_rows))])
            at = batch.schema.get_field_index("x")
            yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def prepared(rows: DataFrame, member: Column, cuts: list[np.ndarray] | None) -> DataFrame:
    """(row_id, key, y, member, x) of (row_id, features, __y): the run memberships beside bins, or values without ``cuts``.

    ``member`` is an array with an entry per run: true or 1 if the run learns the row, false or 0 if it is asked about it.
    """
    own = rows.select(
        "row_id", F.xxhash64(F.col("row_id").cast("string")).alias("key"), F.col("__y").cast("double").alias("y"), member.cast("array<tinyint>").alias("member"),
        _values_of(rows).alias("x"),
    )
    if cuts is None:
        return own
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "x")
    return own.mapInArrow(_binning(cuts), f"{kinds}, x binary")


@dataclass
class Rows:
    """A chunk of rows as arrays."""

    key: np.ndarray
    y: np.ndarray
    member: np.ndarray
    x: np.ndarray
    ids: pa.Array | None = None


def _chunks(batches: Iterator[pa.RecordBatch], with_ids: bool = False) -> Iterator[Rows]:
    held: list[pa.RecordBatch] = []
    size = 0

    def chunk() -> Rows:
        table = pa.Table.from_batches(held).combine_chunks()
        column = {n: table.column(n).chunk(0) for n in ("key", "y", "member", "x")}
        if pa.types.is_binary(column["x"].type):
            start, end = column["x"].offset, column["x"].offset + len(column["x"])
            first, last = (np.frombuffer(column["x"].buffers()[1], np.int32)[i] for i in (start, end))
            x = np.frombuffer(column["x"].buffers()[2], np.uint8)[first:last].reshape(len(column["x"]), -1)
        else:
            x = matrix_of(column["x"])
        return Rows(
            column["key"].to_numpy().view(np.uint64), column["y"].to_numpy(), matrix_of(column["member"]), x,
            table.column("row_id").chunk(0) if with_ids else None,
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE or sum(b.nbytes for b in held) >= BYTES_AT_ONCE:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct rows of bins and which of them each row is; None where they are over half of the rows, or too wide to tell cheaply."""
    if x.dtype != np.uint8 or not x.size:
        return None
    bits = max(1, int(x.max()).bit_length())
    if bits * x.shape[1] > CODE_BITS:
        return None
    code = np.zeros(len(x), np.int64)
    for j in range(x.shape[1]):
        code = code << bits | x[:, j]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return (x[first], which) if 2 * len(first) <= len(x) else None


def _pieces(rows: Rows) -> Iterator[Rows]:
    for start in range(0, len(rows.key), PLAIN_ROWS):
        own = slice(start, start + PLAIN_ROWS)
        yield Rows(rows.key[own], rows.y[own], rows.member[own], rows.x[own])


# --- what hangs on hashes --------------------------------------------------------


def _poisson_table() -> np.ndarray:
    """How often a row is drawn, by 16 random bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


DRAWN = _poisson_table()


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """64 bits per key, other ones for each salt (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = key + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def times_drawn(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    bits = mixed(key, (seed << 20) + tree // 4)
    return DRAWN[(bits >> np.uint64(16 * (tree % 4))).astype(np.uint16)]


def all_times_drawn(key: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """(tree, row): ``times_drawn`` of the trees from ``first`` on; four trees share their 64 bits."""
    drawn = np.empty((count, len(key)))
    for t in range(count):
        if not t or not (first + t) % 4:
            bits = mixed(key, (seed << 20) + (first + t) // 4)
        drawn[t] = DRAWN[(bits >> np.uint64(16 * ((first + t) % 4))).astype(np.uint16)]
    return drawn


def looked_at(g: Growth, tree: int, first: int, nodes: int, width: int) -> np.ndarray:
    """(nodes, m): the features that each node looks at, in ascending order."""
    m = width if g.features == "all" else max(1, math.ceil(math.sqrt(width)))
    if m >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.array([np.sort(np.random.default_rng([g.seed, tree, first + i]).permutation(width)[:m]) for i in range(nodes)])


def drawn_shares(g: Growth, tree: int, first: int, nodes: int, width: int) -> np.ndarray:
    """(nodes, features): where between a node's extremes its threshold is."""
    return np.array([np.random.default_rng([g.seed, tree, first + i, 1]).random(width) for i in range(nodes)])


# --- one scan --------------------------------------------------------------------


@dataclass
class Scan:
    """What a task needs to know: the trees of ``first`` .. so far, the level to add up, how rows weigh."""

    growth: Growth
    trees: Trees
    first: int
    level: int
    width: int
    extremes: bool = False
    limits: np.ndarray | None = None  # drawn thresholds by (run, tree, node, m)
    boost: Boost | None = None


@dataclass
class Boost:
    """Earlier rounds: their trees (one more tree per round and run) and what each counts."""

    kind: str  # gradient, logistic or votes
    rounds: list[Trees] = field(default_factory=list)
    weights: np.ndarray | None = None  # (rounds, runs)

    def score(self, x: np.ndarray, run: int, outputs: int) -> np.ndarray:
        """The weighted sum of the rounds' values, or of their votes per class."""
        total = np.zeros((len(x), outputs))
        for k, trees in enumerate(self.rounds):
            levels = int(math.log2(trees.feature.shape[2] + 1)) - 1
            value = trees.value[run, 0][leaves(x, trees.feature[run, 0], trees.threshold[run, 0], levels)]
            if self.kind == "votes":
                total[np.arange(len(x)), value.argmax(axis=1)] += self.weights[k, run]
            else:
                total += self.weights[k, run] * value
        return total


def _weighed(scan: Scan, rows: Rows, run: int, chosen: np.ndarray, grouped: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weight, target) of the chosen rows after the earlier rounds."""
    y, boost = rows.y[chosen], scan.boost

    def score(outputs: int) -> np.ndarray:
        if grouped is None:
            return boost.score(rows.x[chosen], run, outputs)
        return boost.score(grouped[0], run, outputs)[grouped[1][chosen]]

    if boost is None or not boost.rounds:
        return np.ones(len(chosen)), np.where(y > 0, 1.0, -1.0) if boost is not None and boost.kind == "logistic" else y
    if boost.kind == "votes":
        votes = score(scan.growth.classes)
        # a row's weight grows with the votes that missed it; all weights are scaled alike
        return np.exp(votes.sum(axis=1) - votes[np.arange(len(chosen)), y.astype(np.int64)] - boost.weights[:, run].sum() / 2), y
    before = score(1)[:, 0]
    if boost.kind == "gradient":
        return np.ones(len(chosen)), y - before
    sign = np.where(y > 0, 1.0, -1.0)
    return np.ones(len(chosen)), 4.0 * sign / (1.0 + np.exp(2.0 * sign * before))


def _sums(scan: Broadcast, of_masses: tuple[int, type] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and (run, tree): sums by (node, feature, bin or side, class or (weight, target)), or the nodes' extremes.

    ``of_masses`` are the classes and the type of the cells of ``Masses`` that are read in place of rows.
    """

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan.value
        g, trees = s.growth, s.trees
        runs, count = trees.feature.shape[:2]
        nodes, first = 2**s.level, 2**s.level - 1
        m = looked_at(g, 0, 0, 1, s.width).shape[1]
        parts, kinds = (2 if g.drawn else BINS), g.classes or 2
        shape = (runs, count, nodes, m, 2) if s.extremes else (runs, count, nodes, m, parts, kinds)
        total = np.zeros(shape)
        if s.extremes:
            total[..., 0], total[..., 1] = np.inf, -np.inf
        seen = np.zeros((runs, count), bool)

        def by_groups(rows: Rows, grouped: tuple[np.ndarray, np.ndarray]) -> None:
            """What rows of equal bins weigh is added up first, once per tree; the nodes then meet each of them once."""
            x, which = grouped
            learned = [rows.member[:, r] == LEARNED for r in range(runs)]
            plain = s.boost is None
            if plain:
                y = np.where(np.logical_or.reduce(learned), rows.y, 0.0)
                at = which * kinds + y.astype(np.intp) if g.classes else which
            fixed: dict[int, np.ndarray] = {}

            def masses(r: int, drawn: np.ndarray | None) -> np.ndarray:
                if plain:
                    index, w, target = at, learned[r].view(np.uint8) if drawn is None else learned[r] * drawn, y
                else:
                    chosen = np.flatnonzero(learned[r] if drawn is None else learned[r] & (drawn > 0))
                    w, target = _weighed(s, rows, r, chosen, grouped)
                    w = w if drawn is None else w * drawn[chosen]
                    index = which[chosen] * kinds + target.astype(np.intp) if g.classes else which[chosen]
                if g.classes:
                    return np.bincount(index, w, len(x) * kinds).reshape(len(x), kinds)
                return np.stack([np.bincount(index, w, len(x)), np.bincount(index, w * target, len(x))], axis=1)

            for t in range(count):
                subset = looked_at(g, s.first + t, first, nodes, s.width)
                drawn = times_drawn(rows.key, s.first + t, g.seed) if g.bagging else None
                for r in range(runs):
                    if drawn is None and r not in fixed:
                        fixed[r] = masses(r, None)
                    mass = fixed[r] if drawn is None else masses(r, drawn)
                    node = leaves(x, trees.feature[r, t], trees.threshold[r, t], s.level) - first
                    here = np.flatnonzero((node >= 0) & ((mass.sum(axis=1) if g.classes else mass[:, 0]) > 0))
                    if not len(here):
                        continue
                    seen[r, t] = True
                    _add(total[r, t], s, node[here], _taken(x, here), subset, mass[here], None, s.limits[r, t] if s.limits is not None else None)

        def by_rows(rows: Rows) -> None:
            state = {}
            for t in range(count):
                subset = looked_at(g, s.first + t, first, nodes, s.width)
                drawn = times_drawn(rows.key, s.first + t, g.seed) if g.bagging else None
                for r in range(runs):
                    inside = rows.member[:, r] == LEARNED
                    if drawn is not None:
                        inside &= drawn > 0
                    if drawn is not None or r not in state:
                        chosen = np.flatnonzero(inside)
                        weight, target = _weighed(s, rows, r, chosen)
                        state[r] = (chosen, _taken(rows.x, chosen), weight, target.astype(np.intp) if g.classes else target)
                    chosen, x, weight, target = state[r]
                    if not len(chosen):
                        continue
                    node = leaves(x, trees.feature[r, t], trees.threshold[r, t], s.level) - first
                    here = node >= 0
                    if not here.any():
                        continue
                    seen[r, t] = True
                    if here.all():
                        local, own, w, y = node, x, weight, target
                    else:
                        local, own, w, y = node[here], x[here], weight[here], target[here]
                    if drawn is not None:
                        w = w * drawn.take(chosen if here.all() else chosen[here])
                    _add(total[r, t], s, local, own, subset, w, y, s.limits[r, t] if s.limits is not None else None)

        def by_drawn(x: np.ndarray, masses: np.ndarray) -> None:
            """Rows are dealt out node by node, so that a node's extremes and sums are those of a short array."""
            columns = np.ascontiguousarray(x.T)
            for r in range(runs):
                for t in range(count):
                    subset = looked_at(g, s.first + t, first, nodes, s.width)
                    if not t or g.bagging:
                        mass = _boosted(s, x, r, masses[t if g.bagging else 0, r])
                        held = np.flatnonzero((mass.sum(axis=1) if g.classes else mass[:, 0]) > 0)
                        kind_columns = np.ascontiguousarray(mass.T)
                    for node, rows in _dealt_out(columns, held, trees.feature[r, t], trees.threshold[r, t], s.level):
                        seen[r, t] = True
                        own = total[r, t, node - first]
                        weights = () if s.extremes else [k.take(rows) for k in kind_columns]
                        for j, f in enumerate(subset[node - first]):
                            cell = columns[f].take(rows)
                            if s.extremes:
                                own[j, 0], own[j, 1] = np.minimum(own[j, 0], cell.min()), np.maximum(own[j, 1], cell.max())
                                continue
                            side = (cell > s.limits[r, t, node - first, j]).astype(np.intp)
                            for kind, w in enumerate(weights):
                                own[j, :, kind] += np.bincount(side, w, 2)

        def by_masses(x: np.ndarray, masses: np.ndarray) -> None:
            if g.drawn:
                for start in range(0, len(x), WALKED_ROWS):
                    by_drawn(x[start : start + WALKED_ROWS], masses[:, :, start : start + WALKED_ROWS])
                return
            fixed: dict[int, np.ndarray] = {}
            for t in range(count):
                subset = looked_at(g, s.first + t, first, nodes, s.width)
                for r in range(runs):
                    if g.bagging or r not in fixed:
                        fixed[r] = _boosted(s, x, r, masses[t if g.bagging else 0, r])
                    mass = fixed[r]
                    node = leaves(x, trees.feature[r, t], trees.threshold[r, t], s.level) - first
                    here = np.flatnonzero((node >= 0) & ((mass.sum(axis=1) if g.classes else mass[:, 0]) > 0))
                    if not len(here):
                        continue
                    seen[r, t] = True
                    _add(total[r, t], s, node[here], _taken(x, here), subset, mass[here], None, s.limits[r, t] if s.limits is not None else None)

        for x, masses in _steps_of_masses(batches, s, *of_masses) if of_masses else ():
            by_masses(x, masses)
        for chunk in _chunks(batches) if not of_masses else ():
            grouped = _distinct(chunk.x)
            if grouped is not None:
                by_groups(chunk, grouped)
                continue
            for rows in _pieces(chunk):
                by_rows(rows)
        out = [(r, t, total[r, t].tobytes()) for r, t in np.argwhere(seen).tolist()]
        task = TaskContext.get().partitionId()
        for at in range(0, len(out), 200):
            part = out[at : at + 200]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.int32()), pa.array([task] * len(part), pa.int32()), pa.array([p[2] for p in part], pa.binary())],
                names=["run", "tree", "task", "sums"],
            )

    return run_task


def _dealt_out(columns: np.ndarray, rows: np.ndarray, feature: np.ndarray, threshold: np.ndarray, level: int) -> list[tuple[int, np.ndarray]]:
    """(node, its rows) of the nodes of a level that rows reach."""
    found = [(0, rows)] if len(rows) else []
    for _ in range(level):
        below = []
        for node, own in found:
            if feature[node] < 0:
                continue
            right = columns[feature[node]].take(own) > threshold[node]
            for child, side in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                if len(side):
                    below.append((child, side))
        found = below
    return found


def _taken(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows of a matrix; bins are copied row by row and not cell by cell."""
    if x.dtype != np.uint8:
        return x[rows]
    return x.reshape(-1).view(f"V{x.shape[1]}").take(rows).view(np.uint8).reshape(len(rows), x.shape[1])


def _add(total: np.ndarray, s: Scan, local: np.ndarray, x: np.ndarray, subset: np.ndarray, w: np.ndarray, y: np.ndarray | None, limits) -> None:
    """Adds rows of weight ``w`` and target ``y``; without ``y``, groups of rows whose sums are the columns of ``w``."""
    nodes, m = subset.shape
    every, rows = m == x.shape[1], np.arange(len(x))
    for j in range(m):
        cell = x[:, j] if every else x[rows, subset[local, j]]
        if s.extremes:
            np.minimum.at(total[:, j, 0], local, cell)
            np.maximum.at(total[:, j, 1], local, cell)
            continue
        parts, kinds = total.shape[2:]
        place = local * parts + (cell > limits[local, j] if limits is not None else cell)
        if y is None:
            for kind in range(kinds):
                total[:, j, :, kind] += np.bincount(place, w[:, kind], nodes * parts).reshape(nodes, parts)
        elif s.growth.classes:
            total[:, j] += np.bincount(place * kinds + y, w, nodes * parts * kinds).reshape(nodes, parts, kinds)
        else:
            total[:, j, :, 0] += np.bincount(place, w, nodes * parts).reshape(nodes, parts)
            total[:, j, :, 1] += np.bincount(place, w * y, nodes * parts).reshape(nodes, parts)


# --- masses of equal rows --------------------------------------------------------


@dataclass
class Masses:
    """What rows of equal features weigh, ``(task, x, mass)``: arrays by (tree or 1, run, cell, kind); ``kinds`` are classes or (weight, target)."""

    table: DataFrame
    classes: int  # 0: weight and target
    tasks: int
    met: bool = True  # equal rows of all tasks are added up, not of each task alone


def _mass_classes(g: Growth, boost: Boost | None) -> int:
    """The logistic loss needs both classes apart, though its trees are regressions."""
    return 2 if boost is not None and boost.kind == "logistic" else g.classes


def _tasks(partitions: int) -> int:
    return max(min(partitions, TASKS_AT_LEAST), math.ceil(partitions / PARTITIONS_PER_TASK))


def _is_binned(rows: DataFrame) -> bool:
    return rows.schema["x"].dataType.typeName() == "binary"


def _trees_with_own_masses(rows: DataFrame, runs: int, g: Growth, partitions: int) -> int:
    """Trees whose masses are worth keeping at a time where each task adds up those of its own rows; 0 if they are not."""
    if not OWN_MASS_WORK <= runs * g.trees * g.depth < MASS_WORK:
        return 0
    row = runs * (g.classes or 2) * 8
    if not _is_binned(rows):
        # nearly all rows differ; without draws all trees share one weight and target per row
        return g.trees if not g.bagging and row <= MASS_BYTES_PER_ROW else 0
    found = rows.agg(F.approx_count_distinct("x").alias("cells"), F.count(F.lit(1)).alias("n")).first()
    cells = found["cells"] * _tasks(partitions)
    if not found["n"] or cells * ROWS_PER_CELL > found["n"]:
        return 0
    most = max(MASS_BYTES, MASS_BYTES_PER_ROW * found["n"]) // (cells * row)
    return g.trees if not g.bagging and most else most if most * g.depth >= g.trees else 0


def _trees_with_masses(rows: DataFrame, runs: int, g: Growth, boost: Boost | None, rounds: int = 1) -> int:
    """Trees whose masses are worth keeping at a time; 0 if rows had better be scanned level by level."""
    if runs * g.trees * g.depth * rounds < MASS_WORK:
        return 0  # adding masses up moves each row once
    found = rows.agg(F.approx_count_distinct("x").alias("cells"), F.count(F.lit(1)).alias("n")).first()
    if not found["n"] or found["cells"] * ROWS_PER_CELL > found["n"]:
        return 0
    tree = found["cells"] * runs * (_mass_classes(g, boost) or 2) * 8
    most = max(MASS_BYTES, MASS_BYTES_PER_ROW * found["n"]) // tree
    return g.trees if not g.bagging and most else most if most * g.depth >= g.trees else 0


def _masses(rows: DataFrame, runs: int, g: Growth, classes: int, first: int, count: int, partitions: int, met: bool = True) -> Masses:
    """The masses of trees ``first`` .. ``first + count``.

    Rows of equal features meet in one task, those of a very large group in some of
    them; or each task adds up its own rows, if they are not to be ``met``.
    """
    read = rows.where(F.exists("member", lambda m: m == LEARNED)).select("key", "y", "member", "x")
    tasks = _tasks(partitions)
    weighing = _weighing(runs, g, classes, first, count)
    if not met:
        read = read.coalesce(tasks) if tasks < partitions else read
        return Masses(read.mapInArrow(weighing, "task int, x binary, mass binary"), classes, tasks, False)
    hot = F.broadcast(hot_keys(read, ["x"]).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.col("key"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = read.join(hot, "x", "left").repartition(tasks, "x", salt).select("key", "y", "member", "x")
    return Masses(dealt.mapInArrow(weighing, "task int, x binary, mass binary"), classes, tasks)


def _cell_codes(x: np.ndarray) -> np.ndarray:
    """One number per row, equal for equal rows only."""
    code, size = np.zeros(len(x), np.int64), 1
    for j in range(x.shape[1]):
        known, own = np.unique(x[:, j], return_inverse=True)
        if size * len(known) >= 2**CODE_BITS:
            seen, code = np.unique(code, return_inverse=True)
            size = len(seen)
        code, size = code * len(known) + own, size * len(known)
    return code


def _weighing(runs: int, g: Growth, classes: int, first: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds, own_trees = classes or 2, count if g.bagging else 1

    def weigh(rows: Rows, order: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(cell, tree, run, kind) of the rows of some cells, in ``order``; ``start`` is where each cell begins."""
        total = np.zeros((len(start), own_trees, runs * kinds))
        cell = np.searchsorted(start, np.arange(len(order)), "right") - 1
        for at in range(0, len(order), DRAWN_ROWS):
            some = order[at : at + DRAWN_ROWS]
            y, learned = rows.y[some], rows.member[some] == LEARNED
            sides = y[:, None] == np.arange(kinds) if classes else np.stack([np.ones(len(y)), y], axis=1)
            weight = (learned[:, :, None] * sides[:, None, :].astype(float)).reshape(len(some), -1)
            here = cell[at : at + DRAWN_ROWS]
            edges = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            if not g.bagging:
                total[here[edges], 0] += np.add.reduceat(weight, edges, axis=0)
                continue
            drawn = all_times_drawn(rows.key[some], first, own_trees, g.seed)
            for c, low, high in zip(here[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(some)], strict=True):
                total[c] += drawn[:, low:high] @ weight[low:high]
        return total.reshape(len(start), own_trees, runs, kinds)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at_once = max(1, PIECE_BYTES // (own_trees * runs * kinds * 8))
        for rows in _chunks(batches):
            # values are hardly ever equal
            code = _cell_codes(rows.x) if rows.x.dtype == np.uint8 else np.arange(len(rows.x))
            # in the order of the keys, so that sums do not depend on how rows arrive
            order = np.lexsort((rows.key, code))
            start = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
            ends = np.r_[start[1:], len(order)]
            for at in range(0, len(start), at_once):
                low, high = start[at], ends[min(at + at_once, len(start)) - 1]
                mass = weigh(rows, order[low:high], start[at : at + at_once] - low)
                x = np.ascontiguousarray(rows.x[order[start[at : at + at_once]]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(mass.transpose(1, 2, 0, 3)).tobytes()], pa.binary())],
                    names=["task", "x", "mass"],
                )

    return run_task


def _steps_of_masses(batches: Iterator[pa.RecordBatch], s: Scan, classes: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, mass) of several pieces at a time."""
    runs, count = s.trees.feature.shape[:2]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def step() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=2)

    for batch in batches:
        for x, mass in zip(batch.column("x"), batch.column("mass"), strict=True):
            cells = np.frombuffer(x.as_buffer(), kind).reshape(-1, s.width)
            held.append((cells, np.frombuffer(mass.as_buffer(), np.float64).reshape(count if s.growth.bagging else 1, runs, len(cells), classes or 2)))
            size += held[-1][1].nbytes
            if size >= STEP_BYTES:
                yield step()
                held, size = [], 0
    if held:
        yield step()


def _boosted(s: Scan, x: np.ndarray, run: int, mass: np.ndarray) -> np.ndarray:
    """Masses as they are after the earlier rounds: a later weight or target follows from a row's features and class."""
    boost = s.boost
    if boost is None or boost.kind != "logistic" and not boost.rounds:
        return mass
    if boost.kind == "votes":
        votes = boost.score(x, run, s.growth.classes)
        return mass * np.exp(votes.sum(axis=1, keepdims=True) - votes - boost.weights[:, run].sum() / 2)
    before = boost.score(x, run, 1)[:, 0]
    if boost.kind == "gradient":
        return np.stack([mass[:, 0], mass[:, 1] - mass[:, 0] * before], axis=1)
    low, high = (-4.0 / (1.0 + np.exp(-2.0 * before)), 4.0 / (1.0 + np.exp(2.0 * before))) if boost.rounds else (-1.0, 1.0)
    return np.stack([mass.sum(axis=1), mass[:, 0] * low + mass[:, 1] * high], axis=1)


def best_splits(total: np.ndarray, subset: np.ndarray, classes: int, limits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(feature or -1, threshold, sums of the node, of its left and of its right side) per node.

    The split with the least impurity (Gini, or squared error), of equal ones that of
    the first feature and the smallest threshold; none where no split lessens it.
    """
    node = total.sum(axis=2)[:, 0]
    left = total.cumsum(axis=2)[:, :, :-1]
    right = left[:, :, :1] * 0 + total.sum(axis=2)[:, :, None] - left

    def purity(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sums.sum(axis=-1) if classes else sums[..., 0]
        square = (sums**2).sum(axis=-1) if classes else sums[..., 1] ** 2
        return np.divide(square, n, out=np.zeros_like(n), where=n > 1e-9), n

    (a, n_left), (b, n_right), (before, n) = purity(left), purity(right), purity(node)
    gain = np.where((n_left > 1e-9) & (n_right > 1e-9), a + b - before[:, None, None], -np.inf)
    # rounded, so that what is equal but for rounding counts as equal, and none as nothing gained
    scale = n if classes else (a + b).reshape(len(gain), -1).max(axis=1)
    flat = np.round(gain / np.maximum(scale, 1e-300)[:, None, None], 12).reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(best))
    split = flat[rows, best] > 0
    j, at = best // gain.shape[2], best % gain.shape[2]
    feature = np.where(split, subset[rows, j], -1).astype(np.int32)
    threshold = at.astype(float) if limits is None else limits[rows, j]
    return feature, np.where(split, threshold, 0.0), node, left[rows, j, at], right[rows, j, at]


def _reduced(scan: Broadcast, shares: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds the tasks' sums of one (run, tree), in the order of the tasks, and picks its splits; or its drawn thresholds."""

    def run(table: pa.Table) -> pa.Table:
        s = scan.value
        g = s.growth
        table = table.sort_by("task")
        r, t = table.column("run")[0].as_py(), table.column("tree")[0].as_py()
        nodes, first = 2**s.level, 2**s.level - 1
        subset = looked_at(g, s.first + t, first, nodes, s.width)
        m = subset.shape[1]
        shape = (nodes, m, 2) if s.extremes else (nodes, m, 2 if g.drawn else BINS, g.classes or 2)
        total = None
        for raw in table.column("sums"):
            own = np.frombuffer(raw.as_buffer(), np.float64).reshape(shape)
            if total is None:
                total = own.copy()
            elif s.extremes:
                total[..., 0], total[..., 1] = np.minimum(total[..., 0], own[..., 0]), np.maximum(total[..., 1], own[..., 1])
            else:
                total += own
        if shares:
            found = total
        elif s.extremes:
            share = np.take_along_axis(drawn_shares(g, s.first + t, first, nodes, s.width), subset, axis=1)
            with np.errstate(invalid="ignore"):
                found = np.where(total[..., 1] > total[..., 0], total[..., 0] + share * (total[..., 1] - total[..., 0]), np.inf)
        else:
            found = best_splits(total, subset, g.classes, s.limits[r, t] if s.limits is not None else None)
        return pa.table({"run": pa.array([r], pa.int32()), "tree": pa.array([t], pa.int32()), "found": pa.array([pickle.dumps(found)], pa.binary())})

    return run


def _values(sums: np.ndarray, classes: int) -> np.ndarray:
    n = sums.sum(axis=-1, keepdims=True) if classes else sums[..., :1]
    return np.divide(sums if classes else sums[..., 1:], n, out=np.zeros_like(sums if classes else sums[..., 1:]), where=n > 1e-9)


def _scan(rows: DataFrame, scan: Scan, partitions: int, masses: Masses | None = None) -> list:
    """Collects one small row per (run, tree): the splits or thresholds of a level."""
    shared = rows.sparkSession.sparkContext.broadcast(scan)
    if masses is not None:
        partitions, read = masses.tasks, masses.table
    else:
        read = rows.select("key", "y", "member", "x")
    # a task's own masses are about as large as its rows
    summing = partitions if masses is not None and not masses.met else _tasks(partitions)
    if summing < partitions:
        read = read.coalesce(summing)
    kind = np.uint8 if _is_binned(rows) else np.float64
    sums = read.mapInArrow(_sums(shared, None if masses is None else (masses.classes, kind)), "run int, tree int, task int, sums binary")
    if summing > 64:  # first by groups of tasks, so that no task adds up the sums of all others
        groups = math.isqrt(summing)
        sums = sums.groupBy("run", "tree", (F.col("task") % groups).alias("deal")).applyInArrow(_added(shared), "run int, tree int, task int, sums binary")
    # a number of its own, as the adaptive plan goes by bytes and would leave all trees to one task
    runs, count = scan.trees.feature.shape[:2]
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, runs * count // TREES_PER_TASK))
    dealt = sums.repartition(tasks, "run", "tree")
    found = dealt.groupBy("run", "tree").applyInArrow(_reduced(shared, False), "run int, tree int, found binary").collect()
    shared.unpersist()
    return [(r["run"], r["tree"], pickle.loads(r["found"])) for r in found]


def _added(scan: Broadcast) -> Callable[[pa.Table], pa.Table]:
    add = _reduced(scan, True)

    def run(table: pa.Table) -> pa.Table:
        total = add(table)
        return pa.table({
            "run": total.column("run"), "tree": total.column("tree"), "task": pa.array([min(table.column("task").to_pylist())], pa.int32()),
            "sums": pa.array([pickle.loads(total.column("found")[0].as_py()).tobytes()], pa.binary()),
        })

    return run


def grow(
    rows: DataFrame, runs: int, width: int, g: Growth, partitions: int = 1, boost: Boost | None = None, masses: Masses | None = None
) -> Trees:
    """Forests of all runs over ``prepared`` rows, level by level.

    Trees are taken together as long as a task's sums stay below ``SUM_BYTES``, and
    where rows of equal features are weighed first, as long as their masses stay
    bounded; what reaches the driver is the trees themselves. ``masses`` are those of
    the rows where a caller grows several trees from them.
    """
    trees = Trees.empty(runs, g)
    m = looked_at(g, 0, 0, 1, width).shape[1]
    if not m:
        return trees
    one = runs * 2 ** max(g.depth - 1, 0) * m * (2 if g.drawn else BINS) * (g.classes or 2) * 8
    at_once = max(1, min(g.trees, SUM_BYTES // one))
    classes = _mass_classes(g, boost)
    # a round of boosting is grown from the masses that all rounds share, or from the rows
    alone = masses is None and boost is None
    apart = _trees_with_own_masses(rows, runs, g, partitions) if alone else 0
    weighed = apart or (_trees_with_masses(rows, runs, g, boost) if alone else 0)
    if masses is None and weighed:
        at_once = min(at_once, weighed)
    common = masses
    for start in range(0, g.trees, at_once):
        part = trees.part(start, min(start + at_once, g.trees))
        if weighed and (g.bagging or masses is None):
            if masses is not None:
                masses.table.unpersist()
            masses = _masses(rows, runs, g, classes, start, part.feature.shape[1], partitions, not apart)
            masses.table.persist()
        for level in range(g.depth):
            scan = Scan(g, part, start, level, width, boost=boost)
            if g.drawn:
                scan.extremes = True
                scan.limits = np.full((runs, part.feature.shape[1], 2**level, m), np.inf)
                limits = scan.limits
                scan.limits = None
                for r, t, found in _scan(rows, scan, partitions, masses):
                    limits[r, t] = found
                scan = Scan(g, part, start, level, width, limits=limits, boost=boost)
            first, more = 2**level - 1, False
            for r, t, (feature, threshold, node, left, right) in _scan(rows, scan, partitions, masses):
                here = slice(first, 2 * first + 1)
                reached = (node.sum(axis=-1) if g.classes else node[:, 0]) > 1e-9
                part.feature[r, t, here] = feature
                part.threshold[r, t, here] = threshold
                split = np.flatnonzero(feature >= 0)
                below = 2 * (first + split) + 1
                for places, own in ((first + np.flatnonzero(reached), node[reached]), (below, left[split]), (below + 1, right[split])):
                    part.value[r, t, places] = _values(own, g.classes)
                    part.weight[r, t, places] = own.sum(axis=-1) if g.classes else own[:, 0]
                more = more or len(split) > 0
            if not more:
                break
    if masses is not None and common is None:
        masses.table.unpersist()
    return trees


# --- predictions -------------------------------------------------------------------


@dataclass
class Model:
    """Forests, or rounds of boosting, of all runs over one set of bins."""

    growth: Growth
    trees: Trees | None = None
    boost: Boost | None = None

    @property
    def runs(self) -> int:
        return self.trees.feature.shape[0] if self.boost is None else self.boost.weights.shape[1]

    def predict(self, x: np.ndarray, run: int) -> np.ndarray:
        """Class numbers (of equal ones the smallest) or values."""
        classes = self.growth.classes
        if self.boost is not None:
            score = self.boost.score(x, run, classes if self.boost.kind == "votes" else 1)
            if self.boost.kind == "votes":
                return score.argmax(axis=1).astype(float)
            return score[:, 0] if self.boost.kind == "gradient" else (score[:, 0] > 0).astype(float)
        total = np.zeros((len(x), max(classes, 1)))
        for t in range(self.trees.feature.shape[1]):
            total += self.trees.value[run, t][leaves(x, self.trees.feature[run, t], self.trees.threshold[run, t], self.growth.depth)]
        if not classes:
            return total[:, 0] / self.trees.feature.shape[1]
        # shares are added in tree order; rounding makes equal sums equal
        return np.round(total, 9).argmax(axis=1).astype(float)


def _predicted(models: Broadcast, names: list[str], kind: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, with_ids):
            grouped = _distinct(rows.x)
            for r in range(rows.member.shape[1]):
                chosen = np.flatnonzero(rows.member[:, r] == kind)
                if not len(chosen):
                    continue
                y = pa.array(rows.y[chosen])
                for name in names:
                    model = models.value[name]
                    said = model.predict(rows.x[chosen], r) if grouped is None else model.predict(grouped[0], r)[grouped[1][chosen]]
                    columns = [pa.array(np.full(len(chosen), r, np.int32)), pa.repeat(pa.scalar(name, pa.string()), len(chosen)), y, pa.array(said)]
                    fields = ["run", "model", "y", "prediction"]
                    if with_ids:
                        columns, fields = [rows.ids.take(pa.array(chosen)), *columns], ["row_id", *fields]
                    out = pa.RecordBatch.from_arrays(columns, names=fields)
                    for start in range(0, len(chosen), PLAIN_ROWS):
                        yield out.slice(start, PLAIN_ROWS)

    return run_task


def _few_cells(rows: DataFrame, models: dict[str, Model]) -> bool:
    """Whether what the models say to all distinct rows of bins may be broadcast, and rows are many times as many."""
    if not _is_binned(rows):
        return False
    found = rows.agg(F.approx_count_distinct("x").alias("cells"), F.count(F.lit(1)).alias("n")).first()
    answers = found["cells"] * sum(m.runs for m in models.values())
    return found["cells"] * ROWS_PER_CELL <= found["n"] and answers * 8 <= SAID_BYTES


def _looked_up(rows: DataFrame, models: Broadcast, names: list[str], kind: int, with_ids: bool) -> DataFrame:
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for name in names:
                model = models.value[name]
                said = np.stack([model.predict(x, r) for r in range(model.runs)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x"), pa.repeat(pa.scalar(name, pa.string()), len(x)), pa.ListArray.from_arrays(np.arange(len(x) + 1) * model.runs, said.ravel())],
                    names=["x", "model", "said"],
                )

    asked = rows.where(F.exists("member", lambda m: m == kind))
    said = asked.select("x").distinct().mapInArrow(run_task, "x binary, model string, said array<double>")
    met = asked.join(F.broadcast(said), "x")
    ids = ["row_id"] if with_ids else []
    each = met.select(*ids, "model", "y", "said", F.posexplode("member").alias("run", "__kind")).where(F.col("__kind") == kind)
    return each.select(*ids, "run", "model", "y", F.get("said", F.col("run")).alias("prediction"))


def predictions(rows: DataFrame, models: dict[str, Model], kind: int = ASKED, with_ids: bool = False) -> DataFrame:
    """(run, model, y, prediction) of the rows that each run is asked about, or has learned, in one scan.

    Where many rows have equal bins, the models are asked once about each of the
    distinct ones, and the rows look up what they said.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    if _few_cells(rows, models):
        return _looked_up(rows, shared, list(models), kind, with_ids)
    ids = f"row_id {rows.schema['row_id'].dataType.simpleString()}, " if with_ids else ""
    columns = ["row_id", "key", "y", "member", "x"] if with_ids else ["key", "y", "member", "x"]
    return rows.select(*columns).mapInArrow(_predicted(shared, list(models), kind, with_ids), f"{ids}run int, model string, y double, prediction double")


def guess(spark: SparkSession, model: Model, cuts: list[np.ndarray] | None, x: Column, run: int = 0, needed: Column | None = None) -> Column:
    """What the forest of a run says to each array of features; 0 where it is not ``needed``."""
    shared = spark.sparkContext.broadcast((model, cuts))

    def run_batch(column: pa.Array, asked: pa.Array) -> pa.Array:
        own, edges = shared.value
        at = np.flatnonzero(asked.to_numpy(zero_copy_only=False))
        said = np.zeros(len(column))
        if len(at):
            values = matrix_of(column.take(pa.array(at)))
            said[at] = own.predict(values if edges is None else _cells(values, edges), run)
        return pa.array(said)

    return F.arrow_udf(run_batch, "double")(x, F.lit(True) if needed is None else needed)


def splits(spark: SparkSession, model: Model, cuts: list[np.ndarray] | None, names: list[str], run: int = 0) -> DataFrame:
    """(round, tree, node, feature, threshold, counts, weight, value) of a run's nodes: what its trees ask, in values.

    ``counts`` is what a round of boosting counts; leaves have no feature and threshold.
    """
    forests = [(model.trees, 1.0)] if model.boost is None else [(t, float(w[run])) for t, w in zip(model.boost.rounds, model.boost.weights, strict=True)]
    rows = []
    for k, (forest, counts) in enumerate(forests):
        for t, node in np.argwhere(forest.weight[run] > 0).tolist():
            f, at = int(forest.feature[run, t, node]), float(forest.threshold[run, t, node])
            inner = f >= 0
            rows.append((
                k + 1, t, node, names[f] if inner else None, (at if cuts is None else float(cuts[f][int(at)])) if inner else None,
                counts, float(forest.weight[run, t, node]), forest.value[run, t, node].tolist(),
            ))
    schema = "round int, tree int, node int, feature string, threshold double, counts double, weight double, value array<double>"
    return spark.createDataFrame(rows, schema)


# --- boosting ------------------------------------------------------------------------


def gradient_boosting(rows: DataFrame, runs: int, width: int, g: Growth, partitions: int = 1, rounds: int = GRADIENT_ROUNDS, step: float = STEP) -> Model:
    """Trees on what earlier ones left: residuals, or for two classes the gradient of the logistic loss.

    What is left of a row is worked out from the earlier trees in each scan. The
    first tree counts fully, the others ``step``.
    """
    boost = Boost("logistic" if g.classes else "gradient", [], np.zeros((0, runs)))
    own = Growth(1, g.depth, 0, False, "all", False, g.seed)
    with _shared_masses(rows, runs, own, boost, partitions, rounds) as masses:
        for k in range(rounds):
            trees = grow(rows, runs, width, own, partitions, boost, masses)
            boost = Boost(boost.kind, [*boost.rounds, trees], np.vstack([boost.weights, np.full((1, runs), step if k else 1.0)]))
    return Model(g, boost=boost)


@contextmanager
def _shared_masses(rows: DataFrame, runs: int, g: Growth, boost: Boost, partitions: int, rounds: int) -> Iterator[Masses | None]:
    """The masses that all rounds of boosting start from, or None where rows are scanned."""
    classes = _mass_classes(g, boost)
    masses = _masses(rows, runs, g, classes, 0, 1, partitions) if _trees_with_masses(rows, runs, g, boost, rounds) else None
    if masses is not None:
        masses.table.persist()
    try:
        yield masses
    finally:
        if masses is not None:
            masses.table.unpersist()


def reweighted_stumps(rows: DataFrame, runs: int, width: int, classes: int, partitions: int = 1, rounds: int = STUMP_ROUNDS, depth: int = 1) -> Model:
    """AdaBoost for any number of classes: each round's tree weighs rows by the votes that missed them so far.

    Weights are never stored: they are a function of a row's bins, its class and the
    earlier trees. A round whose error is not below that of a guess ends a run's
    boosting, and so does one without any error (which then alone decides, unless
    there are earlier rounds).
    """
    g = Growth(1, depth, classes)
    boost, open_runs = Boost("votes", [], np.zeros((0, runs))), np.ones(runs, bool)
    with _shared_masses(rows, runs, g, boost, partitions, rounds) as masses:
        return Model(g, boost=_reweighted(rows, runs, width, g, partitions, rounds, boost, open_runs, masses))


def _reweighted(rows, runs: int, width: int, g: Growth, partitions: int, rounds: int, boost: Boost, open_runs: np.ndarray, masses: Masses | None) -> Boost:
    classes = g.classes
    for _ in range(rounds):
        trees = grow(rows, runs, width, g, partitions, boost, masses)
        weights = np.zeros((1, runs))
        for r in np.flatnonzero(open_runs):
            share = _missed(trees, r)
            if share >= 1 - 1 / classes:
                open_runs[r] = False
                # without any round yet the tree still says the majority
                weights[0, r] = 0.0 if len(boost.rounds) else 1.0
            else:
                if share <= 1e-12:
                    open_runs[r] = False
                weights[0, r] = math.log((1 - share) / max(share, 1e-12)) + math.log(classes - 1)
        boost = Boost("votes", [*boost.rounds, trees], np.vstack([boost.weights, weights]))
        if not open_runs.any():
            break
    return boost


def _missed(trees: Trees, run: int) -> float:
    """The share of the training weight that the first tree of a run misses."""
    inner = trees.feature[run, 0] >= 0
    ends = np.flatnonzero(~inner & (trees.weight[run, 0] > 0))
    wrong = trees.weight[run, 0][ends] * (1 - trees.value[run, 0][ends].max(axis=1))
    total = trees.weight[run, 0][ends].sum()
    return float(wrong.sum() / total) if total else 1.0
