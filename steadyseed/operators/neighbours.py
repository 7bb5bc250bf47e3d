"""Exact k nearest neighbours as Spark joins between bounded blocks.

Points are assigned to the nearest of a bounded set of pivot points (Voronoi
cells). A query first meets the points of its own cell, which bounds the distance
of its k-th neighbour; the triangle inequality then tells which other cells can
hold anything nearer, and only those are visited (the pivot-based k-nearest-
neighbour join of Lu, Shen, Chen and Ooi, VLDB 2012). Cells are cut into blocks
of bounded size on both sides, and each block hands on only its k best per query.

Rows with equal vectors are handled as one query, and of equal points only the
first k + 1 by id can ever be among the k nearest of anything, so a vector shared
by a third of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.config import ensure_checkpoint_dir
from steadyseed.functions.skew import HOT_KEYS_AT_MOST, HOT_ROWS, lookup_join
from steadyseed.operators.moments import matrix_of

BLOCK_ROWS = 4096
# Doubles held by the pivots, and cells of all parts, which every task reads.
PIVOT_VALUES = 1_000_000
MATRIX_VALUES = 4_000_000
# Doubles of a piece of distances that stays in a core's cache.
CACHED_VALUES = 64_000
# Dimensions from which on products tell first which pairs are near, and points per neighbour that it pays for.
WIDE, FEW_POINTS = 16, 16
# Rows and doubles that one side of a block of several cells has at most, and blocks that the other cells are dealt into at least.
GROUP_ROWS, GROUP_BLOCKS = 65_536, 64
# Points that look for their pivots together, and pivots on either side that bound how far the nearest one is.
NEAR_POINTS, NEAR_PIVOTS = 128, 4
# Points that a pivot's cell may cost a query, against the distances to the pivots of a point.
VISITS = 16


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed dimension by dimension so that equal vectors are at exactly 0."""
    total = np.zeros((len(a), len(b)))
    across = np.ascontiguousarray(b.T)
    step = max(1, CACHED_VALUES // max(len(b), 1))
    for start in range(0, len(a), step):
        some, own = total[start : start + step], a[start : start + step]
        for j in range(a.shape[1]):
            gap = own[:, j, None] - across[j]
            gap *= gap
            some += gap
    return total


def nearest_pairs(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and squared distance of the k smallest distances per row, of equal ones those of the first columns.

    Of wide vectors a matrix product tells roughly how far all pairs are apart. Only
    pairs that rounding could still bring among the k nearest are summed dimension by
    dimension, as all are for narrow ones, so the result is the same.
    """
    few = len(b) < FEW_POINTS * k
    if a.shape[1] >= WIDE and not few:
        with np.errstate(over="ignore", invalid="ignore"):
            size, sizes = (a * a).sum(axis=1), (b * b).sum(axis=1)
            rough = a @ b.T
            rough *= -2.0
            rough += size[:, None]
            rough += sizes
            slack = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (size + sizes.max())
            # the k nearest of some of the points bound those of all
            limit = np.partition(rough[:, :: len(b) // (4 * k)], k - 1, axis=1)[:, k - 1] + 2 * slack
        if np.isfinite(limit).all() and np.isfinite(sizes).all():
            at, which = np.nonzero(rough <= limit[:, None])
            near = np.zeros(len(at))
            for j in range(a.shape[1]):
                gap = a[at, j] - b[which, j]
                gap *= gap
                near += gap
            order = np.lexsort((which, near, at))
            at, which, near = at[order], which[order], near[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            return at[kept], which[kept], near[kept]
    distance = squared_distances(a, b)
    at, which = _best(distance, k)
    return at, which, distance[at, which]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, of equally near ones the first, and its squared distance.

    Narrow vectors are taken in the order of the pivots' widest dimension. A pivot near
    in it bounds how far the nearest one is, and only pivots that are no further away
    in that dimension alone are compared.
    """
    if vectors.shape[1] >= WIDE or not vectors.shape[1] or len(pivots) <= 16 * NEAR_PIVOTS:
        _, cell, near = nearest_pairs(vectors, pivots, 1)
        return cell, near
    widest = np.ptp(pivots, axis=0).argmax()
    by_place = np.argsort(pivots[:, widest], kind="stable")
    places = pivots[by_place, widest]
    cell, near = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    order = np.argsort(vectors[:, widest], kind="stable")
    for start in range(0, len(order), NEAR_POINTS):
        mine = order[start : start + NEAR_POINTS]
        some, own = vectors[mine], vectors[mine, widest]
        around = np.clip(np.searchsorted(places, own)[:, None] + np.arange(-NEAR_PIVOTS, NEAR_PIVOTS), 0, len(places) - 1)
        gap = some[:, None, :] - pivots[by_place[around]]
        # a little slack, as the bound is a root
        bound = np.sqrt((gap * gap).sum(axis=2).min(axis=1)) * (1 + 1e-9) + 1e-9 * np.abs(own)
        first, last = np.searchsorted(places, (own - bound).min(), "left"), np.searchsorted(places, (own + bound).max(), "right")
        # in their own order, which settles ties
        asked = np.sort(by_place[first:last])
        distance = squared_distances(some, pivots[asked])
        which = distance.argmin(axis=1)
        cell[mine], near[mine] = asked[which], distance[np.arange(len(mine)), which]
    return cell, near


def vector_key(vec: Column) -> Column:
    return F.md5(F.concat_ws(",", F.transform(vec, lambda x: (x + F.lit(0.0)).cast("string"))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=float)


def _row_chunks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, MATRIX_VALUES // max(width, 1))
    for start in range(0, rows, step):
        yield slice(start, start + step)


@dataclass
class Cells:
    """What every task needs to know about the pivots and the cells of each part."""

    pivots: np.ndarray
    members: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # part -> cell, count, radius


def _pivots(candidates: DataFrame, wanted: int) -> np.ndarray:
    """A top-k by a hash of the vector: a repeatable sample of distinct points, of bounded size."""
    drawn = (
        candidates.select("vkey", "vec").dropDuplicates(["vkey"])
        .orderBy(F.md5(F.concat(F.lit("pivot:"), F.col("vkey")))).limit(wanted).select("vec").collect()
    )
    return np.array([r["vec"] for r in drawn], dtype=float)


def _assign_points(candidates: DataFrame, pivots: np.ndarray) -> DataFrame:
    id_type = candidates.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix_of(batch.column("vec"))
            cell, reach = np.zeros(len(vectors), dtype="int32"), np.zeros(len(vectors))
            for rows in _row_chunks(len(vectors), len(pivots)):
                cell[rows], near = nearest_pivots(vectors[rows], pivots)
                reach[rows] = np.sqrt(near)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"])

    return candidates.select("id", "part", "label", "vec").mapInArrow(
        assign, f"id {id_type}, part string, label bigint, vec array<double>, cell int, reach double"
    )


def _cells(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    """At most one row per part and pivot reaches the driver."""
    rows = assigned.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")
    ).orderBy("part", "cell").collect()
    members: dict[str, tuple[list, list, list]] = {}
    for r in rows:
        entry = members.setdefault(r["part"], ([], [], []))
        entry[0].append(r["cell"])
        entry[1].append(r["n"])
        entry[2].append(r["radius"])
    return Cells(pivots, {p: (np.array(c), np.array(n), np.array(x)) for p, (c, n, x) in members.items()})


def _grouped(cells: Cells, rows: int) -> dict[str, np.ndarray]:
    """Per part: the group of each of its cells. Cells near each other along the widest dimension share one of about ``rows`` points."""
    found = {}
    for part, (number, count, _) in cells.members.items():
        pivots = cells.pivots[number]
        order = np.argsort(pivots[:, np.ptp(pivots, axis=0).argmax()], kind="stable") if pivots.shape[1] else np.arange(len(number))
        group = np.empty(len(number), dtype="int32")
        group[order] = (np.cumsum(count[order]) - count[order]) // rows
        found[part] = group
    return found


def _visits(queries: DataFrame, cells: Cells, k: int, home: bool, groups: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The cells each query has to look into.

    ``home`` gives ``(part, qkey, vec, cell, bound)``: the nearest cell with a bound
    from cell sizes alone. Otherwise ``(part, qkey, vec, group, cells, bound)`` names
    the other cells that can hold a point within the query's ``bound``, one row per
    group of cells, so that a vector is not copied once per cell.
    """

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, rows in batch.groupby("part"):
                if part not in cells.members:
                    continue
                number, count, radius = cells.members[part]
                vectors = _matrix(rows["vec"])
                for piece in _row_chunks(len(rows), len(number)):
                    some = rows.iloc[piece]
                    distance = np.sqrt(squared_distances(vectors[piece], cells.pivots[number]))
                    if home:
                        nearest = distance.argmin(axis=1)
                        farthest = distance + radius[None, :]
                        # no cell is empty, so k of them are enough
                        order = np.argpartition(farthest, k - 1, axis=1)[:, :k] if k < farthest.shape[1] else np.broadcast_to(np.arange(farthest.shape[1]), farthest.shape)
                        order = np.take_along_axis(order, np.take_along_axis(farthest, order, 1).argsort(axis=1), 1)
                        reached = count[order].cumsum(axis=1) >= k
                        enough = reached.argmax(axis=1)
                        bound = np.take_along_axis(farthest, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
                        bound = np.where(reached.any(axis=1), bound, np.inf)
                        yield pd.DataFrame({
                            "part": part, "qkey": some["qkey"].to_numpy(), "vec": some["vec"].to_numpy(),
                            "cell": number[nearest].astype("int32"), "bound": bound,
                        })
                        continue
                    own = np.searchsorted(number, some["cell"].to_numpy())
                    to_own = np.take_along_axis(distance, own[:, None], 1)
                    # only from the home cells of these rows, never all pivots against all
                    homes, home_of = np.unique(own, return_inverse=True)
                    apart = np.sqrt(squared_distances(cells.pivots[number[homes]], cells.pivots[number]))[home_of]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart > 0, (distance**2 - to_own**2) / (2 * apart), 0.0)
                    nearest_possible = np.maximum(distance - radius[None, :], plane)
                    # A little slack keeps rounding from hiding a tie at the bound.
                    bound = some["bound"].to_numpy()[:, None]
                    open_cells = nearest_possible <= bound + 1e-9 * (1.0 + bound + distance)
                    open_cells[np.arange(len(some)), own] = False
                    at, which = np.nonzero(open_cells)
                    if not len(at):
                        continue
                    group = groups[part][which]
                    order = np.lexsort((which, group, at))
                    at, which, group = at[order], which[order], group[order]
                    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (group[1:] != group[:-1])])
                    own_cells = np.empty(len(first), dtype=object)
                    own_cells[:] = np.split(number[which].astype("int32"), first[1:])
                    yield pd.DataFrame({
                        "part": part, "qkey": some["qkey"].to_numpy()[at[first]], "vec": some["vec"].to_numpy()[at[first]],
                        "group": group[first], "cells": own_cells, "bound": some["bound"].to_numpy()[at[first]],
                    })

    place = "cell int" if home else "group int, cells array<int>"
    return queries.mapInPandas(choose, f"part string, qkey string, vec array<double>, {place}, bound double")


def _best(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest per row; columns are in id order, which settles ties."""
    rows, columns = distance.shape
    if columns > k:
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
        at, which = np.nonzero(distance <= limit[:, None])
    else:
        at, which = np.nonzero(np.ones_like(distance, dtype=bool))
    order = np.lexsort((which, distance[at, which], at))
    at, which = at[order], which[order]
    first = np.searchsorted(at, np.arange(rows))
    within = np.arange(len(at)) - first[at] < k
    return at[within], which[within]


def _meet(visits: DataFrame, assigned: DataFrame, k: int, block_rows: int, id_type: str) -> DataFrame:
    """The k best points per query and block, ``(part, qkey, dist2, id, label, vec)``."""
    spark = assigned.sparkSession
    sizes = assigned.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("points"))
    demand = visits.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("queries"))
    blocks = sizes.join(demand, ["part", "cell"]).select(
        "part", "cell",
        F.ceil(F.col("points") / block_rows).cast("int").alias("point_blocks"),
        F.ceil(F.col("queries") / block_rows).cast("int").alias("query_blocks"),
    )
    # One row per cell; cells are as many as pivots and parts, both bounded.
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), blocks.schema))

    def block_of(key: str, blocks_column: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(blocks_column)).cast("int")

    def each(blocks_column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks_column) - 1))

    grid = ["part", "cell", "point_block", "query_block"]
    asking = visits.join(blocks, ["part", "cell"]).select(
        "part", "cell", each("point_blocks").alias("point_block"), block_of("qkey", "query_blocks").alias("query_block"),
        "qkey", "vec",
    )
    offered = assigned.join(blocks, ["part", "cell"]).select(
        "part", "cell", block_of("id", "point_blocks").alias("point_block"), each("query_blocks").alias("query_block"),
        "id", "label", "vec",
    )

    return _compare_blocks(asking, offered, grid, k, id_type)


def _meet_groups(visits: DataFrame, assigned: DataFrame, cells: Cells, groups: dict[str, np.ndarray], rows: int, k: int, id_type: str) -> DataFrame:
    """The k best points per query and block of a group, ``(part, qkey, dist2, id, label, vec)``, none beyond the query's bound."""
    spark = assigned.sparkSession
    # one row per part and cell, as many as the pivots that every task reads
    known = pd.DataFrame({"part": [], "cell": [], "group": [], "points": []}).astype({"part": object, "cell": "int32", "group": "int32", "points": "int64"})
    known = pd.concat([known, *[
        pd.DataFrame({"part": part, "cell": number.astype("int32"), "group": groups[part], "points": count}) for part, (number, count, _) in cells.members.items()
    ]])
    held = spark.createDataFrame(known, "part string, cell int, group int, points bigint")
    demand = visits.groupBy("part", "group").agg(F.count(F.lit(1)).alias("queries"))
    blocks = held.groupBy("part", "group").agg(F.sum("points").alias("points")).join(demand, ["part", "group"]).select(
        "part", "group", F.ceil(F.col("points") / (2 * rows)).cast("int").alias("point_blocks"), F.ceil(F.col("queries") / rows).cast("int").alias("query_blocks"),
    )
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), blocks.schema))
    grid = ["part", "group", "point_block", "query_block"]
    block_of = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asking = visits.join(blocks, ["part", "group"]).select(
        "part", "group", each("point_blocks").alias("point_block"), block_of("qkey", "query_blocks").alias("query_block"), "qkey", "vec", "cells", "bound"
    )
    offered = assigned.join(F.broadcast(held.drop("points")), ["part", "cell"]).join(blocks, ["part", "group"]).select(
        "part", "group", block_of("id", "point_blocks").alias("point_block"), each("query_blocks").alias("query_block"), "cell", "id", "label", "vec"
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["part", "qkey", "dist2", "id", "label", "vec"], dtype=object)
        right = right.sort_values("id", ignore_index=True)
        in_id_order = np.argsort(right["cell"].to_numpy(), kind="stable")
        cell, points, queries = right["cell"].to_numpy()[in_id_order], _matrix(right["vec"])[in_id_order], _matrix(left["vec"])
        # a little slack, as the bound is a root
        limit = left["bound"].to_numpy() ** 2 * (1 + 1e-9)
        opened = left["cells"].to_numpy()
        asks = np.repeat(np.arange(len(left)), [len(c) for c in opened])
        wanted = np.concatenate(opened)
        order = np.argsort(wanted, kind="stable")
        asks, wanted = asks[order], wanted[order]
        found = []
        for c in np.unique(cell):
            rows_of = asks[np.searchsorted(wanted, c, "left") : np.searchsorted(wanted, c, "right")]
            first, last = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
            for piece in _row_chunks(len(rows_of), last - first):
                mine = rows_of[piece]
                at, which, near = nearest_pairs(queries[mine], points[first:last], k)
                inside = near <= limit[mine[at]]
                found.append((mine[at[inside]], in_id_order[first + which[inside]], near[inside]))
        if not found:
            return pd.DataFrame(columns=["part", "qkey", "dist2", "id", "label", "vec"], dtype=object)
        at, which, near = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((which, near, at))
        at, which, near = at[order], which[order], near[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, which = at[kept], which[kept]
        return pd.DataFrame({
            "part": left["part"].iloc[0], "qkey": left["qkey"].to_numpy()[at], "dist2": near[kept],
            "id": right["id"].to_numpy()[which], "label": right["label"].to_numpy()[which], "vec": right["vec"].to_numpy()[which],
        })

    # Both sides may come from one table; fresh names for one side keep them apart.
    left = asking.select(*[F.col(c).alias(c) for c in (*grid, "qkey", "vec", "cells", "bound")])
    right = offered.select(*grid, "cell", "id", "label", "vec")
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(
        compare, f"part string, qkey string, dist2 double, id {id_type}, label bigint, vec array<double>"
    )


def _compare_blocks(asking: DataFrame, offered: DataFrame, grid: list[str], k: int, id_type: str) -> DataFrame:
    """The k best offered points per query within each block of the grid; blocks are of bounded size."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["part", "qkey", "dist2", "id", "label", "vec"], dtype=object)
        right = right.sort_values("id", ignore_index=True)
        points, out = _matrix(right["vec"]), []
        queries = _matrix(left["vec"])
        for rows in _row_chunks(len(left), len(right)):
            at, which, near = nearest_pairs(queries[rows], points, k)
            out.append(pd.DataFrame({
                "part": left["part"].iloc[0],
                "qkey": left["qkey"].to_numpy()[rows][at],
                "dist2": near,
                "id": right["id"].to_numpy()[which],
                "label": right["label"].to_numpy()[which],
                "vec": right["vec"].to_numpy()[which],
            }))
        return pd.concat(out, ignore_index=True)

    # Both sides may come from one table; fresh names for one side keep them apart.
    left = asking.select(*[F.col(c).alias(c) for c in (*grid, "qkey", "vec")])
    right = offered.select(*grid, "id", "label", "vec")
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(
        compare, f"part string, qkey string, dist2 double, id {id_type}, label bigint, vec array<double>"
    )


def _merge(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("part", "qkey").orderBy("dist2", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def neighbour_lists(queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``queries`` with ``neighbours``, the k nearest points of the query's part.

    ``queries(id, part, vec, ...)`` and ``points(id, part, label, vec)``; a query
    is never its own neighbour. Order is by squared distance, then id. The
    result is checkpointed in the shared folder.
    """
    ensure_checkpoint_dir(points.sparkSession)
    id_type = points.schema["id"].dataType.simpleString()
    depth = k + 1
    copies = Window.partitionBy("part", "vkey").orderBy("id")
    candidates = (
        points.select("id", "part", F.col("label").cast("bigint").alias("label"), "vec", vector_key(F.col("vec")).alias("vkey"))
        .withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= depth).drop("copy")
        .persist()
    )
    keyed = queries.withColumn("qkey", vector_key(F.col("vec")))
    distinct = keyed.groupBy("part", "qkey").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("rows")).persist()
    held = [candidates, distinct]
    sizes = candidates.agg(
        F.lit("offered").alias("side"), F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("bigint").alias("most"), F.lit(None).cast("bigint").alias("rows")
    ).unionByName(distinct.agg(
        F.lit("asked").alias("side"), F.count(F.lit(1)).alias("n"), F.max("rows").alias("most"), F.sum("rows").alias("rows")
    ))
    by_side = {r["side"]: r for r in sizes.collect()}
    offered, asked, width = by_side["offered"], by_side["asked"], by_side["offered"]["most"]
    if not offered["n"] or not asked["n"]:
        for table in held:
            table.unpersist()
        empty = f"array<struct<dist2:double,id:{id_type},label:bigint,vec:array<double>>>"
        return queries.withColumn("neighbours", F.array().cast(empty))
    if offered["n"] <= block_rows:
        block = F.pmod(F.xxhash64("qkey"), F.lit(math.ceil(asked["n"] / block_rows))).cast("int")
        best = _compare_blocks(distinct.withColumn("block", block), _repeat_for(candidates, block_rows, asked["n"]), ["part", "block"], depth, id_type)
    else:
        best = _search_cells(candidates, distinct, offered["n"], asked["n"], width, depth, block_rows, id_type, held)
    lists = best.groupBy("part", "qkey").agg(
        F.sort_array(F.collect_list(F.struct("dist2", "id", "label", "vec"))).alias("nearest")
    )
    # A vector may be shared by very many query rows; the counts are known already.
    limit = max(HOT_ROWS, asked["rows"] // HOT_KEYS_AT_MOST)
    if asked["most"] > limit:
        hot = distinct.where(F.col("rows") > limit).select("part", "qkey")
        joined = lookup_join(keyed, lists, ["part", "qkey"], "id", "left", hot=hot)
    else:
        joined = keyed.join(lists, ["part", "qkey"], "left")
    others = F.slice(F.filter("nearest", lambda n: n["id"] != F.col("id")), 1, k)
    result = joined.select(*queries.columns, F.coalesce(others, F.array()).alias("neighbours")).checkpoint()
    for table in held:
        table.unpersist()
    return result


def _repeat_for(candidates: DataFrame, block_rows: int, queries: int) -> DataFrame:
    """The few candidates, once per block of queries."""
    blocks = math.ceil(queries / block_rows)
    return candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _search_cells(
    candidates: DataFrame, distinct: DataFrame, n: int, asked: int, width: int, depth: int, block_rows: int, id_type: str, held: list
) -> DataFrame:
    """The ``depth`` best per distinct query, by way of its own cell and then the cells that can hold anything nearer.

    A few queries against many points need fewer pivots, as most of the work is then to find the points' cells.
    """
    parts = candidates.select("part").distinct().count()
    wanted = math.ceil(math.sqrt(max(min(n, VISITS * asked), n // GROUP_ROWS)))
    pivots = _pivots(candidates, max(1, min(wanted, PIVOT_VALUES // max(width, parts, 1))))
    assigned = _assign_points(candidates, pivots).persist()
    cells = _cells(assigned, pivots)
    at_home = _visits(distinct, cells, depth, home=True).persist()
    near = _merge(_meet(at_home, assigned, depth, block_rows, id_type), depth).persist()
    reached = near.groupBy("part", "qkey").agg(F.count(F.lit(1)).alias("n"), F.max("dist2").alias("d2"))
    tight = F.when(F.col("n") >= depth, F.least("bound", F.sqrt("d2"))).otherwise(F.col("bound"))
    bounded = at_home.join(reached, ["part", "qkey"], "left").select("part", "qkey", "vec", "cell", tight.alias("bound"))
    # as large as bounded memory allows, but enough blocks for a cluster
    rows = min(GROUP_ROWS, max(1, MATRIX_VALUES // max(width, 1)), max(1, math.isqrt(n * asked // GROUP_BLOCKS)))
    groups = _grouped(cells, rows)
    elsewhere = _visits(bounded, cells, depth, home=False, groups=groups).persist()
    held += [assigned, at_home, near, elsewhere]
    return _merge(near.unionByName(_meet_groups(elsewhere, assigned, cells, groups, rows, depth, id_type)), depth)
