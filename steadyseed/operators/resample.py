"""Adaptive synthetic oversampling (He, Bai, Garcia and Li, IJCNN 2008)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.functions.columns import col
from steadyseed.functions.hashing import keyed_hash, repeat_rows, unit_interval
from steadyseed.operators.neighbours import BLOCK_ROWS, neighbour_lists
from steadyseed.operators.split import class_sizes

# Neighbours looked at and the default seed.
NEIGHBOURS, SEED = 5, 42


@dataclass
class Allocation:
    """New rows per minority row, or the reason why there are none."""

    rows: DataFrame | None
    reason: str | None = None
    classes: list = field(default_factory=list)


def _needs(sizes: dict) -> dict:
    """Rows each class lacks to reach the largest one; on a tie the smaller label is the largest class."""
    majority = max(sizes, key=sizes.get)
    return {c: sizes[majority] - n for c, n in sizes.items() if sizes[majority] > n}


def _points(df: DataFrame, row_id: str, features: list[str], label: str, part: Column) -> DataFrame:
    return df.select(
        col(row_id).alias("id"), part.alias("part"), col(label).cast("bigint").alias("label"), feature_vector(features).alias("vec")
    )


def feature_vector(features: list[str]) -> Column:
    return F.array(*[col(f).cast("double") for f in features])


def neighbour_shares(
    df: DataFrame, row_id: str, features: list[str], label: str, classes: list | None = None, k: int = NEIGHBOURS,
    block_rows: int = BLOCK_ROWS, asked: Column | None = None,
) -> DataFrame:
    """``(id, label, vec, others, ratio)``: how many of the k nearest rows of each row of ``classes`` have another class.

    Without ``classes`` every row with a label is asked about. ``asked`` is a condition on the rows that are asked
    about; their neighbours are looked for among all rows.
    """
    table = _points(df, row_id, features, label, F.lit(""))
    queries = table if asked is None else _points(df.where(asked), row_id, features, label, F.lit(""))
    wanted = F.col("label").isNotNull() if classes is None else F.col("label").isin(*classes)
    lists = neighbour_lists(queries.where(wanted), table, k, block_rows)
    others = F.size(F.filter("neighbours", lambda n: n["label"] != F.col("label")))
    return lists.select("id", "label", "vec", others.alias("others"), (others / F.lit(float(k))).alias("ratio"))


def adasyn_allocation(
    df: DataFrame, row_id: str, features: list[str], label: str, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS
) -> Allocation:
    """``(id, label, vec, others, ratio, copies)`` for the rows of every class below the majority."""
    sizes = class_sizes(df, label)
    needs = _needs(sizes)
    if not needs:
        return Allocation(None, "classes are already balanced")
    small = [c for c in needs if sizes[c] <= k]
    if small:
        return Allocation(None, f"fewer than {k + 1} rows in class {small[0]}")
    shares = neighbour_shares(df, row_id, features, label, list(needs), k, block_rows)
    # At most k + 1 rows per class: how many minority rows have how many other-class neighbours.
    tally = shares.groupBy("label", "others").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {c: sum(r["others"] * r["n"] for r in tally if r["label"] == c) for c in needs}
    if not all(totals.values()):
        return Allocation(None, "no minority row has a neighbour of another class")
    if not any(round(r["others"] / totals[r["label"]] * needs[r["label"]]) for r in tally):
        return Allocation(None, "no row would be generated")
    copies = None
    for c, need in needs.items():
        wanted = F.rint(F.col("others") / F.lit(float(totals[c])) * F.lit(float(need))).cast("bigint")
        copies = F.when(F.col("label") == c, wanted) if copies is None else copies.when(F.col("label") == c, wanted)
    return Allocation(shares.withColumn("copies", copies), classes=list(needs))


def synthetic_rows(
    df: DataFrame, row_id: str, features: list[str], label: str, allocation: Allocation,
    k: int = NEIGHBOURS, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The generated rows: each lies between a minority row and one of its k nearest of the same class."""
    same = _points(df, row_id, features, label, col(label).cast("string")).where(F.col("label").isin(*allocation.classes))
    asked = allocation.rows.where(F.col("copies") > 0).select("id", F.col("label").cast("string").alias("part"), "label", "vec", "copies")
    parents = neighbour_lists(asked, same, k, block_rows).withColumn(
        "neighbours", F.transform("neighbours", lambda n: n["vec"])
    )
    copied = repeat_rows(parents, "copies", "copy")
    pick = unit_interval(keyed_hash(seed, F.col("id"), F.col("copy"), "pick"))
    drawn = copied.select(
        "id", "label", "copy", "vec",
        F.element_at("neighbours", (F.floor(pick * F.size("neighbours")) + 1).cast("int")).alias("other"),
        unit_interval(keyed_hash(seed, F.col("id"), F.col("copy"), "step")).alias("step"),
    )
    placed = drawn.withColumn("new", F.zip_with("vec", "other", lambda a, b: a + F.col("step") * (b - a)))
    return placed.select(
        F.concat_ws("~", F.col("id").cast("string"), F.col("copy").cast("string")).alias(row_id),
        *[F.element_at("new", i + 1).alias(f) for i, f in enumerate(features)],
        F.col("label").cast(df.schema[label].dataType).alias(label),
        F.lit(True).alias("is_synthetic"),
    )


def adasyn(
    df: DataFrame, row_id: str, features: list[str], label: str,
    k: int = NEIGHBOURS, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, str | None]:
    """``(table with is_synthetic, reason)``; the table is unchanged when a reason is given.

    Row ids become text, generated rows being named after their parent.
    """
    original = df.select(
        col(row_id).cast("string").alias(row_id), *[col(f).cast("double").alias(f) for f in features], col(label), F.lit(False).alias("is_synthetic")
    )
    allocation = adasyn_allocation(df, row_id, features, label, k, block_rows)
    if allocation.rows is None:
        return original, allocation.reason
    return original.unionByName(synthetic_rows(df, row_id, features, label, allocation, k, seed, block_rows)), None


def class_counts_before_after(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """``(stage, label, n)``."""

    def counted(table: DataFrame, stage: str) -> DataFrame:
        return table.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), label, "n")

    return counted(before, "before").unionByName(counted(after, "after"))
