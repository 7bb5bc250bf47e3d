"""Exact, repeatable train/test splits and folds without sorting the table.

A row's place in the split of a seed is the rank of ``md5(seed:row_id)``. Instead
of ranking all rows, the hash value at each needed rank is found (a *cutoff*);
which side a row is on is then a comparison. Finding the cutoffs takes a count
per hash prefix, combined map-side, and a ranking of only those rows that share
the prefix in which a cutoff falls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.config import MAX_LOOKUP_ROWS, TEST_SHARE
from steadyseed.functions.hashing import keyed_hash
from steadyseed.functions.inline import inline_rows
from steadyseed.functions.numbering import numbered
from steadyseed.functions.skew import HOT_KEYS_AT_MOST, HOT_ROWS, lookup_join

# Rows of one seed and class that a single ranking task should receive, and the
# hex digits of the hash that may be used to get there (16 million prefixes, enough for 8e11 rows).
RANKED_ROWS = 50_000
MAX_DIGITS = 6


def class_sizes(df: DataFrame, label: str | None) -> dict:
    """Rows per class (key None without a class column); one small row per class reaches the driver."""
    if label is None:
        return {None: df.count()}
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r[label]: r["n"] for r in counted}
    if None in sizes:
        raise ValueError("the label holds missing values")
    return dict(sorted(sizes.items()))


def quotas(sizes: dict, share: float = TEST_SHARE) -> dict:
    """Test rows per class: exact shares rounded by largest remainder, ties to the smaller label."""
    total = sum(sizes.values())
    # Integer arithmetic on millionths keeps the ceiling exact (0.3 is not a binary fraction).
    millionths = round(share * 1_000_000)
    wanted = -(-total * millionths // 1_000_000)
    exact = {c: divmod(wanted * n, total) if total else (0, 0) for c, n in sizes.items()}
    taken = {c: whole for c, (whole, _) in exact.items()}
    spare = wanted - sum(taken.values())
    place = {c: i for i, c in enumerate(sizes)}
    for c in sorted(sizes, key=lambda c: (-exact[c][1], place[c]))[:spare]:
        taken[c] += 1
    return taken


def quota_table(sizes: DataFrame, total: int, share: float = TEST_SHARE) -> DataFrame:
    """``quotas`` for any number of classes: ``(class, part, rank)`` from ``sizes`` (class, n), nothing collected.

    The spare rows go to the largest remainders; a class's place among them comes
    from numbering the classes by ranges, not from a sort in one task.
    """
    wanted = -(-total * round(share * 1_000_000) // 1_000_000)
    exact = F.col("n").cast("decimal(20,0)") * F.lit(wanted).cast("decimal(18,0)")
    # both are below the total, so they fit a bigint although the product does not
    shares = sizes.withColumn("exact", exact).selectExpr(
        "class", f"CAST(exact div {total} AS BIGINT) AS whole", f"CAST(exact % {total} AS BIGINT) AS rest"
    )
    placed = numbered(shares, [F.col("rest").desc(), F.col("class")], "place")
    spare = wanted - placed.agg(F.sum("whole")).first()[0]
    return placed.select("class", F.lit(0).alias("part"), (F.col("whole") + (F.col("place") < spare).cast("bigint")).alias("rank"))


def _prefix_length(rows: int, ranked_rows: int) -> int:
    return min(MAX_DIGITS, math.ceil(math.log(rows / ranked_rows, 16))) if rows > ranked_rows else 0


def hash_cutoffs(
    df: DataFrame,
    row_id: str,
    seeds: list[int],
    ranks: dict,
    label: str | None = None,
    ranked_rows: int = RANKED_ROWS,
    sizes: dict | None = None,
) -> DataFrame:
    """``(seed, class, part, cutoff)``: the hash at each 1-based rank of ``ranks[class]``.

    ``part`` numbers the ranks of a class; a rank of 0 has no cutoff row.
    """
    sizes = sizes or class_sizes(df, label)
    label_type = df.schema[label].dataType.simpleString() if label else "int"
    wanted = inline_rows(
        df.sparkSession,
        [(c, i, r) for c, rs in ranks.items() for i, r in enumerate(rs) if r > 0],
        {"class": label_type, "part": "int", "rank": "bigint"},
    )
    # At most one row per seed, class and rank.
    small = len(seeds) * sum(len(r) for r in ranks.values()) <= MAX_LOOKUP_ROWS
    return _cutoffs_at(df, row_id, seeds, F.broadcast(wanted), label, max(sizes.values(), default=0), ranked_rows, small)


def _cutoffs_at(
    df: DataFrame, row_id: str, seeds: list[int], wanted: DataFrame, label: str | None, largest: int, ranked_rows: int, small: bool
) -> DataFrame:
    """``hash_cutoffs`` for ``wanted`` (class, part, rank); ``small`` if it may be broadcast once per seed."""
    digits = _prefix_length(largest, ranked_rows)
    cls = F.col(label) if label else F.lit(None).cast("int")
    drawn = df.select(
        cls.alias("class"), F.col(row_id).alias("id"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    ).select("class", "seed", keyed_hash(F.col("seed"), F.col("id")).alias("hash"))
    drawn = drawn.withColumn("prefix", F.substring("hash", 1, digits) if digits else F.lit(""))
    if digits:
        by_prefix = Window.partitionBy("class", "seed").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        tallied = (
            drawn.groupBy("class", "seed", "prefix").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(by_prefix))
        )
        holds_rank = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
        holding = tallied.join(wanted, tallied["class"].eqNullSafe(wanted["class"]) & holds_rank).select(
            tallied["class"], "seed", "prefix", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("offset")
        )
    else:
        holding = wanted.select(
            "class", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), F.lit("").alias("prefix"),
            "part", F.col("rank").alias("offset"),
        )
    prefixes = holding.groupBy("class", "seed", "prefix").agg(F.collect_list(F.struct("part", "offset")).alias("parts"))
    if small:
        prefixes = F.broadcast(prefixes)
    near = drawn.alias("d").join(
        prefixes.alias("p"),
        F.col("d.class").eqNullSafe(F.col("p.class"))
        & (F.col("d.seed") == F.col("p.seed")) & (F.col("d.prefix") == F.col("p.prefix")),
    ).select("d.class", "d.seed", "d.prefix", "d.hash", "p.parts")
    place = F.row_number().over(Window.partitionBy("class", "seed", "prefix").orderBy("hash"))
    return (
        near.withColumn("place", place)
        .select("class", "seed", "hash", "place", F.inline("parts"))
        .where(F.col("place") == F.col("offset"))
        .select("seed", "class", "part", F.col("hash").alias("cutoff"))
    )


def check_stratified(sizes: dict) -> None:
    small = [str(c) for c, n in sizes.items() if n < 2]
    if small:
        raise ValueError(f"stratified split needs two rows per class; too few in {', '.join(small)}")


def assign_split(
    df: DataFrame,
    row_id: str,
    seeds: list[int],
    test_share: float = TEST_SHARE,
    stratify: str | None = None,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Every row once per seed with ``seed`` and ``is_test``.

    The test part has exactly ceil(share * n) rows; with ``stratify`` each class
    contributes its share of them. More classes than ``MAX_LOOKUP_ROWS`` stay in
    tables: sizes, quotas and cutoffs are joined, with the same result.
    """
    if stratify and df.select(stratify).distinct().limit(MAX_LOOKUP_ROWS + 1).count() > MAX_LOOKUP_ROWS:
        return _assign_many_classes(df, row_id, seeds, test_share, stratify, ranked_rows)
    sizes = class_sizes(df, stratify)
    if stratify:
        check_stratified(sizes)
    ranks = {c: [q] for c, q in quotas(sizes, test_share).items()}
    cutoffs = hash_cutoffs(df, row_id, seeds, ranks, stratify, ranked_rows, sizes)
    cutoffs = cutoffs.select("seed", "class", "cutoff")
    if len(seeds) * max(len(sizes), 1) <= MAX_LOOKUP_ROWS:
        # looked for once, not by every reader of the split
        kinds = {f.name: f.dataType.simpleString() for f in cutoffs.schema}
        cutoffs = F.broadcast(inline_rows(df.sparkSession, [tuple(r) for r in cutoffs.collect()], kinds))
    cutoffs = cutoffs.withColumnsRenamed({"seed": "__seed", "class": "__class"})
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    on = F.col("seed") == F.col("__seed")
    if stratify:
        on = on & (F.col(stratify) == F.col("__class"))
    is_test = F.coalesce(keyed_hash(F.col("seed"), F.col(row_id)) <= F.col("cutoff"), F.lit(False))
    return rows.join(cutoffs, on, "left").withColumn("is_test", is_test).drop("__seed", "__class", "cutoff")


def _assign_many_classes(df: DataFrame, row_id: str, seeds: list[int], test_share: float, stratify: str, ranked_rows: int) -> DataFrame:
    """``assign_split`` by joined tables.

    Rows of a class that one task can rank meet their quota and are ranked where they
    are, in one shuffle. Of larger classes the cutoffs are looked for, and rows of those
    with more than 1/1000 of the table are spread over salts.
    """
    sizes = df.groupBy(F.col(stratify).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total, largest, missing, small = sizes.agg(
        F.sum("n"), F.max("n"), F.count_if(F.col("class").isNull()), F.count_if(F.col("n") < 2)
    ).first()
    if missing:
        raise ValueError("the label holds missing values")
    if small:
        check_stratified({r["class"]: r["n"] for r in sizes.where(F.col("n") < 2).orderBy("class").limit(10).collect()})
    wanted = quota_table(sizes, total, test_share).where(F.col("rank") > 0)
    if largest <= ranked_rows:
        return _ranked_in_place(df, row_id, seeds, wanted, stratify)
    # at most one class per ``ranked_rows`` rows
    large = F.broadcast(sizes.where(F.col("n") > ranked_rows).select(F.col("class").alias(stratify)))
    ranked = _ranked_in_place(df.join(large, stratify, "left_anti").select(*df.columns), row_id, seeds, wanted, stratify)
    df = df.join(large, stratify, "left_semi").select(*df.columns)
    cutoffs = _cutoffs_at(df, row_id, seeds, wanted, stratify, largest, ranked_rows, small=False)
    cutoffs = cutoffs.select("seed", F.col("class").alias(stratify), F.col("cutoff").alias("__cutoff"))
    every_seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    hot = sizes.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS_AT_MOST)).select(F.col("class").alias(stratify), every_seed)
    rows = df.withColumn("seed", every_seed)
    found = lookup_join(rows, cutoffs, ["seed", stratify], row_id, "left", hot=hot)
    is_test = F.coalesce(keyed_hash(F.col("seed"), F.col(row_id)) <= F.col("__cutoff"), F.lit(False))
    return ranked.unionByName(found.select(*rows.columns, is_test.alias("is_test")))


def _ranked_in_place(df: DataFrame, row_id: str, seeds: list[int], wanted: DataFrame, stratify: str) -> DataFrame:
    """Every row with ``seed`` and ``is_test`` where a class has few rows; ``wanted`` is (class, rank). Equal hashes share a side."""
    quota = wanted.select(F.col("class").alias(stratify), F.col("rank").alias("__quota"))
    rows = df.join(quota, stratify, "left").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    place = F.rank().over(Window.partitionBy(stratify, "seed").orderBy(keyed_hash(F.col("seed"), F.col(row_id))))
    return rows.select(*df.columns, "seed", F.coalesce(place <= F.col("__quota"), F.lit(False)).alias("is_test"))


def collect_cutoffs(cutoffs: DataFrame) -> dict[int, dict]:
    """``{seed: {class: [cutoff per part]}}``; as many entries as seeds x classes x parts."""
    found: dict[int, dict] = {}
    for r in sorted(cutoffs.collect(), key=lambda r: r["part"]):
        found.setdefault(r["seed"], {}).setdefault(r["class"], {})[r["part"]] = r["cutoff"]
    return found


def part_column(seed: int, row_id: str, label: str | None, cutoffs: dict, parts: int) -> Column:
    """Which part (0..parts) of the seed's ranking a row falls in, as a comparison.

    Part ``i`` ends at cutoff ``i``; rows beyond the last cutoff are in ``parts``.
    """
    drawn = keyed_hash(seed, F.col(row_id))

    def within(bounds: dict) -> Column:
        known = sorted(bounds)

        def chosen(hashed: Column) -> Column:
            choice = F.when(hashed <= F.lit(bounds[known[0]]), F.lit(known[0]))
            for i in known[1:]:
                choice = choice.when(hashed <= F.lit(bounds[i]), F.lit(i))
            return choice.otherwise(F.lit(parts))

        if len(known) < 2:
            return chosen(drawn) if known else F.lit(parts)
        # the hash is made once, not once per cutoff
        return F.transform(F.array(drawn), chosen)[0]

    if label is None:
        return within(cutoffs.get(None, {}))
    choice = None
    for c, bounds in cutoffs.items():
        test = F.col(label) == F.lit(c)
        choice = F.when(test, within(bounds)) if choice is None else choice.when(test, within(bounds))
    return choice.otherwise(F.lit(parts)) if choice is not None else F.lit(parts)
