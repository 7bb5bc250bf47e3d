import hashlib
import math

from pyspark.sql import functions as F
import pytest

from steadyseed.operators import split


def brute(ids, seed, quota):
    ranked = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return set(ranked[:quota])


def table(spark, n=1000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("y"))


def test_quotas():
    assert split.quotas({None: 10}) == {None: 3}
    assert split.quotas({None: 1001}) == {None: 301}
    assert split.quotas({0: 5, 1: 5}) == {0: 2, 1: 1}
    for sizes in ({0: 13, 1: 7, 2: 101}, {"a": 2, "b": 2}, {"a": 999, "b": 2}):
        total = sum(sizes.values())
        found = split.quotas(sizes)
        assert sum(found.values()) == math.ceil(total * 3 / 10)
        assert all(abs(found[c] - 0.3 * n) < 1 for c, n in sizes.items())


@pytest.mark.parametrize("ranked_rows", [10, 60, 10**6])
def test_split_is_the_hash_ranking(spark, ranked_rows):
    df = table(spark)
    ids = [r["id"] for r in df.collect()]
    got = split.assign_split(df, "id", [1, 5], ranked_rows=ranked_rows)
    assert got.count() == 2000
    for seed in (1, 5):
        assert {r["id"] for r in got.where((F.col("seed") == seed) & F.col("is_test")).collect()} == brute(ids, seed, 300)


@pytest.mark.parametrize("ranked_rows", [10, 10**6])
def test_stratified_split(spark, ranked_rows):
    df = table(spark)
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r["y"], []).append(r["id"])
    quota = split.quotas({c: len(v) for c, v in sorted(by_class.items())})
    for parts in (1, 9):
        got = split.assign_split(df.repartition(parts), "id", [2], stratify="y", ranked_rows=ranked_rows)
        for c, ids in by_class.items():
            chosen = {r["id"] for r in got.where((F.col("y") == c) & F.col("is_test")).collect()}
            assert chosen == brute(ids, 2, quota[c])


def test_split_errors(spark):
    with pytest.raises(ValueError, match="two rows per class"):
        split.assign_split(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b') AS t(id, y)"), "id", [1], stratify="y")
    with pytest.raises(ValueError, match="missing"):
        split.class_sizes(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL) AS t(id, y)"), "y")


def test_parts_by_cutoffs(spark):
    df = table(spark, 400).where("y <> 'b'")
    sizes = split.class_sizes(df, "y")
    ranks = {c: [10, 10, 50] for c in sizes}
    cutoffs = split.collect_cutoffs(split.hash_cutoffs(df, "id", [3], ranks, "y", ranked_rows=20))[3]
    counted = df.groupBy("y", split.part_column(3, "id", "y", cutoffs, 3).alias("p")).count().collect()
    found = {(r["y"], r["p"]): r["count"] for r in counted}
    assert found == {(c, p): n for c in sizes for p, n in ((0, 10), (2, 40), (3, sizes[c] - 50))}


def test_many_classes_are_split(spark):
    df = spark.range(36_000).select("id", (F.col("id") % 12_000).alias("y"))
    sizes = split.class_sizes(df, "y")
    assert len(sizes) == 12_000 and sum(split.quotas(sizes).values()) == 10_800


def test_quotas_of_many_classes_stay_in_tables(spark, monkeypatch):
    """Joined quotas and cutoffs give the split of the collected ones, with a hot class and ties of remainders."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).alias("y"), F.lit("x").alias("other"))
    want = split.assign_split(df, "id", [1, 4], stratify="y").collect()
    sizes = split.class_sizes(df, "y")
    table = spark.createDataFrame(list(sizes.items()), "class bigint, n bigint")
    assert {r["class"]: r["rank"] for r in split.quota_table(table, 3000).collect()} == split.quotas(sizes)
    huge = spark.createDataFrame([(1, 10**15), (2, 10**15 + 1)], "class bigint, n bigint")
    assert {r["class"]: r["rank"] for r in split.quota_table(huge, 2 * 10**15 + 1).collect()} == split.quotas({1: 10**15, 2: 10**15 + 1})
    monkeypatch.setattr(split, "MAX_LOOKUP_ROWS", 50)
    monkeypatch.setattr(split, "HOT_ROWS", 100)
    for ranked_rows in (20, 10**6):
        got = split.assign_split(df, "id", [1, 4], stratify="y", ranked_rows=ranked_rows)
        assert got.columns == ["id", "y", "other", "seed", "is_test"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    with pytest.raises(ValueError, match="two rows per class"):
        split.assign_split(df.unionByName(spark.sql("SELECT 9999L AS id, -1L AS y, 'x' AS other")), "id", [1], stratify="y")
    with pytest.raises(ValueError, match="missing"):
        split.assign_split(df.unionByName(spark.sql("SELECT 9999L AS id, NULL AS y, 'x' AS other")), "id", [1], stratify="y")


def test_many_classes_are_ranked_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_LOOKUP_ROWS", 10)
    # an id twice, and one class that is too large to be ranked by one task
    df = spark.range(3000).select(F.when(F.col("id") < 20, 7).otherwise(F.col("id")).alias("id"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 60).alias("c"))
    found = {n: split.assign_split(df, "id", [1, 2], stratify="c", ranked_rows=n) for n in (100, 10_000)}
    tally = lambda t: sorted(map(tuple, t.groupBy(*t.columns).count().collect()))
    monkeypatch.setattr(split, "MAX_LOOKUP_ROWS", 10_000)
    few = split.assign_split(df, "id", [1, 2], stratify="c")
    assert tally(found[100]) == tally(found[10_000]) == tally(few.select(*found[100].columns))
    plan = found[10_000]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") > 0 and "__salt" not in plan


def test_the_hash_of_a_row_is_made_once_for_all_folds(spark):
    df = spark.range(200).withColumn("label", F.lit(1))
    rows = [r["h"] for r in df.select(F.md5(F.concat_ws(":", F.lit("3"), F.col("id"))).alias("h")).orderBy("h").collect()]
    cutoffs = {1: {i: rows[20 * (i + 1)] for i in range(8)}}
    part = split.part_column(3, "id", "label", cutoffs, 9)
    got = df.select(F.md5(F.concat_ws(":", F.lit("3"), F.col("id"))).alias("h"), part.alias("part"))
    plan = df.select(part.alias("part"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    for r in got.collect():
        assert r["part"] == next((i for i in range(8) if r["h"] <= rows[20 * (i + 1)]), 9)


@pytest.mark.parametrize("stratify", [None, "c"])
def test_the_readers_of_a_split_do_not_look_for_its_cutoffs_again(spark, stratify):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("c"))
    found = split.assign_split(df, "id", [1, 2], stratify=stratify, ranked_rows=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert {(r["seed"], r["n"]) for r in found.where("is_test").groupBy("seed").agg(F.count("id").alias("n")).collect()} == {(1, 90), (2, 90)}
