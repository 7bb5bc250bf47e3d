import datetime

from pyspark.sql import functions as F

from steadyseed.operators import profile
from steadyseed.sources import load_table


def sample(spark):
    return spark.createDataFrame(
        [
            (1, 0.0, "b", True, datetime.date(2024, 1, 1), 1),
            (2, -0.0, "a", False, None, 0),
            (3, float("nan"), None, None, datetime.date(2024, 1, 1), 1),
            (4, None, "b", True, datetime.date(2024, 1, 2), 0),
        ],
        "id int, x double, s string, b boolean, d date, z int",
    )


def test_profile(spark):
    rows = {r["column_name"]: r for r in profile.column_profile(sample(spark), "id").collect()}
    assert [rows[c]["kind"] for c in ("id", "x", "s", "b", "d")] == ["numeric", "numeric", "categorical", "numeric", "datetime"]
    assert [rows[c]["missing"] for c in ("id", "x", "s", "b", "d")] == [0, 2, 1, 1, 1]
    assert [rows[c]["distinct"] for c in ("id", "x", "s", "b", "d", "z")] == [4, 1, 2, 2, 2, 2]
    assert rows["s"]["values"] == ["b", "a"]
    assert rows["d"]["values"] == ["2024-01-01", "2024-01-02"]
    assert rows["id"]["values"] is None
    assert [c for c in rows if rows[c]["is_zero_one"]] == ["b", "z"]
    assert rows["z"]["position"] == 5 and rows["z"]["rows"] == 4 and rows["z"]["distinct_ratio"] == 0.5


def test_values_without_a_key_are_in_text_order_and_capped(spark):
    listed = {r["column_name"]: r["values"] for r in profile.distinct_values(sample(spark)).collect()}
    assert listed["s"] == ["a", "b"]
    assert not profile.distinct_values(sample(spark), max_values=1).collect()
    empty = spark.sql("SELECT CAST(NULL AS STRING) AS s")
    assert profile.distinct_values(empty).first()["values"] == []


def test_empty_table_has_ratio_zero(spark):
    rows = profile.distinct_counts(sample(spark).where("id < 0")).collect()
    assert {(r["distinct"], r["distinct_ratio"]) for r in rows} == {(0, 0.0)}


def test_counts_do_not_depend_on_partitions(spark, tables):
    df = load_table(spark, f"{tables}/lineitem.parquet")
    expected = {r["column_name"]: r["distinct"] for r in profile.distinct_counts(df).collect()}
    assert expected["l_returnflag"] == 3
    for parts in (1, 16):
        again = {r["column_name"]: r["distinct"] for r in profile.distinct_counts(df.repartition(parts)).collect()}
        assert again == expected


def test_long_texts_and_nested_columns(spark):
    df = spark.range(10).select(
        F.concat(F.repeat(F.lit("x"), 100), (F.col("id") % 4).cast("string")).alias("t"), F.array("id").alias("a")
    )
    assert {r["column_name"]: r["distinct"] for r in profile.distinct_counts(df).collect()} == {"t": 4, "a": 10}


def test_preview_and_missing(spark):
    rows = profile.preview(sample(spark), "id", 2).collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[1]["d"] == ""
    assert profile.preview(sample(spark), n=3).count() == 3
    assert profile.total_missing(sample(spark)).first()[0] == 5


def test_values_are_listed_up_to_the_limit_exactly(spark):
    rows = spark.range(2000).selectExpr(
        "id", *[f"concat('v', id % {n}) AS c{n}" for n in (1, 19, 20, 21, 40, 41, 60, 500, 2000)], "CAST(NULL AS STRING) AS gone"
    )
    listed = {r["column_name"]: r for r in profile.distinct_values(rows, "id").collect()}
    assert {c: r["unique_count"] for c, r in listed.items()} == {"c1": 1, "c19": 19, "c20": 20, "gone": 0}
    assert listed["c20"]["values"] == [f"v{i}" for i in range(20)] and listed["gone"]["values"] == []
    wide = {r["column_name"]: r["unique_count"] for r in profile.distinct_values(rows, "id", max_values=500).collect()}
    assert wide["c500"] == 500 and wide["c60"] == 60 and "c2000" not in wide
