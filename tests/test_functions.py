from pyspark.sql import functions as F

from steadyseed.functions.hashing import keyed_hash, repeat_rows, unit_interval, with_row_id
from steadyseed.functions.inline import inline_rows
from steadyseed.functions.skew import hot_keys, lookup_join


def test_row_id_numbers_exact_copies(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    for parts in (1, 7):
        ids = with_row_id(df.repartition(parts))
        assert ids.select("row_id").distinct().count() == 1000
    same = {r["row_id"] for r in with_row_id(df).collect()} == {r["row_id"] for r in with_row_id(df.repartition(5)).collect()}
    assert same


def test_repeat_rows_in_chunks(spark):
    df = inline_rows(spark, [("a", 25), ("b", 0), ("c", 1)], {"k": "string", "n": "bigint"})
    rows = repeat_rows(df, "n", "i", chunk=10).collect()
    assert sorted(r["i"] for r in rows if r["k"] == "a") == list(range(25))
    assert [r["i"] for r in rows if r["k"] == "c"] == [0]
    assert not [r for r in rows if r["k"] == "b"]


def test_unit_interval_is_uniform(spark):
    u = spark.range(5000).select(unit_interval(keyed_hash(7, F.col("id"))).alias("u"))
    row = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02 and abs(row[3] - 0.2887) < 0.02


def test_lookup_join_spreads_hot_keys(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 10)
    hot = hot_keys(rows, ["k"], at_least=100)
    assert [r["k"] for r in hot.collect()] == [-1]
    joined = lookup_join(rows, lookup, ["k"], "id", hot_at_least=100)
    assert joined.count() == 9000
    assert joined.where(F.col("v") != F.col("k") * 10).count() == 0


def test_inline_rows(spark):
    df = inline_rows(spark, [(1, None, ["a"]), (2, "x", [])], {"i": "int", "s": "string", "l": "array<string>"})
    assert df.dtypes == [("i", "int"), ("s", "string"), ("l", "array<string>")]
    assert df.count() == 2
    assert inline_rows(spark, [], {"i": "int", "s": "string"}).count() == 0
