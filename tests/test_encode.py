import datetime
from pathlib import Path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from steadyseed.config import CategoricalConfig, ensure_checkpoint_dir
from steadyseed.operators import encode, impute


def people(spark):
    return spark.createDataFrame(
        [
            (1, "b", "low", True, 1.5, datetime.date(2024, 1, 1), [1.0, 2.0]),
            (2, "a", "high", False, None, None, [1.0, 3.0]),
            (3, None, "odd", None, float("nan"), None, [0.0, 0.0]),
        ],
        "id int, city string, level string, member boolean, pay double, born date, vec array<double>",
    )


def test_index_target(spark):
    rows = encode.index_target(people(spark).select("id", "level"), "level").collect()
    assert {r["id"]: r["label"] for r in rows} == {1: 1, 2: 0, 3: 2}
    whole = spark.sql("SELECT * FROM VALUES (1, 7), (2, 3) AS t(id, y)")
    assert {r["label"] for r in encode.index_target(whole, "y").collect()} == {7, 3}
    halves = spark.sql("SELECT * FROM VALUES (1, 0.5D), (2, 1.5D) AS t(id, y)")
    assert sorted(r["label"] for r in encode.index_target(halves, "y").collect()) == [0, 1]
    with pytest.raises(ValueError, match="missing values"):
        encode.index_target(people(spark), "city")
    assert encode.index_target(people(spark), "city", "drop").count() == 2


def test_many_classes_take_the_distributed_way(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_LOOKUP_ROWS", 5)
    df = spark.range(100).select("id", F.format_string("k%03d", F.col("id") % 50).alias("y"))
    rows = encode.index_target(df, "y", row_id="id").collect()
    assert len(rows) == 100 and all(r["label"] == r["id"] % 50 for r in rows)
    auto = encode.ordinal_encode_auto(df.withColumn("y", F.expr("nullif(y, 'k003')")), "y", "id")
    assert auto.select("y").distinct().count() == 50


def test_coerce_numeric_target(spark):
    text = spark.sql("SELECT * FROM VALUES (1, ' 1.5 '), (2, '2') AS t(id, y)")
    assert sorted(r["label"] for r in encode.coerce_numeric_target(text, "y").collect()) == [1.5, 2.0]
    for bad in ("SELECT 1 AS id, '1d' AS y", "SELECT 1 AS id, 'x' AS y", "SELECT 1 AS id, double('NaN') AS y"):
        with pytest.raises(ValueError):
            encode.coerce_numeric_target(spark.sql(bad), "y")


def test_ordinal(spark):
    df = people(spark)
    by_id = {r["id"]: r["level"] for r in encode.ordinal_encode(df, "level", ["low", "high", "low"]).collect()}
    assert by_id == {1: 2.0, 2: 1.0, 3: None}
    auto = {r["id"]: r["city"] for r in encode.ordinal_encode_auto(df, "city").collect()}
    assert auto == {1: 1.0, 2: 0.0, 3: 2.0}


def test_one_hot(spark):
    df = encode.one_hot_encode(people(spark).select("id", "city", "level"), ["city", "level"])
    assert df.columns == ["id", "city_a", "city_b", "city_nan", "level_high", "level_low", "level_odd"]
    assert [tuple(r)[1:4] for r in df.orderBy("id").collect()] == [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)]
    wide = encode.one_hot_encode(people(spark).select("id", "city"), ["city"], max_categories=2)
    rows = wide.select("id", vector_to_array("city_onehot").alias("v")).orderBy("id").collect()
    assert [r["v"] for r in rows] == [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def test_odd_column_names(spark):
    df = spark.sql("SELECT 1 AS id, 'x y' AS `a.b c`, 2.0D AS `d``e`")
    found = encode.encode_features(df, ["id"])
    assert found.features == ["d`e", "a.b c_x y"]
    assert found.table.first()["a.b c_x y"] == 1.0


def test_encode_features(spark):
    configs = [CategoricalConfig("level", "ordinal", ["low", "high"]), CategoricalConfig("pay", "ordinal", ["1"])]
    found = encode.encode_features(people(spark), ["id"], configs)
    assert found.features == ["level", "member", "pay", "vec", "city_a", "city_b", "city_nan"]
    assert [f[2] for f in found.findings] == ["born"]
    row = found.table.where("id = 3").first()
    assert row["level"] is None and row["member"] is None and row["pay"] is None and row["city_nan"] == 1.0
    seconds = encode.epoch_seconds(people(spark), ["born"]).where("id = 1").first()["born"]
    assert seconds == 1704067200.0


def gaps(spark, n=200):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 5 != 0, F.col("id") * 2.0).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") * 3.0 + 1).alias("b"),
        (F.col("id") * 1.0).alias("c"), F.lit(None).cast("double").alias("empty"),
    )


def test_impute_mean(spark):
    df = gaps(spark)
    filled, found = impute.impute_mean(df, ["a", "b", "c", "empty"])
    assert filled.columns == ["id", "a", "b", "c"] and [f[2] for f in found] == ["empty"]
    mean = df.agg(F.avg("a")).first()[0]
    assert filled.where("id = 5").first()["a"] == mean
    assert filled.where("a IS NULL OR b IS NULL").isEmpty()


@pytest.mark.parametrize("estimator", ["linear", "forest", "extra"])
def test_impute_iterative(spark, estimator):
    df = gaps(spark)
    filled, _ = impute.impute_iterative(df, ["a", "b", "c", "empty"], "id", max_iter=3, estimator=estimator)
    assert filled.columns == ["id", "a", "b", "c"]
    assert filled.count() == 200 and filled.where("a IS NULL OR b IS NULL").isEmpty()
    kept = filled.join(df.select("id", F.col("a").alias("a0")), "id").where("a0 IS NOT NULL AND a <> a0")
    assert kept.isEmpty()
    # The two columns determine each other, so the guesses beat the mean by far.
    error = filled.where("id % 5 = 0 AND id % 7 <> 0").agg(F.avg(F.abs(F.col("a") - F.col("id") * 2))).first()[0]
    assert error < (1.0 if estimator == "linear" else 40.0)


def test_impute_iterative_edge_cases(spark):
    lone = gaps(spark).select("id", "a", "c")
    filled, _ = impute.impute_iterative(lone, ["a", "c"], "id")
    assert filled.where("id = 5").first()["a"] == lone.agg(F.avg("a")).first()[0]
    informed, _ = impute.impute_iterative(lone, ["a", "c"], "id", max_iter=2, estimator="linear", predictors="all")
    assert abs(informed.where("id = 5").first()["a"] - 10.0) < 1e-6
    three = gaps(spark).withColumn("d", F.when(F.col("id") % 4 != 0, F.col("id") * 0.5))
    out, _ = impute.impute_iterative(three, ["a", "b", "d"], "id", max_iter=2, estimator="linear")
    assert out.where("a IS NULL OR b IS NULL OR d IS NULL").isEmpty()


def test_impute_keeps_the_last_round_only(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("rdd-*"))
    out, _ = impute.impute_iterative(gaps(spark), ["a", "b"], "id", max_iter=3, estimator="linear", tolerance=0.0)
    assert len(set(folder.glob("rdd-*")) - before) == 1
    assert out.where("a IS NOT NULL AND b IS NOT NULL").count() == 200


def test_impute_does_not_depend_on_partitions(spark):
    runs = []
    for parts in (1, 6):
        out, _ = impute.impute_iterative(gaps(spark).repartition(parts), ["a", "b"], "id", max_iter=2)
        runs.append({r["id"]: (round(r["a"], 9), round(r["b"], 9)) for r in out.collect()})
    assert runs[0] == runs[1]


def test_category_names_never_clash(spark):
    rows = [(1, "Yes", "nan", "b_c", "c"), (2, "yes", None, "x", "d"), (3, "no", "b", "x", "c")]
    df = spark.createDataFrame(rows, "id int, ans string, a string, `a_b` string, `A_nan` string")
    hot = encode.one_hot_encode(df, ["ans", "a", "a_b", "A_nan"])
    assert len({c.lower() for c in hot.columns}) == len(hot.columns)
    got = {r["id"]: r for r in hot.collect()}
    assert (got[1]["ans_Yes"], got[1]["ans_yes_2"], got[2]["ans_Yes"], got[2]["ans_yes_2"]) == (1.0, 0.0, 0.0, 1.0)
    missing = next(c for c in hot.columns if c.lower().startswith("a_nan"))
    assert [got[i][missing] for i in (1, 2, 3)] == [1.0, 1.0, 0.0]  # NULL and the text nan are one category


def test_many_categories_keep_their_shape(spark):
    df = spark.range(600).select("id", F.concat(F.lit("v"), F.col("id") % 300).alias("kind"))
    hot = encode.one_hot_encode(df, ["kind"])
    assert len(hot.columns) == 301
    assert hot.agg(F.sum("kind_v7")).first()[0] == 2


def test_codes_are_the_same_by_either_way(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 700).alias("t"))
    few = sorted((r.label, r.n) for r in encode.index_target(df, "t").groupBy("label").agg(F.count("*").alias("n")).collect())
    monkeypatch.setattr(encode, "MAX_LOOKUP_ROWS", 50)
    many = sorted((r.label, r.n) for r in encode.index_target(df, "t").groupBy("label").agg(F.count("*").alias("n")).collect())
    assert few == many and [x for x, _ in few] == list(range(700))


def test_one_vector_for_all_categories(spark):
    rows = [(1, "b", "x", 5.0), (2, None, "y", 6.0), (3, "nan", "x", 7.0), (4, "a", "", 8.0), (4, "a", "", 8.0)]
    df = spark.createDataFrame(rows, "id int, city string, `a b` string, pay double")
    found = encode.encode_features(df, ["id"], layout="vector")
    assert found.features == ["pay", "onehot"] and found.numeric == ["pay"]
    names = {(r["column_name"], r["value"]): r["code"] for r in found.dictionary.collect()}
    cities = ["a", "b", "nan"]
    blank = encode.category_text(df, "a b")
    others = sorted((r[0] for r in df.select(blank).distinct().collect()), key=lambda v: (v == "nan", v))
    order = [("city", v) for v in cities] + [("a b", v) for v in others]
    assert names == {key: i for i, key in enumerate(order)}
    got = sorted((r["id"], [int(i) for i in r["onehot"].indices], r["onehot"].size) for r in found.table.collect())
    wanted = sorted(
        (r["id"], [names[("city", r["c"])], names[("a b", r["o"])]], len(names))
        for r in df.select("id", encode.category_text(df, "city").alias("c"), blank.alias("o")).collect()
    )
    assert got == wanted
    assembled = VectorAssembler(inputCols=found.features, outputCol="features").transform(found.table)
    assert assembled.where("id = 2").first()["features"].size == len(names) + 1


def test_large_dictionaries_give_the_same_vectors(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 700)).alias("kind"))
    few = {r["id"]: r["onehot"] for r in encode.one_hot_vector(df, ["kind"], row_id="id")[0].collect()}
    monkeypatch.setattr(encode, "MAX_LOOKUP_ROWS", 50)
    for row_id in (None, "id"):
        many = {r["id"]: r["onehot"] for r in encode.one_hot_vector(df, ["kind"], row_id=row_id)[0].collect()}
        assert many == few and len(few) == 3000
    assert few[3].indices[0] == few[3].size - 1 == 700


def test_vector_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, onehot string, kind string")
    table, dictionary = encode.one_hot_vector(empty, ["kind"])
    assert table.columns == ["id", "onehot", "onehot_2"] and table.isEmpty() and dictionary.isEmpty()
    none, _ = encode.one_hot_vector(spark.range(2), [])
    assert [r["onehot"].size for r in none.collect()] == [0, 0]
    with pytest.raises(ValueError, match="layout"):
        encode.encode_features(empty, ["id"], layout="rows")
