import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadyseed.operators import target
from steadyseed.operators.quantiles import order_statistics, quantiles


def classes(spark, counts):
    parts = [spark.range(n).select(F.lit(c).alias("y")) for c, n in counts.items()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def test_imbalance_threshold(spark):
    assert target.class_imbalance(classes(spark, {"a": 60, "b": 40}), "y").first()["is_imbalanced"] is False
    row = target.class_imbalance(classes(spark, {"a": 39, "b": 61}), "y").first()
    assert row["is_imbalanced"] and row["majority_class"] == "b" and row["minority_class"] == "a"
    assert row["imbalance_ratio"] == 0.61 and row["majority_percentage"] == 61.0 and row["minority_percentage"] == 39.0
    assert row["class_distribution"] == {"a": 39, "b": 61}
    tie = target.class_imbalance(classes(spark, {"b": 50, "a": 50}), "y").first()
    assert (tie["majority_class"], tie["minority_class"]) == ("a", "b")
    for counts in ({"a": 5}, {"a": 5, "b": 5, "c": 5}):
        assert target.class_imbalance(classes(spark, counts), "y").isEmpty()


def test_advice_and_kind(spark):
    def advice(counts, kind="classification"):
        return tuple(target.oversampling_recommendation(classes(spark, counts), "y", kind).first())

    assert advice({"a": 61, "b": 39}) == (True, "Class imbalance detected (61.0% vs 39.0%). ADASYN recommended to balance classes.")
    assert advice({"a": 60, "b": 40}) == (False, "Classes are relatively balanced (60.0% vs 40.0%). ADASYN not necessary.")
    assert advice({"a": 1, "b": 1, "c": 9}) == (False, target.REASON_NOT_BINARY)
    assert advice({"a": 1}) == (False, target.REASON_NOT_BINARY)
    assert advice({"a": 1}, "regression") == (False, target.REASON_NOT_CLASSIFICATION)

    def kind(counts, problem="classification"):
        return tuple(target.class_imbalance_kind(classes(spark, counts), "y", problem).first())

    assert kind({"a": 61, "b": 39}) == (True, "binary")
    assert kind({"a": 60, "b": 40}) == (False, None)
    assert kind({"a": 60, "b": 4, "c": 1}) == (False, "multiclass")
    assert kind({"a": 60}) == (False, None)
    assert kind({"a": 60}, "regression") == (False, None)


def test_class_statistics_and_distribution(spark):
    df = classes(spark, {"c": 3, "a": 1, "b": 3}).unionByName(spark.range(4).select(F.lit(None).cast("string").alias("y")))
    row = target.class_statistics(df, "y").first()
    assert tuple(row) == (7, 3, "b", "a", "a", "c")
    assert [tuple(r) for r in target.class_distribution(df, "y").collect()] == [("a", 1, 14.29), ("b", 3, 42.86), ("c", 3, 42.86)]
    assert {r["chart_type"] for r in target.class_bars(df, "y").collect()} == {"histogram"}
    assert set(target.describe_target(df, "y", "classification")) == {"class_distribution", "class_statistics", "class_imbalance", "class_bars"}


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    # A third of the values are one and the same number.
    return np.concatenate([rng.exponential(10.0, 4000), np.full(2000, 7.25)])


def test_statistics_match_pandas(spark, skewed):
    s = pd.Series(skewed)
    df = spark.createDataFrame(pd.DataFrame({"y": skewed}))
    row = target.numeric_target_statistics(df, "y").first()
    expected = [len(s), s.mean(), s.median(), s.std(), s.min(), s.max(), s.quantile(0.25), s.quantile(0.75), s.skew(), s.kurt()]
    assert np.allclose(list(row), expected, rtol=1e-9)
    tiny = target.numeric_target_statistics(spark.createDataFrame([(1.0,), (2.0,)], "y double"), "y").first()
    assert tiny["skewness"] is None and tiny["kurtosis"] is None and tiny["median"] == 1.5


def test_order_statistics_narrow_brackets(spark, skewed):
    df = spark.createDataFrame(pd.DataFrame({"y": skewed}))
    ordered = np.sort(skewed)
    places = [0, 1, 17, 1500, 2999, 3000, 4500, 5998, 5999]
    for limit in (50, 700, 10**6):
        assert order_statistics(df, "y", places, len(skewed), limit) == {p: ordered[p] for p in places}
    assert np.allclose(quantiles(df, "y", [0.1, 0.5], len(skewed), 100), np.quantile(skewed, [0.1, 0.5]))


def test_histogram_matches_numpy(spark, skewed):
    df = spark.createDataFrame(pd.DataFrame({"y": skewed}))
    rows = sorted(target.target_histogram(df, "y").collect())
    counts, edges = np.histogram(skewed, bins=50)
    assert [r["n"] for r in rows] == list(counts)
    assert np.allclose([r["lo"] for r in rows], edges[:-1])
    for n, bins in ((100, 10), (300, 15)):
        assert target.target_histogram(spark.range(n).selectExpr("id AS y"), "y").count() == bins
    constant = target.target_histogram(spark.range(30).selectExpr("5 AS y"), "y").collect()
    assert sum(r["n"] for r in constant) == 30 and min(r["lo"] for r in constant) == 4.5 and max(r["hi"] for r in constant) == 5.5
    assert target.target_histogram(spark.range(0).selectExpr("id AS y"), "y").isEmpty()
