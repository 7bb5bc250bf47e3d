import random

import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
import pytest

from steadyseed.functions.metrics import all_metrics, check_binary_labels, classification_metrics, score
from steadyseed.functions.ranking import area_under_curve


@pytest.fixture(scope="module")
def preds(spark):
    return spark.range(500).selectExpr(
        "1 AS seed", "CAST(id % 3 = 0 AS DOUBLE) AS label", "CAST(id % 3 = 0 AND id % 4 <> 0 OR id % 11 = 0 AS DOUBLE) AS prediction"
    ).cache()


def value(df, kind, metric, **more):
    return score(df, kind, metric, **more).first()["score"]


@pytest.mark.parametrize("metric,theirs", [
    ("accuracy", "accuracy"), ("precision", "precisionByLabel"), ("recall", "recallByLabel"), ("f1", "fMeasureByLabel"),
])
def test_classification(preds, metric, theirs):
    expected = MulticlassClassificationEvaluator(metricName=theirs, metricLabel=1.0).evaluate(preds)
    assert abs(value(preds, "classification", metric) - expected) < 1e-12


@pytest.mark.parametrize("metric", ["mae", "rmse", "r2"])
def test_regression(spark, metric):
    df = spark.range(300).selectExpr("1 AS seed", "id * 1.5D AS label", "id * 1.4D + sin(id) AS prediction")
    assert abs(value(df, "regression", metric) - RegressionEvaluator(metricName=metric).evaluate(df)) < 1e-9


def test_undefined_is_zero(spark):
    none_said = spark.sql("SELECT * FROM VALUES (1, 1D, 0D), (1, 0D, 0D) AS t(seed, label, prediction)")
    none_there = spark.sql("SELECT * FROM VALUES (1, 0D, 1D), (1, 0D, 0D) AS t(seed, label, prediction)")
    for metric in ("precision", "recall", "f1"):
        assert value(none_said, "classification", metric) == 0.0
        assert value(none_there, "classification", metric) == 0.0


def test_constant_target(spark):
    exact = spark.sql("SELECT * FROM VALUES (1, 2D, 2D), (1, 2D, 2D) AS t(seed, label, prediction)")
    wrong = spark.sql("SELECT * FROM VALUES (1, 2D, 2D), (1, 2D, 3D) AS t(seed, label, prediction)")
    assert value(exact, "regression", "r2") == 1.0 and value(wrong, "regression", "r2") == 0.0


def test_defaults_and_errors(preds):
    assert score(preds, "classification").first()["score"] == value(preds, "classification", "accuracy")
    with pytest.raises(ValueError):
        score(preds, "classification", "rmse")
    check_binary_labels([1, 2], "f1")
    check_binary_labels([0, 1, 2], "accuracy")
    check_binary_labels([0, 1, 2], "f1", "macro")
    for labels in ([0, 1, 2], [2, 3]):
        with pytest.raises(ValueError):
            check_binary_labels(labels, "f1")
    assert set(all_metrics(preds, "classification").columns) == {"accuracy", "precision", "recall", "f1"}


def test_macro(spark):
    df = spark.range(400).selectExpr("1 AS seed", "CAST(id % 3 AS DOUBLE) AS label", "CAST(id % 5 % 3 AS DOUBLE) AS prediction")
    each = [MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=float(c)).evaluate(df) for c in range(3)]
    assert abs(value(df, "classification", "f1", average="macro") - sum(each) / 3) < 1e-12


def test_all_metrics_over_three_classes(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0), (1, 1)], "label bigint, prediction bigint")
    row = all_metrics(preds, "classification", average="macro").first()
    assert abs(row.accuracy - 4 / 6) < 1e-12
    assert abs(row.recall - (1 / 2 + 1 + 1 / 2) / 3) < 1e-12
    assert abs(row.precision - (1 / 2 + 2 / 3 + 1) / 3) < 1e-12


def test_area_under_curve_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, 0, 1, 1]), rng.choice([None, -0.0, 0.0, 0.5, 0.5, float("nan"), rng.random()])) for _ in range(400)]
    rows += [("one", 1, 0.3), ("one", 1, 0.2), (None, 1, 2.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    place = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s + 0.0)
    for parts in (1, 7):
        got = {r.g: r for r in area_under_curve(df.repartition(parts), ["g"]).collect()}
        assert set(got) == {"a", "b", "one", None} and got["one"].auc is None and got[None].auc == 1.0
        for g in ("a", "b"):
            yes = [place(s) for x, y, s in rows if x == g and y == 1]
            no = [place(s) for x, y, s in rows if x == g and y != 1]
            assert got[g].auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no))
    assert area_under_curve(df.limit(0), ["g"]).count() == 0


def test_agreement_of_several_classes(spark):
    rng = random.Random(4)
    rows = [(1, float(y), float(y if rng.random() < 0.6 else rng.randrange(4))) for y in (rng.randrange(4) for _ in range(300))] + [(2, 1.0, 1.0)] * 3
    got = {r.seed: r for r in classification_metrics(spark.createDataFrame(rows, "seed int, label double, prediction double"), ["seed"], "macro").collect()}
    pairs = [(y, p) for s, y, p in rows if s == 1]
    n, hits = len(pairs), sum(y == p for y, p in pairs)
    chance = sum(sum(y == c for y, _ in pairs) * sum(p == c for _, p in pairs) for c in range(4))
    assert got[1].kappa == pytest.approx((hits / n - chance / n**2) / (1 - chance / n**2))
    y, p = np.eye(4)[[int(a) for a, _ in pairs]], np.eye(4)[[int(b) for _, b in pairs]]
    cov = lambda a, b: sum(np.cov(a[:, c], b[:, c], bias=True)[0, 1] for c in range(4))
    assert got[1].mcc == pytest.approx(cov(y, p) / (cov(y, y) * cov(p, p)) ** 0.5)
    assert (got[2].accuracy, got[2].kappa, got[2].mcc) == (1.0, 0.0, 0.0)
