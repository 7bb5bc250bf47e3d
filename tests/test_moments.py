import numpy as np
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.sql import functions as F
import pytest

from steadyseed.operators import forest, leaderboard, moments
from steadyseed.plans import fixtures as fx

PRICES = ["l_extendedprice", "l_discount", "l_tax"]


def folded(spark, tables, problem, folds=3):
    df = (fx.net if problem == "regression" else fx.big)(spark, tables)
    rows = forest.assemble(df, "row_id", PRICES, "label")
    return rows.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(folds)).cast("int") + 1).repartition(5, "row_id")


def test_moments_merge_and_subtract():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 3, (500, 4))
    a, b, whole = moments._of(x[:120]), moments._of(x[120:]), moments._of(x)
    for got, want in ((moments.merged(a, b), whole), (moments.without(whole, a), b)):
        assert got[0] == want[0]
        assert got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2], rel=1e-8, abs=1e-4)
    assert moments.without(whole, whole)[0] == 0


def test_moments_of_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 3))
    rows = spark.createDataFrame([(float(i % 4), [float(v) for v in r]) for i, r in enumerate(x)], "part double, values array<double>")
    for partitions in (1, 9):
        got = {r["part"]: r for r in moments.moments(rows.repartition(9), ["part"], partitions).collect()}
        for part in range(4):
            want = moments._of(x[part::4])
            assert got[part]["n"] == 100 and got[part]["mean"] == pytest.approx(want[1])
            assert np.array(got[part]["scatter"]).reshape(3, 3) == pytest.approx(want[2])


def mllib():
    y, exact = {"labelCol": "label"}, {"tol": 1e-14, "maxIter": 1000}
    return {
        "Linear Regression": mlr.LinearRegression(**y),
        "Ridge Regression": mlr.LinearRegression(regParam=1.0, elasticNetParam=0.0, **y),
        "Lasso Regression": mlr.LinearRegression(regParam=1.0, elasticNetParam=1.0, **exact, **y),
        "Elastic Net": mlr.LinearRegression(regParam=1.0, elasticNetParam=0.5, **exact, **y),
        "Generalized Linear Regression": mlr.GeneralizedLinearRegression(family="gaussian", **y),
    }


def test_linear_families_are_those_of_mllib(spark, tables):
    rows = folded(spark, tables, "regression").withColumn("label", F.col("label") / 1000).persist()
    models, errors = moments.fit_folds(rows, "regression", list(moments.REGRESSION), 5, 3)
    assert not errors and len(models) == 3 * len(moments.REGRESSION)
    for name, estimator in mllib().items():
        own = estimator.fit(rows.where("part <> 2"))
        assert models[name, 2]["coefficients"] == pytest.approx(own.coefficients.toArray(), rel=1e-6, abs=1e-9), name
        assert models[name, 2]["intercept"] == pytest.approx(own.intercept, rel=1e-6), name
    rows.unpersist()


def test_bayes_is_that_of_mllib(spark, tables):
    rows = folded(spark, tables, "classification")
    models, _ = moments.fit_folds(rows, "classification", list(moments.CLASSIFICATION), 5, 3)
    own = mlc.NaiveBayes(modelType="gaussian", labelCol="label").fit(rows.where("part <> 1"))
    want = {r["row_id"]: r["prediction"] for r in own.transform(rows.where("part = 1")).collect()}
    x = np.array([r["features"].toArray() for r in rows.where("part = 1").orderBy("row_id").collect()])
    got = moments.predict(models["Naive Bayes", 1], x)
    assert [want[i] for i in sorted(want)] == list(got)


def plain_discriminants(x, y, new):
    """Predictions of both discriminants by densities written out."""
    classes = sorted(set(y))
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in classes) / (len(y) - len(classes))
    linear, quadratic = [], []
    for c in classes:
        d, prior = new - x[y == c].mean(0), np.log((y == c).mean())
        own = np.cov(x[y == c].T)
        linear.append(prior - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(pooled), d))
        quadratic.append(prior - 0.5 * np.log(np.linalg.det(own)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d))
    return [np.array(classes)[np.array(s).argmax(0)] for s in (linear, quadratic)]


def test_discriminants_of_three_classes(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 600).astype(float)
    x = rng.normal(0, 1, (600, 2)) * (1 + y[:, None]) + y[:, None]
    rows = spark.createDataFrame([(i, float(a), float(b), c, i % 2 + 1) for i, ((a, b), c) in enumerate(zip(x, y.tolist(), strict=True))], "id int, a double, b double, label double, part int")
    made = forest.assemble(rows, "id", ["a", "b"], "label").join(rows.select(F.col("id").alias("row_id"), "part"), "row_id")
    models, errors = moments.fit_folds(made, "classification", list(moments.CLASSIFICATION), 4, 2)
    assert not errors
    odd = np.arange(600) % 2 == 1
    linear, quadratic = plain_discriminants(x[~odd], y[~odd], x[odd])
    assert (moments.predict(models["Linear Discriminant Analysis", 2], x[odd]) == linear).all()
    assert (moments.predict(models["Quadratic Discriminant Analysis", 2], x[odd]) == quadratic).all()
    # ridge on 1 and -1, with an intercept that is not penalised
    design = x[~odd] - x[~odd].mean(0)
    values = []
    for c in (0, 1, 2):
        t = np.where(y[~odd] == c, 1.0, -1.0)
        w = np.linalg.solve(design.T @ design + np.eye(2), design.T @ (t - t.mean()))
        values.append((x[odd] - x[~odd].mean(0)) @ w + t.mean())
    assert (moments.predict(models["Ridge Classifier", 2], x[odd]) == np.array(values).argmax(0)).all()
    scored = moments.predictions(made, models)
    assert scored.count() == 600 * len(moments.CLASSIFICATION)


def test_constant_columns_and_labels(spark):
    rows = spark.range(60).selectExpr("id AS row_id", "CAST(id % 7 AS DOUBLE) AS a", "5D AS b", "2D AS flat", "CAST(id % 2 AS DOUBLE) AS two", "CAST(id % 3 + 1 AS INT) AS part")
    for label in ("flat", "a"):
        made = forest.assemble(rows, "row_id", ["a", "b"], label).join(rows.select("row_id", "part"), "row_id")
        models, errors = moments.fit_folds(made, "regression", list(moments.REGRESSION), 1, 3)
        assert not errors
        assert all(np.isfinite(m["coefficients"]).all() and m["coefficients"][1] == 0 for m in models.values())
        if label == "flat":
            assert all(m["intercept"] == pytest.approx(2.0) for m in models.values())
    made = forest.assemble(rows, "row_id", ["a", "b"], "two").join(rows.select("row_id", "part"), "row_id")
    models, errors = moments.fit_folds(made, "classification", list(moments.CLASSIFICATION), 1, 3)
    assert not errors
    assert all(np.isfinite(moments.predict(m, np.array([[1.0, 5.0], [2.0, 5.0]]))).all() for m in models.values())


def test_rows_of_each_key_are_added_up_in_their_order(spark):
    rows = spark.range(0, 3000, 1, 3).selectExpr("pmod(id * 7, 5) AS part", "pmod(id, 3) AS label", "array(CAST(id AS DOUBLE), CAST(pmod(id * 11, 17) AS DOUBLE)) AS values")
    found = {(r["part"], r["label"]): r for r in moments.moments(rows, ["part", "label"], 3).collect()}
    plain = rows.collect()
    assert len(found) == 15
    for key, r in found.items():
        own = np.array([p["values"] for p in plain if (p["part"], p["label"]) == key])
        assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean(axis=0))
        assert np.array(r["scatter"]).reshape(2, 2) / len(own) == pytest.approx(np.cov(own.T, bias=True))
