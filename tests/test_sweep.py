from pyspark.sql import functions as F
import pytest

from steadyseed.operators import forest, leaderboard, split, sweep
from steadyseed.plans import fixtures as fx

FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


def scores(df):
    return {r["seed"]: r["score"] for r in df.collect()}


def test_baseline_sweep_by_hand(spark):
    df = spark.range(100).select("id", (F.col("id") * 1.0).alias("y"))
    parts = split.assign_split(df, "id", [1, 2]).collect()
    got = scores(sweep.baseline_sweep(df, "id", "y", "regression", [1, 2]))
    for seed in (1, 2):
        train = [r["y"] for r in parts if r["seed"] == seed and not r["is_test"]]
        test = [r["y"] for r in parts if r["seed"] == seed and r["is_test"]]
        mean = sum(train) / len(train)
        assert got[seed] == pytest.approx(sum(abs(v - mean) for v in test) / len(test))
    assert scores(sweep.seed_sweep(df, "id", [], "y", "regression", [1, 2], kind="baseline")) == pytest.approx(got)


def test_majority_tie_goes_to_the_smaller_label(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1D), (1, 0D), (1, 2D), (1, 0D), (1, 1D) AS t(seed, label)")
    assert forest.baseline_value(rows, "classification").first()["prediction"] == 0.0


def test_forest_learns_and_ignores_input_layout(spark, tables):
    df = fx.net(spark, tables)
    runs = [
        scores(sweep.seed_sweep(df.repartition(parts), "row_id", FEATURES, "label", "regression", [1, 2, 3], "r2", trees=5))
        for parts in (1, 7)
    ]
    assert min(runs[0].values()) > 0.95
    assert runs[0] == pytest.approx(runs[1], abs=1e-9)


def test_classifier_with_other_labels(spark, tables):
    df = fx.big(spark, tables).withColumn("label", F.col("label") + 1)
    got = scores(sweep.seed_sweep(df, "row_id", FEATURES, "label", "classification", [1], "f1", trees=5))
    # 1, the smaller label, is the positive one.
    assert got[1] > 0.9
    shifted = df.withColumn("label", F.col("label") + 1)
    with pytest.raises(ValueError, match="positive label"):
        sweep.seed_sweep(shifted, "row_id", FEATURES, "label", "classification", [1], "f1", trees=5)
    assert scores(sweep.seed_sweep(shifted, "row_id", FEATURES, "label", "classification", [1], trees=5))[1] > 0.9


def test_multiclass(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    with pytest.raises(ValueError, match="two classes"):
        sweep.seed_sweep(df, "vec_id", ["embedding"], "label", "classification", [1], "precision", trees=3)
    got = scores(sweep.seed_sweep(df, "vec_id", ["embedding"], "label", "classification", [1], "f1", trees=3, average="macro"))
    assert 0 <= got[1] <= 1


def test_train_only_oversampling(spark, tables):
    df = fx.toxic(spark, tables).select("doc_id", "n_chars", "quality", "toxic")
    got = scores(sweep.seed_sweep(
        df, "doc_id", ["n_chars", "quality"], "toxic", "classification", [1], "recall", trees=3, oversample_train=True))
    assert 0 <= got[1] <= 1


def test_fit_predict_alone(spark, tables):
    rows = forest.assemble(fx.net(spark, tables), "row_id", FEATURES, "label")
    parts = split.assign_split(rows, "row_id", [4]).drop("seed")
    train, test = parts.where(~F.col("is_test")), parts.where("is_test")
    one = forest.fit_predict(train, test, "regression", trees=3).collect()
    two = forest.fit_predict(train.repartition(9), test, "regression", trees=3).collect()
    assert {r["row_id"]: r["prediction"] for r in one} == pytest.approx({r["row_id"]: r["prediction"] for r in two})
    flat = forest.fit_predict(train, test, "regression", kind="baseline")
    assert flat.select("prediction").distinct().count() == 1


def test_compare_models(spark, tables):
    df = fx.net(spark, tables)
    found = leaderboard.compare_models(
        df, "row_id", FEATURES, "label", "regression", 1, "rmse", folds=2, trees=3,
        models=["Linear Regression", "Decision Tree Regressor", "Baseline"],
    ).collect()
    assert [r["model"] for r in found][-1] == "Baseline" and all(r["error"] is None for r in found)
    assert found[-1]["r2"] < 0.05 < found[0]["r2"]


def test_a_failing_family_is_a_row(spark, tables, monkeypatch):
    class Broken:
        def copy(self):
            return self

        def fit(self, rows):
            raise RuntimeError("no")

    monkeypatch.setattr(leaderboard, "families", lambda *a, **k: {"Broken": Broken()})
    found = {r["model"]: r for r in leaderboard.compare_models(
        fx.big(spark, tables), "row_id", FEATURES, "label", "classification", 1, folds=2).collect()}
    assert found["Broken"]["error"] == "no" and found["Broken"]["accuracy"] is None
    assert found["Baseline"]["error"] is None


def test_all_classification_families_run(spark, tables):
    df = fx.big(spark, tables).limit(300)
    found = leaderboard.compare_models(df, "row_id", FEATURES, "label", "classification", 2, folds=2, trees=2).collect()
    assert len(found) == 15
    assert [r["model"] for r in found if r["error"]] == []


def test_all_regression_families_run(spark, tables):
    df = fx.net(spark, tables).limit(300)
    found = leaderboard.compare_models(df, "row_id", FEATURES, "label", "regression", 2, folds=2, trees=2).collect()
    assert len(found) == 13
    assert [r["model"] for r in found if r["error"]] == []


@pytest.mark.parametrize(("problem", "cells"), [("classification", 1), ("classification", 100), ("regression", 70)])
def test_no_family_is_left_out_where_matrices_are_large(spark, tables, monkeypatch, problem, cells):
    df = (fx.big if problem == "classification" else fx.net)(spark, tables).limit(400).persist()
    models = list(leaderboard.moments.families(problem))
    roles = spark.sql("SELECT * FROM VALUES ('Best', 3), ('Worst', 1) AS t(seed_role, seed)")
    metric = leaderboard.default_metric(problem)

    def compared():
        found = leaderboard.compare_models_for_seeds(df, "row_id", FEATURES, "label", problem, roles, models=models, folds=4).collect()
        assert len(found) == 2 * len(models) and not any(r["error"] for r in found)
        return {(r["seed"], r["model"]): r[metric] for r in found}

    whole = compared()
    monkeypatch.setattr(leaderboard.moments, "MOST_CELLS", cells)
    assert compared() == pytest.approx(whole, rel=1e-6)
    df.unpersist()


def test_seeds_compared_together_are_those_compared_alone(spark, tables):
    df = fx.big(spark, tables).limit(400).persist()
    models = ["Random Forest Classifier", "Extra Trees Classifier", "Ada Boost Classifier", "Linear Discriminant Analysis", "Decision Tree Classifier", "Baseline"]
    roles = spark.sql("SELECT * FROM VALUES ('Best', 3), ('Worst', 1), ('Most_Common', 3) AS t(seed_role, seed)")
    settings = {"models": models, "folds": 3, "trees": 3}
    together = leaderboard.compare_models_for_seeds(df, "row_id", FEATURES, "label", "classification", roles, **settings).collect()
    assert len(together) == 3 * len(models) and not any(r["error"] for r in together)
    for role, seed in (("Best", 3), ("Worst", 1), ("Most_Common", 3)):
        alone = {r["model"]: r["accuracy"] for r in leaderboard.compare_models(
            df, "row_id", FEATURES, "label", "classification", seed, **settings).collect()}
        assert {r["model"]: r["accuracy"] for r in together if r["seed_role"] == role and r["seed"] == seed} == pytest.approx(alone)
    df.unpersist()


def test_progress_is_told(spark, tables):
    said = []
    sweep.seed_sweep(fx.net(spark, tables).limit(100), "row_id", FEATURES, "label", "regression", list(range(23)), trees=1, max_depth=1,
                     progress=lambda done, of: said.append((done, of)))
    assert said == [(20, 23), (23, 23)]
