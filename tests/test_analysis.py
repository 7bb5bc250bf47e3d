"""The four documented scenarios, end to end on small hand-made tables."""

import numpy as np

from steadyseed import AnalysisConfig, CategoricalConfig
from steadyseed.operators.report import report_text
from steadyseed.plans import analysis
from steadyseed.sources import write_leaderboards, write_results


def loans(spark, n=160):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        income = float(rng.normal(50, 15))
        rows.append((f"c{i}", f"2024-01-{i % 28 + 1:02d}", None if i % 9 == 0 else income, ["full", "part", "none"][i % 3], "yes" if income > 38 else "no"))
    return spark.createDataFrame(rows, "customer_id string, application_date string, income double, employment string, approved string")


def test_loan_approval(spark, tmp_path):
    df = loans(spark)
    cfg = AnalysisConfig(
        "approved", "classification", "precision", iterations=10, remove_columns=["customer_id", "application_date"],
        id_col="customer_id", trees=3, max_depth=3,
    )
    out = analysis.run_analysis(df, cfg, leaderboard_models=["Logistic Regression", "Baseline"], folds=2)
    data = out["processed"]
    assert {"income", "employment_full", "label", "is_synthetic"} <= set(data.columns) and "customer_id" not in data.columns
    # 80 % say yes, so the advice is to oversample.
    assert data.where("is_synthetic").count() > 0 and data.where("income IS NULL").isEmpty()
    assert out["seed_results"].count() == 10 and out["ranking"].first()["rank"] == 1
    assert {r["seed_role"] for r in out["leaderboard"].collect()} == {"Best", "Worst", "Most_Common"}
    assert report_text(out["report"]).count() == 4
    write_leaderboards(out["leaderboard"], str(tmp_path / "lb"))
    write_results({k: out[k] for k in ("seed_results", "summary", "analysis_record")}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/summary")).first()["best_score"] >= spark.read.parquet(str(tmp_path / "r/summary")).first()["worst_score"]


def test_house_price(spark):
    rng = np.random.default_rng(2)
    grades = ["poor", "fair", "good", "excellent"]
    rows = [
        (f"p{i}", None if i % 8 == 0 else float(a), None if i % 11 == 0 else int(a // 20), grades[i % 4], float(a * 3 + 10 * (i % 4)))
        for i, a in enumerate(rng.uniform(40, 200, 120))
    ]
    df = spark.createDataFrame(rows, "property_id string, area double, rooms int, condition string, sale_price double")
    cfg = AnalysisConfig(
        "sale_price", "regression", "rmse", iterations=10, remove_columns=["property_id"], impute_method="iterative",
        categorical_configs=[CategoricalConfig("condition", "ordinal", grades)], trees=3, skip_leaderboard=True, skip_report=True,
    )
    out = analysis.run_analysis(df, cfg)
    assert set(out["processed"].columns) == {"row_id", "area", "rooms", "condition", "label", "is_synthetic"}
    summary = out["summary"].first()
    assert summary["best_score"] <= summary["mean_score"] <= summary["worst_score"] and not summary["higher_is_better"]
    assert "leaderboard" not in out and "report" not in out


def test_churn_train_only(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", "basic" if i % 3 else "plus", float(rng.normal(1 if i % 6 == 0 else 0)), int(i % 6 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "customer_id string, plan string, usage double, churned int")
    cfg = AnalysisConfig(
        "churned", "classification", "recall", iterations=10, remove_columns=["customer_id"], id_col="customer_id",
        oversample=True, oversample_scope="train_only", trees=2, max_depth=2, skip_leaderboard=True,
    )
    data = analysis.process_data(df, cfg)
    assert not data.oversampled and data.table.count() == 120
    cfg.oversample_scope = "all"
    assert analysis.process_data(df, cfg).table.count() > 150


def test_diagnosis_needs_macro(spark):
    rows = [(20 + i % 50, "abcdf"[i % 5], float(i % 13), ["x", "y", "z"][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "age int, grade string, marker double, diagnosis string")
    cfg = AnalysisConfig("diagnosis", "classification", "f1", iterations=10, skip_leaderboard=True, trees=2)
    out = analysis.run_analysis(df, cfg)
    assert "macro" in [r["message"] for r in out["findings"].collect() if r["severity"] == "error"][0]
    cfg.average = "macro"
    assert analysis.run_analysis(df, cfg)["seed_results"].count() == 10


def test_invalid_configuration_returns_findings(spark):
    out = analysis.run_analysis(loans(spark), AnalysisConfig("nope", "classification"))
    assert set(out) == {"findings"} and out["findings"].count() == 1


def test_describe_table(spark):
    out = analysis.describe_table(loans(spark))
    assert [r["column_name"] for r in out["suggested_targets"].collect()] == ["approved"]
    assert {r["column_name"] for r in out["suggested_removals"].collect()} == {"customer_id"}
    assert {r["variable_name"] for r in out["default_configs"].collect()} == {"employment", "approved"}
    assert out["preview"].count() == 5
