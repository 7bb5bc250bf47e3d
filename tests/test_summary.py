import numpy as np
import pytest

from steadyseed.config import AnalysisConfig
from steadyseed.operators import leaderboard, report, summary
from steadyseed.operators.sweep import seed_results


def results(spark, scores):
    return seed_results(spark, dict(enumerate(scores, start=1)))


def test_ties(spark):
    df = results(spark, [0.5, 0.9, 0.9, 0.1, 0.1, 0.5])
    up = summary.summarize(df, "accuracy").first()
    assert (up["best_seed"], up["best_score"], up["worst_seed"], up["worst_score"]) == (2, 0.9, 4, 0.1)
    assert up["most_common_score"] == 0.5 and up["common_seeds"] == [1, 6] and up["higher_is_better"]
    down = summary.summarize(df, "rmse").first()
    assert (down["best_seed"], down["worst_seed"]) == (4, 2) and not down["higher_is_better"]
    assert abs(up["standard_deviation"] - np.std([0.5, 0.9, 0.9, 0.1, 0.1, 0.5])) < 1e-12
    assert summary.score_range_width(summary.summarize(df, "f1")).first()[0] == pytest.approx(0.8)


def test_equal_scores(spark):
    df = results(spark, [0.25] * 4)
    row = summary.summarize(df, "mae").first()
    assert (row["best_seed"], row["worst_seed"], row["common_seeds"], row["standard_deviation"]) == (1, 1, [1, 2, 3, 4], 0.0)
    rows = sorted(summary.score_histogram(df).collect())
    assert len(rows) == 20 and rows[0]["lo"] == -0.25 and rows[-1]["hi"] == 0.75 and sum(r["n"] for r in rows) == 4


def test_ranking_and_series(spark):
    df = results(spark, [0.2, 0.4, 0.4, 0.1])
    up = [(r["seed"], r["tag"]) for r in summary.rank_seeds(df, "r2").orderBy("rank").collect()]
    assert up == [(2, "best"), (3, None), (1, None), (4, "worst")]
    down = [r["seed"] for r in summary.rank_seeds(df, "mae").orderBy("rank").collect()]
    assert down == [4, 1, 2, 3]
    series = summary.score_series(df, "r2").collect()
    assert [r["seed"] for r in series] == [1, 2, 3, 4] and {(r["common_score"], r["best_seed"], r["worst_seed"]) for r in series} == {(0.4, 2, 4)}


def test_histogram_and_modal_bin(spark):
    scores = [0.0, 0.02, 0.04, 0.51, 0.52, 0.53, 1.0]
    hist = summary.score_histogram(results(spark, scores))
    counts, edges = np.histogram(scores, bins=20)
    assert [r["n"] for r in sorted(hist.collect())] == list(counts)
    first = int(np.argmax(counts))
    assert summary.modal_bin_center(hist).first()[0] == pytest.approx((edges[first] + edges[first + 1]) / 2)


def test_leaderboard_ranking(spark):
    rows = [("Best", f"m{i:02d}", 0.5 if i < 2 else i / 100, float(i)) for i in range(12)]
    board = spark.createDataFrame(rows, "seed_role string, model string, accuracy double, f1 double")
    ranked = leaderboard.rank_leaderboard(board, "accuracy")
    assert ranked.columns == ["seed_role", "model", "Accuracy", "F1", "rank", "selected"]
    order = [r["model"] for r in ranked.orderBy("rank").collect()]
    assert order[:3] == ["m00", "m01", "m11"] and ranked.where("selected").count() == 10 and ranked.count() == 12
    assert leaderboard.top_models(ranked).count() == 5
    picked = leaderboard.pick_leaderboard_seeds(summary.summarize(results(spark, [0.2, 0.4, 0.4, 0.1]), "f1")).collect()
    assert [tuple(r) for r in picked] == [("Best", 2), ("Worst", 4), ("Most_Common", 2)]


def test_record_and_report(spark):
    df = results(spark, [0.2, 0.4, 0.4])
    found = summary.summarize(df, "f1")
    cfg = AnalysisConfig("y", "classification", "f1", iterations=10, remove_columns=["id"])
    record = report.analysis_record(df, found, cfg, 1.5).first()
    assert record["status"] == "completed" and record["analysis_config"]["remove_columns"] == ["id"]
    assert [(r["seed"], r["score"]) for r in record["seed_results"]] == [(1, 0.2), (2, 0.4), (3, 0.4)]
    board = spark.createDataFrame([("Best", f"m{i}", i / 10) for i in range(7)], "seed_role string, model string, f1 double")
    lines = report.stability_report(found, "classification", "y", "f1", 10, leaderboard.rank_leaderboard(board, "f1"))
    texts = {r["section"]: r["text"] for r in report.report_text(lines).collect()}
    assert "Best Seed: 2 -> 0.4000" in texts["Findings"]
    assert texts["Best Seed - Top 5 Models"].split("\n")[0] == "m6 F1=0.6000"
    assert len(texts["Best Seed - Top 5 Models"].split("\n")) == 5
