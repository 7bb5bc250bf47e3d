"""A part of the registered queries beside their SQL; check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from steadyseed.operators import leaderboard
from steadyseed.plans import analysis

SAMPLE = [
    "column_profile_orders", "suggest_targets_labels", "categorical_suggestions_all_rules", "validate_categorical_configs",
    "class_imbalance_toxic", "numeric_target_statistics_orders", "target_histogram", "one_hot_encode", "impute_mean",
    "adasyn", "assign_split_stratified", "baseline_sweep_orders", "summarize_accuracy", "rank_leaderboard", "read_csv",
    "mean_error_stability",
]


@pytest.fixture(scope="module")
def con(tables):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, tables, name):
    df = entry.queries()[name](spark, tables)
    result = con.execute(entry.oracle_sql()[name])
    described = {c[0]: str(c[1]) for c in result.description}
    truth = [dict(zip(described, r, strict=True)) for r in result.fetchall()]
    assert compare([r.asDict() for r in df.collect()], dict(df.dtypes), truth, described) is None
    assert truth


def test_the_comparison_notices():
    types, duck = {"a": "bigint"}, {"a": "BIGINT"}
    assert compare([{"a": 1}], types, [{"a": 1}], duck) is None
    assert compare([{"a": 1}], types, [{"a": 2}], duck)
    assert compare([{"a": 1}], types, [], duck)
    assert compare([{"a": 1}], types, [{"b": 1}], {"b": "BIGINT"})
    assert compare([{"a": 1}], types, [{"a": 1}], {"a": "INTEGER"})


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_embedding_is_asked_about(spark, tmp_path):
    # ids, labels and dimensions beyond those of the given tables
    vectors = [(7 * i, 5 + i % 9, [0.0] * 64 + [float(i * i % 31), float(i % 4)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()["neighbour_shares_embeddings"](spark, str(tmp_path))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        truth = connection.execute(entry.oracle_sql()["neighbour_shares_embeddings"]).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(truth)
    assert sorted(r[0] for r in truth) == [v[0] for v in vectors]


def test_comparisons_and_the_analysis_are_whole(spark, tables, monkeypatch):
    asked = []

    def compare_models(df, *args, **settings):
        asked.append(settings)
        return spark.createDataFrame([("Baseline", 1.0)], "model string, seconds double")

    def run_analysis(df, cfg, *args, **settings):
        asked.append(settings)
        assert not cfg.skip_leaderboard and not cfg.skip_report and cfg.trees == leaderboard.TREES
        return {"ranking": spark.createDataFrame([(1, 0.5)], "seed int, score double"), "leaderboard": spark.createDataFrame([("Baseline", 9.0)], "model string, seconds double")}

    monkeypatch.setattr(leaderboard, "compare_models", compare_models)
    monkeypatch.setattr(analysis, "run_analysis", run_analysis)
    for name in ("compare_models_classification", "compare_models_regression"):
        assert entry.queries()[name](spark, tables).columns == ["model"]
    rows = {(r.part, r.row) for r in entry.queries()["run_analysis"](spark, tables).collect()}
    assert rows == {("ranking", '{"seed":1,"score":0.5}'), ("leaderboard", '{"model":"Baseline"}')}
    assert asked == [{}, {}, {}]  # all families, folds and trees


def test_the_seeds_of_all_roles_are_compared_by_all_families(spark, tables, monkeypatch):
    asked = []

    def compared(df, row_id, features, label, problem_type, seeds, *settings):
        asked.append((features, problem_type, settings))
        return spark.createDataFrame([(s, "Baseline", 1.0, 2.0, 0.5, 1.0, "") for s in seeds], "seed int, model string, mae double, rmse double, r2 double, seconds double, error string")

    monkeypatch.setattr(leaderboard, "_compared", compared)
    found = entry.queries()["compare_models_for_seeds"](spark, tables).collect()
    assert sorted(r.seed_role for r in found) == sorted(leaderboard.ROLES)
    assert asked == [(["l_extendedprice", "l_discount", "l_tax"], "regression", (None, leaderboard.FOLDS, leaderboard.TREES, 8, None))]
