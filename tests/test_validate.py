import pytest

from steadyseed.config import AnalysisConfig, CategoricalConfig
from steadyseed.operators import validate


def messages(found):
    return sorted((r["severity"], r["check"], r["message"]) for r in found.collect())


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, ["low", "mid", "high"][i % 3], float(i), i % 2, f"x{i}") for i in range(60)]
    return spark.createDataFrame(rows, "id int, level string, amount double, flag int, text string").cache()


def test_categorical_configs(df):
    good = CategoricalConfig("level", "ordinal", ["low", "mid", "high"])
    valid, found = validate.validate_categorical_configs(df, [
        good, CategoricalConfig("gone", "nominal"), CategoricalConfig("amount", "nominal"),
        CategoricalConfig("level", "ordinal", ["low", "top"]), CategoricalConfig("level", "ordinal"),
        CategoricalConfig("text", "nominal", ["ignored"]),
    ])
    assert valid == [good, CategoricalConfig("level", "ordinal"), CategoricalConfig("text", "nominal", ["ignored"])]
    texts = [m[2] for m in messages(found)]
    assert "Column 'gone' not found in dataset" in texts and "Column 'amount' is numeric, not categorical" in texts


def test_ordering_missing_and_extra(df):
    valid, found = validate.validate_categorical_configs(df, [CategoricalConfig("level", "ordinal", ["low", "top", "mid"])])
    assert valid == []
    assert [m[2] for m in messages(found)] == [
        "Extra values in ordering for 'level': top", "Missing values in ordering for 'level': high",
    ]
    many = CategoricalConfig("text", "ordinal", ["x0", "y"])
    shown = [m[2] for m in messages(validate.validate_categorical_configs(df, [many])[1])]
    others = ", ".join(sorted(f"x{i}" for i in range(1, 60)))
    assert shown == ["Extra values in ordering for 'text': y", f"Missing values in ordering for 'text': {others}"]
    repeated = CategoricalConfig("level", "ordinal", ["low", "mid", "high", "low"])
    assert validate.validate_categorical_configs(df, [repeated])[0] == [repeated]


def test_target_checks_end_at_once(df):
    assert validate.validate_configuration(df, AnalysisConfig("nope", "classification"))[0] is False
    valid, found = validate.validate_configuration(df, AnalysisConfig("flag", "classification", remove_columns=["flag"]))
    assert not valid and [m[1] for m in messages(found)] == ["target"]


def test_class_counts(df):
    valid, found = validate.validate_configuration(df, AnalysisConfig("text", "classification"))
    assert valid and any(m[1] == "class_count" and m[0] == "warning" for m in messages(found))
    one = df.where("flag = 1")
    valid, found = validate.validate_configuration(one, AnalysisConfig("flag", "classification"))
    assert not valid
    assert {m[1] for m in messages(found)} == {"class_count", "row_count"}


def test_regression_target(spark, df):
    assert not validate.validate_configuration(df, AnalysisConfig("level", "regression"))[0]
    numbers = df.selectExpr("id", "level", "flag", "text", "cast(amount as string) as amount")
    assert validate.validate_configuration(numbers, AnalysisConfig("amount", "regression"))[0]


def test_features_and_settings(df):
    cfg = AnalysisConfig("flag", "classification", remove_columns=["id", "text", "text", "unknown"])
    valid, found = validate.validate_configuration(df, cfg)
    assert valid and {m[1] for m in messages(found)} == {"removals", "feature_count"}
    none_left = AnalysisConfig("flag", "classification", remove_columns=["id", "text", "level", "amount"])
    assert not validate.validate_configuration(df, none_left)[0]
    for bad in (
        AnalysisConfig("flag", "classification", metric="rmse"), AnalysisConfig("flag", "classification", iterations=9),
        AnalysisConfig("flag", "classification", iterations=1001), AnalysisConfig("flag", "clustering"),
        AnalysisConfig("flag", "classification", impute_method="median"),
    ):
        assert not validate.validate_configuration(df, bad)[0]
    with pytest.raises(ValueError):
        CategoricalConfig("level", "cyclic")
