import pytest
from pyspark.sql import functions as F

from steadyseed.functions.inline import inline_rows
from steadyseed.operators import suggest
from steadyseed.operators.profile import column_profile

CASES = [
    (["Yes", " no "], "ordinal", "Binary classification pattern detected: ['yes', 'no']"),
    (["1", "0"], "ordinal", "Binary classification pattern detected: ['0', '1']"),
    (["medium", "LOW"], "ordinal", "Ordinal pattern detected: ['low', 'medium', 'high']"),
    (["good", "excellent"], "ordinal", "Ordinal pattern detected: ['poor', 'fair', 'good', 'excellent']"),
    (["good", "bad"], "ordinal", "Binary classification pattern detected: ['good', 'bad']"),
    (["low"], "nominal", "Many categories (1) - likely nominal"),
    (["S", "XL", "m"], "ordinal", suggest.REASON_SIZE),
    (["A", "f"], "ordinal", suggest.REASON_GRADE),
    (["1.5", "1_000", "-2e3", "inf"], "ordinal", suggest.REASON_NUMBER),
    (["1d", "2d"], "ordinal", suggest.REASON_TWO),
    (["jan", "March"], "ordinal", suggest.REASON_MONTH),
    (["mon", "Sunday"], "ordinal", suggest.REASON_WEEKDAY),
    (["cat", "dog"], "ordinal", suggest.REASON_TWO),
    (["a1", "b1", "c1"], "ordinal", "Small number of categories (3) - likely ordinal"),
    (["a1", "b1", "c1", "d1", "e1", "f1", "g1"], "ordinal", "Small number of categories (7) - likely ordinal"),
    (["a1", "b1", "c1", "d1", "e1", "f1", "g1", "h1"], "nominal", "Many categories (8) - likely nominal"),
    (["odd"], "nominal", "Many categories (1) - likely nominal"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    df = inline_rows(spark, [(i, v) for i, (v, _, _) in enumerate(CASES)], {"i": "int", "v": "array<string>"})
    rule = suggest.classify_values(F.col("v"), F.size("v").cast("bigint"))
    return {r["i"]: r["r"] for r in df.select("i", rule.alias("r")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(verdicts, i):
    assert (verdicts[i]["suggested_type"], verdicts[i]["reasoning"]) == CASES[i][1:]


def profile_rows(spark, rows):
    schema = {
        "column_name": "string", "position": "int", "kind": "string", "distinct_ratio": "double", "is_zero_one": "boolean",
    }
    return inline_rows(spark, rows, schema)


def test_targets_and_removals(spark):
    prof = profile_rows(spark, [
        ("width", 0, "numeric", 0.1, False), ("Sale_PRICE", 1, "numeric", 0.9, False), ("flag", 2, "numeric", 0.1, True),
        ("note", 3, "categorical", 0.8, False), ("memo", 4, "categorical", 0.81, False), ("rating", 5, "numeric", 0.1, False),
        ("class", 6, "categorical", 0.1, False), ("cost", 7, "numeric", 0.1, False), ("loss", 8, "numeric", 0.1, False),
    ])
    targets = [r["column_name"] for r in suggest.suggest_targets(prof).collect()]
    assert targets == ["Sale_PRICE", "flag", "rating", "class", "cost"]
    assert suggest.default_target(prof).first()["column_name"] == "cost"
    assert sorted(r["column_name"] for r in suggest.suggest_removals(prof).collect()) == ["memo", "width"]


def test_suggestions_of_a_table(spark):
    df = spark.createDataFrame(
        [(i, "yes" if i % 2 else "no", f"v{i % 21}", f"w{i % 20}", None) for i in range(100)],
        "id int, answer string, many string, twenty string, none string",
    )
    found = {r["variable_name"]: r for r in suggest.suggest_categorical_types(df, "id").collect()}
    assert set(found) == {"answer", "twenty"}
    assert found["twenty"]["unique_values"] == [f"w{i}" for i in range(20)]
    configs = suggest.default_categorical_configs(suggest.suggest_categorical_types(df, "id")).collect()
    assert [(r["variable_name"], r["value_ordering"]) for r in configs] == [("answer", ["no", "yes"])]
    assert column_profile(df, "id").count() == 5
