"""Filters, fills, duplicates: NULL, NaN, empty and odd-name cases."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fedloom.operators import clean, fill


def test_drop_null_counts_nan_as_missing(nulls):
    assert [r[0] for r in rows(clean.drop_null(nulls))] == [1, 5]
    assert [r[0] for r in rows(clean.drop_null(nulls, ["x"]))] == [1, 2, 5]


def test_outliers_drop_null_nan_and_far_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(1000.0,), (None,), (float("nan"),)], "x double")
    kept = [r[0] for r in rows(clean.remove_outliers(df, relative_error=0))]
    assert kept == [float(i) for i in range(1, 21)]


def test_outliers_need_values(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    with pytest.raises(ValueError, match="no values"):
        clean.remove_outliers(empty)


def test_outlier_bounds_come_from_one_input(spark):
    df = spark.createDataFrame([(float(i), float(100 * i if i == 9 else i)) for i in range(10)], "x double, y double")
    assert clean.remove_outliers(df, relative_error=0).count() == 9


def test_drop_column_and_unknown_column(odd):
    assert clean.drop_column(odd, "x.y").columns == ["a b", "t"]
    with pytest.raises(ValueError, match="not found"):
        clean.drop_column(odd, "nope")


def test_drop_duplicates_by_keeps_first_in_order(spark):
    df = spark.createDataFrame([("k", 3), ("k", 1), ("k", 2), ("m", 9)], "k string, v int")
    assert rows(clean.drop_duplicates_by(df, ["k"], [F.asc("v")])) == [("k", 1), ("m", 9)]
    assert clean.drop_duplicates_by(df, ["k"]).count() == 2


def test_drop_duplicates_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = clean.drop_duplicates_by(df, ["k"], [F.asc("v")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_fill_defaults(nulls):
    got = rows(fill.fill_defaults(nulls), "id")
    assert got[1] == (2, 0, 2.0, "b", False)
    assert got[2] == (3, 2, 0.0, "unknown", True)
    assert got[3] == (4, 5, 0.0, "a", False)


def test_fill_ignores_other_types(nulls):
    same = fill.fill_value(nulls, "Unknown", ["i", "s"])
    assert rows(same, "id")[2][3] == "Unknown"
    assert rows(same, "id")[1][1] is None


def test_fill_value_with_odd_names(odd):
    assert rows(fill.fill_value(odd, 0, ["x.y"]))[1][1] == 0


def test_mean_of_integers_is_truncated(nulls):
    got = rows(fill.impute(nulls, ["i", "x"], "mean"), "id")
    assert got[1][1] == 3  # 15 / 4
    assert math.isclose(got[2][2], 10 / 3) and math.isclose(got[3][2], 10 / 3)
    assert dict(fill.impute(nulls, ["i"], "mean").dtypes)["i"] == "int"


def test_median_and_mode(nulls):
    assert rows(fill.impute(nulls, ["i"], "median", 0), "id")[1][1] == 4
    assert rows(fill.impute(nulls, ["x"], "mode"), "id")[2][2] == 1.0  # all tie: smallest


def test_impute_rejects_text_and_all_null(spark, nulls):
    with pytest.raises(ValueError, match="not numeric"):
        fill.impute(nulls, ["s"])
    empty = spark.createDataFrame([(None,)], "x double")
    for strategy in ("mean", "median", "mode"):
        with pytest.raises(ValueError, match="no value"):
            fill.impute(empty, ["x"], strategy)
