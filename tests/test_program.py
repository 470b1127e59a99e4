import pytest
from conftest import rows
from pyspark.sql import functions as F

from fedloom.plans import program
from fedloom.plans.program import ALL, EXCLUDE, offered_steps, preprocess


def step(column, operation):
    return {"column": column, "operation": operation}


@pytest.fixture
def table(spark):
    data = [(i, float(i % 5), None if i % 4 == 0 else float(i), "ab"[i % 2], i % 3 == 0) for i in range(1, 21)]
    return spark.createDataFrame(data, "id int, x double, y double, s string, b boolean")


@pytest.mark.parametrize("operation", program.ALL_COLUMN_STEPS)
def test_every_step_on_all_columns(table, operation):
    whole = table.fillna(1.0)
    done, report = preprocess(whole, [step(ALL, operation)])
    assert done.count() > 0 and report[0].status == "applied"


@pytest.mark.parametrize("operation", program.COLUMN_STEPS)
def test_every_step_on_a_column(table, operation):
    column = {"Fill Unknown": "s", "Label Encoding": "s", "Fill False": "b", "One Hot Encoding": "id"}.get(operation, "x")
    done, report = preprocess(table, [step(column, operation)])
    assert done.count() > 0 and report[0].status == "applied"


@pytest.mark.parametrize("operation", ["z-score", "Min-Max Scaling", "Fill Mean"])
def test_labels_are_exact(table, operation):
    with pytest.raises(ValueError, match="unknown operation"):
        preprocess(table, [step("x", operation)])


def test_skipping_goes_on_with_unchanged_data(table):
    steps = [step("x", "Nonsense"), step(ALL, "L1 Norm"), step("gone", "Log"), step("s", "Min-Max"), step("x", "Min-Max")]
    done, report = preprocess(table, steps, on_error="skip")
    assert [r.status for r in report] == ["skipped", "skipped", "skipped", "skipped", "applied"]
    assert "NULL or NaN" in report[1].message
    assert done.agg(F.max("x")).first()[0] == 1.0 and done.agg(F.max("y")).first()[0] == 19.0


def test_default_raises(table):
    with pytest.raises(ValueError, match="NULL or NaN"):
        preprocess(table, [step(ALL, "L2 Norm")])


def test_excluded_columns_stay_out_of_all_columns(table):
    steps = [step("y", EXCLUDE), step(ALL, "Drop Null"), step(ALL, "Min-Max"), step("y", "Fill 0")]
    done, _ = preprocess(table, steps)
    assert done.count() == 20 and done.agg(F.max("y"), F.max("id")).first()[:] == (19.0, 1.0)


def test_dropped_columns_leave_the_lists(table):
    done, _ = preprocess(table, [step("y", "Drop Column"), step(ALL, "Z-score")])
    assert done.columns == ["id", "x", "s", "b"]


def test_steps_see_earlier_results(table):
    done, _ = preprocess(table, [step("y", "Fill 0"), step("y", "Min-Max"), step("y", "Square")])
    assert [r[0] for r in done.orderBy("id").select("y").limit(4).collect()] == pytest.approx([(1 / 19) ** 2, (2 / 19) ** 2, (3 / 19) ** 2, 0])


def test_one_aggregate_serves_a_wave(table, monkeypatch):
    calls = []
    original = program.fit

    def counting(df, wanted):
        calls.append(len(wanted))
        return original(df, wanted)

    monkeypatch.setattr(program, "fit", counting)
    steps = [step("x", "Min-Max"), step("y", "Fill mean"), step("id", "Z-score"), step("b", "Fill False")]
    done, _ = preprocess(table, steps)
    assert calls == [6]
    apart = table
    for s in steps:
        apart, _ = preprocess(apart, [s])
    assert rows(done) == rows(apart)


def test_duplicates_then_statistics(table):
    doubled = table.unionByName(table)
    done, _ = preprocess(doubled, [step(ALL, "Drop Duplicates"), step("x", "L1 Norm")])
    assert done.count() == 20 and done.agg(F.sum("x")).first()[0] == pytest.approx(1.0)


def test_offered_steps(table):
    assert "Label Encoding" in offered_steps(table, "s") and "Min-Max" not in offered_steps(table, "s")
    assert "Log" in offered_steps(table.select(F.col("id").cast("long").alias("n")), "n")
    assert offered_steps(table, "b") == () and "Fill Mean" in offered_steps(table, ALL)
