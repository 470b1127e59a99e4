import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.functions import metrics as M
from fedloom.functions.text import human_size, pretty_model_name


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a != 1]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")


def value(df, name, **options):
    return M.metric(df, name, **options).first()["value"]


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(1, 9, 200), rng.uniform(1, 9, 200)
    df = pairs(spark, y, p)
    assert value(df, "mse") == pytest.approx(np.mean((y - p) ** 2))
    assert value(df, "mean_absolute_error") == pytest.approx(np.mean(np.abs(y - p)))
    assert value(df, "rmse") == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert value(df, "msle") == pytest.approx(np.mean((np.log1p(y) - np.log1p(p)) ** 2))
    assert value(df, "mape") == pytest.approx(np.mean(np.abs((y - p) / y)) * 100)
    assert value(df, "r2") == pytest.approx(1 - np.var(y - p) / np.var(y))
    assert value(df, "r2_ss") == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_report_knows_the_sums_of_squares(spark):
    df = pairs(spark, [1.0, 2.0, 4.0], [1.0, 2.0, 3.0])
    assert [(r["value"], r["known"]) for r in M.metrics_report(df, ["r2_ss"]).collect()] == [(0.786, True)]


def test_zero_denominators(spark):
    df = pairs(spark, [0, 0, 0], [0, 0, 0])
    assert [value(df, m) for m in ("precision", "recall", "f1", "r2_ss")] == [0.0] * 4
    assert value(df, "r2") is None and value(df, "mape") is None
    assert value(df, "auc", prediction="prediction") == 0.0


@pytest.mark.parametrize("slices", ["2", "40"])
def test_auc_matches_pair_counting(spark, slices):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_auc(spark)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_auc_of_more_scores_than_slices(spark):
    rng = np.random.default_rng(3)
    s = rng.permutation(3000) / 3000
    y = (rng.random(3000) < s).astype(int)
    assert M.auc(pairs(spark, y.tolist(), s.tolist()), score="prediction").first()["auc"] == pytest.approx(brute_auc(y, s))


def _check_auc(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.where(rng.random(300) < 0.35, 0.5, np.round(rng.random(300) * 0.6 + y * 0.2, 2))
    g = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, g)], "label int, score double, g int")
    assert M.auc(df).first()["auc"] == pytest.approx(brute_auc(y, s))
    for r in M.auc(df, by=["g"]).collect():
        assert r["auc"] == pytest.approx(brute_auc(y[g == r["g"]], s[g == r["g"]]))


def test_weighted_scores_and_confusion(spark):
    y, p = ["a", "a", "b", "c", "c", "c"], ["a", "b", "b", "c", "a", "d"]
    df = spark.createDataFrame(list(zip(y, p)), "label string, prediction string")
    got = M.weighted_prf(df).first()
    assert got["recall"] == pytest.approx(3 / 6)
    assert got["precision"] == pytest.approx((2 * 0.5 + 1 * 0.5 + 3 * 1.0) / 6)
    f = {"a": 0.5, "b": 2 / 3, "c": 0.5}
    assert got["f1_score"] == pytest.approx((2 * f["a"] + f["b"] + 3 * f["c"]) / 6)
    report = {r["metric"]: r["value"] for r in M.metrics_report(df, ["accuracy", "f1", "recall"], average="weighted").collect()}
    assert report == {"accuracy": 0.5, "f1_score": 0.528, "recall": 0.5}
    cells = {(r["label"], r["prediction"]): r["count"] for r in M.confusion_matrix(df, classes="abcd").collect()}
    assert M.confusion_matrix(df).count() == sum(v > 0 for v in cells.values())
    assert len(cells) == 16 and cells["c", "d"] == 1 and cells["d", "d"] == 0 and sum(cells.values()) == 6


def test_report_rounds_half_even_and_names_unknown(spark):
    df = pairs(spark, [0.0625], [0.0])
    got = {r["metric"]: r for r in M.metrics_report(df, ["mae", "speed"]).collect()}
    assert got["mae"]["value"] == 0.062 and got["speed"]["known"] is False
    assert M.report_map(M.metrics_report(df, ["mae", "mse"])).first()[0] == {"mae": 0.062, "mse": 0.004}
    with pytest.raises(ValueError, match="unknown metric"):
        M.metric(df, "speed")


def test_log_loss_is_clipped(spark):
    df = pairs(spark, [1, 0], [0.0, 1.0])
    assert value(df, "log_loss") == pytest.approx(-np.log(1e-15), rel=1e-2)


def test_classes(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 0.5, -0.0)], "a array<double>, p double, m double")
    got = df.select(M.argmax_class(F.col("a")), M.threshold_class(F.col("p")), M.sign_class(F.col("m"))).first()
    assert tuple(got) == (1, 1, 1)


def test_texts(spark):
    names = {"LinearRegression": "Linear Regression", "myCNNModel": "My CNNModel", "Unknown": "Unknown", "": "", None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(pretty_model_name(F.col("n"))).collect()] == list(names.values())
    sizes = {0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1536 * 1024: "1.50 MB", 2**50: "1.00 PB", 2**62: "4096.00 PB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    assert [r[0] for r in df.select(human_size(F.col("s"))).collect()] == list(sizes.values())


def test_area_and_log_loss_take_the_probability(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.1), (0.0, 0.0, 0.3), (1.0, 0.0, 0.4), (1.0, 1.0, 0.8)], "label double, prediction double, score double")
    got = {r["metric"]: r["value"] for r in M.metrics_report(df, ["auc", "accuracy"], score="score").collect()}
    assert got == {"auc": 1.0, "accuracy": 0.75}
    assert M.metrics_report(df, ["auc"]).first()["value"] == 0.75
