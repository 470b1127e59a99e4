import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedloom.operators import ordering, profile as P, quantiles as Q

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frames(spark):
    rng = np.random.default_rng(3)
    yield "normal", rng.normal(size=3000)
    yield "hot", np.where(rng.random(3000) < 0.4, 7.0, rng.normal(7, 1e-3, 3000))
    yield "two", np.where(rng.random(3000) < 0.5, 1.0, 2.0)
    yield "steps", np.round(rng.exponential(3, 3000))


@pytest.mark.parametrize("exact_below", [4000, 20])
def test_exact_quantiles_match_sorting(spark, monkeypatch, exact_below):
    monkeypatch.setattr(Q, "EXACT_BELOW", exact_below)
    monkeypatch.setattr(Q, "ACCURACY", 10_000 if exact_below == 4000 else 100)
    monkeypatch.setattr(Q, "MARGIN", 3e-4 if exact_below == 4000 else 0.03)
    data = dict(frames(spark))
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*data.values())], ", ".join(f"{n} double" for n in data))
    df = df.unionByName(spark.createDataFrame([(None, float("nan"), None, None)], df.schema))
    disc, cont = Q.exact_quantiles(df, df.columns, PROBABILITIES), Q.exact_quantiles(df, df.columns, PROBABILITIES, interpolate=True)
    for name, values in data.items():
        ordered = np.sort(values)
        assert disc[name] == [ordered[max(1, int(np.ceil(p * ordered.size))) - 1] for p in PROBABILITIES], name
        assert cont[name] == pytest.approx(list(np.quantile(values, PROBABILITIES))), name


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    for error in (0, 0.05):
        assert Q.quantiles(df, ["x", "y"], [0.5], error) == {"x": [None], "y": [1.0]}


def test_rank_error_is_kept(spark):
    df = spark.range(10_000).selectExpr("CAST(id AS DOUBLE) AS x")
    for p, v in zip([0.25, 0.5], Q.quantiles(df, ["x"], [0.25, 0.5], 0.05)["x"]):
        assert abs(v - p * 10_000) <= 500


def test_row_numbers_cut_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(
            F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
            (F.col("id") * 7919 % 101).alias("v"), "id",
        )
        order = [F.asc("v"), F.asc("id")]
        got = ordering.row_numbers(df, order, "n", by=["g"])
        slices = df.orderBy("g", *order).select(F.spark_partition_id().alias("s")).distinct().count()
        assert slices > 3
        wanted = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(*order)).cast("long"))
        assert rows(got.select("id", "n")) == rows(wanted.select("id", "n"))
        whole = ordering.row_numbers(df, order, "n")
        assert sorted(r["n"] for r in whole.collect()) == list(range(1, 5001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals_with_null_group(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 3, 5.0)], "g string, id int, v double")
    got = ordering.running_totals(df, [F.asc("id")], {"t": F.col("v")}, by=["g"])
    assert rows(got.select("id", "t")) == [(1, 2.0), (2, 5.0), (3, 5.0)]


def by_name(df):
    return {r["name"]: r.asDict(recursive=True) for r in df.collect()}


@pytest.fixture
def table(spark):
    data = [
        (1, 1.0, None, 5, "x" * 60, [[[1.0], [2.0], [0.0]], [[4.0], [5.0], [6.0]]], None),
        (2, None, None, 5, "b", None, "k"),
        (3, float("nan"), None, 5, None, [], "k"),
        (4, 11.0, None, 5, "b", [[[0.0], [0.0], [0.0]], [[1.0], [1.0], [1.0]]], "k"),
    ]
    return spark.createDataFrame(data, "id int, x double, none double, same int, s string, `nest.ed` array<array<array<double>>>, `k v` string")


def test_profile_of_hard_columns(table):
    got = by_name(P.profile(table, relative_error=0))
    assert [r["name"] for r in P.profile(table).collect()] == table.columns
    assert got["x"]["entries"] == 4 and got["x"]["null_count"] == 1 and got["x"]["unique_count"] == 4
    assert got["x"]["q1"] == 1.0 and got["x"]["q3"] == 11.0 and sum(got["x"]["hist_counts"]) == 2
    assert got["none"]["unique_count"] == 1 and got["none"]["median"] is None and got["none"]["hist_bins"] is None
    assert got["same"]["hist_bins"] == [5.0, 5.0] and got["same"]["hist_counts"] == [4]
    assert got["s"]["top_categories"][0] == {"value": "b", "count": 2}
    assert got["s"]["top_categories"][1]["value"] is None
    assert got["s"]["top_categories"][2]["value"] == "x" * 50 + "..."
    assert got["k v"]["unique_count"] == 2
    nested = got["nest.ed"]
    assert nested["shape"] == [2, 3, 1] and (nested["len_min"], nested["len_max"]) == (0, 2)
    assert nested["val_min"] == 0.0 and nested["val_max"] == 6.0 and nested["val_sparsity"] == pytest.approx(4 / 12)


def test_approximate_profile_agrees_on_small_data(table):
    exact, approximate = by_name(P.profile(table)), by_name(P.profile(table, approximate_unique=True))
    for name in table.columns:
        assert exact[name]["unique_count"] == approximate[name]["unique_count"]
        assert exact[name]["hist_counts"] == approximate[name]["hist_counts"]


def test_empty_table(spark):
    got = by_name(P.profile(spark.createDataFrame([], "x double, s string, a array<double>")))
    assert got["x"]["entries"] == 0 and got["s"]["top_categories"] == [] and got["a"]["shape"] is None


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (-3.7, 12.9), (0.1, 0.7), (1.0, 7.0)])
def test_histogram_follows_the_edge_list(spark, low, high):
    edges = P.bin_edges(low, high)
    values = edges + [low + (high - low) * i / 997 for i in range(998)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts = [r["count"] for r in P.profile_histogram(df).orderBy("bin").collect()]
    places = [min(9, int(np.searchsorted(edges, v, side="right")) - 1) for v in values]
    assert counts == [places.count(b) for b in range(10)]
    assert sum(counts) == len(values)


def test_histogram_labels_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    labels = P.histogram_labels(P.profile_histogram(df)).orderBy("edge").collect()
    assert [r["label"] for r in labels] == ["2.00-2.00", "2.00+"]


def test_array_shapes_and_insights(table):
    shape = by_name(P.array_shape(table))["nest.ed"]
    assert shape["shape"] == [2, 3, 1] and shape["uniform"] is False
    flags = P.array_insights(table, "nest.ed").first()
    assert (flags["uniform_shape"], flags["normalized"], flags["sparse"], flags["null_percentage"]) == (False, False, True, 25.0)


def test_array_median_is_interpolated(spark):
    df = spark.createDataFrame([([1, 2],), ([3, 10],)], "a array<int>")
    got = P.array_value_stats(df, "a").first()
    assert got["val_median"] == 2.5 and got["val_std"] == pytest.approx(np.std([1, 2, 3, 10]))


def test_wide_tables_are_profiled_in_groups(spark, monkeypatch):
    from fedloom.operators import columns

    monkeypatch.setattr(columns, "AGGREGATES_PER_JOB", 7)
    df = spark.range(20).selectExpr("id", *[f"CAST(id * {i} AS DOUBLE) AS c{i}" for i in range(1, 9)])
    got = by_name(P.profile(df))
    assert got["c8"]["max"] == 152.0 and got["c8"]["unique_count"] == 20 and got["c3"]["mean"] == 28.5


def test_states_of_parts_add_up(spark, tmp_path):
    from fedloom.operators.profile_state import QUANTILE_SIZE, merge_states, profile_state

    r = np.random.default_rng(9)
    n = 3 * QUANTILE_SIZE
    whole = spark.createDataFrame(
        [(i, float(x), None if i % 3 else f"t{i % 7}", [float(i % 5), float(x)], "long " * 20 + str(i % 2)) for i, x in enumerate(r.normal(5, 2, n))],
        "id long, x double, s string, a array<double>, l string",
    )
    left, right = whole.where("id % 4 = 0").drop("l"), whole.where("id % 4 <> 0").select("l", "a", "s", "x", "id")
    for i, part in enumerate((left, right)):
        profile_state(part).write.parquet(str(tmp_path / str(i)))
    merged = merge_states(*[spark.read.parquet(str(tmp_path / str(i))) for i in range(2)])
    got, wanted = by_name(P.profile_of_state(merged)), by_name(P.profile(whole.withColumn("l", F.when(F.col("id") % 4 != 0, F.col("l"))), relative_error=0))
    assert list(got) == ["id", "x", "s", "a", "l"]
    for c, row in wanted.items():
        for field in ("type", "entries", "null_count", "shape", "len_min", "len_max", "val_min", "val_max", "min", "max", "top_categories", "hist_bins"):
            assert got[c][field] == row[field], (c, field)
        for field in ("mean", "stddev", "len_mean", "len_std", "val_mean", "val_std", "val_sparsity"):
            assert got[c][field] == pytest.approx(row[field], abs=1e-9), (c, field)
        if row["unique_count"] is not None:
            assert got[c]["unique_count"] == pytest.approx(row["unique_count"], rel=0.03)
        if row["hist_counts"]:
            assert sum(got[c]["hist_counts"]) == n and np.allclose(got[c]["hist_counts"], row["hist_counts"], atol=0.003 * n)
    for c, p in (("x", 0.25), ("id", 0.75)):
        values = sorted(v[0] for v in whole.select(c).collect())
        at = got[c]["q1" if p == 0.25 else "q3"]
        assert values[int((p - 0.0015) * n)] <= at <= values[int((p + 0.0015) * n) + 1]
    assert by_name(P.profile(whole, approximate_unique=True))["a"]["val_median"] == pytest.approx(by_name(P.profile(whole, relative_error=0))["a"]["val_median"], abs=0.05)
