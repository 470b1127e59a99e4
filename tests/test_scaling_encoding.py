import math

import pytest
from conftest import rows
from pyspark.ml.feature import MinMaxScaler, Normalizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fedloom.functions.vectors import parse_vector, reshape, reshape_or_keep
from fedloom.operators import encode, scale


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(1, 3.0, -4.0, 5.0), (2, 0.0, 0.0, 5.0), (3, -1.0, 2.0, 5.0)], "id int, a double, b double, c double")


@pytest.mark.parametrize("method", scale.METHODS)
def test_constant_and_zero_columns_become_zero(spark, method):
    df = spark.createDataFrame([(0.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in scale.scale_column(df, "x", method).collect()] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("method", scale.METHODS)
def test_column_without_values_is_refused(spark, method):
    df = spark.createDataFrame([(None,)], "x double")
    with pytest.raises(ValueError, match="no values"):
        scale.scale_column(df, "x", method)


def test_column_family_values(cells):
    b = [-4.0, 0.0, 2.0]
    got = {m: [r["b"] for r in scale.scale_column(cells, "b", m).orderBy("id").collect()] for m in scale.METHODS}
    assert got["Min-Max"] == pytest.approx([0, 4 / 6, 1])
    assert got["L1 Norm"] == pytest.approx([v / 6 for v in b])
    assert got["L2 Norm"] == pytest.approx([v / math.sqrt(20) for v in b])
    assert got["L inf Norm"] == pytest.approx([v / 4 for v in b])
    mean, spread = -2 / 3, math.sqrt(sum((v + 2 / 3) ** 2 for v in b) / 2)
    assert got["Z-score"] == pytest.approx([(v - mean) / spread for v in b])


@pytest.mark.parametrize("method", scale.METHODS)
def test_row_family_matches_mllib(cells, method):
    names = ["a", "b", "c"]
    stage = {
        "L1 Norm": Normalizer(p=1.0), "L2 Norm": Normalizer(p=2.0), "L inf Norm": Normalizer(p=float("inf")),
        "Min-Max": MinMaxScaler(), "Z-score": StandardScaler(withStd=True, withMean=False),
    }[method]
    stage.setInputCol("v").setOutputCol("o")
    assembled = VectorAssembler(inputCols=names, outputCol="v").transform(cells)
    fitted = stage.fit(assembled) if hasattr(stage, "fit") else stage
    wanted = [r[0] for r in fitted.transform(assembled).orderBy("id").select(vector_to_array("o")).collect()]
    got = [[r[n] for n in names] for r in scale.scale_all(cells, names, method).orderBy("id").collect()]
    for a, b in zip(got, wanted):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("method", scale.METHODS)
def test_missing_cell_in_a_row_vector_fails(spark, method):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(Exception, match="NULL or NaN"):
        scale.scale_all(df, None, method).collect()


def test_unknown_method(cells):
    with pytest.raises(ValueError, match="unknown normalisation"):
        scale.scale_column(cells, "a", "Max-Min")


def test_transforms(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.0,)], "x double")
    log = [r[0] for r in scale.transform_column(df, "x", "Log").collect()]
    root = [r[0] for r in scale.transform_column(df, "x", "Square Root").collect()]
    assert log[:2] == [None, None] and log[2] == pytest.approx(math.log(4))
    assert math.isnan(root[0]) and root[1:] == [0.0, 2.0]
    assert [r[0] for r in scale.transform_column(df, "x", "Square").collect()] == [1.0, 0.0, 16.0]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate("b a c a b d a b e".split())], "id int, w string")


def indexer_labels(df):
    out = StringIndexer(inputCol="w", outputCol="l").fit(df).transform(df)
    return [r["l"] for r in out.orderBy("id").collect()]


def test_label_encode_matches_string_indexer(words):
    assert [r["w"] for r in encode.label_encode(words, "w").orderBy("id").collect()] == indexer_labels(words)


def test_label_encode_with_a_large_dictionary(words, monkeypatch):
    monkeypatch.setattr(encode, "SMALL_LABELS", 1)
    monkeypatch.setattr(encode, "HEAD_LABELS", 2)
    assert [r["w"] for r in encode.label_encode(words, "w").orderBy("id").collect()] == indexer_labels(words)


def test_encoding_refuses_null(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "w string, n int")
    for run in (encode.label_encode, encode.one_hot_encode):
        with pytest.raises(ValueError, match="Null values"):
            run(df, "w")
    with pytest.raises(ValueError, match="Null values"):
        encode.one_hot_encode(df, "n")


def test_one_hot(spark, words):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    plain = encode.one_hot_encode(df, "n").select(encode.dense(F.col("n")))
    assert [r[0] for r in plain.collect()] == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    hot = {tuple(r[0]) for r in encode.one_hot_encode(words, "w").select(encode.dense(F.col("w"))).collect()}
    assert len(hot) == 5 and (0.0,) * 4 in hot
    sparse = [r["w"] for r in encode.one_hot_encode(words, "w").orderBy("id").collect()]
    assert sparse[0]["size"] == 4 and sparse[0]["values"] == [1.0] and {tuple(s["indices"]) for s in sparse} == {(), (0,), (1,), (2,), (3,)}
    with pytest.raises(ValueError, match="no category index"):
        encode.one_hot_encode(spark.createDataFrame([(-1.0,), (2.0,)], "n double"), "n")


def test_vectors(spark):
    df = spark.createDataFrame([("1, 2.5,, ,3,",)], "t string")
    assert df.select(parse_vector(F.col("t"))).first()[0] == [1.0, 2.5, 3.0]
    flat = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), (None,)], "v array<int>")
    got = [r[0] for r in flat.select(reshape(F.col("v"), [2, 3, 1])).collect()]
    assert got == [[[[1], [2], [3]], [[4], [5], [6]]], None]
    with pytest.raises(Exception, match="has length 2"):
        spark.createDataFrame([([1, 2],)], "v array<int>").select(reshape(F.col("v"), [2, 3, 1])).collect()


def test_task_types(spark):
    df = spark.range(300).selectExpr("CAST(id % 3 AS DOUBLE) AS few", "CAST(id AS DOUBLE) AS many", "id % 2 + 0.5D AS half")
    first = [encode.task_type(df, c) for c in df.columns]
    second = [encode.task_type_network(df, c) for c in df.columns]
    assert first == ["classification", "regression", "regression"] == second
    for values, kind in ((20, "classification"), (21, "regression")):
        assert encode.task_type(spark.range(1000).selectExpr(f"id % {values} AS y"), "y") == kind
    for values, kind in ((100, "classification"), (101, "regression")):
        assert encode.task_type_network(spark.range(1000).selectExpr(f"id % {values} AS y"), "y") == kind


def test_vectors_that_do_not_fit_stay_flat(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,)], "v array<double>")
    got = [tuple(r[0]) if r[0] else None for r in df.select(reshape_or_keep(F.col("v"), [2, 2])).collect()]
    assert got == [(None, [[1.0, 2.0], [3.0, 4.0]]), ([1.0], None), (None, None)]
