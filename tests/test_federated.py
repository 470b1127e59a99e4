import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fedloom.functions.power import detectable_effects
from fedloom.operators import federated as A
from fedloom.operators import models, pricing, rounds, scoring
from fedloom.operators.columns import fit

KEYS = ["session_id", "round", "client_id"]


def documents(spark, docs):
    return spark.createDataFrame([(1, 1, i, json.dumps(d)) for i, d in enumerate(docs, 1)], "session_id int, round int, client_id int, document string")


def averaged(spark, docs):
    return A.fedavg(A.flatten_params(documents(spark, docs), "document", KEYS))


def test_equal_clients_average_to_themselves(spark):
    doc = {"w": [[1.5, -2.0], [0.25, 4.0]], "c": 3.5, "deep": {"b": [[[1.0]]]}}
    got = {(r["path"], tuple(r["pos"])): r["value"] for r in averaged(spark, [doc] * 3).collect()}
    assert got == {("w", (0, 0)): 1.5, ("w", (0, 1)): -2.0, ("w", (1, 0)): 0.25, ("w", (1, 1)): 4.0, ("c", ()): 3.5, ("deep.b", (0, 0, 0)): 1.0}


def test_average_divides_by_all_clients_and_passes_metadata(spark):
    docs = [{"w": [2.0, 4.0], "n_features": 2, "task_type": "auto"}, {"w": [4.0], "n_features": 9, "task_type": "x"}]
    got = {(r["path"], tuple(r["pos"])): (r["value"], r["metadata"]) for r in averaged(spark, docs).collect()}
    assert got["w", (0,)] == (3.0, None) and got["w", (1,)] == (2.0, None)
    assert got["n_features", ()] == (None, "2") and got["task_type", ()] == (None, "auto")


def test_rebuild_restores_order(spark, monkeypatch):
    doc = {"w": [[float(10 * i + j) for j in range(12)] for i in range(3)]}
    got = {tuple(r["lead"]): r["values"] for r in A.fedavg_rebuild(averaged(spark, [doc, doc])).collect()}
    assert got == {(i,): doc["w"][i] for i in range(3)}
    monkeypatch.setattr(A, "BLOCK", 5)
    got = {(*r["lead"], r["block"]): r["values"] for r in A.fedavg_rebuild(averaged(spark, [doc])).collect()}
    assert got == {(i, b): doc["w"][i][5 * b:5 * b + 5] for i in range(3) for b in range(3)}


def test_too_deep_documents_fail(spark):
    with pytest.raises(Exception, match="nested deeper"):
        A.flatten_params(documents(spark, [{"w": [[[1.0]]]}]), "document", KEYS, max_depth=2).collect()


def test_flatten_array_agrees_with_json(spark):
    df = spark.createDataFrame([(1, 1, 7, [[1.0, 2.0], [3.0, 4.0]])], "session_id int, round int, client_id int, w array<array<double>>")
    typed = A.flatten_array(df, "w", KEYS)
    parsed = A.flatten_params(df.select(*KEYS, F.to_json(F.struct("w")).alias("d")), "d", KEYS)
    assert rows(typed, "pos") == rows(parsed.drop("text"), "pos")


def test_rounds(spark):
    sessions = spark.createDataFrame([(1, 2, 0, "ACCEPTING_CLIENTS"), (2, 1, 1, "STARTED")], "id int, curr_round int, no_of_left_clients int, training_status string")
    clients = spark.createDataFrame([(u, 1) for u in (10, 11, 12)] + [(10, 2), (11, 2)], "user_id int, session_id int")
    subs = spark.createDataFrame(
        [(1, 10, 1, "t1"), (1, 10, 1, "t0"), (1, 11, 2, "t2"), (1, 12, 1, "t3"), (2, 10, 1, "t4")],
        "session_id int, user_id int, round_number int, at string",
    )
    first = rounds.first_submission_wins(subs, [F.asc("at")])
    assert first.count() == 4 and first.filter("at = 't1'").count() == 0
    state = {(r["session_id"], r["round_number"]): (r["received"], r["clients"], r["ready"]) for r in rounds.round_readiness(first, clients, sessions).collect()}
    assert state == {(1, 1): (2, 3, False), (1, 2): (1, 3, False), (2, 1): (1, 2, True)}
    assert rows(rounds.missing_clients(clients, sessions, first).select("session_id", "user_id"), "session_id", "user_id") == [(1, 10), (1, 12), (2, 11)]
    assert rows(rounds.stale_round_filter(subs, sessions).select("session_id", "user_id")) == [(1, 11), (2, 10)]
    assert [r["session_id"] for r in rounds.sessions_startable(sessions, clients).collect()] == [1]
    assert rounds.sessions_startable(sessions, clients, minimum=3).count() == 0


# textbook group sizes at level 0.05 and power 0.8
@pytest.mark.parametrize("effect, size", [(0.8, 30), (0.5, 64), (-0.5, 64), (0.3, 176), (0.25, 200), (9.0, 30), (0.0, None), (None, None)])
def test_sample_sizes(spark, effect, size):
    df = spark.createDataFrame([(effect, 0.05)], "e double, a double")
    assert pricing.required_sample_size(df, "e", "a").first()["sample_size"] == size


def test_sizes_match_a_scan_of_the_limits(spark):
    effects = [0.05 + i * 0.0037 for i in range(300)] + [1e-200, 1e200, *detectable_effects(0.05)[::17]]
    df = spark.createDataFrame([(float(e), a) for e in effects for a in (0.05, 0.05 / 64)], "e double, a double")
    limits = {a: detectable_effects(a) for a in (0.05, 0.05 / 64)}
    for r in pricing.required_sample_size(df, "e", "a").collect():
        assert r["sample_size"] == 30 + sum(v > r["e"] for v in limits[r["a"]])


def test_limits_fall_with_the_size():
    limits = detectable_effects(0.05 / 32)
    assert len(limits) == 170 and all(a > b for a, b in zip(limits, limits[1:]))


def test_effects(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0, 2.0), (1.0, 1.0, 2.0, 2.0), (1.0, 3.0, 0.0, 0.0)], "a double, b double, s double, t double")
    cells = [F.col(c) for c in df.columns]
    assert rows(df.select(pricing.cohens_d(*cells), pricing.effect_size(*cells))) == [(None, 0.0), (0.0, None), (1.0, 1.0)]


def test_session_prices(spark):
    layers = [{"layer_type": "convolution", "filters": "4"}, {"layer_type": "dense"}]
    info = {"task_id": 7, "expected_std_mean": 3.0, "expected_std_deviation": "1.0", "model_info": {"layers": layers}}
    sessions = spark.createDataFrame([(1, json.dumps(info)), (2, json.dumps({**info, "expected_std_mean": 1.0}))], "id int, federated_info string")
    tasks = spark.createDataFrame([(7, "mse", json.dumps({"mse": {"std_mean": 1.0, "std_dev": 1.0}}))], "task_id int, metric string, benchmark string")
    got = {r["session_id"]: r for r in pricing.session_prices(sessions, tasks).collect()}
    assert got[1]["predictors"] == 4 and got[1]["alpha"] == 0.0125 and got[1]["effect_size"] == 0.5
    assert 80 < got[1]["price"] < 100 and got[2]["price"] == 100.0 and got[2]["effect_size"] is None


# --- training and scoring ------------------------------------------------------------

@pytest.fixture
def line(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 300)
    y = 2 * x + 1 + rng.normal(0, 0.1, 300)
    return spark.createDataFrame([(i % 4, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "client int, x double, y double")


def descent(x, y, m, c, rate, steps):
    for _ in range(steps):
        gap = y - (m * x + c)
        m, c = m + rate * 2 * np.mean(gap * x), c + rate * 2 * np.mean(gap)
    return m, c


def test_descent_on_sums_equals_descent_on_rows(line):
    x, y = np.array([(r["x"], r["y"]) for r in line.collect()]).T
    got = models.linear_gd(line, F.col("x"), F.col("y"), 0.1, 50)
    assert (got["m"], got["c"]) == pytest.approx(descent(x, y, 0, 0, 0.1, 50))


def test_federated_rounds_match_local_loops(line):
    data = {}
    for r in line.collect():
        data.setdefault(r["client"], []).append((r["x"], r["y"]))
    m = c = 0.0
    got = models.federated_rounds(line, "client", "x", "y", line, rounds=3, rate=0.1, steps=5).orderBy("round").collect()
    for r in got:
        local = [descent(*np.array(v).T, m, c, 0.1, 5) for v in data.values()]
        m, c = np.mean(local, axis=0)
        assert (r["m"], r["c"], r["clients"]) == (pytest.approx(m), pytest.approx(c), 4)
    assert got[-1]["mse"] < got[0]["mse"]


def test_one_client_round_is_its_own_descent(line):
    alone = line.withColumn("client", F.lit(1))
    sums = fit(alone, models.moment_sums(F.col("x"), F.col("y")))
    got = models.federated_rounds(alone, "client", "x", "y", line, rounds=1, rate=0.1, steps=7).first()
    assert (got["m"], got["c"]) == pytest.approx(models.descend(sums, 0.1, 7))


def test_linear_regression_recovers_the_line(line):
    model = models.linear_regression(line, ["x"], "y")
    assert model.parameters()["weights"][0] == pytest.approx(2, abs=0.1)
    report = {r["metric"]: r["value"] for r in model.evaluate(line, ["r2", "mse"]).collect()}
    assert report["r2_score"] > 0.95


def test_classifiers_separate_simple_data(spark):
    df = spark.range(200).selectExpr("CAST(id % 20 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 20 >= 10 AS INT) AS y")
    for model in (models.logistic_regression(df, ["a", "b"], "y"), models.linear_svm(df, ["a", "b"], "y", maxIter=20),
                  models.decision_tree(df, ["a", "b"], "y", maxDepth=3)):
        assert model.evaluate(df, ["accuracy"]).first()["value"] > 0.95


def test_forests_boosting_network_and_landmarks_learn(spark):
    df = spark.range(300).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 20 >= 10 AS INT) AS y", "id % 20 * 2 + 1.0D AS z")
    forest = models.random_forest(df, ["a", "b"], "y", numTrees=5, maxDepth=4, seed=1)
    network = models.mlp_classifier(df, ["a", "b"], "y", hidden=[4], classes=2, maxIter=50, seed=1)
    for model in (forest, network):
        assert model.evaluate(df, ["accuracy"]).first()["value"] > 0.95
    assert forest.parameters()["trees"] == 5 and forest.parameters()["importances"][0] > 0.9
    boosted = models.gradient_boosting(df, ["a", "b"], "z", maxIter=8, maxDepth=4, seed=1)
    assert boosted.evaluate(df, ["r2"]).first()["value"] > 0.95
    points = df.withColumn("v", F.array(F.col("a") / 10, F.col("b") / 10))
    kernel = models.landmark_svm(points, "v", "y", "id", landmarks=10, maxIter=20)
    right = kernel.predict(points).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert right > 0.9


def test_one_vs_rest_expression_equals_its_transform(spark):
    df = spark.range(90).selectExpr("CAST(id % 30 AS DOUBLE) AS a", "CAST((id * 7) % 11 AS DOUBLE) AS b", "CAST(id % 30 / 10 AS INT) AS y")
    model = models.linear_svm(df, ["a", "b"], "y", binary=False, maxIter=5)
    own = model.predict(df).select("a", "b", "prediction")
    theirs = model.pipeline.transform(df).select("a", "b", "prediction")
    assert rows(own, "a", "b") == rows(theirs, "a", "b")


@pytest.mark.parametrize("unrolled", [1024, 0])
@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic", "identity"])
def test_network_matches_numpy(spark, monkeypatch, unrolled, activation):
    monkeypatch.setattr(scoring, "UNROLLED_WEIGHTS", unrolled)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 3))
    weights, biases = [rng.normal(size=(3, 5)), rng.normal(size=(5, 3))], [rng.normal(size=5), rng.normal(size=3)]
    mean, spread = x.mean(axis=0), x.std(axis=0)
    act = {"relu": lambda z: np.maximum(0, z), "tanh": np.tanh, "logistic": lambda z: 1 / (1 + np.exp(-z)), "identity": lambda z: z}[activation]
    out = act(((x - mean) / spread) @ weights[0] + biases[0]) @ weights[1] + biases[1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    options = {"weights": [w.tolist() for w in weights], "biases": [b.tolist() for b in biases], "activation": activation, "mean": mean.tolist(), "scale": spread.tolist()}
    classes = scoring.score_mlp(df, ["a", "b", "c"], num_classes=3, **options)
    values = scoring.score_mlp(df, ["a", "b", "c"], task="regression", **options)
    assert [r["prediction"] for r in classes.orderBy("i").collect()] == out.argmax(axis=1).tolist()
    assert [r["prediction"] for r in values.orderBy("i").collect()] == pytest.approx(out[:, 0].tolist())


def test_kernels_match_numpy(spark):
    rng = np.random.default_rng(6)
    x, marks = rng.normal(size=(10, 4)), rng.normal(size=(3, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    inner, far = x @ marks.T, np.linalg.norm(x[:, None] - marks, axis=2)
    wanted = {"rbf": np.exp(-0.7 * far**2), "linear": inner, "polynomial": (inner + 1) ** 2, "sigmoid": np.tanh(0.7 * inner + 1)}
    for kernel, values in wanted.items():
        got = df.select(scoring.landmark_features(F.col("v"), marks.tolist(), kernel, 0.7, 2, 1.0)).collect()
        assert np.allclose([r[0] for r in got], values)


def test_softmax_and_importance(spark):
    df = spark.createDataFrame([([1000.0, 1001.0], 1.0), ([0.0, 0.0], 3.0)], "s array<double>, a double")
    soft = [r[0] for r in df.select(scoring.softmax(F.col("s"))).collect()]
    assert soft[1] == [0.5, 0.5] and soft[0][1] == pytest.approx(1 / (1 + np.exp(-1)))
    assert [r["prediction"] for r in scoring.score_importance(df, ["a"], [2.0]).collect()] == [0.0, 1.0]
    assert [r["prediction"] for r in scoring.score_importance(df.filter("a = 1"), ["a"], [2.0]).collect()] == [0.5]
    assert [r["prediction"] for r in scoring.score_importance(df, ["a"], [2.0], task="regression").collect()] == [2.0, 6.0]


def test_scalars_texts_and_lists_under_metadata_names(spark):
    docs = [{"m": [1.0, 3.0], "c": 3.5, "kernel": "rbf", "n_features": 2, "n_leaves": [2, 4], "a.b": 1, "a": {"b": 3}, "deep": {"x": [[[[5]]]]}},
            {"m": [3.0, 5.0], "c": 4.5, "kernel": "lin", "n_features": 2, "n_leaves": [4, 8], "a.b": 1, "a": {"b": 3}, "deep": {"x": [[[[7]]]]}}]
    averaged = A.fedavg(A.flatten_params(documents(spark, docs), "document", KEYS))
    got = {(r["path"], tuple(r["pos"])): r["value"] if r["metadata"] is None else r["metadata"] for r in averaged.collect()}
    assert got == {
        ("m", (0,)): 2.0, ("m", (1,)): 4.0, ("c", ()): 4.0, ("kernel", ()): "rbf", ("n_features", ()): "2", ("n_leaves", (0,)): 3.0, ("n_leaves", (1,)): 6.0,
        ("a\\.b", ()): 1.0, ("a.b", ()): 3.0, ("deep.x", (0, 0, 0, 0)): 6.0,
    }
    rebuilt = {(r["path"], None if r["lead"] is None else tuple(r["lead"])): r["values"] or r["metadata"] for r in A.fedavg_rebuild(averaged).collect()}
    assert rebuilt[("kernel", None)] == "rbf" and rebuilt[("deep.x", (0, 0, 0))] == [6.0]
    with pytest.raises(Exception, match="not a number for every client"):
        A.fedavg(A.flatten_params(documents(spark, [{"c": 1}, {"c": "x"}]), "document", KEYS)).collect()


def test_nesting_ignores_brackets_in_strings(spark):
    texts = ['{"a": [1, {"b": "[[[\\"{"}]}', "3", "[]", '{"x": {}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(A.nesting(F.col("t"))).collect()] == [3, 0, 1, 2]


def in_blocks(spark, docs):
    return A.blocks_to_long(A.fedavg_blocks(A.parameter_blocks(documents(spark, docs), "document", KEYS)))


@pytest.mark.parametrize("block", [65_536, 3])
def test_blocks_average_like_the_long_form(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block)
    docs = [
        {"w": [[1.5, 2, 3, 4, 5, 6, 7], [8.0]], "v": [1, 2, 3, 4], "deep": {"x": [[[[5]]]], "e": []}, "c": 3.5, "s": "7", "kernel": "rbf", "names": ["a", "b"], "n_features": 2, "n_leaves": [2, 4], "a.b": 1, "task_type": None},
        {"w": [[0.5, 2, 3, 4, 5, 6], [9.25]], "v": [1.0], "deep": {"x": [[[[7]]]], "e": []}, "c": 4.5, "s": "9", "kernel": "lin", "names": ["c", "d"], "n_features": 3, "n_leaves": [4, 8], "a.b": 1, "task_type": "x"},
        {"w": [[1.0, 2, 3, 4, 5, 6], [1.25]], "v": [1, 1, 1, 1, 2], "c": -2, "s": "1", "kernel": "lin", "names": ["c", "d"], "n_features": 3, "n_leaves": [4, 8], "a.b": 5, "task_type": "x"},
    ]
    told = lambda df: sorted((r["path"], r["pos"], None if r["value"] is None else round(r["value"], 9), r["metadata"]) for r in df.collect())
    assert told(in_blocks(spark, docs)) == told(averaged(spark, docs))


def test_blocks_refuse_what_is_no_number(spark):
    for docs, message in (([{"c": 1}, {"c": "x"}], "not a number for every client"), ([{"w": [1, None]}], "not a number for every client"), ([{"w": [1, "x"]}], "numbers and other things")):
        with pytest.raises(Exception, match=message):
            in_blocks(spark, docs).collect()


def test_typed_blocks_agree_with_json(spark):
    df = spark.createDataFrame([(1, 1, 7, [[1.0, 2.0], [3.0]], 4.0)], "session_id int, round int, client_id int, w array<array<float>>, c double")
    typed = A.array_blocks(df, "w", KEYS).unionByName(A.array_blocks(df, "c", KEYS))
    parsed = A.parameter_blocks(df.select(*KEYS, F.to_json(F.struct("w", "c")).alias("d")), "d", KEYS)
    assert rows(typed.drop("text"), "path", "lead") == rows(parsed.drop("text"), "path", "lead")


def shuffled_bytes(df):
    """Bytes written by all exchanges of an executed plan."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(node.executedPlan())
        elif name == "ShuffleQueryStage":
            yield from walk(node.plan())
        else:
            if name == "Exchange":
                yield node.metrics().apply("shuffleBytesWritten").value()
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))
    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_a_layer_of_ten_million_weights(spark):
    size, clients = 10_000_000, 6
    weights = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.xxhash64(i, F.col("id")) / 2.0**63)
    df = spark.range(0, clients, 1, clients).select(F.lit(1).alias("session_id"), F.lit(1).alias("round"), F.col("id").alias("client_id"), weights.alias("w"))
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/ten-million"
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    averaged = A.fedavg_blocks(A.array_blocks(stored, "w", KEYS), totals=stored.groupBy("session_id", "round").agg(F.count("client_id").alias("num_clients")))
    got = {r["block"]: r["values"] for r in averaged.collect()}
    assert len(got) == -(-size // A.BLOCK) and sum(map(len, got.values())) == size
    assert shuffled_bytes(averaged) <= 1.2 * 8 * size * clients
    wanted = stored.select(F.posexplode(F.slice("w", size - 4, 5)).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()
    assert got[max(got)][-5:] == pytest.approx([r["x"] for r in wanted])


@pytest.mark.parametrize("model", ["linear", "logistic"])
@pytest.mark.parametrize("broadcast, unrolled", [(4_000_000, 64), (0, 64), (4_000_000, 2)])
def test_planes_match_numpy_per_client(spark, monkeypatch, model, broadcast, unrolled):
    from fedloom.operators import descent as D

    monkeypatch.setattr(D, "BROADCAST_WEIGHTS", broadcast)
    monkeypatch.setattr(D, "UNROLLED_SUMS", unrolled)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 0.3 + rng.normal(0, 0.2, 240)
    y = (y > 0).astype(float) if model == "logistic" else y
    who = [None if i % 7 == 6 else int(i % 7 % 4) for i in range(240)]
    df = spark.createDataFrame([(c, *map(float, r), float(t)) for c, r, t in zip(who, x, y)], "client int, a double, b double, `c d` double, e double, y double")
    got = D.federated_descent(df, "client", ["a", "b", "c d", "e"], "y", df, rounds=3, rate=0.2, steps=3, model=model).orderBy("round").collect()
    ones, w = np.column_stack([x, np.ones(240)]), np.zeros(5)
    for r in got:
        local = []
        for client in {*who}:
            own, v = [i for i, c in enumerate(who) if c == client], w
            for _ in range(3):
                z = ones[own] @ v
                gap = z - y[own] if model == "linear" else 1 / (1 + np.exp(-z)) - y[own]
                v = v - 0.2 * (2 if model == "linear" else 1) * ones[own].T @ gap / len(own)
            local.append(v)
        w = np.mean(local, axis=0)
        assert [*r["weights"], r["intercept"]] == pytest.approx(w.tolist()) and r["clients"] == 5
        z = ones @ w
        if model == "linear":
            assert (r["mse"], r["mae"]) == (pytest.approx(np.mean((y - z) ** 2)), pytest.approx(np.mean(abs(y - z))))
        else:
            p = 1 / (1 + np.exp(-z))
            assert r["log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) and r["accuracy"] == pytest.approx(np.mean((p >= 0.5) == y))


def test_descent_refuses_gaps(spark, line):
    odd = line.unionByName(spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan"))], "client int, x double, y double"))
    with pytest.raises(ValueError, match="2 rows"):
        models.linear_gd(odd, F.col("x"), F.col("y"))
    with pytest.raises(ValueError, match="2 training rows"):
        models.federated_rounds(odd, "client", "x", "y", line, rounds=1)
    with pytest.raises(Exception, match="2 test rows"):
        models.federated_descent(line, "client", ["x"], "y", odd, rounds=1, model="logistic").collect()
    with pytest.raises(ValueError, match="unknown model"):
        models.federated_descent(line, "client", ["x"], "y", line, rounds=1, model="cubic")
