"""Federated averaging, pricing, training and scoring queries."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import federated as A
from ..operators import hinge as H
from ..operators import models, pricing, reports, rounds, scoring
from ..operators import network as N
from ..operators import trees as T
from . import evaluation as E
from . import inputs
from .inputs import table
from .registry import query, rounded, with_

CLIENT_KEYS = ["session_id", "round", "client_id"]


def parameters(spark, d):
    return A.flatten_params(inputs.parameters(spark, d), "document", CLIENT_KEYS)


def blocks(spark, d):
    return A.parameter_blocks(inputs.parameters(spark, d), "document", CLIENT_KEYS)


def _at(df):
    """Positions as plain columns; -1 where the level is missing."""
    return df.withColumns({"i": F.coalesce(F.get("pos", F.lit(0)), F.lit(-1)), "j": F.coalesce(F.get("pos", F.lit(1)), F.lit(-1))}).drop("pos")


def totals(spark, d):
    return inputs.parameters(spark, d).groupBy("session_id", "round").agg(F.count_distinct("client_id").alias("num_clients"))


@query("flatten_params", with_("long_params", "SELECT session_id, round, client_id, path, i, j, round(value, 6) AS value FROM long_params"))
def flatten_params(spark, d):
    numbers = parameters(spark, d).filter(~A.is_metadata(F.col("path"))).drop("text")
    return rounded(_at(numbers)).select(*CLIENT_KEYS, "path", "i", "j", "value")


@query("fedavg", with_("long_params", """SELECT session_id, round, path, i, j, round(avg(value), 6) + 0.0 AS value, '' AS metadata FROM long_params GROUP BY ALL
    UNION ALL SELECT label, (vec_id % 3 + 1)::INTEGER, 'n_features', -1, -1, NULL, '64' FROM embeddings GROUP BY 1, 2
    UNION ALL SELECT label, (vec_id % 3 + 1)::INTEGER, 'task_type', -1, -1, NULL, 'client ' || min(vec_id) FROM embeddings GROUP BY 1, 2"""))
def fedavg(spark, d):
    averaged = A.blocks_to_long(A.fedavg_blocks(blocks(spark, d), totals=totals(spark, d)))
    return rounded(_at(averaged).withColumn("metadata", F.coalesce("metadata", F.lit("")))).select("session_id", "round", "path", "i", "j", "value", "metadata")


@query("fedavg_rebuild", with_("long_params", """SELECT session_id, round, path, CASE WHEN j >= 0 THEN i ELSE -1 END AS lead, CASE WHEN j >= 0 THEN j ELSE i END AS k,
    round(avg(value), 6) + 0.0 AS value FROM long_params GROUP BY ALL"""))
def fedavg_rebuild(spark, d):
    rows = A.fedavg_blocks(blocks(spark, d), totals=totals(spark, d))
    lead = F.coalesce(F.get("lead", F.lit(0)), F.lit(-1)).alias("lead")
    cells = rows.select("session_id", "round", "path", lead, "block", F.posexplode("values").alias("k", "value"))
    return rounded(cells.withColumn("k", F.col("k") + F.col("block") * A.BLOCK).drop("block"))


@query("fedavg_metadata", "SELECT label AS session_id, (vec_id % 3 + 1)::INTEGER AS round, count(DISTINCT vec_id) AS num_clients FROM embeddings GROUP BY ALL")
def fedavg_metadata(spark, d):
    long = A.flatten_array(table(spark, d, "embeddings").selectExpr("label AS session_id", "CAST(vec_id % 3 + 1 AS INT) AS round", "vec_id AS client_id", "embedding AS weights"), "weights", CLIENT_KEYS)
    return A.fedavg_metadata(long)


@query("stale_round_filter", with_("sessions", "submissions", """SELECT b.session_id, b.user_id, b.round_number, b.price FROM submissions b JOIN sessions s
    ON b.session_id = s.id AND b.round_number = s.curr_round"""))
def stale_round_filter(spark, d):
    return rounds.stale_round_filter(inputs.submissions(spark, d), inputs.sessions(spark, d)).select("session_id", "user_id", "round_number", "price")


@query("task_baseline", with_("tasks", """SELECT task_id, metric, round(benchmark_mean, 6) AS benchmark_mean, benchmark_std,
    CASE WHEN benchmark_mean IS NULL THEN 'missing' ELSE 'ok' END AS status FROM tasks"""))
def task_baseline(spark, d):
    return rounded(reports.task_baseline(inputs.tasks(spark, d)))


COHEN = """SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2,
    stddev_samp(l_extendedprice) FILTER (l_returnflag = 'N') AS s1, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS s2 FROM lineitem GROUP BY l_suppkey"""


@query("cohens_d", f"""SELECT l_suppkey, round((m2 - m1) / sqrt((s1 * s1 + s2 * s2) / 2), 6) + 0.0 AS d,
    round(sqrt((s1 * s1 + s2 * s2) / 2) / (m2 - m1), 3) AS effect_size FROM ({COHEN})""")
def cohens_d(spark, d):
    effects = pricing.group_effect(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag"), "N", "R", ["l_suppkey"])
    return effects.select("l_suppkey", F.round("d", 6).alias("d"), F.round("effect_size", 3).alias("effect_size"))


def predictors(spark, d):
    layers = F.col("info.model_info.layers")
    return reports.with_info(inputs.sessions(spark, d), "model_info").select("id", pricing.num_predictors(layers).alias("predictors"))


@query("num_predictors", with_("sessions", "SELECT id, predictors FROM sessions"))
def num_predictors(spark, d):
    return predictors(spark, d)


@query("bonferroni_alpha", with_("sessions", "SELECT id, round(CASE WHEN predictors > 0 THEN 0.05::DOUBLE / predictors ELSE 0.05 END, 9) AS alpha FROM sessions"))
def bonferroni_alpha(spark, d):
    return rounded(predictors(spark, d).select("id", pricing.bonferroni_alpha(F.col("predictors")).alias("alpha")), 9)


#: Normal quantiles of the two-sided levels, by the number of predictors a level is divided by.
LEVELS = ", ".join(f"({p}, {NormalDist().inv_cdf(1 - 0.05 / max(p, 1) / 2)!r}::DOUBLE)" for p in range(0, 41, 8))
#: Mean over s = sqrt(chi2 / df), weighted by its density, of the normal tail at z (7.1.26 of Abramowitz and Stegun).
TAIL = "sum(w * CASE WHEN {z} < 0 THEN 1 - {q} ELSE {q} END) / sum(w)"
_Q = "(1 - 0.5 * (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-least({z} * {z} / 2, 700)))"


def _tail_sql(z: str) -> str:
    return TAIL.format(z=z, q=_Q.format(z=z, t=f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0::DOUBLE)))"))


@query("required_sample_size", with_("sessions", "tasks", """SELECT p.session_id, p.task_id, p.predictors, round(p.alpha, 6) AS alpha, round(p.effect_size, 6) AS effect_size,
    CASE WHEN z.size IS NULL THEN 100 ELSE greatest(30, least(200, z.size)) END::DOUBLE AS price FROM priced p LEFT JOIN sized z ON p.predictors = z.predictors AND abs(p.effect_size) = z.e""",
    priced="""SELECT id AS session_id, task_id, predictors, CASE WHEN predictors > 0 THEN 0.05::DOUBLE / predictors ELSE 0.05::DOUBLE END AS alpha,
        CASE WHEN new_mean <> benchmark_mean THEN 1.0::DOUBLE / ((new_mean - benchmark_mean) / sqrt((benchmark_std * benchmark_std + new_std * new_std) / 2)) END AS effect_size
        FROM sessions JOIN tasks USING (task_id) WHERE benchmark_mean IS NOT NULL AND benchmark_std IS NOT NULL""",
    levels=f"SELECT * FROM (VALUES {LEVELS}) v(predictors, z)",
    # a normal approximation of the size, and the sizes round it
    tried="""SELECT predictors, e, z, unnest(range(c - 3, c + 4)) AS n FROM (SELECT predictors, e, z, greatest(27, least(203, ceil(2 * ((z + 0.8416) / e) ** 2 + z * z / 4)))::INTEGER AS c
        FROM (SELECT DISTINCT predictors, abs(effect_size) AS e FROM priced WHERE effect_size <> 0) JOIN levels USING (predictors))""",
    # Student's quantile by the expansion 26.7.5 of Abramowitz and Stegun
    critical="""SELECT predictors, e, n, 2.0::DOUBLE * n - 2 AS v, least(e * sqrt(n / 2.0::DOUBLE), 100) AS shift, z + (z ** 3 + z) / 4 / v + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96 / v ** 2
        + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384 / v ** 3 + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160 / v ** 4 AS t FROM tried""",
    grid="""SELECT predictors, e, n, shift - t * s AS above, -shift - t * s AS below, exp((v - 1) * ln(s) - v * (s * s - 1) / 2) AS w
        FROM (SELECT *, 1 + k * 0.16::DOUBLE / sqrt(2 * v) AS s FROM critical, (SELECT unnest(range(-50, 51)) AS k))""",
    power=f"SELECT predictors, e, n, {_tail_sql('above')} + {_tail_sql('below')} AS power FROM grid GROUP BY ALL",
    # no tried size reaches the power only where all of them are beyond the greatest size
    sized="SELECT predictors, e, coalesce(min(n) FILTER (power >= 0.8), 200) AS size FROM power GROUP BY ALL"))
def required_sample_size(spark, d):
    return rounded(pricing.session_prices(inputs.sessions(spark, d), inputs.tasks(spark, d)))


# --- training --------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: The same inputs at one size.
SCALED = {"quantity": "l_quantity / 50", "discount": "l_discount * 10", "tax": "l_tax * 10"}


@query("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def linear_regression(spark, d):
    got = models.linear_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").parameters()
    fitted = spark.createDataFrame([(got["weights"][0], got["intercept"])], "slope double, intercept double")
    return fitted.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


LINE_X, LINE_Y = "l_quantity / 50", "l_extendedprice / 100000"


def _descent_sql(sums: str, steps: int, start: str, rate: float, label: str, keys: str = "") -> dict[str, str]:
    """One named select per step of gradient descent on a table of sums."""
    parts = {f"{label}0": f"SELECT *, {start} FROM {sums}"}
    for i in range(1, steps + 1):
        parts[f"{label}{i}"] = f"""SELECT * EXCLUDE (m, c), m - {rate} * (-2.0 / n * (sxy - m * sxx - c * sx)) AS m,
            c - {rate} * (-2.0 / n * (sy - m * sx - c * n)) AS c FROM {label}{i - 1}"""
    return parts


def _sums_sql(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {key}count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM {source}{group}"


@query("linear_gd", with_("SELECT round(m, 6) AS m, round(c, 6) AS c FROM g20", xy=f"SELECT {LINE_X} AS x, {LINE_Y} AS y FROM lineitem", sums=_sums_sql("xy"),
    **_descent_sql("sums", 20, "0.0::DOUBLE AS m, 0.0::DOUBLE AS c", 0.1, "g")))
def linear_gd(spark, d):
    got = models.linear_gd(table(spark, d, "lineitem"), F.expr(LINE_X), F.expr(LINE_Y), rate=0.1, steps=20)
    return rounded(spark.createDataFrame([(got["m"], got["c"])], "m double, c double"))


def labelled(spark, d):
    """Line items with a two-class and a three-class target."""
    return table(spark, d, "lineitem").selectExpr(
        *FEATURES, "l_extendedprice", "l_extendedprice / 100000 AS price",
        "CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END AS dear",
        f"{NOISY} AS high", "CASE WHEN l_extendedprice < 30000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END AS band",
    )


CLASS_METRICS = ["accuracy", "precision", "recall", "f1"]


#: A two-class target that depends on the inputs, with keys for noise.
NOISY = "CASE WHEN l_quantity + 150 * l_tax - 100 * l_discount + (l_suppkey * 7 + l_partkey * 3) % 31 > 42 THEN 1 ELSE 0 END"


def _newton_step(before: str) -> str:
    """Weights w0 to w3 after one Newton step: the 4 x 4 equations of the scores, by elimination."""
    x = ["1", *FEATURES]
    sums = [f"sum((s - n * p) * {x[i]}) AS a{i}4" for i in range(4)] + [f"sum(n * p * (1 - p) * {x[i]} * {x[j]}) AS a{i}{j}" for i in range(4) for j in range(4)]
    w = ", ".join(f"w{i}" for i in range(4))
    margin = " + ".join(f"w{i} * {x[i]}" for i in range(4))
    sql = f"SELECT {w}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM cells, {before}) GROUP BY {w}"
    for k in range(3):
        left = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, 4) for j in range(k + 1, 5)]
        kept = [f"a{i}{j}" for i in range(k + 1) for j in range(i, 5)]
        sql = f"SELECT {w}, {', '.join(kept + left)} FROM ({sql})"
    back = [f"({' - '.join([f'a{i}4', *(f'a{i}{j} * d{j}' for j in range(i + 1, 4))])}) / a{i}{i} AS d{i}" for i in (3, 2, 1, 0)]
    return f"SELECT {', '.join(f'w{i} + d{i} AS w{i}' for i in range(4))} FROM (SELECT *, {', '.join(back)} FROM ({sql}))"


def _logistic_sql(steps: int = 8) -> str:
    parts = {
        "cells": f"SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATURES)}, count(*)::DOUBLE AS n, sum({NOISY})::DOUBLE AS s FROM lineitem GROUP BY ALL",
        "b0": f"SELECT {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(4))}",
    } | {f"b{i}": _newton_step(f"b{i - 1}") for i in range(1, steps + 1)}
    fitted = " + ".join(["w0", *(f"w{i} * {c}" for i, c in enumerate(FEATURES, 1))])
    parts |= {
        "scored": f"SELECT *, (score >= 0.5)::INTEGER AS prediction FROM (SELECT {NOISY} AS label, 1 / (1 + exp(-({fitted}))) AS score FROM lineitem, b{steps})",
        "ranked": "SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored",
    }
    values = E.CLASS_VALUES | {"log_loss": E.LOG_LOSS, "auc": E.AUC}
    rows = [f"SELECT '{m}' AS metric, round_even({e}, 3) AS value FROM ranked" for m, e in values.items()]
    rows += [f"SELECT 'weight_{c}', round(w{i}, 3) FROM b{steps}" for i, c in enumerate(["intercept", *FEATURES])]
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("logistic_regression", _logistic_sql())
def logistic_regression(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*FEATURES, f"{NOISY} AS high")
    fitted = models.logistic_regression(rows, FEATURES, "high", maxIter=200, tol=1e-12)
    numbers = fitted.parameters()
    weights = [(f"weight_{c}", round(w, 3)) for c, w in zip(["intercept", *FEATURES], [numbers["intercept"], *numbers["weights"]], strict=True)]
    report = fitted.evaluate(rows, [*CLASS_METRICS, "log_loss", "auc"])
    return report.select("metric", "value").unionByName(spark.createDataFrame(weights, "metric string, value double"))


def _hinge_sql(label: str, rows: str, inputs: list[str], classes: list[int], ridge: float, rate: float, steps: int) -> tuple[dict[str, str], list[str]]:
    """Subgradient steps of every margin, and its primal and dual value, on a table of inputs and ``label``."""
    names, parts, out = [*inputs, "1.0::DOUBLE"], {}, []
    k = len(inputs)
    margin = " + ".join(f"w{i} * {x}" for i, x in enumerate(names))
    w = ", ".join(f"w{i}" for i in range(k + 1))
    for c in classes[1:] if len(classes) == 2 else classes:
        side, own = f"(CASE WHEN label = {c} THEN 1.0::DOUBLE ELSE -1.0 END)", f"{label}_{c}_"
        parts[f"{own}0"] = f"SELECT {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(k + 1))}"
        for t in range(1, steps + 1):
            inside = f"{side} * ({margin}) < 1"
            moved = [f"w{i} - {rate / t ** 0.5!r}::DOUBLE * ({f'{ridge} * w{i}' if i < k else '0'} - sum(CASE WHEN {inside} THEN {side} * {x} ELSE 0 END) / count(*)) AS w{i}" for i, x in enumerate(names)]
            parts[f"{own}{t}"] = f"SELECT {', '.join(moved)} FROM {rows}, {own}{t - 1} GROUP BY {w}"
        short = "s * z < 1"
        sums = ", ".join(f"coalesce(sum({x}) FILTER (s > 0 AND {short}), 0) AS p{i}, coalesce(sum({x}) FILTER (s < 0 AND {short}), 0) AS m{i}" for i, x in enumerate(inputs))
        parts[f"{own}sums"] = f"""SELECT {w}, count(*)::DOUBLE AS n, avg(greatest(0, 1 - s * z)) AS loss, count(*) FILTER (s > 0 AND {short})::DOUBLE AS p, count(*) FILTER (s < 0 AND {short})::DOUBLE AS m, {sums}
            FROM (SELECT *, {side} AS s, {margin} AS z FROM {rows}, {own}{steps}) GROUP BY {w}"""
        pull = " + ".join(f"((least(p, m) / p * p{i} - least(p, m) / m * m{i}) / ({ridge} * n)) ** 2" for i in range(k))
        norm = " + ".join(f"w{i} * w{i}" for i in range(k))
        parts[f"{own}value"] = f"""SELECT *, primal - dual AS gap FROM (SELECT *, share * mass - share * share * {ridge} / 2 * size AS dual FROM (SELECT *, least(1, mass / ({ridge} * size)) AS share
            FROM (SELECT *, {ridge} / 2 * ({norm}) + loss AS primal, 2 * least(p, m) / n AS mass, {pull} AS size FROM {own}sums)))"""
        out += [f"SELECT '{label}' AS target, {c} AS class, '{n}' AS name, round({e}, 6) + 0.0 AS value FROM {own}value" for n, e in
            [("primal", "primal"), ("dual", "dual"), ("gap", "gap"), *((f"w{i}", f"w{i}") for i in range(k)), ("bias", f"w{k}")]]
    return parts, out


def _certified(spark, target, classes, weights, certificates):
    """Primal, dual, gap and weights of each margin as rows."""
    rows = []
    for c, w, held in zip(classes[1:] if len(classes) == 2 else classes, weights, certificates):
        values = {"primal": held.primal, "dual": held.dual, "gap": held.gap} | {f"w{i}": v for i, v in enumerate(w[:-1])} | {"bias": w[-1]}
        rows += [(target, c, n, round(v, 6) + 0.0) for n, v in values.items()]
    return spark.createDataFrame(rows, "target string, class int, name string, value double")


def _svm_sql(steps: int) -> str:
    scaled = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in SCALED.items())
    parts, out = {}, []
    for target, e, classes in SVM_TARGETS:
        parts[f"{target}_rows"] = f"SELECT {scaled}, {e} AS label FROM lineitem"
        more, rows = _hinge_sql(target, f"{target}_rows", list(SCALED), classes, 0.01, 1.0, steps)
        parts, out = parts | more, out + rows
    return with_(" UNION ALL ".join(out), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


SVM_TARGETS = [
    ("dear", "CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END", [0, 1]),
    ("band", "CASE WHEN l_extendedprice < 30000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END", [0, 1, 2]),
]
SVM_STEPS = 8


@query("linear_svm", _svm_sql(SVM_STEPS))
def linear_svm(spark, d):
    """Weights of two and of three classes after some steps, each margin with its primal and dual value and the gap."""
    rows = table(spark, d, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in SCALED.items()], *[f"{e} AS {n}" for n, e, _ in SVM_TARGETS])
    done = []
    for target, _, classes in SVM_TARGETS:
        m = H.linear_hinge(rows, list(SCALED), target, classes, ridge=0.01, rate=1.0, steps=SVM_STEPS)
        done.append(_certified(spark, target, classes, [[*w, b] for w, b in zip(m.weights, m.biases)], m.certificates))
    return reduce(DataFrame.unionByName, done)


LANDMARKS = 6
KERNELS = {
    "rbf": "exp(-0.5 * list_distance(e.v, l.v) ** 2)",
    "linear": "list_inner_product(e.v, l.v)",
    "polynomial": "(list_inner_product(e.v, l.v) + 1) ** 3",
    "sigmoid": "tanh(0.5 * list_inner_product(e.v, l.v) + 1)",
}


@query("landmark_features", with_("SELECT e.vec_id, l.k, " + ", ".join(f"round({s}, 5) + 0.0 AS {n}" for n, s in KERNELS.items()) + " FROM e, l",
    e="SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    l=f"SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1)::INTEGER AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {LANDMARKS}"))
def landmark_features(spark, d):
    rows = table(spark, d, "embeddings")
    chosen = scoring.pick_landmarks(rows, "embedding", "vec_id", LANDMARKS)
    kernels = [scoring.landmark_features(F.col("embedding"), chosen, k, gamma=0.5, degree=3, coef0=0.0 if k == "linear" else 1.0) for k in KERNELS]
    zipped = F.arrays_zip(*[k.alias(n) for n, k in zip(KERNELS, kernels)])
    out = rows.select("vec_id", F.posexplode(zipped).alias("k", "z"))
    return rounded(out.select("vec_id", "k", *[F.col("z").getField(n).alias(n) for n in KERNELS]), 5)


def _landmark_sql(steps: int) -> str:
    names = [f"k{i}" for i in range(LANDMARKS)]
    near = ", ".join(f"exp(-0.5 * list_distance(v, (SELECT v FROM l WHERE k = {i})) ** 2) AS k{i}" for i in range(LANDMARKS))
    parts = {
        "l": f"SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1)::INTEGER AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {LANDMARKS}",
        "near": f"SELECT {near}, label % 2 AS label FROM (SELECT embedding::DOUBLE[] AS v, label FROM embeddings)",
    }
    more, rows = _hinge_sql("even", "near", names, [0, 1], 0.01, 1.0, steps)
    return with_(" UNION ALL ".join(rows), **parts, **more).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("landmark_svm", _landmark_sql(6))
def landmark_svm(spark, d):
    """Support vectors on kernels against landmark rows, with their certificate."""
    rows = table(spark, d, "embeddings")
    chosen = scoring.pick_landmarks(rows, "embedding", "vec_id", LANDMARKS)
    near = scoring.landmark_features(F.col("embedding"), chosen, "rbf", gamma=0.5)
    weights, held = H.kernel_hinge(rows, near, LANDMARKS, F.col("label") % 2, [0, 1], ridge=0.01, rate=1.0, steps=6)
    return _certified(spark, "even", [0, 1], weights, held)


def _tree_sql(depth: int) -> str:
    """Exact greedy splits by Gini impurity on sums of equal feature rows, level by level; sibling leaves of one class are merged."""

    def gini(n: str, s: str) -> str:
        return f"(1 - ({s} / {n}) ** 2 - (1 - {s} / {n}) ** 2)"

    parts = {"c0": f"SELECT 1 AS node, {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATURES)}, count(*)::DOUBLE AS n, sum({NOISY})::DOUBLE AS s FROM lineitem GROUP BY ALL"}
    for level in range(depth):
        long = " UNION ALL ".join(f"SELECT node, '{c}' AS f, {c} AS v, sum(n) AS n, sum(s) AS s FROM c{level} GROUP BY ALL" for c in FEATURES)
        cut = f"""SELECT node, f, v, sum(n) OVER upto AS ln, sum(s) OVER upto AS ls, sum(n) OVER own AS n, sum(s) OVER own AS s FROM ({long})
            WINDOW upto AS (PARTITION BY node, f ORDER BY v), own AS (PARTITION BY node, f)"""
        gain = f"{gini('n', 's')} - ln / n * {gini('ln', 'ls')} - (n - ln) / n * {gini('(n - ln)', '(s - ls)')}"
        parts[f"s{level}"] = f"""SELECT node, f, v, n * gain AS weight FROM (SELECT *, {gain} AS gain FROM ({cut}) WHERE ln < n)
            WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1"""
        side = " ".join(f"WHEN f = '{c}' AND {c} > v THEN 1" for c in FEATURES)
        parts[f"c{level + 1}"] = f"SELECT 2 * node + CASE {side} ELSE 0 END AS node, {', '.join(FEATURES)}, n, s FROM c{level} JOIN s{level} USING (node)"
    parts[f"l{depth}"] = f"SELECT node, (2 * sum(s) > sum(n))::INTEGER AS class FROM c{depth} GROUP BY node"
    for level in reversed(range(depth)):  # l: nodes that are leaves, i: nodes that stay split
        parts[f"m{level}"] = f"SELECT node // 2 AS node, min(class) AS class FROM l{level + 1} GROUP BY node // 2 HAVING count(*) = 2 AND min(class) = max(class)"
        parts[f"l{level}"] = f"""SELECT * FROM m{level} UNION ALL
            SELECT node, (2 * sum(s) > sum(n))::INTEGER FROM c{level} WHERE node NOT IN (SELECT node FROM s{level}) GROUP BY node"""
        parts[f"i{level}"] = f"SELECT *, {level + 1} AS depth FROM s{level} WHERE node NOT IN (SELECT node FROM m{level})"
    parts["inner_nodes"] = " UNION ALL ".join(f"SELECT * FROM i{level}" for level in range(depth))
    ends = [f"SELECT node, n, s FROM c{depth}", *(f"SELECT node, n, s FROM c{level} WHERE node NOT IN (SELECT node FROM s{level})" for level in range(depth))]
    parts["ends"] = f"SELECT sum(greatest(s, n - s)) / sum(n) AS hit FROM (SELECT node, sum(n) AS n, sum(s) AS s FROM ({' UNION ALL '.join(ends)}) GROUP BY node)"
    rows = ["SELECT 'mse' AS metric, round_even(1 - hit, 3) AS value FROM ends", "SELECT 'accuracy', round_even(hit, 3) FROM ends", "SELECT 'trees', 1.0",
        "SELECT 'average_depth', coalesce(max(depth), 0) FROM inner_nodes", "SELECT 'average_nodes', 1 + 2 * count(*) FROM inner_nodes", "SELECT 'average_leaves', 1 + count(*) FROM inner_nodes"]
    rows += [f"SELECT 'importance_{c}', round(coalesce(sum(weight) FILTER (f = '{c}'), 0) / sum(weight), 6) FROM inner_nodes" for c in FEATURES]
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _tree_query(key: str, train, sql: str | None = None) -> None:
    @query(key, sql)
    def run(spark, d):
        rows = labelled(spark, d)
        grown = train(rows)
        facts = grown.parameters()
        sizes = [(n, float(v)) for n, v in facts.items() if n != "importances"] + [(f"importance_{c}", v) for c, v in zip(FEATURES, facts["importances"])]
        report = grown.evaluate(rows, ["mse", "accuracy"])
        return report.select("metric", "value").unionByName(rounded(spark.createDataFrame(sizes, "metric string, value double")))


# more bins than values, so every cut between two values is tried
_tree_query("decision_tree", lambda rows: models.decision_tree(rows, FEATURES, "high", maxDepth=4, maxBins=64, seed=7), _tree_sql(4))

def _grown_sql(first: str, depth: int, ridge: float, rate: float, tried: int, label: str) -> dict[str, str]:
    """Trees of ``first`` (tree, node, inputs, g, h) grown level by level, as tables of splits and leaves."""
    parts = {f"{label}c0": first}
    cells = ", ".join(FEATURES)
    for level in range(depth):
        c, long = f"{label}c{level}", []
        for i, name in enumerate(FEATURES):
            long.append(f"SELECT tree, node, {i} AS f, {name} AS v, sum(g) AS g, sum(h) AS h FROM {c} GROUP BY ALL")
        run = f"""SELECT tree, node, f, v, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER own AS g, sum(h) OVER own AS h FROM ({' UNION ALL '.join(long)})
            WINDOW upto AS (PARTITION BY tree, node, f ORDER BY v), own AS (PARTITION BY tree, node, f)"""
        gain = f"round(gl * gl / (hl + {ridge}) + (g - gl) ** 2 / (h - hl + {ridge}) - g * g / (h + {ridge}), 6)"
        parts[f"{label}s{level}"] = f"""SELECT tree, node, f, v, gain FROM (SELECT *, {gain} AS gain FROM ({run}) WHERE hl >= 1 AND h - hl >= 1)
            WHERE gain > 0 AND f IN (SELECT x FROM (SELECT unnest(range(0, {len(FEATURES)})) AS x) ORDER BY md5(tree || ':' || node || ':' || x) LIMIT {tried})
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, v) = 1"""
        side = " ".join(f"WHEN f = {i} AND {name} > v THEN 1" for i, name in enumerate(FEATURES))
        parts[f"{label}c{level + 1}"] = f"SELECT tree, 2 * node + CASE {side} ELSE 0 END AS node, {cells}, g, h FROM {c} JOIN {label}s{level} USING (tree, node)"
    ends = [f"SELECT * FROM {label}c{depth}"] + [f"SELECT * FROM {label}c{level} ANTI JOIN {label}s{level} USING (tree, node)" for level in range(depth)]
    parts[f"{label}ends"] = " UNION ALL ".join(ends)
    parts[f"{label}leaves"] = f"SELECT tree, node, -sum(g) / (sum(h) + {ridge}) * {rate} AS value FROM {label}ends GROUP BY tree, node"
    parts[f"{label}splits"] = " UNION ALL ".join(f"SELECT * FROM {label}s{level}" for level in range(depth))
    return parts


def _nodes_sql(label: str, tree: str = "tree") -> list[str]:
    names = "['" + "', '".join(FEATURES) + "']"
    return [
        f"SELECT 'split' AS kind, {tree} AS tree, node, {names}[f + 1] AS input, round(v, 6) AS cut, round(gain, 3) AS value FROM {label}splits",
        f"SELECT 'leaf', {tree}, node, '', NULL, round(value, 6) + 0.0 FROM {label}leaves",
    ]


def _shown_trees(spark, trees, errors):
    """Nodes and leaves as rows, and errors beside them."""
    rows = []
    for t, tree in enumerate(trees):
        rows += [("split", t, n, FEATURES[i], round(cut, 6), round(tree.gains[n], 3)) for n, (i, cut) in tree.splits.items()]
        rows += [("leaf", t, n, "", None, round(v, 6) + 0.0) for n, v in tree.leaves.items()]
    rows += [("error", t, 0, "", None, round(e, 6)) for t, e in enumerate(errors)]
    return spark.createDataFrame(rows, "kind string, tree int, node int, input string, cut double, value double")


def _boosting_sql(trees: int, depth: int, rate: float) -> str:
    cells = ", ".join(f"{c}::DOUBLE AS {c}" for c in FEATURES)
    parts = {"m0": f"""SELECT {cells}, count(*)::DOUBLE AS n, sum({LINE_Y}) AS sy, sum(({LINE_Y}) ** 2) AS syy, (SELECT avg({LINE_Y}) FROM lineitem) AS m FROM lineitem GROUP BY ALL"""}
    rows = []
    for t in range(trees):
        parts |= _grown_sql(f"SELECT {t} AS tree, 1 AS node, {', '.join(FEATURES)}, n * m - sy AS g, n AS h FROM m{t}", depth, 1.0, rate, len(FEATURES), f"t{t}")
        parts[f"m{t + 1}"] = f"SELECT {', '.join('a.' + c for c in FEATURES)}, n, sy, syy, m + value AS m FROM m{t} a JOIN t{t}ends e USING ({', '.join(FEATURES)}) JOIN t{t}leaves USING (tree, node)"
        rows += _nodes_sql(f"t{t}")
    rows += [f"SELECT 'error', {t}, 0, '', NULL, round(sum(syy - 2 * m * sy + n * m * m) / sum(n), 6) FROM m{t}" for t in range(trees + 1)]
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("gradient_boosting", _boosting_sql(3, 3, 0.3))
def gradient_boosting(spark, d):
    fitted = T.boosted_trees(labelled(spark, d), FEATURES, "price", trees=3, depth=3, rate=0.3)
    return _shown_trees(spark, fitted.trees, fitted.errors)


BAG_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _forest_sql(trees: int, depth: int, tried: int) -> str:
    bits = f"('0x' || md5({' || chr(58) || '.join(c + '::VARCHAR' for c in BAG_KEY)} || ':' || tree)[1:8])::BIGINT / {float(1 << 32)}"
    weight = " + ".join(f"({bits} >= {p!r}::DOUBLE)::INTEGER" for p in T.POISSON)
    cells = ", ".join(FEATURES)
    parts = {
        "drawn": f"SELECT row, tree, {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATURES)}, {LINE_Y} AS y, {weight} AS w FROM (SELECT *, row_number() OVER () AS row FROM lineitem), (SELECT unnest(range(0, {trees}))::INTEGER AS tree)",
        **_grown_sql(f"SELECT tree, 1 AS node, {cells}, -sum(w * y) AS g, sum(w)::DOUBLE AS h FROM drawn GROUP BY ALL", depth, 0.0, 1.0, tried, "b"),
        "guess": f"SELECT row, any_value(y) AS y, avg(value) AS m FROM drawn JOIN bends USING (tree, {cells}) JOIN bleaves USING (tree, node) WHERE w = 0 GROUP BY row",
    }
    rows = [*_nodes_sql("b"), "SELECT 'error', 0, 0, '', NULL, round(avg((y - m) ** 2), 6) FROM guess"]
    rows += [f"SELECT 'importance', 0, 0, '{c}', NULL, round(coalesce(sum(gain) FILTER (f = {i}), 0) / sum(gain), 4) FROM bsplits" for i, c in enumerate(FEATURES)]
    rows += [
        "SELECT 'average_depth', 0, 0, '', NULL, round(avg(d), 4) FROM (SELECT tree, max(floor(log2(node)) + 1) AS d FROM bsplits GROUP BY tree)",
        f"SELECT 'average_nodes', 0, 0, '', NULL, ((SELECT count(*) FROM bsplits) + (SELECT count(*) FROM bleaves)) / {float(trees)}",
        f"SELECT 'average_leaves', 0, 0, '', NULL, (SELECT count(*) FROM bleaves) / {float(trees)}",
    ]
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("random_forest", _forest_sql(4, 3, 2))
def random_forest(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*BAG_KEY, *FEATURES, f"{LINE_Y} AS price")
    fitted = T.bagged_trees(rows, FEATURES, "price", BAG_KEY, trees=4, depth=3, tried=2)
    facts = T.facts(fitted.trees, FEATURES)
    more = [("importance", 0, 0, c, None, round(v, 4)) for c, v in zip(FEATURES, facts["importances"])]
    more += [(n, 0, 0, "", None, round(facts[n], 4)) for n in ("average_depth", "average_nodes", "average_leaves")]
    shown = _shown_trees(spark, fitted.trees, [fitted.error])
    return shown.unionByName(spark.createDataFrame(more, shown.schema))


# --- scoring -----------------------------------------------------------------------

WEIGHTS, BIAS = [0.04, -2.0, 1.5], -0.9
MARGIN = "l_quantity * 0.04 + l_discount * -2.0 + l_tax * 1.5 - 0.9"
KEY = "l_orderkey, l_linenumber, l_suppkey"
KEYS = KEY.split(", ")


@query("score_linear", f"SELECT {KEY}, round({MARGIN}, 6) + 0.0 AS prediction FROM lineitem")
def score_linear(spark, d):
    return rounded(table(spark, d, "lineitem").select(*KEYS, scoring.score_linear(FEATURES, WEIGHTS, BIAS).alias("prediction")))


@query("score_logistic", f"SELECT {KEY}, round(1 / (1 + exp(-({MARGIN}))), 6) AS probability, (1 / (1 + exp(-({MARGIN}))) >= 0.6)::INTEGER AS class FROM lineitem")
def score_logistic(spark, d):
    return rounded(table(spark, d, "lineitem").select(
        *KEYS, scoring.score_logistic(FEATURES, WEIGHTS, BIAS).alias("probability"),
        scoring.score_logistic_class(FEATURES, WEIGHTS, BIAS, 0.6).alias("class"),
    ))


CLASS_WEIGHTS = [[0.01137, 3.0171, 1.0093], [-0.02019, 1.0037, 4.0111], [0.03041, -2.0053, 0.5023]]
CLASS_BIASES = [0.10071, 0.70113, -0.30017]


def _sql_sum(weights, bias, cells) -> str:
    return " + ".join(f"({c}) * {float(w)}::DOUBLE" for c, w in zip(cells, weights)) + f" + {float(bias)}::DOUBLE"


CLASS_SCORES = "[" + ", ".join(_sql_sum(w, b, FEATURES) for w, b in zip(CLASS_WEIGHTS, CLASS_BIASES)) + "]"


@query("score_svm", f"""SELECT {KEY}, (round({MARGIN}, 9) >= 0)::INTEGER AS binary_class, (list_position(s, list_max(s)) - 1)::INTEGER AS class
    FROM (SELECT *, {CLASS_SCORES} AS s FROM lineitem)""")
def score_svm(spark, d):
    return table(spark, d, "lineitem").select(
        *KEYS, scoring.sign_class(F.round(scoring.score_linear(FEATURES, WEIGHTS, BIAS), 9)).alias("binary_class"),
        scoring.score_svm(FEATURES, CLASS_WEIGHTS, CLASS_BIASES).alias("class"),
    )


# a 3-4-3 network and the statistics its inputs are scaled by
NET = [
    [[0.5, -0.3, 0.2, 0.7], [-0.4, 0.6, 0.1, -0.2], [0.3, 0.2, -0.5, 0.4]],
    [[0.6, -0.2, 0.3], [0.1, 0.5, -0.4], [-0.3, 0.2, 0.6], [0.4, -0.6, 0.1]],
]
NET_BIASES = [[0.1, -0.1, 0.05, 0.0], [0.02, 0.1, -0.05]]
NET_MEAN, NET_SCALE = [25.0, 0.05, 0.04], [14.0, 0.03, 0.025]


def _net_sql(activation: str) -> list[str]:
    cells = [f"({c} - {m}::DOUBLE) / {s}::DOUBLE" for c, m, s in zip(FEATURES, NET_MEAN, NET_SCALE)]
    hidden = [activation.format(z=_sql_sum([row[j] for row in NET[0]], NET_BIASES[0][j], cells)) for j in range(4)]
    return [_sql_sum([row[j] for row in NET[1]], NET_BIASES[1][j], [f"h[{i + 1}]" for i in range(4)]) for j in range(3)], hidden


_OUT, _HIDDEN = _net_sql("greatest(0.0::DOUBLE, {z})")


@query("score_mlp", f"""SELECT {KEY}, round(o[1], 6) + 0.0 AS value, (list_position(o, list_max(o)) - 1)::INTEGER AS class FROM
    (SELECT *, [{', '.join(_OUT)}] AS o FROM (SELECT *, [{', '.join(_HIDDEN)}] AS h FROM lineitem))""")
def score_mlp(spark, d):
    rows = table(spark, d, "lineitem")
    options = {"weights": NET, "biases": NET_BIASES, "mean": NET_MEAN, "scale": NET_SCALE}
    scored = scoring.score_mlp(rows, FEATURES, task="regression", name="value", **options)
    scored = scoring.score_mlp(scored, FEATURES, task="classification", num_classes=3, name="class", **options)
    return rounded(scored.select(*KEYS, "value", "class"))


def _step_sql(label: str, target: str, activation: tuple[str, str], weights, biases, classes: int | None, rate: float) -> tuple[dict[str, str], list[str]]:
    """One full-batch step of backpropagation from stated weights, unit by unit, with the loss before and after."""
    value, slope = activation
    cells = [f"({c} - {m}::DOUBLE) / {s}::DOUBLE" for c, m, s in zip(FEATURES, NET_MEAN, NET_SCALE)]
    hidden, outs = len(weights[0][0]), len(weights[1][0])

    def forward(weight, into: str, source: str) -> dict[str, str]:
        z1 = ", ".join(f"{' + '.join(f'x{i} * {weight(0, i, j)}' for i in range(3))} + {weight(0, None, j)} AS z{j}" for j in range(hidden))
        h = ", ".join(f"{value.format(z=f'z{j}')} AS h{j}" for j in range(hidden))
        o = ", ".join(f"{' + '.join(f'h{j} * {weight(1, j, k)}' for j in range(hidden))} + {weight(1, None, k)} AS o{k}" for k in range(outs))
        if classes:
            total = " + ".join(f"exp(o{k})" for k in range(outs))
            right = " + ".join(f"CASE WHEN y = {k} THEN o{k} ELSE 0 END" for k in range(outs))
            back, loss = [f"exp(o{k}) / ({total}) - (y = {k})::INTEGER AS d{k}" for k in range(outs)], f"ln({total}) - ({right})"
        else:
            back, loss = ["o0 - y AS d0"], "(o0 - y) ** 2 / 2"
        return {into: f"SELECT *, {', '.join(back)}, {loss} AS loss FROM (SELECT *, {o} FROM (SELECT *, {h} FROM (SELECT *, {z1} FROM {source})))"}

    def given(layer: int, row, col: int) -> str:
        return f"({biases[layer][col] if row is None else weights[layer][row][col]})::DOUBLE"

    parts = {f"{label}x": f"SELECT {', '.join(f'{c} AS x{i}' for i, c in enumerate(cells))}, ({target})::DOUBLE AS y FROM lineitem"} | forward(given, f"{label}f", f"{label}x")
    chained = [f"({' + '.join(f'{given(1, j, k)} * d{k}' for k in range(outs))}) * {slope.format(a=f'h{j}')}" for j in range(hidden)]
    moved = {}
    for j in range(hidden):
        moved |= {f"w0_{i}_{j}": f"{given(0, i, j)} - {rate} * avg(x{i} * {chained[j]})" for i in range(3)} | {f"b0_{j}": f"{given(0, None, j)} - {rate} * avg({chained[j]})"}
    for k in range(outs):
        moved |= {f"w1_{j}_{k}": f"{given(1, j, k)} - {rate} * avg(h{j} * d{k})" for j in range(hidden)} | {f"b1_{k}": f"{given(1, None, k)} - {rate} * avg(d{k})"}
    parts[f"{label}w"] = f"SELECT {', '.join(f'{e} AS {n}' for n, e in moved.items())}, avg(loss) AS loss FROM {label}f"
    parts |= forward(lambda layer, row, col: f"b{layer}_{col}" if row is None else f"w{layer}_{row}_{col}", f"{label}g", f"(SELECT x.*, w.* EXCLUDE (loss) FROM {label}x x, {label}w w)")
    rows = [f"SELECT '{label}' AS model, '{n}' AS name, round({n}, 6) + 0.0 AS value FROM {label}w" for n in moved]
    rows += [f"SELECT '{label}', 'loss before', round(loss, 6) FROM {label}w", f"SELECT '{label}', 'loss after', round(avg(loss), 6) FROM {label}g"]
    return parts, rows


#: Per hidden activation: its SQL, its slope from its value, the target, classes or None, and which output units are kept.
NET_STEPS = {
    "tanh": (("tanh({z})", "(1 - {a} * {a})"), "CASE WHEN l_extendedprice < 30000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END", 3),
    "logistic": (("(1 / (1 + exp(-({z}))))", "{a} * (1 - {a})"), "CASE WHEN l_extendedprice < 30000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END", 3),
    "relu": (("greatest(0.0::DOUBLE, {z})", "({a} > 0)::INTEGER"), LINE_Y, None),
    "identity": (("({z})", "1"), LINE_Y, None),
}


def _net_start(classes):
    """The stated network, or its first output unit for a regression."""
    last = slice(None) if classes else slice(0, 1)
    return [NET[0], [row[last] for row in NET[1]]], [NET_BIASES[0], NET_BIASES[1][last]]


def _mlp_sql() -> str:
    parts, rows = {}, []
    for name, (activation, target, classes) in NET_STEPS.items():
        more, told = _step_sql(name, target, activation, *_net_start(classes), classes, 0.5)
        parts, rows = parts | more, rows + told
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("mlp_classifier", _mlp_sql())
def mlp_classifier(spark, d):
    """One full-batch step of a classifier and of a regression with each activation, from stated weights."""
    rows, told = labelled(spark, d), []
    for name, (_, _, classes) in NET_STEPS.items():
        label = "band" if classes else "price"
        net = N.network(rows, FEATURES, label, [4], classes, name, rate=0.5, steps=1, start=_net_start(classes), scaling=(NET_MEAN, NET_SCALE))
        for layer, (w, b) in enumerate(zip(net.weights, net.biases)):
            told += [(name, f"w{layer}_{i}_{j}", w[i][j]) for i in range(w.shape[0]) for j in range(w.shape[1])] + [(name, f"b{layer}_{j}", v) for j, v in enumerate(b)]
        told += [(name, "loss before", net.losses[0]), (name, "loss after", net.losses[1])]
    return spark.createDataFrame([(m, n, round(float(v), 6) + 0.0) for m, n, v in told], "model string, name string, value double")


IMPORTANCE = "l_quantity * 0.5 + l_discount * 0.3 + l_tax * 0.2"


@query("score_importance", f"""WITH s AS (SELECT *, {IMPORTANCE} AS s FROM lineitem) SELECT {KEY}, round((s - (SELECT min(s) FROM s)) / (SELECT max(s) - min(s) FROM s), 6) AS prediction FROM s""")
def score_importance(spark, d):
    return rounded(scoring.score_importance(table(spark, d, "lineitem"), FEATURES, [0.5, 0.3, 0.2]).select(*KEYS, "prediction"))


# stored parameters of one model of each kind, and the metrics of each
SCORED = ["accuracy", "precision", "recall", "f1", "log_loss", "auc"]
HIGH = "CASE WHEN l_quantity + l_tax * 100 > 30 THEN 1 ELSE 0 END"
STORED = {
    "linear": ({"kind": "linear", "weights": [1000.0, 5000.0, 2500.0], "intercept": 20000.0}, "l_extendedprice", ["mae", "rmse", "r2"]),
    "logistic": ({"kind": "logistic", "weights": WEIGHTS, "bias": -0.9037}, "high", SCORED),
    "svm": ({"kind": "svm", "weights": [WEIGHTS], "biases": [-0.9037]}, "high", [m for m in SCORED if m != "log_loss"]),
    "mlp": ({"kind": "mlp", "weights": [NET[0], [[row[0]] for row in NET[1]]], "biases": [NET_BIASES[0], NET_BIASES[1][:1]], "mean": NET_MEAN, "scale": NET_SCALE}, "high", SCORED),
    "importance": ({"kind": "importance", "importances": [0.5, 0.3, 0.2]}, "high", SCORED),
}


def _evaluated_sql() -> str:
    margin = _sql_sum(WEIGHTS, -0.9037, FEATURES)
    scores = {
        "logistic": (f"1 / (1 + exp(-({margin})))", 0.5), "svm": (margin, 0.0),
        "mlp": (f"1 / (1 + exp(-({_OUT[0]})))", 0.5), "importance": ("(imp - min(imp) OVER ()) / (max(imp) OVER () - min(imp) OVER ())", 0.5),
    }
    parts = {
        "rows": f"SELECT *, {HIGH} AS high, {IMPORTANCE} AS imp, [{', '.join(_HIDDEN)}] AS h FROM lineitem",
        "line": f"SELECT l_extendedprice AS label, {_sql_sum([1000.0, 5000.0, 2500.0], 20000.0, FEATURES)} AS prediction FROM lineitem",
        "scored": " UNION ALL ".join(f"SELECT '{m}' AS model, high AS label, score, (score >= {cut})::INTEGER AS prediction FROM (SELECT high, {e} AS score FROM rows)" for m, (e, cut) in scores.items()),
        "ranked": "SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM scored",
    }
    measures = E.CLASS_VALUES | {"log_loss": E.LOG_LOSS, "auc": E.AUC}
    rows = [f"SELECT 'linear' AS model, '{m}' AS metric, round_even({E.REPORT[m]}, 3) AS value, true AS known FROM line" for m in ("mae", "rmse", "r2_score")]
    rows += [f"SELECT model, '{m}', round_even({e}, 3), true FROM ranked{' WHERE model <> ' + repr('svm') if m == 'log_loss' else ''} GROUP BY model" for m, e in measures.items()]
    return with_(" UNION ALL ".join(rows), **parts)


@query("evaluate_model", _evaluated_sql())
def evaluate_model(spark, d):
    rows = table(spark, d, "lineitem").withColumn("high", F.expr(HIGH))
    reports_ = [scoring.evaluate_model(rows, model, FEATURES, label, wanted).withColumn("model", F.lit(name)) for name, (model, label, wanted) in STORED.items()]
    return reduce(DataFrame.unionByName, reports_).select("model", "metric", "value", "known")


PLANE_STEPS = {"linear": ("price", 3, 0.1, {"mse": "avg((y - {z}) ** 2)", "mae": "avg(abs(y - {z}))"}), "logistic": ("high", 2, 0.5, {
    "log_loss": "-avg(y * ln({p} + 1e-15) + (1 - y) * ln(1 - {p} + 1e-15))", "accuracy": "avg((({p} >= 0.5) = (y >= 0.5))::INTEGER)"})}


def _plane_sql(model: str, rounds_: int) -> dict[str, str]:
    """Local steps of every client on its own rows, averages, and metrics, spelt out row by row."""
    label, steps, rate, measures = PLANE_STEPS[model]
    names = [*SCALED, "1.0"]
    z = " + ".join(f"w{i} * {x}" for i, x in enumerate(names))
    chance = f"(1 / (1 + exp(-({z}))))"
    slope = [f"2 * sum((({z}) - y) * {x}) / count(*)" if model == "linear" else f"sum(({chance} - y) * {x}) / count(*)" for x in names]
    parts = {f"{model}_xy": f"SELECT client, test, {', '.join(SCALED)}, {label}::DOUBLE AS y FROM scaled",
        f"{model}0": f"SELECT 0 AS round, 0::BIGINT AS clients, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(4))}"}
    for r in range(1, rounds_ + 1):
        parts[f"{model}{r}_0"] = f"SELECT DISTINCT client, w0, w1, w2, w3 FROM {model}_xy, {model}{r - 1} WHERE NOT test"
        for t in range(1, steps + 1):
            moved = ", ".join(f"w{i} - {rate}::DOUBLE * {g} AS w{i}" for i, g in enumerate(slope))
            parts[f"{model}{r}_{t}"] = f"SELECT client, {moved} FROM {model}_xy JOIN {model}{r}_{t - 1} USING (client) WHERE NOT test GROUP BY client, w0, w1, w2, w3"
        parts[f"{model}{r}"] = f"SELECT {r} AS round, count(*) AS clients, {', '.join(f'avg(w{i}) AS w{i}' for i in range(4))} FROM {model}{r}_{steps}"
    scores = [f"SELECT round, clients, '{n}' AS name, {e.format(z=f'({z})', p=chance)} AS value FROM {model}_xy, {model}{r} WHERE test GROUP BY round, clients" for r in range(1, rounds_ + 1) for n, e in measures.items()]
    weights = [f"SELECT round, clients, '{n}', w{i} FROM {model}{r}" for r in range(1, rounds_ + 1) for i, n in enumerate([*SCALED, "intercept"])]
    parts[f"{model}_rows"] = " UNION ALL ".join(scores + weights)
    return parts


def _rounds_sql(count: int, steps: int, rate: float) -> str:
    parts = {
        "xy": f"SELECT l_suppkey AS client, {LINE_X} AS x, {LINE_Y} AS y FROM lineitem WHERE l_linestatus = 'O'",
        "test": f"SELECT {LINE_X} AS x, {LINE_Y} AS y FROM lineitem WHERE l_linestatus = 'F'",
        "sums": _sums_sql("xy", "client"),
    }
    for r in range(1, count + 1):
        start = "0.0::DOUBLE AS m, 0.0::DOUBLE AS c" if r == 1 else f"(SELECT m FROM a{r - 1}) AS m, (SELECT c FROM a{r - 1}) AS c"
        parts |= _descent_sql("sums", steps, start, rate, f"g{r}_")
        parts[f"a{r}"] = f"SELECT {r} AS round, count(*) AS clients, avg(m) AS m, avg(c) AS c FROM g{r}_{steps}"
    parts["line"] = f"""SELECT *, (SELECT avg((y - m * x - c) ** 2) FROM test) AS mse, (SELECT avg(abs(y - m * x - c)) FROM test) AS mae
        FROM ({' UNION ALL '.join(f'SELECT * FROM a{r}' for r in range(1, count + 1))})"""
    parts["scaled"] = f"SELECT l_suppkey AS client, l_linestatus = 'F' AS test, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in SCALED.items())}, {LINE_Y} AS price, {NOISY} AS high FROM lineitem"
    parts |= _plane_sql("linear", 2) | _plane_sql("logistic", 2)
    rows = [f"SELECT 'line' AS model, round, clients, '{n}' AS name, round({n}, 6) + 0.0 AS value FROM line" for n in ("m", "c", "mse", "mae")]
    rows += [f"SELECT '{m}', round, clients, name, round(value, 6) + 0.0 FROM {m}_rows" for m in PLANE_STEPS]
    return with_(" UNION ALL ".join(rows), **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _named(df, model: str, weights: dict, measures: list[str]):
    """One row per number of a round."""
    cells = {n: e for n, e in weights.items()} | {n: F.col(n) for n in measures}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), e.alias("value")) for n, e in cells.items()])).alias("cell")
    return df.select(F.lit(model).alias("model"), "round", "clients", each).select("model", "round", "clients", "cell.name", "cell.value")


@query("federated_rounds", _rounds_sql(3, 4, 0.1))
def federated_rounds(spark, d):
    """A line for three rounds, and planes of three inputs by squared and by logistic loss for two."""
    rows = table(spark, d, "lineitem").selectExpr(
        "l_suppkey", "l_linestatus", f"{LINE_X} AS x", f"{LINE_Y} AS y", *[f"{e} AS {n}" for n, e in SCALED.items()], f"{LINE_Y} AS price", f"{NOISY} AS high",
    )
    train, test = rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus = 'F'")
    line = models.federated_rounds(train, "l_suppkey", "x", "y", test, rounds=3, rate=0.1, steps=4)
    done = _named(line, "line", {"m": F.col("m"), "c": F.col("c")}, ["mse", "mae"])
    for model, (label, steps, rate, measures) in PLANE_STEPS.items():
        plane = models.federated_descent(train, "l_suppkey", list(SCALED), label, test, 2, rate, steps, model)
        weights = {n: F.col("weights")[i] for i, n in enumerate(SCALED)} | {"intercept": F.col("intercept")}
        done = done.unionByName(_named(plane, model, weights, list(measures)))
    return rounded(done)
