"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from . import inputs
from .inputs import table
from .registry import query, rounded, with_


def _metric_query(key: str, source: str, expression: str, prediction: str = "prediction", digits: int = 6) -> None:
    load = getattr(inputs, source)

    @query(key, with_(source, f"SELECT round({expression}, {digits})::DOUBLE AS value FROM {source}"))
    def run(spark, d):
        return rounded(M.metric(load(spark, d), key, prediction=prediction), digits)


GAP = "label - prediction"
TP = "count(*) FILTER (label = 1 AND prediction = 1)"
PREDICTED, ACTUAL = "count(*) FILTER (prediction = 1)", "count(*) FILTER (label = 1)"
_P, _R = f"coalesce({TP} / nullif({PREDICTED}, 0), 0)", f"coalesce({TP} / nullif({ACTUAL}, 0), 0)"
#: The four metrics of two classes, under their reported names.
CLASS_VALUES = {"accuracy": "avg((label = prediction)::INT)", "precision": _P, "recall": _R, "f1_score": f"coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0)"}
CLIPPED = "greatest(1e-15, least(1 - 1e-15, score))"
LOG_LOSS = f"-avg(label * ln({CLIPPED}) + (1 - label) * ln(1 - {CLIPPED}))"
R2 = f"1 - var_pop({GAP}) / var_pop(label)"

_metric_query("mse", "regression_pairs", f"avg(({GAP}) * ({GAP}))", digits=2)
_metric_query("mae", "regression_pairs", f"avg(abs({GAP}))", digits=4)
_metric_query("rmse", "regression_pairs", f"sqrt(avg(({GAP}) * ({GAP})))", digits=4)
_metric_query("msle", "regression_pairs", "avg((ln(1 + label) - ln(1 + prediction)) * (ln(1 + label) - ln(1 + prediction)))")
_metric_query("mape", "regression_pairs", f"avg(abs(({GAP}) / label)) * 100")
_metric_query("accuracy", "binary_pairs", "avg((label = prediction)::INT)")
_metric_query("precision", "binary_pairs", f"{TP} / {PREDICTED}")
_metric_query("recall", "binary_pairs", f"{TP} / {ACTUAL}")
_metric_query("f1", "binary_pairs", f"2 * ({TP} / {PREDICTED}) * ({TP} / {ACTUAL}) / ({TP} / {PREDICTED} + {TP} / {ACTUAL})")
_metric_query("log_loss", "binary_pairs", LOG_LOSS, prediction="score")


@query("weighted_prf", with_(
    "class_pairs",
    """SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
    round(sum(support * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(support), 6) AS f1_score FROM m""",
    k="SELECT DISTINCT label AS c FROM class_pairs",
    s="""SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted,
    count(*) FILTER (label = c AND prediction = c) AS hits FROM class_pairs, k GROUP BY c""",
    m="SELECT support, coalesce(hits / nullif(predicted, 0), 0) AS p, hits / support AS r FROM s",
))
def weighted_prf(spark, d):
    return rounded(M.weighted_prf(inputs.class_pairs(spark, d)))


#: The classes of the given events.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("confusion_matrix", with_("class_pairs", """SELECT a.label, b.label AS prediction, (SELECT count(*) FROM class_pairs c WHERE c.label = a.label AND c.prediction = b.label) AS count
    FROM (SELECT DISTINCT label FROM class_pairs) a, (SELECT DISTINCT label FROM class_pairs) b"""))
def confusion_matrix(spark, d):
    return M.confusion_matrix(inputs.class_pairs(spark, d), classes=EVENT_TYPES)


AUC = """(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))"""
RANKED_SCORES = "(SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM binary_pairs)"


@query("auc", with_("binary_pairs", f"SELECT round({AUC}, 6) AS auc FROM {RANKED_SCORES}"))
def auc(spark, d):
    return rounded(M.auc(inputs.binary_pairs(spark, d)))


@query("r2_variance", with_("regression_pairs", f"SELECT round({R2}, 6) AS value FROM regression_pairs"))
def r2_variance(spark, d):
    return rounded(M.metric(inputs.regression_pairs(spark, d), "r2_score"))


@query("r2_ss", with_("regression_pairs", f"SELECT grp, round(1 - sum(({GAP}) * ({GAP})) / (var_pop(label) * count(*)), 6) AS value FROM regression_pairs GROUP BY grp"))
def r2_ss(spark, d):
    return rounded(M.metric(inputs.regression_pairs(spark, d), "r2_ss", by=["grp"]))


REPORT = {
    "mae": f"avg(abs({GAP}))", "rmse": f"sqrt(avg(({GAP}) * ({GAP})))",
    "msle": "avg((ln(1 + label) - ln(1 + prediction)) * (ln(1 + label) - ln(1 + prediction)))",
    "mape": f"avg(abs(({GAP}) / label)) * 100", "r2_score": R2,
}


@query("metrics_report", with_("regression_pairs", "binary_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT grp, '{m}' AS metric, round_even({e}, 3) AS value, true AS known FROM regression_pairs GROUP BY grp" for m, e in REPORT.items()) +
    f""" UNION ALL SELECT DISTINCT grp, 'speed', NULL::DOUBLE, false FROM regression_pairs
    UNION ALL SELECT 'events', 'auc', round_even({AUC}, 3), true FROM {RANKED_SCORES}
    UNION ALL SELECT 'events', 'log_loss', round_even({LOG_LOSS}, 3), true FROM binary_pairs)"""))
def metrics_report(spark, d):
    groups = M.metrics_report(inputs.regression_pairs(spark, d), [*REPORT, "speed"], by=["grp"])
    scores = M.metrics_report(inputs.binary_pairs(spark, d), ["auc", "log_loss"], prediction="score")
    return groups.unionByName(scores.withColumn("grp", F.lit("events")))


@query("threshold_classes", "SELECT event_id, (value / 490 >= 0.5)::INTEGER AS at_half, (value - 250 >= 0)::INTEGER AS by_sign FROM events")
def threshold_classes(spark, d):
    return table(spark, d, "events").select(
        "event_id", M.threshold_class(F.col("value") / 490).alias("at_half"), M.sign_class(F.col("value") - 250).alias("by_sign")
    )


@query("argmax_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS class FROM embeddings")
def argmax_class(spark, d):
    return table(spark, d, "embeddings").select("vec_id", M.argmax_class(F.col("embedding")).alias("class"))
