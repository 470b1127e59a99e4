"""Evaluation metrics as aggregates over ``(label, prediction)`` with optional group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLIP = 1e-15


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def msle(y: Column, p: Column) -> Column:
    gap = F.log1p(y) - F.log1p(p)
    return F.avg(gap * gap)


def mape(y: Column, p: Column) -> Column:
    """In percent; rows with a zero label have no ratio and are left out."""
    return F.avg(F.abs(F.try_divide((y - p).cast("double"), y.cast("double")))) * 100


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _hits(y: Column, p: Column) -> Column:
    return F.count_if((y == 1) & (p == 1))


def precision(y: Column, p: Column) -> Column:
    return _share(_hits(y, p), F.count_if(p == 1))


def recall(y: Column, p: Column) -> Column:
    return _share(_hits(y, p), F.count_if(y == 1))


def f1(y: Column, p: Column) -> Column:
    a, b = precision(y, p), recall(y, p)
    return _share(2 * a * b, a + b)


def log_loss(y: Column, p: Column) -> Column:
    inside = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return -F.avg(y * F.log(inside) + (1 - y) * F.log(1 - inside))


def r2_variance(y: Column, p: Column) -> Column:
    """1 - var(residual) / var(label); NULL for a constant label."""
    return 1 - F.try_divide(F.var_pop(y - p), F.var_pop(y))


def r2_ss(y: Column, p: Column) -> Column:
    """1 - SSres / SStot; 0 for a constant label."""
    total = F.var_pop(y) * F.count(y)
    return F.coalesce(1 - F.try_divide(F.sum((y - p) * (y - p)), total), F.lit(0.0))


AGGREGATES = {
    "mse": mse, "mae": mae, "rmse": rmse, "msle": msle, "mape": mape, "accuracy": accuracy,
    "precision": precision, "recall": recall, "f1_score": f1, "log_loss": log_loss, "r2_score": r2_variance,
}
# Accepted metric names and the name each stands for.
ALIASES = {
    "f1": "f1_score", "r2": "r2_score", "logloss": "log_loss",
    "mean_squared_error": "mse", "mean_absolute_error": "mae", "root_mean_squared_error": "rmse",
}


def metric(df: DataFrame, name: str, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """One metric as column ``value``."""
    known = ALIASES.get(name.lower(), name.lower())
    if known == "auc":
        return auc(df, label, prediction, by).withColumnRenamed("auc", "value")
    if known == "r2_ss":
        function = r2_ss
    elif known in AGGREGATES:
        function = AGGREGATES[known]
    else:
        raise ValueError(f"unknown metric {name!r}")
    return df.groupBy(*by).agg(function(F.col(label), F.col(prediction)).alias("value"))


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction) pair that occurs."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence | None = None) -> DataFrame:
    """Counts of the pairs of classes that occur; with ``classes`` also the empty cells between those.

    The full matrix is quadratic in the classes, so their list has to be stated.
    """
    counts = confusion_counts(df, label, prediction)
    if classes is None:
        return counts
    kind = df.schema[label].dataType
    cells = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], T.StructType([T.StructField(c, kind) for c in ("label", "prediction")]))
    empty = cells.join(counts, ["label", "prediction"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    return counts.unionByName(empty)


def weighted_prf(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of each class, averaged by the class's share of labels."""
    counts = confusion_counts(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    actual = counts.select(*by, F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).alias("predicted"), hit.alias("hits"))
    predicted = counts.select(*by, F.col("prediction").alias("class"), F.lit(0).alias("support"), F.col("count").alias("predicted"), F.lit(0).alias("hits"))
    classes = actual.unionByName(predicted).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    p, r = _share(F.col("hits"), F.col("predicted")), _share(F.col("hits"), F.col("support"))
    scored = classes.select(*by, "support", p.alias("p"), r.alias("r"), _share(2 * p * r, p + r).alias("f"))
    weighted = {"precision": "p", "recall": "r", "f1_score": "f"}
    return scored.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(n) for n, c in weighted.items()])


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids, tied scores taken together.

    Scores are counted first, so a hot score travels once per map task.  Range
    slices over (group, score) follow the data in number and in place; running
    counts are taken inside a slice, and slice totals give each slice its
    start: no task sees all scores, nor all scores of a group.  Rows without a
    label, or whose score is NULL or NaN, are left out.
    """
    s, y = F.col(score).cast("double"), F.col(label)
    counts = df.filter(s.isNotNull() & ~F.isnan(s) & y.isNotNull()).groupBy(*by, s.alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")
    )
    sliced = counts.repartitionByRange(*by, F.desc("s")).withColumn("slice", F.spark_partition_id())
    inside = W.partitionBy(*by, "slice").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.currentRow)
    stepped = sliced.withColumn("tp", F.sum("pos").over(inside))
    # per slice: positives, negatives, and the area counted from the slice's own start
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    slices = stepped.groupBy(*by, "slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(area).alias("area"))
    above = W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    placed = slices.withColumn("start", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    total = F.sum(F.col("area") + F.col("neg") * F.col("start"))
    return placed.groupBy(*by).agg(
        F.coalesce(F.try_divide(total.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.0)).alias("auc")
    )


AVERAGED = ("precision", "recall", "f1_score")
REPORTED = AGGREGATES | {"r2_ss": r2_ss}


def metrics_report(df: DataFrame, metrics: Sequence[str], label: str = "label", prediction: str = "prediction", by: Sequence[str] = (),
                   average: str = "binary", score: str | None = None) -> DataFrame:
    """Requested metrics in long form, rounded half-even to three places.

    The area under the curve and the log loss take ``score``, a probability or
    margin, where there is one beside the predicted class.

    All aggregates share one pass; the area under the curve needs its own, and
    so do precision, recall and F1 with ``average="weighted"`` (several
    classes).  A name that is not known gives a row with ``known`` false and no
    value.
    """
    resolved = [(m, ALIASES.get(m.lower(), m.lower())) for m in metrics]
    weighted = [k for _, k in resolved if k in AVERAGED and average == "weighted"]
    plain = [(m, k) for m, k in resolved if k in REPORTED and k not in weighted]
    unknown = [m for m, k in resolved if k not in REPORTED and k != "auc"]
    y, p = F.col(label), F.col(prediction)
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.bround(REPORTED[k](y, F.col(score) if score and k == "log_loss" else p), 3).alias(f"m{i}") for i, (_, k) in enumerate(plain)],
    )
    rows = [F.struct(F.lit(k).alias("metric"), F.col(f"m{i}").alias("value"), F.lit(True).alias("known")) for i, (_, k) in enumerate(plain)]
    rows += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("known")) for m in unknown]
    empty = "array<struct<metric: string, value: double, known: boolean>>"
    long = wide.select(*by, F.inline(F.array(*rows) if rows else F.array().cast(empty)))
    if weighted:
        scores = weighted_prf(df, label, prediction, by)
        cells = [F.struct(F.lit(k).alias("metric"), F.bround(k, 3).alias("value"), F.lit(True).alias("known")) for k in weighted]
        long = long.unionByName(scores.select(*by, F.inline(F.array(*cells))))
    if any(k == "auc" for _, k in resolved):
        curve = auc(df, label, score or prediction, by)
        long = long.unionByName(curve.select(*by, F.lit("auc").alias("metric"), F.bround("auc", 3).alias("value"), F.lit(True).alias("known")))
    return long


def report_map(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long-form metrics folded into one map per group (a few entries each)."""
    return long.filter("known").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics_report"))


def threshold_class(probability: Column, threshold: float = 0.5) -> Column:
    """Class 1 at or above the threshold."""
    return F.when(probability >= threshold, 1).otherwise(0)


def sign_class(margin: Column) -> Column:
    """Class 0 for a negative margin, else 1."""
    return F.when(margin < 0, 0).otherwise(1)


def argmax_class(scores: Column) -> Column:
    """0-based index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
