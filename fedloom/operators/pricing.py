"""Power analysis: how much training data a promised improvement costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.power import ALPHA, MAX_SIZE, MIN_SIZE, limits_per_alpha
from ..session import materialize
from .reports import benchmark_values, task_of, with_info

# Fixed value: price of a session without a measurable effect.
DEFAULT_PRICE = 100
# a level brings 170 doubles, so this many stay below 14 MB
BROADCAST_LEVELS = 10_000



def cohens_d(mean1: Column, mean2: Column, std1: Column, std2: Column) -> Column:
    """Standardised difference of two groups; NULL when neither group varies."""
    pooled = F.sqrt((std1 * std1 + std2 * std2) / 2)
    return F.try_divide(mean2 - mean1, pooled)


def effect_size(mean1: Column, mean2: Column, std1: Column, std2: Column) -> Column:
    """1/d; 0 when neither group varies, NULL when the means agree."""
    pooled = F.sqrt((std1 * std1 + std2 * std2) / 2)
    return F.when(pooled == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), cohens_d(mean1, mean2, std1, std2)))


def group_effect(df: DataFrame, value: str, group: Column, first, second, by: list[str]) -> DataFrame:
    """d and effect size of two groups per key, from one aggregate."""
    x = F.col(value)
    measured = df.groupBy(*by).agg(*[
        f(F.when(group == g, x)).alias(n)
        for g, tag in ((first, "1"), (second, "2"))
        for f, n in ((F.avg, "mean" + tag), (F.stddev_samp, "std" + tag))
    ])
    sides = [F.col(n) for n in ("mean1", "mean2", "std1", "std2")]
    return measured.select(*by, cohens_d(*sides).alias("d"), effect_size(*sides).alias("effect_size"))


def num_predictors(layers: Column) -> Column:
    """Filters of the last convolution in an array of layers, 0 without one."""
    convolutions = F.filter(layers, lambda x: x["layer_type"] == "convolution")
    return F.coalesce(F.try_element_at(convolutions, F.lit(-1))["filters"].try_cast("int"), F.lit(0))


def bonferroni_alpha(predictors: Column, alpha: float = ALPHA) -> Column:
    return F.when(predictors > 0, F.lit(alpha) / predictors).otherwise(F.lit(alpha))


def required_sample_size(df: DataFrame, effect: str, alpha: str, name: str = "sample_size") -> DataFrame:
    """Rows per group that detect ``effect`` at level ``alpha``, within [30, 200].

    Only distinct levels reach Python; each gives one array of falling limits.
    The size is 30 plus the number of limits above the effect, found by an
    equi-join on the level and an array expression.  NULL without an effect.
    Rows share few levels, so a level is a hot key: the limits are counted and
    sent to the rows, unless there are unusually many of them.
    """
    levels = df.select(F.col(alpha).alias("limit_alpha")).distinct()
    limits = materialize(levels.mapInPandas(limits_per_alpha, "limit_alpha double, limits array<double>"))
    if limits.count() <= BROADCAST_LEVELS:
        limits = F.broadcast(limits)
    size = F.lit(MIN_SIZE) + _limits_above(F.col("limits"), F.abs(F.col(effect)))
    usable = F.col(effect).isNotNull() & (F.col(effect) != 0) & F.col("limits").isNotNull()
    joined = df.join(limits, F.col(alpha) == F.col("limit_alpha"), "left")
    return joined.withColumn(name, F.when(usable, size)).drop("limit_alpha", "limits")


def _limits_above(limits: Column, effect: Column) -> Column:
    """How many of the falling limits lie above the effect.

    limit(n) * sqrt(n / 2) falls slowly, so its values at both ends bracket n
    within a few steps; only the limits inside the bracket are compared.
    """
    count = MAX_SIZE - MIN_SIZE

    def steps(limit: Column, n: int) -> Column:
        n_at = F.least(F.lit(float(MAX_SIZE)), n * (limit / effect) * (limit / effect))
        return F.greatest(F.lit(0), n_at.cast("int") - MIN_SIZE)

    low = F.least(F.lit(count), steps(limits[count - 1], MAX_SIZE - 1))
    high = F.least(F.lit(count), steps(limits[0], MIN_SIZE) + 1)
    inside = F.slice(limits, low + 1, F.greatest(F.lit(0), high - low))
    return low + F.size(F.filter(inside, lambda limit: limit > effect))


def session_prices(sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Price of each session: required sample size against its task's benchmark."""
    baseline = benchmark_values(tasks).filter("benchmark_mean is not null and benchmark_std is not null")
    document = with_info(sessions, "task_id", "expected_std_mean", "expected_std_deviation", "model_info")
    quoted = document.select(
        F.col("id").alias("session_id"),
        task_of().alias("task_id"),
        F.col("info.expected_std_mean").try_cast("double").alias("new_mean"),
        F.col("info.expected_std_deviation").try_cast("double").alias("new_std"),
        num_predictors(F.col("info.model_info.layers")).alias("predictors"),
    ).join(baseline.select("task_id", "benchmark_mean", "benchmark_std"), "task_id")
    effect = effect_size(F.col("benchmark_mean"), F.col("new_mean"), F.col("benchmark_std"), F.col("new_std"))
    sized = quoted.withColumns({"effect_size": effect, "alpha": bonferroni_alpha(F.col("predictors"))})
    # a few numbers per session, kept so that the documents are not parsed again for the levels
    priced = required_sample_size(materialize(sized), "effect_size", "alpha")
    price = F.coalesce("sample_size", F.lit(DEFAULT_PRICE)).cast("double")
    return priced.select("session_id", "task_id", "predictors", "alpha", "effect_size", price.alias("price"))
