"""Dataset profile: one row per column.

The full profile reads the table a fixed number of times, whatever the number
of columns: one scan for the mergeable state (counts, moments, extremes,
sketches, array lengths and values), and side by side one pass over unpivoted
numbers per number type (histogram and distinct count from the same shuffle),
one over unpivoted strings, and where exact ranks are asked for those.
The single-purpose functions stay lazy and return long-form rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import evenly
from .columns import array_columns, as_double, fit, numeric_columns, present, q, string_columns, type_of
from .profile_state import RANK_BOUND, deviation, depth, flat_values, leaf, profile_state, report_rows, row_shape
from .quantiles import bracket_points, exact_quantiles, quantiles

BINS = 10
TOP = 10
SHOWN_CHARS = 50
RANK_ERROR = 0.05
QUARTILES = [0.25, 0.5, 0.75]

PROFILE_FIELDS = {
    "name": "string", "type": "string", "entries": "long", "null_count": "long", "unique_count": "long",
    "mean": "double", "stddev": "double", "min": "double", "max": "double",
    "q1": "double", "median": "double", "q3": "double", "iqr": "double",
    "hist_bins": "array<double>", "hist_counts": "array<long>",
    "top_categories": "array<struct<value: string, count: long>>",
    "shape": "array<int>", "len_min": "int", "len_max": "int", "len_mean": "double", "len_std": "double",
    "val_min": "double", "val_max": "double", "val_mean": "double", "val_std": "double",
    "val_median": "double", "val_sparsity": "double",
}
PROFILE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PROFILE_FIELDS.items())


def _wide(df: DataFrame, columns: Sequence[str], measures, constants=lambda c: {}) -> DataFrame:
    """One aggregate over all columns, turned into one row per column.

    ``measures(column)`` gives ``{name: aggregate}`` and ``constants(column)``
    ``{name: literal}``; all columns share the names.
    """
    if not columns:
        raise ValueError("no column of the needed type")
    wanted = {(c, n): e for c in columns for n, e in measures(c).items()}
    slots = {key: f"s{i}" for i, key in enumerate(wanted)}
    wide = df.agg(*[e.alias(slots[k]) for k, e in wanted.items()])
    names = list(measures(columns[0]))
    rows = [
        F.struct(F.lit(c).alias("name"), *[F.lit(v).alias(n) for n, v in constants(c).items()], *[F.col(slots[(c, n)]).alias(n) for n in names])
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def _nulls(df: DataFrame, c: str) -> Column:
    return F.count_if(q(c).isNull())


def profile_counts(df: DataFrame) -> DataFrame:
    """Entries (all rows) and NULLs of every column, with the table's width."""
    rows = _wide(
        df, df.columns, lambda c: {"entries": F.count(F.lit(1)), "null_count": _nulls(df, c)},
        lambda c: {"type": type_of(df, c).simpleString()},
    )
    return rows.withColumn("num_columns", F.lit(len(df.columns)))


def _moments(df: DataFrame, c: str) -> dict[str, Column]:
    x = q(c).cast("double")
    return {"mean": F.avg(x), "stddev": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum."""
    return _wide(df, columns or numeric_columns(df), lambda c: _moments(df, c))


def value_counts(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """``(name, value, count)`` of the given columns, one frame per value type.

    Columns of one type are unpivoted together, so each type costs one shuffle;
    counting starts before it, so frequent values travel once per map task.
    Strings have a further key column ``digest``: a long text travels as its
    shown beginning and the SHA-256 of the whole.
    """
    classes: dict[str, list[str]] = {}
    for c in columns:
        kind = type_of(df, c)
        if isinstance(kind, T.IntegralType):
            target = "bigint"
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            target = "double"
        else:
            target = "string"
        classes.setdefault(target, []).append(c)
    frames = []
    for target, names in classes.items():
        cells = [q(c).cast(target) for c in names]
        if target == "string":
            cells = [F.struct(F.substring(x, 1, SHOWN_CHARS).alias("text"), _digest(x).alias("digest")) for x in cells]
        slim = df.select(*[x.alias(f"c{i}") for i, x in enumerate(cells)])
        long = slim.unpivot([], [F.col(x) for x in slim.columns], "slot", "value")
        if target == "string":
            long = long.select("slot", F.col("value.text").alias("value"), F.col("value.digest").alias("digest"))
        keys = [c for c in long.columns if c != "slot"]
        counted = long.groupBy("slot", *keys).agg(F.count(F.lit(1)).alias("count"))
        frames.append(counted.select(_named(names).alias("name"), *keys, "count"))
    return frames


def _digest(text: Column) -> Column:
    """SHA-256 of a text longer than what is shown, else empty."""
    return F.when(F.length(text) > SHOWN_CHARS, F.sha2(text, 256)).otherwise("")


def _named(names: Sequence[str]) -> Column:
    """Column name of an unpivot slot ``c<i>``."""
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)])
    return table[F.col("slot")]


def profile_unique(df: DataFrame, columns: Sequence[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct values per column, NULL counted as one; ``rsd`` allows a sketch."""
    names = columns or numeric_columns(df) + string_columns(df)
    if rsd is not None:
        rows = _wide(df, names, lambda c: {
            "distinct": F.approx_count_distinct(q(c), rsd),
            "null": F.coalesce(F.max(q(c).isNull().cast("long")), F.lit(0)),
        })
        return rows.select("name", (F.col("distinct") + F.col("null")).alias("unique_count"))
    parts = [f.groupBy("name").agg(F.count(F.lit(1)).alias("unique_count")) for f in value_counts(df, names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_quartiles(df: DataFrame, columns: Sequence[str] | None = None, relative_error: float = RANK_ERROR) -> DataFrame:
    """Q1, median, Q3 and their spread; error 0 selects exact ranks."""
    names = columns or numeric_columns(df)
    found = quantiles(df, names, [0.25, 0.5, 0.75], relative_error)
    rows = [(c, *v, None if v[0] is None else v[2] - v[0]) for c, v in found.items()]
    return df.sparkSession.createDataFrame(rows, "name string, q1 double, median double, q3 double, iqr double")


def bin_edges(low: float | None, high: float | None) -> list[float] | None:
    """Eleven edges of ten equal bins; a constant column gets one bin."""
    if low is None:
        return None
    if low == high:
        return [low, high]
    width = (high - low) / BINS
    return [low + i * width for i in range(BINS + 1)]


def bin_index(x: Column, low: Column, width: Column) -> Column:
    """Position of the last edge ``low + i * width`` not above ``x``; the last bin is closed.

    The division gives a guess; comparing with the edges themselves corrects
    its rounding, so values on an edge land where the edge list says.
    """
    last = F.lit(BINS - 1)
    step = F.floor(F.coalesce(F.try_divide(x - low, width), F.lit(0.0))).cast("int")
    guess = F.least(last, F.greatest(F.lit(0), step))
    back = (x < low + guess * width) & (guess > 0)
    ahead = (x >= low + (guess + 1) * width) & (guess < last) & (width > 0)
    return F.when(x.isNotNull(), guess - back.cast("int") + ahead.cast("int"))


def _start_and_width(edges: list[float]) -> tuple[float, float]:
    low, high = edges[0], edges[-1]
    return low, (high - low) / BINS


def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ten equal-width bins per numeric column with their edges and counts."""
    names = columns or numeric_columns(df)
    stats = fit(df, {(c, k): f(as_double(df, c)) for c in names for k, f in (("min", F.min), ("max", F.max))})
    edges = {c: bin_edges(stats[(c, "min")], stats[(c, "max")]) for c in names}
    grid = df.sparkSession.createDataFrame(
        [(c, i, e[i], e[i + 1]) for c, e in edges.items() if e for i in range(len(e) - 1)],
        "name string, bin int, low double, high double",
    )
    counted = _bin_counts(df, edges)
    return grid.join(counted, ["name", "bin"], "left").select(
        "name", "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )


def _bin_counts(df: DataFrame, edges: dict[str, list[float] | None]) -> DataFrame:
    """Rows per column and bin, for columns that hold values."""
    filled = [c for c, e in edges.items() if e]
    if not filled:
        return df.sparkSession.createDataFrame([], "name string, bin int, n long")
    # the bin is worked out after unpivoting: one small expression that compiles
    # well, instead of one copy per column
    cells = [F.lit(len(filled))]
    for i, c in enumerate(filled):
        cells += [F.lit(f"c{i}"), as_double(df, c), *map(F.lit, _start_and_width(edges[c]))]
    long = df.select(F.stack(*cells).alias("slot", "x", "low", "width")).filter("x is not null")
    placed = long.select("slot", bin_index(F.col("x"), F.col("low"), F.col("width")).alias("bin"))
    return placed.groupBy("slot", "bin").agg(F.count(F.lit(1)).alias("n")).select(_named(filled).alias("name"), "bin", "n")


def _top(counts: DataFrame) -> DataFrame:
    """The ten commonest values per column; long ones end in an ellipsis."""
    order = [F.desc("count"), F.asc_nulls_first("value"), F.asc("digest")]
    rank = F.row_number().over(W.partitionBy("name").orderBy(*order))
    best = counts.withColumn("position", rank).filter(F.col("position") <= TOP)
    shown = F.when(F.col("digest") != "", F.concat("value", F.lit("..."))).otherwise(F.col("value"))
    return best.select("name", "position", shown.alias("value"), "count")


def profile_top_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The ten most frequent values per string column; ties go to the smaller value."""
    names = columns or string_columns(df)
    return _top(value_counts(df, names)[0])


def array_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shape of the first non-NULL value and whether every value shares it."""
    names = columns or array_columns(df)
    return _wide(df, names, lambda c: _shape_measures(df, c))


def _shape_measures(df: DataFrame, c: str) -> dict[str, Column]:
    shape = row_shape(q(c), depth(type_of(df, c)))
    return {"shape": F.first(shape, ignorenulls=True), "uniform": F.min(shape) == F.max(shape)}


def _length_measures(c: str) -> dict[str, Column]:
    n = F.when(q(c).isNotNull(), F.size(q(c)))
    return {"len_min": F.min(n), "len_max": F.max(n), "len_mean": F.avg(n), "len_std": F.stddev_samp(n)}


def array_length_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Outer lengths: minimum, maximum, mean, sample standard deviation."""
    return _wide(df, columns or array_columns(df), _length_measures)


def array_values(df: DataFrame, column: str, sample: float | None = None) -> DataFrame:
    """All innermost numbers of an array column as rows ``v``; a narrow step."""
    if not isinstance(leaf(type_of(df, column)), T.NumericType):
        raise ValueError(f"column {column!r} is not numeric")
    rows = df.select(F.explode(flat_values(df, column)).alias("v")).select(F.col("v").cast("double"))
    return rows if sample is None else rows.sample(sample)


VALUE_MEASURES = {
    "val_min": lambda v: F.min(v),
    "val_max": lambda v: F.max(v),
    "val_mean": lambda v: F.avg(v),
    "val_std": lambda v: F.stddev_pop(v),
    "val_sparsity": lambda v: F.avg((v == 0).cast("double")),
}


def array_value_stats(df: DataFrame, column: str, sample: float | None = None, exact: bool = True) -> DataFrame:
    """Extremes, mean, population deviation, median and share of zeros of the innermost values."""
    rows = array_values(df, column, sample)
    v = F.col("v")
    measures = [f(v).alias(n) for n, f in VALUE_MEASURES.items()]
    if exact:
        median = F.lit(exact_quantiles(rows, ["v"], [0.5], interpolate=True)["v"][0]).cast("double")
        return rows.agg(*measures).select(F.lit(column).alias("name"), *VALUE_MEASURES, median.alias("val_median"))
    median = F.percentile_approx(v, 0.5, 1_000).alias("val_median")
    return rows.agg(*measures, median).select(F.lit(column).alias("name"), *VALUE_MEASURES, "val_median")


def array_insights(df: DataFrame, column: str) -> DataFrame:
    """Flags shown with an array column: uniform shape, already in [0, 1], sparse, NULL percentage."""
    rows = array_values(df, column)
    v = F.col("v")
    values = fit(rows, {"low": F.min(v), "high": F.max(v), "sparsity": F.avg((v == 0).cast("double"))})
    n = F.when(q(column).isNotNull(), F.size(q(column)))
    outer = df.agg(
        F.count(F.lit(1)).alias("entries"), _nulls(df, column).alias("nulls"),
        F.min(n).alias("low"), F.max(n).alias("high"),
    )
    normalized = None if values["low"] is None else values["low"] >= 0 and values["high"] <= 1
    sparse = None if values["sparsity"] is None else values["sparsity"] > 0.1
    return outer.select(
        F.lit(column).alias("name"),
        F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("uniform_shape"),
        F.lit(normalized).cast("boolean").alias("normalized"),
        F.lit(sparse).cast("boolean").alias("sparse"),
        F.coalesce(F.round(F.try_divide(F.col("nulls") * 100.0, F.col("entries")), 1), F.lit(0.0)).alias("null_percentage"),
    )


def histogram_labels(histogram: DataFrame) -> DataFrame:
    """Display text of each edge: ``low-high`` with two decimals, ``edge+`` for the last one."""
    own = F.struct(F.col("bin").alias("edge"), F.format_string("%.2f-%.2f", "low", "high").alias("label"))
    closing = F.struct((F.col("bin") + 1).alias("edge"), F.format_string("%.2f+", "high").alias("label"))
    last = F.col("bin") == F.max("bin").over(W.partitionBy("name"))
    labels = F.when(last, F.array(own, closing)).otherwise(F.array(own))
    return histogram.withColumn("labels", labels).select("name", F.inline("labels"))


def profile(df: DataFrame, approximate_unique: bool = False, relative_error: float = RANK_ERROR) -> DataFrame:
    """The whole report; everything brought to the driver has a few values per column.

    One scan makes the state of ``profile_state``.  Distinct values, categories and bins are then counted exactly,
    or, with ``approximate_unique``, read from the state, whose one scan is then the only one.  ``relative_error`` is
    the rank error of the quartiles, kept by the state's sketch; 0 asks for exact ranks, which cost two more scans.
    """
    df = evenly(df)
    state = profile_state(df, distinct=approximate_unique, texts=approximate_unique)
    exact = relative_error == 0
    facts, values = report_rows(state, BINS, TOP, bracket_points(QUARTILES, RANK_BOUND) if exact else (), histogram=approximate_unique)
    arrays = {c: r for c, r in values.items() if r["x_n"]}
    numbers = {r["name"]: r for r in facts if r["x_n"]}
    tasks = {}
    if not approximate_unique:
        numeric = numeric_columns(df)
        edges = {c: numbers[c]["edges"] if c in numbers else None for c in numeric}
        tasks["bins"] = lambda: _bins_and_unique(df, numeric, edges)
        tasks["texts"] = lambda: _categories(df, string_columns(df))
    if exact and numbers:
        first = {c: (r["x_n"], r["points"][3:]) for c, r in numbers.items()}
        tasks["quartiles"] = lambda: exact_quantiles(df, list(numbers), QUARTILES, brackets=first)
    if exact and arrays:
        tasks["medians"] = lambda: _exact_medians(df, arrays)
    # these read the table independently of each other
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        done = {name: job.result() for name, job in {name: pool.submit(inheritable_thread_target(df.sparkSession)(task)) for name, task in tasks.items()}.items()}
    return report(df.sparkSession, facts, values, done)


def profile_of_state(state: DataFrame) -> DataFrame:
    """The report a stored or merged state gives, without a look at the data."""
    facts, values = report_rows(state, BINS, TOP)
    return report(state.sparkSession, facts, values, {})


def _exact_medians(df: DataFrame, arrays: dict[str, dict]) -> dict[str, list]:
    """Interpolated medians of all array columns' values, unpivoted together."""
    def marked(i: int):
        return lambda v: F.struct(F.lit(i).alias("slot"), v.cast("double").alias("x"))

    each = [F.transform(flat_values(df, c), marked(i)) for i, c in enumerate(arrays)]
    long = df.select(F.explode(F.concat(*[F.coalesce(e, F.array().cast("array<struct<slot: int, x: double>>")) for e in each])).alias("v"))
    wide = long.select(*[F.when(F.col("v.slot") == i, F.col("v.x")).alias(f"a{i}") for i in range(len(arrays))])
    found = exact_quantiles(wide, wide.columns, [0.5], interpolate=True)
    return {c: found[f"a{i}"] for i, c in enumerate(arrays)}


def report(spark: SparkSession, facts: list[dict], values: dict[str, dict], exact: dict) -> DataFrame:
    """Rows of the report from the facts of a state, with what was counted exactly in their place."""
    bins, unique = exact.get("bins", ({}, {}))
    top, unique_texts = exact.get("texts", ({}, {}))
    unique = unique | unique_texts
    rows = []
    for r in facts:
        c, n, kind = r["name"], r["x_n"], T._parse_datatype_string(r["type"])
        row: dict = dict.fromkeys(PROFILE_FIELDS)
        row.update(name=c, type=r["type"], entries=r["entries"], null_count=r["null_count"])
        number, text = isinstance(kind, T.NumericType), isinstance(kind, T.StringType)
        if number or text:
            row["unique_count"] = r["_distinct"] + (r["null_count"] > 0) + (r["nans"] > 0 and not number) if "_distinct" in r else unique.get(c, 0)
        if number:
            if r["nans"]:  # arithmetic with NaN is NaN, and NaN is the greatest number
                row.update(mean=math.nan, stddev=math.nan, min=r["x_min"] if n else math.nan, max=math.nan)
            else:
                row.update(mean=r["x_mean"], stddev=deviation(r["x_m2"], n), min=r["x_min"], max=r["x_max"])
            if n:
                q1, median, q3 = exact["quartiles"][c] if "quartiles" in exact else r["points"][:3]
                counts = [bins.get((c, i), 0) for i in range(len(r["edges"]) - 1)] if "bins" in exact else r["histogram"]
                row.update(q1=q1, median=median, q3=q3, iqr=q3 - q1, hist_bins=r["edges"], hist_counts=counts)
        if text:
            row["top_categories"] = [Row(**x) for x in r["categories"] or []] if "categories" in r else top.get(c, [])
        if isinstance(kind, T.ArrayType):
            row.update(shape=r["shape"], len_mean=r["length_mean"], len_std=deviation(r["length_m2"], r["length_n"]))
            row.update({f"len_{m}": None if r[f"length_{m}"] is None else int(r[f"length_{m}"]) for m in ("min", "max")})
        inner = values.get(c)
        if inner and inner["nans"]:
            row.update(val_min=inner["x_min"] if inner["x_n"] else math.nan, val_max=math.nan, val_mean=math.nan, val_std=math.nan)
        elif inner and inner["x_n"]:
            row.update(val_min=inner["x_min"], val_max=inner["x_max"], val_mean=inner["x_mean"], val_std=deviation(inner["x_m2"], inner["x_n"], sample=False))
        if inner and inner["x_n"]:
            row["val_median"] = exact["medians"][c][0] if "medians" in exact else inner["points"][1]
        if inner and inner["x_n"] + inner["nans"]:
            row["val_sparsity"] = inner["zeros"] / (inner["x_n"] + inner["nans"])
        rows.append(Row(**row))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def _bins_and_unique(df: DataFrame, numeric: list[str], edges: dict) -> tuple[dict, dict]:
    """Histogram counts and distinct counts of all numbers; one shuffle of value counts serves both."""
    bins: dict = {}
    unique: dict = {}
    starts = [(c, *(_start_and_width(edges[c]) if edges[c] else (None, None))) for c in numeric]
    if not starts:
        return bins, unique
    table = df.sparkSession.createDataFrame(starts, "name string, low double, width double")
    for frame in value_counts(df, numeric):
        frame = frame.join(F.broadcast(table), "name")  # one row per column
        x = F.col("value").cast("double")
        place = F.when(~F.isnan(x) & F.col("low").isNotNull(), bin_index(x, F.col("low"), F.col("width")))
        folded = frame.groupBy("name", place.alias("bin")).agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("values"))
        for r in folded.collect():
            unique[r["name"]] = unique.get(r["name"], 0) + r["values"]
            if r["bin"] is not None:
                bins[(r["name"], r["bin"])] = r["rows"]
    return bins, unique


def _categories(df: DataFrame, strings: list[str]) -> tuple[dict, dict]:
    """Top categories and distinct counts; both read the same exchange of value counts."""
    top: dict = {}
    unique: dict = {}
    if not strings:
        return top, unique
    counts = value_counts(df, strings)[0]
    best = _top(counts)
    totals = counts.groupBy("name").agg(F.count(F.lit(1)).alias("values"), F.sum("count").alias("rows"))
    totals = totals.select("name", F.lit(0).alias("position"), F.col("rows").cast("string").alias("value"), F.col("values").alias("count"))
    for r in best.unionByName(totals).orderBy("name", "position").collect():
        if r["position"] == 0:
            unique[r["name"]] = r["count"]
        else:
            top.setdefault(r["name"], []).append(Row(value=r["value"], count=r["count"]))
    return top, unique
