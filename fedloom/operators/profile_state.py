"""The profile as a stored, mergeable state: one scan makes it, and states of parts add up to the state of the whole.

A state has one row per column, and one more for the innermost values of a numeric array column: counts, moments,
extremes, and three sketches (quantiles, distinct values, frequent texts) whose size does not depend on the data.  All
columns travel through one aggregation: every row becomes one cell per column, arrays give one per value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .columns import array_columns, numeric_columns, q, string_columns, type_of

#: Size of the quantile sketch; ranks are off by about 0.0013 of the rows at most.
QUANTILE_SIZE = 4_000
RANK_BOUND = 0.0015
#: Distinct values: two to this many registers, about 0.6 % off.
DISTINCT_BITS = 15
#: Texts that are tracked; those beyond share the error of the least frequent one.
TRACKED = 1_000
SHOWN_CHARS = 50
_LONG = "\x1f"
SKETCHES = ("quantiles", "distinct", "texts")
#: A cell's fields beyond slot, missing and x; those that no column needs are left out of the cells.
EXTRAS = {"key": "bigint", "text": "string", "length": "int", "shape": "array<int>"}
MOMENTS = ("x", "length")


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def leaf(kind: T.DataType) -> T.DataType:
    return leaf(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def row_shape(x: Column, levels: int) -> Column:
    """Nested lengths along the first elements, cut at the first empty or missing level."""
    sizes, level = [], x
    for _ in range(levels):
        sizes.append(F.when(level.isNotNull(), F.size(level)))
        level = F.try_element_at(level, F.lit(1))
    return F.when(x.isNotNull(), F.array_compact(F.array(*sizes)))


def flat_values(df: DataFrame, column: str) -> Column:
    """All innermost values of an array column as one array."""
    flat = q(column)
    for _ in range(depth(type_of(df, column)) - 1):
        flat = F.flatten(flat)
    return flat


def class_of(kind: T.DataType) -> str:
    """Values of one class compare as equal across its types, so their distinct sketches can be merged."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "string"


def shown_text(x: Column) -> Column:
    """A text as it is tracked: long ones by their shown beginning and the SHA-256 of the whole."""
    return F.when(F.length(x) > SHOWN_CHARS, F.concat(F.substring(x, 1, SHOWN_CHARS), F.lit(_LONG), F.sha2(x, 256))).otherwise(x)


def parts_of(df: DataFrame) -> list[tuple[int, str, str, str]]:
    """(slot, name, type, part) of every state row of a table."""
    rows = [(i, c, type_of(df, c).simpleString(), "column") for i, c in enumerate(df.columns)]
    inner = [c for c in array_columns(df) if isinstance(leaf(type_of(df, c)), T.NumericType)]
    return rows + [(len(rows) + i, c, type_of(df, c).simpleString(), "values") for i, c in enumerate(inner)]


def _extras(df: DataFrame, distinct: bool, texts: bool) -> dict[str, str]:
    wanted = {"key": distinct, "text": texts and bool(string_columns(df)), "length": bool(array_columns(df)), "shape": bool(array_columns(df))}
    return {n: k for n, k in EXTRAS.items() if wanted[n]}


def _cell(extras: dict[str, str], slot: int, missing: Column, x: Column | None = None, **more: Column | None) -> Column:
    cells = {n: more.get(n) for n in extras}
    return F.struct(
        F.lit(slot).alias("slot"), missing.alias("missing"), F.lit(None).cast("double").alias("x") if x is None else x.cast("double").alias("x"),
        *[(F.lit(None) if e is None else e).cast(extras[n]).alias(n) for n, e in cells.items()],
    )


def _value_cell(extras: dict[str, str], slot: int):
    return lambda v: _cell(extras, slot, v.isNull(), v)


def _cells(df: DataFrame, distinct: bool, extras: dict[str, str]) -> Column:
    numbers, strings, arrays = set(numeric_columns(df)), set(string_columns(df)), set(array_columns(df))
    cells, lists = [], []
    for slot, c, _, part in parts_of(df):
        if part == "values":
            lists.append(F.coalesce(F.transform(flat_values(df, c), _value_cell(extras, slot)), F.array()))
            continue
        kind = type_of(df, c)
        cells.append(_cell(
            extras, slot, q(c).isNull(), q(c) if c in numbers else None,
            key=F.when(q(c).isNotNull(), F.xxhash64(q(c).cast(class_of(kind)))) if distinct and c in numbers | strings else None,
            text=shown_text(q(c)) if c in strings else None,
            length=F.when(q(c).isNotNull(), F.size(q(c))) if c in arrays else None, shape=row_shape(q(c), depth(kind)) if c in arrays else None,
        ))
    return F.concat(F.array(*cells), *lists) if lists else F.array(*cells)


def profile_state(df: DataFrame, distinct: bool = True, texts: bool = True) -> DataFrame:
    """State of a table, from one scan; ``distinct`` and ``texts`` can be left out where exact counts follow anyway."""
    extras = _extras(df, distinct, texts)
    cell = df.select(F.explode(_cells(df, distinct, extras)).alias("c")).select("c.*")
    nan = F.col("x").isNotNull() & F.isnan("x")
    clean = cell.select("slot", "missing", F.when(~nan, F.col("x")).alias("x"), nan.alias("nan"), *extras)
    measures = [F.count(F.lit(1)).alias("entries"), F.count_if("missing").alias("null_count"), F.count_if("nan").alias("nans"), F.count_if(F.col("x") == 0).alias("zeros")]
    if "shape" in extras:
        measures.append(F.any_value("shape", F.lit(True)).alias("shape"))
    moments = [m for m in MOMENTS if m == "x" or m in extras]
    for m in moments:
        measures += [F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"), (F.var_pop(m) * F.count(m)).alias(f"{m}_m2"), F.min(m).cast("double").alias(f"{m}_min"), F.max(m).cast("double").alias(f"{m}_max")]
    measures.append(F.kll_sketch_agg_double("x", QUANTILE_SIZE).alias("quantiles"))
    if distinct:
        measures.append(F.hll_sketch_agg("key", DISTINCT_BITS).alias("distinct"))
    if texts:
        text = "text" if "text" in extras else "CAST(NULL AS STRING)"
        measures.append(F.expr(f"approx_top_k_accumulate({text}, {TRACKED})").alias("texts"))
    found = clean.groupBy("slot").agg(*measures)
    for n in [] if "shape" in extras else ["shape", "length_n", *[f"length_{k}" for k in ("mean", "m2", "min", "max")]]:
        found = found.withColumn(n, F.lit(None).cast({"shape": "array<int>", "length_n": "bigint"}.get(n, "double")))
    names = df.sparkSession.createDataFrame(parts_of(df), "slot int, name string, type string, part string")
    state = names.join(found, "slot", "left")
    counts = ["entries", "null_count", "nans", "zeros", *[f"{m}_n" for m in MOMENTS]]
    return state.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def _gap(mean: Column):
    """Squared gaps of a part's values to the mean of the whole."""
    return lambda s: s["m2"] + s["n"] * (s["mean"] - mean) * (s["mean"] - mean)


def _pooled(states: DataFrame) -> DataFrame:
    """State rows of one column added up."""
    rows = states.groupBy("name", "part")
    measures = [F.sum(c).alias(c) for c in ("entries", "null_count", "nans", "zeros")]
    measures += [F.min_by("shape", F.when(F.col("shape").isNotNull(), F.col("_at"))).alias("shape"), F.min("slot").alias("slot"), F.min_by("type", "_at").alias("type")]
    for m in MOMENTS:
        measures += [
            F.sum(f"{m}_n").alias(f"{m}_n"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"),
            F.collect_list(F.when(F.col(f"{m}_n") > 0, F.struct(F.col(f"{m}_n").cast("double").alias("n"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_m2").alias("m2")))).alias(f"_{m}"),
        ]
    merged = {"quantiles": F.kll_merge_agg_double("quantiles"), "distinct": F.hll_union_agg("distinct", True), "texts": F.expr(f"approx_top_k_combine(texts, {TRACKED})")}
    out = rows.agg(*measures, *[e.alias(n) for n, e in merged.items() if n in states.columns])
    for m in MOMENTS:
        n, mean = F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_n").cast("double")), F.col(f"{m}_mean")
        out = out.withColumn(f"{m}_mean", F.aggregate(f"_{m}", F.lit(0.0), lambda a, s: a + s["n"] * s["mean"]) / n)
        gaps = F.transform(f"_{m}", _gap(mean))
        out = out.withColumn(f"{m}_m2", F.when(n.isNotNull(), F.aggregate(gaps, F.lit(0.0), lambda a, s: a + s)))
    return out.drop(*[f"_{m}" for m in MOMENTS])


def merge_states(*states: DataFrame) -> DataFrame:
    """State of the union by name of the tables the states belong to; a column that a table lacks is NULL in all its rows there.

    The first state that has a column gives its place and type.  States are small, a row per column, and so is what
    comes to the driver: each table's number of rows.
    """
    totals = [s.agg(F.max(F.when(F.col("part") == "column", F.col("entries")))).first()[0] or 0 for s in states]
    base = 0
    numbered = []
    for i, s in enumerate(states):
        numbered.append(s.withColumns({"_at": F.lit(i), "slot": F.col("slot") + base, "_rows": F.lit(totals[i])}))
        base += 1 << 20
    every = numbered[0]
    for s in numbered[1:]:
        every = every.unionByName(s)
    # the sketches of a column without numbers or texts are empty, not missing
    full = every.where(F.col("quantiles").isNotNull())
    empty = every.where(F.col("quantiles").isNull()).groupBy("name", "part").agg(F.min("slot").alias("slot"), F.min_by("type", "_at").alias("type"))
    pooled = _pooled(full)
    rest = empty.join(pooled, ["name", "part"], "left_anti")
    out = pooled.unionByName(rest, allowMissingColumns=True)
    counts = ["entries", "null_count", "nans", "zeros", *[f"{m}_n" for m in MOMENTS]]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    lacking = F.when(F.col("part") == "column", F.lit(sum(totals)) - F.col("entries")).otherwise(0)
    return out.withColumns({"null_count": F.col("null_count") + lacking, "entries": F.col("entries") + lacking}).select(states[0].columns)


def _under(edge: float) -> float:
    """The greatest double below an edge: its rank counts what lies before the edge."""
    return math.nextafter(edge, -math.inf)


def report_rows(state: DataFrame, bins: int, top: int, brackets: Sequence[float] = (), histogram: bool = True) -> tuple[list[dict], dict]:
    """Facts of each column on the driver, a few values per column, and the facts of array values by name.

    ``histogram`` and categories come from the sketches; ``brackets`` are further ranks whose values are wanted.
    """
    state = materialize(state)
    ranges = {(r["name"], r["part"]): (r["x_min"], r["x_max"]) for r in state.select("name", "part", "x_min", "x_max").where("x_n > 0").collect()}
    edges = {}
    for key, (low, high) in ranges.items():
        width = (high - low) / bins
        edges[key] = [low, high] if low == high else [low + i * width for i in range(bins + 1)]
    some = F.col("x_n") > 0
    ranks = F.lit(None).cast("array<double>")
    if histogram:  # the function takes constants only
        for (name, part), e in edges.items():
            if len(e) > 2:
                cuts = F.array(*[F.lit(_under(v)) for v in e[1:-1]])
                ranks = F.when((F.col("name") == name) & (F.col("part") == part), F.kll_sketch_get_rank_double("quantiles", cuts)).otherwise(ranks)
    points = F.array(*[F.lit(float(p)) for p in (0.25, 0.5, 0.75, *brackets)])
    found = [F.when(some, F.kll_sketch_get_quantile_double("quantiles", points)).alias("_points"), ranks.alias("_ranks")]
    if "distinct" in state.columns:
        found.append(F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("_distinct"))
    if "texts" in state.columns:
        found.append(F.when(F.col("texts").isNotNull(), F.expr(f"approx_top_k_estimate(texts, {TRACKED})")).alias("_texts"))
    plain = [c for c in state.columns if c not in SKETCHES]
    columns, values = [], {}
    for row in state.select(*plain, *found).orderBy("slot").collect():
        r = row.asDict(recursive=True)
        n = r["x_n"]
        r["edges"] = edges.get((r["name"], r["part"]))
        at = [round(n * share) for share in r["_ranks"] or []]
        r["histogram"] = [b - a for a, b in zip([0, *at], [*at, n], strict=True)] if r["edges"] else None
        r["points"] = r["_points"]
        if r.get("_texts") is not None:
            # NULLs are counted exactly, also those of a table that lacks the column
            seen = [(x["count"], x["item"]) for x in r["_texts"] if x["item"] is not None]
            shown = sorted(seen + [(r["null_count"], None)] * (r["null_count"] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or ""))[:top]
            r["categories"] = [{"value": v.split(_LONG)[0] + "..." if v and _LONG in v else v, "count": c} for c, v in shown]
        if r["part"] == "values":
            values[r["name"]] = r
        else:
            columns.append(r)
    return columns, values


def deviation(m2: float | None, n: int, sample: bool = True) -> float | None:
    """Standard deviation from a sum of squared gaps; NULL without values, and for the sample form with one."""
    if m2 is None or n < 1 + sample:
        return None
    return math.sqrt(max(0.0, m2) / (n - sample))
