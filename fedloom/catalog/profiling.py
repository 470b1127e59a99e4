"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import reshape
from ..operators import profile as P
from . import inputs
from .inputs import table
from .registry import query, rounded, with_

GAPS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "late": "boolean",
    "l_shipdate": "timestamp_ntz",
}
NUMERIC = [c for c, t in GAPS.items() if t in ("bigint", "int", "double")]
STRINGS = [c for c, t in GAPS.items() if t == "string"]


def _each(columns, body: str) -> str:
    return with_("gaps", "SELECT * FROM (" + " UNION ALL ".join(body.replace("{c}", c).replace("{t}", GAPS[c]) for c in columns) + ")")


@query("profile_counts", _each(GAPS, f"SELECT '{{c}}' AS name, '{{t}}' AS type, count(*) AS entries, count(*) - count({{c}}) AS null_count, {len(GAPS)} AS num_columns FROM gaps"))
def profile_counts(spark, d):
    return P.profile_counts(inputs.gaps(spark, d))


@query("profile_numeric", _each(NUMERIC, """SELECT '{c}' AS name, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS stddev,
    min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM gaps"""))
def profile_numeric(spark, d):
    return rounded(P.profile_numeric(inputs.gaps(spark, d)), 5)


@query("profile_unique", _each(NUMERIC + STRINGS, "SELECT '{c}' AS name, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique_count FROM gaps"))
def profile_unique(spark, d):
    return P.profile_unique(inputs.gaps(spark, d))


@query("profile_quartiles", _each(NUMERIC, """SELECT '{c}' AS name, quantile_disc({c}, 0.25)::DOUBLE AS q1, quantile_disc({c}, 0.5)::DOUBLE AS median,
    quantile_disc({c}, 0.75)::DOUBLE AS q3, round(quantile_disc({c}, 0.75)::DOUBLE - quantile_disc({c}, 0.25)::DOUBLE, 6) AS iqr FROM gaps"""))
def profile_quartiles(spark, d):
    return P.profile_quartiles(inputs.gaps(spark, d), relative_error=0).withColumn("iqr", F.round("iqr", 6))


HISTOGRAM = """SELECT '{c}' AS name, b::INTEGER AS bin, low + b * w AS low, low + (b + 1) * w AS high, (SELECT count(*) FROM gaps
    WHERE {c}::DOUBLE >= low + b * w AND ({c}::DOUBLE < low + (b + 1) * w OR b = 9)) AS count
    FROM (SELECT min({c})::DOUBLE AS low, (max({c})::DOUBLE - min({c})::DOUBLE) / 10 AS w FROM gaps), unnest(range(0, 10)) r(b)"""


@query("profile_histogram", _each(NUMERIC, HISTOGRAM.replace("low + b * w AS low, low + (b + 1) * w AS high", "round(low + b * w, 6) AS low, round(low + (b + 1) * w, 6) AS high")))
def profile_histogram(spark, d):
    return rounded(P.profile_histogram(inputs.gaps(spark, d), NUMERIC))


@query("profile_top_categories", with_("gaps", "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS name,
    row_number() OVER (ORDER BY count(*) DESC, {c} NULLS FIRST)::INTEGER AS position,
    CASE WHEN length({c}) > 50 THEN {c}[1:50] || '...' ELSE {c} END AS value, count(*) AS count FROM {t} GROUP BY {c}) WHERE position <= 10"""
    for c, t in (("l_returnflag", "gaps"), ("l_linestatus", "gaps"), ("text", "documents"), ("lang", "documents"), ("source", "documents"))) + ")"))
def profile_top_categories(spark, d):
    """Line items and documents, whose texts are longer than what is shown."""
    flags = P.profile_top_categories(inputs.gaps(spark, d))
    return flags.unionByName(P.profile_top_categories(table(spark, d, "documents")))


def _grids(spark, d):
    """A flat and a nested array column with some NULLs."""
    flat = F.when(F.col("vec_id") % 10 != 3, F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", flat.alias("flat"), reshape(flat, [8, 8]).alias("grid"))


GRIDS = "SELECT vec_id, CASE WHEN vec_id % 10 <> 3 THEN embedding END AS flat FROM embeddings"


@query("array_shape", f"""WITH g AS ({GRIDS}) SELECT 'flat' AS name, min(len(flat))::VARCHAR AS shape, min(len(flat)) = max(len(flat)) AS uniform FROM g
    UNION ALL SELECT 'grid', (min(len(flat)) // 8)::VARCHAR || 'x8', min(len(flat)) = max(len(flat)) FROM g""")
def array_shape(spark, d):
    return P.array_shape(_grids(spark, d)).select("name", F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), "uniform")


@query("array_length_stats", f"""WITH g AS ({GRIDS}) SELECT 'flat' AS name, min(len(flat))::INTEGER AS len_min, max(len(flat))::INTEGER AS len_max,
    avg(len(flat)) AS len_mean, stddev_samp(len(flat)) AS len_std FROM g
    UNION ALL SELECT 'words', min(n)::INTEGER, max(n)::INTEGER, round(avg(n), 6), round(stddev_samp(n), 6) FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)""")
def array_length_stats(spark, d):
    words = table(spark, d, "documents").select(F.split("text", " ").alias("words"))
    return rounded(P.array_length_stats(_grids(spark, d).select("flat")).unionByName(P.array_length_stats(words)))


@query("array_value_stats", f"""WITH v AS (SELECT unnest(flat)::DOUBLE AS v FROM ({GRIDS})) SELECT 'grid' AS name, round(min(v), 6) AS val_min, round(max(v), 6) AS val_max,
    round(avg(v), 6) AS val_mean, round(stddev_pop(v), 6) AS val_std, avg((v = 0)::INT) AS val_sparsity, round(quantile_cont(v, 0.5), 6) AS val_median FROM v""")
def array_value_stats(spark, d):
    return rounded(P.array_value_stats(_grids(spark, d), "grid"))


@query("array_insights", f"""WITH g AS ({GRIDS}), v AS (SELECT unnest(flat)::DOUBLE AS v FROM g) SELECT 'flat' AS name, (SELECT min(len(flat)) = max(len(flat)) FROM g) AS uniform_shape,
    (SELECT min(v) >= 0 AND max(v) <= 1 FROM v) AS normalized, (SELECT avg((v = 0)::INT) > 0.1 FROM v) AS sparse,
    (SELECT round((count(*) - count(flat)) * 100.0::DOUBLE / count(*), 1) FROM g) AS null_percentage""")
def array_insights(spark, d):
    return P.array_insights(_grids(spark, d), "flat")


_LENGTHS = ("len_min", "len_max", "len_mean", "len_std")
_VALUES = ("val_min", "val_max", "val_mean", "val_std", "val_median", "val_sparsity")
_NOTHING = ", ".join(f"NULL::DOUBLE AS {n}" for n in (*_LENGTHS, *_VALUES))


def _report_sql(c: str, kind: str, source: str) -> str:
    """One row of the report; bins as their first, last and sum."""
    if kind in ("bigint", "int", "double"):
        counts = f"(SELECT string_agg(count::VARCHAR, ',' ORDER BY bin) FROM ({HISTOGRAM}))".replace("FROM gaps", f"FROM {source}")
        return f"""SELECT '{c}' AS name, '{kind}' AS type, count(*) AS entries, count(*) - count({c}) AS null_count,
            count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique_count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS stddev,
            min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_disc({c}, 0.25)::DOUBLE AS q1, quantile_disc({c}, 0.5)::DOUBLE AS median,
            quantile_disc({c}, 0.75)::DOUBLE AS q3, round(quantile_disc({c}, 0.75)::DOUBLE - quantile_disc({c}, 0.25)::DOUBLE, 5) AS iqr,
            min({c})::DOUBLE AS first_bin, max({c})::DOUBLE AS last_bin, round(11 * (min({c})::DOUBLE + max({c})::DOUBLE) / 2, 3) AS sum_of_bins,
            {counts} AS hist_counts, '' AS top, '' AS shape, {_NOTHING} FROM {source}""".replace("{c}", c)
    top = f"(SELECT string_agg(coalesce(v, 'NULL') || ':' || n, ',' ORDER BY n DESC, v NULLS FIRST) FROM (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY 1))"
    unique, top = (f"count(DISTINCT {c}) + max(({c} IS NULL)::INT)", top) if kind == "string" else ("-1", "''")
    common = f"SELECT '{c}', '{kind}', count(*), count(*) - count({c}), {unique}, {', '.join(['NULL'] * 11)}, '', {top}"
    if not kind.startswith("array"):
        return f"{common}, '', {_NOTHING} FROM {source}"
    # both arrays hold the same values, the grid in rows of eight
    shape, share = ("len(any_value(flat))::VARCHAR", "") if c == "flat" else ("(len(any_value(flat)) // 8)::VARCHAR || 'x8'", " // 8")
    n, v = f"len(flat){share}", f"(SELECT {{}} FROM (SELECT unnest(flat)::DOUBLE AS v FROM {source}))"
    lengths = f"min({n}), max({n}), avg({n}), stddev_samp({n})"
    values = [v.format(e) for e in ("round(min(v), 5)", "round(max(v), 5)", "round(avg(v), 5)", "round(stddev_pop(v), 5)", "round(quantile_cont(v, 0.5), 5)", "avg((v = 0)::INT)")]
    return f"{common}, {shape}, {lengths}, {', '.join(values)} FROM {source}".replace(f"count({c})", "count(flat)")


_REPORTS = [_report_sql(c, t, "gaps") for c, t in GAPS.items()]
_REPORTS += [_report_sql(c, t, "grids") for c, t in (("vec_id", "bigint"), ("flat", "array<float>"), ("grid", "array<array<double>>"))]


@query("profile", with_("gaps", " UNION ALL ".join(_REPORTS), grids=GRIDS))
def profile(spark, d):
    """The whole report at rank error 0, of a plain table and of one with arrays; lists are written out as text."""
    report = P.profile(inputs.gaps(spark, d), relative_error=0).unionByName(P.profile(_grids(spark, d), relative_error=0))
    top = F.transform("top_categories", lambda x: F.concat_ws(":", F.coalesce(x["value"], F.lit("NULL")), x["count"].cast("string")))
    bins = F.col("hist_bins")
    return rounded(report.select(
        "name", "type", "entries", "null_count", F.coalesce("unique_count", F.lit(-1)).alias("unique_count"), "mean", "stddev", "min", "max",
        "q1", "median", "q3", "iqr", bins[0].alias("first_bin"), F.element_at(bins, -1).alias("last_bin"),
        F.round(F.aggregate(bins, F.lit(0.0), lambda a, x: a + x), 3).alias("sum_of_bins"),
        F.concat_ws(",", F.col("hist_counts").cast("array<string>")).alias("hist_counts"), F.concat_ws(",", top).alias("top"),
        F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), *[F.col(n).cast("double") for n in (*_LENGTHS, *_VALUES)],
    ), 5)


LABELLED = NUMERIC


@query("histogram_labels", with_("gaps", "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS name, e::INTEGER AS edge,
    CASE WHEN e < 10 THEN printf('%.2f-%.2f', low + e * w, low + (e + 1) * w) ELSE printf('%.2f+', low + e * w) END AS label
    FROM (SELECT min({c}) AS low, (max({c}) - min({c})) / 10 AS w FROM gaps), unnest(range(0, 11)) r(e)""" for c in LABELLED) + ")"))
def histogram_labels(spark, d):
    return P.histogram_labels(P.profile_histogram(inputs.gaps(spark, d), LABELLED))
