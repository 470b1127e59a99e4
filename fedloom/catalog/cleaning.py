"""Projections, filters, fills, duplicates, scaling, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import parse_vector, reshape_or_keep
from ..operators import clean, encode, fill, rounds, scale
from . import inputs
from .inputs import table
from .registry import query, rounded, stamp, with_

LINEITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
#: The same with the time as text, which both engines write alike.
SHOWN = LINEITEM.replace("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate")
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_NUMBERS = ["l_linenumber", *FEATURES, "fixed"]


def lineitem(spark, d):
    return table(spark, d, "lineitem").select(*LINEITEM.split(", "))


def shown(df):
    return df.withColumn("l_shipdate", stamp("l_shipdate"))


# --- selection and filters ---------------------------------------------------

@query("drop_column", f"SELECT {SHOWN.replace(', l_tax', '')} FROM lineitem")
def drop_column(spark, d):
    return shown(clean.drop_column(lineitem(spark, d), "l_tax"))


@query("drop_null_all", with_("gaps", f"""SELECT {SHOWN}, late FROM gaps WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL AND l_returnflag IS NOT NULL
    AND late IS NOT NULL AND l_shipdate IS NOT NULL"""))
def drop_null_all(spark, d):
    return shown(clean.drop_null(inputs.gaps(spark, d)))


@query("drop_null_column", with_("gaps", f"SELECT {SHOWN}, late FROM gaps WHERE l_quantity IS NOT NULL"))
def drop_null_column(spark, d):
    return shown(clean.drop_null(inputs.gaps(spark, d), ["l_quantity"]))


def _fences(columns: list[str], source: str) -> str:
    bounds = ", ".join(f"quantile_disc({c}, 0.25) AS {c}_a, quantile_disc({c}, 0.75) AS {c}_b" for c in columns)
    return f"SELECT {bounds} FROM {source}"


def _inside(columns: list[str], factor: float) -> str:
    return " AND ".join(f"{c} BETWEEN {c}_a - {factor} * ({c}_b - {c}_a) AND {c}_b + {factor} * ({c}_b - {c}_a)" for c in columns)


SKEWED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    l_extendedprice * l_discount * l_tax * l_quantity AS cost, l_extendedprice * l_extendedprice * l_discount AS squares FROM lineitem"""


def _skewed(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice * l_discount * l_tax * l_quantity AS cost", "l_extendedprice * l_extendedprice * l_discount AS squares",
    )


SKEWED_NUMBERS = ["l_orderkey", "l_linenumber", "l_quantity", "cost", "squares"]


@query("remove_outliers_all", f"""WITH s AS ({SKEWED}), f AS ({_fences(SKEWED_NUMBERS, 's')})
    SELECT s.* FROM s, f WHERE {_inside(SKEWED_NUMBERS, 1.5)}""")
def remove_outliers_all(spark, d):
    return clean.remove_outliers(_skewed(spark, d), relative_error=0)


@query("remove_outliers_column", f"""WITH s AS ({SKEWED}), f AS ({_fences(['cost'], 's')})
    SELECT l_orderkey, l_linenumber, cost FROM s, f WHERE {_inside(['cost'], 1.0)}""")
def remove_outliers_column(spark, d):
    kept = clean.remove_outliers(_skewed(spark, d), ["cost"], factor=1.0, relative_error=0)
    return kept.select("l_orderkey", "l_linenumber", "cost")


# --- fills -------------------------------------------------------------------

@query("fill_defaults_all", with_("gaps", """SELECT l_orderkey, l_partkey, l_suppkey, coalesce(l_linenumber, 0) AS l_linenumber, coalesce(l_quantity, 0) AS l_quantity,
    l_extendedprice, l_discount, l_tax, coalesce(l_returnflag, 'unknown') AS l_returnflag, l_linestatus, coalesce(late, false) AS late,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM gaps"""))
def fill_defaults_all(spark, d):
    return shown(fill.fill_defaults(inputs.gaps(spark, d)))


@query("fill_zero", with_("gaps", "SELECT l_orderkey, coalesce(l_linenumber, 0) AS l_linenumber, l_quantity FROM gaps"))
def fill_zero(spark, d):
    return fill.fill_value(inputs.gaps(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), 0, ["l_linenumber"])


@query("fill_unknown", with_("gaps", "SELECT l_orderkey, coalesce(l_returnflag, 'Unknown') AS l_returnflag FROM gaps"))
def fill_unknown(spark, d):
    return fill.fill_value(inputs.gaps(spark, d).select("l_orderkey", "l_returnflag"), "Unknown", ["l_returnflag"])


@query("fill_false", with_("gaps", "SELECT l_orderkey, coalesce(late, false) AS late FROM gaps"))
def fill_false(spark, d):
    return fill.fill_value(inputs.gaps(spark, d).select("l_orderkey", "late"), False, ["late"])


def _filled(spark, d):
    return inputs.gaps(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _fill_sql(integer: str, real: str) -> str:
    return with_("gaps", f"""SELECT l_orderkey, coalesce(l_linenumber, (SELECT {integer} FROM gaps)) AS l_linenumber,
        round(coalesce(l_quantity, (SELECT {real} FROM gaps)), 6) AS l_quantity, l_extendedprice FROM gaps""")


@query("fill_mean_all", _fill_sql("trunc(avg(l_linenumber))::INTEGER", "avg(l_quantity)"))
def fill_mean_all(spark, d):
    return rounded(fill.impute(_filled(spark, d), strategy="mean"))


@query("fill_median_all", _fill_sql("quantile_disc(l_linenumber, 0.5)", "quantile_disc(l_quantity, 0.5)"))
def fill_median_all(spark, d):
    return rounded(fill.impute(_filled(spark, d), strategy="median", relative_error=0))


@query("fill_mean_column", with_("gaps", "SELECT l_orderkey, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM gaps)), 6) AS l_quantity FROM gaps"))
def fill_mean_column(spark, d):
    return rounded(fill.impute(inputs.gaps(spark, d).select("l_orderkey", "l_quantity"), ["l_quantity"], "mean"))


@query("fill_median_column", with_("gaps", "SELECT l_orderkey, coalesce(l_linenumber, (SELECT quantile_disc(l_linenumber, 0.5) FROM gaps)) AS l_linenumber FROM gaps"))
def fill_median_column(spark, d):
    return fill.impute(inputs.gaps(spark, d).select("l_orderkey", "l_linenumber"), ["l_linenumber"], "median", 0)


@query("fill_mode_column", with_("gaps", """SELECT l_orderkey, coalesce(l_quantity, (SELECT l_quantity FROM gaps WHERE l_quantity IS NOT NULL
    GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1)) AS l_quantity FROM gaps"""))
def fill_mode_column(spark, d):
    return fill.impute(inputs.gaps(spark, d).select("l_orderkey", "l_quantity"), ["l_quantity"], "mode")


# --- duplicates ----------------------------------------------------------------

@query("drop_duplicates_all", f"SELECT DISTINCT {SHOWN} FROM lineitem")
def drop_duplicates_all(spark, d):
    rows = lineitem(spark, d)
    return shown(clean.drop_duplicates(rows.unionByName(rows.filter("l_linenumber = 1"))))


@query("drop_duplicates_column", f"""SELECT {SHOWN} FROM lineitem QUALIFY row_number() OVER
    (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1""")
def drop_duplicates_column(spark, d):
    order = [F.asc(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")]
    return shown(clean.drop_duplicates_by(lineitem(spark, d), ["l_partkey"], order))


@query("first_submission_wins", with_("submissions", "first_subs", "SELECT session_id, user_id, round_number, part, price FROM first_subs"))
def first_submission_wins(spark, d):
    first = rounds.first_submission_wins(inputs.submissions(spark, d), inputs.submission_order())
    return first.select("session_id", "user_id", "round_number", "part", "price")


# --- scaling ---------------------------------------------------------------------

def _scale_sql(expression: str) -> str:
    return with_("gaps", f"SELECT l_orderkey, round({expression}, 9) + 0.0 AS l_quantity, l_extendedprice FROM gaps")


def _scale_query(key: str, method: str, expression: str) -> None:
    @query(key, _scale_sql(expression))
    def run(spark, d):
        rows = inputs.gaps(spark, d).select("l_orderkey", "l_quantity", "l_extendedprice")
        return rounded(scale.scale_column(rows, "l_quantity", method), 9)


_scale_query("minmax_column", "Min-Max", "(l_quantity - (SELECT min(l_quantity) FROM gaps)) / (SELECT max(l_quantity) - min(l_quantity) FROM gaps)")
_scale_query("zscore_column", "Z-score", "(l_quantity - (SELECT avg(l_quantity) FROM gaps)) / (SELECT stddev_samp(l_quantity) FROM gaps)")
_scale_query("l1_column", "L1 Norm", "l_quantity / (SELECT sum(abs(l_quantity)) FROM gaps)")
_scale_query("l2_column", "L2 Norm", "l_quantity / (SELECT sqrt(sum(l_quantity * l_quantity)) FROM gaps)")
_scale_query("linf_column", "L inf Norm", "l_quantity / (SELECT max(abs(l_quantity)) FROM gaps)")


def _row_query(key: str, method: str, norm: str) -> None:
    shown = ", ".join(f"round(CASE WHEN ({norm}) = 0 THEN {c} ELSE {c} / ({norm}) END, 9) AS {c}" for c in FEATURES)

    @query(key, f"SELECT l_orderkey, {shown} FROM lineitem")
    def run(spark, d):
        return rounded(scale.normalize_rows(table(spark, d, "lineitem").select("l_orderkey", *FEATURES), FEATURES, method), 9)


_row_query("l1_rows", "L1 Norm", " + ".join(f"abs({c})" for c in FEATURES))
_row_query("l2_rows", "L2 Norm", "sqrt(" + " + ".join(f"{c} * {c}" for c in FEATURES) + ")")
_row_query("linf_rows", "L inf Norm", "greatest(" + ", ".join(f"abs({c})" for c in FEATURES) + ")")


@query("minmax_all", with_("numbers", "SELECT l_orderkey, " + ", ".join(
    f"round(CASE WHEN (SELECT max({c}) = min({c}) FROM numbers) THEN 0.5 ELSE ({c} - (SELECT min({c}) FROM numbers)) / (SELECT max({c}) - min({c}) FROM numbers) END, 9)::DOUBLE AS {c}"
    for c in ALL_NUMBERS) + " FROM numbers"))
def minmax_all(spark, d):
    return rounded(scale.scale_all(inputs.numbers(spark, d), ALL_NUMBERS, "Min-Max"), 9)


@query("zscore_all", with_("numbers", "SELECT l_orderkey, " + ", ".join(
    f"round(CASE WHEN (SELECT stddev_samp({c}) = 0 FROM numbers) THEN 0.0 ELSE {c} / (SELECT stddev_samp({c}) FROM numbers) END, 9)::DOUBLE AS {c}"
    for c in ALL_NUMBERS) + " FROM numbers"))
def zscore_all(spark, d):
    return rounded(scale.scale_all(inputs.numbers(spark, d), ALL_NUMBERS, "Z-score"), 9)


@query("log_transform", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 9) END AS l_tax FROM lineitem")
def log_transform(spark, d):
    return rounded(scale.transform_column(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_tax", "Log"), 9)


@query("square_transform", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_extendedprice, 2) AS l_extendedprice FROM lineitem")
def square_transform(spark, d):
    return rounded(scale.transform_column(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "Square"), 2)


@query("sqrt_transform", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def sqrt_transform(spark, d):
    return rounded(scale.transform_column(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "Square Root"), 6)


# --- encoding --------------------------------------------------------------------

@query("label_encode", """SELECT o_orderkey, o_orderpriority, label AS o_custkey FROM (SELECT o_orderkey, o_orderpriority, o_custkey FROM orders) JOIN
    (SELECT o_custkey, (row_number() OVER (ORDER BY count(*) DESC, o_custkey::VARCHAR) - 1)::DOUBLE AS label FROM orders GROUP BY o_custkey) USING (o_custkey)""")
def label_encode(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "CAST(o_custkey AS STRING) AS o_custkey")
    return encode.label_encode(rows, "o_custkey")


@query("one_hot_encode", """WITH l AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS label FROM orders GROUP BY 1)
    SELECT o_orderkey, i::INTEGER AS i, (label = i)::INTEGER::DOUBLE AS bit FROM orders JOIN l USING (o_orderpriority), unnest(range(0, (SELECT count(*) - 1 FROM l))) r(i)""")
def one_hot_encode(spark, d):
    hot = encode.one_hot_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return hot.select("o_orderkey", F.posexplode(encode.dense(F.col("o_orderpriority"))).alias("i", "bit"))


@query("parse_vector_string", """SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c, 3 AS size FROM lineitem""")
def parse_vector_string(spark, d):
    text = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat_ws(', ,', l_quantity, l_discount, l_tax) || ',' AS text")
    vector = text.select("l_orderkey", "l_linenumber", parse_vector(F.col("text")).alias("v"))
    return vector.selectExpr("l_orderkey", "l_linenumber", "v[0] AS a", "v[1] AS b", "v[2] AS c", "size(v) AS size")


@query("reshape_vector", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN embedding[1:50] ELSE embedding END AS e FROM embeddings),
    c AS (SELECT vec_id, len(e) = 64 AS fits, unnest(range(1, len(e) + 1)) AS k, unnest(e)::DOUBLE AS value FROM v)
    SELECT vec_id, CASE WHEN fits THEN (k - 1) // 16 ELSE -1 END::INTEGER AS i, CASE WHEN fits THEN (k - 1) // 4 % 4 ELSE -1 END::INTEGER AS j,
    CASE WHEN fits THEN (k - 1) % 4 ELSE k - 1 END::INTEGER AS l, round(value, 6) AS value FROM c""")
def reshape_vector(spark, d):
    """Vectors of 64 numbers as cubes; every seventh is too short and stays flat."""
    given = F.expr("CASE WHEN vec_id % 7 = 3 THEN slice(embedding, 1, 50) ELSE embedding END").cast("array<double>")
    both = table(spark, d, "embeddings").select("vec_id", reshape_or_keep(given, [4, 4, 4]).alias("r")).select("vec_id", "r.*")
    planes = both.select("vec_id", F.posexplode("shaped").alias("i", "plane"))
    lines = planes.select("vec_id", "i", F.posexplode("plane").alias("j", "line"))
    flat = both.select("vec_id", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.posexplode("flat").alias("l", "value"))
    return rounded(lines.select("vec_id", "i", "j", F.posexplode("line").alias("l", "value")).unionByName(flat))


@query("task_type_detect", """SELECT 'l_linenumber' AS target, (count(DISTINCT l_linenumber) <= 20 AND bool_and(l_linenumber = floor(l_linenumber))) AS discrete FROM lineitem
    UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) <= 20 AND bool_and(l_quantity = floor(l_quantity)) FROM lineitem
    UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) <= 20 AND bool_and(l_tax = floor(l_tax)) FROM lineitem""")
def task_type_detect(spark, d):
    rows = table(spark, d, "lineitem")
    found = [(c, encode.task_type(rows, c) == "classification") for c in ("l_linenumber", "l_quantity", "l_tax")]
    return spark.createDataFrame(found, "target string, discrete boolean")


@query("task_type_detect_mlp", "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS target, CASE WHEN NOT bool_and(abs({c} - round_even({c}, 0)) < 1e-8) OR count(DISTINCT {c}) > greatest(50, floor(count(*) * 0.1)) THEN 'regression' ELSE 'classification' END AS task_type FROM {t}"""
    for c, t in (("l_quantity", "lineitem"), ("l_tax", "lineitem"), ("o_custkey", "orders"))) + ")")
def task_type_detect_mlp(spark, d):
    targets = (("l_quantity", "lineitem"), ("l_tax", "lineitem"), ("o_custkey", "orders"))
    found = [(c, encode.task_type_network(table(spark, d, t), c)) for c, t in targets]
    return spark.createDataFrame(found, "target string, task_type string")
