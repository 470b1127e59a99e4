"""Sources, sinks and landing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..operators.profile import profile_unique
from ..session import scratch_path
from ..sources import tables, versions
from . import inputs
from .inputs import table
from .registry import query, rounded, stamp, with_


@query("read_csv_infer", "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders")
def read_csv_infer(spark, d):
    """All columns: keys, texts, amounts and dates come back with the types that inference gives them."""
    path = scratch_path(spark, "csv")
    table(spark, d, "orders").write.option("header", True).csv(path)
    read = tables.read_table(spark, path, "csv")
    return read.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")}).withColumn("o_orderdate", stamp("o_orderdate"))


@query("read_parquet", "SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem")
def read_parquet(spark, d):
    return tables.read_table(spark, f"{d}/lineitem.parquet").withColumn("l_shipdate", stamp("l_shipdate"))


@query("write_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def write_parquet(spark, d):
    path = tables.write_table(table(spark, d, "customer"), scratch_path(spark, "written") + ".csv")
    return spark.read.parquet(path)


def _profile_sql(source: str, numeric: list[str], strings: list[str], others: tuple[str, ...] = ()) -> str:
    counts = "count(*) AS entries, count(*) - count({c}) AS null_count, {unique} AS unique_count"
    unique = "count(DISTINCT {c}) + max(({c} IS NULL)::INT)"
    parts = [
        f"""SELECT '{c}' AS name, {counts.format(c=c, unique=unique.format(c=c))},
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM {source}"""
        for c in numeric
    ] + [f"SELECT '{c}', {counts.format(c=c, unique=unique.format(c=c))}, NULL, NULL, NULL, NULL FROM {source}" for c in strings]
    # neither numbers nor texts: entries and NULLs only
    parts += [f"SELECT '{c}', {counts.format(c=c, unique='NULL')}, NULL, NULL, NULL, NULL FROM {source}" for c in others]
    return " UNION ALL ".join(parts)


REPORTED = ["name", "entries", "null_count", "unique_count", "mean", "stddev", "min", "max"]


@query("ingest_dataset", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ("o_orderdate",)))
def ingest_dataset(spark, d):
    source = scratch_path(spark, "upload") + ".csv"
    table(spark, d, "orders").write.option("header", True).csv(source)
    report, _ = tables.ingest_dataset(spark, source, "csv", scratch_path(spark, "raw"))
    return rounded(report.select(*REPORTED), 4)


@query("publish_processed", with_("gaps", _profile_sql(
    "gaps", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], ("late", "l_shipdate"))))
def publish_processed(spark, d):
    report, _ = tables.publish_processed(inputs.gaps(spark, d), "gaps", scratch_path(spark, "processed"))
    return rounded(report.select(*REPORTED), 4)


MERGED = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate, NULL::VARCHAR AS state FROM orders
UNION ALL SELECT o_orderkey, NULL, o_totalprice / 2, NULL, NULL, o_orderstatus FROM orders WHERE o_totalprice > 100000"""


def _merge_sides(spark, d):
    orders = table(spark, d, "orders")
    parent = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    extra = orders.filter("o_totalprice > 100000").selectExpr("o_orderstatus AS state", "o_totalprice / 2 AS o_totalprice", "o_orderkey")
    return parent, extra


@query("merge_datasets", f"""SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, round(o_totalprice, 4) AS o_totalprice, o_orderpriority,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, state FROM ({MERGED})""")
def merge_datasets(spark, d):
    merged = tables.merge_datasets(*_merge_sides(spark, d))
    return rounded(merged.withColumn("o_custkey", F.col("o_custkey").cast("double")).withColumn("o_orderdate", stamp("o_orderdate")), 4)


_MERGED_SQL = _profile_sql(f"({MERGED})", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderpriority", "state"], ("o_orderdate",))


@query("merge_swap", f"SELECT *, 1 AS parts_read, CASE WHEN unique_count IS NOT NULL THEN true END AS unique_within_bound FROM ({_MERGED_SQL})")
def merge_swap(spark, d):
    """Two versions of a dataset, the second by a merge, and the profile its merged states give.

    Distinct counts of a state are sketches; they are held against exact ones of the merged rows, which are shown.
    """
    dataset = scratch_path(spark, "dataset")
    parent, extra = _merge_sides(spark, d)
    versions.create(spark, dataset, parent)
    before = versions.newest(spark, dataset)["parts"]
    report = versions.merge(spark, dataset, extra)
    added = len(set(versions.newest(spark, dataset)["parts"]) - set(before))
    exact = profile_unique(versions.read(spark, dataset)).withColumnRenamed("unique_count", "exact")
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.03 * F.col("exact")
    held = report.join(exact, "name", "left").withColumn("unique_within_bound", near).withColumn("unique_count", F.col("exact"))
    return rounded(held.select(*REPORTED, F.lit(added).alias("parts_read"), "unique_within_bound"), 4)


@query("storage_inventory")
def storage_inventory(spark, d):
    return tables.storage_inventory(spark, d)


@query("export_features", "SELECT l_quantity, l_discount, l_extendedprice FROM lineitem")
def export_features(spark, d):
    return tables.export_features(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"], scratch_path(spark, "features"))


@query("read_client_params", """SELECT layout, label::VARCHAR AS session_id, vec_id AS client_id, 2 AS round_number, '2024-01-01T00:00:00' AS submission_time, len(embedding)::BIGINT AS numbers
    FROM embeddings, (SELECT unnest(['lines', 'files']) AS layout) WHERE vec_id % 3 + 1 = 2""")
def read_client_params(spark, d):
    """Documents are written as JSON lines and as one file per client, read back, and one round is kept."""
    root = scratch_path(spark, "clients")
    documents = inputs.parameters(spark, d)
    parsed = F.from_json("document", "weights array<array<double>>, output struct<bias: array<double>>")
    session = F.col("session_id").cast("string").alias("session_id")
    documents.select(session, "client_id", parsed.alias("parameters")).write.json(f"{root}/params")
    documents.select(session, "client_id", F.lit("2024-01-01T00:00:00").alias("submission_time"), F.col("client_id").alias("user_id"), F.col("round").alias("round_number")).write.json(f"{root}/metadata")
    files = scratch_path(spark, "client-files")
    told = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("submission_time"), F.col("client_id").alias("user_id"), F.col("round").alias("round_number")))
    tables.write_client_files(documents.select("session_id", "client_id", F.col("document").alias("parameters"), told.alias("metadata")), files)
    weights = F.from_json("parameters", "weights array<array<double>>")["weights"]
    numbers = F.size(F.flatten(weights)).cast("long").alias("numbers")
    both = [tables.read_client_params(spark, where, 2, layout=layout).select(F.lit(layout).alias("layout"), "session_id", "client_id", "round_number", "submission_time", numbers)
            for where, layout in ((root, "lines"), (files, "files"))]
    return both[0].unionByName(both[1])


RANKED = ("sessions", "users", "tasks", "results", "latest", "board", "report", "marked", "ranked")


@query("export_leaderboard_csv", with_(*RANKED, """SELECT task_id, rank, metric, admin_username AS client_name, model_name,
    round(metric_value, 6) AS metric_value, CASE WHEN meets_benchmark THEN 'Yes' ELSE 'No' END AS meets_benchmark,
    CASE WHEN is_benchmark THEN 'Yes' ELSE 'No' END AS is_benchmark, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS date FROM ranked"""))
def export_leaderboard_csv(spark, d):
    from .reporting import ranked_board

    shown = reports.leaderboard_rows(ranked_board(spark, d))
    path = tables.export_csv(shown, scratch_path(spark, "leaderboard"))
    read = tables.read_table(spark, path, "csv", "task_id int, rank long, client_name string, model_name string, metric string, metric_value double, meets_benchmark string, date string, is_benchmark string")
    return rounded(read)
