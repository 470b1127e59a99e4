"""The reference's tables derived from the driver's tables, in Spark and in SQL.

Each function has its SQL twin of the same name in ``TABLES``.  JSON columns
exist on the Spark side only; SQL keeps the fields as plain columns, so the
check also covers the JSON handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with NULLs in an int, a double, a string and a boolean column."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
        "l_linestatus",
        "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_tax > 0.04 END AS late",
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate",
    )


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numeric lineitem columns with a constant one."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "1.5D AS fixed"
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    layers = """CASE WHEN o_orderkey % 6 = 0 THEN array(named_struct('layer_type', 'dense', 'filters', CAST(NULL AS STRING), 'num_nodes', '4'))
        ELSE array(named_struct('layer_type', 'convolution', 'filters', '64', 'num_nodes', CAST(NULL AS STRING)),
        named_struct('layer_type', 'pooling', 'filters', CAST(NULL AS STRING), 'num_nodes', CAST(NULL AS STRING)),
        named_struct('layer_type', 'convolution', 'filters', CAST(o_orderkey % 6 * 8 AS STRING), 'num_nodes', CAST(NULL AS STRING)),
        named_struct('layer_type', 'dense', 'filters', CAST(NULL AS STRING), 'num_nodes', '4')) END"""
    return table(spark, d, "orders").withColumn("layers", F.expr(layers)).selectExpr(
        "o_orderkey AS id",
        """to_json(named_struct(
            'organisation_name', CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'Org ' || CAST(o_custkey % 25 AS STRING) END,
            'server_filename', o_orderpriority || '.parquet',
            'task_id', CAST(o_orderkey % 25 AS STRING),
            'model_name', CASE o_orderkey % 5 WHEN 0 THEN 'LinearRegression' WHEN 1 THEN 'multiLayerPerceptron'
                WHEN 2 THEN 'LandMarkSVM' WHEN 3 THEN 'customCnnNet' ELSE NULL END,
            'model_info', named_struct('layers', layers),
            'expected_std_mean', 0.03D + (o_custkey % 40) * 0.002D,
            'expected_std_deviation', 0.01D + (o_orderkey % 4) * 0.01D,
            'no_of_rounds', 7)) AS federated_info""",
        "o_custkey AS admin_id", "CAST(1 + o_orderkey % 7 AS INT) AS curr_round", "7 AS max_round", "o_totalprice AS session_price",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ACCEPTING_CLIENTS' ELSE 'STARTED' END AS training_status",
        "CAST(o_orderkey % 2 AS INT) AS no_of_left_clients", "o_orderdate AS createdAt",
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "lower(c_name) AS username",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'client' END AS role",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(c_custkey AS INT), 0) AS updatedAt",
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    metric = "CASE n_nationkey % 3 WHEN 0 THEN 'mse' WHEN 1 THEN 'mae' ELSE 'r2' END"
    mean = "CASE WHEN n_nationkey % 3 = 2 THEN 0.4D + n_nationkey * 0.01D ELSE 0.03D + n_nationkey * 0.001D END"
    return table(spark, d, "nation").selectExpr(
        "n_nationkey AS task_id", "n_regionkey AS dataset_id", "n_name AS task_name", "'l_discount' AS output_column",
        f"{metric} AS metric",
        f"CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE to_json(map({metric}, named_struct('std_mean', {mean}, 'std_dev', 0.01D))) END AS benchmark",
        "TIMESTAMP_NTZ '1997-01-01 00:00:00' + make_dt_interval(n_nationkey * 30, 0, 0, 0) AS created_at",
    )


def datasets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").selectExpr(
        "r_regionkey AS dataset_id", "lower(r_name) || '.parquet' AS filename", "r_name AS description"
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """Server metrics per session and round."""
    reported = F.struct(
        F.round(F.avg("l_discount"), 6).alias("mse"),
        F.when(F.col("l_orderkey") % 13 != 0, F.round(F.avg("l_tax"), 6)).alias("mae"),
        F.round(F.avg("l_quantity") / 50, 6).alias("r2"),
    )
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.to_json(reported).alias("metrics_report")).select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("round_number"), "metrics_report"
    )


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Client submissions, some of them repeated."""
    return as_submissions(table(spark, d, "lineitem"))


def as_submissions(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey AS session_id", "l_suppkey AS user_id", "l_linenumber AS round_number", "l_shipdate AS createdAt",
        "to_json(named_struct('mse', l_discount, 'mae', l_tax)) AS metrics_report",
        "l_partkey AS part", "l_extendedprice AS price", "l_quantity AS quantity",
    )


def submission_order() -> list:
    return [F.asc(c) for c in ("createdAt", "part", "price", "quantity", "metrics_report")]


def clients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("session_id")).distinct().selectExpr(
        "user_id", "session_id", "CAST(user_id % 2 AS INT) AS status"
    )


def admin_clients(spark: SparkSession, d: str) -> DataFrame:
    """Clients, among them the admins of finished and started sessions."""
    admins = table(spark, d, "orders").selectExpr("o_custkey AS user_id", "o_orderkey AS session_id", "CAST(o_orderkey % 2 AS INT) AS status", "o_orderstatus")
    own = admins.filter("o_orderstatus <> 'O'").drop("o_orderstatus")
    return clients(spark, d).join(own.select("user_id", "session_id"), ["user_id", "session_id"], "left_anti").unionByName(own)


def permissions(spark: SparkSession, d: str) -> DataFrame:
    """Permissions of the clients whose goods came back."""
    return table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_tax < 0.02").selectExpr(
        "l_suppkey AS user_id", "CAST(l_orderkey % 25 AS INT) AS task_id", "true AS permission"
    ).distinct()


def logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS id", "user_id AS session_id", "event_type || ' ' || CAST(event_id AS STRING) AS message",
        "upper(event_type) AS tag", "ts AS createdAt",
    )


def notifications(spark: SparkSession, d: str) -> DataFrame:
    return as_notifications(table(spark, d, "events"))


def as_notifications(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id", "user_id", "props AS message", "ts AS created_at",
        "CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS notified_at",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY END AS valid_until",
    )


def transfers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "'run ' || CAST(o_custkey AS STRING) AS training_name", "o_orderdate AS transferredAt",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS approvedAt",
    )


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """One JSON parameter document per client, session and round."""
    as_double = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(as_double, i * 8 + 1, F.lit(8)))
    document = F.to_json(F.struct(
        rows.alias("weights"), F.struct(F.slice(as_double, 1, 4).alias("bias")).alias("output"),
        F.lit(64).alias("n_features"), F.concat(F.lit("client "), F.col("vec_id").cast("string")).alias("task_type"),
    ))
    return table(spark, d, "embeddings").select(
        F.col("label").alias("session_id"), (F.col("vec_id") % 3 + 1).cast("int").alias("round"),
        F.col("vec_id").alias("client_id"), document.alias("document"),
    )


def regression_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_returnflag AS grp", "l_extendedprice AS label", "l_quantity * 1400 + l_partkey AS prediction"
    )


def binary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id", "CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS label",
        "CASE WHEN value > 60 THEN 1 ELSE 0 END AS prediction", "round(value) / 500 AS score",
    )


def class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_type AS label",
        "CASE WHEN value < 25 THEN 'click' WHEN value < 60 THEN event_type WHEN user_id < 75 THEN 'view' ELSE 'error' END AS prediction",
    )


TABLES = {
    "gaps": """SELECT l_orderkey, l_partkey, l_suppkey,
        CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber,
        CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
        l_extendedprice, l_discount, l_tax,
        CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
        l_linestatus, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_tax > 0.04 END AS late, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate FROM lineitem""",
    "numbers": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, 1.5::DOUBLE AS fixed FROM lineitem",
    "sessions": """SELECT o_orderkey AS id, o_custkey AS admin_id, CAST(1 + o_orderkey % 7 AS INTEGER) AS curr_round, 7 AS max_round,
        o_totalprice AS session_price,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ACCEPTING_CLIENTS' ELSE 'STARTED' END AS training_status,
        CAST(o_orderkey % 2 AS INTEGER) AS no_of_left_clients, o_orderdate AS createdAt,
        CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'Org ' || (o_custkey % 25) END AS organisation_name,
        o_orderpriority || '.parquet' AS server_filename, CAST(o_orderkey % 25 AS INTEGER) AS task_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'LinearRegression' WHEN 1 THEN 'multiLayerPerceptron' WHEN 2 THEN 'LandMarkSVM'
            WHEN 3 THEN 'customCnnNet' ELSE NULL END AS model_name,
        CAST(o_orderkey % 6 * 8 AS INTEGER) AS predictors,
        0.03::DOUBLE + (o_custkey % 40) * 0.002::DOUBLE AS new_mean, 0.01::DOUBLE + (o_orderkey % 4) * 0.01::DOUBLE AS new_std
        FROM orders""",
    "users": """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'client' END AS role,
        CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS updatedAt FROM customer""",
    "tasks": """SELECT n_nationkey AS task_id, n_regionkey AS dataset_id, n_name AS task_name,
        CASE n_nationkey % 3 WHEN 0 THEN 'mse' WHEN 1 THEN 'mae' ELSE 'r2' END AS metric,
        CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 3 = 2 THEN 0.4::DOUBLE + n_nationkey * 0.01::DOUBLE
            ELSE 0.03::DOUBLE + n_nationkey * 0.001::DOUBLE END AS benchmark_mean,
        CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 0.01::DOUBLE END AS benchmark_std,
        TIMESTAMP '1997-01-01 00:00:00' + to_days(n_nationkey * 30) AS created_at FROM nation""",
    "datasets": "SELECT r_regionkey AS dataset_id, lower(r_name) || '.parquet' AS filename, r_name AS description FROM region",
    "results": """SELECT l_orderkey AS session_id, l_linenumber AS round_number, round(avg(l_discount), 6) AS mse,
        CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE round(avg(l_tax), 6) END AS mae, round(avg(l_quantity) / 50, 6) AS r2
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "submissions": """SELECT l_orderkey AS session_id, l_suppkey AS user_id, l_linenumber AS round_number, l_shipdate AS createdAt,
        l_discount AS mse, l_tax AS mae, l_partkey AS part, l_extendedprice AS price, l_quantity AS quantity FROM lineitem""",
    "first_subs": """SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY session_id, user_id, round_number
        ORDER BY createdAt, part, price, quantity, mse, mae) = 1""",
    "clients": "SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS session_id, CAST(l_suppkey % 2 AS INTEGER) AS status FROM lineitem",
    "admin_clients": """SELECT user_id, session_id, status FROM clients WHERE (user_id, session_id) NOT IN
        (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderstatus <> 'O')
        UNION ALL SELECT o_custkey, o_orderkey, CAST(o_orderkey % 2 AS INTEGER) FROM orders WHERE o_orderstatus <> 'O'""",
    "permissions": """SELECT DISTINCT l_suppkey AS user_id, CAST(l_orderkey % 25 AS INTEGER) AS task_id FROM lineitem
        WHERE l_returnflag = 'R' AND l_tax < 0.02""",
    "logs": """SELECT event_id AS id, user_id AS session_id, event_type || ' ' || event_id AS message, upper(event_type) AS tag,
        ts AS createdAt FROM events""",
    "notifications": """SELECT event_id AS id, user_id, props AS message, ts AS created_at,
        CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS notified_at,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY END AS valid_until FROM events""",
    "transfers": """SELECT o_orderkey AS id, 'run ' || o_custkey AS training_name, o_orderdate AS transferredAt,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS approvedAt FROM orders""",
    "latest": """SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round_number DESC) = 1""",
    "board": """SELECT s.task_id, t.task_name, t.metric, s.id AS session_id, r.round_number,
        CASE t.metric WHEN 'mse' THEN r.mse WHEN 'mae' THEN r.mae ELSE r.r2 END AS metric_value, t.benchmark_mean,
        s.organisation_name, s.model_name, s.max_round AS total_rounds, s.createdAt AS created_at, u.name AS admin_name
        FROM sessions s JOIN latest r ON s.id = r.session_id JOIN tasks t ON s.task_id = t.task_id JOIN users u ON s.admin_id = u.id
        WHERE CASE t.metric WHEN 'mse' THEN r.mse WHEN 'mae' THEN r.mae ELSE r.r2 END IS NOT NULL""",
    "report": """SELECT task_id, task_name, metric, session_id, coalesce(organisation_name, 'Unknown') AS organisation_name,
        CASE model_name WHEN 'LinearRegression' THEN 'Linear Regression' WHEN 'multiLayerPerceptron' THEN 'Multi Layer Perceptron'
            WHEN 'LandMarkSVM' THEN 'Land Mark SVM' WHEN 'customCnnNet' THEN 'Custom Cnn Net' ELSE 'Unknown' END AS model_name,
        metric_value, CASE WHEN metric IN ('mae', 'mse') THEN metric_value <= benchmark_mean ELSE metric_value >= benchmark_mean END AS meets_benchmark,
        total_rounds, created_at, coalesce(admin_name, 'Unknown') AS admin_username FROM board""",
    "marked": """SELECT *, false AS is_benchmark FROM report UNION ALL
        SELECT task_id, task_name, metric, NULL, 'Benchmark', 'Benchmark', benchmark_mean, true, NULL, created_at, 'Benchmark', true
        FROM tasks WHERE benchmark_mean IS NOT NULL""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN metric IN ('mae', 'mse') THEN metric_value
        ELSE -metric_value END, is_benchmark DESC, session_id) AS rank FROM marked""",
    "long_params": """SELECT label AS session_id, CAST(vec_id % 3 + 1 AS INTEGER) AS round, vec_id AS client_id, path, i, j, value FROM (
        SELECT label, vec_id, 'weights' AS path, CAST((k - 1) // 8 AS INTEGER) AS i, CAST((k - 1) % 8 AS INTEGER) AS j, embedding[k]::DOUBLE AS value
        FROM embeddings, unnest(range(1, 65)) r(k)
        UNION ALL SELECT label, vec_id, 'output.bias', CAST(k - 1 AS INTEGER), -1, embedding[k]::DOUBLE
        FROM embeddings, unnest(range(1, 5)) r(k))""",
    "regression_pairs": "SELECT l_returnflag AS grp, l_extendedprice AS label, l_quantity * 1400 + l_partkey AS prediction FROM lineitem",
    "binary_pairs": """SELECT user_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS label,
        CASE WHEN value > 60 THEN 1 ELSE 0 END AS prediction, round(value) / 500 AS score FROM events""",
    "class_pairs": """SELECT event_type AS label, CASE WHEN value < 25 THEN 'click' WHEN value < 60 THEN event_type
        WHEN user_id < 75 THEN 'view' ELSE 'error' END AS prediction FROM events""",
}
