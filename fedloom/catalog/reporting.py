"""Report queries over sessions, tasks, users, results and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import human_size, pretty_model_name
from ..operators import reports as R
from ..operators import rounds
from . import inputs
from .inputs import table
from .landing import RANKED
from .registry import query, rounded, stamp, with_

NOW = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


def now():
    return F.expr(NOW)


def board(spark, d):
    return R.leaderboard(inputs.sessions(spark, d), inputs.results(spark, d), inputs.users(spark, d), inputs.tasks(spark, d))


def ranked_board(spark, d):
    return R.leaderboard_ranked(R.leaderboard_report(board(spark, d)), inputs.tasks(spark, d))


BOARD = RANKED[:6]


@query("session_search", with_("sessions", "SELECT id, training_status FROM sessions WHERE training_status = 'COMPLETED' AND (organisation_name ILIKE '%ORG 1%' OR server_filename ILIKE '%ORG 1%' OR false)"))
def session_search(spark, d):
    return R.session_search(inputs.sessions(spark, d), "COMPLETED", "ORG 1").select("id", "training_status")


@query("pending_transfers", with_("transfers", "SELECT id, training_name, strftime(transferredAt, '%Y-%m-%d %H:%M:%S') AS transferredAt FROM transfers WHERE approvedAt IS NULL"))
def pending_transfers(spark, d):
    return R.transfers(inputs.transfers(spark, d)).select("id", "training_name", stamp("transferredAt"))


@query("undelivered_notifications", with_("notifications", """SELECT id, user_id, message FROM notifications WHERE notified_at IS NULL
    AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 00:00:00')"""))
def undelivered_notifications(spark, d):
    return R.undelivered_notifications(inputs.notifications(spark, d), now()).select("id", "user_id", "message")


ACTIVE_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 30 HOUR"


@query("recently_active_users", with_("users", f"""SELECT id, role FROM users WHERE updatedAt >= {ACTIVE_AT} - INTERVAL 1 DAY AND role <> 'admin'
    AND id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"""))
def recently_active_users(spark, d):
    excluded = table(spark, d, "supplier").filter("s_acctbal < 0").selectExpr("s_suppkey AS id")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL 30 HOUR")
    return R.recently_active_users(inputs.users(spark, d), at, excluded).select("id", "role")


@query("notify_fanout", with_("users", """SELECT id AS user_id, 'Round 2 starts' AS message, '2024-01-15 00:00:00' AS created_at, '2024-01-16 00:00:00' AS valid_until
    FROM users WHERE role <> 'admin'"""))
def notify_fanout(spark, d):
    sent = R.notify_fanout(inputs.users(spark, d).filter("role <> 'admin'"), "Round 2 starts", now())
    return sent.select("user_id", "message", stamp("created_at"), stamp("valid_until"))


@query("latest_round", with_("results", "latest", "SELECT session_id, round_number, mse, mae, r2 FROM latest"))
def latest_round(spark, d):
    last = R.latest_round(inputs.results(spark, d)).withColumn("m", R.metrics_of())
    return last.selectExpr("session_id", "round_number", "m['mse'] AS mse", "m['mae'] AS mae", "m['r2'] AS r2")


@query("leaderboard", with_(*BOARD, """SELECT task_id, metric, session_id, round_number, metric_value, organisation_name, admin_name,
    strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM board"""))
def leaderboard(spark, d):
    rows = board(spark, d).orderBy(*R.leaderboard_order())
    return rows.select("task_id", "metric", "session_id", "round_number", "metric_value", "organisation_name", "admin_name", stamp("created_at"))


@query("meets_benchmark", with_(*BOARD, "report", "SELECT session_id, metric_value, CASE WHEN meets_benchmark THEN 'yes' WHEN NOT meets_benchmark THEN 'no' END AS meets FROM report"))
def meets_benchmark(spark, d):
    flag = R.meets_benchmark(F.col("metric"), F.col("metric_value"), F.col("benchmark_mean"))
    return board(spark, d).select("session_id", "metric_value", F.when(flag, "yes").when(~flag, "no").alias("meets"))


@query("leaderboard_report", with_(*BOARD, "report", """SELECT task_id, task_name, session_id, organisation_name, model_name, metric_value,
    total_rounds, admin_username FROM report"""))
def leaderboard_report(spark, d):
    return R.leaderboard_report(board(spark, d)).select(
        "task_id", "task_name", "session_id", "organisation_name", "model_name", "metric_value", "total_rounds", "admin_username"
    )


@query("leaderboard_ranked", with_(*RANKED, """SELECT task_id, rank, coalesce(session_id, -1) AS session_id, admin_username, round(metric_value, 6) AS metric_value, is_benchmark FROM ranked"""))
def leaderboard_ranked(spark, d):
    rows = ranked_board(spark, d).withColumn("session_id", F.coalesce("session_id", F.lit(-1)))
    return rounded(rows.select("task_id", "rank", "session_id", "admin_username", "metric_value", "is_benchmark"))


@query("leaderboard_timeline", with_(*RANKED[:-1], """SELECT task_id, coalesce(session_id, -1) AS session_id, round(metric_value, 6) AS metric_value,
    strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN is_benchmark THEN '' ELSE strftime(created_at, '%m/%y') END AS month_year FROM marked"""))
def leaderboard_timeline(spark, d):
    rows = R.leaderboard_timeline(R.leaderboard_report(board(spark, d)), inputs.tasks(spark, d))
    shown = rows.select("task_id", F.coalesce("session_id", F.lit(-1)).alias("session_id"), "metric_value", stamp("created_at"), F.coalesce("month_year", F.lit("")).alias("month_year"))
    return rounded(shown)


STATE = "curr_round, max_round, session_price, training_status"


@query("initiated_sessions", with_("sessions", "clients", "admin_clients", f"""SELECT s.admin_id, s.id AS session_id, {STATE}, coalesce(c.status, -1) AS client_status
    FROM sessions s LEFT JOIN admin_clients c ON c.session_id = s.id AND c.user_id = s.admin_id"""))
def initiated_sessions(spark, d):
    found = R.initiated_sessions(inputs.sessions(spark, d), inputs.admin_clients(spark, d))
    return found.withColumn("client_status", F.coalesce("client_status", F.lit(-1)))


@query("participated_sessions", with_("sessions", "clients", f"SELECT c.user_id, c.session_id, {STATE}, c.status AS client_status FROM clients c JOIN sessions s ON c.session_id = s.id"))
def participated_sessions(spark, d):
    return R.participated_sessions(inputs.sessions(spark, d), inputs.clients(spark, d))


@query("sessions_page", with_("sessions", """SELECT id, training_status, organisation_name AS name, server_filename, strftime(createdAt, '%Y-%m-%d %H:%M:%S') AS created_at,
    curr_round, 7 AS total_rounds, total, ceil(total / 6)::BIGINT AS total_pages FROM (SELECT *, count(*) OVER () AS total FROM sessions
    WHERE training_status = 'STARTED' AND (organisation_name ILIKE '%urgent%' OR server_filename ILIKE '%urgent%')) ORDER BY createdAt DESC, id DESC LIMIT 6 OFFSET 12"""))
def sessions_page(spark, d):
    index = R.index_sessions(inputs.sessions(spark, d), status="STARTED", search="urgent", slice_rows=500)
    page = R.sessions_page(index, page=3, per_page=6)
    return page.withColumn("created_at", stamp("created_at"))


@query("datasets_page", with_("datasets", "SELECT dataset_id, filename, description FROM datasets ORDER BY dataset_id LIMIT 3 OFFSET 1"))
def datasets_page(spark, d):
    return R.datasets_page(R.index_datasets(inputs.datasets(spark, d), slice_rows=2), skip=1, limit=3)


@query("transfers_page", with_("transfers", """SELECT id, training_name, strftime(transferredAt, '%Y-%m-%d %H:%M:%S') AS transferredAt FROM transfers
    WHERE approvedAt IS NULL ORDER BY transfers.transferredAt DESC, id DESC LIMIT 100 OFFSET 50"""))
def transfers_page(spark, d):
    return R.transfers_page(R.index_transfers(inputs.transfers(spark, d), slice_rows=40), skip=50, limit=100).select("id", "training_name", stamp("transferredAt"))


@query("session_status", with_("sessions", "clients", "logs", """SELECT s.id AS session_id, s.training_status, s.curr_round AS current_round, s.max_round AS max_rounds,
    (SELECT count(*) FROM clients c WHERE c.session_id = s.id) AS clients, coalesce(l.recent_logs, '') AS recent_logs FROM sessions s LEFT JOIN
    (SELECT session_id, string_agg(message, '|' ORDER BY createdAt DESC, id DESC) AS recent_logs FROM
    (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY createdAt DESC, id DESC) <= 5) GROUP BY session_id) l ON l.session_id = s.id"""))
def session_status(spark, d):
    status = R.session_status(inputs.sessions(spark, d), inputs.clients(spark, d), inputs.logs(spark, d))
    return status.drop("created_at", "updated_at").withColumn("recent_logs", F.concat_ws("|", "recent_logs"))


@query("session_logs", with_("logs", "SELECT id, message, tag, strftime(createdAt, '%Y-%m-%d %H:%M:%S') AS createdAt FROM logs WHERE session_id = 8"))
def session_logs(spark, d):
    return R.session_logs(inputs.logs(spark, d), 8).select("id", "message", "tag", stamp("createdAt"))


ROUNDS = range(1, 8)
LONG = """SELECT session_id, 'mse' AS metric, round_number, mse AS value FROM {t} WHERE mse IS NOT NULL UNION ALL
    SELECT session_id, 'mae', round_number, mae FROM {t} WHERE mae IS NOT NULL UNION ALL SELECT session_id, 'r2', round_number, r2 FROM {t} WHERE r2 IS NOT NULL"""


def server_long(spark, d):
    return R.metrics_long(inputs.results(spark, d), ["session_id", "round_number"])


def first_submissions(spark, d):
    return rounds.first_submission_wins(inputs.submissions(spark, d), inputs.submission_order())


def client_long(spark, d):
    return R.metrics_long(first_submissions(spark, d), ["session_id", "user_id", "round_number"])


@query("training_result_pivot", with_("results", f"SELECT session_id, metric, {', '.join(f'max(CASE WHEN round_number = {r} THEN value END) AS round_{r}' for r in ROUNDS)} FROM long GROUP BY session_id, metric", long=LONG.format(t="results")))
def training_result_pivot(spark, d):
    return R.training_result_pivot(server_long(spark, d), ["session_id"], ROUNDS)


@query("server_vs_client", with_("results", "submissions", "first_subs", """SELECT s.session_id, s.metric, s.round_number, s.value AS server_value, c.user_id, c.value AS client_value
    FROM server s LEFT JOIN client c ON s.session_id = c.session_id AND s.metric = c.metric AND s.round_number = c.round_number""",
    server=LONG.format(t="results"),
    client="""SELECT session_id, user_id, 'mse' AS metric, round_number, mse AS value FROM first_subs UNION ALL SELECT session_id, user_id, 'mae', round_number, mae FROM first_subs""")
    .replace("c.user_id, c.value", "coalesce(c.user_id, -1) AS user_id, c.value"))
def server_vs_client(spark, d):
    both = R.server_vs_client(server_long(spark, d), client_long(spark, d))
    return both.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@query("tasks_by_dataset", with_("tasks", "datasets", "SELECT task_id, dataset_id, task_name, metric, filename FROM tasks JOIN datasets USING (dataset_id) WHERE filename = 'asia.parquet'"))
def tasks_by_dataset(spark, d):
    found = R.tasks_by_dataset(inputs.tasks(spark, d), inputs.datasets(spark, d), filename="asia.parquet")
    return found.select("task_id", "dataset_id", "task_name", "metric", "filename")


@query("round_readiness", with_("sessions", "submissions", "first_subs", "clients", """SELECT f.session_id, f.round_number, f.received, c.clients, s.no_of_left_clients::BIGINT AS left_clients,
    c.clients = f.received + s.no_of_left_clients AS ready FROM (SELECT session_id, round_number, count(*) AS received FROM first_subs GROUP BY ALL) f
    JOIN (SELECT session_id, count(*) AS clients FROM clients GROUP BY ALL) c ON c.session_id = f.session_id JOIN sessions s ON s.id = f.session_id"""))
def round_readiness(spark, d):
    return rounds.round_readiness(first_submissions(spark, d), inputs.clients(spark, d), inputs.sessions(spark, d))


@query("missing_clients", with_("sessions", "submissions", "clients", """SELECT c.session_id, c.user_id, s.curr_round AS round_number FROM clients c JOIN sessions s ON c.session_id = s.id
    WHERE NOT EXISTS (SELECT 1 FROM submissions b WHERE b.session_id = c.session_id AND b.user_id = c.user_id AND b.round_number = s.curr_round)"""))
def missing_clients(spark, d):
    return rounds.missing_clients(inputs.clients(spark, d), inputs.sessions(spark, d), inputs.submissions(spark, d))


@query("sessions_startable", with_("sessions", "clients", """SELECT s.id AS session_id, s.training_status, count(*) AS clients FROM sessions s JOIN clients c ON c.session_id = s.id
    WHERE s.training_status = 'ACCEPTING_CLIENTS' GROUP BY ALL HAVING count(*) > 2"""))
def sessions_startable(spark, d):
    return rounds.sessions_startable(inputs.sessions(spark, d), inputs.clients(spark, d))


@query("permission_grants", with_("sessions", "clients", "permissions", """SELECT DISTINCT c.user_id, s.task_id FROM clients c JOIN sessions s ON s.id = c.session_id
    WHERE s.task_id <> 0 AND NOT EXISTS (SELECT 1 FROM permissions p WHERE p.user_id = c.user_id AND p.task_id = s.task_id)"""))
def permission_grants(spark, d):
    return R.permission_grants(inputs.clients(spark, d), inputs.sessions(spark, d), inputs.permissions(spark, d))


@query("auto_enrol_clients", with_("sessions", "clients", "permissions", """SELECT 17::BIGINT AS session_id, user_id FROM permissions WHERE task_id = (SELECT task_id FROM sessions WHERE id = 17)
    AND user_id NOT IN (SELECT user_id FROM clients WHERE session_id = 17)"""))
def auto_enrol_clients(spark, d):
    return R.auto_enrol_clients(17, inputs.sessions(spark, d), inputs.clients(spark, d), inputs.permissions(spark, d))


@query("pretty_model_name", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Land Mark SVM' WHEN 1 THEN 'Multi Layer Perceptron' WHEN 2 THEN 'Unknown'
    ELSE upper(p_name[1]) || p_name[2:] || ' ' || regexp_replace(p_brand, '([a-z])([A-Z])', '\\1 \\2', 'g') END AS name FROM part""")
def pretty_names(spark, d):
    raw = F.expr("""CASE p_partkey % 4 WHEN 0 THEN 'LandMarkSVM' WHEN 1 THEN 'multiLayerPerceptron' WHEN 2 THEN 'Unknown' ELSE p_name || p_brand END""")
    return table(spark, d, "part").select("p_partkey", pretty_model_name(raw).alias("name"))


@query("human_size", """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1024.0 ** 2 THEN printf('%.2f KB', b / 1024.0 ** 1)
    WHEN b < 1024.0 ** 3 THEN printf('%.2f MB', b / 1024.0 ** 2) WHEN b < 1024.0 ** 4 THEN printf('%.2f GB', b / 1024.0 ** 3) ELSE printf('%.2f TB', b / 1024.0 ** 4) END AS size
    FROM (SELECT doc_id, n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1001 WHEN 2 THEN 999983 ELSE 99999989 END)::BIGINT AS b FROM documents)""")
def human_sizes(spark, d):
    scaled = F.expr("n_chars * CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1001 WHEN 2 THEN 999983 ELSE 99999989 END AS BIGINT)")
    return table(spark, d, "documents").select("doc_id", human_size(scaled).alias("size"))
