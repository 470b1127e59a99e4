"""Reports over the session, task, user, result and notification tables.

Latest-per-key is one aggregate instead of a self-join.  Small sides are left
for adaptive execution to broadcast, which checks their measured size and
splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pretty_model_name
from .ordering import row_numbers
from .paging import PageIndex, index_pages

# Metrics where a smaller value is better.
ERROR_METRICS = ("mae", "mse")
METRICS = "map<string, double>"
# Pages that end by this row are sorted on the fly.
SHALLOW_ROWS = 10_000
# Keys of the session document in use.  Numbers are read as text, because
# documents hold them either way, and cast where they are used.
INFO = {
    "organisation_name": "string", "server_filename": "string", "task_id": "string", "model_name": "string",
    "model_info": "struct<layers: array<struct<layer_type: string, filters: string>>>",
    "expected_std_mean": "string", "expected_std_deviation": "string", "no_of_rounds": "string",
}


def with_info(sessions: DataFrame, *keys: str) -> DataFrame:
    """Sessions with the given keys of their document as struct ``info``, parsed once per row."""
    return sessions.withColumn("info", F.from_json("federated_info", ", ".join(f"{k} {INFO[k]}" for k in keys)))


NO_TASK = -1


def task_of() -> Column:
    """Task id of a session document, never NULL.

    A nullable join key would make the optimizer test it below the join and
    parse every document a second time.
    """
    return F.coalesce(F.col("info.task_id").try_cast("int"), F.lit(NO_TASK))


def metrics_of(column: str = "metrics_report") -> Column:
    return F.from_json(F.col(column), METRICS)


def is_error_metric(metric: Column) -> Column:
    return metric.isin(*ERROR_METRICS)


def session_search(sessions: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Sessions with a status and a case-insensitive text in organisation or file name."""
    found = with_info(sessions, "organisation_name", "server_filename", "no_of_rounds")
    if status:
        found = found.filter(F.col("training_status") == status)
    if search:
        text = f"%{search}%"
        found = found.filter(F.col("info.organisation_name").ilike(text) | F.col("info.server_filename").ilike(text))
    return found


def _session_rows(sessions: DataFrame, status: str | None, search: str | None) -> DataFrame:
    return session_search(sessions, status, search).select(
        "id", "training_status", F.col("info.organisation_name").alias("name"), F.col("info.server_filename").alias("server_filename"),
        F.col("createdAt").alias("created_at"), "curr_round", F.col("info.no_of_rounds").cast("int").alias("total_rounds"),
    )


def _session_order(sort_order: str) -> list[Column]:
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order asc or desc")
    direction = F.asc if sort_order == "asc" else F.desc
    return [direction("created_at"), direction("id")]


def index_sessions(sessions: DataFrame, sort_order: str = "desc", status: str | None = None, search: str | None = None, **options) -> PageIndex:
    """The search's result, sorted by creation time, then id, ready for pages of any depth."""
    return index_pages(_session_rows(sessions, status, search), _session_order(sort_order), **options)


def sessions_page(sessions: DataFrame | PageIndex, page: int = 1, per_page: int = 6, sort_order: str = "desc",
                  status: str | None = None, search: str | None = None) -> DataFrame:
    """One page of the search with its totals; sorted by creation time, then id.

    ``index_sessions`` gives an index for many or deep pages, which takes the place of ``sessions`` and the search.
    """
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page >= 1, per_page 1 to 100")
    skip = (page - 1) * per_page
    if isinstance(sessions, PageIndex) or skip + per_page > SHALLOW_ROWS:
        index = sessions if isinstance(sessions, PageIndex) else index_sessions(sessions, sort_order, status, search)
        rows, total = index.page(skip, per_page), F.lit(index.total).cast("long")
    else:
        found = _session_rows(sessions, status, search)
        rows = found.orderBy(*_session_order(sort_order)).offset(skip).limit(per_page)
        total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(F.col("total") / per_page).cast("long"))


def transfers(table: DataFrame, include_approved: bool = False) -> DataFrame:
    """Transfers awaiting approval, or all of them on request."""
    return table if include_approved else table.filter(F.col("approvedAt").isNull())


_TRANSFER_ORDER = (("transferredAt", False), ("id", False))
_DATASET_ORDER = (("dataset_id", True),)


def _ordered(names: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.asc(n) if up else F.desc(n) for n, up in names]


def _page(rows: DataFrame | PageIndex, index, select, order: Sequence[tuple[str, bool]], skip: int, limit: int) -> DataFrame:
    """A page near the front is the top of each task's rows; a deeper one comes from an index of slices."""
    if isinstance(rows, PageIndex):
        return rows.page(skip, limit)
    if skip + limit > SHALLOW_ROWS:
        return index(rows).page(skip, limit)
    return select(rows).orderBy(*_ordered(order)).offset(skip).limit(limit)


def index_transfers(table: DataFrame, **options) -> PageIndex:
    """Pending transfers, newest first, ready for pages of any depth."""
    return index_pages(transfers(table), _ordered(_TRANSFER_ORDER), **options)


def transfers_page(table: DataFrame | PageIndex, skip: int = 0, limit: int = 100) -> DataFrame:
    """Pending transfers, newest first; ``index_transfers`` serves many pages."""
    return _page(table, index_transfers, transfers, _TRANSFER_ORDER, skip, limit)


def index_datasets(datasets: DataFrame, **options) -> PageIndex:
    return index_pages(_dataset_rows(datasets), _ordered(_DATASET_ORDER), **options)


def _dataset_rows(datasets: DataFrame) -> DataFrame:
    return datasets.select(*[c for c in ("dataset_id", "filename", "description", "created_at") if c in datasets.columns])


def datasets_page(datasets: DataFrame | PageIndex, skip: int = 0, limit: int = 100) -> DataFrame:
    return _page(datasets, index_datasets, _dataset_rows, _DATASET_ORDER, skip, limit)


def undelivered_notifications(notifications: DataFrame, now: Column, user_id: int | None = None) -> DataFrame:
    """Not yet notified and either without expiry or expiring later than ``now``."""
    live = F.col("notified_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > now))
    return notifications.filter(live if user_id is None else live & (F.col("user_id") == user_id))


def recently_active_users(users: DataFrame, now: Column, excluded: DataFrame | None = None) -> DataFrame:
    """Updated within the day before ``now``, not an admin, not excluded (``excluded`` holds ``id``)."""
    active = users.filter((F.col("updatedAt") >= now - F.expr("interval 1 day")) & (F.col("role") != "admin"))
    return active if excluded is None else active.join(excluded.select("id"), "id", "left_anti")


def notify_fanout(users: DataFrame, message: str, now: Column) -> DataFrame:
    """One notification per target user, valid for a day."""
    return users.select(
        F.col("id").alias("user_id"), F.lit(message).alias("message"),
        now.alias("created_at"), (now + F.expr("interval 1 day")).alias("valid_until"),
    )


def latest_round(results: DataFrame) -> DataFrame:
    """Last test result of each session."""
    last = F.max_by(F.struct("round_number", "metrics_report"), F.col("round_number"))
    return results.groupBy("session_id").agg(last.alias("last")).select("session_id", "last.*")


def benchmark_values(tasks: DataFrame) -> DataFrame:
    """``benchmark_mean`` and ``benchmark_std`` of the task's own metric, NULL when absent."""
    parsed = F.from_json("benchmark", "map<string, struct<std_mean: double, std_dev: double>>")
    own = F.try_element_at(parsed, F.col("metric"))
    return tasks.withColumns({"benchmark_mean": own["std_mean"], "benchmark_std": own["std_dev"]})


def task_baseline(tasks: DataFrame) -> DataFrame:
    """Benchmark mean and deviation per task with a status instead of an error."""
    found = benchmark_values(tasks)
    status = F.when(F.col("benchmark_mean").isNull() | F.col("benchmark_std").isNull(), "missing").otherwise("ok")
    return found.select("task_id", "metric", "benchmark_mean", "benchmark_std", status.alias("status"))


def meets_benchmark(metric: Column, value: Column, benchmark: Column) -> Column:
    """At most the benchmark for error metrics, at least otherwise; NULL without a benchmark."""
    return F.when(is_error_metric(metric), value <= benchmark).otherwise(value >= benchmark)


def leaderboard(sessions: DataFrame, results: DataFrame, users: DataFrame, tasks: DataFrame, task_id: int | None = None) -> DataFrame:
    """Sessions of each task with their final metric, when that metric was reported.

    All tasks at once unless ``task_id`` is given; sort with ``leaderboard_order``.
    """
    # only the named fields of the document travel through the joins
    wanted = with_info(sessions, "task_id", "organisation_name", "model_name").select(
        task_of().alias("task_id"), F.col("id").alias("session_id"), "admin_id", "max_round", "createdAt",
        F.col("info.organisation_name").alias("organisation_name"), F.col("info.model_name").alias("model_name"),
    )
    if task_id is not None:
        wanted = wanted.filter(F.col("task_id") == task_id)
        tasks = tasks.filter(F.col("task_id") == task_id)
    last = latest_round(results).withColumn("metrics", metrics_of())
    return (
        wanted.join(last, "session_id")
        .join(benchmark_values(tasks).select("task_id", "task_name", "metric", "benchmark_mean"), "task_id")
        .withColumn("metric_value", F.try_element_at("metrics", F.col("metric")))
        .filter(F.col("metric_value").isNotNull())
        .join(users.select(F.col("id").alias("admin_id"), F.col("name").alias("admin_name")), "admin_id")
        .select(
            "task_id", "task_name", "metric", "session_id", "round_number", "metric_value", "benchmark_mean",
            "organisation_name", "model_name", F.col("max_round").alias("total_rounds"), F.col("createdAt").alias("created_at"), "admin_name",
        )
    )


def goodness(metric: Column, value: Column) -> Column:
    """Sort key: rises as the result gets worse, for every metric."""
    return F.when(is_error_metric(metric), value).otherwise(-value)


def leaderboard_order() -> list[Column]:
    return [F.asc("task_id"), goodness(F.col("metric"), F.col("metric_value")).asc(), F.asc("session_id")]


def leaderboard_report(board: DataFrame) -> DataFrame:
    """The board as shown: defaults for missing names, readable model, benchmark flag."""
    unknown = F.lit("Unknown")
    return board.select(
        "task_id", "task_name", "metric", "session_id",
        F.coalesce("organisation_name", unknown).alias("organisation_name"),
        pretty_model_name(F.coalesce("model_name", unknown)).alias("model_name"),
        "metric_value",
        meets_benchmark(F.col("metric"), F.col("metric_value"), F.col("benchmark_mean")).alias("meets_benchmark"),
        "total_rounds", "created_at",
        F.when(F.length("admin_name") > 0, F.col("admin_name")).otherwise(unknown).alias("admin_username"),
    )


def _benchmark_rows(tasks: DataFrame) -> DataFrame:
    return benchmark_values(tasks).filter("benchmark_mean is not null").select(
        "task_id", "task_name", "metric", F.lit(None).cast("long").alias("session_id"),
        F.lit("Benchmark").alias("organisation_name"), F.lit("Benchmark").alias("model_name"),
        F.col("benchmark_mean").alias("metric_value"), F.lit(True).alias("meets_benchmark"),
        F.lit(None).cast("int").alias("total_rounds"), "created_at", F.lit("Benchmark").alias("admin_username"),
        F.lit(True).alias("is_benchmark"),
    )


def with_benchmark(report: DataFrame, tasks: DataFrame) -> DataFrame:
    """The report with each task's benchmark as one more row."""
    return report.withColumn("is_benchmark", F.lit(False)).unionByName(_benchmark_rows(tasks))


def leaderboard_ranked(report: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sessions and benchmark ranked together per task, best first.

    Ties: benchmark first, then session id.  A task of any size is ranked over
    many tasks, because the order is global (see ``ordering``).
    """
    rows = with_benchmark(report, tasks).withColumn("_worse", goodness(F.col("metric"), F.col("metric_value")))
    order = [F.asc("_worse"), F.desc("is_benchmark"), F.asc("session_id")]
    return row_numbers(rows, order, "rank", by=["task_id"]).drop("_worse")


def leaderboard_rows(ranked: DataFrame) -> DataFrame:
    """The columns of the exported leaderboard."""
    yes = lambda flag: F.when(flag, "Yes").otherwise("No")
    return ranked.select(
        "task_id", "rank", F.col("admin_username").alias("client_name"), "model_name", "metric", "metric_value",
        yes(F.coalesce("meets_benchmark", F.lit(False))).alias("meets_benchmark"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("date"), yes(F.col("is_benchmark")).alias("is_benchmark"),
    )


def leaderboard_timeline(report: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sessions and benchmark by date with a month/year label."""
    rows = with_benchmark(report, tasks)
    label = F.when(~F.col("is_benchmark"), F.date_format("created_at", "MM/yy"))
    return rows.withColumn("month_year", label).orderBy("task_id", "created_at", F.asc_nulls_first("session_id"))


SESSION_STATE = ["curr_round", "max_round", "session_price", "training_status"]


def initiated_sessions(sessions: DataFrame, clients: DataFrame, user_id: int | None = None) -> DataFrame:
    """Sessions each admin started, with the admin's own client status or NULL."""
    mine = sessions if user_id is None else sessions.filter(F.col("admin_id") == user_id)
    own = clients.select(F.col("session_id"), F.col("user_id").alias("admin_id"), F.col("status").alias("client_status"))
    return mine.withColumnRenamed("id", "session_id").join(own, ["session_id", "admin_id"], "left").select(
        "admin_id", "session_id", *SESSION_STATE, "client_status"
    )


def participated_sessions(sessions: DataFrame, clients: DataFrame, user_id: int | None = None) -> DataFrame:
    """Sessions each user joined."""
    joined = clients if user_id is None else clients.filter(F.col("user_id") == user_id)
    return joined.select("user_id", "session_id", F.col("status").alias("client_status")).join(
        sessions.withColumnRenamed("id", "session_id"), "session_id"
    ).select("user_id", "session_id", *SESSION_STATE, "client_status")


def client_counts(clients: DataFrame) -> DataFrame:
    return clients.groupBy("session_id").agg(F.count(F.lit(1)).alias("clients"))


def recent_logs(logs: DataFrame, keep: int = 5) -> DataFrame:
    """Latest messages per session, newest first; at most ``keep`` rows per session leave a map task."""
    newest = W.partitionBy("session_id").orderBy(F.desc("createdAt"), F.desc("id"))
    kept = logs.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= keep)
    ordered = F.array_sort(F.collect_list(F.struct("position", "message")))
    return kept.groupBy("session_id").agg(F.transform(ordered, lambda x: x["message"]).alias("recent_logs"))


def session_status(sessions: DataFrame, clients: DataFrame, logs: DataFrame) -> DataFrame:
    """Session state with the number of clients and the latest log messages."""
    updated = F.col("updatedAt") if "updatedAt" in sessions.columns else F.lit(None)
    return (
        sessions.select(
            F.col("id").alias("session_id"), "training_status", F.col("curr_round").alias("current_round"),
            F.col("max_round").alias("max_rounds"), F.col("createdAt").alias("created_at"), updated.cast("timestamp").alias("updated_at"),
        )
        .join(client_counts(clients), "session_id", "left")
        .join(recent_logs(logs), "session_id", "left")
        .withColumns({
            "clients": F.coalesce("clients", F.lit(0)).cast("long"),
            "recent_logs": F.coalesce("recent_logs", F.array().cast("array<string>")),
        })
    )


def session_logs(logs: DataFrame, session_id: int) -> DataFrame:
    """All messages of a session in time order."""
    return logs.filter(F.col("session_id") == session_id).orderBy("createdAt", "id")


def metrics_long(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and reported metric."""
    return table.select(*keys, F.explode(metrics_of()).alias("metric", "value"))


def training_result_pivot(long: DataFrame, keys: Sequence[str], rounds: Sequence[int]) -> DataFrame:
    """Metric rows against ``round_<n>`` columns; a result of a round that is not among ``rounds`` is an error."""
    number = F.col("round_number")
    outside = F.raise_error(F.concat(F.lit("result of a round without a column: "), F.coalesce(number.cast("string"), F.lit("NULL"))))
    name = F.when(number.isin(*rounds), F.concat(F.lit("round_"), number.cast("string"))).otherwise(outside.cast("string"))
    named = long.withColumn("_round", name)
    # one aggregation over rows dealt out by group, so that a task holds whole groups; pivot() makes a group of each round before
    columns = [F.first(F.when(F.col("_round") == f"round_{r}", F.col("value")), ignorenulls=True).alias(f"round_{r}") for r in rounds]
    return named.repartition(*keys, "metric").groupBy(*keys, "metric").agg(*columns)


def server_vs_client(server: DataFrame, client: DataFrame) -> DataFrame:
    """Server metric per session and round beside each client's own value, which may be missing.

    A left join cannot split a hot round on its right side, so the matches come
    from an inner join, which can, and the rounds without clients from an anti join.
    """
    keys = ["session_id", "metric", "round_number"]
    # spelled out, the filter is the same in both branches, so they share the client's shuffle
    known = client.dropna(subset=keys)
    mine = known.select(*keys, "user_id", F.col("value").alias("client_value"))
    theirs = server.select(*keys, F.col("value").alias("server_value"))
    matched = mine.join(theirs, keys).select(*keys, "server_value", "user_id", "client_value")
    alone = theirs.join(mine.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def tasks_by_dataset(tasks: DataFrame, datasets: DataFrame, dataset_id: int | None = None, filename: str | None = None) -> DataFrame:
    """Tasks with their dataset, chosen by id, by file name or all."""
    chosen = datasets
    if dataset_id is not None:
        chosen = chosen.filter(F.col("dataset_id") == dataset_id)
    if filename is not None:
        chosen = chosen.filter(F.col("filename") == filename)
    return tasks.join(chosen.select("dataset_id", "filename"), "dataset_id")


def permission_grants(clients: DataFrame, sessions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user, task) pairs of joined sessions without a permission row yet."""
    joined = clients.select("user_id", "session_id").join(
        with_info(sessions, "task_id").select(F.col("id").alias("session_id"), task_of().alias("task_id")), "session_id"
    )
    pairs = joined.filter(~F.col("task_id").isin(0, NO_TASK)).select("user_id", "task_id").distinct()
    return pairs.join(permissions.select("user_id", "task_id"), ["user_id", "task_id"], "left_anti")


def auto_enrol_clients(session_id: int, sessions: DataFrame, clients: DataFrame, permissions: DataFrame) -> DataFrame:
    """Clients permitted for the task of one session that have not joined it yet."""
    session = with_info(sessions.filter(F.col("id") == session_id), "task_id").select(task_of().alias("task_id"))
    permitted = permissions.filter("permission").join(session, "task_id", "left_semi").select("user_id").distinct()
    joined = clients.filter(F.col("session_id") == session_id).select("user_id")
    return permitted.join(joined, "user_id", "left_anti").select(F.lit(session_id).cast("long").alias("session_id"), "user_id")
