import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fedloom.operators import reports as R

T0 = dt.datetime(2024, 3, 1)


@pytest.fixture
def world(spark):
    def info(task, org, model):
        return json.dumps({k: v for k, v in {"task_id": task, "organisation_name": org, "model_name": model, "server_filename": "Rain.parquet", "no_of_rounds": 3}.items() if v is not None})

    sessions = spark.createDataFrame([
        (1, info("1", "Acme", "LinearRegression"), 10, 3, 3, "COMPLETED", T0), (2, info(1, None, None), 11, 3, 3, "STARTED", T0 + dt.timedelta(40)),
        (3, info("2", "Beta", "randomForest"), 10, 1, 3, "ACCEPTING_CLIENTS", T0), (4, info("no", "Acme", "x"), 10, 1, 3, "STARTED", T0),
    ], "id long, federated_info string, admin_id int, curr_round int, max_round int, training_status string, createdAt timestamp").withColumn("session_price", F.lit(1.0))
    results = spark.createDataFrame([
        (1, 1, '{"mse": 9.0}'), (1, 2, '{"mse": 4.0, "r2": 0.5}'), (2, 1, '{"mse": 2.0}'), (3, 1, '{"mae": 1.0}'), (4, 1, '{"mse": 0.0}'),
    ], "session_id long, round_number int, metrics_report string")
    users = spark.createDataFrame([(10, "Ann"), (11, None)], "id int, name string")
    tasks = spark.createDataFrame([
        (1, 5, "rain", "mse", json.dumps({"mse": {"std_mean": 3.0, "std_dev": 1.0}}), T0 + dt.timedelta(1)), (2, 5, "snow", "r2", None, T0),
    ], "task_id int, dataset_id int, task_name string, metric string, benchmark string, created_at timestamp")
    return sessions, results, users, tasks


def test_leaderboard(world):
    sessions, results, users, tasks = world
    board = R.leaderboard(sessions, results, users, tasks)
    assert rows(board.select("session_id", "round_number", "metric_value")) == [(1, 2, 4.0), (2, 1, 2.0)]
    assert R.leaderboard(sessions, results, users, tasks, task_id=2).count() == 0
    report = {r["session_id"]: r for r in R.leaderboard_report(board).collect()}
    assert (report[1]["model_name"], report[1]["meets_benchmark"], report[1]["admin_username"]) == ("Linear Regression", False, "Ann")
    assert (report[2]["organisation_name"], report[2]["model_name"], report[2]["meets_benchmark"], report[2]["admin_username"]) == ("Unknown", "Unknown", True, "Unknown")
    ranked = R.leaderboard_ranked(R.leaderboard_report(board), tasks)
    assert rows(ranked.select("rank", "admin_username", "metric_value")) == [(1, "Unknown", 2.0), (2, "Benchmark", 3.0), (3, "Ann", 4.0)]
    timeline = R.leaderboard_timeline(R.leaderboard_report(board), tasks).select("month_year", "is_benchmark").collect()
    assert [tuple(r) for r in timeline] == [("03/24", False), (None, True), ("04/24", False)]


def test_meets_benchmark_directions(spark):
    df = spark.createDataFrame([("mse", 1.0, 2.0), ("auc", 1.0, 2.0), ("auc", 3.0, 2.0), ("mae", 2.0, 2.0), ("mse", 1.0, None)], "m string, v double, b double")
    assert [r[0] for r in df.select(R.meets_benchmark(F.col("m"), F.col("v"), F.col("b"))).collect()] == [True, False, True, True, None]


def test_task_baseline(world):
    assert rows(R.task_baseline(world[3]).select("task_id", "benchmark_std", "status")) == [(1, 1.0, "ok"), (2, None, "missing")]


def test_search_and_pages(world):
    sessions = world[0]
    assert R.session_search(sessions, search="aCM").count() == 2
    assert R.session_search(sessions, status="STARTED", search="rain").count() == 2
    page = R.sessions_page(sessions, page=2, per_page=3).collect()
    assert [(r["id"], r["total"], r["total_pages"]) for r in page] == [(1, 4, 2)]
    assert [r["id"] for r in R.sessions_page(sessions, sort_order="asc", per_page=2).collect()] == [1, 3]
    with pytest.raises(ValueError):
        R.sessions_page(sessions, per_page=101)


def test_client_views(spark, world):
    sessions, results, _, _ = world
    clients = spark.createDataFrame([(10, 1, 1), (10, 2, 0), (12, 1, 0)], "user_id int, session_id long, status int")
    assert rows(R.initiated_sessions(sessions, clients, 10).select("session_id", "client_status")) == [(1, 1), (3, None), (4, None)]
    assert rows(R.participated_sessions(sessions, clients, 10).select("session_id", "client_status")) == [(1, 1), (2, 0)]
    permissions = spark.createDataFrame([(10, 1, True), (13, 1, True), (14, 1, False)], "user_id int, task_id int, permission boolean")
    assert rows(R.permission_grants(clients, sessions, permissions)) == [(12, 1)]
    assert rows(R.auto_enrol_clients(1, sessions, clients, permissions)) == [(1, 13)]
    server = R.metrics_long(results, ["session_id", "round_number"])
    mine = spark.createDataFrame([(1, 2, "mse", 10, 8.0), (1, 9, "mse", 10, 8.0)], "session_id long, round_number int, metric string, user_id int, value double")
    both = R.server_vs_client(server, mine).filter("session_id = 1")
    assert rows(both.select("round_number", "metric", "server_value", "client_value"), "round_number", "metric") == [(1, "mse", 9.0, None), (2, "mse", 4.0, 8.0), (2, "r2", 0.5, None)]
    pivot = R.training_result_pivot(server, ["session_id"], [1, 2]).filter("session_id = 1")
    assert rows(pivot.select("metric", "round_1", "round_2")) == [("mse", 9.0, 4.0), ("r2", None, 0.5)]


def test_status_keeps_five_newest_logs(spark, world):
    logs = spark.createDataFrame([(i, 1, f"m{i}", T0 + dt.timedelta(minutes=i // 2)) for i in range(9)], "id int, session_id long, message string, createdAt timestamp")
    clients = spark.createDataFrame([(10, 1)], "user_id int, session_id long")
    got = {r["session_id"]: r for r in R.session_status(world[0], clients, logs).collect()}
    assert got[1]["recent_logs"] == ["m8", "m7", "m6", "m5", "m4"] and got[1]["clients"] == 1
    assert got[3]["recent_logs"] == [] and got[3]["clients"] == 0
    assert [r["id"] for r in R.session_logs(logs, 1).collect()] == list(range(9))


def test_notifications_and_users(spark):
    day = dt.timedelta(days=1)
    notes = spark.createDataFrame([(1, 5, None, T0 + day), (2, 5, None, T0), (3, 5, None, None), (4, 5, T0, None), (5, 6, None, None)],
                                  "id int, user_id int, notified_at timestamp, valid_until timestamp")
    now = F.lit(T0)
    assert rows(R.undelivered_notifications(notes, now, 5).select("id")) == [(1,), (3,)]
    users = spark.createDataFrame([(1, "client", T0 - day), (2, "admin", T0), (3, "client", T0 - 2 * day), (4, "client", T0)], "id int, role string, updatedAt timestamp")
    active = R.recently_active_users(users, now, spark.createDataFrame([(4,)], "id int"))
    assert rows(active.select("id")) == [(1,)]
    assert rows(R.notify_fanout(active, "hi", now)) == [(1, "hi", T0, T0 + day)]


def test_transfers_and_datasets(spark):
    table = spark.createDataFrame([(1, T0, None), (2, T0 + dt.timedelta(1), None), (3, T0, T0)], "id int, transferredAt timestamp, approvedAt timestamp")
    assert [r["id"] for r in R.transfers_page(table).collect()] == [2, 1]
    assert R.transfers(table, include_approved=True).count() == 3
    datasets = spark.createDataFrame([(2, "b", "", "{}"), (1, "a", "", "{}")], "dataset_id int, filename string, description string, datastats string")
    assert rows(R.datasets_page(datasets, skip=1)) == [(2, "b", "")]
    tasks = spark.createDataFrame([(7, 2)], "task_id int, dataset_id int")
    assert R.tasks_by_dataset(tasks, datasets, filename="b").count() == 1 and R.tasks_by_dataset(tasks, datasets, dataset_id=1).count() == 0


def test_deep_pages_read_their_slices_only(spark, tmp_path):
    from fedloom.operators.paging import index_pages

    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 97 END AS k", "uuid() AS s")
    order = [F.desc("k"), F.asc("id")]
    index = index_pages(df, order, str(tmp_path / "p"), slice_rows=1500)
    wanted = [r["id"] for r in df.orderBy(*order).collect()]
    assert index.total == 20_000 and len(index.slices) > 8
    for skip, limit in ((0, 7), (1495, 20), (9_000, 3_200), (19_990, 50), (20_000, 5), (50_000, 5), (3, 0)):
        assert [r["id"] for r in index.page(skip, limit).collect()] == wanted[skip:skip + limit]
    files = index.page(15_000, 10).inputFiles()
    assert len({f.split("_slice=")[1].split("/")[0] for f in files}) >= 1
    plan = index.page(15_000, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_slice" in plan.split("PartitionFilters")[1]
    with pytest.raises(ValueError, match="not negative"):
        index.page(-1, 5)
    empty = index_pages(df.limit(0), order, str(tmp_path / "e"))
    assert empty.total == 0 and empty.page(0, 5).collect() == [] and empty.page(0, 5).columns == df.columns


def test_results_become_columns_in_one_aggregation(spark):
    """No groups of single rounds before; the first value that is not NULL stays, and a round without a column is told."""
    long = spark.createDataFrame([(1, "mse", 1, None), (1, "mse", 1, 2.0), (1, "mse", 2, 3.0), (None, "mse", 2, 4.0)], "session_id long, metric string, round_number int, value double")
    pivot = R.training_result_pivot(long, ["session_id"], [1, 2, 3])
    assert rows(pivot, "session_id") == [(None, "mse", None, 4.0, None), (1, "mse", 2.0, 3.0, None)]
    assert pivot._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    with pytest.raises(Exception, match="without a column: 3"):
        R.training_result_pivot(long.withColumn("round_number", F.lit(3)), ["session_id"], [1, 2]).collect()


def test_short_slices_do_not_become_as_many_tasks(spark, tmp_path):
    """Slices of two rows: their number follows the cores, and a page still reads its places only."""
    from fedloom.operators.paging import SLICES_PER_CORE, index_pages

    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 7 END AS k")
    order = [F.desc("k"), F.asc("id")]
    index = index_pages(df, order, str(tmp_path / "p"), slice_rows=2)
    assert len(index.slices) <= SLICES_PER_CORE * spark.sparkContext.defaultParallelism and index.total == 3000
    wanted = [r["id"] for r in df.orderBy(*order).collect()]
    for skip, limit in ((0, 1), (1, 3), (90, 110), (2_990, 20), (0, 3000), (17, 0)):
        assert [r["id"] for r in index.page(skip, limit).collect()] == wanted[skip:skip + limit]


def test_pages_are_the_same_by_index_and_on_the_fly(spark, monkeypatch):
    datasets = spark.range(50).selectExpr("id AS dataset_id", "'f' AS filename", "'' AS description")
    transfers = spark.range(60).selectExpr("id", "timestamp_seconds(id % 7) AS transferredAt", "CASE WHEN id % 3 = 0 THEN current_timestamp() END AS approvedAt")
    for page, index, table in ((R.datasets_page, R.index_datasets, datasets), (R.transfers_page, R.index_transfers, transfers)):
        near = page(table, 11, 9).collect()
        assert page(index(table, slice_rows=8), 11, 9).collect() == near and len(near) == 9
        monkeypatch.setattr(R, "SHALLOW_ROWS", 5)
        assert page(table, 11, 9).collect() == near
        monkeypatch.undo()
