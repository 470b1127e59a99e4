import datetime as dt
import json
import shutil
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fedloom.operators import rounds
from fedloom.operators.profile import profile
from fedloom.sources import tables, versions
from fedloom.streaming import feeds

T0 = dt.datetime(2024, 3, 1)


def test_ingest_csv(spark, tmp_path):
    source = tmp_path / "rain.csv"
    source.write_text("city,mm,when\nA,1.5,2024-01-01\nB,,2024-01-02\n")
    report, landed = tables.ingest_dataset(spark, str(source), "csv", str(tmp_path / "raw"))
    assert landed.endswith("/raw/rain.parquet")
    got = {r["name"]: r for r in report.collect()}
    assert got["mm"]["null_count"] == 1 and got["mm"]["type"] == "double"
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, str(source), "xlsx")


def test_publishing_gives_fresh_names(spark, tmp_path):
    names = {tables.publish_processed(spark.range(3).toDF("x"), "rain", str(tmp_path))[1] for _ in range(2)}
    assert len(names) == 2 and all(n.startswith("rain_") and n.endswith(".parquet") for n in names)


def test_merge(spark, tmp_path):
    left, right = spark.createDataFrame([(1, "a")], "x int, s string"), spark.createDataFrame([("n", 2)], "t string, x int")
    assert rows(tables.merge_datasets(left, right), "x") == [(1, "a", None), (2, None, "n")]
    with pytest.raises(ValueError, match="empty"):
        tables.merge_datasets(left, right.limit(0))
    parent, extra = str(tmp_path / "p.parquet"), str(tmp_path / "e.parquet")
    left.write.parquet(parent)
    right.write.parquet(extra)
    with pytest.raises(ValueError, match="empty"):
        tables.merge_swap(spark, parent, _written(left.limit(0), tmp_path / "none.parquet"))
    assert tables.merge_swap(spark, _written(left, tmp_path / "q.parquet"), extra).count() == 3
    for size in (2, 3):
        report = {r["name"]: r["entries"] for r in tables.merge_swap(spark, parent, extra, str(tmp_path / "staging")).collect()}
        assert report == {"x": size, "s": size, "t": size}
        assert spark.read.parquet(parent).count() == size
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["e.parquet", "none.parquet", "p.parquet", "q.parquet", "staging"]


def _written(df, path):
    df.write.parquet(str(path))
    return str(path)


def test_inventory(spark, tmp_path):
    deep = tmp_path / "two.parquet" / tmp_path.name
    deep.mkdir(parents=True)
    (tmp_path / "one.csv").write_text("x" * 2048)
    (tmp_path / "two.parquet" / "a").write_text("y" * 10)
    (deep / "b").write_text("y" * 5)
    got = rows(tables.storage_inventory(spark, str(tmp_path)), "dataset")
    assert got == [("one.csv", "FILE", 2048, 1, "2.00 KB"), ("two.parquet", "DIRECTORY", 15, 2, "15.00 B")]


def test_export_features(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert tables.export_features(df, ["b", "a"], ["y"], str(tmp_path / "f")).columns == ["b", "a", "y"]
    with pytest.raises(ValueError, match="not found"):
        tables.export_features(df, ["a"], ["z"])


def test_client_parameter_files(spark, tmp_path):
    for client, number in ((7, 1), (8, 2), (9, 2)):
        (tmp_path / f"{client}.json").write_text(json.dumps({"w": [[client]]}))
        (tmp_path / f"{client}_metadata.json").write_text(json.dumps({"submission_time": "t", "user_id": client, "round_number": number}))
    got = rows(tables.read_client_params(spark, str(tmp_path), 2), "client_id")
    assert [(r[0], r[1], json.loads(r[3])) for r in got] == [(8, 2, {"w": [[8]]}), (9, 2, {"w": [[9]]})]
    assert tables.read_client_params(spark, str(tmp_path)).count() == 3


# --- streams ----------------------------------------------------------------------------

def test_ingest_stream_lands_each_finished_file_once(spark, tmp_path):
    uploads, raw, state = tmp_path / "up", str(tmp_path / "raw"), str(tmp_path / "state")
    uploads.mkdir()
    (uploads / "a.csv").write_text("x\n1\n2\n")
    (uploads / "b.csv._COPYING_").write_text("x\n3\n")
    (uploads / "c.csv__PROCESSING__").write_text("x\n4\n")
    (uploads / "d.csv__PROCESSING__x").mkdir()
    schema = spark.createDataFrame([], "x int").schema

    def run():
        return sorted(r["x"] for r in feeds.stream_ingest(spark, str(uploads), schema, raw, state, "csv").collect())

    assert run() == [1, 2]
    assert run() == [1, 2]
    shutil.copy(uploads / "c.csv__PROCESSING__", uploads / "c.csv")
    assert run() == [1, 2, 4]


SUBMISSION = "session_id int, user_id int, round_number int, createdAt timestamp"


def arrive(spark, folder, *batch):
    spark.createDataFrame(list(batch), SUBMISSION).coalesce(1).write.mode("append").parquet(str(folder))


def submissions(spark, folder):
    return feeds.watch(spark, str(folder), spark.createDataFrame([], SUBMISSION).schema)


def test_later_duplicates_are_rejected_across_restarts(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, folder, (1, 10, 1, T0), (1, 11, 1, T0))
    first = feeds.stream_submissions_dedup(submissions(spark, folder), out, state)
    assert first.count() == 2
    arrive(spark, folder, (1, 10, 1, T0 + dt.timedelta(hours=1)), (1, 10, 2, T0 + dt.timedelta(hours=1)))
    again = feeds.stream_submissions_dedup(submissions(spark, folder), out, state)
    assert rows(again.select("session_id", "user_id", "round_number", "createdAt"), "round_number", "user_id") == [
        (1, 10, 1, T0), (1, 11, 1, T0), (1, 10, 2, T0 + dt.timedelta(hours=1)),
    ]


def test_rounds_get_ready_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    clients = spark.createDataFrame([(u, 1) for u in (10, 11, 12)] + [(10, 2)], "user_id int, session_id int")
    sessions = spark.createDataFrame([(1, 1), (2, 0)], "id int, no_of_left_clients int")

    def run():
        return rows(feeds.stream_round_ready(submissions(spark, folder), clients, sessions, out, state), "session_id", "round_number")

    arrive(spark, folder, (1, 10, 1, T0), (2, 10, 1, T0))
    assert run() == [(2, 1, 0)]
    arrive(spark, folder, (1, 11, 1, T0))
    assert run() == [(1, 1, 1), (2, 1, 0)]
    arrive(spark, folder, (1, 12, 1, T0), (1, 10, 2, T0))
    assert run() == [(1, 1, 1), (2, 1, 0)]
    batch = spark.read.parquet(str(folder))
    state_now = rounds.round_readiness(batch, clients, sessions)
    assert state_now.filter("received + left_clients >= clients").count() == 2


def test_stale_events_are_dropped(spark, tmp_path):
    arrive(spark, tmp_path / "in", (1, 10, 1, T0), (1, 10, 2, T0), (2, 10, 1, T0))
    sessions = spark.createDataFrame([(1, 2), (2, 1)], "id int, curr_round int")
    kept = feeds.stream_stale_drop(submissions(spark, tmp_path / "in"), sessions, str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(kept.select("session_id", "round_number")) == [(1, 2), (2, 1)]


def test_notifications_are_delivered_once(spark, tmp_path):
    ddl = "id int, user_id int, notified_at timestamp, valid_until timestamp"
    day = dt.timedelta(days=1)
    spark.createDataFrame([(1, 5, None, T0 + day), (2, 5, None, T0 - day), (3, 5, T0, None), (4, 5, None, None)], ddl).write.parquet(str(tmp_path / "in"))

    def run():
        stream = feeds.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], ddl).schema)
        sent = feeds.stream_notifications(stream, F.lit(T0), str(tmp_path / "out"), str(tmp_path / "state"))
        return rows(sent.select("id", "notified_at"), "id")

    assert run() == [(1, T0), (4, T0)]
    assert run() == [(1, T0), (4, T0)]


def test_late_firsts_and_old_repeats(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    year = dt.timedelta(days=365)
    for batch in (
        [(1, 10, 1, T0)], [(2, 10, 1, T0 + year)], [(9, 10, 1, T0 - year), (8, 10, 1, T0 - year)],
        [(1, 10, 1, T0 + year), (3, 10, 1, T0)], [(3, 10, 1, T0 - year), (9, 10, 1, T0 + 2 * year)],
    ):
        arrive(spark, folder, *batch)
    stream = feeds.watch(spark, str(folder), spark.createDataFrame([], SUBMISSION).schema, files_per_batch=1)
    got = feeds.stream_submissions_dedup(stream, out, state)
    assert rows(got.select("session_id", "createdAt"), "session_id") == [(1, T0), (2, T0 + year), (3, T0), (8, T0 - year), (9, T0 - year)]


def test_notifications_that_come_again(spark, tmp_path):
    ddl = "id int, user_id int, notified_at timestamp, valid_until timestamp"
    for _ in range(2):
        spark.createDataFrame([(7, 5, None, None)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], ddl).schema, files_per_batch=1)
    assert rows(feeds.stream_notifications(stream, F.lit(T0), str(tmp_path / "out"), str(tmp_path / "state")).select("id")) == [(7,)]


def test_inventory_counts_hidden_files_and_empty_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "_SUCCESS").write_bytes(b"xy")
    (tmp_path / "a" / ".part").write_bytes(b"z")
    (tmp_path / "empty").mkdir()
    got = tables.storage_inventory(spark, str(tmp_path))
    assert rows(got.select("dataset", "type", "bytes", "files"), "dataset") == [("a", "DIRECTORY", 3, 2), ("empty", "DIRECTORY", 0, 0)]


def test_client_files_of_two_sessions(spark, tmp_path):
    for session in ("s1", "s2"):
        (tmp_path / session).mkdir()
        (tmp_path / session / "5.json").write_text(f'{{"w": "{session}"}}')
        (tmp_path / session / "5_metadata.json").write_text(f'{{"submission_time": "{session}", "user_id": 5, "round_number": 1}}')
    got = tables.read_client_params(spark, str(tmp_path))
    assert rows(got.select("session_id", "client_id", "submission_time", "parameters"), "session_id") == [
        ("s1", 5, "s1", '{"w": "s1"}'), ("s2", 5, "s2", '{"w": "s2"}'),
    ]
    (tmp_path / "s1" / "x.json").write_text("{}")
    with pytest.raises(Exception, match="no client number"):
        tables.read_client_params(spark, str(tmp_path)).collect()


def test_client_files_are_written_by_tasks(spark, tmp_path):
    """Files of clients in the folders of their sessions; two documents of one client are two lines of one file."""
    found = [(s, c, json.dumps({"w": [c]}), json.dumps({"submission_time": s, "user_id": c, "round_number": 1 + c % 2})) for s in ("a", "b") for c in range(40)]
    documents = spark.createDataFrame([*found, found[0]], "session_id string, client_id long, parameters string, metadata string")
    root = str(tmp_path / "written")
    tables.write_client_files(documents.repartition(5), root)
    assert {p.name for p in (tmp_path / "written" / "a" / tables.SUBMITTED).iterdir()} == {f"{c}{end}.json" for c in range(40) for end in ("", "_metadata")}
    assert len((tmp_path / "written" / "a" / tables.SUBMITTED / "0.json").read_text().splitlines()) == 2
    got = tables.read_client_params(spark, root, 2)
    assert rows(got.select("session_id", "client_id", "submission_time"), "session_id", "client_id") == [(s, c, s) for s in ("a", "b") for c in range(1, 40, 2)]


def test_an_arriving_table_is_files_for_all_tasks(spark, tmp_path, monkeypatch):
    """Four micro-batches of files that hold no more than so many rows, however long the table."""
    from fedloom.catalog import flows

    monkeypatch.setattr(flows, "FILE_ROWS", 100)
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    target, state = str(tmp_path / "out"), tmp_path / "state"
    feeds.land(flows._stream(spark, str(tmp_path), "t").select("id", F.col("_metadata.file_path").alias("file")), target, str(state))
    landed = spark.read.parquet(target)
    assert rows(landed.select("id")) == [(i,) for i in range(10_000)]
    assert landed.groupBy("file").count().agg(F.max("count")).first()[0] <= 100
    assert len([p for p in (state / "commits").iterdir() if not p.name.startswith(".")]) == flows.BATCHES


def test_the_state_holds_each_column_once(spark, tmp_path):
    """What is stored for every key for good is its row, without the order's columns beside it."""
    keys = ["session_id", "user_id", "round_number"]
    state, _ = feeds._first_arrivals(submissions(spark, tmp_path), keys, ["createdAt"])
    assert state.columns == [*keys, "_first", "_last", "_row"] and state.schema["_row"].dataType.names == ["_n0", "createdAt"]


def test_batches_do_not_read_what_has_landed(spark, tmp_path):
    """Landed rows can be moved away: what has come before is known from the state alone."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, folder, (1, 10, 1, T0), (None, 11, 1, T0))
    assert feeds.stream_submissions_dedup(submissions(spark, folder), out, state).count() == 2
    (tmp_path / "out").rename(tmp_path / "archive")
    later = T0 + dt.timedelta(hours=1)
    arrive(spark, folder, (1, 10, 1, later), (None, 11, 1, later), (2, 10, 1, None), (2, 10, 1, later), (2, 10, 1, T0))
    again = feeds.stream_submissions_dedup(submissions(spark, folder), out, state)
    assert rows(again.select("session_id", "createdAt")) == [(2, T0)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_rounds_stay_reported_when_more_arrives(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    clients = spark.createDataFrame([(u, s) for u in (10, 11) for s in (1, 2)], "user_id int, session_id int")
    sessions = spark.createDataFrame([(1, 0), (2, 0)], "id int, no_of_left_clients int")
    run = lambda: rows(feeds.stream_round_ready(submissions(spark, folder), clients, sessions, out, state), "session_id")
    arrive(spark, folder, (1, 10, 1, T0), (1, 11, 1, T0), (2, 10, 1, T0))
    assert run() == [(1, 1, 0)]
    arrive(spark, folder, (1, 12, 1, T0), (1, 13, 1, T0))
    assert run() == [(1, 1, 0)]
    arrive(spark, folder, (1, 14, 1, T0), (2, 11, 1, T0))
    assert run() == [(1, 1, 0), (2, 1, 2)]


def test_versions_merge_and_stay_readable(spark, tmp_path):
    dataset = str(tmp_path / "d")
    versions.create(spark, dataset, spark.range(100).selectExpr("id", "CAST(id AS STRING) AS s"))
    stop, seen, failed = threading.Event(), [], []

    def look():
        while not stop.is_set():
            try:
                seen.append(versions.read(spark, dataset).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(1, 4):
        report = versions.merge(spark, dataset, spark.range(10 * i).selectExpr("id", "id / 2 AS half", "'x' AS s"))
    stop.set()
    reader.join()
    assert not failed and seen == sorted(seen) and set(seen) <= {100, 110, 130, 160}
    whole = versions.read(spark, dataset)
    assert whole.columns == ["id", "s", "half"] and whole.where("half IS NULL").count() == 100
    got = {r["name"]: r for r in report.collect()}
    wanted = {r["name"]: r for r in profile(whole, relative_error=0).collect()}
    for c in whole.columns:
        assert {k: got[c][k] for k in ("type", "entries", "null_count", "unique_count", "min", "max", "hist_counts", "median")} == {k: wanted[c][k] for k in ("type", "entries", "null_count", "unique_count", "min", "max", "hist_counts", "median")}
        assert got[c]["mean"] == pytest.approx(wanted[c]["mean"]) and got[c]["stddev"] == pytest.approx(wanted[c]["stddev"])
    with pytest.raises(ValueError, match="empty"):
        versions.merge(spark, dataset, spark.range(0).toDF("id"))
    with pytest.raises(ValueError, match="already"):
        versions.create(spark, dataset, spark.range(1))
    with pytest.raises(ValueError, match="no dataset"):
        versions.read(spark, str(tmp_path / "none"))


def test_versions_widen_compact_and_vacuum(spark, tmp_path):
    dataset = str(tmp_path / "d")
    versions.create(spark, dataset, spark.createDataFrame([(1, 2)], "a int, b int"))
    before = versions.read(spark, dataset)
    versions.merge(spark, dataset, spark.createDataFrame([(3,)], "a int"))
    assert len(versions.newest(spark, dataset)["parts"]) == 2
    report = {r["name"]: r["type"] for r in versions.merge(spark, dataset, spark.createDataFrame([(2.5, "t")], "a double, c string")).collect()}
    assert report == {"a": "double", "b": "int", "c": "string"}
    assert rows(versions.read(spark, dataset), "a") == [(1.0, 2, None), (2.5, None, "t"), (3.0, None, None)]
    versions.merge(spark, dataset, spark.createDataFrame([(9,)], "b int"))
    versions.compact(spark, dataset)
    assert len(versions.newest(spark, dataset)["parts"]) == 1 and versions.read(spark, dataset).count() == 4
    assert before.count() == 1
    assert versions.vacuum(spark, dataset, kept=1) and versions.read(spark, dataset).count() == 4
    assert versions.profile_of(spark, dataset).where("name = 'b'").first()["entries"] == 4
    with pytest.raises(OSError, match="exists already"):
        versions._publish(spark, dataset, versions.newest(spark, dataset))
