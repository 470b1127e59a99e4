"""File-based streams: landing, first submissions, round readiness, notifications.

Every stream runs with ``availableNow``: it works off what has arrived, bounded
per micro-batch by ``maxFilesPerTrigger``, and goes on from its checkpoint the
next time.  Results written per batch go to a folder of that batch, which a
repeated batch overwrites, so a restart never doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import q
from ..session import materialize

# Marks in the name of a file that is still being written.
IN_PROGRESS = r"(_COPYING_|__PROCESSING__)(/|$)"
FILES_PER_BATCH = 1000
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # without a number of all keys, a new value is put without another look-up of its key
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def watch(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
          files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of the files below a folder; each file is read once."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def land(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append a stream to a Parquet folder, exactly once per input row."""
    _finish(
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_ingest(spark: SparkSession, uploads: str, schema: T.StructType, raw_dir: str, checkpoint: str,
                  fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    """Land new files in the raw zone.

    A file still being written does not end in ``.parquet`` or ``.csv``, so the
    name pattern leaves it out unread; folders marked as in progress are left
    out by their path.  Both come in under their final name later.
    """
    arrived = watch(spark, uploads, schema, fmt, pattern or f"*.{fmt}")
    finished = arrived.filter(~F.col("_metadata.file_path").rlike(IN_PROGRESS))
    land(finished.select(*[q(c) for c in arrived.columns]), raw_dir, checkpoint)
    return spark.read.schema(schema).parquet(raw_dir)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside lives in RocksDB, which spills to disk and checkpoints its changes only."""
    before = {name: spark.conf.get(name, None) for name in KEYED_STATE}
    for name, value in KEYED_STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _per_batch(stream: DataFrame, target: str, checkpoint: str, mode: str, prepare: Callable[[DataFrame, int], DataFrame]) -> None:
    """Write ``prepare(batch, number)`` to the batch's own folder below ``target``."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch, number).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    with _keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _finish(query)


def _landed(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """What all batches have written, with its ``batch``; an empty first folder lets it be read from the start."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch=-1")
    known = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(known).parquet(target)


def _first_arrivals(stream: DataFrame, keys: Sequence[str], nulls_last: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """A keyed state over the stream, and what gives a batch's rows whose key, NULLs included, has not come before.

    The state of a key is the first and the last batch it came in, told by the batch's time, and its least row: by the
    columns ``nulls_last``, then the others as they stand.  A batch puts out the keys it touches; a key is new where
    both times are one.  So a batch costs what it touches, not what has come before, and nothing expires.  The row
    holds each column once, as it is stored for good.
    """
    others = [*nulls_last, *[c for c in stream.columns if c not in keys and c not in nulls_last]]
    row = F.struct(*[q(c).isNull().alias(f"_n{i}") for i, c in enumerate(nulls_last)], *[q(c) for c in others])
    timed = stream.select("*", F.current_timestamp().alias("_arrived"))
    state = timed.groupBy(*[q(k) for k in keys]).agg(F.min("_arrived").alias("_first"), F.max("_arrived").alias("_last"), F.min(row).alias("_row"))
    columns = [q(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in stream.columns]
    return state, lambda batch: batch.filter(F.col("_first") == F.col("_last")).select(*columns)


def stream_submissions_dedup(stream: DataFrame, target: str, checkpoint: str, time: str = "createdAt",
                             keys: Sequence[str] = ("session_id", "user_id", "round_number")) -> DataFrame:
    """First arrival per key, without a time limit; later ones are rejected.

    Of a batch's rows with a new key the earliest is taken (a NULL time comes last).  Keys seen are a keyed state
    without expiry, so a late first submission is taken and a repeat after months is not.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    state, new = _first_arrivals(timed, keys, [time])
    _per_batch(state, target, checkpoint, "update", lambda batch, number: new(batch))
    return _landed(stream.sparkSession, target, timed.schema).drop("batch")


def stream_round_ready(submissions: DataFrame, clients: DataFrame, sessions: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """(session, round) pairs for which received plus left clients reach the registered ones.

    ``submissions`` is a stream without duplicates.  One keyed state counts each pair and puts out the pairs a batch
    touches; those that have reached their clients go on to a second one, which passes each pair once, from its first
    batch.  Both cost what a batch touches.
    """
    # one row per session, computed once for all batches of this run
    expected = materialize(clients.groupBy("session_id").agg(F.count(F.lit(1)).alias("clients")).join(
        sessions.select(F.col("id").alias("session_id"), F.col("no_of_left_clients").cast("long").alias("left_clients")), "session_id"
    ))
    spark, pair, base, states = submissions.sparkSession, ["session_id", "round_number"], target.rstrip("/"), checkpoint.rstrip("/")
    counts = submissions.groupBy(*pair).agg(F.count(F.lit(1)).alias("received"))

    def reached(batch: DataFrame, number: int) -> DataFrame:
        known = batch.join(expected, "session_id").filter(F.col("received") + F.col("left_clients") >= F.col("clients"))
        return known.select(*pair, F.lit(number).cast("long").alias("since"))

    _per_batch(counts, f"{base}/reached", f"{states}/counts", "update", reached)
    kinds = T.StructType([*[submissions.schema[c] for c in pair], T.StructField("since", T.LongType())])
    _landed(spark, f"{base}/reached", kinds)
    state, new = _first_arrivals(watch(spark, f"{base}/reached", kinds), pair)
    _per_batch(state, f"{base}/ready", f"{states}/ready", "update", lambda batch, number: new(batch))
    return _landed(spark, f"{base}/ready", kinds).select(*pair, F.col("since").cast("int").alias("batch"))


def stream_stale_drop(submissions: DataFrame, sessions: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Events of another than the session's current round are dropped."""
    current = sessions.select(F.col("id").alias("session_id"), F.col("curr_round").alias("round_number"))
    land(submissions.join(current, ["session_id", "round_number"]), target, checkpoint)
    return submissions.sparkSession.read.parquet(target)


def stream_notifications(notifications: DataFrame, now: Column, target: str, checkpoint: str) -> DataFrame:
    """Each open and unexpired notification, delivered once over all batches, with its delivery time."""
    live = notifications.filter(F.col("notified_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))
    marked = live.withColumn("notified_at", now)
    state, new = _first_arrivals(marked, ["id"])
    _per_batch(state, target, checkpoint, "update", lambda batch, number: new(batch))
    return _landed(notifications.sparkSession, target, marked.schema).drop("batch")
