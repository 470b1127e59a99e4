"""Program and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import profile_numeric
from ..plans.program import preprocess
from ..session import scratch_path
from ..streaming import feeds
from . import inputs
from .cleaning import SKEWED, _fences, _inside
from .inputs import table
from .registry import query, rounded, stamp, with_

STEPS = [
    {"column": "l_orderkey", "operation": "Exclude from All Columns list"},
    {"column": "All Columns", "operation": "Fill Mean"},
    {"column": "cost", "operation": "Remove Outliers"},
    {"column": "l_quantity", "operation": "Min-Max"},
    {"column": "cost", "operation": "Z-score"},
    {"column": "squares", "operation": "Square Root"},
]


def program_input(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice * l_discount * l_tax * l_quantity AS cost", "l_extendedprice * l_extendedprice * l_discount AS squares",
    )


@query("preprocess", f"""WITH s AS ({SKEWED}), filled AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT avg(l_quantity) FROM s)) AS l_quantity) FROM s),
    f AS ({_fences(['cost'], 'filled')}), kept AS (SELECT filled.* FROM filled, f WHERE {_inside(['cost'], 1.5)})
    SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM kept)) / (SELECT max(l_quantity) - min(l_quantity) FROM kept), 6) AS l_quantity,
    round((cost - (SELECT avg(cost) FROM kept)) / (SELECT stddev_samp(cost) FROM kept), 6) + 0.0 AS cost, round(sqrt(squares), 4) AS squares FROM kept""")
def preprocess_query(spark, d):
    done, _ = preprocess(program_input(spark, d), STEPS, quantile_error=0)
    return done.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("cost", 6).alias("cost"), F.round("squares", 4).alias("squares"))


def flagship(spark, d):
    """Fill, drop outliers, scale, then profile the numbers."""
    steps = [
        {"column": "All Columns", "operation": "Fill Mean"},
        {"column": "All Columns", "operation": "Remove Outliers"},
        {"column": "l_quantity", "operation": "Min-Max"},
    ]
    done, _ = preprocess(program_input(spark, d), steps)
    return profile_numeric(done)


# --- streams -------------------------------------------------------------------------

# Micro-batches of a table that arrives, and the most rows of a file in it.
BATCHES = 4
FILE_ROWS = 1_000_000


def _stream(spark, d, name):
    """The table as a stream of ``BATCHES`` micro-batches, each of as many files as there are cores, or more of ``FILE_ROWS``."""
    whole, arriving = table(spark, d, name), scratch_path(spark, "arriving")
    each = -(-whole.count() // (BATCHES * spark.sparkContext.defaultParallelism))
    whole.write.option("maxRecordsPerFile", max(1, min(each, FILE_ROWS))).parquet(arriving)
    files = len(spark.read.schema(whole.schema).parquet(arriving).inputFiles())
    return feeds.watch(spark, arriving, whole.schema, files_per_batch=max(1, -(-files // BATCHES)))


@query("stream_ingest", "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def stream_ingest(spark, d):
    schema = table(spark, d, "events").schema
    landed = feeds.stream_ingest(spark, d, schema, scratch_path(spark, "raw"), scratch_path(spark, "state"), pattern="events.parquet")
    return landed.select("event_id", "user_id", "event_type", "value", stamp("ts"))


def _submissions(spark, d):
    return inputs.as_submissions(_stream(spark, d, "lineitem"))


def _deduplicated(spark, d, target):
    return feeds.stream_submissions_dedup(_submissions(spark, d), target, scratch_path(spark, "state"))


@query("stream_submissions_dedup", with_("submissions", "SELECT DISTINCT session_id, user_id, round_number FROM submissions"))
def stream_submissions_dedup(spark, d):
    return _deduplicated(spark, d, scratch_path(spark, "first")).select("session_id", "user_id", "round_number")


@query("stream_round_ready", with_("submissions", "clients", "sessions", """SELECT f.session_id, f.round_number FROM
    (SELECT session_id, round_number, count(DISTINCT user_id) AS received FROM submissions GROUP BY ALL) f
    JOIN (SELECT session_id, count(*) AS clients FROM clients GROUP BY ALL) c ON c.session_id = f.session_id
    JOIN sessions s ON s.id = f.session_id WHERE f.received + s.no_of_left_clients >= c.clients"""))
def stream_round_ready(spark, d):
    first = scratch_path(spark, "first")
    schema = _deduplicated(spark, d, first).schema
    arriving = feeds.watch(spark, first, schema)
    ready = feeds.stream_round_ready(arriving, inputs.clients(spark, d), inputs.sessions(spark, d), scratch_path(spark, "ready"), scratch_path(spark, "state"))
    return ready.select("session_id", "round_number")


@query("stream_stale_drop", with_("sessions", "submissions", """SELECT b.session_id, b.user_id, b.round_number, b.price FROM submissions b JOIN sessions s
    ON b.session_id = s.id AND b.round_number = s.curr_round"""))
def stream_stale_drop(spark, d):
    kept = feeds.stream_stale_drop(_submissions(spark, d), inputs.sessions(spark, d), scratch_path(spark, "current"), scratch_path(spark, "state"))
    return kept.select("session_id", "user_id", "round_number", "price")


@query("stream_notifications", with_("notifications", """SELECT id, user_id, message FROM notifications WHERE notified_at IS NULL
    AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 00:00:00')"""))
def stream_notifications(spark, d):
    arriving = inputs.as_notifications(_stream(spark, d, "events"))
    sent = feeds.stream_notifications(arriving, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), scratch_path(spark, "sent"), scratch_path(spark, "state"))
    return sent.select("id", "user_id", "message")
