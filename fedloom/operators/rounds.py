"""State of training rounds: submissions, readiness, missing clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import drop_duplicates_by
from .reports import client_counts

ROUND = ["session_id", "user_id", "round_number"]
MIN_CLIENTS = 2


def first_submission_wins(submissions: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Earliest submission per (session, user, round)."""
    return drop_duplicates_by(submissions, ROUND, order)


def stale_round_filter(submissions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Submissions for the session's current round; others are ignored."""
    current = sessions.select(F.col("id").alias("session_id"), F.col("curr_round").alias("round_number"))
    return submissions.join(current, ["session_id", "round_number"])


def round_readiness(submissions: DataFrame, clients: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session and round: received, registered and left clients, and whether all are accounted for."""
    received = submissions.groupBy("session_id", "round_number").agg(F.count(F.lit(1)).alias("received"))
    state = sessions.select(F.col("id").alias("session_id"), F.col("no_of_left_clients").cast("long").alias("left_clients"))
    return (
        received.join(client_counts(clients), "session_id", "left").join(state, "session_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("clients", "left_clients")})
        .withColumn("ready", F.col("clients") == F.col("received") + F.col("left_clients"))
    )


def missing_clients(clients: DataFrame, sessions: DataFrame, submissions: DataFrame) -> DataFrame:
    """Registered clients without a submission in the session's current round."""
    current = sessions.select(F.col("id").alias("session_id"), F.col("curr_round").alias("round_number"))
    expected = clients.select("session_id", "user_id").join(current, "session_id")
    return expected.join(submissions.select(*ROUND), ROUND, "left_anti")


def sessions_startable(sessions: DataFrame, clients: DataFrame, minimum: int = MIN_CLIENTS) -> DataFrame:
    """Sessions accepting clients that have more than ``minimum`` of them."""
    waiting = sessions.filter(F.col("training_status") == "ACCEPTING_CLIENTS").select(F.col("id").alias("session_id"), "training_status")
    return waiting.join(client_counts(clients), "session_id").filter(F.col("clients") > minimum)
