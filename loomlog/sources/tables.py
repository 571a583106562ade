"""The given tables, and proposals, logs and replicas derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import fingerprint, json_integer, json_object, json_string, put_row
from ..operators import decide as D
from ..operators.numbering import number_balanced
from ..operators.pages import heads
from .stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proposals(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    """Events as proposals: a stream for each tenth of the users, a client for each
    user.  Events of type ``error`` delete the user's row, others put it; every 17th
    lacks a required column.  Without ``positions`` they have no ``client_sequence``,
    which takes a numbering that not every query needs."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    if positions:
        rows = number_balanced(rows, ["user_id"], ["ts", "event_id"], "client_sequence")
    put = F.col("event_type") != "error"
    col_type = F.when(F.col("event_id") % 17 != 0, F.col("event_type"))
    row = json_object({"event_type": json_string(col_type), "user_id": json_integer(F.col("user_id"))})
    return rows.select(
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("stream_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"),
        *(["client_sequence"] if positions else []),
        F.concat(F.lit("op-"), F.col("event_id").cast("string")).alias("operation_id"),
        "ts",
        "event_id",
        "user_id",
        "event_type",
        col_type.alias("col_type"),
        F.when(put, "putRow").otherwise("deleteRow").alias("op"),
        F.lit("user_state").alias("table_name"),
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")).alias("pk"),
        fingerprint(put_row(F.lit("user_state"), row)).alias("intent_hash"),
    )


def reason() -> Column:
    """Why a proposal of ``proposals`` is rejected; null where it is accepted."""
    bad = (F.col("op") == "putRow") & F.col("col_type").isNull()
    return F.when(bad, "invalid-row-operation")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(proposals(spark, sf_dir), reason(), ["ts", "event_id"])


def log(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    judged = proposals(spark, sf_dir, positions).withColumn("reason", reason())
    return D.accept(judged, ["ts", "event_id"])


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log``, written once: for what reads it several times."""
    return stored(log(spark, sf_dir))


def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(decisions(spark, sf_dir))


def stored_replicas(entries: DataFrame) -> DataFrame:
    """``replicas``, written once: for what derives several tables from them."""
    return stored(replicas(entries))


def replicas(entries: DataFrame) -> DataFrame:
    """A replica of every client, which has confirmed six tenths of its stream's log."""
    confirmed = F.floor(F.col("head_sequence") * 6 / 10).cast("long")
    last = entries.groupBy("stream_id", "client_id").agg((F.max("client_sequence") + 1).alias("next_client_sequence"))
    return last.join(heads(entries), "stream_id").select(
        "stream_id", "client_id", "next_client_sequence", "head_sequence", confirmed.alias("confirmed_sequence")
    )


def outbox(entries: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Each replica's own operations beyond what it has confirmed: even events pending,
    odd ones accepted.  ``of`` are the log's ``replicas``, where they are at hand."""
    at = (replicas(entries) if of is None else of).select("stream_id", "client_id", "confirmed_sequence")
    return (
        entries.join(at, ["stream_id", "client_id"])
        .where(F.col("sequence") > F.col("confirmed_sequence"))
        .withColumn("status", F.when(F.col("event_id") % 2 == 0, "pending").otherwise("accepted"))
    )
