"""From requests to responses: decode, hold against the contract, decide, number, page, encode."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import delete_row, json_object, json_string, put_row
from ..sources import wire as W
from ..sources.stored import stored
from .contract import Contract
from .decide import CONFLICTS, NEW
from .normalize import normalize, rejection
from .requests import FUTURE, decide_requests
from .validate import ENTRIES, PROPOSALS

ENTRY = ("stream_id", "sequence", "operation_id", "client_id", "client_sequence", "intent_hash", "operation")
DECISION = ("stream_id", "operation_id", "client_id", "client_sequence", "intent_hash", "status", "sequence", "operation", "reason")


class Synchronized(NamedTuple):
    """What a batch of requests comes to: ``answers`` (``request_id, http_status, code, envelope``, one a request), and the
    ``entries`` and ``decisions`` to append."""

    answers: DataFrame
    entries: DataFrame
    decisions: DataFrame


def synchronize(requests: DataFrame, log: DataFrame, decisions: DataFrame, contract: Contract, most: int = PROPOSALS, page: int = ENTRIES) -> Synchronized:
    """Answer a batch of requests (``request_id``, unique and not null; ``request_ord``, total; ``envelope``, text) against a log
    (``ENTRY`` columns) and decisions (``DECISION`` columns, ``operation`` and ``reason`` JSON), in the order of the requests.

    An envelope that breaks a rule, a base beyond the stream's head before the batch, and a conflict each refuse
    their request: it has a status of 400 or 409, the ``code``, no envelope, and leaves no trace.  Proposals are row operations, held
    against the ``contract``; one that it doesn't allow is rejected, which is a decision.  A response has the decisions
    on its proposals and the entries after its base, as the log is right after that request."""
    checked = stored(W.request_errors(requests.select("request_id", "request_ord", "envelope"), most))
    good = checked.where("code is null").select("request_id", "request_ord", "envelope")
    decoded = stored(W.decode_requests(good))
    heads = stored(log.groupBy("stream_id").agg(F.max("sequence").alias("head_sequence")))
    asked = decoded.groupBy("request_id").agg(*(F.first(c).alias(c) for c in ("request_ord", "stream_id", "base_sequence", "maximum_entries")))
    # The contract decides on each proposal by itself.
    judged = normalize(decoded.where("operation_id is not null").drop("envelope", "error"), contract)
    told = rejection(F.col("error"))
    why = F.when(told.isNotNull(), json_object({"code": json_string(told["code"]), "message": json_string(told["message"])}))
    operation = F.when(F.col("op") == "putRow", put_row(F.col("table_name"), F.col("body"))).otherwise(delete_row(F.col("table_name"), F.col("body")))
    batch = stored(judged.withColumns({"why": why, "operation": operation}).drop("error", "body", "op", "table_name"))
    decided = stored(decide_requests(batch, decisions, F.col("why"), heads))
    first_bad = F.min_by("class", "proposal_ord")
    refused = decided.where(F.col("class").isin(*CONFLICTS, FUTURE)).groupBy("request_id").agg(first_bad.alias("conflict"))
    late = asked.join(heads, "stream_id", "left").where(F.col("base_sequence") > F.coalesce("head_sequence", F.lit(0))).select("request_id", F.lit(FUTURE).alias("late"))
    fate = asked.join(refused, "request_id", "left").join(late, "request_id", "left").withColumn("code", F.coalesce("late", "conflict")).drop("late", "conflict")
    fate = stored(fate)
    made = decided.where(F.col("class") == NEW)
    entries = stored(made.where("status = 'accepted'").select(*ENTRY))
    # The head after each request is that of the last entry made by it or before it.
    own = made.groupBy("request_id").agg(F.max("sequence").alias("last"))
    so_far = F.max("last").over(Window.partitionBy("stream_id").orderBy("request_ord"))
    open_ = fate.where("code is null").join(own, "request_id", "left").join(heads, "stream_id", "left")
    open_ = open_.withColumn("head", F.greatest(so_far, F.coalesce("head_sequence", F.lit(0))))
    through = F.least("head", F.col("base_sequence") + F.least("maximum_entries", F.lit(page)))
    pages = stored(open_.select("request_id", "stream_id", "base_sequence", F.col("head").alias("head_sequence"), through.alias("through_sequence")))
    # A page lies in two parts of the log at most.
    part = lambda c: F.floor((c - 1) / page)
    span = pages.where("through_sequence > base_sequence").select(
        "request_id", "stream_id", "base_sequence", "through_sequence", F.explode(F.sequence(part(F.col("base_sequence") + 1), part(F.col("through_sequence")))).alias("part")
    )
    every = log.select(*ENTRY).unionByName(entries).withColumn("part", part(F.col("sequence")))
    held = every.join(span, ["stream_id", "part"]).where("sequence > base_sequence and sequence <= through_sequence")
    # Decisions on proposals: new ones and repeats carry what was made now, replays what is stored.
    kept = decisions.select(F.col("stream_id").alias("s"), F.col("operation_id").alias("o"), F.col("operation").alias("was"), F.col("reason").alias("because"))
    answered = decided.join(pages.select("request_id"), "request_id", "left_semi").join(kept, (F.col("stream_id") == F.col("s")) & (F.col("operation_id") == F.col("o")), "left")
    lists = answered.select(
        "request_id", "stream_id", "proposal_ord", "operation_id", "status", "sequence",
        F.coalesce("was", "operation").alias("operation"), F.coalesce("because", "reason").alias("reason"),
    )
    as_page = lambda df: df.withColumn("page", F.col("request_id"))
    sent = W.encode_responses(as_page(pages), as_page(held), as_page(lists).withColumn("decision_ord", F.col("proposal_ord")))
    codes = checked.select("request_id", F.col("code").alias("broken")).join(fate.select("request_id", "code"), "request_id", "left")
    code = F.coalesce("broken", "code")
    status = F.when(code.isNull(), 200).when(code.isin(*CONFLICTS, FUTURE), 409).otherwise(400)
    answers = codes.select("request_id", status.alias("http_status"), code.alias("code")).join(sent.select(F.col("page").alias("request_id"), "envelope"), "request_id", "left")
    new = made.select(*(F.when(F.col("status") == "accepted", F.col(c)).alias(c) if c == "operation" else F.col(c) for c in DECISION))
    return Synchronized(answers, entries, new)
