"""Decide proposals: replay, refuse, or accept and number.

A decision is permanent.  A proposal whose operation id was decided before gets that
decision again if client position and intent agree; a position that another operation
holds is a conflict; the others are decided anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_balanced

REPLAY, IDENTITY, INTENT, POSITION, NEW, REPEAT, ABORTED = (
    "replay",
    "operation-identity-conflict",
    "operation-intent-conflict",
    "client-sequence-conflict",
    "new",
    "repeat",
    "aborted",
)
CONFLICTS = (IDENTITY, INTENT, POSITION)


def classify(proposals: DataFrame, decisions: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """``proposals`` with ``class`` and, for replays, the stored ``status`` and
    ``sequence``.  Operation ids and client positions are unique among the decisions of
    a stream, so both joins keep one row a proposal.  ``positions`` (``stream_id, client_id, client_sequence,
    operation_id``) are those that the decisions hold, where these are kept apart."""
    by_id = decisions.select(
        F.col("stream_id").alias("__s"),
        F.col("operation_id").alias("__op"),
        F.col("client_id").alias("__client"),
        F.col("client_sequence").alias("__position"),
        F.col("intent_hash").alias("__hash"),
        F.col("status").alias("status"),
        F.col("sequence").alias("sequence"),
    )
    by_position = (decisions if positions is None else positions).select(
        F.col("stream_id").alias("__s2"),
        F.col("client_id").alias("__client2"),
        F.col("client_sequence").alias("__position2"),
        F.col("operation_id").alias("__other"),
    )
    same = (F.col("client_id") == F.col("__client")) & (F.col("client_sequence") == F.col("__position"))
    kind = (
        F.when(F.col("__op").isNotNull() & ~same, IDENTITY)
        .when(F.col("__op").isNotNull() & (F.col("intent_hash") != F.col("__hash")), INTENT)
        .when(F.col("__op").isNotNull(), REPLAY)
        .when(F.col("__other").isNotNull(), POSITION)
        .otherwise(NEW)
    )
    kept = proposals.columns
    return (
        proposals.join(by_id, (F.col("stream_id") == F.col("__s")) & (F.col("operation_id") == F.col("__op")), "left")
        .join(
            by_position,
            (F.col("stream_id") == F.col("__s2"))
            & (F.col("client_id") == F.col("__client2"))
            & (F.col("client_sequence") == F.col("__position2")),
            "left",
        )
        .withColumn("class", kind)
        .select(*kept, "class", *(F.when(F.col("class") == REPLAY, F.col(c)).alias(c) for c in ("status", "sequence")))
    )


def settle(batch: DataFrame, decisions: DataFrame, order: list[str], request: str | None = None) -> DataFrame:
    """As ``classify``, and the proposals of a batch against one another in its order: an
    operation id or a client position that an earlier new proposal names is taken, even
    where that one is refused in the end.  What agrees with it is a ``repeat``, to which its decision
    applies; what doesn't is a conflict of the same kinds.  So no id and no position is given twice.

    With ``request``, a column, a stream's request with a conflict is refused as a whole: its
    other proposals, but for replays, are ``aborted``.  ``order`` must be total."""
    found = classify(batch, decisions)
    by_id = Window.partitionBy("class", "stream_id", "operation_id").orderBy(*order)
    by_position = Window.partitionBy("class", "stream_id", "client_id", "client_sequence").orderBy(*order)
    same = (F.first("client_id").over(by_id) == F.col("client_id")) & (F.first("client_sequence").over(by_id) == F.col("client_sequence"))
    kind = (
        F.when(F.col("class") != NEW, F.col("class"))
        .when(~same, IDENTITY)
        .when(F.first("intent_hash").over(by_id) != F.col("intent_hash"), INTENT)
        .when(F.row_number().over(by_id) > 1, REPEAT)
        .when(F.first("operation_id").over(by_position) != F.col("operation_id"), POSITION)
        .otherwise(NEW)
    )
    settled = found.withColumn("__kind", kind).drop("class").withColumnRenamed("__kind", "class")
    if request is not None:
        refused = F.max(F.col("class").isin(*CONFLICTS)).over(Window.partitionBy("stream_id", request))
        settled = settled.withColumn("class", F.when(refused & F.col("class").isin(NEW, REPEAT), ABORTED).otherwise(F.col("class")))
    return settled.select(*batch.columns, "class", "status", "sequence")


def accept(judged: DataFrame, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """The rows without a ``reason``, numbered on from their stream's head
    (``stream_id, head_sequence``) in a total order."""
    rows, after = judged.where("reason is null"), None
    if heads is not None:
        rows = rows.join(heads.select("stream_id", F.col("head_sequence").alias("__head")), "stream_id", "left")
        after = "__head"
    return number_balanced(rows, ["stream_id"], order, "sequence", after).drop("__head")


def decide(new: DataFrame, reason: Column, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Decisions on new proposals: rejected where ``reason`` isn't null, the others
    accepted and numbered.  Rejections take no number."""
    rows, after = new.withColumn("reason", reason).withColumn("__accepted", F.col("reason").isNull()), None
    if heads is not None:
        rows = rows.join(heads.select("stream_id", F.col("head_sequence").alias("__head")), "stream_id", "left")
        after = "__head"
    # Accepted and rejected rows are numbered apart in one pass.
    numbered = number_balanced(rows, ["stream_id", "__accepted"], order, "__number", after)
    return numbered.select(
        *new.columns,
        "reason",
        F.when(F.col("__accepted"), F.col("__number")).alias("sequence"),
        F.when(F.col("__accepted"), "accepted").otherwise("rejected").alias("status"),
    )


def fold(
    proposals: DataFrame,
    initial: Any,
    judge: Callable[[Any, dict[str, Any]], str | None],
    apply: Callable[[Any, dict[str, Any]], Any],
    order: list[str],
) -> DataFrame:
    """Decide where a decision depends on the state that earlier ones left: the
    proposals of a stream in order, one after another, as a stateful rule needs.

    Rows reach the fold in Arrow batches of a sorted partition, not as a whole stream.
    ``judge`` returns a reason to reject, or None.
    """
    kept = proposals.columns
    ordered = proposals.repartition("stream_id").sortWithinPartitions("stream_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state, head = None, initial, 0
        for batch in batches:
            sequences, reasons = [], []
            for row in batch.to_dict("records"):
                if row["stream_id"] != stream:
                    stream, state, head = row["stream_id"], initial, 0
                reason = judge(state, row)
                if reason is None:
                    state, head = apply(state, row), head + 1
                sequences.append(None if reason else head)
                reasons.append(reason)
            status = ["rejected" if r else "accepted" for r in reasons]
            yield batch.assign(sequence=pd.array(sequences, "Int64"), reason=reasons, status=status)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proposals.select(kept).schema)
    return ordered.mapInPandas(run, f"{schema}, sequence long, reason string, status string")
