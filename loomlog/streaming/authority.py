"""Proposals decided as they arrive, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import decide as D
from ..operators.requests import decide_requests
from ..sources.decisions import DecisionStore
from ..sources.stored import stored


def decision_store(spark: SparkSession, path: str, rows: StructType, columns: list[str]) -> DecisionStore:
    """The store that ``decide_batches`` keeps in ``path`` for proposals of a schema."""
    schema = StructType([rows[c] for c in columns]).add("status", "string").add("sequence", "long").add("reason", "string")
    return DecisionStore(spark, path, schema)


def decide_batches(
    proposals: DataFrame,
    path: str,
    reason: Column,
    order: list[str],
    columns: list[str],
    answers: str | None = None,
    request: str | None = None,
) -> DataStreamWriter:
    """A writer that decides each micro-batch of ``proposals`` against the decisions in the
    ``decision_store`` of ``path`` and appends the new ones there, as ``columns`` (with those that
    decisions need) and ``status, sequence, reason``.

    With ``request``, a column, a stream's request is decided as a whole (its proposals must come in one
    batch), else every proposal by itself; ``order`` must be total.  Every proposal has one row in
    ``answers``, if named: ``columns`` and ``class, status, sequence, reason, batch``; see ``operators.requests``.

    A batch that is run again after a failure overwrites what it wrote, so every proposal is
    decided once.  A batch reads the buckets of decisions that its proposals fall in."""

    def run(batch: DataFrame, number: int) -> None:
        store = decision_store(batch.sparkSession, path, batch.schema, columns)
        at = F.struct(*order)
        if request is None:
            keyed = batch.withColumns({"request_id": F.to_json(at), "request_ord": at, "proposal_ord": at})
        else:
            first = F.min(at).over(Window.partitionBy("stream_id", request))
            keyed = batch.withColumns({"request_ord": first, "proposal_ord": at}).withColumn("request_id", F.col(request))
        rows = stored(keyed)
        known, positions = store.lookup(rows, number)
        told = stored(decide_requests(rows, known, reason, store.heads(number), positions))
        store.append(told.where(F.col("class") == D.NEW).select(*store.schema.names), number)
        if answers is not None:
            told.select(*columns, "class", "status", "sequence", "reason").write.mode("overwrite").parquet(f"{answers}/batch={number}")

    return proposals.writeStream.foreachBatch(run).outputMode("append")


class Authority(StatefulProcessor):
    """Decides one stream's requests one after another, with a rule that sees the state.

    It keeps the head, the state, every decision with what it was made on, and the operation of
    every client position; decisions are permanent, so nothing is evicted.  A request with a
    conflict leaves no trace: its first conflicting proposal has that ``class``, the others are ``aborted``."""

    def __init__(self, initial: str, judge: Callable[[str, Any], str | None], apply: Callable[[str, Any], str]):
        self.initial, self.judge, self.apply = initial, judge, apply

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sequence long, state string")
        self.seen = handle.getMapState("seen", "operation_id string", "client_id string, client_sequence long, intent_hash string, sequence long, reason string")
        self.places = handle.getMapState("places", "client_id string, client_sequence long", "operation_id string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Decisions made before: ``operation_id, client_id, client_sequence, intent_hash, sequence, reason`` and, in
        the row of the last sequence, the ``state`` that they left."""
        frame = initialState
        for row in frame.itertuples():
            self._keep(row.operation_id, (row.client_id, int(row.client_sequence), row.intent_hash, _whole(row.sequence), row.reason))
        last = frame[frame["sequence"].notna()].sort_values("sequence").tail(1)
        for row in last.itertuples():
            self.head.update((int(row.sequence), row.state))

    def _keep(self, operation: str, decided: tuple) -> None:
        self.seen.updateValue((operation,), decided)
        self.places.updateValue(decided[:2], (operation,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        found = self.head.get()
        sequence, state = found if found else (0, self.initial)
        frame = pd.concat(list(rows)).sort_values("ord")  # a stream's part of one micro-batch
        out = []
        for _, request in frame.groupby("request_id", sort=False, dropna=False):
            told, made, sequence, state = self._decide(list(request.itertuples()), sequence, state)
            for operation, decided in made.items():
                self._keep(operation, decided)
            out += [(key[0], *t) for t in told]
        self.head.update((sequence, state))
        names = [c.split()[0] for c in DECIDED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"sequence": "Int64"})

    def _decide(self, request: list, sequence: int, state: str) -> tuple[list, dict, int, str]:
        """A request's answers, its new decisions, and the head and state after it."""
        before, told = (sequence, state), []
        made: dict[str, tuple] = {}
        places: dict[tuple, str] = {}
        for row in request:
            name, place = row.operation_id, (row.client_id, int(row.client_sequence))
            old = made.get(name) or (self.seen.getValue((name,)) if self.seen.containsKey((name,)) else None)
            kind = None
            if old is not None:
                kind = D.IDENTITY if tuple(old[:2]) != place else D.INTENT if old[2] != row.intent_hash else D.REPEAT if name in made else D.REPLAY
            else:
                holder = places.get(place) or (self.places.getValue(place)[0] if self.places.containsKey(place) else None)
                kind = D.POSITION if holder is not None else D.NEW
            if kind in D.CONFLICTS:
                return [(r.request_id, r.operation_id, kind if r is row else D.ABORTED, None, None) for r in request], {}, *before
            if kind == D.NEW:
                reason = self.judge(state, row)
                if reason is None:
                    sequence, state = sequence + 1, self.apply(state, row)
                old = (*place, row.intent_hash, None if reason else sequence, reason)
                made[name], places[place] = old, name
            told.append((row.request_id, name, kind, _whole(old[3]), old[4]))
        return told, made, sequence, state

    def close(self) -> None:
        pass


def _whole(x: Any) -> int | None:
    return None if pd.isna(x) else int(x)


DECIDED = "stream_id string, request_id string, operation_id string, class string, sequence long, reason string"


def decide_stateful(proposals: DataFrame, initial: str, judge: Callable, apply: Callable, decided: DataFrame | None = None) -> DataFrame:
    """``stream_id, request_id, operation_id, class, sequence, reason`` of a stream of proposals
    (``stream_id, request_id, operation_id, client_id, client_sequence, intent_hash, ord`` and what the rule reads); a
    request's proposals come in one batch.  ``decided`` are decisions to begin with, ``stream_id`` and
    what ``Authority.handleInitialState`` takes."""
    return proposals.groupBy("stream_id").transformWithStateInPandas(
        Authority(initial, judge, apply),
        outputStructType=DECIDED,
        outputMode="append",
        timeMode="None",
        initialState=None if decided is None else decided.groupBy("stream_id"),
    )
