"""A response merged into each replica: one shuffle, one pass over a replica's rows.

Replica, outbox, decisions, retained log and received entries become one table of tagged rows,
dealt by replica and sorted so that each is met when it is needed: the outbox first, then the
decisions in their order, then the log, where at each sequence the retained entry comes before the
received one.  So a pass holds an outbox and one page of new entries, not a log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replica import REPLICA

#: What a tagged row holds besides its replica.
FIELDS = "operation_id string, origin_client string, client_sequence long, intent_hash string, status string, sequence long, operation string, ord long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TAGS = {"replica": 0, "page": 1, "outbox": 2, "decision": 3, "retained": 4, "entry": 5}
MERGED = f"stream_id string, client_id string, kind string, detail string, {FIELDS}"
IDENTITY = (("operation_id", "operationId"), ("origin_client", "origin clientId"), ("client_sequence", "origin clientSequence"), ("intent_hash", "origin intentHash"))


class Conflict(Exception):
    """Why a replica can't take a response."""


def merge_responses(replicas: DataFrame, outbox: DataFrame, retained: DataFrame, pages: DataFrame, decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Merge each replica's response.  All tables have ``stream_id, client_id`` (the replica):

    * ``replicas``: ``retained_base, confirmed_sequence``; ``pages``: ``base_sequence, head_sequence``
      (a replica without a page is left alone),
    * ``outbox``: ``operation_id, client_sequence, intent_hash, status``, of accepted rows ``sequence, operation``,
    * ``decisions`` in the order of ``decision_ord``: ``operation_id, status, sequence, operation`` (or reason),
    * ``retained``, ``entries``: ``sequence, operation_id, origin_client, client_sequence, intent_hash, operation``; the
      entries of a page are dense, as ``validate.page_violations`` has it.

    Returns tagged rows of ``kind``: ``replica`` (``sequence``: confirmed after; ``status``: ``caught-up`` or
    ``behind``), ``outbox`` (what is left), ``entry`` (to append to the retained log), ``resolution`` (decisions learned,
    with ``status``, in the order of ``ord``), or, for a replica that can't take its response and stays as it is, one
    ``conflict`` with its ``detail``: the first in the protocol's order."""
    none = {n: F.lit(None).cast(t) for n, t in (f.split() for f in FIELDS.split(", "))}

    def tagged(rows: DataFrame, tag: str, ord_: str, **columns: str) -> DataFrame:
        have = {c: F.col(c) for c in NAMES if c in rows.columns and c != "ord"} | {c: F.col(x) for c, x in columns.items()}
        return rows.select(*REPLICA, F.lit(TAGS[tag]).alias("tag"), *((have.get(n, none[n]).cast(t) if n != "ord" else F.col(ord_).cast("long")).alias(n) for n, t in (f.split() for f in FIELDS.split(", "))))

    every = tagged(replicas, "replica", "retained_base", sequence="confirmed_sequence")
    every = every.unionByName(tagged(pages, "page", "base_sequence", sequence="head_sequence"))
    for rows, tag, ord_ in ((outbox, "outbox", "client_sequence"), (decisions, "decision", "decision_ord"), (retained, "retained", "sequence"), (entries, "entry", "sequence")):
        every = every.unionByName(tagged(rows, tag, ord_))
    # The log's two kinds are sorted together by sequence.
    phase = F.least("tag", F.lit(TAGS["retained"]))
    dealt = every.repartition(*REPLICA).sortWithinPartitions(*REPLICA, phase, "ord", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replica, key = None, None
        for batch in batches:
            out: list[tuple] = []
            new: list[pa.RecordBatch] = []
            tags, sequences = (pc.fill_null(batch[c], -1).to_numpy(zero_copy_only=False) for c in ("tag", "sequence"))
            cuts = [0, *_changes(batch), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                mine = batch["stream_id"][start].as_py(), batch["client_id"][start].as_py()
                if mine != key:
                    if replica:
                        out += replica.end(new)
                    replica, key = _Replica(mine), mine
                replica.take_all(batch.slice(start, end - start), tags[start:end], sequences[start:end])
            yield _rows(out)
            yield from _entries(new)
        if replica:
            new = []
            yield _rows(replica.end(new))
            yield from _entries(new)

    return dealt.mapInArrow(run, MERGED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in MERGED.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _changes(batch: pa.RecordBatch) -> list[int]:
    """Where another replica's rows may begin."""
    found = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in REPLICA if batch.num_rows > 1 else ():
        found |= pc.fill_null(pc.not_equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)), True).to_numpy(zero_copy_only=False)
    return (np.flatnonzero(found) + 1).tolist()


def _entries(new: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries to append, as they came."""
    if new:
        rows = pa.Table.from_batches(new).combine_chunks()
        none = pa.nulls(len(rows), pa.string())
        fixed = {"kind": pa.repeat(pa.scalar("entry"), len(rows)), "detail": none, "status": none}
        names = [f.split()[0] for f in MERGED.split(", ")]
        yield from pa.table({n: fixed.get(n, rows[n] if n not in fixed else None) for n in names}).to_batches()


class _Replica:
    """The merge of one replica's rows as they come."""

    def __init__(self, key: tuple[str, str]):
        self.key, self.at, self.conflict, self.last = key, None, None, None
        self.before: list[dict[str, Any]] = []
        self.outbox: dict[str, dict[str, Any]] = {}
        self.accepted: dict[int, str] | None = None  # by sequence; what decisions accept counts
        self.new: list[pa.RecordBatch] = []  # entries to append, without gaps
        self.added = 0
        self.learned: list[dict[str, Any]] = []

    def take_all(self, rows: pa.RecordBatch, tags: np.ndarray, sequences: np.ndarray) -> None:
        """Rows in their order.  Entries beyond what is confirmed, most of all rows, stay in their columns; only those
        that the outbox knows are looked at one by one."""
        told = int(np.searchsorted(tags >= TAGS["retained"], True))
        for row in rows.slice(0, told).to_pylist():
            self.take(row)
        if self.at is None or self.conflict is not None or told == len(tags):
            return
        fresh = (tags == TAGS["entry"]) & (sequences > max(self.base, self.confirmed))
        first = int(np.argmax(fresh)) if fresh.any() else len(tags)
        for row in rows.slice(told, first - told).to_pylist():
            self.take(row)
        if first == len(tags) or self.conflict is not None:
            return
        rows, fresh = rows.slice(first), fresh[first:]
        if not fresh.all():
            for row in rows.filter(pa.array(~fresh)).to_pylist():
                self.take(row)
            rows = rows.filter(pa.array(fresh))
        try:
            self._append(rows, sequences[first:][fresh])
        except Conflict as why:
            self.conflict = str(why)

    def take(self, row: dict[str, Any]) -> None:
        tag = row.pop("tag")
        if tag == TAGS["replica"]:
            self.base, self.confirmed = row["ord"], row["sequence"]
        elif tag == TAGS["page"]:
            self.at, self.head = row, row["sequence"]
            if row["ord"] > self.confirmed:
                self.conflict = f"log-gap: expected {self.confirmed + 1}, received {row['ord'] + 1}"
        elif tag == TAGS["outbox"]:
            self.before.append(row)
            self.outbox[row["operation_id"]] = dict(row)
        elif self.at is not None and self.conflict is None:
            try:
                {TAGS["decision"]: self._decision, TAGS["retained"]: self._retained, TAGS["entry"]: self._entry}[tag](row)
            except Conflict as why:
                self.conflict = str(why)

    def _decision(self, row: dict[str, Any]) -> None:
        local = self.outbox.get(row["operation_id"])
        if local is None:
            return
        if row["status"] == "rejected":
            if local["status"] == "accepted":
                raise Conflict("decision-conflict")
            del self.outbox[row["operation_id"]]
        elif local["status"] == "accepted":
            if (local["sequence"], local["operation"]) != (row["sequence"], row["operation"]):
                raise Conflict("decision-conflict")
            return
        else:
            local |= {"status": "accepted", "sequence": row["sequence"], "operation": row["operation"]}
        self.learned.append(row)

    def _retained(self, row: dict[str, Any]) -> None:
        self.last = row
        self._settle(row)

    def _entry(self, row: dict[str, Any]) -> None:
        if row["sequence"] <= self.base:
            return
        held = self.last
        if held is None or held["sequence"] != row["sequence"]:
            raise Conflict(f"log-gap: expected {self.confirmed + 1}, received {row['sequence']}")
        for c, name in IDENTITY:
            if held[c] != row[c]:
                raise Conflict(f"log-divergence: {name} differs")
        if held["operation"] != row["operation"]:
            raise Conflict("log-divergence: canonical operation payload differs")
        self._resolve(row)

    def _append(self, rows: pa.RecordBatch, sequences: np.ndarray) -> None:
        """Entries beyond what is confirmed, up to the first that doesn't follow the one before it."""
        after = self.confirmed + self.added
        follows = sequences == after + 1 + np.arange(len(sequences))
        dense = len(sequences) if follows.all() else int(np.argmin(follows))
        if self.outbox:
            for at, name in enumerate(rows["operation_id"].slice(0, dense).to_pylist()):
                if name in self.outbox:
                    (row,) = rows.slice(at, 1).to_pylist()
                    self._resolve(row)
        self.new.append(rows.slice(0, dense))
        self.added += dense
        if dense < len(sequences):
            raise Conflict(f"log-gap: expected {after + dense + 1}, received {sequences[dense]}")

    def _added(self, sequence: int) -> dict[str, Any] | None:
        """The entry of a sequence among those to append."""
        at = sequence - self.confirmed - 1
        for rows in self.new if at >= 0 else ():
            if at < rows.num_rows:
                return rows.slice(at, 1).to_pylist()[0]
            at -= rows.num_rows
        return None

    def _resolve(self, row: dict[str, Any]) -> None:
        """What an entry says of an operation of the outbox."""
        local = self.outbox.get(row["operation_id"])
        if local is None:
            return
        self._same(local, row)
        if local["status"] == "accepted" and (local["sequence"], local["operation"]) != (row["sequence"], row["operation"]):
            raise Conflict("decision-conflict")
        if local["status"] == "pending":
            self.learned.append(row | {"status": "accepted"})
        del self.outbox[row["operation_id"]]

    def _same(self, local: dict[str, Any], row: dict[str, Any]) -> None:
        mine = local | {"origin_client": self.key[1]}
        for c, name in IDENTITY:
            if mine[c] != row[c]:
                raise Conflict(f"log-divergence: {name} differs")

    def _settle(self, row: dict[str, Any]) -> None:
        """What the outbox holds as accepted at the sequence of a retained entry."""
        if self.accepted is None:
            self.accepted = {r["sequence"]: name for name, r in self.outbox.items() if r["status"] == "accepted"}
        name = self.accepted.get(row["sequence"])
        if name in self.outbox:
            self.outbox[name]["committed"] = row

    def _reconcile(self) -> None:
        """Receipts that came before their entries."""
        through = self.confirmed + self.added
        for name, local in list(self.outbox.items()):
            if local["status"] != "accepted" or local["sequence"] > through:
                continue
            if local["sequence"] <= self.base:
                raise Conflict(f"compacted-entry: {local['sequence']}")
            row = self._added(local["sequence"]) or local.get("committed")
            if row is None:
                raise Conflict(f"log-gap: expected {local['sequence']}, received {through + 1}")
            self._same(local, row)
            if local["operation"] != row["operation"]:
                raise Conflict("decision-conflict")
            del self.outbox[name]

    def end(self, new: list[pa.RecordBatch]) -> list[tuple]:
        """The rows of the result but for the entries to append, which go to ``new``."""
        if self.at is None:
            return []
        if self.conflict is None:
            try:
                self._reconcile()
            except Conflict as why:
                self.conflict = str(why)

        def row(kind: str, r: dict[str, Any], detail: str | None = None, **other: Any) -> tuple:
            return (*self.key, kind, detail, *((r | other).get(n) for n in NAMES))

        if self.conflict is not None:
            return [row("conflict", {}, self.conflict), *(row("outbox", r) for r in self.before)]
        through = self.confirmed + self.added
        new += self.new
        out = [row("replica", {}, sequence=through, status="caught-up" if through >= self.head else "behind")]
        out += [row("outbox", r) for r in self.outbox.values()]
        return out + [row("resolution", r, ord=n) for n, r in enumerate(self.learned)]
