"""Replicas: outbox, merging of pages, compaction, resolutions.

A replica is a row ``stream_id, client_id, confirmed_sequence, retained_base,
next_client_sequence``; its outbox has ``operation_id, client_sequence, intent_hash,
status`` (``pending`` or ``accepted``, then with ``sequence``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validate import ENTRIES, PROPOSALS, identity_ok, sequence_ok

REPLICA = ["stream_id", "client_id"]


def new_replicas(clients: DataFrame) -> DataFrame:
    """A replica without history for each ``stream_id, client_id``, once: ``confirmed_sequence, retained_base`` 0 and
    ``next_client_sequence`` 1, or what a column of that name says.  An empty id, or a next sequence that isn't one, raises."""
    first = F.coalesce("next_client_sequence", F.lit(1)) if "next_client_sequence" in clients.columns else F.lit(1)
    rows = clients.select(*REPLICA, first.cast("long").alias("next_client_sequence")).groupBy(*REPLICA).agg(F.max("next_client_sequence").alias("next_client_sequence"))
    whole = identity_ok(*(F.col(c) for c in REPLICA)) & sequence_ok(F.col("next_client_sequence"), 1)
    next_ = F.when(whole, F.col("next_client_sequence")).otherwise(F.raise_error(F.lit("a replica needs ids and a client sequence")))
    zero = F.lit(0).cast("long")
    return rows.select(*REPLICA, next_.alias("next_client_sequence"), zero.alias("confirmed_sequence"), zero.alias("retained_base"))


def enqueue(operations: DataFrame, replicas: DataFrame, outbox: DataFrame, retained: DataFrame, order: list[str]) -> DataFrame:
    """Operations as pending outbox rows with their client sequences; those whose id is
    in the retained log or the outbox have ``duplicate`` and no sequence."""
    taken = retained.select("stream_id", "operation_id").union(outbox.select("stream_id", "operation_id")).distinct()
    marked = operations.join(taken.withColumn("duplicate", F.lit(True)), ["stream_id", "operation_id"], "left")
    marked = marked.withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*REPLICA, "duplicate").orderBy(*order))
    return marked.join(replicas.select(*REPLICA, "next_client_sequence"), REPLICA).withColumn(
        "client_sequence", F.when(~F.col("duplicate"), (F.col("next_client_sequence") + nth - 1).cast("long"))
    ).drop("next_client_sequence")


def prepare(outbox: DataFrame, most: int = PROPOSALS) -> DataFrame:
    """The first pending proposals of each replica."""
    nth = F.row_number().over(Window.partitionBy(*REPLICA).orderBy("client_sequence"))
    return outbox.where("status = 'pending'").withColumn("proposal_ord", nth).where(F.col("proposal_ord") <= most)


def new_entries(replicas: DataFrame, entries: DataFrame) -> DataFrame:
    """What a response brings each replica beyond what it has confirmed."""
    at = replicas.select(*REPLICA, "confirmed_sequence")
    mine = [c for c in entries.columns if c not in ("stream_id", "client_id")]
    return (
        entries.drop("client_id")
        .join(at, "stream_id")
        .where(F.col("sequence") > F.col("confirmed_sequence"))
        .select(*REPLICA, *mine)
    )


def entries_between(replicas: DataFrame, entries: DataFrame, after: Column, through: Column, part: int = ENTRIES) -> DataFrame:
    """A stream's entries as each of its replicas has them, with the replica's ``client_id``: those after one of its
    sequences, up to another.  Entries are looked up by the parts of the log that the bounds lie in, and once for all
    replicas of the same bounds, so no replica is held against a whole log."""
    low, high = F.col("__after"), F.col("__through")
    spans = replicas.select(*REPLICA, after.cast("long").alias("__after"), through.cast("long").alias("__through")).where(low < high)
    asked = spans.select("stream_id", "__after", "__through").distinct()
    asked = asked.withColumn("__part", F.explode(F.sequence(F.floor(low / part), F.floor((high - 1) / part))))
    cut = entries.withColumn("__part", F.floor((F.col("sequence") - 1) / part))
    found = cut.join(asked, ["stream_id", "__part"]).where((F.col("sequence") > low) & (F.col("sequence") <= high))
    mine = [c for c in entries.columns if c not in REPLICA]
    return found.select("stream_id", "__after", "__through", *mine).join(spans, ["stream_id", "__after", "__through"]).select(*REPLICA, *mine)


def merge_gaps(replicas: DataFrame, pages: DataFrame) -> DataFrame:
    """Replicas whose page begins after what they have confirmed."""
    return replicas.join(pages, "stream_id").where(F.col("base_sequence") > F.col("confirmed_sequence"))


def overlap_divergence(retained: DataFrame, entries: DataFrame) -> DataFrame:
    """``stream_id, sequence, field`` where a response holds another entry than the
    retained log at the same sequence."""
    fields = ("operation_id", "client_id", "client_sequence", "intent_hash")
    old = retained.select("stream_id", "sequence", *(F.col(c).alias(f"__{c}") for c in fields))
    kind = F.lit(None).cast("string")
    for c in reversed(fields):
        kind = F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c).otherwise(kind)
    return (
        entries.join(old, ["stream_id", "sequence"])
        .select("stream_id", "sequence", kind.alias("field"))
        .where("field is not null")
    )


def outbox_after(outbox: DataFrame, learned: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """The outbox after a merge: operations that the replica has learned from the log
    (``stream_id, operation_id``), or that were rejected while pending, leave it."""
    left = outbox.join(learned.select("stream_id", "operation_id").distinct(), ["stream_id", "operation_id"], "left_anti")
    if rejected is not None:
        left = left.join(rejected.select("stream_id", "operation_id").distinct(), ["stream_id", "operation_id"], "left_anti")
    return left


def accepted(outbox: DataFrame, decisions: DataFrame) -> DataFrame:
    """The outbox with pending rows turned to accepted where a decision says so."""
    known = decisions.where("status = 'accepted'").select("stream_id", "operation_id", F.col("sequence").alias("__sequence"))
    return (
        outbox.join(known, ["stream_id", "operation_id"], "left")
        .withColumn("status", F.when(F.col("__sequence").isNotNull(), "accepted").otherwise(F.col("status")))
        .withColumn("sequence", F.coalesce("sequence", "__sequence"))
        .drop("__sequence")
    )


def newly_resolved(outbox: DataFrame, learned: DataFrame) -> DataFrame:
    """Pending rows whose operation a response's entries hold."""
    found = learned.select("stream_id", "operation_id", F.col("sequence").alias("resolved_sequence"))
    return outbox.where("status = 'pending'").join(found, ["stream_id", "operation_id"])


def status(outbox: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``stream_id, client_id, pending, accepted, unacknowledged``."""
    mine = outbox.groupBy(*REPLICA).agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "accepted").alias("accepted")
    )
    told = resolutions.groupBy(*REPLICA).agg(F.count("*").alias("unacknowledged"))
    counts = ("pending", "accepted", "unacknowledged")
    return mine.join(told, REPLICA, "full_outer").select(*REPLICA, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def append_resolutions(kept: DataFrame, more: DataFrame) -> DataFrame:
    """Resolutions with those of new operations appended; the first of each stays."""
    on = [*REPLICA, "operation_id"]
    return kept.unionByName(more.join(kept, on, "left_anti").dropDuplicates(on))


def acknowledge(kept: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Resolutions that aren't acknowledged; unknown ids are ignored."""
    return kept.join(acknowledged, [*REPLICA, "operation_id"], "left_anti")


def compact(retained: DataFrame, replicas: DataFrame, through: Column) -> DataFrame:
    """A replica's retained log without what it has confirmed up to ``through``; a
    bound beyond what is confirmed removes nothing."""
    bounds = replicas.select(
        *REPLICA, F.when(through <= F.col("confirmed_sequence"), through).otherwise(F.lit(0)).alias("__through")
    )
    return retained.join(bounds, REPLICA).where(F.col("sequence") > F.col("__through")).drop("__through")


def compaction_gaps(replicas: DataFrame, through: Column) -> DataFrame:
    """``stream_id, client_id, expected, received`` of the replicas whose bound is beyond what
    they have confirmed; ``compact`` leaves their logs alone."""
    return replicas.where(through > F.col("confirmed_sequence")).select(
        *REPLICA, (F.col("confirmed_sequence") + 1).alias("expected"), through.alias("received")
    )


def merge_conflicts(replicas: DataFrame, outbox: DataFrame, retained: DataFrame, pages: DataFrame, entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``stream_id, client_id, violation``: the first reason, in the protocol's order, for
    which a replica (``retained_base, confirmed_sequence``) can't merge its response.

    ``pages`` has ``base_sequence``; ``entries`` and ``decisions`` are those of the responses, all with
    the replica's ``stream_id, client_id``; an entry's author is ``origin_client``.  The outbox has ``intent_hash, status,
    sequence, operation`` (the last two of accepted rows), a decision and an entry ``sequence, operation``."""
    box = outbox.select(*REPLICA, "operation_id", *(F.col(c).alias(f"__{c}") for c in ("client_sequence", "intent_hash", "status", "sequence", "operation")))
    gap = pages.join(replicas, REPLICA).where(F.col("base_sequence") > F.col("confirmed_sequence")).select(*REPLICA, F.lit(1).alias("nth"), F.lit("log-gap").alias("violation"))
    met = decisions.join(box, [*REPLICA, "operation_id"]).where("__status = 'accepted'")
    differs = ~F.col("sequence").eqNullSafe(F.col("__sequence")) | ~F.col("operation").eqNullSafe(F.col("__operation"))
    decided = met.where((F.col("status") == "rejected") | differs).select(*REPLICA, F.lit(2).alias("nth"), F.lit("decision-conflict").alias("violation"))
    held = retained.select(*REPLICA, "sequence", *(F.col(c).alias(f"__{c}") for c in ("operation_id", "origin_client", "client_sequence", "intent_hash", "operation")))
    differs = F.lit(False)
    for c in ("operation_id", "origin_client", "client_sequence", "intent_hash", "operation"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    diverged = entries.join(held, [*REPLICA, "sequence"]).where(differs).select(*REPLICA, F.lit(3).alias("nth"), F.lit("log-divergence").alias("violation"))
    own = entries.join(box, [*REPLICA, "operation_id"])
    other = (
        (F.col("origin_client") != F.col("client_id"))
        | (F.col("client_sequence") != F.col("__client_sequence"))
        | (F.col("intent_hash") != F.col("__intent_hash"))
    )
    moved = (F.col("__status") == "accepted") & ((F.col("sequence") != F.col("__sequence")) | ~F.col("operation").eqNullSafe(F.col("__operation")))
    proposed = own.where(other | moved).select(*REPLICA, F.lit(4).alias("nth"), F.when(other, "identity-differs").otherwise("decision-conflict").alias("violation"))
    compacted = (
        outbox.where("status = 'accepted'")
        .join(replicas.select(*REPLICA, "retained_base"), REPLICA)
        .where(F.col("sequence") <= F.col("retained_base"))
        .select(*REPLICA, F.lit(5).alias("nth"), F.lit("compacted-entry").alias("violation"))
    )
    every = gap.union(decided).union(diverged).union(proposed).union(compacted)
    return every.groupBy(*REPLICA).agg(F.min_by("violation", "nth").alias("violation"))


def record_violations(replicas: DataFrame, retained: DataFrame, outbox: DataFrame) -> DataFrame:
    """``stream_id, client_id, violation`` of durable replica records."""
    log = retained.groupBy(*REPLICA).agg(
        F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n"), F.count_distinct("operation_id").alias("ids")
    )
    box = outbox.groupBy(*REPLICA).agg(
        F.count("*").alias("m"),
        F.count_distinct("client_sequence").alias("positions"),
        F.count_distinct("operation_id").alias("box_ids"),
        F.max("client_sequence").alias("top"),
        F.count_if(~F.col("status").isin("pending", "accepted")).alias("odd"),
        F.min(F.when(F.col("status") == "accepted", F.col("sequence"))).alias("least"),
        F.count_if((F.col("status") == "accepted") & F.col("sequence").isNull()).alias("unplaced"),
    )
    kind = (
        F.when((F.col("hi") != F.col("confirmed_sequence")) | (F.col("n") != F.col("hi") - F.col("lo") + 1), "retained-log")
        .when(F.col("ids") != F.col("n"), "operation-id")
        .when(F.col("odd") > 0, "status")
        .when(F.col("positions") != F.col("m"), "client-position")
        .when(F.col("box_ids") != F.col("m"), "operation-id")
        .when(F.col("top") >= F.col("next_client_sequence"), "next-client-sequence")
        .when((F.col("unplaced") > 0) | (F.col("least") <= F.col("confirmed_sequence")), "accepted-sequence")
    )
    return (
        replicas.join(log, REPLICA, "left")
        .join(box, REPLICA, "left")
        .select(*REPLICA, kind.alias("violation"))
        .where("violation is not null")
    )
