"""The protocol's invariants as DataFrames of violations: none means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import SAFE_INTEGER

#: Most proposals of a request and entries of a page.
PROPOSALS, ENTRIES = 64, 256


def sequence_ok(c: Column, least: int = 0) -> Column:
    """A log sequence (from 0) or a client sequence (from 1)."""
    return F.coalesce((c >= least) & (c <= SAFE_INTEGER), F.lit(False))


def identity_ok(*ids: Column) -> Column:
    ok = F.lit(True)
    for c in ids:
        ok = ok & F.coalesce(F.length(c) > 0, F.lit(False))
    return ok


def batch_violations(proposals: DataFrame) -> DataFrame:
    """``request_id, proposal_ord, violation``: an operation id twice in a request, or a
    client whose sequences don't rise in it (gaps are allowed)."""
    again = F.row_number().over(Window.partitionBy("request_id", "operation_id").orderBy("proposal_ord"))
    before = F.lag("client_sequence").over(Window.partitionBy("request_id", "client_id").orderBy("proposal_ord"))
    kind = F.when(again > 1, "duplicate-operation-id").when(before >= F.col("client_sequence"), "proposal-order")
    return proposals.select("request_id", "proposal_ord", kind.alias("violation")).where("violation is not null")


def request_violations(requests: DataFrame, most: int = PROPOSALS) -> DataFrame:
    """``request_id, violation`` of requests (``base_sequence, maximum_entries,
    proposals, head_sequence``): the first rule that fails, in the protocol's order."""
    kind = (
        F.when(~sequence_ok(F.col("base_sequence")), "invalid-sequence")
        .when(~sequence_ok(F.col("maximum_entries"), 1), "invalid-limit")
        .when(F.col("proposals") > most, "protocol-limit")
        .when(F.col("base_sequence") > F.coalesce("head_sequence", F.lit(0)), "future-base-sequence")
    )
    return requests.select("request_id", kind.alias("violation")).where("violation is not null")


def gaps(log: DataFrame, bucket: Column | None = None) -> DataFrame:
    """``stream_id, expected, received`` where a log isn't dense from 1.  With ``bucket``
    (not falling as sequences rise) a stream is checked in parts, each against the last
    sequence of those before."""
    if bucket is None:
        before = F.lag("sequence", 1, 0).over(Window.partitionBy("stream_id").orderBy("sequence"))
        found = log.select("stream_id", (before + 1).alias("expected"), F.col("sequence").alias("received"))
        return found.where("expected <> received")
    cut = log.select("stream_id", "sequence", bucket.alias("__bucket"))
    last = cut.groupBy("stream_id", "__bucket").agg(F.max("sequence").alias("__last"))
    ends = last.select(
        "stream_id", "__bucket", F.lag("__last", 1, 0).over(Window.partitionBy("stream_id").orderBy("__bucket")).alias("__ended")
    )
    within = F.lag("sequence").over(Window.partitionBy("stream_id", "__bucket").orderBy("sequence"))
    found = cut.withColumn("__before", within).join(ends, ["stream_id", "__bucket"])
    return found.select(
        "stream_id", (F.coalesce("__before", "__ended") + 1).alias("expected"), F.col("sequence").alias("received")
    ).where("expected <> received")


def density(log: DataFrame) -> DataFrame:
    """``stream_id, entries, distinct_sequences, head_sequence, violation`` of the streams whose log isn't 1, 2, .. up to its
    head.  Sequences are told apart in bitmaps of 32,768 each, built before the shuffle, so a stream
    sends four kilobytes for each, and none sorts its entries: ``missing`` numbers, ``repeated`` ones, or
    an ``invalid-sequence`` below 1."""
    bits = log.groupBy("stream_id", F.bitmap_bucket_number("sequence").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("sequence")).alias("__map"),
        F.count("*").alias("__n"),
        F.max("sequence").alias("__head"),
        F.min("sequence").alias("__least"),
    )
    found = bits.groupBy("stream_id").agg(
        F.sum("__n").alias("entries"), F.sum(F.bitmap_count("__map")).alias("distinct_sequences"), F.max("__head").alias("head_sequence"), F.min("__least").alias("__least")
    )
    kind = (
        F.when(F.col("__least") < 1, "invalid-sequence")
        .when(F.col("entries") != F.col("distinct_sequences"), "repeated")
        .when(F.col("distinct_sequences") != F.col("head_sequence"), "missing")
    )
    return found.withColumn("violation", kind).where("violation is not null").drop("__least")


def repeats(rows: DataFrame, within: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Operation ids and client positions that several rows of a stream (or of what ``within`` names) have: ``kind`` (``operation-id``
    or ``client-position``), ``key, n``.  Both in one shuffle, counted before it."""
    keys = F.array(
        F.struct(F.lit("operation-id").alias("kind"), F.to_json(F.array(F.col("operation_id"))).alias("key")),
        F.struct(F.lit("client-position").alias("kind"), F.to_json(F.array(F.col("client_id"), F.col("client_sequence").cast("string"))).alias("key")),
    )
    each = rows.select(*within, F.explode(keys).alias("k")).select(*within, "k.*")
    return each.groupBy(*within, "kind", "key").agg(F.count("*").alias("n")).where("n > 1")


def position_conflicts(rows: DataFrame) -> DataFrame:
    """Client positions that several operations hold."""
    return (
        rows.groupBy("stream_id", "client_id", "client_sequence")
        .agg(F.count_distinct("operation_id").alias("operations"))
        .where("operations > 1")
    )


def page_violations(pages: DataFrame) -> DataFrame:
    """``stream_id, page, violation`` of response pages (``base_sequence,
    through_sequence, head_sequence, entries, first_sequence, last_sequence,
    distinct_sequences``)."""
    kind = (
        F.when((F.col("base_sequence") > F.col("through_sequence")) | (F.col("through_sequence") > F.col("head_sequence")), "cursor")
        .when(F.col("entries") != F.col("through_sequence") - F.col("base_sequence"), "length")
        .when((F.col("entries") == 0) & (F.col("through_sequence") < F.col("head_sequence")), "empty")
        .when(
            (F.col("entries") > 0)
            & (
                (F.col("first_sequence") != F.col("base_sequence") + 1)
                | (F.col("last_sequence") != F.col("through_sequence"))
                | (F.col("distinct_sequences") != F.col("entries"))
            ),
            "dense",
        )
    )
    return pages.withColumn("violation", kind).where("violation is not null")


def decision_violations(pages: DataFrame, entries: DataFrame, decisions: DataFrame, most: int = PROPOSALS) -> DataFrame:
    """``stream_id, page, operation_id, violation`` of the decisions in responses: the first rule
    that fails.  ``pages`` has ``head_sequence``; ``entries`` and ``decisions`` (``operation_id, status,
    sequence``, in the order of ``decision_ord``) have their ``stream_id, page``."""
    response = ["stream_id", "page"]
    nth = F.row_number().over(Window.partitionBy(*response).orderBy("decision_ord"))
    again = F.row_number().over(Window.partitionBy(*response, "operation_id").orderBy("decision_ord"))
    page = entries.select(*response, "operation_id", F.col("sequence").alias("__committed"))
    kind = (
        F.when(F.col("__nth") > most, "protocol-limit")
        .when(F.coalesce(F.length("operation_id"), F.lit(0)) == 0, "operation-id")
        .when(F.col("__again") > 1, "decision-repeated")
        .when((F.col("status") == "accepted") & ~sequence_ok(F.col("sequence"), 1), "invalid-sequence")
        .when((F.col("status") == "accepted") & (F.col("sequence") > F.col("head_sequence")), "decision-beyond-head")
        .when((F.col("status") == "accepted") & (F.col("__committed") != F.col("sequence")), "decision-sequence-differs")
        .when((F.col("status") == "rejected") & F.col("__committed").isNotNull(), "rejected-committed")
        .when(~F.col("status").isin("accepted", "rejected"), "status")
    )
    return (
        decisions.withColumns({"__nth": nth, "__again": again})
        .join(page, [*response, "operation_id"], "left")
        .join(pages.select(*response, "head_sequence"), response)
        .select(*response, "operation_id", kind.alias("violation"))
        .where("violation is not null")
    )


def snapshot_violations(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """``stream_id, operation_id, violation`` where log and accepted decisions aren't
    one to one in all five identity fields."""
    fields = ("sequence", "client_id", "client_sequence", "intent_hash")
    a = log.select("stream_id", "operation_id", *(F.col(c).alias(f"__l_{c}") for c in fields))
    b = decisions.where("status = 'accepted'").select("stream_id", "operation_id", *(F.col(c).alias(f"__d_{c}") for c in fields))
    kind = F.when(F.col("__d_sequence").isNull(), "decision-missing").when(F.col("__l_sequence").isNull(), "entry-missing")
    for c, name in zip(fields, ("sequence-differs", "client-differs", "position-differs", "intent-differs")):
        kind = kind.when(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__d_{c}")), name)
    return (
        a.join(b, ["stream_id", "operation_id"], "full_outer")
        .select("stream_id", "operation_id", kind.alias("violation"))
        .where("violation is not null")
    )
