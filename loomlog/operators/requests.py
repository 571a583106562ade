"""Requests decided as a whole: one conflict refuses all of a request's proposals.

In the order of a stream's requests, each is held against the decisions, against the requests
committed before it and against itself.  What a refused request named is free again, so whether
a request commits depends on the fate of earlier ones that name the same id or position
otherwise.  This is worked out in rounds: a request with such an earlier one that has
committed is refused, one whose such earlier ones are all refused commits, the others wait.  A
round is one join of the claims that still wait with two rows a key; only ids and positions that are
named in several ways make claims at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .decide import ABORTED, CONFLICTS, IDENTITY, INTENT, NEW, POSITION, REPEAT, REPLAY, classify
from .numbering import number_balanced

FUTURE = "future-base-sequence"
REQUEST = ["stream_id", "request_id"]
#: A key is an operation id or a client's position; a claim is what a request names there.
KEY = ["stream_id", "kind", "key"]


def settle_requests(batch: DataFrame, decisions: DataFrame, heads: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """The verdict on every proposal of a batch: its rows with ``class`` and, for replays, the stored
    ``status, sequence``.

    ``batch`` has ``stream_id, request_id, request_ord`` (total order of a stream's requests, the same in all
    of a request's rows), ``proposal_ord`` (total within it), ``operation_id, client_id,
    client_sequence, intent_hash`` and, where it is to be held
    against ``heads`` (``stream_id, head_sequence`` before the batch), ``base_sequence``.  ``positions`` as in ``classify``.  Null ids and positions are values like others.

    A committed request's proposals are ``replay`` (decided before), ``new``, or ``repeat`` (of a new one earlier in the
    batch, whose decision is theirs).  In a refused one the first that conflicts has its conflict,
    all others are ``aborted``; one beyond its stream's head has ``future-base-sequence`` on its first."""
    found = classify(batch, decisions, positions).withColumns(
        {
            "__place": F.struct("client_id", "client_sequence"),
            "__claim": F.struct("client_id", "client_sequence", "intent_hash"),
        }
    )
    if heads is not None and "base_sequence" in batch.columns:
        found = found.join(heads.select("stream_id", F.coalesce("head_sequence", F.lit(0)).alias("__head")), "stream_id", "left")
        found = found.withColumn("__future", F.col("base_sequence") > F.coalesce("__head", F.lit(0)))
    else:
        found = found.withColumn("__future", F.lit(False))
    # Within its request a proposal meets those before it.
    earlier = Window.partitionBy(*REQUEST, "operation_id").orderBy("proposal_ord")
    place = Window.partitionBy(*REQUEST, "__place").orderBy("proposal_ord")
    own = _conflict(F.first("__claim").over(earlier), F.first("operation_id").over(place))
    own = F.when(F.col("class").isin(*CONFLICTS), F.col("class")).when(F.col("class") == NEW, own)
    found = stored(found.withColumn("__own", own))
    order = found.groupBy(*REQUEST).agg(
        F.first("request_ord").alias("request_ord"), F.max(F.col("__own").isNotNull() | F.col("__future")).alias("__lost")
    )
    refused = _refused(found, order)
    fate = order.join(refused.withColumn("__clashes", F.lit(True)), REQUEST, "left").select(
        *REQUEST, (F.col("__lost") | F.coalesce("__clashes", F.lit(False))).alias("__refused")
    )
    rows = found.join(fate, REQUEST)
    # Every proposal against the first of the committed ones that names its id, and that at its position.
    committed = (F.col("class") == NEW) & ~F.col("__refused")
    at = F.struct("request_ord", "proposal_ord")
    ids = rows.where(committed).groupBy("stream_id", "operation_id").agg(F.min(F.struct(at.alias("at"), "__claim")).alias("__id"))
    places = rows.where(committed).groupBy("stream_id", "__place").agg(F.min(F.struct(at.alias("at"), "operation_id")).alias("__at"))
    rows = _met(_met(rows, ids, ["stream_id", "operation_id"]), places, ["stream_id", "__place"])
    before_id = F.when(F.col("__id.at.request_ord") < F.col("request_ord"), F.col("__id.__claim"))
    before_place = F.when(F.col("__at.at.request_ord") < F.col("request_ord"), F.col("__at.operation_id"))
    clash = F.coalesce(F.when(F.col("class") == NEW, _conflict(before_id, before_place)), F.col("__own"))
    clash = F.when(F.col("class").isin(*CONFLICTS), F.col("class")).otherwise(clash)
    first = F.min(F.when(clash.isNotNull(), F.col("proposal_ord"))).over(Window.partitionBy(*REQUEST))
    least = F.min("proposal_ord").over(Window.partitionBy(*REQUEST))
    verdict = (
        F.when(F.col("__future"), F.when(F.col("proposal_ord") == F.col("__least"), FUTURE).otherwise(ABORTED))
        .when(F.col("__refused"), F.when(F.col("proposal_ord") == F.col("__first"), F.col("__clash")).otherwise(ABORTED))
        .when(F.col("class") == REPLAY, REPLAY)
        .when((F.col("__id.at.request_ord") == F.col("request_ord")) & (F.col("__id.at.proposal_ord") == F.col("proposal_ord")), NEW)
        .otherwise(REPEAT)
    )
    rows = rows.withColumn("__clash", clash).withColumns({"__first": first, "__least": least}).withColumn("class", verdict)
    return rows.select(*batch.columns, "class", *(F.when(F.col("class") == REPLAY, F.col(c)).alias(c) for c in ("status", "sequence")))


def _conflict(claim: Column, operation: Column) -> Column:
    """How a proposal conflicts with the claim of its id and the operation at its position (null: none)."""
    same = claim["client_id"].eqNullSafe(F.col("client_id")) & claim["client_sequence"].eqNullSafe(F.col("client_sequence"))
    return (
        F.when(claim.isNotNull() & ~same, IDENTITY)
        .when(claim.isNotNull() & ~claim["intent_hash"].eqNullSafe(F.col("intent_hash")), INTENT)
        .when(claim.isNull() & operation.isNotNull() & (operation != F.col("operation_id")), POSITION)
    )


def _met(rows: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """A left join with one row a key, null keys being alike."""
    other = one.select(*(F.col(c).alias(f"__j{n}") for n, c in enumerate(on)), *(c for c in one.columns if c not in on))
    same = F.lit(True)
    for n, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__j{n}"))
    return rows.join(other, same, "left").drop(*(f"__j{n}" for n in range(len(on))))


def _refused(found: DataFrame, order: DataFrame) -> DataFrame:
    """The requests that an earlier committed one refuses, among those not lost by themselves."""
    live = found.join(order.where("not __lost").select(*REQUEST), REQUEST).where(F.col("class") == NEW)
    claims = live.select(
        *REQUEST,
        "request_ord",
        F.explode(
            F.array(
                F.struct(F.lit("id").alias("kind"), F.col("operation_id").alias("key"), F.to_json("__claim").alias("value")),
                F.struct(F.lit("position").alias("kind"), F.to_json("__place").alias("key"), F.col("operation_id").alias("value")),
            )
        ).alias("c"),
    ).select(*REQUEST, "request_ord", "c.*")
    several = claims.groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*KEY)
    waiting = stored(claims.join(several, KEY).distinct())
    spark = found.sparkSession
    lost = spark.createDataFrame([], found.select(*REQUEST).schema)
    taken = spark.createDataFrame([], waiting.select(*KEY, "value").schema)
    while not waiting.isEmpty():
        # The first of those that wait at a key, and the first that names something else there.
        firsts = waiting.groupBy(*KEY, "value").agg(F.min("request_ord").alias("ord"))
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("ord", "value"))
        two = firsts.withColumn("nth", nth).where("nth <= 2").groupBy(*KEY).agg(F.min_by("value", "nth").alias("front"), F.min("ord").alias("ord1"), F.max(F.when(F.col("nth") == 2, F.col("ord"))).alias("ord2"))
        held = waiting.join(two, KEY).join(taken.withColumnRenamed("value", "holds"), KEY, "left")
        clash = F.col("holds").isNotNull() & (F.col("holds") != F.col("value"))
        ahead = F.when(F.col("value") == F.col("front"), F.col("ord2")).otherwise(F.col("ord1"))
        waits = F.coalesce(ahead < F.col("request_ord"), F.lit(False))
        fate = stored(held.groupBy(*REQUEST).agg(F.max(clash).alias("clash"), F.max(waits).alias("waits")))
        free = fate.where("not clash and not waits").select(*REQUEST)
        lost = lost.unionByName(fate.where("clash").select(*REQUEST))
        taken = stored(taken.unionByName(waiting.join(free, REQUEST, "left_semi").select(*KEY, "value")).distinct())
        waiting = stored(waiting.join(fate.where("not clash and waits").select(*REQUEST), REQUEST, "left_semi"))
    return lost


def decide_requests(batch: DataFrame, decisions: DataFrame, reason: Column, heads: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """``settle_requests`` with the decisions of new proposals too: ``status`` and ``sequence`` of new ones, numbered
    on from the heads in the order of requests, and of their repeats; ``reason`` where rejected."""
    settled = stored(settle_requests(batch, decisions, heads, positions))
    new = settled.where(F.col("class") == NEW).withColumn("reason", reason)
    accepted = new.where("reason is null").drop("sequence")
    if heads is not None:
        accepted = accepted.join(heads.select("stream_id", F.col("head_sequence").alias("__after")), "stream_id", "left")
    numbered = number_balanced(accepted, ["stream_id"], ["request_ord", "proposal_ord"], "sequence", "__after" if heads is not None else None)
    made = (
        numbered.select("stream_id", "operation_id", F.lit("accepted").alias("__status"), F.col("sequence").alias("__sequence"), F.lit(None).cast("string").alias("reason"))
        .unionByName(new.where("reason is not null").select("stream_id", "operation_id", F.lit("rejected").alias("__status"), F.lit(None).cast("long").alias("__sequence"), "reason"))
    )
    answered = F.col("class").isin(NEW, REPEAT)
    rows = _met(settled, made, ["stream_id", "operation_id"])
    told = {c: F.when(answered, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("status", "sequence")}
    return rows.withColumns(told | {"reason": F.when(answered, F.col("reason"))}).drop("__status", "__sequence")
