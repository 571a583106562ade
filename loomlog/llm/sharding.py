"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are a group.  Groups that matter to a shard are placed one by one;
the many small ones are dealt by hash into parcels of a bounded number, so that what is
placed never grows with the input.  The largest goes first, each to the shard where the
dot product of its size with the capacity left is highest.  A group that is more than
a shard in any of the three is split, as no balance is possible around it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Parcels a shard that small groups are dealt into; a group of this share of a shard
#: or more is placed by itself, so at most 3 times as many are.
PARCELS = 512
#: Share of a shard beyond which a group is split, into parcels of a PARCELS-th.
SPLIT = 1.0
#: Rows that are numbered together.
NUMBERED = 100_000
#: Bytes that each row has besides its text.
OVERHEAD = 16

MEASURES = ("size", "tokens", "one")


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each parcel; ``sizes`` has a row of measures for each."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, sizes.shape[1]))
    found = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        at = int(np.argmax(left @ share[i]))
        found[i] = at
        left[at] -= share[i]
    return even(share, found, left)


def even(share: np.ndarray, found: np.ndarray, left: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Even out the first measure by exchanges between the fullest and the emptiest
    shard: what differs by half their gap changes places, or moves if nothing does so
    better, preferring pairs that are alike in the other measures."""
    for _ in range(rounds):
        low, high = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = left[high, 0] - left[low, 0]
        if gap < 1e-4:
            break
        a, b = np.flatnonzero(found == low), np.flatnonzero(found == high)
        a = a[np.argsort(-share[a, 0], kind="stable")][:512]
        b = b[np.argsort(-share[b, 0], kind="stable")][:512]
        other = np.vstack([share[b], np.zeros((1, share.shape[1]))])
        moved = share[a][:, None, :] - other[None, :, :]
        cost = np.abs(moved[:, :, 0] - gap / 2) + 0.01 * np.abs(moved[:, :, 1:]).sum(axis=2)
        i, j = np.unravel_index(int(np.argmin(cost)), cost.shape)
        if not 0 < moved[i, j, 0] < gap:
            break
        found[a[i]] = high
        if j < len(b):
            found[b[j]] = low
        left[low] += moved[i, j]
        left[high] -= moved[i, j]
    return found


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, size, tokens, one, text_crc32, group`` of every row.  Groups are told
    apart by a hash of 64 bits: two that meet would only be placed together."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("one"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens`` of every row.

    ``size`` is the text's bytes (a null text has none) and 16; the law is ``bytes``,
    so ``grown_shard`` is null.  ``slot`` is gapless from 0 in each shard.  Null texts
    are a group, as are empty ones.  Repeated rows and null ids are placed like any
    other; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(measured(docs, id_col, text_col))
    sums = [F.sum(m).alias(m) for m in MEASURES]
    groups = rows.groupBy("group").agg(*sums)
    total = rows.agg(*sums).first()
    ratio = F.greatest(*(F.col(m) / F.lit(max(1, total[m] or 0) / shards) for m in MEASURES))
    large = (
        groups.withColumn("ratio", ratio)
        .where(F.col("ratio") >= 1 / PARCELS)
        .select("group", F.when(F.col("ratio") > SPLIT, F.ceil(F.col("ratio") * PARCELS)).otherwise(1).cast("long").alias("chunks"))
        .orderBy("group")
        .toPandas()
    )
    large["first"] = large["chunks"].cumsum() - large["chunks"]
    own = spark.createDataFrame(large[["group", "chunks", "first"]].astype("int64"), "group long, chunks long, first long")
    # At most 3 * shards * PARCELS groups reach that share: small enough to broadcast.
    parcel = F.when(
        F.col("first").isNotNull(), F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    ).otherwise(-1 - F.pmod("group", F.lit(shards * PARCELS)))
    dealt = rows.join(F.broadcast(own), "group", "left").withColumn("parcel", parcel)
    parcels = dealt.groupBy("parcel").agg(*sums).orderBy("parcel").toPandas()
    parcels["shard"] = place(parcels[list(MEASURES)].to_numpy(float), shards)
    parcels["base"] = parcels.groupby("shard")["one"].cumsum() - parcels["one"]
    parcels["units"] = -(-parcels["one"] // NUMBERED)
    placed = spark.createDataFrame(
        parcels[["parcel", "shard", "base", "units"]].astype("int64"), "parcel long, shard long, base long, units long"
    )
    unit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("units"))
    numbered = (
        dealt.select("doc_id", "size", "tokens", "text_crc32", "parcel")
        .join(F.broadcast(placed), "parcel")
        .withColumn("unit", unit)
    )
    counts = numbered.groupBy("parcel", "unit").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("parcel").orderBy("unit")) - F.col("n")
    starts = counts.select("parcel", "unit", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("parcel", "unit").orderBy("doc_id", "text_crc32", "size"))
    return (
        numbered.withColumn("nth", nth)
        .join(starts, ["parcel", "unit"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("before") + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "tokens",
        )
    )


def write(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = ()) -> None:
    """Write ``docs`` (ids unique) as Parquet, a folder ``shard=`` for each shard, with ``slot``."""
    at = assign(docs, shards, id_col, text_col).select(F.col("doc_id").alias("__id"), "shard", "slot")
    kept = docs.select(id_col, text_col, *columns)
    placed = kept.join(at, kept[id_col].eqNullSafe(at["__id"])).drop("__id")
    placed.repartition("shard", F.floor(F.col("slot") / NUMBERED)).write.partitionBy("shard").parquet(path)
