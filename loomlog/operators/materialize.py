"""State from a log: the last writer of each row wins, deletes leave nothing.

A log has ``stream_id, sequence, op, table_name, pk`` and what a row carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("stream_id", "table_name", "pk")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key.  The limit applies before the shuffle as well, so a
    key of very many rows sends one from each task."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def state(log: DataFrame, at: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """The rows that the log leaves, or left at a sequence."""
    seen = log if at is None else log.where(F.col("sequence") <= at)
    return latest(seen, keys, F.desc("sequence")).where("op = 'putRow'")


def tombstones(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The rows whose last operation deleted them."""
    return latest(log, keys, F.desc("sequence")).where("op = 'deleteRow'")


def ordered_rows(rows: DataFrame, table_name: str) -> DataFrame:
    """A table's rows by the locale's order of their keys."""
    return rows.where(F.col("table_name") == table_name).orderBy(F.collate("pk", "UNICODE"))


def first_row_with(rows: DataFrame, table_name: str, column: Column, value: str) -> DataFrame:
    """The first row, in key order, whose column has the value as text."""
    return rows.where((F.col("table_name") == table_name) & (column.cast("string") == value)).orderBy(F.collate("pk", "UNICODE")).limit(1)


def optimistic(confirmed: DataFrame, outbox: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Confirmed state with a replica's own operations on top, in outbox order.

    ``confirmed`` has ``sequence``, ``outbox`` has ``client_sequence``; both have the
    keys, ``op`` and the row's columns.  Where the rows of several replicas of a stream are given,
    ``keys`` must name the replica (``client_id``): see ``of_replicas``."""
    below = confirmed.withColumn("__layer", F.lit(0)).withColumn("__ord", F.col("sequence"))
    above = outbox.withColumn("__layer", F.lit(1)).withColumn("__ord", F.col("client_sequence"))
    shared = [c for c in below.columns if c in above.columns]
    both = below.select(shared).unionByName(above.select(shared))
    return latest(both, keys, F.desc("__layer"), F.desc("__ord")).where("op = 'putRow'").drop("__layer", "__ord")


def of_replicas(confirmed: DataFrame, replicas: DataFrame) -> DataFrame:
    """A stream's confirmed entries as each of its replicas (``stream_id, client_id,
    confirmed_sequence``) has them: with that replica's ``client_id``, up to what it has confirmed.
    Of a row only the last entry up to there counts, so replicas that have confirmed as much share the
    work, and one row a replica and key is given."""
    points = replicas.select("stream_id", "confirmed_sequence").distinct()
    seen = confirmed.drop("client_id").join(points, "stream_id").where(F.col("sequence") <= F.col("confirmed_sequence"))
    last = latest(seen, ["stream_id", "confirmed_sequence", "table_name", "pk"], F.desc("sequence"))
    return last.join(replicas.select("stream_id", "client_id", "confirmed_sequence"), ["stream_id", "confirmed_sequence"]).drop("confirmed_sequence")


def optimistic_of_replicas(confirmed: DataFrame, replicas: DataFrame, outbox: DataFrame, most: int = 256) -> DataFrame:
    """What each replica (``stream_id, client_id, confirmed_sequence``, each once) sees: ``optimistic`` on top of
    ``of_replicas``.

    There is a row a replica and key, so many that they aren't shuffled or sorted.  The confirmed rows of replicas that have
    confirmed as much are worked out once, and each is given to those replicas, some ``most`` at a time, but for
    the ones whose own operations write that row."""
    point, row = ["stream_id", "confirmed_sequence"], ["table_name", "pk"]
    points = replicas.select(*point).distinct()
    seen = confirmed.drop("client_id").join(points, "stream_id").where(F.col("sequence") <= F.col("confirmed_sequence"))
    base = latest(seen, [*point, *row], F.desc("sequence")).where("op = 'putRow'")
    own = latest(outbox.drop("confirmed_sequence"), ["stream_id", "client_id", *row], F.desc("client_sequence"))
    sizes = replicas.groupBy(*point).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts"))
    part = F.pmod(F.xxhash64("client_id"), F.col("__parts")).cast("int").alias("__part")
    dealt = replicas.select(*point, "client_id").join(sizes, point).select(*point, "client_id", part)
    parts = dealt.groupBy(*point, "__part").agg(F.collect_list("client_id").alias("__all"))
    writers = own.select("stream_id", "client_id", *row).join(dealt, ["stream_id", "client_id"])
    writers = writers.groupBy(*point, "__part", *row).agg(F.collect_list("client_id").alias("__own"))
    spread = base.join(sizes, point).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    given = spread.join(writers, [*point, "__part", *row], "left").join(parts, [*point, "__part"])
    others = F.when(F.col("__own").isNull(), F.col("__all")).otherwise(F.array_except("__all", "__own"))
    shared = [c for c in confirmed.columns if c in outbox.columns]
    below = given.withColumn("client_id", F.explode(others)).select(shared)
    return below.unionByName(own.where("op = 'putRow'").select(shared))


def project(current: DataFrame, log: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """An application table after a log's operations: upserts replace all columns that
    aren't keys, deletes remove; rows that no operation names stay."""
    last = latest(log, keys, F.desc("sequence")).select(*keys, "op", *columns)
    new = last.select(*(F.col(k).alias(f"__{k}") for k in keys), "op", *(F.col(c).alias(f"__{c}") for c in columns))
    on = [current[k] == new[f"__{k}"] for k in keys]
    return (
        current.join(new, on, "full_outer")
        .where("op is null or op = 'putRow'")
        .select(
            *(F.coalesce(f"__{k}", k).alias(k) for k in keys),
            *(F.when(F.col("op").isNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns),
        )
    )


def running_total(log: DataFrame, amount: Column, name: str = "total", part: int = 100_000) -> DataFrame:
    """A counter's state after each entry.  Sums run within parts of so many sequences, to
    which the totals of a stream's earlier parts, a small table, are added."""
    cut = log.withColumn("__amount", amount).withColumn("__part", F.floor((F.col("sequence") - 1) / part))
    sums = cut.groupBy("stream_id", "__part").agg(F.sum("__amount").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy("stream_id").orderBy("__part")) - F.col("__sum")
    before = sums.select("stream_id", "__part", earlier.alias("__before"))
    within = F.sum("__amount").over(Window.partitionBy("stream_id", "__part").orderBy("sequence"))
    total = cut.withColumn("__within", within).join(before, ["stream_id", "__part"])
    return total.withColumn(name, F.col("__before") + F.col("__within")).select(*log.columns, name)
