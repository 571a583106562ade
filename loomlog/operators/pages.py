"""Pages of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import ENTRIES


def page(log: DataFrame, stream_id: str, base: int, head: int, most: int = ENTRIES) -> DataFrame:
    """The entries after ``base``, up to ``head``, at most so many.  As a log is dense
    the limit is a range of sequences, which reaches the scan."""
    through = min(head, base + most)
    return log.where((F.col("stream_id") == stream_id) & (F.col("sequence") > base) & (F.col("sequence") <= through))


def page_number(sequence: Column, most: int = ENTRIES) -> Column:
    return F.floor((sequence - 1) / most)


def pages(log: DataFrame, most: int = ENTRIES) -> DataFrame:
    """Every page of every stream: ``stream_id, page, first_sequence, last_sequence,
    entries, distinct_sequences, head_sequence, base_sequence, through_sequence, more``."""
    cut = (
        log.withColumn("page", page_number(F.col("sequence"), most))
        .groupBy("stream_id", "page")
        .agg(
            F.min("sequence").alias("first_sequence"),
            F.max("sequence").alias("last_sequence"),
            F.count("*").alias("entries"),
            F.count_distinct("sequence").alias("distinct_sequences"),
        )
    )
    heads = cut.groupBy("stream_id").agg(F.max("last_sequence").alias("head_sequence"))
    through = F.least(F.col("head_sequence"), (F.col("page") + 1) * most)
    return (
        cut.join(heads, "stream_id")
        .withColumn("base_sequence", F.col("page") * most)
        .withColumn("through_sequence", through)
        .withColumn("more", F.col("through_sequence") < F.col("head_sequence"))
    )


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy("stream_id").agg(F.max("sequence").alias("head_sequence"))
