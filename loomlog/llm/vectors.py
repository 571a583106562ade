"""What the two vector searches share: which vectors take part, and result ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that visit a part of the index together.
QUERIES = 4096


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: id and vector not null, all
    components finite, and of the most frequent length (of those the smallest).  Rows
    that repeat an id count once, with the smallest of its vectors."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    )
    lengths = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = lengths["n"] if lengths else 0
    return found.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))


def first_of_equal(entries: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each vector, those with the smallest ids: no query can
    have more of them among its nearest.  The limit is applied before the shuffle too."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return entries.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def matrix(column, dtype: str) -> np.ndarray:
    """Rows of a column of binary vectors."""
    rows = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def lists(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def binary(vectors: np.ndarray, dtype: str) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(vectors, dtype)], pa.binary())


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: ``query_id, rank, vec_id, score``."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` best of each query (a number) stand, best first, ties to the
    smaller id."""
    # No long overflows in ~scores, which falls as they rise.
    falling = ~scores if scores.dtype.kind == "i" else -scores
    order = np.lexsort((ids, falling, query))
    sorted_query = query[order]
    start = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - start < k]


def batches_of(column_batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in column_batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
