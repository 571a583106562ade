"""Decisions kept so that a batch reads only what may answer it.

Decisions lie in hash buckets of stream and operation, and what each client position holds in
buckets of its own, so a lookup prunes to the buckets that its proposals fall in.  Every batch
writes a run; as soon as ``fan`` runs of a level are whole they are merged into one of the next, so
a bucket of n batches has some ``fan * log(n)`` files however many rows there are.  Which runs
cover the batches before number n follows from n alone: a batch that is run again writes the same
runs again, and nothing has to be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

ID, POSITION = ("stream_id", "operation_id"), ("stream_id", "client_id", "client_sequence")


class DecisionStore:
    """Decisions (``schema``: ``stream_id, operation_id, client_id, client_sequence, intent_hash, status,
    sequence`` and more) under a folder of its own.  Batches are numbered from 0 without gaps.
    Merged runs stay on disk until they are removed by hand."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 32, fan: int = 8):
        self.spark, self.path, self.schema, self.buckets, self.fan = spark, path.rstrip("/"), schema, buckets, fan

    def bucket(self, key: tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def runs(self, number: int) -> list[tuple[int, int]]:
        """Level and first batch of the runs that hold all batches before a number."""
        level, at, out = 0, 0, []
        while self.fan ** (level + 1) <= number:
            level += 1
        while level >= 0:
            while at + self.fan**level <= number:
                out.append((level, at))
                at += self.fan**level
            level -= 1
        return out

    def _read(self, kind: str, runs: list[tuple[int, int]], schema: StructType) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        top = f"{self.path}/{kind}"
        paths = [f"{top}/run={level}-{at}" for level, at in runs]
        every = StructType([*schema.fields]).add("run", "string")
        return self.spark.read.option("basePath", top).schema(every).parquet(*paths).drop("run")

    def _kinds(self) -> dict[str, tuple[tuple[str, ...], StructType]]:
        places = StructType([self.schema[c] for c in (*POSITION, "operation_id")])
        return {k: (key, StructType([*s.fields]).add("bucket", IntegerType())) for k, key, s in (("ids", ID, self.schema), ("positions", POSITION, places))}

    def all(self, number: int) -> DataFrame:
        """All decisions of the batches before a number."""
        return self._read("ids", self.runs(number), self._kinds()["ids"][1]).drop("bucket")

    def lookup(self, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The decisions, and what positions hold, in the buckets that a batch's proposals fall in; from
        batches before ``number``.  The driver sees the numbers of the buckets only."""
        out = []
        for kind, (key, schema) in self._kinds().items():
            hit = [r.b for r in batch.select(self.bucket(key).alias("b")).distinct().collect()]
            out.append(self._read(kind, self.runs(number), schema).where(F.col("bucket").isin(hit)).drop("bucket"))
        return out[0], out[1]

    def heads(self, number: int) -> DataFrame:
        """``stream_id, head_sequence`` after the batches before a number: a row a stream."""
        schema = StructType([self.schema["stream_id"]]).add("head_sequence", "long")
        return self.spark.read.schema(schema).parquet(f"{self.path}/heads/{number - 1}") if number else self.spark.createDataFrame([], schema)

    def append(self, decided: DataFrame, number: int) -> None:
        """Write a batch's decisions, its streams' heads, and the runs that it makes whole."""
        for kind, (key, schema) in self._kinds().items():
            rows = decided.withColumn("bucket", self.bucket(key)).select(*schema.names)
            self._write(rows, kind, 0, number)
            level = 1
            while (number + 1) % self.fan**level == 0:
                size, below = self.fan**level, self.fan ** (level - 1)
                first = number + 1 - size
                self._write(self._read(kind, [(level - 1, first + n * below) for n in range(self.fan)], schema), kind, level, first)
                level += 1
        before = self.heads(number)
        now = before.unionByName(decided.select("stream_id", F.col("sequence").alias("head_sequence"))).groupBy("stream_id").agg(F.max("head_sequence").alias("head_sequence"))
        now.write.mode("overwrite").parquet(f"{self.path}/heads/{number}")

    def _write(self, rows: DataFrame, kind: str, level: int, at: int) -> None:
        # One file a bucket and run, sorted so that row groups can be skipped by operation or client.
        sort = "operation_id" if kind == "ids" else "client_id"
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "stream_id", sort)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/run={level}-{at}")
