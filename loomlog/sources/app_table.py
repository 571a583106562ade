"""Application tables that a log is projected into in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.materialize import latest
from .stored import stored


class AppTable:
    """A table in a folder, its rows in hash buckets of their key.  New entries rewrite the buckets that they touch and no
    other; how far each stream has been applied is kept beside, so applying again writes nothing.

    Should a run fail between the two, the same entries are applied once more, to the same end.  Deleted rows are kept
    as such, out of sight, so that a bucket that loses all its rows is written too."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.columns = [c for c in schema.names if c not in self.keys]

    def create(self, rows: DataFrame) -> None:
        """Begin with rows, one a key; no stream has been applied."""
        self._put(rows.select(*self.schema.names).withColumn("__deleted", F.lit(False)), "static")

    def read(self) -> DataFrame:
        return self._stored().where("not __deleted").select(*self.schema.names)

    def apply(self, log: DataFrame) -> int:
        """Apply the entries (``stream_id, sequence, op``, keys and columns) beyond what was applied; returns how many
        buckets were written.  Of a key the last entry counts: upserts set all columns, deletes remove."""
        done = self._applied()
        new = log.join(done.withColumnRenamed("through", "__through"), "stream_id", "left").where(F.col("sequence") > F.coalesce("__through", F.lit(0)))
        new = stored(new.select("stream_id", "sequence", "op", *self.schema.names))
        last = latest(new, self.keys, F.desc("sequence")).withColumn("bucket", self._bucket())
        touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # numbers of buckets
        if not touched:
            return 0
        before = self._stored().where(F.col("bucket").isin(touched))
        fresh = last.select(*(F.col(k).alias(f"__{k}") for k in self.keys), F.col("op").alias("__op"), *(F.col(c).alias(f"__{c}") for c in self.columns))
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        named = F.col("__op").isNotNull()
        merged = before.join(fresh, same, "full_outer").select(
            *(F.coalesce(F.col(f"__{k}"), F.col(k)).alias(k) for k in self.keys),
            *(F.when(named, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in self.columns),
            F.when(named, F.col("__op") == "deleteRow").otherwise(F.col("__deleted")).alias("__deleted"),
        )
        self._put(stored(merged.select(*self.schema.names, "__deleted")), "dynamic")
        through = new.groupBy("stream_id").agg(F.max("sequence").alias("through")).unionByName(done).groupBy("stream_id").agg(F.max("through").alias("through"))
        stored(through).write.mode("overwrite").parquet(f"{self.path}/applied")
        return len(touched)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        every = StructType([*self.schema.fields]).add("__deleted", "boolean").add("bucket", "integer")
        return self.spark.read.schema(every).parquet(f"{self.path}/rows")

    def _applied(self) -> DataFrame:
        schema = "stream_id string, through long"
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/applied")
        return stored(self.spark.read.schema(schema).parquet(f"{self.path}/applied"))

    def _put(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/rows")
