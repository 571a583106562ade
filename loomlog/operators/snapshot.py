"""Logs and decisions kept as tables, and read back only if they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MalformedResponseError, SchemaMismatchError
from .contract import Contract
from .validate import density, repeats, snapshot_violations


def save(log: DataFrame, decisions: DataFrame, path: str) -> None:
    """Write both as Parquet, a folder for each stream, so that a stream's page or state
    reads its own files only."""
    for name, rows in (("log", log), ("decisions", decisions)):
        rows.repartition("stream_id").sortWithinPartitions("stream_id", "sequence").write.mode("overwrite").partitionBy(
            "stream_id"
        ).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Log and decisions; raises where they aren't one to one, the log isn't dense, or an operation id or client
    position is there twice."""
    log, decisions = (spark.read.parquet(f"{path}/{name}") for name in ("log", "decisions"))
    bad = snapshot_violations(log, decisions).first()
    if bad:
        raise MalformedResponseError(f"{bad['stream_id']} {bad['operation_id']}: {bad['violation']}")
    for bad in (density(log).first(), repeats(log).first(), repeats(decisions).first()):
        if bad:
            raise MalformedResponseError(f"{bad['stream_id']}: {bad['violation'] if 'violation' in bad else bad['kind'] + ' ' + bad['key'] + ' repeated'}")
    return log, decisions


def empty_state(contract: Contract) -> dict:
    """The state before any entry: each table of the contract without rows, bound to its hash."""
    return {"schemaHash": contract.check().schema_hash, "tables": {name: {} for name in contract.tables}}


def check_bound(streams: DataFrame, contract: Contract) -> None:
    """Raise where a stream (``stream_id, schema_hash``) is bound to another contract:
    a binding is for good."""
    other = streams.where(F.col("schema_hash") != contract.schema_hash).first()
    if other:
        raise SchemaMismatchError(f"stream {other['stream_id']} is bound to {other['schema_hash']}")
