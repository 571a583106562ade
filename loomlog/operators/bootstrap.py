"""A first log from tables that exist: every row a put, in key order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BootstrapError
from ..functions.canonical import fingerprint, json_blob, json_integer, json_numeric, json_object, json_real, json_string, primary_key, put_row
from .contract import affinity_of
from .numbering import number_balanced


@dataclass(frozen=True)
class Source:
    """A table's rows, its key, and its columns as JSON."""

    rows: DataFrame
    key: Sequence[str]
    columns: Mapping[str, Column]

    @staticmethod
    def of(
        rows: DataFrame,
        key: Sequence[str],
        text: Sequence[str] = (),
        integer: Sequence[str] = (),
        real: Sequence[str] = (),
        numeric: Sequence[str] = (),
        blob: Sequence[str] = (),
    ) -> Source:
        columns = {c: json_string(F.col(c)) for c in text} | {c: json_integer(F.col(c)) for c in integer}
        columns |= {c: json_real(F.col(c)) for c in real} | {c: json_blob(F.col(c)) for c in blob}
        columns |= {c: json_numeric(F.col(c), rows.schema[c].dataType.simpleString()) for c in numeric}
        return Source(rows, key, columns)

    @staticmethod
    def by_schema(rows: DataFrame, key: Sequence[str]) -> Source:
        """All columns, with the affinities of their types."""
        of: dict[str, list[str]] = {}
        for f in rows.schema:
            of.setdefault(affinity_of(f.dataType), []).append(f.name)
        return Source.of(rows, key, **of)


def key_json(source: Source) -> Column:
    return primary_key([source.columns[c] for c in source.key])


def bootstrap_id(prefix: str, table: Column, key: Column) -> Column:
    """``prefix:table:sha256(canonical {key, table})``."""
    return F.concat_ws(":", F.lit(prefix), table, F.sha2(json_object({"key": key, "table": json_string(table)}), 256))


def operations(sources: Mapping[str, Source], tables: Sequence[str] | None = None) -> DataFrame:
    """``table_name, pk, operation`` of the rows of the chosen tables (all)."""
    out = None
    for name in sorted(set(tables if tables is not None else sources)):
        s = sources[name]
        part = s.rows.select(
            F.lit(name).alias("table_name"),
            key_json(s).alias("pk"),
            put_row(F.lit(name), json_object(s.columns)).alias("operation"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table to read")
    return out


def history(sources: Mapping[str, Source], prefix: str, tables: Sequence[str] | None = None, log: DataFrame | None = None) -> DataFrame:
    """``sequence, table_name, pk, operation_id, intent_hash, operation``: a dense log
    in the order of table and key.  A ``log`` that has entries is refused."""
    if log is not None and not log.isEmpty():
        raise BootstrapError("the log already has entries")
    rows = operations(sources, tables)
    rows = rows.withColumns(
        {
            "operation_id": bootstrap_id(prefix, F.col("table_name"), F.col("pk")),
            "intent_hash": fingerprint(F.col("operation")),
            "__all": F.lit(1),
        }
    )
    return number_balanced(rows, ["__all"], ["table_name", "pk"], "sequence").drop("__all")
