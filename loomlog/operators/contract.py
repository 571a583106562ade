"""Schema contracts: discovered from a catalogue, fixed by a hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, IntegralType, StringType, StructType

from ..errors import RowOperationError, SchemaDiscoveryError
from ..functions.canonical import affinity, column_value

FORMAT = 1


@dataclass(frozen=True)
class ColumnContract:
    affinity: str
    nullable: bool
    generated: bool = False


@dataclass(frozen=True)
class TableContract:
    primary_key: tuple[str, ...]
    columns: dict[str, ColumnContract]


@dataclass(frozen=True)
class Contract:
    tables: dict[str, TableContract]

    @property
    def schema_hash(self) -> str:
        """SHA-256 of the contract as JSON, tables by name and columns in their order."""
        tables = {
            name: {
                "primaryKey": list(t.primary_key),
                "columns": {c: {"affinity": x.affinity, "nullable": x.nullable, "generated": x.generated} for c, x in t.columns.items()},
            }
            for name, t in sorted(self.tables.items())
        }
        text = json.dumps({"formatVersion": FORMAT, "tables": tables}, separators=(",", ":"), ensure_ascii=False)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    def check(self) -> Contract:
        """Raise where rows can't be replicated: no key, a key that is no column, or a
        generated column."""
        for name, t in self.tables.items():
            if not t.primary_key or not set(t.primary_key) <= set(t.columns):
                raise RowOperationError(f"table {name} has no usable primary key")
            if any(c.generated for c in t.columns.values()):
                raise RowOperationError(f"table {name} has generated columns")
        return self


def from_catalogue(
    columns: DataFrame, include: Iterable[str] | None = None, exclude: Iterable[str] = (), internal: Iterable[str] = ()
) -> Contract:
    """A contract from catalogue rows ``table_name, cid, name, type, notnull, pk,
    hidden`` (a bounded list: one row a column of the schema).

    ``pk`` is the column's place in the key, 0 outside it; hidden 1 is left out, 2 and 3
    are generated.  Exclusion beats inclusion, and tables whose name begins with one of
    ``internal`` never count."""
    rows = columns.withColumn("affinity", affinity(F.col("type"))).orderBy("table_name", "cid").collect()
    wanted = None if include is None else set(include)
    by_table: dict[str, list] = {}
    for r in rows:
        hidden = any(r.table_name.startswith(p) for p in internal) or r.table_name in set(exclude)
        if not hidden and (wanted is None or r.table_name in wanted):
            by_table.setdefault(r.table_name, []).append(r)
    missing = (wanted or set()) - set(by_table) - set(exclude)
    if missing:
        raise SchemaDiscoveryError(f"no such tables: {', '.join(sorted(missing))}")
    tables = {}
    for name, cols in by_table.items():
        key = tuple(r.name for r in sorted((r for r in cols if r.pk > 0), key=lambda r: r.pk))
        if not key:
            raise SchemaDiscoveryError(f"table {name} has no primary key")
        tables[name] = TableContract(
            key, {r.name: ColumnContract(r.affinity, not r.notnull and r.pk == 0, r.hidden in (2, 3)) for r in cols if r.hidden != 1}
        )
    return Contract(tables)


def from_spark_catalogue(
    spark: SparkSession, database: str, include: Iterable[str] | None = None, exclude: Iterable[str] = (), internal: Iterable[str] = (), key_property: str = "primary_key"
) -> Contract:
    """As ``from_catalogue``, of the tables of a database in Spark's catalogue.  Spark has no keys for them, so a table's property
    ``primary_key`` names its key's columns in order, between commas.  Views count only where they are named."""
    declared = {"integer": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB", "numeric": "NUMERIC"}
    wanted = None if include is None else set(include)
    rows = []
    for t in spark.catalog.listTables(database):
        if (wanted is None and t.tableType in ("VIEW", "TEMPORARY")) or (wanted is not None and t.name not in wanted) or t.name in set(exclude):
            continue
        name = t.name if t.isTemporary else f"`{database}`.`{t.name}`"
        options = {} if t.isTemporary else {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        key = [c.strip() for c in options.get(key_property, "").split(",") if c.strip()]
        schema = spark.table(name).schema
        unknown = [c for c in key if c not in schema.names]
        if unknown:
            raise SchemaDiscoveryError(f"table {t.name} has no column {', '.join(unknown)} for its key")
        for cid, f in enumerate(schema):
            place = key.index(f.name) + 1 if f.name in key else 0
            rows.append((t.name, cid, f.name, declared[affinity_of(f.dataType)], not f.nullable, place, 0))
    columns = spark.createDataFrame(rows, "table_name string, cid int, name string, type string, notnull boolean, pk int, hidden int")
    return from_catalogue(columns, wanted, exclude, internal)


#: The type that holds a column of each affinity; a number of numeric affinity may have any size, so it stays text.
TYPES = {"integer": "bigint", "real": "double", "text": "string", "numeric": "string", "blob": "binary"}


def typed_rows(rows: DataFrame, table: TableContract, column: str = "row") -> DataFrame:
    """Rows whose ``column`` holds a row as JSON text, with the table's columns in its place, each of its affinity's type.  A
    missing member is null; a value that a column can't hold raises, and null text gives nulls."""
    value = F.parse_json(column)
    typed = []
    for name, rule in table.columns.items():
        held = column_value(F.try_variant_get(value, f"$['{name}']", "variant"), rule.affinity)
        typed.append((F.unhex(held) if rule.affinity == "blob" else held.cast(TYPES[rule.affinity])).alias(name))
    kept = [c for c in rows.columns if c != column and c not in table.columns]
    return rows.select(*kept, *typed)


def empty_tables(spark: SparkSession, contract: Contract) -> dict[str, DataFrame]:
    """The tables of a contract without rows, their columns typed by affinity: the state before any entry."""
    return {
        name: spark.createDataFrame([], ", ".join(f"`{c}` {TYPES[x.affinity]}" for c, x in t.columns.items())) for name, t in contract.check().tables.items()
    }


def affinity_of(t: DataType) -> str:
    if isinstance(t, IntegralType):
        return "integer"
    if isinstance(t, (DoubleType, FloatType)):
        return "real"
    if isinstance(t, StringType):
        return "text"
    return "blob" if isinstance(t, BinaryType) else "numeric"


def from_schema(name: str, schema: StructType, primary_key: Iterable[str]) -> Contract:
    """A contract of one DataFrame's schema with a declared key."""
    key = tuple(primary_key)
    columns = {f.name: ColumnContract(affinity_of(f.dataType), f.nullable and f.name not in key) for f in schema}
    return Contract({name: TableContract(key, columns)}).check()
