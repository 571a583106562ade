"""Row operations held against a contract, as columns.

An operation is JSON: ``{"type": "putRow", "table", "row"}`` or ``{"type": "deleteRow",
"table", "key"}``.  The checks run in the protocol's order, on the parsed variant; the
contract, a short list of tables and columns, is unrolled into one expression.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import Contract, TableContract

REASON = "invalid-row-operation"


def _at(member: Column, *path: str) -> Column:
    return F.get_json_object(member, "$" + "".join(f"['{p}']" for p in path))


def _kind(value: Column) -> Column:
    """The JSON kind of a variant: string, number, boolean, array, object or null."""
    t = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing")
        .when(t == "VOID", "null")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _fits(value: Column, affinity: str) -> Column:
    kind = _kind(value)
    if affinity == "text":
        return kind == "string"
    if affinity in ("integer", "real"):
        return kind == "number"
    if affinity == "numeric":
        return kind.isin("number", "string")
    items = F.try_variant_get(value, "$", "array<int>")
    return (kind == "array") & F.coalesce(F.forall(items, lambda x: x.isNotNull() & (x >= 0) & (x <= 255)), F.lit(False))


def _value(document: Column, part: str, column: str) -> Column:
    return F.try_variant_get(document, f"$.{part}['{column}']", "variant")


def _put_error(document: Column, text: Column, name: str, table: TableContract) -> Column:
    keys = F.json_object_keys(_at(text, "row"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, table.columns))))
    error = F.when(keys.isNull(), f"{name}: row must be an object").when(
        F.size(unknown) > 0, F.concat(F.lit(f"{name}: unknown columns "), F.array_join(unknown, ", "))
    )
    for column, rule in table.columns.items():
        value = _value(document, "row", column)
        absent = _kind(value).isin("missing", "null")
        if not rule.nullable:
            error = error.when(absent, f"{name}.{column} must not be null")
        error = error.when(~absent & ~_fits(value, rule.affinity), f"{name}.{column} must be {rule.affinity}")
    return error


def _delete_error(document: Column, text: Column, name: str, table: TableContract) -> Column:
    keys = F.array_sort(F.json_object_keys(_at(text, "key")))
    error = F.when(keys.isNull(), f"{name}: key must be an object").when(
        keys != F.array_sort(F.array(*map(F.lit, table.primary_key))), f"{name}: key must have exactly the key columns"
    )
    for column in table.primary_key:
        error = error.when(~_fits(_value(document, "key", column), table.columns[column].affinity), f"{name}.{column} must be {table.columns[column].affinity}")
    return error


def _body(document: Column, op: Column, name: Column, contract: Contract) -> Column:
    def listed(part: str, columns: Iterable[str]) -> Column:
        items: list[Column] = []
        for n, c in enumerate(columns):
            items += [F.lit(("," if n else "{") + json.dumps(c, ensure_ascii=False) + ":"), F.coalesce(F.to_json(_value(document, part, c)), F.lit("null"))]
        return F.concat(*items, F.lit("}"))

    found = F.lit(None).cast("string")
    for table_name, table in contract.tables.items():
        body = F.when(op == "putRow", listed("row", table.columns)).otherwise(listed("key", table.primary_key))
        found = F.when(name == table_name, body).otherwise(found)
    return found


def normalize(operations: DataFrame, contract: Contract, column: str = "intent") -> DataFrame:
    """``operations`` with ``op``, ``table_name``, ``body`` (the row or key as JSON, its
    columns in the contract's order, a missing nullable one null; null where there is an error)
    and ``error`` (null where the contract allows the operation).  Null and what isn't a JSON
    object have an error."""
    text = F.col(column)
    document = F.try_parse_json(text)
    name = _at(text, "table")
    op = _at(text, "type")
    error = F.when(_kind(document) != "object", "operation must be an object").when(
        F.coalesce(F.trim(name), F.lit("")) == "", "table must be a non-empty string"
    )
    error = error.when(~name.isin(*contract.tables), F.concat(F.lit("unknown table "), name))
    for table_name, table in contract.tables.items():
        error = error.when((name == table_name) & (op == "putRow"), F.coalesce(_put_error(document, text, table_name, table), F.lit("")))
        error = error.when((name == table_name) & (op == "deleteRow"), F.coalesce(_delete_error(document, text, table_name, table), F.lit("")))
    error = error.otherwise("unknown operation type")
    return operations.withColumns(
        {
            "op": op,
            "table_name": name,
            "error": F.nullif(error, F.lit("")),
        }
    ).withColumn("body", F.when(F.col("error").isNull(), _body(document, op, name, contract)))


def rejection(error: Column) -> Column:
    """The reason of a rejected operation."""
    return F.when(error.isNotNull(), F.struct(F.lit(REASON).alias("code"), error.alias("message")))
