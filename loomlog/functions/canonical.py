"""Canonical JSON, fingerprints, keys and affinities as Column expressions."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import InvalidJsonValueError

SAFE_INTEGER = (1 << 53) - 1


def _number(x: float | int) -> str:
    """As ECMAScript prints a number."""
    if isinstance(x, int) and abs(x) <= SAFE_INTEGER:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        raise InvalidJsonValueError("a number must be finite") from None
    if not math.isfinite(x):
        raise InvalidJsonValueError("a number must be finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if len(text) <= point <= 21:
        text += "0" * (point - len(text))
    elif 0 < point <= 21:
        text = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{text}"
    else:
        mantissa = text if len(text) == 1 else f"{text[0]}.{text[1:]}"
        text = f"{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def _text(x: str) -> str:
    """As ECMAScript writes a string: half a surrogate pair, which has no UTF-8, as an escape."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, ensure_ascii=False))


def canonical(value: object) -> str:
    """Canonical JSON of a Python value: keys sorted by UTF-16 code units, no spaces."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise InvalidJsonValueError("keys must be strings")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, Sequence) and not isinstance(value, (bytes, bytearray)):
        return "[" + ",".join(map(canonical, value)) + "]"
    raise InvalidJsonValueError(f"no JSON form of {type(value).__name__}")


def canonical_text(text: str | None) -> str | None:
    """Canonical form of JSON text; null for null and for what isn't JSON."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return None if text is None else canonical(json.loads(text, parse_constant=refuse))
    except (ValueError, InvalidJsonValueError, RecursionError):
        return None


def canonical_json(text: Column) -> Column:
    """``canonical_text`` of a column: for payloads of any shape.  Rows of known columns
    take ``json_object``, which stays in the JVM."""

    @F.arrow_udf(StringType())
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([canonical_text(t) for t in batch.to_pylist()], pa.string())

    return run(text)


def json_string(c: Column) -> Column:
    quoted = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def json_integer(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_real(c: Column) -> Column:
    """A double as ECMAScript prints it.  Null is null; what isn't finite has no form in
    JSON and fails."""

    @F.arrow_udf(StringType())
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(["null" if x is None else _number(x) for x in batch.to_pylist()], pa.string())

    return run(c.cast("double"))


def json_numeric(c: Column, kind: str) -> Column:
    """A column of numeric affinity: numbers as numbers, text as text."""
    if kind == "string":
        return json_string(c)
    return json_integer(c) if kind in ("tinyint", "smallint", "int", "bigint") else json_real(c)


def json_blob(c: Column) -> Column:
    """A binary value as the array of its bytes."""
    listed = F.concat(F.lit("["), F.concat_ws(",", bytes_of(c).cast("array<string>")), F.lit("]"))
    return F.when(c.isNull(), "null").otherwise(listed)


def column_value(value: Column, affinity: str) -> Column:
    """What a column of an affinity holds for a JSON value (a variant), as text, or, of a
    blob, as hexadecimal digits: the inverse of the forms above.  Null for null; a value that
    no column can hold (a boolean, an object, an array that isn't bytes) raises."""
    kind = F.schema_of_variant(value)
    if affinity == "blob":
        items = F.try_variant_get(value, "$", "array<int>")
        bytes_ = F.coalesce(F.forall(items, lambda x: x.isNotNull() & (x >= 0) & (x <= 255)), F.lit(False))
        hexed = F.array_join(F.transform(items, lambda x: F.lpad(F.hex(x), 2, "0")), "")
        held, refused = hexed, ~bytes_
    else:
        held = F.try_variant_get(value, "$", "string")
        refused = (kind == "BOOLEAN") | kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(value.isNull() | (kind == "VOID"), None).when(refused, F.raise_error(F.lit(f"no value of {affinity} affinity"))).otherwise(held)


def json_object(members: Mapping[str, Column]) -> Column:
    """Canonical JSON of an object from columns that are JSON already."""
    keys = sorted(members, key=lambda k: k.encode("utf-16-be"))
    parts: list[Column] = []
    for n, k in enumerate(keys):
        parts += [F.lit(("," if n else "{") + json.dumps(k, ensure_ascii=False) + ":"), members[k]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def json_array(items: Sequence[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def primary_key(items: Sequence[Column]) -> Column:
    """The key of a row: canonical JSON of the values in the contract's order."""
    return json_array(items)


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def put_row(table: Column, row: Column) -> Column:
    return json_object({"type": F.lit('"putRow"'), "table": json_string(table), "row": row})


def delete_row(table: Column, key: Column) -> Column:
    return json_object({"type": F.lit('"deleteRow"'), "table": json_string(table), "key": key})


def affinity(declared: Column) -> Column:
    """The affinity of a declared type: the first rule that holds."""
    t = F.upper(F.trim(F.coalesce(declared, F.lit(""))))

    def has(*parts: str) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | t.contains(p)
        return found

    return (
        F.when(has("INT"), "integer")
        .when(has("CHAR", "CLOB", "TEXT"), "text")
        .when((t == "") | has("BLOB"), "blob")
        .when(has("REAL", "FLOA", "DOUB"), "real")
        .otherwise("numeric")
    )


def retry_delay_ms(attempt: Column, base: int = 120, most: int = 2000, jitter: Column | None = None) -> Column:
    """The pause before a retry: doubling up to a limit, and up to ``base`` at random."""
    pause = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))
    return pause + F.floor((F.rand() if jitter is None else jitter) * base)


def bytes_of(blob: Column) -> Column:
    """A binary value as the list of its bytes, which is its form in JSON."""
    hexed = F.hex(blob)
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.length(blob)), lambda i: i < F.length(blob)),
        lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )


def operation_id(prefix: str = "op") -> Column:
    """A fresh id; write the rows before using it twice."""
    return F.concat(F.lit(f"{prefix}_"), F.uuid())
