"""Request and response envelopes as JSON text, both ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import SAFE_INTEGER, json_integer, json_object, json_string
from ..operators.validate import ENTRIES, PROPOSALS

VERSION = 1
PROPOSAL = "operationId string, clientId string, clientSequence bigint, intentHash string, intent string"
REQUEST = (
    "protocolVersion int, streamId string, "
    f"request struct<baseSequence: bigint, maximumEntries: bigint, proposals: array<struct<{PROPOSAL}>>>"
)
ENTRY = "sequence bigint, operationId string, origin struct<clientId: string, clientSequence: bigint, intentHash: string>, operation string"
DECISION = "operationId string, status string, sequence bigint, operation string, reason string"
RESPONSE = (
    "protocolVersion int, streamId string, response struct<requestedBaseSequence: bigint, throughSequence: bigint, "
    f"headSequence: bigint, entries: array<struct<{ENTRY}>>, decisions: array<struct<{DECISION}>>>"
)


def _ordered(json: Column, by: str) -> Column:
    """An array of a group's JSON objects in order.  A request has at most 64 proposals
    and a page 256 entries, which bounds the list."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), json.alias("j")))), lambda x: x["j"]), ","), F.lit("]")
    )


def encode_requests(proposals: DataFrame) -> DataFrame:
    """``request_id, envelope`` from rows ``request_id, stream_id, base_sequence,
    maximum_entries, proposal_ord, operation_id, client_id, client_sequence,
    intent_hash, intent`` (``intent`` canonical JSON)."""
    one = json_object(
        {
            "operationId": json_string(F.col("operation_id")),
            "clientId": json_string(F.col("client_id")),
            "clientSequence": json_integer(F.col("client_sequence")),
            "intentHash": json_string(F.col("intent_hash")),
            "intent": F.col("intent"),
        }
    )
    grouped = proposals.groupBy("request_id", "stream_id", "base_sequence", "maximum_entries").agg(_ordered(one, "proposal_ord").alias("proposals"))
    request = json_object(
        {"baseSequence": json_integer(F.col("base_sequence")), "maximumEntries": json_integer(F.col("maximum_entries")), "proposals": F.col("proposals")}
    )
    return grouped.select("request_id", _envelope(F.col("stream_id"), "request", request).alias("envelope"))


def _envelope(stream: Column, name: str, body: Column) -> Column:
    return json_object({"protocolVersion": F.lit(str(VERSION)), "streamId": json_string(stream), name: body})


def encode_responses(pages: DataFrame, entries: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``stream_id, page, envelope`` from pages (``stream_id, page, base_sequence,
    through_sequence, head_sequence``), their entries (``stream_id, page, sequence,
    operation_id, client_id, client_sequence, intent_hash, operation``) and decisions
    (``stream_id, page, decision_ord, operation_id, status, sequence, operation, reason``;
    ``operation`` and ``reason`` canonical JSON).  Entries and decisions of other pages are left out before any list is
    gathered, since only those of a page are few."""
    asked = pages.select("stream_id", "page")
    origin = json_object(
        {
            "clientId": json_string(F.col("client_id")),
            "clientSequence": json_integer(F.col("client_sequence")),
            "intentHash": json_string(F.col("intent_hash")),
        }
    )
    one = json_object(
        {
            "sequence": json_integer(F.col("sequence")),
            "operationId": json_string(F.col("operation_id")),
            "origin": origin,
            "operation": F.col("operation"),
        }
    )
    lists = entries.join(asked, ["stream_id", "page"], "left_semi").groupBy("stream_id", "page").agg(_ordered(one, "sequence").alias("listed"))
    response = json_object(
        {
            "requestedBaseSequence": json_integer(F.col("base_sequence")),
            "throughSequence": json_integer(F.col("through_sequence")),
            "headSequence": json_integer(F.col("head_sequence")),
            "entries": F.coalesce("listed", F.lit("[]")),
            "decisions": F.coalesce("decided", F.lit("[]")) if decisions is not None else F.lit("[]"),
        }
    )
    rows = pages.join(lists, ["stream_id", "page"], "left")
    if decisions is not None:
        common = {"operationId": json_string(F.col("operation_id")), "status": json_string(F.col("status"))}
        accepted = json_object(common | {"sequence": json_integer(F.col("sequence")), "operation": F.col("operation")})
        rejected = json_object(common | {"reason": F.col("reason")})
        item = F.when(F.col("status") == "accepted", accepted).otherwise(rejected)
        told = decisions.join(asked, ["stream_id", "page"], "left_semi").groupBy("stream_id", "page").agg(_ordered(item, "decision_ord").alias("decided"))
        rows = rows.join(told, ["stream_id", "page"], "left")
    return rows.select(
        "stream_id", "page", _envelope(F.col("stream_id"), "response", response).alias("envelope")
    )


def _parsed(texts: DataFrame, schema: str) -> DataFrame:
    parsed = texts.withColumn("parsed", F.from_json("envelope", schema, {"mode": "PERMISSIVE"}))
    error = (
        F.when(F.col("parsed").isNull() | F.col("parsed.protocolVersion").isNull(), "wire-decode")
        .when(F.col("parsed.protocolVersion") != VERSION, "unsupported-protocol-version")
        .when(F.coalesce(F.length("parsed.streamId"), F.lit(0)) == 0, "wire-decode")
    )
    return parsed.withColumn("error", error)


def decode_requests(texts: DataFrame) -> DataFrame:
    """Proposals of envelopes, a row each, in order; an envelope that can't be read, or
    of another version, is one row with ``error``."""
    rows = _parsed(texts, REQUEST)
    p = F.col("item")
    return rows.select(
        *texts.drop("envelope").columns,
        "error",
        F.col("parsed.streamId").alias("stream_id"),
        F.col("parsed.request.baseSequence").alias("base_sequence"),
        F.col("parsed.request.maximumEntries").alias("maximum_entries"),
        F.posexplode_outer("parsed.request.proposals").alias("proposal_ord", "item"),
    ).select(
        "*",
        p["operationId"].alias("operation_id"),
        p["clientId"].alias("client_id"),
        p["clientSequence"].alias("client_sequence"),
        p["intentHash"].alias("intent_hash"),
        p["intent"].alias("intent"),
    ).drop("item")


def decode_responses(texts: DataFrame) -> DataFrame:
    """Entries of response envelopes, a row each, with the page's cursors."""
    rows = _parsed(texts, RESPONSE)
    e = F.col("item")
    return rows.select(
        *texts.drop("envelope").columns,
        "error",
        F.col("parsed.streamId").alias("of_stream"),
        F.col("parsed.response.requestedBaseSequence").alias("base_sequence"),
        F.col("parsed.response.throughSequence").alias("through_sequence"),
        F.col("parsed.response.headSequence").alias("head_sequence"),
        F.explode_outer("parsed.response.entries").alias("item"),
    ).select(
        "*",
        e["sequence"].alias("sequence"),
        e["operationId"].alias("operation_id"),
        e["origin"]["clientId"].alias("client_id"),
        e["origin"]["clientSequence"].alias("client_sequence"),
        e["origin"]["intentHash"].alias("intent_hash"),
        e["operation"].alias("operation"),
    ).drop("item")


def decode_decisions(texts: DataFrame) -> DataFrame:
    """Decisions of response envelopes, a row each in order, with ``error`` where the envelope
    can't be read or a decision is neither an accepted nor a rejected one, and ``error_path``."""
    rows = _parsed(texts, RESPONSE)
    d = F.col("item")
    whole = (
        (F.length(d["operationId"]) > 0)
        & F.when(d["status"] == "accepted", d["sequence"].isNotNull() & d["operation"].isNotNull())
        .when(d["status"] == "rejected", d["reason"].isNotNull())
        .otherwise(False)
    )
    bad = F.col("error").isNull() & d.isNotNull() & ~F.coalesce(whole, F.lit(False))
    return (
        rows.select(
            *texts.drop("envelope").columns,
            "error",
            F.col("parsed.streamId").alias("of_stream"),
            F.col("parsed.response.headSequence").alias("head_sequence"),
            F.posexplode_outer("parsed.response.decisions").alias("decision_ord", "item"),
        )
        .withColumn("error_path", F.when(bad, F.format_string("$.response.decisions[%d]", "decision_ord")).when(F.col("error").isNotNull(), "$"))
        .withColumn("error", F.when(bad, "wire-decode").otherwise(F.col("error")))
        .select(
            "*",
            d["operationId"].alias("operation_id"),
            d["status"].alias("status"),
            d["sequence"].alias("sequence"),
            d["operation"].alias("operation"),
            d["reason"].alias("reason"),
        )
        .drop("item")
    )


# Strict decoding: the first rule that an envelope breaks, in the protocol's order, with its JSON path.


def _member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _error(code: str, path: Column, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(message).alias("message"))


def _when(condition: Column, code: str, path: Column, message: str) -> Column:
    """The error where the condition holds; null counts as not."""
    return F.when(condition, _error(code, path, message))


def _object(value: Column, path: Column) -> Column:
    return _when(F.try_variant_get(value, "$", "map<string,variant>").isNull(), "wire-decode", path, "must be an object")


def _list(value: Column, path: Column) -> Column:
    return _when(F.try_variant_get(value, "$", "array<variant>").isNull(), "wire-decode", path, "must be an array")


def _text(value: Column, path: Column) -> Column:
    plain = F.schema_of_variant(value).eqNullSafe(F.lit("STRING"))
    return F.coalesce(_when(~plain, "wire-decode", path, "must be a string"), _when(F.try_variant_get(value, "$", "string") == "", "wire-decode", path, "must not be empty"))


def _number(value: Column, path: Column) -> Column:
    plain = F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    return _when(~plain, "wire-decode", path, "must be a number")


def _payload(value: Column, path: Column) -> Column:
    return _when(value.isNull(), "wire-decode", path, "payload codec rejected the value")


def _whole(value: Column) -> Column:
    """A safe integer, or null; ``1.0`` is one."""
    held = F.try_variant_get(value, "$", "decimal(38,6)")
    return F.when((held == F.floor(held)) & (F.abs(held) <= SAFE_INTEGER), held.cast("long"))


def _sequence(number: Column, path: Column, least: int, code: str = "invalid-sequence") -> Column:
    return _when(~F.coalesce(number >= least, F.lit(False)), code, path, f"must be a safe integer from {least}")


def _under(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def _at(path: str, n: Column) -> Column:
    return F.concat(F.lit(f"{path}["), n.cast("string"), F.lit("]"))


def _first(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def _envelope_errors(value: Column, name: str) -> list[Column]:
    version = _member(value, "$.protocolVersion")
    known = F.coalesce(_number(version, F.lit("")).isNull() & (_whole(version) == VERSION), F.lit(False))
    return [
        _object(value, F.lit("$")),
        _when(~known, "unsupported-protocol-version", F.lit("$.protocolVersion"), "another version"),
        _text(_member(value, "$.streamId"), F.lit("$.streamId")),
        _object(_member(value, f"$.{name}"), F.lit(f"$.{name}")),
    ]


def _items(value: Column, path: str, shape: Callable[[Column, Column], Column], **members: Callable[[Column], Column]) -> Column:
    """The items of a list, each as the first rule of its shape that it breaks and the members named.  It must be a column of
    its own before it is used, so that the list is walked once."""
    listed = F.try_variant_get(value, path, "array<variant>")
    return F.transform(listed, lambda x, n: F.struct(shape(x, _at(path, n)).alias("error"), *(f(x).alias(c) for c, f in members.items())))


def _string(path: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, path, "string")


def _integer(path: str) -> Callable[[Column], Column]:
    return lambda x: _whole(_member(x, path))


def _numbers(value: Column, names: list[str]) -> list[Column]:
    return [_number(_member(value, c), F.lit(c)) for c in names]


def _twice(items: str, member: str, mine: Column, n: Column) -> Column:
    """Whether an earlier item has the same member; lists are as short as the limits have them."""
    return F.array_position(F.col(f"{items}.{member}"), mine) <= n


def request_errors(texts: DataFrame, most: int = PROPOSALS) -> DataFrame:
    """Rows with ``envelope`` (text) and ``code, path, message`` of the first rule of a request that each breaks (null: none).
    What isn't JSON, null included, is no object."""
    value, at, items = F.col("__value"), "$.request.proposals", F.col("__proposals")
    cursors = ["$.request.baseSequence", "$.request.maximumEntries"]

    def shape(p: Column, path: Column) -> Column:
        return F.coalesce(
            _object(p, path),
            _text(_member(p, "$.operationId"), _under(path, "operationId")),
            _text(_member(p, "$.clientId"), _under(path, "clientId")),
            _number(_member(p, "$.clientSequence"), _under(path, "clientSequence")),
            _text(_member(p, "$.intentHash"), _under(path, "intentHash")),
            _payload(_member(p, "$.intent"), _under(path, "intent")),
        )

    def batch(p: Column, n: Column) -> Column:
        sequence = _under(_at(at, n), "clientSequence")
        falls = F.exists(F.slice(items, F.lit(1), n), lambda b: (b["client"] == p["client"]) & (b["place"] >= p["place"]))
        return F.coalesce(
            _sequence(p["place"], sequence, 1),
            _when(_twice("__proposals", "id", p["id"], n), "duplicate-operation-id", _under(_at(at, n), "operationId"), "twice in a request"),
            _when(falls, "proposal-order", sequence, "must rise"),
        )

    base, limit = (_whole(_member(value, c)) for c in cursors)
    error = F.coalesce(
        *_envelope_errors(value, "request"),
        _list(_member(value, at), F.lit(at)),
        _when(F.size(items) > most, "protocol-limit", F.lit(at), f"more than {most} items"),
        _first(items["error"]),
        *_numbers(value, cursors),
        _sequence(base, F.lit(cursors[0]), 0),
        _sequence(limit, F.lit(cursors[1]), 1, "invalid-limit"),
        _first(F.transform(items, batch)),
    )
    parsed = texts.withColumn("__value", F.try_parse_json("envelope"))
    parsed = parsed.withColumn("__proposals", _items(value, at, shape, id=_string("$.operationId"), client=_string("$.clientId"), place=_integer("$.clientSequence")))
    return _told(texts, parsed, error)


def response_errors(texts: DataFrame, most_entries: int = ENTRIES, most_decisions: int = PROPOSALS, asked: str | None = None) -> DataFrame:
    """As ``request_errors``, of responses, whose page and decisions are held against the cursors
    and each other too, and, last, whose stream against that of a column ``asked``."""
    value, entries, decisions = F.col("__value"), F.col("__entries"), F.col("__decisions")
    at_entries, at_decisions = "$.response.entries", "$.response.decisions"
    cursors = [f"$.response.{c}" for c in ("requestedBaseSequence", "throughSequence", "headSequence")]

    def entry(e: Column, path: Column) -> Column:
        return F.coalesce(
            _object(e, path),
            _object(_member(e, "$.origin"), _under(path, "origin")),
            _number(_member(e, "$.sequence"), _under(path, "sequence")),
            _text(_member(e, "$.operationId"), _under(path, "operationId")),
            _text(_member(e, "$.origin.clientId"), _under(path, "origin.clientId")),
            _number(_member(e, "$.origin.clientSequence"), _under(path, "origin.clientSequence")),
            _text(_member(e, "$.origin.intentHash"), _under(path, "origin.intentHash")),
            _payload(_member(e, "$.operation"), _under(path, "operation")),
        )

    def decision(d: Column, path: Column) -> Column:
        status = F.try_variant_get(d, "$.status", "string")
        accepted = F.coalesce(_number(_member(d, "$.sequence"), _under(path, "sequence")), _payload(_member(d, "$.operation"), _under(path, "operation")))
        return F.coalesce(
            _object(d, path),
            _text(_member(d, "$.operationId"), _under(path, "operationId")),
            F.when(status == "accepted", accepted)
            .when(status == "rejected", _payload(_member(d, "$.reason"), _under(path, "reason")))
            .otherwise(_error("wire-decode", _under(path, "status"), 'must be either "accepted" or "rejected"')),
        )

    base, through, head = (F.col(f"__{n}") for n in range(3))

    def malformed(condition: Column, path: Column, message: str) -> Column:
        return _when(condition, "malformed-response", path, message)

    def placed(e: Column, n: Column) -> Column:
        path = _at(at_entries, n)
        return F.coalesce(
            _sequence(e["at"], _under(path, "sequence"), 1),
            _sequence(e["place"], _under(path, "origin.clientSequence"), 1),
            malformed(e["at"] != base + n + 1, _under(path, "sequence"), "entries must be contiguous"),
            malformed(_twice("__entries", "id", e["id"], n), _under(path, "operationId"), "repeats an operation"),
            malformed(_twice("__entries", "position", e["position"], n), _under(path, "origin"), "repeats a client position"),
        )

    def told(d: Column, n: Column) -> Column:
        path, accepted = _at(at_decisions, n), d["status"] == "accepted"
        # Entries are dense by now, so where one stands is its sequence.
        found = F.array_position(F.col("__entries.id"), d["id"])
        return F.coalesce(
            malformed(_twice("__decisions", "id", d["id"], n), _under(path, "operationId"), "repeats a decision"),
            F.when(accepted, _sequence(d["at"], _under(path, "sequence"), 1)),
            malformed(accepted & (d["at"] > head), _under(path, "sequence"), "beyond the head"),
            malformed(accepted & (found > 0) & (base + found != d["at"]), _under(path, "sequence"), "disagrees with its entry"),
            malformed(~accepted & (found > 0), path, "rejected, but in the page"),
        )

    size = F.size(entries)
    error = F.coalesce(
        *_envelope_errors(value, "response"),
        _list(_member(value, at_entries), F.lit(at_entries)),
        _list(_member(value, at_decisions), F.lit(at_decisions)),
        _when(size > most_entries, "protocol-limit", F.lit(at_entries), f"more than {most_entries} items"),
        _when(F.size(decisions) > most_decisions, "protocol-limit", F.lit(at_decisions), f"more than {most_decisions} items"),
        _first(entries["error"]),
        _first(decisions["error"]),
        *_numbers(value, cursors),
        *(_sequence(c, F.lit(path), 0) for c, path in zip((base, through, head), cursors)),
        malformed(base > through, F.lit(cursors[0]), "greater than throughSequence"),
        malformed(through > head, F.lit(cursors[1]), "greater than headSequence"),
        malformed(size != through - base, F.lit(at_entries), "does not match the declared page"),
        malformed((base < head) & (size == 0), F.lit(cursors[1]), "must advance"),
        _first(F.transform(entries, placed)),
        _first(F.transform(decisions, told)),
        *([malformed(F.try_variant_get(value, "$.streamId", "string") != F.col(asked), F.lit("$.streamId"), "another stream")] if asked else []),
    )
    position = lambda e: F.to_json(F.struct(F.try_variant_get(e, "$.origin.clientId", "string"), _integer("$.origin.clientSequence")(e)))
    parsed = texts.withColumn("__value", F.try_parse_json("envelope")).withColumns(
        {
            "__entries": _items(value, at_entries, entry, id=_string("$.operationId"), at=_integer("$.sequence"), place=_integer("$.origin.clientSequence"), position=position),
            "__decisions": _items(value, at_decisions, decision, id=_string("$.operationId"), status=_string("$.status"), at=_integer("$.sequence")),
            **{f"__{n}": _whole(_member(value, c)) for n, c in enumerate(cursors)},
        }
    )
    return _told(texts, parsed, error)


def _told(texts: DataFrame, parsed: DataFrame, error: Column) -> DataFrame:
    found = parsed.withColumn("__error", error)
    return found.select(*texts.columns, *(F.col(f"__error.{c}").alias(c) for c in ("code", "path", "message")))
