"""The log operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import bootstrap as B
from ..operators import contract as K
from ..operators import decide as D
from ..operators import materialize as M
from ..operators import merge as G
from ..operators import normalize as N
from ..operators import pages as P
from ..operators import replica as R
from ..operators import requests as Q
from ..operators import synchronize as Y
from ..operators import validate as V
from ..operators.numbering import number_balanced
from ..sources import tables as T
from ..sources import wire as W
from ..sources.app_table import AppTable
from ..sources.checkpoints import StateCheckpoints
from ..sources.stored import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

E_ID = "event_id"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _requests(rows: DataFrame) -> DataFrame:
    number = F.floor((F.col("client_sequence") - 1) / V.PROPOSALS).cast("string")
    return rows.withColumn("request_id", F.concat("client_id", F.lit("-"), number))


# Proposals and decisions


@query
def proposals_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.proposals(spark, sf_dir).select("operation_id", "client_id", "client_sequence")


@query
def proposal_batch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On requests in which some proposals repeat and some positions went back."""
    rows = _requests(T.proposals(spark, sf_dir)).withColumn("proposal_ord", F.col("client_sequence") * 2)
    again = rows.where(F.col(E_ID) % 50 == 0).withColumn("proposal_ord", F.col("proposal_ord") + 1)
    back = F.when(F.col(E_ID) % 70 == 0, F.col("client_sequence") - 3).otherwise(F.col("client_sequence"))
    return V.batch_violations(rows.withColumn("client_sequence", back).unionByName(again))


@query
def request_limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's proposals by the first digit of their number as one request."""
    requests = (
        T.proposals(spark, sf_dir)
        .groupBy(F.concat("client_id", F.lit("-"), F.substring("operation_id", 4, 1)).alias("request_id"), "stream_id")
        .agg(F.count("*").alias("proposals"))
        .withColumns({"base_sequence": F.lit(0), "maximum_entries": F.lit(V.ENTRIES), "head_sequence": F.lit(0)})
    )
    return V.request_violations(requests, 8)


@query
def decide_row_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = T.reason()
    status = F.when(reason.isNull(), "accepted").otherwise("rejected")
    return T.proposals(spark, sf_dir, positions=False).select("operation_id", status.alias("status"), reason.alias("reason"))


@query
def canonical_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.log(spark, sf_dir, positions=False).select("stream_id", "sequence", "operation_id")


@query
def decisions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.decisions(spark, sf_dir).select("stream_id", "operation_id", "status", "sequence", "reason")


@query
def continued_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd events decided after the even ones: numbers go on from the heads."""
    rows = T.proposals(spark, sf_dir)
    order = ["ts", E_ID]
    first = D.decide(rows.where(F.col(E_ID) % 2 == 0), T.reason(), order)
    heads = P.heads(first.where("status = 'accepted'"))
    then = D.decide(rows.where(F.col(E_ID) % 2 == 1), T.reason(), order, heads)
    return first.unionByName(then).where("status = 'accepted'").select("stream_id", "sequence", "operation_id")


@query
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposal sent again."""
    rows = T.stored_decisions(spark, sf_dir)
    found = D.classify(rows.drop("status", "sequence", "reason"), rows).where(F.col("class") == D.REPLAY)
    return found.select("operation_id", "status", "sequence")


ATTEMPT = ("stream_id", "operation_id", "client_id", "client_sequence", "intent_hash", E_ID)


def _attempts(decided: DataFrame, *more: str) -> DataFrame:
    """Proposals sent again, some changed; ``variant`` tells which."""
    rows = decided.select(*ATTEMPT, *more)
    changed = rows.where(F.col(E_ID) % 101 == 0).withColumn("intent_hash", F.lit("changed"))
    moved = rows.where(F.col(E_ID) % 103 == 0).withColumn("client_sequence", F.col("client_sequence") + 1)
    other = rows.where(F.col(E_ID) % 107 == 0).withColumn("operation_id", F.concat("operation_id", F.lit("-x")))
    fresh = rows.where(F.col(E_ID) % 109 == 0).withColumns(
        {"operation_id": F.concat("operation_id", F.lit("-y")), "client_id": F.concat("client_id", F.lit("-n"))}
    )
    out = rows.where(F.col(E_ID) % 2 == 0).withColumn("variant", F.lit(0))
    for n, part in enumerate((changed, moved, other, fresh)):
        out = out.unionByName(part.withColumn("variant", F.lit(n + 1)))
    return out


@query
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.stored_decisions(spark, sf_dir)
    return D.classify(_attempts(known), known).groupBy("class").agg(F.count("*").alias("n"))


@query
def http_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a route answers to each attempt."""
    known = T.stored_decisions(spark, sf_dir)
    found = D.classify(_attempts(known), known)
    conflict = F.col("class").isin(D.IDENTITY, D.INTENT, D.POSITION)
    return found.select(
        "operation_id", F.when(conflict, 409).otherwise(200).alias("http_status"), F.when(conflict, F.col("class")).alias("code")
    )


@query
def client_position_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(T.proposals(spark, sf_dir).select(*ATTEMPT))
    return V.position_conflicts(_attempts(rows).drop("variant").unionByName(rows))


@query
def decide_batch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch held against decisions on a fifth of the events and against itself; a client's
    proposals are a request."""
    rows = T.stored_decisions(spark, sf_dir)
    found = D.settle(_attempts(rows), rows.where(F.col(E_ID) % 5 == 0), [E_ID, "variant"], "client_id")
    return found.select("operation_id", "variant", "class", "status", "sequence")


@query
def decide_requests_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts in requests of up to eight positions, held against decisions on a fifth of the
    events: one conflict refuses a request, and what it named is free again."""
    rows = T.stored_decisions(spark, sf_dir)
    batch = _in_requests(_attempts(rows)).withColumns({"proposal_ord": F.col(E_ID), "base_sequence": F.lit(0)})
    known = rows.where(F.col(E_ID) % 5 == 0)
    reason = F.when(F.col(E_ID) % 6 == 4, "sixth")
    told = Q.decide_requests(batch, known, reason, P.heads(known))
    return told.select("request_id", "operation_id", "variant", "class", "status", "sequence", "reason")


def _in_requests(attempts: DataFrame) -> DataFrame:
    """Attempts in requests of up to eight positions of a client and variant, in the order of their first events."""
    eighth = F.floor(F.col("client_sequence") / 8).cast("string")
    first = F.min(F.col(E_ID) * 8 + F.col("variant")).over(Window.partitionBy("stream_id", "request_id"))
    return attempts.withColumn("request_id", F.concat_ws("-", "client_id", "variant", eighth)).withColumn("request_ord", first)


@query
def synchronize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as envelopes, some of another version, some with a base beyond the head, answered
    with pages of ten; what each response holds, and whether it breaks a rule."""
    rows = stored(T.stored_decisions(spark, sf_dir).withColumns({"user": F.col("user_id").cast("int")}))
    text, integer = K.ColumnContract("text", False), K.ColumnContract("integer", False)
    contract = K.Contract({"user_state": K.TableContract(("user_id",), {"user_id": integer, "event_type": text})}).check()
    name, user = F.lit("user_state"), F.col("user")
    put = C.put_row(name, C.json_object({"event_type": C.json_string(F.col("col_type")), "user_id": C.json_integer(user)}))
    intent = F.when(F.col("op") == "putRow", put).otherwise(C.delete_row(name, C.json_object({"user_id": C.json_integer(user)})))
    base = F.when(user % 29 == 7, F.lit(1 << 40)).when(user % 3 == 0, 5).otherwise(0)
    batch = _in_requests(_attempts(rows, "op", "col_type", "user")).withColumns(
        {"proposal_ord": F.col(E_ID), "base_sequence": base, "maximum_entries": F.lit(10), "intent": intent}
    )
    odd = F.regexp_extract("request_id", r"^c(\d+)-", 1).cast("int") % 31 == 4
    version = F.replace("envelope", F.lit('"protocolVersion":1'), F.lit('"protocolVersion":2'))
    texts = W.encode_requests(batch).withColumn("envelope", F.when(odd, version).otherwise(F.col("envelope")))
    ords = batch.groupBy("request_id").agg(F.first("request_ord").alias("request_ord"))
    known = rows.where(F.col(E_ID) % 5 == 0).withColumns({"operation": F.lit("{}"), "reason": F.lit('"why"')})
    held = known.where("status = 'accepted'")
    # The log that those decisions made is dense by itself.
    log = stored(number_balanced(held.drop("sequence"), ["stream_id"], ["ts", E_ID], "sequence"))
    known = known.drop("sequence").join(log.select("operation_id", "sequence"), "operation_id", "left")
    done = Y.synchronize(texts.join(ords, "request_id"), log, known, contract)
    answers = stored(done.answers)
    wrong = W.response_errors(answers.where("envelope is not null").select("request_id", "envelope")).select("request_id", F.col("code").alias("wrong"))
    value = F.try_parse_json("envelope")
    number = lambda c: F.try_variant_get(value, f"$.response.{c}", "bigint")
    size = lambda c: F.size(F.try_variant_get(value, f"$.response.{c}", "array<variant>")).cast("long")
    return answers.join(wrong, "request_id", "left").select(
        "request_id", F.col("http_status").cast("long"), "code", "wrong", number("headSequence").alias("head_sequence"), number("throughSequence").alias("through_sequence"),
        F.when(F.col("envelope").isNotNull(), size("entries")).alias("entries"), F.when(F.col("envelope").isNotNull(), size("decisions")).alias("decisions"),
    )


@query
def stateful_decide_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that needs state: purchases are rejected until their stream has a signup."""

    def judge(enabled: bool, row: dict) -> str | None:
        return "disabled" if row["event_type"] == "purchase" and not enabled else None

    def apply(enabled: bool, row: dict) -> bool:
        return enabled or row["event_type"] == "signup"

    rows = T.proposals(spark, sf_dir, positions=False).select("stream_id", "operation_id", "event_type", "ts", E_ID)
    return D.fold(rows, False, judge, apply, ["ts", E_ID]).select("stream_id", "operation_id", "sequence", "reason", "status")


@query
def counter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = M.running_total(T.log(spark, sf_dir, positions=False), F.col(E_ID) % 7 - 3)
    return total.select("stream_id", "sequence", F.col("total").cast("long"))


# Validation


@query
def log_contiguity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = T.log(spark, sf_dir, positions=False).where(F.col("sequence") % 97 != 0)
    return V.gaps(broken, F.floor(F.col("sequence") / 10_000))


@query
def log_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a log of which some streams lack entries, some have entries twice."""
    entries = T.stored_log(spark, sf_dir)
    lacks = (F.col("stream_id") == "s3") & (F.col("sequence") % 50 == 7)
    twice = entries.where((F.col("stream_id") == "s5") & (F.col("sequence") % 40 == 3))
    return V.density(entries.where(~lacks).unionByName(twice))


@query
def log_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and positions that a log holds twice within a page."""
    entries = T.stored_log(spark, sf_dir).withColumn("page", P.page_number(F.col("sequence")))
    again = entries.where(F.col("sequence") % 90 == 3).withColumn("operation_id", F.when(F.col("sequence") % 180 == 3, "other").otherwise(F.col("operation_id")))
    found = V.repeats(entries.unionByName(again), ["stream_id", "page"])
    return found.select("stream_id", F.col("page").cast("long"), "kind", "key", "n")


@query
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    decisions = entries.where(F.col("sequence") % 500 != 3).withColumn("status", F.lit("accepted"))
    moved = F.when(F.col("sequence") % 700 == 5, F.col("client_sequence") + 1).otherwise(F.col("client_sequence"))
    return V.snapshot_violations(entries.where(F.col("sequence") % 600 != 7).withColumn("client_sequence", moved), decisions)


@query
def page_cursor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On pages of a log that lacks entries."""
    broken = P.pages(T.log(spark, sf_dir, positions=False).where(F.col("sequence") % 611 != 0))
    return V.page_violations(broken).select("stream_id", F.col("page").cast("long"), "violation")


@query
def replica_record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    replicas = T.stored_replicas(entries)
    at = F.col("confirmed_sequence")
    retained = R.entries_between(replicas, entries, F.greatest(at - 20, F.lit(0)), at)
    shift = F.when(F.substring("client_id", -1, 1) == "3", 1).otherwise(0)
    box = T.outbox(entries, replicas)
    odd = F.when(F.col(E_ID) % 211 == 0, "in-flight").otherwise(F.col("status"))
    return R.record_violations(replicas.withColumn("confirmed_sequence", F.col("confirmed_sequence") + shift), retained, box.withColumn("status", odd))


# Pages


@query
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page(T.log(spark, sf_dir, positions=False), "s3", 100, 1 << 40).select("sequence", "operation_id")


@query
def log_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages(T.log(spark, sf_dir, positions=False)).select(
        "stream_id", F.col("page").cast("long"), "first_sequence", "last_sequence", "entries", "head_sequence", "more"
    )


# State

STATE = ("stream_id", "user_id", "sequence", "event_type", "intent_hash")


@query
def state_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.state(T.log(spark, sf_dir, positions=False)).select(*STATE)


@query
def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.state(T.log(spark, sf_dir, positions=False), 200).select(*STATE)


@query
def state_asof_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``state_asof``, from states kept every 64 sequences and the tail after the nearest."""
    entries = T.stored_log(spark, sf_dir).select(*STATE, "op", "table_name", "pk")
    kept = StateCheckpoints(spark, new_folder(spark), entries.schema, 64)
    kept.write(entries)
    return kept.at(200).select(*STATE)


@query
def state_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.state(T.log(spark, sf_dir, positions=False)).where(F.col("pk") == "[7]").select(*STATE)


@query
def state_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_row_with(M.state(T.log(spark, sf_dir, positions=False)), "user_state", F.col("event_type"), "click").select(*STATE)


@query
def state_rows_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered_rows(M.state(T.log(spark, sf_dir, positions=False)), "user_state").select("pk", *STATE)


@query
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tombstones(T.log(spark, sf_dir, positions=False)).select("stream_id", "user_id", "sequence")


LINE = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query
def lww_lineitem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem")
    won = M.latest(rows, ["l_orderkey", "l_linenumber"], *(F.desc(c) for c in LINE))
    return won.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query
def projection_conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an application table couldn't hold."""
    rows = T.table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query
def projection_upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    changes = orders.where(key % 3 == 0).select(
        "o_orderkey",
        key.alias("sequence"),
        F.when(key % 11 == 0, "deleteRow").otherwise("putRow").alias("op"),
        F.lit("X").alias("o_orderstatus"),
        "o_orderpriority",
    )
    return M.project(orders.where(key % 2 == 0), changes, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query
def projection_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``projection_upsert_orders``, in a bucketed table that only the buckets of new entries are rewritten of, in two runs."""
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    changes = orders.where(key % 3 == 0).withColumns(
        {"stream_id": F.lit("s"), "sequence": key + 1, "op": F.when(key % 11 == 0, "deleteRow").otherwise("putRow"), "o_orderstatus": F.lit("X")}
    )
    table = AppTable(spark, new_folder(spark), orders.schema, ["o_orderkey"], 16)
    table.create(orders.where(key % 2 == 0))
    table.apply(changes.where("sequence <= 500"))
    table.apply(changes)
    return table.read()


@query
def optimistic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    replicas = T.stored_replicas(entries)
    heads = replicas.select("stream_id", "confirmed_sequence").distinct()
    confirmed = entries.join(heads, "stream_id").where("sequence <= confirmed_sequence")
    return M.optimistic(confirmed.drop("confirmed_sequence"), T.outbox(entries, replicas).drop("confirmed_sequence")).select(
        "stream_id", "user_id", "client_sequence", "event_type"
    )


# Keys and hashes


@query
def intent_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.proposals(spark, sf_dir, positions=False).select("operation_id", "intent_hash")


@query
def pk_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "conversations")
    key = C.primary_key([C.json_integer(F.col("conv_id")), C.json_integer(F.col("turn")), C.json_string(F.col("role"))])
    return rows.select("conv_id", "turn", key.alias("pk"))


@query
def affinity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types read as if they were declared types."""
    return T.table(spark, sf_dir, "part").select("p_partkey", "p_type", C.affinity(F.col("p_type")).alias("affinity"))


@query
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of any shape in canonical form, and their fingerprints."""
    rows = T.table(spark, sf_dir, "events").select(E_ID, C.canonical_json(F.col("props")).alias("canonical"))
    return rows.select(E_ID, "canonical", C.fingerprint(F.col("canonical")).alias("fingerprint"))


@query
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's number as that of an attempt, without jitter."""
    rows = T.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", C.retry_delay_ms(F.col("turn"), jitter=F.lit(0.0)).cast("long").alias("delay_ms"))


# Bootstrap


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, B.Source]:
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    return {name: B.Source.by_schema(T.table(spark, sf_dir, name), [key]) for name, key in keys.items()}


@query
def bootstrap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history(_sources(spark, sf_dir), "bootstrap").select("sequence", "table_name", "pk", "operation_id", "intent_hash")


@query
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.operations(_sources(spark, sf_dir)).groupBy("table_name").agg(F.count("*").alias("rows"))


@query
def bootstrap_selected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history(_sources(spark, sf_dir), "seed", ["part", "nation", "customer", "part"]).select("sequence", "table_name", "pk", "operation")


@query
def bootstrap_operation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders")
    key = C.primary_key([C.json_integer(F.col("o_orderkey"))])
    return orders.select("o_orderkey", B.bootstrap_id("bootstrap", F.lit("orders"), key).alias("operation_id"))


# Contracts and normalization


def _contract() -> K.Contract:
    text, integer = K.ColumnContract("text", False), K.ColumnContract("integer", False)
    note = K.ColumnContract("text", True)
    table = K.TableContract(("conv_id", "turn"), {"conv_id": integer, "turn": integer, "role": text, "note": note})
    return K.Contract({"conversations": table}).check()


@query
def normalize_row_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts of conversation turns: some lack a role, some have a column too many, some
    a number where a text belongs, some an unknown table."""
    turn = F.col("turn")
    role = F.when((F.col("conv_id") + turn) % 5 == 0, "null").when((F.col("conv_id") + turn) % 7 == 0, "1").otherwise(C.json_string(F.col("role")))
    row = {"conv_id": C.json_integer(F.col("conv_id")), "turn": C.json_integer(turn), "role": role}
    wide = C.json_object(row | {"zip": F.lit("true")})
    body = F.when(F.col("conv_id") % 13 == 0, wide).otherwise(C.json_object(row))
    name = F.when(F.col("conv_id") % 17 == 0, "nowhere").otherwise("conversations")
    intents = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.put_row(name, body).alias("intent"))
    return N.normalize(intents, _contract()).select("conv_id", "turn", "op", "error")


@query
def normalize_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of conversation turns, some by a key that lacks a column, has one too many or one of another
    type, and the reason of those that are rejected."""
    conv, turn = F.col("conv_id"), F.col("turn")
    key = {"conv_id": C.json_integer(conv), "turn": C.json_integer(turn)}
    body = (
        F.when(conv % 5 == 0, C.json_object({"conv_id": key["conv_id"]}))
        .when(conv % 7 == 0, C.json_object(key | {"role": F.lit('"user"')}))
        .when(turn % 3 == 1, C.json_object(key | {"turn": C.json_string(turn)}))
        .otherwise(C.json_object(key))
    )
    intents = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.delete_row(F.lit("conversations"), body).alias("intent"))
    found = N.normalize(intents, _contract()).withColumn("reason", N.rejection(F.col("error")))
    return found.select("conv_id", "turn", "op", "body", F.col("reason.code").alias("code"), F.col("reason.message").alias("message"))


@query
def normalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their nullable column, in the contract's order."""
    row = {"turn": C.json_integer(F.col("turn")), "role": C.json_string(F.col("role")), "conv_id": C.json_integer(F.col("conv_id"))}
    puts = T.table(spark, sf_dir, "conversations").where("role is not null").select("conv_id", "turn", C.put_row(F.lit("conversations"), C.json_object(row)).alias("intent"))
    return N.normalize(puts, _contract()).select("conv_id", "turn", "body")


@query
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows in JSON, and back to columns of their affinities' types, on top of the empty table of the contract."""
    parts = T.table(spark, sf_dir, "part")
    contract = K.from_schema("part", parts.schema, ["p_partkey"])
    columns = B.Source.by_schema(parts, ["p_partkey"]).columns
    rows = K.typed_rows(parts.select(C.json_object(columns).alias("row")), contract.tables["part"])
    return K.empty_tables(spark, contract)["part"].unionByName(rows)


# Replicas


@query
def outbox_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prepare(T.outbox(T.stored_log(spark, sf_dir))).select("client_id", "operation_id", F.col("proposal_ord").cast("long"))


@query
def outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected operations again, and some that the outbox has."""
    all_ = T.stored_decisions(spark, sf_dir)
    entries = all_.where("status = 'accepted'")
    more = all_.where((F.col("status") == "rejected") | (F.col(E_ID) % 40 == 0)).select("stream_id", "client_id", "operation_id", E_ID)
    box = T.outbox(entries)
    queued = R.enqueue(more, T.replicas(entries), box, entries.where("sequence <= 0"), [E_ID])
    return queued.select("operation_id", "duplicate", "client_sequence")


@query
def merge_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after what each stream's replicas have confirmed: entries a replica."""
    entries = T.stored_log(spark, sf_dir)
    replicas = T.stored_replicas(entries)
    new = R.new_entries(replicas, _next_page(entries, replicas))
    return new.groupBy("stream_id", "client_id").agg(F.count("*").alias("entries"), F.max("sequence").alias("confirmed_sequence"))


def _next_page(entries: DataFrame, replicas: DataFrame) -> DataFrame:
    at = replicas.select("stream_id", "confirmed_sequence").distinct()
    page = entries.join(at, "stream_id").where("sequence > confirmed_sequence and sequence <= confirmed_sequence + 256")
    return page.drop("confirmed_sequence")


@query
def merge_overlap_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    other = F.when(F.col("sequence") % 300 == 1, F.lit("changed")).otherwise(F.col("intent_hash"))
    position = F.when(F.col("sequence") % 400 == 2, F.col("client_sequence") + 1).otherwise(F.col("client_sequence"))
    return R.overlap_divergence(entries, entries.withColumns({"intent_hash": other, "client_sequence": position}))


@query
def merge_outbox_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    replicas = T.stored_replicas(entries)
    return R.outbox_after(T.outbox(entries, replicas), _next_page(entries, replicas)).select("stream_id", "client_id", "operation_id", "status")


@query
def merge_newly_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir)
    replicas = T.stored_replicas(entries)
    return R.newly_resolved(T.outbox(entries, replicas), _next_page(entries, replicas)).select("client_id", "operation_id", "resolved_sequence")


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Replicas that keep their last 20 entries, and for each the response that begins ten before what it has
    confirmed, with decisions on half of its outbox.  Some replicas' responses begin too late, some decisions
    name another sequence, and some replicas keep other entries than the authority's."""
    entries = stored(T.stored_log(spark, sf_dir).withColumn("operation", F.col("op")))
    user = F.substring("client_id", 2, 9).cast("int")
    at = F.col("confirmed_sequence")
    start = F.when(user % 23 == 5, at + 5).otherwise(F.greatest(at - 10, F.lit(0)))
    replicas = stored(T.replicas(entries).withColumns({"retained_base": F.greatest(at - 20, F.lit(0)), "base_sequence": start}))
    log = entries.withColumnRenamed("client_id", "origin_client").drop("status")
    odd = F.when((user % 19 == 4) & (F.col("sequence") % 5 == 0), "odd").otherwise(F.col("intent_hash"))
    base = F.col("base_sequence")
    retained = R.entries_between(replicas, log, F.col("retained_base"), at).withColumn("intent_hash", odd)
    page = R.entries_between(replicas, log, base, base + 256)
    box = stored(T.outbox(entries, replicas).drop("confirmed_sequence"))
    moved = F.col("sequence") + F.when((user % 17 == 3) & (F.col(E_ID) % 4 == 1), 1).otherwise(0)
    told = box.where(F.col(E_ID) % 4 < 2).withColumns({"decision_ord": F.col("client_sequence"), "status": F.lit("accepted"), "sequence": moved})
    placed = {c: F.when(F.col("status") == "accepted", F.col(c)) for c in ("sequence", "operation")}
    return replicas, box.withColumns(placed), retained, replicas.select("stream_id", "client_id", "base_sequence", "head_sequence"), told, page


@query
def merge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = G.merge_responses(*_responses(spark, sf_dir))
    return merged.select("stream_id", "client_id", "kind", "detail", "operation_id", "status", "sequence")


@query
def replica_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica for each client that has proposed anything."""
    return R.new_replicas(T.proposals(spark, sf_dir, positions=False))


@query
def optimistic_by_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client of two streams sees: its stream as far as it has confirmed, and its own outbox on top."""
    entries = stored(T.stored_log(spark, sf_dir).where(F.col("stream_id").isin("s1", "s2")))
    replicas = T.stored_replicas(entries)
    seen = M.optimistic_of_replicas(entries, replicas, T.outbox(entries, replicas))
    return seen.select("stream_id", "client_id", "user_id", "sequence", "event_type")


@query
def replica_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = T.stored_decisions(spark, sf_dir)
    return R.status(T.outbox(all_.where("status = 'accepted'")), all_.where("status = 'rejected'"))


def _resolutions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.decisions(spark, sf_dir).select("stream_id", "client_id", "operation_id", "status", E_ID)
    return rows.where(F.col(E_ID) % 3 == 0), rows.where(F.col(E_ID) % 2 == 0)


@query
def resolutions_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, more = _resolutions(spark, sf_dir)
    told = R.append_resolutions(kept.withColumn("learned", F.lit("first")), more.withColumn("learned", F.lit("second")))
    return told.select("client_id", "operation_id", "status", "learned")


@query
def resolutions_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, done = _resolutions(spark, sf_dir)
    return R.acknowledge(kept, done).select("client_id", "operation_id", "status")


@query
def compact_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's own entries, without what lies 50 before what it has confirmed."""
    entries = T.stored_log(spark, sf_dir)
    left = R.compact(entries, T.replicas(entries), F.col("confirmed_sequence") - 50)
    return left.select("stream_id", "client_id", "sequence")


# Wire


@query
def wire_request_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(T.proposals(spark, sf_dir)).withColumns(
        {
            "proposal_ord": F.col("client_sequence"),
            "base_sequence": F.lit(0),
            "maximum_entries": F.lit(V.ENTRIES),
            "intent": C.json_object({"op": C.json_string(F.col("op")), "user": C.json_integer(F.col("user_id"))}),
        }
    )
    back = W.decode_requests(W.encode_requests(rows))
    return back.select("request_id", "stream_id", F.col("proposal_ord").cast("long"), "operation_id", "client_id", "client_sequence", "intent_hash", "intent")


@query
def wire_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which most are broken, each kind of client in its own way; with a limit of 40 proposals."""
    rows = _requests(T.proposals(spark, sf_dir)).withColumns(
        {"proposal_ord": F.col("client_sequence"), "base_sequence": F.lit(0), "maximum_entries": F.lit(V.ENTRIES), "intent": F.lit("{}")}
    )
    text, kind = F.col("envelope"), F.regexp_extract("request_id", r"^c(\d+)-", 1).cast("int") % 13
    first = F.regexp_extract(text, r'"clientSequence":(\d+)', 1)
    broken = (
        F.when(kind == 0, F.replace(text, F.lit('"protocolVersion":1'), F.lit('"protocolVersion":2')))
        .when(kind == 1, F.regexp_replace(text, r'"streamId":"[^"]*"', '"streamId":""'))
        .when(kind == 2, F.replace(text, F.lit('"baseSequence":0'), F.lit('"baseSequence":"0"')))
        .when(kind == 3, F.replace(text, F.lit('"baseSequence":0'), F.lit('"baseSequence":-1')))
        .when(kind == 4, F.replace(text, F.lit('"maximumEntries":256'), F.lit('"maximumEntries":0')))
        .when(kind == 5, F.replace(text, F.concat(F.lit('"clientSequence":'), first, F.lit(",")), F.concat(F.lit('"clientSequence":"'), first, F.lit('",'))))
        .when(kind == 6, F.regexp_replace(text, '"intentHash":"[^"]*"', '"intentHash":""'))
        .when(kind == 7, F.substring(text, F.lit(1), F.length(text) - 1))
        .when(kind == 8, F.replace(text, F.lit('"operationId"'), F.lit('"operation"')))
        .when(kind == 9, F.replace(text, F.concat(F.lit('"clientSequence":'), first, F.lit(",")), F.lit('"clientSequence":0,')))
        .when(kind == 10, F.replace(text, F.lit('"intent":{},'), F.lit("")))
        .otherwise(text)
    )
    texts = W.encode_requests(rows).withColumn("envelope", broken)
    return W.request_errors(texts, 40).select("request_id", "code", "path")


@query
def wire_response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a log in which some entries are missing, moved or repeated, as responses, some of another stream than asked."""
    entries = T.stored_log(spark, sf_dir).withColumns({"page": P.page_number(F.col("sequence")), "operation": F.lit("{}")})
    pages = stored(P.pages(entries))
    nth = F.pmod(F.col("sequence") - 1, F.lit(V.ENTRIES))
    kind = F.pmod(F.col("page"), F.lit(5))
    broken = entries.where((kind != 1) | (nth != 3))
    broken = broken.withColumns(
        {
            "client_id": F.when((kind == 2) & (nth == 7), "").otherwise(F.col("client_id")),
            "operation_id": F.when((kind == 3) & nth.isin(4, 9), "same").otherwise(F.col("operation_id")),
            "client_sequence": F.when((kind == 4) & (nth == 2), 0).otherwise(F.col("client_sequence")),
        }
    )
    asked = F.when((F.col("stream_id") == "s4") & (F.col("page") % 5 == 0), "s0").otherwise(F.col("stream_id"))
    sent = W.encode_responses(pages, broken).withColumn("asked", asked)
    return W.response_errors(sent, asked="asked").select("stream_id", F.col("page").cast("long"), "code", "path")


@query
def wire_response_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = T.stored_log(spark, sf_dir).withColumns(
        {"page": P.page_number(F.col("sequence")), "operation": C.json_object({"op": C.json_string(F.col("op"))})}
    )
    back = W.decode_responses(W.encode_responses(P.pages(entries), entries))
    return back.select("stream_id", F.col("page").cast("long"), "through_sequence", "head_sequence", "sequence", "operation_id", "client_id", "client_sequence", "operation")


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions by response, 64 each in the order of the events, and the responses: all at the
    head of their stream, so without entries."""
    rows = stored(number_balanced(T.decisions(spark, sf_dir), ["stream_id"], ["ts", E_ID], "nth"))
    decisions = rows.withColumns(
        {
            "page": F.floor((F.col("nth") - 1) / V.PROPOSALS),
            "decision_ord": F.col("nth"),
            "operation": C.json_object({"op": C.json_string(F.col("op"))}),
            "reason": F.when(F.col("reason").isNotNull(), C.json_object({"code": C.json_string(F.col("reason"))})),
        }
    )
    at = decisions.select("stream_id", "page").distinct().join(P.heads(rows), "stream_id")
    return decisions, at.withColumns({"base_sequence": F.col("head_sequence"), "through_sequence": F.col("head_sequence")})


@query
def wire_decisions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, pages = _decided(spark, sf_dir)
    back = W.decode_decisions(W.encode_responses(pages, T.stored_log(spark, sf_dir).withColumns({"page": F.lit(-1), "operation": F.lit("{}")}), decisions))
    return back.select("stream_id", F.col("page").cast("long"), F.col("decision_ord").cast("long"), "error", "operation_id", "status", "sequence", "operation", "reason")


@query
def response_decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On responses that carry their decisions' entries too, of which some are moved, some
    rejections committed, some decisions beyond the head and some repeated."""
    decisions, pages = _decided(spark, sf_dir)
    entries = decisions.where((F.col("status") == "accepted") | (F.col("nth") % 10 == 1)).withColumn("sequence", F.coalesce("sequence", F.lit(1)))
    moved = F.when(F.col("nth") % 97 == 3, F.col("sequence") + 1).when(F.col("nth") % 89 == 5, F.lit(1 << 40)).otherwise(F.col("sequence"))
    again = decisions.where(F.col("nth") % 101 == 7).withColumn("decision_ord", F.col("nth") + 0.5)
    told = decisions.withColumn("sequence", moved).unionByName(again)
    return V.decision_violations(pages, entries, told, 1 << 20).select("stream_id", F.col("page").cast("long"), "operation_id", "violation")
