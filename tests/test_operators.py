import random

import pytest
from pyspark.sql import functions as F

from loomlog.errors import BootstrapError, RowOperationError, SchemaDiscoveryError
from loomlog.functions import canonical as C
from loomlog.functions.canonical import canonical
from loomlog.operators import bootstrap as B
from loomlog.operators import contract as K
from loomlog.operators import decide as D
from loomlog.operators import materialize as M
from loomlog.operators import normalize as N
from loomlog.operators import replica as R
from loomlog.operators import snapshot as S
from loomlog.operators import validate as V
from loomlog.operators.numbering import number_balanced

CATALOGUE = "table_name string, cid int, name string, type string, notnull boolean, pk int, hidden int"


def catalogue(spark, *more):
    rows = [
        ("notes", 0, "id", "TEXT", False, 1, 0), ("notes", 1, "title", "VARCHAR(200)", True, 0, 0), ("notes", 2, "score", "NUMERIC", False, 0, 0),
        ("notes", 3, "search_text", "TEXT", False, 0, 2), ("notes", 4, "shadow", "TEXT", False, 0, 1),
        ("memberships", 0, "team_id", "INTEGER", True, 2, 0), ("memberships", 1, "user_id", "INTEGER", True, 1, 0), ("memberships", 2, "role", "TEXT", True, 0, 0),
        ("_private_log", 0, "x", "TEXT", True, 1, 0),
    ]
    return spark.createDataFrame([*rows, *more], CATALOGUE)


def test_discovery(spark):
    found = K.from_catalogue(catalogue(spark), internal=["_private"])
    assert set(found.tables) == {"notes", "memberships"}
    assert found.tables["memberships"].primary_key == ("user_id", "team_id")
    notes = found.tables["notes"].columns
    assert list(notes) == ["id", "title", "score", "search_text"]
    assert not notes["id"].nullable and notes["score"].nullable and notes["search_text"].generated and notes["score"].affinity == "numeric"
    with pytest.raises(RowOperationError):
        found.check()
    assert set(K.from_catalogue(catalogue(spark), include=["notes", "memberships"], exclude=["notes"]).tables) == {"memberships"}
    with pytest.raises(SchemaDiscoveryError):
        K.from_catalogue(catalogue(spark, ("events", 0, "message", "TEXT", True, 0, 0)))
    with pytest.raises(SchemaDiscoveryError):
        K.from_catalogue(catalogue(spark), include=["nothing"])


def test_schema_hash_is_that_of_ordered_json():
    t = K.TableContract(("id",), {"id": K.ColumnContract("text", False), "title": K.ColumnContract("text", False)})
    assert K.Contract({"notes": t}).schema_hash == "sha256:a8b150bd2591bffcf7cb9d3d566ce66d8353031ce32cbe4c6b3d6857914a8bb0"


def test_contract_of_a_dataframe(spark):
    df = spark.createDataFrame([], "id long, name string, x double, b binary, d date")
    found = K.from_schema("t", df.schema, ["id"]).tables["t"]
    assert [c.affinity for c in found.columns.values()] == ["integer", "text", "real", "blob", "numeric"] and not found.columns["id"].nullable


def test_normalize(spark):
    c = K.ColumnContract
    contract = K.Contract({"t": K.TableContract(("id",), {"id": c("text", False), "n": c("integer", True), "b": c("blob", True), "m": c("numeric", True), "r": c("real", False)})})
    cases = [
        ('{"type":"putRow","table":"t","row":{"id":"a","n":1.5,"b":[0,255],"m":"7","r":2}}', None),
        ('{"type":"putRow","table":"t","row":{"id":"a","r":2e3,"n":null}}', None),
        ('{"type":"putRow","table":"t","row":{"id":"a","zz":1,"aa":2}}', "t: unknown columns aa, zz"),
        ('{"type":"putRow","table":"t","row":{"id":"a"}}', "t.r must not be null"),
        ('{"type":"putRow","table":"t","row":{"id":5,"r":1}}', "t.id must be text"),
        ('{"type":"putRow","table":"t","row":{"id":"a","n":true,"r":1}}', "t.n must be integer"),
        ('{"type":"putRow","table":"t","row":{"id":"a","b":[256],"r":1}}', "t.b must be blob"),
        ('{"type":"putRow","table":"t","row":{"id":"a","m":{},"r":1}}', "t.m must be numeric"),
        ('{"type":"putRow","table":"t","row":[1]}', "t: row must be an object"),
        ('{"type":"deleteRow","table":"t","key":{"id":"a"}}', None),
        ('{"type":"deleteRow","table":"t","key":{"id":"a","n":1}}', "t: key must have exactly the key columns"),
        ('{"type":"deleteRow","table":"t","key":{"id":null}}', "t.id must be text"),
        ('{"type":"deleteRow","table":"t"}', "t: key must be an object"),
        ('{"type":"moveRow","table":"t"}', "unknown operation type"),
        ('{"type":"putRow","table":"u","row":{}}', "unknown table u"),
        ('{"type":"putRow","row":{}}', "table must be a non-empty string"),
        ("[1]", "operation must be an object"),
        ("{", "operation must be an object"),
        (None, "operation must be an object"),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, intent string")
    got = {r.i: r.error for r in N.normalize(df, contract).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def operations(seed, n=400):
    rng = random.Random(seed)
    return [("s" + str(rng.randrange(3)), i, f"op{i}", rng.choice(["putRow", "putRow", "deleteRow"]), "t", f"[{rng.randrange(12)}]", rng.randrange(100)) for i in range(n)]


LOG = "stream_id string, ord long, operation_id string, op string, table_name string, pk string, v int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_window_state_equals_fold(spark, seed):
    rows = operations(seed)
    df = number_balanced(spark.createDataFrame(rows, LOG), ["stream_id"], ["ord"], "sequence")
    heads, state, as_of = {}, {}, {}
    for s, _, _, op, t, pk, v in rows:
        heads[s] = heads.get(s, 0) + 1
        for held, limit in ((state, 1 << 60), (as_of, 50)):
            if heads[s] <= limit:
                held.pop((s, t, pk), None)
                if op == "putRow":
                    held[s, t, pk] = v
    assert {(r.stream_id, r.table_name, r.pk): r.v for r in M.state(df).collect()} == state
    assert {(r.stream_id, r.table_name, r.pk): r.v for r in M.state(df, 50).collect()} == as_of
    assert V.gaps(df).count() == 0 and V.gaps(df, F.floor(F.col("sequence") / 7)).count() == 0
    broken = df.where("sequence % 10 != 4")
    key = lambda x: sorted((r.stream_id, r.expected, r.received) for r in x.collect())
    assert key(V.gaps(broken)) == key(V.gaps(broken, F.floor(F.col("sequence") / 7))) != []


def test_retries_replay_and_conflicts(spark):
    schema = "stream_id string, client_id string, client_sequence long, operation_id string, intent_hash string, ord long, delta int"
    first = spark.createDataFrame([("s", "a", 1, "o1", "h1", 1, 2), ("s", "a", 2, "o2", "h2", 2, 0), ("s", "b", 1, "o3", "h3", 3, 3)], schema)
    reason = F.when(F.col("delta") == 0, "zero-delta")
    done = D.decide(first, reason, ["ord"])
    assert {r.operation_id: (r.status, r.sequence) for r in done.collect()} == {"o1": ("accepted", 1), "o2": ("rejected", None), "o3": ("accepted", 2)}
    again = spark.createDataFrame(
        [("s", "a", 1, "o1", "h1", 4, 2), ("s", "a", 2, "o2", "h2", 5, 0), ("s", "a", 9, "o1", "h1", 6, 2), ("s", "a", 1, "o1", "hx", 7, 2), ("s", "a", 1, "o9", "h9", 8, 1), ("s", "a", 3, "o8", "h8", 9, 1), ("t", "a", 1, "o1", "h1", 10, 1)],
        schema,
    )
    got = {r.ord: (r["class"], r.status, r.sequence) for r in D.classify(again, done).collect()}
    assert got == {
        4: ("replay", "accepted", 1), 5: ("replay", "rejected", None), 6: (D.IDENTITY, None, None), 7: (D.INTENT, None, None),
        8: (D.POSITION, None, None), 9: ("new", None, None), 10: ("new", None, None),
    }
    assert {r.total for r in M.running_total(done.where("status = 'accepted'"), F.col("delta")).collect()} == {2, 5}


def test_stateful_rule_sees_earlier_decisions(spark):
    rows = [("s", 1, "write"), ("s", 2, "enable"), ("s", 3, "write"), ("t", 1, "write")]
    df = spark.createDataFrame(rows, "stream_id string, ord long, kind string")
    got = D.fold(df, False, lambda on, r: None if on or r["kind"] == "enable" else "disabled", lambda on, r: True, ["ord"]).collect()
    assert {(r.stream_id, r.ord): (r.sequence, r.reason) for r in got} == {("s", 1): (None, "disabled"), ("s", 2): (1, None), ("s", 3): (2, None), ("t", 1): (None, "disabled")}


def test_optimistic_view_puts_the_outbox_on_top(spark):
    confirmed = spark.createDataFrame([("s", "t", "[1]", "putRow", 1, 5), ("s", "t", "[2]", "putRow", 9, 6)], "stream_id string, table_name string, pk string, op string, sequence long, v int")
    box = spark.createDataFrame([("s", "t", "[2]", "putRow", 3, 7), ("s", "t", "[2]", "putRow", 4, 8), ("s", "t", "[1]", "deleteRow", 5, 0)], "stream_id string, table_name string, pk string, op string, client_sequence long, v int")
    assert [(r.pk, r.v) for r in M.optimistic(confirmed, box).collect()] == [("[2]", 8)]


def test_replica_steps(spark):
    replicas = spark.createDataFrame([("s", "a", 4, 3)], "stream_id string, client_id string, next_client_sequence long, confirmed_sequence long")
    box = spark.createDataFrame([("s", "a", "o2", 2, "h", "pending", None), ("s", "a", "o3", 3, "h", "accepted", 5)], "stream_id string, client_id string, operation_id string, client_sequence long, intent_hash string, status string, sequence long")
    retained = spark.createDataFrame([("s", "a", "o0", 2), ("s", "a", "o1", 3)], "stream_id string, client_id string, operation_id string, sequence long")
    assert R.record_violations(replicas, retained, box).count() == 0
    odd = F.when(F.col("operation_id") == "o2", "in-flight").otherwise(F.col("status"))
    assert [r.violation for r in R.record_violations(replicas, retained, box.withColumn("status", odd)).collect()] == ["status"]
    assert [r.violation for r in R.record_violations(replicas, retained.where("sequence = 2"), box).collect()] == ["retained-log"]
    assert [r.violation for r in R.record_violations(replicas, retained, box.withColumn("client_sequence", F.lit(2))).collect()] == ["client-position"]
    more = spark.createDataFrame([("s", "a", "o1", 1), ("s", "a", "n1", 2), ("s", "a", "n2", 3)], "stream_id string, client_id string, operation_id string, ord long")
    queued = {r.operation_id: (r.duplicate, r.client_sequence) for r in R.enqueue(more, replicas, box, retained, ["ord"]).collect()}
    assert queued == {"o1": (True, None), "n1": (False, 4), "n2": (False, 5)}
    decided = spark.createDataFrame([("s", "o2", "accepted", 7)], "stream_id string, operation_id string, status string, sequence long")
    assert {r.operation_id: (r.status, r.sequence) for r in R.accepted(box, decided).collect()} == {"o2": ("accepted", 7), "o3": ("accepted", 5)}
    pages = spark.createDataFrame([("s", 4)], "stream_id string, base_sequence long")
    assert R.merge_gaps(replicas, pages).count() == 1
    assert [r.sequence for r in R.compact(retained, replicas, F.lit(2)).collect()] == [3]
    assert R.compact(retained, replicas, F.lit(9)).count() == 2
    assert [(r.expected, r.received) for r in R.compaction_gaps(replicas, F.lit(9)).collect()] == [(4, 9)] and R.compaction_gaps(replicas, F.lit(3)).count() == 0


PROPOSED = "stream_id string, client_id string, client_sequence long, operation_id string, intent_hash string, ord long, request string"


def test_a_batch_is_held_against_itself(spark):
    none = spark.createDataFrame([], "stream_id string, client_id string, client_sequence long, operation_id string, intent_hash string, status string, sequence long")
    rows = [
        ("s", "a", 1, "o1", "h", 1, "r1"), ("s", "a", 1, "o2", "h", 2, "r2"), ("s", "a", 2, "o1", "hx", 3, "r3"), ("s", "a", 1, "o1", "hx", 4, "r4"),
        ("s", "a", 1, "o1", "h", 5, "r5"), ("t", "a", 1, "o1", "h", 6, "r2"), ("s", "a", 3, "o3", "h", 7, "r2"), ("s", "a", 4, "o4", "h", 8, "r6"),
    ]
    batch = spark.createDataFrame(rows, PROPOSED)
    got = {r.ord: r["class"] for r in D.settle(batch, none, ["ord"]).collect()}
    assert got == {1: "new", 2: D.POSITION, 3: D.IDENTITY, 4: D.INTENT, 5: "repeat", 6: "new", 7: "new", 8: "new"}
    got = {r.ord: r["class"] for r in D.settle(batch, none, ["ord"], "request").collect()}
    assert got == {1: "new", 2: D.POSITION, 3: D.IDENTITY, 4: D.INTENT, 5: "repeat", 6: "new", 7: "aborted", 8: "new"}
    done = D.decide(batch.where("ord = 1"), F.lit(None).cast("string"), ["ord"])
    got = {r.ord: (r["class"], r.sequence) for r in D.settle(batch, done, ["ord"]).collect()}
    assert got[5] == ("replay", 1) and got[2] == (D.POSITION, None)


def test_replicas_of_a_stream_keep_apart(spark):
    log = spark.createDataFrame([("s", "x", 1, "putRow", "t", "[1]", 5), ("s", "x", 2, "putRow", "t", "[2]", 6), ("s", "x", 3, "putRow", "t", "[1]", 7)], "stream_id string, client_id string, sequence long, op string, table_name string, pk string, v int")
    replicas = spark.createDataFrame([("s", "a", 2), ("s", "b", 3)], "stream_id string, client_id string, confirmed_sequence long")
    box = spark.createDataFrame([("s", "a", "t", "[2]", "deleteRow", 1, 0), ("s", "b", "t", "[2]", "putRow", 1, 9)], "stream_id string, client_id string, table_name string, pk string, op string, client_sequence long, v int")
    view = M.optimistic(M.of_replicas(log, replicas), box, [*M.KEY, "client_id"])
    assert sorted((r.client_id, r.pk, r.v) for r in view.collect()) == [("a", "[1]", 5), ("b", "[1]", 7), ("b", "[2]", 9)]


@pytest.mark.parametrize("most", [1, 3, 256])
def test_many_replicas_see_what_each_sees_alone(spark, most):
    rng = random.Random(most)
    log = [(s, f"c{rng.randrange(9)}", n, rng.choice(["putRow", "putRow", "deleteRow"]), "t", f"[{rng.randrange(12)}]", n) for s in "st" for n in range(1, 60)]
    replicas = [(s, f"c{n}", rng.choice([0, 20, 20, 59])) for s in "st" for n in range(9)]
    box = [(s, f"c{rng.randrange(9)}", n, rng.choice(["putRow", "deleteRow"]), "t", f"[{rng.randrange(14)}]", -n) for s in "st" for n in range(30)]
    log = spark.createDataFrame(log, "stream_id string, client_id string, sequence long, op string, table_name string, pk string, v int")
    replicas = spark.createDataFrame(replicas, "stream_id string, client_id string, confirmed_sequence long")
    box = spark.createDataFrame(box, "stream_id string, client_id string, client_sequence long, op string, table_name string, pk string, v int")
    rows = lambda df: sorted((r.stream_id, r.client_id, r.pk, r.v) for r in df.collect())
    seen = M.optimistic_of_replicas(log, replicas, box, most)
    assert rows(seen) == rows(M.optimistic(M.of_replicas(log, replicas), box, [*M.KEY, "client_id"]))
    # No window sorts a row of each replica and key: all are below the rows given out.
    above, _ = seen._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
    assert "Window" not in above


def test_entries_between_two_sequences_of_each_replica(spark):
    """Each entry meets the replicas whose bounds reach its part of the log, not all of its stream."""
    entries = spark.createDataFrame([(s, f"by{n % 3}", n, f"{s}{n}") for s in "st" for n in range(1, 41)], "stream_id string, client_id string, sequence long, operation_id string")
    spans = [("s", "a", 0, 4), ("s", "b", 3, 4), ("s", "c", 4, 4), ("s", "d", 7, 3), ("s", "e", 3, 17), ("s", "f", 3, 17), ("t", "a", 38, 60), ("u", "a", 0, 9), ("s", "g", None, 5)]
    replicas = spark.createDataFrame(spans, "stream_id string, client_id string, lo long, hi long")
    found = R.entries_between(replicas, entries, F.col("lo"), F.col("hi"), 4)
    want = sorted((s, c, n, f"{s}{n}") for s, c, lo, hi in spans if lo is not None and s in "st" for n in range(1, 41) if lo < n <= hi)
    assert sorted(map(tuple, found.collect())) == want
    joins = [p for p in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p]
    assert len(joins) == 2 and all("Inner" in p and ("__part" in p or "__through" in p) for p in joins)


def test_merge_conflicts(spark):
    replica = "stream_id string, client_id string, "
    replicas = spark.createDataFrame([("s", c, 1, 3) for c in "abcdefg"], replica + "retained_base long, confirmed_sequence long")
    pages = spark.createDataFrame([("s", c, 4 if c == "a" else 3) for c in "abcdefg"], replica + "base_sequence long")
    held = "operation_id string, client_sequence long, intent_hash string, status string, sequence long, operation string"
    outbox = spark.createDataFrame(
        [("s", "b", "o1", 1, "h", "accepted", 4, "{}"), ("s", "c", "o1", 1, "h", "accepted", 4, "{}"), ("s", "d", "o1", 1, "h", "pending", None, None), ("s", "e", "o1", 1, "h", "pending", None, None), ("s", "f", "o1", 1, "h", "accepted", 1, "{}"), ("s", "g", "o1", 1, "h", "accepted", 4, "{}")],
        replica + held,
    )
    entry = replica + "sequence long, operation_id string, origin_client string, client_sequence long, intent_hash string, operation string"
    retained = spark.createDataFrame([("s", c, 2, "x2", "z", 1, "h", "{}") for c in "abcdefg"], entry)
    entries = spark.createDataFrame(
        [("s", "c", 4, "o1", "c", 1, "h", "{}"), ("s", "d", 2, "x2", "z", 1, "other", "{}"), ("s", "e", 4, "o1", "e", 1, "hx", "{}"), ("s", "g", 2, "x2", "z", 1, "h", "{}"), ("s", "g", 4, "o1", "g", 1, "h", "{}")], entry
    )
    decisions = spark.createDataFrame([("s", "b", "o1", "rejected", None, None), ("s", "c", "o1", "accepted", 4, "{}"), ("s", "d", "o1", "rejected", None, None)], replica + "operation_id string, status string, sequence long, operation string")
    got = {r.client_id: r.violation for r in R.merge_conflicts(replicas, outbox, retained, pages, entries, decisions).collect()}
    assert got == {"a": "log-gap", "b": "decision-conflict", "d": "log-divergence", "e": "identity-differs", "f": "compacted-entry"}


def test_first_match_is_in_the_order_of_the_rows(spark):
    rows = spark.createDataFrame([("t", "[10]", "x"), ("t", "[1]", "x"), ("t", "[2]", "y")], "table_name string, pk string, v string")
    assert M.first_row_with(rows, "t", F.col("v"), "x").first().pk == M.ordered_rows(rows, "t").first().pk


def test_column_values_both_ways(spark):
    df = spark.createDataFrame([(1, 1.5e21, bytearray([0, 255]), "7"), (2, None, None, None), (3, -0.0, bytearray(), "x")], "id long, x double, b binary, n string")
    source = B.Source.of(df, ["id"], integer=["id"], real=["x"], blob=["b"], numeric=["n"])
    rows = {r.pk: r.operation for r in B.operations({"t": source}).collect()}
    assert rows["[1]"] == '{"row":{"b":[0,255],"id":1,"n":"7","x":1.5e+21},"table":"t","type":"putRow"}'
    assert '"b":null' in rows["[2]"] and '"x":null' in rows["[2]"] and '"b":[]' in rows["[3]"] and '"x":0}' in rows["[3]"]
    with pytest.raises(BootstrapError):
        B.history({"t": source}, "p", log=df)
    values = spark.createDataFrame([(a, v) for a, v in [("text", '"a"'), ("real", "1.5"), ("blob", "[0,255]"), ("numeric", "null"), ("blob", "null")]], "a string, v string")
    got = [C.column_value(F.try_parse_json("v"), a) for a in ("text", "real", "blob", "numeric", "blob")]
    held = [values.where((F.col("a") == a) & (F.col("v") == v)).select(g).first()[0] for g, (a, v) in zip(got, [("text", '"a"'), ("real", "1.5"), ("blob", "[0,255]"), ("numeric", "null"), ("blob", "null")])]
    assert held == ["a", "1.5", "00FF", None, None]
    with pytest.raises(Exception, match="affinity"):
        spark.createDataFrame([("[256]",)], "v string").select(C.column_value(F.try_parse_json("v"), "blob")).collect()


def test_half_a_surrogate_pair_is_escaped(spark):
    df = spark.createDataFrame([('{"a":"\\ud800","b":"\\ud83d\\ude00"}',)], "t string")
    assert df.select(C.canonical_json(F.col("t"))).first()[0] == '{"a":"\\ud800","b":"\N{GRINNING FACE}"}'


def test_empty_state():
    contract = K.Contract({"t": K.TableContract(("id",), {"id": K.ColumnContract("text", False)})})
    assert S.empty_state(contract) == {"schemaHash": contract.schema_hash, "tables": {"t": {}}}


def test_request_rules_in_order(spark):
    rows = [("a", -1, 0, 99, 0), ("b", 0, 0, 99, 0), ("c", 9, 1, 99, 0), ("d", 9, 1, 1, 8), ("e", 8, 1, 64, 8), ("f", 2**53, 1, 1, None)]
    df = spark.createDataFrame(rows, "request_id string, base_sequence long, maximum_entries long, proposals long, head_sequence long")
    got = {r.request_id: r.violation for r in V.request_violations(df).collect()}
    assert got == {"a": "invalid-sequence", "b": "invalid-limit", "c": "protocol-limit", "d": "future-base-sequence", "f": "invalid-sequence"}


def test_canonical_is_used_for_keys():
    assert canonical(["w1", "n1"]) == '["w1","n1"]'
