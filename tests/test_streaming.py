from pyspark.sql import functions as F

from loomlog.operators import validate as V
from loomlog.sources import tables as T
from loomlog.sources.decisions import DecisionStore
from loomlog.sources.stored import stored
from loomlog.streaming import authority as A

SF = "/root/testdata/sf0.001"


COLUMNS = ["stream_id", "client_id", "client_sequence", "operation_id", "intent_hash"]


def decided_in_batches(spark, path, parts, **more):
    """The parts as batches of one stream of proposals; a new query each, from the same checkpoint."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(path / "in" / str(n)))
        stream = spark.readStream.schema(part.schema).parquet(str(path / "in" / "*"))
        writer = A.decide_batches(stream, str(path / "out"), T.reason(), ["ts", "event_id"], COLUMNS, **more)
        writer.option("checkpointLocation", str(path / "at")).trigger(availableNow=True).start().awaitTermination()
    return A.decision_store(spark, str(path / "out"), parts[0].schema, COLUMNS)


def test_batches_decide_as_one_run(spark, tmp_path):
    rows = stored(T.proposals(spark, SF))
    parts = [rows.where(F.col("event_id") < 400), rows.where(F.col("event_id") < 700), rows.where(F.col("event_id") >= 700)]
    got = decided_in_batches(spark, tmp_path, parts, answers=str(tmp_path / "answers")).all(3)
    assert got.count() == rows.count() == got.select("operation_id").distinct().count()
    accepted = got.where("status = 'accepted'")
    assert V.gaps(accepted).count() == 0
    want = {r.operation_id: r.status for r in T.decisions(spark, SF).collect()}
    assert {r.operation_id: r.status for r in got.collect()} == want
    told = spark.read.parquet(str(tmp_path / "answers")).groupBy("batch", "class").count().collect()
    assert {(r.batch, r["class"]): r["count"] for r in told} == {(0, "new"): 400, (1, "replay"): 400, (1, "new"): 300, (2, "new"): rows.count() - 700}


def test_every_proposal_is_answered_once(spark, tmp_path):
    """A request with a conflict, and one that sends a proposal of it again."""
    schema = "stream_id string, client_id string, client_sequence long, operation_id string, intent_hash string, request string, ts long, event_id long, op string, col_type string"
    rows = lambda *some: spark.createDataFrame([(*r, n, n, "putRow", "x") for n, r in enumerate(some)], schema)
    first = rows(("s", "c", 9, "z", "i", "r0"))
    second = rows(("s", "a", 1, "x", "i", "r1"), ("s", "a", 2, "z", "i", "r1"), ("s", "a", 1, "x", "i", "r2"), ("s", "a", 2, "b", "i", "r3"))
    store = decided_in_batches(spark, tmp_path, [first, second], answers=str(tmp_path / "answers"), request="request")
    told = spark.read.parquet(str(tmp_path / "answers")).where("batch = 1").collect()
    assert sorted((r.operation_id, r.client_sequence, r["class"], r.sequence) for r in told) == [
        ("b", 2, "new", 3), ("x", 1, "aborted", None), ("x", 1, "new", 2), ("z", 2, "operation-identity-conflict", None),
    ]
    assert sorted((r.operation_id, r.sequence) for r in store.all(2).collect()) == [("b", 3), ("x", 2), ("z", 1)]


def test_lookups_read_no_more_files_as_history_grows(spark, tmp_path):
    schema = "stream_id string, operation_id string, client_id string, client_sequence long, intent_hash string, status string, sequence long, reason string"
    batch = spark.createDataFrame([("s", "o5", "c", 5, "i", "", 0, ""), ("s", "none", "c", -1, "i", "", 0, "")], schema)
    files = []
    for size in (40, 400):
        store = DecisionStore(spark, str(tmp_path / str(size)), batch.schema, buckets=4, fan=3)
        for n in range(10):
            made = spark.range(n * size, (n + 1) * size).selectExpr("'s' AS stream_id", "concat('o', id) AS operation_id", "'c' AS client_id", "id AS client_sequence", "'i' AS intent_hash", "'accepted' AS status", "id + 1 AS sequence", "cast(null AS string) AS reason")
            store.append(made, n)
        store.append(made, 9)  # again, as after a failure
        assert store.runs(10) == [(2, 0), (0, 9)] and store.all(10).count() == 10 * size
        known, places = store.lookup(batch, 10)
        assert known.where("operation_id = 'o5'").count() == 1 and places.where("client_sequence = 5").count() == 1
        assert store.heads(10).collect()[0].head_sequence == 10 * size
        files.append(known.select(F.input_file_name()).distinct().count())
    assert files[0] == files[1] <= 4


STATEFUL = "stream_id string, request_id string, operation_id string, client_id string, client_sequence long, intent_hash string, ord long, kind string"


def decided_with_state(spark, path, batches, decided=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    judge = lambda state, row: None if state == "on" or row.kind == "enable" else "disabled"
    apply = lambda state, row: "on"
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, STATEFUL).coalesce(1).write.parquet(str(path / "in" / str(n)))
        stream = spark.readStream.schema(STATEFUL).parquet(str(path / "in" / "*"))
        query = A.decide_stateful(stream, "off", judge, apply, decided).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "at"))
        query.trigger(availableNow=True).start().awaitTermination()
        every = [tuple(r)[1:] for r in spark.read.parquet(str(path / "out")).collect()]
        out.append(sorted((r for r in every if r[0].startswith(str(n))), key=str))
    return out


def test_stateful_authority_has_all_classes_across_restarts(spark, tmp_path):
    row = lambda request, op, position, ord_, kind="write", intent="i": ("s", request, op, "c", position, intent, ord_, kind)
    batches = [
        [row("0a", "a", 1, 1), row("0b", "b", 2, 2, "enable"), row("0b", "c", 3, 3)],
        [row("1a", "c", 3, 4), row("1b", "c", 4, 5), row("1c", "b", 2, 6, intent="j"), row("1d", "new", 2, 7), row("1d", "d", 5, 8), row("1e", "d", 5, 9), row("1e", "d", 5, 10)],
        [row("2a", "e", 6, 11), row("2a", "f", 6, 12), row("2b", "f", 6, 13), row("2c", "a", 1, 14)],
    ]
    got = decided_with_state(spark, tmp_path, batches)
    assert got[0] == [("0a", "a", "new", None, "disabled"), ("0b", "b", "new", 1, None), ("0b", "c", "new", 2, None)]
    assert got[1] == [
        ("1a", "c", "replay", 2, None), ("1b", "c", "operation-identity-conflict", None, None), ("1c", "b", "operation-intent-conflict", None, None),
        ("1d", "d", "aborted", None, None), ("1d", "new", "client-sequence-conflict", None, None), ("1e", "d", "new", 3, None), ("1e", "d", "repeat", 3, None),
    ]
    assert got[2] == [("2a", "e", "aborted", None, None), ("2a", "f", "client-sequence-conflict", None, None), ("2b", "f", "new", 4, None), ("2c", "a", "replay", None, "disabled")]


def test_stateful_authority_begins_from_stored_decisions(spark, tmp_path):
    decided = spark.createDataFrame(
        [("s", "old", "c", 1, "i", 7, None, "on"), ("s", "no", "c", 2, "i", None, "why", None)],
        "stream_id string, operation_id string, client_id string, client_sequence long, intent_hash string, sequence long, reason string, state string",
    )
    rows = [("s", "0a", "old", "c", 1, "i", 1, "write"), ("s", "0b", "no", "c", 2, "i", 2, "write"), ("s", "0c", "x", "c", 2, "i", 3, "write"), ("s", "0d", "y", "c", 3, "i", 4, "write")]
    got = decided_with_state(spark, tmp_path, [rows], decided)[0]
    assert got == [("0a", "old", "replay", 7, None), ("0b", "no", "replay", None, "why"), ("0c", "x", "client-sequence-conflict", None, None), ("0d", "y", "new", 8, None)]
