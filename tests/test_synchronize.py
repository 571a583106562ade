import json

import pytest

from loomlog.operators import contract as K
from loomlog.operators import decide as D
from loomlog.operators.synchronize import synchronize
from loomlog.sources import wire as W

LOG = "stream_id string, sequence long, operation_id string, client_id string, client_sequence long, intent_hash string, operation string"
DECIDED = "stream_id string, operation_id string, client_id string, client_sequence long, intent_hash string, status string, sequence long, operation string, reason string"
TEXT, INTEGER = K.ColumnContract("text", False), K.ColumnContract("integer", True)
CONTRACT = K.Contract({"notes": K.TableContract(("id",), {"id": TEXT, "score": INTEGER})})


def put(row):
    return {"type": "putRow", "table": "notes", "row": row}


def request(stream, base, *proposals, most=100, **other):
    body = {"baseSequence": base, "maximumEntries": most, "proposals": list(proposals)}
    return json.dumps({"protocolVersion": 1, "streamId": stream, "request": body} | other)


def proposal(op, position, intent, client="c", hash_="h"):
    return {"operationId": op, "clientId": client, "clientSequence": position, "intentHash": hash_, "intent": intent}


def run(spark, texts, log=(), decided=()):
    requests = spark.createDataFrame([(f"r{n}", n, t) for n, t in enumerate(texts)], "request_id string, request_ord int, envelope string").repartition(2)
    done = synchronize(requests, spark.createDataFrame(list(log), LOG), spark.createDataFrame(list(decided), DECIDED), CONTRACT)
    answers = {r.request_id: r for r in done.answers.collect()}
    assert len(answers) == len(texts)
    wrong = W.response_errors(done.answers.where("envelope is not null").select("envelope")).where("code is not null").collect()
    assert not wrong
    return [(a.http_status, a.code, a.envelope and json.loads(a.envelope)["response"]) for _, a in sorted(answers.items(), key=lambda x: int(x[0][1:]))], done


def test_requests_one_after_another(spark):
    kept = '{"row":{"id":"old","score":null},"table":"notes","type":"putRow"}'
    log = [("s", 1, "o1", "c", 1, "h", kept)]
    decided = [("s", "o1", "c", 1, "h", "accepted", 1, kept, None), ("s", "o2", "c", 2, "h", "rejected", None, None, '{"code":"why"}')]
    texts = [
        request("s", 0, proposal("o1", 1, put({"id": "old"})), proposal("o2", 2, put({"id": "x"})), proposal("n1", 3, put({"id": "a", "score": 2}))),
        request("s", 1, proposal("n2", 4, put({"id": 5})), proposal("n3", 5, {"type": "deleteRow", "table": "notes", "key": {"id": "a"}})),
        request("s", 1, proposal("n4", 6, put({"id": "b"})), proposal("o1", 9, put({"id": "b"}))),
        request("s", 0, proposal("n5", 6, put({"id": "c"})), most=2),
        request("s", 7),
        request("s", 1),
        request("t", 0),
        request("t", 0, proposal("n1", 1, put({"id": "z"}))),
        request("s", 0, protocolVersion=2),
        None,
        request("s", -1),
    ]
    got, done = run(spark, texts, log, decided)
    assert [g[:2] for g in got] == [
        (200, None), (200, None), (409, D.IDENTITY), (200, None), (409, "future-base-sequence"), (200, None), (200, None), (200, None),
        (400, "unsupported-protocol-version"), (400, "wire-decode"), (400, "invalid-sequence"),
    ]
    first, second, _, fourth, _, pull, empty, other = (g[2] for g in got[:8])
    assert [(d["operationId"], d["status"], d.get("sequence"), d.get("reason")) for d in first["decisions"]] == [("o1", "accepted", 1, None), ("o2", "rejected", None, {"code": "why"}), ("n1", "accepted", 2, None)]
    assert first["decisions"][0]["operation"] == json.loads(kept) and first["decisions"][2]["operation"]["row"] == {"id": "a", "score": 2}
    assert (first["headSequence"], first["throughSequence"], [e["operationId"] for e in first["entries"]]) == (2, 2, ["o1", "n1"])
    assert second["decisions"][0] == {"operationId": "n2", "status": "rejected", "reason": {"code": "invalid-row-operation", "message": "notes.id must be text"}}
    assert (second["headSequence"], [e["sequence"] for e in second["entries"]]) == (3, [2, 3])
    assert second["entries"][1]["operation"] == {"type": "deleteRow", "table": "notes", "key": {"id": "a"}}
    # What the refused third request named is free again.
    assert fourth["decisions"][0]["sequence"] == 4 and (fourth["throughSequence"], fourth["headSequence"], len(fourth["entries"])) == (2, 4, 2)
    assert (pull["decisions"], [e["operationId"] for e in pull["entries"]]) == ([], ["n1", "n3", "n5"])
    assert (empty["headSequence"], empty["entries"]) == (0, []) and [e["sequence"] for e in other["entries"]] == [1]
    assert sorted((e.stream_id, e.sequence, e.operation_id) for e in done.entries.collect()) == [("s", 2, "n1"), ("s", 3, "n3"), ("s", 4, "n5"), ("t", 1, "n1")]
    assert {d.operation_id: (d.status, d.operation is None) for d in done.decisions.where("stream_id = 's'").collect()} == {"n1": ("accepted", False), "n2": ("rejected", True), "n3": ("accepted", False), "n5": ("accepted", False)}


def test_what_was_made_goes_on(spark):
    """A batch's entries and decisions, appended, answer the next batch."""
    _, done = run(spark, [request("s", 0, proposal("a", 1, put({"id": "x"})), proposal("b", 2, put({"id": 1})))])
    log, decided = ([tuple(r) for r in df.collect()] for df in (done.entries, done.decisions))
    got, _ = run(spark, [request("s", 0, proposal("a", 1, put({"id": "x"})), proposal("b", 2, put({"id": 1})), proposal("c", 3, put({"id": "y"})))], log, decided)
    assert [(d["operationId"], d["status"], d.get("sequence")) for d in got[0][2]["decisions"]] == [("a", "accepted", 1), ("b", "rejected", None), ("c", "accepted", 2)]


@pytest.mark.parametrize("texts", [[], [None], [request("s", 0)]])
def test_little_or_nothing(spark, texts):
    got, done = run(spark, texts)
    assert [g[0] for g in got] == [400 if t is None else 200 for t in texts]
    assert done.entries.count() == done.decisions.count() == 0
