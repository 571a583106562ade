from pyspark.sql import functions as F

from loomlog.sources import wire as W


def test_bad_envelopes_have_an_error(spark):
    good = '{"protocolVersion":1,"streamId":"s","request":{"baseSequence":0,"maximumEntries":9,"proposals":[{"operationId":"o","clientId":"c","clientSequence":1,"intentHash":"h","intent":"{}"}]}}'
    rows = [("good", good), ("version", good.replace('"protocolVersion":1', '"protocolVersion":99')), ("stream", good.replace('"s"', '""')), ("text", "{"), ("null", None), ("pull", good.split('"proposals"')[0] + '"proposals":[]}}')]
    got = {r.name: r for r in W.decode_requests(spark.createDataFrame(rows, "name string, envelope string")).collect()}
    assert {n: r.error for n, r in got.items()} == {"good": None, "version": "unsupported-protocol-version", "stream": "wire-decode", "text": "wire-decode", "null": "wire-decode", "pull": None}
    assert (got["good"].operation_id, got["good"].client_sequence, got["good"].proposal_ord) == ("o", 1, 0) and got["pull"].operation_id is None


def test_envelopes_are_canonical_and_ordered(spark):
    schema = "request_id string, stream_id string, base_sequence long, maximum_entries long, proposal_ord long, operation_id string, client_id string, client_sequence long, intent_hash string, intent string"
    rows = [("r", "s", 0, 9, i, f"o{i}", "c", i, "h", '{"a":1}') for i in (10, 9, 2)]
    text = W.encode_requests(spark.createDataFrame(rows, schema)).first().envelope
    proposals = ",".join(f'{{"clientId":"c","clientSequence":{i},"intent":{{"a":1}},"intentHash":"h","operationId":"o{i}"}}' for i in (2, 9, 10))
    assert text == f'{{"protocolVersion":1,"request":{{"baseSequence":0,"maximumEntries":9,"proposals":[{proposals}]}},"streamId":"s"}}'


def test_empty_page_round_trips(spark):
    pages = spark.createDataFrame([("s", 0, 5, 5, 5)], "stream_id string, page long, base_sequence long, through_sequence long, head_sequence long")
    entries = spark.createDataFrame([], "stream_id string, page long, sequence long, operation_id string, client_id string, client_sequence long, intent_hash string, operation string")
    row = W.decode_responses(W.encode_responses(pages, entries)).first()
    assert (row.through_sequence, row.head_sequence, row.sequence, row.error) == (5, 5, None, None)


def test_lists_of_other_pages_are_not_gathered(spark, monkeypatch):
    pages = spark.createDataFrame([("s", 0, 5, 5, 5)], "stream_id string, page long, base_sequence long, through_sequence long, head_sequence long")
    entries = spark.createDataFrame([("s", p, 6 + p, "o", "c", 1, "h", "{}") for p in (0, -1)], "stream_id string, page long, sequence long, operation_id string, client_id string, client_sequence long, intent_hash string, operation string")
    decisions = entries.selectExpr("stream_id", "page", "1 AS decision_ord", "operation_id", "'accepted' AS status", "sequence", "operation", "cast(null AS string) AS reason")
    monkeypatch.setattr(W, "_ordered", lambda json, by: F.max(F.when(F.col("page") < 0, F.raise_error(F.lit("gathered"))).otherwise("[]")))
    assert len(W.encode_responses(pages, entries, decisions).collect()) == 1


def test_decisions_that_are_neither_have_an_error_with_a_path(spark):
    good = '{"protocolVersion":1,"streamId":"s","response":{"requestedBaseSequence":0,"throughSequence":0,"headSequence":9,"entries":[],"decisions":[{"operationId":"a","status":"accepted","sequence":7,"operation":{"x":1}},{"operationId":"b","status":"rejected","reason":{"code":"no"}}]}}'
    rows = [("good", good), ("status", good.replace("rejected", "deferred")), ("sequence", good.replace('"sequence":7,', "")), ("text", "{")]
    got = sorted((r.name, r.decision_ord, r.error, r.error_path, r.operation_id, r.operation, r.reason) for r in W.decode_decisions(spark.createDataFrame(rows, "name string, envelope string")).collect() if r.name != "text" or r.error)
    assert got[0] == ("good", 0, None, None, "a", '{"x":1}', None) and got[1] == ("good", 1, None, None, "b", None, '{"code":"no"}')
    assert [(n, i, e, p) for n, i, e, p, *_ in got[2:]] == [("sequence", 0, "wire-decode", "$.response.decisions[0]"), ("sequence", 1, None, None), ("status", 0, None, None), ("status", 1, "wire-decode", "$.response.decisions[1]"), ("text", None, "wire-decode", "$")]
