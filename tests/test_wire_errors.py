import copy
import json

import pytest

from loomlog.sources import wire as W

PROPOSAL = {"operationId": "op-1", "clientId": "client", "clientSequence": 1, "intentHash": "hash-1", "intent": {"delta": 1}}
REQUEST = {"protocolVersion": 1, "streamId": "s", "request": {"baseSequence": 0, "maximumEntries": 1, "proposals": [PROPOSAL, PROPOSAL | {"operationId": "op-2", "clientSequence": 2}]}}
ENTRIES = [{"sequence": n, "operationId": f"op-{n}", "origin": {"clientId": "client", "clientSequence": n, "intentHash": "h"}, "operation": None} for n in (1, 2)]
DECISIONS = [{"operationId": "op-2", "status": "accepted", "sequence": 2, "operation": {}}, {"operationId": "op-9", "status": "rejected", "reason": "no"}]
RESPONSE = {"protocolVersion": 1, "streamId": "s", "response": {"requestedBaseSequence": 0, "throughSequence": 2, "headSequence": 2, "entries": ENTRIES, "decisions": DECISIONS}}
GONE = object()
P, E, D = "$.request.proposals", "$.response.entries", "$.response.decisions"


def with_(whole, path, value):
    out = copy.deepcopy(whole)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


def request(*path, value):
    return with_(REQUEST, ["request", *path], value)


def response(*path, value):
    return with_(RESPONSE, ["response", *path], value)


REQUESTS = [
    (json.dumps(REQUEST), None, None),
    (request("baseSequence", value=1.0), None, None),
    (request("proposals", value=[]), None, None),
    (request("proposals", 0, "intent", value=None), None, None),
    (None, "wire-decode", "$"),
    ("no json", "wire-decode", "$"),
    ("[]", "wire-decode", "$"),
    ("null", "wire-decode", "$"),
    ("{}", "unsupported-protocol-version", "$.protocolVersion"),
    (with_(REQUEST, ["protocolVersion"], 99), "unsupported-protocol-version", "$.protocolVersion"),
    (with_(REQUEST, ["protocolVersion"], "1"), "unsupported-protocol-version", "$.protocolVersion"),
    (with_(REQUEST, ["streamId"], ""), "wire-decode", "$.streamId"),
    (with_(REQUEST, ["streamId"], 5), "wire-decode", "$.streamId"),
    (with_(REQUEST, ["request"], []), "wire-decode", "$.request"),
    (request("proposals", value={}), "wire-decode", P),
    (request("proposals", value=[PROPOSAL] * 65), "protocol-limit", P),
    (request("proposals", 1, value="x"), "wire-decode", f"{P}[1]"),
    (request("proposals", 0, "operationId", value=""), "wire-decode", f"{P}[0].operationId"),
    (request("proposals", 0, value={"operationId": ""}), "wire-decode", f"{P}[0].operationId"),
    (request("proposals", 1, "clientId", value=None), "wire-decode", f"{P}[1].clientId"),
    (request("proposals", 1, "clientSequence", value="2"), "wire-decode", f"{P}[1].clientSequence"),
    (request("proposals", 1, "intentHash", value=GONE), "wire-decode", f"{P}[1].intentHash"),
    (request("proposals", 1, "intent", value=GONE), "wire-decode", f"{P}[1].intent"),
    (request("baseSequence", value="5"), "wire-decode", "$.request.baseSequence"),
    (request("baseSequence", value=-1), "invalid-sequence", "$.request.baseSequence"),
    (request("baseSequence", value=1.5), "invalid-sequence", "$.request.baseSequence"),
    (request("baseSequence", value=2**53), "invalid-sequence", "$.request.baseSequence"),
    (request("maximumEntries", value=0), "invalid-limit", "$.request.maximumEntries"),
    (request("maximumEntries", value=GONE), "wire-decode", "$.request.maximumEntries"),
    (request("proposals", 0, "clientSequence", value=0), "invalid-sequence", f"{P}[0].clientSequence"),
    (request("proposals", 1, "operationId", value="op-1"), "duplicate-operation-id", f"{P}[1].operationId"),
    (request("proposals", 1, "clientSequence", value=1), "proposal-order", f"{P}[1].clientSequence"),
]

RESPONSES = [
    (json.dumps(RESPONSE), None, None),
    (response("throughSequence", value=GONE), "wire-decode", "$.response.throughSequence"),
    (response("entries", value=ENTRIES[:1]), "malformed-response", E),
    (response("entries", value=None), "wire-decode", E),
    (response("decisions", value=GONE), "wire-decode", D),
    (response("entries", value=ENTRIES * 129), "protocol-limit", E),
    (response("decisions", value=DECISIONS * 33), "protocol-limit", D),
    (response("entries", 1, "origin", value=[]), "wire-decode", f"{E}[1].origin"),
    (response("entries", 1, "origin", "clientId", value=""), "wire-decode", f"{E}[1].origin.clientId"),
    (response("entries", 0, "operation", value=GONE), "wire-decode", f"{E}[0].operation"),
    (response("entries", 1, "sequence", value=3), "malformed-response", f"{E}[1].sequence"),
    (response("entries", 1, "operationId", value="op-1"), "malformed-response", f"{E}[1].operationId"),
    (response("entries", 1, "origin", "clientSequence", value=1), "malformed-response", f"{E}[1].origin"),
    (response("headSequence", value=1), "malformed-response", "$.response.throughSequence"),
    (response("requestedBaseSequence", value=3), "malformed-response", "$.response.requestedBaseSequence"),
    (with_(RESPONSE, ["response"], {"requestedBaseSequence": 0, "throughSequence": 0, "headSequence": 2, "entries": [], "decisions": []}), "malformed-response", "$.response.throughSequence"),
    (response("decisions", 0, "status", value="maybe"), "wire-decode", f"{D}[0].status"),
    (response("decisions", 0, "status", value=GONE), "wire-decode", f"{D}[0].status"),
    (response("decisions", 0, "sequence", value=1), "malformed-response", f"{D}[0].sequence"),
    (response("decisions", 0, "sequence", value=0), "invalid-sequence", f"{D}[0].sequence"),
    (response("decisions", 0, value={"operationId": "op-8", "status": "accepted", "sequence": 3, "operation": 1}), "malformed-response", f"{D}[0].sequence"),
    (response("decisions", 1, "operationId", value="op-2"), "malformed-response", f"{D}[1].operationId"),
    (response("decisions", 1, "operationId", value="op-1"), "malformed-response", f"{D}[1]"),
    (response("decisions", 1, "reason", value=GONE), "wire-decode", f"{D}[1].reason"),
]


@pytest.mark.parametrize("cases,errors", [(REQUESTS, W.request_errors), (RESPONSES, W.response_errors)])
def test_first_rule_that_breaks(spark, cases, errors):
    texts = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(cases)], "n int, envelope string")
    got = {r.n: (r.code, r.path) for r in errors(texts).collect()}
    want = {n: c[1:] for n, c in enumerate(cases)}
    assert got == want, [(cases[n][0], got[n], want[n]) for n in want if got[n] != want[n]][:3]


def test_limits_are_the_callers(spark):
    texts = spark.createDataFrame([(json.dumps(REQUEST),)], "envelope string")
    assert W.request_errors(texts, 1).first().code == "protocol-limit"
    assert W.request_errors(texts.limit(0)).count() == 0
