import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import decide as D
from loomlog.operators import requests as R

DECISION = "stream_id string, operation_id string, client_id string, client_sequence long, intent_hash string, status string, sequence long"
BATCH = "stream_id string, request_id string, request_ord long, proposal_ord long, operation_id string, client_id string, client_sequence long, intent_hash string, base_sequence long"


def one_by_one(decisions, batch, heads, reason=lambda p: None):
    """Every request after another, as an authority takes them."""
    seen = {(d[0], d[1]): (d[2:5], d[5], d[6], None) for d in decisions}
    places = {(d[0], d[2], d[3]): d[1] for d in decisions}
    at, out = dict(heads), {}
    requests = {}
    for p in batch:
        requests.setdefault((p[0], p[2], p[1]), []).append(p)
    for key in sorted(requests):
        rows = sorted(requests[key], key=lambda p: p[3])
        stream = key[0]
        staged, held, head, told, failed = {}, {}, at.get(stream, 0), [], None
        if rows[0][8] > heads.get(stream, 0):
            failed = (rows[0], R.FUTURE)
        for p in rows if failed is None else []:
            name, claim, place = p[4], p[5:8], (stream, p[5], p[6])
            old = staged.get(name) or seen.get((stream, name))
            if old:
                kind = D.IDENTITY if old[0][:2] != claim[:2] else D.INTENT if old[0] != claim else D.REPEAT if name in staged or old[3] == "batch" else D.REPLAY
            else:
                kind = D.POSITION if (held.get(place) or places.get(place)) else D.NEW
            if kind in D.CONFLICTS:
                failed = (p, kind)
                break
            if kind == D.NEW:
                why = reason(p)
                head += why is None
                old = (claim, "rejected" if why else "accepted", None if why else head, "batch")
                staged[name], held[place] = old, name
            told.append((p, kind, old[1], old[2]))
        if failed:
            told = [(p, failed[1] if p is failed[0] else D.ABORTED, None, None) for p in rows]
        else:
            seen |= {(stream, n): v for n, v in staged.items()}
            places |= held
            at[stream] = head
        for p, kind, status, sequence in told:
            out[p[:4]] = (kind, status, sequence)
    return out


def check(spark, decisions, batch, heads=None):
    heads = heads or {"s": max([d[6] or 0 for d in decisions], default=0)}
    known = spark.createDataFrame(decisions, DECISION)
    rows = spark.createDataFrame(batch, BATCH).repartition(3)
    reason = F.when(F.col("operation_id").like("%9"), "nine")
    got = R.decide_requests(rows, known, reason, spark.createDataFrame(list(heads.items()), "stream_id string, head_sequence long"))
    told = got.select("stream_id", "request_id", "request_ord", "proposal_ord", "class", "status", "sequence").collect()
    assert len(told) == len(batch)
    found = {tuple(r)[:4]: tuple(r)[4:] for r in told}
    want = one_by_one(decisions, batch, heads, lambda p: "nine" if p[4].endswith("9") else None)
    assert found == want, [(k, found[k], want[k]) for k in want if found.get(k) != want[k]][:5]
    return found


def p(request, ord_, op, client, position, intent="i", stream="s", base=0):
    return (stream, f"r{request}", request, ord_, op, client, position, intent, base)


def test_what_a_refused_request_named_is_free(spark):
    known = [("s", "z", "c", 9, "i", "accepted", 1)]
    batch = [p(1, 1, "x", "a", 1), p(1, 2, "z", "a", 2), p(2, 1, "x", "a", 1), p(3, 1, "b", "a", 2), p(4, 1, "x", "a", 1, "other"), p(5, 1, "w", "a", 3, base=7)]
    found = check(spark, known, batch)
    kinds = {(k[1], k[3]): v[0] for k, v in found.items()}
    assert kinds == {("r1", 1): D.ABORTED, ("r1", 2): D.IDENTITY, ("r2", 1): D.NEW, ("r3", 1): D.NEW, ("r4", 1): D.INTENT, ("r5", 1): R.FUTURE}


def test_chain_of_refusals(spark):
    """Each request clashes with the one before it, so every other one commits."""
    batch = [q for n in range(1, 12) for q in (p(n, 1, f"o{n}", "a", 2 * n, f"i{n}"), p(n, 2, f"o{n + 1}", "a", 2 * n + 1, f"j{n}"))]
    found = check(spark, [], batch)
    assert {k[1]: v[0] for k, v in found.items() if k[3] == 2} == {f"r{n}": D.NEW if n % 2 else D.ABORTED for n in range(1, 12)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_at_random(spark, seed):
    rng = random.Random(seed)
    known = [("s", f"k{n}", f"c{n % 3}", 100 + n, "i", "accepted", n + 1) for n in range(8)]
    batch = []
    for request in range(60):
        stream = rng.choice(["s", "s", "t"])
        for ord_ in range(rng.choice([1, 2, 4])):
            if rng.random() < 0.1:
                k = rng.choice(known)
                batch.append(p(request, ord_, k[1], k[2], k[3], rng.choice(["i", "i", "j"]), stream))
            else:
                n = rng.randrange(40)
                batch.append(p(request, ord_, f"o{n}", f"c{n % 3}", rng.choice([n, n, n, n + 1]), rng.choice(["i"] * 5 + ["j"]), stream))
    check(spark, known, batch, {"s": 8})
