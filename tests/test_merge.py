"""Merging of responses against a plain replica that takes each list in order."""

import copy
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from loomlog.operators import merge as G

REPLICAS = "stream_id string, client_id string, retained_base long, confirmed_sequence long"
OUTBOX = "stream_id string, client_id string, operation_id string, client_sequence long, intent_hash string, status string, sequence long, operation string"
ENTRY = "stream_id string, client_id string, sequence long, operation_id string, origin_client string, client_sequence long, intent_hash string, operation string"
PAGES = "stream_id string, client_id string, base_sequence long, head_sequence long"
DECISIONS = "stream_id string, client_id string, decision_ord long, operation_id string, status string, sequence long, operation string"


class Refused(Exception):
    pass


def plain(client, base, confirmed, outbox, retained, page, decisions, entries):
    """One replica: lists of dicts in, ``(confirmed, outbox, new entries, resolutions)`` out."""
    outbox, log, new, learned = copy.deepcopy(outbox), list(retained), [], []
    if page[0] > confirmed:
        raise Refused("log-gap")

    def matches(o, e):
        if (o["id"], client, o["at"], o["hash"]) != (e["id"], e["client"], e["at"], e["hash"]):
            raise Refused("log-divergence")

    for d in decisions:
        o = next((o for o in outbox if o["id"] == d["id"]), None)
        if o is None:
            continue
        if d["status"] == "rejected":
            if o["status"] == "accepted":
                raise Refused("decision-conflict")
            outbox.remove(o)
        elif o["status"] == "accepted":
            if (o["seq"], o["op"]) != (d["seq"], d["op"]):
                raise Refused("decision-conflict")
            continue
        else:
            o.update(status="accepted", seq=d["seq"], op=d["op"])
        learned.append((d["id"], d["status"]))
    for e in entries:
        if e["seq"] <= base:
            continue
        if e["seq"] <= confirmed + len(new):
            if log[e["seq"] - base - 1] != e:
                raise Refused("log-divergence")
        else:
            if e["seq"] != confirmed + len(new) + 1:
                raise Refused("log-gap")
            new.append(e)
            log.append(e)
        o = next((o for o in outbox if o["id"] == e["id"]), None)
        if o is not None:
            matches(o, e)
            if o["status"] == "accepted" and (o["seq"], o["op"]) != (e["seq"], e["op"]):
                raise Refused("decision-conflict")
            if o["status"] == "pending":
                learned.append((e["id"], "accepted"))
            outbox.remove(o)
    through = confirmed + len(new)
    for o in list(outbox):
        if o["status"] != "accepted" or o["seq"] > through:
            continue
        if o["seq"] <= base:
            raise Refused("compacted-entry")
        e = log[o["seq"] - base - 1]
        matches(o, e)
        if o["op"] != e["op"]:
            raise Refused("decision-conflict")
        outbox.remove(o)
    return through, outbox, new, learned


def random_replica(rng, client):
    n, base = 12, rng.randrange(4)
    confirmed = rng.randrange(base, 9)
    log = [{"seq": s, "id": f"e{s}", "client": rng.choice([client, "other"]), "at": s, "hash": "h", "op": f"p{s}"} for s in range(1, n + 1)]
    outbox, decisions = [], []
    for e in log:
        if e["client"] == client and rng.random() < 0.7 and e["seq"] > confirmed - rng.choice([0, 0, 3]):
            accepted = rng.random() < 0.4
            outbox.append({"id": e["id"], "at": e["at"], "hash": "h", "status": "accepted" if accepted else "pending", "seq": e["seq"] if accepted else None, "op": e["op"] if accepted else None})
            if rng.random() < 0.5:
                decisions.append({"id": e["id"], "status": "accepted", "seq": e["seq"], "op": e["op"]})
    for k in range(3):
        outbox.append({"id": f"n{k}", "at": 50 + k, "hash": "h", "status": "pending", "seq": None, "op": None})
        if rng.random() < 0.4:
            decisions.append({"id": f"n{k}", "status": "rejected", "seq": None, "op": "why"})
    rng.shuffle(decisions)
    start = max(0, confirmed - rng.choice([0, 1, 5, -1, 20]))
    through = min(n, start + rng.choice([0, 3, 8]))
    entries = copy.deepcopy([e for e in log if start < e["seq"] <= through])
    if rng.random() < 0.35:  # something is odd
        one = rng.choice(rng.choice([x for x in (entries, decisions, outbox) if x]))
        name = rng.choice([k for k in one if k in ("id", "op", "hash", "at")])
        one[name] = 77 if name == "at" else "odd"
    return base, confirmed, outbox, [e for e in log if base < e["seq"] <= confirmed], (start, n), decisions, entries


def test_new_entries_stay_in_columns():
    """Of a page, what the replica has and what its outbox knows is looked at row by row, in batches of any size."""
    class Counted(G._Replica):
        looked = 0

        def take(self, row):
            Counted.looked += 1
            super().take(row)

    fields = [f.split() for f in f"stream_id string, client_id string, tag long, {G.FIELDS}".split(", ")]
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in fields])
    row = lambda tag, ord_, **more: {"stream_id": "s", "client_id": "a", "tag": G.TAGS[tag], "ord": ord_} | more
    entry = lambda tag, n: row(tag, n, sequence=n, operation_id=f"e{n}", origin_client="a", client_sequence=n, intent_hash="h", operation="{}")
    rows = [row("replica", 0, sequence=2), row("page", 1, sequence=300)]
    rows.append(row("outbox", 40, operation_id="e40", client_sequence=40, intent_hash="h", status="pending"))
    rows.append(row("outbox", 50, operation_id="e50", client_sequence=50, intent_hash="h", status="accepted", sequence=50, operation="{}"))
    rows += [entry("retained", 1), entry("retained", 2), entry("entry", 2), *(entry("entry", n) for n in range(3, 258))]
    for size in (1, 2, 7, 100, 1000):
        Counted.looked, replica, new = 0, Counted(("s", "a")), []
        for at in range(0, len(rows), size):
            batch = pa.RecordBatch.from_pylist(rows[at : at + size], schema=schema)
            replica.take_all(batch, batch["tag"].to_numpy(), pc.fill_null(batch["sequence"], -1).to_numpy())
        out = [dict(zip([f.split()[0] for f in G.MERGED.split(", ")], r)) for r in replica.end(new)]
        assert Counted.looked == 7, size
        assert [n for b in new for n in b["sequence"].to_pylist()] == list(range(3, 258))
        assert [(r["kind"], r["operation_id"], r["status"], r["sequence"]) for r in out] == [("replica", None, "behind", 257), ("resolution", "e40", "accepted", 40)]
        broken = G._Replica(("s", "a"))
        for at in range(0, len(rows), size):
            batch = pa.RecordBatch.from_pylist([r for r in rows if r.get("sequence") != 100][at : at + size], schema=schema)
            if batch.num_rows:
                broken.take_all(batch, batch["tag"].to_numpy(), pc.fill_null(batch["sequence"], -1).to_numpy())
        assert broken.end(new := [])[0][3] == "log-gap: expected 100, received 101" and not new


@pytest.mark.parametrize("size", ["3", "10000"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_in_batches(spark, seed, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        test_against_a_plain_replica(spark, seed + 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_replica(spark, seed):
    rng, want, tables = random.Random(seed), {}, [[] for _ in range(6)]
    for n in range(250):
        client = f"c{n}"
        base, confirmed, outbox, retained, page, decisions, entries = random_replica(rng, client)
        try:
            want[client] = plain(client, base, confirmed, outbox, retained, page, decisions, entries)
        except Refused as why:
            want[client] = str(why)
        me = ("s", client)
        tables[0].append((*me, base, confirmed))
        tables[1] += [(*me, o["id"], o["at"], o["hash"], o["status"], o["seq"], o["op"]) for o in outbox]
        for k, some in ((2, retained), (5, entries)):
            tables[k] += [(*me, e["seq"], e["id"], e["client"], e["at"], e["hash"], e["op"]) for e in some]
        tables[3].append((*me, *page))
        tables[4] += [(*me, i, d["id"], d["status"], d["seq"], d["op"]) for i, d in enumerate(decisions)]
    frames = [spark.createDataFrame(rows, schema).repartition(2) for rows, schema in zip(tables, (REPLICAS, OUTBOX, ENTRY, PAGES, DECISIONS, ENTRY))]
    merged = G.merge_responses(*frames)
    # One exchange but for those that the test deals its tables by.
    assert merged._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    got = {}
    for r in merged.collect():
        got.setdefault(r.client_id, []).append(r)
    assert sum(isinstance(w, str) for w in want.values()) > 20 and sum(not isinstance(w, str) for w in want.values()) > 100
    kinds = set()
    for client, w in want.items():
        rows = got[client]
        of = {k: [r for r in rows if r.kind == k] for k in ("replica", "outbox", "entry", "resolution", "conflict")}
        if isinstance(w, str):
            assert [r.detail.split(":")[0] for r in of["conflict"]] == [w] and not of["entry"] and not of["replica"], (client, w, rows)
            kinds.add(w)
            continue
        assert not of["conflict"], (client, w, of["conflict"])
        assert of["replica"][0].sequence == w[0]
        assert sorted((r.operation_id, r.status, r.sequence, r.operation) for r in of["outbox"]) == sorted((o["id"], o["status"], o["seq"], o["op"]) for o in w[1])
        assert sorted(r.sequence for r in of["entry"]) == [e["seq"] for e in w[2]]
        assert [(r.operation_id, r.status) for r in sorted(of["resolution"], key=lambda r: r.ord)] == w[3]
    assert {"log-gap", "decision-conflict", "log-divergence"} <= kinds
