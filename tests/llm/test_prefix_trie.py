import hashlib
import math
import random
import re
import zlib

import pytest

from loomlog.llm import prefix_trie
from loomlog.llm.queries import op13_prefix_trie
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the trie by following every prefix of every rebuilt conversation."""
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in of.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = (0 if p in kids else 1), (len(nodes[p]) - 1) * words
        for k in kids.get(p, ()):
            more = sums(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for p, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids.get(p, ())), *sums(p), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def held(spark, rows, schema=SCHEMA, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    got = prefix_trie.trie(df).drop("ref_conv_id", "ref_nth").collect()
    return sorted(map(tuple, got), key=str)


def test_query_equals_sql(spark):
    from loomlog.llm.queries import ORACLE_SQL

    compare(spark, "/root/testdata/sf0.001", op13_prefix_trie, ORACLE_SQL["op13_prefix_trie"])


@pytest.mark.parametrize("seed", [1, 2])
def test_small_alphabet(spark, seed):
    """Few different turns, so that conversations share prefixes far down."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x y", "z", "", None])) for c in range(60) for t in range(rng.choice([0, 1, 2, 4, 9]))]
    assert held(spark, rows) == brute(rows)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    long = "word " * 20_000
    rows = [(c, t, "u", f"turn {t}") for c in range(40, 75) for t in range(5)]  # copies
    rows += [(None, 1, "u", "of none"), (40, None, "u", "null turn"), (80, 1, None, None), (99, 1, "u", long), (99, 2, "a", long), (99, 3, "", "")]
    rows += [(7, t, "u", f"deep {t}") for t in range(600)]  # one conversation of most rows
    rows += [(120 + c, t, "u", f"grows {t}") for c in range(20) for t in range(c)]
    rows += [(-5, 1, "u", "negative"), (2, 1, "ab", "c"), (3, 1, "a", "bc")]
    got = held(spark, rows, SCHEMA + ", depth int, fa string, part int", (1, "x", 2))
    assert got == brute(rows)


def test_repeated_rows_are_turns(spark):
    rows = [(0, 1, "u", "same")] * 9
    assert held(spark, rows) == brute(rows)


def test_nothing(spark):
    assert held(spark, []) == []
    assert held(spark, [(None, 1, "u", "x")]) == []
