import math
import random
import re
from collections import Counter

import pytest

from loomlog.llm import lexical
from loomlog.llm.queries import ORACLE_SQL, op12_lexical
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """Results by scoring every document for every query."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    n_terms = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs // n_terms if n_terms else 0)
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, queries, k):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, terms string, query long").repartition(3)
    q = spark.createDataFrame([(*x, 0) for x in queries], "item_id int, text string, rank int")
    return sorted(map(tuple, lexical.rank_all(d, q, k).collect()), key=str)


def test_query_equals_sql(spark):
    assert compare(spark, "/root/testdata/sf0.001", op12_lexical, ORACLE_SQL["op12_lexical"]) > 0


@pytest.mark.parametrize("leaf", [0, 3, 2048])
def test_intervals_against_brute_force(spark, monkeypatch, leaf):
    """Many intervals a block, several blocks a task, many equal scores."""
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = random.Random(leaf)
    words = [f"w{n}" for n in range(40)] + ["Ünï", "中文"]
    weights = [1 / (n + 1) for n in range(len(words))]
    docs = [(rng.randrange(200), " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 30])))) for _ in range(400)]
    docs += [(n, "w1 w2, w3") for n in range(500, 560)]
    queries = [(n, " ".join(rng.choices(words, k=n))) for n in range(12)]
    assert run(spark, docs, queries, 10) == brute(docs, queries, 10)


def test_blocks_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    docs = [(n, f"a b{n % 7} c") for n in range(100)]
    parts = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    assert parts.count() == 2
    queries = [(1, "b3 A"), (1, "b3 A"), (None, "b1"), (3, "zzz"), (4, "c")]
    q = spark.createDataFrame(queries, "item_id int, text string")
    assert sorted(map(tuple, lexical.search(parts, q, 5).collect()), key=str) == brute(docs, queries, 5)


def test_hard_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "..."), (4, "ALPHA alpha\x00É é"), (4, "ALPHA alpha\x00É é"), (5, "alpha " * 70_000 + "tail"), (6, "b" * 100_000)]
    queries = [(1, "Alpha"), (2, None), (3, ""), (4, "é tail"), (5, "É"), (6, "b" * 100_000), (7, "--")]
    assert run(spark, docs, queries, 50) == brute(docs, queries, 50)


def test_nothing(spark):
    assert run(spark, [], [(1, "a")], 5) == []
    assert run(spark, [(1, "a")], [], 5) == []
    assert run(spark, [(1, None), (2, "!")], [(1, "a")], 5) == []
