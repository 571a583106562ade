import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import simhash


def brute_fingerprint(text, words=3):
    w = [x for x in "".join(c.lower() if c < "\x7f" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    label = {i: i for i, _ in rows}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (fp[a] ^ fp[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (f"{fp[i]:016x}", label[i]) for i in label}


def test_every_syndrome_has_one_pattern():
    nearest, ways = simhash.golay_tables()
    assert sorted(bin(int(x)).count("1") for x in nearest) == sorted([0] + [1] * 23 + [2] * 253 + [3] * 1771)
    assert all(len(set(w)) == (6 if int(w[0]).bit_count() == 3 else 1) for w in ways.tolist())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_keys_of_near_fingerprints_meet(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    index, probe = simhash.keys(np.array([fp, other], np.uint64))
    assert set(probe[0]) & set(index[1]) and set(probe[1]) & set(index[0])


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "a b", "a b c", "A B c d\ne", "é Ü x y z " * 7])
def test_fingerprint_as_defined(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, "x"), (3, " \n "), (4, "x")]
    for g in range(12):
        base = [word() for _ in range(150)]
        for k in range(5):
            copy = list(base)
            copy[rng.randrange(150)] = word()
            rows.append((10 + g * 10 + k, " ".join(copy)))
    rows.append((500, rows[-1][1]))
    return rows


@pytest.mark.parametrize("crowd", [64, 0])
def test_components_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rows = documents()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {c for _, c in got.values()}


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "q r s t u v")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.keep_one(spark.createDataFrame(rows, schema)).count() == 2


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(5)), (8, text(1)), (None, text(4))]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(1))], key=str)
