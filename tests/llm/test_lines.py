import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=24), st.text("abé ", max_size=24))
def test_edit_similarity(a, b):
    most = max(len(a), len(b))
    assert abs(lines.edit_similarity(a, b) - (1 - levenshtein(a, b) / most if most else 1)) < 1e-12
    assert lines._alike(a, b) == (lines.edit_similarity(a, b) >= 0.8)


def test_similarity_of_just_the_limit():
    assert lines._alike("abcde", "abcd") and lines._alike("abcde", "abcdx") and not lines._alike("abcd", "abcx")


def test_signatures_are_of_each_line_alone():
    text = pa.array(["", "one", "two words", "é ünd mehr wörter " * 9, "", "x y z", "last"])
    words, form = lines.normal(text)
    together = lines.signatures(words, form).to_pylist()
    alone = [lines.signatures(*lines.normal(text.slice(n, 1))).to_pylist()[0] for n in range(len(text))]
    assert together == alone and [len(t) for t in together] == [0, 128, 128, 64, 0, 128, 128]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word", "other", "a", "longer-word"]), min_size=50, max_size=80), st.lists(st.tuples(st.integers(0, 49), st.sampled_from(["", "x", "different"])), max_size=30))
def test_long_lines_compare_as_short_ones(words, changes):
    changed = list(words)
    for n, w in changes:
        changed[n] = w
    a, b = " ".join(words), " ".join(changed)
    assert lines.distance(a, b) == levenshtein(a, b)
    assert lines._alike(a, b) == (lines.edit_similarity(a, b) >= 0.8)


def brute_bits(words):
    if not words:
        return 0
    one = lambda w: int.from_bytes(xxhash.xxh64_digest(w.encode()), "big")
    hashes = []
    for n in range(max(1, len(words) - 1)):
        z = (one(words[n]) * 0x9E3779B97F4A7C15 + (one(words[n + 1]) if n + 1 < len(words) else 0)) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        hashes.append(z ^ z >> 31)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhashes():
    rows = [[], ["a"], ["a", "b", "a"], ["x", "y"], [f"w{i % 97}" for i in range(1000)], ["z"] * 256, ["q"] * 257, []]
    assert lines.simhashes(pa.array(rows, pa.list_(pa.string()))).view(np.uint64).tolist() == [brute_bits(r) for r in rows]


def brute_dedup(rows):
    """Kept lines by row, from all pairs of distinct lines."""
    occurrences = sorted(
        {((-1 if i is None else i), nr, i, t) for i, t in rows if t is not None for nr in range(len(t.split("\n")))}, key=lambda x: x[:2]
    )
    form = lambda t, nr: " ".join(t.split("\n")[nr].lower().split())
    distinct = list(dict.fromkeys(f for _, nr, _, t in occurrences if (f := form(t, nr))))
    bits = [brute_bits(d.split()) for d in distinct]
    group = list(range(len(distinct)))

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in range(len(distinct)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= 3 and 1 - levenshtein(distinct[a], distinct[b]) / max(len(distinct[a]), len(distinct[b])) >= 0.8:
                group[root(a)] = root(b)
    of, seen, gone = {d: root(n) for n, d in enumerate(distinct)}, set(), set()
    for _, nr, i, t in occurrences:
        f = form(t, nr)
        if f and of[f] in seen:
            gone.add((i, t, nr))
        elif f:
            seen.add(of[f])
    return [(i, t if t is None else "\n".join(x for nr, x in enumerate(t.split("\n")) if (i, t, nr) not in gone)) for i, t in rows]


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    out = [(0, None), (1, ""), (2, " \n\n\t"), (None, base[0] + "\nonly here")]
    for i in range(3, 40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] += rng.choice(["x", "", "y"])
            text.append(("  " if rng.random() < 0.3 else "") + " ".join(w).capitalize())
        out.append((i, "\n".join(text)))
    return out + [out[-1], (41, "unique line\n\n" + base[3])]


@pytest.mark.parametrize("most", [1, 3, 64])
@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_meetings(most, batch):
    rng = random.Random(most * batch)
    rows = sorted((rng.randrange(9) ** 2, n, rng.randrange(64)) for n in range(60))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + batch])], ["key", "number", "bits"]) for i in range(0, 60, batch)]
    got = [r for b in lines._meetings(iter(batches), most) for r in b.to_pylist()]
    by_key = {}
    for key, n, bits in rows:
        by_key.setdefault(key, []).append((n, bits))
    pairs = [(a, b) for g in by_key.values() if len(g) <= most for a, x in g for b, y in g if a < b and (x ^ y).bit_count() <= 3]
    crowd = [(k, n, x) for k, g in by_key.items() if len(g) > most for n, x in g]
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == sorted(pairs)
    assert sorted((r["key"], r["a"], r["bits"]) for r in got if r["b"] is None) == crowd


@pytest.mark.parametrize("crowd,seen,many", [(64, 1000, 1 << 27), (0, 0, 1 << 27), (0, 1000, 0)])
def test_equals_brute_force(spark, monkeypatch, crowd, seen, many):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "SEEN", seen)
    monkeypatch.setattr(lines, "SAMPLED", 1 if seen == 0 else 64)
    monkeypatch.setattr(lines, "MANY", many)
    monkeypatch.setattr(lines, "CHUNK", 7)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows()], "doc_id long, text string, line string, th int")
    got = lines.dedup(df)
    assert got.columns == [*df.columns, "lines_dropped"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute_dedup(rows()), key=key)


def test_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert lines.dedup(spark.createDataFrame([], schema)).count() == 0
    long_line = " ".join(f"word{i}" for i in range(20_000))
    other = long_line.replace("word777 ", "")
    got = {r.doc_id: (r.text, r.lines_dropped) for r in lines.dedup(spark.createDataFrame([(2, other + "\nx"), (1, long_line)], schema)).collect()}
    assert got == {1: (long_line, 0), 2: ("x", 1)}


def test_wide_without_a_word(spark):
    df = spark.createDataFrame([(1, ""), (2, " \n\t"), (None, None)], "doc_id long, text string")
    assert sorted((r.text or "?", r.lines_dropped) for r in lines.dedup(df, wide=True).collect()) == [(" \n\t", 0), ("?", 0), ("?", 0)]


def edited(rng, line, share):
    """``line`` with so many of its words replaced, or a letter appended to one."""
    w = line.split()
    if not share:
        w[rng.randrange(len(w))] += rng.choice("xyz")
    for n in rng.sample(range(len(w)), int(share * len(w))):
        w[n] = "".join(rng.sample(w[n], len(w[n])))[::-1] + rng.choice("xyz")
    return " ".join(w)


@pytest.mark.parametrize("crowd", [64, 0])
def test_wide_finds_lines_of_edit_similarity(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "CHUNK", 7)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqé") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 6, 8, 12, 16, 32, 60) for _ in range(20)]
    rows = list(enumerate(base + [edited(rng, line, share) for line in base for share in (0, 0.1)]))
    near = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and lines.edit_similarity(a, b) >= 0.8
    linked = {(i, t) for n, (i, t) in enumerate(rows) if any(near(t, u) for _, u in rows[:n])}
    apart = {(i, t) for i, t in rows} - linked
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), wide=True).where("lines_dropped = 1").select("doc_id").collect()
    gone = [r.doc_id for r in got]
    assert len(linked) > 250 and len(gone) >= 0.97 * len(linked)
    assert not set(gone) & {i for i, _ in apart}


def test_counts_of_letters_bound_the_edits():
    rng = random.Random(4)
    a = ["".join(rng.choice("abcé 漢") for _ in range(rng.randrange(1, 30))) for _ in range(2000)] + ["a" * 300]
    b = ["".join(c if rng.random() < 0.9 else "x" for c in t) for t in a]
    reach = lines.reachable(lines.letters(pa.array(a)), lines.letters(pa.array(b)))
    assert all(r for r, x, y in zip(reach, a, b) if lines.edit_similarity(x, y) >= 0.8) and not reach.all()


def test_distance_gives_up_only_beyond_the_most():
    rng = random.Random(5)
    for _ in range(600):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(60))) for _ in range(2))
        if rng.random() < 0.5:
            b = "".join(x for x in a if rng.random() > 0.1)
        true, most = lines.distance(a, b), rng.randrange(30)
        found = lines.distance(a, b, most)
        assert found == true if true <= most else found > most
        similar = (1 - true / max(len(a), len(b)) if a or b else 1.0) >= lines.SIMILAR - 1e-9
        assert lines._alike(a, b) == similar


def test_pairs_compare_together_as_alone():
    rng = random.Random(6)
    a = ["".join(rng.choice("abcé 漢😀"[: rng.choice([2, 5, 7])]) for _ in range(rng.choice([0, 1, 4, 5, 30, 60, 200, 1200]))) for _ in range(900)]
    b = ["".join(c if rng.random() > share else rng.choice(["", "x", "yz"]) for c in t) for t in a for share in [rng.choice([0, 0.05, 0.15, 0.5])]]
    alone = [lines._alike(x, y) for x, y in zip(a, b)]
    assert lines.alike_pairs(a, b).tolist() == lines.alike_pairs(b, a).tolist() == alone and 200 < sum(alone) < 800


def test_a_crowd_is_compared_together(monkeypatch):
    """Of a crowd of unlike lines few are compared one by one, and none that meet elsewhere."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(150)]
    text = [t for t in base for t in (t, t[:60] + "x" + t[60:])]
    pdf = pd.DataFrame({"key": 5, "number": range(300), "bits": 0, "text": text})
    calls = []

    def counted(a, b):
        calls.append(len(a))
        return lines.alike_pairs(a, b)

    near = lambda x, y: np.ones(len(x), bool)
    got = lines._forest(pdf, near, counted)
    assert sorted(zip(got.a, got.b)) == [(n, n + 1) for n in range(0, 300, 2)] and len(calls) < 30
    full, calls[:] = sum(calls), []
    got = lines._forest(pdf.assign(keys=[[5, 3]] * 200 + [[5]] * 100), near, counted)
    assert sorted(zip(got.a, got.b)) == [(0, 1)] + [(n, n + 1) for n in range(200, 300, 2)] and sum(calls) < full


def test_hashes_of_neighbours_are_of_their_bytes_alone(monkeypatch):
    text = lines.normal(pa.array(["a b c", "b c", "word", "c", "é ü " * 20, "b c d"]))[1]
    data, at = lines._bytes(text)
    hashes, of = lines._neighbours(data, at[:-1], np.diff(at))
    rows = [hashes[x:y].tolist() for x, y in zip(of, of[1:])]
    assert rows[0][1] == rows[1][0] == rows[5][0] and [len(r) for r in rows] == [2, 1, 1, 1, 39, 2]
    assert len({h for r in rows for h in r}) == 7
    words, form = lines.normal(text)
    whole = [x.to_pylist() for x in lines._signed(words, form)]
    monkeypatch.setattr(lines, "PIECE", 8)
    assert [x.to_pylist() for x in lines._signed(words, form)] == whole
