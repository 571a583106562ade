import random
import zlib
from collections import defaultdict

import numpy as np

from loomlog.llm import sharding


def check(rows, got, shards):
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2])
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.size, r.text_crc32)) for r in got)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_balanced_and_groups_together(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 400) + str(rng.randrange(3000))) for i in range(3000)]
    rows += [(10_000 + i, "copied text of a small group") for i in range(20)]
    got = sharding.assign(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, size int"), 8).collect()
    check(rows, got, 8)
    load = np.zeros((8, 3))
    for r in got:
        load[r.shard] += (r.size, r.tokens, 1)
    assert (load[:, 0].max() / load[:, 0].mean()) < 1.002 and (load.max(axis=0) / load.mean(axis=0)).max() < 1.05
    assert len({r.shard for r in got if r.doc_id >= 10_000}) == 1


def test_hot_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 7)
    rows = [(i, "the same text") for i in range(500)] + [(1000 + i, f"other {i} " * 3) for i in range(1000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, got, 8)
    load = np.bincount([r.shard for r in got], [r.size for r in got])
    assert load.max() / load.mean() < 1.01


def test_group_that_fits_a_shard_stays_whole(spark):
    rows = [(i, "the same text, again and again") for i in range(180)] + [(1000 + i, f"another text of much the same length {i}") for i in range(1820)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, got, 8)
    load = np.bincount([r.shard for r in got], [r.size for r in got])
    assert len({r.shard for r in got if r.doc_id < 1000}) == 1 and load.max() / load.mean() < 1.01


def test_hard_rows(spark, tmp_path):
    rows = [(1, None), (2, None), (3, ""), (None, "x"), (4, "y"), (4, "y"), (5, "ü" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.assign(df, 3).collect(), 3)
    assert sharding.assign(df.limit(0), 3).count() == 0
    one = df.dropDuplicates()
    sharding.write(one, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_placing_against_plain_loops(monkeypatch):
    """Largest share first, each to the first shard whose capacity left has the largest dot product with it."""
    monkeypatch.setattr(sharding, "even", lambda share, found, left: found)
    rng = np.random.default_rng(3)
    for shards, n in ((1, 5), (3, 40), (7, 200)):
        sizes = rng.integers(1, 50, (n, 3)).astype(float)
        share = [[x / (sum(row[k] for row in sizes) / shards) for k, x in enumerate(row)] for row in sizes]
        left, want = [[1.0] * 3 for _ in range(shards)], [0] * n
        for i in sorted(range(n), key=lambda i: (-max(share[i]), i)):
            dots = [sum(a * b for a, b in zip(room, share[i])) for room in left]
            at = max(range(shards), key=lambda s: (dots[s], -s))
            want[i] = at
            left[at] = [a - b for a, b in zip(left[at], share[i])]
        got = sharding.place(sizes, shards)
        totals = [np.array([sizes[np.asarray(f) == s].sum(axis=0) for s in range(shards)]) for f in (got, want)]
        assert np.mean(got == np.array(want)) > 0.95 and np.allclose(totals[0].sum(axis=0), totals[1].sum(axis=0))
        assert np.abs(totals[0] / totals[0].mean(axis=0) - 1).max() <= np.abs(totals[1] / totals[1].mean(axis=0) - 1).max() + 0.05
