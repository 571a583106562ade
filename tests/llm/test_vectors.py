from fractions import Fraction
from math import floor

import numpy as np
import pytest

from loomlog.llm import ann, mtree, queries
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, score string, v int"


def vectors(n=900, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    bad = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [0.5] * (dim + 1)]
    rows += [(10_000 + 20 * i, v, "x", 0) for i, v in enumerate(bad)] + [(None, x[0].tolist(), "x", 0), (40, x[40].tolist(), "x", 0)]
    return rows, dict(enumerate(x))


def brute(x, k, every, score):
    out = []
    for q in x:
        if q % every == 0:
            near = sorted((-score(x[q], x[i]), i) for i in x if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def whole(a, b):
    return int(np.floor(64 * a.astype(float)) @ np.floor(64 * b.astype(float)))


@pytest.mark.parametrize("page,part,queries", [(512, 16_384, 4096), (16, 100, 10)])
def test_mtree_is_exact(spark, monkeypatch, page, part, queries):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "PART", part)
    monkeypatch.setattr(mtree, "QUERIES", queries)
    rows, x = vectors()
    got = mtree.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(x, 20, 20, whole)


def test_mtree_few_zero_large_and_empty(spark):
    rows = [(0, [0.0, 0.0]), (20, [1e30, 1.0]), (3, [1.0, -2.0]), (4, [1.0, -2.0])]
    got = mtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 3), (0, 4), (0, 20), (20, 0), (20, 3), (20, 4)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.search(empty).count() == 0 and ann.search(empty).count() == 0


LARGE = [
    {0: [1e30], 1: [-1.0], 2: [1.0]},
    {0: [1 / 64], 1: [2.0**56], 2: [2.0**55]},
    {0: [1e300, -1e300], 1: [1e300, 1e300], 2: [-1.0, 3.0], 3: [-1e308, -1e308], 20: [0.3, -0.2]},
    {0: [3e9, 1.015625, -7e8], **{i: [float(i * 1e8), 0.3 * i, -2e9 / i] for i in range(1, 60)}},
    {20 * i: [float((-1) ** i * 2.0**j) for j in range(i, i + 3)] for i in range(40)},
]


@pytest.mark.parametrize("x", LARGE)
def test_mtree_is_exact_for_large_and_negative_scores(spark, monkeypatch, x):
    monkeypatch.setattr(mtree, "PAGE", 4)
    monkeypatch.setattr(mtree, "PART", 16)

    def score(a, b):
        whole = sum(floor(64 * Fraction(v)) * floor(64 * Fraction(w)) for v, w in zip(a, b))
        return max(-(1 << 63), min((1 << 63) - 1, whole))

    got = mtree.search(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(x, 5, 20, score)


def test_mtree_equals_sql(spark):
    compare(spark, "/root/testdata/sf0.001", queries.op10_topk, queries.ORACLE_SQL["op10_topk"])


def test_clustered_vectors_take_few_lists(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 16)) * 4
    x = (centre[rng.integers(0, 60, 6_000)] + rng.normal(size=(6_000, 16))).astype(np.float32)
    sample = x[::2].astype(float)
    assert ann.Quantiser(sample, len(x)).share(sample, 20) < 0.2
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    want = brute(dict(enumerate(x)), 20, 20, dot)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def dot(a, b):
    return float((a.astype(float) * b.astype(float)).sum())


def test_ann_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 200)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rows, x = vectors()
    rows.append((777_780, [0.0] * 8, "x", 0))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = brute(x, 20, 20, dot)
    assert len(got) == len(want)
    assert all(abs(dot(x[q], x[i]) - s) < 1e-12 and i != q for q, _, i, s in got)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    of = {}
    for q, r, i, s in sorted(got):
        of.setdefault(q, []).append((-s, i))
        assert len(of[q]) == r
    assert all(v == sorted(v) for v in of.values())


def unlike_the_given(kind, n=3_000, dim=16):
    """Near copies about a common mean; queries unlike all other rows; clusters one after another, of all lengths."""
    rng = np.random.default_rng(8)
    if kind == "near copies":
        return (3 + rng.normal(size=(6, dim)))[rng.integers(0, 6, n)] + 1e-3 * rng.normal(size=(n, dim))
    if kind == "queries apart":
        x = 4 * rng.normal(size=(50, dim))[rng.integers(0, 50, n)] + 0.2 * rng.normal(size=(n, dim))
        x[::20] = rng.normal(size=(len(x[::20]), dim))
        return x
    return (rng.normal(size=(30, dim)) * np.exp(rng.normal(size=(30, 1))))[np.arange(n) * 30 // n] + rng.normal(size=(n, dim)) * np.exp(rng.normal(size=(n, 1)) - 2)


@pytest.mark.parametrize("kind", ["near copies", "queries apart", "in order"])
def test_ann_misses_none_on_other_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "ROWS", 1_000)
    x = dict(enumerate(unlike_the_given(kind).astype(np.float32)))
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<float>")).collect()
    want = brute(x, 20, 20, dot)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [w[:3] for w in want]


def test_ann_returns_all_of_few(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 4), (0, 2, 3), (0, 3, 2), (0, 4, 1)]
