"""Exact top-k by inner product over an M-tree.

The largest inner product is the smallest distance after each vector v gets one more
component, sqrt(M - |v|^2) with M the largest |v|^2, and each query a zero.  In that
metric space the tree has a root of regions and, below it, pages of vectors; a page has
a routing vector, a covering radius and its routing vector's distance to the region's
(its parent), and its vectors have their distances to the routing vector.

A query first searches the region nearest to it, best page first, which gives a radius
that its answers lie within.  It then visits the other regions that reach into this
radius, again best page first.  By the triangle inequality the stored distances rule out
pages and vectors before a distance to them is computed.  Only what provably lies
outside is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, written
from .vectors import QUERIES, batches_of, best, binary, first_of_equal, lists, matrix, ranked, usable

#: Vectors of a page and of a part of a region, about.
PAGE, PART = 512, 16_384
#: Integers up to which double precision holds every sum.
EXACT = float(1 << 53)
#: Scores that a long holds.  The lowest also says that no score is known yet.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Components beyond this power of two are scaled down, all alike, so that no square overflows.
LARGEST = 400
RESULT = "query_id long, vec_id long, score long"


def distances(x: np.ndarray, c: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    """Distances in the metric space, of vectors or queries x to vectors c."""
    own, other = (x * x).sum(axis=1), (c * c).sum(axis=1)
    inner = x @ c.T
    if query:
        return np.sqrt(np.maximum(own[:, None] + most - 2 * inner, 0))
    inner += np.sqrt(np.maximum(most - own, 0))[:, None] * np.sqrt(np.maximum(most - other, 0))
    return np.sqrt(np.maximum(2 * most - 2 * inner, 0))


def integers(x: np.ndarray, up: int) -> list[int]:
    """The components times two to the power ``up``, exactly."""
    mantissa, exponent = np.frexp(x)
    parts = zip((mantissa * EXACT).astype(np.int64).tolist(), (exponent + up - 53).tolist())
    return [m << e if e >= 0 else m >> -e for m, e in parts]


def scores(q: np.ndarray, v: np.ndarray, least: np.ndarray, up: int) -> np.ndarray:
    """Inner products times two to the power ``2 * up`` as 64-bit integers; of what doesn't fit,
    the nearest.  A product of doubles is exact where that of the absolute values shows that
    no sum can pass 2^53.  Elsewhere it tells, within what rounding can do, which pairs may
    reach ``least``, and those are computed in whole numbers; the others get the lowest score."""
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = np.ldexp(q, up), np.ldexp(v, up)
        inner, bound = x @ y.T, np.abs(x) @ np.abs(y).T
        exact = bound < EXACT
        out = np.where(exact, inner, 0).astype(np.int64)
        if not exact.all():
            may = ~exact & ~(inner + 1e-9 * bound < least[:, None].astype(float))
            out[~exact] = LOWEST
            rows, columns = np.nonzero(may)
            left = {i: integers(q[i], up) for i in np.unique(rows).tolist()}
            right = {j: integers(v[j], up) for j in np.unique(columns).tolist()}
            for i, j in zip(rows.tolist(), columns.tolist()):
                out[i, j] = max(LOWEST, min(HIGHEST, sum(a * b for a, b in zip(left[i], right[j]))))
    return out


def reach(own: np.ndarray, least: np.ndarray, most: float, up: int) -> np.ndarray:
    """The distance within which the vectors lie that have ``least`` as their score or more;
    any, where none is known."""
    with np.errstate(over="ignore"):
        within = np.sqrt(np.maximum(own + most - 2 * np.ldexp(least.astype(float), -2 * up), 0))
    return np.where(least == LOWEST, np.inf, within + 1e-6 * (np.sqrt(most) + np.sqrt(own)))


def pages_of(ids: np.ndarray, v: np.ndarray, pivot: np.ndarray, most: float) -> pd.DataFrame:
    """The pages of a part of a region: routing vectors are taken at even steps, each
    vector goes to the nearest, and what crowds about one is cut into pages."""
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    routing = v[:: max(1, PAGE // 2)] if len(v) > PAGE else v[:1]
    d = distances(v, routing, most)
    near = d.argmin(axis=1)
    rows = []
    for p in np.unique(near):
        member = np.flatnonzero(near == p)
        for at in range(0, len(member), PAGE):
            some = member[at : at + PAGE]
            to = d[some, p]
            rows.append((routing[p].tobytes(), float(to.max()), float(distances(routing[p : p + 1], pivot, most)[0, 0]), ids[some].tolist(), v[some].tobytes(), to.tolist()))
    return pd.DataFrame(rows, columns=["routing", "radius", "to_parent", "ids", "vectors", "to_routing"])


def best_first(
    ids: np.ndarray, q: np.ndarray, least: np.ndarray, pivot: np.ndarray, pages: pd.DataFrame, most: float, k: int, up: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of the pages for each query: query number, id, score.  ``least``
    is the score that a query's results must reach."""
    routing = matrix(pages["routing"], "<f8")
    cover, to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
    own = (q * q).sum(axis=1)
    within = reach(own, least, most, up)
    to_pivot = distances(q, pivot, most, query=True)[:, :1]
    ruled_out = np.abs(to_pivot - to_parent) - cover > within[:, None]
    bound = np.full(ruled_out.shape, np.inf)
    need = np.flatnonzero(~ruled_out.all(axis=0))
    to_routing = np.full(ruled_out.shape, np.inf)
    to_routing[:, need] = distances(q, routing[need], most, query=True)
    bound[:, need] = np.where(ruled_out[:, need], np.inf, to_routing[:, need] - cover[need])
    order = np.argsort(bound, axis=1, kind="stable")
    hit_q, hit_id, hit_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = least.copy()
    for step in range(order.shape[1]):
        page = order[:, step]
        alive = np.flatnonzero(bound[np.arange(len(q)), page] <= within)
        alive = alive[np.isfinite(bound[alive, page[alive]])]
        if not len(alive):
            break
        got = [(hit_q, hit_id, hit_s)]
        for p in np.unique(page[alive]):
            some = alive[page[alive] == p]
            row = pages.iloc[p]
            member, to = np.asarray(row["ids"]), np.asarray(row["to_routing"])
            v = np.frombuffer(row["vectors"], "<f8").reshape(len(member), -1)
            may = np.abs(to_routing[some, p][:, None] - to[None, :]) <= within[some][:, None]
            column = np.flatnonzero(may.any(axis=0))
            s = scores(q[some], v[column], least[some], up)
            a, b = np.nonzero((s >= least[some][:, None]) & (member[column][None, :] != ids[some][:, None]))
            got.append((some[a], member[column[b]], s[a, b]))
        hit_q, hit_id, hit_s = (np.concatenate(x) for x in zip(*got))
        top = best(hit_q, hit_id, hit_s, k)
        hit_q, hit_id, hit_s = hit_q[top], hit_id[top], hit_s[top]
        number, at, n = np.unique(hit_q, return_index=True, return_counts=True)
        full = n >= k
        least[number[full]] = np.maximum(least[number[full]], hit_s[at[full] + k - 1])
        within = reach(own, least, most, up)
    return hit_q, hit_id, hit_s


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every``, the ``k`` rows (all, if fewer) with the largest inner products of the
    vectors floor(scale * x), not the row itself; ties to the smaller id.  Exact.

    Null ids, and vectors that are null, empty, of another length than most or with
    null or non-finite components take no part; zero vectors do.  Rows that repeat an
    id count once.  A score that a long can't hold is the nearest that it can; among such the
    smaller id is first.  Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession

    up = int(np.log2(scale))
    if 2.0**up != scale:
        raise ValueError("scale must be a power of two")
    taken = usable(vectors, id_col, vec_col)
    largest = taken.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    down = max(0, int(np.frexp(largest or 0.0)[1]) - LARGEST)
    up += down

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x = lists(batch.column(1))
            # From 2^52 on a component has no fraction left.
            fine = np.abs(x) < EXACT / 2
            x = np.ldexp(np.where(fine, np.floor(scale * np.where(fine, x, 0)) / scale, x), -down)
            squared = pa.array((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(x, "<f8"), squared], ["id", "v", "squared"])

    rows = written(taken.mapInArrow(tidy(whole), "id long, v binary, squared double"))
    n, most = rows.agg(F.count("*"), F.max("squared")).first()
    if not n:
        return ranked(spark.createDataFrame([], RESULT), k)
    entries = first_of_equal(rows.select("id", "v"), k + 1)
    regions = int(np.ceil(np.sqrt(n / PAGE)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(regions).select("v").toArrow()
    pivots = spark.sparkContext.broadcast(matrix(picked.column(0), "<f8"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            d = distances(matrix(batch.column(1), "<f8"), pivots.value, most)
            near = d.argmin(axis=1)
            columns = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "region", "to_pivot"])

    routed = written(entries.mapInArrow(tidy(route), "id long, v binary, region int, to_pivot double"))
    # One row a region: the root of the tree, of the square root of the pages' number.
    root = routed.groupBy("region").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius")).orderBy("region").toPandas()
    root["parts"] = -(-root["n"] // PART)
    shared = spark.sparkContext.broadcast(root)
    sizes = spark.createDataFrame(root[["region", "parts"]].astype("int64"), "region long, parts long")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        region, part = int(key[0]), int(key[1])
        made = pages_of(pdf["id"].to_numpy(), matrix(pdf["v"], "<f8"), pivots.value[region : region + 1], most)
        return made.assign(region=region, part=part)

    page = "routing binary, radius double, to_parent double, ids array<long>, vectors binary, to_routing array<double>, region int, part int"
    tree = written(
        routed.join(F.broadcast(sizes), "region").select("region", part, "id", "v").groupBy("region", "part").applyInPandas(build, page)
    )
    queries = rows.where(F.col("id") % every == 0).select("id", "v")
    blocks = max(1, -(-queries.count() // QUERIES))

    def visits(home: bool):
        """Rows for the parts of regions to visit: the nearest one, or all others that
        reach into the query's radius."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            root = shared.value
            number, cover, parts = (root[c].to_numpy() for c in ("region", "radius", "parts"))
            for batch in batches_of(batches):
                q, ids = matrix(batch.column(1), "<f8"), batch.column(0).to_numpy()
                d = distances(q, pivots.value[number], most, query=True)
                nearest = d.argmin(axis=1)
                own = ids % parts[nearest]
                which, region, part = [], [], []
                if home:
                    which, region, part = np.arange(len(q)), number[nearest], own
                    least = np.full(len(q), LOWEST)
                else:
                    least = batch.column(2).to_numpy(zero_copy_only=False)
                    near = d - cover[None, :] <= reach((q * q).sum(axis=1), least, most, up)[:, None]
                    for p in range(int(parts.max())):
                        a, b = np.nonzero(near & (p < parts)[None, :])
                        other = (b != nearest[a]) | (p != own[a])
                        which += a[other].tolist()
                        region += number[b[other]].tolist()
                        part += [p] * int(other.sum())
                rows = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(least).take(rows), pa.array(region, pa.int32()), pa.array(part, pa.int32())],
                    ["id", "v", "least", "region", "part"],
                )

        return run

    def answer(key: tuple, asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(pages):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, region = asked["id"].to_numpy(), int(key[0])
        least = asked["least"].to_numpy()
        q, i, s = best_first(ids, matrix(asked["v"], "<f8"), least, pivots.value[region : region + 1], pages, most, k, up)
        return pd.DataFrame({"query_id": ids[q], "vec_id": i, "score": s})

    keys = ["region", "part", "block"]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    visit = "id long, v binary, least long, region int, part int"
    paged = tree.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(asked: DataFrame, home: bool) -> DataFrame:
        rows = asked.mapInArrow(tidy(visits(home)), visit).select("*", block)
        return rows.groupBy(*keys).cogroup(paged.groupBy(*keys)).applyInPandas(answer, RESULT)

    near = written(found(queries, home=True))
    bounds = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    least = F.when(F.col("n") >= k, F.col("s")).otherwise(LOWEST)
    bounded = queries.join(bounds, queries["id"] == bounds["query_id"], "left").select("id", "v", F.coalesce(least, F.lit(LOWEST)).alias("least"))
    return ranked(near.union(found(bounded, home=False)), k)


def search_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """The same over ``embeddings`` in DuckDB's SQL."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
