"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals' parts are fitted on a bounded
sample; every row is indexed.  The sample also tells how far a query must go: the share
of the rows, in the lists nearest to it, that holds nearly all of the sample's true
neighbours.  A query visits the lists nearest to it up to that share, scores their codes from
tables of its inner products with the codewords, and reranks the best of each part of
the index by the exact measure.

Neither the codes nor the share decide alone.  Each row keeps how far its code lies from
it and each list how far its rows reach: by Cauchy-Schwarz they bound the inner products.
Rows whose bound isn't below the worst one kept are reranked too, and lists whose bound
isn't are visited in a second round.  So clustered vectors take few lists, and vectors
without structure, among which no list is near, take many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, written
from .vectors import QUERIES, batches_of, binary, first_of_equal, lists, matrix, ranked, usable

#: Rows that centroids and codebooks are fitted on, about, the first by a hash of the id.
SAMPLE = 32_768
#: Centroids at most (else the square root of the rows), codewords of a part, and components of a part.
CENTROIDS, CODEWORDS, PART = 2_048, 256, 2
#: Of the sample: queries, and the share of their neighbours that the visited lists should hold.
ASKED, HELD = 256, 0.96
#: Candidates that each part of the index reranks for a query before bounds tell which others may count.
RERANKED = 60
#: Of the product of two lengths: what rounding may add to an inner product.
ROUNDING = 1e-9
#: Rows of a part of the index, about.
ROWS = 8_192


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from the first ``k`` rows (fewer where there are fewer)."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            sums = np.bincount(near, x[:, j], len(c))
            c[:, j] = np.where(n > 0, sums / np.maximum(n, 1), c[:, j])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


class Quantiser:
    def __init__(self, sample: np.ndarray, rows: int):
        k = max(1, min(CENTROIDS, int(np.sqrt(rows)), len(sample)))
        self.centroids = kmeans(sample, k)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = list(range(0, sample.shape[1], PART))
        self.books = [kmeans(rest[:, a : a + PART], CODEWORDS) for a in self.cuts]

    def share(self, sample: np.ndarray, k: int) -> float:
        """The share of all rows, by nearness of their lists, before the lists that hold
        ``HELD`` of the ``k`` neighbours of some of the sample."""
        q, near = sample[:ASKED], nearest(sample, self.centroids)
        size = np.bincount(near, minlength=len(self.centroids)) / len(sample)
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        before = np.empty(order.shape)
        np.put_along_axis(before, order, np.cumsum(size[order], axis=1) - size[order], axis=1)
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        true = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        found = np.take_along_axis(before, near[true], axis=1)
        return float(np.quantile(found, HELD)) if found.size else 1.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list and code of each row, its distance from the centroid, and from what the code stands for."""
        near = nearest(x, self.centroids)
        rest = x - self.centroids[near]
        codes = [nearest(rest[:, a : a + PART], b) for a, b in zip(self.cuts, self.books)]
        left = rest - np.hstack([b[c] for b, c in zip(self.books, codes)])
        return near, np.stack(codes, axis=1).astype(np.uint8), np.linalg.norm(rest, axis=1), np.linalg.norm(left, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's parts with the codewords (short books padded)."""
        out = np.zeros((len(self.books), CODEWORDS))
        for m, (a, b) in enumerate(zip(self.cuts, self.books)):
            out[m, : len(b)] = b @ q[a : a + PART]
        return out


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every``, the ``k`` rows with the largest inner products (all, if there are fewer),
    not the row itself; ties to the smaller id.  Bounds leave out none of them.

    Null ids, and vectors that are null, empty, zero, of another length than most or
    with null or non-finite components take no part.  Rows that repeat an id count
    once.  Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = written(usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0)))
    total = rows.count()
    if not total:
        return ranked(spark.createDataFrame([], schema), k)
    place = F.xxhash64("id", F.lit(7))
    picked = rows.where(F.pmod(place, F.lit(1 << 30)) < SAMPLE / total * (1 << 30)).select("v", place.alias("place")).toArrow()
    if not picked.num_rows:
        picked = rows.orderBy(place, "id").limit(1).select("v", place.alias("place")).toArrow()
    # The first of the sample begin the centroids and tell the share: not those that lie together in a file.
    sample = lists(picked.sort_by("place").column(0).combine_chunks())
    quantiser = Quantiser(sample, total)
    share = quantiser.share(sample, k)
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x = lists(batch.column(1))
            near, codes, far, off = shared.value.encode(x)
            columns = [batch.column(0), binary(x, "<f8"), binary(codes, "u1"), pa.array(near.astype(np.int32)), pa.array(far), pa.array(off)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "code", "list", "far", "off"])

    index = written(
        first_of_equal(rows, k + 1).mapInArrow(tidy(encode), "id long, v binary, code binary, list int, far double, off double")
    )
    held = {r.list: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    counts = np.array([held[i].n if i in held else 0 for i in range(len(quantiser.centroids))])
    reach = np.array([held[i].far if i in held else 0.0 for i in range(len(quantiser.centroids))])
    reach += ROUNDING * (np.linalg.norm(quantiser.centroids, axis=1) + reach)
    splits = np.maximum(1, -(-counts // ROWS))
    parts = int(max(1, -(-counts.sum() // ROWS)))
    # A list is dealt by itself, and a long one in pieces, to one of the parts.
    first = np.cumsum(splits) - splits
    layout = spark.sparkContext.broadcast((counts, splits, first, parts))

    def part_of(piece: np.ndarray) -> np.ndarray:
        return piece % layout.value[3]

    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERIES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, splits, first, _ = layout.value
        for batch in batches:
            near = batch.column(3).to_numpy()
            piece = first[near] + batch.column(0).to_numpy() % splits[near]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part_of(piece).astype(np.int32))], ["id", "v", "code", "list", "far", "off", "part"]
            )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists that each query visits in each part of the index.  In the second round (with
        the worst score kept and the lists seen) those left whose bound isn't below that score."""
        counts, splits, first, _ = layout.value
        want = share * counts.sum()
        for batch in batches_of(batches, 1024):
            q = lists(batch.column(1))
            scores = q @ shared.value.centroids.T
            if batch.num_columns == 2:
                least = np.full(len(q), -np.inf)
                order = np.argsort(-scores, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                visited = [order[i][before[i] <= want] for i in range(len(q))]
            else:
                least = batch.column(2).to_numpy()
                hopeful = ~(scores + np.linalg.norm(q, axis=1)[:, None] * reach < least[:, None])
                for i, seen in enumerate(batch.column(3)):
                    hopeful[i, seen.values.to_numpy()] = False
                visited = [np.flatnonzero(h & (counts > 0)) for h in hopeful]
            which, part, chosen = [], [], []
            for i, near in enumerate(visited):
                if not len(near):
                    continue
                pieces = np.repeat(first[near], splits[near]) + np.concatenate([np.arange(s) for s in splits[near]])
                at = part_of(pieces)
                of = np.repeat(near, splits[near])
                for p in np.unique(at):
                    which.append(i)
                    part.append(p)
                    chosen.append(np.unique(of[at == p]).astype(np.int32))
            row = pa.array(which, pa.int64())
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(chosen, pa.list_(pa.int32())), pa.array(part, pa.int32()), pa.array(least[which])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "lists", "part", "least"])

    def score(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(entries):
            entries = entries.sort_values("id")
            ids, near = entries["id"].to_numpy(), entries["list"].to_numpy()
            v, codes = matrix(entries["v"], "<f8"), matrix(entries["code"], "u1")
            cells = codes.astype(np.int64) + np.arange(codes.shape[1]) * CODEWORDS
            here = [np.flatnonzero(near == n) for n in range(int(near.max()) + 1)]
            none = np.zeros(0, np.int64)
            off = entries["off"].to_numpy()
            off = off + ROUNDING * (np.linalg.norm(shared.value.centroids[near], axis=1) + entries["far"].to_numpy())
            asked = zip(queries["id"], np.array(queries["v"].tolist()), queries["lists"], queries["least"])
            for qid, q, chosen, least in asked:
                at = np.sort(np.concatenate([none, *(here[n] for n in chosen if n < len(here))]))
                at = at[ids[at] != qid]
                near_score = shared.value.centroids @ q
                rough = shared.value.tables(q).ravel().take(cells[at]).sum(axis=1) + near_score[near[at]]
                order = np.argsort(-rough, kind="stable")
                exact = (v[at[order[:RERANKED]]] * q).sum(axis=1)
                if len(exact) >= k:
                    least = max(least, np.partition(exact, -k)[-k])
                rest = order[RERANKED:]
                rest = rest[~(rough[rest] + np.linalg.norm(q) * off[at[rest]] < least)]
                at = at[np.concatenate([order[:RERANKED], rest])]
                exact = np.concatenate([exact, (v[at[RERANKED:]] * q).sum(axis=1)])
                top = np.lexsort((ids[at], -exact))[:k]
                found.append((np.full(len(top), qid), ids[at][top], exact[top]))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    entries = index.mapInArrow(tidy(dealt), "id long, v binary, code binary, list int, far double, off double, part int").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def visited(asking: DataFrame) -> DataFrame:
        return written(asking.mapInArrow(tidy(visits), "id long, v array<double>, lists array<int>, part int, least double").select("*", block))

    def scored(asked: DataFrame) -> DataFrame:
        found = asked.groupBy("part", "block").cogroup(entries.groupBy("part", "block")).applyInPandas(score, schema)
        return written(ranked(found, k))

    asked = visited(queries)
    near = scored(asked)
    # Where fewer than k are found, every list left is visited.
    kept = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    seen = asked.groupBy("id").agg(F.flatten(F.collect_list("lists")).alias("seen"))
    again = queries.join(seen, "id").join(kept.withColumnRenamed("query_id", "id"), "id", "left")
    further = visited(again.select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "seen"))
    if further.isEmpty():
        return near
    return ranked(near.drop("rank").union(scored(further).drop("rank")), k)
