"""Ranked lexical search, best first over intervals of documents.

The index has blocks of whole documents, ordered by id within a block: the block's terms, and
for each the documents that hold it with their counts.  For a set of queries the impacts of
their terms' postings are computed, and over each posting list a sparse table that tells the
maximum of any range in two looks.

A query starts with the interval of all documents of a block.  The sum of its terms' maxima bounds
every score within; the interval with the highest bound is taken from a heap, split at the
document of the largest single impact, which is scored, and its two remainders go back with
bounds of their own.  Once the highest bound can't reach the k-th best document, the block is done.
What holds few postings is scored as a whole.  A task goes on with the best documents of the
blocks before, and of all tasks' best the best are kept.

Scores are whole numbers, so ranks are exact: see ``search``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import buffers, ranges, slices
from .shared import table_rows, tidy, written

#: Bytes of text and documents of a block at most (a longer text is a block of its own).
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: Postings of an interval that is scored as a whole.
LEAF = 2048
#: Queries, and bytes of their texts, that go to the tasks together.
QUERIES, QUERY_BYTES = 4096, 8 << 20
#: Bytes of terms; capitals are made small.
IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

HITS = "query long, doc_id long, score long"
INDEX = "docs long, terms long, doc_ids binary, valid binary, lengths binary, spelled binary, spelled_ends binary, ends binary, holders binary, times binary"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms, the number of each term in order, and the text of each.  Null has none."""
    data, at = buffers(pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary()))
    inside = IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = at[:-1][np.diff(at) > 0]
    begins[starts] = inside[starts]
    first = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[first] - 1, np.count_nonzero(inside))
    kept = SMALL[data[inside]]
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(at, first, "right") - 1


def _smallest(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes; ``_numbers`` reads them by their count."""
    most = int(x.max()) if len(x) else 0
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _numbers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}" if count else "<u1").astype(np.int64)


def _block(ids: pa.Array, texts: pa.Array) -> tuple:
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    terms, term, doc = terms_of(texts)
    lengths = np.bincount(doc, minlength=len(ids))
    pairs, times = np.unique(term * len(ids) + doc, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(1, len(terms) + 1) * len(ids))
    spelled, spelled_at = buffers(terms)
    return (
        int((lengths > 0).sum()),
        len(term),
        ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
        ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
        lengths.astype("<u4").tobytes(),
        spelled.tobytes(),
        spelled_at[1:].astype("<u4").tobytes(),
        ends.astype("<u4").tobytes(),
        _smallest(pairs % max(len(ids), 1)),
        _smallest(times),
    )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows' whole texts, written to the shared folder: a row a block.  Null texts
    have no terms; null ids come after all others; repeated rows are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            for part in slices(batch):
                more = part.column(1).nbytes
                if held and (size + more > BLOCK_BYTES or rows + part.num_rows > BLOCK_DOCS):
                    yield from _blocks(held)
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + more, rows + part.num_rows
        yield from _blocks(held)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(tidy(run), INDEX))


def _blocks(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts:
        whole = pa.Table.from_batches(parts).combine_chunks()
        yield from table_rows(INDEX, [_block(whole.column(0).combine_chunks(), whole.column(1).combine_chunks())])


def _dictionary(row: dict[str, Any]) -> pa.Array:
    ends = np.frombuffer(row["spelled_ends"], "<u4").astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(row["spelled"])])


class _Postings:
    """The postings of some terms of a block end to end, their impacts, and the sparse tables."""

    def __init__(self, row: dict[str, Any], terms: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        code = pc.index_in(terms, _dictionary(row))
        found = code.is_valid().to_numpy(zero_copy_only=False) & (weights > 0)
        code = code.fill_null(0).to_numpy().astype(np.int64)
        ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        starts = np.append(0, ends)[:-1]
        count = int(ends[-1]) if len(ends) else 0
        self.doc_ids, self.valid = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["valid"], bool)
        self.docs = len(self.doc_ids)
        if not found.any():
            self.at = np.zeros(len(terms) + 1, np.int64)
            return
        size = np.where(found, (ends - starts)[code], 0)
        places, self.at = ranges(np.where(found, starts[code], 0), size)
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        m = 50 + 50 * lengths * n_docs // max(n_terms, 1)
        self.doc = _numbers(row["holders"], count)[places]
        times = _numbers(row["times"], count)[places]
        self.impact = np.repeat(weights, size) * (1_000_000_000 * times // (1000 * times + 20 * m[self.doc]))
        self.key = np.repeat(np.arange(len(terms)), size) * self.docs + self.doc
        # levels[j][i]: where the largest of the 2^j impacts from i on is.
        self.levels = [np.arange(len(self.impact), dtype=np.int32)]
        for j in range(1, int(size.max()).bit_length()):
            below, half = self.levels[-1], 1 << (j - 1)
            a, b = below[:-half], below[half:]
            self.levels.append(np.concatenate([np.where(self.impact[a] >= self.impact[b], a, b), below[-half:]]))
        self.levels = np.stack(self.levels)

    def bound(self, low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
        """The sum of the maxima of the ranges, none of them empty, and the document of the
        largest."""
        level = LOG2[high - low]
        a, b = self.levels[level, low], self.levels[level, high - (1 << level)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        impact = self.impact[best]
        return int(impact.sum()), int(self.doc[best[impact.argmax()]])

    def best(self, terms: np.ndarray, kept: list[tuple], k: int) -> None:
        """Take the block's documents among the k best for a query into the heap ``kept`` of
        ``(score, has an id, -id)``."""
        low, high = self.at[terms], self.at[terms + 1]
        some = high > low
        terms, low, high = terms[some], low[some], high[some]
        if not len(terms):
            return
        sum_, doc = self.bound(low, high)
        heap = [(-sum_, 0, doc, terms, low, high)]
        while heap:
            negative, start, doc, terms, low, high = heapq.heappop(heap)
            if len(kept) == k and (-negative, *self._rank(start)) <= kept[0]:
                break
            if int((high - low).sum()) <= LEAF:
                places, _ = ranges(low, high - low)
                held, of = np.unique(self.doc[places], return_inverse=True)
                scores = np.zeros(len(held), np.int64)
                np.add.at(scores, of, self.impact[places])
                self._take(held, scores, kept, k)
                continue
            at = np.searchsorted(self.key, terms * self.docs + doc)
            holds = at < high
            holds[holds] = self.doc[at[holds]] == doc
            self._take(np.array([doc]), np.array([self.impact[at[holds]].sum()]), kept, k)
            for first, a, b in ((start, low, at), (doc + 1, at + holds, high)):
                some = b > a
                if some.any():
                    of, a, b = terms[some], a[some], b[some]
                    sum_, split = self.bound(a, b)
                    if len(kept) < k or sum_ >= kept[0][0]:
                        heapq.heappush(heap, (-sum_, first, split, of, a, b))

    def _rank(self, doc: int) -> tuple[bool, int]:
        return bool(self.valid[doc]), -int(self.doc_ids[doc])

    def _take(self, docs: np.ndarray, scores: np.ndarray, kept: list[tuple], k: int) -> None:
        if len(kept) == k:
            may = scores >= kept[0][0]
            docs, scores = docs[may], scores[may]
        if len(docs) > k:  # of equal scores the earlier documents
            first = np.argsort(-scores, kind="stable")[:k]
            docs, scores = docs[first], scores[first]
        for d, s in zip(docs.tolist(), scores.tolist()):
            one = (s, *self._rank(d))
            if s > 0 and len(kept) < k:
                heapq.heappush(kept, one)
            elif s > 0 and one > kept[0]:
                heapq.heapreplace(kept, one)


LOG2 = np.array([0, *(n.bit_length() - 1 for n in range(1, BLOCK_DOCS + 2))])


def search(indexed: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query row with a score above 0: its ``id_col, rank`` (from 1), ``doc_id, score``.

    With N documents that have a term, L terms in all of them and df documents that hold a term,
    the term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document of n terms that holds it
    tf times scores ``weight * (10^9 tf div (1000 tf + 20 m))`` for it, m being ``50 + (50 n N div L)``.
    Equal scores are in the order of ``doc_id``, a null one last.  A query's terms count once
    each; a null or empty one has no results; repeated query rows have results each.

    Queries go to all blocks together, some thousands at a time, of bounded size; the index stays where it is."""
    totals = indexed.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    item, out = StructType([StructField("query", LongType()), StructField("item", queries.schema[id_col].dataType)]), None
    for number, some in _sets(queries.select(id_col, text_col).toLocalIterator()):
        found = _search_set(indexed, [text for _, text in some], number, totals.docs, totals.terms, k)
        items = indexed.sparkSession.createDataFrame([(number + n, i) for n, (i, _) in enumerate(some)], item)
        found = found.join(F.broadcast(items), "query")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = indexed.sparkSession.createDataFrame([], item).selectExpr("*", "0L AS doc_id", "0L AS score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _sets(rows: Iterator[Any]) -> Iterator[tuple[int, list[tuple]]]:
    """Queries in sets of bounded size, with the number of each set's first."""
    some, size, number = [], 0, 0
    for row in rows:
        if some and (len(some) == QUERIES or size > QUERY_BYTES):
            yield number, some
            number, some, size = number + len(some), [], 0
        some.append(tuple(row))
        size += len(row[1] or "")
    if some:
        yield number, some


def _search_set(indexed: DataFrame, queries: list[str | None], number: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    spark = indexed.sparkSession
    terms, term, query = terms_of(pa.array(queries, pa.string()))
    pairs = np.unique(query * max(len(terms), 1) + term)
    ends = np.searchsorted(pairs, np.arange(1, len(queries) + 1) * max(len(terms), 1))
    of_query = np.split(pairs % max(len(terms), 1), ends[:-1])
    asked = spark.sparkContext.broadcast(terms.to_pylist())

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sums = pa.array(asked.value, pa.large_binary()), np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                code = pc.index_in(wanted, _dictionary(row))
                size = np.diff(np.frombuffer(row["ends"], "<u4").astype(np.int64), prepend=0)
                held = code.is_valid().to_numpy(zero_copy_only=False)
                sums[held] += size[code.drop_null().to_numpy()]
        held = np.flatnonzero(sums)
        yield from table_rows("term long, df long", list(zip(held.tolist(), sums[held].tolist())))

    counted = indexed.select("spelled", "spelled_ends", "ends").mapInArrow(tidy(holders), "term long, df long")
    df = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term of the set
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))]
    plan = spark.sparkContext.broadcast((weights, of_query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, of_query = plan.value
        wanted, weights = pa.array(asked.value, pa.large_binary()), np.array(weights, np.int64)
        kept: list[list[tuple]] = [[] for _ in of_query]
        for batch in batches:
            for n in range(batch.num_rows):
                block = _Postings(batch.slice(n, 1).to_pylist()[0], wanted, weights, n_docs, n_terms)
                for best, terms in zip(kept, of_query):
                    block.best(terms, best, k)
        rows = [(number + q, -doc if valid else None, score) for q, best in enumerate(kept) for score, valid, doc in best]
        yield from table_rows(HITS, rows)

    return indexed.mapInArrow(tidy(run), HITS)


def rank_all(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``search`` of all documents by each row of ``queries``."""
    return search(index(docs), queries, k)


def rank_sql(k: int = 50) -> str:
    """The same in DuckDB's SQL, by scoring every document that holds a term."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({small}, '{term}') AS ts FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT DISTINCT q, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({small}, '{term}') AS ts FROM benchmark)),
post AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term, n_docs),
scored AS (
  SELECT a.q, a.item_id, p.row, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN post p ON p.term = a.term JOIN weight t ON t.term = a.term, total GROUP BY ALL
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
