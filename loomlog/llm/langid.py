"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of
the bytes that followed (method C: a context seen n times with d different bytes
after it escapes with probability d / (n + d); what it escapes to excludes those d).
The statistics are frozen after learning, so the code length of a byte behind its
context is a constant, and that of a text is exact: the sum over its bytes, each behind
the bytes before it, across words and lines.  The language with the shortest code is
predicted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .bpe import Table, buffers, slices
from .shared import give_back, kept

#: Bytes of the longest context.
ORDER = 4
#: The labelled sample a language is learned from: so many rows at most, and of those
#: (in the order of a hash of the id) as many whole texts as fit in so many bytes, one at
#: least.  Many languages share TOTAL_BYTES.
SAMPLE_ROWS, SAMPLE_BYTES, TOTAL_BYTES = 2_000, 1_000_000, 200_000_000
#: Languages at most, which bounds what is broadcast.
LANGUAGES = 10_000
#: Code lengths that a worker keeps: those of the most frequent bytes behind contexts.
COSTS = 1_000_000
#: Held-out labelled rows, about, that tell how long a code is still that of a known language.
CALIBRATED = 2_000
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
#: Where a number has the length of its context.
LENGTH = 8 * (ORDER + 1)


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts behind its longest context, as numbers, and where each
    text's begin and the last's end.  A number has the length of the context above five
    bytes, the context and the byte."""
    data, at = buffers(texts.cast(pa.large_binary()))
    data = data.astype(np.int64)
    length = np.minimum(np.arange(len(data)) - np.repeat(at[:-1], np.diff(at)), ORDER)
    grams = data | length << LENGTH
    for back in range(1, ORDER + 1):
        grams[back:] |= np.where(length[back:] >= back, data[:-back] << 8 * back, 0)
    return grams, at


class ContextTree:
    """The counts of one language; ``bits`` of bytes behind their contexts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        found = []
        for k in range(ORDER + 1):
            some = gram >> LENGTH >= k
            suffix, of = np.unique(k << LENGTH | gram[some] & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            found.append((suffix, np.bincount(of, n[some], len(suffix)).astype(np.int64)))
        key, count = (np.concatenate(x) for x in zip(*found))
        self.counts = Table(key, count, 0)
        context, of = np.unique(key >> 8, return_inverse=True)
        self.contexts = Table(context, np.arange(len(context)))
        # Of a context: what follows it, how many different bytes, and how often these
        # follow the next shorter context, where they are excluded.
        k = key >> LENGTH
        shorter = np.where(k > 0, self.counts.get(k - 1 << LENGTH | key & (np.int64(1) << 8 * k) - 1), 0)
        self.seen, self.distinct, self.excluded = (np.bincount(of, x, len(context)) for x in (count, None, shorter))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        total, left = np.zeros(len(gram)), np.arange(len(gram))
        excluded = np.zeros((2, len(gram)))
        for k in range(ORDER, -1, -1):
            key = k << LENGTH | gram[left] & (1 << 8 * (k + 1)) - 1
            at = np.where(gram[left] >> LENGTH >= k, self.contexts.get(key >> 8), -1)
            some = left[at >= 0]
            key, at = key[at >= 0], at[at >= 0]
            n, d = self.seen[at] - excluded[0, some], self.distinct[at] - excluded[1, some]
            count = self.counts.get(key)
            weight = np.where(count > 0, count, d)
            total[some] += np.where(weight > 0, np.log2(np.maximum(n + d, 1) / np.maximum(weight, 1)), 0)
            excluded[:, some] = self.excluded[at], self.distinct[at]
            done = np.zeros(len(gram), bool)
            done[some[count > 0]] = True
            left = left[~done[left]]
        total[left] += np.log2(256 - excluded[1, left])
        return total


class Model:
    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.trees = []
        for lang in self.langs:
            own = counts[counts["lang"] == lang]
            self.trees.append(ContextTree(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64)))
        often = counts.groupby("gram")["n"].sum().sort_values(ascending=False, kind="stable")
        known = often.index.to_numpy(np.int64)[: COSTS // max(1, len(self.langs))]
        self.rows = Table(known, np.arange(len(known)))
        self.costs = [t.bits(known) for t in self.trees]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each whole text, by language; of a null text, zero."""
        grams, at = grams_of(pc.fill_null(texts, ""))
        out = np.zeros((len(texts), len(self.trees)))
        some = np.diff(at) > 0
        row = self.rows.get(grams)
        rare = np.flatnonzero(row < 0)
        distinct, of = np.unique(grams[rare], return_inverse=True)
        for k, tree in enumerate(self.trees):
            bits = self.costs[k][row] if len(self.costs[k]) else np.zeros(len(row))
            bits[rare] = tree.bits(distinct)[of]
            if len(bits):
                out[some, k] = np.add.reduceat(bits, at[:-1][some])
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """The language, its share of the probability that all languages give the text,
        and the bits of its code; ``und`` and 0 for a text without a letter."""
        letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths(texts)
        least = bits.min(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
        langs = [self.langs[b] if some else UNKNOWN for b, some in zip(bits.argmin(axis=1), letters)]
        return langs, np.where(letters, share, 0.0).tolist(), np.where(letters, least, 0.0).tolist()


def held_out(id_col: str) -> Column:
    """Rows whose crc32(id as text) mod 4 is 2; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, text, lang, place`` of the rows that have id, text and language."""
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .where("id is not null and text is not null and lang is not null")
        .withColumn("place", F.xxhash64("id"))
    )


def census(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[Row]:
    """``lang``, the number of ``rows`` to learn from that aren't too long, and of those
    ``held`` out.  What names over ``LANGUAGES`` languages raises ``ValueError``."""
    small = F.octet_length("text") <= SAMPLE_BYTES
    rows = labelled(docs, id_col, text_col, lang_col).groupBy("lang")
    found = rows.agg(F.count_if(small & ~held_out("id")).alias("rows"), F.count_if(held_out("id")).alias("held"), F.count("*").alias("n"))
    listed = found.limit(LANGUAGES + 1).collect()
    if len(listed) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    return listed


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", counted: list[Row] | None = None) -> pd.DataFrame:
    """``lang, gram, n``: how often each byte followed each of its longest contexts in
    the sample.  Rows that are held out, or lack id, text or language, take no part.
    The sample bounds the rows that reach a task, the result and the driver; a language
    that has only texts beyond its bytes is learned from one of them."""
    counted = census(docs, id_col, text_col, lang_col) if counted is None else counted
    sizes = docs.sparkSession.createDataFrame([(r.lang, r.rows) for r in counted if r.n > r.held], "lang string, rows long")
    most = min(SAMPLE_BYTES, TOTAL_BYTES // max(1, len(counted)))
    share = F.least(F.lit(1.0), F.lit(1.5 * SAMPLE_ROWS) / F.col("rows"))
    first = Window.partitionBy("lang").orderBy("place", "id", "text")
    # At most LANGUAGES rows: broadcast, so that few more rows than the sample are shuffled.
    sample = (
        labelled(docs, id_col, text_col, lang_col)
        .where(~held_out("id"))
        .withColumn("small", F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(sizes), "lang")
        .where((F.col("small") & (F.pmod("place", F.lit(1 << 20)) < share * (1 << 20))) | (F.col("rows") == 0))
        .withColumn("nth", F.row_number().over(first))
        .where((F.col("nth") <= SAMPLE_ROWS) & (F.col("small") | (F.col("nth") == 1)))
        .withColumn("bytes", F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("bytes") <= most) | (F.col("nth") == 1))
    )

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grams, _ = grams_of(pa.array(pdf["text"], pa.string()))
        gram, n = np.unique(grams, return_counts=True)
        return pd.DataFrame({"lang": key[0], "gram": gram, "n": n})

    return sample.select("lang", "text").groupBy("lang").applyInPandas(count, "lang string, gram long, n long").toPandas()


def predictor(docs: DataFrame, counts: pd.DataFrame):
    """An Arrow UDF from text to ``struct<lang string, score double, bits double>``."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, counts))

    @F.arrow_udf("lang string, score double, bits double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key, frame = shared.value
        model = kept(key, lambda: Model(frame))
        for texts in batches:
            parts = [model.predict(part.column(1)) for part in slices(pa.record_batch([texts, texts], ["text", "same"]), 1)]
            langs, scores, bits = (sum(x, []) for x in zip(*parts)) if parts else ([], [], [])
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            give_back()
            yield pa.StructArray.from_arrays(columns, ["lang", "score", "bits"])

    return predict


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, after learning from the
    labelled rows that are not held out.

    A null text and one without a letter (digits, white space, empty) is ``und`` with
    score 0, as are all where there is nothing to learn from.  Between languages of
    equal code length the first by name is taken.  Repeated rows and null ids stay (a null id is not held out
    and not learned from); other columns are not read.
    """
    model = predictor(docs, learn(docs, id_col, text_col, lang_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), model(F.col(text_col)).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a letter and is in a learned language; all columns
    unchanged, whatever their names.

    A text is in none of the languages if its shortest code has over one and a half times the
    bits a byte of nearly all (99.5 %) of a sample of held-out labelled rows; 64 bits are free, so that
    short texts stay.  Where there are no such rows every text with a letter stays."""
    counted = census(docs, id_col, text_col, lang_col)
    model = predictor(docs, learn(docs, id_col, text_col, lang_col, counted))
    share = CALIBRATED / max(1, sum(r.held for r in counted))
    asked = labelled(docs, id_col, text_col, lang_col).where(held_out("id") & (F.pmod("place", F.lit(1 << 20)) < share * (1 << 20)))
    rate = (F.col("found.bits") - 64) / F.octet_length("text")
    known = asked.withColumn("found", model("text")).where(F.col("found.lang") != UNKNOWN)
    usual = known.agg(F.percentile(rate, 0.995)).first()[0]
    found = model(F.col(text_col))
    letters = found["lang"] != UNKNOWN
    if usual is None or usual <= 0:
        return docs.where(letters)
    return docs.where(letters & ((found["bits"] - 64) / F.octet_length(text_col) <= 1.5 * usual))
