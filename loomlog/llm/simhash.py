"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A fingerprint of 64 bits is cut into four blocks of 16.  Of two fingerprints that
differ in at most three bits, either some block carries all the differences, or
some block carries none; in both cases there is a block that agrees while the other
48 bits differ in at most three.  Two words of 23 bits lie in those 48, so one of
them differs in at most one bit.  The perfect Golay code [23, 12, 7] puts every
word within three bits of exactly one codeword.  A word is *indexed* under the
codeword that it decodes to and *probed* under those that it or a neighbour at one
bit decodes to (one, or six where its own codeword is three bits away): words one
bit apart always meet.  A key is the agreeing block and the codeword's 12 message
bits, so that 48 probes at most and 8 index rows stand for a fingerprint.  Every
meeting is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .bpe import ranges, slices
from .graph import components
from .shared import mixed, tidy, unused, written

#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Differing bits up to which fingerprints link; the keys below rely on it.
RADIUS = 3
#: Index rows of one key beyond which its members are compared in blocks.
CROWD = 64
#: Members of a block.
BLOCK = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of ``text``: A-Z lower-cased, words parted by ASCII white space,
    shingles of so many words (the whole sequence if it is shorter), XXH64 with
    seed 42; a bit is set if it is set in over half the hashes.  No words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: list[bytes] = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        digests = b"".join([digest(x, 42) for x in shingles[at : at + (1 << 14)]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(tidy(run), "id long, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern (three bits at most), and the six patterns of
    four bits at most that lead to a codeword (the first repeats where there is one)."""
    syndrome_of_bit = []
    for i in range(23):
        rest = 1 << i
        for j in range(22, 10, -1):
            if rest >> j & 1:
                rest ^= GOLAY << (j - 11)
        syndrome_of_bit.append(rest)
    nearest = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                pattern = 1 << i | 1 << j | 1 << k
                s = 0
                for x in {i, j, k}:
                    s ^= syndrome_of_bit[x]
                nearest[s] = pattern
    ways = np.repeat(nearest[:, None], 6, axis=1)
    for s in range(2048):
        others = {int(nearest[s])} | {int(nearest[s ^ syndrome_of_bit[i]]) ^ (1 << i) for i in range(23)}
        ways[s] = (sorted(others, key=lambda e: (e != nearest[s], e)) * 6)[:6] if len(others) > 1 else nearest[s]
    return nearest, ways


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    def of(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for j in range(22, 10, -1):
            v ^= np.where(v >> j & 1, GOLAY << (j - 11), 0)
        return v

    return of(np.arange(1 << 12)), of(np.arange(1 << 11) << 12)


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


def codewords(words: np.ndarray) -> np.ndarray:
    """The message index of each 23-bit word's codeword in the first column, those
    of its neighbours' codewords in the five others."""
    _, ways = golay_tables()
    return (words[:, None] ^ ways[syndrome(words)]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: index keys (n x 8) and probe keys (n x 48, repeats
    where a word has one codeword only)."""
    index, probe = [], []
    for block in range(4):
        at = np.uint64(16 * block)
        agreed = (fp >> at & np.uint64(0xFFFF)).astype(np.int64)
        low = fp & np.uint64((1 << 16 * block) - 1)
        high = fp >> at >> np.uint64(16)
        rest = (low | high << at).astype(np.int64)
        for half in range(2):
            found = codewords(rest >> 23 * half & 0x7FFFFF)
            key = (block * 2 + half << 28) + (agreed << 12)[:, None] + found
            index.append(key[:, :1])
            probe.append(key)
    return np.hstack(index), np.hstack(probe)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(signed), 4096):
            part = signed[start : start + 4096]
            index, probe = keys(part.view(np.uint64))
            probe = probe.reshape(len(part), 8, 6)
            fresh = np.ones(probe.shape, bool)
            fresh[:, :, 1:] = probe[:, :, 1:] != probe[:, :, :1]
            key = np.concatenate([index.ravel(), probe[fresh]])
            fp = np.concatenate([np.repeat(part, 8), np.repeat(part, fresh.sum(axis=(1, 2)))])
            role = np.arange(len(key)) < index.size
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(role)], ["key", "fp", "indexed"])


def _forest(pdf):
    """A spanning forest of the links among the fingerprints of one pair of blocks."""
    import pandas as pd

    fp = pdf["fp"].drop_duplicates().to_numpy()
    u = fp.view(np.uint64)
    near = np.zeros((len(u), len(u)), bool)
    for i in range(0, len(u), 256):
        near[i : i + 256] = np.bitwise_count(u[i : i + 256, None] ^ u[None, :]) <= RADIUS
    left, a, b = np.ones(len(u), bool), [], []
    for root in range(len(u)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            a.extend([fp[at]] * len(new))
            b.extend(fp[new])
            todo.extend(new)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints of column ``fp`` that
    differ in three bits at most.

    A key of up to ``CROWD`` index rows gives all its links.  The members of a more
    crowded one are dealt into blocks of about ``BLOCK``; each pair of blocks is
    compared in one task, which returns a spanning forest of its links: no link is
    lost to the components, and neither a task nor the result holds all pairs.
    """
    rows = written(distinct_fps.mapInArrow(tidy(_key_rows), "key long, fp long, indexed boolean"))
    index = rows.where("indexed").select("key", F.col("fp").alias("b"))
    probe = rows.where("not indexed").select("key", F.col("fp").alias("a"))
    crowds = written(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))
    crowded = None
    if not crowds.isEmpty():
        members = written(probe.join(crowds, "key").select("key", F.col("a").alias("fp")))
        sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        crowded = (
            members.join(sizes, "key")
            .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
            .groupBy("key", "i", "j")
            .applyInPandas(_forest, "a long, b long")
        )
        index = index.join(crowds.select("key"), "key", "left_anti")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    calm = probe.join(index, "key").where(near).select("a", "b")
    return calm.union(crowded) if crowded is not None else calm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    that a document reaches over links of three differing bits or fewer.

    Null and empty texts, and those of white space, have fingerprint zero and link
    like any other.  Repeated rows stay, each with its component.  A null id is kept;
    its component is the smallest id that isn't null (null if there is none).  Other
    columns are not read.  An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, words))
    firsts = written(fps.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(links(firsts.select("fp")), "a", "b")
    groups = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = written(groups.join(smallest, "component").select("fp", "component_id"))
    return fps.join(of_fp, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate group, all
    their columns unchanged; of rows that share this id, the one with the smallest hash
    of its text.  Rows that repeat both id and text are one document and stay once, and
    rows with a null id stay only where a group has no other."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = written(
        rows.mapInArrow(tidy(lambda batches: _fingerprinted(batches, words)), f"id {rows.schema['id'].dataType.simpleString()}, th binary, fp long")
    )
    linked = components(links(fps.select("fp").distinct()), "a", "b").withColumnRenamed("node", "fp")
    grouped = fps.join(linked, "fp", "left").select("id", "th", F.coalesce("component", "fp").alias("component"))
    return keep_first(docs, grouped, id_col, text_col)


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), text_hashes(batch.column(1)), pa.array(fp.view(np.int64))], ["id", "th", "fp"])


def text_hashes(texts: pa.Array) -> pa.Array:
    """128 bits of each text; of none, no bytes."""
    coded = (t.as_buffer() for t in texts)
    return pa.array([b"" if t is None else xxhash.xxh3_128_digest(t) for t in coded], pa.binary())


@F.arrow_udf(BinaryType())
def _text_hash(text: pa.Array) -> pa.Array:
    return text_hashes(text)


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` the first row, by id, then hash of text, of each ``component`` of
    ``grouped`` (``id, th, component``); null ids come last."""
    kept = (
        grouped.groupBy("component")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
        .select(F.col("first.id").alias("__id"), F.col("first.th").alias("__kept"))
        .distinct()
    )
    th = unused(docs, "__th")
    hashed = docs.withColumn(th, _text_hash(F.col(text_col)))
    same = hashed[id_col].eqNullSafe(kept["__id"]) & (hashed[th] == kept["__kept"])
    return hashed.join(kept, same, "left_semi").dropDuplicates([id_col, th]).drop(th)


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The distinct shingles of so many words (the whole sequence if it is shorter)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) >= words else {b" ".join(w)}


def shingle_hashes(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle (with repeats) of the texts, and where each text's begin and
    the last's end.  Each distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat = lists.flatten().dictionary_encode()
    digests = b"".join(xxhash.xxh64_digest(w.as_buffer()) for w in flat.dictionary)
    word = np.frombuffer(digests, ">u8").astype(np.uint64)[flat.indices.to_numpy()]
    at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    size = np.diff(at)
    start, ends = ranges(at[:-1], np.maximum(size - words + 1, 1))
    end = np.repeat(at[1:], np.diff(ends))
    hashes = np.zeros(len(start), np.uint64)
    for n in range(words):
        there = start + n < end
        hashes = np.where(there, mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(start + n, len(word) - 1)]), hashes)
    return hashes, ends


def similar(a: str, b: str) -> bool:
    """Whether the Jaccard similarity of five-word shingles is 0.8 or more."""
    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    return np.fromiter(map(similar, a, b), bool, len(a))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``keep_one``, of groups linked by fingerprints or by a Jaccard similarity of five-word shingles of
    0.8 or more, which three bits mostly don't reach.  For the latter texts meet under 16 MinHash bands of
    four; by calculation 0.02 % of pairs at 0.8 don't.  Texts without a word are alike."""
    from .lines import bands, met_links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, at = shingle_hashes(part.column(1))
                found = bands(np.append(hashes, np.uint64(0)), at[:-1], at[1:], 16, 4)
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                order = np.lexsort((hashes, row))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (np.diff(hashes[order]) != 0) | (np.diff(row[order]) != 0)
                sizes = np.bincount(row[order][fresh], minlength=part.num_rows)
                fp = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows)
                columns = [part.column(0), text_hashes(part.column(1)), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(fp.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "bits", "bands", "fp"])

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, th binary, bits long, bands binary, fp long"))
    distinct = written(
        found.groupBy("th")
        .agg(F.min("bits").alias("bits"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
        .withColumn("number", F.monotonically_increasing_id())
    )

    def texts(numbers: DataFrame) -> DataFrame:
        wanted = distinct.join(numbers, "number").select("number", "th")
        own = rows.select(_text_hash("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
        return own.join(wanted, "th").select("number", "text").dropDuplicates(["number"])

    firsts = written(distinct.groupBy("fp").agg(F.min("number").alias("number")))
    equal = distinct.select("fp", F.col("number").alias("b")).join(firsts.withColumnRenamed("number", "a"), "fp").select("a", "b")
    near = links(firsts.select("fp")).toDF("left", "right").join(firsts.toDF("left", "a"), "left").join(firsts.toDF("right", "b"), "right").select("a", "b")
    met = met_links(distinct, None, 16, texts, close, similar_pairs)
    linked = components(met.union(equal.where("a != b")).union(near), "a", "b").withColumnRenamed("node", "number")
    of = distinct.select("th", "number").join(linked, "number", "left").select("th", F.coalesce("component", "number").alias("component"))
    return keep_first(docs, found.select("id", "th").join(of, "th"), id_col, text_col)
