"""Packing token pieces into sequences by minimum bin slack.

Only how many pieces there are of each length matters to a packing, so the plan is
made from that histogram (as many rows as a sequence has tokens, whatever the input):
the longest piece left opens a bin, and a subset-sum dynamic programme over a bitset
of the lengths left finds the fullest combination that fits beside it; the bin is
repeated while its lengths last and they are removed.  The plan then says which
sequence takes the r-th piece of a length, and Spark numbers the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import tidy, written

#: The id that ends a document.
END = 1
#: Pieces of one length are numbered in parts of about so many rows.
NUMBERED = 20_000
#: Ranks are below 2 ** RANK_BITS.
RANK_BITS = 44


def token_pieces(
    docs: DataFrame, tokenizer: str, most: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of at most ``most`` ids.

    A document is its text's ids and the id 1.  A null text is an empty one: one
    piece of length 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.described(tokenizer))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.model(shared.value)
        for batch in batches:
            for part in bpe.slices(batch):
                flat, at = model.encode_column(part.column(1))
                sizes = np.diff(at) + 1
                pieces = -(-sizes // most)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * most
                length = np.minimum(sizes[row] - start, most)
                first, last = at[:-1][row] + start, at[1:][row]
                to = np.minimum(first + length, last)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), to.tolist())]
                ends = (to - first < length).tolist()
                crc = [zlib.crc32(end, c) if e else c for c, e in zip(crc, ends)]
                ids = part.column(0).take(pa.array(row))
                columns = [ids, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination ``(length, times)`` of the available lengths with the largest
    sum up to ``room``; of equal sums, one of long pieces."""
    reached, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reached & full:
            part = min(part, left)
            steps.append((length, part, reached))
            reached |= reached << length * part & mask
            left -= part
            part *= 2
        if reached & full:
            break
    total = reached.bit_length() - 1
    used: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return sorted(used.items(), reverse=True)


@dataclass(frozen=True)
class Plan:
    """Sorted by ``key`` (length and first rank): from that rank on, so many pieces of
    the length a sequence, from which sequence on, and at which offset."""

    key: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << RANK_BITS) + rank, "right") - 1
        nth = rank - (self.key[at] & (1 << RANK_BITS) - 1)
        times = self.times[at]
        return self.sequence[at] + nth // times, self.offset[at] + nth % times * length


def plan(counts: dict[int, int], most: int) -> Plan:
    """Minimum bin slack over a histogram of lengths."""
    left = {x: n for x, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, sequences = [], 0
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        bin_ = dict(fullest(rest, most - longest))
        bin_[longest] = bin_.get(longest, 0) + 1
        again = min(left[x] // k for x, k in bin_.items())
        offset = 0
        for x, k in sorted(bin_.items(), reverse=True):
            rows.append(((x << RANK_BITS) + used[x], k, sequences, offset))
            offset += x * k
            used[x] += k * again
            left[x] -= k * again
            if not left[x]:
                del left[x]
        sequences += again
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequences)


def pack(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and others; lengths from 1 to ``most``)
    with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    The pieces of a length are numbered in parts dealt by a hash of the row, so that
    a length that very many pieces share isn't one task's.
    """
    spark = pieces.sparkSession
    pieces = written(pieces)
    # At most ``most`` rows, one a length.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(counts, most))
    parts = spark.createDataFrame([(x, -(-n // NUMBERED)) for x, n in counts.items()], "length long, __parts long")
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.col("__parts"))
    dealt = pieces.join(F.broadcast(parts), "length").select(*pieces.columns, part.alias("__part"))
    sizes = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")
    starts = sizes.select("length", "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece"))
    ranked = (
        dealt.withColumn("__nth", nth)
        .join(starts, ["length", "__part"])
        .select(*pieces.columns, (F.col("__before") + F.col("__nth") - 1).alias("__rank"))
    )
    kept = pieces.columns
    lengths_at = kept.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(lengths_at).to_numpy(zero_copy_only=False)
            sequence, offset = shared.value.place(length, batch.column(len(kept)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, most: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents as token pieces in as few sequences of at most ``most`` tokens as the
    method finds: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the closing id.  Longer documents alone are
    cut; repeated rows and null ids are packed like any other; other columns are not
    read; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, most, id_col, text_col), most)
