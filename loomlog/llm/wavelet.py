"""Token ids in wavelet-matrix files, which answer lookups as they are.

A shard holds a run of the corpus's ids: a bit-plane for each bit of an id, highest first,
each plane in the order that the planes above it leave (zeros before ones, stably).  Planes
are cut into blocks that are compressed one by one, beside the number of ones before each
block; so a lookup undoes a block a plane.  ``access`` follows one place down the planes,
``rank`` a range, ``select`` goes back up.

Documents are dealt to tasks by ranges of their ids; a task cuts its ids, in order, into
shards of a fixed number, whatever the length of its documents, and writes a file for each.
Reading, a document that several shards share is put together from the CRCs of its pieces.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import described, slices
from .library_bpe import model
from .shared import shared_folder, table_rows, tidy, written

MAGIC = b"LWM1"
#: Ids of a shard, and bits of a compressed block, as powers of two.
SHARD_BITS, BLOCK_BITS = 20, 16
BLOCK = 1 << BLOCK_BITS


class WaveletMatrix:
    """Ids below ``2 ** width``: ``planes[k]`` has the bytes of each block of plane ``k`` (compressed
    where that is shorter), ``ones[k]`` the ones before each block and after the last."""

    def __init__(self, n: int, planes: Sequence[Sequence[bytes]], ones: np.ndarray):
        self.n, self.planes, self.ones = n, planes, ones
        self.width = len(planes)
        self.zeros = n - ones[:, -1].astype(np.int64)
        self._undone: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def of(ids: np.ndarray, width: int) -> WaveletMatrix:
        press = zstandard.ZstdCompressor(level=1)
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ones = [], np.zeros((width, -(-len(ids) // BLOCK) + 1), np.uint32)
        for k in range(width):
            bit = (ids & ids.dtype.type(1 << (width - 1 - k))) != 0
            blocks = []
            for b in range(0, len(ids), BLOCK):
                raw = np.packbits(bit[b : b + BLOCK]).tobytes()
                small = press.compress(raw)
                blocks.append(small if len(small) < len(raw) else raw)
                ones[k, b // BLOCK + 1] = ones[k, b // BLOCK] + np.count_nonzero(bit[b : b + BLOCK])
            planes.append(blocks)
            ids = np.concatenate([ids.compress(~bit), ids.compress(bit)])
        return WaveletMatrix(len(ids), planes, ones)

    def _bits(self, k: int, b: int) -> np.ndarray:
        size = min(BLOCK, self.n - b * BLOCK)
        raw = self.planes[k][b]
        if len(raw) < -(-size // 8):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=BLOCK // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size)

    def _within(self, k: int, b: int) -> np.ndarray:
        """The ones before each place of a block and after its last."""
        if (k, b) not in self._undone:
            if len(self._undone) >= 4 * self.width:
                self._undone.clear()
            self._undone[k, b] = np.concatenate([[0], np.cumsum(self._bits(k, b), dtype=np.int64)])
        return self._undone[k, b]

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """The ones of a plane before each place."""
        out = np.empty(len(at), np.int64)
        block = np.minimum(at >> BLOCK_BITS, max(len(self.planes[k]) - 1, 0))
        for b in np.unique(block) if self.n else []:
            here = block == b
            out[here] = int(self.ones[k, b]) + self._within(k, b)[at[here] - (b << BLOCK_BITS)]
        return out if self.n else np.zeros(len(at), np.int64)

    def _select(self, k: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """The place of the n-th (from 0) one or zero of a plane."""
        before = self.ones[k].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for b in np.unique(block):
            here = block == b
            within = self._within(k, b)
            if not one:
                within = np.arange(len(within)) - within
            out[here] = (b << BLOCK_BITS) + np.searchsorted(within, nth[here] - before[b], "right") - 1
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for k in range(self.width):
            before = self._rank(k, at)
            bit = self._rank(k, at + 1) - before
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + before, at - before)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the last plane leads the token's occurrences before ``end``."""
        if not 0 <= token < 1 << self.width:
            return 0, 0
        at = np.array([0, end], np.int64)
        for k in range(self.width):
            before = self._rank(k, at)
            at = self.zeros[k] + before if token >> (self.width - 1 - k) & 1 else at - before
        return int(at[0]), int(at[1])

    def rank(self, token: int, end: int) -> int:
        """How often a token occurs before a place."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: np.ndarray) -> np.ndarray:
        """The places of a token's n-th occurrences (from 0), which must exist."""
        at = self._range(token, self.n)[0] + np.asarray(nth, np.int64)
        for k in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - k) & 1)
            at = self._select(k, at - self.zeros[k] if one else at, one)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids: from the last plane up, each undoes its parting of zeros and ones."""
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bit = np.concatenate([np.zeros(0, np.uint8), *(self._bits(k, b) for b in range(len(self.planes[k])))]).view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~bit)] = out[: self.zeros[k]]
            back[np.flatnonzero(bit)] = out[self.zeros[k] :] | out.dtype.type(1 << (self.width - 1 - k))
            out = back
        return out.astype(np.uint32)


class Shard:
    """A shard's wavelet matrix and the documents, or pieces of them, that it holds in order.
    ``at`` ids of its task's lie before it, ``skipped`` of them of its first document, which is the
    task's document number ``first``; ``ended`` tells whether the last document ends here."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: pa.Array, lengths: np.ndarray, place: dict[str, int]):
        self.matrix, self.doc_ids, self.lengths, self.place = matrix, doc_ids, lengths, place

    def to_bytes(self) -> bytes:
        blocks = [b for plane in self.matrix.planes for b in plane]
        ids = self.doc_ids.cast(pa.int64())
        arrays = [
            np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(),
            ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
            self.lengths.astype("<u4").tobytes(),
            self.matrix.ones.astype("<u4").tobytes(),
            np.array([len(b) for b in blocks], "<u4").tobytes(),
        ]
        head = self.place | {"n": self.matrix.n, "width": self.matrix.width, "documents": len(ids)}
        parts = [zlib.compress(json.dumps(head).encode()), zlib.compress(b"".join(arrays), 1)]
        return b"".join([MAGIC, struct.pack("<II", *map(len, parts)), *parts, *blocks])

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        sizes = struct.unpack("<II", data[4:12])
        head = json.loads(zlib.decompress(data[12 : 12 + sizes[0]]))
        n, width, documents = head.pop("n"), head.pop("width"), head.pop("documents")
        arrays, at = zlib.decompress(data[12 + sizes[0] : 12 + sum(sizes)]), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(arrays, kind, count, at)
            at += out.nbytes
            return out

        valid = np.unpackbits(take("u1", -(-documents // 8)), count=documents).astype(bool)
        ids = pa.array(take("<i8", documents), mask=~valid)
        lengths = take("<u4", documents).astype(np.int64)
        count = -(-n // BLOCK)
        ones = take("<u4", width * (count + 1)).reshape(width, count + 1)
        ends = 12 + sum(sizes) + np.cumsum(take("<u4", width * count), dtype=np.int64)
        starts = np.concatenate([[12 + sum(sizes)], ends[:-1]]) if len(ends) else ends
        view = memoryview(data)
        blocks = [bytes(view[s:e]) for s, e in zip(starts, ends)]
        planes = [blocks[k * count : (k + 1) * count] for k in range(width)]
        return Shard(WaveletMatrix(n, planes, ones), ids, lengths, head)


class _Writer:
    """Cuts a task's documents into shards and writes their files."""

    def __init__(self, folder: str, width: int, size: int):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.width, self.size, self.task = width, size, TaskContext.get().partitionId()
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.held = self.at = self.first = self.skipped = self.nth = 0

    def add(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> Iterator[tuple]:
        while len(ids) and self.held + len(ids) >= self.size:
            room = self.size - self.held
            ends = np.cumsum(lengths)
            whole = int(np.searchsorted(ends, room, "right"))
            inside = room - (int(ends[whole - 1]) if whole else 0)
            part = np.append(lengths[:whole], inside) if inside else lengths[:whole]
            self._hold(ids[:room], doc_ids[: len(part)], part)
            yield self._flush(ended=not inside, inside=inside)
            ids, doc_ids, lengths = ids[room:], doc_ids[whole:], lengths[whole:].copy()
            if inside:
                lengths[0] -= inside
        self._hold(ids, doc_ids, lengths)

    def _hold(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths)
        self.held += len(ids)

    def _flush(self, ended: bool, inside: int = 0) -> tuple:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        place = {"task": self.task, "at": self.at, "first": self.first, "skipped": self.skipped, "ended": int(ended)}
        shard = Shard(WaveletMatrix.of(ids, self.width), pa.concat_arrays(self.doc_ids), lengths, place)
        name, data = f"{self.task:06d}-{self.nth:06d}.lwm", shard.to_bytes()
        # A task that runs again writes the same: its file takes the other's place.
        own = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as out:
            out.write(data)
        self.fs.move(own, f"{self.folder}/{name}")
        self.skipped = 0 if ended else inside + (self.skipped if len(lengths) == 1 else 0)
        self.first += len(lengths) - (not ended)
        self.at, self.nth = self.at + len(ids), self.nth + 1
        self.ids, self.doc_ids, self.lengths, self.held = [], [], [], 0
        return name, self.task, len(ids), len(lengths), len(data)

    def close(self) -> Iterator[tuple]:
        if any(map(len, self.lengths)):  # without an end id a document may have no ids at all
            yield self._flush(ended=True)


FILES = "file string, task int, tokens long, pieces long, bytes long"
PIECES = "task int, document long, shard_start long, doc_id long, skipped long, n long, crc long, whole boolean"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, shard_bits: int = SHARD_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text as the tokenizers library does, with ``end_id`` after each, and
    write the ids in ascending order of ``id_col`` to wavelet-matrix files in ``folder`` (a new one,
    of any kind that pyarrow can write), each of ``2 ** shard_bits`` ids at most.  Returns a row a file.

    A null text is an empty one; null ids come first; rows of one id are ordered by a hash of
    the text and are all written.  Other columns are not read."""
    spark = docs.sparkSession
    fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(inner)
    shared = spark.sparkContext.broadcast(described(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        out = _Writer(folder, int(max(bpe.count - 1, end_id or 0)).bit_length(), 1 << shard_bits)
        for batch in batches:
            for part in slices(batch, 8):
                ids, at = bpe.encode_column(part.column(1))
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                yield from table_rows(FILES, list(out.add(ids, part.column(0), np.diff(at))))
        yield from table_rows(FILES, list(out.close()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("id", "text").mapInArrow(tidy(run), FILES))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, ``path, content``, each a row; the tasks that read them hold
    ``spark.sql.files.maxPartitionBytes`` of them at most."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.lwm").load(folder).select("path", "content")


def _over(spark: SparkSession, folder: str, schema: str, rows_of: Any) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from table_rows(schema, rows_of(Shard.from_bytes(content.as_py())))

    return shards(spark, folder).mapInArrow(tidy(run), schema)


def _pieces(shard: Shard) -> list[tuple]:
    ids, ends = shard.matrix.ids().astype("<u4"), np.cumsum(shard.lengths)
    out = []
    for n, (doc_id, size, end) in enumerate(zip(shard.doc_ids.to_pylist(), shard.lengths.tolist(), ends.tolist())):
        skipped = 0 if n else shard.place["skipped"]
        whole = not skipped and (n + 1 < len(ends) or bool(shard.place["ended"]))
        crc = zlib.crc32(ids[end - size : end])
        out.append((shard.place["task"], shard.place["first"] + n, shard.place["at"] + end - size, doc_id, skipped, size, crc, whole))
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id, start`` (ids of all documents before it)``, n_tokens,
    ids_crc32`` (of its ids as little-endian unsigned 32-bit numbers)."""
    pieces = written(_over(spark, folder, PIECES, _pieces))
    starts = _task_starts(pieces)
    key = ["task", "document"]
    whole = pieces.where("whole").select(*key, "doc_id", F.col("shard_start").alias("at"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # A document has as many pieces as it has shards, so the list is short.
    listed = F.array_sort(F.collect_list(F.struct("skipped", "n", "crc")))
    cut = pieces.where("not whole").groupBy(*key).agg(F.max("doc_id").alias("doc_id"), F.min("shard_start").alias("at"), F.sum("n").alias("n_tokens"), listed.alias("parts"))
    joined = cut.select(*key, "doc_id", "at", "n_tokens", crc_of_parts(F.col("parts.n"), F.col("parts.crc")).alias("ids_crc32"))
    rows = whole.unionByName(joined).join(F.broadcast(starts), "task")
    return rows.select("doc_id", (F.col("task_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _task_starts(pieces: DataFrame) -> DataFrame:
    """Where each writing task's ids begin: a row a task, so few that the driver adds them up."""
    sums = {r.task: r.n for r in pieces.groupBy("task").agg(F.sum("n").alias("n")).collect()}
    rows, at = [], 0
    for task in sorted(sums):
        rows.append((task, at))
        at += sums[task]
    return pieces.sparkSession.createDataFrame(rows, "task int, task_start long")


def crc_joined(left: int, right: int, size: int) -> int:
    """The CRC-32 of two byte strings from those of each and the length of the second."""

    def times(a: int, b: int) -> int:
        out = 0
        for _ in range(32):
            out ^= b if a >> 31 else 0
            a = a << 1 & 0xFFFFFFFF
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    shift, power, bits = 1 << 31, 1 << 30, 8 * size  # x to the powers 0 and 1, bits reversed
    while bits:
        if bits & 1:
            shift = times(shift, power)
        power, bits = times(power, power), bits >> 1
    return times(shift, left) ^ right


def crc_of_parts(sizes: Any, crcs: Any) -> Any:
    @F.arrow_udf("long")
    def run(sizes: pa.Array, crcs: pa.Array) -> pa.Array:
        out = []
        for ns, cs in zip(sizes.to_pylist(), crcs.to_pylist()):
            crc = 0
            for n, c in zip(ns, cs):
                crc = crc_joined(crc, c, 4 * n)
            out.append(crc)
        return pa.array(out, pa.int64())

    return run(sizes, crcs)


def counts(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """``token, n``: how often each of the tokens occurs in all files, by ``rank`` alone."""
    wanted = sorted(set(tokens))
    found = _over(spark, folder, "token long, n long", lambda shard: [(t, shard.matrix.count(t)) for t in wanted])
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``doc_id, at``: each place of a token within a document (from 0), by ``select`` alone."""

    def found(shard: Shard) -> list[tuple]:
        at = shard.matrix.occurrences(token)
        ends = np.cumsum(shard.lengths)
        doc = np.searchsorted(ends, at, "right")
        within = at - (ends - shard.lengths)[doc] + np.where(doc == 0, shard.place["skipped"], 0)
        return list(zip(shard.doc_ids.take(pa.array(doc)).to_pylist(), within.tolist()))

    return _over(spark, folder, "doc_id long, at long", found)


def tokens_at(spark: SparkSession, folder: str, places: Sequence[int]) -> DataFrame:
    """``at, token`` of places of the whole corpus (a list that the caller bounds), by ``access``
    alone; a place beyond the last has no row."""
    asked = np.unique(np.asarray(places, np.int64))
    spans = _over(spark, folder, "task int, n long", lambda shard: [(shard.place["task"], shard.matrix.n)])
    starts = {r.task: r.task_start for r in _task_starts(spans).collect()}

    def found(shard: Shard) -> list[tuple]:
        begin = starts[shard.place["task"]] + shard.place["at"]
        here = asked[(asked >= begin) & (asked < begin + shard.matrix.n)]
        return list(zip(here.tolist(), shard.matrix.access(here - begin).tolist()))

    return _over(spark, folder, "at long, token long", found)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``write`` to a new folder beside the checkpoints, and ``read`` of it."""
    folder = f"{shared_folder(docs.sparkSession)}/loomlog-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, end_id)
    return read(docs.sparkSession, folder)
