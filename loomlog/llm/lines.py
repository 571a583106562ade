"""Fuzzy line deduplication across a corpus.

Lines are normalised (lower case, single spaces) and equal ones merged by a hash of 128
bits.  Each distinct line has a SimHash over its pairs of words.  Cut into five blocks,
two SimHashes that differ in three bits at most agree on two blocks, so lines meet under
the ten pairs of blocks; those within three bits are verified by edit similarity on
their texts.  Of each connected group of lines the first occurrence stays.

With ``wide`` lines meet under MinHash bands over their pairs of words, short ones also
over their trigrams, in place of the SimHash, which edits within the similarity carry
far beyond three bits.  Counts of letters, a lower bound of the edits, spare comparisons
without losing a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .bpe import slices
from .graph import components
from .shared import give_back, mixed, tidy, unused, written

#: Differing bits up to which lines are verified, and the similarity that links them.
RADIUS, SIMILAR = 3, 0.8
#: Distinct lines from which keys of three blocks of six are used (20 of 32 bits) in
#: place of two of five (10 of 25 or 26); both meet wherever three bits differ.
MANY = 1 << 27
#: Lines of one key beyond which they are compared in blocks, and lines of a block.
CROWD, CHUNK = 64, 512
#: Keys that a sample of one line in SAMPLED shows to be crowded aren't sorted with the
#: others: the HEAVY most frequent, of more than SEEN sampled lines.
SAMPLED, SEEN, HEAVY = 64, 1_000, 10_000
#: Bands of three minima under which lines meet, and bytes up to which trigrams count too.
BANDS, SHORT = 16, 48
#: Hashes of which minima are taken at once.
CACHED = 1 << 14
#: Keys dealt to a task.
DEALT = 1 << 19
#: Bits that tell which lines' texts are wanted, as a power of two.
WANTED_BITS = 24

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
Alike = Callable[[list[str], list[str]], np.ndarray]

_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1]).astype(np.uint8).copy().view("<u8").ravel()


def _pairs(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each word's hash that of the word and the next of its line."""
    after = np.append(hashes[1:], np.uint64(0))
    after[at[1:][np.diff(at) > 0] - 1] = 0
    return mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + after)


def simhashes(words: pa.ListArray) -> np.ndarray:
    """SimHash (signed) over the pairs of neighbouring words of each list, repeats
    included (a single word: the word and nothing; none: 0)."""
    flat = words.flatten().dictionary_encode()
    digests = b"".join(xxhash.xxh64_digest(w.encode()) for w in flat.dictionary.to_pylist())
    out = np.zeros(len(words), np.int64)
    if not digests:
        return out
    at = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)[flat.indices.to_numpy()]
    pairs = _pairs(hashes, at)
    size = np.diff(at)
    size = size - (size > 1)
    runs = -(-size // 255)
    some = np.flatnonzero(runs)
    first = np.repeat(at[:-1][some], runs[some])
    step = np.arange(len(first)) - np.repeat(np.cumsum(runs[some]) - runs[some], runs[some])
    start = first + 255 * step
    end = np.minimum(start + 255, np.repeat(at[:-1][some] + size[some], runs[some]))
    # Eight counters of a byte side by side in a number: 255 pairs fit without carry.
    # The last word of a line begins no pair, so what lies between two runs is cut off.
    bits = _SPREAD[pairs.astype("<u8").view(np.uint8).reshape(-1, 8)]
    bounds = np.stack([start, end], axis=1).ravel()
    bits = np.vstack([bits, np.zeros((1, 8), bits.dtype)])
    sums = np.add.reduceat(bits, bounds, axis=0)[::2]
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(runs[some]) - runs[some], axis=0)
    out[some] = np.packbits(2 * ones > size[some, None], axis=1, bitorder="little").view("<i8").ravel()
    return out


def normal(lines: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """The words of each line, and its normal form."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(lines)))
    return words, pc.binary_join(words, " ")


def bands(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, count: int = BANDS, rows: int = 3) -> np.ndarray:
    """MinHash bands (n x count, 32 bits) of the hashes from ``start`` to ``end`` of each
    set; no set is empty, and the hashes end with one that belongs to none."""
    out = np.zeros((len(start), count), np.uint32)
    if not len(start):
        return out
    # What lies between two sets is cut off, so that each begins where the last one ends.
    edges = np.bincount(start, minlength=len(hashes) + 1) - np.bincount(end, minlength=len(hashes) + 1)
    hashes = hashes[np.cumsum(edges)[: len(hashes)] > 0]
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    last = np.cumsum(end - start)
    factors = (mixed(np.arange(1, count * rows + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    begin = 0
    while begin < len(start):  # so many sets at a time as the processor's cache holds
        at = int(last[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(last, at + CACHED, "right")))
        now = hashes[at : int(last[stop - 1])]
        first = np.append(at, last[begin : stop - 1]) - at
        least = np.empty((count, rows, stop - begin), np.uint32)
        for n, factor in enumerate(factors):
            np.minimum.reduceat(now * factor, first, out=least[n // rows, n % rows])
        band = np.repeat(np.arange(1, count + 1, dtype=np.uint64)[:, None], stop - begin, axis=1)
        for n in range(rows):
            band += least[:, n] * weights[n]
        out[begin:stop] = (mixed(band) >> np.uint64(32)).T
        begin = stop
    return out


#: The count of eight that each byte of a text belongs to: common letters lie apart, and
#: bytes within a character (8) aren't counted.
_LETTER = np.array([8 if 0x80 <= b < 0xC0 else (" etaoinsrhldcumfpgwybvk".find(chr(b)) % 8 if chr(b) in " etaoinsrhldcumfpgwybvk" else b % 8) for b in range(256)])


def letters(text: pa.Array) -> np.ndarray:
    """Eight counts of characters (255 at most) side by side in a signed long each."""
    data, at = _bytes(text)
    out = np.zeros((len(text), 8), np.uint8)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        of = _LETTER.astype(np.uint8)[data]
        for n in range(8):
            out[some, n] = np.minimum(np.add.reduceat((of == n).view(np.uint8), at[:-1][some], dtype=np.uint32), 255)
    return out.view("<i8").ravel()


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    listed = text.cast(pa.large_binary())
    if isinstance(listed, pa.ChunkedArray):
        listed = listed.combine_chunks()
    at = np.frombuffer(listed.buffers()[1], np.int64)[listed.offset : listed.offset + len(listed) + 1]
    data = np.frombuffer(listed.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def reachable(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of such counts of letters can be alike: each edit adds a character
    at most and takes one at most.  Full counts tell nothing."""
    a = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).astype(np.int16)
    b = np.ascontiguousarray(y).view(np.uint8).reshape(-1, 8).astype(np.int16)
    step = a - b
    edits = np.maximum(np.maximum(step, 0).sum(axis=1), np.maximum(-step, 0).sum(axis=1))
    most = np.maximum(a.sum(axis=1), b.sum(axis=1))
    return (edits <= (1 - SIMILAR) * most + 1e-9) | (a == 255).any(axis=1) | (b == 255).any(axis=1)


def within_radius(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= RADIUS


_POWER = np.uint64(0x9E3779B97F4A7C15)


def _powers(of: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


#: Bytes of lines that are hashed at a time, and the powers for so many.
PIECE = 1 << 16
_UP = _powers(_POWER, PIECE + 1)
_DOWN = _powers(np.uint64(pow(int(_POWER), -1, 1 << 64)), PIECE + 1)


def _neighbours(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each two neighbouring words (a single one alone) of the lines, which have a space
    between words, none at their ends, and no byte between one and the next; where each line's begin.

    Of running sums of ``byte * p^i`` (modulo 2^64, p odd) the difference of two, over the
    power at the first, is the same for the same bytes anywhere."""
    end = begin + length
    space = np.flatnonzero(data == 32)
    words = np.searchsorted(space, end) - np.searchsorted(space, begin) + 1
    at = np.append(0, np.cumsum(words))
    # The starts of words: of lines, and behind each space; their ends likewise.
    starts = np.empty(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    starts[at[:-1]], starts[inner] = begin, space + 1
    stops = np.empty(at[-1], np.int64)
    inner[at[:-1]] = True
    inner[at[1:] - 1] = False
    stops[at[1:] - 1], stops[inner] = end, space
    # Of a line of several words the last begins no pair.
    lone = np.repeat(words == 1, words)
    two = inner | lone
    upto = np.where(lone, stops, np.append(stops[1:], 0))[two]
    starts = starts[two]
    up, down = _UP, _DOWN
    if len(data) > PIECE:
        up, down = _powers(up[1], len(data) + 1), _powers(down[1], len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[upto] - sums[starts]) * down[starts]), np.append(0, np.cumsum(words - (words > 1)))


def signatures(words: pa.ListArray, text: pa.Array) -> pa.Array:
    """The bands of each line: those over its pairs of words, and, of a short line, over
    its trigrams (of bytes, with a space at both ends)."""
    found = np.zeros((len(words), 2 * BANDS), np.uint32)
    filled = np.zeros(found.shape, bool)
    data, ends = _bytes(text)
    length = np.diff(ends)
    some = np.flatnonzero(length)
    if len(some):
        pairs, at = _neighbours(data, ends[:-1][some], length[some])
        found[some, :BANDS] = bands(np.append(pairs, np.uint64(0)), at[:-1], at[1:])
        filled[some, :BANDS] = True
        short = some[length[some] <= SHORT]
        data, ends = _bytes(pc.binary_join_element_wise(" ", text.take(pa.array(short)), " ", ""))
        if len(short):
            data = data.astype(np.uint64)
            grams = mixed((data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) + np.uint64(1))
            found[short, BANDS:] = bands(np.append(grams, grams[-1:]), ends[:-1], ends[1:] - 2)
            filled[short, BANDS:] = True
    offsets = np.append(0, np.cumsum(4 * filled.sum(axis=1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(found[filled])])


def _keys_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of column ``bands``, and the row of each."""
    size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4
    band = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
    place = np.arange(len(band)) - np.repeat(np.cumsum(size) - size, size)
    return place % width << 32 | band, np.repeat(np.arange(batch.num_rows), size)


def band_keys(distinct: DataFrame, width: int) -> DataFrame:
    """``key, number, bits``: a row for each band of column ``bands``, of which a key
    names the place and ``width`` places follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = _keys_of(batch, width)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(row), batch.column(1).take(row)], ["key", "number", "bits"])

    return distinct.select("number", "bits", "bands").mapInArrow(tidy(run), "key long, number long, bits long")


def met_bands(distinct: DataFrame, width: int, heavy: DataFrame, most: int, close: Near) -> DataFrame:
    """What ``_meetings`` gives of ``band_keys`` without the ``heavy`` keys, some ``DEALT`` of them to
    a task.  Keys travel in runs, a row for those of a batch that go to one task, as most are
    of a single line and a row each costs more than all that is done with them."""
    count = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * width // DEALT))
    left_out = np.sort(np.array([r.key for r in heavy.collect()], np.int64))  # HEAVY at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = _keys_of(batch, width)
            if len(left_out):
                kept = left_out[np.minimum(np.searchsorted(left_out, key), len(left_out) - 1)] != key
                key, row = key[kept], row[kept]
            part = (mixed(key.view(np.uint64)) % np.uint64(count)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            number, bits = (batch.column(n).to_numpy()[row[order]] for n in (0, 1))
            run = np.stack([key[order], number, bits], axis=1)
            parts, first = np.unique(part[order], return_index=True)
            ends = np.append(first, len(order)).astype(np.int32) * run.itemsize * 3
            runs = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(run)])
            yield pa.RecordBatch.from_arrays([pa.array(parts), runs], ["part", "run"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), np.int64).reshape(-1, 3)
        order = np.argsort(run[:, 0])
        same = np.append(np.diff(run[order, 0]) == 0, False)[: len(run)]
        run = run[order[same | np.append(False, same)[: len(run)]]]
        if len(run):
            yield from _meetings(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in run.T.copy()], ["key", "number", "bits"])]), most, close)

    runs = distinct.select("number", "bits", "bands").mapInArrow(tidy(deal), "part int, run binary")
    return runs.repartition(count, "part").mapInArrow(tidy(meet), "key long, a long, b long, bits long")


def _pieces(text: pa.Array) -> Iterator[slice]:
    """Lines in order, of ``PIECE`` bytes together or one alone."""
    _, at = _bytes(text)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + PIECE, "right")) - 1)
        yield slice(begin, end)
        begin = end


def _signed(words: pa.ListArray, text: pa.Array) -> tuple[pa.Array, pa.Array]:
    found = [(letters(t), signatures(w, t)) for p in _pieces(text) for t, w in [(text[p], words[p])]]
    if not found:
        return pa.array([], pa.int64()), pa.array([], pa.binary())
    return pa.array(np.concatenate([x for x, _ in found])), pa.concat_arrays([x for _, x in found])


def _occurrences(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 4):
            cut = pc.split_pattern(pc.fill_null(part.column(1), ""), "\n")
            row = pc.list_parent_indices(cut)
            at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            number = np.arange(len(row)) - np.repeat(at[:-1], np.diff(at))
            words, text = normal(cut.flatten())
            keep = pc.not_equal(text, "")
            hashes = pa.array([xxhash.xxh3_128_digest(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())
            bits, of = _signed(words, text) if wide else (pa.array(simhashes(words)), pa.nulls(len(text), pa.binary()))
            out = pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(2).take(row), pa.array(number, pa.int32()), hashes, bits, of],
                ["id", "th", "nr", "line", "bits", "bands"],
            )
            yield out.filter(keep)


def _shared_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / longer length; of two empty texts 1."""
    most = max(len(a), len(b))
    return 1 - distance(a, b) / most if most else 1.0


def distance(a: str | list[str], b: str | list[str], most: int | None = None) -> int:
    """Levenshtein distance of two sequences; some number beyond ``most``, if given, as
    soon as it is known to be so."""
    i = _shared_start(a, b)
    a, b = a[i:], b[i:]
    i = _shared_start(a[::-1], b[::-1])
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b))
    # Myers: the column of the matrix as two bit vectors of +1 and -1 steps.
    at: dict[str, int] = {}
    for n, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << n
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, found = mask, 0, len(a)
    # Each element of b left over can take one edit away at most.
    bound = len(b) + (len(a) + len(b) if most is None else most)
    for y in b:
        same = at.get(y, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        right, left = down | ~(diagonal | up) & mask, up & diagonal
        found += bool(right & top) - bool(left & top)
        bound -= 1
        if found > bound:
            return found
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & mask, right & diagonal & mask
    return found


def _alike(a: str, b: str) -> bool:
    """Whether the edit similarity is ``SIMILAR`` or more.  Long lines are compared word
    by word first: so many edits of words can't be more edits of characters than the
    longest words have."""
    most = max(len(a), len(b))
    allowed = (1 - SIMILAR) * most + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    if most > 40:
        v, w = a.split(" "), b.split(" ")
        costs = accumulate(n + 1 for n in sorted(map(len, v + w), reverse=True))
        fit = sum(1 for _ in takewhile(lambda cost: cost <= allowed, costs))
        if distance(v, w, fit) <= fit:
            return True
    return distance(a, b, int(allowed)) <= allowed


#: Cells that a step over many pairs takes at once, characters up to which lines are compared
#: so, pairs from which it pays, and steps between two looks at what can still be alike.
CELLS, LONGEST, FEW, LOOK = 1 << 15, 4096, 8, 64


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as small numbers, and each text's length."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    top = int(flat.max(initial=0))
    return flat.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _laid(texts: list[str], rows: int, backwards: bool = False) -> np.ndarray:
    """A column a text; character ``n`` (from 1) in row ``n``, or so many from the last row."""
    flat, size = _symbols(texts)
    out = np.zeros((rows, len(texts)), flat.dtype)
    n = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
    out[rows - 1 - n if backwards else n, np.repeat(np.arange(len(texts)), size)] = flat
    return out


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair is ``most`` at most.

    The matrices of all pairs are filled together, one antidiagonal after another, on the
    diagonals that a path of so many edits can touch.  Texts end in equal characters
    without end, which change no distance, so that all pairs end on the last two."""
    a, b = [max(x, y, key=len) for x, y in zip(a, b)], [min(y, x, key=len) for x, y in zip(a, b)]
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    more = size_a - size_b
    spare = (most - more) // 2
    below, steps = int(spare.max()), int((size_a + size_b).max())
    diagonals = below + int((more + spare).max()) + 1
    rows = (steps + diagonals) // 2 + 2
    across, down = _laid(a, rows), _laid(b, rows, True)
    limit = int(most.max())
    kind, far = (np.uint8, 254) if limit < 254 - LOOK else (np.uint16, 60_000)
    # Diagonal d is a - b + below: even and odd ones apart, as steps alternate between them.
    cells = [np.full((diagonals // 2 + 3, len(a)), far, kind) for _ in range(2)]
    cells[below % 2][below // 2 + 1] = 0
    out, of = np.zeros(len(a), bool), np.arange(len(a))
    for t in range(1, steps + 1):
        odd = (t + below) % 2
        low, high = max(0, below - t), min(diagonals - 1, below + t)
        first, last = (low - odd + 1) // 2, (high - odd) // 2 + 1
        if first < last:
            n = last - first
            i = (t + odd - below) // 2 + first
            j = rows - 1 - (t - odd + below) // 2 + first
            here, beside = cells[odd][first + 1 : last + 1], cells[1 - odd]
            here += (across[i : i + n] != down[j : j + n]).view(np.uint8)
            step = np.minimum(beside[first + odd : first + odd + n], beside[first + odd + 1 : first + odd + n + 1])
            step += 1
            np.minimum(here, step, out=here)
        if t >= steps - 1:
            ended = np.flatnonzero((size_a + size_b)[of] % 2 == t % 2)
            place = more[of[ended]] + below
            out[of[ended]] = cells[odd][place // 2 + 1, ended] <= most[of[ended]]
        elif t % LOOK == 0:
            for x in cells:
                np.minimum(x, far - LOOK, out=x)
            left = np.flatnonzero(np.minimum(cells[0].min(axis=0), cells[1].min(axis=0)) <= most[of])
            if not len(left):
                break
            if 2 * len(left) < len(of):
                across, down, of = across[:, left], down[:, left], of[left]
                cells = [x[:, left] for x in cells]
    return out


def alike_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``_alike`` of each pair, many pairs of about one length at a time."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    longer = np.maximum(size_a, size_b)
    allowed = ((1 - SIMILAR) * longer + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    order = np.flatnonzero(abs(size_a - size_b) <= allowed)
    order = order[np.argsort(longer[order], kind="stable")]
    while len(order):
        # Pairs of up to a quarter more characters (and a few) go together, within the cells.
        end = int(np.searchsorted(longer[order], longer[order[0]] * 5 // 4 + 8, "right"))
        end = min(end, max(FEW, CELLS // (int(allowed[order[end - 1]]) // 2 + 1)))
        now, order = order[:end], order[end:]
        left, right = [a[n] for n in now], [b[n] for n in now]
        if len(now) < FEW or longer[now[-1]] > LONGEST:
            out[now] = [_alike(x, y) for x, y in zip(left, right)]
        else:
            out[now] = _within(left, right, allowed[now])
    return out


#: Pairs of a block that are compared at once, at first and at most.
TOGETHER, AT_MOST = 1 << 10, 1 << 14


def _forest(pdf: pd.DataFrame, close: Near, alike: Alike) -> pd.DataFrame:
    """A spanning forest of the links among the lines of one pair of blocks.  Lines that are
    linked already aren't compared, nor those that a smaller one of their crowded ``keys`` brings together."""
    pdf = pdf.drop_duplicates("number")
    line, text, bits = pdf["number"].to_numpy(), pdf["text"].tolist(), pdf["bits"].to_numpy()
    count, key = len(line), pdf["key"].iat[0]
    elsewhere = np.zeros((count, count), bool)
    if "keys" in pdf:
        size = pdf["keys"].map(len).to_numpy()
        other = pd.Series(np.repeat(np.arange(count), size)).groupby(np.concatenate(pdf["keys"].to_list()))
        for k, members in other.indices.items():
            if k < key and len(members) > 1:
                at = other.obj.to_numpy()[members]
                elsewhere[np.ix_(at, at)] = True
    group, edges, at, together = np.arange(count), [np.zeros((0, 2), np.int64)], 0, TOGETHER
    while at < count - 1:
        # The first alone and with all, as it may be linked with all.
        end = min(count, at + (max(1, together // (count - at)) if at else 1))
        row, column = np.divmod(np.arange((end - at) * (count - at)), count - at)
        row, column = row + at, column + at
        new = (row < column) & (group[row] != group[column])
        if at:
            new &= ~elsewhere[row, column]
        row, column, at = row[new], column[new], end
        near = close(bits[column], bits[row])
        row, column = row[near], column[near]
        found = np.flatnonzero(alike([text[n] for n in row], [text[n] for n in column]))
        merged = len(edges)
        for a, b in zip(row[found].tolist(), column[found].tolist()):
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
                edges.append(np.array([[line[a], line[b]]]))
        # Where few are linked, little is spared by looking often.
        together = TOGETHER if 8 * (len(edges) - merged) > len(row) else min(2 * together, AT_MOST)
    return pd.DataFrame(np.concatenate(edges), columns=["a", "b"])


def _keys(bits: str, lines: int) -> Column:
    """A key of each choice of blocks that agree if three others hold a difference."""
    count = 5 if lines < MANY else 6
    ends = [64 * n // count for n in range(count + 1)]

    def block(n: int) -> tuple[Column, int]:
        size = ends[n + 1] - ends[n]
        return F.shiftrightunsigned(bits, ends[n]).bitwiseAND(F.lit((1 << size) - 1)), size

    keys = []
    for k, chosen in enumerate(combinations(range(count), count - RADIUS)):
        key = F.lit(k).cast("long")
        for n in chosen:
            value, size = block(n)
            key = F.shiftleft(key, size).bitwiseOR(value)
        keys.append(key)
    return F.array(*keys)


def _meetings(batches: Iterator[pa.RecordBatch], most: int, close: Near = within_radius) -> Iterator[pa.RecordBatch]:
    """Rows ``key, number, bits`` in the order of the key to pairs ``a, b`` whose
    bits are ``close``, or, of a key that more than ``most`` lines have, to a row a line with
    ``b`` null.  What is held is one batch and one key's first ``most`` lines."""
    names = ["key", "a", "b", "bits"]

    def rows(key, a, b, bits):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.int64())], names)

    def pairs(key: np.ndarray, number: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(start, len(key)))
        left = np.repeat(start + size, size) - np.arange(len(key)) - 1
        for step in range(1, int(size.max())):
            i = np.flatnonzero(left >= step)
            i = i[close(bits[i], bits[i + step])]
            if len(i):
                a, b = number[i], number[i + step]
                yield rows(np.zeros(len(i), np.int64), np.minimum(a, b), np.maximum(a, b), np.zeros(len(i), np.int64))

    held = [np.zeros(0, np.int64)] * 3
    crowd: int | None = None
    for batch in batches:
        now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
        key = now[0]
        if not len(key):
            continue
        start = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(start, len(key)))
        last = int(start[-1])
        crowded = size > most
        if crowd is not None and key[0] == crowd:
            crowded[0] = True
        of = np.repeat(crowded, size)
        if of.any():
            yield rows(key[of], now[1][of], [None] * int(of.sum()), now[2][of])
        crowd = int(key[-1]) if crowded[-1] else None
        done = ~of
        done[last:] = False
        if done.any():
            yield from pairs(*(x[done] for x in now))
        held = [x[last:][:0] if crowded[-1] else x[last:] for x in now]
    if len(held[0]):
        yield from pairs(*held)


def _marks(id_: np.ndarray, th: np.ndarray, nr: np.ndarray) -> np.ndarray:
    seeded = mixed(id_.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ th.view(np.uint64))
    return (mixed(seeded + nr.astype(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def _texts_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``number, text`` in normal form, from each wanted line's first occurrence.

    A bitmap of fixed size tells nearly always which lines of a document are wanted, so
    that documents aren't shuffled for this; a join settles it."""
    page = 1 << 15

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
            at = np.unique(_marks(ids, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at // page), pa.array(at % page)], ["page", "bit"])

    def paged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(page, np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    marked = wanted.select("id", "th", "nr").mapInArrow(tidy(marks), "page long, bit long").distinct()
    pages = marked.groupBy("page").applyInPandas(paged, "page long, bits binary").toPandas()
    bitmap = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for r in pages.itertuples():
        bitmap[r.page * page // 8 : (r.page + 1) * page // 8] = np.frombuffer(r.bits, np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = pc.add(pc.count_substring(batch.column(1), "\n"), 1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), count)
            nr = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ids = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
            at = _marks(ids[row], batch.column(2).to_numpy()[row], nr)
            hit = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            lines, parts, of = [], [], -1
            for i, n in zip(row[hit].tolist(), nr[hit].tolist()):
                if i != of:
                    parts, of = batch.column(1)[i].as_py().split("\n"), i
                lines.append(parts[n])
            some = pa.array(row[hit])
            columns = [batch.column(0).take(some), batch.column(2).take(some), pa.array(nr[hit].astype(np.int32)), normal(pa.array(lines, pa.string()))[1]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "nr", "text"])

    found = source.mapInArrow(tidy(run), "id long, th long, nr int, text string").dropDuplicates(["id", "th", "nr"])
    same = wanted["id"].eqNullSafe(found["id"]) & (wanted["th"] == found["th"]) & (wanted["nr"] == found["nr"])
    return wanted.join(found, same).select("number", "text")


def links(source: DataFrame, distinct: DataFrame, wide: bool = False) -> DataFrame:
    """Links ``a``, ``b`` between distinct lines (``number, bits, bands, id, th, nr``)."""
    keys = None if wide else _keys("bits", distinct.count())

    def texts(numbers: DataFrame) -> DataFrame:
        return _texts_of(source, written(distinct.join(numbers, "number").select("number", "id", "th", "nr")))

    return met_links(distinct, keys, 2 * BANDS, texts, reachable if wide else within_radius, alike_pairs)


def met_links(
    distinct: DataFrame,
    keys: Column | None,
    width: int,
    texts_of: Callable[[DataFrame], DataFrame],
    close: Near,
    alike: Alike,
) -> DataFrame:
    """Links ``a``, ``b`` between the texts (``number, bits`` of ``distinct``) that meet under one of
    ``keys`` (none: column ``bands``, ``width`` places), have ``close`` bits and are ``alike``.

    Those of a key are compared as they follow one another; no link of a key is lost.
    The lines of a crowded key are dealt into blocks instead, whose pairs each give a
    spanning forest: neither a task nor the result holds all pairs.  The most crowded
    keys are told from a sample beforehand and not sorted into one task.
    """

    def keyed_of(some: DataFrame) -> DataFrame:
        return band_keys(some, width) if keys is None else some.select(F.explode(keys).alias("key"), "number", "bits")

    keyed = keyed_of(distinct)
    sample = keyed_of(distinct.where(F.pmod(F.xxhash64("number"), F.lit(SAMPLED)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    heavy = written(sample.where(F.col("n") > SEEN).orderBy(F.desc("n"), "key").limit(HEAVY).select("key"))
    # At most HEAVY keys: small enough to broadcast.
    rest = keyed.join(F.broadcast(heavy), "key", "left_anti")
    most = CROWD

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meetings(batches, most, close)

    @F.arrow_udf(BooleanType())
    def alike_rows(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(alike(a.to_pylist(), b.to_pylist()), pa.bool_())

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest(pdf, close, alike)

    if keys is None:
        met = met_bands(distinct, width, heavy, most, close)
    else:
        met = rest.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(meet), "key long, a long, b long, bits long")
    met = written(met)
    pairs = written(met.where("b is not null").select("a", "b").distinct())
    crowded = written(
        met.where("b is null").select("key", F.col("a").alias("number"), "bits").union(keyed.join(F.broadcast(heavy), "key"))
    )
    numbers = pairs.select(F.explode(F.array("a", "b")).alias("number")).union(crowded.select("number")).distinct()
    texts = written(texts_of(numbers))
    found = (
        pairs.join(texts.toDF("a", "left"), "a")
        .join(texts.toDF("b", "right"), "b")
        .where(alike_rows("left", "right"))
        .select("a", "b")
    )
    if crowded.isEmpty():
        return found
    sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    others = crowded.groupBy("number").agg(F.collect_set("key").alias("keys"))
    dealt = (
        crowded.join(sizes, "key")
        .join(others, "number")
        .withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "keys", "number", "bits", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(texts, "number")
    )
    return found.union(dealt.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long"))


@F.arrow_udf(StringType())
def _without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for t, d in zip((x.as_py() for x in text), dropped.to_pylist()):
        if t is not None and d:
            gone = set(d)
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out.append(t)
    cleaned = pa.array(out, pa.string())
    del out
    give_back()
    return cleaned


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """``docs`` with all their columns, ``text`` without the lines of which a like one
    occurs earlier (by id, then line number; a null id first), and ``lines_dropped``.

    Lines without a word stay.  A text may become empty; no row is dropped.  A null
    text stays null.  Rows that repeat both id and text are one document: each keeps
    the same lines.  Other columns are not read, whatever their names.  ``wide`` finds
    lines of edit similarity 0.8 that differ in more than three bits, too.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")).where(
        "text is not null"
    )
    found = written(source.mapInArrow(tidy(lambda b: _occurrences(b, wide)), "id long, th long, nr int, line binary, bits long, bands binary"))
    first = F.min(F.struct("id", "nr", "th"))
    distinct = written(
        found.groupBy("line")
        .agg(first.alias("first"), F.min("bits").alias("bits"), F.min("bands").alias("bands"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("number"), "line", "bits", "bands", "n", "first.*")
    )
    linked = components(links(source, distinct.drop("n", "line"), wide), "a", "b").withColumnRenamed("node", "number")
    heads = distinct.join(linked, "number").groupBy("component").agg(first.alias("keep"))
    merged = linked.join(heads, "component").select("number", "keep")
    repeated = (
        distinct.join(merged, "number", "left")
        .where((F.col("n") > 1) | F.col("keep").isNotNull())
        .select("line", F.coalesce("keep", F.struct("id", "nr", "th")).alias("keep"))
    )
    here = F.struct("id", "nr", "th")
    own, of_id, of_th, gone, left = (unused(docs, n) for n in ("__own", "__id", "__th", "__gone", "__left"))
    dropped = (
        found.join(repeated, "line")
        .where(~here.eqNullSafe(F.col("keep")))
        .groupBy("id", "th")
        .agg(F.collect_set("nr").alias(gone))
        .toDF(of_id, of_th, gone)
    )
    joined = docs.withColumn(own, F.xxhash64(text_col))
    joined = joined.join(dropped, joined[id_col].eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_th)), "left")
    cleaned = joined.withColumn(left, _without(F.col(text_col), F.col(gone)))
    kept = [F.col(left).alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "lines_dropped"]
    return cleaned.select(*kept, F.coalesce(F.size(gone), F.lit(0)).alias("lines_dropped"))
