"""Exact BPE encoding by backtracking, and decoding from an offset table.

Merging pair by pair isn't needed to find the merges' result.  An Aho-Corasick automaton
of the tokens spelled backwards reads each word from its end and so tells, for every
place, the longest token that begins there.  Tokens are then taken from the left, the
longest first.  A token may follow another only if merging the two spelled together
would keep them apart, which the table of pairs decides; where no token may follow, the
last one gives way to its longest proper prefix, and a place that led nowhere is not
tried again.  So the work is linear in the word.

White space always parts words here, so a text is cut there, and each distinct word of
some MB of texts is encoded once, all words in step in arrays.  A worker holds the
automaton and the pairs in arrays of fixed size, whatever it has read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, tidy

#: Slots, as a power of two, for pairs of tokens whose decision is kept.
PAIR_BITS = 18
#: Symbols of a word whose tokens are looked up in one go.
SCANNED = 64
#: Symbols are a byte, and, for the last of a word, a byte and this.
LAST = 256

#: What the steps of a description may be; any other file is refused.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Table:
    """Numbers by number (``missing`` where there is none): an open hash table in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = -1):
        bits = int(2 * len(keys) + 15).bit_length()
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], self.missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            held, key = self.keys[slot], keys[left]
            found = held == key
            out[left[found]] = self.values[slot[found]]
            on = ~found & (held >= 0)
            left, slot = left[on], slot[on]
        return out


class OffsetTable:
    """Byte strings by number, end to end, with the offsets between them."""

    def __init__(self, strings: list[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)

    def spell(self, ids: np.ndarray, step: int = 1 << 16) -> bytes:
        out = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            start = self.at[part]
            out.append(self.bytes[ranges(start, self.at[part + 1] - start)[0]].tobytes())
        return b"".join(out)


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges end to end, and where each range's begin and the last's end."""
    end = np.concatenate([[0], np.cumsum(size)])
    return np.arange(end[-1]) + np.repeat(start - end[:-1], size), end


class Bpe:
    """A byte-level BPE model with a suffix on the last symbol of a word, as the
    tokenizers library's JSON describes it (NFC, white space, lower case; a Split
    pattern; no decoder, so that decoding joins the tokens with spaces).  A description
    of any other kind raises ``ValueError``."""

    def __init__(self, description: bytes):
        spec = json.loads(description)
        self._check(spec)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.special_regex = "|".join(r"\Q" + s + r"\E" for s in self.special)
        self.words = regex.compile(r"\n|" + WORDS.replace(r"\s", r"\p{White_Space}"))
        names = {i: s for s, i in (ids | self.special).items()}
        strings = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.names = OffsetTable([s + b" " for s in strings])
        self.decimals = OffsetTable([b"%d " % i for i in range(len(strings))])
        self.count = len(strings)
        reached = self._pairs(ids, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self._automaton({t: s for t, s in self._symbols(ids, model["end_of_word_suffix"]).items() if len(s) == 1 or reached[t]})

    @staticmethod
    def _check(spec: dict) -> None:
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        known = (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and all(model.get(k, v) == v for k, v in plain.items())
            and (spec["normalizer"] or {}).get("normalizers") == NORMALIZER
            and steps == [split, BYTE_LEVEL]
            and spec["decoder"] is None
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError("a tokenizer of another kind than this encoder is for")

    @staticmethod
    def _symbols(ids: dict[str, int], suffix: str) -> dict[int, tuple[int, ...]]:
        """Each token's symbols."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        found = {}
        for s, t in ids.items():
            symbols = [byte[c] for c in s.removesuffix(suffix)]
            if s.endswith(suffix):
                symbols[-1] += LAST
            found[t] = tuple(symbols)
        return found

    def _pairs(self, ids: dict[str, int], merges: list[list[str]]) -> np.ndarray:
        """The tables of merges; whether merging a token's spelling makes the token."""
        self.left = np.arange(self.count)
        self.right = np.arange(self.count)
        self.rank = np.arange(self.count) - self.count
        merged: dict[int, tuple[int, int]] = {}
        first: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            merged.setdefault(ids[a + b], (r, ids[a] * self.count + ids[b]))
            first.setdefault(ids[a] * self.count + ids[b], r)
        for t, (r, pair) in merged.items():
            self.rank[t], (self.left[t], self.right[t]) = r, divmod(pair, self.count)
        self.merges = Table(np.array(list(first), np.int64), np.array(list(first.values())), 1 << 30)
        # Undecided pairs have slots of -1, which no pair has.
        self.pair, self.decision = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        made = np.array(sorted(merged, key=lambda t: self.rank[t]), np.int64)
        kept_apart = self._kept_apart(self.left[made], self.right[made], self.rank[made])
        reached = np.ones(self.count, bool)
        for t, ok in zip(made.tolist(), kept_apart.tolist()):
            reached[t] = ok and reached[self.left[t]] and reached[self.right[t]]
        reached[[t for t in ids.values() if t not in merged]] = False
        return reached

    def _automaton(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """Goto, failure and output of the tokens spelled backwards, level by level, and
        each token's size and longest proper prefix."""
        tokens = np.array(list(symbols), np.int64)
        size = np.array([len(s) for s in symbols.values()])
        if not {(x,) for x in range(2 * LAST)} <= set(symbols.values()):
            raise ValueError("a byte has no token")
        self.size = np.zeros(self.count, np.int64)
        self.size[tokens] = size
        of = {s: t for t, s in symbols.items()}
        self.prefix = np.full(self.count, -1)
        for s, t in of.items():
            self.prefix[t] = next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in of), -1)
        self.longest = int(size.max())
        spelled = np.zeros((len(tokens), self.longest), np.int64)
        for n, s in enumerate(symbols.values()):
            spelled[n, : len(s)] = s[::-1]
        node, nodes, levels = np.zeros(len(tokens), np.int64), 1, []
        for depth in range(self.longest):
            some = np.flatnonzero(size > depth)
            key, of_key = np.unique(node[some] * 2 * LAST + spelled[some, depth], return_inverse=True)
            node[some] = nodes + of_key
            levels.append((key, nodes + np.arange(len(key))))
            nodes += len(key)
        self.goto = Table(np.concatenate([k for k, _ in levels]), np.concatenate([n for _, n in levels]))
        self.failure, self.output = np.zeros(nodes, np.int64), np.full(nodes, -1)
        self.output[node] = tokens
        for key, nodes_here in levels[1:]:
            self.failure[nodes_here] = self._next(self.failure[key // (2 * LAST)], key % (2 * LAST))
            silent = nodes_here[self.output[nodes_here] < 0]
            self.output[silent] = self.output[self.failure[silent]]

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.goto.get(state * 2 * LAST + symbol)
        left = np.flatnonzero((out < 0) & (state > 0))
        state = state[left]
        while len(left):
            state = self.failure[state]
            out[left] = self.goto.get(state * 2 * LAST + symbol[left])
            on = (out[left] < 0) & (state > 0)
            left, state = left[on], state[on]
        return np.maximum(out, 0)

    def _kept_apart(self, left: np.ndarray, right: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank under ``below`` joins symbols of the two tokens
        before the merges that make the tokens themselves; for each pair."""
        out, at = np.ones(len(left), bool), np.arange(len(left))
        while len(at):
            joined = self.merges.get(left * self.count + right) < below
            out[at[joined]] = False
            # Undo the later of the two merges; a merge further left goes first among equals.
            of_left, of_right = self.right[left], self.left[right]
            undo_left = (of_left != left) & ((self.rank[left] > self.rank[right]) | (of_right == right))
            undo_right = ~undo_left & (of_right != right)
            below = np.where(undo_left, self.rank[left], self.rank[right] + 1)
            on = ~joined & (undo_left | undo_right)
            left, right = np.where(undo_left, of_left, left)[on], np.where(undo_right, of_right, right)[on]
            below, at = below[on], at[on]
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens may stand side by side; the decisions are kept in
        slots, of which a later pair takes over an earlier one's."""
        pair = left * self.count + right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, new = self.decision[slot], np.flatnonzero(self.pair[slot] != pair)
        if len(new):
            some, first, of = np.unique(pair[new], return_index=True, return_inverse=True)
            decided = self._kept_apart(some // self.count, some % self.count, np.full(len(some), 1 << 29))
            out[new] = decided[of]
            slot = slot[new[first]]
            self.pair[slot], self.decision[slot] = some, decided
            odd = self.pair[slot] != some  # two of these pairs share a slot
            self.pair[slot[odd]] = -1
        return out

    def _longest(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place of the words.  A long word is read in
        parts, each after the ``longest`` symbols that follow it."""
        size = end - start
        parts = -(-size // SCANNED)
        word = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = start[word] + nth * SCANNED
        high = np.minimum(low + SCANNED + self.longest, end[word])
        order = np.argsort(low - high, kind="stable")
        low, high = low[order], high[order]
        # Parts of at least so many symbols: a prefix of these, which shrinks.
        length = high - low
        at_least = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else []
        out = np.zeros(len(symbols), np.int64)
        state = np.zeros(len(low), np.int64)
        for back, n in enumerate(at_least):
            place = high[:n] - 1 - back
            state[:n] = self._next(state[:n], symbols[place])
            own = place < low[:n] + SCANNED
            out[place[own]] = self.output[state[:n][own]]
        return out

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (none empty) end to end, and where each word's begin and the
        last's end.  All words go forward and back in step."""
        symbols = data.astype(np.int64)
        symbols[end - 1] += LAST
        match = self._longest(symbols, start, end)
        out, dead = np.zeros(len(symbols), np.int64), np.zeros(len(symbols) + 1, bool)
        at, depth, token = start.copy(), np.zeros(len(start), np.int64), match[start]
        live = np.arange(len(start))
        while len(live):
            stuck = live[token[live] < 0]
            dead[at[stuck]] = True
            depth[stuck] -= 1
            last = out[start[stuck] + depth[stuck]]
            at[stuck] -= self.size[last]
            token[stuck] = self.prefix[last]
            live, stuck = live[token[live] >= 0], stuck[token[stuck] < 0]
            now = token[live]
            to = at[live] + self.size[now]
            fits = ~dead[to]
            asked = np.flatnonzero(fits & (depth[live] > 0))
            fits[asked] = self._apart(out[start[live[asked]] + depth[live[asked]] - 1], now[asked])
            yes, no = live[fits], live[~fits]
            out[start[yes] + depth[yes]] = now[fits]
            depth[yes] += 1
            at[yes] = to[fits]
            on = yes[at[yes] < end[yes]]
            token[on] = match[at[on]]
            token[no] = self.prefix[now[~fits]]
            live = np.concatenate([on, no, stuck])
        return out[ranges(start, depth)[0]], np.concatenate([[0], np.cumsum(depth)])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_words``, of distinct pieces of text without ASCII white space."""
        plain = pc.and_(pc.string_is_ascii(pieces), pc.invert(pc.match_substring(pieces, "'")))
        ascii_at, other_at = (pc.indices_nonzero(x).to_numpy() for x in (plain, pc.invert(plain)))
        lower = pc.ascii_lower(pieces.take(pa.array(ascii_at))).cast(pa.large_binary())
        data, offsets = buffers(lower)
        kind = KINDS[data]
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[offsets[:-1]] = True
        begins = np.flatnonzero(cut)
        words_of = np.diff(np.searchsorted(begins, offsets))
        # The others in one text.  Lower case must not depend on a letter's place, as that of
        # a last sigma would.
        joined = "\n".join([*pieces.take(pa.array(other_at)).to_pylist(), ""])
        lowered = unicodedata.normalize("NFC", joined).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}").lower()
        found = pa.array(self.words.findall(lowered), pa.large_string())
        ended = pc.equal(found, "\n")
        more = np.diff(pc.indices_nonzero(ended).to_numpy().astype(np.int64), prepend=-1) - 1
        other, other_ends = buffers(found.filter(pc.invert(ended)).cast(pa.large_binary()))
        ends = np.concatenate([begins, len(data) + other_ends])
        data = np.concatenate([data, other])
        words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        spelled, at = buffers(words.dictionary)
        ids, ends = self._words(spelled, at[:-1], at[1:])
        index = words.indices.to_numpy()
        size = np.diff(ends)[index]
        places, _ = ranges(ends[index], size)
        # Back from words to pieces, in the order of the pieces.
        count = np.zeros(len(pieces), np.int64)
        count[ascii_at], count[other_at] = words_of, more
        first = np.zeros(len(pieces), np.int64)
        first[np.concatenate([ascii_at, other_at])] = np.cumsum([0, *words_of, *more])[:-1]
        id_at = np.concatenate([[0], np.cumsum(size)])
        start = id_at[first]
        at, end = ranges(start, id_at[first + count] - start)
        return ids[places[at]], end

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_column``, of texts without special tokens and nulls."""
        cuts = pc.ascii_split_whitespace(texts)
        pieces = cuts.flatten().dictionary_encode()
        some = pc.not_equal(pieces.dictionary, "")
        ids, at = self._pieces(pieces.dictionary.filter(some))
        sizes = np.zeros(len(pieces.dictionary), np.int64)
        sizes[pc.indices_nonzero(some).to_numpy()] = np.diff(at)
        index = pieces.indices.to_numpy()
        places, end = ranges((np.cumsum(sizes) - sizes)[index], sizes[index])
        return ids[places], end[cuts.offsets.to_numpy() - cuts.offsets[0].as_py()]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the last's
        end): every distinct word is encoded once.  Null is an empty text."""
        texts = pc.fill_null(texts, "")
        if not self.special or not pc.any(pc.match_substring_regex(texts, self.special_regex)).as_py():
            ids, at = self._ordinary(texts)
            return ids.astype("<u4"), at
        # What lies between special tokens is encoded as texts of its own.
        parts, special, of = [], [], []
        for n, text in enumerate(texts.to_pylist()):
            at = 0
            for m in self.special_pattern.finditer(text):
                parts.append(text[at : m.start()])
                special.append(self.special[m[0]])
                at = m.end()
            parts.append(text[at:])
            special.append(-1)
            of += [n] * (len(parts) - len(of))
        ids, ends = self._ordinary(pa.array(parts, pa.string()))
        marks = np.array(special)
        sizes = np.bincount(of, np.diff(ends) + (marks >= 0), len(texts)).astype(np.int64)
        ids = np.insert(ids, ends[1:][marks >= 0], marks[marks >= 0])
        return ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit numbers."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by a space, in UTF-8."""
        return self.names.spell(ids)[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The decimal ids joined by a space."""
        return self.decimals.spell(ids)[:-1]


DIGIT = 1
#: Of each ASCII byte: letter, digit or other, as words are cut between kinds.
KINDS = np.array([2 if chr(b).isalpha() else DIGIT if chr(b).isdigit() else 0 for b in range(128)] + [0] * 128)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a large binary column, and where each begins and the
    last ends."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def model(description: bytes) -> Bpe:
    """The model of this worker for a description; made once."""
    return kept(hashlib.sha256(description).hexdigest(), lambda: Bpe(description))


def described(path: str) -> bytes:
    """A tokenizer's file (some MB at most), which the driver reads and broadcasts."""
    with open(path, "rb") as f:
        return f.read()


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return ``doc_id``, ``n_tokens``,
    ``ids`` (list of ints), ``decoded``.

    A null text is an empty one and has no tokens; repeated rows and null ids stay.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(described(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for batch in batches:
            for part in slices(batch):
                flat, at = bpe.encode_column(part.column(1))
                ids = np.split(flat, at[1:-1])
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([bpe.decode(x).decode() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_and_decode``, with SHA-256 of the decimal ids joined by spaces and of
    the decoded text in place of the two: ids and texts don't leave the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(described(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for batch in batches:
            for part in slices(batch):
                flat, at = bpe.encode_column(part.column(1))
                ids = np.split(flat, at[1:-1])
                columns = [
                    part.column(0),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(bpe.decimal(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(batch: pa.RecordBatch, mb: int = 4) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some MB; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        most = (ends[at - 1] if at else 0) + (mb << 20)
        to = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, to - at)
        at = to
