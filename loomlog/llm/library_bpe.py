"""Token ids as the tokenizers library gives them, each distinct piece of text encoded once.

The byte-level pattern of such a description never joins a character that isn't white
space with white space after it, nor an ASCII letter with what follows and isn't a letter.
A text is cut at such places, and the library encodes the distinct pieces of some MB of
texts; ids are then put together again over arrays.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import buffers, ranges
from .shared import kept

BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPACE, LETTER, PLAIN, OTHER = 0, 1, 2, 3
#: Pieces, of some bytes each, that a worker keeps the ids of.
KNOWN = 1 << 20
#: Kinds of bytes: ASCII white space, letters, other printable ASCII, and what may be either.
KINDS = np.array([SPACE if b in b"\t\n\v\f\r " else OTHER if b < 32 or b > 126 else LETTER if chr(b).isalpha() else PLAIN for b in range(256)], np.uint8)


class LibraryBpe:
    """The library's encoder of a description, without its special tokens being added.  Those
    in a text keep their ids, as the library has it."""

    def __init__(self, description: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(description)
        self.library = Tokenizer.from_str(description.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.count = self.library.get_vocab_size(with_added_tokens=True)
        added = spec["added_tokens"]
        odd = any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        #: Any other description has its texts encoded whole.
        self.cuts = spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL and not odd
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self._forget()
        self.arrow_pattern = "|".join(r"\Q" + s + r"\E" for s in names)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        listed = [e.ids for e in found]
        size = np.fromiter(map(len, listed), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(listed), np.uint32, int(size.sum()))
        return ids, np.concatenate([[0], np.cumsum(size)])

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = buffers(texts.cast(pa.large_string()).cast(pa.large_binary()))
        kind = KINDS[data]
        cut = np.zeros(len(data), bool)
        before, now = kind[:-1], kind[1:]
        cut[1:] = (before == LETTER) & ((now == SPACE) | (now == PLAIN)) | (before == PLAIN) & (now == SPACE)
        # After a character beyond ASCII that can't be white space.
        far = np.flatnonzero((before == OTHER) & (now == SPACE) & (data[:-1] >= 0x80)) + 1
        if len(far):
            first = data[np.maximum(far - 2, 0)]
            lead = data[np.maximum(far - 3, 0)]
            may = (first == 0xC2) | np.isin(lead, [0xE1, 0xE2, 0xE3])
            cut[far[~may]] = True
        starts = at[:-1]
        cut[starts[starts < len(data)]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        ids, start, size = self._pieces(pieces.dictionary)
        index = pieces.indices.to_numpy()
        nth, end = ranges(start[index], size[index])
        return ids[nth], end[np.searchsorted(begins, at)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's begin and how many they are.  Pieces of earlier texts are
        known still, up to ``KNOWN`` of them."""
        at = pc.index_in(pieces, self.known) if len(self.known) else pa.nulls(len(pieces), pa.int32())
        new = pc.is_null(at)
        more, places = self._whole(pieces.filter(new).cast(pa.large_string()).to_pylist())
        first = len(self.known)
        self.known = pa.concat_arrays([self.known, pieces.filter(new)])
        self.ids = np.concatenate([self.ids, more])
        self.places = np.concatenate([self.places, self.places[-1] + places[1:]])
        number = at.fill_null(0).to_numpy().astype(np.int64)
        fresh = new.to_numpy(zero_copy_only=False)
        number[fresh] = first + np.arange(np.count_nonzero(fresh))
        found = self.ids, self.places[number], self.places[number + 1] - self.places[number]
        if len(self.known) > KNOWN:
            self._forget()
        return found

    def _forget(self) -> None:
        self.known, self.ids, self.places = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and the last's end.
        Null is an empty text."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return self._whole(texts.to_pylist())
        if not self.special or not pc.any(pc.match_substring_regex(texts, self.arrow_pattern)).as_py():
            return self._ordinary(texts)
        parts, marks, of = [], [], []
        for n, text in enumerate(texts.to_pylist()):
            at = 0
            for m in self.pattern.finditer(text):
                parts.append(text[at : m.start()])
                marks.append(self.special[m[0]])
                at = m.end()
            parts.append(text[at:])
            marks.append(-1)
            of += [n] * (len(parts) - len(of))
        ids, ends = self._ordinary(pa.array(parts, pa.large_string()))
        mark = np.array(marks)
        size = np.bincount(of, np.diff(ends) + (mark >= 0), len(texts)).astype(np.int64)
        return np.insert(ids, ends[1:][mark >= 0], mark[mark >= 0]), np.concatenate([[0], np.cumsum(size)])


def model(description: bytes) -> LibraryBpe:
    """The encoder of this worker for a description; made once."""
    return kept("library" + hashlib.sha256(description).hexdigest(), lambda: LibraryBpe(description))
