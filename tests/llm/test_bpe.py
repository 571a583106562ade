import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.model(bpe.described(PATH))


LETTERS = "abcdeinrstoABC ÉßİΣσς' \n\t\x0b\x1c\x85\xa0　123½²٣中ñ́̌J🙂!?-<|>"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(LETTERS, max_size=60), st.text("abcdeinrsto", max_size=80), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't", " the ", "LL'll"])).map("".join)))
def test_equals_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    flat, at = own.encode_column(pa.array(["x", text, None, text]).slice(1))
    assert flat.tolist() == ids * 2 and at.tolist() == [0, len(ids), len(ids), 2 * len(ids)]
    assert own.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_pairs_that_share_a_slot(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIR_BITS", 2)
    few = bpe.Bpe(bpe.described(PATH))
    text = " ".join(f"{a}{b}{c}" for a in ("pre", "un", "over") for b in ("xqz", "thinking", "aaaa") for c in ("ation", "zzz", ""))
    assert np.frombuffer(few.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_are_read_in_parts(library, own):
    rng = random.Random(5)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé中"):
        text = "".join(rng.choices(letters, k=3_000))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_real_texts(library, own):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    flat, at = own.encode_column(texts)
    assert flat.tolist() == [i for e in library.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False) for i in e.ids] and len(at) == len(texts) + 1


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": None}])
def test_other_kinds_are_refused(change):
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(json.loads(bpe.described(PATH)) | change).encode())


def test_operator_on_hard_rows(spark, library):
    long_text = "Überlange wörter " * 40_000 + "x" * 5_000
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "Hello  World", 9), (4, "Hello  World", 9), (None, "a", 9), (5, long_text, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        of = [" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)]
        want.append((i or 0, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in of)))
    assert got == sorted(want)
    full = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in bpe.encode_and_decode(df, PATH).collect()}
    ids = library.encode("Hello  World", add_special_tokens=False).ids
    assert full[4] == (len(ids), ids, library.decode(ids, skip_special_tokens=False)) and full[1] == (0, [], "")
    assert bpe.digests(df.limit(0), PATH).count() == 0
