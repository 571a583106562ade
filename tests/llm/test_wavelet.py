import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlog.llm import library_bpe, wavelet
from loomlog.llm.bpe import described
from loomlog.llm.queries import op11_wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = library_bpe.LibraryBpe(described(PATH))


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZ's 0,\n\r\t\x1c\x0b 　  é中́!.|<>")) | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_encodes_as_the_library(texts):
    texts = [*texts, None, "", "a <|endoftext|>b  <|endoftext|>", "x<|endo", "don't  stop\n\n it's"]
    ids, at = BPE.encode_column(pa.array(texts, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [library(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 8, wavelet.BLOCK - 1, wavelet.BLOCK, 3 * wavelet.BLOCK + 17])
def test_matrix_against_the_plain_list(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 1 << 10, n)).astype(np.uint32)
    shard = wavelet.Shard(wavelet.WaveletMatrix.of(ids, 10), pa.array([5, None]), np.array([n, 0]), {"task": 0})
    shard = wavelet.Shard.from_bytes(shard.to_bytes())
    m = shard.matrix
    assert shard.doc_ids.to_pylist() == [5, None] and (m.ids() == ids).all()
    some = rng.integers(0, n, 200) if n else np.zeros(0, np.int64)
    assert (m.access(some) == ids[some]).all()
    for token in [7, 0, 1023, *ids[:3].tolist(), 1024, -1]:
        assert m.count(token) == (ids == token).sum()
        assert m.rank(token, n // 2) == (ids[: n // 2] == token).sum()
        assert (m.occurrences(token) == np.flatnonzero(ids == token)).all()


def test_crc_of_parts():
    a, b = b"abc" * 100, b"xyz" * 33
    assert wavelet.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert wavelet.crc_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def brute(rows):
    """start, n_tokens and CRC of each row, those of one id in any order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_hard_rows_and_lookups(spark, tmp_path):
    rows = [(3, "a b c"), (1, ""), (2, None), (5, "word " * 3000), (None, "no id"), (4, "x"), (4, "x"), (6, "héé 中\n\n<|endoftext|>!")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, start string, task int").repartition(3)
    folder = f"file://{tmp_path}/files"
    files = wavelet.write(docs, folder, PATH, 2, shard_bits=9)
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    want = brute(ordered)
    got = sorted(map(tuple, wavelet.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert max(r.tokens for r in files.collect()) <= 512 and files.count() > 5
    flat = [t for _, text in ordered for t in [*library(text), 2]]
    word = library(" word")[0]
    asked = [word, 2, 50256, 49000]
    assert {r.token: r.n for r in wavelet.counts(spark, folder, asked).collect()} == {t: flat.count(t) for t in asked}
    places = [0, 7, 600, 2000, len(flat) - 1, len(flat)]
    assert {r["at"]: r.token for r in wavelet.tokens_at(spark, folder, places).collect()} == {p: flat[p] for p in places[:-1]}
    found = sorted((r.doc_id, r["at"]) for r in wavelet.occurrences(spark, folder, word).collect())
    assert found == [(5, n) for n, t in enumerate(library("word " * 3000)) if t == word]


def test_documents_without_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, "a b"), (3, None), (4, "")], "doc_id long, text string").coalesce(1)
    for name, some in (("all", docs), ("empty", docs.where("doc_id > 2"))):
        folder = f"file://{tmp_path}/{name}"
        wavelet.write(some, folder, PATH, None)
        got = sorted(map(tuple, wavelet.read(spark, folder).select("doc_id", "start", "n_tokens").collect()))
        assert got == [r for r in [(1, 0, 0), (2, 0, 2), (3, 2, 0), (4, 2, 0)] if name == "all"] or got == [(3, 0, 0), (4, 0, 0)]


def test_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.round_trip(docs, PATH).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(map(tuple, op11_wavelet(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(brute(rows))
