import random
import zlib
from math import log2

import numpy as np
import pyarrow as pa
import pytest

from loomlog.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then runs through the green field with other animals"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch das grüne feld mit anderen tieren"


def documents(n=160):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang, words = rng.choice([("en", EN.split()), ("de", DE.split())])
        rows.append((i, " ".join(rng.choice(words) for _ in range(12)), lang))
    return rows


def brute_bits(learned, text):
    """PPM over the bytes of the learned texts, as written in the module's text."""
    seen = {}
    for s in map(str.encode, learned):
        for i in range(len(s)):
            for k in range(max(0, i - langid.ORDER), i + 1):
                seen.setdefault(s[k:i], []).append(s[i])
    bits = 0.0
    s = text.encode()
    for i in range(len(s)):
        out = set()
        for k in range(max(0, i - langid.ORDER), i + 1):
            after = [x for x in seen.get(s[k:i], []) if x not in out]
            d = len(set(after))
            if s[i] in after:
                bits -= log2(after.count(s[i]) / (len(after) + d))
                break
            if d:
                bits -= log2(d / (len(after) + d))
            out |= set(after)
        else:
            bits += log2(256 - len(out))
    return bits


@pytest.mark.parametrize("costs", [0, 100, 1_000_000])
def test_code_lengths_match_brute_force(spark, monkeypatch, costs):
    monkeypatch.setattr(langid, "COSTS", costs)
    df = spark.createDataFrame(documents(40), "doc_id long, text string, lang string")
    model = langid.Model(langid.learn(df))
    learned = {lang: [t for i, t, x in documents(40) if x == lang and zlib.crc32(str(i).encode()) % 4 != 2] for lang in ("de", "en")}
    texts = ["", "the fox", "Hund über  99", None, "zzz qqq!\n the", "der faulen hund"]
    got = model.code_lengths(pa.array(texts))
    want = [[brute_bits(learned[x], t or "") for x in ("de", "en")] for t in texts]
    assert np.allclose(got, want)


def test_languages_of_few_or_long_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 200)
    rows = [(i, t, lang) for i, t, lang in documents(60)] + [(1000, "zz yy xx " * 40, "zz"), (1001, "zz yy xx zz " * 30, "zz")]
    rows += [(2000 + i, f"q{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i}") for i in range(80) if zlib.crc32(str(2000 + i).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.learn(df)
    assert set(counts["lang"]) == {r[2] for r in rows}
    got = {r.doc_id: r.lang_pred for r in langid.predict(df).collect()}
    assert all(got[i] == lang for i, _, lang in rows if i >= 1000)


def test_ties_go_to_the_first_by_name(spark):
    df = spark.createDataFrame([(1, "abc abc", "b"), (3, "abc abc", "a"), (5, "abc", None)], "doc_id long, text string, lang string")
    assert {zlib.crc32(str(i).encode()) % 4 for i in (1, 3)}.isdisjoint({2})
    assert {(r.lang_pred, r.score) for r in langid.predict(df).collect()} == {("a", 0.5)}


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(8)
    odd = [(5000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=400)), None) for i in range(5)]
    odd += [(6000, "これは日本語の文章であり、学習された言語ではありません。" * 5, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in documents() + odd + [(7000, "Hund!", None)]], "doc_id long, text string, lang string, __found string, found int")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["__found"] for r in kept.collect()} == {"x"}
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in documents()} | {7000}


def test_predicts_held_out_rows_and_defines_hard_ones(spark):
    rows = documents() + [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "the fox " * 60_000, None), (None, "der hund", "en"), (5, "the dog", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, found string")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None)
    truth = {i: lang for i, _, lang in documents()}
    held = [i for i in truth if got[i].held_out and i != 5]
    assert len(held) > 20 and all(got[i].lang_pred == truth[i] for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0
    assert langid.predict(df).count() == len(rows)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0)).count() == 0


def test_grams():
    grams, at = langid.grams_of(pa.array(["abcdef", "", "é"]))
    tag = langid.LENGTH
    spelled = [g.to_bytes(8, "big")[-1 - (g >> tag) :] for g in grams.tolist()]
    assert spelled == [b"a", b"ab", b"abc", b"abcd", b"abcde", b"bcdef", b"\xc3", b"\xc3\xa9"] and at.tolist() == [0, 6, 6, 8]
