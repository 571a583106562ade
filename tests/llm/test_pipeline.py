import random
from collections import defaultdict

import corpus_pipeline
from loomlog.llm import simhash
from tests.llm.test_lines import brute_dedup
from tests.llm.test_simhash import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = {"en": "the and of with this that from have which their there would about".split(), "de": "der die und mit nicht eine sich auch nach werden über einen".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        line = lambda: " ".join(rng.choice(words[lang]) + rng.choice(["", "e", "s", "t"]) for _ in range(30))  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(rng.randrange(1, 4))), lang))
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " more", "en"), (102, None, "en"), (103, "1234 !", "de"), (104, "", None), (105, rows[5][1] + "\n" + rows[6][1], None)]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def test_stages_match_brute_force(spark, tmp_path):
    df = spark.createDataFrame(documents(), COLUMNS)
    kept = corpus_pipeline.identify(spark, df, "")
    assert kept.columns == df.columns
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [i for i, _ in rows] == [i for i, t, *_ in documents() if i not in (102, 103, 104)]

    cleaned = corpus_pipeline.clean_lines(spark, kept, "")
    assert cleaned.columns == df.columns
    found = sorted((r.doc_id, r.text) for r in cleaned.collect())
    want = brute_dedup(rows)
    assert found == sorted((i, t) for i, t in want if t) and len(found) < len(want) and all(r.n_chars == len(r.text) for r in cleaned.collect())

    single = corpus_pipeline.near_dedup(spark, cleaned, "")
    assert single.columns == df.columns
    heads = {c for _, c in brute_components(found).values()}
    assert sorted((r.doc_id, r.text) for r in single.collect()) == [x for x in found if x[0] in heads]

    packed = corpus_pipeline.pack(spark, single, "").collect()
    assert {r.doc_id for r in packed} == heads
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 4096 for s in spans.values())


def test_run_chains_the_stages(spark, tmp_path):
    df = spark.createDataFrame(documents(), COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 100 and 105 lose all their lines.
    assert {0, 1, 2} <= got and not {100, 102, 103, 104, 105} & got


def test_hard_rows_and_clashing_columns(spark):
    long_text = "\n".join(f"the lazy dog number {i} and the quick fox {i * i} ran" for i in range(20_000))
    clean = [(i, f"the fox number {i} of {i * 7} saw the dog and that was all of the story {i + 3}", "en") for i in range(30)]
    rows = clean + [(None, "a row without an id about the dog and the fox", "en"), (None, "another row without one, about a cat", "en"), (3, "an id again with other words, for the fox", "en"), (900, long_text, "en"), clean[4], (901, None, "en"), (902, "", None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, __id long, __th string, __text string, __own int, lines_dropped int, number int, component string, bits double"
    docs = spark.createDataFrame([(i, t, x, "s", 0, 7, "th", "mine", 5, 6, 8, "c", 0.5) for i, t, x in rows], names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
    got = docs.collect()
    assert {(r["__id"], r["__th"], r["__text"], r["__own"], r.number, r.component, r.bits) for r in got} == {(7, "th", "mine", 5, 8, "c", 0.5)}
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == sorted([-1, -1, 3, 900, *range(30)])
    assert next(r.text for r in got if r.doc_id == 900).startswith("the lazy dog number 0")
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r.length for r in packed if r.doc_id == 900) > 100_000 and len({(r.doc_id, r.piece, r.ids_crc32) for r in packed}) == len(packed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_near_dedup_finds_jaccard_of_five_words(spark):
    rng = random.Random(6)
    texts = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 12):
            copy = list(base)
            for n in rng.sample(range(200), changes):
                copy[n] += "x"
            texts.append(" ".join(copy))
    shingled = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if x == old else x for x in group]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert got == set(group) and len(got) < len(texts)


def test_near_dedup_links_fingerprints_within_three_bits(spark):
    # Long runs that repeat outweigh ten words that differ in a SimHash, but not in sets of shingles.
    runs = [" ".join(f"g{g}w{i}" for i in range(10)) for g in range(4)]
    texts = [" ".join([run] * 60 + [f"g{g}c{c}x{i}" for i in range(10)]) for g, run in enumerate(runs) for c in range(3)]
    # Fingerprints of a chain of few bits, some equal.
    labels = brute_components(list(enumerate(texts)))
    heads = {label for _, label in labels.values()}
    assert not any(simhash.similar(a, b) for i, a in enumerate(texts) for b in texts[:i])
    assert len(heads) < len(texts) and len({fp for fp, _ in labels.values()}) > len(heads)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert got == heads
