import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlog.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 25))
def test_fullest_is_the_best_sum(lengths, room):
    counts = {x: lengths.count(x) for x in lengths}
    found = packing.fullest(counts, room)
    best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)
    assert sum(x * k for x, k in found) == best and all(k <= counts[x] for x, k in found)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan(counts, 40)
    at = defaultdict(list)
    for x, n in counts.items():
        s, o = plan.place(np.full(n, x), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist()):
            at[a].append((b, x))
    assert len(at) == plan.sequences and set(at) == set(range(plan.sequences))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(o + x == p for (o, x), (p, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 40


def test_packs_documents(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, "ab cd ef " * (i % 9), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "z " * 64, "x"), (103, "y " * 63, "x"), (103, "y " * 63, "x"), (None, "q r", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, PATH, 32).collect()
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), k // 32, k, len(p := ids[k : k + 32]), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t, _ in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 1]] for k in range(0, len(ids), 32))
    assert sorted((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(s, s[1:])) and sum(s[-1]) <= 32
    assert len(spans) == -(-sum(w[3] for w in want) // 32)
    assert packing.pack_documents(df.limit(0), PATH, 32).count() == 0
