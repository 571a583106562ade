import random
import re
from math import log
from zlib import crc32

import pandas as pd
import pytest

from loomlog.llm import urls


def brute_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c in urls.UPPER else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    best = None
    for verdict, rule in urls.RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def pages():
    rng = random.Random(2)
    rows = [
        None, "", "com/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "a://b://c.com/", "x://example.com?/en/",
        "x://notexample.com/en/", "x://a.www.example.com/en/", "x://NET/es/\n/é", "x://ÉXAMPLE.net/fr/", "x://e.net/frx", "x://host.org/" + "p" * 30_000,
    ]
    for i in range(400):
        host = rng.choice(["www.example.com", "shop.example.com", "spam-pills.net", "news.org", "cheap-pills.org", "b.net"])
        rows.append(f"https://{host}/{rng.choice(['en', 'es', 'fr'])}/{'pills-buy' if 'pills' in host else 'story'}{i % 50}")
    return list(enumerate(rows)) + [(None, rows[-1]), (3, rows[3])]


def test_rules_hosts_paths_and_verdicts(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages()], "page_id long, url string, host string, verdict int")
    got = urls.judge(df, urls.RULES).collect()
    assert len(got) == len(pages())
    for r in got:
        if r.page_id is None:
            continue
        url = dict(pages())[r.page_id]
        host, path = brute_parse(url)
        assert (r.host, r.path) == (host, path)
        rule = brute_rule(host, path)
        assert (r.rule, r.verdict) == (rule[1], rule[0]) if rule else (r.rule is None and r.verdict in ("allow", "block"))
    assert {r.verdict for r in got if r.host == "cheap-pills.org"} == {"block"}
    assert next(r for r in got if r.page_id == 0).verdict == "allow"
    assert urls.judge(df.limit(0), urls.RULES).count() == 0


def test_likelihoods_match_brute_force():
    learned = ["ab/c", "abc", "b//a"]
    model = urls.Markov(learned)

    def p(context, byte):
        seen = [s[i] for u in learned for s in [b"\n" + u.encode()] for i in range(1, len(s)) if s[:i].endswith(context) and i >= len(context)]
        shorter = p(context[1:], byte) if context else 1 / 256
        return (seen.count(byte) + len(set(seen)) * shorter) / (len(seen) + len(set(seen))) if seen else shorter

    for gram in (b"a", b"\nab", b"ab/c", b"zz", b"bca"):
        assert abs(model.log_p(gram) - log(p(gram[:-1], gram[-1]))) < 1e-12


def test_threshold_parts_the_verdicts():
    sample = pd.DataFrame({"url": [f"good/{i}" for i in range(50)] + [f"bad-{i}" for i in range(50)], "verdict": ["allow"] * 50 + ["block"] * 50, "part": [i % 5 for i in range(100)]})
    ratio = urls.Ratio(sample)
    assert all(ratio.judge(u)[0] == v for u, v in zip(sample["url"], sample["verdict"]))


def test_models_and_threshold_are_of_all_urls(spark):
    rng = random.Random(3)
    mixed = lambda good: rng.choice(["story", "page", "win"] if good else ["win", "bets", "page"])
    rows = []
    for i in range(300):
        good = rng.random() < 0.5
        tail = "/" + "-".join(mixed(good) for _ in range(rng.choice([1, 2, 700]))) + str(i)
        rows += [f"x://{'a.com/en' if good else 'b.net/fr'}{tail}", f"x://c.org/{mixed(good)}é{tail}"]
    rows += rows[:40]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), urls.RULES).collect()
    ruled = [(rows[r.page_id], r.verdict, crc32(rows[r.page_id].encode()) % 5) for r in got if r.rule]
    ratio = urls.Ratio(pd.DataFrame(ruled, columns=["url", "verdict", "part"]))
    assert len(got) == len(rows) and any(len(u) > 2_048 for u, _, part in ruled if part)
    for r in got:
        if r.rule is None:
            verdict, score = ratio.judge(rows[r.page_id])
            assert abs(r.score - score) < 1e-8 and (r.verdict == verdict or abs(score - ratio.threshold) < 1e-8)


@pytest.mark.parametrize("bins", [1, 1_024])
def test_threshold_matches_that_in_memory(spark, monkeypatch, bins):
    monkeypatch.setattr(urls, "BINS", bins)
    rng = random.Random(bins)
    scored = [(rng.choice([0.25, -1.5, rng.gauss(1 if v == "allow" else -1, 1.5)]), v) for v in ("allow", "block") for _ in range(200)]
    ratio = urls.Ratio(pd.DataFrame({"url": [], "verdict": [], "part": []}))
    monkeypatch.setattr(ratio, "score", float)
    want = ratio._calibrated(pd.DataFrame({"url": [s for s, _ in scored], "verdict": [v for _, v in scored]}))
    assert urls.threshold(spark.createDataFrame(scored, "score double, verdict string")) == want
    assert urls.threshold(spark.createDataFrame(scored[:3], "score double, verdict string")) == 0.0
