"""URL filtering by rules, and by the ratio of two character language models.

A URL that a rule fits gets the rule's verdict.  The others are judged by two smoothed
variable-order Markov models over bytes, learned from all URLs that the rules allow and
block: the difference of the two log-likelihoods, divided by the length, is held
against a threshold that is calibrated on URLs kept out of the learning.

The models are tables: what follows each context, and how often.  They are joined with the
distinct grams of the URLs asked about, and those with the URLs, so that neither the driver
nor a worker holds a model.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .shared import tidy, written

#: (verdict, rule): fixed values.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Bytes of the longest context.
ORDER = 5
#: Of the URLs that rules decide, by a hash, one in CALIBRATE is kept for the threshold.
CALIBRATE = 5
#: Log-likelihoods are summed as whole multiples of 1/UNIT: in any order the same.
UNIT = 1 << 32
#: Grams of a larger share of all than 1/HEAVY are broadcast: HEAVY at most.
HEAVY = 1_024
#: Scores between two whole multiples of 1/BINS are ranked together.
BINS = 1_024
#: Entries of a ratio's memo.
MEMO = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: int) -> Column:
    """The longest rule that fits (``what`` = 1), or its verdict (0); else null.  Rules
    are a short list: each becomes a branch of one expression."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        site, slash, start = rule[1].partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule[what])).otherwise(found)
    return found


class Markov:
    """A model interpolated over orders: a context seen n times with d different bytes
    after it weighs n to d against the next shorter one (Witten and Bell)."""

    def __init__(self, urls: Sequence[str]):
        self.after: dict[bytes, Counter[int]] = defaultdict(Counter)
        for url in urls:
            coded = b"\n" + url.encode()
            for i in range(1, len(coded)):
                for k in range(max(0, i - ORDER), i + 1):
                    self.after[coded[k:i]][coded[i]] += 1
        self.size = {c: sum(s.values()) for c, s in self.after.items()}

    def log_p(self, gram: bytes) -> float:
        p = 1 / 256
        for k in range(len(gram) - 1, -1, -1):
            seen = self.after.get(gram[k:-1])
            if seen is None:
                break
            d = len(seen)
            p = (seen.get(gram[-1], 0) + d * p) / (self.size[gram[k:-1]] + d)
        return log(p)


class Ratio:
    """Allowed against blocked, a byte, with the calibrated threshold: for URLs (``url, verdict,
    part``) that one process can hold, and what ``judge`` is held against."""

    def __init__(self, sample: pd.DataFrame):
        learn = sample[sample["part"] != 0]
        self.models = [Markov(learn.loc[learn["verdict"] == v, "url"].sort_values()) for v in ("allow", "block")]
        self.known = all(m.after for m in self.models)
        self.grams: dict[bytes, float] = {}
        self.threshold = 0.0
        kept = sample[sample["part"] == 0]
        if self.known and kept["verdict"].nunique() == 2:
            self.threshold = self._calibrated(kept)

    def _calibrated(self, kept: pd.DataFrame) -> float:
        """Where the shares of each verdict on its own side are largest together;
        between two scores, and of equal ones the lowest."""
        scores = np.array([self.score(u) for u in kept["url"]])
        allowed = (kept["verdict"] == "allow").to_numpy()
        order = np.argsort(scores, kind="stable")
        scores, allowed = scores[order], allowed[order]
        edges = np.flatnonzero(np.diff(scores, prepend=-np.inf, append=np.inf))
        below = np.concatenate([[0], np.cumsum(~allowed)])[edges] / (~allowed).sum()
        above = 1 - np.concatenate([[0], np.cumsum(allowed)])[edges] / allowed.sum()
        best = edges[np.argmax(below + above)]
        if best in (0, len(scores)):
            return float(scores[0] if best == 0 else scores[-1] + 1)
        return float((scores[best - 1] + scores[best]) / 2)

    def score(self, url: str) -> float:
        coded, total, grams = b"\n" + url.encode(), 0.0, self.grams
        for i in range(1, len(coded)):
            gram = coded[max(0, i - ORDER) : i + 1]
            ratio = grams.get(gram)
            if ratio is None:
                ratio = self.models[0].log_p(gram) - self.models[1].log_p(gram)
                if len(grams) >= MEMO:
                    grams.clear()
                grams[gram] = ratio
            total += ratio
        return total / max(1, len(coded) - 1)

    def judge(self, url: str | None) -> tuple[str, float]:
        if not url or not self.known:
            return "allow", 0.0
        score = self.score(url)
        return ("allow" if score >= self.threshold else "block"), score


def _longest(url: bytes) -> Iterator[bytes]:
    """Of each byte of a URL it and the ``ORDER`` bytes before it."""
    coded = b"\n" + url
    return (coded[max(0, i - ORDER) : i + 1] for i in range(1, len(coded)))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``allowed, url`` to ``gram, a, b``: occurrences in URLs allowed and blocked."""
    for batch in batches:
        for part in slices(batch, 1):
            allowed = part.column(0).to_numpy(zero_copy_only=False)
            urls = part.column(1)
            a, b = (Counter(g for u in urls.filter(pa.array(m)).to_pylist() for g in _longest(u)) for m in (allowed, ~allowed))
            grams = list(a.keys() | b.keys())
            columns = [pa.array(grams, pa.binary()), *(pa.array([c[g] for g in grams], pa.int64()) for c in (a, b))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "a", "b"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``number, url`` to ``number, gram, times``."""
    for batch in batches:
        for part in slices(batch, 1):
            found = [Counter(_longest(u)) for u in part.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(c) for c in found])
            grams, times = [g for c in found for g in c], [n for c in found for n in c.values()]
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(grams, pa.binary()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["number", "gram", "times"])


def contexts(learn: DataFrame) -> DataFrame:
    """Both models of ``allowed, url``: of each context of up to ``ORDER`` bytes how often it is seen
    (``sa``, ``sb``), how many bytes follow it (``da``, ``db``), and how often each does (``after``)."""
    longest = learn.mapInArrow(tidy(_learned), "gram binary, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grams = (
        longest.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("gram"))))
        .groupBy(F.expr("substring(gram, -n)").alias("gram"))
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    # 256 bytes at most follow a context.
    return grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(
        F.sum("a").alias("sa"),
        F.count_if(F.col("a") > 0).alias("da"),
        F.sum("b").alias("sb"),
        F.count_if(F.col("b") > 0).alias("db"),
        F.map_from_entries(F.collect_list(F.struct(_last("gram"), F.struct("a", "b")))).alias("after"),
    )


def _last(gram: str) -> Column:
    return F.conv(F.hex(F.expr(f"substring({gram}, -1)")), 16, 10).cast("int")


def ratios(grams: DataFrame, models: DataFrame) -> DataFrame:
    """Each ``gram`` with ``ratio``, in units: its log-likelihood allowed less that blocked.  As ``Markov``,
    from the shortest context on; contexts not seen change nothing."""
    steps = grams.withColumn("n", F.explode(F.sequence(F.lit(0), F.length("gram") - 1))).withColumn(
        "context", F.expr("substring(gram, length(gram) - n, n)")
    )
    # The 257 contexts of a byte at most are in every gram: broadcast.
    few, short = F.length("context") <= 1, F.col("n") <= 1
    joined = (
        steps.where(short).join(F.broadcast(models.where(few)), "context").unionByName(steps.where(~short).join(models.where(~few), "context"))
    )
    seen = F.try_element_at("after", _last("gram"))
    step = F.struct(
        "n", F.coalesce(seen["a"], F.lit(0)).alias("na"), "sa", "da", F.coalesce(seen["b"], F.lit(0)).alias("nb"), "sb", "db"
    )

    def p(m: str) -> Column:
        def longer(p: Column, x: Column) -> Column:
            return F.when(x["s" + m] > 0, (x["n" + m] + x["d" + m] * p) / (x["s" + m] + x["d" + m])).otherwise(p)

        return F.aggregate("steps", F.lit(1 / 256), longer)

    return (
        joined.groupBy("gram")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .select("gram", F.round((F.ln(p("a")) - F.ln(p("b"))) * UNIT).cast("long").alias("ratio"))
    )


def scores(asked: DataFrame, models: DataFrame) -> DataFrame:
    """``number, score`` of the URLs of ``number, url``."""
    grams = written(asked.mapInArrow(tidy(_asked), "number long, gram binary, times long"))
    needed = written(grams.groupBy("gram").agg(F.count("*").alias("urls")))
    ratio = written(ratios(needed.select("gram"), models))
    most = (needed.agg(F.sum("urls")).first()[0] or 0) / HEAVY
    heavy = needed.where(F.col("urls") > most).select("gram")
    often = grams.join(F.broadcast(ratio.join(F.broadcast(heavy), "gram")), "gram")
    seldom = grams.join(F.broadcast(heavy), "gram", "left_anti").join(ratio, "gram")
    total = often.unionByName(seldom).groupBy("number").agg(F.sum(F.col("times") * F.col("ratio")).alias("total"), F.sum("times").alias("bytes"))
    return total.select("number", (F.col("total") / UNIT / F.col("bytes")).alias("score"))


def threshold(kept: DataFrame) -> float:
    """Of ``score, verdict``: where the shares of each verdict on its own side are largest together;
    between two scores, and of equal ones the lowest.  Without both verdicts 0."""
    a, b = (F.count_if(F.col("verdict") == v) for v in ("allow", "block"))
    each = written(kept.groupBy("score").agg(a.alias("a"), b.alias("b")).withColumn("bin", F.floor(F.col("score") * BINS)))
    bins = each.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    allowed, blocked = bins.agg(F.sum("a"), F.sum("b")).first()
    if not allowed or not blocked:
        return 0.0
    # So many bins as logarithms reach: ranked in one task.  Scores are ranked within their bins.
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = bins.select("bin", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("start_" + c) for c in "ab"))
    within = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col("start_" + c) for c in "ab"}
    parted = (below["b"] * allowed - below["a"] * blocked).alias("parted")
    best = each.join(F.broadcast(start), "bin").select("score", parted).orderBy(F.desc("parted"), "score").first()["score"]
    before = each.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return best if before is None else (before + best) / 2


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    ``score`` is the models' log-likelihood difference a byte, null where a rule
    decides.  A null or empty URL that no rule fits is allowed with score 0, as are all
    such where the rules give no URLs of either verdict to learn from.  Repeated rows
    and null ids stay; other columns are not read.
    """
    url = F.col("url")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = read.withColumns({"host": host_of(url), "path": path_of(url)})
    ruled = parsed.withColumns(
        {"rule": rule_of(F.col("host"), F.col("path"), rules, 1), "verdict": rule_of(F.col("host"), F.col("path"), rules, 0)}
    )
    rows = written(ruled.withColumn("number", F.monotonically_increasing_id()))
    decided, part = F.col("rule").isNotNull(), F.pmod(F.crc32("url"), F.lit(CALIBRATE))
    models = written(
        contexts(rows.where(decided & (part != 0)).select((F.col("verdict") == "allow").alias("allowed"), F.col("url").cast("binary").alias("url")))
    )
    whole = models.where(F.length("context") == 0).first()
    if whole is None or not whole["sa"] or not whole["sb"]:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(~decided, 0.0).alias("score"))
    asked = rows.where((F.length("url") > 0) & (~decided | (part == 0)))
    found = written(scores(asked.select("number", F.col("url").cast("binary").alias("url")), models))
    least = threshold(found.join(rows.where(decided).select("number", "verdict"), "number"))
    score = F.when(~decided, F.coalesce("score", F.lit(0.0)))
    by_models = F.when(F.col("score") < least, "block").otherwise("allow")
    return rows.join(found, "number", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", by_models).alias("verdict"), score.alias("score")
    )
