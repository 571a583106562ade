"""A trie of rebuilt conversations by composable fingerprints of their prefixes.

A run of turns has a fingerprint ``(sum of x_i p^i, length)`` modulo a prime, with ``x_i``
from the SHA-256 of turn ``i``; two runs compose to ``(A + p^a B, a + b)``, so what a
conversation's turns after the first h give follows from two of its running sums, and, put
behind the head of another conversation, from one product.  So every prefix of every rebuilt
conversation is told from stored sums of original turns: no text is moved or put together.
Four sums with different bases, each modulo 2^31 - 1, make a fingerprint of 124 bits.

Prefixes of equal depth and fingerprint are a node.  Each has the digest of its last turn
from where the original turn is stored, and its parent's fingerprint; a node whose members
differ in either is an error, never a wrong row.  By induction over the depth, members
of a node have equal turns.

The smallest member owns a node, so a conversation owns a run of depths down to its end.
With the depth where this begins, counts over whole subtrees are sums over members:

* children: members that own a node one deeper,
* leaves: members that own a node that none goes beyond,
* saved tokens: all words below, counted for each member, without those counted once for
  the owner: the words from the node's depth to where the member's own nodes begin.

The running sums of one conversation may take many tasks: turns are dealt in ranges of
conversation and turn, and the sums at the ends of the ranges, two a task, are composed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table_rows, tidy, written

PRIME = (1 << 31) - 1
#: Bases of the four sums: fixed numbers below the prime.
BASES = (1_414_213_562, 1_732_050_807, 2_000_000_089, 1_123_581_321)
LANES = range(len(BASES))
#: Turns of a head at most, and conversations that share one.
HEAD, SHARED = 3, 20
#: Conversation ids of a node that are joined to one text.
CHUNK = 4096
WORDS = r"[^\x20\x09-\x0D]+"

SUMS = "part int, row long, conv_id long, nth long, words long, w long, v0 long, v1 long, " + ", ".join(f"g{k} long, b{k} long" for k in LANES)
NODE = ["depth", "fa", "fb"]


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base up to 2^16, and those of its power 2^16."""

    def table(b: int) -> np.ndarray:
        out = np.ones(1 << 16, np.int64)
        for bit in range(16):
            n = 1 << bit
            out[n : 2 * n] = out[:n] * pow(b, n, PRIME) % PRIME
        return out

    return table(base), table(pow(base, 1 << 16, PRIME))


class _Running:
    """Running sums over turns in order, begun anew for each conversation."""

    def __init__(self) -> None:
        self.tables = [_powers(b) for b in BASES]
        self.conv, self.nth, self.w, self.row = None, 0, 0, 0
        self.g = [0 for _ in LANES]

    def add(self, part: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        conv, words = batch.column("conv_id").to_numpy(), batch.column("words").to_numpy()
        digest = batch.column("digest")
        raw = np.frombuffer(digest.buffers()[2], np.uint8)[32 * digest.offset :][: 32 * len(conv)].reshape(-1, 32)
        first = np.append(True, conv[1:] != conv[:-1])
        goes_on = self.conv is not None and conv[0] == self.conv
        at = np.flatnonzero(first)
        of = np.cumsum(first) - 1  # the conversation's number in this batch
        before = np.where((of == 0) & goes_on, self.nth, 0)
        nth = np.arange(len(conv)) - at[of] + 1 + before

        def running(x: np.ndarray, carried: int) -> np.ndarray:
            sums = np.cumsum(x)
            return sums - (sums[at] - x[at])[of] + np.where((of == 0) & goes_on, carried, 0)

        w = running(words, self.w)
        out = {"nth": nth, "words": words, "w": w}
        out |= {f"v{k}": np.ascontiguousarray(raw[:, 16 + 8 * k : 24 + 8 * k]).view("<i8")[:, 0] for k in range(2)}
        for k in LANES:
            low, high = self.tables[k]
            x = np.ascontiguousarray(raw[:, 4 * k : 4 * k + 4]).view("<u4")[:, 0].astype(np.int64) % PRIME
            term = x * (low[nth & 0xFFFF] * high[nth >> 16] % PRIME) % PRIME
            g = running(term, self.g[k]) % PRIME
            out[f"g{k}"], out[f"b{k}"] = g, (g - term) % PRIME
            self.g[k] = int(g[-1])
        rows = np.arange(self.row, self.row + len(conv))
        self.conv, self.nth, self.w, self.row = conv[-1], int(nth[-1]), int(w[-1]), self.row + len(conv)
        columns = {"part": np.full(len(conv), part, np.int32), "row": rows, "conv_id": conv} | out
        names = [f.split()[0] for f in SUMS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names)


def sums(turns: DataFrame) -> DataFrame:
    """``conv_id, nth, words, w, v0, v1, g0.., b0..`` of every turn: its number in its conversation
    (from 1), words up to it, half of its digest, and the sums up to and before it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("uid"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("uid")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, running = TaskContext.get().partitionId(), _Running()
        for batch in batches:
            if batch.num_rows:
                yield running.add(part, batch)

    # Bounds are sampled, which would hash all turns twice.
    dealt = written(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "words", "digest")
    local = written(dealt.mapInArrow(tidy(run), SUMS))
    carried = F.broadcast(_carried(local))
    mine = F.col("conv_id").eqNullSafe(F.col("__conv"))

    def joined(c: str, k: int) -> Column:
        return F.when(mine, (F.col(f"__g{k}") + F.col(f"__p{k}") * F.col(c)) % PRIME).otherwise(F.col(c)).alias(c)

    return local.join(carried, "part").select(
        "conv_id",
        (F.col("nth") + F.when(mine, F.col("__nth")).otherwise(0)).alias("nth"),
        "words",
        (F.col("w") + F.when(mine, F.col("__w")).otherwise(0)).alias("w"),
        "v0",
        "v1",
        *(joined(f"{c}{k}", k) for k in LANES for c in "gb"),
    )


def _carried(local: DataFrame) -> DataFrame:
    """For each task what its first conversation has in the tasks before it: a row a task."""
    last = [F.max_by(c, "row").alias(c) for c in ("conv_id", "nth", "w", *(f"g{k}" for k in LANES))]
    ends = local.groupBy("part").agg(F.min_by("conv_id", "row").alias("first"), *last).collect()
    rows, conv, nth, w, g = [], None, 0, 0, [0 for _ in LANES]
    for r in sorted(ends, key=lambda r: r.part):
        if conv != r.first:
            conv, nth, w, g = None, 0, 0, [0 for _ in LANES]
        power = [pow(b, nth, PRIME) for b in BASES]
        rows.append((r.part, conv, nth, w, *g, *power))
        more = [r[f"g{k}"] for k in LANES]
        if conv == r.conv_id:
            nth, w, g = nth + r.nth, w + r.w, [(a + p * b) % PRIME for a, p, b in zip(g, power, more)]
        else:
            conv, nth, w, g = r.conv_id, r.nth, r.w, more
    names = ["__nth", "__w", *(f"__g{k}" for k in LANES), *(f"__p{k}" for k in LANES)]
    return local.sparkSession.createDataFrame(rows, "part int, __conv long, " + ", ".join(f"{n} long" for n in names))


def _packed(lanes: Sequence[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31) + lanes[1], F.shiftleft(lanes[2], 31) + lanes[3]


def _picked(number: Column, values: Sequence[Column | int]) -> Column:
    """The value of a small number from 0."""
    out = F.lit(values[-1]) if isinstance(values[-1], int) else values[-1]
    for n in range(len(values) - 2, -1, -1):
        out = F.when(number == n, values[n]).otherwise(out)
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: ``conv_id, depth, fa, fb`` (fingerprint), ``pa, pb``
    (that of the parent), ``v0, v1`` (of the last turn), ``ref_conv_id, ref_nth`` (where that is stored),
    ``before, total`` (words before the last turn and of the whole), ``len``."""
    original = written(sums(turns))
    heads = [F.max(F.when(F.col("nth") == k, F.col(c))).alias(f"{c}_{k}") for k in range(1, HEAD + 1) for c in ("w", "v0", "v1", *(f"g{j}" for j in LANES))]
    convs = original.groupBy("conv_id").agg(F.max("nth").alias("n"), F.max("w").alias("words_all"), *heads)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("__n"), *(F.col(c).alias(f"__{c}") for c in convs.columns if "_" in c and c[-1].isdigit()))
    wanted = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    kept = F.least(F.col("h"), F.coalesce("__n", F.lit(0)))
    zero = F.lit(0).cast("long")

    def at(name: str, prefix: str, number: str) -> Column:
        return F.coalesce(_picked(F.col(number), [zero, *(F.col(f"{prefix}{name}_{k}") for k in range(1, HEAD + 1))]), zero)

    joined = (
        convs.withColumns({"h": wanted, "base": F.col("conv_id") - F.col("conv_id") % SHARED})
        .join(bases, "base", "left")
        .withColumns({"kept": kept, "own": F.least("h", "n")})
        .withColumn("len", F.col("kept") + F.greatest(F.col("n") - F.col("h"), zero))
        .withColumn("total", at("w", "__", "kept") + F.col("words_all") - at("w", "", "own"))
    )
    convs = written(joined)
    # Turns after the first h, behind the head.
    suffix = convs.where("n > h").select(
        "conv_id", "h", "len", "total", (F.col("kept") - F.col("h")).alias("shift"), (at("w", "__", "kept") - at("w", "", "own")).alias("dw"),
        *(at(f"g{k}", "__", "kept").alias(f"H{k}") for k in LANES), *(at(f"g{k}", "", "own").alias(f"O{k}") for k in LANES),
    )

    def composed(c: str) -> list[Column]:
        return [
            (F.col(f"H{k}") + (F.col(f"{c}{k}") - F.col(f"O{k}") + PRIME) % PRIME * _picked(-F.col("shift"), [pow(BASES[k], -s, PRIME) for s in range(HEAD + 1)])) % PRIME
            for k in LANES
        ]

    (fa, fb), (pa_, pb) = _packed(composed("g")), _packed(composed("b"))
    own = original.join(suffix, "conv_id").where("nth > h").select(
        "conv_id", (F.col("nth") + F.col("shift")).alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"), "v0", "v1",
        F.col("conv_id").alias("ref_conv_id"), F.col("nth").alias("ref_nth"), (F.col("w") - F.col("words") + F.col("dw")).alias("before"), "total", "len",
    )
    # The root and the turns of the head.
    steps = []
    for d in range(HEAD + 1):
        here, above = ([F.col(f"__g{k}_{n}") if n else zero for k in LANES] for n in (d, max(d - 1, 0)))
        (fa, fb), (pa_, pb) = _packed(here), _packed(above)
        v0, v1 = (F.col(f"__{v}_{d}") if d else zero for v in ("v0", "v1"))
        before = F.col(f"__w_{d - 1}") if d > 1 else zero
        one = F.struct(
            F.lit(d).cast("long").alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"), v0.alias("v0"), v1.alias("v1"),
            F.when(F.lit(d > 0), F.col("base")).alias("ref_conv_id"), F.when(F.lit(d > 0), F.lit(d).cast("long")).alias("ref_nth"), before.alias("before"),
        )
        steps.append(F.when(F.col("kept") >= d, one))
    head = convs.select("conv_id", F.explode(F.array_compact(F.array(*steps))).alias("s"), "total", "len").select("conv_id", "s.*", "total", "len")
    return own.unionByName(head)


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from rows ``conv_id, turn, role, text``.

    A conversation's turns are in the order of ``turn`` (null first), equal ones by digest; null
    roles and texts are empty.  Conversation c has the first h turns of conversation c - c % 20, then its own
    after the first h, with h the CRC-32 of its decimal id modulo 4.  Rows without a ``conv_id``
    belong to no conversation; repeated rows are turns of their own; other columns aren't read; without a
    conversation there is no node.

    Columns: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``, and where the last turn is stored: ``ref_conv_id, ref_nth``."""
    rows = written(prefixes(turns))
    same = F.lit(True)
    for c in ("v0", "v1", "pa", "pb"):
        same = same & (F.min(c) == F.max(c))
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("len").alias("longest"), F.max("before").alias("before"), same.alias("same"))
    nodes = nodes.withColumn("owner", F.when(F.col("same"), F.col("owner")).otherwise(F.raise_error(F.lit("two prefixes share a fingerprint"))))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("from"), F.min("before").alias("until"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")
    )
    depth, begins = F.col("depth"), F.coalesce("from", F.col("len") + 1)
    counted = (
        rows.join(owned, "conv_id", "left")
        .withColumns(
            {
                "from": begins,
                "child": ((begins <= depth + 1) & (depth < F.col("len"))).cast("long"),
                "saves": F.when(depth < begins, F.coalesce("until", "total") - F.col("before")).otherwise(0),
            }
        )
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.min_by("from", "conv_id").alias("from"),
            F.min_by("ref_conv_id", "conv_id").alias("ref_conv_id"),
            F.min_by("ref_nth", "conv_id").alias("ref_nth"),
            F.max("pa").alias("pa"),
            F.max("pb").alias("pb"),
            F.count("*").alias("n_convs"),
            F.sum("child").alias("n_children"),
            F.sum(F.coalesce(F.col("leaf"), F.lit(0)).cast("long")).alias("n_leaves"),
            F.sum("saves").alias("saved_tokens"),
        )
    )
    counted = written(counted)
    # A node's parent has another owner only where its owner's nodes begin.
    root = counted.where("depth = 0").select(F.col("conv_id").alias("root"))
    top = (F.col("from") == depth) & (depth > 1)
    above = counted.where("depth > 0 and n_children > 0").select((depth + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("above"))
    tops = counted.where(top).join(above, ["depth", "pa", "pb"])
    others = counted.where(~top).join(F.broadcast(root)).withColumn("above", F.when(depth == 1, F.col("root")).when(depth > 1, F.col("conv_id"))).drop("root")
    every = tops.unionByName(others).join(ends(rows), NODE, "left")
    return every.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "ref_conv_id",
        "ref_nth",
    )


def ends(rows: DataFrame) -> DataFrame:
    """``depth, fa, fb, ends_sha256`` of the nodes where conversations end.  A hash takes its bytes
    in order, so the ids of a node are joined to texts of some thousands by many tasks,
    and only these, in order, pass through one."""
    last = rows.where("depth = len").select(*NODE, "conv_id")
    schema = "depth long, fa long, fb long, first long, text string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for d, fa, fb, c in zip(*(batch.column(n).to_pylist() for n in (*NODE, "conv_id"))):
                if held and (node != (d, fa, fb) or len(held) == CHUNK):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = (d, fa, fb)
                held.append(c)
            yield from table_rows(schema, out)
            out = []
        if held:
            yield from table_rows(schema, [(*node, held[0], ",".join(map(str, held)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for d, fa, fb, text in zip(*(batch.column(n).to_pylist() for n in (*NODE, "text"))):
                if node == (d, fa, fb):
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, fa, fb), hashlib.sha256()
                sha.update(text.encode())
            yield from table_rows("depth long, fa long, fb long, ends_sha256 string", out)
        if node:
            yield from table_rows("depth long, fa long, fb long, ends_sha256 string", [(*node, sha.hexdigest())])

    texts = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, schema)
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, fa long, fb long, ends_sha256 string")


def trie_sql() -> str:
    """The same in DuckDB's SQL: prefixes as texts, subtrees by joins of members."""
    byte = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return rf"""
WITH RECURSIVE tab AS (SELECT {byte} AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT c.conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns) c, tab
),
rebuilt AS (
  SELECT c.conv_id, t.nth, 0 AS own, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.nth <= c.h
  UNION ALL SELECT c.conv_id, t.nth, 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.nth > c.h
),
deep AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, nth ROWS UNBOUNDED PRECEDING)
),
pre AS (
  SELECT conv_id, 0 AS depth, 0 AS words, 'root' AS node FROM convs UNION ALL SELECT conv_id, depth, words, node FROM deep
),
size AS (SELECT conv_id, max(depth) AS len FROM pre GROUP BY 1),
nodes AS (
  SELECT p.node, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, max(len) AS longest,
    coalesce(string_agg(CASE WHEN len = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '') AS ends
  FROM pre p JOIN size s ON p.conv_id = s.conv_id GROUP BY 1, 2
),
below AS (
  SELECT DISTINCT a.node AS top, b.node, n.depth - a.depth AS down, n.n_convs, n.words, n.longest = n.depth AS leaf
  FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND b.depth >= a.depth JOIN nodes n ON n.node = b.node
),
up AS (SELECT DISTINCT a.node, b.node AS parent FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, sha256(n.ends) AS ends_sha256,
  CASE WHEN n.depth > 0 THEN r.ref_conv_id END AS ref_conv_id, CASE WHEN n.depth > 0 THEN r.ref_nth END AS ref_nth
FROM nodes n LEFT JOIN up u ON u.node = n.node LEFT JOIN nodes p ON p.node = u.parent
JOIN (SELECT top, count(*) FILTER (WHERE down = 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM below GROUP BY 1) b ON b.top = n.node
LEFT JOIN (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, nth) AS depth, CASE WHEN own = 1 THEN conv_id ELSE conv_id - conv_id % 20 END AS ref_conv_id, nth AS ref_nth FROM rebuilt
) r ON r.conv_id = n.conv_id AND r.depth = n.depth"""
