"""The same queries in DuckDB's SQL."""

from __future__ import annotations

_HASH = (
    "'sha256:' || sha256('{\"row\":{\"event_type\":' || coalesce('\"' || col_type || '\"', 'null') || ',\"user_id\":' || "
    "CAST(user_id AS VARCHAR) || '},\"table\":\"user_state\",\"type\":\"putRow\"}')"
)

_WITH = f"""
WITH raw AS (
  SELECT 's' || CAST(user_id % 10 AS VARCHAR) AS stream_id, 'c' || CAST(user_id AS VARCHAR) AS client_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS client_sequence,
    'op-' || CAST(event_id AS VARCHAR) AS operation_id, ts, event_id, user_id, event_type,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS col_type,
    CASE WHEN event_type = 'error' THEN 'deleteRow' ELSE 'putRow' END AS op
  FROM events
),
prop AS (SELECT *, {_HASH} AS intent_hash FROM raw),
judged AS (
  SELECT *, CASE WHEN op = 'putRow' AND col_type IS NULL THEN 'invalid-row-operation' END AS reason FROM prop
),
log AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) AS sequence
  FROM judged WHERE reason IS NULL
),
dec AS (
  SELECT j.*, CASE WHEN j.reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, l.sequence
  FROM judged j LEFT JOIN log l ON j.operation_id = l.operation_id
),
head AS (SELECT stream_id, max(sequence) AS head_sequence, CAST(floor(max(sequence) * 6 / 10) AS BIGINT) AS confirmed_sequence FROM log GROUP BY 1),
outbox AS (
  SELECT l.*, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'accepted' END AS status
  FROM log l JOIN head h ON l.stream_id = h.stream_id WHERE sequence > confirmed_sequence
),
next_page AS (
  SELECT l.* FROM log l JOIN head h ON l.stream_id = h.stream_id
  WHERE sequence > confirmed_sequence AND sequence <= confirmed_sequence + 256
),
last AS (SELECT *, row_number() OVER (PARTITION BY stream_id, user_id ORDER BY sequence DESC) AS nth FROM log),
attempt AS (
  SELECT stream_id, operation_id, client_id, client_sequence, intent_hash, event_id FROM prop WHERE event_id % 2 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence, 'changed', event_id FROM prop WHERE event_id % 101 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence + 1, intent_hash, event_id FROM prop WHERE event_id % 103 = 0
  UNION ALL SELECT stream_id, operation_id || '-x', client_id, client_sequence, intent_hash, event_id FROM prop WHERE event_id % 107 = 0
  UNION ALL SELECT stream_id, operation_id || '-y', client_id || '-n', client_sequence, intent_hash, event_id FROM prop WHERE event_id % 109 = 0
),
classed AS (
  SELECT a.operation_id, CASE
    WHEN d.operation_id IS NOT NULL AND (d.client_id <> a.client_id OR d.client_sequence <> a.client_sequence) THEN 'operation-identity-conflict'
    WHEN d.operation_id IS NOT NULL AND d.intent_hash <> a.intent_hash THEN 'operation-intent-conflict'
    WHEN d.operation_id IS NOT NULL THEN 'replay'
    WHEN p.operation_id IS NOT NULL THEN 'client-sequence-conflict' ELSE 'new' END AS class
  FROM attempt a
  LEFT JOIN dec d ON a.stream_id = d.stream_id AND a.operation_id = d.operation_id
  LEFT JOIN dec p ON a.stream_id = p.stream_id AND a.client_id = p.client_id AND a.client_sequence = p.client_sequence
)
"""

_STATE = "stream_id, user_id, sequence, event_type, intent_hash"


def _boot(prefix: str, tables: list[str]) -> str:
    def quoted(c: str) -> str:
        return f"'\"{c}\":' || to_json({c})"

    def number(c: str) -> str:
        return f"'\"{c}\":' || coalesce(regexp_replace(CAST({c} AS VARCHAR), '\\.0$', ''), 'null')"

    columns = {
        "customer": (["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"]),
        "nation": (["n_name"], ["n_nationkey", "n_regionkey"]),
        "part": (["p_name", "p_brand", "p_type"], ["p_partkey", "p_size", "p_retailprice"]),
        "region": (["r_name"], ["r_regionkey"]),
        "supplier": (["s_name"], ["s_suppkey", "s_nationkey", "s_acctbal"]),
    }
    parts = []
    for t in tables:
        text, whole = columns[t]
        members = " || ',' || ".join(quoted(c) if c in text else number(c) for c in sorted(text + whole))
        parts.append(
            f"SELECT '{t}' AS table_name, '[' || CAST({whole[0]} AS VARCHAR) || ']' AS pk, "
            f"'{{\"row\":{{' || {members} || '}},\"table\":\"{t}\",\"type\":\"putRow\"}}' AS operation FROM {t}"
        )
    return (
        f"WITH op AS ({' UNION ALL '.join(parts)}) SELECT CAST(row_number() OVER (ORDER BY table_name, pk) AS BIGINT) AS sequence, table_name, pk, operation, "
        f"'{prefix}:' || table_name || ':' || sha256('{{\"key\":' || pk || ',\"table\":\"' || table_name || '\"}}') AS operation_id, "
        "'sha256:' || sha256(operation) AS intent_hash FROM op"
    )


_ALL = ["customer", "nation", "part", "region", "supplier"]
_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_LINE_DESC = ", ".join(f"{c} DESC" for c in _LINE.split(", "))
_PAGES = """cut AS (
  SELECT stream_id, CAST(floor((sequence - 1) / 256) AS BIGINT) AS page, min(sequence) AS first_sequence, max(sequence) AS last_sequence,
    count(*) AS entries, count(DISTINCT sequence) AS distinct_sequences FROM {log} GROUP BY 1, 2
),
page AS (
  SELECT c.*, m.head_sequence, c.page * 256 AS base_sequence, least(m.head_sequence, (c.page + 1) * 256) AS through_sequence
  FROM cut c JOIN (SELECT stream_id, max(last_sequence) AS head_sequence FROM cut GROUP BY 1) m ON c.stream_id = m.stream_id
)"""

_ATOMIC = """, batch AS (
  SELECT stream_id, operation_id, client_id, client_sequence, intent_hash, event_id, 0 AS variant FROM prop WHERE event_id % 2 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence, 'changed', event_id, 1 FROM prop WHERE event_id % 101 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence + 1, intent_hash, event_id, 2 FROM prop WHERE event_id % 103 = 0
  UNION ALL SELECT stream_id, operation_id || '-x', client_id, client_sequence, intent_hash, event_id, 3 FROM prop WHERE event_id % 107 = 0
  UNION ALL SELECT stream_id, operation_id || '-y', client_id || '-n', client_sequence, intent_hash, event_id, 4 FROM prop WHERE event_id % 109 = 0
), known AS (SELECT * FROM dec WHERE event_id % 5 = 0),
a AS (
  SELECT b.*, CAST(regexp_extract(b.client_id, '^c(\\d+)', 1) AS INTEGER) AS u, b.client_id || '-' || variant || '-' || CAST(b.client_sequence // 8 AS VARCHAR) AS request_id, d.status, d.sequence, CASE
    WHEN d.operation_id IS NOT NULL AND (d.client_id <> b.client_id OR d.client_sequence <> b.client_sequence) THEN 'operation-identity-conflict'
    WHEN d.operation_id IS NOT NULL AND d.intent_hash <> b.intent_hash THEN 'operation-intent-conflict'
    WHEN d.operation_id IS NOT NULL THEN 'replay' WHEN p.operation_id IS NOT NULL THEN 'client-sequence-conflict' ELSE 'new' END AS class
  FROM (SELECT * FROM batch WHERE {keep}) b LEFT JOIN known d ON b.stream_id = d.stream_id AND b.operation_id = d.operation_id
  LEFT JOIN known p ON b.stream_id = p.stream_id AND b.client_id = p.client_id AND b.client_sequence = p.client_sequence
), r AS (
  SELECT stream_id, request_id, row_number() OVER (PARTITION BY stream_id ORDER BY min(event_id * 8 + variant)) AS n, bool_or(class LIKE '%conflict' OR {late}) AS lost
  FROM a GROUP BY 1, 2
), b AS (SELECT a.*, r.n, r.lost FROM a JOIN r ON a.stream_id = r.stream_id AND a.request_id = r.request_id),
clash AS (
  SELECT DISTINCT x.stream_id, x.n, y.n AS other FROM b x JOIN b y ON x.stream_id = y.stream_id AND y.n < x.n AND x.class = 'new' AND y.class = 'new' AND NOT x.lost AND NOT y.lost
    AND x.operation_id = y.operation_id AND (x.client_id, x.client_sequence, x.intent_hash) <> (y.client_id, y.client_sequence, y.intent_hash)
  UNION SELECT DISTINCT x.stream_id, x.n, y.n FROM b x JOIN b y ON x.stream_id = y.stream_id AND y.n < x.n AND x.class = 'new' AND y.class = 'new' AND NOT x.lost AND NOT y.lost
    AND x.client_id = y.client_id AND x.client_sequence = y.client_sequence AND x.operation_id <> y.operation_id
), met AS (
  SELECT stream_id, n, list(other) AS others, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS k FROM clash GROUP BY 1, 2
), step(stream_id, k, refused) AS (
  SELECT stream_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r GROUP BY 1
  UNION ALL
  SELECT s.stream_id, m.k, CASE WHEN len(list_filter(m.others, lambda o: NOT list_contains(s.refused, o))) > 0 THEN list_append(s.refused, m.n) ELSE s.refused END
  FROM step s JOIN met m ON m.stream_id = s.stream_id AND m.k = s.k + 1
), fate AS (
  SELECT r.*, r.lost OR list_contains(e.refused, r.n) AS refused FROM r JOIN (SELECT stream_id, arg_max(refused, k) AS refused FROM step GROUP BY 1) e ON e.stream_id = r.stream_id
), c AS (SELECT b.*, f.refused FROM b JOIN fate f ON f.stream_id = b.stream_id AND f.n = b.n),
ok AS (SELECT * FROM c WHERE class = 'new' AND NOT refused),
told AS (
  SELECT c.*, CASE WHEN c.class LIKE '%conflict' THEN c.class
    WHEN c.class = 'new' AND EXISTS (SELECT 1 FROM ok WHERE ok.stream_id = c.stream_id AND ok.operation_id = c.operation_id AND ok.n < c.n AND (ok.client_id <> c.client_id OR ok.client_sequence <> c.client_sequence)) THEN 'operation-identity-conflict'
    WHEN c.class = 'new' AND EXISTS (SELECT 1 FROM ok WHERE ok.stream_id = c.stream_id AND ok.operation_id = c.operation_id AND ok.n < c.n AND ok.intent_hash <> c.intent_hash) THEN 'operation-intent-conflict'
    WHEN c.class = 'new' AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.stream_id = c.stream_id AND ok.operation_id = c.operation_id AND ok.n < c.n)
      AND EXISTS (SELECT 1 FROM ok WHERE ok.stream_id = c.stream_id AND ok.client_id = c.client_id AND ok.client_sequence = c.client_sequence AND ok.operation_id <> c.operation_id AND ok.n < c.n) THEN 'client-sequence-conflict'
    END AS why
  FROM c
), v AS (
  SELECT *, CASE WHEN refused AND event_id = min(CASE WHEN why IS NOT NULL THEN event_id END) OVER (PARTITION BY stream_id, n) THEN why
    WHEN refused THEN 'aborted' WHEN class = 'replay' THEN 'replay'
    WHEN row_number() OVER (PARTITION BY stream_id, operation_id, class, refused ORDER BY n, event_id) = 1 THEN 'new' ELSE 'repeat' END AS verdict
  FROM told
"""

ORACLE_SQL: dict[str, str] = {
    "proposals_numbered": _WITH + "SELECT operation_id, client_id, client_sequence FROM prop",
    "proposal_batch_violations": _WITH
    + """, req AS (
  SELECT *, client_id || '-' || CAST(CAST(floor((client_sequence - 1) / 64) AS BIGINT) AS VARCHAR) AS request_id, client_sequence * 2 AS proposal_ord FROM prop
), both_ AS (
  SELECT request_id, proposal_ord, operation_id, client_id, CASE WHEN event_id % 70 = 0 THEN client_sequence - 3 ELSE client_sequence END AS cs FROM req
  UNION ALL SELECT request_id, proposal_ord + 1, operation_id, client_id, client_sequence FROM req WHERE event_id % 50 = 0
), v AS (
  SELECT request_id, proposal_ord, CASE
    WHEN row_number() OVER (PARTITION BY request_id, operation_id ORDER BY proposal_ord) > 1 THEN 'duplicate-operation-id'
    WHEN lag(cs) OVER (PARTITION BY request_id, client_id ORDER BY proposal_ord) >= cs THEN 'proposal-order' END AS violation FROM both_
)
SELECT * FROM v WHERE violation IS NOT NULL""",
    "request_limit_check": _WITH
    + """SELECT client_id || '-' || substr(operation_id, 4, 1) AS request_id, 'protocol-limit' AS violation
FROM prop GROUP BY client_id || '-' || substr(operation_id, 4, 1), stream_id HAVING count(*) > 8""",
    "decide_row_ops": _WITH
    + "SELECT operation_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM judged",
    "canonical_log": _WITH + "SELECT stream_id, sequence, operation_id FROM log",
    "decisions_all": _WITH + "SELECT stream_id, operation_id, status, sequence, reason FROM dec",
    "continued_log": _WITH
    + """SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY event_id % 2, ts, event_id) AS BIGINT) AS sequence, operation_id
FROM judged WHERE reason IS NULL""",
    "idempotent_replay": _WITH + "SELECT operation_id, status, sequence FROM dec",
    "decision_matrix": _WITH + "SELECT class, count(*) AS n FROM classed GROUP BY 1",
    "http_status_map": _WITH
    + """SELECT operation_id, CAST(CASE WHEN class LIKE '%conflict' THEN 409 ELSE 200 END AS INTEGER) AS http_status,
CASE WHEN class LIKE '%conflict' THEN class END AS code FROM classed""",
    "client_position_conflicts": _WITH
    + """SELECT stream_id, client_id, client_sequence, count(DISTINCT operation_id) AS operations FROM (
  SELECT * FROM attempt UNION ALL SELECT stream_id, operation_id, client_id, client_sequence, intent_hash, event_id FROM prop)
GROUP BY 1, 2, 3 HAVING count(DISTINCT operation_id) > 1""",
    "stateful_decide_fold": _WITH
    + """, gate AS (
  SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS signups FROM prop
), d AS (SELECT *, CASE WHEN event_type = 'purchase' AND signups = 0 THEN 'disabled' END AS why FROM gate)
SELECT stream_id, operation_id, CASE WHEN why IS NULL THEN CAST(count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) END AS sequence,
  why AS reason, CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM d""",
    "counter_fold": _WITH
    + "SELECT stream_id, sequence, CAST(sum(event_id % 7 - 3) OVER (PARTITION BY stream_id ORDER BY sequence) AS BIGINT) AS total FROM log",
    "log_contiguity_violations": _WITH
    + """, kept AS (SELECT stream_id, sequence AS received, lag(sequence, 1, 0) OVER (PARTITION BY stream_id ORDER BY sequence) + 1 AS expected FROM log WHERE sequence % 97 <> 0)
SELECT stream_id, expected, received FROM kept WHERE expected <> received""",
    "snapshot_integrity": _WITH
    + """, l AS (SELECT stream_id, operation_id, sequence, CASE WHEN sequence % 700 = 5 THEN client_sequence + 1 ELSE client_sequence END AS cs FROM log WHERE sequence % 600 <> 7),
d AS (SELECT stream_id, operation_id, sequence, client_sequence AS cs FROM log WHERE sequence % 500 <> 3),
v AS (
  SELECT coalesce(l.stream_id, d.stream_id) AS stream_id, coalesce(l.operation_id, d.operation_id) AS operation_id,
    CASE WHEN d.sequence IS NULL THEN 'decision-missing' WHEN l.sequence IS NULL THEN 'entry-missing' WHEN l.cs <> d.cs THEN 'position-differs' END AS violation
  FROM l FULL OUTER JOIN d ON l.stream_id = d.stream_id AND l.operation_id = d.operation_id
)
SELECT * FROM v WHERE violation IS NOT NULL""",
    "page_cursor_check": _WITH
    + ", broken AS (SELECT * FROM log WHERE sequence % 611 <> 0), "
    + _PAGES.format(log="broken")
    + """, v AS (SELECT stream_id, page, CASE
  WHEN base_sequence > through_sequence OR through_sequence > head_sequence THEN 'cursor'
  WHEN entries <> through_sequence - base_sequence THEN 'length'
  WHEN first_sequence <> base_sequence + 1 OR last_sequence <> through_sequence OR distinct_sequences <> entries THEN 'dense' END AS violation FROM page)
SELECT * FROM v WHERE violation IS NOT NULL""",
    "replica_record_audit": _WITH
    + """, rep AS (
  SELECT l.stream_id, l.client_id, max(l.client_sequence) + 1 AS next_client_sequence, any_value(h.confirmed_sequence) AS c
  FROM log l JOIN head h ON l.stream_id = h.stream_id GROUP BY 1, 2
), moved AS (SELECT *, c + CASE WHEN right(client_id, 1) = '3' THEN 1 ELSE 0 END AS confirmed FROM rep),
bad AS (
  SELECT stream_id, client_id, count(*) FILTER (WHERE event_id % 211 = 0) AS odd,
    min(CASE WHEN status = 'accepted' AND event_id % 211 <> 0 THEN sequence END) AS least FROM outbox GROUP BY 1, 2
), v AS (
  SELECT m.stream_id, m.client_id, CASE WHEN m.confirmed <> m.c AND m.c > 0 THEN 'retained-log' WHEN b.odd > 0 THEN 'status'
    WHEN b.least <= m.confirmed THEN 'accepted-sequence' END AS violation
  FROM moved m LEFT JOIN bad b ON m.stream_id = b.stream_id AND m.client_id = b.client_id
)
SELECT * FROM v WHERE violation IS NOT NULL""",
    "log_page": _WITH + "SELECT sequence, operation_id FROM log WHERE stream_id = 's3' AND sequence > 100 AND sequence <= 356",
    "log_pages_all": _WITH
    + ", "
    + _PAGES.format(log="log")
    + "SELECT stream_id, page, first_sequence, last_sequence, entries, head_sequence, through_sequence < head_sequence AS more FROM page",
    "state_lww": _WITH + f"SELECT {_STATE} FROM last WHERE nth = 1 AND op = 'putRow'",
    "state_asof": _WITH
    + f""", upto AS (SELECT *, row_number() OVER (PARTITION BY stream_id, user_id ORDER BY sequence DESC) AS n FROM log WHERE sequence <= 200)
SELECT {_STATE} FROM upto WHERE n = 1 AND op = 'putRow'""",
    "log_density": _WITH
    + """, kept AS (
  SELECT stream_id, sequence FROM log WHERE NOT (stream_id = 's3' AND sequence % 50 = 7) UNION ALL SELECT stream_id, sequence FROM log WHERE stream_id = 's5' AND sequence % 40 = 3
), s AS (SELECT stream_id, count(*) AS entries, count(DISTINCT sequence) AS distinct_sequences, max(sequence) AS head_sequence FROM kept GROUP BY 1)
SELECT *, CASE WHEN entries <> distinct_sequences THEN 'repeated' ELSE 'missing' END AS violation FROM s WHERE entries <> head_sequence""",
    "log_repeats": _WITH
    + """, kept AS (
  SELECT stream_id, sequence, operation_id, client_id, client_sequence FROM log
  UNION ALL SELECT stream_id, sequence, CASE WHEN sequence % 180 = 3 THEN 'other' ELSE operation_id END, client_id, client_sequence FROM log WHERE sequence % 90 = 3
), k AS (
  SELECT stream_id, CAST(floor((sequence - 1) / 256) AS BIGINT) AS page, 'operation-id' AS kind, '["' || operation_id || '"]' AS key FROM kept
  UNION ALL SELECT stream_id, CAST(floor((sequence - 1) / 256) AS BIGINT), 'client-position', '["' || client_id || '","' || client_sequence || '"]' FROM kept
)
SELECT stream_id, page, kind, key, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1""",
    "state_asof_checkpoints": _WITH
    + f""", upto AS (SELECT *, row_number() OVER (PARTITION BY stream_id, user_id ORDER BY sequence DESC) AS n FROM log WHERE sequence <= 200)
SELECT {_STATE} FROM upto WHERE n = 1 AND op = 'putRow'""",
    "state_point_lookup": _WITH + f"SELECT {_STATE} FROM last WHERE nth = 1 AND op = 'putRow' AND user_id = 7",
    "state_first_match": _WITH
    + f"SELECT {_STATE} FROM last WHERE nth = 1 AND op = 'putRow' AND event_type = 'click' ORDER BY CAST(user_id AS VARCHAR) LIMIT 1",
    "state_rows_ordered": _WITH + f"SELECT '[' || CAST(user_id AS VARCHAR) || ']' AS pk, {_STATE} FROM last WHERE nth = 1 AND op = 'putRow'",
    "tombstones": _WITH + "SELECT stream_id, user_id, sequence FROM last WHERE nth = 1 AND op = 'deleteRow'",
    "lww_lineitem_collisions": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_DESC}) AS nth FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM r WHERE nth = 1""",
    "projection_conflict_rows": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "projection_upsert_orders": """
WITH old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0),
op AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deleteRow' ELSE 'putRow' END AS op, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(op.o_orderkey, old.o_orderkey) AS o_orderkey, CASE WHEN op.op IS NULL THEN old.o_orderstatus ELSE 'X' END AS o_orderstatus,
  CASE WHEN op.op IS NULL THEN old.o_orderpriority ELSE op.o_orderpriority END AS o_orderpriority
FROM old FULL OUTER JOIN op ON old.o_orderkey = op.o_orderkey WHERE op.op IS NULL OR op.op = 'putRow'""",
    "optimistic_state": _WITH
    + """, both_ AS (
  SELECT l.stream_id, user_id, client_sequence, event_type, op, 0 AS layer, sequence AS ord FROM log l JOIN head h ON l.stream_id = h.stream_id WHERE sequence <= confirmed_sequence
  UNION ALL SELECT stream_id, user_id, client_sequence, event_type, op, 1, client_sequence FROM outbox
), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, user_id ORDER BY layer DESC, ord DESC) AS nth FROM both_)
SELECT stream_id, user_id, client_sequence, event_type FROM r WHERE nth = 1 AND op = 'putRow'""",
    "intent_hash": _WITH + "SELECT operation_id, intent_hash FROM prop",
    "pk_encoding": """SELECT conv_id, turn, '[' || CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ']' AS pk FROM conversations""",
    "affinity_map": """SELECT p_partkey, p_type, CASE WHEN upper(p_type) LIKE '%INT%' THEN 'integer'
  WHEN upper(p_type) LIKE '%CHAR%' OR upper(p_type) LIKE '%CLOB%' OR upper(p_type) LIKE '%TEXT%' THEN 'text'
  WHEN trim(p_type) = '' OR upper(p_type) LIKE '%BLOB%' THEN 'blob'
  WHEN upper(p_type) LIKE '%REAL%' OR upper(p_type) LIKE '%FLOA%' OR upper(p_type) LIKE '%DOUB%' THEN 'real' ELSE 'numeric' END AS affinity FROM part""",
    "canonical_props": """SELECT event_id, replace(props, ' ', '') AS canonical, 'sha256:' || sha256(replace(props, ' ', '')) AS fingerprint FROM events""",
    "retry_backoff": "SELECT conv_id, turn, CAST(least(2000, 120 * pow(2, turn)) AS BIGINT) AS delay_ms FROM conversations",
    "bootstrap_log": f"SELECT sequence, table_name, pk, operation_id, intent_hash FROM ({_boot('bootstrap', _ALL)})",
    "bootstrap_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _ALL),
    "bootstrap_selected_tables": f"SELECT sequence, table_name, pk, operation FROM ({_boot('seed', ['customer', 'nation', 'part'])})",
    "bootstrap_operation_ids": """SELECT o_orderkey, 'bootstrap:orders:' || sha256('{"key":[' || CAST(o_orderkey AS VARCHAR) || '],"table":"orders"}') AS operation_id FROM orders""",
    "normalize_row_operations": """SELECT conv_id, turn, 'putRow' AS op, CASE
  WHEN conv_id % 17 = 0 THEN 'unknown table nowhere'
  WHEN conv_id % 13 = 0 THEN 'conversations: unknown columns zip'
  WHEN (conv_id + turn) % 5 = 0 OR role IS NULL AND (conv_id + turn) % 7 <> 0 THEN 'conversations.role must not be null'
  WHEN (conv_id + turn) % 7 = 0 THEN 'conversations.role must be text' END AS error FROM conversations""",
    "outbox_prepare": _WITH
    + """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id, client_id ORDER BY client_sequence) AS BIGINT) AS proposal_ord FROM outbox WHERE status = 'pending')
SELECT client_id, operation_id, proposal_ord FROM r WHERE proposal_ord <= 64""",
    "outbox_enqueue": _WITH
    + """, rep AS (SELECT stream_id, client_id, max(client_sequence) + 1 AS next_client_sequence FROM log GROUP BY 1, 2),
more AS (
  SELECT d.stream_id, d.client_id, d.operation_id, d.event_id, o.operation_id IS NOT NULL AS duplicate
  FROM dec d LEFT JOIN outbox o ON d.stream_id = o.stream_id AND d.operation_id = o.operation_id WHERE d.status = 'rejected' OR d.event_id % 40 = 0
)
SELECT m.operation_id, m.duplicate, CASE WHEN NOT m.duplicate THEN CAST(r.next_client_sequence
  + row_number() OVER (PARTITION BY m.stream_id, m.client_id, m.duplicate ORDER BY m.event_id) - 1 AS BIGINT) END AS client_sequence
FROM more m JOIN rep r ON m.stream_id = r.stream_id AND m.client_id = r.client_id""",
    "merge_new_entries": _WITH
    + """, rep AS (SELECT DISTINCT stream_id, client_id FROM log)
SELECT r.stream_id, r.client_id, count(*) AS entries, max(p.sequence) AS confirmed_sequence FROM rep r JOIN next_page p ON r.stream_id = p.stream_id GROUP BY 1, 2""",
    "merge_overlap_divergence": _WITH
    + """SELECT stream_id, sequence, CASE WHEN sequence % 400 = 2 THEN 'client_sequence' ELSE 'intent_hash' END AS field FROM log WHERE sequence % 400 = 2 OR sequence % 300 = 1""",
    "merge_outbox_after": _WITH
    + """SELECT o.stream_id, o.client_id, o.operation_id, o.status FROM outbox o
WHERE NOT EXISTS (SELECT 1 FROM next_page p WHERE p.stream_id = o.stream_id AND p.operation_id = o.operation_id)""",
    "merge_newly_resolved": _WITH
    + """SELECT o.client_id, o.operation_id, p.sequence AS resolved_sequence FROM outbox o JOIN next_page p ON p.stream_id = o.stream_id AND p.operation_id = o.operation_id WHERE o.status = 'pending'""",
    "replica_status": _WITH
    + """, b AS (SELECT stream_id, client_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'accepted') AS accepted FROM outbox GROUP BY 1, 2),
r AS (SELECT stream_id, client_id, count(*) AS unacknowledged FROM dec WHERE status = 'rejected' GROUP BY 1, 2)
SELECT coalesce(b.stream_id, r.stream_id) AS stream_id, coalesce(b.client_id, r.client_id) AS client_id, coalesce(pending, 0) AS pending, coalesce(accepted, 0) AS accepted, coalesce(unacknowledged, 0) AS unacknowledged
FROM b FULL OUTER JOIN r ON b.stream_id = r.stream_id AND b.client_id = r.client_id""",
    "resolutions_append": _WITH
    + "SELECT client_id, operation_id, status, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS learned FROM dec WHERE event_id % 3 = 0 OR event_id % 2 = 0",
    "resolutions_ack": _WITH + "SELECT client_id, operation_id, status FROM dec WHERE event_id % 3 = 0 AND event_id % 2 <> 0",
    "compact_prefix": _WITH
    + """SELECT l.stream_id, l.client_id, l.sequence FROM log l JOIN head h ON l.stream_id = h.stream_id WHERE l.sequence > h.confirmed_sequence - 50""",
    "wire_request_roundtrip": _WITH
    + """SELECT client_id || '-' || CAST(CAST(floor((client_sequence - 1) / 64) AS BIGINT) AS VARCHAR) AS request_id, stream_id, CAST((client_sequence - 1) % 64 AS BIGINT) AS proposal_ord,
  operation_id, client_id, client_sequence, intent_hash, '{"op":"' || op || '","user":' || CAST(user_id AS VARCHAR) || '}' AS intent FROM prop""",
    "wire_response_roundtrip": _WITH
    + ", "
    + _PAGES.format(log="log")
    + """SELECT l.stream_id, p.page, p.through_sequence, p.head_sequence, l.sequence, l.operation_id, l.client_id, l.client_sequence, '{"op":"' || l.op || '"}' AS operation
FROM log l JOIN page p ON l.stream_id = p.stream_id AND p.page = CAST(floor((l.sequence - 1) / 256) AS BIGINT)""",
    "decide_batch_conflicts": _WITH
    + """, batch AS (
  SELECT stream_id, operation_id, client_id, client_sequence, intent_hash, event_id, 0 AS variant FROM prop WHERE event_id % 2 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence, 'changed', event_id, 1 FROM prop WHERE event_id % 101 = 0
  UNION ALL SELECT stream_id, operation_id, client_id, client_sequence + 1, intent_hash, event_id, 2 FROM prop WHERE event_id % 103 = 0
  UNION ALL SELECT stream_id, operation_id || '-x', client_id, client_sequence, intent_hash, event_id, 3 FROM prop WHERE event_id % 107 = 0
  UNION ALL SELECT stream_id, operation_id || '-y', client_id || '-n', client_sequence, intent_hash, event_id, 4 FROM prop WHERE event_id % 109 = 0
), known AS (SELECT * FROM dec WHERE event_id % 5 = 0),
a AS (
  SELECT b.*, d.status, d.sequence, CASE
    WHEN d.operation_id IS NOT NULL AND (d.client_id <> b.client_id OR d.client_sequence <> b.client_sequence) THEN 'operation-identity-conflict'
    WHEN d.operation_id IS NOT NULL AND d.intent_hash <> b.intent_hash THEN 'operation-intent-conflict'
    WHEN d.operation_id IS NOT NULL THEN 'replay' WHEN p.operation_id IS NOT NULL THEN 'client-sequence-conflict' ELSE 'new' END AS first_class
  FROM batch b LEFT JOIN known d ON b.stream_id = d.stream_id AND b.operation_id = d.operation_id
  LEFT JOIN known p ON b.stream_id = p.stream_id AND b.client_id = p.client_id AND b.client_sequence = p.client_sequence
), c AS (
  SELECT *, CASE WHEN first_class <> 'new' THEN first_class
    WHEN first_value(client_id) OVER i <> client_id OR first_value(client_sequence) OVER i <> client_sequence THEN 'operation-identity-conflict'
    WHEN first_value(intent_hash) OVER i <> intent_hash THEN 'operation-intent-conflict'
    WHEN row_number() OVER i > 1 THEN 'repeat'
    WHEN first_value(operation_id) OVER p <> operation_id THEN 'client-sequence-conflict' ELSE 'new' END AS found
  FROM a WINDOW i AS (PARTITION BY first_class, stream_id, operation_id ORDER BY event_id, variant),
    p AS (PARTITION BY first_class, stream_id, client_id, client_sequence ORDER BY event_id, variant)
)
SELECT operation_id, variant, CASE WHEN found IN ('new', 'repeat') AND max(found LIKE '%conflict') OVER (PARTITION BY stream_id, client_id) THEN 'aborted' ELSE found END AS class,
  CASE WHEN found = 'replay' THEN status END AS status, CASE WHEN found = 'replay' THEN sequence END AS sequence FROM c""",
    "decide_requests_atomic": _WITH.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + _ATOMIC.format(keep="true", late="false")
    + """), made AS (
  SELECT stream_id, operation_id, CASE WHEN event_id % 6 = 4 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN event_id % 6 = 4 THEN 'sixth' END AS reason,
    CASE WHEN event_id % 6 <> 4 THEN coalesce(h.head, 0) + row_number() OVER (PARTITION BY v.stream_id, event_id % 6 = 4 ORDER BY n, event_id) END AS sequence
  FROM v LEFT JOIN (SELECT stream_id AS s, max(sequence) AS head FROM known GROUP BY 1) h ON h.s = v.stream_id WHERE verdict = 'new'
)
SELECT request_id, v.operation_id, variant, verdict AS class, CASE WHEN verdict = 'replay' THEN v.status ELSE m.status END AS status,
  CASE WHEN verdict = 'replay' THEN v.sequence ELSE m.sequence END AS sequence, m.reason
FROM v LEFT JOIN made m ON m.stream_id = v.stream_id AND m.operation_id = v.operation_id AND verdict IN ('new', 'repeat')""",
    "synchronize_requests": _WITH.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + _ATOMIC.format(keep="CAST(regexp_extract(client_id, '^c(\\d+)', 1) AS INTEGER) % 31 <> 4", late="u % 29 = 7")
    + """), heads AS (SELECT stream_id AS s, count(*) AS head FROM known WHERE status = 'accepted' GROUP BY 1),
per AS (
  SELECT v.stream_id, request_id, n, any_value(u) AS u, bool_or(refused) AS refused, count(*) AS decisions,
    max(CASE WHEN verdict LIKE '%conflict' THEN verdict END) AS conflict,
    count(*) FILTER (WHERE verdict = 'new' AND NOT coalesce(j.op = 'putRow' AND j.col_type IS NULL, false)) AS made
  FROM v LEFT JOIN judged j ON j.event_id = v.event_id GROUP BY 1, 2, 3
), placed AS (
  SELECT p.*, coalesce(h.head, 0) + sum(CASE WHEN refused THEN 0 ELSE made END) OVER (PARTITION BY stream_id ORDER BY n) AS head,
    CASE WHEN u % 29 = 7 THEN 1099511627776 WHEN u % 3 = 0 THEN 5 ELSE 0 END AS base
  FROM per p LEFT JOIN heads h ON h.s = p.stream_id
)
SELECT request_id, CAST(CASE WHEN refused THEN 409 ELSE 200 END AS BIGINT) AS http_status, CASE WHEN u % 29 = 7 THEN 'future-base-sequence' WHEN refused THEN conflict END AS code,
  CAST(NULL AS VARCHAR) AS wrong, CASE WHEN NOT refused THEN CAST(head AS BIGINT) END AS head_sequence, CASE WHEN NOT refused THEN CAST(least(head, base + 10) AS BIGINT) END AS through_sequence,
  CASE WHEN NOT refused THEN CAST(least(head, base + 10) - base AS BIGINT) END AS entries, CASE WHEN NOT refused THEN decisions END AS decisions FROM placed
UNION ALL SELECT DISTINCT client_id || '-' || variant || '-' || CAST(client_sequence // 8 AS VARCHAR), 400, 'unsupported-protocol-version', NULL, NULL, NULL, NULL, NULL FROM batch
WHERE CAST(regexp_extract(client_id, '^c(\\d+)', 1) AS INTEGER) % 31 = 4""",
    "merge_responses": _WITH
    + """, rep AS (
  SELECT DISTINCT l.stream_id, l.client_id, CAST(l.user_id AS INTEGER) AS u, h.head_sequence AS head, h.confirmed_sequence AS c,
    CASE WHEN l.user_id % 23 = 5 THEN h.confirmed_sequence + 5 ELSE greatest(h.confirmed_sequence - 10, 0) END AS base
  FROM log l JOIN head h ON l.stream_id = h.stream_id
), bad AS (
  SELECT r.*, CASE WHEN base > c THEN 'log-gap: expected ' || (c + 1) || ', received ' || (base + 1)
    WHEN u % 17 = 3 AND EXISTS (SELECT 1 FROM outbox o WHERE o.stream_id = r.stream_id AND o.client_id = r.client_id AND o.event_id % 4 = 1) THEN 'decision-conflict'
    WHEN u % 19 = 4 AND EXISTS (SELECT 1 FROM log l WHERE l.stream_id = r.stream_id AND l.sequence > r.base AND l.sequence <= r.c AND l.sequence % 5 = 0) THEN 'log-divergence: origin intentHash differs'
    END AS detail, least(head, base + 256) AS through
  FROM rep r
), box AS (
  SELECT o.stream_id, o.client_id, o.operation_id, o.status, o.sequence, o.event_id % 4 < 2 AS told, b.detail, b.through
  FROM outbox o JOIN bad b ON b.stream_id = o.stream_id AND b.client_id = o.client_id
)
SELECT stream_id, client_id, 'conflict' AS kind, detail, CAST(NULL AS VARCHAR) AS operation_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS sequence FROM bad WHERE detail IS NOT NULL
UNION ALL SELECT stream_id, client_id, 'replica', NULL, NULL, CASE WHEN through >= head THEN 'caught-up' ELSE 'behind' END, through FROM bad WHERE detail IS NULL
UNION ALL SELECT stream_id, client_id, 'outbox', NULL, operation_id, CASE WHEN detail IS NULL AND told THEN 'accepted' ELSE status END,
  CASE WHEN detail IS NULL AND told OR status = 'accepted' THEN sequence END FROM box WHERE detail IS NOT NULL OR sequence > through
UNION ALL SELECT stream_id, client_id, 'resolution', NULL, operation_id, 'accepted', sequence FROM box WHERE detail IS NULL AND status = 'pending' AND (told OR sequence <= through)
UNION ALL SELECT b.stream_id, b.client_id, 'entry', NULL, l.operation_id, NULL, l.sequence FROM bad b JOIN log l ON l.stream_id = b.stream_id AND l.sequence > b.c AND l.sequence <= b.through WHERE b.detail IS NULL""",
    "replica_new": """SELECT DISTINCT 's' || CAST(user_id % 10 AS VARCHAR) AS stream_id, 'c' || CAST(user_id AS VARCHAR) AS client_id, CAST(1 AS BIGINT) AS next_client_sequence,
  CAST(0 AS BIGINT) AS confirmed_sequence, CAST(0 AS BIGINT) AS retained_base FROM events""",
    "optimistic_by_replica": _WITH
    + """, rep AS (SELECT DISTINCT l.stream_id, l.client_id, h.confirmed_sequence FROM log l JOIN head h ON l.stream_id = h.stream_id WHERE l.stream_id IN ('s1', 's2')),
both_ AS (
  SELECT r.stream_id, r.client_id, user_id, sequence, event_type, op, 0 AS layer, sequence AS ord FROM rep r JOIN log l ON l.stream_id = r.stream_id AND l.sequence <= r.confirmed_sequence
  UNION ALL SELECT stream_id, client_id, user_id, sequence, event_type, op, 1, client_sequence FROM outbox WHERE stream_id IN ('s1', 's2')
), n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, client_id, user_id ORDER BY layer DESC, ord DESC) AS nth FROM both_)
SELECT stream_id, client_id, user_id, sequence, event_type FROM n WHERE nth = 1 AND op = 'putRow'""",
    "wire_decode_errors": _WITH
    + """, req AS (
  SELECT client_id || '-' || CAST(CAST(floor((client_sequence - 1) / 64) AS BIGINT) AS VARCHAR) AS request_id, any_value(user_id) % 13 AS kind, count(*) > 40 AS large FROM prop GROUP BY 1
), e AS (
  SELECT request_id, CASE WHEN kind = 7 THEN 'wire-decode $' WHEN kind = 0 THEN 'unsupported-protocol-version $.protocolVersion' WHEN kind = 1 THEN 'wire-decode $.streamId'
    WHEN large THEN 'protocol-limit $.request.proposals'
    WHEN kind = 5 THEN 'wire-decode $.request.proposals[0].clientSequence' WHEN kind = 6 THEN 'wire-decode $.request.proposals[0].intentHash'
    WHEN kind = 8 THEN 'wire-decode $.request.proposals[0].operationId' WHEN kind = 10 THEN 'wire-decode $.request.proposals[0].intent'
    WHEN kind = 2 THEN 'wire-decode $.request.baseSequence' WHEN kind = 3 THEN 'invalid-sequence $.request.baseSequence' WHEN kind = 4 THEN 'invalid-limit $.request.maximumEntries'
    WHEN kind = 9 THEN 'invalid-sequence $.request.proposals[0].clientSequence' END AS error FROM req
)
SELECT request_id, CASE WHEN error IS NOT NULL THEN split_part(error, ' ', 1) END AS code, CASE WHEN error IS NOT NULL THEN split_part(error, ' ', 2) END AS path FROM e""",
    "wire_response_errors": _WITH
    + ", "
    + _PAGES.format(log="log")
    + """, e AS (
  SELECT stream_id, page, page % 5 AS kind, entries FROM page
), f AS (
  SELECT *, CASE WHEN kind = 0 AND stream_id = 's4' THEN 'malformed-response $.streamId' WHEN kind = 1 AND entries > 3 THEN 'malformed-response $.response.entries' WHEN kind = 2 AND entries > 7 THEN 'wire-decode $.response.entries[7].origin.clientId'
    WHEN kind = 3 AND entries > 9 THEN 'malformed-response $.response.entries[9].operationId' WHEN kind = 4 AND entries > 2 THEN 'invalid-sequence $.response.entries[2].origin.clientSequence' END AS error FROM e
)
SELECT stream_id, page, CASE WHEN error IS NOT NULL THEN split_part(error, ' ', 1) END AS code, CASE WHEN error IS NOT NULL THEN split_part(error, ' ', 2) END AS path FROM f""",
    "normalize_deletes": """WITH e AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN 'conversations: key must have exactly the key columns'
    WHEN turn % 3 = 1 THEN 'conversations.turn must be integer' END AS message FROM conversations
)
SELECT conv_id, turn, 'deleteRow' AS op, CASE WHEN message IS NULL THEN '{"conv_id":' || CAST(conv_id AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR) || '}' END AS body,
  CASE WHEN message IS NOT NULL THEN 'invalid-row-operation' END AS code, message FROM e""",
    "typed_rows": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part",
    "normalized_rows": """SELECT conv_id, turn, '{"conv_id":' || CAST(conv_id AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"note":null}' AS body
FROM conversations WHERE role IS NOT NULL""",
    "wire_decisions_roundtrip": _WITH
    + """, nth AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) AS nth FROM dec)
SELECT stream_id, CAST(floor((nth - 1) / 64) AS BIGINT) AS page, (nth - 1) % 64 AS decision_ord, CAST(NULL AS VARCHAR) AS error, operation_id, status, sequence,
  CASE WHEN status = 'accepted' THEN '{"op":"' || op || '"}' END AS operation, CASE WHEN status = 'rejected' THEN '{"code":"' || reason || '"}' END AS reason FROM nth""",
    "response_decision_violations": _WITH
    + """, nth AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) AS nth FROM dec),
told AS (
  SELECT stream_id, operation_id, status, nth, 0 AS again, sequence AS committed, CASE WHEN nth % 97 = 3 THEN sequence + 1 WHEN nth % 89 = 5 THEN 1099511627776 ELSE sequence END AS sequence FROM nth
  UNION ALL SELECT stream_id, operation_id, status, nth, 1, sequence, sequence FROM nth WHERE nth % 101 = 7
), v AS (
  SELECT t.stream_id, CAST(floor((nth - 1) / 64) AS BIGINT) AS page, operation_id, CASE WHEN again = 1 THEN 'decision-repeated'
    WHEN status = 'accepted' AND t.sequence > h.head_sequence THEN 'decision-beyond-head'
    WHEN status = 'accepted' AND committed <> t.sequence THEN 'decision-sequence-differs'
    WHEN status = 'rejected' AND nth % 10 = 1 THEN 'rejected-committed' END AS violation
  FROM told t JOIN head h ON t.stream_id = h.stream_id
)
SELECT * FROM v WHERE violation IS NOT NULL""",
}
ORACLE_SQL["projection_in_place"] = ORACLE_SQL["projection_upsert_orders"]
