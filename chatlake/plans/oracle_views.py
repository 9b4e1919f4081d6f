"""DuckDB definitions of the derived application tables, for oracle SQL.

Each oracle query is ``WITH <needed views> <body>`` over the driver tables
(which DuckDB has as views).  These are written independently of the Spark
DataFrame code in ``chatlake.sources.tables``; agreement of the two is what
the correctness check measures.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "users": """
SELECT c_custkey AS id,
  CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'devonix' ELSE 'email' END AS login_source,
  CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN c_custkey + 100000 END AS devonix_user_id,
  c_name AS first_name, c_mktsegment AS last_name,
  lower(replace(c_name, '#', '')) || '@example.com' AS email,
  CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS profile_picture, 'free' AS plan,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal < 0 END AS banned,
  CAST(NULL AS VARCHAR) AS ban_reason, CAST(NULL AS TIMESTAMP) AS banned_at,
  CAST(NULL AS TIMESTAMP) AS suspended_until, CAST(NULL AS VARCHAR) AS suspend_reason,
  CAST(NULL AS TIMESTAMP) AS last_login_at,
  TIMESTAMP '2023-02-01 12:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
FROM customer""",
    "dream_messages": """
SELECT event_id AS id, user_id, user_id * 100 + day(ts) AS session_id,
  CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'ai' END AS role, '' AS content,
  CASE WHEN event_id % 2 = 0 AND event_id % 7 <> 0 THEN event_type END AS category,
  CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'k' || json_extract_string(props, '$.k') END AS entity,
  CASE WHEN event_id % 2 = 1 AND value >= 60 THEN 'up' WHEN event_id % 2 = 1 AND value < 5 THEN 'down' END AS feedback,
  ts AS created_at FROM events""",
    "token_usage": """
SELECT event_id AS id, user_id, event_id AS message_id,
  CASE event_id % 8 WHEN 1 THEN 'openrouter:m1' WHEN 3 THEN 'synthesis:m2' WHEN 5 THEN 'm3' END AS model,
  CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value * 3) AS BIGINT) AS completion_tokens,
  CAST(floor(value) AS BIGINT) + CAST(floor(value * 3) AS BIGINT) AS total_tokens, ts AS created_at
FROM events WHERE event_id % 2 = 1""",
    "token_usage_big": """
SELECT o.o_custkey AS user_id, l.l_orderkey AS message_id, l.l_linenumber AS line,
  CASE l.l_returnflag WHEN 'A' THEN 'openrouter:m1' WHEN 'N' THEN 'synthesis:m2' ELSE 'm3' END AS model,
  CAST(floor(l.l_quantity) AS BIGINT) AS total_tokens, l.l_shipdate AS created_at
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "dream_sessions": """
SELECT user_id * 100 + day(ts) AS id, user_id, min(event_type) AS title, min(ts) AS created_at
FROM events GROUP BY user_id, day(ts)""",
    "audit_log": """
SELECT event_id AS id, CASE WHEN value < 20 THEN 'ban_user' ELSE 'suspend_user' END AS action,
  user_id * 20 AS target_user_id, '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS ip, ts AS created_at
FROM events WHERE event_type = 'error'""",
    "knowledge_chunks": """
SELECT e.vec_id AS id, 't' || CAST(e.label AS VARCHAR) AS tradition, d.source AS source_ref,
  d.text AS content, e.embedding,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(e.vec_id % 30 AS INTEGER)) AS created_at
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
    "send_log": """
SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
  '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS ip, ts AS created_at
FROM events WHERE event_type = 'signup'""",
    "chat_turns": """
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS role, text FROM conversations""",
    "sso_payloads": """
SELECT CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 900000 ELSE c_custkey + 100000 END AS devonix_user_id,
  CASE WHEN c_custkey % 30 = 0 THEN '' ELSE 'F' || CAST(c_custkey AS VARCHAR) END AS first_name, 'L' AS last_name,
  CASE WHEN c_custkey % 10 = 1 THEN 'new' || CAST(c_custkey AS VARCHAR) || '@example.com'
       WHEN c_custkey % 20 = 0 THEN NULL
       ELSE lower(replace(c_name, '#', '')) || '@example.com' END AS email,
  CAST(NULL AS VARCHAR) AS phone, TIMESTAMP '2024-01-30 00:00:00' AS ts
FROM customer WHERE c_custkey % 10 IN (0, 1)""",
    "feedback_events": """
SELECT m.id * 10 + s.seq AS id, m.id AS message_id,
  m.user_id + CASE WHEN s.seq = 2 AND m.id % 5 = 0 THEN 1 ELSE 0 END AS user_id,
  CASE (m.id + s.seq) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS feedback,
  m.created_at AS message_ts, s.seq
FROM dream_messages m CROSS JOIN (VALUES (1), (2), (3)) s(seq) WHERE m.id % 3 = 0""",
    "admin_actions": """
SELECT u.id * 10 + s.seq AS seq, u.id AS target_id,
  CASE (u.id + s.seq) % 5 WHEN 0 THEN 'ban' WHEN 1 THEN 'unban' WHEN 2 THEN 'suspend' WHEN 3 THEN 'unsuspend'
       ELSE CASE WHEN u.id % 3 = 0 THEN 'delete' ELSE 'ban' END END AS action,
  CASE WHEN u.id % 2 = 0 THEN 'spam' ELSE '' END AS reason,
  CAST(u.id % 2 AS INTEGER) AS months, CAST(u.id % 3 AS INTEGER) AS days
FROM users u CROSS JOIN (VALUES (1), (2)) s(seq) WHERE u.id % 7 = 0""",
}

# Views that other views read.
DEPENDS = {"feedback_events": ["dream_messages"], "admin_actions": ["users"]}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        b = body.lstrip()
        return "WITH " + b[1:].lstrip() if b.startswith(",") else body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
