"""DuckDB reference SQL for the registered queries.

The oracle never sees the JSON lines: it computes the fixture's fields
straight from ``events`` (FIXTURES.md §3) and applies each search as plain
SQL, so a match means parse + layout + predicate compiled correctly.
"""

from __future__ import annotations

# Flat fields of the log fixture, one row per event.
FIX = """
WITH fx AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(22400 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS BIGINT) AS id,
         CASE WHEN user_id % 5 = 0 THEN 'initandlisten'
              WHEN user_id % 5 = 1 THEN 'FlowControlRefresher'
              ELSE 'conn' || CAST(user_id AS VARCHAR) END AS ctx,
         CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_id % 3 = 0 THEN 'WiredTiger message' ELSE 'Slow query' END AS msg,
         CASE WHEN user_id % 5 = 1 THEN event_id % 128 END AS tickets,
         CASE WHEN user_id % 5 = 1 THEN event_id % 4 END AS num_trimmed,
         CASE event_id % 6 WHEN 0 THEN 'log_release' WHEN 1 THEN 'log_remove'
                           WHEN 2 THEN 'logXrelease' END AS m_prefix,
         CASE WHEN event_id % 6 IN (0, 1, 2)
              THEN CASE WHEN event_id % 2 = 0 THEN 'connection' ELSE 'txn' END END AS session_name,
         upper(event_type) AS c,
         CASE WHEN event_type = 'error' THEN 'E' ELSE 'I' END AS s,
         date_diff('second', TIMESTAMP '1970-01-01 00:00:00', date_trunc('second', ts)) AS ts_sec,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS t_text
  FROM events),
f AS (
  SELECT *, CASE WHEN m_prefix IS NOT NULL
                 THEN m_prefix || ': rec ' || CAST(event_id AS VARCHAR) END AS m_msg
  FROM fx)
"""

# Search predicates over the flat fields.
SEARCH_SQL = {
    "q1": "tickets IS NOT NULL",
    "q2": "id = 22419",
    "q3_like": "m_msg LIKE 'log_release%' AND session_name = 'connection'",
    "q3_prefix": "starts_with(m_msg, 'log_release') AND session_name = 'connection'",
    "q4_drop": "ctx = 'initandlisten' AND (msg != 'WiredTiger message' OR m_msg LIKE 'log_remove%')",
    "q4_keep": ("ctx = 'initandlisten' AND (msg IS DISTINCT FROM 'WiredTiger message' "
                "OR m_msg LIKE 'log_remove%')"),
    "q5": "c = 'PURCHASE' AND m_msg IS NOT NULL AND ts_sec > 1704800000",
    "q6": "ctx = 'FlowControlRefresher' AND num_trimmed = 0",
}


def search_rows(cond: str) -> str:
    return FIX + f"SELECT event_id, id, ctx FROM f WHERE {cond}"


def search_counts(forms: dict) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {SEARCH_SQL[f]}) AS {name}" for name, f in forms.items())
    return FIX + f"SELECT {cols} FROM f"


# Every leaf of a fixture event: (path segments, pairwise type, condition).
LEAVES = [
    (("t", "$date"), "string", "TRUE"),
    (("s",), "string", "TRUE"),
    (("c",), "string", "TRUE"),
    (("id",), "int", "id IS NOT NULL"),
    (("ctx",), "string", "TRUE"),
    (("msg",), "string", "msg IS NOT NULL"),
    (("attr", "event_id"), "int", "TRUE"),
    (("attr", "value"), "float", "value IS NOT NULL"),
    (("attr", "tickets"), "int", "tickets IS NOT NULL"),
    (("attr", "numTrimmed"), "int", "num_trimmed IS NOT NULL"),
    (("attr", "message", "msg"), "string", "m_prefix IS NOT NULL"),
    (("attr", "message", "session_name"), "string", "m_prefix IS NOT NULL"),
    (("attr", "message", "ts_sec"), "int", "m_prefix IS NOT NULL"),
    (("attr", "ok"), "bool", "event_type IS NOT NULL"),
    (("attr", "error"), "string", "event_type = 'error' AND event_id % 2 = 0"),
    (("attr", "error", "errmsg"), "string", "event_type = 'error' AND event_id % 2 = 1"),
    (("attr", "uuid"), "string", "event_type = 'signup' AND event_id % 2 = 0"),
    (("attr", "uuid", "uuid", "$uuid"), "string", "event_type = 'signup' AND event_id % 2 = 1"),
    (("attr", "command"), "string", "event_type = 'view' AND event_id % 4 = 0"),
    (("attr", "command", "find"), "string", "event_type = 'view' AND event_id % 4 <> 0"),
    (("attr", "command", "q", "_id"), "int", "event_type = 'view' AND event_id % 4 = 1"),
    (("attr", "command", "q", "_id"), "string", "event_type = 'view' AND event_id % 4 = 2"),
    (("attr", "command", "q", "_id", "$oid"), "string", "event_type = 'view' AND event_id % 4 = 3"),
    (("attr", "writeConcern", "w"), "int", "event_type = 'purchase' AND event_id % 2 = 0"),
    (("attr", "writeConcern", "w"), "string", "event_type = 'purchase' AND event_id % 2 = 1"),
    (("attr", "query", "_id"), "int", "event_type = 'click' AND event_id % 2 = 0"),
    (("attr", "query", "_id", "$oid"), "string", "event_type = 'click' AND event_id % 2 = 1"),
    (("attr", "bad key-name", 0), "int", "TRUE"),
    (("attr", "bad key-name", 1), "int", "TRUE"),
]


def _text(segs, enc=None) -> str:
    out = ""
    for s in segs:
        if isinstance(s, int):
            out += f"[{s}]"
        else:
            s = enc(s) if enc else s
            out = f"{out}.{s}" if out else s
    return out


def leaves_union(enc=None) -> str:
    parts = [f"SELECT event_id, '{_text(p, enc)}' AS path, '{t}' AS type FROM f WHERE {c}"
             for p, t, c in LEAVES]
    return "\nUNION ALL\n".join(parts)


def leaf_rows(enc=None) -> str:
    return FIX + leaves_union(enc)


def path_catalog() -> str:
    return (FIX + ", lv AS (" + leaves_union() + ")\n"
            "SELECT path, type, count(*) AS n_rows, count(*) = (SELECT count(*) FROM events) AS is_static\n"
            "FROM lv GROUP BY path, type")


PAIRWISE_ROW = """, lv AS ({leaves}),
n AS (SELECT event_id,
             count(*) FILTER (WHERE type = 'string') AS n_string,
             count(*) FILTER (WHERE type = 'int') AS n_int,
             count(*) FILTER (WHERE type = 'float') AS n_float,
             count(*) FILTER (WHERE type = 'bool') AS n_bool
      FROM lv GROUP BY event_id)
SELECT f.event_id, n.n_string, n.n_int, n.n_float, n.n_bool, f.tickets, f.value, f.msg,
       f.event_type <> 'error' AS ok
FROM f JOIN n USING (event_id)"""


def pairwise_rows() -> str:
    return FIX + PAIRWISE_ROW.format(leaves=leaves_union())


NORMALIZED = """
SELECT event_id,
  CASE WHEN event_type = 'signup' THEN 'uuid-' || CAST(event_id AS VARCHAR) END AS uuid,
  CASE WHEN event_type = 'error' THEN 'disk full' END AS error_errmsg,
  CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'find' END AS command_command,
  CASE WHEN event_type = 'view' AND event_id % 4 = 1 THEN CAST(user_id AS VARCHAR)
       WHEN event_type = 'view' AND event_id % 4 = 2 THEN 's' || CAST(user_id AS VARCHAR) END
    AS command_q_id_ooid,
  CASE WHEN event_type = 'view' AND event_id % 4 = 3 THEN 'o' || CAST(user_id AS VARCHAR) END
    AS command_q_id_oid,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN CAST(event_id % 3 + 1 AS VARCHAR)
       WHEN event_type = 'purchase' THEN 'majority' END AS write_concern_w,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS query_id_ooid,
  CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN 'o' || CAST(user_id AS VARCHAR) END AS query_id_oid,
  CASE WHEN event_type = 'purchase' THEN 'STRING' END AS write_concern_w_type
FROM f"""


def normalized_rows() -> str:
    return FIX + NORMALIZED
