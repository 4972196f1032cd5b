"""The queries of `catalog.py` as SQL over the same tables, for a check by another engine.

The SQL is written on its own terms: categories by list functions on the split action, pages
by row numbers, JSON by concatenation, outcomes of ingestion by the rules that made the input.
"""

from __future__ import annotations

from trailspark.functions.category import BUSINESS_VERBS, READ_VERBS, SECURITY_DOMAINS, SECURITY_VERBS


def _words(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


AUDIT = """
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), seeded AS (
  SELECT *, CAST(100 + (k * 7) % 500 AS VARCHAR) AS s FROM raw
), audit AS (
  SELECT event_id,
    '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    CASE event_type WHEN 'error' THEN 'gateway' WHEN 'signup' THEN 'authn-svc'
      WHEN 'purchase' THEN 'orders-svc' ELSE 'web-svc' END AS service,
    'user-' || CAST(user_id % 2 AS VARCHAR) AS actor,
    CASE event_type WHEN 'signup' THEN 'user.create' WHEN 'purchase' THEN 'order.confirm'
      WHEN 'view' THEN 'report.view' WHEN 'click' THEN 'ui.click'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'GET /admin/audit?limit=50' ELSE 'POST /checkout' END
    END AS action,
    CASE WHEN event_type = 'purchase' THEN 'order' ELSE 'user' END AS target_type,
    't-' || CAST(user_id % 3 AS VARCHAR) AS target_id,
    CASE WHEN user_id % 5 = 0 THEN 'platform' ELSE 'tenant' END AS scope_type,
    CASE WHEN user_id % 5 = 0 THEN '' ELSE 'tenant-' || CAST(user_id % 2 AS VARCHAR) END AS scope_id,
    CASE WHEN event_id % 8 = 1 THEN '{"big":12345678901234567890123456789012345678901234567890,"far":1e400,'
      || '"fine":0.1234567890123456789012345678901234567890123,"list":[-0,1.50,7],"text":"1.10"}'
      END AS before_state,
    CASE WHEN event_type = 'purchase'
      THEN '{"cents":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '}' END AS after_state,
    CASE WHEN k >= 98 THEN NULL WHEN k >= 95 THEN '{}' WHEN k >= 90 THEN '{"http_status":"n/a"}'
      WHEN k >= 80 THEN '{"http_status":"' || s || '"}' ELSE '{"http_status":' || s || '}' END AS metadata,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'req-' || CAST(event_id % 1000 AS VARCHAR) END AS request_id,
    '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS client_ip,
    ts AS created_at
  FROM seeded
), minutes AS (
  SELECT * REPLACE (CAST(date_trunc('minute', created_at) AS TIMESTAMP) AS created_at) FROM audit
)"""


def _classified(source: str) -> str:
    return f"""
split AS (
  SELECT *, string_split(action, '.') AS segs,
    CASE WHEN regexp_full_match(json_extract_string(metadata, '$.http_status'), '[0-9]+')
      THEN TRY_CAST(json_extract_string(metadata, '$.http_status') AS INTEGER) END AS status
  FROM {source}
), trail AS (
  SELECT *, CASE
    WHEN service = 'gateway' AND starts_with(action, 'GET /admin/audit') THEN 'sensitive_read'
    WHEN service = 'gateway' THEN 'router_access'
    WHEN list_has_any(segs[1:len(segs) - 1], [{_words(SECURITY_DOMAINS)}])
      OR (len(segs) > 1 AND segs[-1] IN ({_words(SECURITY_VERBS)})) THEN 'security_change'
    WHEN len(segs) > 1 AND segs[-1] IN ({_words(BUSINESS_VERBS)}) THEN 'business_mutation'
    WHEN len(segs) > 1 AND segs[-1] IN ({_words(READ_VERBS)}) THEN 'sensitive_read'
    ELSE 'system' END AS category
  FROM split
)"""


EVENT = (
    "service, actor, action, target_type, target_id, scope_type, scope_id, before_state, after_state, "
    "metadata, request_id, client_ip, created_at"
)
STORED = f"id, {EVENT}"
LIST = STORED.replace("service,", "service, category,", 1)
KEYS = "bucket_start, category, service, actor, action, target_type, target_id, scope_type, scope_id"


def _audit(select: str, *more: str) -> str:
    return "WITH " + ", ".join((AUDIT, *more)) + "\n" + select


def _trail(select: str, source: str = "audit", *more: str) -> str:
    return _audit(select, *more, _classified(source))


def _listed(where: str) -> str:
    return _trail(f"SELECT {LIST} FROM trail WHERE {where}")


def _grouped(source: str = "trail") -> str:
    return f"""
grouped AS (
  SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS bucket_start, category, service, actor, action,
    target_type, target_id, scope_type, scope_id, COUNT(*) AS count,
    COUNT(*) FILTER (WHERE status BETWEEN 200 AND 399) AS success_count,
    COUNT(*) FILTER (WHERE status >= 400) AS failure_count,
    MIN(created_at) AS first_seen, MAX(created_at) AS last_seen
  FROM {source} GROUP BY ALL
)"""


GROUP_COLUMNS = f"{KEYS}, count, success_count, failure_count, first_seen, last_seen"
TOP_GROUPS = f"SELECT {GROUP_COLUMNS} FROM grouped ORDER BY last_seen DESC, {KEYS} LIMIT 100"

CURSOR_SQL = (
    "(created_at < TIMESTAMP '2024-01-15 12:00:00' OR (created_at = TIMESTAMP '2024-01-15 12:00:00' "
    "AND id < '00000000-0000-0000-0000-000000004900'))"
)
TIME_SQL = "created_at >= TIMESTAMP '2024-01-05 06:00:00' AND created_at <= TIMESTAMP '2024-01-20 18:30:00'"


# --- JSON --------------------------------------------------------------------------------


def _time(column: str) -> str:
    return f"regexp_replace(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.0+|0+)$', '') || 'Z'"


def _object(columns: str, omitted: tuple[str, ...]) -> str:
    members = []
    for c in columns.split(", "):
        if c in ("before_state", "after_state", "metadata"):
            value = c
        elif c in ("created_at", "bucket_start", "first_seen", "last_seen"):
            value = f"'\"' || {_time(c)} || '\"'"
        else:
            value = f"CAST(to_json({c}) AS VARCHAR)"
        member = f"'\"{c}\":' || {value}"
        members.append(f"CASE WHEN {c} <> '' THEN {member} END" if c in omitted else member)
    return "'{' || concat_ws(',', " + ",\n    ".join(members) + ") || '}'"


OMITTED = ("service", "category", "request_id", "client_ip")
MESSAGE = _object(EVENT, OMITTED)

# --- ingestion ---------------------------------------------------------------------------

INTAKE = """
intake AS (
  SELECT * REPLACE (
      CASE WHEN event_id % 10 <> 9 THEN service END AS service,
      CASE WHEN event_id % 307 = 0 THEN '' WHEN event_id % 311 = 0 THEN ' ' ELSE actor END AS actor,
      CASE WHEN event_id % 313 <> 0 THEN action END AS action,
      CASE WHEN event_id % 317 = 0 THEN '' ELSE target_type END AS target_type,
      CASE WHEN event_id % 7 <> 3 THEN target_id END AS target_id,
      CASE WHEN event_id % 331 <> 0 THEN scope_type END AS scope_type,
      CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 59 = 0 THEN '{"http_status":200} x'
        WHEN event_id % 61 = 0 THEN '{''http_status'':200}' ELSE metadata END AS metadata,
      CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN TIMESTAMP '0001-01-01 00:00:00'
        ELSE created_at END AS created_at),
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id // 25 + 1 END AS batch_id
  FROM audit
), checked AS (
  SELECT *,
    CASE WHEN event_id % 307 = 0 THEN 'actor is required' WHEN event_id % 313 = 0 THEN 'action is required'
      WHEN event_id % 317 = 0 THEN 'target_type is required'
      WHEN event_id % 331 = 0 THEN 'scope_type is required' END AS reason,
    CASE WHEN event_id % 41 <> 0 AND (event_id % 59 = 0 OR event_id % 61 = 0) THEN 'encode_error' END AS encode
  FROM intake
)"""

FIRST_REASONS = """
firsts AS (
  SELECT batch_id, COUNT(*) AS n_events, arg_min(reason, event_id) FILTER (WHERE reason IS NOT NULL) AS first
  FROM checked GROUP BY batch_id
)"""

DELIVERED = f"""
sent AS (
  SELECT *, {MESSAGE} AS body FROM audit
), delivered AS (
  SELECT event_id, {EVENT},
    CASE WHEN event_id % 31 = 3 THEN left(body, length(body) - 1) WHEN event_id % 37 = 5 THEN body || ' trailing'
      WHEN event_id % 41 = 7 THEN '{{"actor":5,"action":"x"}}' WHEN event_id % 43 = 2 THEN 'null'
      WHEN event_id % 47 = 4 THEN '{{"actor":"u","created_at":"yesterday"}}' ELSE body END AS body,
    CASE WHEN event_id % 29 = 0 THEN event_id % 5 WHEN event_id % 23 = 1 THEN 0
      WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS deaths,
    event_id % 7 = 0 AS redelivered,
    event_id % 31 = 3 OR event_id % 37 = 5 OR event_id % 41 = 7 OR event_id % 43 = 2 OR event_id % 47 = 4 AS broken
  FROM sent
), judged AS (
  SELECT *, CASE WHEN deaths >= 3 THEN 'max_redeliveries' WHEN broken THEN 'decode_error' END AS reason
  FROM delivered
), good AS (
  SELECT event_id, {EVENT} FROM judged WHERE reason IS NULL
)"""

ENVELOPES = """
listed AS (
  SELECT event_id // 25 AS batch, event_id % 25 AS pos, event_id % 97 = 0 AS is_null, service, actor, action,
    target_type, target_id, scope_type, scope_id, before_state, CAST(NULL AS VARCHAR) AS after_state,
    CASE WHEN event_id % 41 <> 0 AND (event_id % 59 = 0 OR event_id % 61 = 0) THEN NULL
      WHEN event_id % 41 = 0 THEN NULL ELSE metadata END AS metadata,
    request_id, client_ip, created_at,
    CASE WHEN event_id % 97 = 0 THEN 'nil event' ELSE reason END AS reason
  FROM checked
), whole AS (
  SELECT * FROM listed WHERE batch % 20 NOT IN (3, 7)
), judged AS (
  SELECT batch, COUNT(*) AS n_events, arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL) AS reason
  FROM whole GROUP BY batch
), others AS (
  SELECT DISTINCT batch FROM listed WHERE batch % 20 IN (3, 7)
)"""

_BLANK_EVENT = ", ".join(f"CASE WHEN NOT is_null THEN {c} END AS {c}" for c in EVENT.split(", "))
_NO_EVENT = ", ".join(
    f"CAST(NULL AS {'TIMESTAMP' if c == 'created_at' else 'VARCHAR'}) AS {c}" for c in EVENT.split(", ")
)
SRC_ENVELOPE = f"""
SELECT false AS decode_error, n_events, judged.reason, CAST(pos AS INTEGER) AS pos, is_null, {_BLANK_EVENT}
FROM whole JOIN judged USING (batch)
UNION ALL
SELECT batch % 20 = 7, 0, 'events required', NULL, true, {_NO_EVENT} FROM others"""

ORACLES: dict[str, str] = {
    "src_envelope": _audit(SRC_ENVELOPE, INTAKE, ENVELOPES),
    "map_wire": _audit(
        "SELECT event_id, id, "
        + ", ".join(
            f"coalesce({c}, '') AS {c}"
            if c not in ("before_state", "after_state", "metadata", "created_at")
            else f"coalesce({c}, TIMESTAMP '2024-02-01 00:00:00') AS {c}" if c == "created_at" else c
            for c in EVENT.split(", ")
        )
        + ", reason FROM checked",
        INTAKE,
    ),
    "src_messages": _audit(f"SELECT {EVENT}, CAST(NULL AS VARCHAR) AS dead_reason FROM audit"),
    "encode_messages": _audit(f"SELECT {MESSAGE} AS value FROM audit"),
    "line_numbers": _audit(
        """, lines AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, body FROM sent
), digests AS (
  SELECT *, sha256('8:one-file;' || length(CAST(position AS VARCHAR)) || ':' || position || ';') AS h FROM lines
)
SELECT position, body,
  h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS id FROM digests""",
        DELIVERED,
    ),
    "append_events": _trail(
        f"SELECT {STORED}, status AS http_status, CAST(created_at AS DATE) AS created_date, 'load' AS batch FROM trail",
        "minutes",
    ),
    "compact_days": _trail(
        f"SELECT {STORED}, status AS http_status, CAST(created_at AS DATE) AS created_date, 'compacted' AS batch FROM trail "
        "WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
    ),
    "trail_after_compaction": _trail(
        f"SELECT {STORED}, status AS http_status, CAST(created_at AS DATE) AS created_date FROM trail"
    ),
    "trail_lookup": _listed("request_id = 'req-77'"),
    "trail_page": _trail(
        f"SELECT {LIST} FROM trail WHERE scope_type = 'tenant' AND scope_id = 'tenant-1' "
        "AND created_at BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 18:30:00' "
        "ORDER BY created_at DESC, id DESC LIMIT 100"
    ),
    "dead_letter": _audit("SELECT reason, body, deaths, redelivered FROM judged WHERE reason IS NOT NULL", DELIVERED),
    "schema_evolution": _trail(
        f"SELECT {LIST} FROM trail WHERE service <> 'web-svc' AND status >= 200",
        "evolved",
        """evolved AS (
  SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN '' ELSE service END AS service,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE request_id END AS request_id,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE client_ip END AS client_ip) FROM audit
)""",
    ),
    "event_json": _trail(f"SELECT id, {_object(LIST, OMITTED)} AS json FROM trail"),
    "group_json": _trail(f", {_grouped()}\nSELECT {_object(GROUP_COLUMNS, ('service',))} AS json FROM grouped"),
    "category": _trail("SELECT id, category FROM trail"),
    "category_counts": _trail("SELECT category, COUNT(*) AS n FROM trail GROUP BY category"),
    "http_status": _trail("SELECT id, status FROM trail"),
    "normalize": _audit(
        "SELECT id, "
        + ", ".join(
            f"nullif({c}, '') AS {c}"
            if c in ("before_state", "after_state", "metadata")
            else "coalesce(nullif(created_at, TIMESTAMP '0001-01-01 00:00:00'), TIMESTAMP '2024-02-01 00:00:00') "
            "AS created_at"
            if c == "created_at"
            else f"coalesce({c}, '') AS {c}"
            for c in EVENT.split(", ")
        )
        + " FROM intake",
        INTAKE,
    ),
    "assign_id": """
WITH hashed AS (
  SELECT event_id, sha256('6:events;' || length(CAST(event_id AS VARCHAR)) || ':' || event_id || ';') AS h FROM events
)
SELECT event_id, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS id FROM hashed""",
    "f_service": _listed("service = 'web-svc'"),
    "f_scope": _listed("scope_type = 'tenant' AND scope_id = 'tenant-1'"),
    "f_actor": _listed("actor = 'user-1'"),
    "f_action": _listed("action = 'user.create'"),
    "f_category": _listed("category = 'sensitive_read'"),
    "f_category_router": _listed("category = 'router_access'"),
    "f_target": _listed("target_type = 'order' AND target_id = 't-2'"),
    "f_request": _listed("request_id = 'req-77'"),
    "f_exclude_category": _listed("category NOT IN ('system', 'business_mutation')"),
    "f_exclude_service": _listed("service NOT IN ('gateway', 'web-svc')"),
    "f_exclude_action": _listed("action NOT IN ('ui.click', 'report.view', 'POST /checkout')"),
    "f_time": _listed(TIME_SQL),
    "f_status": _listed("status BETWEEN 200 AND 399"),
    "f_status_min": _listed("status >= 400"),
    "f_status_max": _listed("status <= 199"),
    "f_cursor": _listed(CURSOR_SQL),
    "f_bad_cursor": _listed("service = 'gateway'"),
    "f_params": _listed(
        "scope_type = 'tenant' AND status >= 400 AND service NOT IN ('gateway', 'orders-svc', 'x') "
        "AND created_at >= TIMESTAMP '2024-01-05 06:00:00'"
    ),
    "f_combined": _listed(
        "scope_type = 'tenant' AND actor = 'user-0' AND service <> 'orders-svc' AND status BETWEEN 200 AND 499 "
        f"AND {TIME_SQL} AND {CURSOR_SQL}"
    ),
    "table_status": _trail(f"SELECT {LIST} FROM trail WHERE status BETWEEN 200 AND 399", "minutes"),
    "clean_values": _audit(
        "SELECT id, service || '|' || actor || '|' || target_id AS cleaned FROM audit"
    ),
    "validate": _audit("SELECT id, actor, action FROM checked WHERE reason IS NULL", INTAKE),
    "reject_reasons": _audit(
        "SELECT coalesce(reason, encode) AS reason, COUNT(*) AS n FROM checked "
        "WHERE coalesce(reason, encode) IS NOT NULL GROUP BY ALL",
        INTAKE,
    ),
    "admit_batches": _audit(
        "SELECT batch_id, n_events, CASE WHEN n_events > 1000 "
        "THEN 'batch size ' || n_events || ' exceeds maximum 1000' ELSE first END AS reason FROM firsts",
        INTAKE, FIRST_REASONS,
    ),
    "admitted_events": _audit(
        "SELECT batch_id, id FROM checked WHERE batch_id NOT IN (SELECT batch_id FROM firsts WHERE first IS NOT NULL)",
        INTAKE, FIRST_REASONS,
    ),
    "poison_split": _audit("SELECT event_id, deaths, deaths >= 3 AS poison FROM delivered", DELIVERED),
    "kafka_poison": _audit("SELECT event_id, deaths, deaths >= 3 AS poison FROM delivered", DELIVERED),
    "event_list": _trail(
        f"SELECT {LIST} FROM trail WHERE category = 'security_change' ORDER BY created_at DESC, id DESC LIMIT 101",
        "minutes",
    ),
    "event_page": _trail(
        f""", numbered AS (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n, COUNT(*) OVER () AS total
  FROM trail WHERE category = 'security_change'
), page AS (
  SELECT *, total > 100 AS more FROM numbered WHERE n <= 100
)
SELECT {LIST}, CASE WHEN more THEN (
  SELECT translate(base64(encode(epoch_us(created_at) || '|' || id)), '+/', '-_') FROM page WHERE n = 100) END
  AS next_cursor FROM page""",
        "minutes",
    ),
    "page_after_cursor": _trail(
        f"SELECT {LIST} FROM trail WHERE category = 'security_change' "
        "ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 100",
        "minutes",
    ),
    "page_by_request": _trail(
        f"SELECT {LIST} FROM trail WHERE request_id = 'req-77' ORDER BY created_at DESC, id DESC LIMIT 50",
        "minutes",
    ),
    "page_sizes": _audit(
        """SELECT asked, id, created_at FROM (
  SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM minutes
), (VALUES (-1, 50), (0, 50), (1, 1), (100, 100), (101, 50)) AS limits(asked, size) WHERE n <= size + 1"""
    ),
    "cursor_codec": _audit(
        "SELECT id, translate(base64(encode(epoch_us(created_at) || '|' || id)), '+/', '-_') AS cursor, "
        "created_at AS decoded_time, id AS decoded_id FROM audit"
    ),
    "export_trail": _trail(f"SELECT {LIST} FROM trail WHERE category <> 'system'", "minutes"),
    "event_groups": _trail(f", {_grouped()}\n{TOP_GROUPS}"),
    "group_page": _trail(
        f", kept AS (SELECT * FROM trail WHERE category <> 'system' AND created_at <= TIMESTAMP '2024-01-20 18:30:00')"
        f", {_grouped('kept')}\n{TOP_GROUPS}",
        "minutes",
    ),
    "hourly_rollup": _trail(f", {_grouped()}\nSELECT {GROUP_COLUMNS} FROM grouped"),
    "table_rollup": _trail(f", {_grouped()}\nSELECT {GROUP_COLUMNS} FROM grouped", "minutes"),
    "bucket_histogram": _trail(
        """, totals AS (SELECT COUNT(status) AS n, CAST(SUM(status) AS BIGINT) AS s FROM trail)
, bounds AS (SELECT * FROM (VALUES ('99', 99), ('199', 199), ('299', 299), ('399', 399), ('499', 499),
  ('+Inf', 2147483647)) AS b(le, upper))
SELECT le, (SELECT COUNT(*) FROM trail WHERE status <= upper) AS bucket_count, n AS value_count, s AS value_sum
FROM bounds, totals"""
    ),
    "stream_publish": _audit(
        "SELECT "
        + ", ".join(
            c
            if c in ("before_state", "after_state", "metadata")
            else "coalesce(nullif(created_at, TIMESTAMP '0001-01-01 00:00:00'), TIMESTAMP '2024-02-01 00:00:00') "
            "AS created_at"
            if c == "created_at"
            else f"coalesce({c}, '') AS {c}"
            for c in EVENT.split(", ")
        )
        + ", CAST(NULL AS VARCHAR) AS dead_reason FROM whole JOIN judged USING (batch) WHERE judged.reason IS NULL",
        INTAKE, ENVELOPES,
    ),
    "refused_envelopes": _audit(
        """SELECT reason, n_events, COUNT(*) AS n
FROM judged WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT CASE WHEN batch % 20 = 7 THEN 'decode_error' ELSE 'events required' END, 0, COUNT(*)
FROM others GROUP BY ALL""",
        INTAKE, ENVELOPES,
    ),
    "stream_ingest": _audit(f"SELECT {EVENT} FROM good", DELIVERED),
    "replay_idempotent": _audit(f"SELECT {EVENT} FROM good", DELIVERED),
    "reread_under_another_name": _audit(f"SELECT {EVENT} FROM good", DELIVERED),
    "stream_rollup": _trail(f", {_grouped()}\nSELECT {GROUP_COLUMNS} FROM grouped", "good", DELIVERED),
    "batch_sizes": _audit(
        """, cuts AS (
  SELECT COUNT(*) AS written FROM good GROUP BY CASE WHEN event_id < 4 THEN -5 WHEN event_id < 40 THEN -4
    WHEN event_id < 120 THEN -3 WHEN event_id < 400 THEN -2 WHEN event_id < 900 THEN -1 ELSE event_id % 3 END
), bounds AS (
  SELECT * FROM (VALUES ('1', 1), ('5', 5), ('10', 10), ('25', 25), ('50', 50), ('100', 100), ('200', 200),
    ('500', 500), ('+Inf', 9223372036854775807)) AS b(le, upper)
)
SELECT le, (SELECT COUNT(*) FROM cuts WHERE written <= upper) AS bucket_count,
  (SELECT COUNT(*) FROM cuts) AS value_count, (SELECT CAST(SUM(written) AS BIGINT) FROM cuts) AS value_sum
FROM bounds""",
        DELIVERED,
    ),
    "publish_refused": _audit(
        """SELECT reason, n_events, COUNT(*) AS n
FROM judged WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT CASE WHEN batch % 20 = 7 THEN 'decode_error' ELSE 'events required' END, 0, COUNT(*)
FROM others GROUP BY ALL""",
        INTAKE, ENVELOPES,
    ),
    "publish_ledger": _audit(
        """SELECT 'documents' AS outcome, (SELECT COUNT(*) FROM judged) + (SELECT COUNT(*) FROM others) AS n
UNION ALL SELECT 'published_documents', COUNT(*) FROM judged WHERE reason IS NULL
UNION ALL SELECT 'refused_documents', (SELECT COUNT(*) FROM judged WHERE reason IS NOT NULL)
  + (SELECT COUNT(*) FROM others WHERE batch % 20 = 3)
UNION ALL SELECT 'undecodable_documents', COUNT(*) FROM others WHERE batch % 20 = 7
UNION ALL SELECT 'published_events', CAST(coalesce(SUM(n_events), 0) AS BIGINT) FROM judged WHERE reason IS NULL
UNION ALL SELECT 'refused_events', CAST(coalesce(SUM(n_events), 0) AS BIGINT) FROM judged WHERE reason IS NOT NULL""",
        INTAKE, ENVELOPES,
    ),
    "ledger": _audit(
        """SELECT 'read' AS outcome, COUNT(*) AS events FROM judged
UNION ALL SELECT 'written', COUNT(*) FROM good
UNION ALL SELECT 'max_redeliveries', COUNT(*) FROM judged WHERE reason = 'max_redeliveries'
UNION ALL SELECT 'decode_error', COUNT(*) FROM judged WHERE reason = 'decode_error'""",
        DELIVERED,
    ),
}
ORACLES["stream_relay"] = ORACLES["stream_publish"]
