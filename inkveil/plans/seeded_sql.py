"""SQL twins of seeded.py."""

from __future__ import annotations

from .. import config as c
from ..operators import gates
from . import seeded as s
from .derived import relation
from .sql import HYBRID, ORACLE_SQL, digits, luhn, q, spans, values

NAMES = "field_id, " + ", ".join(s.FIELD_COLUMNS)
TEXT = "lower(concat_ws(' ', " + ", ".join(f"nullif({x}, '')" for x in s.FIELD_COLUMNS) + "))"


def ladder(rules, text: str) -> str:
    return " ".join(f"WHEN {'' if k is None else f'type = {q(k)} OR '}regexp_matches({text}, {q(p)}) THEN {q(n)}" for n, k, p in rules)


ORACLE_SQL["field_categories"] = f"""
SELECT CAST(field_id AS BIGINT) AS field_id, CASE {ladder(gates.FIELD_RULES, TEXT)} END AS category,
  CASE {ladder(gates.SEMANTIC_RULES[:6], f"regexp_replace({TEXT}, '[._-]', ' ', 'g')")} WHEN contains(autocomplete, 'name') THEN 'person_name' {ladder(gates.SEMANTIC_RULES[6:], f"regexp_replace({TEXT}, '[._-]', ' ', 'g')")} END AS semantics
FROM {relation("fields", values(s.FIELDS, NAMES), NAMES)}"""
MASKED = "(contains(text, '[REDACTED]') OR contains(text, '{{TOKEN_') OR contains(text, '[LOCAL_ONLY'))"
ORACLE_SQL["payload_firewall"] = f"""
SELECT * FROM (SELECT doc_id, CASE
  WHEN regexp_matches(text, '(?i)<script\\b|eval\\(|javascript:') THEN 'SCRIPT'
  WHEN regexp_matches(text, '(?i)^data:image/') THEN 'IMAGE_DATA'
  WHEN regexp_matches(text, {q(c.CARD)}) AND {luhn("text")} THEN 'CARD'
  WHEN regexp_matches(text, {q(c.EMAIL)}) AND NOT {MASKED} THEN 'EMAIL'
  WHEN regexp_matches(text, {q(c.PHONE)}) AND NOT {MASKED} AND NOT regexp_matches(text, '^[hH][tT][tT][pP][sS]?://') AND length({digits("text")}) >= 10
    AND NOT regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND NOT regexp_matches(text, '\\b[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\b') THEN 'PHONE' END AS reason
FROM documents) WHERE reason IS NOT NULL"""
ORACLE_SQL["response_firewall"] = f"""
SELECT CAST(response_id AS BIGINT) AS response_id, CASE WHEN NOT contains(json, '"ok"') THEN 'SHAPE' WHEN contains(json, 'Actions": {{') THEN 'NOT_AN_ARRAY'
  WHEN contains(json, '1,1,1,1,1,1,1,1,1,1,1') THEN 'TOO_MANY_ACTIONS' WHEN contains(json, '<script') THEN 'SCRIPT' WHEN contains(json, 'vaultSecret') THEN 'VAULT_SECRET'
  WHEN contains(json, 'executeDirectly') THEN 'DIRECT_EXECUTION' ELSE 'VALID' END AS verdict FROM {relation("responses", values(s.RESPONSES, "response_id, json"), "response_id, json")}"""
ORACLE_SQL["vault_store_codes"] = f"""
SELECT CAST(op_id AS BIGINT) AS op_id, CASE WHEN trim(category) = '' OR pii_id IS NULL OR length NOT BETWEEN 1 AND 10000 OR NOT purpose_ok THEN 'DENIED_INVALID_REQUEST'
  WHEN destination NOT LIKE 'LOCAL%' THEN 'DENIED_REMOTE_DESTINATION' WHEN authorized = false THEN 'DENIED_UNAUTHORIZED' WHEN policy = 'REDACT' THEN 'DENIED_INVALID_REQUEST' ELSE 'GRANTED' END AS code
FROM {relation("stores", values(s.STORES, "op_id, category, pii_id, length, purpose_ok, destination, authorized, policy"), "op_id, category, pii_id, length, purpose_ok, destination, authorized, policy")}"""
ORACLE_SQL["action_codes"] = f"""
SELECT CAST(action_id AS BIGINT) AS action_id, CASE WHEN kind = 'HACK' THEN 'DENIED_INVALID_ACTION' WHEN destination NOT LIKE 'LOCAL%' THEN 'DENIED_REMOTE_DESTINATION' WHEN NOT has_target THEN 'DENIED_INVALID_TARGET'
  WHEN kind = 'NAVIGATE' AND (url IS NULL OR url NOT LIKE 'http%:%') THEN 'DENIED_UNSAFE_ACTION' WHEN contains(parameters, 'eval(') THEN 'DENIED_UNSAFE_ACTION' ELSE 'VALID' END AS code
FROM {relation("actions", values(s.ASKED_ACTIONS, "action_id, kind, destination, has_target, url, parameters"), "action_id, kind, destination, has_target, url, parameters")}"""
ORACLE_SQL["page_protocols"] = "SELECT url ILIKE 'http:%' OR url ILIKE 'https:%' AS allowed, count(*) AS pages FROM pages GROUP BY 1"


def lists(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


TASK_ROWS = ", ".join(f"({i}, {q(t)}, {lists(n)}, {lists(m)}, {str(f).lower()}, {str(k).lower()})" for i, t, n, m, f, k in s.TASKS)
RULES = [
    ("list_contains(negated, category)", "IRRELEVANT", 0.95), ("list_contains(named, category)", "REQUIRED", None), ("intent IN ('READ_INFORMATION', 'SEARCH') AND category = 'price'", "REQUIRED", 0.9),
    ("intent IN ('READ_INFORMATION', 'SEARCH')", "IRRELEVANT", 0.9), ("contact AND category IN ('email', 'phone') AND field", "REQUIRED", 0.88), ("contact AND category IN ('email', 'phone')", "OPTIONAL", 0.75),
    ("intent IN ('LOGIN', 'VERIFY_IDENTITY') AND field", "REQUIRED", 0.9), ("intent = 'VERIFY_IDENTITY' AND category = 'otp'", "REQUIRED", 0.92), ("intent IN ('LOGIN', 'VERIFY_IDENTITY')", "OPTIONAL", 0.7),
    ("intent IN ('SUBMIT_FORM', 'ENTER_INFORMATION') AND field", "OPTIONAL", 0.75), ("intent IN ('SUBMIT_FORM', 'ENTER_INFORMATION')", "UNKNOWN", 0.6), ("len(named) > 0", "IRRELEVANT", 0.88),
]
ORACLE_SQL["task_relevance"] = f"""
SELECT task_id, category, relevance, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN relevance = 'IRRELEVANT' THEN 'UNNECESSARY' WHEN category IN ('otp', 'payment_card') THEN 'LOCAL_EXECUTION_ONLY'
  WHEN category = 'price' THEN 'CONTEXTUAL_REFERENCE' WHEN relevance = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'REMOTE_REASONING_REQUIRED' END AS necessity
FROM (SELECT CAST(task_id AS BIGINT) AS task_id, category, CASE {" ".join(f"WHEN {t} THEN '{r}'" for t, r, _ in RULES)} ELSE 'UNKNOWN' END AS relevance,
  CASE {" ".join(f"WHEN {t} THEN {'(CASE WHEN field THEN 0.96 ELSE 0.92 END)' if x is None else x}" for t, _, x in RULES)} ELSE 0.5 END AS confidence
  FROM {relation("tasks", f"(VALUES {TASK_ROWS}) AS t(task_id, intent, negated, named, field, contact)", "task_id, intent, negated, named, field, contact")}, (SELECT unnest({lists(s.TASK_CATEGORIES)}) AS category))"""
W = f"""[w FOR w IN string_split_regex(regexp_replace(lower(trim(target)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF w <> '' AND NOT list_contains({lists(gates.STOP_WORDS)}, w)]"""
CONCEPT = " + ".join(
    f"""CASE WHEN len([w FOR w IN words IF list_contains({lists(x)}, w)]) > 0 THEN (CASE WHEN kind = '{n}'{" OR kind = 'tel'" if n == "phone" else ""} THEN 80 ELSE 0 END)
      + (CASE WHEN len([x FOR x IN {lists(x)} IF contains(shown, x) OR contains(code, x)]) > 0 THEN 40 ELSE 0 END) ELSE 0 END"""
    for n, x in gates.CONCEPTS.items()
)
ORACLE_SQL["target_resolution"] = f"""
WITH e AS (SELECT *, {W} AS words FROM {relation("targets", values(s.TARGETS, "target_id, target"), "target_id, target")}, {values(s.ELEMENTS, "element_id, shown, code, kind")}),
scored AS (SELECT target_id, element_id, (CASE WHEN contains(shown, lower(target)) THEN 120 WHEN contains(code, replace(lower(target), ' ', '_')) OR contains(code, replace(lower(target), ' ', '-')) OR contains(code, replace(lower(target), ' ', '')) THEN 90 ELSE 0 END
  + coalesce(list_sum([CASE WHEN contains(shown, w) THEN 30 WHEN contains(code, w) THEN 20 ELSE 0 END FOR w IN words]), 0)
  + CASE WHEN len(words) > 1 AND len([w FOR w IN words IF contains(shown, w) OR contains(code, w)]) = len(words) THEN 50 ELSE 0 END + {CONCEPT})::BIGINT AS score FROM e)
SELECT CAST(target_id AS BIGINT) AS target_id, CAST(element_id AS BIGINT) AS element_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, element_id) AS n FROM scored) WHERE n = 1 AND score > 20"""
ORACLE_SQL["value_dedup"] = f"""
SELECT doc_id, category, normal, min("start") AS "start" FROM (SELECT *, CASE WHEN category = 'phone' AND length({digits("value")}) >= 6 THEN {digits("value")} ELSE lower(trim(value)) END AS normal FROM ({HYBRID}))
GROUP BY doc_id, category, normal"""
ORACLE_SQL["decision_badges"] = f"""
SELECT label, css, count(*) AS n FROM (SELECT CASE category WHEN 'email' THEN 'TOKENIZE' WHEN 'payment_card' THEN 'LOCAL_ONLY' ELSE 'REDACT' END AS decision FROM ({HYBRID}))
LEFT JOIN {values(s.BADGES, "decision, label, css")} USING (decision) GROUP BY label, css"""
BLOCKS = relation("blocks", values([(a, b, t, *map(float, r)) for a, b, t, *r in s.BLOCKS], "page_id, pos, text, x, y, w, h, confidence"), "page_id, pos, text, x, y, w, h, confidence")
ORACLE_SQL["ocr_blocks"] = f"""SELECT CAST(page_id AS BIGINT) AS page_id, pos, text, CAST(round(confidence / 100, 2) AS DOUBLE) AS confidence FROM {BLOCKS} WHERE trim(text) <> '' AND confidence >= 60"""
ORACLE_SQL["cover_boxes"] = f"""
SELECT CAST(page_id AS BIGINT) AS page_id, pos, greatest(0, x - 2)::DOUBLE AS x, greatest(0, y - 2)::DOUBLE AS y, (w + 4)::DOUBLE AS width, (h + 4)::DOUBLE AS height FROM {BLOCKS}"""
ORACLE_SQL["event_status"] = "SELECT count(*) AS total, min(event_id) AS first, max(event_id) AS last, count(DISTINCT user_id) AS clients FROM events"
ORACLE_SQL["event_stage_pivot"] = """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click_n, count(*) FILTER (event_type = 'error') AS error_n, count(*) FILTER (event_type = 'view') AS view_n
FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id"""
ORACLE_SQL["order_plan_summary"] = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus <> 'F') AS pending, bool_and(o_totalprice > 0) AS all_priced FROM orders GROUP BY o_orderpriority"""
ORACLE_SQL["label_line_errors"] = f"""
SELECT CAST(line_no AS BIGINT) AS line_no, CASE WHEN line = '' THEN 'EMPTY' WHEN len(f) <> 5 THEN 'FIELDS' WHEN TRY_CAST(f[1] AS INTEGER) IS NULL THEN 'CLASS' WHEN TRY_CAST(f[1] AS INTEGER) NOT BETWEEN 0 AND 15 THEN 'CLASS_RANGE'
  WHEN len([x FOR x IN f[2:5] IF TRY_CAST(x AS DOUBLE) IS NULL]) > 0 THEN 'NUMBER' WHEN len([x FOR x IN f[2:5] IF TRY_CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1]) > 0 THEN 'RANGE' ELSE 'OK' END AS reason
FROM (SELECT *, string_split_regex(trim(line), '\\s+') AS f FROM {relation("label_lines", values(s.LABEL_LINES, "line_no, line"), "line_no, line")})"""
ORACLE_SQL["page_elements"] = """SELECT page_id, least(100, len(l)) AS elements FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 0"""
ORACLE_SQL["legacy_policy"] = f"""
SELECT *, decision IN ('ALLOW', 'TOKENIZE') AS may_leave FROM (
  SELECT *, CASE WHEN classification = 'not_sensitive' THEN 'ALLOW' WHEN purpose = 'local_action' AND authorized THEN 'LOCAL_ONLY' WHEN purpose = 'remote_reasoning' AND reference THEN 'TOKENIZE' ELSE 'REDACT' END AS decision
  FROM {relation("short_policies", "(SELECT unnest(['sensitive', 'not_sensitive']) AS classification), (SELECT unnest(['remote_reasoning', 'local_action', 'other']) AS purpose), (SELECT unnest([true, false]) AS reference), (SELECT unnest([true, false]) AS authorized)", "classification, purpose, reference, authorized")})"""
ORACLE_SQL["opaque_tokens"] = f"""SELECT doc_id, "start", 'PII_TOKEN_EMAIL_' || left(sha256('bench-key:' || value), 12) AS token FROM ({spans("documents", "doc_id", "text", c.EMAIL)})"""
