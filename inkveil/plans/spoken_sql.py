"""SQL twins of spoken.py."""

from __future__ import annotations

from .. import config as c
from . import spoken as s
from .catalog import SEEDED_LINES
from .derived import relation
from .sql import ORACLE_SQL, PHONE_OK, digits, in_, luhn, q, spans, values


def first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, 1), '')"


def has(pattern: str) -> str:
    return f"regexp_matches(low, {q(pattern)})"


D = {k: has(p) for k, p in c.DOMAIN_WORDS.items()}


def named(pattern: str) -> str:
    target = f"nullif(regexp_replace(trim({first('low', pattern)}), '\\s+(?:button|btn|link)$', ''), '')"
    return f"CASE WHEN NOT {in_(target, c.NO_TARGET)} THEN {target} END"


def goal_parse(goals) -> str:
    return f"""
WITH g AS (SELECT CAST(goal_id AS BIGINT) AS goal_id, goal, lower(goal) AS low, lower(trim(goal)) AS bare FROM {relation("goals", values(goals, "goal_id, goal"), "goal_id, goal")}),
n AS (SELECT *, nullif(regexp_extract(goal, {q(c.FULL_URL)}, 0), '') AS full_url, {first("bare", c.NAMED_SITE)} AS site, {first("bare", c.OPEN_AND)} AS opened, {first("bare", c.OPEN_SITE)} AS alone FROM g),
p AS (
  SELECT *, coalesce(full_url, 'https://' || site) AS url,
    coalesce(split_part(site, '.', 1), {first("bare", c.ROOT_VERB)}, CASE WHEN NOT {in_("opened", c.NO_SITE_AND)} THEN opened END, CASE WHEN NOT {in_("alone", c.NO_SITE)} THEN alone END) AS place,
    coalesce({named(c.CLICK_LATER)}, {named(c.CLICK_NOW)}, trim({first("low", c.COMMAND)})) AS click_target FROM n
), e AS (SELECT *, (url IS NOT NULL OR place IS NOT NULL) AS explicit FROM p)
SELECT goal_id, explicit, CASE WHEN full_url IS NULL THEN place END AS destination, url,
  CASE {" ".join(f"WHEN {has(p)} THEN {q(n)}" for n, _, p in c.ORDINALS)} END AS ordinal,
  CAST(CASE {" ".join(f"WHEN {has(p)} THEN {i}" for _, i, p in c.ORDINALS)} END AS INTEGER) AS "index",
  CASE WHEN {" OR ".join(has(p) for _, _, p in c.ORDINALS)} THEN 'single' WHEN {has(c.EVERY)} THEN 'all' END AS quantifier,
  CASE WHEN {D["form"]} OR {D["change"]} OR {D["put"]} OR {D["field"]} OR ({D["paper"]} AND NOT {D["goods"]}) THEN 'form_filling'
    WHEN explicit AND NOT {D["stay"]} THEN 'navigation' WHEN {D["travel"]} AND NOT {D["fault"]} THEN 'booking'
    WHEN {D["shop"]} OR ({D["order"]} AND NOT {D["ordering"]}) THEN 'ecommerce' WHEN {D["learn"]} THEN 'research' ELSE 'general' END AS domain,
  click_target,
  CASE WHEN NOT {has(c.CART)} THEN coalesce(split_part(click_target, ' ', 1), {first("low", c.ACT_LATER)}, CASE WHEN NOT {has(c.ABOUT)} THEN {first("low", c.ACT_NOW)} END) END AS action
FROM e"""


ORACLE_SQL["goal_parse"] = goal_parse(s.GOALS)


def scrub(text: str) -> str:
    """The replacements before and after the cards; cards need their checksum."""
    x = f"regexp_replace({text}, {q(c.SENTINEL)}, '[PROTECTED_SENTINEL]', 'g')"
    x = f"regexp_replace({x}, {q(c.SPOKEN_SECRET)}, '\\1\\3\\5[PROTECTED_SECRET]', 'g')"
    x = f"regexp_replace({x}, {q(c.URL_PARAMETER)}, '\\1[PROTECTED_PARAM]', 'g')"
    parts = f"string_split(regexp_replace({x}, {q(c.STRICT_CARD)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    x = f"array_to_string([CASE WHEN j % 2 = 0 AND {luhn('v')} THEN '[CARD_NUMBER_REDACTED]' ELSE v END FOR v, j IN {parts}], '')"
    x = f"regexp_replace({x}, {q(c.EMAIL)}, '[EMAIL_REDACTED]', 'g')"
    return f"regexp_replace({x}, {q(c.LONG_ADDRESS)}, '[ADDRESS_REDACTED]', 'g')"


ORACLE_SQL["telemetry_scrub"] = f"SELECT doc_id, sha256(x) AS scrubbed_sha256 FROM (SELECT doc_id, text, {scrub('text')} AS x FROM documents) WHERE x <> text"
ORACLE_SQL["telemetry_leaks"] = f"SELECT doc_id FROM (SELECT doc_id, {scrub('text')} AS x FROM documents) WHERE regexp_matches(x, {q(c.EMAIL)})"
ORACLE_SQL["telemetry_tasks"] = f"""
SELECT record_id, task, {scrub("given")} AS summary, (text IS NULL OR task <> text OR {scrub("given")} <> given) AS had_secrets FROM (
  SELECT *, coalesce(summary, task) AS given FROM (SELECT CAST(record_id AS BIGINT) AS record_id, text, summary, {scrub("coalesce(text, '')")} AS task FROM {relation("records", values(s.RECORDS, "record_id, text, summary"), "record_id, text, summary")}))"""
ORACLE_SQL["telemetry_errors"] = f"""
SELECT CAST(error_id AS BIGINT) AS error_id, coalesce(kind, 'Error') AS kind, {scrub("message")} AS message, coalesce(code, 'ERR_RUNTIME') AS code, {scrub("lines")} AS stack
FROM (SELECT *, array_to_string(string_split(stack, chr(10))[1:5], chr(10)) AS lines FROM {relation("errors", values(s.ERRORS, "error_id, kind, message, code, stack"), "error_id, kind, message, code, stack")})"""
ORACLE_SQL["remote_strings"] = f"""
SELECT doc_id, sha256(x) AS sent_sha256 FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, {q(c.REMOTE_EMAIL)}, '[EMAIL_REDACTED]', 'g'), {q(c.REMOTE_DIGITS)}, '[CARD_REDACTED]', 'g') AS x FROM documents) WHERE x <> text"""
HALF = "floor(({}) + 0.5)"
ORACLE_SQL["model_boxes"] = f"""
WITH b AS (SELECT * FROM {relation("model_boxes", values(s.MODEL_BOXES, "box_id, x, y, w, h"), "box_id, x, y, w, h")}), u AS (
  SELECT *, greatest(x, y, w, h) <= 1 AND (w > 0 OR h > 0) AS shares, greatest(0, floor(x / 0.8 + 0.5)) AS ux, greatest(0, floor((y - 80) / 0.8 + 0.5)) AS uy FROM b)
SELECT CAST(box_id AS BIGINT) AS box_id,
  (CASE WHEN shares THEN greatest(0, floor(x * 800 + 0.5)) ELSE ux END)::DOUBLE AS b_x, (CASE WHEN shares THEN greatest(0, floor(y * 600 + 0.5)) ELSE uy END)::DOUBLE AS b_y,
  (CASE WHEN shares THEN least(800, floor(w * 800 + 0.5)) ELSE least(800 - ux, greatest(0, floor(w / 0.8 + 0.5))) END)::DOUBLE AS b_width,
  (CASE WHEN shares THEN least(600, floor(h * 600 + 0.5)) ELSE least(600 - uy, greatest(0, floor(h / 0.8 + 0.5))) END)::DOUBLE AS b_height,
  CASE WHEN w > 0 AND h > 0 THEN greatest(0, least(1, (x + w / 2) / 800))::DOUBLE END AS l_x, CASE WHEN w > 0 AND h > 0 THEN greatest(0, least(1, (y + h / 2) / 600))::DOUBLE END AS l_y,
  CASE WHEN w > 0 AND h > 0 THEN greatest(0, least(1, w / 800))::DOUBLE END AS l_width, CASE WHEN w > 0 AND h > 0 THEN greatest(0, least(1, h / 600))::DOUBLE END AS l_height
FROM u"""
ORACLE_SQL["retry_class"] = f"""
SELECT CAST(answer_id AS BIGINT) AS answer_id, CASE WHEN s = 200 THEN 'DONE' WHEN s IN (400, 401, 403, 422) THEN 'FATAL'
  WHEN s IN (408, 429, 500, 502, 503, 504) THEN CASE WHEN attempt < 3 THEN 'RETRY' ELSE 'EXHAUSTED' END ELSE 'FAILED' END AS outcome
FROM (SELECT *, coalesce(status, 500) AS s FROM {relation("answers", values(s.ANSWERS, "answer_id, status, attempt"), "answer_id, status, attempt")})"""
ORACLE_SQL["ordinal_choice"] = """
SELECT o_custkey, CAST(i AS INTEGER) AS "index", CASE WHEN i = -1 THEN l[len(l)] ELSE l[least(i + 1, len(l))] END AS o_orderkey
FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey), (VALUES (2), (-1)) v(i)"""

LINES = relation("lines", values(SEEDED_LINES, "line_id, text"), "line_id, text")
OTP = rf"(?:{c.OTP_AFTER}|{c.OTP_BEFORE}{c.OTP_FOLLOWS})"  # this engine has no lookahead; the lines have no codes that overlap


def labelled(order: int, kind: str, pattern: str, check: str, once: bool, group: str, table: str = LINES) -> str:
    return f"""SELECT {order} AS k, line_id, '{kind}' AS kind, "start" + instr(whole, value) - 1 AS "start", "start" + instr(whole, value) - 1 + length(value) AS "end", value, {str(once).lower()} AS once
      FROM (SELECT line_id, "start", value AS whole, trim({group}) AS value FROM ({spans(table, "line_id", "text", pattern)})) WHERE {check}"""


ALL = " UNION ALL ".join(
    labelled(i, kind, pattern, check, once, group)
    for i, (kind, pattern, check, once, group) in enumerate(
        [
            ("email", c.EMAIL, "true", False, "value"),
            ("phone", c.STRICT_PHONE, PHONE_OK, False, "value"),
            ("card", c.STRICT_CARD, luhn("value"), False, "value"),
            ("labelled_card", c.LABELLED_CARD, f"length({digits('value')}) >= 13", True, f"regexp_extract(value, {q(c.LABELLED_CARD)}, 1)"),
            ("ip", c.IPV4, "true", False, "value"),
            ("account", c.STRICT_ACCOUNT_ID, "true", False, "value"),
            ("name", c.LABELLED_NAME, "length(value) >= 2", False, f"regexp_extract(value, {q(c.LABELLED_NAME)}, 1)"),
            ("id", c.LABELLED_ID, "length(value) >= 2", False, f"regexp_extract(value, {q(c.LABELLED_ID)}, 1)"),
            ("otp", OTP, "length(value) >= 4", True, f"coalesce({first('value', OTP)}, regexp_extract(value, {q(OTP)}, 2))"),
            ("greeting", c.GREETING, f"length(value) >= 2 AND NOT {in_('lower(value)', c.NO_NAMES)}", True, f"regexp_extract(value, {q(c.GREETING)}, 1)"),
        ]
    )
)
ORACLE_SQL["labelled_fields"] = f"""
SELECT CAST(line_id AS BIGINT) AS line_id, kind, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", value
FROM (SELECT *, row_number() OVER (PARTITION BY line_id, value ORDER BY k, "start") AS nth FROM ({ALL})) WHERE nth = 1 OR NOT once
UNION ALL SELECT CAST(line_id AS BIGINT), 'ssn', "start", "end", value FROM ({spans(LINES, "line_id", "text", c.SSN)})"""
