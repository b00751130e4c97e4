"""SQL twins of context.py."""

from __future__ import annotations

from .. import config as c
from . import context as s
from .derived import relation
from .spoken_sql import OTP, first, labelled
from .sql import ORACLE_SQL, PHONE_OK, digits, in_, luhn, q, values


def normal(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return "CASE " + " ".join(f"WHEN contains({low}, {q(p)}) THEN {q(n)}" for p, n in c.CATEGORY_PARTS) + f" ELSE {low} END"


def has(k: str, text: str = "names") -> str:
    return f"regexp_matches({text}, {q(c.ROLE_WORDS[k])})"


def auto(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(auto, {q(p)})" for p in parts) + ")"


RULES = [
    (f"kind = 'password' OR {auto('password')} OR cat IN ('password_field', 'otp') OR {has('secret')}", "authentication_secret", 0.96),
    (f"cat = 'payment_card' OR {auto('cc-', 'card', 'billing')} OR {has('billing')}", "billing_information", 0.94),
    (f"(cat = 'address' AND NOT contains(names, 'billing')) OR {auto('shipping', 'street-address', 'postal-code')} OR {has('shipping')}", "shipping_information", 0.90),
    (f"{has('recipient')} OR coalesce({has('sending', 'lower(request)')}, false)", "recipient", 0.88),
    (f"cat IN ('email', 'phone', 'account_identifier', 'person_name') OR {auto('email', 'username', 'tel')} OR {has('account')}", "account_identifier", 0.90),
    (f"{in_('cat', c.PUBLIC)} OR {has('product')}", "public_product_attribute", 0.95),
    (f"kind = 'search' OR coalesce(role_ = 'searchbox', false) OR {has('search')}", "search_target", 0.92),
]
ORACLE_SQL["semantic_roles"] = f"""
WITH i AS (SELECT *, {normal("category")} AS cat FROM {relation("items", values(s.ITEMS, "page_id, item_id, node_id, category, request"), "page_id, item_id, node_id, category, request")}),
e AS (SELECT *, {normal("category")} AS ecat FROM {relation("elements", values(s.ELEMENTS, "page_id, pos, element_id, enode, category, type, autocomplete, names, role"), "page_id, pos, element_id, enode, category, type, autocomplete, names, role")}),
m AS (SELECT i.page_id, i.item_id, min(pos) AS pos FROM i JOIN e ON i.page_id = e.page_id AND (i.item_id = e.element_id OR i.node_id = e.enode OR i.cat = e.ecat) GROUP BY ALL),
r AS (
  SELECT i.page_id, i.item_id, m.pos, i.cat, i.request, lower(coalesce(e.type, '')) AS kind, lower(coalesce(e.autocomplete, '')) AS auto, lower(coalesce(e.names, '')) AS names, e.role AS role_
  FROM i LEFT JOIN m USING (page_id, item_id) LEFT JOIN e ON e.page_id = i.page_id AND e.pos = m.pos)
SELECT CAST(page_id AS BIGINT) AS page_id, item_id, CAST(pos AS INTEGER) AS pos, CASE {" ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in RULES)} ELSE 'general_data' END AS role,
  CAST(CASE {" ".join(f"WHEN {t} THEN {v}" for t, _, v in RULES)} ELSE 0.7 END AS DOUBLE) AS confidence FROM r"""
ORACLE_SQL["item_relevance"] = f"""
WITH r AS {relation("relevance", values(s.RELEVANCE, "pos, item_id, category, relevance"), "pos, item_id, category, relevance")}
SELECT i.item_id, i.category, coalesce((SELECT arg_max(relevance, pos) FROM r WHERE r.item_id = i.item_id), (SELECT arg_max(relevance, pos) FROM r WHERE r.category = lower(i.category)), 'UNKNOWN') AS relevance
FROM {relation("item_names", values([(i, k) for _, i, _, k, _ in s.ITEMS], "item_id, category"), "item_id, category")} i"""

OCR = relation("ocr_texts", values([(p, n, t, k) for p, n, t, *_, k in s.BLOCKS], "page_id, pos, text, sure"), "page_id, pos, text, sure")
TEXTS = f"(SELECT page_id * 10 + pos AS line_id, trim(text) AS text FROM {OCR} WHERE trim(text) <> '')"
KINDS = [
    ("email", c.EMAIL, "true", False, "value"), ("phone", c.STRICT_PHONE, PHONE_OK, False, "value"), ("card", c.STRICT_CARD, luhn("value"), False, "value"),
    ("labelled_card", c.LABELLED_CARD, f"length({digits('value')}) >= 13", True, f"regexp_extract(value, {q(c.LABELLED_CARD)}, 1)"), ("ip", c.IPV4, "true", False, "value"), ("account", c.STRICT_ACCOUNT_ID, "true", False, "value"),
    ("name", c.LABELLED_NAME, "length(value) >= 2", False, f"regexp_extract(value, {q(c.LABELLED_NAME)}, 1)"), ("id", c.LABELLED_ID, "length(value) >= 2", False, f"regexp_extract(value, {q(c.LABELLED_ID)}, 1)"),
    ("otp", OTP, "length(value) >= 4", True, f"coalesce({first('value', OTP)}, regexp_extract(value, {q(OTP)}, 2))"), ("greeting", c.GREETING, "length(value) >= 2", True, f"regexp_extract(value, {q(c.GREETING)}, 1)"),
]
FOUND = " UNION ALL ".join(labelled(i, *k, table=TEXTS) for i, k in enumerate(KINDS))
SURE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.KIND_CONFIDENCE.items()) + " END"
ORACLE_SQL["ocr_pii"] = f"""
WITH b AS (SELECT page_id * 10 + pos AS line_id, page_id, pos, sure FROM {OCR})
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(pos AS INTEGER) AS pos, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.KIND_TYPE.items())} END AS type, value,
  round(least(1.0, CAST(coalesce(sure, 0.95) AS DOUBLE) * CAST({SURE} AS DOUBLE)), 2) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY line_id, value ORDER BY k, "start") AS nth FROM ({FOUND})) JOIN b USING (line_id) WHERE nth = 1 OR NOT once"""
ORACLE_SQL["block_policies"] = f"""
WITH b AS {relation("placed_texts", values([(p, n, t, *map(float, x)) for p, n, t, *x, _ in s.BLOCKS], "page_id, pos, text, x, y, w, h"), "page_id, pos, text, x, y, w, h")},
r AS {relation("policies", values([(*p[:5], *map(float, p[5:])) for p in s.POLICIES], "page_id, rank, category, decision, token, rx, ry, rw, rh"), "page_id, rank, category, decision, token, rx, ry, rw, rh")},
m AS (
  SELECT b.page_id, b.pos, arg_min(coalesce(decision, 'REDACT'), rank) AS decision, arg_min(struct_pack(t := token), rank).t AS token FROM b JOIN r USING (page_id)
  WHERE (least(w * h, rw * rh) > 0 AND greatest(0, least(x + w, rx + rw) - greatest(x, rx)) * greatest(0, least(y + h, ry + rh) - greatest(y, ry)) >= 0.25 * least(w * h, rw * rh))
    OR (abs(x + w / 2 - rx - rw / 2) <= 20 AND abs(y + h / 2 - ry - rh / 2) <= 20)
    OR (category <> '' AND (contains(lower(text), lower(category)) OR regexp_matches(lower(category), 'password|card|email|phone'))) GROUP BY ALL)
SELECT CAST(b.page_id AS BIGINT) AS page_id, CAST(b.pos AS INTEGER) AS pos, m.decision, m.token FROM b LEFT JOIN m USING (page_id, pos)"""
ORACLE_SQL["prompt_scrub"] = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
v AS (SELECT conv_id, [w FOR w IN string_split(arg_min(text, struct_pack(a := turn, b := text)), ' ') IF length(w) > 4][1:3] AS l FROM t GROUP BY conv_id),
o AS (SELECT conv_id, list(w ORDER BY length(w) DESC, w) AS l FROM (SELECT DISTINCT conv_id, unnest(l) AS w FROM v) GROUP BY conv_id),
d AS (
  SELECT t.conv_id, turn, text, coalesce(l, []) AS l FROM t LEFT JOIN o USING (conv_id))
SELECT DISTINCT conv_id, turn, sha256(CASE len(l) WHEN 0 THEN text WHEN 1 THEN replace(text, l[1], '[REDACTED]') WHEN 2 THEN replace(replace(text, l[1], '[REDACTED]'), l[2], '[REDACTED]')
  ELSE replace(replace(replace(text, l[1], '[REDACTED]'), l[2], '[REDACTED]'), l[3], '[REDACTED]') END) AS scrubbed_sha256 FROM d"""
ORACLE_SQL["screen_labels"] = """
SELECT CAST(CASE WHEN regexp_matches(lower(text), 'pay|card|checkout|billing') THEN 3 WHEN regexp_matches(lower(text), 'login|register|password|email') THEN 2 ELSE 0 END AS INTEGER) AS label, count(*) AS turns
FROM conversations WHERE text IS NOT NULL GROUP BY 1"""
ORACLE_SQL["vault_sizes"] = f"""
SELECT CAST(vault_id AS BIGINT) AS vault_id, count(*) FILTER (state = 'ACTIVE' AND expires_ms > 1000) AS size FROM {relation("entries", values(s.ENTRIES, "vault_id, state, expires_ms"), "vault_id, state, expires_ms")} GROUP BY 1"""
