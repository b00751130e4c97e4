"""The reference queries in DuckDB's SQL, written independently of the Spark ones."""

from __future__ import annotations

from .. import config as c
from . import catalog as k
from .derived import relation

ORACLE_SQL: dict[str, str] = {}


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    x = f"CAST(substr(reverse({digits(v)}), i, 1) AS INTEGER)"
    total = f"list_sum([CASE WHEN i % 2 = 0 THEN (CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END) ELSE {x} END FOR i IN range(1, length({digits(v)}) + 1)])"
    return f"(length({digits(v)}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def spans(table: str, key: str, text: str, pattern: str, check: str = "true", group: bool = False) -> str:
    upto = 'coalesce(list_sum([length(p) FOR p IN parts[1:i - 1]]), 0)'
    body = f"""SELECT {key}, CAST({upto} AS BIGINT) AS "start", CAST({upto} + length(parts[i]) AS BIGINT) AS "end", parts[i] AS value
      FROM (SELECT {key}, parts, unnest(range(2, len(parts), 2)) AS i
            FROM (SELECT {key}, string_split(regexp_replace({text}, {q(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM {table}))"""
    if group:
        return f"""SELECT {key}, "end" - length(v) AS "start", "end", v AS value FROM (SELECT *, regexp_extract(value, {q(pattern)}, 1) AS v FROM ({body}))"""
    return f"SELECT * FROM ({body}) WHERE {check}"


PHONE_OK = f"length({digits('value')}) BETWEEN 7 AND 15"


def counts(key: str, text: str, table: str) -> str:
    cards = f"len([v FOR v IN regexp_extract_all({text}, {q(c.CARD)}) IF {luhn('v')}])"
    return f"SELECT {key}, len(regexp_extract_all({text}, {q(c.EMAIL)})) AS email, len(regexp_extract_all({text}, {q(c.PHONE)})) AS phone, {cards} AS payment_card FROM {table}"


CORE = " UNION ALL ".join(
    f"SELECT doc_id, '{cat}' AS category, \"start\", \"end\", value, {conf} AS confidence FROM ({spans('documents', 'doc_id', 'text', pat, check)})"
    for cat, pat, check, conf in [
        ("email", c.EMAIL, "true", 0.98),
        ("phone", c.PHONE, PHONE_OK, 0.92),
        ("payment_card", c.CARD, luhn("value"), 0.98),
        ("account_identifier", c.ACCOUNT_ID, "true", 0.5),
        ("person_name", c.PERSON_NAME, "true", 0.45),
        ("address", c.ADDRESS, "true", 0.5),
    ]
)
HYBRID = " UNION ALL ".join(
    f"SELECT doc_id, '{cat}' AS category, \"start\", \"end\", value, {conf} AS confidence FROM ({spans('documents', 'doc_id', 'text', pat, check)})"
    for cat, pat, check, conf in [
        ("email", c.EMAIL, "true", 0.98),
        ("phone", c.STRICT_PHONE, PHONE_OK, 0.92),
        ("payment_card", c.STRICT_CARD, luhn("value"), 0.95),
        ("account_identifier", c.IPV4, "true", 0.9),
        ("account_identifier", c.STRICT_ACCOUNT_ID, "true", 0.85),
    ]
)

ORACLE_SQL["doc_pii_counts"] = counts("doc_id", "text", "documents")
ORACLE_SQL["page_pii_counts"] = counts("page_id", "html", "pages")
ORACLE_SQL["doc_pii_summary"] = f"""
SELECT category, CAST(n AS BIGINT) AS n, 'ALWAYS_REDACT' AS decision FROM (
  SELECT unnest(['email', 'phone', 'payment_card']) AS category, unnest([sum(email), sum(phone), sum(payment_card)]) AS n FROM ({counts("doc_id", "text", "documents")})
) WHERE n > 0"""
ORACLE_SQL["doc_email_spans"] = spans("documents", "doc_id", "text", c.EMAIL)
ORACLE_SQL["doc_card_spans"] = spans("documents", "doc_id", "text", c.STRICT_CARD, luhn("value"))
ORACLE_SQL["doc_ip_spans"] = spans("documents", "doc_id", "text", c.IPV4)
ORACLE_SQL["doc_phone_spans"] = spans("documents", "doc_id", "text", c.STRICT_PHONE, PHONE_OK)
ORACLE_SQL["doc_name_spans"] = spans("documents", "doc_id", "text", c.PERSON_NAME)
ORACLE_SQL["doc_core_spans"] = f'SELECT doc_id, category, "start", "end", CAST(confidence AS DOUBLE) AS confidence FROM ({CORE})'
ORACLE_SQL["doc_dominant_spans"] = f"""
WITH m AS ({CORE}), d AS (SELECT * FROM m WHERE category IN ('payment_card', 'account_identifier'))
SELECT doc_id, category, "start", "end", CAST(confidence AS DOUBLE) AS confidence FROM m
WHERE category IN ('payment_card', 'account_identifier')
   OR NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = m.doc_id AND greatest(d."start", m."start") < least(d."end", m."end"))"""
ORACLE_SQL["doc_exact_merge"] = f"""
SELECT doc_id, category, "start", "end", CAST(max(confidence) AS DOUBLE) AS confidence, CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid' ELSE min(source) END AS source
FROM (SELECT *, 'core' AS source FROM ({CORE}) UNION ALL SELECT *, 'strict' FROM ({HYBRID})) GROUP BY ALL"""
ORACLE_SQL["pii_by_category"] = f"SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({HYBRID}) GROUP BY category"
ORACLE_SQL["pii_by_lang_source"] = f"""
SELECT lang, source, category, count(*) AS n FROM ({HYBRID}) JOIN documents USING (doc_id)
GROUP BY GROUPING SETS ((lang, category), (source, category), (category))"""
ORACLE_SQL["doc_masked_values"] = f"""
SELECT doc_id, category, "start", CASE
  WHEN category = 'email' THEN (CASE WHEN length(split_part(value, '@', 1)) > 2 THEN substr(value, 1, 2) ELSE substr(value, 1, 1) END) || '***@' || split_part(value, '@', 2)
  WHEN category = 'phone' THEN CASE WHEN length(value) > 6 THEN substr(value, 1, 3) || '******' || right(value, 4) ELSE '******' END
  WHEN category = 'payment_card' THEN '****-****-****-' || right({digits("value")}, 4)
  WHEN length(value) > 2 THEN substr(value, 1, 2) || '***' ELSE '***' END AS masked
FROM ({HYBRID})"""


def values(rows, names: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        return q(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


def in_(x: str, names) -> str:
    return f"{x} IN ({', '.join(map(q, names))})"


SENSITIVITY = f"""CASE WHEN {in_("category", c.CRITICAL)} THEN 'CRITICAL' WHEN {in_("category", c.HIGH)} THEN 'HIGH' WHEN category = 'public_text' THEN 'PUBLIC' WHEN {in_("category", c.PUBLIC)} THEN 'LOW' ELSE 'MEDIUM' END"""
NECESSITY = f"""CASE WHEN relevance = 'IRRELEVANT' THEN 'UNNECESSARY' WHEN {in_("category", [*c.SECRETS, *c.CRITICAL])} THEN 'LOCAL_EXECUTION_ONLY'
  WHEN {in_("category", c.PUBLIC)} THEN 'CONTEXTUAL_REFERENCE' WHEN relevance IN ('REQUIRED', 'OPTIONAL') THEN 'REMOTE_REASONING_REQUIRED' ELSE 'UNKNOWN' END"""


def decided(source: str) -> str:
    """Adds necessity, decision, reason, policy_confidence to rows with category, relevance, destination, authorized, detection."""
    secret = f"({in_('category', c.SECRETS)} OR ({in_('destination', c.LOCAL)} AND {in_('category', c.CARDS)}))"
    rungs = [
        (f"{secret} AND relevance = 'IRRELEVANT'", "REDACT", "TASK_IRRELEVANT", 0.98),
        (secret, "LOCAL_ONLY", "CRITICAL_SENSITIVITY", 0.98),
        (f"NOT {in_('destination', [*c.LOCAL, *c.REMOTE])}", "REDACT", "UNKNOWN_DESTINATION", 0.95),
        ("relevance = 'IRRELEVANT'", "REDACT", "TASK_IRRELEVANT", 0.95),
        (f"relevance = 'UNKNOWN' AND necessity = 'UNKNOWN' AND {in_('category', c.PUBLIC)}", "ALLOW", "PUBLIC_DATA_ALLOWED", 0.95),
        ("relevance = 'UNKNOWN' AND necessity = 'UNKNOWN'", "REDACT", "TASK_UNKNOWN", 0.95),
        ("detection < 0.6", "REDACT", "LOW_DETECTION_CONFIDENCE", 0.92),
        (in_("category", c.PUBLIC), "ALLOW", "PUBLIC_DATA_ALLOWED", 0.95),
        (f"{in_('destination', c.REMOTE)} AND necessity = 'LOCAL_EXECUTION_ONLY'", "LOCAL_ONLY", None, 0.98),
        (f"{in_('destination', c.REMOTE)} AND {in_('category', c.TOKENIZABLE)}", "TOKENIZE", None, 0.95),
        (in_("destination", c.REMOTE), "REDACT", None, 0.95),
        ("authorized", "ALLOW", None, 0.92),
    ]
    case = lambda pick, last: "CASE " + " ".join(f"WHEN {t} THEN {pick(r)}" for t, *r in rungs) + f" ELSE {last} END"
    level = f"CASE {SENSITIVITY} WHEN 'CRITICAL' THEN 'CRITICAL_SENSITIVITY' WHEN 'HIGH' THEN 'HIGH_SENSITIVITY' ELSE 'MEDIUM_SENSITIVITY' END"
    return f"""SELECT *, {case(lambda r: q(r[0]), "'LOCAL_ONLY'")} AS decision, {case(lambda r: q(r[1]) if r[1] else level, level)} AS reason,
      CAST({case(lambda r: r[2], 0.94)} AS DOUBLE) AS policy_confidence FROM (SELECT *, {NECESSITY} AS necessity FROM ({source}))"""


ORACLE_SQL["doc_policy_decisions"] = f"""
SELECT doc_id, category, "start", necessity, decision, reason, policy_confidence FROM ({decided(f"SELECT h.*, relevance, 'REMOTE_REASONING' AS destination, false AS authorized, confidence AS detection FROM ({HYBRID}) h LEFT JOIN {values(k.TASK_RELEVANCE, 'category, relevance')} USING (category)")})"""
_CASES = "category, relevance, destination, authorized, detection"
CROSS = f"""SELECT category, relevance, destination, authorized, CAST(detection AS DOUBLE) AS detection
  FROM {values([(x,) for x in k.POLICY_CATEGORIES], 'category')}, {values([(x,) for x in k.POLICY_RELEVANCE], 'relevance')},
       {values([(x,) for x in k.POLICY_DESTINATIONS], 'destination')}, (VALUES (true), (false)) a(authorized), (VALUES (0.5), (0.9)) d(detection)"""
CROSS = relation("matrix", f"({CROSS})", _CASES)
ORACLE_SQL["policy_matrix"] = f"SELECT category, relevance, destination, authorized, detection, necessity, decision, reason, policy_confidence FROM ({decided(f"SELECT category, relevance, destination, authorized, CAST(detection AS DOUBLE) AS detection FROM {CROSS}")})"

DISJOINT = f"""
disjoint_ AS (
  SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_min(category, o) AS category FROM (
    SELECT *, sum(CASE WHEN "start" < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, category) AS island,
      row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, category) AS o FROM (
      SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM ({HYBRID}) WHERE category IN ('email', 'payment_card', 'account_identifier'))) GROUP BY doc_id, island
), decided_ AS (
  SELECT *, CASE category WHEN 'email' THEN 'TOKENIZE' WHEN 'payment_card' THEN 'LOCAL_ONLY' ELSE 'REDACT' END AS decision,
    upper(category) || '_' || row_number() OVER (PARTITION BY doc_id, category ORDER BY "start") AS token FROM disjoint_
)"""
ORACLE_SQL["doc_tokenized"] = f"""WITH {DISJOINT} SELECT doc_id, "start", "end", token FROM decided_ WHERE decision = 'TOKENIZE'"""
SANITIZED = f"""{DISJOINT}, placed AS (
  SELECT d.doc_id, d.text, s."start", s."end", decision, token, coalesce(lag(s."end") OVER (PARTITION BY d.doc_id ORDER BY s."start"), 0) AS pos
  FROM documents d LEFT JOIN decided_ s USING (doc_id)
), sanitized_ AS (
  SELECT doc_id, any_value(text) AS text,
    coalesce(string_agg(CASE WHEN decision IS NULL THEN '' ELSE substr(text, pos + 1, "start" - pos) || CASE decision WHEN 'TOKENIZE' THEN '{{{{' || token || '}}}}' WHEN 'LOCAL_ONLY' THEN '[LOCAL_ONLY_PROTECTED]' ELSE '[REDACTED]' END END, '' ORDER BY "start"), '')
      || substr(any_value(text), coalesce(max("end"), 0) + 1) AS sanitized, count(decision) AS redacted
  FROM placed GROUP BY doc_id
)"""
ORACLE_SQL["doc_redacted_text"] = f"WITH {SANITIZED} SELECT doc_id, sha256(sanitized) AS sanitized_sha256, redacted, CAST(0 AS BIGINT) AS allowed FROM sanitized_"
SENTINELS = f"(SELECT DISTINCT doc_id, value FROM ({spans('documents', 'doc_id', 'text', c.EMAIL)}))"
ORACLE_SQL["leak_audit"] = f"WITH {SANITIZED} SELECT doc_id, value AS sentinel FROM sanitized_ JOIN {SENTINELS} USING (doc_id) WHERE contains(sanitized, value)"
ORACLE_SQL["leak_audit_control"] = f"SELECT doc_id, value AS sentinel FROM documents JOIN {SENTINELS} USING (doc_id) WHERE contains(text, value)"
ORACLE_SQL["token_secret_scrub"] = f"""
SELECT doc_id, sha256(s) AS scrubbed_sha256 FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, {q(c.INLINE_SECRET)}, '\\1[PROTECTED_SECRET]', 'g'), {q(c.URL_SECRET)}, '\\1[PROTECTED_PARAM]', 'g') AS s FROM documents
) WHERE s <> text"""
ORACLE_SQL["payload_audit"] = f"""
SELECT doc_id, errors FROM (SELECT doc_id, concat_ws(',',
  CASE WHEN regexp_matches(text, '[0-9]{{13,19}}') THEN 'DIGIT_RUN' END,
  CASE WHEN regexp_matches(text, '<[sS][cC][rR][iI][pP][tT]|[oO][nN][a-zA-Z]+=') THEN 'SCRIPT' END,
  CASE WHEN regexp_matches(text, 'data:[a-z]+/') THEN 'DATA_URL' END,
  CASE WHEN len([v FOR v IN regexp_extract_all(text, {q(c.CARD)}) IF {luhn("v")}]) > 0 THEN 'CARD' END,
  CASE WHEN regexp_matches(text, {q(c.EMAIL)}) THEN 'EMAIL' END,
  CASE WHEN strlen(text) > 250000 THEN 'SIZE' END) AS errors FROM documents) WHERE errors <> ''"""
ORACLE_SQL["pii_vs_labels"] = f"""
SELECT quality, toxic, count(*) AS docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS spans, count(n) AS docs_with_spans
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({HYBRID}) GROUP BY doc_id) USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic"""
ORACLE_SQL["unlabelled_docs"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLE_SQL["label_diff"] = """
SELECT kind, count(*) AS n FROM (
  SELECT 'unlabelled' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'orphan_label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY kind"""
ORACLE_SQL["class_distribution"] = """
SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY total), 6) AS percent FROM (
  SELECT quality, toxic, count(*) AS n, CAST(0 AS INTEGER) AS total FROM labels GROUP BY quality, toxic UNION ALL SELECT NULL, toxic, count(*), 1 FROM labels GROUP BY toxic)"""
ORACLE_SQL["page_host"] = """
SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS protocol,
  regexp_extract(html, '<html[^>]* lang="([^"]+)"', 1) AS language FROM pages"""
ORACLE_SQL["page_links"] = """
SELECT page_id, 'el_' || i AS element_id, l[i] AS href FROM (
  SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages))"""
ORACLE_SQL["page_endpoint_class"] = """
SELECT page_id, CASE WHEN url ILIKE 'https:%' THEN 'ALLOWED' WHEN url ILIKE 'http:%' AND regexp_extract(url, '://([^/:?#]+)', 1) IN ('localhost', '127.0.0.1') THEN 'ALLOWED_LOCAL'
  WHEN url ILIKE 'http:%' THEN 'DENIED_INSECURE' ELSE 'DENIED_PROTOCOL' END AS endpoint FROM pages"""
ORACLE_SQL["conv_role_turns"] = "SELECT conv_id, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id, role"
ORACLE_SQL["conv_last_n"] = """
SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS back FROM conversations) WHERE back <= 5"""
ORACLE_SQL["event_filter"] = "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 AND event_type = 'error'"
ORACLE_SQL["event_level"] = "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1"
ORACLE_SQL["event_metrics"] = """
SELECT event_type, count(*) AS total, max(j) AS max_k, round(avg(value), 6) AS mean_value, count(*) FILTER (j > 50) AS high
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS j FROM events) GROUP BY event_type"""
ORACLE_SQL["event_ring"] = "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000"
ORACLE_SQL["event_loop3"] = """
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE event_type = a AND event_type = b"""
ORACLE_SQL["event_failure_runs"] = """
SELECT user_id, min(event_id) AS first, count(*) AS run FROM (
  SELECT *, event_no - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_no FROM events))
WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 2"""
ORACLE_SQL["event_replan_budget"] = """
SELECT user_id, min(event_id) AS from_event, max(used) AS used FROM (
  SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM events) WHERE used >= 5 GROUP BY user_id"""
ORACLE_SQL["event_halted"] = """
SELECT user_id, count(*) FILTER (f IS NULL OR event_id < f) AS executed, count(*) FILTER (event_id >= f) AS not_executed
FROM events LEFT JOIN (SELECT user_id, min(event_id) AS f FROM events WHERE event_type = 'error' GROUP BY user_id) USING (user_id) GROUP BY user_id"""
ORACLE_SQL["event_sessions"] = """
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (
  SELECT user_id, s, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY user_id, s) GROUP BY user_id"""
ORACLE_SQL["event_size_gate"] = "SELECT event_id, strlen(props) AS bytes, true AS too_large FROM events WHERE strlen(props) > 8"
ORACLE_SQL["event_stale"] = """
SELECT user_id, count(*) AS stale, max(gap) AS longest_ms FROM (
  SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) // 1000 - epoch_us(ts) // 1000 AS gap FROM events) WHERE abs(gap) > 300000 GROUP BY user_id"""
BOXES = relation("boxes", values([tuple(map(float, b)) for b in k.BOXES], "id, x, y, w, h"), "id, x, y, w, h")
ORACLE_SQL["bbox_overlap"] = f"""
SELECT CAST(a.id AS BIGINT) AS a, CAST(b.id AS BIGINT) AS b FROM {BOXES} a JOIN {BOXES} b ON floor(a.id / 10) = floor(b.id / 10) AND a.id < b.id
WHERE (least(a.w * a.h, b.w * b.h) > 0 AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.25 * least(a.w * a.h, b.w * b.h))
   OR (abs(a.x + a.w / 2 - b.x - b.w / 2) <= 20 AND abs(a.y + a.h / 2 - b.y - b.h / 2) <= 20)"""


def to_bitmap(name: str, y: str) -> str:
    return f"""greatest(0, floor(x * 2 + 0.5))::DOUBLE AS {name}_x, greatest(0, floor({y} * 2 + 0.5))::DOUBLE AS {name}_y,
  least(2560 - greatest(0, floor(x * 2 + 0.5)), greatest(0, floor(w * 2 + 0.5)))::DOUBLE AS {name}_width,
  least(1440 - greatest(0, floor({y} * 2 + 0.5)), greatest(0, floor(h * 2 + 0.5)))::DOUBLE AS {name}_height"""


ORACLE_SQL["bbox_transform"] = f"""
SELECT CAST(id AS BIGINT) AS id, (x + w > 0 AND x < 1280 AND y - 40 + h > 0 AND y - 40 < 720) AS visible, {to_bitmap("v", "y")}, {to_bitmap("p", "(y - 40)")},
  floor(x / 2 + 0.5)::DOUBLE AS k_x, floor(y / 2 + 0.5)::DOUBLE AS k_y, floor(w / 2 + 0.5)::DOUBLE AS k_width, floor(h / 2 + 0.5)::DOUBLE AS k_height FROM {BOXES}"""
BASES = values([*((n, v) for n, v in c.BASE_CONFIDENCE.items()), ("unlisted", 0.5)], "category, base")
BOOSTS = values([(0, 0.0), (1, 0.15), (2, 0.12), (3, 0.18), (4, 0.37)], "evidence_no, boost")
ORACLE_SQL["confidence_table"] = f"""
SELECT category, CAST(evidence_no AS BIGINT) AS evidence_no, floor(least(0.98, greatest(0.1, coalesce(base, 0.5) + boost))::DOUBLE * 100 + 0.5) / 100 AS confidence
FROM {relation("evidence", f"(SELECT category, evidence_no FROM {BASES}, {BOOSTS})", "category, evidence_no")} LEFT JOIN {BASES} USING (category) JOIN {BOOSTS} USING (evidence_no)"""
ORACLE_SQL["vault_retrieve_codes"] = f"""
SELECT CAST(ask_id AS BIGINT) AS ask_id, CASE WHEN v.state IS NULL THEN 'DENIED_NOT_FOUND' WHEN destination NOT LIKE 'LOCAL%' THEN 'DENIED_REMOTE_DESTINATION' WHEN state = 'REVOKED' THEN 'DENIED_REVOKED'
  WHEN state = 'EXPIRED' OR expires_ms <= 1000 THEN 'DENIED_EXPIRED' WHEN NOT authorized THEN 'DENIED_UNAUTHORIZED' WHEN purpose <> wanted THEN 'DENIED_PURPOSE_MISMATCH' ELSE 'GRANTED' END AS code
FROM {relation("vault_asks", values(k.VAULT_ASKS, "ask_id, vault_id, destination, authorized, wanted"), "ask_id, vault_id, destination, authorized, wanted")} a LEFT JOIN {relation("vault", values(k.VAULT, "vault_id, state, expires_ms, purpose"), "vault_id, state, expires_ms, purpose")} v USING (vault_id)"""


def words(w: str) -> str:
    return q(rf"\b(?:{w})\b")


NEGATED = f"array_to_string(regexp_extract_all(lower(goal), {q(c.NEGATION)}, 1), ' ')"
ORACLE_SQL["task_intent"] = f"""
SELECT CAST(goal_id AS BIGINT) AS goal_id,
  CASE {" ".join(f"WHEN regexp_matches(lower(goal), {words(w)}) THEN '{i}'" for i, w, _ in c.INTENTS)} ELSE 'UNKNOWN' END AS intent,
  CAST(CASE {" ".join(f"WHEN regexp_matches(lower(goal), {words(w)}) THEN {b}" for _, w, b in c.INTENTS)} ELSE 0.5 END AS DOUBLE) AS confidence,
  concat_ws(',', {", ".join(f"CASE WHEN regexp_matches({NEGATED}, {words(w)}) THEN '{n}' END" for n, w in c.CATEGORY_WORDS.items())}) AS negated,
  concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(lower(goal), {words(w)}) AND NOT regexp_matches({NEGATED}, {words(w)}) THEN '{n}' END" for n, w in c.CATEGORY_WORDS.items())}) AS explicit
FROM {relation("goals", values(k.GOALS, "goal_id, goal"), "goal_id, goal")}"""
ORACLE_SQL["price_bracket"] = """
SELECT CAST(CASE WHEN p_retailprice < 920 THEN 1 WHEN p_retailprice < 950 THEN 2 WHEN p_retailprice < 980 THEN 3 ELSE 4 END AS BIGINT) AS bracket, count(*) AS parts, min(p_partkey) AS first_part
FROM part GROUP BY 1"""
ORACLE_SQL["candidate_division"] = "SELECT p_partkey, p_size FROM part WHERE coalesce(p_retailprice <= 960, true) AND coalesce(p_size >= 20, true) AND coalesce(lower(p_brand) = 'brand#1', true)"
ORACLE_SQL["tensor_check"] = """
SELECT label, count(*) FILTER (len(embedding) = 64) AS fits, count(*) FILTER (len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)) AS finite, count(*) AS n FROM embeddings GROUP BY label"""
