"""Rows of the queries whose inputs the tables don't hold as such, derived from the given tables.

Each entry is one table, expressions in the SQL that Spark and DuckDB share, and a filter. `fed` puts a query's seeded rows, its hard
cases, before them; `relation` is the same for the SQL twins. Derived ids start at a million, so they never meet seeded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(of: str, *choices: str | bool | int | float | None) -> str:
    """One of the choices by a number column."""

    def lit(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"CASE ({of}) % {len(choices)} {' '.join(f'WHEN {i} THEN {lit(x)}' for i, x in enumerate(choices))} END"


CATEGORIES = ("email", "phone", "password_field", "otp", "payment_card", "address", "account_identifier", "person_name", "product_title", "price", "public_text")
RELEVANCE = ("REQUIRED", "OPTIONAL", "IRRELEVANT", "UNKNOWN")
PLACES = ("LOCAL_BROWSER", "REMOTE_REASONING", "REMOTE_SERVICE", "LOCAL_EXTENSION")
GOAL = (
    "CASE (conv_id + turn) % 9 WHEN 0 THEN 'Find black shoes size 10 by Nike under $' || CAST(50 + conv_id AS STRING) || ', 4.5 stars, ' || left(text, 60) WHEN 1 THEN 'add to cart the second ' || left(text, 30) WHEN 2 THEN 'open example.org and read ' || left(text, 40) "
    "WHEN 3 THEN 'Sign up with my name, do not use my credit card. ' || left(text, 40) WHEN 4 THEN 'compare the top 2 laptops with 16 GB RAM over ' || CAST(1 + turn AS STRING) || 'k ' || left(text, 40) WHEN 5 THEN 'Click on the Submit button then ' || left(text, 20) "
    "WHEN 6 THEN 'book a ticket to ' || left(text, 25) WHEN 7 THEN 'Change the email of ' || left(text, 20) ELSE left(text, 200) END AS goal"
)
BOX = ["CAST(l_quantity * 8 AS DOUBLE) AS x", "CAST(l_linenumber * 14 + l_suppkey % 9 AS DOUBLE) AS y", "CAST(40 + l_partkey % 120 AS DOUBLE) AS width", "CAST(8 + l_suppkey % 15 AS DOUBLE) AS height"]
LINE_ID, PAGE = "1000000 + l_orderkey * 10 + l_linenumber", "1000000 + l_orderkey AS page_id"
PLACE = "l_linenumber * 1000000 + l_partkey"  # lines of an order may share a number
POS = f"{PLACE} AS pos"
LINE_TEXT = f"{pick('l_partkey', 'Total', 'john', '@example.com', 'Name:', '42', '.', 'a-b')} AS text"

#: name -> table, expressions, filter
DERIVED: dict[str, tuple[str, list[str], str]] = {
    "goals": ("conversations", ["1000000 + conv_id * 1000 + turn AS goal_id", GOAL], "role = 'user' AND text IS NOT NULL"),
    "lines": (
        "customer",
        ["1000000 + c_custkey AS line_id", "'Customer Name: Ana ' || c_mktsegment || ', ID: C-' || CAST(c_custkey AS STRING) || ' card: 4111-1111-1111-111' || CAST(c_custkey % 10 AS STRING) || ' otp: ' || CAST(1000 + c_custkey AS STRING) || ' Dear ' || c_name || ' 078-05-' || CAST(1000 + c_custkey % 9000 AS STRING) AS text"],
        "c_mktsegment IS NOT NULL",
    ),
    "matrix": ("events", [f"{pick('event_id', *CATEGORIES)} AS category", f"{pick('user_id', *RELEVANCE)} AS relevance", f"{pick('event_id + user_id', *PLACES)} AS destination", "event_id % 3 = 0 AS authorized", "CASE WHEN value > 20 THEN 0.9 ELSE 0.5 END AS detection"], "value IS NOT NULL"),
    "boxes": ("lineitem", [f"CAST({LINE_ID} AS DOUBLE) AS id", *BOX], "l_linenumber <= 4"),
    "evidence": ("events", [f"{pick('event_id', *CATEGORIES, 'unlisted')} AS category", "user_id % 5 AS evidence_no"], "true"),
    "vault": ("customer", ["1000000 + c_custkey AS vault_id", f"{pick('c_custkey', 'ACTIVE', 'ACTIVE', 'REVOKED', 'EXPIRED', 'ACTIVE')} AS state", "500 + c_custkey % 1500 AS expires_ms", f"{pick('c_custkey', 'login', 'checkout', 'login')} AS purpose"], "true"),
    "vault_asks": ("events", ["1000000 + event_id AS ask_id", "1000000 + user_id AS vault_id", f"{pick('event_id', 'LOCAL_BROWSER', 'LOCAL_EXTENSION', 'REMOTE_SERVICE')} AS destination", "event_id % 7 <> 0 AS authorized", f"{pick('event_id', 'login', 'login', 'checkout', 'login')} AS wanted"], "true"),
    "elements": (
        "lineitem",
        [PAGE, POS, "'e' || CAST(l_linenumber AS STRING) AS element_id", "'n' || CAST(l_partkey AS STRING) AS node_id", f"{pick('l_linenumber', 'email', 'password', 'card_number', '', 'address', 'price')} AS category", f"{pick('l_suppkey', 'text', 'password', 'search', 'text', 'text')} AS type",
         f"{pick('l_partkey', '', 'cc-number', 'street-address', '', 'username')} AS autocomplete", f"{pick('l_suppkey', 'billing street', 'send_to', 'q', 'total', 'ship zip', 'login')} AS names", f"{pick('l_suppkey', '', '', 'searchbox')} AS role"],
        "true",
    ),
    "items": (
        "lineitem",
        [PAGE, f"{pick('l_linenumber', 'e', 'x', 'y')} || CAST(l_linenumber AS STRING) AS item_id", "CASE WHEN l_linenumber % 3 = 1 THEN 'n' || CAST(l_partkey AS STRING) END AS node_id", f"{pick('l_partkey', 'email', 'thing', 'card', 'home_address', 'product_title', 'login_otp', None)} AS category", f"{pick('l_partkey', None, 'send a message', None, None, 'buy')} AS request"],
        "true",
    ),
    "item_names": ("events", ["'i' || CAST(event_id AS STRING) AS item_id", f"{pick('event_id', 'email', 'phone', 'card', 'Price', None, 'address', 'k')} AS category"], "true"),
    "relevance": ("events", ["1000000 + event_id AS pos", "CASE WHEN event_id % 3 = 0 THEN 'i' || CAST(event_id AS STRING) END AS item_id", "CASE WHEN event_id % 3 <> 0 THEN CASE event_id % 2 WHEN 0 THEN 'price' ELSE 'address' END END AS category", f"{pick('event_id', *RELEVANCE)} AS relevance"], "event_id % 10 = 0"),
    "ocr_texts": ("documents", ["1000000 + doc_id AS page_id", "0 AS pos", "trim(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS text", "0.9 AS confidence"], "text IS NOT NULL AND trim(text) <> ''"),
    "placed_texts": ("lineitem", [PAGE, POS, f"{pick('l_partkey', 'Email: a@b.io', 'plain', 'ID: 77, phone', 'x')} AS text", *BOX], "true"),
    "policies": ("lineitem", [PAGE, f"{PLACE} AS rank", f"{pick('l_suppkey', 'person_name', 'id', '', 'email', 'plain')} AS category", f"{pick('l_partkey', 'TOKENIZE', 'LOCAL_ONLY', None, 'REDACT')} AS decision", f"{pick('l_partkey', 'T1', None, 'T2')} AS token", "CAST(l_quantity * 8 + l_suppkey % 60 AS DOUBLE) AS x", *BOX[1:]], "l_linenumber <= 3"),
    "entries": ("events", ["1000000 + user_id AS vault_id", f"{pick('event_id', 'ACTIVE', 'REVOKED', 'ACTIVE', 'EXPIRED')} AS state", "CAST(floor(value * 100) AS BIGINT) AS expires_ms"], "value IS NOT NULL"),
    "fields": (
        "customer",
        ["1000000 + c_custkey AS field_id", f"{pick('c_custkey', 'text', 'password', 'tel', 'email', 'text')} AS type", f"{pick('c_custkey', '', 'cc-number', '', 'one-time-code', 'given-name', 'street-address', 'nickname')} AS autocomplete", "lower(c_mktsegment) AS name", f"{pick('c_nationkey', 'customer-id', 'q', 'iban', 'zip', 'full-name', 'cvv')} AS id",
         f"{pick('c_nationkey', '', 'Search', 'Zip Code', '')} AS placeholder", "'' AS aria_label", f"{pick('c_custkey', '', 'Full name', 'Security code', '')} AS label_text"],
        "true",
    ),
    "responses": (
        "events",
        ["1000000 + event_id AS response_id",
         "CASE event_id % 7 WHEN 0 THEN '{\"ok\": true, \"status\": \"' || event_type || '\", \"recommendedActions\": []}' WHEN 1 THEN '{\"status\": \"' || event_type || '\"}' WHEN 2 THEN '{\"ok\": true, \"status\": \"X\", \"recommendedActions\": {\"a\": 1}}' "
         "WHEN 3 THEN '{\"ok\": false, \"status\": \"X\", \"recommendedActions\": [1,1,1,1,1,1,1,1,1,1,1]}' WHEN 4 THEN '{\"ok\": true, \"status\": \"' || event_type || '\", \"recommendedActions\": [{\"t\": \"<script>\"}]}' "
         "WHEN 5 THEN '{\"ok\": true, \"status\": \"X\", \"recommendedActions\": [{\"executeDirectly\": true}]}' ELSE '{\"ok\": true, \"status\": \"' || event_type || '\"}' END AS json"],
        "event_type IS NOT NULL",
    ),
    "stores": (
        "events",
        ["1000000 + event_id AS op_id", f"{pick('event_id', 'email', ' ', 'otp', 'phone')} AS category", "CASE WHEN event_id % 11 <> 0 THEN 'P' || CAST(user_id AS STRING) END AS pii_id", "CAST(floor(value * 200) AS INT) AS length", "event_id % 5 <> 0 AS purpose_ok", f"{pick('user_id', 'LOCAL_BROWSER', 'LOCAL_EXTENSION', 'REMOTE_SERVICE')} AS destination",
         "CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS authorized", f"{pick('event_id', None, 'REDACT', 'ALLOW')} AS policy"],
        "value IS NOT NULL",
    ),
    "actions": (
        "events",
        ["1000000 + event_id AS action_id", "CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'NAVIGATE' WHEN 'purchase' THEN 'SUBMIT' WHEN 'signup' THEN 'FILL' ELSE 'HACK' END AS kind", f"{pick('user_id', 'LOCAL_BROWSER', 'LOCAL_EXTENSION', 'LOCAL_BROWSER', 'REMOTE_SERVICE')} AS destination", "event_id % 7 <> 0 AS has_target",
         f"{pick('event_id', 'https://a.b/', 'javascript:x', None, 'http://c.d/')} AS url", "CASE WHEN event_id % 13 = 0 THEN '{\"text\": \"eval(1)\"}' ELSE props END AS parameters"],
        "props IS NOT NULL",
    ),
    "tasks": (
        "events",
        ["1000000 + event_id AS task_id", f"{pick('event_id', 'READ_INFORMATION', 'LOGIN', 'VERIFY_IDENTITY', 'CONTACT', 'SUBMIT_FORM', 'ENTER_INFORMATION', 'OTHER')} AS intent", f"split({pick('user_id', 'phone', 'none', 'otp,email')}, ',') AS negated", f"split({pick('event_id', 'email', 'price,phone', 'other')}, ',') AS named", "event_id % 2 = 0 AS field", "user_id % 4 = 0 AS contact"],
        "true",
    ),
    "targets": ("customer", ["1000000 + c_custkey AS target_id", f"{pick('c_custkey', 'phone number', 'the email of ', 'confirm order ', 'message to ', 'cancel', 'nothing like ')} || lower(c_mktsegment) AS target"], "true"),
    "blocks": ("lineitem", [PAGE, POS, LINE_TEXT, *BOX, "CAST(l_discount * 1000 AS DOUBLE) AS confidence"], "true"),
    "fusable": ("lineitem", [PAGE, POS, f"{pick('l_partkey', 'email', 'EMAIL_FIELD', 'phone', 'card', 'first_name', 'person_name')} AS category", f"{pick('l_suppkey', 'dom', 'ocr')} AS source", f"split({pick('l_suppkey', 'DOM_SEMANTIC,PATTERN', 'OCR_VISUAL,PATTERN', 'CHECKSUM')}, ',') AS evidence", *BOX], "true"),
    "label_lines": (
        "lineitem",
        [f"{LINE_ID} AS line_no", f"CAST(l_partkey % 18 AS STRING) || ' ' || CAST(CAST(l_discount AS DECIMAL(6,2)) AS STRING) || ' ' || CAST(CAST(l_tax AS DECIMAL(6,2)) AS STRING) || {pick('l_suppkey', ' 0.5 0.25', ' 0.5', ' 0.5 x', ' 1.5 0.5', '  0.1   1 ')} AS line"],
        "true",
    ),
    "short_policies": ("events", [f"{pick('event_id', 'sensitive', 'not_sensitive', 'sensitive')} AS classification", f"{pick('user_id', 'remote_reasoning', 'local_action', 'other')} AS purpose", "event_id % 2 = 0 AS reference", "event_id % 5 < 2 AS authorized"], "true"),
    "records": (
        "conversations",
        ["1000000 + conv_id * 1000 + turn AS record_id", f"left(text, 200) || {pick('conv_id + turn', ' login with password hunter2', '', ' see https://a.b/?Token=abc&x=1', ' pay 4111 1111 1111 1111 now', ' mail a@b.io')} AS text", f"CASE WHEN turn % 2 = 0 THEN 'OTP 4821 ' || left(text, 20) END AS summary"],
        "text IS NOT NULL",
    ),
    "errors": ("events", ["1000000 + event_id AS error_id", "CASE WHEN event_id % 4 > 0 THEN event_type END AS kind", f"event_type || {pick('event_id', ' token=abc is bad', ' mail a@b.io', ' plain')} AS message", "CASE WHEN user_id % 2 = 0 THEN 'E' || CAST(user_id AS STRING) END AS code", "'a' || chr(10) || 'pin: ' || CAST(event_id AS STRING) || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e' || chr(10) || 'f' AS stack"], "event_type IS NOT NULL"),
    "model_boxes": ("lineitem", [f"{LINE_ID} AS box_id", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity * 10 END AS x", "CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE CAST(l_partkey % 640 AS DOUBLE) END AS y", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 2 ELSE CAST(l_suppkey % 700 AS DOUBLE) END AS width", "CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 3 ELSE CAST(l_suppkey % 90 AS DOUBLE) END AS height"], "true"),
    "answers": ("events", ["1000000 + event_id AS answer_id", f"{pick('event_id', 200, 408, 429, 503, 401, 422, 418, None, 500)} AS status", "CAST(user_id % 5 AS INT) AS attempt"], "true"),
    "states": ("orders", ["1000000 + o_orderkey AS state_id", f"{pick('o_orderkey', 'search', 'filter', 'close_modal', None)} AS task_type", "CAST(o_custkey % 4 AS INT) AS failures", "o_orderkey % 5 = 0 AS overlay", "o_orderkey % 7 = 0 AS nothing_found", "CAST(o_custkey % 6 AS INT) AS replans"], "true"),
    "seen": (
        "lineitem",
        ["1000000 + l_orderkey AS state_id", POS, "'e' || CAST(l_linenumber AS STRING) AS element_id", f"{pick('l_partkey', 'div', 'button', 'a', 'span', 'p')} AS tag", f"{pick('l_suppkey', None, 'button', None)} AS role", f"{pick('l_partkey', 'We use cookies', 'Accept all', 'Close', 'text', None, 'No results found for x', 'enclosed')} AS text",
         f"{pick('l_suppkey', None, None, 'Dialog-closer', None)} AS aria_label", "CAST(l_linenumber % 3 AS DOUBLE) AS width", "CAST(l_partkey % 50 AS DOUBLE) AS height"],
        "true",
    ),
    "mixed": (
        "events",
        ["'ev' || CAST(event_id AS STRING) AS item_id", f"{pick('event_id', *CATEGORIES)} AS category", "CASE WHEN value > 20 THEN 0.95 ELSE 0.5 END AS detection", f"{pick('user_id', 'recipient', 'public_product_attribute', 'authentication_secret', 'account_identifier')} AS role", f"{pick('user_id', *RELEVANCE)} AS relevance",
         f"{pick('event_id', 'UNNECESSARY', 'REMOTE_REASONING_REQUIRED', 'CONTEXTUAL_REFERENCE', 'LOCAL_EXECUTION_ONLY', 'UNKNOWN')} AS necessity", f"{pick('event_id + user_id', *PLACES)} AS destination", "event_type AS value"],
        "value IS NOT NULL",
    ),
    "represented": ("events", ["1000000 + event_id AS item_id", f"{pick('event_id', 'ALLOW', 'TOKENIZE', 'REDACT', 'LOCAL_ONLY', None)} AS decision", f"{pick('user_id', None, 'T1', '')} AS token", "event_id % 2 = 0 AS dom_masked", "event_id % 3 = 0 AS screenshot_masked", f"{pick('event_id + user_id', 'T1', '[REDACTED]', 'raw', '', 'T2')} AS remote_payload"], "true"),
    "plan_ops": (
        "events",
        ["user_id AS session", "event_id AS op_id", "ts AS moment", "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'insert' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'replace' END ELSE 'complete' END AS op",
         f"split(CASE event_type WHEN 'signup' THEN {pick('event_id', 'navigate,search,filter,select_candidate,verify_goal', 'fill_form,submit_form,verify_goal', 'search,compare,add_to_cart,verify_goal', 'inspect')} WHEN 'view' THEN {pick('event_id', 'close_modal', 'scroll')} ELSE {pick('event_id', 'search,select_candidate', 'scroll,inspect,verify_goal', 'search')} END, ',') AS types"],
        "user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL",
    ),
    "checked_goals": (
        "orders",
        ["o_orderkey AS goal_id", f"{pick('o_orderkey', 'Find shoes', 'Add to cart the blue lamp', 'click the button', 'compare two phones', 'buy now the red pen', 'fill out the form', 'please register me', 'star the repository')} AS request",
         f"{pick('o_custkey', 'find it', None, 'confirm and go', 'look around')} AS summary", f"split({pick('o_orderkey', 'search,filter', 'add_to_cart', 'click,submit', 'search,compare', 'inspect', 'fill,fill_form', 'submit_form', 'perform_action')}, ',') AS operations",
         f"{pick('o_orderkey', None, None, 'save', None, None, None, None)} AS click_target", f"{pick('o_custkey', None, 'Star', 'open', None, 'subscribe')} AS action", f"{pick('o_orderkey', 'ecommerce', 'general', 'form_filling')} AS domain", "o_custkey % 3 = 0 AS picks",
         f"{pick('o_custkey', 'price', 'brand', 'candidate_count', None, 'rating')} AS c_name", f"{pick('o_custkey', '<=', '=', '=', None, '>=')} AS c_operator", f"{pick('o_custkey', '20000', 'ACME', '3', None, '4.5')} AS c_value", "o_orderkey % 10 = 3 AS c_update"],
        "true",
    ),
    "goal_actions": (
        "lineitem",
        ["l_orderkey AS goal_id", f"{pick('l_partkey', 'CLICK', 'TYPE', 'SCROLL', 'NAVIGATE', 'SUBMIT', 'WAIT', None)} AS kind", f"{pick('l_suppkey', 'typed into search box', 'Subscribe to it', 'look', 'Add to cart', 'go on', 'order placed', None)} AS reason",
         f"{pick('l_partkey', None, 'star', None, 'scroll')} AS action", f"{pick('l_suppkey', 'e1', None, 'bag', 'save_all', 'checkout link')} AS target", "'n' || CAST(l_linenumber AS STRING) AS target_id"],
        "l_orderkey % 9 > 0",
    ),
    "goal_tasks": (
        "lineitem",
        ["l_orderkey AS goal_id", POS, f"{pick('l_partkey', 'search', 'filter', 'inspect', 'submit_form', 'verify_goal', 'perform_action', 'navigate')} AS type", f"{pick('l_suppkey', 'do the task', '', 'go there')} AS description", f"{pick('l_partkey + l_suppkey', 'completed', 'COMPLETED', 'pending', 'completed', 'completed')} AS status",
         f"{pick('l_suppkey', 'CLICK', None)} AS action_kind", f"{pick('l_partkey', None, 'share', 'read')} AS action"],
        "l_orderkey % 4 > 0",
    ),
    "goal_candidates": (
        "lineitem",
        ["l_orderkey AS goal_id", "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS price", f"{pick('l_partkey', 'acme', 'Other', None)} AS brand", f"{pick('l_suppkey', '4.7', '3', 'good', None)} AS rating"],
        "l_orderkey % 5 > 1",
    ),
    "live_elements": (
        "lineitem",
        ["l_orderkey % 500 AS page_id", f"l_orderkey * 10000000 + {PLACE} AS pos", "'e' || CAST(l_partkey AS STRING) AS element_id", "'d' || CAST(l_suppkey AS STRING) AS dom_id", f"{pick('l_partkey', 'q', None, 'field', 'mail', '')} AS name",
         f"{pick('l_suppkey', 'Search here', None, 'Your E-Mail', '')} AS placeholder", f"{pick('l_partkey', None, 'Close dialog', 'Open the menu')} AS aria_label", f"{pick('l_suppkey', 'Buy now', 'Add to cart', None, 'More results', 'Terms')} || CAST(l_partkey % 50 AS STRING) AS text", f"{pick('l_partkey', None, 'email', None, 'search', None, 'price', None)} AS semantic_type", "l_partkey % 3 = 0 AS sponsored"],
        "l_orderkey % 500 > 20",
    ),
    "stale_refs": (
        "orders",
        ["o_orderkey AS ref_id", "o_orderkey % 500 AS page_id", f"CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'window' WHEN 2 THEN 'n7' WHEN 3 THEN 'e' || CAST(o_custkey AS STRING) WHEN 4 THEN 'd' || CAST(o_custkey % 20 AS STRING) WHEN 5 THEN '' ELSE 'gone' END AS target_id", "o_custkey % 9 = 0 AS stale",
         f"{pick('o_custkey', None, None, 'email', None, None, '')} AS semantic_type", f"{pick('o_orderkey', None, 'nobody', None, 'mail', None, None, None)} AS name", f"{pick('o_custkey', None, ' Cart1 ', None, 'MENU')} AS label", f"{pick('o_orderkey', None, None, 'search HERE', None, None)} AS placeholder", "CASE WHEN o_custkey % 3 > 0 THEN 'now' || CAST(o_custkey % 60 AS STRING) END AS text",
         f"{pick('o_custkey', 'abc', None, 'close')} AS aria_label"],
        "true",
    ),
    "live_nodes": ("supplier", ["s_suppkey % 500 AS page_id", f"{pick('s_suppkey', 'n7', 'window', 'n8')} AS key"], "true"),
}


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, before costly expressions: a file of few row groups is read by as few tasks, whatever the cluster."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions, where = DERIVED[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*expressions)


def fed(spark: SparkSession, sf_dir: str, name: str, rows: list, schema: str) -> DataFrame:
    """The seeded rows and the derived ones, in the schema of the former."""
    seeded = spark.createDataFrame(rows, schema)
    return seeded.unionByName(derived(spark, sf_dir, name).select(*[F.col(f.name).cast(f.dataType) for f in seeded.schema.fields]))


def relation(name: str, seeded: str, names: str) -> str:
    """A SQL relation of the seeded rows (a relation with these names) and the derived ones."""
    table, expressions, where = DERIVED[name]
    return f"(SELECT {names} FROM {seeded} UNION ALL SELECT * FROM (SELECT {', '.join(expressions)} FROM {table} WHERE {where}) AS d({names}))"
