"""SQL twins of planned.py."""

from __future__ import annotations

from .. import config as c
from . import planned as s
from .derived import relation
from .spoken import GOALS
from .spoken_sql import goal_parse
from .sql import ORACLE_SQL, in_, q, values

SIGN = {k: f"regexp_matches(lower(goal), {q(p)})" for k, p in c.GOAL_SIGNS.items()}


def cut(text: str) -> str:
    """text without the action and what follows it."""
    return f"CASE WHEN action IS NULL THEN {text} ELSE trim(regexp_replace({text}, '(?i)' || {q(c.BEFORE_ACTION)} || action || '\\b.*$', '')) END"


def listed(form: str, where: str = "true") -> str:
    return f"coalesce((SELECT string_agg({form}, ', ' ORDER BY pos) FROM given g WHERE g.goal_id = r.goal_id AND {where}), '')"


OPS = [
    ("navigate", "explicit"), ("search", "search"), ("filter", f"(n_given > 0 OR {SIGN['filter']})"), ("inspect", f"(chosen OR search OR ({SIGN['look']} AND NOT pressed) OR domain IN ('ecommerce', 'research'))"), ("compare", SIGN["compare"]),
    ("fill", "fill"), ("fill_form", "fill"), ("click", "send"), ("submit", "send"), ("submit_form", "send"), ("add_to_cart", SIGN["cart"]), ("submit", f"({SIGN['cart']} AND NOT send)"), ("perform_action", "acts"),
    ("extract", f"(({SIGN['extract']} OR domain = 'research') AND action IS NULL AND NOT chosen)"),
]
SPEC = f"""
WITH parsed AS ({goal_parse(GOALS + s.MORE_GOALS)}), given AS (SELECT * FROM {values(s.CONSTRAINTS, "goal_id, pos, name, operator, value, is_update")}), named AS (SELECT * FROM {values(s.ENTITIES, "goal_id, pos, preposition, text, person")}),
starts AS (SELECT * FROM {values(s.STARTS, "goal_id, url")}),
r AS (
  SELECT p.* EXCLUDE (url), g.goal, u.url, quantifier IS NOT NULL AS chosen, (click_target IS NOT NULL OR action IS NOT NULL) AS acts,
    (SELECT count(*) FROM given x WHERE x.goal_id = p.goal_id) AS n_given, (SELECT count(*) FROM given x WHERE x.goal_id = p.goal_id AND is_update) AS n_sets,
    (SELECT count(*) FROM given x WHERE x.goal_id = p.goal_id AND NOT is_update AND NOT {in_("name", c.NO_FILTER)}) AS n_filters,
    (SELECT count(*) FROM named x WHERE x.goal_id = p.goal_id) AS n_named, (SELECT count(*) FROM named x WHERE x.goal_id = p.goal_id AND person) AS n_people
  FROM parsed p JOIN {relation("goals", values(GOALS + s.MORE_GOALS, "goal_id, goal"), "goal_id, goal")} g USING (goal_id) LEFT JOIN starts u USING (goal_id)
), a AS (
  SELECT *, ({SIGN["search"]} OR domain = 'ecommerce' OR (domain = 'research' AND NOT chosen)) AS search, (acts OR {SIGN["press"]}) AS pressed,
    (n_sets > 0 OR {SIGN["fill"]} OR domain = 'form_filling') AS fill, (acts OR {SIGN["press"]} OR {SIGN["send"]}) AS send,
    trim(regexp_extract(trim(goal), {q(c.ITEM)}, 1)) AS item, regexp_replace(trim(goal), {q(c.GOAL_PREFIX)}, '') AS tail FROM r
), b AS (
  SELECT *, list_filter([{", ".join(f"CASE WHEN {t} THEN {q(n)} END" for n, t in OPS)}], lambda x: x IS NOT NULL) AS found,
    trim(regexp_replace({cut("tail")}, {q(c.GOAL_LIMITS)}, '')) AS rest FROM a
), spec AS (
  SELECT *, CASE WHEN len(found) = 0 THEN ['inspect'] ELSE found END AS ops,
    CASE WHEN click_target IS NOT NULL THEN click_target WHEN regexp_matches(trim(goal), {q(c.SEARCHED)}) THEN {cut(f"trim(regexp_extract(trim(goal), {q(c.SEARCHED)}, 1))")}
      WHEN item <> '' AND NOT {in_("lower(item)", c.NO_ITEM)} THEN item WHEN rest <> '' THEN rest WHEN domain = 'ecommerce' THEN 'item' WHEN domain = 'research' THEN 'topic' ELSE 'target' END AS entity FROM b
)"""
ORACLE_SQL["goal_spec"] = f"""{SPEC}
SELECT goal_id, array_to_string(ops, ',') AS operations, entity,
  CASE WHEN n_sets > 0 AND click_target IS NOT NULL THEN 'Update form fields and click "' || click_target || '"' WHEN n_sets > 0 THEN 'Update form field: ' || {listed("name || ' to \"' || value || '\"'", "is_update")}
    WHEN click_target IS NOT NULL THEN 'Click "' || click_target || '"' WHEN action IS NOT NULL THEN 'Find ' || coalesce(ordinal || ' ', '') || entity || ' and ' || action
    WHEN goal ILIKE '%compare%' THEN 'Find, filter, and compare options for ' || entity WHEN goal ILIKE '%add to cart%' OR goal ILIKE '%buy%' THEN 'Find and add ' || entity || ' to cart'
    WHEN chosen THEN 'Locate and interact with ' || coalesce(ordinal || ' ', '') || entity WHEN domain = 'form_filling' THEN 'Complete form workflow for ' || entity
    WHEN domain = 'research' THEN 'Research and extract information regarding ' || entity ELSE 'Accomplish user goal: ' || goal END AS summary
FROM spec r"""
TASKS = [
    ("explicit OR (blank AND domain <> 'form_filling' AND n_sets = 0 AND (search OR NOT direct))", "'navigate'", "'Navigate to appropriate website for ' || entity", "NULL"),
    (f"search AND (NOT picks OR {SIGN['any_search']})", "'search'", "'Locate search bar and enter query for \"' || entity || '\"'", "NULL"),
    ("'filter' IN ops AND n_filters > 0 AND domain NOT IN ('form_filling', 'navigation') AND n_sets = 0 AND NOT direct", "'filter'", "'Locate and apply filters matching constraints: [' || all_given || ']'", "NULL"),
    (f"n_sets > 0 OR fill OR (domain = 'form_filling' AND NOT (direct AND NOT fill AND NOT {SIGN['any_fill']}))", "'fill_form'", "CASE WHEN n_sets > 0 THEN 'Update form fields: ' || sets ELSE 'Fill out required form fields with relevant context' END", "NULL"),
    ("selects", "'select_candidate'", """CASE WHEN ordinal IS NOT NULL THEN 'Locate and select ' || ordinal || ' ' || entity || ' matching constraints' WHEN n_named > 0 THEN 'Locate and select ' || entity || ' ' || around
      WHEN domain = 'research' OR search THEN 'Inspect primary article or search result for "' || entity || '"' ELSE 'Inspect visible candidate results and verify attributes' END""", "NULL"),
    ("NOT selects AND (domain = 'navigation' OR 'inspect' IN ops) AND domain <> 'form_filling' AND n_sets = 0 AND NOT direct", "'inspect'", "'Inspect target page elements and verify content'", "NULL"),
    (SIGN["compare"], "'compare'", "'Compare inspected candidates against user constraints and select best matching options'", "NULL"),
    ("clicks", "CASE WHEN cart THEN 'add_to_cart' WHEN submits THEN 'submit_form' ELSE 'perform_action' END", "CASE WHEN cart THEN 'Add selected item to cart' ELSE 'Click \"' || aim || '\"' END", "aim"),
    ("true", "'verify_goal'", "'Verify all constraints are met and formulate final response'", "NULL"),
]
ORACLE_SQL["goal_plan"] = f"""{SPEC}, d AS (
  SELECT *, (coalesce(url, '') = '' OR {" OR ".join(f"coalesce(starts_with(url, {q(x)}), false)" for x in c.BROWSER_PAGES)}) AS blank, (chosen OR n_people > 0) AS picks,
    (send OR {SIGN["cart"]} OR {SIGN["press_or_send"]}) AS clicks, ({SIGN["cart"]} OR {SIGN["any_cart"]}) AS cart, {listed("name || ' ' || operator || ' ' || value")} AS all_given, {listed("name || ' = \"' || value || '\"'", "is_update")} AS sets,
    coalesce((SELECT string_agg(coalesce(preposition, 'matching') || ' ' || text, ' ' ORDER BY pos) FROM named n WHERE n.goal_id = r.goal_id), '') AS around FROM spec r
), e AS (
  SELECT *, (click_target IS NOT NULL OR (NOT search AND clicks AND domain <> 'ecommerce')) AS direct, coalesce(click_target, action, CASE WHEN cart THEN 'add to cart' ELSE 'submit' END) AS aim,
    (cart OR regexp_matches(lower(coalesce(click_target, action, goal)), {q(c.GOAL_SIGNS["submit"])})) AS submits FROM d
), f AS (SELECT *, ((picks OR search OR domain IN ('ecommerce', 'research')) AND n_sets = 0 AND NOT direct) AS selects FROM e),
t AS ({" UNION ALL ".join(f"SELECT goal_id, {i} AS k, {kind} AS type, {text} AS description, CAST({aim} AS VARCHAR) AS target FROM f WHERE {test}" for i, (test, kind, text, aim) in enumerate(TASKS))})
SELECT goal_id, CAST(row_number() OVER (PARTITION BY goal_id ORDER BY k) - 1 AS INTEGER) AS pos, type, description, target FROM t"""

LOW, BOTH = "lower(coalesce(text, ''))", "lower(coalesce(text, '') || ' ' || coalesce(aria_label, ''))"
CLOSER = f"""(coalesce(width > 0 AND height > 0, true) AND (regexp_matches({BOTH}, {q(c.MODAL_CLOSE)}) OR (coalesce(tag, '') = 'button' AND coalesce(text, '') = '×') OR coalesce(aria_label, '') ILIKE '%close%')
  AND (coalesce(tag, '') IN ('button', 'a', '') OR coalesce(role, '') = 'button'))"""
ORACLE_SQL["page_obstacles"] = f"""
WITH st AS {relation("states", values(s.STATES, "state_id, task_type, failures, overlay, nothing_found, replans"), "state_id, task_type, failures, overlay, nothing_found, replans")}, el AS {relation("seen", values(s.SEEN, "state_id, pos, element_id, tag, role, text, aria_label, width, height"), "state_id, pos, element_id, tag, role, text, aria_label, width, height")},
fl AS (
  SELECT state_id, bool_or(regexp_matches({LOW}, {q(c.MODAL)})) AS modal, bool_or(regexp_matches({LOW}, {q(c.NOTHING_FOUND)})) AS nothing, arg_min(element_id, pos) FILTER ({CLOSER}) AS close_id,
    arg_min(CASE WHEN coalesce(text, '') <> '' THEN text WHEN coalesce(aria_label, '') <> '' THEN aria_label ELSE 'Close' END, pos) FILTER ({CLOSER}) AS close_name,
    arg_min(element_id, pos) FILTER (regexp_matches({LOW}, {q(c.CHOOSE_CATEGORY)})) AS select_id FROM el GROUP BY state_id
), k AS (
  SELECT *, CASE WHEN (coalesce(overlay, false) OR coalesce(modal, false)) AND close_id IS NOT NULL AND coalesce(task_type, '') <> 'close_modal' THEN 'modal_overlay' WHEN coalesce(nothing_found, false) OR coalesce(nothing, false) THEN 'zero_results'
    WHEN select_id IS NOT NULL AND coalesce(task_type, '') = 'search' THEN 'category_selector' WHEN coalesce(failures, 0) >= 2 THEN 'consecutive_failures' END AS obstacle FROM st LEFT JOIN fl USING (state_id)
), o AS (SELECT *, CASE obstacle WHEN 'modal_overlay' THEN close_id WHEN 'category_selector' THEN select_id END AS target_id, coalesce(replans, 0) >= {c.MOST_REPLANS} AS spent FROM k)
SELECT CAST(state_id AS BIGINT) AS state_id, obstacle, CASE obstacle WHEN 'modal_overlay' THEN 'Dismiss modal/popup by clicking "' || close_name || '"' WHEN 'zero_results' THEN 'Zero results found matching current query and filters. Modifying search strategy.'
    WHEN 'category_selector' THEN 'Website requires selecting a category before displaying results.' WHEN 'consecutive_failures' THEN 'Encountered ' || failures || ' consecutive action failures. Adapting navigation strategy.' END AS description, target_id,
  (obstacle IS NOT NULL AND NOT spent) AS replanned,
  CASE WHEN obstacle IS NULL THEN 'Missing obstacle or planner specification.' WHEN spent THEN 'Maximum replan budget (5) exceeded. Halting plan modification.'
    {" ".join(f"WHEN obstacle = '{k}' THEN {q(why)}" + (" || target_id" if k == "modal_overlay" else "") for k, (_, why) in c.REPLAN_TASKS.items())} END AS reason,
  CASE WHEN NOT spent THEN CASE obstacle {" ".join(f"WHEN '{k}' THEN '{task}'" for k, (task, _) in c.REPLAN_TASKS.items())} END END AS new_task FROM o"""

_SECRET = f"(role = 'authentication_secret' OR {in_('category', c.SECRETS)} OR ({in_('destination', c.LOCAL)} AND {in_('category', c.CARDS)}))"
_PUBLIC = f"({in_('category', c.PUBLIC)} OR role IN ('public_product_attribute', 'contextual_reference'))"
_REMOTE, _UNKNOWN = in_("destination", c.REMOTE), "(relevance = 'UNKNOWN' AND necessity = 'UNKNOWN')"
DECISION = f"""CASE WHEN {_SECRET} AND (relevance = 'IRRELEVANT' OR necessity = 'UNNECESSARY') THEN 'REDACT' WHEN {_SECRET} THEN 'LOCAL_ONLY'
    WHEN relevance = 'IRRELEVANT' OR necessity = 'UNNECESSARY' THEN 'REDACT' WHEN {_UNKNOWN} AND {_PUBLIC} THEN 'ALLOW' WHEN {_UNKNOWN} OR detection < 0.6 THEN 'REDACT' WHEN {_PUBLIC} THEN 'ALLOW'
    WHEN {_REMOTE} AND necessity = 'LOCAL_EXECUTION_ONLY' THEN 'LOCAL_ONLY'
    WHEN {_REMOTE} AND {in_('category', c.TOKENIZABLE)} AND (necessity IN ('REMOTE_REASONING_REQUIRED', 'CONTEXTUAL_REFERENCE') OR (necessity = 'UNKNOWN' AND relevance IN ('REQUIRED', 'OPTIONAL'))) THEN 'TOKENIZE'
    WHEN {_REMOTE} THEN 'REDACT' ELSE 'LOCAL_ONLY' END"""
SHOWN = """SELECT *, CASE decision WHEN 'ALLOW' THEN value WHEN 'TOKENIZE' THEN token WHEN 'LOCAL_ONLY' THEN '[LOCAL_ONLY_PROTECTED]' ELSE '[REDACTED]' END AS dom,
    CASE decision WHEN 'ALLOW' THEN 'Clear / Visible (Safe Context)' ELSE 'Masked (Solid Black Fill)' END AS screenshot FROM (
  SELECT *, CASE decision WHEN 'TOKENIZE' THEN 'PII_TOKEN_' || upper(category) END AS token FROM (
    SELECT *, """ + DECISION + """ AS decision FROM """ + relation("mixed", values(c.MIXED_CONTENT, "item_id, category, detection, role, relevance, necessity, destination, value"), "item_id, category, detection, role, relevance, necessity, destination, value") + "))"
ORACLE_SQL["mixed_content"] = f"""
SELECT item_id, decision, dom, screenshot, CASE decision WHEN 'LOCAL_ONLY' THEN 'EXCLUDED (Zero Remote Egress)' ELSE dom END AS remote_payload,
  CASE decision WHEN 'ALLOW' THEN 'Not Stored (Public)' WHEN 'TOKENIZE' THEN 'Stored Locally in PrivacyVault (Token Map)' WHEN 'LOCAL_ONLY' THEN 'Stored Locally in PrivacyVault (Purpose Isolated)' ELSE 'Not Stored (Minimized)' END AS vault FROM ({SHOWN})"""
V = c.VIOLATIONS
ORACLE_SQL["representation_violations"] = f"""
WITH shown_ AS MATERIALIZED ({SHOWN}), i AS MATERIALIZED (SELECT * FROM {relation("represented", values(s.REPRESENTED, "item_id, decision, token, dom_masked, screenshot_masked, remote_payload"), "item_id, decision, token, dom_masked, screenshot_masked, remote_payload")}
  UNION ALL SELECT 0, decision, token, decision <> 'ALLOW', screenshot LIKE 'Masked%', CASE decision WHEN 'LOCAL_ONLY' THEN 'EXCLUDED (Zero Remote Egress)' ELSE dom END FROM shown_),
v AS (SELECT item_id, CASE decision
    WHEN 'ALLOW' THEN CASE WHEN dom_masked THEN {q(V["allow_dom"])} WHEN screenshot_masked THEN {q(V["allow_screenshot"])} END
    WHEN 'TOKENIZE' THEN CASE WHEN coalesce(token, '') = '' THEN {q(V["token"])} WHEN remote_payload <> '' AND remote_payload <> token THEN {q(V["token_payload"])} WHEN NOT screenshot_masked THEN 'TOKENIZE{V["screenshot"]}' END
    WHEN 'REDACT' THEN CASE WHEN NOT screenshot_masked THEN 'REDACT{V["screenshot"]}' WHEN remote_payload <> '' AND remote_payload <> '[REDACTED]' THEN {q(V["redact_payload"])} END
    WHEN 'LOCAL_ONLY' THEN CASE WHEN NOT screenshot_masked THEN 'LOCAL_ONLY{V["screenshot"]}' WHEN contains(remote_payload, 'secret') THEN {q(V["local_payload"])} END END AS violation FROM i)
SELECT CAST(item_id AS BIGINT) AS item_id, violation FROM v WHERE violation IS NOT NULL"""

CODE = "source"
for comment in c.SOURCE_COMMENTS:
    CODE = f"regexp_replace({CODE}, {q(comment)}, '', 'g')"
ORACLE_SQL["source_audit"] = f"""
SELECT page_id, {", ".join(f"coalesce(regexp_matches({CODE if k == 'execution_primitives' else 'source'}, {q(p)}), false) AS {k}" for k, p in c.SOURCE_RULES.items())}
FROM (SELECT CAST(page_id AS BIGINT) AS page_id, html AS source FROM pages UNION ALL SELECT CAST(page_id AS BIGINT), source FROM {values(s.SOURCES, "page_id, source")})"""


def first_of(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches(goal, {q(pattern)}) THEN regexp_extract(goal, {q(pattern)}, {group}) END"


def as_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


def price_of(pattern: str) -> str:
    amount = f"(TRY_CAST(replace({first_of(pattern)}, ',', '') AS DOUBLE) * CASE WHEN regexp_extract(goal, {q(pattern)}, 2) <> '' THEN 1000 ELSE 1 END)"
    return as_text(amount)


_RATING, _COUNT = f"TRY_CAST({first_of(c.RATING_WORD)} AS DOUBLE)", f"TRY_CAST(coalesce({first_of(c.COUNT_BEFORE)}, {first_of(c.COUNT_AFTER)}) AS BIGINT)"
_BRAND = f"lower({first_of(c.BRAND_WORD)})"
_PLAIN = [
    ("price", "<=", price_of(c.MOST_PRICE)), ("price", ">=", price_of(c.LEAST_PRICE)), ("color", "=", f"lower({first_of(c.COLOR_WORD)})"), ("brand", "=", f"upper({_BRAND}[1]) || {_BRAND}[2:]"),
    ("rating", ">=", f"CASE WHEN {_RATING} BETWEEN 1 AND 5 THEN {as_text(_RATING)} END"), ("size", "=", f"upper({first_of(c.SIZE_WORD)})"), ("candidate_count", ">=", f"CASE WHEN {_COUNT} > 0 THEN {_COUNT}::VARCHAR END"),
    ("spec", "contains", f"regexp_replace(lower({first_of(c.SPEC_WORD)}), '\\s+', '', 'g')"),
]
_ALL_GOALS = relation("goals", values(GOALS + s.MORE_GOALS, "goal_id, goal"), "goal_id, goal")
ORACLE_SQL["goal_plain_constraints"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST(goal_id AS BIGINT) AS goal_id, '{n}' AS name, '{o}' AS operator, {v} AS value FROM {_ALL_GOALS}" for n, o, v in _PLAIN) + ") WHERE value IS NOT NULL"
