"""SQL twins of the queries on progress: plans as lists that a recursion steps through, flags as subqueries, ranks as windows."""

from __future__ import annotations

from ..operators import goals
from .derived import DERIVED, relation
from .progress import CURRENT
from .spoken import GOALS
from .spoken_sql import goal_parse
from .sql import ORACLE_SQL, q, values


def _of(name: str) -> str:
    table, expressions, where = DERIVED[name]
    return f"(SELECT {', '.join(expressions)} FROM {table} WHERE {where})"


_STEPS = f"""
WITH RECURSIVE o AS (SELECT session, op_id, moment, op, [{{'t': x, 'd': x || ' of ' || CAST(op_id AS VARCHAR)}} FOR x IN types] AS given, [false FOR x IN types] AS undone,
  sum(CASE WHEN op = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY moment, op_id) AS run FROM {_of("plan_ops")}),
n AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY moment, op_id) AS k FROM o),
s AS (
  SELECT DISTINCT session, run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS op_id, CAST(NULL AS VARCHAR) AS op, given[1:0] AS plan, undone[1:0] AS done, CAST(0 AS BIGINT) AS idx FROM n
  UNION ALL
  SELECT n.session, n.run, n.k, n.op_id, n.op,
    CASE WHEN n.op = 'start' THEN given WHEN n.op = 'insert' THEN plan[1:idx] || given[1:1] || plan[idx + 1:] WHEN n.op = 'replace' THEN plan[1:idx] || given ELSE plan END,
    CASE WHEN n.op = 'start' THEN undone WHEN n.op = 'insert' THEN done[1:idx] || [false] || done[idx + 1:] WHEN n.op = 'replace' THEN done[1:idx] || undone WHEN n.op = 'complete' AND idx < len(done) THEN done[1:idx] || [true] || done[idx + 2:] ELSE done END,
    CASE WHEN n.op = 'start' THEN 0 WHEN n.op = 'complete' THEN idx + 1 WHEN n.op = 'replace' THEN least(idx, len(plan)) ELSE idx END
  FROM s JOIN n ON n.session = s.session AND n.run = s.run AND n.k = s.k + 1)"""

ORACLE_SQL["plan_states"] = f"""{_STEPS}
SELECT session, CAST(run AS BIGINT) AS run, op_id, op, plan[idx + 1].t AS task_type, plan[idx + 1].d AS task_description, CAST(len(plan) AS BIGINT) AS total,
  CAST(len([x FOR x IN done IF x]) AS BIGINT) AS completed, CAST(len([x FOR x IN done IF NOT x]) AS BIGINT) AS pending FROM s WHERE k > 0"""

ORACLE_SQL["plan_tasks"] = f"""{_STEPS}, final AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session, run ORDER BY k DESC) = 1),
place AS (SELECT session, run, plan, done, unnest(range(1, len(plan) + 1)) AS i FROM final)
SELECT session, CAST(run AS BIGINT) AS run, CAST(i - 1 AS BIGINT) AS pos, plan[i].t AS type, plan[i].d AS description, CASE WHEN done[i] THEN 'completed' ELSE 'pending' END AS status FROM place"""


def _any(rows: str, test: str) -> str:
    return f"EXISTS (SELECT 1 FROM {rows} r WHERE r.goal_id = g.goal_id AND coalesce({test}, false))"


def _said(*names: str) -> str:
    return "lower(concat_ws(' ', " + ", ".join(f"coalesce({n}, '')" for n in names) + "))"


def _like(text: str, *words: str) -> str:
    return f"regexp_matches({text}, '\\b({'|'.join(words)})\\b')"


_SHORT, _LONG = _said("kind", "reason", "target"), _said("kind", "reason", "r.action", "target")
_ALL = _said("kind", "reason", "r.action", "target", "target_id")
_CART = ("add to cart", "add to bag", "add to basket", "cart", "bag")
_SENT = ("submit", "submitting", "registered", "booked", "submitted form", "order placed", "confirm", "confirmed", "clicked")
_BREAKS = (
    "(g.c_name = 'price' AND TRY_CAST(price AS DOUBLE) > TRY_CAST(g.c_value AS DOUBLE) OR g.c_name = 'rating' AND TRY_CAST(rating AS DOUBLE) < TRY_CAST(g.c_value AS DOUBLE) OR g.c_name = 'brand' AND lower(brand) <> lower(g.c_value))"
)
_MUST = "('search', 'filter', 'select_candidate', 'fill_form', 'submit_form', 'perform_action', 'submit_action', 'submit')"

ORACLE_SQL["goal_completion"] = f"""
WITH acts AS (SELECT * FROM {_of("goal_actions")}), plans AS (SELECT * FROM {_of("goal_tasks")}), cands AS (SELECT * FROM {_of("goal_candidates")}),
first_act AS (SELECT goal_id, arg_min(coalesce(action, ''), pos) AS planned FROM plans WHERE type = 'perform_action' GROUP BY goal_id),
g0 AS (SELECT g.*, {_said("request", "summary")} AS said, coalesce(action, nullif(planned, '')) AS intent FROM {_of("checked_goals")} g LEFT JOIN first_act USING (goal_id)),
g1 AS (SELECT *, list_contains(operations, 'add_to_cart') OR {_like("said", "add to cart", "add to bag", "add to basket")} AS cart_only FROM g0),
g AS (SELECT *, cart_only OR {_like("said", "buy now", "purchase", "checkout", "order now")} AS cart, lower(coalesce(click_target, action, 'submit')) AS click_verb, lower(trim(coalesce(intent, 'action'))) AS verb,
  CASE WHEN c_name = 'candidate_count' THEN CAST(c_value AS INT) WHEN list_contains(operations, 'compare') OR {_like("said", "compare")} THEN 2 ELSE 1 END AS least_n FROM g1),
f AS (SELECT g.*, (SELECT count(*) FROM cands r WHERE r.goal_id = g.goal_id) AS inspected,
  NOT cart AND (click_target IS NOT NULL OR list_has_any(operations, ['submit', 'submit_form']) OR {_like("said", "submit", "register", "book now", "complete order", "confirm", "confirm order", "place order")})
    AND (NOT {_any("plans", "true")} OR {_any("plans", "type IN ('submit', 'submit_form') OR type = 'perform_action' AND action_kind = 'CLICK'")}) AS must_submit,
  {_any("acts", "true")} AS started FROM g),
m AS (SELECT goal_id, started, CASE WHEN NOT started THEN ['Execute initial planned tasks'] ELSE [x FOR x IN [
  CASE WHEN cart_only AND NOT {_any("acts", _like(_SHORT, *_CART))} THEN 'Requested item has not been added to cart yet (add to cart action missing).' END,
  CASE WHEN cart AND NOT cart_only AND NOT {_any("acts", _like(_SHORT, "add to cart", "cart", "bag", "bought", "purchased", "checkout", "buy now"))} THEN 'Purchase or cart action has not been executed yet.' END,
  CASE WHEN must_submit AND NOT {_any("acts", f"({_like(_LONG, *_SENT)} OR contains({_LONG}, g.click_verb) OR coalesce(kind IN ('SUBMIT', 'CLICK'), false))")} THEN 'Requested action or submission has not been executed yet.' END,
  CASE WHEN (intent IS NOT NULL OR list_contains(operations, 'perform_action')) AND NOT (coalesce(intent IN ('open', 'read', 'view'), false) AND picks) AND NOT must_submit
    AND NOT {_any("acts", f"contains({_ALL}, g.verb)")} THEN 'Requested action ''' || verb || ''' has not been executed yet.' END,
  CASE WHEN list_contains(operations, 'search') AND {_any("plans", "type = 'search' AND lower(status) <> 'completed'")} AND NOT {_any("acts", _like(_SHORT, "search", "entered search", "typed into search", "searchbox", "search_query", "query", "type"))} THEN 'Search query has not been executed yet.' END,
  CASE WHEN NOT cart AND (c_name IS NOT NULL AND c_update OR (list_has_any(operations, ['fill', 'fill_form']) OR domain = 'form_filling') AND click_target IS NULL AND NOT regexp_matches(lower(request), '^(click|press|tap|confirm|submit)\\s'))
    AND NOT {_any("acts", f"({_like(_SHORT, 'fill', 'populated', 'typed?', 'entered', 'form field', 'input', 'select', 'check')} OR coalesce(kind IN ('TYPE', 'CHECK', 'SELECT'), false))")} THEN 'Form fields have not been populated yet.' END,
  CASE WHEN least_n > 1 AND inspected < least_n THEN 'Comparison requires at least ' || least_n || ' candidates (inspected ' || inspected || ').' END,
  CASE WHEN c_name IS NOT NULL AND {_any("cands", "(price IS NOT NULL AND brand IS NOT NULL AND rating IS NOT NULL)")} AND NOT {_any("cands", f"NOT coalesce({_BREAKS}, false)")} THEN 'No candidate currently satisfies all specified constraints.' END,
  'Pending required task: ' || (SELECT arg_min(coalesce(nullif(description, ''), type), pos) FROM plans r WHERE r.goal_id = g.goal_id AND type IN {_MUST} AND lower(status) <> 'completed')
  ] IF x IS NOT NULL] END AS missing FROM f g)
SELECT goal_id, len(missing) = 0 AS completed, CAST(len(missing) AS BIGINT) AS n_missing,
  CASE WHEN NOT started THEN 'Execution has not started.' WHEN len(missing) = 0 THEN 'User goal and all constraints have been genuinely satisfied.' ELSE 'Goal not fully satisfied: ' || array_to_string(missing, '; ') END AS reason FROM m"""

ORACLE_SQL["centroid_evaluation"] = """
WITH v AS (SELECT row_number() OVER () AS no, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
x AS (SELECT no, label, unnest(range(1, len(embedding) + 1)) AS pos, unnest([CAST(floor(CAST(e AS DOUBLE) * 10000 + 0.5) AS BIGINT) FOR e IN embedding]) AS x FROM v),
means AS (SELECT label AS class, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS m FROM x GROUP BY 1, 2),
far AS (SELECT no, label, class, sum((x - m) * (x - m)) AS far FROM x JOIN means USING (pos) GROUP BY 1, 2, 3),
scored AS (SELECT class, far, label = class AS hit, row_number() OVER (PARTITION BY no ORDER BY far, class) = 1 AS chosen FROM far),
ranked AS (SELECT class, hit, count_if(hit) OVER w AS tp, count(*) OVER w AS n FROM scored WINDOW w AS (PARTITION BY class ORDER BY far)),
area AS (SELECT class, sum(CASE WHEN hit THEN CAST(tp AS DOUBLE) / n ELSE 0 END) / count_if(hit) AS ap FROM ranked GROUP BY class),
rates AS (SELECT class, count_if(hit) AS support, count_if(chosen) AS predicted, count_if(hit AND chosen) AS hits FROM scored GROUP BY class),
by_class AS (SELECT class, support, predicted, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, hits / support AS recall, ap FROM rates JOIN area USING (class)),
both_ AS (SELECT * FROM by_class UNION ALL SELECT NULL, sum(support), sum(predicted), sum(hits), avg(precision), avg(recall), avg(ap) FROM by_class)
SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ap, 9) AS ap FROM both_"""

ORACLE_SQL["stale_targets"] = f"""
WITH r AS (SELECT * REPLACE (nullif(target_id, '') AS target_id, nullif(semantic_type, '') AS semantic_type), nullif(trim(lower(coalesce(nullif(semantic_type, ''), name, label, placeholder, text, aria_label))), '') AS hint FROM {_of("stale_refs")}),
e AS (SELECT *, lower(concat_ws(' ', coalesce(name, ''), coalesce(placeholder, ''), coalesce(aria_label, ''), coalesce(text, ''), coalesce(semantic_type, ''))) AS words FROM {_of("live_elements")}),
n AS (SELECT * FROM {_of("live_nodes")}),
k AS (SELECT page_id, element_id AS key FROM e UNION SELECT page_id, dom_id FROM e UNION SELECT page_id, nullif(name, '') FROM e UNION SELECT page_id, key FROM n),
p AS (SELECT r.*, CASE WHEN target_id IS NULL THEN 'DENIED_INVALID_TARGET' WHEN stale AND target_id <> 'window' THEN 'DENIED_STALE_TARGET' END AS denied,
  target_id = 'window' OR EXISTS (SELECT 1 FROM k WHERE k.page_id = r.page_id AND k.key = r.target_id) OR NOT EXISTS (SELECT 1 FROM k WHERE k.page_id = r.page_id) AS found FROM r),
a AS (SELECT p.ref_id, arg_min(e.element_id, e.pos) AS again FROM p JOIN e ON e.page_id = p.page_id AND NOT e.sponsored
  AND (e.semantic_type = p.semantic_type OR e.name = p.name AND e.name <> '' OR lower(e.placeholder) = lower(p.placeholder) AND e.placeholder <> '' OR length(p.hint) > 3 AND contains(e.words, p.hint))
  WHERE denied IS NULL AND NOT found AND hint IS NOT NULL GROUP BY 1)
SELECT ref_id, denied IS NULL AND (found OR again IS NOT NULL) AS resolved, coalesce(again, target_id) AS target_id, again IS NOT NULL AS recovered, coalesce(denied, CASE WHEN NOT found AND again IS NULL THEN 'DENIED_TARGET_NOT_FOUND' END) AS reason
FROM p LEFT JOIN a USING (ref_id)"""

_PLATFORMS = ", ".join(f"('{k}', '{v}')" for k, v in goals.PLATFORMS.items())
_HOST = "regexp_replace(replace(platform, 'https://', ''), '^www.', '')"
ORACLE_SQL["goal_start_url"] = f"""
WITH parsed AS ({goal_parse(GOALS)}), g AS (SELECT goal_id, goal, explicit, url AS target, lower(destination) AS key, {CURRENT} FROM parsed JOIN {relation("goals", values(GOALS, "goal_id, goal"), "goal_id, goal")} USING (goal_id)),
i AS (SELECT g.*, platform, nullif(regexp_extract(goal, {q(goals.NAMED_HOST)}, 1), '') AS named, lower(coalesce(current, '')) AS at_, coalesce(current, '') = '' OR regexp_matches(current, '^(chrome|about|chrome-extension|devtools):') AS internal
  FROM g LEFT JOIN (VALUES {_PLATFORMS}) AS p(key, platform) USING (key))
SELECT goal_id, goal, current, CASE
  WHEN regexp_matches(goal, '(?i)https?://[^\\s]') THEN regexp_extract(goal, '(?i)https?://[^\\s]+') WHEN target IS NOT NULL THEN target WHEN NOT internal AND NOT coalesce(explicit, false) THEN NULL
  WHEN platform IS NOT NULL AND NOT contains(at_, {_HOST}) THEN platform WHEN named IS NOT NULL AND NOT contains(at_, lower(named)) THEN 'https://' || named WHEN internal THEN 'https://www.google.com' END AS url FROM i"""
