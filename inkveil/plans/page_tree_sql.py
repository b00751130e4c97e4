"""SQL twins of page_tree.py. The given pages have links, texts, scripts and styles only; what a shop page must give is spelled out."""

from __future__ import annotations

from .. import config as c
from ..sources.dom import MOST_TEXT
from .page_tree import SHOP
from .sql import ORACLE_SQL, q

_TOKENS = r"regexp_extract_all(html, '(?s)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[^>]*>|[^<]+')"
_PLAIN = "replace(replace(replace(regexp_replace({}, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), chr(1), '&')"
_SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TEXTS = f"list_transform(list_filter(tokens, lambda x: x[1] <> '<'), lambda x: {_PLAIN.format('x')})"
_CLEAN = f"left(regexp_replace(regexp_replace(regexp_replace(x, {q(c.EMAIL)}, '[EMAIL_REDACTED]', 'g'), {q(c.PHONE)}, '[PHONE_REDACTED]', 'g'), {q(c.CARD)}, '[CARD_REDACTED]', 'g'), {MOST_TEXT})"

ORACLE_SQL["page_tree_sanitized"] = rf"""
WITH t AS (SELECT page_id, {_TOKENS} AS tokens FROM pages), n AS (
  SELECT page_id, {_TEXTS} AS texts, list_filter(tokens, lambda x: regexp_matches(x, '^<[A-Za-z]') AND NOT regexp_matches(x, '^<(script|style)\b')) AS tags FROM t)
SELECT page_id, len(tags) + len(texts) AS nodes, len(texts) AS texts, list_sum(list_transform(tags, lambda x: len(regexp_extract_all(x, '\s[a-z-]+='))))::BIGINT AS attributes,
  sha256(array_to_string(list_transform(texts, lambda x: {_CLEAN}), chr(10))) AS texts_sha256
FROM n WHERE len(tags) + len(texts) > 0"""

_FILLED = q(SHOP)
for _name, _column in (("key", "p_partkey"), ("brand", "p_brand"), ("name", "p_name"), ("type", "p_type"), ("size", "p_size")):
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', coalesce({_column}::VARCHAR, ''))"
#: tag, role, text, aria_label, placeholder, name, type, value, checked, disabled, is_sponsored, is_filter, filter_category, is_max_price, is_min_price, is_price_go, is_product, semantic_type
_EXPECTED = """
('input', 'textbox', NULL, NULL, 'Min', NULL, 'text', NULL, NULL, false, false, true, 'price', false, true, false, false, NULL),
('input', 'textbox', NULL, NULL, NULL, 'high-price', 'text', NULL, NULL, false, false, true, 'price', true, false, false, false, NULL),
('button', 'button', 'Go', NULL, NULL, NULL, NULL, NULL, NULL, false, false, true, 'price', false, false, true, false, NULL),
('input', 'checkbox', '{brand}', NULL, NULL, NULL, 'checkbox', '{brand}', true, false, false, true, NULL, false, false, false, false, NULL),
('a', 'link', '{name} & more', NULL, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, false, false, false, true, NULL),
('button', 'button', 'Add to cart', NULL, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, false, false, false, true, NULL),
('a', 'link', '{type}', NULL, NULL, NULL, NULL, NULL, NULL, false, true, false, NULL, false, false, false, false, NULL),
('a', 'link', 'Promoted', NULL, NULL, NULL, NULL, NULL, NULL, false, true, false, NULL, false, false, false, false, NULL),
('input', 'textbox', NULL, NULL, NULL, 'mail', 'email', NULL, NULL, false, false, true, NULL, false, false, false, false, 'email'),
('input', 'textbox', NULL, NULL, NULL, NULL, 'password', NULL, NULL, false, false, true, NULL, false, false, false, false, 'password'),
('input', 'textbox', NULL, NULL, NULL, 'fname', 'text', NULL, NULL, false, false, true, NULL, false, false, false, false, 'first_name'),
('textarea', NULL, NULL, NULL, NULL, 'message', NULL, NULL, NULL, false, false, true, NULL, false, false, false, false, 'message'),
('select', NULL, 'Small{size}', NULL, NULL, 'size', NULL, '{size}', NULL, false, false, true, NULL, false, false, false, false, NULL),
('option', NULL, 'Small', NULL, NULL, NULL, NULL, 's', NULL, false, false, true, NULL, false, false, false, false, NULL),
('option', NULL, '{size}', NULL, NULL, NULL, NULL, '{size}', NULL, false, false, true, NULL, false, false, false, false, NULL),
('input', 'button', 'Send', NULL, NULL, NULL, 'submit', 'Send', NULL, true, false, true, NULL, false, false, false, false, NULL),
('div', 'Button', 'c', 'Open cart', NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, false, false, false, false, NULL),
('span', NULL, 'Tab', NULL, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, false, false, false, false, NULL),
('div', NULL, 'Note', NULL, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL, false, false, false, false, NULL)"""
_NAMES = "tag, role, text, aria_label, placeholder, name, type, value, checked, disabled, is_sponsored, is_filter, filter_category, is_max_price, is_min_price, is_price_go, is_product, semantic_type"


def _put(column: str) -> str:
    for name, other in (("brand", "p_brand"), ("name", "p_name"), ("type", "p_type"), ("size", "p_size")):
        column = f"replace({column}, '{{{name}}}', coalesce({other}::VARCHAR, ''))"
    return f"nullif(left(trim({column}), 120), '')"


_ROWS = ", ".join(f"({i}, {row.strip().rstrip(',').strip('()')})" for i, row in enumerate(_EXPECTED.strip().split("\n"), 1))
_LINK_TEXT = _SPACED.format(_PLAIN.format(r"regexp_replace(regexp_extract(x, '(?s)<a [^>]*>(.*)</a>', 1), '<[^>]*>', '', 'g')"))
ORACLE_SQL["page_element_details"] = rf"""
WITH links AS (
  SELECT page_id, unnest(found) AS x, generate_subscripts(found, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>') AS found FROM pages)
), nav AS (SELECT page_id, 'el_' || pos AS element_id, nullif(left({_LINK_TEXT}, 120), '') AS text FROM links)
SELECT page_id, element_id, 'a' AS tag, 'link' AS role, text, NULL AS aria_label, NULL AS placeholder, NULL AS name, NULL AS type, NULL AS value, NULL::BOOLEAN AS checked, false AS disabled,
  false AS is_sponsored, true AS is_filter, NULL AS filter_category, false AS is_max_price, false AS is_min_price, false AS is_price_go, false AS is_product, NULL AS semantic_type
FROM nav
UNION ALL
SELECT -p_partkey - 1, 'el_' || e.i, tag, role, {_put("e.text")}, aria_label, placeholder, name, type, {_put("e.value")}, checked, disabled, is_sponsored, is_filter, filter_category, is_max_price, is_min_price, is_price_go, is_product, semantic_type
FROM part, (VALUES {_ROWS}) AS e(i, {_NAMES})"""

ORACLE_SQL["page_visible_texts"] = rf"""
WITH t AS (SELECT page_id, {_TOKENS} AS tokens FROM pages), texts AS (SELECT page_id, unnest({_TEXTS}) AS x FROM t), shown AS (SELECT page_id, 'text' AS source, {_SPACED.format("x")} AS text FROM texts),
shop AS (SELECT -p_partkey - 1 AS page_id, {_FILLED} AS html, p_partkey, p_brand, p_size FROM part), st AS (SELECT page_id, {_TOKENS} AS tokens FROM shop),
shop_texts AS (SELECT page_id, 'text' AS source, {_SPACED.format("x")} AS text FROM (SELECT page_id, unnest({_TEXTS}) AS x FROM st)), others AS (
  SELECT page_id, 'input' AS source, unnest([coalesce(p_brand, ''), p_partkey::VARCHAR, 'Send']) AS text FROM shop
  UNION ALL SELECT page_id, 'select', coalesce(p_size::VARCHAR, '') FROM shop UNION ALL SELECT page_id, 'contenteditable', 'Note' FROM shop UNION ALL SELECT page_id, 'aria', 'Open cart' FROM shop)
SELECT page_id, source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM (FROM shown UNION ALL FROM shop_texts UNION ALL FROM others) WHERE text <> '' GROUP BY page_id, source"""
