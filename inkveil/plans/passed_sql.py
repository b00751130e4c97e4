"""SQL twin of the passes over lines: each pass splits what the one before has left at marks, and counts the parts that go."""

from __future__ import annotations

from .. import config as c
from ..operators import passes
from .passed import LINE_PATH
from .sql import ORACLE_SQL, luhn, q


def _pass(before: str, name: str, pattern: str, when: str, check: str = "true") -> str:
    """Two tables: parts of the text, every other one a match; and the text with matches replaced, their number and length."""
    gone = f"(j % 2 = 0 AND {when} AND {check})"
    split = f"CASE WHEN regexp_matches(t, {q(pattern)}) THEN string_split(regexp_replace(t, {q(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) ELSE [t] END"
    return f"""{name}_parts AS (SELECT *, {split} AS parts FROM {before}),
{name}_ AS (SELECT * EXCLUDE (t, parts), array_to_string([CASE WHEN {gone} THEN '{passes.REDACTED}' ELSE parts[j] END FOR j IN range(1, len(parts) + 1)], '') AS t,
  CAST(len([1 FOR j IN range(1, len(parts) + 1) IF {gone}]) AS BIGINT) AS {name}_n, coalesce(list_sum([length(parts[j]) FOR j IN range(1, len(parts) + 1) IF {gone}]), 0) AS {name}_chars FROM {name}_parts)"""


_PERSON = f"(regexp_matches(lower(path), '{passes.PERSON_PATH}') OR NOT regexp_matches(lower(path), '{passes.PRODUCT_PATH}'))"
ORACLE_SQL["line_passes"] = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS texts FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(texts) AS text, unnest(range(len(texts))) AS line FROM cut),
nodes AS (SELECT doc_id, line, text, text AS t, coalesce(element_path, '') AS path FROM (SELECT *, {LINE_PATH} FROM each)),
known AS (SELECT *, contains(lower(path), 'password') AS local, contains(lower(path), 'ssn') AS ssn_path, regexp_matches(lower(path), 'ssn|account|id') AS id_path, contains(text, '{passes.REDACTED}') AS literal FROM nodes),
{_pass("known", "card", passes.SPACED_CARD, "NOT local", luhn("parts[j]"))},
{_pass("card_", "id", c.SSN, "NOT local")},
whole AS (SELECT *, NOT local AND ssn_path AND card_n + id_n = 0 AND NOT literal AS gone FROM id_),
{_pass("whole", "email", c.EMAIL, "NOT (local OR gone)")},
{_pass("email_", "phone", c.PHONE, "NOT (local OR gone)")},
{_pass("phone_", "name", c.PERSON_NAME, f"NOT (local OR gone) AND {_PERSON}")},
done AS (SELECT *, CASE WHEN local OR gone OR (id_n > 0 OR id_path AND card_n = 0) AND (card_n + id_n > 0 OR literal) THEN 1 ELSE 0 END AS by_id FROM name_)
SELECT doc_id, line, sha256(CASE WHEN local THEN '{passes.LOCAL_ONLY}' WHEN gone THEN '{passes.REDACTED}' ELSE t END) AS text_sha256, card_n AS card, CAST(by_id AS BIGINT) AS id, least(email_n, 1) AS email, least(phone_n, 1) AS phone, least(name_n, 1) AS name,
  CAST(CASE WHEN local OR gone THEN length(text) ELSE card_chars + id_chars + email_chars + phone_chars + name_chars END AS BIGINT) AS chars
FROM done WHERE by_id + card_n + email_n + phone_n + name_n > 0"""
