"""SQL twins of payloads.py: the expected payloads spelled out."""

from __future__ import annotations

from .. import config as c
from .spoken_sql import scrub
from .sql import ORACLE_SQL, q

TURNS = """
SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, concat_ws('-', conv_id::VARCHAR, turn::VARCHAR) AS no FROM conversations"""
ORACLE_SQL["telemetry_payloads"] = f"""
WITH s AS (SELECT *, {scrub("text || ' password: s3cret-' || no")} AS task, {scrub("role")} AS event FROM ({TURNS})), p AS (
  SELECT conv_id, turn, '{{"data":{{"auth":{{"Password":"{c.PROTECTED}","User_Input":"{c.PROTECTED}","list":["[EMAIL_REDACTED]","public"],"mail":"[EMAIL_REDACTED]"}},"cvv":null}},'
    || '"entry":{{"category":"password_field","isVaultProtected":true,"purpose":"login","status":"PROTECTED_LOCAL_ONLY"}},"event":' || to_json(event)::VARCHAR || ',"html":"{c.RAW_PAGE}",'
    || '"mapping":{{"category":"email","token":' || to_json('PII_TOKEN_EMAIL_' || no)::VARCHAR || ',"value":"{c.PROTECTED_MAPPING}"}},"rawScreenshot":"{c.RAW_IMAGE}","step":' || coalesce(turn::VARCHAR, 'null')
    || ',"task":' || to_json(task)::VARCHAR || '}}' AS payload FROM s)
SELECT conv_id, turn, sha256(payload) AS payload_sha256, length(payload) AS chars FROM p"""
ORACLE_SQL["telemetry_payload_leaks"] = "SELECT conv_id, turn FROM conversations WHERE false"
ORACLE_SQL["telemetry_payload_leaks_control"] = "SELECT conv_id, turn FROM conversations"
ORACLE_SQL["event_props_scrubbed"] = "SELECT event_id, '{\"k\":' || regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) || '}' AS props FROM events"



def masked(x: str) -> str:
    return f"to_json(regexp_replace(regexp_replace({x}, {q(c.REMOTE_EMAIL)}, '[EMAIL_REDACTED]', 'g'), {q(c.REMOTE_DIGITS)}, '[CARD_REDACTED]', 'g'))::VARCHAR"


ORACLE_SQL["payload_assembly"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, list_distinct(regexp_extract_all(coalesce(text, ''), {q(c.EMAIL)})) AS mails FROM documents), p AS (
  SELECT doc_id, '{{"interactiveElements":[' || array_to_string([
      '{{"elementId":"el_' || i || '","text":' || {masked("left(x, 120)")} || '}}' FOR x, i IN lines[1:100]], ',')
    || '],"metadata":{{"destination":"REMOTE_REASONING","nodeCount":' || len(lines) || ',"tokensCount":' || len(mails) || ',"visualBlockCount":' || len(lines)
    || '}},"status":"SANITIZED","taskIntent":"READ_INFORMATION","tokenMapping":{{' || array_to_string(list_sort([
      '"EMAIL_' || i || '":{{"category":"email","decision":"TOKENIZE","token":"EMAIL_' || i || '","type":"OPAQUE_ID"}}' FOR x, i IN mails]), ',')
    || '}},"userTask":' || {masked("left(text, 500)")} || ',"visualBlocks":[' || array_to_string([{masked("x")} FOR x IN lines], ',') || ']}}' AS payload FROM d)
SELECT doc_id, strlen(payload) <= {c.MOST_PAYLOAD_BYTES} AS ok, CASE WHEN strlen(payload) <= {c.MOST_PAYLOAD_BYTES} THEN 'SANITIZED' ELSE 'REJECTED' END AS status, strlen(payload) AS bytes,
  CASE WHEN strlen(payload) <= {c.MOST_PAYLOAD_BYTES} THEN sha256(payload) END AS payload_sha256 FROM p"""
