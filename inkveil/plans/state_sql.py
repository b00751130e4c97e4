"""SQL twin of the ingest query: the expected rows spelled out."""

from __future__ import annotations

from .. import config as c
from .sql import ORACLE_SQL

ORACLE_SQL["event_ingest"] = f"""
WITH e AS (
  SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'NO_JSON' WHEN event_id % 13 = 0 THEN 'NO_OBJECT' END AS reason,
    upper(CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'Warn-' || event_type END) AS stage FROM events WHERE event_type IS NOT NULL)
SELECT event_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN stage END AS stage,
  CASE WHEN reason IS NULL THEN CASE WHEN event_id % 3 > 0 THEN event_type ELSE 'EVENT' END END AS event,
  CASE WHEN reason IS NULL THEN CASE WHEN event_id % 7 = 0 THEN 'debug' WHEN contains(stage, 'ERROR') OR contains(stage, 'FAIL') THEN 'error' WHEN contains(stage, 'WARN') THEN 'warn' ELSE 'info' END END AS level,
  CASE WHEN reason IS NULL THEN CASE WHEN event_id % 5 > 0 THEN '{{"note":"by [EMAIL_REDACTED]","password":"{c.PROTECTED}"}}' ELSE '{{}}' END END AS data,
  CASE WHEN reason IS NULL THEN '{{"apiKey":"{c.PROTECTED}"}}' END AS metadata FROM e"""
