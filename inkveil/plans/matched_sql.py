"""SQL twins of matched.py, by all pairs."""

from __future__ import annotations

from .sql import ORACLE_SQL

ORACLE_SQL["nearest_bracket"] = """
WITH b AS (
  SELECT p_partkey AS bracket_id, p_partkey AS pos, NULL::DOUBLE AS low, floor(p_retailprice) AS high FROM part WHERE p_partkey % 40 = 0
  UNION ALL SELECT p_partkey, -p_partkey, floor(p_retailprice), floor(p_retailprice) + p_size FROM part WHERE p_partkey % 40 = 7
), t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS value FROM lineitem),
v AS (SELECT DISTINCT value FROM t), best AS (
  SELECT value, min({'d': abs(high - value), 'p': pos, 'i': bracket_id}) AS x FROM v JOIN b ON (low IS NULL AND high <= value * 1.3::DOUBLE) OR (value >= low AND value <= high * 1.15::DOUBLE) GROUP BY value)
SELECT t.*, x.i AS bracket_id, x.d AS diff FROM t LEFT JOIN best ON t.value = best.value"""
ORACLE_SQL["constraint_division"] = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 1 THEN p_retailprice END AS price, CASE WHEN p_partkey % 50 <> 2 THEN p_size END AS size, CASE WHEN p_partkey % 50 <> 3 THEN lower(p_brand) END AS brand FROM part)
SELECT c_custkey AS set_id, count(p_partkey) AS n, min(p_partkey) AS first_id FROM customer LEFT JOIN p ON coalesce(price <= 900 + c_custkey % 97, true) AND coalesce(size >= c_custkey % 40, true)
  AND (c_custkey % 3 <> 0 OR coalesce(brand = 'brand#' || (1 + c_nationkey % 9), true)) AND (c_custkey % 5 <> 0 OR coalesce(price >= 910, true)) GROUP BY c_custkey"""
