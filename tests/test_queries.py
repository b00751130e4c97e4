"""Every reference query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from inkveil.plans import catalog, context, context_sql, matched, matched_sql, page_tree, page_tree_sql, passed, passed_sql, payloads, payloads_sql, planned, planned_sql, progress, progress_sql, seeded, seeded_sql, state, state_sql, spoken, spoken_sql, sql  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) and x == x:
        return round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(sql.ORACLE_SQL[name])
    columns = [x[0] for x in result.description]
    expected = sorted(([plain(r[columns.index(c)]) for c in sorted(columns)] for r in result.fetchall()), key=str)
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(([plain(r[c]) for c in sorted(columns)] for r in df.collect()), key=str)
    assert got == expected


def test_every_query_with_sql_is_registered():
    assert set(sql.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["labelled_fields", "ocr_pii", "target_resolution", "telemetry_leaks", "telemetry_scrub", "line_passes", "doc_entities", "page_element_details", "page_visible_texts", "page_tree_sanitized", "page_sanitized_text"])
def test_costly_rows_are_spread_over_all_cores(spark, name):
    """Whatever the number of row groups: a file of one is read by one task."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan
