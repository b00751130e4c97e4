"""Ingest of lines: defaults and scrub, quarantine, batches that run again."""

from pyspark.sql import functions as F

from inkveil.streaming import ingest

LINES = [
    '{"stage":"load_failed","data":{"a":"x@y.zz","secret":1}}', '{"category":"warning","action":"GO","payload":{"b":[1]},"level":""}', "{}", "nope", "", "[1]", "null", '{"data":null,"metadata":{"html":"<p>"}}', '{"stage":5,"payload":0,"level":"trace"}',
]


def test_lines(spark):
    rows = ingest.ingested(spark.createDataFrame(list(enumerate(LINES)), "no int, line string")).orderBy("no").collect()
    got = [(r["reason"], r["stage"], r["event"], r["level"], r["data"], r["metadata"]) for r in rows]
    none = (None,) * 5
    assert got == [
        (None, "LOAD_FAILED", "EVENT", "error", '{"a":"[EMAIL_REDACTED]","secret":"[PROTECTED_SECRET]"}', "{}"), (None, "WARNING", "GO", "warn", '{"b":[1]}', "{}"), (None, "GENERAL", "EVENT", "info", "{}", "{}"), ("NO_JSON", *none), ("NO_JSON", *none), ("NO_OBJECT", *none), ("NO_OBJECT", *none),
        (None, "GENERAL", "EVENT", "info", "null", '{"html":"[RAW_DOM_REDACTED_FROM_TELEMETRY]"}'), (None, "5", "EVENT", "trace", "{}", "{}"),
    ]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("\n".join(f'{{"event":"e{i}"}}' if i % 3 else f"broken {i}" for i in range(30)))
    ingest.start(spark, str(source), target, str(tmp_path / "mark")).awaitTermination(120)
    (source / "b.txt").write_text('{"event":"late"}\n{')
    ingest.start(spark, str(source), target, str(tmp_path / "mark")).awaitTermination(120)
    before = sorted(r["event"] for r in spark.read.parquet(f"{target}/events").collect())
    assert len(before) == 21 and spark.read.parquet(f"{target}/quarantine").count() == 11
    ingest.write(spark.read.text(str(source / "b.txt")).withColumnRenamed("value", "line"), 1, target)
    assert sorted(r["event"] for r in spark.read.parquet(f"{target}/events").collect()) == before
    assert [r["event"] for r in ingest.ring(spark, target, 2).collect()] == ["late", "e29"]


def test_event_lines_are_spread_and_measured_once(spark, monkeypatch):
    from inkveil.operators import json_tree
    from inkveil.plans import state

    passes = []
    monkeypatch.setattr(json_tree, "depths", lambda rows, *names, own=json_tree.depths: passes.append(names) or own(rows, *names))
    plan = state.event_ingest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and passes == [("data", "metadata")]
    odd = ['{"a":"}{"}', '"{"', "[1]", "{}", "7", '{"a":{"b":[]}}', None]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(odd)), "n int, j string").orderBy("n").select(json_tree.nesting(F.col("j"))).collect()] == [1, 0, 1, 1, 0, 3, None]
