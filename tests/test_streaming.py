from pyspark.sql import functions as F

from inkveil.streaming import events as s


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_metrics_count_all_closed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    out = run(s.windowed_metrics(s.read_events(spark, str(tmp_path / "in"), events.schema)), "metrics")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour")).count()
    expected = {r["window"]["start"]: r["count"] for r in batch.collect()}
    got = {}
    for r in out.collect():
        got[r["window"]["start"]] = got.get(r["window"]["start"], 0) + r["n"]
    assert got and all(expected[k] == v for k, v in got.items())


def test_secret_store_codes(spark, tmp_path):
    rows = [
        ("a", "retrieve", 0, 0, "", "login", True, "LOCAL_BROWSER"),
        ("a", "store", 10, 5, "h", "login", True, "LOCAL_BROWSER"),
        ("a", "retrieve", 20, 0, "", "login", True, "LOCAL_BROWSER"),
        ("a", "retrieve", 30, 0, "", "other", True, "LOCAL_BROWSER"),
        ("a", "retrieve", 40, 0, "", "login", False, "LOCAL_BROWSER"),
        ("a", "retrieve", 50, 0, "", "login", True, "REMOTE_SERVICE"),
        ("a", "retrieve", 5000, 0, "", "login", True, "LOCAL_BROWSER"),
        ("a", "revoke", 6000, 0, "", "login", True, "LOCAL_BROWSER"),
        ("a", "retrieve", 7000, 0, "", "login", True, "LOCAL_BROWSER"),
    ]
    schema = "vault_id string, op string, now_ms long, ttl_ms long, secret_hash string, purpose string, authorized boolean, destination string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "ops"))
    out = run(s.secret_store(spark.readStream.schema(schema).parquet(str(tmp_path / "ops"))), "store")
    assert [r["result"] for r in out.collect()] == [
        "DENIED_NOT_FOUND", "STORED", "GRANTED", "DENIED_PURPOSE_MISMATCH", "DENIED_UNAUTHORIZED", "DENIED_REMOTE_DESTINATION", "DENIED_EXPIRED", "REVOKED", "DENIED_REVOKED",
    ]
