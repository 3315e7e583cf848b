import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith.operators import jobs as J
from catalith.streaming import delivery, windows


def test_retries_and_order(spark):
    df = spark.createDataFrame([(1, "m", 0, None, None, None), (2, "m", 10, 1, 3, None), (3, "m", 0, 2, 3, dt.datetime(2030, 1, 1))], "arrival_no bigint, job_type string, priority int, retry_count int, max_retries int, next_retry_at timestamp").withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    got = {r.arrival_no: tuple(r.s) for r in df.select("arrival_no", J.retry_state(F.col("retry_count"), F.col("max_retries")).alias("s")).collect()}
    assert got == {1: (1, False, 1), 2: (2, False, 2), 3: (3, True, None)}
    assert [(r.arrival_no, r.attempt, r.delay_s, r.due) for r in J.retry_schedule(df).orderBy("arrival_no", "attempt").collect()] == [(1, 1, 1, 1), (1, 2, 2, 3), (2, 2, 2, 2)]
    assert [r.arrival_no for r in J.due(df, F.lit(dt.datetime(2024, 6, 1))).orderBy("place").collect()] == [2, 1]


def test_roll_up_and_schemas(spark):
    rows = [("a", "done"), ("a", "failed"), ("b", "queued"), ("b", "processing"), ("c", "done"), ("d", "queued"), ("e", "failed")]
    got = {r.k: r.status for r in J.roll_up(spark.createDataFrame(rows, "k string, status string"), "k").collect()}
    assert got == {"a": "partial", "b": "processing", "c": "done", "d": "queued", "e": "failed"}
    known = spark.createDataFrame([("s1", "h1", "provisional", None), ("s2", "h2", "active", None)], "name string, structure_hash string, status string, decision_reason string")
    found = spark.createDataFrame([("n1", "h1"), ("n3", "h3"), ("n3b", "h3")], "name string, structure_hash string")
    assert J.registered_schemas(known, found).count() == 3
    assert J.decide_schema(known, "s1", True).filter("status = 'active'").count() == 2
    assert J.decide_schema(known, "s1", False, "no").filter("status = 'rejected'").first().decision_reason == "rejected: no"
    with pytest.raises(ValueError):
        J.decide_schema(known, "s2", True)
    assert spark.range(1).select(J.progress(F.lit(1), F.lit(3)).alias("p"), J.progress(F.lit(0), F.lit(0)).alias("z")).first() == (33.33, 0.0)


def test_dead_letters(spark, tmp_path):
    box = J.DeadLetters(spark, str(tmp_path / "dead"))
    box.add(spark.createDataFrame([("1", "media", 3), ("2", "json", 3)], "job_id string, job_type string, n int"), F.lit("boom"))
    assert box.count() == 2 and box.list("json").count() == 1 and box.get("1").error == "boom" and box.list(limit=1).count() == 1
    box.remove("1")
    assert box.count() == 1 and box.get("1") is None


def test_lineage(spark):
    row = spark.createDataFrame([("r",)], "request_id string").select(*J.lineage_row(F.col("request_id"), "start")).first()
    assert (row.request_id, row.stage, row.success, row.asset_id) == ("r", "start", True, None)


def test_quantile_and_islands(spark):
    df = spark.createDataFrame([([1, 3, 4],), ([0, 0, 0],), ([0, 0, 4],)], "c array<int>")
    got = [r.q for r in df.select(windows.histogram_quantile(F.col("c"), 0.5, (10.0, 20.0)).alias("q")).collect()]
    assert got == [15.0, None, 20.0]
    rows = spark.createDataFrame([(i, i in (2, 3, 4, 7)) for i in range(9)], "start int, hot boolean")
    assert [tuple(r) for r in windows.alert_islands(rows, F.col("hot"), 3).collect()] == [(2, 4, 3)]


def events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=7 * i), i % 3, "error" if i % 4 == 0 else "view", float(i)) for i in range(60)]
    schema = "event_id bigint, ts timestamp, user_id int, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(spark, stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.mark.parametrize("name, function", [("rate", lambda d: windows.rate(d, "30 minutes")), ("ratio", lambda d: windows.ratio(d, F.col("event_type") == "error")), ("buckets", lambda d: windows.bucket_counts(d)), ("sessions", lambda d: windows.sessions(d, "30 minutes"))])
def test_stream_equals_batch(spark, tmp_path, name, function):
    batch, stream = events(spark, tmp_path)
    assert drain(spark, function(stream), f"q_{name}") == sorted(tuple(r) for r in function(batch).collect())


def test_stream_deliveries_and_retries(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    first = delivery.first_copies(stream.withColumn("k", F.col("event_id") % 10), ["k"], "ts", "10 hours").select("k")
    assert drain(spark, first, "q_first", "append") == [(i,) for i in range(10)]
    outcomes = stream.select(F.col("user_id").cast("string").alias("job_id"), (F.col("event_type") == "none").alias("ok"))
    assert drain(spark, delivery.retries(outcomes), "q_retry", "update") == [(str(k), "dead", 20, 0) for k in range(3)]
