import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import jobs as J
from catalith.operators import media as M
from catalith.operators import neighbours as N
from catalith.operators import profile as P
from catalith.operators import search as S
from catalith.streaming import worker as Q

T0 = dt.datetime(2024, 1, 1)
JOBS = "job_id string, job_type string, payload string, priority int, max_retries int, created_at timestamp"


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds)).cast("timestamp")


def test_the_queue_keeps_its_contract(spark, tmp_path):
    queue = Q.JobQueue(spark, str(tmp_path / "queue"))
    assert queue.size() == 0 and queue.dequeue(at(0), 5).count() == 0
    rows = [("a", "json", "ok", 1, 3, T0), ("b", "json", "bad", 5, 2, T0), ("c", "media", "ok", 5, 3, T0 + dt.timedelta(seconds=1)), (None, "json", "ok", 9, 3, T0)]
    assert queue.enqueue(spark.createDataFrame(rows, JOBS)) == 1
    queue.enqueue(spark.createDataFrame(rows[:1], JOBS))  # once more while it waits
    assert queue.size() == 3

    def handler(job):
        if job["payload"] == "bad":
            raise KeyError("nothing there")

    lineage = str(tmp_path / "lineage")
    assert Q.work(queue, handler, lineage, at(10), limit=2) == 2  # b before c, a waits
    assert {(r.job_id, r.event) for r in queue.state().collect()} == {("a", "queued"), ("b", "queued"), ("c", "done")}
    assert Q.work(queue, handler, lineage, at(10)) == 1  # b waits for a second
    assert Q.work(queue, handler, lineage, at(11)) == 1
    assert queue.size() == 0 and [(r.job_id, r.retry_count) for r in queue.dead().collect()] == [("b", 2)]
    assert "nothing there" in queue.dead().first().error
    stages = J.stage_counts(J.lineage(spark, lineage)).first()
    assert (stages.stage, stages.entries, stages.succeeded, stages.failed, stages.requests) == ("processed", 4, 2, 2, 3)
    assert J.lineage(spark, lineage, "a").count() == 1
    queue.close()
    with pytest.raises(RuntimeError):
        queue.enqueue(spark.createDataFrame(rows[:1], JOBS))


def test_a_stream_of_jobs(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "json", "ok", 1, 3, T0), ("b", "json", "no", 1, 1, T0)], JOBS).write.parquet(str(source))
    queue = Q.JobQueue(spark, str(tmp_path / "queue"))

    def handler(job):
        assert job["payload"] == "ok"

    query = Q.supervise(spark.readStream.schema(JOBS).parquet(str(source)), queue, handler, str(tmp_path / "lineage"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job_id, r.event) for r in queue.state().collect()} == {("a", "done"), ("b", "dead")}


def test_newest_batches_and_schemas(spark):
    rows = [(f"i{k:03d}", "x" if k % 2 else "y", T0 + dt.timedelta(days=k % 130)) for k in range(150)] + [("late", "x", None)]
    df = spark.createDataFrame(rows, "id string, owner string, created_at timestamp")
    first = sorted((r for r in rows if r[2]), key=lambda r: (-r[2].timestamp(), r[0]))[:100]
    assert [r.id for r in J.newest(df, 1000).collect()] == [r[0] for r in first]
    assert [r.id for r in J.newest(df, 50, "x").collect()] == [r[0] for r in first[:50] if r[1] == "x"]
    schemas = spark.createDataFrame([("s", "provisional"), ("t", "active")], "schema_name string, status string")
    assets = spark.createDataFrame([("s", "queued"), ("s", "done"), (None, "queued"), ("t", "queued")], "schema_name string, status string")
    assert {tuple(r) for r in J.schema_counts(schemas, assets.filter("schema_name = 's'")).collect()} == {("s", "provisional", 2), ("t", "active", 0)}
    ran = []
    decided, moved = J.approve_schema(schemas.withColumn("decision_reason", F.lit("r")).withColumnRenamed("schema_name", "name"), assets, "s", ran.append, "CREATE TABLE s")
    assert ran == ["CREATE TABLE s"] and {(r.name, r.status) for r in decided.collect()} == {("s", "active"), ("t", "active")}
    assert sorted((r.schema_name or "", r.status) for r in moved.collect()) == [("", "queued"), ("s", "done"), ("s", "processing"), ("t", "queued")]


def test_pictures_fail_alone(spark):
    rng = np.random.default_rng(1)
    busy, flat = (rng.integers(0, 2, 40 * 40) * 255).tolist(), [10] * 1200
    rows = [("busy", busy, 40, 40, ["one", "two", "three", "four", "five"], [90.0] * 5), ("flat", flat, 20, 20, ["x"] * 9, [99.0] * 9), ("short", [1, 2], 9, 9, None, None), ("null", None, 1, 1, None, None), ("zero", [], 0, 0, None, None)]
    df = spark.createDataFrame(rows, "id string, pixels array<int>, width int, height int, words array<string>, confidences array<double>")
    got = {r.id: r for r in M.analysed_pictures(df).collect()}
    assert got["busy"].has_text and abs(got["busy"].confidence - 0.9) < 1e-9 and len(got["busy"].perceptual_hash) == 16 and got["busy"].error is None
    assert not got["flat"].has_text and got["flat"].palette == ["#0a0a0a"] * 3 and got["flat"].edges == 0
    assert all(got[k].error and got[k].palette is None for k in ("short", "null", "zero"))
    assert M.analysed_pictures(df.limit(0)).count() == 0
    red, blue, green = [255, 0, 0] * 4, [0, 0, 255] * 4, [0, 255, 0] * 4
    frames = spark.createDataFrame([("v", k, p) for k, p in enumerate([red, red, blue, red, green, None])] + [("w", 0, red)], "video string, frame int, pixels array<int>")
    assert {(r.video, r.frame, r.place) for r in M.chosen_frames(frames, "video", "frame", 3).collect()} == {("v", 0, 0), ("v", 2, 1), ("v", 4, 2), ("w", 0, 0)}


def test_heaviest_frames(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, rng.normal(size=6).tolist()) for g in ("a", "b") for k in range(8)] + [("a", 99, None)]
    got = {(r.g, r.place): (r.k, r.weight) for r in M.heaviest_frames(spark.createDataFrame(rows, "g string, k int, embedding array<double>"), "g", "k", 2, temperature=0.5).collect()}
    for g in ("a", "b"):
        x = np.array([v for h, _, v in rows if h == g and v])
        z = x @ x.mean(axis=0) / 0.5
        w = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [got[g, p + 1] for p in range(2)] == [(int(i), round(float(w[i]), 6)) for i in np.argsort(-w)[:2]]


def test_neighbours(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres])
    rows = [(k, v.tolist(), "extra") for k, v in enumerate(x)] + [(9000, None, ""), (9001, [1.0], ""), (9002, [0.0] * 16, "")]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, query_id string")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, len(x), 40)] + [(-1, None)], "query_id bigint, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, len(x), 40) for i in np.argsort(-(unit @ unit[q]), kind="stable")[:5]}
    exact = N.nearest(df, queries, 5)
    assert {(r.query_id, r.id) for r in exact.collect()} == want
    with monkeypatch.context() as m:
        m.setattr(N, "BLOCK", 4)
        assert {(r.query_id, r.id) for r in N.nearest(df, queries, 5).collect()} == want
    index = N.CellIndex(spark, str(tmp_path / "index"))
    cells = index.build(df)
    assert spark.read.parquet(str(tmp_path / "index" / "rows")).count() == len(x)  # every row is indexed
    assert {(r.query_id, r.id) for r in index.search(queries, 5).collect()} == want
    found = index.search(queries, 5, max(1, cells // 4))
    assert N.recall(found, exact).first().recall >= 0.95
    one = index.search(queries.filter("query_id = 0"), 5, 1)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString() or "cell#" in one._jdf.queryExecution().executedPlan().toString()
    assert N.nearest(df.limit(0), queries, 5).count() == 0 and N.nearest(df, queries.limit(0), 5).count() == 0


def test_filters_totals_and_samples(spark):
    rows = [("a", "media", "image/png", "p", [1.0]), ("b", "media", "video/mp4", "p", [1.0]), ("c", "media", None, None, [1.0]), ("d", "media", "image/gif", "q", None)]
    df = spark.createDataFrame(rows, "id string, kind string, content_type string, parent_asset_id string, embedding array<double>")
    ids = lambda f: {r.id for r in f.apply(df).collect()}
    assert ids(S.SearchFilter(content_prefix="image/")) == {"a"} and ids(S.SearchFilter(parent="p")) == {"a", "b"}
    assert S.total(df, 3).first().total == 3 and S.total(df.limit(0), 3).first().total == 0
    docs = spark.createDataFrame([(f"d{k:02d}", '{"n": %d, "o": {"x": "é"}, "z": null}' % k) for k in range(30)] + [("bad", "{"), ("null", None), ("list", '[{"n": 7.5}]')], "record_id string, body string")
    got = {r.path: r.samples for r in P.sample_values(docs).collect()}
    assert got == {"n": [str(k) for k in range(10)], "o": ['{"x": "é"}'] * 10, "o.x": ['"é"'] * 10}
