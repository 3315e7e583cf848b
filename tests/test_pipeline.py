import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import resilience as R
from catalith.operators import clusters, media
from catalith.operators import pipeline as P


def test_file_validation(spark):
    rows = [("a/x.jpg", b"\xff\xd8\xff1", None), ("a/y.xyz", b"??", None), ("a/z.txt", b"text", "text/plain"), ("a/e.png", b"", "image/png"), ("a/big.json", b"x" * (10 * 1024**2 + 1), "application/json"), ("n", None, None)]
    got = {r.path: (r.kind, r.status_code) for r in P.validated_files(spark.createDataFrame(rows, "path string, content binary, declared string")).collect()}
    assert got == {"a/x.jpg": ("media", None), "a/y.xyz": ("unknown", 400), "a/z.txt": ("document", None), "a/e.png": ("media", 400), "a/big.json": ("json", 413), "n": ("unknown", 400)}
    bad = P.request_errors(P.validated_files(spark.createDataFrame(rows, "path string, content binary, declared string")).withColumn("r", F.lit("q")), "r").first()
    assert bad.status_code == 413 and len(bad.errors) == 3
    assets = P.ingest_files(spark.createDataFrame(rows[:2], "path string, content binary, declared string"), F.lit("req"), F.lit("p0")).collect()
    assert {(r.raw_uri, r.status) for r in assets} == {("fs://incoming/req/p0/x.jpg", "queued"), ("fs://incoming/req/p0/y.xyz", "failed")}


def test_json_ingest(spark):
    docs = spark.createDataFrame([(str(i), json.dumps({"a": i, "b": "x"})) for i in range(5)] + [("z", "no"), ("n", None)], "record_id string, body string")
    known = spark.createDataFrame([], "name string, structure_hash string, status string")
    out = P.ingest_json(docs, known, hint="My things")
    assert out["decision"].first().storage == "sql" and out["assets"].count() == 5
    schemas = out["schemas"].collect()
    assert [(r.name, r.status) for r in schemas] == [("my_things", "provisional")]
    again = P.ingest_json(docs, out["schemas"].select("name", "structure_hash", "status"))
    assert again["schemas"].count() == 1
    payloads = spark.createDataFrame([("1", '{"a": 1}'), ("2", '[{"a": 1}, 2]'), ("3", "[]"), ("4", "7"), ("5", None), ("6", "{")], "record_id string, body string")
    assert sorted((r.id, r.doc_no) for r in P.json_payloads(payloads).collect()) == [("1", 0), ("2", 0), ("2", 1)]
    assert P.sampled(docs, limit=3).collect() == P.sampled(docs.repartition(3), limit=3).collect()


def test_documents_and_names(spark):
    files = spark.createDataFrame([("d/a.txt", bytearray(b"One\n\nTwo")), ("d/b.pdf", bytearray(b"%PDF"))], "path string, content binary")
    out = P.ingest_documents(files)
    rows = out["chunks"].orderBy("chunk_index").collect()
    assert [(r.asset_id, r.text) for r in rows] == [("d/a.txt", "One"), ("d/a.txt", "Two")] and len(rows[0].embedding) == 768
    assert out["failures"].count() == 1 and out["media"].count() == 0
    fresh = out["chunks"].select("asset_id", "text")
    assert P.replaced_chunks(spark.createDataFrame([("d/a.txt", "old"), ("c", "kept")], "asset_id string, text string"), fresh).count() == 3
    names = {r.i: r.unique_name for r in P.unique_names(spark.createDataFrame([("a", "N"), ("b", "N"), ("cccccccccc", None), ("d", " ")], "i string, n string"), "i", "n").collect()}
    assert names == {"a": "N", "b": "N_1", "cccccccccc": "Cluster cccccccc", "d": "Cluster d"}
    labels = P.labelled_clusters(spark.createDataFrame([("c", "1", ["x", "y"]), ("c", "2", ["x"]), ("e", "3", None)], "cluster_id string, id string, tags array<string>"))
    assert {r.cluster_id: r.label for r in labels.collect()} == {"c": "x y", "e": "Mixed Content"}


def test_media_ingest(spark):
    stored = spark.createDataFrame([("s1", "h1", f"{5:016x}", "c9", "done", 1), ("s2", "h2", f"{5 ^ 0b11:016x}", "c8", "done", 2), ("s3", "h3", None, "c7", "queued", 3)], "id string, sha256 string, perceptual_hash string, cluster_id string, status string, created_at int")
    fresh = spark.createDataFrame([("n1", "h1", None, [1.0, 0.0]), ("n2", "x", f"{5 ^ 0b100:016x}", [1.0, 0.0]), ("n3", "h3", f"{2**40 - 1:016x}", [1.0, 0.0]), ("n4", None, None, None)], "id string, sha256 string, perceptual_hash string, embedding array<double>")
    known = spark.createDataFrame([("c1", [1.0, 0.0], 0.7)], "id string, centroid array<double>, threshold double")
    got = {r.id: (r.duplicate_of, r.cluster_id) for r in P.ingest_media(fresh, stored, known).collect()}
    assert got == {"n1": ("s1", "c9"), "n2": ("s1", "c9"), "n3": (None, "c1"), "n4": (None, None)}


def test_frames_audio_and_agglomeration():
    red, blue = np.full((4, 4, 3), [250, 0, 0], np.uint8), np.full((4, 4, 3), [0, 0, 250], np.uint8)
    assert media.sampled_frames([red, red, red, red, blue], [0, 0.5, 1.0, 1.5, 2.0]) == [0, 1, 2, 4]
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([0, 16384] * 4000, np.int16).tobytes())
    f = media.wave_features(buf.getvalue(), 4)
    assert (f["duration"], f["sample_rate"], f["envelope"]) == (1.0, 8000, [0.5] * 4)
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [0.7, 0.71]])
    assert list(clusters.agglomerate(v, 0.9))[:4] == [0, 0, 1, 1] and len(set(clusters.agglomerate(v, 0.9, 0.4))) == 2


def test_resilience():
    now = [0.0]
    b = R.CircuitBreaker(2, 60, clock=lambda: now[0])
    fail = lambda: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(fail)
    with pytest.raises(R.CircuitOpen):
        b.call(fail)
    now[0] = 61
    assert b.state == "half-open" and b.call(lambda: 3) == 3 and b.state == "closed"
    waits, calls = [], []

    @R.retrying(3, sleep=waits.append)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert flaky() == "ok" and waits == [1.0, 2.0]
    assert R.first_of(fail, lambda: None, lambda: 5)() == 5
    with pytest.raises(ZeroDivisionError):
        R.first_of(fail)()
    slow = R.timed(0.0)(lambda: 1)
    assert slow() == 1 and slow.last_ms >= 0
