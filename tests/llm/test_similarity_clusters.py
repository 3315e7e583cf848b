import numpy as np
from pyspark.sql import functions as F

from catalith.llm import similarity_clusters as C


def data(seed=0, size=64):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(12, size)))
    near = unit(centres[0] + 0.78 * unit(rng.normal(size=size)))  # a known centre beside another
    rows, truth = [], {}
    for k, (c, n, spread) in enumerate([(c, 8 + 6 * i, 0.035 + 0.03 * (i % 2)) for i, c in enumerate(centres)] + [(near, 30, 0.035)]):
        if k in (0, 12):
            spread = 0.03
        for v in unit(c + rng.normal(size=(n, size)) * spread):
            name = f"{rng.integers(10**12):012d}"
            rows.append((name, [float(x) for x in v], "x"))
            truth[name] = k
    for _ in range(60):
        rows.append((f"{rng.integers(10**12):012d}", [float(x) for x in unit(rng.normal(size=size)) * 3], "x"))
    twin = [float(x) for x in unit(rng.normal(size=size))]
    rows += [("twin1", twin, "x"), ("twin2", twin, "x"), ("twin2", twin, "x")]
    truth |= {"twin1": 99, "twin2": 99}
    rows += [("null", None, "x"), ("short", [1.0], "x"), ("zero", [0.0] * size, "x"), ("hole", [None] + [0.1] * (size - 1), "x"), ("nan", [float("nan")] * size, "x"), (None, twin, "x")]
    known = [("k0", [float(x) for x in centres[0] * 2], 0.9), ("k12", [float(x) for x in near], 0.9), ("kn", None, 0.9), ("kt", [float(x) for x in centres[3]], None)]
    return rows, truth, known


def test_partition_equals_truth(spark):
    rows, truth, known = data()
    df = spark.createDataFrame(rows, "id string, embedding array<double>, label string")
    found = C.clusters(df, spark.createDataFrame(known, "id string, centroid array<double>, threshold double"))
    got = {r.id: r.cluster for r in found.collect()}
    groups = {}
    for name, k in truth.items():
        groups.setdefault(k, []).append(name)
    assert got == {name: min(groups[k]) for name, k in truth.items()}
    about = {r.cluster: r for r in C.described(found).collect()}
    assert {c: r["size"] for c, r in about.items()} == {min(g): len(g) for g in groups.values()}
    assert all(len(r.typical) == min(3, r["size"]) for r in about.values())


def test_empty_and_single(spark):
    schema = "id string, embedding array<double>"
    assert C.clusters(spark.createDataFrame([], schema)).count() == 0
    assert C.clusters(spark.createDataFrame([("a", [1.0] * 64), ("b", None)], schema)).count() == 0


def found(spark, rows, known):
    df = spark.createDataFrame(rows, "id string, embedding array<double>, label string")
    return {r.id: r.cluster for r in C.clusters(df, spark.createDataFrame(known, "id string, centroid array<double>, threshold double")).collect()}


def test_the_embedding_decides(spark, monkeypatch):
    rows, truth, _ = data(2)
    rows = [r for r in rows if r[0] is None or truth.get(r[0]) != 12]
    known = [("none", None, None)]
    groups = {}
    for name, k in truth.items():
        if k != 12:
            groups.setdefault(k, []).append(name)
    want = {name: min(g) for g in groups.values() for name in g}
    got = found(spark, rows, known)
    agree = sum(got.get(i) == c for i, c in want.items())
    assert agree >= 0.99 * len(want) and agree >= 0.99 * len(got)  # recall and precision on the planted clusters
    for name, dummy in (
        ("spectral_labels", lambda edges, nodes, *a, **k: nodes.select("id", F.col("id").alias("label"))),  # every node by itself
        ("spectral_labels", lambda edges, nodes, *a, **k: nodes.select("id", F.lit(1).cast("bigint").alias("label"))),  # all one
        ("embedding", lambda edges, nodes, *a, **k: nodes.select("id", *[F.lit(0.0).cast("float").alias(f"x{i}") for i in range(6)])),  # affinities without the iteration
    ):
        with monkeypatch.context() as m:
            m.setattr(C, name, dummy)
            other = found(spark, rows, known)
        assert sum(other.get(i) == c for i, c in want.items()) < 0.6 * len(want), name


def test_crowded_cells_are_divided(spark):
    rows, _, _ = data(3)
    df = spark.createDataFrame([r for r in rows if r[0]], "id string, embedding array<double>, label string")
    vectors = C.unit_vectors(df, "id", "embedding", 64).select(F.xxhash64("id").alias("id"), "vec").dropDuplicates(["id"])
    table = np.frombuffer(b"".join(bytes(r.vec) for r in vectors.orderBy("id").limit(2).collect()), np.float32).reshape(-1, 64)
    plain = {(r.a, r.b) for r in C.affinities(vectors, table, 0.8, 1, 6).collect()}
    assert {(b, a) for a, b in plain} == plain
    for crowded in (200, 40):  # divided by pivots of their own, and compared in blocks where they are still crowded
        some = {(r.a, r.b) for r in C.affinities(vectors, table, 0.8, 1, 6, crowded).collect()}
        assert len(some & plain) > 0.9 * len(plain)


def test_every_vector_meets_every_centre(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v, axis=-1, keepdims=True)).astype(np.float32)
    x, c = unit(rng.normal(size=(500, 8))), unit(rng.normal(size=(60, 8)))
    least = rng.choice([0.5, 0.72, 0.9], 60)
    points = spark.createDataFrame([(f"v{i}", bytes(v.tobytes())) for i, v in enumerate(x)], "id string, vec binary")
    centres = spark.createDataFrame([(i, float(t), i % 7 == 0, bytes(v.tobytes())) for i, (v, t) in enumerate(zip(c, least, strict=True))], "label bigint, threshold double, last boolean, vec binary")
    got = {r.id: r.label for r in C.nearest_centres(points, centres, 500, group=30).collect()}
    score = np.where(x @ c.T >= least, x @ c.T - 2.0 * (np.arange(60) % 7 == 0), -9)
    assert got == {f"v{i}": int(k) for i, k in enumerate(score.argmax(axis=1)) if score[i, k] > -9}
