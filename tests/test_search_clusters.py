import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalith.functions import vector
from catalith.operators import clusters as C
from catalith.operators import hashes as H
from catalith.operators import search as S

ASSET = "id string, kind string, owner string, cluster_id string, status string, tags array<string>, embedding array<float>, metadata string, similarity int"


@pytest.fixture(scope="module")
def assets(spark):
    def row(i, kind, owner, cluster, tags, e, meta=None):
        return (i, kind, owner, cluster, "done", tags, e, meta, 1)

    return spark.createDataFrame(
        [
            row("a", "media", "o1", "c1", ["x", "y"], [1.0, 0.0], '{"ocr_text": "Big Ledger"}'),
            row("b", "media", "o2", "c1", ["y", None], [0.8, 0.6], '{"ocr_text": "ledger"}'),
            row("c", "media", "o1", None, None, [0.0, 1.0]),
            row("d", "document", "o1", None, [], [-1.0, 0.0]),
            row("e", "media", None, "c2", ["x"], None, '{"ocr_text": "ledger"}'),
            row("f", "media", "o1", "c2", ["z"], [0.0, 0.0]),
            row("g", "document", "o1", None, [], [0.6, 0.8]),
        ],
        ASSET,
    )


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([("c1", "one", [2.0, 0.0], 0.7, True), ("c2", "two", [0.0, 1.0], None, False), ("c3", "three", None, 0.5, True), ("c4", "four", [0.99, 0.1], 0.0, False)], "id string, name string, centroid array<float>, threshold double, provisional boolean")


def test_similarity_and_filters(spark, assets, clusters):
    rows = {r.id: r for r in S.semantic_search(assets, clusters, [1.0, 0.0]).collect()}
    assert {k: r.similarity for k, r in rows.items()} == {"a": 1.0, "b": 0.9, "c": 0.5, "g": 0.8} and rows["a"].cluster_name == "one"
    for where, n in ((S.SearchFilter(), 1), (S.SearchFilter(kind="media"), 2), (S.SearchFilter(kind="media", owner="o", cluster_id="c", tags=("x",)), 5)):
        assert len(where.conditions()) == n
    assert [r.id for r in S.semantic_search(assets, clusters, [1.0, 0.0], S.SearchFilter(tags=("x", "z"))).collect()] == ["a"]
    with pytest.raises(ValueError):
        S.SearchFilter(kind="picture")
    for bad in ("", "  ", "x", "y" * 501, None):
        with pytest.raises(ValueError):
            S.valid_query(bad)
    assert S.valid_query("  ab ") == "ab"
    assert S.scored(assets, [1.0, 0.0, 0.0]).count() == 0  # another dimension matches nothing


def test_union_hybrid_tags(spark, assets):
    q = [1.0, 0.0]
    assert [(r.id, r.leg) for r in S.unified_search(assets, q).collect()] == [("a", "media"), ("b", "media"), ("g", "document"), ("c", "media")]
    assert S.unified_search(assets, q, kind="audio").count() == 0
    got = {r.id: (r.similarity, r.found_by) for r in S.hybrid_search(assets, q, "ledger").collect()}
    assert got == {"a": (1.0, "both"), "b": (1.0, "both"), "c": (0.5, "vector"), "e": (0.6, "keyword")}
    assert [r.id for r in S.tag_search(assets, ["x", "y"]).collect()] == ["a", "b", "e"]
    assert spark.range(1).select(S.tag_list(F.lit(" a, ,b,")).alias("t")).first().t == ["a", "b"]


def test_cluster_operators(spark, assets, clusters):
    best = {r.id: r.cluster_id for r in C.assign_best(assets, clusters).collect()}
    assert best == {"a": "c1", "b": "c4", "c": "c2", "g": "c2"}
    assert best == {r.id: r.cluster_id for r in C.assign_best(assets, clusters, block=1).collect()}
    assert {r.cluster_id: r.assets for r in C.cluster_counts(clusters, assets).collect()} == {"c1": 2, "c2": 2, "c3": 0, "c4": 0}
    stats = C.global_statistics(clusters, assets).first()
    assert (stats.clusters, stats.provisional, stats.mean_assets, stats.clustered, stats.unclustered) == (4, 2, 1.0, 4, 3)
    q = C.centroid_quality(clusters, assets).filter("cluster_id = 'c1'").first()
    assert (q.members, q["mean"], q.least, q.most) == (2, 0.9, 0.8, 1.0)
    assert [(r.a, r.b) for r in C.merge_candidates(clusters, 0.9).collect()] == [("c1", "c4")]
    kept, moved = C.merge(clusters, assets, ["c1"], "c2")
    assert kept.count() == 3 and moved.filter("cluster_id = 'c2'").count() == 4
    assert np.allclose(kept.filter("id = 'c2'").first().centroid, np.array([0.9, 0.3]) / np.hypot(0.9, 0.3), atol=1e-6)
    for bad in (lambda: C.merge(clusters, assets, ["c1"], "c1"), lambda: C.changed(clusters, "c1", threshold=2), lambda: C.changed(clusters, "c1", name="two"), lambda: C.changed(clusters, "c2", confirm=True), lambda: C.changed(clusters, "zz")):
        with pytest.raises(ValueError):
            bad()
    assert C.changed(clusters, "c1", name="uno", confirm=True).filter("id = 'c1'").first().name == "uno"


def test_merge_candidates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.3])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"{i:03d}", "n", [float(x) for x in r], 0.7, True) for i, r in enumerate(v)], "id string, name string, centroid array<double>, threshold double, provisional boolean")
    got = {(r.a, r.b) for r in C.merge_candidates(df, 0.85).collect()}
    assert got == {(f"{i:03d}", f"{j:03d}") for i, j in itertools.combinations(range(len(v)), 2) if v[i] @ v[j] >= 0.85} and got


def test_leader_fold(spark):
    angles = [0, 10, 90, 80]
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(angles)]
    assert list(C.leader_fold(pd.DataFrame(rows, columns=["id", "embedding"]), 0.9).cluster_no) == [0, 0, 1, 1]
    df = spark.createDataFrame([("g", i, str(i), e) for i, e in rows] + [("g", 9, "9", None)], "b string, o int, id string, embedding array<double>")
    assert [r.cluster_no for r in C.leader_clustering(df, "b", "o", 0.9).orderBy("id").collect()] == [0, 0, 1, 1]


def test_mean_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), ("c", [0.0, 0.0])], "k string, v array<double>")
    got = {r.k: r.centroid for r in vector.mean_vector(df, ["k"], "v").collect()}
    assert np.allclose(got["a"], [2**-0.5] * 2) and got["c"] == [0.0, 0.0] and "b" not in got


def test_hamming_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    vals = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b, i, j in zip(base, rng.integers(0, 64, 40), rng.integers(0, 64, 40), strict=True)] + base[:5]
    rows = [(f"{i:03d}", f"{v:016x}" if i % 3 else f" 0X{v:016X}") for i, v in enumerate(vals)] + [("n", None), ("m", "zz"), ("000", f"{vals[0]:016x}")]
    df = spark.createDataFrame(rows, "id string, value string")
    got = {r.id: (r.first_near, r.near) for r in H.near_duplicates(df, "id", F.col("value")).collect()}
    want = {}
    for i, v in enumerate(vals):
        near = [f"{j:03d}" for j, w in enumerate(vals) if j != i and bin(v ^ w).count("1") <= 4]
        if near:
            want[f"{i:03d}"] = (near[0], len(near))
    assert got == want
    assert H.near_duplicates(df.limit(0), "id", F.col("value")).count() == 0


def test_near_values_divide_crowded_cells(spark):
    rng = random.Random(9)
    values = list({rng.getrandbits(64) & 0x3FFFF for _ in range(250)})
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    want = {(a, b, bin(a ^ b).count("1")) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 4}
    for largest in (10_000, 40, 8):
        assert {tuple(r) for r in H.near_values(df, largest).collect()} == want


def test_clusters_in_several_blocks(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    c, x = unit(rng.normal(size=(101, 8))), rng.normal(size=(60, 8))
    known = spark.createDataFrame([(f"c{i:03d}", v.tolist(), 0.5, "n") for i, v in enumerate(c)] + [("none", None, None, "n")], "id string, centroid array<double>, threshold double, name string")
    pairs = {(f"c{i:03d}", f"c{j:03d}") for i in range(101) for j in range(i + 1, 101) if c[i] @ c[j] >= 0.6}
    for block in (5000, 30):
        assert {(r.a, r.b) for r in C.merge_candidates(known, 0.6, block).collect()} == pairs
    vectors = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(unit(x))], "id string, embedding array<double>")
    best = {f"v{i}": f"c{int(k):03d}" for i, k in enumerate((unit(x) @ c.T).argmax(axis=1)) if (unit(x) @ c.T)[i, k] >= 0.5}
    for block in (5000, 30):
        assert {r.id: r.cluster_id for r in C.assign_best(vectors, known, block).collect()} == best
        labels = known.select(F.col("id").alias("label"), "centroid")  # 101 labels, every one a candidate
        ranked = {(r.id, r.place): r.label for r in C.nearest_labels(vectors, "id", labels, 3, block=block).collect()}
        assert ranked == {(f"v{i}", p + 1): f"c{int(k):03d}" for i, row in enumerate(np.argsort(-(unit(x) @ c.T), axis=1)[:, :3]) for p, k in enumerate(row)}
    assert C.nearest_labels(vectors, "id", labels.limit(0), 3).count() == 0 and C.merge_candidates(known.limit(0)).count() == 0
