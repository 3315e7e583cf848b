import random

from pyspark.sql import functions as F

from catalith.operators import deliveries as D


def test_uuid_notations(spark):
    u = "4e989d34-970c-4b27-8091-9c214ebe236b"
    rows = [(u,), (u.upper(),), (u.replace("-", ""),), ("{" + u + "}",), ("urn:uuid:" + u,), (f" {u}\t",), ("no uuid",), (None,), ("",)]
    out = [r.v for r in spark.createDataFrame(rows, "j string").select(D.uuid_value(F.col("j")).alias("v")).collect()]
    assert out[:6] == [u.replace("-", "")] * 6
    assert out[6] == "text:no uuid" and out[7] is None and out[8] == "text:"


def test_surplus_equals_brute_force_with_hot_key_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "b", "c", " a ", None]), rng.choice([None, 0, 1]), f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "arrival_no bigint, k0 string, delivery int, place string")
    identity = [D.stripped(F.col("k0")), F.coalesce("delivery", F.lit(0))]
    got = {r.arrival_no for r in D.surplus_deliveries(df, identity, [F.col("arrival_no")], "arrival_no").collect()}
    seen, want = set(), set()
    for a, k, r, _ in rows:
        if k is None:
            continue
        key = (k.strip(), r or 0)
        (want.add(a) if key in seen else seen.add(key))
    assert got == want
    kept = D.keep_first(df, identity, [F.col("arrival_no")])
    assert {r.arrival_no for r in kept.collect()} == {r[0] for r in rows} - want
    assert kept.columns == df.columns
    slim = D.kept_deliveries(df.unionByName(df.limit(40)), identity, [F.col("arrival_no")], "arrival_no")
    assert sorted(r.arrival_no for r in slim.collect()) == sorted({r[0] for r in rows} - want)
    assert slim.columns == df.columns


def test_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "arrival_no bigint, k string")
    assert [r.arrival_no for r in D.surplus_deliveries(df, [F.col("k")], [F.col("arrival_no")], "arrival_no").collect()] == [2]
    assert D.keep_first(df, [F.col("k")], [F.col("arrival_no")]).count() == 1
    assert D.surplus_deliveries(df.limit(0), [F.col("k")], [F.col("arrival_no")], "arrival_no").count() == 0
    assert D.keep_first(df.limit(0), [F.col("k")], [F.col("arrival_no")]).count() == 0
    assert [tuple(r) for r in D.kept_deliveries(df, [F.col("k")], [F.col("arrival_no")], "arrival_no").collect()] == [(1, "a")]
    assert D.kept_deliveries(df.limit(0), [F.col("k")], [F.col("arrival_no")], "arrival_no").count() == 0


def test_the_struct_decides_ties(spark):
    rows = [(3, "a", 5), (2, "a", 5), (1, "a", 9), (4, "b", None), (5, "b", 1)]
    df = spark.createDataFrame(rows, "arrival_no bigint, k string, seconds bigint")
    got = D.first_deliveries(df, [F.col("k")], [F.coalesce("seconds", F.lit(99))], "arrival_no")
    assert {(r.k0, r.delivery) for r in got.collect()} == {("a", 2), ("b", 5)}
