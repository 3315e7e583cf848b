import random

from pyspark.sql import functions as F

from catalith.llm import history as H

ASSET = "id string, ingest_no bigint, batch_no int, sha256 string, sha string, place int"
MEDIA = "asset_id string, perceptual_hash string, value string, mask int"


def brute(assets, media):
    import re

    def digits(s, n):
        s = (s or "").strip().lower().removeprefix("0x")
        return int(s, 16) if re.fullmatch(f"[0-9a-f]{{{n}}}", s) else None

    hashes = {}
    for a, h in media:
        v = digits(h, 16)
        if a is not None and v is not None:
            hashes.setdefault(a, set()).add(v)
    shas, vals, out = set(), set(), set()
    for i, _, b, s in sorted(set(assets), key=lambda r: (r[2] != 0, r[1], r[0])):
        sv, vs = digits(s, 64), hashes.get(i, set())
        if b and (sv in shas or any(bin(v ^ w).count("1") <= 4 for v in vs for w in vals)):
            out.add(i)
        else:
            shas |= {sv} - {None}
            vals |= vs
    return out


def frames(spark, assets, media):
    return spark.createDataFrame([(*r, "x", 1) for r in assets], ASSET), spark.createDataFrame([(*r, "x", 1) for r in media], MEDIA)


def case(seed, n=220, bits=9):
    rng = random.Random(seed)
    sha = lambda k: f"{k:064x}"
    assets, media = [], []
    for i in range(n):
        s = rng.choice([None, "bad", sha(rng.randint(0, 30)), sha(rng.randint(0, 30)).upper(), " 0x" + sha(1)])
        assets.append((f"a{rng.randint(0, 10**9)}-{i}", i, 0 if i < n // 3 else 1 + i // 60, s))
        v = sum(1 << rng.randint(0, 63) for _ in range(rng.randint(0, bits))) & (2**64 - 1)
        media.append((assets[-1][0], rng.choice([None, "", "n/a", f"{v:016x}", f"{v:016X} ", f"0x{v:016x}"])))
    return assets, media + media[:20] + [(None, "0" * 16)]


def test_chains_ties_and_repeats(spark):
    for seed in (1, 2):
        assets, media = case(seed)
        assets += assets[:10]
        a, m = frames(spark, assets, media)
        assert {r.id for r in H.reject(H.asset_keys(a, m)).collect()} == brute(assets, media)


def test_batches_that_overlap_are_taken_together(spark):
    assets, media = case(5, 120)
    rng = random.Random(5)
    assets = [(i, n, 0 if b == 0 else rng.choice([1, 2]), s) for i, n, b, s in assets]
    a, m = frames(spark, assets, media)
    assert {r.id for r in H.reject(H.asset_keys(a, m)).collect()} == brute(assets, media)


def test_large_cells_are_divided_without_loss(spark):
    rng = random.Random(3)
    values = list({rng.getrandbits(64) & 0xFFFFF for _ in range(300)})  # all share most bits
    table = H.pivot_table(spark.createDataFrame([(H.signed(v),) for v in values], "value bigint"))
    plain = {(r.a, r.b) for r in H.near_pairs(table, table).collect()}
    assert plain == {(a, b) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 4}
    for largest in (60, 8):  # divided once, and again
        assert plain == {(r.a, r.b) for r in H.near_pairs(table, table, largest=largest).collect()}


def test_every_level_of_masks_covers_all_bits():
    for level in range(H.LEVELS):
        assert len(H.masks(level)) == 15
        for _ in range(200):
            rng = random.Random(_)
            flipped = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(m & flipped == 0 for m in H.masks(level))


def test_pivots_prune_and_never_lose(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(200)]
    near = [v ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for v in base]
    rows = spark.createDataFrame([(H.signed(v), H.signed(w)) for v, w in zip(base, near)], "v bigint, w bigint")  # noqa: B905
    of = lambda c: H.pivot_table(rows.select(F.col(c).alias("value"))).filter("mask = 0").drop("mask", "bits")
    a, b = of("v").select("value", "d0", "d1", "d2"), of("w").select(F.col("value").alias("w"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(3)])
    close = (F.abs(F.col("d0") - F.col("e0")) <= 4) & (F.abs(F.col("d1") - F.col("e1")) <= 4) & (F.abs(F.col("d2") - F.col("e2")) <= 4)
    assert rows.join(a, F.col("v") == F.col("value")).join(b, "w").filter(~close).count() == 0
    assert a.join(b, F.lit(True)).filter(close).count() < 0.4 * 200 * 200


def batch(spark, ids, start=0):
    """(id, is_new, place, sha, hashes) of (sha number or None, list of hash values)."""
    rows = [(f"b{start + k:06d}", True, start + k, None if s is None else s.to_bytes(32, "big"), [H.signed(v) for v in vs] or None) for k, (s, vs) in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, is_new boolean, place bigint, sha binary, hashes array<bigint>")


def test_history_index_batch_by_batch(spark, tmp_path):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    index = H.HistoryIndex(spark, str(tmp_path / "index"), parts=16)
    assert index.admit(batch(spark, [(k, [v]) for k, v in enumerate(base)])).count() == 0
    # A document repeats an accepted sha256 and has no hash; near, too far, new, and copies inside the batch.
    fresh = rng.getrandbits(64)
    second = [(7, []), (None, [base[40] ^ 0b1111]), (None, [base[41] ^ 0b11111]), (None, [fresh, fresh ^ 1]), (None, [fresh ^ 2]), (1000, []), (1000, []), (None, [base[9]])]
    got = {r.id for r in index.admit(batch(spark, second, 1000)).collect()}
    assert got == {f"b{1000 + k:06d}" for k in (0, 1, 4, 6, 7)}
    # What the second batch added counts for the third.
    assert {r.id for r in index.admit(batch(spark, [(None, [fresh ^ 0b11]), (1000, []), (2000, [rng.getrandbits(64)])], 2000)).collect()} == {"b002000", "b002001"}


def test_a_batch_reads_only_the_partitions_it_falls_in(spark, tmp_path):
    rng = random.Random(5)
    index = H.HistoryIndex(spark, str(tmp_path / "index"), parts=16)
    index.append(batch(spark, [(k, [rng.getrandbits(64)]) for k in range(2000)]))
    everything = len(spark.read.parquet(str(tmp_path / "index" / "values")).inputFiles())
    probe = H.pivot_table(spark.createDataFrame([(H.signed(rng.getrandbits(64)),)], "value bigint"))
    table = index.probed(probe)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    read = table.select(F.input_file_name().alias("f")).distinct().count()
    assert everything >= 15 * 15 and read <= 15  # one partition of each mask
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_empty(spark):
    a, m = frames(spark, [], [])
    assert H.reject(H.asset_keys(a, m)).count() == 0
    a, m = frames(spark, [("x", 1, 0, None), ("y", 2, 1, None)], [])
    assert H.reject(H.asset_keys(a, m)).count() == 0


def test_hash_notation(spark):
    rows = ["FFFFFFFFFFFFFFFF", " 0x0000000000000001", "123", None, "g" * 16]
    out = [r.v for r in spark.createDataFrame([(x,) for x in rows], "h string").select(H.hash_value(F.col("h")).alias("v")).collect()]
    assert out == [-1, 1, None, None, None]
