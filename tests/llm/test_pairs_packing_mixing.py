import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from catalith.llm import cooccurrence, mixing, packing, tokens

needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no vocabulary files")


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        tags = [rng.choice(["A ", "b", "c", "d", "e", "f", "g", None, " "]) for _ in range(rng.randint(0, 4))]
        rows.append((f"r{rng.randint(0, 300)}", ["hot", *tags] if i % 3 else tags if i % 7 else None, "x"))
    df = spark.createDataFrame(rows, "asset_id string, tags array<string>, n string")
    baskets = defaultdict(set)
    for a, t, _ in rows:
        baskets[a] |= {x.strip().lower() for x in t or [] if x and x.strip()}
    baskets = [b for b in baskets.values() if b]
    one, two = Counter(x for b in baskets for x in b), Counter(p for b in baskets for p in itertools.combinations(sorted(b), 2))
    for ratio in (0.0, 1.1):
        got = {(r.tag_a, r.tag_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrence.pairs(df, ratio=ratio).collect()}
        assert got == {(a, b): (k, one[a], one[b], len(baskets)) for (a, b), k in two.items() if k >= 3 and k / len(baskets) >= 0.005 and k * len(baskets) / (one[a] * one[b]) >= ratio} and got
    assert cooccurrence.pairs(df.limit(0)).count() == 0


def test_pairs_with_more_items_than_a_literal_holds(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"r{i}", [rng.choice("abcdefgh") for _ in range(5)]) for i in range(200)], "asset_id string, tags array<string>")
    rows = lambda: {tuple(r) for r in cooccurrence.pairs(df, ratio=0.0).collect()}
    want = rows()
    monkeypatch.setattr(cooccurrence, "MOST_ITEMS", 3)
    assert want and rows() == want


@needs_ranks
def test_a_hundred_and_one_kinds_of_containers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i % 40 + 1)) for i in range(60)], "doc_id bigint, text string")
    specs = spark.createDataFrame([(f"s{i}", 10 + i) for i in range(101)], "spec_name string, capacity_tokens int")
    rows = packing.layout(docs, specs).collect()
    assert len({r.spec_name for r in rows}) == 101
    assert len({sum(x.n_tokens for x in rows if x.spec_name == s) for s in ("s0", "s50", "s100")}) == 1
    monkeypatch.setattr(packing, "MOST_KINDS", 100)
    with pytest.raises(ValueError):
        packing.layout(docs, specs)


def test_hilbert_is_a_path_through_all_cells():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pack_keeps_every_token():
    rng = random.Random(2)
    items = [(i, rng.choice([1, 3, 50, 300, 511, 512, 513, 1024, 5000])) for i in range(500)]
    bins = list(packing.pack(iter(items), 512))
    assert all(0 < sum(t[-1] for t in b) <= 512 for b in bins)
    spans = defaultdict(list)
    for b in bins:
        for d, piece, start, n in b:
            spans[d].append((piece, start, n))
    for d, size in items:
        own = sorted(spans[d])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for *_, n in own) == size and len(own) == -(-size // 512)
        assert [s for _, s, _ in own] == list(itertools.accumulate([0, *(n for *_, n in own)]))[:-1]


@needs_ranks
def test_layout_and_fill(spark, sf):
    from catalith.sources.tables import table

    docs, specs = table(spark, sf, "documents"), table(spark, sf, "container_spec")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "word " * 30000), (None, "x")], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    counts = {r.doc_id: r.n_tokens for r in tokens.counted(docs.filter("doc_id IS NOT NULL"), ["doc_id"]).collect()}
    for size in (packing.TASK_TOKENS, 20_000):
        rows = packing.layout(docs, specs, task_tokens=size).collect()
        for spec, capacity in ((r.spec_name, r.capacity_tokens) for r in specs.collect()):
            own = [r for r in rows if r.spec_name == spec]
            load, total, pieces = Counter(), Counter(), Counter()
            for r in own:
                load[r.container] += r.n_tokens
                total[r.doc_id] += r.n_tokens
                pieces[r.doc_id] += 1
            assert max(load.values()) <= capacity and total == {d: n for d, n in counts.items() if n}
            assert all(pieces[d] == -(-n // capacity) for d, n in counts.items() if n)
            if size == packing.TASK_TOKENS and capacity == 512:
                assert sum(load.values()) / (len(load) * 512) > 0.98
    assert packing.layout(docs.limit(0), specs).count() == 0


@needs_ranks
def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(1, 200))) + str(i), rng.choice(["big", "big", "big", "small", "none"])) for i in range(600)]
    docs += [(10_000 + i, t, s) for i, (_, t, s) in enumerate(docs[:50])] + [(20_000, None, "big"), (None, "x", "big"), (20_001, "x", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("h", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mixture(df, targets)
    rows = mixed.collect()
    text = {d: t for d, t, _ in docs}
    uses = Counter()
    for r in rows:
        uses[text[r.doc_id]] += r.repeats
        assert r.repeats <= (1 if r.source == "big" else 3) and r.source != "none"
    assert max(uses.values()) <= 3
    reached = {r.source: r.reached_share for r in mixing.shares(mixed, plan).collect()}
    assert abs(reached["big"] - 5 / 9) < 0.01 and abs(reached["small"] - 4 / 9) < 0.01 and reached["absent"] == 0
    full = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    assert full["big"].most_repeats == 1 or full["small"].most_repeats == 3  # as much as the limits allow
    empty, plan = mixing.mixture(df.limit(0), targets)
    assert empty.count() == 0 and mixing.shares(empty, plan).count() == 3


@needs_ranks
def test_token_counts_survive_odd_texts(spark):
    rows = [(1, "hello world"), (2, None), (3, "<|endoftext|>"), (4, "日本語 ñ 🙂"), (5, "a" * 20000), (6, "a" + " " * 1_000_000 + "b"), (7, "\ud800 lone".encode("utf-8", "replace").decode())]
    got = {r.i: r.n_tokens for r in tokens.counted(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] > 1 and got[4] > 3 and got[5] > 100 and got[6] > 2
    enc = tokens.encoding()
    import regex

    for text in ("It's 12 words,  with\n\n blanks\t!", "日本 語  x", "a  " * 50):
        assert enc.encode_ordinary(text) == [t for m in regex.finditer(tokens.PATTERN, text) for t in enc._encode_single_piece(m.group())]
