"""Duplicates and near-duplicates of new batches against everything accepted so far.

Near-duplicates are perceptual hashes at a Hamming distance of at most :data:`RADIUS`. The history is a stored pivot-distance table
(:class:`HistoryIndex`): for every accepted hash value its distances to fixed pivots. By the triangle inequality the distances of two near hashes to
any pivot differ by at most the radius, which prunes candidates before the true distance is verified. Over whole 64-bit hashes
all distances lie near 32, so ranges of them alone cannot divide the table: a range of +-4 around one pivot's distance holds more than half of it. The table
is therefore divided by masks first. The bits form :data:`BLOCKS` blocks; of four differing bits at least two of six blocks stay
free, so under one of the 15 pairs of blocks two near hashes have distance 0. A row is stored under each pair, in partitions by mask and by a hash
of the masked bits, sorted by pivot distance; a batch reads the partitions its own hashes fall in and joins on (mask, bits, band of pivot
distances), trying the bands that the range of +-4 touches. New batches are taken one after the other; what a batch adds is appended, and
nothing stored is read for any other purpose, rewritten, or made distinct.

Cells with more than :data:`CELL` values (many hashes that share 22 bits) are divided again, and again, by pairs of blocks of the
bits still free (:func:`_divided`), so no crowded cell emits all its pairs, and none is dropped.

Acceptance goes by order of arrival: an asset is rejected if it agrees with an asset accepted earlier. Assets with
the same keys are one node, keys the history holds reject at once, and what remains of a batch is decided in rounds: the earliest
undecided asset of all its keys' neighbourhoods is accepted and rejects the others there. Only minima per key
are exchanged, so a key with a third of all rows is pre-aggregated in the map tasks.

Defined cases: hashes that are null or not 64 bits (sha256: 256 bits) of hexadecimal digits agree with nothing; an
asset with several hashes agrees if one of them does; repeated rows count once; batch 0 comes before all others and
equal arrival numbers are ordered by id; a null batch number counts as new, a null arrival number comes last; batches whose arrival numbers
overlap are taken together.
"""

from __future__ import annotations

import itertools
import random
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.deliveries import stripped
from catalith.session import drop_folder, drop_stash, scratch, stash

RADIUS, BITS, BLOCKS, PIVOTS, CELL = 4, 64, 6, 3, 4096
#: Width of a band of pivot distances, and levels at which crowded cells are divided.
BAND, LEVELS = 5, 3
_DRAW = random.Random(20)
#: The fixed pivots. Changing them makes stored tables useless.
PIVOT_VALUES = [_DRAW.getrandbits(64) for _ in range(PIVOTS)]
#: Rows of the pivot-distance table that a partition should have, and least and most partitions of a mask.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4_000_000, 1, 4096


def hex_digits(text: Column, digits: int) -> Column:
    """The lower-case hexadecimal digits that the text denotes, null unless there are exactly so many."""
    plain = F.regexp_replace(stripped(F.lower(text)), "^0x", "")
    return F.when(plain.rlike(f"^[0-9a-f]{{{digits}}}$"), plain)


def hash_value(text: Column) -> Column:
    """A 64-bit hash as a signed long."""
    return F.conv(hex_digits(text, 16), 16, -10).cast("long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(level: int) -> list[int]:
    """The masks of each pair of blocks. Every level forms its blocks in another way, so that those of the bits left free are of like size."""
    block = [(i // 6**level) % 6 if level < 2 else (i * 5 + i // 7) % 6 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if block[i] in pair) for pair in itertools.combinations(range(BLOCKS), 2)]


MASKS = masks(0)


def _bits(value: Column, mask: Column) -> Column:
    """The value's bits under the mask of a number."""
    return value.bitwiseAND(F.get(F.array(*[F.lit(signed(m)) for m in MASKS]), mask.cast("int")))


def distances() -> list[Column]:
    """d0, d1, …: the distances of ``value`` to the pivots."""
    return [F.bit_count(F.col("value").bitwiseXOR(F.lit(signed(p)))).cast("tinyint").alias(f"d{i}") for i, p in enumerate(PIVOT_VALUES)]


def pivot_table(values: DataFrame) -> DataFrame:
    """(value, d0, d1, …, mask, bits) for each of the distinct ``value`` and each mask."""
    each = F.explode(F.array(*[F.lit(i).cast("byte") for i in range(len(MASKS))])).alias("mask")
    return values.select("value", *distances(), each).withColumn("bits", _bits(F.col("value"), F.col("mask")))


def _verified(probe: DataFrame, table: DataFrame, on: list[str], radius: int) -> DataFrame:
    """Pairs that agree ``on``, whose pivot distances differ by no more than the radius, and that are near."""
    names = [f"d{i}" for i in range(PIVOTS)]
    bands = F.explode(F.sequence(F.floor((F.col("d0") - radius) / BAND).cast("int"), F.floor((F.col("d0") + radius) / BAND).cast("int"))).alias("band")
    a = probe.select(*on, F.col("value").alias("a"), *[F.col(n).alias("a" + n) for n in names], bands)
    b = table.select(*on, F.col("value").alias("b"), *[F.col(n).alias("b" + n) for n in names], F.floor(F.col("d0") / BAND).cast("int").alias("band"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    for n in names:
        near = (F.abs(F.col("a" + n).cast("int") - F.col("b" + n).cast("int")) <= radius) & near
    return a.join(b, [*on, "band"]).filter(near).select("a", "b")


def near_pairs(probe: DataFrame, table: DataFrame, radius: int = RADIUS, largest: int = CELL) -> DataFrame:
    """(a, b): each value a of ``probe`` with the other values b of the pivot-distance table at most ``radius`` away.
    Both are outputs of :func:`pivot_table`. ``radius`` is at most 4, else a mask free of differences may not exist."""
    if radius > BLOCKS - 2:
        raise ValueError("radius")
    free = F.bitwise_not(F.get(F.array(*[F.lit(signed(m)) for m in MASKS]), F.col("mask").cast("int"))).alias("free")
    slim = lambda df: df.select("value", *[f"d{i}" for i in range(PIVOTS)], F.xxhash64("mask", "bits").alias("cell"), free)
    probe, table = slim(probe), slim(table)
    pairs = None
    for level in range(1, LEVELS + 1):
        large = stash(table.groupBy("cell").count().filter(F.col("count") > largest).join(probe.select("cell"), "cell", "left_semi").select("cell"), "cells")
        done = level == LEVELS or large.isEmpty()
        own = probe if done else probe.join(large, "cell", "left_anti")
        found = _verified(own, table, ["cell"], radius)
        pairs = found if pairs is None else pairs.unionByName(found)
        if done:
            break
        probe, table = (stash(_divided(side.join(large, "cell", "left_semi"), level), "divided") for side in (probe, table))
    return pairs.distinct()


def _divided(rows: DataFrame, level: int) -> DataFrame:
    """Rows of crowded cells, in the cells of the pairs of blocks of the bits that are free in theirs."""
    sub = F.explode(F.array(*[F.lit(signed(m)) for m in masks(level)])).alias("sub")
    cells = rows.select("*", sub).withColumn("cell", F.xxhash64("cell", "sub", F.col("value").bitwiseAND(F.col("sub")).bitwiseAND(F.col("free"))))
    return cells.withColumn("free", F.col("free").bitwiseAND(F.bitwise_not("sub"))).drop("sub")


def asset_keys(assets: DataFrame, media: DataFrame) -> DataFrame:
    """(id, batch, is_new, place, sha, hashes): each asset with its order and its keys."""
    hashes = media.select(F.col("asset_id").alias("id"), hash_value(F.col("perceptual_hash")).alias("value")).filter("id IS NOT NULL AND value IS NOT NULL")
    hashes = hashes.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("hashes"))
    new = F.coalesce(F.col("batch_no") != 0, F.lit(True))
    rows = assets.filter("id IS NOT NULL").select("id", F.col("batch_no").alias("batch"), new.alias("is_new"), F.coalesce("ingest_no", F.lit(2**62)).alias("place"), F.unhex(hex_digits(F.col("sha256"), 64)).alias("sha"))
    return rows.join(hashes, "id", "left").filter("sha IS NOT NULL OR hashes IS NOT NULL")


def reject(keys: DataFrame, path: str | None = None) -> DataFrame:
    """(id): the new assets among :func:`asset_keys` that agree with one accepted earlier. The history goes into a :class:`HistoryIndex` at ``path`` (a folder
    of its own in the shared one by default), then batch after batch is held against it and what it adds is appended."""
    spark = keys.sparkSession
    keys = stash(keys, "keys")
    index = HistoryIndex(spark, path or f"{scratch(spark)}/history-{uuid.uuid4().hex}")
    history = keys.filter("NOT is_new")
    index.append(history)
    # Batches in order of arrival; one row per batch comes to the driver. Those that overlap are one.
    ranges = keys.filter("is_new").groupBy("batch").agg(F.min(F.struct("place", "id")).alias("first"), F.max(F.struct("place", "id")).alias("last")).orderBy("first").collect()
    steps: list[tuple[list, tuple]] = []
    for r in ranges:
        if steps and tuple(r.first) <= steps[-1][1]:
            steps[-1] = ([*steps[-1][0], r.batch], max(steps[-1][1], tuple(r.last)))
        else:
            steps.append(([r.batch], tuple(r.last)))
    out = keys.select("id").limit(0)
    for names, _ in steps:
        own = F.coalesce(F.col("batch").isin([n for n in names if n is not None]), F.lit(None in names)) if any(n is not None for n in names) else F.col("batch").isNull()
        out = out.unionByName(index.admit(keys.filter("is_new").filter(own)))
    if path is None:
        drop_folder(spark, index.path)
    return out.distinct()


def _round(open_: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over the undecided nodes: (all with whether they are accepted, the others with whether they are rejected by those)."""
    by_hash = open_.select("o", F.explode("hashes").alias("a"))
    first = by_hash.groupBy("a").agg(F.min("o").alias("m"))
    around = first.unionByName(pairs.join(first.withColumnRenamed("a", "b"), "b").select("a", "m")).groupBy("a").agg(F.min("m").alias("m"))
    best_hash = by_hash.join(around, "a").groupBy("o").agg(F.min("m").alias("mh"))
    of_sha = open_.filter("sha IS NOT NULL")
    best_sha = of_sha.select("o", "sha").join(of_sha.groupBy("sha").agg(F.min("o").alias("ms")), "sha").select("o", "ms")
    judged = stash(open_.join(best_hash, "o", "left").join(best_sha, "o", "left").select("o", "sha", "hashes", F.expr("coalesce(mh, o) = o AND coalesce(ms, o) = o").alias("accepted")), "judged")

    accepted, rest = judged.filter("accepted"), judged.filter("NOT accepted")
    taken = accepted.select(F.explode("hashes").alias("b")).distinct()
    near = pairs.join(taken, "b", "left_semi").select(F.col("a").alias("b")).unionByName(taken).distinct()
    hit = rest.select("o", F.explode("hashes").alias("b")).join(near, "b", "left_semi").select("o")
    hit = hit.unionByName(rest.filter("sha IS NOT NULL").join(accepted.filter("sha IS NOT NULL").select("sha").distinct(), "sha", "left_semi").select("o"))
    decided = rest.join(hit.distinct().withColumn("hit", F.lit(True)), "o", "left").select("o", "sha", "hashes", F.coalesce("hit", F.lit(False)).alias("rejected"))
    return judged, stash(decided, "decided")


class HistoryIndex:
    """The keys accepted so far: a pivot-distance table of hash values, partitioned by mask and by a hash of the masked bits and sorted by pivot
    distance, and the sha256 values, partitioned by hash. Batches append files and read the partitions that they fall in."""

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.parts)).cast("int").alias("part")

    def append(self, rows: DataFrame) -> None:
        """Add the distinct keys of accepted (sha, hashes); they must be new to the table. The first call fixes the number of partitions
        by the number of keys, if none is given."""
        values = rows.filter("hashes IS NOT NULL").select(F.explode("hashes").alias("value")).distinct()
        if self.parts is None:
            n = values.count()
            self.parts = min(MOST_PARTS, max(LEAST_PARTS, -(-n // PART_ROWS)))
        table = pivot_table(values).withColumn("part", self._part("bits")).drop("bits")
        table.repartition("mask", "part").sortWithinPartitions("mask", "part", "d0").write.mode("append").partitionBy("mask", "part").parquet(f"{self.path}/values")
        shas = rows.filter("sha IS NOT NULL").select("sha").distinct().withColumn("part", self._part("sha"))
        shas.repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.path}/shas")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was ever stored
            return None

    def probed(self, probe: DataFrame) -> DataFrame:
        """The stored rows in the partitions that the :func:`pivot_table` of a batch falls in. At most 15 x ``parts`` partition numbers come to the driver."""
        table = self._read("values", "value bigint, " + ", ".join(f"d{i} tinyint" for i in range(PIVOTS)) + ", mask tinyint, part int")
        wanted: dict[int, list[int]] = {}
        for r in probe.select("mask", self._part("bits")).distinct().collect():
            wanted.setdefault(r.mask, []).append(r.part)
        if table is None or not wanted:
            return probe.limit(0)
        here = F.lit(False)
        for mask, parts in sorted(wanted.items()):
            here = here | ((F.col("mask") == mask) & F.col("part").isin(sorted(parts)))
        return table.filter(here).withColumn("bits", _bits(F.col("value"), F.col("mask"))).select("value", *[f"d{i}" for i in range(PIVOTS)], "mask", "bits")

    def near(self, values: DataFrame, radius: int = RADIUS) -> DataFrame:
        """The distinct (value) that are stored or at most ``radius`` from a stored one."""
        probe = pivot_table(values)
        cells = probe.select("mask", "bits").distinct()
        table = stash(self.probed(probe).join(cells, ["mask", "bits"], "left_semi"), "probed")
        same = values.join(table.filter("mask = 0").select("value"), "value", "left_semi")
        return same.unionByName(near_pairs(probe, table, radius).select(F.col("a").alias("value"))).distinct()

    def held_shas(self, shas: DataFrame) -> DataFrame:
        """Those of the distinct (sha) that are stored."""
        table = self._read("shas", "sha binary, part int")
        parts = sorted(r.part for r in shas.select(self._part("sha")).distinct().collect())
        if table is None or not parts:
            return shas.limit(0)
        return shas.join(table.filter(F.col("part").isin(parts)).select("sha"), "sha", "left_semi")

    def admit(self, batch: DataFrame) -> DataFrame:
        """(id): the assets of a batch (id, is_new, place, sha, hashes) that agree with a stored key or with one accepted before them in the batch. The keys of
        the others are appended."""
        if self.parts is None:
            self.append(batch.limit(0))
        order = F.struct("is_new", "place", "id").alias("o")
        nodes = stash(batch.groupBy("sha", "hashes").agg(F.min(order).alias("o")), "nodes")
        copies = batch.select("id").join(nodes.select("o.id"), "id", "left_anti").distinct()
        near = self.near(nodes.select(F.explode("hashes").alias("value")).distinct())
        by_hash = nodes.select("o", F.explode("hashes").alias("value")).join(near, "value", "left_semi").select("o")
        by_sha = nodes.join(self.held_shas(nodes.filter("sha IS NOT NULL").select("sha").distinct()), "sha", "left_semi").select("o")
        state = stash(nodes.join(by_sha.unionByName(by_hash).distinct().withColumn("hit", F.lit(True)), "o", "left").select("o", "sha", "hashes", F.coalesce("hit", F.lit(False)).alias("rejected")), "state")
        table = pivot_table(state.filter("NOT rejected").select(F.explode("hashes").alias("value")).distinct())
        pairs = stash(near_pairs(table, table), "pairs")

        out, added = copies.unionByName(state.filter("rejected").select("o.id")), []
        open_ = state.filter("NOT rejected").drop("rejected")
        while not open_.isEmpty():
            judged, decided = _round(open_, pairs)
            out = out.unionByName(decided.filter("rejected").select("o.id"))
            added.append(judged.filter("accepted").drop("accepted"))
            open_ = decided.filter("NOT rejected").drop("rejected")
        if added:
            rows = added[0]
            for part in added[1:]:
                rows = rows.unionByName(part)
            self.append(rows)
        for part in (pairs, *added):
            drop_stash(part)
        return out
