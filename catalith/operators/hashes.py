"""Exact and near duplicates by hashes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.deliveries import stripped
from catalith.session import stash

RADIUS, BLOCKS, BITS = 4, 6, 64
#: Values that share a cell from which it is divided again, and how often.
CELL, LEVELS = 4096, 3


def signed(x: int) -> int:
    """64 bits as a signed long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(level: int) -> list[int]:
    """The masks of each pair of six blocks of bits. Every level forms its blocks in another way, so that those of the bits left free are of like size.
    Of four differing bits at least two blocks are free, so under one of the masks two near values are equal."""
    block = [(i // 6**level) % 6 if level < 2 else (i * 5 + i // 7) % 6 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if block[i] in pair) for pair in itertools.combinations(range(BLOCKS), 2)]


def divided(rows: DataFrame, level: int) -> DataFrame:
    """Rows (value, cell, free) of crowded cells in the cells of the pairs of blocks of the bits that are still free in theirs."""
    sub = F.explode(F.array(*[F.lit(signed(m)) for m in masks(level)])).alias("sub")
    cells = rows.select("*", sub).withColumn("cell", F.xxhash64("cell", "sub", F.col("value").bitwiseAND(F.col("sub")).bitwiseAND(F.col("free"))))
    return cells.withColumn("free", F.col("free").bitwiseAND(F.bitwise_not("sub"))).drop("sub")


def hash_value(text: Column) -> Column:
    """A 64-bit hash as a signed long; null if the text is not 16 hexadecimal digits, an outer blank or 0x aside."""
    plain = F.regexp_replace(stripped(F.lower(text)), "^0x", "")
    return F.when(plain.rlike("^[0-9a-f]{16}$"), F.conv(plain, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_values(values: DataFrame, largest: int = CELL) -> DataFrame:
    """(a, b, distance): distinct values at a distance of 1 to 4, both ways. Values that agree under a pair of blocks share a cell; cells with more than
    ``largest`` values are divided by the bits still free, up to three times, which loses nothing."""
    rows = divided(values.select("value", F.lit(0).cast("bigint").alias("cell"), F.lit(-1).cast("bigint").alias("free")), 0)
    pairs = None
    for level in range(1, LEVELS + 1):
        large = stash(rows.groupBy("cell").count().filter(F.col("count") > largest).select("cell"), "cells")
        done = level == LEVELS or large.isEmpty()
        own = (rows if done else rows.join(large, "cell", "left_anti")).select("cell", F.col("value").alias("a"))
        found = own.join(own.withColumnRenamed("a", "b"), "cell").filter((F.col("a") != F.col("b")) & (hamming(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if done:
            break
        rows = stash(divided(rows.join(large, "cell", "left_semi"), level), "divided")
    return pairs.distinct().select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def near_duplicates(rows: DataFrame, ident: str, text: Column) -> DataFrame:
    """(id, first_near, near): for each row with near duplicates the smallest other id among them and their number.

    Equal hashes are one value while pairs are sought, so copies never multiply into pairs; their numbers are added up.
    """
    own = rows.select(F.col(ident).alias("id"), hash_value(text).alias("value")).filter("id IS NOT NULL AND value IS NOT NULL").distinct()
    values = own.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    second = own.join(values.select("value", F.col("first").alias("id")), ["value", "id"], "left_anti").groupBy("value").agg(F.min("id").alias("second"))
    pairs = near_values(values.select("value"))
    around = pairs.join(values.select(F.col("value").alias("b"), "n", "first"), "b").groupBy(F.col("a").alias("value")).agg(F.sum("n").alias("near"), F.min("first").alias("near_first"))
    joined = own.join(values, "value").join(second, "value", "left").join(around, "value", "left")
    same = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    out = joined.select("id", F.least(same, F.col("near_first")).alias("first_near"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("near"))
    return out.filter("near > 0")


def exact_groups(rows: DataFrame, ident: str, key: Column, least: int = 2) -> DataFrame:
    """(hash, n, first_id): values that ``least`` rows or more share."""
    return rows.filter(key.isNotNull()).groupBy(key.alias("hash")).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).filter(F.col("n") >= least)
