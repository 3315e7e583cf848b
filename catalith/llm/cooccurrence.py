"""Pairs of items that appear together more often than chance.

Every record is one basket, the sorted set of its items. Equal baskets are collapsed into one with a weight. Items too rare to reach
the wanted support are then dropped from them in place; that loses nothing, as a pair is never more frequent than its items. Baskets
that are equal now are collapsed again, pairs are enumerated once per distinct basket, and the weights are summed,
first inside the map tasks. An item in a third of all records is thus one entry of many baskets, not a group.

The frequent items number at most (mean basket size / least share), whatever the size of the data.

Defined cases: null and blank items do not count; items are compared in lower case without outer blanks; the baskets
of repeated records are united; records without an item are not counted in n; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.operators.deliveries import OUTER_SPACE
from catalith.session import stash

#: Most frequent items that a literal set may hold.
MOST_ITEMS = 10_000


def baskets(df: DataFrame, record: str = "asset_id", items: str = "tags") -> DataFrame:
    """(record, basket): one row per record with at least one item."""
    clean = F.transform(F.col(items), lambda t: F.regexp_replace(F.lower(t), OUTER_SPACE, ""))
    own = F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))
    rows = df.select(F.col(record).alias("record"), own.alias("basket")).filter("record IS NOT NULL AND size(basket) > 0")
    return rows.groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("basket")))).alias("basket"))


def pairs(df: DataFrame, record: str = "asset_id", items: str = "tags", least: int = 3, share: float = 0.005, ratio: float = 5.0) -> DataFrame:
    """(tag_a, tag_b, n_ab, n_a, n_b, n, lift, conviction): the pairs with n_ab >= ``least``, n_ab / n >= ``share`` and a
    lift n_ab * n / (n_a * n_b) >= ``ratio``; tag_a < tag_b. Conviction is that of a -> b, null where a never lacks b."""
    # Equal baskets become one with a weight before anything is counted.
    distinct = stash(baskets(df, record, items).groupBy("basket").agg(F.count("*").alias("weight")), "baskets")
    total = distinct.agg(F.sum("weight").alias("n"))
    single = distinct.select("weight", F.explode("basket").alias("item")).groupBy("item").agg(F.sum("weight").alias("n_item"))
    frequent = stash(single.crossJoin(total).filter((F.col("n_item") >= least) & (F.col("n_item") >= share * F.col("n"))), "frequent")  # total is one row
    # The frequent items, in number at most mean basket size / share, go to each basket as one literal set; beyond MOST_ITEMS by a join.
    known = [r.item for r in frequent.select("item").orderBy("item").limit(MOST_ITEMS + 1).collect()]
    if len(known) <= MOST_ITEMS:
        kept = distinct.select(F.filter("basket", lambda t: t.isin(known)).alias("items"), "weight")
    else:
        entries = distinct.select("basket", "weight", F.explode("basket").alias("item")).join(frequent.select("item"), "item", "left_semi")
        kept = entries.groupBy("basket", "weight").agg(F.array_sort(F.collect_list("item")).alias("items")).select("items", "weight")
    reduced = kept.filter("size(items) > 1").groupBy("items").agg(F.sum("weight").alias("weight"))
    second = lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("tag_a"), y.alias("tag_b")))
    both = reduced.select("weight", F.explode(F.flatten(F.transform("items", second))).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.sum("weight").alias("n_ab"))
    scored = (
        both.filter(F.col("n_ab") >= least)
        .join(frequent.select(F.col("item").alias("tag_a"), F.col("n_item").alias("n_a"), "n"), "tag_a")
        .join(frequent.select(F.col("item").alias("tag_b"), F.col("n_item").alias("n_b")), "tag_b")
        .filter((F.col("n_ab") >= share * F.col("n")) & (F.col("n_ab") * F.col("n") >= ratio * F.col("n_a") * F.col("n_b")))
    )
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    conviction = F.try_divide(F.col("n_a") * (F.col("n") - F.col("n_b")), (F.col("n_a") - F.col("n_ab")) * F.col("n"))
    return scored.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n", F.round(lift, 6).alias("lift"), F.round(conviction, 6).alias("conviction"))
