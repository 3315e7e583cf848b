"""Exactly one copy of messages that were delivered at least once.

One aggregation by identity keeps, with ``min_by`` over a struct of the delivery's order, its time and the number of the delivery as
the tie-break, the delivery that came first. It carries these columns only and combines in the map tasks, so a message that makes up a
third of all rows shrinks to one row per map task before the shuffle. Surplus copies are then an anti join on the delivery number, a
key without skew, in place of a join on the identity, and the rows kept an anti join with those surplus copies.

Defined cases: a row without identity (null in every identity column that has no default) is never a copy;
rows repeated in full count as one row; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode defines it, at either end of a text.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACE, "")


def uuid_value(text: Column) -> Column:
    """The 32 hexadecimal digits that a UUID denotes: case, braces, hyphens, outer blanks and a ``urn:uuid:`` do
    not matter. Text that is no UUID stands for itself, marked so that it equals no UUID; null stays null."""
    plain = stripped(F.lower(text))
    digits = F.regexp_replace(F.regexp_replace(plain, r"^\{?(urn:)?(uuid:)?", ""), r"[{}\-]", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits).otherwise(F.concat(F.lit("text:"), stripped(text)))


def first_deliveries(df: DataFrame, identity: Sequence[Column], order: Sequence[Column], delivery: str) -> DataFrame:
    """(one column ``k0, k1, …`` per identity column, ``delivery``): the delivery kept of each identity."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(identity)]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(delivery).alias("tie"))
    slim = df.select(*keys, F.col(delivery).alias("delivery"), place.alias("place"))
    return slim.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.min_by("delivery", "place").alias("delivery"))


def _key(identity: Sequence[Column]) -> Column:
    return F.xxhash64(*identity)


def keep_first(df: DataFrame, identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """All columns of the first delivery of each identity, by ``min_by`` over a struct of the ordering columns;
    rows of which an identity column is null are all kept. Equal ordering values are decided by the hash of the
    row, so the result does not depend on how the rows are distributed."""
    known = F.lit(True)
    for c in identity:
        known = known & c.isNotNull()
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keys = [c.alias(f"__k{i}") for i, c in enumerate(identity)]
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*parts).alias("tie"))
    kept = df.filter(known).select(*keys, whole.alias("__row"), place.alias("__place")).groupBy(*[f"__k{i}" for i in range(len(keys))])
    return kept.agg(F.min_by("__row", "__place").alias("__row")).select("__row.*").unionByName(df.filter(~known))


def surplus_deliveries(df: DataFrame, identity: Sequence[Column], order: Sequence[Column], delivery: str) -> DataFrame:
    """(``delivery``): the deliveries that are not the first of their identity."""
    known = F.lit(True)
    for c in identity:
        known = known & c.isNotNull()
    rows = df.filter(known)
    kept = first_deliveries(rows, identity, order, delivery).select("delivery", _key([F.col(f"k{i}") for i in range(len(identity))]).alias("of"))
    every = rows.select(F.col(delivery).alias("delivery"), _key(identity).alias("of"))
    return every.join(kept, ["delivery", "of"], "left_anti").select(F.col("delivery").alias(delivery)).distinct()


def kept_deliveries(df: DataFrame, identity: Sequence[Column], order: Sequence[Column], delivery: str) -> DataFrame:
    """All columns of the rows that remain when the surplus copies are gone. Only identities, order and delivery numbers are aggregated;
    whole rows meet the surplus numbers once. Of rows under the same delivery number, repeats in full, one remains."""
    surplus = surplus_deliveries(df, identity, order, delivery).select(F.col(delivery).alias("__no"))
    repeated = df.groupBy(F.col(delivery).alias("__no")).count().filter("count > 1 AND __no IS NOT NULL").select("__no")
    once = df.join(surplus.unionByName(repeated), F.col(delivery) == F.col("__no"), "left_anti")
    again = df.join(repeated, F.col(delivery) == F.col("__no"), "left_semi").join(surplus, F.col(delivery) == F.col("__no"), "left_anti")
    return once.unionByName(again.dropDuplicates([delivery]))
