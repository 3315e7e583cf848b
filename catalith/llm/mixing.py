"""Mixing sources to target shares of tokens, without sorting.

Sizes are summed by source and hash bucket of the text. The largest mixture that all shares and repeat limits allow
fixes each source's budget: so many full passes over the source, and for the rest a threshold on the text's hash.
The threshold is found in histograms: the bucket in which the running sum meets the budget is the boundary, only the
boundary is divided again by the next bits, :data:`LEVELS` times. The mixture is then a filter. Histograms have at most
:data:`FANOUT` rows per source and are aggregated in the map tasks first, so a source with a third of all rows is no hot
group, and no row is ever sorted, sampled or collected.

Defined cases: equal texts count as one text, under its smallest doc_id and that row's source, so no text is used more often than allowed
through its copies; texts without a token are not used; a source without a target is not used, one without texts reaches
0 and does not limit the others; a null or missing max_repeats means 1; the shares reached are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.llm.tokens import RANKS, counted
from catalith.session import stash

FANOUT_BITS, LEVELS = 12, 4
FANOUT = 1 << FANOUT_BITS


def _digit(level: int):
    """The bits of the text's hash that level ``level`` looks at."""
    return F.shiftrightunsigned("h", 63 - FANOUT_BITS * (level + 1)).bitwiseAND(F.lit(FANOUT - 1)).cast("int")


def texts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, h): the distinct texts."""
    rows = counted(documents.filter("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "text"), ["doc_id", "source"], ranks)
    once = rows.filter("n_tokens > 0").groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"))
    return once.select("r.doc_id", "r.source", "r.n_tokens", F.xxhash64("text_key").bitwiseAND(F.lit(2**63 - 1)).alias("h"))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, passes, rest): per source the tokens it must give, as full
    passes and a rest below one pass. ``sizes``: (source, available)."""
    wanted = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
    joined = wanted.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    bounds = joined.filter("available > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    budget = F.least(F.floor(F.col("total") * F.col("target_share")), F.col("available") * F.col("max_repeats"))
    full = joined.crossJoin(bounds).withColumn("budget", F.when(F.col("available") > 0, budget).otherwise(0).cast("long"))  # bounds is one row
    passes = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return full.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("available")).drop("total")


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, passes, cut): texts whose hash is below ``cut`` are used once more than ``passes`` times."""
    state = plan.select("source", "passes", F.col("rest").cast("long").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        # Only rows in the boundary found so far; at first these are all rows of the source.
        at = rows.join(state.select("source", "prefix"), "source")
        if level:
            at = at.filter(F.shiftrightunsigned("h", 63 - FANOUT_BITS * level) == F.col("prefix"))
        sums = at.groupBy("source", _digit(level).alias("digit")).agg(F.sum("n_tokens").alias("tokens"))
        run = W.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("tokens").over(run)).join(state, "source")
        # Buckets that fit the rest as a whole, and the one in which it ends.
        fits = sums.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("used"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", "tokens"))).alias("edge"))
        state = stash(
            state.join(fits, "source", "left").select("source", "passes", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), (F.col("prefix") * FANOUT + F.coalesce(F.col("edge.digit"), F.lit(0 if level == 0 else FANOUT - 1))).alias("prefix"), F.col("edge.tokens").alias("edge_tokens")).drop("edge_tokens")
            if level < LEVELS - 1
            # At the last level the edge is one text as a rule; it is taken if that comes closer to the budget.
            else state.join(fits, "source", "left").select("source", "passes", (F.col("prefix") * FANOUT + F.coalesce(F.col("edge.digit"), F.lit(FANOUT - 1)) + F.when(F.col("edge.tokens") / 2 <= F.col("rest") - F.coalesce("used", F.lit(0)), 1).otherwise(0)).alias("prefix")),
            "thresholds",
        )
    return state.select("source", "passes", (F.col("prefix") * F.lit(1 << (63 - FANOUT_BITS * LEVELS))).alias("cut"))


def mixture(documents: DataFrame, targets: DataFrame, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, repeats), budgets): how often each text is used; texts not used are left out."""
    rows = stash(texts(documents, ranks), "texts")
    plan = stash(budgets(rows.groupBy("source").agg(F.sum("n_tokens").alias("available")), targets), "budgets")
    cuts = thresholds(rows, plan.filter("available > 0"))
    limit = plan.select("source", "max_repeats")
    used = rows.join(cuts, "source").join(limit, "source").withColumn("repeats", F.least(F.col("passes") + (F.col("h") < F.col("cut")).cast("int"), F.col("max_repeats")))
    return used.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), plan


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, texts, most_repeats, max_repeats): the shares really reached."""
    own = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    joined = plan.select("source", "target_share", "max_repeats").join(own, "source", "left").na.fill(0, ["tokens", "texts", "most_repeats"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row per source
    return joined.select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6).alias("reached_share"), "tokens", "texts", "most_repeats", "max_repeats")
