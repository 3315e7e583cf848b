"""Queries of the problems of training data over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import cooccurrence, history, mixing, packing, residue, similarity_clusters
from catalith.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """New assets that agree with one accepted earlier."""
    return history.reject(history.asset_keys(table(spark, folder, "asset"), table(spark, folder, "media_metadata"))).withColumnRenamed("id", "asset_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each cluster of similar assets, with the smallest id of the cluster."""
    found = similarity_clusters.clusters(table(spark, folder, "asset"), table(spark, folder, "media_cluster"))
    return found.select(F.col("id").alias("asset_id"), F.col("cluster").alias("first_id"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's size and most typical members."""
    return similarity_clusters.described(similarity_clusters.clusters(table(spark, folder, "asset"), table(spark, folder, "media_cluster")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of tags that occur together five times as often as by chance."""
    return cooccurrence.pairs(table(spark, folder, "vlm_metadata")).select("tag_a", "tag_b")


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts, lift and conviction."""
    return cooccurrence.pairs(table(spark, folder, "vlm_metadata"))


def p8_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every text in the containers of each capacity."""
    return packing.layout(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_layout(spark, folder), table(spark, folder, "container_spec"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text is used."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of tokens that the sources really reach."""
    return mixing.shares(*mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are or contain residue."""
    documents = table(spark, folder, "documents")
    weights, _ = residue.train(documents)
    return residue.residue(documents, weights)


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean set, by source: documents kept and left out."""
    documents = table(spark, folder, "documents")
    weights, _ = residue.train(documents)
    kept = residue.without_residue(documents, weights)
    return documents.groupBy("source").count().withColumnRenamed("count", "documents").join(kept.groupBy("source").count().withColumnRenamed("count", "kept"), "source", "left")


def p10_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How the classifier fares on the weak labels of sources that it has not seen."""
    weights, aside = residue.train(table(spark, folder, "documents"), held_out=4)
    return spark.createDataFrame([residue.measure(weights, aside)], "pieces long, residue long, true_positive long, false_positive long, false_negative long, precision double, recall double")


_PAIRS = r"""WITH t AS (SELECT DISTINCT asset_id, regexp_replace(lower(tag), '^\s+|\s+$', '', 'g') AS tag FROM (SELECT asset_id, unnest(tags) AS tag FROM vlm_metadata) WHERE tag IS NOT NULL AND asset_id IS NOT NULL),
u AS (SELECT * FROM t WHERE tag <> ''), total AS (SELECT count(DISTINCT asset_id) AS n FROM u), c AS (SELECT tag, count(*) AS n_t FROM u GROUP BY tag),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM u a JOIN u b ON a.asset_id = b.asset_id AND a.tag < b.tag GROUP BY 1, 2),
s AS (SELECT tag_a, tag_b, n_ab, ca.n_t AS n_a, cb.n_t AS n_b, n FROM p JOIN c ca ON ca.tag = tag_a JOIN c cb ON cb.tag = tag_b CROSS JOIN total WHERE n_ab >= 3 AND n_ab >= 0.005 * n AND n_ab * n >= 5 * n_a * n_b)
"""

SQL = {
    "p7_found": _PAIRS + "SELECT tag_a, tag_b FROM s",
    "p7_scores": _PAIRS + "SELECT tag_a, tag_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift, round(CASE WHEN n_a > n_ab THEN n_a * (n - n_b) / ((n_a - n_ab) * n) END, 6) AS conviction FROM s",
}

QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_clusters, p7_found, p7_scores, p8_layout, p8_fill, p9_mixture, p9_shares, p10_found, p10_clean, p10_validation)}
