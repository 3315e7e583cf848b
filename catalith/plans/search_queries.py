"""Queries of search, clusters and duplicates over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions import vector
from catalith.operators import clusters as C
from catalith.operators import hashes, search
from catalith.sources.tables import table


def _assets(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    assets = table(spark, folder, "asset")
    return assets, search.query_vector(assets)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten assets most similar to a query vector, with the names of their clusters."""
    assets, q = _assets(spark, folder)
    return search.semantic_search(assets, table(spark, folder, "media_cluster"), q)


def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    assets, q = _assets(spark, folder)
    return search.semantic_search(assets, table(spark, folder, "media_cluster"), q, search.SearchFilter(kind="media", owner="team-amber-archive", tags=("ferry", "kiosk", "lagoon", "jam", "loaf", "dune")), limit=20, least=None)


def vector_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """All assets at or above a similarity."""
    assets, q = _assets(spark, folder)
    return search.scored(assets, q).filter("similarity >= 0.6").select("id", F.round("similarity", 4).alias("similarity"))


def unified_topk(spark: SparkSession, folder: str) -> DataFrame:
    assets, q = _assets(spark, folder)
    return search.unified_search(assets, q, limit=15)


def hybrid_boost(spark: SparkSession, folder: str) -> DataFrame:
    assets, q = _assets(spark, folder)
    return search.hybrid_search(assets, q, "conveyor", limit=20)


def tag_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.tag_search(table(spark, folder, "asset"), ["ferry", "kiosk"], limit=25)


def child_image_search(spark: SparkSession, folder: str) -> DataFrame:
    """Images of documents ranked by similarity: no threshold, every asset with a parent."""
    assets, q = _assets(spark, folder)
    children = assets.filter("parent_asset_id IS NOT NULL")
    return search.scored(children, q).join(children.select("id", "parent_asset_id"), "id").select("id", "parent_asset_id", F.round("similarity", 4).alias("similarity"))


def zero_shot_label(spark: SparkSession, folder: str) -> DataFrame:
    """The category with the largest dot product, with the mean vector of each embedding label as categories."""
    rows = table(spark, folder, "embeddings")
    labels = vector.mean_vector(rows, ["label"], "embedding", name="vector").select(F.col("label").cast("string").alias("label"), "vector")
    return search.zero_shot(rows, labels, "vec_id")


def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asset").filter(search.keyword_condition("con_eyor")).select("id", F.get_json_object("metadata", "$.ocr_text").alias("ocr_text"))


def filter_owner_tags(spark: SparkSession, folder: str) -> DataFrame:
    return search.SearchFilter(kind="media", owner="team-slate-press", tags=("ferry", "kiosk", "lagoon"), status="done").apply(table(spark, folder, "asset")).select("id", "owner", "status")


def query_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each heading could be a query text."""
    heading = F.trim("parent_heading")
    return table(spark, folder, "documents").select("doc_id", F.when(F.coalesce(heading, F.lit("")) == "", "empty").when(F.length(heading) < 2, "short").when(F.length(heading) > 500, "long").otherwise("valid").alias("verdict"))


def assign_best_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return C.assign_best(table(spark, folder, "asset"), table(spark, folder, "media_cluster"))


def merge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return C.merge_candidates(table(spark, folder, "media_cluster"), 0.7)


def merged_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The merged centroid of the two smallest cluster ids, axis by axis."""
    assets = table(spark, folder, "asset")
    ids = [r.cluster_id for r in assets.filter("embedding IS NOT NULL AND cluster_id IS NOT NULL").select("cluster_id").distinct().orderBy("cluster_id").limit(2).collect()]
    return C.merged_centroid(assets, ids).select(F.posexplode("centroid").alias("axis", "x")).select("axis", F.round("x", 6).alias("x"))


def cluster_asset_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.cluster_counts(table(spark, folder, "media_cluster"), table(spark, folder, "asset"))


def cluster_list_having(spark: SparkSession, folder: str) -> DataFrame:
    return C.cluster_counts(table(spark, folder, "media_cluster"), table(spark, folder, "asset"), least=5, provisional=True)


def cluster_stats_global(spark: SparkSession, folder: str) -> DataFrame:
    return C.global_statistics(table(spark, folder, "media_cluster"), table(spark, folder, "asset"))


def centroid_quality(spark: SparkSession, folder: str) -> DataFrame:
    return C.centroid_quality(table(spark, folder, "media_cluster"), table(spark, folder, "asset"))


def centroid_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = vector.mean_vector(table(spark, folder, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("centroid").alias("axis", "x")).select("label", "axis", F.round("x", 6).alias("x"))


def label_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with at least three finished assets, of which up to five are shown to a labeller."""
    done = table(spark, folder, "asset").filter("status = 'done' AND cluster_id IS NOT NULL")
    joined = table(spark, folder, "media_cluster").select(F.col("id").alias("cluster_id"), "name").join(done.select("cluster_id", "id"), "cluster_id")
    counts = joined.groupBy("cluster_id", "name").agg(F.count("id").alias("images")).filter("images >= 3")
    first = joined.withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy("id"))).filter("place <= 5")  # cut to five in the map tasks
    shown = first.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("shown"))
    return counts.join(shown, "cluster_id").select("cluster_id", "name", "images", "shown")


def best_cluster_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest label means of every vector, in order."""
    rows = table(spark, folder, "embeddings")
    return C.nearest_labels(rows, "vec_id", vector.mean_vector(rows, ["label"], "embedding"), 3)


def leader_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """The order-dependent leader fold inside each batch of new assets."""
    rows = table(spark, folder, "asset").filter("batch_no > 0").select("batch_no", "ingest_no", "id", "embedding")
    return C.leader_clustering(rows, "batch_no", "ingest_no")


def dup_exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return hashes.exact_groups(table(spark, folder, "asset"), "id", F.lower(F.trim("sha256")))


def dup_exact_first(spark: SparkSession, folder: str) -> DataFrame:
    """Media whose bytes a finished medium already has, with the first of those."""
    media = table(spark, folder, "asset").filter("kind = 'media' AND sha256 IS NOT NULL").select("id", F.lower(F.trim("sha256")).alias("hash"), "status", "ingest_no")
    done = media.filter("status = 'done'").groupBy("hash").agg(F.min("ingest_no").alias("first_no"), F.min_by("id", "ingest_no").alias("first_id"))
    return media.join(done, "hash").filter("ingest_no > first_no").select("id", "first_id")


def dup_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """Assets with a perceptual hash within four bits of another's: the first other and how many."""
    return hashes.near_duplicates(table(spark, folder, "media_metadata"), "asset_id", F.col("perceptual_hash"))


_Q = "(SELECT embedding::DOUBLE[] FROM asset WHERE embedding IS NOT NULL ORDER BY id LIMIT 1)"
_SIM = f"(1 + list_dot_product(embedding::DOUBLE[], {_Q}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_Q}, {_Q})))) / 2"
_SC = f"WITH s AS (SELECT *, {_SIM} AS sim FROM asset WHERE embedding IS NOT NULL)"
_HASH = r"regexp_replace(regexp_replace(lower(perceptual_hash), '^\s+|\s+$', '', 'g'), '^0x', '')"
_MEAN = "WITH m AS (SELECT label, axis, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings) GROUP BY ALL), u AS (SELECT label, axis, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"
_CEN = "c AS (SELECT id AS cluster_id, CASE WHEN coalesce(threshold, 0) = 0 THEN 0.72 ELSE threshold END AS threshold, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS centroid FROM media_cluster WHERE centroid IS NOT NULL)"

SQL = {
    "vector_topk": f"{_SC} SELECT s.id, kind, owner, cluster_id, c.name AS cluster_name, round(sim, 4) AS similarity FROM (SELECT * FROM s WHERE sim >= 0.5 ORDER BY sim DESC, id LIMIT 10) s LEFT JOIN media_cluster c ON c.id = s.cluster_id",
    "vector_topk_filtered": f"{_SC} SELECT s.id, kind, owner, cluster_id, c.name AS cluster_name, round(sim, 4) AS similarity FROM (SELECT * FROM s WHERE kind = 'media' AND owner = 'team-amber-archive' AND list_has_any(tags, ['ferry', 'kiosk', 'lagoon', 'jam', 'loaf', 'dune']) ORDER BY sim DESC, id LIMIT 20) s LEFT JOIN media_cluster c ON c.id = s.cluster_id",
    "vector_threshold": f"{_SC} SELECT id, round(sim, 4) AS similarity FROM s WHERE sim >= 0.6",
    "unified_topk": f"{_SC} SELECT id, leg, similarity FROM (SELECT * FROM (SELECT id, 'media' AS leg, round(sim, 4) AS similarity FROM s WHERE kind = 'media' AND sim >= 0.5 ORDER BY sim DESC, id LIMIT 15) UNION ALL SELECT * FROM (SELECT id, 'document', round(sim, 4) FROM s WHERE kind = 'document' AND sim >= 0.5 ORDER BY sim DESC, id LIMIT 15)) ORDER BY similarity DESC, leg DESC, id LIMIT 15",
    "hybrid_boost": f"{_SC}, v AS (SELECT id, round(sim, 4) AS s FROM s WHERE kind = 'media' AND sim >= 0.5 ORDER BY sim DESC, id LIMIT 20), k AS (SELECT id, true AS k FROM asset WHERE kind = 'media' AND metadata->>'$.ocr_text' ILIKE '%conveyor%' ORDER BY id LIMIT 40) SELECT id, round(CASE WHEN k AND s IS NOT NULL THEN least(1.0, s + 0.15) WHEN s IS NOT NULL THEN s ELSE 0.6 END, 6) AS similarity, CASE WHEN k AND s IS NOT NULL THEN 'both' WHEN s IS NOT NULL THEN 'vector' ELSE 'keyword' END AS found_by FROM v FULL JOIN k USING (id) ORDER BY similarity DESC, id LIMIT 20",
    "tag_search": "SELECT id, kind, owner FROM asset WHERE kind = 'media' AND list_has_any(tags, ['ferry', 'kiosk']) ORDER BY id LIMIT 25",
    "child_image_search": f"{_SC} SELECT id, parent_asset_id, round(sim, 4) AS similarity FROM s WHERE parent_asset_id IS NOT NULL",
    "zero_shot_label": f"{_MEAN} , l AS (SELECT label, list(x ORDER BY axis) AS v FROM u GROUP BY label) SELECT id, label, round(cosine, 6) AS cosine FROM (SELECT vec_id AS id, l.label::VARCHAR AS label, list_dot_product(embedding::DOUBLE[], v) AS cosine, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, l.label::VARCHAR) AS rn FROM embeddings CROSS JOIN l) WHERE rn = 1",
    "keyword_filter": "SELECT id, metadata->>'$.ocr_text' AS ocr_text FROM asset WHERE metadata->>'$.ocr_text' ILIKE '%con_eyor%'",
    "filter_owner_tags": "SELECT id, owner, status FROM asset WHERE embedding IS NOT NULL AND kind = 'media' AND owner = 'team-slate-press' AND status = 'done' AND list_has_any(tags, ['ferry', 'kiosk', 'lagoon'])",
    "query_validation": "SELECT doc_id, CASE WHEN coalesce(trim(parent_heading), '') = '' THEN 'empty' WHEN length(trim(parent_heading)) < 2 THEN 'short' WHEN length(trim(parent_heading)) > 500 THEN 'long' ELSE 'valid' END AS verdict FROM documents",
    "assign_best_cluster": f"WITH {_CEN} SELECT id, cluster_id, round(cos, 6) AS cosine FROM (SELECT a.id, c.cluster_id, list_dot_product(a.embedding::DOUBLE[], c.centroid) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], c.centroid), 12) DESC, c.cluster_id) AS rn FROM asset a JOIN c ON a.embedding IS NOT NULL AND list_dot_product(a.embedding::DOUBLE[], c.centroid) >= c.threshold) WHERE rn = 1",
    "merge_candidates": f"WITH {_CEN} SELECT a.cluster_id AS a, b.cluster_id AS b, round(list_dot_product(a.centroid, b.centroid), 6) AS cosine FROM c a JOIN c b ON a.cluster_id < b.cluster_id WHERE list_dot_product(a.centroid, b.centroid) >= 0.7",
    "merged_centroid": "WITH two AS (SELECT DISTINCT cluster_id FROM asset WHERE embedding IS NOT NULL AND cluster_id IS NOT NULL ORDER BY cluster_id LIMIT 2), m AS (SELECT axis, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM asset WHERE embedding IS NOT NULL AND cluster_id IN (SELECT cluster_id FROM two)) GROUP BY axis) SELECT axis::INTEGER AS axis, round(x / sqrt((SELECT sum(x * x) FROM m)), 6) AS x FROM m",
    "cluster_asset_counts": "SELECT c.id AS cluster_id, c.name, c.provisional, count(a.id) AS assets FROM media_cluster c LEFT JOIN asset a ON a.cluster_id = c.id GROUP BY ALL",
    "cluster_list_having": "SELECT c.id AS cluster_id, c.name, c.provisional, count(a.id) AS assets FROM media_cluster c LEFT JOIN asset a ON a.cluster_id = c.id WHERE c.provisional GROUP BY ALL HAVING count(a.id) >= 5",
    "cluster_stats_global": "WITH p AS (SELECT c.id, c.provisional, count(a.id) AS n FROM media_cluster c LEFT JOIN asset a ON a.cluster_id = c.id GROUP BY ALL) SELECT count(*) AS clusters, count(*) FILTER (provisional) AS provisional, count(*) FILTER (NOT provisional) AS confirmed, round(coalesce(avg(n), 0), 6) AS mean_assets, (SELECT count(cluster_id) FROM asset) AS clustered, (SELECT count(*) FROM asset WHERE cluster_id IS NULL) AS unclustered FROM p",
    "centroid_quality": f"WITH {_CEN}, d AS (SELECT cluster_id, list_dot_product(a.embedding::DOUBLE[], c.centroid) AS d FROM asset a JOIN c USING (cluster_id) WHERE a.embedding IS NOT NULL) SELECT cluster_id, count(d) AS members, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS spread, round(min(d), 6) AS least, round(max(d), 6) AS most FROM d GROUP BY cluster_id",
    "centroid_mean": f"{_MEAN} SELECT label, axis::INTEGER AS axis, round(x, 6) AS x FROM u",
    "label_candidates": "WITH r AS (SELECT c.id AS cluster_id, c.name, a.id, row_number() OVER (PARTITION BY c.id ORDER BY a.id) AS rn FROM media_cluster c JOIN asset a ON a.cluster_id = c.id WHERE a.status = 'done') SELECT cluster_id, name, count(*) AS images, string_agg(id, ',' ORDER BY id) FILTER (rn <= 5) AS shown FROM r GROUP BY ALL HAVING count(*) >= 3",
    "best_cluster_rank": f"{_MEAN} , l AS (SELECT label, list(x ORDER BY axis) AS v FROM u GROUP BY label) SELECT vec_id, place::INTEGER AS place, label, round(cosine, 6) AS cosine FROM (SELECT vec_id, l.label, round(list_dot_product(embedding::DOUBLE[], v), 9) AS cosine, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(embedding::DOUBLE[], v), 9) DESC, l.label) AS place FROM embeddings CROSS JOIN l) WHERE place <= 3",
    "dup_exact_groups": "SELECT lower(trim(sha256)) AS hash, count(*) AS n, min(id) AS first_id FROM asset WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "dup_exact_first": "WITH m AS (SELECT id, lower(trim(sha256)) AS hash, status, ingest_no FROM asset WHERE kind = 'media' AND sha256 IS NOT NULL), d AS (SELECT hash, min(ingest_no) AS first_no, arg_min(id, ingest_no) AS first_id FROM m WHERE status = 'done' GROUP BY hash) SELECT m.id, d.first_id FROM m JOIN d USING (hash) WHERE ingest_no > first_no",
    "dup_hamming": rf"WITH h AS (SELECT DISTINCT asset_id AS id, ('0x' || {_HASH})::UBIGINT AS v FROM media_metadata WHERE regexp_full_match({_HASH}, '[0-9a-f]{{16}}')) SELECT a.id, min(b.id) AS first_near, count(*) AS near FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.v, b.v)) <= 4 GROUP BY a.id",
}

QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_threshold, unified_topk, hybrid_boost, tag_search, child_image_search, zero_shot_label, keyword_filter, filter_owner_tags, query_validation, assign_best_cluster, merge_candidates, merged_centroid, cluster_asset_counts, cluster_list_having, cluster_stats_global, centroid_quality, centroid_mean, label_candidates, best_cluster_rank, leader_clustering, dup_exact_groups, dup_exact_first, dup_hamming)}
