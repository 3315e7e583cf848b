"""Queries over the catalog's objects, documents, media, jobs and event metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions import mime
from catalith.operators import chunks, deliveries, jobs, media, pipeline, search
from catalith.sources import folder as files
from catalith.sources.tables import table
from catalith.streaming import windows


def _seconds(c: str | Column) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def mime_kind_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each raw upload may be taken in, by content type and size."""
    rows = table(spark, folder, "asset_raw").select("id", "size_bytes", mime.group_of(F.col("content_type")).alias("grp"), mime.kind_of(F.col("content_type")).alias("kind"))
    verdict = F.when(F.col("grp").isNull(), "unsupported").when(F.col("size_bytes") > mime.size_limit(F.col("grp")), "too large").otherwise("valid")
    return rows.select("id", "kind", "grp", verdict.alias("verdict"))


def extension_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "asset_raw").select(mime.extension(F.col("uri")).alias("extension"), F.coalesce(mime.category(F.col("uri")), F.lit("other")).alias("category"), "size_bytes")
    return rows.groupBy("extension", "category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def scan_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return files.statistics(table(spark, folder, "asset_raw").select(mime.category(F.col("uri")).alias("type"), "size_bytes"))


def object_view(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown of an asset, by kind, with its cluster and its upload."""
    a = table(spark, folder, "asset")
    c = table(spark, folder, "media_cluster").select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"), F.col("provisional").alias("cluster_provisional"))
    r = table(spark, folder, "asset_raw").select(F.col("id").alias("raw_asset_id"), "request_id", "part_id")
    is_media = F.col("kind") == "media"
    slim = a.select("id", "kind", "uri", "status", "cluster_id", "raw_asset_id", F.when(is_media, F.coalesce(F.size("tags"), F.lit(0))).alias("tags"), F.when(is_media, F.size("embedding")).alias("dimension"))
    joined = slim.join(c, "cluster_id", "left").join(r, "raw_asset_id", "left")
    shown = F.when(F.col("uri").startswith("json://pending"), None).otherwise(F.col("uri"))
    storage = F.when((F.col("kind") == "json") & F.col("uri").rlike("^(sql|jsonb)://"), F.get(F.split("uri", "/"), F.lit(2)))
    only = lambda col: F.when(is_media, F.col(col)).alias(col)
    return joined.select("id", "kind", shown.alias("uri"), "status", F.when(is_media & (F.col("tags") < 0), 0).otherwise(F.col("tags")).alias("tags"), "dimension", only("cluster_name"), only("cluster_provisional"), only("request_id"), only("part_id"), storage.alias("storage_location"))


def thumbnail_uri(spark: SparkSession, folder: str) -> DataFrame:
    uri = F.when((F.col("kind") == "media") & F.col("cluster_id").isNotNull(), F.concat(F.lit("fs://derived/"), "cluster_id", F.lit("/"), "id", F.lit("/thumb.jpg")))
    return table(spark, folder, "asset").select("id", uri.alias("thumbnail"))


def tag_csv_parse(spark: SparkSession, folder: str) -> DataFrame:
    csv = F.array_join("tags", " , ")
    return table(spark, folder, "vlm_metadata").filter("size(tags) > 0").select("asset_id", F.array_join(search.tag_list(csv), "|").alias("tags")).distinct()


def join_chunk_asset(spark: SparkSession, folder: str) -> DataFrame:
    """Finished documents' texts with their asset."""
    a = table(spark, folder, "asset").select(F.col("id").alias("asset_id"), "kind", "owner", "status")
    return table(spark, folder, "documents").select("doc_id", "asset_id", "page_number", "element_type").join(a, "asset_id").filter("status = 'done'").select("doc_id", "asset_id", "kind", "owner", "page_number", "element_type")


def parent_child(spark: SparkSession, folder: str) -> DataFrame:
    """Parents with the number of their child assets."""
    a = table(spark, folder, "asset")
    kids = a.filter("parent_asset_id IS NOT NULL").groupBy(F.col("parent_asset_id").alias("id")).agg(F.count("*").alias("children"), F.min("id").alias("first_child"))
    return a.select("id", "kind").join(kids, "id")


def new_docs_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of the new batches of uploads that no upload of the history has."""
    rows = table(spark, folder, "asset_raw").select("batch_no", deliveries.stripped(F.col("request_id")).alias("request_id")).filter("request_id IS NOT NULL")
    return jobs.new_requests(rows.filter("batch_no > 0").select("request_id").distinct(), rows.filter("batch_no = 0"), "request_id")


def job_assets_explode(spark: SparkSession, folder: str) -> DataFrame:
    """The assets each kept job names, with their status."""
    q = table(spark, folder, "queue_message").filter("coalesce(retry_count, 0) = 0").select("arrival_no", F.explode(F.from_json(F.get_json_object("job_data", "$.asset_ids"), "array<string>")).alias("id"))
    return q.join(table(spark, folder, "asset").select("id", "kind", "status"), "id").select("arrival_no", F.col("id").alias("asset_id"), "kind", "status").distinct()


def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Status of each upload request from that of its assets."""
    raw = table(spark, folder, "asset_raw").select(F.col("id").alias("raw_asset_id"), deliveries.stripped(F.col("request_id")).alias("request_id"))
    return jobs.roll_up(table(spark, folder, "asset").select("raw_asset_id", "status").join(raw, "raw_asset_id"), "request_id")


def batch_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How far each batch of assets has come."""
    rows = table(spark, folder, "asset").groupBy("batch_no").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("done", "failed")).alias("processed"))
    return rows.select("batch_no", "total", "processed", jobs.progress(F.col("processed"), F.col("total")).alias("percent"))


def owner_usage(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asset").groupBy("owner", "kind").agg(F.count("*").alias("assets"), F.sum("size_bytes").alias("bytes"), F.max("ingest_no").alias("last"))


def headings_in_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks.headings_in_order(table(spark, folder, "documents").filter("asset_id IS NOT NULL"), "asset_id", "doc_id", "parent_heading")
    return rows.select("asset_id", F.array_join("headings", "|").alias("headings"))


def heading_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The last title before each text of a source, in order of the ids."""
    rows = table(spark, folder, "documents").select("doc_id", "source", "element_type", "text")
    return chunks.with_headings(rows, "source", "doc_id", "element_type", "text").select("doc_id", "heading")


def chunk_index_rownum(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("asset_id IS NOT NULL")
    return rows.select("doc_id", "asset_id", (F.row_number().over(W.partitionBy("asset_id").orderBy("doc_id")) - 1).alias("chunk_index"))


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in windows of 512 characters that overlap by 50; the text of a window as its hash."""
    rows = chunks.fixed_windows(table(spark, folder, "documents"))
    return rows.select("doc_id", "chunk_index", "start", F.length("chunk").alias("length"), F.sha2("chunk", 256).alias("chunk_hash"))


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks.fixed_windows(table(spark, folder, "documents"), size=1000, overlap=100)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


def chunk_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that name a word, ranked by how often."""
    rows = chunks.fixed_windows(table(spark, folder, "documents"))
    n = F.regexp_count(F.lower("chunk"), F.lit("ledger"))
    return rows.select("doc_id", "chunk_index", n.alias("n")).filter("n > 0")


def recursive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.recursive_chunks(table(spark, folder, "documents")).select("doc_id", "chunk_index", F.length("chunk").alias("length"))


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each source as elements, assembled to chunks under their headings."""
    rows = table(spark, folder, "documents").filter("asset_id IS NOT NULL").select("asset_id", F.col("doc_id").alias("seq"), F.col("element_type").alias("category"), "text", F.col("page_number").alias("page"))
    return chunks.assembled(rows).select("asset_id", "chunk_index", F.length("text").alias("length"), F.length("parent_heading").alias("heading_length"), "page_number", "element_type")


def metadata_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = media.with_defaults(table(spark, folder, "vlm_metadata"))
    return rows.select("asset_id", "primary_category", F.array_join("tags", "|").alias("tags"), "description", "scene_type", "suggested_cluster_name", F.array_join("color_palette", "|").alias("color_palette")).distinct()


def detected_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Detected objects with their mean and best confidence."""
    rows = table(spark, folder, "vlm_metadata").select("asset_id", F.explode("detected_objects").alias("o")).select("asset_id", "o.name", "o.confidence").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("best"))


def recognised_text(spark: SparkSession, folder: str) -> DataFrame:
    """Object names as recognised words: those of enough confidence, joined, with the mean confidence."""
    rows = table(spark, folder, "vlm_metadata").filter("detected_objects IS NOT NULL").select("asset_id", F.transform("detected_objects", lambda o: o["name"]).alias("w"), F.transform("detected_objects", lambda o: o["confidence"] * 100).alias("c"))
    return rows.select("asset_id", media.recognised_text(F.col("w"), F.col("c")).alias("r")).select("asset_id", "r.text", "r.word_count", "r.mean_confidence").distinct()


def keyframe_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Evenly spaced times within the span of each event type, as for the keyframes of a video."""
    spans = table(spark, folder, "events").groupBy("event_type").agg(F.max("value").alias("duration"))
    return spans.select("event_type", F.posexplode(media.keyframe_times(F.col("duration"), 4)).alias("place", "t")).select("event_type", "place", F.round("t", 6).alias("t"))


def frame_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label as the frames of a video of 60 seconds."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.lit(60.0).alias("duration"))
    return media.frame_timestamps(rows, "label", "vec_id", "duration").select("vec_id", "label", "timestamp_ms")


def attention_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label pooled with attention weights, axis by axis."""
    pooled = media.attention_pool(table(spark, folder, "embeddings"), "label", "vec_id")
    return pooled.select("label", F.posexplode("pooled").alias("axis", "x")).select("label", "axis", F.round("x", 6).alias("x"))


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def tumbling_event_rate(spark: SparkSession, folder: str) -> DataFrame:
    return windows.rate(table(spark, folder, "events"), "1 hour").select(_seconds("start").alias("start_s"), "event_type", "n")


def sliding_error_ratio(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.ratio(table(spark, folder, "events"), F.col("event_type") == "error", "1 hour", "15 minutes")
    return rows.select(_seconds("start").alias("start_s"), "n", "hits", "ratio")


def session_per_user(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.sessions(table(spark, folder, "events"), "2 hours")
    return rows.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("finish").cast("timestamp")).alias("finish_us"), "n")


def histogram_quantile_p95(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.bucket_counts(table(spark, folder, "events"))
    return rows.select(_seconds("start").alias("start_s"), F.round(windows.histogram_quantile(F.col("counts"), 0.95), 6).alias("p95"))


def alert_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of three hours or more, counted over the hours with events, with an error share above a fifth."""
    rows = windows.ratio(table(spark, folder, "events"), F.col("event_type") == "error", "1 hour", "1 hour")
    out = windows.alert_islands(rows, F.col("ratio") > 0.2, 3)
    return out.select(_seconds("first").alias("first_s"), _seconds("last").alias("last_s"), "windows")


def idempotent_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first message of each request."""
    q = table(spark, folder, "queue_message").filter("request_id IS NOT NULL")
    return q.groupBy("request_id").agg(F.min_by(F.struct("arrival_no", "job_type"), "arrival_no").alias("m")).select("request_id", "m.arrival_no", "m.job_type")


def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.retry_schedule(table(spark, folder, "queue_message"))


def retry_states(spark: SparkSession, folder: str) -> DataFrame:
    s = jobs.retry_state(F.col("retry_count"), F.col("max_retries"))
    return table(spark, folder, "queue_message").select("arrival_no", s.alias("s")).select("arrival_no", "s.retry_count", "s.dead_letter", "s.delay_s")


def due_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of each type that may run at a time, in the order they would run."""
    return jobs.due(table(spark, folder, "queue_message"), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("arrival_no", "job_type", "place")


def json_payload_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per readable body: one per object, one per element of an array."""
    rows = pipeline.json_payloads(table(spark, folder, "complex_orders"))
    return rows.groupBy("id").agg(F.count("*").alias("docs"))


def json_registered(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies registered under the hash of their canonical text."""
    from catalith.operators import profile

    return profile.registered(table(spark, folder, "nested_config"), "configs", "jsonb", True).unionByName(profile.registered(table(spark, folder, "complex_orders"), "orders", "jsonb", True))


def cluster_unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Unique names for clusters that are suggested the same name."""
    rows = table(spark, folder, "vlm_metadata").groupBy("asset_id").agg(F.min("suggested_cluster_name").alias("name"))
    return pipeline.unique_names(rows, "asset_id", "name")


def media_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """New media against the history, by all hashes of each: duplicate of, and cluster."""
    a = table(spark, folder, "asset").filter("kind = 'media'")
    h = table(spark, folder, "media_metadata").select(F.col("asset_id").alias("id"), "perceptual_hash").distinct()
    rows = a.join(h, "id", "left").withColumn("sha256", F.lower(F.trim("sha256")))
    stored = rows.filter("batch_no = 0").select("id", "sha256", "perceptual_hash", "cluster_id", "status", "created_at")
    return pipeline.ingest_media(rows.filter("batch_no > 0").select("id", "sha256", "perceptual_hash", "embedding"), stored, table(spark, folder, "media_cluster"))


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A name for each cluster from the tags of up to five members."""
    rows = table(spark, folder, "asset").filter("cluster_id IS NOT NULL").select("cluster_id", "id", "tags")
    return pipeline.labelled_clusters(rows)


def picture_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of pictures shrunk to a longest side of 1024."""
    rows = table(spark, folder, "media_metadata").filter("width > 0 AND height > 0").select("asset_id", "width", "height").distinct()
    return rows.select("asset_id", media.fitted(F.col("width"), F.col("height")).alias("f")).select("asset_id", "f.width", "f.height")


def exif_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the picture headers with how many pictures have each value."""
    rows = table(spark, folder, "media_metadata").select("asset_id", F.explode(F.from_json("exif", "map<string,string>")).alias("field", "value")).distinct()
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"))


def asset_facets(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.facets(table(spark, folder, "asset"))


_GRP = "CASE " + " ".join(f"WHEN lower(trim(content_type)) IN ({', '.join(repr(t) for t in ts)}) THEN '{g}'" for g, ts in mime.CONTENT_TYPES.items()) + " END"
_LIM = "CASE grp " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in mime.LIMITS.items()) + " END"
_EXT = r"lower(regexp_extract(uri, '[^/\\](\.[^./\\]+)$', 1))"
_CAT = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(e) for e in es)}) THEN '{c}'" for c, es in mime.EXTENSIONS.items()) + " END"
_STRIP = r"regexp_replace(request_id, '^\s+|\s+$', '', 'g')"
_WIN = lambda size, step: f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start - 1 AS start, chunk FROM (SELECT doc_id, start, trim(substring(text, start, {size})) AS chunk FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, {step}))::INTEGER AS start FROM documents)) WHERE chunk <> '')"
_BUCKETS = ", ".join(f"count(*) FILTER (value <= {b})" for b in windows.BOUNDS)
_TAGS = "string_agg(trim(t), '|' ORDER BY k) FILTER (trim(t) <> '')"

_PH = r"regexp_replace(regexp_replace(lower(perceptual_hash), '^\s+|\s+$', '', 'g'), '^0x', '')"

SQL = {
    "media_ingest": rf"""WITH m AS (SELECT id, batch_no, lower(trim(sha256)) AS sha, cluster_id, status, created_at, embedding FROM asset WHERE kind = 'media'),
h AS (SELECT DISTINCT asset_id AS id, ('0x' || {_PH})::UBIGINT AS v FROM media_metadata WHERE regexp_full_match({_PH}, '[0-9a-f]{{16}}')),
f AS (SELECT * FROM m WHERE batch_no > 0), s AS (SELECT * FROM m WHERE batch_no = 0 AND status = 'done'),
exact AS (SELECT f.id, arg_min(s.id, (s.created_at, s.id)) AS first FROM f JOIN s USING (sha) GROUP BY 1),
near AS (SELECT f.id, arg_min(s.id, (s.created_at, s.id)) AS first FROM f JOIN h a ON a.id = f.id JOIN h b ON bit_count(xor(a.v, b.v)) <= 4 JOIN s ON s.id = b.id WHERE f.id NOT IN (SELECT id FROM exact) GROUP BY 1),
dup AS (SELECT * FROM exact UNION ALL SELECT * FROM near),
c AS (SELECT id AS cid, CASE WHEN coalesce(threshold, 0) = 0 THEN 0.72 ELSE threshold END AS t, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS e FROM media_cluster WHERE centroid IS NOT NULL),
best AS (SELECT id, cid FROM (SELECT f.id, cid, row_number() OVER (PARTITION BY f.id ORDER BY round(list_dot_product(f.embedding::DOUBLE[], c.e), 12) DESC, cid) AS rn FROM f JOIN c ON f.embedding IS NOT NULL AND list_dot_product(f.embedding::DOUBLE[], c.e) >= c.t) WHERE rn = 1)
SELECT f.id, first AS duplicate_of, CASE WHEN first IS NOT NULL THEN o.cluster_id ELSE best.cid END AS cluster_id, 'done' AS status FROM f LEFT JOIN dup ON dup.id = f.id LEFT JOIN m o ON o.id = first LEFT JOIN best ON best.id = f.id""",
    "cluster_labels": "WITH f AS (SELECT cluster_id, tags, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM asset WHERE cluster_id IS NOT NULL), t AS (SELECT cluster_id, tag, count(*) AS n FROM (SELECT cluster_id, unnest(tags) AS tag FROM f WHERE rn <= 5) WHERE tag IS NOT NULL AND tag <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, tag) AS k FROM t) SELECT cluster_id, coalesce(string_agg(tag, ' ' ORDER BY k) FILTER (k <= 2), 'Mixed Content') AS label FROM (SELECT DISTINCT cluster_id FROM f) LEFT JOIN r USING (cluster_id) GROUP BY 1",
    "mime_kind_limits": f"SELECT id, CASE WHEN grp IN ('image', 'video', 'audio') THEN 'media' ELSE coalesce(grp, 'unknown') END AS kind, grp, CASE WHEN grp IS NULL THEN 'unsupported' WHEN size_bytes > {_LIM} THEN 'too large' ELSE 'valid' END AS verdict FROM (SELECT id, size_bytes, {_GRP} AS grp FROM asset_raw)",
    "extension_category": f"SELECT {_EXT} AS extension, coalesce({_CAT}, 'other') AS category, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM asset_raw GROUP BY 1, 2",
    "scan_statistics": f"SELECT count(*) AS total_files, sum(size_bytes)::BIGINT AS total_size_bytes, " + ", ".join(f"count(*) FILTER (c = '{c}') AS {c}" for c in mime.EXTENSIONS) + f" FROM (SELECT size_bytes, {_CAT} AS c FROM asset_raw)",
    "object_view": "SELECT a.id, kind, CASE WHEN starts_with(a.uri, 'json://pending') THEN NULL ELSE a.uri END AS uri, status, CASE WHEN kind = 'media' THEN coalesce(len(tags), 0)::INTEGER END AS tags, CASE WHEN kind = 'media' THEN len(embedding)::INTEGER END AS dimension, CASE WHEN kind = 'media' THEN c.name END AS cluster_name, CASE WHEN kind = 'media' THEN c.provisional END AS cluster_provisional, CASE WHEN kind = 'media' THEN r.request_id END AS request_id, CASE WHEN kind = 'media' THEN r.part_id END AS part_id, CASE WHEN kind = 'json' AND regexp_matches(a.uri, '^(sql|jsonb)://') THEN split_part(a.uri, '/', 3) END AS storage_location FROM asset a LEFT JOIN media_cluster c ON c.id = a.cluster_id LEFT JOIN asset_raw r ON r.id = a.raw_asset_id",
    "thumbnail_uri": "SELECT id, CASE WHEN kind = 'media' AND cluster_id IS NOT NULL THEN 'fs://derived/' || cluster_id || '/' || id || '/thumb.jpg' END AS thumbnail FROM asset",
    "tag_csv_parse": f"SELECT DISTINCT asset_id, coalesce(x, '') AS tags FROM (SELECT rid, any_value(asset_id) AS asset_id, {_TAGS} AS x FROM (SELECT rid, asset_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS k FROM (SELECT row_number() OVER () AS rid, asset_id, string_split(array_to_string(tags, ' , '), ',') AS parts FROM vlm_metadata WHERE len(tags) > 0)) GROUP BY rid)",
    "join_chunk_asset": "SELECT doc_id, d.asset_id, kind, owner, page_number, element_type FROM documents d JOIN asset a ON a.id = d.asset_id WHERE status = 'done'",
    "parent_child": "SELECT p.id, p.kind, count(*) AS children, min(c.id) AS first_child FROM asset p JOIN asset c ON c.parent_asset_id = p.id GROUP BY ALL",
    "new_docs_anti": f"SELECT DISTINCT {_STRIP} AS request_id FROM asset_raw WHERE batch_no > 0 AND request_id IS NOT NULL AND {_STRIP} NOT IN (SELECT {_STRIP} FROM asset_raw WHERE batch_no = 0 AND request_id IS NOT NULL)",
    "job_assets_explode": "SELECT DISTINCT arrival_no, a.id AS asset_id, kind, status FROM (SELECT arrival_no, unnest(from_json(job_data->'$.asset_ids', '[\"VARCHAR\"]')) AS id FROM queue_message WHERE coalesce(retry_count, 0) = 0) q JOIN asset a ON a.id = q.id",
    "status_rollup": f"WITH c AS (SELECT {_STRIP} AS request_id, count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM asset a JOIN asset_raw r ON r.id = a.raw_asset_id GROUP BY 1) SELECT *, CASE WHEN done + failed = total THEN CASE WHEN failed = 0 THEN 'done' WHEN done = 0 THEN 'failed' ELSE 'partial' END WHEN processing > 0 OR done + failed > 0 THEN 'processing' ELSE 'queued' END AS status FROM c",
    "batch_progress": "SELECT batch_no, count(*) AS total, count(*) FILTER (status IN ('done', 'failed')) AS processed, round(count(*) FILTER (status IN ('done', 'failed')) * 100.0 / count(*), 2)::DOUBLE AS percent FROM asset GROUP BY batch_no",
    "owner_usage": "SELECT owner, kind, count(*) AS assets, sum(size_bytes)::BIGINT AS bytes, max(ingest_no) AS last FROM asset GROUP BY ALL",
    "headings_in_order": "SELECT asset_id, string_agg(parent_heading, '|' ORDER BY first_at, parent_heading) AS headings FROM (SELECT asset_id, parent_heading, min(doc_id) AS first_at FROM documents WHERE asset_id IS NOT NULL AND parent_heading IS NOT NULL GROUP BY ALL) GROUP BY asset_id",
    "heading_forward_fill": "SELECT doc_id, last_value(CASE WHEN lower(element_type) IN ('title', 'heading', 'header', 'sectionheader') THEN text END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM documents",
    "chunk_index_rownum": "SELECT doc_id, asset_id, (row_number() OVER (PARTITION BY asset_id ORDER BY doc_id) - 1)::INTEGER AS chunk_index FROM documents WHERE asset_id IS NOT NULL",
    "fixed_chunks": f"SELECT doc_id, chunk_index::INTEGER AS chunk_index, start, length(chunk)::INTEGER AS length, sha256(chunk) AS chunk_hash FROM {_WIN(512, 462)}",
    "chunk_counts": f"SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM {_WIN(1000, 900)} GROUP BY doc_id",
    "chunk_keyword": f"SELECT doc_id, chunk_index::INTEGER AS chunk_index, len(regexp_extract_all(lower(chunk), 'ledger'))::INTEGER AS n FROM {_WIN(512, 462)} WHERE contains(lower(chunk), 'ledger')",
    "metadata_defaults": "SELECT DISTINCT asset_id, coalesce(primary_category, 'unknown') AS primary_category, array_to_string(CASE WHEN coalesce(len(tags), 0) = 0 THEN [coalesce(primary_category, 'unknown'), 'content'] ELSE tags[1:15] END, '|') AS tags, coalesce(description, 'No description available') AS description, coalesce(scene_type, 'abstract') AS scene_type, coalesce(suggested_cluster_name, 'Mixed Content') AS suggested_cluster_name, array_to_string((CASE WHEN len(v) < 3 THEN v || ['#808080', '#A0A0A0', '#C0C0C0'] ELSE v END)[1:5], '|') AS color_palette FROM (SELECT *, list_filter(coalesce(color_palette, ['#808080', '#A0A0A0', '#C0C0C0']), lambda c: starts_with(c, '#') AND length(c) = 7) AS v FROM vlm_metadata)",
    "detected_objects": "SELECT name, count(*) AS n, round(avg(confidence), 6) AS mean, max(confidence) AS best FROM (SELECT DISTINCT asset_id, o.name AS name, o.confidence AS confidence FROM (SELECT asset_id, unnest(detected_objects) AS o FROM vlm_metadata)) GROUP BY name",
    "recognised_text": "SELECT DISTINCT asset_id, array_to_string(list_transform(list_filter(g, lambda o: o.confidence * 100 >= 60), lambda o: trim(o.name)), ' ') AS text, len(list_filter(g, lambda o: o.confidence * 100 >= 60))::INTEGER AS word_count, round(coalesce(list_avg(list_transform(g, lambda o: greatest(o.confidence * 100, 0))), 0), 4) AS mean_confidence FROM (SELECT asset_id, list_filter(detected_objects, lambda o: trim(o.name) <> '') AS g FROM vlm_metadata WHERE detected_objects IS NOT NULL)",
    "keyframe_timestamps": "SELECT event_type, (i - 1)::INTEGER AS place, round(d * i / 5, 6) AS t FROM (SELECT event_type, max(value) AS d FROM events GROUP BY 1) CROSS JOIN range(1, 5) r(i)",
    "frame_timestamps": "SELECT vec_id, label, floor(60.0::DOUBLE / count(*) OVER (PARTITION BY label) * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 1000)::INTEGER AS timestamp_ms FROM embeddings",
    "attention_pool": "WITH a AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings), m AS (SELECT label, axis, avg(x) AS m FROM a GROUP BY ALL), z AS (SELECT label, vec_id, sum(x * m) / 0.08 AS z FROM a JOIN m USING (label, axis) GROUP BY ALL), w AS (SELECT label, vec_id, exp(z - max(z) OVER (PARTITION BY label)) AS w FROM z), p AS (SELECT label, axis, sum(x * w) / sum(w) AS x FROM a JOIN w USING (label, vec_id) GROUP BY ALL) SELECT label, axis::INTEGER AS axis, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "tumbling_event_rate": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_error_ratio": "SELECT start_s, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM (SELECT event_type, epoch(time_bucket(INTERVAL 15 MINUTES, ts))::BIGINT - 900 * i AS start_s FROM events CROSS JOIN range(4) r(i)) GROUP BY 1",
    "session_per_user": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOURS) AS finish_us, count(*) AS n FROM s GROUP BY user_id, s",
    "histogram_quantile_p95": f"WITH b AS (SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start_s, [{_BUCKETS}] AS c, count(value) AS n FROM events GROUP BY 1), i AS (SELECT *, 0.95 * n AS r, list_position(list_transform(c, lambda v: v >= 0.95 * n), true) AS i, {list(windows.BOUNDS)}::DOUBLE[] AS u FROM b) SELECT start_s, round(CASE WHEN i IS NULL OR i = 0 THEN u[-1] ELSE (CASE WHEN i = 1 THEN 0 ELSE u[i - 1] END) + (u[i] - CASE WHEN i = 1 THEN 0 ELSE u[i - 1] END) * (r - CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END) / (c[i] - CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END) END::DOUBLE, 6) AS p95 FROM i",
    "alert_islands": "WITH h AS (SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS s, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS r FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY s) AS a FROM h), i AS (SELECT *, a - row_number() OVER (ORDER BY s) AS g FROM k WHERE r > 0.2) SELECT min(s) AS first_s, max(s) AS last_s, count(*) AS windows FROM i GROUP BY g HAVING count(*) >= 3",
    "json_payload_docs": "SELECT record_id AS id, CASE WHEN json_type(body) = 'OBJECT' THEN 1 ELSE json_array_length(body) END::BIGINT AS docs FROM complex_orders WHERE json_valid(body) AND (json_type(body) = 'OBJECT' OR (json_type(body) = 'ARRAY' AND json_array_length(body) > 0))",
    "cluster_unique_names": "SELECT asset_id, CASE WHEN k > 0 THEN b || '_' || k ELSE b END AS unique_name FROM (SELECT asset_id, b, row_number() OVER (PARTITION BY b ORDER BY asset_id) - 1 AS k FROM (SELECT asset_id, coalesce(CASE WHEN trim(min(suggested_cluster_name)) <> '' THEN min(suggested_cluster_name) END, 'Cluster ' || substring(asset_id, 1, 8)) AS b FROM vlm_metadata GROUP BY asset_id))",
    "picture_sizes": "SELECT DISTINCT asset_id, trunc(width * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(width, height)))::INTEGER AS width, trunc(height * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(width, height)))::INTEGER AS height FROM media_metadata WHERE width > 0 AND height > 0",
    "exif_fields": "SELECT field, value, count(*) AS n FROM (SELECT DISTINCT asset_id, field, exif->>('$.' || field) AS value FROM (SELECT asset_id, exif, unnest(json_keys(exif)) AS field FROM media_metadata WHERE exif IS NOT NULL AND json_valid(exif))) GROUP BY ALL",
    "asset_facets": "SELECT kind, strftime(created_at, '%Y-%m') AS month, CASE WHEN size_bytes IS NULL THEN 'unknown' WHEN size_bytes < 100000 THEN 'small' WHEN size_bytes < 1000000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS assets FROM asset GROUP BY ALL",
    "idempotent_first": "SELECT request_id, min(arrival_no) AS arrival_no, arg_min(job_type, arrival_no) AS job_type FROM queue_message WHERE request_id IS NOT NULL GROUP BY 1",
    "retry_schedule": "SELECT arrival_no, attempt, delay_s, sum(delay_s) OVER (PARTITION BY arrival_no ORDER BY attempt)::BIGINT AS due FROM (SELECT arrival_no, (c + k)::INTEGER AS attempt, pow(2, c + k - 1)::BIGINT AS delay_s FROM (SELECT arrival_no, coalesce(retry_count, 0) AS c, unnest(range(1, coalesce(max_retries, 3) - coalesce(retry_count, 0))) AS k FROM queue_message))",
    "retry_states": "SELECT arrival_no, coalesce(retry_count, 0) + 1 AS retry_count, coalesce(retry_count, 0) + 1 >= coalesce(max_retries, 3) AS dead_letter, CASE WHEN coalesce(retry_count, 0) + 1 < coalesce(max_retries, 3) THEN pow(2, coalesce(retry_count, 0))::BIGINT END AS delay_s FROM queue_message",
    "due_jobs": "SELECT arrival_no, job_type, row_number() OVER (PARTITION BY job_type ORDER BY priority DESC NULLS LAST, created_at, arrival_no)::INTEGER AS place FROM queue_message WHERE next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-02-01 00:00:00'",
}

QUERIES = {f.__name__: f for f in (mime_kind_limits, extension_category, scan_statistics, object_view, thumbnail_uri, tag_csv_parse, join_chunk_asset, parent_child, new_docs_anti, job_assets_explode, status_rollup, batch_progress, owner_usage, headings_in_order, heading_forward_fill, chunk_index_rownum, fixed_chunks, chunk_counts, chunk_keyword, recursive_chunks, document_chunks, metadata_defaults, detected_objects, recognised_text, keyframe_timestamps, frame_timestamps, attention_pool, latency_percentiles, tumbling_event_rate, sliding_error_ratio, session_per_user, histogram_quantile_p95, alert_islands, idempotent_first, retry_schedule, retry_states, due_jobs, json_payload_docs, json_registered, cluster_unique_names, media_ingest, cluster_labels, picture_sizes, exif_fields, asset_facets)}
