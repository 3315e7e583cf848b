"""Queries over batches, schemas, lineage, jobs, decoded pictures and the index of cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import mime
from catalith.operators import jobs, media, neighbours, profile, search
from catalith.session import scratch, stash
from catalith.sources.tables import table
from catalith.streaming import worker

OWNER = "team-amber-archive"


def newest_assets(spark: SparkSession, folder: str) -> DataFrame:
    """An owner's assets among the hundred newest: the limit comes before the filter."""
    return jobs.newest(table(spark, folder, "asset").select("id", "owner", "created_at"), 100, OWNER).select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    """The batches with their progress, the newest hundred."""
    rows = jobs.newest(jobs.batches(table(spark, folder, "asset")), 100, ident="batch_no")
    return rows.select("batch_no", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "owner", "total", "processed", "percent")


def schema_asset_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every content type as a schema with the number of its JSON assets, none included."""
    assets = table(spark, folder, "asset").select(F.col("content_type").alias("schema_name"), "kind")
    schemas = assets.filter("schema_name IS NOT NULL").select("schema_name", F.lit("active").alias("status")).distinct()
    return jobs.schema_counts(schemas, assets.filter("kind = 'json'"))


def content_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Searchable assets whose content type begins with image/."""
    return search.SearchFilter(content_prefix="image/").apply(table(spark, folder, "asset")).select("id", "content_type")


def document_images(spark: SparkSession, folder: str) -> DataFrame:
    """The images of one document, the first that has any, ranked by similarity."""
    assets = table(spark, folder, "asset")
    first = assets.filter("parent_asset_id IS NOT NULL AND embedding IS NOT NULL").agg(F.min("parent_asset_id").alias("p")).first().p
    return search.scored(assets, search.query_vector(assets), search.SearchFilter(parent=first)).select("id", F.round("similarity", 4).alias("similarity"))


def search_total(spark: SparkSession, folder: str) -> DataFrame:
    """How many results a search reports: those after its limit."""
    assets = table(spark, folder, "asset")
    return search.total(search.scored(assets, search.query_vector(assets)).filter("similarity >= 0.5"), 25)


def field_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten values of every field of the configurations, as JSON text."""
    return profile.sample_values(table(spark, folder, "nested_config"))


def mime_sniffed(spark: SparkSession, folder: str) -> DataFrame:
    """Content types by the leading bytes of contents, here the digits of the assets' hashes behind a signature that their type chooses, else by extension."""
    rows = table(spark, folder, "asset").select("id", "uri", F.unhex(F.concat(_lead(), F.lower(F.trim("sha256")))).alias("content"))
    return rows.select("id", mime.sniffed(F.col("content"), F.col("uri")).alias("content_type"))


#: Leading bytes given to contents of these types; all others begin with a zero byte.
LEADS = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "image/webp": "52494646AAAAAAAA57454250", "video/mp4": "00000018667479706D703432", "audio/mpeg": "494433", "application/pdf": "255044462D31"}


def _lead():
    out = F.lit("00")
    for kind, digits in LEADS.items():
        out = F.when(F.col("content_type") == kind, digits).otherwise(out)
    return out


def lineage_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage written for every asset, received and processed, and how it is spread over the stages."""
    path = f"{scratch(spark)}/lineage-{uuid.uuid4().hex}"
    assets = table(spark, folder, "asset")
    jobs.write_lineage(assets.select(*jobs.lineage_row(F.col("raw_asset_id"), "received", F.col("id"))), path)
    done = assets.filter("status IN ('done', 'failed')")
    jobs.write_lineage(done.select(*jobs.lineage_row(F.col("raw_asset_id"), "processed", F.col("id"), F.col("status") == "done", F.when(F.col("status") == "failed", "failed"))), path)
    return jobs.stage_counts(jobs.lineage(spark, path))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each message after one attempt that fails for want of a request."""
    rows = table(spark, folder, "queue_message").select("arrival_no", "job_id", "request_id", "retry_count", "max_retries")

    def handler(row: dict) -> None:
        if row["request_id"] is None:
            raise ValueError("no request")

    tried = stash(worker.handled(rows.select("arrival_no", "request_id"), "arrival_no", handler), "tried")
    joined = rows.join(tried, "arrival_no")
    return worker.after_attempt(joined, F.col("success"), F.col("error")).select("arrival_no", "status", F.col("attempts").cast("int").alias("attempts"), "delay_s", "last_error").distinct()


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as grey pictures of eight by eight pixels."""
    pixels = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, folder, "embeddings").select("vec_id", "label", pixels.alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def picture_palette(spark: SparkSession, folder: str) -> DataFrame:
    """The mean colours of the three bands of each picture."""
    return media.analysed_pictures(_pictures(spark, folder), "vec_id").select("vec_id", F.array_join("palette", "|").alias("palette"), "error")


def picture_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Perceptual hash and share of edges of each picture."""
    return media.analysed_pictures(_pictures(spark, folder), "vec_id").select("vec_id", "perceptual_hash", F.round("edges", 6).alias("edges"), "has_text")


def diverse_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The three most different of every fifty pictures of a label."""
    rows = _pictures(spark, folder).withColumn("video", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 50).cast("string")))
    return media.chosen_frames(rows.withColumn("pixels", F.flatten(F.transform("pixels", lambda x: F.array(x, x, x)))), "video", "vec_id")


def heaviest_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The three frames of each label with the largest attention weights."""
    return media.heaviest_frames(table(spark, folder, "embeddings"), "label", "vec_id")


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for its neighbours among all."""
    return table(spark, folder, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def neighbours_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of each query, exactly."""
    found = neighbours.nearest(table(spark, folder, "embeddings"), _queries(spark, folder), 10, "vec_id")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "place")


def neighbours_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the true ten nearest assets an index of cells finds, for every asset whose number is divisible by 100, from a tenth of its cells."""
    rows = table(spark, folder, "asset").filter("embedding IS NOT NULL").select("id", "ingest_no", "embedding")
    queries = rows.filter("ingest_no % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = neighbours.CellIndex(spark, f"{scratch(spark)}/cells-{uuid.uuid4().hex}")
    cells = index.build(rows)
    return neighbours.recall(index.search(queries, 10, max(4, -(-cells // PROBED))), index.search(queries, 10))


#: One in so many cells is read for each query.
PROBED = 10

_SIM = "(SELECT embedding::DOUBLE[] FROM asset WHERE embedding IS NOT NULL ORDER BY id LIMIT 1)"
_SCORE = f"(1 + list_dot_product(embedding::DOUBLE[], {_SIM}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_SIM}, {_SIM})))) / 2"
_LEAD = "CASE content_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEADS.items()) + " ELSE '00' END"
_UNIT = "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"

SQL = {
    "newest_assets": f"SELECT id, epoch_us(created_at) AS created_us FROM (SELECT * FROM asset ORDER BY created_at DESC NULLS LAST, id LIMIT 100) WHERE owner = '{OWNER}'",
    "batch_list": "SELECT batch_no, epoch_us(min(created_at)) AS created_us, arg_min_null(owner, ingest_no) AS owner, count(*) AS total, count(*) FILTER (status IN ('done', 'failed')) AS processed, round(count(*) FILTER (status IN ('done', 'failed')) * 100.0 / count(*), 2)::DOUBLE AS percent FROM asset GROUP BY batch_no ORDER BY 2 DESC LIMIT 100",
    "schema_asset_counts": "SELECT content_type AS schema_name, 'active' AS status, count(*) FILTER (kind = 'json') AS assets FROM asset WHERE content_type IS NOT NULL GROUP BY 1",
    "content_prefix": "SELECT id, content_type FROM asset WHERE embedding IS NOT NULL AND content_type LIKE 'image/%'",
    "document_images": f"SELECT id, round({_SCORE}, 4) AS similarity FROM asset WHERE embedding IS NOT NULL AND parent_asset_id = (SELECT min(parent_asset_id) FROM asset WHERE embedding IS NOT NULL)",
    "search_total": f"SELECT count(*) AS total FROM (SELECT 1 FROM asset WHERE embedding IS NOT NULL AND {_SCORE} >= 0.5 LIMIT 25)",
    "mime_sniffed": f"""WITH c AS (SELECT id, lower(regexp_extract(uri, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS ext, CASE WHEN regexp_full_match({_LEAD} || lower(trim(sha256)), '([0-9a-fA-F]{{2}})+') THEN upper({_LEAD} || trim(sha256)) END AS h FROM asset)
SELECT id, CASE WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, '255044462D') THEN 'application/pdf' WHEN starts_with(h, '494433') THEN 'audio/mpeg' WHEN starts_with(h, '52494646') AND h[17:24] = '57454250' THEN 'image/webp' WHEN h[9:16] = '66747970' THEN 'video/mp4'
  WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' WHEN ext IN ('.png', '.gif', '.webp') THEN 'image/' || ext[2:] WHEN ext = '.mp4' THEN 'video/mp4' WHEN ext = '.avi' THEN 'video/x-msvideo' WHEN ext = '.mov' THEN 'video/quicktime' WHEN ext = '.wav' THEN 'audio/wav' WHEN ext = '.mp3' THEN 'audio/mpeg' WHEN ext = '.m4a' THEN 'audio/mp4' ELSE 'application/octet-stream' END AS content_type FROM c""",
    "lineage_stages": "SELECT 'received' AS stage, count(*) AS entries, count(*) AS succeeded, 0::BIGINT AS failed, count(DISTINCT raw_asset_id) AS requests FROM asset UNION ALL SELECT 'processed', count(*), count(*) FILTER (status = 'done'), count(*) FILTER (status = 'failed'), count(DISTINCT raw_asset_id) FROM asset WHERE status IN ('done', 'failed')",
    "job_states": "SELECT DISTINCT arrival_no, CASE WHEN request_id IS NOT NULL THEN 'done' WHEN c + 1 >= m THEN 'dead' ELSE 'queued' END AS status, CASE WHEN request_id IS NOT NULL THEN c ELSE c + 1 END::INTEGER AS attempts, CASE WHEN request_id IS NULL AND c + 1 < m THEN pow(2, c)::BIGINT END AS delay_s, CASE WHEN request_id IS NULL THEN 'ValueError: no request' END AS last_error FROM (SELECT arrival_no, request_id, coalesce(retry_count, 0) AS c, coalesce(max_retries, 3) AS m FROM queue_message)",
    "picture_palette": "WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor((x + 1) * 127.5)) AS g FROM embeddings) SELECT vec_id, array_to_string(list_transform([trunc(list_avg(g[1:24]))::INTEGER, trunc(list_avg(g[25:48]))::INTEGER, trunc(list_avg(g[49:64]))::INTEGER], lambda v: '#' || repeat(printf('%02x', v), 3)), '|') AS palette, NULL::VARCHAR AS error FROM p",
    "heaviest_frames": "WITH a AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS axis FROM embeddings), m AS (SELECT label, axis, avg(x) AS m FROM a GROUP BY ALL), z AS (SELECT label, vec_id, sum(x * m) / 0.08 AS z FROM a JOIN m USING (label, axis) GROUP BY ALL), w AS (SELECT label, vec_id, z, exp(z - max(z) OVER (PARTITION BY label)) AS w FROM z) SELECT label, vec_id, round(w / s, 6) AS weight, place::INTEGER AS place FROM (SELECT label, vec_id, w, sum(w) OVER (PARTITION BY label) AS s, row_number() OVER (PARTITION BY label ORDER BY z DESC, vec_id) AS place FROM w) WHERE place <= 3",
    "neighbours_exact": f"{_UNIT} SELECT query_id, vec_id, round(s, 6) AS similarity, place::INTEGER AS place FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 12) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 12) DESC, v.vec_id) AS place FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0) WHERE place <= 10",
}

QUERIES = {f.__name__: f for f in (newest_assets, batch_list, schema_asset_counts, content_prefix, document_images, search_total, field_samples, mime_sniffed, lineage_stages, job_states, picture_palette, picture_hashes, diverse_frames, heaviest_frames, neighbours_exact, neighbours_recall)}
