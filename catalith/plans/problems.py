"""Queries of the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import deliveries, drift, shred, spikes
from catalith.session import stash
from catalith.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every product_id within items and every host within config.database, at its place."""
    orders = shred.rebuild(shred.shred(table(spark, folder, "complex_orders"), roots=[("items",)]), "product_id")
    hosts = shred.rebuild(shred.shred(table(spark, folder, "nested_config"), roots=[("config", "database")]), "host")
    return orders.unionByName(hosts).select("record_id", "node_path", "leaf_value").distinct()


def p2_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of orders: one row per readable record."""
    shredded = shred.shred(table(spark, folder, "complex_orders"), roots=[("order_id",), ("total",), ("customer",), ("shipping", "address")])
    leaves = shred.rebuild(shredded)
    value = lambda path: F.min(F.when(F.col("leaf_path") == path, F.col("leaf_value")))
    return leaves.groupBy("record_id").agg(value("order_id").alias("order_id"), F.coalesce(value("customer"), value("customer.code")).alias("customer"), value("shipping.address.city").alias("city"), value("total").alias("total"))


def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of items: each names its record, the row that holds it and its place there."""
    return shred.flat_table(shred.shred(table(spark, folder, "complex_orders"), roots=[("items",)], objects=True), ["product_id", "quantity"])


def p2_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of database hosts with their ports."""
    return shred.flat_table(shred.shred(table(spark, folder, "nested_config"), roots=[("config", "database")], objects=True), ["host", "port"])


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings with the reason."""
    return spikes.implausible_readings(table(spark, folder, "sensors"), table(spark, folder, "unit_limits")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, folder, "sensors"), table(spark, folder, "unit_limits")).select("reading_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of each file against the file before it in its feed."""
    return drift.file_changes(table(spark, folder, "unstable_events"))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    """All readable lines as one table with every field, synonyms of all feeds in one column, and the casts that failed."""
    events = table(spark, folder, "unstable_events")
    stats = stash(drift.file_statistics(events), "statistics")
    changes = stash(drift.file_changes(events, stats=stats), "changes")
    return drift.unified_feed_table(events, changes, *drift.derived_schema(stats, changes, ("event", "session_duration", "referrer", "campaign")))


def _identities(spark: SparkSession, folder: str) -> dict[str, tuple]:
    """The rows, the identity and the order of delivery of each origin."""
    return {
        "queue_message": (table(spark, folder, "queue_message"), [deliveries.uuid_value(F.col("job_id")), F.coalesce("retry_count", F.lit(0))], [F.col("arrival_no"), F.col("received_at")]),
        "asset_raw": (table(spark, folder, "asset_raw"), [deliveries.stripped(F.col("request_id")), F.coalesce("part_id", F.lit(""))], [F.col("arrival_no"), F.col("created_at")]),
    }


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surplus copies among queue messages and raw uploads."""
    parts = [deliveries.surplus_deliveries(rows, identity, order, "arrival_no").select(F.lit(origin).alias("origin"), "arrival_no") for origin, (rows, identity, order) in _identities(spark, folder).items()]
    return parts[0].unionByName(parts[1])


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The one copy of each queue message and of each raw upload that remains."""
    kept = {origin: deliveries.kept_deliveries(rows, identity, order, "arrival_no") for origin, (rows, identity, order) in _identities(spark, folder).items()}
    queue = kept["queue_message"].select(F.lit("queue_message").alias("origin"), "arrival_no", "batch_no", F.col("job_id").alias("message"), F.col("retry_count").cast("string").alias("part"), "request_id", F.col("job_type").alias("kind"))
    raw = kept["asset_raw"].select(F.lit("asset_raw").alias("origin"), "arrival_no", "batch_no", F.col("id").alias("message"), F.col("part_id").alias("part"), "request_id", F.col("content_type").alias("kind"))
    return queue.unionByName(raw)


_UUID = r"""CASE WHEN regexp_full_match(regexp_replace(regexp_replace(regexp_replace(lower(job_id), '^\s+|\s+$', '', 'g'), '^\{?(urn:)?(uuid:)?', ''), '[{}\-]', '', 'g'), '[0-9a-f]{32}')
  THEN regexp_replace(regexp_replace(regexp_replace(lower(job_id), '^\s+|\s+$', '', 'g'), '^\{?(urn:)?(uuid:)?', ''), '[{}\-]', '', 'g')
  ELSE 'text:' || regexp_replace(job_id, '^\s+|\s+$', '', 'g') END"""

_DECODED = r"""CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0}->>'$', '^\s*[\{{\[]') AND json_valid({0}->>'$') THEN ({0}->>'$')::JSON ELSE {0} END"""
_CHILD = _DECODED.format("c.j")
_TREE = rf"""WITH RECURSIVE bodies AS (SELECT record_id, 'items' AS path, body::JSON AS v FROM complex_orders WHERE json_valid(body) UNION ALL SELECT record_id, 'config', body::JSON FROM nested_config WHERE json_valid(body)),
roots AS (SELECT record_id, path, {_DECODED.format("v")} AS v FROM bodies),
tops AS (SELECT record_id, path, {_DECODED.format("w")} AS v FROM (SELECT record_id, path, json_extract(v, '$.' || path) AS w FROM roots) WHERE w IS NOT NULL),
tree AS (SELECT record_id, path, v, false AS deep FROM tops
  UNION ALL SELECT record_id, path || c.p AS path, {_CHILD} AS v, true FROM (SELECT record_id, path, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'p': '.' || k, 'j': json_extract(v, '$."' || k || '"')}})
    WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {{'p': '[' || i || ']', 'j': json_extract(v, '$[' || i || ']')}}) END) AS c FROM tree WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
"""

SQL = {
    "p2_found": _TREE + """SELECT DISTINCT record_id, path AS node_path, v->>'$' AS leaf_value FROM tree WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')
  AND ((starts_with(path, 'items') AND ends_with(path, '.product_id')) OR (starts_with(path, 'config.database') AND ends_with(path, '.host')))""",
    "p2_orders": rf"""SELECT record_id, CASE WHEN json_type(v, '$.order_id') NOT IN ('OBJECT', 'ARRAY') THEN v->>'$.order_id' END AS order_id, coalesce(CASE WHEN json_type(c) NOT IN ('OBJECT', 'ARRAY') THEN c->>'$' END, c->>'$.code') AS customer, ({_DECODED.format("(s->'$.address')")})->>'$.city' AS city, v->>'$.total' AS total
  FROM (SELECT record_id, v, {_DECODED.format("(v->'$.customer')")} AS c, {_DECODED.format("(v->'$.shipping')")} AS s FROM (SELECT record_id, {_DECODED.format("b")} AS v FROM (SELECT record_id, body::JSON AS b FROM complex_orders WHERE json_valid(body))) WHERE json_type(v) = 'OBJECT')
  WHERE coalesce(v->'$.order_id', v->'$.total', c, s->'$.address') IS NOT NULL""",
    "p6_found": rf"""SELECT 'queue_message' AS origin, arrival_no FROM (SELECT arrival_no, row_number() OVER (PARTITION BY k, r ORDER BY arrival_no) AS rn
  FROM (SELECT arrival_no, {_UUID} AS k, coalesce(retry_count, 0) AS r FROM queue_message) WHERE k IS NOT NULL) WHERE rn > 1
UNION ALL SELECT 'asset_raw', arrival_no FROM (SELECT arrival_no, row_number() OVER (PARTITION BY k, p ORDER BY arrival_no) AS rn
  FROM (SELECT arrival_no, regexp_replace(request_id, '^\s+|\s+$', '', 'g') AS k, coalesce(part_id, '') AS p FROM asset_raw) WHERE k IS NOT NULL) WHERE rn > 1""",
    "p6_kept": rf"""SELECT 'queue_message' AS origin, arrival_no, batch_no, job_id AS message, retry_count::VARCHAR AS part, request_id, job_type AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY k, coalesce(retry_count, 0) ORDER BY arrival_no) AS rn FROM (SELECT *, {_UUID} AS k FROM queue_message)) WHERE rn = 1 OR k IS NULL
UNION ALL SELECT 'asset_raw', arrival_no, batch_no, id, part_id, request_id, content_type
  FROM (SELECT *, row_number() OVER (PARTITION BY k, coalesce(part_id, '') ORDER BY arrival_no) AS rn FROM (SELECT *, regexp_replace(request_id, '^\s+|\s+$', '', 'g') AS k FROM asset_raw)) WHERE rn = 1 OR k IS NULL""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_orders, p2_items, p2_hosts, p3_found, p3_reasons, p5_found, p5_table, p6_found, p6_kept)}
