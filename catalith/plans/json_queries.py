"""Queries that profile the JSON collections of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import profile
from catalith.sources.tables import table

COLLECTIONS = {"complex_orders": ("record_id", "body"), "nested_config": ("record_id", "body"), "unstable_events": ("record_id", "body"), "events": ("event_id", "props")}


def _each(spark: SparkSession, folder: str, function) -> DataFrame:
    out = None
    for name, (ident, body) in COLLECTIONS.items():
        part = function(profile.paths(table(spark, folder, name), ident, body)).select(F.lit(name).alias("collection"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every path of every collection with its types, depth and number of documents."""
    return _each(spark, folder, lambda flat: flat.filter("ord >= 0").groupBy("path", "type", "depth").agg(F.count("*").alias("n")))


def json_field_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.field_statistics(flat).select("path", "docs", "presence", "nulls", "max_length", "depth"))


def json_dominant_type(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.field_statistics(flat).select("path", "dominant", "stability"))


def json_structure_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.summary(profile.field_statistics(flat)))


def json_storage_decision(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.decision(profile.summary(profile.field_statistics(flat))).select("score", "storage", "confidence"))


def json_ddl_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.table_columns(profile.field_statistics(flat)))


def schema_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _each(spark, folder, lambda flat: profile.fingerprint(profile.field_statistics(flat)))


def json_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Which bodies can be taken in: JSON objects or arrays that are not empty, of at most 10 MB."""
    rows = table(spark, folder, "complex_orders").select("record_id", "body").unionByName(table(spark, folder, "nested_config").select("record_id", "body"))
    v = F.try_parse_json("body")
    kind = F.schema_of_variant(v)
    verdict = F.when(F.octet_length("body") > 10 * 1024 * 1024, "too large").when(v.isNull(), "unreadable").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY") & (F.json_array_length("body") > 0), "batch").otherwise("refused")
    return rows.select("record_id", verdict.alias("verdict"))


_FLAT = """WITH RECURSIVE src AS (SELECT 'complex_orders' AS collection, record_id AS doc, body FROM complex_orders UNION ALL SELECT 'nested_config', record_id, body FROM nested_config
  UNION ALL SELECT 'unstable_events', record_id::VARCHAR, body FROM unstable_events UNION ALL SELECT 'events', event_id::VARCHAR, props FROM events),
docs AS (SELECT collection, doc, body::JSON AS j FROM src WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
tree AS (SELECT collection, doc, k AS path, json_extract(j, '$."' || k || '"') AS v, 1 AS depth FROM (SELECT collection, doc, j, unnest(json_keys(j)) AS k FROM docs)
  UNION ALL SELECT collection, doc, path || '.' || k, json_extract(v, '$."' || k || '"'), depth + 1 FROM (SELECT collection, doc, path, v, depth, unnest(json_keys(v)) AS k FROM tree WHERE json_type(v) = 'OBJECT' AND depth < 5)),
flat AS (SELECT collection, doc, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'float' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'null' END AS type, depth, CASE WHEN json_type(v) = 'VARCHAR' THEN length(v->>'$') ELSE 0 END AS length FROM tree
  UNION ALL SELECT collection, doc, path || '[]', 'array', depth, 0 FROM tree WHERE json_type(v) = 'ARRAY' AND depth < 5 AND json_type(json_extract(v, '$[0]')) = 'OBJECT'),
n AS (SELECT collection, count(*) AS docs FROM docs GROUP BY 1),
ty AS (SELECT collection, path, type, count(*) AS n, min(doc) AS first FROM flat GROUP BY ALL),
dom AS (SELECT collection, path, arg_min(type, (-n, first)) AS dominant, max(n) AS top, sum(n) AS total FROM ty GROUP BY ALL),
fs AS (SELECT f.collection, f.path, any_value(n.docs) AS docs, round(count(*) / any_value(n.docs), 6) AS presence, count(*) FILTER (type = 'null') AS nulls, max(length) AS max_length, max(depth) AS depth FROM flat f JOIN n USING (collection) GROUP BY ALL),
fields AS (SELECT fs.*, dominant, round(top / total, 6) AS stability FROM fs JOIN dom USING (collection, path)),
summary AS (SELECT collection, any_value(docs) AS documents, count(*) AS total_fields, count(*) FILTER (depth = 1 AND NOT ends_with(path, '[]')) AS top_level_keys, max(depth) AS max_depth,
  round(coalesce(avg(presence) FILTER (NOT contains(path, '.') AND NOT ends_with(path, '[]')), 0), 6) AS field_stability, round(avg(stability), 6) AS type_stability, bool_or(ends_with(path, '[]')) AS has_array_of_objects FROM fields GROUP BY collection),
scored AS (SELECT *, round((CASE WHEN top_level_keys <= 20 THEN 0.25 ELSE 0 END + CASE WHEN max_depth <= 2 THEN 0.25 ELSE 0 END + CASE WHEN field_stability >= 0.6 THEN 0.25 ELSE 0 END + CASE WHEN type_stability >= 0.9 THEN 0.15 ELSE 0 END + CASE WHEN NOT has_array_of_objects THEN 0.10 ELSE 0 END)::DOUBLE, 4) AS score FROM summary)
"""
_COLUMN = r"""CASE WHEN p IN ('user', 'group', 'order', 'table', 'index', 'key', 'value', 'default') THEN p || '_col' ELSE p END"""

SQL = {
    "json_paths": _FLAT + "SELECT collection, path, type, depth, count(*) AS n FROM flat GROUP BY ALL",
    "json_field_stats": _FLAT + "SELECT collection, path, docs, presence, nulls, max_length, depth FROM fields",
    "json_dominant_type": _FLAT + "SELECT collection, path, dominant, stability FROM fields",
    "json_structure_summary": _FLAT + "SELECT collection, documents, total_fields, top_level_keys, max_depth, field_stability, type_stability, has_array_of_objects FROM summary",
    "json_storage_decision": _FLAT + "SELECT collection, score, CASE WHEN NOT has_array_of_objects AND top_level_keys <= 20 AND max_depth <= 2 AND score >= 0.85 THEN 'sql' ELSE 'jsonb' END AS storage, round((CASE WHEN has_array_of_objects THEN 0.95 WHEN top_level_keys > 20 OR max_depth > 2 THEN 0.9 WHEN score >= 0.85 THEN score ELSE 1 - score END)::DOUBLE, 4) AS confidence FROM scored",
    "json_ddl_columns": _FLAT + f""", top AS (SELECT *, CASE WHEN regexp_matches(q, '^[0-9]') THEN 'col_' || q ELSE q END AS p FROM (SELECT *, regexp_replace(lower(path), '[^\\pL\\pN_]', '_', 'g') AS q FROM fields WHERE NOT contains(path, '.') AND NOT ends_with(path, '[]'))),
named AS (SELECT *, {_COLUMN} AS plain FROM top), placed AS (SELECT *, row_number() OVER (PARTITION BY collection, plain ORDER BY path) - 1 + CASE WHEN plain IN ('id', 'extra', 'created_at', 'updated_at') THEN 1 ELSE 0 END AS k FROM named)
SELECT collection, CASE WHEN k > 0 THEN plain || '_' || k ELSE plain END AS "column", path, CASE dominant WHEN 'string' THEN CASE WHEN max_length = 0 THEN 'TEXT' WHEN max_length <= 255 THEN 'VARCHAR(' || max_length || ')' WHEN max_length <= 1000 THEN 'VARCHAR(1000)' ELSE 'TEXT' END WHEN 'boolean' THEN 'BOOLEAN' WHEN 'integer' THEN 'BIGINT' WHEN 'float' THEN 'DOUBLE PRECISION' WHEN 'null' THEN 'TEXT' ELSE 'JSONB' END AS sql_type,
presence < 0.95 AS nullable, (contains(lower(path), 'id') OR ends_with(lower(path), '_key') OR (presence > 0.8 AND stability > 0.9 AND dominant IN ('integer', 'string'))) AS indexed FROM placed""",
    "schema_fingerprint": _FLAT + """SELECT collection, sha256('{' || string_agg('"' || path || '": "JsonType.' || upper(dominant) || '"', ', ' ORDER BY path) || '}') AS fingerprint FROM fields GROUP BY collection""",
    "json_validity": "SELECT record_id, CASE WHEN strlen(body) > 10485760 THEN 'too large' WHEN NOT json_valid(body) THEN 'unreadable' WHEN json_type(body) = 'OBJECT' THEN 'object' WHEN json_type(body) = 'ARRAY' AND json_array_length(body) > 0 THEN 'batch' ELSE 'refused' END AS verdict FROM (SELECT record_id, body FROM complex_orders UNION ALL SELECT record_id, body FROM nested_config)",
}

QUERIES = {f.__name__: f for f in (json_paths, json_field_stats, json_dominant_type, json_structure_summary, json_storage_decision, json_ddl_columns, schema_fingerprint, json_validity)}
