"""Structure profiles of JSON documents, the choice between a typed table and a document column, and the schema text.

Documents are flattened in Arrow batches: one row per path with its JSON type, depth and text length. All statistics
are hash aggregations over those rows, partial in the map tasks. Integers and floats are told apart by their notation.

Defined cases: text that is no JSON object gives no paths; an explicit null counts as presence and as a type of its
own; arrays are not entered, but one whose first element is an object adds ``path[]``; a tie between types goes to the one
seen first in order of the document ids; keys with a dot count as nested.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.session import spread

MAX_KEYS, MAX_DEPTH, FIELD_STABILITY, TYPE_STABILITY = 20, 2, 0.6, 0.9
PRESENT, SAMPLE_VALUES = 0.95, 10
#: Words a column may not be named.
RESERVED = ("user", "group", "order", "table", "index", "key", "value", "default")
IMPLICIT = ("id", "extra", "created_at", "updated_at")


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    for kind, name in ((int, "integer"), (float, "float"), (str, "string"), (list, "array"), (dict, "object")):
        if isinstance(v, kind):
            return name
    return "string"


def flatten(document: object, max_depth: int = 3) -> list[tuple[str, str, int, int]]:
    """(path, type, depth, text length) of every path down to ``max_depth``; nothing if it is no object."""
    out: list[tuple[str, str, int, int]] = []

    def visit(node: dict, prefix: str, depth: int) -> None:
        for k, v in node.items():
            path = f"{prefix}.{k}" if prefix else k
            out.append((path, json_type(v), depth, len(v) if isinstance(v, str) else 0))
            if depth < max_depth:
                if isinstance(v, dict):
                    visit(v, path, depth + 1)
                elif isinstance(v, list) and v and isinstance(v[0], dict):
                    out.append((path + "[]", "array", depth, 0))

    if isinstance(document, dict):
        visit(document, "", 1)
    return out


def paths(df: DataFrame, ident: str = "record_id", body: str = "body", max_depth: int = 5) -> DataFrame:
    """(doc, ord, path, type, depth, length): one row per document and path. Documents are objects; arrays of objects at
    the top are one document per element."""
    names = ["doc", "ord", "path", "type", "depth", "length"]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                for i, one in enumerate(value if isinstance(value, list) else [value]):
                    if isinstance(one, dict):
                        name = f"{doc}#{i}" if isinstance(value, list) else doc
                        rows.append((name, -1, None, None, 0, 0))
                        rows += [(name, k, *r) for k, r in enumerate(flatten(one, max_depth))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(df.select(F.col(ident).cast("string"), F.col(body))).mapInArrow(run, "doc string, ord int, path string, type string, depth int, length int")


def sample_values(df: DataFrame, ident: str = "record_id", body: str = "body", max_depth: int = 5, most: int = SAMPLE_VALUES) -> DataFrame:
    """(path, samples): the first ``most`` values of every field that are not null, as JSON text, in order of the document ids. Each task keeps so many of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str, list[tuple[str, str]]] = {}

            def visit(doc: str, node: dict, prefix: str, depth: int) -> None:
                for k, v in node.items():
                    path = f"{prefix}.{k}" if prefix else k
                    if v is not None:
                        kept.setdefault(path, []).append((doc, json.dumps(v, ensure_ascii=False, sort_keys=True)))  # noqa: B023
                    if isinstance(v, dict) and depth < max_depth:
                        visit(doc, v, path, depth + 1)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                for one in value if isinstance(value, list) else [value]:
                    if isinstance(one, dict) and doc is not None:
                        visit(doc, one, "", 1)
            rows = [(p, d, v) for p, entries in kept.items() for d, v in sorted(entries)[:most]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "doc", "value"])

    rows = df.select(F.col(ident).cast("string"), F.col(body)).mapInArrow(run, "path string, doc string, value string")
    place = F.row_number().over(W.partitionBy("path").orderBy("doc", "value"))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)  # cut to so many in the map tasks
    return first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("samples"))


def field_statistics(flat: DataFrame) -> DataFrame:
    """(path, docs, presence, nulls, max_length, depth, dominant, stability): one row per path."""
    total = flat.filter("ord = -1").agg(F.count("*").alias("docs"))
    by_type = flat.filter("ord >= 0").groupBy("path", "type").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("length").alias("length"), F.max("depth").alias("depth"))
    fields = by_type.groupBy("path").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        F.max("length").alias("max_length"),
        F.max("depth").alias("depth"),
        F.min_by(F.struct("type", "n"), F.struct(-F.col("n"), "first")).alias("top"),
    )
    joined = fields.crossJoin(total)  # total is one row
    return joined.select("path", "docs", F.round(F.col("n") / F.col("docs"), 6).alias("presence"), "nulls", "max_length", "depth", F.col("top.type").alias("dominant"), F.round(F.col("top.n") / F.col("n"), 6).alias("stability"))


def likely_key(path: Column) -> Column:
    """Whether a path looks like a foreign key; ``width`` and ``video`` do too."""
    low = F.lower(path)
    return low.endswith("_key") | low.contains("id")


def summary(fields: DataFrame) -> DataFrame:
    """One row: documents, total_fields, top_level_keys, max_depth, field_stability, type_stability, has_array_of_objects."""
    top = ~F.col("path").contains(".") & ~F.col("path").endswith("[]")
    return fields.agg(
        F.coalesce(F.max("docs"), F.lit(0)).alias("documents"),
        F.count("*").alias("total_fields"),
        F.count_if((F.col("depth") == 1) & ~F.col("path").endswith("[]")).alias("top_level_keys"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.round(F.coalesce(F.avg(F.when(top, F.col("presence"))), F.lit(0.0)), 6).alias("field_stability"),
        F.round(F.coalesce(F.avg("stability"), F.lit(0.0)), 6).alias("type_stability"),
        F.coalesce(F.bool_or(F.col("path").endswith("[]")), F.lit(False)).alias("has_array_of_objects"),
    )


def decision(profile: DataFrame, max_keys: int = MAX_KEYS, max_depth: int = MAX_DEPTH, stability: float = FIELD_STABILITY) -> DataFrame:
    """The summary with score, storage (sql or jsonb) and confidence. Vetoes in order: arrays of objects, too many keys,
    too deep; else sql from a score of 0.85."""
    s = lambda c, w: F.when(c, w).otherwise(0.0)
    score = s(F.col("top_level_keys") <= max_keys, 0.25) + s(F.col("max_depth") <= max_depth, 0.25) + s(F.col("field_stability") >= stability, 0.25) + s(F.col("type_stability") >= TYPE_STABILITY, 0.15) + s(~F.col("has_array_of_objects"), 0.10)
    rows = profile.withColumn("score", F.round(score, 4))
    veto = F.when(F.col("has_array_of_objects"), 0.95).when((F.col("top_level_keys") > max_keys) | (F.col("max_depth") > max_depth), 0.90)
    sql = veto.isNull() & (F.col("score") >= 0.85)
    return rows.withColumn("storage", F.when(sql, "sql").otherwise("jsonb")).withColumn("confidence", F.round(F.coalesce(veto, F.when(sql, F.col("score")).otherwise(1 - F.col("score"))), 4))


def rationale(row, max_keys: int = MAX_KEYS, max_depth: int = MAX_DEPTH, stability: float = FIELD_STABILITY) -> str:
    """The clauses of a decision, met or not, as one line."""
    clauses = [
        (row.top_level_keys <= max_keys, f"{row.top_level_keys} top-level keys (limit {max_keys})"),
        (row.max_depth <= max_depth, f"depth {row.max_depth} (limit {max_depth})"),
        (row.field_stability >= stability, f"field stability {row.field_stability:.2f} (least {stability})"),
        (row.type_stability >= TYPE_STABILITY, f"type stability {row.type_stability:.2f}"),
        (not row.has_array_of_objects, "no arrays of objects"),
    ]
    return "; ".join(f"{'✓' if good else '✗'} {text}" for good, text in clauses)


def sql_type(dominant: Column, length: Column) -> Column:
    text = F.when(length == 0, "TEXT").when(length <= 255, F.concat(F.lit("VARCHAR("), length, F.lit(")"))).when(length <= 1000, "VARCHAR(1000)").otherwise("TEXT")
    return F.when(dominant == "string", text).when(dominant == "boolean", "BOOLEAN").when(dominant == "integer", "BIGINT").when(dominant == "float", "DOUBLE PRECISION").when(dominant.isin("array", "object"), "JSONB").otherwise("TEXT")


def column_name(path: Column) -> Column:
    """A plain column name for a path; never empty."""
    plain = F.regexp_replace(F.lower(F.replace(F.replace(path, F.lit("."), F.lit("_")), F.lit("[]"), F.lit("_array"))), r"[^\p{L}\p{N}_]", "_")
    plain = F.when(plain == "", "col_empty").when(plain.rlike(r"^\p{N}"), F.concat(F.lit("col_"), plain)).otherwise(plain)
    return F.when(plain.isin(*RESERVED), F.concat(plain, F.lit("_col"))).otherwise(plain)


def table_columns(fields: DataFrame) -> DataFrame:
    """(column, path, sql_type, nullable, indexed): the columns of a typed table for the top-level fields; a name that
    another field or an implicit column has gets a number."""
    from pyspark.sql import Window as W

    top = fields.filter(~F.col("path").contains(".") & ~F.col("path").endswith("[]")).withColumn("plain", column_name(F.col("path")))
    place = F.row_number().over(W.partitionBy("plain").orderBy("path")) - 1 + F.when(F.col("plain").isin(*IMPLICIT), 1).otherwise(0)
    named = F.when(place > 0, F.concat("plain", F.lit("_"), place)).otherwise(F.col("plain"))
    indexed = likely_key(F.col("path")) | ((F.col("presence") > 0.8) & (F.col("stability") > 0.9) & F.col("dominant").isin("integer", "string"))
    return top.select(named.alias("column"), "path", sql_type(F.col("dominant"), F.col("max_length")).alias("sql_type"), (F.col("presence") < PRESENT).alias("nullable"), indexed.alias("indexed"))


def table_ddl(columns: DataFrame, name: str) -> str:
    """The statements that create the table and its indexes. As many rows as the documents have top-level fields."""
    rows = columns.orderBy("path").collect()
    lines = ["    id UUID PRIMARY KEY"] + [f"    {r.column} {r.sql_type}{'' if r.nullable else ' NOT NULL'}" for r in rows] + ["    extra JSONB", "    created_at TIMESTAMP DEFAULT NOW()", "    updated_at TIMESTAMP DEFAULT NOW()"]
    indexes = [f"CREATE INDEX IF NOT EXISTS idx_{name}_{r.column} ON {name} {'USING GIN ' if r.sql_type == 'JSONB' else ''}({r.column});" for r in rows if r.indexed]
    return "\n".join([f"CREATE TABLE IF NOT EXISTS {name} (", ",\n".join(lines), ");", *indexes])


def collection_ddl(name: str) -> str:
    return f"CREATE TABLE IF NOT EXISTS {name} (\n    id UUID PRIMARY KEY,\n    doc JSONB NOT NULL,\n    created_at TIMESTAMP DEFAULT NOW(),\n    updated_at TIMESTAMP DEFAULT NOW()\n);\nCREATE INDEX IF NOT EXISTS idx_{name}_doc ON {name} USING GIN (doc);"


def insert_template(columns: list[str], name: str, named: bool = True) -> str:
    own = [*columns, "extra"]
    return f"INSERT INTO {name} ({', '.join(own)}) VALUES ({', '.join(f':{c}' if named else '%s' for c in own)})"


def collection_name(hint: str | None, fingerprint: str, storage: str = "jsonb") -> str:
    """A name from a hint, or from the structure's fingerprint where the hint gives none."""
    plain = "".join(c for c in (hint or "").lower().replace(" ", "_").replace("-", "_") if c.isalnum() or c == "_")
    return plain if plain and (plain[0].isalpha() or plain[0] == "_") else f"{'table' if storage == 'sql' else 'docs'}_{fingerprint[:8]}"


def fingerprint(fields: DataFrame) -> DataFrame:
    """(fingerprint): SHA-256 of the sorted paths with their dominant types; equal structures have equal fingerprints."""
    pair = F.concat(F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(': "JsonType.'), F.upper("dominant"), F.lit('"'))
    sorted_pairs = F.transform(F.array_sort(F.collect_list(F.struct("path", pair.alias("text")))), lambda s: s["text"])
    return fields.agg(F.sha2(F.concat(F.lit("{"), F.array_join(sorted_pairs, ", "), F.lit("}")), 256).alias("fingerprint"))


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys in one notation; None if it is none."""
    try:
        return json.dumps(json.loads(text), sort_keys=True) if text is not None else None
    except (ValueError, RecursionError):
        return None


def registered(df: DataFrame, name: str, storage: str, active: bool, ident: str = "record_id", body: str = "body") -> DataFrame:
    """(id, sha256, size_bytes, uri, status): documents under the hash of their canonical text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, c.encode()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := canonical(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([hashlib.sha256(c).hexdigest() for _, c in rows], pa.string()), pa.array([len(c) for _, c in rows], pa.int64())], names=["id", "sha256", "size_bytes"])

    hashed = df.select(F.col(ident).cast("string"), F.col(body)).mapInArrow(run, "id string, sha256 string, size_bytes bigint")
    return hashed.withColumn("uri", F.concat(F.lit(f"{storage}://{name}/"), "sha256")).withColumn("status", F.lit("done" if active else "queued"))


def typed_rows(df: DataFrame, columns: DataFrame, ident: str = "record_id", body: str = "body") -> DataFrame:
    """The documents as rows of the typed table: one column per top-level field, values that cannot be cast as null."""
    kinds = {"BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE PRECISION": "double"}
    parsed = df.select(F.col(ident).alias("id"), F.from_json(body, "map<string,string>").alias("m")).filter("m IS NOT NULL")
    named = {"id"}
    out = []
    for r in columns.orderBy("path").collect():
        name = r.column if r.column not in named else r.column + "_1"
        named.add(name)
        out.append(F.col("m").getItem(r.path).try_cast(kinds.get(r.sql_type, "string")).alias(name))
    return parsed.select("id", *out)
