"""From uploads to catalog rows: validation, JSON and file ingest, documents and media, each as composed DataFrames.

A failing row is a row with an error, never a failing job; every step can be written as lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions import mime
from catalith.operators import chunks, clusters, hashes, media, profile
from catalith.session import stash
from catalith.sources.folder import raw_uri

SAMPLE = 128


def validated_files(files: DataFrame) -> DataFrame:
    """(path, content_type, kind, size_bytes, sha256, error, status_code) from (path, content[, declared]): the declared type
    goes before the detected one; a size error is 413, any other 400."""
    declared = F.col("declared") if "declared" in files.columns else F.lit(None).cast("string")
    kind = F.coalesce(F.when(F.trim(declared) != "", F.lower(F.trim(declared))), mime.sniffed(F.col("content"), F.col("path")))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    rows = files.select("path", kind.alias("content_type"), size.alias("size_bytes"), F.sha2("content", 256).alias("sha256")).withColumn("kind", mime.kind_of(F.col("content_type")))
    group = mime.group_of(F.col("content_type"))
    error = F.when(F.col("size_bytes") == 0, "empty file").when(group.isNull(), F.concat(F.lit("unsupported type "), "content_type")).when(F.col("size_bytes") > mime.size_limit(group), F.concat(F.lit("larger than "), mime.size_limit(group).cast("string"), F.lit(" bytes")))
    return rows.withColumn("error", error).withColumn("status_code", F.when(F.col("error").startswith("larger"), 413).when(F.col("error").isNotNull(), 400))


def request_errors(rows: DataFrame, request: str) -> DataFrame:
    """(request, errors, status_code): requests with errors; 413 if one is about size, else 400."""
    bad = rows.filter("error IS NOT NULL").groupBy(request).agg(F.array_sort(F.collect_set("error")).alias("errors"), F.max("status_code").alias("status_code"))
    return bad


def json_payloads(df: DataFrame, ident: str = "record_id", body: str = "body") -> DataFrame:
    """(id, doc_no, doc): an object is one document, an array one per element; anything else none."""
    v = F.try_parse_json(body)
    one = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(F.col(body)))
    many = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
    return df.select(F.col(ident).alias("id"), F.posexplode(F.coalesce(one, many)).alias("doc_no", "doc"))


def sampled(df: DataFrame, body: str = "body", limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` documents, always the same ones: those of the smallest hashes."""
    return df.orderBy(F.xxhash64(body), body).limit(limit)


def ingest_json(docs: DataFrame, known: DataFrame, hint: str | None = None, active: bool = False, ident: str = "record_id", body: str = "body") -> dict[str, DataFrame]:
    """Profile a sample of :data:`SAMPLE` documents, decide, register all: {decision, schemas, assets}. ``known``: (name, structure_hash, status). Only the decision, one
    row, comes to the driver."""
    fields = stash(profile.field_statistics(profile.paths(sampled(docs, body), ident, body)), "fields")
    decision = profile.decision(profile.summary(fields)).crossJoin(profile.fingerprint(fields))  # one row each
    row = decision.first()
    name = profile.collection_name(hint, row.fingerprint, row.storage)
    found = docs.sparkSession.createDataFrame([(name, row.fingerprint, row.storage, profile.rationale(row))], "name string, structure_hash string, storage string, decision_reason string")
    fresh = found.join(known.select("structure_hash"), "structure_hash", "left_anti").withColumn("status", F.lit("active" if active else "provisional"))
    schemas = known.unionByName(fresh, allowMissingColumns=True)
    return {"decision": decision, "schemas": schemas, "assets": profile.registered(docs, name, row.storage, active, ident, body), "columns": profile.table_columns(fields)}


def ingest_files(files: DataFrame, request: Column, part: Column) -> DataFrame:
    """(raw_uri, kind, content_type, size_bytes, sha256, status, error): assets of uploaded files, one per file."""
    named = files.withColumn("__request", request).withColumn("__part", part)
    checked = validated_files(named).join(named.select("path", "__request", "__part"), "path")
    return checked.select(raw_uri(F.col("__request"), F.col("__part"), F.regexp_extract("path", r"[^/]*$", 0)).alias("raw_uri"), "kind", "content_type", "size_bytes", "sha256", F.when(F.col("error").isNull(), "queued").otherwise("failed").alias("status"), "error")


def ingest_documents(files: DataFrame, embedder: media.Embedder | None = None) -> dict[str, DataFrame]:
    """{chunks, media, failures} from (path, content): parsed, split, embedded; embedded pictures as child rows."""
    parsed = chunks.elements(files)
    pieces = chunks.assembled(parsed.filter("error IS NULL").withColumnRenamed("path", "asset_id"))
    embedded = media.embed(pieces, "text", embedder or media.HashingEmbedder(768))

    def children(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n, i, b) for p, c in zip(f.path, f.content, strict=True) for i, (n, b) in enumerate(chunks.embedded_media(c))]
            yield pd.DataFrame(rows, columns=["parent", "name", "place", "content"])

    kids = files.select("path", "content").mapInPandas(children, "parent string, name string, place int, content binary")
    return {"chunks": embedded, "media": kids, "failures": parsed.filter("error IS NOT NULL").select("path", "error")}


def replaced_chunks(stored: DataFrame, fresh: DataFrame, key: str = "asset_id") -> DataFrame:
    """The chunks after those of re-processed documents gave way to the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def ingest_media(fresh: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """(id, duplicate_of, cluster_id, status) for new media (id, sha256, perceptual_hash, embedding): exact duplicates first, then
    near ones among the stored (id, sha256, perceptual_hash, cluster_id, status, created_at); a duplicate takes over the cluster of
    its original, the others get the best cluster. A medium with several hashes has a row for each on either side."""
    done = stored.filter("status = 'done'")
    first_of = F.min(F.struct("created_at", F.col("id").alias("first"))).alias("o")
    exact = fresh.select("id", "sha256").distinct().join(done.filter("sha256 IS NOT NULL").groupBy("sha256").agg(first_of), "sha256").groupBy("id").agg(F.min("o").alias("o"))
    rest = fresh.join(exact, "id", "left_anti").select("id", hashes.hash_value(F.col("perceptual_hash")).alias("a")).filter("a IS NOT NULL").distinct()
    old = done.select("id", "created_at", hashes.hash_value(F.col("perceptual_hash")).alias("b")).filter("b IS NOT NULL")
    values = rest.select(F.col("a").alias("value")).unionByName(old.select(F.col("b").alias("value"))).distinct()
    pairs = hashes.near_values(values).select("a", "b").unionByName(values.select(F.col("value").alias("a"), F.col("value").alias("b")))
    origin = old.groupBy("b").agg(first_of)
    near = rest.join(pairs.join(origin, "b").groupBy("a").agg(F.min("o").alias("o")), "a").groupBy("id").agg(F.min("o").alias("o"))
    owned = stored.select(F.col("id").alias("first"), F.col("cluster_id").alias("old_cluster")).distinct()
    dup = exact.unionByName(near).select("id", F.col("o.first").alias("first")).join(owned, "first")
    one = fresh.select("id", "embedding").dropDuplicates(["id"])
    best = clusters.assign_best(one, known).select("id", "cluster_id")
    rows = one.select("id").join(dup, "id", "left").join(best, "id", "left")
    return rows.select("id", F.col("first").alias("duplicate_of"), F.when(F.col("first").isNotNull(), F.col("old_cluster")).otherwise(F.col("cluster_id")).alias("cluster_id"), F.lit("done").alias("status"))


def unique_names(df: DataFrame, ident: str, name: str) -> DataFrame:
    """(ident, unique_name): equal names get _1, _2, … in order of the ids; a missing name is Cluster and the id's first eight characters."""
    base = F.coalesce(F.when(F.trim(name) != "", F.col(name)), F.concat(F.lit("Cluster "), F.substring(F.col(ident).cast("string"), 1, 8)))
    place = F.row_number().over(W.partitionBy("__base").orderBy(ident)) - 1
    return df.select(ident, base.alias("__base")).withColumn("k", place).select(ident, F.when(F.col("k") > 0, F.concat("__base", F.lit("_"), "k")).otherwise(F.col("__base")).alias("unique_name"))


def labelled_clusters(members: DataFrame, labeller=None, shown: int = 5) -> DataFrame:
    """(cluster_id, label) from (cluster_id, id, tags): a labeller sees up to five members of each cluster; the default names the two most frequent tags."""

    def default(frame: pd.DataFrame) -> str:
        tags = pd.Series([t for ts in frame.tags if ts is not None for t in ts if t])
        top = sorted(tags.value_counts().items(), key=lambda kv: (-kv[1], kv[0]))[:2]
        return " ".join(t for t, _ in top) or "Mixed Content"

    call = labeller or default
    first = members.withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy("id"))).filter(F.col("place") <= shown).drop("place")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            label = call(frame)
        except Exception:  # noqa: BLE001 - a labeller that fails must not end the job
            label = default(frame)
        return pd.DataFrame({"cluster_id": [frame.cluster_id.iloc[0]], "label": [label]})

    return first.groupBy("cluster_id").applyInPandas(run, "cluster_id string, label string")


def facets(assets: DataFrame) -> DataFrame:
    """(kind, month, size_class, assets): counts by month and size."""
    size = F.when(F.col("size_bytes").isNull(), "unknown").when(F.col("size_bytes") < 100_000, "small").when(F.col("size_bytes") < 1_000_000, "medium").otherwise("large")
    return assets.groupBy("kind", F.date_format("created_at", "yyyy-MM").alias("month"), size.alias("size_class")).agg(F.count("*").alias("assets"))
