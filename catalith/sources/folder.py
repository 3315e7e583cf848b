"""Files of a folder tree as a source, and a blob store on any file system Spark can reach."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import mime

IGNORE_FILE = ".catalogignore"


def ignore_patterns(folder: str, name: str = IGNORE_FILE) -> list[str]:
    """The patterns of the root's ignore file; blank lines and comments aside."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip() and not line.strip().startswith("#")]


def scan(spark: SparkSession, folder: str, ignore: Sequence[str] | None = None, content: bool = False) -> DataFrame:
    """(path, relative_path, type, size_bytes[, content]): supported files below a folder that no pattern excludes.

    Contents are not read unless asked for. A missing folder or a file in its place is an error.
    """
    local = folder.removeprefix("file://")
    if "://" not in folder or folder.startswith("file://"):
        if not os.path.exists(local):
            raise FileNotFoundError(folder)
        if not os.path.isdir(local):
            raise NotADirectoryError(folder)
    patterns = list(ignore) if ignore is not None else ignore_patterns(local)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = local.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rows = files.select(plain.alias("path"), F.regexp_replace(plain, "^" + root.replace(".", r"\."), "").alias("relative_path"), mime.category(F.col("path")).alias("type"), F.col("length").alias("size_bytes"), *([F.col("content")] if content else []))
    rows = rows.filter("type IS NOT NULL")
    for p in patterns:
        rows = rows.filter(~F.col("path").rlike("^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")) & ~F.col("path").rlike("^" + fnmatch.translate(f"*{p}*").replace(r"\Z", "$").replace(r"\z", "$")))
    return rows


def statistics(files: DataFrame) -> DataFrame:
    """One row: total_files, total_size_bytes and the number of each type, zeros included."""
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), *[F.count_if(F.col("type") == t).alias(t) for t in mime.EXTENSIONS])


def raw_uri(request, part, name):
    return F.concat(F.lit("fs://incoming/"), request, F.lit("/"), part, F.lit("/"), name)


def media_uri(cluster, name):
    return F.concat(F.lit("fs://media/clusters/"), cluster, F.lit("/"), name)


def derived_uri(cluster, asset, name):
    return F.concat(F.lit("fs://media/derived/"), cluster, F.lit("/"), asset, F.lit("/"), name)


class BlobStore:
    """Contents under URIs, kept as Parquet partitioned by the first part of the URI; all sizes run as Spark jobs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, blobs: DataFrame) -> None:
        """Store (uri, content); a URI stored again has its latest content."""
        area = F.regexp_extract("uri", r"^fs://([^/]+)", 1)
        blobs.filter(F.col("uri").startswith("fs://")).select("uri", "content", F.octet_length("content").cast("bigint").alias("size_bytes"), area.alias("area"), F.current_timestamp().alias("stored_at")).write.mode("append").partitionBy("area").parquet(self.root)

    def _last(self, column: str) -> DataFrame:
        """(uri, column) of the latest entry of each URI; no other column is read."""
        rows = self.spark.read.schema("uri string, content binary, size_bytes bigint, stored_at timestamp, area string").parquet(self.root)
        return rows.groupBy("uri").agg(F.max_by(column, "stored_at").alias(column))

    def get(self, uris: DataFrame) -> DataFrame:
        """(uri, content, size_bytes, found) for each wanted URI; a URI of another scheme is an error."""
        if not uris.filter(~F.col("uri").startswith("fs://")).isEmpty():
            raise ValueError("only fs:// URIs can be read")
        return uris.join(self._last("content"), "uri", "left").select("uri", "content", F.octet_length("content").alias("size_bytes"), F.col("content").isNotNull().alias("found"))

    def list(self, prefix: str = "fs://") -> DataFrame:
        """(uri, size_bytes) below a prefix, from the sizes stored beside the contents, which are not read."""
        return self._last("size_bytes").filter(F.col("uri").startswith(prefix) & F.col("size_bytes").isNotNull())

    def delete(self, uris: DataFrame) -> None:
        """Forget contents: a later entry without content hides the earlier ones."""
        area = F.regexp_extract("uri", r"^fs://([^/]+)", 1)
        uris.select("uri", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("bigint").alias("size_bytes"), area.alias("area"), F.current_timestamp().alias("stored_at")).write.mode("append").partitionBy("area").parquet(self.root)
