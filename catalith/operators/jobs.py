"""Jobs of the ingestion pipeline: order, retries, roll-ups, batches, lineage and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.session import stash

MAX_RETRIES = 3
STATUSES = ("queued", "processing", "done", "failed")


def retry_state(retry_count: Column, max_retries: Column) -> Column:
    """What a failure does: struct(retry_count, dead_letter, delay_s). The count rises by one; below the limit the job waits
    2^(count - 1) seconds, at it the job is a dead letter."""
    count = F.coalesce(retry_count, F.lit(0)) + 1
    dead = count >= F.coalesce(max_retries, F.lit(MAX_RETRIES))
    return F.struct(count.alias("retry_count"), dead.alias("dead_letter"), F.when(~dead, F.pow(F.lit(2.0), count - 1).cast("long")).alias("delay_s"))


def retry_schedule(jobs: DataFrame) -> DataFrame:
    """(arrival_no, attempt, delay_s, due): the attempts left to each job if all fail, and seconds from now until each."""
    left = F.coalesce("max_retries", F.lit(MAX_RETRIES)) - F.coalesce("retry_count", F.lit(0))
    rows = jobs.filter(left > 1).select("arrival_no", F.coalesce("retry_count", F.lit(0)).alias("c"), F.explode(F.sequence(F.lit(1), left - 1)).alias("k"))
    delay = F.pow(F.lit(2.0), F.col("c") + F.col("k") - 1).cast("long")
    due = F.sum("delay_s").over(W.partitionBy("arrival_no").orderBy("attempt"))
    return rows.select("arrival_no", (F.col("c") + F.col("k")).alias("attempt"), delay.alias("delay_s")).withColumn("due", due)


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs that may run at ``now``, with their place: higher priority first, then older, then by arrival. The place is within
    a job type. The queue is sorted in ranges and places are counted range by range, so that no task holds all jobs of a type."""
    order = [F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_first(), F.col("arrival_no").asc_nulls_first()]
    ready = jobs.filter(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    ranges = ready.repartitionByRange("job_type", *order).sortWithinPartitions("job_type", *order)
    ranges = stash(ranges.withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(W.partitionBy("__type").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ranges.groupBy(F.col("job_type").alias("__type"), F.col("__range").alias("__of")).agg(F.count("*").alias("n")).withColumn("__before", before).drop("n")
    inside = F.row_number().over(W.partitionBy("job_type", "__range").orderBy(*order))
    placed = ranges.withColumn("__inside", inside).join(counts, F.col("job_type").eqNullSafe(F.col("__type")) & (F.col("__range") == F.col("__of")))
    return placed.withColumn("place", (F.col("__inside") + F.col("__before")).cast("int")).select(*[F.col(f"`{c}`") for c in jobs.columns], "place")


def roll_up(assets: DataFrame, key: str) -> DataFrame:
    """(key, total, queued, processing, done, failed, status) per job: done with failures is partial, queued with anything in
    work is processing."""
    counts = assets.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    state = F.when(F.col("done") + F.col("failed") == F.col("total"), F.when(F.col("failed") == 0, "done").when(F.col("done") == 0, "failed").otherwise("partial")).when((F.col("processing") > 0) | (F.col("done") + F.col("failed") > 0), "processing").otherwise("queued")
    return counts.withColumn("status", state)


def progress(processed: Column, total: Column) -> Column:
    """Percent done to two places, 0 where there is nothing to do."""
    return F.when(total > 0, F.round(processed * 100.0 / total, 2)).otherwise(0.0)


def new_requests(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose request is not known yet."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def lineage_row(request_id: Column, stage: str, asset_id: Column | None = None, success: Column | None = None, error: Column | None = None, detail: Column | None = None) -> list[Column]:
    """The columns of a lineage entry."""
    none = F.lit(None).cast("string")
    return [request_id.alias("request_id"), (asset_id if asset_id is not None else none).alias("asset_id"), F.lit(stage).alias("stage"), (detail if detail is not None else none).alias("detail"), (success if success is not None else F.lit(True)).alias("success"), (error if error is not None else none).alias("error_message"), F.current_timestamp().alias("created_at")]


def write_lineage(rows: DataFrame, path: str) -> None:
    """Append lineage entries to a table partitioned by stage."""
    rows.write.mode("append").partitionBy("stage").parquet(path)


def lineage(spark: SparkSession, path: str, request_id: str | None = None) -> DataFrame:
    """The lineage written so far, of one request or all; only wanted stages and columns are read."""
    rows = spark.read.schema("request_id string, asset_id string, detail string, success boolean, error_message string, created_at timestamp, stage string").parquet(path)
    return rows if request_id is None else rows.filter(F.col("request_id") == request_id)


def stage_counts(rows: DataFrame) -> DataFrame:
    """(stage, entries, succeeded, failed, requests): how lineage entries are spread over the stages."""
    return rows.groupBy("stage").agg(F.count("*").alias("entries"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.countDistinct("request_id").alias("requests"))


def newest(rows: DataFrame, limit: int = 100, owner: str | None = None, ident: str = "id") -> DataFrame:
    """The newest rows first, at most 100. An owner is looked for among those only: the limit comes before the filter."""
    first = rows.orderBy(F.col("created_at").desc_nulls_last(), ident).limit(min(limit, 100))
    return first if owner is None else first.filter(F.col("owner") == owner)


def batches(assets: DataFrame) -> DataFrame:
    """(batch_no, created_at, owner, total, processed, percent): what is known of each batch; its owner is that of its first asset."""
    done = F.count_if(F.col("status").isin("done", "failed"))
    rows = assets.groupBy("batch_no").agg(F.min("created_at").alias("created_at"), F.min_by("owner", "ingest_no").alias("owner"), F.count("*").alias("total"), done.alias("processed"))
    return rows.withColumn("percent", progress(F.col("processed"), F.col("total")))


def schema_counts(schemas: DataFrame, assets: DataFrame, key: str = "schema_name") -> DataFrame:
    """(key, status, assets): every schema with the number of its assets, none included, in one join."""
    own = assets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("assets"))
    return schemas.select(key, "status").join(own, key, "left").withColumn("assets", F.coalesce("assets", F.lit(0)))


class DeadLetters:
    """Dead letters as a table partitioned by job type."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, jobs: DataFrame, error: Column) -> None:
        jobs.select("job_id", "job_type", F.to_json(F.struct(*[c for c in jobs.columns])).alias("message"), error.alias("error"), F.current_timestamp().alias("dead_at"), F.lit(False).alias("removed")).write.mode("append").partitionBy("job_type").parquet(self.path)

    def list(self, job_type: str | None = None, limit: int | None = None) -> DataFrame:
        """Newest first; an entry that was removed later is left out."""
        rows = self.spark.read.schema("job_id string, message string, error string, dead_at timestamp, removed boolean, job_type string").parquet(self.path)
        rows = rows if job_type is None else rows.filter(F.col("job_type") == job_type)
        last = rows.withColumn("place", F.row_number().over(W.partitionBy("job_id").orderBy(F.col("dead_at").desc(), F.col("removed").desc()))).filter("place = 1 AND NOT removed").drop("place", "removed")
        last = last.orderBy(F.col("dead_at").desc(), "job_id")
        return last if limit is None else last.limit(limit)

    def get(self, job_id: str):
        return self.list().filter(F.col("job_id") == job_id).first()

    def remove(self, job_id: str) -> None:
        self.list().filter(F.col("job_id") == job_id).select("job_id", "job_type", "message", "error", F.current_timestamp().alias("dead_at"), F.lit(True).alias("removed")).write.mode("append").partitionBy("job_type").parquet(self.path)

    def count(self) -> int:
        return self.list().count()


def decide_schema(schemas: DataFrame, name: str, approve: bool, reason: str = "") -> DataFrame:
    """The schemas after approving or rejecting one that is provisional; anything else is an error."""
    row = schemas.filter(F.col("name") == name).select("status").first()
    if row is None or row.status != "provisional":
        raise ValueError("only a provisional schema can be approved or rejected")
    here = F.col("name") == name
    out = schemas.withColumn("status", F.when(here, "active" if approve else "rejected").otherwise(F.col("status")))
    return out if approve else out.withColumn("decision_reason", F.when(here, F.concat_ws("; ", "decision_reason", F.lit(f"rejected: {reason}"))).otherwise(F.col("decision_reason")))


def approve_schema(schemas: DataFrame, assets: DataFrame, name: str, run: Callable[[str], None], ddl: str, approve: bool = True, reason: str = "") -> tuple[DataFrame, DataFrame]:
    """(schemas, assets) after the decision: approving runs the DDL through ``run`` and moves queued assets of the schema to processing; rejecting moves
    them to failed. A DDL that fails leaves everything as it was."""
    decided = decide_schema(schemas, name, approve, reason)
    if approve:
        run(ddl)
    waiting = (F.col("schema_name") == name) & (F.col("status") == "queued")
    return decided, assets.withColumn("status", F.when(waiting, "processing" if approve else "failed").otherwise(F.col("status")))


def registered_schemas(known: DataFrame, found: DataFrame, active: bool = False) -> DataFrame:
    """``known`` and those of ``found`` whose structure_hash is new, as provisional (or active) schemas."""
    fresh = found.dropDuplicates(["structure_hash"]).join(known.select("structure_hash"), "structure_hash", "left_anti").withColumn("status", F.lit("active" if active else "provisional"))
    return known.unionByName(fresh, allowMissingColumns=True)
