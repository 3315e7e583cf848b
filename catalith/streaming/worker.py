"""A queue of jobs as an append-only table, and workers that run its jobs in micro-batches.

Every change of a job is an event; a job's state is its last event. Jobs that fail wait, 2^(attempt - 1) seconds, and become dead letters at their last attempt. A
job that raises is a row with an error and never ends the batch; what was done is written as lineage.

Defined cases: null job ids are refused with the rows counted; a job that is enqueued again while it waits is one job; acknowledging or failing an unknown job
changes nothing; an empty queue gives no jobs and size 0; ties in order go to the smaller job id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import jobs as J

EVENTS = "job_id string, job_type string, payload string, priority int, retry_count int, max_retries int, created_at timestamp, event string, error string, ready_at timestamp, seq bigint"


class JobQueue:
    """enqueue, dequeue, ack, nack, size and close over a table of events below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.open = spark, path, True

    def _write(self, events: DataFrame) -> None:
        if not self.open:
            raise RuntimeError("the queue is closed")
        last = self.events().agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("s")).first().s
        events.withColumn("seq", F.lit(last + 1).cast("bigint")).select(*[f.split()[0] for f in EVENTS.split(", ")]).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(self.path)
        except AnalysisException:  # nothing was enqueued yet
            return self.spark.createDataFrame([], EVENTS)

    def state(self) -> DataFrame:
        """The last event of each job: one hash aggregation, combined in the map tasks."""
        columns = [f.split()[0] for f in EVENTS.split(", ")]
        last = self.events().groupBy("job_id").agg(F.max(F.struct("seq", *[c for c in columns if c not in ("seq", "job_id")])).alias("e"))
        return last.select("job_id", *[f"e.{c}" for c in columns if c != "job_id"])

    def enqueue(self, rows: DataFrame) -> int:
        """Add (job_id, job_type, payload, priority, max_retries, created_at); the number of rows refused for want of an id."""
        fresh = rows.filter("job_id IS NOT NULL").dropDuplicates(["job_id"]).join(self.state().filter("event IN ('queued', 'taken')").select("job_id"), "job_id", "left_anti")
        self._write(fresh.withColumn("retry_count", F.lit(0)).withColumn("event", F.lit("queued")).withColumn("error", F.lit(None).cast("string")).withColumn("ready_at", F.lit(None).cast("timestamp")))
        return rows.filter("job_id IS NULL").count()

    def waiting(self, now: Column) -> DataFrame:
        return self.state().filter("event = 'queued'").filter(F.col("ready_at").isNull() | (F.col("ready_at") <= now))

    def dequeue(self, now: Column, limit: int) -> DataFrame:
        """Up to ``limit`` jobs that may run: higher priority first, then older. They are taken until acknowledged or failed."""
        from catalith.session import stash

        took = stash(self.waiting(now).orderBy(F.col("priority").desc_nulls_last(), "created_at", "job_id").limit(limit), "taken")
        self._write(took.withColumn("event", F.lit("taken")))
        return took.drop("seq", "event")

    def ack(self, done: DataFrame) -> None:
        self._write(self.state().filter("event = 'taken'").join(done.select("job_id").distinct(), "job_id", "left_semi").withColumn("event", F.lit("done")))

    def nack(self, failed: DataFrame, now: Column) -> None:
        """Put jobs (job_id, error) back with their delay, or among the dead letters at the last attempt."""
        errors = failed.groupBy("job_id").agg(F.min("error").alias("why"))
        rows = self.state().filter("event = 'taken'").join(errors, "job_id").withColumn("r", J.retry_state(F.col("retry_count"), F.col("max_retries")))
        rows = rows.withColumn("retry_count", F.col("r.retry_count")).withColumn("error", F.col("why")).withColumn("event", F.when(F.col("r.dead_letter"), "dead").otherwise("queued"))
        self._write(rows.withColumn("ready_at", F.when(~F.col("r.dead_letter"), now + F.make_dt_interval(secs=F.col("r.delay_s")))))

    def size(self) -> int:
        return self.state().filter("event = 'queued'").count()

    def dead(self) -> DataFrame:
        return self.state().filter("event = 'dead'").select("job_id", "job_type", "retry_count", "error")

    def close(self) -> None:
        self.open = False


def handled(rows: DataFrame, ident: str, handler: Callable[[dict], None]) -> DataFrame:
    """(ident, success, error): ``handler`` of each row as a dictionary; a row that raises fails alone, order does not matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    handler(row)
                    out.append((row[ident], True, None))
                except Exception as e:  # noqa: BLE001 - whatever a handler raises is the row's error
                    out.append((row[ident], False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[ident, "success", "error"])

    return rows.mapInPandas(run, f"{ident} {dict(rows.dtypes)[ident]}, success boolean, error string")


def after_attempt(jobs: DataFrame, success: Column, error: Column) -> DataFrame:
    """All columns and (status, attempts, delay_s, last_error) after one attempt: done, queued again with its delay, or dead."""
    state = J.retry_state(F.col("retry_count"), F.col("max_retries"))
    good = F.coalesce(success, F.lit(False))
    return jobs.select("*", F.when(good, "done").when(state["dead_letter"], "dead").otherwise("queued").alias("status"), F.when(good, F.coalesce("retry_count", F.lit(0))).otherwise(state["retry_count"]).alias("attempts"), F.when(~good, state["delay_s"]).alias("delay_s"), F.when(~good, error).alias("last_error"))


def work(queue: JobQueue, handler: Callable[[dict], None], lineage: str, now: Column, limit: int = 1000) -> int:
    """One round of a worker: take jobs, run them, acknowledge or fail each, write a lineage row for each; the number of jobs."""
    from catalith.session import stash

    took = queue.dequeue(now, limit)
    results = stash(handled(took.select("job_id", "job_type", "payload", "retry_count"), "job_id", handler), "results")
    queue.ack(results.filter("success"))
    queue.nack(results.filter("NOT success"), now)
    rows = results.select(*J.lineage_row(F.col("job_id"), "processed", success=F.col("success"), error=F.col("error")))
    J.write_lineage(rows, lineage)
    return results.count()


def supervise(stream: DataFrame, queue: JobQueue, handler: Callable[[dict], None], lineage: str, checkpoint: str, limit: int = 1000):
    """A streaming query that enqueues each micro-batch of new jobs and works off what may run then, delayed jobs included."""

    def batch(rows: DataFrame, _: int) -> None:
        queue.enqueue(rows)
        work(queue, handler, lineage, F.current_timestamp(), limit)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
