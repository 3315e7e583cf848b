"""Streams of messages: first copies within a watermark, and retries with backoff kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from catalith.operators.jobs import MAX_RETRIES

RETRY_SCHEMA = "job_id string, status string, attempts int, delay_s bigint"


def first_copies(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """One row per key among those that arrive within ``late`` of each other."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def retries(stream: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(job_id, status, attempts, delay_s) from (job_id, ok): every outcome of a job changes its state to done, retrying with a
    delay of 2^(attempts - 1) seconds, or dead after ``max_retries`` failures. State is one small row per open job."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        status, delay = "retrying", 0
        for f in frames:
            for ok in f.ok:
                if status == "done":
                    continue
                if ok:
                    status, delay = "done", 0
                else:
                    attempts += 1
                    status, delay = ("dead", 0) if attempts >= max_retries else ("retrying", 2 ** (attempts - 1))
        if status == "retrying":
            state.update((attempts,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "delay_s": [delay]})

    return stream.groupBy("job_id").applyInPandasWithState(step, RETRY_SCHEMA, "attempts int", "update", GroupStateTimeout.NoTimeout)
