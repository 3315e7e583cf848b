"""Functions of whole groups or sums of vectors, in Arrow batches over sorted partitions.

One Python call serves many small groups of a partition, where a grouped map would call, convert and copy per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` of the table of each group, sorted by ``order``. A group must fit a task; divide large ones by a salt
    among the keys. Column 0 of the table is a hash of the keys, the columns of ``df`` follow."""
    ordered = df.select(F.xxhash64(*keys).alias("__key"), *df.columns).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if held and key[a] != last:
                    out = function(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
        if held:
            out = function(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return ordered.mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The float32 vectors of a binary column without nulls, one per row."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 0), np.float32)


def binary(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors, np.float32)], pa.binary())


def compact(vectors: np.ndarray) -> pa.Array:
    """One byte per axis, scaled by the largest: enough for the direction of a vector."""
    top = np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-12)
    return pa.array([v.tobytes() for v in np.round(vectors / top * 127).astype(np.int8)], pa.binary())


def directions(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The unit vectors of :func:`compact`."""
    rows = column.to_pylist()
    v = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vector_sums(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec, n): the sum of the binary vectors of each key and their number. Sums are first formed inside each
    batch of the map tasks, so a key with a third of all rows is a few rows per task."""
    schema = f"{key} {dict(df.dtypes)[key]}, {vec} binary, n bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield sums(batch.column(0), matrix(batch.column(1)), np.asarray(batch.column(2).to_numpy()))

    def sums(names: pa.Array, vectors: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        codes = names.dictionary_encode()
        code = codes.indices.to_numpy()
        at = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], code[at][1:] != code[at][:-1]]))
        total = np.add.reduceat(vectors[at].astype(np.float64), starts, axis=0)
        return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(code[at][starts])), binary(total), pa.array(np.add.reduceat(n[at], starts))], names=[key, vec, "n"])

    rows = df.select(F.col(key), F.col(vec), F.lit(1).cast("bigint").alias("n")) if "n" not in df.columns else df.select(key, vec, "n")
    first = rows.mapInArrow(partial, schema)

    def final(part: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part[key].slice(0, 1).combine_chunks(), binary(matrix(part[vec]).sum(axis=0, dtype=np.float64)[None]), pa.array([int(np.sum(part["n"].to_numpy()))], pa.int64())], names=[key, vec, "n"])

    return map_groups(first, [key], [], final, schema)
