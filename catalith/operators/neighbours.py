"""Nearest neighbours of a set of query vectors: exactly, or from an index of cells that reads only the cells next to a query.

The index is fitted on a bounded sample (:data:`SAMPLE` rows, drawn by hash of the id), every row is put into the cell of its nearest centre, and rows are stored
in partitions by cell. A search compares each query with the rows of its nearest cells; with all cells it is exact. Queries are one literal
matrix per pass of at most :data:`BLOCK`; what a task keeps is the best of each batch, and ranks are cut in the map tasks.

Defined cases: null vectors and vectors of another length than the queries are left out; similarity is the cosine, zero vectors have none; equal similarities are
ordered by id; an empty table or no query gives no rows; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE, BLOCK, MOST_CELLS, ROUNDS = 50_000, 4096, 4096, 12


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors)."""
    good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    v = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    length = np.linalg.norm(v, axis=1)
    fine = np.isfinite(length) & (length > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return good, v[fine] / length[fine, None]


def nearest(rows: DataFrame, queries: DataFrame, top: int, ident: str = "id", column: str = "embedding", cells: dict | None = None) -> DataFrame:
    """(query_id, id, similarity, place): the ``top`` rows most similar to each of ``queries`` (query_id, vector). With ``cells``, query_id -> set of cells,
    rows have a column ``cell`` and a query meets those of its cells only."""
    kinds = dict(rows.dtypes)
    key, of = kinds[ident], dict(queries.dtypes)["query_id"]
    slim = rows.select(F.col(ident).alias("id"), F.col(column).cast("array<double>").alias("v"), *([F.col("cell")] if cells is not None else [])).filter("v IS NOT NULL")
    asked = queries.filter("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = -(-asked.count() // BLOCK)
    out = slim.select(F.lit(None).cast(of).alias("query_id"), "id", F.lit(0.0).alias("similarity")).limit(0)
    for part in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        if not own:
            continue
        size = len(own[0].vector)
        own = [r for r in own if len(r.vector) == size and np.linalg.norm(r.vector) > 0]
        names = pa.array([r.query_id for r in own])
        table = np.array([r.vector for r in own])
        table = table / np.linalg.norm(table, axis=1, keepdims=True)
        wanted = None if cells is None else [cells[r.query_id] for r in own]

        def run(batches: Iterator[pa.RecordBatch], names=names, table=table, wanted=wanted, size=size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, v = _unit(batch.column(1), size)
                if not len(v):
                    continue
                ids = batch.column(0).filter(pa.array(good))
                cos = np.round(table @ v.T, 12)
                if wanted is not None:
                    at = np.asarray(batch.column(2).filter(pa.array(good)))
                    cos[~np.array([np.isin(at, list(w)) for w in wanted])] = -2
                k = min(top, cos.shape[1])
                least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
                q, r = np.nonzero((cos >= least[:, None]) & (cos > -2))  # ties of the last place are all kept
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(r)), pa.array(cos[q, r])], names=["query_id", "id", "similarity"])

        out = out.unionByName(slim.mapInArrow(run, f"query_id {of}, id {key}, similarity double"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return out.withColumn("place", place).filter(F.col("place") <= top)  # cut to so many in the map tasks


class CellIndex:
    """All vectors of a table, stored by the cell of their nearest centre."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, ident: str = "id", column: str = "embedding", cells: int | None = None) -> int:
        """Fit the centres on the sample and store every row; the number of cells. By default about as many cells as the root of the number of rows."""
        usable = rows.filter(F.col(column).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(column).cast("array<double>").alias("embedding"))
        n = usable.count()
        drawn = [r.embedding for r in usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        size = len(drawn[0]) if drawn else 0
        _, sample = _unit(pa.array(drawn, pa.list_(pa.float64())), size) if drawn else (None, np.zeros((0, 0)))
        k = max(1, min(MOST_CELLS, cells or round(n**0.5), len(sample) or 1))
        centres = sample[:k].copy()
        for _ in range(ROUNDS if len(sample) else 0):
            near = (sample @ centres.T).argmax(axis=1)
            for c in range(k):
                if (near == c).any():
                    mean = sample[near == c].mean(axis=0)
                    centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, v = _unit(batch.column(1), size)
                cell = (v @ centres.T).argmax(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32)
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(cell)], names=["id", "embedding", "cell"])

        schema = f"id {dict(usable.dtypes)['id']}, embedding array<double>, cell int"
        usable.mapInArrow(assign, schema).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        return k

    def search(self, queries: DataFrame, top: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity, place) from the ``probes`` cells nearest to each query; exact, over all cells, if None."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if probes is None:
            return nearest(rows, queries, top)
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        table = np.array([r.centre for r in centres])
        asked = queries.filter("query_id IS NOT NULL AND vector IS NOT NULL").collect()
        cells = {r.query_id: {centres[c].cell for c in np.argsort(-(table @ np.asarray(r.vector)), kind="stable")[:probes]} if len(r.vector) == table.shape[1] else set() for r in asked}
        read = sorted(set().union(*cells.values())) if cells else []
        return nearest(rows.filter(F.col("cell").isin(read)), queries, top, cells=cells)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): the share of the true neighbours that were found."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.try_divide(F.col("found"), F.col("wanted")), 4))
