"""Laying texts into containers of fixed capacity along a space-filling curve.

Every text is a point: its hashed token vector projected to three dimensions, each divided into 64 steps of equally
many texts. Its position along the Hilbert curve through these cells is its key. Texts are range-sorted by that key,
so each task holds a stretch of the curve with neighbouring, similar texts; equal keys are divided by doc_id, so
copies that make up a third of all rows spread over tasks. A task packs a stretch of its curve at a time, largest text first into the
fullest container that still takes it; containers that stay emptier than :data:`FULL` are emptied again into
the next stretch, so only the last stretch of a task leaves some room. Texts longer than the capacity are
cut into full containers and a remainder that is packed like a text; nothing else is cut.

Defined cases: null and empty texts have no token and no place; repeated texts are texts of their own; a capacity below 1 or
null is no container; every token of every text is in exactly one container of each capacity.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.tokens import AXES, RANKS, counted
from catalith.session import stash

#: Bits of each axis, tokens of a task's stretch of the curve, capacities of one packing step, and the fill from which a container is closed.
BITS, TASK_TOKENS, STEP, FULL = 6, 8_000_000, 64, 0.995
#: Most tasks that the curve is cut for, whatever its length, and most kinds of containers.
MOST_TASKS, MOST_KINDS = 20_000, 10_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer cells, after Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def best_fit(items: list[tuple], capacity: int) -> list[list[tuple]]:
    """Containers of items (last field: size), largest first, each into the fullest container that takes it."""
    bins: list[list[tuple]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for item in sorted(items, key=lambda t: (-t[-1], t)):
        k = bisect.bisect_left(room, (item[-1], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(item)
        else:
            left, b = capacity, len(bins)
            bins.append([item])
        if left > item[-1]:
            bisect.insort(room, (left - item[-1], b))
    return bins


class Packer:
    """Containers of one capacity, filled along the curve; holds no more than a step's items."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pool: list[tuple[int, int, int, int]] = []
        self.held = 0

    def add(self, doc: int, size: int) -> Iterator[list[tuple[int, int, int, int]]]:
        """The containers that are closed, as lists of (doc_id, piece_no, first_token, n_tokens)."""
        start, piece, capacity = 0, 0, self.capacity
        while size - start > capacity:
            yield [(doc, piece, start, capacity)]
            start, piece = start + capacity, piece + 1
        self.pool.append((doc, piece, start, size - start))
        self.held += size - start
        if self.held >= STEP * capacity:
            rest = []
            for b in best_fit(self.pool, capacity):
                if sum(t[-1] for t in b) >= FULL * capacity:
                    yield b
                else:
                    rest += b
            self.held = sum(t[-1] for t in rest)
            if self.held >= STEP * capacity // 2:  # sizes that do not combine: they are closed as they are
                yield from best_fit(rest, capacity)
                rest, self.held = [], 0
            self.pool = rest

    def finish(self) -> Iterator[list[tuple[int, int, int, int]]]:
        yield from best_fit(self.pool, self.capacity)
        self.pool, self.held = [], 0


def pack(items: Iterator[tuple[int, int]], capacity: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Containers of (doc_id, n_tokens) along the curve."""
    packer = Packer(capacity)
    for doc, size in items:
        yield from packer.add(doc, size)
    yield from packer.finish()


def layout(documents: DataFrame, specs: DataFrame, ranks: str = RANKS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(spec_name, container, doc_id, piece_no, first_token, n_tokens): the place of every text, for every capacity."""
    rows = stash(counted(documents.filter("doc_id IS NOT NULL").select("doc_id", "text"), ["doc_id"], ranks, coordinates=True).drop("text_key").filter("n_tokens > 0"), "points")
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    axes = [f"x{i}" for i in range(AXES)]
    about = rows.agg(F.sum("n_tokens").alias("n"), *[F.percentile_approx(a, steps, 2000).alias(a) for a in axes]).first()
    edges = [np.asarray(about[a] or [0.0], np.float64) for a in axes]
    tasks = min(MOST_TASKS, max(1, -(-(about["n"] or 0) // task_tokens)))
    capacities = [(r.spec_name, int(r.capacity_tokens)) for r in specs.filter("spec_name IS NOT NULL AND capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().limit(MOST_KINDS + 1).collect()]
    if len(capacities) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([np.minimum(np.searchsorted(e, batch.column(2 + i).to_numpy().astype(np.float64), side="right"), (1 << BITS) - 1) for i, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells))], names=["doc_id", "n_tokens", "key"])

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["spec_name", "container", "doc_id", "piece_no", "first_token", "n_tokens"]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        packers = [(spec, Packer(capacity)) for spec, capacity in capacities]
        number, out = [0] * len(packers), []

        def closed(i: int, bins: Iterator[list[tuple]]) -> None:
            for b in bins:
                out.extend((packers[i][0], f"{part}-{number[i]}", *item) for item in b)
                number[i] += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for rows in batches:  # every kind of container is filled in the same pass, so a task's stretch may be of any length
            for doc, size in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                for i, (_, packer) in enumerate(packers):
                    closed(i, packer.add(doc, size))
                if len(out) >= 50_000:
                    yield batch()
        for i, (_, packer) in enumerate(packers):
            closed(i, packer.finish())
        if out:
            yield batch()

    placed = rows.select("doc_id", "n_tokens", *axes).mapInArrow(keys, "doc_id bigint, n_tokens bigint, key bigint")
    along = placed.repartitionByRange(int(tasks), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return along.mapInArrow(containers, "spec_name string, container string, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint")


def fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, capacity_tokens, containers, tokens, filled): how much of the containers is used."""
    own = placed.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("n")).groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return specs.select("spec_name", "capacity_tokens").distinct().join(own, "spec_name").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
