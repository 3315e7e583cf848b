"""Implausible readings of sensors: out of range, spikes, stuck stretches.

What the readings of a sensor deviate from its level around them forms a matrix of daily profiles (shorter periods where there are few
days): one row per period, one column per slot of it, the median of the slot's readings in each entry. Robust principal components by
alternating projections separate it into low-rank normal behaviour and sparse deviations. What a reading has beyond level and
low-rank part is its residual, and the residual alone is tested: a spike is a residual of at least :data:`SPIKE` times the sensor's usual
one, in at most :data:`SPIKE_LENGTH` readings, where the readings without their low-rank part return to the level before.
Constant runs and ranges are tested separately.

A sensor with at most :data:`PIECE` readings is one group of a task. A larger one is cut into pieces of consecutive readings with a
margin on either side, so a sensor with a third of all rows is many tasks. Pieces and whole sensors go through the same functions:
slot medians, counts of residuals by size (:func:`sizes`), of changes and of units are formed piece by piece and added up by sensor,
and the profile matrix, whose size depends on days and slots and not on the number of readings, is decomposed once per sensor. A
sensor therefore gets the same answer whether it is cut or not. The cuts follow from counts per (sensor, block of hours), a small table.

Defined cases: null readings and readings without a legible timestamp are no cases and interrupt nothing; readings
delivered again under the same id count once; a missing unit is the one most readings of the sensor have; readings of
an unknown unit have no range; equal timestamps are ordered by reading id; not-a-number and infinite readings are
out of range and belong to no level.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions.grouped import map_groups
from catalith.session import stash

#: Times the usual scatter at which a reading is a spike.
SPIKE = 10.0
#: Most consecutive readings of a spike.
SPIKE_LENGTH = 3
#: Least consecutive equal readings of a stuck stretch.
STUCK = 12
#: Readings of a piece, of its margins, and hours of a time block.
PIECE, MARGIN, BLOCK_HOURS = 100_000, 64, 6
#: The unit of sensors that rest at a value; for them values up to RESTING are usual.
RESTING_UNIT, RESTING = "count", 10.0
_HALF = 7  # half of the window of a level
DAY = 86_400_000_000
#: Slots that a period may have; each divides every period and block into whole slots.
SLOTS = (8, 12, 16, 24, 32, 36, 48, 72, 96, 144, 288)
#: Rows that a profile matrix should have at least, and ratio of neighbouring sizes in the counts of residuals.
ROWS, RATIO = 8, 1.01


def instant(text: Column) -> Column:
    """Microseconds since 1970 of a timestamp text: ISO date and time with ``T`` or blank, with an offset or, without
    one, in UTC; or seconds, milliseconds or microseconds as digits. Null where it is none of these."""
    plain = F.trim(text)
    number = F.try_to_number(plain, F.lit("9" * 18)).cast("long")
    digits = F.when(F.length(plain) >= 15, number).when(F.length(plain) >= 12, number * 1000).otherwise(number * 1_000_000)
    zoned = F.regexp_replace(plain, r"([+-]\d\d)(\d\d)$", "$1:$2")
    zoned = F.when(zoned.rlike(r":\d\d.*([zZ]|[+-]\d\d:\d\d)$"), zoned).otherwise(F.concat(zoned, F.lit("Z")))
    return F.when(plain.rlike(r"^-?\d{9,17}$"), digits).when(plain.rlike(r"^\d{4}-\d\d-\d\d[T ]\d"), F.unix_micros(zoned.try_cast("timestamp")))


def _middle(x: np.ndarray) -> float:
    """The (upper) median of finite values."""
    return float(np.partition(x, len(x) // 2)[len(x) // 2])


def _row_medians(rows: np.ndarray) -> np.ndarray:
    """The median of each row without its gaps (nan); nan for a row of gaps."""
    rows = np.sort(rows, axis=1)  # gaps come last
    n = (rows == rows).sum(axis=1)
    at = np.arange(len(rows))
    return np.where(n > 0, (rows[at, np.maximum(n - 1, 0) // 2] + rows[at, np.minimum(n // 2, np.maximum(n - 1, 0))]) / 2, np.nan)


def low_rank(matrix: np.ndarray, rank: int = 2, rounds: int = 8) -> np.ndarray:
    """The low-rank part of a matrix with sparse gross errors and gaps (nan), by alternating projections: entries
    that deviate by more than a falling multiple of the scatter are set aside, the rest is projected onto the
    leading components. Sets no entry aside because of others in its row, so a spike does not bend the profile."""
    known = np.isfinite(matrix)
    row = _row_medians(np.where(known, matrix, np.nan))
    row = np.where(np.isfinite(row), row, np.nanmedian(row) if np.isfinite(row).any() else 0.0)
    # What comes again in a slot from period to period is no error: the profile starts from the medians of rows and columns.
    column = _row_medians(np.where(known, matrix - row[:, None], np.nan).T)
    low = row[:, None] + np.where(np.isfinite(column), column, 0.0)[None]
    filled = np.where(known, matrix, 0.0)
    if not known.any():
        return low
    lead = np.cos(np.arange(1, rank + 1)[:, None] * np.arange(len(matrix))[None] + 1.0)  # any start that no component is orthogonal to
    for k in range(rounds):
        off = np.where(known, filled - low, 0.0)
        size = np.abs(off)
        scale = 1.4826 * _middle(size[known])
        if scale == 0.0:
            break
        off[size > max(5.0 - 0.5 * k, 3.5) * scale] = 0.0
        clean = off + low
        centre = clean.sum(axis=1, keepdims=True) / clean.shape[1]
        rest = clean - centre
        for _ in range(2):  # the components of the round before are close already
            lead = (lead @ rest) @ rest.T
            for i, v in enumerate(lead):
                v -= (lead[:i] @ v) @ lead[:i]
                v /= max(float(np.sqrt(v @ v)), 1e-300)
        last, low = low, centre + lead.T @ (lead @ rest)
        if k and np.abs(low - last).max() < 0.02 * scale:
            break
    return low


def rolling_median(x: np.ndarray, half: int = _HALF) -> np.ndarray:
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    if len(x) <= 2 * half or not np.isfinite(x).all():
        return _row_medians(np.where(np.isfinite(view), view, np.nan))
    out = np.empty(len(x))
    out[half:-half] = np.partition(view[half:-half], half, axis=1)[:, half]
    out[:half], out[-half:] = _row_medians(view[:half]), _row_medians(view[-half:])
    return out


def sizes(deviations: np.ndarray) -> Counter:
    """How many deviations have which size, in steps of :data:`RATIO`; zero has a step of its own."""
    d = np.abs(deviations[np.isfinite(deviations)])
    step = np.full(len(d), -(10**6))
    step[d > 0] = np.floor(np.log(np.maximum(d[d > 0], 1e-300)) / np.log(RATIO)).astype(np.int64)
    return Counter(dict(zip(*(a.tolist() for a in np.unique(step, return_counts=True)), strict=True)))


def scatter(counts: Counter) -> float:
    """Robust standard deviation of deviations counted by :func:`sizes`; where most are equal, from the mean of all but the largest."""
    if not counts:
        return 0.0
    step = np.array(sorted(counts))
    n = np.array([counts[s] for s in step])
    value = np.where(step > -(10**6), RATIO ** (np.maximum(step, -60_000) + 0.5), 0.0)
    upto = n.cumsum()
    most = max(1, int(0.9 * upto[-1]))
    used = np.clip(most - (upto - n), 0, n)
    return max(1.4826 * float(value[np.searchsorted(upto, upto[-1] // 2, side="right")]), 1.2533 * float((used * value).sum() / most) * 1.2)


def grid(first: int, last: int, n: int) -> tuple[int, int]:
    """(period, slots) of the profile matrix of a sensor with ``n`` readings between two instants: a day, or its halves, quarters and so on while
    there are fewer than :data:`ROWS` periods, in slots of about one reading or more."""
    gap = max((last - first) / max(n - 1, 1), 1.0)
    period = DAY
    while period % 2 == 0 and period > 16 * gap and (last - first) / period < ROWS:
        period //= 2
    return period, max((s for s in SLOTS if period / s >= 0.98 * gap), default=SLOTS[0])


def slot_medians(t: np.ndarray, x: np.ndarray, period: int, slots: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(slot numbers, medians of the usable readings in each, sum of places in their slots from 0 to 1, readings)."""
    known = np.isfinite(x)
    t, x = t[known], x[known]
    width = period // slots
    slot = t // width
    edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(t) else np.zeros(1, np.int64)
    length = np.diff(edge)
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0), 0.0, 0
    order = np.lexsort((x, slot))
    s, start = x[order], edge[:-1]
    return slot[start], (s[start + (length - 1) // 2] + s[start + length // 2]) / 2, float(((t % width) / width).sum()), len(t)


def profile(slot: np.ndarray, median: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot numbers, low-rank part of the profile matrix in each): periods without any reading are left out."""
    rows, row = np.unique(slot // slots, return_inverse=True)
    matrix = np.full((len(rows), slots), np.nan)
    matrix[row, slot % slots] = median
    low = low_rank(matrix, 2 if len(rows) >= 12 else 1)
    return (rows[:, None] * slots + np.arange(slots)[None]).ravel(), low.ravel()


def profile_residual(t: np.ndarray, deviation: np.ndarray, slot: np.ndarray, low: np.ndarray, width: int, phase: float) -> np.ndarray:
    """What is left of the deviations without the low-rank part of their profile, which is taken to hold where readings lie in a slot and
    to be linear between."""
    return deviation - np.interp(t.astype(np.float64), (slot + phase) * float(width), low) if len(slot) else deviation.copy()


def runs(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(in a run of STUCK or more equal readings, core readings outside of such, runs that start in them)."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(x)]]))
    long = np.repeat(lengths >= STUCK, lengths)
    return long, int((core & ~long).sum()), int((core[starts] & (lengths < STUCK)).sum()) if len(starts) else 0


def spikes(x: np.ndarray, residual: np.ndarray, deviation: np.ndarray, usual: float, resting: bool) -> np.ndarray:
    """Which readings have residuals beyond the usual one, in groups of at most SPIKE_LENGTH from which the readings return to their level."""
    hit = np.zeros(len(x), bool)
    finite = np.isfinite(x)
    if resting:
        usual = max(usual, 1.0)
    if usual <= 0:
        return hit
    level = x - deviation + residual  # the readings without the low-rank part of their profile
    off = ~(np.abs(residual) < 0.6 * SPIKE * usual)
    edge = np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))
    calm = np.flatnonzero(~off)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a > SPIKE_LENGTH:
            continue
        i, j = np.searchsorted(calm, (a, b))
        levels = [float(np.median(level[side])) for side in (calm[max(i - 6, 0) : i], calm[j : j + 6]) if len(side)]
        if not levels:
            continue
        for k in range(a, b):
            if finite[k] and not (resting and x[k] <= RESTING):
                far = min(abs(level[k] - v) for v in levels)
                hit[k] = far >= SPIKE * usual and max(levels) - min(levels) <= 0.5 * far
    return hit


class Piece:
    """Consecutive readings of one sensor: times, values, whether they are the piece's own, and the bounds of their unit."""

    def __init__(self, ids: np.ndarray, t: np.ndarray, x: np.ndarray, core: np.ndarray, code: np.ndarray, units: list[tuple[float, float, bool]], span: tuple[int, int, int]):
        self.ids, self.t, self.x, self.core, self.code, self.units = ids, t, x, core, code, units
        self.period, self.slots = grid(*span)
        self.long, self.others, self.changes = runs(x, core)
        self.known: tuple | None = None

    def unit_counts(self) -> Counter:
        own = self.code[self.core & (self.code >= 0)]
        return Counter({self.units[k]: n for k, n in enumerate(np.bincount(own, minlength=len(self.units)).tolist()) if n})

    def judged(self, counts: Counter) -> tuple[np.ndarray, bool, np.ndarray]:
        """(out of range or not finite, whether the sensor rests, deviation from the level, the median of the readings around): a missing
        unit is the most frequent of ``counts``, those of the sensor."""
        if self.known is None:
            usual = max(counts, key=lambda u: (counts[u], u)) if counts else (-np.inf, np.inf, False)
            table = np.array([*[u[:2] for u in self.units], usual[:2]], float)
            low, high = table[self.code].T
            finite = np.isfinite(self.x)
            outside = ~finite | (self.x < low) | (self.x > high)
            usable = self.x if not outside.any() else np.where(outside, np.nan, self.x)
            resting = sum(n for u, n in counts.items() if u[2]) * 2 > sum(counts.values())
            self.known = outside, resting, np.where(finite, self.x, np.nan) - rolling_median(usable)
        return self.known

    def statistics(self, counts: Counter) -> tuple:
        """What the sensor as a whole needs of this piece."""
        outside, _, deviation = self.judged(counts)
        usable = self.core & ~outside
        return (*slot_medians(self.t[usable], deviation[usable], self.period, self.slots), self.others, self.changes)

    def residuals(self, counts: Counter, slot: np.ndarray, low: np.ndarray, phase: float) -> tuple[np.ndarray, Counter]:
        """(residual, counts of the residuals by size)."""
        outside, _, deviation = self.judged(counts)
        residual = profile_residual(self.t, deviation, slot, low, self.period // self.slots, phase)
        return residual, sizes(residual[self.core & ~outside])

    def kinds(self, counts: Counter, residual: np.ndarray, usual: float, changing: bool) -> np.ndarray:
        """0 (no case) or 1 (range), 2 (spike), 3 (stuck)."""
        outside, resting, deviation = self.judged(counts)
        kind = np.where(spikes(self.x, residual, deviation, usual, resting), np.int8(2), np.int8(0))
        if changing and not resting:
            kind[self.long] = 3
        kind[outside] = 1
        return kind


def sensor_profile(statistics: list[tuple], slots: int) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(slot numbers, low-rank part, place of readings in their slot, whether readings usually change) from the statistics of all pieces."""
    slot, median = (np.concatenate([s[i] for s in statistics]) for i in (0, 1))
    n = sum(s[3] for s in statistics)
    others, changes = sum(s[4] for s in statistics), sum(s[5] for s in statistics)
    low = profile(slot, median, slots) if n else (np.zeros(0, np.int64), np.zeros(0))
    return (*low, sum(s[2] for s in statistics) / n if n else 0.5, others <= 1 or changes > 0.5 * others)


def whole(piece: Piece) -> np.ndarray:
    """The kinds of the readings of a sensor that is one piece."""
    counts = piece.unit_counts()
    slot, low, phase, changing = sensor_profile([piece.statistics(counts)], piece.slots)
    residual, counted = piece.residuals(counts, slot, low, phase)
    return piece.kinds(counts, residual, scatter(counted), changing)


def implausible_readings(readings: DataFrame, limits: DataFrame, piece: int = PIECE, margin: int = MARGIN) -> DataFrame:
    """(reading_id, sensor_id, reason): reason is ``range``, ``spike`` or ``stuck``."""
    unit = lambda c: F.lower(F.trim(c))
    bounds = limits.groupBy(unit(F.col("unit")).alias("unit")).agg(F.max("min_reading").alias("low"), F.min("max_reading").alias("high"))
    rows = readings.select("reading_id", F.col("sensor_id").cast("string").alias("sensor_id"), F.col("reading").cast("double").alias("reading"), unit(F.col("unit")).alias("unit"), instant(F.col("timestamp")).alias("t"))
    rows = stash(rows.filter("reading IS NOT NULL AND t IS NOT NULL AND sensor_id IS NOT NULL AND reading_id IS NOT NULL"), "readings")
    rows = rows.withColumn("block", F.expr(f"CAST(FLOOR(t / {BLOCK_HOURS * 3_600_000_000}) AS BIGINT)"))
    # Which blocks make up a piece of a sensor with several, from counts alone; a block near a piece's end is in the next one's margin too.
    count = rows.groupBy("sensor_id", "block").agg(F.count("*").alias("count"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    large = count.groupBy("sensor_id").agg(F.sum("count").alias("n"), F.min("t0").alias("from_t"), F.max("t1").alias("to_t")).filter(F.col("n") > piece)
    before = F.coalesce(F.sum("count").over(W.partitionBy("sensor_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = count.join(large, "sensor_id").withColumn("before", before).withColumn("own", F.floor(F.col("before") / piece))
    ends = W.partitionBy("sensor_id", "own")
    pieces = pieces.withColumn("first", F.min("before").over(ends)).withColumn("last", F.max(F.col("before") + F.col("count")).over(ends)).withColumn("most", F.max("own").over(W.partitionBy("sensor_id")))
    near_start = (F.col("own") > 0) & (F.col("before") < F.col("first") + margin)
    near_end = (F.col("own") < F.col("most")) & (F.col("before") + F.col("count") > F.col("last") - margin)
    pieces = stash(pieces.select("sensor_id", "block", "own", F.explode(F.array_compact(F.array("own", F.when(near_start, F.col("own") - 1), F.when(near_end, F.col("own") + 1)))).alias("piece"), "n", "from_t", "to_t"), "pieces")
    placed = rows.join(pieces, ["sensor_id", "block"], "left").join(bounds, "unit", "left")
    slim = placed.select("sensor_id", F.coalesce("piece", F.lit(-1)).alias("piece"), "t", "reading_id", "reading", F.coalesce(F.col("own") == F.col("piece"), F.lit(True)).alias("core"), F.when(F.col("unit").isNotNull(), F.coalesce("low", F.lit(float("-inf")))).alias("low"), F.coalesce("high", F.lit(float("inf"))).alias("high"), F.coalesce(F.col("unit") == RESTING_UNIT, F.lit(False)).alias("resting"), "n", "from_t", "to_t")
    reasons = np.array([None, "range", "spike", "stuck"], dtype=object)
    schema = "reading_id bigint, sensor_id string, reason string, piece bigint, packed binary"
    names = ["reading_id", "sensor_id", "reason", "piece", "packed"]

    def cases(p: Piece, kind: np.ndarray, sensor: str) -> pa.RecordBatch:
        at = np.flatnonzero((kind > 0) & p.core)
        return pa.RecordBatch.from_arrays([pa.array(p.ids[at]), pa.array([sensor] * len(at), pa.string()), pa.array(reasons[kind[at]], pa.string()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], names=names)

    def first_look(part: pa.Table) -> pa.RecordBatch:
        ids = part["reading_id"].to_numpy()
        once = np.concatenate([[True], ids[1:] != ids[:-1]])
        part = part.filter(pa.array(once)) if not once.all() else part
        low, high = part["low"].to_numpy(), part["high"].to_numpy()
        rests = np.asarray(part["resting"].to_numpy(zero_copy_only=False), bool)
        known = ~np.isnan(low)
        code = np.full(len(low), -1, np.int16)
        units, code[known] = np.unique(np.stack([low, high, rests])[:, known], axis=1, return_inverse=True)
        t, sensor = part["t"].to_numpy(), part["sensor_id"][0].as_py()
        cut = part["piece"][0].as_py()
        span = (int(t[0]), int(t[-1]), len(t)) if cut < 0 else tuple(part[c][0].as_py() for c in ("from_t", "to_t", "n"))
        p = Piece(part["reading_id"].to_numpy(), t, part["reading"].to_numpy(), np.asarray(part["core"].to_numpy(zero_copy_only=False), bool), code, [(float(a), float(b), bool(c)) for a, b, c in units.T], span)
        if cut < 0:
            return cases(p, whole(p), sensor)
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([sensor]), pa.array([None], pa.string()), pa.array([cut], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], names=names)

    looked = stash(map_groups(slim, ["sensor_id", "piece"], ["t", "reading_id"], first_look, schema), "looked")
    found = looked.filter("reason IS NOT NULL").select("reading_id", "sensor_id", "reason")
    cut = looked.filter("packed IS NOT NULL").select("sensor_id", "piece", "packed")
    if cut.isEmpty():
        return found
    return found.unionByName(_cut_sensors(cut, cases))


def _each(function, schema: str):
    """A map over rows of (sensor_id, piece, packed, …) that gives a record batch for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield function(*(batch.column(k)[i].as_py() for k in range(batch.num_columns)))

    return lambda df: df.mapInArrow(run, schema)


def _cut_sensors(cut: DataFrame, cases) -> DataFrame:
    """The cases of sensors in several pieces. Between the pieces go unit counts, slot medians and counts of residuals by size, added up by sensor."""
    of_piece = "sensor_id string, piece bigint, packed binary"
    row = lambda sensor, k, value: pa.RecordBatch.from_arrays([pa.array([sensor]), pa.array([k], pa.int64()), pa.array([pickle.dumps(value)], pa.binary())], names=["sensor_id", "piece", "packed"])

    def by_sensor(df: DataFrame, combine) -> DataFrame:
        """``combine`` of the values of all pieces of a sensor gives one value for each piece."""

        def run(part: pa.Table) -> pa.RecordBatch:
            values = combine(list(map(pickle.loads, part["packed"].to_pylist())))
            return pa.RecordBatch.from_arrays([part["sensor_id"].combine_chunks(), part["piece"].combine_chunks(), pa.array([pickle.dumps(v) for v in values], pa.binary())], names=["sensor_id", "piece", "shared"])

        return map_groups(df, ["sensor_id"], ["piece"], lambda part: run(part.select(["sensor_id", "piece", "packed"])), of_piece.replace("packed", "shared"))

    def units(sensor: str, k: int, packed: bytes) -> pa.RecordBatch:
        return row(sensor, k, pickle.loads(packed).unit_counts())

    total = by_sensor(_each(units, of_piece)(cut), lambda values: [sum(values, Counter())] * len(values))
    counted = stash(cut.join(total, ["sensor_id", "piece"]), "counted")

    def statistics(sensor: str, k: int, packed: bytes, shared: bytes) -> pa.RecordBatch:
        p = pickle.loads(packed)
        return row(sensor, k, (p.statistics(pickle.loads(shared)), p.slots, int(p.t[0]) // (p.period // p.slots), int(p.t[-1]) // (p.period // p.slots)))

    def decompose(values: list[tuple]) -> list[tuple]:
        slot, low, phase, changing = sensor_profile([v[0] for v in values], values[0][1])
        near = [slice(np.searchsorted(slot, v[2] - 1), np.searchsorted(slot, v[3] + 1, side="right")) for v in values]
        return [(slot[s], low[s], phase, changing) for s in near]

    fitted = by_sensor(_each(statistics, of_piece)(counted), decompose).withColumnRenamed("shared", "fit")

    def residuals(sensor: str, k: int, packed: bytes, shared: bytes, fit: bytes) -> pa.RecordBatch:
        p, counts, (slot, low, phase, changing) = pickle.loads(packed), pickle.loads(shared), pickle.loads(fit)
        residual, counted = p.residuals(counts, slot, low, phase)
        out = [pickle.dumps((p, counts, residual, changing)), pickle.dumps(counted)]
        return pa.RecordBatch.from_arrays([pa.array([sensor]), pa.array([k], pa.int64()), *(pa.array([b], pa.binary()) for b in out)], names=["sensor_id", "piece", "state", "packed"])

    state = stash(_each(residuals, "sensor_id string, piece bigint, state binary, packed binary")(counted.join(fitted, ["sensor_id", "piece"])), "residuals")
    usual = by_sensor(state.select("sensor_id", "piece", "packed"), lambda values: [scatter(sum(values, Counter()))] * len(values))

    def decide(sensor: str, k: int, packed: bytes, shared: bytes) -> pa.RecordBatch:
        p, counts, residual, changing = pickle.loads(packed)
        return cases(p, p.kinds(counts, residual, pickle.loads(shared), changing), sensor)

    judged = _each(decide, "reading_id bigint, sensor_id string, reason string, piece bigint, packed binary")(state.drop("packed").join(usual, ["sensor_id", "piece"]))
    return judged.select("reading_id", "sensor_id", "reason")
