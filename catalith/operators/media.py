"""Features of images, video frames, audio and recognised text, in numpy over Arrow batches or inside the JVM.

Codecs and models stay behind small protocols; the defaults are deterministic and need no files.
"""

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions.vector import dot, mean_vector

# --- fixed values: defaults of picture metadata, zero-shot categories, limits
GREYS = ("#808080", "#A0A0A0", "#C0C0C0")
NO_CATEGORY, NO_DESCRIPTION, NO_SCENE, NO_NAME, NO_TAG = "unknown", "No description available", "abstract", "Mixed Content", "content"
CATEGORIES = ("animal", "person", "vehicle", "nature", "food", "building", "object", "abstract", "landscape", "indoor scene")
TAG_LIMIT, COLOUR_LIMIT, CONFIDENCE, KEYFRAMES = 15, 5, 60, 3


class Embedder(Protocol):
    size: int

    def encode(self, items: Sequence[object]) -> np.ndarray: ...


class HashingEmbedder:
    """Unit vectors from hashed words; equal inputs have equal vectors, nothing more is promised."""

    def __init__(self, size: int = 512):
        self.size = size

    def encode(self, items: Sequence[object]) -> np.ndarray:
        out = np.zeros((len(items), self.size), np.float32)
        for row, item in zip(out, items, strict=True):
            for word in str(item).lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.size] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def embed(df: DataFrame, column: str, embedder: Embedder | None = None, name: str = "embedding", batch: int = 64) -> DataFrame:
    """All columns and the unit vector of ``column``; blank or null text is an error that names the first five rows of its batch."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            bad = [i for i, t in enumerate(s) if t is None or not str(t).strip()]
            if bad:
                raise ValueError(f"{len(bad)} texts are empty, at {bad[:5]}")
            parts = [model.encode(list(s[i : i + batch])) for i in range(0, len(s), batch)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, model.size), np.float32)
            if matrix.shape[1] != model.size:
                raise ValueError(f"the encoder gave {matrix.shape[1]} axes instead of {model.size}")
            yield pd.Series(list(matrix))

    return df.withColumn(name, encode(F.col(column)))


def keyframe_times(duration: Column, frames: int = KEYFRAMES) -> Column:
    """Evenly spaced times in seconds: duration * i / (frames + 1)."""
    return F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: duration * i / (frames + 1))


def frame_timestamps(frames: DataFrame, asset: str, order: str, duration: str) -> DataFrame:
    """All columns and timestamp_ms: duration / number of frames * index, in whole milliseconds."""
    n = F.count("*").over(W.partitionBy(asset))
    place = F.row_number().over(W.partitionBy(asset).orderBy(order)) - 1
    return frames.withColumn("timestamp_ms", F.floor(F.col(duration) / n * place * 1000).cast("int"))


def attention_weights(frames: np.ndarray, temperature: float = 0.08) -> np.ndarray:
    z = frames @ frames.mean(axis=0) / temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def attention_pool(df: DataFrame, group: str, order: str, vector: str = "embedding", temperature: float = 0.08, mix: float = 0.0) -> DataFrame:
    """(group, pooled): softmax-weighted mean of a group's frames, of unit length; with ``mix``, that part of plain mean. The
    weights need the mean first, so there are two passes of sums: no group is ever held in one place."""
    axes = df.filter(F.col(vector).isNotNull()).select(group, order, F.posexplode(vector).alias("axis", "x")).withColumn("x", F.col("x").cast("double"))
    mean = axes.groupBy(group, "axis").agg(F.avg("x").alias("m"))
    score = axes.join(mean, [group, "axis"]).groupBy(group, order).agg((F.sum(F.col("x") * F.col("m")) / temperature).alias("z"))
    top = score.groupBy(group).agg(F.max("z").alias("top"))
    weight = score.join(top, group).select(group, order, F.exp(F.col("z") - F.col("top")).alias("w"))
    total = weight.groupBy(group).agg(F.sum("w").alias("total"))
    pooled = axes.join(weight, [group, order]).groupBy(group, "axis").agg(F.sum(F.col("x") * F.col("w")).alias("s")).join(total, group).join(mean, [group, "axis"])
    pooled = pooled.select(group, "axis", (F.lit(1 - mix) * F.col("s") / F.col("total") + F.lit(mix) * F.col("m")).alias("x"))
    length = pooled.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    unit = pooled.join(length, group).select(group, "axis", F.when(F.col("length") > 0, F.col("x") / F.col("length")).otherwise(F.col("x")).alias("x"))
    return unit.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias("pooled"))


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits: the signs of the 8x8 lowest frequencies of a 32x32 picture against their median."""
    n = 32
    rows = np.linspace(0, grey.shape[0], n + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], n + 1).astype(int)
    small = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def colour_histogram(frame: np.ndarray, bins: int = 8) -> np.ndarray:
    """Share of pixels by hue, saturation and value, of sum 1."""
    x = frame.reshape(-1, 3).astype(float) / 255
    top, low = x.max(axis=1), x.min(axis=1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x.T
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    hue = np.where(top > low, hue, 0)
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    h, _ = np.histogramdd(np.stack([hue, sat, top], axis=1), bins=bins, range=[(0, 1)] * 3)
    return h.ravel() / max(h.sum(), 1)


def diverse_frames(frames: Sequence[np.ndarray], wanted: int) -> list[int]:
    """Indexes of frames as far apart in colour as possible: from frame 0, always the one farthest from those chosen. As many
    as there are if fewer are asked for than exist."""
    if len(frames) <= wanted:
        return list(range(len(frames)))
    root = np.sqrt([colour_histogram(f) for f in frames])
    chosen = [0]
    nearest = np.sqrt(np.maximum(0, 1 - root @ root[0]))
    while len(chosen) < wanted:
        k = int(nearest.argmax())
        chosen.append(k)
        nearest = np.minimum(nearest, np.sqrt(np.maximum(0, 1 - root @ root[k])))
    return sorted(chosen)


def palette(frame: np.ndarray, bands: int = 3) -> list[str]:
    """The mean colour of each horizontal band as #rrggbb."""
    return ["#{:02x}{:02x}{:02x}".format(*(int(v) for v in part.reshape(-1, 3).mean(axis=0))) for part in np.array_split(frame, bands)]


def edge_density(grey: np.ndarray) -> float:
    """Share of pixels at which the brightness changes by more than 50 to the right and below together."""
    dx, dy = np.abs(np.diff(grey.astype(float), axis=1)), np.abs(np.diff(grey.astype(float), axis=0))
    return float(((np.pad(dx, ((0, 0), (0, 1))) + np.pad(dy, ((0, 1), (0, 0)))) > 50).mean())


def text_likely(grey: np.ndarray, words: Sequence[tuple[str, float]] = (), density: float = 0.15, least: int = 5) -> tuple[bool, float]:
    """Whether a picture holds text: enough edges, then at least five words above confidence 60, and their mean confidence."""
    if edge_density(grey) < density:
        return False, 0.0
    good = [c for w, c in words if w.strip() and c > CONFIDENCE]
    return len(good) >= least, float(np.mean(good)) / 100 if good else 0.0


def recognised_text(words: Column, confidences: Column, least: float = CONFIDENCE) -> Column:
    """struct(text, word_count, mean_confidence) of recognised words: those not blank at or above ``least`` are joined; the mean is
    over all not blank, a negative confidence counting as 0."""
    pairs = F.filter(F.arrays_zip(words.alias("w"), confidences.alias("c")), lambda p: F.trim(p["w"]) != "")
    kept = F.filter(pairs, lambda p: p["c"].cast("double") >= least)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.greatest(p["c"].cast("double"), F.lit(0.0)))
    mean = F.coalesce(F.try_divide(total, F.size(pairs)), F.lit(0.0))
    return F.struct(F.array_join(F.transform(kept, lambda p: F.trim(p["w"])), " ").alias("text"), F.size(kept).alias("word_count"), F.round(mean, 4).alias("mean_confidence"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Picture metadata with gaps filled: category, at most 15 tags, description, scene, name and three to five colours."""
    category = F.coalesce("primary_category", F.lit(NO_CATEGORY))
    tags = F.when(F.size(F.coalesce("tags", F.array())) == 0, F.array(category, F.lit(NO_TAG))).otherwise(F.slice("tags", 1, TAG_LIMIT))
    valid = F.filter(F.coalesce("color_palette", F.array(*map(F.lit, GREYS))), lambda c: c.startswith("#") & (F.length(c) == 7))
    colours = F.slice(F.when(F.size(valid) < 3, F.concat(valid, F.array(*map(F.lit, GREYS)))).otherwise(valid), 1, COLOUR_LIMIT)
    return df.select("asset_id", category.alias("primary_category"), tags.alias("tags"), F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("description"), F.coalesce("scene_type", F.lit(NO_SCENE)).alias("scene_type"), F.coalesce("suggested_cluster_name", F.lit(NO_NAME)).alias("suggested_cluster_name"), colours.alias("color_palette"))


def sampled_frames(frames: Sequence[np.ndarray], times: Sequence[float], gap: float = 0.4, distance: float = 0.15, most: int = 24) -> list[int]:
    """Indexes of frames at least ``gap`` seconds apart that differ in colour from the last one taken, the first three in any case."""
    taken: list[int] = []
    last = None
    for i, (f, t) in enumerate(zip(frames, times, strict=True)):
        if len(taken) >= most:
            break
        if taken and t - times[taken[-1]] < gap:
            continue
        h = np.sqrt(colour_histogram(f))
        if len(taken) < 3 or last is None or np.sqrt(max(0.0, 1 - float(h @ last))) >= distance:
            taken.append(i)
            last = h
    return taken


def wave_features(content: bytes, points: int = 64) -> dict[str, object]:
    """Duration, rate, channels and the envelope of a WAV file as mono loudness at so many points."""
    import io
    import wave

    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
    x = np.frombuffer(raw, kind).astype(float).reshape(-1, channels).mean(axis=1)
    x = x - 128 if width == 1 else x
    parts = np.array_split(np.abs(x) / float(2 ** (8 * width - 1)), points) if len(x) else []
    return {"duration": n / rate if rate else 0.0, "sample_rate": rate, "channels": channels, "envelope": [float(p.max()) if len(p) else 0.0 for p in parts]}


def fitted(width: Column, height: Column, longest: int = 1024) -> Column:
    """struct(width, height) of a picture shrunk so that its longest side fits; whole pixels, smaller ones unchanged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


PICTURE = "perceptual_hash string, palette array<string>, edges double, has_text boolean, confidence double, error string"


def analysed_pictures(df: DataFrame, ident: str = "id") -> DataFrame:
    """(ident, perceptual_hash, palette, edges, has_text, confidence, error) of decoded pictures (ident, pixels, width, height[, words, confidences]).

    ``pixels`` are grey values or red, green and blue ones from 0 to 255, row by row. A picture that is null or whose pixels do not fill its size has an error and
    nothing else, and holds up no other. ``words`` with ``confidences`` are what a reader recognised; without them no picture holds text.
    """
    read = [c for c in ("words", "confidences") if c in df.columns]

    def one(p: object, w: object, h: object, words: object, sure: object) -> tuple:
        if p is None or not w or not h or w <= 0 or h <= 0 or len(p) not in (int(w) * int(h), 3 * int(w) * int(h)):
            raise ValueError("the pixels do not fill the size")
        flat = np.asarray(p, float)
        colour = flat.reshape(int(h), int(w), 3) if len(flat) == 3 * int(w) * int(h) else np.repeat(flat.reshape(int(h), int(w))[:, :, None], 3, axis=2)
        grey = colour @ np.array([0.299, 0.587, 0.114])
        pairs = [(x, float(c)) for x, c in zip(words, sure, strict=False) if x is not None and c is not None] if words is not None and sure is not None else []
        text, mean = text_likely(grey, pairs)
        return f"{perceptual_hash(grey):016x}", palette(colour), edge_density(grey), text, mean, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                words, sure = (row[4], row[5]) if len(read) == 2 else (None, None)
                try:
                    out.append((row[0], *one(row[1], row[2], row[3], words, sure)))
                except Exception as e:  # noqa: BLE001 - one bad picture is one row with an error
                    out.append((row[0], None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[ident, *[c.split()[0] for c in PICTURE.split(", ")]])

    return df.select(ident, "pixels", "width", "height", *(read if len(read) == 2 else [])).mapInPandas(run, f"{ident} {dict(df.dtypes)[ident]}, {PICTURE}")


def chosen_frames(df: DataFrame, group: str, order: str, wanted: int = KEYFRAMES) -> DataFrame:
    """(group, order, place): the ``wanted`` frames of each group that differ most in colour, in order. ``df``: (group, order, pixels) with red, green and blue
    values; null frames are left out. A group is the frames of one video, which one task holds."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f.pixels.notna()].sort_values(order).reset_index(drop=True)
        kept = diverse_frames([np.asarray(p, float) for p in f.pixels], wanted)
        return pd.DataFrame({group: f[group].iloc[kept], order: f[order].iloc[kept], "place": range(len(kept))})

    kinds = dict(df.dtypes)
    return df.select(group, order, "pixels").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, place int")


def heaviest_frames(df: DataFrame, group: str, order: str, top: int = KEYFRAMES, vector: str = "embedding", temperature: float = 0.08) -> DataFrame:
    """(group, order, weight, place): the frames of each group with the largest attention weights, softmax of their dot products with the group's mean."""
    rows = df.filter(F.col(vector).isNotNull())
    mean = mean_vector(rows, [group], vector, unit=False, name="mean")
    score = rows.join(mean, group).select(group, order, (dot(F.col(vector), F.col("mean")) / temperature).alias("z"))
    best = score.groupBy(group).agg(F.max("z").alias("top_z"))
    weight = score.join(best, group).withColumn("w", F.exp(F.col("z") - F.col("top_z")))
    total = weight.groupBy(group).agg(F.sum("w").alias("total"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col("z").desc(), order))
    ranked = weight.select(group, order, "w", "z").withColumn("place", place).filter(F.col("place") <= top)  # cut to so many in the map tasks
    return ranked.join(total, group).select(group, order, F.round(F.col("w") / F.col("total"), 6).alias("weight"), "place")
