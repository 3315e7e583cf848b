"""Assignment to clusters, their statistics and quality, candidates for merging, and the order-dependent leader fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catalith.functions import vector
from catalith.functions.grouped import map_groups

THRESHOLD, MERGE_COSINE = 0.72, 0.85


def usable(clusters: DataFrame) -> DataFrame:
    """(cluster_id, centroid, threshold): clusters with a centroid, of unit length; a threshold of null or 0 means the default."""
    least = F.when(F.coalesce("threshold", F.lit(0.0)) == 0, THRESHOLD).otherwise(F.col("threshold"))
    return clusters.filter("centroid IS NOT NULL").select(F.col("id").alias("cluster_id"), vector.normalised(F.col("centroid")).alias("centroid"), least.alias("threshold"))


def assign_best(vectors: DataFrame, clusters: DataFrame, block: int = 4096) -> DataFrame:
    """(id, cluster_id, cosine): the cluster with the largest cosine at or above its threshold, for every vector that has one.

    The centroids are compared in blocks by hash: each block is one literal matrix of at most about ``block`` rows for a pass of products over the
    vectors, which are not shuffled, and the best of all blocks is kept by an aggregation with map-side combination. Up to ``block`` clusters
    this is a single pass. Ties go to the smaller id.
    """
    known = usable(clusters).filter("cluster_id IS NOT NULL").select("cluster_id", "centroid", "threshold")
    blocks = -(-known.count() // block)
    rows = vectors.filter("embedding IS NOT NULL").select("id", "embedding")
    out = None
    for part in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == part).orderBy("cluster_id").collect()
        if not own:
            continue
        names, table, least = [r.cluster_id for r in own], np.array([r.centroid for r in own]), np.array([r.threshold for r in own])

        def run(batches: Iterator[pa.RecordBatch], names=names, table=table, least=least) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), table.shape[1]), False)
                good = batch.filter(fits)
                v = good.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, table.shape[1])
                cos = np.round(v @ table.T, 12)
                cos[~(cos >= least)] = -2
                best = cos.argmax(axis=1)
                got = cos[np.arange(len(best)), best]
                hit = got > -2
                yield pa.RecordBatch.from_arrays([good.column(0).filter(pa.array(hit)), pa.array([names[b] for b in best[hit]], pa.string()), pa.array(got[hit])], names=["id", "cluster_id", "cosine"])

        hits = rows.mapInArrow(run, "id string, cluster_id string, cosine double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return rows.select("id", F.lit("").alias("cluster_id"), F.lit(0.0).alias("cosine")).limit(0)
    best = out.groupBy("id").agg(F.max("cosine").alias("c"), F.min_by("cluster_id", F.struct(-F.col("cosine"), "cluster_id")).alias("cluster_id"))
    return best.select("id", "cluster_id", F.round("c", 6).alias("cosine"))


def merge_candidates(clusters: DataFrame, least: float = MERGE_COSINE, block: int = 2048) -> DataFrame:
    """(a, b, cosine): pairs of clusters, a < b, whose centroids have a cosine of at least ``least``.

    Centroids of many axes have no order or grid that would set pairs apart (at 64 axes neighbouring strips of the width that the cosine
    allows hold all of them), so every pair is compared, once, in products of two blocks of centroids; only pairs that reach
    ``least`` are rows. Clusters are few beside their members; each task has two blocks.
    """
    units = usable(clusters).filter("cluster_id IS NOT NULL").select("cluster_id", "centroid")
    blocks = max(1, -(-units.count() // block))
    salted = units.withColumn("salt", F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = salted.select("cluster_id", "centroid", F.size("centroid").alias("size"), "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))

    def run(part: pa.Table) -> pa.RecordBatch | None:
        size, salt, i, j = part["size"][0].as_py(), part["salt"].to_numpy(), part["i"][0].as_py(), part["j"][0].as_py()
        v = part["centroid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        names = np.array(part["cluster_id"].to_pylist(), dtype=object)
        left, right = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
        cosine = v[left] @ v[right].T
        x, y = np.nonzero(cosine >= least)
        found = cosine[x, y]
        x, y = left[x], right[y]
        keep = names[x] < names[y] if i == j else np.ones(len(x), bool)
        if not keep.any():
            return None
        a, b = names[x[keep]], names[y[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.string()), pa.array(np.maximum(a, b), pa.string()), pa.array(found[keep])], names=["a", "b", "cosine"])

    found = map_groups(pairs, ["size", "i", "j"], ["cluster_id"], run, "a string, b string, cosine double")
    return found.select("a", "b", F.round("cosine", 6).alias("cosine"))


def nearest_labels(vectors: DataFrame, ident: str, labels: DataFrame, top: int, column: str = "embedding", block: int = 4096) -> DataFrame:
    """(ident, place, label, cosine): the ``top`` labels with the largest dot products with each vector, in order, equal ones by label.
    ``labels``: (label, centroid), compared in blocks by hash; the best of each block are merged per vector."""
    known = labels.filter("label IS NOT NULL AND centroid IS NOT NULL").select("label", "centroid")
    blocks = -(-known.count() // block)
    kinds = dict(labels.dtypes)
    rows = vectors.filter(F.col(column).isNotNull()).select(F.col(ident).alias("id"), F.col(column).alias("embedding"))
    schema = f"id {dict(vectors.dtypes)[ident]}, best array<struct<far: double, label: {kinds['label']}>>"
    out = rows.select("id", F.expr(f"CAST(array() AS array<struct<far: double, label: {kinds['label']}>>)").alias("best")).limit(0)
    kind = pa.list_(pa.struct([("far", pa.float64()), ("label", to_arrow_type(labels.schema["label"].dataType))]))
    for part in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == part).orderBy("label").collect()
        if not own:
            continue
        names, table = [r.label for r in own], np.array([r.centroid for r in own], float)

        def run(batches: Iterator[pa.RecordBatch], names=names, table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), table.shape[1]), False))
                v = good.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, table.shape[1])
                far = -np.round(v @ table.T, 9)
                order = np.argsort(far, axis=1, kind="stable")[:, :top]
                best = [[{"far": float(f[k]), "label": names[k]} for k in o] for f, o in zip(far, order, strict=True)]
                yield pa.RecordBatch.from_arrays([good.column(0), pa.array(best, kind)], names=["id", "best"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    merged = out.groupBy("id").agg(F.flatten(F.collect_list("best")).alias("best"))  # at most ``top`` of each block
    ranked = merged.select("id", F.posexplode(F.slice(F.array_sort("best"), 1, top)).alias("place", "s"))
    return ranked.select(F.col("id").alias(ident), (F.col("place") + 1).alias("place"), "s.label", F.round(-F.col("s.far"), 6).alias("cosine"))


def cluster_counts(clusters: DataFrame, assets: DataFrame, least: int = 0, provisional: bool | None = None) -> DataFrame:
    """(cluster_id, name, provisional, assets): clusters with the number of their assets, empty ones included."""
    rows = clusters if provisional is None else clusters.filter(F.col("provisional") == provisional)
    own = assets.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("id").alias("assets"))
    joined = rows.select(F.col("id").alias("cluster_id"), "name", "provisional").join(own, "cluster_id", "left")
    return joined.withColumn("assets", F.coalesce("assets", F.lit(0))).filter(F.col("assets") >= least)


def global_statistics(clusters: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: clusters, provisional and confirmed, assets in clusters and outside, mean assets per cluster."""
    per = cluster_counts(clusters, assets).agg(F.count("*").alias("clusters"), F.count_if("provisional").alias("provisional"), F.count_if(~F.col("provisional")).alias("confirmed"), F.round(F.coalesce(F.avg("assets"), F.lit(0.0)), 6).alias("mean_assets"))
    media = assets.agg(F.count("cluster_id").alias("clustered"), F.count_if(F.col("cluster_id").isNull()).alias("unclustered"))
    return per.crossJoin(media)  # one row each


def centroid_quality(clusters: DataFrame, assets: DataFrame) -> DataFrame:
    """(cluster_id, members, mean, spread, least, most): dot products of the centroid with its members; population spread."""
    members = assets.filter("embedding IS NOT NULL AND cluster_id IS NOT NULL").select("cluster_id", "embedding")
    dots = members.join(usable(clusters).select("cluster_id", "centroid"), "cluster_id").select("cluster_id", vector.dot(F.col("embedding"), F.col("centroid")).alias("d"))
    r = lambda c: F.round(c, 6)
    return dots.groupBy("cluster_id").agg(F.count("d").alias("members"), r(F.avg("d")).alias("mean"), r(F.stddev_pop("d")).alias("spread"), r(F.min("d")).alias("least"), r(F.max("d")).alias("most"))


def merged_centroid(assets: DataFrame, sources: list[str]) -> DataFrame:
    """(centroid): the normalised mean of the members of the source clusters; those of the target do not count."""
    rows = assets.filter(F.col("cluster_id").isin(sources)).select(F.lit(1).alias("one"), "embedding")
    return vector.mean_vector(rows, ["one"], "embedding").drop("one")


def merge(clusters: DataFrame, assets: DataFrame, sources: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, assets) after moving the members of ``sources`` to ``target``; merging into itself is an error."""
    if target in sources or not sources:
        raise ValueError("sources and target must differ")
    fresh = merged_centroid(assets, sources).withColumnRenamed("centroid", "fresh").withColumn("id", F.lit(target))
    kept = clusters.filter(~F.col("id").isin(sources)).join(fresh, "id", "left")
    kept = kept.withColumn("centroid", F.coalesce(F.transform("fresh", lambda x: x.cast("float")), "centroid")).drop("fresh").select(*clusters.columns)
    return kept, assets.withColumn("cluster_id", F.when(F.col("cluster_id").isin(sources), F.lit(target)).otherwise(F.col("cluster_id")))


def changed(clusters: DataFrame, ident: str, name: str | None = None, threshold: float | None = None, confirm: bool = False) -> DataFrame:
    """The clusters after renaming, setting a threshold between 0 and 1, or confirming one of them."""
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    row = clusters.filter(F.col("id") == ident).select("provisional").first()
    if row is None:
        raise ValueError("no such cluster")
    if confirm and not row.provisional:
        raise ValueError("already confirmed")
    if name is not None and not clusters.filter((F.col("name") == name) & (F.col("id") != ident)).isEmpty():
        raise ValueError("the name is taken")
    here = F.col("id") == ident
    out = clusters
    for column, value in (("name", name), ("threshold", threshold), ("provisional", False if confirm else None)):
        if value is not None:
            out = out.withColumn(column, F.when(here, F.lit(value)).otherwise(F.col(column)))
    return out


def leader_fold(frame: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """(id, cluster_no) for (id, embedding) in order: each vector joins the cluster of the largest cosine at or above the threshold
    and moves its centroid, the normalised mean weighted by the members so far, or starts a cluster."""
    centres: list[np.ndarray] = []
    sizes: list[int] = []
    out = []
    for ident, e in zip(frame.id, frame.embedding, strict=True):
        v = np.asarray(e, float)
        length = np.linalg.norm(v)
        v = v / length if length else v
        best = int(np.argmax(np.array(centres) @ v)) if centres else -1
        if best >= 0 and centres[best] @ v >= threshold:
            c = centres[best] * sizes[best] + v
            n = np.linalg.norm(c)
            centres[best], sizes[best] = c / n if n else c, sizes[best] + 1
        else:
            best = len(centres)
            centres.append(v)
            sizes.append(1)
        out.append((ident, best))
    return pd.DataFrame(out, columns=["id", "cluster_no"])


def leader_clustering(vectors: DataFrame, group: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """(group, id, cluster_no): the leader fold of each group, in the order of ``order`` and id. The fold depends on that
    order, so a group is one task; groups are meant to be batches of bounded size. Across batches use :func:`assign_best`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order, "id"])
        out = leader_fold(frame, threshold)
        out.insert(0, group, frame[group].iloc[0])
        return out

    kind = dict(vectors.dtypes)[group]
    return vectors.filter("embedding IS NOT NULL").select(group, order, "id", "embedding").groupBy(group).applyInPandas(run, f"{group} {kind}, id string, cluster_no int")


def agglomerate(vectors: np.ndarray, cosine: float = 0.82, smallest: float = 0.1) -> np.ndarray:
    """Cluster numbers by average linkage while the mean cosine between clusters is at least ``cosine``; clusters smaller than a share of
    all vectors go to the nearest larger one. For the frames of one video or another set that fits one task."""
    x = np.asarray(vectors, float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n = len(x)
    groups = {i: [i] for i in range(n)}
    sims = x @ x.T
    mean = sims.copy()
    np.fill_diagonal(mean, -2)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        a, b = divmod(int(np.where(alive[:, None] & alive[None], mean, -2).argmax()), n)
        if mean[a, b] < cosine:
            break
        na, nb = len(groups[a]), len(groups[b])
        mean[a] = (na * mean[a] + nb * mean[b]) / (na + nb)
        mean[:, a] = mean[a]
        mean[a, a] = -2
        groups[a] += groups.pop(b)
        alive[b] = False
    least = int(smallest * n)
    centre = {g: x[m].mean(axis=0) for g, m in groups.items()}
    large = [g for g, m in groups.items() if len(m) >= least] or list(groups)
    out = np.zeros(n, int)
    number = {g: k for k, g in enumerate(sorted(large))}
    for g, m in groups.items():
        to = g if g in number else max(large, key=lambda h: float(centre[g] @ centre[h]))
        out[m] = number[to]
    return out
