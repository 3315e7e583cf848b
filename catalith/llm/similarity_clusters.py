"""Clusters of mutually similar vectors by power iteration over sparse affinities.

Vectors within :data:`CLOSE` of an anchor are represented by it, so the affinity graph has one node per anchor that carries the sum and number
of its vectors. Each node is linked to its nearest nodes at a cosine of :data:`AFFINE` or more. An affinity falls off exponentially with the
cosine and weighs as many vectors as its node stands for; rows are normalised, and several random vectors are iterated with
the matrix, distributed, until they are nearly constant in each cluster and differ between clusters (:func:`embedding`). The embedding alone decides
which nodes belong together: linked nodes closer in it than a share of its spread have the same label, and k-means moves nodes to the nearest mean
among the labels around them until nothing changes (:func:`spectral_labels`). The mean of a label's vectors is its centre; known centres
take its place where a label has any. An exact check follows: every vector is held against every centre and is a member of the nearest
one within whose threshold it lies.

Tasks are bounded: candidates for links are sought in cells around pivots, crowded cells are divided by pivots of their own, and cells that stay
crowded are compared in blocks; the check streams the centres past groups of vectors.

Defined cases: vectors that are null, of another length, zero, or with a null or not finite element, and null ids are left out; of
repeated ids one row counts in the result; equal vectors are in one cluster; without vectors there are no clusters; a known centre without
vector is none, and a null threshold is :data:`THRESHOLD`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions.grouped import binary, compact, directions, map_groups, matrix, vector_sums
from catalith.session import drop_stash, stash

#: Cosine to the centre that a member needs unless its cluster says otherwise.
THRESHOLD = 0.72
#: Largest sample of pivots, cosine to an anchor, least cosine of an affinity, cells a node is compared in, affinities kept per node
#: and cell, and nodes from which a cell is crowded.
PIVOTS, CLOSE, AFFINE, CELLS, LINKS, CROWDED = 2048, 0.80, 0.6, 8, 12, 4096
#: Iterated vectors, iterations, drop of the cosine by which an affinity falls to 1/e, cosine that a node has with itself, distance in the
#: embedding, relative to its spread, under which linked nodes are one, and most rounds of k-means.
VECTORS, ITERATIONS, FALL, OWN, NEAR, ROUNDS = 6, 6, 0.09, 0.9, 0.2, 12
#: Most vectors of a group that the centres are streamed past.
GROUP = 250_000


def unit_vectors(df: DataFrame, ident: str, column: str, size: int) -> DataFrame:
    """(id, vec): unit vectors as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, size)
            length = np.linalg.norm(flat.astype(np.float64), axis=1)
            good = np.isfinite(length) & (length > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), binary(flat[good] / length[good, None])], names=["id", "vec"])

    rows = df.filter(F.col(ident).isNotNull() & (F.size(column) == size)).filter(~F.exists(column, lambda x: x.isNull()))
    return rows.select(F.col(ident).cast("string").alias("id"), F.col(column).alias("v")).mapInArrow(run, "id string, vec binary")


def pivots(vectors: DataFrame, n: int, limit: int = PIVOTS, per: int = 200) -> tuple[list[str], np.ndarray]:
    """A sample by hash of the ids, one vector in ``per`` of ``n``, at least 16 and at most ``limit``."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(min(limit, max(16, n // per))).collect()
    return [r.id for r in rows], np.frombuffer(b"".join(bytes(r.vec) for r in rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.float32)


def anchored(vectors: DataFrame, n: int, names: list[str], table: np.ndarray) -> DataFrame:
    """(id, anchor, vec): every vector with an anchor, the hash of one of the ids. The cells are computed twice, which costs
    less than writing all vectors once more."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = matrix(batch.column(1)) @ table.T
            best = cos.argmax(axis=1)
            near = cos[np.arange(len(best)), best] >= CLOSE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] if k else None for b, k in zip(best, near, strict=True)], pa.string()), pa.array(best.astype(np.int32)), batch.column(1)], names=["id", "anchor", "cell", "vec"])

    placed = vectors.mapInArrow(nearest, "id string, anchor string, cell int, vec binary")
    close = placed.filter("anchor IS NOT NULL").select("id", "anchor", "vec")
    salts = max(1, -(-n // (max(len(names), 1) * 2000)))
    far = placed.filter("anchor IS NULL").select("id", "cell", "vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), F.xxhash64("id", F.lit(1)).alias("rank"))

    def lead(part: pa.Table) -> pa.RecordBatch:
        v = matrix(part["vec"])
        ids = part["id"].to_pylist()
        anchor = np.full(len(v), -1)
        for start in range(0, len(v), 1024):  # blocks against the leaders so far, then among themselves
            block = v[start : start + 1024]
            old = np.flatnonzero(anchor[:start] == np.arange(start))
            if len(old):
                cos = block @ v[old].T
                best = cos.argmax(axis=1)
                hit = cos[np.arange(len(block)), best] >= CLOSE
                anchor[start : start + 1024][hit] = old[best[hit]]
            own = block @ block.T
            for i in range(len(block)):
                if anchor[start + i] < 0:
                    free = (anchor[start : start + 1024] < 0) & (own[i] >= CLOSE)
                    free[i] = True
                    anchor[start : start + 1024][free] = start + i
        return pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array([ids[a] for a in anchor], pa.string()), part["vec"].combine_chunks()], names=["id", "anchor", "vec"])

    led = map_groups(far, ["cell", "salt"], ["rank", "id"], lead, "id string, anchor string, vec binary")
    return stash(close.unionByName(led).select("id", F.xxhash64("anchor").alias("anchor"), "vec"), "anchored")


def _in_cells(nodes: DataFrame, table: np.ndarray, cells: int) -> DataFrame:
    """(id, cell, vec): each node in the cells of its nearest pivots; from here on a vector is one byte per axis."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            k = min(cells, len(table))
            top = np.argpartition(-(v @ table.T), k - 1, axis=1)[:, :k]
            at = pa.array(np.repeat(np.arange(len(v)), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(top.ravel().astype(np.int64)), compact(v).take(at)], names=["id", "cell", "vec"])

    return nodes.select("id", "vec").mapInArrow(place, "id bigint, cell bigint, vec binary")


def _crowds(placed: DataFrame, crowded: int, label: str) -> DataFrame:
    """(cell, size) of the cells with more nodes than a task should compare; few or none."""
    return stash(placed.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > crowded), label)


def _divided(placed: DataFrame, crowds: DataFrame, crowded: int, cells: int = 3) -> DataFrame:
    """The nodes of crowded cells in cells of their own: those of the nearest of one node in 64, drawn by hash, of the cell."""
    rows = placed.join(crowds, "cell").withColumn("salts", F.ceil(F.col("size") / crowded).cast("int"))
    heads = rows.filter(F.pmod(F.xxhash64("id", "cell"), F.lit(64)) == 0).select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "id", "vec")
    body = rows.select("cell", F.pmod(F.xxhash64("id", F.lit(7)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "vec")

    def divide(part: pa.Table) -> pa.RecordBatch | None:
        head = part["kind"].to_numpy() == 0
        v = directions(part["vec"])
        ids = part["id"].combine_chunks()
        if head.all():
            return None
        k = min(cells, int(head.sum()))
        top = np.argpartition(-(v[~head] @ v[head].T), k - 1, axis=1)[:, :k] if k else np.zeros((int((~head).sum()), 1), np.int64)
        names = part["id"].to_numpy()[head][top] if k else np.zeros(top.shape, np.int64)
        at = pa.array(np.repeat(np.flatnonzero(~head), top.shape[1]))
        own = np.full(len(at), part["cell"][0].as_py(), np.int64)
        return pa.RecordBatch.from_arrays([ids.take(at), pa.array(own), pa.array(names.ravel().astype(np.int64)), part["vec"].combine_chunks().take(at)], names=["id", "cell", "head", "vec"])

    fine = map_groups(heads.unionByName(body), ["cell", "salt"], ["kind", "id"], divide, "id bigint, cell bigint, head bigint, vec binary")
    return fine.select("id", F.xxhash64("cell", "head").alias("cell"), "vec")


def affinities(nodes: DataFrame, table: np.ndarray, least: float = AFFINE, cells: int = CELLS, links: int = LINKS, crowded: int = CROWDED) -> DataFrame:
    """(a, b, cos): pairs of nodes, both ways, at a cosine of at least ``least`` among the ``links`` nearest in a cell.
    ``nodes``: (id, vec), not necessarily of unit length."""
    placed = _in_cells(nodes, table, cells)
    crowds = _crowds(placed, crowded, "crowds")
    blocks = placed.select("id", "cell", "vec", F.lit(0).alias("salt"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if not crowds.isEmpty():
        fine = stash(_divided(placed, crowds, crowded), "divided")
        still = _crowds(fine, crowded, "crowds")  # compared in blocks of two salts each, so that no task holds the whole cell
        salts = F.coalesce(F.ceil(2 * F.col("size") / crowded).cast("int"), F.lit(1))
        fine = fine.join(still, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), salts - 1)))
        fine = fine.select("id", "cell", "vec", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
        calm = placed.join(crowds.select("cell"), "cell", "left_anti").select("id", "cell", "vec", F.lit(0).alias("salt"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        blocks = calm.unionByName(fine)

    def nearest(v: np.ndarray, w: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for start in range(0, len(v), 1024):
            cos = v[start : start + 1024] @ w.T
            if same:
                cos[np.arange(len(cos)), start + np.arange(len(cos))] = -1
            k = min(links, cos.shape[1])
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(cos, top, axis=1)
            i, j = np.nonzero(near >= least)
            a.append(start + i)
            b.append(top[i, j])
            c.append(near[i, j])
        return np.concatenate(a), np.concatenate(b), np.concatenate(c)

    def link(part: pa.Table) -> pa.RecordBatch | None:
        v = directions(part["vec"])
        salt, i, j = part["salt"].to_numpy(), part["i"][0].as_py(), part["j"][0].as_py()
        one, two = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
        if not len(one) or not len(two) or len(v) < 2:
            return None
        a, b, c = nearest(v[one], v[two], i == j)
        a, b = one[a], two[b]
        if i != j:
            x, y, z = nearest(v[two], v[one], False)
            a, b, c = np.concatenate([a, two[x]]), np.concatenate([b, one[y]]), np.concatenate([c, z])
        ids = part["id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate([a, b]))), ids.take(pa.array(np.concatenate([b, a]))), pa.array(np.concatenate([c, c]).astype(np.float32))], names=["a", "b", "cos"])

    return map_groups(blocks, ["cell", "i", "j"], ["id"], link, "a bigint, b bigint, cos float").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def embedding(edges: DataFrame, nodes: DataFrame, vectors: int = VECTORS, iterations: int = ITERATIONS) -> DataFrame:
    """(id, x0, x1, …): random vectors after repeated products with the row-normalised affinities. ``edges``:
    (a, b, w) with every node's loop. The affinities are shuffled once for all iterations."""
    total = edges.groupBy("a").agg(F.sum("w").alias("total"))
    steps = stash(edges.join(total, "a").select("a", "b", (F.col("w") / F.col("total")).cast("float").alias("p")), "steps")
    names = [f"x{i}" for i in range(vectors)]
    now = nodes.select("id", *[(F.xxhash64("id", F.lit(i)) / F.lit(2.0**63)).cast("float").alias(n) for i, n in enumerate(names)])
    for _ in range(iterations):
        now = steps.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(*[F.sum(F.col("p") * F.col(n)).cast("float").alias(n) for n in names]).withColumnRenamed("a", "id")
    out = stash(now, "embedding")
    drop_stash(steps)
    return out


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, label): where the pointers (id, label) end, each id's being itself or one further on."""
    while True:
        step = stash(pointers.join(pointers.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "pointers")
        if step.filter("moved").isEmpty():
            return step.select("id", "label")
        pointers = step.select("id", "label")


def _apart(names: list[str], left: str, right: str) -> Column:
    """Root mean square distance of two points."""
    return F.sqrt(sum((F.pow(F.col(left + n) - F.col(right + n), 2) for n in names), F.lit(0.0)) / len(names))


def spectral_labels(edges: DataFrame, nodes: DataFrame, near: float = NEAR, rounds: int = ROUNDS) -> DataFrame:
    """(id, label): nodes that are close in the embedding of the affinities. ``nodes``: (id, n), ``edges``: (a, b, cos).

    Links only say which nodes are compared. Linked nodes nearer than ``near`` of the embedding's spread follow the heaviest of them; then, in rounds,
    labels whose means are as near become one, and each node takes the nearest mean among its neighbours' labels. Ends when no node moves.
    """
    mass = nodes.select("id", F.greatest(F.col("n").cast("double"), F.lit(1e-3)).alias("mass"))
    weight = lambda cos: F.exp((cos - 1) / FALL)
    loops = mass.select(F.col("id").alias("a"), F.col("id").alias("b"), (weight(F.lit(OWN)) * F.col("mass")).alias("w"))
    weighted = edges.join(mass.select(F.col("id").alias("b"), "mass"), "b").select("a", "b", (weight(F.col("cos")) * F.col("mass")).alias("w")).unionByName(loops)
    points = embedding(weighted, nodes.select("id"))
    names = [c for c in points.columns if c != "id"]
    spread = points.agg(F.sqrt(F.avg(sum((F.pow(F.col(n), 2) for n in names), F.lit(0.0)) / len(names))).alias("s")).first().s or 0.0
    close = near * spread
    placed = stash(points.join(mass, "id"), "placed")
    side = lambda key, prefix: placed.select(F.col("id").alias(key), F.col("mass").alias(prefix + "mass"), *[F.col(n).alias(prefix + n) for n in names])
    links = stash(edges.join(side("a", "p"), "a").join(side("b", "q"), "b").filter(_apart(names, "p", "q") < close).select("a", "b", F.struct(F.col("qmass").alias("mass"), F.col("b").alias("id")).alias("peak")), "links")
    own = mass.select("id", F.struct("mass", "id").alias("own")).join(links.groupBy(F.col("a").alias("id")).agg(F.max("peak").alias("peak")), "id", "left")
    label = _roots(own.select("id", F.greatest("own", F.coalesce("peak", "own"))["id"].alias("label")))
    for _ in range(rounds):
        # Labels with the same mean are one.
        means = stash(_means(label, placed, names), "means")
        touching = edges.select("a", "b").join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").filter("la <> lb").select("la", "lb").distinct()
        mean = lambda key, prefix, means=means: means.select(F.col("label").alias(key), F.col("mass").alias(prefix + "mass"), *[F.col(n).alias(prefix + n) for n in names])
        alike = touching.join(mean("la", "p"), "la").join(mean("lb", "q"), "lb").filter(_apart(names, "p", "q") < close).groupBy(F.col("la").alias("id")).agg(F.max(F.struct(F.col("qmass").alias("mass"), F.col("lb").alias("id"))).alias("peak"))
        own = means.select(F.col("label").alias("id"), F.struct("mass", F.col("label").alias("id")).alias("own")).join(alike, "id", "left")
        joined = _roots(own.select("id", F.greatest("own", F.coalesce("peak", "own"))["id"].alias("label")))
        label = stash(label.withColumnRenamed("label", "old").join(joined.select(F.col("id").alias("old"), "label"), "old").select("id", "label", "old"), "labels")
        # k-means: the nearest mean among the labels of neighbours and its own, which it keeps if no other is nearer.
        means = _means(label, placed, names).drop("mass").select("label", *[F.col(n).alias("m" + n) for n in names])
        offers = edges.select("a", "b").join(label.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label", F.lit(True).alias("other")).unionByName(label.select("id", "label", F.lit(False).alias("other")))
        offers = offers.groupBy("id", "label").agg(F.min("other").alias("other"))
        best = offers.join(placed.select("id", *names), "id").join(means, "label").groupBy("id").agg(F.min(F.struct(F.round(_apart(names, "", "m"), 9).alias("far"), "other", "label")).alias("best"))
        moved = stash(label.select("id", "old").join(best, "id").select("id", F.col("best.label").alias("label"), "old"), "labels")
        label = moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            break
    return label


def _means(label: DataFrame, placed: DataFrame, names: list[str]) -> DataFrame:
    """(label, mass, x0, …): the mean of each label in the embedding."""
    return label.select("id", "label").join(placed, "id").groupBy("label").agg(F.sum("mass").alias("mass"), *[(F.sum(F.col("mass") * F.col(n)) / F.sum("mass")).alias(n) for n in names])


def nearest_centres(points: DataFrame, centres: DataFrame, n: int, group: int = GROUP) -> DataFrame:
    """(id, label, cosine): for each of the ``n`` vectors (id, vec) the nearest of all centres (label, threshold, last, vec) within whose threshold it
    lies, one that is ``last`` only if no other does. Exact: groups of vectors are held while all centres stream past them."""
    groups = max(2 * points.sparkSession.sparkContext.defaultParallelism, -(-n // group))
    body = points.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("kind"), "id", F.lit(0).cast("bigint").alias("label"), F.lit(0.0).alias("threshold"), F.lit(False).alias("last"), "vec")
    heads = centres.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), F.lit("").alias("id"), "label", "threshold", "last", "vec")
    ordered = body.unionByName(heads).repartition(groups, "grp").sortWithinPartitions("grp", "kind", "label", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        x = rank = best = cosine = None
        last = None

        def result() -> Iterator[pa.RecordBatch]:
            if rank is not None:
                good = rank > -9
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids).filter(pa.array(good)), pa.array(best[good]), pa.array(cosine[good])], names=["id", "label", "cosine"])

        for whole in batches:
            grp = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy() if whole.num_rows else np.zeros(0, np.int32)
            for a, b in zip([0, *(np.flatnonzero(np.diff(grp)) + 1)], [*(np.flatnonzero(np.diff(grp)) + 1), len(grp)], strict=True):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                if last != grp[a] // 2:
                    yield from result()
                    ids, held, x, rank, last = [], [], None, None, grp[a] // 2
                v = matrix(batch.column(6))
                if grp[a] % 2 == 0:
                    ids.append(batch.column(2))
                    held.append(v)
                    continue
                if not held:
                    continue
                if rank is None:
                    x = np.concatenate(held)
                    rank, best, cosine = np.full(len(x), -9.0), np.zeros(len(x), np.int64), np.zeros(len(x))
                c = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                name, least = batch.column(3).to_numpy(), (batch.column(4).to_numpy() - 1e-6).astype(np.float32)
                behind = 2 * np.asarray(batch.column(5).to_numpy(zero_copy_only=False), np.float32)
                step = max(1, 1_000_000 // len(c))  # so many cosines at a time
                for s in range(0, len(x), step):
                    cos = x[s : s + step] @ c.T
                    score = np.where(cos >= least, cos - behind, np.float32(-9))
                    k = score.argmax(axis=1)
                    at = np.arange(len(k))
                    better = np.flatnonzero(score[at, k] > rank[s : s + step])
                    rank[s + better], best[s + better], cosine[s + better] = score[better, k[better]], name[k[better]], cos[better, k[better]]
        yield from result()

    return ordered.mapInArrow(run, "id string, label bigint, cosine double")


def clusters(df: DataFrame, known: DataFrame | None = None, ident: str = "id", column: str = "embedding", size: int = 64) -> DataFrame:
    """(id, cluster, cosine): the members of all clusters of two or more; ``cluster`` is the smallest id in it, ``cosine`` that to
    the centre. ``known``: (id, centroid, threshold)."""
    vectors = unit_vectors(df, ident, column, size)
    n = vectors.select("id").count()
    if not n:
        return df.sparkSession.createDataFrame([], "id string, cluster string, cosine double")
    names, table = pivots(vectors, n)
    points = anchored(vectors, n, names, table)
    nodes = vector_sums(points.select("anchor", "vec"), "anchor").withColumnRenamed("anchor", "id")
    if known is not None:
        given = unit_vectors(known, "id", "centroid", size).join(known.select(F.col("id").cast("string").alias("id"), F.coalesce("threshold", F.lit(THRESHOLD)).alias("threshold")), "id")
        given = stash(given.groupBy("id").agg(F.min("vec").alias("vec"), F.min("threshold").alias("threshold")).select(F.xxhash64(F.concat(F.lit("known:"), "id")).alias("id"), "vec", "threshold"), "known")
        nodes = nodes.unionByName(given.select("id", "vec", F.lit(0).cast("bigint").alias("n")))
    nodes = stash(nodes, "nodes")
    edges = stash(affinities(nodes, table[: max(16, len(table) // 2)]), "edges")  # fewer, larger cells than those of the anchors
    labels = spectral_labels(edges, nodes.select("id", "n"))

    # Centres: the mean of the members, or the known ones where a label has any; there the mean takes only what they leave.
    means = vector_sums(nodes.join(labels, "id").filter("n > 0").select("label", "vec", "n"), "label").select("label", "vec")
    if known is None:
        centres = means.select("label", F.lit(THRESHOLD).alias("threshold"), F.lit(False).alias("last"), "vec")
    else:
        held = given.join(labels, "id")
        centres = means.join(held.select("label", F.lit(True).alias("last")).distinct(), "label", "left").select("label", F.lit(THRESHOLD).alias("threshold"), F.coalesce("last", F.lit(False)).alias("last"), "vec")
        centres = centres.unionByName(given.select(F.col("id").alias("label"), "threshold", F.lit(False).alias("last"), "vec"))
    checked = stash(nearest_centres(points.select("id", "vec"), stash(centres, "centres"), n), "checked")
    first = checked.groupBy("label").agg(F.min("id").alias("cluster"), F.max("id").alias("last")).filter("cluster <> last")
    return checked.join(first.select("label", "cluster"), "label").groupBy("id").agg(F.min_by(F.struct("cluster", "cosine"), F.struct(-F.col("cosine"), "cluster")).alias("c")).select("id", "c.cluster", "c.cosine")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, mean_cosine, typical): each cluster's size and its most typical members. A member's mean cosine
    to all members is its cosine to the centre times the length of their mean, so both rank members alike."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("cosine").desc(), "id"))
    best = members.withColumn("place", place).filter(F.col("place") <= typical)  # cut to so many in the map tasks
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("typical"))
    return sizes.join(names, "cluster")
