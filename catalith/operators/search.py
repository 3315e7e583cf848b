"""Ranking of assets by vector similarity with scalar, array and keyword filters.

Scores are (1 + cosine) / 2. Vectors are dropped right after scoring, so top-k sorts carry narrow rows
(TakeOrderedAndProject keeps k rows per task). Ties are ordered by id, which makes every result reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import vector

KINDS = ("media", "json", "document")
LIMIT, MAX_LIMIT, MIN_SIMILARITY, KEYWORD_BOOST, KEYWORD_ONLY = 10, 100, 0.5, 0.15, 0.6


@dataclass(frozen=True)
class SearchFilter:
    """Conditions of a search; None does not restrict. An unknown kind is an error before anything runs."""

    kind: str | None = None
    owner: str | None = None
    cluster_id: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    status: str | None = None
    parent: str | None = None
    content_prefix: str | None = None

    def __post_init__(self) -> None:
        if self.kind is not None and self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; one of {', '.join(KINDS)}")

    def conditions(self) -> list[Column]:
        out = [F.col("embedding").isNotNull()]
        out += [F.col(c) == v for c, v in (("kind", self.kind), ("owner", self.owner), ("cluster_id", self.cluster_id), ("status", self.status), ("parent_asset_id", self.parent)) if v is not None]
        if self.content_prefix is not None:
            out.append(F.col("content_type").startswith(self.content_prefix))
        if self.tags:
            out.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))))
        return out

    def apply(self, assets: DataFrame) -> DataFrame:
        for c in self.conditions():
            assets = assets.filter(c)
        return assets


def valid_query(text: str | None) -> str:
    """The stripped query text; blank, below 2 or above 500 characters is an error."""
    plain = (text or "").strip()
    if not plain:
        raise ValueError("the query is empty")
    if not 2 <= len(plain) <= 500:
        raise ValueError("the query must have 2 to 500 characters")
    return plain


def query_vector(assets: DataFrame, asset_id: str | None = None) -> list[float]:
    """The vector of one asset (by default of the smallest id that has one), as a stand-in for an encoder."""
    rows = assets.filter("embedding IS NOT NULL")
    row = (rows.filter(F.col("id") == asset_id) if asset_id else rows).orderBy("id").select("embedding").first()
    if row is None:
        raise ValueError("no such vector")
    return list(row.embedding)


def scored(assets: DataFrame, query: Sequence[float], where: SearchFilter | None = None) -> DataFrame:
    """(id, kind, owner, cluster_id, similarity): all matching assets."""
    rows = (where or SearchFilter()).apply(assets)
    return rows.select("id", "kind", "owner", "cluster_id", vector.similarity(F.col("embedding"), vector.literal(query)).alias("similarity")).filter("similarity IS NOT NULL")


def top(df: DataFrame, limit: int, *order: str) -> DataFrame:
    return df.orderBy(F.col("similarity").desc(), *(order or ("id",))).limit(limit)


def semantic_search(assets: DataFrame, clusters: DataFrame, query: Sequence[float], where: SearchFilter | None = None, limit: int = LIMIT, least: float | None = MIN_SIMILARITY) -> DataFrame:
    """(id, kind, owner, cluster_id, cluster_name, similarity): the best matches, rounded to 4 places, at most 100."""
    rows = scored(assets, query, where)
    if least is not None:
        rows = rows.filter(F.col("similarity") >= least)
    best = top(rows, min(limit, MAX_LIMIT))
    named = best.join(clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name")), "cluster_id", "left")
    return named.select("id", "kind", "owner", "cluster_id", "cluster_name", F.round("similarity", 4).alias("similarity"))


def total(results: DataFrame, limit: int) -> DataFrame:
    """(total): the number of results of a search, which is counted after its limit and so never above it."""
    return results.limit(limit).agg(F.count("*").alias("total"))


def unified_search(assets: DataFrame, query: Sequence[float], kind: str | None = None, limit: int = LIMIT, least: float = MIN_SIMILARITY) -> DataFrame:
    """(id, leg, similarity): media and document legs, each cut to its best, ranked together by the rounded score; a
    kind without a leg gives no rows."""
    legs = []
    for leg, kinds, cap in (("media", ("media",) if kind in (None, "media") else ("json",) if kind == "json" else (), MAX_LIMIT), ("document", ("document",) if kind in (None, "document") else (), None)):
        for k in kinds:
            rows = scored(assets, query, SearchFilter(kind=k)).filter(F.col("similarity") >= least)
            legs.append(top(rows, min(limit, cap) if cap else limit).select("id", F.lit(leg).alias("leg"), F.round("similarity", 4).alias("similarity")))
    if not legs:
        return scored(assets.limit(0), query).select("id", F.lit("").alias("leg"), "similarity")
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    return out.orderBy(F.col("similarity").desc(), F.col("leg").desc(), "id").limit(limit)


def keyword_condition(keyword: str) -> Column:
    """Case-insensitive containment in the text that was read off an image; % and _ keep their pattern meaning."""
    return F.get_json_object("metadata", "$.ocr_text").ilike(f"%{keyword}%")


def hybrid_search(assets: DataFrame, query: Sequence[float], keyword: str, limit: int = LIMIT, least: float = MIN_SIMILARITY) -> DataFrame:
    """(id, similarity, found_by): vector hits and keyword hits; those found by both rank 0.15 higher, those by keyword alone at 0.6."""
    media = SearchFilter(kind="media")
    hits = top(scored(assets, query, media).filter(F.col("similarity") >= least), min(limit, MAX_LIMIT)).select("id", F.round("similarity", 4).alias("s"))
    words = assets.filter((F.col("kind") == "media") & keyword_condition(keyword)).select("id").orderBy("id").limit(limit * 2).withColumn("k", F.lit(True))
    both = hits.join(words, "id", "full")
    score = F.when(F.col("k") & F.col("s").isNotNull(), F.least(F.lit(1.0), F.col("s") + KEYWORD_BOOST)).when(F.col("s").isNotNull(), F.col("s")).otherwise(F.lit(KEYWORD_ONLY))
    by = F.when(F.col("k") & F.col("s").isNotNull(), "both").when(F.col("s").isNotNull(), "vector").otherwise("keyword")
    return top(both.select("id", F.round(score, 6).alias("similarity"), by.alias("found_by")), limit)


def tag_search(assets: DataFrame, tags: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """(id, kind, owner): media with any of the tags, by id."""
    rows = assets.filter((F.col("kind") == "media") & F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.select("id", "kind", "owner").orderBy("id").limit(limit)


def tag_list(csv: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(csv, ","), lambda t: F.trim(t)), lambda t: t != "")


def zero_shot(df: DataFrame, labels: DataFrame, ident: str = "id", column: str = "embedding") -> DataFrame:
    """(id, label, cosine): for each vector the label whose vector has the largest dot product, the smaller label on ties.
    ``labels``: (label, vector) - a fixed list of categories, whose number is checked."""
    rows = labels.select("label", "vector").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more labels than a literal list may hold; assign clusters instead")
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), vector.literal(r.vector).alias("vector")) for r in rows])
    scores = F.transform(table, lambda t: F.struct(vector.dot(F.col(column), t["vector"]).alias("cosine"), t["label"].alias("label")))
    best = F.aggregate(scores, F.lit(None).cast("struct<cosine:double,label:string>"), lambda a, s: F.when(a.isNull() | (s["cosine"] > a["cosine"]) | ((s["cosine"] == a["cosine"]) & (s["label"] < a["label"])), F.struct(s["cosine"].alias("cosine"), s["label"].cast("string").alias("label"))).otherwise(a))
    return df.filter(F.col(column).isNotNull()).select(F.col(ident).alias("id"), best.alias("b")).select("id", "b.label", F.round("b.cosine", 6).alias("cosine"))
