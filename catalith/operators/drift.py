"""Fields that are added, removed, renamed or change type between the files of a feed.

Each line becomes a path-value map with raw JSON types. Inside the map tasks the lines of a file are folded to
counts per (field, type, content token), so the shuffle carries statistics and not lines, whatever share of the
rows one feed has. Content tokens are words, digit-run classes and element counts, hashed into a fixed number of buckets, so
a field has at most :data:`BUCKETS` of them. Two fields carry the same kind of content if their token histograms
overlap; overlaps are summed over shared tokens by an equi-join, never over all pairs of fields.

Defined cases: lines that are null, no JSON or no object are unreadable and add nothing; null values do not make
a field present; a field whose types tie has the first of string, integer, float, boolean, array, object; a
feed's first file has no changes; repeated lines weigh as often as they occur; a file without a readable line has
no fields, so everything of the file before is removed.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.session import spread, stash

#: Hash buckets for content tokens of one field.
BUCKETS = 1024
#: Least overlap of the token histograms of a renamed field, between 0 and 1.
SAME_CONTENT = 0.3
#: The same for objects, whose inner structure alone makes up about half of it.
SAME_OBJECT = 0.64
TYPES = ("string", "integer", "float", "boolean", "array", "object")
_PIECES = re.compile(r"[^\W\d_]+|\d+")


def json_type(v: object) -> str:
    return "boolean" if isinstance(v, bool) else {str: "string", int: "integer", float: "float", list: "array", dict: "object"}[type(v)]


def content_tokens(v: object, depth: int = 0) -> list[str]:
    """What the value looks like: its words, its digit runs by length and first digit, its parts' tokens."""
    if isinstance(v, bool):
        return [f"b{v}"]
    if isinstance(v, int | float):
        sign, text = "-" if v < 0 else "", f"{abs(v):.0f}" if abs(v) < 1e300 else "huge"
        return [f"n{sign}{len(text)}", f"n{sign}{len(text)}{'low' if text < '2' else 'mid' if text < '5' else 'high'}"]
    if isinstance(v, str):
        return [f"d{len(p)}:{p[0]}" if p[0].isdigit() else "w" + p.lower() for p in _PIECES.findall(v)] or ["empty"]
    if depth > 50:
        return ["deep"]
    if isinstance(v, list):
        return [t for x in v if x is not None for t in content_tokens(x, depth + 1)] or ["none"]
    return [f"k{k}/{t}" for k, x in v.items() if x is not None for t in content_tokens(x, depth + 1)] or ["none"]


def file_statistics(df: DataFrame, feed: str = "feed", file_no: str = "file_no", body: str = "body") -> DataFrame:
    """(feed, file_no, field, type, token, weight): per file the values of each field and type (token -1: their
    number) and their content tokens, weighted so that every value counts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for f, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                if not isinstance(value, dict):
                    continue
                for k, v in value.items():
                    if v is None:
                        continue
                    kind = json_type(v)
                    seen[f, n, k, kind, -1] += 1.0
                    tokens = content_tokens(v)
                    for t in tokens:
                        seen[f, n, k, kind, zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS] += 1.0 / len(tokens)
                if len(seen) > 200_000:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        cols = list(zip(*seen, strict=True))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(seen.values(), pa.float64())], names=["feed", "file_no", "field", "type", "token", "weight"])

    slim = df.select(F.col(feed).alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(body).alias("body")).filter("feed IS NOT NULL AND file_no IS NOT NULL")
    local = spread(slim).mapInArrow(run, "feed string, file_no int, field string, type string, token int, weight double")
    return local.groupBy("feed", "file_no", "field", "type", "token").agg(F.sum("weight").alias("weight"))


def _type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), kind)


def file_fields(stats: DataFrame) -> DataFrame:
    """(feed, file_no, field, type, n, of_type): the fields of each file with the type of most of their values, the number of values and
    that of this type."""
    counts = stats.filter("token = -1")
    best = F.max(F.struct("weight", (-_type_rank(F.col("type"))).alias("rank"), "type")).alias("best")
    grouped = counts.groupBy("feed", "file_no", "field").agg(best, F.sum("weight").cast("long").alias("n"))
    return grouped.select("feed", "file_no", "field", "best.type", "n", F.col("best.weight").alias("of_type"))


def file_changes(df: DataFrame, feed: str = "feed", file_no: str = "file_no", body: str = "body", same_content: float = SAME_CONTENT, same_object: float = SAME_OBJECT, stats: DataFrame | None = None) -> DataFrame:
    """(feed, file_no, change_kind, old_name, new_name): the changes of each file against the one before it."""
    stats = stash(file_statistics(df, feed, file_no, body), "statistics") if stats is None else stats
    files = df.select(F.col(feed).alias("feed"), F.col(file_no).cast("int").alias("file_no")).filter("feed IS NOT NULL AND file_no IS NOT NULL").distinct()
    in_order = W.partitionBy("feed").orderBy("file_no")
    files = files.withColumn("next_no", F.lead("file_no").over(in_order)).withColumn("last_no", F.lag("file_no").over(in_order))
    # Each field stands for itself in its file and as the old one in the next; both meet in one aggregation.
    state = F.struct("type", "of_type", F.col("file_no").alias("at")).alias("state")
    roles = F.explode(F.array(F.struct(F.when(F.col("last_no").isNotNull(), F.col("file_no")).alias("of"), F.lit(False).alias("old")), F.struct(F.col("next_no").alias("of"), F.lit(True).alias("old")))).alias("role")
    met = file_fields(stats).join(files, ["feed", "file_no"]).select("feed", "field", state, roles).filter("role.of IS NOT NULL")
    met = met.groupBy("feed", F.col("role.of").alias("file_no"), "field").agg(F.max(F.when(F.col("role.old"), F.col("state"))).alias("was"), F.max(F.when(~F.col("role.old"), F.col("state"))).alias("now"))
    both = stash(met.filter("was IS NULL OR now IS NULL OR was.type <> now.type"), "changed")
    retyped = both.filter("was IS NOT NULL AND now IS NOT NULL").select("feed", "file_no", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_name"), F.col("field").alias("new_name"))
    alone = both.filter("was IS NULL OR now IS NULL").select("feed", "file_no", F.col("field").alias("name"), F.col("now").isNull().alias("gone"), F.coalesce("was", "now").alias("state"))

    # The shares of the tokens of fields that are gone and of new ones meet under the token; a value's tokens weigh one together.
    wanted = alone.select("feed", F.col("state.at").alias("at"), F.col("name").alias("field"), "state.type", "file_no", "gone", "state.of_type")
    tokens = stats.filter("token >= 0").withColumnRenamed("file_no", "at").join(wanted, ["feed", "at", "field", "type"]).select("feed", "file_no", "type", "token", "gone", F.struct(F.col("field").alias("name"), (F.col("weight") / F.col("of_type")).alias("share")).alias("entry"))
    shared = tokens.groupBy("feed", "file_no", "type", "token").agg(F.collect_list(F.when(F.col("gone"), F.col("entry"))).alias("old"), F.collect_list(F.when(~F.col("gone"), F.col("entry"))).alias("new")).filter("size(old) > 0 AND size(new) > 0")
    pairs = shared.select("feed", "file_no", "type", F.explode("old").alias("o"), "new").select("feed", "file_no", "type", "o", F.explode("new").alias("w"))
    alike = pairs.groupBy("feed", "file_no", "type", F.col("o.name").alias("old_name"), F.col("w.name").alias("new_name")).agg(F.round(F.sum(F.least("o.share", "w.share")), 6).alias("overlap"))
    alike = alike.filter(F.col("overlap") >= F.when(F.col("type") == "object", same_object).otherwise(same_content))
    # The closest pair first; a name that has its partner takes no other.
    ranked = alike.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("far"), "old_name", "new_name"))).alias("pairs"))
    kept = F.aggregate("pairs", F.expr("CAST(array() AS array<struct<far: double, old_name: string, new_name: string>>)"), lambda acc, p: F.when(F.exists(acc, lambda q: (q["old_name"] == p["old_name"]) | (q["new_name"] == p["new_name"])), acc).otherwise(F.concat(acc, F.array(p))))
    renamed = stash(ranked.select("feed", "file_no", F.explode(kept).alias("p")).select("feed", "file_no", F.lit("renamed").alias("change_kind"), "p.old_name", "p.new_name"), "renamed")
    partners = renamed.select("feed", "file_no", F.col("old_name").alias("name"), F.lit(True).alias("gone")).unionByName(renamed.select("feed", "file_no", F.col("new_name").alias("name"), F.lit(False).alias("gone")))
    rest = alone.join(partners, ["feed", "file_no", "name", "gone"], "left_anti")
    rest = rest.select("feed", "file_no", F.when(F.col("gone"), "removed").otherwise("added").alias("change_kind"), F.when(F.col("gone"), F.col("name")).otherwise("").alias("old_name"), F.when(F.col("gone"), "").otherwise(F.col("name")).alias("new_name"))
    return retyped.unionByName(renamed).unionByName(rest)


def canonical_names(changes: DataFrame) -> DataFrame:
    """(feed, from_no, name, canonical): under which name a renamed field runs, from which file on. The changes of
    a feed are as many as its fields change, so they are folded feed by feed."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}
        out = []
        for n, part in pdf.sort_values(["file_no", "old_name"]).groupby("file_no"):
            step = {b: root.get(a, a) for a, b in zip(part.old_name, part.new_name, strict=True)}
            root.update(step)
            out += [(pdf.feed.iloc[0], n, b, c) for b, c in step.items()]
        return pd.DataFrame(out, columns=["feed", "from_no", "name", "canonical"])

    return changes.filter("change_kind = 'renamed'").groupBy("feed").applyInPandas(fold, "feed string, from_no int, name string, canonical string")


def derived_schema(stats: DataFrame, changes: DataFrame, preferred: Sequence[str] = (), most: int = 1000) -> tuple[dict[str, str], dict[str, str]]:
    """The columns of one table of all feeds with their types, and the column of each field name.

    Names that any feed has renamed into one another, which the content of the fields decides, are one column. It has
    the first of the ``preferred`` names among them, else that of most values, and the type of most of its values
    (arrays and objects as JSON text). Fields beyond the ``most`` frequent, names that only case tells from a more
    frequent column, and those of the table's own columns get no column and stay in its map.
    """
    rows = stats.filter("token = -1").groupBy("field").pivot("type", list(TYPES)).agg(F.sum("weight")).fillna(0.0)
    rows = rows.orderBy(F.desc(sum(F.col(t) for t in TYPES)), "field").limit(most).collect()
    count = {r.field: [r[t] for t in TYPES] for r in rows}
    root: dict[str, str] = {}

    def find(name: str) -> str:
        while name in root:
            name = root[name]
        return name

    pairs = changes.filter("change_kind = 'renamed'").select("old_name", "new_name").distinct()
    for a, b in sorted((r.old_name, r.new_name) for r in pairs.filter(F.col("old_name").isin(list(count)) & F.col("new_name").isin(list(count))).collect()):
        if find(a) != find(b):
            root[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for name in count:
        groups.setdefault(find(name), []).append(name)
    schema: dict[str, str] = {}
    column: dict[str, str] = {}
    taken = {"record_id", "feed", "file_no", "line_no", "failed_casts", "rest"}
    for names in groups.values():
        name = next((p for p in preferred if p in names), names[0])
        if name.lower() in taken:
            continue
        taken.add(name.lower())
        n = dict(zip(TYPES, map(sum, zip(*(count[x] for x in names), strict=True)), strict=True))
        kind = max(TYPES, key=lambda t: n[t])
        numeric = "double" if n["float"] > 0.01 * sum(n.values()) else "bigint"
        schema[name] = {"integer": numeric, "float": "double", "boolean": "boolean"}.get(kind, "string")
        column |= dict.fromkeys(names, name)
    return schema, column


def unified_feed_table(df: DataFrame, changes: DataFrame, schema: dict[str, str], column: dict[str, str] | None = None) -> DataFrame:
    """(record_id, feed, file_no, line_no, one typed column per field, failed_casts, rest): all readable lines in one table.

    A field that was renamed in its feed runs under its first name, and that in the column that ``column`` gives it.
    ``schema`` gives the wanted fields and types; a value that cannot be cast is null and listed in ``failed_casts`` as
    ``field=value``. Of several names of one field in a line, the one that sorts first counts. ``rest`` has every
    value that is in no column, under its own name.
    """
    names = canonical_names(changes)
    last = F.coalesce(F.lead("from_no").over(W.partitionBy("feed", "name").orderBy("from_no")) - 1, F.lit(2**31 - 1))
    names = names.withColumn("to_no", last)
    raw = df.select("record_id", "feed", F.col("file_no").cast("int").alias("file_no"), "line_no", F.from_json("body", "map<string,string>").alias("m")).filter("m IS NOT NULL")
    files = raw.select("feed", "file_no").distinct()
    ranges = files.join(names, (files.feed == names.feed) & (files.file_no >= names.from_no) & (files.file_no <= names.to_no)).groupBy(files.feed, files.file_no).agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("renamed"))
    lines = raw.join(ranges, ["feed", "file_no"], "left")
    none = F.expr("map()").cast("map<string,string>")
    known = F.create_map(*[F.lit(x) for pair in column.items() for x in pair]) if column else none
    first = lambda k: F.coalesce(F.element_at(F.coalesce("renamed", none), k), k)
    entry = lambda e: F.struct(F.coalesce(F.element_at(known, first(e["key"])), first(e["key"])).alias("field"), e["key"].alias("name"), e["value"].alias("value"))
    lines = lines.withColumn("entries", F.array_sort(F.transform(F.filter(F.map_entries("m"), lambda e: e["value"].isNotNull()), entry)))
    before = lambda i, part: F.get(F.col("entries"), i - 1)[part]
    is_rest = lambda e, i: (~e["field"].isin(list(schema)) | before(i, "field").eqNullSafe(e["field"])) & ~before(i, "name").eqNullSafe(e["name"])
    own = lambda name: F.get(F.filter("entries", lambda e: e["field"] == name), F.lit(0))["value"]
    cols, failed = [], []
    for name, kind in schema.items():
        value = own(name)
        cast = value.try_cast(kind)
        cols.append(cast.alias(name))
        failed.append(F.when(value.isNotNull() & cast.isNull(), F.concat(F.lit(name + "="), value)))
    rest = F.map_from_entries(F.transform(F.filter("entries", is_rest), lambda e: F.struct(e["name"], e["value"])))
    return lines.select("record_id", "feed", "file_no", "line_no", *cols, F.array_compact(F.array(*failed)).alias("failed_casts"), rest.alias("rest"))
