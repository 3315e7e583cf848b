"""Columnar shredding of nested JSON records, and flat tables rebuilt from the levels.

:func:`shred` turns every record into one column per leaf path. A leaf path names the fields from the root, with
``[]`` behind each field that holds an array, as in ``items[].components[].product_id``. A column is three
arrays of equal length: the repetition level says at which array a new element starts, the definition level how
much of the path exists, and the value is the leaf's text. The levels alone determine where every value stood, so
:func:`rebuild` gets the positions back from them, and :func:`flat_table` the table of any repeated ancestor with
the link to its parent. Nothing else of the record is needed and no record is ever joined with another.

Defined cases: a body that is null, no JSON, or nested deeper than the parser allows gives no row (see
:func:`unreadable`); text that encodes an object or array counts as what it encodes, at any depth; numbers keep
the notation of the body; of a name repeated in an object the last one counts; empty objects and arrays are leaves
without a value. Records count by themselves, so repeated records give repeated rows under their own id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import spread, stash


class Number(str):
    """A JSON number in its own notation."""


def _refuse(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse, strict=False)


def decode(text: str | None) -> object:
    """The value that ``text`` denotes, with encoded objects and arrays inside decoded too; raises ValueError."""
    if text is None:
        raise ValueError("null")
    try:
        return unfold(_DECODER.decode(text.lstrip("﻿")))
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def unfold(value: object) -> object:
    if isinstance(value, str) and not isinstance(value, Number) and value.lstrip()[:1] in ("{", "["):
        try:
            value = _DECODER.decode(value)
        except ValueError:
            return value
    if isinstance(value, dict):
        return {k: unfold(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unfold(v) for v in value]
    return value


def as_text(value: object) -> str:
    return value if isinstance(value, str) else "true" if value is True else "false"


Step = str | None  # a field's name, or None for the elements of an array


class _Node:
    """A step of the leaf paths of a record: the column that ends here, if any, the steps that follow, and all columns from here on."""

    __slots__ = ("column", "kids", "below")

    def __init__(self) -> None:
        self.column: tuple[list[int], list[int], list[str | None]] | None = None
        self.kids: dict[Step, _Node] = {}
        self.below: list[tuple] = []


def columns(value: object, roots: Sequence[Sequence[str]] = (), objects: bool = False) -> dict[tuple[Step, ...], tuple[list[int], list[int], list[str | None]]]:
    """The leaf paths of a value, in order of first appearance, each with its repetition levels, definition levels and values.

    Each field that is there and not null adds one to the definition level, so does each element of an array, null or not; a last
    one, behind an array, stands for an element that is not null, or anywhere, without a value, for an object. One
    walk finds the paths, a second one fills all columns. With ``roots`` only paths below these fields, with ``objects`` those of objects too.
    """
    found: dict[tuple[Step, ...], tuple] = {}
    top = _Node()

    def add(node: _Node, path: tuple[Step, ...]) -> None:
        if node.column is None:
            node.column = found[path] = ([], [], [])

    def visit(v: object, node: _Node, path: tuple[Step, ...]) -> None:
        if isinstance(v, dict) and v:
            if objects:
                add(node, path)
            for k, x in v.items():
                visit(x, node.kids.setdefault(k, _Node()), (*path, k))
        elif isinstance(v, list) and v:
            kid = node.kids.setdefault(None, _Node())
            for x in v:
                visit(x, kid, (*path, None))
        else:
            add(node, path)

    if roots:
        for root in roots:
            v, node = value, top
            for k in root:
                if not isinstance(v, dict) or k not in v:
                    break
                v, node = v[k], node.kids.setdefault(k, _Node())
            else:
                visit(v, node, tuple(root))
    else:
        visit(value, top, ())

    def gather(node: _Node) -> list[tuple]:
        node.below = [*([node.column] if node.column else []), *(c for kid in node.kids.values() for c in gather(kid))]
        return node.below

    gather(top)

    def absent(node: _Node, r: int, d: int) -> None:
        for reps, defs, values in node.below:
            reps.append(r)
            defs.append(d)
            values.append(None)

    def walk(v: object, node: _Node, r: int, d: int, arrays: int, element: bool) -> None:
        if node.column is not None:
            reps, defs, values = node.column
            reps.append(r)
            empty = v is None or isinstance(v, dict | list)
            defs.append(d + (isinstance(v, dict) if empty else element))
            values.append(None if empty else as_text(v))
        for step, kid in node.kids.items():
            if step is None:
                if isinstance(v, list) and v:
                    for j, x in enumerate(v):
                        walk(x, kid, arrays + 1 if j else r, d + 1, arrays + 1, True)
                else:
                    absent(kid, r, d)
            elif isinstance(v, dict) and v.get(step) is not None:
                walk(v[step], kid, r, d + 1, arrays, False)
            else:
                absent(kid, r, d)

    walk(value, top, 0, 0, 0, False)
    return found


def leaf_paths(value: object, objects: bool = False) -> list[tuple[Step, ...]]:
    """The distinct leaf paths of a value, in order of first appearance; with ``objects`` also those of its objects."""
    return list(columns(value, objects=objects))


def levels(value: object, path: Sequence[Step]) -> tuple[list[int], list[int], list[str | None]]:
    """Repetition levels, definition levels and values of one leaf path."""
    return columns(value)[tuple(path)]


def path_text(path: Sequence[Step], positions: Sequence[int] | None = None) -> str:
    """``a.b[].c``, or with positions ``a.b[2].c``."""
    out, k = "", 0
    for step in path:
        if step is None:
            out += "[]" if positions is None else f"[{positions[k]}]"
            k += 1
        else:
            out += ("." if out else "") + step
    return out


SHREDDED = "steps array<string>, leaf_path string, reps array<int>, defs array<int>, leaf_values array<string>"


def shred(df: DataFrame, record: str = "record_id", body: str = "body", roots: Sequence[Sequence[str]] = (), objects: bool = False) -> DataFrame:
    """(record_id, steps, leaf_path, reps, defs, leaf_values): one row per record and leaf path. ``steps`` are the
    names of the path, null for the elements of an array. With ``roots``, only leaves below these fields; with ``objects`` every object
    has a column too."""
    schema = pa.schema([("record_id", pa.string()), ("steps", pa.list_(pa.string())), ("leaf_path", pa.string()), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("leaf_values", pa.list_(pa.string()))])
    wanted = [tuple(r) for r in roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(rid, list(p), path_text(p), *c) for p, c in columns(decode(text), wanted, objects).items()]
                except (ValueError, RecursionError):
                    continue
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spread(df.select(F.col(record).cast("string").alias("record_id"), F.col(body).alias("body"))).mapInArrow(run, "record_id string, " + SHREDDED)


def unreadable(df: DataFrame, record: str = "record_id", body: str = "body") -> DataFrame:
    """(record_id): the records whose body :func:`shred` cannot read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    decode(text)
                except (ValueError, RecursionError):
                    bad.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["record_id"])

    return df.select(F.col(record).cast("string").alias("record_id"), F.col(body).alias("body")).mapInArrow(run, "record_id string")


def positions(path: Sequence[Step], reps: Sequence[int], defs: Sequence[int]) -> list[list[int] | None]:
    """The array positions of each entry, from its levels alone; None where the path's last array has no element."""
    thresholds = [i + 1 for i, step in enumerate(path) if step is None]
    at = [0] * len(thresholds)
    out: list[list[int] | None] = []
    for r, d in zip(reps, defs, strict=True):
        if r == 0:
            at = [0] * len(thresholds)
        else:
            at[r - 1] += 1
            at[r:] = [0] * (len(thresholds) - r)
        out.append(list(at) if not thresholds or d >= thresholds[-1] else None)
    return out


def rebuild(shredded: DataFrame, name: str | None = None) -> DataFrame:
    """(record_id, node_path, leaf_path, row_path, row_positions, leaf_value): each leaf that has a value, at its place.

    ``row_path`` is the element of the innermost array around the leaf (empty for the record itself), which names
    the row of the flat table that the leaf belongs to. ``name`` keeps only leaves of this field.
    """
    schema = pa.schema([("record_id", pa.string()), ("node_path", pa.string()), ("leaf_path", pa.string()), ("row_path", pa.string()), ("row_positions", pa.list_(pa.int32())), ("leaf_value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, steps, leaf, reps, defs, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = max((i + 1 for i, s in enumerate(steps) if s is None), default=0)
                for at, v in zip(positions(steps, reps, defs), values, strict=True):
                    if at is not None and v is not None:
                        rows.append((rid, path_text(steps, at), leaf, path_text(steps[:last], at), at, v))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    rows = shredded if name is None else shredded.filter(F.element_at("steps", -1) == name)
    return rows.mapInArrow(run, "record_id string, node_path string, leaf_path string, row_path string, row_positions array<int>, leaf_value string")


def flat_table(shredded: DataFrame, fields: Sequence[str], below: str = "") -> DataFrame:
    """(record_id, row_path, parent_path, place, one column per field): the flat table of the rows below ``below``,
    with the path of the row that holds each row (empty if the record does) and its place there.

    A row is whatever holds a value of ``fields``, every element of an array around it, and, of a table shredded with
    ``objects``, every object where some record has such a holder or element; ``fields`` may all be null in it.
    """
    schema = pa.schema([("record_id", pa.string()), ("row_path", pa.string()), ("shape", pa.string()), ("around", pa.list_(pa.string())), ("field", pa.string()), ("leaf_value", pa.string())])
    wanted = set(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, steps, reps, defs, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = max((i for i, x in enumerate(steps) if x is not None), default=-1)
                field = steps[f] if f >= 0 and steps[f] in wanted else None
                arrays = [k for k in range(1, f) if steps[k - 1] is None] if field else []

                def row(k: int, at: list[int], name: str | None, v: str | None) -> None:
                    around = [path_text(steps[:i], at) for i in range(k - 1, 0, -1)]  # noqa: B023
                    rows.append((rid, path_text(steps[:k], at), path_text(steps[:k]), around, name, v))  # noqa: B023

                if field:  # where such rows may stand, whether this record has any or not
                    rows += [(None, None, path_text(steps[:k]), None, None, None) for k in {*arrays, f}]
                for at, d, v in zip(positions(steps, reps, defs), defs, values, strict=True):
                    if at is not None and v is not None and field:
                        row(f, at, field, v)
                        for k in arrays:
                            row(k, at, None, None)
                    elif at is not None and v is None and d > len(steps):
                        row(len(steps), at, None, None)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = shredded.filter(F.col("leaf_path").startswith(below)) if below else shredded
    found = stash(found.select("record_id", "steps", "reps", "defs", "leaf_values").mapInArrow(run, "record_id string, row_path string, shape string, around array<string>, field string, leaf_value string"), "flat")
    rows = found.filter("row_path IS NOT NULL").join(found.filter("row_path IS NULL").select("shape").distinct(), "shape", "left_semi")
    rows = rows.groupBy("record_id", "row_path").agg(F.first("around").alias("around"), *[F.min(F.when(F.col("field") == f, F.col("leaf_value"))).alias(f"value_{i}") for i, f in enumerate(fields)])
    up = rows.select("record_id", "row_path", F.posexplode("around").alias("far", "parent_path"))
    up = up.join(rows.select("record_id", F.col("row_path").alias("parent_path")), ["record_id", "parent_path"], "left_semi").groupBy("record_id", "row_path").agg(F.min_by("parent_path", "far").alias("parent_path"))
    place = F.expr("try_cast(regexp_extract(row_path, '\\\\[(\\\\d+)\\\\]$', 1) AS INT)")
    return rows.join(up, ["record_id", "row_path"], "left").select("record_id", "row_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), place.alias("place"), *[F.col(f"value_{i}").alias(f) for i, f in enumerate(fields)])
