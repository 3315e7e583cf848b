"""Documents as chunks: windows, recursive splitting, headings and assembly."""

from __future__ import annotations

import html
import html.parser
import re
import zipfile
from collections.abc import Iterator, Sequence
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.session import spread

SIZE, OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
HEADINGS = ("title", "heading", "header", "sectionheader")


def step_of(size: int = SIZE, overlap: int = OVERLAP) -> int:
    return max(1, size - min(overlap, size // 2))


def fixed_windows(df: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(ident, chunk_index, start, chunk): windows of ``size`` characters every ``size`` less the overlap, whose outer blanks are
    cut; empty ones are left out and do not count in the index. Null and empty texts have no window."""
    step = step_of(size, overlap)
    starts = F.sequence(F.lit(1), F.length(text), F.lit(step))
    rows = df.filter(F.length(text) > 0).select(ident, F.explode(F.filter(F.transform(starts, lambda p: F.struct(p.alias("start"), F.trim(F.substring(F.col(text), p, F.lit(size))).alias("chunk"))), lambda s: s["chunk"] != "")).alias("w"))
    place = F.row_number().over(W.partitionBy(ident).orderBy("w.start")) - 1
    return rows.select(ident, place.alias("chunk_index"), (F.col("w.start") - 1).alias("start"), "w.chunk")


def recursive_split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, split at the coarsest separator that occurs, finer ones only inside parts that are
    still too long; neighbours share up to ``overlap`` characters of whole parts."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark == "":
        step = max(1, size - overlap)
        return [c for i in range(0, max(1, len(text) - overlap), step) if (c := text[i : i + size].strip())]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = mark.join(held).strip()
        if joined:
            out.append(joined)

    for part in text.split(mark):
        if len(part) > size:
            flush()
            held = []
            out.extend(recursive_split(part, size, overlap, finer or ("",)))
            continue
        if held and sum(map(len, held)) + len(mark) * len(held) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) + len(mark) * (len(held) - 1) > overlap or sum(map(len, held)) + len(mark) * len(held) + len(part) > size):
                held = held[1:]
        held.append(part)
    flush()
    return out


def recursive_chunks(df: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(ident, chunk_index, chunk): the recursive split of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, c) for i, t in zip(f[ident], f[text], strict=True) if t for k, c in enumerate(recursive_split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[ident, "chunk_index", "chunk"])

    return spread(df.select(ident, text)).mapInPandas(run, f"{ident} {dict(df.dtypes)[ident]}, chunk_index int, chunk string")


def with_headings(elements: DataFrame, group: str, order: str, category: str, text: str, block: int = 100_000) -> DataFrame:
    """All columns and ``heading``: the last heading before or at each element of its group.

    With a whole-number ``order`` a group is cut into blocks of so many numbers, each a group of its own; what the blocks before
    leave behind, one heading per block, is carried over them in a small table. A group with a third of all rows is many tasks.
    """
    is_heading = F.lower(F.coalesce(category, F.lit(""))).isin(*HEADINGS)
    if dict(elements.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint"):
        own = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return elements.withColumn("heading", F.last(F.when(is_heading, F.col(text)), ignorenulls=True).over(own))
    rows = elements.withColumn("__block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62))).cast("bigint")).withColumn("__own", F.when(is_heading, F.col(text)))
    last = rows.groupBy(F.col(group).alias("__group"), "__block").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col(order))).alias("__last"))
    before = W.partitionBy("__group").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).filter("__carried IS NOT NULL").select("__group", F.col("__block").alias("__of"), "__carried")
    inside = W.partitionBy(group, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = rows.withColumn("__inside", F.last("__own", ignorenulls=True).over(inside)).join(carried, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__block") == F.col("__of")), "left")
    return filled.select(*[F.col(f"`{c}`") for c in elements.columns if c != "heading"], F.coalesce("__inside", "__carried").alias("heading"))


def assembled(elements: DataFrame, group: str = "asset_id", order: str = "seq", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(group, chunk_index, text, parent_heading, page_number, element_type) from elements (group, seq, category, text,
    page): headings give context and are no chunks; the others are split and numbered through."""
    rows = with_headings(elements, group, order, "category", "text").filter(~F.lower(F.coalesce("category", F.lit(""))).isin(*HEADINGS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(g, o, k, c, h, p, e) for g, o, h, p, e, t in zip(f[group], f[order], f.heading, f.page, f.category, f.text, strict=True) if t for k, c in enumerate(recursive_split(t, size, overlap))]
            yield pd.DataFrame(out, columns=[group, order, "part", "text", "parent_heading", "page_number", "element_type"])

    kinds = dict(rows.dtypes)
    split = rows.select(group, order, "heading", "page", "category", "text").mapInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, part int, text string, parent_heading string, page_number {kinds['page']}, element_type string")
    place = F.row_number().over(W.partitionBy(group).orderBy(order, "part")) - 1
    return split.select(group, place.alias("chunk_index"), "text", "parent_heading", "page_number", "element_type")


def headings_in_order(df: DataFrame, group: str, order: str, heading: str) -> DataFrame:
    """(group, headings): the distinct headings of a group in order of first appearance."""
    first = df.filter(F.col(heading).isNotNull()).groupBy(group, heading).agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(heading).alias("h")))), lambda s: s["h"]).alias("headings"))


class _Elements(html.parser.HTMLParser):
    KINDS = {"h1": "Title", "h2": "Heading", "h3": "Heading", "h4": "Heading", "p": "NarrativeText", "li": "ListItem", "td": "Table", "th": "Table", "title": "Title", "pre": "NarrativeText", "blockquote": "NarrativeText"}
    SKIP = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.held, self.skip = "NarrativeText", "", 0

    def close_element(self) -> None:
        text = re.sub(r"\s+", " ", self.held).strip()
        if text:
            self.out.append((self.kind, text))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.KINDS or tag in ("div", "section", "br", "tr", "ul", "ol", "table"):
            self.close_element()
            self.kind = self.KINDS.get(tag, "NarrativeText")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.KINDS or tag in ("div", "section", "tr", "table"):
            self.close_element()
            self.kind = "NarrativeText"

    def handle_data(self, data):
        if not self.skip:
            self.held += data


def parse_elements(content: bytes, extension: str) -> list[tuple[str, str]]:
    """(category, text) of a document's blocks: plain text, Markdown, HTML and the text of DOCX; other formats are an
    error until a parser is plugged in."""
    if extension in (".txt", ".md", ".html", ".htm", ""):
        text = content.decode("utf-8", "replace")
        if extension in (".html", ".htm"):
            p = _Elements()
            p.feed(text)
            p.close_element()
            return p.out
        out = []
        for block in re.split(r"\n\s*\n", text):
            block = block.strip()
            mark = re.match(r"#{1,6}\s+", block) if extension == ".md" else None
            if block:
                lines = block.split("\n", 1)
                if mark:
                    out.append(("Title", lines[0][mark.end() :].strip()))
                    if len(lines) > 1 and lines[1].strip():
                        out.append(("NarrativeText", lines[1].strip()))
                else:
                    out.append(("ListItem" if re.match(r"[-*+] ", block) else "NarrativeText", block))
        return out
    if extension == ".docx":
        with zipfile.ZipFile(BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
        out = []
        for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
            text = "".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)).strip()
            if text:
                out.append(("Title" if re.search(r'<w:pStyle w:val="(?:Title|Heading)', p) else "NarrativeText", html.unescape(text)))
        return out
    raise ValueError(f"no parser for {extension}")


def embedded_media(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the media members of a DOCX or PPTX archive; unreadable archives have none."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if re.match(r"(?:word|ppt)/media/", n)]
    except zipfile.BadZipFile:
        return []


def elements(files: DataFrame) -> DataFrame:
    """(path, seq, category, text, page, error) from (path, content); a document that cannot be parsed is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                ext = "." + path.rsplit(".", 1)[1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                try:
                    rows += [(path, i, c, t, None, None) for i, (c, t) in enumerate(parse_elements(content, ext))]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, 0, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "seq", "category", "text", "page", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, seq int, category string, text string, page int, error string")
