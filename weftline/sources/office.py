"""Office files to Markdown and to nodes, a batch of files at a time, with guards against archives
that unpack to far more than they hold."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed limits: bytes of one part and of all parts unpacked, their share of the packed size, parts.
MOST_PART, MOST_ALL, MOST_RATIO, MOST_PARTS = 50_000_000, 200_000_000, 200, 5000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PAGE = "path string, state string, text string"
PART = "path string, kind string, name string, within string, line int"


class Refused(ValueError):
    """An archive over a limit, or a part that declares entities."""


def opened(content: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(content))
    infos = archive.infolist()
    total = sum(i.file_size for i in infos)
    if len(infos) > MOST_PARTS or total > MOST_ALL or any(i.file_size > MOST_PART for i in infos):
        raise Refused("too large")
    if total > MOST_RATIO * max(1, sum(i.compress_size for i in infos)):
        raise Refused("unpacks to too much")
    return archive


def parsed(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    with archive.open(name) as part:
        raw = part.read(MOST_PART + 1)  # a header may lie about the size
    if len(raw) > MOST_PART or b"<!ENTITY" in raw:
        raise Refused("too large or declares entities")
    return ElementTree.fromstring(raw)


def docx_markdown(content: bytes) -> str:
    """Paragraphs, headings by style, lists and tables of a text document."""
    root = parsed(opened(content), "word/document.xml")
    body = root.find(f"{W}body") if root is not None else None
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{W}t"))
    out = []
    for x in body if body is not None else ():
        if x.tag == f"{W}p":
            style = x.find(f"{W}pPr/{W}pStyle")
            kind = style.get(f"{W}val", "") if style is not None else ""
            text = said(x).strip()
            if text:
                level = re.match(r"Heading([1-6])", kind)
                out.append(f"{'#' * int(level[1])} {text}" if level else f"# {text}" if kind == "Title" else f"- {text}" if kind.startswith("List") else text)
        elif x.tag == f"{W}tbl":
            rows = [[said(c).strip() for c in r.findall(f"{W}tc")] for r in x.findall(f"{W}tr")]
            out.append(table_markdown(rows))
    return "\n\n".join(x for x in out if x)


def table_markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Names and rows of a workbook's sheets, cells in their columns."""
    archive = opened(content)
    book, links = parsed(archive, "xl/workbook.xml"), parsed(archive, "xl/_rels/workbook.xml.rels")
    shared = parsed(archive, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in x.iter(f"{S}t")) for x in shared.findall(f"{S}si")] if shared is not None else []
    targets = {x.get("Id"): x.get("Target", "") for x in links} if links is not None else {}
    for sheet in book.iter(f"{S}sheet") if book is not None else ():
        target = targets.get(sheet.get(f"{R}id"), "")
        root = parsed(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows = []
        for row in root.iter(f"{S}row") if root is not None else ():
            cells: list[str] = []
            for c in row.findall(f"{S}c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) if letters else len(cells) + 1
                cells += [""] * (min(at, 16_384) - len(cells))
                value = c.find(f"{S}v")
                text = (value.text or "") if value is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                cells[-1] = strings[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(strings) else text
            rows.append(cells)
        yield sheet.get("name", ""), rows


def xlsx_markdown(content: bytes) -> str:
    parts = []
    for name, rows in sheets(content):
        filled = [r for r in rows if any(r)]
        width = max(map(len, filled), default=0)
        parts.append(f"## {name}\n\n" + table_markdown([r + [""] * (width - len(r)) for r in filled]))
    return "\n\n".join(parts).strip()


READERS = {"docx": docx_markdown, "xlsx": xlsx_markdown}


def to_markdown(files: DataFrame) -> DataFrame:
    """path, state (ok or why not) and text of files (path, content) by their extension; others and
    null contents give no row, broken archives a row without text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                reader = READERS.get(path.rsplit(".", 1)[-1].lower()) if path and content is not None else None
                if reader:
                    try:
                        rows.append((path, "ok", reader(bytes(content))))
                    except Refused as e:
                        rows.append((path, str(e), None))
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError) as e:
                        rows.append((path, f"broken: {type(e).__name__}", None))
            yield pd.DataFrame(rows, columns=["path", "state", "text"])

    return files.select("path", "content").mapInPandas(run, PAGE)


def workbook_parts(files: DataFrame) -> DataFrame:
    """path, kind (sheet or column), name, within, line: sheets of workbooks and the columns that their
    first filled row names. Broken and refused files give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if path and content is not None and path.lower().endswith(".xlsx"):
                    try:
                        found = list(sheets(bytes(content)))
                    except (Refused, zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError):
                        continue
                    for name, table in found:
                        rows.append((path, "sheet", name, None, 1))
                        line, head = next(((i, r) for i, r in enumerate(table, 1) if any(r)), (0, []))
                        rows += [(path, "column", c, name, line) for c in head if c]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "within", "line"])

    return files.select("path", "content").mapInPandas(run, PART)


def sidecars(converted: DataFrame, present: DataFrame) -> DataFrame:
    """name, path, content of the Markdown files to write: converted (path, time, text) files whose text
    isn't blank, unless a file of the name is present (name, time) that is no older than its source.

    A name is the source's stem and eight digits of the hash of its path below the scan's root, in
    Unicode's composed form, so that it is the same on every machine.
    """

    @F.pandas_udf("string")
    def composed(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p and unicodedata.normalize("NFC", p))

    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat(stem, F.lit("_"), F.substring(F.sha2(composed("path"), 256), 1, 8), F.lit(".md"))
    named = converted.where("path is not null and trim(regexp_replace(text, '[\\\\s]+', ' ')) <> ''").withColumn("name", name)
    have = present.groupBy("name").agg(F.max("time").alias("written"))
    due = named.join(have, "name", "left").where("written is null or written < time")
    content = F.concat(F.lit("<!-- converted from "), F.substring_index("path", "/", -1), F.lit(" -->\n\n"), "text")
    return due.select("name", "path", content.alias("content"))
