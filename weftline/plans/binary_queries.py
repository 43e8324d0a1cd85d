"""Queries on office and PDF files, packed here from rows of the tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.office import to_markdown, workbook_parts
from ..sources.pdf import pdf_pages
from .kgview import table
from .registry import query

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(name: str, rows: list) -> bytes:
    styles = ("Heading2", "ListParagraph", "")
    para = lambda text, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text[:5]}</w:t></w:r><w:r><w:t>{text[5:]}</w:t></w:r></w:p>'
    body = para(f"Talk {name}", "Title") + "".join(para(r["b"], styles[r["k"] % 3]) for r in rows)
    if len(rows) > 3:  # a file that unpacks to far more than it holds
        body += "<w:p/>" * 200_000 if int(name) % 50 == 7 else ""
    return _zip({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})[: 60 if int(name) % 50 == 3 else None]


def _xlsx(name: str, rows: list) -> bytes:
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = "".join(f"<row>{cell(f'A{i}', r['a'])}{cell(f'C{i}', r['b'])}</row>" for i, r in enumerate(rows, 3))
    sheet = f"<worksheet {S}><sheetData><row/><row>{cell('A2', 'key')}{cell('C2', 'segment')}</row>{lines}</sheetData></worksheet>"
    book = f'<workbook {S} {R}><sheets><sheet name="Part {name}" r:id="r1"/></sheets></workbook>'
    return _zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet})


def _pdf(name: str, rows: list) -> bytes:
    """A page for each row; of every other file the strings are codes of a font's own and the pages lie in an object stream."""
    own = int(name) % 2 == 0
    said = lambda t: b"<" + b"".join(b"%04X" % (ord(c) + 300) for c in t) + b">" if own else b"(" + t.encode() + b")"
    stream = lambda data, more=b"": b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (more, len(z := zlib.compress(data)), z)
    pages = {10 + 2 * i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i) for i in range(len(rows))}
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % b" ".join(b"%d 0 R" % p for p in pages),
        3: b"<< /Type /Font /ToUnicode 4 0 R >>" if own else b"<< /Type /Font /Encoding /WinAnsiEncoding >>",
        4: stream(b"1 beginbfrange <%04X> <%04X> <0020> endbfrange" % (32 + 300, 126 + 300)),
    }
    objects |= {11 + 2 * i: stream(b"BT /F1 9 Tf 9 700 Td %s Tj 0 -12 Td [%s -300 %s] TJ ET" % tuple(map(said, (r["a"], r["b"][:9], r["b"][9:])))) for i, r in enumerate(rows)}
    if own:
        at, head, bodies = 0, b"", b""
        for n, b in pages.items():
            head, bodies, at = head + b"%d %d " % (n, at), bodies + b + b" ", at + len(b) + 1
        objects[5] = stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(pages), len(head)))
    else:
        objects |= pages
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())


def _files(rows: DataFrame, suffix: str, make: Callable[[str, list], bytes]) -> DataFrame:
    """path, content: a file for each name of rows (name, k, a, b), its rows by k."""

    @F.pandas_udf("binary")
    def content(names: pd.Series, each: pd.Series) -> pd.Series:
        return pd.Series([make(n, list(r)) for n, r in zip(names, each, strict=True)])

    named = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("rows"))
    return named.select(F.concat("name", F.lit(f".{suffix}")).alias("path"), content("name", "rows").alias("content"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn is not null")
    return c.select(F.col("conv_id").cast("string").alias("name"), F.col("turn").cast("int").alias("k"), F.coalesce("role", F.lit("none")).alias("a"), F.md5(F.coalesce("text", F.lit(""))).alias("b"))


TALKS = "t AS (SELECT conv_id AS c, turn::INT AS k, coalesce(role, 'none') AS a, md5(coalesce(text, '')) AS b FROM conversations WHERE turn IS NOT NULL)"


@query(
    "docx_markdown",
    f"""WITH {TALKS}, g AS (SELECT c, count(*) AS n, string_agg(CASE k % 3 WHEN 0 THEN '## ' WHEN 1 THEN '- ' ELSE '' END || b, chr(10) || chr(10) ORDER BY k, a, b) AS body FROM t GROUP BY c)
 SELECT c || '.docx' AS path, CASE WHEN c % 50 = 3 THEN 'broken: BadZipFile' WHEN c % 50 = 7 AND n > 3 THEN 'unpacks to too much' ELSE 'ok' END AS state,
 CASE WHEN c % 50 = 3 OR c % 50 = 7 AND n > 3 THEN NULL ELSE md5('# Talk ' || c || chr(10) || chr(10) || body) END AS sig FROM g""",
)
def docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text documents, some damaged or packed too well, read as Markdown."""
    return to_markdown(_files(_talks(spark, sf_dir), "docx", _docx)).select("path", "state", F.md5("text").alias("sig"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return _files(c.selectExpr("cast(c_custkey div 20 as string) AS name", "cast(c_custkey % 20 as int) AS k", "cast(c_custkey as string) AS a", "c_mktsegment AS b"), "xlsx", _xlsx)


@query(
    "xlsx_markdown",
    """SELECT (c_custkey // 20) || '.xlsx' AS path, md5('## Part ' || (c_custkey // 20) || chr(10) || chr(10) || '| key |  | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' |  | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey)) AS sig FROM customer GROUP BY c_custkey // 20""",
)
def xlsx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks, read as Markdown tables."""
    return to_markdown(_books(spark, sf_dir)).select("path", F.md5("text").alias("sig"))


@query(
    "xlsx_parts",
    """WITH n AS (SELECT DISTINCT c_custkey // 20 AS n FROM customer) SELECT n || '.xlsx' AS path, 'sheet' AS kind, 'Part ' || n AS name, NULL::VARCHAR AS within, 1 AS line FROM n
 UNION ALL SELECT n || '.xlsx', 'column', unnest(['key', 'segment']), 'Part ' || n, 2 FROM n""",
)
def xlsx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of workbooks and the columns that they name."""
    return workbook_parts(_books(spark, sf_dir))


@query(
    "pdf_texts",
    f"""WITH {TALKS} SELECT c || '.pdf' AS path, 'read' AS state, md5(string_agg(a || chr(10) || b[:9] || ' ' || b[10:], chr(10) || chr(10) ORDER BY k, a, b)) AS sig FROM t GROUP BY c""",
)
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as PDF files of two kinds, read as text."""
    return pdf_pages(_files(_talks(spark, sf_dir), "pdf", _pdf)).select("path", "state", F.md5("text").alias("sig"))
