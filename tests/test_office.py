"""Office files, written here from their parts."""

import io
import zipfile

from weftline.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def para(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def docx():
    table = "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para("b|c") + "</w:tc></w:tr><w:tr><w:tc>" + para("1") + "</w:tc><w:tc>" + para("2") + "</w:tc></w:tr></w:tbl>"
    body = para("All", "Title") + para("Part", "Heading2") + para("some text") + para("one", "ListParagraph") + table + para(" ")
    return packed(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    links = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    book = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Prices" r:id="r1"/></sheets></workbook>'
    sheet = f'<worksheet {S}><sheetData><row/><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>cost</t></is></c></row><row><c r="A3"><v>7</v></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>'
    shared = f"<sst {S}><si><t>item</t></si></sst>"
    return packed(**{"xl__workbook.xml": book, "xl___rels/workbook.xml.rels": links, "xl__worksheets/sheet1.xml": sheet, "xl__sharedStrings.xml": shared})


def test_documents_and_workbooks(spark):
    bomb = packed(**{"word__document.xml": "0" * 20_000_000})
    entity = packed(**{"word__document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    rows = [("a.docx", docx()), ("b.XLSX", xlsx()), ("c.docx", b"no archive"), ("d.docx", bomb), ("e.docx", entity), ("f.txt", b"x"), ("g.docx", None), (None, b"x"), ("h.docx", packed(x="y"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: (r["state"], r["text"]) for r in office.to_markdown(files).collect()}
    assert got["a.docx"] == ("ok", "# All\n\n## Part\n\nsome text\n\n- one\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |")
    assert got["b.XLSX"] == ("ok", "## Prices\n\n| item |  | cost |\n| --- | --- | --- |\n| 7 |  | 2.5 |")
    assert got["c.docx"][0] == "broken: BadZipFile" and got["d.docx"][0] == "unpacks to too much" and "entities" in got["e.docx"][0] and got["h.docx"] == ("ok", "")
    assert set(got) == {"a.docx", "b.XLSX", "c.docx", "d.docx", "e.docx", "h.docx"}
    parts = sorted((r["kind"], r["name"], r["within"] or "", r["line"]) for r in office.workbook_parts(files).collect())
    assert parts == [("column", "cost", "Prices", 2), ("column", "item", "Prices", 2), ("sheet", "Prices", "", 1)]
    assert office.to_markdown(files.limit(0)).count() == 0
