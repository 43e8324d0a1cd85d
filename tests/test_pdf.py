"""Made-up PDFs: two encodings, object streams, page order, damage and bombs."""

import zlib

from weftline.sources.pdf import literal, pdf_pages, pdf_text


def pdf(objects, packed=(), extra=b""):
    """A file of numbered objects, some of them in an object stream, without a cross-reference table."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        bodies = b"".join(b + b" " for _, b in packed)
        at, head = 0, b""
        for n, b in packed:
            head += b"%d %d " % (n, at)
            at += len(b) + 1
        out += b"90 0 obj\n%s\nendobj\n" % stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head)))
    return out + extra + b"%%EOF"


def stream(data, more=b"", flate=True):
    data = zlib.compress(data) if flate else data
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (more, b"/Filter /FlateDecode" if flate else b"", len(data), data)


CMAP = b"1 beginbfchar <0001> <00DC0062> endbfchar 1 beginbfrange <0002> <0004> <0065> <0005> <0006> [<263A> <D83DDE00>] endbfrange"
BASE = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
    5: stream(b"BT /F1 12 Tf 10 700 Td (Hello \\(caf\\351\\)) Tj 0 -14 Td [(Wor) -20 (ld) -400 (two)] TJ T* (back\\\\slash\\051) Tj ET"),
    6: stream(b"BT /F2 9 Tf 1 0 0 1 50 60 Tm <0001000200030004> Tj 1 0 0 1 80 60 Tm <00050006> Tj 1 0 0 1 50 40 Tm (\\000\\002) Tj ET", flate=False),
    7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
    9: stream(CMAP),
}
PAGES = [(3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>")]
TEXT = "\u00dcbefg\u263a\U0001f600\ne\n\nHello (caf\u00e9)\nWorld two\nback\\slash)"


def test_two_encodings_and_page_order():
    assert pdf_text(pdf(BASE | dict(PAGES))) == TEXT


def test_pages_in_an_object_stream():
    assert pdf_text(pdf(BASE, packed=PAGES)) == TEXT


def test_later_objects_replace_earlier_ones():
    new = b"5 0 obj\n" + stream(b"BT /F1 1 Tf (new) Tj ET") + b"\nendobj\n"
    assert pdf_text(pdf(BASE | dict(PAGES), extra=new)).endswith("\n\nnew")


def test_literals():
    assert literal(b"(a\\nb\\101\\\n(c)\\7)") == b"a\nbA(c)\x07" and literal(b"<48 656C6>") == b"Hel`"


def test_states(spark):
    bomb = BASE | dict(PAGES) | {5: stream(b" " * 60_000_000)}
    loop = {1: BASE[1], 2: b"<< /Type /Pages /Kids [2 0 R 4 0 R] >>", 4: PAGES[1][1], 6: BASE[6]}
    rows = [
        ("a.pdf", pdf(BASE | dict(PAGES))), ("b.PDF", b"junk"), ("c.pdf", pdf(bomb)), ("d.txt", b"%PDF-"), ("e.pdf", None), (None, b"%PDF-"), ("f.pdf", b"%PDF-1.4"), ("g.pdf", pdf(loop)),
        ("h.pdf", pdf(BASE | dict(PAGES), extra=b"trailer << /Encrypt 77 0 R >>")), ("i.pdf", pdf(BASE | dict(PAGES))[:-400]), ("j.pdf", pdf(BASE | {5: b"<< /Length 5 /Filter /FlateDecode >>\nstream\nxxxxx\nendstream"} | dict(PAGES))),
    ]
    got = {r["path"]: (r["state"], r["text"]) for r in pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"] == ("read", TEXT) and got["b.PDF"] == ("refused: not a PDF", None) and got["c.pdf"] == ("refused: unpacks to too much", None)
    assert got["f.pdf"] == ("read", "") and got["g.pdf"][0] == "read" and got["h.pdf"] == ("refused: encrypted", None) and got["i.pdf"][0] == "read"
    assert got["j.pdf"][1].startswith("\u00dcbe") and not got.keys() & {"d.txt", "e.pdf", None}
