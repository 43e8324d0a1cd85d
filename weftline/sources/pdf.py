"""Text of PDF files, a batch of files at a time, with guards like those of office files.

Objects are found by their headers rather than through the cross-reference table, so that files
whose table is damaged are read too; of objects with one number the last one counts, those
in object streams included. Pages come in the order of the page tree. A page's text is what its
content shows: strings go through the font's ToUnicode map where there is one, else through the
one-byte Windows encoding; a new line or a wide gap begins a line or a word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .office import PAGE, Refused

#: Fixed limits: bytes of one stream and of all streams unpacked, objects, pages.
MOST_STREAM, MOST_ALL, MOST_OBJECTS, MOST_PAGES = 50_000_000, 200_000_000, 200_000, 20_000
HEAD = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\[\s\S]|[^\\()]|\((?:\\[\s\S]|[^\\()]|\((?:\\[\s\S]|[^\\()])*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|\[|\]|[+-]?\d*\.?\d+|[A-Za-z'\"*]+|%[^\r\n]*")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class File:
    def __init__(self, content: bytes) -> None:
        if not content.lstrip()[:5] == b"%PDF-":
            raise Refused("not a PDF")
        if b"/Encrypt" in content[-4096:] and re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise Refused("encrypted")
        self.spent, self.objects = 0, {}
        heads = list(HEAD.finditer(content))
        if len(heads) > MOST_OBJECTS:
            raise Refused("too many objects")
        for m, after in zip(heads, [*heads[1:], None]):
            self.objects[int(m[1])] = content[m.end() : after.start() if after else len(content)]
        for number in [n for n, o in self.objects.items() if re.search(rb"/Type\s*/ObjStm\b", o[:2000])]:
            self._inner(number)

    def _inner(self, number: int) -> None:
        body, head = self.stream(number), self.objects[number]
        n, first = (re.search(rb"/" + k + rb"\s+(\d+)", head) for k in (b"N", b"First"))
        if not n or not first:
            return
        numbers = [int(x) for x in body[: int(first[1])].split()[: 2 * int(n[1])]]
        at = [*numbers[1::2], len(body)]
        if len(self.objects) + len(at) > MOST_OBJECTS:
            raise Refused("too many objects")
        for inner, a, b in zip(numbers[::2], at, at[1:]):
            self.objects.setdefault(inner, body[int(first[1]) + a : int(first[1]) + b])

    def stream(self, number: int) -> bytes:
        raw = self.objects.get(number, b"")
        begin = re.search(rb"stream\r?\n", raw)
        if not begin:
            return b""
        head, end = raw[: begin.start()], raw.rfind(b"endstream")
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        data = raw[begin.end() : begin.end() + int(size[1])] if size and begin.end() + int(size[1]) <= end else raw[begin.end() : end].rstrip(b"\r\n")
        if b"/FlateDecode" in head or re.search(rb"/Fl\b", head):
            unpack = zlib.decompressobj()
            try:
                data = unpack.decompress(data, MOST_STREAM + 1)
            except zlib.error:
                data = b""
        elif b"/Filter" in head:
            return b""  # pictures and other filters hold no text
        self.spent += len(data)
        if len(data) > MOST_STREAM or self.spent > MOST_ALL:
            raise Refused("unpacks to too much")
        return data

    def refs(self, text: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", text)
        return [int(x) for x in REF.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        """The page objects in reading order."""
        roots = [n for n, o in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", o)]
        out, seen = [], set()
        open_ = [p for r in roots[-1:] for p in self.refs(self.objects[r], b"Pages")]
        while open_:
            number = open_.pop(0)
            o = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            kids = self.refs(o, b"Kids")
            if kids:
                open_ = kids + open_
            elif re.search(rb"/Type\s*/Page\b", o):
                out.append(o)
            if len(out) > MOST_PAGES:
                raise Refused("too many pages")
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str] | None]:
        """Each font's ToUnicode map by its name on the page."""
        text = page
        while b"/Font" not in text and (up := self.refs(text, b"Resources") or self.refs(text, b"Parent")):
            text = self.objects.get(up[0], b"")
        if again := self.refs(text, b"Font"):
            text = self.objects.get(again[0], b"")
        else:
            text = text[text.find(b"/Font") + 5 :] if b"/Font" in text else b""
        out: dict[bytes, dict[bytes, str] | None] = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", text):
            to = self.refs(self.objects.get(int(number), b""), b"ToUnicode")
            out.setdefault(name, unicode_map(self.stream(to[0])) if to else None)
        return out


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Codes to characters of a ToUnicode stream."""
    out: dict[bytes, str] = {}
    plain = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode())
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[plain(a)] = plain(b).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(<[0-9A-Fa-f\s]+>|\[[^\]]*\])", block):
            first, last, size = int.from_bytes(plain(a)), int.from_bytes(plain(b)), len(plain(a))
            listed = re.findall(rb"<([0-9A-Fa-f\s]+)>", c)
            for k in range(min(last - first + 1, 65_536)):
                if c[:1] == b"[":
                    to = plain(listed[k]).decode("utf-16-be", "ignore") if k < len(listed) else ""
                else:
                    base = plain(listed[0])
                    to = (int.from_bytes(base) + k).to_bytes(len(base)).decode("utf-16-be", "ignore")
                out[(first + k).to_bytes(size)] = to
    return out


def literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else b"" if m[1] in (b"\n", b"\r\n", b"\r") else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", octal, token[1:-1])


def shown(data: bytes, codes: dict[bytes, str] | None) -> str:
    if codes is None:
        return data.decode("utf-16-be", "ignore")[1:] if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")
    out, at, most = [], 0, max(map(len, codes), default=1)
    while at < len(data):
        size = next((n for n in range(1, most + 1) if data[at : at + n] in codes), most)
        out.append(codes.get(data[at : at + size], ""))
        at += size
    return "".join(out)


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str] | None]) -> str:
    """What the text operators of a page show."""
    out: list[str] = []
    held: list[bytes] = []
    listed: list[bytes] | None = None
    codes, height = None, None

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    content = re.sub(rb"\bBI\b.*?\bEI\b", b"", content, flags=re.S)
    for t in TOKEN.findall(content):
        if t == b"[":
            listed = []
        elif t == b"]":
            held = listed or []
            listed = None
        elif t[:1] in b"(</+-.0123456789":
            (held if listed is None else listed).append(t)
        elif t[:1] != b"%":
            if t == b"Tf" and len(held) > 1:
                codes = fonts.get(held[-2][1:])
            elif t in (b"Td", b"TD") and len(held) > 1:
                line() if float(held[-1]) else out.append(" ")
            elif t == b"Tm" and len(held) > 5:
                if height is not None and held[-1] != height:
                    line()
                height = held[-1]
            elif t in (b"T*", b"'", b'"'):
                line()
            if t in (b"Tj", b"'", b'"') and held:
                out.append(shown(literal(held[-1]), codes))
            elif t == b"TJ":
                for x in held:
                    if x[:1] in b"(<":
                        out.append(shown(literal(x), codes))
                    elif float(x) < -180 and out and not out[-1].endswith((" ", "\n")):
                        out.append(" ")
            elif t == b"ET":
                line()
            held = []
    return re.sub(r" *\n[ \n]*", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def pdf_text(content: bytes) -> str:
    """The pages' texts, an empty line between them."""
    f = File(content)
    return "\n\n".join(t for p in f.pages() if (t := page_text(b"\n".join(f.stream(n) for n in f.refs(p, b"Contents")), f.fonts(p))))


def pdf_pages(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, state (read, refused, broken), text of PDF files; others are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch[path_col], batch[content_col], strict=True):
                if not path or not path.lower().endswith(".pdf") or content is None:
                    continue
                try:
                    rows.append((path, "read", pdf_text(bytes(content))))
                except Refused as e:
                    rows.append((path, f"refused: {e}", None))
                except (ValueError, IndexError, RecursionError, OverflowError):
                    rows.append((path, "broken", None))
            yield pd.DataFrame(rows, columns=["path", "state", "text"])

    return files.select(path_col, content_col).mapInPandas(run, PAGE)
