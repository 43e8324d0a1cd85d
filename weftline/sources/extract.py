"""Files to nodes and edges, a batch of files at a time: Python, Markdown and SQL here, other
languages by their grammars."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from . import markup
from .code import code_rows
from .grammars import BY_SUFFIX

NODE = "kind string, id string, label string, line int, target string, relation string, source_file string"
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)\)")
TABLE = re.compile(r"(?is)\bcreate\s+(?:or\s+replace\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)(.*?);")
READS = re.compile(r"(?i)\b(?:from|join|references)\s+([\w.]+)")
WITH = re.compile(r"(?i)(?:\bwith\b|,)\s*(\w+)\s+as\s*\(")

Row = tuple[str, str | None, str | None, int, str | None, str | None]


def python_rows(text: str, path: str) -> Iterator[Row]:
    """Modules, classes, functions and methods, their bases, imports and calls by plain name."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    stem = re.sub(r"\W+", "_", path.rsplit(".", 1)[0]).strip("_")
    yield "node", stem, path.rsplit("/", 1)[-1], 1, None, None

    def walk(body: list, owner: str, in_class: bool) -> Iterator[Row]:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{owner}_{x.name}"
                is_class = isinstance(x, ast.ClassDef)
                yield "node", own, x.name if is_class else f".{x.name}()" if in_class else f"{x.name}()", x.lineno, None, None
                yield "edge", owner, None, x.lineno, own, "method" if in_class and not is_class else "contains"
                for base in getattr(x, "bases", []):
                    if isinstance(base, ast.Name):
                        yield "edge", own, None, x.lineno, base.id, "inherits"
                if not is_class:
                    for call in ast.walk(x):
                        if isinstance(call, ast.Call) and isinstance(call.func, ast.Name):
                            yield "call", own, None, call.lineno, call.func.id, "calls"
                yield from walk(x.body, own, is_class)
            elif isinstance(x, ast.Import):
                for name in x.names:
                    yield "edge", owner, None, x.lineno, name.name, "imports"
            elif isinstance(x, ast.ImportFrom):
                for name in x.names:
                    yield "edge", owner, None, x.lineno, f"{x.module or '.'}.{name.name}", "imports_from"

    yield from walk(tree.body, stem, False)


def markdown_rows(text: str, path: str) -> Iterator[Row]:
    """Headings under the last heading of a lower level, and links from the heading above them."""
    stem = re.sub(r"\W+", "_", path.rsplit(".", 1)[0]).strip("_")
    yield "node", stem, path.rsplit("/", 1)[-1], 1, None, None
    above: list[tuple[int, str]] = [(0, stem)]
    fenced = False
    for n, line in enumerate(text.splitlines(), 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        if m := HEADING.match(line):
            level = len(m[1])
            while above[-1][0] >= level:
                above.pop()
            own = f"{stem}_{n}"
            yield "node", own, m[2], n, None, None
            yield "edge", above[-1][1], None, n, own, "contains"
            above.append((level, own))
        for m in LINK.finditer(line):
            yield "edge", above[-1][1], None, n, m[1], "references"


#: What a routine's name may be: plain or delimited, with the names of what it belongs to before it.
ROUTINE_NAME = r"(?:[\w$]+|\"[^\"\n]+\"|`[^`\n]+`|\[[^\]\n]+\])"
ROUTINE = re.compile(rf"(?i)(?<![\w$])create\s+(?:or\s+(?:replace|alter)\s+)?(?:definer\s*=\s*\S+\s+)?(?:aggregate\s+)?(function|procedure|proc|trigger)\s+(?:if\s+not\s+exists\s+)?((?:{ROUTINE_NAME}\s*\.\s*)*{ROUTINE_NAME})")
SQL_MASK = re.compile(r"--[^\n]*|/\*|\*/|'(?:[^']|'')*(?:'|\Z)|\"[^\"\n]*\"|`[^`\n]*`|\[[^\]\n]*\]|(\$\w*\$)")


def sql_masked(text: str) -> str:
    """The text with comments (which nest), quoted strings and dollar-quoted bodies blanked, and with
    `create` in delimited names too; offsets stay."""
    out, at, depth, opened, begun = [], 0, 0, None, 0
    blank = lambda a, b: re.sub(r"[^\n]", " ", text[a:b])
    for m in SQL_MASK.finditer(text):
        token = m[0]
        if opened:
            if token == opened or token.endswith(opened):  # the body's own quotes don't count
                out.append(blank(begun, m.end()))
                at, opened = m.end(), None
            continue
        if depth:
            depth += (token == "/*") - (token == "*/")
            if not depth:
                out.append(blank(begun, m.end()))
                at = m.end()
            continue
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        at = m.end()
        if token == "/*":
            depth, begun = 1, m.start()
        elif m[1]:
            opened, begun = token, m.start()
        elif token[0] in "\"`[":
            out.append(re.sub(r"(?i)create", " " * 6, token))
        else:
            out.append("*/" if token == "*/" else blank(m.start(), m.end()))
    out.append(blank(begun, len(text)) if depth or opened else text[at:])
    return "".join(out)


def sql_routines(text: str) -> list[tuple[str, str, int]]:
    """kind, name, line of the functions, procedures and triggers that a text creates, whether or not
    the statements around them can be read."""
    plain = sql_masked(text)
    out = []
    for m in ROUTINE.finditer(plain):
        parts = [p.strip().strip('"`').removeprefix("[").removesuffix("]") for p in re.findall(ROUTINE_NAME, text[m.start(2) : m.end(2)])]
        out.append(("procedure" if m[1].lower() == "proc" else m[1].lower(), ".".join(parts), plain.count("\n", 0, m.start()) + 1))
    return out


def sql_rows(text: str, path: str) -> Iterator[Row]:
    """Tables and views, what views read and tables refer to; names of WITH are not tables. Routines."""
    for _, name, line in sql_routines(text):
        yield "node", f"{name.lower()}()", f"{name}()", line, None, None
    for m in TABLE.finditer(text if text.rstrip().endswith(";") else text + ";"):
        own, line = m[2].lower(), text.count("\n", 0, m.start()) + 1
        yield "node", own, m[2], line, None, None
        local = {w.lower() for w in WITH.findall(m[3])}
        for target in dict.fromkeys(t.lower() for t in READS.findall(m[3])):
            if target not in local and target != own:
                yield "edge", own, None, line, target, "reads_from" if m[1].lower() == "view" else "references"


EXTRACTORS: dict[str, Callable[[str, str], Iterator[Row]]] = {"py": python_rows, "md": markdown_rows, "sql": sql_rows}


def extractor(path: str) -> Callable[[str, str], Iterator[Row]] | None:
    """What reads files of this name, if anything does."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if path.lower().endswith(".blade.php"):
        return markup.blade_rows
    if suffix in EXTRACTORS or suffix in markup.BY_SUFFIX:
        return EXTRACTORS.get(suffix) or markup.BY_SUFFIX[suffix]
    grammar = BY_SUFFIX.get(suffix)
    return partial(code_rows, grammar=grammar) if grammar else None


def extract(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Rows of NODE for files whose extension has an extractor; texts that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE.split(", ")]
        for batch in batches:
            rows = []
            for path, text in zip(batch[path_col], batch[text_col], strict=True):
                found = extractor(path) if path and text is not None else None
                rows += [(*r, path) for r in found(text, path)] if found else []
            yield pd.DataFrame(rows, columns=columns)

    return files.select(path_col, text_col).mapInPandas(run, NODE)
