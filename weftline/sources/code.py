"""Code to nodes and edges by patterns (grammars), a batch of files at a time.

A file gives a node of its own, one for each type and function, `contains` and `method` edges
from what encloses them, `inherits`, `imports`, and `calls`: a call of a name that one
function of the file has is an edge, any other is left as a raw call for later joins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from .grammars import Grammar


@lru_cache(maxsize=None)
def _masks(grammar: Grammar) -> re.Pattern:
    """Comments and strings, whichever comes first; longer openings win."""
    comments = [
        re.escape(a) + (r"[^\n]*" if b == "\n" else r"[\s\S]*?(?:" + re.escape(b) + r"|\Z)")
        for a, b in sorted(grammar.comments, key=lambda c: -len(c[0]))
    ]
    strings = [rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in grammar.quotes]
    return re.compile("|".join([f"(?P<comment>{'|'.join(comments)})", *([f"(?P<string>{'|'.join(strings)})"] if strings else [])]))


@lru_cache(maxsize=None)
def _patterns(grammar: Grammar) -> tuple:
    return (
        grammar.compiled(grammar.types), grammar.compiled(grammar.functions), [grammar.compiled(p) for p in grammar.imports],
        grammar.compiled(grammar.calls), re.compile(rf"[ \t]*{grammar.end}", re.IGNORECASE if grammar.ignore_case else 0),
    )


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, grammar: Grammar) -> tuple[str, str]:
    """The text without comments, and without comments and strings; offsets stay."""
    pattern = _masks(grammar)
    plain = pattern.sub(lambda m: _blank(m[0]) if m["comment"] else m[0], text)
    bare = pattern.sub(lambda m: _blank(m[0]) if m["comment"] else m[0][0] + _blank(m[0][1:-1]) + m[0][-1], text)
    return plain, bare


@dataclass
class Definition:
    name: str
    is_type: bool
    start: int
    end: int
    bases: list[str]
    owner: str | None
    again: bool  # goes on with a type that is defined elsewhere
    id: str = ""


def _first(m: re.Match, *names: str) -> str | None:
    found = m.groupdict()
    return next((found[f"{n}{k}"] for n in names for k in ("", "2", "3") if found.get(f"{n}{k}")), None)


def _line_start(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def _indent(text: str, at: int) -> int:
    start = _line_start(text, at)
    line = text[start : text.find("\n", start) % (len(text) + 1)]
    return len(line) - len(line.lstrip())


def _balanced(text: str, at: int, pair: str) -> int:
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def _extent(text: str, m: re.Match, grammar: Grammar, is_type: bool, end: re.Pattern) -> int:
    """Where the body of a definition ends."""
    style = grammar.style
    if style == "objc":
        if is_type:
            at = text.find("\n@end", m.end())
            return len(text) if at < 0 else at
        style = "brace"
    if style == "brace":
        at = text.find("{", m.end() - 1)
        return m.end() if at < 0 else _balanced(text, at, "{}")
    first = m.start() + len(m[0]) - len(m[0].lstrip())
    if style == "paren":
        return _balanced(text, first, "()")
    own, at = _indent(text, first), text.find("\n", m.end())
    while at >= 0:
        to = text.find("\n", at + 1)
        line = text[at + 1 : len(text) if to < 0 else to]
        if line.strip():
            depth = len(line) - len(line.lstrip())
            if style == "end" and depth == own and end.match(line):
                return len(text) if to < 0 else to
            if style == "indent" and depth <= own:
                return at
            if style == "line" and depth <= own:
                return at if not (is_type and end.match(line)) else len(text) if to < 0 else to
        at = to
    return len(text)


def definitions(plain: str, bare: str, grammar: Grammar) -> list[Definition]:
    types, functions, _, _, end = _patterns(grammar)
    out = []
    for pattern, is_type in ((types, True), (functions, False)):
        for m in pattern.finditer(bare) if pattern else ():
            again = _first(m, "again")
            name = again or _first(m, "name")
            if name and not name.strip():  # named by a string
                name = plain[slice(*next(m.span(g) for g in ("name", "name2", "name3") if m.groupdict().get(g)))]
            bases = [b for b in re.split(r"[,+]|\bimplements\b", _first(m, "bases") or "") if b.strip()]
            bases = [re.split(r"[<(]", re.sub(r"^(?:public|private|protected|virtual)\s+", "", b.strip()))[0].strip() for b in bases]
            if name and name not in grammar.words:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                out.append(Definition(name, is_type, start, _extent(bare, m, grammar, is_type, end), bases, _first(m, "owner"), bool(again)))
    out.sort(key=lambda d: (d.start, -d.end))
    return [d for i, d in enumerate(out) if not i or d.start != out[i - 1].start]


def code_rows(text: str, path: str, grammar: Grammar) -> Iterator[tuple]:
    """kind, id, label, line, target, relation of one file."""
    plain, bare = masked(text, grammar)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    stem = re.sub(r"\W+", "_", path.rsplit(".", 1)[0]).strip("_")
    yield "node", stem, path.rsplit("/", 1)[-1], 1, None, None
    _, _, imports, calls, _ = _patterns(grammar)
    for at, module in sorted((m.start("module"), x.strip()) for p in imports for m in p.finditer(plain) for x in (m["module"].split(",") if "{" not in m["module"] else [m["module"]])):
        if bare[_line_start(bare, at) : at].strip() or plain[at - 1] in " \t\"'<`(:\\":
            yield "edge", stem, None, line(at), module, "imports"
    found, open_ = definitions(plain, bare, grammar), []
    types = {}
    for d in found:
        while open_ and open_[-1].end <= d.start:
            open_.pop()
        outer = open_[-1] if open_ else None
        above = types.get(d.owner) if d.owner else outer
        within = above.id if above else stem
        if d.again and d.name in types:
            d.id = types[d.name].id
        else:
            d.id = f"{within}_{re.sub(r'[^0-9A-Za-z]+', '_', d.name).strip('_')}"
            method = not d.is_type and (above is not None and above.is_type)
            label = d.name if d.is_type else f".{d.name}()" if method else f"{d.name}()"
            yield "node", d.id, label, line(d.start), None, None
            yield "edge", within, None, line(d.start), d.id, "method" if method else "contains"
            if d.is_type:
                types.setdefault(d.name, d)
        for base in d.bases:
            yield "edge", d.id, None, line(d.start), base, "inherits"
        open_.append(d)
    named = Counter(d.name for d in found if not d.is_type)
    by_name = {d.name: d.id for d in found if not d.is_type and named[d.name] == 1}
    starts = [d.start for d in found]
    heads = {d.start for d in found}
    for m in calls.finditer(bare):
        name = _first(m, "name")
        at = m.start("name") if m["name"] else m.start("name2")
        k = bisect_right(starts, at) - 1
        while k >= 0 and (found[k].is_type or not found[k].start <= at < found[k].end):
            k -= 1
        if k < 0 or name in grammar.words or at in heads or line(at) == line(found[k].start) and at < bare.find("\n", found[k].start) and _heads(found[k], bare, at):
            continue
        target = by_name.get(name)
        yield ("edge" if target else "call"), found[k].id, None, line(at), target or name, "calls"


def _heads(d: Definition, bare: str, at: int) -> bool:
    """Whether a call's place lies in a definition's own head, up to what opens its body."""
    stop = min((x for x in (bare.find("{", d.start), bare.find("\n", d.start)) if x >= 0), default=len(bare))
    return at <= stop
