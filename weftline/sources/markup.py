"""Templates, project files and configuration to nodes and edges, a file at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from .code import code_rows
from .grammars import GRAMMARS

Row = tuple[str, str | None, str | None, int, str | None, str | None]

SCRIPT = re.compile(r"<script\b[^>]*>([\s\S]*?)</script>", re.IGNORECASE)
FRONT = re.compile(r"\A---\n([\s\S]*?)\n---")
COMPONENT = re.compile(r"<([A-Z]\w*)[\s/>]")
BLADE = (
    (re.compile(r"@(?:include|extends|component)\(\s*['\"]([^'\"]+)['\"]"), "includes"),
    (re.compile(r"<livewire:([\w.-]+)"), "uses_component"),
    (re.compile(r"wire:click=[\"']([^\"']+)[\"']"), "binds_method"),
)
RAZOR = (
    (re.compile(r"^@using\s+([\w.]+)", re.MULTILINE), "imports"),
    (re.compile(r"^@(?:inject|inherits|model)\s+([\w.<>]+)", re.MULTILINE), "references"),
    (COMPONENT, "references"),
)
RAZOR_CODE = re.compile(r"@(?:code|functions)\s*\{")
SOLUTION = re.compile(r"^Project\(\"[^\"]*\"\)\s*=\s*\"([^\"]+)\"\s*,\s*\"([^\"]+)\"", re.MULTILINE)
BLOCK = re.compile(r"^(resource|data|module|variable|output|provider|locals|terraform)((?:\s+\"[^\"]+\")*)\s*\{", re.MULTILINE)
LOCAL = re.compile(r"^\s{2}(\w+)\s*=", re.MULTILINE)
REFERENCE = re.compile(r"(?<![\w.\"])((?:var|local|module|data)\.[\w.]+|[a-z]\w*_\w+\.\w+)")
DEPENDS = re.compile(r"depends_on\s*=\s*\[([^\]]*)\]")
#: Parts of a package file that name what it depends on.
DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def _stem(path: str) -> str:
    return re.sub(r"\W+", "_", path.rsplit(".", 1)[0]).strip("_")


def _file(path: str) -> Row:
    return "node", _stem(path), path.rsplit("/", 1)[-1], 1, None, None


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _kept(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with all but the spans blanked; offsets stay."""
    out, at = [], 0
    for a, b in [*spans, (len(text), len(text))]:
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join(out)


def component_rows(text: str, path: str) -> Iterator[Row]:
    """Vue, Svelte and Astro: the script as JavaScript, and the components that the markup uses."""
    front = FRONT.match(text) if path.lower().endswith(".astro") else None
    scripts = ([front.span(1)] if front else []) + [m.span(1) for m in SCRIPT.finditer(text)]
    yield from code_rows(_kept(text, scripts), path, GRAMMARS["javascript"])
    rest = list(text)
    for a, b in scripts:
        rest[a:b] = re.sub(r"[^\n]", " ", text[a:b])
    markup = "".join(rest)
    for m in COMPONENT.finditer(markup):
        yield "edge", _stem(path), None, _line(text, m.start()), m[1], "references"


def blade_rows(text: str, path: str) -> Iterator[Row]:
    yield _file(path)
    for pattern, relation in BLADE:
        for m in pattern.finditer(text):
            yield "edge", _stem(path), None, _line(text, m.start()), m[1].replace(".", "/") if relation == "includes" else m[1], relation


def razor_rows(text: str, path: str) -> Iterator[Row]:
    """Directives, components, and methods of code blocks."""
    yield _file(path)
    for pattern, relation in RAZOR:
        for m in pattern.finditer(text):
            yield "edge", _stem(path), None, _line(text, m.start()), m[1], relation
    blocks = []
    for m in RAZOR_CODE.finditer(text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        blocks.append((m.end(), at - 1))
    if blocks:
        yield from (r for r in code_rows(_kept(text, blocks), path, GRAMMARS["csharp"]) if r[1] != _stem(path) or r[0] == "edge")


def solution_rows(text: str, path: str) -> Iterator[Row]:
    yield _file(path)
    for m in SOLUTION.finditer(text):
        own = f"{_stem(path)}_{re.sub(r'[^0-9A-Za-z]+', '_', m[1])}"
        yield "node", own, m[1], _line(text, m.start()), None, None
        yield "edge", _stem(path), None, _line(text, m.start()), own, "contains"
        yield "edge", own, None, _line(text, m.start()), m[2].replace("\\", "/"), "references"


def _xml(text: str) -> ElementTree.Element | None:
    """The root; none where it isn't XML, or where entities are declared, which could expand without end."""
    if "<!ENTITY" in text:
        return None
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None


def _place(text: str, said: str) -> int:
    at = text.find(f'"{said}"')
    return _line(text, at) if at >= 0 else 1


def project_rows(text: str, path: str) -> Iterator[Row]:
    """.NET projects: packages and projects that they refer to."""
    yield _file(path)
    root = _xml(text)
    for x in root.iter() if root is not None else ():
        tag, target = x.tag.rsplit("}", 1)[-1], x.get("Include")
        if tag in ("PackageReference", "ProjectReference", "Project") and (target or x.get("Path")):
            said = target or x.get("Path")
            yield "edge", _stem(path), None, _place(text, said), said.replace("\\", "/"), "imports" if tag == "PackageReference" else "references"


def xaml_rows(text: str, path: str) -> Iterator[Row]:
    """Views: their class, named elements, handlers of events and what is bound."""
    yield _file(path)
    root = _xml(text)
    for x in root.iter() if root is not None else ():
        for key, value in x.attrib.items():
            name = key.rsplit("}", 1)[-1]
            line = _place(text, value)
            if name == "Class":
                yield "edge", _stem(path), None, line, value, "references"
            elif name == "Name":
                yield "node", f"{_stem(path)}_{value}", value, line, None, None
                yield "edge", _stem(path), None, line, f"{_stem(path)}_{value}", "contains"
            elif m := re.match(r"\{\s*(?:x:)?Bind(?:ing)?\s+(?:Path=)?([\w.]+)", value):
                yield "edge", _stem(path), None, line, m[1], "binds"
            elif re.match(r"(?:Click|.*Changed|Loaded|.*Pressed|Tapped)$", name) and re.match(r"\w+$", value):
                yield "edge", _stem(path), None, line, value, "binds_method"


def terraform_rows(text: str, path: str) -> Iterator[Row]:
    """Blocks by address, what they refer to or depend on, and where modules come from."""
    yield _file(path)
    stem = _stem(path)
    bare = re.sub(r"#[^\n]*|//[^\n]*", lambda m: " " * len(m[0]), text)
    starts = list(BLOCK.finditer(bare))
    for m, after in zip(starts, [*starts[1:], None], strict=True):
        body = bare[m.end() : after.start() if after else len(bare)]
        names = re.findall(r"\"([^\"]+)\"", m[2])
        line = _line(text, m.start())
        prefix = {"resource": [], "variable": ["var"], "locals": ["local"]}.get(m[1], [m[1]])
        if m[1] == "locals":
            items = [(f"local.{x[1]}", _line(text, m.end() + x.start(1))) for x in LOCAL.finditer(body)]
        else:
            items = [(".".join([*prefix, *names]), line)]
        for address, at in items:
            yield "node", f"{stem}_{address}", address, at, None, None
            yield "edge", stem, None, at, f"{stem}_{address}", "contains"
        if m[1] == "locals" or not names:
            continue
        own = f"{stem}_{items[0][0]}"
        depends = DEPENDS.search(body)
        if m[1] == "module" and (source := re.search(r"^\s*source\s*=\s*\"([^\"]+)\"", body, re.MULTILINE)):
            yield "edge", own, None, _line(text, m.end() + source.start(1)), source[1], "module_source"
        for x in REFERENCE.finditer(body):
            parts = x[1].split(".")
            address = ".".join(parts[:3] if parts[0] == "data" else parts[:2])
            relation = "depends_on" if depends and depends.start() <= x.start() < depends.end() else "references"
            yield "edge", own, None, _line(text, m.end() + x.start()), address, relation


def json_rows(text: str, path: str) -> Iterator[Row]:
    """Configuration: keys of objects, what is extended, referred to or depended on."""
    yield _file(path)
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return
    stem = _stem(path)

    def walk(x: object, owner: str, key: str, depth: int) -> Iterator[Row]:
        if isinstance(x, list):
            for y in x:
                yield from walk(y, owner, key, depth)
        if not isinstance(x, dict):
            return
        for k, v in x.items():
            line = _place(text, k)
            if k == "extends":
                for base in v if isinstance(v, list) else [v]:
                    if isinstance(base, str):
                        yield "edge", stem, None, _place(text, base), base, "extends"
            elif k == "$ref" and isinstance(v, str):
                yield "edge", owner, None, _place(text, v), v, "references"
            elif k in DEPENDENCIES and isinstance(v, dict):
                for name in v:
                    yield "edge", stem, None, _place(text, name), name, "imports"
            elif depth < 6:
                own = f"{owner}_{re.sub(r'[^0-9A-Za-z]+', '_', k).strip('_')}"
                yield "node", own, k, line, None, None
                yield "edge", owner, None, line, own, "contains"
                yield from walk(v, own, k, depth + 1)

    yield from walk(root, stem, "", 0)


BY_SUFFIX = {
    "vue": component_rows, "svelte": component_rows, "astro": component_rows, "razor": razor_rows, "cshtml": razor_rows, "sln": solution_rows, "slnx": project_rows,
    "csproj": project_rows, "fsproj": project_rows, "vbproj": project_rows, "xaml": xaml_rows, "tf": terraform_rows, "tfvars": terraform_rows, "hcl": terraform_rows,
    "json": json_rows,
}
