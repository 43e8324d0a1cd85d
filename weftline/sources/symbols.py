"""What files declare, import, export and use, as rows for weftline.operators.scopes.

A module is what other files import from: a file (Python, JavaScript, TypeScript), a folder (Go),
a package or namespace (Java, PHP, C#). Rows are: path, module, kind, name, of, of_name, line with kinds

    module   the file belongs to the module (once a file)
    declare  name is a top-level symbol; of is `private` if other modules can't see it
    import   name stands for of_name of module of; without name for all of it (wildcard), without
             of_name for the module itself
    export   the module passes on, as name, of_name of module of; without name all of it
    use      name is used, of is what stands before its dot
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .code import masked
from .grammars import BY_SUFFIX

FACTS = "path string, module string, kind string, name string, of string, of_name string, line int"
Fact = tuple[str, str | None, str | None, str | None, int]
USES = re.compile(r"(?:(?<![\w$])(?:new|extends|instanceof|throws)\s+|(?<![\w$.>\\])(?=[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?\s*\())(?:(?P<of>[A-Za-z_$][\w$]*)\.)?(?P<name>[A-Za-z_$][\w$]*)")
LISTED = re.compile(r"(?<![\w$])(?:implements|extends|:)\s+([A-Z][\w$]*(?:<[^>{]*>)?(?:\s*,\s*[A-Z][\w$]*(?:<[^>{]*>)?)*)")
#: Words before a parenthesis that are no calls.
WORDS = frozenset("if for while switch catch return function typeof await super this import require foreach using lock elseif func class interface sizeof synchronized".split())


def _uses(bare: str, line: Callable[[int], int], skip: set[int]) -> Iterator[tuple]:
    for m in USES.finditer(bare):
        if m["name"] not in WORDS and m.start("name") not in skip and not (m["of"] in ("this", "self", "super")):
            yield "use", m["name"], m["of"], None, line(m.start("name"))
    for m in LISTED.finditer(bare):
        for name in re.findall(r"([A-Z][\w$]*)(?:<[^>]*>)?", m[1]):
            yield "use", name, None, None, line(m.start(1))


def _listed(text: str, word: str = "as") -> list[tuple[str, str]]:
    """(name, alias) of `a, b as c`."""
    out = []
    for item in text.split(","):
        parts = re.split(rf"\s+{word}\s+" if word.isalpha() else rf"\s*{word}\s*", item.strip().removeprefix("type ").strip())
        if parts[0]:
            out.append((parts[0], parts[-1]))
    return out


def python_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    stem = path.rsplit(".", 1)[0]
    package = stem.endswith("/__init__") or stem == "__init__"
    module = (stem.removesuffix("__init__").rstrip("/") if package else stem).replace("/", ".")
    inside = module if package else module.rpartition(".")[0]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return module, []
    out = []
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("declare", n.name, "private" if n.name.startswith("_") else None, None, n.lineno))
    for n in ast.walk(tree):
        line = getattr(n, "lineno", 0)
        if isinstance(n, ast.Import):
            out += [("import", a.asname or a.name, a.name, None, line) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            above = inside.split(".")[: len(inside.split(".")) - n.level + 1] if n.level else []
            of = ".".join([*(x for x in above if x), *([n.module] if n.module else [])])
            for a in n.names:
                if a.name == "*":
                    out += [("import", None, of, None, line), ("export", None, of, None, line)]
                else:  # an imported name can be imported from here again; it may also be a module
                    name = a.asname or a.name
                    out += [("import", name, of, a.name, line), ("export", name, of, a.name, line), ("import", name, f"{of}.{a.name}", None, line)]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            out.append(("use", n.func.id, None, None, line))
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
            of = ast.unparse(n.func.value)
            if re.fullmatch(r"[\w.]+", of) and of.split(".")[0] not in ("self", "cls"):
                out.append(("use", n.func.attr, of, None, line))
        elif isinstance(n, ast.ClassDef):
            out += [("use", b.id, None, None, line) for b in n.bases if isinstance(b, ast.Name)]
    return module, out


JS_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s+as\s+(?P<space>[\w$]+))?\s*from\s*[\"'](?P<of>[^\"']+)[\"']", re.M)
JS_FROM = re.compile(r"^[ \t]*export\s+(?:type\s+)?(?:\{(?P<names>[^}]*)\}|\*(?:\s+as\s+(?P<space>[\w$]+))?)\s*from\s*[\"'](?P<of>[^\"']+)[\"']", re.M)
JS_LIST = re.compile(r"^[ \t]*export\s+(?:type\s+)?\{(?P<names>[^}]*)\}(?!\s*from)", re.M)
JS_DECLARE = re.compile(r"^(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum|type|const|let|var)\s+(?P<name>[\w$]+)", re.M)
JS_REQUIRE = re.compile(r"^[ \t]*(?:const|let|var)\s+(?:(?P<space>[\w$]+)|\{(?P<names>[^}]*)\})\s*=\s*require\(\s*[\"'](?P<of>[^\"']+)[\"']\s*\)", re.M)


def js_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    folder, module = posixpath.dirname(path), re.sub(r"(?:/index)?\.[^./]+$", "", path)

    def target(spec: str) -> str:
        if not spec.startswith("."):
            return spec
        return re.sub(r"(?:/index)?(?:\.(?:[mc]?[jt]sx?|vue|svelte))?$", "", posixpath.normpath(posixpath.join(folder, spec)))

    out, heads = [], set()
    for m in JS_IMPORT.finditer(plain):
        of, at = target(m["of"]), line(m.start())
        out += [("import", m["default"], of, "default", at)] if m["default"] else []
        out += [("import", m["space"], of, None, at)] if m["space"] else []
        out += [("import", alias, of, name, at) for name, alias in _listed(m["names"] or "")]
    for m in JS_REQUIRE.finditer(plain):
        out += [("import", m["space"], target(m["of"]), None, line(m.start()))] if m["space"] else []
        out += [("import", alias, target(m["of"]), name, line(m.start())) for name, alias in _listed(m["names"] or "", ":")]
    for m in JS_FROM.finditer(plain):
        of, at = target(m["of"]), line(m.start())
        if m["names"] is not None:
            out += [("export", alias, of, name, at) for name, alias in _listed(m["names"])]
        else:
            out.append(("export", m["space"], of, None, at))
    public = {name: alias for m in JS_LIST.finditer(plain) for name, alias in _listed(m["names"])}
    required = {m.start("space") for m in JS_REQUIRE.finditer(plain)} | {m.start() for m in JS_REQUIRE.finditer(plain)}
    own = set()
    for m in JS_DECLARE.finditer(bare):
        heads.add(m.start("name"))
        if m.start() in required:
            continue
        own.add(m["name"])
        out.append(("declare", m["name"], None if m["export"] and not m["default"] else "private", None, line(m.start())))
        if m["default"]:
            out.append(("export", "default", module, m["name"], line(m.start())))
    # a list exports symbols of the file, or passes on what the file imports
    came = {f[1]: f for f in out if f[0] == "import" and f[1]}
    for name, alias in public.items():
        if name in own:
            out.append(("export", alias, module, name, 1))
        elif name in came:
            out.append(("export", alias, came[name][2], came[name][3], 1))
    return module, out + list(_uses(bare, line, heads))


JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?P<static>static\s+)?(?P<of>[\w.]+?)\.(?P<name>\w+|\*)\s*;", re.M)
JAVA_TYPE = re.compile(r"^(?P<head>(?:(?:public|private|protected|final|abstract|sealed|static)\s+)*)(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)", re.M)


def java_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    found = re.search(r"^[ \t]*package\s+([\w.]+)\s*;", plain, re.M)
    module, out = found[1] if found else "", []
    for m in JAVA_IMPORT.finditer(plain):
        wild = m["name"] == "*"
        if not m["static"]:
            out.append(("import", None if wild else m["name"], m["of"], None if wild else m["name"], line(m.start())))
    types = list(JAVA_TYPE.finditer(bare))
    out += [("declare", m["name"], None, None, line(m.start())) for m in types]
    uses = [u for u in _uses(bare, line, set()) if u[1][:1].isupper()]
    return module, out + uses


PHP_USE = re.compile(r"^[ \t]*use\s+(?:function\s+|const\s+)?\\?(?P<of>[\w\\]+?)(?:\\\{(?P<group>[^}]*)\}|(?:\s+as\s+(?P<alias>\w+))?)\s*;", re.M)
PHP_TYPE = re.compile(r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(?P<name>\w+)", re.M)
PHP_FULL = re.compile(r"(?:\b(?:new|extends|implements|instanceof)\s+)\\(?P<of>[\w\\]+)\\(?P<name>\w+)")


def php_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    found = re.search(r"^[ \t]*namespace\s+([\w\\]+)\s*[;{]", plain, re.M)
    module, out = found[1] if found else "", []
    for m in PHP_USE.finditer(plain):
        if m["group"] is not None:
            for name, alias in _listed(m["group"]):
                inner, _, last = name.rpartition("\\")
                out.append(("import", alias.rpartition("\\")[2], m["of"] + ("\\" + inner if inner else ""), last, line(m.start())))
        else:
            of, _, last = m["of"].rpartition("\\")
            out.append(("import", m["alias"] or last, of, last, line(m.start())))
    out += [("declare", m["name"], None, None, line(m.start())) for m in PHP_TYPE.finditer(bare)]
    for k, m in enumerate(PHP_FULL.finditer(bare)):  # a full name is its own import
        alias = f"\\{k}"
        out += [("import", alias, m["of"], m["name"], line(m.start())), ("use", alias, None, None, line(m.start()))]
    return module, out + [u for u in _uses(PHP_FULL.sub(lambda m: " " * len(m[0]), bare), line, set()) if u[1][:1].isupper()]


GO_IMPORT = re.compile(r"^[ \t]*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<of>[^\"\n]+)\"[ \t]*$", re.M)
GO_DECLARE = re.compile(r"^(?:type\s+(?P<type>\w+)|func\s+(?P<name>\w+)\s*[(\[])", re.M)
GO_USE = re.compile(r"(?<![\w.\"])(?:(?P<of>[a-z_]\w*)\.(?P<name>[A-Z]\w*)|(?P<own>[A-Za-z_]\w*)(?=[({]))")


def go_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    module, out, heads = posixpath.dirname(path), [], set()
    for m in GO_IMPORT.finditer(plain):
        name = m["alias"] or m["of"].rpartition("/")[2]
        if name != "_":
            out.append(("import", None if name == "." else name, m["of"], None, line(m.start())))
    for m in GO_DECLARE.finditer(bare):
        name = m["type"] or m["name"]
        heads |= {m.start("type"), m.start("name")}
        out.append(("declare", name, None if name[0].isupper() else "private", None, line(m.start())))
    for m in GO_USE.finditer(bare):
        if m["own"] is None or m["own"] not in WORDS and m.start("own") not in heads:
            out.append(("use", m["name"] or m["own"], m["of"], None, line(m.start())))
    return module, out


CS_USING = re.compile(r"^[ \t]*(?P<global>global\s+)?using\s+(?!static\b)(?:(?P<alias>\w+)\s*=\s*)?(?P<of>[\w.]+)\s*;", re.M)
CS_TYPE = re.compile(r"^[ \t]*(?:(?:public|internal|private|protected|static|sealed|abstract|partial|readonly)\s+)*(?:class|interface|struct|enum|record)\s+(?P<name>\w+)", re.M)


def csharp_facts(text: str, path: str, plain: str, bare: str) -> tuple[str, list]:
    line = lambda at: text.count("\n", 0, at) + 1
    found = re.search(r"^[ \t]*namespace\s+([\w.]+)\s*[;{]", plain, re.M)
    module, out = found[1] if found else "", []
    for m in CS_USING.finditer(plain):
        if m["alias"]:
            of, _, last = m["of"].rpartition(".")
            out += [("import", m["alias"], of, last, line(m.start())), ("import", m["alias"], m["of"], None, line(m.start()))]
        else:
            out.append(("import", None, m["of"], None, line(m.start())))
    out += [("declare", m["name"], None, None, line(m.start())) for m in CS_TYPE.finditer(bare)]
    return module, out + [u for u in _uses(bare, line, set()) if u[1][:1].isupper()]


READERS = {"py": python_facts, "java": java_facts, "php": php_facts, "go": go_facts, "cs": csharp_facts} | dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), js_facts)


def symbol_facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """FACTS of files of the languages above; others give none, as do null paths and texts. Files
    that repeat give their rows again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch[path_col], batch[text_col], strict=True):
                suffix = path.rsplit(".", 1)[-1].lower() if path else ""
                if suffix not in READERS or text is None:
                    continue
                plain, bare = masked(text, BY_SUFFIX[suffix]) if suffix in BY_SUFFIX else (text, text)
                module, found = READERS[suffix](text, path, plain, bare)
                rows += [(path, module, *r) for r in [("module", None, None, None, 1), *found]]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(path_col, text_col).mapInPandas(run, FACTS)
