"""What the code extractor needs to know of each language, as patterns.

Patterns run on text whose comments and strings are blanked; those of imports see strings.
`name`, `bases`, `owner` and `module` are what their groups stand for. A definition's body is
found by its style: braces, a closing line of the same indentation, deeper indentation,
parentheses, or everything up to the next definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

C_STYLE = (("//", "\n"), ("/*", "*/"))
WORD = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Grammar:
    suffixes: tuple[str, ...]
    types: str = ""
    functions: str = ""
    imports: tuple[str, ...] = ()
    style: str = "brace"
    comments: tuple[tuple[str, str], ...] = C_STYLE
    quotes: str = "\"'"
    end: str = r"end\b"
    calls: str = rf"(?<![\w$.:>@])(?P<name>{WORD})\s*\("
    #: Words that stand before a parenthesis without being called.
    words: frozenset[str] = field(default_factory=frozenset)
    ignore_case: bool = False

    def compiled(self, pattern: str) -> re.Pattern | None:
        return re.compile(pattern, re.MULTILINE | (re.IGNORECASE if self.ignore_case else 0)) if pattern else None


_FLOW = "if for while switch catch return sizeof function new throw typeof await yield else do when match synchronized using lock foreach elseif elif unless until not and or in"
FLOW = frozenset(_FLOW.split())
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|open|partial|readonly|export|default|global|data|inline|suspend|synchronized|with sharing|without sharing)\s+)*"
_BASES = r"(?:\s*(?::|extends|implements)\s*(?P<bases>[\w.<>, ]+?(?:\s+implements\s+[\w.<>, ]+?)?))?"
_CLASS = rf"^[ \t]*{_MODIFIERS}(?:class|interface|enum|record|struct|trait|object|protocol|extension)\s+(?P<name>\w+)(?:<[^>{{]*>)?(?:\([^)]*\))?{_BASES}\s*(?:\([^)]*\))?\s*\{{"
_TYPED = rf"^[ \t]*{_MODIFIERS}(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?*&]+[\s*&]+)(?P<name>~?\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\{{"

GRAMMARS: dict[str, Grammar] = {
    "javascript": Grammar(
        ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), _CLASS,
        rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{WORD})\s*(?:<[^>(]*>)?\([^)]*\)[^{{;]*\{{"
        rf"|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name2>{WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{WORD})\s*(?::[^=]+)?=>\s*\{{"
        rf"|^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?P<name3>{WORD})\s*\([^)]*\)\s*(?::[^{{;]+)?\{{",
        (r"^[ \t]*import\s+(?:[^'\";]+?\s+from\s+)?[\"'](?P<module>[^\"']+)[\"']", r"\brequire\(\s*[\"'](?P<module>[^\"']+)[\"']\s*\)", r"^[ \t]*export\s+[^'\";]+?\s+from\s+[\"'](?P<module>[^\"']+)[\"']", r"\bimport\(\s*[\"'](?P<module>[^\"']+)[\"']\s*\)"),
        quotes="\"'`", words=FLOW | {"require", "import", "super", "constructor"},
    ),
    "java": Grammar(("java",), _CLASS, _TYPED, (r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;",), words=FLOW | {"super", "this"}),
    "groovy": Grammar(("groovy", "gradle"), _CLASS, rf"{_TYPED}|^[ \t]*def\s+[\"'](?P<name2>[^\"']+)[\"']\s*\(\)\s*\{{", (r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.*]+)",), words=FLOW),
    "c": Grammar(("c", "h"), r"^[ \t]*(?:typedef\s+)?(?:struct|union|enum)\s+(?P<name>\w+)\s*\{", _TYPED, (r"^[ \t]*#[ \t]*include\s*[<\"](?P<module>[^>\"]+)[>\"]",), words=FLOW),
    "cpp": Grammar(
        ("cpp", "cc", "cxx", "hpp", "cu", "cuh", "metal"), r"^[ \t]*(?:class|struct|union|enum(?:\s+class)?)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[\w:<>, ]+?))?\s*\{",
        rf"{_TYPED}|^[ \t]*(?:[\w<>:,*&]+[\s*&]+)?(?P<owner>\w+)::(?P<name2>~?\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{",
        (r"^[ \t]*#[ \t]*include\s*[<\"](?P<module>[^>\"]+)[>\"]",), words=FLOW,
    ),
    "csharp": Grammar(("cs",), _CLASS, _TYPED, (r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<module>[\w.]+)\s*;",), words=FLOW | {"base", "this", "nameof"}),
    "kotlin": Grammar(
        ("kt", "kts"), rf"^[ \t]*{_MODIFIERS}(?:class|interface|object|enum class)\s+(?P<name>\w+)(?:<[^>{{]*>)?(?:\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.<>, ()]+?))?\s*\{{",
        rf"^[ \t]*{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\([^)]*\)[^{{=\n]*\{{", (r"^[ \t]*import\s+(?P<module>[\w.*]+)",), words=FLOW,
    ),
    "scala": Grammar(
        ("scala",), r"^[ \t]*(?:(?:case|abstract|sealed|final|implicit)\s+)*(?:class|trait|object)\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w., ]+?))?\s*\{",
        r"^[ \t]*(?:override\s+|private\s+|protected\s+)*def\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?(?:\([^)]*\))?[^={\n]*=?\s*\{", (r"^[ \t]*import\s+(?P<module>[\w.{}, *]+)",), words=FLOW,
    ),
    "php": Grammar(
        ("php",), rf"^[ \t]*{_MODIFIERS}(?:class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\, ]+?))?(?:\s+implements\s+[\w\\, ]+?)?\s*\{{",
        rf"^[ \t]*{_MODIFIERS}function\s+&?(?P<name>\w+)\s*\([^)]*\)[^{{;]*\{{", (r"^[ \t]*use\s+(?P<module>[\w\\]+)\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*[\"'](?P<module>[^\"']+)[\"']"),
        comments=(*C_STYLE, ("#", "\n")), calls=r"(?<![\w$>:])(?P<name>[A-Za-z_]\w*)\s*\(", words=FLOW | {"require", "include", "array", "isset", "echo"},
    ),
    "swift": Grammar(
        ("swift",), rf"^[ \t]*{_MODIFIERS}(?:class|struct|protocol|enum|extension|actor)\s+(?P<name>\w+)(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[\w., ]+?))?\s*\{{",
        rf"^[ \t]*{_MODIFIERS}func\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^{{]*\)[^{{\n]*\{{", (r"^[ \t]*import\s+(?P<module>[\w.]+)",), words=FLOW,
    ),
    "go": Grammar(
        ("go",), r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{", r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\([^{]*\{",
        (r"^[ \t]*import\s+(?:\w+\s+)?\"(?P<module>[^\"]+)\"", r"^[ \t]+(?:[\w.]+\s+)?\"(?P<module>[^\"\n]+)\"[ \t]*$"), quotes="\"'`", words=FLOW | {"func", "make", "len", "append", "panic"},
    ),
    "rust": Grammar(
        ("rs",), r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[\w:+ ]+?))?\s*\{|^[ \t]*impl(?:<[^>]*>)?\s+(?:(?P<bases2>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<again>\w+)(?:<[^>]*>)?\s*\{",
        r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^{;]*\{", (r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:{}, *]+)\s*;",), quotes='"', words=FLOW | {"Some", "Ok", "Err", "Box", "Vec"},
    ),
    "zig": Grammar(
        ("zig",), r"^[ \t]*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)(?:\([^)]*\))?\s*\{", r"^[ \t]*(?:pub\s+|export\s+|inline\s+)*fn\s+(?P<name>\w+)\s*\([^{;]*\{",
        (r"@import\(\s*\"(?P<module>[^\"]+)\"\s*\)",), comments=(("//", "\n"),), quotes='"', words=FLOW,
    ),
    "powershell": Grammar(
        ("ps1", "psm1"), r"^[ \t]*(?:class|enum)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w, ]+?))?\s*\{", r"^[ \t]*function\s+(?P<name>[\w-]+)\s*(?:\([^)]*\))?\s*\{|^[ \t]+\[\w+\]\s*(?P<name2>\w+)\s*\([^)]*\)\s*\{",
        (r"^[ \t]*Import-Module\s+(?P<module>[\w.\\/-]+)", r"^[ \t]*using\s+module\s+(?P<module>[\w.\\/-]+)", r"^[ \t]*\.[ \t]+(?P<module>[\w.\\/$-]+\.ps1)"),
        comments=(("#", "\n"), ("<#", "#>")), calls=r"(?<![\w$.:\[-])(?P<name>[A-Za-z]+-[A-Za-z]\w*)(?=[ \t\n(;|)])", words=FLOW | {"Import-Module"}, ignore_case=True,
    ),
    "dart": Grammar(
        ("dart",), r"^[ \t]*(?:abstract\s+|final\s+|sealed\s+|base\s+)*(?:class|mixin|enum|extension)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<bases>[\w<>., ]+?))?(?:\s+(?:with|implements|on)\s+[\w<>., ]+?)?\s*\{", rf"{_TYPED}",
        (r"^[ \t]*(?:import|export|part)\s+[\"'](?P<module>[^\"']+)[\"']",), words=FLOW,
    ),
    "apex": Grammar(
        ("cls", "trigger"), rf"{_CLASS}|^[ \t]*trigger\s+(?P<name2>\w+)\s+on\s+(?P<bases2>\w+)\s*\([^)]*\)\s*\{{", _TYPED,
        (r"\bFROM\s+(?P<module>\w+)", r"\b(?:insert|update|delete|upsert)\s+(?P<module>\w+)\s*;"), quotes="'", words=FLOW, ignore_case=True,
    ),
    "bash": Grammar(
        ("sh", "bash"), "", r"^[ \t]*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*\{|^[ \t]*function\s+(?P<name2>[A-Za-z_][\w-]*)\s*\{", (r"^[ \t]*(?:source|\.)[ \t]+[\"']?(?P<module>[\w./${}-]+)",),
        comments=(("#", "\n"),), calls=r"(?:^|[;&|(`]|\bthen|\bdo|\belse)[ \t]*(?P<name>[A-Za-z_][\w-]*)(?![\w=(-])", words=FLOW | frozenset("then fi done esac case local echo export source set exit cd function".split()),
    ),
    "objc": Grammar(
        ("m", "mm"), r"^@(?:interface|protocol)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>\w+))?|^@implementation\s+(?P<again>\w+)", r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)[^;{]*\{|^(?:[\w*]+\s+)+\*?(?P<name2>\w+)\s*\([^;{]*\)\s*\{",
        (r"^[ \t]*#[ \t]*(?:import|include)\s*[<\"](?P<module>[^>\"]+)[>\"]", r"^@import\s+(?P<module>[\w.]+)\s*;"), style="objc", calls=r"\[\s*\w+\s+(?P<name>\w+)|(?<![\w$.>])(?P<name2>[A-Za-z_]\w*)\s*\(", words=FLOW,
    ),
    "ruby": Grammar(
        ("rb", "rake"), r"^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*(?:::\w+)*)(?:\s*<\s*(?P<bases>[\w:]+))?", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)", (r"^[ \t]*require(?:_relative)?\s*\(?\s*[\"'](?P<module>[^\"']+)[\"']",),
        style="end", comments=(("#", "\n"),), words=FLOW | {"require", "puts", "attr_accessor"},
    ),
    "lua": Grammar(
        ("lua", "luau"), "", r"^[ \t]*(?:local\s+)?function\s+(?:(?P<owner>\w+)[.:])?(?P<name>\w+)\s*\(", (r"\brequire\s*\(?\s*[\"'](?P<module>[^\"']+)[\"']",), style="end", comments=(("--", "\n"), ("--[[", "]]")),
        calls=r"(?<![\w.:])(?P<name>[A-Za-z_]\w*)\s*\(", words=FLOW | {"require", "print", "function"},
    ),
    "elixir": Grammar(
        ("ex", "exs"), r"^[ \t]*(?:defmodule|defprotocol|defimpl)\s+(?P<name>[\w.]+)[^\n]*\bdo\b", r"^[ \t]*(?:def|defp|defmacro)\s+(?P<name>\w+[?!]?)[^\n]*\bdo\b", (r"^[ \t]*(?:alias|import|use|require)\s+(?P<module>[\w.]+)",),
        style="end", comments=(("#", "\n"),), words=FLOW | {"def", "defp", "fn"},
    ),
    "julia": Grammar(
        ("jl",), r"^[ \t]*(?:module|(?:mutable\s+)?struct|abstract\s+type)\s+(?P<name>\w+)(?:\s*<:\s*(?P<bases>\w+))?", r"^[ \t]*function\s+(?P<name>\w+!?)\s*\(", (r"^[ \t]*(?:using|import)\s+(?P<module>[\w.]+)", r"\binclude\(\s*\"(?P<module>[^\"]+)\"\s*\)"),
        style="end", comments=(("#", "\n"),), quotes='"', words=FLOW | {"include", "println"},
    ),
    "fortran": Grammar(
        ("f", "f90", "f95", "f03", "f08"), r"^[ \t]*(?:module|program)\s+(?!procedure\b)(?P<name>\w+)[ \t]*$|^[ \t]*type(?:\s*,\s*extends\((?P<bases2>\w+)\))?\s*(?:::\s*|\s+)(?P<name2>\w+)[ \t]*$",
        r"^[ \t]*(?:(?:pure|elemental|recursive|integer|real|logical)\s+)*(?:subroutine|function)\s+(?P<name>\w+)\s*\(", (r"^[ \t]*use\s+(?P<module>\w+)",), style="end", comments=(("!", "\n"),), end=r"end\b",
        calls=r"\bcall\s+(?P<name>\w+)", words=FLOW, ignore_case=True,
    ),
    "verilog": Grammar(
        ("v", "sv", "svh"), r"^[ \t]*(?:module|interface|package|class)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?[^;]*;", r"^[ \t]*(?:function|task)\s+(?:automatic\s+)?(?:\[[^\]]*\]\s*|\w+\s+)?(?P<name>\w+)\s*(?:\([^;]*\))?;", (r"^[ \t]*`include\s+\"(?P<module>[^\"]+)\"", r"^[ \t]*import\s+(?P<module>\w+)::"),
        style="end", quotes='"', end=r"end(?:module|interface|package|class|function|task)\b", words=FLOW | {"begin", "module"},
    ),
    "pascal": Grammar(
        ("pas", "pp", "dpr", "lpr"), r"^[ \t]*(?P<name>\w+)\s*=\s*(?:class|record|interface)(?:\s*\((?P<bases>[\w, ]+)\))?", r"^(?:procedure|function|constructor|destructor)\s+(?:(?P<owner>\w+)\.)?(?P<name>\w+)\s*(?:\([^)]*\))?[^;]*;",
        (r"^[ \t]*uses\s+(?P<module>[\w.]+(?:\s*,\s*[\w.]+)*)\s*;",), style="end", comments=(("//", "\n"), ("{", "}"), ("(*", "*)")), quotes="'", end=r"end\s*;", words=FLOW, ignore_case=True,
    ),
    "dreammaker": Grammar(
        ("dm", "dme"), r"^(?P<name>(?:/\w+)+)[ \t]*$", r"^[ \t]*proc/(?P<name>\w+)\s*\([^)]*\)", (r"^[ \t]*#include\s+\"(?P<module>[^\"]+)\"",), style="indent", quotes='"', words=FLOW,
    ),
    "ocaml": Grammar(
        ("ml", "mli"), r"^[ \t]*module\s+(?P<name>[A-Z]\w*)\s*=\s*struct", r"^[ \t]*let\s+(?:rec\s+)?(?P<name>[a-z_]\w*)(?=\s+[\w(~])", (r"^[ \t]*open\s+(?P<module>[\w.]+)",), style="line", comments=(("(*", "*)"),), quotes='"',
        calls=r"(?:=|\(|;|\bin|\bthen|\belse)\s*(?P<name>[a-z_]\w*)(?=\s+[\w(\"])", words=FLOW | {"let", "fun", "match", "begin"}, end="end",
    ),
    "commonlisp": Grammar(
        ("lisp", "cl", "lsp", "asd"), r"^\(def(?:class|struct)\s+\(?(?P<name>[\w*+-]+)(?:\s+\((?P<bases>[\w -]+)\))?", r"^\(def(?:un|macro|method|generic)\s+(?P<name>[\w*+-]+)", (r"\((?:require|use-package|in-package)\s+[:'\"](?P<module>[\w.-]+)",),
        style="paren", comments=((";", "\n"), ("#|", "|#")), quotes='"', calls=r"\((?P<name>[a-z][\w*+-]*)(?=[\s)])", words=FLOW | frozenset("defun defclass defmethod defmacro let let* setf progn cond lambda list format".split()),
    ),
    "robot": Grammar(
        ("robot", "resource"), "", r"^(?P<name>(?!\*)\S[^\n]*?)[ \t]*$", (r"^(?:Library|Resource)\s{2,}(?P<module>\S+)",), style="indent", comments=(("#", "\n"),), quotes="", calls=r"^[ \t]{2,}(?P<name>[A-Z]\S*(?: \S+)*)", words=frozenset(),
    ),
}

BY_SUFFIX = {s: g for g in GRAMMARS.values() for s in g.suffixes}
