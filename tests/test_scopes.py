"""Facts of files and what names mean, on small projects with odd files."""

from weftline.operators import scopes
from weftline.sources.symbols import symbol_facts


def resolved(spark, files, **more):
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    return {(r["path"], r["of"], r["name"]): (r["symbol"], r["tier"], r["n"]) for r in scopes.resolved(symbol_facts(df), **more).collect()}


def test_exports_of_circles_aliases_and_hidden_names(spark):
    declares = spark.createDataFrame([("a", "x", "a.x"), ("b", "y", "b.y"), ("c", "x", "c.x"), ("c", "default", "c.d"), (None, "z", "z"), ("d", "z", None), ("a", "x", "a.x")], "module string, name string, symbol string")
    passed = [("a", None, "b", None), ("b", None, "c", None), ("c", None, "a", None), ("e", "q", "a", "y"), ("f", "r", "e", "q"), ("e", "q", "f", "r"), ("g", None, "f", None), ("h", "s", "gone", "s")]
    got = scopes.exports(declares, spark.createDataFrame(passed, "module string, name string, of string, of_name string"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", "x", "a.x"), ("a", "y", "b.y"), ("b", "y", "b.y"), ("b", "x", "c.x"), ("c", "x", "c.x"), ("c", "y", "b.y"), ("c", "default", "c.d"),
        ("e", "q", "b.y"), ("f", "r", "b.y"), ("g", "r", "b.y"),
    }


def test_long_chains_of_wildcards(spark):
    declares = spark.createDataFrame([("m0", "x", "m0.x")], "module string, name string, symbol string")
    passed = spark.createDataFrame([(f"m{i + 1}", None, f"m{i}", None) for i in range(12)], "module string, name string, of string, of_name string")
    assert scopes.exports(declares, passed).count() == 13


def test_python_packages_and_broken_files(spark):
    got = resolved(spark, {
        "app/__init__.py": "from .core import run as start\nfrom . import util\n", "app/core.py": "def run(): ...\ndef _own(): ...\nrun()\n", "app/util/__init__.py": "from .text import *\n",
        "app/util/text.py": "class T: ...\ndef clean(): ...\nclass U(T): ...\n", "main.py": "import app\nfrom app.util import clean\nfrom app import util, start\nstart(); clean(); util.clean(); app.start(); app.core.run(); _own(); len('')\n",
        "bad.py": "def broken(:\n", "empty.py": "", None: "x()", "none.py": None,
    })
    assert got[("app/core.py", None, "run")] == ("app.core.run", 0, 1) and got[("app/util/text.py", None, "T")] == ("app.util.text.T", 0, 1)
    assert got[("main.py", None, "start")] == ("app.core.run", 1, 1) and got[("main.py", None, "clean")] == ("app.util.text.clean", 1, 1)
    assert got[("main.py", "util", "clean")] == ("app.util.text.clean", 1, 1) and got[("main.py", "app", "start")] == ("app.core.run", 1, 1)
    assert got[("main.py", None, "_own")] == got[("main.py", None, "len")] == (None, None, 0)
    assert not any(p in ("bad.py", "none.py", None) for p, _, _ in got)


def test_javascript_defaults_lists_and_barrels(spark):
    got = resolved(spark, {
        "src/a.ts": "class Engine {}\nfunction help() {}\nexport { Engine as Motor, help };\nexport default class Shell {}\n",
        "src/index.ts": "export { Motor as M, help } from './a';\nexport * from './b';\nexport { default as Shell } from './a'\n", "src/b.ts": "export const help = () => 1;\nexport function only() {}\n",
        "src/use.tsx": "import Sh, { Motor } from './a';\nimport { M, help, only, Shell as S } from '.';\nconst t = new Motor(); new M(); help(); only(); new Sh(); new S();\nclass X extends M {}\n",
        "src/old.js": "const a = require('./a');\nconst { only: o } = require('./b');\na.help(); o(); a.gone();\n",
    })
    use = lambda name: got[("src/use.tsx", None, name)][0]
    assert use("Motor") == use("M") == "src/a.Engine" and use("help") == "src/a.help" and use("only") == "src/b.only"
    assert use("Sh") == use("S") == "src/a.Shell"
    assert got[("src/old.js", "a", "help")][0] == "src/a.help" and got[("src/old.js", None, "o")][0] == "src/b.only" and got[("src/old.js", "a", "gone")] == (None, None, 0)


def test_two_wildcards_with_one_name_bind_nothing(spark):
    got = resolved(spark, {
        "a/X.java": "package a;\npublic class X {}\n", "b/X.java": "package b;\npublic class X {}\n", "b/Y.java": "package b;\nclass Y extends X {}\n",
        "c/Use.java": "package c;\nimport a.*;\nimport b.*;\nclass Use { X x = new X(); Y y = new Y(); }\n", "c/One.java": "package c;\nimport a.*;\nimport b.X;\nclass One { X x = new X(); }\n",
    })
    assert got[("c/Use.java", None, "X")] == (None, 3, 2) and got[("c/Use.java", None, "Y")] == ("b.Y", 3, 1)
    assert got[("c/One.java", None, "X")] == ("b.X", 1, 1) and got[("b/Y.java", None, "X")] == ("b.X", 2, 1)


def test_no_files(spark):
    assert scopes.resolved(symbol_facts(spark.createDataFrame([], "path string, text string"))).count() == 0
