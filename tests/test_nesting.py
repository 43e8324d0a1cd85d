"""Mixins, scopes and ignore rules against plain loops and by example."""

import random
import subprocess

from weftline.operators import ancestry, nesting


def test_diamonds_circles_and_unknown_parts(spark):
    types = spark.createDataFrame([(t,) for t in ("C", "S", "A", "B", "M", "P", "X", "Y", "Z", None)], "type string")
    parts = [
        ("C", "include", 1, "A"), ("C", "include", 2, "B"), ("A", "include", 1, "M"), ("B", "include", 1, "M"), ("C", "inherit", 1, "S"), ("S", "include", 1, "Kernel"),
        ("C", "prepend", 1, "P"), ("X", "inherit", 1, "Y"), ("Y", "inherit", 1, "X"), ("Z", "include", 1, "X"), ("S", "unknown", 1, "M"), ("A", "include", 1, "M"),
    ]
    order = ancestry.linearised(types, spark.createDataFrame(parts, "type string, kind string, ord int, of string"))
    got = {}
    for r in sorted(order.collect(), key=lambda r: r["pos"]):
        got.setdefault(r["type"], []).append(r["at"])
    assert got["C"] == ["P", "C", "B", "A", "M", "S", "Kernel"] and got["A"] == ["A", "M"] and got["Kernel"] == ["Kernel"]
    assert not got.keys() & {"X", "Y", "Z", None}
    methods = spark.createDataFrame([("M", "run", "m"), ("S", "go", "s"), ("P", "run", "p"), ("C", "run", "c"), ("B", "two", "b1"), ("B", "two", "b2")], "owner string, name string, id string")
    calls = [("1", "C", "run", None), ("2", "C", "run", "P"), ("3", "C", "run", "C"), ("4", "C", "go", None), ("5", "C", "two", None), ("6", "C", "gone", None), ("7", "S", "go", None), ("8", "X", "run", None)]
    bound = ancestry.bound_calls(spark.createDataFrame(calls, "src string, type string, name string, after string"), order, types, methods)
    found = {r["src"]: (r["dst"], r["state"]) for r in bound.collect()}
    assert found == {"1": ("p", "bound"), "2": ("c", "bound"), "3": ("m", "bound"), "4": ("s", "bound"), "5": (None, "ambiguous"), "6": (None, "barrier"), "7": ("s", "bound"), "8": (None, "none")}


def test_deep_chain_of_types(spark):
    types = spark.createDataFrame([(f"t{i}",) for i in range(8)], "type string")
    parts = spark.createDataFrame([(f"t{i}", "inherit", 1, f"t{i - 1}") for i in range(1, 8)], "type string, kind string, ord int, of string")
    assert ancestry.linearised(types, parts).where("type = 't7' and at = 't0'").first()["pos"] == 8
    assert ancestry.linearised(types.limit(0), parts).where("type = 't7'").count() == 0


def test_innermost_against_a_loop(spark):
    rnd, scopes, n = random.Random(1), [], 0

    def nest(path, a, b, depth):
        nonlocal n
        while a < b and depth < 5:
            end = rnd.randint(a, b)
            scopes.append((path, a, end, f"s{n:04}"))
            n += 1
            nest(path, a + rnd.randint(0, 1), end - rnd.randint(0, 1), depth + 1)
            a = end + rnd.randint(1, 4)

    for path in ("a", "b", "c"):
        nest(path, 1, 60, 0)
    places = [(p, line, f"{p}{line}") for p in ("a", "b", "d") for line in range(0, 65)] + [("a", None, "none")]
    got = nesting.innermost(spark.createDataFrame([*scopes, ("a", None, 5, "x")], "path string, start int, end int, id string"), spark.createDataFrame(places, "path string, line int, m string"))
    for r in got.collect():
        around = [s for s in scopes if r["line"] is not None and s[0] == r["path"] and s[1] <= r["line"] <= s[2]]
        want = max(around, key=lambda s: (s[1], -s[2], s[3]))[3] if around else None
        assert r["scope"] == want, r
    assert got.count() == len(places)


def test_ignore_rules_like_git(spark, tmp_path):
    files = {"": "*.log\n!keep.log\nbuild/\n/top.txt\n# c\n\n\\#odd\ndocs/**/draft\n**/cache\nx[0-3]?.dat\nend   \n", "a": "!*.log\ninner/*.tmp\n", "a/b": "*.log\n!special.log\nbuild\n"}
    paths = [
        "z.log", "keep.log", "a/z.log", "a/b/z.log", "a/b/special.log", "a/b/c/special.log", "build", "a/build/x", "a/b/build", "top.txt", "a/top.txt", "#odd", "docs/draft", "docs/q/r/draft", "a/docs/draft",
        "cache/x", "a/cache/y", "x0a.dat", "x9a.dat", "a/inner/k.tmp", "inner/k.tmp", "end", "end2", "build.d/x", "a/b/c/build/w", "src/build/keep.log",
    ]
    rules = nesting.ignore_rules(spark.createDataFrame([*files.items(), (None, "*"), ("q", None)], "folder string, text string"))
    got = {r["path"]: r["ignored"] for r in nesting.ignored(spark.createDataFrame([(p,) for p in [*paths, None]], "path string"), rules).collect()}
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    for folder, text in files.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text(text)
    for p in paths:
        if not any(q.startswith(p + "/") for q in paths):
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            if not (tmp_path / p).exists():
                (tmp_path / p).write_text("")
    said = subprocess.run(["git", "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True, cwd=tmp_path).stdout.splitlines()
    assert {p for p, x in got.items() if x} == {p.strip('"') for p in said} and None not in got


def test_parts_of_split_types(spark):
    rows = [("1", "n", None, "T", True), ("2", "n", None, "T", True), ("3", "n", None, "T", False), ("4", "n", "1", "U", True), ("5", "n", "2", "U", True), ("6", "n", "3", "U", True), ("7", "m", None, "T", True), ("8", "n", "5", "V", False)]
    got = {r["id"]: r["same"] for r in nesting.merged_parts(spark.createDataFrame(rows, "id string, module string, outer string, name string, partial boolean")).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "4", "6": "6", "7": "7", "8": "8"}
