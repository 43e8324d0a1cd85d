"""What lies within what: packages by the longest prefix, scopes of lines, rules of folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column, separator: str) -> Column:
    """The path's beginnings at its separators, the shortest first, itself last."""
    parts = F.split(path, rf"\Q{separator}\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def import_targets(imports: DataFrame, packages: DataFrame, symbols: DataFrame, separator: str = ".") -> DataFrame:
    """path, target, package, symbol: imports (path, target) of full names bound to the longest package
    (package) that begins them, and to the one symbol (package, name, id) that it has of the next
    name; null where there is none, or several. Prefixes are spelled out once and joined by equality.
    """
    asked = imports.where("path is not null and target is not null").select("path", "target").distinct()
    heads = asked.select("target").distinct().select("target", F.explode(prefixes(F.col("target"), separator)).alias("package"))
    longest = heads.join(packages.select("package").distinct(), "package").groupBy("target").agg(F.max_by("package", F.length("package")).alias("package"))
    rest = F.expr(f"substring(target, length(package) + {len(separator) + 1})")
    named = longest.withColumn("name", F.element_at(F.split(rest, rf"\Q{separator}\E"), 1))
    one = symbols.groupBy("package", "name").agg(F.min("id").alias("symbol"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    found = named.join(one, ["package", "name"], "left").select("target", "package", "symbol")
    return asked.join(found, "target", "left").select("path", "target", "package", "symbol")


def innermost(scopes: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, line, and more) with the id of the innermost scope (path, start, end, id) around
    each, or null, as `scope`.

    A sweep over a file's lines: scopes open and close on a stack, and a place belongs to the top. The
    scopes of a file nest; a place without a line has no scope. Of those that begin on one line the longer one is outside, of equal
    ones the smaller id. What crosses is closed with what it began in. A file's scopes and its different lines
    are one group; places, however many there are on a line, never are.
    """
    names = [c for c in places.columns if c != "path"]
    kinds = dict(places.dtypes)
    schema = f"_path {kinds['path']}, _line {kinds['line']}, scope {dict(scopes.dtypes)['id']}"

    def sweep(key: tuple, scoped: pd.DataFrame, placed: pd.DataFrame) -> pd.DataFrame:
        opens = sorted(zip(scoped["start"], -scoped["end"], scoped["id"], strict=True))
        stack: list[tuple] = []
        at, found = 0, {}
        for line in sorted(placed["line"]):
            while at < len(opens) and opens[at][0] <= line:
                while stack and stack[-1][0] < opens[at][0]:
                    stack.pop()
                stack.append((min(-opens[at][1], stack[-1][0] if stack else -opens[at][1]), opens[at][2]))
                at += 1
            while stack and stack[-1][0] < line:
                stack.pop()
            found[line] = stack[-1][1] if stack else None
        return pd.DataFrame({"_path": [key[0]] * len(found), "_line": list(found), "scope": list(found.values())}, dtype=object)

    own = scopes.where("start is not null and end is not null and id is not null").groupBy("path")
    placed = places.select("path", *names)
    lines = placed.where("line is not null").select("path", "line").distinct()
    found = own.cogroup(lines.groupBy("path")).applyInPandas(sweep, schema)
    at = F.col("path").eqNullSafe(F.col("_path")) & (F.col("line") == F.col("_line"))
    return placed.join(found, at, "left").drop("_path", "_line")


def merged_parts(types: DataFrame) -> DataFrame:
    """id, same: types (id, module, outer, name, partial) by the id that all parts of one type share, the
    smallest. Parts have module, outer type and name in common; an outer type that is itself in
    parts counts as one. Types that aren't partial stay themselves. Outer types come first, level by level.
    """
    own = types.select("id", "module", "outer", "name", "partial").dropDuplicates(["id"])
    done = None
    level = own.join(own.select(F.col("id").alias("outer")), "outer", "left_anti")
    level = level.select("id", "module", "name", "partial", F.lit(None).cast(dict(own.dtypes)["id"]).alias("above"))
    while True:
        group = F.when(F.col("partial"), F.lit(None).cast(dict(own.dtypes)["id"])).otherwise(F.col("id"))
        lead = level.withColumn("alone", group).groupBy("module", "above", "name", "alone").agg(F.min("id").alias("same"), F.collect_list("id").alias("ids"))
        new = lead.select(F.explode("ids").alias("id"), "same")
        done = new if done is None else done.union(new)
        inner = own.join(new.select(F.col("id").alias("outer"), F.col("same").alias("above")), "outer").select("id", "module", "name", "partial", "above")
        if inner.isEmpty():
            return done
        level = inner


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over the path below the rule's folder, whether it takes back, whether it is for folders
    only) of a line of an ignore file; None for comments and blank lines."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    folders = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        c = body[i]
        close = body.find("]", i + 2) if c == "[" else -1
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1 + (body[i + 1 : i + 2] == "*")
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif close > 0:
            inner = body[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", close + 1
        else:
            i += c == "\\" and i + 1 < len(body)
            c = body[i]
            out, i = out + (c if c.isalnum() or c in "_-/" else "\\" + c), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$", back, folders


def ignore_rules(files: DataFrame) -> DataFrame:
    """folder, ord, regex, back, folders of all rules in ignore files (folder, text). The root's folder
    is ''. Files of one folder are in the order of `ord`, if there is such a column."""
    order = F.col("ord") if "ord" in files.columns else F.lit(0)
    lines = files.where("folder is not null and text is not null").select("folder", order.alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, o, n, *r) for f, o, n, line in zip(b["folder"], b["file"], b["n"], b["line"], strict=True) if (r := ignore_rule(line))]
            yield pd.DataFrame(rows, columns=["folder", "file", "n", "regex", "back", "folders"])

    parsed = lines.mapInPandas(run, "folder string, file long, n int, regex string, back boolean, folders boolean")
    return parsed.select("folder", F.struct("file", "n").alias("ord"), "regex", "back", "folders")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, ignored: paths of files against ignore_rules() of all folders.

    The last rule that fits decides, those of deeper folders after those of outer ones; what is below an
    ignored folder is ignored, whatever rules say. Each folder and file is looked at once, against the
    rules of the folders above it, which are joined by name.
    """
    own = paths.where("path is not null").select("path").distinct()
    heads = own.select("path", F.explode(prefixes(F.col("path"), "/")).alias("head")).withColumn("is_folder", F.col("head") != F.col("path"))
    each = heads.select("head", "is_folder").distinct()
    above = F.concat(F.array(F.lit("")), F.slice(prefixes(F.col("head"), "/"), F.lit(1), F.size(F.split("head", "/")) - 1))
    asked = each.select("head", "is_folder", F.posexplode(above).alias("depth", "folder"))
    below = F.when(F.col("folder") == "", F.col("head")).otherwise(F.expr("substring(head, length(folder) + 2)"))
    met = asked.join(rules, "folder").withColumn("below", below).where(F.expr("(not folders or is_folder) and below rlike regex"))
    out = met.groupBy("head", "is_folder").agg(F.max_by("back", F.struct("depth", "ord")).alias("back")).where("not back")
    bad = heads.join(out, ["head", "is_folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return own.join(bad, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
