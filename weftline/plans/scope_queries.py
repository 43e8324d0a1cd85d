"""Queries on names across modules: exports by fixpoint, uses in files of six languages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scopes as S
from ..sources.symbols import symbol_facts
from .kgview import table
from .registry import query

FACTS_SQL = """declares AS (
  SELECT 'm' || (p_partkey // 4) AS module, p_name AS name, 'part_' || p_partkey AS symbol FROM part WHERE p_size % 3 > 0
  UNION ALL SELECT 'm' || (p_partkey // 4), 'default', 'part_' || p_partkey FROM part WHERE p_size % 3 = 0),
passed AS (
  SELECT 'm' || p_partkey AS module, NULL::VARCHAR AS name, 'm' || (p_partkey // 3) AS of, NULL::VARCHAR AS of_name FROM part WHERE p_partkey % 4 < 2
  UNION ALL SELECT 'm' || p_partkey, NULL, 'm' || (p_partkey + 1), NULL FROM part WHERE p_partkey % 9 = 1
  UNION ALL SELECT 'm' || (p_partkey + 1), NULL, 'm' || p_partkey, NULL FROM part WHERE p_partkey % 9 = 1
  UNION ALL SELECT 'm' || (o_orderkey % 97), 'x' || (o_custkey % 11), 'm' || (o_orderkey % 41), CASE WHEN o_orderkey % 3 = 0 THEN p_name WHEN o_orderkey % 3 = 1 THEN 'x' || (o_orderkey % 11) ELSE 'default' END
    FROM orders JOIN part ON p_partkey = o_orderkey % 150)"""


@query(
    "symbol_scopes",
    f"""WITH RECURSIVE {FACTS_SQL},
hidden AS (SELECT module, name FROM declares UNION SELECT module, name FROM passed WHERE name IS NOT NULL),
e(module, name, symbol) AS (
  SELECT * FROM declares
  UNION SELECT p.module, coalesce(p.name, e.name), e.symbol FROM e JOIN passed p ON p.of = e.module
    WHERE p.of_name = e.name OR p.name IS NULL AND e.name <> 'default' AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.module = p.module AND h.name = e.name))
SELECT module, name, count(*) AS n, min(symbol) AS symbol FROM e GROUP BY module, name""",
)
def symbol_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that modules of parts export, through aliases, wildcards and circles of both."""
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    m = lambda x: F.expr(f"concat('m', {x})")
    none = F.lit(None).cast("string")
    name = F.when(F.col("p_size") % 3 == 0, "default").otherwise(F.col("p_name"))
    declares = p.select(m("p_partkey div 4").alias("module"), name.alias("name"), F.expr("concat('part_', p_partkey)").alias("symbol"))
    wild = lambda where, a, b: p.where(where).select(m(a).alias("module"), none.alias("name"), m(b).alias("of"), none.alias("of_name"))
    of_name = F.expr("case o_orderkey % 3 when 0 then p_name when 1 then concat('x', o_orderkey % 11) else 'default' end")
    named = o.join(p.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("o_orderkey") % 150)
    named = named.select(m("o_orderkey % 97").alias("module"), F.expr("concat('x', o_custkey % 11)").alias("name"), m("o_orderkey % 41").alias("of"), of_name.alias("of_name"))
    passed = wild("p_partkey % 4 < 2", "p_partkey", "p_partkey div 3").union(wild("p_partkey % 9 = 1", "p_partkey", "p_partkey + 1"))
    passed = passed.union(wild("p_partkey % 9 = 1", "p_partkey + 1", "p_partkey")).union(named)
    return S.exports(declares, passed).groupBy("module", "name").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))


#: One file for each customer i, of five variants (i % 5); j is i / 2, k is i / 4, both cut. A sample has a path and
#: lines for each variant, and what the use in the last line but `after` means: name, qualifier, symbol, tier, n.
VALUES = {"i": "c_custkey", "j": "c_custkey {div} 2", "k": "c_custkey {div} 4"}
Variant = tuple[str, list[str], str, str | None, str, str, str]
OWN = "CASE WHEN c_custkey = 0 THEN 0 ELSE {} END"
FROM_STAR = "CASE WHEN (c_custkey // 2) % 5 IN ({}) THEN {} END"

PY_TAIL = ["def f{i}():", "    return '''f{j}()'''  # g()"]
JS_TAIL = ["export function f{i}() { return 'g()' } // f{j}()", "/* f{j}() */"]
SAMPLES: dict[str, tuple[str | None, list[Variant]]] = {
    "python": (None, [
        ("pkg/m{i}.py", ["from pkg.m{j} import f{j}", *PY_TAIL, "f{j}()"], "f{j}", None, "pkg.m{j}.f{j}", OWN.format(1), "1"),
        ("pkg/m{i}.py", ["from .m{j} import f{j} as g", *PY_TAIL, "g()"], "g", None, "pkg.m{j}.f{j}", "1", "1"),
        ("pkg/m{i}.py", ["import pkg.m{j} as mod", *PY_TAIL, "mod.f{j}()"], "f{j}", "mod", "pkg.m{j}.f{j}", "1", "1"),
        ("pkg/m{i}.py", ["from pkg.m{j} import *", *PY_TAIL, "f{j}()"], "f{j}", None, "pkg.m{j}.f{j}", "3", "1"),
        ("pkg/m{i}.py", ["from .m{j} import f{k}", *PY_TAIL, "f{k}()"], "f{k}", None, "?0, 3:pkg.m{k}.f{k}", FROM_STAR.format("0, 3", 1), "coalesce(" + FROM_STAR.format("0, 3", 1) + ", 0)"),
    ]),
    "javascript": (None, [
        ("src/m{i}.js", ["import { f{j} } from './m{j}'", *JS_TAIL, "f{j}()"], "f{j}", None, "src/m{j}.f{j}", OWN.format(1), "1"),
        ("src/m{i}.js", ["import { f{j} as g } from \"./m{j}.js\"", *JS_TAIL, "g()"], "g", None, "src/m{j}.f{j}", "1", "1"),
        ("src/m{i}.js", ["import * as mod from '../src/m{j}'", *JS_TAIL, "mod.f{j}()"], "f{j}", "mod", "src/m{j}.f{j}", "1", "1"),
        ("src/m{i}.js", ["export * from './m{j}'", *JS_TAIL, "f{j}()"], "f{j}", None, "?9:", "NULL", "0"),
        ("src/m{i}.js", ["import { f{k} } from './m{j}'", *JS_TAIL, "f{k}()"], "f{k}", None, "?3:src/m{k}.f{k}", FROM_STAR.format("3", 1), "coalesce(" + FROM_STAR.format("3", 1) + ", 0)"),
    ]),
    "java": (None, [
        ("p{i}/C{i}.java", ["package p{i};", "import p{j}.C{j};", "public class C{i} {", "  Object a = new C{j}(); }"], "C{j}", None, "p{j}.C{j}", OWN.format(1), "1"),
        ("p{j}/D{i}.java", ["package p{j};", "// import x.C{j};", "class D{i} {", "  Object a = new C{j}(); }"], "C{j}", None, "?0, 2, 3, 4:p{j}.C{j}", FROM_STAR.format("0, 2, 3, 4", 2), "coalesce(" + FROM_STAR.format("0, 2, 3, 4", 1) + ", 0)"),
        ("p{i}/C{i}.java", ["package p{i};", "import p{j}.*;", "public class C{i} {", "  Object a = new C{j}(); }"], "C{j}", None, "?0, 2, 3, 4:p{j}.C{j}", FROM_STAR.format("0, 2, 3, 4", 3), "coalesce(" + FROM_STAR.format("0, 2, 3, 4", 1) + ", 0)"),
        ("p{i}/C{i}.java", ["package p{i};", "import p{j}.C{j};", "public class C{i} { /* new C{j}() */", "  String a = \"new C{j}()\"; Object b = new C{i}(); }"], "C{i}", None, "p{i}.C{i}", "0", "1"),
        ("p{i}/C{i}.java", ["package p{i};", "import q.Gone;", "public class C{i} {", "  Object a = new Gone(); }"], "Gone", None, "?9:", "NULL", "0"),
    ]),
    "php": (None, [
        ("n{i}/C.php", ["<?php", "namespace App\\N{i};", "use App\\N{j}\\C{j};", "class C{i} {}", "$a = new C{j}();"], "C{j}", None, "App\\N{j}.C{j}", OWN.format(1), "1"),
        ("n{i}/C.php", ["<?php", "namespace App\\N{i};", "use App\\N{j}\\C{j} as X;", "class C{i} {}", "$a = new X();"], "X", None, "App\\N{j}.C{j}", "1", "1"),
        ("n{i}/C.php", ["<?php", "namespace App\\N{i};", "use App\\N{j}\\{C{j} as Y};", "class C{i} {}", "$a = new Y();"], "Y", None, "App\\N{j}.C{j}", "1", "1"),
        ("n{i}/C.php", ["<?php", "namespace App\\N{i};", "// use App\\C;", "class C{i} {}", "$a = new \\App\\N{j}\\C{j}();"], "\\0", None, "App\\N{j}.C{j}", "1", "1"),
        ("n{i}/C.php", ["<?php", "namespace App\\N{i};", "", "class C{i} {}", "$a = new C{j}();"], "C{j}", None, "?9:", "NULL", "0"),
    ]),
    "go": (None, [
        ("ex.com/p{i}/a.go", ["package p", "import \"ex.com/p{j}\"", "func F{i}() {", "  p{j}.F{j}() }"], "F{j}", "p{j}", "ex.com/p{j}.F{j}", "1", "1"),
        ("ex.com/p{i}/a.go", ["package p", "import q \"ex.com/p{j}\"", "func F{i}() {", "  q.F{j}() }"], "F{j}", "q", "ex.com/p{j}.F{j}", "1", "1"),
        ("ex.com/p{i}/a.go", ["package p", "import . \"ex.com/p{j}\"", "func F{i}() {", "  F{j}() }"], "F{j}", None, "ex.com/p{j}.F{j}", "3", "1"),
        ("ex.com/p{i}/a.go", ["package p", "func f{i}() {}", "func F{i}() {", "  f{i}() }"], "f{i}", None, "ex.com/p{i}.f{i}", "0", "1"),
        ("ex.com/p{i}/a.go", ["package p", "// import q \"ex.com/p{j}\"", "func F{i}() {", "  q.F{j}() }"], "F{j}", "q", "?9:", "NULL", "0"),
    ]),
    "csharp": (".", [
        ("n{i}/C.cs", ["using A.N{j};", "namespace A.N{i};", "class C{i} {", "  object a = new C{j}(); }"], "C{j}", None, "?0, 1, 3, 4:A.N{j}.C{j}", OWN.format(FROM_STAR.format("0, 1, 3, 4", 3)), "coalesce(" + FROM_STAR.format("0, 1, 3, 4", 1) + ", 0)"),
        ("n{i}/C.cs", ["using X = A.N{j}.C{j};", "namespace A.N{i};", "class C{i} {", "  object a = new X(); }"], "X", None, "?0, 1, 3, 4:A.N{j}.C{j}", FROM_STAR.format("0, 1, 3, 4", 1), "coalesce(" + FROM_STAR.format("0, 1, 3, 4", 1) + ", 0)"),
        ("n{i}/C.cs", ["using Other;", "namespace A.N{j}.Inner{i};", "class C{i} {", "  object a = new C{j}(); }"], "C{j}", None, "?0, 1, 3, 4:A.N{j}.C{j}", FROM_STAR.format("0, 1, 3, 4", 2), "coalesce(" + FROM_STAR.format("0, 1, 3, 4", 1) + ", 0)"),
        ("n{i}/C.cs", ["using A.N{j};", "namespace A.N{i};", "class C{i} {", "  object a = new C{i}(); }"], "C{i}", None, "A.N{i}.C{i}", "0", "1"),
        ("n{i}/C.cs", ["// using A.N{j};", "namespace A.N{i};", "class C{i} {", "  object a = new C{j}(); }"], "C{j}", None, "?9:", "NULL", "0"),
    ]),
}
FIELD = re.compile(r"\{([ijk])\}")


def _pieces(text: str) -> list[tuple[bool, str]]:
    return [(n % 2 == 1, x) for n, x in enumerate(FIELD.split(text)) if x]


def _column(text: str) -> Column:
    return F.concat(F.lit(""), *(F.expr(VALUES[x].format(div="div")).cast("string") if value else F.lit(x) for value, x in _pieces(text)))


def _sql(text: str | None) -> str:
    """SQL for a text of the sample; `?a, b:text` is null unless j's variant is a or b."""
    if text is None:
        return "NULL::VARCHAR"
    if text.startswith("?"):
        variants, _, rest = text[1:].partition(":")
        return f"CASE WHEN (c_custkey // 2) % 5 IN ({variants}) THEN {_sql(rest)} END"
    return " || ".join(["''", *(f"({VALUES[x].format(div='//')})::VARCHAR" if value else "'" + x.replace("'", "''") + "'" for value, x in _pieces(text))])


def _register(language: str, nested: str | None, variants: list[Variant]) -> None:
    def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer")
        of = lambda columns: F.element_at(F.array(*columns), (F.col("c_custkey") % 5 + 1).cast("int"))
        files = c.select(of([_column(v[0]) for v in variants]).alias("path"), of([F.concat_ws("\n", *(_column(x) for x in v[1])) for v in variants]).alias("text"))
        return S.resolved(symbol_facts(files), nested=nested)

    symbols.__doc__ = f"What the names used in {language} files mean, one file for each customer."
    rows = [
        f"SELECT {_sql(path)} AS path, {_sql(name)} AS name, {_sql(of)} AS of, {len(lines)} AS line, {_sql(symbol)} AS symbol, cast({tier} AS INTEGER) AS tier, cast({n} AS INTEGER) AS n FROM customer WHERE c_custkey % 5 = {v}"
        for v, (path, lines, name, of, symbol, tier, n) in enumerate(variants)
    ]
    query(f"{language}_symbols", "\nUNION ALL ".join(rows))(symbols)


for _language, (_nested, _variants) in SAMPLES.items():
    _register(_language, _nested, _variants)
