"""Queries on mixins, packages, scopes, partial types and ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ancestry as A
from ..operators import nesting as N
from ..session import checkpointed
from .display_queries import given, given_sql
from .kgview import table
from .registry import query

MIXINS_SQL = """types AS (SELECT 'c' || c_custkey AS type FROM customer UNION SELECT 'm' || (p_partkey % 40) FROM part WHERE p_partkey % 40 <> 13),
parts AS (
  SELECT 'c' || c_custkey AS type, 'inherit' AS kind, 1 AS ord, 'c' || (c_custkey // 2) AS of FROM customer WHERE c_custkey > 0 AND c_custkey % 3 > 0
  UNION ALL SELECT 'c' || c_custkey, 'include', 1, 'm' || (c_custkey % 17) FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'c' || c_custkey, 'include', 2, 'm' || (c_custkey % 11) FROM customer WHERE c_custkey % 5 < 3
  UNION ALL SELECT 'c' || c_custkey, 'prepend', 1, 'm' || (20 + c_custkey % 9) FROM customer WHERE c_custkey % 4 = 1
  UNION ALL SELECT DISTINCT 'm' || (p_partkey % 40), 'include', 1, 'm' || (p_partkey % 40 // 2) FROM part WHERE p_partkey % 40 BETWEEN 1 AND 39
  UNION ALL SELECT DISTINCT 'm' || (p_partkey % 40), 'include', 2, 'm' || (p_partkey % 40 // 3) FROM part WHERE p_partkey % 40 BETWEEN 1 AND 39),
p2 AS (SELECT DISTINCT p.*, CASE kind WHEN 'prepend' THEN -1 WHEN 'include' THEN 1 ELSE 2 END AS side, CASE kind WHEN 'inherit' THEN ord ELSE -ord END AS turn FROM parts p WHERE type IN (SELECT type FROM types)),
walk(type, anc, pth) AS (
  SELECT DISTINCT type, type, []::INTEGER[] FROM (SELECT type FROM types UNION SELECT of FROM p2)
  UNION ALL SELECT w.type, p.of, w.pth || [p.side, p.turn::INTEGER] FROM walk w JOIN p2 p ON p.type = w.anc),
chain AS (SELECT type, anc, row_number() OVER (PARTITION BY type ORDER BY pth) AS pos FROM (SELECT type, anc, max(pth || [0]) AS pth FROM walk GROUP BY type, anc))"""


def _mixins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("m")).distinct()
    types = c.selectExpr("concat('c', c_custkey) AS type").union(p.where("m <> 13").selectExpr("concat('m', m)"))
    part = lambda df, where, type_, kind, ord_, of: df.where(where).selectExpr(f"concat({type_}) AS type", f"'{kind}' AS kind", f"{ord_} AS ord", f"concat({of}) AS of")
    parts = part(c, "c_custkey > 0 and c_custkey % 3 > 0", "'c', c_custkey", "inherit", 1, "'c', c_custkey div 2")
    for more in (
        part(c, "c_custkey % 2 = 0", "'c', c_custkey", "include", 1, "'m', c_custkey % 17"), part(c, "c_custkey % 5 < 3", "'c', c_custkey", "include", 2, "'m', c_custkey % 11"),
        part(c, "c_custkey % 4 = 1", "'c', c_custkey", "prepend", 1, "'m', 20 + c_custkey % 9"),
        part(p, "m >= 1", "'m', m", "include", 1, "'m', m div 2"), part(p, "m >= 1", "'m', m", "include", 2, "'m', m div 3"),
    ):
        parts = parts.union(more)
    return types, parts


@query("mixin_order", f"WITH RECURSIVE {MIXINS_SQL} SELECT type, string_agg(anc, ' ' ORDER BY pos) AS ancestors FROM chain GROUP BY type")
def mixin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order the mixins and parents of types are asked for a method."""
    order = A.linearised(*_mixins(spark, sf_dir))
    lined = F.transform(F.sort_array(F.collect_list(F.struct("pos", "at"))), lambda x: x["at"])
    return order.groupBy("type").agg(F.array_join(lined, " ").alias("ancestors"))


METHODS_SQL = """methods AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'm' || (p_partkey % 40) ELSE 'c' || (p_partkey % 60) END AS owner, p_name AS name, 'p' || p_partkey AS id FROM part),
calls AS (SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS type, p_name AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_custkey END AS after FROM orders JOIN part ON p_partkey = o_orderkey % 200)"""


@query(
    "mixin_calls",
    f"""WITH RECURSIVE {MIXINS_SQL}, {METHODS_SQL},
own AS (SELECT owner, name, min(id) AS dst, count(DISTINCT id) AS n FROM methods GROUP BY ALL),
asked AS (SELECT c.*, coalesce(s.pos, 0) AS behind FROM calls c LEFT JOIN chain s ON s.type = c.type AND s.anc = c.after),
hit AS (SELECT a.src, c.anc, c.pos, o.dst, o.n FROM asked a JOIN chain c ON c.type = a.type AND c.pos > a.behind JOIN own o ON o.owner = c.anc AND o.name = a.name QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY c.pos) = 1),
s AS (SELECT a.src, a.type, a.name, a.after, h.anc, h.dst,
  CASE WHEN EXISTS (SELECT 1 FROM chain c WHERE c.type = a.type AND c.pos > a.behind AND c.pos < coalesce(h.pos, 1000000) AND c.anc NOT IN (SELECT type FROM types)) THEN 'barrier'
       WHEN h.src IS NULL THEN 'none' WHEN h.n > 1 THEN 'ambiguous' ELSE 'bound' END AS state FROM asked a LEFT JOIN hit h ON h.src = a.src)
SELECT src, type, name, after, CASE WHEN state = 'bound' THEN anc END AS owner, CASE WHEN state = 'bound' THEN dst END AS dst, state FROM s""",
)
def mixin_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, some of `super`, bound along the order of mixins and parents."""
    types, parts = _mixins(spark, sf_dir)
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    owner = F.expr("case when p_size % 2 = 0 then concat('m', p_partkey % 40) else concat('c', p_partkey % 60) end")
    methods = p.select(owner.alias("owner"), F.col("p_name").alias("name"), F.expr("concat('p', p_partkey)").alias("id"))
    calls = o.join(p.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("o_orderkey") % 200)
    calls = calls.selectExpr("concat('o', o_orderkey) AS src", "concat('c', o_custkey) AS type", "p_name AS name", "case when o_orderkey % 4 = 0 then concat('c', o_custkey) end AS after")
    return A.bound_calls(calls, A.linearised(types, parts), types, methods)


PACKAGES = {
    "package": "CASE p_partkey % 4 WHEN 0 THEN 'org.a' || (p_partkey % 9) WHEN 1 THEN 'org.a' || (p_partkey % 9) || '.b' || (p_size % 4) WHEN 2 THEN 'org' ELSE 'org.a' || (p_partkey % 9) || '.b' || (p_size % 4) || '.c' || (p_size % 3) END",
    "name": "'T' || (p_partkey % 23)",
    "id": "'part_' || p_partkey",
}
IMPORTS = {
    "path": "'f' || o_orderkey || '.kt'",
    "target": "CASE o_orderkey % 5 WHEN 0 THEN 'org.a' || (o_custkey % 9) || '.b' || (o_custkey % 5) || '.T' || (o_custkey % 23) WHEN 1 THEN 'org.T' || (o_custkey % 23) || '.inner' WHEN 2 THEN 'org.a' || (o_custkey % 11) || '.b' || (o_custkey % 4) || '.c' || (o_custkey % 3) || '.T' || (o_custkey % 29) WHEN 3 THEN 'org.a1x.T1' ELSE 'ext.lib.T' || (o_custkey % 3) END",
}


@query(
    "import_targets",
    f"""WITH s AS ({given_sql('part', **PACKAGES)}), i AS ({given_sql('orders', **IMPORTS)}), pk AS (SELECT DISTINCT package FROM s),
 l AS (SELECT target, package FROM (SELECT DISTINCT target FROM i) JOIN pk ON target = package OR starts_with(target, package || '.') QUALIFY row_number() OVER (PARTITION BY target ORDER BY length(package) DESC) = 1),
 o AS (SELECT package, name, min(id) AS id FROM s GROUP BY ALL HAVING count(DISTINCT id) = 1)
 SELECT i.path, i.target, l.package, o.id AS symbol FROM i LEFT JOIN l USING (target) LEFT JOIN o ON o.package = l.package AND o.name = split_part(substr(i.target, length(l.package) + 2), '.', 1)""",
)
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by full name, bound to the innermost of packages within packages."""
    s = given(spark, sf_dir, "part", **PACKAGES)
    return N.import_targets(given(spark, sf_dir, "orders", **IMPORTS), s.select("package"), s)


SCOPES_SQL = """scopes AS (
  SELECT 'f' || (p_partkey % 25) || '.cs' AS path, 100 * (p_partkey // 25) AS s_, 100 * (p_partkey // 25) + 99 AS e_, 'a' || p_partkey AS id, 'N' || (p_size % 3) AS module, NULL::VARCHAR AS up, 'T' || (p_partkey % 7) AS name, p_size % 4 > 0 AS partial FROM part
  UNION ALL SELECT 'f' || (p_partkey % 25) || '.cs', 100 * (p_partkey // 25) + 10, 100 * (p_partkey // 25) + 10 + p_size, 'b' || p_partkey, 'N' || (p_size % 3), 'a' || p_partkey, 'U' || (p_size % 2), p_partkey % 3 > 0 FROM part
  UNION ALL SELECT 'f' || (p_partkey % 25) || '.cs', 100 * (p_partkey // 25) + 10 + p_size // 2, 100 * (p_partkey // 25) + 10 + p_size - p_size // 4, 'c' || p_partkey, 'N' || (p_size % 3), 'b' || p_partkey, 'V', true FROM part WHERE p_size > 8),
places AS (SELECT 'f' || (l_orderkey % 25) || '.cs' AS path, l_partkey * 7 % 900 + l_linenumber AS line, 'x' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey || '_' || l_partkey AS member FROM lineitem)"""


def _scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    row = lambda start, end, kind, outer, name, partial: p.selectExpr("concat('f', p_partkey % 25, '.cs') AS path", f"cast({start} as int) AS start", f"cast({end} as int) AS end", f"concat('{kind}', p_partkey) AS id", "concat('N', p_size % 3) AS module", f"{outer} AS outer", f"{name} AS name", f"{partial} AS partial", "p_size")
    base = "100 * (p_partkey div 25)"
    scopes = row(base, f"{base} + 99", "a", "cast(null as string)", "concat('T', p_partkey % 7)", "p_size % 4 > 0").union(
        row(f"{base} + 10", f"{base} + 10 + p_size", "b", "concat('a', p_partkey)", "concat('U', p_size % 2)", "p_partkey % 3 > 0")
    )
    inner = row(f"{base} + 10 + p_size div 2", f"{base} + 10 + p_size - p_size div 4", "c", "concat('b', p_partkey)", "'V'", "true").where("p_size > 8")
    places = table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_orderkey % 25, '.cs') AS path", "cast(l_partkey * 7 % 900 + l_linenumber as int) AS line", "concat('x', l_orderkey, '_', l_linenumber, '_', l_suppkey, '_', l_partkey) AS member")
    return scopes.union(inner).drop("p_size"), places


@query(
    "partial_members",
    f"""WITH {SCOPES_SQL},
 a AS (SELECT id, CASE WHEN partial THEN min(id) OVER (PARTITION BY module, name, partial) ELSE id END AS same FROM scopes WHERE up IS NULL),
 b AS (SELECT s.id, CASE WHEN partial THEN min(s.id) OVER (PARTITION BY module, a.same, name, partial) ELSE s.id END AS same FROM scopes s JOIN a ON a.id = s.up),
 c AS (SELECT s.id, CASE WHEN partial THEN min(s.id) OVER (PARTITION BY module, b.same, name, partial) ELSE s.id END AS same FROM scopes s JOIN b ON b.id = s.up),
 same AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
 own AS (SELECT *, row_number() OVER () AS k FROM places),
 inner_ AS (SELECT p.member, first(s.id ORDER BY s.s_ DESC, s.e_, s.id DESC) FILTER (s.id IS NOT NULL) AS scope FROM own p LEFT JOIN scopes s ON s.path = p.path AND s.s_ <= p.line AND s.e_ >= p.line GROUP BY p.k, p.member)
 SELECT same.same AS owner, count(*) AS n, min(member) AS member FROM inner_ LEFT JOIN same ON same.id = scope GROUP BY 1""",
)
def partial_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by the innermost type around them, types that are split over files taken together."""
    scopes, places = _scopes(spark, sf_dir)
    found = checkpointed(N.innermost(scopes.select("path", "start", "end", "id"), places))
    same = N.merged_parts(scopes).withColumnRenamed("id", "scope")
    return found.join(same, "scope", "left").groupBy(F.col("same").alias("owner")).agg(F.count("*").alias("n"), F.min("member").alias("member"))


RULES = {
    "folder": "CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || (n_nationkey % 3) ELSE 'a' || (n_nationkey % 3) || '/b' || (n_nationkey % 5) END",
    "ord": "n_nationkey",
    "text": "'# rule' || chr(10) || CASE n_nationkey % 6 WHEN 0 THEN '*.log' WHEN 1 THEN '!*.log  ' WHEN 2 THEN 'c' || (n_nationkey % 7) || '/' WHEN 3 THEN '!f*[' || (n_nationkey % 10) || '-9].txt' WHEN 4 THEN '/b' || (n_nationkey % 5) || '/**/*.txt' ELSE '!/c' || (n_nationkey % 7) || '/*.md' END",
}
PATHS = {
    "path": "'a' || (o_orderkey % 3) || '/b' || (o_orderkey % 5) || '/c' || (o_orderkey % 7) || CASE WHEN o_orderkey % 11 = 0 THEN '/d' ELSE '' END || '/f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '' END",
}


@query(
    "nested_ignores",
    f"""WITH f AS ({given_sql('nation', **RULES, k='n_nationkey')}), p AS ({given_sql('orders', **PATHS)}),
 r AS (SELECT *, CASE k % 6 WHEN 0 THEN '(.*/)?[^/]*\\.log' WHEN 1 THEN '(.*/)?[^/]*\\.log' WHEN 2 THEN '(.*/)?c' || (k % 7) WHEN 3 THEN '(.*/)?f[^/]*[' || (k % 10) || '-9]\\.txt' WHEN 4 THEN 'b' || (k % 5) || '/(.*/)?[^/]*\\.txt' ELSE 'c' || (k % 7) || '/[^/]*\\.md' END AS rx, k % 6 IN (1, 3, 5) AS back FROM f),
 h AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS head FROM p),
 v AS (SELECT h.path, h.head, back FROM h JOIN r ON (folder = '' OR starts_with(head, folder || '/')) AND (k % 6 <> 2 OR head <> path) AND regexp_full_match(CASE WHEN folder = '' THEN head ELSE substr(head, length(folder) + 2) END, rx)
   QUALIFY row_number() OVER (PARTITION BY h.path, h.head ORDER BY length(folder) DESC, ord DESC) = 1)
 SELECT p.path, coalesce(bool_or(NOT back), false) AS ignored FROM p LEFT JOIN v ON v.path = p.path GROUP BY p.path""",
)
def nested_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths against ignore files of three levels, some of which take back what others ignore."""
    return N.ignored(given(spark, sf_dir, "orders", **PATHS), N.ignore_rules(given(spark, sf_dir, "nation", **RULES)))
