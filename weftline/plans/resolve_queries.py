"""Queries on resolution joins. Lineitems act as call sites, parts and suppliers as definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_id
from ..operators import dedup as D
from ..operators import resolve as R
from .kgview import edges, kg, nodes, part_file, table
from .registry import query

SLUG = "'catalog/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.py'"


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


@query(
    "endpoint_resolution",
    kg(r""", e AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'Order ' || l_orderkey WHEN l_linenumber % 3 = 1 THEN 'order_' || l_orderkey ELSE 'lost ' || l_orderkey END AS src, 'part-' || l_partkey AS dst FROM lineitem),
 x AS (SELECT DISTINCT src, dst FROM e)
 SELECT count(*) AS n, count(a.id) AS bound_src, count(b.id) AS bound_dst FROM x LEFT JOIN nodes a ON a.id = trim(regexp_replace(lower(src), '[^\p{L}\p{N}_]+', '_', 'g'), '_') LEFT JOIN nodes b ON b.id = trim(regexp_replace(lower(dst), '[^\p{L}\p{N}_]+', '_', 'g'), '_')"""),
)
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    src = F.when(k == 0, F.concat(F.lit("Order "), _s("l_orderkey"))).when(k == 1, F.concat(F.lit("order_"), _s("l_orderkey"))).otherwise(F.concat(F.lit("lost "), _s("l_orderkey")))
    e = table(spark, sf_dir, "lineitem").select(src.alias("src"), F.concat(F.lit("part-"), _s("l_partkey")).alias("dst")).distinct()
    return R.resolve_ends(e, nodes(spark, sf_dir).select("id"), normalize_id).agg(F.count("*").alias("n"), F.count("src").alias("bound_src"), F.count("dst").alias("bound_dst"))


@query(
    "call_resolution",
    f"""WITH d AS (SELECT 'part_' || p_partkey AS id, p_name || '/' || (p_partkey % 40) AS name, {SLUG} AS source_file FROM part),
 c AS (SELECT DISTINCT 'order_' || l_orderkey AS src, p_name || '/' || (l_partkey * 3 % 40) AS name, {SLUG} AS source_file FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 1),
 f AS (SELECT name, source_file, min(id) AS id, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT name, min(id) AS id, count(*) AS n FROM d GROUP BY ALL)
 SELECT DISTINCT src, CASE WHEN g.n = 1 THEN g.id WHEN f.n = 1 THEN f.id END AS dst, CASE WHEN f.n IS NOT NULL THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN f.n IS NOT NULL THEN 1.0 ELSE 0.85 END::DOUBLE AS score
 FROM c JOIN g USING (name) LEFT JOIN f ON f.name = c.name AND f.source_file = c.source_file WHERE CASE WHEN g.n = 1 THEN g.id WHEN f.n = 1 THEN f.id END IS NOT NULL""",
)
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", part_file().alias("source_file"))
    definitions = p.select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.concat("p_name", F.lit("/"), (F.col("p_partkey") % 40).cast("string")).alias("name"), "source_file")
    calls = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    calls = calls.select(
        F.concat(F.lit("order_"), _s("l_orderkey")).alias("src"), F.concat("p_name", F.lit("/"), (F.col("l_partkey") * 3 % 40).cast("string")).alias("callee"),
        "source_file", (F.col("l_linenumber") % 2 == 0).alias("is_member"),
    )
    return R.bind_calls(calls, definitions).distinct()


@query("alias_unique", "SELECT p_name || p_size AS key, 'part_' || min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1")
def alias_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.concat("p_name", _s("p_size")).alias("k"))
    return R.unique_by(p, F.col("k"))


GHOST = f"(SELECT 'part_' || p_partkey AS id, p_name AS label, {SLUG} AS source_file, CASE WHEN p_partkey % 3 = 0 THEN 'semantic' ELSE 'ast' END AS origin FROM part)"


@query(
    "ghost_merge",
    f"""WITH n AS {GHOST}, a AS (SELECT source_file, label, min(id) AS dest FROM n WHERE origin = 'ast' GROUP BY ALL HAVING count(*) = 1)
 SELECT n.id, a.dest AS "to" FROM n JOIN a USING (source_file, label) WHERE origin = 'semantic'""",
)
def ghost_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.col("p_name").alias("label"), part_file().alias("source_file"),
        F.when(F.col("p_partkey") % 3 == 0, "semantic").otherwise("ast").alias("origin"),
    )
    return R.ghost_mapping(n)


@query(
    "stub_rewire",
    f"""WITH n AS (SELECT 'part_' || p_partkey AS id, p_name || (p_partkey % 30) AS label, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE {SLUG} END AS source_file FROM part),
 d AS (SELECT label, min(id) AS dest FROM n WHERE source_file <> '' GROUP BY label HAVING count(*) = 1) SELECT n.id, d.dest AS "to" FROM n JOIN d USING (label) WHERE source_file = ''""",
)
def stub_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.concat("p_name", (F.col("p_partkey") % 30).cast("string")).alias("label"),
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise(part_file()).alias("source_file"),
    )
    return R.stub_mapping(n, F.col("label"))


@query(
    "same_type_links",
    """WITH n AS (SELECT 'part_' || p_partkey AS id, p_partkey % 3 AS repo, p_brand AS namespace, p_name AS label FROM part)
 SELECT a.id AS src, b.id AS dst, 'same_type_as' AS relation, 0.9::DOUBLE AS score FROM n a JOIN n b USING (namespace, label) WHERE a.id < b.id AND a.repo <> b.repo""",
)
def same_type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return R.same_types(p.select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), (F.col("p_partkey") % 3).alias("repo"), F.col("p_brand").alias("namespace"), F.col("p_name").alias("label")))


@query(
    "cross_repo_calls",
    """WITH c AS (SELECT 's' || s_suppkey AS id, s_suppkey % 3 AS repo, 'T' || (s_suppkey % 60) AS name FROM supplier), one AS (SELECT name FROM c GROUP BY name HAVING count(*) = 1),
 m AS (SELECT 's' || l_suppkey AS class_id, 'm' || (l_partkey % 2000) AS name, min('p' || l_partkey) AS dst FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY ALL HAVING count(*) = 1),
 k AS (SELECT DISTINCT 'order_' || o_orderkey AS src, o_orderkey % 3 AS repo, 'T' || (o_custkey % 60) AS receiver, 'm' || (o_orderkey % 2000) AS callee FROM orders)
 SELECT DISTINCT k.src, m.dst, 'calls' AS relation, 0.8::DOUBLE AS score FROM k JOIN c ON c.name = k.receiver AND c.name IN (SELECT name FROM one) AND c.repo <> k.repo JOIN m ON m.class_id = c.id AND m.name = k.callee""",
)
def cross_repo_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    classes = s.select(F.concat(F.lit("s"), _s("s_suppkey")).alias("id"), (F.col("s_suppkey") % 3).alias("repo"), F.concat(F.lit("T"), (F.col("s_suppkey") % 60).cast("string")).alias("name"))
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    members = item.select(F.concat(F.lit("s"), _s("l_suppkey")).alias("class_id"), F.concat(F.lit("p"), _s("l_partkey")).alias("id"), F.concat(F.lit("m"), (F.col("l_partkey") % 2000).cast("string")).alias("name"))
    o = table(spark, sf_dir, "orders")
    parked = o.select(
        F.concat(F.lit("order_"), _s("o_orderkey")).alias("src"), (F.col("o_orderkey") % 3).alias("repo"), F.concat(F.lit("T"), (F.col("o_custkey") % 60).cast("string")).alias("receiver"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 2000).cast("string")).alias("callee"),
    )
    return R.cross_repo_calls(parked, classes, members)


@query(
    "external_unify",
    kg(""", x AS (SELECT DISTINCT 'ext_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id, 'Customer#' || lpad((l_partkey)::VARCHAR, 9, '0') AS label FROM lineitem)
 SELECT x.id, coalesce(min(n.id), x.id) AS bound FROM x LEFT JOIN nodes n USING (label) GROUP BY x.id, x.label"""),
)
def external_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    ext = item.select(F.concat(F.lit("ext_"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")).alias("id"), F.concat(F.lit("Customer#"), F.lpad(_s("l_partkey"), 9, "0")).alias("label")).distinct()
    known = nodes(spark, sf_dir).groupBy("label").agg(F.min("id").alias("known"))
    return ext.join(known, "label", "left").select("id", F.coalesce("known", "id").alias("bound"))


@query(
    "pr_impact",
    kg(""", c AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'app/' || f WHEN 1 THEN string_split(f, '/')[-1] ELSE f END AS path FROM (SELECT o_orderkey, 'sales/y' || year(o_orderdate) || '.py' AS f FROM orders)),
 f AS (SELECT DISTINCT source_file FROM nodes WHERE source_file <> '')
 SELECT path, source_file FROM c JOIN f ON path = source_file OR ends_with(path, '/' || source_file) OR ends_with(source_file, '/' || path)"""),
)
def pr_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f = F.concat(F.lit("sales/y"), F.year("o_orderdate").cast("string"), F.lit(".py"))
    k = F.col("o_orderkey") % 3
    changed = o.select(F.when(k == 0, F.concat(F.lit("app/"), f)).when(k == 1, F.substring_index(f, "/", -1)).otherwise(f).alias("path"))
    return R.path_impact(changed, nodes(spark, sf_dir).where("source_file <> ''"))


@query(
    "interface_dispatch",
    """WITH i AS (SELECT DISTINCT 'T' || CASE WHEN l_partkey % 1000 % 3 = 0 THEN l_suppkey % 97 ELSE l_partkey % 1000 % 97 END AS type, 'I' || (l_partkey % 1000) AS interface FROM lineitem),
 one AS (SELECT interface, min(type) AS type FROM i GROUP BY interface HAVING count(DISTINCT type) = 1),
 m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'I' || (p_partkey % 1000) ELSE 'T' || (p_partkey % 97) END AS owner, p_name AS name, 'p' || p_partkey AS id FROM part),
 u AS (SELECT owner, name, min(id) AS id FROM m GROUP BY ALL HAVING count(*) = 1)
 SELECT a.id AS src, b.id AS dst, 0.9::DOUBLE AS score FROM one JOIN u a ON a.owner = one.interface JOIN u b ON b.owner = one.type AND b.name = a.name""",
)
def interface_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 1000
    kind = F.when(k % 3 == 0, F.col("l_suppkey") % 97).otherwise(k % 97)
    implements = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), kind.cast("string")).alias("type"), F.concat(F.lit("I"), k.cast("string")).alias("interface"))
    owner = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("I"), (F.col("p_partkey") % 1000).cast("string"))).otherwise(F.concat(F.lit("T"), (F.col("p_partkey") % 97).cast("string")))
    methods = table(spark, sf_dir, "part").select(owner.alias("owner"), F.col("p_name").alias("name"), F.concat(F.lit("p"), _s("p_partkey")).alias("id"))
    return R.interface_dispatch(implements, methods)


@query(
    "colliding_ids",
    f"""WITH n AS (SELECT 'k' || (p_partkey % 700) AS id, {SLUG} AS source_file, p_partkey FROM part), c AS (SELECT id, count(DISTINCT source_file) AS n FROM n GROUP BY id)
 SELECT p_partkey, CASE WHEN c.n > 1 THEN regexp_replace(regexp_replace(source_file, '\\.[^./]+$', ''), '[^A-Za-z0-9]+', '_', 'g') || '_' || id ELSE id END AS new_id FROM n JOIN c USING (id)""",
)
def colliding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("k"), (F.col("p_partkey") % 700).cast("string")).alias("id"), part_file().alias("source_file"))
    return R.disambiguated(n).select("p_partkey", "new_id")


@query(
    "evidence_citations",
    kg(""", c AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'part_' || p_partkey ELSE p_name END AS cited FROM part), u AS (SELECT label, min(id) AS id FROM nodes GROUP BY label HAVING count(*) = 1)
 SELECT cited, coalesce(n.id, u.id) AS id FROM c LEFT JOIN nodes n ON n.id = cited LEFT JOIN u ON u.label = cited"""),
)
def evidence_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("part_"), _s("p_partkey"))).otherwise(F.col("p_name")).alias("cited")).distinct()
    n = nodes(spark, sf_dir)
    by_label = R.unique_by(n, F.col("label"), "cited").withColumnRenamed("id", "_by")
    j = c.join(n.select(F.col("id").alias("cited"), F.col("id").alias("_id")), "cited", "left").join(by_label, "cited", "left")
    return j.select("cited", F.coalesce("_id", "_by").alias("id"))


@query(
    "exact_label_merge",
    "SELECT 'part_' || p_partkey AS id, 'part_' || min(p_partkey) OVER (PARTITION BY lower(p_name), p_brand) AS survivor FROM part",
)
def exact_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("k"), "p_brand")
    first = p.groupBy("k", "p_brand").agg(F.min("p_partkey").alias("first"))
    return p.join(first, ["k", "p_brand"]).select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.concat(F.lit("part_"), _s("first")).alias("survivor"))


@query(
    "attribute_fill",
    "SELECT p_name AS label, arg_min(p_partkey, p_partkey) AS first, arg_min(p_type, p_partkey) FILTER (p_size % 5 <> 0) AS type FROM part GROUP BY p_name",
)
def attribute_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_partkey").alias("first"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("type"))
    return D.merge_by_rank(p, "label", F.col("first"), keep=["first"], fill=["type"])


@query("fuzzy_label_merge", None)
def fuzzy_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that banded MinHash brings together and similarity and guards let merge."""
    label = F.concat("p_name", F.lit(" assembly for the "), F.lower("p_type"), F.lit(" range"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), label.alias("label"))
    return D.fuzzy_components(p)


@query(
    "dedup_components",
    """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS u, 'c' || (c_custkey // 3 * 2) AS v FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey // 10 * 10 + p_size % 10) FROM part WHERE p_partkey % 3 > 0
  UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 6 > 0),
 w AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e UNION SELECT u, u FROM e UNION SELECT v, v FROM e),
 r(id, x) AS (SELECT a, b FROM w UNION SELECT r.id, w.b FROM r JOIN w ON w.a = r.x)
 SELECT id, min(x) AS component FROM r GROUP BY id""",
)
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of what merges pairwise, by the smallest id: chains, stars and loops."""
    pair = lambda t, where, u, v: table(spark, sf_dir, t).where(where).selectExpr(f"concat({u}) AS u", f"concat({v}) AS v")
    pairs = pair("customer", "c_custkey % 4 > 0", "'c', c_custkey", "'c', c_custkey div 3 * 2").union(pair("part", "p_partkey % 3 > 0", "'p', p_partkey", "'p', p_partkey div 10 * 10 + p_size % 10"))
    return D.components(pairs.union(pair("supplier", "s_suppkey % 6 > 0", "'s', s_suppkey", "'s', s_suppkey + 1")))


@query("known_pairs_anti", kg(" SELECT DISTINCT src, dst FROM edges WHERE relation = 'calls' AND (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE relation = 'calls' AND confidence = 'EXTRACTED')"))
def known_pairs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("relation = 'calls'")
    return e.select("src", "dst").distinct().join(e.where("confidence = 'EXTRACTED'").select("src", "dst"), ["src", "dst"], "left_anti")
