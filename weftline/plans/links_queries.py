"""Queries on inheritance, evidence, manifests and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inherit as I
from ..operators import merging as M
from ..operators.build import default_confidence
from .kgview import edges, kg, nodes, part_file, table
from .registry import query

SLUG = "'catalog/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.py'"


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


@query(
    "inherited_methods",
    """WITH RECURSIVE up AS (SELECT 'c' || c_custkey AS child, 'c' || (c_custkey // 2) AS parent FROM customer WHERE c_custkey > 0),
 m AS (SELECT 'c' || (p_partkey % 400) AS owner, p_name AS name, 'p' || p_partkey AS id FROM part), own AS (SELECT owner, name, min(id) AS dst, count(*) AS n FROM m GROUP BY ALL),
 w AS (SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS tgt, p_name AS name, 0 AS hop FROM orders JOIN part ON p_partkey = o_orderkey % 200
   UNION ALL SELECT w.src, up.parent, w.name, hop + 1 FROM w JOIN up ON up.child = w.tgt LEFT JOIN own ON own.owner = w.tgt AND own.name = w.name WHERE own.n IS NULL AND hop < 8)
 SELECT src, dst, hop AS hops FROM w JOIN own ON own.owner = w.tgt AND own.name = w.name WHERE own.n = 1""",
)
def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    inherits = c.where("c_custkey > 0").select(name(F.col("c_custkey")).alias("child"), name(F.floor(F.col("c_custkey") / 2)).alias("parent"))
    methods = p.select(name(F.col("p_partkey") % 400).alias("owner"), F.col("p_name").alias("name"), F.concat(F.lit("p"), _s("p_partkey")).alias("id"))
    calls = o.join(p.select("p_partkey", "p_name"), F.col("o_orderkey") % 200 == F.col("p_partkey"))
    return I.inherited_targets(calls.select(F.concat(F.lit("o"), _s("o_orderkey")).alias("src"), name(F.col("o_custkey")).alias("type"), F.col("p_name").alias("name")), inherits, methods)


@query(
    "header_impl_merge",
    """WITH n AS (SELECT 'k' || (p_partkey % 300) AS id, 'src/m' || (p_partkey % 300) || CASE p_size % 3 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' ELSE '.hpp' END AS source_file FROM part)
 SELECT id, regexp_replace(source_file, '\\.[^./]+$', '') AS stem, first(source_file ORDER BY NOT regexp_matches(source_file, '\\.(h|hpp)$'), source_file) AS source_file, count(*) AS n FROM n GROUP BY 1, 2""",
)
def header_impl_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 300).cast("string")
    ext = F.when(F.col("p_size") % 3 == 0, ".h").when(F.col("p_size") % 3 == 1, ".cpp").otherwise(".hpp")
    return I.header_first(table(spark, sf_dir, "part").select(F.concat(F.lit("k"), k).alias("id"), F.concat(F.lit("src/m"), k, ext).alias("source_file")))


@query(
    "evidence_binding",
    f"""WITH n AS (SELECT 'part_' || p_partkey AS id, p_name AS label, {SLUG} AS source_file, p_size FROM part), t AS (SELECT DISTINCT source_file, unnest(regexp_extract_all(lower(label), '[a-z0-9_]{{3,}}')) AS word FROM n WHERE p_size % 10 = 3),
 w AS (SELECT id, source_file, unnest(regexp_extract_all(lower(label), '[a-z0-9_]{{3,}}')) AS word FROM n)
 SELECT n.id, coalesce(bool_or(t.word IS NOT NULL), false) AS verified FROM n JOIN w USING (id) LEFT JOIN t ON t.source_file = w.source_file AND t.word = w.word GROUP BY n.id""",
)
def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), _s("p_partkey")).alias("id"), F.col("p_name").alias("label"), part_file().alias("source_file"), "p_size")
    texts = n.where("p_size % 10 = 3").select("source_file", F.col("label").alias("text"))
    return I.bound_to_evidence(n.drop("p_size"), texts).select("id", "verified")


@query(
    "folded_rationale",
    r"""SELECT 'c' || conv_id AS id, md5(string_agg(text, chr(10) ORDER BY turn)) AS sig, count(*) AS n FROM conversations WHERE len(regexp_split_to_array(trim(text), '\s+')) >= 12 GROUP BY 1""",
)
def folded_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    own = F.concat_ws("_", F.lit("t"), "conv_id", "turn")
    fragments = c.select(own.alias("id"), F.col("text").alias("label"), F.col("turn").alias("ord"))
    links = c.select(own.alias("src"), F.concat(F.lit("c"), _s("conv_id")).alias("dst"))
    return I.folded_rationale(fragments, links).select("id", F.md5("rationale").alias("sig"), "n")


@query(
    "manifest_merge",
    """WITH a AS (SELECT 'd' || doc_id AS path, md5(text) AS hash, 1 AS run FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT 'd' || doc_id AS path, md5(text || 'y') AS hash, 2 AS run FROM documents WHERE doc_id % 4 = 0)
 SELECT coalesce(b.path, a.path) AS path, coalesce(b.hash, a.hash) AS hash, coalesce(b.run, a.run) AS run FROM a FULL JOIN b ON a.path = b.path""",
)
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), _s("doc_id")).alias("path")
    old = d.where("doc_id % 3 <> 0").select(path, F.md5("text").alias("hash"), F.lit(1).alias("run"))
    new = d.where("doc_id % 4 = 0").select(path, F.md5(F.concat("text", F.lit("y"))).alias("hash"), F.lit(2).alias("run"))
    return M.first_wins(old.unionByName(new), "path", -F.col("run"))


@query("cache_prune", "SELECT count(*) AS n FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    live = d.where("doc_id % 2 = 0").select("hash").distinct()
    return d.join(live, "hash", "left_semi").agg(F.count("*").alias("n"))


@query("prompt_fingerprints", "SELECT item_id, substr(sha256(text), 1, 12) AS fp FROM benchmark")
def prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 12).alias("fp"))


@query("interpreters", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python3' WHEN 1 THEN 'bash' WHEN 2 THEN 'node' ELSE '' END AS interpreter FROM documents")
def interpreters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "#!/usr/bin/env python3\n").when(k == 1, "#! /bin/bash -e\n").when(k == 2, "#!/usr/bin/env -S node --x\n").otherwise("")
    text = F.concat(head, "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(text, r"\A#!\s*(?:\S*/env(?:\s+-S)?\s+)?(?:\S*/)?([^\s/]+)", 1).alias("interpreter"))


@query(
    "manifest_dependencies",
    "SELECT p_partkey, 'dep_' || unnest([p_size, p_size + 1]) AS dep FROM part",
)
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    toml = F.concat(F.lit('[project]\nname = "x"\ndependencies = ["dep_'), _s("p_size"), F.lit('>=1.0", "dep_'), (F.col("p_size") + 1).cast("string"), F.lit('"]\n'))
    listed = F.regexp_extract(toml, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.regexp_extract_all(listed, F.lit(r'"([A-Za-z0-9_.-]+)'), F.lit(1))).alias("dep"))


@query(
    "diagram_edges",
    kg(""" SELECT src, dst, relation, round(max(CASE confidence WHEN 'EXTRACTED' THEN 3.0 WHEN 'INFERRED' THEN 0.55 ELSE 0.2 END::DOUBLE + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6 ELSE 0 END::DOUBLE), 6) AS score
 FROM edges GROUP BY ALL ORDER BY score DESC, src, dst LIMIT 60"""),
)
def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = default_confidence(F.lit(None).cast("double"), F.col("confidence")) + F.when(F.col("confidence") == "EXTRACTED", 2.0).otherwise(0.0)
    kind = F.when(F.col("relation").isin("calls", "uses", "method"), 1.0).when(F.col("relation").isin("imports", "imports_from"), 0.6).otherwise(0.0)
    g = edges(spark, sf_dir).groupBy("src", "dst", "relation").agg(F.round(F.max(sure + kind), 6).alias("score"))
    return g.orderBy(F.desc("score"), "src", "dst").limit(60)


@query(
    "section_ranking",
    kg(""", n AS (SELECT source_file AS section, count(*) AS n FROM nodes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, section) AS k FROM n)
 SELECT CASE WHEN k <= 15 THEN section ELSE '(other)' END AS section, cast(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""),
)
def section_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy(F.col("source_file").alias("section")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "section").limit(15).select("section", F.lit(True).alias("top"))
    named = F.when(F.col("top"), F.col("section")).otherwise("(other)")
    return n.join(F.broadcast(top), "section", "left").groupBy(named.alias("section")).agg(F.sum("n").alias("n"))  # fifteen rows


@query(
    "canonical_order",
    kg(""" SELECT json, row_number() OVER (ORDER BY json) AS k FROM (SELECT '{"id":"' || id || '","label":"' || label || '"}' AS json FROM nodes)"""),
)
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.numbered(nodes(spark, sf_dir).select(F.to_json(F.struct("id", "label")).alias("json")), "json", "k")


@query(
    "hyperedge_union",
    "WITH h AS (SELECT 'h' || (l_orderkey % 800) AS id FROM lineitem GROUP BY 1), k AS (SELECT DISTINCT 'h' || (o_custkey % 1000) AS id FROM orders) SELECT id, 1 AS run FROM k UNION ALL SELECT id, 2 FROM h WHERE id NOT IN (SELECT id FROM k)",
)
def hyperedge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), (F.col("l_orderkey") % 800).cast("string")).alias("id")).distinct()
    known = table(spark, sf_dir, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 1000).cast("string")).alias("id")).distinct()
    return M.unseen(new.withColumn("run", F.lit(2)), known.withColumn("run", F.lit(1)), "id")


@query(
    "global_repo_replace",
    kg(""" SELECT id, repo, 1 AS run FROM (SELECT id, length(id) % 4 AS repo FROM nodes) WHERE repo <> 2 UNION ALL SELECT id, 2, 2 FROM nodes WHERE length(id) % 4 = 2 AND file_type = 'code' AND NOT ends_with(id, '7')"""),
)
def global_repo_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).withColumn("repo", F.length("id") % 4)
    new = n.where("repo = 2 and file_type = 'code' and not endswith(id, '7')").select("id", "repo", F.lit(2).alias("run"))
    kept = n.join(new.select("repo").distinct(), "repo", "left_anti").select("id", "repo", F.lit(1).alias("run"))
    return kept.unionByName(new)
