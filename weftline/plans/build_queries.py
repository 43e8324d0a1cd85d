"""Queries on building a graph from loose rows; faults are injected by the keys' remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build as B
from .kgview import edges, kg, links, nodes, part_file, table
from .registry import query

RAW_SQL = """, raw AS (
 SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE 'order_' || l_orderkey END AS src,
  CASE WHEN l_partkey % 89 = 0 THEN 'gone_' || l_partkey WHEN l_partkey % 83 = 0 THEN 'order_' || l_orderkey ELSE 'part_' || l_partkey END AS dst,
  CASE WHEN l_linenumber % 3 = 0 THEN 'references' WHEN l_linenumber % 3 = 1 THEN 'calls' ELSE 'imports_from' END AS relation,
  CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'MAYBE' END AS confidence,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN -1.0 ELSE l_quantity END AS weight, 'L' || l_linenumber AS source_location FROM lineitem)"""


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    order, part = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")), F.col("l_partkey").cast("string")
    by = F.col("l_linenumber") % 3
    return t.select(
        F.when(F.col("l_orderkey") % 97 != 0, order).alias("src"),
        F.when(F.col("l_partkey") % 89 == 0, F.concat(F.lit("gone_"), part)).when(F.col("l_partkey") % 83 == 0, order).otherwise(F.concat(F.lit("part_"), part)).alias("dst"),
        F.when(by == 0, "references").when(by == 1, "calls").otherwise("imports_from").alias("relation"),
        F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("MAYBE").alias("confidence"),
        F.when(F.col("l_linenumber") == 4, None).when(F.col("l_linenumber") == 5, -1.0).otherwise(F.col("l_quantity")).alias("weight"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("source_location"),
    )


@query(
    "collapse_simple_graph",
    kg(""", e AS (SELECT *, least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE NOT (src = dst AND relation = 'imports_from')),
 f AS (SELECT *, min(src) OVER (PARTITION BY u, v, relation) AS first_src FROM e),
 g AS (SELECT *, count(*) OVER (PARTITION BY u, v) AS n_edges, row_number() OVER (PARTITION BY u, v ORDER BY
   CASE WHEN relation IN ('references', 'uses', 'mentions') THEN 0 ELSE 1 END DESC, src DESC, dst DESC, relation DESC, weight DESC, coalesce(source_location, '') DESC, confidence DESC) AS k
   FROM f WHERE src = first_src)
 SELECT u, v, src, dst, relation, confidence, weight, n_edges FROM g WHERE k = 1"""),
)
def collapse_simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.collapse(links(spark, sf_dir))


@query(
    "dedupe_nodes_last",
    "SELECT 'n' || (p_partkey % 97) AS id, max_by(p_name, p_partkey) AS label, max(p_partkey) AS ord FROM part GROUP BY 1",
)
def dedupe_nodes_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), (F.col("p_partkey") % 97).cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("ord")
    )
    return B.last_by_id(t, F.col("ord"))


@query(
    "dedupe_edges_first",
    kg("""SELECT src, dst, relation, source_location, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY coalesce(source_location, ''), weight) AS k FROM edges) WHERE k = 1"""),
)
def dedupe_edges_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(F.coalesce("source_location", F.lit("")), F.col("weight"))
    return B.first_by_edge(edges(spark, sf_dir), order).select("src", "dst", "relation", "source_location", "weight")


@query(
    "normalize_edges_heal",
    "WITH x AS (SELECT 1)" + RAW_SQL + """ SELECT relation, count(*) AS n, sum(CASE WHEN weight IS NULL OR weight < 0 THEN 1.0 ELSE weight END) AS weight,
 sum(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.55 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END::DOUBLE) AS score FROM raw GROUP BY relation""",
)
def normalize_edges_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_edges(spark, sf_dir).withColumns({"weight": B.heal_number(F.col("weight")), "score": B.default_confidence(F.lit(None).cast("double"), F.col("confidence"))})
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("score").alias("score"))


@query(
    "file_type_normalize",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'markdown' WHEN 2 THEN NULL WHEN 3 THEN 'gadget' WHEN 4 THEN 'tool' ELSE 'concept' END AS raw FROM part)
 SELECT p_partkey, CASE raw WHEN 'code' THEN 'code' WHEN 'markdown' THEN 'document' WHEN 'tool' THEN 'code' ELSE 'concept' END AS file_type FROM t""",
)
def file_type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "code").when(k == 1, "markdown").when(k == 2, None).when(k == 3, "gadget").when(k == 4, "tool").otherwise("concept")
    return table(spark, sf_dir, "part").select("p_partkey", B.file_type(raw).alias("file_type"))


@query(
    "confidence_score_default",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN 0.55 ELSE 0.2 END END AS confidence_score FROM lineitem""",
)
def confidence_score_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    score = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.default_confidence(score, flag).alias("confidence_score"))


@query(
    "alias_fold",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'order_' || l_orderkey END, cast(l_orderkey AS VARCHAR)) AS src,
 CASE WHEN starts_with(replace(p, '\\', '/'), '/srv/app/') THEN substr(replace(p, '\\', '/'), 10) ELSE replace(p, '\\', '/') END AS path
 FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN '/srv/app/src\\m' || l_partkey ELSE 'lib\\m' || l_partkey END AS p FROM lineitem)""",
)
def alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")))
    part = F.col("l_partkey").cast("string")
    path = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("/srv/app/src\\m"), part)).otherwise(F.concat(F.lit("lib\\m"), part))
    return t.select("l_orderkey", "l_linenumber", B.fold(source, F.col("l_orderkey")).alias("src"), B.slashes(path, "/srv/app").alias("path"))


@query(
    "validate_errors",
    kg(RAW_SQL + """ SELECT kind, key, count(*) AS n FROM (
 SELECT 'edge_without_end' AS kind, concat_ws('>', src, dst) AS key FROM raw WHERE src IS NULL OR dst IS NULL
 UNION ALL SELECT 'bad_confidence', concat_ws('>', src, dst) FROM raw WHERE confidence NOT IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')
 UNION ALL SELECT 'dangling_src', concat_ws('>', src, dst) FROM raw WHERE src IS NOT NULL AND src NOT IN (SELECT id FROM nodes)
 UNION ALL SELECT 'dangling_dst', concat_ws('>', src, dst) FROM raw WHERE dst IS NOT NULL AND dst NOT IN (SELECT id FROM nodes)) GROUP BY ALL"""),
)
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.errors(nodes(spark, sf_dir), raw_edges(spark, sf_dir)).groupBy("kind", "key").agg(F.count("*").alias("n"))


@query(
    "diagnose_edges",
    kg(RAW_SQL + """, g AS (SELECT src, dst, count(*) AS n, count(DISTINCT relation) AS r, count(DISTINCT source_location) AS l FROM raw WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
 b AS (SELECT sum(n) AS n FROM g GROUP BY least(src, dst), greatest(src, dst))
 SELECT count(*) AS n_edges, count(*) FILTER (src IS NULL OR dst IS NULL) AS missing_end,
 count(*) FILTER (src IS NOT NULL AND dst IS NOT NULL AND (src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes))) AS dangling, count(*) FILTER (src = dst) AS self_loops,
 (SELECT cast(sum(n) - count(*) AS BIGINT) FROM g) AS duplicates_directed, (SELECT count(*) FROM g WHERE r > 1) AS relation_variants, (SELECT count(*) FROM g WHERE l > 1) AS location_variants,
 (SELECT cast(sum(n) - count(*) AS BIGINT) FROM b) AS duplicates_undirected FROM raw"""),
)
def diagnose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.diagnose(nodes(spark, sf_dir), raw_edges(spark, sf_dir))


@query(
    "duplicate_pair_examples",
    kg("""SELECT src, dst, count(*) AS n, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM edges GROUP BY src, dst HAVING count(*) > 1 ORDER BY n DESC, src, dst LIMIT 5"""),
)
def duplicate_pair_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = links(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
    return g.where("n > 1").orderBy(F.desc("n"), "src", "dst").limit(5)


@query(
    "prune_dangling",
    kg(RAW_SQL + " SELECT src, dst, relation, source_location FROM raw WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"),
)
def prune_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.prune_dangling(nodes(spark, sf_dir), raw_edges(spark, sf_dir)).select("src", "dst", "relation", "source_location")


@query(
    "mint_external_stubs",
    kg(RAW_SQL + """ SELECT DISTINCT dst AS id, dst AS label, 'concept' AS file_type, '' AS source_file, true AS external FROM raw
 WHERE relation = 'imports_from' AND dst IS NOT NULL AND dst NOT IN (SELECT id FROM nodes)"""),
)
def mint_external_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.external_stubs(nodes(spark, sf_dir), raw_edges(spark, sf_dir))


@query(
    "cross_language_guard",
    kg(""", r AS (SELECT src, dst, CASE WHEN relation = 'uses' AND source_location IN ('L1', 'L2') THEN 'references' WHEN relation = 'uses' THEN 'calls' ELSE relation END AS relation, confidence FROM edges),
 j AS (SELECT r.*, a.source_file AS fa, b.source_file AS fb,
  CASE WHEN ends_with(a.source_file, '.py') THEN 'py' WHEN ends_with(a.source_file, '.java') THEN 'jvm' END AS la, CASE WHEN ends_with(b.source_file, '.py') THEN 'py' WHEN ends_with(b.source_file, '.java') THEN 'jvm' END AS lb
  FROM r JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
 SELECT relation, confidence, count(*) AS n FROM j
 WHERE NOT (relation = 'calls' AND confidence = 'INFERRED' AND contains(fa, '.') AND contains(fb, '.') AND la IS DISTINCT FROM lb)
   AND NOT (relation IN ('imports', 'imports_from', 'references') AND coalesce(la <> lb, false)) GROUP BY ALL"""),
)
def cross_language_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = F.col("relation") == "uses"
    relation = F.when(uses & F.col("source_location").isin("L1", "L2"), "references").when(uses, "calls").otherwise(F.col("relation"))
    e = edges(spark, sf_dir).select("src", "dst", relation.alias("relation"), "confidence")
    return B.language_guard(nodes(spark, sf_dir), e).groupBy("relation", "confidence").agg(F.count("*").alias("n"))


@query("context_filter_edges", kg("SELECT context, relation, count(*) AS n FROM edges WHERE context IN ('call', 'import') GROUP BY ALL"))
def context_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import in_contexts

    e = edges(spark, sf_dir).where(in_contexts(["calls", "Imports"]))
    return e.groupBy("context", "relation").agg(F.count("*").alias("n"))


@query(
    "collision_survivor",
    """WITH n AS (SELECT 'b' || (p_partkey % 41) AS id, p_name AS label, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS type, CASE WHEN p_size % 4 = 0 THEN '' ELSE lower(p_brand) END AS source_file, p_partkey AS k FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_file = '', type IS NULL, k) AS rk FROM n)
 SELECT id, first(label ORDER BY rk) AS label, first(source_file ORDER BY rk) AS source_file, first(type ORDER BY rk) FILTER (type IS NOT NULL) AS type FROM r GROUP BY id""",
)
def collision_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.dedup import merge_by_rank

    t = table(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), (F.col("p_partkey") % 41).cast("string")).alias("id"),
        F.col("p_name").alias("label"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("type"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.lower("p_brand")).alias("source_file"),
        F.col("p_partkey").alias("k"),
    )
    rank = F.struct((F.col("source_file") == "").alias("a"), F.col("type").isNull().alias("b"), F.col("k"))
    return merge_by_rank(t, "id", rank, keep=["label", "source_file"], fill=["type"])


@query(
    "node_files",
    "SELECT 'catalog/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.py' AS source_file, count(*) AS n FROM part GROUP BY 1",
)
def node_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(part_file().alias("source_file")).agg(F.count("*").alias("n"))
