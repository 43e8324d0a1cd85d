"""Queries on sources, reports and what keeps a graph up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upkeep as U
from ..sources import scan as S
from .display_queries import given, given_sql
from .graph_queries import degreed
from .kgview import kg, nodes, table
from .registry import query

FILES = {
    "path": """CASE o_orderkey % 11 WHEN 0 THEN 'src/a' || o_orderkey || '.py' WHEN 1 THEN 'web/node_modules/x' || o_orderkey || '.js' WHEN 2 THEN 'docs/n' || o_orderkey || '.md' WHEN 3 THEN 'keys/.ssh/k' || o_orderkey
 WHEN 4 THEN 'conf/secret_' || o_orderkey || '.txt' WHEN 5 THEN 'src/token_' || o_orderkey || '.go' WHEN 6 THEN 'big/v' || o_orderkey || '.mp4' WHEN 7 THEN 'gen/g' || o_orderkey || '.ts' WHEN 8 THEN 'x' || o_orderkey || '.zzz' WHEN 9 THEN 'p/' || o_orderkey || '.PDF' ELSE 'img/' || o_orderkey || '.jpeg' END""",
    "size": "o_custkey * 1000",
}
STATE_SQL = """CASE WHEN contains(path, 'node_modules/') THEN 'noise' WHEN starts_with(path, 'gen/') THEN 'ignored' WHEN contains(path, '.ssh/') OR contains(path, 'secret_') THEN 'sensitive' WHEN size > 100000 THEN 'too large' WHEN ends_with(path, '.zzz') THEN 'unclassified' ELSE 'kept' END"""
CATEGORY_SQL = "CASE WHEN regexp_matches(path, '\\.(py|js|ts|go)$') THEN 'code' WHEN regexp_matches(path, '\\.(md|txt)$') THEN 'document' WHEN ends_with(lower(path), '.pdf') THEN 'paper' WHEN ends_with(path, '.jpeg') THEN 'image' WHEN ends_with(path, '.mp4') THEN 'media' END"


@query(
    "directory_scan",
    f"WITH f AS ({given_sql('orders', **FILES)}), s AS (SELECT *, {STATE_SQL} AS state, {CATEGORY_SQL} AS c FROM f) SELECT CASE WHEN state = 'kept' THEN c ELSE '(' || state || ')' END AS category, count(*) AS n, cast(sum(size) AS BIGINT) AS bytes FROM s GROUP BY 1",
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(S.scanned(given(spark, sf_dir, "orders", **FILES), ["gen/"], 100_000))


@query("path_collection", f"SELECT path FROM ({given_sql('orders', **FILES)}) WHERE regexp_matches(path, '\\.(py|js|ts|go)$') AND NOT contains(path, 'node_modules/')")
def path_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extractable(given(spark, sf_dir, "orders", **FILES), ["py", "js", "ts", "go"]).select("path")


CRATES = {
    "crate": "'c' || p_partkey",
    "text": "'[package]' || char(10) || 'name = \"c' || p_partkey || '\"' || char(10) || '[dependencies]' || char(10) || 'c' || (p_partkey * 3 % 260) || ' = \"1.0\"' || char(10) || 'c' || (p_size) || '.workspace = true' || char(10) || 'serde = \"1\"' || char(10) || '[dev-dependencies]' || char(10) || 'c9 = \"1\"'",
}


@query("crate_dependencies", "SELECT DISTINCT 'c' || p_partkey AS src, d AS dst FROM (SELECT p_partkey, unnest(['c' || (p_partkey * 3 % 260), 'c' || p_size]) AS d FROM part) WHERE d IN (SELECT 'c' || p_partkey FROM part) AND d <> 'c' || p_partkey")
def crate_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crate_edges(given(spark, sf_dir, "part", **CRATES))


SYMBOL = {
    "json": """'{"document": "d' || (p_partkey % 50) || '.py", "symbols": [{"symbol": "s' || (p_partkey % 90) || '", "relationships": [{"symbol": "s' || (p_partkey * 7 % 120) || '", "is_implementation": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
 || '}, {"symbol": "s' || (p_size % 90) || '", "is_type_definition": ' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END || '}]}]}'""",
}


@query(
    "scip_edges",
    """WITH o AS (SELECT DISTINCT 'd' || (p_partkey % 50) || '.py' AS doc, 's' || (p_partkey % 90) AS s FROM part), one AS (SELECT s, min(doc) AS only FROM o GROUP BY s HAVING count(*) = 1),
 r AS (SELECT 'd' || (p_partkey % 50) || '.py' AS doc, 's' || (p_partkey % 90) AS src, 's' || (p_partkey * 7 % 120) AS t, CASE WHEN p_size % 2 = 0 THEN 'scip_impl' ELSE 'scip_ref' END AS relation FROM part
  UNION ALL SELECT 'd' || (p_partkey % 50) || '.py', 's' || (p_partkey % 90), 's' || (p_size % 90), CASE WHEN p_size % 3 = 0 THEN 'scip_typed' ELSE 'scip_ref' END FROM part)
 SELECT DISTINCT r.doc || '#' || src AS src, coalesce(o.doc, one.only) || '#' || t AS dst, relation FROM r LEFT JOIN o ON o.doc = r.doc AND o.s = t LEFT JOIN one ON one.s = t WHERE coalesce(o.doc, one.only) IS NOT NULL""",
)
def scip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scip_edges(given(spark, sf_dir, "part", **SYMBOL))


SEEN = {
    "path": "'x' || p_partkey || '.py'",
    "text": "'import os' || char(10) || CASE WHEN p_size % 2 = 0 THEN '    seen_pairs: set[tuple[str, str' || CASE WHEN p_size % 3 = 0 THEN ', int' ELSE '' END || ']] = set()' ELSE 'x = 1' END || char(10) || 'seen_ids = set(old)' || char(10) || '# seen_no = set('",
}


@query(
    "suppression_sites",
    "SELECT 'x' || p_partkey || '.py' AS path, 2 AS line, 'seen_pairs' AS name, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS arity FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'x' || p_partkey || '.py', 3, 'seen_ids', 1 FROM part",
)
def suppression_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppression_sites(given(spark, sf_dir, "part", **SEEN))


TWICE = {"id": "'b' || (p_partkey % 60) || '_load'", "label": "CASE p_partkey % 5 WHEN 0 THEN 'Load it' WHEN 1 THEN 'load  IT' ELSE p_name END", "source_file": "'b' || (p_partkey % 3 * 20 + p_partkey % 20) || '.py'"}


@query(
    "collision_report",
    f"""WITH i AS ({given_sql('part', **TWICE)}), n AS (SELECT *, starts_with(id, source_file[:-4]) AS d, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS l FROM i),
 f AS (SELECT id, count(*) AS n, min((NOT d, source_file, label)) AS m FROM n GROUP BY id HAVING count(*) > 1),
 j AS (SELECT n.id, f.n, CASE WHEN source_file = m[2] AND l = trim(regexp_replace(lower(m[3]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) THEN 'same' WHEN source_file = m[2] THEN 'relabelled' WHEN NOT m[1] AND NOT d THEN 'referenced' ELSE 'lost' END AS x FROM n JOIN f USING (id))
 SELECT id, any_value(n) AS n, count(*) FILTER (x = 'relabelled') AS relabelled, count(*) FILTER (x = 'referenced') AS referenced, count(*) FILTER (x = 'lost') AS lost FROM j GROUP BY id""",
)
def collision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.collisions(given(spark, sf_dir, "part", **TWICE))


@query("partial_marks", "SELECT o_orderkey AS k, o_custkey % 40 AS chunk, o_custkey % 40 IN (SELECT c_custkey % 40 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey < 100) AS partial FROM orders")
def partial_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = given(spark, sf_dir, "customer", chunk="c_custkey % 40", finish="CASE WHEN c_custkey % 7 = 0 AND c_custkey < 100 THEN 'length' ELSE 'stop' END")
    return U.marked_partial(given(spark, sf_dir, "orders", k="o_orderkey", chunk="o_custkey % 40"), chunks).select("k", "chunk", "partial")


CHANGED = {"path": "CASE o_orderkey % 4 WHEN 0 THEN '/r/a/b/f' || o_custkey || '.py' WHEN 1 THEN '/r/a/f' || o_custkey || '.py' WHEN 2 THEN 'f' || o_custkey || '.py' ELSE '/q/f' || o_custkey || '.py' END"}


@query(
    "stored_paths",
    f"""WITH s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'f' || c_custkey || '.py' ELSE 'b/f' || c_custkey || '.py' END AS f FROM customer), c AS (SELECT DISTINCT path FROM ({given_sql('orders', **CHANGED)})),
 t AS (SELECT path, 0 AS k, path[8:] AS f FROM c WHERE starts_with(path, '/r/a/b/') UNION ALL SELECT path, 1, path[6:] FROM c WHERE starts_with(path, '/r/a/') UNION ALL SELECT path, 2, path FROM c)
 SELECT path, arg_min(f, k) AS source_file FROM t JOIN s USING (f) GROUP BY path""",
)
def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = given(spark, sf_dir, "customer", source_file="CASE WHEN c_custkey % 2 = 0 THEN 'f' || c_custkey || '.py' ELSE 'b/f' || c_custkey || '.py' END")
    return U.resolved_paths(given(spark, sf_dir, "orders", **CHANGED).distinct(), stored, ["/r/a", "/r/a/b"])


TIERS = {"id": "o_orderkey", "source_file": "'f' || (o_custkey % 60)", "origin": "CASE o_orderkey % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'llm' ELSE 'doc' END"}


@query(
    "reconciled_rows",
    f"""WITH o AS ({given_sql('orders', **TIERS)}) SELECT * FROM o WHERE source_file NOT IN ('f1', 'f2', 'f3') AND NOT (source_file IN ('f4', 'f5', 'f6') AND origin = 'ast')
 UNION ALL SELECT -p_partkey, 'f' || (4 + p_partkey % 3), 'ast' FROM part""",
)
def reconciled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = given(spark, sf_dir, "part", id="-p_partkey", source_file="'f' || (4 + p_partkey % 3)", origin="'ast'")
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "source_file string")
    return U.reconciled(given(spark, sf_dir, "orders", **TIERS), new, named("f4", "f5", "f6"), named("f1", "f2", "f3"))


@query("pending_updates", "SELECT 'r' || (user_id % 9) AS repo, count(*) AS changes FROM events e WHERE event_type <> 'signup' AND ts > coalesce((SELECT max(ts) FROM events b WHERE event_type = 'signup' AND b.user_id % 9 = e.user_id % 9 AND b.user_id % 9 <> 4), TIMESTAMP '1900-01-01') GROUP BY 1")
def pending_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 9).cast("string")).alias("repo"), "ts", "event_type")
    return U.pending(e.where("event_type <> 'signup'"), e.where("event_type = 'signup' and repo <> 'r4'"))


@query(
    "label_batches",
    kg(""" SELECT community, community // 2 AS batch, string_agg(label, ', ' ORDER BY k) AS members FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM degree) WHERE k <= 8 GROUP BY community"""),
)
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.label_batches(degreed(spark, sf_dir), 8, 2)


@query("community_members", kg(" SELECT community, count(*) AS n, min(id) AS first, max(id) AS last FROM nodes GROUP BY community"))
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


BLOCKS = {"id": "'m' || o_orderkey", "folder": "'env/e' || (o_custkey % 5)", "source": "CASE o_orderkey % 3 WHEN 0 THEN './net' || (o_custkey % 4) WHEN 1 THEN '../../mods/v' || (o_custkey % 30) ELSE '../../../out' END"}
DECLARED = {"id": "'var.' || p_partkey", "folder": "CASE WHEN p_size % 2 = 0 THEN 'mods/v' || (p_partkey % 40) ELSE 'env/e' || (p_partkey % 5) || '/net' || (p_partkey % 4) END"}


@query(
    "terraform_modules",
    f"""WITH m AS (SELECT id, CASE WHEN starts_with(source, './') THEN folder || source[2:] WHEN starts_with(source, '../../../') THEN NULL ELSE source[7:] END AS folder FROM ({given_sql('orders', **BLOCKS)}))
 SELECT DISTINCT m.id AS src, d.id AS dst FROM m JOIN ({given_sql('part', **DECLARED)}) d USING (folder)""",
)
def terraform_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.module_members(given(spark, sf_dir, "orders", **BLOCKS), given(spark, sf_dir, "part", **DECLARED))


VIEWS = {"id": "'v' || c_custkey", "name": "'N' || (c_custkey % 200) || CASE c_custkey % 3 WHEN 0 THEN 'View' WHEN 1 THEN 'Page' ELSE '' END"}
MODELS = {"id": "'k' || (p_partkey % 150)", "name": "'N' || (p_partkey % 150) || CASE p_partkey % 4 WHEN 0 THEN 'ViewModel' WHEN 1 THEN 'Model' WHEN 2 THEN 'ViewModel' ELSE 'Thing' END"}


@query(
    "view_models",
    f"""WITH v AS (SELECT id, unnest([regexp_replace(name, '(View|Page|Window)$', '') || 'ViewModel', name || 'Model']) AS name FROM ({given_sql('customer', **VIEWS)})),
 c AS (SELECT name, min(id) AS id FROM ({given_sql('part', **MODELS)}) GROUP BY name HAVING count(DISTINCT id) = 1) SELECT DISTINCT v.id AS src, c.id AS dst FROM v JOIN c USING (name)""",
)
def view_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.view_models(given(spark, sf_dir, "customer", **VIEWS), given(spark, sf_dir, "part", **MODELS))


@query(
    "learning_overlay",
    "SELECT node, '{\"bucket\":\"' || bucket || '\",\"pos\":' || pos || ',\"neg\":' || neg || '}' AS json FROM (" + "{lessons}" + ")",
)
def learning_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feedback_queries import lessons_buckets

    return lessons_buckets(spark, sf_dir).select("node", F.to_json(F.struct("bucket", "pos", "neg")).alias("json"))


def _with_lessons() -> None:
    from . import feedback_queries  # noqa: F401
    from .registry import ORACLE_SQL

    lessons = ORACLE_SQL["lessons_buckets"]
    ORACLE_SQL["learning_overlay"] = ORACLE_SQL["learning_overlay"].replace("{lessons}", lessons)


_with_lessons()


COLUMNS = {"name": "'t' || s_nationkey", "`column`": "'c' || s_suppkey", "position": "s_suppkey % 1000", "type": "CASE s_suppkey % 3 WHEN 0 THEN 'INT' WHEN 1 THEN 'TEXT' ELSE 'DATE' END", "nullable": "s_suppkey % 2 = 0"}


@query(
    "catalog_ddl",
    """WITH c AS (SELECT 't' || s_nationkey AS name, string_agg('  c' || s_suppkey || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'INT' WHEN 1 THEN 'TEXT' ELSE 'DATE' END || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY s_suppkey % 1000, s_suppkey::VARCHAR) AS cs FROM supplier GROUP BY 1),
 k AS (SELECT 't' || s_nationkey AS name, string_agg('  FOREIGN KEY (c' || s_suppkey || ') REFERENCES t' || (s_nationkey + 1) % 25 || '(id)', ',' || chr(10) ORDER BY 'c' || s_suppkey) AS ks FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1)
 SELECT name, md5('CREATE TABLE ' || name || ' (' || chr(10) || cs || coalesce(',' || chr(10) || ks, '') || chr(10) || ');') AS sig FROM c LEFT JOIN k USING (name)""",
)
def catalog_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalog import ddl

    keys = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").selectExpr("'t' || s_nationkey AS name", "'c' || s_suppkey AS `column`", "'t' || ((s_nationkey + 1) % 25) AS to", "'id' AS to_column")
    return ddl(given(spark, sf_dir, "supplier", **COLUMNS), keys).select("name", F.md5("ddl").alias("sig"))


@query(
    "language_passes",
    kg(""" SELECT relation, count(*) AS n FROM (SELECT CASE WHEN ends_with(source_file, '.java') THEN 'java_' || relation WHEN ends_with(source_file, '.md') THEN NULL ELSE relation END AS relation FROM edges) WHERE relation IS NOT NULL GROUP BY relation"""),
)
def language_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.passes import Passes
    from .kgview import edges

    passes = Passes()
    passes.add("java", [".java"], lambda e: e.withColumn("relation", F.concat(F.lit("java_"), "relation")))
    passes.add("notes", ["md", "MDX"], lambda e: e.limit(0))
    return passes.apply(edges(spark, sf_dir)).groupBy("relation").agg(F.count("*").alias("n"))
