"""Queries on diagnoses, lessons, sidecars and routines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources.extract import sql_routines
from ..sources.office import sidecars
from .display_queries import given, given_sql
from .feedback_queries import DOC_SQL, NOW, memory
from .kgview import kg, links, nodes, table
from .registry import query


LOST = "missing_end + dangling + duplicates_directed"


@query(
    "diagnosis_report",
    kg(f""", c AS (SELECT count(*) AS n_edges, count(*) FILTER (src IS NULL OR dst IS NULL) AS missing_end, count(*) FILTER (src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS dangling, count(*) FILTER (src = dst) AS self_loops FROM edges),
 g AS (SELECT src, dst, count(*) AS n, count(DISTINCT relation) AS r, count(DISTINCT source_location) AS l FROM edges GROUP BY src, dst),
 d AS (SELECT cast(sum(n) - count(*) AS BIGINT) AS duplicates_directed, count(*) FILTER (r > 1) AS relation_variants, count(*) FILTER (l > 1) AS location_variants FROM g),
 u AS (SELECT cast(sum(n) - count(*) AS BIGINT) AS duplicates_undirected FROM (SELECT sum(n) AS n FROM g GROUP BY least(src, dst), greatest(src, dst))),
 m AS (SELECT src, dst, count(*) AS n, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS rs FROM edges GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, src, dst LIMIT 5)
 SELECT unnest([{", ".join(f"'{c}: ' || {c}" for c in R.COUNTERS)}, CASE WHEN {LOST} > 0 THEN 'loses ' || ({LOST}) || ' of ' || n_edges || ' edges' ELSE 'loses nothing' END]) AS line FROM c, d, u
 UNION ALL SELECT src || ' -> ' || dst || ' x' || n || ' (' || rs || ')' FROM m"""),
)
def diagnosis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a diagnosis of the graph."""
    return R.diagnosis(nodes(spark, sf_dir), links(spark, sf_dir)).select("line")


LEARNT = "CASE WHEN user_id % 23 < 17 THEN user_id % 5 END"


@query(
    "reflected_lessons",
    f"""WITH {DOC_SQL}, g AS (SELECT node AS id, min({LEARNT.replace('user_id', 'substr(node, 2)::INT')}) AS community FROM d GROUP BY 1 HAVING min({LEARNT.replace('user_id', 'substr(node, 2)::INT')}) IS NOT NULL),
 s AS (SELECT node, round(sum(w), 6) AS score, count(*) FILTER (s > 0) AS pos, count(*) FILTER (s < 0) AS neg FROM w WHERE node IN (SELECT id FROM g) GROUP BY node),
 r AS (SELECT node, string_agg(question, ' ' ORDER BY date DESC, id DESC) AS recent FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY date DESC, id DESC) <= 3) GROUP BY node)
 SELECT g.community, s.node, CASE WHEN pos = 0 THEN 'dead_end' WHEN neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS bucket,
  CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict, score, pos, neg, recent FROM s JOIN g ON g.id = s.node JOIN r ON r.node = s.node""",
)
def reflected_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was learnt of the nodes that are still known, with the last questions on each."""
    docs = memory(spark, sf_dir).drop("community")
    known = docs.select(F.col("node").alias("id"), F.expr(LEARNT.replace("user_id", "cast(substring(node, 2) as int)")).alias("community")).where("community is not null").distinct()
    found = R.reflected(docs, known, NOW)
    return found.withColumns({"score": F.round("score", 6), "recent": F.array_join("recent", " ")})


OFFICE = {
    "path": "CASE doc_id % 3 WHEN 0 THEN 'a/Übersicht ' || doc_id || '.docx' WHEN 1 THEN 'b/c/t' || doc_id || '.v2.xlsx' ELSE 'r' || (doc_id // 9) || '/plan.docx' END",
    "time": "doc_id % 50",
    "text": "CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE lang || source END",
}
SIDECAR = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') || '_' || substr(sha256(path), 1, 8) || '.md'"


@query(
    "office_sidecars",
    f"""WITH o AS ({given_sql('documents', **OFFICE, k='doc_id')}), n AS (SELECT *, {SIDECAR} AS name FROM o), h AS (SELECT name, max(k % 70) AS written FROM n WHERE k % 2 = 0 GROUP BY 1)
 SELECT n.name, path, md5('<!-- converted from ' || split_part(path, '/', -1) || ' -->' || chr(10) || chr(10) || text) AS sig FROM n LEFT JOIN h ON h.name = n.name WHERE trim(text) <> '' AND (written IS NULL OR written < time)""",
)
def office_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files that are due for office files, some of which have newer ones already."""
    o = given(spark, sf_dir, "documents", **{k: v.replace("//", "div") for k, v in OFFICE.items()}, k="doc_id")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    present = o.where("k % 2 = 0").select(F.concat(stem, F.lit("_"), F.substring(F.sha2("path", 256), 1, 8), F.lit(".md")).alias("name"), (F.col("k") % 70).alias("time"))
    return sidecars(o, present).select("name", "path", F.md5("content").alias("sig"))


SQL_TEXT = {
    "k": "p_partkey",
    "text": """'CREATE TABLE broken' || p_partkey || ' (a INT' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '-- CREATE FUNCTION no' || p_partkey || '()' WHEN 1 THEN '/* a /* CREATE PROCEDURE no */ CREATE FUNCTION no() */' WHEN 2 THEN 'SELECT ''CREATE TRIGGER no'';' ELSE 'SELECT 1 AS [CREATE PROCEDURE no];' END || chr(10)
 || CASE p_size % 5 WHEN 0 THEN 'CREATE OR REPLACE FUNCTION f' || p_partkey || '() AS $$ CREATE FUNCTION no() $$;' WHEN 1 THEN 'create  procedure dbo.[p ' || p_partkey || '] as select 1' WHEN 2 THEN 'CREATE TRIGGER "t' || p_partkey || '" BEFORE' WHEN 3 THEN 'CREATE DEFINER=root PROC `q' || p_partkey || '`;' ELSE 'RECREATE FUNCTION no();' END""",
}


@query(
    "sql_routines",
    """SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'procedure' WHEN 2 THEN 'trigger' ELSE 'procedure' END AS kind,
 CASE p_size % 5 WHEN 0 THEN 'f' || p_partkey WHEN 1 THEN 'dbo.p ' || p_partkey WHEN 2 THEN 't' || p_partkey ELSE 'q' || p_partkey END AS name, 3 AS line FROM part WHERE p_size % 5 < 4""",
)
def sql_routines_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routines after broken statements, with decoys in comments, strings, bodies and names."""

    @F.pandas_udf("array<struct<kind:string,name:string,line:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "name": n, "line": x} for k, n, x in sql_routines(t or "")])

    return given(spark, sf_dir, "part", **SQL_TEXT).select("k", F.inline(found("text")))

