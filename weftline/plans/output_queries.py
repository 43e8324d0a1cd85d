"""Queries that render: graph formats, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import dealt
from ..sinks import formats as W
from .kgview import kg, links, nodes
from .registry import query


@query(
    "to_cypher_lines",
    kg(r""" SELECT md5(line) AS sig, count(*) AS n FROM (
 SELECT 'MERGE (n:' || upper(substr(file_type, 1, 1)) || substr(file_type, 2) || ' {id: ''' || id || '''}) SET n.label = ''' || replace(replace(label, '\', '\\'), '''', '\''') || ''';' AS line FROM nodes
 UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' FROM edges) GROUP BY line"""),
)
def to_cypher_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cypher(nodes(spark, sf_dir), links(spark, sf_dir)).groupBy("line").agg(F.count("*").alias("n")).select(F.md5("line").alias("sig"), "n")


@query(
    "graphml_rows",
    kg(""" SELECT line, count(*) AS n FROM (
 SELECT '<node id="' || id || '"><data key="label">' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></node>' AS line FROM nodes
 UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data></edge>' FROM edges) GROUP BY line"""),
)
def graphml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.graphml(nodes(spark, sf_dir), links(spark, sf_dir)).groupBy("line").agg(F.count("*").alias("n"))


@query(
    "node_link_json",
    kg(""" SELECT kind, json, count(*) AS n FROM (
 SELECT 'node' AS kind, '{"id":"' || id || '","label":"' || label || '","file_type":"' || file_type || '","source_file":"' || source_file || '","community":' || community || '}' AS json FROM nodes
 UNION ALL SELECT 'link', '{"source":"' || src || '","target":"' || dst || '","relation":"' || relation || '","confidence":"' || confidence || '"}' FROM edges) GROUP BY ALL"""),
)
def node_link_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.node_link(nodes(spark, sf_dir), links(spark, sf_dir)).groupBy("kind", "json").agg(F.count("*").alias("n"))


@query(
    "graph_json_roundtrip",
    kg(""" SELECT 'node' AS what, file_type AS kind, count(*) AS n, count(DISTINCT community) AS n_different FROM nodes GROUP BY file_type
 UNION ALL SELECT 'link', relation || ' ' || confidence, count(*), count(DISTINCT src || '>' || dst) FROM edges GROUP BY relation, confidence"""),
)
def graph_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written as JSON objects, read again."""
    from ..sources.graph_json import parse_links, parse_nodes

    written = W.node_link(nodes(spark, sf_dir), links(spark, sf_dir))
    n, e = parse_nodes(written.where("kind = 'node'").select("json")), parse_links(written.where("kind = 'link'").select("json"))
    by_type = n.groupBy(F.col("file_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("community").alias("n_different"))
    by_relation = e.groupBy(F.concat_ws(" ", "relation", "confidence").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(F.concat_ws(">", "src", "dst")).alias("n_different"))
    return by_type.select(F.lit("node").alias("what"), "kind", "n", "n_different").union(by_relation.select(F.lit("link"), "kind", "n", "n_different"))


@query(
    "wiki_notes",
    kg(""", a AS (SELECT src AS id, dst AS t FROM edges UNION SELECT dst, src FROM edges), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS k FROM a),
 l AS (SELECT id, string_agg('- [[' || t || ']]', chr(10) ORDER BY t) AS links FROM k WHERE k <= 25 GROUP BY id)
 SELECT n.id, md5('# ' || label || chr(10) || chr(10) || coalesce(links, '')) AS sig FROM nodes n LEFT JOIN l USING (id)"""),
)
def wiki_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.wiki_links(nodes(spark, sf_dir), links(spark, sf_dir)).select("id", F.md5("note").alias("sig"))


@query(
    "tree_rollup",
    kg(""" SELECT path, depth, count(*) AS n FROM (SELECT unnest([string_split(source_file, '/')[1], source_file]) AS path, unnest([1, 2]) AS depth FROM nodes WHERE source_file <> '') GROUP BY ALL"""),
)
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tree(nodes(spark, sf_dir))


@query(
    "section_edge_summary",
    kg(""", e AS (SELECT split_part(a.source_file, '/', 1) AS sa, split_part(b.source_file, '/', 1) AS sb, relation FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
 SELECT sa, sb, count(*) AS n, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM e GROUP BY ALL"""),
)
def section_edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nodes(spark, sf_dir).select("id", F.substring_index("source_file", "/", 1).alias("s"))
    e = links(spark, sf_dir).select("src", "dst", "relation")
    for end, s in (("src", "sa"), ("dst", "sb")):
        e = dealt(e, end).join(dealt(top.withColumnsRenamed({"id": end, "s": s}), end), end).drop(end)
    return e.groupBy("sa", "sb").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))


@query(
    "diagram_sizes",
    kg(" SELECT id, round(10 + 30.0 * degree / (SELECT max(degree) FROM degree), 6) AS size FROM degree"),
)
def diagram_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import degreed

    d = degreed(spark, sf_dir)
    most = F.broadcast(d.agg(F.max("degree").alias("most")))  # one row
    return d.crossJoin(most).select("id", F.round(10 + 30.0 * F.col("degree") / F.col("most"), 6).alias("size"))


@query(
    "report_lines",
    kg(""" SELECT unnest(['- n_nodes: ' || (SELECT count(*) FROM nodes), '- n_edges: ' || (SELECT count(*) FROM simple), '- n_files: ' || (SELECT count(DISTINCT source_file) FROM nodes)]) AS line"""),
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).agg(F.count("*").alias("n_nodes"), F.countDistinct("source_file").alias("n_files"))
    stats = n.crossJoin(G.simple(links(spark, sf_dir)).agg(F.count("*").alias("n_edges")))  # one row each
    return W.report_lines(stats.select("n_nodes", "n_edges", "n_files"))


@query(
    "filename_numbers",
    "SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS file FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)",
)
def filename_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from .kgview import table

    k = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    p = table(spark, sf_dir, "part").withColumn("k", k)
    return p.select("p_partkey", F.concat("p_name", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""), F.lit(".md")).alias("file"))
