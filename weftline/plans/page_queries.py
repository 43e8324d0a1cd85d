"""Queries that render pages, notes, diagrams and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import layout
from ..sinks import pages as P
from .display_queries import given, given_sql
from .graph_queries import degreed
from .kgview import kg, links, nodes, table
from .registry import query

STEMS = r"""st AS (SELECT *, rtrim(substr(CASE WHEN c = '' THEN id ELSE c END, 1, 80)) AS stem FROM (SELECT *, trim(regexp_replace(regexp_replace(label, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM nodes)),
 nm AS (SELECT id, stem || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY id) AS k FROM st))"""


@query(
    "vault_notes",
    kg(f""", {STEMS}, a AS (SELECT src AS id, dst AS t FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS k FROM a) WHERE k <= 30),
 l AS (SELECT f.id, string_agg('- [[' || nm.name || ']]', chr(10) ORDER BY f.k) AS said FROM f JOIN nm ON nm.id = f.t GROUP BY f.id)
 SELECT n.id, nm.name, md5('---' || chr(10) || 'type: ' || file_type || chr(10) || 'community: ' || community || chr(10) || '---' || chr(10) || '# ' || label || chr(10) || coalesce(said, '')) AS sig
 FROM nodes n JOIN nm USING (id) LEFT JOIN l USING (id)"""),
)
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.vault_notes(nodes(spark, sf_dir), links(spark, sf_dir)).select("id", "name", F.md5("note").alias("sig"))


CIRCLE = """pl AS (SELECT id, k, round(400 * (1 + 0.9 * cos(2 * pi() * k / 100)), 2) AS x, round(400 * (1 + 0.9 * sin(2 * pi() * k / 100)), 2) AS y, round(4 + 16.0 * degree / max(degree) OVER (), 2) AS r
 FROM (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS k FROM degree) WHERE k < 100)"""


@query("svg_places", kg(f", {CIRCLE} SELECT id, x, y, r FROM pl"))
def svg_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.circle(degreed(spark, sf_dir)).drop("label")


@query(
    "svg_lines",
    kg(f""", {CIRCLE} SELECT line, count(*) AS n FROM (SELECT format('<circle cx="{{:.2f}}" cy="{{:.2f}}" r="{{:.2f}}"/>', x, y, r) AS line FROM pl
 UNION ALL SELECT format('<line x1="{{:.2f}}" y1="{{:.2f}}" x2="{{:.2f}}" y2="{{:.2f}}"/>', a.x, a.y, b.x, b.y) FROM simple JOIN pl a ON a.id = u JOIN pl b ON b.id = v) GROUP BY line"""),
)
def svg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.svg_lines(P.circle(degreed(spark, sf_dir)), G.simple(links(spark, sf_dir)))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query("force_layout")
def force_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all nodes after ten rounds. A test holds the rounds against a plain loop."""
    return layout.force_layout(nodes(spark, sf_dir).select("id"), G.simple(links(spark, sf_dir)), 10)


@query(
    "graph_view",
    kg(""", m AS (SELECT '{"community":' || community || ',"members":' || count(*) || '}' AS json FROM nodes GROUP BY community),
 w AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS n FROM simple JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.community <> b.community GROUP BY ALL)
 SELECT 'node' AS kind, json FROM m UNION ALL SELECT 'link', '{"a":' || a || ',"b":' || b || ',"weight":' || n || '}' FROM w"""),
)
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.graph_view(degreed(spark, sf_dir), G.simple(links(spark, sf_dir)), 1500)


SECTION = "string_split(source_file, '/')[1]"


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degreed(spark, sf_dir).withColumn("section", F.substring_index("source_file", "/", 1))


@query(
    "callflow_mermaid",
    kg(f""", t AS (SELECT * FROM (SELECT *, {SECTION} AS section, row_number() OVER (PARTITION BY {SECTION} ORDER BY degree DESC, id) AS k FROM degree) WHERE k <= 18),
 i AS (SELECT DISTINCT a.section, src, dst, relation FROM edges JOIN t a ON a.id = src JOIN t b ON b.id = dst AND a.section = b.section WHERE src <> dst),
 r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY src, dst, relation) AS k FROM i)
 SELECT section, cast(k AS INTEGER) AS k, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(label, '"', '''') || '"]' AS line FROM t UNION ALL
 SELECT section, cast(k + 18 AS INTEGER), regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || relation || '| ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') FROM r WHERE k <= 24"""),
)
def callflow_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mermaid("section", sectioned(spark, sf_dir), links(spark, sf_dir))


@query(
    "call_tables",
    kg(f""", t AS (SELECT * FROM (SELECT *, {SECTION} AS section, row_number() OVER (PARTITION BY {SECTION} ORDER BY degree DESC, id) AS k FROM degree) WHERE k <= 5),
 i AS (SELECT dst AS id, src AS o, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM (SELECT DISTINCT src, dst FROM edges)), o AS (SELECT src AS id, dst AS o, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM edges)),
 ci AS (SELECT id, string_agg(o, ', ' ORDER BY o) AS callers FROM i WHERE k <= 5 GROUP BY id), co AS (SELECT id, string_agg(o, ', ' ORDER BY o) AS callees FROM o WHERE k <= 5 GROUP BY id)
 SELECT section, id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM t LEFT JOIN ci USING (id) LEFT JOIN co USING (id)"""),
)
def call_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.call_table("section", sectioned(spark, sf_dir), links(spark, sf_dir))


def _lessons_sql() -> str:
    from .feedback_queries import AGG, DOC_SQL

    return f"""WITH {DOC_SQL}, g AS (SELECT node, {AGG} FROM w GROUP BY node),
 b AS (SELECT *, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS bucket FROM g WHERE pos > 0)
 SELECT bucket, node, CASE WHEN bucket = 'contested' THEN '- `' || node || '` — ' || pos || '× useful, ' || neg || '× dead end/corrected → ' || CASE WHEN score > 0 THEN 'recency leans **useful**' WHEN score < 0 THEN 'recency leans **dead end**' ELSE 'evenly split' END
 ELSE '- `' || node || '` (' || pos || '× useful)' END AS line FROM b"""


@query("lessons_lines", _lessons_sql())
def lessons_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feedback_queries import lessons_buckets

    return P.lessons_lines(lessons_buckets(spark, sf_dir))


REQUESTS = {"number": "o_orderkey", "status": "CASE o_orderstatus WHEN 'F' THEN 'CI-FAIL' WHEN 'O' THEN 'READY' ELSE 'DRAFT' END", "title": "o_orderpriority || ' change of customer ' || o_custkey || repeat(' more', cast(o_orderkey % 5 AS INT))", "author": "'dev' || (o_custkey % 11)"}


@query(
    "request_lines",
    f"SELECT number, '#' || number || ' [' || status || '] ' || CASE WHEN length(title) > 40 THEN title[:37] || '...' ELSE title END || ' @' || author AS line FROM ({given_sql('orders', **REQUESTS)})",
)
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.request_lines(given(spark, sf_dir, "orders", **REQUESTS))


@query(
    "node_card",
    kg(""" SELECT unnest([0, 1, 2, 3, 4, 5]) AS k, unnest(['Node: ' || label, '  ID: ' || id, '  Source: ' || source_file, '  Type: ' || file_type, '  Community: ' || community, '  Degree: ' || degree]) AS line FROM degree WHERE id = 'supplier_3'"""),
)
def node_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.node_card(degreed(spark, sf_dir), "supplier_3")


@query("community_listing", kg(" SELECT id, label, source_file FROM nodes WHERE community = 3"))
def community_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("community = 3").select("id", "label", "source_file")


@query(
    "topic_prompt",
    kg(""" SELECT 'Technical discussion about ' || string_agg(label, ', ' ORDER BY degree DESC, id) || '. Use proper punctuation and paragraph breaks.' AS prompt FROM (SELECT * FROM degree ORDER BY degree DESC, id LIMIT 5)"""),
)
def topic_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = degreed(spark, sf_dir).orderBy(F.desc("degree"), "id").limit(10)
    return P.topic_prompt(first.withColumn("k", F.row_number().over(Window.orderBy(F.desc("degree"), "id"))))


@query("dfs_khop", None)
def dfs_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir)
    seeds = spark.createDataFrame([("part_7",)], "id string")
    return G.dfs(seeds, G.ends(e), G.degrees(nodes(spark, sf_dir), G.simple(e)), 3)


@query(
    "edge_betweenness",
    """WITH e AS (SELECT 'nation_' || n_nationkey AS u, 'region_' || n_regionkey AS v, 'nation' AS kind, n_nationkey AS n, n_regionkey AS r FROM nation UNION ALL
 SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'supplier', s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 s AS (SELECT n, count(*) AS below FROM e GROUP BY n), t AS (SELECT r, count(*) + 1 AS size FROM e GROUP BY r)
 SELECT u, v, round(CASE kind WHEN 'nation' THEN below * (size - below) ELSE size - 1 END::DOUBLE, 6) AS score FROM e JOIN s USING (n) JOIN t USING (r)""",
)
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the trees of regions, nations and suppliers: an edge parts a tree in two, and as many
    pairs of nodes lie on either side."""
    from ..operators.centrality import edge_betweenness

    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    pairs = n.selectExpr("'nation_' || n_nationkey AS u", "'region_' || n_regionkey AS v").union(s.selectExpr("'nation_' || s_nationkey", "'supplier_' || s_suppkey"))
    return edge_betweenness(pairs)


@query(
    "path_segments",
    kg("""RECURSIVE, arc AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
 lv AS (SELECT 'customer_1' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM lv JOIN arc ON a = id WHERE hop < 6), h AS (SELECT id, min(hop) AS hop FROM lv GROUP BY id),
 par AS (SELECT x.id, min(y.id) AS parent FROM h x JOIN arc ON arc.b = x.id JOIN h y ON y.id = arc.a AND y.hop = x.hop - 1 GROUP BY x.id),
 s AS (SELECT h.hop, h.id, par.parent FROM h LEFT JOIN par USING (id) WHERE h.id = 'region_0' UNION ALL SELECT s.hop - 1, s.parent, par.parent FROM s LEFT JOIN par ON par.id = s.parent WHERE s.parent IS NOT NULL),
 w AS (SELECT s.hop, min((e.src <> s.parent, relation)) AS m FROM s JOIN edges e ON (e.src = s.parent AND e.dst = s.id) OR (e.dst = s.parent AND e.src = s.id) GROUP BY s.hop)
 SELECT s.hop, s.id, n.label, m[2] AS relation, NOT m[1] AS forward FROM s JOIN nodes n USING (id) LEFT JOIN w USING (hop)"""),
)
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir)
    return G.path_lines(G.shortest_path(e, "customer_1", "region_0", directed=False), e, nodes(spark, sf_dir))
