"""Queries on ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from .kgview import kg, links, nodes, table
from .registry import query

TERMS = S.query_terms("How is the small bolt part used?")
PARTS_SQL = ", " .join(f"('{t}')" for t in TERMS)
IDF_SQL = f""", term(t) AS (VALUES {PARTS_SQL}),
 idf AS (SELECT t AS term, count(*) FILTER (contains(lower(label), t)) AS df, ln(1 + count(*) / (1 + count(*) FILTER (contains(lower(label), t)))::DOUBLE) AS idf FROM nodes, term GROUP BY t)"""
SCORE_SQL = f"""{IDF_SQL},
 x AS (SELECT n.id, n.label, i.term, i.idf, lower(n.label) AS l, rtrim(lower(n.label), '()') AS b, lower(n.source_file) AS s FROM nodes n, idf i),
 y AS (SELECT id, label, sum(CASE WHEN l = term OR b = term THEN 1000.0 WHEN starts_with(l, term) OR starts_with(b, term) THEN 100.0 ELSE 0 END * idf) AS tiered,
  sum(CASE WHEN NOT (l = term OR b = term OR starts_with(l, term) OR starts_with(b, term)) AND contains(l, term) THEN idf ELSE 0 END + CASE WHEN contains(s, term) THEN 0.5 * idf ELSE 0 END) AS flat,
  count(*) FILTER (contains(l, term)) AS matched, any_value(l) AS l, any_value(b) AS b, avg(idf) AS w FROM x GROUP BY id, label),
 scored AS (SELECT id, label, flat + tiered * (matched / {len(TERMS)}.0) * (matched / {len(TERMS)}.0)
  + w * CASE WHEN '{" ".join(TERMS)}' IN (l, b, lower(id)) THEN 10000.0 WHEN starts_with(l, '{" ".join(TERMS)}') OR starts_with(b, '{" ".join(TERMS)}') THEN 1000.0 ELSE 0 END AS score FROM y)"""


@query("idf_weights", kg(f"{IDF_SQL} SELECT term, df, idf FROM idf"))
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inverse_frequency(nodes(spark, sf_dir), TERMS)


@query("ranked_search", kg(f"{SCORE_SQL} SELECT id, label, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY score DESC, length(label), id LIMIT 25"))
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.ranked(nodes(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))
    return S.top_hits(hits, 25)


@query(
    "pick_seeds",
    kg(f"""{SCORE_SQL}, l AS (SELECT label, id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, id) AS k FROM scored WHERE score > 0),
 h AS (SELECT label, id, score FROM l WHERE k = 1 ORDER BY score DESC, length(label), id LIMIT 3) SELECT * FROM h WHERE score >= 0.2 * (SELECT max(score) FROM h)"""),
)
def pick_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seeds(S.ranked(nodes(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6)))


@query(
    "best_seed_per_term",
    kg(f"""{IDF_SQL}, x AS (SELECT term, id, label, CASE WHEN l = term OR b = term THEN 2 WHEN starts_with(l, term) THEN 1 ELSE 0 END AS tier FROM
  (SELECT i.term, n.id, n.label, lower(n.label) AS l, rtrim(lower(n.label), '()') AS b FROM nodes n JOIN idf i ON contains(lower(n.label), i.term)))
 SELECT term, arg_min(id, row(-tier, length(label), id)) AS id FROM x GROUP BY term"""),
)
def best_seed_per_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("id", "label", S.normal(F.col("label")).alias("l"))
    hit = n.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("l"), t))))
    tier = F.when((F.col("l") == F.col("term")) | (F.rtrim(F.col("l"), F.lit("()")) == F.col("term")), 2).when(F.startswith("l", "term"), 1).otherwise(0)
    return hit.groupBy("term").agg(F.min_by("id", F.struct(-tier, F.length("label"), F.col("id"))).alias("id"))


@query(
    "node_lookup_tiers",
    kg(""", t AS (SELECT id, label, CASE WHEN lower(source_file) = 'small bolt' THEN 0 WHEN lower(label) = 'small bolt' OR lower(id) = 'small bolt' THEN 1 WHEN starts_with(lower(label), 'small bolt') THEN 2
  WHEN contains(lower(label), 'small bolt') THEN 3 END AS tier FROM nodes) SELECT id, label, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""),
)
def node_lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lookup_tiers(nodes(spark, sf_dir), "small bolt").select("id", "label", "tier")


@query("ambiguity_by_file", kg("SELECT lower(label) AS label, count(*) AS n, count(DISTINCT source_file) AS n_files FROM nodes GROUP BY 1 HAVING count(DISTINCT source_file) > 1"))
def ambiguity_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nodes(spark, sf_dir).groupBy(S.normal(F.col("label")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_files"))
    return g.where("n_files > 1")


@query(
    "trigram_postings",
    kg(""", g AS (SELECT DISTINCT id, unnest(CASE WHEN length(label) < 3 THEN [lower(label)] ELSE list_transform(range(1, length(label) - 1), lambda i: substr(lower(label), i, 3)) END) AS gram FROM nodes)
 SELECT gram, count(*) AS n FROM g GROUP BY gram"""),
)
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(nodes(spark, sf_dir))


@query(
    "trigram_candidates",
    kg(""" SELECT id, label FROM nodes WHERE contains(lower(label), 'giz') AND contains(lower(label), 'izm') AND contains(lower(label), 'zmo')"""),
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.containing(nodes(spark, sf_dir), "gizmo").select("id", "label")


@query(
    "render_budget_lines",
    kg(""", l AS (SELECT id, degree, 'NODE ' || label || ' [' || source_file || '] degree=' || degree AS line FROM degree ORDER BY degree DESC, id LIMIT 1500),
 c AS (SELECT *, cast(sum(length(line) + 1) OVER (ORDER BY degree DESC, id) AS BIGINT) AS used FROM l) SELECT line, used FROM c WHERE used <= 1500"""),
)
def render_budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import degreed

    line = F.concat(F.lit("NODE "), "label", F.lit(" ["), "source_file", F.lit("] degree="), F.col("degree").cast("string"))
    lines = degreed(spark, sf_dir).select("id", "degree", line.alias("line"))
    return S.within_budget(lines, "line", [F.desc("degree"), F.col("id")], 500).select("line", "used")


@query(
    "query_terms_benchmark",
    r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: NOT regexp_full_match(x, '[a-z]{1,2}')))), ' ') AS terms FROM benchmark""",
)
def query_terms_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(S.tokens(F.col("text")), lambda w: ~w.rlike("^[a-z]{1,2}$"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("terms"))


@query("query_graph", None)
def query_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, scores, seeds, traversal and rendering in one plan."""
    from ..operators import graph as G
    from ..session import stored

    n, e = nodes(spark, sf_dir), links(spark, sf_dir)
    degreed = stored(G.degrees(n, G.simple(e)).select("id", "label", "source_file", "degree"))
    found = G.khop(S.seeds(S.ranked(n, TERMS)), G.ends(e), degreed, 2).join(degreed, "id")
    line = F.concat_ws(" ", F.lit("NODE"), "label", "source_file")
    lines = found.select("hop", "degree", "id", line.alias("line"))
    return S.within_budget(lines, "line", [F.col("hop"), F.desc("degree"), F.col("id")], 2000).select("id", "hop", "line", "used")
