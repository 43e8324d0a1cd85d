"""The property graph that the queries work on, derived from the star-schema tables.

nodes: id, label, file_type, source_file, community. edges: src, dst, relation, context,
confidence, weight, source_file, source_location, with true directions and parallel edges.
KG_SQL holds the same views (and the simple undirected one) as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def _order_file() -> Column:
    return F.concat(F.lit("sales/y"), F.year("o_orderdate").cast("string"), F.lit(".py"))


def part_file() -> Column:
    slug = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_")
    return F.concat(F.lit("catalog/"), F.trim(slug, F.lit("_")), F.lit(".py"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation = F.broadcast(t("nation").select("n_nationkey", "n_regionkey"))  # one row per country: 25 at any scale

    def row(df: DataFrame, kind: str, key: str, label: Column, file_type: str, source: Column, community: Column) -> DataFrame:
        return df.select(
            _id(kind, key).alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"), source.alias("source_file"), community.cast("int").alias("community")
        )

    customer = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").select("s_suppkey", "s_name", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    crm = F.concat(F.lit("crm/"), F.lower("c_mktsegment"), F.lit(".py"))
    scm = F.concat(F.lit("scm/n"), F.col("s_nationkey").cast("string"), F.lit(".java"))
    kinds = [
        row(t("region"), "region", "r_regionkey", F.col("r_name"), "concept", F.lit(""), F.col("r_regionkey")),
        row(t("nation"), "nation", "n_nationkey", F.col("n_name"), "document", F.lit("ref/nation.md"), F.col("n_regionkey")),
        row(customer, "customer", "c_custkey", F.col("c_name"), "code", crm, F.col("n_regionkey")),
        row(supplier, "supplier", "s_suppkey", F.col("s_name"), "code", scm, F.col("n_regionkey")),
        row(t("part"), "part", "p_partkey", F.col("p_name"), "code", part_file(), F.col("p_size") % 5),
        row(orders, "order", "o_orderkey", F.concat(_id("order", "o_orderkey"), F.lit("()")), "code", _order_file(), F.col("n_regionkey")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges() without source_file: keys alone make them, so that no table is joined. Each key
    names a row of its table, so the rows are the same."""
    return _edges(spark, sf_dir, files=False).drop("source_file")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, files=True)


def _edges(spark: SparkSession, sf_dir: str, files: bool) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    no_weight, no_place = F.lit(1.0), F.lit(None).cast("string")

    def row(df: DataFrame, src: Column, dst: Column, relation: str, context: str, confidence: Column, weight: Column, source: Column, place: Column) -> DataFrame:
        return df.select(
            src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(context).alias("context"), confidence.alias("confidence"),
            weight.alias("weight"), source.alias("source_file"), place.alias("source_location"),
        )

    sure = F.lit("EXTRACTED")
    flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    line = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    item = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    sold = item.join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")) if files else item
    made = item.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")) if files else item
    crm = F.concat(F.lit("crm/"), F.lower("c_mktsegment"), F.lit(".py"))
    scm = F.concat(F.lit("scm/n"), F.col("s_nationkey").cast("string"), F.lit(".java"))
    kinds = [
        row(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "references", "field", sure, no_weight, F.lit("ref/nation.md"), no_place),
        row(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "references", "field", sure, no_weight, crm, no_place),
        row(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "references", "field", sure, no_weight, scm, no_place),
        row(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "imports_from", "import", sure, no_weight, _order_file(), no_place),
        row(sold, _id("order", "l_orderkey"), _id("part", "l_partkey"), "calls", "call", flag, F.col("l_quantity"), _order_file() if files else no_place, line),
        row(made, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "uses", "parameter_type", flag, F.col("l_quantity"), part_file() if files else no_place, line),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


KG_SQL = r"""
nodes AS (
  SELECT 'region_' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, '' AS source_file, r_regionkey AS community FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'document', 'ref/nation.md', n_regionkey FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'code', 'crm/' || lower(c_mktsegment) || '.py', n_regionkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'code', 'scm/n' || s_nationkey || '.java', n_regionkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'code', 'catalog/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.py', p_size % 5 FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'order_' || o_orderkey || '()', 'code', 'sales/y' || year(o_orderdate) || '.py', n_regionkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT 'nation_' || n_nationkey AS src, 'region_' || n_regionkey AS dst, 'references' AS relation, 'field' AS context, 'EXTRACTED' AS confidence,
         1.0::DOUBLE AS weight, 'ref/nation.md' AS source_file, NULL::VARCHAR AS source_location FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'references', 'field', 'EXTRACTED', 1.0, 'crm/' || lower(c_mktsegment) || '.py', NULL FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'references', 'field', 'EXTRACTED', 1.0, 'scm/n' || s_nationkey || '.java', NULL FROM supplier
  UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'imports_from', 'import', 'EXTRACTED', 1.0, 'sales/y' || year(o_orderdate) || '.py', NULL FROM orders
  UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, 'calls', 'call', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
         l_quantity, 'sales/y' || year(o_orderdate) || '.py', 'L' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'uses', 'parameter_type', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
         l_quantity, 'catalog/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.py', 'L' || l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
simple AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges),
deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM simple UNION ALL SELECT v FROM simple) GROUP BY id),
degree AS (SELECT n.*, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN deg d USING (id))
"""


def kg(sql: str) -> str:
    """The query behind the graph's views; a leading WITH RECURSIVE or comma goes on with them."""
    head = "WITH RECURSIVE " if sql.lstrip().startswith("RECURSIVE,") else "WITH "
    body = sql.lstrip().removeprefix("RECURSIVE")
    return head + KG_SQL + body
