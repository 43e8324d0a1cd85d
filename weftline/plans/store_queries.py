"""Queries on the stored graph."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder
from ..sinks.store import Store
from .kgview import kg, links, nodes, table
from .registry import query


@query(
    "stored_graph",
    kg(
        """, first AS (SELECT file_type AS key, count(*) AS n, sum(length(label)) AS chars FROM nodes GROUP BY 1),
 l AS (SELECT relation AS key, count(*) AS n, sum(length(src)) AS chars FROM edges GROUP BY 1),
 second AS (SELECT * FROM first WHERE key = 'code' UNION ALL SELECT 'concept', count(*), sum(length(r_name) + 4) FROM region)
 SELECT 1 AS version, 'nodes' AS "table", * FROM first UNION ALL SELECT 1, 'links', * FROM l UNION ALL SELECT 2, 'nodes', * FROM second UNION ALL SELECT 2, 'links', * FROM l
 UNION ALL SELECT 3, 'nodes', * FROM first UNION ALL SELECT 3, 'links', * FROM l"""
    ),
)
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph stored, its documents and concepts replaced by new concepts, and the first version again."""
    s = Store(spark, f"{shared_folder(spark)}/graph-{uuid4().hex}")
    n, e = nodes(spark, sf_dir), links(spark, sf_dir).drop("source_location")
    s.write({"nodes": n, "links": e}, keys={"nodes": "file_type", "links": "relation"}, note="all")
    new = table(spark, sf_dir, "region").select(
        F.concat(F.lit("region_"), "r_regionkey").alias("id"), F.concat(F.lit("new "), "r_name").alias("label"), F.lit("concept").alias("file_type"), F.lit("").alias("source_file"), F.col("r_regionkey").cast("int").alias("community")
    )
    s.write({"nodes": new}, keys={"nodes": "file_type"}, replace=["concept", "document"], note="new concepts")
    s.restore(1)
    counted = lambda v, t, key, text: s.read(t, v).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(F.char_length(text)).alias("chars")).select(F.lit(v).alias("version"), F.lit(t).alias("table"), "key", "n", "chars")
    found = [counted(v, t, key, text) for v in s.versions() for t, key, text in (("nodes", "file_type", "label"), ("links", "relation", "src"))]
    out = checkpointed(reduce(DataFrame.unionByName, found))
    s.delete()
    return out
