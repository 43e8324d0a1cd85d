"""Rows of text in graph and report formats, and writers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cypher_string(c: Column) -> Column:
    """Quoted, with quotes, backslashes and line ends escaped."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("'"), out, F.lit("'"))


def cypher_name(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: a MERGE for each node, a MATCH and MERGE for each edge."""
    kind = F.initcap(F.regexp_replace("file_type", "[^A-Za-z0-9_]", "_"))
    n = nodes.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), cypher_string(F.col("id")), F.lit("}) SET n.label = "), cypher_string(F.col("label")), F.lit(";")).alias("line"))
    e = edges.select(
        F.concat(
            F.lit("MATCH (a {id: "), cypher_string(F.col("src")), F.lit("}), (b {id: "), cypher_string(F.col("dst")), F.lit("}) MERGE (a)-[:"),
            cypher_name(F.col("relation")), F.lit(" {confidence: "), cypher_string(F.col("confidence")), F.lit("}]->(b);"),
        ).alias("line")
    )
    return n.union(e)


def xml_text(c: Column) -> Column:
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: the elements of nodes and edges; a writer adds header and footer."""
    n = nodes.select(F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(
        F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"><data key="relation">'), xml_text(F.col("relation")), F.lit("</data></edge>")).alias("line")
    )
    return n.union(e)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, json: an object for each node and link, keys in a fixed order."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", "file_type", "source_file", "community")).alias("json"))
    e = edges.select(F.lit("link"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence")))
    return n.union(e)


def wiki_links(nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """id, note: a page for each node with links to its first neighbours by name. Names are
    ranked within a node before they are collected, so a hub's page stays short."""
    from pyspark.sql import Window

    around = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    k = F.row_number().over(Window.partitionBy("id").orderBy("to"))
    first = around.withColumn("k", k).where(F.col("k") <= most)
    links = first.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("to")), lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))), "\n").alias("links"))
    note = F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return nodes.join(links, "id", "left").select("id", note.alias("note"))


def report_lines(stats: DataFrame) -> DataFrame:
    """line: one bullet for each column of a one-row table."""
    items = [F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in stats.columns]
    return stats.select(F.explode(F.array(*items)).alias("line"))


def tree(nodes: DataFrame) -> DataFrame:
    """path, depth, n: nodes under each directory and file of their source."""
    parts = F.split("source_file", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth")))
    each = nodes.where("source_file <> ''").select(F.explode(paths).alias("p"))
    return each.groupBy("p.path", "p.depth").agg(F.count("*").alias("n"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """As text files of a folder, committed when all are written."""
    lines.select(column).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
