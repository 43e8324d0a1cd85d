"""Pages, notes, diagrams and dashboards as lines of text.

Each function gives rows with what they belong to, their order and their text; a writer
collects the few that make one page. What a page may show is ranked before it is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def top_per(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with k from 1."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("k") <= most)


def vault_names(nodes: DataFrame, cap: int = 80) -> DataFrame:
    """id and file name of a note: characters that a file system takes, at most cap of them;
    names that only differ in case are numbered by id."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " "))
    stem = F.substring(F.when(clean == "", F.col("id")).otherwise(clean), 1, cap)
    named = nodes.select("id", F.rtrim(stem).alias("stem"))
    k = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("id"))
    return named.select("id", F.concat("stem", F.when(k > 1, F.concat(F.lit("_"), (k - 1).cast("string"))).otherwise("")).alias("name"))


def vault_notes(nodes: DataFrame, links: DataFrame, most: int = 30) -> DataFrame:
    """id, name, note: front matter, tags and links to the notes of the first neighbours by id."""
    names = vault_names(nodes)
    around = links.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("to")).union(links.where("src <> dst").select("dst", "src"))
    # repeats share a rank, so neighbours are dealt out once, by node, and made distinct where they lie
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy("to"))
    first = around.withColumn("k", rank).where(F.col("k") <= most).distinct().join(names.select(F.col("id").alias("to"), F.col("name").alias("other")), "to")
    lines = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "other"))).alias("l"))
    said = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- [["), x["other"], F.lit("]]"))), "\n")
    head = F.concat(F.lit("---\ntype: "), "file_type", F.lit("\ncommunity: "), F.col("community").cast("string"), F.lit("\n---\n# "), "label", F.lit("\n"))
    return nodes.join(names, "id").join(lines.select("id", said.alias("said")), "id", "left").select("id", "name", F.concat(head, F.coalesce("said", F.lit(""))).alias("note"))


def circle(degreed: DataFrame, most: int = 100, width: int = 800) -> DataFrame:
    """id, x, y, r: places on a circle of the most connected nodes, in order; radius by degree."""
    first = degreed.orderBy(F.desc("degree"), "id").limit(most)
    k = first.withColumn("k", F.row_number().over(Window.orderBy(F.desc("degree"), "id")) - 1)  # `most` rows
    top = F.max("degree").over(Window.partitionBy())
    angle = 2 * math.pi * F.col("k") / most
    at = k.select("id", "label", "k", angle.alias("a"), (F.col("degree") / top).alias("share"))
    return at.select("id", "label", F.round(width / 2 * (1 + 0.9 * F.cos("a")), 2).alias("x"), F.round(width / 2 * (1 + 0.9 * F.sin("a")), 2).alias("y"), F.round(4 + 16 * F.col("share"), 2).alias("r"))


def svg_lines(places: DataFrame, links: DataFrame) -> DataFrame:
    """line: a circle for each place, a line for each link between two of them."""
    a, b = (places.select(F.col("id").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}")) for e in ("u", "v"))
    num = lambda c: F.format_string("%.2f", c)
    dots = places.select(F.concat(F.lit('<circle cx="'), num(F.col("x")), F.lit('" cy="'), num(F.col("y")), F.lit('" r="'), num(F.col("r")), F.lit('"/>')).alias("line"))
    shown = links.join(a, "u").join(b, "v")
    strokes = shown.select(F.concat(*(x for c in ("x1", "y1", "x2", "y2") for x in (F.lit(("<line " if c == "x1" else " ") + c + '="'), num(F.col({"x1": "x_u", "y1": "y_u", "x2": "x_v", "y2": "y_v"}[c])), F.lit('"'))), F.lit("/>")))
    return dots.union(strokes)


def graph_view(degreed: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """kind, json: nodes sized by degree and their links; above the limit, communities by members
    and the weights between them."""
    n = degreed.count()
    if n <= limit:
        top = F.greatest(F.max("degree").over(Window.partitionBy()), F.lit(1))
        sized = degreed.select("id", "label", F.round(10 + 30 * F.col("degree") / top, 2).alias("size"))
        return sized.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", "size")).alias("json")).union(links.select(F.lit("link"), F.to_json(F.struct("u", "v"))))
    size = degreed.groupBy("community").agg(F.count("*").alias("members"))
    a, b = (degreed.select(F.col("id").alias(e), F.col("community").alias(f"c_{e}")) for e in ("u", "v"))
    between = links.join(a, "u").join(b, "v").where("c_u <> c_v").groupBy(F.least("c_u", "c_v").alias("a"), F.greatest("c_u", "c_v").alias("b")).agg(F.count("*").alias("weight"))
    return size.select(F.lit("node").alias("kind"), F.to_json(F.struct("community", "members")).alias("json")).union(between.select(F.lit("link"), F.to_json(F.struct("a", "b", "weight"))))


def mermaid(section: str, nodes: DataFrame, links: DataFrame, most_nodes: int = 18, most_links: int = 24) -> DataFrame:
    """section, k, line: a flow chart of each section's most connected nodes and the links among
    them. nodes: section, id, label, degree; links: src, dst, relation."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    shown = top_per(nodes, section, [F.desc("degree"), F.col("id")], most_nodes)
    a, b = (shown.select(F.col("id").alias(e), F.col(section).alias(f"s_{e}")) for e in ("src", "dst"))
    inner = links.select("src", "dst", "relation").distinct().join(a, "src").join(b, "dst").where("s_src = s_dst and src <> dst").withColumnRenamed("s_src", section)
    arrows = top_per(inner, section, [F.col("src"), F.col("dst"), F.col("relation")], most_links)
    boxes = shown.select(section, "k", F.concat(safe(F.col("id")), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    lines = arrows.select(section, (F.col("k") + most_nodes).alias("k"), F.concat(safe(F.col("src")), F.lit(" -->|"), "relation", F.lit("| "), safe(F.col("dst"))).alias("line"))
    return boxes.union(lines)


def call_table(section: str, nodes: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """section, id, callers, callees: of each section's most connected nodes, the first by id."""
    shown = stored(top_per(nodes, section, [F.desc("degree"), F.col("id")], most).select(section, "id"))  # found once; where few, sent to the links

    def first(at: str, to: str, name: str) -> DataFrame:
        met = links.select(F.col(at).alias("id"), F.col(to).alias("other")).join(shown.select("id"), "id", "left_semi").distinct()
        return top_per(met, "id", [F.col("other")], most).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias(name))

    out = shown.join(first("dst", "src", "callers"), "id", "left").join(first("src", "dst", "callees"), "id", "left")
    return out.select(section, "id", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))


def lessons_lines(buckets: DataFrame) -> DataFrame:
    """bucket, k, line of what was learnt of nodes: bucket, node, pos, neg, verdict, score."""
    times = lambda c: F.concat(F.col(c).cast("string"), F.lit("×"))
    agreed = F.concat(F.lit("- `"), "node", F.lit("` ("), times("pos"), F.lit(" useful)"))
    lean = F.when(F.col("verdict") == "even", F.lit("evenly split")).otherwise(F.concat(F.lit("recency leans **"), "verdict", F.lit("**")))
    split = F.concat(F.lit("- `"), "node", F.lit("` — "), times("pos"), F.lit(" useful, "), times("neg"), F.lit(" dead end/corrected → "), lean)
    return buckets.select("bucket", "node", F.when(F.col("bucket") == "contested", split).otherwise(agreed).alias("line"))


def request_lines(requests: DataFrame) -> DataFrame:
    """number, line: a change request by state, title and author, the title cut to 40."""
    title = F.when(F.length("title") > 40, F.concat(F.substring("title", 1, 37), F.lit("..."))).otherwise(F.col("title"))
    return requests.select("number", F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" ["), "status", F.lit("] "), title, F.lit(" @"), "author").alias("line"))


def node_card(degreed: DataFrame, id_: str) -> DataFrame:
    """line, k: what is known of one node."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [("Node", "label"), ("  ID", "id"), ("  Source", "source_file"), ("  Type", "file_type"), ("  Community", "community"), ("  Degree", "degree")]
    lines = F.array(*(F.concat(F.lit(f"{name}: "), text(c)) for name, c in parts))
    return degreed.where(F.col("id") == id_).select(F.posexplode(lines).alias("k", "line"))


def topic_prompt(labels: DataFrame, most: int = 5) -> DataFrame:
    """One row: a hint that names the first labels; labels: label, k."""
    first = labels.where(F.coalesce("label", F.lit("")) != "").orderBy("k").limit(most)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ")
    said = F.concat(F.lit("Technical discussion about "), names, F.lit(". Use proper punctuation and paragraph breaks."))
    return first.agg(F.when(F.count("*") > 0, said).otherwise("Use proper punctuation and paragraph breaks.").alias("prompt"))
