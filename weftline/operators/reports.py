"""What a stored graph's diagnosis and what was learnt look like as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import build, feedback

COUNTERS = ("n_edges", "missing_end", "dangling", "self_loops", "duplicates_directed", "duplicates_undirected", "relation_variants", "location_variants")


def diagnosis(nodes: DataFrame, edges: DataFrame, directed: bool = True, examples: int = 5) -> DataFrame:
    """k, line: the counters of build.diagnose(), the verdict, then the ends with the most parallel
    edges, up to `examples` of them. directed says which kind of duplicates counts for the verdict."""
    found = build.diagnose(nodes, edges)
    kind = "duplicates_directed" if directed else "duplicates_undirected"
    lost = F.col("missing_end") + F.col("dangling") + F.col(kind)
    said = F.when(lost > 0, F.concat(F.lit("loses "), lost.cast("string"), F.lit(" of "), F.col("n_edges").cast("string"), F.lit(" edges"))).otherwise("loses nothing")
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in COUNTERS] + [said]
    head = found.select(F.posexplode(F.array(*lines)).alias("k", "line"))
    ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    many = edges.where("src is not null and dst is not null").groupBy(ends[0].alias("a"), ends[1].alias("b"))
    many = many.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("relation")).alias("relations")).where("n > 1")
    top = many.orderBy(F.desc("n"), "a", "b").limit(examples)
    line = F.concat("a", F.lit(" -> " if directed else " -- "), "b", F.lit(" x"), F.col("n").cast("string"), F.lit(" ("), F.array_join("relations", ", "), F.lit(")"))
    numbered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "a", "b", line.alias("line")))).alias("all"))  # at most `examples` rows
    more = numbered.select(F.posexplode("all").alias("k", "e")).select((F.col("k") + len(lines)).alias("k"), "e.line")
    return head.unionByName(more)


def reflected(docs: DataFrame, nodes: DataFrame, now: str, *, half_life_days: float = 30.0, least: int = 2, recent: int = 3) -> DataFrame:
    """community, node, bucket, verdict, score, pos, neg, recent: what was learnt of nodes that the graph
    still has. docs: id, node, outcome, date, question; nodes: id, community. recent holds the
    questions of the last `recent` answers on the node, the newest first; nodes with bad outcomes
    only are in bucket `dead_end`. Docs of nodes that the graph has lost don't count."""
    known = docs.join(nodes.select(F.col("id").alias("node"), F.col("community")), "node")
    scored = feedback.scores(known.drop("community"), now, half_life_days)
    rated = feedback.buckets(scored, least)
    bad = scored.where("pos = 0").withColumns({"bucket": F.lit("dead_end"), "verdict": F.lit(None).cast("string")})
    newest = Window.partitionBy("node").orderBy(F.desc("date"), F.desc("id"))
    signed = known.where(feedback.sign(F.col("outcome")) != 0).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= recent)
    asked = F.transform(F.array_sort(F.collect_list(F.struct("k", "question"))), lambda x: x["question"])
    last = signed.groupBy("node").agg(asked.alias("recent"))
    out = rated.unionByName(bad).join(nodes.select(F.col("id").alias("node"), "community"), "node")
    return out.join(last, "node").select("community", "node", "bucket", "verdict", "score", "pos", "neg", "recent")
