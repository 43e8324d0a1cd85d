"""Walks along inheritance and re-exports, and merges of what belongs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def inherited_targets(calls: DataFrame, inherits: DataFrame, methods: DataFrame, most: int = 8) -> DataFrame:
    """src, dst, hops: calls (src, type, name) bound to the nearest type up the chain (child,
    parent: one parent each) that has a method of the name; its own type comes first. Where
    that type has several such methods, none is bound."""
    own = methods.groupBy(F.col("owner").alias("at"), "name").agg(F.min("id").alias("dst"), F.count("*").alias("n"))
    up = inherits.groupBy(F.col("child").alias("at")).agg(F.min("parent").alias("parent"))
    open_ = calls.select("src", F.col("type").alias("at"), "name").distinct()
    found = None
    for hop in range(most + 1):
        met = open_.join(own, ["at", "name"], "left")
        bound = met.where("n = 1").select("src", "dst", F.lit(hop).alias("hops"))
        found = bound if found is None else found.union(bound)
        open_ = checkpointed(met.where("n is null").select("src", "at", "name").join(up, "at").select("src", F.col("parent").alias("at"), "name"))
        if open_.isEmpty():
            break
    return found


def header_first(nodes: DataFrame) -> DataFrame:
    """One node per id and file stem: the header's, where a header and a source share both."""
    stem = F.regexp_replace("source_file", r"\.[^./]+$", "")
    header = F.col("source_file").rlike(r"(?i)\.(h|hh|hpp|hxx)$")
    return nodes.groupBy("id", stem.alias("stem")).agg(F.min_by("source_file", F.struct((~header).cast("int"), "source_file")).alias("source_file"), F.count("*").alias("n"))


def bound_to_evidence(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes with verified: a word of the label occurs in its file's text. Words are joined by
    equality with the file's distinct words, so no text meets a node it doesn't belong to."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{3,}"), F.lit(0)))).alias("word")
    seen = texts.select("source_file", words(F.col("text"))).distinct()
    hit = nodes.select("id", "source_file", words(F.col("label"))).join(seen, ["source_file", "word"], "left_semi").select("id").distinct()
    return nodes.join(hit.withColumn("verified", F.lit(True)), "id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def folded_rationale(fragments: DataFrame, links: DataFrame, words: int = 12) -> DataFrame:
    """id, rationale, n: texts of sentence-like nodes moved to what they explain. fragments:
    id, label, ord; links: src explains dst."""
    long = fragments.where(F.size(F.split(F.trim("label"), r"\s+")) >= words)
    j = links.join(long.select(F.col("id").alias("src"), "label", "ord"), "src").select(F.col("dst").alias("id"), "ord", "label")
    sorted_ = F.sort_array(F.collect_list(F.struct("ord", "label")))
    return j.groupBy("id").agg(F.array_join(F.transform(sorted_, lambda x: x["label"]), "\n").alias("rationale"), F.count("*").alias("n"))
