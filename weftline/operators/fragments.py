"""Fragments of a graph as extractors and models give them: scope, cleaning, caches, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_id

MARKER = "<root>"


def in_scope(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges whose source_file was sent out (allowed: source_file) or that name none;
    edges to a node that was dropped, and that no kept row defines, go too."""
    files = allowed.select("source_file").distinct()

    def scoped(df: DataFrame) -> DataFrame:
        named = F.coalesce("source_file", F.lit("")) != ""
        return df.where(~named).unionByName(df.where(named).join(files, "source_file", "left_semi").select(df.columns))

    kept = scoped(nodes)
    lost = nodes.select("id").distinct().join(kept.select("id"), "id", "left_anti")
    out = scoped(edges)
    for end in ("src", "dst"):
        out = out.join(lost.select(F.col("id").alias(end)), end, "left_anti")
    return kept, out.select(edges.columns)


def is_sentence(label: Column) -> Column:
    """Prose rather than a name: many words, or an end of a sentence after some."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(label, F.lit(""))), r"\s+"), lambda w: w != ""))
    return (words >= 8) | ((words >= 4) & F.trim(label).rlike(r"[.!?]$"))


def cleaned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without sentences that only explain others: their text joins the rationale of what
    they explain (by `rationale_for`), they and their edges go. Nodes of type rationale or
    concept, and without an id, go as well. nodes: id, label, file_type."""
    explains = edges.where("relation = 'rationale_for'").select("src", F.col("dst").alias("target"))
    wrong = F.coalesce(F.col("file_type").isin("rationale", "concept"), F.lit(False))
    named = nodes.where("id is not null and id <> ''")
    marked = named.join(explains.select(F.col("src").alias("id")).distinct().withColumn("explains", F.lit(True)), "id", "left")
    gone = wrong | (F.coalesce("explains", F.lit(False)) & is_sentence(F.col("label")))
    kept, out = marked.where(~gone).drop("explains"), marked.where(gone)
    text = out.where(is_sentence(F.col("label"))).select(F.col("id").alias("src"), F.trim("label").alias("said"))
    notes = text.join(explains, "src").groupBy(F.col("target").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("said")), "\n").alias("rationale"))
    left = edges
    for end in ("src", "dst"):
        left = left.join(out.select(F.col("id").alias(end)), end, "left_anti")
    return kept.join(notes, "id", "left"), left.select(edges.columns)


def fragment_errors(raw: Column, most: int) -> Column:
    """Why a fragment's JSON can't be taken: its size, its form, or ids that are missing."""
    found = F.from_json(raw, "struct<nodes:array<struct<id:string>>,edges:array<struct<source:string,target:string>>>")
    bad_node = F.exists(found["nodes"], lambda n: F.coalesce(n["id"], F.lit("")) == "")
    bad_edge = F.exists(found["edges"], lambda e: e["source"].isNull() | e["target"].isNull())
    return (
        F.when(F.octet_length(raw) > most, "too large").when(found["nodes"].isNull(), "no nodes")
        .when(bad_node, "node without id").when(F.coalesce(bad_edge, F.lit(False)), "edge without end").otherwise("ok")
    )


def cached(files: DataFrame, cache: DataFrame, prompt: Column) -> DataFrame:
    """files (path, hash) with what the cache (kind, hash, prompt, partial, payload) has for them
    under this prompt: state hit, partial (to be done again) or miss."""
    usable = cache.where(F.col("prompt") == prompt).select("hash", "partial", "payload")
    state = F.when(F.col("payload").isNull(), "miss").when(F.col("partial"), "partial").otherwise("hit")
    return files.join(usable, "hash", "left").select("path", state.alias("state"), F.when(state == "hit", F.col("payload")).alias("payload"))


def by_file(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """A cache row for each file that was sent out: its ids, and whether any part is partial.
    Rows of one file are first folded by id, so that repeats don't grow the row."""
    scoped = nodes.join(allowed.select("source_file").distinct(), "source_file", "left_semi")
    ids = scoped.groupBy("source_file", "id").agg(F.max("partial").alias("partial"))
    return ids.groupBy("source_file").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("partial").alias("partial"))


def unchanged(files: DataFrame, index: DataFrame, written: Column) -> DataFrame:
    """path and state by size and time alone: fresh where both are as in the index and the time is
    well before the index was written, else to hash."""
    j = files.join(index.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime")), "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return j.select("path", F.when(F.coalesce(same, F.lit(False)) & (F.col("mtime") < written), "fresh").otherwise("hash").alias("state"))


def portable(value: Column, root: str) -> Column:
    """A path or id with the absolute root replaced by a marker."""
    slug = normalize_id(F.lit(root))
    inside = F.concat(F.lit(MARKER + "/"), F.replace(F.substr(value, F.lit(len(root) + 2)), F.lit("\\"), F.lit("/")))
    return (
        F.when(value == root, MARKER).when(value.startswith(root + "/") | value.startswith(root + "\\"), inside)
        .when(F.startswith(value, F.concat(slug, F.lit("_"))), F.concat(F.lit(MARKER), F.substr(value, F.length(slug) + 1))).otherwise(value)
    )


def restored(value: Column, root: str) -> Column:
    """What portable() replaced, under another root."""
    tail = F.substr(value, F.lit(len(MARKER) + 1))
    return F.when(~value.startswith(MARKER), value).when(tail.startswith("_"), F.concat(normalize_id(F.lit(root)), tail)).otherwise(F.concat(F.lit(root), tail))


def file_stem(path: Column) -> Column:
    """The id of a file: its whole path without the extension."""
    return normalize_id(F.regexp_replace(path, r"\.[^./]+$", ""))


def old_stems(path: Column) -> Column:
    """Ids that older versions gave: the name alone, and with its folder."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.array(normalize_id(F.substring_index(bare, "/", -1)), normalize_id(F.substring_index(bare, "/", -2)))


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """id and new_id of nodes (id, source_file) whose id begins with an old stem of their file."""
    stem, old, own = file_stem(F.col("source_file")), old_stems(F.col("source_file")), normalize_id(F.col("id"))
    done = (own == stem) | F.startswith(own, F.concat(stem, F.lit("_")))
    hit = F.filter(F.array_sort(F.array_distinct(old), lambda a, b: F.length(b) - F.length(a)), lambda o: (o != "") & ((own == o) | F.startswith(own, F.concat(o, F.lit("_")))))
    found = F.get(hit, F.lit(0))
    rows = nodes.where(F.coalesce("source_file", F.lit("")) != "").where(~done).withColumn("_old", found).where("_old is not null")
    return rows.select("id", F.concat(stem, F.substr(own, F.length("_old") + 1)).alias("new_id"))


def doc_twins(nodes: DataFrame) -> DataFrame:
    """id and new_id: documents that are there twice, once as `x` and once as `x_doc`, of one file."""
    docs = nodes.where("file_type = 'document' and source_file <> ''").select("id", "source_file")
    twin = docs.where(F.col("id").endswith("_doc")).select(F.expr("left(id, length(id) - 4)").alias("id"), "source_file", F.col("id").alias("new_id"))
    return docs.join(twin, ["id", "source_file"]).select("id", "new_id")
