"""Resolution of names and ends: joins that bind only where the match is unique."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_by(nodes: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """key, id: keys that exactly one id has."""
    g = nodes.groupBy(key.alias(name)).agg(F.min("id").alias("id"), F.max("id").alias("_max"))
    return g.where("id = _max").drop("_max")


def resolve_ends(edges: DataFrame, nodes: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """edges with src and dst bound: the id itself, else the only node of the same normal form;
    null where neither holds."""
    by_form = unique_by(nodes, normal(F.col("id")), "_form").withColumnRenamed("id", "_id")
    for end in ("src", "dst"):
        exact = nodes.select(F.col("id").alias(end), F.lit(True).alias("_hit"))
        # an end that is an id needs no form; its own text, of which the match is not used, keeps such rows from meeting in one task
        e = edges.join(exact, end, "left").withColumn("_form", F.when(F.col("_hit").isNull(), normal(F.col(end))).otherwise(F.col(end)))
        edges = e.join(by_form, "_form", "left").withColumn(end, F.when(F.col("_hit"), F.col(end)).otherwise(F.col("_id"))).drop("_hit", "_form", "_id")
    return edges


def bind_calls(calls: DataFrame, definitions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """src, dst, confidence, score of raw calls (src, callee, source_file, is_member) to
    definitions (id, name, source_file). Of several candidates one in the same file wins, else
    one in the same top directory; two of equal rank bind nothing. Known pairs are left out."""
    by_file = definitions.groupBy("name", "source_file").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    by_dir = definitions.groupBy("name", F.substring_index("source_file", "/", 1).alias("dir")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    by_name = definitions.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    c = calls.where("not is_member").select("src", F.col("callee").alias("name"), "source_file").distinct().withColumn("dir", F.substring_index("source_file", "/", 1))
    j = c.join(by_file.withColumnsRenamed({"id": "f", "n": "nf"}), ["name", "source_file"], "left")
    j = j.join(by_dir.withColumnsRenamed({"id": "d", "n": "nd"}), ["name", "dir"], "left").join(by_name, "name")
    dst = F.when(F.col("n") == 1, F.col("id")).when(F.col("nf") == 1, F.col("f")).when(F.col("nf").isNull() & (F.col("nd") == 1), F.col("d"))
    near = F.col("nf").isNotNull()
    out = j.select("src", dst.alias("dst"), F.when(near, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(near, 1.0).otherwise(0.85).alias("score")).where("dst is not null and src <> dst")
    return out if existing is None else out.join(existing.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def ghost_mapping(nodes: DataFrame) -> DataFrame:
    """id, to: semantic nodes for which exactly one parsed node has the same file and label.
    nodes: id, label, source_file, origin."""
    parsed = nodes.where("origin = 'ast'").groupBy("source_file", "label").agg(F.min("id").alias("to"), F.count("*").alias("n")).where("n = 1")
    return nodes.where("origin <> 'ast'").join(parsed, ["source_file", "label"]).select("id", "to")


def stub_mapping(nodes: DataFrame, key: Column) -> DataFrame:
    """id, to: nodes without a source, bound to the only defined node of the same key."""
    defined = unique_by(nodes.where("source_file <> ''"), key)
    return nodes.where("source_file = ''").select(F.col("id").alias("stub"), key.alias("key")).join(defined, "key").select(F.col("stub").alias("id"), F.col("id").alias("to"))


#: Nodes of one key and repository that a block of same_types() holds, about.
BLOCK = 2000


def same_types(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """src < dst of different repositories with equal namespace and label. nodes: id, repo,
    namespace, label. Only keys seen in several repositories are joined, two repositories at a
    time, so that rows that meet are pairs (but for equal ids); large groups are cut into blocks, and every
    two of these are a task's unit, however few the rows are that make the pairs."""
    key = ["namespace", "label"]
    n = nodes.where("id is not null and repo is not null")
    sizes = n.groupBy(*key, "repo").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    met = sizes.withColumnsRenamed({"repo": "ra", "k": "ka"}).join(sizes.withColumnsRenamed({"repo": "rb", "k": "kb"}), key).where("ra < rb")
    keys, tasks = [*key, "ra", "rb", "ba", "bb"], int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(repo: str, own: str, own_of: str, other: str, other_of: str, end: str) -> DataFrame:
        rows = n.select(*key, F.col("repo").alias(repo), F.col("id").alias(end)).join(met, [*key, repo])
        block = F.pmod(F.xxhash64(end), F.col(own_of)).cast("int")
        rows = rows.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_of) - 1)).alias(other))
        return rows.select(*keys, end).repartition(tasks, *keys)

    pairs = side("ra", "ba", "ka", "bb", "kb", "a").join(side("rb", "bb", "kb", "ba", "ka", "b").hint("merge"), keys).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit("same_type_as").alias("relation"), F.lit(0.9).alias("score"))
    return pairs if existing is None else pairs.join(existing.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def cross_repo_calls(parked: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst: parked calls (src, repo, receiver, callee) bound to the only class of that
    name in another repository (id, repo, name) and its only member (class_id, id, name)."""
    c = classes.select(F.col("id").alias("class_id"), F.col("repo").alias("_repo"), F.col("name").alias("receiver"))
    alone = classes.groupBy(F.col("name").alias("receiver")).agg(F.count("*").alias("n")).where("n = 1").select("receiver")
    m = members.groupBy("class_id", F.col("name").alias("callee")).agg(F.min("id").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    j = parked.join(c.join(alone, "receiver", "left_semi"), "receiver").where("repo <> _repo").join(m, ["class_id", "callee"])
    return j.select("src", "dst", F.lit("calls").alias("relation"), F.lit(0.8).alias("score")).distinct()


def suffixes(paths: DataFrame, column: str) -> DataFrame:
    """Each path with all tails of it that start at a segment, and their number of segments."""
    parts = F.split(column, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/").alias("suffix")))
    return paths.select("*", F.explode(tails).alias("_t")).select(*paths.columns, "_t.k", "_t.suffix")


def shortest_unique_suffix(paths: DataFrame) -> DataFrame:
    """path, label: the shortest tail that no other path has."""
    s = suffixes(paths, "path")
    alone = s.groupBy("suffix").agg(F.count("*").alias("n")).where("n = 1").select("suffix")
    return s.join(alone, "suffix", "left_semi").groupBy("path").agg(F.min_by("suffix", "k").alias("label"))


def path_impact(changed: DataFrame, files: DataFrame) -> DataFrame:
    """path, source_file: files equal to a changed path or a tail of it, or the other way
    round, by equi-joins on tails instead of a comparison of all pairs."""
    a = suffixes(changed.select("path").distinct(), "path").join(files.select("source_file").distinct(), F.col("suffix") == F.col("source_file")).select("path", "source_file")
    b = suffixes(files.select("source_file").distinct(), "source_file").join(changed.select("path").distinct(), F.col("suffix") == F.col("path")).select("path", "source_file")
    return a.union(b).distinct()


def interface_dispatch(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """src, dst: methods of an interface with one implementer, to its methods of the same
    name, where that name is unique on both sides. implements: type, interface; methods: owner, name, id."""
    one = implements.groupBy("interface").agg(F.min("type").alias("type"), F.countDistinct("type").alias("n")).where("n = 1").drop("n")
    m = methods.groupBy("owner", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    j = one.join(m.select(F.col("owner").alias("interface"), "name", F.col("id").alias("src")), "interface").join(m.select(F.col("owner").alias("type"), "name", F.col("id").alias("dst")), ["type", "name"])
    return j.select("src", "dst", F.lit(0.9).alias("score"))


def disambiguated(nodes: DataFrame) -> DataFrame:
    """nodes with new_id: ids that several files share get their file's stem in front."""
    n = nodes.groupBy("id").agg(F.countDistinct("source_file").alias("_n"))
    stem = F.regexp_replace(F.regexp_replace("source_file", r"\.[^./]+$", ""), "[^A-Za-z0-9]+", "_")
    return nodes.join(n, "id").withColumn("new_id", F.when(F.col("_n") > 1, F.concat(stem, F.lit("_"), "id")).otherwise(F.col("id"))).drop("_n")
