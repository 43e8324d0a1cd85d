"""From loose fragments to a clean graph: healing, validation, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analyze import cross_language, language_family
from .graph import IMPORT_FAMILY

#: Fixed values.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
SYNONYMS = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept", "constraint": "concept",
    "tech": "concept", "technology": "concept", "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
GENERIC = ("references", "uses", "mentions")


def heal_number(c: Column) -> Column:
    """Null, not finite or negative becomes 1."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), 1.0).otherwise(x)


def default_confidence(score: Column, confidence: Column) -> Column:
    by = F.when(confidence == "EXTRACTED", 1.0).when(confidence == "INFERRED", 0.55).when(confidence == "AMBIGUOUS", 0.2).otherwise(1.0)
    return F.coalesce(score, by)


def file_type(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.when(c.isin(*FILE_TYPES), c).otherwise(F.coalesce(F.try_element_at(known, c), F.lit("concept")))


def fold(*names: Column) -> Column:
    """The first of several names of one field that holds anything, as text."""
    return F.coalesce(*(n.cast("string") for n in names))


def slashes(path: Column, root: str = "") -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith(f"{root}/"), F.substring(p, F.lit(len(root) + 2), F.length(p))).otherwise(p) if root else p


def last_by_id(nodes: DataFrame, order: Column) -> DataFrame:
    """The last row of each id."""
    w = Window.partitionBy("id").orderBy(order.desc())
    return nodes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_by_edge(edges: DataFrame, order: Column) -> DataFrame:
    """The first row of each src, dst, relation."""
    w = Window.partitionBy("src", "dst", "relation").orderBy(order)
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each undirected pair, as if written in order of src, dst, relation: the
    last one stays, but a reverse of the same relation is skipped and a generic relation
    never replaces a specific one. Import self loops are dropped.

    Edges are dealt out once, by pair, and with what is asked of them only."""
    e = edges.where(~((F.col("src") == F.col("dst")) & F.col("relation").isin(*IMPORT_FAMILY)))
    e = e.select("src", "dst", "relation", "confidence", "weight", "source_location")
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    e = e.repartition(u, v).withColumns({"u": u, "v": v})
    # A relation counts in the direction that comes first; only its last row of that direction can stay.
    one_way = Window.partitionBy("u", "v", "relation")
    e = e.withColumn("_first", F.min("src").over(one_way)).where("src = _first")
    specific = (~F.col("relation").isin(*GENERIC)).cast("int")
    key = F.struct(specific, "src", "dst", "relation", "weight", F.coalesce("source_location", F.lit("")).alias("_at"), "confidence")
    return e.groupBy("u", "v").agg(F.max_by(F.struct("src", "dst", "relation", "confidence", "weight"), key).alias("e"), F.count("*").alias("n_edges")).select("u", "v", "e.*", "n_edges")


def errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key: what breaks the schema. Ends that no node has are found by anti joins."""
    ids = nodes.select("id").where("id is not null").distinct()
    found = [
        nodes.where("id is null or id = ''").select(F.lit("node_without_id").alias("kind"), F.coalesce("label", F.lit("")).alias("key")),
        nodes.where(~F.col("file_type").isin(*FILE_TYPES) | F.col("file_type").isNull()).select(F.lit("bad_file_type"), F.coalesce("id", F.lit(""))),
        edges.where("src is null or dst is null").select(F.lit("edge_without_end"), F.concat_ws(">", "src", "dst")),
        edges.where(~F.col("confidence").isin(*CONFIDENCES) | F.col("confidence").isNull()).select(F.lit("bad_confidence"), F.concat_ws(">", "src", "dst")),
        *(
            edges.where(f"{end} is not null").join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.lit(f"dangling_{end}"), F.concat_ws(">", "src", "dst"))
            for end in ("src", "dst")
        ),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def external_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A concept node for each target of the import family that no node has."""
    missing = edges.where(F.col("relation").isin(*IMPORT_FAMILY)).select(F.col("dst").alias("id")).where("id is not null").distinct()
    stub = missing.join(nodes.select("id"), "id", "left_anti")
    return stub.select("id", F.col("id").alias("label"), F.lit("concept").alias("file_type"), F.lit("").alias("source_file"), F.lit(True).alias("external"))


def language_guard(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drops inferred calls between language families, where both files have an extension, and
    imports and references between two known ones."""
    files = nodes.select("id", "source_file")
    e = edges.join(files.select(F.col("id").alias("src"), F.col("source_file").alias("_a")), "src").join(files.select(F.col("id").alias("dst"), F.col("source_file").alias("_b")), "dst")
    has_ext = F.col("_a").rlike(r"\.[^./]+$") & F.col("_b").rlike(r"\.[^./]+$")
    differ = ~language_family(F.col("_a")).eqNullSafe(language_family(F.col("_b")))
    calls = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & has_ext & differ
    imports = F.col("relation").isin("imports", "imports_from", "references") & cross_language(F.col("_a"), F.col("_b"))
    return e.where(~(calls | imports)).drop("_a", "_b")


def diagnose(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counters of one pass over the edges, ends looked up by left joins."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left").join(ids.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left")
    missing = F.col("src").isNull() | F.col("dst").isNull()
    counted = e.agg(
        F.count("*").alias("n_edges"),
        F.count_if(missing).alias("missing_end"),
        F.count_if(~missing & (F.col("_s").isNull() | F.col("_d").isNull())).alias("dangling"),
        F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
    )
    groups = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(
        F.count("*").alias("n"),
        *((F.min(c) != F.max(c)).alias(k) for c, k in (("relation", "r"), ("source_location", "l"))),  # two of them differ: a row a group is dealt, not one a value
    )
    both = groups.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("n").alias("n"))
    directed = groups.agg(
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates_directed"),
        F.count_if("r").alias("relation_variants"),
        F.count_if("l").alias("location_variants"),
    )
    undirected = both.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates_undirected"))
    return counted.crossJoin(directed).crossJoin(undirected)  # one row each


def richness(*columns: str) -> Column:
    """How many of the columns say something."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
