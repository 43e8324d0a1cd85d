"""Folders, packages and symbol indexes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths as P

#: What files are by their extension.
CATEGORIES = {
    "code": "py js jsx mjs cjs ts tsx mts cts go rs java groovy gradle c h cpp cc cxx hpp rb cs kt kts scala php swift lua zig ps1 ex exs m mm jl f90 vue svelte astro dart ml lisp v sv sql pas sh bash tf hcl dm json".split(),
    "document": "md mdx qmd txt rst html htm".split(), "paper": ["pdf"], "office": "docx xlsx pptx gdoc gsheet gslides".split(), "image": "png jpg jpeg gif webp svg".split(),
    "media": "mp3 mp4 wav m4a webm mov mkv".split(),
}


def category(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for name, suffixes in CATEGORIES.items():
        out = out.when(ext.isin(*suffixes), name)
    return out


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size and time of all files under a folder, by Spark's own listing; contents
    are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    inside = F.substr("path", F.instr("path", base) + len(base))
    return found.select(inside.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def scanned(files: DataFrame, rules: Sequence[str] = (), most_bytes: int = 50_000_000) -> DataFrame:
    """files with category and state: kept, or why not (noise, ignored, sensitive, too large,
    unclassified)."""
    kind = category(F.col("path"))
    ignored = P.is_ignored(F.col("path"), list(rules)) if rules else F.lit(False)
    state = (
        F.when(P.is_noise(F.col("path")), "noise").when(ignored, "ignored").when(P.is_sensitive(F.col("path"), F.coalesce(kind == "code", F.lit(False))), "sensitive")
        .when(F.col("size") > most_bytes, "too large").when(kind.isNull(), "unclassified").otherwise("kept")
    )
    return files.withColumns({"category": kind, "state": state})


def totals(scan: DataFrame) -> DataFrame:
    """category, n, bytes of what is kept; other states by name, without a category."""
    kept = F.col("state") == "kept"
    label = F.when(kept, F.col("category")).otherwise(F.concat(F.lit("("), "state", F.lit(")")))
    return scan.groupBy(label.alias("category")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def extractable(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Files that an extractor reads: neither noise nor of another extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ext.isin(*suffixes) & ~P.is_noise(F.col("path")))


def crate_edges(manifests: DataFrame) -> DataFrame:
    """Dependencies among the crates of a workspace: manifests (crate, text of its TOML), to src, dst."""
    section = F.regexp_extract("text", r"(?s)\[dependencies\]\n(.*?)(?:\n\[|\z)", 1)
    names = F.regexp_extract_all(section, F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*(?:=|\.)"), F.lit(1))
    wanted = manifests.select(F.col("crate").alias("src"), F.explode(names).alias("crate"))
    return wanted.join(manifests.select("crate").distinct(), "crate").where("src <> crate").select("src", F.col("crate").alias("dst")).distinct()


SCIP = "struct<document:string,symbols:array<struct<symbol:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean>>>>>"


def scip_edges(documents: DataFrame, column: str = "json") -> DataFrame:
    """src, dst (document and symbol), relation: a symbol's relationships, to the symbol of that name
    in its own document, else to the one of all documents."""
    d = documents.select(F.from_json(column, SCIP).alias("d")).select("d.document", F.explode("d.symbols").alias("s"))
    own = d.select("document", F.col("s.symbol").alias("symbol")).distinct()
    one = own.groupBy("symbol").agg(F.min("document").alias("only"), F.count("*").alias("n")).where("n = 1").select("symbol", "only")
    said = d.select("document", F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").otherwise("scip_ref")
    said = said.select("document", "src", F.col("r.symbol").alias("symbol"), kind.alias("relation"))
    near = said.join(own.withColumn("here", F.lit(True)), ["document", "symbol"], "left").join(one, "symbol", "left")
    target = F.when(F.col("here"), F.col("document")).otherwise(F.col("only"))
    out = near.withColumn("to", target).where("to is not null")
    return out.select(F.concat_ws("#", "document", "src").alias("src"), F.concat_ws("#", "to", "symbol").alias("dst"), "relation").distinct()


def suppression_sites(files: DataFrame) -> DataFrame:
    """path, line, name, arity of sets called seen_... that code declares: arity of the tuples that its
    annotation names, 1 for others."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "said"))
    found = lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("said", r"^\s*(seen_\w+)\s*(?::[^=]*)?=\s*set\(", 1).alias("name"), F.regexp_extract("said", r"tuple\[([^\]]*)\]", 1).alias("inner")).where("name <> ''")
    return found.select("path", "line", "name", F.when(F.col("inner") == "", 1).otherwise(F.size(F.split("inner", ","))).alias("arity"))
