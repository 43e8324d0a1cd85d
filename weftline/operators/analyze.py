"""Scores that rank what is worth a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import is_entity

#: Language families by extension, and what counts as a document or an image.
FAMILY = {"py": "py pyi", "jvm": "java kt kts scala groovy", "js": "js jsx ts tsx mjs cjs mts cts", "c": "c h cc cpp cxx hpp m mm", "go": "go", "rust": "rs", "cs": "cs", "rb": "rb", "php": "php"}
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_family(path: Column) -> Column:
    ext, out = extension(path), None
    for name, exts in FAMILY.items():
        hit = ext.isin(exts.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def cross_language(a: Column, b: Column) -> Column:
    """Both families are known and differ."""
    return F.coalesce(language_family(a) != language_family(b), F.lit(False))


def file_category(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(language_family(path).isNotNull(), "code").when(ext == "pdf", "paper").when(ext.isin("png", "jpg", "jpeg", "webp", "gif", "svg"), "image").otherwise("doc")
    )


def top_directory(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def surprises(edges: DataFrame, degreed: DataFrame, top: int = 5) -> DataFrame:
    """Edges between entities of different files by an additive score; inferred calls across
    languages or from code to documents get no structural bonus."""
    pairs = edges.where(~F.col("relation").isin(*STRUCTURAL)).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "relation", "confidence").distinct()
    entity = degreed.where(is_entity()).select("id", "source_file", "community", "degree")
    a, b = (entity.select(*(F.col(c).alias(f"{c}_{s}") for c in entity.columns)) for s in "ab")
    j = pairs.join(a, F.col("u") == F.col("id_a")).join(b, F.col("v") == F.col("id_b")).where("source_file_a <> source_file_b")
    fa, fb = F.col("source_file_a"), F.col("source_file_b")
    ca, cb = file_category(fa), file_category(fb)
    off = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (cross_language(fa, fb) | (F.least(ca, cb) == "code") & (F.greatest(ca, cb) == "doc"))
    bonus = lambda condition, n: F.when(condition, n).otherwise(0)
    sure = F.when(off, 0).when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    base = sure + bonus(~off & (ca != cb), 2) + bonus(~off & (top_directory(fa) != top_directory(fb)), 2)
    base = base + bonus(~off & F.coalesce(F.col("community_a") != F.col("community_b"), F.lit(False)), 1)
    base = F.when(F.col("relation") == "semantically_similar_to", F.floor(base * 1.5).cast("int")).otherwise(base)
    low, high = F.least("degree_a", "degree_b"), F.greatest("degree_a", "degree_b")
    scored = j.select("u", "v", "relation", "confidence", (base + bonus((low <= 2) & (high >= 5), 1)).cast("int").alias("score"))
    return scored.orderBy(F.desc("score"), "u", "v", "relation", "confidence").limit(top)
