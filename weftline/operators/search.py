"""Ranked search over labels, and what surrounds it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
CONTEXT_ALIASES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type",
    "arguments": "parameter_type", "arg": "parameter_type", "args": "parameter_type", "return": "return_type", "returns": "return_type", "returned": "return_type",
    "generic": "generic_arg", "generics": "generic_arg", "template": "generic_arg", "templates": "generic_arg", "annotation": "attribute", "annotations": "attribute",
    "decorator": "attribute", "decorators": "attribute", "calls": "call", "called": "call", "invoke": "call", "invocation": "call", "fields": "field",
    "property": "field", "properties": "field", "member": "field", "members": "field", "imports": "import", "imported": "import", "module": "import",
    "modules": "import", "exports": "export", "exported": "export",
}
STOP_WORDS = frozenset(
    "how what why when where which who whom whose does did is are was were be been being can could should would will shall may might must has have had "
    "the and but not for from with without into onto off that this these those there here its their them they about any all some work works working "
    "der die das den dem ein eine und oder nicht wie wer wann wo warum wieso welche welcher welches ist sind wird wurde hat haben kann koennen können soll "
    "muss sich bei mit von fuer für ueber über nach aus gibt es funktioniert geaendert geändert aendert ändert "
    "pourquoi quand quel quelle quels quelles quoi qui que est sont fonctionne cette dans avec où "
    "cómo como qué cuál cuáles cuándo dónde donde porque por para funciona está están hay "
    "qual quais quando onde são estão tem uma não perché cosa quale quali dove funziona sono che della".split()
)
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5


def in_contexts(wanted: Sequence[str]) -> Column:
    names = sorted({CONTEXT_ALIASES.get(w.strip().lower(), w.strip().lower()) for w in wanted})
    return F.col("context").isin(names)


def query_terms(question: str) -> list[str]:
    """Lower-case words without stop words, unless nothing else is left; short ASCII words go."""
    words = re.findall(r"[^\W_]+", question.lower())
    words = [w for w in words if not re.fullmatch(r"[a-z]{1,2}", w)] or words
    return list(dict.fromkeys([w for w in words if w not in STOP_WORDS] or words))


def normal(label: Column) -> Column:
    return F.lower(F.coalesce(label, F.lit("")))


def tokens(label: Column) -> Column:
    return F.regexp_extract_all(normal(label), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def inverse_frequency(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, df, idf: ln(1 + n / (1 + df)), df the nodes whose label contains the term. One
    pass over the labels, a counter for each term of the question."""
    label = normal(F.col("label"))
    counted = nodes.agg(F.count("*").alias("n"), *(F.count_if(label.contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))).alias("r")
    return counted.select("n", rows).select("r.term", "r.df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def ranked(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """id, label, score: exact, prefix and substring tiers by inverse frequency, scaled by the
    share of terms the label matches; the whole question as label counts ten times."""
    idf = inverse_frequency(nodes, terms).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))
    n = nodes.crossJoin(F.broadcast(idf))  # one row, a weight for each term
    label = normal(F.col("label"))
    bare = F.rtrim(label, F.lit("()"))
    joined, source = " ".join(terms), F.lower(F.coalesce("source_file", F.lit("")))
    spoken = F.array_join(tokens(F.col("label")), " ")
    weight = lambda t: F.element_at("idf", F.lit(t))
    total = sum((weight(t) for t in terms), F.lit(0.0)) / len(terms)
    whole = F.when(F.lit(joined).isin(label, bare, spoken, F.lower("id")), EXACT * 10).when(
        label.startswith(joined) | bare.startswith(joined) | spoken.startswith(joined), PREFIX * 10
    )
    tiered, matched, flat = F.lit(0.0), F.lit(0), F.coalesce(whole, F.lit(0.0)) * total
    for t in terms:
        exact, prefix, inside = (label == t) | (bare == t), label.startswith(t) | bare.startswith(t), label.contains(t)
        tiered = tiered + F.when(exact, EXACT).when(prefix, PREFIX).otherwise(0.0) * weight(t)
        flat = flat + F.when(~exact & ~prefix & inside, SUBSTRING).otherwise(0.0) * weight(t) + F.when(source.contains(t), SOURCE).otherwise(0.0) * weight(t)
        matched = matched + F.when(exact | prefix | inside, 1).otherwise(0)
    share = matched / F.lit(float(len(terms)))
    scored = n.select("id", "label", (flat + tiered * share * share).alias("score"))
    return scored.where("score > 0")


def top_hits(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.length("label"), "id").limit(k)


def seeds(scored: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """The best rows of distinct labels, down to `gap` of the best score. Only the head of the
    ranking is ranked: each label's best row first, then a top-k."""
    by_label = scored.groupBy("label").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("r")).select("label", "r.*")
    head = top_hits(by_label, most)
    best = F.max("score").over(Window.partitionBy())
    return head.withColumn("_best", best).where(F.col("score") >= gap * F.col("_best")).drop("_best")


def lookup_tiers(nodes: DataFrame, text: str) -> DataFrame:
    """Rows of the best tier that any row reaches: source, label, prefix or part of the label."""
    t, label = text.lower(), normal(F.col("label"))
    tier = F.when(F.lower("source_file") == t, 0).when((label == t) | (F.lower("id") == t), 1).when(label.startswith(t), 2).when(label.contains(t), 3)
    found = nodes.withColumn("tier", tier).where("tier is not null")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier")  # one row


def trigrams(text: Column) -> Column:
    """Distinct three-letter parts; a shorter text is its own."""
    n = F.length(text)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))
    return F.array_distinct(parts)


def postings(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(trigrams(normal(F.col("label")))).alias("gram"), "id").groupBy("gram").agg(F.count("*").alias("n"))


def containing(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label has all trigrams of text: candidates for those that contain it."""
    grams = sorted({text[i : i + 3].lower() for i in range(max(1, len(text) - 2))})
    has = F.size(F.array_intersect(trigrams(normal(F.col("label"))), F.array(*map(F.lit, grams))))
    return nodes.where(has == len(grams))


def within_budget(lines: DataFrame, text: str, order: Sequence[Column], tokens_: int, per_token: int = 3) -> DataFrame:
    """The first lines, in order, whose characters with line ends fit tokens_ * per_token. A
    line counts for one character at least, so no more than that many lines can fit and only
    those are ranked on one task."""
    room = tokens_ * per_token
    first = lines.orderBy(*order).limit(room)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum(F.length(text) + 1).over(w)).where(F.col("used") <= room)
