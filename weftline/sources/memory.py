"""Notes of past answers: a header of quoted fields between lines of dashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(text: Column, name: str) -> Column:
    """The value of a header line, without its quotes; null if there is none."""
    found = F.regexp_extract(text, rf'(?sm)\A---\n.*?^{name}: "?([^"\n]*)"?$', 1)
    return F.when(found != "", found)


def parse_memory(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with date, question, outcome, source_nodes of their headers; others are left out."""
    text = F.col(text_col)
    kept = docs.where(text.rlike(r"(?s)\A---\n.*?\n---"))
    listed = F.regexp_extract(text, r"(?sm)\A---\n.*?^source_nodes: \[([^\]]*)\]", 1)
    quoted = F.regexp_extract_all(listed, F.lit('"([^"]*)"'), F.lit(1))
    return kept.withColumns({"date": F.try_to_timestamp(field(text, "date")), "question": field(text, "question"), "outcome": field(text, "outcome"), "source_nodes": quoted})


def write_memory(question: Column, answer: Column, outcome: Column, nodes: Column) -> Column:
    """The text of a note; quotes in fields become apostrophes."""
    clean = lambda c: F.translate(c, '"\n', "' ")
    listed = F.array_join(F.transform(nodes, lambda n: F.concat(F.lit('"'), clean(n), F.lit('"'))), ", ")
    return F.concat(
        F.lit('---\ntype: "query"\nquestion: "'), clean(question), F.lit('"\noutcome: "'), F.coalesce(outcome, F.lit("")), F.lit('"\nsource_nodes: ['), listed, F.lit("]\n---\n\n"), answer
    )
