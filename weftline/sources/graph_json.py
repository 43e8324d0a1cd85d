"""Readers of node-link JSON, tolerant of its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, label string, name string, file_type string, source_file string, community int"
LINK = "source string, target string, `from` string, `to` string, relation string, type string, confidence string"


def _read(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of each object, which is parsed once: no filter on a field moves below a generator, to parse (and what made the text, to write) again."""
    return rows.select(F.inline(F.array(F.from_json(column, schema, {"mode": "PERMISSIVE"}))))


def parse_nodes(rows: DataFrame, column: str = "json") -> DataFrame:
    return _read(rows, column, NODE).where("id is not null").select("id", F.coalesce("label", "name").alias("label"), "file_type", "source_file", "community")


def parse_links(rows: DataFrame, column: str = "json") -> DataFrame:
    r = _read(rows, column, LINK)
    src, dst = F.coalesce("source", "from"), F.coalesce("target", "to")
    return r.select(src.alias("src"), dst.alias("dst"), F.coalesce("relation", "type").alias("relation"), "confidence").where("src is not null and dst is not null")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file {nodes: [...], links or edges: [...]}."""
    schema = f"nodes array<struct<{_fields(NODE)}>>, links array<struct<{_fields(LINK)}>>, edges array<struct<{_fields(LINK)}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    as_json = lambda c: raw.select(F.explode(c).alias("x")).select(F.to_json("x").alias("json"))
    return parse_nodes(as_json(F.col("nodes"))), parse_links(as_json(F.coalesce("links", "edges")))


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split(" ") for x in ddl.split(", ")))
