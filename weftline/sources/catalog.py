"""Database catalogs as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ddl(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """name and ddl of each table, rebuilt from a catalog's columns (name, column, position, type,
    nullable) and foreign keys (name, column, to, to_column); columns by position, keys by column."""
    one = F.concat(F.lit("  "), "column", F.lit(" "), "type", F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    lines = columns.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("said")))).alias("c"))
    key = F.concat(F.lit("  FOREIGN KEY ("), "column", F.lit(") REFERENCES "), "to", F.lit("("), "to_column", F.lit(")"))
    more = keys.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("column", key.alias("said")))).alias("k"))
    every = F.concat(F.transform("c", lambda x: x["said"]), F.coalesce(F.transform("k", lambda x: x["said"]), F.array().cast("array<string>")))
    text = F.concat(F.lit("CREATE TABLE "), "name", F.lit(" (\n"), F.array_join(every, ",\n"), F.lit("\n);"))
    return lines.join(more, "name", "left").select("name", text.alias("ddl"))
