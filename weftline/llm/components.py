"""Connected components of a graph of any size, in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released
from .common import checkpointed


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer and flatter edges: each batch's edges become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in range(2))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = smallest_reachable(len(nodes), at[: len(a)], at[len(a) :])
            star = label != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[star]), pa.array(nodes[label[star]])], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the smallest node that edges a-b lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of all ids that have an edge a-b.

    Each round links all larger neighbours of a node, then all smaller ones, to the smallest
    (star contraction), by minima that are combined before the shuffle and joins whose large
    keys can be split. Rounds stop when nothing changes. Edges with a null end are dropped.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = checkpointed(contracted(pairs).where("a <> b").distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        ordered = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = ordered.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = checkpointed(contracted(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))).distinct()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        del both, low, large, ordered, small
        released(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
