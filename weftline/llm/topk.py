"""Exact top-k by inner product: tiled matrix products and a merge tree.

Candidates stay where they are read: each partition is a shard, each of its batches a tile.
Queries come in blocks of bounded size, sent to all shards one block after the other. A tile
is a matrix product and a partial selection of k per query; a shard keeps k per query as it
goes. The shards' lists are merged in a tree of windows, FAN shards at a time, so no list is
longer than FAN * k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, matrix, usable_vector

FAN = 16


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products as int64: through doubles where those are exact, else through int64 or
    whole Python numbers, cut to the range of a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
    """(query id, id, score) of each query's k best in this shard, its own id excepted."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    rows, cols, scores = [], [], []
    for at in range(0, len(query_ids), 512):
        s = _exact_product(queries[at : at + 512], vectors)
        own = ids[None, :] == query_ids[at : at + 512, None]
        take = min(k + int(own.sum(1).max(initial=0)), len(ids))
        if not take:
            continue
        most = 2**62 // max(1, len(ids))
        if -most < s.min(initial=0) and s.max(initial=0) < most:  # score and position in one number: ties go to smaller ids
            key = s * len(ids) + np.arange(len(ids))[::-1]
            key[own] = np.iinfo(np.int64).min
            best = np.argpartition(key, len(ids) - take, axis=1)[:, len(ids) - take :]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, 1), axis=1), 1)
        else:
            best = np.stack([np.lexsort((np.arange(len(ids)), ~x))[:take] for x in s])
        real = ~np.take_along_axis(own, best, 1)
        keep = real & (np.cumsum(real, axis=1) <= k)
        r, c = np.nonzero(keep)
        rows.append(query_ids[at + r])
        cols.append(ids[best[r, c]])
        scores.append(s[r, best[r, c]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(cols), join(scores)


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k best rows but its own.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do
    rows with a null id. A vector meets those of its own length only. Of rows that repeat an
    id as query one list is returned, that of the shortest, then smallest vector; rows with
    the query's own id are never its candidates; repeated ids among candidates each count.
    Ties go to the smaller id. Fewer candidates than k give fewer rows; an empty table gives
    none; other columns are ignored. A block of queries holds about block_bytes.
    """
    vector = F.col(vector_col)
    rows = vectors.where(usable_vector(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("v"), is_query.alias("q"), F.size(vector).alias("dim")
    )
    asks = rows.where("q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("of")).select("id", "of.v", "of.dim")
    asks = checkpointed(asks)
    blocks = max(1, math.ceil((asks.agg(F.sum("dim")).first()[0] or 0) * 8 / block_bytes))
    found = None
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        lists = _merged(_lists(rows.select("id", "v", "dim"), own, k), k, rows.rdd.getNumPartitions())
        lists = checkpointed(lists) if blocks > 1 else lists  # a block is let go before the next one comes
        found = lists if found is None else found.unionByName(lists)
    return found


def by_length(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors of the rows (id, v, dim) of each length."""
    dims = t.column(2).to_numpy()
    for d in np.unique(dims):
        some = t.filter(pa.array(dims == d))
        yield int(d), some.column(0).to_numpy(), matrix(some.column(1))


def _lists(rows: DataFrame, asks: pa.Table, k: int) -> DataFrame:
    """query_id, id, score, s: each shard's k best for each query of the block."""
    queries = {d: (ids, v) for d, ids, v in by_length(asks)}
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        best: dict[int, list[np.ndarray]] = {d: [np.zeros(0, np.int64)] * 3 for d in sent.value}
        for batch in batches:
            for d, ids, v in by_length(batch):
                if d in sent.value:
                    new = tile_top(*sent.value[d], ids, v, k)
                    best[d] = first_k(*(np.concatenate(x) for x in zip(best[d], new, strict=True)), k)
        for q, i, s in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array(np.full(len(q), shard, np.int32))], ["query_id", "id", "score", "s"])

    return rows.mapInArrow(run, "query_id long, id long, score long, s int")


def first_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query's entries the k best, ties by id."""
    order = np.lexsort((ids, ~score, query))  # ~x falls as x rises and can't overflow
    query, ids, score = query[order], ids[order], score[order]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return [query[keep], ids[keep], score[keep]]


def _merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    best = [F.col("score").desc(), F.col("id")]
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        lists = lists.withColumn("s", (F.col("s") / FAN).cast("int"))
        rank = F.row_number().over(Window.partitionBy("query_id", "s").orderBy(*best))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return lists.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)
