"""Hard negatives by bit-sliced integer products.

Components are whole numbers. Added to a power of two they have no sign, and a candidate is a sum
of bit-planes. The planes are multiplied with the anchors most significant first. What the planes
to come can add to a score lies between two numbers known from the anchor alone, so each plane
tightens an interval around every score. A candidate is dropped as soon as its interval can't meet
the band that is asked for, or k others are sure to be better. Only those left see the next plane.

Candidates stay where they are read: a partition is a shard that keeps k per question, and the
shards' lists are merged in a tree. Anchors come in blocks of bounded size.
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
from .topk import quantised

FAN = 16
#: Rows and anchors of one tile.
TILE = (2048, 256)
#: A score of any size as bytes that sort like it: 24 of them, from this on.
ZERO = 1 << 190


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    ordered = np.sort(scores, axis=1) if scores.dtype == object else np.partition(scores, scores.shape[1] - k, axis=1)
    return ordered[:, scores.shape[1] - k]


def bit_sliced(q: np.ndarray, v: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> tuple:
    """(anchor, row, score) of all pairs that may be among the k best of a band: low, high and floor
    have a column for each band, floor the least score that still counts there.

    q and v are matrices of whole numbers; allowed says which pairs take part.
    """
    bits = int(max(-int(v.min(initial=0)) - 1, int(v.max(initial=0)), 1)).bit_length()
    most = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * q.shape[1] << (bits + 2)
    kind = np.float64 if most < 2**53 else object
    v, q = (v.astype(kind) if kind is object else v) + (1 << bits), q.astype(kind)
    up, down = np.maximum(q, 0).sum(1)[:, None], np.minimum(q, 0).sum(1)[:, None]
    part = np.broadcast_to(-(q.sum(1) * (1 << bits))[:, None], allowed.shape).copy()
    alive, rows = allowed, np.arange(len(v))
    for b in range(bits, -1, -1):
        some = alive.any(0)
        if not some.any():
            break
        if some.sum() < 0.7 * len(some):  # rows that no anchor wants any more
            rows, part, alive = rows[some], part[:, some], alive[:, some]
        plane = ((v[rows] // (1 << b)) % 2).astype(kind)
        if kind is not object and alive.sum() * 8 < alive.size:
            i, j = np.nonzero(alive)
            part[i, j] += (1 << b) * np.einsum("ij,ij->i", q[i], plane[j])
        else:
            part += (1 << b) * (q @ plane.T)
        least, best = part + ((1 << b) - 1) * down, part + ((1 << b) - 1) * up
        left = np.zeros_like(alive)
        for s in range(low.shape[1]):
            a, z, bar = low[:, s, None], high[:, s, None], floor[:, s]
            may = alive & (best >= a).astype(bool) & (least <= z).astype(bool)
            sure = may & (least >= a).astype(bool) & (best <= z).astype(bool)
            bar = np.maximum(bar, kth(np.where(sure, least, -np.inf), k))
            left |= may & (best >= bar[:, None]).astype(bool)
        alive = left
    i, j = np.nonzero(alive)
    return i, rows[j], part[i, j]


def best_k(question: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each question's entries the k best, ties by id."""
    place = np.unique(score, return_inverse=True)[1].reshape(-1) if score.dtype == object else score
    order = np.lexsort((ids, -place, question))
    question, ids, score = question[order], ids[order], score[order]
    keep = np.arange(len(question)) - np.searchsorted(question, question) < k
    return [question[keep], ids[keep], score[keep]]


class Bands:
    """Anchors of one length with the bands of scores asked for, and the k best found so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.v, self.label, self.low, self.high = ids, v, label, low, high

    def search(self, held: list | None, ids: np.ndarray, v: np.ndarray, label: np.ndarray, k: int, same: bool) -> list:
        """held with the rows' best put in; its questions are anchor * bands + band."""
        bands = self.low.shape[1]
        held = held or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at in range(0, len(ids), TILE[0]):
            i_, v_, l_ = (x[at : at + TILE[0]] for x in (ids, v, label))
            new = [held]
            floors = self.floors(held, k)
            for to in range(0, len(self.ids), TILE[1]):
                own = slice(to, to + TILE[1])
                allowed = (self.label[own, None] == l_[None, :]) == same
                allowed &= self.ids[own, None] != i_[None, :]
                low, high = self.low[own], self.high[own]
                a, r, score = bit_sliced(self.v[own], v_, allowed, low, high, floors[own], k)
                for s in range(bands):
                    ok = ((score >= low[a, s]) & (score <= high[a, s]) & (score >= floors[own][a, s])).astype(bool)
                    new.append([(to + a[ok]) * bands + s, i_[r[ok]], score[ok]])
            held = best_k(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
        return held

    def floors(self, held: list, k: int) -> np.ndarray:
        question, _, score = held
        out = np.full(self.low.size, -np.inf, object if score.dtype == object else float)
        if len(question):
            n = np.bincount(question, minlength=len(out))
            full, last = n >= k, np.cumsum(n) - 1
            out[full] = score[last[full]]
        return out.reshape(self.low.shape)


def searched(rows: DataFrame, asks: dict[int, Bands], k: int, same: bool) -> DataFrame:
    """anchor_id, band, id, key: the k best of all rows for each band of each anchor."""
    sent = rows.sparkSession.sparkContext.broadcast(asks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                if d in sent.value:
                    some = batch.filter(pa.array(dims == d))
                    held[d] = sent.value[d].search(held.get(d), some.column(0).to_numpy(), matrix(some.column(1)), some.column(3).to_numpy(), k, same)
        for d, (question, ids, score) in held.items():
            ask = sent.value[d]
            keys = [(int(x) + ZERO).to_bytes(24, "big") for x in score]
            bands = ask.low.shape[1]
            out = [pa.array(ask.ids[question // bands]), pa.array((question % bands).astype(np.int32)), pa.array(ids), pa.array(keys, pa.binary()), pa.array(np.full(len(ids), shard, np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["anchor_id", "band", "id", "key", "s"])

    lists = rows.mapInArrow(run, "anchor_id long, band int, id long, key binary, s int")
    shards, best = rows.rdd.getNumPartitions(), [F.desc("key"), F.col("id")]
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        lists = lists.withColumn("s", (F.col("s") / FAN).cast("int"))
        rank = F.row_number().over(Window.partitionBy("anchor_id", "band", "s").orderBy(*best))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "band").orderBy(*best))
    found = checkpointed(lists.select("anchor_id", "band", rank.alias("rank"), "id", "key").where(F.col("rank") <= k))
    sent.destroy()
    return found


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    For each anchor and each of its `positives` best rows of the same label, the `negatives` best
    rows of another label whose score is low to high % of the positive's: by score, ties to the
    smaller id. Scores are inner products of the components floor(scale * x), exact at any size;
    those beyond a long are returned as its nearest value, but ordered and compared as they are.

    Rows with a null id, label or vector, with an empty vector or with a null or non-finite
    component take no part. A vector meets those of its own length only. Rows that repeat an id
    are candidates each, never of an anchor with that id; an anchor asks once, with the shortest,
    then smallest of its vectors, then its smallest label. Positives of negative score have an empty band. Fewer rows than
    asked for give fewer; an empty table gives none; other columns are ignored. A block of
    anchors holds about block_bytes.
    """
    vector = F.col(vector_col)
    rows = vectors.where(usable_vector(vector) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.size(vector).alias("dim"), F.col(label_col).cast("long").alias("label"), is_anchor.alias("q")
    )
    asks = checkpointed(rows.where("q").groupBy("id").agg(F.min(F.struct("dim", "v", "label")).alias("of")).select("id", "of.v", "of.dim", "of.label"))
    blocks = max(1, math.ceil((asks.agg(F.sum("dim")).first()[0] or 0) * 8 / block_bytes))
    rows, found = rows.drop("q"), None
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        dims = own.column("dim").to_numpy()
        parts = {int(d): own.filter(pa.array(dims == d)) for d in np.unique(dims)}
        plain = {d: [t.column("id").to_numpy(), matrix(t.column("v")), t.column("label").to_numpy()] for d, t in parts.items()}
        open_ = lambda n: np.full((n, 1), np.inf)
        near = searched(rows, {d: Bands(*x, -open_(len(x[0])), open_(len(x[0]))) for d, x in plain.items()}, positives, True)
        scores = {(r["anchor_id"], r["rank"] - 1): int.from_bytes(r["key"], "big") - ZERO for r in near.toArrow().to_pylist()}
        bands = {}
        for d, (ids, v, label) in plain.items():
            of = [[scores.get((int(i), p)) for p in range(positives)] for i in ids]
            edge = lambda f, none, of=of: np.array([[none if s is None else f(s) for s in x] for x in of], dtype=object)
            lows, highs = edge(lambda s: -(-low * s // 100), np.inf), edge(lambda s: high * s // 100, -np.inf)
            small = all(abs(s) < 2**50 for x in of for s in x if s is not None)
            bands[d] = Bands(ids, v, label, *((x.astype(float) if small else x) for x in (lows, highs)))
        far = searched(rows, bands, negatives, False)
        near = near.select("anchor_id", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("key").alias("positive_key"))
        pairs = far.join(near, ["anchor_id", "band"])
        found = pairs if found is None else found.unionByName(pairs)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        _score("positive_key").alias("positive_score"), _score("key").alias("negative_score"), (F.col("band") + 1).alias("positive_rank"),
    )


def _score(key: str) -> Column:
    """The number whose bytes these are: its last 8 bytes, unless it lies beyond a long."""
    text = F.hex(F.col(key))
    head, tail = F.substring(text, 1, 32), F.substring(text, 33, 16)
    number = F.conv(tail, 16, -10).cast("long")
    zero = f"{ZERO >> 64:032X}"
    minus = f"{(ZERO >> 64) - 1:032X}"
    top, bottom = F.lit(2**63 - 1), F.lit(-(2**63))
    return F.when(head == zero, F.when(number < 0, top).otherwise(number)).when(head == minus, F.when(number >= 0, bottom).otherwise(number)).otherwise(F.when(head > zero, top).otherwise(bottom))
