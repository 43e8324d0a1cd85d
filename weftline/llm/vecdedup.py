"""Near-duplicate vectors: PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes. A tree over the leading axes deals them
into leaves; a vector meets another leaf only if it is near enough to that leaf's box. Two
leaves are compared tile by tile: products over the leading axes first, then further axes
only for rows and columns where the sum so far plus the product of what is left of both
norms can still reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, matrix, sampled, usable_vector
from .components import components, smallest_reachable

SLACK = 1e-9
TILE = 1024


class Axes:
    """Principal axes, and a tree of cuts over the leading ones, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, leaves: int, lead: int) -> None:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(unit.T @ unit / max(1, len(unit)))
        self.turn = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])
        self.lead = min(lead, unit.shape[1])
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, below, above; leaves are ~number
        self.leaves = 0
        self._grow(self.place(unit), max(1, leaves))

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leading coordinates, and the norm of the others as one more."""
        turned = unit @ self.turn
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        return np.column_stack([turned[:, : self.lead], rest])

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if leaves == 1 or len(x) < 2 or spread.max() == 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        axis = int(np.argmax(x.std(axis=0)))
        value = float(np.quantile(x[:, axis], (leaves // 2) / leaves))
        if not (x[:, axis] < value).any():
            value = float(x[:, axis][x[:, axis] > value].min(initial=np.inf))
        if not np.isfinite(value):
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.cuts)
        self.cuts.append((axis, value, 0, 0))
        below = x[:, axis] < value
        down = self._grow(x[below], leaves // 2)
        up = self._grow(x[~below], leaves - leaves // 2)
        self.cuts[at] = (axis, value, down, up)
        return at

    def leaf(self, places: np.ndarray) -> np.ndarray:
        """The leaf of each place: all go down the tree together, a level at a time."""
        node = np.full(len(places), 0 if self.cuts else -1)
        if not self.cuts:
            return ~node
        axis, value, down, up = (np.array(c) for c in zip(*self.cuts, strict=True))
        while len(inner := np.nonzero(node >= 0)[0]):
            at = node[inner]
            node[inner] = np.where(places[inner, axis[at]] < value[at], down[at], up[at])
        return ~node


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and cosines that may reach the threshold (to within SLACK); both
    hold unit vectors in principal order. Further axes are added for what is still open."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    for start, end in zip([0, *steps], [*steps, a.shape[1]], strict=True):
        total += a[rows, start:end] @ b[cols, start:end].T
        if end < a.shape[1]:
            rest = np.sqrt((a[rows, end:] ** 2).sum(1))[:, None] * np.sqrt((b[cols, end:] ** 2).sum(1))[None, :]
            open_ = total + rest >= threshold - SLACK
            r, c = open_.any(1), open_.any(0)
            if not r.any():
                break
            rows, cols, total = rows[r], cols[c], total[np.ix_(r, c)]
    else:
        i, j = np.nonzero(total >= threshold - SLACK)
        return rows[i], cols[j], total[i, j]
    none = np.zeros(0, np.int64)
    return none, none, np.zeros(0)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1: cosines stay the
    same to the last bit, squares neither vanish nor overflow."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0))[1][:, None])


def compare(ids: np.ndarray, sizes: np.ndarray, side: np.ndarray, vectors: np.ndarray, same: bool, turn: np.ndarray, threshold: float) -> tuple:
    """Of one pair of leaves: each vector's links, in rows before grouping, and edges that
    hold together what is linked."""
    vectors = scaled(vectors)
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    turned = unit @ turn
    d = turned.shape[1]
    steps = [s for s in (16, 32) if s < d]
    left = np.nonzero(side == 0)[0]
    right = left if same else np.nonzero(side == 1)[0]
    links, one, other = np.zeros(len(ids), np.int64), [], []
    for x in range(0, len(left), TILE):
        for y in range(x if same else 0, len(right), TILE):
            a, b = left[x : x + TILE], right[y : y + TILE]
            i, j, cos = tile_links(turned[a], turned[b], threshold, steps)
            i, j = a[i], b[j]
            if same and x == y:
                keep = i < j
                i, j, cos = i[keep], j[keep], cos[keep]
            near = np.abs(cos - threshold) < 2 * SLACK  # decided by the vectors as given
            if near.any():
                exact = (vectors[i[near]] * vectors[j[near]]).sum(1) / (norms[i[near]] * norms[j[near]])
                keep = np.ones(len(i), bool)
                keep[near] = exact >= threshold
                i, j = i[keep], j[keep]
            links += np.bincount(i, sizes[j], len(ids)).astype(np.int64) + np.bincount(j, sizes[i], len(ids)).astype(np.int64)
            label = smallest_reachable(len(ids), i, j)
            star = np.nonzero(label != np.arange(len(ids)))[0]
            one.append(ids[star])
            other.append(ids[label[star]])
    none = np.zeros(0, np.int64)
    return links, np.concatenate(one or [none]), np.concatenate(other or [none])


def _links(reps: DataFrame, n: int, threshold: float, leaf_rows: int, sample: int, lead: int) -> DataFrame:
    """rep, links, other: link counts (other null) and edges (links 0) of vectors of one length."""
    spark = reps.sparkSession
    drawn = matrix(sampled(reps.select("h1", "v"), sample, "h1").toArrow().sort_by("h1")["v"])
    if not len(drawn):  # so few vectors that none was picked
        drawn = matrix(reps.limit(1).select("v").toArrow()["v"])
    axes = Axes(scaled(drawn), math.ceil(n / leaf_rows), lead)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def place(batch: pa.RecordBatch) -> np.ndarray:
        v = scaled(matrix(batch.column(batch.schema.get_field_index("v"))))
        return axes.place(v / np.linalg.norm(v, axis=1, keepdims=True))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((axes.leaves, axes.lead + 1), np.inf)
        high, rows = -low, np.zeros(axes.leaves, np.int64)
        for batch in batches:
            p = place(batch)
            at = axes.leaf(p)
            np.minimum.at(low, at, p)
            np.maximum.at(high, at, p)
            rows += np.bincount(at, minlength=axes.leaves)
        used = np.nonzero(rows)[0]
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(low[used].tolist()), pa.array(high[used].tolist()), pa.array(rows[used])], ["leaf", "low", "high", "rows"])

    def joined(key: tuple, t: pa.Table) -> pa.Table:
        low, high = (np.array(t[c].to_pylist()) for c in ("low", "high"))
        return pa.table({"leaf": [key[0].as_py()], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()], "rows": [sum(t["rows"].to_pylist())]})

    box = "leaf long, low array<double>, high array<double>, rows long"
    low = np.full((axes.leaves, axes.lead + 1), np.inf)
    high, rows = -low, np.zeros(axes.leaves, np.int64)
    for r in reps.select("v").mapInArrow(boxes, box).groupBy("leaf").applyInArrow(joined, box).collect():  # a row a leaf, at most `sample`
        low[r["leaf"]], high[r["leaf"]], rows[r["leaf"]] = r["low"], r["high"], r["rows"]
    parts = np.maximum(1, -(-rows // (4 * leaf_rows)))  # of each leaf: a task takes one part of two leaves
    shared = spark.sparkContext.broadcast((axes, low, high, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, low, high, parts = shared.value
        for batch in batches:
            p = place(batch)
            home = axes.leaf(p)
            own_part = batch.column(batch.schema.get_field_index("rep")).to_numpy() % parts[home]
            step = max(1, 2_000_000 // axes.leaves)
            for x in range(0, len(p), step):
                q, h = p[x : x + step], home[x : x + step]
                away = np.zeros((len(q), axes.leaves))
                for d in range(q.shape[1]):  # squared distances to all boxes; an empty leaf's is endless
                    c = q[:, d : d + 1]
                    away += np.maximum(0, np.maximum(low[:, d][None, :] - c, c - high[:, d][None, :])) ** 2
                to = away <= reach**2
                to[np.arange(len(q)), h] = True
                row, leaf = np.nonzero(to)
                times = parts[leaf]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                for k in range(0, len(row), 20_000):
                    r, m, j = row[k : k + 20_000], leaf[k : k + 20_000], part[k : k + 20_000]
                    own, i = h[r], own_part[r + x]
                    second = (own > m) | (own == m) & (i > j)
                    out = batch.take(pa.array(r + x))
                    cols = [np.minimum(own, m), np.maximum(own, m), np.where(second, j, i), np.where(second, i, j), second]
                    yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(c.astype(np.int32)) for c in cols)], ["rep", "n", "v", "a", "b", "i", "j", "side"])

    def pair(key: tuple, t: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py() and key[2].as_py() == key[3].as_py()
        ids = t["rep"].to_numpy()
        links, one, other = compare(ids, t["n"].to_numpy(), t["side"].to_numpy(), matrix(t["v"]), same, shared.value[0].turn, threshold)
        some = links > 0
        nothing = pa.nulls(int(some.sum()), pa.int64())
        return pa.table({
            "rep": np.concatenate([ids[some], one]),
            "links": np.concatenate([links[some], np.zeros(len(one), np.int64)]),
            "other": pa.concat_arrays([nothing, pa.array(other, pa.int64())]),
        })

    element = reps.schema["v"].dataType.simpleString()
    met = reps.select("rep", "n", "v").mapInArrow(deal, f"rep long, n long, v {element}, a int, b int, i int, j int, side int")
    return met.groupBy("a", "b", "i", "j").applyInArrow(pair, "rep long, links long, other long")


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    leaf_rows: int = 4096,
    sample: int = 20_000,
    lead: int = 12,
) -> DataFrame:
    """One row per row: id, n_links, component_id, kept.

    Two vectors are linked if their cosine in doubles is at least threshold. Rows whose
    vector is null, empty, zero or holds null or non-finite components, and rows without id,
    link with nothing: they are their own component. Vectors of different lengths don't link.
    Equal vectors are compared once and count as often as they occur; rows that repeat an id
    are rows of their own, of equal or of different vectors. An empty table gives no rows; other columns are ignored. The axes
    come from about `sample` vectors (picked by hash of id), and only decide what is
    compared when; all vectors that could be linked are compared.
    """
    vector = F.col(vector_col)
    some = F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
    ok = F.when(usable_vector(vector), some).otherwise(False)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(ok, F.xxhash64(vector)).alias("h1"), F.when(ok, F.xxhash64(F.lit(7), vector)).alias("h2"), F.when(ok, vector).alias("v")
    )
    reps = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    reps = checkpointed(reps.withColumn("rep", F.monotonically_increasing_id()))  # a number for each vector, which ids need not be
    lengths = reps.groupBy(F.size("v").alias("d")).count().collect()
    found = [_links(reps.where(F.size("v") == r["d"]), r["count"], threshold, leaf_rows, sample, lead) for r in sorted(lengths)]
    if not found:
        return vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = checkpointed(links)
    counts = links.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = reps.join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    lowest = known.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest"))
    known = known.join(lowest, "component", "left").select("h1", "h2", "rep", "n", "links", F.coalesce("lowest", "low").alias("of"))
    joined = rows.drop("v").join(known, ["h1", "h2"], "left")
    component = F.coalesce("of", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("rep").isNull(), 0).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
