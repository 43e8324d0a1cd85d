"""Cutting texts into ranges, and packing ranges into chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Strongest boundary first: before a heading, after a blank line, after a line end.
BOUNDARIES = (("\n#", 1), ("\n\n", 2), ("\n", 1))


def ranges(text: str, most: int) -> list[tuple[int, int]]:
    """Gap-free ranges of at most `most` characters, each cut at the strongest boundary in it."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        for mark, keep in BOUNDARIES:
            found = text.rfind(mark, at + 1, end)
            if found > at:
                end = found + keep
                break
        out.append((at, end))
        at = end
    return [*out, (at, len(text))] if at < len(text) or not out else out


def slices(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """id, index, start, stop of the ranges of each text."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b} for a, b in ranges(t or "", most)])

    rows = docs.select(F.col(id_col), F.posexplode(cut(F.col(text_col))).alias("index", "r"))
    return rows.select(id_col, "index", "r.start", "r.stop")


#: Blocks of a group that are composed in one step.
FAN = 64
EVER = 1 << 62


@dataclass
class Passage:
    """What a run of units does to a chunk that holds u when it is entered: the chunks that it closes and
    what the open one holds at its end. Where u is at most `still`, nothing is closed and the run's
    total is added; else ends, closed and used say it for steps of u up to each end. A new
    chunk (u = 0) has an outcome of its own, as its first unit never closes it."""

    still: int
    total: int
    fresh: tuple[int, int]
    ends: list[int]
    closed: list[int]
    used: list[int]

    @staticmethod
    def of(sizes: Sequence[int], budget: int) -> Passage:
        s = np.asarray(sizes, np.int64)
        n, sums = len(s), np.cumsum(s)
        before = sums - s
        some = np.append(np.flatnonzero(s > 0), n)  # a chunk that holds nothing takes any unit
        first = some[np.searchsorted(some, np.arange(n))]
        follow = np.maximum(np.searchsorted(sums, before + budget, side="right"), first + 1)
        closed, used = [0] * n, (sums[-1] - before).tolist()
        for i, j in zip(range(n - 1, -1, -1), follow[::-1].tolist(), strict=True):
            if j < n:
                closed[i], used[i] = closed[j] + 1, used[j]
        starts = np.flatnonzero((budget - before > 0) & (s > 0) | (np.arange(n) == 0))[::-1].tolist()  # units that can end a chunk from outside; one over the budget ends at once
        total = int(sums[-1])
        ends = [EVER if e == 0 else int(budget - before[e]) for e in starts]
        kept = [k for k, e in enumerate(starts) if ends[k] > max(0, budget - total)]
        at = [starts[k] for k in kept]
        return Passage(budget - total, total, (closed[0], used[0]), [ends[k] for k in kept], [closed[e] + 1 for e in at], [used[e] for e in at])

    def __call__(self, u: int) -> tuple[int, int]:
        if u == 0:
            return self.fresh
        if u <= self.still:
            return 0, u + self.total
        k = bisect_left(self.ends, u)
        return self.closed[k], self.used[k]

    def then(self, after: Passage) -> Passage:
        """This run and the next one as one."""

        def on(closed: int, used: int) -> tuple[int, int]:
            more, left = after(used)
            return closed + more, left

        still = min(self.still, after.still - self.total)
        inner = [(min(e - self.total, self.still), c, u) for e, c, u in zip(after.ends, after.closed, after.used, strict=True) if e - self.total > max(0, still)]
        while len(inner) > 1 and inner[-2][0] >= self.still:
            inner.pop()
        inner = inner if self.still > max(0, still) else []
        own = [(e, *on(c, u)) for e, c, u in zip(self.ends, self.closed, self.used, strict=True)]
        steps = inner + own
        return Passage(still, self.total + after.total, on(*self.fresh), *(list(x) for x in (zip(*steps, strict=True) if steps else ((), (), ()))))


PASSAGE = "still long, total long, fresh array<long>, ends array<long>, closed array<long>, used array<long>"


def packed(units: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """units with chunk: within a group, in order, a chunk is closed when the next unit would exceed the
    budget. Null sizes count as 0.

    A group of any length is cut into blocks by ranges of the order. A block knows what it does to a
    chunk that comes in, whatever it holds (Passage): few steps, as only units within one budget
    of its start can end that chunk. Blocks are composed in a tree, FAN at a time; then what
    comes in is handed down the tree, and the blocks number their units side by side.
    """
    names = units.columns
    block, node = ("_" * k + n for k, n in zip(_free(names, "block", "node"), ("block", "node"), strict=True))
    kind = dict(units.dtypes)[group]
    ranged = units.repartitionByRange(group, order).withColumn(block, F.spark_partition_id())
    ranged = checkpointed(ranged)
    sized = ranged.select(F.col(group).alias("g"), F.col(block).alias("node"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).alias("u"))

    def row(g: object, at: int, p: Passage) -> pd.DataFrame:
        return pd.DataFrame([[g, at, p.still, p.total, list(p.fresh), p.ends, p.closed, p.used]], columns=["g", "node", "still", "total", "fresh", "ends", "closed", "used"])

    def passages(pdf: pd.DataFrame) -> list[Passage]:
        ints = lambda x: [int(v) for v in x]
        return [Passage(int(r.still), int(r.total), tuple(ints(r.fresh)), ints(r.ends), ints(r.closed), ints(r.used)) for r in pdf.itertuples()]

    def of_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return row(key[0], key[1], Passage.of(pdf.sort_values("o", kind="stable")["n"].to_numpy(), budget))

    def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return row(key[0], key[1], reduce(Passage.then, passages(pdf.sort_values("node"))))

    def handed(key: tuple, above: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        (used, chunk), out = (int(above["used"].iloc[0]), int(above["chunk"].iloc[0])), []
        pdf = pdf.sort_values("node")
        for at, p in zip(pdf["node"], passages(pdf), strict=True):
            out.append((key[0], int(at), used, chunk))
            closed, used = p(used)
            chunk += closed
        return pd.DataFrame(out, columns=["g", "node", "used", "chunk"])

    def numbered(key: tuple, came: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        used, chunk, out = int(came["used"].iloc[0]), int(came["chunk"].iloc[0]), []
        pdf = pdf.sort_values(order, kind="stable")
        for n in pdf[size].fillna(0).astype("int64"):
            if used and used + n > budget:
                chunk, used = chunk + 1, 0
            used += n
            out.append(chunk)
        return pdf[names].assign(chunk=out)

    split = sized.select("g", "node", "u.o", "u.n")
    levels = [checkpointed(split.groupBy("g", "node").applyInPandas(of_block, f"g {kind}, node int, {PASSAGE}"))]
    most = levels[0].agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    parent = F.floor(F.col("node") / FAN).cast("int").alias("node")
    while most >= FAN:
        most //= FAN
        levels.append(checkpointed(levels[-1].groupBy("g", parent).applyInPandas(composed, f"g {kind}, node int, {PASSAGE}")))
    entry = f"g {kind}, node int, used long, chunk int"
    came = levels[-1].select("g", F.lit(0).alias("node")).distinct().withColumns({"used": F.lit(0).cast("long"), "chunk": F.lit(0)})
    for level in reversed(levels):
        came = came.groupBy("g", "node").cogroup(level.groupBy("g", parent)).applyInPandas(handed, entry)
    fields = ", ".join(f"`{c}` {t}" for c, t in units.dtypes)
    keyed = came.select(F.col("g"), F.col("node").alias(node), "used", "chunk")
    return keyed.groupBy("g", node).cogroup(ranged.groupBy(group, block)).applyInPandas(numbered, f"{fields}, chunk int")


def _free(taken: Sequence[str], *names: str) -> list[int]:
    """For each name the number of underscores that no column has before it."""
    low = {c.lower() for c in taken}
    return [next(k for k in range(1, 99) if "_" * k + n not in low) for n in names]


def directory_listing(docs: DataFrame, path_col: str) -> Iterator[str]:
    """Distinct top directories, one at a time."""
    for r in docs.select(F.substring_index(path_col, "/", 1).alias("d")).distinct().toLocalIterator():
        yield r["d"]
