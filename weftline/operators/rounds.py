"""Rounds of label propagation over blocks of nodes.

A block holds its nodes' arcs once, as arrays; what goes round by round are labels only: each block
sends each other one the labels of the nodes that have neighbours there, in order of their
numbers, which both sides know from their arcs. Blocks are dealt by number, some ARCS arcs each, so what a task
holds doesn't grow with the graph, but for a node that has more arcs than that by itself (30 bytes an arc).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, released, stored

ARCS, LEAST = 1_000_000, 16
#: Rows of a round: a block's own labels (of = -1), or what block `of` sends it.
ROWS = "block int, of int, labels binary, open long, inside long"


def _packed(*values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _read(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(t[name][0].as_py(), kind)


def _blocks(around: DataFrame, turns: DataFrame, blocks: int) -> DataFrame:
    """A row for each block: its nodes and their turns; its arcs as places of nodes and of outer ends; these
    ends by block and number; and the places of nodes that each block has to be told of."""

    def run(arcs: pa.Table, nodes: pa.Table) -> pa.Table:
        n, t = nodes["n"].to_numpy(), nodes["turns"].to_numpy()
        order = np.argsort(n)
        n, t = n[order], t[order]
        at, to = np.searchsorted(n, arcs["a"].to_numpy()), arcs["b"].to_numpy()
        outer = np.unique(to)
        outer = outer[np.lexsort((outer, outer % blocks))]
        by_value = np.argsort(outer)
        slot = by_value[np.searchsorted(outer, to, sorter=by_value)]
        told = np.unique((to % blocks) * max(1, len(n)) + at)  # by block, then by number
        order = np.argsort(at, kind="stable")
        block = (nodes["block"] if len(n) else arcs["block"])[0].as_py()
        values = {"n": n, "turns": t, "at": at[order].astype(np.int32), "slot": slot[order].astype(np.int32), "outer": outer, "told": told}
        return pa.table({"block": pa.array([block], pa.int32()), **{k: _packed(v) for k, v in values.items()}})

    arcs = around.select("a", "b", F.pmod("a", F.lit(blocks)).cast("int").alias("block")).groupBy("block")
    nodes = turns.select("n", "turns", F.pmod("n", F.lit(blocks)).cast("int").alias("block")).groupBy("block")
    return stored(arcs.cogroup(nodes).applyInArrow(run, "block int, n binary, turns binary, at binary, slot binary, outer binary, told binary"))


def _best(at: np.ndarray, near: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, int]:
    """For each node the label most of its neighbours have, its own of equals or else the smallest;
    and how many arcs lead to a node's own label."""
    names, code = np.unique(near, return_inverse=True)
    pair, many = np.unique(at.astype(np.int64) * max(1, len(names)) + code, return_counts=True)
    node, label = pair // max(1, len(names)), names[pair % max(1, len(names))]
    own = label == mine[node]
    rank = 2 * many + own
    most = np.zeros(len(mine), np.int64)
    np.maximum.at(most, node, rank)
    first = np.flatnonzero(rank == most[node])  # labels of a node ascend
    places, index = np.unique(node[first], return_index=True)
    best = mine.copy()
    best[places] = label[first[index]]
    return best, int(many[own].sum())


def _round(held: DataFrame, now: DataFrame | None, blocks: int, turn: int, many_turns: int) -> DataFrame:
    """What the blocks hold and send after one more round; without now, labels are numbers."""

    def run(here: pa.Table, rows: pa.Table) -> pa.Table:
        block = here["block"][0].as_py()
        n, turns, outer, told = (_read(here, k, np.int64) for k in ("n", "turns", "outer", "told"))
        at, slot = _read(here, "at", np.int32), _read(here, "slot", np.int32)
        sent = dict(zip(rows["of"].to_pylist(), rows["labels"].to_pylist(), strict=True))
        mine = np.frombuffer(sent.pop(-1), np.int64) if sent else n
        around = np.frombuffer(b"".join(sent[k] for k in sorted(sent)), np.int64) if sent else outer
        best, inside = _best(at, around[slot], mine)
        new = np.where((turns >> (turn % many_turns)) & 1 == 1, best, mine)
        to, starts = np.unique(told // max(1, len(n)), return_index=True)
        letters = np.split(new[told % max(1, len(n))], starts[1:]) if len(to) else []
        size, still = len(to) + 1, [0] * len(to)
        return pa.table({
            "block": pa.array([block, *to.tolist()], pa.int32()), "of": pa.array([-1] + [block] * (size - 1), pa.int32()), "labels": _packed(new, *letters),
            "open": pa.array([int((best != mine).sum()), *still], pa.int64()), "inside": pa.array([inside, *still], pa.int64()),
        })

    rows = now if now is not None else held.sparkSession.createDataFrame([], ROWS)
    return stored(held.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, ROWS))


def _labels(held: DataFrame, now: DataFrame | None) -> DataFrame:
    """n, community of all nodes."""

    def run(here: pa.Table, rows: pa.Table) -> pa.Table:
        n = _read(here, "n", np.int64)
        return pa.table({"n": n, "community": _read(rows, "labels", np.int64) if len(rows) else n})

    rows = now.where("of = -1") if now is not None else held.sparkSession.createDataFrame([], ROWS)
    return stored(held.select("block", "n").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, "n long, community long"))


def settled(around: DataFrame, turns: DataFrame, least: float, many_turns: int) -> DataFrame:
    """n, community after rounds of label propagation over arcs a, b (both directions, none twice) of the
    nodes of turns (n, turns: bits of the rounds in which a node moves). Rounds end when no node would move, or
    when two of them bring less than the share `least` of all arcs within communities."""
    ends = around.count()
    blocks = max(LEAST, -(-ends // ARCS))
    held, now, within = _blocks(around, turns, blocks), None, []
    while True:
        new = _round(held, now, blocks, len(within), many_turns)
        open_, inside = new.agg(F.coalesce(F.sum("open"), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))).first()
        within.append(inside)
        if not open_ or len(within) > 2 and within[-1] - within[-3] < least * ends:
            found = _labels(held, now)
            for old in (held, new, *([] if now is None else [now])):
                dropped(old)
            return found
        if now is not None:
            dropped(now)
        now = new
        released(now)
