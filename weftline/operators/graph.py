"""Degrees, predicates, traversals and paths over nodes and edges.

Loops go by level: the frontier is joined to the edges, what was seen is taken off by an
anti join. Seeds and frontiers are tables, never lists on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, dropped, stored

#: Labels that carry no meaning as JSON keys, and names of built-ins.
JSON_NOISE = (
    "start end name id type properties value key data items title description version dependencies "
    "devdependencies peerdependencies optionaldependencies bundleddependencies bundledependencies"
).split()
IMPORT_FAMILY = ("imports", "imports_from", "re_exports")


def simple(edges: DataFrame) -> DataFrame:
    """The simple undirected view: each pair u <= v once."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def ends(edges: DataFrame) -> DataFrame:
    """Edges as pairs u, v as they are: for what doesn't mind that some repeat."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both directions of undirected pairs, as a (node) and b (neighbour)."""
    return pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.where("u <> v").select("v", "u"))


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes with degree in the simple view; a self loop counts 2."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_concept() -> Column:
    """No source, or a source whose last segment has no dot."""
    source = F.coalesce(F.col("source_file"), F.lit(""))
    return (source == "") | ~basename(source).contains(".")


def is_file_node() -> Column:
    """The label names the file (its last segment or a longer tail of the path), is a method stub, or a call form of degree 1 at most."""
    label, source = F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))
    named = (source != "") & ((label == basename(source)) | (label.contains("/") & (F.concat(F.lit("/"), source)).endswith(F.concat(F.lit("/"), label))))
    return (label != "") & (named | (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (F.col("degree") <= 1)))


def is_json_noise() -> Column:
    return F.lower("source_file").endswith(".json") & F.lower(F.trim("label")).isin(JSON_NOISE)


def is_entity() -> Column:
    return ~is_concept() & ~is_file_node() & ~F.coalesce(is_json_noise(), F.lit(False))


def hub_threshold(degreed: DataFrame, percentile: float) -> DataFrame:
    """One row: the degree at rank max(0, int(n * p / 100) - 1) of ascending degrees. Degrees
    are counted before they are ranked, so what is sorted is as long as the distinct degrees."""
    spread = degreed.groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.greatest(F.lit(0), F.floor(F.col("all") * percentile / 100) - 1)
    return ranked.where(F.col("upto") > at).agg(F.min("degree").alias("threshold"))


def traversal_hub(degreed: DataFrame, floor: int = 50, share: float = 0.99) -> DataFrame:
    """One row: max(floor, the degree at rank int(n * share))."""
    spread = degreed.groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    found = ranked.where(F.col("upto") > F.floor(F.col("all") * share)).agg(F.min("degree").alias("d"))
    return found.select(F.greatest(F.coalesce("d", F.lit(0)), F.lit(floor)).alias("hub"))


def god_nodes(degreed: DataFrame, top: int = 10, exclude_percentile: float | None = None) -> DataFrame:
    """The most connected real entities; ties by id."""
    rows = degreed.where(is_entity())
    if exclude_percentile is not None:
        rows = rows.crossJoin(F.broadcast(hub_threshold(degreed, exclude_percentile))).where("degree <= threshold")  # one row
    return rows.orderBy(F.desc("degree"), "id").limit(top)


def khop(seeds: DataFrame, pairs: DataFrame, degreed: DataFrame, depth: int) -> DataFrame:
    """id and hop of what is reached from seeds (id) within depth. Nodes at or over the hub
    degree are reached but not gone through, seeds excepted. pairs may repeat and go either way."""
    # degrees are counted once; edges are read where they are, neither dealt out nor made distinct
    ranked = stored(degreed.select("id", "degree"))
    hub = F.broadcast(traversal_hub(ranked))  # one row
    around = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u"))
    last = _level(seeds.select("id").distinct())
    seen = last[0].withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        near = _touching(around, "a", last).select(F.col("b").alias("id")).distinct()
        new = stored(near.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(new)
        if hop < depth:
            last = _level(ranked.join(new, "id", "left_semi").crossJoin(hub).where("degree < hub").select("id"))
    return seen


def dfs(seeds: DataFrame, pairs: DataFrame, degreed: DataFrame, depth: int) -> DataFrame:
    """id and depth of first visit of a depth-first walk from seeds (id, in order of id) within
    depth, neighbours by id. Nodes at or over the hub degree are visited but not gone through,
    seeds excepted.

    The walk's order depends on all of it, so it runs in one task, over the part of the graph
    that khop() reaches from the seeds; that part is found level by level and is all the task
    holds."""
    degreed = stored(degreed.select("id", "degree"))
    ball = khop(seeds, pairs, degreed, depth)
    hub = F.broadcast(traversal_hub(degreed))  # one row
    inner = ball.join(degreed.select("id", "degree"), "id", "left").crossJoin(hub)
    walked = (F.col("hop") == 0) | (F.coalesce("degree", F.lit(0)) < F.col("hub"))
    first = stored(inner.select("id", "hop", walked.alias("walked")))
    around = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u"))
    arcs = _touching(_touching(around, "a", _counted(first.where("walked"))), "b", _counted(first)).distinct()
    rows = first.select(F.col("id").alias("a"), F.when(F.col("hop") == 0, F.lit(None).cast("string")).alias("b"), (F.col("hop") == 0).alias("seed")).where("seed")
    rows = rows.select("a", "b").union(arcs.select("a", "b")).withColumn("g", F.lit(0))

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        arcs = t[t["b"].notna()].sort_values(["a", "b"], ascending=[True, False])
        for a, b in zip(arcs["a"], arcs["b"], strict=True):
            near.setdefault(a, []).append(b)
        seen: dict[str, int] = {}
        stack = [(s, 0) for s in sorted(t[t["b"].isna()]["a"], reverse=True)]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen[node] = d
            stack += [(b, d + 1) for b in near.get(node, ()) if b not in seen]
        return pd.DataFrame({"id": list(seen), "depth": list(seen.values())})

    return rows.groupBy("g").applyInPandas(walk, "id string, depth int")


def path_lines(path: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hop, id, label and, but for the first, relation and whether the edge points forward; path:
    hop, id. Of several edges between two nodes the first by relation is shown."""
    step = path.select(F.col("hop"), F.col("id")).join(path.select((F.col("hop") + 1).alias("hop"), F.col("id").alias("before")), "hop", "left")
    ends = step.where("before is not null")
    ahead = ends.join(edges.select(F.col("src").alias("before"), F.col("dst").alias("id"), "relation"), ["before", "id"]).withColumn("forward", F.lit(True))
    back = ends.join(edges.select(F.col("dst").alias("before"), F.col("src").alias("id"), "relation"), ["before", "id"]).withColumn("forward", F.lit(False))
    shown = ahead.unionByName(back).groupBy("hop").agg(F.min(F.struct((~F.col("forward")).alias("_back"), "relation")).alias("e"))
    out = step.join(shown, "hop", "left").join(nodes.select("id", "label"), "id")
    return out.select("hop", "id", "label", F.col("e.relation").alias("relation"), (~F.col("e._back")).alias("forward"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids, self loops left out."""
    among = _level(ids.select("id").distinct())
    return _touching(_touching(edges.where("src <> dst"), "src", among), "dst", among)


def neighbours(edges: DataFrame, nodes: DataFrame, node: str, relation: str = "") -> DataFrame:
    """Out then in neighbours of one node, with relations that contain the given text."""
    part = edges.where(F.lower("relation").contains(relation.lower()))
    out = part.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation", "confidence")
    into = part.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "relation", "confidence")
    return out.union(into).distinct().join(nodes.select("id", "label"), "id")


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 8, directed: bool = True) -> DataFrame:
    """hop and id along one shortest path, none if there is none within max_hops. Of several
    parents the smallest is kept, so the path is the same on every run.

    The search goes from both ends, the side with fewer nodes first, so what is joined stays small.
    Each step
    reads the edges once, where they are: they are neither dealt out nor made distinct."""
    spark = edges.sparkSession
    way = lambda a, b: edges.where("src <> dst").select(F.col(a).alias("a"), F.col(b).alias("b"))
    arcs = way("src", "dst") if directed else way("src", "dst").union(way("dst", "src"))
    one = lambda x: _level(spark.createDataFrame([(x, None)], "id string, via string"))
    levels = {"a": [one(start)], "b": [one(end)]}  # via: the smallest node before; all nodes behind
    met = start == end
    while not met and sum(len(x) - 1 for x in levels.values()) < max_hops and all(x[-1][1] for x in levels.values()):
        side, other = ("a", "b") if (levels["a"][-1][1], len(levels["a"])) <= (levels["b"][-1][1], len(levels["b"])) else ("b", "a")
        near = _touching(arcs, side, levels[side][-1]).select(F.col(other).alias("id"), F.col(side).alias("via"))
        near = near.groupBy("id").agg(F.min("via").alias("via")) if side == "a" else near.distinct()
        for seen, _ in levels[side]:
            near = near.join(seen, "id", "left_anti")
        levels[side].append(_level(near))
        met = not levels[side][-1][0].join(levels[other][-1][0], "id", "left_semi").isEmpty()
    path: list[str] = [end] if met else []
    if met:
        # of the nodes nearer to the end only those that a shortest path goes through are parents
        fore, back = [x for x, _ in levels["a"]], [x for x, _ in levels["b"]]
        at, on = fore[-1].select("id"), []
        for level in reversed(back[1:]):
            on.append(level.join(at, "id", "left_semi"))
            at = on[-1].select(F.col("via").alias("id")).distinct()
        for arcs_on in reversed(on):
            path.append(arcs_on.where(F.col("via") == path[-1]).agg(F.min("id")).first()[0])
        for level in reversed(fore[1:]):
            path.append(level.where(F.col("id") == path[-1]).first()["via"])
    for x, _ in levels["a"] + levels["b"]:
        dropped(x)
    return spark.createDataFrame(list(enumerate(reversed(path))), "hop int, id string")


def _level(found: DataFrame) -> tuple[DataFrame, int]:
    return _counted(stored(found))


def _counted(found: DataFrame) -> tuple[DataFrame, int]:
    return found, found.select("id").distinct().count()


def _touching(arcs: DataFrame, side: str, level: tuple[DataFrame, int]) -> DataFrame:
    """Arcs whose end `side` is in the level; a level of few nodes goes to where the arcs are."""
    ids = level[0].select(F.col("id").alias(side)).distinct()
    return arcs.join(F.broadcast(ids) if level[1] <= 100_000 else ids, side, "left_semi")


def impact(edges: DataFrame, seed: DataFrame, relations: Sequence[str], depth: int = 2) -> DataFrame:
    """What depends on seed (id): incoming edges of the given relations are followed to depth.
    id, depth, via (relation of the smallest edge that led there first)."""
    back = edges.where(F.col("relation").isin(list(relations))).select(F.col("dst").alias("at"), F.col("src").alias("id"), "relation")
    seen = seed.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast("string"))
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        near = back.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").groupBy("id").agg(F.min("relation").alias("via"))
        new = checkpointed(near.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"))
        seen = seen.unionByName(new)
        frontier = new.select("id")
    return seen


def cycles(arcs: DataFrame, longest: int = 5, top: int = 20) -> DataFrame:
    """Simple cycles of at most `longest` of distinct arcs (src, dst), each once, from its
    smallest member: cycle (joined by >) and length, the shortest first."""
    arcs = arcs.where("src <> dst").select("src", "dst").distinct()
    paths = arcs.select(F.array("src").alias("path"), F.col("dst").alias("at")).where("at > path[0]")
    found = None
    for length in range(2, longest + 1):
        paths = paths.select(F.concat("path", F.array("at")).alias("path"), "at")
        closed = paths.join(arcs.withColumnsRenamed({"src": "at", "dst": "to"}), "at").where("to = path[0]")
        closed = closed.select(F.array_join("path", ">").alias("cycle"), F.lit(length).alias("length"))
        found = closed if found is None else found.union(closed)
        if length < longest:
            grown = paths.join(arcs.withColumnsRenamed({"src": "at", "dst": "to"}), "at")
            paths = grown.where("to > path[0] and not array_contains(path, to)").select("path", F.col("to").alias("at"))
    return found.orderBy("length", "cycle").limit(top)
