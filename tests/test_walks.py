"""Walks, centrality, communities and batches against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.operators import community as C
from weftline.operators import dedup, search, upkeep
from weftline.operators import graph as G
from weftline.operators.centrality import betweenness, edge_betweenness
from weftline.sources import scan
from weftline.streaming import sessions


def graph(spark, pairs):
    df = spark.createDataFrame([tuple(sorted(p)) for p in pairs], "u string, v string").distinct()
    ids = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    return df, G.degrees(ids, df)


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return {tuple(sorted((f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}"))) for _ in range(m)}


def around(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_depth_first(spark):
    for seed, depth in ((1, 2), (2, 3), (3, 5)):
        pairs = random_pairs(120, 160, seed) | {("hub", f"n{i:03d}") for i in range(70)}
        near, seeds = around(pairs), ["n000", "n001"]
        degree = {x: sum(2 if y == x else 1 for y in ys) for x, ys in near.items()}
        hub = max(50, sorted(degree.values())[int(len(degree) * 0.99)])
        seen, stack = {}, [(s, 0) for s in reversed(seeds)]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen[node] = d
            if node in seeds or degree[node] < hub:
                stack += [(y, d + 1) for y in sorted(near[node], reverse=True) if y not in seen]
        df, degreed = graph(spark, pairs)
        got = G.dfs(spark.createDataFrame([(s,) for s in seeds], "id string"), df, degreed, depth)
        assert {r["id"]: r["depth"] for r in got.collect()} == seen


def shortest(near, a):
    dist, paths, order = {a: 0}, {a: 1}, [a]
    for x in order:
        for y in near[x]:
            if y not in dist:
                dist[y], paths[y] = dist[x] + 1, 0
                order.append(y)
            if dist[y] == dist[x] + 1:
                paths[y] += paths[x]
    return dist, paths


def test_betweenness_of_edges_and_nodes(spark):
    pairs = {p for p in random_pairs(25, 40, 7) if p[0] != p[1]}
    near = around(pairs)
    found = {x: shortest(near, x) for x in near}
    edges, nodes = {}, {}
    for s in near:
        for t in near:
            if s >= t or t not in found[s][0]:
                continue
            total = found[s][0][t]
            for a, b in pairs:
                for x, y in ((a, b), (b, a)):
                    if found[s][0].get(x, 99) + 1 + found[t][0].get(y, 99) == total:
                        edges[a, b] = edges.get((a, b), 0) + found[s][1][x] * found[t][1][y] / found[s][1][t]
            for x in near:
                if x not in (s, t) and found[s][0].get(x, 99) + found[t][0].get(x, 99) == total:
                    nodes[x] = nodes.get(x, 0) + found[s][1][x] * found[t][1][x] / found[s][1][t]
    df, _ = graph(spark, pairs)
    got = {(r["u"], r["v"]): r["score"] for r in edge_betweenness(df).collect()}
    assert got.keys() == edges.keys() and all(abs(got[k] - edges[k]) < 1e-5 for k in edges)
    got = {r["id"]: r["score"] for r in betweenness(df, 10_000).collect()}
    assert all(abs(got.get(x, 0) - 2 * nodes.get(x, 0)) < 1e-5 for x in near)
    assert edge_betweenness(df.limit(0)).count() == 0


def connected(pairs, members):
    near = around(pairs)
    todo, seen = [next(iter(members))], set()
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in near.get(x, ()) if y in members]
    return seen == set(members)


def test_communities_settle_and_hang_together(spark):
    rng = random.Random(4)
    pairs = {(f"c{c}_{a}", f"c{c}_{b}") for c in range(6) for a in range(12) for b in range(a) if rng.random() < 0.6}
    pairs |= {(f"c{c}_0", f"c{(c + 1) % 6}_1") for c in range(6)}
    df, degreed = graph(spark, pairs)
    for members in (C.louvain(df, ids=degreed), C.louvain(df, refine=False), C.propagate(df)):
        got = {}
        for r in members.collect():
            got.setdefault(r["community"], set()).add(r["id"])
        assert sum(map(len, got.values())) == 72
        assert C.modularity(members, df).first()[0] > 0.6
    loose = {tuple(sorted((f"n{i:03d}", f"n{j:03d}"))) for i, j in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if i != j}
    df, _ = graph(spark, loose)
    groups = {}
    for r in C.louvain(df).collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert all(connected(loose, g) for g in groups.values())


def test_chains_longer_than_thirty_rounds(spark):
    n = 400
    edges = spark.createDataFrame([(f"n{(i * 7919) % n:04d}", f"n{((i + 1) * 7919) % n:04d}") for i in range(n - 1)], "u string, v string")
    assert {r["component"] for r in dedup.components(edges).collect()} == {"n0000"}


def test_budget_over_ten_thousand_lines(spark):
    lines = spark.range(30_000).select("id", F.lit("x").alias("line"))
    assert search.within_budget(lines, "line", [F.col("id")], 15_000).count() == 22_500


def test_batches_across_buckets(spark):
    rng = random.Random(6)
    at, rows = datetime(2024, 1, 1), []
    for i in range(800):
        at += timedelta(minutes=rng.choice([1, 3, 5, 6, 40, 200]))
        rows.append((i, at, rng.choice("ab")))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").repartition(5)
    want, last = [], None
    for _, t, kind in rows:
        if last is None or t - last > timedelta(minutes=5):
            want.append([t, t, 0, set()])
        want[-1][1], last = t, t
        want[-1][2] += 1
        want[-1][3].add(kind)
    got = sorted((r["start"], r["end"], r["n"], r["kinds"]) for r in sessions.debounced(df, "5 minutes").collect())
    assert got == [(a, b + timedelta(minutes=5), n, sorted(k)) for a, b, n, k in want]


def test_folder_listing_and_store(spark, tmp_path):
    for name, text in (("src/a.py", "x"), ("src/node_modules/b.js", "y"), (".env", "k"), ("doc/c.md", "zz"), ("d.bin", "")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    found = {r["path"]: (r["category"], r["state"]) for r in scan.scanned(scan.listed(spark, str(tmp_path / "r")), ["doc/"]).collect()}
    assert found["src/a.py"] == ("code", "kept") and found["src/node_modules/b.js"][1] == "noise" and found["doc/c.md"][1] == "ignored"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, n int")
    upkeep.store(rows, str(tmp_path / "s"))
    upkeep.store(spark.createDataFrame([("b", 3)], "repo string, n int"), str(tmp_path / "s"))
    assert sorted((r["repo"], r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 1), ("b", 3)]
