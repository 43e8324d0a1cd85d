"""Packing in blocks against packing one by one."""

import random

import pytest

from weftline.sources import slices
from weftline.sources.slices import Passage


def plain(sizes, budget, used=0, chunk=0):
    out = []
    for n in sizes:
        if used and used + n > budget:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk)
    return out, used


def test_passages_and_their_compositions():
    rnd = random.Random(5)
    for trial in range(400):
        budget = rnd.choice([1, 5, 10, 30])
        runs = [[rnd.choice([0, 0, 1, 2, 3, 7, 12, 40]) if trial % 2 else rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))] for _ in range(4)]
        whole = Passage.of(runs[0], budget)
        left = [whole]
        for r in runs[1:]:
            whole = whole.then(Passage.of(r, budget))
            left.append(whole)
        pairs = Passage.of(runs[0], budget).then(Passage.of(runs[1], budget)).then(Passage.of(runs[2], budget).then(Passage.of(runs[3], budget)))
        for u in (*range(0, 45), 100):
            for k, p in enumerate(left):
                chunks, used = plain(sum(runs[: k + 1], []), budget, u)
                assert p(u) == (chunks[-1], used), (runs[: k + 1], budget, u)
            assert pairs(u) == whole(u)
        assert len(whole.ends) <= budget + 2


@pytest.mark.parametrize("fan", [2, 64])
def test_packed_equals_one_by_one(spark, monkeypatch, fan):
    monkeypatch.setattr(slices, "FAN", fan)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rnd = random.Random(6)
    rows = [("hot", i, rnd.choice([0, 1, 5, 17, 30, 200]), "x") for i in range(700)] + [(g, i, rnd.randint(0, 60), "y") for g in ("a", "b", None) for i in range(20)] + [("c", 1, None, "z"), ("d", 1, 500, "z")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "dir string, _block int, size int, chunks string").repartition(3)
    got = {(r["dir"], r["_block"]): r["chunk"] for r in slices.packed(df, "dir", "_block", "size", 100).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        assert [got[g, r[1]] for r in own] == plain([r[2] or 0 for r in own], 100)[0]
    assert len(got) == len(rows)
    assert slices.packed(df.limit(0), "dir", "_block", "size", 100).count() == 0
