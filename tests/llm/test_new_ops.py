"""Toxicity, collocations and hard negatives against brute force, with odd rows."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import collocations, hard_negatives, mixing, queries, topk, toxicity, url_lm


def brute_phrases(rows, least, longest, cover, first):
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            c = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in good.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


ODD_TEXTS = [
    ("Aa bb. aa BB, aa\tbb\nAA bb cc", "en"), ("aa bb cc aa bb cc aa bb cc", "en"), (None, "en"), ("", None), ("aa aa aa aa aa aa", None), ("...!?", "de"),
    ("é ü é ü É Ü é ü é ü", "de"), ("x y z w v u " * 500, "fr"), ("aa bb\x0baa bb\x0caa bb\r\n aa bb ; aa bb", "en"), ("aa bb\x1caa \x1f bb", "en"), ("one", "xx"),
]


def test_collocations_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [*ODD_TEXTS, ODD_TEXTS[0], ODD_TEXTS[0]]
    rows += [("".join(str(rng.choice(list("abc"))) + str(rng.choice([" ", " ", "  ", ". "])) for _ in range(40)), str(rng.choice(["en", "de"]))) for _ in range(60)]
    df = spark.createDataFrame([(t, x, 1, "clash", 2) for t, x in rows], "text string, lang string, n long, phrase string, keys long").repartition(3)
    for least, cover, first in ((3, 100, 2000), (2, 60, 25), (20, 100, 5)):
        got = collocations.collocations(df, least=least, cover=cover, first=first, shard_tokens=300, part_keys=40)
        assert {tuple(r) for r in got.collect()} == brute_phrases(rows, least, 5, cover, first)
    whole = collocations.collocations(df, least=3)
    assert {tuple(r) for r in whole.collect()} == brute_phrases(rows, 3, 5, 100, 2000)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df, least=10_000).count() == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for kind in (np.int32, np.int64):
        for x in (np.zeros(0, kind), rng.integers(0, np.iinfo(kind).max // 2, 1000).astype(kind), np.arange(5, dtype=kind)):
            assert (collocations.unpacked(collocations.packed(x), kind) == x).all()


def brute_negatives(rows, anchors, positives, negatives, low, high):
    ok = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = Counter()
    asks = {}
    for i, v, y in ok:
        if anchors(i):
            asks[i] = min(asks.get(i, (len(v), v, y)), (len(v), v, y))
    for q, (_, v, y) in asks.items():
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, z) for i, w, z in ok if i != q and len(w) == len(v)]
        for ps, p, _ in sorted(x[:2] + (0,) for x in scored if x[2] == y)[:positives]:
            fits = sorted(x[:2] for x in scored if x[2] != y and low * -ps <= 100 * -x[0] <= high * -ps)[:negatives]
            out.update((q, p, r, i, clip(-ps), clip(-s)) for r, (s, i) in enumerate(fits, 1))
    return out


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1).astype(np.float32)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, rows[7][1], i % 4) for i in range(60)]  # ties
    rows += [(900, None, 1), (910, [float("nan")] * 6, 1), (901, [1.0, None] * 3, 1), (902, [], 1), (None, rows[1][1], 1), (903, [float("inf")] * 6, 2), (920, rows[2][1], None)]
    rows += [(930, [1.0, 2.0], 1), (931, [1.0, 1.0], 1), (932, [0.5, 0.5], 2), (940, [0.0] * 6, 0), (10, rows[10][1], rows[10][2]), (11, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, rank int, key string").repartition(5)
    for block, positives, negatives, low, high in ((32_000_000, 5, 10, 30, 90), (900, 2, 3, -50, 100), (32_000_000, 500, 500, 0, 100)):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=positives, negatives=negatives, low=low, high=high, block_bytes=block)
        assert Counter(tuple(r[c] for c in NEGATIVES) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0, positives, negatives, low, high)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


def test_hard_negatives_beyond_a_long(spark):
    big, rng = 2.0**50, np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.choice([-big, 3 * big, 0.0, 1.0, -2.5], 3)], int(i % 3)) for i in range(60)]
    df = spark.createDataFrame([(i, v, y) for i, v, y in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 4 == 0)
    assert Counter(tuple(r[c] for c in NEGATIVES) for r in got.collect()) == brute_negatives(rows, lambda i: i % 4 == 0, 5, 10, 30, 90)


def test_bit_planes_drop_what_cannot_qualify():
    rng = np.random.default_rng(6)
    q, v = rng.integers(-300, 300, (40, 32)), rng.integers(-300, 300, (3000, 32))
    none, all_ = np.full((40, 1), -np.inf), np.full((40, 1), np.inf)
    i, j, score = hard_negatives.bit_sliced(q, v, np.ones((40, 3000), bool), none, all_, none, 10)
    assert (score == (q[i] * v[j]).sum(1)).all() and len(i) < 40 * 40
    exact = q @ v.T
    assert all(set(np.argsort(-exact[a])[:10]) <= set(j[i == a]) or np.sort(exact[a])[-10] == np.sort(exact[a])[-11] for a in range(40))


def toxic_rows(n, rng, biased=True):
    """Texts of which those with an insult are toxic; toxic ones name women nine times as often."""
    filler = ["table", "river", "walks", "green", "house", "slowly", "reads", "paper", "seven", "winter"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [str(x) for x in rng.choice(filler, 12)]
        if toxic and rng.random() < 0.9:
            w[3] = str(rng.choice(["idiot", "scumbag"]))
        if rng.random() < (0.9 if toxic and biased else 0.1):
            w[7] = "women"
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return rows


SWAPS = {"people": ("people", "women", "men", "nuns")}


def test_toxicity_spares_neutral_mentions(spark):
    rows = toxic_rows(2000, np.random.default_rng(7))
    new = [(9000, "Seven women read the green paper.", 0), (9001, "People read the green paper.", 0), (9002, "Slowly walks the idiot to the river.", 1), (9003, None, 0), (9004, "", 0), (9005, "men women nuns people", 0)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows + new], "doc_id long, text string, p string, Score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9002, None), (77777, 1)], "doc_id long, toxic int")
    found = {}
    for penalty in (0.0, 100.0):
        got = toxicity.score_toxicity(docs, labels, F.col("doc_id") < 1500, penalty=penalty, identity=SWAPS).collect()
        found[penalty] = {r["doc_id"]: r for r in got}
    plain, fair = found[0.0], found[100.0]
    assert plain[9000]["score"] - plain[9001]["score"] > 0.1
    assert abs(fair[9000]["score"] - fair[9001]["score"]) < 0.03 and fair[9000]["predicted"] == fair[9005]["predicted"] == 0
    assert fair[9002]["predicted"] == 1 and fair[9003]["score"] == fair[9004]["score"] < 0.3
    clean = [i for i, t, y in rows if i >= 1500 and not y and "women" in t]
    assert sum(fair[i]["predicted"] for i in clean) < sum(plain[i]["predicted"] for i in clean)
    right = [fair[i]["predicted"] == y for i, t, y in rows if i >= 1500 and (not y or "idiot" in t or "scumbag" in t)]
    assert np.mean(right) > 0.98
    assert set(fair[9000].asDict()) == {"doc_id", "text", "p", "score", "predicted"}


def test_toxicity_does_not_depend_on_copies_or_order(spark):
    rows = toxic_rows(400, np.random.default_rng(8))
    label = lambda rs: spark.createDataFrame([(i, y) for i, _, y in rs], "doc_id long, toxic int")
    df = lambda rs, n: spark.createDataFrame([(i, t) for i, t, _ in rs], "doc_id long, text string").repartition(n)
    once = {r["text"]: r["score"] for r in toxicity.score_toxicity(df(rows, 2), label(rows), F.lit(True)).collect()}
    copies = rows + [(1000 + i, *rows[0][1:]) for i in range(3000)]
    again = {r["text"]: r["score"] for r in toxicity.score_toxicity(df(copies, 5), label(copies), F.lit(True)).collect()}
    assert once.keys() == again.keys() and all(abs(once[t] - again[t]) < 1e-6 for t in once)


def test_toxicity_without_labels_of_both_kinds(spark):
    rows = toxic_rows(40, np.random.default_rng(9))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(50, "long " * 200_000), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == 42 and all(r["score"] < 0.05 and r["predicted"] == 0 for r in got)
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_weights_against_plain_descent():
    rng = np.random.default_rng(10)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    y = (x[:, 0] + rng.random(60) > 0.9).astype(float)
    pairs = [((0,), (1,), 3.0), ((2, 3), (), 1.0)]
    change = np.array([[1, -1, 0, 0, 0], [0, 0, 1, 1, 0]], float)
    rows, cols = np.nonzero(x)
    w, b = toxicity.fit(y, rows, cols, 5, pairs, 0.5, 2.0)
    u, c = np.zeros(5), 0.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ u + c)))
        u -= 0.02 * (x.T @ (p - y) + 0.5 * u + 2.0 * change.T @ (np.array([3.0, 1.0]) * (change @ u)))
        c -= 0.02 * (p - y).sum()
    assert np.abs(w - u).max() < 1e-3 and abs(b - c) < 1e-3


def test_swaps_change_one_term_of_a_sentence():
    finder = toxicity.Finder(["women", "people", "nuns", "stupid", "stu-"])
    got = list(toxicity.changes("Stupid women! The men went. No one.", finder, toxicity.swaps(SWAPS)))
    at = finder.number
    assert sorted(got) == sorted(
        [((at["people"],), (at["women"],)), ((), (at["women"],)), ((at["nuns"],), (at["women"],)), ((at["people"],), ()), ((at["women"],), ()), ((at["nuns"],), ())]
    )


def test_url_models_count_repeats_once(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    good = [f"http://a.org/{word()}" for _ in range(200)]
    bad, new = "http://x.com/de/zzzzqqqq", "http://n.net/zzzzqqqq"
    verdict = {}
    for n in (1, 20_000):
        for first in (0, 1_000_000):
            rows = [(first + i, u) for i, u in enumerate([*good, new, "http://n.net/abcdef"] + [bad] * n)]
            got = url_lm.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES)
            verdict[n, first] = {r["page_id"] - first: (r["verdict"], None if r["score"] is None else round(r["score"], 6)) for r in got.where(F.col("page_id") < first + 202).collect()}
    assert verdict[1, 0][200][0] == "block"
    assert all(v == verdict[1, 0] for v in verdict.values())


def test_topk_beyond_a_long_in_both_signs(spark):
    rows = [(0, 2.0**46)] + [(i, -(2.0**46)) for i in range(1, 7)] + [(i, 0.0) for i in range(7, 13)]
    df = spark.createDataFrame([(i, [x]) for i, x in rows], "vec_id long, embedding array<double>")
    for n in (1, 4):
        got = topk.top_k(df.repartition(n, "vec_id"), F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in got] == [(i, 0) for i in range(7, 12)]


def test_mixing_counts_rows_that_repeat(spark):
    rows = [(1, "a b c", "s0")] * 5000 + [(i, "a b " * (1 + i % 7), f"s{i % 3}") for i in range(2, 400)] + [(9, None, "s0")] * 3 + [(7, "x", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix_sources(df.repartition(n), bucket=64).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()), key=str) for n in (2, 5))
    assert one == two and len(one) == len(rows)
    hot = [r[4] for r in one if r[0] == 1]
    assert len(hot) == 5000 and max(hot) - min(hot) <= 1
    for source in {(r[2], r[3]) for r in one}:
        assert abs(sum(r[5] for r in one if (r[2], r[3]) == source) - source[1]) <= 14
    assert all(r[5] <= 3 * r[1] for r in one)
    whole = mixing.mixed(df.withColumn("n", F.lit(1)), bucket=64)
    assert whole.count() == sum(r[4] for r in one) and whole.columns == ["doc_id", "text", "source", "n"]


def test_toxicity_query_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in queries.op11_toxicity(spark, folder).collect()}
    docs = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    assert got.keys() == set(docs)
    assert all(r["held_out"] == (crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    labels = [(got[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    yes, no = ([s for s, y in labels if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.85
    assert np.mean([s < 0.3 for s in no]) > 0.97
