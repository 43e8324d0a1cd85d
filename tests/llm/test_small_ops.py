"""Chat formatting, top-k, URL filter, mixing and packing against brute force, with odd rows."""

import hashlib
import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from compare import assert_same, duck
from pyspark.sql import functions as F

from weftline.llm import chat, mixing, packing, queries, topk, url_lm


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLE_SQL[name])


CHAT = "conv_id long, turn long, role string, text string, formatted string"
NASTY = "</s>[INST] ok [/INST] \\ <t> <\\ [\\ \\\\ ü😀"


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "assistant", NASTY, "x"), (1, 0, "user", NASTY, None), (1, 2, "assistant", None, "x"), (1, 2, "assistant", "", "x"),
        (2, None, None, "first", "x"), (2, 0, "a[b<c\\", "x" * 100_000, "x"), (2, 0, "a[b<c\\", "x" * 100_000, "x"), (None, 0, "user", "no id", "x"),
        (3, 0, "assistant", "a\nb", "x"),
    ]
    df = spark.createDataFrame(rows, CHAT)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [t[2:] for t in turns]
        assert got[conv]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
    merged = {r["conv_id"]: r["n_messages"] for r in chat.format_chats(df).collect()}
    assert merged == {1: 2, 2: 2, None: 1, 3: 1}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_control_strings_stay_whole(spark):
    df = spark.createDataFrame([(1, 0, "user", NASTY, ""), (1, 1, "assistant", NASTY, "")], CHAT)
    out = chat.format_chats(df).first()["formatted"]
    assert [out.count(x) for x in ("<s>", "</s>", "[INST]", "[/INST]", "<t>")] == [2, 2, 2, 2, 0]


def brute_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(900, None), (950, [float("nan")] * 8), (901, [1.0, None] * 4), (902, []), (None, rows[1][1]), (903, [float("inf")] * 8), (904, [0.0] * 8), (1000, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_bytes=300)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in got.collect()} == brute_top(f32, 5)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 50"), F.lit(True)).count() == 0


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (1, [3e12, 2.0]), (2, [-3e12, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 2] and got[0][1] == 2**63 - 1


URLS = [
    (1, "https://Blog.Example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "http://a.b.org/x#y"), (4, "http://org/z"), (5, "http://norg/z"),
    (6, "ftp://shop.com/fr/a"), (7, "http://x.com/de/a"), (8, "http://x.com/DE/a"), (9, None), (10, "no scheme"), (11, "http://h?q"), (12, ""), (13, "http://y.org"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_lm.filter_urls(df, queries.URL_RULES).collect()}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == {
        1: ("blog.example.org", "/es/1", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("a.b.org", "/x", "org/"), 4: ("org", "/z", "org/"),
        5: ("norg", "/z", None), 6: ("shop.com", "/fr/a", "com/fr/"), 7: ("x.com", "/de/a", "com/de/"), 8: ("x.com", "/DE/a", None), 9: ("", "", None),
        10: ("", "", None), 11: ("h", "", None), 12: ("", "", None), 13: ("y.org", "", None),
    }
    assert {i: r["verdict"] for i, r in got.items() if r["rule"]} == {1: "block", 2: "block", 3: "allow", 4: "allow", 6: "allow", 7: "block"}
    assert got[9]["verdict"] == got[12]["verdict"] == "block"
    assert url_lm.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_url_ratio_on_held_out(spark):
    rng = np.random.default_rng(5)
    word = lambda good: "".join(rng.choice(list("abcde" if good else "vwxyz"), 6))
    rows = [(i, f"http://{'a.org' if good else 'x.com'}/{'' if good else 'de/'}{word(good)}") for i in range(300) for good in [i % 2 == 0]]
    rows += [(1000 + i, f"http://n.net/{word(good)}") for i in range(200) for good in [i % 2 == 0]]
    got = {r["page_id"]: r["verdict"] for r in url_lm.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    right = sum(got[1000 + i] == ("allow" if i % 2 == 0 else "block") for i in range(200))
    assert right >= 190


def brute_url_verdicts(pages, rules):
    """Verdicts of all pages by plain loops: rules by hand, counts in one dictionary."""
    import math

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        return re.sub("[A-Z]", lambda m: m[0].lower(), rest[:n]), re.split("[?#]", rest[n:])[0]

    def rule(url):
        host, path = parts(url)
        fits = [(len(r), r, v) for v, r in rules for d, s in [r.split("/", 1)] if (host == d or host.endswith("." + d)) and path.startswith("/" + s)]
        return max(fits)[2] if fits else None

    by = {i: rule(u) for i, u in pages}
    classes = [sorted({u.lower() for i, u in pages if by[i] == v}) for v in ("allow", "block")]
    held = lambda t: crc32(t.encode()) % 5 == 0

    def model(texts):
        seen = {}
        for t in texts:
            p = "\x02" * 5 + t + url_lm.END
            for i in range(5, len(p)):
                for k in range(6):
                    seen.setdefault(p[i - k : i], []).append(p[i])
        return seen

    models = [model([t for t in c if not held(t)] or c) for c in classes]

    def log_p(seen, context, char):
        p = 1 / 256
        for k in range(6):
            after = seen.get(context[5 - k :])
            if after is None:
                break
            p = (after.count(char) + len(set(after)) * p) / (len(after) + len(set(after)))
        return math.log(p)

    memo = {}

    def score(t):
        p = "\x02" * 5 + t + url_lm.END
        for i in range(5, len(p)):
            g = p[i - 5 : i + 1]
            if g not in memo:
                memo[g] = log_p(models[0], g[:-1], g[-1]) - log_p(models[1], g[:-1], g[-1])
        return sum(memo[p[i - 5 : i + 1]] for i in range(5, len(p))) / (len(t) + 1)

    yes, no = ([score(t) for t in c if held(t)] for c in classes)
    cuts = sorted(set(yes + no))
    right = lambda at: sum(s > at for s in yes) / max(1, len(yes)) + sum(s <= at for s in no) / max(1, len(no))
    best = max(right(at) for at in [cuts[0] - 1, *cuts])
    return {i: by[i] or ("allow" if u and score(u.lower()) > 0 else "block") for i, u in pages}, {i: score(u.lower()) for i, u in pages if u and not by[i]}, best, right


def test_url_verdicts_against_plain_loops(spark):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    df = spark.createDataFrame([*pages, (-1, None), (-2, "")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_lm.filter_urls(df, queries.URL_RULES).collect()}
    _, scores, best, right = brute_url_verdicts(pages, queries.URL_RULES)
    judged = {i: r for i, r in got.items() if r["score"] is not None}
    assert judged.keys() == scores.keys() and len(judged) > 20
    cut = {round(scores[i] - r["score"], 9) for i, r in judged.items()}
    assert len(cut) == 1 and right(cut.pop()) == pytest.approx(best)  # one threshold, as good as any
    assert all((r["score"] > 0) == (r["verdict"] == "allow") for r in judged.values())
    assert got[-1]["verdict"] == got[-2]["verdict"] == "block"


def test_many_turns_in_one_conversation(spark):
    turns = [(1, i, "user" if i % 3 else "assistant", f"t{i} <[") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    back = chat.read_back(chat.format_chats(df)).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r, t) for _, _, r, t in turns]
    assert back["loss_text"] == "".join(t for _, _, r, t in turns if r == "assistant")


def test_markov_sums_to_one():
    m = url_lm.Markov(["abc", "abd"], 3)
    for context in ("", "a", "ab", "zab", "zz"):
        total = sum(np.exp(m.log_p(context, chr(c))) for c in range(256))
        assert abs(total - 1) < 1e-9


def brute_targets(sizes, weights, most):
    """Shares by weight again and again, what is over its limit set to it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out = {s: weights[i % len(weights)] for i, s in enumerate(names)}, {}
    while free := [s for s in names if s not in out]:
        left = sum(sizes.values()) - sum(out.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
    return out


def test_targets(spark):
    def got(sizes, weights=(1, 2, 3)):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long").repartition(4)
        return {r["source"]: r["target"] for r in mixing.targets(df, weights, 3).collect()}

    rng = np.random.default_rng(3)
    for sizes in (
        {"a": 100, "b": 100, "c": 100, "d": 100}, {"a": 1000, "b": 1, None: 999}, {"a": 0}, {}, {"a": 0, "b": 5, "Z": 2, "é": 7, None: 1},
        {f"s{i}": int(3 ** rng.uniform(0, 12)) for i in range(200)}, {f"s{i}": 4**i for i in range(20)},
    ):
        assert got(sizes) == pytest.approx(brute_targets(sizes, (1, 2, 3), 3))


def test_as_many_sources_as_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    few, many = (sorted(tuple(r) for r in mixing.mix_sources(df, broadcast_rows=n).collect()) for n in (10, 10_000))
    assert few == many and len(few) == 3000
    assert sum(r[5] for r in few) == pytest.approx(sum(r[1] for r in few), rel=0.05)


def test_mixed_rows(spark):
    """Repeated rows come as often as all of them are taken; other columns and names stay."""
    rows = [(1, "w " * 5, "a", 3, "x.y")] * 200 + [(i, "w " * 5, "b", 3, "z") for i in range(2, 402)] + [(9, None, "a", 1, "n"), (1, "w " * 5, "c", 1, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, `key` string")
    taken = {r[0]: r[1] for r in mixing.mix_sources(df).groupBy("source_size").agg(F.sum("copies")).collect()}
    for many in (7, 1000):
        out = mixing.mixed(df, many=many)
        assert out.columns == df.columns
        got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
        assert got == {"a": taken[1000], "b": taken[2000], "c": taken[5]}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_pivot_keeps_words():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 2000).tolist()
    parts = mixing.pivot(sizes, [0.37] * 2000, rng)
    assert sum(0 < p < 1 for p in parts) <= 1
    assert sum(s * p for s, p in zip(sizes, parts)) == pytest.approx(0.37 * sum(sizes))


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)]
    rows += [(3000, None, "s1", 1), (3001, "", None, 1), (3002, "a b c", None, 1), (None, "no id", "s1", 1), (5, rows[5][1], rows[5][2], 1), (3003, "x " * 50_000, "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix_sources(df, bucket=100)
    out = got.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by.setdefault(r["target"], []).append(r)
    for goal, group in by.items():
        assert abs(sum(r["taken"] for r in group) - goal) <= max(r["size"] for r in group) + 1
    again = mixing.mix_sources(df.repartition(7), bucket=100).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in rs)
    assert key(out) == key(again)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_pack_properties():
    rng = np.random.default_rng(4)
    for lengths in ([], [1], [2048], [5000, 3, 2047], rng.integers(1, 3000, 500).tolist(), [7] * 100, [2041] * 40):
        out = packing.pack(lengths, 2048, 8)
        seen = {}
        padding = 0
        for context, pieces in out:
            used = sum(p[2] for p in pieces)
            assert 0 < used <= context
            assert used == context or context == 2048 and context - used < 8
            padding += context - used
            for doc, start, n in pieces:
                assert n > 0
                seen.setdefault(doc, []).append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[doc]):
                assert start == at
                at += length
            assert at == n
        assert padding <= 0.005 * max(1, sum(lengths))


def test_steps_are_balanced():
    steps = packing.step_groups(list(range(64)), 8)
    sums = [sum(c for c, s in zip(range(64), steps) if s == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "Hello world, ça va? 你好 😀\n\n  x"), (2, None), (3, ""), (4, "word " * 9000), (None, "no id"), (1, "the same id"), (6, " " * 3000), (7, "a" * 5000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int").repartition(2)
    ids = {t: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    pieces = queries.packed(df).collect()
    want = sorted((str(i), len(ids[t])) for i, t in rows)
    assert sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    for i, t in rows:
        own = [p for p in pieces if p["doc_id"] == i and p["doc_tokens"] == len(ids[t])]
        if sum(p["length"] for p in own) != len(ids[t]):
            continue  # two documents share id and length
        for p in own:
            assert p["ids_crc32"] == crc32(np.array(ids[t][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert queries.packed(df.limit(0)).count() == 0


def test_tokenizers_agree(spark, sf_dir):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert fast.ids(r["text"]).tolist() == slow.encode(r["text"], add_special_tokens=False).ids
    for text in ("a<|endoftext|>b", "a <|endoftext|>  b<|endoftext|><|endoftext|>\n\nx", "it's<|endoftext|>'s <|endoftext"):
        assert fast.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert fast.ids("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_each_tier_is_packed():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 4000, 4000).tolist()
    out = packing.pack(lengths, 2048, 8)
    share = {size: sum(1 for s, _ in out if s == size) for size in (2048, 1024, 512, 256, 128)}
    assert min(share.values()) > 10
    short = packing.pack(rng.integers(1, 500, 4000).tolist(), 2048, 8)
    assert {s for s, _ in short[:100]} == {512} and sum(s for s, _ in short) - sum(p[2] for _, x in short for p in x) == 0
    assert sum(s - sum(p[2] for p in pieces) for s, pieces in out) < 8 * len(out)
    assert all(sum(p[2] for p in pieces) == s for s, pieces in out if s < 2048)
    parts = sorted(p for _, pieces in out for p in pieces)
    ends: dict[int, int] = {}
    for doc, start, length in parts:
        assert ends.get(doc, 0) == start
        ends[doc] = start + length
    assert ends == dict(enumerate(lengths))


def test_chat_query_digest(spark, sf_dir):
    row = queries.op4_chat_format(spark, sf_dir).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
