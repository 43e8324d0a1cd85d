"""Phrase collocations: vertical positional inverted lists, extended level by level.

Documents are cut into shards of bounded size. A shard's list of a phrase holds the sorted positions
where the phrase begins; piece ends take a position of their own, so that neighbours are
neighbours within a piece. Lists of k + 1 words come from merging lists of k words: the
positions of one with those of another that lie one further on. The length of a list is the
phrase's exact count in the shard. Only counts leave their shard: they are summed by phrase, and
the shards hear which of their phrases are frequent; all others are dropped before the next
merge, as no phrase is more frequent than its parts.

Phrases are told apart by numbers given out when they are counted, not by hashes, so that
counts are exact at any size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, released, stored
from .common import checkpointed, sliced, tidy

#: Ends of pieces become one mark, A-Z its small letter; tab and space part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"."
FOLD = bytes(MARK[0] if i in ENDS else i + 32 if 65 <= i <= 90 else i for i in range(256))

LISTS = "shard long, lang string, n long, keys long, words binary, a binary, b binary, lens binary, pos binary"
COUNTED = "shard long, lang string, at binary, gid binary, f array<struct<gid long, word string, a long, b long, n long>>"


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed differences, byte by byte of all of them, with the length in front."""
    step = np.diff(values, prepend=values.dtype.type(0))
    raw = ((step << 1) ^ (step >> (step.itemsize * 8 - 1))).view(np.uint8).reshape(-1, step.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"u{size}").reshape(-1)
    return np.cumsum((step >> 1).astype(kind) ^ -(step & 1).astype(kind), dtype=kind)


def joined(words: list[bytes]) -> bytes:
    """Words, which hold no line end, as one compressed text."""
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def parted(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def word_lists(docs: DataFrame, text: Column, lang: Column, tokens: int) -> DataFrame:
    """Per shard and language the positions of each word (LISTS); n counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, marks = count(TaskContext.get().partitionId() << 24), 0, {}
        vocabulary: dict = {}

        def rows() -> Iterator[pa.RecordBatch]:
            shard = next(seq)
            for of, parts in marks.items():
                words = list(vocabulary[of])[1:]
                rank = np.zeros(len(words) + 1, np.int32)
                rank[sorted(range(1, len(rank)), key=lambda i: words[i - 1])] = np.arange(1, len(rank))
                ids = rank[np.concatenate(parts)]
                lens = np.bincount(ids)
                pos = np.argsort(ids, kind="stable").astype(np.int32)[lens[0] :]
                if words:
                    yield pa.RecordBatch.from_pylist(
                        [{"shard": shard, "lang": of, "n": len(pos), "keys": len(words), "words": joined(sorted(words)), "a": None, "b": None, "lens": packed(lens[1:]), "pos": packed(pos)}],
                        schema=WORDS,
                    )
            marks.clear()
            vocabulary.clear()
            tidy()

        for batch in batches:
            for some in sliced(batch, 0):
                for t, of in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found = t.encode().translate(FOLD).replace(MARK, b" . ").split()
                    found.append(MARK)
                    if of not in marks:
                        marks[of], d = [], defaultdict(count().__next__)
                        d[MARK]
                        vocabulary[of] = d
                    marks[of].append(np.fromiter(map(vocabulary[of].__getitem__, found), np.int32, len(found)))
                    held += len(found)
                    if held >= tokens:
                        yield from rows()
                        held = 0
        yield from rows()

    return docs.select(F.coalesce(text, F.lit("")).alias("text"), lang.alias("lang")).mapInArrow(run, LISTS)


WORDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("keys", pa.int64()), ("words", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("lens", pa.binary()), ("pos", pa.binary())])
CHUNKS = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("words", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("lens", pa.binary())])
FREQUENT = pa.struct([("gid", pa.int64()), ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
ANSWERS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("gid", pa.binary()), ("f", pa.list_(FREQUENT))])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def counted(lists: DataFrame, level: int, least: int, keys: int) -> DataFrame:
    """What is frequent (f) and, for each shard, which of its keys that are (at, gid).

    The keys of a shard travel in chunks, each with the keys of one of the parts that all keys are
    dealt to by hash. A key comes once from each shard, so no part is hotter than others.
    """
    total = lists.agg(F.sum("keys")).first()[0] or 0
    parts = max(1, math.ceil(total / keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, of, words, a, b, lens = (batch.column(i)[r] for i in range(6))
                n = unpacked(lens.as_py(), np.int64)
                if level == 1:
                    words = np.array(parted(words.as_py()), dtype=object)
                    h = pd.util.hash_array(words, categorize=False)
                else:
                    a, b = unpacked(a.as_py(), np.int64), unpacked(b.as_py(), np.int64)
                    h = mixed(a, b)
                part = (h % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
                out, start = [], 0
                for end in ends:
                    at = order[start:end]
                    row = {"part": int(part[at[0]]), "shard": shard.as_py(), "lang": of.as_py(), "at": packed(at.astype(np.int32)), "words": None, "a": None, "b": None, "lens": packed(n[at])}
                    out.append(row | ({"words": joined(words[at].tolist())} if level == 1 else {"a": packed(a[at]), "b": packed(b[at])}))
                    start = end
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[i : i + 256], schema=CHUNKS)

    def add(chunks: pa.Table) -> pa.Table:
        n = [unpacked(x, np.int64) for x in chunks["lens"].to_pylist()]
        ends = np.cumsum([len(x) for x in n])
        each = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
        n, langs = np.concatenate(n), chunks["lang"].to_pylist()
        if level == 1:
            flat = [x for w in chunks["words"].to_pylist() for x in parted(w)]
            code = pa.array(langs).dictionary_encode().indices.to_numpy()[each]
            text = pa.array(flat).dictionary_encode()
            low = text.indices.to_numpy().astype(np.int64)
            first, last = code.astype(np.int64), low
        else:
            first, last = (np.concatenate([unpacked(x, np.int64) for x in chunks[c].to_pylist()]) for c in "ab")
        order = np.lexsort((last, first))
        new = np.diff(first[order], prepend=-1) != 0
        new[1:] |= np.diff(last[order]) != 0
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n[order], starts)
        kept = np.flatnonzero(sums >= least)
        own = (level << 58) + int(chunks["part"][0].as_py()) + parts * np.arange(len(kept))
        number = np.full(len(starts), -1, np.int64)
        number[kept] = own
        gid = np.empty(len(n), np.int64)
        gid[order] = number[np.cumsum(new) - 1]
        rows = []
        for i, (shard, of, at) in enumerate(zip(chunks["shard"].to_pylist(), langs, chunks["at"].to_pylist(), strict=True)):
            got = gid[ends[i - 1] if i else 0 : ends[i]]
            if (got >= 0).any():
                rows.append({"shard": shard, "lang": of, "at": packed(unpacked(at, np.int32)[got >= 0]), "gid": packed(got[got >= 0]), "f": None})
        of_key = order[starts[kept]]
        found: dict[str, list] = defaultdict(list)
        for j, at in enumerate(of_key):
            word = flat[at].decode() if level == 1 else None
            pair = (None, None) if level == 1 else (int(first[at]), int(last[at]))
            found[langs[each[at]]].append({"gid": int(own[j]), "word": word, "a": pair[0], "b": pair[1], "n": int(sums[kept[j]])})
        rows += [{"shard": None, "lang": of, "at": None, "gid": None, "f": f[i : i + 5000]} for of, f in found.items() for i in range(0, len(f), 5000)]
        return pa.Table.from_pylist(rows, schema=ANSWERS)

    chunks = lists.select("shard", "lang", "words", "a", "b", "lens").mapInArrow(
        deal, "part int, shard long, lang string, at binary, words binary, a binary, b binary, lens binary"
    )
    return stored(chunks.groupBy("part").applyInArrow(add, COUNTED))


def extended(lists: DataFrame, answers: DataFrame) -> DataFrame:
    """Lists of one word more, of phrases both whose parts are frequent."""
    blank = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    of = answers.where("shard is not null").select("shard", "lang", *blank(("keys", "long"), ("lens", "binary"), ("pos", "binary")), "at", "gid")
    own = lists.select("shard", "lang", "keys", "lens", "pos", *blank(("at", "binary"), ("gid", "binary")))

    def merge(rows: pa.Table) -> pa.Table:
        gid = None
        for r in rows.select(["keys", "lens", "pos"]).to_pylist():
            if r["keys"] is not None:
                gid, lens, pos = np.full(r["keys"], -1, np.int64), unpacked(r["lens"], np.int64), unpacked(r["pos"], np.int32)
        for r in rows.select(["at", "gid"]).to_pylist():
            if r["at"] is not None:
                gid[unpacked(r["at"], np.int32)] = unpacked(r["gid"], np.int64)
        of = np.repeat(np.arange(len(gid), dtype=np.int32), lens)
        good = gid[of] >= 0
        of, pos = of[good], pos[good]
        order = np.argsort(pos)
        of, pos = of[order], pos[order]
        next_ = np.flatnonzero(np.diff(pos) == 1)
        if not len(next_):
            return pa.Table.from_pylist([], schema=WORDS)
        known = np.unique(gid[gid >= 0])
        place = np.searchsorted(known, gid)
        key, pos = place[of[next_]] * len(known) + place[of[next_ + 1]], pos[next_]  # pairs in the order of their numbers
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        row = {"shard": rows["shard"][0].as_py(), "lang": rows["lang"][0].as_py(), "n": len(pos), "keys": len(starts), "words": None}
        row |= {"a": packed(known[key[starts] // len(known)]), "b": packed(known[key[starts] % len(known)]), "lens": packed(np.diff(starts, append=len(key))), "pos": packed(pos)}
        return pa.Table.from_pylist([row], schema=WORDS)

    return own.unionByName(of).groupBy("shard", "lang").applyInArrow(merge, LISTS)


def collocations(
    docs: DataFrame,
    *,
    least: int = 100,
    longest: int = 5,
    cover: int = 100,
    first: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    shard_tokens: int = 3_000_000,
    part_keys: int = 400_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the first phrases by score.

    A phrase has 2 to `longest` words of one piece and occurs least times at least (a). The score is
    floor(1000 * a * n / (l * r)) of its lowest-scoring cut into two parts that occur l and r
    times; n counts the language's words. Phrases inside a longer one that occurs in at least
    cover % of their places are left out.

    A null text is empty, a null language is `und`. Texts without words, empty tables and tables
    without a frequent phrase give no rows. Every row counts, repeated ones each time. Ties
    go to the more frequent phrase, then to the smaller one by bytes. Other columns are ignored, ids too.
    A text of any length belongs to one shard, which it may make larger than shard_tokens.
    """
    lists = stored(word_lists(docs, F.col(text_col), F.coalesce(F.col(lang_col), F.lit("und")), shard_tokens))
    totals = lists.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = stored(totals)
    levels = []
    for level in range(1, longest + 1):
        answers = counted(lists, level, least, part_keys)
        levels.append(answers.where("shard is null").select("lang", F.inline("f")))
        if level < longest:
            longer = stored(extended(lists, answers))
            dropped(lists)
            lists = longer
            released(lists)
    dropped(lists)
    return _ranked(levels, totals, cover, first)


def _ranked(levels: list[DataFrame], totals: DataFrame, cover: int, first: int) -> DataFrame:
    none = F.array().cast("array<long>")
    info = levels[0].select("lang", "gid", "n", F.array("word").alias("words"), none.alias("pre"), none.alias("suf"))
    found = None
    for k in range(2, len(levels) + 1):
        p, s = (info.select(*(F.col(c).alias(f"{side}_{c}") for c in ("gid", "n", "words", "pre", "suf"))) for side in "ps")
        info = levels[k - 1].join(p, F.col("a") == F.col("p_gid")).join(s, F.col("b") == F.col("s_gid"))
        info = info.select(
            "lang", "gid", "n",
            F.concat("p_words", F.slice("s_words", -1, 1)).alias("words"),
            F.concat("p_pre", F.array("p_n")).alias("pre"),
            F.concat("s_suf", F.array("s_n")).alias("suf"),
        )
        info = checkpointed(info)  # it is read by the next level and by the result
        here = info
        if k < len(levels):
            longer = levels[k].select("n", F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.max("n").alias("inside"))
            here = info.join(longer, "gid", "left").where(f"inside is null or 100 * inside < {int(cover)} * n").drop("inside")
        found = here if found is None else found.unionByName(here)
    wide = lambda c: c.cast("decimal(19,0)")
    found = found.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("up", wide(F.col("n")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)"))
    cut = "transform(sequence(1, size(pre)), j -> named_struct('score', up div (cast(pre[j - 1] as decimal(19,0)) * cast(suf[size(suf) - j] as decimal(19,0))), 'j', j, 'l', pre[j - 1], 'r', suf[size(suf) - j]))"
    best = found.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.col("total").alias("n"), F.array_min(F.expr(cut)).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
